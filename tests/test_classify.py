"""Samples of the sorted ids."""

from __future__ import annotations

import pytest

from viewtrail.operators import classify as q


@pytest.mark.parametrize(("count", "n"), [(300_000, 50), (30, 50), (50, 50), (0, 50)])
def test_strided_sample_is_that_of_the_sorted_ids(spark, count, n):
    ids = spark.range(count).selectExpr("concat('v', id * 7919 % 1000003) AS video_id").repartition(7)
    every = sorted(f"v{i * 7919 % 1000003}" for i in range(count))
    want = every if n >= count else [every[int(i * count / n)] for i in range(n)]
    assert sorted(r[0] for r in q.strided_sample(ids, n).collect()) == want
