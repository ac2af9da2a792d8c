"""Classification: ordered rules, cached verdicts, retries and projections."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNCLEAR, area_of, normalize_topic, replace_area, stale, sub_of
from ..sources.scratch import scratch

LEAST_SUB_CONFIDENCE = 0.4
SEEDS_PER_AREA, CONTEXT_TOPICS = 12, 3


def _any_holds(tags: Column, part: str) -> Column:
    return F.exists(tags, lambda tag: F.contains(tag, F.lit(part)))


@dataclass(frozen=True)
class Rule:
    """Matches if any of its lists does; the first rule that matches decides."""

    id: str
    topic: str
    mode: str = ""
    title_any: tuple[str, ...] = ()
    channel_any: tuple[str, ...] = ()
    tag_any: tuple[str, ...] = ()
    text_any: tuple[str, ...] = ()
    category_any: tuple[str, ...] = ()

    def condition(self) -> Column:
        """Over the columns title, channel, tags and categories."""
        low = lambda xs: [x.lower() for x in xs]
        title, tags = F.lower(F.coalesce("title", F.lit(""))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
        categories = F.transform(F.coalesce("categories", F.array().cast("array<string>")), F.lower)
        parts = [F.contains(title, F.lit(x)) for x in low(self.title_any)]
        if self.channel_any:
            parts.append(F.lower(F.coalesce("channel", F.lit(""))).isin(*low(self.channel_any)))
        parts += [F.array_contains(tags, x) for x in low(self.tag_any)]
        parts += [F.contains(title, F.lit(x)) | _any_holds(tags, x) for x in low(self.text_any)]
        parts += [F.array_contains(categories, x) for x in low(self.category_any)]
        return reduce(lambda a, b: a | b, parts, F.lit(False))


def match(rules: list[Rule]) -> Column:
    """struct(rule, topic, mode) of the first rule that matches, or null."""
    hits = [F.when(r.condition(), F.struct(F.lit(r.id).alias("rule"), F.lit(r.topic).alias("topic"), F.lit(r.mode).alias("mode"))) for r in rules]
    return F.coalesce(*hits) if hits else F.lit(None)


def video_inputs(views: DataFrame, metadata: DataFrame, order: str = "event_id") -> DataFrame:
    """One row a video: its first view's title and channel, metadata over them."""
    first = views.filter(F.coalesce("video_id", F.lit("")) != "").groupBy("video_id").agg(F.min_by(F.struct("title", "channel"), order).alias("f"), F.count("*").alias("views"))
    m = metadata.select("video_id", F.col("title").alias("_t"), F.col("channel").alias("_c"), "tags", "categories", "unavailable")
    pick = lambda mine, own: F.coalesce(F.when(~F.coalesce("unavailable", F.lit(False)), F.nullif(F.col(mine), F.lit(""))), F.col(own))
    return first.join(m, "video_id", "left").select("video_id", "views", pick("_t", "f.title").alias("title"), pick("_c", "f.channel").alias("channel"), "tags", "categories", F.col("unavailable").isNotNull().alias("has_meta"), F.coalesce("unavailable", F.lit(False)).alias("unavailable"))


def resolve_cached(items: DataFrame, cache: DataFrame, areas: list[str], fingerprint: str, aliases: dict[str, str] | None = None, title_only: bool = False, keep_verdicts: bool = False) -> DataFrame:
    """Adds topic, mode, source, confidence, stale, waiting, ask: what the cache or the category decides.

    items have video_id, category_area, has_meta and unavailable. The category's
    area wins over the cached one: a subject survives only where the areas agree,
    otherwise the bare area stands, with the verdict's mode, source and
    confidence, even if the cached area exists no more. Without a category the
    cached topic must name a known area. What has no verdict keeps the category's
    area alone. A cached verdict may be stale whether it is usable or not;
    ``keep_verdicts`` ignores the areas it was judged under. Videos without a
    verdict are asked once metadata is there, or at once with ``title_only``.
    """
    c = cache.select("video_id", F.lit(True).alias("_hit"), F.col("topic").alias("_t"), F.col("mode").alias("_m"), "confidence", "model", "basis", "taxonomy")
    j = items.join(c, "video_id", "left")
    area, hit = F.nullif(F.col("category_area"), F.lit("")), F.coalesce("_hit", F.lit(False))
    same = F.lower(F.trim(area_of("_t"))) == F.lower(area)
    topic = F.when(area.isNull(), normalize_topic("_t", areas, aliases)).when(same, replace_area("_t", area, areas, aliases)).otherwise(area)
    known = hit & topic.isNotNull()
    now = F.coalesce("taxonomy", F.lit("")) if keep_verdicts else F.lit(fingerprint)
    old = hit & stale("taxonomy", "basis", "has_meta", "unavailable", now)
    ready = F.lit(True) if title_only else F.col("has_meta")
    return j.select(
        "video_id", F.when(known, topic).otherwise(F.coalesce(area, F.lit(UNCLEAR))).alias("topic"), F.when(known, F.coalesce("_m", F.lit(""))).otherwise("").alias("mode"),
        F.when(known, F.concat(F.lit("llm:"), F.coalesce("model", F.lit("")))).when(area.isNotNull(), "category").otherwise("unclassified").alias("source"),
        F.when(known, F.col("confidence")).otherwise(0.0).alias("confidence"), old.alias("stale"), (~hit & ~ready).alias("waiting"), (old | (~hit & ready)).alias("ask"),
    )


def join_back(views: DataFrame, verdicts: DataFrame, metadata: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every view with its video's verdict and metadata.

    Views without an id get the rules on their own title and channel instead.
    """
    v = verdicts.select("video_id", "topic", "mode", "source")
    m = metadata.select("video_id", "duration_s", "unavailable")
    j = views.join(v, "video_id", "left").join(m, "video_id", "left")
    if rules:
        none = F.array().cast("array<string>")
        own = j.withColumns({"tags": none, "categories": none}).withColumn("_rule", F.when(F.coalesce("video_id", F.lit("")) == "", match(rules)))
        j = own.withColumns({"topic": F.coalesce("_rule.topic", "topic"), "mode": F.coalesce("_rule.mode", "mode"), "source": F.coalesce(F.concat(F.lit("rule:"), "_rule.rule"), "source")}).drop("_rule", *({"tags", "categories"} - set(views.columns)))
    return j.withColumn("topic", F.coalesce("topic", F.lit(UNCLEAR))).withColumn("source", F.coalesce("source", F.lit("unclassified")))


def merge_verdicts(cache: DataFrame, answers: DataFrame, kind: str, areas: list[str]) -> DataFrame:
    """The cache after a round: sub, mode or full.

    answers: video_id, sub, confidence and the verdict's area of a sub round;
    video_id and mode of a mode round; video_id, topic, mode, confidence, model,
    basis, taxonomy, area (the category's, or null) and marker of a full round.

    A sub round changes topic and confidence if the subject isn't blank and
    confident enough, a mode round a mode that isn't blank; every answer, blank
    and hesitant ones too, is marked as asked, so that it isn't asked for ever. A
    full round replaces the verdict, but for an area that the category imposes,
    and keeps the markers only where it was asked for a marked reason.
    """
    a = answers.select("video_id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in answers.columns if c != "video_id"))
    j = cache.join(a, "video_id", "left")
    hit, marks = F.coalesce("_hit", F.lit(False)), F.coalesce("retried", F.array().cast("array<string>"))
    if kind == "sub":
        sure = hit & (F.coalesce("_sub", F.lit("")) != "") & (F.coalesce("_confidence", F.lit(0.0)) >= LEAST_SUB_CONFIDENCE)
        new = {"topic": F.when(sure, F.concat_ws("/", "_area", "_sub")).otherwise(F.col("topic")), "confidence": F.when(sure, F.col("_confidence")).otherwise(F.col("confidence"))}
    elif kind == "mode":
        new = {"mode": F.when(hit & (F.coalesce("_mode", F.lit("")) != ""), F.col("_mode")).otherwise(F.col("mode"))}
    else:
        topic = F.when(F.coalesce("_area", F.lit("")) != "", replace_area("_topic", "_area", areas)).otherwise(F.col("_topic"))
        new = {"topic": F.when(hit, topic).otherwise(F.col("topic"))} | {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("mode", "confidence", "model", "basis", "taxonomy")}
    asked = F.array_union(marks, F.array(F.lit(kind)))
    if kind == "full":
        asked = F.when(F.col("_marker").isNotNull(), F.array_union(marks, F.array("_marker"))).otherwise(F.array().cast("array<string>"))
    return j.withColumns(new | {"retried": F.when(hit, asked).otherwise(F.col("retried"))}).select(*cache.columns)


def sub_seeds(topics: DataFrame, areas: list[str], asked_again: list[str] | None = None, k: int = SEEDS_PER_AREA) -> DataFrame:
    """The most frequent subjects of each area over all topics so far.

    topics: one row a verdict of the rules or of the cache. Topics are brought to
    their present spelling; unknown areas and topics that are asked again, whose
    answers mustn't be offered back, seed nothing.
    """
    now = topics.select(normalize_topic("topic", areas).alias("topic")).filter(F.col("topic").isNotNull())
    if asked_again:
        now = now.filter(~F.col("topic").isin(*asked_again))
    n = now.select(area_of("topic").alias("area"), sub_of("topic").alias("sub")).filter("sub <> ''").groupBy("area", "sub").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("area").orderBy(F.col("n").desc(), "sub"))).filter(F.col("rank") <= k)


def channel_context(items: DataFrame, verdicts: DataFrame, k: int = CONTEXT_TOPICS) -> DataFrame:
    """For each item the commonest topics of its channel's other videos."""
    known = verdicts.filter(F.col("topic") != UNCLEAR).groupBy("channel", "topic").agg(F.count("*").alias("n"))
    own = items.join(verdicts.select("video_id", F.col("topic").alias("own")), "video_id", "left")
    other = own.join(known, "channel").withColumn("n", F.col("n") - F.when(F.col("topic") == F.col("own"), 1).otherwise(0)).filter("n > 0")
    ranked = other.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("n").desc(), "topic"))).filter(F.col("rank") <= k)
    return ranked.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]), "|").alias("context"))


def model_drift(cache: DataFrame, want: str) -> DataFrame:
    """(model, video_id) of the verdicts that other models gave; a model's ids in order are its rows by id."""
    return cache.filter(~F.coalesce("model", F.lit("")).isin("", want)).select("model", "video_id")


def defects(verdicts: DataFrame) -> DataFrame:
    """One row of counters: what the next retry could select of a model's verdicts."""
    t, done = F.col("topic"), lambda k: F.coalesce(F.array_contains("retried", k), F.lit(False))
    judged = verdicts.filter(F.col("source").startswith("llm:") & (t != UNCLEAR))
    return judged.agg(F.count_if((sub_of(t) == "") & ~done("sub")).alias("no_sub"), F.count_if((F.coalesce("mode", F.lit("")) == "") & ~done("mode")).alias("no_mode"))


def retry_targets(verdicts: DataFrame, selectors: list[str]) -> DataFrame:
    """(video_id, kind, marker): full, sub or mode; a video may be in sub and mode.

    verdicts: video_id, topic (null: not usable, never asked), mode, retried and
    usable_text. Each defect is asked once: its marker is in ``retried`` then. An
    unclear topic is asked for context alone; a named topic is asked in full and
    wins over the other defects.
    """
    t, done = F.col("topic"), lambda k: F.coalesce(F.array_contains("retried", k), F.lit(False))
    named = [s.removeprefix("topic:") for s in selectors if s.startswith("topic:")]
    want = lambda s: F.lit("all" in selectors or s in selectors)
    own = F.concat(F.lit("topic:"), t)
    whole = (t.isin(*named) if named else F.lit(False)) & ~done(own) & (t != UNCLEAR)
    target = lambda when, kind, marker: F.when(when, F.struct(F.lit(kind).alias("kind"), (marker if marker is not None else F.lit(kind)).alias("marker")))
    rest = ~whole & (t != UNCLEAR)
    found = F.array(
        target(want("unclear") & (t == UNCLEAR) & ~done("context") & F.col("usable_text"), "full", F.lit("context")), target(whole, "full", own),
        target(rest & want("no-sub") & (sub_of(t) == "") & ~done("sub"), "sub", None), target(rest & want("no-mode") & (F.coalesce("mode", F.lit("")) == "") & ~done("mode"), "mode", None),
    )
    return verdicts.filter(t.isNotNull()).select("video_id", F.explode(F.array_compact(found)).alias("x")).select("video_id", "x.kind", "x.marker")


def within_budget(targets: DataFrame, limit: int) -> DataFrame:
    """The first so many targets: sub before mode before full, then by id."""
    order = F.when(F.col("kind") == "sub", 1).when(F.col("kind") == "mode", 2).otherwise(3)
    return targets.orderBy(order, "video_id").limit(limit)


def fold(rows: DataFrame, projection: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds folded and how: exact, area or none; projection: old_topic, new_topic."""
    p = projection.dropDuplicates(["old_topic"])
    exact = p.select(F.col("old_topic").alias(topic), F.col("new_topic").alias("_exact"))
    area = p.filter(F.instr("old_topic", "/") == 0).select(F.col("old_topic").alias("_area"), area_of("new_topic").alias("_top"))
    j = rows.join(exact, topic, "left").withColumn("_area", area_of(topic)).join(area, "_area", "left")
    under = F.concat_ws("/", "_top", F.nullif(sub_of(topic), F.lit("")))
    folded = F.coalesce("_exact", F.when(F.col("_top").isNotNull(), under), F.col(topic))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_top").isNotNull(), "area").otherwise("none")
    return j.withColumn("folded", folded).withColumn("how", how).drop("_exact", "_area", "_top")


def priorities(views: DataFrame, cached: DataFrame) -> DataFrame:
    """Ids that no cache holds, most watched first."""
    n = views.filter(F.coalesce("video_id", F.lit("")) != "").groupBy("video_id").agg(F.count("*").alias("views"))
    return n.join(cached.select("video_id"), "video_id", "left_anti")


def strided_sample(ids: DataFrame, n: int, key: str = "video_id") -> DataFrame:
    """n ids at equal steps of the sorted ids, or all if they are fewer: places floor(i * count / n).

    Places come from counts of range partitions, so no task sorts all ids. The
    partitions are written once: they are drawn from a sample, and a second
    evaluation would cut them elsewhere.
    """
    spark, distinct = ids.sparkSession, ids.select(key).distinct()
    ranged = distinct.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(key)
    own, folder = ranged.withColumn("_n", F.row_number().over(w) - 1), scratch(spark, "strides")
    own.write.parquet(folder)
    placed = spark.read.schema(own.schema).parquet(folder)
    counts = {r[0]: r[1] for r in placed.groupBy("_p").count().collect()}  # a row a partition
    total, base, bases = sum(counts.values()), 0, []
    for p in sorted(counts):
        bases.append((p, base))
        base += counts[p]
    wanted = sorted({int(i * total / n) for i in range(n)}) if total else []
    b = F.broadcast(spark.createDataFrame(bases, "_p int, _base long"))
    w = F.broadcast(spark.createDataFrame([(x,) for x in wanted], "_place long"))
    return placed.join(b, "_p").withColumn("_place", F.col("_base") + F.col("_n")).join(w, "_place", "left_semi").select(key)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: videos both judged, and on how many topic, area and mode agree."""
    j = a.select("video_id", F.col("topic").alias("x"), F.col("mode").alias("xm")).join(b.select("video_id", F.col("topic").alias("y"), F.col("mode").alias("ym")), "video_id")
    return j.agg(F.count("*").alias("both"), F.count_if(F.col("x") == F.col("y")).alias("topic"), F.count_if(area_of("x") == area_of("y")).alias("area"), F.count_if(F.col("xm").eqNullSafe(F.col("ym"))).alias("mode"))


def verdict(wins: Column, losses: Column, undecided: Column) -> Column:
    """none below the quorum, close inside the noise, else a or b."""
    decided, margin = wins + losses, F.abs(wins - losses)
    return F.when(decided * 2 < decided + undecided, "none").when(margin < 2 * F.sqrt(decided), "close").when(wins > losses, "a").otherwise("b")
