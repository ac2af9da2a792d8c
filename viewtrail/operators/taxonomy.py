"""Label collection, vectors, agglomerative clusters and the projection.

The vector algebra over the labels runs in one group, behind a check of its
memory: each merge of a linkage depends on all before it. What precedes it
(collecting labels) and follows it (folding topics) is distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNCLEAR, area_of, sub_of
from . import clusters as k

LEAST_VIDEOS, MOST_LABELS = 3, 20_000
#: Vector elements of one group of labels: 0.8 GB in double precision.
MOST_VALUES = 100_000_000


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for vectors of other lengths or without length."""
    size = lambda v: F.size(F.col(v) if isinstance(v, str) else v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(size(a) == size(b), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def normalised(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v.cast("array<double>"), lambda x: x / length)).otherwise(v.cast("array<double>"))


def mean_vector(df: DataFrame, vec: str, keys: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """The weighted mean of each group, one row of arrays a group; a group's vectors are of one length.

    Sums of whole vectors are kept in one buffer a group, and partial ones are
    shuffled: no element becomes a row of its own.
    """
    w = F.lit(1.0) if weight is None else F.greatest(weight.cast("double"), F.lit(1.0))
    each = df.select(*keys, w.alias("_w"), array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return each.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias("mean"))


def centred(df: DataFrame, vec: str) -> DataFrame:
    """Vectors less their mean, of unit length; of unequal lengths, or none, unchanged."""
    least, most = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    own = F.col(vec).cast("array<double>")
    if least is None or least != most:
        return df.withColumn(vec, own)
    mean = df.sparkSession.createDataFrame([mean_vector(df, vec).first()], "_mean array<double>")  # one row
    moved = normalised(F.zip_with(own, F.col("_mean"), lambda x, m: x - m))
    return df.crossJoin(F.broadcast(mean)).withColumn(vec, moved).drop("_mean")


def centroids(df: DataFrame, vec: str, keys: list[str], weight: Column | None = None) -> DataFrame:
    return mean_vector(df, vec, keys, weight).withColumn("mean", normalised(F.col("mean"))).withColumnRenamed("mean", "centroid")


def few(df: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """The same rows, held by the driver once their number is known to be bounded."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return df.sparkSession.createDataFrame(rows, df.schema)


@dataclass
class Centres:
    """Unit centroids in groups about pivots, for the nearest by cosine without comparing all.

    Angles between unit vectors obey the triangle inequality: a centroid of a
    group is no nearer than the pivot's angle less the group's radius. A row
    meets its nearest pivot's group first and then the groups that the bound
    doesn't exclude, each as one product of a block of rows with a block of
    centroids. Places are those of centroids in label order; the last of equal
    cosines to nine places wins.
    """

    units: np.ndarray
    places: np.ndarray
    pivots: np.ndarray
    groups: list[np.ndarray]
    radii: np.ndarray
    others: int | None

    #: Radians by which bounds are widened: cosines that are equal to nine places lie no further apart.
    MARGIN = 1e-4

    @classmethod
    def of(cls, vectors: list[np.ndarray], size: int) -> Centres:
        """vectors in label order; those of another size or of no length are as far from all as right angles."""
        fit = [v is not None and len(v) == size and np.dot(v, v) > 0 for v in vectors]
        places = np.flatnonzero(fit)
        units = np.array([vectors[i] / np.sqrt(np.dot(vectors[i], vectors[i])) for i in places], np.float64).reshape(len(places), size)
        others = max((i for i, f in enumerate(fit) if not f), default=None)
        pivots, far = [], np.full(len(units), np.inf)
        for _ in range(min(len(units), int(np.sqrt(len(units)) * 1.5) + 1)):  # each the furthest from those before
            pivots.append(int(far.argmax()) if pivots else 0)
            far = np.minimum(far, cls.angles(units, units[pivots[-1:]])[:, 0])
        to = cls.angles(units, units[pivots]) if pivots else np.zeros((0, 0))
        own = to.argmin(axis=1) if pivots else np.zeros(0, np.int64)
        groups = [np.flatnonzero(own == g) for g in range(len(pivots))]
        radii = np.array([to[m, g].max(initial=0) for g, m in enumerate(groups)])
        return cls(units, places, units[pivots] if pivots else units, groups, radii, others)

    @staticmethod
    def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(a @ b.T, -1.0, 1.0))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, int]:
        """(place of the nearest centroid of each unit row, vectors compared)."""
        start = -np.inf if self.others is None else 0.0
        best, at = np.full(len(rows), start), np.full(len(rows), -1 if self.others is None else self.others)
        if not len(self.units) or not len(rows):
            return at, 0
        pivot = self.angles(rows, self.pivots)
        first, compared = pivot.argmin(axis=1), pivot.size

        def meet(g: int, which: np.ndarray) -> int:
            members = self.groups[g]
            cosines = np.round(rows[which] @ self.units[members].T, 9)
            last = cosines.shape[1] - 1 - cosines[:, ::-1].argmax(axis=1)  # members stand in label order
            value, place = cosines[np.arange(len(which)), last], self.places[members[last]]
            better = (value > best[which]) | ((value == best[which]) & (place > at[which]))
            best[which[better]], at[which[better]] = value[better], place[better]
            return cosines.size

        for g in np.unique(first):
            compared += meet(g, np.flatnonzero(first == g))
        for g in range(len(self.groups)):
            open_ = (first != g) & (pivot[:, g] - self.radii[g] <= np.arccos(np.clip(best, -1.0, 1.0)) + self.MARGIN)
            if open_.any():
                compared += meet(g, np.flatnonzero(open_))
        return at, compared


def nearest(df: DataFrame, vec: str, centres: DataFrame, label: str) -> DataFrame:
    """Adds ``nearest``, the label of the closest centroid: chosen in each row, without a shuffle.

    centres: a table of ``few``, label and centroid. The greater label wins ties
    of nine places; a vector of another size than the first centroid's, or of no
    length, has the cosine 0.
    """
    rows = sorted(centres.select(label, "centroid").filter(F.col(label).isNotNull()).collect())  # at most MOST_LABELS
    names = pd.Series([r[0] for r in rows])
    vectors = [None if r[1] is None else np.array(r[1], np.float64) for r in rows]
    size = next((len(v) for v in vectors if v is not None), 0)
    held = Centres.of(vectors, size)
    kind = centres.schema[label].dataType

    @F.pandas_udf(kind)
    def closest(column: pd.Series) -> pd.Series:
        out = np.full(len(column), len(names) - 1)  # a row without a direction is as far from all
        own = [k for k, v in enumerate(column) if v is not None and len(v) == size]
        matrix = np.array([column.iloc[k] for k in own], np.float64).reshape(len(own), size)
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        fit = lengths > 0
        for at in range(0, int(fit.sum()), 1024):
            part = np.flatnonzero(fit)[at : at + 1024]
            out[np.array(own)[part]] = held.nearest(matrix[part] / lengths[part, None])[0]
        return pd.Series([names.iloc[k] if k >= 0 else None for k in out])

    return df.withColumn("nearest", closest(F.col(vec).cast("array<double>")))


def labels(views: DataFrame) -> DataFrame:
    """area, sub: views, distinct videos and channels; a title stands in for a missing id."""
    v = _named(views)
    return v.groupBy("area", "sub").agg(F.count("*").alias("views"), F.count_distinct(_video()).alias("videos"), F.count_distinct("channel").alias("channels"))


def _named(views: DataFrame) -> DataFrame:
    keep = [c for c in ("video_id", "title", "channel", "tags") if c in views.columns]
    v = views.select(area_of("topic").alias("area"), F.nullif(sub_of("topic"), F.lit("")).alias("sub"), *keep)
    return v.filter((F.col("area") != "") & (F.col("area") != UNCLEAR))


def _video():
    return F.coalesce(F.nullif("video_id", F.lit("")), F.concat(F.lit("t:"), F.coalesce("title", F.lit(""))))


def label_facts(views: DataFrame, channels: int = 3, tags: int = 8, titles: int = 2) -> DataFrame:
    """kind, area, sub, name, n, rank: a label's first channels and titles by views and tags by videos."""
    v = _named(views)
    by = lambda name, kind: v.filter(F.coalesce(name, F.lit("")) != "").groupBy("area", "sub", F.col(name).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    each = v.groupBy("area", "sub", _video().alias("v")).agg(F.first("tags", ignorenulls=True).alias("tags"))
    tagged = each.select("area", "sub", F.explode("tags").alias("name")).groupBy("area", "sub", "name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("tag"))
    every = by("channel", "channel").unionByName(tagged).unionByName(by("title", "title"))
    most = F.when(F.col("kind") == "channel", channels).when(F.col("kind") == "tag", tags).otherwise(titles)
    w = Window.partitionBy("kind", "area", "sub").orderBy(F.col("n").desc(), "name")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def top_channels(views: DataFrame, k: int = 3) -> DataFrame:
    n = views.groupBy("topic", "channel").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("n").desc(), "channel"))).filter(F.col("rank") <= k)


def embedded(views: DataFrame) -> DataFrame:
    """area, sub, text: what is embedded for each label."""
    facts = label_facts(views).groupBy("area", "sub", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    wide = facts.groupBy("area", "sub").pivot("kind", ["channel", "tag", "title"]).agg(F.first("names"))
    return wide.select("area", "sub", embed_text(F.col("area"), F.col("sub"), F.col("channel"), F.col("tag"), F.col("title")).alias("text"))


def embed_text(area: Column, sub: Column, channels: Column, tags: Column, titles: Column) -> Column:
    """The text that stands for a label: its words, then what it has of channels, tags and titles, a line each."""
    few = lambda head, a, n, by: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.concat(F.lit(head), F.array_join(F.slice(a, 1, n), by)))
    words = F.regexp_replace(F.concat_ws(" ", area, sub), "[-/]", " ")
    return F.concat_ws("\n", words, few("channels: ", channels, 3, ", "), few("tags: ", tags, 8, ", "), few("titles: ", titles, 2, " | "))


# --- one group of labels ------------------------------------------------


def _labels(pdf: pd.DataFrame) -> k.Labels:
    values = sum(len(v) for v in pdf["vec"])
    if values > MOST_VALUES:
        raise ValueError(f"{values} vector elements; one group holds {MOST_VALUES}")
    pdf = pdf.sort_values(["views", "area", "sub"], ascending=[False, True, True], na_position="first")
    subs = [s if isinstance(s, str) and s else None for s in pdf["sub"]]
    vectors = np.stack(pdf["vec"].to_list()).astype(np.float64)
    channels = [list(x) if x is not None else [] for x in pdf["channel_names"]] if "channel_names" in pdf else None
    return k.Labels(pdf["area"].to_list(), subs, pdf["views"].to_numpy(np.int64), pdf["videos"].to_numpy(np.int64), vectors, channels)


CLUSTERS = "area string, sub string, cluster long, parent_name string, cluster_name string, radius double, round_no int"


def _rows(labels: k.Labels, found: list[k.Cluster], round_no: int) -> pd.DataFrame:
    each = [(labels.areas[r], labels.subs[r], n, c.parent, c.name, round(c.radius, 9), round_no) for n, c in enumerate(found) for r in c.rows]
    return pd.DataFrame(each, columns=["area", "sub", "cluster", "parent_name", "cluster_name", "radius", "round_no"])


def clusters(table: DataFrame, fine: float = k.FINE, coarse: float = k.COARSE, least: int = k.LEAST_VIDEOS, least_top: int = k.LEAST_TOP_VIDEOS, control: k.Control | None = None, rounds: int = 1, most_radius: float = k.MOST_RADIUS) -> DataFrame:
    """area, sub, cluster, parent_name, cluster_name, radius, round_no of each label.

    table: area, sub, views, videos, vec (and channel_names). Labels go to
    clusters, clusters to parents, small ones into the nearest; further rounds
    refine. round_no: how many rounds were run. Labels are one group on one task,
    whose memory is checked; time grows with the square of their number.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = _labels(pdf)
        found, measured = k.rounds(labels, lambda: control or k.Control(), fine, coarse, least, least_top, most_radius, rounds)
        return _rows(labels, found, len(measured))

    return table.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(run, CLUSTERS)


def projection(found: DataFrame) -> DataFrame:
    """old_topic to new_topic; a cluster named as its parent is the bare parent."""
    old = F.concat_ws("/", "area", "sub")
    new = F.when(F.col("cluster_name") == F.col("parent_name"), F.col("parent_name")).otherwise(F.concat_ws("/", "parent_name", "cluster_name"))
    return found.select(old.alias("old_topic"), new.alias("new_topic"))


def metrics(assigned: DataFrame, tail: int = k.TAIL, radius: Column | None = None) -> DataFrame:
    """One row: names, tops, spread, subjects, tail share, subjects a channel, coherence.

    assigned: area, sub, channel, video_id and views' rows; ``radius`` is that of
    a row's subject, whose mean by views is the coherence.
    """
    names = assigned.filter("sub IS NOT NULL").groupBy("sub").agg(F.count_distinct("area").alias("tops"))
    spread = names.agg(F.count("*").alias("names"), F.count_if(F.col("tops") > 1).alias("spread"))
    subjects = assigned.groupBy("area", "sub").agg(F.count_distinct("video_id").alias("videos")).agg(F.count("*").alias("subjects"), F.count_distinct("area").alias("tops"), F.round(F.count_if(F.col("videos") <= tail) / F.count("*"), 6).alias("tail_share"))
    per = assigned.filter(F.coalesce("channel", F.lit("")) != "").groupBy("channel").agg(F.count_distinct("area", F.coalesce("sub", F.lit(""))).alias("n")).agg(F.max("n").alias("most_per_channel"), F.round(F.avg("n"), 6).alias("mean_per_channel"))
    coherence = assigned.agg(F.round(F.avg(F.lit(0.0) if radius is None else radius), 6).alias("coherence"))
    return spread.crossJoin(subjects).crossJoin(per).crossJoin(coherence)  # a row each
