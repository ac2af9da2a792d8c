"""Text summaries of small aggregates, a row a line; and prompts for a model.

Lines are (section, place, text). What they say is computed by the aggregates of
the report and of the inspection; here it is only worded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inspect as ins
from . import report as rep

TOPICS, SUBJECTS, BAR = 12, 6, 24
#: Fixed order of what became of a video: what nothing undoes, what a login could, what nobody asked.
FATES = ("private", "removed", "terminated", "unavailable", "age", "members", "unknown")
LOCKED = ("age", "members")


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100, whole)), F.lit(0)).cast("long")


def _lines(df: DataFrame, section: str, place: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), place.cast("long").alias("place"), text.alias("text"))


def _hours(seconds: str) -> Column:
    return F.format_string("%.1f", F.coalesce(F.col(seconds), F.lit(0)) / 3600.0)


def report_lines(views: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Headline, sources, fates, areas with their subjects, modes and subscriptions."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("-"))
    head = rep.headline(views)
    first = _lines(head, "headline", F.lit(1), F.format_string("%d views of %d videos, at most %s h, from %s to %s", "views", "videos", _hours("duration_s"), day("from_at"), day("to_at")))
    kinds = ("rule", "llm", "category", "unclassified")
    by = views.agg(*(F.count_if(rep.source_bucket("source") == k).alias(k) for k in kinds))
    sources = _lines(by, "sources", F.lit(1), F.format_string("judged by rules %d, by a model %d, by category alone %d, open %d", *kinds))

    total = head.select("views", "unavailable")
    each = rep.gone_reasons(views).withColumn("order", F.array_position(F.array(*map(F.lit, FATES)), F.col("reason"))).filter("order > 0")
    told = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "reason", "views"))), lambda x: F.concat_ws(" ", x["reason"], x["views"].cast("string"))).alias("fates"), F.sum(F.when(F.col("reason").isin(*LOCKED), F.col("views"))).alias("locked"))
    gone = total.crossJoin(told).filter("unavailable > 0")  # a row each
    fates = _lines(gone, "gone", F.lit(1), F.format_string("gone: %d views, %d %%: %s", "unavailable", _percent(F.col("unavailable"), F.col("views")), F.array_join("fates", ", ")))
    locked = _lines(gone.filter("locked > 0"), "gone", F.lit(2), F.format_string("locked, not deleted: %d", "locked"))

    tree = rep.topic_rollup(views)
    order = [F.col("views").desc(), "area"]
    areas = tree.filter(F.col("sub").isNull()).withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("most", F.max("views").over(Window.orderBy(*order)))  # areas are few
    bar = F.expr(f"repeat('#', cast(1 + views * {BAR} div most as int))")
    shown = _lines(areas.filter(F.col("place") <= TOPICS), "topics", F.col("place") * 2 - 1, F.format_string("%s (%s): %d views, at most %s h %s", "area", "mode", "views", _hours("duration_s"), bar))
    more = _lines(areas.agg((F.count("*") - TOPICS).alias("n")).filter("n > 0"), "topics", F.lit(2 * TOPICS + 1), F.format_string("and %d more", "n"))
    subs = tree.filter(F.col("sub").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy(F.col("views").desc(), "sub")))
    few = subs.groupBy("area").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= SUBJECTS, F.struct("k", "sub", "views")))).alias("x"), F.count_if(F.col("k") > SUBJECTS).alias("rest"))
    words = F.array_join(F.transform("x", lambda e: F.concat_ws(" ", e["sub"], e["views"].cast("string"))), ", ")
    under = few.join(areas.filter(F.col("place") <= TOPICS).select("area", "place"), "area")
    subjects = _lines(under, "topics", F.col("place") * 2, F.concat(F.lit("  "), words, F.when(F.col("rest") > 0, F.format_string(", +%d more", "rest")).otherwise("")))

    mode, dated = rep.mode_or_unclear(), views.filter(F.col("watched_at").isNotNull())
    split = dated.agg(*(F.count_if(mode == m).alias(m) for m in rep.MODES)).crossJoin(head.select("views"))  # a row each
    parts = F.array_compact(F.array(*(F.when(F.col(m) > 0, F.format_string(f"{m} %d %%", _percent(F.col(m), F.col("views")))) for m in rep.MODES)))
    modes = _lines(split, "modes", F.lit(1), F.concat(F.lit("modes: "), F.array_join(parts, ", ")))

    own = rep.subscription_rows(views, subscriptions).agg(F.count("*").alias("n"), F.count_if("dead").alias("dead"), F.sum("views").alias("own"), F.sum("duration_s").alias("own_s")).crossJoin(head.select("views", "duration_s"))  # a row each
    follows = _lines(own.filter("n > 0"), "subscriptions", F.lit(1), F.format_string("%d subscriptions, %d never watched; %d %% of views, %d %% of hours", "n", "dead", _percent(F.col("own"), F.col("views")), _percent(F.col("own_s"), F.col("duration_s"))))
    out = first
    for part in (sources, fates, locked, shown, more, subjects, modes, follows):
        out = out.unionByName(part)
    return out


def inspection_lines(videos: DataFrame) -> DataFrame:
    """Coverage, categories, what channels could lend, and whether tags name subjects."""
    c = ins.coverage(videos)
    first = _lines(c, "coverage", F.lit(1), F.format_string("%d views of %d videos; metadata: %d fetched, %d gone, %d not fetched", "views", "videos", "enriched", "tombstoned", "unfetched"))
    second = _lines(c, "coverage", F.lit(2), F.format_string("categories: %d %% of fetched videos; tags: %d %%, median %d; several categories: %d", _percent(F.col("with_category"), F.col("enriched")), _percent(F.col("with_tags"), F.col("enriched")), "median_tags", "multi_category"))
    order = [F.col("views").desc(), "category"]
    names = ins.categories(videos).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # categories are few
    kinds = _lines(names, "categories", F.col("place"), F.format_string("%s: %d views, %d videos", F.when(F.col("category") == "", "(none)").otherwise(F.col("category")), "views", "videos"))
    f = ins.donor_funnel(videos)
    funnel = _lines(f, "donors", F.lit(1), F.format_string("%d videos (%d views) lack a category; %d (%d) name a channel; of %d (%d) the channel has one elsewhere", "no_category", "no_category_views", "with_channel", "with_channel_views", "donor_found", "donor_views"))
    places = F.array(*(F.lit(name) for name, _ in ins.BUCKETS))
    buckets = _lines(ins.donors(videos), "donors", F.array_position(places, F.col("bucket")) + 1, F.format_string("majority %s: %d videos, %d views; with enough videos: %d, %d", "bucket", "videos", "views", "videos_over", "views_over"))
    spread = _lines(ins.tag_spread(videos), "tags", F.lit(1), F.format_string("%d tags: %d on one channel, %d on several", "tags", "brands", "subjects"))
    out = first
    for part in (second, kinds, funnel, buckets, spread):
        out = out.unionByName(part)
    return out


# --- prompts ------------------------------------------------------------

#: What a reply's line holds, by the kind of question.
ASKED = {
    "verdict": "its number, area/subject, mode (consume, learn, mixed or unclear) and a confidence from 0 to 1",
    "mode": "its number and a mode: consume, learn, mixed or unclear",
    "sub": "its number, one short subject within the area, or other, and a confidence from 0 to 1",
    "name": "its number and one short name, words joined by dashes",
    "hole": "its number and a title of at most six words",
}


def item_text(title: Column, channel: Column, tags: Column, area: Column | None = None) -> Column:
    """What a model is told of one video: title, channel, the first 8 tags, and the area that is fixed."""
    none = F.array().cast("array<string>")
    few = F.array_join(F.slice(F.coalesce(tags, none), 1, 8), ", ")
    parts = [F.coalesce(title, F.lit("")), F.concat(F.lit("channel: "), F.nullif(channel, F.lit(""))), F.concat(F.lit("tags: "), F.nullif(few, F.lit("")))]
    return F.concat_ws(" | ", *parts, *([] if area is None else [F.concat(F.lit("area: "), area)]))


def system_prompt(kind: str, areas: dict[str, str] | None = None, seeds: dict[str, list[str]] | None = None) -> str:
    """The instruction of a kind of question, with the areas and subjects that may be used again."""
    lines = [f"Answer with one line for each numbered item: {ASKED[kind]}. Nothing else."]
    for name, about in (areas or {}).items():
        known = ", ".join((seeds or {}).get(name, []))
        lines.append(f"- {name}" + (f": {about}" if about else "") + (f" (subjects so far: {known})" if known else ""))
    return "\n".join(lines)


def system_prompts(areas: list[str], seeds: DataFrame) -> DataFrame:
    """(kind, prompt): the instruction of every kind, with the areas and their seeds (area, sub, rank) by rank."""
    spark = seeds.sparkSession
    named = spark.createDataFrame([(k, a) for k, a in enumerate(areas)], "place int, area string")  # of the config
    known = seeds.groupBy("area").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sub"))), lambda x: x["sub"]), ", ").alias("known"))
    line = F.concat(F.lit("- "), "area", F.coalesce(F.concat(F.lit(" (subjects so far: "), "known", F.lit(")")), F.lit("")))
    lines = named.join(known, "area", "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))  # a row
    kinds = spark.createDataFrame([(kind, system_prompt(kind)) for kind in ASKED], "kind string, head string")
    return kinds.crossJoin(F.broadcast(lines)).select("kind", F.concat_ws("\n", "head", F.nullif("lines", F.lit(""))).alias("prompt"))


def batched_prompts(items: DataFrame, size: int, order: str = "video_id", keys: list[str] | None = None) -> DataFrame:
    """batch, ids, user: numbered item texts, so many to a prompt and never of two groups of ``keys``.

    items have ``order`` and text. Batches are cut within ranges of a hash, so that
    no task numbers all items; the last batch of a range may be short.
    """
    keys = keys or []
    dealt = items.withColumn("_range", F.pmod(F.xxhash64(order), F.lit(64)))
    n = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    cut = dealt.withColumn("_batch", F.floor(n / size)).withColumn("_n", (n % size + 1).cast("int"))
    each = cut.groupBy(*keys, "_range", "_batch").agg(F.array_sort(F.collect_list(F.struct("_n", F.col(order).cast("string").alias("id"), "text"))).alias("x"))  # at most ``size`` items
    user = F.array_join(F.transform("x", lambda e: F.concat(e["_n"].cast("string"), F.lit(". "), e["text"])), "\n")
    return each.select(*keys, F.concat_ws("-", "_range", "_batch").alias("batch"), F.transform("x", lambda e: e["id"]).alias("ids"), user.alias("user"))
