"""Queries over sources, sinks and reply parsers: written in the shared folder, read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import replies, text as t
from ..sources import config, connectors, export, files
from ..sources.events import table, views
from ..sources.scratch import scratch
from ..sources.snapshots import KeyedLog
from .catalog import register
from .oracle import VIEWS, sql

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def entries(spark, d) -> DataFrame:
    """Events in the layout of an export's entries: some ads, music, without address or with a broken time."""
    e = table(spark, d, "events").select("*", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, vid = F.col("k"), F.format_string("v%05d_%04d", F.col("user_id") % 100000, F.col("k"))
    host = F.when(k % 7 == 3, "https://music.youtube.com/watch?v=").otherwise("https://www.youtube.com/watch?v=")
    time = F.when(k % 19 == 2, "soon").otherwise(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select(
        "event_id", F.lit("YouTube").alias("header"), F.concat(F.lit("Watched "), "event_type", F.lit(" "), "event_id").alias("title"), F.when(k % 13 != 5, F.concat(host, vid)).alias("titleUrl"),
        F.when(k % 11 != 0, F.array(F.struct(F.concat(F.lit("channel-"), "user_id").alias("name"), F.concat(F.lit("https://www.youtube.com/channel/UC"), "user_id").alias("url")))).alias("subtitles"),
        F.when(k % 17 == 4, F.array(F.struct(F.lit("From Google Ads").alias("name")))).alias("details"), time.alias("time"), F.when(k % 9 == 1, F.array(F.lit("YouTube Music"))).otherwise(F.array(F.lit("YouTube"))).alias("products"),
    )


def exported(spark, d) -> DataFrame:
    """The same after a trip through JSON arrays, a file for each of 16 shares."""
    folder = scratch(spark, "export")
    rows = entries(spark, d).select(F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("share"), F.to_json(F.struct("header", "title", "titleUrl", "subtitles", "details", "time", "products")).alias("row"))
    files = rows.groupBy("share").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
    files.select("share", "value").write.partitionBy("share").text(folder)
    return export.read_export(spark, folder)


RAW = f"""
raw AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, {K} AS k, printf('v%05d_%04d', user_id % 100000, {K}) AS vid FROM events),
entries AS (SELECT *, k % 17 = 4 AS ad, k % 13 = 5 AS no_url, (k % 9 = 1 OR (k % 7 = 3 AND k % 13 <> 5)) AS music, k % 19 = 2 AS bad_time FROM raw)
"""


@register("s1_export_views", sql(RAW, "SELECT CASE WHEN no_url THEN '' ELSE vid END AS video_id, event_type || ' ' || event_id AS title, CASE WHEN k % 11 <> 0 THEN 'channel-' || user_id END AS channel, CASE WHEN k % 11 <> 0 THEN 'https://www.youtube.com/channel/UC' || user_id END AS channel_url, CASE WHEN NOT bad_time THEN us END AS us, music FROM entries WHERE NOT ad"))
def s1_export_views(spark, d) -> DataFrame:
    """Also F1, P5 and P6: ads go, music is marked, times that can't be read are null."""
    return export.views_of(exported(spark, d)).withColumn("us", F.unix_micros("watched_at")).drop("watched_at")


@register("p5_is_ad", sql(RAW, "SELECT event_id, ad FROM entries"))
def p5_is_ad(spark, d) -> DataFrame:
    return entries(spark, d).select("event_id", t.is_ad("details").alias("ad"))


@register("p6_is_music", sql(RAW, "SELECT event_id, music FROM entries"))
def p6_is_music(spark, d) -> DataFrame:
    return entries(spark, d).select("event_id", t.is_music("products", "titleUrl").alias("music"))


@register("f1_without_ads", sql(RAW, "SELECT event_id FROM entries WHERE NOT ad"))
def f1_without_ads(spark, d) -> DataFrame:
    return entries(spark, d).filter(~t.is_ad("details")).select("event_id")


@register("a1_statistics", sql(RAW, "SELECT count(*) AS total, count(*) FILTER (WHERE ad) AS ads, count(*) FILTER (WHERE NOT ad) AS views, count(*) FILTER (WHERE NOT ad AND no_url) AS no_url, count(*) FILTER (WHERE NOT ad AND music) AS music, count(*) FILTER (WHERE NOT ad AND bad_time) AS bad_time FROM entries"))
def a1_statistics(spark, d) -> DataFrame:
    return export.parse_statistics(exported(spark, d))


PLACES = """
files AS (
  SELECT concat(CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'first/' WHEN 2 THEN 'second/a/' WHEN 3 THEN 'cache/' ELSE 'third/a/b/c/d/' END, CASE p_size % 4 WHEN 0 THEN 'watch-history.json' WHEN 1 THEN 'Wiedergabeverlauf.JSON' WHEN 2 THEN 'abos.csv' ELSE 'notes.txt' END) AS path,
    CAST(p_partkey * 7919 % 1000 AS BIGINT) AS s FROM part),
found AS (SELECT path, s, CASE WHEN lower(split_part(path, '/', -1)) IN ('watch-history.json', 'wiedergabeverlauf.json') THEN 'history' ELSE 'subscriptions' END AS kind, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS export
  FROM files WHERE NOT path LIKE '%notes.txt' AND NOT path LIKE 'cache/%' AND NOT path LIKE 'third/%')
"""


def listing(spark, d) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size") % 4
    folder = F.when(p % 5 == 0, "").when(p % 5 == 1, "first/").when(p % 5 == 2, "second/a/").when(p % 5 == 3, "cache/").otherwise("third/a/b/c/d/")
    name = F.when(size == 0, "watch-history.json").when(size == 1, "Wiedergabeverlauf.JSON").when(size == 2, "abos.csv").otherwise("notes.txt")
    return table(spark, d, "part").select(F.concat(folder, name).alias("path"), F.timestamp_seconds(p * 7919 % 1000).alias("modified"))


@register("s2_candidates", sql(PLACES, "SELECT path, s, kind, export FROM found"))
def s2_candidates(spark, d) -> DataFrame:
    return export.candidates(listing(spark, d)).select("path", F.unix_seconds("modified").alias("s"), "kind", "export")


@register("s3_chosen", sql(PLACES, """, h AS (SELECT path, export FROM found WHERE kind = 'history' ORDER BY s DESC, path LIMIT 1), n AS (SELECT count(DISTINCT export) AS exports FROM found WHERE kind = 'history')
SELECT h.path AS history, (SELECT f.path FROM found f WHERE f.kind = 'subscriptions' AND (n.exports <= 1 OR f.export = h.export) ORDER BY s DESC, f.path LIMIT 1) AS subscriptions, n.exports FROM h, n"""))
def s3_chosen(spark, d) -> DataFrame:
    """Also S4 and A37: the newest, of one export where there are several."""
    return export.chosen(listing(spark, d))


@register("s5_subscriptions", "SELECT 'UC' || c_custkey AS channel_id, CASE WHEN c_custkey % 6 <> 1 THEN 'http://c/' || c_custkey END AS channel_url, CASE WHEN c_custkey % 6 > 1 THEN c_name END AS title FROM customer WHERE c_custkey % 5 <> 0")
def s5_subscriptions(spark, d) -> DataFrame:
    """Ragged rows: some end after the id, some after the address; rows without an id go."""
    return subscriptions(spark, d, "Kanal-ID,Kanal-URL,Kanaltitel", lambda own, url, title: (own, url, title))


@register("s5_wide_subscriptions", "SELECT 'UC' || c_custkey AS channel_id, CASE WHEN c_custkey % 6 <> 1 THEN 'http://c/' || c_custkey END AS channel_url, c_name AS title FROM customer WHERE c_custkey % 5 <> 0")
def s5_wide_subscriptions(spark, d) -> DataFrame:
    """Eight columns, the id in the seventh and the title before it; a row that ends there has no address."""
    x = F.lit("x")
    return subscriptions(spark, d, "a,b,c,d,e,Titel,Kanal-ID,url", lambda own, url, title: (x, x, x, x, x, title, own, url), wide=True)


def subscriptions(spark, d, head: str, layout, wide: bool = False) -> DataFrame:
    folder, k = scratch(spark, "subscriptions"), F.col("c_custkey")
    own = F.when(k % 5 != 0, F.concat(F.lit("UC"), k)).otherwise(" ")
    cells = layout(own, F.concat(F.lit("http://c/"), k), F.col("c_name"))
    upto = lambda n: F.concat_ws(",", *cells[:n])
    line = F.when(k % 6 == 1, upto(len(cells) - 1)).otherwise(upto(len(cells))) if wide else F.when(k % 6 == 1, upto(1)).when(k % 6 == 0, upto(2)).otherwise(upto(3))
    top = spark.createDataFrame([(head,)], "value string")
    top.unionByName(table(spark, d, "customer").select(line.alias("value"))).coalesce(1).write.text(folder)  # one file, as an export has
    return export.read_subscriptions(spark, folder)


@register("s6_jsonl", sql(VIEWS, "SELECT event_id, video_id, topic, duration_s, mode FROM views"))
def s6_jsonl(spark, d) -> DataFrame:
    """Also K1: rows written as JSON lines and read strictly."""
    folder, rows = scratch(spark, "classified"), views(spark, d).select("event_id", "video_id", "topic", "duration_s", "mode")
    export.write_jsonl(rows, folder)
    return export.read_jsonl(spark, folder, rows.schema)


def keyed(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), (F.col("s_suppkey") % 100).cast("double").alias("duration"), (F.col("s_suppkey") % 4 == 0).alias("unavailable"))


def keyed_folder(spark, d) -> str:
    folder = scratch(spark, "keyed")
    export.write_keyed(keyed(spark, d), folder, "id").write.format("noop").mode("overwrite").save()
    return folder


@register("s7_keyed_files", "SELECT 's' || s_suppkey AS id, s_name AS title, CAST(s_suppkey % 100 AS DOUBLE) AS duration, s_suppkey % 4 = 0 AS unavailable FROM supplier")
def s7_keyed_files(spark, d) -> DataFrame:
    """Also K2: a file a key, written whole, read strictly."""
    return files.read_keyed(spark, keyed_folder(spark, d), META).select("id", "title", "duration", "unavailable")


META = "id STRING, title STRING, duration DOUBLE, unavailable BOOLEAN"


@register("s7_first_error", "SELECT min('s' || s_suppkey) AS first, count(*) AS bad FROM supplier WHERE s_suppkey % 4 = 3")
def s7_first_error(spark, d) -> DataFrame:
    """Of files that can't be decoded the error names the first by path, whichever task met which."""
    folder, rows, bad = scratch(spark, "keyed"), keyed(spark, d), F.substring("id", 2, 20).cast("long") % 4 == 3
    for part in (rows.filter(~bad), rows.filter(bad).withColumn("duration", F.lit("soon"))):
        export.write_keyed(part, folder, "id").write.format("noop").mode("overwrite").save()
    try:
        files.read_keyed(spark, folder, META)
        raise AssertionError("bad files were read")
    except ValueError as error:
        said = str(error)
    return spark.createDataFrame([(said.rsplit("/", 1)[1].removesuffix(".json"), int(said.split()[0]))], "first string, bad long")


@register("s9_some_keys", "SELECT 's' || s_suppkey AS id, CAST(s_suppkey % 100 AS DOUBLE) AS duration FROM supplier WHERE s_suppkey IN (3, 5, 8)")
def s9_some_keys(spark, d) -> DataFrame:
    """A filter on ids reaches the listing: three files are opened."""
    return files.read_keyed(spark, keyed_folder(spark, d), META, ["s3", "s5", "s8", "none"]).select("id", "duration")


@register("s9_keyed_ids", "SELECT 's' || s_suppkey AS id FROM supplier")
def s9_keyed_ids(spark, d) -> DataFrame:
    return export.keyed_ids(spark, keyed_folder(spark, d))


@register("s8_unseen_files", "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS scan FROM supplier")
def s8_unseen_files(spark, d) -> DataFrame:
    """Files that can't be decoded in the first scan are mended, and the second scan reads them alone."""
    folder, schema, late = scratch(spark, "keyed"), "id STRING, duration DOUBLE", F.substring("id", 2, 20).cast("long") % 3 == 0
    good = keyed(spark, d).select("id", "duration")
    put = lambda rows: export.write_keyed(rows, folder, "id").write.format("noop").mode("overwrite").save()
    put(good.filter(~late))
    put(good.filter(late).withColumn("duration", F.lit("soon")))
    held = scratch(spark, "scanned")
    export.read_unseen(spark, folder, schema, spark.createDataFrame([], "path string"))[0].write.parquet(held)
    first = spark.read.parquet(held)
    put(good.filter(late))
    second, _ = export.read_unseen(spark, folder, schema, first.select("path"))
    return first.select("id", F.lit(1).alias("scan")).unionByName(second.select("id", F.lit(2).alias("scan")))


UPSERTED = "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'again' ELSE s_name END AS title FROM supplier UNION ALL SELECT 'n' || s_suppkey, 'again' FROM supplier WHERE s_suppkey % 10 = 0"


def update(spark, d) -> tuple[DataFrame, DataFrame]:
    """(old rows, new rows): some keys are repeated in the update, some are new."""
    old, n = keyed(spark, d).select("id", "title", F.lit(0).alias("at")), F.substring("id", 2, 20).cast("long")
    new = old.filter(n % 3 == 0).select("id", F.explode(F.array(F.struct(F.lit("once").alias("title"), F.lit(1).alias("at")), F.struct(F.lit("again").alias("title"), F.lit(2).alias("at")))).alias("x")).select("id", "x.*")
    fresh = old.filter(n % 10 == 0).select(F.concat(F.lit("n"), n).alias("id"), F.lit("again").alias("title"), F.lit(1).alias("at"))
    return old, new.unionByName(fresh)


@register("k2_upsert", UPSERTED)
def k2_upsert(spark, d) -> DataFrame:
    """A repeated key of the update counts once, by its last row."""
    return export.upsert(*update(spark, d), "id", "at").select("id", "title")


def keyed_log(spark, d) -> KeyedLog:
    """The same update of a keyed log: a commit of old rows, one of their bases, one of new rows."""
    old, new = update(spark, d)
    held = KeyedLog(spark, scratch(spark, "keyed-log"), "id", old.schema, buckets=16)
    held.update(old)
    held.compact()
    held.update(new, "at")
    return held


@register("k2_keyed_log", UPSERTED)
def k2_keyed_log(spark, d) -> DataFrame:
    """The table is not rewritten: bases and logs are merged as they are read."""
    return keyed_log(spark, d).read().select("id", "title")


@register("k2_keyed_versions", """WITH v AS (SELECT c, s_suppkey, s_suppkey % 3 = 0 AND c >= 3 AS again FROM supplier, range(1, 5) r(c))
SELECT CAST(c AS INTEGER) AS version, count(*) + CASE WHEN c >= 3 THEN (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) ELSE 0 END AS keys, count(*) FILTER (WHERE again) + CASE WHEN c >= 3 THEN (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) ELSE 0 END AS again FROM v GROUP BY c""")
def k2_keyed_versions(spark, d) -> DataFrame:
    """The table after each commit, the last one a compaction of all buckets."""
    held = keyed_log(spark, d)
    held.compact(0.0)
    each = [held.read(n).agg(F.lit(n).alias("version"), F.count("*").alias("keys"), F.count_if(F.col("title") == "again").alias("again")) for n in range(1, 5)]
    return reduce(DataFrame.unionByName, each)


@register("p38_provenance", "SELECT 'sha256:' || substr(sha256(string_agg(n_name, ',' ORDER BY n_name) || chr(10)), 1, 12) AS digest, true AS named, true AS stamped FROM nation")
def p38_provenance(spark, d) -> DataFrame:
    """The line that tells which file an output was made with."""
    folder = scratch(spark, "taxonomy")
    table(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("value")).write.text(folder)
    parts = F.split("line", " ")
    line = export.provenance(spark, folder).select("path", parts[0].alias("digest"), parts[1].alias("at"), parts[2].alias("stamp"))
    return line.select("digest", (F.col("at") == F.col("path")).alias("named"), F.col("stamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))


def fetched(ids: list[str]) -> list[dict]:
    """A stand-in for a service: what it knows of an id follows from the id."""
    return [{"id": i, "title": f"title of {i}", "duration": len(i) + 0.9, "unavailable": i.endswith("3"), "gone_reason": "removed" if i.endswith("3") else None} for i in ids]


@register("s10_fetch", sql(VIEWS, "SELECT DISTINCT video_id AS id, 'title of ' || video_id AS title, CAST(length(video_id) AS INTEGER) AS duration_s, video_id LIKE '%3' AS unavailable, CASE WHEN video_id LIKE '%3' THEN 'removed' END AS gone_reason FROM views"))
def s10_fetch(spark, d) -> DataFrame:
    return connectors.fetch_metadata(views(spark, d).select("video_id").distinct(), fetched)


def vectors(texts: list[str]) -> list[dict]:
    """Answers come in any order, each with its place."""
    return [{"index": k, "embedding": [float(len(x)), float(len(x.split()))]} for k, x in reversed(list(enumerate(texts)))]


@register("s12_embed", "SELECT p_partkey AS key, CAST(length(p_name) AS BIGINT) AS chars, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words FROM part")
def s12_embed(spark, d) -> DataFrame:
    """Also S11: vectors are brought into the order asked, each place once."""
    texts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("text"))
    return connectors.embed(texts, vectors).select(F.col("key").cast("long").alias("key"), F.col("vec")[0].cast("long").alias("chars"), F.col("vec")[1].cast("long").alias("words"))


def echo(system: str, user: str, most: int) -> str:
    return f"{system}: {user}"[:most]


@register("s11_chat", "SELECT p_partkey AS key, substr('name: ' || p_name, 1, 20) AS reply FROM part")
def s11_chat(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.lit("name").alias("system"), F.col("p_name").alias("user"))
    return connectors.chat(p, echo, 20).select(F.col("key").cast("long").alias("key"), "reply")


RULES = {
    "topics": [{"id": "dev", "description": "programs"}, {"id": "gaming"}, {"id": "unclear"}],
    "sub_aliases": {"rustlang": "rust"},
    "rules": [{"id": "r1", "topic": "DEV/RustLang", "mode": "learn", "title_any": ["rust"]}, {"id": "r2", "topic": "gaming", "tag_any": ["game", "play"]}],
}


@register("s13_rules", "SELECT * FROM (VALUES ('r1', 'dev/rust', 'learn', 1), ('r2', 'gaming', '', 2)) v(id, topic, mode, matchers)")
def s13_rules(spark, d) -> DataFrame:
    """Also S15: a rules file, checked; a missing control file wishes nothing."""
    if config.load_control("/nowhere/control.yaml")["stop"]:
        raise ValueError("a missing file has wishes")
    rules = config.parse(RULES).rules
    return spark.createDataFrame([(r.id, r.topic, r.mode, len(r.title_any) + len(r.tag_any)) for r in rules], "id string, topic string, mode string, matchers int")


@register("k4_projection_file", sql(VIEWS, "SELECT DISTINCT topic AS old_topic, CASE WHEN sub IS NULL THEN area ELSE 'top: ' || area || '/#' || sub END AS new_topic FROM views"))
def k4_projection_file(spark, d) -> DataFrame:
    """Topics with marks that YAML reads as its own survive the file."""
    import tempfile
    from pathlib import Path

    new = F.when(F.col("sub").isNull(), F.col("area")).otherwise(F.concat(F.lit("top: "), "area", F.lit("/#"), "sub"))
    rows = views(spark, d).groupBy(F.col("topic").alias("old"), new.alias("new")).agg(F.count("*").alias("n")).collect()  # a row a topic
    with tempfile.TemporaryDirectory() as own:  # a file of the driver alone
        path = str(Path(own) / "map.yaml")
        config.write_projection([(r["old"], r["new"], r["n"]) for r in rows], path, ["made by a query"])
        return spark.createDataFrame(config.load_projection(path), "old_topic string, new_topic string")


@register("k6_run_log", "SELECT n_nationkey AS n, 'wave' AS event FROM nation")
def k6_run_log(spark, d) -> DataFrame:
    import json
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as own:  # a run's log is the driver's
        path = str(Path(own) / "run.jsonl")
        for row in table(spark, d, "nation").select("n_nationkey").collect():
            export.append_log(path, event="wave", n=row[0])
        lines = [json.loads(x) for x in Path(path).read_text().splitlines()]
    return spark.createDataFrame([(x["n"], x["event"]) for x in lines], "n int, event string")


# --- replies ------------------------------------------------------------

AREAS = replies.Areas(("dev", "gaming", "unclear", "education"))
#: For each of eight layouts: the line after its number, and topic, mode and percent that it means.
LAYOUTS = [
    (". dev/talks learn 0.9", "dev/talks", "learn", 90), (") gaming factorio consume 0.8", "gaming/factorio", "consume", 80), (" dev/talks 0.7", "dev/talks", "", 70), (": gaming/factorio-consume 0.6", "gaming/factorio", "consume", 60),
    (" education dev 0.5", "education/dev", "", 50), (" unclear mixed 0.4", "unclear", "mixed", 40), (" DEV/Some-Thing mixed 0.3", "dev/some-thing", "mixed", 30), (" gaming/other learn 1", "gaming", "learn", 100),
]


def _case(column, values: list):
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def _case_sql(column: str, values: list) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in enumerate(values)) + " END"


def batches(spark, d, line, spoil: bool = True) -> DataFrame:
    """A batch an order, a line an item in falling order between prose; some lack a line, repeat one or number too far."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("n", F.row_number().over(_numbered()))
    each = x.withColumn("line", F.concat(F.col("n").cast("string"), line(F.pmod(F.col("l_orderkey") * 3 + F.col("n"), F.lit(8)))))
    b = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "n", "line"))).alias("x"))
    b = b.select(F.col("l_orderkey").cast("long").alias("batch_id"), F.transform("x", lambda e: e["line"]).alias("lines"), F.transform(F.sequence(F.lit(1), F.size("x")), lambda n: F.concat_ws("-", "l_orderkey", n)).alias("ids"))
    kind, far = F.col("batch_id") % 11, F.concat((F.size("ids") + 1).cast("string"), line(F.lit(0)))
    held = F.col("lines")
    if spoil:
        held = F.when(kind == 0, F.concat(held, F.slice(held, 1, 1))).when(kind == 2, F.slice(held, F.lit(2), F.size(held))).when(kind == 4, F.concat(held, F.array(far))).otherwise(held)
    return b.select("batch_id", "ids", F.concat(F.lit("Here it is:\n"), F.array_join(held, "\n"), F.lit("\nDone.")).alias("reply"))


def _numbered():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber")


ITEMS = """
li AS (SELECT l_orderkey AS batch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem),
x AS (SELECT batch_id, n, (batch_id * 3 + n) % 8 AS layout, batch_id % 11 IN (0, 2, 4) AS refused, batch_id || '-' || n AS id FROM li)
"""


def _answer(df: DataFrame, *columns: str) -> DataFrame:
    percent = [F.round(F.col("confidence") * 100).cast("int").alias("percent")] if "confidence" in df.columns else []
    return df.select("batch_id", "id", *columns, *percent, F.col("error").isNotNull().alias("refused"))


@register("p27_verdict_replies", sql(ITEMS, f"SELECT batch_id, id, CASE WHEN NOT refused THEN {_case_sql('layout', [x[1] for x in LAYOUTS])} END AS topic, CASE WHEN NOT refused THEN {_case_sql('layout', [x[2] for x in LAYOUTS])} END AS mode, CASE WHEN NOT refused THEN {_case_sql('layout', [x[3] for x in LAYOUTS])} END AS percent, refused FROM x"))
def p27_verdict_replies(spark, d) -> DataFrame:
    """Also P28: lines of other layouts are mended where only one reading fits; a reply is whole or refused."""
    got = replies.parse_replies(batches(spark, d, lambda k: _case(k, [x[0] for x in LAYOUTS])), AREAS)
    return got.select(F.regexp_extract("id", "^[0-9]+", 0).cast("long").alias("batch_id"), "id", "topic", "mode", F.round(F.col("confidence") * 100).cast("int").alias("percent"), F.col("error").isNotNull().alias("refused"))


MODE_LINES = [(". learn", "learn"), (") consume", "consume"), (" mixed", "mixed"), (": unclear", "")] * 2


@register("p29_mode_replies", sql(ITEMS, f"SELECT batch_id, id, CASE WHEN NOT refused THEN {_case_sql('layout', [x[1] for x in MODE_LINES])} END AS mode, refused FROM x"))
def p29_mode_replies(spark, d) -> DataFrame:
    return _answer(replies.parse_kind(batches(spark, d, lambda k: _case(k, [x[0] for x in MODE_LINES])), "modes"), "mode")


SUB_LINES = [(". rust 0.9", "rust", 90), (") Other 0.2", "", 20), (" Deep-Dives! 0.5", "deep-dives", 50), (": jazz 1", "jazz", 100)] * 2


@register("p29_sub_replies", sql(ITEMS, f"SELECT batch_id, id, CASE WHEN NOT refused THEN {_case_sql('layout', [x[1] for x in SUB_LINES])} END AS sub, CASE WHEN NOT refused THEN {_case_sql('layout', [x[2] for x in SUB_LINES])} END AS percent, refused FROM x"))
def p29_sub_replies(spark, d) -> DataFrame:
    return _answer(replies.parse_kind(batches(spark, d, lambda k: _case(k, [x[0] for x in SUB_LINES])), "subjects"), "sub")


NAME_LINES = [(". jazz", "jazz"), (") Chess!", "Chess!"), (" rock-music", "rock-music"), (": Go", "Go")] * 2


@register("p31_name_replies", sql(ITEMS, f"SELECT batch_id, id, CASE WHEN NOT refused THEN {_case_sql('layout', [x[1] for x in NAME_LINES])} END AS name, refused FROM x"))
def p31_name_replies(spark, d) -> DataFrame:
    return _answer(replies.parse_kind(batches(spark, d, lambda k: _case(k, [x[0] for x in NAME_LINES])), "names"), "name")


@register("p32_picks", sql(ITEMS, "SELECT batch_id, id, layout % 3 AS pick FROM x"))
def p32_picks(spark, d) -> DataFrame:
    """A referee's picks by number, whatever their order."""
    got = replies.parse_kind(batches(spark, d, lambda k: _case(k, [f" {i % 3}" for i in range(8)]), spoil=False), "picks")
    return got.select("batch_id", "id", F.col("pick").cast("long").alias("pick"))


@register("p30_json_verdict", "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'dev/x' WHEN 1 THEN 'gaming' END AS topic, CASE l_linenumber % 4 WHEN 0 THEN 'learn' WHEN 1 THEN '' END AS mode, CASE l_linenumber % 4 WHEN 0 THEN 50 WHEN 1 THEN 100 END AS percent FROM lineitem")
def p30_json_verdict(spark, d) -> DataFrame:
    n = F.col("l_linenumber")
    reply = F.when(n % 4 == 0, 'so: {"topic": "DEV/x", "mode": "learn", "confidence": 0.5}.').when(n % 4 == 1, '```json\n{"topic": "gaming", "mode": "", "confidence": 1}\n``` and {"topic": "dev"}').when(n % 4 == 2, '{"topic": "nowhere", "mode": "learn", "confidence": 0.5}').otherwise("none {")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).cast("long").alias("id"), reply.alias("reply"))
    return replies.parse_json(rows, AREAS).select("id", "topic", "mode", F.round(F.col("confidence") * 100).cast("int").alias("percent"))
