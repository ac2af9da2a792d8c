"""Scalar functions over titles, addresses, topics, tags and replies.

All are column expressions that stay in generated code.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the export format.
TITLE_PREFIXES = ("Watched ", "Angesehen: ")
TITLE_SUFFIX = " angesehen"
AD_MARKERS = ("From Google Ads", "Von Google Anzeigen")
MUSIC_PRODUCT, MUSIC_HOST = "YouTube Music", "music.youtube.com"
CHANNEL_PREFIX = "https://www.youtube.com/channel/"
MODES = ("consume", "learn", "mixed")
UNCLEAR = "unclear"
SUB_CAP = 24
# Subjects that say nothing.
EMPTY_SUBS = ("other", "others", "misc", "miscellaneous", "general", "various", "unknown", "none", "unclear", "n-a")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    x = _c(x)
    return F.when(F.length(F.trim(x)) > 0, x)


def clean_title(title) -> Column:
    """Drops the first prefix that matches, or else the suffix."""
    t = _c(title)
    out = F.when(F.endswith(t, F.lit(TITLE_SUFFIX)), F.substring(t, F.lit(1), F.length(t) - len(TITLE_SUFFIX))).otherwise(t)
    for p in reversed(TITLE_PREFIXES):
        out = F.when(F.startswith(t, F.lit(p)), F.substring(t, F.lit(len(p) + 1), F.length(t))).otherwise(out)
    return out


def video_id(url) -> Column:
    """The id that a watch, short, live, embed or short-link address holds, or ''."""
    u = _c(url)
    host = F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", "")
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    asked = F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))
    segment = F.regexp_extract(path, r"^/(?:shorts|live|embed)/([^/]*)", 1)
    tube = F.coalesce(F.when(F.length(asked) > 0, F.coalesce(F.try_url_decode(asked), asked)), segment)
    return F.coalesce(F.when(host == "youtu.be", F.regexp_replace(path, "^/+|/+$", "")).when(F.endswith(host, F.lit("youtube.com")), tube), F.lit(""))


def channel_id_from_url(url) -> Column:
    return F.regexp_extract(_c(url), "^" + CHANNEL_PREFIX.replace(".", r"\.") + "([^/]*)", 1)


def channel_key(channel_id, name) -> Column:
    """The id, else the trimmed lower-case name, else null."""
    return F.coalesce(F.nullif(_c(channel_id), F.lit("")), F.nullif(F.lower(F.trim(_c(name))), F.lit("")))


def is_ad(details) -> Column:
    return F.coalesce(F.exists(_c(details), lambda d: d["name"].isin(*AD_MARKERS)), F.lit(False))


def is_music(products, url) -> Column:
    return F.coalesce(F.array_contains(_c(products), MUSIC_PRODUCT), F.lit(False)) | F.coalesce(F.contains(_c(url), F.lit(MUSIC_HOST)), F.lit(False))


def rfc3339(text) -> Column:
    """A timestamp, or null where the text isn't one with date, time and zone."""
    t = _c(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))


def slug(text, cap: int | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if cap is None else F.regexp_replace(F.substring(s, 1, cap), "-+$", "")


def area_of(topic) -> Column:
    return F.substring_index(_c(topic), "/", 1)


def sub_of(topic) -> Column:
    """What follows the first slash, or ''."""
    t = _c(topic)
    at = F.instr(t, "/")
    return F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise("")


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def normalize_topic(topic, areas: list[str], aliases: dict[str, str] | None = None) -> Column:
    """area or area/sub in the configured spelling; null for an unknown area."""
    t = _c(topic)
    area = _lookup(F.lower(F.trim(area_of(t))), {a.lower(): a for a in areas})
    raw = slug(sub_of(t), SUB_CAP)
    sub = F.coalesce(slug(_lookup(raw, aliases or {}), SUB_CAP), raw)
    plain = (sub == "") | sub.isin(*EMPTY_SUBS) | (sub == F.lower(area)) | (area == UNCLEAR)
    return F.when(area.isNotNull(), F.when(plain, area).otherwise(F.concat_ws("/", area, sub)))


def replace_area(topic, area, areas: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The subject under another area; an unknown area changes nothing."""
    moved = F.concat_ws("/", _c(area), F.nullif(sub_of(topic), F.lit("")))
    return F.coalesce(normalize_topic(moved, areas, aliases), _c(topic))


def first_category(categories) -> Column:
    return F.get(F.filter(_c(categories), lambda c: F.length(F.trim(c)) > 0), F.lit(0))


def area_for_category(category, areas: list[str]) -> Column:
    return _lookup(slug(category), {a: a for a in areas})


def fingerprint(areas: dict[str, str]) -> str:
    """Eight hex digits that change with any area or description."""
    text = "\x1e".join(sorted(f"{k}\0{v}" for k, v in areas.items()))
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def fingerprint_of(pairs) -> Column:
    """The same over an array of (id, description) structs."""
    joined = F.transform(_c(pairs), lambda p: F.concat(p["id"], F.lit("\0"), p["description"]))
    return F.substring(F.sha2(F.array_join(F.array_sort(joined), "\x1e"), 256), 1, 8)


def hue(text) -> Column:
    """FNV-1a of the bytes, as a hue of 360; offset and prime are fixed values."""
    digits = F.hex(F.encode(_c(text), "UTF-8"))
    pairs = F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(-1)).cast("int"))
    codes = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(pairs, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")))
    return (F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))) % 360).cast("int")


def norm_tags(tags) -> Column:
    return F.array_distinct(F.filter(F.transform(_c(tags), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def percent(part, whole) -> Column:
    return F.coalesce(F.try_divide(_c(part) * 100.0, _c(whole)), F.lit(0.0))


def has_usable_text(title, channel) -> Column:
    return (F.coalesce(F.length(_c(channel)), F.lit(0)) > 0) | ~F.coalesce(F.startswith(_c(title), F.lit("http")), F.lit(False))


def stale(taxonomy, basis, has_meta, unavailable, current) -> Column:
    """A verdict of other areas, or of the title alone where metadata came since."""
    other = ~F.coalesce(_c(taxonomy), F.lit("")).eqNullSafe(current if isinstance(current, Column) else F.lit(current))
    return other | ((F.coalesce(_c(basis), F.lit("")) != "full") & _c(has_meta) & ~_c(unavailable))


GONE_GROUPS = {"locked": ("age", "members"), "unknown": ("",)}


def matches_gone_reason(spec, reason) -> Column:
    """Whether a comma-separated list of reasons and groups takes in a reason."""
    r = F.coalesce(_c(reason), F.lit(""))
    each = F.transform(F.split(_c(spec), ","), lambda s: F.trim(s))
    hit = lambda s: reduce(lambda a, b: a | b, [(s == "all") | ((s == r) & (s != "")), *((s == g) & r.isin(*m) for g, m in GONE_GROUPS.items())])
    return F.exists(each, hit)


# Ordered marks of a final failure and their reasons.
ERROR_MARKS = (
    ("confirm your age", "age"),
    ("members", "members"),
    ("private", "private"),
    ("removed", "removed"),
    ("terminated", "terminated"),
    ("unavailable", "unavailable"),
    ("not available", "unavailable"),
)
# Marks of throttling, which concerns no single video.
THROTTLE_MARKS = ("not a bot", "too many requests", "http error 429")


def error_reason(message) -> Column:
    """The reason of a final failure; null for one that may pass."""
    m = F.lower(_c(message))
    return reduce(lambda rest, x: F.when(F.contains(m, F.lit(x[0])), x[1]).otherwise(rest), reversed(ERROR_MARKS), F.lit(None).cast("string"))


def is_throttled(message) -> Column:
    m = F.lower(_c(message))
    return reduce(lambda a, b: a | b, [F.contains(m, F.lit(x)) for x in THROTTLE_MARKS])


def parse_mode(text) -> Column:
    t = F.lower(F.trim(_c(text)))
    return F.when(t.isin(*MODES), t).otherwise("")


def clean_label(text) -> Column:
    """First line, without outer punctuation, lower case, one blank between words; '' if long."""
    line = F.substring_index(_c(text), "\n", 1)
    x = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")), r"\s+", " ")), "^ +| +$", "")
    return F.when((F.char_length(x) <= 48) & (F.size(F.split(x, " ")) <= 8), x).otherwise("")


def clip(text, cap: int) -> Column:
    """At most so many characters, the last a mark of omission."""
    t = _c(text)
    return F.when(F.char_length(t) <= cap, t).otherwise(F.concat(F.substring(t, 1, cap - 1), F.lit("…")))


def truncate(text, size: int) -> Column:
    """At most so many bytes of UTF-8 and a mark of omission; a character that is cut in two becomes the replacement character."""
    t = _c(text)
    cut = F.make_valid_utf8(F.substring(t.cast("binary"), 1, size).cast("string"))
    return F.when(F.octet_length(t) <= size, t).otherwise(F.concat(cut, F.lit("…")))


def cache_key(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *map(_c, parts)), 256), 1, 24)


def safe_key(key) -> Column:
    return _c(key).rlike("^[A-Za-z0-9_-]{1,20}$")


def confidence_text(confidence) -> Column:
    """Two decimals, blank for none."""
    c = _c(confidence)
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "").otherwise(F.format_string("%.2f", c))
