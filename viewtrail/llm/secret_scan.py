"""Secret scans: a random forest over candidates, in DataFrame operations only.

Candidates are quoted values and long runs of key characters. A forest trained
on labelled findings removes false positives by the candidate's length, its
character transitions, the share of it that dictionary words cover, the path of
its document and the words beside it. Training is the forest of Spark's machine
learning library over a bounded table of findings; the trees are then written
out as conditional expressions, so that scoring stays in generated code.

The synthetic corpora hold no labelled findings: ``example_findings`` makes a
table of them by rules (keys and tokens in assignments against checksums,
identifiers, placeholders, commit names and plain words). ``train`` takes any
table of the same columns.

Defined cases: null and empty texts have no candidates; a null path is an empty
one; repeated rows and null ids give their findings row by row; equal findings
of one text are told apart by their place; an empty table gives an empty
result; other columns aren't read. Findings carry a digest, never the secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: A quoted value, or a run of key characters.
CANDIDATE = r"""(?<=["'])[^\s"']{8,}(?=["'])|[A-Za-z0-9+/_=\-]{16,}"""
LEAST = 8
DICTIONARY = ("access", "account", "admin", "and", "api", "auth", "build", "change", "client", "code", "config", "data", "default", "demo", "dev", "dummy", "example", "fake", "file", "for", "here", "host", "http", "image", "index", "insert", "key", "local", "main", "mock", "name", "page", "pass", "password", "path", "placeholder", "prod", "public", "sample", "secret", "server", "service", "some", "test", "the", "this", "token", "user", "value", "version", "with", "word", "your")
KEYS = r"(?i)(secret|token|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key|\bkey\b)"
PLAIN = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|revision|etag|example|sample|dummy|placeholder|id\b)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
FEATURES = ("length", "transitions", "case_transitions", "vowels", "digits", "distinct", "hex_only", "dictionary", "test_path", "key_near", "plain_near", "assigned", "quoted")
TREES, DEPTH, SEED = 20, 6, 7


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs, by name."""
    c, low = candidate, F.lower(candidate)
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[aeiou]", "\u0001"), "[a-z]", "\u0002"), "[0-9]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    cases = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "\u0001"), "[A-Z]", "\u0002"), "[^\u0001\u0002]", "\u0003")
    runs = lambda x: F.length(F.regexp_replace(x, r"(?s)(.)\1*", "$1"))
    share = lambda pattern: (n - F.length(F.regexp_replace(low, pattern, ""))) / n
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    return {
        "length": n,
        "transitions": runs(kinds) / n,
        "case_transitions": runs(cases) / n,
        "vowels": share("[aeiou]"),
        "digits": share("[0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "hex_only": yes(low.rlike("^[0-9a-f]+$")),
        "dictionary": share("(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
        "test_path": yes(path.rlike(TEST_PATH)),
        "key_near": yes(before.rlike(KEYS)),
        "plain_near": yes(F.concat_ws(" ", before, after).rlike(PLAIN)),
        "assigned": yes(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": yes(before.rlike("[\"']$")),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, word_no, nth, candidate, before, after, path."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.split(text, r"\s+").alias("words"))
    each = words.select("doc_id", "path", "words", F.posexplode("words").alias("word_no", "word")).filter((F.length("word") >= LEAST) & F.col("word").rlike(CANDIDATE))
    near = lambda k: F.coalesce(F.get("words", F.col("word_no") + k), F.lit(""))
    hit = F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("nth", "candidate")
    found = each.select("doc_id", "path", "word_no", "word", F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("ahead"), near(1).alias("next"), hit)
    within = F.expr("substring_index(word, candidate, 1)")
    rest = F.expr("substring(word, length(substring_index(word, candidate, 1)) + length(candidate) + 1)")
    return found.select("doc_id", "word_no", "nth", "candidate", F.concat_ws(" ", "ahead", within).alias("before"), F.concat_ws(" ", rest, "next").alias("after"), "path")


def example_findings(spark: SparkSession, count: int = 6000) -> DataFrame:
    """candidate, before, after, path, label: labelled findings made by rules."""
    i = F.col("id")
    digest = lambda salt, n: F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")), 256), 1, n)
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))
    coded = F.translate(F.base64(F.sha2(F.concat(F.lit("b"), i.cast("string")), 512).cast("binary")), "=", "")
    mixed = F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), i.cast("string")), 512))), 1, 40)
    names = lambda salt: pick(salt, DICTIONARY)
    secret_context = F.concat(pick("k", ("token", "secret", "api_key", "password", "access token", "auth", "Bearer", "private key")), pick("a", (" = \"", ": '", "=", " = ", " ")))
    plain_context = F.concat(pick("p", ("commit", "sha1", "checksum", "md5", "digest of", "uuid", "revision", "etag", "see", "the", "of")), pick("b", (" ", ": ", " = ", " \"")))
    kinds = [
        (1, F.concat(F.lit(""), digest("h", 40)), secret_context), (1, mixed, secret_context), (1, F.concat(F.lit("AKIA"), F.upper(digest("u", 16))), pick("s", ("", "key ", "aws = "))),
        (1, F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), pick("s", ("", "token ", "= "))), (1, digest("x", 32), secret_context), (1, F.substring(mixed, 1, 20), secret_context),
        (0, digest("c", 40), plain_context), (0, digest("d", 32), plain_context), (0, F.concat_ws("-", digest("e", 8), digest("f", 4), digest("g", 12)), plain_context),
        (0, F.concat_ws("_", names("1"), names("2"), names("3"), names("4")), pick("t", ("", "token = \"", "key: ", "name = "))), (0, F.concat_ws("-", F.lit("your"), names("5"), names("6"), F.lit("here")), secret_context),
        (0, F.repeat(pick("r", ("x", "0", "-", "=", "A", "_", "ab")), 20), secret_context), (0, F.concat(names("7"), names("8"), names("9"), names("10")), plain_context), (0, F.substring(coded, 1, 24), F.lit("sample ")),
        (0, F.concat_ws("/", names("11"), names("12"), names("13"), names("14")), plain_context), (0, F.rpad(F.abs(F.xxhash64(i)).cast("string"), 18, "0"), pick("n", ("", "number ", "id ", "of "))),
        (0, F.initcap(F.substring(F.translate(digest("y", 40), "0123456789abcdef", "aeiouaietnrshdlm"), 1, 18)), plain_context), (0, F.substring(F.translate(digest("z", 40), "0123456789abcdef", "enrchstieauberge"), 1, 22), pick("o", ("", "the ", "of the ", "and "))),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    column = lambda k: reduce(lambda rest, x: F.when(kind == x[0], x[1][k] if k else F.lit(x[1][0])).otherwise(rest), list(enumerate(kinds))[1:], kinds[0][k] if k else F.lit(kinds[0][0]))
    rows = spark.range(0, count, 1, 1)
    return rows.select(column(1).alias("candidate"), column(2).alias("before"), pick("w", ("", "\"", "of", "and", "# test")).alias("after"), pick("q", ("src/main", "src/app", "tests/unit", "docs/guide", "src0", "lib")).alias("path"), column(0).alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """The forest's trees as nested tuples (feature, threshold, left, right) or shares."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    x = features(text("candidate"), text("before"), text("after"), text("path"))
    rows = findings.filter(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("label"), *(v.cast("double").alias(k) for k, v in x.items())).coalesce(1)
    rows = VectorAssembler(inputCols=list(x), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5).fit(rows)

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / max(sum(stats), 1e-12) if len(stats) > 1 else 0.0
        split = node.split()
        return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._call_java("rootNode")) for t in model.trees]


def score(forest: list, x: list[Column]) -> Column:
    """The forest's mean share of secrets, as one expression."""

    def expression(node):
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, threshold, left, right = node
        return F.when(x[f] <= threshold, expression(left)).otherwise(expression(right))

    return reduce(lambda a, b: a + b, map(expression, forest)) / float(len(forest))


def scan(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate: doc_id, word_no, nth, length, sha256, score, is_secret."""
    found = candidates(docs, id_col, text_col, path_col)
    x = features(*map(F.col, ("candidate", "before", "after", "path")))
    held = found.select("doc_id", "word_no", "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("sha256"), F.array(*(v.cast("double") for v in x.values())).alias("x"))
    scored = held.withColumn("score", F.round(score(forest, [F.col("x")[k] for k in range(len(x))]), 9))
    return scored.select("doc_id", "word_no", "nth", "length", "sha256", "score", (F.col("score") >= threshold).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every candidate of every document."""
    return scan(table(spark, sf_dir, "documents"), train(example_findings(spark)))
