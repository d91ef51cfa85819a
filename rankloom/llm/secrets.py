"""Secret scan: candidates by expression, false positives removed by a random forest.

Only DataFrame functions and Spark's own forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Runs of key characters of length 16 and more with a digit; a run is looked through once, from its start.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: At most so many labelled findings are used to fit the forest.
MAX_TRAINING_ROWS = 20_000

#: Formats of well-known keys, words that name a secret, words that name something else.
KNOWN_KEYS = (r"^(AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^sk_(live|test)_[A-Za-z0-9]{16,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$", r"^AIza[0-9A-Za-z_-]{35}$", r"^glpat-[0-9A-Za-z_-]{20}$")
SECRET_WORDS = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "apikey", "access")
OTHER_WORDS = ("sha", "sha1", "sha256", "md5", "hash", "commit", "uuid", "checksum", "digest", "etag", "revision", "card", "phone", "order", "isbn", "version")

FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "distinct", "class_changes", "case_changes", "vowel_changes",
    "longest_letters", "longest_digits", "hex", "covered", "assigned", "quoted", "secret_near", "other_near", "path_like", "slashes",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, token``, what stands ``left`` and ``right`` (48 characters each), and the share of the token that is ``covered`` by words of its text.

    Offsets count code points, ends are exclusive. Texts without a digit are passed over,
    as a candidate needs one; all others are read whole, once. What leaves a text is a narrow row for each candidate and for each
    word that both its candidates and what lies between them have, so a text with very many candidates is no more than many rows:
    their offsets are running sums, and their words are looked up by a join.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place")).where(F.col("text").rlike("[0-9]"))
    rows = rows.withColumn("tokens", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("tokens") > 0)
    # What lies between the matches; lengths of both, summed up, give the offsets.
    rows = rows.withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text")
    # The dictionary of a text: its words outside of candidates, of which those matter that a candidate has.
    words = lambda c: F.split(F.lower(F.array_join(c, " ")), "[^a-z]+")
    rows = rows.withColumn("shared", F.filter(F.array_intersect(words("tokens"), words("gaps")), lambda w: (F.length(w) >= 3) & ~w.isin(*SECRET_WORDS)))
    none = F.lit(None).cast("string")

    def narrow(token: Column, i: Column) -> Column:
        before, after = F.get("gaps", i), F.get("gaps", i + 1)
        left = F.substring(before, F.greatest(F.length(before) - 47, F.lit(1)), F.lit(48))
        return F.struct(i.alias("i"), token.alias("token"), left.alias("left"), F.substring(after, F.lit(1), F.lit(48)).alias("right"), F.length(before).alias("gap"))

    known = F.transform("shared", lambda w: F.struct(F.lit(-1).alias("i"), w.alias("token"), none.alias("left"), none.alias("right"), F.lit(0).alias("gap")))
    parts = checkpoint(rows.select("doc_id", "place", F.inline(F.concat(F.transform("tokens", narrow), known))))
    found = parts.where("i >= 0")
    upto = W.partitionBy("place").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.length("token")).over(upto).cast("int")
    runs = found.select("place", "i", F.explode(F.split(F.lower("token"), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    dictionary = parts.where("i < 0").select("place", F.col("token").alias("w"))
    covered = runs.join(dictionary, ["place", "w"]).groupBy("place", "i").agg(F.sum(F.length("w")).alias("n"))
    rows = found.withColumn("end", ends).join(covered, ["place", "i"], "left")
    return rows.select("doc_id", (F.col("end") - F.length("token")).alias("start"), "end", "token", "left", "right", (F.coalesce("n", F.lit(0)) / F.length("token")).alias("covered"))


def _share(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern)) / F.length(token)


def _longest(token: Column, other: str) -> Column:
    """Length of the longest run without characters of ``other``."""
    return F.array_max(F.transform(F.split(token, other), F.length))


def described(found: DataFrame) -> DataFrame:
    """Adds the FEATURES: length, character transitions, dictionary coverage, path and neighbouring words."""
    t, left, right = F.col("token"), F.lower("left"), F.lower("right")
    near = F.concat(F.slice(F.reverse(F.split(F.regexp_replace(left, r"[^a-z0-9]+$", ""), "[^a-z0-9]+")), 1, 3), F.slice(F.split(F.regexp_replace(right, "^[^a-z0-9]+", ""), "[^a-z0-9]+"), 1, 2))
    columns = {
        "length": F.length(t),
        "digits": _share(t, "[0-9]"),
        "uppers": _share(t, "[A-Z]"),
        "lowers": _share(t, "[a-z]"),
        "marks": _share(t, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.length(t),
        "class_changes": _share(t, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "case_changes": _share(t, "[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_changes": _share(F.lower(t), "[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "longest_letters": _longest(t, "[^A-Za-z]+"),
        "longest_digits": _longest(t, "[^0-9]+"),
        "hex": t.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "covered": F.col("covered"),
        "assigned": left.rlike("[=:][ \\t]*[\"']?$"),
        "quoted": left.rlike("[\"']$") & right.rlike("^[\"']"),
        "secret_near": F.arrays_overlap(near, F.array(*map(F.lit, SECRET_WORDS))),
        "other_near": F.arrays_overlap(near, F.array(*map(F.lit, OTHER_WORDS))),
        "path_like": left.rlike(r"(://\S*|[/.\\])$") | right.rlike(r"^[/\\.][a-z0-9]"),
        "slashes": F.regexp_count(t, F.lit("/")),
    }
    return found.withColumns({name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in columns.items()})


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings whose label is beyond doubt, with ``label``: 1 for keys of a known format and assignments to a
    secret's name; 0 for plain numbers, tokens made of the text's words, path parts, and values of other names.

    The forest learns from the features alone, which overlap with these rules, to judge the rest.
    """
    known = F.lit(False)
    for pattern in KNOWN_KEYS:
        known = known | F.col("token").rlike(pattern)
    named = (F.col("assigned") > 0) & (F.col("secret_near") > 0) & (F.col("other_near") == 0) & (F.col("distinct") * F.col("length") >= 8)
    other = F.col("token").rlike("^[0-9]+$") | (F.col("covered") >= 0.5) | (F.col("path_like") > 0) | ((F.col("other_near") > 0) & (F.col("secret_near") == 0))
    label = F.when(known | named, 1.0).when(other, 0.0)
    return found.withColumn("label", label).where("label is not null")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_rows: int = MAX_TRAINING_ROWS, trees: int = 20, depth: int = 6) -> DataFrame:
    """All candidates of all texts: ``doc_id, start, end, token, score, secret``.

    ``score`` is the forest's probability that a candidate is a secret; ``secret`` says that it
    reaches ``threshold``. The forest is fitted on at most ``max_rows`` different labelled findings of the
    corpus, those with the least hash. If these do not have both labels, the score is
    the label of the one they have, or 0.5 without any.

    Null and empty texts have no candidates. Rows that repeat give findings that repeat, a
    null id stays null, other columns are ignored, and an empty table gives no rows.
    """
    found = checkpoint(described(candidates(docs, id_col, text_col)))
    labelled = labelled_findings(found).select("token", "label", *FEATURES).dropDuplicates(["token", "label"])
    n = labelled.count()
    at = F.xxhash64("token", F.lit(7))
    if n > max_rows:
        labelled = labelled.where(F.pmod(at, F.lit(1 << 30)) < int(min(1.0, 1.2 * max_rows / n + 1e-3) * (1 << 30)))
    sample = checkpoint(labelled.orderBy(at, "token", "label").limit(max_rows))
    classes = [r["label"] for r in sample.select("label").distinct().collect()]
    columns = ["doc_id", "start", "end", "token"]
    if len(classes) < 2:
        score = F.lit(classes[0] if classes else 0.5)
        return found.select(*columns, score.alias("score"), (score >= threshold).alias("secret"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=11)
    model = forest.fit(vectors.transform(sample))
    scored = model.transform(vectors.transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*columns, "score", (F.col("score") >= threshold).alias("secret"))


def op7_secrets(spark, sf_dir):
    """Findings with a digest in the secret's stead."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), F.round("score", 6).alias("score"), "secret")
