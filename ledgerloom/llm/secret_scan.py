"""Secret scanning with a random forest against false positives (operator 3), in DataFrame and ML operations only.

Candidates are runs of at least 16 characters of ``[A-Za-z0-9+/_-]``, and
values of 8 and more characters without blanks between quotation marks. Every
occurrence is one, with its own place. Most are harmless: long words, card
numbers, paths, addresses. A random forest, trained on labelled findings,
tells them apart by

* length, and the share of each class of characters;
* transitions: how often neighbouring characters change their class, and how
  many distinct characters there are a character;
* dictionary coverage: the share of the candidate that known words make up.
  The dictionary holds the corpus's ``DICTIONARY`` most widespread short words;
* path: whether the candidate or its word looks like a path or an address,
  and the source the document comes from;
* neighbouring words: an assignment or quotation mark next to it, a key-like
  word before it, and buckets of the words' hashes.

Labelled findings come as a table (doc_id, start, is_secret), reviewed by
people. Training takes at most ``TRAIN_ROWS`` of each class, those with the
smallest hash; every candidate of every document is scored. Where there are no
reviewed ones, ``is_secret`` labels by one view only, the words next to the
candidate: assigned to a key-like name, or nothing like that near it. The forest
then gets the other view (``BLIND``: value, path and farther words), so that it
can't learn the rule back, and a value that looks like the labelled ones is
found without the name. ``held_out`` measures it on values it didn't see.

Places and neighbours come from the text's pieces between candidates, cut once
a text, so no row carries more than its neighbourhood: up to five words before
(as far as they lie within the last five pieces) and what stands up to three
words behind, within two.

Tables in the shared folder hold features and hashes, never a value or the
words next to it; findings are returned by place and SHA-256.

Defined results: null and empty texts have no candidates; repeated rows give
their findings each; a null ``doc_id`` is kept; a missing ``source`` counts as
null; without labels of both classes every candidate stays (probability null,
``kept`` true); an empty table gives no rows; extra columns are ignored.
Offsets are code points.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, read_table

CANDIDATE = r"(?<=[\"'])[^\"'\x20\x09-\x0D]{8,}(?=[\"'])|[A-Za-z0-9+/_-]{16,}"
KEY_WORD = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|auth|bearer|credential|private)"
DICTIONARY = 5_000
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED, FOLDS = 30, 6, 42, 3
BLIND = ["length", "digits", "lowers", "uppers", "others", "turns", "distinct", "hex", "known", "path_like", "address_like", "source_bucket", "left3_bucket", "right_bucket"]
FEATURES = [*BLIND, "assigned", "quoted", "key_before", "left_bucket"]
_BLOCK = 128


def _sums_before(values: Column) -> Column:
    """For an array of longs, the sum of all before each; in blocks, so that long arrays aren't copied a value at a time."""

    def run(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda k: F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK)))
    base = run(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v)))
    return F.flatten(F.transform(blocks, lambda x, k: F.transform(F.slice(run(x), F.lit(1), F.size(x)), lambda v: v + F.get(base, k))))


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate: its place, itself, its word, what stands in the word before it, and the words around it."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    some = docs.filter(F.col("text").rlike(CANDIDATE)).select("doc_id", source.alias("source"), F.split("text", CANDIDATE, -1).alias("gap"), F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)).alias("found"))
    lengths = F.transform("found", lambda c, i: (F.length(F.get("gap", i)) + F.length(c)).cast("long"))
    # each gap's last words, with what is left of the word that touches the candidate; and its first ones
    tail = F.transform("gap", lambda g: F.reverse(F.regexp_extract(F.reverse(g), r"^([^\x20\x09-\x0D]*(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,5}[\x20\x09-\x0D]*)", 1)))
    head = F.transform("gap", lambda g: F.regexp_extract(g, r"^([^\x20\x09-\x0D]*(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,3})", 1))
    cut = some.select("doc_id", "source", "found", _sums_before(lengths).alias("at"), F.transform("gap", lambda g: F.length(g)).alias("width"), tail.alias("tail"), head.alias("head"))

    def piece(i: Column, k: int) -> list[Column]:
        return [F.coalesce(F.when(i >= k, F.get("tail", i - k)), F.lit("")), F.coalesce(F.when(i >= k, F.get("found", i - k)), F.lit(""))]

    def one(c: Column, i: Column) -> Column:
        left = [x for k in range(4, 0, -1) for x in piece(i, k)]
        right = [F.get("head", i + 1), F.coalesce(F.get("found", i + 1), F.lit("")), F.coalesce(F.get("head", i + 2), F.lit(""))]
        return F.struct(c.alias("candidate"), (F.get("at", i) + F.get("width", i)).alias("start"), F.concat(*left, F.get("tail", i)).alias("left"), F.concat(*right).alias("right"))

    rows = cut.select("doc_id", "source", F.explode(F.transform("found", one)).alias("c")).select("doc_id", "source", "c.*")
    blank = r"[\x20\x09-\x0D]+"
    rows = rows.withColumn("l", F.reverse(F.split("left", blank))).withColumn("r", F.split("right", blank))
    before, behind = F.get("l", F.lit(0)), F.get("r", F.lit(0))
    word = lambda side, k: F.coalesce(F.get(side, F.lit(k)), F.lit(""))
    return rows.select(
        "doc_id", "source", F.concat(before, "candidate", behind).alias("word"), before.alias("before"), word("l", 1).alias("left1"), word("l", 2).alias("left2"), word("l", 3).alias("left3"), word("r", 1).alias("right1"), "candidate", "start"
    )


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """The ``size`` words of 3 to 6 letters that most documents hold."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{3,6})\b"), F.lit(1)))).alias("entry"))
    return words.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entry").limit(size).select("entry")


def with_features(found: DataFrame, known_words: DataFrame) -> DataFrame:
    """``found``, each row with a ``finding`` of its own, and its features."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda cls: F.regexp_count(c, F.lit(cls)) / n
    turn = r"[0-9](?=[^0-9])|[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[^0-9a-zA-Z](?=[0-9a-zA-Z])"
    bucket = lambda w: F.pmod(F.crc32(F.lower(w).cast("binary")), F.lit(32)).cast("double")
    around = F.concat_ws(" ", "left2", "left1", "before")
    # every piece of 3 to 6 letters may be a word; covered letters are counted once, by place. Keyed by finding, so that a value
    # of many copies is dealt like others; the pieces of one meet in their own task before they are dealt
    row = F.struct(*[F.col(x) for x in found.columns]).alias("row")
    letters = found.select("finding", row, F.lower(c).alias("c")).select("finding", "row", "c", F.explode(F.sequence(F.lit(1), F.length("c"))).alias("p"))
    spots = letters.select("finding", "row", "p", F.explode(F.transform(F.lit([3, 4, 5, 6]), lambda k: F.struct(k.alias("k"), F.call_function("substr", F.col("c"), F.col("p"), k).alias("entry")))).alias("s"))
    spots = spots.select("finding", "row", "p", "s.*").join(F.broadcast(known_words.withColumn("hit", F.lit(True))), "entry", "left")
    at = F.when(F.col("hit"), F.struct("p", "k"))
    covered = spots.groupBy("finding").agg(F.first("row").alias("row"), F.collect_set(at).alias("hits"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["p"], h["p"] + h["k"] - 1))))
    return covered.select("row.*", F.size(places).alias("letters")).select(
        *found.columns,
        n.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[a-z]").alias("lowers"),
        share("[A-Z]").alias("uppers"),
        share("[^a-zA-Z0-9]").alias("others"),
        share(turn).alias("turns"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        F.coalesce(F.col("letters") / n, F.lit(0.0)).alias("known"),
        (F.col("word").contains("/") | F.col("word").contains("\\")).cast("double").alias("path_like"),
        F.col("word").rlike(r"@|www\.|://").cast("double").alias("address_like"),
        F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32)).cast("double").alias("source_bucket"),
        bucket(F.col("left3")).alias("left3_bucket"),
        bucket(F.col("right1")).alias("right_bucket"),
        around.rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike("[\"']$").cast("double").alias("quoted"),
        around.rlike(KEY_WORD).cast("double").alias("key_before"),
        bucket(F.col("left1")).alias("left_bucket"),
    )


def is_secret() -> Column:
    """What the words next to a finding tell: assigned to a key-like name (true), neither assigned nor after such a name (false), or nothing (null)."""
    around = F.concat_ws(" ", "left2", "left1", "before")
    yes = around.rlike(KEY_WORD.replace("(?i)", "(?i)\\b") + r"\s*[=:]\s*[\"']?$")
    no = ~around.rlike(r"[=:]\s*[\"']?$") & ~around.rlike(KEY_WORD)
    return F.when(yes, True).when(no, False)


def train(labelled: DataFrame, names: list[str], rows: int = TRAIN_ROWS):
    """A forest from at most ``rows`` findings (with ``is_secret``) of each class; None without both classes."""
    given = labelled.withColumn("label", F.col("is_secret").cast("double"))
    keep = [given.filter(F.col("label") == y).orderBy("draw", "doc_id", "start").limit(rows).select("label", *names) for y in (1.0, 0.0)]
    sample = materialize(keep[0].unionByName(keep[1]), "training")
    if sample.select("label").distinct().count() < 2:
        discard(sample)
        return None, None
    # one sorted partition of a bounded sample, so that the forest's draws are the same in every run
    ordered = sample.repartition(1).sortWithinPartitions("label", *names)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", maxBins=32)
    model = forest.fit(assembler.transform(ordered).select("label", "features"))
    discard(sample)
    return assembler, model


def _scored(featured: DataFrame, assembler: VectorAssembler, model) -> DataFrame:
    return model.transform(assembler.transform(featured)).withColumn("probability", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))


def _featured(docs: DataFrame) -> DataFrame:
    """Places, hashes, features and own labels of all findings, written. Neither values nor their surroundings are, in clear text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *["source" for c in docs.columns if c.lower() == "source"])
    words = materialize(dictionary(slim), "dictionary")
    found = with_features(candidates(slim).withColumn("finding", F.monotonically_increasing_id()), words)
    told = is_secret().alias("told")
    own = [F.sha2("candidate", 256).alias("candidate_sha256"), F.xxhash64("candidate", "doc_id", "start").alias("draw"), F.pmod(F.xxhash64("candidate"), F.lit(FOLDS)).alias("fold")]
    featured = materialize(found.select("doc_id", "start", (F.col("start") + F.length("candidate")).alias("finish"), told, *own, *FEATURES), "features")
    discard(words)
    return featured


def _labelled(featured: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, list[str]]:
    if labels is None:
        return featured.withColumn("is_secret", F.col("told")).filter("is_secret is not null"), BLIND
    return featured.join(labels.select("doc_id", "start", "is_secret").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"]), FEATURES


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All candidates with ``probability`` and ``kept`` (false: removed as a false positive)."""
    featured = _featured(docs)
    labelled, names = _labelled(featured, labels)
    assembler, model = train(labelled, names)
    if model is None:
        scored = featured.withColumn("probability", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    else:
        scored = _scored(featured, assembler, model).withColumn("kept", F.col("probability") >= threshold)
    scored = materialize(scored.select("doc_id", "start", "finish", "candidate_sha256", "probability", "kept"), "findings")
    discard(featured)
    return scored


def held_out(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall on the labelled findings of one fold of values (of ``FOLDS``), by a forest that learned from the others."""
    featured = _featured(docs)
    labelled, names = _labelled(featured, labels)
    aside = F.col("fold") == 0  # equal values are on one side
    assembler, model = train(labelled.filter(~aside), names)
    said = (F.col("probability") >= threshold).cast("long")
    got = _scored(labelled.filter(aside), assembler, model).agg(F.sum(said).alias("said"), F.sum(said * F.col("is_secret").cast("long")).alias("right"), F.sum(F.col("is_secret").cast("long")).alias("true"), F.count(F.lit(1)).alias("n")).first()
    discard(featured)
    return {"n": got.n, "secrets": got.true, "precision": got.right / got.said if got.said else 0.0, "recall": got.right / got.true if got.true else 0.0}


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
SQL: dict[str, str] = {}
