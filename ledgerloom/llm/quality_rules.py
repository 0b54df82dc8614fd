"""Quality rules with a hashed n-gram log-likelihood ratio (operator 1).

Two multinomials over hashed byte n-grams are counted: one of trusted target
texts, one of the whole raw corpus. A document's score is the mean, over its
n-grams, of ``log p_target - log p_raw``; it is kept if no base rule fails and
the score is at least ``threshold``. Equal texts get equal verdicts, whatever
stands beside them: counts are integers, the ratios are fixed-point integers
of ``1 / SCALE``, so a document's sum is exact, and nothing is drawn at random.

The target is a bounded sample: the ``target_rows`` trusted labels with the
smallest id hash. The raw counts and the verdicts cover every document.

Defined results: a null or empty text has no words, fails the base rule and
scores 0; ties at the threshold are kept; repeated rows are scored alike;
without trusted labels every score is 0; an empty table gives no rows; other
columns pass through ``filter_documents`` untouched and are ignored by
``score_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .textvec import Words, combine, mix, parts

GRAM = 4
BUCKETS = 1 << 16
THRESHOLD = -0.4
#: Log ratios are integers of this fraction; below 64 in size, 10 ** 10 of them fit a long.
SCALE = 1 << 23
#: Trusted documents that make the target: their ids (8 bytes each) are broadcast.
TARGET_ROWS = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram that lies inside a text, and the n-grams before each text."""
    data, off = words.data, words.offsets
    count = np.maximum(np.diff(off) - GRAM + 1, 0)
    before = np.concatenate(([0], np.cumsum(count)))
    if not before[-1]:
        return np.empty(0, np.int64), before
    code = np.zeros(len(data) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code |= data[k : len(data) - GRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    inside = np.repeat(off[:-1] - before[:-1], count) + np.arange(before[-1])
    with np.errstate(over="ignore"):
        return ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), before


def sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the borders ``before``."""
    c = np.concatenate((np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)))
    return c[before[1:]] - c[before[:-1]]


def base_stats(words: Words) -> dict[str, np.ndarray]:
    data, off, n = words.data, words.offsets, len(words.offsets) - 1
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    per_word = lead[words.end] - lead[words.start]
    doc_salt = mix(np.arange(n, dtype=np.uint64))

    # lines: their bytes between \n or a text's borders; hashed through the words and the bytes between them
    cut = np.zeros(len(data) + 1, bool)
    newline = np.flatnonzero(data == 10)
    cut[newline + 1] = True
    cut[off] = True
    begin = np.flatnonzero(cut[:-1])
    stop = np.append(begin[1:], len(data))[: len(begin)]
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(data) else 0)
    inside = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
    full = inside[1] > inside[0]
    begin, stop = begin[full], stop[full]
    doc = np.searchsorted(off, begin, "right") - 1
    key = mix(words.span_hash(begin, stop) ^ doc_salt[doc])
    fresh = np.unique(key, return_index=True)[1]
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[fresh], minlength=n)

    h, before = combine(words.hash, words.first, (0, 1, 2))
    wdoc = np.repeat(np.arange(n), np.diff(before))
    _, inverse, count = np.unique(mix(h ^ doc_salt[wdoc]), return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    at = words.first[:-1][wdoc[again]] + again - before[:-1][wdoc[again]]
    marked = np.zeros(len(words.start), bool)
    for k in range(3):
        marked[at + k] = True
    return {
        "n_words": words.counts(),
        "word_chars": sums(per_word, words.first),
        "n_symbols": sums(_SYMBOL[data], off),
        "n_dup_lines": dup,
        "n_repeat_words": sums(marked, words.first),
    }


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids of trusted documents, chosen by a hash of the id."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratio(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p_target - log p_raw for each bucket, in ``1 / SCALE``: raw counts are scaled to the target's total, then one is added to both, so rare n-grams weigh little."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in parts(batch):
                h, before = grams(Words(part.column("text")))
                total[0] += np.bincount(h, minlength=BUCKETS)
                target = np.repeat(part.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(before))
                total[1] += np.bincount(h[target], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    ids = trusted_ids(labels, target_rows).withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    table = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = table.toPandas()  # BUCKETS rows, whatever the input
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log(target + 1) - np.log(raw * (target.sum() / raw.sum()) + 1)
    return np.rint(ratio * SCALE).astype(np.int64)


def _judge(part: pa.RecordBatch, weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    words = Words(part.column("text"))
    out = base_stats(words)
    h, before = grams(words)
    out["score"] = np.round(sums(weights[h], before) / (np.maximum(np.diff(before), 1) * float(SCALE)), 9)
    n = out["n_words"]
    out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Statistics, ``score``, ``base_failed`` and ``kept`` of each document."""
    weights = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, target_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                got = _judge(part, weights.value, threshold)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(got[s].astype(np.int64)) for s in STATS], pa.array(got["score"]), pa.array(got["base_failed"]), pa.array(got["kept"])], ["doc_id", *STATS, "score", "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATS) + ", score double, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The kept documents, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, target_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts(batch.select(["text"])):
                kept = _judge(part, weights.value, threshold)["kept"]
                yield batch.slice(done, part.num_rows).filter(pa.array(kept))
                done += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL: dict[str, str] = {}
