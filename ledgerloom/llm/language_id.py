"""Language identification by rank-order profiles (operator 5).

Character n-grams of one to three characters are counted over lower-cased
letters, a blank standing for anything between words. A language's profile
ranks its ``top`` most frequent n-grams, counted over all its training texts;
a document's profile ranks its own. The out-of-place distance sums, over the
document's ranked n-grams, how far each stands from its rank in the language's
profile (``top`` where it is missing). The nearest language wins.

Counting is a partial aggregate per batch and language, then one Spark
aggregate; profiles are ``top`` rows a language, and at most
``MAX_LANGUAGES`` languages are learned (an error beyond, never a cut), so
what is broadcast is bounded.

Defined results: null texts and texts without a letter give ``und`` with score
0, as does everything when nothing was learned; ties go to the language first
by code point, and equal counts rank by n-gram; ``score`` is 1 less the
distance's share of its maximum; a null ``doc_id`` is never held out (its
remainder is null) and never trained on; repeated rows count each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table

TOP = 300
MAX_LANGUAGES = 2000
_SHIFT = np.uint64(21)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 characters: 21 bits a character, a blank is 0; n-grams that are blank or hold a blank inside are left out."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 0).astype(np.uint64)
    c = np.concatenate((np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    a, b = c[:-1], c[1:]
    pairs = (a << _SHIFT) | b | np.uint64(1 << 62)
    triples = (c[:-2] << (_SHIFT + _SHIFT)) | (c[1:-1] << _SHIFT) | c[2:]
    return np.concatenate((c[c != 0], pairs[(a != 0) | (b != 0)], triples[c[1:-1] != 0] ^ np.uint64(1 << 63)))


def ranked(text: str, top: int) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, equal counts by code."""
    code, count = np.unique(ngrams(text), return_counts=True)
    if len(code) > top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        code, count = code[count >= least], count[count >= least]
    return code[np.argsort(-count, kind="stable")[:top]]


def profiles(train: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language of ``train`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, chunks in held.items():
                code, which = np.unique(np.concatenate([c for c, _ in chunks]), return_inverse=True)
                n = np.bincount(which, np.concatenate([k for _, k in chunks])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                code, n = np.unique(ngrams(text.as_py()), return_counts=True)
                held.setdefault(lang, []).append((code, n))
                size += len(code)
                if size > 2_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    usable = train.filter("text is not null and lang is not null").select("text", "lang")
    counts = usable.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # codes with the top bit set are negative as longs: order as unsigned, like the documents' own profiles
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code") < 0, "code")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for lang, group in best.select("lang", "rank", "code").toPandas().sort_values(["lang", "rank"]).groupby("lang"):
        out[lang] = group["code"].to_numpy(np.int64).view(np.uint64)
    return dict(sorted(out.items()))


class Matcher:
    def __init__(self, learned: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = list(learned), top
        self.codes = np.unique(np.concatenate(list(learned.values()))) if learned else np.empty(0, np.uint64)
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1)
        for k, codes in enumerate(learned.values()):
            self.rank[np.searchsorted(self.codes, codes), k] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(text, self.top) if text else np.empty(0, np.uint64)
        if not len(mine) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != mine)] = len(self.codes)
        rank = self.rank[at]
        away = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], round(1 - float(away[best]) / (self.top * len(mine)), 6)


def identify(docs: DataFrame, learned: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """``docs`` (doc_id, text) with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(learned, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    train = docs.filter(fold != 1)
    return identify(docs.select("doc_id", "held_out", "text"), profiles(train))


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
