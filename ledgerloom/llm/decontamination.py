"""Benchmark decontamination by spaced seeds (operator 4).

A seed is a fixed mask over word positions: positions with 1 are hashed,
positions with 0 are ignored, so a substituted word under a 0 doesn't hide a
copy. Hashes of all benchmark windows are looked up from all document windows
under each mask; each hit gives an alignment, and the words of both texts are
compared along it. Of windows that agree one after the other on one alignment
only the first is a hit, so a phrase that both texts repeat many times costs
its alignments, not all pairs of its places. A document is contaminated by an item if, on one
alignment, at least ``share`` of the item's words agree, or some ``window``
consecutive positions of the item hold at least ``agree`` equal words (the
whole item where it is shorter than the window).

The benchmark is read in blocks of at most ``block_bytes`` of text, each of
which is broadcast; the documents are scanned once a block. Documents are
never shuffled.

Every pattern of agreeing words that this rule accepts has a hit. Items under
``LONG`` words use the masks ``SHORT``, which meet every pattern of 5 to 15
words with ``share`` of them equal. Longer ones use ``MASKS``, which meet every
pattern of 16 to 31 words with that share, and so every longer one (cut it into
pieces of 16 to 31 words: one piece has the share), and every 13 words of which
11 agree. The tests count this through for all patterns.

Words are runs of non-space characters with A-Z lower-cased. Hits are taken in
bounded portions. Defined results: items with fewer than
``least`` words (5) and null or empty texts contaminate nothing; repeated
rows are reported as often as they occur; a null id is reported as null;
empty tables give no rows; extra columns are ignored by ``find`` and kept by
``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import materialize, read_table
from .textvec import Words, combine, parts

#: The first four meet every 13 words of which 11 agree; all of them every 16 to 31 words of which the share agrees.
MASKS = ("111111", "1101011", "11100111", "101101101", "111011", "1001111", "10110011", "1010001011", "1100101001")
#: Meet every 5 to 15 words of which the share agrees.
SHORT = ("1111", "11101", "11011", "10111", "1100011")
LONG = 16
WINDOW, AGREE, SHARE, LEAST = 13, 11, 0.7, 5
BLOCK_BYTES = 8 << 20
#: Hits, and words compared along them, that are held at a time.
HELD = 1 << 20
_FILTER = 20
#: Stands for no window; taken as unknown should a hash be equal.
_NONE = np.uint64(2**64 - 1)


class Index:
    """All masked windows of some benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()), lower=True)
        self.ids, self.hash, self.first, self.size = ids, words.hash, words.first, words.counts()
        self.seeds = []
        for masks, lo, hi in ((SHORT, LEAST, LONG), (MASKS, LONG, np.inf)):
            for mask in masks:
                picks = tuple(k for k, c in enumerate(mask) if c == "1")
                h, before = combine(words.hash, words.first, picks)
                item = np.repeat(np.arange(len(ids)), np.diff(before))
                at = np.arange(len(h)) - before[item]
                ok = (self.size[item] >= lo) & (self.size[item] < hi)
                h, item, at = h[ok], item[ok], at[ok]
                known = np.unique(h)
                code = self._code(known, h, np.where(at > 0, np.roll(h, 1), _NONE))
                order = np.argsort(code, kind="stable")
                seen = np.zeros(1 << _FILTER, bool)
                seen[(h >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
                if len(h):
                    self.seeds.append((picks, seen, known, code[order], item[order], at[order]))

    @staticmethod
    def _code(known: np.ndarray, h: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """Place of ``h`` among the known hashes, then that of the window before it (last: none, or not known)."""
        rank = np.searchsorted(known, prev)
        rank[(rank < len(known)) & (known[np.minimum(rank, len(known) - 1)] != prev)] = len(known)
        return np.searchsorted(known, h) * (len(known) + 1) + rank

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, shift) with an equal masked window, the first of each run of them, distinct within each portion; shift = place in the text less place in the item."""
        found, held = [], 0
        for picks, seen, known, code, item, at in self.seeds:
            mine, before = combine(words.hash, words.first, picks)
            some = np.flatnonzero(seen[(mine >> np.uint64(64 - _FILTER)).astype(np.int64)])
            some = some[known[np.minimum(np.searchsorted(known, mine[some]), len(known) - 1)] == mine[some]]
            row = np.searchsorted(before, some, "right") - 1
            place = some - before[row]
            own = self._code(known, mine[some], np.where(place > 0, mine[some - (place > 0)], _NONE))
            group = own // (len(known) + 1) * (len(known) + 1)
            # all windows of the hash, but for those that follow the same window
            lo, hi = np.searchsorted(code, group), np.searchsorted(code, group + len(known), "right")
            cut = own - group < len(known)
            mid = np.where(cut, np.searchsorted(code, own, "left"), hi), np.where(cut, np.searchsorted(code, own, "right"), hi)
            row, place = np.repeat(row, 2), np.repeat(place, 2)
            lo, n = np.stack((lo, mid[1]), axis=1).ravel(), np.stack((mid[0] - lo, hi - mid[1]), axis=1).ravel()
            row, place, lo, n = row[n > 0], place[n > 0], lo[n > 0], n[n > 0]
            for s in _portions(n):
                k = _ranges(lo[s], n[s])
                found.append(np.stack((np.repeat(row[s], n[s]), item[k], np.repeat(place[s], n[s]) - at[k])))
                held += len(k)
                if held >= HELD:
                    yield _distinct(found)
                    found, held = [], 0
        if found:
            yield _distinct(found)

    def judge(self, text: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words that agree, words of the item, place of the overlap) for each contaminated pair, on its best alignment."""
        words = Words(text, lower=True)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, shift in self.hits(words):
            size, length = self.size[item], words.counts()[row]
            lo = np.maximum(0, -shift)
            n = np.minimum(size, length - shift) - lo
            theirs, mine = words.first[row] + shift + lo, self.first[item] + lo
            for s in _portions(n):
                equal = words.hash[_ranges(theirs[s], n[s])] == self.hash[_ranges(mine[s], n[s])]
                c = np.concatenate(([0], np.cumsum(equal)))
                end = np.cumsum(n[s])
                agree = c[end] - c[end - n[s]]
                ok = agree >= SHARE * size[s]
                for k in np.flatnonzero(~ok & (agree >= AGREE) & (n[s] >= WINDOW)):
                    part = c[end[k] - n[s][k] : end[k] + 1]
                    ok[k] = (part[WINDOW:] - part[:-WINDOW]).max() >= AGREE
                for k in np.flatnonzero(ok):
                    key = int(row[s][k]), int(item[s][k])
                    got = int(agree[k]), -int(shift[s][k]), int(shift[s][k] + lo[s][k])
                    best[key] = max(best.get(key, got), got)
        return [(*k, best[k][0], int(self.size[k[1]]), best[k][2]) for k in sorted(best)]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from ``start`` on, ``n`` of each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _portions(n: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose sizes ``n`` sum to about ``HELD``, at least a row each."""
    total, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(total, HELD + (total[begin - 1] if begin else 0), "right")))
        yield slice(begin, end)
        begin = end


def _distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, item, shift = np.concatenate(found, axis=1)
    order = np.lexsort((shift, item, row))
    row, item, shift = row[order], item[order], shift[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
    return row[fresh], item[fresh], shift[fresh]


def n_blocks(bench: DataFrame, block_bytes: int) -> int:
    """Into how many blocks of about half ``block_bytes`` the benchmark's texts go."""
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-2 * total // block_bytes))


def blocks(bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark's index, one bounded block after the other."""
    n = n_blocks(bench, block_bytes)
    bench = bench.filter("text is not null").select("item_id", "text")
    for k in range(n):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows])


def _hits(texts: DataFrame, bench: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each contaminated row of ``texts`` (a key and ``text``) and item. With more than one block each block's hits are written and its broadcast is destroyed, so the driver holds one."""
    spark, key = texts.sparkSession, texts.columns[0]
    names = [key, "item_id", "n_match", "n_item", "at_word"]
    schema = StructType([StructField(key, texts.schema[key].dataType), *[StructField(c, LongType()) for c in names[1:]]])
    out, many = None, n_blocks(bench, block_bytes) > 1
    for index in blocks(bench, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in parts(batch):
                    if got := shared.value.judge(part.column("text")):
                        row, item, match, size, at = zip(*got)
                        yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array([shared.value.ids[i] for i in item], pa.int64()), *[pa.array(x, pa.int64()) for x in (match, size, at)]], names)

        got = texts.mapInArrow(run, schema)
        if many:
            got = materialize(got, "hits")
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def find(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each contaminated document and benchmark item: ``doc_id``, ``item_id``, ``n_match``, ``n_item``, ``at_word``."""
    return _hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bench, block_bytes)


def remove(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns.

    Against one block documents are filtered as they stream. Beyond it, the SHA-256 of contaminated texts are
    gathered block by block and an anti-join takes their documents away.
    """
    if n_blocks(bench, block_bytes) > 1:
        sha = "_sha256"
        while sha in docs.columns:
            sha += "_"
        keyed = docs.withColumn(sha, F.sha2("text", 256))
        hits = materialize(_hits(keyed.filter("text is not null").select(sha, "text"), bench, block_bytes).select(sha).distinct(), "contaminated")
        return keyed.join(hits, sha, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    for index in blocks(bench, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for part in parts(batch.select(["text"])):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in shared.value.judge(part.column("text"))]] = False
                    yield batch.slice(done, part.num_rows).filter(pa.array(clean))
                    done += part.num_rows

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
SQL: dict[str, str] = {}
