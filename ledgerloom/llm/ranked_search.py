"""Ranked lexical search over a K2-treap of the term-document grid (operator 13).

For each item of a query set the documents of highest score are returned. A
document's score sums ``weight * impact`` over the item's terms, in integers
but for the weights' logarithm, so results are exact.

How it works:

* One pass over the whole texts counts each document's terms and keeps the
  occurrences of the items' own terms (other terms touch lengths only). Texts
  don't move; the kept counts are written as a table, and the collection's
  numbers (documents, terms, documents of each term) are aggregates over it.
* Documents are dealt into ranges, and each range's (term, document) grid is a
  K2-treap: a quadtree of which only cells with points exist, kept as one
  sorted array of (level, Morton code) with the largest impact in each cell.
  Terms are rows in order of how many documents hold them, documents are
  columns in order of their ids. An impact comes from count and length alone.
* An item descends along the paths of all its terms' rows at once. A state is
  a document range: its bound is the sum over the terms of weight times the
  maximum of the cell that holds the term's row and the range. States are
  taken best first, a few an item and a round so that all items of a range
  proceed together; a range whose bound is below the item's tenth score so far
  is dropped, and at the last level the bound is the document's score.
* Each task hands on the best of its ranges, and those are ranked by item.

The items are read in blocks of ``BLOCK_BYTES`` of text, one after the other:
only one block's terms (words of 64-bit hashes and a weight each) are on the
driver and broadcast at a time.

Defined results: a text that is null, empty or without terms is no document
(it counts in no number and is never found); an item without known terms has
no rows; repeated rows of a document are documents of their own, and a null id
stands last among ties; repeated items have results of their own, even under
one id; other columns are ignored; empty tables give no rows. Terms are
compared by 64-bit hashes: for 10^13 words of text and 10^4 terms a chance
equality has a probability of half a per cent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, read_table
from .textvec import Words, parts

TOP = 10
#: Text of the items of one block.
BLOCK_BYTES = 4 << 20
#: Documents of one grid; its arrays hold a few times as many terms.
RANGE = 4096
#: States that an item expands in one round, and items that descend together.
WIDTH, TOGETHER = 24, 128

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(text: pa.Array) -> Words:
    """Maximal runs of ASCII letters and digits and of all other code points from U+0080 on; A-Z in lower case."""
    return Words(text, lower=True, inside=lambda data: _TERM[data])


def _counted(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index in ``known``, occurrences), sorted, of the words among ``known`` (sorted hashes)."""
    if not len(known) or not len(words.hash):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    hit = np.flatnonzero(known[at] == words.hash)
    row = np.searchsorted(words.first, hit, "right") - 1
    both, n = np.unique(row * len(known) + at[hit], return_counts=True)
    return both // len(known), both % len(known), n


def _lists(row: np.ndarray, rows: int, *values: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and the hashes of the distinct terms of each item with any (``terms``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = terms(part.column("text"))
                own = [np.unique(words.hash[a:b]).view(np.int64) for a, b in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(own, pa.list_(pa.int64()))], ["item_id", "terms"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<long>").filter(F.size("terms") > 0)


def occurrences(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats) and, for the terms among ``known``, ``term`` (index) and ``tf``; documents with a term only."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                words = terms(part.column("text"))
                row, term, n = _counted(words, shared.value)
                term, n = _lists(row, part.num_rows, term.astype(np.int32), n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts().astype(np.int64)), term, n], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>").filter("n > 0")


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers with a zero between each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """The maxima of a grid's points on all levels of its quadtree; only cells with points are kept."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.levels = max(1, int(max(row.max(initial=0), column.max(initial=0))).bit_length())
        code = (_spread(row) << np.uint64(1)) | _spread(column)
        order = np.argsort(code)
        code, value = code[order], value[order]
        keys, tops = [code | self._level(self.levels)], [value]
        for level in range(self.levels - 1, -1, -1):  # a cell's four parts stand together
            code = code >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            code, value = code[starts], np.maximum.reduceat(value, starts)
            keys.append(code | self._level(level))
            tops.append(value)
        self.keys, self.tops = np.concatenate(keys[::-1]), np.concatenate(tops[::-1])

    @staticmethod
    def _level(level) -> np.ndarray:
        return np.uint64(level) << np.uint64(58)

    def maxima(self, level: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The largest value in the cell of ``level`` that holds ``row``, at ``column`` of that level; 0 without points."""
        code = (_spread(row >> (self.levels - level)) << np.uint64(1)) | _spread(column) | (level.astype(np.uint64) << np.uint64(58))
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return np.where(self.keys[at] == code, self.tops[at], 0)


@dataclass
class Items:
    """The items of one block: their terms as a run of (index, weight) each."""

    ids: list
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def descend(treap: Treap, items: Items, low: int, high: int, floor: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, column, score) of each item's ``top`` best columns, for the items from ``low`` to ``high``; what is below its ``floor`` may be missing."""
    n = high - low
    size = np.diff(items.first[low : high + 1])
    floor = floor[low:high].copy()
    found = [np.empty(0, np.int64)] * 3

    def bounds(item: np.ndarray, level: np.ndarray, column: np.ndarray) -> np.ndarray:
        many = size[item]
        start = np.cumsum(many) - many
        at = np.repeat(items.first[low:high][item] - start, many) + np.arange(many.sum())
        best = treap.maxima(np.repeat(level, many), items.term[at], np.repeat(column, many))
        return np.add.reduceat(items.weight[at] * best, start) if len(start) else np.empty(0, np.int64)

    item, level, column = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    bound = bounds(item, level, column)
    while len(item):
        keep = (bound >= np.maximum(floor[item], 1))
        item, level, column, bound = item[keep], level[keep], column[keep], bound[keep]
        order = np.lexsort((-level, -bound, item))  # best first, deep ones first among equals
        item, level, column, bound = item[order], level[order], column[order], bound[order]
        first = np.searchsorted(item, item)
        now = np.arange(len(item)) - first < WIDTH
        part = np.repeat(item[now], 2)
        below = np.repeat(level[now], 2) + 1
        child = np.repeat(column[now], 2) * 2 + np.tile([0, 1], now.sum())
        value = bounds(part, below, child)
        some = value >= np.maximum(floor[part], 1)
        part, below, child, value = part[some], below[some], child[some], value[some]
        done = below == treap.levels
        if done.any():
            found = [np.concatenate(x) for x in zip(found, (part[done], child[done], value[done]))]
            order = np.lexsort((found[1], -found[2], found[0]))
            found = [x[order] for x in found]
            rank = np.arange(len(order)) - np.searchsorted(found[0], found[0])
            found = [x[rank < top] for x in found]
            full = np.flatnonzero(rank[rank < top] == top - 1)
            floor[found[0][full]] = np.maximum(floor[found[0][full]], found[2][full])
        item, level, column, bound = (np.concatenate(x) for x in ((item[~now], part[~done]), (level[~now], below[~done]), (column[~now], child[~done]), (bound[~now], value[~done])))
    return found[0] + low, found[1], found[2]


def _search_range(ids: pa.Array, length: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray, items: Items, stats: tuple[int, int], best: np.ndarray, top: int) -> pa.RecordBatch:
    """The best documents of a range for every item, by descent through its treap; raises the items' tenth scores ``best``."""
    docs, total = stats
    column = np.repeat(np.arange(len(length)), count)
    norm = 10 + 90 * length * docs // total
    treap = Treap(term, column, 1_000_000_000 * tf // (1000 * tf + 8 * norm[column]))
    got = [descend(treap, items, k, min(k + TOGETHER, len(items.ids)), best, top) for k in range(0, len(items.ids), TOGETHER)]
    item, at, score = (np.concatenate(x) for x in zip(*got))
    full = np.flatnonzero(np.bincount(item, minlength=len(items.ids)) == top)
    last = np.searchsorted(item, full, "right") - 1
    best[full] = np.maximum(best[full], score[last])
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(at)), pa.array(score)], ["item", "doc_id", "score"])


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items, one bounded block after the other."""
    total = items.agg(F.coalesce(F.sum(F.size("terms") * 8), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)) == k).orderBy("item_id", "terms").collect()
        if rows:
            yield rows


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    asked = materialize(item_terms(items), "items")
    out = None
    for rows in _blocks(asked, block_bytes):
        got = _search_block(docs, rows, top)
        out = got if out is None else out.unionByName(got)
    discard(asked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """Results of one block of items, written; what it had on the driver and broadcast is given free."""
    spark = docs.sparkSession
    mine = [np.array(r.terms, np.int64).view(np.uint64) for r in rows]
    known = np.unique(np.concatenate(mine))
    kept = materialize(occurrences(docs, known), "occurrences")
    stats = kept.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    df = np.zeros(len(known), np.int64)
    for r in kept.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # terms of the block at most
        df[r.term] = r["count"]
    weight = np.floor(1000 * np.log((2 * stats.docs + 2) / (2 * df + 1))).astype(np.int64)
    place = np.empty(len(known), np.int64)  # rows of the grid: rare terms first
    place[np.argsort(df, kind="stable")] = np.arange(len(known))
    at = [np.searchsorted(known, m) for m in mine]
    flat = np.concatenate(at)
    shared = spark.sparkContext.broadcast((Items([r.item_id for r in rows], np.concatenate(([0], np.cumsum([len(a) for a in at]))), place[flat], weight[flat]), place, (stats.docs, stats.total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, place, numbers = shared.value
        best = np.zeros(len(items.ids), np.int64)
        for batch in _ranges(batches):
            term, tf = batch.column("term"), batch.column("tf")
            flat = term.flatten().to_numpy()
            if len(flat):
                count = np.diff(term.offsets.to_numpy())
                yield _search_range(batch.column("doc_id"), batch.column("n").to_numpy(), count, place[flat], tf.flatten().to_numpy(), items, numbers, best, top)

    ranges = max(1, -(-stats.docs // RANGE))
    some = kept.filter(F.size("term") > 0)  # the others score nothing
    dealt = some.repartitionByRange(ranges, F.col("doc_id"), F.xxhash64("n", "term")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "n", "term", "tf")
    found = dealt.mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id long")
    out = materialize(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    shared.destroy()
    discard(kept)
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``RANGE`` rows; larger ones are cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for k in range(0, batch.num_rows, RANGE):
            part = batch.slice(k, RANGE)
            if held and sum(b.num_rows for b in held) + part.num_rows > RANGE:
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
SQL = {
    "op13_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
o AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM o GROUP BY ALL),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM b JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
}
