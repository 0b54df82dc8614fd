"""Grouping of spelling variants by pivotal grams (operator 11).

Words are the maximal runs of letters of all whole texts (only A-Z is
lower-cased); two are near if one inserted, deleted or replaced code point
tells them apart. A word's form is its near word of largest count, if that is
``ratio`` times its own or more; roots follow forms to the last one.

How near pairs are found, all of them, without comparing all words:

* Bigrams are ordered by how many words hold them, rarest first. A word's
  prefix holds its three rarest bigrams (and further ones equal to the third).
* One edit destroys at most one of two disjoint bigrams. Of the prefix two
  disjoint bigrams of least cost are chosen by dynamic programming: the pivots.
  Of two near words, the one whose third bigram comes no later in the order has
  a pivot that stands in the other's prefix (the survivor is no later than the
  other's third).
* Position limits: the edit lies to the right of the shared bigram, and all up
  to it is equal and in its place, or to the left, and all from it on is equal
  and moved by the difference in length. So an index entry is the length of
  the word and the part of it up to, or from, a prefix bigram; a pivot looks
  up six entries (three lengths, two sides). Only pairs with such a side in
  common meet, and most of them are near.
* A parity mask of code points is part of the join: one edit changes two bits
  at most. What is left is verified by its edit distance.

Counting merges within tasks before the shuffle, so a word that makes up a
third of all text costs a row a task. Bigrams are at most the square of the
alphabet (90 letters: 8 100), which bounds what the driver collects. Forms rise
``ratio`` times a step, so chains are short, and pointer jumping follows them
in a few rounds.

Defined results: a null or empty text has no words; a null ``doc_id`` counts
as an empty one in the check sum that decides deletions; rows repeated count
each; an empty table gives no rows; other columns are ignored; a run of any
length is taken whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, read_table
from .textvec import Words, parts

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: A run of a document whose check sum this divides loses one code point.
DAMAGE = 199
#: Words that a task holds before it hands on their counts.
HELD = 400_000
#: Spans up to so many bytes are summed column by column; longer ones each on its own.
LONG = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _PRIME = 1_000_003, 2**61 - 1
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and what follows it)."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, carried on from ``seed``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    crc, at, left = ~seed[order], start[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -j, "left"))  # those longer than j
        crc[:k] = _CRC[(crc[:k] ^ data[at[:k] + j]) & 0xFF] ^ (crc[:k] >> 8)
    out = np.empty(len(start), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(seed[i]))
    return out


def _slice_counts(text: pa.Array, ids: list, least: int, damage: int) -> Iterator[tuple[bytes, int]]:
    """Words of at least ``least`` code points with their counts; a word may come more than once."""
    words = Words(text, lower=True, inside=letters)
    data = _LOWER[words.data]
    pairs = np.concatenate(([0], np.cumsum(data == 0xC3)))
    length = words.end - words.start - (pairs[words.end] - pairs[words.start])
    keep = length >= least
    start, end, hashes, length = words.start[keep], words.end[keep], words.hash[keep], length[keep]
    if not len(start):
        return
    row = np.searchsorted(words.offsets, start, "right") - 1
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc32_spans(data, start, end, seeds[row])
    raw = data.tobytes()
    hurt = h % damage == 0
    for i in np.flatnonzero(hurt):
        if length[i] > least:
            word = raw[start[i] : end[i]].decode()
            cut = int(h[i]) % len(word)
            yield (word[:cut] + word[cut + 1 :]).encode(), 1
    whole = np.flatnonzero(~hurt)
    _, first, n = np.unique(hashes[whole], return_index=True, return_counts=True)
    first = whole[first]
    for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
        yield raw[a:b], k


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """``word``, ``n``: words of the damaged texts with at least ``least_length`` code points and ``least_count`` occurrences."""

    def table(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for part in parts(batch):
                for word, k in _slice_counts(part.column("text"), part.column("doc_id").to_pylist(), least_length, damage):
                    held[word] = held.get(word, 0) + k
                if len(held) >= HELD:
                    yield table(held)
                    held = {}
        yield table(held)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, k long")
    return found.groupBy("word").agg(F.sum("k").alias("n")).filter(F.col("n") >= least_count)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Each bigram's place in the order and the words that hold it: at most the square of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                held.update({x + y for x, y in zip(word, word[1:])})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "k"])

    rows = words.select("word").mapInArrow(run, "gram string, k long").groupBy("gram").agg(F.sum("k").alias("k")).collect()
    return {r.gram: (i, r.k) for i, r in enumerate(sorted(rows, key=lambda r: (r.k, r.gram)))}


def pivots(places: list[int], cost: list[int]) -> tuple[int, int]:
    """The two disjoint bigrams of least total cost among ``places`` (ascending): best single one up to each place, then best pair."""
    alone, both, done = None, None, 0
    for k, place in enumerate(places):
        while places[done] <= place - 2:  # now disjoint from this one
            alone = min(alone or (cost[done], places[done]), (cost[done], places[done]))
            done += 1
        if alone:
            pair = alone[0] + cost[k], alone[1], place
            both = min(both or pair, pair)
    return both[1], both[2]


def signature(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], tuple[int, int], int, int]:
    """Prefix places, pivots, the third bigram's place in the order, and the parity mask of a word of 4 code points or more."""
    rank = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(r[0] for r in rank)[2]
    prefix = [i for i, r in enumerate(rank) if r[0] <= last]
    mask = 0
    for c in word:
        mask ^= 1 << (ord(c) & 63)
    return prefix, pivots(prefix, [rank[i][1] for i in prefix]), last, mask - (1 << 64) if mask >> 63 else mask


def side_keys(word: str, places: list[int], lengths: tuple[int, ...]) -> list[int]:
    """For each length of the other word, keys of the parts up to, and from, the bigram at each place; linear in the word's length."""
    run = [0]
    for c in word:
        run.append((run[-1] * _BASE + ord(c)) % _PRIME)
    n, parts_of = len(word), []
    for p in places:
        parts_of.append(run[p + 2] * 2 % _PRIME)
        parts_of.append((((run[n] - run[p] * pow(_BASE, n - p, _PRIME)) * 2 + 1) * _BASE + n - p) % _PRIME)
    return [(part * _BASE + m) * _BASE % _PRIME for m in lengths for part in parts_of]


def _entries(words: DataFrame, ranks: dict[str, tuple[int, int]], asking: bool) -> DataFrame:
    """Rows (key, id, last, mask): lookups of the pivots, or index entries of the prefix."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, count, last, mask = [], [], [], []
            for word in batch.column("word").to_pylist():
                prefix, two, third, bits = signature(word, shared.value)
                n = len(word)
                mine = side_keys(word, list(two), (n - 1, n, n + 1)) if asking else side_keys(word, prefix, (n,))
                key += mine
                count.append(len(mine))
                last.append(third)
                mask.append(bits)
            columns = [batch.column("id").to_numpy(), np.array(last, np.int32), np.array(mask, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(np.repeat(c, count)) for c in columns]], ["key", "id", "last", "mask"])

    return words.select("word", "id").mapInArrow(run, "key long, id long, last int, mask long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) in both orders: all pairs of words (``word``, ``n``, ``id``; distinct, 4 code points or more) that one edit tells apart."""
    ranks = gram_ranks(words)
    p, e = _entries(words, ranks, True).alias("p"), _entries(words, ranks, False).alias("e")
    on = (F.col("p.key") == F.col("e.key")) & (F.col("p.last") <= F.col("e.last")) & (F.col("p.id") != F.col("e.id")) & (F.bit_count(F.col("p.mask").bitwiseXOR(F.col("e.mask"))) <= 2)
    met = p.join(e, on).select(F.least("p.id", "e.id").alias("x"), F.greatest("p.id", "e.id").alias("y")).distinct()
    one = words.select(F.col("id").alias("x"), F.col("word").alias("a"), F.col("n").alias("na"))
    two = words.select(F.col("id").alias("y"), F.col("word").alias("b"), F.col("n").alias("nb"))
    pairs = met.join(one, "x").join(two, "y").filter(F.levenshtein("a", "b", 1) == 1)
    turned = F.array(F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    return pairs.select(F.inline(turned))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last form that a chain of them reaches. Pointer jumping doubles each word's reach a round."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("jump"))
        step = materialize(at.join(up, "root", "left").select("word", F.coalesce("jump", "root").alias("root"), F.col("jump").isNotNull().alias("moved")), "roots")
        discard(at)
        at = step
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int = DAMAGE) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for each word of ``docs`` (doc_id, text)."""
    if least_length < 4 or ratio < 2:
        raise ValueError("words need 4 code points or more, and ratio 2 or more")
    words = materialize(word_counts(docs, least_length, least_count, damage).withColumn("id", F.monotonically_increasing_id()), "words")
    best = near_pairs(words).groupBy(F.col("a").alias("word"), F.col("na").alias("n")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("k"), F.col("b").alias("form"))).alias("best"))
    large = -F.col("best.k") >= ratio * F.col("n")
    near = materialize(best.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.k")).alias("form_n")), "forms")
    out = words.join(near, "word", "left").join(roots(near.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL = {
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, r, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
h AS (
  SELECT r, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM runs, crc),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM h),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word AS a, y.word AS b, y.n AS nb FROM cut x JOIN cut y ON x.i = y.i AND x.s = y.s AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.s = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.s = y.word),
best AS (SELECT a, b, nb, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY nb DESC, b) AS rn FROM near),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 5 * n THEN b END AS form, CASE WHEN nb >= 5 * n THEN nb END AS form_n FROM words LEFT JOIN best ON a = word AND rn = 1),
up AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(u.root, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word) u USING (word)
"""
}
