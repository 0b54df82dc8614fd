"""N-gram Jaccard self-join by parity sketches (operator 10).

A document's set holds its distinct ``width``-word shingles (A-Z lower-cased);
two documents link when ``100 * |A & B| >= percent * |A | B|``. Nothing is
sampled or capped: every link between different sets is found, and components
of links are returned.

How it works:

* Equal sets form one class; only classes take part in the join.
* Sketch. For a size band all sets are dealt by token hash into the same ``S``
  segments, and each segment keeps the XOR of its tokens' hashes. A token of
  the symmetric difference changes one segment, so the number of differing
  segments is at most ``|A ^ B|``, which a link bounds by
  ``d = (|A| + |B|) * (100 - percent) / (100 + percent)``.
* Pigeonhole. With at most ``d`` differing segments, the first ``d + 1``
  segments of both sets under one common order share an equal one. The order
  puts segments with a token outside the frequent-shingle list first, then
  those with more tokens; it decides the cost, never the result, and empty
  segments come last.
* Bands are powers of 4. A set whose partners may lie in the next band also
  files under that band, so that both meet there.
* A parity sketch of about two bits a token (each token flips one bit) prunes
  candidates: its Hamming distance is a lower bound of ``|A ^ B|``.
* Candidates are verified on the whole sets. In a bucket each class is first
  compared with one pivot only, so that a large group of near copies costs a
  star, not all pairs; then, for ``STARS`` rounds, with a few pivots of other
  components. In the last round the classes of a bucket that are still in
  different components meet: in a small bucket all of them, in a crowded one
  those outside its largest component meet all others, and the bound of a sketch
  of fixed length is part of the join. So a large group of copies with some
  outsiders costs its size times the outsiders, and only pairs that may link
  become rows. A crowded bucket is dealt in salted portions of ``PORTION`` rows,
  of pivots and outsiders each gets a copy.

A bucket of k classes that don't link still takes k * k / 2 comparisons of two
fixed sketches, spread over k / ``PORTION`` tasks.

Defined results: text null, empty or without words: ``n_shingles`` 0 and
``component_id`` its own ``doc_id``; fewer words than ``width``: the whole
sequence is the only shingle; repeated rows are returned as often as they
occur; a null ``doc_id`` is kept, and never becomes a component's id unless
every id in the component is null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .shared import WORD, discard, materialize, read_table
from .textvec import Words, combine, mix, parts

PERCENT = 75
WIDTH = 5
#: Frequent shingles kept to order segments: 8 bytes each, so the broadcast stays under 0.2 MB.
FREQUENT = 20_000
#: Rounds in which a class meets a pivot in each of its buckets; buckets choose among PIVOTS of them.
STARS, PIVOTS = 2, 4
#: Buckets of at most so many classes give all their pairs in the last round, so pairs stay in proportion to rows; larger ones only those that pass the fixed sketch. It decides the cost, never the result.
SMALL = 16
FIXED_BITS = 1024
#: Rows of a crowded bucket in one portion.
PORTION = 512
#: Tokens (or pairs) held by a task before it counts (or merges) them.
COUNTED = 1_000_000


def shingle_sets(text: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(text, lower=True)
    h, before = combine(words.hash, words.first, tuple(range(width)))
    counts = words.counts()
    for i, n in enumerate(counts):
        if n >= width:
            yield np.unique(h[before[i] : before[i + 1]])
        elif n:
            at = words.first[i]
            yield combine(words.hash[at : at + n], np.array([0, n]), tuple(range(n)))[0] ^ np.uint64(n)
        else:
            yield np.empty(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """One 64-bit id for a whole set."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(mix(tokens)) if len(tokens) else np.uint64(0)
        s = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([x * np.uint64(3) + s + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def parity(tokens: np.ndarray) -> bytes:
    """A sketch of about two bits a token; each bit is the parity of the number of tokens that hash to it."""
    m = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fixed_parity(tokens: np.ndarray) -> np.ndarray:
    """A parity sketch of ``FIXED_BITS`` bits, as longs."""
    bits = np.bincount((tokens & np.uint64(FIXED_BITS - 1)).astype(np.int64), minlength=FIXED_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two parity sketches; the longer one is folded, which keeps it a parity sketch."""
    while len(x) != len(y):
        if len(x) > len(y):
            x, y = y, x
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def band(n: int) -> int:
    return (n.bit_length() - 1) // 2


def segment_keys(tokens: np.ndarray, level: int, most: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of the first ``most + 1`` of this band's segments, in the order common to all sets."""
    bits = max(6, 2 * level + 1)
    seg = tokens >> np.uint64(64 - bits)  # sorted, as tokens are
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    count = np.diff(np.append(starts, len(seg)))
    value = np.bitwise_xor.reduceat(mix(tokens), starts)
    rare = np.ones(len(tokens), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        rare = frequent[at] != tokens
    common = ~np.logical_or.reduceat(rare, starts)
    with np.errstate(over="ignore"):
        salt = np.uint64((level + 1) * 0x9FB21C651E98DF25 % 2**64)
        key = mix(value ^ mix(seg[starts] + salt))
        if len(key) > most + 1:
            key = key[np.lexsort((key, -count, common))[: most + 1]]
        elif len(key) < most + 1:  # empty segments, in the order of their numbers
            empty = np.setdiff1d(np.arange(min(1 << bits, 2 * (most + 1)), dtype=np.uint64), seg[starts])
            key = np.concatenate((key, mix(mix(empty[: most + 1 - len(key)] + salt) + np.uint64(1))))
    return key


def file_keys(tokens: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    n = len(tokens)
    own, limit = band(n), 4 ** (band(n) + 1)
    largest = n * 100 // percent
    gap = lambda m: (n + m) * (100 - percent) // (100 + percent)
    keys = segment_keys(tokens, own, gap(min(largest, limit - 1)), frequent)
    if largest >= limit:
        keys = np.concatenate((keys, segment_keys(tokens, own + 1, gap(largest), frequent)))
    return keys


def text_key():
    """Hash of a row's text: with ``doc_id`` it tells rows apart where ids are null or repeated."""
    return F.xxhash64("text")


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each document (``doc_id``, ``key`` its text's hash, ``n``, ``cls``, ``sketch``), and rows of locally frequent shingles (``n`` null: ``cls`` shingle, ``doc_id`` count)."""

    def frequent(seen: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(seen), return_counts=True)
        keep = np.flatnonzero(count >= max(3, len(seen) // 1000))
        keep = keep[np.argsort(-count[keep], kind="stable")[:FREQUENT]]
        return _rows(pa.array(count[keep], pa.int64()), pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.int32()), value[keep].view(np.int64), pa.nulls(len(keep), pa.binary()), pa.nulls(len(keep), pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for part in parts(batch):
                sets = list(shingle_sets(part.column("text"), width))
                ids = [set_id(s) for s in sets]
                yield _rows(part.column("doc_id"), part.column("key"), [len(s) for s in sets], ids, [parity(s) for s in sets], [fixed_parity(s) for s in sets])
                seen.update((c, s) for c, s in zip(ids, sets) if len(s))
                held += sum(map(len, sets))
                if held > COUNTED:
                    yield frequent(list(seen.values()))
                    seen, held = {}, 0
        if seen:
            yield frequent(list(seen.values()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).mapInArrow(run, "doc_id long, key long, n int, cls long, sketch binary, bits array<long>")


def _rows(doc_id, key, n, cls, sketch, bits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, key, pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "key", "n", "cls", "sketch", "bits"])


def live_buckets(docs: DataFrame, frequent: np.ndarray, percent: int, width: int) -> DataFrame:
    """Each class of a bucket with the bucket's pivot, its smallest class, as (x, y, ``pair`` true); and (x bucket, y class, ``pair`` false, n, size) of buckets with three classes or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()  # equal sets of one batch file once
            for part in parts(batch):
                keys, ids, sizes = [], [], []
                for s in shingle_sets(part.column("text"), width):
                    if len(s) and (c := set_id(s)) not in done:
                        done.add(c)
                        keys.append(k := file_keys(s, percent, frequent))
                        ids.append(np.full(len(k), c, np.int64))
                        sizes.append(np.full(len(k), len(s), np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))], ["bucket", "cls", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches if b.num_rows]
        if not got:
            return
        key, cls, n = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        key, cls, n = key[twin], cls[order[twin]], n[order[twin]]
        order = np.lexsort((cls, n, key))
        key, cls, n = key[order], cls[order], n[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, n = key[fresh], cls[fresh], n[fresh]
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(starts, len(key)))
        many, first = np.repeat(size > 1, size), np.repeat(starts, size)
        star = many & (first != np.arange(len(key))) & (n[first].astype(np.int64) * 100 >= n.astype(np.int64) * percent)
        pairs = _distinct(np.stack((cls[first[star]], cls[star]), axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(np.ones(len(pairs), bool)), pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int64())], ["x", "y", "pair", "n", "size"])
        more = np.repeat(size > 2, size)  # the pivot's pair is all that a bucket of two has
        yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(cls[more]), pa.array(np.zeros(more.sum(), bool)), pa.array(n[more]), pa.array(np.repeat(size, size)[more])], ["x", "y", "pair", "n", "size"])

    return docs.select("text").mapInArrow(emit, "bucket long, cls long, n int").repartition("bucket").mapInArrow(meet, "x long, y long, pair boolean, n int, size long")


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[fresh]


def prune(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Drop pairs that cannot link: by the ratio of sizes, and by the parity sketches' lower bound of ``|A ^ B|``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = ((batch.column("na").to_numpy() + batch.column("nb").to_numpy()).astype(np.int64) * (100 - percent)) // (100 + percent)
            sa, sb = batch.column("sa"), batch.column("sb")
            ok = np.array([hamming(np.frombuffer(sa[i].as_buffer(), np.uint8), np.frombuffer(sb[i].as_buffer(), np.uint8)) <= most[i] for i in range(batch.num_rows)], bool)
            yield batch.select([0, 1]).filter(pa.array(ok))

    left = info.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = info.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb").cast("long") * 100 >= F.greatest("na", "nb").cast("long") * percent)
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))

    held = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def class_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """Whole sets of the classes in ``reps`` (cls, doc_id and key of a member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                sets = list(shingle_sets(part.column("text"), width))
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["want", "cls", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).alias("d")
    texts = texts.join(reps.select("doc_id", "key", "cls").alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key")))
    found = texts.select("cls", "text").mapInArrow(run, "want long, cls long, tokens binary")
    return found.filter("want = cls").select("cls", "tokens").dropDuplicates(["cls"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): smallest label in reach, by label passing with pointer jumping; a written table after each round."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("other"))
        step = label.join(near, label.node == near.a).select("node", "comp", F.least("comp", "other").alias("next"))
        up = label.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        step = step.join(up, "next", "left").select("node", F.least("next", "jump").alias("comp"), (F.least("next", "jump") != F.col("comp")).alias("moved"))
        step = materialize(step, "labels")
        moved = step.filter("moved").limit(1).count()
        discard(label)
        label = step
        if not moved:
            discard(both)
            return label.select("node", "comp")


def _sizes_fit(percent: int):
    return F.least("x.n", "y.n").cast("long") * 100 >= F.greatest("x.n", "y.n").cast("long") * percent


def _portions(size) -> Column:
    return F.ceil(size / PORTION).cast("int")


def _salt() -> Column:
    return F.pmod(F.xxhash64("cls"), _portions(F.col("size"))).cast("int")


def _for_each_portion(buckets: DataFrame) -> DataFrame:
    """One row a bucket (with ``size``) becomes one a portion of it (``salt``)."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), _portions(F.col("size")) - 1))).drop("size")


def _mixed(live: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows (bucket, salt, cls, n, size, comp) of buckets whose classes are not all in one component."""
    at = live.withColumn("comp", F.col("cls"))
    if label is not None:
        at = live.join(label, live.cls == label.node, "left").select("bucket", "cls", "n", "size", F.coalesce("comp", "cls").alias("comp"))
    at = at.withColumn("salt", _salt())
    split = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("size").alias("size")).filter("lo < hi").select("bucket", "size")
    return materialize(at.join(_for_each_portion(split), ["bucket", "salt"], "left_semi"), "mixed")


def _bound(percent: int):
    """The fixed parity sketches' lower bound of ``|A ^ B|`` allows a link."""
    far = F.lit(0)
    for k in range(FIXED_BITS // 64):
        far = far + F.bit_count(F.get("x.bits", F.lit(k)).bitwiseXOR(F.get("y.bits", F.lit(k))))
    return far * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def _every_pair(mixed: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a bucket and may link."""
    apart = (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp"))
    few = mixed.filter(F.col("size") <= SMALL)
    small = few.alias("x").join(few.alias("y"), "bucket").filter(apart & _sizes_fit(percent))

    many = mixed.filter(F.col("size") > SMALL)
    by = many.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.first("size").alias("size"))
    main = by.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.first("size").alias("size"))
    many = many.join(_for_each_portion(main), ["bucket", "salt"]).join(info.select("cls", "bits"), "cls")
    outside = _for_each_portion(many.filter("comp != main").drop("salt"))
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.comp") != F.col("y.comp")) & once & _sizes_fit(percent) & _bound(percent)
    large = outside.alias("x").join(many.alias("y"), on)
    cols = [F.struct("x.cls", "x.n").alias("x"), F.struct("y.cls", "y.n").alias("y")]
    return small.select(*cols).unionByName(large.select(*cols))


def _tokens(docs: DataFrame, pairs: DataFrame, info: DataFrame, have: DataFrame | None, width: int, held: list[DataFrame]) -> DataFrame:
    """Whole sets of all classes in ``pairs``, added to those at hand; the written table is noted in ``held``."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    if have is not None:
        wanted = wanted.join(have.select("cls"), "cls", "left_anti")
    new = materialize(class_sets(docs, info.join(wanted, "cls").select("cls", "member.doc_id", "member.key"), width), "tokens")
    held.append(new)
    return new if have is None else have.unionByName(new)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for each row of ``docs`` (doc_id, text)."""
    out = _labelled(docs, percent, width)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _labelled(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``doc_id``, ``key``, ``n``, ``comp`` (the component's smallest class) and ``component_id`` (its smallest id) for each row; the last two are null where ``n`` is 0."""
    if not 30 <= percent <= 100:
        raise ValueError("percent must be 30 to 100")
    spark = docs.sparkSession
    table = materialize(set_table(docs, width), "sets")
    top = table.filter("n is null").groupBy("cls").agg(F.sum("doc_id").alias("k")).orderBy(F.desc("k"), "cls").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r.cls for r in top], np.int64).view(np.uint64))
    rows = table.filter("n is not null").select("doc_id", "key", "n", "cls")
    found = table.filter("n > 0").select("doc_id", "key", "n", "cls", "sketch", "bits")
    info = found.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "key")).alias("member"), *[F.first(c).alias(c) for c in ("n", "sketch", "bits")])
    info = materialize(info, "classes")
    done = [info]

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(materialize(df, name))
        return done[-1]

    met = kept(live_buckets(docs, frequent, percent, width), "buckets")
    star = met.filter("pair").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    live = met.filter("not pair").select(F.col("x").alias("bucket"), F.col("y").alias("cls"), "n", "size")
    pairs = kept(prune(star, info, percent), "pairs")
    held: list[DataFrame] = []
    sets = _tokens(docs, pairs, info, None, width, held)
    links = kept(verify(pairs, sets, percent), "links")
    label = None if links.isEmpty() else kept(components(links), "components")

    mixed = _mixed(live, label)
    done.append(mixed)
    for turn in range(STARS + 1):
        last = turn == STARS
        if mixed.isEmpty():
            break
        if last:
            near = _every_pair(mixed, info, percent)
        else:  # each class with a pivot of its bucket, of another component
            pivot = F.min_by(F.struct("cls", "comp", "n"), F.struct("comp", F.xxhash64("cls", F.lit(turn), F.pmod("bucket", F.lit(PIVOTS)))))
            pivots = _for_each_portion(mixed.groupBy("bucket").agg(pivot.alias("p"), F.first("size").alias("size"))).select("bucket", "salt", "p.*")
            near = mixed.alias("x").join(pivots.alias("y"), ["bucket", "salt"]).filter("x.comp != y.comp")
        near = near.filter(_sizes_fit(percent)).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        more = kept(prune(near.join(pairs, ["a", "b"], "left_anti"), info, percent), "pairs")
        if more.isEmpty():
            continue
        sets = _tokens(docs, more, info, sets, width, held)
        new = kept(verify(more, sets, percent), "links")
        pairs, links = pairs.unionByName(more), links.unionByName(new)
        if not new.isEmpty():
            label = kept(components(links), "components")
            if not last:
                mixed = _mixed(mixed.drop("comp", "salt"), label)
                done.append(mixed)

    if label is None:
        named = info.select("cls", F.col("cls").alias("comp"), F.col("doc_id").alias("component_id"))
    else:
        by = info.join(label, info.cls == label.node, "left").select("cls", "doc_id", F.coalesce("comp", "cls").alias("comp"))
        low = by.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        named = by.join(low, "comp").select("cls", "comp", "component_id")
    named = materialize(named, "named")
    discard(*done, *held)
    return rows.join(named, "cls", "left").select("doc_id", "key", "n", "comp", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest id, then of the smallest hash of its text.

    Rows without an id come after all others, so one of them stays only where
    a group has no id at all. Of rows with the same id and text, whatever their
    other columns, one stays. Texts without words link with nothing: they stay, but
    a row with an id is kept once if it is repeated as a whole.
    """
    names = docs.columns
    found = _labelled(docs, percent, width).filter("n > 0")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("top"))
    stays = materialize(first.select(F.col("top.doc_id").alias("_id"), F.col("top.key").alias("_key")).distinct(), "stays")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    empty = docs.filter(wordless)
    empty = empty.filter("doc_id is not null").dropDuplicates().unionByName(empty.filter("doc_id is null"))
    kept = docs.filter(~wordless).alias("d").join(stays, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key")), "left_semi")
    # all but a few stand alone, so only groups of one id and text are aggregated; copies meet in their own tasks first
    again = materialize(found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).count().filter("count > 1").drop("count"), "repeated")
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key"))
        whole = F.struct(*[F.col(f"`{c}`") for c in names])
        rest = kept.join(again, same, "left_semi").select("doc_id", text_key().alias("_key"), whole.alias("_row"), F.xxhash64(*[F.col(f"`{c}`") for c in names if not isinstance(docs.schema[c].dataType, MapType)]).alias("_h"))
        one = rest.groupBy("doc_id", "_key").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
        kept = kept.join(again, same, "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in names]).unionByName(empty)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, a AS r FROM edge
  UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r)
SELECT d.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""
}
