"""Approximate nearest neighbours by a forest of random-projection trees (operator 12).

For each query the rows of largest cosine are returned, with scores in double
precision on the original vectors.

How it works:

* Equal vectors are one class, which keeps its smallest ids; so a vector that
  a third of all rows share is searched, and found, once.
* Forest. In each tree a node splits on a random direction (one a level, the
  directions of a tree orthonormal) at the median of a bounded sample of at
  most ``SAMPLE_FLOATS`` numbers, down to leaves that hold ``LEAF`` rows of the
  whole table in the mean, or a single one of the sample. The model is a few
  thresholds and directions; every class is then filed in every tree.
* Search. A query's queue holds nodes of all trees. Since directions are
  orthonormal, the squares of the margins on the far sides of a path add up to
  a lower bound of the distance to a node's cell: the nearest cell is opened
  first, whatever tree it is of. How many are opened is measured, not guessed:
  so many that of the sample's own neighbours, known by brute force for some of
  its rows, a share of ``RECALL`` is found. Vectors without any structure need
  a good part of all leaves, those with some need few.
* A query brings along what the sixth best of the sample's rows in its opened
  leaves scores (for five neighbours): rows below that can't be among the best.
* Classes and queries meet by (tree, leaf). A leaf of more than ``PORTION``
  classes is dealt in portions; each task compares one portion's vectors with
  its queries in a matrix product and hands on the best. Scores of what may be
  among the best are computed again, one pair at a time and always in the same
  order, so they don't depend on portions or batches.

The search is exact where the opened leaves hold the whole table.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, nor do rows without an id, nor vectors
whose length isn't the commonest one (ties: the shorter one); an id never
finds itself; rows of one id are one, and of several vectors under one id that
of the smallest hash counts; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, read_table

TOP = 5
EVERY = 50
TREES = 10
LEAF = 128
#: Share of the sample's neighbours that the opened leaves hold, and rows of the sample that it is measured on.
RECALL = 0.97
MEASURED = 200
#: The sample that trees are fitted on: numbers, and rows.
SAMPLE_FLOATS, SAMPLE_ROWS = 2_000_000, 30_000
PORTION = 2048
SEED = 29
#: More than the rounding of a product of unit vectors.
ROUNDING = 1e-9
#: Queries compared with the sample at once.
ASKED = 256


class Forest:
    """Directions, and medians of the nodes, of all trees; nodes are numbered as in a heap (children of i: 2i + 1 and 2i + 2)."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.sample = sample
        n, dim = sample.shape
        wanted = max(0, int(np.ceil(np.log2(max(1, rows / leaf)))))
        self.depth = min(wanted, max(0, n.bit_length() - 1), dim)
        self.directions = np.stack([np.linalg.qr(rng.standard_normal((dim, max(1, self.depth))))[0].T for _ in range(trees)])
        self.medians = np.zeros((trees, 2**self.depth - 1))
        for tree in range(trees):
            shown = sample @ self.directions[tree].T
            groups = [np.arange(n)]
            for level in range(self.depth):
                below = []
                for k, rows_of in enumerate(groups):
                    value = shown[rows_of, level]
                    cut = np.median(value) if len(value) else 0.0
                    self.medians[tree, 2**level - 1 + k] = cut
                    below += [rows_of[value < cut], rows_of[value >= cut]]
                groups = below
        self.home = self.leaves(sample)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (tree, row)."""
        out = np.zeros((len(self.directions), len(vectors)), np.int32)
        for tree, directions in enumerate(self.directions):
            shown = vectors @ directions.T
            node = np.zeros(len(vectors), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (shown[:, level] >= self.medians[tree, node])
            out[tree] = node - (2**self.depth - 1)
        return out

    def nearest_leaves(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """All (tree, leaf), nearest cells first, out of one queue for all trees."""
        shown = (self.directions @ vector).tolist()
        queue = [(0.0, tree, 0, 0) for tree in range(len(shown))]
        first = 2**self.depth - 1
        while queue:
            far, tree, node, level = heapq.heappop(queue)
            values, medians = shown[tree], self.medians[tree]
            while level < self.depth:
                margin = values[level] - medians[node]
                level += 1
                near = 2 * node + (2 if margin >= 0 else 1)
                heapq.heappush(queue, (far + margin * margin, tree, 4 * node + 3 - near, level))
                node = near
            yield tree, node - first

    def bars(self, vectors: np.ndarray, opened: list[list[tuple[int, int]]], keep: int) -> np.ndarray:
        """What the ``keep``-th best of the sample's rows in each vector's opened leaves scores at least; -2 if there are not so many."""
        close = vectors @ self.sample.T
        out = np.full(len(vectors), -2.0)
        trees = np.arange(len(self.home))[:, None]
        for i, leaves in enumerate(opened):
            flag = np.zeros((len(self.home), 2**self.depth), bool)
            flag[tuple(np.array(leaves).T)] = True
            inside = close[i][flag[trees, self.home].any(axis=0)]
            if len(inside) >= keep:
                out[i] = np.partition(inside, -keep)[-keep] - ROUNDING
        return out

    def opened(self, top: int, recall: float = RECALL, measured: int = MEASURED) -> int:
        """How many leaves hold the share ``recall`` of the ``top`` nearest rows of the sample's first ones."""
        sample, home = self.sample, self.home
        needed = []
        for i in range(min(measured, len(sample))):
            close = sample @ sample[i]
            close[i] = -np.inf
            wanted = np.argsort(-close)[: min(top, len(sample) - 1)]
            left = {int(j): {(t, int(home[t, j])) for t in range(len(home))} for j in wanted}
            for n, leaf in enumerate(self.nearest_leaves(sample[i]), 1):
                for j in [j for j, at in left.items() if leaf in at]:
                    needed.append(n)
                    del left[j]
                if not left:
                    break
        return int(np.quantile(needed, recall, method="higher")) if needed else 1


def _usable(table: DataFrame, column: str) -> DataFrame:
    """``vec_id``, ``vec`` (doubles) of the rows that take part."""
    vec = F.col(f"`{column}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id is not null and vec is not null")
    rows = rows.filter(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.filter(F.size("vec") == (sizes.dim if sizes else 0))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """``cls``, ``vec`` and the ``ids`` smallest ids (``members``) of each distinct vector."""
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))).filter(F.col("_n") <= ids)
    return few.groupBy("cls").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("members"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares of tiny and huge numbers stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` with the same row of ``y``; a row's value doesn't depend on the others."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def fit(found: DataFrame, top: int, recall: float, trees: int, leaf: int, seed: int) -> tuple[Forest, int] | None:
    """The forest of a table of classes, and how many leaves a query opens; None without rows."""
    rows = found.count()
    if not rows:
        return None
    dim = found.select(F.size("vec").alias("d")).first().d
    most = min(SAMPLE_ROWS, max(1, SAMPLE_FLOATS // dim))
    sample = found.select("cls", "vec").orderBy(F.xxhash64("cls", F.lit(seed)), "cls").limit(most).collect()
    vectors = _unit(np.array([r.vec for r in sample]))
    forest = Forest(vectors, rows, trees, leaf, seed)
    return forest, forest.opened(top, recall)


def _filed(found: DataFrame, forest: Forest) -> DataFrame:
    """Every class in its leaf of every tree: (tree, leaf, cls, low, vec)."""
    shared = found.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for tree, leaf in enumerate(shared.value.leaves(_unit(_matrix(batch.column("vec"))))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree, np.int32)), pa.array(leaf), *[batch.column(c) for c in ("cls", "low", "vec")]], ["tree", "leaf", "cls", "low", "vec"])

    return found.select("cls", F.col("members")[0].alias("low"), "vec").mapInArrow(run, "tree int, leaf int, cls string, low long, vec array<double>")


def _asked(queries: DataFrame, forest: Forest, most: int, keep: int) -> DataFrame:
    """The leaves that each distinct query vector opens: (tree, leaf, qcls, qvec, bar)."""
    shared = queries.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ASKED):
                part = batch.slice(k, ASKED)
                unit = _unit(_matrix(part.column("vec")))
                opened = [list(islice(shared.value.nearest_leaves(v), most)) for v in unit]
                bar = pa.array(shared.value.bars(unit, opened, keep))
                at = pa.array(np.repeat(np.arange(len(opened)), [len(o) for o in opened]))
                tree, leaf = np.array([x for o in opened for x in o], np.int32).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(tree)), pa.array(np.ascontiguousarray(leaf)), *[c.take(at) for c in (part.column("cls"), part.column("vec"), bar)]], ["tree", "leaf", "qcls", "qvec", "bar"])

    return queries.mapInArrow(run, "tree int, leaf int, qcls string, qvec array<double>, bar double")


def _portions(size: Column) -> Column:
    return F.ceil(size / PORTION).cast("int")


def _compare(asked: DataFrame, filed: DataFrame, keep: int) -> DataFrame:
    """(qcls, cls, low, score): the ``keep`` best classes for each query in each portion of a leaf that it opens."""
    leaf = ["tree", "leaf"]
    size = filed.groupBy(*leaf).agg(F.count(F.lit(1)).alias("size"))  # leaves are as many as the sample allows
    crowd = asked.groupBy(*leaf).agg(F.count(F.lit(1)).alias("crowd"))
    both = materialize(size.join(crowd, leaf), "leaves")
    every = lambda n: F.explode(F.sequence(F.lit(0), _portions(F.col(n)) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), _portions(F.col(n))).cast("int")
    theirs = filed.join(both, leaf).withColumn("part", own("cls", "size")).withColumn("turn", every("crowd"))
    mine = asked.join(both, leaf).withColumn("turn", own("qcls", "crowd")).withColumn("part", every("size"))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names = ["qcls", "cls", "low", "score"]
        if not mine.num_rows or not theirs.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.float64())], names)
        x, y = _matrix(mine.column("qvec")), _matrix(theirs.column("vec"))
        low = theirs.column("low").to_numpy()
        close = _unit(x) @ _unit(y).T
        last = max(0, close.shape[1] - keep)
        bar = np.maximum(np.partition(close, last, axis=1)[:, last] - ROUNDING, mine.column("bar").to_numpy())
        i, j = np.nonzero(close >= bar[:, None])
        score = cosine(x[i], y[j])
        order = np.lexsort((low[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < keep
        i, j, score = i[few], j[few], score[few]
        return pa.Table.from_arrays([mine.column("qcls").combine_chunks().take(pa.array(i)), theirs.column("cls").combine_chunks().take(pa.array(j)), pa.array(low[j]), pa.array(score)], names)

    keys = [*leaf, "part", "turn"]
    met = mine.select(*keys, "qcls", "qvec", "bar").groupBy(*keys).cogroup(theirs.select(*keys, "cls", "low", "vec").groupBy(*keys))
    return met.applyInArrow(meet, "qcls string, cls string, low long, score double")


def neighbours(table: DataFrame, queries: Column, top: int = TOP, column: str = "embedding", trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``top`` nearest rows found for each row of ``table`` that the condition ``queries`` on ``vec_id`` takes."""
    spark = table.sparkSession
    cls = F.concat(F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(seed), "vec")))
    rows = _usable(table, column).groupBy("vec_id").agg(F.min(F.struct(cls.alias("cls"), "vec")).alias("v"))
    rows = materialize(rows.select("vec_id", "v.cls", "v.vec"), "vectors")
    found = materialize(classes(rows, top + 1), "vector-classes")
    fitted = fit(found, top, recall, trees, leaf, seed)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = rows.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("qcls"))
    vectors = found.join(asking.select(F.col("qcls").alias("cls")).distinct(), "cls", "left_semi").select("cls", "vec")
    forest, most = fitted
    asked = materialize(_asked(vectors, forest, most, top + 1), "asked")
    filed = materialize(_filed(found, forest), "filed")
    met = _compare(asked, filed, top + 1).distinct()
    order = Window.partitionBy("qcls").orderBy(F.desc("score"), "low", "cls")
    best = materialize(met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top + 1), "nearest")
    # members of a class stand at one score; ids of a query's own class are as near as the class itself
    members = best.join(found.select("cls", "members"), "cls").select("qcls", "score", F.explode("members").alias("vec_id"))
    near = members.withColumn("_n", F.row_number().over(Window.partitionBy("qcls").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= top + 1)
    lists = near.groupBy("qcls").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    own = asking.join(lists, "qcls").withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top))
    out = own.select("query_id", F.posexplode("near").alias("place", "hit"))
    out = materialize(out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")), "neighbours")
    discard(rows, found, asked, filed, best)
    return out


def op12_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op12_vector_forest": op12_vector_forest}
SQL: dict[str, str] = {}
