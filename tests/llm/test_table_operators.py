"""Operators 3, 8 and 9, and the pipeline."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hilbert_shards as hs
from ledgerloom.llm import secret_scan as ss
from ledgerloom.llm import source_mixing as sm
from ledgerloom.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


# --- mixing -----------------------------------------------------------------


def fill(sizes, weights, most=3):
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_words_taken(make):
    r = random.Random(1)
    rows = [(k, " ".join(["w"] * r.randrange(1, 60)), s) for k, s in enumerate(r.choices(["a", "b", "Z", "é", None, "tiny"], [50, 20, 20, 5, 5, 1], k=600))]
    rows += [(None, None, "a"), (7, "", "b"), (8, "x y", "b"), (8, "x y", "b")]
    got = sm.repetitions(make(rows)).select("_row.*", F.col("size").alias("words"), "source_size", "target", "copies").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and 0 <= x.copies <= 3 and x["size"] == 7
        taken[x.source] += x.copies * x.words
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= max(60, 0.03 * want[s]) for s in sizes)
    again = sm.repetitions(make(list(reversed(rows))).repartition(3)).select("_row.doc_id", "copies").collect()
    assert Counter(map(tuple, again)) == Counter((x.doc_id, x.copies) for x in got)
    mixed = sm.mix(make(rows))
    assert mixed.columns == make(rows).columns and mixed.count() == sum(x.copies for x in got)


def test_mixing_edges(make):
    assert sm.repetitions(make([])).count() == 0
    assert {x.copies for x in sm.repetitions(make([(1, None), (2, "", "b")])).collect()} == {0}


def test_rows_without_id_or_repeated_do_not_move_together(make):
    r = random.Random(9)
    rows = [(None, "w " * r.randrange(1, 50), "a") for _ in range(400)] + [(None, "same text here", "b")] * 300 + [(7, "other " * 9, "b")] * 200 + [(None, None, "b"), (k := 1, "x " * 4000, "c")]
    got = sm.repetitions(make(rows).repartition(5)).select("_row.doc_id", "_row.source", "_row.text", F.col("size").alias("words"), "target", "copies").collect()
    for s in "ab":
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.words * x.copies for x in mine) - mine[0].target) <= 10
    again = sm.repetitions(make(list(reversed(rows))).repartition(3)).select("_row.doc_id", "_row.source", "_row.text", "copies").collect()
    assert Counter((x.doc_id, x.source, x.text, x.copies) for x in got) == Counter(map(tuple, again))


# --- sharding ---------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"a{k} int" for k in range(dims)))
    rows = points.withColumn("h", hs.hilbert_index([F.col(f"a{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [x.h for x in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(x[:dims], y[:dims])) == 1 for x, y in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(make):
    r = random.Random(2)
    rows = [(k, r.choice([None, "", "é" * k, "same text", "x" * 5000]), r.choice(["a", "b", None]), r.choice(["en", "de", None])) for k in range(331)] + [(None, "q"), (4, "dup"), (4, "dup")]
    docs = make(rows).drop("size")
    out = hs.place(docs, 24).collect()
    count = Counter(x.shard for x in out)
    assert len(out) == len(rows) and set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(x.slot for x in out if x.shard == s) == list(range(n))
    import zlib

    for x in out:
        b = (x.text or "").encode()
        assert x.size == len(b) + 8 and x.text_crc32 == zlib.crc32(b)
    inside = sorted(out, key=lambda x: (x.shard, x.slot))
    assert [x.curve for x in inside] == sorted(x.curve for x in inside)
    assert sorted(x.shard for x in hs.place(make([(1, "a"), (2, "b")]).drop("size"), 24).collect()) == [0, 1]
    assert hs.place(make([]).drop("size")).count() == 0


def test_a_column_named_like_an_added_one_is_replaced(make):
    docs = make([(1, "a"), (2, "bc"), (3, None)]).withColumn("slot", F.lit("x")).withColumn("Curve", F.lit(1.5))
    out = hs.place(docs, 2)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"n", "kind", "lang", "text"} <= set(out.columns)
    assert sorted((x.doc_id, x["size"], x.slot) for x in out.select("doc_id", "size", "slot").collect())[0][:2] == (1, 9)
    assert hs.place(docs.withColumn("text_crc32", F.lit(0)), 2).select("text_crc32").filter("text_crc32 = 0").count() == 1  # the null text's


# --- secrets ----------------------------------------------------------------


def test_secret_scan_learns_from_labels(spark, make):
    r = random.Random(3)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for k in range(120):
        rows.append((k, f'set the token = "{hexes(40)}" in the file'))
        rows.append((1000 + k, f"the card {''.join(r.choice('0123456789') for _ in range(16))} and donaudampfschifffahrt near the house"))
    rows += [(None, f'token = "{hexes(40)}"'), (3000, None), (3001, ""), (3002, "é " + "k" * 30_000 + " z"), (5, f'password: "{hexes(32)}"')]
    out = ss.scan(make(rows)).collect()
    text = dict(rows)
    import hashlib

    for x in out:
        assert x.doc_id in text
        if x.doc_id not in (None, 5):
            assert hashlib.sha256(text[x.doc_id][x.start : x.finish].encode()).hexdigest() == x.candidate_sha256
    assert all(x.kept for x in out if x.doc_id is not None and x.doc_id < 120)
    assert not any(x.kept for x in out if x.doc_id is not None and 1000 <= x.doc_id < 2000)
    assert sum(x.doc_id is not None and 1000 <= x.doc_id < 2000 for x in out) == 240
    none = ss.scan(make(rows), spark.createDataFrame([], "doc_id long, start long, is_secret boolean")).collect()
    assert len(none) == len(out) and all(x.kept and x.probability is None for x in none)
    assert ss.scan(make([])).count() == 0


def test_secret_scan_leaves_no_value_in_the_shared_folder(make, tmp_path, monkeypatch):
    from ledgerloom.llm import shared

    value = "q7" * 20
    rows = [(k, f'set the token = "{value}{k}" in the file and donaudampfschifffahrt here') for k in range(30)]
    written, put = [], shared.materialize
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(ss, "materialize", lambda df, name: (written.append(df.collect()), put(df, name))[1])
    out = ss.scan(make(rows)).collect()
    assert len(out) == 60 and written
    assert not any(value in repr(x) or "donaudampf" in repr(x) for t in written for x in t)
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 1 and left[0].startswith("findings-")  # what it returns


def test_candidates_equal_brute_force(make):
    import re

    r = random.Random(5)
    k = "k" * 20
    bits = [k, f"{k}.{k}", f"xx{k}yy.{k}", f'"{k}"', "'a1.b2!c3$'", '"short"', "/usr/lib/x86-64-linux-gnu/lib", "é", "=", "token", "a", "\n", "  ", f"{k}\t{k}", "漢字", '"un closed', "x" * 300, f"({k})"]
    texts = ["", None, k, f"{k} {k}", "é " * 40 + k] + ["".join(r.choice(bits) + r.choice([" ", "", "\n"]) for _ in range(r.randrange(1, 25))) for _ in range(150)] + [f"{k} " * 700]
    pattern = re.compile(ss.CANDIDATE)
    blank = re.compile(r"[\x20\x09-\x0D]+")
    want = Counter()
    for d, t in enumerate(texts):
        found = list(pattern.finditer(t or ""))
        for i, m in enumerate(found):
            first = found[i - 4].start() if i >= 4 else 0
            left = blank.split(t[: m.start()])[::-1]
            known = " " in t[first : m.start()] or "\n" in t[first : m.start()] or "\t" in t[first : m.start()] or i < 4
            want[d, m.start(), m[0], left[0] if known else None] += 1
    docs = make(list(enumerate(texts)))
    got = ss.candidates(docs.select("doc_id", "text", "source")).collect()
    assert Counter((x.doc_id, x.start, x.candidate) for x in got) == Counter((d, a, c) for d, a, c, _ in want.elements())
    known = {(d, a): b for d, a, _, b in want if b is not None}
    for x in got:
        t = texts[x.doc_id]
        if (x.doc_id, x.start) in known and len(known[x.doc_id, x.start]) < 100:
            assert x.before == known[x.doc_id, x.start]
    far = {x.doc_id: x for x in ss.candidates(make([(1, f'one two three four token = "{k}1" five six')])).collect()}[1]
    assert (far.left3, far.left2, far.left1, far.before, far.right1, far.word) == ("four", "token", "=", '"', "five", f'"{k}1"')
    bare = ss.candidates(docs.select("doc_id", "text"))
    assert bare.count() == len(got) and bare.filter("source is not null").count() == 0


def test_coverage_counts_letters_of_known_words(spark, make):
    docs = make([(1, "houseXYZhouse999900 and zzqqzzqqzzqqzzqqzz")])
    found = ss.candidates(docs).withColumn("finding", F.monotonically_increasing_id())
    known = spark.createDataFrame([("house",), ("use",)], "entry string")
    got = {x.candidate: x for x in ss.with_features(found, known).collect()}
    x = got["houseXYZhouse999900"]
    assert x.known == pytest.approx(10 / 19) and got["zzqqzzqqzzqqzzqqzz"].known == 0 and x.digits == pytest.approx(6 / 19)
    assert len(got) == 2 and x.path_like == 0 and x.length == 19


def test_forest_finds_held_out_secrets_without_the_name(spark):
    got = ss.held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got["secrets"] >= 3 and got["precision"] >= 0.9 and got["recall"] >= 0.9


# --- order of rows ----------------------------------------------------------


def test_mix_of_repeated_ids_depends_on_no_order(spark, words):
    r = random.Random(11)
    rows = [(r.randrange(40), words(r.randrange(1, 6), r.randrange(4)), f"s{r.randrange(3)}", r.randrange(3)) for _ in range(600)]
    schema = "doc_id long, text string, source string, lang long"
    mixes = []
    for k in range(2):
        got = sm.mix(spark.createDataFrame(rows, schema).repartition(3 + 4 * k)).collect()
        mixes.append(Counter(map(tuple, got)))
        r.shuffle(rows)
    assert mixes[0] == mixes[1]


def test_equal_rows_are_dealt_over_all_slices(spark, monkeypatch):
    from ledgerloom.llm import shared

    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    written, put = {}, shared.materialize

    def noted(df, name):
        written[name] = put(df, name)
        return written[name]

    monkeypatch.setattr(shared, "materialize", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes go to one slice
    got = hs.place(docs).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    slices = [x["count"] for x in written["slices"].groupBy("_slice").count().collect()]
    assert sorted(x.n for x in got) == [833] * 16 + [834] * 8 and all(x.last == x.n - 1 for x in got)
    assert len(slices) == 8 and max(slices) < 2 * 20_000 / len(slices)


# --- registered queries ------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = c.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline as cp

    from ledgerloom.llm import jaccard_join as jj
    from ledgerloom.llm import quality_rules as qr

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    step = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        step[name] = docs
    ids = {k: Counter(x.doc_id for x in v.select("doc_id").collect()) for k, v in step.items()}
    judged = qr.score_documents(step["documents"], labels).filter("kept").select("doc_id").collect()
    assert set(ids["quality"]) == {x.doc_id for x in judged}
    groups = jj.jaccard_components(step["quality"]).collect()
    assert set(ids["near_duplicates"]) == {x.component_id for x in groups if x.n_shingles}
    assert set(ids["decontaminate"]) <= set(ids["near_duplicates"]) and len(ids["decontaminate"]) > 0.9 * len(ids["near_duplicates"])
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(ids["mix"].values()) <= 3
    assert ids["shards"] == ids["mix"]
    assert all(step[k].columns == step["documents"].columns for k, _ in cp.STAGES[:-1])
    assert cp.run(spark, SF).count() == sum(ids["mix"].values())
