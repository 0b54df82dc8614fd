"""Operators 11 to 13 against brute force on small inputs, and their edge cases."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import ranked_search, spelling_variants, vector_forest

SF = "/root/testdata/sf0.01"


# --- 11: spelling variants ---------------------------------------------------


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows, least=6, count=5, ratio=5, damage=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    by = {a: [b for b in n if near(a, b)] for a in n}
    form = {}
    for w in n:
        b = min(by[w], key=lambda b: (-n[b], b), default=None)
        form[w] = b if b and n[b] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n}


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def noisy(seed, stems, letters, docs=60):
    """Texts of stems and of stems with some edits, frequent ones far more often."""
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(6, 11))) for _ in range(stems)]

    def edited(w):
        for _ in range(r.randrange(1, 3)):
            i, c = r.randrange(len(w)), r.choice(letters)
            w = r.choice((w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]))
        return w

    pool = words + [edited(w) for w in words for _ in range(3)]
    weights = [200] * stems + [r.choice((3, 8, 30)) for _ in range(3 * stems)]
    return [(i, " ".join(r.choice((w, w.upper(), w.capitalize())) for w in r.choices(pool, weights, k=150))) for i in range(docs)]


@pytest.mark.parametrize("seed,stems,letters", [(1, 40, "abcdefghijklmnopqrstuvwxyz"), (2, 60, "ab"), (3, 60, "aéo"), (4, 25, "abcÿ×÷")])
def test_variants_equal_brute_force(spark, make, seed, stems, letters):
    rows = noisy(seed, stems, letters)
    rows += [(None, None), (None, "thereabouts thereabouts"), (7, ""), (8, " .;\n"), rows[0], rows[0]]
    assert got_variants(spelling_variants.variants(make(rows))) == expected_variants(rows)


def test_variants_with_frequent_damage_and_short_words(spark, make):
    rows = noisy(5, 30, "abc")
    got = spelling_variants.variants(make(rows, extra=False), least_length=4, least_count=2, ratio=2, damage=3)
    assert got_variants(got) == expected_variants(rows, 4, 2, 2, 3)


def test_variants_of_very_long_runs_and_texts(spark, make):
    rows = [(i, "x" * 100_000 + " filler" * 20_000) for i in range(5)] + [(9, "x" * 99_999)] * 5
    got = got_variants(spelling_variants.variants(make(rows)))
    assert got == expected_variants(rows) and got["filler"][2] >= 80_000


def test_variants_follow_forms_to_the_last(spark, make):
    """n rises fivefold a step: the first word's root is two steps away; equal counts take the smaller word."""
    text = " ".join(["abcdefg"] * 5 + ["abcdefgh"] * 25 + ["abcdefghi"] * 125 + ["abcdefgx"] * 25)
    got = got_variants(spelling_variants.variants(make([(1, text)]), damage=10**9))
    assert got["abcdefg"] == ("abcdefgh", "abcdefghi", 5, 2, 25)
    assert got["abcdefgh"][:2] == ("abcdefghi", "abcdefghi") and got["abcdefghi"][:2] == (None, "abcdefghi")


def test_variants_of_an_empty_table(spark, make):
    assert spelling_variants.variants(make([])).count() == 0
    assert spelling_variants.variants(make([(1, None), (2, "a b")])).count() == 0


def test_check_sums_of_spans():
    r = random.Random(3)
    raw = np.array([r.randrange(256) for _ in range(5000)], np.uint8)
    start = np.array([r.randrange(4000) for _ in range(300)] + [5, 9])
    end = start + np.array([r.randrange(1, 90) for _ in range(300)] + [0, 990])
    seed = np.array([r.randrange(2**32) for _ in range(302)], np.uint32)
    want = [zlib.crc32(raw[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seed)]
    assert spelling_variants.crc32_spans(raw, start, end, seed).tolist() == want


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(8)
    for _ in range(300):
        places = sorted(r.sample(range(12), r.randrange(3, 7)))
        cost = [r.randrange(9) for _ in places]
        by = dict(zip(places, cost))
        a, b = spelling_variants.pivots(places, cost)
        assert b - a >= 2 and by[a] + by[b] == min(by[x] + by[y] for x in places for y in places if y - x >= 2)


# --- 12: nearest neighbours --------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, score int")


def exact(rows, take, top=5):
    """Query id to its (vec_id, score), by brute force in doubles of the stored floats."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, x in good:
        if take(q):
            near = [(-(x @ y) / math.sqrt((x @ x) * (y @ y)), i) for i, y in good if i != q]
            out[q] = sorted((round(s, 12), i) for s, i in near)[:top]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((round(-r.score, 12), r.vec_id))
    return out


def test_few_vectors_are_searched_exactly(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(8)) for i in range(300)]
    got = found(vector_forest.neighbours(vectors(spark, rows), F.col("vec_id") % 7 == 0, recall=1.0, leaf=400))
    assert got == exact(rows, lambda i: i % 7 == 0)


def test_recall_on_clusters(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    centre = r.standard_normal((40, 24))
    rows = [(i, centre[i % 40] + 0.5 * r.standard_normal(24)) for i in range(4000)]
    got = found(vector_forest.neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0))
    want = exact(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    same = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert same >= 0.9 * 5 * len(want)
    scores = {(q, i): s for q, x in exact(rows, lambda i: i % 50 == 0, 4000).items() for s, i in x}
    assert all(scores[q, i] == s for q, x in got.items() for s, i in x)


def test_unusable_vectors_take_no_part(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0, 0]), (2, None), (3, [None, 1]), (4, [nan, 1]), (5, [inf, 1]), (6, []), (7, [1, 2, 3]), (None, [1, 1]), (8, [1, 1]), (8, [1, 1]), (9, [2, 0]), (10, [-1, 0])]
    got = found(vector_forest.neighbours(vectors(spark, rows), F.lit(True)))
    r2 = round(math.sqrt(0.5), 12)
    assert got[0] == [(-1.0, 9), (-r2, 8), (1.0, 10)]
    assert set(got) == {0, 8, 9, 10}


def test_copies_ties_and_huge_numbers(spark):
    from pyspark.sql import functions as F

    rows = [(i, [3e30, 4e30]) for i in range(2000)] + [(5000, [3e-30, 4e-30]), (5001, [4, -3])]
    got = found(vector_forest.neighbours(vectors(spark, rows), F.col("vec_id").isin(0, 3, 1999, 5001)))
    assert got[3] == [(-1.0, i) for i in (0, 1, 2, 4, 5)] and got[0] == [(-1.0, i) for i in (1, 2, 3, 4, 5)]
    assert [i for _, i in got[1999]] == [0, 1, 2, 3, 4] and len(got[5001]) == 5


def test_no_vectors(spark):
    from pyspark.sql import functions as F

    for rows in ([], [(1, None)], [(1, [1, 2])]):
        assert vector_forest.neighbours(vectors(spark, rows), F.lit(True)).count() == 0


def test_crowded_leaves_are_dealt_in_portions(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vector_forest, "PORTION", 16)
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(4)) for i in range(200)]
    got = found(vector_forest.neighbours(vectors(spark, rows), F.col("vec_id") % 3 == 0, recall=1.0, leaf=300))
    assert got == exact(rows, lambda i: i % 3 == 0)


# --- 13: ranked search -------------------------------------------------------


def expected_ranking(docs, items, top=10):
    term = lambda t: [lower(x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts = [(d, Counter(term(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(term(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return out


def order(rows):
    return sorted(rows, key=repr)


def ranked(df):
    return order((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def prose(seed, docs, vocabulary=300):
    r = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"É{i}Ü" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(r.choice((w, w.upper())) for w in r.choices(words, weights, k=r.choice((1, 5, 30, 200))))) for i in range(docs)]


@pytest.mark.parametrize("span,width", [(4096, 24), (64, 2), (1, 1)])
def test_ranking_equals_brute_force(spark, make, monkeypatch, span, width):
    monkeypatch.setattr(ranked_search, "RANGE", span)
    monkeypatch.setattr(ranked_search, "WIDTH", width)
    docs = prose(1, 400 if span > 1 else 60)
    docs += [(900, None), (901, ""), (902, "-- !"), (None, docs[3][1]), docs[5], docs[5], docs[7][:1] + (docs[8][1],)]
    items = [(i, t) for i, (_, t) in enumerate(prose(2, 30))] + [(99, "unknown words only"), (98, None), (97, "w1-w1, W1"), (5, "w7")]
    got = ranked_search.search(make(docs), spark.createDataFrame([(*x, "rank") for x in items], "item_id long, text string, score string"))
    assert ranked(got) == order(expected_ranking(docs, items))


def test_ranking_in_blocks_of_items(spark, make):
    docs = prose(3, 80)
    items = [(i, t) for i, (_, t) in enumerate(prose(4, 25))] + [(None, "w3 w4"), (None, "w9")]
    got = ranked_search.search(make(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=900)
    assert ranked(got) == order(expected_ranking(docs, items))


def test_ranking_of_ties_long_texts_and_empty_tables(spark, make):
    docs = [(i, "alpha beta") for i in range(40, 0, -1)] + [(50, "alpha " * 200_000), (51, "gamma")]
    items = spark.createDataFrame([(1, "Alpha"), (2, "gamma delta")], "item_id long, text string")
    got = ranked(ranked_search.search(make(docs), items))
    assert got == order(expected_ranking(docs, [(1, "Alpha"), (2, "gamma delta")]))
    assert ranked_search.search(make([]), items).count() == 0
    assert ranked_search.search(make(docs), items.limit(0)).count() == 0


# --- against SQL -------------------------------------------------------------


@pytest.mark.parametrize("module", [spelling_variants, ranked_search])
def test_queries_equal_their_sql(spark, module):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, query in module.QUERIES.items():
        df = query(spark, SF)
        cur = c.execute(module.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert order(tuple(r[n] for n in names) for r in df.collect()) == order(map(tuple, cur.fetchall()))
