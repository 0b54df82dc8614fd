import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard_join as jj


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def edited(text, share, r):
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(make, words):
    r = random.Random(2)
    rows = [(k, words(r.choice([1, 2, 3, 5, 6, 9, 20, 60, 150, 400]), k)) for k in range(120)]
    for base in range(12):  # near copies around the threshold
        for share in (0.0, 0.01, 0.03, 0.05, 0.08):
            rows.append((len(rows), edited(rows[base * 9][1], share, r)))
    passage = words(60, 999)
    rows += [(len(rows) + k, passage + " " + words(3 + k, 5000 + k)) for k in range(40)]  # one passage in many
    rows += [(len(rows) + k, passage.upper()) for k in range(5)]
    got = [tuple(x) for x in jj.jaccard_components(make(rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def link(x, y, percent=75):
    x, y = shingles(x), shingles(y)
    return 100 * len(x & y) >= percent * len(x | y)


def test_large_group_of_near_copies(make, words):
    r = random.Random(3)
    base = words(80, 1)
    rows = [(k + 10, edited(base, 0.02, r)) for k in range(200)] + [(1000 + k, words(50, 7000 + k)) for k in range(50)]
    got = [tuple(x) for x in jj.jaccard_components(make(rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_edges(make):
    rows = [(5, None), (6, ""), (7, " \n "), (8, "one two"), (9, "ONE two"), (None, "one two"), (9, "ONE two"), (None, "a b c d e f"), (3, "é é"), (4, "É é")]
    got = sorted((tuple(x) for x in jj.jaccard_components(make(rows)).collect()), key=repr)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (None, 1, 8), (9, 1, 8), (None, 2, None), (3, 1, 3), (4, 1, 4)], key=repr)
    assert jj.jaccard_components(make([])).count() == 0


def test_one_of_each_keeps_columns_and_one_row_of_each_group(make, words):
    """A row without an id that links to another is a duplicate like any other; without any id one of the group stays."""
    a, b = words(40, 1), words(40, 7)
    rows = [(2, a), (1, a + " tail"), (1, a + " tail"), (None, a), (None, a), (4, words(40, 2)), (5, None), (None, b), (None, b), (None, b + " tail"), (None, ""), (6, words(40, 8), "s1"), (6, words(40, 8), "s2")]
    out = jj.one_of_each(make(rows))
    assert out.columns == make(rows).columns
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted((d for d, _ in got), key=repr) == sorted([1, 4, 5, 6, None, None], key=repr)
    assert sum(t in (b, b + " tail") for d, t in got if d is None) == 1 and (None, "") in got


def test_near_copies_with_null_and_repeated_ids(make, words):
    r = random.Random(4)
    a, b, c = words(200, 1), words(200, 2), words(200, 3)
    rows = [(None, a), (None, edited(a, 0.01, r)), (7, edited(a, 0.01, r)), (None, edited(b, 0.01, r)), (None, edited(b, 0.01, r))]
    w = c.split()
    left, right = (" ".join(x) for x in ([f"x{k}" for k in range(18)] + w[18:], w[:-18] + [f"y{k}" for k in range(18)]))
    assert not link(left, right) and link(left, c) and link(right, c)
    rows += [(None, c), (20, left), (21, right)]  # the one between has no id
    rows += [(30, words(100, 5)), (31, edited(words(100, 5), 0.01, r)), (31, words(100, 6)), (31, words(100, 6) + " tail")]
    got = [tuple(x) for x in jj.jaccard_components(make(rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)
    low = {d: k for d, _, k in got if d in (20, 21)}
    assert low == {20: 20, 21: 20}


def test_one_of_each_judges_texts_under_one_id_each_on_its_own(make, words):
    a, b = words(100, 1), words(100, 2)
    rows = [(1, a), (2, a + " tail"), (2, b), (2, b + " tail"), (3, b + " end"), (4, words(100, 3)), (4, words(100, 4))]
    out = [(x.doc_id, x.text) for x in jj.one_of_each(make(rows)).collect()]
    assert sorted(x for x, _ in out) == [1, 2, 4, 4]
    assert [t for d, t in out if d == 2][0] in (b, b + " tail")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 15, 16, 63, 64, 250, 1023])
def test_linked_sets_always_share_a_key(n):
    """The pigeonhole: however tokens differ within the bound, a key is shared."""
    rng = np.random.default_rng(n)
    for _ in range(30):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = rng.integers(0, len(a) // 4 + 1)
        keep = a[drop:]
        room = int((len(keep) * 100 // 75) - len(a))
        extra = rng.integers(0, 2**63, rng.integers(0, max(0, room) + 1), dtype=np.uint64)
        b = np.unique(np.concatenate((keep, extra)))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            frequent = np.sort(rng.choice(a, len(a) // 2, replace=False))
            assert len(np.intersect1d(jj.file_keys(a, 75, frequent), jj.file_keys(b, 75, frequent)))
            x, y = (np.frombuffer(jj.parity(s), np.uint8) for s in (a, b))
            assert jj.hamming(x, y) <= len(a) + len(b) - 2 * both


def test_shingles_of_a_long_text():
    t = "ab " * 200_000
    assert [len(s) for s in jj.shingle_sets(pa.array([t, None, "x"], pa.large_string()).fill_null(""))] == [1, 0, 1]


def test_crowded_buckets(make, words, monkeypatch):
    """Many classes that share a passage but don't link, among them links that no star finds, small and large sets."""
    monkeypatch.setattr(jj, "SMALL", 3)
    monkeypatch.setattr(jj, "PORTION", 16)
    r = random.Random(11)
    passage = words(14, 1, 60)
    rows = []
    for k in range(120):  # the passage is most of a text; some have a near copy
        text = f"{passage} {words(r.randrange(8, 14), 100 + k, 200)}"
        rows.append((len(rows), text))
        if k % 5 == 0:
            rows.append((len(rows), text + " end"))
    base = words(40, 5)
    rows += [(len(rows) + k, edited(base, 0.06, r)) for k in range(60)]  # copies of copies around the threshold
    long = words(260, 6)
    for k in range(40):
        rows.append((len(rows), f"{long} {words(90 + 2 * k, 300 + k)}"))
    got = [tuple(x) for x in jj.jaccard_components(make(rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)
