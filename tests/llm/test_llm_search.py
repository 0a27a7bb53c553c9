"""Hard negatives, ranked lexical search and approximate neighbours against brute force, on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foldlake.llm import crosspoly, negatives, ranked

VECTORS = "vec_id bigint, embedding array<double>, label int"
SEPARATORS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def floors(v):
    return [math.floor(256 * c) for c in v]


def clip(score):
    return max(-2 ** 63, min(2 ** 63 - 1, score))


# ---------------------------------------------------------------- 11 hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 9), (33, 64, 70), (40, 0, 50), (64, 65, 66)])
@pytest.mark.parametrize("top", [300, 1 << 40])
def test_strassen_equals_the_product(shape, top):
    rng = np.random.default_rng(1)
    m, d, n = shape
    a, x = rng.integers(-top, top, (m, d)), rng.integers(-top, top, (n, d))
    want = [[clip(sum(p * q for p, q in zip(u, v))) for v in x.tolist()] for u in a.tolist()]
    assert negatives.scores(a, x, leaf=4).tolist() == want


def test_sums_that_wrap_around_come_back():
    """Quadrant sums leave 64 bits although every score fits."""
    a = np.full((8, 8), (1 << 62) // 8 * 5 // 4, dtype=np.int64)
    x = np.tile(np.array([1, -1, 1, 0, 1, -1, 1, 0], dtype=np.int64), (8, 1))
    assert (negatives.strassen(a, x.T, leaf=1) == a @ x.T).all()
    assert int(a[0, 0]) * 2 == int((a @ x.T)[0, 0])


@pytest.mark.parametrize("positive, want", [(100, (80, 100)), (7, (6, 7)), (0, (0, 0)), (-5, (-4, -5)), (2 ** 62, (-(-2 ** 62 * 4 // 5), 2 ** 62))])
def test_windows(positive, want):
    assert negatives.window(positive, 80, 100) == want


def mined_by_force(rows, step=100, k=5):
    rows = sorted({(i, n, tuple(floors(v))) for i, v, n in rows if i is not None and n is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for a in rows:
        if a[0] % step:
            continue
        met = [(clip(sum(p * q for p, q in zip(a[2], c[2]))), c[0], c[1]) for c in rows if c != a and len(c[2]) == len(a[2])]
        met.sort(key=lambda m: (-m[0], m[1]))
        for p in [m for m in met if m[2] == a[1]][:k]:
            hard = [m for m in met if m[2] != a[1] and 80 * p[0] <= 100 * m[0] <= 100 * p[0]][:k]
            out += [(a[0], p[1], rank, m[1], p[0], m[0]) for rank, m in enumerate(hard, 1)]
    return sorted(out)


def mined(df, **options):
    found = negatives.mine(df, "vec_id % 100 = 0", **options).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found)


@pytest.mark.parametrize("scale, options", [(1.0, {}), (1.0, {"block": 37, "step": 2, "leaf": 2}), (1e6, {"block": 64}), (1e16, {"block": 50, "leaf": 3})])
def test_mining_equals_brute_force(spark, scale, options):
    rng = np.random.default_rng(3)
    rows = [(k, (np.abs(rng.normal(size=6)) * scale).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3]))) for k in range(450)]
    rows += [(1000 + k, rows[100][1], k % 4) for k in range(60)]  # one vector many times, in every label
    rows += [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [1.0, 2.0], 2), (2100, [], 1), (2101, [], 1), (2102, [], 2)]
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(5), **options) == mined_by_force(rows)


def test_mining_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, None], 2), (4, [nan, 0.0], 2), (5, [inf, 0.0], 2),
            (6, None, 2), (7, [0.9, 0.0], None), (None, [0.9, 0.0], 2), (100, [0.0, 1.0], 9), (200, [-1.0, 0.0], 2), (9, [0.9, 0.0], 3)]
    table = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], VECTORS + ", row string, score string, rank string, dims int")
    want = mined_by_force(rows)
    assert mined(table) == want and (0, 1, 1, 2, 256 * 256, 230 * 256) in want
    assert negatives.mine(table.limit(0), "vec_id % 100 = 0").count() == 0
    assert negatives.mine(table.filter("vec_id = 0"), "vec_id % 100 = 0").count() == 0


# ---------------------------------------------------------------- 12 ranked search

def ranked_by_force(docs, items, k=50):
    """From the formula, with Python's regular expressions and integers."""
    words = [SEPARATORS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = defaultdict(list)
    for item, text in items:
        asked = set(SEPARATORS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scored = []
        for (doc, _), w in zip(docs, words):
            tf = Counter(w)
            m = 100 - 50 + (50 * len(w) * n) // total if w else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in asked if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out[item] += [(rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return {i: sorted(h, key=str) for i, h in out.items() if h}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(h, key=str) for i, h in out.items()}


@pytest.mark.parametrize("options", [{}, {"tokens": 5000, "block": 3}, {"tokens": 300, "block": 1}, {"k": 7, "tokens": 20000}])
def test_ranked_search_equals_brute_force(spark, sf_dir, options):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000 + k, docs[3][1]) for k in range(120)]  # more copies than places
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    made = ranked.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"), **options)
    assert found(made) == ranked_by_force(docs, items, options.get("k", 50))


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(256))) + " Ünïcode ÀB İstanbul 日本語 x_y a b 1.5 A B"
    want = SEPARATORS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [t.decode() for t in ranked.terms(text.encode())] == want


def test_intervals_are_pruned_and_ranges_are_right():
    rng = np.random.default_rng(2)
    docs, lists = 3000, []
    for share in (0.9, 0.5, 0.2, 0.02, 0.001):
        place = np.flatnonzero(rng.random(docs) < share)
        lists.append((place, rng.integers(1, int(10 / share) + 2, len(place))))
    made = ranked._Lists(lists, docs)
    for _ in range(200):
        t = int(rng.integers(len(lists)))
        a, b = sorted(rng.integers(made.starts[t], made.ends[t] + 1, 2).tolist())
        value, at = made.maximum(np.array([a]), np.array([b]))
        assert value[0] == (made.impact[a:b].max() if a < b else 0)
        assert a == b or at[0] == a + int(made.impact[a:b].argmax())
    full = np.zeros(docs, dtype=np.int64)
    for place, impact in lists:
        full[place] += impact
    places, scores, scored = made.search(np.arange(len(lists)), 10)
    want = np.lexsort((np.arange(docs), -full))[:10]
    assert places.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert scored < docs / 2


def test_ranked_search_edge_cases(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "..."), (None, "alpha beta"), (5, "ALPHA " * 40000), (6, "gamma"), (7, "é"), (-3, "alpha beta")]
    items = [(1, "Alpha"), (1, "Alpha"), (2, None), (3, ""), (4, "beta beta gamma é"), (None, "gamma"), (5, "nowhere")]
    d = spark.createDataFrame([(*r, "x", "y", 1) for r in docs], "doc_id bigint, text string, item_id string, score string, rank int")
    i = spark.createDataFrame([(*r, 5, "z") for r in items], "item_id bigint, text string, doc_id int, score string")
    assert found(ranked.search(d, i)) == ranked_by_force(docs, items)
    assert ranked.search(d.limit(0), i).count() == ranked.search(d, i.limit(0)).count() == 0


# ---------------------------------------------------------------- 13 cross-polytope search

def test_rotations_keep_lengths_and_angles():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 24))
    y = crosspoly.rotated(x, 3, 0)
    assert y.shape == (50, 32) and np.allclose(y @ y.T, x @ x.T)
    dense = np.array([[1]])
    while len(dense) < 32:
        dense = np.block([[dense, dense], [dense, -dense]])
    z = rng.normal(size=(5, 32))
    assert np.allclose(crosspoly.hadamard(z), z @ dense / np.sqrt(32))


@pytest.mark.parametrize("fine", [0, 3])
def test_probes_begin_with_the_own_cell_and_reach_all(fine):
    x = np.random.default_rng(6).normal(size=(20, 16))
    count = crosspoly._cell_count(16, fine)
    order = crosspoly.probed(x, 2, fine, count)
    assert (order[:, 0] == crosspoly.cells(x, 2, fine)).all()
    assert (np.sort(order, axis=1) == np.arange(count)).all()
    assert (crosspoly.probed(x, 2, fine, 5) == order[:, :5]).all()


def neighbours_by_force(rows, k, step):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and any(v) and all(c is not None and math.isfinite(c) for c in v)})
    out = {}
    for q in sorted({i for i, _ in rows if i % step == 0}):
        best = {}
        for _, v in [r for r in rows if r[0] == q]:
            for i, w in rows:
                if i != q and len(v) == len(w):
                    s = float((np.array(v) * np.array(w)).sum())
                    best[i, w] = max(best.get((i, w), s), s)
        out[q] = [(i, s) for (i, _), s in sorted(best.items(), key=lambda m: (-m[1], m[0][0]))][:k]
    return out


def neighbours(df, **options):
    out = defaultdict(list)
    for r in sorted(crosspoly.search(df, "vec_id % 20 = 0", **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("lengths, options", [("unit", {}), ("any", {}), ("unit", {"fine": 2, "piece": 16}), ("any", {"tables": 3, "piece": 40})])
def test_search_recall(spark, lengths, options):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "any":
        x *= rng.uniform(0.2, 3, (900, 1))
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(2000 + k, x[40].tolist()) for k in range(50)]  # more copies than places
    want, got = neighbours_by_force(rows, 20, 20), neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3), **options)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    every = {(q, i): s for q, hits in neighbours_by_force(rows, 10 ** 6, 20).items() for i, s in hits}
    for q, hits in got.items():
        assert all(every[q, i] == s for i, s in hits) and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
    assert got[40] == want[40]  # all its copies, by id


def test_search_is_exact_where_every_cell_is_probed(spark):
    rng = np.random.default_rng(9)
    rows = [(k, v) for k, v in enumerate(rng.integers(-2, 3, (300, 3)).astype(float).tolist())] + [(500, [1.0]), (501, [2.0]), (520, [-1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert neighbours(table, k=4, probes=64, tables=2, piece=20) == {q: h for q, h in neighbours_by_force(rows, 4, 20).items() if h}


def test_fewer_candidates_than_asked_for_are_all_listed(spark):
    rows = [(k, v) for k, v in enumerate(np.random.default_rng(11).normal(size=(18, 40)).tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = crosspoly.search(table, "vec_id % 20 = 0").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(k, i) for k, (i, _) in enumerate(neighbours_by_force(rows, 20, 20)[0], 1)] and len(got) == 17


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, None), (None, [1.0, 1.0]), (7, [0.5, 0.5]),
            (20, [-0.0, 3.0]), (40, [1.0])]
    table = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "vec_id bigint, embedding array<float>, score string, class string, rank int, dims int")
    got = neighbours(table, probes=4)
    assert got == {q: h for q, h in neighbours_by_force(rows, 20, 20).items() if h}
    assert crosspoly.search(table.limit(0), "vec_id % 20 = 0").count() == 0
    assert crosspoly.search(table.filter("vec_id = 1"), "vec_id % 20 = 0").count() == 0
