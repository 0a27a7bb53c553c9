"""Groups that hold most of the data, plans, and what the library may not do."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldlake.functions.ordering import hash_pieces, ordinal, range_pieces, sums_of_best, with_score_pieces
from foldlake.operators import graph, pairs, retrieve
from foldlake.plans import load_all, proxies
from foldlake.plans.registry import QUERIES
from foldlake.session import tasks_for

ROOT = Path(__file__).resolve().parents[1] / "foldlake"


def test_ordinal_in_one_hot_group(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    out = ordinal(df, ["g"], [F.col("h")], hash_pieces(F.col("h"), 2), "n").toPandas()
    for _, part in out.groupby("g"):
        assert part.sort_values("h")["n"].tolist() == list(range(len(part)))


def test_ordinal_over_everything(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k"))
    out = ordinal(df, [], [F.col("k")], range_pieces(df, "k", 16), "n").toPandas().sort_values("k")
    assert out["n"].tolist() == list(range(3000))


def test_running_sum_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(i), int(j), float(p), int(y)) for (i, j), p, y in zip(
        [(i, j) for i in range(60) for j in range(60)], rng.choice([0.0, 1.0, 0.25, 0.3, 0.30001], 3600), rng.integers(0, 2, 3600))]
    df = spark.createDataFrame(rows, "g int, i int, j int, p double, y int")
    cut, pieces = with_score_pieces(df, "p", "i", 16, 8)
    out = ordinal(cut, ["g"], [F.desc("p"), F.col("i"), F.col("j")], pieces, "n", {"tp": F.col("y")})
    got = out.toPandas().sort_values("n")
    want = sorted(rows, key=lambda r: (-r[3], r[1], r[2]))
    assert list(zip(got.i, got.j)) == [(r[1], r[2]) for r in want]
    assert got.tp.tolist() == np.cumsum([r[4] for r in want]).tolist()


@pytest.mark.parametrize("scores", [[0.3], [0.3, 0.7, 0.70001]])
def test_equal_scores_are_many_pieces(spark, scores):
    """A chain with 95 % of the rows and few distinct scores: no piece holds more than one part in twenty."""
    df = spark.range(40_000).select(F.when(F.col("id") % 20 == 0, "b").otherwise("a").alias("c"), (F.col("id") % 997).cast("int").alias("i"),
                                    F.element_at(F.array(*[F.lit(x) for x in scores]), (F.col("id") % len(scores)).cast("int") + 1).alias("p"))
    cut, pieces = with_score_pieces(df, "p", "i", width=16)
    assert cut.select("c", *[p.alias(f"k{n}") for n, p in enumerate(pieces)]).groupBy("c", "k0", "k1").count().agg(F.max("count")).first()[0] <= 2000


def _cloud(spark, sizes, spread, seed=3, missing=9):
    rng = np.random.default_rng(seed)
    rows = [(f"c{c}", k, *map(float, rng.normal(0, spread, 3)), k % missing != 0) for c, n in enumerate(sizes) for k in range(n)]
    return rows, spark.createDataFrame(rows, "chain_key string, pos int, x double, y double, z double, has_ca boolean")


def test_grid_equals_brute_force(spark):
    rows, df = _cloud(spark, [300, 40, 3], 12.0)
    got = {(r.chain_key, r.i, r.j) for r in pairs.pair_distances(df, 7.5).collect()}
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[5] and b[5]
            and np.linalg.norm(np.subtract(a[2:5], b[2:5])) < 7.5}
    assert got == want


@pytest.mark.parametrize("radius", [2.0, 9.0, 1000.0])
def test_knn_ways_agree(spark, radius):
    """The radius only moves work between the grid and the blocks."""
    rows, df = _cloud(spark, [60, 25, 4], 9.0)
    got = {(r.chain_key, r.src): [] for r in df.selectExpr("chain_key", "pos as src").collect()}
    for r in graph.knn_edges(df, 6, radius=radius).orderBy("chain_key", "src", "dist", "dst").collect():
        got[r.chain_key, r.src].append(r.dst)
    for a in rows:
        ranked = []
        for b in rows:
            if a[0] == b[0]:
                far = 1e8 + 1e6 * abs(a[1] - b[1])
                ranked.append((float(np.sqrt(np.sum(np.subtract(a[2:5], b[2:5]) ** 2) + 1e-8)) if a[5] and b[5] else far, b[1]))
        assert got[a[0], a[1]] == [d for _, d in sorted(ranked)[:6]]


def test_rings_stay_near_linear(spark, monkeypatch):
    """Scattered points and a radius far too small: neighbours met per residue do not grow with the chain."""
    met, ring = [], graph._ring

    def counted(*args):
        out = ring(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(graph, "_ring", counted)
    per_node = []
    for n in (400, 1600):
        met.clear()
        _, df = _cloud(spark, [n], 4.0 * n ** (1 / 3))
        edges = graph.knn_edges(df, 6, radius=0.05)
        assert edges.count() == 6 * n
        per_node.append(sum(met) / n)
    assert per_node[1] < 1.5 * per_node[0] and per_node[1] < 200


def test_knn_without_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("c", 0, 0.0, 0.0, 0.0, True), ("c", 1, nan, 0.0, 0.0, True), ("c", 2, inf, 0.0, 0.0, True), ("c", 3, None, None, None, False), ("c", 4, 1.0, 0.0, 0.0, True),
            ("d", 0, nan, nan, nan, True)]
    df = spark.createDataFrame(rows, "chain_key string, pos int, x double, y double, z double, has_ca boolean")
    got = {}
    for r in graph.knn_edges(df, 3).orderBy("chain_key", "src", "dist", "dst").collect():
        got.setdefault((r.chain_key, r.src), []).append((r.dst, r.resolved))
    assert got[("c", 0)] == [(0, True), (4, True), (1, False)] and got[("c", 1)] == [(1, False), (0, False), (2, False)]
    assert got[("d", 0)] == [(0, False)]


def _vectors(spark, n, dims=8, groups=5, seed=2, duplicates=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims)) * 3
    data = [(centres[k % 4] * (k % 3 > 0) + rng.normal(size=dims)).tolist() for k in range(n - duplicates)]
    data += [data[0]] * duplicates  # many copies of one vector
    rows = [(f"g{k % groups if k % 3 else 0}_{k:04d}", f"g{k % groups if k % 3 else 0}", v) for k, v in enumerate(data)]
    return rows, spark.createDataFrame(rows, "chain_key string, pdb_id string, emb array<double>")


def _brute(rows, k, exclude=True):
    m = np.array([r[2] for r in rows])
    m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    sims = np.round(m @ m.T, 9)
    out = {}
    for q, row in enumerate(rows):
        ranked = sorted((-sims[q, t], other[0]) for t, other in enumerate(rows) if not exclude or other[1] != row[1])
        out[row[0]] = [(key, -s) for s, key in ranked[:k]]
    return out


@pytest.mark.parametrize("block", [retrieve.BLOCK, 90])
@pytest.mark.parametrize("exclude", [True, False])
def test_topk_equals_brute_force(spark, block, exclude):
    rows, df = _vectors(spark, 700, duplicates=200)
    got = {}
    for r in retrieve.topk_similar(df, df, 4, exclude, block=block).orderBy("query_key", "rank").collect():
        got.setdefault(r.query_key, []).append((r.tpl_key, r.sim))
        if exclude:
            assert not r.same_group
    want = _brute(rows, 4, exclude)
    assert set(got) == set(want)
    for key in want:
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in want[key]], abs=2e-9)
        gap = min((a[1] - b[1] for a, b in zip(want[key], want[key][1:])), default=1)
        if gap > 1e-8 or gap == 0:
            assert [t for t, _ in got[key]] == [t for t, _ in want[key]]


def test_topk_small_index_returns_fewer(spark):
    rows, df = _vectors(spark, 6, groups=2)
    got = retrieve.topk_similar(df, df, 4).groupBy("query_key").count().collect()
    want = {k: len(v) for k, v in _brute(rows, 4).items() if v}
    assert {r.query_key: r["count"] for r in got} == want


def _clustered(spark, clusters, per, dims=16, spread=0.02):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters, dims))
    rows = [(f"k{c}_{n:03d}", f"g{n % 9}", (centres[c] + rng.normal(size=dims) * spread).tolist()) for c in range(clusters) for n in range(per)]
    return rows, spark.createDataFrame(rows, "chain_key string, pdb_id string, emb array<double>").repartition(4)


@pytest.mark.parametrize("exclude", [True, False])
def test_pairs_of_blocks_are_skipped_where_vectors_cluster(spark, exclude):
    rows, df = _clustered(spark, 12, 60)
    index = retrieve.blocks(retrieve.scaled(df), 40)
    _, plan = retrieve.search_plan(index, index, 4, exclude)
    pairs, compared = plan.agg(F.count(F.lit(1)), F.count_if("compared")).first()
    assert pairs == index.count ** 2 and compared < 0.4 * pairs
    assert plan.groupBy("q", "t").count().filter("count > 1").count() == 0  # a vector is sent once per block of the other side
    got = {}
    for r in retrieve.topk_similar(df, df, 4, exclude, block=40).orderBy("query_key", "rank").collect():
        got.setdefault(r.query_key, []).append((r.tpl_key, r.sim))
    want = _brute(rows, 4, exclude)
    assert {q: [t for t, _ in hits] for q, hits in got.items()} == {q: [t for t, _ in hits] for q, hits in want.items()}


def test_blocks_meet_in_cells(spark):
    """A query leaves a cell with its best of all blocks there, not with the best of each block."""
    rows, df = _vectors(spark, 400, groups=7)
    index = retrieve.blocks(retrieve.scaled(df), 15)
    every = retrieve.block_pairs(index, index)
    hits = retrieve._compare(every, index, index, 4, True)
    assert index.count > 16 and hits.count() < 400 * 4 * index.count / 4
    best = retrieve._merge(hits, 4).select("query_key", "tpl_key").collect()
    assert {tuple(r) for r in best} == {(q, t) for q, found in _brute(rows, 4).items() for t, _ in found}


@pytest.mark.parametrize("copies", [0, 300])
def test_best_of_rows_equal_those_of_a_full_sort(copies):
    rng = np.random.default_rng(3)
    sims = rng.normal(size=(40, 1000))
    sims[:, 500:500 + copies] = 2.5
    sims[3, 7], sims[4] = -np.inf, -np.inf
    rows, cols, found = retrieve._row_best(sims, np.full(40, -np.inf), 4)
    want = [(r, c) for r in range(40) if r != 4 for c in sorted(range(1000), key=lambda c: (-round(sims[r, c], 9), c))[:4]]
    assert list(zip(rows.tolist(), cols.tolist())) == want


def test_block_bounds_hold(spark):
    rows, df = _clustered(spark, 5, 30, spread=0.4)
    made = retrieve.blocks(retrieve.scaled(df), 25)
    of = {r.block: np.frombuffer(r.matrix).reshape(r.n, -1) for r in made.table.collect()}
    assert sum(map(len, of.values())) == len(rows)
    for r in retrieve.block_pairs(made, made).collect():
        assert (of[r.q] @ of[r.t].T).max() <= r.bound


def test_empty_search(spark):
    rows, df = _vectors(spark, 6, groups=2)
    assert retrieve.topk_similar(df, df.limit(0), 4).count() == retrieve.topk_similar(df.limit(0), df, 4).count() == 0


PYTHON_QUERIES = {"token_batches", "embed_stub", "embed_tokens", "topk_similar", "topk_blocked", "topk_other", "hit_weights", "index_build", "aligned_positions", "align_pairs", "align_tiles", "align_turns",
                  "transfer_e2e", "ingest_stream", "pair_classifier", "predict_pairs", "predict_proof"}


load_all()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_QUERIES))
def test_plan_is_declarative(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert not re.search(r"MapInPandas|BatchEvalPython|ArrowEvalPython|FlatMapGroups", plan)


def test_library_keeps_data_distributed():
    """Nothing is gathered to the driver; the optional corpus operators have tests of their own."""
    for path in ROOT.rglob("*.py"):
        if "llm" in path.parts:
            continue
        text = path.read_text()
        assert "crossJoin" not in text and "localCheckpoint" not in text and ".collect()" not in text and ".rdd" not in text, path
        assert "toPandas()" not in text, path


def _matrix(residues, count, channels, seed=8):
    """Rows of one long and one short chain, some repeated, some without an end, a chain or a value."""
    rng = np.random.default_rng(seed)
    rows = []
    for chain, size, n in (("a", residues, count), ("b", 9, 20)):
        for i, j in rng.integers(0, size, (n, 2)):
            rows += [(chain, c, int(min(i, j)), int(max(i, j)), float(rng.integers(1, 9))) for c in range(channels)]
    rows += rows[:50] + [("a", 0, None, 3, 2.0), ("a", 0, 140, None, 5.0), (None, 0, 1, 2, 7.0), ("a", 0, 5, 130, None), ("b", None, 1, 2, 3.0)]
    return rows


@pytest.mark.parametrize("channels", [1, 3])
def test_background_correction_of_a_long_chain(spark, channels):
    """Blocks of one chain are dealt to all tasks; the rows equal the plain way, and the pairs are shuffled once."""
    rows = _matrix(700, 6000, channels)
    df = spark.createDataFrame(rows, "chain_key string, channel int, i int, j int, x double")
    out = pairs.apc(df, keys=("chain_key", "channel"), tasks=6)
    got = out.select("*", F.spark_partition_id().alias("task")).collect()
    ends, total = {}, {}
    for chain, c, i, j, x in rows:
        for end in (i, j):
            ends[chain, c, end] = ends.get((chain, c, end), 0) + (x or 0)
            total[chain, c] = total.get((chain, c), 0) + (x or 0)
    want = [(a, c, i, j, x and x - ends[a, c, i] * ends[a, c, j] / total[a, c]) for a, c, i, j, x in rows if None not in (a, c, i, j)]
    key = lambda r: (*r[:4], r[4] is None, r[4] or 0)
    assert [tuple(r)[:5] for r in sorted(got, key=key)] == [pytest.approx(r) for r in sorted(want, key=key)]
    share = [sum(r.task == t for r in got) for t in range(6)]
    assert max(share) < len(got) / 2 and sum(s > 0 for s in share) >= 5
    places = {}
    for r in got:
        places.setdefault((r.chain_key, r.i, r.j), set()).add(r.task)
    assert all(len(tasks) == 1 for tasks in places.values())  # a pair's channels meet without another shuffle of each
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["apc", "logistic_score"])
def test_pairs_of_a_query_are_dealt_by_their_number(spark, sf_dir, monkeypatch, name):
    """Tasks grow with the rows, so that none does; a channel is a row more."""
    assert tasks_for(spark.range(2_100_000)) == 5 and tasks_for(spark.range(10)) == 4
    monkeypatch.setattr(proxies, "pair_tasks", lambda spark, d: 23)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 23), REPARTITION_BY_NUM") >= 3


def test_weights_move_to_the_channels(spark):
    """Joined on the channel by a shuffle, all pairs would land in as many tasks as there are channels."""
    features = spark.createDataFrame([("a", c, 0, 1, 0.5) for c in range(3)], "chain_key string, channel int, i int, j int, x double")
    weights = spark.createDataFrame([(0, 1.5), (1, -0.7), (2, 0.4)], "channel int, w double")
    out = pairs.logistic_score_long(features, weights, -0.25)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(channel" not in plan
    assert out.first().score == pytest.approx(1 / (1 + np.exp(-0.35)))


@pytest.mark.parametrize("scores", ["random", "equal", "few"])
def test_sums_of_best_sort_only_around_the_places(spark, scores):
    rng = np.random.default_rng(6)
    p = {"random": rng.normal(size=3000), "equal": np.zeros(3000), "few": rng.choice([0.1, 0.5], 3000)}[scores]
    rows = [("c" if k % 3 else "d", float(p[k]), k // 60, k % 60, int(rng.integers(0, 2))) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, p double, i int, j int, y int")
    places = {"c": (0, 1, 7, 400, 2000), "d": (3, 0, 1000, 2, 999), "none": (1, 2, 3, 4, 5)}
    names = [f"n{k}" for k in range(5)]
    wanted = spark.createDataFrame([(g, f"{g}!", *ns) for g, ns in places.items()], ["g", "extra", *names])
    for limit in (20, 1500, 10_000):
        for row in sums_of_best(df, "g", wanted, names, ["p", "i", "j"], "y", limit=limit, digits=8).collect():
            best = sorted((r for r in rows if r[0] == row.g), key=lambda r: (-r[1], r[2], r[3]))
            assert row.extra == f"{row.g}!" and [row[n] for n in names] == [sum(r[4] for r in best[:n]) for n in places[row.g]]


def _bent(rng, n, dims=12):
    """Vectors with few large directions and many small ones, some far off, most with a close neighbour."""
    spread = 0.4 ** np.arange(dims)
    near = 1 + rng.normal(size=(n // 2, dims)) * spread
    m = np.vstack([near, near[:n - n // 2] + rng.normal(size=(n - n // 2, dims)) * 0.01 * spread])
    m[::97] = rng.normal(size=m[::97].shape)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_leaves_out_of_reach_are_not_multiplied(monkeypatch):
    """Once a query has its hits, only leaves of the next block that may beat them are; the rows are those of a full sort."""
    rng = np.random.default_rng(9)
    m = _bent(rng, 4000)
    side = lambda b, at: retrieve._Side(b, pa.array([f"{k:05d}" for k in at]), np.array(at) % 5, m[at])
    formed, similar = [], retrieve._Asked._similar

    def counted(*args):
        formed.append(len(args[0]) * len(args[2]))
        return similar(*args)

    monkeypatch.setattr(retrieve._Asked, "_similar", staticmethod(counted))
    asked = list(range(0, 4000, 4))
    one = retrieve._Asked(side(0, asked), [0, 1], np.full(len(asked), -np.inf), 4)
    one.meet(side(0, list(range(2000))), True)
    first = sum(formed)
    one.meet(side(1, list(range(2000, 4000))), True)
    assert first == 1000 * 2000 and sum(formed) - first < 0.25 * first
    sims = np.round(m[asked] @ m.T, 9)
    sims[np.array(asked)[:, None] % 5 == np.arange(4000) % 5] = -np.inf
    got = {}
    for batch in one.hits():
        for r in batch.to_pylist():
            got.setdefault(r["query_key"], []).append((-r["sim"], r["tpl_key"]))
    for row, q in zip(sims, asked):
        want = [(-row[c], f"{c:05d}") for c in sorted(range(4000), key=lambda c: (-row[c], c))[:4]]
        assert sorted(got[f"{q:05d}"])[:4] == want


def test_boxes_of_leaves_hold():
    rng = np.random.default_rng(4)
    m, q = _bent(rng, 900), _bent(rng, 300)
    q[5], m[7] = 0, 0
    leaves = retrieve._Leaves(m, 50, 3)
    assert sorted(np.concatenate(leaves.places).tolist()) == list(range(900)) and max(map(len, leaves.places)) <= 50
    for floor in (-np.inf, -1.0, 0.5, 0.999, 1.0):
        reached = leaves.reach(q, np.full(300, floor), step=128)
        for places, some in zip(leaves.places, reached):
            assert not ((q @ m[places].T).max(axis=1) >= floor)[~some].any()


@pytest.mark.parametrize("exclude", [True, False])
def test_topk_through_leaves_equals_brute_force(spark, exclude):
    """Blocks of several leaves; with copies, vectors without a number, keys that come twice and queries without a key."""
    rng = np.random.default_rng(12)
    m = _bent(rng, 1600)
    m[300:420], m[9], m[11] = m[300], np.nan, 0
    rows = [(f"k{k:04d}", f"g{k % 7}", v.tolist()) for k, v in enumerate(m)]
    asked = rows + [("k0020", "g1", rows[1500][2]), ("k0020", "g2", rows[1][2]), (None, "g3", rows[40][2]), (None, None, rows[41][2])]
    schema = "chain_key string, pdb_id string, emb array<double>"
    index, queries = spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)
    unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    groups, want = np.array([r[1] for r in rows]), {}
    for key, group, v in asked:
        sims = np.round(unit @ (np.array(v) / (np.linalg.norm(v) + 1e-8)), 9)
        kept = np.isfinite(sims) & ((groups != group) | (not exclude))
        want.setdefault(key, []).extend((-sims[t], rows[t][0]) for t in np.flatnonzero(kept))
    got = {}
    for r in retrieve.topk_similar(queries, index, 4, exclude, block=500).collect():
        got.setdefault(r.query_key, []).append((r["rank"], -r.sim, r.tpl_key))
    for key, all_of in want.items():
        best = sorted(all_of)[:4]
        assert [s for _, s, _ in sorted(got.get(key, []))] == pytest.approx([s for s, _ in best], abs=2e-9), key
        if sorted({round(s, 8) for s, _ in sorted(all_of)[:5]}) == sorted(round(s, 8) for s, _ in sorted(all_of)[:5]):
            assert [t for _, _, t in sorted(got.get(key, []))] == [t for _, t in best], key
