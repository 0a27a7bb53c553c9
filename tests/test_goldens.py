"""Small cases worked out by hand from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.functions import scalars as S
from foldlake.functions import vectors as V
from foldlake.operators import batching, embed, evaluate, geometry, graph, losses, pairs, retrieve, runs, splits


@pytest.fixture(scope="module")
def hairpin(spark):
    rows = [("c", k, 3.8 * k, 0.0, 0.0, True) if k < 6 else ("c", k, 3.8 * (11 - k), 5.0, 0.0, True) for k in range(12)]
    return spark.createDataFrame(rows, "chain_key string, pos int, x double, y double, z double, has_ca boolean")


def test_contacts(hairpin):
    got = {(r.i, r.j): round(r.dist, 4) for r in pairs.contacts(hairpin).collect()}
    assert got == {(0, 10): 6.2801, (0, 11): 5.0, (1, 9): 6.2801, (1, 10): 5.0, (1, 11): 6.2801, (2, 8): 6.2801, (2, 9): 5.0,
                   (2, 10): 6.2801, (3, 9): 6.2801}


def test_contact_distance_is_strict(hairpin):
    assert pairs.contacts(hairpin, cutoff=5.0).count() == 0


def test_matrix_rows(spark, hairpin):
    windows = spark.createDataFrame([("c", 1, 12)], "chain_key string, crop_start int, crop_end int")
    rows = {r.i: r for r in pairs.matrix_rows(pairs.contacts(hairpin), windows).collect()}
    assert rows[0].partners == [10, 11] and rows[0].cells is None
    assert rows[11].partners == [0, 1] and rows[11].cells == [1] + [0] * 10
    assert {r.i: r.partners for r in pairs.matrix_rows(pairs.contacts(hairpin)).collect()} == {i: r.partners for i, r in rows.items()}


def test_relpos(spark):
    d = [0, 1, 5, 6, 8, 9, 12, 13, 64, 65, 200]
    df = spark.createDataFrame([(0, x) for x in d], "i int, j int")
    assert [r[0] for r in df.select(S.relpos_bucket(F.col("i"), F.col("j"))).collect()] == [0, 1, 5, 6, 6, 7, 7, 8, 12, 13, 13]


def test_length_bins(spark):
    df = spark.createDataFrame([(f"k{n}", n, n) for n in range(20, 120, 10)], "chain_key string, L int, doc_id int")
    assert batching.length_edges(df) == [38, 56, 74, 92]
    assert [r.bin for r in batching.length_bins(df).orderBy("L").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.fixture(scope="module")
def six(spark):
    rows = [("val", "c", 0, 10 + k, p, y, True) for k, (p, y) in enumerate(zip((.9, .8, .7, .6, .4, .3), (1, 1, 0, 1, 0, 1)))]
    return spark.createDataFrame(rows, "split string, chain_key string, i int, j int, p double, y int, valid boolean")


def test_threshold_sweep(six):
    best = evaluate.best_threshold(evaluate.threshold_curve(six)).first()
    assert best.tau == 0.05 and best.f1 == pytest.approx(0.8)


def test_threshold_without_positives(six):
    curve = evaluate.threshold_curve(six.withColumn("y", F.lit(0)))
    assert curve.count() == 19 and evaluate.best_threshold(curve).first().tau == 0.5


def test_pr_curve(six):
    got = [(round(r.precision, 4), round(r.recall, 4)) for r in evaluate.pr_curve(six).orderBy("rank").collect()]
    assert got == [(1, .25), (1, .5), (.6667, .5), (.75, .75), (.6, .75), (.6667, 1)]


def test_losses(six):
    assert losses.tversky(six).first()[0] == pytest.approx(0.313984, abs=1e-6)
    assert losses.bce_balanced(six).first()[0] == pytest.approx(0.435195, abs=1e-6)
    both = losses.total_loss(six).first()
    assert both.loss == pytest.approx(0.435195 + 0.3 * 0.313984, abs=1e-6)


def test_hit_weights(spark):
    hits = spark.createDataFrame([("q", f"t{k}", s) for k, s in enumerate((.9, .8, .5, .1))], "query_key string, tpl_key string, sim double")
    got = [r.weight for r in retrieve.hit_weights(hits).orderBy("tpl_key").collect()]
    assert got == pytest.approx([.330635, .299171, .221631, .148564], abs=1e-6)


def test_apc(spark):
    upper = spark.createDataFrame([("c", 0, 1, 1.0), ("c", 0, 2, 2.0), ("c", 1, 2, 3.0)], "chain_key string, i int, j int, x double")
    got = {(r.i, r.j): round(r.x, 4) for r in pairs.mirror(pairs.apc(upper)).collect()}
    assert got == {(0, 1): 0, (1, 0): 0, (0, 2): .75, (2, 0): .75, (1, 2): 1.3333, (2, 1): 1.3333}


def test_symmetrize(spark):
    df = spark.createDataFrame([("c", 0, 1, 1.0), ("c", 1, 0, 3.0), ("c", 2, 2, 5.0)], "chain_key string, i int, j int, x double")
    assert {(r.i, r.j): r.x for r in pairs.symmetrize(df).collect()} == {(0, 1): 2.0, (2, 2): 5.0}
    assert {(r.i, r.j): r.x for r in pairs.symmetrize(df, "sum").collect()} == {(0, 1): 4.0, (2, 2): 10.0}


def test_dihedral_quarter_turns(spark):
    """N, CA, C of one residue and the next N span a right angle."""
    def p(*v):
        return dict(zip("xyz", map(float, v)))

    schema = "chain_key string, pos int, " + ", ".join(f"{a} struct<x:double,y:double,z:double>" for a in ("n", "ca", "c"))
    for sign in (1, -1):
        rows = [("c", 0, p(1, 0, 0), p(0, 0, 0), p(0, 1, 0)), ("c", 1, p(0, 1, sign), p(0, 2, sign), p(0, 3, sign))]
        out = geometry.dihedrals(spark.createDataFrame(rows, schema)).filter("pos = 0").first()
        assert out.sin_psi == pytest.approx(-sign, abs=1e-6) and out.cos_psi == pytest.approx(0, abs=1e-6)
        assert (out.cos_phi, out.sin_phi) == (1.0, 0.0)


def test_binned(spark):
    df = spark.createDataFrame([([0.0, 0.0, math.log(2.0), 0.0],)], "l array<double>")
    row = df.select(S.binned_mean(F.col("l"), 0.0, 1.0, 4), S.binned_logprob(F.col("l"), F.lit(0.5), 0.0, 1.0, 4)).first()
    assert row[0] == pytest.approx((0.125 + 0.375 + 2 * 0.625 + 0.875) / 5)
    assert row[1] == pytest.approx(math.log(1 / 5))  # 0.375 and 0.625 tie, the first wins


def test_split_rounds_half_to_even(spark):
    ids = spark.range(25).selectExpr("cast(id as string) as pdb_id")
    assert splits.split_ids(ids, 0.1).filter("split = 'val'").count() == 2
    assert splits.split_ids(ids.limit(2), 0.1).filter("split = 'val'").count() == 1


def test_random_crop(spark):
    df = spark.createDataFrame([("1ABC", 256 + 56), ("short", 10)], "chain_key string, L int")
    got = {r.chain_key: (r.crop_start, r.crop_end) for r in pairs.crop_windows(df, 256, "random", 42).collect()}
    assert got == {"1ABC": (29, 285), "short": (0, 10)}


@pytest.mark.parametrize("limit", [1 << 16, 5])
def test_precision_equals_mirrored_ranking(spark, limit):
    rng = np.random.default_rng(5)
    rows = [("s", f"c{c}", i, j, float(rng.random()), int(rng.random() < .3), bool(rng.random() < .8))
            for c in range(4) for i in range(70 + c) for j in range(i + 1, 70 + c) if rng.random() < .2 + .2 * c]
    df = spark.createDataFrame(rows, "split string, chain_key string, i int, j int, p double, y int, valid boolean")
    got = {r.chain_key: r for r in evaluate.precision_at_k(df, limit=limit).collect()}
    for c in range(4):
        entries = [(-p, i, j, o, y) for _, k, i, j, p, y, v in rows if k == f"c{c}" and v for o in (0, 1)]
        entries.sort()
        lb = len({e for _, i, j, _, _ in entries for e in (i, j)})
        for name, k in (("p_at_l", lb), ("p_at_l2", max(1, lb // 2)), ("p_at_l5", max(1, lb // 5))):
            top = entries[:k]
            assert got[f"c{c}"][name] == pytest.approx(sum(e[4] for e in top) / len(top))


def test_early_stop(spark):
    values = [1, 3, 3, 2, 2, 2, 2, 9]
    df = spark.createDataFrame([("r", e, "m", float(v)) for e, v in enumerate(values)], "run_id string, epoch int, metric string, value double")
    assert runs.early_stop(df, "m", 5).first().stop_epoch == 6
    assert runs.early_stop(df, "m", 6).first().stop_epoch is None
    assert runs.best_epoch(df, "m").first().best_epoch == 7
    with pytest.raises(ValueError):
        runs.best_epoch(df, "other")


def test_unit_handles_missing(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (0.0, 0.0, 0.0)], "v_x double, v_y double, v_z double")
    rows = df.select(V.as_struct(V.unit(V.named("v"))).alias("u")).collect()
    assert all(r.u.x == 0.0 for r in rows)


def test_mean_pool_without_valid_tokens(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0], True), ("a", [3.0, 5.0], True), ("a", [9.0, 9.0], False), ("b", [7.0, 7.0], False)],
                               "chain_key string, vec array<double>, ok boolean")
    assert {r.chain_key: r.emb for r in embed.mean_pool(df, valid="ok").collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}


def test_chunk_pool_ignores_chunk_size(spark):
    df = spark.createDataFrame([("a", 0, [0.0]), ("a", 0, [2.0]), ("a", 1, [5.0])], "chain_key string, chunk_no int, vec array<double>")
    assert embed.chunk_pool(df).first().emb == [3.0]


def test_unresolved_edges_take_the_mean_direction(spark):
    points = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0, True), ("c", 1, 2.0, 0.0, 0.0, True), ("c", 2, None, None, None, False)],
                                   "chain_key string, pos int, x double, y double, z double, has_ca boolean")
    edges = spark.createDataFrame([("c", 1, 0, 2.0, True), ("c", 0, 2, 1.02e8, False)],
                                  "chain_key string, src int, dst int, dist double, resolved boolean")
    rows = {(r.src, r.dst): r for r in graph.edge_features(edges, points, drop_unresolved=False).collect()}
    assert rows[0, 2].u.x == pytest.approx(1.0) and rows[0, 2].dst_missing == 1 and rows[0, 2].rbf == [0.0] * 16
    assert graph.edge_features(edges, points).count() == 1


def test_empty_index_is_an_error(spark):
    table = spark.createDataFrame([("p_A", "p", 3)], "chain_key string, pdb_id string, L int")
    with pytest.raises(ValueError, match="index is empty"):
        embed.require_rows(embed.build_index(table, table.select("pdb_id")))


def test_stored_split_is_reused(spark, tmp_path):
    ids = spark.range(40).selectExpr("cast(id as string) as pdb_id")
    tag = splits.split_tag(0.1, 42, 20)
    assert tag == "val10_seed42_min20"
    first = splits.named_split(spark, str(tmp_path), tag, ids)
    again = splits.named_split(spark, str(tmp_path), tag, ids.limit(3))
    assert sorted(first.collect()) == sorted(again.collect()) and again.count() == 40
    given = ids.selectExpr("pdb_id", "'test' as split")
    assert splits.named_split(spark, str(tmp_path), tag, ids, lists=given).filter("split = 'test'").count() == 40
