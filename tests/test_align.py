"""Alignment, tokens and transfer invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldlake.operators import align as A
from foldlake.operators import tokens as K
from foldlake.operators import transfer as T
from foldlake.operators.align_tiles import _frames, align_long


def plain_score(a, b, gap=2):
    known = set(A.AMINO_ACIDS)
    h = [[-gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [-gap * i]
        for j, y in enumerate(b, 1):
            s = 0 if x not in known or y not in known else (1 if x == y else -1)
            row.append(max(h[-1][j - 1] + s, h[-1][j] - gap, row[-1] - gap))
        h.append(row)
    return h[-1][-1]


def check(a, b, done):
    q, t, score = done
    assert q.replace("-", "") == a and t.replace("-", "") == b and len(q) == len(t)
    assert not any(x == y == "-" for x, y in zip(q, t))
    assert score == plain_score(a, b)


texts = st.text(alphabet="ACDEXU", max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=6))
def test_alignments(pairs):
    for (a, b), many in zip(pairs, A.align_many(pairs)):
        one = A.align(a, b)
        check(a, b, one)
        assert one == many  # both ways take the same path back


def test_long_pairs_take_little_memory():
    rng = np.random.default_rng(0)
    a = "".join(rng.choice(list("ACDE"), 3000))
    b = a[:1000] + a[1100:]
    q, t, score = A.align(a, b)
    assert score == 2900 - 200 and q == a and t.replace("-", "") == b


def test_jvm_score_and_rescore(spark):
    pairs = [("ACDEFG", "ACEFG", 3), ("GATTACA", "GCATGCG", -1), ("A", "ACD", -3), ("", "AC", -4), ("AU", "AU", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    for row in df.withColumn("got", A.align_score(F.col("a"), F.col("b"))).collect():
        assert row.got == row.want == plain_score(row.a, row.b)
    done = [A.align(a, b) for a, b, _ in pairs]
    gapped = spark.createDataFrame(done, "q string, t string, score int")
    assert all(r.s == r.score for r in gapped.withColumn("s", A.rescore(F.col("q"), F.col("t"))).collect())


def test_positions_rise(spark):
    done = A.align("ACDEFGHIK", "ADEFWGHK")
    df = spark.createDataFrame([("q", "t", *done)], "query_key string, tpl_key string, q_aln string, t_aln string, score int")
    rows = A.aligned_positions(df).orderBy("qpos").collect()
    assert all(a.qpos < b.qpos and a.tpos < b.tpos for a, b in zip(rows, rows[1:]))
    assert all("ACDEFGHIK"[r.qpos] == r.q_aa and "ADEFWGHK"[r.tpos] == r.t_aa for r in rows)


def test_cigar(spark):
    df = spark.createDataFrame([("k", "2M1I1D1=3D1X")], "key string, cigar string")
    assert sorted((r.qpos, r.tpos) for r in A.cigar_positions(df).collect()) == [(0, 0), (1, 1), (3, 3), (4, 7)]


def test_projection_modes(spark):
    aligned = spark.createDataFrame([("q", "t", 0, 0, "W", "W"), ("q", "t", 8, 9, "W", "W"), ("q", "t", 9, 10, "C", "C")],
                                    "query_key string, tpl_key string, qpos int, tpos int, q_aa string, t_aa string")
    contacts = spark.createDataFrame([("t", 0, 9)], "chain_key string, i int, j int")
    asked = spark.createDataFrame([("q", "t", 0, 8), ("q", "t", 0, 9), ("q", "t", 0, 5)], "query_key string, tpl_key string, i int, j int")

    def values(df):
        return {(r.i, r.j): round(r.value, 4) for r in df.collect()}

    assert values(T.project_onto(asked, aligned, contacts)) == {(0, 8): 1, (0, 9): 0, (0, 5): -1}
    scores = T.blosum62(spark)
    onto = T.project_onto(asked, aligned, contacts, scores)
    assert values(onto) == {(0, 8): 1.0, (0, 9): round(-2 / 15, 4), (0, 5): 0}
    kept = T.evidence(onto, positive_only=True, use_blosum=True).filter("flag = 1").collect()
    assert [(r.i, r.j) for r in kept] == [(0, 8)]  # only W with W reaches exactly 1
    assert values(T.project(aligned, contacts, scores)) == {(0, 8): 1.0}


def test_blosum_is_symmetric(spark):
    table = {(r.a, r.b): r.score for r in T.blosum62(spark).collect()}
    assert len(table) == 400 and table["W", "W"] == 11 and table["E", "D"] == table["D", "E"] == 2
    assert all(table[a, b] == table[b, a] for a, b in table)


def test_prior_stays_in_bounds(spark, sf_dir):
    import __spark_entry__ as entry
    row = entry.queries()["transfer_e2e"](spark, sf_dir).agg(F.min("prior"), F.max("prior"), F.min(F.col("j") - F.col("i"))).first()
    assert row[0] > 0 and row[1] <= 1.0 and row[2] >= 6


def test_vocabulary():
    ids = K.token_ids("base")
    assert len(ids) == 35 and ids["<null_0>"] == 0 and ids["L"] == 4 and ids["<null_1>"] == 31 and ids["<cls>"] == 32
    assert K.token_ids("roberta")["<mask>"] == 32


def test_encode(spark):
    df = spark.createDataFrame([("k", "LAJ"), ("m", "LA-"), ("e", "")], "chain_key string, seq string")
    rows = {r.chain_key: r.tokens for r in K.encode(df).collect()}
    assert rows == {"k": None, "m": [0, 4, 5, 30, 2], "e": [0, 2]}
    good, bad = K.split_unknown(K.encode(df, "base", max_len=1))
    assert {r.chain_key: r.tokens for r in good.collect()} == {"m": [32, 4], "e": [32]} and bad.count() == 1


def greedy(sizes, budget):
    batches, current = [], []
    for s in sorted(sizes):
        if current and s * (len(current) + 1) > budget:
            batches.append(current)
            current = []
        current.append(s)
    return batches + [current]


@pytest.mark.parametrize("partitions, adaptive", [(1, "true"), (16, "true"), (16, "false")])
def test_token_batches(spark, partitions, adaptive):
    """The greedy result, whatever the partitions and settings."""
    rng = np.random.default_rng(4)
    rows = [(f"k{n:03d}", "A" * int(rng.integers(1, 80))) for n in range(200)] + [("big", "A" * 500)]
    df = spark.createDataFrame(rows, "chain_key string, seq string").repartition(partitions)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        out = K.token_batches(df, 300, extra=2).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(out["key"]) == sorted(r[0] for r in rows)
    got = [sorted(b["size"].tolist()) for _, b in out.groupby("batch_no")]
    assert got == greedy([len(s) + 2 for _, s in rows], 300)


def test_transfer_equals_brute_force(spark, sf_dir):
    """Hits, alignments, projection and vote of a few chains, once more in plain Python."""
    from foldlake.operators import pairs as B
    from foldlake.operators.chains import all_chains
    from foldlake.plans import proxies as P
    from foldlake.plans.transfer import chain_index

    seqs = {r.chain_key: r.seq for r in all_chains(P.points(spark, sf_dir)).collect()}
    found = B.contacts(P.points(spark, sf_dir))
    contacts = {}
    for r in found.collect():
        contacts.setdefault(r.chain_key, []).append((r.i, r.j))
    index = chain_index(spark, sf_dir)
    vectors = {r.chain_key: np.array(r.emb) / np.linalg.norm(r.emb) for r in index.collect()}
    want = {}
    for q in vectors:
        hits = sorted(((-float(vectors[q] @ v), t) for t, v in vectors.items() if t.split("_")[0] != q.split("_")[0]))[:4]
        e = np.exp(np.array([-s for s, _ in hits]) + hits[0][0])
        for (_, t), w in zip(hits, e / (e.sum() + 1e-8)):
            a, b, _ = A.align(seqs[q], seqs[t])
            back, i, j = {}, 0, 0
            for x, y in zip(a, b):
                if x != "-" and y != "-":
                    back[j] = i
                i, j = i + (x != "-"), j + (y != "-")
            for ti, tj in contacts.get(t, []):
                if ti in back and tj in back and abs(back[ti] - back[tj]) >= 6:
                    key = (q, min(back[ti], back[tj]), max(back[ti], back[tj]))
                    prior, count = want.get(key, (0.0, 0))
                    want[key] = (prior + w, count + 1)
    all_seqs = all_chains(P.points(spark, sf_dir)).select("chain_key", "seq")
    got = {(r.query_key, r.i, r.j): (r.prior, r.cnt) for r in T.transfer(index, index, all_seqs, found, min_sep=6).collect()}
    assert set(got) == set(want) and len(want) > 500
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-6)


def test_classifier_learns(spark, sf_dir):
    from foldlake.operators import model as M
    from foldlake.plans.runs import _features
    from foldlake.session import stored

    features = stored(_features(spark, sf_dir))
    scored = M.score_pairs(M.fit_pair_classifier(features), features).toPandas()
    assert scored["p"].between(0, 1).all() and len(scored) > 1000
    assert scored.loc[scored.y == 1, "p"].mean() > scored.loc[scored.y == 0, "p"].mean()


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_tiles_give_the_same_strings(spark, tile):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACDEXU"), n)) for n in (0, 1, 5, 7, 14, 20 if tile == 1 else 90, 3 if tile == 1 else 130)]
    table = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(seqs)], "chain_key string, seq string")
    pairs = spark.createDataFrame([(f"s{a}", f"s{b}") for a in range(len(seqs)) for b in range(len(seqs)) if tile > 1 or a + b < 8], "query_key string, tpl_key string")
    if tile == 1:
        pairs = pairs.filter("query_key < 's4' and tpl_key < 's4'")
    found = {(r.query_key, r.tpl_key): (r.q_aln, r.t_aln, r.score) for r in align_long(pairs, table, table, tile=tile).collect()}
    assert len(found) == pairs.count()
    for (q, t), done in found.items():
        assert done == A.align(seqs[int(q[1])], seqs[int(t[1])]), (q, t)


def test_tiles_of_a_long_pair(spark):
    rng = np.random.default_rng(5)
    a = "".join(rng.choice(list("ACDE"), 3000))
    b = a[:1200] + a[1300:]
    table = spark.createDataFrame([("a", a), ("b", b)], "chain_key string, seq string")
    row = align_long(spark.createDataFrame([("a", "b")], "query_key string, tpl_key string"), table, table, tile=600).first()
    assert (row.q_aln, row.t_aln, row.score) == A.align(a, b)


def test_small_tiles_share_a_frame():
    rows = [("a" * 10, k) for k in range(25)]
    frames = list(_frames(iter(rows), ["s", "k"], room=100))
    assert [len(f) for f in frames] == [10, 10, 5] and [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows
    assert len(list(_frames(iter(rows), ["s", "k"]))) == 1
