"""Queries on alignments and contact transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AMINO_ACIDS, blosum62_pairs
from ..functions.scalars import r6
from ..operators import align as A
from ..operators import chains as C
from ..operators import embed as E
from ..operators import pairs as B
from ..operators import retrieve as R
from ..operators import transfer as T
from ..operators.align_tiles import align_long
from . import proxies as P
from .pairs import ALL_NEAR_SQL, CONTACTS_SQL
from .registry import ORACLES, query


def chain_seqs(spark, d):
    return C.all_chains(P.points(spark, d)).select("chain_key", "pdb_id", "seq", "L")


# Candidates: every chain against the four that follow it; similarity falls with the gap.
def _candidates(spark, d):
    heads = P.table(spark, d, "embeddings").groupBy(F.expr("vec_id div 50").alias("c")).agg(
        F.concat(F.lit("P"), F.expr("c div 2").cast("string"), F.when(F.col("c") % 2 == 0, "_A").otherwise("_B")).alias("chain_key"))
    steps = heads.select(F.col("chain_key").alias("query_key"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"), "c")
    return steps.join(heads.select(F.col("chain_key").alias("tpl_key"), F.col("c").alias("t")), F.col("c") + F.col("step") == F.col("t")).select(
        "query_key", "tpl_key", "step", (0.9 - F.col("step") * 0.15).alias("sim"))


_CANDIDATES_SQL = """heads AS (SELECT DISTINCT vec_id // 50 AS c, 'P' || (vec_id // 100) ||
    CASE WHEN (vec_id // 50) % 2 = 0 THEN '_A' ELSE '_B' END AS chain_key FROM embeddings),
candidates AS (SELECT q.chain_key AS query_key, t.chain_key AS tpl_key, t.c - q.c AS step, (0.9::DOUBLE - (t.c - q.c) * 0.15::DOUBLE) AS sim
    FROM heads q JOIN heads t ON t.c - q.c BETWEEN 1 AND 4)"""


def _aligned(spark, d):
    """Stand-in alignment: positions moved by the gap between the chains, unresolved query residues unpaired."""
    q = P.points(spark, d).filter("has_ca").select(F.col("chain_key").alias("query_key"), F.col("pos").alias("qpos"), F.col("aa").alias("q_aa"))
    t = P.points(spark, d).select(F.col("chain_key").alias("tpl_key"), F.col("pos").alias("tpos"), F.col("aa").alias("t_aa"))
    moved = q.join(_candidates(spark, d), "query_key").withColumn(
        "tpos", (F.col("qpos") + F.col("step")).cast("int"))
    return moved.join(t, ["tpl_key", "tpos"]).select("query_key", "tpl_key", "qpos", "tpos", "q_aa", "t_aa")


_ALIGNED_SQL = f"""{CONTACTS_SQL}, {_CANDIDATES_SQL},
aligned AS (SELECT query_key, tpl_key, q.pos AS qpos, t.pos AS tpos, q.aa AS q_aa, t.aa AS t_aa FROM candidates
    JOIN points q ON q.chain_key = query_key JOIN points t ON t.chain_key = tpl_key AND t.pos = q.pos + step WHERE q.has_ca)"""
_BLOSUM_SQL = "blosum(ai, aj, score) AS (VALUES " + ", ".join(f"('{a}','{b}',{s})" for a, b, s in blosum62_pairs()) + ")"
_PROJECTED_SQL = f"""{_ALIGNED_SQL}, {_BLOSUM_SQL},
projected AS (SELECT a.query_key, a.tpl_key, least(a.qpos, b.qpos) AS i, greatest(a.qpos, b.qpos) AS j,
    (coalesce(score, 0) + 4) / 15.0::DOUBLE AS strength FROM contacts c JOIN aligned a ON a.tpl_key = c.chain_key AND a.tpos = c.i
    JOIN aligned b ON b.tpl_key = c.chain_key AND b.query_key = a.query_key AND b.tpos = c.j
    LEFT JOIN blosum s ON s.ai = a.t_aa AND s.aj = b.t_aa)"""


def _asked(spark, d):
    """Pairs whose projected value is asked for: the query's close pairs with each of its templates."""
    close = B.pair_distances(P.points(spark, d).withColumn("has_ca", F.lit(True)), 12.0)
    return close.select(F.col("chain_key").alias("query_key"), "i", "j").join(_candidates(spark, d).select("query_key", "tpl_key"), "query_key")


_ONTO_SQL = f"""{_ALIGNED_SQL}, {_BLOSUM_SQL}, {ALL_NEAR_SQL[len(P.POINTS_SQL) + 2:]},
onto AS (SELECT c.query_key, c.tpl_key, n.i, n.j, a.tpos IS NOT NULL AND b.tpos IS NOT NULL AS known, k.i IS NOT NULL AS hit,
    (coalesce(score, 0) + 4) / 15.0::DOUBLE AS strength FROM near n JOIN candidates c ON c.query_key = n.chain_key
    LEFT JOIN aligned a ON a.query_key = c.query_key AND a.tpl_key = c.tpl_key AND a.qpos = n.i
    LEFT JOIN aligned b ON b.query_key = c.query_key AND b.tpl_key = c.tpl_key AND b.qpos = n.j
    LEFT JOIN contacts k ON k.chain_key = c.tpl_key AND k.i = least(a.tpos, b.tpos) AND k.j = greatest(a.tpos, b.tpos)
    LEFT JOIN blosum s ON s.ai = a.t_aa AND s.aj = b.t_aa)"""


def contacts(spark, d):
    return B.contacts(P.points(spark, d))


def score_sql(pairs: str) -> str:
    """Alignment scores of pairs(id, a, b), row by row with a running maximum."""
    inside = "strpos('{0}', {1}) > 0".format(AMINO_ACIDS, "{0}")
    letter = (f"CASE WHEN NOT ({inside.format('s.a[s.i + 1]')} AND {inside.format('s.b[x]')}) THEN 0 "
              "WHEN s.a[s.i + 1] = s.b[x] THEN 1 ELSE -1 END")
    return f"""score_rows AS (SELECT id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: (-2 * x)::BIGINT) AS h FROM {pairs}
UNION ALL SELECT id, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda x: list_max(t[1:x + 1]) - 2 * x) FROM (
    SELECT id, a, b, i, list_transform(range(0, length(s.b) + 1), lambda x: CASE WHEN x = 0 THEN s.h[1] - 2 ELSE
        greatest(s.h[x] + {letter}, s.h[x + 1] - 2) END + 2 * x) AS t FROM score_rows s WHERE i < length(a)))"""


_CHAIN_PAIRS_SQL = f"""{P.POINTS_SQL}, {_CANDIDATES_SQL},
seqs AS (SELECT chain_key, string_agg(aa, '' ORDER BY pos) AS seq FROM points GROUP BY chain_key),
chain_pairs AS (SELECT query_key || '/' || tpl_key AS id, query_key, tpl_key, q.seq AS a, t.seq AS b FROM candidates
    JOIN seqs q ON q.chain_key = query_key JOIN seqs t ON t.chain_key = tpl_key)"""


def _checked(done, q_seqs, t_seqs):
    """Alignments with what must hold: the gapped strings spell the sequences and earn the score."""
    spelled = C.fetch(C.fetch(done, q_seqs.select("chain_key", F.col("seq").alias("q_seq")), "query_key"),
                      t_seqs.select("chain_key", F.col("seq").alias("t_seq")), "tpl_key")
    return spelled.select("query_key", "tpl_key", "score", A.rescore(F.col("q_aln"), F.col("t_aln")).alias("rescored"),
                          (F.replace("q_aln", F.lit("-"), F.lit("")) == F.col("q_seq")).alias("q_whole"),
                          (F.replace("t_aln", F.lit("-"), F.lit("")) == F.col("t_seq")).alias("t_whole"))


@query("align_pairs", f"""WITH RECURSIVE {_CHAIN_PAIRS_SQL}, {score_sql('chain_pairs')}
SELECT query_key, tpl_key, h[length(r.b) + 1]::INT AS score, h[length(r.b) + 1]::INT AS rescored, true AS q_whole, true AS t_whole
FROM score_rows r JOIN chain_pairs USING (id) WHERE i = length(r.a)""")
def align_pairs(spark, d):
    """Chains against their candidates. The gapped strings must spell the chains and earn the score."""
    seqs = chain_seqs(spark, d)
    return _checked(A.align_pairs(_candidates(spark, d), seqs, seqs), seqs, seqs)


@query("align_tiles", ORACLES["align_pairs"])
def align_tiles(spark, d):
    """The same pairs tile by tile, as pairs too long for one task are aligned."""
    seqs = chain_seqs(spark, d)
    return _checked(align_long(_candidates(spark, d), seqs, seqs, tile=16), seqs, seqs)


# Diagonal by diagonal: a cell needs the two diagonals before it, so a step is one list per pair.
@query("align_turns", f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, {P.clean_sql('text')} AS seq FROM conversations),
turn_pairs AS (SELECT q.conv_id || '_' || q.turn AS query_key, t.conv_id || '_' || t.turn AS tpl_key, string_split(q.seq, '') AS a, string_split(t.seq, '') AS b,
    length(q.seq) AS m, length(t.seq) AS n FROM turns q JOIN turns t ON t.conv_id = q.conv_id AND t.turn = q.turn + 1),
diagonals(query_key, d, a, b, m, n, h2, h1) USING KEY (query_key) AS (SELECT query_key, 0::BIGINT, a, b, m, n,
        list_transform(range(0, m + 1), lambda i: NULL::INT), list_transform(range(0, m + 1), lambda i: CASE WHEN i = 0 THEN 0 END) FROM turn_pairs
    UNION ALL SELECT query_key, d + 1, a, b, m, n, h1, list_transform(range(0, m + 1), lambda i: CASE WHEN i > d + 1 OR d + 1 - i > n THEN NULL ELSE greatest(
        CASE WHEN i > 0 AND i <= d THEN h2[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 1 ELSE -1 END END, CASE WHEN i > 0 THEN h1[i] - 2 END,
        CASE WHEN i <= d THEN h1[i + 1] - 2 END) END) FROM diagonals WHERE d < m + n)
SELECT query_key, tpl_key, h1[p.m + 1] AS score, h1[p.m + 1] AS rescored, true AS q_whole, true AS t_whole FROM diagonals JOIN turn_pairs p USING (query_key)""")
def align_turns(spark, d):
    """Every conversation turn against the next one, whole texts."""
    turns = P.table(spark, d, "conversations").select("conv_id", "turn", P.clean(F.col("text")).alias("seq"))
    keyed = turns.select(F.concat_ws("_", "conv_id", "turn").alias("chain_key"), "seq")
    pairs = turns.select(F.concat_ws("_", "conv_id", "turn").alias("query_key"),
                         F.concat_ws("_", F.col("conv_id"), F.col("turn") + 1).alias("tpl_key"))
    return _checked(A.align_pairs(pairs, keyed, keyed), keyed, keyed)


_NAME, _TYPE = "upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))", "upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g'))"


@query("align_score", f"""WITH RECURSIVE names AS (SELECT p_partkey AS id, {_NAME} AS a, {_TYPE} AS b FROM part), {score_sql('names')}
SELECT id AS p_partkey, h[length(b) + 1]::INT AS score FROM score_rows WHERE i = length(a)""")
def align_score(spark, d):
    letters = [F.upper(F.regexp_replace(c, "[^A-Za-z]", "")).alias(a) for c, a in (("p_name", "a"), ("p_type", "b"))]
    parts = P.table(spark, d, "part").select("p_partkey", *letters)
    # Equal name pairs score alike: score each distinct pair once.
    scored = parts.select("a", "b").distinct().select("a", "b", A.align_score(F.col("a"), F.col("b")).alias("score"))
    return parts.join(scored, ["a", "b"]).select("p_partkey", "score")


# Gapped strings: the text with vowels hidden against the text with every fifth letter hidden.
@query("aligned_positions", f"""WITH seqs AS (SELECT item_id, {P.clean_sql('text')} AS seq FROM benchmark),
cells AS (SELECT item_id, u, regexp_replace(seq[u + 1], '[AEI]', '-') AS q, CASE WHEN u % 5 = 4 THEN '-' ELSE seq[u + 1] END AS t
    FROM (SELECT *, unnest(range(0, length(seq))) AS u FROM seqs)),
placed AS (SELECT *, sum((q <> '-')::INT) OVER w - 1 AS qpos, sum((t <> '-')::INT) OVER w - 1 AS tpos FROM cells
    WINDOW w AS (PARTITION BY item_id ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT item_id::VARCHAR AS query_key, 't' AS tpl_key, qpos::INT AS qpos, tpos::INT AS tpos, q AS q_aa, t AS t_aa FROM placed
WHERE q <> '-' AND t <> '-'""")
def aligned_positions(spark, d):
    seq = P.clean(F.col("text"))
    gapped = P.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("query_key"), F.lit("t").alias("tpl_key"),
        F.regexp_replace(seq, "[AEI]", "-").alias("q_aln"), F.regexp_replace(seq, "(.{4}).", "$1-").alias("t_aln"))
    return A.aligned_positions(gapped)


@query("cigar_positions", """WITH ops AS (SELECT user_id || '/' || (event_id // 1000) AS key, event_id, 1 + event_id % 3 AS n,
    CASE event_type WHEN 'error' THEN 'I' WHEN 'signup' THEN 'D' ELSE 'M' END AS op FROM events),
started AS (SELECT *, coalesce(sum(CASE WHEN op = 'D' THEN 0 ELSE n END) OVER w, 0) AS q0,
    coalesce(sum(CASE WHEN op = 'I' THEN 0 ELSE n END) OVER w, 0) AS t0 FROM ops
    WINDOW w AS (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, (q0 + s)::INT AS qpos, (t0 + s)::INT AS tpos FROM (SELECT *, unnest(range(0, n)) AS s FROM started WHERE op = 'M')""")
def cigar_positions(spark, d):
    """Every event is a run; a user's events within a block of 1000 event ids make one alignment."""
    op = F.when(F.col("event_type") == "error", "I").when(F.col("event_type") == "signup", "D").otherwise("M")
    runs = P.table(spark, d, "events").groupBy(F.concat_ws("/", "user_id", F.expr("event_id div 1000")).alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", F.concat((F.col("event_id") % 3 + 1).cast("string"), op).alias("run")))).alias("runs"))
    return A.cigar_positions(runs.select("key", F.array_join(F.transform("runs", lambda r: r["run"]), "").alias("cigar")))


@query("project_binary", f"""WITH {_ONTO_SQL} SELECT query_key, tpl_key, i, j,
    CASE WHEN NOT known THEN -1.0 WHEN hit THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM onto""")
def project_binary(spark, d):
    return T.project_onto(_asked(spark, d), _aligned(spark, d), contacts(spark, d))


@query("project_blosum", f"""WITH {_ONTO_SQL} SELECT query_key, tpl_key, i, j, round(CASE WHEN j - i < 3 OR NOT known THEN 0.0
    WHEN hit THEN strength ELSE -strength END::DOUBLE, 6) + 0.0 AS value FROM onto""")
def project_blosum(spark, d):
    onto = T.project_onto(_asked(spark, d), _aligned(spark, d), contacts(spark, d), T.blosum62(spark), min_sep=3)
    return onto.withColumn("value", r6(F.col("value")))


@query("project_contacts", f"""WITH {_PROJECTED_SQL} SELECT query_key, tpl_key, i, j, round(strength, 6) + 0.0 AS value FROM projected""")
def project_contacts(spark, d):
    out = T.project(_aligned(spark, d), contacts(spark, d), T.blosum62(spark))
    return out.withColumn("value", r6(F.col("value")))


@query("evidence", f"""WITH {_PROJECTED_SQL} SELECT query_key, tpl_key, i, j,
    round(CASE WHEN j - i < 8 THEN 0 ELSE greatest(0, least(1, strength)) END::DOUBLE, 6) + 0.0 AS value,
    CASE WHEN j - i < 8 OR strength = 0 THEN 0 ELSE 1 END AS flag FROM projected""")
def evidence(spark, d):
    rows = T.evidence(T.project(_aligned(spark, d), contacts(spark, d), T.blosum62(spark)), False, True, 8)
    return rows.withColumn("value", r6(F.col("value")))


@query("evidence_known", f"""WITH {_ONTO_SQL} SELECT query_key, tpl_key, i, j,
    CASE WHEN hit AND j - i >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS value, CASE WHEN known AND j - i >= 6 THEN 1 ELSE 0 END AS flag FROM onto""")
def evidence_known(spark, d):
    return T.evidence(T.project_onto(_asked(spark, d), _aligned(spark, d), contacts(spark, d)), False, False, 6)


_WEIGHTS_SQL = """raised AS (SELECT *, exp(sim - max(sim) OVER (PARTITION BY query_key)) AS e FROM candidates),
weights AS (SELECT query_key, tpl_key, e / (sum(e) OVER (PARTITION BY query_key) + 1e-8) AS weight FROM raised)"""


@query("template_vote", f"""WITH {_PROJECTED_SQL}, {_WEIGHTS_SQL}
SELECT query_key, (i - 5)::INT AS i, (j - 5)::INT AS j, round(sum(weight), 6) + 0.0 AS prior, count(*)::DOUBLE AS cnt
FROM projected JOIN weights USING (query_key, tpl_key) WHERE i >= 5 AND j < 45 GROUP BY query_key, i, j""")
def template_vote(spark, d):
    rows = T.evidence(T.project(_aligned(spark, d), contacts(spark, d)), True, False)
    windows = B.crop_windows(chain_seqs(spark, d), 40, "center")
    voted = T.vote(rows, R.hit_weights(_candidates(spark, d)), windows)
    return voted.withColumn("prior", r6(F.col("prior")))


def chain_index(spark, d):
    """Mean-pooled chain embeddings."""
    vectors = P.points(spark, d).select("chain_key", "pdb_id", "pos")
    raw = P.table(spark, d, "embeddings").select(
        F.concat(F.lit("P"), F.expr("vec_id div 100").cast("string"), F.when(F.expr("vec_id div 50") % 2 == 0, "_A").otherwise("_B")).alias("chain_key"),
        F.col("embedding").cast("array<double>").alias("vec"))
    return E.mean_pool(raw).join(vectors.select("chain_key", "pdb_id").distinct(), "chain_key")


_WALK_LETTER = (f"CASE WHEN NOT (strpos('{AMINO_ACIDS}', p.a[w.i]) > 0 AND strpos('{AMINO_ACIDS}', p.b[w.j]) > 0) THEN 0 "
                "WHEN p.a[w.i] = p.b[w.j] THEN 1 ELSE -1 END")
_E2E_SQL = f"""WITH RECURSIVE {CONTACTS_SQL},
dims AS (SELECT 'P' || (vec_id // 100) || CASE WHEN vec_id // 50 % 2 = 0 THEN '_A' ELSE '_B' END AS chain_key, 'P' || (vec_id // 100) AS pdb_id,
    unnest(range(1, len(embedding) + 1)) AS k, embedding FROM embeddings),
means AS (SELECT chain_key, pdb_id, k, avg(embedding[k]::DOUBLE) AS v FROM dims GROUP BY ALL),
pooled AS (SELECT chain_key, pdb_id, list(v ORDER BY k) AS emb FROM means GROUP BY ALL),
unit AS (SELECT *, sqrt(list_inner_product(emb, emb)) + 1e-8 AS norm FROM pooled),
sims AS (SELECT q.chain_key AS query_key, t.chain_key AS tpl_key, round(list_inner_product(q.emb, t.emb) / (q.norm * t.norm), 9) AS sim
    FROM unit q JOIN unit t ON q.pdb_id <> t.pdb_id),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_key ORDER BY sim DESC, tpl_key) <= 4),
raised AS (SELECT *, exp(sim - max(sim) OVER (PARTITION BY query_key)) AS e FROM top),
weights AS (SELECT query_key, tpl_key, e / (sum(e) OVER (PARTITION BY query_key) + 1e-8) AS weight FROM raised),
seqs AS (SELECT chain_key, string_agg(aa, '' ORDER BY pos) AS seq FROM points GROUP BY chain_key),
chain_pairs AS (SELECT query_key || '/' || tpl_key AS id, query_key, tpl_key, q.seq AS a, t.seq AS b FROM weights
    JOIN seqs q ON q.chain_key = query_key JOIN seqs t ON t.chain_key = tpl_key), {score_sql('chain_pairs')},
walk AS (SELECT id, length(a) AS i, length(b) AS j, NULL::BIGINT AS qpos, NULL::BIGINT AS tpos FROM chain_pairs
    UNION ALL SELECT id, i - (step <> 'left')::INT, j - (step <> 'up')::INT, CASE WHEN step = 'both' THEN i - 1 END, CASE WHEN step = 'both' THEN j - 1 END
    FROM (SELECT w.id, w.i, w.j, CASE WHEN w.i > 0 AND w.j > 0 AND r.h[w.j + 1] = u.h[w.j] + {_WALK_LETTER} THEN 'both'
            WHEN w.i > 0 AND r.h[w.j + 1] = u.h[w.j + 1] - 2 THEN 'up' ELSE 'left' END AS step
        FROM walk w JOIN chain_pairs p USING (id) JOIN score_rows r ON r.id = w.id AND r.i = w.i
        LEFT JOIN score_rows u ON u.id = w.id AND u.i = w.i - 1 WHERE w.i > 0 OR w.j > 0)),
aligned AS (SELECT query_key, tpl_key, qpos, tpos FROM walk JOIN chain_pairs USING (id) WHERE qpos IS NOT NULL),
projected AS (SELECT a.query_key, a.tpl_key, least(a.qpos, b.qpos) AS i, greatest(a.qpos, b.qpos) AS j FROM contacts c
    JOIN aligned a ON a.tpl_key = c.chain_key AND a.tpos = c.i
    JOIN aligned b ON b.tpl_key = c.chain_key AND b.query_key = a.query_key AND b.tpos = c.j)
SELECT query_key, i::INT AS i, j::INT AS j, round(sum(weight), 6) + 0.0 AS prior, count(*)::DOUBLE AS cnt
FROM projected JOIN weights USING (query_key, tpl_key) WHERE j - i >= 6 GROUP BY query_key, i, j"""


@query("transfer_e2e", _E2E_SQL)
def transfer_e2e(spark, d):
    index = chain_index(spark, d)
    prior = T.transfer(index, index, chain_seqs(spark, d), contacts(spark, d), min_sep=6)
    return prior.withColumn("prior", r6(F.col("prior")))
