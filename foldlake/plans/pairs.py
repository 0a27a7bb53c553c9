"""Queries on residue pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import RELPOS_CUTS
from ..functions import scalars as S
from ..operators import pairs as B
from . import proxies as P
from .registry import query

NEAR = 12.0


def near_sql(table: str, radius: float, name: str = "near", condition: str = "a.has_ca AND b.has_ca") -> str:
    """Pairs of one chain closer than a radius, the plain way."""
    return f"""{name} AS (SELECT * FROM (SELECT a.chain_key, a.pos AS i, b.pos AS j,
        sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
        FROM {table} a JOIN {table} b ON a.chain_key = b.chain_key AND a.pos < b.pos WHERE {condition}) WHERE dist < {radius})"""


CONTACTS_SQL = f"""{P.POINTS_SQL}, {near_sql('points', 8.0, 'close')},
contacts AS (SELECT * FROM close WHERE j - i >= 6)"""


def _contacts(spark, d):
    return B.contacts(P.points(spark, d))


def _all_near(spark, d):
    """Close pairs of all residues, those marked as unresolved included."""
    return B.pair_distances(P.points(spark, d).withColumn("has_ca", F.lit(True)), NEAR)


ALL_NEAR_SQL = f"{P.POINTS_SQL}, {near_sql('points', NEAR, 'near', 'true')}"


@query("contacts", f"WITH {CONTACTS_SQL} SELECT chain_key, i, j, round(dist, 6) + 0.0 AS dist FROM contacts")
def contacts(spark, d):
    return _contacts(spark, d).withColumn("dist", S.r6(F.col("dist")))


@query("contacts_bulk", f"""WITH {P.BULK_POINTS_SQL}, {near_sql('bulk_points', 8.0)}
SELECT chain_key, count(*) AS n, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j, round(max(dist), 6) + 0.0 AS max_dist
FROM near WHERE j - i >= 6 GROUP BY chain_key""")
def contacts_bulk(spark, d):
    """Contacts of the large residue table, counted per chain."""
    found = B.contacts(P.bulk_points(spark, d), join="shuffle_hash")
    return found.groupBy("chain_key").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j"),
                                          S.r6(F.max("dist")).alias("max_dist"))


@query("pair_distances", f"""WITH {P.POINTS_SQL}, {near_sql('points', 20.0)}
SELECT chain_key, i, j, round(dist, 6) + 0.0 AS dist FROM near""")
def pair_distances(spark, d):
    return B.pair_distances(P.points(spark, d), 20.0).withColumn("dist", S.r6(F.col("dist")))


@query("contact_rows", f"""WITH {CONTACTS_SQL},
mirrored AS (SELECT chain_key, i, j FROM contacts UNION ALL SELECT chain_key, j, i FROM contacts)
SELECT chain_key, i, string_agg(j, ',' ORDER BY j) AS partners, CASE WHEN i >= 5 AND i < 45 THEN
    array_to_string(list_transform(range(5, 45), lambda k: list_contains(list(j), k)::INT), '') END AS cells
FROM mirrored GROUP BY chain_key, i""")
def contact_rows(spark, d):
    """Partners of every residue, and the dense cells of a window of forty residues."""
    windows = P.points(spark, d).select("chain_key").distinct().select("chain_key", F.lit(5).alias("crop_start"), F.lit(45).alias("crop_end"))
    rows = B.matrix_rows(_contacts(spark, d), windows)
    return rows.select("chain_key", "i", *[F.array_join(F.col(c).cast("array<string>"), sep).alias(c) for c, sep in (("partners", ","), ("cells", ""))])


@query("contact_mirror", f"""WITH {CONTACTS_SQL} SELECT chain_key, i, j FROM contacts
UNION ALL SELECT chain_key, j AS i, i AS j FROM contacts""")
def contact_mirror(spark, d):
    return B.mirror(_contacts(spark, d)).select("chain_key", "i", "j")


@query("pair_mask", f"""WITH {ALL_NEAR_SQL} SELECT n.chain_key, n.i, n.j, (a.has_ca AND b.has_ca)::INT AS mask FROM near n
JOIN points a ON a.chain_key = n.chain_key AND a.pos = n.i JOIN points b ON b.chain_key = n.chain_key AND b.pos = n.j""")
def pair_mask(spark, d):
    return B.pair_mask(_all_near(spark, d).select("chain_key", "i", "j"), P.points(spark, d))


@query("long_mask", f"WITH {P.PAIRS_SQL} SELECT chain_key, i, j FROM pair_scores WHERE abs(i - j) >= 12")
def long_mask(spark, d):
    return B.long_range(P.pair_scores(spark, d), 12).select("chain_key", "i", "j")


def _crop_sql(start: str) -> str:
    return f"""WITH {P.GROUPS_SQL} SELECT chain_key, L, CASE WHEN L > 256 THEN {start} ELSE 0 END::INT AS crop_start,
    CASE WHEN L > 256 THEN {start} + 256 ELSE L END::INT AS crop_end FROM groups"""


@query("crop_center", _crop_sql("(L - 256) // 2"))
def crop_center(spark, d):
    return B.crop_windows(P.groups(spark, d).select("chain_key", "L"), 256, "center")


@query("crop_random", _crop_sql("concat('0x', substr(md5(chain_key || ':42'), 1, 8))::BIGINT % (L - 256 + 1)"))
def crop_random(spark, d):
    return B.crop_windows(P.groups(spark, d).select("chain_key", "L"), 256, "random", 42)


@query("crop_pairs", f"""WITH {CONTACTS_SQL}, windows AS (SELECT chain_key, (count(*) - 30) // 2 AS s FROM points GROUP BY chain_key)
SELECT chain_key, (i - s)::INT AS i, (j - s)::INT AS j, s::INT AS crop_start, (s + 30)::INT AS crop_end
FROM contacts JOIN windows USING (chain_key) WHERE i >= s AND j < s + 30""")
def crop_pairs(spark, d):
    chains = P.points(spark, d).groupBy("chain_key").agg(F.count(F.lit(1)).alias("L"))
    return B.crop_pairs(_contacts(spark, d).select("chain_key", "i", "j"), B.crop_windows(chains, 30, "center"))


@query("crop_residues", f"""WITH {P.POINTS_SQL}, windows AS (SELECT chain_key, (count(*) - 30) // 2 AS s FROM points GROUP BY chain_key)
SELECT chain_key, (pos - s)::INT AS pos, aa, has_ca FROM points JOIN windows USING (chain_key) WHERE pos >= s AND pos < s + 30""")
def crop_residues(spark, d):
    points = P.points(spark, d).select("chain_key", "pos", "aa", "has_ca")
    windows = B.crop_windows(points.groupBy("chain_key").agg(F.count(F.lit(1)).alias("L")), 30, "center")
    return B.crop_residues(points, windows)


@query("pad_batch", f"""WITH {P.SEQUENCES_SQL}, wide AS (SELECT *, doc_id // 8 AS batch_id,
    max(length(seq)) OVER (PARTITION BY doc_id // 8) AS width FROM sequences)
SELECT batch_id, chain_key, width::INT AS size, (width - length(seq))::INT AS padded,
    md5(seq || repeat('-', (width - length(seq))::INT)) AS digest FROM wide""")
def pad_batch(spark, d):
    """Whole residue strings as letter arrays, padded inside batches of eight."""
    letters = P.sequences(spark, d).select(
        F.expr("doc_id div 8").alias("batch_id"), "chain_key", F.length("seq").alias("own"),
        F.filter(F.split("seq", ""), lambda c: c != "").alias("letters"))
    padded = B.pad_arrays(letters, "batch_id", "letters", "-")
    return padded.select("batch_id", "chain_key", F.size("letters").alias("size"), (F.size("letters") - F.col("own")).alias("padded"),
                         F.md5(F.array_join("letters", "")).alias("digest"))


_BUCKET_SQL = " + ".join(f"(abs(i - j) > {c})::INT" for c in RELPOS_CUTS)


@query("relpos_bucket", f"""WITH {P.PAIRS_SQL}, b AS (SELECT chain_key, i, j, {_BUCKET_SQL} AS bucket FROM pair_scores)
SELECT chain_key, i, j, bucket, repeat('0', bucket) || '1' || repeat('0', 13 - bucket) AS one_hot FROM b""")
def relpos_bucket(spark, d):
    return P.pair_scores(spark, d).select(
        "chain_key", "i", "j", S.relpos_bucket(F.col("i"), F.col("j")).alias("bucket"),
        F.array_join(S.relpos_one_hot(F.col("i"), F.col("j")).cast("array<string>"), "").alias("one_hot"))


@query("relpos_clipped", f"""WITH {P.PAIRS_SQL} SELECT chain_key, i, j,
    CASE WHEN valid THEN greatest(-32, least(32, j - i)) + 33 ELSE 0 END AS ahead,
    CASE WHEN valid THEN greatest(-32, least(32, i - j)) + 33 ELSE 0 END AS behind FROM pair_scores""")
def relpos_clipped(spark, d):
    i, j, valid = F.col("i"), F.col("j"), F.col("valid")
    return P.pair_scores(spark, d).select(
        "chain_key", "i", "j", S.relpos_clipped(i, j, 32, valid).alias("ahead"), S.relpos_clipped(j, i, 32, valid).alias("behind"))


def _cb_sql(axis: str, p: str, q: str) -> str:
    b = {a: f"(ca.{a} - n.{a})" for a in "xyz"}
    c = {a: f"(c.{a} - ca.{a})" for a in "xyz"}
    return f"-0.58273431 * ({b[p]} * {c[q]} - {b[q]} * {c[p]}) + 0.56802827 * {b[axis]} - 0.54067466 * {c[axis]} + ca.{axis}"


_EDGES = [(3.25 + (50.75 - 3.25) / 62 * k) ** 2 for k in range(63)]


@query("distogram", f"""WITH {ALL_NEAR_SQL}, {P.BACKBONE_SQL},
beta AS (SELECT chain_key, pos, {_cb_sql('x', 'y', 'z')} AS x, {_cb_sql('y', 'z', 'x')} AS y, {_cb_sql('z', 'x', 'y')} AS z FROM backbone),
gaps AS (SELECT n.chain_key, n.i, n.j, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM near n
    JOIN beta a ON a.chain_key = n.chain_key AND a.pos = n.i JOIN beta b ON b.chain_key = n.chain_key AND b.pos = n.j)
SELECT chain_key, i, j, CASE WHEN d2 IS NOT NULL THEN {' + '.join(f'(d2 > {e!r})::INT' for e in _EDGES)} END AS bin FROM gaps""")
def distogram(spark, d):
    return B.distogram(_all_near(spark, d).select("chain_key", "i", "j"), P.backbone(spark, d), 3.25, 50.75, 64)


_DIRECTED_SQL = """directed AS (SELECT chain_key, CASE WHEN y = 1 THEN i ELSE j END AS i, CASE WHEN y = 1 THEN j ELSE i END AS j,
    p AS x FROM pair_scores UNION ALL SELECT chain_key, CASE WHEN y = 1 THEN j ELSE i END, CASE WHEN y = 1 THEN i ELSE j END,
    p * 0.5 FROM pair_scores WHERE valid)"""


def _directed(spark, d):
    """Scores that differ with the order of the pair; short-range pairs have one order only."""
    i, j, up = F.col("i"), F.col("j"), F.col("y") == 1
    pair = lambda a, b, x: F.struct(F.when(up, a).otherwise(b).alias("i"), F.when(up, b).otherwise(a).alias("j"), x.alias("x"))
    both = F.array(pair(i, j, F.col("p")), F.when(F.col("valid"), pair(j, i, F.col("p") * 0.5)))
    return P.pair_scores(spark, d).select("chain_key", F.explode(F.filter(both, lambda r: r.isNotNull())).alias("r")).select(
        "chain_key", "r.i", "r.j", "r.x")


@query("symmetrize", f"""WITH {P.PAIRS_SQL}, {_DIRECTED_SQL} SELECT chain_key, least(i, j) AS i, greatest(i, j) AS j,
    round(sum(x) / 2, 6) + 0.0 AS mean, round(sum(x), 6) + 0.0 AS total FROM directed GROUP BY ALL""")
def symmetrize(spark, d):
    directed = _directed(spark, d)
    return B.symmetrize(directed, "sum").select("chain_key", "i", "j", S.r6(F.col("x") / 2).alias("mean"), S.r6(F.col("x")).alias("total"))


@query("symmetrize_mean", f"""WITH {P.PAIRS_SQL}, {_DIRECTED_SQL} SELECT chain_key, least(i, j) AS i, greatest(i, j) AS j,
    round(sum(x) / 2, 6) + 0.0 AS x FROM directed GROUP BY ALL""")
def symmetrize_mean(spark, d):
    return B.symmetrize(_directed(spark, d), "mean").withColumn("x", S.r6(F.col("x")))


def _channels(spark, d):
    """Three feature channels per pair."""
    p = F.col("p")
    return P.pair_scores(spark, d).select("chain_key", "i", "j", p.alias("c0"), (p * p).alias("c1"), ((F.col("y") + 1) * p).alias("c2"))


_CHANNEL_SQL = """halves AS (SELECT chain_key, i, j, 0 AS channel, p AS x FROM pair_scores
    UNION ALL SELECT chain_key, i, j, 1, p * p FROM pair_scores UNION ALL SELECT chain_key, i, j, 2, (y + 1) * p FROM pair_scores),
channels AS (SELECT * FROM halves UNION ALL SELECT chain_key, j, i, channel, x FROM halves),
corrected AS (SELECT chain_key, channel, i, j, x - sum(x) OVER (PARTITION BY chain_key, channel, i)
    * sum(x) OVER (PARTITION BY chain_key, channel, j) / sum(x) OVER (PARTITION BY chain_key, channel) AS x FROM channels)"""


@query("apc", f"""WITH {P.PAIRS_SQL}, {_CHANNEL_SQL.replace("0 AS channel, p AS x", "0 AS channel, round(p * 1000) AS x")} SELECT chain_key, i, j, round(x, 6) + 0.0 AS x FROM corrected WHERE channel = 0""")
def apc(spark, d):
    """Scores in thousandths, whole numbers whose sums are exact."""
    scores = P.pair_scores(spark, d).select("chain_key", "i", "j", F.round(F.col("p") * 1000).alias("x"))
    return B.mirror(B.apc(scores, tasks=P.pair_tasks(spark, d))).withColumn("x", S.r6(F.col("x")))


_LOGISTIC_SQL = f"""WITH {P.PAIRS_SQL}, {_CHANNEL_SQL}, weights(channel, w) AS (VALUES (0, 1.5), (1, -0.7), (2, 0.4))
SELECT chain_key, i, j, round(1 / (1 + exp(-(sum(x * w::DOUBLE) - 0.25))), 6) + 0.0 AS score
FROM corrected JOIN weights USING (channel) WHERE i < j GROUP BY chain_key, i, j"""


@query("logistic_score", _LOGISTIC_SQL)
def logistic_score(spark, d):
    corrected = B.apc(_channels(spark, d), values=("c0", "c1", "c2"), tasks=P.pair_tasks(spark, d))
    return B.logistic_score(corrected, {"c0": 1.5, "c1": -0.7, "c2": 0.4}, -0.25).withColumn("score", S.r6(F.col("score")))


@query("logistic_score_long", _LOGISTIC_SQL)
def logistic_score_long(spark, d):
    """The form with a row per channel."""
    rows = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(f"c{k}").alias("x")) for k in range(3)])
    long = _channels(spark, d).select("chain_key", "i", "j", F.explode(rows).alias("r")).select("chain_key", "i", "j", "r.channel", "r.x")
    weights = spark.createDataFrame([(0, 1.5), (1, -0.7), (2, 0.4)], "channel int, w double")
    corrected = B.apc(long, keys=("chain_key", "channel"), tasks=P.pair_tasks(spark, d, 3))
    return B.logistic_score_long(corrected, weights, -0.25).withColumn("score", S.r6(F.col("score")))
