"""Queries on backbone geometry and residue graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import graph
from . import proxies as P
from .registry import query

# ---------------------------------------------------------- SQL vector macros


def _vec(x: str, y: str, z: str) -> str:
    return "{'x': " + x + ", 'y': " + y + ", 'z': " + z + "}"


def v_sub(a: str, b: str) -> str:
    return _vec(*[f"{a}.{k} - {b}.{k}" for k in "xyz"])


def v_unit(a: str) -> str:
    norm = f"sqrt({a}.x * {a}.x + {a}.y * {a}.y + {a}.z * {a}.z + 1e-8)"
    return _vec(*[f"coalesce({a}.{k} / {norm}, 0)" for k in "xyz"])


def v_cross(a: str, b: str) -> str:
    return _vec(f"{a}.y * {b}.z - {a}.z * {b}.y", f"{a}.z * {b}.x - {a}.x * {b}.z", f"{a}.x * {b}.y - {a}.y * {b}.x")


def v_dot(a: str, b: str) -> str:
    return f"({a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"


def flat(column: str, name: str | None = None) -> str:
    return ", ".join(f"round({column}.{k}, 6) + 0.0 AS {name or column}_{k}" for k in "xyz")


def flat_cols(column: str, name: str | None = None):
    return [S.r6(F.col(f"{column}.{k}")).alias(f"{name or column}_{k}") for k in "xyz"]


_NEAR_SQL = f"""{P.BACKBONE_SQL}, near AS (SELECT *, lag(ca) OVER w AS pca, lag(c) OVER w AS pc, lead(n) OVER w AS nn,
    lead(ca) OVER w AS nca FROM backbone WINDOW w AS (PARTITION BY chain_key ORDER BY pos))"""


def _torsion_sql(name: str, a: str, b: str, c: str, e: str) -> str:
    return f"""{name}1 AS (SELECT chain_key, pos, {v_sub(b, a)} AS a, {v_sub(c, b)} AS b, {v_sub(e, c)} AS c FROM near),
{name}2 AS (SELECT chain_key, pos, {v_unit('a')} AS a, {v_unit('b')} AS b, {v_unit('c')} AS c FROM {name}1),
{name}3 AS (SELECT chain_key, pos, a, {v_cross('a', 'b')} AS m, {v_cross('b', 'c')} AS k FROM {name}2),
{name}4 AS (SELECT chain_key, pos, a, {v_unit('m')} AS m, {v_unit('k')} AS k FROM {name}3),
{name} AS (SELECT chain_key, pos, sign({v_dot('a', 'k')}) * acos(greatest(-1 + 1e-7, least(1 - 1e-7, {v_dot('m', 'k')}))) AS {name}
    FROM {name}4)"""


_TORSIONS_SQL = f"""{_NEAR_SQL}, {_torsion_sql('phi', 'pc', 'n', 'ca', 'c')}, {_torsion_sql('psi', 'n', 'ca', 'c', 'nn')},
{_torsion_sql('omega', 'ca', 'c', 'nn', 'nca')}"""
_LIFTED_SQL = ", ".join(f"round({fn}({a}), 6) + 0.0 AS {fn}_{a}" for fn in ("cos", "sin") for a in ("phi", "psi", "omega"))


@query("dihedrals", f"""WITH {_TORSIONS_SQL} SELECT chain_key, pos, {_LIFTED_SQL}
FROM phi JOIN psi USING (chain_key, pos) JOIN omega USING (chain_key, pos)""")
def dihedrals(spark, d):
    out = G.dihedrals(P.backbone(spark, d))
    return out.select("chain_key", "pos", *[S.r6(F.col(c)).alias(c) for c in out.columns[2:]])


_ORIENT_SQL = f"""o1 AS (SELECT chain_key, pos, {v_sub('nca', 'ca')} AS f, {v_sub('pca', 'ca')} AS b FROM near),
orientations AS (SELECT chain_key, pos, {v_unit('f')} AS forward, {v_unit('b')} AS backward FROM o1)"""


@query("orientations", f"WITH {_NEAR_SQL}, {_ORIENT_SQL} SELECT chain_key, pos, {flat('forward')}, {flat('backward')} FROM orientations")
def orientations(spark, d):
    return G.orientations(P.backbone(spark, d)).select("chain_key", "pos", *flat_cols("forward"), *flat_cols("backward"))


_SIDE_SQL = f"""s1 AS (SELECT chain_key, pos, {v_sub('c', 'ca')} AS a, {v_sub('n', 'ca')} AS b FROM backbone),
s2 AS (SELECT chain_key, pos, {v_unit('a')} AS a, {v_unit('b')} AS b FROM s1),
s3 AS (SELECT chain_key, pos, {_vec('a.x + b.x', 'a.y + b.y', 'a.z + b.z')} AS s, {v_cross('a', 'b')} AS p FROM s2),
s4 AS (SELECT chain_key, pos, {v_unit('s')} AS s, {v_unit('p')} AS p FROM s3),
sidechains AS (SELECT chain_key, pos, {_vec(*[f's.{k} * {-math.sqrt(1 / 3)!r} - p.{k} * {math.sqrt(2 / 3)!r}' for k in 'xyz'])} AS sidechain FROM s4)"""


@query("sidechains", f"WITH {P.BACKBONE_SQL}, {_SIDE_SQL} SELECT chain_key, pos, {flat('sidechain')} FROM sidechains")
def sidechains(spark, d):
    return G.sidechain_vectors(P.backbone(spark, d)).select("chain_key", "pos", *flat_cols("sidechain"))


@query("frames", f"""WITH {P.BACKBONE_SQL}, f1 AS (SELECT chain_key, pos, {v_sub('c', 'ca')} AS a, {v_sub('n', 'ca')} AS v FROM backbone),
f2 AS (SELECT chain_key, pos, v, {v_unit('a')} AS e1 FROM f1),
f3 AS (SELECT chain_key, pos, e1, {_vec(*[f"v.{k} - e1.{k} * {v_dot('e1', 'v')}" for k in 'xyz'])} AS u FROM f2),
f4 AS (SELECT chain_key, pos, e1, {v_unit('u')} AS e2 FROM f3),
f5 AS (SELECT chain_key, pos, e1, e2, {v_cross('e1', 'e2')} AS e3 FROM f4)
SELECT chain_key, pos, {flat('e1')}, {flat('e2')}, {flat('e3')},
    {', '.join(f"round(e1.{k} * 1.0 + e2.{k} * 2.0 + e3.{k} * 3.0, 6) + 0.0 AS turned_{k}" for k in 'xyz')} FROM f5""")
def frames(spark, d):
    vector = V.Vec(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    out = G.frames(P.backbone(spark, d))
    out = out.withColumn("turned", V.as_struct(G.rotate(vector, "e1", "e2", "e3")))
    return out.select("chain_key", "pos", *flat_cols("e1"), *flat_cols("e2"), *flat_cols("e3"),
                      *[S.r6(F.col(f"turned.{k}")).alias(f"turned_{k}") for k in "xyz"])


@query("node_features", f"""WITH {_TORSIONS_SQL}, {_ORIENT_SQL}, {_SIDE_SQL}
SELECT chain_key, pos, {_LIFTED_SQL}, (b.ca IS NOT NULL)::INT AS has_coords, {flat('forward')}, {flat('backward')}, {flat('sidechain')}
FROM phi JOIN psi USING (chain_key, pos) JOIN omega USING (chain_key, pos) JOIN orientations USING (chain_key, pos)
JOIN sidechains USING (chain_key, pos) JOIN backbone b USING (chain_key, pos)""")
def node_features(spark, d):
    out = G.node_features(P.backbone(spark, d))
    lifted = [c for c in out.columns if c.startswith(("cos", "sin"))]
    return out.select("chain_key", "pos", *[S.r6(F.col(c)).alias(c) for c in lifted], "has_coords", *flat_cols("forward"),
                      *flat_cols("backward"), *flat_cols("sidechain"))


_KNN_SQL = f"""{P.POINTS_SQL}, ranked AS (SELECT a.chain_key, a.pos AS src, b.pos AS dst,
    CASE WHEN a.has_ca AND b.has_ca THEN sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) + 1e-8)
         ELSE 1e8 + 1e6 * abs(a.pos - b.pos) END AS rank FROM points a JOIN points b USING (chain_key)),
knn AS (SELECT chain_key, src, dst, rank AS dist, rank < 5e7 AS resolved FROM ranked
    QUALIFY row_number() OVER (PARTITION BY chain_key, src ORDER BY rank, dst) <= 8)"""


@query("knn_edges", f"WITH {_KNN_SQL} SELECT chain_key, src, dst, round(dist, 6) + 0.0 AS dist, resolved FROM knn")
def knn_edges(spark, d):
    return graph.knn_edges(P.points(spark, d), 8).withColumn("dist", S.r6(F.col("dist")))


def _rbf_sql(value: str, hi: float, k: int) -> str:
    return f"round(exp(-pow(({value} - {S.linspace(0.0, hi, 16)[k]!r}) / {hi / 16!r}, 2)), 6) + 0.0 AS rbf_{k}"


_RATES = [math.exp(-t * math.log(10000.0) / 16) for t in range(0, 16, 2)]


@query("edge_features", f"""WITH {_KNN_SQL}, e AS (SELECT k.*, a.has_ca AS sa, b.has_ca AS sb, {v_sub('a', 'b')} AS v FROM knn k
    JOIN points a ON a.chain_key = k.chain_key AND a.pos = k.src JOIN points b ON b.chain_key = k.chain_key AND b.pos = k.dst
    WHERE resolved), u AS (SELECT *, {v_unit('v')} AS u FROM e)
SELECT chain_key, src, dst, {', '.join(_rbf_sql('dist', 20.0, k) for k in range(16))},
    {', '.join(f"round({f}((src - dst) * {r!r}), 6) + 0.0 AS {f}_{k}" for f in ('cos', 'sin') for k, r in enumerate(_RATES))}, {flat('u')},
    (NOT sa)::INT AS src_missing, (NOT sb)::INT AS dst_missing FROM u""")
def edge_features(spark, d):
    points = P.points(spark, d)
    out = graph.edge_features(graph.knn_edges(points, 8), points)
    return out.select("chain_key", "src", "dst", *[S.r6(F.col("rbf")[k]).alias(f"rbf_{k}") for k in range(16)],
                      *[S.r6(F.col("posemb")[k]).alias(f"{'cos' if k < 8 else 'sin'}_{k % 8}") for k in range(16)], *flat_cols("u"),
                      "src_missing", "dst_missing")


@query("rbf", f"""WITH {P.PAIRS_SQL} SELECT chain_key, i, j, {', '.join(_rbf_sql('p', 1.0, k) for k in range(16))} FROM pair_scores""")
def rbf(spark, d):
    bumps = P.pair_scores(spark, d).select("chain_key", "i", "j", S.rbf(F.col("p"), 0.0, 1.0).alias("r"))
    return bumps.select("chain_key", "i", "j", *[S.r6(F.col("r")[k]).alias(f"rbf_{k}") for k in range(16)])


@query("flatten_graph", f"""WITH {_KNN_SQL}, lengths AS (SELECT chain_key, pdb_id AS batch_id, count(*) AS L FROM points GROUP BY ALL),
slots AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY chain_key) - 1 AS slot,
    max(L) OVER (PARTITION BY batch_id) AS N FROM lengths)
SELECT batch_id, chain_key, slot * N + src AS node_src, slot * N + dst AS node_dst, slot, src::BIGINT AS src, dst::BIGINT AS dst
FROM knn JOIN slots USING (chain_key) WHERE resolved""")
def flatten_graph(spark, d):
    points = P.points(spark, d)
    edges = graph.knn_edges(points, 8).select("chain_key", *[
        F.when(F.col("resolved"), F.col(c)).otherwise(-1).alias(c) for c in ("src", "dst")])
    batches = points.groupBy("chain_key", F.col("pdb_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("L"))
    flat_edges = graph.flatten_graph(edges, batches)
    return graph.unflatten_graph(flat_edges)
