"""Per-residue geometry from backbone atoms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def with_neighbours(df: DataFrame, before: list[str] = (), after: list[str] = ()) -> DataFrame:
    """Add ``prev_*`` and ``next_*`` copies of columns from the positions pos-1 and pos+1.

    Every residue sends its columns to both neighbours and the parts meet on
    (chain, pos): one shuffle, and a long chain spreads over all tasks.
    """
    own = [c for c in df.columns if c not in ("chain_key", "pos")]
    roles = F.array(*[F.struct(F.lit(r).alias("role"), (F.col("pos") + s).alias("at"))
                      for r, s in (("self", 0), ("prev", 1), ("next", -1))])
    sent = df.select("*", F.explode(roles).alias("m")).filter(F.col("m.at") >= 0)

    def of(role: str, column: str) -> Column:
        return F.first(F.when(F.col("m.role") == role, F.col(column)), ignorenulls=True)

    return sent.groupBy("chain_key", F.col("m.at").alias("pos")).agg(
        F.max(F.col("m.role") == "self").alias("__real"),
        *[of("self", c).alias(c) for c in own],
        *[of("prev", c).alias(f"prev_{c}") for c in before],
        *[of("next", c).alias(f"next_{c}") for c in after],
    ).filter("__real").drop("__real")


def _normals(steps: DataFrame, bonds: list[str]) -> DataFrame:
    """Unit bonds, then unit normals of consecutive bonds, as flat columns n0, n1, ..."""
    keep = [c for c in steps.columns if c.rsplit("_", 1)[0] not in bonds]
    steps = steps.select(*keep, *[f for b in bonds for f in V.fields(b, V.unit(V.named(b)))])
    pairs = list(zip(bonds, bonds[1:]))
    steps = steps.select("*", *[f for k, (a, b) in enumerate(pairs) for f in V.fields(f"m{k}", V.cross(V.named(a), V.named(b)))])
    return steps.select("*", *[f for k in range(len(pairs)) for f in V.fields(f"n{k}", V.unit(V.named(f"m{k}")))])


def _torsion(bond: str, first: str, second: str, eps: float = 1e-7) -> Column:
    """Signed angle between two normals; 0 where an atom is missing."""
    cosine = F.greatest(F.lit(-1 + eps), F.least(F.lit(1 - eps), V.dot(V.named(first), V.named(second))))
    return F.signum(V.dot(V.named(bond), V.named(second))) * F.acos(cosine)


def with_torsions(near: DataFrame) -> DataFrame:
    """Add phi, psi and omega to residues that carry their neighbours' atoms."""
    atoms = ["prev_c", "n", "ca", "c", "next_n", "next_ca"]
    bonds = [f"b{k}" for k in range(5)]
    steps = near.select("*", *[f for b, (p, q) in zip(bonds, zip(atoms, atoms[1:])) for f in V.fields(b, V.sub(V.point(q), V.point(p)))])
    turned = _normals(steps, bonds)
    angles = [_torsion(f"b{k}", f"n{k}", f"n{k + 1}").alias(a) for k, a in enumerate(("phi", "psi", "omega"))]
    return turned.select(*near.columns, *angles)


def _lifted() -> list[Column]:
    return [fn(F.col(a)).alias(f"{name}_{a}") for name, fn in (("cos", F.cos), ("sin", F.sin)) for a in ("phi", "psi", "omega")]


def dihedrals(backbone: DataFrame) -> DataFrame:
    """Backbone torsions as cosine and sine; the open ends of a chain have angle 0."""
    near = with_neighbours(backbone.select("chain_key", "pos", "n", "ca", "c"), ["c"], ["n", "ca"])
    return with_torsions(near).select("chain_key", "pos", *_lifted())


def _add_orientations(near: DataFrame) -> DataFrame:
    steps = near.select("*", *V.fields("ahead", V.sub(V.point("next_ca"), V.point("ca"))),
                        *V.fields("back", V.sub(V.point("prev_ca"), V.point("ca"))))
    return steps.select(*near.columns, V.as_struct(V.unit(V.named("ahead"))).alias("forward"),
                        V.as_struct(V.unit(V.named("back"))).alias("backward"))


def orientations(backbone: DataFrame) -> DataFrame:
    """Unit vectors to the next and the previous CA; zero at the ends."""
    near = with_neighbours(backbone.select("chain_key", "pos", "ca"), ["ca"], ["ca"])
    return _add_orientations(near).select("chain_key", "pos", "forward", "backward")


def _add_sidechain(df: DataFrame) -> DataFrame:
    steps = df.select("*", *V.fields("rc", V.sub(V.point("c"), V.point("ca"))), *V.fields("rn", V.sub(V.point("n"), V.point("ca"))))
    steps = steps.select(*df.columns, *V.fields("uc", V.unit(V.named("rc"))), *V.fields("un", V.unit(V.named("rn"))))
    steps = steps.select(*df.columns, *V.fields("mid", V.add(V.named("uc"), V.named("un"))),
                         *V.fields("out", V.cross(V.named("uc"), V.named("un"))))
    steps = steps.select(*df.columns, *V.fields("mid", V.unit(V.named("mid"))), *V.fields("out", V.unit(V.named("out"))))
    direction = V.sub(V.scale(V.named("mid"), -math.sqrt(1 / 3)), V.scale(V.named("out"), math.sqrt(2 / 3)))
    return steps.select(*df.columns, V.as_struct(direction).alias("sidechain"))


def sidechain_vectors(backbone: DataFrame) -> DataFrame:
    """Direction in which an ideal side chain leaves the backbone."""
    return _add_sidechain(backbone.select("chain_key", "pos", "n", "ca", "c")).select("chain_key", "pos", "sidechain")


def frames(backbone: DataFrame) -> DataFrame:
    """Local axes e1, e2, e3 of each residue from N, CA and C."""
    keys = ["chain_key", "pos"]
    e1, e2, v = V.named("e1"), V.named("e2"), V.named("v")
    steps = backbone.select(*keys, *V.fields("w", V.sub(V.point("c"), V.point("ca"))), *V.fields("v", V.sub(V.point("n"), V.point("ca"))))
    steps = steps.select(*keys, *V.fields("e1", V.unit(V.named("w"))), *v)
    steps = steps.select("*", V.dot(e1, v).alias("along"))
    steps = steps.select(*keys, *e1, *V.fields("flat", V.sub(v, V.scale(e1, F.col("along")))))
    steps = steps.select(*keys, *e1, *V.fields("e2", V.unit(V.named("flat"))))
    return steps.select(*keys, V.as_struct(e1).alias("e1"), V.as_struct(e2).alias("e2"), V.as_struct(V.cross(e1, e2)).alias("e3"))


def rotate(v: V.Vec, e1: str, e2: str, e3: str) -> V.Vec:
    """A vector given in a residue's axes (struct columns), in outer coordinates."""
    return V.add(V.add(V.scale(V.point(e1), v.x), V.scale(V.point(e2), v.y)), V.scale(V.point(e3), v.z))


def node_features(backbone: DataFrame) -> DataFrame:
    """Six torsion features, the coordinate flag and three direction vectors per residue, in one pass."""
    complete = F.col("n").isNotNull() & F.col("ca").isNotNull() & F.col("c").isNotNull()
    near = with_neighbours(backbone.select("chain_key", "pos", "n", "ca", "c"), ["ca", "c"], ["n", "ca"])
    return _add_sidechain(_add_orientations(with_torsions(near))).select(
        "chain_key", "pos", *_lifted(), complete.cast("int").alias("has_coords"), "forward", "backward", "sidechain")
