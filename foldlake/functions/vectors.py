"""Three-vectors as triples of columns, and array<double> vectors.

A chain of vector steps is written as a chain of ``select``s with flat columns
(``fields`` to name a result, ``named`` to read it in the next step). Catalyst
then evaluates every step once, inside whole-stage code; nested in one
expression the steps would be copied into each other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EPSILON


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column


def point(column: str) -> Vec:
    """Components of a struct<x,y,z> column."""
    return Vec(*[F.col(f"{column}.{k}") for k in "xyz"])


def named(name: str) -> Vec:
    return Vec(*[F.col(f"{name}_{k}") for k in "xyz"])


def fields(name: str, v: Vec) -> list[Column]:
    return [c.alias(f"{name}_{k}") for k, c in zip("xyz", v)]


def as_struct(v: Vec) -> Column:
    return F.struct(*[c.alias(k) for k, c in zip("xyz", v)])


def add(a: Vec, b: Vec) -> Vec:
    return Vec(*[p + q for p, q in zip(a, b)])


def sub(a: Vec, b: Vec) -> Vec:
    return Vec(*[p - q for p, q in zip(a, b)])


def scale(a: Vec, k) -> Vec:
    return Vec(*[p * k for p in a])


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def finite(v: Column) -> Column:
    """The value, or 0.0 where it is missing, NaN or infinite."""
    return F.when(F.abs(v) < F.lit(float("inf")), v).otherwise(F.lit(0.0))


def unit(a: Vec) -> Vec:
    """v / sqrt(|v|^2 + 1e-8), with anything not finite set to zero."""
    length = F.sqrt(dot(a, a) + EPSILON)
    return Vec(*[finite(p / length) for p in a])


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def l2_normalize(a: Column) -> Column:
    """Vector divided by its length + 1e-8."""
    wide = a.cast("array<double>")
    length = F.sqrt(array_dot(wide, wide)) + EPSILON
    return F.transform(wide, lambda v: v / length)
