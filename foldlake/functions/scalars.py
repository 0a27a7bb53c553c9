"""Column expressions: buckets, radial bases, binned logits, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import RELPOS_CUTS


def r6(col: Column) -> Column:
    """Six decimals, without negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def seeded(key: Column, seed: int) -> Column:
    """Reproducible shuffle key: the same text gives the same order on any cluster."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def relpos_bucket(i: Column, j: Column, cuts=RELPOS_CUTS) -> Column:
    """Number of cuts below |i-j|: bucket k holds (cuts[k-1], cuts[k]]."""
    distance = F.abs(i - j)
    return sum((F.when(distance > c, 1).otherwise(0) for c in cuts), F.lit(0))


def relpos_clipped(i: Column, j: Column, bins: int, valid: Column) -> Column:
    """Signed offset clipped to +-bins and moved above zero; masked pairs get 0."""
    clipped = F.greatest(F.lit(-bins), F.least(F.lit(bins), j - i))
    return F.when(valid, clipped + bins + 1).otherwise(0)


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * k / (n - 1) for k in range(n)] if n > 1 else [lo]


def rbf(value: Column, lo: float, hi: float, n: int = 16) -> Column:
    """Gaussian bumps at n even centres, width (hi-lo)/n."""
    width = (hi - lo) / n
    return F.array(*[F.exp(-F.pow((value - F.lit(c)) / width, F.lit(2.0))) for c in linspace(lo, hi, n)])


def bin_centres(lo: float, hi: float, n: int) -> list[float]:
    edges = linspace(lo, hi, n + 1)
    return [(a + b) / 2 for a, b in zip(edges, edges[1:])]


def _array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax_terms(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top))


def binned_mean(logits: Column, lo: float, hi: float, n: int) -> Column:
    """Expectation of softmax(logits) over the bin centres."""
    terms = softmax_terms(logits)
    centres = F.array(*[F.lit(c) for c in bin_centres(lo, hi, n)])
    weighted = F.zip_with(terms, centres, lambda t, c: t * c)
    return _array_total(weighted) / _array_total(terms)


def binned_logprob(logits: Column, value: Column, lo: float, hi: float, n: int) -> Column:
    """log softmax at the bin whose centre is nearest to ``value``; the first wins a tie."""
    centres = F.array(*[F.lit(c) for c in bin_centres(lo, hi, n)])
    gaps = F.transform(centres, lambda c: F.abs(value - c))
    index = F.array_position(gaps, F.array_min(gaps)).cast("int")
    top = F.array_max(logits)
    return F.element_at(logits, index) - top - F.log(_array_total(softmax_terms(logits)))


def relpos_one_hot(i: Column, j: Column, cuts=RELPOS_CUTS) -> Column:
    """The bucket as 0/1 flags, each from its own two borders (no lambda, so it stays in compiled code)."""
    distance = F.abs(i - j)
    flags = []
    for k in range(len(cuts) + 1):
        inside = F.lit(True)
        if k > 0:
            inside = inside & (distance > cuts[k - 1])
        if k < len(cuts):
            inside = inside & (distance <= cuts[k])
        flags.append(inside.cast("int"))
    return F.array(*flags)
