"""Column expressions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PREFIX = "720575940"


def entropy(pre: Column, post: Column) -> Column:
    """Binary entropy (base 2) of two counts; 0 if either, or both, are 0."""
    p = lambda x: x / (pre + post)
    both = (pre > 0) & (post > 0)
    return F.when(both, -(p(pre) * F.log2(p(pre)) + p(post) * F.log2(p(post)))).otherwise(0.0)


def segregation(ax_pre: Column, ax_post: Column, de_pre: Column, de_post: Column) -> tuple[Column, Column]:
    """(index, information gain) of a neuron; null where the whole has no entropy."""
    ax, de = ax_pre + ax_post, de_pre + de_post
    whole = entropy(ax_pre + de_pre, ax_post + de_post)
    inside = (ax * entropy(ax_pre, ax_post) + de * entropy(de_pre, de_post)) / (ax + de)
    return F.when(whole > 0, 1 - inside / whole), F.when(whole > 0, whole - inside)


def full_id(suffix: Column) -> Column:
    """The fixed prefix put before a non-negative suffix; 64-bit throughout."""
    return F.concat(F.lit(ID_PREFIX), suffix.cast("string")).cast("bigint")


def without_side(npil: Column) -> Column:
    return F.regexp_replace(npil, "_[LR]$", "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    """x, null where it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bin_right(x: Column, low: Column, step: Column, bins: int) -> Column:
    """Number of the right-closed bin of x; what lies at or below the lowest edge is in bin 0, and so is all if the bins have no width."""
    at = F.ceil(F.coalesce(F.try_divide(x - low, step), F.lit(0.0))) - 1
    return F.when(x.isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("int")


def bin_left(x: Column, low: Column, step: Column, bins: int | Column) -> Column:
    """Number of the left-closed bin of x, the last one closed on both sides; 0 if the bins have no width."""
    at = F.floor(F.coalesce(F.try_divide(x - low, step), F.lit(0.0)))
    return F.when(x.isNotNull(), F.least(at, F.lit(bins - 1) if isinstance(bins, int) else bins - 1)).cast("int")


def most_of(columns: list[str]) -> Column:
    """Name of the column that is largest; the first of equals."""
    top = F.greatest(*[F.col(c) for c in columns])
    out = F.when(F.col(columns[0]) == top, columns[0])
    for c in columns[1:]:
        out = out.when(F.col(c) == top, c)
    return out


def zscore_scale(x: Column) -> Column:
    """Variance-stabilised share: arcsine of its square root."""
    return F.asin(F.sqrt(x))
