"""Upper tail probabilities: of columns, by Simpson sums over the densities around their peaks, and of one number, by continued fractions for the
incomplete gamma and beta (which the tests hold the columns against)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a sum.
STEPS = 800
#: A density's sum goes so many deviations to either side of its peak.
REACH = 16
TINY = "1e-300"  # stands for 0 in a logarithm


def _sum(density, low: Column, high: Column) -> Column:
    at = lambda i: low + (high - low) * i / F.lit(float(STEPS))
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    every = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda acc, i: acc + weight(i) * density(at(i)))
    return every * (high - low)


def _share(log_density, x: Column, peak: Column, deviation: Column, most: Column | None = None) -> Column:
    """Share of a density above x.  Its logarithm is taken less that of its peak, so it neither overflows nor vanishes."""
    low, high = F.greatest(peak - REACH * deviation, F.lit(0.0)), peak + REACH * deviation
    high = high if most is None else F.least(high, most)
    density = lambda u: F.exp(log_density(u) - log_density(peak))
    return F.try_divide(_sum(density, F.least(F.greatest(x, low), high), high), _sum(density, low, high))


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(float(TINY))))


def p_chi2(x: Column, df: Column) -> Column:
    """P(chi-square of df degrees > x); in u = sqrt(x / 2) the density is u^(df - 1) exp(-u^2)."""
    log_density = lambda u: (df - 1) * _log(u) - u * u
    return F.when(x.isNotNull() & (df > 0), _share(log_density, F.sqrt(F.greatest(x, F.lit(0.0)) / 2), F.sqrt(F.greatest(df - 1, F.lit(0)) / 2), F.lit(0.5)))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    """P(F of d1 and d2 degrees > f); in w = atan(sqrt(d1 f / d2)) the density is cos(w)^(d2 - 1) sin(w)^(d1 - 1)."""
    log_density = lambda w: (d2 - 1) * _log(F.cos(w)) + (d1 - 1) * _log(F.sin(w))
    peak = F.atan2(F.sqrt(F.greatest(d1 - 1, F.lit(0))), F.sqrt(F.greatest(d2 - 1, F.lit(0.0))))
    deviation = 1 / F.sqrt(2 * F.greatest(d1 + d2 - 2, F.lit(0.5)))
    w = F.atan(F.sqrt(F.try_divide(d1 * F.greatest(f, F.lit(0.0)), d2)))
    return F.when(f.isNotNull() & (d1 > 0) & (d2 > 0), _share(log_density, w, peak, deviation, F.lit(math.pi / 2)))


def p_t(t: Column, df: Column) -> Column:
    """Two-sided."""
    return p_f(t * t, F.lit(1), df)


def p_z(z: Column) -> Column:
    """Two-sided."""
    return p_chi2(z * z, F.lit(1))


def _sql_share(log_density: str, x: str, peak: str, deviation: str, most: str) -> str:
    low, high = f"greatest({peak} - {REACH} * {deviation}, 0)", f"least({peak} + {REACH} * {deviation}, {most})"

    def total(start: str) -> str:
        u = f"(s.a + (s.z - s.a) * i / {STEPS}.0)"
        weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
        return (f"(SELECT any_value(s.z - s.a) * sum({weight} * exp({log_density.replace('@', u)} - ({log_density.replace('@', 's.p')})))"
                f" FROM (SELECT ({start})::DOUBLE AS a, ({high})::DOUBLE AS z, ({peak})::DOUBLE AS p) s, range({STEPS + 1}) AS t(i))")
    return f"{total(f'least(greatest({x}, {low}), {high})')} / {total(low)}"


def sql_chi2(x: str, df: str) -> str:
    share = _sql_share(f"(({df}) - 1) * ln(greatest(@, {TINY})) - @ * @", f"sqrt(greatest({x}, 0) / 2)", f"sqrt(greatest(({df}) - 1, 0) / 2)", "0.5", "1e300")
    return f"CASE WHEN ({x}) IS NOT NULL AND ({df}) > 0 THEN {share} END"


def sql_f(f: str, d1: str, d2: str) -> str:
    log_density = f"(({d2}) - 1) * ln(greatest(cos(@), {TINY})) + (({d1}) - 1) * ln(greatest(sin(@), {TINY}))"
    peak, deviation = f"atan2(sqrt(greatest(({d1}) - 1, 0)), sqrt(greatest(({d2}) - 1, 0)))", f"(1 / sqrt(2 * greatest(({d1}) + ({d2}) - 2, 0.5)))"
    share = _sql_share(log_density, f"atan(sqrt(({d1}) * greatest({f}, 0) / ({d2})))", peak, deviation, "pi() / 2")
    return f"CASE WHEN ({f}) IS NOT NULL AND ({d1}) > 0 AND ({d2}) > 0 THEN {share} END"


def sql_t(t: str, df: str) -> str:
    return sql_f(f"({t}) * ({t})", "1", df)


def sql_z(z: str) -> str:
    return sql_chi2(f"({z}) * ({z})", "1")


def sql_with(sql: str, **added: str) -> str:
    """A statement (common tables, then SELECT) with further columns, worked out from its own as r."""
    at = max((m.start(1) for m in re.finditer(r"\)\s+(SELECT )", sql)), default=0)
    more = ", ".join(f"round({x}, 6) AS {n}" for n, x in added.items())
    return f"{sql[:at].rstrip()}{',' if at else ''} r AS ({sql[at:]}) SELECT r.*, {more} FROM r"


def _fraction(term, tiny: float = 1e-300, most: int = 500) -> float:
    """Value of a continued fraction 1 / (1 + a1 / (1 + ...)) by the modified Lentz steps; term(i) = (a_i, b_i)."""
    f = d = 0.0
    c = 1.0
    f = tiny
    c = f
    for i in range(1, most):
        a, b = term(i)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    return front * _fraction(lambda i: (1.0, x + 1 - a) if i == 1 else (-(i - 1) * (i - 1 - a), x + 2 * i - 1 - a))


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)

    def term(i: int) -> tuple[float, float]:
        if i == 1:
            return 1.0, 1.0
        m, odd = divmod(i - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front * _fraction(term)


def chi2(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def f(x: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
