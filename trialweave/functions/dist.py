"""Distribution functions.

The normal CDF and quantile are expression text (they stay inside code generation and the same
text runs in any SQL engine). Tails that have no closed expression are Arrow pandas UDFs on
numpy, meant for the small per-group result tables.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Coefficients of Wichura (1988), algorithm AS 241, routine PPND16.
AS241_A = ("3.3871328727963666080e0", "1.3314166789178437745e2", "1.9715909503065514427e3", "1.3731693765509461125e4",
           "4.5921953931549871457e4", "6.7265770927008700853e4", "3.3430575583588128105e4", "2.5090809287301226727e3")
AS241_B = ("1.0e0", "4.2313330701600911252e1", "6.8718700749205790830e2", "5.3941960214247511077e3",
           "2.1213794301586595867e4", "3.9307895800092710610e4", "2.8729085735721942674e4", "5.2264952788528545610e3")
AS241_C = ("1.42343711074968357734e0", "4.63033784615654529590e0", "5.76949722146069140550e0",
           "3.64784832476320460504e0", "1.27045825245236838258e0", "2.41780725177450611770e-1",
           "2.27238449892691845833e-2", "7.74545014278341407640e-4")
AS241_D = ("1.0e0", "2.05319162663775882187e0", "1.67638483018380384940e0", "6.89767334985100004550e-1",
           "1.48103976427480074590e-1", "1.51986665636164571966e-2", "5.47593808499534494600e-4",
           "1.05075007164441684324e-9")
AS241_E = ("6.65790464350110377720e0", "5.46378491116411436990e0", "1.78482653991729133580e0",
           "2.96560571828504891230e-1", "2.65321895265761230930e-2", "1.24266094738807843860e-3",
           "2.71155556874348757815e-5", "2.01033439929228813265e-7")
AS241_F = ("1.0e0", "5.99832206555887937690e-1", "1.36929880922735805310e-1", "1.48753612908506148525e-2",
           "7.86869131145613259100e-4", "1.84631831751005468180e-5", "1.42151175831644588870e-7",
           "2.04426310338993978564e-15")
# Coefficients of Hart (1968), algorithm 5666, for the normal tail.
HART_P = ("220.206867912376e0", "221.213596169931e0", "112.079291497871e0", "33.912866078383e0", "6.37396220353165e0",
          "0.700383064443688e0", "3.52624965998911e-2")
HART_Q = ("440.413735824752e0", "793.826512519948e0", "637.333633378831e0", "296.564248779674e0", "86.7807322029461e0",
          "16.064177579207e0", "1.75566716318264e0", "8.83883476483184e-2")


def _poly(coef: tuple[str, ...], x: str) -> str:
    text = coef[-1]
    for c in reversed(coef[:-1]):
        text = f"({text} * {x} + {c})"
    return text


def norm_quantile_sql(p: str) -> str:
    """Normal quantile of the SQL expression ``p`` (0 < p < 1)."""
    q = f"(({p}) - 0.5e0)"
    r0 = f"(0.180625e0 - {q} * {q})"
    r1 = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    sign = f"(CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END)"
    centre = f"{q} * {_poly(AS241_A, r0)} / {_poly(AS241_B, r0)}"
    mid = f"{sign} * {_poly(AS241_C, f'({r1} - 1.6e0)')} / {_poly(AS241_D, f'({r1} - 1.6e0)')}"
    tail = f"{sign} * {_poly(AS241_E, f'({r1} - 5e0)')} / {_poly(AS241_F, f'({r1} - 5e0)')}"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {centre} "
            f"WHEN {r1} <= 5e0 THEN {mid} ELSE {tail} END)")


def norm_tail_sql(x: str) -> str:
    """Upper normal tail of abs(x)."""
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2e0)"
    body = f"{e} * {_poly(HART_P, a)} / {_poly(HART_Q, a)}"
    frac = f"({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0)))))"
    return (f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {body} "
            f"ELSE {e} / {frac} / 2.506628274631e0 END)")


def norm_cdf_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN 1e0 - {norm_tail_sql(x)} ELSE {norm_tail_sql(x)} END)"


def chi2_tail1_sql(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    return f"(2e0 * {norm_tail_sql(f'sqrt({x})')})"


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Student t quantile by bisection on the tail probability."""
    if not (0.0 < p < 1.0) or not df > 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    target = 2.0 * min(p, 1.0 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > target:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > target:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * hi:
            break
    t = (lo + hi) / 2.0
    return t if p > 0.5 else -t


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0.0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log_front) * h


def _map2(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else fn(float(x), float(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _map2(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def chi2_tail_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _map2(lambda v, k: gamma_tail(k / 2.0, v / 2.0), x, df)


@F.pandas_udf(DoubleType())
def binom_half_two_sided_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided sign-test p: P(X <= min(k, n-k)) doubled, X ~ Binomial(n, 1/2)."""
    def one(kk: float, nn: float) -> float:
        lo = min(kk, nn - kk)
        if nn == 0:
            return 1.0
        return min(1.0, 2.0 * beta_inc(nn - lo, lo + 1.0, 0.5)) if lo < nn else 1.0
    return _map2(one, k, n)


def t_quantile_col(p: float, dof: Column, table_size: int = 200) -> Column:
    """t quantile for whole degrees of freedom and a fixed p, without leaving the JVM.

    Small degrees of freedom are looked up in an array computed once by ``t_quantile``; beyond it the
    expansion in 1/dof about the normal quantile is exact to about 1e-10.
    """
    z = NormalDist().inv_cdf(p)
    g = (z, (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
         (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160)
    head = F.array(*[F.lit(t_quantile(p, k)) for k in range(1, table_size + 1)])
    n = dof.cast("double")
    tail = sum((F.lit(c) / F.pow(n, F.lit(float(i))) for i, c in enumerate(g[1:], 1)), F.lit(z))
    return F.when(dof >= 1, F.when(dof <= table_size, F.get(head, dof.cast("int") - 1)).otherwise(tail))


def norm_quantile(col: str) -> Column:
    return F.expr(norm_quantile_sql(col))


def norm_cdf(col: str) -> Column:
    return F.expr(norm_cdf_sql(col))


def chi2_tail1(col: str) -> Column:
    return F.expr(chi2_tail1_sql(col))


def t_values_sql(p: float, up_to: int) -> str:
    """``(df, tq)`` rows for checking queries in an engine without a t quantile."""
    return ", ".join(f"({d}, {t_quantile(p, d)!r})" for d in range(1, up_to + 1))


