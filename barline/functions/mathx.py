"""Normal distribution and option pricing as native column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.cols import col

# Hart's rational approximation of the normal distribution function
# (published by West, "Better approximations to cumulative normal functions")
HART_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Acklam's rational approximation of the normal quantile
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

EULER_GAMMA = 0.5772156649
TRADING_DAYS = 252
RISK_FREE = 0.065


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value once for an expression that mentions it many times.

    Spark repeats a nested expression at every mention; long formulas would grow
    past what it can compile.
    """
    return F.transform(F.array(value), use)[0]


def _poly(coeffs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + c
    return out


def _cdf(x: Column) -> Column:
    a = F.least(F.abs(x), F.lit(38.0))
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    body = F.exp(-a * a / 2)
    upper = F.when(a < 7.07106781186547, body * _poly(HART_NUM, a) / _poly(HART_DEN, a)).otherwise(
        body / tail / math.sqrt(2 * math.pi)
    )
    return F.when(x > 0, 1 - upper).otherwise(upper)


def norm_cdf(x: Column | str) -> Column:
    """Standard normal distribution function, accurate to about 1e-15 (there is no ``erf`` in Spark)."""
    x = col(x)
    return F.when(x.isNotNull(), let(x.cast("double"), _cdf))


def _first_guess(p: Column) -> Column:
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    return (
        F.when(p < 0.02425, let(low, lambda v: _poly(ACKLAM_C, v) / _poly(ACKLAM_D, v)))
        .when(p > 1 - 0.02425, let(high, lambda v: -_poly(ACKLAM_C, v) / _poly(ACKLAM_D, v)))
        .otherwise(q * let(q * q, lambda v: _poly(ACKLAM_A, v) / _poly(ACKLAM_B, v)))
    )


def norm_ppf(p: Column | str) -> Column:
    """Standard normal quantile with one correction step; NULL outside (0, 1)."""
    p = col(p)

    def corrected(pp: Column) -> Column:
        def step(x: Column) -> Column:
            miss = (_cdf(x) - pp) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
            return let(miss, lambda u: x - u / (1 + x * u / 2))

        return let(_first_guess(pp), step)

    return F.when((p > 0) & (p < 1), let(p.cast("double"), corrected))


def chi2_sf(x: Column | str, dof: int) -> Column:
    """Upper tail of the chi-square distribution with a whole number of degrees of freedom, in closed form."""
    x = F.greatest(col(x).cast("double"), F.lit(0.0))
    half = x / 2
    if dof % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, dof // 2):
            term = term * half / k
            total = total + term
        return F.exp(-half) * total
    total, odd = F.lit(0.0), 1.0
    for k in range(1, (dof - 1) // 2 + 1):
        odd *= 2 * k - 1
        total = total + F.pow(x, F.lit(k - 0.5)) / odd
    return 2 * (norm_cdf(-F.sqrt(x)) + F.exp(-half) / math.sqrt(2 * math.pi) * total)


def expected_best_z(n_trials: Column | float) -> Column:
    """Expected largest of ``n_trials`` standard normal draws (extreme-value form); 0 for one trial."""
    if isinstance(n_trials, Column):
        a = norm_ppf(1 - 1 / n_trials)
        b = norm_ppf(1 - 1 / (n_trials * math.e))
        return F.when(n_trials > 1, a * (1 - EULER_GAMMA) + b * EULER_GAMMA).otherwise(0.0)
    if n_trials <= 1:
        return F.lit(0.0)
    q = NormalDist().inv_cdf
    return F.lit(q(1 - 1 / n_trials) * (1 - EULER_GAMMA) + q(1 - 1 / (n_trials * math.e)) * EULER_GAMMA)


def noise_sharpe(n_trials: Column | float, n_obs: Column | str) -> Column:
    """Annualised Sharpe ratio the best of ``n_trials`` pure-noise strategies is expected to show."""
    n = col(n_obs)
    return F.when(n >= 2, expected_best_z(n_trials) * F.sqrt(TRADING_DAYS / n)).otherwise(0.0)


def deflated_sharpe(
    sharpe: Column | str, n_obs: Column | str, n_trials: Column | float, skew: Column | float = 0.0, kurt: Column | float = 3.0
) -> Column:
    """Probability that a Sharpe ratio beats the best of ``n_trials`` noise strategies."""
    sr = col(sharpe) / math.sqrt(TRADING_DAYS)
    n = col(n_obs)
    sk = skew if isinstance(skew, Column) else F.lit(float(skew))
    ku = kurt if isinstance(kurt, Column) else F.lit(float(kurt))
    left = F.greatest(n - 1, F.lit(1))
    bench = expected_best_z(n_trials) / F.sqrt(left)
    spread = F.sqrt(F.greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, F.lit(1e-12)) / left)
    return F.when(n >= 3, norm_cdf((sr - bench) / spread)).otherwise(0.0)


def option_price(spot: Column, strike: Column, years: Column, vol: Column, is_call: Column, rate: float = RISK_FREE) -> Column:
    """European option value; intrinsic where any input is not positive."""
    sigma = vol * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / sigma
    side = F.when(is_call, 1.0).otherwise(-1.0)
    held = strike * F.exp(-rate * years)
    live = side * (spot * norm_cdf(side * d1) - held * norm_cdf(side * (d1 - sigma)))
    ok = (years > 0) & (vol > 0) & (spot > 0) & (strike > 0)
    return F.when(ok, live).otherwise(F.greatest(side * (spot - strike), F.lit(0.0)))


def implied_vol(
    price: Column, spot: Column, strike: Column, years: Column, is_call: Column,
    rate: float = RISK_FREE, lo: float = 1e-4, hi: float = 5.0, tol: float = 1e-4, steps: int = 60,
) -> Column:
    """Volatility that reproduces a price, by bisection folded over a fixed number of steps.

    NULL outside the no-arbitrage bounds. The value grows with volatility, so a
    step only needs the sign of the price error at the midpoint; it stops moving
    once the error is below ``tol``.
    """
    held = strike * F.exp(-rate * years)
    floor = F.greatest(F.when(is_call, spot - held).otherwise(held - spot), F.lit(0.0))
    cap = F.when(is_call, spot).otherwise(held)

    def error(v: Column) -> Column:
        return option_price(spot, strike, years, v, is_call, rate) - price

    usable = (
        price.isNotNull() & spot.isNotNull() & strike.isNotNull()
        & (years > 0) & (price > 0) & (spot > 0) & (strike > 0)
        & (price >= floor - 1e-6) & (price < cap)
        & (error(F.lit(lo)) * error(F.lit(hi)) <= 0)
    )

    def halve(state: Column, _: Column) -> Column:
        def moved(mid: Column) -> Column:
            return let(error(mid), lambda e: F.struct(
                F.when((F.abs(e) < tol) | (e >= 0), state["lo"]).otherwise(mid).alias("lo"),
                F.when((F.abs(e) < tol) | (e < 0), state["hi"]).otherwise(mid).alias("hi"),
                (F.abs(e) < tol).alias("done"),
            ))

        return F.when(state["done"], state).otherwise(let((state["lo"] + state["hi"]) / 2, moved))

    start = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(usable, found)


def kelly(win_rate: Column | str, win_loss: Column | str, multiplier: float = 0.25) -> Column:
    """Fraction of the growth-optimal stake; never negative."""
    p = F.least(F.greatest(col(win_rate), F.lit(0.0)), F.lit(1.0))
    b = col(win_loss)
    return F.when(b > 0, F.greatest((b * p - (1 - p)) / b, F.lit(0.0)) * multiplier).otherwise(0.0)
