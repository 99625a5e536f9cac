"""Trading-cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.cols import col

# Statutory charges of the venue, as fractions of notional
BROKERAGE = 0.0
TRANSACTION_TAX_BUY = 0.001
TRANSACTION_TAX_SELL = 0.001
EXCHANGE_FEE = 2.97e-05
REGULATOR_FEE = 1e-06
STAMP_DUTY_BUY = 0.00015
SERVICE_TAX = 0.18

# Slippage by bar volume, in percent, and its ceiling
HIGH_VOLUME, HIGH_SLIPPAGE = 10_000_000, 0.05
MID_VOLUME, MID_SLIPPAGE = 1_000_000, 0.15
LOW_SLIPPAGE = 0.50
MAX_SLIPPAGE = 0.05


def cost_fraction(is_buy: Column) -> Column:
    """All charges of one side as a fraction of notional."""
    fees = (BROKERAGE + EXCHANGE_FEE + REGULATOR_FEE) * (1 + SERVICE_TAX)
    return F.when(is_buy, F.lit(TRANSACTION_TAX_BUY + STAMP_DUTY_BUY + fees)).otherwise(F.lit(TRANSACTION_TAX_SELL + fees))


def round_trip_bps() -> Column:
    return (cost_fraction(F.lit(True)) + cost_fraction(F.lit(False))) * 10_000


def trade_cost(notional: Column | str, is_buy: Column) -> Column:
    return F.abs(col(notional)) * cost_fraction(is_buy)


def slippage(
    bar_volume: Column | str, trade_value: Column | None = None, daily_value: Column | None = None,
    high: float = HIGH_VOLUME, mid: float = MID_VOLUME,
) -> Column:
    """Slippage fraction by liquidity tier, plus market impact where daily turnover is known."""
    v = col(bar_volume)
    base = F.when(v >= high, HIGH_SLIPPAGE).when(v >= mid, MID_SLIPPAGE).otherwise(LOW_SLIPPAGE) / 100
    if trade_value is None or daily_value is None:
        return base
    impact = F.least(base + trade_value / daily_value * 0.01, F.lit(MAX_SLIPPAGE))
    return F.when(daily_value > 0, impact).otherwise(base)
