"""Participant positions and derivative contracts to daily features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import mathx

# Instrument and option codes of the contract files
FUTURES = ("STF", "IDF")
OPTIONS = ("STO", "IDO")
CALL, PUT = "CE", "PE"

FLOW_FEATURES = (
    "fii_idx_fut_net", "fii_idx_fut_net_chg", "fii_stk_fut_net", "dii_idx_fut_net", "client_idx_fut_net", "fii_opt_directional",
)


def net_ratio(long: Column, short: Column) -> Column:
    """(long - short) / (long + short), NULL unless the total is positive."""
    total = long + short
    return F.when(total > 0, (long - short) / total)


def position_features(cells: DataFrame) -> DataFrame:
    """Six market-wide features per day from (dt, participant, field, value) cells."""
    def cell(who: str, field: str) -> Column:
        return F.max(F.when((F.col("participant") == who) & (F.col("field") == field), F.col("value")))
    day = cells.groupBy("dt").agg(
        net_ratio(cell("FII", "future index long"), cell("FII", "future index short")).alias("fii_idx_fut_net"),
        net_ratio(cell("FII", "future stock long"), cell("FII", "future stock short")).alias("fii_stk_fut_net"),
        net_ratio(cell("DII", "future index long"), cell("DII", "future index short")).alias("dii_idx_fut_net"),
        net_ratio(cell("Client", "future index long"), cell("Client", "future index short")).alias("client_idx_fut_net"),
        net_ratio(
            cell("FII", "option index call long") + cell("FII", "option index put short"),
            cell("FII", "option index put long") + cell("FII", "option index call short"),
        ).alias("fii_opt_directional"),
    )
    # one row per report day
    before = F.lag("fii_idx_fut_net").over(Window.orderBy("dt"))
    return day.withColumn("fii_idx_fut_net_chg", F.col("fii_idx_fut_net") - before).select("dt", *FLOW_FEATURES)


def contract_aggregates(contracts: DataFrame) -> DataFrame:
    """Open-interest and volume ratios, near-future basis and turnover ratio per symbol and day.

    Contract rows: sym, dt, instrument, expiry, strike, option, close, settle, spot,
    oi, oi_change, volume, seq (order of rows in the file).
    """
    fut, opt = F.col("instrument").isin(*FUTURES), F.col("instrument").isin(*OPTIONS)
    call, put = opt & (F.col("option") == CALL), opt & (F.col("option") == PUT)
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    dated = fut & F.col("expiry").isNotNull()
    near = F.struct("expiry", "oi", "oi_change", "close", "spot")
    day = contracts.groupBy("sym", "dt").agg(
        total("oi", call).alias("_co"), total("oi", put).alias("_po"), total("volume", call).alias("_cv"), total("volume", put).alias("_pv"),
        total("volume", fut).alias("_fv"), total("volume", opt).alias("_ov"),
        F.min_by(F.when(dated, near), F.when(dated, F.struct("expiry", "seq"))).alias("_n"),
    )
    log_ratio = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.ln(F.col(a) / F.col(b)))
    days = F.greatest(F.datediff("_n.expiry", "dt"), F.lit(1))
    spot = F.col("_n.spot")
    return day.select(
        "sym", "dt",
        log_ratio("_po", "_co").alias("pcr_oi"),
        log_ratio("_pv", "_cv").alias("pcr_volume"),
        F.when(F.col("_n.oi") > 0, F.col("_n.oi_change") / F.col("_n.oi")).alias("oi_change_norm"),
        F.when(spot > 0, (F.col("_n.close") / spot - 1) * 365.0 / days).alias("basis_annualised"),
        F.when(F.col("_n").isNotNull(), log_ratio("_ov", "_fv")).alias("opt_volume_ratio"),
        F.when(spot > 0, spot).alias("spot"),
    )


#: (name, option side, strike target as a multiple of spot)
LEGS = (("atm_call", CALL, 1.0), ("atm_put", PUT, 1.0), ("otm_put", PUT, 0.95), ("otm_call", CALL, 1.05))


def volatility_legs(contracts: DataFrame, day: DataFrame, terms: int = 2) -> DataFrame:
    """Nearest-strike contracts of the first expiries, with their implied volatility.

    Expiries are ranked on their distinct table; one aggregate then picks all four
    strikes of an expiry, so only a handful of rows per symbol and day is inverted.
    """
    opts = contracts.where(F.col("instrument").isin(*OPTIONS) & F.col("expiry").isNotNull()).select(
        "sym", "dt", "expiry", "strike", "option", "seq", F.when(F.col("settle") > 0, F.col("settle")).otherwise(F.col("close")).alias("px")
    )
    terms_of = opts.select("sym", "dt", "expiry").distinct().withColumn(
        "term", F.row_number().over(Window.partitionBy("sym", "dt").orderBy("expiry"))
    ).where(F.col("term") <= terms)
    priced = opts.join(terms_of, ["sym", "dt", "expiry"]).join(day.select("sym", "dt", "spot"), ["sym", "dt"])
    picks = []
    for name, side, at in LEGS:
        ok = (F.col("option") == side) & (F.col("px") > 0) & F.col("strike").isNotNull()
        order = F.struct(F.abs(F.col("strike") - F.col("spot") * at).alias("gap"), F.col("seq"))
        picks.append(F.min_by(F.when(ok, F.struct("strike", "px")), F.when(ok, order)).alias(name))
    legs = priced.groupBy("sym", "dt", "expiry", "term", "spot").agg(*picks)
    # one row per leg, so the inversion is planned once
    cells = F.array(
        *[F.struct(F.lit(n).alias("leg"), F.lit(side == CALL).alias("call"), F.col(f"{n}.strike").alias("strike"), F.col(f"{n}.px").alias("px")) for n, side, _ in LEGS]
    )
    years = F.greatest(F.datediff("expiry", "dt"), F.lit(1)) / 365.0
    rows = legs.select("sym", "dt", "term", "spot", years.alias("years"), F.explode(cells).alias("c")).select("*", "c.*")
    vols = rows.where(F.col("px").isNotNull()).withColumn(
        "vol", mathx.implied_vol(F.col("px"), F.col("spot"), F.col("strike"), F.col("years"), F.col("call"))
    )
    pick = lambda n: F.max(F.when(F.col("leg") == n, F.col("vol"))).alias(n)
    return vols.groupBy("sym", "dt", "term").agg(*[pick(n) for n, _, _ in LEGS])


def contract_features(contracts: DataFrame) -> DataFrame:
    """All eight daily features of a contract table."""
    day = contract_aggregates(contracts)
    legs = volatility_legs(contracts, day)
    atm = F.when(
        F.col("atm_call").isNotNull() & F.col("atm_put").isNotNull(), (F.col("atm_call") + F.col("atm_put")) / 2
    ).otherwise(F.coalesce("atm_call", "atm_put"))
    legs = legs.withColumns({"atm": atm, "skew": F.col("otm_put") - F.col("otm_call")})
    term = lambda k, c: F.max(F.when(F.col("term") == k, F.col(c)))
    vols = legs.groupBy("sym", "dt").agg(
        term(1, "atm").alias("atm_iv"), term(1, "skew").alias("iv_skew"), (term(2, "atm") - term(1, "atm")).alias("iv_term")
    )
    return day.join(vols, ["sym", "dt"], "left").drop("spot")


