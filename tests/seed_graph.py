"""The starting graph of market drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Drivers (name, category, update frequency)
NODES = (
    ("FED_FUNDS_RATE", "macro", "1d"), ("US_CPI", "macro", "1d"), ("US_GDP_GROWTH", "macro", "1d"),
    ("US_10Y_YIELD", "macro", "1h"), ("US_2Y_YIELD", "macro", "1h"), ("YIELD_CURVE_SPREAD", "macro", "1h"),
    ("DXY", "fx", "1m"), ("VIX", "sentiment", "1m"), ("SPX", "equity", "1m"), ("NDX", "equity", "1m"),
    ("GOLD", "commodity", "1m"), ("WTI_OIL", "commodity", "1m"), ("BTC", "crypto", "1m"), ("USDJPY", "fx", "1m"),
    ("EURUSD", "fx", "1m"), ("CHINA_PMI", "macro", "1d"), ("BRAZIL_COFFEE", "commodity", "1d"),
    ("JAPAN_TOPIX", "equity", "1h"), ("SEMICONDUCTOR_INDEX", "equity", "1h"), ("CREDIT_SPREAD", "macro", "1h"),
    ("MARKET_BREADTH", "sentiment", "1h"), ("RETAIL_SENTIMENT", "sentiment", "1h"),
    ("ORDER_FLOW_IMBALANCE", "orderflow", "1m"), ("CEO_SENTIMENT_INDEX", "sentiment", "1d"), ("GLOBAL_M2", "macro", "1d"),
)
# Links (source, target, weight, lag in bars, mechanism, confidence)
EDGES = (
    ("FED_FUNDS_RATE", "US_10Y_YIELD", 0.85, 1, "linear", 0.95), ("FED_FUNDS_RATE", "US_2Y_YIELD", 0.92, 0, "linear", 0.97),
    ("FED_FUNDS_RATE", "USDJPY", 0.67, 2, "nonlinear", 0.82), ("FED_FUNDS_RATE", "GOLD", -0.55, 3, "nonlinear", 0.78),
    ("US_CPI", "FED_FUNDS_RATE", 0.88, 30, "linear", 0.91), ("US_10Y_YIELD", "SPX", -0.72, 1, "nonlinear", 0.87),
    ("YIELD_CURVE_SPREAD", "CREDIT_SPREAD", -0.81, 5, "linear", 0.89), ("CREDIT_SPREAD", "SPX", -0.76, 2, "nonlinear", 0.84),
    ("DXY", "GOLD", -0.83, 0, "linear", 0.94), ("DXY", "EURUSD", -0.99, 0, "linear", 0.99),
    ("DXY", "BRAZIL_COFFEE", -0.61, 1, "nonlinear", 0.75), ("BRAZIL_COFFEE", "USDJPY", 0.34, 3, "nonlinear", 0.61),
    ("USDJPY", "JAPAN_TOPIX", -0.71, 0, "linear", 0.88), ("JAPAN_TOPIX", "SEMICONDUCTOR_INDEX", 0.58, 1, "nonlinear", 0.72),
    ("SEMICONDUCTOR_INDEX", "NDX", 0.86, 0, "linear", 0.93), ("NDX", "SPX", 0.94, 0, "linear", 0.98),
    ("VIX", "SPX", -0.88, 0, "nonlinear", 0.96), ("VIX", "GOLD", 0.45, 0, "nonlinear", 0.7),
    ("WTI_OIL", "US_CPI", 0.62, 60, "linear", 0.79), ("CHINA_PMI", "WTI_OIL", 0.58, 5, "nonlinear", 0.74),
    ("GLOBAL_M2", "BTC", 0.71, 14, "nonlinear", 0.69), ("GLOBAL_M2", "GOLD", 0.64, 30, "linear", 0.77),
    ("ORDER_FLOW_IMBALANCE", "SPX", 0.79, 0, "nonlinear", 0.85), ("CEO_SENTIMENT_INDEX", "SPX", 0.52, 5, "nonlinear", 0.68),
    ("RETAIL_SENTIMENT", "VIX", -0.43, 2, "nonlinear", 0.65), ("MARKET_BREADTH", "SPX", 0.74, 1, "linear", 0.82),
)


def seed_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODES), "node string, category string, update_freq string")


def seed_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(EDGES), "source string, target string, weight double, lag_bars int, mechanism string, confidence double"
    )
