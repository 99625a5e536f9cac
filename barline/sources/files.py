"""Readers of landed files: every vintage ends in one set of column names.

All readers take strings, trim headers, cast with ``try_*`` and keep an
unreadable value as NULL. A file without its required columns is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header names of the venue files, legacy name -> current name
PRICE_COLUMNS = (
    "TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "PrvsClsgPric", "TtlTradgVol", "FinInstrmTp",
)
PRICE_LEGACY = {
    "SYMBOL": "TckrSymb", "SERIES": "SctySrs", "OPEN": "OpnPric", "HIGH": "HghPric", "LOW": "LwPric", "CLOSE": "ClsPric",
    "PREVCLOSE": "PrvsClsgPric", "TOTTRDQTY": "TtlTradgVol", "TOTTRDVAL": "TtlTrfVal", "TIMESTAMP": "TradDt",
}
CONTRACT_COLUMNS = (
    "TradDt", "FinInstrmTp", "TckrSymb", "XpryDt", "StrkPric", "OptnTp", "ClsPric", "SttlmPric", "UndrlygPric",
    "OpnIntrst", "ChngInOpnIntrst", "TtlTradgVol",
)
CONTRACT_LEGACY = {
    "SYMBOL": "TckrSymb", "EXPIRY_DT": "XpryDt", "STRIKE_PR": "StrkPric", "OPTION_TYP": "OptnTp", "CLOSE": "ClsPric",
    "SETTLE_PR": "SttlmPric", "OPEN_INT": "OpnIntrst", "CHG_IN_OI": "ChngInOpnIntrst", "CONTRACTS": "TtlTradgVol",
    "TIMESTAMP": "TradDt",
}
INSTRUMENT_LEGACY = {"FUTSTK": "STF", "OPTSTK": "STO", "FUTIDX": "IDF", "OPTIDX": "IDO"}
DELIVERY_COLUMNS = ("SYMBOL", "SERIES", "TTL_TRD_QNTY", "NO_OF_TRADES", "DELIV_QTY")
SECOND_VENUE_GROUPS = ("A", "B")
PARTICIPANTS = ("Client", "DII", "FII", "Pro")
DATE_FORMATS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy")
ANNOUNCED_FIELDS = ("an_dt", "sort_date", "exchdisstime", "dt")
ANNOUNCED_FORMATS = ("dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss")

DEPTH_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("ts", "xts", "tk")]
    + [T.StructField("ltp", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("lq", "v", "tbq", "tsq")]
    + [T.StructField(c, T.ArrayType(T.ArrayType(T.DoubleType()))) for c in ("b", "a")]
    + [T.StructField("seq", T.LongType())]
)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV as strings with trimmed headers."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def _require(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")


def any_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that parses, as a date. Month names may be upper case."""
    c = F.initcap(F.trim(c))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def number(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit("-")).try_cast("double")


def read_daily_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily price files of either vintage under one vocabulary."""
    df = read_strings(spark, path)
    if "SYMBOL" in df.columns and "TckrSymb" not in df.columns:
        df = df.withColumnsRenamed(PRICE_LEGACY).withColumn("FinInstrmTp", F.lit("STK"))
    _require(df, PRICE_COLUMNS, "price file")
    prices = {"OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close", "PrvsClsgPric": "prev_close", "TtlTradgVol": "volume", "TtlTrfVal": "turnover"}
    null = F.lit(None).cast("string")
    return df.select(
        F.trim("TckrSymb").alias("sym"),
        (any_date(F.col("TradDt")) if "TradDt" in df.columns else null.cast("date")).alias("dt"),
        F.trim("SctySrs").alias("series"), F.trim("FinInstrmTp").alias("instrument"),
        (F.trim("ISIN") if "ISIN" in df.columns else null).alias("isin"),
        *[(number(c) if c in df.columns else null.cast("double")).alias(n) for c, n in prices.items()],
    )


def price_rows(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Equity rows of the wanted symbols: listing filters first, columns last."""
    from barline.operators.quality import equities_only

    kept = equities_only(rows).join(universe.select("sym").distinct(), "sym", "left_semi")
    return kept.select("sym", "dt", "open", "high", "low", "close", "prev_close", "volume", "turnover")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Derivative-contract files of either vintage."""
    df = read_strings(spark, path)
    if "INSTRUMENT" in df.columns and "FinInstrmTp" not in df.columns:
        kinds = F.create_map(*[F.lit(x) for kv in INSTRUMENT_LEGACY.items() for x in kv])
        df = df.withColumnsRenamed(CONTRACT_LEGACY).withColumn("FinInstrmTp", kinds[F.trim("INSTRUMENT")])
        if "UndrlygPric" not in df.columns:
            df = df.withColumn("UndrlygPric", F.lit(None).cast("string"))
    _require(df, ("FinInstrmTp", "TckrSymb"), "contract file")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    option = F.upper(F.trim(F.coalesce(have("OptnTp"), F.lit(""))))
    return df.select(
        F.trim("TckrSymb").alias("sym"), any_date(have("TradDt")).alias("dt"), F.trim("FinInstrmTp").alias("instrument"),
        any_date(have("XpryDt")).alias("expiry"), F.when(option == "XX", "").otherwise(option).alias("option"),
        *[number(have(c)).alias(n) for c, n in (
            ("StrkPric", "strike"), ("ClsPric", "close"), ("SttlmPric", "settle"), ("UndrlygPric", "underlying"),
            ("OpnIntrst", "oi"), ("ChngInOpnIntrst", "oi_change"), ("TtlTradgVol", "volume"),
        )],
    )


def read_delivery(spark: SparkSession, path: str, universe: DataFrame | None = None) -> DataFrame:
    """Delivery files: EQ rows, a dash is a missing number."""
    df = read_strings(spark, path)
    _require(df, DELIVERY_COLUMNS, "delivery file")
    date = F.col("DATE1") if "DATE1" in df.columns else F.lit(None).cast("string")
    out = df.where(F.trim("SERIES") == "EQ").select(
        F.trim("SYMBOL").alias("sym"), any_date(date).alias("dt"),
        number("TTL_TRD_QNTY").alias("volume"), number("NO_OF_TRADES").alias("trades"), number("DELIV_QTY").alias("delivered"),
    )
    return out if universe is None else out.join(universe.select("sym").distinct(), "sym", "left_semi")


def read_second_venue(spark: SparkSession, path: str, universe: DataFrame | None = None) -> DataFrame:
    """Second-venue prices: main groups only, the most traded listing of a name wins."""
    df = read_strings(spark, path)
    _require(df, ("TckrSymb", "SctySrs", "ClsPric"), "second-venue file")
    volume = number("TtlTradgVol") if "TtlTradgVol" in df.columns else F.lit(None).cast("double")
    date = F.col("TradDt") if "TradDt" in df.columns else F.lit(None).cast("string")
    rows = df.where(F.upper(F.trim("SctySrs")).isin(*SECOND_VENUE_GROUPS)).select(
        F.upper(F.trim("TckrSymb")).alias("sym"), any_date(date).alias("dt"), F.upper(F.trim("SctySrs")).alias("grp"),
        number("ClsPric").alias("close"), volume.alias("volume"),
    )
    if universe is not None:
        rows = rows.join(universe.select("sym").distinct(), "sym", "left_semi")
    rank = F.struct(F.coalesce("volume", F.lit(-1.0)), F.col("grp"))
    return rows.groupBy("sym", "dt").agg(F.max_by(F.struct("close", "volume"), rank).alias("r")).select("sym", "dt", "r.*")


def parse_participants(reports: DataFrame, text: str = "text") -> DataFrame:
    """(dt, participant, field, value) from position reports ``(dt, text)``.

    A report has a preamble, a padded header row, quoted cells and thousands commas.
    Cells are split on commas outside quotes.
    """
    cell = lambda c: F.trim(F.regexp_replace(c, '"', ""))
    cells = lambda line: F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), cell)
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    rows = reports.select("dt", F.transform(F.split(F.col(text), r"\r?\n"), cells).alias("_rows"))
    header = F.filter("_rows", lambda r: norm(r[0]) == "client type")
    rows = rows.withColumn("_head", F.when(F.size(header) > 0, F.transform(header[0], norm)))
    known = F.filter("_rows", lambda r: r[0].isin(*PARTICIPANTS))
    body = rows.where(F.col("_head").isNotNull()).select("dt", "_head", F.explode(known).alias("_row"))
    pairs = F.zip_with("_head", "_row", lambda h, v: F.struct(h.alias("field"), F.regexp_replace(v, ",", "").try_cast("double").alias("value")))
    out = body.select("dt", F.col("_row")[0].alias("participant"), F.explode(F.slice(pairs, 2, F.size("_head"))).alias("c"))
    return out.select("dt", "participant", "c.field", "c.value").where(F.col("field").isNotNull() & F.col("value").isNotNull())


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    """Report files with their day (ddMMyyyy) in the name of the file, or of its folder (``day=..``)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.input_file_name()
    folder, file = F.regexp_extract(name, r"day=(\d{8})/", 1), F.regexp_extract(name, r"(\d{8})[^/\d]*$", 1)
    day = F.to_date(F.coalesce(F.nullif(folder, F.lit("")), F.nullif(file, F.lit(""))), "ddMMyyyy")
    return parse_participants(raw.select(day.alias("dt"), F.col("value").alias("text")))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(raw, seq): landed JSON payloads, one per line, and their sequence number where they carry one."""
    raw = spark.read.text(path).select(F.col("value").alias("raw"))
    return raw.select("raw", F.get_json_object("raw", "$.seq").try_cast("bigint").alias("seq"))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Recorded books, one JSON object per line, gzipped or plain; torn lines are skipped.

    The session comes from the file or folder name.
    """
    rows = spark.read.schema(DEPTH_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    name = F.input_file_name()
    digits = F.regexp_replace(F.regexp_extract(name, r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    return rows.withColumn("dt", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def depth_books(rows: DataFrame) -> DataFrame:
    """Recorded level lists as (quantity, price, orders) structs; ``seq`` is the order of arrival, by time where none was recorded."""
    level = lambda e: F.struct(e[0].alias("quantity"), e[1].alias("price"), e[2].cast("int").alias("orders"))
    return rows.select(
        F.col("tk").alias("sym"), "dt", "ts", "ltp", "v", F.coalesce("seq", "ts").alias("seq"), F.transform("b", level).alias("bids"), F.transform("a", level).alias("asks"),
    )


def parse_actions(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """Corporate-action JSON rows; an unreadable ex-date drops the row."""
    r = F.from_json(raw, "symbol string, exDate string, subject string")
    rows = payloads.select("*", r.alias("_r"))
    ex = F.try_to_timestamp(F.initcap("_r.exDate"), F.lit("dd-MMM-yyyy")).cast("date")
    keep = [c for c in payloads.columns if c != raw]
    return rows.select(*keep, F.col("_r.symbol").alias("sym"), ex.alias("dt"), F.coalesce("_r.subject", F.lit("")).alias("subject")).where(
        F.col("dt").isNotNull()
    )


def parse_announcements(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """(sym, dt): the first of four date fields and four formats that parses; otherwise the row is dropped."""
    r = F.from_json(raw, "symbol string, " + ", ".join(f"`{c}` string" for c in ANNOUNCED_FIELDS))
    rows = payloads.select("*", r.alias("_r"))
    tries = [F.try_to_timestamp(F.initcap(F.trim(F.col(f"_r.{c}"))), F.lit(f)) for c in ANNOUNCED_FIELDS for f in ANNOUNCED_FORMATS]
    keep = [c for c in payloads.columns if c != raw]
    return rows.select(*keep, F.upper(F.trim("_r.symbol")).alias("sym"), F.coalesce(*tries).cast("date").alias("dt")).where(F.col("dt").isNotNull())


def parse_articles(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """(dt, tone) per article; undated articles are dropped, an unreadable tone is missing."""
    r = F.from_json(raw, "articles array<struct<seendate string, tone string>>")
    rows = payloads.select(F.explode(r["articles"]).alias("a"))
    seen = F.try_to_timestamp(F.substring("a.seendate", 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    return rows.select(seen.cast("date").alias("dt"), F.col("a.tone").try_cast("double").alias("tone")).where(F.col("dt").isNotNull())


def daily_tone(articles: DataFrame) -> DataFrame:
    """Articles per day and their mean tone; a tone nobody gave is missing, not zero."""
    return articles.groupBy("dt").agg(F.count(F.lit(1)).alias("news_count"), F.avg("tone").alias("news_tone"))


def parse_feeds(feeds: DataFrame, raw: str = "raw") -> DataFrame:
    """(title, published) per item of feed documents; an unreadable date is NULL, a broken feed gives no item."""
    shape = "channel struct<item array<struct<title string, pubDate string>>>"
    keep = [c for c in feeds.columns if c != raw]
    items = feeds.select(*keep, F.explode(F.from_xml(raw, shape)["channel"]["item"]).alias("i"))
    # the weekday is redundant and strictly checked by the date parser, so it is cut off
    stamp = F.regexp_replace(F.trim("i.pubDate"), r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(stamp, r"\s(GMT|UTC|Z)$", " +0000")
    when = F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z"))
    return items.select(*keep, F.trim(F.coalesce("i.title", F.lit(""))).alias("title"), when.alias("published"))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed files as they were fetched, one document each."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_feeds(raw.select(F.input_file_name().alias("feed"), F.col("value").alias("raw")))


def read_wide_history(spark: SparkSession, path: str, date_col: str = "dt") -> DataFrame:
    """A date-by-symbol sheet as long rows; empty cells give no row."""
    df = read_strings(spark, path)
    names = [c for c in df.columns if c != date_col]
    long = df.unpivot([F.col(date_col).alias("dt")], [F.col(f"`{c}`") for c in names], "sym", "v")
    return long.select("sym", F.to_date("dt").alias("dt"), F.col("v").try_cast("double").alias("close")).where(F.col("close").isNotNull())
