"""Trading calendars as generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Announced exchange holidays (no rule gives these festival dates)
VENUE_HOLIDAYS = {
    2026: (
        "2026-01-26", "2026-03-03", "2026-03-26", "2026-03-31", "2026-04-03", "2026-04-14", "2026-05-01", "2026-05-28",
        "2026-06-26", "2026-09-14", "2026-10-02", "2026-10-20", "2026-11-10", "2026-11-24", "2026-12-25",
    ),
    2027: (
        "2027-01-26", "2027-03-22", "2027-03-26", "2027-04-14", "2027-04-15", "2027-04-19", "2027-05-17", "2027-06-15",
        "2027-09-03", "2027-10-08", "2027-10-29", "2027-11-12",
    ),
}


def easter(year: Column) -> Column:
    """Easter Sunday by Gauss's rule for the Gregorian calendar."""
    century = F.floor(year / 100)
    moon = F.pmod(15 + century - F.floor(century / 4) - F.floor((8 * century + 13) / 25), F.lit(30))
    sun = F.pmod(4 + century - F.floor(century / 4), F.lit(7))
    full = F.pmod(19 * F.pmod(year, F.lit(19)) + moon, F.lit(30))
    week = F.pmod(2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) + 6 * full + sun, F.lit(7))
    late = full + week
    late = F.when((full == 29) & (week == 6), late - 7).when(
        (full == 28) & (week == 6) & (F.pmod(11 * moon + 11, F.lit(30)) < 19), late - 7
    ).otherwise(late)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), late.cast("int"))


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """n-th weekday of a month (``weekday`` like 'MON'); n = -1 is the last one."""
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))
    after = F.next_day(F.date_sub(F.add_months(F.make_date(year, F.lit(month), F.lit(1)), 1), 1), weekday)
    return F.date_sub(after, 7)


def observed(day: Column) -> Column:
    """Saturday holidays move to Friday, Sunday ones to Monday."""
    k = F.weekday(day)
    return F.when(k == 5, F.date_sub(day, 1)).when(k == 6, F.date_add(day, 1)).otherwise(day)


def us_holidays(years: DataFrame) -> DataFrame:
    """(dt, name) for every row of ``years(year)``."""
    y = F.col("year")
    fixed = lambda m, d: observed(F.make_date(y, F.lit(m), F.lit(d)))
    days = {
        "new_year": fixed(1, 1),
        "king": nth_weekday(y, 1, "MON", 3),
        "presidents": nth_weekday(y, 2, "MON", 3),
        "good_friday": F.date_sub(easter(y), 2),
        "memorial": nth_weekday(y, 5, "MON", -1),
        "juneteenth": fixed(6, 19),
        "independence": fixed(7, 4),
        "labor": nth_weekday(y, 9, "MON", 1),
        "thanksgiving": nth_weekday(y, 11, "THU", 4),
        "christmas": fixed(12, 25),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("name"), d.alias("dt")) for n, d in days.items()])
    return years.select("year", F.explode(cells).alias("h")).select("h.dt", "h.name", "year")


def venue_holidays(spark: SparkSession) -> DataFrame:
    rows = [(d,) for days in VENUE_HOLIDAYS.values() for d in days]
    return spark.createDataFrame(rows, "d string").select(F.to_date("d").alias("dt"))


def trading_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Each day with its trading flag and the next trading day after it.

    ``days`` is a calendar: one row per day, so one ordered window holds it.
    """
    off = holidays.select("dt", F.lit(True).alias("_off")).distinct()
    marked = days.join(off, "dt", "left").withColumn("is_trading", (F.weekday("dt") < 5) & F.col("_off").isNull())
    ahead = Window.orderBy("dt").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("is_trading"), F.col("dt")), ignorenulls=True).over(ahead)
    return marked.withColumn("next_trading", nxt).drop("_off")


def uncovered_years(days: DataFrame, horizon: int = 90) -> DataFrame:
    """Days from which a year without a venue holiday list can be reached within ``horizon`` days."""
    have = list(VENUE_HOLIDAYS)
    near, far = F.year("dt"), F.year(F.date_add("dt", horizon))
    gaps = F.array_distinct(F.array_compact(F.array(F.when(~near.isin(have), near), F.when(~far.isin(have), far))))
    return days.withColumn("missing_years", F.array_sort(gaps)).where(F.size("missing_years") > 0)
