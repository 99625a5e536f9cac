"""Corporate actions: classification, adjusted returns, back-adjusted prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cols import by_sym, col, nonzero, ratio

#: What a subject is cut into: words, amounts, and the colon of a ratio.
TOKEN = r"[a-z]+|[0-9]+(?:[.][0-9]+)?|:"
#: Words that say which kind of action a subject announces.
LEAVING = ("demerge", "demerged", "demerger", "demergers", "arrangement", "spinoff")
LEAVING_PAIRS = ("de merger", "de merge", "de merged", "spin off")
BONUS, SPLIT, DIVIDEND = ("bonus",), ("split", "splits", "splitting"), ("dividend", "dividends")
CURRENCY = ("rs", "re", "inr")

UNEXPLAINED = 0.25


def _after(tokens: Column, words: tuple[str, ...]) -> Column:
    """The tokens behind the first of some words; none if no such word is there."""
    at = F.array_position(F.transform(tokens, lambda t: t.isin(*words)), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(tokens, at + 1, F.size(tokens))).otherwise(F.array().cast("array<string>"))


def _number_at(tokens: Column) -> Column:
    """Place of the first amount, 0 if there is none."""
    return F.array_position(F.transform(tokens, lambda t: t.rlike("^[0-9]")), F.lit(True)).cast("int")


def _amount(tokens: Column, at: Column) -> Column:
    """The amount at a place; null where the place is outside or holds a word."""
    return F.get(tokens, at - 1).try_cast("double")


def classify_actions(rows: DataFrame, subject: Column | str = "subject") -> DataFrame:
    """Adds ``kind``, ``price_ratio`` and ``dividend`` from an action's wording.

    The subject is read as a list of words and amounts. A kind is named by its word and
    takes the amounts behind it: a bonus the ratio around a colon, a split the amounts
    behind "from" and the next "to", a dividend the amount behind a currency word. A word without its
    amounts names nothing. Order matters: a demerger that mentions a dividend is one.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(col(subject), F.lit(""))), F.lit(TOKEN), F.lit(0))
    base = rows.withColumn("_t", tokens)
    base = base.withColumns({"_b": _after(F.col("_t"), BONUS), "_f": _after(_after(F.col("_t"), SPLIT), ("from",)), "_d": _after(F.col("_t"), DIVIDEND)})
    base = base.withColumn("_o", _after(F.col("_f"), ("to",)))
    b, d, f, o = (_number_at(F.col(c)) for c in ("_b", "_d", "_f", "_o"))
    new, old = _amount(F.col("_b"), b), _amount(F.col("_b"), b + 2)
    before, after = _amount(F.col("_f"), f), _amount(F.col("_o"), o)
    paid = F.when(F.get("_d", d - 2).isin(*CURRENCY), _amount(F.col("_d"), d))
    pairs = F.zip_with("_t", F.slice("_t", 2, F.size("_t")), lambda x, y: F.concat_ws(" ", x, y))
    apart = F.arrays_overlap("_t", F.array(*map(F.lit, LEAVING))) | F.arrays_overlap(pairs, F.array(*map(F.lit, LEAVING_PAIRS)))
    kind = (
        F.when(apart, "demerger")
        .when((F.get("_b", b) == ":") & (new > 0) & (old > 0), "bonus")
        .when((before > 0) & (after > 0), "split")
        .when(paid.isNotNull(), "dividend")
        .otherwise("other")
    )
    base = base.withColumn("kind", kind)
    return base.withColumns(
        {
            "price_ratio": F.when(F.col("kind") == "bonus", old / (new + old)).when(F.col("kind") == "split", after / before).otherwise(1.0),
            "dividend": F.when(F.col("kind") == "dividend", paid).otherwise(0.0),
        }
    ).drop("_t", "_b", "_f", "_o", "_d")


def effective_actions(actions: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (sym, dt): the last applicable action and whether any is a demerger.

    An unordered pile of actions on one cell collapses in the partial aggregate.
    """
    priced = F.col("kind") != "demerger"
    packed = F.struct("kind", "price_ratio", "dividend")
    return actions.groupBy("sym", "dt").agg(
        F.max_by(F.when(priced, packed), F.when(priced, F.col(order))).alias("_last"),
        F.max(F.when(~priced, 1).otherwise(0)).alias("_demerger"),
        F.count(F.lit(1)).alias("n_actions"),
    )


def adjust_returns(panel: DataFrame, actions: DataFrame, order: str = "seq") -> DataFrame:
    """Returns against the previous close, corrected for actions; unexplained jumps become NULL.

    Expects ``close`` and ``prev_close``. Adds ``ret`` and ``masked``.
    """
    joined = panel.join(effective_actions(actions, order), ["sym", "dt"], "left")
    plain = ratio("close", "prev_close") - 1
    ratio_, div = F.col("_last.price_ratio"), F.col("_last.dividend")
    usable = (F.col("prev_close") > 0) & F.col("close").isNotNull() & (F.col("prev_close") * ratio_ > 0)
    fixed = (F.col("close") + div) / nonzero(F.col("prev_close") * ratio_) - 1
    out = joined.withColumn("_r", F.when(F.col("_last").isNotNull() & usable, fixed).otherwise(plain))
    out = out.withColumn(
        "masked",
        (F.coalesce(F.col("_demerger"), F.lit(0)) == 1) | F.coalesce(F.abs("_r") > UNEXPLAINED, F.lit(False)),
    )
    out = out.withColumn("ret", F.when(~F.col("masked"), F.col("_r")))
    return out.withColumn("action", F.col("_last.kind")).drop("_last", "_demerger", "n_actions", "_r")


def adjusted_index(panel: DataFrame) -> DataFrame:
    """Price index 100 x running product of (1 + ret) over the live grid, with rescaled high and low.

    A masked or missing return keeps the index flat. The index-to-price factor is
    carried over gaps, and back over a leading one.
    """
    past = by_sym().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_sym().rowsBetween(0, Window.unboundedFollowing)
    out = panel.withColumn("adj_close", 100 * F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(past)))
    out = out.withColumn("_f", ratio("adj_close", nonzero("close")))
    out = out.withColumn(
        "factor",
        F.coalesce(F.last("_f", ignorenulls=True).over(past), F.first("_f", ignorenulls=True).over(ahead)),
    )
    return out.withColumns({"adj_high": F.col("high") * F.col("factor"), "adj_low": F.col("low") * F.col("factor")}).drop("_f")


def rescale_bars(bars: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Open, high and low moved onto an adjusted close by the cell's own factor."""
    out = bars.join(adjusted.select("sym", "dt", "adj_close"), ["sym", "dt"])
    f = ratio("adj_close", nonzero("close"))
    return out.withColumn("factor", f).withColumns(
        {f"adj_{c}": F.col(c) * F.col("factor") for c in ("open", "high", "low")}
    )


