"""Quality rules: counts of words, signs and repeats, and a perplexity band per language.

The language model is a modified Kneser-Ney model of the last ``ORDER`` bytes, one for each
language code, counted by Spark over all documents. Tasks count n-grams of the top order;
lower orders count the distinct n-grams that end in theirs, and discounts, totals and
interpolated probabilities are joins and aggregates of these tables, of all n-grams. The
texts to be scored are those counted, so each of their n-grams has its row in the table of
the top order. Tasks get the ``MODEL_ROWS`` most frequent ones at most, as one sorted array
of 64-bit hashes with probabilities, and score a text by binary search, once per distinct
n-gram of a piece of text; the others come back from a task with their counts, one row per
text and n-gram, and are joined with the table. Which n-grams are sent changes no score.
N-grams of three bytes and more count from ``LEAST_COUNT`` on, since the texts to be scored
are among those counted: what the others held goes to the back-off weight of their context,
as with the cut-offs of any n-gram model.

``fit`` gives a model that can score other texts too, with all orders and the contexts'
back-off weights in arrays; there an order of over ``rows`` n-grams is cut off higher up.

A document's log perplexity (per byte) is compared with its language's median. The band's
half-width is ``LOWER`` or ``UPPER`` times the root of (scaled median deviation squared plus
the variance of single bytes over the document's length): short texts scatter more. Medians
come from counts in bins of 1/2000, so they are exact to a bin and equal in each run.

Defined cases: a null text is empty; a text without words has no lines or windows, fails the
rules and takes no part in the bands; a null language is a language of its own; languages
share a model where their 8-bit codes meet, never a band; null or repeated doc_ids are rows
like others; a language whose texts are all alike has a band as wide as single bytes scatter;
an empty table gives no rows; further columns are ignored or, in ``well_formed``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from barline.llm import textbytes as tb
from barline.llm.common import discard, free, step

ORDER = 5
#: The most n-grams that are sent to tasks (of one order, for ``fit``).
MODEL_ROWS = 1 << 20
#: Least count of n-grams of three bytes and more: a text's own singletons must not speak for it.
LEAST_COUNT = 2
#: Half-widths of the band, in deviations; repetitive texts lie far below the median.
LOWER, UPPER = 3.0, 2.0
#: Bins per unit of log perplexity.
BINS = 2000
#: Positions of text worked on at once, and n-grams held by a counting task.
PIECE, HELD = 1 << 20, 1 << 21
#: Fewest words, window of repeated words, and the share of words in repeated windows.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True
_PAD = ORDER - 1


def language_code(lang: Column) -> Column:
    """0..255; null has a code too."""
    return F.pmod(F.xxhash64(F.coalesce(lang, F.lit("-"))), F.lit(256))


def suffix(key, order: int):
    """The last ``order`` bytes of an n-gram of one more byte; the language code lies above the bytes."""
    return (key >> (8 * (order + 1)) << (8 * order)) | (key & ((1 << (8 * order)) - 1))


def keys(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, row) of every byte of each text and its end, in pieces.

    A text is read with newlines before it and one after it. An n-gram is a long: language
    code, then the bytes.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes + _PAD + 1)
    flat = np.full(len(row), 10, np.uint8)
    flat[np.arange(len(data)) + np.repeat(np.arange(n) * (_PAD + 1) + _PAD, sizes)] = data
    starts = offsets[:-1] + np.arange(n) * (_PAD + 1)
    for i in range(0, len(flat), PIECE):
        at = np.arange(max(i, _PAD), min(i + PIECE, len(flat)))
        if not len(at):
            continue
        own = row[at]
        key = codes[own].astype(np.int64)
        for j in range(_PAD, -1, -1):
            key = (key << 8) | flat[at[0] - j: at[-1] + 1 - j]
        inside = at - starts[own] >= _PAD
        yield key[inside], own[inside]


def summed(keys_: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys_), return_inverse=True)
    return key, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, count) of the n-grams of (code, text) rows, summed in the task as far as memory allows."""
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def out(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "count"])

    for batch in batches:
        codes = batch.column(0).to_numpy()
        for i, j, data, offsets in tb.chunks(batch.column(1)):
            for key, _ in keys(data, offsets, codes[i:j]):
                k, n = np.unique(key, return_counts=True)
                found.append(k)
                counts.append(n)
                held += len(k)
                if held > HELD:
                    k, n = summed(found, counts)
                    if len(k) > HELD // 2:
                        yield out(k, n)
                        k, n = k[:0], n[:0]
                    found, counts, held = [k], [n], len(k)
    if held:
        yield out(*summed(found, counts))


def discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [(i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.0 for i in range(3)]
    return [min(max(x, 0.0), i + 1.0) for i, x in enumerate(raw)]


def ngram_counts(docs: DataFrame, label: str = "ngrams") -> list[DataFrame]:
    """(key, c) tables of orders 1 to ORDER: counts at the top, distinct left neighbours below."""
    texts = docs.select(language_code(F.col("lang")).alias("code"), "text")
    top = texts.mapInArrow(count, "key long, count long").groupBy("key").agg(F.sum("count").alias("c"))
    tables = [step(top, label)]
    for order in range(ORDER - 1, 0, -1):
        at = F.shiftright("key", 8 * (order + 1))
        low = F.shiftleft(at, 8 * order).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1)))
        tables.append(step(tables[-1].groupBy(low.alias("key")).agg(F.count(F.lit(1)).alias("c")), label))
    return tables[::-1]


def probabilities(tables: list[DataFrame], rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n-grams with order, key and p; contexts with order, key and back-off weight g; key, c and p of all top-order n-grams).

    ``rows`` bounds the n-grams of one order in the first two. A context that keeps none of
    its n-grams has g = 1 and is left out.
    """
    grams, contexts, lower = [], [], None
    for order, t in enumerate(tables, 1):
        sizes = t.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)], *[F.count_if(F.col("c") >= (1 << k)) for k in range(40)]).first()
        d = discounts(list(sizes[:4]))
        cut = max(next(1 << k for k in range(40) if rows is None or sizes[4 + k] <= rows), LEAST_COUNT if order > 2 else 1)
        kept = F.col("c") >= cut
        parts = t.withColumn("ctx", F.shiftright("key", 8))
        # integer sums, so that the floats built from them are the same in each run
        per = parts.groupBy("ctx").agg(
            F.sum("c").alias("total"), F.sum(F.when(~kept, F.col("c")).otherwise(0)).alias("cut"),
            F.count_if(kept).alias("n"), *[F.count_if(kept & (F.col("c") == i)).alias(f"n{i}") for i in (1, 2)])
        held = F.col("n1") * d[0] + F.col("n2") * d[1] + (F.col("n") - F.col("n1") - F.col("n2")) * d[2] + F.col("cut")
        per = per.withColumn("g", held / F.col("total"))
        p = parts.join(per, "ctx")
        own = F.when(kept, (F.col("c") - discount(F.col("c"), d)) / F.col("total")).otherwise(0.0)
        if lower is None:
            p = p.withColumn("p", own + F.col("g") / 256)
        else:
            low = F.shiftleft(F.shiftright("key", 8 * order), 8 * (order - 1)).bitwiseOR(
                F.col("key").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))
            p = p.withColumn("low", low).join(lower.select(F.col("key").alias("low"), F.col("p").alias("p_low")), "low")
            p = p.withColumn("p", own + F.col("g") * F.col("p_low"))
        p = step(p.select("key", "c", "p", kept.alias("kept")), "ngram_p")
        grams.append(p.where("kept").select(F.lit(order).alias("order"), "key", "p"))
        contexts.append(per.where("n > 0").select(F.lit(order).alias("order"), F.col("ctx").alias("key"), F.col("g").alias("p")))
        lower = p
    return reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, contexts), lower.select("key", "c", "p")


def hashed(order, key: np.ndarray) -> np.ndarray:
    """64-bit hash of (order, n-gram), one to one."""
    with np.errstate(over="ignore"):
        return tb.mix(key.astype(np.uint64) | (np.asarray(order).astype(np.uint64) << np.uint64(56)))


def sorted_arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, values) of (order, key, p) rows; at most ORDER * MODEL_ROWS of them."""
    got = table.toArrow()
    h = hashed(got["order"].to_numpy(), got["key"].to_numpy())
    at = np.argsort(h)
    return h[at], got["p"].to_numpy()[at]


def place(array: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash stands in an ascending array, or its end."""
    at = np.searchsorted(array, h)
    found = array[np.minimum(at, len(array) - 1)] == h if len(array) else np.zeros(len(h), bool)
    return np.where(found, at, len(array))


class Model:
    """Sorted hash arrays of n-grams and contexts; ``parts`` are those of ``fit``."""

    def __init__(self, parts: tuple[bytes, bytes, bytes, bytes]):
        self.gram, self.context = np.frombuffer(parts[0], np.uint64), np.frombuffer(parts[2], np.uint64)
        # a last place stands for all that is not found
        self.p = np.append(np.frombuffer(parts[1], np.float64), np.nan)
        self.g = np.append(np.frombuffer(parts[3], np.float64), 1.0)

    def log(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithm of p(last byte | bytes before it) of distinct top-order n-grams."""
        out = np.zeros(len(key))
        left, weight = np.arange(len(key)), np.ones(len(key))
        for order in range(ORDER, 0, -1):
            p = self.p[place(self.gram, hashed(order, key))]
            hit = ~np.isnan(p)
            out[left[hit]] = weight[hit] * p[hit]
            left, weight, key = left[~hit], weight[~hit], key[~hit]
            if not len(left):
                return np.log(out)
            weight = weight * self.g[place(self.context, hashed(order, key >> 8))]
            key = suffix(key, order - 1)
        out[left] = weight / 256
        return np.log(out)


def fit(docs: DataFrame, rows: int = MODEL_ROWS) -> tuple[bytes, bytes, bytes, bytes]:
    """The model of all documents, as bytes to send to tasks."""
    tables = ngram_counts(docs)
    grams, contexts, _ = probabilities(tables, rows)
    parts = tuple(x.tobytes() for t in (grams, contexts) for x in sorted_arrays(t))
    for t in tables:
        discard(t)
    return parts


class Known:
    """Logarithms of the probabilities of the n-grams that are sent to tasks."""

    def __init__(self, parts: tuple[bytes, bytes]):
        self.gram = np.frombuffer(parts[0], np.uint64)
        self.p = np.append(np.frombuffer(parts[1], np.float64), np.nan)

    def log(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithm of p(last byte | bytes before it) of top-order n-grams, NaN for those not sent."""
        return np.log(self.p[place(self.gram, hashed(ORDER, key))])


def fit_all(docs: DataFrame, rows: int = MODEL_ROWS) -> tuple[tuple[bytes, bytes], DataFrame | None]:
    """(the ``rows`` most frequent n-grams at most, as bytes to send to tasks; key and p of the others, None where there are none).

    N-grams counted at least 2^k times are sent, for the least k that fits.
    """
    tables = ngram_counts(docs)
    _, _, top = probabilities(tables)
    sizes = top.agg(*[F.count_if(F.col("c") >= (1 << k)) for k in range(40)]).first()
    cut = next(1 << k for k in range(40) if sizes[k] <= rows)
    sent = top.where(F.col("c") >= cut).select(F.lit(ORDER).alias("order"), "key", "p")
    parts = tuple(x.tobytes() for x in sorted_arrays(sent))
    for t in tables:
        discard(t)
    return parts, top.where(F.col("c") < cut).select("key", "p") if cut > 1 else None


def repeats(word: np.ndarray, row: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of words which the row holds at least twice."""
    out = np.zeros(n, np.int64)
    last = len(word) - window + 1
    if last <= 0:
        return out
    odd = tb.seeded(window, 78) | np.uint64(1)
    with np.errstate(over="ignore"):
        value = np.zeros(last, np.uint64)
        for j in range(window):
            value += word[j: j + last] * odd[j]
        whole = np.flatnonzero(row[:last] == row[window - 1:])
        # equal windows of one row are equal hashes; other rows' are told apart by theirs
        value = tb.mix(tb.mix(value[whole]) + row[whole].astype(np.uint64))
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, whole[twice], 1)
    np.add.at(cover, whole[twice] + window, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)


def rules(data: np.ndarray, offsets: np.ndarray, hasher: tb.Rolling) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    space = tb.SPACE[data]
    start, end, row = tb.runs(~space, offsets)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    points = ~space & ((data & 0xC0) != 0x80)
    per = [np.bincount(row, minlength=n), np.bincount(owner[points], minlength=n), np.bincount(owner[_SIGN[data]], minlength=n)]
    a, b, line_row = tb.runs(data != 10, offsets)
    # a line has a word if a word starts in it
    has = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, line_row = a[has], b[has], line_row[has]
    content = hasher.ranges(data, a, b)
    order = np.lexsort((np.arange(len(a)), content, line_row))
    r, c = line_row[order], content[order]
    dup = (r[1:] == r[:-1]) & (c[1:] == c[:-1])
    per.append(np.bincount(r[1:][dup], minlength=n))
    per.append(repeats(hasher.ranges(data, start, end), row, n))
    return per


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TYPE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_bytes:bigint,log_sum:double,square_sum:double>"
#: N-grams of a text that were not sent, and how often each comes.
OTHERS = "struct<row:bigint,keys:array<bigint>,times:array<bigint>>"


def rate(batches: Iterator[pa.RecordBatch], model, code_at: int, text_at: int, keep: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Appends two structs to the first ``keep`` columns: the rules' counts with the sums over n-grams sent, and the other n-grams."""
    from pyspark import TaskContext

    hasher, lm = tb.Rolling(), Known(model.value)
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        codes = batch.column(code_at).to_numpy()
        parts: list[list[np.ndarray]] = []
        others: list[list[np.ndarray]] = []
        for i, j, data, offsets in tb.chunks(batch.column(text_at)):
            n = j - i
            logs, squares = np.zeros(n), np.zeros(n)
            for key, row in keys(data, offsets, codes[i:j]):
                distinct, at = np.unique(key, return_inverse=True)
                log = lm.log(distinct)
                missing = np.isnan(log)
                log = log[at]
                if missing.any():
                    k = np.flatnonzero(missing[at])
                    log[k] = 0.0
                    order = np.lexsort((key[k], row[k]))
                    r, g = row[k][order], key[k][order]
                    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])))
                    others.append([i + r[new], g[new], np.diff(np.append(new, len(r)))])
                logs += np.bincount(row, weights=log, minlength=n)
                squares += np.bincount(row, weights=log * log, minlength=n)
            parts.append([*rules(data, offsets, hasher), np.diff(offsets) + 1, logs, squares])
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 8
        arrays = [pa.array(x.astype(np.int64)) for x in columns[:6]] + [pa.array(x) for x in columns[6:]]
        struct = pa.StructArray.from_arrays(arrays, names=[*FIELDS, "n_bytes", "log_sum", "square_sum"])
        # pieces of a text follow each other, so rows ascend
        row, *lists = [np.concatenate(x) for x in zip(*others, strict=True)] if others else [np.zeros(0, np.int64)] * 3
        at = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
        more = pa.StructArray.from_arrays(
            [pa.array(number + np.arange(len(batch))), *[pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in lists]], names=["row", "keys", "times"])
        number += len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], struct, more], names=[*batch.schema.names[:keep], *names])


def rated(docs: DataFrame, parts: tuple[bytes, bytes], rest: DataFrame | None, name: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` with the struct ``name``, in a written table; ``parts`` and ``rest`` are those of ``fit_all``."""
    code, others, number, s, q = (free(docs, n) for n in ("__code", "__others", "__row", "__s", "__q"))
    model = docs.sparkSession.sparkContext.broadcast(parts)
    kinds = docs.select(F.lit(None).cast(TYPE).alias(name), F.lit(None).cast(OTHERS).alias(others)).schema
    columns = [*carry, *[c for c in ("text",) if c not in carry]]
    given = docs.select(*[F.col(f"`{c}`") for c in columns], language_code(F.col("lang")).alias(code))
    schema = StructType([*[docs.schema[c] for c in carry], *[StructField(n, kinds[n].dataType) for n in (name, others)]])
    work = partial(rate, model=model, code_at=len(columns), text_at=columns.index("text"), keep=len(carry), names=(name, others))
    out = given.mapInArrow(work, schema)
    if rest is None:
        return step(out.drop(others), "ratings")
    # rows are numbered by the run that writes them
    out = step(out, "ratings")
    o, r = F.col(others), F.col(name)
    each = out.select(o["row"].alias("row"), F.explode(F.arrays_zip(o["keys"], o["times"])).alias("x"))
    each = each.select("row", F.col("x")["keys"].alias("key"), F.col("x")["times"].cast("double").alias("times")).join(rest.hint("merge"), "key")
    # summed in order of the keys, the same in each run
    listed = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("key", "times", F.log("p").alias("log")))).alias("x"))
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, x: a + f(x))
    sums = listed.select(
        F.col("row").alias(number), total(lambda x: x["times"] * x["log"]).alias(s), total(lambda x: x["times"] * x["log"] * x["log"]).alias(q))
    whole = r.withField("log_sum", r["log_sum"] + F.coalesce(s, F.lit(0.0))).withField("square_sum", r["square_sum"] + F.coalesce(q, F.lit(0.0)))
    joined = out.join(sums.hint("merge"), o["row"] == F.col(number), "left")
    done = step(joined.select(*[F.col(f"`{c}`") for c in carry], whole.alias(name)), "ratings")
    discard(out)
    return done


def base_failed(r: Column) -> Column:
    return (r["n_words"] < LEAST_WORDS) | (r["n_repeat_words"] * 100 > r["n_words"] * REPEAT_PERCENT)


def log_perplexity(r: Column) -> Column:
    return -r["log_sum"] / r["n_bytes"]


def bands(ratings: DataFrame) -> DataFrame:
    """(__lang, __median, __deviation, __scatter) of (lang, r) rows that pass the rules, one row per language.

    Everything follows from counts per bin, at most a few thousand per language.
    """
    good = ratings.where(~base_failed(F.col("r")))
    bins = good.groupBy("lang", F.floor(log_perplexity(F.col("r")) * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # sums of integers, equal in each run
    sums = good.groupBy("lang").agg(
        F.sum("r.n_bytes").alias("n_bytes"), F.sum(F.round(F.col("r.log_sum") * 1000).cast("long")).alias("s"),
        F.sum(F.round(F.col("r.square_sum") * 1000).cast("long")).alias("q"))

    def middle(df: DataFrame, value: str, out: str) -> DataFrame:
        per = Window.partitionBy("lang")
        run = F.sum("n").over(per.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        at = df.select("lang", value, run.alias("run"), F.sum("n").over(per).alias("all"))
        return at.where("run * 2 >= all").groupBy(F.col("lang").alias("l")).agg(F.min(value).alias(out))

    same = F.col("lang").eqNullSafe(F.col("l"))
    median = middle(bins, "bin", "mid")
    away = bins.join(median, same).select("lang", F.abs(F.col("bin") - F.col("mid")).alias("away"), "n")
    away = away.groupBy("lang", "away").agg(F.sum("n").alias("n"))
    deviation = middle(away, "away", "mad").withColumnRenamed("l", "l2")
    mean = F.col("s") / 1000 / F.col("n_bytes")
    var = F.greatest(F.col("q") / 1000 / F.col("n_bytes") - mean * mean, F.lit(0.0))
    return sums.join(median, same).join(deviation, F.col("lang").eqNullSafe(F.col("l2"))).select(
        F.col("lang").alias("__lang"), ((F.col("mid") + 0.5) / BINS).alias("__median"),
        (F.greatest("mad", F.lit(1)) * 1.4826 / BINS).alias("__deviation"), var.alias("__scatter"))


def decided(ratings: DataFrame, band: DataFrame, r: str, lower: float, upper: float) -> tuple[DataFrame, Column, Column]:
    """(``ratings`` joined with the bands, deviations from the median, whether the row stays)."""
    joined = ratings.join(band, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    wide = F.sqrt(F.col("__deviation") * F.col("__deviation") + F.col("__scatter") / F.col(r)["n_bytes"])
    z = (log_perplexity(F.col(r)) - F.col("__median")) / wide
    return joined, z, ~base_failed(F.col(r)) & z.between(-lower, upper)


def quality_rules(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, rows: int = MODEL_ROWS) -> DataFrame:
    """One row per document: the rules' counts, base_failed, log_perplexity (null without words), deviation and kept."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    ratings = rated(slim, *fit_all(slim, rows), "r", ["doc_id", "lang"])
    joined, z, kept = decided(ratings, step(bands(ratings), "bands"), "r", lower, upper)
    words = F.col("r.n_words") > 0
    return joined.select(
        "doc_id", *[F.col(f"r.{f}").alias(f) for f in FIELDS], base_failed(F.col("r")).alias("base_failed"),
        F.when(words, log_perplexity(F.col("r"))).alias("log_perplexity"), F.when(words, z).alias("deviation"), F.coalesce(kept, F.lit(False)).alias("kept"))


def well_formed(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, rows: int = MODEL_ROWS) -> DataFrame:
    """The documents that the rules and bands keep, with the columns of ``docs``."""
    name = free(docs, "__rating")
    ratings = rated(docs, *fit_all(docs.select("lang", "text"), rows), name, docs.columns)
    band = step(bands(ratings.select("lang", F.col(name).alias("r"))), "bands")
    joined, _, kept = decided(ratings.alias("d"), band, name, lower, upper)
    return joined.where(kept).select(*[F.col(f"d.`{c}`") for c in docs.columns])
