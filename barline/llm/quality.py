"""Quality classifier by importance resampling.

Target text are the labelled documents of good quality that are not toxic. Raw text is a
mixture of three kinds of documents: target, poor and toxic, each with a generative model
over hashed n-grams (tokens; the first 4, 5 and 6 bytes of words; bigrams of token shapes).
A document's weight is log p(target) - log p(raw), where p(raw) sums the three models by
their shares of the labels: at most log(1 / share of target), and far below zero for a
document that another model explains better. A kind's model is the model of all labelled
text times a ratio per n-gram, which ``PRIOR`` counts draw towards one, so that rare n-grams
say little and only those which mark a kind count.

Documents are resampled by Gumbel top-k: the k documents with the largest weight plus
Gumbel noise (from a hash of the id and a seed) stay, with k the number of documents that
are target documents more likely than not, share * exp(weight) >= 1/2. The k-th key is found by counting keys in ranges
that narrow around it; nothing is sorted or collected.

The models are fitted on at most ``FIT_LABELS`` labelled documents, chosen by a hash where
there are more; that table is small enough to be sent to the tasks, so no text is shuffled.
N-grams are counted in ``BUCKETS`` places: the models have a fixed size too.

Defined cases: a null or empty text has no n-grams and weight 0, like any text of which the
models say nothing; a null doc_id draws its noise as an empty one; documents with equal keys
stay or go together; labels without a document, or with null fields, are ignored; several
labels of one document count as its worst; without target labels, or without labels of
either rejected kind, all documents stay with weight 0; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barline.llm import textbytes as tb
from barline.llm.common import free, step

#: Places of the n-grams: tokens, word beginnings of 4, 5 and 6 bytes, shape bigrams.
PARTS = (1 << 18, 1 << 15, 1 << 16, 1 << 16, 1 << 12)
BEGINNINGS = (4, 5, 6)
EDGES = tuple(np.cumsum((0, *PARTS)).tolist())
BUCKETS = EDGES[-1]
KINDS = ("target", "poor", "toxic")
#: Counts that draw an n-gram's ratio towards one.
PRIOR = 20.0
TRUST = 3.0
SEED = "quality-1"
#: The most labelled documents the models are fitted on.
FIT_LABELS = 1 << 18
#: Ranges in which keys are counted per round, and the share of rows that ends the search.
RANGES = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def ngrams(data: np.ndarray, offsets: np.ndarray, hasher: tb.Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all n-grams of a chunk of texts.

    Tokens are runs of letters and digits, and runs of other signs. Unigrams are their
    lower-cased contents; a bigram is the pair of neighbouring tokens' shapes (capitals,
    kind, signs themselves) and whether both are the same.
    """
    letters = _LETTER[data]
    parts = []
    for inside in (letters, ~letters & ~tb.SPACE[data]):
        parts.append(tb.runs(inside, offsets))
    start, end, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    word = np.concatenate([np.ones(len(parts[0][0]), bool), np.zeros(len(parts[1][0]), bool)])
    order = np.argsort(start, kind="stable")
    start, end, row, word = start[order], end[order], row[order], word[order]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    content = hasher.ranges(tb.fold(data), start, end)
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=capitals[1:])
    caps = capitals[end] - capitals[start]
    shape = np.where(word, (caps > 0).astype(np.int64) + (caps > 1), 3 + (content % np.uint64(61)).astype(np.int64))
    pair = row[1:] == row[:-1]
    two = (shape[:-1] * 64 + shape[1:]) * 2 + (content[1:] == content[:-1])
    place = lambda h, part: ((h >> np.uint64(32)) % np.uint64(PARTS[part])).astype(np.int64) + EDGES[part]
    buckets, rows = [place(content, 0)], [row]
    for part, n in enumerate(BEGINNINGS, 1):
        k = np.flatnonzero(word & (end - start >= n))
        buckets.append(place(hasher.ranges(tb.fold(data), start[k], start[k] + n), part))
        rows.append(row[k])
    once = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    shapes = place(tb.mix(two[pair].astype(np.uint64)), len(PARTS) - 1)
    return np.concatenate([once % BUCKETS, shapes]), np.concatenate([once // BUCKETS, row[1:][pair]])


COUNT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("count", pa.int64())])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of (kind, text); kind is 0, 1 or 2. One row per kind and bucket a task has met."""
    hasher = tb.Rolling()
    total = np.zeros((len(KINDS), BUCKETS), np.int64)
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        for i, _, data, offsets in tb.chunks(batch.column(1)):
            bucket, row = ngrams(data, offsets, hasher)
            total += np.bincount(kinds[i + row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
    kind, bucket = np.nonzero(total)
    yield pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[kind, bucket])], COUNT)


def models(counts: np.ndarray) -> np.ndarray:
    """log p(n-gram | kind) from counts (kind, bucket), a model for each kind of n-gram."""
    out = np.zeros(counts.shape, np.float32)
    for part in range(len(PARTS)):
        at = slice(EDGES[part], EDGES[part + 1])
        own = counts[:, at].astype(np.float64)
        everything = own.sum(axis=0)
        share = own.sum(axis=1) / max(1.0, everything.sum())
        base = (everything + 0.01) / (everything + 0.01).sum()
        for k in range(len(KINDS)):
            ratio = (own[k] + PRIOR * share[k]) / (everything + PRIOR) / share[k] if share[k] > 0 else np.ones(PARTS[part])
            p = base * np.where(np.abs(np.log(ratio)) > np.log(TRUST), ratio, 1.0)
            out[k, at] = np.log(p / p.sum())
    return out


def weigh(batches: Iterator[pa.RecordBatch], model, shares: tuple, at: int, name: str) -> Iterator[pa.RecordBatch]:
    """Appends the log weight of the text in column ``at`` to each row."""
    hasher = tb.Rolling()
    table = np.frombuffer(model.value, np.float32).reshape(len(KINDS), BUCKETS)
    prior = np.log(np.array(shares))
    for batch in batches:
        weights = []
        for i, j, data, offsets in tb.chunks(batch.column(at)):
            bucket, row = ngrams(data, offsets, hasher)
            logs = np.stack([np.bincount(row, weights=table[k][bucket], minlength=j - i) for k in range(len(KINDS))])
            mixed = logs + prior[:, None]
            most = mixed.max(axis=0)
            weights.append(logs[0] - (most + np.log(np.exp(mixed - most).sum(axis=0))))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(weights) if weights else np.zeros(0))], names=[*batch.schema.names, name])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, tuple[float, ...]] | None:
    """(models, shares of the three kinds) from all labelled documents; None if a kind is missing."""
    poor, toxic = F.max((F.col("quality") == 0).cast("int")), F.max((F.col("toxic") == 1).cast("int"))
    kinds = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.when(poor == 1, 1).when(toxic == 1, 2).otherwise(0).alias("kind"))
    kinds = step(kinds, "labels")
    n = kinds.count()
    if n > FIT_LABELS:
        # a little under the bound, as the hash does not deal evenly
        share = int(0.98 * FIT_LABELS / n * (1 << 32))
        kinds = kinds.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 32)) < share)
    labelled = docs.select("doc_id", "text").join(F.broadcast(kinds), "doc_id").select("kind", "text")
    counts = labelled.mapInArrow(count, "kind int, bucket int, count long").groupBy("kind", "bucket").agg(F.sum("count").alias("count"))
    table = np.zeros((len(KINDS), BUCKETS), np.int64)
    got = counts.toArrow()  # at most KINDS * BUCKETS rows
    table[got["kind"].to_numpy(), got["bucket"].to_numpy()] = got["count"].to_numpy()
    number = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    shares = tuple(number.get(k, 0) / max(1, sum(number.values())) for k in range(len(KINDS)))
    if number.get(0, 0) == 0 or number.get(1, 0) + number.get(2, 0) == 0 or table[0].sum() == 0:
        return None
    return models(table), tuple(max(s, 1e-6) for s in shares)


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of doubles, by counting in narrowing ranges."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k <= 0:
        return None
    if k >= n:
        return low
    above = 0
    while low < high:
        width = (high - low) / RANGES
        if low + width <= low:
            break
        part = F.least(F.floor((F.col(column) - low) / width), F.lit(RANGES - 1))
        got = keys.where(F.col(column).between(low, high)).groupBy(part.alias("r")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(got, key=lambda x: -x["r"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def weighted(docs: DataFrame, labels: DataFrame, seed: str = SEED) -> tuple[DataFrame, Column, Column, float | None]:
    """(``docs`` with two more columns, the log weight and the key among them, least key that stays or None)."""
    weight, key = free(docs, "__weight"), free(docs, "__key")
    fitted = fit(docs, labels)
    if fitted is None:
        return docs.withColumn(weight, F.lit(0.0)).withColumn(key, F.lit(0.0)), F.col(weight), F.col(key), 0.0
    table, shares = fitted
    model = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    schema = StructType([*docs.schema.fields, StructField(weight, DoubleType())])
    out = docs.mapInArrow(partial(weigh, model=model, shares=shares, at=docs.columns.index("text"), name=weight), schema)
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    out = out.withColumn(key, F.col(weight) - F.log(-F.log(draw)))
    keys = step(out.select(weight, key), "quality_keys")
    likely = keys.where(F.lit(shares[0]) * F.exp(weight) >= 0.5).count()
    return out, F.col(weight), F.col(key), kth_largest(keys, key, likely)


def quality_weights(docs: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, log_weight, key, kept), one row per document."""
    out, weight, key, least = weighted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, seed)
    kept = F.lit(False) if least is None else key >= F.lit(least)
    return out.select("doc_id", weight.alias("log_weight"), key.alias("key"), kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents that the resampling keeps."""
    out, _, key, least = weighted(docs, labels, seed)
    kept = F.lit(False) if least is None else key >= F.lit(least)
    return out.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
