"""Scores of whole documents under a gated recurrent language model, beside a unigram base.

Tokens are the lower-cased (A-Z) words of a text and one end. Words are known by 64-bit
hashes. The recurrent model's types are the most frequent words, the end, and one type for
all other words; a type's probability is that of its class times its share in the class
(classes of equal size by frequency), given the state before the token. Other words share
their type's probability by smoothed counts, so a score is a probability of the text.

Training: documents not held out, in as many rounds as ``ROUNDS`` hash slices of them. In a
round every task starts from the same parameters, walks its documents in lanes with
truncated backpropagation (the state is carried from window to window and cleared at an
end), and the results are averaged, weighted by tokens, in a tree of at most ``FAN`` models
at a time. Scoring carries the state through each whole document.

Counts cover all training words. The ``FREQUENT`` most frequent ones are sent to the tasks;
the other words of a document meet their counts in a join.

Defined cases: a null text is an empty one, whose only token is the end; a null doc_id counts
as the empty text for the split; repeated rows are scored alike; without training documents
all counts are zero and the model's types are equally likely; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm import textbytes as tb
from barline.llm.common import step
from barline.llm.quality import kth_largest

FOLDS, HELD_OUT = 7, 2
HIDDEN, CLASSES, WIDTH = 16, 32, 64
TYPES = CLASSES * WIDTH
#: Words with a type of their own; one more type is the end, the last one all other words.
VOCABULARY = TYPES - 2
FREQUENT = 1 << 18
ROUNDS, LANES, WINDOW, FAN = 3, 128, 16, 64
RATE, CLIP = 0.01, 5.0
#: Bytes of text whose documents are trained on or scored side by side. Long texts end with few
#: documents beside them, whose steps cost as much, so scoring takes more.
SIDE_BY_SIDE, SCORED = 4 << 20, 8 << 20
#: Bytes of text hashed at once.
PIECE = 1 << 17

Net = dict[str, np.ndarray]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def tokens_of(data: np.ndarray, offsets: np.ndarray, hasher: tb.Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all words; taken in pieces whose arrays stay in the processor's cache."""
    words, rows, i, n = [], [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        part = data[offsets[i]: offsets[j]]
        start, end, row = tb.words(part, offsets[i: j + 1] - offsets[i])
        words.append(hasher.ranges(tb.fold(part), start, end))
        rows.append(row + i)
        i = j
    return (np.concatenate(words), np.concatenate(rows)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = tb.Rolling()
    for batch in batches:
        for _, _, data, offsets in tb.chunks(batch.column(0), SIDE_BY_SIDE):
            words, _ = tokens_of(data, offsets, hasher)
            word, n = np.unique(words, return_counts=True)
            yield pa.record_batch([tb.signed(word), pa.array(n)], ["word", "count"])


class Types:
    """Types of words: by frequency in classes of ``WIDTH``."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, other: int):
        order = np.lexsort((words, -counts))[:VOCABULARY]
        self.known = np.sort(words[order])
        rank = np.empty(len(order), np.int64)
        rank[np.searchsorted(self.known, words[order])] = np.arange(len(order))
        mass = np.zeros(TYPES)
        mass[: len(order)] = counts[order]
        mass[-2], mass[-1] = ends, other
        # all types in order of mass; a type's place gives class and number in it
        place = np.empty(TYPES, np.int64)
        place[np.argsort(-mass, kind="stable")] = np.arange(TYPES)
        self.type_of = place[rank]
        self.end, self.other = int(place[-2]), int(place[-1])
        self.mass = np.sort(mass)[::-1]

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(words), self.other)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.type_of[at], self.other)


def fresh(types: Types) -> Net:
    """Parameters before training: the output layer gives the types' frequencies."""
    rng = np.random.default_rng(7)
    p = (types.mass + 0.5) / (types.mass + 0.5).sum()
    by_class = p.reshape(CLASSES, WIDTH)
    net = {
        "x": rng.normal(0, 0.1, (TYPES, 3 * HIDDEN)), "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)),
        "cw": np.zeros((HIDDEN, CLASSES)), "cb": np.log(by_class.sum(axis=1)),
        "ww": np.zeros((CLASSES, HIDDEN, WIDTH)), "wb": np.log(by_class / by_class.sum(axis=1, keepdims=True))}
    return {k: v.astype(np.float32) for k, v in net.items()}


def pack(net: Net) -> bytes:
    return np.concatenate([net[k].ravel() for k in sorted(net)]).tobytes()


def unpack(data: bytes) -> Net:
    flat = np.frombuffer(data, np.float32)
    shapes = {"x": (TYPES, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,),
              "ww": (CLASSES, HIDDEN, WIDTH), "wb": (CLASSES, WIDTH)}
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at: at + n].reshape(shapes[k]).copy()
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in the place of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def advance(net: Net, h: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, ...]:
    """(next state, z, r, candidate, recurrent part of the candidate) after reading a token in each lane."""
    return move(net, h, net["x"].take(types, axis=0))


def move(net: Net, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """``advance`` of lanes whose tokens' rows of the input layer are known."""
    u = h @ net["u"]
    gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    un = u[:, 2 * HIDDEN:]
    n = r * un
    n += x[:, 2 * HIDDEN:]
    np.tanh(n, out=n)
    after = h - n
    after *= z
    after += n
    return after, z, r, n, un


def _low(reach: float, weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no value of the layer is over 80 for inputs of at most ``reach``, so exp cannot overflow."""
    return bool(reach * np.abs(weights).sum(axis=-2).max() + np.abs(bias).max() <= 80)


def _exp(x: np.ndarray, own: np.ndarray, rows: np.ndarray, low: bool) -> tuple[np.ndarray, np.ndarray]:
    """(``x`` in column ``own``, row sums of exp(x)); exp(x) takes the place of ``x``.

    Row maxima are taken off only where exp would overflow.
    """
    if not low and x.size and x.max() > 80:
        x -= x.max(axis=1, keepdims=True)
    picked = x[rows, own]
    np.exp(x, out=x)
    return picked, x @ np.ones(x.shape[1], x.dtype)


def log_probabilities(net: Net, h: np.ndarray, types: np.ndarray, gradient: Net | None = None):
    """Natural log p(type | state) per row; with ``gradient`` also adds to it and returns d loss / d state."""
    own, number = types // WIDTH, types % WIDTH
    rows = np.arange(len(types))
    reach = float(np.abs(h).max(initial=0))
    d = h @ net["cw"]
    d += net["cb"]
    picked, total = _exp(d, own, rows, _low(reach, net["cw"], net["cb"]))
    out = (picked - np.log(total)).astype(np.float64)
    back = None
    if gradient is not None:
        d /= total[:, None]
        d[rows, own] -= 1
        gradient["cw"] += h.T @ d
        gradient["cb"] += np.ones(len(d), d.dtype) @ d
        back = d @ net["cw"].T
    # one byte sorts by counting; a class is a run of the sorted rows
    order = np.argsort(own.astype(np.uint8), kind="stable")
    edges = np.zeros(CLASSES + 1, np.int64)
    np.cumsum(np.bincount(own, minlength=CLASSES), out=edges[1:])
    h, number = h.take(order, axis=0), number[order]
    low = _low(reach, net["ww"], net["wb"])
    inner = None if back is None else np.empty_like(back)
    for c in np.flatnonzero(np.diff(edges)).tolist():
        k = slice(edges[c], edges[c + 1])
        part = h[k]
        at, place = rows[: len(part)], number[k]
        d = part @ net["ww"][c]
        d += net["wb"][c]
        picked[k], total[k] = _exp(d, place, at, low)
        if gradient is not None:
            d /= total[k, None]
            d[at, place] -= 1
            gradient["ww"][c] += part.T @ d
            gradient["wb"][c] += np.ones(len(d), d.dtype) @ d
            np.matmul(d, net["ww"][c].T, out=inner[k])
    out[order] += picked - np.log(total)
    if back is not None:
        back[order] += inner
    return out, back


class Trainer:
    """Truncated backpropagation over lanes of tokens, with Adam steps."""

    def __init__(self, net: Net, end: int):
        self.net, self.end = net, end
        self.h = np.zeros((LANES, HIDDEN), np.float32)
        self.m = {k: np.zeros_like(v) for k, v in net.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.items()}
        self.steps = 0

    def window(self, types: np.ndarray, masked: int = 0) -> None:
        """One window: ``types`` is (lanes, places); the last ``masked`` places of the last lane only fill it."""
        net, lanes, places = self.net, *types.shape
        g = {k: np.zeros_like(v) for k, v in net.items()}
        h, states = self.h, np.empty((places, lanes, HIDDEN), np.float32)
        z, r, n, un = (np.empty_like(states) for _ in range(4))
        live = (types != self.end).astype(np.float32)
        x = net["x"].take(types.T, axis=0)
        for t in range(places):
            states[t] = h
            after, z[t], r[t], n[t], un[t] = move(net, h, x[t])
            h = after * live[:, t: t + 1]
        self.h = h
        real = np.ones((places, lanes), bool)
        real[places - masked:, -1] = False
        if masked:
            back = np.zeros((places, lanes, HIDDEN), np.float32)
            _, back[real] = log_probabilities(net, states[real], types.T[real], g)
        else:
            _, back = log_probabilities(net, states.reshape(-1, HIDDEN), types.T.ravel(), g)
            back = back.reshape(places, lanes, HIDDEN)
        dh = np.zeros((lanes, HIDDEN), np.float32)
        dx = np.empty((places, lanes, 3 * HIDDEN), np.float32)
        # what the gradients of a step's gates are multiples of, for all steps at once
        into_n, into_z, into_r = (1 - z) * (1 - n * n), (states - n) * z * (1 - z), un * r * (1 - r)
        rec = np.empty_like(dx)
        turned = np.ascontiguousarray(net["u"].T)
        for t in range(places - 1, -1, -1):
            dh *= live[:, t: t + 1]
            step_in, step_rec = dx[t], rec[t]
            dn = dh * into_n[t]
            np.multiply(dh, into_z[t], out=step_in[:, :HIDDEN])
            np.multiply(dn, into_r[t], out=step_in[:, HIDDEN: 2 * HIDDEN])
            step_in[:, 2 * HIDDEN:] = dn
            step_rec[:, : 2 * HIDDEN] = step_in[:, : 2 * HIDDEN]
            np.multiply(dn, r[t], out=step_rec[:, 2 * HIDDEN:])
            dh *= z[t]
            dh += step_rec @ turned
            dh += back[t]
        g["u"] += states.reshape(-1, HIDDEN).T @ rec.reshape(-1, 3 * HIDDEN)
        flat = types.T.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        seen = flat[order]
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        g["x"][seen[first]] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN).take(order, axis=0), first, axis=0)
        scale = 1 / (lanes * places - masked)
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-9))
        self.steps += 1
        warm = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, v in g.items():
            m, square = self.m[k], self.v[k]
            v *= scale
            m *= 0.9
            m += 0.1 * v
            v *= v
            v *= 0.001
            square *= 0.999
            square += v
            np.sqrt(square, out=v)
            v += 1e-6
            np.divide(m, v, out=v)
            v *= RATE * warm
            net[k] -= v


def lanes_of(types: np.ndarray) -> np.ndarray:
    """A run of tokens dealt into LANES equal rows; what does not fill a row stays out."""
    return types[: len(types) // LANES * LANES].reshape(LANES, -1)


def train(batches: Iterator[pa.RecordBatch], net: bytes, types: Types) -> Iterator[pa.RecordBatch]:
    """One model per task: (number of the task, tokens seen, parameters)."""
    from pyspark import TaskContext

    hasher = tb.Rolling()
    trainer = Trainer(unpack(net.value), types.value.end)
    names, seen = types.value, 0
    rest = np.zeros(0, np.int64)
    for batch in batches:
        for i, j, data, offsets in tb.chunks(batch.column(0), SIDE_BY_SIDE):
            words, row = tokens_of(data, offsets, hasher)
            # each document's words, then its end
            at = tb.bounds(row, j - i)
            stream = np.insert(names.of(words), at[1:], names.end)
            stream = np.concatenate([rest, stream])
            block = LANES * WINDOW
            full = len(stream) // block * block
            rest = stream[full:]
            rows = lanes_of(stream[:full])
            trainer.h[:] = 0
            for t in range(0, rows.shape[1], WINDOW):
                trainer.window(rows[:, t: t + WINDOW])
            seen += full
    if len(rest):
        # the last block has as many lanes as it fills
        masked = -len(rest) % WINDOW
        rows = np.append(rest, np.full(masked, names.end)).reshape(-1, WINDOW)
        trainer.h = np.zeros((len(rows), HIDDEN), np.float32)
        trainer.window(rows, masked)
        seen += len(rest)
    if seen:
        yield pa.record_batch(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([pack(trainer.net)], pa.binary())],
            ["id", "tokens", "net"])


def average(group: pa.Table) -> pa.Table:
    """Token-weighted mean of at most FAN models."""
    rows = sorted(zip(group["id"].to_pylist(), group["tokens"].to_pylist(), group["net"].to_pylist(), strict=True))
    total = sum(r[1] for r in rows)
    mean = sum(np.frombuffer(net, np.float32).astype(np.float64) * (tokens / total) for _, tokens, net in rows)
    return pa.table({"id": [rows[0][0] // FAN], "tokens": [total], "net": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def fit(texts: DataFrame, types: Types) -> Net:
    """Parameters after all rounds; ``texts`` has (doc_id, text) of the training documents."""
    context = texts.sparkSession.sparkContext
    net, names = fresh(types), context.broadcast(types)
    turn = F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        start = context.broadcast(pack(net))
        models = step(texts.where(turn == k).select("text").mapInArrow(
            partial(train, net=start, types=names), "id long, tokens long, net binary"), "models")
        n = models.count()
        while n > 1:
            grouped = models.groupBy(F.floor(F.col("id") / FAN).alias("part"))
            models = step(grouped.applyInArrow(lambda t: average(t), "id long, tokens long, net binary"), "models")  # noqa: PLW0108
            n = models.count()
        if n:
            net = unpack(models.first()["net"])
    return net


ROW = pa.schema([
    ("kind", pa.int8()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("n_other", pa.int64()), ("word", pa.int64()), ("is_other", pa.int64()), ("logs", pa.float64()), ("other_logs", pa.float64()),
    ("model", pa.float64())])
ROW_DDL = ("kind byte, row long, doc_id long, n_tokens long, n_known long, n_other long, word long, is_other long, "
           "logs double, other_logs double, model double")


def document_scores(net: Net, words: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Natural log-likelihood of each document; ``words`` are types, ``at`` the documents' bounds."""
    length = np.diff(at) + 1
    order = np.argsort(-length, kind="stable")
    length, start = length[order], at[:-1][order]
    stop = at[1:][order]
    padded = np.append(words, 0)
    out = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), np.float32)
    # lanes are sorted by length, so the live ones come first
    lanes = np.searchsorted(-length, -np.arange(length[0] if len(order) else 0), "left").tolist()
    states, seen, who, held = [], [], [], 0
    for t, live in enumerate(lanes):
        place = start[:live] + t
        types = np.where(place < stop[:live], padded[np.minimum(place, len(words))], end)
        h = h[:live]
        states.append(h)
        seen.append(types)
        who.append(np.arange(live))
        h = advance(net, h, types)[0]
        held += live
        # few lanes, as at the end of a long text, wait for more steps
        if (held >= LANES * WINDOW and len(seen) >= WINDOW) or t + 1 == len(lanes):
            logs, _ = log_probabilities(net, np.concatenate(states), np.concatenate(seen))
            out += np.bincount(np.concatenate(who), weights=logs, minlength=len(out))
            states, seen, who, held = [], [], [], 0
    result = np.empty(len(order))
    result[order] = out
    return result


def score(batches: Iterator[pa.RecordBatch], net, types, common, ends: int) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text): kind 0 per document, kind 1 per word of it that is not among the frequent ones."""
    from pyspark import TaskContext

    hasher = tb.Rolling()
    model, names = unpack(net.value), types.value
    frequent, counts = (np.frombuffer(x, d) for x, d in zip(common.value, (np.uint64, np.int64), strict=True))
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offsets in tb.chunks(batch.column(1), SCORED):
            words, doc = tokens_of(data, offsets, hasher)
            at, n = tb.bounds(doc, j - i), j - i
            kinds = names.of(words)
            other = kinds == names.other
            place = np.minimum(np.searchsorted(frequent, words), max(0, len(frequent) - 1))
            is_frequent = frequent[place] == words if len(frequent) else np.zeros(len(words), bool)
            logs = np.where(is_frequent, np.log10((counts[place] if len(counts) else 0) + 1.0), 0.0)
            add = lambda w, k: np.bincount(doc[k], weights=w[k], minlength=n)
            everything = np.ones(len(words), bool)
            likelihood = document_scores(model, kinds, at, names.end) / np.log(10)
            zero = np.zeros(n, np.int64)
            own = np.arange(row, row + n)
            yield pa.record_batch([
                pa.array(np.zeros(n, np.int8)), pa.array(own), ids.slice(i, n).cast(pa.int64()), pa.array(np.diff(at) + 1),
                pa.array(np.bincount(doc[is_frequent], minlength=n) + (ends > 0)), pa.array(np.bincount(doc[other], minlength=n)),
                pa.array(zero), pa.array(zero), pa.array(add(logs, everything) + np.log10(ends + 1.0)), pa.array(add(logs, other & is_frequent)),
                pa.array(likelihood)], ROW)
            k = np.flatnonzero(~is_frequent)
            order = k[np.lexsort((words[k], doc[k]))]
            w, d = words[order], doc[order]
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(order) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(order)))
            m = len(first)
            gap, none = np.zeros(m, np.int64), np.zeros(m)
            yield pa.record_batch([
                pa.array(np.ones(m, np.int8)), pa.array(own[d[first]]), pa.array(gap), pa.array(times), pa.array(gap), pa.array(gap),
                tb.signed(w[first]), pa.array(other[order][first].astype(np.int64)), pa.array(none), pa.array(none), pa.array(none)], ROW)
            row += n


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = texts.where(fold(F.col("doc_id")) != HELD_OUT)
    ends = training.count()
    counts = step(training.select("text").mapInArrow(count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "word_counts")
    words, kinds = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, n_types = words + ends, kinds + (ends > 0)

    # fewer than FREQUENT words occur more often than the one in that place
    least = kth_largest(counts.select(F.col("count").cast("double").alias("count")), "count", FREQUENT) if kinds > FREQUENT else 0.0
    got = counts.where(F.col("count") > least).toArrow()
    word, number = got["word"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(word)
    word, number = word[order], number[order]
    best = np.lexsort((word, -number))[:VOCABULARY]
    other_words, other_kinds = words - int(number[best].sum()), kinds - len(best)
    types = Types(word, number, ends, other_words)
    net = fit(training, types)

    send = spark.sparkContext.broadcast
    rows = step(texts.mapInArrow(
        partial(score, net=send(pack(net)), types=send(types), common=send((word.tobytes(), number.tobytes())), ends=ends), ROW_DDL), "scored")
    rare = rows.where("kind = 1").select("row", "word", F.col("n_tokens").alias("times"), "is_other")
    logs = F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 1.0)
    rare = rare.join(counts.hint("merge"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("r_known"), F.sum(logs).alias("r_logs"),
        F.sum(logs * F.col("is_other")).alias("r_other"))
    zero = F.lit(0)
    done = rows.where("kind = 0").join(rare, "row", "left")
    base = F.col("logs") + F.coalesce("r_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + n_types + 1)))
    model = F.col("model") + F.col("other_logs") + F.coalesce("r_other", F.lit(0.0)) - F.col("n_other") * F.lit(
        float(np.log10(other_words + other_kinds + 1)))
    return done.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("r_known", zero)).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
