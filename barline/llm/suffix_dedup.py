"""Removal of repeated byte strings with suffix arrays built by linear grouping.

A string of ``length`` bytes that occurs twice has the same canonical anchor both times: the
16-byte gram of least hash in it. Texts are cut into fragments, each the strings that share
one anchor occurrence. Equal fragments settle each other by their first occurrence. Only
anchors with several different fragments need more: their fragments (each once) meet in a
task. Most share little more than the anchor; those that agree with another one on as many
bytes around it as any common string holds are cut at content-defined places into tokens in
byte order, and one suffix array over the tokens gives all classes of equal strings. The array is built by grouping suffixes by
their Lyndon prefixes.

Order of occurrences: smaller doc_id, then earlier start. Rows without a doc_id, and rows
whose doc_id another text shares, are documents of their own and come last, in the order
of a hash; rows alike in doc_id and text are one document (only an earlier start counts).
An anchor with more than ``hot`` different fragments is not gathered: its strings are grouped
one by one.

Defined cases: a null or empty text has no bytes and the digest of nothing; texts shorter
than ``length`` lose nothing; rows alike keep their bytes (neither is earlier); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import textbytes as tb
from barline.llm.common import discard, identified, join_groups, partitions, step

GRAM = 16
#: Tokens sorted in one suffix array.
TOKENS = 1 << 16
#: Parts of the places an anchor can have in a string: strings of one part have all but 1/PARTS of their bytes around it in common.
PARTS = 5
#: Different fragments of one anchor that may meet in a task.
HOT = 20_000


def lyndon_grouping(text: list[int]) -> list[int]:
    """Suffix array of a sequence of integers (the end counts as smaller than anything).

    Groups start as the suffixes with equal first symbol and end as those with equal Lyndon
    prefix. The highest group not yet treated is final; each of its suffixes finds the next
    suffix to its left in a lower group, and those found move to new groups right above
    their own, ordered by how many suffixes of the group point at them. Then all groups are
    filled in one pass over the growing array: the suffix left of an emitted one, and on
    along the pointers, comes next in its group.
    """
    n = len(text)
    members: list[list[int]] = []
    by_symbol: dict[int, int] = {}
    group = [0] * n
    for s in sorted(set(text)):
        by_symbol[s] = len(members)
        members.append([])
    for i, s in enumerate(text):
        g = by_symbol[s]
        group[i] = g
        members[g].append(i)
    top = len(members) - 1
    below = list(range(-1, top))
    above = list(range(1, top + 2))
    smaller = [-1] * n
    # one place more, never set: walking left ends at -1
    done = bytearray(n + 1)
    current = top
    lowest = 0
    while current >= 0:
        own = [s for s in members[current] if group[s] == current]
        members[current] = own
        if len(own) == 1:
            # a group of one points at one suffix, which moves alone
            s = own[0]
            done[s] = 1
            j = s - 1
            while done[j]:
                j = smaller[j]
            smaller[s] = j
            moving = [j] if j >= 0 else []
            pointed = {j: 1}
        else:
            own.sort()
            for s in own:
                done[s] = 1
            pointed = {}
            for s in own:
                j = s - 1
                while done[j]:
                    j = smaller[j]
                smaller[s] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            moving = list(pointed)
        level = 1
        while moving:
            made: dict[int, int] = {}
            for p in moving:
                g = group[p]
                h = made.get(g)
                if h is None:
                    h = made[g] = len(members)
                    members.append([])
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = h
                    below[up] = h
                group[p] = h
                members[h].append(p)
            moving = [p for p in moving if pointed[p] > level]
            level += 1
        current = below[current]
    # places of the groups from the lowest up; all members are final now
    place = [0] * len(members)
    at, g = 0, lowest
    left = len(members)
    while left:
        place[g] = at
        at += len(members[g])
        g = above[g]
        left -= 1
    order = [-1] * n
    out = bytearray(n)
    for i in range(-1, n):
        j = (n if i < 0 else order[i]) - 1
        while j >= 0 and not out[j]:
            out[j] = 1
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            j = smaller[j]
    return order


def fragments(data: np.ndarray, offsets: np.ndarray, hasher: tb.Rolling, length: int):
    """(row, start in the row, number of strings, anchor hash, fragment hash) of a chunk of texts."""
    span = length - GRAM + 1
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = hasher.grams(data, GRAM)
    # the least hash of each window, leftmost first: hash above, position below
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    m = 1
    while 2 * m <= span:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    if span > m:
        low = np.minimum(low[: len(low) - (span - m)], low[span - m:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    ok = start + length <= offsets[row + 1]
    start, anchor, row = start[ok], anchor[ok], row[ok]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo, at, row = start[first], anchor[first], row[first]
    whole = tb.mix(hasher.ranges(data, lo, lo + count - 1 + length) + (at - lo).astype(np.uint64))
    return row, lo - offsets[row], count, grams[at], whole


def tags(data: np.ndarray, offsets: np.ndarray, hasher: tb.Rolling) -> np.ndarray:
    """Sixteen bits of each whole text's hash: tells rows with one doc_id apart."""
    return (hasher.ranges(data, offsets[:-1], offsets[1:]) & np.uint64(0xFFFF)).astype(np.int64)


# where a fragment is: tag, number of strings and start in one long
def pack(tag: np.ndarray, count: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (tag << 47) | (count << 40) | start


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 47, (place >> 40) & 0x7F, place & ((1 << 40) - 1)


FRAGMENT = pa.schema([("anchor", pa.int64()), ("fragment", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])


def scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Fragments of (doc, text). One that occurred before in its text is marked by a null anchor."""
    hasher = tb.Rolling()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, _, data, offsets in tb.chunks(batch.column(1)):
            row, start, count, anchor, whole = fragments(data, offsets, hasher, length)
            if not len(row):
                continue
            again = np.ones(len(row), bool)
            order = np.lexsort((start, whole, row))
            w, r = whole[order], row[order]
            again[order[0]] = False
            again[order[1:]] = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
            place = pack(tags(data, offsets, hasher)[row], count, start)
            yield pa.record_batch([
                pa.array(anchor.view(np.int64), mask=again), tb.signed(whole), pa.array(ids[i + row]), pa.array(place)], FRAGMENT)


PIECE = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary()), ("second", pa.int64())])


def cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted fragments of (doc, text, wanted: list of (anchor, place, hot)).

    A hot anchor's fragment gives its strings instead, as two independent hashes (``second``
    is null otherwise).
    """
    hasher, other = tb.Rolling(), tb.Rolling(1)
    for batch in batches:
        wanted = batch.column(2)
        for i, j, data, offsets in tb.chunks(batch.column(1)):
            tag = tags(data, offsets, hasher)
            lists = wanted.slice(i, j - i)
            row = np.repeat(np.arange(j - i), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            anchor = flat.field("anchor").to_numpy()
            place = flat.field("place").to_numpy()
            hot = flat.field("hot").to_numpy(zero_copy_only=False)
            own, count, start = unpack(place)
            ok = own == tag[row]
            doc = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)[row]
            buffer = data.tobytes()
            k = np.flatnonzero(ok & ~hot)
            lo = offsets[row[k]] + start[k]
            hi = lo + count[k] - 1 + length
            yield pa.record_batch([
                pa.array(anchor[k]), pa.array(doc[k]), pa.array(place[k]),
                pa.array([buffer[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()), pa.nulls(len(k), pa.int64())], PIECE)
            k = np.flatnonzero(ok & hot)
            if len(k):
                each = np.repeat(k, count[k])
                begin = np.cumsum(count[k]) - count[k]
                step_ = np.arange(len(each)) - np.repeat(begin, count[k])
                lo = offsets[row[each]] + start[each] + step_
                yield pa.record_batch([
                    tb.signed(hasher.ranges(data, lo, lo + length)), pa.array(doc[each]),
                    pa.array(pack(own[each], np.ones(len(each), np.int64), start[each] + step_)), pa.nulls(len(each), pa.binary()),
                    tb.signed(other.ranges(data, lo, lo + length))], PIECE)


def _starts(data: np.ndarray, row_end: np.ndarray, inner: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Token starts. ``mode`` per byte: 0 some words, 1 all words, 2 all bytes; ``inner``: not the first byte of its fragment."""
    at = np.arange(len(data))
    after_space = np.zeros(len(data), bool)
    after_space[1:] = tb.SPACE[data[:-1]]
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    four = padded[:-4] | padded[1:-3] << np.uint32(8) | padded[2:-2] << np.uint32(16) | padded[3:-1] << np.uint32(24)
    chosen = (four * np.uint32(0x9E3779B1) >> np.uint32(29) < 2) & (at + 4 <= row_end)
    return inner & ((mode == 2) | after_space & ((mode == 1) | (mode == 0) & chosen))


COVERED = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def classes(pieces: list[bytes], anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, hasher: tb.Rolling, length: int) -> pa.RecordBatch:
    """Spans of the strings in these fragments that occur earlier in another one of them."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    tag, count, start = unpack(place)
    row = np.repeat(np.arange(len(pieces)), size)
    row_end = offsets[row + 1]
    inner = np.ones(len(data), bool)
    inner[offsets[:-1]] = False
    w_row = np.repeat(np.arange(len(pieces)), count)
    w_at = np.arange(len(w_row)) - np.repeat(np.cumsum(count) - count, count) + offsets[w_row]
    # every string needs a token start inside; an anchor where one has none is cut finer as a whole
    mode = np.zeros(len(pieces), np.int64)
    _, by_anchor = np.unique(anchor, return_inverse=True)
    for finer in (1, 2, 3):
        starts = np.flatnonzero(_starts(data, row_end, inner, mode[row]))
        following = np.searchsorted(starts, w_at, "right")
        after = np.append(starts, len(data) + length)[following]
        room = length - 4 * (mode[w_row] == 0)
        bad = after > w_at + np.minimum(room, length - 1)
        if not bad.any():
            break
        assert finer < 3
        worst = np.zeros(by_anchor.max() + 1, bool)
        worst[by_anchor[w_row[bad]]] = True
        mode[worst[by_anchor]] = finer
    # tokens in byte order; a word token also holds the four bytes that ended it, so none is a prefix of another
    n = len(starts)
    t_row = row[starts]
    ends = np.append(starts[1:], len(data))
    ends = np.where(np.append(t_row[1:] != t_row[:-1], True), offsets[t_row + 1], ends)
    ends = np.minimum(ends + 4 * (mode[t_row] == 0), offsets[t_row + 1])
    buffer = data.tobytes()
    tokens = [buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    rank = {t: r for r, t in enumerate(sorted(set(tokens)), 1)}
    text: list[int] = []
    where: list[int] = []
    last = -1
    for k, (t, r) in enumerate(zip(tokens, t_row.tolist(), strict=True)):
        if r != last:
            text.append(0)
            where.append(-1)
            last = r
        text.append(rank[t])
        where.append(k)
    order = np.array(where, np.int64)[np.array(lyndon_grouping(text), np.int64)]
    order = order[order >= 0]
    # bytes that neighbours in the array share
    reach = np.concatenate([data, np.zeros(length, np.uint8)])
    stop = offsets[t_row + 1] - starts
    shared = np.zeros(n, np.int64)
    for a in range(0, n - 1, 1 << 14):
        x, y = order[a: min(a + (1 << 14), n - 1)], order[a + 1: min(a + (1 << 14), n - 1) + 1]
        span = np.arange(length)
        same = reach[starts[x][:, None] + span] == reach[starts[y][:, None] + span]
        first = np.where(same.all(axis=1), length, np.argmin(same, axis=1))
        shared[a + 1: a + 1 + len(x)] = np.minimum(first, np.minimum(stop[x], stop[y]))
    position = np.empty(n, np.int64)
    position[order] = np.arange(n)
    token = following
    before = starts[token] - w_at
    left = hasher.ranges(data, w_at, w_at + before)
    run = np.empty(len(w_at), np.int64)
    by_length = np.argsort(before, kind="stable")
    cut = np.searchsorted(before[by_length], np.arange(1, length + 1))
    for e in range(1, length):
        k = by_length[cut[e - 1]: cut[e]]
        if len(k):
            run[k] = np.cumsum(shared < length - e)[position[token[k]]]
    begin = start[w_row] + w_at - offsets[w_row]
    order = np.lexsort((begin, doc[w_row], left, run, before))
    covered = np.zeros(len(w_at), bool)
    x, y = order[:-1], order[1:]
    same = (before[x] == before[y]) & (run[x] == run[y]) & (left[x] == left[y])
    # the first of a class and what ties with it stay
    head = np.ones(len(order), bool)
    head[1:] = ~same
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    covered[order] = (doc[w_row[order]] != doc[w_row[leader]]) | (begin[order] != begin[leader])
    hit = np.flatnonzero(covered)
    if not len(hit):
        return pa.record_batch([pa.array([], pa.int64())] * 4, COVERED)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (w_row[hit[1:]] != w_row[hit[:-1]])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(hit)) - 1
    r = w_row[hit[first]]
    return pa.record_batch([
        pa.array(doc[r]), pa.array(tag[r]), pa.array(begin[hit[first]]), pa.array(begin[hit[final]] + length)], COVERED)


def agreeing(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, count: np.ndarray, hasher: tb.Rolling, length: int) -> np.ndarray:
    """Which of these fragments can have a string in common with another one of the same anchor.

    A string whose anchor lies ``a`` to ``b`` bytes behind its start holds the bytes from ``a``
    before the anchor on to ``length - b`` after its start. Equal strings have their anchors at
    the same place, so fragments that share one agree on these bytes.
    """
    n = len(anchor)
    row = np.repeat(np.arange(n), np.diff(offsets))
    grams = hasher.grams(data, GRAM)
    hit = np.flatnonzero(grams == anchor.view(np.uint64)[row[: len(grams)]])
    hit = hit[hit + GRAM <= offsets[row[hit] + 1]]
    # leftmost, as the least hash of a fragment's first string is its leftmost one
    found, first = np.unique(row[hit], return_index=True)
    out = np.ones(n, bool)
    out[found] = False
    at = hit[first]
    highest = at - offsets[found]
    lowest = highest - count[found] + 1
    sums = hasher.sums(data)
    width = -(-(length - GRAM + 1) // PARTS)
    for a in range(0, length - GRAM + 1, width):
        b = min(a + width - 1, length - GRAM)
        k = np.flatnonzero((a <= highest) & (b >= lowest))
        if len(k):
            own = hasher.between(sums, at[k] - a, at[k] - b + length)
            _, kind, members = np.unique(tb.mix(own + anchor.view(np.uint64)[found[k]]), return_inverse=True, return_counts=True)
            out[found[k[members[kind] > 1]]] = True
    return out


def sort_fragments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``classes`` over runs of whole anchors; rows (anchor, doc, place, bytes) come sorted by anchor."""
    hasher = tb.Rolling()
    limit = 12 * TOKENS
    held: list[pa.RecordBatch] = []
    volume, before = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        anchor, doc, place = (rows.column(c).to_numpy() for c in range(3))
        data, offsets = tb.column(rows.column(3))
        k = np.flatnonzero(agreeing(data, offsets, anchor, unpack(place)[1], hasher, length))
        if len(k):
            buffer = data.tobytes()
            pieces = [buffer[i:j] for i, j in zip(offsets[k].tolist(), offsets[k + 1].tolist(), strict=True)]
            yield classes(pieces, anchor[k], doc[k], place[k], hasher, length)

    for batch in batches:
        if not len(batch):
            continue
        anchor = batch.column(0).to_numpy()
        new = np.append(bool(held) and anchor[0] != before, anchor[1:] != anchor[:-1])
        change = np.flatnonzero(new)
        done = np.append(0, np.cumsum(np.diff(tb.column(batch.column(3))[1])))
        i = 0
        while True:
            # the first new anchor after more than ``limit`` bytes
            full = np.searchsorted(done, done[i] + limit - volume, "right")
            p = np.searchsorted(change, max(full, i if held else i + 1))
            if p == len(change):
                break
            held.append(batch.slice(i, change[p] - i))
            yield from flush()
            held, volume, i = [], 0, int(change[p])
        held.append(batch.slice(i))
        volume, before = volume + int(done[-1] - done[i]), anchor[-1]
    if held:
        yield from flush()


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans: list of (tag, start, end)) -> what is left of each text."""
    hasher = tb.Rolling()
    for batch in batches:
        spans = batch.column(2)
        for i, j, data, offsets in tb.chunks(batch.column(1)):
            tag = tags(data, offsets, hasher)
            lists = spans.slice(i, j - i)
            row = np.repeat(np.arange(j - i), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            ok = flat.field("tag").to_numpy() == tag[row]
            row = row[ok]
            delta = np.zeros(len(data) + 1, np.int64)
            np.add.at(delta, offsets[row] + flat.field("start").to_numpy()[ok], 1)
            np.add.at(delta, offsets[row] + flat.field("end").to_numpy()[ok], -1)
            gone = np.cumsum(delta[:-1]) > 0
            lost = np.zeros(len(data) + 1, np.int64)
            np.cumsum(gone, out=lost[1:])
            _, _, span_row = tb.runs(gone, offsets)
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([
                batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(lost[offsets[1:]] - lost[offsets[:-1]]),
                pa.array(np.bincount(span_row, minlength=j - i)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                pa.array(kept if with_text else [None] * len(kept), pa.binary())], OUT)


def suffix_dedup(docs: DataFrame, length: int = 100, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per document.

    Every byte covered by a ``length``-byte string that also starts earlier is removed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    keyed = identified(texts, "doc")
    found = step(keyed.select("doc", "text").mapInArrow(
        partial(scan, length=length), "anchor long, fragment long, doc long, place long"), "fragments")
    single = found.where("anchor IS NOT NULL")
    kinds = step(single.groupBy("anchor", "fragment").agg(
        F.count(F.lit(1)).alias("members"), F.min("doc").alias("first_doc"), F.min_by("place", "doc").alias("first_place")), "fragment_kinds")
    total = found.count()

    start = F.col("place").bitwiseAND(F.lit((1 << 40) - 1))
    count = F.shiftright("place", 40).bitwiseAND(F.lit(0x7F))
    spans = lambda df: df.select(
        "doc", F.shiftright("place", 47).alias("tag"), start.alias("start"), (start + count + F.lit(length - 1)).alias("end"))
    first_start = F.col("first_place").bitwiseAND(F.lit((1 << 40) - 1))
    later = (F.col("doc") > F.col("first_doc")) | ((F.col("doc") == F.col("first_doc")) & (start > first_start))
    repeated = kinds.where("members > 1").select("fragment", "members", "first_doc", "first_place")
    equal = step(spans(join_groups(single.select("fragment", "doc", "place"), repeated, ["fragment"], "members", max(1, total)).where(later))
                 .unionByName(spans(found.where("anchor IS NULL"))), "equal_fragments")

    # anchors with several kinds of fragments: one of each kind goes on
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = several.withColumn("hot", F.col("kinds") > hot)
    wanted = step(kinds.select("anchor", F.col("first_doc").alias("doc"), F.col("first_place").alias("place")).join(several, "anchor")
                  .groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("wanted")), "wanted_fragments")
    discard(found)
    discard(kinds)
    # texts are dealt by key at any size
    pieces = step(keyed.select("doc", "text").join(wanted.hint("merge"), "doc").mapInArrow(
        partial(cut_out, length=length), "anchor long, doc long, place long, bytes binary, second long"), "fragment_bytes")
    by_anchor = pieces.where("second IS NULL").select("anchor", "doc", "place", "bytes").dropDuplicates(["anchor", "doc", "place"])
    by_anchor = by_anchor.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    sorted_out = by_anchor.mapInArrow(partial(sort_fragments, length=length), "doc long, tag long, start long, end long")
    strings = pieces.where("second IS NOT NULL").select("anchor", "second", "doc", "place")
    strings = strings.withColumn("start", start)
    leaders = strings.groupBy("anchor", "second", "doc").agg(F.count(F.lit(1)).alias("members"), F.min("start").alias("start"))
    leaders = leaders.groupBy("anchor", "second").agg(
        F.sum("members").alias("members"), F.min("doc").alias("first_doc"), F.min_by("start", "doc").alias("first_start")).where("members > 1")
    one_by_one = spans(join_groups(strings, leaders, ["anchor", "second"], "members", max(1, total)).where(
        (F.col("doc") > F.col("first_doc")) | ((F.col("doc") == F.col("first_doc")) & (F.col("start") > F.col("first_start")))))
    covered = equal.unionByName(sorted_out).unionByName(one_by_one)
    # a set: rows alike in id and text are one document and give the same spans
    covered = covered.groupBy("doc").agg(F.collect_set(F.struct("tag", "start", "end")).alias("spans"))
    out = keyed.join(covered.hint("merge"), "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        partial(remove, with_text=with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
