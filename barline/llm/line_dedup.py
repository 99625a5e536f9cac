"""Line deduplication: segment-partition edit join over all lines of all documents.

Lines are compared without white space at their ends; lines of white space are left alone.
Equal lines are one member. Two members are near when their edit distance (in
bytes) is at most the threshold of the shorter one: one edit per ``BYTES_PER_EDIT`` bytes,
at most ``threshold``. A line of length l with threshold t is cut into t + 1 segments, one
of which a near line contains unchanged close to its place: segments are indexed under
(length, number, content), and a line probes, for each length it may match, only those of
its substrings whose place fits the edits left and right of the segment. Members that meet
at a key form clusters; pairs within blocks of a cluster are checked with a byte histogram
and a banded bit-parallel edit distance. Near lines, followed from one to the next, form a
class; its first line (smaller doc_id, then earlier line) stays and all others go.

Defined cases: a null or empty text has no lines; rows without a doc_id, and rows whose
doc_id another text shares, come last, in the order of a hash; rows alike in doc_id and
text are one document (only an earlier line counts, so they keep their lines); an empty
table gives no rows; further columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barline.llm import textbytes as tb
from barline.llm.common import components, discard, free, identified, join_groups, partitions, step

#: Lines too short for an edit are near equal lines only.
MIN_BYTES = 1
BYTES_PER_EDIT = 30
THRESHOLD = 2
#: Members and bytes of one block of a cluster.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 1 << 18


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, number in the row, start, end, trimmed start, trimmed end) of all lines of a chunk."""
    brk = np.flatnonzero(data == 0x0A)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    row = np.concatenate([filled, np.searchsorted(offsets, brk, "right") - 1])
    start = np.concatenate([offsets[filled], brk + 1])
    end = np.concatenate([offsets[filled + 1], brk])
    by_start, by_end = np.lexsort((start, row)), np.lexsort((end, row))
    row, start, end = row[by_start], start[by_start], end[by_end]
    first = np.searchsorted(row, np.arange(len(offsets)))
    number = np.arange(len(row)) - first[row]
    ink = np.flatnonzero(~tb.SPACE[data])
    a = np.searchsorted(ink, start)
    b = np.searchsorted(ink, end)
    some = b > a
    padded = np.append(ink, 0)
    return row, number, start, end, np.where(some, padded[np.minimum(a, len(ink))], start), np.where(some, padded[b - 1] + 1, start)


def allowance(length: np.ndarray, threshold: int) -> np.ndarray:
    return np.minimum(length // BYTES_PER_EDIT, threshold)


def line_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray, hasher: tb.Rolling, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of all index segments and probe substrings of lines in ``data``."""
    keys, who = [], []
    sums = hasher.sums(data)

    def add(mask: np.ndarray, at: np.ndarray, size: np.ndarray, indexed: np.ndarray, t: int, i: int) -> None:
        k = np.flatnonzero(mask)
        if len(k):
            lo = start[k] + at[k]
            name = tb.mix(((indexed[k] * 16 + t) * 16 + i).astype(np.uint64))
            keys.append(tb.mix(hasher.between(sums, lo, lo + size[k]) + name))
            who.append(k)

    for t in range(1, threshold + 1):
        for shorter in range(t + 1):  # the indexed line has ``shorter`` bytes less
            indexed = length - shorter
            fits = (allowance(indexed, threshold) == t) & (indexed >= MIN_BYTES)
            base, long = indexed // (t + 1), indexed % (t + 1)
            for i in range(t + 1):
                small = t + 1 - long  # the first segments are the small ones
                size = base + (i >= small)
                place = base * i + np.maximum(0, i - small)
                for shift in range(-t, t + shorter + 1):
                    # the edits left of the segment and right of it bound how far it can have moved
                    if max(-i, shorter - (t - i)) <= shift <= min(i, shorter + (t - i)):
                        at = place + shift
                        add(fits & (at >= 0) & (at + size <= length), at, size, indexed, t, i)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(who)


#: ``name`` is the document of an occurrence, else the key; ``size`` is negative for repeats and 0 for keys.
SCAN = pa.schema([("name", pa.int64()), ("member", pa.int64()), ("place", pa.int64()), ("size", pa.int32())])


def _member(data: np.ndarray, start: np.ndarray, end: np.ndarray, hasher: tb.Rolling) -> np.ndarray:
    return hasher.ranges(data, start, end)


def scan(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Lines of (doc, text): occurrences, repeats inside a text, and keys of the chunk's members."""
    hasher = tb.Rolling()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, _, data, offsets in tb.chunks(batch.column(1)):
            row, number, _, _, a, b = lines(data, offsets)
            keep = b - a >= MIN_BYTES
            row, number, a, b = row[keep], number[keep], a[keep], b[keep]
            if not len(row):
                continue
            member = _member(data, a, b, hasher)
            tag = (hasher.ranges(data, offsets[:-1], offsets[1:]) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.lexsort((number, member, row))
            again = np.zeros(len(row), bool)
            x, y = order[:-1], order[1:]
            again[y] = (row[x] == row[y]) & (member[x] == member[y])
            yield pa.record_batch([
                pa.array(ids[i + row]), tb.signed(member), pa.array(tag[row] << 40 | number),
                pa.array(np.where(again, a - b, b - a).astype(np.int32))], SCAN)
            lead = np.unique(member, return_index=True)[1]
            keys, who = line_keys(data, a[lead], (b - a)[lead], hasher, threshold)
            yield pa.record_batch([
                tb.signed(keys), tb.signed(member[lead][who]), pa.array(np.zeros(len(keys), np.int64)), pa.array(np.zeros(len(keys), np.int32))], SCAN)


def near(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, t: int) -> np.ndarray:
    """Edit distance of pairs of rows of padded byte arrays, where it is at most ``t``; else more than ``t``.

    Column by column over ``b``, a word of 2t + 1 bits holds the differences between
    neighbouring cells of the band around the diagonal; all pairs advance together.
    """
    w = 2 * t + 1
    full, top = np.uint32((1 << w) - 1), np.uint32(1 << (w - 1))
    pairs, columns = len(a), int(len_b.max(initial=0))
    padded = np.full((pairs, a.shape[1] + 2 * w + columns), 256, np.uint16)
    padded[:, t: t + a.shape[1]] = np.where(np.arange(a.shape[1])[None, :] < len_a[:, None], a, 256)
    plus = np.full(pairs, full ^ np.uint32((1 << t) - 1), np.uint32)
    minus = np.zeros(pairs, np.uint32)
    score = np.full(pairs, t, np.int64)
    one = np.uint32(1)
    for i in range(columns):
        on = i < len_b
        eq = np.zeros(pairs, np.uint32)
        for j in range(w):
            eq |= (padded[:, i + j] == b[:, i]).astype(np.uint32) << np.uint32(j)
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = (minus | ~(d | plus)) & full
        down = d & plus
        # the cell on the band's edge while it is above the last row, then the last row itself
        ahead = i + 1 + t - len_a
        diagonal = ahead <= 0
        bit = (np.uint32(2 * t) - np.clip(ahead, 0, 2 * t).astype(np.uint32))
        change = np.where(diagonal, (d & top == 0).astype(np.int64), (up >> bit & one).astype(np.int64) - (down >> bit & one).astype(np.int64))
        score += np.where(on, change, 0)
        plus = np.where(on, (down | ~((d >> one) | up)) & full, plus)
        minus = np.where(on, (d >> one) & up, minus)
    return score


UNIT = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Rows and bytes of units compared together, pairs checked together and bytes of their lines.
TOGETHER, PAIRS, CELLS = 4096, 4096, 1 << 21


def compare(group: pa.Table, threshold: int) -> pa.Table:
    """(member, root) for members that are near others of their unit, a pair of blocks; rows are sorted by unit."""
    data, offsets = tb.column(group.column("line"))
    member, block = group.column("member").to_numpy(), group.column("block").to_numpy()
    name = [group.column(c).to_numpy() for c in ("component", "i", "j")]
    unit = np.zeros(len(member), np.int64)
    unit[1:] = np.cumsum(np.any([c[1:] != c[:-1] for c in name], axis=0))
    size = np.diff(offsets)
    order = np.lexsort((size, unit))
    k = len(order)
    size, member, block, unit = size[order], member[order], block[order], unit[order]
    row = np.repeat(np.arange(k), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + offsets[order][row]
    histogram = np.bincount(row * 64 + (data[at] & 63), minlength=64 * k).reshape(k, 64).astype(np.int32)
    both = (name[1] == name[2])[order]
    limit = allowance(size, threshold)
    # the shorter line sets the threshold; longer ones of the unit follow in order
    wide = int(size.max(initial=0)) + threshold + 1
    last = np.searchsorted(unit * wide + size, unit * wide + size + limit, "right")
    near_a, near_b = [], []
    for x in np.flatnonzero((limit > 0) & (last > np.arange(k) + 1)).tolist():
        end = int(last[x])
        ok = np.abs(histogram[x + 1: end] - histogram[x]).sum(axis=1) <= 2 * limit[x]
        if not both[x]:
            ok &= block[x + 1: end] != block[x]
        y = np.flatnonzero(ok) + x + 1
        near_a.append(np.full(len(y), x))
        near_b.append(y)
    pa_, pb = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (near_a, near_b))
    by_size = np.argsort(size[pb], kind="stable")
    pa_, pb = pa_[by_size], pb[by_size]
    root = np.arange(k)
    first = offsets[order]
    bytes_ = np.append(data, np.zeros(int(size.max(initial=0)) + 1, np.uint8))
    hi = len(pa_)
    while hi:
        # pairs of long lines are fewer at a time
        width = int(size[pb[hi - 1]])
        lo = max(0, hi - max(1, min(PAIRS, CELLS // width)))
        x, y = pa_[lo:hi], pb[lo:hi]
        hi = lo
        # pairs already connected need no check
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
        for t in range(1, threshold + 1):
            own = limit[x] == t
            u, v = x[own], y[own]
            if not len(u):
                continue
            cols = np.arange(int(size[v].max()))
            ok = near(bytes_[first[u][:, None] + cols], bytes_[first[v][:, None] + cols], size[u], size[v], t) <= t
            for p, q in zip(u[ok].tolist(), v[ok].tolist(), strict=True):
                p, q = root[p], root[q]
                if p != q:
                    root[root == max(p, q)] = min(p, q)
    out = np.flatnonzero(root != np.arange(k))
    return pa.table([pa.array(member[out]), pa.array(member[root[out]])], schema=UNIT)


def compare_units(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """``compare`` of rows sorted by unit, many whole units at a time."""

    def runs(group: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        volume = np.append(0, np.cumsum(pc.binary_length(group.column("line")).to_numpy().astype(np.int64)))[ends]
        lo = n = 0
        while n < len(ends):
            fits = (ends[n:] <= lo + TOGETHER) & (volume[n:] <= (volume[n - 1] if n else 0) + CELLS)
            n += max(1, int(np.count_nonzero(fits)))
            hi = int(ends[n - 1])
            yield from compare(group.slice(lo, hi - lo), threshold).to_batches()
            lo = hi

    rest: pa.Table | None = None
    for batch in batches:
        group = pa.Table.from_batches([batch])
        group = pa.concat_tables([rest, group]).combine_chunks() if rest else group
        name = [group.column(c).to_numpy() for c in ("component", "i", "j")]
        # the last unit may go on in the next batch
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in name], axis=0)) + 1
        if len(ends):
            yield from runs(group, ends)
        rest = group.slice(int(ends[-1]) if len(ends) else 0)
    if rest:
        yield from runs(rest, np.array([rest.num_rows]))


def pick_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trimmed lines of (text, wanted: list of members): (member, line)."""
    hasher = tb.Rolling()
    for batch in batches:
        wanted = batch.column(1)
        for i, j, data, offsets in tb.chunks(batch.column(0)):
            row, _, _, _, a, b = lines(data, offsets)
            keep = b - a >= MIN_BYTES
            row, a, b = row[keep], a[keep], b[keep]
            member = _member(data, a, b, hasher).view(np.int64)
            lists = wanted.slice(i, j - i)
            ask = set(lists.flatten().to_pylist())
            at = np.flatnonzero(np.isin(member, np.fromiter(ask, np.int64, len(ask))))
            at = at[np.unique(member[at], return_index=True)[1]]
            buffer = data.tobytes()
            yield pa.record_batch([
                pa.array(member[at]), pa.array([buffer[p:q] for p, q in zip(a[at].tolist(), b[at].tolist(), strict=True)], pa.binary())],
                ["member", "line"])


def cut_lines(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rewrites the text in column ``at`` without the lines listed (as tag and number) in the last column.

    That column is replaced by (number of lines, lines removed, digest of what is left).
    """
    hasher = tb.Rolling()
    out = pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        places = batch.column(batch.num_columns - 1)
        for i, j, data, offsets in tb.chunks(batch.column(at)):
            row, number, start, end, _, _ = lines(data, offsets)
            tag = (hasher.ranges(data, offsets[:-1], offsets[1:]) & np.uint64(0xFFFF)).astype(np.int64)
            first = np.searchsorted(row, np.arange(j - i + 1))
            lists = places.slice(i, j - i)
            r = np.repeat(np.arange(j - i), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten().to_numpy()
            ok = flat >> 40 == tag[r]
            gone = np.zeros(len(row), bool)
            gone[first[r[ok]] + (flat[ok] & ((1 << 40) - 1))] = True
            buffer = data.tobytes()
            texts = []
            for k in range(j - i):
                own = range(first[k], first[k + 1])
                if gone[first[k]: first[k + 1]].any():
                    texts.append(b"\n".join(buffer[start[x]: end[x]] for x in own if not gone[x]))
                else:
                    texts.append(buffer[offsets[k]: offsets[k + 1]])
            total = np.diff(first)
            removed = np.bincount(row[gone], minlength=j - i)
            part = batch.slice(i, j - i)
            columns = list(part.columns)
            changed = pa.array(removed > 0)
            columns[at] = pc.if_else(changed, pa.array(texts, pa.binary()).cast(pa.string()), columns[at].cast(pa.string()))
            columns[-1] = pa.StructArray.from_arrays(
                [pa.array(total), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], fields=list(out))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(columns, names=names)


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, places) of (doc, text) rows: the lines to remove from each document that has some."""
    spark = docs.sparkSession
    texts = docs.select("doc", F.col("text").cast("binary").alias("text"))
    rows = step(texts.mapInArrow(
        partial(scan, threshold=threshold), "name long, member long, place long, size int"), "lines")
    line = F.col("place").bitwiseAND(F.lit((1 << 40) - 1))
    seen = step(rows.where("size > 0").select("member", F.col("name").alias("doc"), "place", "size", line.alias("line")), "line_places")
    again = step(rows.where("size < 0").select(F.col("name").alias("doc"), "place"), "line_repeats")
    total = seen.count()
    members = step(seen.groupBy("member").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc").alias("doc"), F.min_by("line", "doc").alias("line"), F.max("size").alias("size")), "line_members")

    # dealt once, for the least member of each key and for the others
    keys = rows.where("size = 0").select(F.col("name").alias("key"), "member").repartition("key")
    shared = keys.groupBy("key").agg(F.min("member").alias("low"), F.max("member").alias("high")).where("low <> high").select("key", "low")
    edges = keys.join(shared.hint("merge"), "key").where("member <> low").select(F.col("low").alias("a"), F.col("member").alias("b"))
    clusters = components(edges.distinct())
    discard(rows)
    clusters = clusters.withColumnRenamed("node", "member").join(members, "member")
    volume = clusters.groupBy("component").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("count"))
    blocks = F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("count") / BLOCK_MEMBERS)).cast("int")
    clusters = step(clusters.join(volume.select("component", blocks.alias("blocks")), "component").select(
        "component", "member", "doc", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block")), "line_clusters")
    wanted = clusters.groupBy("doc").agg(F.collect_list("member").alias("wanted"))
    # texts are dealt by key at any size
    found = texts.join(wanted.hint("merge"), "doc").select("text", "wanted").mapInArrow(pick_lines, "member long, line binary").dropDuplicates(["member"])
    pair = F.explode(F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, block) AS i, greatest(b, block) AS j))"))
    units = found.join(clusters, "member").select("component", "member", "block", "line", pair.alias("p"))
    units = units.select("component", "member", "block", "line", "p.i", "p.j").repartition(partitions(spark), "component", "i", "j")

    units = units.sortWithinPartitions("component", "i", "j")
    links = step(units.mapInArrow(partial(compare_units, threshold=threshold), "a long, b long"), "line_links")
    linked = components(links).withColumnRenamed("node", "member")
    named = members.join(linked, "member", "left").withColumn("component", F.coalesce("component", "member"))
    # the first line of each class
    first = named.groupBy("component", "doc").agg(F.min("line").alias("line"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("kinds"))
    first = first.groupBy("component").agg(
        F.min("doc").alias("keep_doc"), F.min_by("line", "doc").alias("keep_line"), F.sum("rows").alias("class_rows"), F.sum("kinds").alias("kinds"))
    first = first.where("class_rows > 1")
    classes = step(join_groups(named.select("component", "member", "rows"), first, ["component"], "class_rows", max(1, total)).select(
        "member", "rows", "keep_doc", "keep_line"), "line_classes")
    gone = join_groups(seen, classes, ["member"], "rows", max(1, total)).where(
        (F.col("doc") > F.col("keep_doc")) | ((F.col("doc") == F.col("keep_doc")) & (F.col("line") > F.col("keep_line"))))
    gone = gone.select("doc", "place").unionByName(again)
    places = step(gone.groupBy("doc").agg(F.collect_set("place").alias("places")), "line_gone")
    # the texts are dealt once more after this; the tables of lines make room for them
    for done in (seen, again, members, clusters, classes):
        discard(done)
    return places


#: What ``without_repeats`` adds.
COUNTS = StructType([StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, name: str = "lines") -> DataFrame:
    """``docs`` with repeated lines cut from the text, and a struct column ``name`` (n_lines, n_removed, kept_sha256)."""
    own = free(docs, "__doc")
    keyed = identified(docs, own)
    gone = repeated_lines(keyed.select(F.col(own).alias("doc"), "text"), threshold)
    joined = keyed.alias("a").join(gone.hint("merge").alias("b"), F.col(f"a.{own}") == F.col("b.doc"), "left").select(*[F.col(f"a.`{c}`").alias(c) for c in docs.columns], F.col("b.places").alias(name))
    return joined.mapInArrow(
        partial(cut_lines, at=docs.columns.index("text")), StructType([*docs.schema.fields, StructField(name, COUNTS)]))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256, text), one row per document."""
    done = without_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), threshold)
    return done.select("doc_id", "lines.n_lines", "lines.n_removed", "lines.kept_sha256", "text")


def documents_left(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without repeated lines; documents of which nothing is left go. ``n_chars`` follows the text."""
    name = free(docs, "lines")
    done = without_repeats(docs, threshold, name)
    cut = F.col(name)["n_removed"] > 0
    left = done.where(~cut | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        left = left.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
