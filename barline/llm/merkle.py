"""Merkle manifest of a dataset: leaf, proof and check for every document.

A language's leaves stand in the order of doc_id. Where a document stands follows from
rank queries, not from sorting: tasks make compressed bitmaps of the doc_ids they read, of
spans of ``1 << SPAN`` ids (a short list of places, or the bits), which are merged per
language and span. A popcount directory gives the rows before each span, found level by
level over ever wider spans, and another the bits before each block of 512 bits. A rank is
the sum of both and of the bits below in one block.

Trees are reduced ``LEVELS`` levels at a time: the nodes of a block of 1,024 meet by key and
fall into a slot array by their place. Going up, only the block's top is passed on. Going
down, a block gets the siblings between its top and the root, and adds its own.

Defined cases: null fields are written as ``-``; rows with a null doc_id come first in their
language; rows that share a language and doc_id (or have none) stand in the order of their
leaves, by the same rank queries; equal leaves in an order that does not change any tree;
a null language is the first group; a null doc_id is never tampered with, nor is a null
n_chars; one document is its own subroot; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import step

#: Bits of a doc_id inside a bitmap, the most places kept as a list, bits per directory entry.
SPAN, LISTED, BLOCK = 12, 32, 512
#: Levels of the tree reduced at once, and bits of a span's number resolved per directory level.
LEVELS, DIGITS = 10, 10
#: Rows of doc_ids a task holds before it passes their bitmaps on.
HELD = 1 << 20

CONTAINER = "a long, b long, span long, n long, places array<int>, bits binary, before array<int>, extra array<int>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the leaf's digest, and that of the row with n_chars raised by one, where 7 divides the checksum."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    first = [field(doc_id), field(F.col("source")), field(F.col("lang"))]
    digest = lambda n: F.sha2(F.concat(*first, field(n), field(F.col("text"))), 256)
    chosen = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    return docs.select(doc_id.alias("doc_id"), "lang", digest(n_chars).alias("leaf"), F.when(chosen, digest(n_chars + 1)).alias("tampered"))


def languages(rows: DataFrame) -> DataFrame:
    """(lang, g, n, missing): number of the language in bytewise order, null first, its leaves, and those without a doc_id.

    The distinct names are dealt into ranges; a name's number is its place in the range and
    the size of the ranges before, so no task sees all names.
    """
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("missing"))
    dealt = per.repartitionByRange(F.col("lang").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    dealt = step(dealt, "langs")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("lang").asc_nulls_first())) - 1
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    return step(dealt.withColumn("i", inside).join(starts, "part").select("lang", (F.col("start") + F.col("i")).alias("g"), "n", "missing"), "langs")


def containers(a: np.ndarray, b: np.ndarray, span: np.ndarray, place: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Bitmaps of (a, b, span, place) rows, each counted ``times``; ``extra`` lists (place, further rows) of repeated ids."""
    order = np.lexsort((place, span, b, a))
    a, b, span, place, times = (x[order] for x in (a, b, span, place, times))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (span[1:] != span[:-1])
    once = new.copy()
    once[1:] |= place[1:] != place[:-1]
    first = np.flatnonzero(once)
    times = np.add.reduceat(times, first) if len(first) else times
    a, b, span, place, new = a[first], b[first], span[first], place[first], new[first]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(a))
    places, bits, before, extra, n = [], [], [], [], []
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        n.append(int(times[i:j].sum()))
        more = np.flatnonzero(times[i:j] > 1) + i
        extra.append(np.stack([place[more], times[more] - 1], axis=1).ravel().tolist())
        if j - i <= LISTED:
            places.append(place[i:j].tolist())
            bits.append(None)
            before.append(None)
        else:
            flags = np.zeros(1 << SPAN, np.uint8)
            flags[place[i:j]] = 1
            places.append(None)
            bits.append(np.packbits(flags).tobytes())
            sizes = flags.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
            before.append((np.cumsum(sizes) - sizes).tolist())
    ints = pa.list_(pa.int32())
    longs = lambda x: pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays(
        [longs(a[starts]), longs(b[starts]), longs(span[starts]), longs(n), pa.array(places, ints), pa.array(bits, pa.binary()),
         pa.array(before, ints), pa.array(extra, pa.list_(pa.int64())).cast(ints)],
        names=["a", "b", "span", "n", "places", "bits", "before", "extra"])


def make_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of (a, b, key) rows as far as the task has read them."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(3)])
        size += len(batch)
        if size >= HELD:
            yield _bitmaps(held)
            held, size = [], 0
    if size:
        yield _bitmaps(held)


def _bitmaps(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    a, b, key = (np.concatenate(x) for x in zip(*held, strict=True))
    return containers(a, b, key >> SPAN, (key & ((1 << SPAN) - 1)).astype(np.int64), np.ones(len(a), np.int64))


def opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows at each) of the bitmaps of a batch."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in ("places", "bits", "extra")]
    for places, bits, extra in zip(*cols, strict=True):
        if places.is_valid:
            at = np.array(places.as_py(), np.int64)
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8)))
        times = np.ones(len(at), np.int64)
        more = np.array(extra.as_py(), np.int64).reshape(-1, 2)
        times[np.searchsorted(at, more[:, 0])] += more[:, 1]
        yield at, times


def merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap per (a, b, span) from rows that arrive together by these; a group may run over batches."""
    left: pa.RecordBatch | None = None

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, times = zip(*opened(batch), strict=True)
        size = np.array([len(p) for p in places])
        a, b, span = (np.repeat(batch.column(i).to_numpy(), size) for i in range(3))
        return containers(a, b, span, np.concatenate(places), np.concatenate(times))

    for batch in batches:
        if not len(batch):
            continue
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0))[-1]) + 1 if (keys != keys[:, -1:]).any() else 0
        if last:
            yield merged(batch.slice(0, last))
        # the last group so far, as one row, waits for the rest of it
        left = merged(batch.slice(last))
    if left is not None:
        yield left


def starts(sizes: DataFrame) -> DataFrame:
    """(a, b, span, start): rows of (a, b) in earlier spans.

    Sizes are summed over spans that are 1,024 times as wide at each level until few are
    left, at most 1,024 of (a, b); going back down, a span's start is its parent's and a running sum over at most
    1,024 siblings.
    """
    low, high = sizes.agg(F.min("span"), F.max("span")).first()
    levels = [sizes]
    while low is not None and high - low >= 1 << DIGITS:
        low, high = low >> DIGITS, high >> DIGITS
        up = levels[-1].groupBy("a", "b", F.shiftright("span", DIGITS).alias("span")).agg(F.sum("n").alias("n"))
        levels.append(step(up, "directory"))
    out = None
    for t in reversed(levels):
        t = t.withColumn("parent", F.lit(0) if out is None else F.shiftright("span", DIGITS))
        within = Window.partitionBy("a", "b", "parent").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
        if out is not None:
            up = out.select("a", "b", F.col("span").alias("parent"), F.col("start").alias("more"))
            t = t.join(up, ["a", "b", "parent"]).withColumn("start", F.col("start") + F.col("more"))
        out = t.select("a", "b", "span", "start")
    return out


def rank(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Appends (below, same) to the first ``keep`` columns: rows with a smaller place in the bitmap beside the row, and rows at its place."""
    for batch in batches:
        place = batch.column(keep).to_numpy()
        places, bits, before, extra = (batch.column(keep + i) for i in range(1, 5))
        below = np.zeros(len(batch), np.int64)
        dense = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
        if len(dense):
            maps = np.frombuffer(b"".join(bits.take(pa.array(dense)).to_pylist()), np.uint8).reshape(len(dense), -1, BLOCK // 8)
            block, inside = place[dense] // BLOCK, place[dense] % BLOCK
            flags = np.unpackbits(maps[np.arange(len(dense)), block], axis=1)
            directory = np.array(before.take(pa.array(dense)).to_pylist(), np.int64)
            below[dense] = directory[np.arange(len(dense)), block] + (flags * (np.arange(BLOCK) < inside[:, None])).sum(axis=1)
        listed = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
        for at, column, count in ((listed, places, True), (np.arange(len(batch)), extra, False)):
            part = column.take(pa.array(at))
            size = np.diff(part.offsets.to_numpy())
            flat = part.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(at, size)
            if count:
                below += np.bincount(owner[flat < place[owner]], minlength=len(batch))
            else:
                p, more, owner = flat[::2], flat[1::2], owner[::2]
                less, equal = p < place[owner], p == place[owner]
                below += np.bincount(owner[less], weights=more[less], minlength=len(batch)).astype(np.int64)
                same = 1 + np.bincount(owner[equal], weights=more[equal], minlength=len(batch)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:keep], pa.array(below), pa.array(same)], names=[*batch.schema.names[:keep], "below", "same"])


def ranked(rows: DataFrame, a: Column, b: Column, key: Column) -> DataFrame:
    """``rows`` with ``below``, the rows of their (a, b) with a smaller key, and ``same``, those with an equal one.

    Joined by span: a span's rows number more than its ids only where ids repeat, and then
    adaptive execution splits them.
    """
    keyed = rows.select("*", a.alias("a"), b.alias("b"), key.alias("key"))
    made = keyed.select("a", "b", "key").mapInArrow(make_bitmaps, CONTAINER)
    met = made.repartition("a", "b", "span").sortWithinPartitions("a", "b", "span")
    bitmaps = step(met.mapInArrow(merge_bitmaps, CONTAINER), "bitmaps")
    bitmaps = bitmaps.join(starts(bitmaps.select("a", "b", "span", "n")), ["a", "b", "span"]).drop("n")
    low = F.col("key").bitwiseAND(F.lit((1 << SPAN) - 1))
    joined = keyed.withColumn("span", F.shiftright("key", SPAN)).join(bitmaps, ["a", "b", "span"])
    given = joined.select(*rows.columns, "start", low.alias("place"), "places", "bits", "before", "extra")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*rows.columns, "start").schema)
    out = given.mapInArrow(partial(rank, keep=len(rows.columns) + 1), f"{schema}, below long, same long")
    return out.withColumn("below", F.col("below") + F.col("start")).drop("start")


def placed(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, g, n, idx) of (doc_id, leaf, tampered, g, n, missing) rows: the leaf's place in its language.

    ``missing`` is the number of the language's rows without a doc_id, which come first.
    """
    zero = F.lit(0).cast("long")
    named = step(ranked(rows.where("doc_id IS NOT NULL"), F.col("g"), zero, F.col("doc_id")), "places")
    unnamed = rows.where("doc_id IS NULL")
    named = named.withColumn("below", F.col("below") + F.col("missing"))
    columns = ["doc_id", "leaf", "tampered", "g", "n"]
    out = named.where("same = 1").select(*columns, F.col("below").alias("idx"))
    tied = named.where("same > 1").select(*columns, "below").unionByName(unnamed.select(*columns, F.lit(0).cast("long").alias("below")))
    if tied.isEmpty():
        return out
    # rows of one doc_id: by the first 60 bits of their leaves, then as they were written
    tied = tied.withColumnRenamed("below", "base")
    tied = ranked(tied, F.col("g"), F.col("base"), F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    tied = step(tied.withColumn("part", F.spark_partition_id()), "tied")
    own = ["g", "base", "below"]
    inside = F.row_number().over(Window.partitionBy("part", *own).orderBy("leaf")) - 1
    sizes = tied.groupBy(*own, "part").agg(F.count(F.lit(1)).alias("size"))  # as many rows per leaf as partitions hold it
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(*own, "part", earlier.alias("earlier"))
    tied = tied.withColumn("inside", inside).join(before, [*own, "part"])
    return out.unionByName(tied.select(*columns, (F.col("base") + F.col("below") + F.col("earlier") + F.col("inside")).alias("idx")))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


def slots(nodes: list, levels: int) -> list[list]:
    """The node arrays of each level of a block, from its filled slots up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i: i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(tree: list[list], at: int) -> list[str]:
    """One entry per level: L or R and the sibling on that side, or - where there is none."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append("-" if other >= len(nodes) else ("L" if other < at else "R") + nodes[other])
        at >>= 1
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """(key, rows) of the blocks in rows that arrive together by (g, block); at most 1,024 nodes and a path each."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["g"], row["block"])
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def tree_of(rows: list[dict]) -> list[list]:
    """Node arrays of a block from its (slot, n, h) rows."""
    array = [None] * len(rows)
    for r in rows:
        array[r["slot"]] = r["h"]
    return slots(array, min(LEVELS, depth(rows[0]["n"])))


def go_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, idx, n, h) of each block's top: the nodes of the next round."""
    out: list[tuple] = []
    schema = pa.schema([("g", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("h", pa.string())])

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    for (g, block), rows in blocks(batches):
        out.append((g, block, -(-rows[0]["n"] >> LEVELS), tree_of(rows)[-1][0]))
        if len(out) >= 1024:
            yield flush()
            out.clear()
    if out:
        yield flush()


def go_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, idx, subroot, root, path) of nodes; the block's own path comes as a row without a slot."""
    schema = pa.schema([("g", pa.int64()), ("idx", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("path", pa.list_(pa.string()))])
    for (g, block), rows in blocks(batches):
        head = next(r for r in rows if r["slot"] is None)
        rows = [r for r in rows if r["slot"] is not None]
        tree = tree_of(rows)
        yield pa.RecordBatch.from_pylist([
            {"g": g, "idx": (block << LEVELS) + r["slot"], "subroot": head["subroot"], "root": head["root"],
             "path": siblings(tree, r["slot"]) + head["path"]} for r in rows], schema)


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its siblings lead to."""
    for entry in path:
        node = digest(node) if entry == "-" else digest(entry[1:], node) if entry[0] == "L" else digest(node, entry[1:])
    return node


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The manifest's rows of each block of leaves."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    for _, rows in blocks(batches):
        head = next(r for r in rows if r["slot"] is None)
        rows = [r for r in rows if r["slot"] is not None]
        tree, out = tree_of(rows), []
        for r in rows:
            path = siblings(tree, r["slot"]) + head["path"]
            folded = fold(r["tampered"] or r["h"], path)
            out.append({
                "doc_id": r["doc_id"], "leaf": r["h"], "subroot": head["subroot"], "root": head["root"],
                "proof_sha256": digest(*[e[1:] for e in path if e != "-"]), "folded_root": folded, "verified": folded == head["root"]})
        yield pa.RecordBatch.from_pylist(out, schema)


def by_block(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Nodes, and the paths of their blocks, dealt and brought together by (g, block)."""
    rows = nodes.withColumn("block", F.shiftright("idx", LEVELS)).withColumn("slot", F.col("idx").bitwiseAND(F.lit((1 << LEVELS) - 1))).drop("idx")
    if paths is not None:
        rows = rows.unionByName(paths.withColumnRenamed("idx", "block"), allowMissingColumns=True)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block")


def rounds_up(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The node tables of each round; ``most`` is the largest tree's number of leaves."""
    out = [nodes]
    while most > 1:
        met = by_block(out[-1].select("g", "idx", "n", "h"))
        out.append(step(met.mapInArrow(go_up, "g long, idx long, n long, h string"), "nodes"))
        most = -(-most >> LEVELS)
    return out


def rounds_down(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the blocks of the first round, from those of the trees' tops (g, idx 0), the last round's nodes."""
    for nodes in rounds[-2:0:-1]:
        met = by_block(nodes.select("g", "idx", "n", "h"), paths)
        paths = step(met.mapInArrow(go_down, "g long, idx long, subroot string, root string, path array<string>"), "paths")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document."""
    spark = docs.sparkSession
    rows = step(leaves(docs), "leaves")
    langs = languages(rows)
    count, most = langs.agg(F.count(F.lit(1)), F.max("n")).first()
    if not count:
        return spark.createDataFrame([], PROOFS)
    numbered = rows.join(langs, rows["lang"].eqNullSafe(langs["lang"])).select("doc_id", "leaf", "tampered", "g", "n", "missing")
    nodes = step(placed(numbered).withColumnRenamed("leaf", "h"), "nodes")
    rounds = rounds_up(nodes, most)
    subroots = rounds[-1].select("g", F.col("h").alias("subroot"))
    # the tree over the languages is one more tree, of group 0
    top = [F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(count).cast("long").alias("n"), F.col("h")]
    upper = rounds_up(step(rounds[-1].select(*top), "nodes"), count)
    root = upper[-1].first()["h"]
    none = F.lit(None).cast("string")
    start = spark.range(1).select(
        F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("idx"), none.alias("subroot"), F.lit(root).alias("root"),
        F.array().cast("array<string>").alias("path"))
    over = rounds_down([upper[0], *upper], start) if count > 1 else start
    tops = over.select(F.col("idx").alias("g"), "root", "path").join(subroots, "g").withColumn("idx", F.lit(0).cast("long"))
    met = by_block(nodes, rounds_down(rounds, tops))
    return met.mapInArrow(prove, PROOFS)
