"""Exact Jaccard join on word shingles: universe partition, pigeonhole, exact check.

Two sets with 100 * |A & B| >= t * |A | B| differ in at most
H = (100 - t) * (|A| + |B|) / (100 + t) elements. Shingles are hashed into m segments; sizes
fall into bands, and a band has m = H + 1 segments for its largest pair, so that some
segment of two linked sets agrees. The first few segments of a band are also indexed with
one element left out: a set that probes such a segment with its own one-deletion
neighbourhood covers two differences with it. Each set allots H + 2 T - 1 units to the
cheapest of these probes, by the frequencies of their keys (a first pass finds the frequent
ones), and so skips empty and common segments; as a segment has two units at most, linked
sets then meet in T segments at least, T = 2 or more by band.

Where few sets probe a key, each of them is paired with the others there, and pairs that
meet less than T times are not linked. Where many do, the sets at that key are compared in blocks by
sketches: counts of shingles in ``CELLS`` cells (more for large sets), whose differences add
up to at most the number of different shingles; pairs that differ too much are not linked either. What is left
connects sets to clusters; a cluster is cut into blocks of bounded size, pairs of blocks are
compared exactly (shared columns as matrix products), and each comparison returns a spanning
set of its links and the number of links of each set, never the pairs.

Sets are known by a 64-bit digest; equal sets are one member until the end.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text
with fewer words than a shingle is one shingle; a null doc_id is never a component's id,
but its row is linked like others (component null if no member has an id); repeated rows
are members of one set; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import textbytes as tb
from barline.llm.common import components, discard, join_groups, partitions, step

#: A band reaches from its lowest size to this many times it.
BAND = 1.5
#: One segment in so many has one-deletion neighbourhoods in the index.
DELETIONS = 16
#: Probing sets at a key up to which they are paired with the others there.
FEW = 8
#: Cells of a sketch; they double with each doubling of the set beyond ROOMY shingles.
CELLS, ROOMY = 128, 1024
#: Segments with deletions per meeting asked of linked sets beyond two.
MEETINGS = 8
#: A key is frequent if it occurs over FREQUENT times and more often than one in COMMON of all key rows; there are fewer than COMMON.
FREQUENT, COMMON = 16, 1 << 18
#: Shingles and members of one block of a cluster.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 16, 512


def largest_difference(a: int, b: int, percent: int) -> int:
    """The most elements in which linked sets of sizes a and b differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(largest: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(lowest size, segments, segments with deletions, H, T) of each band up to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * BAND))
        top = high - 1
        h = largest_difference(top, 100 * top // percent, percent)
        enabled = min(h + 1, max(5, (h + 1) // DELETIONS))
        out.append((low, h + 1, enabled, h, 2 + enabled // MEETINGS))
        low = high
    return out


def sets_of(text: pa.Array, hasher: tb.Rolling, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk of texts as sorted (row, hash)."""
    data, offsets = tb.column(text)
    start, end, row = tb.words(data, offsets)
    return tb.shingles(hasher.ranges(tb.fold(data), start, end), row, len(text), size)


def digest_of(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, digest) of each set; the digest does not depend on order."""
    at = tb.bounds(rows, n)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(tb.mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    count = np.diff(at)
    return count, tb.mix(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64))


def _segments(values: np.ndarray, doc: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums and sizes of all segments (flat, per document) and the segment of each value."""
    first = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=first[1:])
    place = first[doc] + ((values >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    content = tb.mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(content[order], out=sums[1:])
    size = np.bincount(place, minlength=first[-1])
    edge = np.zeros(first[-1] + 1, np.int64)
    np.cumsum(size, out=edge[1:])
    return first, sums[edge[1:]] - sums[edge[:-1]], size, place, content


def _keys(band: np.ndarray, segment: np.ndarray, content: np.ndarray) -> np.ndarray:
    return tb.mix(content + tb.mix((band.astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(1)))


def probes(
    values: np.ndarray, doc: np.ndarray, size: np.ndarray, band: np.ndarray, plan: np.ndarray, own: bool, percent: int,
    common: tuple[np.ndarray, np.ndarray] | None = None,
):
    """Rows (key, document, probing) of documents in one role. ``common``: sorted frequent keys and how often they occur.

    ``band`` is the band whose segments are used: the documents' own (all segments are
    indexed, the allotted ones also probe) or the one below (they only probe).
    """
    m, with_deletions = plan[band, 1], plan[band, 2]
    first, content, seg_size, place, element = _segments(values, doc, m)
    seg_doc = np.repeat(np.arange(len(m)), m)
    seg = np.arange(first[-1]) - first[seg_doc]
    key = _keys(band[seg_doc], seg, content)
    # one-deletion neighbourhoods of the enabled segments
    el = np.flatnonzero(seg[place] < with_deletions[doc])
    del_place = place[el]
    del_key = _keys(band[doc[el]], seg[del_place], content[del_place] - element[el])
    # how often each key occurs around here: what probing it is expected to bring
    everything = np.concatenate([key, del_key])
    _, back, count = np.unique(everything, return_inverse=True, return_counts=True)
    often = count[back]
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], everything), len(common[0]) - 1)
        often = np.where(common[0][at] == everything, np.maximum(often, common[1][at]), often)
    cost = often[: len(key)].astype(float)
    del_cost = np.bincount(del_place, weights=often[len(key):], minlength=len(key)) + 1.0
    need = np.minimum(plan[band, 3], 2 * size * (100 - percent) // (100 + percent)) + 2 * plan[band, 4] - 1
    enabled = np.flatnonzero(seg < with_deletions[seg_doc])
    unit_seg = np.concatenate([np.arange(len(key)), enabled])
    unit_cost = np.concatenate([cost, np.maximum(cost[enabled], del_cost[enabled]) + 1e-6])
    order = np.lexsort((unit_cost, seg_doc[unit_seg]))
    per = np.bincount(seg_doc[unit_seg], minlength=len(m))
    begin = np.zeros(len(m) + 1, np.int64)
    np.cumsum(per, out=begin[1:])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - begin[seg_doc[unit_seg[order]]]
    taken = rank < need[seg_doc[unit_seg]]
    v = np.bincount(unit_seg[taken], minlength=len(key))
    probe, del_probe = v >= 1, v[del_place] >= 2
    keys = np.concatenate([key, del_key])
    docs = np.concatenate([seg_doc, doc[el]])
    flags = np.concatenate([probe, del_probe])
    return (keys, docs, flags) if own else (keys[flags], docs[flags], flags[flags])


SCAN = pa.schema([("kind", pa.int8()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("sketch", pa.binary())])


def count_keys(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, count) of the keys that occur twice or more in a batch of documents, and (null, rows) for all of them."""
    for batch in batches:
        keys = [r.column("x").to_numpy() for r in scan(iter([batch]), size, percent, None) if r.num_rows and r.column("kind")[0].as_py() > 0]
        if not keys:
            continue
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        often = count > 1
        yield pa.record_batch([
            pa.array(np.append(key[often], 0), mask=np.append(np.zeros(often.sum(), bool), True)),
            pa.array(np.append(count[often], count.sum()))], ["key", "count"])


def scan(batches: Iterator[pa.RecordBatch], size: int, percent: int, common) -> Iterator[pa.RecordBatch]:
    """One pass over (doc_id, text): a profile row (0, doc_id, n, digest, sketch) per document, key rows (1 or 2 if probing, key, T, digest)."""
    hasher = tb.Rolling()
    plan = np.array(bands(1 << 34, percent))
    frequent = common and (np.frombuffer(common.value[0], np.uint64), np.frombuffer(common.value[1], np.int64))
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for i, j, _, _ in tb.chunks(text):
            rows, values = sets_of(text.slice(i, j - i), hasher, size)
            n, digest = digest_of(rows, values, j - i)
            sketch = sketches(rows, values, n)
            yield pa.record_batch([
                pa.array(np.zeros(j - i, np.int8)), ids.slice(i, j - i).cast(pa.int64()), pa.array(n), tb.signed(digest),
                pa.array(sketch, pa.binary())], SCAN)
            # equal sets of a chunk probe once; empty sets never
            lead = np.zeros(j - i, bool)
            lead[np.unique(digest, return_index=True)[1]] = True
            lead &= n > 0
            band = np.searchsorted(plan[:, 0], n, "right") - 1
            least = -(-percent * n // 100)
            below = lead & (band > 0) & (least < plan[band, 0])
            for own, chosen in ((True, lead), (False, below)):
                level = band if own else band - 1
                chosen = chosen & (plan[np.maximum(level, 0), 3] > 0)
                docs = np.flatnonzero(chosen)
                if not len(docs):
                    continue
                new = np.full(j - i, -1)
                new[docs] = np.arange(len(docs))
                inside = chosen[rows]
                keys, who, flags = probes(values[inside], new[rows[inside]], n[docs], level[docs], plan, own, percent, frequent)
                yield pa.record_batch([
                    pa.array(flags.astype(np.int8) + np.int8(1)), tb.signed(keys), pa.array(plan[level[docs][who], 4]),
                    tb.signed(digest[docs][who]), pa.nulls(len(keys), pa.binary())], SCAN)


def cells_of(n: np.ndarray) -> np.ndarray:
    """Cells of the sketch of a set of n shingles."""
    return CELLS << np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / ROOMY)).astype(np.int64) + 1)


def sketches(rows: np.ndarray, values: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counts of each set's shingles by the low bits of their hashes, two bytes a cell."""
    width = cells_of(n)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    place = at[rows] + (values % width[rows].astype(np.uint64)).astype(np.int64)
    # a cell holds a few dozen at most, as cells grow with the set
    flat = np.bincount(place, minlength=at[-1]).astype(np.uint16).tobytes()
    return [flat[2 * a: 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def near_sketches(group: pa.Table, percent: int) -> pa.Table:
    """(member, root): the members of a pair of blocks at one key whose sketches allow a link with a probing member or from one."""
    n = group.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, k = n[order], len(order)
    member, block = (group.column(c).to_numpy()[order] for c in ("member", "block"))
    probing = group.column("probing").to_numpy()[order]
    raw = group.column("sketch").to_pylist()
    width = cells_of(n)
    both = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    root = np.arange(k)
    cells, first = None, 0
    for x in range(k):
        if cells is None or cells.shape[1] != width[x]:
            # from here on all have as many cells or more, which fold onto these
            first = x
            cells = np.stack([
                np.frombuffer(raw[order[y]], np.uint16).reshape(-1, width[x]).sum(axis=0, dtype=np.int32) for y in range(x, k)])
        last = int(np.searchsorted(n, 100 * n[x] // percent, "right"))
        y = np.arange(x + 1, last)
        # members connected already need no look
        ok = (root[y] != root[x]) & (probing[y] | probing[x])
        if not both:
            ok &= block[y] != block[x]
        y = y[ok]
        if not len(y):
            continue
        y = y[np.abs(cells[y - first] - cells[x - first]).sum(axis=1) <= (100 - percent) * (n[x] + n[y]) // (100 + percent)]
        if len(y):
            joined = np.unique(np.append(root[y], root[x]))
            root[np.isin(root, joined)] = joined[0]
    out = np.flatnonzero(root != np.arange(k))
    return pa.table([pa.array(member[out]), pa.array(member[root[out]])], names=["a", "b"])


#: The pairs of blocks a member of ``block`` takes part in.
PAIRS = "transform(sequence(0, blocks - 1), b -> struct(least(b, block) AS i, greatest(b, block) AS j))"

UNIT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def compare(group: pa.Table, size: int, percent: int) -> pa.Table:
    """Links inside a pair of blocks: (member, root of its links here, number of links)."""
    hasher = tb.Rolling()
    text = group.column("text").combine_chunks()
    rows, values = sets_of(text, hasher, size)
    n, digest = digest_of(rows, values, len(text))
    wanted = group.column("member").to_numpy().view(np.uint64)
    # a doc_id may stand for several texts; only the one that was asked for counts, once
    lead = np.zeros(len(n), bool)
    lead[np.unique(digest, return_index=True)[1]] = True
    alive = np.flatnonzero(np.isin(digest, wanted) & (n > 0) & lead)
    own = dict(zip(wanted.tolist(), group.column("block").to_pylist(), strict=True))
    block = np.array([own[d] for d in digest[alive].tolist()], np.int64)
    inside = np.isin(rows, alive)
    new = np.zeros(len(n), np.int64)
    new[alive] = np.arange(len(alive))
    rows, values = new[rows[inside]], values[inside]
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    # only shingles in two or more sets can be shared
    column = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    rows, place = rows[keep], column[place[keep]]
    k, width = len(alive), 4096
    both = np.zeros((k, k), np.float64)
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [c, c + width])
        part = np.zeros((k, width), np.float32)
        part[rows[lo:hi], place[lo:hi] - c] = 1
        both += part @ part.T
    sizes = n[alive].astype(np.float64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    if first != second:
        linked &= block[:, None] != block[None, :]
    root = np.arange(k)
    while k:
        low = np.minimum(root, np.where(linked, root[None, :], k).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    degree = linked.sum(axis=1)
    out = np.flatnonzero(degree > 0)
    d = digest[alive]
    return pa.table([tb.signed(d[out]), tb.signed(d[root[out]]), pa.array(degree[out].astype(np.int64))], schema=UNIT)


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per document.

    Documents link when 100 * intersection >= percent * union of their distinct
    ``size``-word shingles; ``n_links`` counts the different sets a document's set links to.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    counted = texts.mapInArrow(partial(count_keys, size=size, percent=percent), "key long, count long").groupBy("key").agg(
        F.sum("count").alias("count"))
    counted = step(counted, "key_counts")
    total_keys = counted.where("key IS NULL").agg(F.sum("count")).first()[0] or 0
    most = max(FREQUENT, total_keys // COMMON)
    # fewer than COMMON rows
    got = counted.where((F.col("key").isNotNull()) & (F.col("count") > most)).toArrow()
    known, often = got["key"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order].tobytes(), often[order].tobytes()))

    rows = step(texts.mapInArrow(
        partial(scan, size=size, percent=percent, common=common), "kind byte, x long, y long, z long, sketch binary"), "shingle_keys")
    profile = step(rows.where("kind = 0").select(
        F.col("x").alias("doc_id"), F.col("y").alias("n"), F.col("z").alias("member"), "sketch"), "shingle_profile")
    keys = rows.where("kind > 0").select(
        F.col("x").alias("key"), F.col("y").alias("meetings"), F.col("z").alias("member"), (F.col("kind") == 2).alias("probing"))

    # a key counts if it has a probing member and another row
    shared = step(keys.groupBy("key").agg(F.count_if("probing").alias("probes"), F.count(F.lit(1)).alias("held")).where(
        "probes > 0 AND held > 1"), "shared_key_counts")
    met = step(keys.join(shared.hint("merge"), "key").distinct(), "shared_keys")
    discard(rows)
    held = profile.groupBy("member").agg(F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    many = met.where(F.col("probes") > FEW).groupBy("key", "member").agg(F.max("probing").alias("probing"), F.max("held").alias("held"))
    many = many.withColumn("blocks", F.ceil(F.col("held") / BLOCK_MEMBERS).cast("int")).join(held, "member")
    many = many.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).select(
        "key", "member", "n", "sketch", "probing", "block", F.explode(F.expr(PAIRS)).alias("p")).select(
        "key", "member", "n", "sketch", "probing", "block", "p.i", "p.j").repartition(partitions(spark), "key", "i", "j")

    def at_key(group: pa.Table) -> pa.Table:
        return near_sketches(group, percent)

    star = many.groupBy("key", "i", "j").applyInArrow(at_key, "a long, b long")
    few = met.where(F.col("probes") <= FEW)
    pairs = few.where("probing").select("key", "meetings", F.col("member").alias("a")).join(few.select("key", F.col("member").alias("b")).distinct().hint("merge"), "key")
    # the keys of one band ask for the same number of meetings
    twice = pairs.where("a <> b").groupBy("a", "b", "meetings").agg(F.count(F.lit(1)).alias("hits")).where("hits >= meetings").select("a", "b")
    clusters = components(star.distinct().unionByName(twice))

    classes = step(profile.where("n > 0").groupBy("member").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
        F.count("doc_id").alias("with_id")), "shingle_sets")
    members = clusters.withColumnRenamed("node", "member").join(classes, "member")
    volume = members.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("count"))
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("count") / BLOCK_MEMBERS)).cast("int")
    members = step(members.join(volume.select("component", blocks.alias("blocks")), "component").select(
        "component", "member", "first_id", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block")), "shingle_clusters")

    # texts without an id are found by a hash of the text instead
    texts = texts.withColumn("ref", F.coalesce("doc_id", F.xxhash64("text")))
    lost = members.where("first_id IS NULL")
    found = members.where("first_id IS NOT NULL").withColumn("ref", F.col("first_id"))
    # texts are dealt by key at any size
    held = texts.where("doc_id IS NOT NULL").join(found.hint("merge"), "ref")
    if lost.head(1):
        anonymous = texts.where("doc_id IS NULL").mapInArrow(
            partial(_with_member, size=size), "text string, member long").dropDuplicates(["member"])
        held = held.select("text", *lost.columns).unionByName(anonymous.join(lost, "member").select("text", *lost.columns))
    units = held.select("component", "member", "block", "text", F.explode(F.expr(PAIRS)).alias("p")).select("component", "member", "block", "text", "p.i", "p.j")
    units = units.repartition(partitions(spark), "component", "i", "j")

    def unit(group: pa.Table) -> pa.Table:
        return compare(group, size, percent)

    links = units.groupBy("component", "i", "j").applyInArrow(unit, "a long, b long, links long")
    links = step(links, "shingle_links")
    linked = components(links.select("a", "b"))
    degree = links.groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("n_links"))

    named = classes.join(linked.withColumnRenamed("node", "member"), "member", "left").join(degree, "member", "left").withColumn(
        "component", F.coalesce("component", "member"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("rows"))
    total = profile.count()
    # components are classes again: a component of a third of all sets is joined by broadcast
    named = step(join_groups(named, lowest, ["component"], "rows", max(1, total)).select(
        "member", "component_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "shingle_components")
    full = join_groups(profile.where("n > 0"), named, ["member"], "copies", max(1, total))
    empty = profile.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(empty)


def _with_member(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hasher = tb.Rolling()
    for batch in batches:
        text = batch.column("text")
        for i, j, _, _ in tb.chunks(text):
            part = text.slice(i, j - i)
            rows, values = sets_of(part, hasher, size)
            _, digest = digest_of(rows, values, j - i)
            yield pa.record_batch([part, tb.signed(digest)], ["text", "member"])


def one_per_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each group that links connect, the smallest doc_id stays.

    Documents without words or without an id stay. Repeated rows count as one.
    """
    groups = jaccard_groups(docs, size, percent)
    kept = step(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept_documents")
    stay = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if kept.where("rows > 1").head(1):
        stay = stay.dropDuplicates(["doc_id"])
    return stay.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
