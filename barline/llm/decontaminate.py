"""Benchmark decontamination: pigeonhole pieces found exactly, verified by edit distance.

Texts are compared lower-cased (A-Z) with runs of white space as one space. An item of m
characters may occur with up to k = m * RATE edits. It is split into k + 1 pieces, one of
which must occur unchanged; all pieces of a block of items are found in one pass over a text
(Aho-Corasick), and the place each hit points at is checked with Myers' bit-parallel
distance. Items come in blocks of at most ``BLOCK`` characters: a block's automaton is all
that is ever sent to the tasks, and the blocks are passed one after another without a shuffle.

Defined cases: a null or empty text holds no item; items without a word are left out, a null
item_id is reported as null; repeated rows and items are reported alike; an empty table of
items finds nothing; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from barline.llm.common import free

#: Edits allowed per character of an item.
RATE = 0.05
#: Characters of items in one automaton.
BLOCK = 1 << 20

_SPACES = {c: " " for c in range(0x09, 0x0E)}
_FOLD = {c: chr(c + 32) for c in range(65, 91)} | _SPACES

HITS = ArrayType(StructType([
    StructField("item_id", LongType()), StructField("start", LongType()), StructField("end", LongType()), StructField("distance", LongType())]))


def normalise(text: str | None) -> str:
    return " ".join(w for w in (text or "").translate(_FOLD).split(" ") if w)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of almost equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any substring, end of the first such substring)."""
    m = len(pattern)
    match: dict[str, int] = {}
    for i, c in enumerate(pattern):
        match[c] = match.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = match.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(x | plus) & full
        down = plus & x
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 & full
        plus = down << 1 & full | ~(x | up) & full
        minus = up & x
        if score < best:
            best, end = score, j
    return best, end


def locate(item: str, text: str, k: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the best occurrence of ``item`` in ``text`` with at most k edits."""
    distance, end = myers(item, text)
    if distance > k:
        return None
    back, length = myers(item[::-1], text[:end][::-1])
    return end - length, end, min(distance, back)


def finder(items: list[tuple[int | None, str]], rate: float) -> Callable[[str], list[tuple]]:
    """A function that lists (item_id, start, end, distance) of the items in a normalised text."""
    where: dict[str, list[tuple[int, int]]] = {}
    budget = [int(len(t) * rate) for _, t in items]
    for n, (_, t) in enumerate(items):
        for offset, piece in pieces(t, budget[n]):
            where.setdefault(piece, []).append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, at in where.items():
        automaton.add_word(piece, (len(piece), at))
    if where:
        automaton.make_automaton()

    def find(text: str) -> list[tuple]:
        out: dict[tuple[int, int], tuple] = {}
        checked: dict[int, list[tuple[int, int]]] = {}
        for last, (size, at) in automaton.iter(text) if where else ():
            for n, offset in at:
                item_id, item = items[n]
                k = budget[n]
                begin = last + 1 - size - offset
                lo, hi = max(0, begin - k), min(len(text), begin + len(item) + k)
                # a hit that points at a place already checked says nothing new
                if any(a <= lo and hi <= b for a, b in checked.get(n, ())[-4:]):
                    continue
                lo, hi = max(0, lo - k), min(len(text), hi + k)
                checked.setdefault(n, []).append((lo, hi))
                found = locate(item, text[lo:hi], k)
                if found:
                    start, end, distance = lo + found[0], lo + found[1], found[2]
                    out.setdefault((n, start), (item_id, start, end, distance))
        return sorted(out.values(), key=lambda x: (x[1], x[2], x[0] is None, x[0] or 0))

    return find


def scan(batches: Iterator[pa.RecordBatch], items: list[tuple[int | None, str]], rate: float, at: int, hits_at: int) -> Iterator[pa.RecordBatch]:
    """Appends the hits of these items to the column ``hits_at``, reading the text in column ``at``."""
    find = finder(items, rate)
    for batch in batches:
        before = batch.column(hits_at).to_pylist()
        after = []
        for old, text in zip(before, batch.column(at), strict=True):
            new = [dict(zip(("item_id", "start", "end", "distance"), x, strict=True)) for x in find(normalise(text.as_py()))]
            after.append((old or []) + new)
        columns = list(batch.columns)
        columns[hits_at] = pa.array(after, batch.schema.field(hits_at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK, name: str = "hits") -> DataFrame:
    """``docs`` with a column ``name``: list of (item_id, start, end, distance), places in the normalised text."""
    at, width = docs.columns.index("text"), len(docs.columns)
    docs = docs.withColumn(name, F.array().cast(HITS))
    kept = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block)
    for b in range(blocks):
        own = kept.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).distinct().collect()
        own = sorted(((r.item_id, normalise(r.text)) for r in own), key=lambda x: (x[1], x[0] is None, x[0] or 0))
        own = [x for x in own if x[1]]
        docs = docs.mapInArrow(partial(scan, items=own, rate=rate, at=at, hits_at=width), docs.schema)
    return docs


def contamination(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, contaminated, item_ids, least_distance), one row per document."""
    found = find_items(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, rate)
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"),
        F.array_min("hits.distance").alias("least_distance"))


def clean_of(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold none of the items."""
    name = free(docs, "hits")
    return find_items(docs, items, rate, name=name).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
