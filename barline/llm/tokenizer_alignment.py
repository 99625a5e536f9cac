"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is encoded by a byte-level BPE (A) and a sentence-piece model (B), and the byte
offsets where tokens of both end cut the tokens into groups. The two arrays of ends are
walked by diagonal runs: from a common end on, ends at the current shift between the arrays
are compared in slices of doubling length, so that a stretch of one-to-one tokens is passed
in a few comparisons; where it breaks off, the group is settled end by end up to the next
common end, which sets the new shift.

Every pair of an A id and a B id in a group is linked. A pair counts in how many documents
it is linked. Documents are worked on in blocks of ``BLOCK`` bytes: a block holds its
distinct pairs once and each document's pairs as places among them, so what is shuffled are
a block's pairs and not the documents'. Counts of pairs are summed over blocks, joined back
to the blocks' pairs and read by the documents of the block. No row holds a block: pairs and
documents are rows of a written table, which meet sorted by block, so a task holds the
counts of one block at a time, whatever it is dealt. Occurrence pairs of a group are never
listed: a group's ids are counted first.

Defined cases: a text that is null or empty, or whose tokens do not spell it, has no tokens,
zeros and an empty digest column; strings of special tokens in a text are text; null and
repeated doc_ids are rows like others; equal counts of an A id are all highest; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import textbytes as tb
from barline.llm.common import discard, partitions, step

#: Folder of the tokenizer files; every executor must have it.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and bytes encoded at once.
BLOCK, PIECE = 1 << 22, 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 as it is, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Encoder of lists of texts and the bytes of each id."""

    def __init__(self, spelled: list[bytes]):
        self.bytes = spelled
        self.size = np.array([len(x) for x in spelled], np.int64)


#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel(Vocabulary):
    """Texts after a space, by a byte-level BPE.

    Merges apply in the order of the file; ids ascend in that order, so an encoder that
    merges by least id gives the same tokens as the library the file is made for, and faster.
    Special tokens are no part of it: their strings in a text are text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        letters = byte_letters()
        names = content["model"]["vocab"]
        special = {t["content"] for t in content["added_tokens"] if t["special"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"])
        order = [names["".join(m)] for m in pairs]
        if order != sorted(order):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        spelled = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelled[i] = bytes(letters[c] for c in name)
        super().__init__(spelled)
        ranks = {spelled[i]: i for name, i in names.items() if name not in special}
        self.model = tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class Pieces(Vocabulary):
    """Texts by a sentence-piece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = ((self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size()))
        super().__init__([bytes([int(p[3:-1], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def vocabularies(folder: str, a_file: str, b_file: str) -> tuple[Vocabulary, Vocabulary]:
    """Read once per worker."""
    return ByteLevel(f"{folder}/{a_file}"), Pieces(f"{folder}/{b_file}")


def irregular(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(first a, end a, first b, end b) of the groups that are not one to one.

    ``a`` and ``b`` are ascending ends of tokens and end alike.
    """
    a, b = a.astype(np.int64), b.astype(np.int64)
    raw_a, raw_b, list_a, list_b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    n, i, j, out = len(list_a), 0, 0, []
    while i < n:
        width = 1
        while list_a[i] == list_b[j]:
            # slices at this shift, twice as long each time; a cut one at the end is equal only if both end there
            if raw_a[8 * i: 8 * (i + width)] == raw_b[8 * j: 8 * (j + width)]:
                i, j, width = i + width, j + width, 2 * width
                if i >= n:
                    return np.array(out, np.int64).reshape(-1, 4)
            else:
                while width > 1:
                    width >>= 1
                    if raw_a[8 * i: 8 * (i + width)] == raw_b[8 * j: 8 * (j + width)]:
                        i, j = i + width, j + width
                break
        start_a, start_b = i, j
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        i, j = i + 1, j + 1
        out.extend((start_a, i, start_b, j))
    return np.array(out, np.int64).reshape(-1, 4)


def last_of_group(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` tokens ends a group; tokens outside [first, end) are groups of their own."""
    out = np.ones(n, bool)
    size = end - first - 1
    inner = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[inner] = False
    return out


class Aligned:
    """The tokens of some texts by both vocabularies and their groups.

    Only texts that both spell right are here; ``rows`` has their places in the list given.
    ``a_at`` and ``b_at`` are the texts' first tokens and the end, ``group_at`` their groups.
    """

    def __init__(self, texts: list[str | None], va: Vocabulary, vb: Vocabulary):
        rows = [i for i, t in enumerate(texts) if t]
        a = va.encode([texts[i] for i in rows])
        b = vb.encode([texts[i] for i in rows])
        good = []
        for k, i in enumerate(rows):
            spelled = b" " + texts[i].encode()
            if b"".join([va.bytes[x] for x in a[k]]) == spelled and b"".join([vb.bytes[x] for x in b[k]]) == spelled:
                good.append(k)
        self.rows = np.array([rows[k] for k in good], np.int64)
        self.a, self.a_at = self._flat([a[k] for k in good])
        self.b, self.b_at = self._flat([b[k] for k in good])
        groups = irregular(np.cumsum(va.size[self.a]), np.cumsum(vb.size[self.b]))
        self.a_last = last_of_group(len(self.a), groups[:, 0], groups[:, 1])
        self.b_last = last_of_group(len(self.b), groups[:, 2], groups[:, 3])
        self.a_group = np.cumsum(self.a_last) - self.a_last
        self.b_group = np.cumsum(self.b_last) - self.b_last
        self.a_size = np.bincount(self.a_group, minlength=0)
        self.b_size = np.bincount(self.b_group, minlength=0)
        self.group_at = np.append(0, np.cumsum(self.a_last))[self.a_at]
        self.vocabulary_b = len(vb.bytes)

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.cumsum([0, *map(len, lists)])
        return np.fromiter(chain.from_iterable(lists), np.int64, int(at[-1])), at

    def links(self) -> np.ndarray:
        """Linked occurrence pairs of each text."""
        run = np.append(0, np.cumsum(self.a_size * self.b_size))
        return np.diff(run[self.group_at])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, pair) in order, and how many occurrence pairs each stands for; a pair is a * |B| + b."""
        text = np.repeat(np.arange(len(self.rows)), np.diff(self.group_at))
        one = (self.a_size == 1) & (self.b_size == 1)
        plain_a, plain_b = one[self.a_group], one[self.b_group]
        keys = [(text[self.a_group[plain_a]] << 40) + self.a[plain_a] * self.vocabulary_b + self.b[plain_b]]
        # other groups: their distinct ids with counts, then the products
        ids, times, group = [], [], []
        for own, at, plain in ((self.a, self.a_group, plain_a), (self.b, self.b_group, plain_b)):
            distinct, n = np.unique((at[~plain] << 24) + own[~plain], return_counts=True)
            ids.append(distinct & ((1 << 24) - 1))
            group.append(distinct >> 24)
            times.append(n)
        first = np.searchsorted(group[1], group[0])
        many = np.searchsorted(group[1], group[0], "right") - first
        left = np.repeat(np.arange(len(ids[0])), many)
        right = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        more = (text[group[0][left]] << 40) + ids[0][left] * self.vocabulary_b + ids[1][right]
        weight = times[0][left] * times[1][right]
        key, n = np.unique(np.concatenate([*keys, more]), return_counts=True)
        above = weight > 1
        np.add.at(n, np.searchsorted(key, more[above]), weight[above] - 1)
        return key >> 40, key & ((1 << 40) - 1), n

    def digests(self, digits: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3``."""
        table, size = digits
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        sign = np.empty(len(ids), np.uint8)
        b_before = np.cumsum(self.b_size) - self.b_size
        a_place = np.arange(len(self.a)) + b_before[self.a_group]
        b_place = np.arange(len(self.b)) + np.cumsum(self.a_size)[self.b_group]
        ids[a_place], ids[b_place] = self.a, self.b
        sign[a_place] = np.where(self.a_last, ord("|"), ord(","))
        sign[b_place] = np.where(self.b_last, ord(";"), ord(","))
        rows, length = table[ids], size[ids]
        rows[np.arange(len(ids)), length] = sign
        flat = rows[np.arange(table.shape[1]) <= length[:, None]].tobytes()
        at = np.append(0, np.cumsum(length + 1))[self.a_at + self.b_at].tolist()
        return [hashlib.sha256(flat[i: j - 1]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1 in rows with one place to spare, and their lengths."""
    width = len(str(n)) + 1
    return (np.frombuffer("".join(str(i).ljust(width) for i in range(n)).encode(), np.uint8).reshape(n, width).copy(),
            np.array([len(str(i)) for i in range(n)]))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, list[str | None], int]]:
    """(first row, texts, bytes) of runs of rows holding about ``limit`` bytes."""
    for i, j, data, _ in tb.chunks(texts, limit):
        yield i, texts.slice(i, j - i).to_pylist(), len(data)


DOC = pa.struct([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("docs", pa.list_(DOC))])
#: A row is a document of a block, or (``doc`` null) some of the block's pairs, from place ``first`` on.
ROW_SCHEMA = pa.schema([("block", pa.int64()), ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())), ("doc", DOC)])
ROW_TYPE = ("block long, first int, pairs array<long>, held array<int>, doc struct<doc_id:long,n_a:long,n_b:long,n_groups:long,"
            "n_links:long,groups_sha256:string,places:array<int>,times:array<int>>")
#: Pairs of a row.
RUN = 1 << 12


class Block:
    """Documents of one block while they are read."""

    def __init__(self):
        self.columns: list[list[np.ndarray]] = []
        self.digests: list[str] = []
        self.ids: list[pa.Array] = []
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str | None], va: Vocabulary, vb: Vocabulary, size: int) -> None:
        x = Aligned(texts, va, vb)
        text, pair, times = x.pairs()
        whole = np.zeros((5, len(texts)), np.int64)
        for row, values in enumerate((np.diff(x.a_at), np.diff(x.b_at), np.diff(x.group_at), x.links(), np.bincount(text, minlength=len(x.rows)))):
            whole[row, x.rows] = values
        digests = [""] * len(texts)
        for i, d in zip(x.rows.tolist(), x.digests(decimal_table(max(len(va.bytes), len(vb.bytes)))), strict=True):
            digests[i] = d
        self.columns.append([*whole, pair, times])
        self.digests += digests
        self.ids.append(ids)
        self.bytes += size

    def batch(self, number: int) -> pa.RecordBatch:
        n_a, n_b, n_groups, n_links, n_pairs, pair, times = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        at = pa.array(np.append(0, np.cumsum(n_pairs)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (place, times)]
        docs = pa.StructArray.from_arrays(
            [pa.concat_arrays(self.ids), *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(self.digests, pa.string()), *lists], fields=list(DOC))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(pa.array(pairs)), one(pa.array(held.astype(np.int32))), one(docs)], schema=BLOCK_SCHEMA)


def read_blocks(batches: Iterator[pa.RecordBatch], folder: str, a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text) rows, numbered by partition and order."""
    from pyspark import TaskContext

    va, vb = vocabularies(folder, a_file, b_file)
    number, block = TaskContext.get().partitionId() << 32, Block()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, part, size in pieces(texts):
            block.add(ids.slice(i, len(part)), part, va, vb, size)
            if block.bytes >= BLOCK:
                yield block.batch(number)
                number, block = number + 1, Block()
    if block.ids:
        yield block.batch(number)


def block_rows(batches: Iterator[pa.RecordBatch], folder: str, a_file: str, b_file: str, run: int) -> Iterator[pa.RecordBatch]:
    """``read_blocks`` as rows of single documents and of ``run`` pairs, so that no row holds a block."""
    for block in read_blocks(batches, folder, a_file, b_file):
        number = block.column(0)[0].as_py()
        pairs, held, docs = (block.column(c).flatten() for c in (1, 2, 3))
        first = np.arange(0, len(pairs), run)
        n = len(first)
        if n:
            at = pa.array(np.append(first, len(pairs)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), pa.array(first.astype(np.int32)), pa.ListArray.from_arrays(at, pairs), pa.ListArray.from_arrays(at, held),
                pa.nulls(n, DOC)], schema=ROW_SCHEMA)
        for i in range(0, len(docs), run):
            part = docs.slice(i, run)
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), *[pa.nulls(n, ROW_SCHEMA.field(c).type) for c in ("first", "pairs", "held")], part], schema=ROW_SCHEMA)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def read_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of (key, place, count, best, doc) rows sorted by key: the counts of a block's pairs in any order, then its documents.

    The key is twice the block's number, and one more for documents.
    """
    block, parts = None, []
    count, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = batch.column(0).to_numpy()
        starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            rows = batch.slice(i, j - i)
            if keys[i] >> 1 != block:
                block, parts = keys[i] >> 1, []
            if not keys[i] & 1:
                parts.append([rows.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)])
                continue
            if parts:
                place, counts, bests = (np.concatenate(c) for c in zip(*parts, strict=True))
                count, best = np.zeros((2, len(place)), np.int64)
                count[place], best[place] = counts, bests
                parts = []
            docs = rows.column(4)
            places, times = docs.field("places"), docs.field("times").flatten().to_numpy()
            at = places.flatten().to_numpy()
            owner = np.repeat(np.arange(len(docs)), np.diff(places.offsets.to_numpy()))
            sums = []
            for value in (best, count):
                out = np.zeros(len(docs), np.int64)
                np.add.at(out, owner, times * value[at])
                sums.append(pa.array(out))
            columns = {c: docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            columns |= {"n_best": sums[0], "count_sum": sums[1]}
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def blocks_of(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The documents in blocks, with the blocks' distinct pairs and in how many of their documents each is linked."""
    work = partial(block_rows, folder=folder, a_file=a_file, b_file=b_file, run=RUN)
    return step(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ROW_TYPE), "blocks")


def met_pairs(blocks: DataFrame) -> DataFrame:
    return blocks.where("doc IS NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select(
        "block", (F.col("first") + F.col("at")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))


def pair_counts(met: DataFrame, vocabulary_b: int) -> DataFrame:
    """(pair, a, b, count, best): documents that link the pair, and whether no other pair of the A id has more."""
    per = met.groupBy("pair").agg(F.sum("held").cast("long").alias("count"))
    per = step(per.withColumn("a", F.floor(F.col("pair") / vocabulary_b)).withColumn("b", F.col("pair") % vocabulary_b), "pairs")
    most = per.groupBy("a").agg(F.max("count").alias("most"))
    return per.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def linked_ids(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(a, b, count, best) of all linked ids of both vocabularies, over all documents."""
    size = len(vocabularies(folder, a_file, b_file)[1].bytes)
    return pair_counts(met_pairs(blocks_of(docs, folder, a_file, b_file)), size).drop("pair")


def alignment(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    size = len(vocabularies(folder, a_file, b_file)[1].bytes)
    blocks = blocks_of(docs, folder, a_file, b_file)
    met = met_pairs(blocks)
    counts = step(pair_counts(met, size).select("pair", "count", "best"), "pair_counts")
    kind = ROW_TYPE[ROW_TYPE.index("struct<"):]
    back = met.join(counts, "pair").select(
        (F.col("block") * 2).alias("key"), "place", "count", "best", F.lit(None).cast(kind).alias("doc"))
    given = back.unionByName(blocks.where("doc IS NOT NULL").select((F.col("block") * 2 + 1).alias("key"), "doc"), allowMissingColumns=True)
    # sorted rows are read one block after the other
    given = given.repartition(partitions(docs.sparkSession), F.shiftright("key", 1)).sortWithinPartitions("key")
    out = step(given.mapInArrow(read_counts, OUT), "aligned")
    discard(blocks)
    return out


def token_groups(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, a, b, a_ends, b_ends): the tokens of both vocabularies and the token numbers at which groups end."""
    work = partial(read_groups, folder=folder, a_file=a_file, b_file=b_file)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def read_groups(batches: Iterator[pa.RecordBatch], folder: str, a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    va, vb = vocabularies(folder, a_file, b_file)
    for batch in batches:
        for i, texts, _ in pieces(batch.column(1)):
            x = Aligned(texts, va, vb)
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] * len(texts) for _ in range(4)]
            for k, row in enumerate(x.rows.tolist()):
                for c, (own, last, at) in enumerate(((x.a, x.a_last, x.a_at), (x.b, x.b_last, x.b_at))):
                    part = slice(at[k], at[k + 1])
                    columns[c][row] = own[part]
                    columns[c + 2][row] = np.flatnonzero(last[part]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, len(texts)), *[pa.array(c, pa.list_(pa.int32())) for c in columns]], names=["doc_id", "a", "b", "a_ends", "b_ends"])
