"""Cross-tokenizer alignment against sets of ends, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import SCHEMA, SF, clashing, empty, odd  # noqa: F401

from barline.llm import tokenizer_alignment as ta


@pytest.fixture(scope="module")
def both():
    """Ids and token bytes of a text by both tokenizers, from their own files."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{ta.FOLDER}/{ta.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.B_FILE}")
    with open(f"{ta.FOLDER}/{ta.A_FILE}") as f:
        names = {i: n for n, i in json.load(f)["model"]["vocab"].items()}
    letters = ta.byte_letters()

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        spell = lambda i: bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return ids_a, [bytes(letters[c] for c in names[i]) for i in ids_a], ids_b, [spell(i) for i in ids_b]

    return tokens


def groups_of(text, both):
    if not text:
        return []
    ids_a, spelled_a, ids_b, spelled_b = both(text)
    if b"".join(spelled_a) != b" " + text.encode() or b"".join(spelled_b) != b" " + text.encode():
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spelled_a, spelled_b)]
    out, common = [], sorted(set(ends[0]) & set(ends[1]))
    for low, high in zip([0, *common], common, strict=False):
        out.append(tuple([i for i, e in zip(ids, own, strict=True) if low < e <= high] for ids, own in zip((ids_a, ids_b), ends, strict=True)))
    return out


def by_hand(rows, both):
    links, held = [], Counter()
    for _, text in rows:
        groups = groups_of(text, both)
        own = Counter((x, y) for a, b in groups for x in a for y in b)
        held.update(own.keys())
        links.append((groups, own))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), (groups, own) in zip(rows, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
            sum(n for p, n in own.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in own.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def check(docs, both):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in ta.alignment(docs).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows, both), key=repr)


TEXTS = [
    "▁ is the sign itself", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト、長い文。" * 20, "🙂🙃 mixed 👩‍👩‍👧 text", "x" * 3000, "ab" * 500 + " end",
    "  two  spaces ", "\ttab\r\n", "1234567890 3.14159 1e-9", "ﬁ ligature ① full　width", "\x00\x01", " ", "a", "Źalgo", "ſt " * 40, "- " * 300]


def test_alignment_of_odd_rows(spark, odd, clashing, both, monkeypatch):
    more = spark.createDataFrame([(900 + i, t, None, None, None) for i, t in enumerate(TEXTS)], SCHEMA)
    check(odd.unionByName(more).unionByName(clashing.limit(9), allowMissingColumns=True), both)


def test_alignment_of_documents(spark, both):
    check(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), both)


def test_no_rows(empty):
    assert ta.alignment(empty).collect() == []


def test_linked_ids_and_token_groups(spark, both):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*TEXTS, None, "a cat", "a cat"])], SCHEMA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for _, text in rows:
        want.update({(x, y) for a, b in groups_of(text, both) for x in a for y in b})
    assert {(r.a, r.b): r["count"] for r in ta.linked_ids(docs).collect()} == want
    for r in ta.token_groups(docs).collect():
        cut = lambda ids, ends: [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        assert list(zip(cut(r.a, r.a_ends), cut(r.b, r.b_ends), strict=True)) == groups_of(dict(rows)[r.doc_id], both)


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    rows = docs.select("doc_id", "text").toArrow().to_batches()[0]
    class Context:
        partitionId = staticmethod(lambda: 3)
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Context)
    whole = list(ta.read_blocks(iter([rows]), ta.FOLDER, ta.A_FILE, ta.B_FILE))
    monkeypatch.setattr(ta, "BLOCK", 1)
    monkeypatch.setattr(ta.pieces, "__defaults__", (2000,))
    small = list(ta.read_blocks(iter([rows]), ta.FOLDER, ta.A_FILE, ta.B_FILE))
    assert len(small) > len(whole)

    def docs_of(blocks):
        for block in blocks:
            b = block.to_pylist()[0]
            for d in b["docs"]:
                d["places"] = [b["pairs"][i] for i in d["places"]]
                yield d

    assert list(docs_of(small)) == list(docs_of(whole))


@pytest.mark.parametrize("seed", range(30))
def test_runs_are_skipped_right(seed):
    rng = random.Random(seed)
    end = rng.choice([1, 5, 60, 900])
    ends = [sorted({rng.randint(1, end) for _ in range(rng.choice([0, 3, end // 2, 3 * end]))} | {end}) for _ in range(2)]
    if seed % 3 == 0:  # long stretches of one-to-one tokens
        shared = set(range(1, end))
        ends = [sorted((shared - {rng.randint(1, end) for _ in range(4)}) | {end}) for _ in range(2)]
    got = ta.irregular(*[np.array(e) for e in ends]).tolist()
    common, want, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for x in common:
        k, m = ends[0].index(x) + 1, ends[1].index(x) + 1
        if (k - i, m - j) != (1, 1):
            want.append([i, k, j, m])
        i, j = k, m
    assert got == want


def test_no_row_holds_a_block(spark, both, monkeypatch):
    """Rows of the written tables are documents or some pairs, however much text a block has."""
    from barline.llm import tokenizer_alignment as ta

    monkeypatch.setattr(ta, "RUN", 16)
    texts = ["word%d and other%d words go on, %d times" % (i, i * 7, i) for i in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, "")], "doc_id long, text string").repartition(2)
    blocks = ta.blocks_of(docs)
    sizes = blocks.selectExpr("size(pairs) AS pairs", "doc.doc_id AS doc_id", "block").collect()
    assert max(r.pairs for r in sizes if r.doc_id is None) <= 16
    assert sorted(r.doc_id for r in sizes if r.doc_id is not None) == [*range(120), 500, 501] and len({r.block for r in sizes}) <= 2
    check(docs, both)
