"""Exact copies, repeated strings, near copies and near lines against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import against_sql, clashing, empty, odd, plain, prose  # noqa: F401

from barline.llm import jaccard, line_dedup, queries, suffix_dedup
from barline.llm import textbytes as tb
from barline.llm.common import components, identified
from barline.llm.exact_dedup import DigestIndex, digests, exact_dedup


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_exact_dedup_equals_sql(odd, against_sql):
    # rows with an id and without repeats have an SQL form; the others follow below
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got, want = against_sql(exact_dedup(docs), queries.ORACLES["op1_exact_dedup"], documents=docs)
    assert got == want


def test_exact_dedup_keeps_one_of_each_text(odd, empty):
    rows = exact_dedup(odd, batches=3).collect()
    assert len(rows) == odd.count()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text_sha256, []).append(r)
    for group in by_text.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)}
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
    assert exact_dedup(empty).count() == 0


def test_digest_index_outlives_batches(spark, odd):
    index = DigestIndex(spark)
    index.append(digests(odd.where("doc_id >= 20")))
    n = index.read().count()
    again = DigestIndex(spark, index.name, index.path, index.buckets)
    again.append(digests(odd.where("doc_id >= 20")))
    assert again.read().count() == n
    again.append(digests(odd))
    assert again.read().count() == again.read().select("digest").distinct().count() > n


def test_later_batches_of_known_texts_are_not_kept(spark):
    index = DigestIndex(spark)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    assert all(r.kept for r in exact_dedup(docs, index).collect())
    again = docs.selectExpr("doc_id + 100 AS doc_id", "text")
    assert not any(r.kept for r in exact_dedup(again, index).collect())


def test_lyndon_grouping_sorts_suffixes():
    rng = random.Random(3)
    for n in range(400):
        text = [rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randint(0, 30))]
        text = (text[:4] * 9)[:25] if n % 3 == 0 else text
        assert suffix_dedup.lyndon_grouping(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_equals_brute_force(odd, hot):
    length = 100
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, length, with_text=True, hot=hot).collect()}
    seen = set()
    for doc_id, text in sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect()):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if text[p: p + length] in seen:
                gone[p: p + length] = b"\1" * length
            seen.add(text[p: p + length])
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        r = got.pop(doc_id)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(r.kept) == kept
    assert not got


def test_only_fragments_that_agree_are_sorted(monkeypatch):
    """Fragments that share little more than their anchor cost no suffix array; those that share a string give its spans."""
    rng = np.random.default_rng(3)
    hasher = tb.Rolling()
    fill = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()

    def rows(texts):
        out = []
        for doc, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            _, start, count, anchor, _ = suffix_dedup.fragments(data, np.array([0, len(data)]), hasher, 100)
            for s, c, a in zip(start.tolist(), count.tolist(), anchor.view(np.int64).tolist(), strict=True):
                out.append((a, doc, int(suffix_dedup.pack(0, c, s)), text[s: s + c + 99]))
        return sorted(out)

    def covered(found, size):
        batches = [pa.record_batch([pa.array(c) for c in zip(*found[i: i + size], strict=True)], names=["anchor", "doc", "place", "bytes"])
                   for i in range(0, len(found), size)]
        spans = {}
        for b in suffix_dedup.sort_fragments(iter(batches), 100):
            for d, _, s, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans.setdefault(d, set()).update(range(s, e))
        return spans

    asked = []
    grouping = suffix_dedup.lyndon_grouping
    monkeypatch.setattr(suffix_dedup, "lyndon_grouping", lambda text: asked.append(len(text)) or grouping(text))
    phrase = fill(60)
    found = rows([fill(200) + phrase + fill(200) for _ in range(40)])
    assert len({a for a, *_ in found}) < len(found)
    assert covered(found, 1000) == {} and not asked
    # an edit every 130 bytes leaves strings of 100 bytes and more between
    whole = fill(600)
    edited = b"".join(whole[i: i + 130] + b"#" for i in range(0, 600, 131))
    texts = [fill(90) + whole + fill(90), fill(50) + edited + fill(50)]
    seen = {texts[0][i: i + 100] for i in range(len(texts[0]) - 99)}
    want = {j for i in range(len(texts[1]) - 99) if texts[1][i: i + 100] in seen for j in range(i, i + 100)}
    found = rows(texts)
    several = {a for a, *_ in found if len({f[3] for f in found if f[0] == a}) > 1}
    equal = {(f[0], f[3]) for f in found if f[1] == 0}
    settled = {j for f in found if f[1] == 1 and (f[0], f[3]) in equal for j in range(f[2] & ((1 << 40) - 1), (f[2] & ((1 << 40) - 1)) + len(f[3]))}
    for limit in (1 << 16, 40):
        monkeypatch.setattr(suffix_dedup, "TOKENS", limit)
        for size in (1, 7, 1000):
            assert covered([f for f in found if f[0] in several], size).get(1, set()) | settled == want
    assert asked and want


def unnamed(spark):
    """Rows without an id, or with one id for many texts; half of the rows share a passage and a line."""
    rng = random.Random(4)
    passage, line = " ".join(prose(rng, 40)), " ".join(prose(rng, 12))
    rows = []
    for i in range(900):
        text = " ".join(prose(rng, rng.randint(30, 60)))
        if i % 2:
            text = f"{text} {passage} {' '.join(prose(rng, 5))}\n{line}\nend {i}"
        rows.append((None if i % 3 else 7 if i % 6 else i, text))
    rows += rows[:5] + [(None, rows[1][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_suffix_dedup_of_rows_without_ids(spark):
    docs = unnamed(spark)
    order = sorted({(r.doc, r.text.encode()) for r in identified(docs, "doc").select("doc", "text").collect()})
    seen, want = set(), {}
    for _, text in order:
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p: p + 100] in seen:
                gone[p: p + 100] = b"\1" * 100
            seen.add(text[p: p + 100])
        want[hashlib.sha256(text).hexdigest()] = (sum(gone), bytes(c for c, g in zip(text, gone, strict=True) if not g))
    rows = suffix_dedup.suffix_dedup(docs, with_text=True).collect()
    assert len(rows) == docs.count()
    assert sorted((r.n_removed, bytes(r.kept)) for r in rows) == sorted(want[hashlib.sha256(r.text.encode()).hexdigest()] for r in docs.collect())
    assert sum(r.n_removed > 0 for r in rows) > 400


def test_line_dedup_of_rows_without_ids(spark):
    docs = unnamed(spark)
    named = {r.text: r.doc for r in identified(docs, "doc").select("doc", "text").collect()}
    # the shared line stays in the first document only; nothing else is near another line
    with_line = [t for t in named if "\n" in t]
    first = min(with_line, key=named.get)
    line = first.split("\n")[1]
    want = sorted(t if t == first or t not in with_line else t.replace(f"\n{line}", "") for t in (r.text for r in docs.collect()))
    assert sorted(r.text for r in line_dedup.line_dedup(docs).collect()) == want


def test_suffix_dedup_with_nulls_and_repeats(odd, empty):
    rows = suffix_dedup.suffix_dedup(odd).collect()
    assert len(rows) == odd.count()
    # repeated rows are not earlier than each other: both lose what an earlier document holds, alike
    assert len({(r.n_removed, r.kept_sha256) for r in rows if r.doc_id == 53}) == 1
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize(("size", "percent", "few"), [(3, 90, 32), (5, 80, 0), (1, 50, 2)])
def test_jaccard_groups_equal_brute_force(odd, plain, size, percent, few, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in jaccard.jaccard_groups(odd, size, percent).collect()), key=repr)

    def shingles(text):
        w = plain(text)
        return frozenset(tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in docs]
    kinds = sorted({s for s in sets if s}, key=sorted)
    union, degree = Union(), [0] * len(kinds)
    for i, a in enumerate(kinds):
        union.find(i)
        for j in range(i):
            if 100 * len(a & kinds[j]) >= percent * len(a | kinds[j]):
                union.join(i, j)
                degree[i] += 1
                degree[j] += 1
    place = {s: i for i, s in enumerate(kinds)}
    lowest = {}
    for (doc_id, _), s in zip(docs, sets, strict=True):
        if s and doc_id is not None:
            root = union.find(place[s])
            lowest[root] = min(lowest.get(root, doc_id), doc_id)
    want = [(d, len(s), lowest.get(union.find(place[s])) if s else d, degree[place[s]] if s else 0) for (d, _), s in zip(docs, sets, strict=True)]
    assert got == sorted(want, key=repr)


def test_jaccard_probes_lose_no_link():
    """Any two linked sets share two keys, one of them probed by the larger."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        plan = np.array(jaccard.bands(1 << 20, percent))
        for _ in range(60):
            n = int(rng.integers(12, 400))
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            # as many elements changed as a link allows
            most = jaccard.largest_difference(len(a), len(a), percent) // 2
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[most:]], rng.integers(1, 1 << 62, most).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < percent * (len(a) + len(b) - inter):
                continue
            large, small = (a, b) if len(a) >= len(b) else (b, a)
            band = np.searchsorted(plan[:, 0], len(small), "right") - 1
            role = np.array([band])
            zero = np.zeros(1, np.int64)
            index = jaccard.probes(small, zero.repeat(len(small)), np.array([len(small)]), role, plan, True, percent)[0]
            own = np.searchsorted(plan[:, 0], len(large), "right") - 1 == band
            keys, _, flags = jaccard.probes(large, zero.repeat(len(large)), np.array([len(large)]), role, plan, bool(own), percent)
            assert len(np.intersect1d(keys[flags], index)) + len(np.intersect1d(keys, index)) >= 2


def test_one_per_group_keeps_columns_and_one_document(clashing, empty):
    kept = jaccard.one_per_group(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(clashing).where("doc_id IS NOT NULL").collect()}
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert sorted(ids) == sorted(set(groups.values()))
    assert jaccard.one_per_group(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((40, 25), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(9)]
        union = Union()
        for a, b in edges:
            union.join(a, b)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: union.find(x) for e in edges if e[0] != e[1] for x in e}


def test_banded_distance():
    rng = random.Random(4)
    for t in (1, 2, 3):
        pairs = []
        while len(pairs) < 400:
            a = bytes(rng.choice(b"abc") for _ in range(rng.randint(t + 1, 18)))
            b = bytearray(a)
            for _ in range(rng.randint(0, t + 1)):
                k = rng.randrange(len(b) + 1)
                b[k: k + rng.randint(0, 1)] = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 1)))
            a, b = sorted((a, bytes(b)), key=len)
            if t < len(a) and len(b) - len(a) <= t:
                pairs.append((a, b))
        width = max(len(b) for _, b in pairs)
        pad = lambda rows: np.array([list(r) + [0] * (width - len(r)) for r in rows], np.uint8)
        one, two = zip(*pairs, strict=True)
        got = line_dedup.near(pad(one), pad(two), np.array([*map(len, one)]), np.array([*map(len, two)]), t)
        for a, b, d in zip(one, two, got.tolist(), strict=True):
            want = edit_distance(a, b)
            assert d == want if want <= t else d > t


def test_line_dedup_equals_brute_force(odd):
    white = b" \t\n\r\x0b\x0c"
    docs = sorted(((r.doc_id, (r.text or "").encode()) for r in odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()))
    got = {r.doc_id: r for r in line_dedup.line_dedup(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    where = {}
    for doc_id, text in docs:
        for n, line in enumerate(text.split(b"\n") if text else []):
            if len(line.strip(white)) >= line_dedup.MIN_BYTES:
                where.setdefault(line.strip(white), []).append((doc_id, n))
    kinds, union = sorted(where, key=lambda x: (len(x), x)), Union()
    for i, a in enumerate(kinds):
        union.find(i)
        t = min(len(a) // line_dedup.BYTES_PER_EDIT, line_dedup.THRESHOLD)
        for j in range(i + 1, len(kinds)):
            if t and len(kinds[j]) - len(a) <= t and edit_distance(a, kinds[j]) <= t:
                union.join(i, j)
    first = {}
    for i, a in enumerate(kinds):
        first[union.find(i)] = min([*where[a], first.get(union.find(i), (1 << 62, 0))])
    place = {a: i for i, a in enumerate(kinds)}
    removed = 0
    for doc_id, text in docs:
        lines = text.split(b"\n") if text else []
        gone = [line.strip(white) in place and first[union.find(place[line.strip(white)])] != (doc_id, n) for n, line in enumerate(lines)]
        kept = b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        r = got[doc_id]
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (len(lines), sum(gone), hashlib.sha256(kept).hexdigest())
        assert (r.text or "").encode() == kept
        removed += sum(gone)
    assert removed > 5


def test_units_are_compared_together(monkeypatch):
    """Many whole units a call give the links of each unit alone, wherever batches are cut."""
    rng = random.Random(9)
    rows, sizes = [], (1, 2, 2, 3, 40, 5, 2, 900, 2)
    for u, n in enumerate(sizes):
        one = "".join(rng.choice("abcdef") for _ in range(rng.choice((35, 70, 200))))
        for m in range(n):
            line = one[: rng.randrange(len(one))] + "x" + one if m % 3 == 2 else one[:9] + rng.choice("uvw") * rng.randint(0, 2) + one[9:]
            i, j = (0, 0) if u % 2 else (0, 1)
            rows.append((u, u * 1000 + m, m % 2 if j else 0, line.encode(), i, j))
    schema = pa.schema([("component", pa.int64()), ("member", pa.int64()), ("block", pa.int32()), ("line", pa.binary()), ("i", pa.int32()), ("j", pa.int32())])
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    classes = lambda links: {frozenset([b, *(x for x, y in links if y == b)]) for _, b in links}
    pairs = lambda t: list(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
    want = set().union(*(classes(pairs(line_dedup.compare(table.filter(pa.array([r[0] == u for r in rows])), 2))) for u in range(len(sizes))))
    calls, plain = [], line_dedup.compare
    monkeypatch.setattr(line_dedup, "compare", lambda *a: calls.append(a[0].num_rows) or plain(*a))
    for cut, together in ((7, 4096), (300, 4096), (5000, 4096), (300, 50)):
        monkeypatch.setattr(line_dedup, "TOGETHER", together)
        calls.clear()
        got = pa.Table.from_batches(line_dedup.compare_units(iter(table.to_batches(cut)), 2), line_dedup.UNIT)
        assert sum(calls) == len(rows) and classes(pairs(got)) == want
    assert want and len(calls) < len(sizes)


def test_lines_are_summed_once(monkeypatch):
    """All substrings of a chunk's lines are hashed from one run over its bytes."""
    calls, plain = [], tb.Rolling.sums
    monkeypatch.setattr(tb.Rolling, "sums", lambda *a: calls.append(1) or plain(*a))
    data = np.frombuffer(b"a line of more than sixty bytes, so that two edits are allowed in it", np.uint8)
    keys, _ = line_dedup.line_keys(data, np.array([0]), np.array([len(data)]), tb.Rolling(), 2)
    assert len(keys) > 3 and len(calls) == 1


def test_equal_short_lines_are_removed(spark):
    docs = spark.createDataFrame([(1, "Menu\nfirst text\n\nHome"), (2, "Menu\nsecond text\n\n Home \nMenu!")], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[1].n_removed == 0 and (rows[2].n_removed, rows[2].text) == (2, "second text\n\nMenu!")


def test_line_dedup_carries_columns(clashing, empty):
    left = line_dedup.documents_left(clashing)
    assert left.columns == clashing.columns
    assert {r.hits for r in left.collect()} == {"mine"}
    ids = {r.doc_id for r in left.collect()}
    # nothing was left of the copies; texts that were empty before stay
    assert {40, 41, 42} <= ids and 55 not in ids
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.documents_left(empty).count() == 0


def test_probes_of_lines_meet():
    """Two lines within the threshold share a key."""
    from barline.llm import textbytes as tb

    rng = random.Random(8)
    hasher = tb.Rolling()
    for _ in range(300):
        a = bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(64, 130)))
        b = bytearray(a)
        for _ in range(2):
            k = rng.randrange(len(b))
            b[k: k + rng.randint(0, 1)] = bytes(rng.choice(b"abcdef") for _ in range(rng.randint(0, 1)))
        data, offsets = tb.column(pa.array([a, bytes(b)], pa.binary()))
        keys, who = line_dedup.line_keys(data, offsets[:-1], np.diff(offsets), hasher, 2)
        assert len(np.intersect1d(keys[who == 0], keys[who == 1]))
