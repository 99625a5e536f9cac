"""The Merkle manifest against a tree built leaf by leaf."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from odd_tables import SCHEMA, SF, against_sql, clashing, empty, odd  # noqa: F401

from barline.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, more=0):
    return sha(field(r.doc_id), field(r.source), field(r.lang), field(None if r.n_chars is None else r.n_chars + more), field(r.text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i: i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        yield (nodes[i ^ 1] if i ^ 1 < len(nodes) else None), i & 1
        i >>= 1


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: levels([x[2] for x in sorted(groups[name], key=lambda x: x[:3])]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            steps = [*path(trees[name], i), *path(top, k)]
            node = leaf(r, 1) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else own
            for other, right in steps:
                node = sha(node) if other is None else sha(other, node) if right else sha(node, other)
            out.append((r.doc_id, own, trees[name][-1][0], top[-1][0], sha(*[o for o, _ in steps if o]), node, node == top[-1][0]))
    return out


def check(docs):
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(docs.collect()), key=repr)


def test_manifest_of_odd_rows(spark, odd, clashing):
    more = [(i, f"t{i}", lang, "s", i) for i in (3, 70_000, -70_000, 1 << 62, -(1 << 62), 5) for lang in (None, "", "fr", "é")]
    check(odd.unionByName(spark.createDataFrame(more, SCHEMA)).unionByName(clashing, allowMissingColumns=True))


def test_whole_blocks_single_rows_hot_ids_and_equal_rows(spark):
    rows = [(i * 3 - 500, f"text {i}", f"l{k}", None, i) for k, n in enumerate((1, 2, 1024, 1025, 2049)) for i in range(n)]
    rows += [(None, f"t{i % 40}", "en", "s", 1) for i in range(300)] + [(7, f"t{i % 3}", "en", "s", 1) for i in range(300)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_manifest_of_many_languages(spark):
    check(spark.createDataFrame([(i, "t", f"l{i % 1100}", "s", None) for i in range(1200)], SCHEMA))


def test_no_rows(empty):
    assert merkle.manifest(empty).collect() == []


def test_manifest_equals_sql(spark, against_sql):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, want = against_sql(merkle.manifest(docs), queries.ORACLES["op13_merkle_manifest"], documents=docs)
    assert got == want


def test_bitmaps_merge_and_rank():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(-9000, 9000, 3000), rng.integers(-(1 << 40), 1 << 40, 50), [5] * 9])
    group = rng.integers(0, 2, len(ids))
    parts = [merkle._bitmaps([[group[i::3], np.zeros(len(ids[i::3]), np.int64), ids[i::3]]]) for i in range(3)]
    table = pa.Table.from_batches(parts).sort_by([("a", "ascending"), ("b", "ascending"), ("span", "ascending")])
    merged = pa.Table.from_batches(merkle.merge_bitmaps(iter(table.to_batches(max_chunksize=7))))
    assert sum(merged["n"].to_pylist()) == len(ids) and any(merged["bits"].is_valid().to_pylist()) and any(merged["places"].is_valid().to_pylist())
    for row in merged.to_pylist():
        inside = ids[(group == row["a"]) & (ids >> merkle.SPAN == row["span"])] & ((1 << merkle.SPAN) - 1)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(inside), pa.array(inside), *[pa.array([row[c]] * len(inside), merged.schema.field(c).type) for c in ("places", "bits", "before", "extra")]],
            names=["start", "place", "places", "bits", "before", "extra"])
        got = next(merkle.rank(iter([batch]), 1))
        assert got["below"].to_pylist() == [int((inside < x).sum()) for x in inside]
        assert got["same"].to_pylist() == [int((inside == x).sum()) for x in inside]
