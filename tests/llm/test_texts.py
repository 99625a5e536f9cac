"""Archives, decontamination, language model, passages, mixing, quality and the pipeline."""

import math
import random
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from odd_tables import SF, against_sql, clashing, empty, odd, plain  # noqa: F401

import corpus_pipeline
from barline.llm import decontaminate, language_model, mixing, passages, quality, queries, warc

PAGES = "page_id long, url string, html string, hits string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"http://www.Site{i % 3}.example/a/{i % 4}?q={i}#f", big if i % 2 else f"<p>{i}</p>" * i, "h") for i in range(40)]
    rows += [(50, None, None, "h"), (51, "", "", "h"), (52, "no scheme", "short", "h"), (53, "http://b/\r\nX: y", "short", "h"),
             (54, "http://t/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5, "h"), (55, "http://t/", "é\u0000" * 90, "h"),
             (56, "http://t/", "é\u0000" * 90, "h"), (57, "http://long/", "y" * 300_000, "h")]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_warc_equals_sql(pages, against_sql):
    df = warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got, want = against_sql(df, queries.ORACLES["op4_warc"], pages=pages)
    assert got == want


def test_capture_histories_are_in_global_order(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"), file_records=4)
    runs = warc.read_index(spark, str(tmp_path / "w"))
    assert runs.select("run").distinct().count() > 5
    rows = warc.capture_histories(runs, ranges=4).orderBy("merge_range", "merge_place").collect()
    order = [(r.url_key.encode(), r.captured, r.page_id) for r in rows]
    assert order == sorted(order) and len(rows) == pages.count()


def test_warc_with_nulls_repeats_and_no_rows(spark, pages):
    big = "<p>" + "x" * 200 + "</p>"
    more = pages.unionByName(spark.createDataFrame([(None, "http://n/", big, "h"), (1, "http://n/", big, "h"), (None, None, None, "h")], PAGES))
    rows = warc.archive_pages(more).collect()
    assert len(rows) == more.count()
    assert [(r.record_type, r.refers_to) for r in rows if r.page_id is None and r.payload_bytes] == [("revisit", 1)]
    assert {r.record_type for r in rows if r.page_id == 1} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted((rng.randrange(20), (r, i)) for i in range(rng.randrange(9))) for r in range(k)]
        got = list(warc.loser_tree([iter([(key, (key, *v)) for key, v in run]) for run in runs]))
        assert sorted(got) == sorted((key, *v) for run in runs for key, v in run) and [g[0] for g in got] == sorted(g[0] for g in got)


def test_url_keys():
    assert warc.url_key("HTTP://User@WWW.Example.com:80/A?b#c") == "com,example,www)/A?b"


def test_myers_equals_brute_force():
    from test_copies import edit_distance

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(low, 10))) for low in (1, 0))
        best = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.myers(a, b)[0] == best
        assert passages.distance([*map(ord, a)], [*map(ord, b)]) == edit_distance(a, b)


def test_edited_items_are_found(spark, clashing, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(7, None), (8, " "), (None, " ".join(word() for _ in range(30)))]
    docs, want = [], {}
    for i in range(30):
        item_id, item = items[i % 6]
        k, text = int(len(decontaminate.normalise(item)) * decontaminate.RATE), list(item)
        edits = [k, k // 2, k + 12][i % 3]
        for at in rng.sample(range(len(text)), edits):
            text[at] = "#"
        want[i] = [item_id] if edits <= k else []
        docs.append((i, " ".join(word() for _ in range(40)) + "\n " + "".join(text).upper() + "  " + " ".join(word() for _ in range(9))))
    docs += [(40, None), (41, ""), (42, items[-1][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(table, bench).collect()}
    assert {i: got[i].item_ids for i in want} == want
    assert got[42].contaminated and got[42].item_ids == [None] and not got[40].contaminated
    # the same in many small blocks of items
    blocks = decontaminate.find_items(table, bench, block=300).selectExpr("doc_id", "size(hits) > 0 AS c").collect()
    assert {r.doc_id: r.c for r in blocks} == {i: r.contaminated for i, r in got.items()}
    kept = decontaminate.clean_of(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(table, bench.limit(0)).where("contaminated").count() == 0


def test_language_model_counts_and_scores(odd, plain, empty, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 200)
    rows = language_model.language_scores(odd).collect()
    docs = [(r.doc_id, [*plain(r.text), None]) for r in odd.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, words in docs if not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in docs)
    assert Counter((*r[:5], round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert language_model.language_scores(empty).count() == 0
    assert language_model.language_scores(odd.where("doc_id = 40")).first().n_tokens == 1


def test_language_model_learns(spark):
    """Held-out texts in two languages: the state tells them apart, counts cannot."""
    rng = random.Random(4)
    tongues = [["".join(rng.choice(s) for _ in range(4)) for _ in range(60)] for s in ("abcd", "wxyz")]
    docs = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(120))) for i in range(900)]
    rows = language_model.language_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    # knowing the language is worth log10(2) a word
    assert gain > 0.2


def test_language_model_trains_on_every_token(spark):
    types = language_model.Types(np.arange(1, 50, dtype=np.uint64), np.arange(50, 1, -1), 10, 5)
    texts = spark.createDataFrame([(i, "one two three " * (i % 7)) for i in range(2500)], "doc_id long, text string")
    names, start = (spark.sparkContext.broadcast(v) for v in (types, language_model.pack(language_model.fresh(types))))
    train = partial(language_model.train, net=start, types=names)
    for parts in (1, 7, 40):
        # empty tasks give no model
        rows = texts.where("doc_id % 50 < 49").repartition(parts).select("text").mapInArrow(train, "id long, tokens long, net binary").collect()
        assert sum(r.tokens for r in rows) == sum(3 * (i % 7) + 1 for i in range(2500) if i % 50 < 49)
    few = texts.where("doc_id < 9")
    net = language_model.fit(few, types)
    assert any((net[k] != v).any() for k, v in language_model.fresh(types).items())


def test_masked_places_have_no_weight():
    types = language_model.Types(np.arange(1, 50, dtype=np.uint64), np.arange(50, 1, -1), 10, 5)
    words = types.of(np.random.default_rng(1).integers(1, 60, 11).astype(np.uint64))
    nets = []
    for masked in (0, 5):
        trainer = language_model.Trainer(language_model.fresh(types), types.end)
        trainer.h = np.zeros((1, language_model.HIDDEN), np.float32)
        trainer.window(np.append(words, np.full(masked, types.end))[None, :], masked)
        nets.append(trainer.m)
    assert all(np.allclose(nets[0][k], nets[1][k], atol=1e-7) for k in nets[0])


def test_gradients():
    types = language_model.Types(np.arange(1, 50, dtype=np.uint64), np.arange(50, 1, -1), 10, 5)
    net = {k: v.astype(np.float64) for k, v in language_model.fresh(types).items()}
    rng = np.random.default_rng(0)
    net["cw"] += rng.normal(0, 0.3, net["cw"].shape)
    net["ww"] += rng.normal(0, 0.3, net["ww"].shape)
    words = types.of(rng.integers(1, 60, 24).astype(np.uint64))
    loss = lambda n: -language_model.document_scores(n, words, np.array([0, 24]), types.end).sum()
    seq = np.append(words, types.end)
    # one lane, one window: the gradient before clipping and the step
    caught = {}

    class Probe(language_model.Trainer):
        pass

    trainer = Probe(net, types.end)
    trainer.h = np.zeros((1, language_model.HIDDEN))
    old = {k: v.copy() for k, v in net.items()}
    monkey, language_model.CLIP = language_model.CLIP, 1e9
    try:
        trainer.window(seq[None, :])
    finally:
        language_model.CLIP = monkey
    for k in net:
        caught[k] = trainer.m[k] * 10 * len(seq)
    for k in old:
        flat = np.flatnonzero(np.abs(caught[k].ravel()) > 1e-3)[:4]
        for at in flat:
            up = {n: v.copy() for n, v in old.items()}
            up[k].ravel()[at] += 1e-4
            down = {n: v.copy() for n, v in old.items()}
            down[k].ravel()[at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - caught[k].ravel()[at]) < 2e-2 * max(1, abs(caught[k].ravel()[at]))


def test_chains_equal_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 20)
        x, y = ([rng.randrange(50) for _ in range(n)] for _ in range(2))
        best = {}
        for j in sorted(range(n), key=lambda i: (x[i], y[i])):
            best[j] = passages.K + max([0, *(best[i] - passages.GAP * (x[j] - x[i] + y[j] - y[i]) for i in best if x[i] < x[j] and y[i] < y[j])])
        chain = passages.chains(x, y)[0]
        pairs = list(zip(chain, chain[1:], strict=False))
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in pairs)
        score = passages.K * len(chain) - passages.GAP * sum(x[b] - x[a] + y[b] - y[a] for a, b in pairs)
        assert abs(score - max(best.values())) < 1e-9


def test_planted_passages(spark, odd, empty):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    one, two = words(60), words(80)
    fuzzy = [w for i, w in enumerate(two) if i % 13]
    docs = [(1, words(200) + one + words(100)), (2, words(30) + one + words(77)), (3, one), (4, words(300) + two + words(10)),
            (5, words(20) + fuzzy + words(44)), (6, words(400)), (7, one[:49] + words(30)), (10, one[:51] + words(30)), (11, words(12) + one[:51])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(8, None), (9, ""), (None, " ".join(one))], "doc_id long, text string")
    got = {(r.doc_id, r.ref_id): r for r in passages.fuzzy_passages(table).collect()}
    assert set(got) == {(2, 1), (3, 1), (10, 1), (11, 1), (5, 4)}
    assert tuple(got[2, 1])[2:7] == (30, 90, 200, 260, 0) and got[5, 4].identity > 0.9
    assert {r.doc_id for r in passages.fuzzy_passages(odd).collect()} >= {*range(21, 30)}
    assert passages.fuzzy_passages(empty).count() == 0


def test_short_quotes_hide_no_passage(spark):
    """Earlier documents quote parts of a passage, too short to be reported, then two hold all of it."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    docs, want = [], set()
    for _ in range(20):
        # one quote, many of one part, many of all parts; a passage that goes on
        for quotes, n in (([(0, 45)], 60), ([(0, 45)] * 9, 60), ([(0, 45), (30, 60)] * 9, 60), ([(0, 40)] * 9, 400)):
            one = words(n)
            for a, b in [*quotes, (0, n), (0, n)]:
                docs.append((len(docs), " ".join(words(9) + one[a:b] + words(9))))
            want.add((len(docs) - 1, len(docs) - 2, 9, 9 + n))
    rows = passages.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = {(r.doc_id, r.ref_id, r.start, r.end) for r in rows}
    assert got == want


def test_every_place_of_a_passage_is_found(spark):
    """A passage twice in a document, one after a short quote of it in the earlier document, and lines that repeat."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    docs, want = [], set()

    def add(text):
        docs.append((len(docs), " ".join(text)))
        return len(docs) - 1

    for many in (0, 7):
        for _ in range(5):
            one = words(60)
            for _ in range(many):
                add(words(9) + one[:40] + words(9))
            ref = add(words(70) + one + words(70))
            twice = add(words(80) + one + words(90) + one + words(10))
            want |= {(twice, ref, 80, 140), (twice, ref, 230, 290)}
            other = words(60)
            ref = add(words(70) + other[:45] + words(70) + other + words(20))
            want.add((add(words(30) + other + words(30)), ref, 30, 90))
    for size in (4, 8, 30):
        line = words(size)
        ref = add(words(40) + line * 60 + words(40))
        want.add((add(words(20) + line * 40 + words(20)), ref, 20, 20 + 40 * size))
    rows = passages.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.ref_id, r.start, r.end) for r in rows} == want


def test_a_stretch_keeps_its_ends():
    """Of lines that repeat, the places at the ends are seeds; of other repeats all are."""
    rng = np.random.default_rng(4)
    line, one = (rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (10, 40))
    fill = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    words = np.concatenate([fill(30), *[line] * 100, fill(30), *[line] * 50, fill(60), one, fill(70), one, fill(80), one])
    r, place, last, h = passages.seeds(words, np.zeros(len(words), np.int64), 1)
    assert len(set(zip(place.tolist(), h.tolist(), strict=True))) == len(place) and (last >= place).all()
    found = {v: np.sort(place[h == v]) for v in set(h.tolist())}
    inside = [p for p in found.values() if 30 <= p[0] < 1030]
    assert inside and all(len(p) <= 4 * passages.MIN_SEEDS for p in inside) and any(p[-1] >= 1520 for p in inside)
    assert sum(len(p) == 3 and p[1] - p[0] == 110 and p[2] - p[1] == 120 for p in found.values()) >= 5


def test_frequent_seeds_hide_no_edited_passage(spark, monkeypatch):
    """All seeds of a passage are frequent, their first documents too short to report, and edits break every run."""
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    docs, want = [], set()
    for k in range(12):
        one = words(96)
        for a, b in [(0, 40), (28, 68), (56, 96)] * 6:
            docs.append((len(docs), " ".join(words(30) + one[a:b] + words(30))))
        edited = [w if i % 11 != k % 11 else words(1)[0] for i, w in enumerate(one)]
        # a class of its own whose seeds are the same
        for text in (one, edited):
            docs.append((len(docs), " ".join(words(9) + text + words(9))))
        want.add((len(docs) - 1, len(docs) - 2))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.ref_id) for r in passages.fuzzy_passages(table).collect()} == want
    # small blocks, and pairs not compared before they are made
    monkeypatch.setattr(passages, "BLOCK", 3)
    monkeypatch.setattr(passages, "TOLD", 4)
    assert {(r.doc_id, r.ref_id) for r in passages.fuzzy_passages(table).collect()} == want


def test_mixing_equals_sql(odd, against_sql):
    df = mixing.plan_mix(odd).selectExpr("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.size * mix.copies AS taken", "mix.copies")
    got, want = against_sql(df, queries.ORACLES["op8_mix_sources"], documents=odd)
    assert got == want


def test_targets_share_everything_up_to_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 300, None: 5, "e": 200}
    got = {r[0]: r[2] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "__source string, __size long")).collect()}
    total, weight = sum(sizes.values()), {s: (1, 2, 3)[i % 3] for i, s in enumerate(["a", "b", "c", "d", "e", None])}
    want, left = {}, set(sizes)
    share = dict.fromkeys(sizes, 0.0)
    while True:  # share, cut at the cap, share the excess again
        rest = total - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        left -= over
    want |= share
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in sizes)


def test_rows_without_ids_draw_apart(spark):
    rows = [(None if i % 3 else i % 30, f"{'w ' * (i % 17 + 1)}{i}", f"s{i % 4}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.expr("mix.size * mix.copies")).alias("taken"), F.max("mix.target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.06 for r in got) and len(got) == 4


def test_mixture_holds_what_the_plan_says(clashing, empty):
    mixed = mixing.mix_sources(clashing)
    assert mixed.columns == clashing.columns
    planned = mixing.plan_mix(clashing, name="p").selectExpr("sum(p.copies)", "max(p.rate)").first()
    assert mixed.count() == planned[0] and planned[1] <= mixing.CAP
    assert mixing.mix_sources(empty).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice((rng.gauss(0, 1e6), rng.random(), 0.25)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 499, 500, 900):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, 500) - 1]
    assert quality.kth_largest(df, "x", 0) is None and quality.kth_largest(df.limit(0), "x", 3) is None


def test_quality_keeps_clean_documents(spark, clashing, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 4)))
    docs, labels, kind = [], [], {}
    for i in range(900):
        words = [word() for _ in range(rng.randint(40, 120))]
        kind[i] = ["clean", "clean", "clean", "poor", "toxic"][i % 5]
        if kind[i] == "poor":
            words = [w.upper() + "!!" for w in words]
        if kind[i] == "toxic":
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilestuff", "nastiness", "vileing"]))
        docs.append((i, " ".join(words)))
        if i < 500:
            labels.append((i, int(kind[i] != "poor"), int(kind[i] == "toxic")))
    labels += [(None, 1, 1), (3, None, 0), (10**9, 0, 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality_weights(table, marks).collect()}
    share = lambda k: sum(kept[i] for i in range(500, 900) if kind[i] == k) / sum(kind[i] == k for i in range(500, 900))
    assert share("clean") > 0.97 and share("poor") < 0.05 and share("toxic") < 0.1
    rows = quality.good_documents(clashing, marks)
    assert rows.columns == clashing.columns and rows.count() <= clashing.count()
    assert quality.good_documents(clashing, marks.limit(0)).count() == clashing.count()
    assert quality.quality_weights(empty, marks).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmarks", "mixture"]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        if name != "mixture":
            assert 0 < docs.count() < left or name in ("near_copies", "lines") and docs.count() <= left
            left = docs.count()
    assert docs.count() > 0


def test_pipeline_on_no_documents(spark, empty, tmp_path):
    empty.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
