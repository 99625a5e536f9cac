"""The counts of the quality rules and the n-gram model against plain Python, and the bands they give."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import SCHEMA, SF, clashing, empty, odd, prose  # noqa: F401
from pyspark.sql import functions as F

from barline.llm import perplexity_rules as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) as stated."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    twice = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i: i + 8])] > 1:
            twice.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(twice)


class Plain:
    """Interpolated modified Kneser-Ney over bytes, one model per code, from dictionaries."""

    def __init__(self, rows):
        n = pr.ORDER
        top = Counter()
        for code, text in rows:
            data = b"\n" * (n - 1) + text + b"\n"
            top.update((code, data[i - n + 1: i + 1]) for i in range(n - 1, len(data)))
        self.counts = [top]
        for _ in range(n - 1):
            self.counts.append(Counter((code, gram[1:]) for code, gram in self.counts[-1]))
        self.counts.reverse()
        self.d, self.of = [], []
        self.cut = [1, 1, *[pr.LEAST_COUNT] * (n - 2)]
        for counts, cut in zip(self.counts, self.cut, strict=True):
            seen = Counter(counts.values())
            self.d.append(pr.discounts([seen[i] for i in (1, 2, 3, 4)]))
            groups = defaultdict(list)
            for (code, gram), c in counts.items():
                groups[code, gram[:-1]].append(c)
            self.of.append({k: (sum(v), sum(self.d[-1][min(c, 3) - 1] if c >= cut else c for c in v)) for k, v in groups.items()})

    def p(self, code, gram):
        order = len(gram)
        lower = self.p(code, gram[1:]) if order > 1 else 1 / 256
        if (code, gram[:-1]) not in self.of[order - 1]:
            return lower
        total, held = self.of[order - 1][code, gram[:-1]]
        c = self.counts[order - 1].get((code, gram), 0)
        own = c - self.d[order - 1][min(c, 3) - 1] if c >= self.cut[order - 1] else 0
        return (own + held * lower) / total

    def log(self, code, text):
        n = pr.ORDER
        data = b"\n" * (n - 1) + text + b"\n"
        return sum(math.log(self.p(code, data[i - n + 1: i + 1])) for i in range(n - 1, len(data)))


def small(spark, odd):
    more = [(500 + i, t, lang, "s", 1) for i, (t, lang) in enumerate(
        [("# a $b | <c> 100%", "fr"), ("one two three four five six seven eight nine " * 3, None), ("x\ny\nx\n x\n\n\nx", "fr"), ("only one of its kind " * 2, "qq"), (None, None)])]
    return odd.where("coalesce(length(text), 0) < 5000").unionByName(spark.createDataFrame(more, SCHEMA))


def test_rules_and_model_equal_plain_python(spark, odd):
    docs = small(spark, odd)
    rows = docs.select("doc_id", "text", "lang", pr.language_code(F.col("lang")).alias("code")).collect()
    got = pr.quality_rules(docs).collect()
    plain = Plain([(r.code, (r.text or "").encode()) for r in rows])
    want = []
    for r in rows:
        counts = rules(r.text)
        text = (r.text or "").encode()
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        want.append((r.doc_id, *counts, failed, -plain.log(r.code, text) / (len(text) + 1) if counts[0] else None))
    key = lambda x: tuple(repr(v) for v in x[:7])
    mine = sorted(((r.doc_id, *[r[f] for f in pr.FIELDS], r.base_failed, r.log_perplexity) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:7] == b[:7] and (a[7] is b[7] is None or a[7] == pytest.approx(b[7], rel=1e-9))
    assert not any(r.kept for r in got if r.base_failed)


def test_cut_models_still_add_up_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for rows in (1 << 20, 300):
        model = pr.Model(pr.fit(docs, rows))
        assert max(len(model.gram), len(model.context)) <= rows * pr.ORDER
        code = docs.select(pr.language_code(F.col("lang"))).first()[0]
        for context in (b"the ", b"\n\n\n\n", b"zzzz", b"q\xc3\xa9x"):
            keys = np.array([int.from_bytes(bytes([0, 0, code]) + context + bytes([b]), "big") for b in range(256)])
            assert np.exp(model.log(keys)).sum() == pytest.approx(1.0)


def test_scores_do_not_depend_on_what_is_sent(spark, odd, clashing):
    """Every n-gram counts, also those beyond the bound of what tasks are sent."""
    docs = small(spark, odd)
    want = pr.quality_rules(docs).toPandas()
    keys = ["doc_id", *pr.FIELDS]
    for rows in (100, 0):
        got = pr.quality_rules(docs, rows=rows).toPandas()
        a, b = (x.sort_values([*keys, "log_perplexity"], ignore_index=True) for x in (want, got))
        assert a[[*keys, "base_failed", "kept"]].equals(b[[*keys, "base_failed", "kept"]])
        for c in ("log_perplexity", "deviation"):
            assert np.allclose(a[c], b[c], rtol=1e-9, equal_nan=True)
    left = pr.well_formed(clashing, rows=100)
    assert left.columns == clashing.columns and sorted(left.toPandas().doc_id.fillna(-1)) == sorted(pr.well_formed(clashing).toPandas().doc_id.fillna(-1))


def test_bands_are_medians_and_deviations(spark):
    rng = np.random.default_rng(2)
    rows = [(lang, (50, 1, 0, 0, 0, 400, float(-400 * x), float(400 * x * x + 10))) for lang, mid in (("a", 1.3), (None, 2.0)) for x in rng.normal(mid, 0.05, 301)]
    ratings = spark.createDataFrame(rows, f"lang string, r {pr.TYPE}")
    for band in pr.bands(ratings).collect():
        x = np.sort([-r[6] / 400 for lang, r in rows if lang == band["__lang"]])
        assert abs(band["__median"] - np.median(x)) <= 1 / pr.BINS
        assert abs(band["__deviation"] - 1.4826 * np.median(np.abs(x - np.median(x)))) <= 3 / pr.BINS
    assert pr.bands(ratings).count() == 2


def test_junk_goes_and_clean_text_stays(spark):
    import random

    rng = random.Random(3)
    vocabulary = prose(rng, 900)
    clean = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 400))), "en", "s", 1) for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rng.choice("qxzjkvw0189") for _ in range(7)) for _ in range(120)), "en", "s", 1) for i in range(6)]
    rows = {r.doc_id: r for r in pr.quality_rules(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert not any(rows[i].kept for i, *_ in junk) and not any(rows[i].base_failed for i, *_ in junk)
    assert sum(rows[i].kept for i, *_ in clean) >= 285


def test_columns_are_carried_and_no_rows_give_none(clashing, empty):
    kept = {r.doc_id for r in pr.quality_rules(clashing).where("kept").collect()}
    left = pr.well_formed(clashing)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == kept
    assert pr.quality_rules(empty).count() == 0 and pr.well_formed(empty).count() == 0


def test_counting_in_parts_gives_the_same(monkeypatch):
    import pyarrow as pa

    texts = ["abc " * 50, "", "x", "é" * 700, None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(texts)], names=["code", "text"])

    def counted():
        total = Counter()
        for b in pr.count(iter([batch])):
            total.update(dict(zip(b["key"].to_pylist(), b["count"].to_pylist(), strict=True)))
        return total

    whole = counted()
    monkeypatch.setattr(pr, "PIECE", 64)
    monkeypatch.setattr(pr, "HELD", 40)
    assert counted() == whole
