"""Fixtures shared by the tests here: tables with every odd row the operators define."""

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside; a table may have columns of these names too.
CLASHES = ("doc", "row", "digest", "hits", "lines", "mix", "places", "member", "key", "place", "block", "__weight", "__key", "__size", "__copy", "keep_id")


def prose(rng, n):
    return [rng.choice("bcdfg") + "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages, runs of one sign."""
    rng = random.Random(11)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows = []
    for i in range(12):
        words = list(base)
        for _ in range(i // 2):
            words[rng.randrange(len(words))] = rng.choice(prose(rng, 5))
        rows.append((i, " ".join(words).replace(base[40], base[40] + "\n", 1)))
    for i in range(20, 30):
        rows.append((i, " ".join(prose(rng, rng.randint(20, 90)) + passage + prose(rng, rng.randint(5, 60)))))
    rows += [
        (40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "One"), (45, "two words"), (46, "a" * 400), (47, "b" + "a" * 350), (48, "ab " * 200),
        (49, "\n".join(["A line that is long enough to be compared with others, surely."] * 4 + ["short"])),
        (50, "A line that is long enough to be compared with others, surely!\nA line that is long enough to be compared with others surely.\n"),
        (51, "É" * 150 + " ünï"), (52, " ".join(prose(rng, 6000))), (53, rows[0][1]), (53, rows[0][1]), (54, rows[0][1].upper()), (55, rows[1][1]),
        (None, rows[2][1]), (None, None), (None, " ".join(prose(rng, 80))), (-7, " ".join(passage)), (1 << 40, rows[3][1]),
        (56, "x" * 99), (57, "x" * 100), (58, "\x00 nul \x85   wide"), (59, "\r\n".join(prose(rng, 40)))]
    sources = ["a", "b", None, "", "z", "é", "a"]
    return [(i, t, "en", sources[n % len(sources)], len(t) if t is not None else None) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("mine") for c in CLASHES})


@pytest.fixture(scope="session")
def plain():
    """Lower-cased words of a text, as the contracts define them."""
    import re

    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    return words


@pytest.fixture(scope="session")
def against_sql():
    """Rows of a DataFrame and of SQL over the given tables, both sorted."""
    import duckdb

    def both(df, sql, **tables):
        con = duckdb.connect()
        for name, t in tables.items():
            con.register(name, t.toArrow())
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        cols = sorted(names)
        assert sorted(df.columns) == cols
        order = lambda rows: sorted(rows, key=repr)
        want = order(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
        return order(tuple(r[c] for c in cols) for r in df.collect()), want

    return both
