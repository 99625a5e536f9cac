"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import LOWER, UPPER, table
from barline.llm.decontaminate import contamination
from barline.llm.exact_dedup import exact_dedup
from barline.llm.jaccard import jaccard_groups
from barline.llm.language_model import language_scores
from barline.llm.line_dedup import line_dedup
from barline.llm.merkle import manifest
from barline.llm.mixing import SEED, plan_mix
from barline.llm.passages import fuzzy_passages
from barline.llm.perplexity_rules import quality_rules
from barline.llm.quality import quality_weights
from barline.llm.suffix_dedup import suffix_dedup
from barline.llm.tokenizer_alignment import alignment
from barline.llm.warc import REVISIT_BYTES, archive_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op8_mix_sources", rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS top FROM s),
r AS (
  SELECT *, coalesce(sum(top) OVER o, 0)::BIGINT AS top_before,
    (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS w_left, (sum(source_size) OVER ())::BIGINT AS total
  FROM w WINDOW o AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT top_before AS f_before, w_left AS f_left FROM r WHERE (total - top_before) / w_left * w <= top
  ORDER BY top_before, w_left DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE
    WHEN source_size = 0 THEN 0.0
    WHEN f_before IS NULL OR top_before < f_before THEN top::DOUBLE
    ELSE w * ((total - f_before) / f_left) END::DOUBLE AS target
  FROM r LEFT JOIN f ON true),
p AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || digest)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
  (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS copies
FROM p""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"), "mix.copies")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("text")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_warc", f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first_id THEN first_id END AS refers_to
FROM f""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(table(spark, sf_dir, "documents"))


@query("op6_language_model")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


@query("op12_perplexity_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _written(column: str) -> str:
    """A field of a leaf: byte count and value, or - for a null."""
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR END"


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce({_CRC} % 7 = 0, false) AS hit,
    {_written('doc_id')} || {_written('source')} || {_written('lang')} AS head, {_written('text')} AS tail
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || {_written('n_chars')} || tail) AS leaf,
    sha256(head || CASE WHEN hit THEN {_written('(n_chars + 1)')} ELSE {_written('n_chars')} END || tail) AS tampered
  FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM l),
t AS (
  SELECT g, 0 AS lvl, idx, n, leaf AS h FROM p
  UNION ALL
  SELECT g, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, lvl, idx // 2),
s AS (SELECT g, h AS subroot, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, g AS idx, n, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 2),
a AS (
  SELECT doc_id, leaf, g, idx AS place, 0 AS lvl, idx, n, '' AS proof, tampered AS node FROM p
  UNION ALL
  SELECT doc_id, leaf, a.g, place, a.lvl + 1, a.idx // 2, (a.n + 1) // 2, proof || coalesce(t.h, ''),
    sha256(CASE WHEN a.idx % 2 = 1 THEN t.h || node ELSE node || coalesce(t.h, '') END)
  FROM a LEFT JOIN t ON t.g = a.g AND t.lvl = a.lvl AND t.idx = xor(a.idx, 1) WHERE a.n > 1),
b AS (
  SELECT doc_id, leaf, a.g, place, subroot, 0 AS lvl, a.g AS idx, s.n, proof, node FROM a JOIN s ON a.g = s.g WHERE a.n = 1
  UNION ALL
  SELECT doc_id, leaf, b.g, place, subroot, b.lvl + 1, b.idx // 2, (b.n + 1) // 2, proof || coalesce(u.h, ''),
    sha256(CASE WHEN b.idx % 2 = 1 THEN u.h || node ELSE node || coalesce(u.h, '') END)
  FROM b LEFT JOIN u ON u.lvl = b.lvl AND u.idx = xor(b.idx, 1) WHERE b.n > 1),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM b, r WHERE b.n = 1""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
