"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extract, fingerprint, langid, lm, media, neardup, packing, resample, sharding, simhash, suffix
from .common import crc32_of_id, table

BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=40)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).withColumn("class_key", F.hex("class_key")).drop("key")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (crc32_of_id(F.col("doc_id")) % 5) == 0
    model = langid.learn(docs.filter(~held_out))
    return langid.classify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE, size=1024, end_id=2)


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), held_out=(crc32_of_id(F.col("doc_id")) % 7) == 2)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspect_media(media.store_texts(table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.measure_repeats(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_neardup, op3_langid, op4_packing, op5_extraction, op6_lm_scoring, op7_fingerprints, op8_media, op9_suffix_dedup, op10_bpe, op11_resampling, op12_simhash)}


#: Strings of 50 bytes, in hexadecimal, and the least document that each starts in.
OP9_SQL = """
WITH d AS MATERIALIZED (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS MATERIALIZED (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), least AS (
    SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), starts AS (
    SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM w JOIN least USING (s) WHERE doc_id > m
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + 50 AS b
    FROM (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM starts) GROUP BY doc_id, span
), between_spans AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), gone AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last
    FROM between_spans JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def _op7_sql() -> str:
    """Fingerprints of texts and of edited texts, from SHA-256 of lines and of their clauses."""
    number = lambda first, digits: f"CAST('0x' || substr(digest, {first + 1}, {digits}) AS BIGINT)"
    per_number = fingerprint.WORDS_A_NUMBER
    exact = ", ".join(f"sum({number(8 * i, 8)}) AS e{i}" for i in range(fingerprint.EXACT))
    word = lambda j: f"(({number(fingerprint.DIGITS * (j // per_number), fingerprint.DIGITS)} >> {j % per_number}) & {1 | 1 << fingerprint.LANE_BITS})"
    signs = ", ".join(f"sum({word(j)}) AS s{j}" for j in range(fingerprint.SIGNS))
    hexes = " || ".join([*(f"printf('%08x', coalesce(e{i}, 0) % 4294967296)" for i in range(fingerprint.EXACT)), "printf('%016x', coalesce(units, 0))", *(f"printf('%016x', coalesce(s{j}, 0))" for j in range(fingerprint.SIGNS))])
    lane = (1 << fingerprint.LANE_BITS) - 1
    lanes = ", ".join(f"2 * ((coalesce(s{j}, 0) >> {shift}) & {lane}) - coalesce(units, 0)" for j in range(fingerprint.SIGNS) for shift in (0, fingerprint.LANE_BITS))
    like = lambda a, b: f"CASE WHEN {b}.print IS NULL THEN 0.0 WHEN {a}.print = {b}.print THEN 1.0 WHEN {a}.square * {b}.square <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, list_dot_product({a}.lanes, {b}.lanes) / sqrt({a}.square * {b}.square))) END"
    return rf"""
WITH d AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), ranked AS (
    SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after_t, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d
), body AS MATERIALIZED (
    SELECT doc_id, false AS edited, t FROM d
    UNION ALL SELECT doc_id, true, substr(t, 1, n - n // 3) || substr(after_t, 1, n // 3) FROM ranked
), lines AS MATERIALIZED (
    SELECT doc_id, edited, unnest(string_split(t, chr(10))) AS line FROM body WHERE t <> ''
), exact AS MATERIALIZED (
    SELECT doc_id, edited, {exact} FROM (SELECT doc_id, edited, sha256(line) AS digest FROM lines) GROUP BY ALL
), clauses AS (
    SELECT doc_id, edited, unnest(string_split(regexp_replace(line, '([.!?,;:])[ \t]+', '\1' || chr(1), 'g'), chr(1))) AS clause FROM lines
), signs AS MATERIALIZED (
    SELECT doc_id, edited, count(*) AS units, {signs} FROM (SELECT doc_id, edited, sha256(clause) AS digest FROM clauses WHERE clause <> '') GROUP BY ALL
), found AS MATERIALIZED (
    SELECT doc_id, edited, print, lanes, list_dot_product(lanes, lanes) AS square
    FROM (SELECT doc_id, edited, {hexes} AS print, CAST([{lanes}] AS DOUBLE[]) AS lanes FROM body LEFT JOIN exact USING (doc_id, edited) LEFT JOIN signs USING (doc_id, edited))
)
SELECT doc_id, CAST(r.n AS BIGINT) AS n_chars, sha256(b.t) AS edited_sha256, x.print AS fingerprint, y.print AS edited_fingerprint, {like('x', 'y')} AS near_edited, {like('x', 'z')} AS near_next
FROM ranked AS r JOIN body AS b USING (doc_id) JOIN found AS x USING (doc_id) JOIN found AS y USING (doc_id) JOIN found AS z ON z.doc_id = r.next_id
WHERE b.edited AND NOT x.edited AND y.edited AND NOT z.edited
"""


def _op11_sql() -> str:
    """Buckets by crc32, from its table by the rule of its polynomial; gains, scores and the draw by windows."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    upper = resample.UPPER
    words = lambda t: f"list_filter(string_split_regex(translate(coalesce({t}, ''), '{upper}', '{upper.lower()}'), '{resample.SEPARATOR}'), lambda x: x <> '')"
    features = "list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))"
    byte = "list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT))"
    crc = f"xor(list_reduce({byte}, lambda c, x: xor(c >> 8, CAST({table} AS BIGINT[])[CAST(xor(c, x) & 255 AS INT) + 1]), 4294967295), 4294967295)"
    k = resample.BUCKETS
    return rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM documents
), f AS MATERIALIZED (
    SELECT rid, unnest({features}) AS feature FROM d
), g AS MATERIALIZED (
    SELECT unnest({features}) AS feature FROM (SELECT {words('text')} AS w FROM benchmark)
), b AS MATERIALIZED (
    SELECT feature, {crc} % {k} AS bucket FROM (SELECT feature FROM f UNION SELECT feature FROM g)
), s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (feature) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (feature) GROUP BY ALL),
gains AS MATERIALIZED (
    SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM f) + {k})) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM g) + {k})))) AS BIGINT) AS gain
    FROM (SELECT unnest(range({k})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), sums AS (
    SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b USING (feature) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
    SELECT rid, doc_id, len(w) >= 20 AS enough, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - (total % n + n) % n) // n END AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS noise
    FROM d LEFT JOIN sums USING (rid)
), placed AS (
    SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY enough ORDER BY weight + noise DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= (SELECT 25 * count(*) // 100 FROM placed WHERE enough) THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_fingerprints": _op7_sql(), "op9_suffix_dedup": OP9_SQL, "op11_resampling": _op11_sql()}
