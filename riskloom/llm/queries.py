"""The registered queries of the training-data operators, with production
parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_views, compression_toxicity, decontaminate, embedding_dedup, extendible_sharding, lexical_search,
               license_lookup, merkle_manifest, packing, personal_data, rans_store, simhash_index, suffix_dedup)

SHARD_BYTES = 4 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perspective rotation over all conversations."""
    views = chat_views.perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return views.select("conv_id", "speaker", "chunk", "n_turns", "text", spans.alias("mask_spans"), "n_masked")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that start in an earlier document, removed."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, length=50)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                      F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by 13-word runs of all benchmark items."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return out.drop("text_hash")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors within cosine 0.95, over all embeddings."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), min_cosine=0.95)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token files, written and read back."""
    return rans_store.store_and_read(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by fingerprints at 3 bits or fewer."""
    return simhash_index.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices in all documents."""
    return license_lookup.license_matches(_table(spark, sf_dir, "documents"), license_lookup.known_licenses(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most 4 MiB of text."""
    return extendible_sharding.assign_shards(_table(spark, sf_dir, "documents"), ["doc_id"], "text", SHARD_BYTES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by compression distance."""
    docs = _table(spark, sf_dir, "documents")
    model = compression_toxicity.fit_from_tables(docs, _table(spark, sf_dir, "labels"))
    out = compression_toxicity.score_documents(docs, model)
    return out.select("doc_id", F.coalesce(compression_toxicity.is_held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and proofs of all documents in one tree per language, a third of
    the rows presented with their capitals lower-cased."""
    docs = _table(spark, sf_dir, "documents")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle_manifest.manifest(docs, claim=F.when(third, merkle_manifest.leaf_digest(text=low)))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    out = personal_data.personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in personal_data.BASE],
                      F.sha2(personal_data.span_list(base), 256).alias("base_sha256"),
                      personal_data.span_list(F.col("spans")).alias("spans"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_CAPS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


# CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1),
    lambda i: [CAST(ord(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""


def _values(rows: list[tuple[str, str]]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(a)}, {q(b)})" for a, b in rows)


SQL = {
    "op1_chat_formatting": r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations),
v AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
s AS (SELECT t.conv_id, v.speaker, pos // 64 AS chunk, pos, body, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END AS head
    FROM t JOIN v USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM s)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY pos) AS text,
    coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE mine), '') AS mask_spans,
    CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, speaker, chunk""",
    "op3_benchmark_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n_words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, n_words - n + 2)) AS k
    FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(e, lambda a: a <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, m AS component_id, vec_id = m AS kept
FROM (SELECT a AS vec_id, min(b) AS m FROM c GROUP BY a)""",
    "op8_license_scans": rf"""
WITH known AS (SELECT min(license) AS license, form FROM (SELECT license, {license_lookup.canonical_sql('body')} AS form
    FROM (VALUES {_values(license_lookup.KNOWN)}) k(license, body)) WHERE form <> '' GROUP BY form),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, license AS text_license FROM d JOIN known ON form = {license_lookup.canonical_sql('text')}),
n AS (SELECT r, count(*) AS n_license_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) JOIN known ON form = {license_lookup.canonical_sql('line')} GROUP BY r)
SELECT doc_id, text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n_license_lines, 0) AS n_license_lines
FROM d LEFT JOIN w USING (r) LEFT JOIN n USING (r)""",
    "op9_sharding": f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h, coalesce(strlen(text), 0) AS size FROM documents),
b AS (SELECT depth, h >> (48 - depth) AS prefix, sum(size) AS bytes, count(*) AS n FROM d, (SELECT unnest(range(0, 41)) AS depth) GROUP BY 1, 2),
f AS (SELECT * FROM b WHERE bytes <= {SHARD_BYTES} OR n = 1)
SELECT doc_id, CAST(depth AS INTEGER) AS depth, prefix, CAST(bytes AS BIGINT) AS shard_bytes, n AS shard_rows
FROM (SELECT doc_id, f.*, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM d JOIN f ON f.prefix = d.h >> (48 - f.depth))
WHERE k = 1""",
    "op11_merkle_dataset_manifest": f"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents),
l AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(f'translate(text, {_CAPS})')} ELSE {_leaf_sql('text')} END AS claim FROM d),
n AS (SELECT r, lang, 0 AS lvl, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h,
        count(*) OVER (PARTITION BY lang) AS size FROM l
    UNION ALL SELECT NULL, lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (size + 7) // 8 FROM n WHERE size > 1
        GROUP BY lang, lvl, pos // 8, size),
t AS (SELECT lang, lvl, h FROM n WHERE size = 1),
m AS (SELECT lang, 0 AS lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS size FROM t
    UNION ALL SELECT NULL, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (size + 7) // 8 FROM m WHERE size > 1
        GROUP BY lvl, pos // 8, size),
p AS (SELECT n.r, n.lang, n.lvl, pos, size, claim AS h, '' AS sib FROM n JOIN l ON n.r = l.r
    UNION ALL SELECT p.r, p.lang, p.lvl + 1, p.pos // 8, (p.size + 7) // 8,
        sha256(string_agg(CASE WHEN n.pos = p.pos THEN p.h ELSE n.h END, '' ORDER BY n.pos)),
        p.sib || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> p.pos), '')
        FROM p JOIN n ON n.lang IS NOT DISTINCT FROM p.lang AND n.lvl = p.lvl AND n.pos // 8 = p.pos // 8 WHERE p.size > 1
        GROUP BY p.r, p.lang, p.lvl, p.pos, p.size, p.sib),
o AS (SELECT p.r, m.lvl, m.pos, m.size, p.h, p.sib FROM p JOIN m ON p.size = 1 AND m.lvl = 0 AND m.lang IS NOT DISTINCT FROM p.lang
    UNION ALL SELECT o.r, o.lvl + 1, o.pos // 8, (o.size + 7) // 8,
        sha256(string_agg(CASE WHEN m.pos = o.pos THEN o.h ELSE m.h END, '' ORDER BY m.pos)),
        o.sib || coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos <> o.pos), '')
        FROM o JOIN m ON m.lvl = o.lvl AND m.pos // 8 = o.pos // 8 WHERE o.size > 1 GROUP BY o.r, o.lvl, o.pos, o.size, o.sib),
top AS (SELECT h FROM m WHERE size = 1)
SELECT doc_id, leaf, t.h AS subroot, top.h AS root, sha256(o.sib) AS proof_sha256, o.h AS folded_root, o.h = top.h AS verified
FROM l JOIN o ON l.r = o.r AND o.size = 1 JOIN t ON t.lang IS NOT DISTINCT FROM l.lang, top""",
    "op12_ranked_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM (SELECT q, item_id, unnest(w) AS term FROM i) JOIN tf USING (term) JOIN df USING (term), c GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}

QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_suffix_array_dedup, op3_benchmark_decontamination, op4_embedding_near_dedup, op5_packing,
    op6_token_id_output, op7_simhash_near_dedup, op8_license_scans, op9_sharding, op10_toxicity,
    op11_merkle_dataset_manifest, op12_ranked_lexical_search, op13_pii)}
