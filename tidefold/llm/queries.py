"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, langid, merkle, mixing, quality, simhash, tokencounts, tokenfiles, toxicity, vectorcodes, winnow
from .common import crc32_mod, spread, table
from .sql import merkle_sql, vector_codes_sql


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts hold control strings, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digest(chat.format_chat(turns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.scan(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the documents that aren't held out."""
    docs = spread(table(spark, sf_dir, "documents"))
    model = langid.fit(docs, crc32_mod("doc_id", 3) != 1)
    held = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    rows = winnow.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", winnow.edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "packed", winnow.winnow(F.col("edited")).alias("of_edited"), "next_packed")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", winnow.to_string(F.col("packed")).alias("fingerprint"), winnow.to_string(F.col("of_edited")).alias("edited_fingerprint"),
        winnow.likeness(F.col("packed"), F.col("of_edited")).alias("near_edited"), winnow.likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return tokencounts.document_token_counts(spread(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of near-duplicates of every document."""
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed at 3, 1, 2 by source."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model of the labels that aren't held out."""
    learn = crc32_mod("doc_id", 4) != 2
    found = quality.score_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), learn)
    return found.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to compressed files and read back."""
    return tokenfiles.encode_and_read(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(spread(table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every whole vector, by codebooks of all of them."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model of the labels that aren't held out."""
    docs = spread(table(spark, sf_dir, "documents"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 3) != 1)
    held = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held, "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document in the tree of all, and what those whose text was changed fold up to."""
    return merkle.document_manifest(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 3) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_format, op2_decontaminate, op3_language_id, op4_fingerprints, op5_token_counts, op6_simhash, op7_mix_sources, op8_quality, op9_token_files, op10_html_text,
        op11_vector_codes, op12_toxicity, op13_merkle_manifest,
    )
}

ORACLE_SQL = {
    "op1_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, coalesce(role, '') AS said,
    coalesce(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '<next/>', '\m'), '</turn>', '\t'), ':', '\c'), '\z') AS head,
    length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '<next/>', '\m'), '</turn>', '\t')) AS len
  FROM t),
b AS (SELECT *, lag(head) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS prev FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(said || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(sum(CASE WHEN said = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN said = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
  CAST(sum(len + CASE WHEN head = prev THEN 7 ELSE 6 + length(head) + 8 END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id""",
    "op2_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10)::BIGINT AS n FROM bw WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi),
bg AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bp),
ns AS (SELECT DISTINCT n FROM bi),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dp),
h AS (SELECT d.doc_id, d.n, d.i, b.item_id FROM dg d JOIN bg b ON d.n = b.n AND d.g = b.g),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM h) x),
c AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) x GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c ON dw.doc_id = c.doc_id LEFT JOIN t ON dw.doc_id = t.doc_id""",
    "op7_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM d) AS budget FROM s),
r AS (SELECT a.source, a.source_size, a.weight, a.cap, a.k, a.cap / a.weight AS r,
    (a.budget - (SELECT coalesce(sum(b.cap), 0.0::DOUBLE) FROM w b WHERE b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.k < a.k)))
    / (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight > a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.k >= a.k)) AS level
  FROM w a),
g AS (SELECT source, source_size, k, CASE WHEN h.level <= r.r THEN h.level * r.weight ELSE r.cap END AS target
  FROM r, (SELECT level FROM r WHERE level <= r ORDER BY r, k LIMIT 1) h),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM d),
f AS (SELECT c.doc_id, c.size, g.source_size, g.target, g.k, p.p, (p.p * g.source_size + c.cum)::BIGINT / g.target AS finish
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source, (SELECT 0 AS p UNION ALL SELECT 1) p),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, k, size DESC ROWS UNBOUNDED PRECEDING) - size AS before FROM f)
SELECT doc_id, size, source_size, target,
  CAST(sum(greatest(0, least(size, (SELECT floor(1.5::DOUBLE * sum(size))::BIGINT FROM d) - before))) AS BIGINT) AS taken
FROM u GROUP BY doc_id, size, source_size, target""",
    # the tables' pages have their whole article in one <article> of paragraphs and headings: what is found by templates
    # must be its text; on other pages this wouldn't tell the article
    "op10_html_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1)[^>]*>|<br>', ' ', 'g'), '<[a-z/][^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t""",
    "op11_vector_codes": vector_codes_sql(),
    "op13_merkle_manifest": merkle_sql(),
}
