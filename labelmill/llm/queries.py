"""One registered query per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.session import durable

from . import chat, common, decontaminate, langid, licenses, lines, packing, secrets, simhash, suffix, topk, vectorcodes, whiten, wrappers


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    learned = langid.fit(docs.filter(F.coalesce(~held_out(), F.lit(True))))
    return langid.predict(docs, *learned).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.examples(turns))


def op4_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(_table(spark, folder, "pages"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return licenses.licences(spark, docs)


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op9_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


def op11_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_whiten(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whiten(_table(spark, folder, "embeddings"))


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vectorcodes.compress(_table(spark, folder, "embeddings"))
    coded = durable(coded)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: Scores of all pairs of a query and a candidate, and of each query the five highest.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

#: Blocks of the article, cut at its block tags, with the references that the given pages hold.
ARTICLE_SQL = r"""
WITH blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(
      regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
      lambda b: trim(regexp_replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'),
                                    '\s+', ' ', 'g'))) AS b
  FROM pages
), texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""

#: Shingles of items and documents joined by value; each item's share that a document holds.
LEAK_SQL = r"""
WITH item_words AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(text), '[a-z0-9ªµº\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w
  FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item, item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT *, least(5, len(w)) AS k FROM item_words WHERE len(w) > 0))
), sizes AS (SELECT item, count(*) AS n FROM item_shingles GROUP BY 1),
doc_words AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(lower(text), '[a-z0-9ªµº\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+') AS w
  FROM documents
), doc_shingles AS (
  SELECT doc, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM doc_words CROSS JOIN (SELECT DISTINCT k FROM item_shingles))
), shared AS (
  SELECT doc, doc_id, item, item_id, count(DISTINCT s) AS m FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n AS item_shingles, m AS shared_shingles, m::DOUBLE / n::DOUBLE AS containment
FROM shared JOIN sizes USING (item) WHERE m >= 0.8 * n - 1e-9"""

#: Lines with their keys; a line goes where its key's smallest document is another one.
LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeats AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (SELECT k.*, coalesce(r.first <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN repeats r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds as one common table expression each: nearest entry of every part, then floors of means."""
    steps = [f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v,
    row_number() OVER (ORDER BY vec_id) AS k
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, k, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
  FROM whole, range({parts}) AS parts(p)
), book0 AS MATERIALIZED (SELECT p, k - 1 AS entry, x AS c FROM part WHERE k <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT k, p, arg_min(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d
  FROM (SELECT k, p, entry, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) AS d
        FROM part JOIN book{i} USING (p)) GROUP BY k, p)""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT p, entry, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS c FROM (
      SELECT p, entry, i, count(*) AS n, sum(y) AS s
      FROM (SELECT p, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM part JOIN near{i} USING (k, p))
      GROUP BY p, entry, i) GROUP BY p, entry) m USING (p, entry))""")
    steps.append(f"""coded AS (
  SELECT k, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY k
), numbers AS (
  SELECT p, entry, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book{rounds}
), digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM numbers)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole JOIN coded USING (k), digest""")
    return ", ".join(steps)


QUERIES = {
    "op1_langid": op1_langid, "op2_simhash": op2_simhash, "op3_chat": op3_chat, "op4_wrappers": op4_wrappers,
    "op5_decontaminate": op5_decontaminate, "op6_licenses": op6_licenses, "op7_topk": op7_topk, "op8_secrets": op8_secrets,
    "op9_suffix": op9_suffix, "op10_packing": op10_packing,
    "op11_lines": op11_lines, "op12_whiten": op12_whiten, "op13_codes": op13_codes}
ORACLES = {"op3_chat": chat.ORACLE, "op4_wrappers": ARTICLE_SQL, "op5_decontaminate": LEAK_SQL, "op7_topk": TOPK_SQL, "op11_lines": LINES_SQL,
           "op13_codes": _codes_sql()}
