"""Registered queries: cleaning, chapters, tokens and n-grams."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators import labeling
from labelmill.operators.prepare import clean_html
from labelmill.plans import standins as S
from labelmill.sources.readers import read_table

MAX_TOKENS = 512
TOP_NGRAMS = 1000


def clean_text(spark, sf):
    cleaned = S.documents(spark, sf).select("doc_id", X.clean(F.col("text")).alias("text"))
    return cleaned.select("doc_id", F.md5("text").alias("md5"), F.length("text").alias("length"))


def doc_chapters(spark, sf):
    return S.documents(spark, sf).select(
        "doc_id", F.posexplode_outer(X.chapters(F.col("text")))).select(
        "doc_id", (F.col("pos") + 1).alias("chapter"), F.length("col").alias("length"))


def prepare_dataset(spark, sf):
    """All documents, each chapter cleaned on its own; labels are null where there are none. Cleaned before
    the join on the id: only digests are shuffled."""
    cleaned = S.documents(spark, sf).select(
        "doc_id", F.md5(X.join_chapters(X.chapters(F.col("text")), clean_html)).alias("md5"))
    names = labeling.decode(F.array("quality", "toxic"), S.DOCS)
    encoded = F.when(F.col("quality").isNotNull(), F.array_join(labeling.encode(names, S.DOCS), ""))
    return cleaned.join(read_table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "md5", encoded.alias("labels"))


def _tokens(spark, sf):
    return S.documents(spark, sf).select("doc_id", X.tokens(F.col("text")).alias("tokens"))


def tokenize(spark, sf):
    return _tokens(spark, sf).select(
        "doc_id", F.size("tokens").alias("tokens"),
        F.size(F.array_distinct("tokens")).alias("distinct_tokens"))


def truncate_tokens(spark, sf):
    return _tokens(spark, sf).select("doc_id", X.truncate(F.col("tokens"), MAX_TOKENS).alias("t")).select(
        "doc_id", "t.kept", "t.dropped", "t.padded")


#: Terms that a worker counts before it hands them on.
COUNTED_TERMS = 500_000


def _count_grams(batches):
    """Batches of token lists to batches of (term, count) over many documents at a time."""
    counts = Counter()

    def counted():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "count"])

    for batch in batches:
        for tokens in batch.column(0):
            if tokens.is_valid:
                words = tokens.values.to_numpy(zero_copy_only=False).tolist()
                counts.update(words)
                counts.update(map(" ".join, zip(words, words[1:])))
                counts.update(map(" ".join, zip(words, words[1:], words[2:])))
            if len(counts) > COUNTED_TERMS:
                yield counted()
                counts.clear()
    yield counted()


def ngrams(spark, sf):
    """The 1,000 most frequent n-grams of one to three tokens. Tokens hold no space, so a term says its n."""
    grams = _tokens(spark, sf).select("tokens").mapInArrow(_count_grams, "term string, count long")
    return (
        grams.groupBy("term").agg(F.sum("count").alias("count"))
        .select((F.length("term") - F.length(F.replace("term", F.lit(" "))) + 1).alias("n"), "term", "count")
        .orderBy(F.col("count").desc(), "n", "term").limit(TOP_NGRAMS)
    )


def classify_text_rules(spark, sf):
    return (S.documents(spark, sf).select(X.classify(F.col("text")).alias("rule"))
            .groupBy("rule").agg(F.count("*").alias("docs")))


QUERIES = {f.__name__: f for f in (
    clean_text, doc_chapters, prepare_dataset, tokenize, truncate_tokens, ngrams, classify_text_rules)}

DROPPED_SQL = r"""[^\p{L}\p{N}_\s.,!?"''\x0b\x1c-\x1f\x{85}\p{Z}]"""
_HTML_STEPS = [
    (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<head\b[^>]*>.*?</head>", " "),
    (r"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|"
     r"strong|sub|sup|tt|u|var)(?:\s[^>]*)?>", ""),
    (r"(?s)<[^>]*>", " "),
]
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def html_text_sql(column: str) -> str:
    sql = column
    for pattern, by in _HTML_STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"
    for entity, character in _ENTITIES:
        sql = f"replace({sql}, '{entity}', '{character}')"
    return f"trim(regexp_replace({sql}, '[\\s\\x0b]+', ' ', 'g'))"


def clean_sql(column: str) -> str:
    return f"regexp_replace(lower({column}), '{DROPPED_SQL}', '', 'g')"


_WORDS = f"words AS (SELECT doc_id, regexp_extract_all(lower(text), '{S.TOKEN_SQL}') AS tokens FROM documents)"

ORACLES = {
    "clean_text": f"""SELECT doc_id, md5(t) AS md5, CAST(length(t) AS INT) AS length
        FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents)""",
    "doc_chapters": r"""SELECT doc_id, CAST(i AS INT) AS chapter, CAST(length(c[i]) AS INT) AS length
        FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents))""",
    "prepare_dataset": f"""SELECT doc_id, md5(array_to_string([{clean_sql(html_text_sql('x'))}
            for x in string_split(text, chr(10))], ' ')) AS md5, quality::VARCHAR || toxic::VARCHAR AS labels
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "tokenize": f"""WITH {_WORDS} SELECT doc_id, CAST(len(tokens) AS INT) AS tokens,
        CAST(len(list_distinct(tokens)) AS INT) AS distinct_tokens FROM words""",
    "truncate_tokens": f"""WITH {_WORDS} SELECT doc_id, CAST(least(len(tokens), {MAX_TOKENS}) AS INT) AS kept,
        CAST(greatest(len(tokens) - {MAX_TOKENS}, 0) AS INT) AS dropped,
        CAST(greatest({MAX_TOKENS} - len(tokens), 0) AS INT) AS padded FROM words""",
    "ngrams": f"""WITH {_WORDS},
        spots AS (SELECT doc_id, unnest(tokens) AS w, unnest(range(1, len(tokens) + 1)) AS i FROM words),
        runs AS (SELECT w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spots
                 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        grams AS (SELECT 1 AS n, w AS term FROM runs
                  UNION ALL SELECT 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
                  UNION ALL SELECT 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL)
        SELECT n, term, count(*) AS count FROM grams GROUP BY n, term
        ORDER BY count DESC, n, term LIMIT {TOP_NGRAMS}""",
    "classify_text_rules": r"""SELECT CASE
            WHEN regexp_matches(text, '^Translation into ([^\n\r]*?) available:\s*([^\n\r]*)\s*by\s*([^\n\r]*?)\s*') THEN 'translation_into'
            WHEN regexp_matches(text, '^A translation of\s*([^\n\r]*?)\s*by\s*([^\n\r]*?)\.\s*') THEN 'translated_from'
            WHEN regexp_matches(text, '^For\s*([^\n\r]*)\.') THEN 'gift_for'
            WHEN regexp_matches(text, '^Inspired by\s*([^\n\r]*?)\s*by\s*([^\n\r]*?)\.\s*') THEN 'inspired_by'
            ELSE 'unmatched' END AS rule, count(*) AS docs FROM documents GROUP BY 1""",
}
