"""The registered queries of these operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowhelm.llm import html_text, jaccard, language_id, lexical, minhash, mixing, packing, quality_knn, quality_rules, substring, tool_calls, topk, variants
from rowhelm.sources.tables import read_table


#: Target weights of the mixture by language.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
#: The mixture's size, in times the words of the documents.
MIXTURE = 1.25


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain, the language, of the labelled documents."""
    known = labels.select("doc_id").dropna().distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).dropna().join(known, "doc_id", "left_semi")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labelled = labelled_domains(docs, read_table(spark, sf_dir, "labels"))
    return mixing.rates(docs.select("doc_id", "text"), labelled, TARGETS, MIXTURE)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.learn(docs, read_table(spark, sf_dir, "labels"), fold(5) != 0)
    score = F.col("score")
    return quality_knn.scored(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(score >= quality_knn.THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, near=jaccard.components(docs).filter("n_shingles > 0"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The tools of ``chat_calls``.
CHAT_TOOLS = [
    ("reply", "prompt", "string", True),
    ("reply", "turn", "integer", True),
    ("reply", "language", "string", False),
]


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of the conversations: each user turn calls for a reply, which needs the call two turns before; the assistant's next turn is its result."""
    # a null conversation or turn gives a null id
    call_id = lambda shift: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - shift).cast("string"))
    users = conversations.filter("role = 'user'")
    calls = users.select(
        call_id(0).alias("call_id"),
        F.lit("reply").alias("name"),
        F.create_map(F.lit("prompt"), F.col("text"), F.lit("turn"), F.col("turn").cast("string")).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call_id(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.filter("role = 'assistant'").select(call_id(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(read_table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(CHAT_TOOLS, "name string, argument string, type string, required boolean")
    return tool_calls.link_calls(calls, results, schemas)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, fold(4) != 2)
    return language_id.identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.verdicts(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: One in so many words of a document loses a letter, as the contract asks.
TYPO_EVERY = 97


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.spelling_variants(docs, typo_every=TYPO_EVERY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_source_mixing, op2_substring_dedup, op3_ngram_jaccard, op4_topk_search, op5_quality_classifier,
        op6_best_fit_packing, op7_html_extraction, op8_chat_formatting, op9_language_id, op10_quality_rules,
        op11_lexical_search, op12_minhash_dedup, op13_spelling_variants,
    )
}

_ORDERED_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

_CHAT = """
WITH RECURSIVE calls AS (
  SELECT conv_id || ':' || turn AS call_id, turn, text, CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS needs
  FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, min(text) AS result, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1
), levels AS (
  SELECT call_id, 0 AS level FROM calls WHERE needs IS NULL OR needs NOT IN (SELECT call_id FROM calls)
  UNION ALL
  SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.needs = l.call_id
)
SELECT c.call_id, l.level, coalesce(r.n, 0) AS n_results, NOT e.lost AS valid,
       CASE WHEN e.lost THEN 'dependency:' || c.needs ELSE '' END AS errors,
       CAST(json_object('arguments', json_object('prompt', c.text, 'turn', CAST(c.turn AS VARCHAR)), 'id', c.call_id, 'name', 'reply', 'result', r.result) AS VARCHAR) AS json
FROM calls c JOIN levels l USING (call_id) LEFT JOIN results r USING (call_id)
JOIN (SELECT call_id, needs IS NOT NULL AND needs NOT IN (SELECT call_id FROM calls) AS lost FROM calls) e USING (call_id)
"""

_LEXICAL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM filled
), items AS (
  SELECT item_id, row_number() OVER (ORDER BY item_id, text) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT item_id, item, term, CAST(count(*) AS BIGINT) AS repeats FROM (SELECT item_id, item, unnest(t) AS term FROM items) GROUP BY ALL
), tf AS (
  SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(t) AS term FROM filled) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs
), s AS (
  SELECT item_id, item, doc_id, row,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN filled USING (row), total
  WHERE doc_id IS NOT NULL GROUP BY item_id, item, doc_id, row
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0
)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 10
"""

_MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), one AS (
  SELECT doc_id, unnest(s) AS s FROM s
), two AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM two JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), step AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, step.b FROM reach r JOIN step ON r.b = step.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""

ORACLES: dict[str, str] = {"op4_topk_search": _ORDERED_TOP_K, "op8_chat_formatting": _CHAT}
#: The SQL twins that read texts: tables documents and benchmark.
TEXT_ORACLES: dict[str, str] = {"op12_minhash_dedup": _MINHASH, "op11_lexical_search": _LEXICAL}
