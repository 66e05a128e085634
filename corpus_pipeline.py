"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixture, packing.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents.

1. ``quality_rules`` rejects documents by the base rules and the learned list.
2. ``ngram_jaccard`` keeps one document of each group of near-duplicates.
3. ``substring_dedup`` takes repeated passages out of the texts; a document of which nothing is left goes.
4. ``source_mixing`` repeats documents so that the languages reach their target weights. Every document
   stays at least once: no rate is below 1, a language without a target keeps its share, and the mixture is as
   large as the largest share over its target asks for.
5. ``best_fit_packing`` packs what there is into sequences; repeats of a document don't share one.

An empty table passes through all stages. Extra columns of the documents, whatever their names, pass
through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowhelm.llm import jaccard, mixing, packing, quality_rules, substring
from rowhelm.llm.columns import sealed
from rowhelm.llm.queries import MIXTURE, TARGETS, labelled_domains
from rowhelm.llm.storage import stored
from rowhelm.sources.tables import read_table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried, opened = sealed(docs, "doc_id", "text", "n_chars")
    chars = carried.schema["n_chars"].dataType
    cut = substring.remove_repeats(carried, untouched=True).filter("n_removed = 0 or n_removed < n_words")
    return opened(cut, text=F.col("kept_text"), n_chars=F.length("kept_text").cast(chars))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = labelled_domains(docs, read_table(spark, sf_dir, "labels"))
    return mixing.resample(docs, labelled, TARGETS, MIXTURE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: The learned list, the fitted rates and best fit can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
