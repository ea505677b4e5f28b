"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. Rows without a doc_id pass the stages that work on ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import decontamination, language_id, near_dedup, sentencepieces, substring_dedup
from tidewave.llm._shared import Scratch, fresh

#: A document is rejected if no language is told, or none with this probability.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text. Languages are learned from the documents that name theirs.

    Null texts and texts without a letter go. Repeated rows stay or go together, as only text is judged; equal probabilities
    count for the first name. Columns of any name stay as they are.
    """
    lang, score = fresh("lang_pred", docs), fresh("lang_score", docs)
    found = language_id.predict(docs, language_id.train(docs.select("text", "lang")), names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; one row of each doc_id.

    Of several rows of a doc_id that with the least text stays, of equal texts that whose columns come first as JSON. Null
    and wordless texts are no duplicates of anything.
    """
    gone, twice = fresh("_gone", docs), fresh("_twice", docs)
    lost = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=80).where("not kept").select(F.col("doc_id").alias(gone))
    out = docs.join(lost, docs["doc_id"] == lost[gone], "left_anti")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice))
    if several.isEmpty():
        return out
    whole = F.struct(*docs.columns)
    once = out.join(several, out["doc_id"] == several[twice], "left_semi").groupBy(F.col("doc_id").alias(twice)).agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias(gone))
    return out.join(several, out["doc_id"] == several[twice], "left_anti").unionByName(once.select(f"{gone}.*"))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that an earlier document has; n_chars is counted anew.

    Documents of which nothing is left go; null and empty texts stay, as do all rows without doc_id. Columns of any name
    stay as they are.
    """
    out = substring_dedup.strip_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark: fewer than 80 of 100 of the 5-word shingles of each.

    Null and empty texts, texts shorter than any item and rows without doc_id stay; of repeated rows of a doc_id all go if
    one holds an item. Columns of any name stay as they are.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens and round_trip of each document.

    Null texts have null tokens, empty ones none; repeated rows come as often. Other columns stay out.
    """
    return sentencepieces.encoded(docs, keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: Fitted language models and the encoding are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
