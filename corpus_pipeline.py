"""The corpus pipeline: quality rules, exact deduplication, n-gram Jaccard join, mixing, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.

Every stage takes only the columns of ``documents`` (other columns of the input are left out, whatever their names), works on
whole texts of any length, treats rows with null or equal doc_ids as rows like others, and gives no rows for no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.llm import bpe, dedup, mixing, ngram_join, quality
from cinderloom.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts (under ten words) go.  Rows are judged one by one, so equal rows stay or go together.
    """
    return quality.judged(quality.measures(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the least doc_id.

    A null doc_id comes last, and of rows that differ in nothing the first in file order stays.  Null counts as empty, so at
    most one document without words is left.
    """
    return dedup.deduplicated(spark, docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-gram similarity of 0.8 or more connects: the least doc_id (null last, then file order).

    Groups are told apart by their texts, so a doc_id on different texts loses none of them.  Documents without words stay.
    """
    return ngram_join.distinct_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole; where it takes a part more, that part follows once.

    A part is the head of the text, cut after the words that are taken.  Null texts and texts without words have nothing to
    take and give no rows; a null source is a source of its own.  Equal rows are as good as each other, and reruns take the same.
    """
    taken = mixing.mix(docs.select(*COLUMNS), *COLUMNS)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.greatest(rest, F.lit(1)).cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    copies = F.array_repeat(F.col("text"), whole)
    texts = F.when(rest > 0, F.concat(copies, F.array(head))).otherwise(copies)
    rows = taken.select(*(c for c in COLUMNS if c != "text"), F.explode(texts).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each text, and the sha256 of the text decoded from the ids.

    A null or empty text has no ids and decodes to the empty text.  Each row gives a row.
    """
    path = bpe.vocabulary_path()
    rows = bpe.encode(docs.select(*COLUMNS), bpe.build_lexicon(docs, path), path, check=True)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encoding", bpe_encoding),
]

#: BPE ids can't be made in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
