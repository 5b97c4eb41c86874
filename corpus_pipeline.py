"""The corpus pipeline: from raw documents to token shards.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last keep the columns of documents:

1. quality: documents that the classifier rejects (score under 0.7) go;
2. near_dedup: of each class of near copies (five words, 0.8) the smallest doc_id stays;
3. decontaminate: documents that hold a benchmark item (five words, 0.8) go;
4. mix: all documents, stored in the order that meets the sources' target weights;
5. tokens: token shards in the stored order; a row a document with its place in them.

The result is doc_id, start, n_tokens, ids_crc32: `start` counts the ids before the document
in the mixed order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.llm import decontaminate, mixing, neardup, quality, tokens
from prismgrid.llm.common import saved, scratch
from prismgrid.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it is fitted on a bounded sample of labels.

    Null texts are judged as empty, very long ones whole, repeated rows each by itself; null
    ids have no labels. Without labels of both classes, and of an empty table, all rows stay.
    """
    ship(spark)
    return quality.rejects(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    Documents without words (null or empty texts) are copies of nothing and stay. Of repeated
    rows one stays; of a class the row with the smallest id, null ids only if it has no other.
    Very long texts are compared whole. An empty table gives no rows.
    """
    ship(spark)
    return neardup.keep_one(docs, words=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Null and empty texts hold none; very long ones are searched whole. Repeated rows share
    their fate. Items without words match nothing; without items all rows stay.
    """
    ship(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their place in the mixed order; weights follow the square roots of the sources' sizes.

    A null source is a source of its own; null ids come first in theirs, repeated rows side by
    side. Texts, null, empty or very long, move as they are. An empty table gives no rows.
    """
    return mixing.in_mixed_order(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Places, lengths and checksums in the token shards, which hold the documents in their stored order.

    The stored order is that of the files' numbers and the rows in them. Documents that do
    not come straight from files are taken in order of doc_id. Null and empty texts have the
    end id alone; a very long text is encoded whole; repeated rows and null ids are rows of
    their own. An empty table gives no rows. path: where the shards stay.
    """
    import public_tokenizers

    ship(spark)
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        docs = docs.select("doc_id", "text", F.struct(part.alias("part"), F.col("_metadata.row_index").alias("row")).alias("place"))
    except AnalysisException:
        docs = docs.select("doc_id", "text", F.col("doc_id").alias("place"))
    return tokens.read(tokens.write(docs, str(public_tokenizers.path("word_bpe_49k.json")), order="place", path=path))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: SQL cannot express the classifier, the tokenizer or the checksums; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All stages over the documents table. path: a new folder for the token shards, which else go with the driver."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), keep=True)
    return saved(tokens_stage(spark, docs, sf_dir, path))
