"""A corpus pipeline: quality, line dedup, near dedup, mixing, packing. Each stage reads what the one before wrote.

All stages take null ids (the largest id), null and empty texts (no words), texts of any length, repeated rows, further columns under any names, and empty
tables, which give empty ones. What each does with them is said below; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracube.llm.line_dedup import COUNTS, dedup_lines
from terracube.llm.mixing import mixed_documents
from terracube.llm.near_dedup import near_duplicates
from terracube.llm.packing import pack
from terracube.llm.quality import RESULTS, score_quality
from terracube.llm.shared import NO_ID, free_name, set_aside
from terracube.sources.scratch import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Every row is judged by its own text, so repeated rows stay or go together; a null or empty text has no word
    that speaks against it and none for it, and a very long one is judged whole."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    free, own = set_aside(docs, RESULTS)
    return score_quality(free, labels).where("keep").select(*own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the new text. Repeated rows of one id are one document: all keep their lines.
    A null text stays null, a document that loses all its lines stays with an empty text."""
    free, own = set_aside(docs, COUNTS)
    return dedup_lines(free).withColumn("n_chars", F.length("text").cast("long")).select(*own)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id; texts without words are classes of their own. Of rows that repeat the kept id and text the
    one whose columns have the least hash stays, so that the same rows go on in every run."""
    key, text_key = free_name(docs, "_id"), free_name(docs, "_hash")
    kept = near_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_hash").alias(text_key)).distinct()
    keyed = docs.withColumns({key: F.coalesce("doc_id", F.lit(NO_ID)), text_key: F.xxhash64(F.coalesce("text", F.lit("")))})
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash and no order
    one = keyed.join(kept, [key, text_key], "left_semi").groupBy(key, text_key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias(free_name(docs, "_row")))
    return one.select(f"{free_name(docs, '_row')}.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; of what is taken in part, each run of chosen words is a row, and n_chars follows. Texts without words are
    in no mix. A null source is a source of its own."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with every source's share in each window. Each row is a document with its end mark, repeated ones too; a null or empty text is the
    mark alone; a very long one goes through as many sequences as it needs."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("packing", packed)]

#: No SQL expresses a trained classifier or a tokenizer; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
