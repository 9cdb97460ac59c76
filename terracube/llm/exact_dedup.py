"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_group_stats, stash

SPACES = r"[\x20\x09-\x0D]+"


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), digest: str | None = None, prefix_chars: int = 256, cells: int | None = None) -> DataFrame:
    """Group the rows whose texts are identical but for white space.

    Returns one row per input row: ``id_col``, the ``carry`` columns, ``keep_id``, ``group_size``, ``kept``, and with ``digest`` a column of that name,
    the text's full hash (SHA-256 in hex, without white space) for every row. Of a group, the row with the most code points in the original text stays,
    then the smallest id.

    How it refines: the first scan counts the lengths of the texts without white space. A second one counts the hashes of the first ``prefix_chars`` of the
    texts whose length came up again; what is left after it, texts of one length and one prefix, is read again and grouped by the full hash. Rows learn that they
    are left from broadcast sets of cell numbers (a hash of the length, or of length and prefix, modulo 16 times the number of repeated ones, 2^20 at least
    and 2^22 at most): a false hit lets a row into the next step that could have been left out and changes no result. No text is ever shuffled, only ids,
    lengths and hashes are.

    A null text counts as empty, and all empty texts are one group. A null id sorts last. Repeated rows are rows of their own: exactly one of a
    group is kept. Very long texts are hashed in place. Hot groups are joined with salted keys. Columns that are not named are not read; an empty table gives no rows.
    """
    base = df.select(F.col(id_col), *[F.col(c) for c in carry], F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"), without_spaces(F.col(text_col)).alias("_text"))
    sized = base.withColumn("_len", F.length("_text"))
    lengths = stash(sized.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    among = _among(sized, lengths, ["_len"], "_again", cells)
    # only these are hashed
    profiled = among.withColumn("_prefix", F.when(F.col("_again"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    again = stash(profiled.where("_again").groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    rows = _among(profiled, again, ["_len", "_prefix"], "_hit", cells)
    full = F.unhex(F.sha2("_text", 256))
    if digest:
        rows = rows.withColumn("_sha", full)
        full = F.col("_sha")
    extra = [F.lower(F.hex(full)).alias(digest)] if digest else []
    rows = stash(rows.select(id_col, *carry, *extra, "_chars", F.when(F.col("_hit"), full).alias("_full"), F.monotonically_increasing_id().alias("_row")))

    rank = F.struct((-F.col("_chars")).alias("c"), F.col(id_col).isNull().alias("u"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    left = rows.where("_full is not null")
    groups = stash(left.groupBy("_full").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("_best")).where("group_size > 1"))
    repeated = join_group_stats(left, groups, ["_full"], "group_size", max(1, rows.count()))
    single = rows.where("_full is null").withColumns({"group_size": F.lit(None).cast("long"), "_best": F.lit(None).cast(groups.schema["_best"].dataType)})
    best = F.col("_best")
    return repeated.unionByName(single).select(
        id_col,
        *carry,
        *([digest] if digest else []),
        F.when(best.isNull(), F.col(id_col)).otherwise(best["id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (best.isNull() | (best["row"] == F.col("_row"))).alias("kept"),
    )


def _among(rows: DataFrame, repeated: DataFrame, keys: Sequence[str], name: str, cells: int | None) -> DataFrame:
    """A column ``name``: true where the row's cell is that of one of the ``repeated`` keys, else null."""
    cells = cells or min(1 << 22, max(1 << 20, 16 * repeated.count()))
    cell = F.pmod(F.xxhash64(*keys), F.lit(cells)).alias("_cell")
    hits = F.broadcast(repeated.select(cell).distinct().withColumn(name, F.lit(True)))  # 2^22 numbers at most
    return rows.withColumn("_cell", cell).join(hits, "_cell", "left").drop("_cell")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs, digest="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
