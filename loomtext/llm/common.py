"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved, shared_dir

__all__ = ["SPACE", "WORD", "ascii_lower", "fold", "gathered", "saved", "shared_dir", "sized", "table", "wrapped"]

#: Words of several contracts: runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a file of a narrow table, and the files that any such table may have.
FILE_ROWS, FEW = 50_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, a saved table of narrow rows, with a broadcast hint if it has at most ``most`` rows; else joins with it shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def gathered(df: DataFrame, most: int, each: int = FILE_ROWS) -> DataFrame:
    """df, saved; its rows are narrow and ``most`` at most, so it gets a file for each ``each`` of them (FEW anyway), not one for every partition of a shuffle: a file costs a store and an executor far more than a few rows do."""
    return saved(df.coalesce(max(FEW, -(-most // each))))


def wrapped(documents: DataFrame) -> DataFrame:
    """The whole row as one column beside its id and key, so that no column of the caller can clash: row_, id_, dk_."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row_"), F.col("doc_id").alias("id_"), F.xxhash64("doc_id", "text").alias("dk_"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; every other letter keeps its case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id is in no held-out fold (-1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(-1))
