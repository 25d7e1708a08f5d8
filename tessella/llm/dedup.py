"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at the rows that the level before left over, and only the last level hashes whole texts. What a
level leaves over is held as a sieve of bounded size that is broadcast, so no text is shuffled to decide; rows whose
length or prefix is unique never leave their scan task. A sieve may let too much through, never too little: the full
hash decides.

Defined cases: a null text counts as empty; a null id is smaller than any other; of rows with equal text and equal id
the one that stands last in the order of files and rows stays, so exactly one row of a group is kept; repeated rows count each in
``group_size``; an empty table gives an empty result; other columns, whatever their names, are passed through.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, drop_rows, hot_join, materialise, probe, reserve, sieve, with_row_id

PREFIX_CHARS = 64

_RID, _ID, _TEXT, _LEN, _PRE = OWN + "rid", OWN + "id", OWN + "text", OWN + "len", OWN + "pre"


def _survivors(rows: DataFrame, prefix_chars: int, bits: int | None) -> DataFrame:
    """``rows`` with a flag: false if no other row can have the same text by its length and prefix."""
    by_len = rows.groupBy(_LEN).count().where("count > 1").select(F.xxhash64(_LEN).alias("k"))
    rows = probe(rows, F.xxhash64(_LEN), sieve(by_len, "k", "lengths", bits), OWN + "l1")
    pre = rows.withColumn(_PRE, F.when(F.col(OWN + "l1"), F.xxhash64(F.col(_LEN), F.substring(_TEXT, 1, prefix_chars))))
    by_pre = pre.where(OWN + "l1").groupBy(_PRE).count().where("count > 1").select(F.col(_PRE).alias("k"))
    pre = pre.withColumn(_PRE, F.coalesce(F.col(_PRE), F.lit(0)))
    out = probe(pre, F.col(_PRE), sieve(by_pre, "k", "prefixes", bits), OWN + "l2")
    return out.withColumn(OWN + "open", F.col(OWN + "l1") & F.col(OWN + "l2")).drop(OWN + "l1", OWN + "l2", _PRE)


def _refine(df: DataFrame, id_col: str, text_col: str, prefix_chars: int, bits: int | None) -> tuple[DataFrame, DataFrame]:
    """All rows with a flag, and (rid, id, full hash) of the rows whose full text had to be hashed."""
    rows = with_row_id(reserve(df)).withColumn(_TEXT, F.coalesce(F.col(text_col), F.lit(""))).withColumn(_LEN, F.octet_length(_TEXT))
    rows = _survivors(rows.withColumn(_ID, F.col(id_col)), prefix_chars, bits)
    full = rows.where(OWN + "open").select(_RID, _ID, F.sha2(_TEXT, 256).alias("sha"))
    return rows, materialise(full, "full-hashes")


def _groups(full: DataFrame) -> DataFrame:
    """One row for each full hash, aggregated on the map side."""
    return materialise(full.groupBy("sha").agg(F.max(F.struct(_ID, _RID)).alias("best"), F.count(F.lit(1)).alias("n")), "groups")


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, sieve_bits: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows, full = _refine(df, id_col, text_col, prefix_chars, sieve_bits)
    several = hot_join(full, _groups(full), "sha", "n").select(
        F.col(_ID).alias(id_col),
        F.col("best")[_ID].alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col(_RID) == F.col("best")[_RID]).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    single = rows.where(~F.col(OWN + "open")).select(
        F.col(_ID).alias(id_col), F.col(_ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(_TEXT, 256).alias("text_sha256")
    )
    return single.unionByName(several)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, sieve_bits: int | None = None) -> DataFrame:
    """The input rows, with their columns, without those that have an equal text with a larger id."""
    rows, full = _refine(df, id_col, text_col, prefix_chars, sieve_bits)
    losers = materialise(hot_join(full, _groups(full), "sha", "n").where(F.col(_RID) != F.col("best")[_RID]).select(_RID), "losers")
    return drop_rows(rows.select(*df.columns, _RID), _RID, losers, "losers-sieve").select(*df.columns)
