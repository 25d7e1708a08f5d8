"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (id, checksum, size); a keyed permutation of 0..n-1 moves row i to place p(i);
place p is slot ``p div shards`` of shard ``p mod shards``. The permutation is arithmetic, so the shard and slot of any
row number, and the row number of any shard and slot, are computed without reading data (``place`` and ``row_at``).
Law: ``rows``. Shard sizes differ by one at most and slots have no gaps.

The Feistel network works on pairs (l, r) with l < a and r < b, a = ceil(sqrt(n)), b = ceil(n / a). It permutes 0..a*b-1,
fewer than a numbers of which are n or more; a number that lands there is permuted again until it is below n (cycle
walking). How often that can happen for this n and key is found beforehand from those fewer than sqrt(n) numbers.

Defined cases: a null text has size 1 and checksum 0; null ids come first; rows that agree in id, checksum and size may
trade places; an empty table gives an empty result; other columns are ignored by ``shard`` whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

ROUNDS = 4
KEY = "tessella"


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + (math.isqrt(max(n - 1, 0)) ** 2 < n))
    return a, max(1, -(-n // a))


def _mix(x: str, k: str) -> str:
    """48 bits of MD5: the same in any engine."""
    return f"cast(conv(substr(md5(concat({k}, ':', {x})), 1, 12), 16, 10) as bigint)"


def _keys(key: str, rounds: int) -> list[str]:
    return [f"{key}-{i}" for i in range(rounds)]


def permute(x: str, n: int, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """The network on 0..a*b-1, as an expression over column ``x``."""
    a, b = _sides(n)
    keys = ", ".join(f"'{k}'" for k in _keys(key, rounds))
    left = f"(s.l + {_mix('s.r', "concat(k, 'l')")}) % {a}"
    return F.expr(
        f"aggregate(array({keys}), named_struct('l', {x} div {b}, 'r', {x} % {b}),"
        f" (s, k) -> transform(array(named_struct('l', {left}, 'r', s.r)),"
        f" t -> named_struct('l', t.l, 'r', (t.r + {_mix('t.l', "concat(k, 'r')")}) % {b}))[0],"
        f" s -> s.l * {b} + s.r)"
    )


def unpermute(x: str, n: int, key: str = KEY, rounds: int = ROUNDS) -> Column:
    a, b = _sides(n)
    keys = ", ".join(f"'{k}'" for k in reversed(_keys(key, rounds)))
    right = f"pmod(s.r - {_mix('s.l', "concat(k, 'r')")}, {b})"
    return F.expr(
        f"aggregate(array({keys}), named_struct('l', {x} div {b}, 'r', {x} % {b}),"
        f" (s, k) -> transform(array(named_struct('l', s.l, 'r', {right})),"
        f" t -> named_struct('l', pmod(t.l - {_mix('t.r', "concat(k, 'l')")}, {a}), 'r', t.r))[0],"
        f" s -> s.l * {b} + s.r)"
    )


def longest_walk(spark: SparkSession, n: int, key: str = KEY, rounds: int = ROUNDS, back: bool = False) -> int:
    """Most extra steps that a number below n needs to come back below n."""
    a, b = _sides(n)
    if n < 1 or a * b == n:
        return 0
    there, home = (unpermute, permute) if back else (permute, unpermute)
    out = spark.range(n, a * b).withColumn("from", home("id", n, key, rounds)).where(F.col("from") < n).select("id")
    steps = 0
    while out.limit(1).count():
        steps += 1
        out = materialise(out.select(there("id", n, key, rounds).alias("id")).where(F.col("id") >= n), "walk")
    return steps


def _walk(df: DataFrame, x: str, out: str, n: int, steps: int, step) -> DataFrame:
    df = df.withColumn(out, step(x, n))
    for _ in range(steps):
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(step(out, n)))
    return df


def place(df: DataFrame, row: str, out: str, n: int) -> DataFrame:
    """Add the place of each row number."""
    return _walk(df, row, out, n, longest_walk(df.sparkSession, n), permute)


def row_at(df: DataFrame, at: str, out: str, n: int) -> DataFrame:
    """Add the row number of each place: the inverse of ``place``."""
    return _walk(df, at, out, n, longest_walk(df.sparkSession, n, back=True), unpermute)


def number_rows(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """Add global row numbers in the given total order; also the number of rows.

    Rows are sorted in range partitions, never in one task; the offsets of the partitions are as many as the
    partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"__tsl_part": F.spark_partition_id(), "__tsl_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = materialise(ranged, "ranged")
    sizes = ranged.groupBy("__tsl_part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    offsets = sizes.select(F.col("__tsl_part").alias("part"), (F.sum("n").over(W.orderBy("__tsl_part")) - F.col("n")).alias("start"))
    numbered = ranged.join(F.broadcast(offsets), ranged["__tsl_part"] == offsets["part"])
    n = ranged.count()
    return numbered.withColumn(out, F.col("start") + F.col("__tsl_pos")).drop("__tsl_part", "__tsl_pos", "part", "start"), n


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``), one row per input row."""
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"], "__tsl_row")
    placed = place(numbered, "__tsl_row", "__tsl_place", n)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__tsl_place") % shards).cast("int").alias("shard"),
        F.expr(f"__tsl_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
