"""Pieces that several operators share: scratch tables, stable row ids, sieves of bounded size, joins with hot keys."""
from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import hot_join  # noqa: F401
from ..plans.scratch import cut as materialise
from ..plans.scratch import drop as drop_materialised  # noqa: F401
from ..plans.scratch import shared_dir, ship  # noqa: F401

#: Prefix of the columns that operators add for themselves. Input columns are renamed never, so
#: an input column that begins with it is refused by ``reserve``.
OWN = "__tsl_"
#: Bits of a sieve: about sixteen for a key, between these bounds. At most 2**28 / 64 rows of two longs (64 MB as rows,
#: about 160 MB as a hash relation) are broadcast, however large the corpus is; up to some 30 million keys it rejects
#: seven of eight strangers. A fuller sieve lets more through, which costs a shuffle of what it lets through, not rows.
LEAST_BITS, MOST_BITS = 16, 28
#: A row id is the number of the file and the number of the row in it.
ROW_BITS = 36


class Sieve(NamedTuple):
    words: DataFrame
    bits: int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reserve(df: DataFrame) -> DataFrame:
    if clash := [c for c in df.columns if c.startswith(OWN)]:
        raise ValueError(f"columns {clash} begin with the reserved prefix {OWN!r}")
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex[:12]}-{name}"


def with_row_id(df: DataFrame, name: str = OWN + "rid") -> DataFrame:
    """A row id that is the same in every plan over these files, however they are split: number of the file (in the order
    of the paths) and of the row in it, as the Parquet reader knows them.

    A frame that is not a plain scan of Parquet files is written to the shared folder first, else a second evaluation
    could number its rows in another way. The paths are the only thing that the driver sees: one string for a file.
    """
    if not _plain(df):
        df = materialise(df, "rows")
    at = df.metadataColumn("_metadata")
    paths = sorted(r[0] for r in df.select(at["file_path"]).distinct().collect())
    row = at["row_index"].cast("long")
    if len(paths) <= 1:
        return df.withColumn(name, row)
    spark, path, number = df.sparkSession, OWN + "path", OWN + "file"
    # One literal, as paths are URL-encoded and hold no line feed: a local table of Python rows would be made by workers.
    files = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(paths)), "\n")).alias(number, path))
    found = df.withColumns({name: row, OWN + "at": at["file_path"]})
    found = found.join(F.broadcast(files), found[OWN + "at"] == files[path], "left")
    known = F.coalesce(number, F.raise_error(F.lit("a file was added while it was read")).cast("int"))
    return found.withColumn(name, F.shiftleft(known.cast("long"), ROW_BITS) + F.col(name)).drop(OWN + "at", path, number)


def _plain(df: DataFrame) -> bool:
    """Whether the frame is a scan of Parquet files, each of them once, with filters and projections at most."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation"):
        return False
    relation = plan.relation()
    if "HadoopFsRelation" not in relation.getClass().getSimpleName() or relation.fileFormat().toString() != "Parquet":
        return False
    files = df.inputFiles()
    return 0 < len(files) == len(set(files))


def bit(key: Column, bits: int) -> Column:
    """The sieve's bit number of a 64-bit hash."""
    return F.shiftrightunsigned(key, 64 - bits)


def sieve(keys: DataFrame, key: str, name: str, bits: int | None = None) -> Sieve:
    """A set of the 64-bit hashes in ``key`` as (word, mask) rows, sized by their number.

    It holds every given hash and some others, so what it rejects is certainly absent.
    """
    if bits is None:
        if not _plain(keys):
            keys = materialise(keys.select(key), f"{name}-keys")
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, keys.count()))) + 4))
    words = (
        keys.select(bit(F.col(key), bits).alias("at"))
        .select(F.expr("at >> 6").alias(OWN + "word"), F.expr("1L << cast(at & 63 as int)").alias("m"))
        .groupBy(OWN + "word")
        .agg(F.bit_or("m").alias(OWN + "mask"))
    )
    return Sieve(materialise(words, name), bits)


def probe(df: DataFrame, key: Column, held: Sieve, flag: str) -> DataFrame:
    """Add ``flag``: false only if the hash is certainly not in the sieve, which is broadcast."""
    words = held.words
    out = df.withColumn(OWN + "at", bit(key, held.bits)).withColumn(OWN + "w", F.shiftright(OWN + "at", 6))
    out = out.join(F.broadcast(words), out[OWN + "w"] == words[OWN + "word"], "left")
    hit = F.coalesce(F.getbit(OWN + "mask", F.col(OWN + "at").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return out.withColumn(flag, hit).drop(OWN + "at", OWN + "w", OWN + "word", OWN + "mask")


def drop_rows(df: DataFrame, rid: str, losers: DataFrame, name: str) -> DataFrame:
    """``df`` without the rows whose ``rid`` is in ``losers``; only rows that a sieve of the losers lets through are shuffled."""
    key = F.xxhash64(rid)
    seen = probe(df, key, sieve(losers.select(key.alias("k")), "k", name), OWN + "hit")
    rest = seen.where(F.col(OWN + "hit")).join(losers.select(rid), rid, "left_anti")
    return seen.where(~F.col(OWN + "hit")).select(*df.columns).unionByName(rest.select(*df.columns))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def same(a: DataFrame, b: DataFrame, on: Sequence[str]) -> Column:
    """A null-safe equi-join condition."""
    cond = a[on[0]].eqNullSafe(b[on[0]])
    for c in on[1:]:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond
