"""Quality rules: word statistics of each text, and lines that too many documents of a host share.

A line is normalised (lower case, runs of white space as one blank) and hashed with its host; for every host and line the
documents that hold it are counted. A line in more than ``min_docs`` documents of a host is removed from all of them,
however many documents the host has. A document of which less than ``min_left`` of the words are left is rejected,
as are documents that fail the base rules. Counts cover all documents; only hashes are shuffled, pre-aggregated in each
scan task, so neither a hot host nor a line that a third of all documents hold meets in one task.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A document is a row. Common lines are broadcast where at most ``BROADCAST_LINES``
of them exist and joined by a shuffle (split by AQE where hot) beyond that.

Defined cases: a null text has no words (all counts 0, base failed); a null host is a host of its own; lines without a
word are never counted or removed; repeated rows are documents of their own; an empty table gives an empty result; other
columns are passed on by ``clean`` and ignored by ``decide``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, materialise, reserve, sieve, probe, with_row_id

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, MIN_LEFT = 5, 0.3
BROADCAST_LINES = 1_000_000  # of two longs each

_RID, _TEXT, _HOST = OWN + "rid", OWN + "text", OWN + "host"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def base(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base statistics of column ``__tsl_text``, in one row per row."""
    w, h, s = OWN + "words", OWN + "windows", OWN + "sorted"
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    lines = OWN + "lines"
    df = rows.select(*keep, _TEXT, _words(F.col(_TEXT)).alias(w), F.filter(F.split(_TEXT, "\n"), has_word).alias(lines))
    # Hashes of all windows of three words; only where one occurs again are they sorted with their positions.
    hashes = F.expr(f"if(size({w}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))")
    df = df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(_TEXT, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        hashes.alias(h),
    )
    again = F.expr(f"if(size(array_distinct({h})) = size({h}), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform({h}, (x, i) -> named_struct('h', x, 'i', i))))")
    df = df.withColumn(s, again)
    hit = F.expr(f"transform(filter({s}, (x, k) -> (k > 0 and {s}[k - 1].h = x.h) or (k < size({s}) - 1 and {s}[k + 1].h = x.h)), x -> x.i)")
    df = df.withColumn(OWN + "hit", hit)
    covered = F.expr(f"size(array_union(array_union({OWN}hit, transform({OWN}hit, i -> i + 1)), transform({OWN}hit, i -> i + 2)))")
    df = df.withColumn("n_repeat_words", covered.cast("long")).drop(h, s, OWN + "hit")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def common_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of (host, normalised line) that are in more documents of the host than the limit allows."""
    normal = F.filter(F.transform(F.split(_TEXT, "\n"), _normal), lambda line: line != "")
    each = rows.select(F.col(_HOST), F.explode(F.array_distinct(normal)).alias("line"))
    keyed = each.select(F.xxhash64(_HOST, "line").alias("line"))
    return keyed.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs).select("line")


def _removed(rows: DataFrame, common: DataFrame) -> DataFrame:
    """For rows that hold common lines: rid, words in those lines, positions of the lines."""
    lines = rows.select(_RID, _HOST, F.posexplode(F.split(_TEXT, "\n")).alias("pos", "raw"))
    keyed = lines.select(_RID, "pos", "raw", F.xxhash64(_HOST, _normal(F.col("raw"))).alias("line")).where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    if common.count() <= BROADCAST_LINES:
        hits = keyed.join(F.broadcast(common), "line", "left_semi").select(_RID, "pos", F.size(_words(F.col("raw"))).alias("words"))
    else:
        hits = keyed.select(_RID, "pos", "line", F.size(_words(F.col("raw"))).alias("words")).join(common, "line", "left_semi")
    return hits.groupBy(_RID).agg(F.sum("words").alias("gone"), F.collect_list("pos").alias("positions"))


def _judge(df: DataFrame, text_col: str, host_col: str, keep: list[str], min_docs: int, min_left: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = with_row_id(reserve(df)).withColumns({_TEXT: F.coalesce(F.col(text_col), F.lit("")), _HOST: F.col(host_col)})
    removed = _removed(rows, materialise(common_lines(rows, min_docs), "common-lines"))
    joined = base(rows, [_RID, *keep]).join(removed, _RID, "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return rows, removed, joined.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; one row per input row."""
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    _, _, judged = _judge(df, "text", "host", ["doc_id"], min_docs, min_left)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(df: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The kept rows with their columns, common lines taken out of the text; only rows that hold such lines are shuffled."""
    rows, removed, judged = _judge(df, text_col, host_col, [], min_docs, min_left)
    k, p = OWN + "kept", OWN + "positions"
    verdict = materialise(judged.select(_RID, F.col("kept").alias(k), F.col("positions").alias(p)), "verdicts")
    touched = verdict.where(~F.col(k) | F.col(p).isNotNull())
    seen = probe(rows, F.xxhash64(_RID), sieve(touched.select(F.xxhash64(_RID).alias("k")), "k", "touched"), OWN + "hit")
    left = F.expr(f"transform(filter(transform(split({_TEXT}, '\\n'), (l, i) -> named_struct('l', l, 'i', i)), x -> not array_contains({p}, x.i)), x -> x.l)")
    some = seen.where(OWN + "hit").join(touched, _RID, "left").where(F.coalesce(k, F.lit(True)))
    some = some.withColumn(text_col, F.when(F.col(p).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return seen.where(~F.col(OWN + "hit")).select(*df.columns).unionByName(some.select(*[F.col(c) for c in df.columns]))
