"""Mixing sources to target weights: iterative proportional fitting rakes token weights to several marginals at once, and
documents are sampled by the calibrated probabilities.

Tokens are added up in cells (one for each combination of source, language and topic). Each sweep multiplies the weights
of the cells so that first the sources, then the languages, then the topics have their target totals; after ``sweeps``
sweeps all of them nearly do (``report`` says how nearly). A document's probability is the weight of its cell times a factor,
at most 1, and the factor is such that the expected tokens of the sample come to ``share`` of all tokens: cells that are
wanted more often than they exist are taken whole, the others make up the rest in the proportions of their weights. A tiny
cell can therefore not decide how much of the corpus stays. Whether a document stays depends on its id and the seed alone.

With ``volume`` the weights are scaled to that number of expected tokens with repeats instead: a document is taken as often
as the whole part of its scaled weight says, and once more with the probability of the rest, so targets are met exactly.

A marginal's target is its share of the tokens to the power ``temper`` (1: as it is, 0: all alike), or given by
``targets``. The topic is a column (``topic_col``) or else a rule over the text (``TOPICS``, a plain default). Cells are
broadcast where they are at most ``BROADCAST_CELLS``, else joined by a shuffle; the tables of the fit stay as large as the
cells, and small ones are fitted in one partition without exchanges. Both ways give the same rows.

Defined cases: a null source, language or topic is a value of its own; a null text has no tokens and the topic ``none``; a
document without tokens has the probability of its cell (at most 1); values without tokens, or without a target, keep
their weight; rows with equal ids stay or go together if they are in one cell; an empty table gives an empty result; other
columns pass through ``sample`` whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import OWN, drop_materialised, materialise, reserve

SWEEPS, TEMPER, SEED = 8, 0.7, "mix-1"
SHARE = 0.75
BROADCAST_CELLS = 200_000
DIGITS = 9

#: The rules that name a text's topic, the first that matches.
TOPICS = (
    ("legal", r"[Ll]icen[cs]ed? |[Cc]opyright"),
    ("table", r" \| [^|\n]* \| [^|\n]* \| "),
    ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]|[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9]"),
    ("markup", r"[#*$%&][#*$%&][#*$%&]"),
    ("prose", r"[^\x20\x09-\x0D]"),
)
SPACES = r"[\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    out = F.lit("none")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: 48 bits of MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _given(cells: DataFrame, dim: str, temper: float, targets: DataFrame | None) -> DataFrame:
    """(value, aim): the tokens that each value of a marginal is to have."""
    sums = cells.groupBy(dim).agg(F.sum("n").cast("double").alias("n"))
    if targets is None:
        aims = sums.select(F.col(dim).alias("value"), F.when(F.col("n") > 0, F.pow("n", F.lit(temper))).alias("share"))
    else:
        told = targets.where(F.col("dim") == dim).select(F.col("value").alias("told"), "share")
        aims = sums.join(told, sums[dim].eqNullSafe(told["told"]), "left").where("n > 0").select(F.col(dim).alias("value"), "share")
    whole = aims.agg(F.sum("share").alias("all"))
    return aims.crossJoin(F.broadcast(whole)).select("value", (F.col("share") / F.col("all")).alias("aim"))  # one row


def fit(cells: DataFrame, dims: Sequence[str], temper: float = TEMPER, sweeps: int = SWEEPS, targets: DataFrame | None = None) -> DataFrame:
    """``cells`` (dims and tokens ``n``) with their weight ``g``: raked ``sweeps`` times to each marginal in turn."""
    if cells.count() <= BROADCAST_CELLS:
        return _fit_small(cells.coalesce(1), dims, temper, sweeps, targets)
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    aims = {d: materialise(_given(cells, d, temper, targets), "aims") for d in dims}
    g, last = cells.withColumn("g", F.lit(1.0)), None
    for k in range(sweeps):
        for d in dims:
            now = g.groupBy(d).agg(F.sum(F.col("g") * F.col("n")).alias("now"))
            aim = aims[d]
            factor = now.join(aim, now[d].eqNullSafe(aim["value"]), "left").select(F.col(d).alias("v"), F.when((F.col("now") > 0) & (F.col("aim") > 0), F.col("aim") * total / F.col("now")).otherwise(1.0).alias("f"))
            g = g.join(factor, F.col(d).eqNullSafe(F.col("v")), "left").select(*dims, "n", (F.col("g") * F.coalesce("f", F.lit(1.0))).alias("g"))
        g = materialise(g, f"sweep{k}")
        if last is not None:
            drop_materialised(last)
        last = g
    return g


def _fit_small(cells: DataFrame, dims: Sequence[str], temper: float, sweeps: int, targets: DataFrame | None) -> DataFrame:
    """``fit`` for a bounded number of cells, in one partition: marginals are windows, so a sweep has no join or exchange."""
    for d in dims:
        aim = _given(cells, d, temper, targets).select(F.col("value").alias("__v"), F.col("aim").alias(f"__aim_{d}"))
        cells = cells.join(F.broadcast(aim), F.col(d).eqNullSafe(F.col("__v")), "left").drop("__v")
    g = materialise(cells.withColumns({"g": F.lit(1.0), "__total": F.sum("n").over(W.partitionBy()).cast("double")}), "aims")
    for k in range(0, sweeps, 2):
        g = g.coalesce(1)
        for d in list(dims) * min(2, sweeps - k):
            aim = F.col(f"__aim_{d}")
            g = g.withColumn("__now", F.sum(F.col("g") * F.col("n")).over(W.partitionBy(d)))
            g = g.withColumn("g", F.when((F.col("__now") > 0) & (aim > 0), F.col("g") * (aim * F.col("__total") / F.col("__now"))).otherwise(F.col("g"))).drop("__now")
        g = materialise(g, f"sweep{k}")
    return g.select(*dims, "n", "g")


def factor(g: DataFrame, volume: float) -> float:
    """The factor of the weights at which the expected tokens, with probabilities of at most 1, come to ``volume``.

    Each round takes the cells that the last factor fills whole out of the sum; they only become more, so it ends.
    """
    at, whole = 0.0, -1
    while True:
        full = F.col("g") * at >= 1.0
        held, rest, now = g.where("n > 0").agg(F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("g") * F.col("n"))), F.count_if(full)).first()
        if now == whole or not rest:
            return at if rest else math.inf
        at, whole = max(0.0, volume - (held or 0)) / rest, now


def _cells(rows: DataFrame, dims: Sequence[str], temper: float, sweeps: int, targets: DataFrame | None, share: float, volume: float | None) -> tuple[DataFrame, bool]:
    """The cells with weight, probability and rate (expected copies, with a volume), and whether they may be broadcast."""
    cells = materialise(rows.groupBy(*dims).agg(F.sum("n").alias("n")), "cells")
    g = materialise(fit(cells, dims, temper, sweeps, targets), "weights")
    total, raked, count = g.agg(F.sum("n"), F.sum(F.col("g") * F.col("n")), F.count(F.lit(1))).first()
    by = volume / (raked or 1.0) if volume is not None else factor(g, share * (total or 0))
    rate = F.col("g") * by if math.isfinite(by) else F.lit(1.0)
    rate = rate if volume is not None else F.least(rate, F.lit(1.0))
    told = g.select(*[F.col(d).alias(OWN + d) for d in dims], "n", F.round("g", DIGITS).alias("weight"), F.round(F.least(rate, F.lit(1.0)), DIGITS).alias("probability"), F.round(rate, DIGITS).alias("rate"))
    return told, count <= BROADCAST_CELLS


def _told(rows: DataFrame, dims: Sequence[str], told: DataFrame, small: bool) -> DataFrame:
    """``rows`` with what is known of their cells."""
    told = told.drop("n")
    same = rows[dims[0]].eqNullSafe(told[OWN + dims[0]])
    for d in dims[1:]:
        same = same & rows[d].eqNullSafe(told[OWN + d])
    return rows.join(F.broadcast(told) if small else told, same, "left").drop(*[OWN + d for d in dims])


def _copies(id_col: Column, seed: str) -> Column:
    """How often a document is taken where a volume is given."""
    whole = F.floor("rate")
    return whole + (uniform(id_col, seed) < F.col("rate") - whole).cast("long")


def _thin(df: DataFrame, keep: dict[str, Column], source_col: str, lang_col: str, topic_col: str | None, text_col: str) -> DataFrame:
    text = F.col(text_col)
    label = F.col(topic_col) if topic_col else topic(F.coalesce(text, F.lit("")))
    return df.select(*[c.alias(n) for n, c in keep.items()], F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), label.alias("topic"), tokens(text).alias("n"))


DIMS = ("source", "lang", "topic")


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: float = TEMPER, sweeps: int = SWEEPS, seed: str = SEED, targets: DataFrame | None = None, volume: float | None = None, share: float = SHARE, topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept, and with a volume copies; one row per input row.

    Texts are read once: what is known of them is written."""
    rows = materialise(_thin(df, {"doc_id": F.col(id_col)}, source_col, lang_col, topic_col, text_col), "token-counts")
    out = _told(rows, DIMS, *_cells(rows, DIMS, temper, sweeps, targets, share, volume))
    if volume is not None:
        out = out.withColumn("copies", _copies(F.col("doc_id"), seed))
        return out.select("doc_id", "source", "lang", "topic", F.col("n").alias("n_tokens"), "weight", "probability", (F.col("copies") > 0).alias("kept"), "copies")
    return out.select("doc_id", "source", "lang", "topic", F.col("n").alias("n_tokens"), "weight", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", temper: float = TEMPER, sweeps: int = SWEEPS, seed: str = SEED, targets: DataFrame | None = None, volume: float | None = None, share: float = SHARE, topic_col: str | None = None) -> DataFrame:
    """The sampled rows with their columns. The probability is a function of cell and id, so rows are filtered where they are
    read again and no text is shuffled (but where there are too many cells to broadcast)."""
    own = {d: OWN + "of_" + d for d in DIMS}
    told, small = _cells(_thin(reserve(df), {}, source_col, lang_col, topic_col, text_col), DIMS, temper, sweeps, targets, share, volume)
    label = F.col(topic_col) if topic_col else topic(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.withColumns({OWN + "id": F.col(id_col), own["source"]: F.col(source_col), own["lang"]: F.col(lang_col), own["topic"]: label})
    names = {"weight": OWN + "weight", "probability": OWN + "probability", "rate": OWN + "rate"} | {OWN + d: OWN + own[d] for d in DIMS}
    out = _told(rows, list(own.values()), told.withColumnsRenamed(names), small)
    if volume is not None:
        rate = F.col(OWN + "rate")
        copies = F.floor(rate) + (uniform(F.col(OWN + "id"), seed) < rate - F.floor(rate)).cast("long")
        return out.withColumn(OWN + "copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*df.columns)
    return out.where(uniform(F.col(OWN + "id"), seed) < F.col(OWN + "probability")).select(*df.columns)


def report(decided: DataFrame) -> DataFrame:
    """dim, value, tokens, raked (tokens times weight: the targets, as nearly as the sweeps came) and expected (tokens that the
    probabilities keep), of rows of ``decide``; one row for each value of a marginal."""
    cells = decided.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("weight")).alias("raked"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"))
    each = cells.select("n", "raked", "expected", F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in DIMS])))
    return each.groupBy("dim", "value").agg(F.sum("n").alias("tokens"), F.sum("raked").alias("raked"), F.sum("expected").alias("expected"))
