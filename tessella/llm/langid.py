"""Language identification, words first: known words score by their log frequency in each language, an unseen word by the
longest character n-grams of it that are known (five characters, then four, down to one).

``train`` learns from a bounded sample, at most about ``docs_per_language`` labelled texts of each of the
``max_languages`` most frequent languages (chosen by a hash, whole texts), and keeps at most ``max_words`` words and
``max_grams`` n-grams of each length, so the model that is broadcast to the workers has a fixed bound (160,000 rows of
doubles, 164 MB with 128 languages). Words are counted where the texts are read; n-grams are taken from distinct words, once
for each. Runs of more than ``LONG_WORD`` letters, as whole sentences are in scripts without spaces, are no words of the
table but give their n-grams as all others do. ``predict`` reads every whole text once and needs no shuffle.

The score is the probability of the best language after the sum of the words' log likelihoods is divided by the square
root of their number. Words begin with a letter and go on with letters and marks (Unicode categories L and M), in lower case.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where nothing could be
learned; equal scores go to the language that sorts first; letters that no n-gram knows favour no language; a null id
counts as held out; repeated rows give repeated results and are learned as often as they occur; an empty table gives an
empty result; other columns pass, and names that ``predict`` would give twice are refused.
"""
from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, materialise, reserve, ship

DOCS_PER_LANGUAGE = 4000
MAX_LANGUAGES = 128
MAX_WORDS, MAX_GRAMS, LONGEST = 60_000, 20_000, 5
LONG_WORD = 64
SMOOTH = 0.1
CACHE_WORDS = 1 << 16
CHUNK_CHARS = 1 << 20
FOLDS = 5
UNKNOWN = "und"
MIN_SCORE = 0.5


def _ranges(kind: str) -> str:
    """The code points of a category as ranges of a character class."""
    runs, points = [], (c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind)
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        held = [c for _, c in run]
        runs.append(f"{re.escape(chr(held[0]))}-{re.escape(chr(held[-1]))}")
    return "".join(runs)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """A word, and a character that may go on in one."""
    letters, marks = _ranges("L"), _ranges("M")
    return re.compile(f"[{letters}][{letters}{marks}]*"), re.compile(f"[{letters}{marks}]")


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def word_counts(text: str) -> Counter:
    """Words of a whole text; long texts in stretches that end between words."""
    counts: Counter = Counter()
    word, inside = _patterns()
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + CHUNK_CHARS)
        while end < n and inside.match(text, end):
            end += 1
        counts.update(word.findall(text[at:end].lower()))
        at = end
    return counts


def grams(word: str, size: int) -> list[str]:
    """N-grams of a word between marks of its begin and end; single characters come without marks."""
    if size == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # a row for each word, a column for each language
    grams: dict[str, int]
    gram_scores: np.ndarray


class Scorer:
    """A model with a bounded cache of what unseen words scored: known and cached words are rows of one table."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.m, self.limit = model, cache_words
        self._forget()

    def _forget(self) -> None:
        self.rows = dict(self.m.words)
        self.table = self.m.word_scores

    def _learn(self, words: list[str]) -> None:
        """Append rows for unseen words: means over their longest known n-grams, zeros without any."""
        scores = np.zeros((len(words), len(self.m.languages)))
        get, left = self.m.grams.get, list(range(len(words)))
        for size in range(LONGEST, 0, -1):
            at, flat, begin, rest = [], [], [], []
            for k in left:
                rows = [r for g in grams(words[k], size) if (r := get(g)) is not None]
                if rows:
                    at.append(k)
                    begin.append(len(flat))
                    flat += rows
                else:
                    rest.append(k)
            if at:
                sums = np.add.reduceat(self.m.gram_scores[flat], begin)
                scores[at] = sums / np.diff([*begin, len(flat)])[:, None]
            left = rest
        self.rows.update(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.concatenate([self.table, scores])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [word_counts(t or "") for t in texts]
        if not self.m.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        missing = sorted({w for c in counts for w in c if w not in self.rows})
        if len(self.rows) + len(missing) > len(self.m.words) + self.limit:
            self._forget()
            missing = sorted({w for c in counts for w in c if w not in self.rows})
        if missing:
            self._learn(missing)
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            times = np.fromiter(c.values(), float, len(c))
            total = times @ self.table[list(map(self.rows.__getitem__, c))] / np.sqrt(times.sum())
            p = np.exp(total - total.max())
            best = int(p.argmax())
            out.append((self.m.languages[best], round(float(p[best] / p.sum()), 6)))
        return out


COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])
FLUSH_ITEMS = 50_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) by language, and of the n-grams (kind: length) of long runs, in batches of bounded size."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        lang, kind, item = zip(*counts)
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((lang, kind, item, counts.values()), COUNTS.types)], schema=COUNTS)
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in word_counts(text.as_py()).items():
                if len(word) <= LONG_WORD:
                    counts[lang, 0, word] += n
                    continue
                for size in range(1, LONGEST + 1):
                    for g, k in Counter(grams(word, size)).items():
                        counts[lang, size, g] += k * n
            if len(counts) > FLUSH_ITEMS:
                yield flush()
    if counts:
        yield flush()


def _grams(words: DataFrame) -> DataFrame:
    """(lang, item, n) of words to (lang, kind, item, n) of the n-grams in them, as ``grams`` takes them."""
    marked = "concat('<', item, '>')"
    sizes = [f"transform(sequence(1, length(item)), i -> named_struct('kind', 1, 'item', substring(item, i, 1)))"]
    sizes += [f"if(length(item) + 2 < {k}, array(), transform(sequence(1, length(item) + {3 - k}), i -> named_struct('kind', {k}, 'item', substring({marked}, i, {k}))))" for k in range(2, LONGEST + 1)]
    each = words.select("lang", "n", F.explode(F.expr(f"concat({', '.join(sizes)})")).alias("g"))
    return each.select("lang", "g.kind", "g.item", "n")


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model of the rows with text and language; what may not be learned from is left out by the caller."""
    ship(df.sparkSession)
    labelled = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).withColumnRenamed("count", "size")
    # A hash of the text chooses the same sample however the rows are laid out.
    u = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    some = labelled.join(F.broadcast(sizes), "lang").where(u < docs_per_language / F.col("size")).select("lang", "text")
    counts = some.mapInArrow(_counted, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "word-counts")
    both = counts.unionByName(_grams(counts.where("kind = 0").select("lang", "item", "n")))
    items = both.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")).groupBy("kind", "item").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n"))
    kept = _top(materialise(items.where("n > 1"), "items"), [max_words, *[max_grams] * LONGEST])
    languages = sorted({lang for rows in kept.values() for _, by in rows for lang in by})
    return _model(languages, kept)


def _top(items: DataFrame, most: list[int]) -> dict[int, list]:
    """For each kind the most frequent items, at most so many; of equally frequent ones the first.

    How often each count occurs (few numbers, as the sample is bounded) gives the count down to which all items fit, so no
    task sorts a kind; only items with that very count are ordered.
    """
    steps = sorted(map(tuple, items.groupBy("kind", "n").agg(F.count(F.lit(1))).collect()), key=lambda r: (r[0], -r[1]))
    parts = []
    for kind, rows in itertools.groupby(steps, lambda r: r[0]):
        left, above = most[kind], None
        for _, n, items_of in rows:
            if items_of > left:
                parts.append(items.where((F.col("kind") == kind) & (F.col("n") == n)).orderBy("item").limit(left))
                break
            left, above = left - items_of, n
        if above is not None:
            parts.append(items.where((F.col("kind") == kind) & (F.col("n") >= above)))
    kept: dict[int, list] = {k: [] for k in range(LONGEST + 1)}
    for part in parts:
        for kind, item, by, n in zip(*(c.to_pylist() for c in part.select("kind", "item", "by", "n").toArrow().columns)):
            kept[kind].append((-n, item, {x["lang"]: x["n"] for x in by}))
    return {k: [(item, by) for _, item, by in sorted(rows, key=lambda r: r[:2])] for k, rows in kept.items()}


def _model(languages: list[str], kept: dict[int, list]) -> Model:
    def scores(rows: list) -> np.ndarray:
        table = np.array([[by.get(lang, 0) for lang in languages] for _, by in rows], float).reshape(len(rows), len(languages))
        return np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * (len(rows) + 1)))

    words = {item: i for i, (item, _) in enumerate(kept[0])}
    gram_rows = [scores(kept[size]) for size in range(1, LONGEST + 1)]
    names = [item for size in range(1, LONGEST + 1) for item, _ in kept[size]]
    return Model(languages, words, scores(kept[0]), {g: i for i, g in enumerate(names)}, np.concatenate(gram_rows))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The input's rows and columns with the predicted language and its score behind them."""
    spark = df.sparkSession
    if clash := {lang_name, score_name} & set(df.columns):
        raise ValueError(f"the input has columns {sorted(clash)}; give the results other names")
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                got = scorer.predict(part.column(at).to_pylist())
                extra = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, lang_name, score_name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that are not held out."""
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(df: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with their columns, whose language is found with at least ``min_score``."""
    model = train(reserve(df).where(~held_out(F.col(id_col))), text_col, lang_col)
    found = predict(df, model, text_col, OWN + "lang", OWN + "score")
    return found.where((F.col(OWN + "lang") != UNKNOWN) & (F.col(OWN + "score") >= min_score)).select(*df.columns)
