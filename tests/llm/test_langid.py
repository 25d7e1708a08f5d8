import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the house and a tree was with some water there".split(), "de": "das haus und ein baum war mit etwas wasser dort".split()}


def rows():
    draw = random.Random(3)
    out = [(i, " ".join(draw.choices(WORDS[lang], k=12)), lang, "x") for i in range(200) for lang in [("en", "de")[i % 2]]]
    return out + [(500, None, "en", "x"), (501, "", "de", "x"), (502, "12 345 !!", "en", None), (503, "the house", None, None), (None, "das haus", "de", "x"), (504, "漢字", "en", "x"), (505, "waters houses " * 100_000, None, "x"), (505, "x", None, "x")]


def test_identify(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = langid.identify(df).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows()[:200])
    assert [by[i].lang_pred for i in (500, 501, 502, 503, None, 505)][:5] == ["und", "und", "und", "en", "de"]
    assert by[500].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert by[504].lang_pred in ("en", "de")


def test_keep_known(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(200)} <= ids and not ids & {500, 501, 502}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0


def test_backoff_goes_to_shorter_grams():
    kept = {0: [("abc", {"x": 5, "y": 1})], 5: [("<zzzz", {"x": 9, "y": 1})], 4: [("qqqq", {"y": 9})], 3: [], 2: [("ab", {"x": 1})], 1: [("w", {"y": 7, "x": 1})]}
    scorer = langid.Scorer(langid._model(["x", "y"], kept))
    texts = ["abc", "zzzzz", "pqqqqp", "ow", "", "\u6f22"]
    assert [lang for lang, _ in scorer.predict(texts)] == ["x", "x", "y", "y", "und", "x"]
    tiny = langid.Scorer(scorer.m, cache_words=1)
    assert [tiny.predict([t])[0] for t in texts] == scorer.predict(texts)
    row = kept[0][0][1]
    assert math.isclose(scorer.m.word_scores[0][0], math.log((row["x"] + 0.1) / (row["x"] + 0.2)))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = docs.select("doc_id", "lang")
    right = langid.identify(docs).join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95


@pytest.mark.parametrize("text", ["a b", "ä" * 3_000_000, "ab " * 700_000 + "x"])
def test_long_texts_count_whole_words(text):
    assert langid.word_counts(text) == langid.Counter(langid._patterns()[0].findall(text.lower()))


def test_words_are_letters_and_their_marks():
    words = lambda t: list(langid.word_counts(t))
    assert words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and words("½ ² Ⅷ 12 _ \u0301") == [] and words("a1b_c") == ["a", "b", "c"]
    for c in range(0x3000):
        assert bool(words(chr(c))) == (unicodedata.category(chr(c))[0] == "L" and unicodedata.category(chr(c).lower()[0])[0] == "L"), hex(c)


def plain(texts, learn):
    """Training and scoring in plain Python, without bounds that small data would meet."""
    counts = {k: {} for k in range(6)}
    runs = lambda t: re.findall(r"(?:[^\W\d_])+", t.lower())
    for text, lang in learn:
        for w in runs(text):
            for size in range(1, 6):
                marked = w if size == 1 else f"<{w}>"
                for i in range(len(marked) - size + 1):
                    counts[size].setdefault(marked[i : i + size], Counter())[lang] += 1
            if len(w) <= 64:
                counts[0].setdefault(w, Counter())[lang] += 1
    counts = {k: {x: c for x, c in items.items() if sum(c.values()) > 1} for k, items in counts.items()}
    langs = sorted({lang for _, lang in learn})
    score = {}
    for k, items in counts.items():
        for lang in langs:
            total = sum(c[lang] for c in items.values()) + 0.1 * (len(items) + 1)
            for x, c in items.items():
                score[k, x, lang] = math.log((c[lang] + 0.1) / total)
    out = []
    for text in texts:
        words = runs(text or "")
        if not words:
            out.append(("und", 0.0))
            continue
        sums = dict.fromkeys(langs, 0.0)
        for w in words:
            found = [(0, w)] if w in counts[0] else []
            for size in range(5, 0, -1):
                if not found:
                    marked = w if size == 1 else f"<{w}>"
                    found = [(size, marked[i : i + size]) for i in range(len(marked) - size + 1) if marked[i : i + size] in counts[size]]
            for lang in langs:
                sums[lang] += sum(score[k, x, lang] for k, x in found) / max(1, len(found))
        top = {lang: v / math.sqrt(len(words)) for lang, v in sums.items()}
        best = max(langs, key=lambda lang: (top[lang], [-ord(c) for c in lang]))
        out.append((best, 1 / sum(math.exp(v - top[best]) for v in top.values())))
    return out


def test_against_plain_python(spark):
    draw = random.Random(8)
    learn = [(" ".join(draw.choices(WORDS[lang], k=9)) + draw.choice(["", " xy" * 30, " " + "lang" * 30 + lang]), lang) for lang in ("en", "de") * 60]
    texts = ["tree house", "baumhaus wasserfall", "langlang" * 20, "qqq", "thereof 12", "", None, "xyxy there", "w"]
    model = langid.train(spark.createDataFrame(learn + learn[:3], "text string, lang string"))
    for (lang, score), (want, p) in zip(langid.Scorer(model).predict(texts), plain(texts, learn + learn[:3])):
        assert lang == want and abs(score - p) < 1e-5


def test_languages_are_bounded_and_names_are_guarded(spark):
    df = spark.createDataFrame([(f"wort{k} gut gut", f"l{k % 7}") for k in range(70)] + [("gut", "rare")], "text string, lang string")
    assert langid.train(df, max_languages=7).languages == [f"l{k}" for k in range(7)]
    with pytest.raises(ValueError):
        langid.predict(df.withColumn("score", F.lit(1)), langid.train(df))


def test_the_most_frequent_items(spark):
    draw = random.Random(11)
    rows = [(kind, f"i{k}", draw.choice([2, 3, 3, 5, 9])) for kind in range(6) for k in range(50)]
    items = spark.createDataFrame([(k, i, [("x", n)], n) for k, i, n in rows], "kind int, item string, by array<struct<lang:string,n:long>>, n long")
    most = [7, 1, 50, 49, 100, 23]
    got = langid._top(items, most)
    for kind in range(6):
        assert [i for i, _ in got[kind]] == [i for _, i in sorted((-n, i) for k, i, n in rows if k == kind)][: most[kind]]
