import re
from collections import Counter, defaultdict

import pytest

from tessella.llm import quality

SCHEMA = "doc_id long, text string, source string, kept int"
LONG = " ".join(f"word{i}" for i in range(80))
SHARED = "Subscribe   now to the newsletter"


def brute(rows, max_share=0.01, min_docs=5, min_left=0.3):
    docs, freq = Counter(h for _, _, h, _ in rows), Counter()
    normal = lambda l: re.sub(r"[\x20\x09-\x0d]+", " ", l).strip(" ").lower()
    for _, t, h, _ in rows:
        freq.update({(h, normal(l)) for l in (t or "").split("\n") if normal(l)})
    out = []
    for i, t, h, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        lines = [l for l in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", l)]
        at = defaultdict(list)
        for k in range(len(words) - 2):
            at[tuple(words[k : k + 3])].append(k)
        repeat = len({p for ks in at.values() if len(ks) > 1 for k in ks for p in (k, k + 1, k + 2)})
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        gone = sum(len(re.findall(r"[^\x20\x09-\x0d]+", l)) for l in lines if freq[h, normal(l)] > max(min_docs, max_share * docs[h]))
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed, not failed and len(words) - gone >= min_left * len(words)))
    return Counter(out)


def rows():
    out = [(i, f"{SHARED}\n{LONG} {i}", "a" if i % 2 else None, 1) for i in range(20)]
    out += [(100 + i, "\n".join([SHARED.upper()] + [f"line {k} of the menu with several words in it" for k in range(9)]) + f"\nown {i}", "a", 1) for i in range(8)]
    out += [(200, None, "a", 1), (201, "", None, 1), (202, "one two", None, None), (203, "a b c " * 50, "b", 1), (204, " \t\n\x0b" * 9, "b", 1), (None, LONG, "b", 1), (205, LONG, "b", 1), (205, LONG, "b", 1)]
    out += [(206, "é#*$%&|<> " * 60 + LONG, "b", 1), (207, "x " * 40_000, "b", 1), (208, f"{LONG}\n{LONG}\n \n\n{LONG}", "c", 1), (209, LONG + " word1 word2 word3 word4", "c", 1)]
    return out


@pytest.mark.parametrize("data", [rows(), []])
def test_decide(spark, data):
    got = quality.decide(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(data)


def test_shuffled_lines_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    assert Counter(map(tuple, quality.decide(spark.createDataFrame(rows(), SCHEMA)).collect())) == brute(rows())


def test_clean(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = quality.clean(df)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] == f"{LONG} 1" and texts[205] == LONG and 100 not in texts and 200 not in texts


def test_a_hot_host_does_not_raise_the_limit(spark):
    menu = "\n".join(" ".join(f"menu{k}item{j}" for j in range(10)) for k in range(9))
    data = [(i, f"{LONG} {i}", "hot", 1) for i in range(1000)] + [(2000 + i, f"{menu}\nown {i}", "hot", 1) for i in range(8)]
    kept = {r.doc_id for r in quality.decide(spark.createDataFrame(data, SCHEMA)).collect() if r.kept}
    assert kept == set(range(1000))
