import random
from collections import defaultdict

import pytest

from tessella.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, weight string"


def rows():
    draw = random.Random(2)
    out = []
    for i in range(400):
        out.append((i, " ".join(["w"] * draw.randint(1, 60)) + draw.choice(["", " ### x", " a@b.c", " a | b | c | d"]), draw.choice(["a", "a", "a", "b", None]), draw.choice(["en", "en", "de"]), "x"))
    return out + [(1000, None, "a", "en", "x"), (1001, "", "empty", None, None), (None, "w w", "a", "de", "x"), (7, "w", "b", "de", "x"), (1002, "w " * 100_000, "b", "de", "x")]


def test_many_cells_give_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    few, kept = sorted(map(repr, mixing.decide(df, sweeps=2).collect())), sorted(map(repr, mixing.sample(df, sweeps=2).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", -1)
    assert few == sorted(map(repr, mixing.decide(df, sweeps=2).collect()))
    assert kept == sorted(map(repr, mixing.sample(df, sweeps=2).collect()))


def test_marginals_meet_their_targets(spark):
    decided = mixing.decide(spark.createDataFrame(rows(), SCHEMA))
    got = decided.collect()
    assert len(got) == len(rows()) and all(0 <= r.probability <= 1 for r in got)
    total = sum(r.n_tokens for r in got)
    for dim in ("source", "lang", "topic"):
        have, raked = defaultdict(int), defaultdict(float)
        for r in got:
            have[r[dim]] += r.n_tokens
            raked[r[dim]] += r.n_tokens * r.weight
        aims = {v: n**0.7 for v, n in have.items() if n}
        for v, aim in aims.items():
            assert abs(raked[v] / total - aim / sum(aims.values())) < 0.01
        told = {r.value: r for r in mixing.report(decided).collect() if r.dim == dim}
        assert all(told[v].tokens == n and abs(told[v].raked - raked[v]) < 1e-3 for v, n in have.items())
    assert abs(sum(r.n_tokens * r.probability for r in got) - mixing.SHARE * total) < 1e-3 * total
    by = max(r.probability / r.weight for r in got if r.n_tokens)
    assert all(abs(r.probability - min(1, r.weight * by)) < 1e-6 for r in got)
    assert {r.kept for r in got} == {True, False} and all(r.kept for r in got if r.probability == 1)
    assert {r.topic for r in got if r.doc_id in (1000, 1001)} == {"none"}


def test_sample_agrees_and_keeps_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = sorted((r.doc_id for r in mixing.decide(df).collect() if r.kept), key=repr)
    out = mixing.sample(df)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=repr) == kept
    assert mixing.decide(df.limit(0)).count() == 0


def test_given_targets(spark):
    df = spark.createDataFrame([(i, "w w w w", "a" if i % 4 else "b", "en", "x") for i in range(400)], SCHEMA)
    targets = spark.sql("SELECT * FROM VALUES ('source', 'a', 1.0D), ('source', 'b', 1.0D), ('lang', 'en', 1.0D) AS t(dim, value, share)")
    p = {r.source: r.probability for r in mixing.decide(df, targets=targets, share=0.5).collect()}
    assert p["b"] == 1 and abs(p["a"] - 1 / 3) < 1e-6


def test_a_tiny_cell_does_not_set_the_volume(spark):
    data = [(i, "w " * 40, "a" if i % 3 else "b", "en" if i % 5 else "de", "x") for i in range(2000)] + [(5000, "w " * 20, "new", "xx", "x")]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.decide(df, volume=40_000).collect()
    assert abs(sum(r.n_tokens * r.copies for r in got) - 40_000) < 4_000
    new = next(r for r in got if r.doc_id == 5000)
    assert new.copies > 1 and all(r.kept == (r.copies > 0) for r in got)
    taken = [r.doc_id for r in mixing.sample(df, volume=40_000).collect()]
    assert sorted(taken) == sorted(i for r in got for i in [r.doc_id] * r.copies)


def test_a_tiny_cell_does_not_set_the_share(spark):
    data = [(i, "w " * 40, "a" if i % 3 else "b", "en" if i % 5 else "de", "x") for i in range(2000)]
    plain = mixing.decide(spark.createDataFrame(data, SCHEMA)).collect()
    got = mixing.decide(spark.createDataFrame([*data, (5000, "w " * 20, "new", "xx", "x")], SCHEMA)).collect()
    assert next(r for r in got if r.doc_id == 5000).probability == 1
    assert abs(sum(r.kept for r in got) - sum(r.kept for r in plain)) < 60 and sum(r.kept for r in plain) > 1400


@pytest.mark.parametrize("share", [0.0, 0.3, 0.999, 1.0, 2.0])
def test_factor(spark, share):
    draw = random.Random(9)
    cells = [(draw.randint(0, 50), draw.choice([0.1, 0.5, 1.0, 3.0, 100.0])) for _ in range(40)]
    total = sum(n for n, _ in cells)
    by = mixing.factor(spark.createDataFrame(cells, "n long, g double"), share * total)
    assert abs(sum(n * min(1.0, g * by) for n, g in cells) - min(share, 1) * total) < 1e-6 * total


def test_a_topic_column(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("kind", mixing.F.expr("if(doc_id % 2 = 0, 'x', 'y')"))
    got = mixing.decide(df, topic_col="kind").collect()
    assert {r.topic for r in got} == {"x", "y"}
    assert sorted((r.doc_id for r in mixing.sample(df, topic_col="kind").collect()), key=repr) == sorted((r.doc_id for r in got if r.kept), key=repr)
