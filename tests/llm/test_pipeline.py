"""The pipeline against its stages put together by hand."""
import hashlib
import os
import re

import pytest

import corpus_pipeline
from tessella.llm import bpe, langid, mixing
from tessella.llm.queries import vocabulary_path


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs.collect())
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "ngram_join", "mixing", "bpe"]


def test_stages(spark, stages):
    start, language, exact, near, mixed, encoded = stages
    assert all(r.asDict().keys() == start[0].asDict().keys() for rows in stages[1:5] for r in rows)
    model = langid.train(spark.createDataFrame(start).where(~langid.held_out(langid.F.col("doc_id"))))
    found = langid.Scorer(model).predict([r.text for r in start])
    assert {r.doc_id for r in language} == {r.doc_id for r, (lang, score) in zip(start, found) if lang != "und" and score >= langid.MIN_SCORE}
    best = {}
    for r in language:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    sets = {r.doc_id: shingles(r.text or "") for r in exact}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[min(x, y)] = max(x, y)
    empty = [i for i in ids if not sets[i]]
    for a in empty:
        root[top(a)] = top(max(empty))
    assert sorted(r.doc_id for r in near) == sorted({top(i) for i in ids})
    decided = {r.doc_id: r for r in mixing.decide(spark.createDataFrame(near)).collect()}
    assert {r.doc_id for r in mixed} == {i for i, r in decided.items() if r.kept}
    for r in near:
        n = len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        assert decided[r.doc_id].n_tokens == n
    codec = bpe.Codec(vocabulary_path())
    want = {r.doc_id: hashlib.sha256(codec.encode(r.text or "")[0].astype("<u4").tobytes()).hexdigest() for r in mixed}
    assert {r.doc_id: r.ids_sha256 for r in encoded} == want
    assert all(r.decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest() for t in mixed for r in encoded if r.doc_id == t.doc_id)


HARD = [
    (1, None, None, None, 1, "k"),
    (2, "", "en", "a", 2, "k"),
    (None, "the house and a tree", "en", "a", 3, None),
    (3, "12 345 !!", "de", None, 4, "k"),
    *((i, " ".join(f"{w}{i // 2}" for w in "the house and a tree was with some water there".split()), "en", ("a", "b")[i % 2], 5, "k") for i in range(10, 40)),
    (10, "the5 house5 and5 a5 tree5 was5 with5 some5 water5 there5", "en", "a", 5, "k"),
    (50, "das haus und ein baum " * 20_000, "de", "b", 6, "k"),
    (51, "das haus und ein baum " * 20_000, "de", "b", 6, "k"),
]


@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_rows_through_every_stage(spark, tmp_path, rows):
    """Nulls in every column, empty and very long texts, repeated rows, other columns with names that stages give."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability long, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), f"hard-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "probability", "kept"]
        kept.append([r.doc_id for r in docs.collect()])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, kept[-1]))
    if rows:
        assert not {1, 2, 3} & set(kept[0]) and 50 not in kept[1] and 51 in kept[1]
        texts = {r[0]: r[1] for r in rows}
        assert len({texts[i] for i in kept[1]}) == len(kept[1])


def test_import_without_the_subpackage(tmp_path):
    """The entry module works where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{here}/tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op1_') for n in q))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.stdout.split()[-1] == "False", said.stderr
