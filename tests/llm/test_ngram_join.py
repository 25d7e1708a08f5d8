import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import common
from tessella.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, key string, rid int"


def brute(rows, threshold=0.8):
    words = [tuple((t or "").lower().split()) for _, t, *_ in rows]
    sets = [{w[i : i + min(5, len(w))] for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)
    classes = defaultdict(list)
    for k, w in enumerate(words):
        classes[w].append(k)
    reps = [max(ks, key=order) for ks in classes.values()]
    link = defaultdict(set)
    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                link[a].add(b), link[b].add(a)
    root = {}
    for r in reps:
        if r in root:
            continue
        work, seen = [r], {r}
        while work:
            for b in link[work.pop()] - seen:
                seen.add(b)
                work.append(b)
        best = max(seen, key=order)
        root.update(dict.fromkeys(seen, best))
    out = []
    for ks in classes.values():
        rep = max(ks, key=order)
        out += [(rows[k][0], rows[rep][0], len(ks), len(link[rep]), rows[root[rep]][0]) for k in ks]
    return sorted(out, key=repr), len(set(root.values()))


def data(seed=1):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for family in range(25):
        base = draw.choices(vocab, k=draw.randint(1, 150))
        for _ in range(draw.choice([1, 1, 2, 4, 30])):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 5])):
                at = draw.randrange(len(w))
                w[at : at + 1] = draw.choice([[draw.choice(vocab)], [], [w[at], draw.choice(vocab)]]) if len(w) > 3 else w[at : at + 1]
            rows.append((n, "  ".join(w).upper() if draw.random() < 0.2 else " ".join(w), "k", 1))
            n += 1
    return rows + [(None, None, "k", 1), (9001, "", "k", 1), (9002, " \n", "k", None), (9003, "one", "k", 1), (9004, "ONE", "k", 1), (9005, "word " * 60_000, "k", 1), (9006, "word " * 60_001, "k", 1)]


@pytest.mark.parametrize("block,node_block", [(512, 4096), (4, 5)])
def test_join_matches_brute_force(spark, monkeypatch, block, node_block):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "NODE_BLOCK", node_block)
    rows = data()
    got = nj.join(spark.createDataFrame(rows, SCHEMA)).collect()
    want, groups = brute(rows)
    assert sorted(((r.doc_id, r.class_id, r.copies, r.n_links, r.group_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == groups


def test_dedup_and_empty(spark):
    rows = data(2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = nj.dedup(df)
    assert out.columns == df.columns and out.count() == brute(rows)[1]
    assert nj.join(df.limit(0)).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    depth = nj.prefix_depth()
    assert 1 - (1 - 0.8**depth) ** nj.TREES >= nj.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** nj.TREES


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 150)] + [(200 + draw.randrange(40), 200 + draw.randrange(40)) for _ in range(25)]
    got = {r.node: r.root for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(70):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_linked_blocks_agree():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, 50)) for _ in range(40)]
    whole = nj.linked(sets, np.ones(40, bool), 0.4)
    left = np.arange(40) % 3 == 0
    assert (nj.linked(sets, left, 0.4) == (whole & (left[:, None] != left[None, :]))).all()
    for i in range(40):
        for j in range(40):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert whole[i, j] == (i != j and len(a & b) / len(a | b) >= 0.4)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_least_similarity_by_enumeration(threshold):
    for n in range(1, 60):
        want = min(i / (n + b - i) for i in range(1, n + 1) for b in range(i, 3 * n + 3) if i >= threshold * (n + b - i) - 1e-9)
        assert abs(nj.least_similarity(n, threshold) - want) < 1e-9
        assert 1 - (1 - want ** nj.depths([n], threshold)[0]) ** nj.TREES >= nj.RECALL


def test_sketches_keep_pairs_at_the_threshold():
    least, p = nj.least_agreement(0.8), 0.8 + 0.2 / 16
    draw = np.random.default_rng(2)
    assert (draw.binomial(128, p, 200_000) < least).mean() < 1e-4 and (draw.binomial(128, 0.5 + 0.5 / 16, 200_000) >= least).mean() < 1e-2


def test_joined_is_the_closure_of_candidates():
    draw = np.random.default_rng(5)
    for _ in range(40):
        m = int(draw.integers(2, 40))
        rest = draw.integers(0, 2, (m, 4)).astype(np.int32)
        rest = rest[np.lexsort(rest.T[::-1])]
        depth, nibbles = draw.integers(0, 5, m), draw.integers(0, 2, (m, 128)).astype(np.uint8)
        sketch = nibbles[:, ::2] << np.uint8(4) | nibbles[:, 1::2]
        left = draw.random(m) < 0.5 if draw.random() < 0.5 else np.ones(m, bool)
        across = left.any() and not left.all()
        group = list(range(m))
        for a in range(m):
            for b in range(a):
                shared = next((k for k in range(4) if rest[a, k] != rest[b, k]), 4)
                if shared >= max(depth[a], depth[b]) and (nibbles[a] == nibbles[b]).sum() >= 66 and not (across and left[a] == left[b]):
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
        assert nj.joined(rest, depth, sketch, left, 66) == group


def planted(words, similarity, draw):
    """Two texts of as many words whose shingle sets have about this similarity: words in the middle are replaced."""
    base = [f"w{draw.randrange(50_000)}" for _ in range(words)]
    changed = list(base)
    n = words - 4
    for at in draw.sample(range(5, words - 5), max(1, round(n * (1 - similarity) / (1 + similarity) / 5))):
        changed[at] = "x" + changed[at]
    return " ".join(base), " ".join(changed)


def test_recall_by_similarity(spark):
    draw = random.Random(6)
    rows, want = [], {}
    for k in range(600):
        a, b = planted(draw.choice([80, 150, 300]), draw.uniform(0.78, 0.98), draw)
        rows += [(2 * k, a), (2 * k + 1, b)]
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        want[k] = len(x & y) / len(x | y)
    got = {r.doc_id: r.n_links for r in nj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low in (0.8, 0.85, 0.9):
        band = [k for k, s in want.items() if low <= s < low + 0.05]
        assert len(band) > 30 and sum(got[2 * k] for k in band) / len(band) >= 0.99
    assert all(got[2 * k] == 0 for k, s in want.items() if s < 0.8)


def test_layout_does_not_matter(spark, tmp_path):
    """The same files under another default parallelism and other splits give the same rows."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t) for i, t, *_ in data(3)], "doc_id long, text string").repartition(5).write.parquet(path)
    seen = []
    for parallel, size in (("1", "134217728"), ("64", "4096")):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallel)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = common.with_row_id(spark.read.parquet(path), "rid")
            seen.append((sorted((tuple(r) for r in df.select("rid", "doc_id", "text").collect()), key=repr), sorted(map(repr, nj.join(spark.read.parquet(path)).collect()))))
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({r[0] for r in seen[0][0]}) == len(data(3))
