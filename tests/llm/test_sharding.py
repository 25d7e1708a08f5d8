import hashlib
import zlib
from collections import Counter

import pytest

from tessella.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 1023])
def test_place_is_a_permutation_with_an_inverse(spark, n):
    placed = sharding.place(spark.range(n), "id", "p", n)
    rows = sharding.row_at(placed, "p", "back", n).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    assert n < 100 or sum(r.p == r.id for r in rows) < 10


ROWS = [(1, "a", 0), (None, "b", 0), (2, None, 0), (2, None, 0), (3, "", 0), (4, "é" * 50_000, 0), *((i, f"t{i}", 0) for i in range(10, 60))]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_shard(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = Counter(r.shard for r in got)
    assert not rows or max(by.values()) - min(by.get(s, 0) for s in range(8)) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_layout_does_not_matter(spark):
    df = spark.createDataFrame(ROWS[4:], "doc_id long, text string, shard int")
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.repartition(1)).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.repartition(7)).collect()}


def network(x, n, key=sharding.KEY, rounds=sharding.ROUNDS):
    """The permutation in plain Python, walking until the number is below n."""
    a = next(a for a in range(1, n + 2) if a * a >= n)
    b = -(-n // a)
    mix = lambda k, side, v: int(hashlib.md5(f"{key}-{k}{side}:{v}".encode()).hexdigest()[:12], 16)
    while True:
        left, right = divmod(x, b)
        for k in range(rounds):
            left = (left + mix(k, "l", right)) % a
            right = (right + mix(k, "r", left)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 64, 777])
def test_the_network_in_plain_python(spark, n):
    got = sharding.place(spark.range(n), "id", "p", n).collect()
    assert {r.id: r.p for r in got} == {x: network(x, n) for x in range(n)}


def test_shards_and_slots_in_plain_python(spark):
    got = sharding.shard(spark.createDataFrame(ROWS, "doc_id long, text string, shard int"), 8).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    want = []
    for number, row in enumerate(sorted(ROWS, key=key)):
        at = network(number, len(ROWS))
        want.append((row[0], key(row)[3], key(row)[2], "rows", at % 8, at // 8, None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
