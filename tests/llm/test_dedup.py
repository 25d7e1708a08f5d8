import hashlib
from collections import defaultdict

import pytest

from tessella.llm import dedup

SCHEMA = "doc_id long, text string, lang string"


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted(
        ((i, max(g, key=key), len(g), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows for g in [groups[t or ""]]), key=repr
    )


ROWS = [
    (1, "same text", "en"),
    (5, "same text", None),
    (2, "same texT", "en"),
    (3, None, None),
    (4, "", "de"),
    (None, "same text", "en"),
    (6, "é" * 70 + "a", "en"),
    (7, "é" * 70 + "b", "en"),
    (8, "é" * 70 + "a", "en"),
    (9, "x" * 200_000, "en"),
    (10, "x" * 200_000, "en"),
    (11, "alone", "en"),
    (12, "twice", "en"),
    (12, "twice", "fr"),
]


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("bits", [6, 26])
def test_decide(spark, rows, bits):
    df = spark.createDataFrame(rows, SCHEMA)
    got = dedup.decide(df, sieve_bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t, _ in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_dedup_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(*r, 7, "k") for r in ROWS], SCHEMA + ", kept int, sha string")
    out = dedup.dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len({t or "" for _, t, _ in ROWS}) and {5, 4, 8, 10, 11, 2, 7} <= {r.doc_id for r in got}
    assert sum(r.doc_id == 12 for r in got) == 1


def test_reserved_names_are_refused(spark):
    with pytest.raises(ValueError):
        dedup.decide(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, __tsl_rid long"))
