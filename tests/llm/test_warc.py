import gzip
import hashlib
import io
import re

import pytest

from tessella.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>" + "é" * 600
ROWS = [
    (1, "http://a/1", BIG, "x"),
    (9, "http://a/9", BIG, "x"),
    (4, None, BIG, None),
    (5, "http://a/5\r\nX: y", "small", "x"),
    (6, "http://a/6", "small", "x"),
    (7, "http://a/ü", None, "x"),
    (8, "http://a/8", "", "x"),
    (None, "http://a/n", BIG, "x"),
    (10, "u", "y" * 999, "x"),
    (11, "u", "y" * 999, "x"),
    (12, "u", "z" * 1000 + "\r\n\r\nWARC/1.1", "x"),
    (12, "u", "z" * 1000 + "\r\n\r\nWARC/1.1", "x"),
    (13, "u", "w" * 300_000, "x"),
]


def brute(rows):
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out, done = [], set()
    for i, _, h, _ in rows:
        h, raw = h or "", (h or "").encode()
        revisit = len(raw) >= 1000 and (i != best[h] or h in done)
        if i == best[h]:
            done.add(h)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_archived(spark, rows):
    got = warc.archived(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_index_and_selection(spark):
    folder, index = warc.write(spark.createDataFrame(ROWS, SCHEMA), file_bytes=2000)
    got = warc.read(folder, index.where("url like '%/8' or page_id = 13"), payloads=True).collect()
    assert {(r.page_id, r.url, bytes(r.payload)) for r in got} == {(8, "http://a/8", b""), (13, "u", b"w" * 300_000)}
    store, base = warc.filesystem(folder)
    rows, ids, named = index.collect(), [], []
    for file in {r.file for r in rows}:
        with store.open_input_file(f"{base}/{file}") as f:
            raw = f.read()
        mine = sorted((r.offset, r.length) for r in rows if r.file == file)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(mine[-1]) == len(raw)
        assert gzip.decompress(raw[: mine[0][0]]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        plain = gzip.open(io.BytesIO(raw)).read()
        assert plain.count(b"WARC/1.1\r\nWARC-Type") == len(mine) + 1
        ids += re.findall(rb"WARC-Record-ID: (\S+)", plain)
        named += re.findall(rb"WARC-Refers-To: (\S+)", plain)
    assert len(set(ids)) == len(ids) and set(named) <= set(ids) and len(named) == sum(r.record_type == "revisit" for r in rows)


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 500, 5), ("b", 505, 5), ("b", 510, 90)]
    assert list(warc.ranges(rows, 60, 100)) == [("a", 0, 15, [0, 1]), ("a", 500, 505, [2]), ("b", 505, 510, [3]), ("b", 510, 600, [4])]


def test_a_changed_payload_is_found():
    raw = warc.record(1, "u", hashlib.sha1(b"abc").hexdigest(), b"abd", 3, None)
    with pytest.raises(ValueError):
        warc.parse(raw)
