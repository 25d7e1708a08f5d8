import base64
import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tessella.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = "' 's 'll 're 've 'd 'm 't re ll s a bc 1 23 ½ é ß 中 文 ! ? ... 😀 ́ _ don't The".split() + [" ", "  ", " ", "\n", "\t", "\r\n", " ", "\x00", "x" * 70, "!" * 90, " " * 80]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("small", [False, True])
def test_random_texts(library, small):
    codec = bpe.Codec(PATH, **({"cache_pieces": 7, "chunk_chars": 16} if small else {}))
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 30))) for _ in range(3000)]
    together = codec.encode_many(texts)
    for text, packed in zip(texts, together):
        want = library.encode_ordinary(text)
        ids, offsets = codec.encode(text)
        assert ids.tolist() == want == np.frombuffer(packed, "<u4").tolist(), text
        assert codec.decode(ids) == text.encode()
        raw = text.encode()
        assert [raw[a:b] for a, b in zip(offsets, offsets[1:])] == [codec.vocabulary[i] for i in ids]


def test_long_pieces(library):
    codec = bpe.Codec(PATH)
    for text in ("ab" * 5000, "thequickbrownfox" * 300, "é" * 3000, "a" * 65 + "b" * 70):
        assert codec.encode(text)[0].tolist() == library.encode_ordinary(text)


def test_every_code_point_in_context(library):
    codec = bpe.Codec(PATH)
    for lo in range(0, 0x110000, 0x800):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(lo, lo + 0x800, 7) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text)[0].tolist() == library.encode_ordinary(text)


def test_digests(spark, library):
    rows = [(1, "It's a don't\n\n  test 's", "x"), (2, None, "y"), (None, "", "z"), (2, None, "y"), (3, "long text " * 30_000, "w")]
    schema = "doc_id long, text string, ids_sha256 string"
    got = bpe.digests(spark.createDataFrame(rows, schema), PATH).collect()
    want = []
    for i, text, _ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(spark.createDataFrame([], schema), PATH).count() == 0
    one = bpe.encode_ids(spark.createDataFrame(rows[:1], schema), PATH).first()
    assert one.ids == library.encode_ordinary(rows[0][1]) and one.offsets[-1] == len(rows[0][1].encode())
    both = spark.createDataFrame([("k1", rows[0][1]), (None, None), ("k2", "é" * 9 + " 😀")], "name string, text string")
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_ids(bpe.encode_ids(both, PATH, "name"), PATH).collect()} == {r.name: r.text or "" for r in both.collect()}
    assert {r.doc_id for r in bpe.digests(both, PATH, "name").collect()} == {"k1", "k2", None}
