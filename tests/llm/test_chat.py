import hashlib

import pytest

from tessella.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "<~|end|>", "<~~~|end|> [~INST] [[INST]", "", "\n", "~", "<|end|", "<<|end|>", "[/INST]]", "é😀<s>"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    *((1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(TRICKY)),
    (2, 0, "user", "no reply", None),
    (3, 1, "assistant", None, None),
    (3, 0, None, "first", None),
    (4, None, "a\nb|<s>", "odd role", None),
    (4, 5, "assistant", "same", None),
    (4, 5, "assistant", "same", None),
    (None, 0, "assistant", "z" * 100_000, None),
]


def brute(rows):
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows", [ROWS, []])
def test_digests(spark, rows):
    got = chat.digests(chat.expand(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_examples(spark):
    made = chat.expand(spark.createDataFrame(ROWS, SCHEMA))
    got = chat.examples(made).collect()
    replies = [r for r in ROWS if r[2] == "assistant"]
    assert sum(r.loss_start is not None for r in got) == len(replies)
    by_conv = {}
    for r in sorted(got, key=lambda r: r.example):
        by_conv.setdefault(r.conv_id, []).append(r)
    assert sum(len(r.text) for r in got) == sum(r.formatted_chars for r in chat.digests(made).collect())
    for rs in by_conv.values():
        for a, b in zip(rs, rs[1:]):
            assert b.text.startswith(a.text)
    one = by_conv[3][0]
    assert one.text == "<|turn|>\nfirst<|end|>\n<|turn|>assistant\n<|end|>\n" and one.loss_chars == 0
    masked = [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in by_conv[4]]
    assert masked == ["same", "same"]
    assert by_conv[2][0].loss_start is None


def test_the_mask_decides_what_is_read(spark):
    made = chat.expand(spark.createDataFrame(ROWS, SCHEMA))
    right = {r.conv_id: r for r in chat.digests(made).collect()}
    moved = {r.conv_id: r for r in chat.digests(made.withColumn("loss_start", chat.F.col("loss_start") - 1)).collect()}
    short = {r.conv_id: r for r in chat.digests(made.withColumn("loss_chars", chat.F.greatest(chat.F.col("loss_chars") - 1, chat.F.lit(0)))).collect()}
    for c in (1, 4, None):
        assert moved[c].loss_sha256 != right[c].loss_sha256 != short[c].loss_sha256 and short[c].loss_chars < right[c].loss_chars
    assert moved[2] == right[2]


def test_a_long_conversation_stays_linear(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}", None) for i in range(3000)]
    made = chat.expand(spark.createDataFrame(rows, SCHEMA))
    assert made.count() == 1500 and sum(len(r.text) for r in made.select("text").collect()) < 40 * len(rows)
    got = chat.digests(made).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == brute(rows)[1]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    got = df.select("t", chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    assert not any(c in r.e for r in got for c in ("<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_targets_are_read_out_of_whole_examples(spark):
    """What is read back is the written examples, each with its whole context."""
    made = chat.expand(spark.createDataFrame(ROWS, SCHEMA))
    written = chat.examples(made)
    got = {(r.conv_id, r.example): r for r in chat.read_back(written).collect()}
    for r in written.collect():
        seen = got[r.conv_id, r.example]
        assert seen.chars == len(r.text)
        assert r.final == (r.example == max(e for c, e in got if c == r.conv_id))
        assert (seen.turns is not None) == r.final and (not r.final or len(seen.turns) == r.example)
    # Another context moves what lies under the mask.
    text = chat.F.concat(chat.F.lit("x"), "text")
    moved = {(r.conv_id, r.example): r for r in chat.read_back(written.withColumn("text", text)).collect()}
    assert any(moved[k].target != got[k].target for k in got)
