"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all preceding turns as context and one reply as its target; the loss mask covers the text of that reply
and nothing else. A turn is written ``<|turn|>role\\ntext<|end|>\\n``. Turns behind the last reply (or all turns of a
conversation without one) make a last example without a target, so that every turn can be read back.

Control strings inside texts are escaped by one more ``~`` behind their first character, control strings that already
hold such marks among them, so no escaped text holds a control string and taking one mark away restores it. Roles are
URL-encoded, which changes no ordinary role.

``expand`` gives each example as a row with the turns that it adds and the place of its target in the whole example, linear in
the input. ``examples`` writes each out with its whole context, which grows with the square of a conversation's turns: that
is the method's output. ``digests`` writes these whole examples down and ``read_back`` works on them alone: it cuts each
target out of its example by the loss mask, measures each example, and takes the turns out of the last one.

The rows of a conversation are sorted in one task, which also writes its examples; it holds the turns of one conversation
once and one example, and each example is one string, so at most 2 GB.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null text or role counts as empty; repeated rows
are repeated turns; a null conversation id is a conversation; no rows, no result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Strings that open and close turns, and what follows the first character of a control string of this or
#: of other common templates.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
ANGLE, SQUARE = r"(\|[A-Za-z0-9_]+\|>|/?s>)", r"(/?INST\])"
REPLY = "assistant"


def escape(text: Column) -> Column:
    """Put one mark into every control string, marked ones too."""
    return F.regexp_replace(F.regexp_replace(text, "(<)(~*)" + ANGLE, "$1~$2$3"), r"(\[)(~*)" + SQUARE, "$1~$2$3")


def unescape(text: Column) -> Column:
    """Take one mark out of every marked control string."""
    return F.regexp_replace(F.regexp_replace(text, "(<)~(~*)" + ANGLE, "$1$2$3"), r"(\[)~(~*)" + SQUARE, "$1$2$3")


def expand(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each example: conv_id, example (number of its last turn), text (the turns behind the example before),
    loss_start and loss_chars (code points in the whole example; null without a target)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"head": F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")), "body": escape(F.col("text")), "reply": F.col("role") == REPLY})
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # Windows and aggregation share one exchange by conversation.
    rows = rows.withColumns(
        {
            "n": F.row_number().over(order),
            "start": F.coalesce(F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(before), F.lit(0)) + F.length("head"),
            "part": F.coalesce(F.count_if("reply").over(before), F.lit(0)),
        }
    )
    target = F.struct("start", F.length("body").cast("long").alias("chars"))
    made = rows.groupBy("conv_id", "part").agg(
        F.max("n").alias("example"),
        F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("piece")))).alias("pieces"),
        F.max(F.when(F.col("reply"), target)).alias("target"),  # a part has one reply at most
    )
    joined = F.array_join(F.transform("pieces", lambda p: p.piece), "")
    return made.select("conv_id", "example", joined.alias("text"), F.col("target.start").alias("loss_start"), F.col("target.chars").alias("loss_chars"))


def examples(expanded: DataFrame) -> DataFrame:
    """The rows of ``expand`` written out, each with its whole context: conv_id, example, text, loss_start, loss_chars, final
    (whether it is the last of its conversation, which holds all turns)."""
    order = W.partitionBy("conv_id").orderBy("example")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    final = F.lead("example").over(order).isNull()
    return expanded.select("conv_id", "example", F.array_join(F.collect_list("text").over(upto), "").alias("text"), "loss_start", "loss_chars", final.alias("final"))


def read_back(written: DataFrame) -> DataFrame:
    """For each row of ``examples``: conv_id, example, turns (array of struct: role, text; null but for the final example, as
    the others repeat its beginning), target (the text under its loss mask; null without one), chars."""
    parts = F.expr(f"filter(split(text, '{_quoted(CLOSE)}', -1), p -> p != '')")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), "\n", 1)).alias("role"),
            unescape(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )
    masked = F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_chars as int))")
    return written.select("conv_id", "example", F.when(F.col("final"), turns).alias("turns"), unescape(masked).alias("target"), F.length("text").cast("long").alias("chars"))


def _quoted(literal: str) -> str:
    """A literal as a regular expression inside an SQL string."""
    return literal.replace("|", "\\\\|").replace("\n", "\\\\n")


def digests(expanded: DataFrame) -> DataFrame:
    """The examples are written out whole; what is read back from them, as counts and hashes."""
    written = materialise(examples(expanded), "chat")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = read_back(written).select("conv_id", "example", F.when(F.col("turns").isNotNull(), F.size("turns")).alias("n"), said.alias("said"), "target", "chars")
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", F.coalesce(c, F.lit("")).alias("x")))), lambda s: s.x), "")
    # Only the final example has turns, so joining the texts in order gives its text alone.
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), in_order(F.col("said")).alias("said"), in_order(F.col("target")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
