"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it as context, then the
reply, which alone is trainable.  A conversation that does not end with an assistant's
turn has one more example without a target, so that the output holds every turn.

    <turn ROLE>TEXT</turn>\\n        per turn; the mask covers TEXT of the target

Inside roles and texts a backslash stands before each backslash, ``<`` and ``>``, so the
control strings cannot occur there and reading back restores every character.

Null text and null role are empty.  Turns are ordered by turn, ties by role and text;
repeated rows are turns of their own; null turns come first.  Rows without a conversation
id are conversations of one turn each.  Other columns are ignored.  A conversation is as large as
its last example, which has to be one row (below two gigabytes); no other rows are held together.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import batch

ASSISTANT = "assistant"

_SPECIAL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)

EXAMPLES = "conv_id long, example int, last boolean, text string, loss_start int, loss_length int"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_length", pa.int32())]
)


def escaped(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted example."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError("not a formatted example")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def _examples(turns: list[tuple[str, str]]):
    """(text, loss start, loss length) of each example of a conversation."""
    context = ""
    for i, (role, text) in enumerate(turns):
        head, body = f"<turn {escaped(role)}>", escaped(text)
        start = len(context) + len(head)
        context = f"{context}{head}{body}</turn>\n"
        if role == ASSISTANT:
            yield context, start, len(body)
        elif i == len(turns) - 1:
            yield context, 0, 0


def _alone():
    """Tells rows without a conversation id apart; null for the others."""
    return F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id``, ``example``, ``last``, ``text``, the mask's place and length in it."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).withColumn("alone", _alone())
    held = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def work(batches):
        for rows in batches:
            for conv_id, turns in zip(rows.column("conv_id").to_pylist(), rows.column("turns")):
                own = [(t["role"], t["text"]) for t in turns.as_py()]
                ends = [i for i, (role, _) in enumerate(own) if role == ASSISTANT or i == len(own) - 1]
                for k, (text, start, length) in enumerate(_examples(own)):
                    yield batch(_SCHEMA, [conv_id], [k], [k == len(ends) - 1], [text], [start], [length])

    return held.mapInArrow(work, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, from the examples alone."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("chars", pa.int64())]
    )

    def work(batches):
        for rows in batches:
            columns = [rows.column(n).to_pylist() for n in ("conv_id", "example", "last", "loss_start", "loss_length")]
            out = []
            for conv_id, example, last, start, length, text in zip(*columns, rows.column("text").to_pylist()):
                n_turns = digest = None
                if last:
                    turns = turns_of(text)
                    n_turns = len(turns)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv_id, example, n_turns, digest, unescaped(text[start : start + length]), len(text)))
            yield batch(schema, *zip(*out)) if out else batch(schema, *[[]] * 6)

    read = examples.mapInArrow(work, "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    digests = read.withColumn("alone", _alone()).groupBy("conv_id", "alone").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        whole.alias("loss"), F.sum("chars").alias("formatted_chars"),
    )
    return digests.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
