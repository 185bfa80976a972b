"""Chat formatting with a compiled template, and reading formatted conversations back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, parallelism, small_batches
from .templates import Stream, compile_template

#: The strings that mark turns. In texts they get a backslash after their first character (one more, if they have some).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role | escape }} [/ROLE]{{ m.text | escape }}</s>"
    "{% endif %}{% endfor %}"
)

_RESTS = "|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in CONTROLS)
_ANY = re.compile(_RESTS)


def escape(text: str) -> str:
    return _ANY.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def read_back(formatted: str, first: bool = True) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a conversation that TEMPLATE has formatted, or of a later part of one."""
    if first and not formatted.startswith("<s>"):
        raise ValueError("not a formatted conversation")
    at, turns = 3 if first else 0, []

    def until(end: str) -> str:
        nonlocal at
        to = formatted.index(end, at)
        piece, at = formatted[at:to], to + len(end)
        return unescape(piece)

    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            at += len("[INST] ")
            turns.append(("user", until(" [/INST]")))
        elif formatted.startswith("[ROLE] ", at):
            at += len("[ROLE] ")
            role = until(" [/ROLE]")
            turns.append((role, until("</s>")))
        else:
            turns.append(("assistant", until("</s>")))
    return turns


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, part, formatted, loss (start, end of each stretch under the mask, in code points of the part).

    rows: conv_id, turn, role, text. Turns are in order of turn, then role, then text, nulls first.
    Null roles and texts are empty. Rows without a conv_id are one conversation. Repeated rows are
    repeated turns. A conversation is one row, part 0; a longer one than part_chars comes in several
    parts, cut between turns, so that a task holds about two turns and a part of the longest
    conversation, not the whole of it. No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, escape)
        parts: list[tuple] = []

        def turns() -> Iterator[tuple]:
            for batch in small_batches(batches, 256):
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.string(), _SPANS)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], ["conv_id", "part", "formatted", "loss"])
            parts.clear()
            return out

        for conv, group in groupby(turns(), key=lambda x: x[0]):
            pieces: list[str] = []
            spans: list[dict] = []
            held = number = 0

            def close() -> None:
                nonlocal held, number
                parts.append((conv, number, "".join(pieces), list(spans)))  # noqa: B023
                pieces.clear()  # noqa: B023
                spans.clear()  # noqa: B023
                held, number = 0, number + 1  # noqa: B023

            def messages() -> Iterator[dict]:
                for _, role, text in group:  # noqa: B023
                    if held >= part_chars:  # the turns before the one in hand are complete
                        close()  # noqa: B023
                    yield {"role": role or "", "text": text or ""}

            for text, marked in render.pieces({"messages": Stream(messages())}):
                if marked:
                    spans.append({"start": held, "end": held + len(text)})
                pieces.append(text)
                held += len(text)
                if len(parts) >= 8 and sum(len(x[2]) for x in parts) >= part_chars:
                    yield batch()
            close()
            if len(parts) >= 256:
                yield batch()
        if parts:
            yield batch()

    x = columns_of(rows, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    x = x.repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return x.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>")


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted conversations.

    in_order: the parts of a conversation follow each other in one partition, as they do in what
    format_conversations() returns; else they are put in order first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in small_batches(batches, 64):
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        for conv, group in groupby(parts(), key=lambda x: x[0]):
            n = chars = loss_chars = 0
            whole, loss = hashlib.sha256(), hashlib.sha256()
            for _, part, text, spans in group:
                for role, said in read_back(text, part == 0):
                    n += 1
                    whole.update(f"{role}\n{said}\n".encode())
                for x in spans:
                    said = unescape(text[x["start"] : x["end"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
                chars += len(text)
            done.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(done) >= 512:
                yield batch()
        if done:
            yield batch()

    x = columns_of(formatted, "conv_id", "part", "formatted", "loss")
    if not in_order:
        x = x.repartition(parallelism(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return x.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
