"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is not asked where its turns are:
each prefix of a conversation is rendered, and what one output has beyond the output before it is
the span of the newest turn. A template whose next output does not begin with the last one rewrites
history; then the span begins where the two outputs part, and the conversation is marked.

The rows of a conversation are brought together by a sort within hash partitions and streamed, so a
task holds one conversation at a time. Rendering prefixes takes time with the square of a
conversation's length in characters; that is the price of a black box.

Defined results: turns go by (turn, role, text), nulls first, so ties and repeated rows have one
order. A null role or text counts as empty. A null conv_id is a conversation like any other. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Marks of the tagged template (fixed values).
OPEN, CLOSE, ESCAPE = "### ", " </turn>\n", "\\"
_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in _NAMES.items()}


def escape(text: str) -> str:
    """Text in which no mark of the template can begin: each backslash, #, < and colon gets a backslash in front."""
    for c in ("\\", "#", "<", ":"):
        text = text.replace(c, ESCAPE + c)
    return text


def unescape(text: str) -> str:
    """The reverse of escape."""
    if ESCAPE not in text:
        return text
    out, i = [], 0
    while (k := text.find(ESCAPE, i)) >= 0 and k + 1 < len(text):
        out += text[i:k], text[k + 1]
        i = k + 2
    return "".join(out) + text[i:]


def tagged_template(turns: list[Turn]) -> str:
    """'### Role: text </turn>' and a line feed for each turn; control strings in roles and texts are escaped."""
    return "".join(f"{OPEN}{_NAMES.get(role, escape(role))}: {escape(text)}{CLOSE}" for role, text in turns)


def read_tagged_turn(piece: str) -> Turn:
    """The turn that one piece of the tagged template's output stands for."""
    body = piece.removeprefix(OPEN)
    i = 0
    while body[i] != ":":
        i += 2 if body[i] == ESCAPE else 1
    name = body[:i]
    return _ROLES.get(name, unescape(name)), unescape(body[i + 2 : len(body) - len(CLOSE)])


def tagged_text_bounds(piece: str) -> tuple[int, int]:
    """Where, in one piece of the tagged template's output, the escaped text is."""
    i = len(OPEN)
    while piece[i] != ":":
        i += 2 if piece[i] == ESCAPE else 1
    return i + 2, len(piece) - len(CLOSE)


@dataclass
class Rendered:
    """A conversation's output, the span of each turn in it, and whether the template rewrote history."""

    text: str
    spans: list[tuple[int, int]]
    rewritten: bool


def render_incrementally(turns: list[Turn], template: Template) -> Rendered:
    """Renders each prefix and compares consecutive outputs."""
    before, spans, rewritten = template([]), [], False
    for n in range(1, len(turns) + 1):
        now = template(turns[:n])
        if now.startswith(before):
            start = len(before)
        else:
            rewritten = True
            start = _parting(before, now)
            spans = [(a, min(b, start)) if a < start else (start, start) for a, b in spans]
        spans.append((start, len(now)))
        before = now
    return Rendered(before, spans, rewritten)


def _parting(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


_FORMATTED = "conv_id long, n_turns long, text string, turn_spans array<array<int>>, loss_spans array<array<int>>, rewritten boolean"
_FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("turn_spans", pa.list_(pa.list_(pa.int32()))), ("loss_spans", pa.list_(pa.list_(pa.int32()))), ("rewritten", pa.bool_())])


def _formatter(template: Template, text_bounds, loss_role: str):
    def formatted(conv_id, turns: list[Turn]) -> tuple:
        r = render_incrementally(turns, template)
        loss = []
        for (role, _), (a, b) in zip(turns, r.spans):
            if role == loss_role:
                low, high = text_bounds(r.text[a:b])
                loss.append([a + low, a + high])
        return conv_id, len(turns), r.text, [list(x) for x in r.spans], loss, r.rewritten

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        turns: list[Turn] = []
        at, begun, held = None, False, 0
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv_id != at:
                    out.append(formatted(at, turns))
                    held += len(out[-1][2])
                    turns = []
                at, begun = conv_id, True
                turns.append((role or "", text or ""))
                if len(out) >= 5000 or held > 4_000_000:
                    yield _rows(out)
                    out, held = [], 0
        if begun:
            out.append(formatted(at, turns))
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FORMATTED_ARROW)], schema=_FORMATTED_ARROW)


def format_conversations(turns: DataFrame, template: Template = tagged_template, text_bounds=tagged_text_bounds, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, text, turn_spans, loss_spans, rewritten: one row for each conversation.

    ``text_bounds`` tells where the text is in the piece of a turn under the loss; spans count code points.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_formatter(template, text_bounds, loss_role), _FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv_id, n, text, spans, loss, rewritten in zip(*(c.to_pylist() for c in batch.columns)):
            turns = [read_tagged_turn(text[a:b]) for a, b in spans]
            told = "".join(unescape(text[a:b]) for a, b in loss)
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), told)]
            out.append((conv_id, n, sha[0], len(told), sha[1], len(text), rewritten))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def format_digests(turns: DataFrame) -> DataFrame:
    """What the tagged template's output says when it is read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten."""
    return format_conversations(turns).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
