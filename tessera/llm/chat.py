"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  Successive
prefixes of a conversation are rendered; the part that a prefix adds to the one
before is its last turn's span.  If a prefix does not extend the one before,
the template rewrites history, and the row says from where.  The span of a
turn's text is found the same way: two renderings that differ in one character
of the text share the turn's head and tail.

Conversations stream through a sorted partition.  Whole prefixes are rendered,
whose cost grows with the square of a conversation's turns, unless the template
is declared ``turn_local``: it renders every turn by itself, one after the other.
Then prefixes start at the last ``CONTEXT_TURNS`` turns, a worker holds no more
than those, and a long conversation is linear.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTEXT_TURNS = 2
#: Fixed control strings of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Put one more backslash into every ``<|``, ``<\\|``, ...; no ``<|`` remains."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_local(render: Template) -> Template:
    """Declare that a template's output is that of its turns one by one; this is not checked."""
    render.turn_local = True
    return render


@turn_local
def marked_turns(turns: list[Turn]) -> str:
    """The default template: each turn between control strings, the role on a line of its own."""
    return "".join(f"{BEGIN}{_escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse_marked(formatted: str) -> list[Turn]:
    """Read the turns back from text that ``marked_turns`` has made."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        out.append((_unescape_role(formatted[at + len(BEGIN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def text_span(render: Template, context: list[Turn], role: str, before: int, length: int) -> tuple[int, int]:
    """Where the last turn's text begins and ends within its span of ``length`` characters."""
    a, b = (render([*context, (role, x)])[before:] for x in "ab")
    head = common_prefix(a, b)
    tail = common_prefix(a[:head:-1], b[:head:-1])
    return min(head, length), max(min(head, length), length - tail)


def spans(turns: Iterator[Turn], render: Template = marked_turns) -> Iterator[dict]:
    """One record per turn: its span's text, its text's place in it, and any rewriting.

    ``piece`` is what the prefix adds; for a template that rewrites history it
    is what follows the part in common, and ``rewrites_from`` its beginning
    within the prefix rendered before (null otherwise).
    """
    context: list[Turn] = []
    before, offset, local = render([]), 0, getattr(render, "turn_local", False)
    for number, (role, text) in enumerate(turns):
        if local and len(context) > CONTEXT_TURNS:
            context = context[-CONTEXT_TURNS:]
            shorter = render(context)
            offset += len(before) - len(shorter)
            before = shorter
        now = render([*context, (role, text)])
        same = now.startswith(before)
        start = len(before) if same else common_prefix(before, now)
        piece = now[start:]
        begin, end = text_span(render, context, role, start, len(piece))
        yield {
            "turn_no": number, "role": role, "piece": piece, "text_begin": begin, "text_end": end,
            "loss": role == "assistant", "rewrites_from": None if same else offset + start,
        }
        context.append((role, text))
        before = now


SPAN_SCHEMA = "conv_id long, turn_no long, role string, piece string, text_begin long, text_end long, loss boolean, rewrites_from long"
_SPAN_NAMES = [x.split()[0] for x in SPAN_SCHEMA.split(", ")]
_SPAN_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Neighbouring rows of one conversation, without holding them."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def format_turns(conversations: DataFrame, render: Template = marked_turns) -> DataFrame:
    """One row per turn, sorted by turn within each conversation's partition.

    Turns follow ``turn`` (null first; ties by role, then text).  Null text and
    role are empty.  Rows without ``conv_id`` are one conversation of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in _groups(_rows(batches)):
                for s in spans(((r[2] or "", r[3] or "") for r in rows), render):
                    yield (conv, *s.values())

        yield from _batched(made(), _SPAN_NAMES, _SPAN_TYPES)

    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SPAN_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]


def digests(spans_of_turns: DataFrame) -> DataFrame:
    """Per conversation, what is read back from the spans of ``format_turns``.

    The spans must still be in that function's order; digests are updated turn
    by turn, so a conversation of any length takes constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in _groups(_rows(batches)):
                turns, loss, n, loss_chars, chars, rewrites = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
                for _, _, _, piece, begin, end, masked, rewritten in rows:
                    for role, text in parse_marked(piece):
                        turns.update(f"{role}\n{text}\n".encode())
                        n += 1
                    if masked:
                        own = unescape(piece[begin:end])
                        loss.update(own.encode())
                        loss_chars += len(own)
                    chars += len(piece)
                    rewrites |= rewritten is not None
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites

        yield from _batched(made(), [x.split()[0] for x in DIGEST_SCHEMA.split(", ")], _DIGEST_TYPES)

    return spans_of_turns.mapInArrow(run, DIGEST_SCHEMA)
