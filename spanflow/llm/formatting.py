"""Chat formatting from event logs.

A conversation is an ordered log of events.  The log is partitioned by
conversation, sorted by sequence number and folded, in one streaming pass, into
the final messages, which are rendered with a turn template.

Events (column ``kind``):

* ``message``    a whole message: opens a new turn with ``role`` and ``text``
* ``delta``      streamed text appended to message ``msg``; opens it if it is new
* ``edit``       replaces the text of message ``msg`` (opens it if it is new)
* ``regenerate`` drops message ``msg`` and everything after it; a later event opens the new version
* ``delete``     drops message ``msg`` alone

An event of any other kind, or of kind null, is no event.  A null role or text
is an empty one.  Events with equal sequence numbers are taken in the order of
(msg, kind, role, text), so that the result never depends on row order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

EVENT_COLUMNS = ("conv_id", "seq", "msg", "kind", "role", "text")


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``open`` role ``body`` text ``close``.

    ``controls`` are the strings that no text may hold unescaped, each as its
    first character and the rest; one backslash more goes between the two.
    That is undone exactly by taking one away, whatever the text.
    """

    open: str = "<|im_start|>"
    body: str = "\n"
    close: str = "<|im_end|>\n"
    target: str = "assistant"
    controls: tuple[tuple[str, str], ...] = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"))

    def _pattern(self, least: str) -> re.Pattern:
        tails: dict[str, list[str]] = {}
        for head, tail in self.controls:
            tails.setdefault(head, []).append(re.escape(tail))
        return re.compile("|".join(rf"(?<={re.escape(h)})\\{least}(?={'|'.join(t)})" for h, t in tails.items()))

    def escape(self, text: str) -> str:
        return self._pattern("*").sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        return self._pattern("+").sub(lambda m: m.group()[1:], text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), self.unescape(role))

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and the loss mask: code point ranges of the target role's texts."""
        parts, mask, at = [], [], 0
        for role, text in turns:
            head, text = self.open + self.escape_role(role) + self.body, self.escape(text)
            parts += [head, text, self.close]
            if role == self.target:
                mask.append((at + len(head), at + len(head) + len(text)))
            at += len(head) + len(text) + len(self.close)
        return "".join(parts), mask

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns read back from a formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            assert formatted.startswith(self.open, at), "not a formatted conversation"
            head = formatted.index(self.body, at + len(self.open))
            end = formatted.index(self.close, head + len(self.body))
            turns.append((self.unescape_role(formatted[at + len(self.open):head]),
                          self.unescape(formatted[head + len(self.body):end])))
            at = end + len(self.close)
        return turns


class Fold:
    """State of one conversation while its events stream by."""

    def __init__(self):
        self.turns: list[list] = []  # [message id, role, parts]

    def _find(self, msg) -> int:
        for i in range(len(self.turns) - 1, -1, -1):
            if self.turns[i][0] is not None and self.turns[i][0] == msg:
                return i
        return -1

    def add(self, msg, kind, role, text) -> None:
        if kind == "message":
            self.turns.append([msg, role or "", [text or ""]])
            return
        if kind not in ("delta", "edit", "regenerate", "delete"):
            return
        i = self._find(msg)
        if kind in ("regenerate", "delete"):
            if i >= 0:
                del self.turns[i:i + 1 if kind == "delete" else None]
        elif i < 0:
            self.turns.append([msg, role or "", [text or ""]])
        elif kind == "delta":
            self.turns[i][2].append(text or "")
        else:
            self.turns[i][2] = [text or ""]

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for _, role, parts in self.turns]


def format_conversations(events: DataFrame, template: Template = Template()) -> DataFrame:
    """Fold event logs (``conv_id, seq, msg, kind, role, text``) and render each conversation.

    Returns conv_id, n_turns, formatted and loss_mask (array of code point
    ranges).  Only the conversation at hand is held in memory.  The null
    conv_id is a conversation like any other; one without a final turn is
    rendered as an empty text; further columns of the input are left out.
    """
    kind = dict(events.dtypes)["conv_id"]
    order = ["conv_id", F.col("seq").asc_nulls_first(), F.col("msg").asc_nulls_first(), "kind", "role", "text"]
    # dealt out by conversation and sorted there: one exchange, no window and no group in memory
    dealt = events.select(*EVENT_COLUMNS).repartition("conv_id").sortWithinPartitions(*order)

    arrow = to_arrow_type(events.schema["conv_id"].dataType)
    mask_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv, out, size, begun = Fold(), None, [], 0, False

        def close() -> int:
            turns = fold.final()
            text, mask = template.render(turns)
            out.append((conv, len(turns), text, [{"start": a, "end": b} for a, b in mask]))
            return len(text)

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (arrow, pa.int64(), pa.string(), mask_type))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "formatted", "loss_mask"])

        for batch in batches:
            for c, msg, what, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if begun and c != conv:
                    size += close()
                    fold = Fold()
                    if size > 4 << 20:
                        yield flush()
                        size = 0
                conv, begun = c, True
                fold.add(msg, what, role, text)
        if begun:
            close()
        if out:
            yield flush()

    schema = f"conv_id {kind}, n_turns long, formatted string, loss_mask array<struct<start:long,end:long>>"
    return dealt.mapInArrow(run, schema)


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What ``op9`` returns, read back from formatted texts and their loss masks."""

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (to_arrow_type(formatted.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                turns = template.parse(text)
                sha = hashlib.sha256()
                for role, body in turns:
                    sha.update(f"{role}\n{body}\n".encode())
                under = "".join(template.unescape(text[m["start"]:m["end"]]) for m in mask)
                rows.append((conv, len(turns), sha.hexdigest(), len(under),
                             hashlib.sha256(under.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A log with one ``message`` event for each row of a ``conv_id, turn, role, text`` table."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg"),
                       F.lit("message").alias("kind"), "role", "text")
