"""Chat formatting by incremental black-box rendering.

A template is anything with `render(turns) -> str`. Where a turn lies in its output is found without looking
inside: successive prefixes of the conversation are rendered, and what a longer one adds to the shorter one is
the turn's span. Where the text lies in the span is found by rendering the turn once more with a marker in place
of its text. A template that changes what it rendered before is detected: the longer output then does not begin
with the shorter one, the turn's `rewrites` is true, and its span starts where both outputs part.

Turns are laid out by conversation and in order, and streamed. Prefixes are whole, so a task holds one
conversation, and its renderings grow with the square of its turns. Only a template that declares by `independent`
that it renders each turn by itself is spared that: its prefixes begin anew every `window` turns, with the turn
before as their context, so a task holds one window of turns and a conversation of any length costs at most
`window` renderings a turn. The declaration is the class's own: one that inherits the rest has to give it again.

Nulls: a null text or role is empty. A null conversation is a conversation of its own kind, a null turn comes
first. Rows that share a turn are ordered by role, then text; repeated rows are turns like others. An empty table
has no turns. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a text while its place is looked for: private-use characters that texts hardly hold.
MARKER = "\ue000{}\ue001"
WINDOW = 16


class Template(Protocol):
    def render(self, turns: list[tuple[str, str]]) -> str: ...

    def read(self, span: str) -> tuple[str, str]: ...

    def plain(self, content: str) -> str: ...


def independent(template: Template) -> bool:
    """Whether the very class of a template declares that it renders each turn by itself."""
    return bool(vars(type(template)).get("independent", False))


class ChatMarkup:
    """Turns between <|im_start|>role and <|im_end|>.

    In texts and roles one backslash is put before the bar of every `<` (backslashes) `|`, so no control string is
    left in them, and taken out again on reading. Roles also write line ends and backslashes as escapes.
    """

    independent = True
    _OPEN = re.compile(r"<(\\*)\|")
    _ESCAPED = re.compile(r"<\\(\\*)\|")
    _ROLE = {"\\": "\\\\", "\n": "\\n"}

    def escaped(self, text: str) -> str:
        return self._OPEN.sub(lambda m: "<\\" + m[1] + "|", text)

    def plain(self, content: str) -> str:
        return self._ESCAPED.sub(lambda m: "<" + m[1] + "|", content)

    def render(self, turns: list[tuple[str, str]]) -> str:
        return "".join(f"{START}{self._role(role)}\n{self.escaped(text)}{END}\n" for role, text in turns)

    def _role(self, role: str) -> str:
        return self.escaped("".join(self._ROLE.get(c, c) for c in role))

    def read(self, span: str) -> tuple[str, str]:
        """Role and text of one rendered turn."""
        head, content = span.split("\n", 1)
        if not (head.startswith(START) and content.endswith(END + "\n")):
            raise ValueError("not a rendered turn")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.plain(head[len(START) :]))
        return role, self.plain(content[: -len(END) - 1])


def added(before: str, after: str) -> tuple[int, bool]:
    """Where the longer rendering goes on from the shorter one, and whether it rewrites it."""
    if after.startswith(before):
        return len(before), False
    low, high = 0, min(len(before), len(after))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if before[:middle] == after[:middle] else (low, middle - 1)
    return low, True


class Rendering:
    """The running state of one conversation: its turns (of the window, if they are independent) and its rendering so far."""

    def __init__(self, template: Template, window: int):
        self.template, self.window = template, window if independent(template) else None
        self.turns: list[tuple[str, str]] = []
        self.text = ""
        self.passed = 0  # code points before the window

    def add(self, role: str, text: str) -> tuple[str, int, int, int, bool]:
        """The span that the turn adds, where it starts in the conversation, where its content starts and ends in it,
        and whether earlier text changed."""
        if self.window is not None and len(self.turns) > self.window:
            self.turns = self.turns[-1:]
            self.passed += len(self.text)
            self.text = self.template.render(self.turns)
            self.passed -= len(self.text)
        turns = [*self.turns, (role, text)]
        whole = self.template.render(turns)
        start, rewrites = added(self.text, whole)
        k = 0
        while MARKER.format(k) in whole:
            k += 1
        marker = MARKER.format(k)
        marked = self.template.render([*self.turns, (role, marker)])
        at = marked.rfind(marker)
        tail = len(marked) - at - len(marker)
        opened, closed = (at, len(whole) - tail) if at >= 0 else (start, start)
        if at >= 0 and (whole[:at] != marked[:at] or whole[closed:] != marked[at + len(marker) :]):
            rewrites = True
        self.turns, self.text = turns, whole
        return whole[start:], self.passed + start, max(0, opened - start), max(0, closed - start), rewrites


def content_place(template: Template, turns: list[tuple[str, str]], whole: str, k: int) -> tuple[int, int] | None:
    """Where the text of turn k stands in the rendering of all turns; None if the template leaves it out."""
    n = 0
    while MARKER.format(n) in whole:
        n += 1
    marker = MARKER.format(n)
    marked = template.render([*turns[:k], (turns[k][0], marker), *turns[k + 1 :]])
    at = marked.rfind(marker)
    return (at, max(at, len(whole) - (len(marked) - at - len(marker)))) if at >= 0 else None


def _laid_out(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(F.col("conv_id")).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def format_turns(conversations: DataFrame, template: Template | None = None, trained: tuple[str, ...] = ("assistant",), window: int = WINDOW) -> DataFrame:
    """A row for each turn, by conversation and in order within a partition: conv_id, place (from 0), span (the
    formatted text that the turn adds), start (of the span in the conversation so far, whose text from there on it
    replaces if the turn rewrites), opened and closed (of the
    content within the span, in code points), trained (whether the content is under the loss mask), rewrites."""
    markup = template or ChatMarkup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, state, place = object(), None, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != conversation:
                    conversation, state, place = conv, Rendering(markup, window), 0
                span, start, opened, closed, rewrites = state.add(role, text)
                rows.append((conv, place, span, start, opened, closed, role in trained, rewrites))
                place += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                names = ["conv_id", "place", "span", "start", "opened", "closed", "trained", "rewrites"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _laid_out(conversations).select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, place long, span string, start long, opened long, closed long, trained boolean, rewrites boolean"
    )


def format_conversations(conversations: DataFrame, template: Template | None = None, trained: tuple[str, ...] = ("assistant",), window: int = WINDOW) -> DataFrame:
    """conv_id, formatted (the rendering of all turns), loss_spans (start and end, in code points) and rewrites.

    Where a template rewrites, loss spans are looked for in the whole rendering, one more rendering a trained turn;
    texts that it leaves out have none. One row holds a whole conversation; use `format_turns` where conversations
    may be very long.
    """
    markup = template or ChatMarkup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
        names = ["conv_id", "formatted", "loss_spans", "rewrites"]
        conversation, state, turns, spans, losses, changed = object(), None, [], [], [], False

        def closed_one() -> pa.RecordBatch:
            formatted, places = "".join(spans), losses
            if changed:
                formatted = markup.render(turns)
                places = [content_place(markup, turns, formatted, k) for k, (role, _) in enumerate(turns) if role in trained]
            found = [{"start": p[0], "end": p[1]} for p in sorted(p for p in places if p is not None)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((conversation, formatted, found, changed), kinds, strict=True)], names=names)

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != conversation:
                    if state is not None:
                        yield closed_one()
                    conversation, state, turns, spans, losses, changed = conv, Rendering(markup, window), [], [], [], False
                span, start, opened, closed, rewrites = state.add(role, text)
                turns.append((role, text))
                spans.append(span)
                if role in trained:
                    losses.append((start + opened, start + closed))
                changed |= rewrites
        if state is not None:
            yield closed_one()

    return _laid_out(conversations).select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, rewrites boolean"
    )


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """What formatted turns say, read from their spans alone: conv_id, n_turns, turns_sha256 (role, line end, text,
    line end a turn), loss_chars and loss_sha256 of the trained contents, formatted_chars, rewrites.

    `turns` must come straight from `format_turns`, whose order within a partition it relies on. Digests are
    taken as the turns pass by.
    """
    markup = template or ChatMarkup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, done = None, []

        def close() -> None:
            if now is not None:
                conv, n, turns_digest, chars, loss_digest, size, rewrites = now
                done.append((conv, n, turns_digest.hexdigest(), chars, loss_digest.hexdigest(), size, rewrites))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["place"] == 0:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                role, text = markup.read(row["span"])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if row["trained"]:
                    loss = markup.plain(row["span"][row["opened"] : row["closed"]])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] = row["start"] + len(row["span"])
                now[6] |= row["rewrites"]
            if done:
                yield table()
                done.clear()
        close()
        if done:
            yield table()

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
