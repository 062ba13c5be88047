"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose how many new turns fit the
budget beside the system turn, which every window repeats, and a limited history, the last turns of the window
before. Loss falls on the assistant's new turns only: repeated ones are masked, so each is learned once.

Rows are dealt by conversation, sorted by turn, and read as a stream with the open window as its only state, so a
conversation of any length takes no more memory than a window and a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import batches, small_batches, tokenizer_path, word_tokens

#: Tokens of a window, of them at most for history; turns of history; tokens that a turn's marks take.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS, MARKS = 2048, 512, 2, 4
SYSTEM, TARGET = "system", "assistant"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that control this template or common others. They don't occur inside formatted texts.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """A backslash after the first character of each control string; one more where some are there already."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _head(role: str) -> str:
    return BEGIN + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"


def _role(head: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head))


def parse(window: str) -> Iterator[tuple[str, str, int, int]]:
    """``role, text, start, end`` of each turn of a formatted window; the last two bound the escaped text."""
    at = 0
    while at < len(window):
        body = window.index("\n", at) + 1
        end = window.index(END, body)
        yield _role(window[at + len(BEGIN) : body - 1]), unescape(window[body:end]), body, end
        at = end + len(END)


class _Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv, budget: int, history_tokens: int, history_turns: int):
        self.conv, self.budget, self.history_tokens, self.history_turns = conv, budget, history_tokens, history_turns
        self.system: tuple | None = None
        self.count = self.number = 0
        self.turns: list[tuple] = []  # of the open window: role, text, tokens
        self.sums = [0]  # prefix sums of the window's tokens
        self.repeated = 0

    def _close(self):
        text, spans, at = [], [], 0
        for i, (role, body, _) in enumerate(self.turns):
            head, inner = _head(role), escape(body)
            start = at + len(head)
            if role == TARGET and i >= self.repeated:
                spans.append((start, start + len(inner)))
            text.append(head + inner + END)
            at += len(text[-1])
        self.number += 1
        return self.conv, self.number - 1, "".join(text), self.repeated, spans, sum(t[2] for t in self.turns)

    def _open(self, tokens: int) -> None:
        """The system turn, and as much history as leaves room for the next turn."""
        fixed = [self.system] if self.system else []
        room = self.budget - sum(t[2] for t in fixed) - tokens
        history, last = [], self.turns[max(self.repeated, len(fixed)) :] if self.repeated else self.turns[len(fixed) :]
        spent = 0
        for turn in reversed(last[-self.history_turns :] if self.history_turns else []):
            spent += turn[2]
            if spent > min(room, self.history_tokens):
                break
            history.insert(0, turn)
        self.turns = [*fixed, *history]
        self.repeated = len(self.turns)
        self.sums = [sum(t[2] for t in self.turns)]

    def add(self, role: str, text: str, tokens: int):
        """The window that this turn closes, if any."""
        closed = None
        new = len(self.turns) > self.repeated
        if new and self.sums[-1] + tokens > self.budget:
            closed = self._close()
            self._open(tokens)
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        if self.count == 0 and role == SYSTEM:
            self.system = self.turns[-1]
        self.count += 1
        return closed

    def end(self):
        return self._close()


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokenizer: str | None = None,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a window: the conversation's id, ``window`` (from 0), ``formatted``, ``n_repeated`` (turns at its start
    that stand in an earlier window), ``loss`` (array of start and end, in code points, of what is learned) and
    ``n_tokens`` (about: of the texts, and ``MARKS`` for each turn).

    Windows hold whole turns; a turn longer than the budget has a window of its own, with the system turn and without
    history. Only a system turn that comes first is repeated. Null text and role count as empty, rows without a
    conversation's id form one conversation, and turns with equal numbers come in order of role and text (nulls first
    everywhere). A conversation's windows come one after another in a partition. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    path = tokenizer or tokenizer_path()
    small_batches(turns.sparkSession)
    kind, conv_type = turns.schema[conv_col].dataType.simpleString(), to_arrow_type(turns.schema[conv_col].dataType)

    def run(frames):
        import pyarrow as pa

        types = (conv_type, pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64())
        names = [conv_col, "window", "formatted", "n_repeated", "loss", "n_tokens"]

        def out(rows):
            rows = [(*r[:4], [{"start": a, "end": b} for a, b in r[4]], r[5]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        tokens, open_ = word_tokens(path), None
        for batch in batches(frames):
            conv, _, role, text = (c.to_pylist() for c in batch.columns)
            _, offsets = tokens.encode(text)
            rows = []
            for c, r, t, n in zip(conv, role, text, (offsets[1:] - offsets[:-1]).tolist(), strict=True):
                if open_ is None or open_.conv != c:
                    if open_ is not None:
                        rows.append(open_.end())
                    open_ = _Windows(c, budget, history_tokens, history_turns)
                if (closed := open_.add(r or "", t or "", n + MARKS)) is not None:
                    rows.append(closed)
            yield out(rows)
        if open_ is not None:
            yield out([open_.end()])

    ordered = turns.select(conv_col, turn_col, role_col, text_col).repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, role_col, text_col)
    return ordered.mapInArrow(run, f"`{conv_col}` {kind}, window long, formatted string, n_repeated int, loss array<struct<start:int,end:int>>, n_tokens long")


def read_back(windows: DataFrame, conv_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """From :func:`format_windows`, one row a conversation: the id, ``n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``, all read from the formatted windows: repeated turns are passed over, and what is learned is
    what the loss spans cut out, unescaped. ``in_order``: windows come straight from there, one after another in a
    partition; otherwise they are put in order first. Windows may be missing: what is there is read."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, conv_type = windows.schema[conv_col].dataType.simpleString(), to_arrow_type(windows.schema[conv_col].dataType)

    def run(frames):
        import pyarrow as pa

        types = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done, state = [], None  # state: id, turns, digest, characters learned, their digest, characters

        def end():
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out():
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches(frames):
            for conv, number, formatted, repeated, loss in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or number == 0 or state[0] != conv:
                    if state is not None:
                        end()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, text, _, _) in enumerate(parse(formatted)):
                    if i >= repeated:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    learned = unescape(formatted[span["start"] : span["end"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(formatted)
            yield out()
        if state is not None:
            end()
            yield out()

    read = windows.select(conv_col, "window", "formatted", "n_repeated", "loss")
    if not in_order:
        read = read.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, "window")
    return read.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
