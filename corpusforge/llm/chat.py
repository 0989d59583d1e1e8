"""Chat formatting in budgeted windows.

A conversation becomes one or more training texts of at most ``budget`` tokens.  Prefix sums
of the turns' tokens choose each window's span of new turns.  A window after the first one
repeats the system turn (the first turn, if its role is ``system``) and as many of the turns
before its span as ``history`` tokens and the budget beside the first new turn allow; where that
turn has no room beside the system turn, this isn't repeated, either.  The loss mask covers the texts of assistant
turns in the span; repeated ones are context only.  So every assistant text is a target once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles and texts a
backslash is written twice and ``<|`` as ``<\\|``, in roles a line feed as ``\\n``, so that
no control string can come from data and everything reads back.

Turns are counted in parallel, dealt by conversation, sorted, and then streamed: a task holds
one window's turns, however long the conversation is.

Edges: null text and role are empty; a turn over the budget is a window by itself, whole;
turns of equal number are ordered by role and text; a null conversation is one of its own;
repeated rows are turns like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import bpe

START, END, ROLE_SYSTEM, ROLE_TARGET = "<|im_start|>", "<|im_end|>", "system", "assistant"
#: Tokens of a turn's template besides role and text.
FRAME = 5


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss spans in code points) of turns, the first ``repeated`` of which are context."""
    parts, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{escape(role, role=True)}\n", escape(text)
        parts += [head, body, END, "\n"]
        if role == ROLE_TARGET and i >= repeated:
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(END, line)
        yield unescape(text[at + len(START) : line]), unescape(text[line + 1 : stop])
        at = stop + len(END) + 1


class Windows:
    """Takes one conversation's turns in order and gives its windows as soon as they are full."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.before: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]  # of the tokens of self.turns
        self.first = True

    def add(self, role: str, text: str, tokens: int):
        if self.first and self.system is None and not self.turns and role == ROLE_SYSTEM:
            self.system = (role, text, tokens)
            return
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        while self.turns and self.sums[-1] > self._room():
            while self.before and self.sums[1] > self._room():
                self.before.pop(0)
            if self.system and self.sums[1] > self._room():
                # No room beside the system turn: it goes first by itself, later it isn't repeated here.
                alone = not self.first
                yield self._take(max(1, bisect_right(self.sums, self.budget) - 1) if alone else 0, alone)
            elif self.sums[-1] > self._room():
                yield self._take(max(1, bisect_right(self.sums, self._room()) - 1))

    def _room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0) - sum(t[2] for t in self.before)

    def end(self):
        if self.turns or self.first:
            yield self._take(len(self.turns))

    def _take(self, n: int, alone: bool = False):
        system = [self.system] if self.system and not alone else []
        new = self.turns[:n]
        repeated = (0 if self.first else len(system)) + len(self.before)
        out = [(r, t) for r, t, _ in [*system, *self.before, *new]], repeated
        self.turns = self.turns[n:]
        self.sums = [s - self.sums[n] for s in self.sums[n:]]
        kept, left = [], self.history
        for turn in reversed([*self.before, *new]):
            if turn[2] > left:
                break
            kept.append(turn)
            left -= turn[2]
        self.before, self.first = kept[::-1], False
        return out


def format_conversations(rows: DataFrame, rank_lines: bytes, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, window, n_repeated, loss array<struct<begin, stop>>, text), each conversation's windows in order."""
    ranks = rows.sparkSession.sparkContext.broadcast(rank_lines)
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))

    def count(batches):
        enc = bpe.encoder(ranks.value)
        for batch in batches:
            for part in bpe.slices(batch, "text", bpe.SLICE_BYTES):
                texts = [escape(r, role=True) + "\n" + escape(t) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
                tokens = [FRAME + sum([e[0] for e in found]) for _, found in enc.entries(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.int64())], [*part.schema.names, "tokens"])

    def run(batches):
        out: list[tuple] = []
        windows, conv, number, conv_type = None, None, 0, pa.int64()

        def put(full):
            nonlocal number
            for listed, repeated in full:
                text, loss = render(listed, repeated)
                out.append((conv, number, repeated, [{"begin": a, "stop": b} for a, b in loss], text))
                number += 1

        def flush():
            types = [conv_type, pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "window", "n_repeated", "loss", "text"])
            out.clear()
            return batch

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for c, role, text, tokens in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "tokens"))):
                if windows is None or c != conv:
                    if windows is not None:
                        put(windows.end())
                    windows, conv, number = Windows(budget, history), c, 0
                put(windows.add(role, text, tokens))
                if len(out) >= 1000:
                    yield flush()
        if windows is not None:
            put(windows.end())
        if out:
            yield flush()

    counted = turns.mapInArrow(count, f"conv_id {kind}, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, tokens long")
    dealt = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, window long, n_repeated long, loss array<struct<begin: bigint, stop: bigint>>, text string")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted
    windows, which must come as format_conversations gives them: together and in order."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, text) in enumerate(parse(row["text"])):
                    if i >= row["n_repeated"]:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    target = unescape(row["text"][span["begin"] : span["stop"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(row["text"])
            yield table(done, batch)
        if state:
            yield table([state], batch)

    def table(rows, like):
        cells = [[x if isinstance(x, int) or x is None else x.hexdigest() if hasattr(x, "hexdigest") else x for x in col] for col in zip(*rows)] or [[]] * 6
        types = [like.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names)

    return windows.select("conv_id", "n_repeated", "loss", "text").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
