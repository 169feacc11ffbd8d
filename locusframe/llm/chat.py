"""Chat formatting by a finite-state machine over roles and a declarative template.

A template says how turns of each role open and close, whether their text is learned,
and which role may follow which.  Conversations are dealt by ranges of (conversation,
turn), so a very long one lies in several tasks.  Within a task the machine runs from
its start state, or, for the conversation that may have begun in the task before, from
all states at once; the last states of the tasks, one row each, then say which of them
was the right one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ident, lean, stored


@dataclass(frozen=True)
class Turn:
    """What stands before and after a turn's text, and whether the text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, a form for other roles, and the machine that says which turn may come.

    ``other`` opens with its ``open``, the role and its ``middle``.  ``moves`` leads from a state
    and a role to the next state; a turn that has no move is out of order and leads to the
    state ``resume`` gives for its role, or stays.  A conversation is complete in a state of ``ends``.
    """

    turns: dict[str, Turn]
    other: Turn
    middle: str
    moves: dict[tuple[str, str], str]
    resume: dict[str, str]
    ends: frozenset[str]
    start: str = "start"

    def __post_init__(self):
        marks = self.controls
        if any(not m or "\\" in m or len(m) < 2 for m in marks):
            raise ValueError("marks have two characters or more and no backslash")
        opens = [t.open for t in self.turns.values()] + [self.other.open]
        if any(x != y and x.startswith(y) for x in opens for y in opens) or len(set(opens)) < len(opens):
            raise ValueError("no turn may open as another one does")
        if any(m[k:] == m[: len(m) - k] for m in marks for k in range(1, len(m))):
            raise ValueError("no mark may end as it begins")

    @cached_property
    def controls(self) -> list[str]:
        return sorted({m for t in (*self.turns.values(), self.other) for m in (t.open, t.close)} | {self.middle}, key=lambda m: (-len(m), m))

    @cached_property
    def states(self) -> list[str]:
        found = {self.start, *self.ends, *self.resume.values(), *self.moves.values(), *(s for s, _ in self.moves)}
        return [self.start, *sorted(found - {self.start})]

    def move(self, state: int, role: str) -> tuple[int, bool]:
        """The next state, and whether the role may come in this one."""
        name = self.states[state]
        after = self.moves.get((name, role))
        return self.states.index(after or self.resume.get(role, name)), after is not None

    @cached_property
    def _firsts(self) -> list[str]:
        return sorted({m[0] for m in self.controls})

    @cached_property
    def _found(self):
        return re.compile("|".join(f"({re.escape(m[0])})(\\\\*)({re.escape(m[1:])})" for m in self.controls))

    def escape(self, text: str) -> str:
        r"""The text with one more backslash behind the first character of every mark, with or without some already."""
        return self._changed(text, lambda first, slashes, rest: first + "\\" + slashes + rest)

    def unescape(self, text: str) -> str:
        return self._changed(text, lambda first, slashes, rest: first + slashes[1:] + rest)

    def _changed(self, text: str, change) -> str:
        if not any(c in text for c in self._firsts):
            return text
        return self._found.sub(lambda m: change(*(x for x in m.groups() if x is not None)), text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, whether it is learned) of one turn."""
        turn = self.turns.get(role)
        if turn is None:
            return [(self.other.open + self.escape(role) + self.middle, False), (self.escape(text), self.other.loss), (self.other.close, False)]
        return [(turn.open, False), (self.escape(text), turn.loss), (turn.close, False)]

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """(role, text, first and last place of the escaped text) of every turn; raises for anything else."""
        out, at = [], 0
        while at < len(formatted):
            role = next((r for r, t in self.turns.items() if formatted.startswith(t.open, at)), None)
            if role is not None:
                at, close = at + len(self.turns[role].open), self.turns[role].close
            elif formatted.startswith(self.other.open, at):
                at += len(self.other.open)
                end = formatted.index(self.middle, at)
                role, at, close = self.unescape(formatted[at:end]), end + len(self.middle), self.other.close
            else:
                raise ValueError(f"no turn opens at {at}")
            end = formatted.index(close, at)
            out.append((role, self.unescape(formatted[at:end]), at, end))
            at = end + len(close)
        return out


#: Turns alternate, after at most one system turn; only assistants' texts are learned.
_MOVES = {
    ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked",
}
_RESUME = {"system": "told", "user": "asked", "assistant": "answered"}
INSTRUCT = Template(
    {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", True)},
    Turn("[ROLE]", "[/ROLE]"), "[TEXT]", _MOVES, _RESUME, frozenset({"answered"}),
)
HEADERS = Template(
    {r: Turn(f"<|{r}|>\n", "<|end|>\n", r == "assistant") for r in ("system", "user", "assistant")},
    Turn("<|role|>", "<|/role|>\n"), "<|text|>\n", _MOVES, _RESUME, frozenset({"answered"}),
)

_PART = "conv bigint, part int, nth bigint, first boolean, last boolean, edge boolean, role string, segments array<struct<text:string,loss:boolean>>, ok array<boolean>, after array<int>"


def formatted(template: Template):
    """A row per turn of a partition sorted by conversation; ``ok`` and ``after`` by the state that it may begin in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, every = TaskContext.get().partitionId(), list(range(len(template.states)))
        schema = pa.schema([
            ("conv", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("edge", pa.bool_()),
            ("role", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
            ("ok", pa.list_(pa.bool_())), ("after", pa.list_(pa.int32())),
        ])
        conv, nth, edge, state, kept = None, 0, True, every, None
        for b in batches:
            rows = []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if c != conv:
                    edge = conv is None  # this conversation may have begun in the task before
                    conv, nth, state = c, 0, every if edge else [0]
                    if kept:
                        kept["last"] = True
                moved = [template.move(s, role) for s in state]
                state = [s for s, _ in moved]
                if kept:
                    rows.append(kept)
                kept = {
                    "conv": c, "part": part, "nth": nth, "first": nth == 0 and not edge, "last": False, "edge": edge, "role": role,
                    "segments": [{"text": t, "loss": l} for t, l in template.segments(role, text)], "ok": [o for _, o in moved], "after": state,
                }
                nth += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if kept:
            yield pa.RecordBatch.from_pylist([kept], schema)

    return run


def carried(ends: list, states: int) -> list[tuple[int, int, int, int]]:
    """(part, conversation, turns before, state) of each part that goes on with the conversation of the one before.

    ``ends`` has the last turn of every part: part, conversation, number within the part,
    whether its conversation is the part's first, and state after it by first state.
    """
    out, conv, before, state = [], None, 0, 0
    for e in sorted(ends, key=lambda e: e["part"]):
        out.append((e["part"], conv, before, state))
        if e["edge"]:
            same = e["conv"] == conv
            conv, before, state = e["conv"], e["nth"] + 1 + (before if same else 0), e["after"][state if same else 0]
        else:
            conv, before, state = e["conv"], e["nth"] + 1, e["after"][0]
    return [x for x in out if x[1] is not None]


def format_chats(
    convs: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every turn as the segments of the template, with what the machine says of the order.

    Returns a row per input row: ``conv``, ``nth`` (from 0), ``role``, ``segments`` (text, loss),
    ``in_order`` (whether the machine has a move) and ``complete`` (whether a conversation might
    end behind this turn).  The segments of a conversation, in order, are its formatted text;
    ``read_chats`` takes it apart again.

    Turns go by ``turn_col``, null first; those of one turn by role, then text.  A null role or text
    is empty, a null conversation counts as the smallest bigint; repeated rows are turns each.
    Other columns are not read.  The driver sees one row per range of turns.
    """
    spark = convs.sparkSession
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    rows = lean(convs).select(ident(conv_col).alias("conv"), F.col(f"`{turn_col}`").alias("at"), role, text)
    # equal rows may go either way, so a number tells them apart in the ranges only
    order = [F.col("conv"), F.col("at").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stored(dealt.select("conv", "role", "text").mapInArrow(formatted(template), _PART), "turns")
    ends = turns.groupBy("part").agg(F.max_by(F.struct("conv", "nth", "edge", "after"), F.struct("conv", "nth")).alias("e")).select("part", "e.*").collect()
    carry = spark.createDataFrame(carried(ends, len(template.states)), "part int, conv bigint, before bigint, state int")
    state = F.when(F.size("ok") > 1, F.coalesce("state", F.lit(0))).otherwise(0)
    good = F.array(*[F.lit(s in template.ends) for s in template.states])
    # no more rows than ranges
    return turns.join(F.broadcast(carry), ["part", "conv"], "left").select(
        "conv", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "role", "segments",
        F.get("ok", state).alias("in_order"), F.get(good, F.get("after", state)).alias("complete"),
    )


def _read(template: Template):
    """Digests of what stands in each conversation's segments, which come in order; turns are parsed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "first_bad_turn", "complete"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        conv, now = None, None

        def close():
            return [conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5], now[6]]

        for b in batches:
            done = []
            for c, text, spans, ok, complete in zip(*(b.column(x).to_pylist() for x in ("conv", "formatted", "spans", "in_order", "complete"))):
                if now is None or c != conv:
                    if now is not None:
                        done.append(close())
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None, False]
                for role, said, _, _ in template.parse(text):
                    now[1].update(f"{role}\n{said}\n".encode())
                    if not ok and now[5] is None:
                        now[5] = now[0]
                    now[0] += 1
                for s in spans:
                    learned = template.unescape(text[s["start"] : s["start"] + s["size"]])
                    now[2] += len(learned)
                    now[3].update(learned.encode())
                now[4] += len(text)
                now[6] = complete
            yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)
        if now is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(close(), kinds)], names)

    return run


def joined(chats: DataFrame) -> DataFrame:
    """Each turn's text with its marks, and where the learned parts of it begin and how long they are.

    This is all that a reader gets: roles and texts are only in the formatted text.
    """
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    parts = F.transform(
        "segments",
        lambda s, k: F.struct(
            F.aggregate(F.slice("segments", 1, k), F.lit(0), lambda n, x: n + F.length(x["text"])).alias("start"),
            F.length(s["text"]).alias("size"), s["loss"].alias("loss"),
        ),
    )
    spans = F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size")))
    return chats.select("conv", "nth", text.alias("formatted"), spans.alias("spans"), "in_order", "complete")


def read_chats(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of conversations, read back from ``format_chats``' segments.

    Returns a row per conversation: ``conv``, ``n_turns``, ``turns_sha256`` (role, line feed, text,
    line feed of each turn), ``loss_chars`` and ``loss_sha256`` (of the unescaped text under the
    loss mask), ``formatted_chars``, ``first_bad_turn`` (null where all are in order) and
    ``complete``.  A digest takes its turns one after another, so a conversation is one
    task's stream here; no more than a batch of it is held.
    """
    rows = joined(chats).repartition("conv").sortWithinPartitions("conv", "nth")
    return rows.select("conv", "formatted", "spans", "in_order", "complete").mapInArrow(
        _read(template),
        "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, first_bad_turn bigint, complete boolean",
    )
