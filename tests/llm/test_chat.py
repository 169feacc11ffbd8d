"""Templates by round trips, and conversations against a plain walk of the machine."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import chat
from locusframe.llm.chat import HEADERS, INSTRUCT, Template, Turn, carried, format_chats, joined, read_chats

LOW = -(1 << 63)
NAMES = "conv_id bigint, turn bigint, role string, text string, conv string, nth int, part int, segments int, spans int, formatted int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], NAMES)


@pytest.mark.parametrize("template", [INSTRUCT, HEADERS])
def test_round_trip(template):
    parts = [*template.controls, "\\", "<", "[", "/", "s>", "a", "\n", "é🙂", ">", "|", *[m[1:] for m in template.controls], *[m[:-1] for m in template.controls]]
    word = st.lists(st.sampled_from(parts), max_size=8).map("".join)
    role = st.one_of(st.sampled_from(["system", "user", "assistant", ""]), word)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.tuples(role, word), max_size=5))
    def run(turns):
        assert all(template.unescape(template.escape(t)) == t for _, t in turns)
        text = "".join(s for r, t in turns for s, _ in template.segments(r, t))
        assert [x[:2] for x in template.parse(text)] == turns
        assert not any(m in template.escape(t) for _, t in turns for m in template.controls)

    run()


def test_templates_that_cannot_be_read():
    rest = (INSTRUCT.moves, INSTRUCT.resume, INSTRUCT.ends)
    for turns in ({"a": Turn("<a>", "xyx")}, {"a": Turn("<a>", "b\\c")}, {"a": Turn("<a>", "<e>"), "b": Turn("<a>b", "<e>")}, {"a": Turn("", "<e>")}):
        with pytest.raises(ValueError):
            Template(turns, Turn("<o>", "<e>"), "<m>", *rest)
    with pytest.raises(ValueError):
        INSTRUCT.parse("[INST]a[/INST]tail")
    with pytest.raises(ValueError):
        INSTRUCT.parse("[INST]a")


def brute(rows, template):
    convs = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        convs.setdefault(LOW if c is None else c, []).append((role or "", text or ""))
    out = []
    for c, turns in convs.items():
        state, bad = "start", None
        for k, (role, _) in enumerate(turns):
            after = template.moves.get((state, role))
            if after is None and bad is None:
                bad = k
            state = after or template.resume.get(role, state)
        learned = "".join(t for r, t in turns if r in template.turns and template.turns[r].loss)
        chars = sum(len(s) for r, t in turns for s, _ in template.segments(r, t))
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(turns), sha(said), len(learned), sha(learned), chars, bad, state in template.ends))
    return sorted(out)


def cases():
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "[/ROLE]"]
    rows = [(c, n, rng.choice(roles), rng.choice(["a</s>", "[INST] x", None, "", "word " * 5000, "é🙂"])) for c in range(40) for n in range(rng.randrange(1, 6))]
    rows += [(100, n, ("user", "assistant")[n % 2], f"turn {n}") for n in range(900)]
    rows += [(None, None, "user", "x"), (None, 3, "assistant", "y"), (101, 1, "user", "b"), (101, 1, "user", "a"), (101, 1, "user", "a"), (102, None, None, None)]
    return rows


@pytest.mark.parametrize("template", [INSTRUCT, HEADERS])
def test_conversations(spark, template):
    rows = cases()
    chats = format_chats(table(spark, rows).repartition(6), template)
    got = [tuple(r) for r in read_chats(chats, template).collect()]
    assert sorted(got) == brute(rows, template)
    # one row per turn, numbered without gaps, though the long conversation lies in several ranges
    nths = sorted(r["nth"] for r in chats.filter("conv = 100").collect())
    assert nths == list(range(900))
    one = joined(chats).filter("conv = 100 and nth = 1").first()
    assert one["formatted"][one["spans"][0]["start"] :][: one["spans"][0]["size"]] == "turn 1"


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    """Ranges that hold parts of one conversation hand numbers and states on."""
    told = []
    monkeypatch.setattr(chat, "carried", lambda *a: told.extend(out := carried(*a)) or out)
    rows = [r for r in cases() if r[0] in (100, 101, 102)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = [tuple(r) for r in read_chats(format_chats(table(spark, rows))).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got) == brute(rows, INSTRUCT)
    assert sum(conv == 100 and before > 0 for _, conv, before, _ in told) > 5


def test_carried_states():
    after = lambda *s: list(s)
    ends = [
        {"part": 0, "conv": 5, "nth": 2, "edge": False, "after": after(3)}, {"part": 1, "conv": 5, "nth": 9, "edge": True, "after": after(0, 1, 2, 1)},
        {"part": 4, "conv": 5, "nth": 0, "edge": True, "after": after(2, 2, 2, 2)}, {"part": 6, "conv": 7, "nth": 1, "edge": True, "after": after(3, 0, 0, 0)},
        {"part": 7, "conv": 8, "nth": 0, "edge": False, "after": after(1)},
    ]
    assert carried(ends, 4) == [(1, 5, 3, 3), (4, 5, 13, 1), (6, 5, 14, 2), (7, 7, 2, 3)]


def test_empty(spark):
    assert read_chats(format_chats(table(spark, cases()).limit(0))).count() == 0
