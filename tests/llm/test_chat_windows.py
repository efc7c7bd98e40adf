"""Budgeted chat windows: what is read back against the input, budgets, history and masks by hand."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import chat_windows as C
from tests.llm.test_text_operators import prose

SCHEMA = "conv_id long, turn long, role string, text string, slice string, hash int, conv int"


def table(spark, rows):
    """Three more columns have names that the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def talk(conv, turns, seed, system=True, step=1):
    r = random.Random(seed)
    return [(conv, step * k, "system" if system and k == 0 else ("user", "assistant")[k % 2], prose(seed * 1000 + k, r.randint(0, 40)) if r.random() > 0.1 else r.choice(["", None, "É😀\n漢", "\\", "a <turn>b</turn><say>\\<turn>", "<tu"])) for k in range(turns)]


ROWS = [
    *talk(1, 8, 1), *talk(2, 5, 2, system=False), *talk(3, 700, 3), *talk(4, 90, 4, step=7), (5, 0, "system", "alone"), (6, 3, None, None), (6, 4, "assistant", None),
    (7, 0, "user", "</turn>\\"), (7, 1, "assistant", "\\\\<\\say><say>"), (7, 2, "us<say>er\n", "x"), (8, 0, "assistant", "w " * 9000), (8, 1, "user", "after a long turn"), (8, 2, "assistant", "x" * 200_000),
    (9, None, "user", "no number"), (9, 1, "assistant", "one"), (9, -300, "user", "early"), (10, 0, "system", "s " * 3000), (10, 1, "user", "q"), (10, 2, "assistant", "a"), (11, 0, "user", "u"), (11, 1, "system", "late"), (11, 2, "assistant", "a"),
    (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]
REPEATED = [(None, 0, "user", f"q{k % 7}") for k in range(40)] + [(None, 1, "assistant", f"a{k % 5}") for k in range(40)] + [(None, 0, "system", "s"), (12, 5, "assistant", "same"), (12, 5, "assistant", "same"), (12, 5, "system", "sys")]


def in_order(turns):
    return sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0))


def digests(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for conv, turns in convs.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in in_order(turns))
        lost = "".join(t or "" for _, _, r, t in in_order(turns) if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


def test_read_back_is_the_input(spark):
    got = C.conversations_read_back(C.formatted_windows(table(spark, ROWS))).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == digests(ROWS) and len(got) == len(digests(ROWS))


def windows_by_hand(turns, budget, history, history_turns):
    """(repeated, own) turns of each window of one conversation whose turn numbers are apart."""
    tokens = [max(len((t or "").encode().split()), -(-len((t or "").encode()) // 4)) + 2 for *_, t in turns]
    kept = 0 if turns[0][2] == "system" else None
    stride = max(budget - history - (tokens[0] if kept == 0 else 0), budget // 4)
    start, at = [], 0
    for k, t in enumerate(turns):
        if k and t[1] // C.SLICE_TURNS != turns[k - 1][1] // C.SLICE_TURNS:
            at = 0
        start.append(at)
        at += tokens[k]
    cells = defaultdict(list)
    for k, t in enumerate(turns):
        cells[t[1] // C.SLICE_TURNS, start[k] // stride].append(k)
    spans = []
    for cell in cells.values():
        if len(cell) > 1 and sum(tokens[k] for k in cell) > stride:
            spans += [cell[:-1], cell[-1:]]
        else:
            spans.append(cell)
    out = []
    for own in spans:
        past, room, k = [], history, own[0] - 1
        while k >= 0 and k != kept and tokens[k] <= room and turns[k][1] >= turns[own[0]][1] - history_turns:
            past.insert(0, k)
            room -= tokens[k]
            k -= 1
        context = ([0] if kept == 0 and 0 not in own else []) + past
        out.append((context, own, sum(tokens[k] for k in context + own)))
    return out


@pytest.mark.parametrize("budget, history, history_turns", [(1024, 256, 4), (120, 40, 2), (64, 0, 0)])
def test_windows_by_hand(spark, budget, history, history_turns):
    kept = [c for c in (1, 2, 3, 4, 8, 10, 11)]
    made = C.formatted_windows(table(spark, ROWS), budget=budget, history=history, history_turns=history_turns)
    piece = lambda t: f"<turn>{t[2]}<say>{(t[3] or '').replace(chr(92), chr(92) * 2).replace('<turn>', '<' + chr(92) + 'turn>').replace('<say>', '<' + chr(92) + 'say>').replace('</turn>', '<' + chr(92) + '/turn>')}</turn>"
    want = []
    for conv in kept:
        turns = in_order([r for r in ROWS if r[0] == conv])
        for context, own, tokens in windows_by_hand(turns, budget, history, history_turns):
            want.append((conv, turns[own[0]][1], turns[own[-1]][1], len(context), tokens, tokens > budget, "".join(piece(turns[k]) for k in context + own)))
    got = [(r.conv_id, r.first_turn, r.last_turn, r.repeated, r.tokens, r.over_budget, r.formatted) for r in made.where(F.col("conv_id").isin(kept)).collect()]
    assert sorted(got) == sorted(want)


def test_masks_hold_each_target_once(spark):
    made = C.formatted_windows(table(spark, ROWS), budget=120, history=60).where("conv_id = 3").orderBy("first_turn").collect()
    template = [r[3] or "" for r in ROWS if r[0] == 3 and r[2] == "assistant"]
    texts = [r.formatted[x.start : x.start + x.length] for r in made for x in r.loss]
    assert len(texts) == len(template) and [t for t in texts if "\\" not in t] == [t for t in template if not any(c in t for c in ("\\", "<turn>"))]
    assert sum(r.repeated for r in made) > len(made)  # the system turn, and history


def test_crowded_and_repeated_turns(spark, monkeypatch):
    plain = {r[0]: tuple(r)[1:] for r in C.conversations_read_back(C.formatted_windows(table(spark, REPEATED + ROWS))).collect()}
    monkeypatch.setattr(C, "CROWD", 30)
    crowded = {r[0]: tuple(r)[1:] for r in C.conversations_read_back(C.formatted_windows(table(spark, REPEATED + ROWS))).collect()}
    want = digests(ROWS)
    assert {k: v[:4] for k, v in plain.items() if k in want} == want
    assert {k: (v[0], v[2]) for k, v in crowded.items()} == {k: (v[0], v[2]) for k, v in plain.items()} and crowded[None][0] == 81
    assert crowded[12] == plain[12] and plain[12][0] == 3 and plain[12][1] == hashlib.sha256(b"system\nsys\nassistant\nsame\nassistant\nsame\n").hexdigest()


@pytest.mark.parametrize("budget, history, history_turns", [(1024, 256, 4), (64, 40, 2), (20, 15, 4)])
def test_windows_of_a_crowd_are_those_of_its_slice(spark, monkeypatch, budget, history, history_turns):
    """How many rows make a crowd decides nothing: spans, history and masks are the same."""
    r = random.Random(5)
    many = [(None, r.choice([None, 0, 254, 255, 256, 257, 600]), r.choice(["user", "assistant", "system"]), prose(k % 300, 9)) for k in range(900)]
    rows = ROWS + REPEATED + many + [(30, 253 + k // 60, "assistant" if k % 3 else "user", prose(k, 5)) for k in range(400)]
    names = ["conv_id", "slice", "start", "several", "first_turn", "last_turn", "n_turns", "repeated", "tokens", "over_budget", "formatted", "loss"]

    def made():
        got = C.formatted_windows(table(spark, rows), budget=budget, history=history, history_turns=history_turns)
        assert got.columns == names
        return sorted(map(repr, got.collect()))

    plain = made()
    for crowd in (30, 0):
        monkeypatch.setattr(C, "CROWD", crowd)
        monkeypatch.setattr(C, "CROWD_CELLS", 64 if crowd else 8)
        assert made() == plain


def test_templates(spark):
    other = C.Template("[T]", "|:>", "[/T]", "^")
    got = C.conversations_read_back(C.formatted_windows(table(spark, ROWS + [(20, 0, "[T]", "^|:>^^[/T]")]), template=other), template=other).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == digests(ROWS + [(20, 0, "[T]", "^|:>^^[/T]")])
    with pytest.raises(ValueError):
        C.Template("<a>", "<a>", "</a>")
    with pytest.raises(ValueError):
        C.formatted_windows(table(spark, ROWS), budget=10, history=10)


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.conversations_read_back(C.formatted_windows(none)).collect() == []
    plan = C.op12_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD", "Cartesian"))
