import functools
import hashlib
import random

import pytest

from larkspool.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        seen_text = text.rstrip(WHITE)
        out.append("blank" if not seen_text else "duplicate" if (role, text) in seen else "" if seen_text[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) by trying, from the last row back, every edit in every state."""

    @functools.cache
    def whole(i, state, inserts):
        """With up to two inserts in front of each row."""
        return min(
            [with_edit(i, state)] + ([insert(i, state, inserts)] if inserts < 2 else []), key=lambda o: o[:2]
        )

    def insert(i, state, inserts):
        to, line = {0: (2, "user:"), 1: (2, "user:"), 2: (3, "assistant:"), 3: (2, "user:")}[state]
        cost, audit, lines = whole(i, to, inserts + 1)
        return cost + 3, "I" + audit, (line, *lines)

    def with_edit(i, state):
        options = [(10**9, "", ())]
        follow, to = {0: "u", 1: "u", 2: "a", 3: "u"}[state], {"u": 2, "a": 3}
        if i == len(rows):
            return (0, "", ()) if state in (0, 3) else options[0]
        (role, text), mark = rows[i], marks[i]
        extra = 3 if mark == "truncated" else 0
        cost, audit, lines = whole(i + 1, state, 0)
        options.append((cost + 4, "D" + audit, lines))
        if mark not in ("blank", "duplicate"):
            cost, audit, lines = whole(i + 1, to[follow], 0)
            options.append((cost + 3 + extra, "R" + audit, ({"u": "user", "a": "assistant"}[follow] + ":" + text, *lines)))
            if role[:1] == follow or state == 0 and role[:1] == "s":
                cost, audit, lines = whole(i + 1, 1 if role[:1] == "s" else to[follow], 0)
                options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
        return min(options, key=lambda o: o[:2])

    return whole(0, 0, 0)


def random_rows(dice, n):
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "one", "two. \n"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", ""]
    rows = []
    for k in range(n):
        role = ["user", "assistant"][k % 2] if dice.random() < 0.6 else dice.choice(roles)
        rows.append((role, f"{dice.choice(texts)}" if dice.random() < 0.5 else f"Text {k}{dice.choice(['.', '', '!'])}"))
    return rows


def solved(rows, marks):
    """Cost and audit by survivors."""
    survivors, out = C.Survivors(), []
    for k, ((role, _), mark) in enumerate(zip(rows, marks)):
        survivors.add(C.moves_of(role, mark), k)
        out += [letters for letters, _ in survivors.decided()]
    cost = min(c + 3 * len(C._END[s]) for s, (c, _, _) in survivors.best.items())
    last = survivors.close()
    out += [letters for letters, _ in survivors.decided()]
    return cost, "".join(out) + last


def test_survivors_find_the_cheapest_and_least():
    dice = random.Random(3)
    for _ in range(1500):
        rows = random_rows(dice, dice.randrange(0, 9))
        marks = faults(rows)
        cost, audit, _ = cheapest(rows, marks)
        assert solved(rows, marks) == (cost, audit), rows


def test_undecided_rows_stay_few():
    rows = [(("user", "assistant")[k % 2], f"Turn {k}.") for k in range(5000)]
    survivors, waiting, most = C.Survivors(), 0, 0
    for role, _ in rows:
        survivors.add(C.moves_of(role, ""), None)
        waiting += 1 - sum(1 for _ in survivors.decided())
        most = max(most, waiting)
    assert most <= 4


def test_branches_without_survivors_are_freed():
    import gc

    survivors = C.Survivors()
    for k in range(3000):
        survivors.add(C.moves_of(["user", "tool", "assistant"][k % 3], ["", "blank", "truncated"][k % 3]), None)
        for _ in survivors.decided():
            pass
    gc.collect()
    assert sum(isinstance(x, C._Node) for x in gc.get_objects()) < 3 * 4 * 3000


def expected(rows):
    """Summary per conversation of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).hexdigest()))
        pairs = [(r, x) for _, r, x in mine]
        marks = faults(pairs)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, audit, lines = cheapest(pairs, marks)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, block int")
    return {r["conv_id"]: tuple(r)[1:] for r in C.summary(C.repair(df.repartition(3))).collect()}


ROWS = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate(random_rows(random.Random(c), c % 11 + 1))]
ROWS += [(None, 1, "user", "Hi."), (None, None, None, None), (50, None, "user", "a."), (50, None, "user", "a."), (50, 3, "assistant", "é" * 100_000)]


@pytest.mark.parametrize("block", [1 << 16, 4])
def test_repair(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    assert found(spark, ROWS) == expected(ROWS)


def test_a_cut_conversation_is_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rows = [(7, t, r, x) for t, (r, x) in enumerate(random_rows(random.Random(2), 150))]
    rows += [(8, t, "tool", f"Same {t}.") for t in range(60)] + [(9, t, "user", " ") for t in range(60)]
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = C.repair(df)
    assert made.edits.count() == 0 and C.summary(made).collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "user", "Ho.")], "conv_id string, turn long, role string, text string")
    assert [(r["conv_id"], r["audit"], r["cost"]) for r in C.summary(C.repair(df)).collect()] == [("a", "KR", 3)]
