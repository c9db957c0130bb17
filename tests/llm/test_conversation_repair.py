import hashlib
import random
import re
import zlib

import pytest

from revlens.llm import conversation_repair as CR

SOUND = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"
SF001 = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ an independent statement of the contract

def damaged(rows):
    """(conv, turn, role, text) -> conversations as sorted (turn, role, text) lists; all original ids are keys."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        code = zlib.crc32(":".join(shown).encode()) % 20
        own = out.setdefault(conv, [])
        if code == 0:
            continue
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if code == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(BLANK)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen
                   else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults_):
    """Least (cost, audit, repaired rows) by dynamic programming from the end over the automaton's states."""
    def after(q, initial):                        # 0 nothing, 1 behind s, 2 behind u, 3 behind a
        if initial == "":
            return q
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))

    def settle(best):                             # insertions before the next row
        for _ in range(6):
            for q in range(4):
                for role in ("user", "assistant"):
                    q2 = after(q, role[0])
                    if q2 is not None and best[q2]:
                        c, a, out = best[q2]
                        way = c + 5, "I" + a, [(role, "")] + out
                        if best[q] is None or way[:2] < best[q][:2]:
                            best[q] = way
        return best

    best = settle([(0, "", []), None, None, (0, "", [])])
    for (_, role, text), fault in zip(reversed(rows), reversed(faults_)):
        now = []
        for q in range(4):
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])] if best[q] else []
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for letter, cost, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    q2 = after(q, new[:1])
                    if q2 is not None and best[q2]:
                        c, a, out = best[q2]
                        ways.append((c + cost + more, letter + a, [(new, text)] + out))
            now.append(min(ways, key=lambda w: w[:2]) if ways else None)
        best = settle(now)
    return best[0]


def brute(rows):
    out = []
    for conv, own in damaged(rows).items():
        f = faults(own)
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = cheapest(own, f)
        assert SOUND.fullmatch("".join(r[:1] for r, _ in repaired))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = CR.summaries(CR.stored(spark, CR.repair_conversations(CR.damage(df), copies_col="copies"), "test"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def wild_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        n = rng.randint(0, longest)
        for t in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "sys", "u"])
            if rng.random() < 0.7:
                role = ["user", "assistant"][t % 2]
            text = rng.choice([f"What is {t}?", f"It is {t}.", "Yes.", "so far", " ", "", None, f"no end {t}", "Wait!\n"])
            rows.append((c, rng.choice([t, t, t, t + 1, 0, None, t * 3]), role, text))
    return rows


# ------------------------------------------------------------------ the search

@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_first_of_the_cheapest(seed):
    rng = random.Random(seed)
    for _ in range(300):
        marks = "".join(rng.choice("uuaauasdxeUAS") for _ in range(rng.randint(0, 9)))
        rows, f = [], []
        for m in marks:
            role = {"u": "user", "a": "assistant", "s": "system", "x": "tool", "e": "", "d": "user"}[m.lower()]
            rows.append((0, role, ""))
            f.append("blank" if m == "d" else "truncated" if m.isupper() else "")
        assert CR.search(marks) == cheapest(rows, f)[:2], marks


@pytest.mark.parametrize("seed", range(4))
def test_segments_give_what_the_whole_gives(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(60):
        marks = "".join(rng.choice("uauauauauadxsUAe") for _ in range(rng.randint(0, 40)))
        whole = CR.search(marks)
        monkeypatch.setattr(CR, "SEGMENT", rng.randint(1, 7))
        assert CR.repair(marks) == whole, marks
        monkeypatch.undo()


def test_lower_bound_is_one():
    rng = random.Random(9)
    for _ in range(400):
        marks = "".join(rng.choice("uuaasdxeU") for _ in range(rng.randint(0, 8)))
        cost, leads = CR._bounds(marks)[0]
        assert cost + max(leads - 1, 0) <= CR.search(marks)[0]
        for q in range(1, 4):
            assert cost + leads <= CR.search(marks, q)[0]


def test_long_conversation_in_one_go():
    marks = "".join(random.Random(1).choice("uauauauaud") for _ in range(20_000))
    cost, edits = CR.repair(marks)
    assert len(edits) - edits.count("I") == 20_000 and cost > 0


# ------------------------------------------------------------------ on tables

def test_equals_brute_force(spark):
    rows = wild_rows(1, 150, 12)
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_and_lost_conversations(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Who?"), (None, 3, "user", "Who?"), (7, None, "user", "A?"),
            (7, None, "assistant", "B."), (8, 1, "system", "S."), (8, 5, "user", "Q?"), (8, 9, "assistant", "A!")]
    rows += [(c, 0, "user", "only one row.") for c in range(100, 160)]       # some lose it
    got = run(spark, rows)
    assert got == brute(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", empty) for r in got)
    assert run(spark, rows[:0]) == []


@pytest.mark.parametrize("segment, long, ranges", [(5, 8, 40), (3, 0, 11)])
def test_long_conversations_over_many_tasks(spark, monkeypatch, segment, long, ranges):
    rows = wild_rows(2, 12, 60)
    rows += [(500, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(400)]
    rows += [(500, 17, "user", "the same row many times.")] * 150            # equal rows meet in one place
    rows += [(501, t, "user", "one text in a third of the rows?") for t in range(300)]
    want = brute(rows)
    for name, value in (("SEGMENT", segment), ("LONG", long), ("RANGE_ROWS", ranges)):
        monkeypatch.setattr(CR, name, value)
    assert run(spark, rows) == want


def test_real_output_is_the_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi?", "x"), (1, 1, "user", "Again?", "x"), (1, 2, "assistant", "Yes.", "x"),
                                (1, 3, "assistant", "cut off", "x"), (2, 0, "system", "Be kind.", "x")],
                               "conv_id int, turn int, role string, text string, audit string")
    got = {r.conv_id: r for r in CR.repair_conversations(df).collect()}
    assert got[1].audit == "DKKD" and got[1].cost == 4
    assert [(t.role, t.text) for t in got[1].repaired] == [("user", "Again?"), ("assistant", "Yes.")]
    assert got[2].audit == "D" and got[2].repaired == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in CR.op13_conversation_repair(spark, SF001).collect())
    assert got == brute(rows)
