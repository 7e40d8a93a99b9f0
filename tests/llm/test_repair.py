"""Conversation repair against plain programs: every sequence of edits of short conversations, a plain table of states for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerline.llm import repair

CLASHES = "piece signature rids copies first last illegal way tail cost audit rid same kind at is_blank is_again place sub token n t".split()
SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} int" for c in CLASHES)
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for c, n, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, n, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = VISIBLE.findall(text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_edit(rows, found):
    """(cost, audit, messages) of the best of all sequences of edits, with up to two inserted rows in a gap."""
    best = None
    gaps = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    per_row = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in found]
    for edits in itertools.product(*per_row):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            roles, said, audit, cost = "", [], "", 0
            for k in range(len(rows) + 1):
                audit, cost, roles = audit + "I" * len(inserted[k]), cost + 5 * len(inserted[k]), roles + inserted[k]
                said += [("user" if x == "u" else "assistant", "") for x in inserted[k]]
                if k < len(rows):
                    e = edits[k]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and found[k] == "truncated" else 0)
                    if e != "D":
                        role = rows[k][2] if e == "K" else "user" if e == "u" else "assistant"
                        roles += (role[:1] or "-")
                        said.append((role, rows[k][3]))
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def by_states(rows, found):
    """The same by a table of states, kept whole; one character a token, so that any order of edits competes."""
    lead = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def insertions(table):
        for _ in range(3):
            for state, (cost, audit, said) in list(table.items()):
                for r, after in lead[state].items():
                    if r != "s":
                        better(table, after, (cost + 5, audit + "I", (said, (("user" if r == "u" else "assistant"), ""))))
        return table

    table = insertions({"": (0, "", None)})
    for row, f in zip(rows, found):
        after_row: dict = {}
        for state, (cost, audit, said) in table.items():
            better(after_row, state, (cost + 2, audit + "D", said))
            if f not in ("blank", "duplicate"):
                late = 5 * (f == "truncated")
                if row[2][:1] in lead[state]:
                    better(after_row, lead[state][row[2][:1]], (cost + late, audit + "K", (said, (row[2], row[3]))))
                for r, then in lead[state].items():
                    if r != "s":
                        better(after_row, then, (cost + 1 + late, audit + "R", (said, ("user" if r == "u" else "assistant", row[3]))))
        table = insertions(after_row)
    cost, audit, said = min((table[s] for s in ("", "a") if s in table), key=lambda v: v[:2])
    out = []
    while said is not None:
        said, m = said
        out.append(m)
    return cost, audit, out[::-1]


def brute(rows, best):
    """The contract's rows for conversations whose rows differ in turn (or are alike in all)."""
    out = []
    after = damaged(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        found = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, said = best(mine, found)
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], SCHEMA)
    got = repair.repair_damaged(df)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted(map(tuple, got.collect()), key=repr)


ROLES = ["user", "assistant", "system", "tool", "user", "assistant", None, ""]
TEXTS = ["Yes.", "No!", "Why?  \n", "cut off", "cut. off ", "", " \t\n", None, "é.", "Yes.", "…", "a" * 30_000 + "."]


def test_equals_all_edits_of_short_conversations(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(ROLES), rnd.choice(TEXTS)) for c in range(150) for t in sorted(rnd.sample(range(9), rnd.randrange(1, 4)))]
    assert found(spark, rows) == brute(rows, every_edit)


def test_state_table_equals_all_edits():
    rnd = random.Random(8)
    for _ in range(150):
        rows = [(0, t, rnd.choice(ROLES) or " ", rnd.choice(TEXTS) or " ") for t in range(rnd.randrange(4))]
        assert by_states(rows, faults(rows)) == every_edit(rows, faults(rows))


def test_long_conversations_in_pieces_nulls_and_repeats(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(ROLES), rnd.choice([*TEXTS[:-1], *[f"number {k}." for k in range(40)], *[f"open {k}" for k in range(9)]])) for c in (5, None) for t in range(900)]
    rows += [(c, t, rnd.choice(ROLES[:3]), f"{t}.") for c in range(100, 160) for t in range(rnd.randrange(1, 12))]
    rows += [(7, None, "user", "Hello."), (7, 3, "assistant", "Hi."), (8, None, "tool", "x"), (9, 4, "user", "Same."), *[(9, 5, "assistant", "Copies.")] * 40]
    want = brute(rows, by_states)
    assert found(spark, rows) == want
    monkeypatch.setattr(repair, "PIECE_BITS", 2)  # most conversations in several pieces
    monkeypatch.setattr(repair, "PIECE_ROWS", 4)
    assert found(spark, rows) == want


@pytest.mark.parametrize("signatures", [["su", "ua", "SuaX"], ["x", "xx", "xuxax", "oOo", "uuuaaa", "sss", "UaUaA"]])
def test_pieces_chain_to_the_whole(signatures):
    """Cut anywhere, the chained pieces cost what the whole does and have the same audit."""

    def piece(s):
        costs, ranks, scripts = [-1] * 16, [0] * 16, [None] * 16
        for a in range(4):
            for rank, (b, cost, script) in enumerate(sorted(repair.solve(s, a), key=lambda w: repair.audit_of(w[2]))):
                costs[4 * a + b], ranks[4 * a + b], scripts[4 * a + b] = cost, rank, script
        return costs, ranks, scripts

    for s in signatures:
        s = s.replace("X", "x")
        results = set()
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(s)]
            parts = [piece(s[a:b]) for a, b in itertools.pairwise(at)]
            cost, ways, tail = repair.chain([p[:2] for p in parts])
            results.add((cost, "".join(repair.audit_of(p[2][w]) for p, w in zip(parts, ways)) + "I" * len(tail)))
        assert len(results) == 1


def test_empty_table_ties_and_no_rows_left(spark):
    assert found(spark, []) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert found(spark, [(1, gone, "user", "Hi.")]) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = [(2, 1, "user", "One."), (2, 1, "assistant", "Two."), (2, 1, "user", "Three."), (2, 1, "assistant", "Four.")]
    assert found(spark, rows) == found(spark, rows[::-1])  # rows of one turn have one order
