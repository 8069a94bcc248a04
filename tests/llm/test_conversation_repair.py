"""Conversation repair: the parser against an exhaustive search, blocks against whole parses, odd rows."""

import functools
import hashlib
import random
import re
import zlib

from rosterkit.llm import conversation_repair as cr

NEXT = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def brute(turns):
    """Least (cost, audit) of (initial, gone, cut) turns, from the end, trying every edit."""
    @functools.lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(turns) and state in "03" else []

        def add(cost, edit, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1]))

        if inserts < 2:
            for symbol in "ua":
                if (state, symbol) in NEXT:
                    add(2, "I", best(i, NEXT[state, symbol], inserts + 1))
        if i < len(turns):
            initial, gone, cut = turns[i]
            add(3, "D", best(i + 1, state, 0))
            for symbol in "" if gone else "sua":
                if (state, symbol) in NEXT:
                    if symbol == initial:
                        add(int(cut), "K", best(i + 1, NEXT[state, symbol], 0))
                    elif symbol != "s":
                        add(2 + int(cut), "R", best(i + 1, NEXT[state, symbol], 0))
        return min(found) if found else None

    for i in range(len(turns), -1, -1):  # from the end, so that no call is deep
        for state in "0123":
            for inserts in (2, 1, 0):
                best(i, state, inserts)
    return best(0, "0", 0)


def some_turns(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def whole(turns):
    ends = cr.parse(turns)
    return min((cost + cr.INSERT * cr.TAIL[top], audit + "I" * cr.TAIL[top]) for top, (cost, audit) in ends.items())


def test_parser_equals_every_edit():
    rng = random.Random(3)
    for _ in range(3000):
        turns = some_turns(rng, rng.randint(0, 9))
        assert whole(turns) == brute(tuple(turns)), turns


def test_blocks_fold_to_the_whole_parse():
    rng = random.Random(4)
    for _ in range(600):
        turns = some_turns(rng, rng.randint(1, 14))
        cuts = sorted(rng.sample(range(1, len(turns)), rng.randint(0, min(4, len(turns) - 1)))) if len(turns) > 1 else []
        rows = []
        for no, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(turns)])):
            block = cr._Block("=1", 0, no, tuple(cr.STACKS))
            for k in range(a, b):
                initial, gone, cut = turns[k]
                block.add(k, initial, "x", "blank" if gone else "truncated" if cut else "")
            rows.append(block.row())
        chosen = {c["_no"]: c for c in cr.fold(rows)}
        audit = ""
        for r in rows:
            c = chosen[r["_no"]]
            audit += next(o["audit"] for o in r["options"] if (o["entry"], o["exit"]) == (c["entry"], c["exit"]))
            audit += "I" * c["tail"]
        assert (chosen[len(rows) - 1]["cost"], audit) == whole(turns)
        pairs = [x[0] + y[0] for x, y in zip(turns, turns[1:])]
        assert chosen[len(rows) - 1]["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def expected(rows):
    """The contract over (turn, role, text) rows of one conversation, after the damage."""
    rows = sorted(((r[0], " " if r[1] is None else r[1], " " if r[2] is None else r[2]) for r in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, turns, faults = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = brute(tuple(turns))
    known = [r[0] for r in rows if r[0] is not None]
    lines, at, state = [], 0, "0"
    for edit in audit:
        if edit != "D":
            symbol = rows[at][1][:1] if edit == "K" else "a" if state == "2" else "u"
            role = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[symbol]
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
            state = NEXT[state, symbol]
        at += edit != "I"
    return dict(gaps=max(known) - min(known) + 1 - len(set(known)) if known else 0, **faults,
                illegal=sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost=cost, audit=audit,
                repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn int, role string, text string, _key string, cost string"


def test_random_and_odd_conversations(spark):
    rng = random.Random(9)
    texts = ["Yes.", "no", "  ", "", None, "What? ", "é\n", "a:b!", "Done.\t"]
    data = {c: [(rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", None, "", "u"]),
                 rng.choice(texts)) for _ in range(rng.randint(1, 9))] for c in [None, *range(60)]}
    data[61] = [(0, "user", "Same."), *[(1, "assistant", "x" * 50000 + ".")] * 5]
    df = spark.createDataFrame([(c, *r, "k", "c") for c, rows in data.items() for r in rows], SCHEMA).repartition(4)
    got = {r["_key"]: r.asDict() for r in cr.report(df).collect()}
    assert len(got) == len(data)
    for c, rows in data.items():
        row = got["" if c is None else f"={c}"]
        row.pop("_key")
        assert row == expected(rows), (c, rows)
    kept = [r for r in cr.repaired(df).where("conv_id = '61'").orderBy("position").collect()]
    assert [(r.edit, r.role) for r in kept] == [("K", "user"), ("K", "assistant")]


def test_one_conversation_over_many_blocks(spark):
    rng = random.Random(11)
    rows = [(t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"n{t}.", f"m{t}"])) for t in range(5000)]
    df = spark.createDataFrame([(1, *r, "", "") for r in rows] + [(2, 0, "user", "a.", "", "")], SCHEMA).repartition(5)
    found = cr.pieces(df).collect()
    assert sum(r["_key"] == "=1" for r in found) >= 5000 // cr.BLOCK_ROWS + 1
    row = next(r.asDict() for r in cr.report(df).collect() if r["_key"] == "=1")
    row.pop("_key")
    assert row == expected(rows)


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, r, x) for c in range(80) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Yo!")])]
    rows += [(7, None, None, None), (None, 3, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    want = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        into = want.setdefault(c, [])
        if code:
            x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
            into += [(t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in cr.damaged_and_repaired(df).collect()}
    assert set(got) == set(want)
    for c, kept in want.items():
        got[c].pop("conv_id")
        assert got[c] == expected(kept), c
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert cr.damaged_and_repaired(empty).collect() == [] and cr.repaired(empty).collect() == []
