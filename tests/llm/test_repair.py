"""Conversation repair against a plain walk over the rows, and its matrices against all edits there are."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import repair

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def conversations():
    rng = random.Random(3)
    texts = ["Hello.", "Well, yes", "What now?", "", " \t", "No!", "No!", "Ünder", "ok. \n", "a. ", "x" * 3000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"]), rng.choice([*texts, None])))
    rows += [(100, t, ["user", "assistant"][t % 2], f"Turn {t % 50}{'.' * (t % 3)}") for t in range(400)]
    rows += [(101, None, "user", "same")] * 30 + [(102, 5, "system", "Only.")]
    rows += [(c, 0, "user", "gone.") for c in range(200, 240)]
    return rows


def moved(state, role):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if how:
                text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
                kept += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            rest = text.strip(BLANK)
            faults.append("b" if not rest else "d" if (role, text) in seen else "t" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        ways = {0: (0, "", ())}

        def put_in(ways):
            for _ in range(2):
                for s, (c, e, lines) in list(ways.items()):
                    for name in ("user", "assistant"):
                        n = moved(s, name[0])
                        if n is not None:
                            new = (c + 5, e + "I", (*lines, f"{name}:"))
                            ways[n] = min(ways.get(n, new), new)
            return ways

        for (_, role, text), fault in zip(kept, faults):
            ways, new = put_in(ways), {}
            for s, (c, e, lines) in ways.items():
                options = [(s, (c + 2, e + "D", lines))]
                if fault not in ("b", "d"):
                    late = 5 if fault == "t" else 0
                    options.append((moved(s, role[:1]), (c + late, e + "K", (*lines, f"{role}:{text}"))))
                    options += [(moved(s, name[0]), (c + late + 1, e + "R", (*lines, f"{name}:{text}"))) for name in ("user", "assistant")]
                for n, x in options:
                    if n is not None:
                        new[n] = min(new.get(n, x), x)
            ways = new
        ways = put_in(ways)
        cost, audit, lines = min(ways[s] for s in (0, 3) if s in ways)
        turns = [r[0] for r in kept if r[0] is not None]
        own = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn int, role string, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in ("conv", "task", "chunk", "part", "symbols", "digest", "audit", "cost", "_c", "how", "copy"))).repartition(5)


@pytest.mark.parametrize("chunk,rules,rows", [(4096, 256, 50_000), (3, 5, 0), (1, 0, 50_000)])
def test_is_brute_force(table, monkeypatch, chunk, rules, rows):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "RULES", rules)
    monkeypatch.setattr(repair, "BROADCAST_ROWS", rows)
    found = repair.repaired(repair.damaged(table), rules)
    got = {r.conv: tuple(r)[1:] for r in found.collect()}
    want = brute(conversations())
    assert got == {k: v for k, v in want.items() if k in got} and all(v[5:7] == (0, "") for k, v in want.items() if k not in got)


def test_every_conversation(table):
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(table).collect()}
    assert got == brute(conversations())


def test_empty(table):
    assert repair.report(table.limit(0)).count() == 0


def test_text_keys(spark):
    """Conversations named by strings."""
    rows = [(f"c{r[0]}", *r[1:]) for r in conversations() if r[0] is not None and r[0] < 15]
    got = repair.report(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == brute(rows)


def every_repair(symbols):
    """All edits with up to two rows put in at each place."""
    best = None
    gaps = itertools.product(range(3), repeat=len(symbols) + 1)
    for puts in gaps:
        for edits in itertools.product("DKR", repeat=len(symbols)):
            audit = "".join("I" * n + e for n, e in zip(puts, edits)) + "I" * puts[-1]
            cost, options = 5 * sum(puts), [""]
            for k, e in enumerate(edits):
                cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if symbols[k].isupper() and e != "D" else 0)
            if any(s == "-" and e != "D" for s, e in zip(symbols, edits)):
                continue
            at = iter(symbols)
            for e in audit:
                s = None if e == "I" else next(at)
                add = {"I": "ua", "R": "ua", "D": [""], "K": [s.lower() if s else ""]}[e]
                options = [o + a for o in options for a in add]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_matrices_are_all_edits():
    rng = random.Random(11)
    for symbols in ["", "s", "a", "-", *("".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randint(1, 3))) for _ in range(25))]:
        rows = [[(0, ""), None, None, None]]
        for s in symbols:
            rows = repair.product(rows, repair.terminal(s))
        last = repair.product(rows, repair.inserts())[0]
        cost, rope = functools.reduce(repair.better, (last[e] for e in repair.ENDS))
        assert (cost, repair.spelled(rope)) == every_repair(symbols), symbols


def test_rules_and_ropes():
    rules, rng = ((1, 2), (9, 9), (10, 1), (8, 8), (12, 12)), random.Random(2)
    for _ in range(50):
        flat = np.array([rng.choice([1, 2, 8, 8, 0]) for _ in range(40)], np.int32)
        short = repair.replaced(flat, rules, len(repair.SYMBOLS))

        def spread(x):
            return [x] if x < 9 else [y for z in rules[x - 9] for y in spread(z)]

        assert [y for x in short for y in spread(x)] == flat.tolist() and (10 not in short or len(short) < len(flat))
    whole, other = "", ""
    for _ in range(400):
        piece = rng.choice(["K", "KR", "DII", "K" * 30])
        whole, other = repair.joined(whole, piece), repair.joined(other, piece if rng.random() > 0.01 else "Z")
        a, b = repair.spelled(whole), repair.spelled(other)
        assert repair.before(whole, other) == (a < b) and repair.before(other, whole) == (b < a)
