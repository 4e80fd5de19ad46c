"""Repair of conversations against a dynamic program over whole audits and against every edit sequence."""

import hashlib
import itertools
import random
import zlib

import pytest
import xxhash

from loomgraph.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, pos string, name string, gone int, part string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"", *("ua" * k for k in range(1, 9)), *("s" + "ua" * k for k in range(1, 9))}


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        a, b = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{a}:{b}".encode()) % 20
        held = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), signed(xxhash.xxh64_intdigest(r[2].encode(), 42)), r[2].encode()))
    return out


def plain_faults(held):
    seen, out = set(), []
    for _, role, text in held:
        f = 1 if not text.strip(WHITE) else 2 if (role, text) in seen else 3 if text.rstrip(WHITE)[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(f)
    return out


def plain_best(rows):
    """Forward over rows with every state's least (cost, audit); inserts are followed to their end."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    want = "uuau"

    def inserts(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                to = step[q, want[q]]
                best[to] = min(best.get(to, (c + 3, "")) if to in best else (c + 2, a + "I"), (c + 2, a + "I"))
        return best

    best = inserts({0: (0, "")})
    for initial, f in rows:
        now = {}

        def put(q, c, a):
            now[q] = min(now.get(q, (c, a)), (c, a))

        for q, (c, a) in best.items():
            put(q, c + 3, a + "D")
            if f not in (1, 2):
                charge = f == 3
                put(step[q, want[q]], c + 2 + charge, a + "R")
                if (q, initial) in step:
                    put(step[q, initial], c + charge, a + "K")
        best = inserts(now)
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(rows):
    out = []
    for conv, held in plain_damage(rows).items():
        faults = plain_faults(held)
        cost, audit = plain_best([(r[1][:1], f) for r, f in zip(held, faults)])
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        left, said, k = [], "", 0
        for letter in audit:
            if letter == "D":
                k += 1
                continue
            due = "assistant" if said[-1:] == "u" else "user"
            role, text = (held[k][1] if letter == "K" else due), ("" if letter == "I" else held[k][2])
            k += letter != "I"
            said += role[0]
            left.append(f"{role}:{text}")
        out.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def made(seed, convs, length):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "open end", "So. ", "tail\n", "", " \t", None, "é ok.", "Same.", "🙂."]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, length)):
            if rng.random() < 0.9:
                fair = rng.random() < 0.6
                rows.append((c if c != 3 else None, t if rng.random() < 0.95 else None, ("user", "assistant")[t % 2] if fair else rng.choice(roles), f"word {rng.randint(0, 99)}." if rng.random() < 0.6 else rng.choice(texts)))
    rows += rng.sample(rows, 5)
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, "clash", "p", "n", 3, None) for r in rows], SCHEMA).repartition(parts)


def test_search_equals_every_edit_sequence():
    """All audits over three letters a row with up to three inserts, checked against the pattern itself."""
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice("uuaast"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
        best = None
        for extra in range(4):
            for audit in set(itertools.permutations("I" * extra + "." * len(rows))):
                for fill in itertools.product("KRD", repeat=len(rows)):
                    letters = iter(fill)
                    word = "".join(next(letters) if x == "." else x for x in audit)
                    said, cost, k, fair = "", 0, 0, True
                    for x in word:
                        if x != "I":
                            initial, f = rows[k]
                            k += 1
                            fair &= x == "D" or f not in (1, 2)
                            cost += {"K": 0, "R": 2, "D": 3}[x] + (x != "D" and f == 3)
                        else:
                            cost += 2
                        if x in "RI":
                            said += "a" if said[-1:] == "u" else "u"
                        elif x == "K":
                            said += initial
                    if fair and said in LEGAL and (best is None or (cost, word) < best):
                        best = (cost, word)
        assert cr.solved(rows) == best == plain_best(rows)


def test_blocks_compose(monkeypatch):
    rng = random.Random(8)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(cr, "BLOCK", size)
        for _ in range(60):
            rows = [(rng.choice("uuaast"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 30))]
            assert cr.solved(rows) == plain_best(rows)


@pytest.mark.parametrize("most,parts", [(50_000, 3), (20, 5)])
def test_equals_a_plain_version(spark, most, parts):
    rows = made(1, 60, 14)
    got = cr.repair(cr.damaged(frame(spark, rows, parts)), most=most)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_repair(rows), key=repr)


def test_a_conversation_over_many_ranges(spark):
    """One conversation holds most rows, one of them very often; texts repeat across ranges."""
    rows = made(5, 12, 6) + [(7, t, ("user", "assistant")[t % 3 % 2], f"turn {t % 900}.") for t in range(3000)] + [(7, None, "user", "Hot.")] * 700
    got = cr.repair(cr.damaged(frame(spark, rows, 4)), most=150)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_repair(rows), key=repr)


def test_nothing_left_and_nothing_at_all(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    rows = [(c, 0, "user", "Hi.") for c in gone]
    got = sorted(map(tuple, cr.repair(cr.damaged(frame(spark, rows, 2))).collect()))
    assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]
    assert cr.repair(cr.damaged(frame(spark, rows, 1).limit(0))).count() == 0
