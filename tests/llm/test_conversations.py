"""Conversation repair against all edit scripts, and the damage and the counts against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tesserae.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, blank string, copy string, nth string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def fault_of(role, text, seen):
    body = re.sub(r"[\x20\x09-\x0D]", "", text)
    if not body:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "truncated" if body[-1] not in ".!?" else ""


def all_scripts(rows):
    """Cheapest (cost, audit, repaired) by trying every edit of every row and every number of insertions."""
    best = None

    def go(k, cost, audit, lines, initials):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows):
            for more in range(3):
                for roles in itertools.product("ua", repeat=more):
                    if re.fullmatch(r"(s?(ua)+)?", initials + "".join(roles)):
                        found = (cost + 2 * more, audit + "I" * more, lines + [f"{C.ROLES[x]}:" for x in roles])
                        best = found if best is None or found[:2] < best[:2] else best
            return
        role, text, fault = rows[k]
        for more in range(3):
            for roles in itertools.product("ua", repeat=more):
                c, a, own, so_far = cost + 2 * more, audit + "I" * more, lines + [f"{C.ROLES[x]}:" for x in roles], initials + "".join(roles)
                if not re.fullmatch(r"(s?(ua)*u?)?", so_far):
                    continue
                go(k + 1, c + 3, a + "D", own, so_far)
                if fault in ("blank", "duplicate"):
                    continue
                late = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    if re.fullmatch(r"(s?(ua)*u?)?", so_far + role[:1]):
                        go(k + 1, c + late, a + "K", [*own, f"{role}:{text}"], so_far + role[:1])
                for x in "ua":
                    if re.fullmatch(r"(s?(ua)*u?)?", so_far + x):
                        go(k + 1, c + 2 + late, a + "R", [*own, f"{C.ROLES[x]}:{text}"], so_far + x)

    go(0, 0, "", [], "")
    return best


def expected(rows):
    """What op13 has to return for plain rows (conv_id, turn, role, text), where no two rows of a conversation differ at one turn."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        by[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        by[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told = set(), []
        for _, role, text in own:
            told.append((role, text, fault_of(role, text, seen)))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        count = lambda kind: sum(f == kind for _, _, f in told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = all_scripts(told)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, *"wxyz") for r in rows], SCHEMA)


def repaired(spark, rows, tmp_path):
    table(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return found(C.op13_conversation_repair(spark, str(tmp_path)))


def some(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]
    texts = ["Yes.", "No!", "cut off", "  ", "", "a? ", "b.\n", None, "long one " * 9 + "."]
    return [(c, t if rng.random() < 0.95 else None, rng.choice(roles), f"{rng.choice(texts) or ''}{c % 3}{rng.choice(['.', '', '?'])}" if rng.random() < 0.7 else rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 5))]


@pytest.mark.parametrize("seed", [1, 2])
def test_small_conversations_against_all_scripts(spark, tmp_path, seed):
    rows = some(seed, 120)
    assert repaired(spark, rows, tmp_path) == expected(rows)


def test_driver_table_against_all_scripts(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(C.op13_conversation_repair(spark, path)) == expected(rows)


def test_nulls_gaps_repeats_and_dropped_conversations(spark, tmp_path):
    dropped = [(k, 0, "user", "x.") for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 9, "assistant", "Hi."), *dropped, (1000, 1, "user", "a."), (1000, 1, "user", "a."), (1000, -4, "assistant", "b."), (1001, None, "user", "q?"), (1001, None, "user", "q?")]
    want = expected(rows)
    assert repaired(spark, rows, tmp_path) == want and len(dropped) > 3
    assert want[dropped[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(spark, [], tmp_path) == {}


def test_one_long_conversation(spark):
    """Longer than any batch: the audit from back pointers, the hash turn by turn."""
    rng, rows = random.Random(4), []
    for t in range(9000):
        rows.append((7, t, rng.choice(["user", "assistant"]), f"turn {t}."))
    df = table(spark, rows)
    got = found(C.repair_conversations(df))[7]
    # an independent recurrence over what may come next
    cost = {"": 0}
    for _, _, role, _ in rows:
        new = {}
        for last, c in cost.items():
            for op, to, add in [("D", last, 3)] + [("K" if x == role[0] else "R", x, 0 if x == role[0] else 2) for x in "ua"]:
                options = [(last, 0)] + ([("u", 2)] if last in ("", "a") else [("a", 2)])
                for base, paid in options:
                    if op == "D" and paid:
                        continue
                    if op != "D" and not ((base in ("", "a")) == (to == "u")):
                        continue
                    new[to] = min(new.get(to, 10**9), c + paid + add)
        cost = new
    assert got[5] == min(cost.get("a", 10**9), cost.get("u", 10**9) + 2)
    assert len(got[6].replace("I", "")) == 9000
    lines, k, want = [], 0, "user"
    for step in got[6]:
        if step == "I":
            lines.append(f"{want}:")
        elif step == "D":
            k += 1
            continue
        else:
            assert step == "R" or rows[k][2] == want
            lines.append(f"{want}:{rows[k][3]}")
            k += 1
        want = "assistant" if want == "user" else "user"
    assert want == "user" and got[7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_chart_has_few_items():
    assert len(C.ITEMS) == 7 and len(C.ITEMS) * len(C.STEPS) < 256
    assert {C.AWAITED[k] for k in C.OPENING} == {"s", "u", None}


@pytest.mark.parametrize("seed", range(3))
def test_chart_against_all_scripts(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{k}", rng.choice(["", "", "", "truncated", "blank"])) for k in range(rng.randint(0, 5))]
        chart = C.Chart()
        for role, text, fault in rows:
            chart.read(role, text, fault == "blank", fault == "truncated")
        cost, audit, lines = all_scripts(rows)
        assert chart.repair() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
