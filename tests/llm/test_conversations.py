"""Repair of conversations against all edit paths of small ones."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest
from llm_samples import CLASHING, SF, needs_data, oracle_rows

from faultline.llm import queries
from faultline.llm.conversations import damage_and_repair, repair, repair_conversations

TURNS = "conv_id long, turn long, role string, text string"
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(faults, roles):
    """Uniform-cost search over the texts of edits themselves; of equal costs the least text comes first."""
    heap, known = [(0, "", "", 0)], set()
    while heap:
        cost, audit, out, at = heapq.heappop(heap)
        if (at, out[-1:], len(out) % 2, out[:1] == "s") in known:
            continue
        if at == len(roles) and LEGAL.fullmatch(out):
            return cost, audit
        options = [(cost + 5, audit + "I", out + r, at) for r in "ua"]
        if at < len(roles):
            options.append((cost + 2, audit + "D", out, at + 1))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 if faults[at] == "truncated" else 0
                options.append((cost + more, audit + "K", out + (roles[at] or "?"), at + 1))
                options += [(cost + 1 + more, audit + "R", out + r, at + 1) for r in "ua"]
        for option in options:
            if option[0] <= 2 * len(roles) and re.fullmatch(r"s?(ua)*u?", option[2]):
                heapq.heappush(heap, option)
    raise AssertionError


FAULTS = ["sound", "blank", "duplicate", "truncated"]


def coded(faults, roles):
    return bytes(FAULTS.index(f) * 4 + " sua".find(r or "?") * (r in ("s", "u", "a")) for f, r in zip(faults, roles, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_the_first_accepting_path_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(0, 8)
        faults = [rng.choice(FAULTS + ["sound"] * 4) for _ in range(n)]
        roles = [rng.choice("uauauasx") for _ in range(n)]
        for stretch in (1, 3, 64):
            assert repair(coded(faults, roles), stretch) == cheapest(faults, roles), (faults, roles)


def test_long_conversations_take_time_in_proportion(spark):
    rng = random.Random(1)
    codes = bytes(rng.choice([0, 0, 0, 0, 1, 3]) * 4 * (rng.random() < 0.3) + rng.choice([2, 3]) for _ in range(20_000))
    began = time.time()
    cost, audit = repair(codes)
    assert time.time() - began < 20
    # Stretches of another length are searched in another order and must lead to the same path.
    assert repair(codes[:3000], 1000) == repair(codes[:3000], 64)
    assert len(audit.replace("I", "")) == len(codes) and cost > 0


def plain(rows):
    """All results for rows (conv_id, turn, role, text) after damage, and the conversations asked for."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        found.setdefault(conv, []).append((turn is not None, turn or 0, role, mark, text, turn))
    return found


def result(turns):
    turns = sorted(turns, key=lambda t: t[:4])
    faults, seen = [], set()
    for _, _, role, _, text, _ in turns:
        shown = text.rstrip(" \t\n\x0b\f\r")
        fault = "sound" if shown[-1:] in (".", "!", "?") else "truncated"
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else fault
        seen.add((role, text))
        faults.append(fault)
    initials = [t[2][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    known = [t[5] for t in turns if t[5] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = cheapest(faults, initials) if len(turns) < 9 else repair(coded(faults, initials))
    out, at = [], 0
    for letter in audit:
        last = out[-1][0][:1] if out else ""
        spoken = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((spoken, ""))
            continue
        if letter == "K":
            out.append((turns[at][2], turns[at][4]))
        elif letter == "R":
            out.append((spoken, turns[at][4]))
        at += 1
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in FAULTS[1:]), illegal, cost, audit, sha)


def odd_turns(seed, n):
    rng = random.Random(seed)
    texts = [None, "", " \n", "Yes.", "No", "Ok! \t", "é?", "word " * 3000, "x" * 2000 + "."]
    return [
        (
            rng.choice([None, *range(12)]),
            rng.choice([None, *range(6)]),
            rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]),
            rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(5)}.",
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_conversations_of_odd_rows(spark, seed):
    rows = odd_turns(seed, 60)
    extra = tuple("x" for _ in CLASHING.split(","))
    names = f"{TURNS}, {CLASHING}, mark string, fault string, phase string, said string, again string"
    frame = spark.createDataFrame([r + extra + extra[:5] for r in rows], names).repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(frame).collect()}
    assert got == {conv: result(turns) for conv, turns in plain(rows).items()}


def test_one_hot_conversation_and_repeated_rows(spark):
    rows = [(1, i // 2, "user" if i % 4 < 2 else "assistant", f"t{i // 2}.") for i in range(12_000)] + [(2, 0, "user", "Hi.")] * 3
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1] == result(plain(rows)[1]) and got[1][2] == 6000
    assert got[2] == result(plain(rows)[2])


def test_damage(spark):
    rows = odd_turns(9, 400) + [(100 + i, 0, "user", "A. b? c!") for i in range(100)]
    damage = {None: []}
    asked = set()
    for conv, turn, role, text in rows:
        asked.add(conv)
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        damage.setdefault(conv, []).extend([(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r.conv_id: tuple(r)[1:] for r in damage_and_repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(found) == asked
    for conv in asked:
        assert found[conv] == (result(plain(damage[conv])[conv]) if damage[conv] else nothing)
    assert nothing in found.values()


def test_empty_table(spark):
    assert damage_and_repair(spark.createDataFrame([], TURNS)).collect() == []


@needs_data
def test_rows_equal_the_sql(spark):
    found = queries.op11_conversations(spark, SF)
    got = sorted(repr(list(row)) for row in found.collect())
    assert got == oracle_rows(queries.oracle_sql()["op11_conversations"], found.columns)
