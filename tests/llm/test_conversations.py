"""Repairs against a search of all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from vecloom.llm import conversations as c
from vecloom.llm.registry import ENTRIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def _order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode())


def _faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _least(rows, faults):
    """(cost, audit, lines) by trying all edits, with the state told by the initials so far."""
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in moves[last]:
                    cost, audit, lines = best(i, role[0], inserted + 1)
                    options.append((cost + 3, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, last, 0)
            options.append((cost + 4, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                for edit, price, kept in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if kept[:1] and kept[0] in moves[last]:
                        cost, audit, lines = best(i + 1, kept[0], 0)
                        options.append((cost + price + extra, edit + audit, (f"{kept}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def _plain(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=_order)
    faults = _faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = _least(rows, faults)
    assert PATTERN.match("".join(line[0] for line in lines))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), lines


def _random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!\n", "why", "", " \t", None, "a.b", "Yes.", " ", "ok?"]
    return [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_reports_against_all_edits(spark):
    convs = {i: _random_rows(i, i % 9 + 1) for i in range(150)} | {None: _random_rows(999, 5)}
    rows = [(conv, *row) for conv, found in convs.items() for row in found]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cost int, key string").repartition(5)
    got = {r["conversation"]: tuple(r)[1:] for r in c.reports(df).collect()}
    assert set(got) == {None if k is None else str(k) for k in convs}
    out = {}
    for r in c.repaired(df).collect():
        out.setdefault(r["conversation"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    for conv, found in convs.items():
        want, lines = _plain(found)
        name = None if conv is None else str(conv)
        assert got[name] == want, (conv, found)
        assert [line for _, line in sorted(out.get(name, []))] == list(lines)


def test_batches_carry_the_state(spark):
    rows = [(1, i, ["user", "assistant", "tool"][i * i % 3], ["Hm.", "so", f"n{i}."][i % 3]) for i in range(200)]
    rows += [(2, i, "user", "same.") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(c.reports(df).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(c.reports(df).collect()) == whole
        assert c.repaired(df).count() == sum(r["audit"].count(e) for r in whole for e in "KRI")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole[1]["duplicate"] == 49


def test_a_long_text_and_a_long_conversation(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 1_000_000)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(20_000)]
    got = {r["conversation"]: r for r in c.reports(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["1"]["audit"], got["1"]["cost"]) == ("KDI", 7)
    assert got["2"]["audit"] == "K" * 20_000 and got["2"]["cost"] == 0


def test_steps_are_few():
    c.step.cache_clear()
    rng = random.Random(0)
    costs = c.ENDING
    for _ in range(20_000):
        low = min(costs)
        costs, _ = c.step(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "blank", "duplicate", "truncated"]), tuple(x - low for x in costs))
    assert c.step.cache_info().currsize < 2000


def test_damage_by_key(spark):
    rows = [(i, t, "system", f"A. b! {i}?") for i in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, map(tuple, c.damaged(df).collect())))
    want = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(map(str, want))


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (None, 0, "user", "a.")], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in c.audited(df, df.limit(0)).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: empty, None: empty}
    assert c.reports(df.limit(0)).count() == 0 and c.repaired(df.limit(0)).count() == 0 and c.audited(df.limit(0), df).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_its_sql(spark, sf):
    from tests.oracle import connect, differences

    entry = ENTRIES["op13_conversations"]
    folder = f"/root/testdata/{sf}"
    assert differences(entry.run(spark, folder), connect(folder), entry.sql) == []


def test_the_pattern_of_states():
    for word in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(6)):
        state = 0
        for initial in word:
            state = None if state is None else c.kept_state(state, initial)
        assert bool(PATTERN.match("".join(word))) == (state is not None and c.ENDING[state] == 0)
