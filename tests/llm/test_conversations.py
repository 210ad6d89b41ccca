import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import conversations as cv
from tidewatch.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key int, pos string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
INK = re.compile(r"[^\x20\x09-\x0D]")


def spelled(x):
    return " " if x is None else str(x)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = spelled(role), spelled(text)
        kind = zlib.crc32(f"{spelled(conv)}:{spelled(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, role, text


def cheapest(rows, kinds):
    """(cost, audit, repaired turns) by trying every edit in every state."""

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        following = {"": "u", "s": "u", "u": "a", "a": "u"}[state]

        def add(cost, initial, turn, rest):
            if rest is not None:
                found.append((cost + rest[0], initial + rest[1], ((turn,) if turn else ()) + rest[2]))

        name = {"u": "user", "a": "assistant"}[following]
        if inserted < 3:
            add(2, "I", (name, ""), best(i, following, inserted + 1))
        if i < len(rows):
            role, text = rows[i]
            add(3, "D", None, best(i + 1, state, 0))
            if kinds[i] not in ("blank", "duplicate"):
                extra = kinds[i] == "truncated"
                add(2 + extra, "R", (name, text), best(i + 1, following, 0))
                if role[:1] == following or role[:1] == "s" and state == "":
                    add(0 + extra, "K", (role, text), best(i + 1, role[:1], 0))
        return min(found, key=lambda f: f[:2]) if found else None

    return best(0, "", 0)


def slow(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in damaged([x[:4] for x in rows if x[0] == conv])]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:32].encode()))
        kinds, seen = [], set()
        for _, _, role, text in mine:
            ink = INK.findall(text)
            if not ink:
                kinds.append("blank")
            elif (role, text) in seen:
                kinds.append("duplicate")
            elif ink[-1] not in ".!?":
                kinds.append("truncated")
            else:
                kinds.append("")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(tuple(r[2:] for r in mine), tuple(kinds))
        out.append(
            (
                conv,
                max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine)),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def made(n, seed, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "ux"]
    rows = []
    for conv in range(n):
        usual = rng.random() < 0.5
        for turn in range(rng.randrange(longest)):
            role = ("user", "assistant")[turn % 2] if usual and rng.random() < 0.8 else rng.choice(roles)
            text = rng.choice(["a.", "b!", "c? \n", "cut", "", " \t", None, "x. y", "e\x0b.", "…", f"{turn}.", f"{turn}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + rng.randrange(4), None]), role, text, 1, "p"))
    return rows


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return [tuple(r) for r in queries.op12_conversations(spark, str(path)).select(*COLUMNS).collect()]


def test_query_equals_trying_every_edit(spark, tmp_path):
    rows = made(400, 1)
    rows += rows[:40]  # repeated rows
    rows += [(9001, None, None, None, 1, "p"), (9002, None, "user", "x" * 3_000_000 + ".", 1, "p")]
    assert sorted(write(spark, tmp_path, rows), key=str) == slow(rows)


def test_long_conversations_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cv, "PART_BITS", 1)
    monkeypatch.setattr(cv, "_FAN", 3)
    rows = made(12, 2, longest=90)
    assert sorted(write(spark, tmp_path, rows), key=str) == slow(rows)


def test_one_conversation_holds_most_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{rng.randrange(9000)}.", 1, "p") for t in range(6000)]
    rows += [(7, 3, "user", "same.", 1, "p")] * 3000 + made(5, 5)
    found = {r[0]: r for r in write(spark, tmp_path, rows)}
    mine = found[7]
    kept = sum(c != "I" for c in mine[7])
    assert kept == len(list(damaged([r[:4] for r in rows if r[0] == 7])))
    assert mine[3] >= 2990  # the copies of one turn
    # the cheapest cost by a plain forward table
    after = sorted(damaged([r[:4] for r in rows if r[0] == 7]), key=lambda r: (r[1], r[2], r[3]))
    seen, costs = set(), {"": 0}
    for _, _, role, text in after:
        for _ in range(3):
            for state, to in (("", "u"), ("u", "a"), ("a", "u")):
                if state in costs:
                    costs[to] = min(costs.get(to, 1e9), costs[state] + 2)
        gone = not INK.search(text) or (role, text) in seen
        cut = not gone and INK.findall(text)[-1] not in ".!?"
        seen.add((role, text))
        new = {}
        for state, cost in costs.items():
            to = {"": "u", "u": "a", "a": "u"}[state]
            options = [(state, 3)] + ([] if gone else [(to, 2 + cut)] + ([(to, cut)] if role[0] == to else []))
            for end, more in options:
                new[end] = min(new.get(end, 1e9), cost + more)
        costs = new
    assert mine[6] == min(costs.get("", 1e9), costs.get("a", 1e9), costs.get("u", 1e9) + 2)


def test_given_conversations_equal_trying_every_edit(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversations(spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == slow(rows)


def test_empty_table_and_dropped_conversation(spark, tmp_path):
    assert write(spark, tmp_path / "a", []) == []
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert write(spark, tmp_path / "b", [(gone, 0, "user", "hi.", 1, "p")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


@pytest.mark.parametrize("seed", range(6))
def test_ranks_pick_the_least_path(seed):
    """Random layered graphs: the path read from the pointers is the least of all lists of edits."""
    rng = random.Random(seed)
    layers, width = 7, 3
    arcs = {}
    for layer in range(layers):
        for s in range(width):
            for edit in rng.sample(range(4), rng.randrange(1, 4)):
                arcs[layer * width + s, edit] = (layer + 1) * width + rng.randrange(width)
    keys = sorted(arcs)
    node, edit = (np.array(x) for x in zip(*keys, strict=True))
    to = np.array([arcs[k] for k in keys])
    path, ends = cv.least_paths((layers + 1) * width, node, edit, to, np.arange(width))

    def least(at):
        return min(([e] + least(arcs[at, e]) for e in range(4) if (at, e) in arcs), default=[])

    begin = 0
    for s, end in zip(range(width), ends, strict=True):
        assert edit[path[begin:end]].tolist() == least(s)
        begin = end
