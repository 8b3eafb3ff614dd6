"""The prefix trie against plain dictionaries of members."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldweave.llm import prefix_trie as T

from . import helpers as H

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The nodes of the trie of (conv_id, turn, role, text) rows, sorted."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    for x in own.values():
        x.sort()
    members, ends, last = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = [x[3:] for x in own.get(leader, [])[:h] + own[c][h:]]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            last[tuple(turns[:d])] = len(H.words(turns[d - 1][1])) if d else 0
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * last[p] + sum(saved[q] for q in children[p])
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=lambda r: (r[0], r[1]))


def conversations(seed=3, n=160):
    r = random.Random(seed)
    lines = [None, "", "be brief", "hello there", "go on  please", "é ü x", "a " * 40]
    rows = []
    for c in [*range(n), *range(1000, 1040), -3, -20, -25, 2**62, 5 * 10**9]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", None]) if t else "system", r.choice(lines[:4] if t < 2 else lines)))
    rows += [(7, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "user", "other"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(9000 + k, t, "user", "same") for k in range(60) for t in range(3)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("heavy", "shard", "small"), [(1024, 2**14, 2**18), (8, 50, 2**18), (1, 10, 0)])
def test_nodes_equal_brute_force(spark, monkeypatch, heavy, shard, small):
    for name, v in (("HEAVY", heavy), ("SHARD", shard), ("BROADCAST_TOP", small), ("SPAN_BITS", 3)):
        monkeypatch.setattr(T, name, v)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS depth", "'y' AS c", "1 AS a", "2 AS words").repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in T.prefix_trie(df).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute(rows)


def test_empty_table_and_long_conversation(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert T.prefix_trie(spark.createDataFrame([], kind)).collect() == []
    rows = [(40, t, "user", f"turn {t}") for t in range(3000)] + [(60, 0, "user", "w " * 200_000)]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in T.prefix_trie(spark.createDataFrame(rows, kind)).collect()), key=lambda r: (r[0], r[1]))
    assert got == brute(rows)


def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**62), 2**62, (2, 5000))
    table = T.Slots(a, b)
    assert sorted(table.find(a, b).tolist()) == list(range(5000))
    assert (table.find(a, b + 1) == -1).all()
    assert T.Slots(a[:0], b[:0]).find(a[:3], b[:3]).tolist() == [-1, -1, -1]
