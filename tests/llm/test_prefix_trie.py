from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stagetrace.llm import prefix_trie
from stagetrace.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, path string, family int, shard int"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", "p", 3, 4) for r in rows], SCHEMA).repartition(parts)


def brute(rows):
    """The trie in a dictionary, one turn after the other."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    paths = {}
    for c in own:
        own[c] = [x[3:] for x in sorted(own[c])]
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        paths[c] = [*own.get(base, [])[:h], *own[c][h:]]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if children[node] else 1
        for child in children[node]:
            saved, leaves = saved + sums[child][0], leaves + sums[child][1]
        sums[node] = saved, leaves
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        out.append(
            (min(members[node]), len(node), above, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(df):
    assert tuple(df.columns) == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(n, seed, longest=9, words=3):
    """Few different turns, so that prefixes are shared at every depth."""
    rng = random.Random(seed)
    say = ["", "a", "bb", "日本", "cc " * 4][:words]
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        for t in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, t, rng.choice(["user", "bot"])[: 1 + 3 * (rng.random() < 0.9)], rng.choice(say)))
    return rows


@pytest.fixture
def many_ranges(monkeypatch):
    """Ranges of a few conversations, so that nodes span several of them."""
    monkeypatch.setattr(prefix_trie, "ranges", lambda paths: 13)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = conversations(400, seed)
    assert found(prefix_trie.conversation_trie(turns_of(spark, rows))) == brute(rows)


@pytest.mark.parametrize("words", [1, 2, 5])
def test_nodes_that_span_ranges(spark, many_ranges, monkeypatch, words):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = conversations(300, 7, words=words)
    # a third of all conversations are one, and turnless ones
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 15000, 100) for t in range(3)]
    rows += [(c, 0, "user", "x") for c in range(20001, 20040)]
    want = brute(rows)
    assert found(prefix_trie.conversation_trie(turns_of(spark, rows))) == want
    assert found(prefix_trie.conversation_trie(turns_of(spark, rows, 7))) == want


def test_odd_rows(spark, many_ranges):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (2, 0, "ab", "c"), (3, 0, "a", "bc"), (None, 0, "user", "no conversation")]
    rows += [(100, t, "user", f"t{t}") for t in range(130)] + [(c, t, "user", f"t{t}") for c in (107, 200, 300) for t in range(130)]
    rows += [(400, 0, "user", "long " * 40_000), (401, 0, "user", "long " * 40_000), (402, 5, "user", "z"), (402, 5, "user", "y")]
    rows += [(-250, 1, "user", "negative"), (-200, 0, "user", "family")]
    assert found(prefix_trie.conversation_trie(turns_of(spark, rows))) == brute(rows)


def test_few_conversations(spark):
    assert found(prefix_trie.conversation_trie(turns_of(spark, []))) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone")]
    assert found(prefix_trie.conversation_trie(turns_of(spark, rows))) == brute(rows)
    assert len(brute(rows)) == 1


def test_equals_sql(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from check_oracle import connect, differences

    sf_dir = "/root/testdata/sf0.001"
    df = QUERIES["op11_prefix_trie"](spark, sf_dir)
    assert differences(df, connect(sf_dir), ORACLES["op11_prefix_trie"])[1] is None
    assert df.where(F.col("depth") == 0).count() == 1
