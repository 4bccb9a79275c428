from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stagetrace.llm import mixing, sharding


def as_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_targets_are_capped_and_the_excess_is_shared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 500), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights by name: a 5, b 2, c 1, z 5, null 2
    assert (got["a"], got["z"]) == (30.0, 0.0)
    rest = 1600 - 30
    assert got["b"] == pytest.approx(rest * 2 / 5) and got["c"] == 270.0 or sum(got.values()) == pytest.approx(1600)
    assert all(got[s] <= 3 * n + 1e-9 for s, n in (("a", 10), ("b", 1000), ("c", 90), (None, 500), ("z", 0)))
    assert sum(got.values()) == pytest.approx(1600)
    uncapped = {s: got[s] / w for s, w in (("b", 2), (None, 2), ("c", 1)) if got[s] < 3 * {"b": 1000, None: 500, "c": 90}[s]}
    assert max(uncapped.values()) - min(uncapped.values()) < 1e-6


def test_sources_take_their_budgets(make, odd_rows):
    docs = make(odd_rows)
    out = mixing.mixed(docs, mixing.word_count(F.col("text"))).collect()
    assert len(out) == len(odd_rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == int(t) for s, t in target.items())
    # rows that share a key or have none are told apart by their texts
    rows = odd_rows + [(7, "w " * n, "c") for n in range(1, 9)] + [(None, "v " * n, "a") for n in range(1, 9)]
    docs, again = (mixing.mixed(make(rows, parts=n), mixing.word_count(F.col("text"))) for n in (3, 7))
    out = docs.collect()
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert as_set(again, *columns) == sorted((tuple(r[c] for c in columns) for r in out), key=repr)


def test_mixed_documents_come_once_an_epoch(make, odd_rows):
    docs = make(odd_rows)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in out.collect())
    # documents without words stay
    assert times[(1, None)] == times[(2, "")] == 1
    assert max(times[(d, t)] for d, t, *_ in odd_rows if d not in (7, None)) <= 3
    assert mixing.mix_documents(docs.where("false")).count() == 0


def shards_of(docs, n, group=None):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    text = F.coalesce("text", F.lit(""))
    return sharding.kd_shards(docs, size, sharding.text_metadata(text), F.crc32(text) if group is None else group, n)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_shards_are_near_equal_and_slots_gapless(make, n):
    rows = [(i, f"text {i % 301} " + "w " * (i * 37 % 50)) for i in range(1500)]
    out = sharding.with_slots(shards_of(make(rows), n), "shard", ["doc_id"]).collect()
    assert sorted(r.doc_id for r in out) == list(range(1500))
    total, slots = Counter(), defaultdict(list)
    for r in out:
        total[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id))
    mean = sum(total.values()) / n
    assert set(total) == set(range(n)) and max(abs(t - mean) for t in total.values()) < 0.06 * mean + 130
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_equal_texts_stay_together_where_balance_permits(make):
    rows = [(i, f"copy {i // 4}") for i in range(800)]
    out = shards_of(make(rows), 5).collect()
    where = defaultdict(set)
    for r in out:
        where[r.doc_id // 4].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_cuts_against_a_plain_tree(make):
    """Leaves of a tree built by sorting: the widest dimension, cut at the weighted quantile."""
    rng = random.Random(21)
    points = [(i, rng.randrange(1, 9), rng.random() * 5, rng.gauss(0, 1)) for i in range(600)]
    spark = make([]).sparkSession
    docs = spark.createDataFrame(points, "doc_id long, size long, x double, y double").repartition(5)
    out = sharding.kd_shards(docs, F.col("size"), {"x": F.col("x"), "y": F.col("y")}, F.col("doc_id"), 11).collect()
    ends = [(min(p[i] for p in points), max(p[i] for p in points)) for i in (2, 3)]

    def scaled(p, i):
        low, high = ends[i]
        return (p[i + 2] - low) / (high - low)

    def split(own, node, k):
        if k == 1:
            return {p[0]: node for p in own}
        widths = [max(scaled(p, i) for p in own) - min(scaled(p, i) for p in own) for i in (0, 1)]
        own = sorted(own, key=lambda p: scaled(p, widths.index(max(widths))))
        total, before, cut = sum(p[1] for p in own) * (k // 2) / k, 0, 0
        while before + own[cut][1] <= total:
            before, cut = before + own[cut][1], cut + 1
        return split(own[:cut], node, k // 2) | split(own[cut:], node + k // 2, k - k // 2)

    plain = split(points, 0, 11)
    got = {r.doc_id: r.shard for r in out}
    # cuts may settle a row earlier or later
    assert sum(got[d] == plain[d] for d in plain) > 0.97 * len(plain)
    weight = Counter()
    for p in points:
        weight[got[p[0]]] += p[1]
    mean = sum(weight.values()) / 11
    assert max(abs(w - mean) for w in weight.values()) < 18


def test_a_single_huge_group_is_divided(make):
    out = shards_of(make([(i, "all the same") for i in range(400)]), 8).collect()
    assert set(Counter(r.shard for r in out).values()) == {50}


def test_odd_rows_and_empty_tables(make, odd_rows):
    out = shards_of(make(odd_rows), 6).collect()
    assert len(out) == len(odd_rows) and {r.shard for r in out} <= set(range(6))
    assert shards_of(make(odd_rows).where("false"), 6).count() == 0
    few = shards_of(make([(1, "a"), (2, None)]), 40).collect()
    assert len({r.shard for r in few}) == 2


def test_shards_follow_from_the_target_size(make):
    rows = [(i, "x" * 84) for i in range(100)]
    size = F.lit(100)
    out = sharding.kd_shards(make(rows), size, {"id": F.col("doc_id")}, F.col("doc_id"), target_bytes=2500)
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [25] * 4
