from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from stagetrace.llm import exact_dedup, lines, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_summaries_are_low_by_a_bounded_amount():
    rng = random.Random(2)
    values = ["hot"] * 400 + [f"v{rng.randrange(300)}" for _ in range(1600)]
    rng.shuffle(values)
    true = Counter(values)
    found = exact_dedup.misra_gries((pd.Series(values[i : i + 100]) for i in range(0, 2000, 100)), 20)
    assert len(found) <= 20
    assert all(true[v] - 2000 / 21 <= found.get(v, 0) <= true[v] for v in true)


@pytest.mark.parametrize("counters", [2, 8, 4096])
def test_groups_against_brute_force(make, odd_rows, counters):
    rows = odd_rows + [(1000 + i, "hot text", "a") for i in range(40)]
    got = exact_dedup.duplicate_groups(make(rows), counters=counters).collect()
    by_text = {}
    for doc, text, *_ in rows:
        by_text.setdefault(text or "", []).append(doc)
    assert len(got) == len(rows)
    for r in got:
        same = next(v for t, v in by_text.items() if sha(t) == r.text_sha256)
        best = max(same, key=lambda d: -1 if d is None else d)
        assert (r.keep_id, r.group_size) == (best, len(same))
        assert not r.kept or r.doc_id == best
    assert sum(r.kept for r in got) == len(by_text)


def test_kept_documents_have_their_columns(make, odd_rows):
    docs = make(odd_rows)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    got = sorted((sha(r.text or ""), r.doc_id) for r in out.collect())
    best = {}
    for doc, text, *_ in odd_rows:
        s = sha(text or "")
        best[s] = doc if s not in best or best[s] is None else max(best[s], -1 if doc is None else doc)
    assert got == sorted(best.items())
    empty = make(odd_rows).where("false")
    assert exact_dedup.exact_dedup(empty).count() == 0 == exact_dedup.duplicate_groups(empty).count()


def drop_lines(rows, least):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def key(line):
        k = line.strip(blanks).translate(lower)
        return k if len(k) >= least else None

    found = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                found.setdefault(key(line), set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        all_lines = (text or "").split("\n")
        me = -(2**63) if doc is None else doc
        stay = [x for x in all_lines if key(x) is None or len(found[key(x)]) < 2 or min(found[key(x)]) == me]
        out.append((doc, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("least,most_bits", [(10, 1 << 29), (1, 1 << 18)])
def test_lines_against_brute_force(make, odd_rows, least, most_bits):
    rng = random.Random(3)
    pool = [f"Line number {i} of the pool" for i in range(30)] + ["short", "日本語日本語日本語", "日本語日本語日本語日"]
    rows = odd_rows + [
        (500 + i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(5)))
        for i in range(40)
    ]
    got = lines.dedup_lines(make(rows), least=least, most_bits=most_bits)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(drop_lines(rows, least), key=repr)


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_filters_miss_nothing_even_when_full(bits):
    keys = [f"key {i}".encode() for i in range(500)]
    small = lines.Filter(bits)
    small.add(lines.positions(keys[:300], bits))
    assert small.has(lines.positions(keys[:300], bits)).all()
    assert (bits == 64) == bool(small.has(lines.positions(keys[300:], bits)).all())


def test_filters_of_tasks_merge_without_a_loss():
    size, bits = lines.SEGMENT // 8, lines.SEGMENT
    tasks = [["a line only here", "a shared line"], ["a shared line"], ["own line", "own line two"], ["own line"]]
    filled = [
        f for texts in tasks for f in lines._fill(iter([pd.DataFrame({"text": [t]}) for t in texts]), bits, 4)
    ]
    twice = pd.DataFrame({"text": ["twice in a task", "twice in a task"]})
    filled += list(lines._fill(iter([twice]), bits, 4))
    frame = pd.concat(filled).sort_values(["segment", "part"])
    merged = list(lines._merge(iter([frame.iloc[:3], frame.iloc[3:]]), size))
    got = lines.Filter(bits, lines.np.frombuffer(lines.zlib.decompress(merged[0]["cells"].iloc[0]), "u1"))
    hits = got.has(lines.positions([b"a shared line", b"own line", b"twice in a task", b"a line only here"], bits))
    assert hits.tolist() == [True, True, True, False]


def test_lines_of_an_empty_table(make, odd_rows):
    assert lines.dedup_lines(make(odd_rows).where("false")).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_line_dedup", "op7_source_mix"])
def test_queries_against_their_sql(spark, make, odd_rows, name, tmp_path):
    rows = [r for i, r in enumerate(odd_rows) if r[0] is not None and r[0] not in {x[0] for x in odd_rows[:i]}]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    got, expected = (x.sort_values("doc_id", ignore_index=True)[sorted(got.columns)] for x in (got, expected))
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)
