from __future__ import annotations

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_doc string, _key string, kept boolean, shard int, size string, key string, taken int"
)
CLASH = ("d", "k", True, 7, "s", "q", 3)


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(rows, parts=3):
        """rows: (doc_id, text[, source[, lang]])."""
        full = []
        for r in rows:
            doc, text, source, lang = (*r, *[None] * (4 - len(r)))
            full.append((doc, text, lang, source, None if text is None else len(text), *CLASH))
        return spark.createDataFrame(full, SCHEMA).repartition(parts, "doc_id")

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, null keys, all sources."""
    rng = random.Random(1)
    words = "the of and thing other 日本語 éclair x".split()
    rows = [(1, None, "a"), (2, "", "a"), (3, "", None), (4, "  \n\t ", "b"), (5, "same text here", "b")]
    rows += [(6, "same text here", "a"), (7, "same text here", "c"), (7, "same text here", "c")]
    rows += [(8, "word " * 30_000, "c"), (9, "x" * 50_000, "z"), (None, "no key at all", "a")]
    rows += [(None, "no key at all", "a"), (10, "▁ literal ▁▁ sign\nand 😀 emoji", None)]
    rows += [
        (100 + i, "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6))), f"s{i % 4}")
        for i in range(60)
    ]
    return rows
