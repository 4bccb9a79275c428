"""The registered queries of this package; each reads its table whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrace.llm import (
    exact_dedup, hard_negatives, iblt, language, lines, mixing, packing, prefix_trie, sampling, sharding, simhash, token_order, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each equal text that stays."""
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, and whether they decode to its text."""
    return sampling.sample_segmentations(documents(spark, sf_dir))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences in training order, as the shards that were written hold them."""
    path = token_order.write_shards(documents(spark, sf_dir), stored=True)
    out = token_order.read_shards(spark, path)
    return out.select("slot", "shard", F.col("doc").alias("doc_id"), "sequence", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not held out."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    out = language.identify(docs, language.fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has."""
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes, equal texts side by side."""
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text)
    size = F.octet_length(text) + 16
    out = sharding.kd_shards(docs, size, sharding.text_metadata(text), crc, SHARDS)
    out = sharding.with_slots(out, "shard", ["doc_id"])
    return out.select(
        "doc_id",
        "size",
        F.col("group").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    out = mixing.mixed(documents(spark, sf_dir), mixing.word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return iblt.document_fingerprints(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the nearest examples."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    out = toxicity.score_documents(docs, toxicity.training_rows(docs, labels))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours", "similarities")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates."""
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids, a row for each piece."""
    out = packing.pack(documents(spark, sf_dir))
    return out.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, hard_negatives.moved_label())


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_piece_sampling, op3_token_shards, op4_language, op5_line_dedup, op6_kd_shards,
        op7_source_mix, op8_iblt_fingerprints, op9_toxicity, op10_simhash, op11_prefix_trie,
        op12_best_fit_packing, op13_hard_negatives,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

#: DuckDB SQL by query.
ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, body, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
              FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
              WINDOW same AS (PARTITION BY body))
    """,
    "op5_line_dedup": """
        WITH line AS (
            SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        keyed AS (
            SELECT *, translate(trim(part, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM line),
        repeated AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING min(doc_id) < max(doc_id)),
        marked AS (
            SELECT doc_id, part, pos, coalesce(doc_id > first, false) AS gone
            FROM keyed LEFT JOIN repeated USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op7_source_mix": rf"""
        WITH doc AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
                   substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS key
            FROM documents),
        named AS (
            SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)),
        placed AS (
            SELECT *, row_number() OVER w AS k,
                   sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM named
            WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
        free AS (SELECT * FROM placed WHERE rest * weight <= 3 * source_size * weights ORDER BY k LIMIT 1),
        target AS (
            SELECT p.source, p.source_size,
                   CASE WHEN p.k < f.k THEN CAST(3 * p.source_size AS DOUBLE)
                        ELSE CAST(p.weight * f.rest AS DOUBLE) / CAST(f.weights AS DOUBLE) END AS target
            FROM placed p, free f),
        summed AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
                   CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
            FROM doc d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
        epochs AS (
            SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM summed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
        FROM epochs
    """,
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id AS c, turn,
                   md5(strlen(role) || ':' || role || text) || lpad(CAST(length(text) AS VARCHAR), 12, '0') AS record
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                  FROM conversations WHERE conv_id IS NOT NULL)),
        own AS (
            SELECT c, list(record ORDER BY turn NULLS FIRST, record) AS own, CAST(c AS VARCHAR) AS digits
            FROM turns GROUP BY c),
        crc AS (
            -- CRC-32 bit by bit
            SELECT *, xor(4294967295, list_reduce(
                   list_transform(range(0, 8 * strlen(digits)), lambda i: CAST(ascii(digits[i // 8 + 1]) AS BIGINT) >> i % 8),
                   lambda crc, bits: xor(crc >> 1, xor(crc, bits) % 2 * 3988292384), 4294967295)) % 6 AS h
            FROM own),
        conv AS (
            SELECT o.c, list_concat(coalesce(b.own, [])[1:o.h], o.own[o.h + 1:]) AS path
            FROM crc o LEFT JOIN own b ON b.c = o.c - o.c % 100),
        prefix AS (
            SELECT c, d, array_to_string(path[1:d], '') AS node, len(path) = d AS ends
            FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM conv)),
        node AS (
            SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
                   CASE WHEN d > 0 THEN (count(*) - 1) * CAST(right(node, 12) AS BIGINT) ELSE 0 END AS saved,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM prefix GROUP BY node, d),
        child AS (SELECT left(node, 44 * (d - 1)) AS node, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
        below AS (
            SELECT left(x.node, 44 * x.up) AS node, x.up AS d, sum(x.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
            FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM node) x LEFT JOIN child c ON x.node = c.node AND x.d = c.d
            GROUP BY ALL)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
               coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM node n JOIN below b ON n.node = b.node AND n.d = b.d
        LEFT JOIN child c ON n.node = c.node AND n.d = c.d
        LEFT JOIN node p ON p.d = n.d - 1 AND p.node = left(n.node, 44 * (n.d - 1))
    """,
    "op13_hard_negatives": """
        WITH vec AS (
            SELECT row_number() OVER () AS row, coalesce(vec_id, 9223372036854775807) AS id, vec_id % 100 = 0 AS is_anchor,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pair AS (
            SELECT a.row, a.id AS anchor_id, c.id, c.label = a.label AS alike, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM vec a JOIN vec c ON a.is_anchor),
        positive AS (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id) AS k
            FROM pair WHERE alike AND id <> anchor_id QUALIFY k <= 5),
        negative AS (
            SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.row, p.k ORDER BY n.score DESC, n.id) AS rank
            FROM positive p JOIN pair n ON p.row = n.row
            WHERE NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
            QUALIFY rank <= 5)
        SELECT anchor_id, nullif(positive_id, 9223372036854775807) AS positive_id, CAST(rank AS INTEGER) AS rank,
               nullif(negative_id, 9223372036854775807) AS negative_id, positive_score, negative_score
        FROM negative
    """,
}
