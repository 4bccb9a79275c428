"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is the set of its paragraphs' digests.  A sketch hashes each digest into CHOICES
cells of a block, one in each row of it; a cell keeps a count, the XOR of the digests and
the XOR of their check sums.  Sketches are linear: cells subtract between two versions, and
what both have is gone.  Peeling then recovers the differing digests, one by one, from
cells that hold a single one; if cells of a block are left over, both versions of it are
sketched again as two blocks with new hashes, until all come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrace.llm.common import numbered, saved

#: Paragraphs are parted at line feeds and after the ends of sentences.
PARAGRAPH = r"\n|(?<=[.!?])[ \t]+"
CHOICES = 3
ROW_CELLS = 5
CELLS = CHOICES * ROW_CELLS
#: Differing digests that a block should have.
LOAD = 5
#: After so many retries the rest is compared digest by digest.
RETRIES = 24
CHECK_SEED = 77


def paragraph_digests(text: Column, pattern: str = PARAGRAPH) -> Column:
    """The distinct digests of the text's paragraphs; an empty text has one empty paragraph."""
    return F.array_distinct(F.transform(F.split(text, pattern), lambda p: F.xxhash64(p)))


def _slots(digest: Column, level: Column) -> list[Column]:
    """The cells of a digest: one in each row of a block."""
    h = F.xxhash64(digest, level)
    return [(F.pmod(F.shiftright(h, 12 * r), F.lit(ROW_CELLS)) + r * ROW_CELLS).cast("int") for r in range(CHOICES)]


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(CHECK_SEED))


def fingerprint(digests: Column) -> Column:
    """The sketch of a single block, as text: count, digests and check sums of each cell."""
    level = F.lit(0)
    zero = F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c")), CELLS)

    def add(cells: Column, digest: Column) -> Column:
        slots, check = _slots(digest, level), _check(digest)

        def more(x: Column, i: Column) -> Column:
            hit = slots[0] == i
            for s in slots[1:]:
                hit = hit | (s == i)
            full = F.struct((x["n"] + 1).alias("n"), x["k"].bitwiseXOR(digest).alias("k"), x["c"].bitwiseXOR(check).alias("c"))
            return F.when(hit, full).otherwise(x)

        return F.transform(cells, more)

    cells = F.aggregate(digests, zero, add)
    shown = F.transform(
        cells, lambda x: F.concat(F.lpad(F.hex(x["n"]), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["c"]), 16, "0"))
    )
    return F.lower(F.array_join(shown, ""))


def _peeled(cells: Column, level: Column) -> Column:
    """The number of digests that come out of a block's cells, or null if some are left.

    `cells` are structs (cell, n, k, c), those absent being zero.  Every step takes a cell
    of a single digest, whose check sum shows it, out of all its cells.
    """

    def pure(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))

    def step(state: Column, _: Column) -> Column:
        # lists of one member at most, so that what is worked out for it is worked out once
        found = F.transform(
            F.slice(F.filter(state["cells"], pure), 1, 1),
            lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), F.array(*_slots(x["k"], level)).alias("own")),
        )

        def take(one: Column) -> Column:
            def less(x: Column) -> Column:
                gone = F.struct(
                    x["cell"].alias("cell"),
                    (x["n"] - one["n"]).alias("n"),
                    x["k"].bitwiseXOR(one["k"]).alias("k"),
                    x["c"].bitwiseXOR(one["c"]).alias("c"),
                )
                return F.when(F.array_contains(one["own"], x["cell"]), gone).otherwise(x)

            left = F.filter(F.transform(state["cells"], less), lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
            return F.struct(left.alias("cells"), (state["found"] + 1).alias("found"))

        return F.coalesce(F.get(F.transform(found, take), F.lit(0)), state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"))
    # every digest that comes out empties a cell for good, so that there are no more steps than cells
    end = F.aggregate(cells, start, step)
    # again a list of one, or all steps are taken twice
    return F.get(F.transform(F.array(end), lambda x: F.when(F.size(x["cells"]) == 0, x["found"])), F.lit(0))


#: Digests of a text and of the next one.
TEXT, NEXT = "digests", "next_digests"
#: The edited text begins with so many of the text's digests; the rest of its digests.
SHARED, REST = "shared", "edited_rest"
VERSIONS = (TEXT, SHARED, REST, NEXT)


def _shared() -> Column:
    return F.slice(TEXT, F.lit(1), F.col(SHARED))


def edited_digests() -> Column:
    return F.concat(_shared(), REST)


def _block(digest: Column, level: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(-1 - level)), blocks)


def differences(groups: DataFrame, level: int) -> DataFrame:
    """groups with `edited` and `next`, how many digests differ in the blocks that came out,
    and `stuck`, the blocks where peeling got stuck.

    groups has `row`, `part`, the number of `blocks`, and the digests of three versions, those
    that text and edited text begin with once.  What belongs to a row stays in one task, with
    no further shuffle: the groups and their sketches are of one exchange.
    """
    spark = groups.sparkSession
    seed = F.lit(level)
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = groups.select("row", "part", "blocks", *VERSIONS).repartition(n, "row")

    # a bit for each version that has the digest
    in_text, in_edited, in_next = 1, 2, 4

    def members(digests: Column, versions: int) -> Column:
        return F.transform(digests, lambda d: F.struct(F.lit(versions).alias("v"), d.alias("d")))

    versions = [
        members(_shared(), in_text | in_edited),
        members(F.slice(TEXT, F.col(SHARED) + 1, F.size(TEXT)), in_text),
        members(F.col(REST), in_edited),
        members(F.col(NEXT), in_next),
    ]
    one = own.select("row", "part", "blocks", F.explode(F.concat(*versions)).alias("x"))
    # a digest's check sum and block are the same in all its cells
    one = one.select(
        "row", "part", "x.v", "x.d",
        _block(F.col("x.d"), level, F.col("blocks")).alias("block"),
        _check(F.col("x.d")).alias("c"),
        F.explode(F.array(*_slots(F.col("x.d"), seed))).alias("cell"),
    )

    def cell_of(bit: int, name: str) -> list[Column]:
        mine = F.col("v").bitwiseAND(bit) != 0
        zero = F.lit(0).cast("long")
        return [
            F.count_if(mine).alias(f"n_{name}"),
            F.bit_xor(F.when(mine, F.col("d")).otherwise(zero)).alias(f"k_{name}"),
            F.bit_xor(F.when(mine, F.col("c")).otherwise(zero)).alias(f"c_{name}"),
        ]

    sketches = one.groupBy("row", "part", "block", "cell").agg(
        *cell_of(in_text, "text"), *cell_of(in_edited, "edited"), *cell_of(in_next, "next")
    )

    def minus(name: str) -> Column:
        n = F.col("n_text") - F.col(f"n_{name}")
        k = F.col("k_text").bitwiseXOR(F.col(f"k_{name}"))
        c = F.col("c_text").bitwiseXOR(F.col(f"c_{name}"))
        # collecting leaves nulls out: a cell without a difference is not kept
        return F.when((n != 0) | (k != 0) | (c != 0), F.struct("cell", n.alias("n"), k.alias("k"), c.alias("c")))

    # at most CELLS structs to a block
    by_block = sketches.select("row", "part", "block", minus("edited").alias("e"), minus("next").alias("x"))
    by_block = by_block.groupBy("row", "part", "block").agg(F.collect_list("e").alias("e"), F.collect_list("x").alias("x"))
    by_block = by_block.select(
        "row", "part", "block", _peeled(F.col("e"), seed).alias("edited"), _peeled(F.col("x"), seed).alias("next")
    )
    out = F.col("edited").isNotNull() & F.col("next").isNotNull()
    counts = by_block.groupBy("row", "part").agg(
        F.sum(F.when(out, F.col("edited"))).alias("edited"),
        F.sum(F.when(out, F.col("next"))).alias("next"),
        F.collect_list(F.when(~out, F.col("block"))).alias("stuck"),
    )
    return own.join(counts, ["row", "part"])


def compared(rows: DataFrame) -> DataFrame:
    """(row, edited, next): how many digests of each row differ.

    A block where peeling got stuck is sketched again, for both versions, as two blocks
    with new hashes; blocks that came out are not touched again.
    """
    most = F.greatest(F.col(SHARED) + F.size(REST), F.size(NEXT)) + F.size(TEXT)
    blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(most / LOAD)))).cast("long")
    groups = rows.select("row", F.lit(0).cast("long").alias("part"), blocks.alias("blocks"), *VERSIONS)
    done = None
    for level in range(RETRIES):

        def within(digests: Column, at: int = level) -> Column:
            own = F.filter(digests, lambda d: _block(d, at, F.col("blocks")) == F.col("block"))
            return F.when(F.col("block").isNotNull(), own)

        # a row without a block for what came out, and one with the digests of each block that got stuck
        none = F.lit(None).cast("long")
        came = F.struct(none.alias("block"), F.col("edited").alias("edited"), F.col("next").alias("next"))
        left = F.transform("stuck", lambda b: F.struct(b.alias("block"), none.alias("edited"), none.alias("next")))
        found = differences(groups, level).withColumn("x", F.explode(F.concat(F.array(came), left)))
        found = found.select("row", "part", "blocks", *VERSIONS, "x.*").select(
            "row",
            F.xxhash64("part", "block", F.lit(level)).alias("part"),
            "block", "edited", "next",
            *(within(F.col(name)).alias(name) for name in (TEXT, REST, NEXT)),
            F.size(within(_shared())).alias(SHARED),
        )
        found = saved(found, "differences")
        came_out = found.where("block is null").select("row", "edited", "next")
        done = came_out if done is None else done.unionByName(came_out)
        stuck = found.where("block is not null")
        if stuck.isEmpty():
            groups = None
            break
        groups = stuck.select("row", "part", F.lit(2).cast("long").alias("blocks"), *VERSIONS)
    if groups is not None:  # never seen: the rest, digest by digest

        def apart(other: Column) -> Column:
            return (F.size(F.array_except(F.col(TEXT), other)) + F.size(F.array_except(other, F.col(TEXT)))).cast("int")

        rest = groups.select("row", apart(edited_digests()).alias("edited"), apart(F.col(NEXT)).alias("next"))
        done = done.unionByName(rest)
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edited", "next"))
    return done.groupBy("row").agg(*sums)


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Jaccard similarity of sets of sizes a and b of which `apart` members are in just one."""
    return (a + b - apart) / (a + b + apart)


def edited_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, row, digests, shared, edited_rest, next_digests).

    The next document is the one with the next smaller key, and after the last the first;
    null is smaller than any key.  Rows that share a key have the same next document; of
    several next ones that share a key, the least text counts.  An edited text mostly begins
    as its text does: only the digests from where the two part are kept for it.
    """
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = saved(whole.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies")), "lengths")
    placed = saved(numbered(sizes, ["key"], "at", "order"), "order")
    count = placed.count()
    gives = placed.select(F.col("key").alias("giver"), "copies", F.pmod(F.col("at") + 1, F.lit(max(1, count))).alias("at"))
    need = F.floor(F.col("n") / 3).cast("int").alias("need")
    links = placed.drop("copies").join(gives, "at").select("giver", "copies", F.col("key").alias("receiver"), need)

    def heads_of(some: DataFrame) -> DataFrame:
        return whole.join(some, F.col("key").eqNullSafe(F.col("giver"))).select(
            "receiver", F.left("text", F.col("need")).alias("head"), paragraph_digests(F.col("text")).alias(NEXT)
        )

    # where one row has the next key there is nothing to choose from, and its head is shuffled once, to the receiver
    several = heads_of(links.where("copies > 1")).groupBy("receiver").agg(F.min(F.struct("head", NEXT)).alias("got"))
    heads = heads_of(links.where("copies = 1")).unionByName(several.select("receiver", "got.*"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("head", cut))
    both = whole.join(heads, F.col("key").eqNullSafe(F.col("receiver")))
    both = both.select("key", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), NEXT)
    both = both.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.monotonically_increasing_id().alias("row"),
        paragraph_digests(F.col("text")).alias(TEXT),
        paragraph_digests(F.col("edited")).alias("edited_digests"),
        NEXT,
    )
    own = (key, "n_chars", "edited_sha256", "row", TEXT, NEXT)
    # past the end of the shorter list nothing is equal
    alike = F.zip_with(TEXT, "edited_digests", lambda a, b: F.coalesce(a == b, F.lit(False)))
    parts = F.array_position(F.concat(alike, F.array(F.lit(False))), False)
    both = both.select(*own, "edited_digests", (parts - 1).cast("int").alias(SHARED))
    rest = F.slice("edited_digests", F.col(SHARED) + 1, F.size("edited_digests"))
    return both.select(*own, SHARED, rest.alias(REST))


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Null texts count as empty; an empty text has one empty paragraph.  A text that is alone
    is its own next one.  Equal texts have equal fingerprints.  An empty table gives an
    empty result; further columns are not looked at.
    """
    rows = saved(edited_versions(docs, key, text), "versions")
    found = compared(rows)
    # of the next text the number of digests will do
    shown = rows.select(key, "n_chars", "edited_sha256", "row", TEXT, SHARED, REST, F.size(NEXT).alias("n_next"))
    a, e, x = F.size(TEXT), F.col(SHARED) + F.size(REST), F.col("n_next")
    return shown.join(found, "row").select(
        key,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col(TEXT)).alias("fingerprint"),
        fingerprint(edited_digests()).alias("edited_fingerprint"),
        likeness(a, e, F.col("edited")).alias("near_edited"),
        likeness(a, x, F.col("next")).alias("near_next"),
    )
