"""Prefix trie of conversations by ROLLUP over positional columns of turns.

A conversation's turns are laid out in blocks of ``WIDTH`` positional columns, each a turn's id and length.  One
``GROUP BY block, key, ROLLUP (t1 ... t8)`` aggregates all prefixes together; grouping_id tells how deep a prefix ends.  A
longer conversation goes on in further blocks, whose key is the name of the node at which the block before ended; so the
prefixes of all blocks come from the same job, however long conversations are.

Names: a turn's id is two 64-bit hashes of its place, role and text, a node's name its depth and the exclusive or of its
turns' ids.  So a block's key is a running exclusive or over the blocks before, taken in stretches of 1024 blocks, and the
parent's name is the node's without its last turn.

What a subtree sums up (childless nodes, saved tokens) comes from a second ROLLUP over the nodes themselves.  Nodes of
later blocks reach the blocks before through the smallest member, to whose path each node belongs: what a conversation's
nodes hold beyond a block is added at that block's end.

Nothing gathers a conversation, a node's members or its children in one task: turns are numbered in ranges of the whole
order, blocks are groups of 8 turns, members are aggregated before the shuffle.  The ids that end at a node are joined in
chunks of 4096 consecutive ids, and the chunks stream through the node's digest, which SHA-256 makes one after the other.

Edge cases: rows without a conversation id belong to none; a null role or text is empty; equal turn numbers go by role,
then text, and repeated rows are turns of their own; a conversation that is left without turns is a member of the root only;
a missing base lends nothing; an empty table has no nodes, not even a root; very long texts count by their length; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage

WIDTH = 8
SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]
BEFORE = (Window.unboundedPreceding, -1)
#: Consecutive ids in a chunk, consecutive blocks in a stretch, as powers of 2.
CHUNK, STRETCH = 12, 10


def placed_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 1, u, v, chars) and conversations (conv_id, n).

    u and v are hashes of role and text.  Ranges of the whole order are numbered each by itself; a conversation that
    runs over several goes on where it was in the range before.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = messages.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    turns = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64("role", "text").alias("u"), F.xxhash64("text", F.lit(1), "role").alias("v"), F.length("text").cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("at"),
    )).withColumn("part", F.shiftright("at", 33))
    starts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*BEFORE)), F.lit(0))
    starts = starts.withColumn("before", before)
    placed = turns.join(starts.drop("n"), ["conv_id", "part"])
    placed = placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "u", "v", "chars")
    return placed, starts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt_turns(messages: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, u, v, chars) and conversations (conv_id, n_turns).

    Each conversation c begins with the first h turns of c - c % group and goes on with its own after the first h, where
    h = crc32(c) % most.
    """
    placed, sizes = placed_turns(messages)
    placed = cut_lineage(placed)
    base = F.col("conv_id") - F.col("conv_id") % group
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = sizes.withColumn("base", base).withColumn("h", h).join(bases, "base", "left").withColumn("lent", lent)
    convs = cut_lineage(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    own = placed.join(convs.select("conv_id", "h", "lent"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("pos"), "u", "v", "chars")
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    borrowed = convs.select("conv_id", "base", "lent").join(heads, "base").where("place <= lent").select("conv_id", F.col("place").alias("pos"), "u", "v", "chars")
    return own.unionByName(borrowed), convs.select("conv_id", "n_turns")


def exclusive(df: DataFrame, key: str, place: str, columns: list[str], add, join, backwards: bool = False) -> DataFrame:
    """df with BEFORE_COLUMN: the aggregate ``add`` of a column over the rows of the key at smaller places (larger ones if backwards).

    join puts two such values together.  Stretches of places are aggregated first, so that no window holds more than one.
    """
    sign = -1 if backwards else 1
    rows = df.withColumn("_far", F.shiftright(place, STRETCH) * sign).withColumn("_near", F.col(place) * sign)
    whole = rows.groupBy(key, "_far").agg(*[add(c).alias(f"_all_{c}") for c in columns])
    ahead = Window.partitionBy(key).orderBy("_far").rowsBetween(*BEFORE)
    whole = whole.select(key, "_far", *[F.coalesce(add(f"_all_{c}").over(ahead), F.lit(0)).alias(f"_from_{c}") for c in columns])
    near = Window.partitionBy(key, "_far").orderBy("_near").rowsBetween(*BEFORE)
    rows = rows.join(whole, [key, "_far"])
    return rows.select(*df.columns, *[join(F.coalesce(add(c).over(near), F.lit(0)), F.col(f"_from_{c}")).alias(f"before_{c}") for c in columns])


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, n_turns, block, ka and kb (the key), t1 ... t8 (a, b, chars), xa and xb (what the block adds to the name)."""
    slot = (F.col("pos") - 1) % WIDTH
    turn = F.struct(F.xxhash64("pos", "u", "v").alias("a"), F.xxhash64("v", "u", "pos").alias("b"), "chars")
    wide = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(*[F.max(F.when(slot == i, turn)).alias(t) for i, t in enumerate(SLOTS)])
    wide = wide.join(convs, "conv_id", "right").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))  # a conversation without turns has one empty block
    wide = cut_lineage(wide.withColumn("xa", _xor([F.col(t)["a"] for t in SLOTS])).withColumn("xb", _xor([F.col(t)["b"] for t in SLOTS])))
    short = wide.where(f"n_turns <= {WIDTH}").withColumn("ka", F.lit(0).cast("long")).withColumn("kb", F.lit(0).cast("long"))
    long = exclusive(wide.where(f"n_turns > {WIDTH}"), "conv_id", "block", ["xa", "xb"], F.bit_xor, Column.bitwiseXOR)
    return short.unionByName(long.withColumnsRenamed({"before_xa": "ka", "before_xb": "kb"}))


def _xor(columns: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out.bitwiseXOR(F.coalesce(c, F.lit(0)))
    return out


def rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """The aggregates of every prefix of a block: block, ka, kb, t1 ... t8, at (turns of the block in it), depth, a and b (its name)."""
    slots = ", ".join(SLOTS)
    found = rows.sparkSession.sql(f"SELECT block, ka, kb, {slots}, grouping_id() AS gid, {aggregates} FROM {{rows}} GROUP BY block, ka, kb, ROLLUP ({slots})", rows=rows)
    found = found.withColumn("at", (WIDTH - F.bit_count("gid")).cast("long"))
    filled = sum((F.col(t).isNotNull().cast("int") for t in SLOTS), F.lit(0))
    # Prefixes that are longer than their conversation are none; what ends at no turn of a later block ended in the one before.
    found = found.where((filled == F.col("at")) & ((F.col("at") > 0) | (F.col("block") == 0)))
    names = {"depth": WIDTH * F.col("block") + F.col("at")} | {k: F.col(f"k{k}").bitwiseXOR(_xor([F.col(t)[k] for t in SLOTS])) for k in "ab"}
    return found.withColumns(names).drop("gid")


def _digests(batches):
    """depth, a, b, ends_sha256 of sorted rows (depth, a, b, ids), the ids of a node being in several rows."""
    last, sha = None, None

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["depth", "a", "b", "ends_sha256"])

    for batch in batches:
        done = []
        for name, ids in zip(zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b"))), batch.column("ids").to_pylist()):
            if name != last:
                if last is not None:
                    done.append((*last, sha.hexdigest()))
                last, sha = name, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield told(done)
    if last is not None:
        yield told([(*last, sha.hexdigest())])


def ends(blocks: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: the digest of the ids of the conversations that end at a node."""
    at_end = blocks.where(f"block = greatest(0, floor((n_turns - 1) / {WIDTH}))")
    named = at_end.select(F.col("n_turns").alias("depth"), F.col("ka").bitwiseXOR(F.col("xa")).alias("a"), F.col("kb").bitwiseXOR(F.col("xb")).alias("b"), "conv_id")
    name = ["depth", "a", "b"]
    chunks = named.groupBy(*name, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition(*name).sortWithinPartitions(*name, "chunk").select(*name, "ids").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, pos, u, v, chars), convs: (conv_id, n_turns), as rebuilt_turns gives them.
    """
    blocks = cut_lineage(blocks_of(turns, convs))
    nodes = rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id, max(n_turns) AS longest")
    last = F.element_at(F.array(*SLOTS), F.greatest("at", F.lit(1)).cast("int"))
    nodes = nodes.withColumn("last", F.when(F.col("at") > 0, last))
    nodes = nodes.withColumn("leaf", (F.col("longest") == F.col("depth")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.coalesce(F.col("last.chars"), F.lit(0)))
    nodes = cut_lineage(nodes)
    # What a conversation's own nodes hold beyond each of its blocks.
    held = nodes.where("block > 0").groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    paths = blocks.where(f"n_turns > {WIDTH}").join(held, ["conv_id", "block"], "left").na.fill(0, ["leaf", "saved"])
    beyond = exclusive(paths, "conv_id", "block", ["leaf", "saved"], F.sum, Column.__add__, backwards=True).drop("leaf", "saved").withColumnsRenamed({"before_leaf": "leaf", "before_saved": "saved"})
    parts = ["block", "ka", "kb", *SLOTS, "leaf", "saved"]
    sums = rolled_up(nodes.select(*parts).unionByName(beyond.where("leaf > 0 or saved > 0").select(*parts)), "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens")
    # A node's facts come together by its name.
    name = ["depth", "a", "b"]
    parent = [(F.col("depth") - 1).alias("depth"), F.col("a").bitwiseXOR(F.col("last.a")).alias("a"), F.col("b").bitwiseXOR(F.col("last.b")).alias("b")]
    facts = {"conv_id": "long", "n_convs": "long", "pa": "long", "pb": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
    fact = lambda df, *have: df.select(*name, *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in facts.items()])
    every = fact(nodes.withColumn("pa", parent[1]).withColumn("pb", parent[2]), "conv_id", "n_convs", "pa", "pb")
    every = every.unionByName(fact(nodes.where("depth > 0").select(*parent).withColumn("n_children", F.lit(1)), "n_children"))
    every = every.unionByName(fact(sums, "n_leaves", "saved_tokens")).unionByName(fact(ends(blocks), "ends_sha256"))
    whole = every.groupBy(*name).agg(*[(F.sum if c == "n_children" else F.max)(c).alias(c) for c in facts])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return whole.join(parents, ["depth", "pa", "pb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )
