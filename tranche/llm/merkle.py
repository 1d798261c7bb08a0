"""Merkle manifest of a table: a tree per group, a tree over their roots, and the proof of every row.

Rows of a group are leaves in order. While several nodes remain, every two become their hash and a last lone one the hash
of itself. The leaves are cut into aligned blocks of 2 ** HEIGHT, and the blocks' nodes into blocks again, until one remains.
Inside a block, treehash stacks prepare the siblings that coming leaves need, so that authentication paths advance leaf by
leaf while a few nodes per level are held; the paths of a block's node in the trees above are shared by all its leaves.

Defined results: a null group is a group of its own, before all others; groups are in order of their UTF-8 bytes. Leaves
stand in order of the order column, null first, equal ones by their hashes. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .shared import before, table

#: Levels of a block's tree.
HEIGHT = 10
#: A step of a proof: the sibling's digest and whether it stands left; both null where a node is hashed alone.
STEP = StructType([StructField("left", BooleanType()), StructField("digest", StringType())])


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def encoded(field: Column) -> Column:
    """A field in a leaf: - if null, else the number of its bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    both = lambda d, s: F.when(s["digest"].isNull(), d).when(s["left"], F.concat(s["digest"], d)).otherwise(F.concat(d, s["digest"]))
    return F.aggregate(proof, start, lambda d, s: F.sha2(both(d, s), 256))


class Treehash:
    """A stack that makes one node of a height, a leaf or a joining a step. Leaves may end before the node is full."""

    def __init__(self, height: int):
        self.height, self.nodes, self.at, self.end = height, [], 0, 0

    def start(self, at: int, leaves: list[str]) -> None:
        self.nodes, self.at, self.end = [], at, min(at + (1 << self.height), len(leaves))

    def step(self, leaves: list[str]) -> None:
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            height, right = nodes.pop()
            nodes[-1] = (height + 1, joined(nodes[-1][1], right))
        elif self.at < self.end:
            nodes.append((0, leaves[self.at]))
            self.at += 1
        else:
            nodes[-1] = (nodes[-1][0] + 1, joined(nodes[-1][1]))

    def low(self) -> int:
        """The height that a next step works at; above all heights when there is nothing left to do."""
        if self.nodes:
            return self.nodes[-1][0] if len(self.nodes) > 1 or self.nodes[0][0] < self.height or self.at < self.end else 1 << 30
        return self.height if self.at < self.end else 1 << 30

    def finish(self, leaves: list[str]) -> str | None:
        while self.low() < 1 << 30:
            self.step(leaves)
        return self.nodes[0][1] if self.nodes else None


def node(leaves: list[str], height: int) -> str:
    """The node of a height over some leaves, 2 ** height at most."""
    stack = Treehash(height)
    stack.start(0, leaves)
    return stack.finish(leaves)


def paths(leaves: list[str], height: int) -> Iterator[list[tuple[bool | None, str | None]]]:
    """The steps from each leaf up to the node of a height over them, leaf by leaf.

    A level's sibling changes every 2 ** level leaves. The stacks that make the next ones share 2 * height - 1 steps a leaf;
    the one that works lowest goes first, so that all are done in time and few nodes are held.
    """
    first, auth, stacks = [], [], [Treehash(h) for h in range(height)]
    for h in range(height):  # the siblings of the first leaf; the left ones of the next
        second = Treehash(h)
        second.start(1 << h, leaves)
        auth.append(second.finish(leaves))
        first.append(leaves[0] if not h else joined(*filter(None, (first[-1], auth[h - 1]))))
        stacks[h].nodes = [(h, first[h])]
    for i in range(len(leaves)):
        yield [(None, None) if auth[h] is None else (bool(i >> h & 1), auth[h]) for h in range(height)]
        for h in range(height):
            if (i + 1) >> h << h != i + 1:
                break
            auth[h] = stacks[h].finish(leaves)
            stacks[h].start((i + 1 + (1 << h)) ^ (1 << h), leaves)
        for _ in range(2 * height - 1):
            stack = min(stacks, key=Treehash.low)
            if stack.low() == 1 << 30:
                break
            stack.step(leaves)


def levels(count: int, height: int) -> int:
    """Levels above so many nodes in their block: all of a block, or as many as one block's whole tree has."""
    return min(height, max(0, count - 1).bit_length())


def placed(rows: DataFrame) -> DataFrame:
    """rows: g, k, digest and others. Adds pos, the place in g by k and digest, and n, the rows of g."""
    key = [F.col("g").asc(), F.col("k").asc_nulls_first(), F.col("digest").asc()]
    cut = table(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()))
    cut = cut.withColumn("part", F.shiftright("at", 33))  # rows stand in tasks in order, and are numbered in them
    runs = cut.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("begin"))
    ahead = table(before(runs, "part", "rows", "ahead", ("g",)))
    sizes = ahead.groupBy("g").agg(F.sum("rows").alias("n"))
    ahead = ahead.join(sizes, "g").select("g", "part", "begin", "ahead", "n")
    return cut.join(ahead, ["g", "part"]).withColumn("pos", F.col("at") - F.col("begin") + F.col("ahead")).drop("at", "part", "begin", "ahead")


def in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def climb(leaves: DataFrame, height: int) -> list[DataFrame]:
    """leaves: g, pos, n, digest. These, their blocks' nodes, those nodes' blocks' nodes, and so on until each g has one."""

    def above(key, block):
        g, n, at = (x.as_py() for x in key)
        order = np.argsort(block.column("pos").to_numpy())
        digest = node(block.column("digest").take(pa.array(order)).to_pylist(), levels(n, height))
        return pa.table({"g": pa.array([g], pa.string()), "pos": [at], "n": [-(-n // (1 << height))], "digest": [digest]})

    made = [leaves]
    while True:
        made.append(table(in_blocks(made[-1].select("g", "pos", "n", "digest"), height).groupBy("g", "n", "block").applyInArrow(above, "g string, pos long, n long, digest string")))
        if (made[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return made


def with_proofs(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """nodes: g, pos, n, digest and others. Adds `proof`: the node's steps in its block and then those of upper (g, pos, proof),
    which has a row for each block."""
    rows = in_blocks(nodes, height)
    schema = StructType([*nodes.schema.fields, StructField("proof", ArrayType(STEP))])
    kind = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))
    names = nodes.columns

    def proven(key, block, shared):
        order = pa.array(np.argsort(block.column("pos").to_numpy()))
        block = block.select(names).take(order).combine_chunks()
        own = levels(block.column("n")[0].as_py(), height)
        rest = [(s["left"], s["digest"]) for s in shared.column("proof")[0].as_py()]
        steps = [s for path in paths(block.column("digest").to_pylist(), own) for s in (*path, *rest)]
        left, digest = zip(*steps) if steps else ((), ())
        values = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(digest, pa.string())], ["left", "digest"])
        size = own + len(rest)
        return block.append_column("proof", pa.ListArray.from_arrays(np.arange(0, size * block.num_rows + 1, size, np.int32) if size else np.zeros(block.num_rows + 1, np.int32), values).cast(kind))

    return rows.groupBy("g", "block").cogroup(upper.select("g", F.col("pos").alias("block"), "proof").groupBy("g", "block")).applyInArrow(proven, schema)


def proven(made: list[DataFrame], top: DataFrame, height: int) -> DataFrame:
    """made: what climb() gives. Its leaves with their proofs, which go on as top (g, proof) has it."""
    upper = made[-1].select("g", "pos").join(top, "g")
    for nodes in reversed(made[1:-1]):
        upper = table(with_proofs(nodes, upper, height).select("g", "pos", "proof"))
    return with_proofs(made[0], upper, height)


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """order, group, the columns of `keep`, leaf, subroot, root and proof of every row.

    fields: what a leaf is the hash of. The rows are read once; digests and kept columns are what is shuffled after that.
    """
    kept = F.struct(F.col(f"`{order}`").alias("order"), F.col(f"`{group}`").alias("group"), *[F.struct(c.alias("v")).alias(f"keep{i}") for i, c in enumerate((keep or {}).values())])
    g = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))  # null stands before all others
    leaves = rows.select(g.alias("g"), F.col(f"`{order}`").alias("k"), leaf(*[F.col(f"`{f}`") for f in fields]).alias("digest"), kept.alias("row"))
    trees = climb(placed(leaves).drop("k"), height)
    subroots = trees[-1].select("g", "digest")
    over = climb(table(placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), "digest")).withColumnRenamed("k", "key")), height)
    ends = over[-1].select("g", F.array().cast(ArrayType(STEP)).alias("proof"))
    top = proven(over, ends, height).join(over[-1].select("g", F.col("digest").alias("root")), "g")
    top = table(top.select(F.col("key").alias("g"), F.col("digest").alias("subroot"), "root", "proof"))
    out = proven(trees, top.select("g", "proof"), height).join(top.select("g", "subroot", "root"), "g")
    return out.select(F.col("row.order").alias(order), F.col("row.group").alias(group), *[F.col(f"row.keep{i}").getField("v").alias(k) for i, k in enumerate(keep or {})], F.col("digest").alias("leaf"), "subroot", "root", "proof")
