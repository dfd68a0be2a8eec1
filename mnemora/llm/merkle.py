"""Merkle dataset manifest: one hash tree a source over the rows, one over the sources, and each row's proof.

Rows get their places by a distributed sort.  Blocks of 3**DEPTH consecutive
nodes are reduced where they lie, which leaves a tree 3**DEPTH times smaller;
this goes on until at most TOP nodes are left.  The driver builds that top
tree and broadcasts, for each of its nodes, the suffix of the path to the
root; the blocks are then reduced once more, and each row's proof is finished
and its root folded there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, scan, tune

#: Children of a node, and levels reduced at once: a block has ARITY**DEPTH nodes at most.
ARITY, DEPTH = 3, 7
BLOCK = ARITY**DEPTH
#: Nodes of a top tree that the driver builds; a larger one is reduced in blocks first.
TOP = 3**8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    """Lowercase hex of the hash of digests in hex, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 bytes' number, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


# A path is a list of steps (left, right): the digests of the other nodes of the run, in order.
Step = tuple[list[str], list[str]]


def climb(level: list[str], most: int, wanted: bool = True) -> tuple[list[str], list[list[Step]]]:
    """Reduce consecutive nodes ``most`` times, or until one is left: what remains, and each first node's path to it."""
    paths: list[list[Step]] = [[] for _ in level] if wanted else []
    at, done = list(range(len(level))), 0
    while done < most:
        runs = [level[i : i + ARITY] for i in range(0, len(level), ARITY)]
        if wanted:
            for x, i in enumerate(at):
                run, k = runs[i // ARITY], i % ARITY
                paths[x].append((run[:k], run[k + 1 :]))
            at = [i // ARITY for i in at]
        level = [digest(r) for r in runs]
        done += 1
    return level, paths


def height(n: int) -> int:
    """Levels above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def packed(path: list[Step]) -> bytes:
    return b"".join(bytes([len(left), len(right)]) + bytes.fromhex("".join(left + right)) for left, right in path)


def unpacked(raw: bytes) -> list[Step]:
    out, i = [], 0
    while i < len(raw):
        n, m = raw[i], raw[i + 1]
        names = [raw[i + 2 + 32 * k : i + 34 + 32 * k].hex() for k in range(n + m)]
        out.append((names[:n], names[n:]))
        i += 2 + 32 * (n + m)
    return out


def folded(start: str, path: list[Step]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        start = digest([*left, start, *right])
    return start


def proof(path: list[Step]) -> str:
    """The hash of a path's siblings, level by level, left to right."""
    return digest([s for left, right in path for s in left + right])


def placed(scratch: Scratch, name: str, nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with each one's place ``i`` in its group ``g`` by ``order``, and the group's size ``n``.

    A range sort deals out every group, the largest too; rows that are alike
    in all of ``order`` may change places and are dealt by a random number
    beside it.  Places are the sorted tasks' own, moved by how many rows of
    the group the tasks before have, at most one row a task and group.
    """
    keys = ["g", *order]
    far = nodes.withColumn("salt", F.rand(17)).repartitionByRange(*keys, "salt").sortWithinPartitions(*keys).drop("salt")
    rows = scratch.table(f"{name}_sorted", far.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)))
    tasks = rows.groupBy("g", "task").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("g", "task", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    return rows.join(tasks, ["g", "task"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def blocks(scratch: Scratch, name: str, nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Nodes (g, i, n, hash, payload) packed by block: (g, b, n, rows), the rows in order, BLOCK at most."""
    row = F.struct("i", "hash", *payload)
    out = nodes.withColumn("b", F.floor(F.col("i") / BLOCK)).groupBy("g", "b", "n").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return scratch.table(f"{name}_blocks", out)


def tops(packs: DataFrame) -> DataFrame:
    """What each block reduces to: (g, i, n, hash), n being the number of the group's blocks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, rows = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        top = [climb(hashes, min(DEPTH, height(m)), False)[0][0] for hashes, m in zip(rows, n, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-m // BLOCK) for m in n], pa.int64()), pa.array(top)], ["g", "i", "n", "hash"])

    return scan(packs.select("g", "b", "n", F.col("rows.hash").alias("rows")), run, "g string, i long, n long, hash string")


def top_trees(nodes: DataFrame) -> dict[str, tuple[str, list[list[Step]]]]:
    """The trees over at most TOP nodes (g, i, hash), built on the driver: each group's top and its nodes' paths."""
    groups: dict[str, list[str]] = {}
    for r in nodes.orderBy("g", "i").select("g", "hash").toLocalIterator():
        groups.setdefault(r["g"], []).append(r["hash"])
    out = {}
    for g, level in groups.items():
        (top,), paths = climb(level, height(len(level)))
        out[g] = top, paths
    return out


def suffixes(scratch: Scratch, name: str, nodes: DataFrame) -> DataFrame:
    """Each node's path to its group's top: (g, i, path binary, top).

    Nodes alone in their group are tops themselves.  At most TOP others go to
    the driver, and their paths are broadcast; more are reduced in blocks first.
    """
    schema = "g string, i long, path binary, top string"
    alone = nodes.filter("n = 1").select("g", "i", F.lit(b"").alias("path"), F.col("hash").alias("top"))
    rest = nodes.filter("n > 1")
    if rest.count() <= TOP:
        paths = [(g, i, packed(p), top) for g, (top, ps) in top_trees(rest).items() for i, p in enumerate(ps)]
        return alone.unionByName(scratch.spark.createDataFrame(paths, schema))
    packs = blocks(scratch, name, rest, [])
    upper = suffixes(scratch, f"{name}_", scratch.table(f"{name}_nodes", tops(packs)))
    return alone.unionByName(finished(packs, upper, [], schema, lambda r, path, up: (packed(path), up)))


def suffix_paths(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Each top node's path through its group's tree and the tree of groups: (g, i, path, subroot, root)."""
    if nodes.count() <= TOP:
        trees = top_trees(nodes)
        (root,), above = climb([trees[g][0] for g in sorted(trees, key=str.encode)], height(len(trees))) if trees else ([""], [])
        rows = [(g, i, packed([*p, *up]), trees[g][0], root) for g, up in zip(sorted(trees, key=str.encode), above, strict=True) for i, p in enumerate(trees[g][1])]
        return F.broadcast(scratch.spark.createDataFrame(rows, "g string, i long, path binary, subroot string, root string"))
    lower = scratch.table("lower", suffixes(scratch, "top", nodes))
    roots = lower.groupBy("g").agg(F.first("top").alias("hash")).select(F.lit("").alias("g"), F.col("g").alias("name"), "hash")
    roots = scratch.table("roots", placed(scratch, "group", roots, ["name"]))
    above = suffixes(scratch, "root", roots.drop("name")).select("i", F.col("path").alias("above"), F.col("top").alias("root"))
    above = roots.select(F.col("name").alias("g"), "i").join(above, "i").drop("i")
    return scratch.table("upper", lower.join(above, "g").select("g", "i", F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root"))


def finished(packs: DataFrame, upper: DataFrame, carry: list[str], schema: str, make) -> DataFrame:
    """Reduce each block once more, with its top's path: (g, i, ``make``'s values) of each node, or its carried columns for (g, i)."""
    kinds = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, (_, k) in zip(zip(*lines, strict=True), kinds, strict=True)], [f for f, _ in kinds])
            lines.clear()
            return out

        for batch in batches:
            for g, n, rows, up, *top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, paths = climb([r["hash"] for r in rows], min(DEPTH, height(n)))
                rest = unpacked(up)
                lines.extend((*([r[c] for c in carry] or [g, r["i"]]), *make(r, [*p, *rest], *top)) for r, p in zip(rows, paths, strict=True))
                if len(lines) >= BLOCK:
                    yield flush()
        if lines:
            yield flush()

    both = packs.join(upper.withColumnRenamed("i", "b"), ["g", "b"])
    return both.select("g", "n", "rows", "path", *[c for c in upper.columns if c not in ("g", "i", "path")]).mapInArrow(run, schema)


ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def prove(docs: DataFrame, tampered: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Each row's leaf, tree, proof, and whether another version of it leads to the same root.

    ``tampered`` is an expression of the other version's leaf (null: the row
    is as it was).  A row's leaf is the hash of ``fields``; leaves of a group
    ascend by id, null ids first, equal ids by leaf; rows alike in both are
    alike in the tree.  Groups are ordered bytewise, null first.  An empty
    table gives no rows.  Other columns are not looked at.  Returns (doc_id,
    leaf, subroot, root, proof_sha256, folded_root, verified).
    """
    spark: SparkSession = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "merkle")
    changed = F.lit(None).cast("string") if tampered is None else tampered
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    leaves = docs.select(g.alias("g"), F.col(id_col).cast("long").alias("doc_id"), leaf([F.col(c) for c in fields]).alias("hash"), changed.alias("changed"))
    packs = blocks(scratch, "leaf", placed(scratch, "leaf", leaves, ["doc_id", "hash"]), ["doc_id", "changed"])
    upper = suffix_paths(scratch, scratch.table("tops", tops(packs)))

    def make(r: dict, path: list[Step], subroot: str, root: str) -> tuple:
        end = folded(r["changed"] or r["hash"], path)
        return subroot, root, proof(path), end, end == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    scratch.drop("leaf_sorted")
    return finished(packs, upper, ["doc_id", "hash"], schema, make)


def manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with a planted change: of rows whose decimal id has an even crc32, texts lose their line feeds.

    Null texts and rows with a null id stay as they are.
    """
    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return prove(docs, F.when(even, leaf(cut)))
