"""Exact vector operators: cosine as a Column, top-k for a query, and blocked similarity joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that a similarity join multiplies at once, and pairs that it computes exactly at once.
BLOCK, PAIRS = 2048, 1 << 17
#: Groups of a similarity join as long as they hold no more than this, as 64-bit numbers.
GROUPS, GROUP_MB = 8, 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_of_distance(d: Column) -> Column:
    """Cosine of two unit vectors at a Euclidean distance."""
    return 1 - d * d / 2


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "memory_id") -> DataFrame:
    """The k nearest by cosine with 1-based places; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.select(key, F.round(cosine(F.col("embedding"), q), 6).alias("sim")).orderBy(F.desc("sim"), key).limit(k)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("sim"), key)))  # k rows


def similar_pairs(vectors: DataFrame, low: float, high: float = 2.0, key: str = "memory_id", block: int = BLOCK) -> DataFrame:
    """All pairs a < b with cosine in [low, high]: (a, b, sim), exact, similarity rounded to 6 places.

    Vectors are dealt to groups by a hash of the key, and every pair of groups
    is a tile, which one task multiplies a piece of ``block`` rows at a time.
    A vector is sent once a tile of its group, as 32-bit numbers where that
    loses nothing.  There are at most GROUPS groups until one would exceed
    GROUP_MB, so what is sent grows as the vectors do; past that, as their
    number times the number of groups.  A 32-bit product rules pairs out by
    its error's bound; the others' cosines are computed in 64 bits.
    """
    return _tiled(vectors, low, high, key, block)


def linking_pairs(vectors: DataFrame, low: float, high: float = 2.0, key: str = "memory_id", facts: DataFrame | None = None, same: Sequence[str] = (), agree: Sequence[str] = (), apart: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(a, b) whose connected components are those of all pairs of ``similar_pairs`` that keep the rules.

    The rules are on strings of ``facts``, joined by ``key``: those of ``same``
    are equal, those of ``agree`` equal or null on a side, and none of
    ``apart`` is there on both sides.  A tile links each of its vectors once
    at most, to one that it reaches within the tile, so rows grow as the
    vectors do however many pairs there are.
    """
    return _tiled(vectors, low, high, key, block, facts, (tuple(same), tuple(agree), tuple(apart)))


def _united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's least row reachable by what ``root`` says and by edges x, y."""
    while len(x):
        rx, ry = root[x], root[y]
        differ = rx != ry
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _codes(columns: list[list]) -> list[np.ndarray]:
    """Each list of strings as numbers that are equal where the strings are, -1 for null."""
    coded = pa.array([s for c in columns for s in c], pa.string()).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.split(coded, np.cumsum([len(c) for c in columns])[:-1])


def _tiled(vectors: DataFrame, low: float, high: float, key: str, block: int, facts: DataFrame | None = None, rules: tuple[tuple[str, ...], ...] | None = None) -> DataFrame:
    v = vectors.filter("embedding is not null").select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("embedding"))
    named = [name for rule in rules or () for name in rule]
    n, width = v.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    most = max(1, (GROUP_MB << 20) // (8 * max(1, width)))
    g = max(1, min(GROUPS, -(-n // block)), -(-n // most))
    tile = {(i, j): t for t, (i, j) in enumerate((i, j) for i in range(g) for j in range(i, g))}
    sent = np.dtype(np.float32)

    def deal(batches):
        for batch in batches:
            keys, group = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), width)
            for i in np.unique(group):
                mine = np.flatnonzero(group == i)
                rows = m[mine]
                short = rows.astype(sent)
                one = np.array_equal(short, rows)
                ks, data = keys[mine].tolist(), (short if one else rows).tobytes()
                tiles = [tile[min(i, j), max(i, j)] for j in range(g)]
                said = [batch.column(3 + c).take(pa.array(mine)).to_pylist() for c in range(len(named))]
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int32()), pa.array([int(i)] * g, pa.int32()), pa.array([ks] * g, pa.list_(pa.int64())), pa.array([one] * g), pa.array([data] * g, pa.binary()), pa.array([said] * g, pa.list_(pa.list_(pa.string())))], ["tile", "g", "ks", "short", "m", "said"])

    def multiply(batches):
        held, at = {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(0)[r].as_py() != at:
                    yield from products(held)
                    held, at = {}, batch.column(0)[r].as_py()
                kind = sent if batch.column(3)[r].as_py() else np.float64
                ks = batch.column(2)[r].values.to_numpy()
                held.setdefault(batch.column(1)[r].as_py(), []).append((ks, np.frombuffer(batch.column(4)[r].as_buffer(), kind).reshape(len(ks), width).copy(), batch.column(5)[r].as_py()))
        yield from products(held)

    def products(held):
        sides, told = [], []
        for pieces in held.values():
            ks, m = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
            told.append([[s for p in pieces for s in p[2][c]] for c in range(len(named))])
            pieces.clear()
            sizes = np.linalg.norm(m.astype(np.float64), axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                sides.append((ks, m, sizes, np.where(sizes[:, None] > 0, m / sizes[:, None], 0).astype(np.float32)))
        if not sides:
            return
        (ka, a, na, ua), (kb, b, nb, ub) = sides[0], sides[-1]
        first = len(ka) if len(sides) > 1 else 0  # of the second side's rows, all rows being numbered together
        said = {name: _codes([side[c] for side in told]) for c, name in enumerate(named)}
        root = np.arange(first + len(kb)) if rules is not None else None
        slack = 1e-6 + 2.5e-7 * (ua.shape[1] + 8)  # of rounding, and of the 32-bit product
        for i0 in range(0, len(ka), block):
            for j0 in range(i0 if len(sides) == 1 else 0, len(kb), block):
                i, j = np.nonzero(~(ua[i0 : i0 + block] @ ub[j0 : j0 + block].T < low - slack))
                i, j = i + i0, j + j0
                if len(sides) == 1:
                    i, j = i[i < j], j[i < j]
                for rule, names in enumerate(rules or ()):
                    for name in names:
                        x, y = said[name][0][i], said[name][-1][j]
                        ok = ((x == y) & (x >= 0), (x == y) | (x < 0) | (y < 0), (x < 0) | (y < 0))[rule]
                        i, j = i[ok], j[ok]
                for c in range(0, len(i), PAIRS):
                    x, y = i[c : c + PAIRS], j[c : c + PAIRS]
                    if rules is not None:  # what is linked already needs no cosine
                        open_ = root[x] != root[first + y]
                        x, y = x[open_], y[open_]
                    size = na[x] * nb[y]
                    dots = np.einsum("ij,ij->i", a[x], b[y], dtype=np.float64)
                    sim = np.round(np.divide(dots, size, out=np.zeros_like(dots), where=size > 0), 6)
                    keep = (sim >= low) & (sim <= high)
                    if rules is not None:
                        root = _united(root, x[keep], first + y[keep])
                        continue
                    x, y = ka[x[keep]], kb[y[keep]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim[keep])], ["a", "b", "sim"])
        if rules is not None and len(member := np.flatnonzero(root != np.arange(len(root)))):
            ks = np.concatenate([ka, kb]) if first else ka
            yield pa.RecordBatch.from_arrays([pa.array(ks[root[member]]), pa.array(ks[member])], ["a", "b"])

    v = v.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(g)).cast("int"))
    if facts is not None:
        v = v.join(facts.select(F.col(key).alias("k"), *named), "k").select("k", "embedding", "g", *named)
    dealt = v.mapInArrow(deal, "tile int, g int, ks array<long>, short boolean, m binary, said array<array<string>>")
    return dealt.repartitionById(len(tile), "tile").sortWithinPartitions("tile").mapInArrow(multiply, "a long, b long" + ", sim double" * (rules is None))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair as two directed rows (a, b, sim)."""
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def top_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each a with places; ties by key."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both_ways(pairs).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def keep_distinct(ranked: DataFrame, threshold: float = 0.92, group: str = "query_id", key: str = "id", order: str = "pos") -> DataFrame:
    """Greedy near-duplicate suppression in rank order: a row stays unless it is close to a row that stayed.

    Groups are a query's small pool.  Rows without a vector always stay.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, key, "embedding")))

    def step(kept, row):
        alike = F.exists(kept, lambda o: o["embedding"].isNotNull() & row["embedding"].isNotNull() & (cosine(o["embedding"], row["embedding"]) >= threshold))
        return F.when(alike, kept).otherwise(F.concat(kept, F.array(row)))

    kind = ranked.select(order, key, "embedding").schema
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    kept = ranked.groupBy(group).agg(F.aggregate(rows, empty, step).alias("kept"))
    return kept.select(group, F.explode("kept").alias("r")).select(group, f"r.{key}", f"r.{order}")
