"""Exact metric range join of vectors by angle: pivots make cells, the triangle inequality says which rows a cell borrows.

A group is a label with a vector length.  A vector belongs to the cell of its
nearest pivot and visits later cells that may hold partners; a cell's rows
are cut into tiles by their angle to the pivot, and pairs of tiles are
multiplied by themselves, so that no cell, label or crowd of copies has to
fit a task.  Linked pairs are counted and joined into components where they
are found; they are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, scan, tune
from mnemora.operators.graph import components

#: Rows a pivot stands for at least, and pivots at most: their vectors are broadcast.
CELL, PIVOTS = 2048, 4096
#: Bytes and rows of a tile at most.
TILE_BYTES, TILE_ROWS = 1 << 20, 2048
#: Radians that bounds are widened by against rounding.
SLACK = 1e-6


def units(column: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision; none of a vector without a direction (null, empty, zero, or not whole and finite)."""
    flat, start, size = column.flatten(), 0, column.value_lengths().to_pylist()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    x[np.asarray(flat.is_null())] = np.nan
    out: list[bytes | None] = []
    for n in size:
        v = x[start : start + (n or 0)]
        start += n or 0
        top = np.abs(v).max(initial=0.0)
        if np.isfinite(top) and top > 0:
            v = v / top  # so that no square overflows or vanishes
            out.append((v / np.sqrt(v @ v) + 0.0).astype("<f8").tobytes())
        else:
            out.append(None)
    return out


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def choose_pivots(classes: DataFrame, total: int, radius: float) -> dict[str, np.ndarray]:
    """Pivots of each group of over ``CELL`` rows: vectors of smallest hashes, without any close to an earlier one.

    A group has some one for each CELL rows, or for as many more as keep all
    of them below PIVOTS.  Any pivots, or none, give the same links.
    """
    each = max(CELL, 2 * -(-total // PIVOTS))
    sizes = classes.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > each)
    chosen = classes.select("g", "key", "unit").filter(F.pmod(F.xxhash64("key"), F.lit(each)) == 0).join(sizes, "g", "left_semi")
    out: dict[str, list[np.ndarray]] = {}
    for r in chosen.orderBy(F.xxhash64("key"), "key").select("g", "unit").limit(PIVOTS).collect():
        mine, v = out.setdefault(r["g"], []), np.frombuffer(bytes(r["unit"]), "<f8")
        if not mine or angle(np.stack(mine) @ v).min() > 2 * radius:
            mine.append(v)
    return {g: np.stack(m) for g, m in out.items()}


def radii(classes: DataFrame, pivots) -> dict[tuple[str, int], float]:
    """The largest angle of a cell's own rows to its pivot: a row a pivot."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        g, out = batch.column(0).to_pylist(), []
        raw = batch.column(1).to_pylist()
        for name in sorted({x for x in g if x in pivots.value}):
            cos = matrix([r for r, x in zip(raw, g, strict=True) if x == name]) @ pivots.value[name].T
            home, far = cos.argmax(axis=1), angle(cos.max(axis=1))
            out += [(name, int(p), float(far[home == p].max())) for p in np.unique(home)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["g", "cell", "far"]) if out else None

    found = scan(classes.select("g", "unit"), run, "g string, cell long, far double").groupBy("g", "cell").agg(F.max("far").alias("far"))
    return {(r["g"], r["cell"]): r["far"] for r in found.collect()}


def placed(classes: DataFrame, pivots, far, radius: float) -> DataFrame:
    """Rows of cells: (g, cell, visitor, angle, key, weight, unit).

    A row visits a later cell q if both bounds allow a partner there: its
    angle to q is within q's own reach plus the radius, and its distance to
    the plane halfway between its pivot p and q, (x.p - x.q) / |p - q|, is
    within the chord of the radius.  A pair of different cells thus meets
    once, in the later of its two cells.
    """
    chord = 2 * np.sin(radius / 2)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, raw = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        n = len(g)
        row, cell, visitor, turn = [np.arange(n)], [np.zeros(n, np.int64)], [np.zeros(n, bool)], [np.zeros(n)]
        for name in {x for x in g if x in pivots.value}:
            own = np.array([i for i in range(n) if g[i] == name])
            p = pivots.value[name]
            cos = matrix([raw[i] for i in own]) @ p.T
            home = cos.argmax(axis=1)
            best = cos[np.arange(len(own)), home]
            cell[0][own], turn[0][own] = home, angle(best)
            reach = np.array([far.value.get((name, q), -10.0) for q in range(len(p))])
            apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-18))[home]
            to = angle(cos)
            goes = (np.arange(len(p)) > home[:, None]) & (to <= reach + radius) & ((best[:, None] - cos) / apart <= chord)
            i, q = np.nonzero(goes)
            for column, value in zip((row, cell, visitor, turn), (own[i], q, np.ones(len(i), bool), to[i, q]), strict=True):
                column.append(value)
        at = pa.array(np.concatenate(row))
        values = [batch.column(0).take(at), pa.array(np.concatenate(cell)), pa.array(np.concatenate(visitor)), pa.array(np.concatenate(turn)), *(batch.column(c).take(at) for c in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(values, ["g", "cell", "visitor", "turn", "key", "weight", "unit"])

    return scan(classes.select("g", "key", "weight", "unit"), run, "g string, cell long, visitor boolean, turn double, key binary, weight long, unit binary")


def tiles(rows: DataFrame) -> DataFrame:
    """Rows of one cell that are next to each other by angle, together: (g, cell, visitor, tile, low, high, keys, weights, units)."""
    keys = ["g", "cell", "visitor", "turn", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            g, cell, visitor, low = held[0][:4]
            values = [[g], [cell], [visitor], [low], [held[-1][3]], [[h[4] for h in held]], [[h[5] for h in held]], [b"".join(h[6] for h in held)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (r[:3] != held[0][:3] or len(held) >= min(TILE_ROWS, max(1, TILE_BYTES // len(r[6])))):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    names = ["g", "cell", "visitor", "low", "high", "keys", "weights", "units"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
    schema = "g string, cell long, visitor boolean, low double, high double, keys array<binary>, weights array<long>, units binary"
    near = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g", "cell", "visitor", "turn", "key", "weight", "unit")
    return near.mapInArrow(run, schema).withColumn("tile", F.monotonically_increasing_id())


def local_roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a two-sided graph (rows, columns) of links: a number for each row and column, -1 without a link."""
    a, b = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    for n, start in enumerate(np.flatnonzero(linked.any(axis=1))):
        if a[start] >= 0:
            continue
        new = np.array([start])
        while len(new):
            a[new] = n
            there = np.flatnonzero(linked[new].any(axis=0) & (b < 0))
            b[there] = n
            new = np.flatnonzero(linked[:, there].any(axis=1) & (a < 0)) if len(there) else there
    return a, b


def links(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``least``.

    A row's angle to the middle of ``b``, with b's reach around it, can settle
    the row against all of ``b`` at once, either way; the others are multiplied.
    """
    middle = b.sum(axis=0)
    size = np.sqrt(middle @ middle)
    if not size:
        return a @ b.T >= least
    radius, middle = np.arccos(least), middle / size
    reach, far = angle(b @ middle).max(), angle(a @ middle)
    out = np.repeat((far + reach <= radius - SLACK)[:, None], len(b), axis=1)
    open_ = np.flatnonzero((far + reach > radius - SLACK) & (far - reach <= radius + SLACK))
    out[open_] = a[open_] @ b.T >= least
    return out


def compared(pairs: DataFrame, least: float) -> DataFrame:
    """Links of pairs of tiles: (key, n, root), a row for each linked key of a pair: its partners' weight, and a key of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, ka, wa, ua, kb, wb, ub in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(u, "<f8").reshape(len(k), -1) for u, k in ((ua, ka), (ub, kb)))
                linked = links(a, b, least)
                if same:
                    np.fill_diagonal(linked, False)
                some_a, some_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if not len(some_a):
                    continue
                linked = linked[np.ix_(some_a, some_b)]
                keys = [ka[i] for i in some_a]
                count = linked @ np.array(wb)[some_b]
                root_a, root_b = local_roots(linked | np.eye(len(linked), dtype=bool) if same else linked)  # a tile's rows are its columns
                if not same:
                    keys += [kb[i] for i in some_b]
                    count = np.concatenate([count, np.array(wa)[some_a] @ linked])
                roots = np.concatenate([root_a, root_b])[: len(keys)]
                lead: dict[int, bytes] = {}
                for r, key in zip(roots.tolist(), keys, strict=True):
                    lead[r] = min(lead.get(r, key), key)  # the least, as components are named: few rounds are left to do
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(count.astype(np.int64)), pa.array([lead[r] for r in roots.tolist()], pa.binary())], ["key", "n", "root"])

    return pairs.mapInArrow(run, "key binary, n long, root binary")


def linked_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Each row's number of links and component: (vec_id, n_links, component_id, kept).

    Rows link where their labels are equal and not null, their vectors of one
    length, and the cosine, in double precision, is at least ``least``.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing.  The component is its rows' smallest id, null ids
    apart; a row is kept if that is its own, so rows that repeat the smallest
    id are all kept, and a row with a null id only where no other id is.
    Columns of other names are not looked at.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "metric")
    radius = float(np.arccos(least)) + SLACK
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))

    def directed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units(batch.column(2)), pa.binary())], ["vec_id", "label", "unit"])

    rows = scan(slim, directed, "vec_id long, label string, unit binary")
    rows = rows.withColumn("unit", F.when(F.col("label").isNotNull(), F.col("unit"))).withColumn("g", F.concat(F.octet_length("unit").cast("string"), F.lit(":"), "label"))
    rows = scratch.table("rows", rows.select("vec_id", "g", F.unhex(F.md5(F.concat("unit", F.encode("g", "utf-8")))).alias("key"), "unit"))
    whole = rows.filter("unit is not null")
    classes = scratch.table("classes", whole.groupBy("key").agg(F.first("g").alias("g"), F.first("unit").alias("unit"), F.count("*").alias("weight")))
    pivots = scratch.send(choose_pivots(classes, classes.count(), radius))
    far = scratch.send(radii(classes, pivots))
    tile = scratch.table("tiles", tiles(placed(classes, pivots, far, radius)))
    x, y = (tile.select("g", "cell", *[F.col(c).alias(f"{c}_{s}") for c in ("visitor", "low", "high", "tile")]) for s in "xy")
    near = (F.col("low_x") <= F.col("high_y") + radius) & (F.col("low_y") <= F.col("high_x") + radius)
    pairs = x.filter("not visitor_x").join(y, ["g", "cell"]).filter(near & (F.col("visitor_y") | (F.col("tile_x") <= F.col("tile_y"))))
    pairs = scratch.table("pairs", pairs.select("tile_x", "tile_y"))
    a, b = (tile.select(F.col("tile").alias(f"tile_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("keys", "weights", "units")]) for s in "xy")
    both = pairs.join(a, "tile_x").join(b, "tile_y").select((F.col("tile_x") == F.col("tile_y")).alias("same"), *[f"{c}_{s}" for s in "xy" for c in ("keys", "weights", "units")])
    found = scratch.table("found", compared(both, least))
    joined = components(found.filter("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")), scratch.root)
    known = classes.select("key", "weight").join(found.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    known = scratch.table("known", known.select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component")).filter("n_links > 0"))
    ids = scratch.table("ids", rows.select("vec_id", "key").join(known, "key", "left"))
    least_id = scratch.table("least", ids.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least")))
    scratch.close("ids", "least")
    out = ids.join(least_id, "component", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
