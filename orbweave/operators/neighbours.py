"""Nearest-neighbour and radius joins of two point tables (id, x, y, z).

``knn`` is exact by either of two plans. *Blocks*: the queries, in blocks of bounded size, go to the tasks that
read the data, each task keeps its k best per query in numpy, and a window merges them; for few queries. *Grid*: rounds of
growing radius; points and queries meet in cells as wide as the radius by an equi-join, queries with k
points within the radius are settled and leave, the rest go on with a larger radius; after the rounds what is left is
finished in blocks if they are few. Ties at any distance go to the smaller id. Points at one place are reduced to their k least
ids beforehand, as no more can be among the k nearest, so a place with very many points is no hot cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import vectors as V
from orbweave.operators.schedule import Schedule
from orbweave.plans.cuts import Cuts, spread

#: Points nearer than this (squared) are the query itself where it is excluded.
SELF = 1e-10
#: With more queries than these the grid is taken without being asked for. A scan takes so many at least.
BLOCK = 4_096
#: Queries of a scan at most; they are sent to every task, 20 bytes each.
SENT = 1 << 18
#: Best points that a task keeps, queries times k, 12 bytes each.
KEPT = 1 << 22
#: Points that a task holds at once where it keeps nothing, pairs that it makes at once of these, and the queries and points of a tile.
HELD, CELLS = 1 << 18, 1 << 20
QUERY_TILE, POINT_TILE = 32, 128
#: Points that are sent to every task, 20 bytes each, where a k is too large for a task to keep k points of every query; queries at one
#: place that are answered at once, rows that they have at once, and neighbours of a query that follow each other at least.
RANKED, TOGETHER, ROWS, RUN = 1 << 22, 256, 1 << 16, 256
#: Times as many points are held, some 100 bytes each, where they are ordered: a scan of the queries costs about as much for many as for few.
ORDERED = 8
#: Points that tell what is too far for a tile of queries, and which slabs points are dealt to.
GUIDES = 1 << 13
#: What a search without a schedule of its own goes by: a schedule's defaults begin with fewer queries settled and grow faster,
#: which makes more pairs here.
USUAL = Schedule(percentile=0.5, multiplier=2.0)
#: A cell is wider than the radius by so much, for the rounding of FLOAT squares.
MARGIN = 1e-4


def _points(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), *(F.col(c).cast("float").alias(c) for c in "xyz")).where("id is not null and x is not null and y is not null and z is not null")


def _queries(df: DataFrame) -> DataFrame:
    return _points(df).select(F.col("id").alias("qid"), *(F.col(c).alias("q" + c) for c in "xyz"))


def _d2() -> Column:
    return V.squared_distance(V.vec("x", "y", "z"), V.vec("qx", "qy", "qz"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id")).cast("bigint")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", "d2")


def thinned(data: DataFrame, k: int) -> DataFrame:
    """The points without those that have k or more points of smaller id at their own place."""
    place = Window.partitionBy("x", "y", "z").orderBy("id")
    return data.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n")


def _curve(at: np.ndarray) -> np.ndarray:
    """An order of places in which near ones follow each other: the Morton curve of cells as wide on all axes."""
    at = np.nan_to_num(at.astype(np.float64), posinf=np.finfo(np.float32).max, neginf=np.finfo(np.float32).min)
    low = at.min(axis=0)
    width = max(float((at.max(axis=0) - low).max()), np.finfo(np.float64).tiny)
    code = np.zeros(len(at), np.uint64)
    for axis, values in enumerate(((at - low) * ((2.0**21 - 1) / width)).T):
        bits = values.astype(np.uint64)
        for step, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            bits = (bits | bits << np.uint64(step)) & np.uint64(mask)
        code |= bits << np.uint64(axis)
    return np.argsort(code, kind="stable")


def _boxes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of each ``size`` places in a row."""
    begin = np.arange(0, len(at), size)
    return np.minimum.reduceat(at, begin).astype(np.float64), np.maximum.reduceat(at, begin).astype(np.float64)


def _held(batches, most: int):
    """(ids, places) of up to ``most`` points and a batch more."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        n += len(held[-1][0])
        if n >= most:
            yield np.concatenate([h[0] for h in held]), np.column_stack([np.concatenate([h[i] for h in held]) for i in (1, 2, 3)])
            held, n = [], 0
    if n:
        yield np.concatenate([h[0] for h in held]), np.column_stack([np.concatenate([h[i] for h in held]) for i in (1, 2, 3)])


def _squares(at: np.ndarray, points: np.ndarray, exclude_self: bool) -> np.ndarray:
    """FLOAT squares of the distances, a row per query; infinite for what is left out."""
    d2 = None
    for axis in range(3):
        d = points[None, :, axis] - at[:, None, axis]
        d2 = d * d if d2 is None else d2 + d * d
    if exclude_self:
        d2[d2 <= np.float32(SELF)] = np.inf
    return d2


def _found(ids: np.ndarray, point: np.ndarray, d2: np.ndarray):
    for low in range(0, len(ids), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(point[part]), pa.array(d2[part])], ["qid", "id", "d2"])


def _merge(best_d: np.ndarray, best_i: np.ndarray, d2: np.ndarray, point: np.ndarray) -> None:
    """Puts what is among the k least of a row, by distance and id, into its best."""
    k, near = best_d.shape[1], d2 <= best_d[:, -1:]
    if d2.shape[1] > k and np.count_nonzero(near) > 4 * near.shape[0] * k:
        # what is beyond the k-th distance goes before the sort; ties with it stay
        near &= d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    r, c = np.nonzero(near)
    better = (d2[r, c] < best_d[r, -1]) | (point[c] < best_i[r, -1])
    r, c = r[better], c[better]
    if not len(r):
        return
    rows, first = np.unique(r, return_index=True)
    d, i = np.concatenate((d2[r, c], best_d[rows].ravel())), np.concatenate((point[c], best_i[rows].ravel()))
    order = np.lexsort((i, d, np.concatenate((r, np.repeat(rows, k)))))
    start = first + k * np.arange(len(rows))
    take = order[(start[:, None] + np.arange(k)).ravel()]
    best_d[rows], best_i[rows] = d[take].reshape(-1, k), i[take].reshape(-1, k)


def _block_scan(sent, k: int, exclude_self: bool):
    """Keeps each task's k best points of every query of the block.

    Queries and held points are ordered along a curve and cut into tiles. A tile of queries meets tiles of points from
    the nearest box on, until the next box is farther than the worst of its k-th distances, or than what was sent as too far for the tile.
    What is skipped can be no neighbour: FLOAT squares are no less than the boxes' distance but for their rounding, which has a margin.
    """

    def run(batches):
        ids, at, *limits = sent.value
        if not len(ids):
            return
        order = _curve(at)
        ids, at = ids[order], at[order]
        best_d = np.full((len(ids), k), np.inf, np.float32)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        query_low, query_high = _boxes(at, QUERY_TILE)
        limit = limits[0] if limits else np.full(len(query_low), np.inf)
        for point, where in _held(batches, ORDERED * HELD):
            order = _curve(where)
            point, where = point[order], where[order]
            low, high = _boxes(where, POINT_TILE)
            for tile in np.flatnonzero(_apart(low.min(axis=0), high.max(axis=0), query_low, query_high) <= limit):
                rows = slice(tile * QUERY_TILE, (tile + 1) * QUERY_TILE)
                least = _apart(low, high, query_low[tile], query_high[tile])
                worst = min(float(best_d[rows, -1].max()), limit[tile])
                near = np.flatnonzero(least <= worst)
                near = near[np.argsort(least[near])]
                done, step = 0, 1
                while done < len(near) and least[near[done]] <= worst:
                    some = near[done : done + step]
                    some = some[least[some] <= worst]
                    columns = (some[:, None] * POINT_TILE + np.arange(POINT_TILE)).ravel()
                    columns = columns[columns < len(point)]
                    _merge(best_d[rows], best_i[rows], _squares(at[rows], where[columns], exclude_self), point[columns])
                    worst = min(float(best_d[rows, -1].max()), limit[tile])
                    done, step = done + step, min(2 * step, 16)
        q, j = np.nonzero(np.isfinite(best_d) & (best_d <= np.repeat(limit, QUERY_TILE)[: len(ids), None]))
        yield from _found(ids[q], best_i[q, j], best_d[q, j])

    return run


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squares of the distances of boxes, less a margin; those of boxes without a place are less than any."""
    gap = np.maximum(np.maximum(low - other_high, other_low - high), 0)
    least = (gap * gap).sum(axis=1) * (1 - 1e-6) - 1e-36
    least[np.isnan(least)] = -np.inf
    return least


def _limits(at: np.ndarray, guides: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    """For each tile of queries, which are ordered along the curve, a square of a distance within which all of them have k of the guides."""
    guides, (low, high) = guides.astype(np.float64), _boxes(at[_curve(at)], QUERY_TILE)
    out = np.full(len(low), np.inf)
    if len(guides) < k:
        return out

    def limit(low: np.ndarray, high: np.ndarray, guides: np.ndarray) -> float:
        far = np.maximum(high - guides, guides - low)
        far = (far * far).sum(axis=1)
        if exclude_self:  # what may be a query's own place doesn't count
            far[((guides >= low - 1e-4) & (guides <= high + 1e-4)).all(axis=1)] = np.inf
        far[np.isnan(far)] = np.inf
        return np.partition(far, k - 1)[k - 1] * (1 + 1e-5) + 1e-36

    for begin in range(0, len(low), 16):
        some = slice(begin, begin + 16)
        box = low[some].min(axis=0), high[some].max(axis=0)
        # the guides that any of these tiles can need
        few = guides[_apart(guides, guides, *box) <= limit(*box, guides)]
        for tile in range(begin, min(begin + 16, len(low))):
            out[tile] = limit(low[tile], high[tile], few) if len(few) >= k else np.inf
    return out


def _slabs(points: DataFrame, guides: np.ndarray) -> DataFrame | None:
    """All points, dealt to as many slabs across the widest axis as there are cores; None if the guides don't tell slabs of about one size."""
    parts = points.sparkSession.sparkContext.defaultParallelism
    if parts < 2 or len(guides) < 64 * parts or not np.isfinite(guides).all():
        return None
    axis = int(np.argmax(guides.max(axis=0) - guides.min(axis=0)))
    values = np.sort(guides[:, axis])
    cuts = values[len(values) * np.arange(1, parts) // parts]
    if np.bincount(np.searchsorted(cuts, values, side="right"), minlength=parts).max() * parts > 2 * len(values):
        return None

    def slab(begin: int, end: int) -> Column:
        if begin == end:
            return F.lit(begin)
        middle = (begin + end) // 2
        return F.when(F.col("xyz"[axis]) < F.lit(float(cuts[middle])).cast("float"), slab(begin, middle)).otherwise(slab(middle + 1, end))

    return points.repartitionById(parts, slab(0, parts - 1))


def _wide_scan(sent, k: int, exclude_self: bool):
    """For a k too large for a task to keep k points of every query: each query's k best, or all, of the points held at a time."""

    def run(batches):
        ids, at = sent.value
        for point, where in _held(batches, HELD):
            order = np.argsort(point)
            point, where = point[order], where[order]
            some = max(1, CELLS // len(point))
            for low in range(0, len(ids), some):
                d2 = _squares(at[low : low + some], where, exclude_self)
                near = np.isfinite(d2)
                if len(point) > k:
                    limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
                    near &= d2 <= limit
                    tied = d2 == limit  # of the ties with the k-th the smaller ids
                    near &= ~tied | (np.cumsum(tied, axis=1) <= k - (d2 < limit).sum(axis=1)[:, None])
                q, j = np.nonzero(near)
                yield from _found(ids[low + q], point[j], d2[q, j])

    return run


def _asked_together(rows: pa.Table) -> pa.Table:
    """(part, x, y, z, qids): queries at one place, TOGETHER of them at most; these are dealt to parts in turn."""
    ids, at = rows.column(0).to_numpy(), np.column_stack([rows.column(i).to_numpy() for i in (1, 2, 3)])
    order = np.lexsort((ids, *at.T))
    ids, at = ids[order], at[order]
    place = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1))) if len(ids) else np.zeros(0, np.int64)
    begin = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b, TOGETHER) for a, b in zip(place, np.append(place[1:], len(ids))))])
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(begin, len(ids))), pa.array(ids))
    return pa.table([pa.array(np.arange(len(begin)), pa.int64()), *(pa.array(np.ascontiguousarray(at[begin, i])) for i in range(3)), lists], names=["part", "x", "y", "z", "qids"])


def _ranking(sent, k: int, exclude_self: bool):
    """The k nearest of all points, which were sent in order of their ids, once for the queries of a row: runs of them with the rank before each.

    A run is given out for all queries before the next one begins, so what is written repeats itself soon and takes little room.
    """

    def run(batches):
        ids, at = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                d2 = _squares(np.array([[row[c] for c in "xyz"]], np.float32), at, exclude_self)[0]
                near = np.flatnonzero(np.isfinite(d2))
                # squares aren't negative, so their bits are in their order; ties go by the place among the ids
                near = np.sort(d2[near].view(np.uint32).astype(np.uint64) << np.uint64(32) | near.astype(np.uint64))[:k] & np.uint64(2**32 - 1)
                size = max(RUN, ROWS // len(row["qids"]))
                for low in range(0, len(near), size):
                    some = near[low : low + size].astype(np.int64)
                    parts = [pa.array([row["qids"]], pa.list_(pa.int64())), pa.array([low]), *(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.array(x[some])) for x in (ids, d2))]
                    yield pa.RecordBatch.from_arrays(parts, ["qids", "low", "ids", "d2s"])

    return run


def _knn_ranked(points: pa.Table, rows: pa.Table, k: int, exclude_self: bool, spark) -> DataFrame:
    """(qid, rank, id, d2) without a shuffle of pairs: all points go to the tasks, and each query's neighbours are ranked in one of them."""
    ids, at = points.column(0).to_numpy(), np.column_stack([points.column(i).to_numpy() for i in (1, 2, 3)])
    order = np.argsort(ids, kind="stable")
    sent = spark.sparkContext.broadcast((ids[order], at[order]))
    together = _asked_together(rows)
    tasks = max(1, min(len(together), 64 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame(together).repartitionById(tasks, (F.col("part") % tasks).cast("int"))
    runs = dealt.mapInArrow(_ranking(sent, k, exclude_self), "qids array<long>, low long, ids array<long>, d2s array<float>")
    each = runs.select(F.explode("qids").alias("qid"), "low", "ids", "d2s").select("qid", "low", "d2s", F.posexplode("ids").alias("at", "id"))
    return each.select("qid", (F.col("low") + F.col("at") + 1).alias("rank"), "id", F.get("d2s", "at").alias("d2"))


def knn_blocks(data: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, block: int = SENT) -> DataFrame:
    """Scans the data once per block of queries. The queries' ids are unique.

    For many queries points are dealt to slabs first, so that a task looks at few other queries than those in its slab: some points
    guide it, by which every tile of queries has a distance that none of its neighbours can be beyond. With a large k the points are sent
    to the queries instead, if they aren't too many.
    """
    points, asked = _points(data), _queries(queries)
    spark = data.sparkSession
    wide = k * BLOCK > KEPT
    block = min(block, BLOCK if wide else max(BLOCK, KEPT // (4 * k)))
    rows, out, guides = asked.toArrow(), None, None
    if wide and points.limit(RANKED + 1).count() <= RANKED:
        return _knn_ranked(points.toArrow(), rows, k, exclude_self, spark)
    if len(rows) > BLOCK and not wide:
        found = points.orderBy(F.xxhash64("id")).limit(GUIDES).toArrow()
        guides = np.column_stack([found.column(c).to_numpy() for c in "xyz"])
    slabs = None if guides is None else _slabs(points, guides)
    points = spread(points) if slabs is None else slabs

    def scan(rows: pa.Table) -> DataFrame:
        ids, at = rows.column(0).to_numpy(), np.column_stack([rows.column(i).to_numpy() for i in (1, 2, 3)])
        limits = () if guides is None else (_limits(at, guides, k, exclude_self),)
        return points.mapInArrow((_wide_scan if wide else _block_scan)(spark.sparkContext.broadcast((ids, at, *limits)), k, exclude_self), "qid long, id long, d2 float")

    for low in range(0, max(1, len(rows)), block):
        part = scan(rows.slice(low, block))
        out = part if out is None else out.unionByName(part)
    return _best(out, k)


def _cell(axes: tuple[str, ...], edge: float, names: tuple[str, ...]) -> list[Column]:
    wide = F.lit(float(edge))
    # beyond 2^62 cells the outermost cell takes all, on both sides of the join
    return [F.greatest(F.least(F.floor(F.col(a).cast("double") / wide), F.lit(2.0**62)), F.lit(-(2.0**62))).cast("bigint").alias(n) for a, n in zip(axes, names)]


def grid_pairs(points: DataFrame, asked: DataFrame, radius: float) -> DataFrame:
    """(qid, id, d2) of all pairs within the radius, its surface included. Queries go to the 27 cells around theirs; points stay in one."""
    if not radius > 0:
        same = (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy")) & (F.col("z") == F.col("qz"))
        return asked.join(points, same).select("qid", "id", _d2().alias("d2"))
    edge, cells = radius * (1 + MARGIN), ("cx", "cy", "cz")
    left = points.select("*", *_cell(("x", "y", "z"), edge, cells))
    near = F.array(*(F.lit(i).cast("bigint") for i in (-1, 0, 1)))
    right = asked.select("*", *_cell(("qx", "qy", "qz"), edge, cells))
    for c in cells:
        right = right.withColumn("step", F.explode(near)).withColumn(c, F.col(c) + F.col("step")).drop("step")
    r = F.lit(float(radius)).cast("float")
    return right.join(left, list(cells)).select("qid", "id", _d2().alias("d2")).where(F.col("d2") <= r * r)


def knn_grid(data: DataFrame, queries: DataFrame, k: int, schedule: Schedule | None = None, exclude_self: bool = False, radius: float | None = None) -> DataFrame:
    """Rounds of growing radius; each is a job of its own, whose results are written before the next.

    A radius as wide as all points and queries settles every query, with fewer than k points if there are no more.
    """
    schedule = schedule or USUAL
    cuts = Cuts(data.sparkSession)
    points = cuts.cut(_points(data) if exclude_self else thinned(_points(data), k))
    active = cuts.cut(_queries(queries))
    places = active.select(F.col("qid").alias("id"), *(F.col("q" + c).alias(c) for c in "xyz"))
    box = points.select(*"xyz").union(places.select(*"xyz")).agg(*(f(c).cast("double").alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in "xyz")).first()
    widest = 1.01 * sum((box["h" + c] - box["l" + c]) ** 2 for c in "xyz") ** 0.5 if box["lx"] is not None else 0.0
    if points.count() <= k:
        return knn_blocks(points, places, k, exclude_self)  # all pairs are wanted, and no radius saves any
    r = radius if radius is not None else start_radius(points, places, k, schedule)
    settled, left, rounds = None, active.count(), 0
    while left:
        last = r >= widest or not np.isfinite(r)
        if rounds >= schedule.max_rounds and left > BLOCK:
            last, r = True, widest  # what the schedule's rounds leave, at once
        elif rounds >= schedule.max_rounds or last and left <= BLOCK:
            break
        pairs = grid_pairs(points, active, r)
        if exclude_self:
            pairs = pairs.where(F.col("d2") > F.lit(SELF).cast("float"))
        best = cuts.cut(_best(pairs, k))
        if last:
            settled = best if settled is None else settled.unionByName(best)
            left = 0
            break
        done = best.where(F.col("rank") == k).select("qid")
        full = best.join(done, "qid", "left_semi")
        settled = full if settled is None else settled.unionByName(full)
        rest = cuts.cut(active.join(done, "qid", "left_anti"))
        cuts.drop(active)
        active, now, rounds = rest, rest.count(), rounds + 1
        if now <= BLOCK and (now == left or now * 50 < left):
            left = now
            break  # few are left, and a scan settles them
        left, r = now, r * schedule.multiplier
    if left or settled is None:
        ends = knn_blocks(points, active.select(F.col("qid").alias("id"), *(F.col("q" + c).alias(c) for c in "xyz")), k, exclude_self)
        settled = ends if settled is None else settled.unionByName(ends)
    return settled


def knn(data: DataFrame, queries: DataFrame, k: int, schedule: Schedule | None = None, exclude_self: bool = False, method: str = "auto") -> DataFrame:
    """(qid, rank, id, d2): the k nearest points of each query, rank from 1; all points if there are fewer than k.

    A query's own point counts unless ``exclude_self``, which leaves out all points at its place. The schedule
    changes the work and never the result.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if method == "auto":
        method = "blocks" if queries.limit(BLOCK + 1).count() <= BLOCK else "grid"
    return knn_blocks(data, queries, k, exclude_self) if method == "blocks" else knn_grid(data, queries, k, schedule, exclude_self)


def neighbour_lists(pairs: DataFrame) -> DataFrame:
    """(qid, ids): each query's neighbours in order of rank."""
    return pairs.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))


def radius_join(data: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(qid, id, d2) of all pairs within the radius."""
    return grid_pairs(_points(data), _queries(queries), radius)


def radius_ids(data: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """The flat form: the point's id of each pair, repeats included."""
    return radius_join(data, queries, radius).select("id")


def radius_counts(data: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(qid, n_hits), queries without a hit included."""
    hits = radius_join(data, queries, radius).groupBy("qid").agg(F.count("*").alias("n_hits"))
    return _queries(queries).select("qid").join(hits, "qid", "left").select("qid", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"))


def radius_capped(data: DataFrame, queries: DataFrame, radius: float, cap: int) -> DataFrame:
    """(qid, rank, id, d2, n_hits): the ``cap`` nearest within the radius, with the number of all."""
    by = Window.partitionBy("qid")
    rank, n = F.row_number().over(by.orderBy("d2", "id")).cast("bigint"), F.count("*").over(by)
    pairs = radius_join(data, queries, radius).select("qid", rank.alias("rank"), "id", "d2", n.alias("n_hits"))
    return pairs.where(F.col("rank") <= cap)


#: Hits of a query that are kept, by round, the last one for all that follow.
CAPS = (128, 256, 512, 1_024, 2_048, 4_096, 10_000)
#: Hits that all active queries may keep together.
ALL_HITS = 50_000_000


def adaptive_cap(round_number: int, active: int) -> int:
    """Hits of a query that a round (from 1) keeps: fewer if many queries are active, but CAPS[0] at least."""
    return min(CAPS[min(round_number, len(CAPS)) - 1], max(CAPS[0], ALL_HITS // max(1, active)))


def saturation(counts: DataFrame, cap: int) -> DataFrame:
    """One row: how many of (qid, n_hits) reach the cap, and their share."""
    full = (F.col("n_hits") >= cap).cast("bigint")
    return counts.agg(F.coalesce(F.sum(full), F.lit(0)).cast("bigint").alias("saturated"), F.coalesce(F.avg(full), F.lit(0.0)).alias("ratio"))


def start_radius(points: DataFrame, queries: DataFrame, k: int, schedule: Schedule, most_queries: int = 100) -> float:
    """The schedule's first radius: fixed, or from the k-th distances of sampled queries to all points, one scan of these.

    All points, as the k-th distance among a sample of fixed size doesn't shrink as the points grow dense, and the pairs of a
    round would grow as their square.
    """
    if schedule.heuristic == "fixed":
        return float(schedule.fixed_radius)
    from orbweave.operators.sampling import hashed_sample

    kth = sampled_kth_distances(points, hashed_sample(queries, most_queries), k)
    found = radius_percentile(kth, schedule.percentile) if schedule.heuristic == "percentile" else radius_max(kth)
    value = found.first()["radius"]
    return float(value) if value and value > 0 else 1.0


def sampled_kth_distances(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, dist): distance to the k-th nearest point (the last if fewer), the query's own place left out."""
    near = knn_blocks(points, queries, k, exclude_self=True)
    return near.groupBy("qid").agg(F.sqrt(F.max("d2")).cast("float").alias("dist"))


def radius_percentile(kth: DataFrame, share: float) -> DataFrame:
    """One row, ``radius``: 1.1 times the distance at place floor(n * share) in order, no interpolation; null for no rows.

    Distances are dealt by ranges; the ranges' counts say which has the place, and only that is sorted.
    """
    cuts = Cuts(kth.sparkSession)
    placed = cuts.cut(kth.select("dist").repartitionByRange("dist").withColumn("part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())  # a row per partition
    n, before, part = sum(c for _, c in sizes), 0, 0
    at = min(int(np.floor(n * float(share))), n - 1)
    for part, count in sizes:
        if at < before + count:
            break
        before += count
    value = placed.where(F.col("part") == part).orderBy("dist").offset(max(0, at - before)).limit(1)
    return value.agg((F.max("dist").cast("double") * 1.1).alias("radius"))


def radius_max(kth: DataFrame) -> DataFrame:
    return kth.agg((F.max("dist").cast("double") * 1.1).alias("radius"))
