"""Density clusters inside groups: neighbour graph, mutual reachability, spanning forest, condensed hierarchy, outliers.

1. ``neighbour_lists``: every point is written once for each of several tables, with the signs of random projections as its code. Sorted by
   code, near points are near each other, so nearest neighbours are searched in windows of a fixed number of consecutive points. No window
   grows with a cluster or with copies of a point; recall grows with the tables.
2. ``core_distances``: how far it is to the ``neighbours``-th other row (copies of a point count as rows).
3. ``reach_edges``: an edge weighs as much as the largest of its length and its ends' core distances. Every window gives the edges of its own minimum
   spanning tree, among which the group's tree is found. A group that fits into one window needs one table, and its tree is exact.
4. Hierarchy: edges are merged in order of weight, those of one weight at once. A set that reaches ``min_size`` rows becomes a cluster; a smaller set that
   joins it falls out of it at that weight; where clusters meet, they end and a new one begins. A cluster's stability is summed as its rows
   leave it, and a cluster is chosen if it is at least as stable as the best choice below it. The root of a group is never chosen.
5. Rows get the topmost chosen cluster above the place where they fell out, or -1.

Groups with at most ``edges_per_task`` edges are merged in one task each. Larger ones are first reduced to their minimum spanning forest by
Boruvka rounds, and then merged in blocks of that many edges by weight; between blocks only what the next ones need is kept: the sets, and
the remaining edges between them. So a task never holds more than a block, whatever the group's size, and the labels are the same.

Parts of a group that no window shows together meet above all weights. Labels do not depend on the order of rows or of equal weights.
All vectors have one length; null ones are left out (no label). A group with fewer than ``min_size`` rows has outliers only.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from voxmill.operators.scale import hottest, lookup_join, materialised, salted_join, small_table

NEAREST = 1e-12
# Edges of windows' trees whose common spanning forest a task makes at a time.
EDGES_AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Density:
    """Parameters of the clustering."""

    min_size: int = 10
    neighbours: int = 10
    tables: int = 8
    window: int = 1024
    bits: int = 32
    dims: int = 64
    seed: int = 42
    edges_per_task: int = 1 << 20
    max_clusters: int | None = None


# ---------------------------------------------------------------- neighbours
def _plane(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, count))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _named(group: str) -> Column:
    """The group as a text that is never null, so that rows without one are joined like all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def points_of(df: DataFrame, group: str, vector: str, opts: Density = Density()) -> DataFrame:
    """``grp, id, weight, vec``: the different vectors of each group with their number of rows; ``id`` is a hash of the vector, ``grp`` is never null.

    Vectors longer than ``dims`` are projected to that many random directions, which keeps their distances within about 10%.
    """
    is_vector = df.schema[vector].dataType.typeName() == "vectorudt"
    values = (vector_to_array(vector) if is_vector else F.col(vector)).cast("array<double>")
    # A sparse vector travels as its own entries.
    raw = F.unwrap_udt(vector) if is_vector else F.struct(F.lit(1).alias("type"), F.lit(0).alias("size"), F.lit(None).cast("array<int>").alias("indices"), values.alias("values"))
    rows = df.where(F.col(vector).isNotNull()).select(_named(group).alias("grp"), F.xxhash64(values).alias("id"), raw.alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane: np.ndarray | None = None
        for batch in batches:
            dense, at, entries = batch.column(2), batch.column(4), batch.column(5)
            # Dense vectors tell no size.
            sizes = batch.column(3).fill_null(0).to_numpy()
            places, numbers = (c.flatten().to_numpy(zero_copy_only=False) for c in (at, entries))
            if batch.num_rows and (dense.to_numpy() == 0).all():
                size, ends = int(sizes[0]), entries.offsets.to_numpy() - entries.offsets[0].as_py()
                x = np.zeros((len(sizes), min(size, opts.dims)))
                if size > opts.dims and plane is None:
                    plane = _plane(size, opts.dims, opts.seed) / np.sqrt(opts.dims)
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    if size > opts.dims:
                        x[i] = numbers[a:b] @ plane[places[a:b]]
                    else:
                        x[i, places[a:b]] = numbers[a:b]
            else:
                x = _whole(dense.to_numpy(), sizes, at, entries)
                if x.shape[1] > opts.dims:
                    plane = _plane(x.shape[1], opts.dims, opts.seed) / np.sqrt(opts.dims) if plane is None else plane
                    x = x @ plane
            vec = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1)))
            yield pa.record_batch([*batch.columns[:2], vec], names=["grp", "id", "vec"])

    # Projected first: what is shuffled and sorted are the short vectors.
    short = rows.select("grp", "id", "raw.type", "raw.size", "raw.indices", "raw.values").mapInArrow(run, "grp string, id long, vec array<double>")
    return short.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("weight"), F.any_value("vec").alias("vec"))


def _whole(kind: np.ndarray, sizes: np.ndarray, at: pa.Array, entries: pa.Array) -> np.ndarray:
    """Vectors of both forms as a matrix."""
    if (kind != 0).all():
        return _matrix(entries)
    rows = []
    for k, size, places, numbers in zip(kind.tolist(), sizes.tolist(), at.to_pylist(), entries.to_pylist(), strict=True):
        row = np.array(numbers, dtype=np.float64)
        if k == 0:
            row = np.zeros(size)
            row[places] = numbers
        rows.append(row)
    return np.stack(rows)


def _coded(opts: Density, carried: list[str]):
    """Each point once for each table, with its code there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            centre = _matrix(batch.column("centre"))
            more = pa.array(batch.column("total").to_numpy() > opts.window)
            for t in range(opts.tables if len(x) else 0):
                signs = (x - centre) @ _plane(x.shape[1], opts.bits, opts.seed + 1 + t) > 0
                code = signs @ (1 << np.arange(opts.bits - 1, -1, -1, dtype=np.int64))
                keep = [batch.column(c) for c in carried]
                coded = pa.record_batch([pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int64()), *keep], names=["tab", "code", *carried])
                # The first table shows a group that fits into a window whole.
                yield coded.filter(more) if t else coded

    return run


@dataclass(frozen=True)
class _Seen:
    """A window: its first ``kept`` rows were in the one before, and the next one begins with its last ``stays`` rows."""

    grp: str
    x: np.ndarray
    columns: list[np.ndarray]
    kept: int
    stays: int


def _windows(batches: Iterator[pa.RecordBatch], names: list[str], window: int) -> Iterator[_Seen]:
    """The windows of sorted rows; ``names`` are the columns of numbers, each of which comes as one array."""
    key, parts, have, kept, fresh = None, [], 0, 0, 0

    def seen(stays: int) -> _Seen:
        x, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        return _Seen(key[1], x, columns, kept, stays)

    for batch in batches:
        arrays = [_matrix(batch.column("vec")), *(batch.column(c).to_numpy(zero_copy_only=False) for c in names)]
        tab, grp = batch.column("tab").to_numpy(), batch.column("grp")
        code = grp.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((tab[1:] != tab[:-1]) | (code[1:] != code[:-1])) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []):
            head = (int(tab[lo]), grp[lo].as_py())
            if head != key:
                if fresh:
                    yield seen(0)
                key, parts, have, kept, fresh = head, [], 0, 0, 0
            while lo < hi:
                if have >= window:
                    # The next window begins with the second half of this one; a new group begins empty.
                    full = seen(window // 2)
                    yield full
                    have = kept = window // 2
                    parts, fresh = [tuple(c[len(c) - kept :] for c in (full.x, *full.columns))], 0
                take = min(hi - lo, window - have)
                parts.append(tuple(c[lo : lo + take] for c in arrays))
                lo, have, fresh = lo + take, have + take, fresh + take
    if fresh:
        yield seen(0)


def _in_windows(points: DataFrame, opts: Density, search: Callable[[Iterator[_Seen]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``search`` of the windows of consecutive points in every table, with ``id`` and the other columns; windows overlap by a half.

    ``points`` has ``grp, id, vec, centre``, ``total`` as the last one, and other columns of numbers.
    """
    numbers = [c for c in points.columns if c not in ("grp", "id", "vec", "centre")]
    kinds = dict(points.dtypes)
    carried = ["grp", "id", "vec", *numbers]
    coded = points.select(*carried, "centre").mapInArrow(_coded(opts, carried), "tab int, code long, " + ", ".join(f"{c} {kinds[c]}" for c in carried))
    # A group of one window is dealt as a whole.
    whole = F.when(F.col("total") <= opts.window, F.lit(0)).otherwise(F.col("code"))
    order = ["tab", "grp", "code", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(_windows(batches, ["id", *numbers], opts.window))

    dealt = coded.withColumn("spread", F.when(F.col("total") > opts.window, F.col("id"))).withColumn("code", whole)
    return dealt.repartitionByRange("tab", "grp", "code", "spread").sortWithinPartitions(*order).drop("spread").mapInArrow(run, schema)


def _exact(x: np.ndarray, of: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Distances of the points at ``of`` to those in their row of ``near``, some rows at a time, which stay in the processor's cache."""
    out = np.empty(near.shape)
    for lo in range(0, len(of), 64):
        d = x[of[lo : lo + 64], None, :] - x[near[lo : lo + 64]]
        out[lo : lo + 64] = np.multiply(d, d, out=d).sum(axis=2)
    return np.sqrt(out, out=out)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, kept: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the nearest others and their distances: of the first ``kept`` points, if any, among the rest only, then of the rest among all."""
    square, every, rest = (x * x).sum(axis=1), np.arange(len(x)), np.arange(kept, len(x))
    product = x[kept:] @ x.T
    product *= 2

    def closest(of: np.ndarray, among: np.ndarray, rough: np.ndarray, others: int) -> tuple[np.ndarray, np.ndarray]:
        # A few more than asked for: the distances that count are computed for each pair on its own, alike in every window.
        more = min(k + 4, others)
        near = among[np.argpartition(rough, more - 1, axis=1)[:, :more]]
        exact = _exact(x, of, near)
        order = np.lexsort((ids[near], exact), axis=1)[:, : min(k, others)]
        return np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)

    found = []
    if kept:
        rough = np.array(product[:, :kept].T, order="C")
        found.append(closest(every[:kept], rest, np.subtract(square[:kept, None] + square[None, kept:], rough, out=rough), len(rest)))
    rough = np.subtract(square[kept:, None] + square[None, :], product, out=product)
    rough[rest - kept, rest] = np.inf
    found.append(closest(rest, every, rough, len(x) - 1))
    return found


_NEAR_KIND = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("weight", pa.int64())]))


def _lists(lengths: np.ndarray, d: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> pa.Array:
    items = pa.StructArray.from_arrays([pa.array(d), pa.array(ids), pa.array(weights)], names=["d", "id", "weight"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), items).cast(_NEAR_KIND)


def _search_neighbours(k: int):
    """Every row comes once in a table, as it leaves the windows, with the nearest of both that show it."""

    def search(windows: Iterator[_Seen]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[np.ndarray, ...] = ()
        for seen in windows:
            ids, weights = seen.columns[:2]
            if len(ids) > 1:
                found = [(d, ids[near], weights[near]) for near, d in _nearest(ids, seen.x, k, seen.kept)]
            else:
                found = [(np.empty((1, 0)), np.empty((1, 0), np.int64), np.empty((1, 0), np.int64))]
            if seen.kept:
                both = [np.concatenate(pair, axis=1) for pair in zip(waiting, found[0], strict=True)]
                order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                found[0] = tuple(np.take_along_axis(c, order, 1) for c in both)
            # Rows that stay are new in this window, as windows overlap by a half at most.
            gone, new = len(ids) - seen.stays, len(found[-1][0])
            waiting = tuple(c[new - seen.stays :] for c in found[-1])
            found[-1] = tuple(c[: new - seen.stays] for c in found[-1])
            lengths = np.concatenate([np.full(len(part[0]), part[0].shape[1]) for part in found])
            near = _lists(lengths, *(np.concatenate([c.reshape(-1) for c in column]) for column in zip(*found, strict=True)))
            yield pa.record_batch([pa.array([seen.grp] * gone, pa.string()), pa.array(ids[:gone]), pa.array(weights[:gone]), near], names=["grp", "id", "weight", "near"])

    return search


def _best_lists(k: int):
    """One row for each point: the ``k`` nearest of all its lists. Rows of a point follow each other."""

    def merged(batch: pa.RecordBatch, place: np.ndarray) -> pa.RecordBatch:
        """``place`` counts the points of the rows from 0."""
        near = batch.column("near")
        row = np.repeat(place, near.value_lengths().to_numpy())
        d, ids, weights = (c.to_numpy(zero_copy_only=False) for c in near.flatten().flatten())
        order = np.lexsort((weights, ids, d, row))
        row, d, ids, weights = row[order], d[order], ids[order], weights[order]
        # Tables find the same neighbours, whose distances are alike to the bit.
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]) | (d.view(np.int64)[1:] != d.view(np.int64)[:-1])
        row, d, ids, weights = row[fresh], d[fresh], ids[fresh], weights[fresh]
        count = int(place[-1]) + 1
        sizes = np.bincount(row, minlength=count)
        best = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
        firsts = batch.select(["grp", "id", "weight"]).take(pa.array(np.flatnonzero(np.diff(place, prepend=-1))))
        lists = _lists(np.minimum(sizes, k), d[best], ids[best], weights[best])
        return pa.record_batch([*firsts.columns, lists], names=["grp", "id", "weight", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            ids, code = batch.column("id").to_numpy(), batch.column("grp").dictionary_encode().indices.to_numpy()
            place = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (code[1:] != code[:-1]))])
            # The last point may go on in the next batch.
            cut = int(np.searchsorted(place, place[-1]))
            rest = batch.slice(cut)
            if cut:
                yield merged(batch.slice(0, cut), place[:cut])
        if rest is not None:
            yield merged(rest, np.zeros(rest.num_rows, dtype=np.int64))

    return run


def centred(points: DataFrame) -> DataFrame:
    """``points`` with the mean vector of their group as ``centre`` and its number of points as ``total``."""
    mean = Summarizer.mean(array_to_vector("vec"), F.col("weight").cast("double"))
    groups = points.groupBy("grp").agg(vector_to_array(mean).alias("centre"), F.count(F.lit(1)).alias("total"))
    return lookup_join(points, groups, "grp", "id")


def neighbour_lists(points: DataFrame, opts: Density = Density()) -> DataFrame:
    """``grp, id, weight, near`` of ``centred`` points: for every point its nearest others found, nearest first, ``neighbours`` at most."""
    schema = "grp string, id long, weight long, near array<struct<d: double, id: long, weight: long>>"
    found = _in_windows(points.select("grp", "id", "weight", "vec", "centre", "total"), opts, _search_neighbours(opts.neighbours), schema)
    # Sorted by the number first, which is quicker to compare.
    return found.repartition("grp", "id").sortWithinPartitions("id", "grp").mapInArrow(_best_lists(opts.neighbours), schema)


def core_distances(lists: DataFrame, opts: Density = Density()) -> DataFrame:
    """``lists`` with ``core``. With fewer rows around than ``neighbours`` it is the distance of the farthest one found."""
    k = opts.neighbours
    start = F.struct((F.col("weight") - 1).alias("rows"), F.lit(0.0).alias("d"))
    reached = F.aggregate(
        "near", start,
        lambda s, x: F.when(s["rows"] >= k, s).otherwise(F.struct((s["rows"] + x["weight"]).alias("rows"), x["d"].alias("d"))), lambda s: s["d"],
    )
    return lists.withColumn("core", reached)


def _tree(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the minimum spanning tree of a full graph."""
    n = len(weight)
    best, near = weight[0].copy(), np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    closer = np.empty(n, dtype=bool)
    best[0], outside[0] = np.inf, False
    ends = np.empty((n - 1, 2), dtype=np.int64)
    for k in range(n - 1):
        new = int(best.argmin())
        ends[k] = near[new], new
        # Points of the tree stay at infinity.
        best[new], outside[new] = np.inf, False
        row = weight[new]
        np.less(row, best, out=closer)
        np.logical_and(closer, outside, out=closer)
        np.copyto(best, row, where=closer)
        np.copyto(near, new, where=closer)
    return ends[:, 0], ends[:, 1]


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the edges a, b that are the minimum spanning forest, by Boruvka rounds; ``order`` are all places from the least edge on."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    chosen: list[np.ndarray] = []
    left, every = order, np.arange(len(names))
    while True:
        between = x != y
        x, y, left = x[between], y[between], left[between]
        if not len(left):
            return np.unique(np.concatenate(chosen)) if chosen else left
        least = np.full(len(names), len(left))
        # Of several values for one place the last one stays: the first edge of each component.
        last = np.arange(len(left))[::-1]
        least[x[::-1]] = last
        other = np.full(len(names), len(left))
        other[y[::-1]] = last
        np.minimum(least, other, out=least)
        heads = np.flatnonzero(least < len(left))
        took = least[heads]
        chosen.append(left[took])
        up = every.copy()
        up[heads] = np.where(x[took] == heads, y[took], x[took])
        # Two components that took the same edge point at each other: the smaller one is the name.
        mutual = (up[up] == every) & (every < up)
        up[mutual] = every[mutual]
        while not np.array_equal(further := up[up], up):
            up = further
        x, y = up[x], up[y]


def _search_trees(most: int):
    """The edges of windows' minimum spanning trees by mutual reachability.

    Of the edges of some windows of a group together, about ``most`` at a time, only those of their spanning forest go on: one that closes a
    circle of no larger ones is in no minimum spanning tree of the group.
    """

    def tree(seen: _Seen) -> tuple[np.ndarray, ...]:
        x, (ids, core) = seen.x, seen.columns[:2]
        square = (x * x).sum(axis=1)
        product = x @ x.T
        product *= 2
        weight = np.subtract(square[:, None] + square[None, :], product, out=product)
        np.sqrt(np.maximum(weight, 0.0, out=weight), out=weight)
        np.maximum(np.maximum(weight, core[:, None], out=weight), core[None, :], out=weight)
        p, q = _tree(weight)
        w = np.maximum(np.maximum(np.sqrt(((x[p] - x[q]) ** 2).sum(axis=1)), core[p]), core[q])
        return np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), w

    def search(windows: Iterator[_Seen]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for seen in windows:
            found.append(tree(seen))
            if not seen.stays or sum(len(a) for a, _, _ in found) >= most:
                a, b, w = (np.concatenate(c) for c in zip(*found, strict=True))
                if len(found) > 1:
                    forest = _forest(a, b, np.lexsort((b, a, w)))
                    a, b, w = a[forest], b[forest], w[forest]
                yield pa.record_batch([pa.array([seen.grp] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(w)], names=["grp", "a", "b", "w"])
                found = []

    return search


def reach_edges(points: DataFrame, lists: DataFrame, opts: Density = Density()) -> DataFrame:
    """``grp, a, b, w`` with a < b: the spanning trees of all windows.

    An edge that is not in the tree of its window is in no minimum spanning tree of the group either, so of all pairs that
    some window shows no needed one is lost.
    """
    cores = lists.select("grp", "id", "core")
    rows = points.select("grp", "id", "vec", "centre", "total").join(cores, ["grp", "id"])
    found = _in_windows(rows.select("grp", "id", "vec", "centre", "core", "total"), opts, _search_trees(EDGES_AT_ONCE), "grp string, a long, b long, w double")
    return found.groupBy("grp", "a", "b").agg(F.min("w").alias("w"))


# ---------------------------------------------------------------- spanning forest
def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of ``grp, a, b, w`` (equal weights in the order of a, b), by Boruvka rounds.

    In a round every component takes its least edge outwards, components that are joined by those find their common name by
    doubling pointers, and edges inside a component go. There are at most log2(points) rounds.
    """
    left = materialised(edges.select("grp", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    chosen: list[DataFrame] = []
    while True:
        both = left.select("grp", "a", "b", "w", F.col("ca").alias("c"), F.col("cb").alias("to"))
        both = both.unionByName(left.select("grp", "a", "b", "w", F.col("cb").alias("c"), F.col("ca").alias("to")))
        seen = Observation()
        least = both.groupBy("grp", "c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("grp", "c", "e.*")
        least = materialised(least.observe(seen, F.count(F.lit(1)).alias("n")), "least-edges")
        if not seen.get["n"]:
            break
        chosen.append(least.select("grp", "a", "b", "w"))
        # Two components that took the same edge point at each other: the smaller one is the name.
        back = least.select("grp", F.col("c").alias("to"), F.col("to").alias("_back"))
        up = least.join(back, ["grp", "to"], "left")
        mutual = (F.col("_back") == F.col("c")) & (F.col("c") < F.col("to"))
        names = materialised(up.select("grp", "c", F.when(mutual, F.col("c")).otherwise(F.col("to")).alias("to")), "names")
        while True:
            moved = Observation()
            further = names.select("grp", F.col("c").alias("to"), F.col("to").alias("_to"))
            # Only ends that are not in the table at all have no further one; those are none, as every component has an edge.
            step = names.join(further, ["grp", "to"]).select("grp", "c", F.col("_to").alias("to"), (F.col("_to") != F.col("to")).alias("moved"))
            names = materialised(step.observe(moved, F.count_if("moved").alias("n")).drop("moved"), "names")
            if not moved.get["n"]:
                break
        for end in ("ca", "cb"):
            left = left.join(names.select("grp", F.col("c").alias(end), F.col("to").alias("_to")), ["grp", end]).drop(end).withColumnRenamed("_to", end)
        left = materialised(left.where(F.col("ca") != F.col("cb")).select("grp", "a", "b", "w", "ca", "cb"), "edges")
    forest = chosen[0] if chosen else edges.select("grp", "a", "b", "w")
    for more in chosen[1:]:
        forest = forest.unionByName(more)
    return forest.distinct()


def _by_size(edges: DataFrame, opts: Density) -> tuple[DataFrame, DataFrame | None]:
    """Edges of groups that fit into a task, and those of the larger ones if there are any."""
    sizes = edges.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > opts.edges_per_task).select("grp")
    large = materialised(sizes, "large-groups")
    if not large.limit(1).count():
        return edges, None
    large, small = small_table(large)
    large = F.broadcast(large) if small else large
    return edges.join(large, "grp", "left_anti"), edges.join(large, "grp", "left_semi")


# ---------------------------------------------------------------- hierarchy
# A set of points: its rows, its members as long as they belong to no cluster, its open cluster, what rows have left that with, and the best choice below.
_SETS = "grp string, set long, rows long, members array<long>, cluster string, left_sum double, below double"
# kind: s a set, p a point (id) that falls out of a cluster, c a cluster that ends (its stability is worth choosing or not), m a set that went into another.
_OUT = f"kind string, {_SETS}, id long, parent string, chosen boolean"
_COLUMNS = [c.split(" ")[0] for c in _OUT.split(", ")]


class _Merger:
    """Merges sets along edges in order; collects what has to be told about points and clusters."""

    def __init__(self, grp: str, sets: pd.DataFrame, min_size: int) -> None:
        self.grp, self.min_size = grp, min_size
        self.out: list[tuple] = []
        self.at = {s: i for i, s in enumerate(sets["set"])}
        self.names = list(sets["set"])
        self.up = list(range(len(self.names)))
        self.rows = [int(x) for x in sets["rows"]]
        self.members = [list(m) if m is not None else [] for m in sets["members"]]
        self.cluster = [c if isinstance(c, str) else None for c in sets["cluster"]]
        self.left_sum, self.below = list(sets["left_sum"]), list(sets["below"])

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tell(self, kind: str, **values: object) -> None:
        self.out.append(tuple(map({"kind": kind, "grp": self.grp, **values}.get, _COLUMNS)))

    def end(self, i: int, birth: float, parent: str | None) -> float:
        """The cluster of a set ends; returns the best choice in it and below."""
        own = self.left_sum[i] - self.rows[i] * birth
        self.tell("c", cluster=self.cluster[i], parent=parent, chosen=own >= self.below[i])
        return max(own, self.below[i])

    def fall(self, i: int, cluster: str) -> None:
        for p in self.members[i]:
            self.tell("p", id=p, cluster=cluster)
        self.members[i] = []

    def merge(self, edges: list[tuple[int, int]], names: list[str], w: float) -> None:
        """Merge along all edges of one weight at once, so that their order does not matter."""
        joined: dict[int, list[int]] = {}
        first: dict[int, str] = {}
        for (a, b), name in zip(edges, names, strict=True):
            x, y = self.top(self.at[a]), self.top(self.at[b])
            if x == y:
                continue
            one, other = joined.pop(x, [x]), joined.pop(y, [y])
            name = min(first.pop(x, name), first.pop(y, name), name)
            x, y, one, other = (x, y, one, other) if len(one) >= len(other) else (y, x, other, one)
            self.up[y] = x
            joined[x], first[x] = one + other, name
        for head, parts in joined.items():
            self._together(head, sorted(parts, key=self.names.__getitem__), w, first[head])

    def _together(self, head: int, parts: list[int], w: float, name: str) -> None:
        least = max(w, NEAREST)
        rate = 1.0 / least
        for i in parts:
            if self.cluster[i] is not None and self.members[i]:
                # A point whose copies are enough for a cluster: it is one if its copies are nearer to each other than this weight.
                if self.left_sum[i] == self.rows[i] / least:
                    self.cluster[i], self.left_sum[i] = None, 0.0
                else:
                    self.fall(i, self.cluster[i])
        open_ones = [i for i in parts if self.cluster[i] is not None]
        small = [i for i in parts if self.cluster[i] is None]
        rows = sum(self.rows[i] for i in parts)
        cluster, left, below = None, 0.0, 0.0
        if len(open_ones) == 1:
            (i,) = open_ones
            cluster, left, below = self.cluster[i], self.left_sum[i] + sum(self.rows[k] for k in small) * rate, self.below[i]
        elif open_ones:
            cluster, left, below = name, rows * rate, sum(self.end(i, rate, name) for i in open_ones)
        elif rows >= self.min_size:
            cluster, left = name, rows * rate
        if cluster is not None:
            for i in small:
                self.fall(i, cluster)
        else:
            # The longest list takes the others in.
            keep = max(small, key=lambda i: len(self.members[i]))
            for i in small:
                if i != keep:
                    self.members[keep].extend(self.members[i])
                    self.members[i] = []
            self.members[head], self.members[keep] = self.members[keep], self.members[head]
        self.rows[head], self.cluster[head], self.left_sum[head], self.below[head] = rows, cluster, left, below

    def result(self) -> pd.DataFrame:
        for i, name in enumerate(self.names):
            t = self.top(i)
            if t == i:
                self.tell(
                    "s", set=name, rows=self.rows[i], members=self.members[i], cluster=self.cluster[i],
                    left_sum=float(self.left_sum[i]), below=float(self.below[i]),
                )
            else:
                self.tell("m", set=name, id=self.names[t])
        # Objects, as numbers beside missing values would become floats.
        return pd.DataFrame(self.out, columns=_COLUMNS, dtype=object)


def _merge_block(min_size: int):
    def run(edges: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        merger = _Merger(sets["grp"].iloc[0], sets, min_size)
        order = np.lexsort((edges["b"], edges["a"], edges["w"]))
        # In the order of weights; edges that close a circle merge nothing.
        forest = np.zeros(len(edges), dtype=bool)
        forest[_forest(edges["ca"].to_numpy(), edges["cb"].to_numpy(), order)] = True
        edges = edges.iloc[order[forest[order]]]
        weights = edges["w"].to_numpy()
        ends = list(zip(edges["ca"].tolist(), edges["cb"].tolist(), strict=True))
        names = [f"{a}:{b}" for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True)]
        starts = [0, *(np.flatnonzero(weights[1:] != weights[:-1]) + 1).tolist(), len(weights)] if len(weights) else []
        for lo, hi in zip(starts, starts[1:], strict=False):
            merger.merge(ends[lo:hi], names[lo:hi], float(weights[lo]))
        return merger.result()

    return run


def _in_blocks(edges: DataFrame, opts: Density) -> DataFrame:
    """Edges with their block in the order of weights: ``edges_per_task`` of a group each, and those of equal weight together."""
    ranged = materialised(edges.repartitionByRange("grp", "w").withColumn("part", F.spark_partition_id()), "ranged-edges")
    # One row for each group and partition.
    counts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("grp", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.rank().over(Window.partitionBy("grp", "part").orderBy("w")) - 1
    numbered = ranged.withColumn("inside", inside).join(counts, ["grp", "part"])
    return numbered.select("grp", "a", "b", "w", F.floor((F.col("before") + F.col("inside")) / F.lit(opts.edges_per_task)).cast("long").alias("block"))


def hierarchy(lists: DataFrame, edges: DataFrame, opts: Density = Density()) -> DataFrame:
    """``grp, id, cluster``: the cluster a point gets, or null for an outlier. ``lists`` come from ``core_distances``, ``edges`` from ``reach_edges``."""
    few, many = _by_size(edges, opts)
    plan = few.select("grp", "a", "b", "w", F.lit(0).cast("long").alias("block"))
    rounds = 1
    if many is not None:
        plan = materialised(plan.unionByName(_in_blocks(spanning_forest(many), opts)), "blocks")
        rounds = plan.agg(F.max("block")).first()[0] + 1
    plan = plan.select("grp", "a", "b", "w", "block", F.col("a").alias("ca"), F.col("b").alias("cb"))
    heavy = F.col("weight") >= opts.min_size
    name = F.when(heavy, F.concat(F.lit("point:"), F.col("id").cast("string")))
    sets = lists.select(
        "grp", F.col("id").alias("set"), F.col("weight").alias("rows"), F.array("id").alias("members"), name.alias("cluster"),
        F.when(heavy, F.col("weight") / F.greatest(F.col("core"), F.lit(NEAREST))).otherwise(0.0).alias("left_sum"), F.lit(0.0).alias("below"),
    )
    falls: list[DataFrame] = []
    ends: list[DataFrame] = []
    merge = _merge_block(opts.min_size)
    for block in range(rounds):
        now = plan.where(F.col("block") == block).select("grp", "a", "b", "w", "ca", "cb")
        touched, rest = sets, None
        if rounds > 1:
            used = now.select("grp", F.explode(F.array("ca", "cb")).alias("set")).distinct()
            touched, rest = sets.join(used, ["grp", "set"], "left_semi"), sets.join(used, ["grp", "set"], "left_anti")
        solved = now.groupBy("grp").cogroup(touched.groupBy("grp")).applyInPandas(merge, _OUT)
        solved = materialised(solved, "merged", partition_by=["kind"])
        of = lambda kind: solved.where(F.col("kind") == kind)  # noqa: B023, E731
        falls.append(of("p").select("grp", "id", "cluster"))
        ends.append(of("c").select("grp", "cluster", "parent", "chosen"))
        sets = of("s").select(*[c.split(" ")[0] for c in _SETS.split(", ")])
        if rest is not None:
            sets = materialised(rest.unionByName(sets), "sets")
        if block + 1 < rounds:
            later = plan.where(F.col("block") > block)
            for end in ("ca", "cb"):
                gone = of("m").select("grp", F.col("set").alias(end), F.col("id").alias("_to"))
                later = later.join(gone, ["grp", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
            plan = materialised(later, "later-edges")
    # What is still open is a root. It is not chosen, unless the group falls apart into several.
    roots = sets.where(F.col("cluster").isNotNull())
    falls.append(roots.select("grp", F.explode("members").alias("id"), "cluster"))
    roots = roots.withColumn("roots", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    several = (F.col("roots") > 1) & (F.col("left_sum") >= F.col("below"))
    ends.append(roots.select("grp", "cluster", F.lit(None).cast("string").alias("parent"), several.alias("chosen")))
    return lists.select("grp", "id").join(_topmost(_union(falls), _union(ends)), ["grp", "id"], "left").select("grp", "id", "cluster")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _topmost(falls: DataFrame, clusters: DataFrame) -> DataFrame:
    """``grp, id, cluster``: for every point the topmost chosen cluster from the one it fell out of upwards, by doubling pointers."""
    best = F.when(F.col("chosen"), F.col("cluster"))
    known = materialised(clusters.select("grp", "cluster", F.col("parent").alias("up"), best.alias("best")), "clusters")
    while known.where(F.col("up").isNotNull()).limit(1).count():
        above = known.select("grp", F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        step = known.join(above, ["grp", "up"], "left")
        known = materialised(step.select("grp", "cluster", F.col("_up").alias("up"), F.coalesce("_best", "best").alias("best")), "clusters")
    return falls.join(known, ["grp", "cluster"], "left").select("grp", "id", F.col("best").alias("cluster"))


# ---------------------------------------------------------------- rows
def density_labels(points: DataFrame, opts: Density = Density()) -> DataFrame:
    """``grp, id, label`` of ``points`` (from ``points_of``): 0 for the largest cluster of a group, and so on; -1 for outliers.

    With ``max_clusters`` the rows of the smaller clusters beyond them count as outliers, which ``merge_small`` gives to the nearest kept one.
    """
    points = materialised(centred(points), "points")
    lists = materialised(core_distances(neighbour_lists(points, opts), opts), "neighbours")
    placed = materialised(hierarchy(lists, materialised(reach_edges(points, lists, opts), "reach-edges"), opts), "placed")
    weights = lists.select("grp", "id", "weight")
    counted = placed.where(F.col("cluster").isNotNull()).join(weights, ["grp", "id"]).groupBy("grp", "cluster")
    sizes = counted.agg(F.sum("weight").alias("n"), F.min("id").alias("first"))
    rank: Column = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "first")) - 1
    ranked = sizes.select("grp", "cluster", rank.cast("int").alias("label"))
    if opts.max_clusters is not None:
        ranked = ranked.where(F.col("label") < opts.max_clusters)
    return placed.join(ranked, ["grp", "cluster"], "left").select("grp", "id", F.coalesce("label", F.lit(-1)).alias("label"))


def density_cluster(
    df: DataFrame, group: str, id_col: str, vector: str = "features", out: str = "cluster", opts: Density = Density()
) -> DataFrame:
    """``df`` with the label of each row's vector inside its group; null without a vector. Copies of a hot vector are spread by ``id_col``."""
    is_vector = df.schema[vector].dataType.typeName() == "vectorudt"
    values = (vector_to_array(vector) if is_vector else F.col(vector)).cast("array<double>")
    # Written before they are centred, which reads them twice.
    points = materialised(points_of(df, group, vector, opts), "distinct-points")
    labels = density_labels(points, opts)

    def key(grp: Column, point: Column) -> Column:
        return F.concat_ws(":", point.cast("string"), grp)

    keyed = df.drop(out).withColumn("_key", F.when(F.col(vector).isNotNull(), key(_named(group), F.xxhash64(values))))
    unique = labels.select(key(F.col("grp"), F.col("id")).alias("_key"), F.col("label").alias(out))
    # Points know how many rows they stand for, so no key is counted again.
    hot = hottest(points.select(key(F.col("grp"), F.col("id")).alias("_key"), F.col("weight").alias("count")), "_key")
    return salted_join(keyed, unique, "_key", id_col, hot=hot).drop("_key")
