"""Lloyd's iterations of many k-means fits at once: groups and restarts share the jobs, so these are as many as the longest fit has iterations.

Points are kept as blocks of plain numbers, each of one group, so an iteration is one pass of matrix products over them. Every task sums up
the points of each centre, the sums of a fit are combined before they leave the executors, and the driver gets one row of them per fit. Fits that have
settled leave the iteration. The rule is that of ``pyspark.ml``: the nearest centre, the first one of equally near ones; a centre without points stays;
a fit ends when no centre moves farther than ``TOL``, and its cost is that of the last iteration. Sums differ in their last bits only.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tolerance of ``pyspark.ml``'s k-means.
TOL = 1e-4
# Numbers in a block, and points that a task goes through in an iteration at the most, and at the least while cores are idle.
BLOCK_ENTRIES = 1 << 16
POINTS_PER_TASK = 20_000
LEAST_POINTS = 2_000
# Centres of the fits that iterate together, in bytes.
FIT_BYTES = 1 << 24

# Centres of a group's fits by number of the restart.
Fits = dict[int, np.ndarray]
# Where the entries of each vector begin, and where the last ones end; their positions, or none for whole vectors; their values.
Block = tuple[np.ndarray, np.ndarray | None, np.ndarray]


def _blocks(groups: pa.Array, raw: pa.StructArray) -> Iterator[tuple[Hashable, np.ndarray, Block]]:
    """Group, rows and block of the vectors of a batch, which are unwrapped ML vectors of both forms."""
    kind, _, indices, values = raw.flatten()
    names = groups.dictionary_encode()
    whole = kind.to_numpy(zero_copy_only=False) == 1
    code = names.indices.to_numpy(zero_copy_only=False) * 2 + whole
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype("int64")
    order = np.argsort(code, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if not len(same):
            continue
        for rows in np.array_split(same, min(len(same), 1 + int(lengths[same].sum()) // BLOCK_ENTRIES)):
            taken = pa.array(rows)
            places = None if whole[rows[0]] else indices.take(taken).flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(lengths[rows])])
            block = offsets, places, values.take(taken).flatten().to_numpy(zero_copy_only=False)
            yield names.dictionary[names.indices[rows[0]].as_py()].as_py(), rows, block


def _products(block: Block, centres: np.ndarray) -> np.ndarray:
    """Dot product of every vector with every centre; a sparse vector costs its own entries only."""
    offsets, places, values = block
    n = len(offsets) - 1
    if places is None:
        return values.reshape(n, -1) @ centres.T
    out = np.zeros((n, len(centres)))
    filled = offsets[1:] > offsets[:-1]
    if filled.any():
        for j, centre in enumerate(centres):
            out[filled, j] = np.add.reduceat(values * centre[places], offsets[:-1][filled])
    return out


def _squares(block: Block) -> np.ndarray:
    """Squared length of every vector."""
    sums = np.concatenate([[0.0], np.cumsum(block[2] ** 2)])
    return sums[block[0][1:]] - sums[block[0][:-1]]


def _gaps(block: Block, centres: np.ndarray) -> np.ndarray:
    """Squared distance to every centre, less the vector's own square, which is the same for all of them."""
    return (centres**2).sum(axis=1) - 2 * _products(block, centres)


def _totals(block: Block, near: np.ndarray, weights: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Weighted sum of the vectors nearest to each centre."""
    offsets, places, values = block
    n, (k, size) = len(near), shape
    if places is None:
        chosen = np.zeros((k, n))
        chosen[near, np.arange(n)] = weights
        return chosen @ values.reshape(n, size)
    lengths = np.diff(offsets)
    at = np.repeat(near, lengths) * size + places
    return np.bincount(at, values * np.repeat(weights, lengths), k * size).reshape(k, size)


def _summed(fits: Broadcast):
    """Per fit: the sums and weights of the points nearest to each centre, and their cost; one row per task and fit."""

    def run(blocks: Iterator) -> Iterator:
        sums: dict = {}
        for group, weights, squares, block in blocks:
            of_group = fits.value.get(group)
            if not of_group:
                continue
            gaps = _gaps(block, np.concatenate(list(of_group.values())))
            ends = np.cumsum([len(c) for c in of_group.values()])
            for (attempt, centres), own in zip(of_group.items(), np.split(gaps, ends[:-1], axis=1)):
                near = own.argmin(axis=1)
                cost = (weights * np.maximum(squares + own[np.arange(len(near)), near], 0)).sum()
                found = _totals(block, near, weights, centres.shape), np.bincount(near, weights, len(centres)), cost
                sums[group, attempt] = _added(sums[group, attempt], found) if (group, attempt) in sums else found
        yield from sums.items()

    return run


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _stored(points: DataFrame, group: str, vector: str) -> RDD:
    """``group, weights, squared lengths, block`` of the points, dealt so that a task has neighbouring groups, and any group many tasks."""
    n = points.count()
    tasks = max(1, -(-n // POINTS_PER_TASK), min(points.sparkSession.sparkContext.defaultParallelism, n // LEAST_POINTS))
    dealt = points.repartitionByRange(tasks, group, "_h").sortWithinPartitions(group)
    dealt = dealt.select(F.col(group).alias("grp"), F.unwrap_udt(vector).alias("raw"), "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            for name, rows, (offsets, places, values) in _blocks(batch.column("grp"), batch.column("raw")):
                numbers = [weights[rows], offsets.astype("int64"), None if places is None else places.astype("int32"), values.astype("float64")]
                packed = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in numbers]
                yield pa.RecordBatch.from_arrays([pa.array([name], batch.column("grp").type), *packed], ["grp", "weights", "offsets", "places", "vals"])

    kind = points.schema[group].dataType.simpleString()
    blocks = dealt.mapInArrow(run, f"grp {kind}, weights binary, offsets binary, places binary, vals binary")

    def opened(r) -> tuple:
        places = None if r.places is None else np.frombuffer(r.places, "int32")
        block = np.frombuffer(r.offsets, "int64"), places, np.frombuffer(r.vals, "float64")
        return r.grp, np.frombuffer(r.weights, "float64"), _squares(block), block

    return blocks.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)


def _settle(points: DataFrame, group: str, vector: str, starts: Mapping[Hashable, Fits], most: int) -> dict[Hashable, np.ndarray]:
    blocks = _stored(points.where(F.col(group).isin(list(starts))), group, vector)
    sc = blocks.context
    centres = {(name, attempt): c for name, fits in starts.items() for attempt, c in fits.items()}
    costs = dict.fromkeys(centres, 0.0)
    moving = set(centres)
    for _ in range(most):
        if not moving:
            break
        fits: dict[Hashable, Fits] = {}
        for name, attempt in sorted(moving):
            fits.setdefault(name, {})[attempt] = centres[name, attempt]
        sent = sc.broadcast(fits)
        slices = min(len(moving), sc.defaultParallelism, blocks.getNumPartitions())
        for fit, (sums, weights, cost) in blocks.mapPartitions(_summed(sent)).reduceByKey(_added, slices).collect():
            old, held = centres[fit], weights > 0
            new = np.where(held[:, None], sums / np.where(held, weights, 1)[:, None], old)
            if (((new - old) ** 2).sum(axis=1) <= TOL * TOL).all():
                moving.discard(fit)
            centres[fit], costs[fit] = new, cost
        sent.destroy()
    blocks.unpersist()
    best = {name: min(fits, key=lambda attempt: costs[name, attempt]) for name, fits in starts.items()}
    return {name: centres[name, attempt] for name, attempt in best.items()}


def settle(points: DataFrame, group: str, vector: str, starts: Mapping[Hashable, Fits], most: int) -> dict[Hashable, np.ndarray]:
    """Centres of the cheapest fit of each group after at most ``most`` iterations from the given first centres.

    ``points`` have ``group``, an ML vector, ``weight`` and the vector's hash ``_h``. Groups come in turns whose centres take up to
    ``FIT_BYTES`` together.
    """
    done: dict[Hashable, np.ndarray] = {}
    turn: dict[Hashable, Fits] = {}
    size = 0
    for name, fits in starts.items():
        own = sum(c.nbytes for c in fits.values())
        if turn and size + own > FIT_BYTES:
            done |= _settle(points, group, vector, turn, most)
            turn, size = {}, 0
        turn[name], size = fits, size + own
    return done | _settle(points, group, vector, turn, most) if turn else done


def nearest(df: DataFrame, group: str, vector: str, centres: Mapping[Hashable, np.ndarray]) -> Column:
    """Number of the nearest centre of a row's group; 0 in groups without centres."""
    if not centres:
        return F.lit(0)
    sent = df.sparkSession.sparkContext.broadcast(dict(centres))

    @F.arrow_udf("int")
    def place(groups: pa.Array, raw: pa.Array) -> pa.Array:
        out = np.zeros(len(groups), dtype="int32")
        for name, rows, block in _blocks(groups, raw):
            if name in sent.value:
                out[rows] = _gaps(block, sent.value[name]).argmin(axis=1)
        return pa.array(out)

    return place(F.col(group), F.unwrap_udt(vector))
