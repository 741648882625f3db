"""MinHash near-dedup with sequential Bayesian verification.

1. One scan takes every whole text to the set of its word shingles (64-bit hashes), a fingerprint of the set and a MinHash
   signature. Texts with equal sets form a class; from here on only one representative of each class takes part.
2. Signatures are cut into bands. Representatives that agree in a band are candidates; with 32 bands of 5, a pair at
   similarity 0.8 agrees in none with a chance of 3e-6. In each bucket all members are compared with one hub, its smallest id.
3. Candidates are verified in sequence: after every 32 values of the signatures the posterior probability that the
   similarity reaches the threshold is bounded (uniform prior), and the pair is dropped once it is below ``MISS``.
   What survives is decided exactly on full sets.
4. What these links connect is a component. Buckets that still hold several components get the rest of their comparisons. Members
   of light components (up to ``LIGHT``) are compared by bucket, in blocks inside tasks, by the same sequential test; members of
   smaller components against a heavy one are tried on all of its members, in blocks of both sides, until a first link is
   found. Pairs inside a component need no comparison, so a large group of near copies costs about one comparison a
   member, plus a whole pass over the group for each member without any link. No link between components is left out.
5. Components of all links, handed back to every document through the fingerprint of its set.

Empty and null texts have no shingles: they are their own component and kept. A text with fewer words than a shingle has its
whole sequence as the only one. A null doc_id has a null component and is kept. Repeated rows share their component; all rows
with its smallest doc_id are kept. Other columns pass through ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm import bloom
from voxmill.llm.arrow_text import Piece, bound_batches, mix, pieces, rolling, whole_windows, word_hashes
from voxmill.llm.components import components
from voxmill.operators.scale import materialised

BANDS = 32
ROWS = 5
HASHES = BANDS * ROWS
STEP = 32
MISS = 1e-6
# Rows of a side that a task compares at once: signatures only, and with full sets.
LIGHT_BLOCK = 64
BLOCK = 64
# Components of up to this many representatives are compared by bucket, larger ones as a whole.
LIGHT = 64
PARTS = 1024

_FACTORS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(p: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the bounds of the rows."""
    words, n = word_hashes(p), np.diff(p.bounds)
    at = np.flatnonzero(whole_windows(p.bounds, size, len(words)))
    found = [rolling(words, size)[at]] if len(at) else []
    rows = [np.searchsorted(p.bounds, at, side="right") - 1] if len(at) else []
    for short in range(1, size):
        own = np.flatnonzero(n == short)
        if len(own):
            found.append(mix(rolling(words, short)[p.bounds[own]] + np.uint64(short)))
            rows.append(own)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(p.rows + 1, dtype=np.int64)
    values, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(p.rows + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each; rows without shingles have zeros."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), dtype=np.uint16)
    if len(full):
        short = (values >> np.uint64(32)).astype(np.uint32)
        step = 1 << 16
        # Rows in groups that stay in the processor's cache.
        edges = [0]
        for i in range(len(full)):
            if bounds[full[i] + 1] - bounds[full[edges[-1]]] > step and i > edges[-1]:
                edges.append(i)
        for a, b in zip(edges, [*edges[1:], len(full)], strict=True):
            lo, hi = bounds[full[a]], bounds[full[b - 1] + 1]
            part, starts = short[lo:hi], bounds[full[a:b]] - lo
            for k in range(HASHES):
                least = np.minimum.reduceat(part * _FACTORS[k] + _SHIFTS[k], starts)
                out[full[a:b], k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def least_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """Matches needed after each step: below, P(similarity >= threshold | matches) < ``miss`` under a uniform prior.

    The posterior is a beta distribution, whose tail is that of a binomial one with n + 1 trials.
    """
    needed = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        needed.append(m)
    return needed


def survives(left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which pairs of signatures are left after all steps; later steps only see what earlier ones left."""
    at, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for i, least in enumerate(needed):
        own = slice(i * STEP, (i + 1) * STEP)
        matches[at] += (left[at, own] == right[at, own]).sum(axis=1)
        at = at[matches[at] >= least]
        if not len(at):
            break
    alive = np.zeros(len(left), dtype=bool)
    alive[at] = True
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets: 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """``id, print, n, sig`` from ``_id, _text``; texts without shingles have no fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(1), lower=True):
                values, bounds = shingle_sets(p, size)
                sig, cuts = signatures(values, bounds), list(zip(bounds[:-1], bounds[1:], strict=True))
                prints = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in cuts]
                yield pa.record_batch(
                    [batch.column(0).slice(p.first, p.rows), pa.array(prints, pa.binary()), pa.array(np.diff(bounds), pa.int64()),
                     pa.array([s.tobytes() if x else None for s, x in zip(sig, prints, strict=True)], pa.binary())],
                    names=["id", "print", "n", "sig"],
                )

    return docs.mapInArrow(run, "id long, print binary, n long, sig binary")


def _sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """``id, shingles`` of the wanted ids (and of a few more, which a filter of fixed size lets pass)."""
    table = docs.sparkSession.sparkContext.broadcast(bloom.ids_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.has(table.value, bloom.id_hash(batch.column(0)))))
            for p in pieces(batch.column(1), lower=True):
                values, bounds = shingle_sets(p, size)
                sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(p.first, p.rows), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.where(F.col("_id").isNotNull()).mapInArrow(run, "id long, shingles binary")


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    cut = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(cut.shape[:2], dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + cut[:, :, r])
    return key


def _buckets(reps: DataFrame) -> DataFrame:
    """``bucket, id``: one row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16))
            yield pa.record_batch(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "id"]
            )

    return reps.select("id", "sig").mapInArrow(run, "bucket long, id long")


def _pruned(pairs: DataFrame, reps: DataFrame, needed: list[int]) -> DataFrame:
    """Pairs ``a, b`` whose signatures leave the threshold possible."""
    sig = reps.select("id", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b").join(sig.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(survives(left, right, needed)))

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that the full sets confirm.

    The members of a hub come to it in up to ``PARTS`` groups; the hub's set is sent once for each group, not once for each pair.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    members = pairs.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles")
    hubs = pairs.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a")
    return members.unionByName(hubs.select("a", "part", F.lit(None).cast("long").alias("b"), "shingles"))


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(shingles.as_buffer(), dtype=np.uint64)
                if b is None:
                    hub, own = a, values
                elif a == hub and linked(own, values, percent):
                    out.append((a, b))
            if out:
                yield _pair_batch(out)
            own = own.copy()

    return rows.select("a", "b", "shingles").mapInArrow(run, "a long, b long")


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["a", "b"])


def _first_labels(links: DataFrame) -> DataFrame:
    """``id, component, members``: two steps towards the smallest id of a component, enough to know what belongs together already."""
    ends = links.select(F.col("b").alias("id"), "a").unionByName(links.select(F.col("a").alias("id"), "a"))
    up = materialised(ends.groupBy("id").agg(F.min("a").alias("a")), "first-step")
    labels = up.join(up.select(F.col("id").alias("a"), F.col("a").alias("component")), "a").select("id", "component")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return materialised(labels.join(sizes, "component").select("id", "component", "members"), "first-labels")


def _mixed(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components. Ids outside all links are components of their own."""
    rows = crowded.join(labels, "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"), F.coalesce("members", F.lit(1)).cast("long").alias("members")
    )
    rows = materialised(rows, "labelled-buckets")
    rank = F.struct("members", "component")
    tops = rows.groupBy("bucket").agg(F.max(rank).alias("top"), F.min(rank).alias("low"), F.count_if(F.col("members") <= LIGHT).alias("light"))
    tops = materialised(tops.where("top <> low").select("bucket", "top", "light"), "mixed-buckets")
    return materialised(rows.join(tops, "bucket"), "mixed-rows")


def _light_pairs(mixed: DataFrame, reps: DataFrame, needed: list[int]) -> DataFrame:
    """Pairs between light components of a bucket that their signatures leave possible.

    Buckets are compared inside tasks, in blocks of at most about ``LIGHT_BLOCK`` rows a side; no pair leaves a task before it has
    passed the sequential test. A pair is tested in the bucket of the first band that it shares only.
    """
    rows = mixed.where((F.col("members") <= LIGHT) & (F.col("light") > 1)).join(reps.select("id", "sig"), "id")
    blocks = F.ceil(F.col("light") / F.lit(LIGHT_BLOCK)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "component", "sig")
    rows = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, *row in zip(keys, *(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                if key != group:
                    out += _possible(held, group, needed)
                    group, held = key, []
                held.append(row)
            if out:
                yield _pair_batch(out)
        if out := _possible(held, group, needed):
            yield _pair_batch(out)

    return rows.mapInArrow(run, "a long, b long")


def _possible(rows: list, key: tuple | None, needed: list[int]) -> list[tuple[int, int]]:
    """Pairs of different components in one block pair that survive the sequential test."""
    if len(rows) < 2:
        return []
    own, ids, parts = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    sigs = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint16).reshape(-1, HASHES)
    bands = band_keys(sigs)
    here = int(np.flatnonzero((bands == np.uint64(key[0] % (1 << 64))).all(axis=0))[0])
    out = []
    for i in range(len(rows) - 1):
        at = np.arange(i + 1, len(rows))
        at = at[(parts[at] != parts[i]) & ((own[at] != own[i]) | (key[1] == key[2]))]
        at = at[~(bands[at, :here] == bands[i, :here]).any(axis=1)]
        at = at[survives(np.broadcast_to(sigs[i], (len(at), HASHES)), sigs[at], needed)]
        out += [(min(int(ids[i]), j), max(int(ids[i]), j)) for j in ids[at].tolist()]
    return out


def _heavy_probes(mixed: DataFrame) -> DataFrame:
    """``id, component, members``: each id once for every heavy component, larger than its own, with which it shares a bucket."""
    rank = F.struct("members", "component")
    heavy = mixed.where(F.col("members") > LIGHT).select("bucket", rank.alias("target")).distinct()
    heavy = materialised(heavy, "heavy-components")
    smaller = mixed.where(rank < F.col("top")).select("bucket", "id", rank.alias("own"))
    probes = smaller.join(heavy, "bucket").where(F.col("own") < F.col("target"))
    return probes.select("id", F.col("target.component").alias("component"), F.col("target.members").alias("members")).distinct()


def _heavy_links(probes: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, needed: list[int]) -> DataFrame:
    """A link from each probe into each heavy component that has one: all members are tried, in blocks of both sides."""
    aims = probes.groupBy("component").agg(F.count(F.lit(1)).alias("probes"), F.max("members").alias("members"))
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    aims = materialised(aims.select("component", blocks_of("probes").alias("pb"), blocks_of("members").alias("mb")), "aims")
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = labels.join(aims, "component").select("id", "component", hashed("mb").alias("m"), every("pb").alias("p"), F.lit(False).alias("probe"))
    q = probes.join(aims, "component").select("id", "component", hashed("pb").alias("p"), every("mb").alias("m"), F.lit(True).alias("probe"))
    full = m.unionByName(q).join(sets.join(reps.select("id", "sig"), "id"), "id")
    full = full.repartition("component", "m", "p").sortWithinPartitions("component", "m", "p", "probe", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sigs, sets, table = None, [], [], [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, i, probe, sig, shingles in zip(keys, *(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                if key != group:
                    group, ids, sigs, sets, table = key, [], [], [], None
                own, values = np.frombuffer(sig, dtype=np.uint16), np.frombuffer(shingles, dtype=np.uint64)
                if not probe:
                    ids.append(i)
                    sigs.append(own)
                    sets.append(values)
                    continue
                if not ids:
                    continue
                table = np.stack(sigs) if table is None else table
                alive = np.flatnonzero(survives(table, np.broadcast_to(own, table.shape), needed))
                # The likeliest first; one link joins the whole component.
                for k in alive[np.argsort(-(table[alive] == own).sum(axis=1), kind="stable")]:
                    if linked(sets[k], values, percent):
                        out.append((ids[k], i))
                        break
            if out:
                yield _pair_batch(out)

    return full.select("component", "m", "p", "id", "probe", "sig", "shingles").mapInArrow(run, "a long, b long")


def _all_links(crowded: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that connect whatever is connected among the members of crowded buckets."""
    needed = least_matches(percent / 100)
    star = crowded.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    star = materialised(_pruned(star, reps, needed), "candidates")
    ends = lambda df: df.select(F.col("a").alias("id")).unionByName(df.select(F.col("b").alias("id")))
    sets = materialised(_sets(texts, size, ends(star)), "sets")
    links = materialised(_confirm(_verified(star, sets), percent), "verified")
    labels = _first_labels(links)
    mixed = _mixed(crowded.select("bucket", "id"), labels)
    light = materialised(_light_pairs(mixed, reps, needed), "light-pairs")
    probes = materialised(_heavy_probes(mixed), "heavy-probes")
    # The sets of heavy components are there already; those of probes and light pairs may not be.
    later = ends(light).unionByName(probes.select("id")).join(sets.select("id"), "id", "left_anti")
    sets = sets.unionByName(materialised(_sets(texts, size, later).join(sets.select("id"), "id", "left_anti"), "later-sets"))
    more = _confirm(_verified(light, sets), percent).unionByName(_heavy_links(probes, labels, reps, sets, percent, needed))
    return links.unionByName(materialised(more, "more-links"))


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketched = materialised(_sketched(texts, size), "sketches")
    usable = sketched.where(F.col("print").isNotNull() & F.col("id").isNotNull())
    reps = usable.groupBy("print").agg(F.min(F.struct("id", "sig")).alias("r")).select("print", "r.id", "r.sig")
    reps = materialised(reps, "representatives")
    buckets = _buckets(reps)
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a")
    crowded = materialised(buckets.join(materialised(hubs, "hubs"), "bucket"), "crowded-buckets")
    found = components(_all_links(crowded, reps, texts, size, percent))
    labels = reps.select("print", "id").join(found, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    labels = materialised(labels, "labels")
    out = sketched.select("id", "print", F.col("n").alias("n_shingles")).join(labels, "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component."""
    copies = near_copies(docs, size, percent, id_col, text_col).where(F.col("component_id") < F.col(id_col))
    gone = materialised(copies.select(F.col(id_col).cast("long").alias("__vx_gone")).distinct(), "near-copies")
    return docs.join(gone, F.col(id_col) == F.col("__vx_gone"), "left_anti")
