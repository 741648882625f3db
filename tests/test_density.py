"""Density clusters against a plain top-down restatement, in one block and in many."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from voxmill.operators import density, themes
from voxmill.operators.density import NEAREST, Density


def cloud(seed=0, dims=6, sizes=(60, 45, 30, 12), noise=40, spread=0.06):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal(dims) + spread * (1 + k) * rng.standard_normal((n, dims)) for k, n in enumerate(sizes)]
    return np.concatenate([*parts, 2.5 * rng.standard_normal((noise, dims))])


def plain_lists(x, k):
    """Exact neighbours of the different points, with their rows."""
    points, rows = np.unique(x, axis=0, return_counts=True)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    near = []
    for i in range(len(points)):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][:k]
        near.append([(d[i, j], j) for j in order])
    return points, rows, near


def plain_clusters(x, opts):
    """Sets of row numbers, one for each cluster: split from the largest weight downwards, then choose."""
    points, rows, near = plain_lists(x, opts.neighbours)
    core = []
    for i, found in enumerate(near):
        have, d = rows[i] - 1, 0.0
        for dist, j in found:
            if have >= opts.neighbours:
                break
            have, d = have + rows[j], dist
        core.append(d)
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    edges = {(a, b): max(distance[a, b], core[a], core[b]) for a, b in itertools.combinations(range(len(points)), 2)}
    order = sorted((w, a, b) for (a, b), w in edges.items())
    up = list(range(len(points)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    tree = []
    for w, a, b in order:
        if top(a) != top(b):
            up[top(a)] = top(b)
            tree.append((w, a, b))

    def parts(members, links):
        group = {i: i for i in members}

        def head(i):
            while group[i] != i:
                i = group[i]
            return i

        for _, a, b in links:
            group[head(a)] = head(b)
        out = defaultdict(set)
        for i in members:
            out[head(i)].add(i)
        return list(out.values())

    size = lambda members: int(sum(rows[i] for i in members))
    rate = lambda w: 1 / max(w, NEAREST)

    def big_ones(two, w):
        """Parts that are a cluster below weight w; copies of one point are only if they are nearer to each other."""
        return [p for p in two if size(p) >= opts.min_size and (len(p) > 1 or core[next(iter(p))] < w)]

    def best(members, links, birth):
        """The best choice in a cluster that begins with these members: (worth, [members of the chosen ones], those without itself)."""
        born, left, below = set(members), 0.0, []
        while links:
            w = links[-1][0]
            rest = [e for e in links if e[0] < w]
            big = big_ones(parts(members, rest), w)
            if len(big) != 1:
                left += size(members) * rate(w)
                below = [best(p, [e for e in rest if e[1] in p], rate(w)) for p in big]
                break
            left += (size(members) - size(big[0])) * rate(w)
            members, links = big[0], [e for e in rest if e[1] in big[0]]
        else:
            left += size(members) * rate(core[next(iter(members))])
        own, worth = left - size(born) * birth, sum(b[0] for b in below)
        inner = [c for b in below for c in b[1]]
        return (own, [born], inner) if own >= worth else (worth, inner, inner)

    roots = [p for p in parts(set(range(len(points))), tree) if size(p) >= opts.min_size]
    done = [best(p, [e for e in tree if e[1] in p], 0.0) for p in roots]
    found = done[0][2] if len(roots) == 1 else [c for b in done for c in b[1]]
    place = {p.tobytes(): i for i, p in enumerate(points)}
    of = [place[v.tobytes()] for v in x]
    return {frozenset(r for r, i in enumerate(of) if i in c) for c in found}


def table(spark, groups):
    rows = [(g, n, [float(v) for v in vec]) for g, x in groups.items() for n, vec in enumerate(x)]
    return spark.createDataFrame(rows, "grp string, n long, vec array<double>").repartition(5)


def clusters(labelled):
    out = defaultdict(set)
    for r in labelled:
        if r.c >= 0:
            out[r.grp, r.c].add(r.n)
    by_group = defaultdict(set)
    for (g, _), members in out.items():
        by_group[g].add(frozenset(members))
    return by_group


@pytest.mark.parametrize("opts", [Density(), Density(edges_per_task=70), Density(min_size=5, neighbours=4, edges_per_task=2000)])
def test_labels_equal_a_plain_restatement(spark, opts):
    copies = cloud(2, sizes=(50, 30))
    groups = {
        "a": cloud(0), "b": cloud(1, sizes=(80, 80, 9), noise=20), None: np.concatenate([copies, copies[:15], copies[:8], np.repeat(copies[60:61], 14, 0)]),
        "one": cloud(3)[:1], "few": cloud(4)[:6], "far": np.concatenate([cloud(5, sizes=(30,), noise=0), 100 + cloud(6, sizes=(25,), noise=0)]),
    }
    got = density.density_cluster(table(spark, groups), "grp", "n", "vec", "c", opts).collect()
    found = clusters(got)
    for g, x in groups.items():
        assert found.get(g, set()) == plain_clusters(x, opts), g
    assert sum(len(c) for c in found.values()) >= 7
    for g in groups:
        sizes = Counter(r.c for r in got if r.grp == g and r.c >= 0)
        assert [sizes[c] for c in range(len(sizes))] == sorted(sizes.values(), reverse=True)


def test_spanning_forest_is_minimal(spark):
    rng = np.random.default_rng(4)
    edges = {(int(min(p)), int(max(p))): float(rng.integers(0, 30)) for p in rng.integers(0, 200, (500, 2)) if p[0] != p[1]}
    rows = [(g, a, b, w) for g in "xy" for (a, b), w in edges.items() if g == "x" or (a + b) % 3]
    got = defaultdict(set)
    table = spark.createDataFrame(rows, "grp string, a long, b long, w double")
    for r in density.spanning_forest(table).collect():
        got[r.grp].add((r.w, r.a, r.b))
    for g in "xy":
        up = {}

        def top(i):
            while up.get(i, i) != i:
                i = up[i]
            return i

        want = set()
        for w, a, b in sorted((w, a, b) for h, a, b, w in rows if h == g):
            if top(a) != top(b):
                up[top(a)] = top(b)
                want.add((w, a, b))
        assert got[g] == want


def test_recall_of_the_neighbour_graph(spark):
    """Groups many times larger than a window; one of them holds most points."""
    x = cloud(7, dims=16, sizes=(2500, 1500, 700, 300), noise=1000, spread=0.2)
    opts = Density(window=512)
    points = density.centred(density.points_of(table(spark, {"a": x, "b": cloud(8, dims=16)}), "grp", "vec", opts))
    lists = {r.id: {n.id for n in r.near} for r in density.neighbour_lists(points, opts).collect() if r.grp == "=a"}
    ids = {np.array(r.vec).tobytes(): r.id for r in points.collect() if r.grp == "=a"}
    names = np.array([ids[v.tobytes()] for v in x])
    square = (x * x).sum(axis=1)
    d = square[:, None] + square[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    exact = np.argpartition(d, opts.neighbours, axis=1)[:, : opts.neighbours]
    hits = [len(lists[names[i]] & set(names[exact[i]].tolist())) / opts.neighbours for i in range(len(x))]
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_long_vectors_are_projected_and_odd_rows_kept(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3, 300))
    rows = [("g", i, [float(v) for v in centres[i % 3] + 0.05 * rng.standard_normal(300)]) for i in range(120)] + [("g", 999, None)]
    df = spark.createDataFrame(rows, "grp string, n long, vec array<double>")
    got = density.density_cluster(df, "grp", "n", "vec", "c").collect()
    assert len(got) == 121
    assert {r.n for r in got if r.c is None} == {999}
    assert clusters([r for r in got if r.c is not None])["g"] == {frozenset(range(k, 120, 3)) for k in range(3)}
    assert density.density_cluster(df.limit(0), "grp", "n", "vec", "c").count() == 0


def test_outliers_and_surplus_clusters_go_to_the_nearest_kept_one(spark):
    groups = {"a": cloud(0), "b": cloud(1, dims=6, sizes=(3,), noise=2)}
    opts = Density(max_clusters=2)
    labelled = density.density_cluster(table(spark, groups), "grp", "n", "vec", "c", opts)
    assert {r.c for r in labelled.where("grp = 'a'").collect()} == {-1, 0, 1}
    labelled = labelled.withColumn("vec", array_to_vector("vec"))
    merged = {(r.grp, r.n): (r.c, r.cluster) for r in themes.merge_small(labelled, "grp", "n", "c", "vec", 5).collect()}
    x = groups["a"]
    kept = {c: [n for (g, n), (label, _) in merged.items() if g == "a" and label == c] for c in (0, 1)}
    centre = np.stack([x[kept[c]].mean(axis=0) / np.linalg.norm(x[kept[c]].mean(axis=0)) for c in (0, 1)])
    for (g, n), (label, cluster) in merged.items():
        assert cluster == (0 if g == "b" else label if label >= 0 else int((centre @ x[n]).argmax()))


def test_empty_table_gives_an_empty_result(spark):
    df = spark.createDataFrame([], "grp string, n long, vec array<double>")
    assert density.density_cluster(df, "grp", "n", "vec", "c").withColumn("x", F.lit(1)).count() == 0


def test_sparse_vectors_travel_as_their_entries(spark, monkeypatch):
    """Points of sparse, dense and plain vectors are the same, and points know how often the keys of the final join occur."""
    from pyspark.ml.linalg import Vectors

    from voxmill.operators import scale

    rng = np.random.default_rng(4)
    rows = [{int(k): float(rng.random()) for k in rng.choice(200, 5, replace=False)} for _ in range(30)] + [{}, {}]
    full = [[r.get(k, 0.0) for k in range(200)] for r in rows]
    kinds = {
        "sparse": [Vectors.sparse(200, r) for r in rows],
        "dense": [Vectors.dense(v) for v in full],
        "mixed": [Vectors.sparse(200, r) if i % 2 else Vectors.dense(v) for i, (r, v) in enumerate(zip(rows, full, strict=True))],
        "plain": full,
    }
    frames = {name: spark.createDataFrame([("g", i, v) for i, v in enumerate(vs)], ["grp", "id", "vec"]).coalesce(1) for name, vs in kinds.items()}
    got = {name: {r.id: (r.weight, r.vec) for r in density.points_of(df, "grp", "vec").collect()} for name, df in frames.items()}
    for name, points in got.items():
        assert points.keys() == got["plain"].keys(), name
        assert all(points[k][0] == w and np.allclose(points[k][1], v, atol=1e-12) for k, (w, v) in got["plain"].items())
    assert sorted(w for w, _ in got["sparse"].values()) == [1] * 30 + [2]

    def counted_again(*_):
        raise AssertionError("keys are counted in another pass over the rows")

    monkeypatch.setattr(scale, "hot_keys", counted_again)
    assert density.density_cluster(frames["sparse"], "grp", "id", "vec", "label").count() == 32


def in_windows(x, ids, columns, window, sizes=(7, 50)):
    """What ``_windows`` makes of one group, whose rows come in batches of changing sizes."""
    kinds = pa.list_(pa.float64())
    rows = pa.record_batch(
        [pa.array([0] * len(x), pa.int32()), pa.array(["=g"] * len(x)), pa.array(x.tolist(), kinds), pa.array(ids), *map(pa.array, columns)],
        names=["tab", "grp", "vec", "id", *(f"c{i}" for i in range(len(columns)))],
    )
    cuts = [0, *itertools.takewhile(lambda n: n < len(x), itertools.accumulate(itertools.cycle(sizes))), len(x)]
    batches = [rows.slice(a, b - a) for a, b in itertools.pairwise(cuts)]
    return density._windows(iter(batches), rows.schema.names[3:], window)


@pytest.mark.parametrize(("n", "window"), [(1, 8), (90, 128), (128, 128), (129, 128), (300, 64), (301, 65), (40, 5)])
def test_a_row_leaves_its_windows_once_with_the_nearest_of_all_of_them(n, window):
    rng = np.random.default_rng(n)
    x, ids, weights = rng.standard_normal((n, 5)), rng.permutation(n).astype(np.int64), rng.integers(1, 4, n)
    step = window - window // 2
    starts = [0, *range(step, n - window // 2, step)] if n > window else [0]
    want = defaultdict(set)
    for s in starts:
        for i, j in itertools.permutations(range(s, min(s + window, n)), 2):
            want[ids[i]].add((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), int(ids[j]), int(weights[j])))
    out = list(density._search_neighbours(6)(in_windows(x, ids, [weights], window)))
    got = [(r["id"], r["weight"], [tuple(v.values()) for v in r["near"]]) for batch in out for r in batch.to_pylist()]
    assert [g[:2] for g in got] == list(zip(ids.tolist(), weights.tolist(), strict=True))
    assert all(near == sorted(want[i])[:6] for i, _, near in got)
    core = rng.random(n)
    edges = {(a, b): w for batch in density._search_trees(200)(in_windows(x, ids, [core], window)) for a, b, w in zip(*(batch.column(c).to_pylist() for c in "abw"), strict=True)}
    place = {int(i): k for k, i in enumerate(ids)}
    shown = {(a, b): max(d, core[place[a]], core[place[b]]) for a in place for d, b, _ in want[a] if a < b}
    order = sorted(shown, key=lambda e: (shown[e], e))
    up = list(range(n))
    least = 0.0
    for a, b in order:
        p, q = place[a], place[b]
        while up[p] != p:
            p = up[p]
        while up[q] != q:
            q = up[q]
        if p != q:
            up[p] = q
            least += shown[a, b]
            assert shown[a, b] <= max(edges.values())
    assert all(shown[e] == pytest.approx(w) for e, w in edges.items())
    forest = density._forest(*(np.array(c, dtype=np.int64) for c in zip(*edges, strict=True)), np.argsort(list(edges.values()), kind="stable")) if edges else []
    assert len(forest) == n - 1 and sum(list(edges.values())[k] for k in forest) == pytest.approx(least)


def test_windows_of_a_table_give_one_tree_and_lists_are_merged_without_comparing_all_pairs(spark):
    x = cloud(9, sizes=(300, 200), noise=100)
    opts = Density(tables=1, window=64)
    points = density.centred(density.points_of(table(spark, {"a": x}), "grp", "vec", opts))
    lists = density.neighbour_lists(points, opts)
    assert "array_distinct" not in lists._jdf.queryExecution().optimizedPlan().toString()
    # Each overlapping window has a tree of its own; of those, one table needs no more edges than a tree has.
    assert density.reach_edges(points, density.core_distances(lists, opts), opts).count() <= len(x) - 1
