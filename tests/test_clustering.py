"""Against plain NumPy, and the invariants of the blueprint's test strategy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import distance
from tessella.operators import aggregate, assign, compact, refine, seeding
from tessella.plans.compute import compute
from tessella.sources import points as P


def noise(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d))


def jittered(n, d, k):
    r = np.random.default_rng(1)
    label = np.concatenate([np.arange(k), r.integers(0, k, n - k)])
    x = noise(n, d)
    x[:, 0] += 100 * label
    start = np.zeros((k, d))
    start[:, 0] = 100 * np.arange(k)
    return x, label, start


def duplicates(n, d, k):
    r = np.random.default_rng(2)
    x = noise(k, d)
    label = np.concatenate([np.arange(k), r.integers(0, k, n - k)])
    return x[label], label


def labels_of(df):
    return np.array([r["cid"] for r in sorted(df.collect(), key=lambda r: r["obs_id"])])


def d2(x, c):
    return ((x[:, None, :] - c[None]) ** 2).sum(2)


def slow_lloyd(x, c, limit):
    label, status, it = np.zeros(len(x), int), 2, 0
    size = np.zeros(len(c), int)
    for it in range(1, limit + 1):
        new = d2(x, c).argmin(1)
        if it > 1 and (new == label).all():
            status = 0
            break
        label = new
        size = np.bincount(label, minlength=len(c))
        c = np.array([x[label == j].mean(0) if size[j] else np.zeros(x.shape[1]) for j in range(len(c))])
    return label, c, size, it, status


@pytest.mark.parametrize(("d", "k"), [(3, 4), (40, 9)])
def test_nearest_forms_agree(spark, d, k):
    x, c = noise(120, d), noise(k, d, 5)
    p = P.from_matrix(spark, x).repartition(3)
    want = d2(x, c)
    assert (labels_of(assign.nearest(p, c)) == want.argmin(1)).all()
    assert (labels_of(assign.nearest_join(p, P.centers_frame(spark, c))) == want.argmin(1)).all()
    two = sorted(assign.two_nearest(p, c).collect())
    assert ([[r["best"], r["second"]] for r in two] == want.argsort(1)[:, :2]).all()
    far = sorted(assign.nearest(p, c, True).collect())
    assert np.allclose([r["distance"] for r in far], np.sqrt(want.min(1)))
    distance.register(spark)
    p.createOrReplaceTempView("p")
    lists = ", ".join("array(" + ", ".join(f"{v!r}D" for v in row.tolist()) + ")" for row in c)
    assert (labels_of(spark.sql(f"SELECT obs_id, nearest_center(x, array({lists})) AS cid FROM p")) == want.argmin(1)).all()


def test_ties_go_to_the_smallest_cid(spark):
    p = P.from_matrix(spark, np.zeros((4, 2)))
    for c in (np.ones((3, 2)), np.ones((300, 2))):
        assert labels_of(assign.nearest(p, c)).tolist() == [0] * 4
        assert {(r["best"], r["second"]) for r in assign.two_nearest(p, c).collect()} == {(0, 1)}


def test_scans_and_checks(spark):
    x = noise(20, 3)
    p = P.from_matrix(spark, x).repartition(4)
    assert P.validate(p) == (20, 3) and P.count(p) == 20 and P.dimensions(p) == 3
    assert P.observation(p, 7).first()["x"] == x[7].tolist()
    assert sorted(r["obs_id"] for r in P.consecutive(p, 5, 4).collect()) == [5, 6, 7, 8]
    assert sorted(r["obs_id"] for r in P.indexed(p, spark.createDataFrame([(3,), (9,), (3,)], "obs_id long")).collect()) == [3, 9]
    assert (P.gather(p, [9, 2, 2]) == x[[9, 2, 2]]).all()
    for bad in ([(0, [1.0, None])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (0, [1.0])], [(0, [float("nan")])], [(1, [1.0])], [(0, None)]):
        with pytest.raises(ValueError):
            P.validate(spark.createDataFrame(bad, "obs_id long, x array<double>"))
    ids = P.dense_ids(spark.range(50).select((F.col("id") * 37 % 50).alias("v")), "v").collect()
    assert all(r["obs_id"] == r["v"] for r in ids) and len(ids) == 50


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_aggregates(spark, parts):
    x = noise(90, 5)
    label = np.arange(90) % 7
    label[label == 3] = 2
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))]
    df = spark.createDataFrame(rows, "obs_id long, cid int, x array<double>").repartition(parts)
    sizes, means = aggregate.centroids(df, 7, 5)
    assert (sizes == np.bincount(label, minlength=7)).all() and (means[3] == 0).all()
    assert np.allclose(means[4], x[label == 4].mean(0))
    assert (aggregate.sizes(df, 7) == sizes).all()
    assert np.allclose(aggregate.global_centroid(df, 5), x.mean(0))
    ss = aggregate.wcss(df.select("obs_id", "x"), df.select("obs_id", "cid"), means)
    assert np.allclose(ss, [((x[label == j] - means[j]) ** 2).sum() for j in range(7)])
    m = aggregate.moments(df, 5)
    assert np.allclose(m[2][2], ((x[label == 2] - x[label == 2].mean(0)) ** 2).sum(0))


@pytest.mark.parametrize(("d", "n", "k"), [(10, 200, 5), (30, 300, 10), (2, 50, 20)])
def test_lloyd(spark, d, n, k):
    x, c = noise(n, d), noise(k, d, 9) * 3
    want = slow_lloyd(x, c, 10)
    for parts in (1, 5):
        got = refine.Lloyd().run(P.from_matrix(spark, x).repartition(parts), n, d, c)
        assert (labels_of(got.clusters) == want[0]).all() and np.allclose(got.centers, want[1], atol=1e-9)
        assert (got.details.sizes == want[2]).all() and (got.details.iterations, got.details.status) == want[3:]


@pytest.mark.parametrize("kind", [refine.Lloyd(), refine.HartiganWong(), refine.MiniBatch(max_iterations=25, batch_size=60)])
def test_recovers_separated_clusters(spark, kind):
    x, label, start = jittered(150, 4, 5)
    got = kind.run(P.from_matrix(spark, x), 150, 4, start)
    assert (labels_of(got.clusters) == label).all() and (got.details.sizes == np.bincount(label)).all()
    assert np.allclose(got.centers, [x[label == j].mean(0) for j in range(5)])


def test_hartigan_wong_is_locally_optimal(spark):
    for seed, k in ((0, 2), (1, 5), (2, 8)):
        x = noise(200, 3, seed)
        got = refine.HartiganWong(max_iterations=100).run(P.from_matrix(spark, x), 200, 3, x[:k])
        assert got.details.status == 0
        label, size = labels_of(got.clusters), got.details.sizes
        cost = d2(x, got.centers)
        for i in range(200):
            a = label[i]
            if size[a] > 1 and k > 2:
                loss = cost[i, a] * size[a] / (size[a] - 1)
                assert all(cost[i, b] * size[b] / (size[b] + 1) >= loss - 1e-9 for b in range(k) if b != a)
    far = np.vstack([x[:3], np.full((1, 3), 1e3)])  # an empty cluster gets a member
    assert refine.HartiganWong().run(P.from_matrix(spark, x), 200, 3, far).details.sizes.min() > 0


def test_limits(spark):
    x = noise(50, 4)
    p = P.from_matrix(spark, x)
    assert refine.HartiganWong(max_iterations=0).run(p, 50, 4, x[:3]).details.status == 2
    assert refine.HartiganWong(max_quick_transfer_iterations=0, quit_on_quick_transfer_convergence_failure=True).run(p, 50, 4, x[:3]).details.status == 4
    none = refine.Lloyd(max_iterations=0).run(p, 50, 4, x[:3])
    assert none.details.status == 2 and not none.details.sizes.any() and (none.centers == x[:3]).all()
    with pytest.raises(ValueError):
        refine.HartiganWong(max_rows=10).run(p, 50, 4, x[:3])
    with pytest.raises(ValueError):
        refine.MiniBatch(convergence_history=0).run(p, 50, 4, x[:3])


def test_mini_batch_window(spark):
    x, label, start = jittered(60, 2, 3)
    p = P.from_matrix(spark, x)
    got = refine.MiniBatch(batch_size=60, convergence_history=2, max_iterations=20).run(p, 60, 2, start)
    assert (got.details.status, got.details.iterations) == (2, 20) or got.details.status == 0
    lone = np.vstack([start, [[1e6, 1e6]]])  # a cluster that no batch meets blocks convergence
    assert refine.MiniBatch(batch_size=60, convergence_history=2, max_iterations=5).run(p, 60, 2, lone).details.status == 2


def test_edge_cases(spark):
    x = noise(10, 3)
    p = P.from_matrix(spark, x)
    for kind in ("lloyd", "hartigan-wong", "mini-batch"):
        one = compute(p, "random", kind, 1)
        assert np.allclose(one.centers[0], x.mean(0)) and one.details.sizes.tolist() == [10]
        many = compute(p, "random", kind, 20)
        assert labels_of(many.clusters).tolist() == list(range(10)) and many.details.sizes.tolist() == [1] * 10 + [0] * 10 and many.centers.shape == (20, 3)
        none = compute(p, "random", kind, 0)
        assert len(none.details.sizes) == 0 and none.details.status == 0


def test_random_seeding(spark):
    x = noise(40, 3)
    p = P.from_matrix(spark, x)
    a, b, c = (seeding.Random(s).run(p.repartition(m), 40, 3, 5) for s, m in ((1, 2), (1, 7), (2, 2)))
    assert (a == b).all() and not (a == c).all() and (seeding.Random().run(p, 40, 3, 50) == x).all()


def test_kmeans_plus_plus(spark, monkeypatch):
    x, label = duplicates(80, 3, 6)
    p = P.from_matrix(spark, x)
    plain = seeding.KmeansPlusPlus(seed=4)
    got = plain.run(p, 80, 3, 8)
    assert len(got) == 6 and len({tuple(v) for v in got}) == 6
    narrow = seeding.KmeansPlusPlus(seed=4, rewrite=2, FAN=3)
    assert (narrow.run(p.repartition(5), 80, 3, 8) == got).all()
    u, w = seeding.draws(4, 8), np.ones(80)
    chosen = []
    for r in range(6):
        chosen.append(int(np.searchsorted(np.cumsum(w), u[r] * w.sum())))
        w = d2(x, x[chosen]).min(1)
    assert (x[chosen] == got).all()


@pytest.mark.parametrize("rows", [1 << 18, 17])
def test_optimal_boundary(spark, rows):
    for seed, digits in ((0, 5), (1, 0)):
        v = np.sort(np.round(np.random.default_rng(seed).normal(size=130) * 3, digits))
        ss = [np.var(v[:i]) * i + np.var(v[i:]) * (len(v) - i) for i in range(1, len(v))]
        i = int(np.argmin(np.round(ss, 9))) + 1
        got = seeding.optimal_boundary(spark.createDataFrame([(float(t),) for t in v], "v double").repartition(3), len(v), rows)
        assert got == pytest.approx(v[i - 1] + (v[i] - v[i - 1]) / 2)


def slow_partition(x, k, adjust, optimal):
    label = np.zeros(len(x), int)
    for new in range(1, k):
        ss = [((x[label == c] - x[label == c].mean(0)) ** 2).sum(0) for c in range(new)]
        worth = [s.sum() / (label == c).sum() ** (1 - adjust) for c, s in enumerate(ss)]
        top = max(range(new), key=lambda c: (worth[c], c))
        if worth[top] <= 0:
            break
        j = int(ss[top].argmax())
        v = np.sort(x[label == top, j])
        cut = v.mean()
        if optimal:
            costs = [np.var(v[:i]) * i + np.var(v[i:]) * (len(v) - i) for i in range(1, len(v))]
            i = int(np.argmin(costs)) + 1
            cut = v[i - 1] + (v[i] - v[i - 1]) / 2
        label[(label == top) & (x[:, j] >= cut)] = new
    return np.array([x[label == c].mean(0) for c in range(label.max() + 1)])


@pytest.mark.parametrize(("adjust", "optimal"), [(1.0, True), (1.0, False), (0.3, True)])
def test_variance_partition(spark, adjust, optimal):
    x = noise(150, 4)
    got = seeding.VariancePartition(adjust, optimal).run(P.from_matrix(spark, x).repartition(3), 150, 4, 5)
    assert np.allclose(got, slow_partition(x, 5, adjust, optimal))
    same, label = duplicates(60, 3, 4)
    assert len(seeding.VariancePartition().run(P.from_matrix(spark, same), 60, 3, 9)) == 4


def test_compaction(spark):
    clusters = spark.createDataFrame([(i, (i % 3) * 2) for i in range(12)], "obs_id long, cid int")
    centers, sizes = np.arange(14.0).reshape(7, 2), np.array([4, 0, 4, 0, 4, 0, 0])
    out, c, s, used = compact.remove_unused_centers(clusters, centers, sizes)
    assert labels_of(out).tolist() == [i % 3 for i in range(12)] and used == 3
    assert s.tolist() == [4, 4, 4, 0, 0, 0, 0] and c[:3].tolist() == centers[[0, 2, 4]].tolist() and not c[3:].any()
    assert compact.remove_unused_centers(clusters, centers[:1], np.array([12]))[3] == 1


@pytest.mark.parametrize("seed_kind", ["random", "kmeans++", "variance-partition"])
def test_all_pipelines(spark, seed_kind, tmp_path):
    x = noise(60, 3) / 1000 + (np.arange(60) % 4)[:, None]
    p = P.from_matrix(spark, x)
    for kind in (refine.Lloyd(), refine.HartiganWong(), refine.MiniBatch(max_iterations=12)):
        got = compute(p, seed_kind, kind, 4)
        label = labels_of(got.clusters)
        assert (np.bincount(label, minlength=4) == got.details.sizes).all() and got.details.iterations > 0
        assert np.allclose(got.wcss(), [((x[label == j] - got.centers[j]) ** 2).sum() for j in range(4)], atol=1e-9)
        if seed_kind != "random":
            assert len({tuple(label[np.arange(60) % 4 == j]) for j in range(4)}) == 4 and got.wcss().sum() < 1
    got.save(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "centers")).count() == 4


def plain_hartigan_wong(x, centers, limit=10, quick=50):
    """The published algorithm (AS 136) with its arrays LIVE, NCP and ITRAN, one observation and one number at a time: labels, iterations, status."""
    n, k = len(x), len(centers)
    order = [sorted(range(k), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centers[c])), c)) for p in x]
    first, second = [o[0] for o in order], [o[1] for o in order]
    size = [first.count(c) for c in range(k)]
    mean = lambda: [[sum(x[i][j] for i in range(n) if first[i] == c) / max(size[c], 1) for j in range(len(x[0]))] for c in range(k)]
    center = mean()
    far = lambda i, c: sum((a - b) ** 2 for a, b in zip(x[i], center[c]))
    up, down = lambda c: size[c] / (size[c] + 1), lambda c: size[c] / (size[c] - 1) if size[c] > 1 else float("inf")

    def move(i, a, b):
        center[a] = [(v * size[a] - p) / (size[a] - 1) for v, p in zip(center[a], x[i])]
        center[b] = [(v * size[b] + p) / (size[b] + 1) for v, p in zip(center[b], x[i])]
        size[a], size[b], first[i], second[i] = size[a] - 1, size[b] + 1, b, a

    loss, live, step_of, moved, quiet = [0.0] * n, [0] * k, [-1] * k, [True] * k, 0
    for iteration in range(1, limit + 1):
        live = [n + 1 if moved[c] else live[c] for c in range(k)]
        for i in range(n):
            at, quiet = i + 1, quiet + 1
            a = first[i]
            if size[a] > 1:
                if step_of[a] != 0:
                    loss[i] = far(i, a) * down(a)
                best = before = second[i]
                least = far(i, best) * up(best)
                for c in range(k):
                    if c in (a, before) or (at >= live[a] and at >= live[c]):
                        continue
                    if far(i, c) * up(c) < least:
                        best, least = c, far(i, c) * up(c)
                if least >= loss[i]:
                    second[i] = best
                else:
                    quiet, live[a], live[best], step_of[a], step_of[best] = 0, n + at, n + at, at, at
                    move(i, a, best)
            if quiet == n:
                return first, iteration, 0
        moved, live = [False] * k, [v - n for v in live]
        still, step, done = 0, 0, False
        while not done and step < quick * n:
            i = step % n
            step, still = step + 1, still + 1
            a, b = first[i], second[i]
            if size[a] > 1:
                if step <= step_of[a]:
                    loss[i] = far(i, a) * down(a)
                if (step < step_of[a] or step < step_of[b]) and far(i, b) * up(b) < loss[i]:
                    still = quiet = 0
                    moved[a] = moved[b] = True
                    step_of[a] = step_of[b] = step + n
                    move(i, a, b)
            done = still == n
        center = mean()
        if done and k == 2:
            return first, iteration, 0
        step_of = [0] * k
    return first, limit, 2


@pytest.mark.parametrize("k", [2, 5, 10])
def test_hartigan_wong_matches_a_plain_version(k):
    """On overlapping data: labels, iterations and status."""
    ends = set()
    for seed in range(12):
        x = noise(120, 3, 50 + seed)
        order = np.argsort(d2(x, x[:k]), axis=1, kind="stable")
        for limit in (1, 2, 3, 30):
            got = refine.hartigan_wong(x, order[:, 0], order[:, 1], k, limit, 50, False)
            want = plain_hartigan_wong(x.tolist(), x[:k].tolist(), limit)
            assert (got[0].tolist(), got[1], got[2]) == want, (seed, limit)
            ends.add(got[2])
    assert ends == ({0} if k == 2 else {0, 2})


def test_boundary_of_many_equal_values(spark):
    """A million rows of which half are one value, cut by ranges."""
    v = F.when(F.col("id") % 2 == 0, 0.25).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0 + F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.0))
    values = spark.range(1_000_000).select(v.alias("v"))
    x = np.sort(values.toPandas()["v"].to_numpy())
    n = np.arange(1, len(x))
    s, s2 = np.cumsum(x), np.cumsum(x * x)
    ss = s2[:-1] - s[:-1] ** 2 / n + (s2[-1] - s2[:-1]) - (s[-1] - s[:-1]) ** 2 / (len(x) - n)
    i = int(np.where(np.diff(x) > 0, ss, np.inf).argmin())
    assert seeding.optimal_boundary(values, 1_000_000, 1 << 15) == pytest.approx((x[i] + x[i + 1]) / 2, abs=1e-9)
