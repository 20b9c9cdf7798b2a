"""DuckDB SQL for the clustering queries, from the Parquet views alone."""

from __future__ import annotations

from tessella.operators.refine import MiniBatch
from tessella.operators.seeding import KmeansPlusPlus, Random, draws
from tessella.plans.queries import STARTS, K

POINTS = "points AS MATERIALIZED (SELECT vec_id AS obs_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
JITTERED = "points AS MATERIALIZED (SELECT vec_id AS obs_id, label, list_concat([CAST(embedding[1] AS DOUBLE) + 100.0 * label], list_transform(embedding[2:], lambda v: CAST(v AS DOUBLE))) AS x FROM embeddings)"
FIRST = f"c0 AS (SELECT CAST(obs_id AS INTEGER) AS cid, x AS c FROM points WHERE obs_id < {K})"


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def labels(name: str, centers: str, source: str = "points") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT obs_id, x, cid FROM (SELECT p.obs_id, p.x, c.cid, row_number() OVER (PARTITION BY p.obs_id ORDER BY {d2('p.x', 'c.c')}, c.cid) AS r "
        f"FROM {source} p CROSS JOIN {centers} c) WHERE r = 1)"
    )


def means(name: str, assigned: str, every: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT k.cid, coalesce(m.c, list_transform(k.c, lambda v: CAST(0 AS DOUBLE))) AS c FROM {every} k LEFT JOIN "
        f"(SELECT cid, list(v ORDER BY j) AS c FROM (SELECT cid, j, avg(v) AS v FROM (SELECT cid, unnest(x) AS v, unnest(range(len(x))) AS j FROM {assigned}) GROUP BY cid, j) GROUP BY cid) m ON k.cid = m.cid)"
    )


def summary(assigned: str, centers: str, digits: int = 6) -> str:
    return (
        f"SELECT c.cid, count(a.obs_id) AS size, round(coalesce(sum({d2('a.x', 'c.c')}), 0.0), {digits}) + 0.0 AS wcss "
        f"FROM {centers} c LEFT JOIN {assigned} a ON a.cid = c.cid GROUP BY c.cid"
    )


def lloyd(passes: int) -> str:
    return ", ".join(f"{labels(f'a{i}', f'c{i - 1}')}, {means(f'c{i}', f'a{i}', 'c0')}" for i in range(1, passes + 1))


def details(name: str, passes: int) -> str:
    """When the labels a1, a2, ... last changed: iterations and status of the passes, with the sizes of the last labels."""
    moved = " UNION ALL ".join(f"SELECT {i} AS i WHERE NOT EXISTS (SELECT 1 FROM a{i} n JOIN a{i - 1} o USING (obs_id) WHERE n.cid <> o.cid)" for i in range(2, passes + 1))
    return (
        f"SELECT '{name}' AS name, coalesce((SELECT min(i) FROM ({moved})), {passes}) AS iterations, CASE WHEN EXISTS ({moved}) THEN 0 ELSE 2 END AS status, c.cid, count(a.obs_id) AS size "
        f"FROM c0 c LEFT JOIN a{passes} a ON a.cid = c.cid GROUP BY c.cid"
    )


def long_form(centers: str) -> str:
    return f"SELECT cid, CAST(unnest(range(len(c))) AS INTEGER) AS dim, round(unnest(c), 6) + 0.0 AS value FROM {centers}"


def varpart(optimal: bool, k: int = 3) -> str:
    parts = ["l0 AS (SELECT obs_id, x, 0 AS cid FROM points)"]
    for s in range(k - 1):
        parts.append(f"s{s} AS MATERIALIZED (SELECT cid, j, var_pop(v) * count(*) AS ss, avg(v) AS mean FROM (SELECT cid, unnest(x) AS v, unnest(range(len(x))) AS j FROM l{s}) GROUP BY cid, j)")
        parts.append(f"t{s} AS (SELECT cid FROM s{s} GROUP BY cid ORDER BY sum(ss) DESC, cid DESC LIMIT 1)")
        parts.append(f"w{s} AS MATERIALIZED (SELECT cid, j, mean FROM s{s} WHERE cid = (SELECT cid FROM t{s}) ORDER BY ss DESC, j LIMIT 1)")
        if optimal:
            parts.append(f"v{s} AS (SELECT l.obs_id, l.x[w.j + 1] AS v FROM l{s} l JOIN w{s} w ON l.cid = w.cid)")
            parts.append(f"b{s} AS MATERIALIZED ({cut(f'v{s}')})")
        else:
            parts.append(f"b{s} AS MATERIALIZED (SELECT mean AS boundary FROM w{s})")
        parts.append(f"l{s + 1} AS MATERIALIZED (SELECT l.obs_id, l.x, CASE WHEN l.cid = w.cid AND l.x[w.j + 1] >= b.boundary THEN {s + 1} ELSE l.cid END AS cid FROM l{s} l, w{s} w, b{s} b)")
    every = f"k AS (SELECT DISTINCT cid, (SELECT any_value(x) FROM points) AS c FROM l{k - 1})"
    return f"WITH {POINTS}, {', '.join(parts)}, {every}, {means('m', f'l{k - 1}', 'k')} {long_form('m')}"


def cut(source: str) -> str:
    up, down = "ORDER BY v, obs_id ROWS UNBOUNDED PRECEDING", "ORDER BY v DESC, obs_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return (
        f"SELECT v + (after - v) / 2 AS boundary FROM (SELECT v, obs_id, var_pop(v) OVER ({up}) * count(*) OVER ({up}) + var_pop(v) OVER ({down}) * count(*) OVER ({down}) AS ss, "
        f"lead(v) OVER (ORDER BY v, obs_id) AS after FROM {source}) WHERE after IS NOT NULL ORDER BY ss, v, obs_id LIMIT 1"
    )


def kmeanspp(k: int, seed: int = KmeansPlusPlus().seed) -> str:
    u = draws(seed, k)
    parts = [f"g0 AS MATERIALIZED (SELECT 0 AS cid, obs_id, x AS c FROM points WHERE obs_id = (SELECT least(count(*) - 1, greatest(0, CAST(ceil({u[0]!r} * count(*)) AS BIGINT) - 1)) FROM points))"]
    for r in range(1, k):
        parts.append(f"m{r} AS MATERIALIZED (SELECT p.obs_id, p.x, min({d2('p.x', 'g.c')}) AS w FROM points p CROSS JOIN g{r - 1} g GROUP BY p.obs_id, p.x)")
        parts.append(f"q{r} AS (SELECT obs_id, x, w, sum(w) OVER (ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER () AS total FROM m{r})")
        parts.append(f"g{r} AS MATERIALIZED (SELECT * FROM g{r - 1} UNION ALL (SELECT {r}, obs_id, x FROM q{r} WHERE w > 0 AND run >= {u[r]!r} * total ORDER BY obs_id LIMIT 1))")
    return f"WITH {POINTS}, {', '.join(parts)} {long_form(f'g{k - 1}')}"


def minibatch_steps(passes: int = 2, batch: int = 60) -> str:
    parts = [FIRST, "n0 AS (SELECT cid, 0 AS n FROM c0)"]
    for i in range(passes):
        parts.append(f"b{i} AS MATERIALIZED (SELECT * FROM points ORDER BY md5('{MiniBatch().seed}:{i}:' || obs_id) LIMIT {batch})")
        parts.append(labels(f"s{i}", f"c{i}", f"b{i}"))
        parts.append(f"n{i + 1} AS MATERIALIZED (SELECT k.cid, k.n + count(s.obs_id) AS n FROM n{i} k LEFT JOIN s{i} s ON s.cid = k.cid GROUP BY k.cid, k.n)")
        parts.append(f"u{i} AS (SELECT cid, j, sum(v) AS total, count(*) AS m FROM (SELECT cid, unnest(x) AS v, unnest(range(len(x))) AS j FROM s{i}) GROUP BY cid, j)")
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT e.cid, list(CASE WHEN u.m IS NULL THEN e.v ELSE (e.v * n.n + u.total) / (n.n + u.m) END ORDER BY e.j) AS c "
            f"FROM (SELECT cid, unnest(c) AS v, unnest(range(len(c))) AS j FROM c{i}) e JOIN n{i} n ON n.cid = e.cid LEFT JOIN u{i} u ON u.cid = e.cid AND u.j = e.j GROUP BY e.cid)"
        )
    return f"WITH {POINTS}, {', '.join(parts)}, {labels('a', f'c{passes}')}, {means('c', 'a', 'c0')} {summary('a', 'c')}"


def oracle_sql() -> dict[str, str]:
    lines = "x AS (SELECT [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 12.5] AS x, l_linenumber FROM lineitem), points AS MATERIALIZED (SELECT row_number() OVER () AS obs_id, x, l_linenumber FROM x)"
    starts = "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {[float(v) for v in c]}::DOUBLE[])" for i, c in enumerate(STARTS)) + ") AS t(cid, c))"
    by_label = "a AS (SELECT obs_id, x, label AS cid FROM points)"
    eleven = f"k AS (SELECT CAST(i AS INTEGER) AS cid, (SELECT any_value(x) FROM points) AS c FROM range({K + 1}) AS r(i))"
    apart = f"c0 AS (SELECT CAST(i AS INTEGER) AS cid, list_concat([100.0::DOUBLE * i], list_transform(range(63), lambda z: 0.0::DOUBLE)) AS c FROM range({K}) AS r(i))"
    return {
        "row_count": "SELECT count(*) AS n, count(*) AS n_valid, CAST(max(len(embedding)) AS INTEGER) AS d, CAST(min(len(embedding)) AS INTEGER) AS d_valid FROM embeddings",
        "scan_one": f"WITH {POINTS} SELECT obs_id, CAST(unnest(range(len(x))) AS INTEGER) AS dim, round(unnest(x), 6) + 0.0 AS value FROM points WHERE obs_id = 42",
        "scan_range": f"WITH {POINTS} SELECT obs_id, round(x[1], 6) + 0.0 AS first FROM points WHERE obs_id BETWEEN 100 AND 149",
        "scan_indexed": f"WITH {POINTS} SELECT obs_id, round(x[1], 6) + 0.0 AS first FROM points WHERE label = 3",
        "gather_rows": f"WITH {POINTS}, g AS (SELECT t.cid, p.x AS c FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 411)) AS t(cid, obs_id) JOIN points p ON p.obs_id = t.obs_id) {long_form('g')}",
        "nearest_center": f"WITH {POINTS}, {FIRST}, {labels('a', 'c0')} SELECT a.obs_id, a.cid, round(sqrt({d2('a.x', 'c.c')}), 6) + 0.0 AS distance FROM a JOIN c0 c ON c.cid = a.cid",
        "nearest_center_join": f"WITH {POINTS}, {FIRST}, {labels('a', 'c0')} SELECT obs_id, cid FROM a",
        "two_nearest_centers": f"WITH {POINTS}, {FIRST}, r AS (SELECT p.obs_id, c.cid, row_number() OVER (PARTITION BY p.obs_id ORDER BY {d2('p.x', 'c.c')}, c.cid) AS r FROM points p CROSS JOIN c0 c) "
        "SELECT obs_id, max(cid) FILTER (WHERE r = 1) AS best, max(cid) FILTER (WHERE r = 2) AS second FROM r GROUP BY obs_id",
        "global_centroid": f"WITH {POINTS} SELECT CAST(j AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS value FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS j FROM points) GROUP BY j",
        "cluster_centroids": f"WITH {POINTS} SELECT label AS cid, CAST(j AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS value, count(*) AS size FROM (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS j FROM points) GROUP BY label, j",
        "empty_cluster_centroid": f"WITH {POINTS}, {by_label}, {eleven}, {means('m', 'a', 'k')} {long_form('m')}",
        "cluster_sizes": f"WITH {POINTS}, {eleven} SELECT k.cid, count(p.obs_id) AS size FROM k LEFT JOIN points p ON p.label = k.cid GROUP BY k.cid",
        "cluster_wcss": f"WITH {POINTS}, {by_label}, {eleven}, {means('m', 'a', 'k')} SELECT cid, wcss FROM ({summary('a', 'm')})",
        "dim_sum_squares": f"WITH {lines}, s AS (SELECT l_linenumber AS cid, j, count(*) AS n, var_pop(v) * count(*) AS ss FROM (SELECT l_linenumber, unnest(x) AS v, unnest(range(len(x))) AS j FROM points) GROUP BY ALL) "
        "SELECT CAST(cid AS INTEGER) AS cid, n, CAST(j AS INTEGER) AS dim, round(ss, 5) AS ss, round(sum(ss) OVER (PARTITION BY cid) / pow(n, 0.5), 5) AS adjusted FROM s",
        "optimal_partition": f"WITH {POINTS}, v AS (SELECT obs_id, x[1] AS v FROM points), b AS ({cut('v')}) SELECT round(boundary, 6) + 0.0 AS boundary FROM b",
        "compact_clusters": "SELECT vec_id AS obs_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cid FROM embeddings WHERE label % 2 = 0",
        "edge_k1": "SELECT count(*) AS size, avg(CAST(r_regionkey AS DOUBLE)) AS center, 0 AS iterations, 0 AS status FROM region",
        "edge_k_ge_n": "SELECT CAST(i AS INTEGER) AS cid, CAST(CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS size, CAST(coalesce(n_nationkey, 0) AS DOUBLE) AS c0, CAST(coalesce(n_regionkey, 0) AS DOUBLE) AS c1, "
        "CAST(n_nationkey AS BIGINT) AS obs_id FROM range(30) AS r(i) LEFT JOIN nation ON n_nationkey = i",
        "init_none": f"WITH {POINTS}, g AS (SELECT CAST(obs_id AS INTEGER) AS cid, x AS c FROM points WHERE obs_id < 12) {long_form('g')}",
        "init_random": f"WITH {POINTS}, s AS (SELECT * FROM points ORDER BY md5('{Random().seed}:' || obs_id) LIMIT {K}), g AS (SELECT CAST(row_number() OVER (ORDER BY obs_id) - 1 AS INTEGER) AS cid, x AS c FROM s) {long_form('g')}",
        "init_kmeanspp": kmeanspp(4),
        "init_kmeanspp_10": kmeanspp(K, 42),
        "lloyd_details": f"SELECT name, CAST(iterations AS INTEGER) AS iterations, CAST(status AS INTEGER) AS status, cid, size FROM (FROM (WITH {JITTERED}, {apart}, {lloyd(10)} {details('separated', 10)}) "
        f"UNION ALL FROM (WITH {POINTS}, {FIRST}, {lloyd(2)} {details('two passes', 2)}) UNION ALL FROM (WITH {POINTS}, {FIRST}, {lloyd(25)} {details('many passes', 25)}))",
        "points_round_trip": f"WITH {JITTERED} SELECT CAST(label AS BIGINT) AS obs_id, round(avg(x[1]), 6) + 0.0 AS first, count(*) AS size, count(*) AS labels FROM points GROUP BY label",
        "init_varpart_mean": varpart(False),
        "init_varpart_opt": varpart(True),
        "init_varpart_10": varpart(True, K),
        "lloyd": f"WITH {POINTS}, {FIRST}, {lloyd(10)} {summary('a10', 'c10')}",
        "lloyd_lineitem": f"WITH {lines}, {starts}, {lloyd(10)} {summary('a10', 'c10', 4)}",
        "hartigan_wong": "SELECT vec_id AS obs_id, label AS cid FROM embeddings",
        "minibatch": "SELECT vec_id AS obs_id, label AS cid FROM embeddings",
        "minibatch_steps": minibatch_steps(),
        "compute_pipeline": f"WITH {JITTERED}, {by_label}, k AS (SELECT CAST(i AS INTEGER) AS cid, (SELECT any_value(x) FROM points) AS c FROM range({K}) AS r(i)), {means('m', 'a', 'k')} {summary('a', 'm')}",
    }
