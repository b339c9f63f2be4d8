"""Planted signals, goldens and properties of the engine's own operators."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumentrail.config import SearchConfig
from lumentrail.functions import sky
from lumentrail.operators import candidates, cleanup, curves, images, match, results, search, stamps
from lumentrail.operators.regions import clip_area, patch_pixels
from lumentrail.plans import catalog, views
from lumentrail.sources import fits, tables
from lumentrail.streaming import grid


@pytest.fixture(scope="module")
def stack(spark):
    """Noise of sigma 1 with an object of flux 250 that starts at (20, 12) and moves by (8, -4) a day."""
    k = images.kernel_table(spark, images.gaussian_kernel(1.0))
    s = images.noise_stack(spark, [60000 + i / 10 for i in range(10)], 40, 30, 1.0, seed=1)
    return images.insert_object(s, k, 20, 12, 8.0, -4.0, 250.0).cache(), k


def test_planted_object_is_the_best(spark, stack):
    pixels, k = stack
    pp = images.convolved_psi_phi(pixels, k)
    v = candidates.velocity_grid(spark, 5, 4, 12, 5, -8, 0)
    starts = candidates.start_pixels(spark, (15, 25), (8, 18))
    best = search.ordered(search.search(starts, v, pp, k=1, min_obs=8)).first()
    assert (best.x, best.y, best.vx, best.vy) == (20, 12, 8.0, -4.0)
    assert abs(best.flux - 250) < 10


def test_dense_search_equals_join(spark, stack):
    pp = images.psi_phi(stack[0])
    v = candidates.velocity_grid(spark, 3, -5, 5, 3, -5, 5)
    starts = candidates.start_pixels(spark, (-2, 8), (-2, 8))
    a = search.search(starts, v, pp, k=2, min_obs=3).select("x", "y", "vx", "vy", "obs_count", F.round("lh", 6).alias("lh"))
    b = search.search_dense(starts, v, pp, 40, 30, k=2, min_obs=3).select(a.columns[:-1] + [F.round("lh", 6).alias("lh")])
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_convolutions_agree_and_leave_masked_pixels(spark):
    rows = [(0, 0.0, 0.0, y, x, float(i), 1.0) for i, (y, x) in enumerate(itertools.product(range(12), range(9))) if i % 7]
    p = images.psi_phi(spark.createDataFrame(rows, "t int, mjd double, zt double, y int, x int, sci double, var double"))
    k = images.gaussian_kernel(0.8)
    a = {(r.y, r.x): r.psi for r in images.convolved(p, images.kernel_table(spark, k), "psi").collect()}
    b = {(r.y, r.x): r.psi for r in images.convolved_dense(p, k, "psi", 9, 12).collect()}
    assert a.keys() == b.keys() and len(a) == len(rows)
    assert all(abs(a[c] - b[c]) < 1e-9 for c in a)


def test_encoding_stays_within_a_step(spark):
    df = spark.createDataFrame([(float(v),) for v in [-3, 0, 0.1, 7.5, float("nan")]], "psi double")
    for n, steps in ((1, 255), (2, 65535)):
        e = images.encode(df, "psi", n).withColumn("back", images.decoded(F.col("code"), F.col("low"), F.col("scale"))).collect()
        for r in e:
            assert (r.code == 0) == math.isnan(r.psi)
            assert math.isnan(r.psi) or abs(r.back - r.psi) <= 10.5 / steps * 1.01


def brute_clip(v, n=2.0, floor=1e-8):
    good = [x for x in v if x is not None and math.isfinite(x)]
    if not good:
        return [False] * len(v)
    a, m, b = np.percentile(good, [25, 50, 75])
    d = n * 0.7413 * max(b - a, floor)
    return [x is not None and math.isfinite(x) and m - d < x < m + d for x in v]


def test_clipping(spark):
    rng = random.Random(1)
    cases = [[rng.gauss(0, 1) + (100 if rng.random() < 0.1 else 0) for _ in range(20)] for _ in range(30)] + [[5.0] * 8, [float("nan")] * 4, [], [1.0, None, float("inf"), 2.0]]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, c array<double>")
    got = {r.id: r.v for r in df.select("id", curves.clip_curve(F.col("c"), 25, 75, 0.7413).alias("v")).collect()}
    assert all(got[i] == brute_clip(c) for i, c in enumerate(cases))
    assert abs(sky.clip_coefficient() - 0.7413) < 1e-4


def test_restated_statistics(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 90.0], [1.0, 1.0, 1.0], [True, True, False]), (2, [1.0], [0.0], [True]), (3, [1.0], [1.0], [False])], "id int, psi_curve array<double>, phi_curve array<double>, obs_valid array<boolean>")
    got = {r.id: (r.obs_count, round(r.lh, 6), r.flux) for r in curves.restated(df).collect()}
    assert got == {1: (2, round(3 / math.sqrt(2), 6), 1.5), 2: (1, 0.0, 0.0)}


POINTS = [(0, 10, 11, 1.0, 2.0), (1, 10, 11, 10.0, 20.0), (2, 40, 5, -1.0, 2.0), (3, 5, 0, 1.0, 2.0), (4, 5, 1, 1.0, 2.0)]


def frame(spark, rows, lh=100.0):
    return spark.createDataFrame([(*r, float(lh)) if len(r) == 5 else r for r in rows], "id long, x int, y int, vx double, vy double, lh double")


def kept(df):
    return sorted(r.id for r in df.select("id").collect())


def test_clustering_goldens(spark):
    t = frame(spark, POINTS)
    assert kept(cleanup.best_of_cluster(t, "start_position", 5.0)) == [0, 2, 3]
    assert kept(cleanup.best_of_cluster(t, "all", 5.0)) == [0, 1, 2, 3]
    assert kept(cleanup.grid_best(t, 10.0, 0.0)) == [0, 2, 3]


def brute_sweep(rows, eps):
    """The best first, ties in order of id; each kept one removes those within eps that aren't better."""
    near = lambda a, b: math.dist(a[1:3], b[1:3]) <= eps
    out = []
    for a in rows:
        around = [b for b in rows if b is not a and near(a, b)]
        if all(b[5] <= a[5] for b in around) and not any(near(a, b) for b in out):
            out.append(a)
    return sorted(a[0] for a in out)


@pytest.mark.parametrize("seed", range(3))
def test_sweep_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(40), rng.randrange(40), 0.0, 0.0, float(rng.randrange(4))) for i in range(60)]
    assert kept(cleanup.sweep(frame(spark, rows), "nn_start", 6.0)) == brute_sweep(rows, 6.0)


def crowded(seed, n=120):
    """Rows of which many share a place, a few without one, and ids in no order."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(9), rng.randrange(9), rng.randrange(3) / 2, rng.randrange(3) / 2, float(rng.randrange(50))) for i in rng.sample(range(1000), n)]
    return rows + [(2000, None, 3, 0.0, 0.0, 9.0), (2001, 3, 3, float("nan"), 0.0, 9.0), (2002, 3, 3, float("nan"), 0.0, 9.0)]


def linked_pairs(rows, eps):
    return {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if None not in a + b and math.dist(a[1:5], b[1:5]) <= eps}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_crowded_places(spark):
    """All pairs, also at one place; no side is broadcast, however small it seems before it is sent to several cells."""
    rows = crowded(5)
    pairs = cleanup.neighbours(cleanup.with_features(frame(spark, rows), "all"), 1.2, 4)
    assert "Broadcast" not in plan_of(pairs)
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(linked_pairs(rows, 1.2))


@pytest.mark.parametrize("kind", ["all", "start_position"])
def test_clusters_of_crowded_places(spark, kind):
    """Clusters against brute force; the edges that are joined are no more than places in blocks, however many pairs."""
    rows, eps = crowded(6), 0.8 if kind == "start_position" else 1.0
    flat = [r if kind == "all" else (*r[:3], r[3] * 0, r[4] * 0, r[5]) for r in rows]
    of = {r[0]: r[0] for r in rows}
    pairs = linked_pairs(flat, eps)
    while step := {(a, of[b]) for a, b in pairs if of[b] < of[a]}:
        for a, root in step:
            of[a] = min(of[a], root)
    got = cleanup.clustered(frame(spark, rows), kind, eps)
    assert {r.id: r.cluster for r in got.collect()} == of
    places = cleanup._places(cleanup.with_features(frame(spark, rows * 9), kind), cleanup.dimensions(kind), F.min("id").alias("node"))
    assert places.count() == len({r[1:5] for r in flat if None not in r and not math.isnan(r[3])})


def test_best_of_crowded_clusters(spark):
    """As the clusters; the best of each, the least id of equal ones, among points that share places."""
    rows = crowded(7)
    of = {r.id: r.cluster for r in cleanup.clustered(frame(spark, rows), "pos_vel", 1.0).collect()}
    best = {}
    for r in rows:
        best[of[r[0]]] = max(best.get(of[r[0]], (-1, 0)), (r[5], -r[0]))
    got = cleanup.apply_clustering(frame(spark, rows), "pos_vel", 1.0, (0.0, 1.0, 2.0))
    assert kept(got) == sorted(-i for _, i in best.values())


@pytest.mark.parametrize("seed", range(2))
def test_sweep_of_crowded_places(spark, seed):
    """Many ties at one place and beside it; without a likelihood or a place, a trajectory stays."""
    rows = [(*r[:5], float(r[5] % 4)) for r in crowded(seed)]
    eps = 1.6
    near = linked_pairs([(i, x, y, x + 2 * vx, y + 2 * vy) if x is not None else (i, x, y, vx, vy) for i, x, y, vx, vy, _ in rows], eps)
    lh = {r[0]: r[5] for r in rows}
    top = [i for i in sorted(lh) if not any(a == i and lh[b] > lh[i] for a, b in near)]
    out = []
    for i in top:
        if not any((i, j) in near for j in out):
            out.append(i)
    rows.append((3000, 3, 3, 0.0, 0.0, None))
    t = spark.createDataFrame(rows, "id long, x int, y int, vx double, vy double, lh double")
    assert kept(cleanup.sweep(t, "nn_start_end", eps, (0.0, 1.0, 2.0))) == sorted([*out, 3000])


def test_line_clusters_keep_the_best_of_a_line(spark):
    rows = [(0, 0, 0, 1.0, 0.0, 9.0), (1, 10, 1, 1.0, 0.0, 5.0), (2, 0, 50, 1.0, 0.0, 7.0)]
    assert kept(cleanup.predictive_lines(frame(spark, rows), 4.0, 2, 60.0)) == [0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10**6))
def test_assignment_is_optimal(n, more, seed):
    c = np.random.default_rng(seed).integers(0, 30, (n, n + more)).astype(float)
    best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + more), n))
    pick = match.assign(c)
    assert len(set(pick)) == n and sum(c[i, j] for i, j in enumerate(pick)) == best


def mean_distances(a, b, times):
    at = lambda p, t: (p.x + p.vx * t).to_numpy(float) + 1j * (p.y + p.vy * t).to_numpy(float)
    return np.mean([np.abs(at(a, t)[:, None] - at(b, t)[None, :]) for t in times], axis=0)


def test_matched_sets_are_optimal(spark):
    rng = np.random.default_rng(3)
    for n, m, size in ((6, 7, 12), (7, 5, 12), (6, 6, 30)):
        a, b = (pd.DataFrame({"id": range(k), "x": rng.integers(-size, size, k), "y": rng.integers(-5, 5, k), "vx": rng.integers(-2, 3, k) * 1.0, "vy": rng.integers(-2, 3, k) * 1.0}) for k in (n, m))
        cost = mean_distances(a, b, [0.0, 2.0])
        cost = cost if n <= m else cost.T
        tries = ([cost[i, j] for i, j in enumerate(p) if cost[i, j] <= 8] for p in itertools.permutations(range(max(n, m)), min(n, m)))
        best = min((-len(t), sum(t)) for t in tries)
        got = match.match_sets(spark.createDataFrame(a), spark.createDataFrame(b), [0.0, 2.0], 8.0).toPandas()
        assert got["query_id"].is_unique and got["id"].is_unique
        assert (-len(got), got["distance"].sum()) == pytest.approx(best)


def test_assigned_trajectories_match_across_all_positions(spark):
    d = "/root/testdata/sf0.001"
    t = views.trajectories(spark, d).toPandas()
    a, b = (t[t.id % 2 == k].reset_index() for k in (0, 1))
    cost = mean_distances(a, b, [0.0, 2.0])
    pick = match.assign(np.where(cost <= 8, cost, 1e6))
    best = cost[np.arange(len(a)), pick]
    got = catalog.queries()["assigned_trajectories"](spark, d).toPandas()
    assert got["query_id"].is_unique and got["id"].is_unique
    assert len(got) == (best <= 8).sum()
    assert got["distance"].sum() == pytest.approx(best[best <= 8].sum())


def test_nearest_trajectories_look_at_all_other_rows(spark):
    d = "/root/testdata/sf0.001"
    t = views.trajectories(spark, d).toPandas().sort_values("id", ignore_index=True)
    cost = mean_distances(t, t, [0.0, 2.0]).round(9)
    np.fill_diagonal(cost, np.inf)
    best = {int(t.id[i]): (int(t.id[cost[i].argmin()]), round(cost[i].min(), 6)) for i in np.flatnonzero(t.id % 20 == 0)}
    got = {r.query_id: (r.id, r.distance) for r in catalog.queries()["nearest_trajectories"](spark, d).collect()}
    assert got == best


def test_nearest_trajectories_of_crowded_places(spark):
    """Against brute force, with shared places, far ones and none; no query is compared with all rows in one plan."""
    rows = crowded(8) + [(3000, 90000, -7, 5.0, 0.0, 1.0)]
    t = frame(spark, rows)
    q = t.where("id % 3 = 0")
    got = match.nearest_trajectory(q, t, [0.0, 2.0])
    assert "NestedLoop" not in plan_of(got)
    p = pd.DataFrame([r[:5] for r in rows if None not in r and not math.isnan(sum(r[1:5]))], columns=["id", "x", "y", "vx", "vy"]).sort_values("id", ignore_index=True)
    cost = mean_distances(p, p, [0.0, 2.0]).round(9)
    np.fill_diagonal(cost, np.inf)
    best = {int(p.id[i]): (int(p.id[cost[i].argmin()]), cost[i].min()) for i in np.flatnonzero(p.id % 3 == 0)}
    assert 3000 in best and {r.query_id: (r.id, r.distance) for r in got.collect()} == best


def test_nearest_time_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 10.25), (3, 20.0)], "event_id long, mjd double")
    times = spark.createDataFrame([(0, 9.75), (1, 10.25)], "time_id long, mjd double")
    got = {r.event_id: r.time_id for r in match.nearest_in_time(left, times, 0.25).collect()}
    assert got == {1: 0, 2: 1, 3: -1}


def test_sky_queries_take_all_customers(spark, tmp_path):
    """150 and later customers are catalogued, matched by their users and missed without; against brute force."""
    keys = [0, 7, 149, 150, 151, 399]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    day = pd.Timestamp("2024-01-01")  # mjd 60310
    rows = [(e, u, day + pd.Timedelta(days=e % 9, hours=h), 1.0) for e, (u, h) in enumerate(itertools.product([7, 149, 150, 399, 400], [0, 1, 1, 1, 6]))]
    events = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "value"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    place = lambda k, e: (10 + k % 10 * 0.01 + e % 7 * 0.0001, -5 + k // 10 * 0.01 + e % 5 * 0.0001)

    def near(a, b):
        (r1, d1), (r2, d2) = np.radians(a), np.radians(b)
        h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(h))) <= 0.001

    seen = {(u, e, k) for e, u, ts, _ in rows for k in keys if (ts - ts.normalize()).total_seconds() <= 0.05 * 86400 and near(place(u, e), place(k, 0))}
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r["id"], r["i"], r["name"]) for r in run("sky_matches")} == seen
    assert {k for *_, k in seen} == {7, 149, 150, 399}
    assert {r["i"] for r in run("unmatched_observations")} == {r[0] for r in rows} - {e for _, e, _ in seen}
    assert {(r["name"], r["recovered"]) for r in run("recovered_and_missed")} == {(k, k in (7, 149, 150, 399)) for k in keys}
    of = {}
    for u, e, k in seen:
        of.setdefault((u, k), []).append(e)
    assert {(r["id"], r["name"]): r["observations"] for r in run("matched_observations")} == {p: ",".join(map(str, sorted(e))) for p, e in of.items()}
    assert {(r["id"], r["name"]): r["n"] for r in run("recovered_by_count")} == {p: len(e) for p, e in of.items() if len(e) >= 3}
    assert {(r["id"], r["name"]): r["ratio"] for r in run("recovered_by_ratio")} == {p: round(len(e) / 30, 6) for p, e in of.items() if len(e) / 30 <= 0.15}


def test_sky_match_wraps_around(spark):
    obs = spark.createDataFrame([(1, 0, 5.0, 359.9999, 89.0), (2, 0, 5.0, 0.0, -10.0)], "id long, i long, mjd double, ra double, dec double")
    cat = spark.createDataFrame([("a", 5.0, 0.0001, 89.0), ("b", 5.0, 359.9999, -10.0), ("c", 9.0, 0.0, -10.0)], "name string, mjd double, ra double, dec double")
    got = {(r.id, r.name) for r in match.on_sky(obs, cat, 0.001, 0.1).select("id", "name").collect()}
    assert got == {(1, "a"), (2, "b")}


def test_sky_match_against_brute_force(spark):
    """Around poles and wraps; declinations beyond a pole, as far copies of the customers have, stand for other places."""
    rng = np.random.default_rng(1)

    def places(n):
        dec = rng.choice([89.5, -89.5, 90, 0, 30, 100, 200, -100, 451, 1080], n) + rng.normal(0, 0.6, n)
        return pd.DataFrame({"i": range(n), "id": 1, "mjd": rng.uniform(0, 1.2, n), "ra": rng.choice([0, 360, 180, -3], n) + rng.normal(0, 1.5, n), "dec": dec})

    o, c = places(400), places(400).rename(columns={"i": "name"})
    (r1, d1), (r2, d2) = (np.radians(p[["ra", "dec"]].to_numpy().T) for p in (o, c))
    h = np.sin((d2 - d1[:, None]) / 2) ** 2 + np.cos(d1)[:, None] * np.cos(d2) * np.sin((r2 - r1[:, None]) / 2) ** 2
    apart, gap = np.degrees(2 * np.arcsin(np.sqrt(h.clip(0, 1)))), np.abs(c.mjd.to_numpy() - o.mjd.to_numpy()[:, None])
    for degrees, days in ((0.5, 0.3), (2.0, 0.1)):
        got = match.on_sky(spark.createDataFrame(o), spark.createDataFrame(c), degrees, days)
        assert sorted((r.i, r.name) for r in got.select("i", "name").collect()) == [tuple(map(int, p)) for p in np.argwhere((apart <= degrees) & (gap <= days))]


def test_sky_match_sends_a_catalogue_row_to_one_cell(spark):
    obs = spark.createDataFrame([(1, 0, 5.0, 10.0, 3.0)], "id long, i long, mjd double, ra double, dec double")
    cat = spark.createDataFrame([("a", 5.0, 10.0, 3.0)], "name string, mjd double, ra double, dec double")
    pairs = match.on_sky(obs, cat, 0.001, 0.1).select("id", "name")
    assert plan_of(pairs).count("Generate explode") == 3 and pairs.count() == 1


def test_fit_returns_the_line(spark):
    o = spark.createDataFrame([(1, t / 4, 10 + 3 * t / 4 + 0.5, 20 - 2 * t / 4 + 0.5) for t in range(8)], "id long, zt double, x double, y double")
    line = match.fit_lines(o)
    r = line.first()
    assert (r.x, r.y) == (10, 20) and abs(r.vx - 3) < 1e-9 and abs(r.vy + 2) < 1e-9
    assert match.line_error(o, line).first().mse < 1e-12


def test_coadds_of_empty_and_masked(spark):
    s = spark.createDataFrame([(1, 0, 60000.0, 0, 0, 1.0, 1.0), (1, 1, 60000.5, 0, 0, 4.0, 4.0), (1, 2, 60001.2, 0, 0, 10.0, 0.0)], "id long, t int, mjd double, dy int, dx int, sci double, var double")
    r = stamps.coadds(s).first()
    assert (r["sum"], r["mean"], r["median"], r["weighted"]) == (15.0, 5.0, 4.0, 1.6)
    assert stamps.as_arrays(stamps.coadds(s), "sum", 1).first().coadd_sum == [[0.0, 0.0, 0.0], [0.0, 15.0, 0.0], [0.0, 0.0, 0.0]]


def moving(spark, n=60):
    """A small stack with masked pixels and odd variances, and trajectories of which some leave it or have no place."""
    rng = random.Random(2)
    var = lambda: rng.choice([1.0, 4.0, 0.5, 0.0, float("nan"), float("inf")])
    rows = [(t, 60000.0 + t / 2, t / 2, y, x, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1), float("nan")]), var()) for t in range(5) for y in range(3, 12) for x in range(-2, 9) if rng.random() < 0.8]
    pixels = spark.createDataFrame(rows, "t int, mjd double, zt double, y int, x int, sci double, var double")
    r = [(i, rng.randrange(-4, 14), rng.randrange(-4, 14), rng.choice([-1.5, 0.0, 0.25, 2.0]), rng.choice([-1.0, 0.5])) for i in range(n)] + [(900, None, 3, 0.0, 0.0)]
    return spark.createDataFrame(r, "id long, x int, y int, vx double, vy double"), pixels


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("by_day", [False, True])
def test_coadds_from_a_cube(spark, by_day):
    r, pixels = moving(spark)
    got, want = stamps.coadds_at(r, pixels, 1, by_day), stamps.coadds(stamps.cutouts(r, pixels, 1), by_day)
    assert "SortAggregate" not in plan_of(got) and "HashAggregate" not in plan_of(got)
    assert rounded(got.select(want.columns)) == rounded(want)
    twice = r.union(r)  # an id with two trajectories: summed up by id
    assert rounded(stamps.coadds_at(twice, pixels, 1, by_day).select(want.columns)) == rounded(stamps.coadds(stamps.cutouts(twice, pixels, 1), by_day))


def test_peaks_from_a_cube(spark):
    r, pixels = moving(spark)
    got, want = stamps.peaks_at(r, pixels, 2), stamps.peak_offset(stamps.coadds(stamps.cutouts(r, pixels, 2)))
    assert "Aggregate" not in plan_of(got) and rounded(got) == rounded(want)


def test_normalised_stamps_from_a_cube(spark):
    r, pixels = moving(spark)
    got, want = stamps.normalised_at(r, pixels, 1), stamps.normalised(stamps.coadds(stamps.cutouts(r, pixels, 1)))
    assert "Aggregate" not in plan_of(got) and rounded(got) == rounded(want.select(got.columns))


def test_refined_from_a_cube(spark):
    r, pixels = moving(spark)
    pp = images.psi_phi(pixels.where("not isnan(sci) and var in (1.0, 4.0, 0.5)"))
    v = candidates.velocity_grid(spark, 3, -0.5, 0.5, 3, -0.5, 0.5)
    got = search.refine(r, v, pp, 1, 2)
    assert "Aggregate" not in plan_of(got)
    lines = {(s.id, s.x + i, s.y + j, s.vx + w.vx, s.vy + w.vy) for s in r.where("id < 900").collect() for i in (-1, 0, 1) for j in (-1, 0, 1) for w in v.collect()}
    at, zt, best = {(p.t, p.y, p.x): p for p in pp.collect()}, {p.t: p.zt for p in pp.collect()}, {}
    for i, x, y, vx, vy in lines:
        hits = [at[k] for t, z in zt.items() if (k := (t, math.floor(y + vy * z + 0.5), math.floor(x + vx * z + 0.5))) in at]
        if len(hits) >= 2:
            lh = sum(p.psi for p in hits) / math.sqrt(sum(p.phi for p in hits))
            best[i] = min(best.get(i, (9e9,)), (-round(lh, 9), x, y, vx, vy, len(hits)))
    assert {s.id: (-round(s.lh, 9), s.x, s.y, s.vx, s.vy, s.obs_count) for s in got.collect()} == best


def test_tracked_filters(spark):
    t = results.tracked(frame(spark, POINTS))
    f = results.filter_rows(results.filter_rows(t, F.col("x") < 20, "x"), F.col("y") > 0, "y")
    assert {r.label: r.n for r in results.filter_statistics(f).collect()} == {"unfiltered": 3, "x": 1, "y": 1}
    assert kept(results.current(results.revert(f, "x"))) == [0, 1, 2, 4]
    assert kept(results.current(results.filter_ids(t, spark.createDataFrame([], "id long"), "none"))) == []
    with pytest.raises(ValueError):
        results.extend(t, t.drop("lh"))


def test_results_round_trip(spark, tmp_path):
    df = frame(spark, POINTS).withColumn("all_stamps", F.array(F.array(F.array(F.lit(1.0)))))
    tables.write_results(df, str(tmp_path / "r"), {"wcs": "{}"}, separate=["all_.*"], drop=["lh"])
    got, meta = tables.read_results(spark, str(tmp_path / "r"))
    assert set(got.columns) == {"id", "x", "y", "vx", "vy", "all_stamps"} and got.count() == 5
    assert ("wcs", "{}") in meta
    slim, constant = tables.packed(df.drop("all_stamps"))
    assert constant == {"lh": 100.0} and tables.unpacked(slim, constant).count() == 5
    assert results.stripped(df, max_depth=1).columns == ["id", "x", "y", "vx", "vy", "lh"]


def test_stack_round_trip(spark, stack, tmp_path):
    pixels = stack[0]
    tables.write_stack(pixels, pixels.select("t", "mjd").distinct(), str(tmp_path / "s"))
    back, meta = tables.read_stack(spark, str(tmp_path / "s"))
    assert back.count() == pixels.count() and meta.count() == 10


def test_fits_source(spark, tmp_path):
    a = np.arange(12, dtype=float).reshape(3, 4)
    a[1, 1] = np.nan
    mask = np.zeros((3, 4), int)
    mask[0, 0], mask[2, 3] = 1, 2
    head = {"MJD-OBS": 60000.25}
    (tmp_path / "x.fits").write_bytes(fits.write_units([(head, None), ({"EXTNAME": "SCI"}, a), ({"EXTNAME": "VAR"}, a + 1), ({"EXTNAME": "MASK"}, mask)]))
    spark.dataSource.register(fits.FitsSource)
    df = spark.read.format("fits").load(str(tmp_path))
    assert df.count() == 3 and {r.mjd for r in df.collect()} == {60000.25}
    p = fits.standardized(df, flags=1)
    assert sorted((r.y, r.x, r.sci, r["var"]) for r in p.collect()) == [(y, x, a[y, x], a[y, x] + 1) for y in range(3) for x in range(4) if (y, x) not in ((0, 0), (1, 1))]


def test_stream_of_the_grid_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(50), rng.randrange(50), float(rng.randrange(3)), 0.0, float(rng.randrange(9))) for i in range(200)]
    t = frame(spark, rows)
    for k in range(3):
        t.where(F.col("id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = grid.run_to_table(grid.best_per_cell(src, 10.0, 2.0), "cells", str(tmp_path / "state"))
    q.awaitTermination()
    assert kept(spark.table("cells")) == kept(cleanup.grid_best(t, 10.0, 2.0))


def test_sky_functions(spark):
    row = spark.range(1).select(*sky.tan_to_sky(F.lit(530.0), F.lit(470.0), 359.99, 40.0, 0.01, 500, 500)).toDF("ra", "dec")
    back = row.select(*sky.tan_to_pixel(F.col("ra"), F.col("dec"), 359.99, 40.0, 0.01, 500, 500)).first()
    assert abs(back[0] - 530) < 1e-6 and abs(back[1] - 470) < 1e-6
    assert spark.range(1).select(sky.observing_day(F.lit(60676.4))).first()[0] == "20241231"
    miss = spark.range(1).select(*sky.parallax_corrected(F.lit(0.0), F.lit(0.0), (F.lit(-2.0), F.lit(3.0), F.lit(0.0)), F.lit(1.0))).first()
    assert miss[2] is None
    assert abs(sky.ecliptic_angle(0.0, 0.0) - math.radians(23.4392911)) < 1e-4


def test_regions():
    assert patch_pixels(20, 0.2) == 6000
    assert abs(clip_area([(0, 0), (2, 0), (2, 2), (0, 2)], 2.0, 1.0, 2.0) - 2) < 1e-12
    assert clip_area([(5, 5), (6, 5), (6, 6)], 0.0, 0.0, 1.0) == 0


def test_configuration():
    c = SearchConfig.from_yaml(SearchConfig(num_obs=7).to_yaml())
    assert c.num_obs == 7 and c.start_bounds("x", 100) == (0, 100)
    assert SearchConfig(x_pixel_buffer=5).start_bounds("x", 100) == (-5, 105)
    for bad in ({"sigmaG_lims": [75, 25]}, {"results_per_pixel": 0}, {"no_such": 1}, {"cluster_type": "none"}):
        with pytest.raises(ValueError):
            SearchConfig.from_dict(bad)


def test_generators_refuse_bad_parameters(spark):
    for bad in (lambda: candidates.velocity_grid(spark, 1, 0, 1, 2, 0, 1), lambda: candidates.pencil(spark, 1, 1, -1), lambda: candidates.polar_around(spark, [1, 2, 3], [0, 1, 2], None)):
        with pytest.raises(ValueError):
            bad()
    assert candidates.ecliptic_centered(spark, [5, 5, 1], [0, 0, 1]).count() == 1
    candidates.register("Own", lambda spark, n: candidates.single(spark, n, 0))
    assert candidates.create(spark, {"name": "Own", "n": 3}).first().vx == 3.0


def test_classifier_hook(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "id long, stamp array<double>")
    got = stamps.classify(df, lambda s: pd.Series([float(x[0] > 0) for x in s])).collect()
    assert {r.id: r.cnn_class for r in got} == {1: True, 2: False}
