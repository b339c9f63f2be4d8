"""Whole runs: planted objects are found, and the commands work on what other commands wrote."""

import pytest
from pyspark.sql import functions as F

from lumentrail import cli
from lumentrail.config import SearchConfig
from lumentrail.operators import candidates, images, match
from lumentrail.plans import run as R
from lumentrail.sources import tables

GRID = {"name": "VelocityGridSearch", "vx_steps": 5, "vx_min": 4, "vx_max": 12, "vy_steps": 5, "vy_min": -8, "vy_max": 0}


@pytest.fixture(scope="module")
def stack(spark, tmp_path_factory):
    k = images.kernel_table(spark, images.gaussian_kernel(1.0))
    s = images.noise_stack(spark, [60000 + i / 10 for i in range(10)], 36, 30, 1.0, seed=1)
    s = images.insert_object(s, k, 20, 12, 8.0, -4.0, 250.0)
    path = str(tmp_path_factory.mktemp("stack") / "s")
    tables.write_stack(s, s.select("t", "mjd").distinct(), path)
    return path


def config(**kw):
    return SearchConfig(generator_config=GRID, num_obs=6, lh_level=8.0, psf_val=1.0, stamp_radius=3, coadds=["mean"], peak_offset_max=2.0, x_pixel_bounds=[16, 24], y_pixel_bounds=[8, 16], results_per_pixel=2, **kw)


def test_a_run_finds_the_object(spark, stack):
    pixels = tables.read_stack(spark, stack)[0].withColumn("zt", F.col("mjd") - 60000)
    rows = R.run(pixels, R.Frame(36, 30, 10.0, -5.0), config(cluster_type="nn_start_end", cluster_eps=10.0)).collect()
    best = max(rows, key=lambda r: r.lh)
    assert (best.x, best.y, best.vx, best.vy) == (20, 12, 8.0, -4.0) and len(rows) <= 3
    assert len(best.psi_curve) == len(best.obs_valid) == len(best.global_ra) == 10
    assert len(best.stamp) == len(best.stamp[0]) == 7 and best.coadd_mean[3][3] == max(max(r) for r in best.coadd_mean)
    assert len(best.uuid) == 32 and abs(best.pred_x[5] - 24.0) < 1e-9


def test_injected_objects_are_matched(spark):
    frame = R.Frame(100, 100, 10.0, -5.0)
    times = spark.range(4).select((60000 + F.col("id") / 4).alias("mjd"), (F.col("id") / 4).alias("zt"))
    cat = R.injection_catalog(spark, 7, times, candidates.velocity_grid(spark, 3, -5, 5, 3, -5, 5), frame, (18.0, 22.0), seed=3)
    assert cat.count() == 28 and cat.where(~F.col("mag").between(18, 22)).isEmpty()
    x, y = frame.to_pixel(F.col("ra"), F.col("dec"))
    assert cat.where((F.abs(x - F.col("plot_x")) > 1e-6) | (F.abs(y - F.col("plot_y")) > 1e-6)).isEmpty()
    obs = cat.select(F.col("injection_id").alias("id"), F.floor(F.col("mjd") * 4).alias("i"), "mjd", "ra", "dec")
    pairs = match.on_sky(obs, cat.select(F.col("injection_id").alias("name"), "mjd", "ra", "dec"), 0.1 / 3600, 60 / 86400)
    assert {(r.id, r.name, r.n) for r in match.recovered_by_count(pairs, 4).collect()} == {(i, i, 4) for i in range(7)}


def test_commands(spark, stack, tmp_path, capsys):
    out = lambda n: str(tmp_path / n)
    (tmp_path / "c.yaml").write_text(config(do_clustering=False).to_yaml())
    cli.main(["search", stack, out("r"), "--config", out("c.yaml"), "--width", "36", "--height", "30"])
    n = spark.read.parquet(out("r") + "/main").count()
    cli.main(["filter", out("r"), out("f"), "--min-lh", "9", "--min-obs", "6", "--cluster", "grid_start_end", "--eps", "8"])
    cli.main(["merge", out("m"), out("f"), out("f"), "--eps", "5"])
    cli.main(["strip", out("f"), out("t")])
    cli.main(["stamps", out("f"), out("p"), "--stack", stack, "--radius", "2", "--kinds", "sum", "median"])
    cli.main(["stats", out("f")])
    cli.main(["version"])
    f, m, t, p = (tables.read_results(spark, out(x))[0] for x in "fmtp")
    assert 0 < f.count() <= n and m.count() == f.count()
    assert "stamp" not in t.columns and len(p.first().coadd_median) == 5
    assert "rows:" in capsys.readouterr().out
    cat = tables.read_results(spark, out("f"))[0].select(F.col("uuid").alias("name"), F.explode(F.arrays_zip("global_ra", "global_dec")).alias("g")).select("name", F.col("g.global_ra").alias("ra"), F.col("g.global_dec").alias("dec"))
    cat.crossJoin(spark.createDataFrame([(60000.0,), (60000.5,)], "mjd double")).write.parquet(out("cat"))
    cli.main(["match", out("f"), out("matches"), "--stack", stack, "--catalog", out("cat")])
    assert spark.read.parquet(out("matches")).where("n >= 1").count() >= f.count()
    cli.main(["test-data", out("d"), "--images", "2", "--width", "8", "--height", "8"])
    assert tables.read_stack(spark, out("d"))[0].count() == 128
