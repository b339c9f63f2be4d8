"""Command line: ``python -m lumentrail.cli <command> ...`` on results and stacks written by this engine."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lumentrail
from lumentrail.config import SearchConfig
from lumentrail.operators import candidates, cleanup, images, match, regions, results, stamps
from lumentrail.plans import run as R
from lumentrail.sources import tables


def _session() -> SparkSession:
    return SparkSession.builder.appName("lumentrail").getOrCreate()


def _config(path: str | None) -> SearchConfig:
    if not path:
        return SearchConfig()
    with open(path, encoding="utf-8") as f:
        return SearchConfig.from_yaml(f.read())


def search(a, spark) -> None:
    pixels, _ = tables.read_stack(spark, a.stack)
    config = _config(a.config)
    tables.write_results(R.run(pixels, R.Frame(a.width, a.height, a.ra, a.dec, a.scale), config), a.out, {"config": config.to_yaml()}, config.separate_col_files)


def filter_(a, spark) -> None:
    df, meta = tables.read_results(spark, a.results)
    df = df.where((F.col("lh") >= a.min_lh) & (F.col("obs_count") >= a.min_obs))
    df = cleanup.apply_clustering(df, a.cluster, a.eps, (0.0, a.last_dt / 2, a.last_dt)) if a.cluster else df
    tables.write_results(df, a.out, {k: v for k, v in meta if not k.endswith("_column")})


def merge(a, spark) -> None:
    def keep(df: DataFrame) -> DataFrame:
        ends = [cleanup.sweep(df, "nn_start", a.eps, (t, t, t)).select("id") for t in (0.0, a.last_dt)]
        return ends[0].union(ends[1])

    parts = [tables.read_results(spark, p)[0] for p in a.results]
    top = 0
    for i, p in enumerate(parts):
        parts[i] = p.withColumn("id", F.col("id") + top)
        top += (p.agg(F.max("id")).first()[0] or 0) + 1
    tables.write_results(results.merged(parts, keep), a.out)


def stats(a, spark) -> None:
    df, _ = tables.read_results(spark, a.results, columns=False)
    print("rows:", df.count())
    for column in ("lh", "obs_count"):
        print(column)
        results.histogram(df, column, 10).orderBy("bin").show()


def stamps_(a, spark) -> None:
    df, meta = tables.read_results(spark, a.results)
    pixels, _ = tables.read_stack(spark, a.stack)
    cuts = stamps.coadds(stamps.cutouts(df, pixels, a.radius), by_day=False)
    for kind in a.kinds:
        df = df.drop(f"coadd_{kind}").join(stamps.as_arrays(cuts, kind, a.radius), "id", "left")
    tables.write_results(df, a.out, {k: v for k, v in meta if not k.endswith("_column")})


def strip(a, spark) -> None:
    df, meta = tables.read_results(spark, a.results, columns=False)
    tables.write_results(results.stripped(df, a.max_depth, tuple(a.keep), tuple(a.drop), a.all_null), a.out, {k: v for k, v in meta if not k.endswith("_column")})


def matcher(a, spark) -> None:
    df, _ = tables.read_results(spark, a.results)
    at = df.select("id", F.posexplode(F.arrays_zip("global_ra", "global_dec", "obs_valid")).alias("i", "o")).where("o.obs_valid")
    times = tables.read_stack(spark, a.stack)[0].select("t", "mjd").distinct().select(F.col("t").alias("i"), "mjd")
    obs = at.join(F.broadcast(times), "i").select("id", "i", "mjd", F.col("o.global_ra").alias("ra"), F.col("o.global_dec").alias("dec"))
    pairs = match.on_sky(obs, spark.read.parquet(a.catalog), a.arcsec / 3600, a.seconds / 86400)
    match.matched_observations(pairs).withColumn("n", F.size("observations")).write.mode("overwrite").parquet(a.out)


def regions_(a, spark) -> None:
    grid = regions.patches(spark, a.arcmin, a.overlap, a.dec_min, a.dec_max)
    found = regions.locate(spark.read.parquet(a.images), grid, a.arcmin / 60)
    found.repartition("patch_id").write.mode("overwrite").partitionBy("patch_id").parquet(a.out)


def test_data(a, spark) -> None:
    s = images.noise_stack(spark, [60000 + i / 10 for i in range(a.images)], a.width, a.height, a.noise, a.seed)
    k = images.kernel_table(spark, images.gaussian_kernel(1.4))
    for v in candidates.random_velocities(spark, -10, 10, -10, 10, a.objects, a.seed).collect():
        s = images.insert_object(s, k, (37 * v.vel_id + 5) % a.width, (53 * v.vel_id + 7) % a.height, v.vx, v.vy, a.flux)
    tables.write_stack(s, s.select("t", "mjd").distinct(), a.out)


def version(a, spark) -> None:
    print(lumentrail.__version__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumentrail")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, f, *args: tuple) -> None:
        q = sub.add_parser(name)
        for flags, kw in args:
            q.add_argument(*flags.split(), **kw)
        q.set_defaults(run=f)

    one, many, out, stack = ("results", {}), ("results", {"nargs": "+"}), ("out", {}), ("--stack", {"required": True})
    number = lambda flag, d: (flag, {"type": type(d), "default": d})
    add("search", search, ("stack", {}), out, ("--config", {}), ("--width", {"type": int, "required": True}), ("--height", {"type": int, "required": True}), number("--ra", 0.0), number("--dec", 0.0), number("--scale", 1 / 3600))
    add("filter", filter_, one, out, number("--min-lh", 10.0), number("--min-obs", 10), ("--cluster", {}), number("--eps", 20.0), number("--last-dt", 1.0))
    add("merge", merge, out, many, number("--eps", 20.0), number("--last-dt", 1.0))
    add("stats", stats, one)
    add("stamps", stamps_, one, out, stack, number("--radius", 10), ("--kinds", {"nargs": "+", "default": ["sum"]}))
    add("strip", strip, one, out, number("--max-depth", 1), ("--keep", {"nargs": "*", "default": []}), ("--drop", {"nargs": "*", "default": []}), ("--all-null", {"action": "store_true"}))
    add("match", matcher, one, out, stack, ("--catalog", {"required": True}), number("--arcsec", 1.0), number("--seconds", 600.0))
    add("regions", regions_, ("images", {}), out, number("--arcmin", 60.0), number("--overlap", 0.0), number("--dec-min", -90.0), number("--dec-max", 90.0))
    add("test-data", test_data, out, number("--images", 10), number("--width", 64), number("--height", 64), number("--noise", 1.0), number("--objects", 3), number("--flux", 200.0), number("--seed", 0))
    add("version", version)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a, None if a.command == "version" else _session())


if __name__ == "__main__":
    main()
