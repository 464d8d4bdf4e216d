"""The spring window: features, codebook by months, clustered days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from freshet.operators import som
from freshet.operators.columns import complete_cases, drop_listed, leading
from freshet.operators.ordered import row_numbers
from freshet.operators.reshape import bind_rows
from freshet.operators.scaling import min_max
from freshet.plans.daily import compiled
from freshet.operators.sizing import grid_from_data
from freshet.plans.sweep import GRID_SCHEMA, best_runs, read_grid, sweep
from freshet.session import shared_dir
from freshet.sources import files
from freshet.sources.stages import stage, stage_once

WINDOW = (170, 245)  # days of the water year
SITE = "WB"  # drivers are the same at both sites, so one is clustered

# columns that describe the row or respond to the drivers
INFO = ["site", "wyear", "date", "doy_wyear", "q_mm", "q_mm_cum", "q_mm_per", "precip_mm_cum", "precip_mm_per"]
# other columns left out of the clustering
UNUSED = ["temp_max", "temp_min", "temp_avg", "use_snow_mm_daily", "use_total_mm_daily", "use_total_mm_cum"]
FEATURES = ["precip_mm", "precip_mm_3d", "snow_dep_m", "temp_avg_vwc", "temp_avg_vwc_3d", "pyra_wattm2_dailyTot"]


def in_window(daily: DataFrame, first: int = WINDOW[0], last: int = WINDOW[1]) -> DataFrame:
    return daily.where(F.col("doy_wyear").between(first, last))


def features(spark: SparkSession, folder: str, window: tuple[int, int] = WINDOW) -> DataFrame:
    """date and the six drivers of one site's spring days without missing drivers."""
    days = in_window(compiled(spark, folder), *window).where(F.col("site") == SITE)
    kept = drop_listed(days, [c for c in INFO if c != "date"], UNUSED)
    return complete_cases(kept, FEATURES).select("date", *FEATURES)


def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    return stage_once(spark, folder, "features", lambda: min_max(features(spark, folder), FEATURES))


def month_codebook(spark: SparkSession, folder: str) -> DataFrame:
    """run, node, gx, gy, w, cluster: one node per spring month, at the mean of its scaled days.

    Years run down the lattice and months across it; the cluster is the month's
    place in spring. A codebook that SQL can reproduce, used to score and map days.
    """
    scaled = scaled_features(spark, folder)
    dated = scaled.withColumns({"year": F.year("date"), "month": F.month("date")})
    means = dated.groupBy("year", "month").agg(*[F.avg(c).alias(c) for c in FEATURES])
    node = F.row_number().over(Window.partitionBy("run").orderBy("year", "month")).cast("int")
    across, down = F.col("month") - 2, F.col("year") - 1994
    return means.withColumn("run", F.lit(1)).select(
        "run",
        node.alias("node"),
        (across + (down % 2) * 0.5).alias("gx"),
        (down * (3**0.5 / 2)).alias("gy"),
        F.array(*FEATURES).alias("w"),
        (F.col("month") - 2).cast("int").alias("cluster"),
    )


def codebook(spark: SparkSession, folder: str) -> DataFrame:
    return stage_once(spark, folder, "codebook", lambda: month_codebook(spark, folder))


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    """date, scaled drivers, run, node, dist."""
    build = lambda: som.assign(scaled_features(spark, folder), FEATURES, codebook(spark, folder))
    return stage_once(spark, folder, "assigned", build)


def day_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """date, cluster of every clustered day."""
    nodes = codebook(spark, folder).select("run", "node", "cluster")
    return assigned(spark, folder).join(nodes, ["run", "node"]).select("date", "cluster")


def attach(days: DataFrame, clusters: DataFrame, version: str) -> DataFrame:
    """Cluster labels put back on the full rows of both sites by date, tagged with the version."""
    both = clusters.join(days, "date", "left")
    kept = drop_listed(both, UNUSED).withColumn("SOMversion", F.lit(version))
    return leading(kept, ["SOMversion", "site", "wyear", "date", "doy_wyear", "cluster", "q_mm", "q_mm_cum"])


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of the clustered spring days: with four clusters, and with the last two merged."""

    def build() -> DataFrame:
        days = in_window(compiled(spark, folder))
        four = day_clusters(spark, folder)
        three = four.withColumn("cluster", F.least("cluster", F.lit(3)))
        return bind_rows(attach(days, three, "3cl"), attach(days, four, "4cl"))

    return stage_once(spark, folder, "clustered", build)


def four_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(spark, folder).where(F.col("SOMversion") == "4cl")


def numbered_features(spark: SparkSession, folder: str) -> DataFrame:
    """Drivers with an observation number in date order, numbered by year so that no task orders all rows."""
    dated = features(spark, folder).withColumn("_year", F.year("date"))
    return row_numbers(dated, [], ["date"], "obs", chunk="_year").drop("_year")


# --- the sweep and what follows from it --------------------------------------

CLUSTERS = (3, 4, 5)
TRIES = 2  # runs of every lattice and number of clusters, from other starts


def grid_file(spark: SparkSession, folder: str) -> str:
    """The parameter grid of the sweep, with the lattices that suit the spring days, as a CSV file in the shared folder; its path.

    Rates, iterations and numbers of clusters are those of the published sweep.
    """
    sizes = grid_from_data(features(spark, folder), FEATURES)
    every = sizes.select("*", F.explode(F.array(*map(F.lit, CLUSTERS))).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.lit(TRIES))).alias("try"))
    numbered = every.withColumn("myRun", F.row_number().over(Window.orderBy("k", "try", "place")).cast("int"))
    fixed = {"myDataSet": "bothSites", "myTopo": "hexagonal", "normMeth": "L2norm", "wghtMeth": "noPCA", "niter": 1500, "crsAlpha": 0.05, "finAlpha": 0.01}
    grid = numbered.withColumns({c: F.lit(v) for c, v in fixed.items()}).withColumnsRenamed({"k": "nClusters", "col_row_ratio": "colRowRatio"})
    path = shared_dir(spark, "grid")
    files.write_csv(grid.select(*StructType.fromDDL(GRID_SCHEMA).names), path)
    return path


def swept(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(scores, assignments) of every run of the grid file on the spring days, trained once per session."""
    made: dict[str, DataFrame] = {}

    def train(which: str) -> DataFrame:
        if not made:
            grid = read_grid(files.read_csv(spark, grid_file(spark, folder), GRID_SCHEMA))
            made["scores"], made["assignments"] = sweep(features(spark, folder), "date", FEATURES, grid)
        return made[which]

    scores = stage_once(spark, folder, "sweep-scores", lambda: train("scores"))
    return scores, stage_once(spark, folder, "sweep-assignments", lambda: train("assignments"))


def swept_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every number of clusters from its own best run, attached to the days of both sites.

    Labels are given in order of the clusters' mean temperature, the coldest first.
    """
    scores, found = swept(spark, folder)
    chosen = best_runs(scores).select("run", "clusters")
    labelled = found.join(chosen, "run").join(features(spark, folder).select("date", "temp_avg_vwc"), "date")
    warmth = labelled.groupBy("clusters", "cluster").agg(F.avg("temp_avg_vwc").alias("_t"))
    by_warmth = Window.partitionBy("clusters").orderBy("_t", "cluster")
    names = warmth.select("clusters", "cluster", F.row_number().over(by_warmth).cast("int").alias("label"))
    labelled = stage(labelled.join(names, ["clusters", "cluster"]).select("clusters", "date", F.col("label").alias("cluster")), "swept")
    days = in_window(compiled(spark, folder))
    versions = [r[0] for r in chosen.select("clusters").orderBy("clusters").collect()]
    return bind_rows(*[attach(days, labelled.where(F.col("clusters") == k).select("date", "cluster"), f"{k}cl") for k in versions])
