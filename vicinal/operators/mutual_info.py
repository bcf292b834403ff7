"""Mutual information between continuous features and a class label.

``mutual_info`` is the nearest-neighbour estimator of Ross (2014). Equal values are counted once with
their multiplicity, and a point whose neighbours all coincide with it uses the mixture rule of Gao et
al. (2017), so a value shared by a third of all rows costs one row per class. Long features are cut
into runs of bounded length, so no task ever holds a whole feature.

``mutual_info_binned`` is the cheap companion: equal-frequency bins and a contingency table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.digamma import digamma
from vicinal.operators.labels import class_sizes
from vicinal.operators.validate import finite
from vicinal.session import materialize, parallelism

NEIGHBORS = 3
RADIUS_ROUNDING, VALUE_ROUNDING = 1e-9, 1e-15
RUN_ROWS = 2_000_000  # rows of one feature that a single task may walk through
TASK_ROWS = 50_000  # rows that are worth a task of their own


def range_tasks(rows: int, runs: int, cores: int) -> int:
    """Range partitions for ``runs`` runs over so many rows: short runs share a task, which walks through them one by one.

    A task costs the driver some kilobytes and a part of the range sample, so their number follows the rows, not the runs.
    """
    return max(1, min(runs, max(cores, math.ceil(rows / TASK_ROWS))))


def value_counts(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(pos, v, y, c): how often each class has each value of each feature."""
    long = df.select(F.col(label).alias("y"), F.posexplode_outer(finite(F.col(features))).alias("pos", "v"))
    # +0.0 turns a negative zero into zero
    return long.groupBy("pos", (F.col("v") + F.lit(0.0)).alias("v"), "y").agg(F.count("*").alias("c"))


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, out: str, runs: int = 1
) -> DataFrame:
    """Running sum of ``weight`` per group in the given order, including the row itself.

    With ``runs`` > 1 the rows are range-partitioned first; each run adds up on its own and gets the
    total of the runs before it. The partitioning is materialised, because run numbers must not change
    when a lost task is computed again.
    """
    if runs <= 1:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(weight).over(window))
    spread = materialize(
        df.withColumn("__w", weight)
        .repartitionByRange(runs, *group, *order)
        .withColumn("__run", F.spark_partition_id())
    )
    within = Window.partitionBy(*group, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy(*group, "__run").agg(F.sum("__w").alias("__t"))
    offsets = totals.select(*group, "__run", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    return (
        spread.withColumn("__within", F.sum("__w").over(within))
        .join(offsets, [*group, "__run"])
        .withColumn(out, F.col("__within") + F.col("__before"))
        .drop("__w", "__run", "__within", "__before")
    )


def _with_neighbors(counts: DataFrame, kk: int, runs: int, run_rows: int) -> DataFrame:
    """Add distances to the ``kk`` preceding and following values of the same class, and their counts."""
    keys = ["pos", "y"]
    if runs > 1:
        # consecutive numbers cut each feature into runs of equal length; rows next to a cut are also
        # sent to the neighbouring run, so that every row meets its neighbours
        numbered = running_total(counts, ["pos", "y"], ["v"], F.lit(1), "nth", runs)
        run = F.floor(F.col("nth") / run_rows).cast("int")
        place = F.col("nth") % run_rows
        copies = F.array_compact(
            F.array(run, F.when(place < kk, run - 1), F.when(place >= run_rows - kk, run + 1))
        )
        counts = numbered.withColumn("home", run).withColumn("run", F.explode_outer(copies))
        keys.append("run")
    else:
        # every later step groups by feature and something else, so this is the last shuffle
        counts = counts.repartition("pos")
    window = Window.partitionBy(*keys).orderBy("v")
    own = F.col("v")
    for i in range(1, kk + 1):
        counts = (
            counts.withColumn(f"d_lo{i}", F.coalesce(own - F.lag("v", i).over(window), F.lit(math.inf)))
            .withColumn(f"c_lo{i}", F.lag("c", i, 0).over(window))
            .withColumn(f"d_hi{i}", F.coalesce(F.lead("v", i).over(window) - own, F.lit(math.inf)))
            .withColumn(f"c_hi{i}", F.lead("c", i, 0).over(window))
        )
    return counts.filter(F.col("run") == F.col("home")).drop("run", "home", "nth") if runs > 1 else counts


def _radius(kk: int) -> Column:
    """Distance to the kk-th other row of the class; zero if enough rows share the value.

    The smallest of the neighbouring distances within which enough rows lie: on the same side these are
    the rows up to the neighbour, on the other side those that are not farther away.
    """
    same = F.col("c") - 1
    reaching = []
    for side, other in (("lo", "hi"), ("hi", "lo")):
        rows = same
        for i in range(1, kk + 1):
            d = F.col(f"d_{side}{i}")
            rows = rows + F.col(f"c_{side}{i}")
            across = rows
            for j in range(1, kk + 1):
                across = across + F.when(F.col(f"d_{other}{j}") <= d, F.col(f"c_{other}{j}")).otherwise(0)
            reaching.append(F.when(across >= F.col("kk"), d).otherwise(F.lit(math.inf)))
    return F.when(same >= F.col("kk"), 0.0).otherwise(F.least(*reaching))


def _half_width() -> Column:
    """How far the open interval of radius r reaches.

    Rows exactly at the radius do not count. On a lattice such as 0.1, 0.2, 0.3 equal distances come out
    of the subtraction unequal in the last bits, so the interval ends a rounding error short of r.
    """
    r = F.col("r")
    return F.greatest(r - (r * RADIUS_ROUNDING + F.abs("v") * VALUE_ROUNDING), r / 2)


def mutual_info(
    df: DataFrame,
    names: Sequence[str],
    *,
    neighbors: int = NEIGHBORS,
    features: str = "features",
    label: str = "label",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """(feature, score) in nats, clipped at 0. Classes with a single row are left out."""
    return _scores(value_counts(df, features, label), class_sizes(df, label), names, neighbors, run_rows)


def counted_classes(counts: DataFrame) -> dict[int, int]:
    """Rows per class. Every row has every feature, so those of the first feature tell."""
    return {r["y"]: r["n"] for r in counts.where("pos = 0").groupBy("y").agg(F.sum("c").alias("n")).collect()}


def mutual_info_from_counts(counts: DataFrame, names: Sequence[str], *, neighbors: int = NEIGHBORS, run_rows: int = RUN_ROWS) -> DataFrame:
    """``mutual_info`` of the rows that ``counts`` (pos, v, y, c) was counted from, without the rows."""
    return _scores(counts, counted_classes(counts), names, neighbors, run_rows)


def _scores(counts: DataFrame, classes: dict[int, int], names: Sequence[str], neighbors: int, run_rows: int) -> DataFrame:
    sizes = {y: size for y, size in classes.items() if size > 1}
    n = sum(sizes.values())
    if not n:
        raise ValueError("no class has two rows")
    runs = math.ceil(n / run_rows)
    runs = 1 if runs == 1 else max(2, range_tasks(n * len(names), runs * len(names), parallelism(counts.sparkSession)))
    size_of = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    counts = counts.filter(F.col("y").isin(*sizes))
    counts = counts.withColumn("kk", F.least(F.lit(neighbors), F.element_at(size_of, F.col("y")) - 1))

    points = _with_neighbors(counts, neighbors, runs, run_rows).withColumn("r", _radius(neighbors))
    alone = F.col("r") > 0
    points = points.select(
        "pos",
        "v",
        "y",
        "c",
        F.when(alone, F.col("kk")).otherwise(F.col("c")).alias("near"),
        F.when(alone, F.col("v") - _half_width()).otherwise(F.col("v")).alias("lo"),
        F.when(alone, F.col("v") + _half_width()).otherwise(F.col("v")).alias("hi"),
        alone.alias("open"),
    )
    # Rows strictly between lo and hi: the running count of rows read off at both ends. At equal
    # positions the order of events says whether the end itself counts: it does not for an open
    # interval; for radius zero the interval is the value itself.
    none = F.lit(None)
    event = F.explode_outer(
        F.array(
            F.struct(F.col("v").alias("x"), F.lit(1).alias("kind"), F.col("c").alias("w"), F.lit(0).alias("sign")),
            F.struct(F.col("hi").alias("x"), F.when(F.col("open"), 0).otherwise(2).alias("kind"),
                     none.cast("bigint").alias("w"), F.lit(1).alias("sign")),
            F.struct(F.col("lo").alias("x"), F.when(F.col("open"), 2).otherwise(0).alias("kind"),
                     none.cast("bigint").alias("w"), F.lit(-1).alias("sign")),
        )
    )
    events = points.select("pos", "v", "y", "c", "near", event.alias("e")).select("pos", "v", "y", "c", "near", "e.*")
    counted = running_total(events, ["pos"], ["x", "kind"], F.coalesce("w", F.lit(0)), "upto", runs)
    inside = (
        counted.filter(F.col("sign") != 0)
        .groupBy("pos", "v", "y")
        .agg(F.sum(F.col("sign") * F.col("upto")).alias("m"), F.first("c").alias("c"), F.first("near").alias("near"))
    )
    per_class = digamma(F.element_at(size_of, F.col("y")))
    gain = F.sum(F.col("c") * (digamma(F.col("near")) - digamma(F.col("m")) - per_class)) / n
    scores = inside.groupBy("pos").agg((gain + digamma(F.lit(n))).alias("raw"))
    return scores.select(
        F.element_at(F.lit(list(names)), F.col("pos") + 1).alias("feature"),
        F.greatest(F.col("raw"), F.lit(0.0)).alias("score"),
    )


def mutual_info_binned(
    df: DataFrame,
    names: Sequence[str],
    bins: int = 10,
    *,
    features: str = "features",
    label: str = "label",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """(feature, score) from equal-frequency bins. Equal values always share a bin."""
    return binned_from_counts(value_counts(df, features, label), names, df.count(), bins, run_rows=run_rows)


def binned_from_counts(counts: DataFrame, names: Sequence[str], n: int, bins: int = 10, *, run_rows: int = RUN_ROWS) -> DataFrame:
    """``mutual_info_binned`` of the ``n`` rows that ``counts`` (pos, v, y, c) was counted from."""
    runs = math.ceil(n / run_rows)
    runs = 1 if runs == 1 else max(2, range_tasks(n * len(names), runs * len(names), parallelism(counts.sparkSession)))
    values = (
        counts.groupBy("pos", "v")
        .agg(F.sum("c").alias("c"), F.collect_list(F.struct("y", "c")).alias("classes"))  # one entry per class
    )
    ranked = running_total(values, ["pos"], ["v"], F.col("c"), "upto", runs)
    bin_no = F.floor((F.col("upto") - F.col("c")) * bins / n)
    cells = (
        ranked.select("pos", bin_no.alias("bin"), F.explode_outer("classes").alias("k"))
        .groupBy("pos", "bin", F.col("k.y").alias("y"))
        .agg(F.sum("k.c").alias("c"))
    )
    return scores_of_bins(cells, names, n)


def scores_of_bins(cells: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """(feature, score) of a contingency table (pos, bin, y, c) over ``n`` rows."""
    by_bin = Window.partitionBy("pos", "bin")
    by_class = Window.partitionBy("pos", "y")
    joint = cells.withColumn("bin_n", F.sum("c").over(by_bin)).withColumn("class_n", F.sum("c").over(by_class))
    term = F.col("c") / n * F.log(F.col("c") * F.lit(float(n)) / (F.col("bin_n") * F.col("class_n")))
    return joint.groupBy("pos").agg(F.sum(term).alias("raw")).select(
        F.element_at(F.lit(list(names)), F.col("pos") + 1).alias("feature"),
        F.greatest(F.col("raw"), F.lit(0.0)).alias("score"),
    )
