"""Recovery trend: local quadratic smoother of IS recovery over acquisition order.

The QC report draws a smooth curve through (position, recovery) with the
plotting library's default smoother for small data: local regression of
degree 2, span 0.75, tricube weights, evaluated at 80 evenly spaced points
(Cleveland & Devlin 1988). ``recovery_trend`` evaluates that local fit directly
at the 80 points; ``recovery_curve`` does what the plot does: it fits at the
vertices of interval cells only, and blends between them (Cleveland & Grosse
1991). Missing or infinite recoveries are dropped first and the others keep
their positions.

Definition, per batch with m finite points x_1 < ... < x_m, q = floor(0.75 m):
* grid v_0..v_79: v_0 = min x, v_79 = max x, v_j = min + j * ((max - min) / 79);
* at a place v, h = the q-th smallest |x_i - v|; u = (x - v) / h;
  w = (1 - |u|^3)^3 for |u| < 1, else 0;
* weighted least squares of y on (1, u, u^2); the fit at v is the intercept, its
  slope the linear coefficient / h (closed-form 3x3 solve); NULL when h = 0 or
  the system is singular;
* cells: the interval from min x to max x, widened by ``MARGIN`` of its length,
  is cut halfway between its middle points until a cell has at most
  floor(m * 0.75 * ``CELL``) points (one at least); the cuts and the two ends are
  the vertices, and inside a cell the curve is the cubic that has the fits and
  slopes of its two vertices.
Batches with fewer than two finite points get no curve.

Scale: the q nearest points of v are the ranks [s, s + q - 1] with
s = 1 + #{r <= m - q : x_r + x_(r+q) < 2 v}. For the grid that count is a histogram
(partial aggregation) of each pair sum's grid index, which is computed
arithmetically; for the vertices (17 at most, from the number of points alone) it
is a grouped count. Each point then joins the places whose window holds it
(~60 of the grid, ~12 vertices), and the weighted moments are partial aggregates
per (batch, place). No task holds a whole batch: a hot batch is split in the
joins (``split_hot_batches``), and the per-batch tables have 80 rows or fewer.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrix.functions.sequence import rank_positions
from calibrix.session import materialize, split_hot_batches

# The smoother's defaults in the QC report, and the widening of
# its interval.
SPAN, GRID_POINTS = 0.75, 80
CELL, MARGIN = 0.2, 0.005
# Relative determinant below which the local 3x3 system counts as singular.
SINGULAR_TOL = 1e-10


def _grid_value(j, xmin, xmax, last: int):
    step = (xmax - xmin) / F.lit(float(last))
    return (F.when(j == 0, xmin).when(j == last, xmax).otherwise(xmin + j * step))


def _points(samples: DataFrame) -> DataFrame:
    """BatchID, x (position), y, r (rank among the batch's finite recoveries),
    written once: the smoother reads it from several branches."""
    split_hot_batches(samples.sparkSession)
    y = F.col("IS_Recovery")
    finite = y.isNotNull() & (F.abs(y) != F.lit(float("inf")))
    base = materialize(samples.select("BatchID", "RowIndex", "IS_Recovery"))
    # Order over all samples and rank r over the finite ones, in one pass.
    ranked = rank_positions(base, ["BatchID"], "RowIndex", "Order", flag=finite, flag_name="r")
    pts = ranked.filter(F.col("r").isNotNull()).select(
        "BatchID", F.col("Order").cast("double").alias("x"), y.alias("y"), "r")
    # The point table feeds several branches and a 60-fold explode: spread it over
    # at least the cluster's cores, keyed so one batch spans many partitions.
    spark = samples.sparkSession
    n_parts = max(spark.sparkContext.defaultParallelism, base.rdd.getNumPartitions())
    return materialize(pts.repartition(n_parts, "BatchID", "r"))


def _stats(pts: DataFrame, span: float, last: int) -> DataFrame:
    return (pts.groupBy("BatchID")
            .agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("xmin"), F.max("x").alias("xmax"))
            .filter(F.col("m") >= 2)
            .withColumn("q", F.floor(F.col("m") * F.lit(span)).cast("long"))
            .withColumn("step", (F.col("xmax") - F.col("xmin")) / F.lit(float(last))))


def _pair_sums(pts: DataFrame, stats: DataFrame) -> DataFrame:
    """x_r + x_(r+q) of each rank r <= m - q, with the batch's grid."""
    left = pts.join(stats.select("BatchID", "q"), "BatchID")
    right = pts.select("BatchID", F.col("r").alias("r2"), F.col("x").alias("x2"))
    pairs = left.join(right, (left.BatchID == right.BatchID) &
                      (left.r + left.q == right.r2)).select(
        left.BatchID, (F.col("x") + F.col("x2")).alias("ps"))
    return pairs.join(stats.select("BatchID", "xmin", "xmax", "step"), "BatchID")


def _local_fits(pts: DataFrame, places: DataFrame) -> DataFrame:
    """BatchID, j, fitted and slope at the places (BatchID, j, v, s, q); a place
    without a fit has no row or NULLs."""
    # Bandwidth: the farther of the window's two ends.
    ends = places.select("BatchID", "j", "v", "s", "q", F.explode(F.array("s", F.col("s") + F.col("q") - 1)).alias("r"))
    h = (ends.join(pts.select("BatchID", "r", "x"), ["BatchID", "r"])
         .groupBy("BatchID", "j", "v", "s", "q").agg(F.max(F.abs(F.col("x") - F.col("v"))).alias("h")))
    # Each point meets the places whose window [s, s + q - 1] holds it (an
    # equi-join on the batch with a range condition on the rank).
    g = h.filter(F.col("h") > 0).withColumn("s_end", F.col("s") + F.col("q") - 1).alias("g")
    pj = pts.alias("p").join(g, (F.col("p.BatchID") == F.col("g.BatchID")) &
                             (F.col("p.r") >= F.col("g.s")) & (F.col("p.r") <= F.col("g.s_end")))
    pj = pj.select(F.col("p.BatchID").alias("BatchID"), "x", "y", "j", "v", "h")
    u = (F.col("x") - F.col("v")) / F.col("h")
    pj = pj.withColumn("u", u).withColumn("a", F.abs(F.col("u")))
    t = F.lit(1.0) - F.col("a") * F.col("a") * F.col("a")
    pj = pj.withColumn("w", F.when(F.col("a") < 1.0, t * t * t).otherwise(F.lit(0.0)))
    wu = F.col("w") * F.col("u")
    wu2 = wu * F.col("u")
    wu3 = wu2 * F.col("u")
    wu4 = wu3 * F.col("u")
    mom = pj.groupBy("BatchID", "j").agg(
        F.max("h").alias("h"), F.sum("w").alias("S0"), F.sum(wu).alias("S1"), F.sum(wu2).alias("S2"),
        F.sum(wu3).alias("S3"), F.sum(wu4).alias("S4"),
        F.sum(F.col("w") * F.col("y")).alias("T0"), F.sum(wu * F.col("y")).alias("T1"),
        F.sum(wu2 * F.col("y")).alias("T2"))
    s0, s1, s2, s3, s4 = (F.col(c) for c in ("S0", "S1", "S2", "S3", "S4"))
    t0, t1, t2 = (F.col(c) for c in ("T0", "T1", "T2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    det_a = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    det_b = s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)
    solvable = (s0 > 0) & (det > F.lit(SINGULAR_TOL) * s0 * s0 * s0)
    return mom.select("BatchID", "j", F.when(solvable, det_a / det).alias("fitted"),
                      F.when(solvable, det_b / det / F.col("h")).alias("slope"))


def recovery_trend(samples: DataFrame, span: float = SPAN,
                   n_grid: int = GRID_POINTS) -> DataFrame:
    """BatchID, grid_index (1..80), Order (grid position), IS_Recovery_Trend: the
    local fit at each grid point.

    ``samples``: quantified samples with BatchID, RowIndex and IS_Recovery.
    """
    last = n_grid - 1
    pts = _points(samples)
    stats = _stats(pts, span, last)
    pairs = _pair_sums(pts, stats)

    # s_j from the pair sums: k = #{j : 2 v_j <= pair sum} is found arithmetically
    # (the grid is evenly spaced) and corrected by one step against the exact
    # grid values; a histogram of k gives every s_j.
    xmin, xmax, ps = F.col("xmin"), F.col("xmax"), F.col("ps")

    def twice_v(j):
        return F.lit(2.0) * _grid_value(j, xmin, xmax, last)

    guess = F.floor((ps / F.lit(2.0) - xmin) / F.col("step")).cast("int") + F.lit(1)
    k0 = F.least(F.greatest(guess, F.lit(0)), F.lit(n_grid))
    pairs = pairs.withColumn("k0", k0)
    k = (F.when((F.col("k0") > 0) & (twice_v(F.col("k0") - 1) > ps), F.col("k0") - 1)
         .when((F.col("k0") < n_grid) & (twice_v(F.col("k0")) <= ps), F.col("k0") + 1)
         .otherwise(F.col("k0")))
    hist = (pairs.select("BatchID", k.alias("k"))
            .groupBy("BatchID", "k").agg(F.count(F.lit(1)).alias("cnt")))

    grid = _grid(stats, last)
    upto = Window.partitionBy("BatchID").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    grid = (grid.join(hist.withColumnRenamed("k", "j"), ["BatchID", "j"], "left")
            .withColumn("s", F.lit(1) + F.sum(F.coalesce(F.col("cnt"), F.lit(0))).over(upto))
            .select("BatchID", "j", "v", "s", "q"))
    out = grid.select("BatchID", "j", "v").join(_local_fits(pts, grid), ["BatchID", "j"], "left")
    return out.select("BatchID", (F.col("j") + 1).cast("long").alias("grid_index"),
                      F.col("v").alias("Order"), F.col("fitted").alias("IS_Recovery_Trend"))


def _grid(stats: DataFrame, last: int) -> DataFrame:
    grid = stats.select("BatchID", "q", "xmin", "xmax", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j"))
    return grid.withColumn("v", _grid_value(F.col("j"), F.col("xmin"), F.col("xmax"), last))


def _vertices(pts: DataFrame, stats: DataFrame, share: float, margin: float) -> DataFrame:
    """BatchID, q, j, v: the ends of the cells, from left to right. Where a cell
    is cut depends on its number of points alone, so the ranks on both sides of
    every cut come from m; only those points are looked up."""
    most = F.greatest(F.lit(1), F.floor(F.col("m") * F.lit(share))).cast("long")
    known = stats.withColumn("most", most)
    cells = F.array(F.struct(F.lit(1).cast("long").alias("lo"), F.col("m").alias("hi")))

    def halves(c):
        mid = F.floor((c["lo"] + c["hi"]) / 2).cast("long")
        return F.when(c["hi"] - c["lo"] < F.col("most"), F.array(c)).otherwise(
            F.array(F.struct(c["lo"].alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), c["hi"].alias("hi"))))

    # m / most stays below 2 / share; halves of odd cells cost one level more.
    for _ in range(ceil(log2(2 / share)) + 1):
        cells = F.flatten(F.transform(cells, halves))
    known = known.withColumn("cells", cells)
    cuts = known.select("BatchID", F.posexplode(F.expr("transform(slice(cells, 1, size(cells) - 1), c -> c.hi)"))
                        .alias("at", "rank"))
    cuts = cuts.select("BatchID", (F.col("at") + 1).alias("j"), F.explode(F.array("rank", F.col("rank") + 1)).alias("r"))
    cuts = (cuts.join(pts.select("BatchID", "r", "x"), ["BatchID", "r"])
            .groupBy("BatchID", "j").agg((F.sum("x") / 2).alias("v")))
    reach = F.greatest(F.col("xmax") - F.col("xmin"),
                       F.greatest(F.abs("xmin"), F.abs("xmax")) * F.lit(1e-3) + F.lit(1e-30)) * F.lit(margin)
    ends = known.select("BatchID", F.explode(F.array(
        F.struct(F.lit(0).alias("j"), (F.col("xmin") - reach).alias("v")),
        F.struct(F.size("cells").alias("j"), (F.col("xmax") + reach).alias("v")))).alias("e")).select("BatchID", "e.*")
    return cuts.union(ends).join(stats.select("BatchID", "q"), "BatchID")


def recovery_curve(samples: DataFrame, span: float = SPAN, n_grid: int = GRID_POINTS, cell: float = CELL,
                   margin: float = MARGIN) -> DataFrame:
    """BatchID, grid_index (1..80), Order (grid position), IS_Recovery_Curve: the
    plotted curve, fitted at the cells' vertices and blended between them."""
    last = n_grid - 1
    pts = _points(samples)
    stats = _stats(pts, span, last)
    vertices = materialize(_vertices(pts, stats, span * cell, margin))
    before = (_pair_sums(pts, stats).select("BatchID", "ps").join(vertices.select("BatchID", "j", "v"), "BatchID")
              .filter(F.col("ps") < F.lit(2.0) * F.col("v")).groupBy("BatchID", "j").agg(F.count(F.lit(1)).alias("cnt")))
    places = vertices.join(before, ["BatchID", "j"], "left").select(
        "BatchID", "j", "v", (F.lit(1) + F.coalesce("cnt", F.lit(0))).alias("s"), "q")
    fits = vertices.select("BatchID", "j", "v").join(_local_fits(pts, places), ["BatchID", "j"], "left")
    right = Window.partitionBy("BatchID").orderBy("j")  # 17 rows at most
    cells = fits.select("BatchID", F.col("v").alias("v0"), F.col("fitted").alias("g0"), F.col("slope").alias("d0"), *(
        F.lead(c).over(right).alias(n) for c, n in (("v", "v1"), ("fitted", "g1"), ("slope", "d1"))))
    grid = _grid(stats, last).select("BatchID", "j", "v").join(cells, "BatchID").filter(
        (F.col("v") > F.col("v0")) & (F.col("v") <= F.col("v1")))
    width = F.col("v1") - F.col("v0")
    t = (F.col("v") - F.col("v0")) / width
    blended = ((1 - t) * (1 - t) * (1 + 2 * t) * F.col("g0") + t * t * (3 - 2 * t) * F.col("g1")
               + (t * (1 - t) * (1 - t) * F.col("d0") - t * t * (1 - t) * F.col("d1")) * width)
    return grid.select("BatchID", (F.col("j") + 1).cast("long").alias("grid_index"), F.col("v").alias("Order"),
                       blended.alias("IS_Recovery_Curve"))
