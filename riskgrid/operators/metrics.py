"""Cluster-quality metrics over labelled points (AG7b, AG7c, AG9, AG10, ST3, FI9).

Everything is per-cluster sums: centroids by ``groupBy``, spreads by a join of the points with their centroid
(broadcast when their written table is small; else a shuffle that AQE splits), so the work is linear in the
points.  Davies-Bouldin looks for each centroid's worst neighbour on a grid that widens until no farther
centroid can be worse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.operators.cluster import global_rank
from riskgrid.session import Tables


def _xy(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn("_mx", F.col(x).cast("double")).withColumn("_my", F.col(y).cast("double"))


def _worst_neighbours(cent: DataFrame, by: list[str], tables: Tables) -> DataFrame:
    """``_i, _r``: max over j of (S_i + S_j) / d(c_i, c_j), without all pairs (0 between equal centroids).

    A centroid compared with all others up to a distance g is done when (S_i + S_max) / g is no more than
    what it has found; the others go on with a grid twice as wide, until it holds everything."""
    lim = cent.agg(F.min("_cx"), F.max("_cx"), F.min("_cy"), F.max("_cy"), F.max("_s"), F.count(F.lit(1))).first()
    if not lim[5]:
        return cent.select(*by, "_i", F.lit(None).cast("double").alias("_r"))
    x0, x1, y0, y1, s_max, k = lim
    extent = max(x1 - x0, y1 - y0)
    g = max(extent / max(1.0, k ** 0.5), 1e-9)
    todo, done = cent, None
    while True:
        whole = g >= extent
        at = {"_gx": F.floor((F.col("_cx") - F.lit(x0)) / g), "_gy": F.floor((F.col("_cy") - F.lit(y0)) / g)}
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        a = (todo.withColumns(at).withColumn("_n", F.explode(around))
             .withColumns({"_gx": F.col("_gx") + F.col("_n.i"), "_gy": F.col("_gy") + F.col("_n.j")}).drop("_n"))
        b = cent.withColumns(at).withColumnsRenamed({"_i": "_j", "_cx": "_bx", "_cy": "_by", "_s": "_bs"})
        d = F.sqrt((F.col("_cx") - F.col("_bx")) ** 2 + (F.col("_cy") - F.col("_by")) ** 2)
        found = (a.join(b, by + ["_gx", "_gy"]).where("_i <> _j").withColumn("_d", d)
                 .groupBy(*by, "_i").agg(F.max(F.when(F.col("_d") > 0, (F.col("_s") + F.col("_bs")) / F.col("_d")).otherwise(0.0))
                                         .alias("_r")))
        seen = tables.kept(todo.join(found, by + ["_i"], "left"))
        ready = F.lit(True) if whole else F.coalesce((F.col("_s") + F.lit(s_max)) / g <= F.col("_r"), F.lit(False))
        part = seen.where(ready).select(*by, "_i", "_r")
        done = part if done is None else done.unionByName(part)
        todo = seen.where(~ready).drop("_r")
        if whole or todo.limit(1).count() == 0:
            return done
        g *= 2


def centroid_metrics(points: DataFrame, label: str = "cluster", x: str = "longitude", y: str = "latitude",
                     by: list[str] | None = None) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin per ``by`` group (one row when ``by`` is empty).

    CH = [B / (k - 1)] / [W / (n - k)] (1.0 when W = 0); DB = mean_i max_j (S_i + S_j) / d(c_i, c_j).
    Both are null when k < 2 or k >= n."""
    by = list(by or [])
    p = _xy(points.filter(F.col(label).isNotNull()), x, y)
    cent = p.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_ni"), F.avg("_mx").alias("_cx"), F.avg("_my").alias("_cy"))
    tot = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_mx").alias("_ox"), F.avg("_my").alias("_oy"))
    k = cent.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    # within: squared distances and plain distances to the own centroid
    tables = Tables(points.sparkSession)
    cent = tables.kept(cent)
    pj = p.join(cent, by + [label])
    dx, dy = F.col("_mx") - F.col("_cx"), F.col("_my") - F.col("_cy")
    within = pj.groupBy(*by, label).agg(F.sum(dx * dx + dy * dy).alias("_w"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("_s"))
    cw = tables.kept(cent.join(within, by + [label]))
    between = cw.join(tot, by) if by else cw.crossJoin(F.broadcast(tot))
    bx, byy = F.col("_cx") - F.col("_ox"), F.col("_cy") - F.col("_oy")
    sums = between.groupBy(*by).agg(F.sum(F.col("_ni") * (bx * bx + byy * byy)).alias("B"), F.sum("_w").alias("W"))
    r = _worst_neighbours(cw.select(*by, F.col(label).alias("_i"), "_cx", "_cy", "_s"), by, tables)
    db = r.groupBy(*by).agg(F.avg("_r").alias("davies_bouldin"))
    out = tot.join(k, by) if by else tot.crossJoin(k)
    out = (out.join(sums, by) if by else out.crossJoin(sums))
    out = (out.join(db, by, "left") if by else out.crossJoin(db))
    ok = (F.col("k") >= 2) & (F.col("k") < F.col("n"))
    ch = F.when(F.col("W") == 0, F.lit(1.0)).otherwise((F.col("B") / (F.col("k") - 1)) / (F.col("W") / (F.col("n") - F.col("k"))))
    out = tables.result(out.select(*by, "n", "k", F.when(ok, ch).alias("calinski_harabasz"),
                                   F.when(ok, F.col("davies_bouldin")).alias("davies_bouldin")))
    tables.drop()
    return out


def top_labels(labelled: DataFrame, label: str = "label_all", n: int | None = None) -> DataFrame:
    """AG10 + ST3: distinct non-noise labels ascending with their rank (first ``n`` when given)."""
    d = labelled.filter(F.col(label) != -1).select(F.col(label).alias("label")).distinct()
    if n:
        # the n smallest: a top-n, not a sort of all labels in one task
        return d.orderBy("label").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("label")))
    tables = Tables(labelled.sparkSession)
    out = tables.result(global_rank(d, ["label"], "rank", tables).withColumn("rank", F.col("rank") + 1))
    tables.drop()
    return out


def metric_sweep(points_all: DataFrame, n_values=range(2, 11), label_all: str = "label_all",
                 label: str = "cluster") -> DataFrame:
    """AG9: for each n, the points whose all-points label is among the first n labels (FI9),
    scored on their per-user labels; one job with ``n`` as a group key."""
    ranks = top_labels(points_all, label_all, max(n_values)).withColumnRenamed("label", label_all)
    p = points_all.join(F.broadcast(ranks), label_all)        # at most max(n_values) rows
    ns = F.array(*[F.lit(v) for v in n_values])
    p = p.withColumn("n_clusters", F.explode(F.filter(ns, lambda v: v >= F.col("rank"))))
    return centroid_metrics(p, label=label, by=["n_clusters"])
