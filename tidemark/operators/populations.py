"""Population operators: co-firing, reactivation, decoding, cluster quality, states."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .unit_pairs import correlation_of_correlations

MOST_UNITS = 4096


def dense_zscores(counts: DataFrame, first: int, bins: int) -> DataFrame:
    """(unit, bin, z) of counts (unit, bin, n) over bins first..first+bins-1, absent ones as 0.

    Mean and deviation come from the counts that are there, so only the result
    is dense. Units of constant count are left out.
    """
    inside = counts.where(F.col("bin").between(first, first + bins - 1))
    s, q = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    moments = inside.groupBy("unit").agg((s / bins).alias("_m"), F.sqrt((q - s * s / bins) / (bins - 1)).alias("_s")).where("_s > 0")
    cells = moments.withColumn("bin", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + bins - 1).cast("bigint"))))
    full = cells.join(inside, ["unit", "bin"], "left")
    return full.select("unit", "bin", ((F.coalesce("n", F.lit(0)) - F.col("_m")) / F.col("_s")).alias("z"))


def template(z: DataFrame, bins: int) -> DataFrame:
    """(a, b, w) of each pair a < b: the correlation of their scores."""
    x = z.select(F.col("unit").alias("a"), "bin", F.col("z").alias("za"))
    y = z.select(F.col("unit").alias("b"), "bin", F.col("z").alias("zb"))
    return x.join(y, "bin").where("a < b").groupBy("a", "b").agg((F.sum(F.col("za") * F.col("zb")) / (bins - 1)).alias("w"))


def reactivation(z: DataFrame, pairs: DataFrame) -> DataFrame:
    """(bin, strength): how well each bin agrees with a template without its diagonal."""
    x = z.select(F.col("unit").alias("a"), "bin", F.col("z").alias("za"))
    y = z.select(F.col("unit").alias("b"), "bin", F.col("z").alias("zb"))
    return x.join(pairs, "a").join(y, ["b", "bin"]).groupBy("bin").agg((2 * F.sum(F.col("za") * F.col("w") * F.col("zb"))).alias("strength"))


def cofiring(a: DataFrame, bins_a: int, b: DataFrame, bins_b: int) -> DataFrame:
    """Correlation of the pairwise correlations in two epochs, with ``n`` pairs."""
    return correlation_of_correlations(a, bins_a, b, bins_b)


def decode(rates: DataFrame, counts: DataFrame, width: float, bins: int) -> DataFrame:
    """Posterior over places: (window, x, p), flat prior, for windows with any point.

    ``rates`` is (unit, x, rate), ``counts`` (window, unit, n). The log
    likelihood is the sum of n log(width rate) - width rate; factors that do
    not depend on the place cancel. A rate of 0 counts as a millionth.
    """
    rate = F.greatest(F.col("rate"), F.lit(1e-6)) * width
    known = rates.select("unit", "x", F.log(rate).alias("_l"), rate.alias("_r"))
    silent = known.groupBy("x").agg(F.sum("_r").alias("_all"))
    seen = counts.join(known, "unit").groupBy("window", "x").agg(F.sum(F.col("n") * F.col("_l")).alias("_s"))
    scored = seen.join(F.broadcast(silent), "x").withColumn("_s", F.col("_s") - F.col("_all"))  # a row a place
    w = Window.partitionBy("window")
    e = scored.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.select("window", "x", (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def _moments(rows: DataFrame, features: str, cluster: str) -> dict:
    """Count, mean and covariance of each cluster, from partial sums of batches."""

    def run(batches):
        for batch in batches:
            for k, group in batch.groupby(cluster):
                x = np.stack(group[features]).astype(float)
                yield pd.DataFrame({cluster: [k], "n": [len(x)], "s": [x.sum(0)], "q": [(x.T @ x).ravel()]})

    kind = dict(rows.dtypes)[cluster]
    parts = rows.select(cluster, features).mapInPandas(run, f"{cluster} {kind}, n long, s array<double>, q array<double>")
    whole = parts.groupBy(cluster).applyInPandas(lambda g: pd.DataFrame({cluster: [g[cluster].iloc[0]], "n": [int(g["n"].sum())], "s": [np.sum(np.stack(g["s"]), 0)], "q": [np.sum(np.stack(g["q"]), 0)]}), parts.schema)
    out = {}
    for r in whole.collect():  # a row a cluster
        mean = np.array(r.s) / r.n
        d = len(mean)
        out[r[cluster]] = (r.n, mean, (np.array(r.q).reshape(d, d) - r.n * np.outer(mean, mean)) / max(r.n - 1, 1))
    return out


def cluster_distances(rows: DataFrame, features: str, cluster: str) -> DataFrame:
    """(of, cluster, d2): squared Mahalanobis distance of each row to each cluster of more rows than features."""
    known = {k: (m, np.linalg.pinv(c)) for k, (n, m, c) in _moments(rows, features, cluster).items() if n > len(m)}
    kind = dict(rows.dtypes)[cluster]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[features]).astype(float)
            for k, (m, inverse) in known.items():
                d = x - m
                yield pd.DataFrame({"of": k, "cluster": batch[cluster].to_numpy(), "d2": np.einsum("ij,jk,ik->i", d, inverse, d)})

    return rows.select(cluster, features).mapInPandas(run, f"of {kind}, cluster {kind}, d2 double")


def isolation_distance(rows: DataFrame, features: str, cluster: str) -> DataFrame:
    """(cluster, n, distance): the n-th smallest distance of the rows outside a cluster of n rows.

    It is null for a cluster with no more rows than features, whose covariance
    has no inverse, and for one with fewer rows outside than inside.
    """
    d = cluster_distances(rows, features, cluster)
    sizes = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    # counts by bins of the distance's logarithm tell the bin that holds the n-th; only its rows are ranked
    place = F.floor(64 * F.log2(F.greatest("d2", F.lit(1e-300))))
    outside = d.where("of <> cluster").select(F.col("of").alias("cluster"), "d2", place.alias("bin"))
    run = Window.partitionBy("cluster").orderBy("bin")
    counts = outside.groupBy("cluster", "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(run))
    wanted = counts.join(sizes, "cluster").where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("c") < F.col("n")))
    wanted = wanted.select("cluster", "bin", (F.col("n") - F.col("upto") + F.col("c")).alias("k"))
    inside = outside.join(F.broadcast(wanted), ["cluster", "bin"])  # a row a cluster
    found = inside.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("d2"))).where("r = k")
    return sizes.join(found, "cluster", "left").select("cluster", "n", F.col("d2").alias("distance"))


def l_ratio(rows: DataFrame, features: str, cluster: str, df: int = 4) -> DataFrame:
    """(cluster, l_ratio): chance of the outside rows to belong, by size."""
    from ..functions.distributions import chi2_tail, udf_of

    d = cluster_distances(rows, features, cluster)
    sizes = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    tail = udf_of(chi2_tail)(F.col("d2"), F.lit(float(df)))
    total = d.where("of <> cluster").select(F.col("of").alias("cluster"), tail.alias("p")).groupBy("cluster").agg(F.sum("p").alias("l"))
    return sizes.join(total, "cluster").select("cluster", (F.col("l") / F.col("n")).alias("l_ratio"))


def states(rows: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """Rows with ``state``, by k-means over standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(rows)
    scaled = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(vectors).transform(vectors)
    model = KMeans(featuresCol="_x", predictionCol="state", k=k, seed=seed).fit(scaled)
    return model.transform(scaled).drop("_v", "_x")


def _wide(z: DataFrame, names: list) -> DataFrame:
    """(bin, x): each bin's scores as one array, in the order of ``names``."""
    kind = dict(z.dtypes)["unit"]
    places = z.sparkSession.createDataFrame(list(enumerate(names)), f"_i int, unit {kind}")
    placed = z.join(F.broadcast(places), "unit")  # at most MOST_UNITS rows
    held = placed.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("_i", "z"))).alias("m"))
    return held.select("bin", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("x"))


def _matrix(batch: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(batch[column].to_list()) if len(batch) else np.zeros((0, 0))


def _block_sums(rows: DataFrame, size: int, f) -> np.ndarray:
    """Sum of ``f``, a vector of ``size`` numbers, over batches of rows; one vector a task reaches the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += f(batch)
        yield pd.DataFrame({"sums": [total]})

    return sum((np.asarray(r.sums) for r in rows.mapInPandas(run, "sums array<double>").toLocalIterator()), np.zeros(size))


def _independent(y: DataFrame, k: int, bins: int, rounds: int = 500, closest: float = 1e-10) -> np.ndarray:
    """Directions of whitened projections that are least normal (fixed-point steps, all at once).

    Each round is a sum over all bins of k * k + k numbers; it starts from
    a fixed rotation and ends when no direction turns any more.
    """

    def even(w):
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = even(np.random.default_rng(0).normal(size=(k, k)))
    for _ in range(rounds):

        def step(batch, w=w):
            x = _matrix(batch, "y")
            g = np.tanh(x @ w.T)
            return np.r_[(g.T @ x).ravel(), (1 - g * g).sum(0)]

        sums = _block_sums(y, k * k + k, step) / bins
        new = even(sums[: k * k].reshape(k, k) - sums[k * k :, None] * w)
        turned = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if turned < closest:
            break
    return w


def assemblies(z: DataFrame, units: int, bins: int, independent: bool = False, tasks: int = 32) -> DataFrame:
    """(assembly, unit, weight, eigenvalue) of the components that chance cannot explain.

    Eigenvectors of the correlations above the Marchenko-Pastur edge; if
    ``independent``, they are turned to the directions of their space in which
    the bins' scores are most independent, in order of the variance there,
    which then stands as ``eigenvalue``. Weights have length one and their
    largest is positive. The matrix is units by units, summed over blocks of
    bins; its size does not grow with time, and more than MOST_UNITS units are
    refused. Without such a component there are no rows.
    """
    kind = dict(z.dtypes)["unit"]
    schema = f"assembly int, unit {kind}, weight double, eigenvalue double"
    names = sorted(r.unit for r in z.select("unit").distinct().limit(MOST_UNITS + 1).collect())
    if units > MOST_UNITS or len(names) > MOST_UNITS:
        raise ValueError(f"a matrix of more than {MOST_UNITS} units a side")
    if not names:
        return z.sparkSession.createDataFrame([], schema)
    n = len(names)
    wide = _wide(z, names).coalesce(tasks).persist()

    def squares(batch):
        x = _matrix(batch, "x")
        return (x.T @ x).ravel()

    values, vectors = np.linalg.eigh(_block_sums(wide, n * n, squares).reshape(n, n) / (bins - 1))
    strong = [k for k in range(n)[::-1] if values[k] > (1 + np.sqrt(units / bins)) ** 2]
    values, found = values[strong], vectors[:, strong]
    if independent and strong:
        white = found / np.sqrt(values)

        def project(batches):
            for batch in batches:
                yield pd.DataFrame({"y": list(_matrix(batch, "x") @ white)} if len(batch) else {"y": []})

        w = _independent(wide.mapInPandas(project, "y array<double>").persist(), len(strong), bins)
        turned = white @ w.T
        turned /= np.linalg.norm(turned, axis=0)
        spread = ((turned.T @ found) ** 2) @ values
        order = np.argsort(-spread, kind="stable")
        found, values = turned[:, order], spread[order]
    rows = []
    for j in range(found.shape[1]):
        v = found[:, j] * np.sign(found[np.abs(found[:, j]).argmax(), j])
        rows += [(j + 1, u, float(x), float(values[j])) for u, x in zip(names, v, strict=True)]
    return z.sparkSession.createDataFrame(rows, schema)
