"""Registered queries over whole sessions: hourly signals, transitions, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering as K
from ..operators import histograms as H
from ..operators import populations as P
from ..operators import recursive as R
from ..operators import remapping as M
from ..operators import sharp_waves as W
from ..operators import statistics as S
from .catalog import EV, HOUR, USER, events, extent, of_type, query

PER_HOUR = 1 / HOUR
_CLOCK = f"""WITH {EV}, k AS (SELECT event_type, CAST(floor(t / 3600.0) AS BIGINT) % 24 + 1 AS bin, count(*) AS n FROM ev GROUP BY ALL),
  h AS (SELECT e.event_type, b.bin, coalesce(n, 0)::DOUBLE AS f FROM (SELECT DISTINCT event_type FROM ev) e CROSS JOIN (SELECT unnest(range(1, 25)) AS bin) b LEFT JOIN k USING (event_type, bin))"""


def by_clock(spark, d) -> DataFrame:
    """Events of each type by hour of the day, 24 bins a type."""
    rows = events(spark, d).select("event_type", (F.floor(F.col("t") / HOUR) % 24 + 1).alias("bin"))
    every = rows.select("event_type").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(24).cast("bigint"))))
    return every.join(rows.groupBy("event_type", "bin").agg(F.count("*").alias("n")), ["event_type", "bin"], "left").fillna(0, ["n"])


@query(f"""{_CLOCK}, s AS (SELECT event_type, bin, sum(f) OVER (PARTITION BY event_type ORDER BY bin) AS one, sum(f) OVER (PARTITION BY event_type) AS total FROM h),
  l AS (SELECT event_type, bin, one * ln(one / (bin + 1)) + (total - one) * ln((total - one) / (24 - bin)) AS score FROM s WHERE bin < 24 AND one > 0 AND total - one > 0)
SELECT event_type, bin, round(score, 4) AS score FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, bin) = 1""")
def rate_transition(spark, d):
    return H.transition(by_clock(spark, d), ["event_type"]).select("event_type", "bin", F.round("score", 4).alias("score"))


@query(f"""{_CLOCK}, c AS (SELECT event_type, bin AS t, coalesce(sum(f) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM h),
  w AS (SELECT a.event_type, a.t AS th, sum(CASE WHEN b.t <= a.t THEN b.t * b.y ELSE 0 END) AS p1, sum(CASE WHEN b.t > a.t THEN b.y ELSE 0 END) AS f2,
      sum(CASE WHEN b.t > a.t THEN b.y * (b.t - a.t) ELSE 0 END) AS q, sum(CASE WHEN b.t > a.t THEN b.t - a.t ELSE 0 END) AS u1,
      sum(CASE WHEN b.t > a.t THEN (b.t - a.t) ** 2 ELSE 0 END) AS u2, sum(CASE WHEN b.t <= a.t THEN b.t ** 2 ELSE 0 END) AS t2
    FROM c a JOIN c b USING (event_type) WHERE a.t BETWEEN 2 AND 23 GROUP BY ALL),
  m AS (SELECT *, (-p1 - th * f2 + th * u1 * q / u2) / (th * th * u1 * u1 / u2 - t2 - th * th * (24 - th)) AS l1 FROM w),
  r AS (SELECT m.event_type, th, l1, (q - l1 * th * u1) / u2 AS l2 FROM m),
  s AS (SELECT r.event_type, r.th AS bin, sum(CASE WHEN c.t <= r.th THEN (c.y - l1 * c.t) ** 2 ELSE (c.y - l1 * r.th - l2 * (c.t - r.th)) ** 2 END) AS score FROM r JOIN c USING (event_type) GROUP BY ALL)
SELECT event_type, bin, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 4), bin) = 1""")
def slope_transition(spark, d):
    return H.transition(by_clock(spark, d), ["event_type"], "ls").select("event_type", "bin", F.round("score", 4).alias("score"))


@query()
def deconvolved_response(spark, d):
    return H.deconvolved(of_type(spark, d, "view"), of_type(spark, d, "purchase"), 12 * HOUR, 12 * HOUR, 9, USER)


def hourly(spark, d, kinds: list[str]) -> DataFrame:
    """Events of each kind by hour, an hour a row from the first to the last event."""
    rows = events(spark, d)
    first, n = extent(rows, HOUR)
    counts = rows.groupBy(F.floor(F.col("t") / HOUR).alias("hour")).agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    hours = spark.range(first, first + n).withColumnRenamed("id", "hour")
    return hours.join(counts, "hour", "left").fillna(0.0).select((F.col("hour") * HOUR).alias("t"), *kinds)


@query()
def sharp_waves(spark, d):
    """Waves of days and ripples of hours in the counts of clicks and views."""
    return W.detect(
        hourly(spark, d, ["click", "view"]), "click", "view", PER_HOUR, wave_band=(PER_HOUR / 48, PER_HOUR / 6), ripple_band=(PER_HOUR / 6, PER_HOUR / 2.5), block=6 * HOUR, around=24 * HOUR,
        wave_limits=(0.25, 1.0), ripple_limits=(0.25, 0.5), apart=3 * HOUR, shortest=(2 * HOUR, 2 * HOUR), longest=36 * HOUR,
    )


@query()
def recursive_bands(spark, d):
    """Slow changes of hourly counts, by a recursive filter run both ways."""
    rows = hourly(spark, d, ["click", "view", "purchase"])
    long = rows.select("t", F.expr("stack(3, 'click', click, 'view', view, 'purchase', purchase)").alias("event_type", "n"))
    band = R.chebyshev2(3, 20, PER_HOUR, passband=(0, PER_HOUR / 8))
    return R.recursive_filter(long, band, "n", ["event_type"], PER_HOUR).select("event_type", "t", "n", F.round("filtered", 6).alias("filtered"))


@query()
def resampled_counts(spark, d):
    """Hourly counts at three samples in two hours."""
    return R.resample(hourly(spark, d, ["click", "view"]), ["click", "view"], [], PER_HOUR, 3, 2)


@query()
def assemblies(spark, d):
    """Overlapping groups of users, those whose numbers 2 to 16 divide, as units whose six-hour counts vary together."""
    grouped = events(spark, d).withColumn("unit", F.explode(F.sequence(F.lit(2), F.lit(16)))).where(F.col("user_id") % F.col("unit") == 0)
    counts = H.count_matrix(grouped, "unit", 6 * HOUR)
    low, high = counts.agg(F.min("bin"), F.max("bin")).first()
    bins = high - low + 1 if low is not None else 0
    z = P.dense_zscores(counts, low or 0, bins)
    made = P.assemblies(z, z.select("unit").distinct().count(), bins, independent=True)
    return made.select("assembly", "unit", F.round("weight", 4).alias("weight"), F.round("eigenvalue", 4).alias("eigenvalue"))


@query(f"""WITH {EV}, f AS (SELECT user_id, event_type, CAST(floor(t / 3600.0) AS BIGINT) % 24 + 1 AS x, count(*)::DOUBLE AS r FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL),
  m AS (SELECT user_id, event_type, sum(r) AS s0, sum(r * x) / sum(r) AS m1, sum(r * x ** 2) / sum(r) AS m2, sum(r * x ** 3) / sum(r) AS m3 FROM f GROUP BY ALL),
  k AS (SELECT user_id, event_type, (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / (m2 - m1 * m1) ** 1.5 * sqrt(24 * 23.0) / 22 AS k FROM m WHERE m2 - m1 * m1 > 1e-12),
  s AS (SELECT k, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM k GROUP BY k),
  d AS (SELECT max(abs(da / na - db / nb)) AS gap, max(na) AS na, max(nb) AS nb FROM (SELECT sum(a) OVER (ORDER BY k) AS da, sum(b) OVER (ORDER BY k) AS db, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM s)),
  e AS (SELECT *, gap * (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) AS reach FROM d)
SELECT CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, (SELECT round(avg(k), 6) FROM k WHERE event_type = 'click') AS mean_a, (SELECT round(avg(k), 6) FROM k WHERE event_type = 'view') AS mean_b,
  round(gap, 6) AS gap, round(greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * reach * reach * j * j)) FROM (SELECT unnest(range(1, 102)) AS j)))), 6) AS p FROM e""")
def skewness_test(spark, d):
    """Do a user's clicks lean to other hours of the day than the views?"""
    fields = events(spark, d).where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type", (F.floor(F.col("t") / HOUR) % 24 + 1).alias("bin")).agg(F.count("*").cast("double").alias("rate"))
    made = S.compare_skewness(fields, USER, "event_type", "click", "view", 24)
    return made.select("na", "nb", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "gap", "p")])


@query(f"""WITH {EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1), u AS (SELECT max(t) - min(t) AS span FROM ev),
  g AS (SELECT ev.event_type AS a, n.event_type AS b, ev.t, max(CASE WHEN ev.event_type = n.event_type THEN t END) OVER (PARTITION BY n.event_type ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    min(CASE WHEN ev.event_type = n.event_type THEN t END) OVER (PARTITION BY n.event_type ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM ev CROSS JOIN n),
  m AS (SELECT a, b, avg(least(t - p, q - t)) AS m FROM g WHERE a <> b GROUP BY ALL)
SELECT x.a, x.b, round((x.m + y.m) / 2 / (span * (na.n + nb.n) / (4.0 * na.n * nb.n)), 6) AS distance
FROM m x JOIN m y ON x.a = y.b AND x.b = y.a JOIN n na ON na.event_type = x.a JOIN n nb ON nb.event_type = x.b CROSS JOIN u WHERE x.a < x.b""")
def train_distances(spark, d):
    """How near events of two types come to each other, over what chance would give."""
    made = K.train_distances(events(spark, d), [], "event_type", "event_id", repetitions=0, cell=6 * HOUR)
    return made.select("a", "b", F.round("distance", 6).alias("distance"))


@query()
def functional_clusters(spark, d):
    """The tree of the types of events, against times moved by an hour or so, 20 times."""
    return K.functional_clusters(events(spark, d), [], "event_type", "event_id", HOUR, 20, 6 * HOUR)


_FIELDS = "f AS (SELECT user_id, event_type, CAST(floor(t / 3600.0) AS BIGINT) % 24 + 1 AS bin, count(*)::DOUBLE AS rate FROM ev GROUP BY ALL)"


def clock_fields(spark, d, kind: str) -> DataFrame:
    """(user_id, bin, rate): each user's events of a kind by hour of the day."""
    return of_type(spark, d, kind).groupBy("user_id", (F.floor(F.col("t") / HOUR) % 24 + 1).alias("bin")).agg(F.count("*").cast("double").alias("rate"))


@query(f"""WITH {EV}, {_FIELDS}, a AS (SELECT * FROM f WHERE event_type = 'click'), b AS (SELECT * FROM f WHERE event_type = 'view'),
  k AS (SELECT user_id FROM a INTERSECT SELECT user_id FROM b), l AS (SELECT unnest(range(-23, 24)) AS lag),
  r AS (SELECT user_id, b.bin - a.bin AS lag, sum(a.rate * b.rate) AS s FROM a JOIN b USING (user_id) GROUP BY ALL),
  m AS (SELECT user_id, lag FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, abs(lag), lag) = 1),
  z AS (SELECT user_id, count(*) AS size FROM f WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT user_id, round(lag / 24.0, 9) AS shift, round(2.0 * lag / size, 9) AS relative FROM k JOIN m USING (user_id) JOIN z USING (user_id)""")
def field_shifts(spark, d):
    """Hours of the day of each user's clicks against those of the views."""
    made = M.field_shifts(clock_fields(spark, d, "click"), clock_fields(spark, d, "view"), USER, 24)
    return made.select("user_id", F.round("shift", 9).alias("shift"), F.round("relative", 9).alias("relative"))


@query()
def remapping(spark, d):
    """Do users click at the hours at which they view, or at anyone's?"""
    return M.remapping_test(clock_fields(spark, d, "view"), clock_fields(spark, d, "view"), clock_fields(spark, d, "click"), [], "user_id", 24, circular=True)
