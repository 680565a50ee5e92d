"""Registered queries over the test tables, each with its SQL.

Point process and samples are the events, units are users, intervals begin at
events of one type; maps and angles use line items.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import histograms as H
from ..operators import intervals as I  # noqa: E741
from ..operators import joins as J
from ..operators import ordered as O  # noqa: E741
from ..operators import statistics as S

USER = ["user_id"]
DAY, HOUR = 86400.0, 3600.0
T0 = 1704067200.0  # 2024-01-01, the first event's day
_SQL: dict[str, str] = {}
_QUERIES: dict = {}

EV = "ev AS (SELECT event_id, epoch(ts) AS t, user_id, event_type, value FROM events)"
# Merged six-hour intervals from purchases and from signups, by user.
_MERGE = """{n}_m AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
    FROM (SELECT user_id, t AS a, t + {d} AS b FROM ev WHERE event_type = '{e}')),
  {n}_r AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r + 1e-10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS g FROM {n}_m),
  {n} AS (SELECT user_id, min(a) AS "start", max(b) AS "stop" FROM {n}_r GROUP BY user_id, g)"""


def merged(n: str, e: str, hours: float) -> str:
    return _MERGE.format(n=n, e=e, d=hours * HOUR)


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", C.seconds("ts").alias("t"), "user_id", "event_type", C.finite(F.col("value")).alias("value"))


def extent(points: DataFrame, width: float) -> tuple[int, int]:
    """First bin of ``width`` that the times are in, and how many there are up to the last."""
    low, high = points.agg(F.floor(F.min("t") / width), F.floor(F.max("t") / width)).first()
    return (low, high - low + 1) if low is not None else (0, 1)


def of_type(spark, d, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind)


def spans(spark, d, kind: str, hours: float) -> DataFrame:
    return of_type(spark, d, kind).select("user_id", F.col("event_id").alias("iid"), F.col("t").alias("start"), (F.col("t") + hours * HOUR).alias("stop"))


def items(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


# --- scans and row-local operators --------------------------------------------


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) AS number FROM (SELECT DISTINCT user_id FROM events)")
def numbered_ids(spark, d):
    # a row a user; ranks follow from the counts of ranges, see operators.joins for larger keys
    from pyspark.sql import Window

    ids = events(spark, d).select("user_id").distinct().withColumn("cell", F.floor(F.col("user_id") / 64))
    inside = ids.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("user_id")))
    sizes = ids.groupBy("cell").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(base, "cell").select("user_id", (F.col("k") + F.col("base")).cast("bigint").alias("number"))


@query("SELECT event_id, event_type FROM events WHERE regexp_full_match(event_type, 'p.*|sign.p')")
def events_regex(spark, d):
    return events(spark, d).where(F.col("event_type").rlike("^(?:p.*|sign.p)$")).select("event_id", "event_type")


@query("SELECT DISTINCT event_type FROM events WHERE regexp_full_match(event_type, '[a-p].*')")
def event_types(spark, d):
    return events(spark, d).where(F.col("event_type").rlike("^(?:[a-p].*)$")).select("event_type").distinct()


@query("SELECT event_id, least(greatest(value, 5.0), 100.0) AS clipped FROM events")
def clip_values(spark, d):
    return events(spark, d).select("event_id", C.clip(F.col("value"), 5.0, 100.0).alias("clipped"))


@query("SELECT event_id, greatest(1, least(20, CAST(floor((value - 10) / 90 * 20) AS INTEGER) + 1)) AS bin FROM events WHERE value IS NOT NULL")
def bin_clamp(spark, d):
    return events(spark, d).where("value is not null").select("event_id", C.bin_index(F.col("value"), 10, 100, 20).alias("bin"))


@query("SELECT event_id, least(20, CAST(floor((value - 10) / 90 * 20) AS INTEGER) + 1) AS bin FROM events WHERE value BETWEEN 10 AND 100")
def bin_trim(spark, d):
    return events(spark, d).select("event_id", C.bin_index(F.col("value"), 10, 100, 20, trim=True).alias("bin")).where("bin is not null")


_BINS = "b AS (SELECT event_id, value, greatest(1, least(10, CAST(floor(value / 200 * 10) AS INTEGER) + 1)) AS x FROM events)"


def _binned(spark, d):
    return events(spark, d).withColumn("x", C.bin_index(F.col("value"), 0, 200, 10))


@query(f"WITH {_BINS} SELECT g.x, count(b.x) AS n, round(coalesce(sum(value), 0), 4) AS total FROM range(1, 11) g(x) LEFT JOIN b ON b.x = g.x GROUP BY g.x")
def accumulate_sum(spark, d):
    return H.accumulate(_binned(spark, d), "value", x=10).select(F.col("x").cast("bigint").alias("x"), "n", F.round("total", 4).alias("total"))


@query(f"WITH {_BINS} SELECT x, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM b GROUP BY x")
def accumulate_mean_std(spark, d):
    return H.accumulate(_binned(spark, d), "value", x=10).where("n > 0").select("x", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"WITH {_BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY x ORDER BY value, event_id) AS lo FROM b) SELECT x, max(value) AS largest, max(CASE WHEN hi = 1 THEN event_id END) AS arg_largest, min(value) AS least, max(CASE WHEN lo = 1 THEN event_id END) AS arg_least FROM r GROUP BY x")
def accumulate_argmax(spark, d):
    return H.accumulate(_binned(spark, d), "value", arg="event_id", x=10).where("n > 0").select("x", "largest", "arg_largest", "least", "arg_least")


@query(
    """WITH b AS (SELECT greatest(1, least(25, CAST(floor((l_quantity - 1) / 50 * 25) AS INTEGER) + 1)) AS x,
  greatest(1, least(11, CAST(floor(l_discount / 0.11 * 11) AS INTEGER) + 1)) AS y FROM lineitem)
SELECT gx.x, gy.y, count(b.x) AS n FROM range(1, 26) gx(x) CROSS JOIN range(1, 12) gy(y) LEFT JOIN b ON b.x = gx.x AND b.y = gy.y GROUP BY 1, 2"""
)
def accumulate_2d(spark, d):
    binned = items(spark, d).select(C.bin_index(F.col("l_quantity"), 1, 51, 25).alias("x"), C.bin_index(F.col("l_discount"), 0, 0.11, 11).alias("y"))
    full = H.dense(binned.groupBy("x", "y").agg(F.count("*").alias("n")), ["n"], x=25, y=11)
    return full.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "n")


# --- range joins --------------------------------------------------------------


@query(f"WITH {EV}, i AS (SELECT user_id, event_id AS iid, t AS a, t + 21600.0 AS b FROM ev WHERE event_type = 'purchase'), m AS (SELECT e.event_id, e.user_id, e.t, max(iid) AS iid FROM ev e JOIN i ON e.user_id = i.user_id AND e.t BETWEEN a AND b GROUP BY ALL), p AS (SELECT event_id, iid, row_number() OVER (PARTITION BY user_id, iid ORDER BY t, event_id) AS place FROM m) SELECT ev.event_id, coalesce(p.iid, -1) AS iid, coalesce(CAST(p.place AS INTEGER), 0) AS place, p.iid IS NOT NULL AS inside FROM ev LEFT JOIN p USING (event_id)")
def in_intervals(spark, d):
    got = I.in_intervals(events(spark, d), spans(spark, d, "purchase", 6), 6 * HOUR, USER, "event_id")
    return got.select("event_id", F.coalesce("iid", F.lit(-1)).alias("iid"), F.coalesce("place", F.lit(0)).alias("place"), "inside")


@query(f"WITH {EV}, i AS (SELECT user_id, event_id AS iid, t AS a, t + 21600.0 AS b FROM ev WHERE event_type = 'purchase') SELECT iid, count(e.t) AS n FROM i LEFT JOIN ev e ON e.user_id = i.user_id AND e.t BETWEEN a AND b GROUP BY iid")
def count_in_intervals(spark, d):
    return I.count_in_intervals(events(spark, d), spans(spark, d, "purchase", 6), 6 * HOUR, USER).select("iid", "n")


@query(f"WITH {EV}, {merged('c', 'purchase', 6)} SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = ev.user_id AND ev.t BETWEEN c.start AND c.stop)")
def restrict(spark, d):
    return I.restrict(events(spark, d), spans(spark, d, "purchase", 6), 6 * HOUR, USER).select("event_id")


@query(f"WITH {EV}, {merged('c', 'purchase', 6)}, g AS (SELECT *, coalesce(sum(stop - start) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c) SELECT event_id, round(t - g.start + base, 6) AS t FROM ev JOIN g ON g.user_id = ev.user_id AND ev.t BETWEEN g.start AND g.stop")
def restrict_shift(spark, d):
    return I.restrict(events(spark, d), spans(spark, d, "purchase", 6), 6 * HOUR, USER, shift=True).select("event_id", F.round("t", 6).alias("t"))


_SYNC = f"WITH {EV}, e AS (SELECT * FROM ev WHERE event_type = 'purchase'), s AS (SELECT * FROM ev WHERE event_type = 'click'), y AS (SELECT s.event_id, e.event_id AS sync_id, s.t - e.t AS rt, s.value FROM s JOIN e ON s.user_id = e.user_id AND s.t BETWEEN e.t - 7200.0 AND e.t + 7200.0)"


@query(f"{_SYNC} SELECT event_id, sync_id, round(rt, 6) AS rt FROM y")
def sync(spark, d):
    got = J.sync(of_type(spark, d, "click"), of_type(spark, d, "purchase"), 7200.0, 7200.0, USER)
    return got.select("event_id", F.col("event_event_id").alias("sync_id"), F.round("t", 6).alias("rt"))


@query(f"WITH {EV}, i AS (SELECT user_id, event_id AS iid, t AS a, t + 21600.0 AS b FROM ev WHERE event_type = 'purchase') SELECT event_id, iid, round((t - a) / (b - a), 6) AS relative FROM ev JOIN i ON ev.user_id = i.user_id AND t BETWEEN a AND b")
def relative_times(spark, d):
    return J.relative_times(events(spark, d), spans(spark, d, "purchase", 6), 6 * HOUR, USER).select("event_id", "iid", F.round("relative", 6).alias("relative"))


# --- interval algebra ---------------------------------------------------------


@query(f"WITH {EV}, {merged('c', 'purchase', 24)} SELECT user_id, start, stop FROM c")
def consolidate(spark, d):
    return I.consolidate(spans(spark, d, "purchase", 24), USER)


@query(f"WITH {EV}, i AS (SELECT t AS a, t + 600.0 AS b FROM ev WHERE event_type = 'signup'), m AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i), g AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r + 60 THEN 1 ELSE 0 END) OVER (ORDER BY a, b) AS k FROM m) SELECT min(a) AS start, max(b) AS stop FROM g GROUP BY k")
def consolidate_eps(spark, d):
    return I.consolidate(spans(spark, d, "signup", 1 / 6), epsilon=60.0, cell=DAY)


@query(f"WITH {EV}, {merged('p', 'purchase', 24)}, {merged('q', 'signup', 24)} SELECT p.user_id, greatest(p.start, q.start) AS start, least(p.stop, q.stop) AS stop FROM p JOIN q ON p.user_id = q.user_id AND p.start < q.stop AND q.start < p.stop")
def intersect(spark, d):
    return I.intersect(spans(spark, d, "purchase", 24), spans(spark, d, "signup", 24), DAY, USER)


@query(f"WITH {EV}, a AS (SELECT user_id, event_id AS iid, t AS s, t + 86400.0 AS e FROM ev WHERE event_type = 'purchase'), {merged('q', 'signup', 12)}, h AS (SELECT a.*, q.start AS bs, q.stop AS be FROM a JOIN q ON a.user_id = q.user_id AND s <= q.stop AND q.start <= e), x AS (SELECT iid, coalesce(lag(be) OVER (PARTITION BY iid ORDER BY bs), s) AS start, bs AS stop FROM h UNION ALL SELECT iid, max(be), max(e) FROM h GROUP BY iid) SELECT iid, start, stop FROM x WHERE start < stop UNION ALL SELECT iid, s, e FROM a WHERE iid NOT IN (SELECT iid FROM h)")
def subtract(spark, d):
    return I.subtract(spans(spark, d, "purchase", 24), spans(spark, d, "signup", 12), DAY, USER).select("iid", "start", "stop")


_MET = f"WITH {EV}, a AS (SELECT user_id, event_id AS iid, t AS s, t + 21600.0 AS e FROM ev WHERE event_type = 'purchase'), b AS (SELECT user_id, t AS s, t + 21600.0 AS e FROM ev WHERE event_type = 'signup')"


@query(f"{_MET} SELECT iid FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e)")
def exclude(spark, d):
    return I.exclude(spans(spark, d, "purchase", 6), spans(spark, d, "signup", 6), 6 * HOUR, USER).select("iid")


@query(f"{_MET} SELECT iid, EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e) AS intersects FROM a")
def intervals_intersect(spark, d):
    return I.intersecting(spans(spark, d, "purchase", 6), spans(spark, d, "signup", 6), 6 * HOUR, USER).select("iid", "intersects")


@query(f"WITH {EV} SELECT event_id AS iid, CAST(k AS INTEGER) AS piece, t + k * 3600.0 AS start, least(t + k * 3600.0 + 3600.0, t + 9000.0) AS stop FROM ev, range(0, 3) r(k) WHERE event_type = 'signup'")
def split_pieces(spark, d):
    return I.split(spans(spark, d, "signup", 2.5), HOUR, keep="keep").select("iid", "piece", "start", "stop")


@query(f"WITH {EV}, i AS (SELECT user_id, event_id AS iid, t AS s, t + 3600.0 AS e, coalesce(sum(t + 3600.0 - t) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ev WHERE event_type = 'purchase') SELECT iid, s AS start, round(least(e, s + 9000.0 - used), 6) AS stop FROM i WHERE used < 9000.0")
def truncate(spark, d):
    return I.truncate(spans(spark, d, "purchase", 1), 9000.0, USER).select("iid", "start", F.round("stop", 6).alias("stop"))


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY t) AS g FROM ev) SELECT user_id, min(t) AS start, max(t) AS stop FROM r WHERE value > 50 GROUP BY user_id, g")
def to_intervals(spark, d):
    return I.to_intervals(events(spark, d).withColumn("high", F.col("value") > 50), "high", USER)


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY t) AS g FROM ev), i AS (SELECT user_id, min(t) AS a, max(t) AS b FROM r WHERE value > 20 GROUP BY user_id, g), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i), k AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS n FROM m) SELECT user_id, min(a) AS start, max(b) AS stop FROM k GROUP BY user_id, n HAVING max(b) - min(a) >= 86400")
def threshold_periods(spark, d):
    return I.threshold(events(spark, d), "value", 20, USER, shortest=DAY, bridge=10 * HOUR)


# --- as-of joins --------------------------------------------------------------

_LR = f"WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'click')"


def _lr(spark, d):
    return of_type(spark, d, "purchase"), of_type(spark, d, "click")


@query(f"{_LR} SELECT l.event_id, r.t AS matched_t FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t > r.t")
def match_down(spark, d):
    return J.match(*_lr(spark, d), USER, "down").select("event_id", "matched_t")


@query(f"{_LR} SELECT l.event_id, r.t AS matched_t FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.t")
def match_up(spark, d):
    return J.match(*_lr(spark, d), USER, "up").select("event_id", "matched_t")


@query(f"{_LR}, u AS (SELECT l.event_id, l.user_id, l.t, r.t AS up FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.t), b AS (SELECT u.*, r.t AS dn FROM u ASOF LEFT JOIN r ON u.user_id = r.user_id AND u.t > r.t), c AS (SELECT event_id, t, CASE WHEN up IS NULL OR t - dn < up - t THEN dn ELSE up END AS m FROM b) SELECT event_id, CASE WHEN abs(m - t) <= 36000 + 2.220446049250313e-16 THEN m END AS matched_t FROM c")
def match_closest(spark, d):
    return J.match(*_lr(spark, d), USER, "closest", 10 * HOUR).select("event_id", "matched_t")


@query(f"{_LR}, a AS (SELECT l.event_id, l.user_id, l.t, r.t AS t0, r.value AS y0 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t), b AS (SELECT a.*, r.t AS t1, r.value AS y1 FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t) SELECT event_id, round(CASE WHEN t0 = t1 THEN y0 ELSE y0 + (y1 - y0) / (t1 - t0) * (t - t0) END, 6) AS y FROM b")
def interpolate_linear(spark, d):
    left, right = _lr(spark, d)
    return J.interpolate(right, left.select("event_id", "user_id", "t"), "value", USER).select("event_id", F.round("value", 6).alias("y"))


# --- event histograms and correlograms ----------------------------------------

_BIN = "greatest(1, least(24, CAST(floor((rt + 7200.0) / 14400.0 * 24) AS INTEGER) + 1))"


@query(f"{_SYNC}, h AS (SELECT {_BIN} AS bin, count(*) AS n FROM y GROUP BY 1) SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(-7200 + (g.bin - 0.5) * 600, 3) AS center, round(coalesce(n, 0) / ((SELECT count(*) FROM e) * 600.0), 10) AS rate FROM range(1, 25) g(bin) LEFT JOIN h ON h.bin = g.bin")
def psth(spark, d):
    got = H.peth(of_type(spark, d, "click"), of_type(spark, d, "purchase"), 7200.0, 7200.0, 24, USER)
    return got.select("bin", "n", F.round("center", 3).alias("center"), F.round("rate", 10).alias("rate"))


@query(f"{_SYNC} SELECT sync_id, {_BIN} AS bin, count(*) AS n FROM y GROUP BY ALL")
def peth_matrix(spark, d):
    got = H.peth(of_type(spark, d, "click"), of_type(spark, d, "purchase"), 7200.0, 7200.0, 24, USER, key="event_id")
    return got.select(F.col("event_event_id").alias("sync_id"), "bin", "n")


@query(f"{_SYNC} SELECT {_BIN} AS bin, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM y GROUP BY 1")
def sync_hist_mean(spark, d):
    got = H.peth(of_type(spark, d, "click"), of_type(spark, d, "purchase"), 7200.0, 7200.0, 24, USER, value="value")
    return got.select("bin", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"""{_SYNC}, a AS (SELECT sync_id, CASE WHEN rt < 0 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM y GROUP BY ALL),
  z AS (SELECT x.bin AS bin_a, w.bin AS bin_b, sum(x.n * w.n) AS j FROM a x JOIN a w USING (sync_id) GROUP BY ALL), m AS (SELECT bin, sum(n) AS n FROM a GROUP BY bin)
SELECT p.bin AS bin_a, q.bin AS bin_b, CAST(coalesce(j, 0) AS BIGINT) AS joint, round(p.n * q.n / (SELECT count(*) FROM e), 6) AS expected FROM m p CROSS JOIN m q LEFT JOIN z ON z.bin_a = p.bin AND z.bin_b = q.bin""")
def joint_peth(spark, d):
    e = of_type(spark, d, "purchase")
    a = H.peth(of_type(spark, d, "click"), e, 7200.0, 7200.0, 2, USER, key="event_id")
    got = H.joint_peth(a, a, "event_event_id", e.count(), 2)
    return got.select("bin_a", "bin_b", "joint", F.round("expected", 6).alias("expected"))


_CCG = f"WITH {EV}, c AS (SELECT x.event_type AS a, y.event_type AS b, CAST(floor((y.t - x.t) / 600.0 + 0.5) AS INTEGER) AS bin, count(*) AS n FROM ev x JOIN ev y ON x.user_id = y.user_id AND y.t BETWEEN x.t - 6300 AND x.t + 6300 AND (x.event_type <> y.event_type OR x.t <> y.t) GROUP BY 1, 2, 3 HAVING bin BETWEEN -10 AND 10)"


@query(f"{_CCG} SELECT * FROM c")
def ccg_counts(spark, d):
    return H.correlogram(events(spark, d), "event_type", 600.0, 10, USER).groupBy("a", "b", "bin").agg(F.sum("n").alias("n"))


@query(f"{_CCG} SELECT a, b, bin, round(n / ((SELECT count(*) FROM ev WHERE event_type = a) * 600.0), 10) AS rate FROM c")
def ccg_rate(spark, d):
    counts = ccg_counts(spark, d)
    return H.correlogram_rate(counts, events(spark, d), "event_type", 600.0).select("a", "b", "bin", F.round("rate", 10).alias("rate"))


@query(f"WITH {EV}, i AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM ev), j AS (SELECT *, lead(d) OVER (PARTITION BY user_id ORDER BY t) AS d1 FROM i) SELECT user_id, round(stddev_samp(d) / avg(d), 6) AS cv, round(avg(2 * abs(d1 - d) / (d1 + d)), 6) AS cv2, count(d) AS n FROM j GROUP BY user_id")
def cv(spark, d):
    return O.variation(events(spark, d), USER).select("user_id", F.round("cv", 6).alias("cv"), F.round("cv2", 6).alias("cv2"), "n")


@query(f"WITH {EV}, i AS (SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM ev) SELECT event_id, round(1 / d, 10) AS rate FROM i WHERE d IS NOT NULL")
def inverse_rate(spark, d):
    return O.inverse_rate(events(spark, d), USER).select("event_id", F.round("rate", 10).alias("rate"))


@query(f"WITH {EV}, i AS (SELECT event_id, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, coalesce(a <= 3600, false) OR coalesce(b <= 3600, false) AS burst FROM i")
def burst_spikes(spark, d):
    return O.burst_flags(events(spark, d), USER, HOUR).select("event_id", "burst")


@query(f"WITH {EV}, i AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 14400 THEN 1 ELSE 0 END AS f FROM ev), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS k FROM i) SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n, count(DISTINCT event_type) AS units FROM g GROUP BY user_id, k")
def spike_trains(spark, d):
    return O.trains(events(spark, d), USER, 4 * HOUR, "event_type")


# --- maps ---------------------------------------------------------------------

_DT = f"WITH {EV}, s AS (SELECT *, CASE WHEN lead(t) OVER (PARTITION BY user_id ORDER BY t) IS NOT NULL THEN least(lead(t) OVER (PARTITION BY user_id ORDER BY t) - t, 7200) END AS d FROM ev), q AS (SELECT user_id, t, greatest(1, least(8, CAST(floor(value / 200 * 8) AS INTEGER) + 1)) AS x, coalesce(d, lag(d) OVER (PARTITION BY user_id ORDER BY t), 0) AS dt FROM s)"


@query(f"{_DT} SELECT x, round(sum(dt), 3) AS time, count(*) AS visits FROM q GROUP BY x")
def occupancy_map(spark, d):
    got = H.occupancy(events(spark, d).withColumnRenamed("value", "x"), {"x": (0, 200, 8)}, USER, 7200.0)
    return got.where("visits > 0").select("x", F.round("time", 3).alias("time"), "visits")


_RATE = f"{_DT}, c AS (SELECT q.x, count(*) AS n FROM q JOIN ev p ON p.user_id = q.user_id AND p.event_type = 'click' AND p.t >= q.t AND p.t < q.t + q.dt GROUP BY q.x), m AS (SELECT o.x, o.time, coalesce(n, 0) AS count, CASE WHEN o.time > 0 THEN coalesce(n, 0) / o.time ELSE 0 END AS rate FROM (SELECT x, sum(dt) AS time FROM q GROUP BY x) o LEFT JOIN c USING (x))"


def _rates(spark, d):
    return H.rate_map(events(spark, d).withColumnRenamed("value", "x"), of_type(spark, d, "click"), {"x": (0, 200, 8)}, USER, 7200.0, 7200.0)


@query(f"{_RATE} SELECT x, count, round(rate, 9) AS rate FROM m")
def rate_curve(spark, d):
    return _rates(spark, d).where("visits > 0").select("x", "count", F.round("rate", 9).alias("rate"))


@query(f"{_RATE}, u AS (SELECT sum(time) AS t, sum(time * rate) / sum(time) AS r FROM m) SELECT round(sum(CASE WHEN rate > 0 THEN time / u.t * rate / u.r * log2(rate / u.r) ELSE 0 END), 6) AS information FROM m, u")
def spatial_information(spark, d):
    return H.spatial_information(_rates(spark, d)).select(F.round("information", 6).alias("information"))


_K = ", ".join(f"({k}, {math.exp(-0.5 * k * k)!r})" for k in range(-3, 4))


@query(
    f"""WITH b AS (SELECT greatest(1, least(25, CAST(floor((l_quantity - 1) / 50 * 25) AS INTEGER) + 1)) AS x, count(*) AS n FROM lineitem GROUP BY 1),
  g AS (SELECT r.x, coalesce(n, 0) AS n FROM range(1, 26) r(x) LEFT JOIN b ON b.x = r.x), k(o, w) AS (VALUES {_K})
SELECT a.x, round(sum(c.n * w) / sum(w), 6) AS smoothed FROM g a, k, g c WHERE c.x = a.x + o GROUP BY a.x"""
)
def rate_map_smoothed(spark, d):
    binned = items(spark, d).groupBy(C.bin_index(F.col("l_quantity"), 1, 51, 25).alias("x")).agg(F.count("*").cast("double").alias("smoothed"))
    got = H.smooth_grid(H.dense(binned, ["smoothed"], x=25), "smoothed", {"x": 25}, 1.0)
    return got.select(F.col("x").cast("bigint").alias("x"), F.round("smoothed", 6).alias("smoothed"))


# --- circular and general statistics ------------------------------------------

_ANGLE = "a AS (SELECT l_returnflag AS g, 2 * pi() * dayofyear(l_shipdate) / 365.25 AS x FROM lineitem)"
_CIRC = f"WITH {_ANGLE}, s AS (SELECT g, count(*) AS n, avg(cos(x)) AS c, avg(sin(x)) AS s FROM a GROUP BY g), r AS (SELECT *, sqrt(c * c + s * s) AS r FROM s)"


def _angles(spark, d):
    return items(spark, d).select(F.col("l_returnflag").alias("g"), (2 * math.pi * F.dayofyear("l_shipdate") / 365.25).alias("x"))


@query(f"{_CIRC} SELECT g, n, round(atan2(s, c), 6) AS direction, round(r, 6) AS r, round(1 - r, 6) AS variance FROM r")
def circular_mean(spark, d):
    got = S.circular_summary(_angles(spark, d), "x", ["g"])
    return got.select("g", "n", *[F.round(c, 6).alias(c) for c in ("direction", "r", "variance")])


@query(f"{_CIRC} SELECT g, round(CASE WHEN r < 0.53 THEN 2 * r + r ** 3 + 5 * r ** 5 / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (r ** 3 - 4 * r ** 2 + 3 * r) END, 6) AS kappa FROM r")
def concentration(spark, d):
    return S.circular_summary(_angles(spark, d), "x", ["g"]).select("g", F.round("kappa", 6).alias("kappa"))


@query(f"{_CIRC} SELECT g, round(exp(-n * r * r) * (1 + (2 * (n * r * r) - (n * r * r) ** 2) / (4 * n) - (24 * (n * r * r) - 132 * (n * r * r) ** 2 + 76 * (n * r * r) ** 3 - 9 * (n * r * r) ** 4) / (288 * n * n)), 6) AS p FROM r")
def rayleigh(spark, d):
    return S.circular_summary(_angles(spark, d), "x", ["g"]).select("g", F.round("p", 6).alias("p"))


@query(f"WITH {_ANGLE}, b AS (SELECT g, greatest(1, least(12, CAST(floor((x - 2 * pi() * floor(x / (2 * pi()))) / (2 * pi()) * 12) AS INTEGER) + 1)) AS bin FROM a) SELECT g, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY g), 8) AS share FROM b GROUP BY g, bin")
def circular_dist(spark, d):
    return S.circular_histogram(_angles(spark, d), "x", 12, ["g"]).select("g", "bin", "n", F.round("share", 8).alias("share"))


@query(f"WITH {_ANGLE} SELECT g, round((sum(cos(x)) ** 2 + sum(sin(x)) ** 2 - count(*)) / (count(*) * (count(*) - 1.0)), 8) AS ppc FROM a GROUP BY g")
def ppc(spark, d):
    return S.circular_summary(_angles(spark, d), "x", ["g"]).select("g", F.round("ppc", 8).alias("ppc"))


@query(f"WITH {EV}, x AS (SELECT user_id % 10 AS k, value, event_type = 'click' AS c FROM ev WHERE event_type IN ('click', 'view')), s AS (SELECT k, value, count(*) FILTER (c) AS ca, count(*) FILTER (NOT c) AS cb FROM x GROUP BY ALL), d AS (SELECT k, ca + cb AS n, sum(ca) OVER v AS na, sum(cb) OVER v AS nb, sum(ca) OVER w / sum(ca) OVER v - sum(cb) OVER w / sum(cb) OVER v AS d FROM s WINDOW v AS (PARTITION BY k), w AS (PARTITION BY k ORDER BY value)) SELECT k, round(max(na) * max(nb) / (max(na) + max(nb)) ** 2 * (sum(n * d * d) - sum(n * d) ** 2 / (max(na) + max(nb))), 6) AS u2, round(max(abs(d)), 6) AS gap FROM d GROUP BY k")
def watson_u2(spark, d):
    rows = events(spark, d).withColumn("k", F.col("user_id") % 10)
    return S.distribution_distance(rows, "value", "event_type", "click", "view", ["k"]).select("k", F.round("u2", 6).alias("u2"), F.round("gap", 6).alias("gap"))


@query("WITH g AS (SELECT event_type, count(value) AS n, var_samp(value) AS v FROM events GROUP BY 1), s AS (SELECT count(*) AS k, sum((n - 1) * v) / sum(n - 1) AS p, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS i, sum(n - 1) AS df FROM g) SELECT round((df * ln(p) - l) / (1 + (i - 1 / df) / (3 * (k - 1))), 5) AS statistic FROM s")
def bartlett_t(spark, d):
    return S.bartlett(events(spark, d), "value", "event_type").select(F.round("statistic", 5).alias("statistic"))


@query("SELECT round(var_samp(value) FILTER (event_type = 'click') / var_samp(value) FILTER (event_type = 'view'), 6) AS f FROM events")
def fisher_f(spark, d):
    return S.variance_ratio(events(spark, d), "value", "event_type", "click", "view").select(F.round("f", 6).alias("f"))


@query("WITH g AS (SELECT l_returnflag AS g, regr_slope(l_extendedprice, l_quantity) AS b, regr_sxx(l_extendedprice, l_quantity) AS x, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) SELECT round((a.b - c.b) / sqrt((a.r + c.r) / (a.n + c.n - 4) * (1 / a.x + 1 / c.x)), 4) AS t_value FROM g a, g c WHERE a.g = 'A' AND c.g = 'R'")
def compare_slopes_t(spark, d):
    return S.compare_slopes(items(spark, d), "l_quantity", "l_extendedprice", "l_returnflag", "A", "R").select(F.round("t_value", 4).alias("t_value"))


@query("WITH s AS (SELECT sum(CASE WHEN toxic = 1 THEN quality END) AS s1, count(*) FILTER (toxic = 1) AS n1, sum(CASE WHEN toxic = 0 THEN quality END) AS s0, count(*) FILTER (toxic = 0) AS n0 FROM labels) SELECT round(abs(s1 / n1 - s0 / n0) / sqrt((s1 + s0) / (n1 + n0) * (1 - (s1 + s0) / (n1 + n0)) * (1 / n1 + 1 / n0)), 6) AS z FROM s")
def binomial_z(spark, d):
    return S.proportions(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic", 1, 0).select(F.round("z", 6).alias("z"))


@query("WITH w AS (SELECT l_returnflag AS g, l_discount + 0.01 AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT g, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) / sum(w) AS xy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy FROM w GROUP BY g) SELECT g, round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 6) AS r FROM m")
def weighted_corr(spark, d):
    got = items(spark, d).groupBy(F.col("l_returnflag").alias("g")).agg(C.weighted_corr(F.col("l_discount") + 0.01, F.col("l_quantity"), F.col("l_extendedprice")).alias("r"))
    return got.select("g", F.round("r", 6).alias("r"))


@query("WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS x, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS y FROM events WHERE value IS NOT NULL) SELECT event_type, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def spearman(spark, d):
    return S.spearman(events(spark, d), "user_id", "value", ["event_type"]).select("event_type", F.round("rho", 6).alias("rho"))


@query("WITH f AS (SELECT user_id, regr_slope(value, epoch(ts)) AS b, regr_intercept(value, epoch(ts)) AS a FROM (SELECT user_id, value, ts FROM events) GROUP BY 1) SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id), 6) AS z FROM events")
def zscores(spark, d):
    return S.zscores(events(spark, d), "value", USER).select("event_id", F.round("z", 6).alias("z"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id FROM events JOIN q USING (event_type) WHERE value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a)")
def remove_outliers(spark, d):
    return S.without_outliers(events(spark, d), "value", ["event_type"]).select("event_id")


@query("WITH h AS (SELECT CAST(least(40, floor(value / 200 * 40) + 1) AS INTEGER) AS bin, count(*) AS c FROM events GROUP BY 1), s AS (SELECT bin, sum(c) OVER w AS w, sum(bin * c) OVER w AS m, sum(c) OVER () AS tw, sum(bin * c) OVER () AS tm FROM h WINDOW w AS (ORDER BY bin)), v AS (SELECT bin, power(CAST(tm AS DOUBLE) * w / tw - m, 2) / (w * (tw - w)) AS b FROM s WHERE w < tw) SELECT bin FROM v ORDER BY b DESC, bin LIMIT 1")
def otsu(spark, d):
    return S.otsu(events(spark, d), "value", 0, 200, 40)


# --- ordered rows -------------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, round((lead(value) OVER w - value) / (lead(t) OVER w - t), 8) AS slope FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t) QUALIFY lead(t) OVER w IS NOT NULL")
def diff(spark, d):
    return O.derivative(events(spark, d), "value", USER).select("event_id", F.round("slope", 8).alias("slope"))


@query(f"WITH {EV}, c AS (SELECT event_id, t, value - 50 AS v, lead(value) OVER w - 50 AS v1, lead(t) OVER w AS t1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, v < 0 AS up, round(t + (t1 - t) * v / (v - v1), 3) AS crossing FROM c WHERE (v < 0 AND v1 >= 0) OR (v >= 0 AND v1 < 0)")
def zero_crossings(spark, d):
    return O.zero_crossings(events(spark, d), "value", USER, 50.0).select("event_id", "up", F.round("crossing", 3).alias("crossing"))


@query(f"WITH {EV}, c AS (SELECT event_id, value AS x, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, CASE WHEN x > a AND x > b THEN 'max' ELSE 'min' END AS kind FROM c WHERE (x > a AND x > b) OR (x < a AND x < b)")
def extrema(spark, d):
    return O.extrema(events(spark, d), "value", USER).select("event_id", "kind")


@query(f"WITH {EV}, r AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ev) SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, k ORDER BY t), 4) AS total FROM r")
def cumsum_restart(spark, d):
    rows = events(spark, d).withColumn("stop", F.col("event_type") == "purchase")
    return O.cumulative(rows, "value", "stop", USER).select("event_id", F.round("total", 4).alias("total"))


@query(f"WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM ev")
def smooth_rect(spark, d):
    return O.moving_average(events(spark, d), "value", USER, 2).select("event_id", F.round("smoothed", 6).alias("smoothed"))


_K4 = ", ".join(f"({k}, {math.exp(-0.5 * k * k)!r})" for k in range(-4, 5))


@query(f"WITH {EV}, n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM ev), k(o, w) AS (VALUES {_K4}) SELECT a.event_id, round(sum(b.value * w) / sum(w), 6) AS smoothed FROM n a, k, n b WHERE b.user_id = a.user_id AND b.i = a.i + o GROUP BY a.event_id")
def smooth_gaussian(spark, d):
    return O.gaussian(events(spark, d), "value", USER, 1.0).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"WITH {EV}, c AS (SELECT user_id, value, CAST(unnest(range(CAST(floor(t / 43200.0) AS BIGINT) - 1, CAST(floor(t / 43200.0) AS BIGINT) + 1)) AS BIGINT) AS w FROM ev) SELECT user_id, w AS \"window\", count(value) AS n, round(avg(value), 6) AS mean FROM c GROUP BY ALL")
def running_average(spark, d):
    return O.running_average(events(spark, d), "value", USER, DAY, DAY / 2).select("user_id", "window", "n", F.round("mean", 6).alias("mean"))


@query("SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3")
def topk(spark, d):
    return O.largest(events(spark, d), 3, USER, F.col("value"), "event_id").select("user_id", "event_id", "value", "rank")


@query(f"WITH {EV} SELECT event_id FROM ev QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY t) IS DISTINCT FROM event_type")
def remove_repetitions(spark, d):
    return O.without_repetitions(events(spark, d), "event_type", USER, immediate=True).select("event_id")


@query(f"WITH {EV}, f AS (SELECT *, min(t) OVER (PARTITION BY user_id, event_type) AS m FROM ev) SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY m) AS INTEGER) AS number FROM f")
def renumber(spark, d):
    return O.renumber(events(spark, d), "event_type", USER).select("event_id", "number")


# --- populations --------------------------------------------------------------


@query(f"WITH {EV}, c AS (SELECT user_id AS u, CAST(floor(t / 21600.0) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT x.u AS a, y.u AS b, sum(x.n * y.n) AS xy FROM c x JOIN c y ON x.b = y.b AND x.u < y.u GROUP BY ALL), m AS (SELECT u, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY u) SELECT p.a, p.b, round((k * xy - i.s * j.s) / sqrt((k * i.q - i.s * i.s) * (k * j.q - j.s * j.s)), 6) AS r FROM p JOIN m i ON i.u = p.a JOIN m j ON j.u = p.b CROSS JOIN (SELECT max(b) - min(b) + 1.0 AS k FROM c)")
def corr_in_intervals(spark, d):
    points = events(spark, d)
    return H.unit_correlations(H.count_matrix(points, "user_id", 6 * HOUR), extent(points, 6 * HOUR)[1]).select("a", "b", F.round("r", 6).alias("r"))


@query(f"WITH {EV} SELECT CAST(floor(t / 3600.0) AS BIGINT) AS bin, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM ev), 6) AS share FROM ev GROUP BY 1")
def firing_ratio(spark, d):
    users = events(spark, d).select("user_id").distinct().count()
    return H.active_share(events(spark, d), "user_id", HOUR, users).select("bin", F.round("share", 6).alias("share"))


@query("WITH v AS (SELECT o_custkey AS rat, year(o_orderdate) AS day, o_orderpriority AS arm, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS visit FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY rat, day, arm ORDER BY visit) AS k FROM v) SELECT rat, day, count(*) AS visits, count(*) FILTER (k = 1 AND arm IN ('1-URGENT', '2-HIGH')) AS rewards, count(*) FILTER (k > 1) AS working, count(*) FILTER (k = 1 AND arm NOT IN ('1-URGENT', '2-HIGH')) AS reference, round(count(*) FILTER (k = 1 AND arm IN ('1-URGENT', '2-HIGH')) / count(*), 6) AS performance FROM f GROUP BY rat, day")
def radial_first_visits(spark, d):
    from ..operators.mazes import maze_scores

    orders = spark.read.parquet(f"{d}/orders.parquet")
    visits = orders.select(F.col("o_custkey").alias("rat"), F.year("o_orderdate").cast("bigint").alias("day"), F.col("o_orderpriority").alias("arm"), F.struct("o_orderdate", "o_orderkey").alias("visit"))
    got = maze_scores(visits, ["rat", "day"], ["1-URGENT", "2-HIGH"])
    return got.select("rat", "day", "visits", "rewards", "working", "reference", F.round("performance", 6).alias("performance"))


_Z = f"""WITH {EV}, c AS (SELECT event_type AS u, CAST(floor(t / 21600.0) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY ALL),
  x AS (SELECT min(b) AS lo, max(b) AS hi, max(b) - min(b) + 1.0 AS k FROM c),
  m AS (SELECT u, sum(n) / any_value(k) AS m, sqrt((sum(n * n) - CAST(sum(n) AS DOUBLE) * sum(n) / any_value(k)) / (any_value(k) - 1)) AS s FROM c, x GROUP BY u),
  g AS (SELECT unnest(range(lo, hi + 1)) AS b FROM x),
  z AS (SELECT m.u, g.b, (coalesce(c.n, 0) - m.m) / m.s AS z FROM m CROSS JOIN g LEFT JOIN c ON c.u = m.u AND c.b = g.b WHERE m.s > 0)"""


def _scores(spark, d):
    from ..operators import populations as P

    points = events(spark, d)
    first, n = extent(points, 6 * HOUR)
    return P.dense_zscores(H.count_matrix(points, "event_type", 6 * HOUR), first, n), n


@query(f"{_Z}, w AS (SELECT x.u AS a, y.u AS b, sum(x.z * y.z) / (SELECT k - 1 FROM x) AS w FROM z x JOIN z y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2) SELECT x.b AS bin, round(2 * sum(x.z * w * y.z), 5) AS strength FROM w JOIN z x ON x.u = w.a JOIN z y ON y.u = w.b AND y.b = x.b GROUP BY x.b")
def reactivation_strength(spark, d):
    from ..operators import populations as P

    z, n = _scores(spark, d)
    return P.reactivation(z, P.template(z, n)).select("bin", F.round("strength", 5).alias("strength"))


@query(f"""WITH {EV}, r AS (SELECT event_type AS u, greatest(1, least(8, CAST(floor(value / 200 * 8) AS INTEGER) + 1)) AS x, count(*) / (SELECT floor(max(t) / 3600.0) - floor(min(t) / 3600.0) + 1 FROM ev) AS r FROM ev GROUP BY ALL),
  n AS (SELECT CAST(floor(t / 86400.0) AS BIGINT) AS w, event_type AS u, count(*) AS n FROM ev GROUP BY ALL), k AS (SELECT u, x, greatest(r, 1e-6) * 24.0 AS r FROM r),
  a AS (SELECT x, sum(r) AS s FROM k GROUP BY x), l AS (SELECT n.w, k.x, sum(n * ln(r)) AS s FROM n JOIN k USING (u) GROUP BY ALL), q AS (SELECT w, x, l.s - a.s AS s FROM l JOIN a USING (x)),
  e AS (SELECT w, x, exp(s - max(s) OVER (PARTITION BY w)) AS e FROM q) SELECT w AS "window", x, round(e / sum(e) OVER (PARTITION BY w), 6) AS p FROM e""")
def decode_position(spark, d):
    from ..operators import populations as P

    ev = events(spark, d)
    rates = ev.groupBy(F.col("event_type").alias("unit"), C.bin_index(F.col("value"), 0, 200, 8).alias("x")).agg((F.count("*") / extent(ev, HOUR)[1]).alias("rate"))
    counts = ev.groupBy(F.floor(F.col("t") / DAY).alias("window"), F.col("event_type").alias("unit")).agg(F.count("*").alias("n"))
    return P.decode(rates, counts, 24.0, 8).select("window", "x", F.round("p", 6).alias("p"))


@query(f"WITH {EV}, h AS (SELECT user_id AS u, CAST(floor(t / 21600.0) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY ALL), e AS (SELECT min(b) + (max(b) - min(b) + 1) // 2 AS mid, (max(b) - min(b) + 1) // 2 AS k1, (max(b) - min(b) + 2) // 2 AS k2 FROM h), c AS (SELECT b < (SELECT mid FROM e) AS f, * FROM h), p AS (SELECT x.f, x.u AS a, y.u AS b, sum(x.n * y.n) AS xy FROM c x JOIN c y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2, 3), m AS (SELECT f, u, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY 1, 2), r AS (SELECT p.f, p.a, p.b, (k * xy - i.s * j.s) / sqrt((k * i.q - i.s * i.s) * (k * j.q - j.s * j.s)) AS r FROM (SELECT *, CAST(CASE WHEN f THEN k1 ELSE k2 END AS DOUBLE) AS k FROM p, e) p JOIN m i ON i.u = p.a AND i.f = p.f JOIN m j ON j.u = p.b AND j.f = p.f) SELECT round(corr(v.r, w.r), 6) AS coefficient, count(*) AS n FROM r v JOIN r w ON v.a = w.a AND v.b = w.b AND v.f AND NOT w.f")
def cofiring(spark, d):
    from ..operators import populations as P

    first, n = extent(events(spark, d), 6 * HOUR)
    counts, middle = H.count_matrix(events(spark, d), "user_id", 6 * HOUR), first + n // 2
    return P.cofiring(counts.where(F.col("bin") < middle), n // 2, counts.where(F.col("bin") >= middle), n - n // 2).select(F.round("coefficient", 6).alias("coefficient"), "n")


@query(f"WITH {EV} SELECT event_id AS iid, CAST(k AS INTEGER) AS piece, t + k * ((t + 9000.0 - t) / 4) AS start, t + (k + 1) * ((t + 9000.0 - t) / 4) AS stop FROM ev, range(0, 4) r(k) WHERE event_type = 'signup'")
def split_evenly(spark, d):
    return I.split_evenly(spans(spark, d, "signup", 2.5), 4).select("iid", "piece", "start", "stop")


@query("SELECT o_custkey AS rat, CAST(n AS INTEGER) AS turn, count(*) AS n FROM (SELECT o_custkey, ((arm - lag(arm) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 2 + 5) % 5) - 2 AS n FROM (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS arm FROM orders)) WHERE n IS NOT NULL GROUP BY 1, 2")
def radial_turns(spark, d):
    from ..operators.mazes import turns

    orders = spark.read.parquet(f"{d}/orders.parquet")
    visits = orders.select(F.col("o_custkey").alias("rat"), F.substring("o_orderpriority", 1, 1).cast("int").alias("arm"), F.struct("o_orderdate", "o_orderkey").alias("visit"))
    return turns(visits, ["rat"], 5)


def _signal(spark, d):
    """Hourly counts by event type as a signal of one sample a bin, from the first event's hour."""
    first, n = extent(events(spark, d), HOUR)
    counts = H.count_matrix(events(spark, d), "event_type", HOUR)
    units = counts.select("unit").distinct().withColumn("bin", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + n - 1).cast("bigint"))))
    return units.join(counts, ["unit", "bin"], "left").select("unit", (F.col("bin") - first).cast("double").alias("t"), F.coalesce("n", F.lit(0)).cast("double").alias("v"))


def _bandpass_sql(low: float, high: float, half: int) -> str:
    """A convolution with the filter's taps over the hourly signal, mirrored at its ends."""
    from ..operators.signals import band_pass_taps

    taps = ", ".join(repr(float(x)) for x in band_pass_taps(low, high, 1.0, half))
    return f"""WITH {EV}, c AS (SELECT event_type AS u, CAST(floor(t / 3600.0) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY ALL), x AS (SELECT min(b) AS lo, max(b) - min(b) AS n FROM c),
  s AS (SELECT k.u, k.i, coalesce(c.n, 0) AS v, k.n FROM (SELECT u, unnest(range(0, n + 1)) AS i, n, lo FROM (SELECT DISTINCT u FROM c), x) k LEFT JOIN c ON c.u = k.u AND c.b = k.lo + k.i),
  h AS (SELECT unnest(range(-{half}, {half} + 1)) AS k, unnest([{taps}]) AS w)
  SELECT a.u AS unit, CAST(a.i AS DOUBLE) AS t, round(sum(w * b.v), 6) AS filtered FROM s a CROSS JOIN h JOIN s b ON b.u = a.u AND b.i = a.n - abs(a.n - abs(a.i + k)) GROUP BY 1, 2"""


@query(_bandpass_sql(0.02, 0.2, 64))
def bandpass(spark, d):
    from ..operators import signals

    got = signals.band_pass(_signal(spark, d), "v", ["unit"], 0.02, 0.2, 1.0, half=64, segment=240)
    return got.select("unit", "t", F.round("filtered", 6).alias("filtered"))


@query()
def phase_hilbert(spark, d):
    from ..operators import signals

    narrow = signals.band_pass(_signal(spark, d), "v", ["unit"], 0.02, 0.2, 1.0, half=64, segment=240).select("unit", "t", "filtered")
    return signals.phase(narrow, "filtered", ["unit"], 1.0, segment=240, halo=128).select("unit", "t", F.round("phase", 5).alias("phase"), F.round("amplitude", 5).alias("amplitude"))


@query()
def spectrogram(spark, d):
    from ..operators import signals

    got = signals.spectrogram(_signal(spark, d), "v", ["unit"], 1.0, 48, 24)
    return got.select("unit", "t", F.round("f", 6).alias("f"), F.round("power", 5).alias("power"))


@query()
def ripples(spark, d):
    from ..operators import signals

    narrow = signals.band_pass(_signal(spark, d), "v", ["unit"], 0.1, 0.4, 1.0, half=32, segment=240).select("unit", "t", "filtered")
    return signals.ripples(narrow, "filtered", ["unit"], 1.0, low=1.0, high=1.5, frame=3, merge=2.0, shortest=1.0, longest=40.0)


@query()
def isolation_distance(spark, d):
    from ..operators import populations as P

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("embedding").alias("features"))
    return P.isolation_distance(rows, "features", "label").select("cluster", "n", F.round("distance", 5).alias("distance"))


@query()
def activity_states(spark, d):
    from ..operators import populations as P

    users = events(spark, d).groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"))
    return P.states(users, ["n", "mean"], 3).select("user_id", "state")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return psth(spark, d)


def queries() -> dict:
    from . import more, sessions  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
