"""More registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import histograms as H
from ..operators import intervals as I  # noqa: E741
from ..operators import joins as J
from ..operators import ordered as O  # noqa: E741
from ..operators import statistics as S
from .catalog import DAY, EV, HOUR, USER, events, extent, items, merged, of_type, query, spans

ANGLE = f"(dayofyear(l_shipdate) * {2 * math.pi / 366})"
_PAIR = "r AS (SELECT event_id, user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS n FROM ev WHERE event_type = 'purchase'), s AS (SELECT user_id, t FROM ev WHERE event_type = 'signup')"


def angles(spark, d):
    return items(spark, d).withColumn("angle", F.dayofyear("l_shipdate") * (2 * math.pi / 366))


# --- joins and intervals --------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id % 5 IN (1, 3) AND event_type IN ('click', 'view')")
def select_units(spark, d):
    chosen = (F.col("user_id") % 5).isin(1, 3) & F.col("event_type").isin("click", "view")
    return events(spark, d).where(chosen).select("event_id", "user_id", "event_type")


@query(f"WITH {EV}, {_PAIR} SELECT event_id, EXISTS (SELECT 1 FROM s WHERE s.user_id = r.user_id AND s.t <= r.t AND (r.p IS NULL OR s.t > r.p)) AS first_after FROM r")
def is_first_after(spark, d):
    return J.first_after(of_type(spark, d, "purchase"), of_type(spark, d, "signup"), USER, cell=DAY).select("event_id", "first_after")


@query(f"WITH {EV}, {_PAIR} SELECT event_id, EXISTS (SELECT 1 FROM s WHERE s.user_id = r.user_id AND s.t >= r.t AND (r.n IS NULL OR s.t < r.n)) AS last_before FROM r")
def is_last_before(spark, d):
    return J.last_before(of_type(spark, d, "purchase"), of_type(spark, d, "signup"), USER, cell=DAY).select("event_id", "last_before")


@query(f"WITH {EV}, h AS (SELECT user_id, event_type, floor(t / 21600.0) AS h, row_number() OVER (PARTITION BY user_id, event_type, floor(t / 21600.0) ORDER BY t) AS k FROM ev) SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(a.h AS DOUBLE) AS left_t, CAST(b.h AS DOUBLE) AS right_t FROM (SELECT * FROM h WHERE event_type = 'click') a FULL JOIN (SELECT * FROM h WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.h = b.h AND a.k = b.k")
def match_pairs(spark, d):
    cut = lambda kind: of_type(spark, d, kind).select("user_id", F.floor(F.col("t") / (6 * HOUR)).cast("double").alias("t"))
    return J.match_pairs(cut("click"), cut("view"), USER, cell=40.0)


@query(f"WITH {EV}, i AS (SELECT event_id AS iid, user_id, t AS a, t + 43200.0 AS b FROM ev WHERE event_type = 'purchase'), h AS (SELECT ev.event_id, ev.t, max(iid) AS iid FROM ev JOIN i ON i.user_id = ev.user_id AND t BETWEEN a AND b GROUP BY ALL) SELECT event_id, iid, row_number() OVER (PARTITION BY iid ORDER BY t, event_id) AS place FROM h")
def interval_rank(spark, d):
    held = I.in_intervals(events(spark, d), spans(spark, d, "purchase", 12), 12 * HOUR, USER, "event_id").where("inside")
    return held.select("event_id", "iid", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {EV}, x AS (SELECT floor(min(t) / 86400.0) AS lo, floor(max(t) / 86400.0) AS hi FROM ev), b AS (SELECT k AS iid, lo * 86400.0 + k * 43200.0 AS a, lo * 86400.0 + k * 43200.0 + 86400.0 AS z FROM (SELECT lo, unnest(range(0, CAST(2 * (hi - lo) + 1 AS BIGINT))) AS k FROM x)) SELECT iid, a AS start, z AS stop, count(ev.t) AS n FROM b LEFT JOIN ev ON t BETWEEN a AND z GROUP BY ALL")
def sliding_bins(spark, d):
    first, days = extent(events(spark, d), DAY)
    made = I.bins(spark, first * DAY, (first + days) * DAY, DAY, DAY / 2)
    return I.count_in_intervals(events(spark, d), made, DAY, []).select("iid", "start", "stop", "n")


@query(f"WITH {EV}, e AS (SELECT event_id AS k, t AS e FROM ev WHERE event_type = 'signup'), p AS (SELECT e.k, greatest(1, least(12, CAST(floor((ev.t - e.e + 21600.0) / 43200.0 * 12) AS INTEGER) + 1)) AS bin, value FROM ev JOIN e ON ev.t BETWEEN e - 21600.0 AND e + 21600.0) SELECT k AS event_event_id, bin, count(value) AS n, round(avg(value), 6) AS mean FROM p GROUP BY ALL")
def sync_map(spark, d):
    made = H.peth(events(spark, d).select("t", "value"), of_type(spark, d, "signup").select("event_id", "t"), 6 * HOUR, 6 * HOUR, 12, key="event_id", value="value")
    return made.select("event_event_id", "bin", "n", F.round("mean", 6).alias("mean"))


@query()
def random_intervals(spark, d):
    seen = events(spark, d).groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    return I.random_intervals_within(seen, 20, 0.25, USER)


# --- maps and correlograms --------------------------------------------------------

_GRID = "greatest(1, least({n}, CAST(floor(({c} - {lo}) / {w} * {n}) AS INTEGER) + 1))"
_QX = _GRID.format(c="l_quantity", lo=1, w=49, n=10)
_DY = _GRID.format(c="l_discount", lo=0.0, w=0.1, n=6)


def _phase_sql(axes: dict[str, tuple[str, int]]) -> str:
    names = ", ".join(axes)
    grid = "(SELECT * FROM " + ", ".join(f"range(1, {n + 1}) {c}_r({c})" for c, (_, n) in axes.items()) + ") g"
    return f"WITH b AS (SELECT {', '.join(f'{e} AS {c}' for c, (e, _) in axes.items())}, {ANGLE} AS a FROM lineitem), s AS (SELECT {names}, count(*) AS n, atan2(avg(sin(a)), avg(cos(a))) AS phase, sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2) AS r FROM b GROUP BY {names}) SELECT {names}, coalesce(n, 0) AS n, round(phase, 6) AS phase, round(r, 6) AS r FROM {grid} LEFT JOIN s USING ({names})"


@query(_phase_sql({"l_quantity": (_QX, 10)}))
def phase_curve(spark, d):
    got = H.phase_map(angles(spark, d), "angle", {"l_quantity": (1, 50, 10)})
    return got.select(F.col("l_quantity").cast("bigint").alias("l_quantity"), "n", F.round("phase", 6).alias("phase"), F.round("r", 6).alias("r"))


@query(_phase_sql({"l_quantity": (_QX, 10), "l_discount": (_DY, 6)}))
def phase_map(spark, d):
    got = H.phase_map(angles(spark, d), "angle", {"l_quantity": (1, 50, 10), "l_discount": (0.0, 0.1, 6)})
    return got.select(F.col("l_quantity").cast("bigint").alias("l_quantity"), F.col("l_discount").cast("bigint").alias("l_discount"), "n", F.round("phase", 6).alias("phase"), F.round("r", 6).alias("r"))


@query(f"""WITH {EV}, c AS (SELECT CAST(w AS BIGINT) AS w, event_type AS u, t FROM ev, range(0, 3) k(k), LATERAL (SELECT floor(t / 432000.0) - k AS w) WHERE t < w * 432000.0 + 864000.0),
  p AS (SELECT x.w, x.u AS a, y.u AS b, CAST(floor((y.t - x.t) / 3600.0 + 0.5) AS INTEGER) AS bin FROM c x JOIN c y ON x.w = y.w AND y.t BETWEEN x.t - 12600.0 AND x.t + 12600.0 WHERE x.u <> y.u OR x.t <> y.t)
  SELECT w AS "window", a, b, bin, count(*) AS n FROM p WHERE bin BETWEEN -3 AND 3 GROUP BY ALL""")
def short_time_ccg(spark, d):
    return H.short_time_correlogram(events(spark, d), "event_type", HOUR, 3, 10 * DAY, 5 * DAY)


@query(f"""WITH RECURSIVE b AS (SELECT {_QX} AS x, {_DY} AS y FROM lineitem), s AS (SELECT x, y, count(*) AS n FROM b GROUP BY ALL),
  g AS (SELECT x, y, coalesce(n, 0) AS n FROM (SELECT * FROM range(1, 11) r(x), range(1, 7) q(y)) e LEFT JOIN s USING (x, y)),
  f(x, y) AS (SELECT x, y FROM (SELECT x, y FROM g ORDER BY n DESC, x, y LIMIT 1) UNION SELECT g.x, g.y FROM f JOIN g ON abs(g.x - f.x) + abs(g.y - f.y) = 1 WHERE g.n >= 0.9 * (SELECT max(n) FROM g))
  SELECT f.x AS l_quantity, f.y AS l_discount, g.n, (SELECT count(*) FROM f) AS size FROM f JOIN g USING (x, y)""")
def find_field(spark, d):
    binned = items(spark, d).select(C.bin_index(F.col("l_quantity"), 1, 50, 10).alias("l_quantity"), C.bin_index(F.col("l_discount"), 0.0, 0.1, 6).alias("l_discount"))
    grid = H.dense(binned.groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n")), ["n"], l_quantity=10, l_discount=6)
    got = H.find_field(grid, "n", ["l_quantity", "l_discount"], 0.9)
    return got.select(F.col("l_quantity").cast("bigint").alias("l_quantity"), F.col("l_discount").cast("bigint").alias("l_discount"), "n", "size")


@query("WITH m AS (SELECT CAST(l_quantity AS INTEGER) AS r, l_linenumber AS c, l_extendedprice AS v FROM lineitem) SELECT (p - 1) // 4 + 1 AS row, (q - 1) // 2 + 1 AS column, round(avg(v), 4) AS v FROM (SELECT v, CASE WHEN r < 18 THEN r WHEN r < 34 THEN r + 1 ELSE r + 2 END AS p, CASE WHEN c < 5 THEN c ELSE c + 1 END AS q FROM m) GROUP BY ALL")
def shrink_matrix(spark, d):
    cells = items(spark, d).select(F.col("l_quantity").cast("int").alias("row"), F.col("l_linenumber").alias("column"), F.col("l_extendedprice").alias("v"))
    got = O.shrink(cells, "v", 50, 7, (4, 2))
    return got.select(F.col("row").cast("bigint").alias("row"), F.col("column").cast("bigint").alias("column"), F.round("v", 4).alias("v"))


# --- statistics --------------------------------------------------------------------


@query(f"WITH {EV} SELECT p.event_id, round((SELECT count(*) FROM ev s WHERE s.event_type = 'click' AND s.value < p.value) / (SELECT count(value) FROM ev WHERE event_type = 'click'), 9) AS p FROM ev p WHERE event_type = 'purchase' AND value IS NOT NULL")
def npcdf(spark, d):
    got = S.cdf_at(of_type(spark, d, "click").select("value"), of_type(spark, d, "purchase").select("event_id", "value"), "value", [], cell=10.0)
    return got.select("event_id", F.round("p", 9).alias("p"))


@query("SELECT e.event_type, round(sqrt(sum((value - m) ** 2) / (count(*) * (count(*) - 1))), 6) AS error FROM events e JOIN (SELECT event_type, median(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1")
def semedian(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(C.standard_error_of_median(F.col("value")), 6).alias("error"))


_KAPPA = "CASE WHEN r < 0.53 THEN 2 * r + r ** 3 + 5 * r ** 5 / 6 WHEN r < 0.85 THEN -0.4 + 1.39 * r + 0.43 / (1 - r) ELSE 1 / (r ** 3 - 4 * r ** 2 + 3 * r) END"


@query(f"""WITH g AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, sum(cos({ANGLE})) AS c, sum(sin({ANGLE})) AS s FROM lineitem GROUP BY 1), e AS (SELECT *, sqrt(c * c + s * s) / n AS r FROM g), k AS (SELECT *, {_KAPPA} AS k FROM e),
  s AS (SELECT count(*) AS q, sum(n) AS n, sqrt(sum(c) ** 2 + sum(s) ** 2) AS w, sum(n * r) AS i, sum(n * k) / sum(n) AS kappa FROM k)
  SELECT round((n - q) / (q - 1) * (i - w) / (n - i) * CASE WHEN kappa > 2 AND kappa < 10 THEN 1 + 3 / (8 * kappa) ELSE 1 END, 5) AS f, q - 1 AS df1, CAST(n - q AS BIGINT) AS df2 FROM s""")
def circular_anova(spark, d):
    return S.circular_anova(angles(spark, d), "angle", "l_returnflag").select(F.round("f", 5).alias("f"), "df1", "df2")


@query(f"""WITH g AS (SELECT l_returnflag, count(*) AS n, atan2(avg(sin({ANGLE})), avg(cos({ANGLE}))) AS m, sqrt(avg(cos({ANGLE})) ** 2 + avg(sin({ANGLE})) ** 2) AS r1, sqrt(avg(cos(2 * {ANGLE})) ** 2 + avg(sin(2 * {ANGLE})) ** 2) AS r2 FROM lineitem GROUP BY 1),
  e AS (SELECT *, 1.959963984540054 * sqrt((1 - r2) / (2 * r1 ** 2) / n) AS x FROM g), f AS (SELECT *, CASE WHEN x < 1 THEN asin(least(x, 1)) ELSE pi() END AS b FROM e)
  SELECT l_returnflag, n, round(m, 5) AS mean, round(m - b, 5) AS low, round(m + b, 5) AS high FROM f""")
def circular_interval(spark, d):
    got = S.circular_interval(angles(spark, d), "angle", ["l_returnflag"])
    return got.select("l_returnflag", "n", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS p, 1.13 / sqrt(sum(n) OVER ()) AS b FROM c) SELECT event_type, n, round(p, 9) AS share, round(greatest(p - b, 0), 9) AS low, round(least(p + b, 1), 9) AS high FROM s")
def multinomial_intervals(spark, d):
    got = S.multinomial_intervals(events(spark, d), "event_type")
    return got.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("share", "low", "high")])


_WC = "((sum(w * {x} * {y}) / sum(w) - sum(w * {x}) / sum(w) * (sum(w * {y}) / sum(w))) / sqrt((sum(w * {x} * {x}) / sum(w) - (sum(w * {x}) / sum(w)) ** 2) * (sum(w * {y} * {y}) / sum(w) - (sum(w * {y}) / sum(w)) ** 2)))"


@query(f"WITH b AS (SELECT l_returnflag, l_quantity AS w, l_discount AS x, sin({ANGLE}) AS s, cos({ANGLE}) AS c FROM lineitem), r AS (SELECT l_returnflag, {_WC.format(x='x', y='s')} AS xs, {_WC.format(x='x', y='c')} AS xc, {_WC.format(x='s', y='c')} AS sc FROM b GROUP BY 1) SELECT l_returnflag, round(sqrt((xc * xc + xs * xs - 2 * xc * xs * sc) / (1 - sc * sc)), 5) AS rho FROM r")
def weighted_corr_circ(spark, d):
    got = C.weighted_circular_corr(F.col("l_quantity"), F.col("l_discount"), F.col("angle"))
    return angles(spark, d).groupBy("l_returnflag").agg(F.round(got, 5).alias("rho"))


@query("SELECT l_returnflag, round(1 - sum((l_extendedprice - (1000.0 * l_quantity + 500.0)) ** 2) / ((count(l_extendedprice) - 1) * var_samp(l_extendedprice)), 6) AS r2 FROM lineitem GROUP BY 1")
def rsquared(spark, d):
    got = C.explained(F.col("l_quantity"), F.col("l_extendedprice"), 1000.0, 500.0)
    return items(spark, d).groupBy("l_returnflag").agg(F.round(got, 6).alias("r2"))


@query(f"SELECT l_returnflag, round(atan2(stddev_samp(sin({ANGLE})) / sqrt(count(*)), stddev_samp(cos({ANGLE})) / sqrt(count(*))), 6) AS angle FROM lineitem GROUP BY 1")
def semangle(spark, d):
    return angles(spark, d).groupBy("l_returnflag").agg(F.round(C.sem_angle(F.col("angle")), 6).alias("angle"))


@query("SELECT DISTINCT l_linenumber AS n, round(log(CAST(factorial(CAST(l_linenumber AS INTEGER)) AS DOUBLE)) / log(exp(1)), 9) AS log_factorial FROM lineitem")
def log_factorial(spark, d):
    return items(spark, d).select(F.col("l_linenumber").alias("n")).distinct().withColumn("log_factorial", F.round(C.log_factorial(F.col("n")), 9))


_RES = "{c} - (regr_intercept({c}, l_quantity) OVER g + regr_slope({c}, l_quantity) OVER g * l_quantity)"


@query(f"WITH r AS (SELECT l_returnflag, {_RES.format(c='l_extendedprice')} AS x, {_RES.format(c='l_discount')} AS y FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)) SELECT l_returnflag, round(corr(x, y), 6) AS r, count(*) AS n FROM r GROUP BY 1")
def corr_residuals(spark, d):
    got = S.residual_correlation(items(spark, d), "l_extendedprice", "l_discount", "l_quantity", ["l_returnflag"])
    return got.select("l_returnflag", F.round("r", 6).alias("r"), "n")


# --- ordered rows -------------------------------------------------------------------


@query(f"WITH {EV}, r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t) AS place FROM ev), b AS (SELECT user_id, event_id, place AS spot, 0 AS line FROM r UNION ALL SELECT user_id, -event_id, place, 1 FROM r WHERE event_type = 'purchase') SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY spot, line) AS INTEGER) AS place FROM b")
def insert_rows(spark, d):
    from ..operators.series import ranked

    rows = ranked(events(spark, d), USER, "t", DAY, "place").withColumn("place", F.col("place") + 1)
    lines = rows.where("event_type = 'purchase'").select("user_id", (-F.col("event_id")).alias("event_id"), F.col("place").alias("after"), F.lit(1).alias("number"))
    return O.insert_rows(rows.select("user_id", "event_id", "place"), lines, USER)


@query(f"WITH {EV}, k(u, rank) AS (VALUES ('click', 1), ('error', 2), ('purchase', 3), ('signup', 4), ('view', 5)), s AS (SELECT CAST(floor(t / 86400.0) AS BIGINT) AS day, user_id, t, rank FROM ev JOIN k ON event_type = u) SELECT a.user_id, a.day, CAST(coalesce(sum(sign(b.rank - a.rank)), 0) AS BIGINT) AS score, CAST(coalesce(sum(CASE WHEN a.rank <> b.rank THEN 1 ELSE 0 END), 0) AS BIGINT) AS best FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND b.t > a.t GROUP BY ALL")
def pair_order(spark, d):
    target = spark.createDataFrame([("click", 1), ("error", 2), ("purchase", 3), ("signup", 4), ("view", 5)], "event_type string, rank int")
    days = events(spark, d).withColumn("day", F.floor(F.col("t") / DAY))
    return O.pair_order(days, target, ["user_id", "day"], "event_type")


# --- movement, cycles and resampling -------------------------------------------------

_P = "p AS (SELECT user_id, t, value AS x, (value * 7) % 100 AS y, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(value) OVER w AS x0, lead(value) OVER w AS x1, lag((value * 7) % 100) OVER w AS y0, lead((value * 7) % 100) OVER w AS y1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))"


def positions(spark, d):
    return events(spark, d).select("event_id", "user_id", "t", F.col("value").alias("x"), ((F.col("value") * 7) % 100).alias("y"))


@query(f"WITH {EV}, {_P} SELECT user_id, t, round(sqrt((coalesce(x1, x) - coalesce(x0, x)) ** 2 + (coalesce(y1, y) - coalesce(y0, y)) ** 2) / nullif(coalesce(t1, t) - coalesce(t0, t), 0), 7) AS velocity FROM p")
def linear_velocity(spark, d):
    from ..operators.kinematics import linear_velocity as f

    return f(positions(spark, d), USER).select("user_id", "t", F.round("velocity", 7).alias("velocity"))


@query(f"WITH {EV}, d AS (SELECT user_id, t, lead(t) OVER w AS t1, (((lead(value / 50) OVER w - value / 50) % {2 * math.pi}) + {2 * math.pi}) % {2 * math.pi} AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, round(CASE WHEN a > {math.pi} THEN a - {2 * math.pi} ELSE a END / (t1 - t) * 1000, 6) AS velocity FROM d")
def angular_velocity(spark, d):
    from ..operators.kinematics import angular_velocity as f

    turned = events(spark, d).withColumn("angle", F.col("value") / 50)
    return f(turned, USER).select("user_id", "t", F.round(F.col("velocity") * 1000, 6).alias("velocity"))


@query(f"WITH {EV} SELECT event_id, greatest(1, least(10, CAST(floor(value / 100 * 10) AS INTEGER) + 1)) IN (2, 5) AND greatest(1, least(10, CAST(floor(((value * 7) % 100) / 100 * 10) AS INTEGER) + 1)) BETWEEN 3 AND 6 AS in_zone FROM ev")
def in_zone(spark, d):
    from ..operators.kinematics import in_zone as f

    zone = spark.createDataFrame([(x, y) for x in (2, 5) for y in range(3, 7)], "x int, y int")
    return f(positions(spark, d), zone, {"x": (0, 100, 10), "y": (0, 100, 10)}).select("event_id", "in_zone")


_UP = "z AS (SELECT user_id, t, value - 50 AS v, lead(value - 50) OVER w AS v1, lead(t) OVER w AS t1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), u AS (SELECT user_id, t + (t1 - t) * v / (v - v1) AS c FROM z WHERE v < 0 AND v1 >= 0), y AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY c) AS iid, c AS a, lead(c) OVER (PARTITION BY user_id ORDER BY c) AS b FROM u)"


@query(f"WITH {EV}, {_UP} SELECT y.user_id, y.iid, count(e.t) AS n FROM y LEFT JOIN (SELECT user_id, t FROM ev WHERE event_type = 'click') e ON e.user_id = y.user_id AND e.t BETWEEN a AND b WHERE b IS NOT NULL GROUP BY ALL")
def points_per_cycle(spark, d):
    from ..operators.waves import points_per_cycle as f

    signal = events(spark, d).select("user_id", "t", (F.col("value") - 50).alias("v"))
    return f(of_type(spark, d, "click").select("user_id", "t"), signal, "v", USER, 5 * DAY).select("user_id", F.col("iid").cast("bigint").alias("iid"), "n")


@query(f"WITH {EV}, {merged('i', 'purchase', 24)}, n AS (SELECT i.user_id, i.start AS iid, event_type, min(t) AS m FROM i JOIN ev ON ev.user_id = i.user_id AND t BETWEEN i.start AND i.stop GROUP BY ALL) SELECT user_id, iid, string_agg(event_type, '>' ORDER BY m, event_type) AS sequence FROM n GROUP BY ALL")
def visit_sequences(spark, d):
    from ..operators.waves import visit_sequences as f

    periods = I.consolidate(spans(spark, d, "purchase", 24), USER).withColumn("iid", F.col("start"))
    return f(events(spark, d), periods, DAY, USER, "event_type").select("user_id", "iid", F.array_join("sequence", ">").alias("sequence"))


@query("WITH m AS (SELECT l_orderkey, l_linenumber AS i, l_quantity AS x, l_extendedprice AS y FROM lineitem), n AS (SELECT l_orderkey, sqrt(sum(x * x) * sum(y * y)) AS n FROM m GROUP BY 1) SELECT a.l_orderkey, CAST(b.i - a.i AS INTEGER) AS lag, round(sum(a.x * b.y) / any_value(n), 6) AS r FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND abs(b.i - a.i) <= 2 JOIN n ON n.l_orderkey = a.l_orderkey GROUP BY ALL")
def cross_correlation(spark, d):
    from ..operators.waves import cross_correlation as f

    rows = items(spark, d).select("l_orderkey", F.col("l_linenumber").cast("int").alias("i"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return f(rows, ["l_orderkey"], "x", "y", 2).select("l_orderkey", F.col("lag").cast("int").alias("lag"), F.round("r", 6).alias("r"))


@query(f"WITH b AS (SELECT l_returnflag, {ANGLE} AS a, l_discount AS x FROM lineitem), s AS (SELECT l_returnflag, -1 + 2.0 * k / 40 AS slope, count(*) AS n, avg(cos(a - {2 * math.pi} * (-1 + 2.0 * k / 40) * x)) AS c, avg(sin(a - {2 * math.pi} * (-1 + 2.0 * k / 40) * x)) AS s FROM b, range(0, 41) r(k) GROUP BY 1, 2) SELECT l_returnflag, max(n) AS n, round(max_by(slope, sqrt(c * c + s * s)), 6) AS slope, round(max(sqrt(c * c + s * s)), 5) AS r FROM s GROUP BY 1")
def phase_precession(spark, d):
    from ..operators.kinematics import phase_precession as f

    got = f(angles(spark, d), ["l_returnflag"], "l_discount", "angle", steps=41)
    return got.select("l_returnflag", "n", F.round("slope", 6).alias("slope"), F.round("r", 5).alias("r"))


@query()
def circular_regression(spark, d):
    """Slopes of greatest resultant and their tests, of the line items' phases on discounts."""
    from ..operators.regression import resultant_regression as f

    made = f(angles(spark, d), ["l_returnflag"], "l_discount", "angle")
    return made.select("l_returnflag", "n", *[F.round(c, 5).alias(c) for c in ("slope", "offset", "r2", "p")])


@query("""WITH c AS (SELECT c_nationkey, c_custkey::DOUBLE AS x, c_acctbal::DOUBLE AS y FROM customer)
SELECT c_nationkey, round(median((b.y - a.y) / (b.x - a.x)), 6) AS slope FROM c a JOIN c b USING (c_nationkey) WHERE a.x < b.x GROUP BY c_nationkey""")
def median_slopes(spark, d):
    """Median of the slopes of all pairs of a nation's customers, of balance on number."""
    from ..operators.regression import median_slope as f

    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y"))
    return f(rows, ["c_nationkey"], "x", "y").where("slope is not null").select("c_nationkey", F.round("slope", 6).alias("slope"))


@query()
def bootstrap_interval(spark, d):
    from ..operators import resampling as R

    means = R.bootstrap_means(events(spark, d), "value", "event_id", ["event_type"], 200)
    return R.interval(means, "mean", ["event_type"]).select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def permutation_test(spark, d):
    from ..operators import resampling as R

    got = R.permutation_difference(events(spark, d), "value", "event_type", "click", "view", "event_id", [], 200)
    return got.select(F.round("difference", 6).alias("difference"), F.round("p", 6).alias("p"))


# --- fields, distributions and phases ------------------------------------------------


@query("WITH l AS (SELECT min(value) - (max(value) - min(value)) / 5 AS a, max(value) + (max(value) - min(value)) / 5 AS b FROM events), c AS (SELECT event_type, greatest(1, least(30, CAST(floor((value - a) / (b - a) * 30) AS INTEGER) + 1)) AS bin, count(*) AS n, any_value(a) AS a, any_value(b) AS b FROM events, l WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, bin, round(a + (bin - 0.5) * (b - a) / 30, 6) AS center, round(n / sum(n) OVER (PARTITION BY event_type), 9) AS share FROM c")
def distribution(spark, d):
    from ..operators.fields import distribution as f

    got = f(events(spark, d), "value", ["event_type"], 30)
    return got.select("event_type", "bin", F.round("center", 6).alias("center"), F.round("share", 9).alias("share"))


@query("WITH e AS (SELECT event_id, event_type, value % 6 AS p FROM events WHERE value IS NOT NULL), c AS (SELECT p, count(*) AS n FROM e WHERE event_type = 'view' GROUP BY 1), f AS (SELECT p, CASE WHEN p = (SELECT min(p) FROM c) THEN 0 ELSE sum(n) OVER (ORDER BY p) / (SELECT sum(n) FROM c) END * 2 * pi() AS y FROM c), q AS (SELECT event_id, p FROM e WHERE event_type = 'click'), lo AS (SELECT q.event_id, q.p, f.p AS p0, f.y AS y0 FROM q ASOF LEFT JOIN f ON q.p >= f.p), hi AS (SELECT q.event_id, f.p AS p1, f.y AS y1 FROM q ASOF LEFT JOIN f ON q.p <= f.p) SELECT event_id, round(CASE WHEN p0 = p1 THEN y0 ELSE y0 + (y1 - y0) / (p1 - p0) * (p - p0) END, 6) AS corrected FROM lo JOIN hi USING (event_id)")
def uniform_phases(spark, d):
    from ..operators.fields import uniform_phases as f

    phased = events(spark, d).where("value is not null").withColumn("phase", F.col("value") % 6)
    got = f(phased.where("event_type = 'click'").select("event_id", "phase"), phased.where("event_type = 'view'").select("phase"), [], cell=0.5)
    return got.select("event_id", F.round("corrected", 6).alias("corrected"))


@query(f"WITH {EV}, g AS (SELECT user_id, regr_slope(value, t - 1704067200.0) AS b, regr_intercept(value, t - 1704067200.0) AS a FROM ev GROUP BY 1) SELECT event_id, round(value - a - b * (t - 1704067200.0), 5) AS detrended FROM ev JOIN g USING (user_id)")
def detrended(spark, d):
    from ..operators.fields import detrended as f

    return f(events(spark, d).withColumn("t", F.col("t") - 1704067200.0), "value", USER).select("event_id", F.round("detrended", 5).alias("detrended"))


@query("WITH b AS (SELECT CAST(l_quantity AS INTEGER) AS r, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT r, c FROM b WHERE n >= (SELECT 0.97 * max(n) FROM b)), g AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS BIGINT) AS c FROM range(1, 51) x(r), range(1, 8) y(c)) SELECT CAST(g.r AS BIGINT) AS row, g.c AS column, round(min(sqrt((g.r - o.r) ** 2 + (g.c - o.c) ** 2)), 6) AS distance FROM g, o GROUP BY ALL")
def distance_transform(spark, d):
    from ..operators.fields import distance_transform as f

    counts = items(spark, d).groupBy(F.col("l_quantity").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("column")).agg(F.count("*").alias("n"))
    full = H.dense(counts, ["n"], row=50, column=7)
    most = counts.agg(F.max("n").alias("most"))
    flagged = full.withColumn("one", F.lit(1)).join(F.broadcast(most.withColumn("one", F.lit(1))), "one").withColumn("flag", F.col("n") >= 0.97 * F.col("most"))
    got = f(flagged.select("row", "column", "flag"), "flag", 50)
    return got.select(F.col("row").cast("bigint").alias("row"), F.col("column").cast("bigint").alias("column"), F.round("distance", 6).alias("distance"))


@query(f"WITH m AS (SELECT l_returnflag, atan2(avg(sin({ANGLE})), avg(cos({ANGLE}))) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, abs(sin({ANGLE} - m)) AS d FROM lineitem JOIN m USING (l_returnflag)), g AS (SELECT count(*) AS n, sum(d) AS s, sum(d * d) AS q FROM d GROUP BY l_returnflag), s AS (SELECT count(*) AS r, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(s * s / n) AS b, sum(q) AS q FROM g) SELECT round((n - r) * (b - s * s / n) / ((r - 1) * (q - b)), 5) AS f, r - 1 AS df1, n - r AS df2 FROM s")
def concentration_test(spark, d):
    from ..operators.fields import concentration_test as f

    return f(angles(spark, d), "angle", "l_returnflag").select(F.round("f", 5).alias("f"), "df1", "df2")


@query(f"WITH {EV}, i AS (SELECT event_id, user_id, t, t - 43200.0 AS a, t + 43200.0 AS b FROM ev WHERE event_type = 'signup') SELECT i.event_id, max_by(ev.t, (ev.value, -ev.t)) AS tuned FROM i JOIN ev ON ev.user_id = i.user_id AND ev.t BETWEEN a AND b GROUP BY 1")
def tuned_times(spark, d):
    from ..operators.fields import tuned_times as f

    return f(events(spark, d), of_type(spark, d, "signup").select("event_id", "user_id", "t"), "value", USER, 12 * HOUR, 12 * HOUR, slope=False).select("event_id", "tuned")


@query("SELECT event_id FROM events JOIN (SELECT user_id, min(value) AS m FROM events GROUP BY 1) USING (user_id) WHERE value >= 3 * m")
def threshold_spikes(spark, d):
    from ..operators.fields import above_threshold

    return above_threshold(events(spark, d), "value", USER, 3.0).select("event_id")


@query("SELECT event_type, count(*) FILTER (value > 50) / count(*) AS share, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def portion(spark, d):
    return events(spark, d).groupBy("event_type").agg(C.portion(F.col("value") > 50).alias("share"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT r_regionkey, CAST(r_regionkey + k * 0.5 AS DOUBLE) AS x FROM region, range(0, 20) r(k) WHERE r_regionkey + k * 0.5 <= r_regionkey * 2 + 1")
def linear_steps(spark, d):
    region = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", F.col("r_regionkey").cast("double").alias("k"))
    listed = region.withColumn("x", C.steps(F.col("k"), F.col("k") * 2 + 1, 0.5))
    return listed.select("r_regionkey", F.explode("x").alias("x"))


@query()
def decoded_classes(spark, d):
    from ..operators.fields import decoded_classes as f

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.pmod("label", F.lit(3)).cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    return f(rows, [f"x{i}" for i in range(64)], "label", "vec_id", folds=2, iterations=5).select("vec_id", F.col("predicted").cast("int").alias("predicted"))


# --- whole tables ---------------------------------------------------------------------


@query("SELECT 1 AS \"group\", event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'signup'")
def grouped_lists(spark, d):
    from ..operators.tables import grouped

    return grouped(of_type(spark, d, "click").select("event_id"), of_type(spark, d, "signup").select("event_id"))


@query("SELECT i AS user_id, i IN (SELECT user_id FROM events WHERE event_type = 'signup') AS flag FROM (SELECT unnest(range(1, (SELECT max(user_id) FROM events WHERE event_type = 'signup') + 1)) AS i)")
def index_flags(spark, d):
    from ..operators.tables import flags

    return flags(of_type(spark, d, "signup").where("user_id > 0"), "user_id")


@query("SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l_orderkey AND o.o_custkey % 7 = l_linenumber) AS matched FROM lineitem")
def matched_rows(spark, d):
    from ..operators.tables import matched_rows as f

    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).cast("int").alias("l_linenumber"))
    lines = items(spark, d).select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return f(lines, orders, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "matched")


@query("WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS r, l_linenumber AS c, sum(l_extendedprice) AS v FROM lineitem WHERE l_quantity <= 20 GROUP BY 1, 2) SELECT row, \"column\", round(coalesce(v, 0), 3) AS v FROM (SELECT * FROM range(1, 26) a(row), range(1, 9) b(\"column\")) g LEFT JOIN c ON c.r = g.row AND c.c = g.\"column\"")
def filled_matrix(spark, d):
    from ..operators.tables import filled_matrix as f

    cells = items(spark, d).where("l_quantity <= 20").select(F.col("l_quantity").cast("bigint").alias("row"), F.col("l_linenumber").alias("column"), F.col("l_extendedprice").alias("v"))
    return f(cells, "v", 25, 8, 0.0).withColumn("v", F.round("v", 3))


@query()
def drawn_bins(spark, d):
    from ..operators.tables import drawn_bins as f

    counts = events(spark, d).groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    return f(counts, "bin", "n", 1000)


@query()
def coherogram(spark, d):
    from ..operators import signals
    from .catalog import _signal

    wide = _signal(spark, d).where("unit in ('click', 'view')").groupBy("t").agg(*[F.sum(F.when(F.col("unit") == u, F.col("v"))).alias(u) for u in ("click", "view")])
    got = signals.coherogram(wide.withColumn("k", F.lit("all")), "click", "view", ["k"], 1.0, 48, 24)
    return got.select("t", F.round("f", 6).alias("f"), F.round("coherence", 5).alias("coherence"))


@query()
def point_spectrogram(spark, d):
    from ..operators import signals

    hours = events(spark, d).withColumn("t", (F.col("t") - 1704067200.0) / HOUR)
    got = signals.point_spectrogram(hours, ["event_type"], 1.0, 96, 48)
    return got.select("event_type", "t", F.round("f", 6).alias("f"), F.round("power", 5).alias("power"), "n")


@query()
def wavelet_power(spark, d):
    from ..operators import signals
    from .catalog import _signal

    got = signals.wavelet_power(_signal(spark, d), "v", ["unit"], 1.0, [1 / 24, 1 / 8], segment=240)
    return got.select("unit", "t", F.posexplode("power").alias("band", "power")).withColumn("power", F.round("power", 5))
