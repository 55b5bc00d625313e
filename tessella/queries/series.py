"""Queries over lines and series: lengths, smoothing, interpolation, runs, widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import lines, sql, stations
from ..functions import vector
from ..operators import series

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, points): each line's vertices in order."""
    own = lines(spark, sf_dir).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return own.select("line", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, v): each line's known widths in order."""
    own = stations(spark, sf_dir).where("w is not null").groupBy("line").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("p"))
    return own.select("line", F.col("p.w").alias("v"))


NEXT = "nxt AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM lines WINDOW w AS (PARTITION BY line ORDER BY seq))"


@query(f"{sql('lines')}, {NEXT} SELECT line, round(sum(CASE WHEN x1 IS NULL THEN 0.0 ELSE sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) END), 4) AS length FROM nxt GROUP BY line")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("line", F.round(vector.length(F.col("points")), 4).alias("length"))


@query(f"{sql('lines')}, {NEXT} SELECT line, round(abs(sum(x * coalesce(y1, y0) - coalesce(x1, x0) * y)) / 2, 3) AS area FROM (SELECT *, first(x) OVER (PARTITION BY line ORDER BY seq) AS x0, first(y) OVER (PARTITION BY line ORDER BY seq) AS y0 FROM nxt) GROUP BY line")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("line", F.round(vector.shoelace(F.col("points")), 3).alias("area"))


@query(
    f"""{sql('lines')}, {NEXT}, n AS (SELECT *, CASE WHEN x1 IS NULL THEN 1 ELSE greatest(1, CAST(ceil(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / 60.0::DOUBLE) AS BIGINT)) END AS n FROM nxt),
    e AS (SELECT *, unnest(range(0, n)) AS k FROM n)
    SELECT line, seq, CAST(k AS BIGINT) AS k, round(CASE WHEN x1 IS NULL THEN x ELSE x + (x1 - x) * k / n END, 6) AS x, round(CASE WHEN y1 IS NULL THEN y ELSE y + (y1 - y) * k / n END, 6) AS y FROM e"""
)
def densify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = series.densified(lines(spark, sf_dir), "line", "seq", 60.0)
    return made.select("line", "seq", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    f"""{sql('stations')}, g AS (SELECT *, count(w) OVER (PARTITION BY line ORDER BY i) AS before, count(w) OVER (PARTITION BY line ORDER BY i DESC) AS after FROM stations),
    k AS (SELECT line, before, after, s, w FROM g WHERE w IS NOT NULL)
    SELECT g.line, g.i, round(coalesce(g.w, CASE WHEN n.s > p.s THEN p.w + (g.s - p.s) / (n.s - p.s) * (n.w - p.w) END, p.w, n.w), 5) AS w
    FROM g LEFT JOIN k p ON p.line = g.line AND p.before = g.before LEFT JOIN k n ON n.line = g.line AND n.after = g.after"""
)
def stations_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed measurements filled between their neighbours, by time."""
    filled = series.interpolated(stations(spark, sf_dir), "line", "i", "w", "v", at="s")
    return filled.select("line", "i", F.round("v", 5).alias("w"))


ORDERED = "known AS (SELECT line, w AS v, row_number() OVER (PARTITION BY line ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY line) AS n FROM stations WHERE w IS NOT NULL)"


@query(
    f"""{sql('stations')}, {ORDERED} SELECT a.line, a.k, round(sum(b.v) / 5.0::DOUBLE, 6) AS m FROM known a CROSS JOIN (SELECT unnest(range(-2, 3)) AS j) o
    JOIN known b ON b.line = a.line AND b.k = least(greatest(a.k + j, 0), a.n - 1) GROUP BY a.line, a.k"""
)
def moving_mean_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _values(spark, sf_dir).select("line", F.posexplode(vector.moving_mean(F.col("v"), 2)).alias("k", "m"))
    return own.select("line", F.col("k").cast("long").alias("k"), F.round("m", 6).alias("m"))


@query(
    f"""{sql('stations')}, {ORDERED} SELECT a.line, a.k, round(median(b.v), 6) AS m FROM known a CROSS JOIN (SELECT unnest(range(-2, 3)) AS j) o
    JOIN known b ON b.line = a.line AND b.k = least(greatest(a.k + j, 0), a.n - 1) GROUP BY a.line, a.k"""
)
def moving_median_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _values(spark, sf_dir).select("line", F.posexplode(vector.moving_median(F.col("v"), 2)).alias("k", "m"))
    return own.select("line", F.col("k").cast("long").alias("k"), F.round("m", 6).alias("m"))


@query(
    f"""{sql('stations')}, near AS (SELECT a.line, a.i, count(b.w) AS n, median(b.w) AS m FROM stations a JOIN stations b ON a.line = b.line AND b.i BETWEEN a.i - 3 AND a.i + 3 AND a.i <> b.i GROUP BY a.line, a.i),
    far AS (SELECT a.line, a.i, median(b.w) AS m FROM stations a JOIN stations b ON a.line = b.line AND a.i <> b.i GROUP BY a.line, a.i)
    SELECT s.line, s.i, round(CASE WHEN coalesce(n.n, 0) < 2 THEN f.m ELSE n.m END, 6) AS m FROM stations s LEFT JOIN near n ON s.line = n.line AND s.i = n.i LEFT JOIN far f ON s.line = f.line AND s.i = f.i"""
)
def local_median_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.local_median_without_self(stations(spark, sf_dir), "line", "i", "w", 3, "m").select("line", "i", F.round("m", 6).alias("m"))


@query(
    f"""{sql('stations')}, d AS (SELECT line, abs(w - lag(w) OVER (PARTITION BY line ORDER BY i)) AS d FROM stations WHERE w IS NOT NULL)
    SELECT line, round(CASE WHEN count(*) < 4 THEN 0.5 ELSE least(greatest(1.4826::DOUBLE * median(d) / sqrt(2.0), 0.15), 3.0) END, 6) AS sigma FROM d GROUP BY line"""
)
def robust_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.noise_sigma(stations(spark, sf_dir), "line", "i", "w").select("line", F.round("sigma", 6).alias("sigma"))


@query(
    f"""{sql('stations')}, b AS (SELECT line, i, CASE WHEN lag(w IS NULL) OVER (PARTITION BY line ORDER BY i) IS DISTINCT FROM (w IS NULL) THEN 1 ELSE 0 END AS b, w IS NULL AS gap FROM stations),
    r AS (SELECT *, sum(b) OVER (PARTITION BY line ORDER BY i) AS run FROM b)
    SELECT line, CAST(run AS BIGINT) AS run, gap, count(*) AS n FROM r GROUP BY line, run, gap"""
)
def boolean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = series.runs(stations(spark, sf_dir).withColumn("gap", F.col("w").isNull()), "line", "i", F.col("w").isNull())
    return own.groupBy("line", F.col("run").cast("long").alias("run"), "gap").agg(F.count("*").alias("n"))


@query(
    f"""{sql('stations')}, t AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY i) AS k, w > 40 AS f FROM stations), o AS (SELECT line, k, k - lag(k) OVER (PARTITION BY line ORDER BY k) AS gap FROM t WHERE f),
    r AS (SELECT line, k, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY k) AS run FROM o)
    SELECT line, CAST(run AS BIGINT) AS run, min(k) AS first, max(k) AS last, max(k) - min(k) + 1 AS n FROM r GROUP BY line, run HAVING max(k) - min(k) + 1 >= 4"""
)
def runs_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of wide stations; gaps of two are bridged, short runs go."""
    found = series.merged_runs(stations(spark, sf_dir), "line", "i", F.col("w") > 40, 2, 4)
    return found.select("line", F.col("run").cast("long").alias("run"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("n").cast("long").alias("n"))


@query(
    f"""{sql('stations')}, ref AS (SELECT line, median(w) AS w_ref FROM stations GROUP BY line),
    near AS (SELECT s.line, w_ref, w FROM stations s JOIN ref ON s.line = ref.line WHERE abs(w - w_ref) <= greatest(2.5, 0.55 * greatest(w_ref, 1.0))),
    mean AS (SELECT line, w_ref, count(*) AS n_inliers, avg(w) AS w_in FROM near GROUP BY line, w_ref HAVING count(*) >= 5),
    close AS (SELECT n.line, count(*) AS n_anchors, avg(w) AS w_an FROM near n JOIN mean m ON n.line = m.line WHERE abs(w - w_in) <= greatest(0.7, 0.18 * w_in) GROUP BY n.line)
    SELECT m.line, round(w_ref, 6) AS w_ref, n_inliers, coalesce(n_anchors, 0) AS n_anchors, round(CASE WHEN coalesce(n_anchors, 0) >= 3 THEN w_an ELSE w_in END, 6) AS width FROM mean m LEFT JOIN close c ON m.line = c.line"""
)
def anchor_inlier_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.fixed_width(stations(spark, sf_dir), "line", "w")
    return found.select("line", F.round("w_ref", 6).alias("w_ref"), "n_inliers", "n_anchors", F.round("width", 6).alias("width"))


@query(
    f"""{sql('stations', recursive=True)}, {ORDERED}, fold(line, k, v, n) AS (SELECT line, k, v, n FROM known WHERE k = 0
        UNION ALL SELECT f.line, b.k, CASE WHEN b.k = f.n - 1 THEN b.v ELSE 0.25 * f.v + 0.5 * b.v + 0.25 * c.v END, f.n
        FROM fold f JOIN known b ON b.line = f.line AND b.k = f.k + 1 LEFT JOIN known c ON c.line = f.line AND c.k = f.k + 2)
    SELECT line, k, round(v, 6) AS v FROM fold"""
)
def smoothing_iir(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _values(spark, sf_dir).select("line", F.posexplode(vector.smoothed_in_place(F.col("v"))).alias("k", "v"))
    return own.select("line", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


@query(
    f"""{sql('lines')}, d AS (SELECT line, seq, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM lines WINDOW w AS (PARTITION BY line ORDER BY seq))
    SELECT line, seq, round(sum(coalesce(d, 0.0)) OVER (PARTITION BY line ORDER BY seq), 4) AS s FROM d"""
)
def arc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way along a line to each vertex, where inserted vertices find their place."""
    return series.arc_length(lines(spark, sf_dir), "line", "seq").select("line", "seq", F.round("s", 4).alias("s"))


@query(
    f"""{sql('lines')}, d AS (SELECT line, seq, x, y, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS d FROM lines WINDOW w AS (PARTITION BY line ORDER BY seq)),
    a AS (SELECT *, sum(d) OVER (PARTITION BY line ORDER BY seq) AS s FROM d), t AS (SELECT line, max(s) AS total, greatest(3, CAST(round_even(max(s) / 100.0::DOUBLE, 0) AS BIGINT) + 1) AS n FROM a GROUP BY line HAVING max(s) > 0)
    SELECT line, CAST(n AS BIGINT) AS n, round(total / (n - 1), 6) AS gap FROM t"""
)
def station_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stations each line gets, and how far apart."""
    made = series.stations(lines(spark, sf_dir), "line", "seq", 100.0)
    return made.groupBy("line").agg(F.count("*").alias("n"), F.max("s").alias("t")).select("line", "n", F.round(F.col("t") / (F.col("n") - 1), 6).alias("gap"))


@query()
def headings_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headings of a line's segments lie 40 degrees apart or more: a greedy, ordered fold."""
    heads = F.transform(vector.segments(F.col("points")), lambda s: F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]))
    kept = vector.distinct_headings(heads, 0.6981317007977318)
    return _points(spark, sf_dir).select("line", F.size(kept).cast("long").alias("n_headings"))


@query(
    f"""{sql('stations')}, grid AS (SELECT 1 + unnest(range(0, 31)) * 0.1::DOUBLE AS k), pts AS (SELECT line, (i % 20 + 1) / 20.0::DOUBLE AS u, least(w / 500.0::DOUBLE, 1.0) AS v FROM stations WHERE w IS NOT NULL),
    sse AS (SELECT line, k, round(sum((v - power(greatest(1 - power(u, 2 / k), 0.0), k / 2)) * (v - power(greatest(1 - power(u, 2 / k), 0.0), k / 2))), 6) AS e FROM pts CROSS JOIN grid GROUP BY line, k),
    r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY e, k) AS rn FROM sse) SELECT line, round(k, 4) AS k, e FROM r WHERE rn = 1"""
)
def pinch_fit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve exponent that fits samples best, over a grid of 31; sums go to groups of line and exponent."""
    own = stations(spark, sf_dir).where("w is not null").select("line", ((F.col("i") % 20 + 1) / 20.0).alias("u"), F.least(F.col("w") / 500.0, F.lit(1.0)).alias("v"))
    k = F.col("k")
    tried = own.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: 1 + j * F.lit(0.1))))
    miss = F.col("v") - F.pow(F.greatest(1 - F.pow("u", 2 / k), F.lit(0.0)), k / 2)
    sse = tried.groupBy("line", "k").agg(F.round(F.sum(miss * miss), 6).alias("e"))
    best = sse.groupBy("line").agg(F.min(F.struct("e", "k")).alias("b"))
    return best.select("line", F.round("b.k", 4).alias("k"), "b.e")


@query(
    f"""{sql('stations')}, k AS (SELECT line, w, row_number() OVER (PARTITION BY line ORDER BY i) AS i, median(w) OVER (PARTITION BY line) AS base FROM stations WHERE w IS NOT NULL),
    o AS (SELECT line, i, w, base, greatest(2.0, 0.2 * base) AS gate, side, side * (w - base) AS off FROM k CROSS JOIN (VALUES (1), (-1)) AS v(side)),
    b AS (SELECT *, off > gate AS strong, sum(CASE WHEN off <= 0.5 * gate THEN 1 ELSE 0 END) OVER (PARTITION BY line, side ORDER BY i) AS breaks FROM o),
    g AS (SELECT line, side, i, breaks, lag(i) OVER w AS last, lag(breaks) OVER w AS had FROM b WHERE strong WINDOW w AS (PARTITION BY line, side ORDER BY i)),
    r AS (SELECT line, side, i, sum(CASE WHEN last IS NULL OR i - last > 4 OR breaks > had THEN 1 ELSE 0 END) OVER (PARTITION BY line, side ORDER BY i) AS run FROM g),
    e AS (SELECT line, side, run, min(i) AS first, max(i) AS last FROM r GROUP BY line, side, run HAVING max(i) - min(i) >= 2),
    m AS (SELECT e.line, e.side, e.run, first, last, median(w) AS level, any_value(base) AS base, any_value(gate) AS gate FROM e JOIN b ON e.line = b.line AND e.side = b.side AND b.i BETWEEN first AND last GROUP BY e.line, e.side, e.run, first, last),
    s AS (SELECT m.line, m.side, m.first, 1.4826 * median(abs(w - level)) AS spread FROM m JOIN k ON m.line = k.line AND k.i BETWEEN first AND last GROUP BY m.line, m.side, m.first)
    SELECT m.line, CAST(m.side AS INT) AS side, CAST(m.first AS BIGINT) AS first, CAST(m.last AS BIGINT) AS last, round(level, 6) AS level FROM m JOIN s ON m.line = s.line AND m.side = s.side AND m.first = s.first
    WHERE abs(level - base) > gate AND spread <= greatest(1.0, 0.6 * abs(level - base))"""
)
def exception_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a line that hold a width of their own."""
    own = stations(spark, sf_dir).where("w is not null")
    own = own.withColumn("base", F.median("w").over(Window.partitionBy("line"))).withColumn("gate", F.greatest(F.lit(2.0), 0.2 * F.col("base")))
    found = series.exception_runs(own, "line", "i", "w", "base", "gate", most_gap=3)
    return found.select("line", "side", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.round("level", 6).alias("level"))
