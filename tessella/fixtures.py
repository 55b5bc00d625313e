"""Rasters, lines, stations, boxes and records derived from the driver's tables, in DataFrames and as SQL to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64
#: A raster value from which on a pixel is in the mask.
LEVEL = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def height(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, q): a row for each vector, a column for each of its 64 numbers, quantised."""
    q = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 200))
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode(q).alias("c", "q"))
    return flat.select("r", F.col("c").cast("long").alias("c"), "q")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where(F.col("q") >= LEVEL).select("r", "c")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands: the raster, and the raster moved by one and two columns, round the end."""
    q = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 200)))
    moved = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), q.alias("q"))
    turn = lambda k: F.concat(F.slice("q", k + 1, WIDTH - k), F.slice("q", 1, k))
    zipped = F.arrays_zip(F.col("q").alias("red"), turn(1).alias("green"), turn(2).alias("blue"))
    return moved.select("r", F.posexplode(zipped).alias("c", "p")).select("r", F.col("c").cast("long").alias("c"), "p.red", "p.green", "p.blue")


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("r", "c", F.least(F.greatest(F.col("q") / 240.0, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, seq, x, y): a polyline for each user; x in hours since the start of 2024."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000.0
    return events.select(F.col("user_id").alias("line"), F.row_number().over(w).cast("long").alias("seq"), hours.alias("x"), F.col("value").alias("y"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, i, s, w): measured widths along lines; failed measurements are null."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    return events.select(F.col("user_id").alias("line"), (F.row_number().over(w) - 1).cast("long").alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200).alias("s"), F.when(F.col("event_type") != "error", F.col("value")).alias("w"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): orders by day and price in hundreds."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("x"), (F.col("o_totalprice") / 100.0).alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x0, y0, x1, y1): a box round every order's point."""
    own = points(spark, sf_dir)
    return own.select("id", (F.col("x") - 3).alias("x0"), (F.col("y") - 10).alias("y0"), (F.col("x") + 3).alias("x1"), (F.col("y") + 10).alias("y1"))


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, source, status, corrected) from labelled documents."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    status = F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "incorrect").otherwise("pending")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("tile_id"), "source", status.alias("status"), (F.col("toxic") == 1).alias("corrected"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, pred, target): long documents against labelled quality, by language."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("lang").alias("tile"), (F.col("n_chars") >= 1000).cast("int").alias("pred"), F.col("quality").alias("target"))


SQL = {
    "size": "size AS (SELECT max(vec_id) + 1 AS h, CAST(64 AS BIGINT) AS w FROM embeddings)",
    "raster": "raster AS (SELECT vec_id AS r, CAST(i - 1 AS BIGINT) AS c, CAST(floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 200) AS BIGINT) AS q FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))",
    "mask": "mask AS (SELECT r, c FROM raster WHERE q >= 150)",
    "rgb": "rgb AS (SELECT a.r, a.c, least(255, a.q) AS red, least(255, b.q) AS green, least(255, d.q) AS blue FROM raster a JOIN raster b ON a.r = b.r AND b.c = (a.c + 1) % 64 JOIN raster d ON a.r = d.r AND d.c = (a.c + 2) % 64)",
    "proba": "proba AS (SELECT r, c, least(greatest(q / 240.0::DOUBLE, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM raster)",
    "lines": "lines AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, (epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE AS x, value AS y FROM events)",
    "stations": "stations AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS s, CASE WHEN event_type <> 'error' THEN value END AS w FROM events)",
    "points": "points AS (SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, o_totalprice / 100.0::DOUBLE AS y FROM orders)",
    "boxes": "boxes AS (SELECT id, x - 3 AS x0, y - 10 AS y0, x + 3 AS x1, y + 10 AS y1 FROM points)",
    "items": "items AS (SELECT l.doc_id AS tile_id, d.source, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'incorrect' ELSE 'pending' END AS status, toxic = 1 AS corrected FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
    "predictions": "predictions AS (SELECT d.lang AS tile, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred, l.quality AS target FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
}


def sql(*names: str, recursive: bool = False) -> str:
    """WITH and the named relations, and those that they need."""
    needs = {"mask": ["raster"], "rgb": ["raster"], "proba": ["raster"], "boxes": ["points"]}
    todo: list[str] = []
    for name in names:
        todo += [n for n in [*needs.get(name, []), name] if n not in todo]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in todo)


def sql_tiles(tile: int, stride: int) -> str:
    """Relations row_offs(row_off) and col_offs(col_off) of the tile grid over ``size``."""
    axis = "(SELECT CAST(unnest(range(0, greatest({n} - {t}, 0) + 1, {s})) AS BIGINT) AS o FROM size UNION SELECT greatest({n} - {t}, 0) FROM size WHERE greatest({n} - {t}, 0) // {s} * {s} + {t} < {n})"
    one = lambda n: axis.format(n=n, t=tile, s=stride)
    return f"row_offs AS (SELECT o AS row_off FROM {one('h')}), col_offs AS (SELECT o AS col_off FROM {one('w')})"
