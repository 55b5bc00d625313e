"""Queries over sources, sinks, whole workflows and streams."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import WIDTH, height, lines, mask, points, proba, raster, rgb, sql, stations, table
from ..functions import pixels as px
from ..operators import regions, stencil
from ..operators.graph import cut, shared_folder
from ..plans import footprints, ground, roads
from ..sources import files, geotiff, png, shapefile
from ..streaming import incremental
from .raster import NOT_ROAD, PAVEMENT

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"{sql('raster')} SELECT r, c, least(q, 255) AS v FROM raster")
def geotiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster written as one GeoTIFF for each 64 rows and read back."""
    own = raster(spark, sf_dir).select("r", "c", F.least("q", F.lit(255)).alias("v"), F.floor(F.col("r") / 64).alias("band"))
    coded = geotiff.encoded(own, "band", "v", transform=(0.3, 0.0, 500000.0, 0.0, -0.3, 3500000.0), epsg=32636, nodata=0.0)

    def read(batches):
        for pdf in batches:
            for band, content in zip(pdf["band"], pdf["content"]):
                back = geotiff.decode(content)
                if back.epsg != 32636 or abs(back.transform[0] - 0.3) > 1e-12:
                    raise ValueError("georeference lost")
                r, c = np.mgrid[: back.data.shape[0], : back.data.shape[1]]
                yield pd.DataFrame({"r": r.ravel() + band * 64, "c": c.ravel(), "v": back.data[:, :, 0].ravel().astype("int64")})

    return coded.mapInPandas(read, "r long, c long, v long")


@query(f"{sql('raster')} SELECT r // 64 AS band, c, CAST(sum(CASE WHEN q >= 150 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM raster GROUP BY 1, 2")
def png_mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as 0/255 PNG images and back by the 127 threshold."""
    own = raster(spark, sf_dir).select("r", "c", (F.col("q") >= 150).cast("int").alias("m"), F.floor(F.col("r") / 64).alias("band"))

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        data = np.zeros((int(pdf["r"].max()) - band * 64 + 1, WIDTH), np.uint8)
        data[pdf["r"] - band * 64, pdf["c"]] = pdf["m"]
        back = png.decode(png.encode(png.as_mask(data)))[:, :, 0] > 127
        return pd.DataFrame({"band": band, "c": np.arange(WIDTH), "n": back.sum(0)})

    return own.groupBy("band").applyInPandas(through, "band long, c long, n long")


@query(f"{sql('boxes')} SELECT id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM boxes")
def shapefile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygon shapefiles, one for each batch of rows, and read back."""
    from ..fixtures import boxes

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            x0, y0, x1, y1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))  # null: no number
            shp = shapefile.encode_rings(np.stack([np.stack(p, axis=1) for p in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))], axis=1))
            dbf = shapefile.encode_dbf([{"id": i} for i in ids], {})
            xy = shapefile.decode_rings(shp)
            back = [record["id"] for record in shapefile.decode_dbf(dbf)]
            ends = (*xy.min(axis=1).T, *xy.max(axis=1).T)
            yield pa.RecordBatch.from_arrays([pa.array(back, pa.int64()), *[pa.array(np.round(v, 6), from_pandas=True) for v in ends]], ["id", "x0", "y0", "x1", "y1"])

    return boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1").mapInArrow(through, "id long, x0 double, y0 double, x1 double, y1 double")


@query("SELECT n_name AS title, 'EPSG:4326' AS srs, round(n_nationkey * 3.5::DOUBLE - 100, 6) AS minx, round(n_nationkey * 3.5::DOUBLE - 90, 6) AS maxx, 256 AS tile_width, 'png' AS extension FROM nation")
def xml_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile-map manifests written as XML and parsed again."""
    n = F.col("n_nationkey") * 3.5
    xml = files.tile_map_xml(F.col("n_name"), n - 100, F.lit(-10.0), n - 90, F.lit(10.0), 3)
    return table(spark, sf_dir, "nation").select(files.tile_map(xml).alias("m")).select("m.title", "m.srs", F.round("m.minx", 6).alias("minx"), F.round("m.maxx", 6).alias("maxx"), "m.tile_width", "m.extension")


@query("SELECT CAST(p_size AS INT) AS cls, CAST(floor(p_size / 100.0::DOUBLE * 640) AS BIGINT) AS x0, CAST(floor(0.25::DOUBLE * 480) AS BIGINT) AS y0, CAST(ceil((p_size / 100.0::DOUBLE + 0.125) * 640) AS BIGINT) AS x1, CAST(ceil(0.5::DOUBLE * 480) AS BIGINT) AS y1 FROM part WHERE p_partkey % 3 > 0")
def yolo_label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline labels to pixel boxes; lines with too few points go."""
    x = F.col("p_size") / 100.0
    full = F.concat_ws(" ", F.col("p_size"), x, F.lit("0.25"), x + 0.125, F.lit("0.25"), x + 0.125, F.lit("0.5"))
    own = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 > 0, full).otherwise(F.concat_ws(" ", "p_size", x, F.lit("0.25"))).alias("value"))
    return files.yolo_boxes(own, 640, 480)


@query(f"{sql('points')} SELECT id, 'Point' AS type, round(x, 6) AS x, round(y, 6) AS y FROM points")
def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    text = files.feature_json(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")), F.struct("id"))
    back = F.from_json(text, "geometry struct<type:string,coordinates:array<double>>, properties struct<id:bigint>")
    return own.select(back.alias("f")).select(F.col("f.properties.id").alias("id"), "f.geometry.type", F.round(F.col("f.geometry.coordinates")[0], 6).alias("x"), F.round(F.col("f.geometry.coordinates")[1], 6).alias("y"))


@query(f"{sql('rgb')} SELECT r, c, CAST(round(least(greatest(CASE WHEN y0 > 0.008856 THEN 116 * cbrt(y0) - 16 ELSE 903.3 * y0 END * 2.55, 0), 255), 0) AS INT) AS l FROM (SELECT r, c, 0.212671 * CASE WHEN red / 255.0::DOUBLE > 0.04045 THEN power((red / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE red / 255.0::DOUBLE / 12.92 END + 0.715160 * CASE WHEN green / 255.0::DOUBLE > 0.04045 THEN power((green / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE green / 255.0::DOUBLE / 12.92 END + 0.072169 * CASE WHEN blue / 255.0::DOUBLE > 0.04045 THEN power((blue / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE blue / 255.0::DOUBLE / 12.92 END AS y0 FROM rgb)")
def lab_lightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb(spark, sf_dir).select("r", "c", px.lab(F.col("red"), F.col("green"), F.col("blue"))["l"].alias("l"))


@query()
def footprint_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored tiles to cleaned, numbered footprints, of two scorers merged."""
    h, own = height(spark, sf_dir), proba(spark, sf_dir)
    run = lambda f: footprints.footprints(footprints.predicted(own, lambda t: t.withColumn("score", f), h, WIDTH, 32, 0.25), h, WIDTH, 0.46, least_m2=0.5)
    return footprints.merged({"a": run(F.col("p")), "b": run(F.col("p") * 0.98)})


@query()
def region_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of all regions as rings; outer areas less inner ones are the pixels."""
    from ..functions.vector import shoelace

    rings = regions.rings(regions.label_regions(mask(spark, sf_dir), WIDTH, 8))
    area = F.when(F.col("outer"), shoelace(F.col("ring"))).otherwise(-shoelace(F.col("ring")))
    return rings.groupBy("comp").agg(F.sum(area).alias("area"), F.count("*").alias("n_rings"))


def _road(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    h = height(spark, sf_dir)
    vertices = lines(spark, sf_dir).select("line", "seq", (F.col("seq") % WIDTH).cast("double").alias("x"), ((F.col("line") * 3 + F.floor(F.col("seq") / 4)) % h).cast("double").alias("y"))
    return vertices, raster(spark, sf_dir).where("q >= 128").select("r", "c"), h


@query()
def snap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines snapped to evidence, and how well it carries them."""
    vertices, evidence, h = _road(spark, sf_dir)
    return roads.snap_status(roads.snapped(vertices, evidence, h, WIDTH, 4, 0.3, 0.3, 9.0, 4))


@query()
def ribbon_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths measured left and right of lines by walking over like pixels, then one width a line."""
    vertices, like, _ = _road(spark, sf_dir)
    normal = roads.with_normals(vertices).withColumnRenamed("seq", "i")
    side = lambda n, s: normal.select("line", "i", F.lit(n).alias("side"), "x", "y", (s * F.col("nx")).alias("dx"), (s * F.col("ny")).alias("dy"))
    reach = roads.walked(side("left", -1).union(side("right", 1)), like, 0.5, 0.5, 8.0, 1.5)
    both = reach.groupBy("line", "i").pivot("side", ["left", "right"]).agg(F.first("reach"))
    widths = roads.ribbon_widths(both)
    return widths.groupBy("line").agg(F.count("*").alias("n"), F.round(F.max("width"), 4).alias("width"), F.round(F.avg("left"), 4).alias("left"), F.round(F.avg("right"), 4).alias("right"))


@query(
    f"""{sql('size', 'lines', 'rgb')}, v AS (SELECT line, seq - 1 AS i, CAST(seq % 64 AS DOUBLE) AS x, CAST((line * 3 + seq // 4) % h AS DOUBLE) AS y FROM lines CROSS JOIN size),
    d AS (SELECT *, coalesce(lead(x) OVER o, lag(x) OVER o, x) - x AS dx, coalesce(lead(y) OVER o, lag(y) OVER o, y) - y AS dy FROM v WINDOW o AS (PARTITION BY line ORDER BY i)),
    n AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) < 1e-3 THEN 0.0 ELSE -dy / sqrt(dx * dx + dy * dy) END AS nx, CASE WHEN sqrt(dx * dx + dy * dy) < 1e-3 THEN 1.0 ELSE dx / sqrt(dx * dx + dy * dy) END AS ny FROM d),
    bands AS (SELECT * FROM (SELECT line, min(i) AS i, max(i) + 1 AS j FROM v GROUP BY line, i // 12) CROSS JOIN (VALUES (1, 0.0::DOUBLE, 4.0::DOUBLE), (-1, 1.0::DOUBLE, 3.0::DOUBLE)) AS s(side, lo, hi)),
    k AS (SELECT *, least(6, j - i) AS n, unnest(range(least(6, j - i))) AS t FROM bands),
    picked AS (SELECT DISTINCT line, i, j, side, lo, hi, CASE WHEN n = 1 THEN i WHEN t = n - 1 THEN j - 1 ELSE CAST(floor(i + t * ((j - 1 - i) / (n - 1)::DOUBLE)) AS BIGINT) END AS at FROM k),
    places AS (SELECT *, lo + 0.35 + u * ((hi - 0.2 - (lo + 0.35)) / 3) AS far FROM picked CROSS JOIN range(4) AS a(u)),
    spots AS (SELECT p.line, p.i, p.j, p.side, CAST(round_even(n.y + p.side * n.ny * far, 0) AS BIGINT) AS r, CAST(round_even(n.x + p.side * n.nx * far, 0) AS BIGINT) AS c FROM places p JOIN n ON n.line = p.line AND n.i = p.at),
    seen AS (SELECT s.line, s.i, s.j, s.side, CASE WHEN {NOT_ROAD} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS off_road, CASE WHEN {PAVEMENT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS paved FROM spots s JOIN rgb USING (r, c))
    SELECT b.line, b.i, b.j, b.side, round(coalesce(avg(paved), 0), 8) AS paved, round(coalesce(avg(off_road), 0), 8) AS off_road
    FROM bands b LEFT JOIN seen s ON b.line = s.line AND b.i = s.i AND b.j = s.j AND b.side = s.side GROUP BY 1, 2, 3, 4"""
)
def band_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paved and clearly off-road shares of bands on both sides of each line, twelve stations at a time."""
    vertices, _, _ = _road(spark, sf_dir)
    own = roads.with_normals(vertices).withColumn("i", F.col("seq") - 1)
    spans = own.groupBy("line", F.floor(F.col("i") / 12)).agg(F.min("i").alias("i"), (F.max("i") + 1).alias("j"))
    side = lambda s, lo, hi: spans.select("line", "i", "j", F.lit(s).alias("side"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    band = (F.col("red"), F.col("green"), F.col("blue"))
    found = roads.band_shares(side(1, 0.0, 4.0).union(side(-1, 1.0, 3.0)), own, rgb(spark, sf_dir), {"paved": px.pavement(*band), "off_road": px.not_road(*band)})
    return found.select("line", "i", "j", "side", F.round("paved", 8).alias("paved"), F.round("off_road", 8).alias("off_road"))


@query()
def greedy_join_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of lines joined to the nearest free ends."""
    own = points(spark, sf_dir)
    ends = own.select(F.col("id").alias("end"), F.floor(F.col("id") / 2).alias("line"), "x", "y")
    return roads.joined_ends(ends, 8.0)


@query()
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact points clustered in order by their running centre."""
    own = points(spark, sf_dir).select(F.col("id").alias("ord"), "x", "y")
    found = roads.clustered(own, 12.0)
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.min("ord").alias("first")).select("first", "n")


@query()
def ground_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects dilated, shadows grown in, and the holes filled from the nearest ground."""
    objects = raster(spark, sf_dir).where("q >= 185").select("r", "c")
    return ground.bare_ground(rgb(spark, sf_dir), objects, height(spark, sf_dir), WIDTH)


@query(
    f"""{sql('rgb')}, y AS (SELECT *, 0.2126::DOUBLE * red + 0.7152::DOUBLE * green + 0.0722::DOUBLE * blue AS y FROM rgb), e AS (SELECT CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx FROM (SELECT unnest(range(-3, 4)) AS dy) CROSS JOIN (SELECT unnest(range(-3, 4)) AS dx) WHERE abs(dx) <= round(3 * sqrt((9 - dy * dy) / 9.0::DOUBLE))),
    t AS (SELECT a.r, a.c, max(b.y) AS top FROM y a CROSS JOIN e JOIN y b ON b.r = a.r + e.dy AND b.c = a.c + e.dx GROUP BY a.r, a.c),
    s AS (SELECT y.*, CASE WHEN q % 5 > 0 AND y < 0.55::DOUBLE * greatest(top, 1.0) AND y >= 3 THEN least(greatest(top / greatest(y, 1.0), 1.0), 3.0) ELSE 1.0 END AS scale
          FROM y JOIN t ON y.r = t.r AND y.c = t.c JOIN raster q ON y.r = q.r AND y.c = q.c)
    SELECT r, c, CAST(trunc(least(red * scale, 255.0)) AS INT) AS red, CAST(trunc(least(green * scale, 255.0)) AS INT) AS green, CAST(trunc(least(blue * scale, 255.0)) AS INT) AS blue FROM s"""
)
def shadow_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = raster(spark, sf_dir).where("q % 5 > 0").select("r", "c")
    return ground.lifted_shadows(rgb(spark, sf_dir), known, 3, 0.55)


@query(
    f"""{sql('rgb', 'mask')}, y AS (SELECT rgb.*, 0.2126::DOUBLE * red + 0.7152::DOUBLE * green + 0.0722::DOUBLE * blue AS y, mask.r IS NOT NULL AS hole FROM rgb LEFT JOIN mask ON rgb.r = mask.r AND rgb.c = mask.c),
    a AS (SELECT r, c, count(*) FILTER (NOT hole) OVER w AS n, coalesce(sum(y) FILTER (NOT hole) OVER w, 0) AS s FROM y WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    d AS (SELECT r, c, sum(n) OVER w AS n, sum(s) OVER w AS s FROM a WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    l AS (SELECT y.*, CASE WHEN n > 8 THEN s / n ELSE (SELECT median(y) FROM y WHERE NOT hole) END AS local FROM y JOIN d ON y.r = d.r AND y.c = d.c),
    s AS (SELECT *, CASE WHEN hole AND y < 0.8::DOUBLE * local AND y > 1 THEN least(greatest(0.92::DOUBLE * local / greatest(y, 1.0), 1.0), 3.5) ELSE 1.0 END AS scale FROM l)
    SELECT r, c, CAST(trunc(least(red * scale, 255.0)) AS INT) AS red, CAST(trunc(least(green * scale, 255.0)) AS INT) AS green, CAST(trunc(least(blue * scale, 255.0)) AS INT) AS blue FROM s"""
)
def relight_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.relit(rgb(spark, sf_dir), mask(spark, sf_dir), 3, 0.8)


@query(
    f"""{sql('size', 'mask')}, box AS (SELECT CAST(a.i AS BIGINT) AS r, CAST(b.i AS BIGINT) AS c FROM (SELECT unnest(range(0, 500)) AS i) a CROSS JOIN (SELECT unnest(range(0, 64)) AS i) b),
    t AS (SELECT r, c, least(greatest(((c - 5) * 40.0::DOUBLE + (r - 10) * 30.0::DOUBLE) / 2500, 0.0), 1.0) AS t FROM box), hit AS (SELECT r, c FROM t WHERE sqrt((c - 5 - t * 40) * (c - 5 - t * 40) + (r - 10 - t * 30) * (r - 10 - t * 30)) <= 6.3)
    SELECT r, c FROM mask UNION SELECT r, c FROM hit"""
)
def brush_stroke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brush drawn along a segment."""
    return ground.brushed(mask(spark, sf_dir), (5.0, 10.0, 45.0, 40.0), 6.3, height(spark, sf_dir), WIDTH)


@query(
    f"""{sql('mask')}, log AS (SELECT event_id AS seq, (event_id * 7) % 500 AS r, (event_id * 13) % 64 AS c, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS value FROM events WHERE event_id <= 6000),
    last AS (SELECT r, c, arg_max(value, seq) AS value FROM log GROUP BY r, c)
    SELECT coalesce(m.r, l.r) AS r, coalesce(m.c, l.c) AS c FROM mask m FULL OUTER JOIN last l ON m.r = l.r AND m.c = l.c WHERE coalesce(l.value, 1) = 1"""
)
def edits_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask after an edit log up to a version."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") * 7) % 500).alias("r"), ((F.col("event_id") * 13) % 64).alias("c"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("value"))
    return ground.replayed(mask(spark, sf_dir), log, 6000)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows, the same code as for a stream."""
    made = incremental.windowed(table(spark, sf_dir, "events"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of an hour's gap."""
    return incremental.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files drained through a stream into batches; together they are the table."""
    events = table(spark, sf_dir, "events")
    found: list[DataFrame] = []
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    incremental.drain(stream, lambda batch, _: found.append(cut(batch.groupBy("event_type").agg(F.count("*").alias("n")))), f"{shared_folder(spark)}/stream-{uuid4().hex}")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole.groupBy("event_type").agg(F.sum("n").alias("n"))


@query(f"{sql('stations')} SELECT line, count(w) AS n, round(min(w), 6) AS low, round(avg(w), 6) AS mean, round(median(w), 6) AS mid, round(max(w), 6) AS high FROM stations GROUP BY line")
def width_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations(spark, sf_dir).groupBy("line").agg(F.count("w").alias("n"), *[F.round(f("w"), 6).alias(n) for f, n in ((F.min, "low"), (F.avg, "mean"), (F.median, "mid"), (F.max, "high"))])


@query()
def split_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching objects told apart by their cores."""
    dense = raster(spark, sf_dir).where("q >= 118").select("r", "c")
    return regions.split_instances(dense, stencil.ellipse(3), height(spark, sf_dir), WIDTH)


@query(
    f"""{sql('raster')}, t AS (SELECT r, c, r + 0.25::DOUBLE AS y, c + 0.5::DOUBLE AS x FROM raster),
    a AS (SELECT t.*, s.q, (1 - abs(y - s.r)) * (1 - abs(x - s.c)) AS w FROM t JOIN raster s ON s.r BETWEEN floor(y) AND floor(y) + 1 AND s.c BETWEEN floor(x) AND floor(x) + 1)
    SELECT r, c, round(sum(w * q) / sum(w), 6) AS q FROM a WHERE w > 0 GROUP BY r, c"""
)
def warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling at shifted places, four neighbours each."""
    from ..operators.tiling import warped

    own = raster(spark, sf_dir)
    return warped(own, own, F.col("r") + 0.25, F.col("c") + 0.5, "q").select("r", "c", F.round("q", 6).alias("q"))


@query(
    f"""{sql('lines')}, n AS (SELECT line, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM lines WINDOW w AS (PARTITION BY line ORDER BY seq)),
    t AS (SELECT line, coalesce(sum(d), 0.0) AS length FROM n GROUP BY line), k AS (SELECT *, greatest(1, CAST(ceil(length / 380.0::DOUBLE) AS BIGINT)) AS n FROM t), e AS (SELECT *, unnest(range(0, n)) AS part FROM k)
    SELECT line, CAST(part AS BIGINT) AS part, round(length * part / n, 4) AS s0, round(length * (part + 1) / n, 4) AS s1 FROM e"""
)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.series import arc_length

    whole = arc_length(lines(spark, sf_dir), "line", "seq").groupBy("line").agg(F.max("s").alias("length"))
    return roads.chunked(whole, "line", "length", 380.0).select("line", F.col("part").cast("long").alias("part"), F.round("s0", 4).alias("s0"), F.round("s1", 4).alias("s1"))


@query(
    """WITH m AS (SELECT o_orderkey AS id, (o_orderkey % 60)::DOUBLE AS length, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 13)::DOUBLE END AS width, (o_orderkey % 30) / 100.0::DOUBLE AS skip, o_orderkey % 9 AS inliers, o_orderkey % 50 + 1 AS samples, (o_orderkey % 17)::DOUBLE AS after FROM orders)
    SELECT id, length >= 8 AND (width IS NULL OR skip >= 0.22 OR (skip >= 0.10 AND width <= 3.6) OR (inliers < greatest(4, floor(0.12::DOUBLE * samples)) AND length >= 20)) AS needs,
           after >= width + 0.45 AND after <= CASE WHEN width >= 18 THEN greatest(18.0, width * 1.35) WHEN width >= 6 THEN least(width + 2.2, 12.0) ELSE least(10.5, greatest(width + 6, 8.5)) END + 1e-6 AS accepts FROM m"""
)
def clean_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines are measured again, and whether the second measure stands."""
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 60).cast("double").alias("length"), F.when(k % 11 > 0, (k % 13).cast("double")).alias("width"), ((k % 30) / 100.0).alias("skip"),
        (k % 9).alias("inliers"), (k % 50 + 1).alias("samples"), (k % 17).cast("double").alias("after"),
    )
    needs = roads.needs_clean(F.col("length"), F.col("width"), F.col("skip"), F.col("inliers"), F.col("samples"))
    return own.select("id", needs.alias("needs"), roads.accept_clean(F.col("width"), F.col("after")).alias("accepts"))


@query()
def missing_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that no line covers, thinned to chains of some length."""
    own = raster(spark, sf_dir)
    return roads.proposed(own.where("q >= 100").select("r", "c"), own.where("r % 16 = 0").select("r", "c"), height(spark, sf_dir), WIDTH, 0.3, 1.2, 9.0)
