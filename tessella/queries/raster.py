"""Queries over rasters: tiles, pixels, neighbourhoods, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import LEVEL, WIDTH, height, mask, proba, raster, rgb, sql, sql_tiles
from ..functions import pixels
from ..operators import records, regions, stencil, tiling

QUERIES, ORACLES = {}, {}
TILE, OVERLAP = 32, 0.25


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


TILED = f"{sql('size', 'raster', 'proba')}, {sql_tiles(32, 24)}, tiled AS (SELECT p.*, row_off, col_off FROM proba p JOIN row_offs ON p.r BETWEEN row_off AND row_off + 31 JOIN col_offs ON p.c BETWEEN col_off AND col_off + 31)"


@query(
    f"""{TILED}, scored AS (
        SELECT row_off, col_off, avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS u, avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cover FROM tiled GROUP BY 1, 2)
    SELECT row_off, col_off, round(CASE WHEN cover < 0.01 OR cover > 0.95 THEN u * 0.5 ELSE u END, 8) AS uncertainty, round(cover, 8) AS cover
    FROM scored ORDER BY round(CASE WHEN cover < 0.01 OR cover > 0.95 THEN u * 0.5 ELSE u END, 8) DESC, row_off, col_off LIMIT 30"""
)
def flagship_uncertain_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles to annotate next: mean entropy, halved where nearly all or nothing is covered; a top-k report."""
    h = height(spark, sf_dir)
    tiled = tiling.to_tiles(proba(spark, sf_dir), h, WIDTH, TILE, OVERLAP)
    p = F.col("p")
    scored = tiled.groupBy("row_off", "col_off").agg(F.avg(-(p * F.ln(p) + (1 - p) * F.ln(1 - p))).alias("u"), F.avg((p >= 0.5).cast("double")).alias("cover"))
    score = F.round(F.when((F.col("cover") < 0.01) | (F.col("cover") > 0.95), F.col("u") * 0.5).otherwise(F.col("u")), 8)
    out = scored.select(F.col("row_off").cast("long").alias("row_off"), F.col("col_off").cast("long").alias("col_off"), score.alias("uncertainty"), F.round("cover", 8).alias("cover"))
    return out.orderBy(F.desc("uncertainty"), "row_off", "col_off").limit(30)


@query(
    f"""{sql('size')}, {sql_tiles(48, 36)}
    SELECT row_number() OVER (ORDER BY row_off, col_off) - 1 AS tile_idx, row_off, col_off, least(48, h - row_off) AS height, least(48, w - col_off) AS width,
           48 - least(48, h - row_off) AS pad_bottom, 48 - least(48, w - col_off) AS pad_right
    FROM row_offs CROSS JOIN col_offs CROSS JOIN size"""
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tiling.tile_grid(spark, height(spark, sf_dir), WIDTH, 48, OVERLAP)
    return grid.select([F.col(c).cast("long").alias(c) for c in grid.columns])


@query(
    f"""{TILED}, shares AS (
        SELECT row_off, col_off, avg(CASE WHEN p < 0.45 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dark FROM tiled GROUP BY 1, 2)
    SELECT row_off, col_off, round(dark, 8) AS dark FROM shares WHERE dark < 0.9"""
)
def tile_empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are not mostly empty."""
    own = proba(spark, sf_dir).withColumn("dark", (F.col("p") >= 0.45).cast("int"))
    tiled = tiling.to_tiles(own, height(spark, sf_dir), WIDTH, TILE, OVERLAP)
    shares = tiling.mostly_empty(tiled, ["row_off", "col_off"], ["dark"], None, 0.9)
    return shares.where("not is_empty").select(F.col("row_off").cast("long").alias("row_off"), F.col("col_off").cast("long").alias("col_off"), F.round("empty_share", 8).alias("dark"))


@query(
    f"""{sql('raster')}, p AS (SELECT quantile_cont(q, 0.005) AS low, quantile_cont(q, 0.995) AS high FROM raster)
    SELECT r, c, CAST(floor(round(least(greatest((q - low) / CASE WHEN high <= low THEN 1.0 ELSE high - low END, 0.0), 1.0) * 255, 6)) AS BIGINT) AS v FROM raster CROSS JOIN p"""
)
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To 8 bits between two exact percentiles, which are two numbers and sent to all rows."""
    own = raster(spark, sf_dir)
    p = own.agg(F.percentile("q", F.array(F.lit(0.005), F.lit(0.995))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    unit = F.least(F.greatest((F.col("q") - low) / F.when(high <= low, 1.0).otherwise(high - low), F.lit(0.0)), F.lit(1.0))
    return own.crossJoin(F.broadcast(p)).select("r", "c", F.floor(F.round(unit * 255, 6)).alias("v"))


@query(f"{TILED} SELECT r, c, round(avg(p * (1 + (row_off + col_off) % 3)), 8) AS p FROM tiled GROUP BY r, c")
def overlap_mean_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles score a pixel differently; the mosaic has their mean."""
    tiled = tiling.to_tiles(proba(spark, sf_dir), height(spark, sf_dir), WIDTH, TILE, OVERLAP)
    scored = tiled.withColumn("score", F.col("p") * (1 + (F.col("row_off") + F.col("col_off")) % 3))
    return tiling.overlap_mean(scored, "score", "p").select("r", "c", F.round("p", 8).alias("p"))


@query(
    f"""{sql('proba')} SELECT r // 64 AS band, CAST(sum(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS n_px,
        round(sum(CASE WHEN p >= 0.6 THEN 0.09::DOUBLE ELSE 0.0::DOUBLE END), 6) AS area_m2, round(avg(CASE WHEN p >= 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS share
    FROM proba GROUP BY 1 HAVING sum(CASE WHEN p >= 0.6 THEN 0.09::DOUBLE ELSE 0.0::DOUBLE END) >= 5"""
)
def threshold_mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = proba(spark, sf_dir).withColumn("m", (F.col("p") >= 0.6).cast("int"))
    area = own.groupBy(F.floor(F.col("r") / 64).alias("band")).agg(F.sum("m").alias("n_px"), F.sum(F.when(F.col("m") == 1, 0.09).otherwise(0.0)).alias("a"), F.avg("m").alias("s"))
    return area.where("a >= 5").select("band", "n_px", F.round("a", 6).alias("area_m2"), F.round("s", 8).alias("share"))


@query(
    f"""{sql('size')}, {sql_tiles(32, 24)}, numbered AS (SELECT row_number() OVER (ORDER BY row_off, col_off) - 1 AS tile_idx, row_off, col_off FROM row_offs CROSS JOIN col_offs)
    SELECT tile_idx, row_off, col_off FROM numbered WHERE tile_idx % greatest(1, (SELECT count(*) FROM numbered) // 16) = 0"""
)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th tile where there are too many: a sampling operator."""
    h = height(spark, sf_dir)
    grid = tiling.tile_grid(spark, h, WIDTH, TILE, OVERLAP)
    count = grid.agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 16))
    return grid.crossJoin(F.broadcast(count)).where(F.col("tile_idx") % step == 0).select(*[F.col(c).cast("long").alias(c) for c in ("tile_idx", "row_off", "col_off")])


@query(f"{sql('rgb')} SELECT r, c, round(0.2126 * red + 0.7152 * green + 0.0722 * blue, 6) AS luma, 2 * green - red - blue AS eg FROM rgb")
def luma_excess_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = (F.col("red"), F.col("green"), F.col("blue"))
    return rgb(spark, sf_dir).select("r", "c", F.round(pixels.luma(*band), 6).alias("luma"), pixels.excess_green(*band).alias("eg"))


NOT_ROAD = """((green >= red + 6 AND green >= blue + 6 AND 2 * green - red - blue >= 12) OR (blue >= green + 16 AND blue >= red + 30 AND blue >= 48)
    OR (red >= green + 28 AND red >= blue + 28 AND red >= 70) OR (red >= green + 22 AND blue >= green + 22 AND greatest(red, blue) >= 70))"""
PAVEMENT = f"""NOT {NOT_ROAD} AND NOT (green >= red + 3 AND green >= blue + 3) AND NOT (greatest(red, green, blue) >= 30 AND greatest(red, green, blue) - least(red, green, blue) >= 50)"""


@query(
    f"""{sql('rgb')} SELECT r, c, CASE WHEN {NOT_ROAD} THEN 1 ELSE 0 END AS not_road,
        CASE WHEN {PAVEMENT} THEN 1 ELSE 0 END AS pavement FROM rgb"""
)
def not_road_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = (F.col("red"), F.col("green"), F.col("blue"))
    return rgb(spark, sf_dir).select("r", "c", pixels.not_road(*band).cast("int").alias("not_road"), pixels.pavement(*band).cast("int").alias("pavement"))


@query(
    f"""{sql('rgb', 'mask')} SELECT a.r, a.c, CASE WHEN m.r IS NULL THEN red ELSE CAST(floor(round(least(greatest(1.25::DOUBLE * red + 40, 0.0), 255.0) * 0.5::DOUBLE + 255 * 0.5::DOUBLE, 6)) AS BIGINT) END AS red,
        CASE WHEN m.r IS NULL THEN green ELSE CAST(floor(round(least(greatest(1.25::DOUBLE * green + 40, 0.0), 255.0) * 0.5::DOUBLE + 32 * 0.5::DOUBLE, 6)) AS BIGINT) END AS green
    FROM rgb a LEFT JOIN mask m ON a.r = m.r AND a.c = m.c"""
)
def overlay_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tint over the mask; pixels outside keep their colour."""
    own = rgb(spark, sf_dir).join(mask(spark, sf_dir).withColumn("m", F.lit(1)), ["r", "c"], "left")
    tinted = lambda c, t: F.when(F.col("m").isNull(), F.col(c)).otherwise(pixels.blend(F.col(c), t, F.lit(0.5)).cast("long")).alias(c)
    return own.select("r", "c", tinted("red", 255), tinted("green", 32))


def _grown(source: str, name: str, offsets: list[tuple[int, int]]) -> str:
    values = ", ".join(f"({a}, {b})" for a, b in offsets)
    return f"{name} AS (SELECT DISTINCT m.r + o.dy AS r, m.c + o.dx AS c FROM {source} m CROSS JOIN (VALUES {values}) o(dy, dx) CROSS JOIN size WHERE m.r + o.dy BETWEEN 0 AND h - 1 AND m.c + o.dx BETWEEN 0 AND w - 1)"


def _shrunk(source: str, name: str, offsets: list[tuple[int, int]]) -> str:
    values = ", ".join(f"({a}, {b})" for a, b in offsets)
    return f"""{name} AS (SELECT m.r, m.c FROM {source} m CROSS JOIN (VALUES {values}) o(dy, dx) CROSS JOIN size LEFT JOIN {source} n ON n.r = m.r + o.dy AND n.c = m.c + o.dx
        WHERE m.r + o.dy BETWEEN 0 AND h - 1 AND m.c + o.dx BETWEEN 0 AND w - 1 GROUP BY m.r, m.c HAVING count(*) = count(n.r))"""


CROSS, DISC = stencil.ellipse(3), stencil.ellipse(5)


@query(f"{sql('size', 'raster')}, dense AS (SELECT r, c FROM raster WHERE q >= 105), {_shrunk('dense', 'e1', CROSS)}, {_grown('e1', 'opened', CROSS)}, {_grown('opened', 'd1', DISC)}, {_shrunk('d1', 'closed', DISC)} SELECT r, c FROM closed")
def morph_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense mask cleaned: specks go, then gaps close."""
    dense = raster(spark, sf_dir).where("q >= 105").select("r", "c")
    return stencil.open_close(dense, 3, 5, height(spark, sf_dir), WIDTH)


@query(f"{sql('size', 'mask')}, {_grown('mask', 'd', DISC)}, {_shrunk('mask', 'e', stencil.square(3))} SELECT 'dilated' AS kind, r // 64 AS band, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'eroded', r // 64, count(*) FROM e GROUP BY 2")
def dilate_erode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, h = mask(spark, sf_dir), height(spark, sf_dir)
    count = lambda df, kind: df.groupBy(F.floor(F.col("r") / 64).alias("band")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "band", "n")
    return count(stencil.dilate(own, DISC, h, WIDTH), "dilated").union(count(stencil.erode(own, stencil.square(3), h, WIDTH), "eroded"))


@query(
    f"""{sql('raster')}, across AS (SELECT r, c, count(CASE WHEN q < 200 THEN 1 END) OVER w AS n, sum(CASE WHEN q < 200 THEN q ELSE 0 END) OVER w AS s, sum(CASE WHEN q < 200 THEN q * q ELSE 0 END) OVER w AS qq
        FROM raster WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    down AS (SELECT r, c, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(qq) OVER w AS qq FROM across WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT r, c, CASE WHEN n >= 12 THEN round(CAST(s AS DOUBLE) / n, 6) END AS mean, CASE WHEN n >= 12 THEN round(sqrt(greatest(CAST(qq AS DOUBLE) / n - (CAST(s AS DOUBLE) / n) * (CAST(s AS DOUBLE) / n), 0.0)), 6) END AS std FROM down"""
)
def box_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = raster(spark, sf_dir).withColumn("v", F.when(F.col("q") < 200, F.col("q")))
    return stencil.box_mean_std(known, "v", 2, 12).select("r", "c", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""{sql('raster')}, a AS (SELECT r, c, max(q) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM raster)
    SELECT r, c, max(m) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS local_max FROM a"""
)
def local_max_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.box(raster(spark, sf_dir), 3, "local_max", F.max, F.col("q")).select("r", "c", "local_max")


@query(
    f"""{sql('raster', 'mask')}, offs AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range(-4, 5)) AS d) a CROSS JOIN (SELECT unnest(range(-4, 5)) AS d) b WHERE a.d * a.d + b.d * b.d <= 16),
    near AS (SELECT m.r + dy AS r, m.c + dx AS c, min(dy * dy + dx * dx) AS d2 FROM mask m CROSS JOIN offs GROUP BY 1, 2)
    SELECT p.r, p.c, CAST(n.d2 AS BIGINT) AS d2 FROM raster p LEFT JOIN near n ON p.r = n.r AND p.c = n.c"""
)
def distance_field_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.distance_within(raster(spark, sf_dir), mask(spark, sf_dir), 4).select("r", "c", F.col("d2").cast("long").alias("d2"))


@query(
    f"""{sql('raster')}, seeds AS (SELECT r, c, q % 4 AS cls FROM raster WHERE q >= 180), offs AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range(-4, 5)) AS d) a CROSS JOIN (SELECT unnest(range(-4, 5)) AS d) b WHERE a.d * a.d + b.d * b.d <= 16),
    near AS (SELECT m.r + dy AS r, m.c + dx AS c, dy * dy + dx * dx AS d2, cls FROM seeds m CROSS JOIN offs),
    best AS (SELECT r, c, d2, cls, row_number() OVER (PARTITION BY r, c ORDER BY d2, cls) AS rn FROM near)
    SELECT p.r, p.c, CAST(b.d2 AS BIGINT) AS d2, b.cls FROM raster p LEFT JOIN best b ON p.r = b.r AND p.c = b.c AND b.rn = 1"""
)
def nearest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raster(spark, sf_dir)
    seeds = own.where("q >= 180").select("r", "c", (F.col("q") % 4).alias("cls"))
    return stencil.nearest_class(own, seeds, 4).select("r", "c", F.col("d2").cast("long").alias("d2"), "cls")


def _regions(source: str, steps: str, name: str = "labels") -> str:
    """Labels by reachability, as a recursive relation over ``source``."""
    return f"""edges AS (SELECT a.r * 64 + a.c AS u, b.r * 64 + b.c AS v FROM {source} a CROSS JOIN (VALUES {steps}) o(dy, dx) JOIN {source} b ON b.r = a.r + o.dy AND b.c = a.c + o.dx),
    reach(u, root) AS (SELECT r * 64 + c, r * 64 + c FROM {source} UNION SELECT e.v, reach.root FROM reach JOIN edges e ON reach.u = e.u WHERE reach.root < e.v),
    {name} AS (SELECT u // 64 AS r, u % 64 AS c, min(root) AS comp FROM reach GROUP BY u)"""


ALL8 = "(-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)"
ALL4 = "(-1,0),(0,-1),(0,1),(1,0)"
STATS = "SELECT comp, count(*) AS area_px, round(count(*) * 0.09::DOUBLE, 6) AS area_m2, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM labels GROUP BY comp"


@query(f"{sql('mask', recursive=True)}, {_regions('mask', ALL8)} {STATS}")
def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints: regions of the mask with area and box."""
    stats = regions.region_stats(regions.label_regions(mask(spark, sf_dir), WIDTH, 8), 0.3)
    return stats.select("comp", "area_px", F.round("area_m2", 6).alias("area_m2"), "x", "y", "w", "h")


@query(
    f"""{sql('size', 'raster', recursive=True)}, back AS (SELECT r, c FROM raster WHERE q < 108), {_regions('back', ALL4)}
    SELECT comp, count(*) AS area_px FROM labels CROSS JOIN size GROUP BY comp, h, w HAVING min(r) > 0 AND min(c) > 0 AND max(r) < h - 1 AND max(c) < w - 1"""
)
def holes_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of a dense mask: background regions that don't touch the border."""
    h = height(spark, sf_dir)
    dense = raster(spark, sf_dir).where("q >= 108").select("r", "c")
    return regions.holes(dense, h, WIDTH).groupBy("comp").agg(F.count("*").alias("area_px"))


@query(f"{sql('mask', recursive=True)}, {_regions('mask', ALL8)}, stats AS ({STATS}) SELECT row_number() OVER (ORDER BY area_px, y, x, comp) - 1 AS i, row_number() OVER (ORDER BY area_px, y, x, comp) AS id, comp, area_px FROM stats")
def blob_index_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions numbered by size, then place. The numbers come from range-wise counts, not from one task."""
    from ..operators.numbering import numbered

    stats = regions.region_stats(regions.label_regions(mask(spark, sf_dir), WIDTH, 8))
    return numbered(stats, ["area_px", "y", "x", "comp"], "i").select("i", (F.col("i") + 1).alias("id"), "comp", "area_px")


@query(f"{sql('mask', recursive=True)}, {_regions('mask', ALL8)} SELECT l.r, l.c FROM labels l WHERE l.comp IN (SELECT comp FROM labels GROUP BY comp HAVING count(*) >= 3 OR max(CASE WHEN r % 50 = 0 THEN 1 ELSE 0 END) = 1)")
def prune_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small regions go, unless they are protected."""
    labels = regions.label_regions(mask(spark, sf_dir), WIDTH, 8)
    return regions.pruned(labels, 3, F.col("r") % 50 == 0).select("r", "c")


@query(
    f"""{sql('size', 'raster', recursive=True)}, seeds AS (SELECT r, c FROM raster WHERE q >= 185), limits AS (SELECT r, c FROM raster WHERE q >= 125),
    grown(r, c, d) AS (SELECT r, c, 0 FROM seeds UNION SELECT l.r, l.c, g.d + 1 FROM grown g CROSS JOIN (VALUES {ALL8}) o(dy, dx) JOIN limits l ON l.r = g.r + o.dy AND l.c = g.c + o.dx WHERE g.d < 4)
    SELECT DISTINCT r, c FROM grown"""
)
def geodesic_growth_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raster(spark, sf_dir)
    return stencil.geodesic_growth(own.where("q >= 185"), own.where("q >= 125"), 4, height(spark, sf_dir), WIDTH)


@query(f"{sql('mask', recursive=True)}, {_regions('mask', ALL8)} SELECT r, c, comp FROM labels WHERE comp IN (SELECT comp FROM labels WHERE r % 10 = 0 AND c % 2 = 0)")
def seed_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions under seeds; seeds on background are dead."""
    own = mask(spark, sf_dir)
    seeds = raster(spark, sf_dir).where("r % 10 = 0 and c % 2 = 0")
    return regions.with_seed(regions.label_regions(own, WIDTH, 8), seeds).select("r", "c", "comp")


@query(f"{sql('mask', recursive=True)}, {_regions('mask', ALL8)} SELECT r, c FROM labels WHERE comp NOT IN (SELECT comp FROM labels WHERE r % 10 = 0 AND c % 2 = 0)")
def blob_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask without the regions that were clicked."""
    seeds = raster(spark, sf_dir).where("r % 10 = 0 and c % 2 = 0")
    return regions.with_seed(regions.label_regions(mask(spark, sf_dir), WIDTH, 8), seeds, "left_anti").select("r", "c")


@query(
    f"""{TILED}, votes AS (SELECT t.r, t.c, sum(CASE WHEN (q + row_off) % 3 = 0 THEN 1 ELSE 0 END) AS v, count(*) AS n, arg_max((q + col_off) % 5, row_off * 1000 + col_off) AS cls FROM tiled t JOIN raster USING (r, c) GROUP BY 1, 2)
    SELECT r, c, CASE WHEN 2 * v >= n THEN 1 ELSE 0 END AS object, cls FROM votes"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = tiling.to_tiles(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, TILE, OVERLAP)
    return tiling.majority(tiled, (F.col("q") + F.col("row_off")) % 3 == 0, (F.col("q") + F.col("col_off")) % 5, ["row_off", "col_off"])


@query(
    f"""{TILED}, weighted AS (SELECT r, c, p, greatest((0.5 - 0.5 * cos(2 * pi() * (r - row_off) / 31)) * (0.5 - 0.5 * cos(2 * pi() * (c - col_off) / 31)), 1e-3::DOUBLE) AS w, 1 + (row_off + col_off) % 3 AS k FROM tiled)
    SELECT r, c, round(sum(p * k * w) / sum(w), 6) AS v FROM weighted GROUP BY r, c"""
)
def hann_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = tiling.to_tiles(proba(spark, sf_dir), height(spark, sf_dir), WIDTH, TILE, OVERLAP)
    weight = F.greatest(pixels.hann(F.col("r") - F.col("row_off"), TILE) * pixels.hann(F.col("c") - F.col("col_off"), TILE), F.lit(1e-3))
    return tiling.weighted_mean(tiled, F.col("p") * (1 + (F.col("row_off") + F.col("col_off")) % 3), weight, "v").select("r", "c", F.round("v", 6).alias("v"))


@query(f"{sql('raster')} SELECT CAST(4 AS BIGINT) AS z, c // 2 AS x, r // 2 AS y, count(*) AS children, round(sum(q) / 4.0::DOUBLE, 6) AS value FROM raster GROUP BY c // 2, r // 2")
def quad_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = raster(spark, sf_dir).select(F.lit(5).alias("z"), F.col("c").alias("x"), F.col("r").alias("y"), F.col("q").alias("value"))
    return tiling.pyramid_level(tiles).select(F.col("z").cast("long").alias("z"), "x", "y", "children", F.round("value", 6).alias("value"))


@query(f"{sql('raster')} SELECT r // 4 AS r, c // 4 AS c, round(avg(q), 6) AS v FROM raster GROUP BY 1, 2")
def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.area_average(raster(spark, sf_dir), 4, "q", "v").select("r", "c", F.round("v", 6).alias("v"))


@query(f"{sql('size', 'mask')}, votes AS (SELECT a.r, b.c, count(*) AS n FROM (SELECT CAST(unnest(range(0, h - 15)) AS BIGINT) AS r FROM size) a CROSS JOIN (SELECT CAST(unnest(range(0, 49)) AS BIGINT) AS c) b JOIN mask m ON m.r BETWEEN a.r AND a.r + 15 AND m.c BETWEEN b.c AND b.c + 15 GROUP BY 1, 2) SELECT r, c, n FROM votes ORDER BY n DESC, r, c LIMIT 1")
def window_best_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = stencil.best_window(mask(spark, sf_dir), height(spark, sf_dir), WIDTH, 16, 16)
    return best.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "n")


@query(f"{sql('size', 'raster')}, labels AS (SELECT r, c, q % 7 AS label FROM raster WHERE q >= 185), g AS (SELECT DISTINCT l.r + o.dy AS r, l.c + o.dx AS c, label FROM labels l CROSS JOIN (VALUES (-1,0),(0,-1),(0,0),(0,1),(1,0)) o(dy, dx) CROSS JOIN size WHERE l.r + o.dy BETWEEN 0 AND h - 1 AND l.c + o.dx BETWEEN 0 AND w - 1) SELECT r, c, min(label) AS label FROM g GROUP BY r, c HAVING count(*) = 1")
def expand_keep_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances grown by a cross; pixels that two claim stay a gap."""
    labels = raster(spark, sf_dir).where("q >= 185").select("r", "c", (F.col("q") % 7).alias("label"))
    return stencil.claimed_once(labels, CROSS, height(spark, sf_dir), WIDTH)


@query(f"{sql('raster')} SELECT a.r, a.c, coalesce(n.q, 0) + coalesce(s.q, 0) + coalesce(e.q, 0) + coalesce(w.q, 0) - 4 * a.q AS lap FROM raster a LEFT JOIN raster n ON n.r = a.r - 1 AND n.c = a.c LEFT JOIN raster s ON s.r = a.r + 1 AND s.c = a.c LEFT JOIN raster e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN raster w ON w.r = a.r AND w.c = a.c - 1")
def high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = {(0, 0): -4, (-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1}
    return stencil.weighted(raster(spark, sf_dir), kernel, "q", "lap").select("r", "c", F.col("lap").cast("long").alias("lap"))


@query(f"{sql('raster')} SELECT count(*) AS n, count(DISTINCT q) AS n_values, min(q) AS low, max(q) AS high FROM raster")
def raster_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("q").alias("n_values"), F.min("q").alias("low"), F.max("q").alias("high"))




@query(
    f"""{sql('raster', 'size')}, {sql_tiles(32, 24)}, shares AS (
        SELECT row_off, col_off, avg(CASE WHEN q >= 175 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS crop, avg(CASE WHEN q >= 205 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS water, avg(CASE WHEN q < 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS road
        FROM row_offs CROSS JOIN col_offs JOIN raster ON r >= row_off AND r < row_off + 32 AND c >= col_off AND c < col_off + 32 GROUP BY 1, 2)
    SELECT CAST(row_off AS BIGINT) AS row_off, CAST(col_off AS BIGINT) AS col_off, round(crop, 8) AS crop, round(water, 8) AS water, round(road, 8) AS road, crop >= 0.02 AS positive, crop < 0.01 AS negative, water < 1e-4 AS blank,
        water > 0 OR road > 0 OR substr(md5('chips:' || row_off || '_' || col_off), 1, 8) < '26666666' AS kept FROM shares"""
)
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips by the share of their classes: positives, negatives, blank ones, and those to keep, with a hashed share of the rest."""
    tiled = tiling.to_tiles(raster(spark, sf_dir), height(spark, sf_dir), WIDTH, TILE, OVERLAP)
    shares = tiling.class_shares(tiled, ["row_off", "col_off"], {"crop": F.col("q") >= 175, "water": F.col("q") >= 205, "road": F.col("q") < 35})
    chip = F.concat_ws("_", F.col("row_off").cast("string"), F.col("col_off").cast("string"))
    kept = (F.col("water") > 0) | (F.col("road") > 0) | records.hash_share(chip, "chips", 0.15)
    return shares.select(
        F.col("row_off").cast("long").alias("row_off"), F.col("col_off").cast("long").alias("col_off"), *[F.round(c, 8).alias(c) for c in ("crop", "water", "road")],
        (F.col("crop") >= 0.02).alias("positive"), (F.col("crop") < 0.01).alias("negative"), (F.col("water") < 1e-4).alias("blank"), kept.alias("kept"),
    )


@query(
    f"""{sql('rgb')}, own AS (SELECT r // 24 AS chip_r, c // 12 AS chip_c, * FROM rgb WHERE red >= {LEVEL}),
    bounds AS (SELECT chip_r, chip_c, min(r) AS r0, min(c) AS c0, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w, sum(CASE WHEN greatest(red, green, blue) > 0 THEN 1 ELSE 0 END) AS lit FROM own GROUP BY 1, 2),
    kept AS (SELECT *, greatest(h, w, 16) AS side FROM bounds WHERE h >= 8 AND w >= 8 AND 20 * lit >= h * w),
    rows_ AS (SELECT *, unnest(range(side)) AS i FROM kept), cells AS (SELECT *, unnest(range(side)) AS j FROM rows_),
    placed AS (SELECT *, i - (side - h) // 2 AS y, j - (side - w) // 2 AS x FROM cells),
    shown AS (SELECT p.chip_r, p.chip_c, p.i, p.j, o.red, o.green, o.blue, CASE WHEN y >= 0 AND y < h AND x >= 0 AND x < w THEN 0 ELSE 114 END AS fill
        FROM placed p LEFT JOIN own o ON o.chip_r = p.chip_r AND o.chip_c = p.chip_c AND o.r = p.r0 + p.y AND o.c = p.c0 + p.x)
    SELECT chip_r, chip_c, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(coalesce(red, fill) AS BIGINT) AS red, CAST(coalesce(green, fill) AS BIGINT) AS green, CAST(coalesce(blue, fill) AS BIGINT) AS blue FROM shown"""
)
def square_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright footprints cut out by block, too small or dark ones left out, padded to squares."""
    own = rgb(spark, sf_dir).where(F.col("red") >= LEVEL).withColumn("chip_r", F.floor(F.col("r") / 24)).withColumn("chip_c", F.floor(F.col("c") / 12))
    bands = ["red", "green", "blue"]
    return tiling.square_chips(own, ["chip_r", "chip_c"], bands).select("chip_r", "chip_c", *[F.col(c).cast("long").alias(c) for c in ("i", "j", *bands)])
