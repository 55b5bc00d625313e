"""What SQL can't express, and edge cases, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geo, pixels, vector
from tessella.operators import crossing, graph, numbering, records, regions, series, spatial, stencil, tiling
from tessella.plans import footprints, ground, roads
from tessella.sources import files, geotiff, png, shapefile
from tessella.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("size,tile,overlap,want", [(768, 256, 0.25, [0, 192, 384, 512]), (100, 256, 0.25, [0]), (256, 256, 0, [0]), (10, 3, 0.5, [0, 1, 2, 3, 4, 5, 6, 7])])
def test_tile_offsets(spark, size, tile, overlap, want):
    stride = tiling.step(tile, overlap)
    assert spark.range(1).select(tiling.offsets(size, tile, stride)).first()[0] == want
    places = spark.range(size).select(F.col("id").cast("int").alias("p"))
    for p, offs in places.select("p", tiling.covering(F.col("p"), size, tile, stride).alias("o")).collect():
        assert sorted(offs) == [o for o in want if o <= p < o + tile]


def test_bad_overlap():
    with pytest.raises(ValueError):
        tiling.step(10, 1.0)


def test_synthetic_scene_tiles(spark):
    assert tiling.tile_grid(spark, 768, 768, 256, 0.25).count() == 16


def test_padding(spark):
    px = frame(spark, [(r, c, 1) for r in range(3) for c in range(3)], "r long, c long, v int")
    dense = tiling.padded(tiling.to_tiles(px, 3, 3, 4), tiling.tile_grid(spark, 3, 3, 4), 4, "v")
    assert dense.count() == 16 and dense.agg(F.sum("v")).first()[0] == 9


def test_nearest_resize(spark):
    px = frame(spark, [(r, c, r * 10 + c) for r in range(4) for c in range(4)], "r long, c long, v int")
    assert tiling.nearest(px, 4, 4, 2, 2).count() == 4 and tiling.nearest(px, 4, 4, 8, 8).count() == 64


def test_components_chain_and_star(spark):
    links = frame(spark, [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)], "a long, b long")
    ids = spark.range(0, 200)
    comps = dict((r["id"], r["component"]) for r in graph.components(ids, links).collect())
    assert all(comps[i] == 1 for i in range(1, 61)) and all(comps[i] == 100 for i in range(100, 160)) and comps[0] == 0


def test_components_empty(spark):
    assert got(graph.components(spark.range(2), frame(spark, [], "a long, b long")), "id", "component") == [(0, 0), (1, 1)]


def flood(mask, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    label = {}
    for start in sorted(mask):
        if start in label:
            continue
        todo = [start]
        label[start] = start
        while todo:
            r, c = todo.pop()
            for a, b in steps:
                n = (r + a, c + b)
                if n in mask and n not in label:
                    label[n] = start
                    todo.append(n)
    return label


@pytest.mark.parametrize("connectivity,block", [(8, 4), (4, 4), (8, 256)])
def test_regions_against_flood_fill(spark, connectivity, block):
    rng = random.Random(connectivity * block)
    mask = {(rng.randrange(20), rng.randrange(17)) for _ in range(150)}
    labels = regions.label_regions(frame(spark, [*mask, next(iter(mask))], "r long, c long"), 17, connectivity, block)
    want = flood(mask, connectivity)
    assert got(labels, "r", "c", "comp") == sorted((r, c, a * 17 + b) for (r, c), (a, b) in want.items())


def test_no_regions(spark):
    assert regions.label_regions(frame(spark, [], "r long, c long"), 5).count() == 0


def test_rings_cover_their_region(spark):
    rng = random.Random(5)
    mask = {(rng.randrange(12), rng.randrange(12)) for _ in range(80)}
    labels = regions.label_regions(frame(spark, list(mask), "r long, c long"), 12, 8)
    area = regions.rings(labels).withColumn("a", vector.shoelace(F.col("ring")) * F.when(F.col("outer"), 1).otherwise(-1)).groupBy("comp").agg(F.sum("a").alias("a"))
    sizes = {r["comp"]: r["n"] for r in labels.groupBy("comp").agg(F.count("*").alias("n")).collect()}
    assert {r["comp"]: r["a"] for r in area.collect()} == sizes


def test_ellipse():
    assert stencil.ellipse(3) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    assert len(stencil.ellipse(5)) == 17


def test_border_never_erodes(spark):
    full = frame(spark, [(r, c) for r in range(4) for c in range(4)], "r long, c long")
    assert stencil.erode(full, stencil.square(3), 4, 4).count() == 16


def test_geodesic_growth_stops(spark):
    seeds, limit = frame(spark, [(0, 0)], "r long, c long"), frame(spark, [(0, c) for c in range(6)], "r long, c long")
    assert stencil.geodesic_growth(seeds, limit, 3, 5, 10).count() == 4
    assert stencil.geodesic_growth(seeds, limit, 99, 5, 10).count() == 6


def test_smoothing_and_windows(spark):
    row = spark.range(1).select(
        vector.smoothed_in_place(F.array(*map(F.lit, (0.0, 4.0, 0.0, 4.0, 0.0)))), vector.moving_median(F.array(*map(F.lit, (5.0, 1.0, 9.0, 2.0))), 1),
        vector.moving_mean(F.array(*map(F.lit, (0.0, 3.0))), 1), vector.smoothed_in_place(F.array(F.lit(1.0))),
    ).first()
    assert list(row) == [[0.0, 2.0, 1.5, 2.375, 0.0], [5.0, 5.0, 2.0, 2.0], [1.0, 2.0], [1.0]]


def test_empty_polyline(spark):
    none = F.array().cast("array<struct<x:double,y:double>>")
    assert spark.range(1).select(vector.length(none)).first()[0] == 0.0


def test_interpolation_holds_ends(spark):
    df = frame(spark, [(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, None), (2, 0, None)], "line long, i long, w double")
    assert got(series.interpolated(df, "line", "i", "w", "v"), "line", "i", "v") == [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0), (1, 4, 4.0), (2, 0, None)]


def test_numbers_are_consecutive(spark):
    assert [r["i"] for r in numbering.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"]).orderBy("k").collect()] == list(range(1000))


def test_half_even_split(spark):
    df = spark.range(25)
    assert records.hash_split(df, "id", "s", 0.1, 5).where("split = 'val'").count() == 2  # round(2.5) is 2
    assert records.hash_split(df.limit(3), "id", "s", 0.5, 5).where("split = 'val'").count() == 0


def test_confusion_of_nothing(spark):
    assert records.metrics(records.confusion(frame(spark, [], "t int, p int"), [], F.col("p"), F.col("t"))).first()["iou"] is None


def test_utm_and_mercator(spark):
    row = spark.range(1).select(*geo.utm(F.lit(-96.8), F.lit(39.05), 14), *geo.web_mercator(F.lit(180.0), F.lit(0.0))).first()
    assert math.isclose(row[2], 20037508.342789, abs_tol=1e-3) and abs(row[3]) < 1e-6
    assert math.isclose(row[0], 690388.0, abs_tol=400) and math.isclose(row[1], 4324700.0, abs_tol=600)


def test_affine_round_trip(spark):
    t = (0.3, 0.0, 500000.0, 0.0, -0.3, 3500000.0)
    x, y = geo.pixel_to_world(F.lit(7.5), F.lit(3.25), t)
    col, row = geo.world_to_pixel(x, y, t)
    out = spark.range(1).select(col, row).first()
    assert math.isclose(out[0], 7.5, abs_tol=1e-6) and math.isclose(out[1], 3.25, abs_tol=1e-6)


def test_lab_of_known_colours(spark):
    white, black = (spark.range(1).select(pixels.lab(*[F.lit(v)] * 3).alias("x")).first()["x"] for v in (255, 0))
    assert tuple(white) == (255, 128, 128) and tuple(black) == (0, 128, 128)


def test_half_even_and_floor_modulo(spark):
    row = spark.range(1).select(F.bround(F.lit(2.5)), geo.counter_clockwise(F.lit(1.0), F.lit(0.5))).first()
    assert row[0] == 2.0 and math.isclose(row[1], 2 * math.pi - 0.5)


@pytest.mark.parametrize("dtype,bands", [("uint8", 1), ("uint8", 3), ("uint16", 2), ("float32", 1)])
def test_geotiff(dtype, bands):
    data = (np.random.default_rng(1).random((300, 130, bands)) * 200).astype(dtype)
    back = geotiff.decode(geotiff.encode(geotiff.Raster(data, (0.5, 0, 10, 0, -0.5, 20), 4326, 7.0), 64))
    assert (back.data == data).all() and back.transform == (0.5, 0.0, 10.0, 0.0, -0.5, 20.0) and back.epsg == 4326 and back.nodata == 7.0
    assert geotiff.first_three(data).shape[2] == 3


@pytest.mark.parametrize("bands", [1, 3, 4])
def test_png(bands):
    data = np.random.default_rng(2).integers(0, 256, (9, 7, bands), dtype=np.uint8)
    assert (png.decode(png.encode(data)) == data).all()


def test_shapefile():
    shapes = [[[(0.0, 0.0), (1.0, 2.0), (3.0, 1.0), (0.0, 0.0)]], [[(5.0, 5.0), (6.0, 6.0), (5.0, 5.0)], [(7.0, 7.0), (8.0, 8.0), (7.0, 7.0)]]]
    assert [p for _, p in shapefile.decode_shp(shapefile.encode_shp(shapes, shapefile.POLYGON))] == shapes
    rows = [{"name": "éa", "n": 3}, {"name": "b", "n": None}]
    assert shapefile.decode_dbf(shapefile.encode_dbf(rows, {"name": 10})) == rows


def test_shapefile_of_rings():
    xy = np.random.default_rng(3).uniform(-9, 9, (50, 5, 2))
    raw = shapefile.encode_rings(xy)
    assert raw == shapefile.encode_shp([[[tuple(p) for p in ring]] for ring in xy.tolist()], shapefile.POLYGON)
    assert (shapefile.decode_rings(raw) == xy).all() and len(shapefile.decode_rings(shapefile.encode_rings(xy[:0]))) == 0
    with pytest.raises(ValueError):
        shapefile.decode_rings(shapefile.encode_shp([[[(0.0, 0.0)] * 4], [[(0.0, 0.0)] * 6]], shapefile.POLYGON))


def test_shapefile_roundtrip_of_odd_rows(spark, duck, tmp_path):
    """Rows without an id, a day or a price come back as SQL has them, from as many files as there are batches."""
    from tessella.queries import ORACLES, QUERIES

    rows = [(1, "1995-01-03", 1234.57), (None, "1995-01-04", 5.0), (3, None, 7.0), (4, "1996-02-29", None)]
    df = frame(spark, rows, "o_orderkey long, o_orderdate string, o_totalprice double").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    ours = [tuple(r) for r in QUERIES["shapefile_roundtrip"](spark, str(tmp_path)).collect()]
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert sorted(ours, key=repr) == sorted(con.execute(ORACLES["shapefile_roundtrip"]).fetchall(), key=repr)
    assert QUERIES["shapefile_roundtrip"](spark, str(tmp_path)).rdd.getNumPartitions() == 1
    many = shapefile.encode_dbf([{"id": i} for i in range(200_000)], {})
    assert [r["id"] for r in shapefile.decode_dbf(many)] == list(range(200_000))


def test_files_written_and_listed(spark, tmp_path):
    data = geotiff.encode(geotiff.Raster(np.arange(12, dtype=np.uint8).reshape(3, 4, 1)), 16)
    df = frame(spark, [("a/x.tif", bytearray(data)), ("12/3/4.png", bytearray(png.encode(np.zeros((2, 2), np.uint8)))), ("note.txt", bytearray(b"x"))], "name string, content binary")
    files.write_files(df, str(tmp_path / "out"))
    images = files.list_images(spark, str(tmp_path / "out"), recursive=True)
    assert images.count() == 2
    assert got(files.tile_paths(images), "z", "x", "y") == [(12, 3, 4)]
    px = geotiff.to_pixels(geotiff.read_blocks(spark, str(tmp_path / "out/a"), rows=2))
    assert got(px, "r", "c", "v") == [(r, c, r * 4.0 + c) for r in range(3) for c in range(4)]


def test_pairs_by_stem(spark):
    images, labels = frame(spark, [("/i/a.png",), ("/i/b.png",)], "path string"), frame(spark, [("/l/a.txt",), ("/m/a.txt",)], "path string")
    assert got(files.pair_by_stem(images, labels), "stem", "label") == [("a", "/l/a.txt")]


def test_greedy_joins(spark):
    ends = frame(spark, [(1, 1, 0.0, 0.0), (2, 2, 1.0, 0.0), (3, 3, 1.5, 0.0), (4, 4, 50.0, 0.0)], "end long, line long, x double, y double")
    assert got(roads.joined_ends(ends, 2.0), "a", "b") == [(2, 3)]


def test_greedy_joins_by_tiles(spark):
    """Over tiles as over one, as in a plain loop; a pile of 20,000 ends, of 200 million pairs, costs no list of them."""
    draw = random.Random(7)
    rows = [(i, i // 3, round(draw.uniform(-70, 70), k), round(draw.uniform(-70, 70), k)) for i in range(1200) for k in [draw.choice((0, 3))]]
    close = sorted((d, e, f) for i, (e, m, x, y) in enumerate(rows) for f, n, u, v in rows[i + 1 :] for d in [math.hypot(x - u, y - v)] if m != n and d <= 3)
    used, want = set(), []
    for _, a, b in close:
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b))
    schema = "end long, line long, x double, y double"
    odd = [(5000, 5000, None, 0.0), (5001, None, 0.0, 0.0), (5002, 5002, math.inf, 0.0), (5003, 5003, math.nan, 0.0)]
    for some in (50, 50_000):
        assert got(roads.joined_ends(frame(spark, rows + odd, schema), 3.0, some), "a", "b") == sorted(want)
    pile = spark.range(20_000).select(F.col("id").alias("end"), F.floor(F.col("id") / 2).alias("line"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    joined = got(roads.joined_ends(pile, 3.0), "a", "b")
    assert len(joined) == 10_000 and joined[:3] == [(0, 2), (1, 3), (4, 6)]


def test_touching_boxes(spark):
    """Small and large, flat and empty boxes over many tiles as in a plain loop; 20,000 equal boxes cost no list of pairs."""
    draw = random.Random(9)
    rows = []
    for i in range(900):
        x, y, w, h = draw.uniform(-60, 60), draw.uniform(-60, 60), draw.choice((0.0, 1.0, 2.0, 2.5, 40.0 if i % 90 == 0 else 1.5)), draw.uniform(0, 3)
        rows.append((i, x, y, x + w, y + h))
    rows += [(900 + k, 5.0, 5.0, 5.0, 9.0) for k in range(2)] + [(i + 1000, *r) for i, *r in rows[:50]]
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x0, y0, x1, y1) in enumerate(rows):
        for b, u0, v0, u1, v1 in rows[i + 1 :]:
            if x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    want = sorted((i, top(i)) for i in root) + [(5000, 5000)]
    assert 100 < len({c for _, c in want}) < 900
    df = frame(spark, [*rows, (5000, None, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    for some in (1, 50_000):
        assert got(spatial.touching(df, some), "id", "component") == want
    pile = spark.range(20_000).select("id", *[F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 6), ("y1", 20))])
    assert spatial.touching(pile).groupBy("component").count().collect() == [(0, 20_000)]
    assert spatial.touching(pile.limit(0)).count() == 0


def _meetings(one, two):
    """How many segments of two lines (x, y) meet, in a plain loop; segments lead to no vertex without a place."""
    real = lambda v: [(*p, *q) for p, q in zip(v, v[1:]) if None not in (*p, *q)]
    n = 0
    for ax0, ay0, ax1, ay1 in real(one):
        for bx0, by0, bx1, by1 in real(two):
            cross = (ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0)
            if cross:
                t = ((bx0 - ax0) * (by1 - by0) - (by0 - ay0) * (bx1 - bx0)) / cross
                u = ((bx0 - ax0) * (ay1 - ay0) - (by0 - ay0) * (ax1 - ax0)) / cross
                n += 0 <= t <= 1 and 0 <= u <= 1
    return n


def test_crossing_counts(spark, monkeypatch):
    """Lines along x, on a lattice where most touch, upright, backward, with gaps and repeats, and equal ones, as in a plain loop."""
    draw = random.Random(4)
    shapes = []
    for i in range(90):
        m = draw.randint(0, 14)
        if i % 3 == 0:
            v = [(x, draw.uniform(0, 9)) for x in sorted(draw.uniform(0, 50) for _ in range(m))]
        elif i % 3 == 1:
            v = [(float(x), float(draw.randint(0, 3))) for x in sorted(draw.sample(range(30), m))]
        else:
            v = [(float(x), draw.uniform(0, 9)) for x in sorted(draw.choices(range(40), k=m))]
        if i % 5 == 0 and m > 4:
            v[m // 2] = draw.choice(((None, 1.0), (v[m // 2][0], None)))
        if i % 7 == 0:
            v = v[:3] + v[2:]
        shapes.append(v[::-1] if i % 11 == 0 else v)
    shapes += shapes[:20]
    rows = [(i, k, *p) for i, v in enumerate(shapes) for k, p in enumerate(v)]
    want = [(a, b, n) for b in range(len(shapes)) for a in range(b) if (n := _meetings(shapes[a], shapes[b]))]
    assert len(want) > 1500
    df = frame(spark, [*rows, (None, 0, 0.0, 0.0), (None, 1, 50.0, 9.0)], "line long, seq long, x double, y double")
    assert got(crossing.crossing_counts(df), "line_a", "line_b", "n") == sorted(want)
    of = lambda some: crossing.Lines(np.arange(len(some)), np.ones(len(some), "int64"), *(np.array([p[k] for v in some for p in v]) for k in (0, 1)), np.array([len(v) for v in some]))
    plain = [v for v in shapes if v and not any(None in p for p in v)]
    for step in (1, 7, 128):
        monkeypatch.setattr(crossing, "STEP", step)
        assert crossing._counted(of(plain[:30]), of(plain[30:]), False).tolist() == [[_meetings(a, b) for b in plain[30:]] for a in plain[:30]]
    assert crossing.crossing_counts(df.limit(0)).count() == 0


def test_crossings_of_copies(spark):
    """2,000 lines of two kinds: no list of pairs of segments, every pair of lines."""
    lines = spark.range(2000).select(F.col("id").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("seq")).withColumn("x", F.col("seq") + F.col("line") % 2 * 0.25).withColumn("y", ((F.col("seq") + F.col("line")) % 2).cast("double"))
    met = crossing.crossing_counts(lines)
    assert "Join" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, met.groupBy(((F.col("line_a") + F.col("line_b")) % 2).alias("odd"), "n").count().collect())) == [(0, 38, 999_000), (1, 20, 1_000_000)]


def test_query_of_crossings_joins_no_segments(spark):
    from __spark_entry__ import queries

    plan = queries()["segment_intersections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_clusters_by_running_centre(spark):
    pts = frame(spark, [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.4, 0.0), (3, 30.0, 0.0)], "ord long, x double, y double")
    sizes = sorted(r["n"] for r in roads.clustered(pts, 1.0).groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [1, 3]


def test_clusters_as_one_pass(spark):
    """A drifting centre takes a point that touches no cell of its members; random points, and points without a place."""

    def plain(rows, reach):
        centres = []
        for o, x, y in sorted(rows):
            for c in centres:
                if math.hypot(x - c[0], y - c[1]) <= reach:
                    c[:3] = (c[0] * c[2] + x) / (c[2] + 1), (c[1] * c[2] + y) / (c[2] + 1), c[2] + 1
                    c[3].append(o)
                    break
            else:
                centres.append([x, y, 1, [o]])
        return sorted(tuple(c[3]) for c in centres)

    def ours(rows, reach):
        found = roads.clustered(frame(spark, rows, "ord long, x double, y double"), reach).groupBy("cluster").agg(F.array_sort(F.collect_list("ord")).alias("o"))
        return sorted(tuple(r["o"]) for r in found.collect())

    drift = [(0, 1.25, 0.99), (1, 0.99, 1.75), (2, 0.99, 2.0), (3, 0.99, 2.0), (4, 2.0, 2.0)]
    assert ours(drift, 1.0) == plain(drift, 1.0) == [(0, 1, 2, 3, 4)]
    draw = random.Random(5)
    many = [(i, draw.uniform(-80, 80), draw.uniform(-80, 80)) for i in range(800)]
    assert ours(many, 6.0) == plain(many, 6.0)
    assert ours([(1, None, 1.0), (2, None, 1.0), (3, math.inf, 0.0), (4, 0.0, 0.0), (5, 0.5, 0.0)], 1.0) == [(1,), (2,), (3,), (4, 5)]


def test_walk_stops_at_wide_gaps(spark):
    like = frame(spark, [(0, c) for c in (1, 2, 3, 8, 9)], "r long, c long")
    rays = frame(spark, [(1, 0, "right", 0.0, 0.0, 1.0, 0.0)], "line long, i long, side string, x double, y double, dx double, dy double")
    assert roads.walked(rays, like, 1.0, 1.0, 10.0, 2.0).first()["reach"] == 3.0
    assert roads.walked(rays, like, 1.0, 1.0, 10.0, 6.0).first()["reach"] == 10.0


def test_footprints_of_a_square(spark):
    proba = frame(spark, [(r, c, 0.9 if 3 <= r < 13 and 4 <= c < 14 else 0.1) for r in range(20) for c in range(20)], "r long, c long, proba double")
    row = footprints.footprints(proba, 20, 20, gsd=0.5).collect()
    assert [(r["id"], r["w"], r["h"]) for r in row] == [(1, 10, 10)]
    with pytest.raises(ValueError):
        footprints.merged({})


def test_filling_takes_the_nearest(spark):
    px = frame(spark, [(0, c, 10 * c, 0, 0) for c in range(5)], "r long, c long, red int, green int, blue int")
    out = ground.filled(px, frame(spark, [(0, 1)], "r long, c long"), 2)
    assert got(out, "c", "red")[1] == (1, 0)


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert list(spark.range(1).select(vector.in_ring(F.lit(2.0), F.lit(2.0), ring), vector.in_ring(F.lit(5.0), F.lit(2.0), ring)).first()) == [True, False]
    rings = spark.range(1).select(ring.alias("ring"), F.lit(7).alias("v"))
    assert spatial.rasterized_rings(rings, 10, 10, "v").count() == 16


def test_streams_do_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    spark.range(5).write.mode("append").parquet(str(folder))
    work = lambda df, _: seen.append(df.count())
    stream = lambda: incremental.new_files(spark, str(folder), spark.range(1).schema)
    incremental.drain(stream(), work, str(tmp_path / "state"))
    spark.range(3).write.mode("append").parquet(str(folder))
    incremental.drain(stream(), work, str(tmp_path / "state"))
    assert sum(seen) == 8 and seen[-1] == 3


def test_thinning_keeps_lines_connected(spark):
    from tessella.operators.skeleton import chains, thinned

    bar = frame(spark, [(r, c) for r in range(4, 9) for c in range(2, 30)], "r long, c long")
    line = thinned(bar)
    assert 15 <= line.count() <= 40
    assert regions.label_regions(line, 40, 8).select("comp").distinct().count() == 1
    assert chains(line, 40).count() >= 10


def test_inserted_vertex(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 10, 20)])
    out = spark.range(1).select(vector.insert_point(points, F.lit(13.0), F.lit(4.0)), vector.insert_point(points, F.lit(10.2), F.lit(1.0))).first()
    assert [p["x"] for p in out[0]] == [0, 10, 13, 20] and len(out[1]) == 3


def test_missing_road_is_proposed(spark):
    evidence = frame(spark, [(r, c) for r in range(10, 17) for c in range(3, 55)], "r long, c long")
    none = frame(spark, [], "r long, c long")
    found = roads.proposed(evidence, none, 40, 60, 1.0, 20, 12).collect()
    assert len(found) == 1 and found[0]["length_m"] > 35
    assert roads.proposed(evidence, evidence, 40, 60, 1.0, 20, 12).count() == 0


def test_watershed_parts_two_discs(spark):
    discs = {(r, c) for r in range(30) for c in range(50) if (r - 14) ** 2 + (c - 14) ** 2 <= 100 or (r - 14) ** 2 + (c - 32) ** 2 <= 100}
    labels = regions.label_regions(frame(spark, list(discs), "r long, c long"), 50, 8)
    assert labels.select("comp").distinct().count() == 1
    parts = {(x["r"], x["c"]): x["part"] for x in regions.watershed(labels).collect()}
    assert parts[14, 14] != parts[14, 32] and len(set(parts.values())) == 2 and len(parts) < len(discs)


def test_grain_comes_from_the_cell(spark):
    px = frame(spark, [(r, c, float((r + c) % 2 * 10)) for r in range(8) for c in range(8)], "r long, c long, v double")
    hole = frame(spark, [(3, 3), (3, 4)], "r long, c long")
    out = {(x["r"], x["c"]): x["v"] for x in ground.grained(px, hole, 8, 1.0).collect()}
    assert out[3, 3] != 0.0 and out[0, 1] == 10.0 and len(out) == 64


def test_exception_runs(spark):
    # A gap that is weak is bridged (12, 8.5, 12), one that is not is not (12, 6, 12); a ramp is no steady width.
    widths = [6, 6, 6, 12, 12.5, 8.5, 12, 6, 6, 2, 2, 2, 6, 12, 12, 6, 12, None, 6, 9, 14, 22, 30, 6]
    df = frame(spark, [(1, i, None if w is None else float(w), 6.0, 2.0) for i, w in enumerate(widths)], "line long, i long, w double, base double, gate double")
    want = [(-1, 10, 12, 2.0), (1, 4, 7, 12.0)]
    assert got(series.exception_runs(df, "line", "i", "w", "base", "gate"), "side", "first", "last", "level") == want
    assert got(series.exception_runs(df, "line", "i", "w", "base", "gate", shrink=False), "side", "first", "last", "level") == want[1:]
    wide = frame(spark, [(1, i, w, 6.0, 2.0) for i, w in enumerate([6.0, 9.0, 9.0, 30.0, 30.0, 14.0, 60.0, 60.0, 6.0])], "line long, i long, w double, base double, gate double")
    assert series.exception_runs(wide, "line", "i", "w", "base", "gate").count() == 0  # spread 1.4826 * 21 > 0.6 * 24


def test_boxes_beside_the_raster_set_no_pixel(spark):
    boxes = frame(spark, [(9.0, 30.2, 12.0, 32.0, 1), (-5.0, -4.0, -1.0, -1.0, 1), (2.0, 3.0, 4.0, 5.0, 7)], "x0 double, y0 double, x1 double, y1 double, v long")
    assert got(spatial.rasterized(boxes, 30, 40, "v"), "r", "c", "v") == [(3, 2, 7), (3, 3, 7), (4, 2, 7), (4, 3, 7)]


def test_shadows_are_measured_against_all_pixels_in_an_ellipse(spark):
    """A bright pixel that is not known counts, one in the corner of the square does not."""
    px = frame(spark, [(r, c, *[200 if (r, c) == (0, 3) else 250 if (r, c) == (0, 6) else 50] * 3) for r in range(7) for c in range(7)], "r long, c long, red int, green int, blue int")
    known = px.where("red = 50").select("r", "c")
    out = {(x["r"], x["c"]): x["red"] for x in ground.lifted_shadows(px, known, 3, 0.55).collect()}
    assert out[0, 3] == 200 and out[3, 3] == 150 and out[6, 0] == 50  # 200 / 50 is over 3; (0, 6) is outside of the ellipse at (3, 3)


def test_lines_are_snapped_and_measured_whole(spark):
    from conftest import SMALL

    from tessella.queries import workflows

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    whole = got(events.groupBy(F.col("user_id").alias("line")).agg(F.count("*").alias("n")), "line", "n")
    assert max(n for _, n in whole) > 60
    assert got(workflows._road(spark, SMALL)[0].groupBy("line").agg(F.max("seq").alias("n")), "line", "n") == whole
    assert got(workflows.ribbon_fixed_width(spark, SMALL), "line", "n") == whole
