"""Readers and writers around Spark's own sources: image lists, tile sets, manifests, GeoJSON, label files, binary sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings of images.
IMAGES = ("tif", "tiff", "png", "jpg", "jpeg", "webp")


def list_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of image files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "modificationTime").where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))


def tile_paths(files: DataFrame, zoom: int | None = None) -> DataFrame:
    """Adds z, x and y of .../z/x/y.png paths; other files go."""
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.png$", k)
    found = files.where(part(3) != "").withColumns({"z": part(1).cast("int"), "x": part(2).cast("long"), "y": part(3).cast("long")})
    return found if zoom is None else found.where(F.col("z") == zoom)


def tile_map(xml: Column, parent: str = "") -> Column:
    """A tile map's manifest as a struct; title, reference system, tile size and ending have defaults, the box must be there."""
    text = lambda path, default: F.coalesce(F.nullif(F.xpath_string(xml, F.lit(path)), F.lit("")), F.lit(default))
    number = lambda path: F.xpath_double(xml, F.lit(path))
    return F.struct(
        text("/TileMap/Title", parent).alias("title"), text("/TileMap/SRS", "EPSG:4326").alias("srs"),
        *[number(f"/TileMap/BoundingBox/@{a}").alias(a) for a in ("minx", "miny", "maxx", "maxy")],
        number("/TileMap/Origin/@x").alias("x"), number("/TileMap/Origin/@y").alias("y"),
        text("/TileMap/TileFormat/@width", "256").cast("int").alias("tile_width"), text("/TileMap/TileFormat/@height", "256").cast("int").alias("tile_height"),
        text("/TileMap/TileFormat/@extension", "png").alias("extension"),
    )


def tile_map_xml(title: Column, west: Column, south: Column, east: Column, north: Column, zooms: int) -> Column:
    """The manifest of a pyramid from zoom 0 on."""
    sets = "".join(f'<TileSet href="{z}" units-per-pixel="{180 / 256 / 2**z:.10f}" order="{z}"/>' for z in range(zooms))
    form = '<TileMap version="1.0.0"><Title>%s</Title><SRS>EPSG:4326</SRS><BoundingBox minx="%.7f" miny="%.7f" maxx="%.7f" maxy="%.7f"/><Origin x="-180.0" y="-90.0"/><TileFormat width="256" height="256" mime-type="image/png" extension="png"/><TileSets profile="global-geodetic">'
    return F.concat(F.format_string(form, title, west, south, east, north), F.lit(sets + "</TileSets></TileMap>"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(type, coordinates as JSON, properties as JSON) of every feature of the collections under a path."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties")


def feature_json(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def yolo_boxes(lines: DataFrame, width: int, height: int, text: str = "value") -> DataFrame:
    """(cls, x0, y0, x1, y1): pixel boxes of outlines in label lines (class, then relative x and y); lines of fewer than three points go."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    numbers = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda v: v.try_cast("double"))
    pick = lambda odd: F.filter(numbers, lambda v, i: i % 2 == odd)
    own = lines.where(F.size(parts) >= 7).select(parts[0].try_cast("int").alias("cls"), pick(0).alias("xs"), pick(1).alias("ys"))
    low = lambda c, n: F.floor(F.array_min(c) * n)
    high = lambda c, n: F.ceil(F.array_max(c) * n)
    return own.select("cls", low("xs", width).alias("x0"), low("ys", height).alias("y0"), high("xs", width).alias("x1"), high("ys", height).alias("y1"))


def pair_by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, image, label): files of equal stems; an image without a label goes, of several labels the first stays."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    first = labels.select(stem.alias("stem"), "path").groupBy("stem").agg(F.min("path").alias("label"))
    return images.select(stem.alias("stem"), F.col("path").alias("image")).join(first, "stem")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as files below a folder, each under a name of the attempt first and then moved.

    The folder may be in any store that Arrow knows; every executor must see it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{root}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py())
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    files.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
