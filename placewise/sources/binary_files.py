"""Readers of binary and nested geodata: shapefiles, GeoJSON, OSM PBF, vector tiles, elevation (SRC08 to SRC12, SRC15)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.operators.tiles import fields, unzigzag, varints

RING = "array<struct<x:double,y:double>>"


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """SRC09: features of FeatureCollections: their properties (a schema), geometry type, and rings of polygons (outer rings of all parts, holes after their outer ring)."""
    geometry = "struct<type:string,coordinates:string>"
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<properties:struct<{properties}>,geometry:{geometry}>>").json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("_c"))
    polygon = F.from_json("_c", "array<array<array<double>>>")
    several = F.flatten(F.from_json("_c", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry_type") == "Polygon", polygon).when(F.col("geometry_type") == "MultiPolygon", several)
    shaped = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    point = F.when(F.col("geometry_type") == "Point", F.from_json("_c", "array<double>"))
    return f.withColumn("rings", shaped).withColumn("lon", F.get(point, 0)).withColumn("lat", F.get(point, 1)).drop("_c")


def _dbf(data: bytes, encoding: str) -> list[dict[str, str]]:
    n, head, size = struct.unpack("<IHH", data[4:12])
    names, at = [], 32
    while data[at] != 0x0D:
        names.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        row, p = {}, head + k * size + 1
        for name, width in names:
            row[name] = data[p : p + width].decode(encoding, "replace").strip()
            p += width
        out.append(row)
    return out


def _shapes(data: bytes) -> list[list[list[tuple[float, float]]]]:
    out, at = [], 100
    while at < len(data):
        size = 2 * struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<I", body[:4])[0]
        if kind in (1, 11, 21):
            out.append([[struct.unpack("<2d", body[4:20])]])
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<2I", body[36:44])
            starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            out.append([[tuple(p) for p in xy[a:b].tolist()] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        else:
            out.append([])
        at += 8 + size
    return out


def shapefile(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    """SRC08: rows (file, row, attributes map, rings) of shapefiles: each ``.shp`` with the ``.dbf`` beside it; coordinates as stored (see ``geo.tm_inverse``).

    A pair of files is one task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    pairs = files.where(kind.isin("shp", "dbf")).groupBy(stem.alias("stem")).agg(F.max(F.when(kind == "shp", F.col("content"))).alias("shp"), F.max(F.when(kind == "dbf", F.col("content"))).alias("dbf"))

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples():
                rows = _dbf(bytes(r.dbf), encoding)
                shapes = _shapes(bytes(r.shp))
                yield pd.DataFrame({
                    "file": [r.stem] * len(shapes), "row": range(len(shapes)), "attributes": rows[: len(shapes)],
                    "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in s] for s in shapes],
                })

    return pairs.where("shp IS NOT NULL AND dbf IS NOT NULL").mapInPandas(read, f"file string, row long, attributes map<string,string>, rings array<{RING}>")


def _blobs(data: bytes) -> Iterator[bytes]:
    at = 0
    while at + 4 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        head = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        blob = dict(fields(data[at : at + head[3]]))
        at += head[3]
        if head[1] == b"OSMData":
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])


def _deltas(data: bytes) -> np.ndarray:
    return np.cumsum([unzigzag(v) for v in varints(data)])


def _block(data: bytes) -> Iterator[tuple]:
    """(type, id, lon, lat, tags, refs) of a primitive block."""
    parts = list(fields(data))
    strings = [v.decode("utf-8", "replace") for n, v in fields(dict(parts)[1]) if n == 1]
    scale = {n: v for n, v in parts if n in (17, 19, 20)}
    step, lat0, lon0 = scale.get(17, 100), scale.get(19, 0), scale.get(20, 0)

    def place(lon: int, lat: int) -> tuple[float, float]:
        return 1e-9 * (lon0 + step * int(lon)), 1e-9 * (lat0 + step * int(lat))

    for number, group in parts:
        if number != 2:
            continue
        for n, v in fields(group):
            if n == 1:
                node = dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(varints(node.get(2, b"")), varints(node.get(3, b"")), strict=True)}
                yield "node", unzigzag(node[1]), *place(unzigzag(node[9]), unzigzag(node[8])), tags, []
            elif n == 2:
                dense = dict(fields(v))
                ids, lats, lons = _deltas(dense[1]), _deltas(dense[8]), _deltas(dense[9])
                codes = iter(varints(dense.get(10, b"")))
                for i, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True):
                    tags = {}
                    for a in codes:
                        if a == 0:
                            break
                        tags[strings[a]] = strings[next(codes)]
                    yield "node", i, *place(lon, lat), tags, []
            elif n in (3, 4):
                e = dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(varints(e.get(2, b"")), varints(e.get(3, b"")), strict=True)}
                yield "way" if n == 3 else "relation", e[1], None, None, tags, _deltas(e.get(8 if n == 3 else 9, b"")).tolist()


def osm_pbf(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: rows (type, id, lon, lat, tags, refs) of OSM PBF files: nodes, ways with their nodes, relations with their members."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def split(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for c in pdf["content"]:
                for blob in _blobs(bytes(c)):
                    yield pd.DataFrame({"blob": [blob]})

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for b in pdf["blob"]:
                yield pd.DataFrame(list(_block(bytes(b))), columns=["type", "id", "lon", "lat", "tags", "refs"])

    # a file's blocks are dealt out and decoded in parallel
    blobs = files.mapInPandas(split, "blob binary").repartition(F.xxhash64("blob"))
    return blobs.mapInPandas(read, "type string, id long, lon double, lat double, tags map<string,string>, refs array<long>")


def way_centres(osm: DataFrame) -> DataFrame:
    """SRC10, AGG23: ways (id, tags, lon, lat) at the mean of their nodes, a closing one left out."""
    ways = osm.where("type = 'way' AND size(refs) > 0")
    open_refs = F.when((F.size("refs") > 1) & (F.get("refs", 0) == F.element_at("refs", -1)), F.slice("refs", 1, F.greatest(F.size("refs") - 1, F.lit(1)))).otherwise(F.col("refs"))
    each = ways.select("id", F.explode(open_refs).alias("ref"))
    nodes = osm.where("type = 'node'").select(F.col("id").alias("ref"), "lon", "lat")
    centres = each.join(nodes, "ref").groupBy("id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return ways.select("id", "tags").join(centres, "id")


def elevation(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: rows (lat0, lon0, row, col, metres) of SRTM HGT files, named by their south-west corner; missing heights are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples():
                name = r.path.rsplit("/", 1)[-1].upper()
                lat = int(name[1:3]) * (1 if name[0] == "N" else -1)
                lon = int(name[4:7]) * (1 if name[3] == "E" else -1)
                z = np.frombuffer(bytes(r.content), ">i2")
                n = int(np.sqrt(len(z)))
                for k in range(0, n, 256):
                    part = z[k * n : (k + 256) * n].astype(int)
                    at = np.flatnonzero(part != -32768)
                    yield pd.DataFrame({"lat0": lat, "lon0": lon, "row": k + at // n, "col": at % n, "metres": part[at]})

    return files.mapInPandas(read, "lat0 int, lon0 int, row int, col int, metres int")


def terrain_rgb(metres: Column) -> Column:
    """SRC15: struct(r, g, b) of the Terrain-RGB code of a height."""
    v = F.round((metres + 10000) / 0.1).cast("long")
    return F.struct(F.shiftright(v, 16).bitwiseAND(255).cast("int").alias("r"), F.shiftright(v, 8).bitwiseAND(255).cast("int").alias("g"), v.bitwiseAND(255).cast("int").alias("b"))


def xml_items(pages: DataFrame, column: str, aliases: dict[str, list[str]]) -> DataFrame:
    """SRC12: the items of paged XML replies (one reply a row): for each field the first of its aliases that an item has."""
    names = sorted({a for group in aliases.values() for a in group})
    schema = f"body struct<items:struct<item:array<struct<{','.join(f'{n}:string' for n in names)}>>>>"
    items = pages.select(F.explode(F.from_xml(F.col(column), schema)["body"]["items"]["item"]).alias("i"))
    return items.select(*(F.coalesce(*(F.nullif(F.trim(F.col(f"i.{a}")), F.lit("")) for a in group)).alias(name) for name, group in aliases.items()))
