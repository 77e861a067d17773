"""Vector tiles: encode and decode (SNK10, SNK11, SRC11), GeoJSON (SNK12), point clouds (SNK13)."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.functions import geo, present

#: Field numbers of the tile format (fixed values).
LAYER, VERSION, NAME, FEATURE, KEYS, VALUES, EXTENT = 3, 15, 1, 2, 3, 4, 5
TAGS, TYPE, GEOMETRY = 2, 3, 4


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def _field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message: varints as numbers, the rest as bytes."""
    at = 0

    def read() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = read()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, read()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = read() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


def varints(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(value)
            value = shift = 0
    return out


def encode_points(layer: str, points: list[tuple[int, int, dict[str, str]]]) -> bytes:
    """A gzipped tile with one layer of points, its keys and values in dictionaries of its own."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = b""
    for x, y, tags in points:
        pairs = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(str(v), len(values))) for k, v in tags.items() if v is not None)
        shape = varint(1 << 3 | 1) + varint(zigzag(x)) + varint(zigzag(y))
        body += _field(FEATURE, _field(TAGS, pairs) + _number(TYPE, 1) + _field(GEOMETRY, shape))
    dictionary = b"".join(_field(KEYS, k.encode()) for k in keys) + b"".join(_field(VALUES, _field(1, v.encode())) for v in values)
    tile = _field(LAYER, _number(VERSION, 2) + _field(NAME, layer.encode()) + body + dictionary + _number(EXTENT, geo.EXTENT))
    return gzip.compress(tile, mtime=0)


def decode_points(blob: bytes) -> list[tuple[str, int, int, dict[str, str]]]:
    """(layer, x, y, tags) of the first point of each feature of a tile, gzipped or not."""
    data = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
    out = []
    for number, layer in fields(data):
        if number != LAYER:
            continue
        name, keys, values, features = "", [], [], []
        for n, v in fields(layer):
            if n == NAME:
                name = v.decode()
            elif n == KEYS:
                keys.append(v.decode())
            elif n == VALUES:
                ((kind, raw),) = list(fields(v))[:1]
                if kind == 1:
                    values.append(raw.decode())
                elif kind in (2, 3):
                    values.append(str(struct.unpack("<f" if kind == 2 else "<d", raw)[0]))
                else:
                    values.append(str(unzigzag(raw) if kind == 6 else bool(raw) if kind == 7 else raw))
            elif n == FEATURE:
                features.append(v)
        for f in features:
            parts = dict(fields(f))
            shape = varints(parts.get(GEOMETRY, b""))
            if len(shape) >= 3:
                tags = varints(parts.get(TAGS, b""))
                out.append((name, unzigzag(shape[1]), unzigzag(shape[2]), {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}))
    return out


def bucketed(points: DataFrame, zooms: list[int]) -> DataFrame:
    """GEO10: points (lon, lat, any) with z, x, y, px, py, tms_y for each zoom."""
    z = points.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    return z.withColumn("_t", geo.tile_of(F.col("lon"), F.col("lat"), F.col("z"))).select(*z.columns, "_t.*")


def tiles(points: DataFrame, layer: str, zooms: list[int], tags: list[str], order: str, tms: bool = True) -> DataFrame:
    """SNK10: rows (z, x, y, blob), a tile for each that has points, in the order of ``order``."""
    b = bucketed(points, zooms).select("z", "x", (F.col("tms_y") if tms else F.col("y")).alias("y"), "px", "py", order, *(c for c in tags if c != order))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = [(int(r.px), int(r.py), {t: getattr(r, t) for t in tags}) for r in pdf.itertuples()]
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "x": [pdf["x"].iloc[0]], "y": [pdf["y"].iloc[0]], "blob": [encode_points(layer, rows)]})

    return b.groupBy("z", "x", "y").applyInPandas(encode, "z int, x int, y int, blob binary")


def decoded(tile_rows: DataFrame, tms: bool = True) -> DataFrame:
    """SRC11: points (layer, lon, lat, tags) of tiles (z, x, y, blob), rounded to six places."""

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples():
                y = (1 << r.z) - 1 - r.y if tms else r.y
                for layer, px, py, tag in decode_points(bytes(r.blob)):
                    n = 2.0**r.z
                    lon = (r.x + px / geo.EXTENT) / n * 360 - 180
                    lat = float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + py / geo.EXTENT) / n)))))
                    rows.append((layer, round(lon, 6), round(lat, 6), tag))
            yield pd.DataFrame(rows, columns=["layer", "lon", "lat", "tags"])

    return tile_rows.select("z", "x", "y", "blob").mapInPandas(read, "layer string, lon double, lat double, tags map<string,string>")


def live_tile(places: DataFrame, z: int, x: int, y: int, layer: str, tags: list[str]) -> DataFrame:
    """SNK11: one tile of the places that show at its zoom, by their tier."""
    b = bucketed(places.where(present.visible(F.col("tier_minzoom"), z)), [z]).where((F.col("x") == x) & (F.col("y") == y))
    return tiles(b.select("lon", "lat", "id", *[t for t in tags if t != "id"]), layer, [z], tags, "id", tms=False)


def features(df: DataFrame, properties: list[str]) -> DataFrame:
    """SNK12: a GeoJSON feature for each point, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def collection(features_df: DataFrame) -> DataFrame:
    """SNK12: one small FeatureCollection; larger ones stay lines of features."""
    joined = F.concat_ws(",", F.array_sort(F.collect_list("feature")))
    return features_df.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("collection"))


@F.pandas_udf(T.BinaryType())
def pcd_rows(x: pd.Series, y: pd.Series, z: pd.Series, rgb: pd.Series) -> pd.Series:
    """SNK13: 16 little-endian bytes a point: three floats, and the colour's bits as one."""
    raw = np.empty(len(x), np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<u4")]))
    raw["x"], raw["y"], raw["z"], raw["rgb"] = x, y, z, rgb
    data = raw.tobytes()
    return pd.Series([data[16 * k : 16 * k + 16] for k in range(len(x))])


def pcd_header(n: int) -> str:
    """SNK13."""
    lines = ["# .PCD v0.7", "VERSION 0.7", "FIELDS x y z rgb", "SIZE 4 4 4 4", "TYPE F F F F", "COUNT 1 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA binary"]
    return "\n".join(lines) + "\n"


def voxels(points: DataFrame, size: float) -> DataFrame:
    """GEO14: one point of each voxel, the least."""
    key = [geo.cell(F.col(c), size).alias(f"v{c}") for c in "xyz"]
    rest = [c for c in points.columns if c not in "xyz"]
    return points.groupBy(*key).agg(F.min(F.struct("x", "y", "z", *rest)).alias("p")).select("p.*")


def attrs_json(row: dict[str, Column]) -> Column:
    """JS01: non-blank cells as a JSON object."""
    m = F.map_filter(F.create_map(*(x for k, c in row.items() for x in (F.lit(k), c.cast("string")))), lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    return F.to_json(m)
