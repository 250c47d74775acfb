"""Well-known binary geometries to parts of vertices and back, in Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type numbers of the format.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
LINES, AREAS = ("LineString", "MultiLineString"), ("Polygon", "MultiPolygon")
VERTICES = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xs", "ys")])
DECODED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(VERTICES))])


def _shape(raw: bytes, at: int) -> tuple[str, list, int]:
    """Kind, parts and the byte after one geometry; of a polygon only the outer ring is kept."""
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    width = 2 + (code % 10_000 >= 1000)
    kind, at = KINDS[code % 1000], at + 5

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    def vertices(n: int) -> dict:
        nonlocal at
        xy = np.frombuffer(raw, order + "f8", n * width, at).reshape(n, width)
        at += 8 * n * width
        return {"xs": xy[:, 0].astype(float), "ys": xy[:, 1].astype(float)}

    if kind == "Point":
        return kind, [vertices(1)], at
    if kind == "LineString":
        return kind, [vertices(count())], at
    if kind == "Polygon":
        rings = [vertices(count()) for _ in range(count())]
        return kind, rings[:1], at
    parts: list = []
    for _ in range(count()):
        _, own, at = _shape(raw, at)
        parts += own
    return kind, parts, at


@F.pandas_udf(DECODED)
def _decode(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        try:
            kind, parts, _ = _shape(bytes(r), 0)
        except (TypeError, KeyError, IndexError, ValueError, struct.error):  # null or not this format
            kind, parts = None, None
        rows.append((kind, parts))
    return pd.DataFrame(rows, columns=["kind", "parts"])


def kind_of(raw: Column) -> Column:
    """Kind of a binary geometry by its head alone, without decoding it; null where it is null or of no known kind."""
    byte = lambda i: F.hex(F.substring(raw, i, 1))
    little = byte(1) == "01"
    code = F.conv(F.when(little, F.concat(*map(byte, (5, 4, 3, 2)))).otherwise(F.concat(*map(byte, (2, 3, 4, 5)))), 16, 10).cast("long") % 1000
    return F.when(F.length(raw) >= 5, F.element_at(F.create_map(*[F.lit(x) for k in KINDS.items() for x in k]), code.cast("int")))


def wkb_decode(raw: Column) -> Column:
    """(kind, parts) of a binary geometry; both null where it is null or unreadable. Heights are left out."""
    return _decode(raw)


def _binary(kind: str, parts: list) -> bytes:
    code = {n: c for c, n in KINDS.items()}[kind]
    own = [np.column_stack([p["xs"], p["ys"]]).astype("<f8") for p in parts]
    head = struct.pack("<BI", 1, code)
    if kind == "Point":
        return head + own[0].tobytes()
    if kind == "LineString":
        return head + struct.pack("<I", len(own[0])) + own[0].tobytes()
    if kind == "Polygon":
        return head + struct.pack("<I", len(own)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in own)
    return head + struct.pack("<I", len(parts)) + b"".join(_binary(kind.removeprefix("Multi"), [p]) for p in parts)


@F.pandas_udf(T.BinaryType())
def _encode(g: pd.DataFrame) -> pd.Series:
    return pd.Series([None if k is None or p is None else _binary(k, list(p)) for k, p in zip(g["kind"], g["parts"], strict=True)], dtype=object)


def wkb_encode(kind: Column, parts: Column) -> Column:
    """The binary form of a geometry (``parts`` as from ``wkb_decode``), little-endian, two dimensions."""
    return _encode(F.struct(kind.alias("kind"), parts.alias("parts")))


def is_route_line(geometry: Column) -> Column:
    """Whether a decoded geometry is a LineString of more than one place."""
    xs, ys = geometry["parts"][0]["xs"], geometry["parts"][0]["ys"]
    spread = (F.array_max(xs) > F.array_min(xs)) | (F.array_max(ys) > F.array_min(ys))
    return F.coalesce((geometry["kind"] == "LineString") & spread, F.lit(False))


def vertices_of(features, geometry: str = "g", keep: tuple[str, ...] = ("id",)):  # noqa: ANN001, ANN201
    """One row per vertex of every part of a decoded geometry: ``keep``, part, seq, lon, lat."""
    parts = features.select(*keep, F.posexplode(f"{geometry}.parts").alias("part", "_p"))
    zipped = F.arrays_zip(F.col("_p.xs").alias("x"), F.col("_p.ys").alias("y"))
    return parts.select(*keep, "part", F.posexplode(zipped).alias("seq", "_v")).select(*keep, "part", "seq", F.col("_v.x").alias("lon"), F.col("_v.y").alias("lat"))
