"""Well-known binary at the edges: decode on read, encode on write."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from landledger.functions.geometry import GEOMETRY_TYPE

# Geometry type codes of the format.
KINDS = {1: "POINT", 3: "POLYGON", 6: "MULTIPOLYGON"}


def _decode(raw: bytes) -> dict | None:
    """None for other kinds and for empty shapes; coordinates past the second are dropped."""

    def head(at: int) -> tuple[str, str | None, int, int]:
        order = "<" if raw[at] else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        extra = bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[(code & 0xFFFF) // 1000 % 4]
        skip = 4 if code & 0x20000000 else 0  # a coordinate system id
        return order, KINDS.get((code & 0xFFFF) % 1000), 2 + extra, at + 5 + skip

    def polygon(at: int):
        order, _, width, at = head(at)
        (count,) = struct.unpack_from(order + "I", raw, at)
        at, rings = at + 4, []
        for i in range(count):
            (n,) = struct.unpack_from(order + "I", raw, at)
            xy = np.frombuffer(raw, order + "f8", width * n, at + 4).reshape(n, width)[:, :2]
            rings.append({"hole": i > 0, "pts": [{"x": float(x), "y": float(y)} for x, y in xy]})
            at += 4 + 8 * width * n
        return rings, at

    order, kind, _, at = head(0)
    rings: list[dict] = []
    if kind == "POINT":
        x, y = struct.unpack_from(order + "2d", raw, at)
        rings = [] if np.isnan(x) else [{"hole": False, "pts": [{"x": x, "y": y}]}]
    elif kind == "POLYGON":
        rings = polygon(0)[0]
    elif kind == "MULTIPOLYGON":
        (count,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        for _ in range(count):
            part, at = polygon(at)
            rings += part
    return {"kind": kind, "rings": rings} if rings else None


def _encode(geom) -> bytes | None:
    rings = [[(p["x"], p["y"]) for p in r["pts"]] for r in geom["rings"]]
    if geom["kind"] == "POINT":
        return struct.pack("<BI2d", 1, 1, *rings[0][0])

    def polygon(part):
        body = b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in part)
        return struct.pack("<BII", 1, 3, len(part)) + body

    if geom["kind"] == "POLYGON":
        return polygon(rings)
    parts: list[list] = []
    for ring, source in zip(rings, geom["rings"]):
        if source["hole"] and parts:
            parts[-1].append(ring)
        else:
            parts.append([ring])
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


@F.pandas_udf(GEOMETRY_TYPE)
def from_wkb(raw: pd.Series) -> pd.DataFrame:
    rows = [None if v is None else _decode(bytes(v)) for v in raw]
    return pd.DataFrame({key: [None if r is None else r[key] for r in rows] for key in ("kind", "rings")})


@F.pandas_udf(BinaryType())
def _pack(kind: pd.Series, rings: pd.Series) -> pd.Series:
    return pd.Series(
        [None if k is None or r is None else _encode({"kind": k, "rings": r}) for k, r in zip(kind, rings)]
    )


def to_wkb(geom):
    return _pack(geom["kind"], geom["rings"])
