"""The binary form of cubes and of bundles of cubes.

A cube blob: magic, version, header length, JSON header, then one little-endian
buffer for each column at offsets of a multiple of eight.  Rows are sorted by
free bin and then by the target's keys, so equal cubes are equal bytes.
"""

from __future__ import annotations

import gzip
import json
import struct
from itertools import combinations
from typing import Any

import numpy as np

from ..functions.binning import day_grid
from . import cube as cubes

#: Fixed values of the format.
CUBE_MAGIC, BUNDLE_MAGIC, VERSION = b"FVCUBE", b"FVCBNDL\0", 1
DTYPES = {"u32": "<u4", "f64": "<f8", "f32": "<f4", "u16": "<u2"}
PARTIALS = {
    "count": (("count", "u32"),),
    "sum": (("sum", "f64"),),
    "mean": (("sum", "f64"), ("count", "u32")),
    "min": (("min", "f64"),),
    "max": (("max", "f64"),),
    "line_env": (("y_min", "f32"), ("y_max", "f32"), ("x_argmin", "u16"), ("x_argmax", "u16")),
}


def _stored(measure: cubes.Measure) -> list[tuple[str, str]]:
    if measure.agg != "corr":
        return list(PARTIALS[measure.agg])
    return [(cubes.corr_name(i, j, s), "u32" if s == "n" else "f64") for i, j in combinations(range(len(measure.columns)), 2) for s in cubes.CORR_STATS]


def _aligned(n: int) -> int:
    return -n % 8


def _order(values: set) -> list:
    """Numbers in numeric order, anything else as text in text order; null last."""
    known = [v for v in values if v is not None]
    return (sorted(known) if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in known) else sorted(known, key=str)) + [None] * (None in values)


def _free_header(free: cubes.FreeAxis, categories: list | None) -> dict[str, Any]:
    if free.kind == "categorical":
        return {"kind": free.kind, "cols": list(free.columns), "categories": [list(c) for c in categories]}
    if free.kind == "box2d":
        out: dict[str, Any] = {"kind": free.kind, "cols": list(free.columns), "p": free.p, "domains": [list(d) for d in free.domains]}
        if any(free.units()):
            out["units"] = list(free.units())
            grids = [day_grid(*d, free.p) if u == "day" else None for d, u in zip(free.domains, free.units())]
            out["grids"] = [None if g is None else {"w": g[0], "p_eff": g[1]} for g in grids]
        return out
    out = {"kind": free.kind, "p": free.p, "domain": list(free.domain)}
    if free.unit is not None:
        out["unit"] = free.unit
        if free.unit == "day":
            out["w"], out["p_eff"] = day_grid(*free.domain, free.p)
    return out


def encode_cube(cube: cubes.Cube, cube_id: str) -> bytes:
    """The cells are collected here; their number is bounded by the grid, not by the rows."""
    spec = cube.spec
    frame = cubes.quantised(cube.frame, spec) if spec.measure.agg == "line_env" else cube.frame
    rows = [r.asDict() for r in frame.collect()]
    categories = None
    if spec.free.kind == "categorical":
        keys = [tuple(r[c] for c in cube.free_cols) for r in rows]
        categories = sorted(set(keys))
        code = {k: i for i, k in enumerate(categories)}
        for r, k in zip(rows, keys):
            r["free_bin"] = code[k]
    coded: dict[str, list] = {}
    dims = []
    for d in spec.target_dims:
        if d.kind == "categorical":
            coded[d.key] = _order({r[d.key] for r in rows})
            numeric = all(isinstance(v, (int, float)) for v in coded[d.key])
            dims.append({"name": d.column, "kind": d.kind, "categories": coded[d.key] if numeric else [None if v is None else str(v) for v in coded[d.key]]})
            place = {v: i for i, v in enumerate(coded[d.key])}
            for r in rows:
                r[d.key] = place[r[d.key]]
        else:
            dims.append({"name": d.column, "kind": d.kind, "bins": d.bins, "domain": list(d.domain)} | ({"unit": d.unit} if d.unit is not None else {}))
    rows.sort(key=lambda r: (r["free_bin"], *(r[k] for k in cube.group_cols)))
    columns, body = [], bytearray()
    for name, kind in [("free_bin", "u32"), *((k, "u32") for k in cube.group_cols), *_stored(spec.measure)]:
        values = [np.nan if r[name] is None else r[name] for r in rows]
        if kind == "u32" and any(v >= 2**32 for v in values):
            raise ValueError(f"a cell of {name!r} does not fit 32 bits")
        raw = np.array(values, float if kind[0] == "f" else np.int64).astype(DTYPES[kind]).tobytes()
        body += b"\0" * _aligned(len(body))
        columns.append({"name": name, "dtype": kind, "offset": len(body), "byte_len": len(raw)})
        body += raw
    measure: dict[str, Any] = {"agg": spec.measure.agg, "value_col": spec.measure.value_col}
    if spec.measure.agg == "corr":
        names = list(spec.measure.columns)
        measure |= {"columns": names, "pairs": [list(p) for p in combinations(range(len(names)), 2)], "means": dict(zip(names, cube.centres))}
    header = {"v": VERSION, "cube_id": cube_id, "rows": len(rows), "sorted_by": "free_bin", "free": _free_header(spec.free, categories), "target_dims": dims, "measure": measure, "columns": columns}
    text = json.dumps(header, separators=(",", ":"), default=str).encode()
    text += b" " * _aligned(12 + len(text))
    return CUBE_MAGIC + struct.pack("<BBI", VERSION, 0, len(text)) + text + bytes(body)


def _prelude(blob: bytes, magic: bytes, form: str, what: str) -> int:
    """Length of the JSON part, after checking what comes before it."""
    size = len(magic) + struct.calcsize(form)
    if len(blob) < size:
        raise ValueError(f"{what} is cut off in its first {size} bytes")
    if blob[: len(magic)] != magic:
        raise ValueError(f"this is no {what}: it starts with {blob[: len(magic)]!r}")
    version, *_, length = struct.unpack_from(form, blob, len(magic))
    if version != VERSION:
        raise ValueError(f"{what} of unknown version {version}")
    if len(blob) < size + length:
        raise ValueError(f"{what} is cut off in its header")
    return length


def decode_header(blob: bytes) -> dict[str, Any]:
    length = _prelude(blob, CUBE_MAGIC, "<BBI", "cube")
    header = json.loads(blob[12 : 12 + length])
    for c in header["columns"]:
        if 12 + length + c["offset"] + c["byte_len"] > len(blob):
            raise ValueError(f"cube is cut off in column {c['name']!r}")
    return header


def decode_cube(blob: bytes) -> tuple[dict[str, Any], dict[str, np.ndarray], np.ndarray]:
    """Header, columns, and where each free bin's rows begin: rows of bin b are starts[b] to starts[b + 1]."""
    header = decode_header(blob)
    start = 12 + struct.unpack_from("<I", blob, 8)[0]
    data = {c["name"]: np.frombuffer(blob, DTYPES[c["dtype"]], c["byte_len"] // np.dtype(DTYPES[c["dtype"]]).itemsize, start + c["offset"]) for c in header["columns"]}
    free = header["free"]
    if free["kind"] == "categorical":
        bins = len(free["categories"])
    elif free["kind"] == "box2d":
        bins = (free["p"] + 1) ** 2
    else:
        bins = free.get("p_eff", free["p"]) + 1
    return header, data, np.searchsorted(data["free_bin"], np.arange(bins + 1))


def encode_bundle(blobs: list[bytes], trace_cubes: dict[str, int]) -> bytes:
    meta = json.dumps({"trace_cubes": trace_cubes, "lengths": [len(b) for b in blobs]}, separators=(",", ":")).encode()
    meta += b" " * _aligned(16 + len(meta))
    return BUNDLE_MAGIC + struct.pack("<BBHI", VERSION, 0, 0, len(meta)) + meta + b"".join(blobs)


def decode_bundle(bundle: bytes) -> tuple[list[bytes], dict[str, int]]:
    length = _prelude(bundle, BUNDLE_MAGIC, "<BBHI", "cube bundle")
    meta = json.loads(bundle[16 : 16 + length])
    blobs, at = [], 16 + length
    for n in meta["lengths"]:
        if at + n > len(bundle):
            raise ValueError("cube bundle is cut off in its cubes")
        blobs.append(bundle[at : at + n])
        at += n
    return blobs, meta["trace_cubes"]


def compressed(raw: bytes) -> bytes:
    """Level 1 and no time stamp: quick, and equal input gives equal bytes."""
    return gzip.compress(raw, 1, mtime=0)
