"""Drawings in ASCII DXF: one row per drawn entity, with blocks expanded, and the audit of what was left out.

A file is pairs of lines, a group code and a value. Layers, blocks and the model space are read from them;
INSERTs are expanded recursively with their place, scale and turn, and entities on layer 0 inside a block take
the layer of the INSERT. What is invisible, or on a layer that is off, frozen or not plotted, is dropped with
everything below it, and counted. A file is one task's work, and a file that can't be read is a row with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from meshwright.sources.files import contents

SCHEMA = """drawing string, record string, seq long, evidence string, source_handle string, insert_path array<string>, virtual boolean,
    kind string, layer string, points array<struct<x: double, y: double>>, center struct<x: double, y: double>, radius double,
    start_angle double, end_angle double, closed boolean, text string, height double, block string, rotation double,
    scale array<double>, attributes array<string>, defaults array<string>, reason string, error string"""
COLUMNS = [c.split()[0] for c in " ".join(SCHEMA.split()).replace("struct<x: double, y: double>", "point").split(", ")]

Pairs = list[tuple[int, str]]
#: a, b, c, d, x, y of a plane affine map: (a x + b y + x0, c x + d y + y0).
Affine = tuple[float, float, float, float, float, float]
IDENTITY: Affine = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: An INSERT inside an INSERT beyond this depth is a cycle.
DEPTH = 64


def pairs_of(text: str) -> Pairs:
    lines = text.replace("\r\n", "\n").split("\n")
    out = []
    for i in range(0, len(lines) - 1, 2):
        out.append((int(lines[i].strip()), lines[i + 1].strip("\r")))
    return out


def entities_of(pairs: Pairs) -> list[Pairs]:
    """Runs of pairs that each begin with a code 0."""
    found: list[Pairs] = []
    for code, value in pairs:
        if code == 0:
            found.append([(0, value.strip())])
        elif found:
            found[-1].append((code, value))
    return found


def first(entity: Pairs, code: int, default: Any = "") -> Any:
    for k, v in entity:
        if k == code:
            return type(default)(float(v)) if isinstance(default, int) else type(default)(v) if not isinstance(default, str) else v.strip()
    return default


def sections(pairs: Pairs) -> dict[str, Pairs]:
    out: dict[str, Pairs] = {}
    name, at = None, 0
    for i, (code, value) in enumerate(pairs):
        if code == 2 and i and pairs[i - 1][0] == 0 and pairs[i - 1][1].strip() == "SECTION":
            name, at = value.strip(), i + 1
        elif code == 0 and value.strip() == "ENDSEC" and name:
            out[name] = pairs[at:i]
            name = None
    return out


def grouped(entities: list[Pairs]) -> list[tuple[Pairs, list[Pairs]]]:
    """Entities with what follows them: the ATTRIBs of an INSERT, the VERTEXes of a POLYLINE."""
    out: list[tuple[Pairs, list[Pairs]]] = []
    owner = None
    for e in entities:
        kind = e[0][1]
        if kind == "SEQEND":
            owner = None
        elif owner is not None and kind in ("ATTRIB", "VERTEX"):
            owner.append(e)
        else:
            out.append((e, []))
            owner = out[-1][1] if kind in ("INSERT", "POLYLINE") else None
    return out


def _apply(m: Affine, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[1] * y + m[4], m[2] * x + m[3] * y + m[5]


def _compose(m: Affine, n: Affine) -> Affine:
    """First n, then m."""
    x, y = _apply(m, n[4], n[5])
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], x, y)


def _side(e: Pairs) -> Affine:
    """Object to world coordinates: an extrusion along -z mirrors x."""
    return (-1.0, 0.0, 0.0, 1.0, 0.0, 0.0) if first(e, 230, 1.0) < 0 else IDENTITY


def _spline(e: Pairs, count: int = 64) -> list[tuple[float, float]]:
    """Points of a B-spline by de Boor's rule."""
    xs, ys = ([float(v) for k, v in e if k == c] for c in (10, 20))
    knots, degree = [float(v) for k, v in e if k == 40], first(e, 71, 3)
    n = len(xs)
    if n <= degree or len(knots) < n + degree + 1:
        return list(zip(xs, ys, strict=False))
    low, high, out = knots[degree], knots[n], []
    for i in range(count):
        t = low + (high - low) * i / (count - 1)
        k = max(j for j in range(degree, n) if knots[j] <= t or j == degree)
        d = [(xs[j], ys[j]) for j in range(k - degree, k + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                left = knots[j + k - degree]
                span = knots[j + 1 + k - r] - left
                a = (t - left) / span if span else 0.0
                d[j] = tuple((1 - a) * p + a * q for p, q in zip(d[j - 1], d[j], strict=True))
        out.append(d[degree])
    return out


def arc_points(x: float, y: float, radius: float, start: float, end: float, error: float) -> list[tuple[float, float]]:
    """Points along an arc from start to end in degrees, more for a smaller error, 96 at most."""
    a, b = math.radians(start), math.radians(end)
    if b <= a:
        b += 2 * math.pi
    count = min(max(8, int((b - a) * radius / max(error, 1e-6))), 96)
    return [(x + radius * math.cos(a + (b - a) * i / (count - 1)), y + radius * math.sin(a + (b - a) * i / (count - 1))) for i in range(count)]


def shape_of(e: Pairs, parts: list[Pairs], error: float) -> dict[str, Any] | None:
    """Own coordinates of an entity: points, centre and radius, angles, closed, text, height."""
    kind = e[0][1]
    at = (first(e, 10, 0.0), first(e, 20, 0.0))
    if kind == "LINE":
        return {"points": [at, (first(e, 11, 0.0), first(e, 21, 0.0))], "closed": False}
    if kind == "CIRCLE":
        return {"center": at, "radius": first(e, 40, 0.0), "closed": True}
    if kind == "ARC":
        r, s, t = first(e, 40, 0.0), first(e, 50, 0.0), first(e, 51, 360.0)
        return {"points": arc_points(*at, r, s, t, error), "center": at, "radius": r, "start_angle": s, "end_angle": t, "closed": False}
    if kind == "LWPOLYLINE":
        xs, ys = ([float(v) for k, v in e if k == c] for c in (10, 20))
        return {"points": list(zip(xs, ys, strict=False)), "closed": bool(first(e, 70, 0) & 1)}
    if kind == "POLYLINE":
        return {"points": [(first(v, 10, 0.0), first(v, 20, 0.0)) for v in parts], "closed": bool(first(e, 70, 0) & 1)}
    if kind == "ELLIPSE":
        ax, ay, ratio = first(e, 11, 1.0), first(e, 21, 0.0), first(e, 40, 1.0)
        a, b = first(e, 41, 0.0), first(e, 42, 2 * math.pi)
        turns = [a + (b - a) * i / 63 for i in range(64)]
        whole = abs(b - a - 2 * math.pi) < 1e-9
        return {"points": [(at[0] + ax * math.cos(t) - ay * ratio * math.sin(t), at[1] + ay * math.cos(t) + ax * ratio * math.sin(t)) for t in turns], "closed": whole}
    if kind == "SPLINE":
        return {"points": _spline(e), "closed": False}
    if kind in ("TEXT", "ATTRIB", "MTEXT"):
        value = "".join(v for k, v in e if k == 3) + first(e, 1, "")
        return {"points": [at], "text": value.replace("\\P", " ").strip(), "height": first(e, 40, 0.0), "closed": False}
    return None


def expand(name: str, text: str, error: float = 2.5) -> Iterator[dict[str, Any]]:
    """The rows of one drawing: entities, inserts and what was excluded."""
    parts = sections(pairs_of(text))
    layers: dict[str, str] = {}
    for e in entities_of(parts.get("TABLES", [])):
        if e[0][1] == "LAYER":
            reason = "layer_off" if first(e, 62, 7) < 0 else "layer_frozen" if first(e, 70, 0) & 1 else "layer_non_plot" if first(e, 290, 1) == 0 else ""
            layers[first(e, 2, "")] = reason
    blocks: dict[str, tuple[tuple[float, float], list[tuple[Pairs, list[Pairs]]]]] = {}
    own: list[Pairs] = []
    head: Pairs | None = None
    for e in entities_of(parts.get("BLOCKS", [])):
        if e[0][1] == "BLOCK":
            head, own = e, []
        elif e[0][1] == "ENDBLK" and head is not None:
            blocks[first(head, 2, "")] = ((first(head, 10, 0.0), first(head, 20, 0.0)), grouped(own))
            head = None
        elif head is not None:
            own.append(e)
    seq, virtual = 0, 0

    def row(**values: Any) -> dict[str, Any]:
        nonlocal seq
        seq += 1
        return dict.fromkeys(COLUMNS) | {"drawing": name, "seq": seq} | values

    def point(m: Affine, p: tuple[float, float]) -> dict[str, float]:
        x, y = _apply(m, *p)
        return {"x": x, "y": y}

    def walk(entities: list[tuple[Pairs, list[Pairs]]], m: Affine, path: tuple[str, ...], inherited: str) -> Iterator[dict[str, Any]]:
        nonlocal virtual
        for index, (e, below) in enumerate(entities):
            kind, raw = e[0][1], first(e, 8, "")
            layer = inherited if raw in ("", "0") and inherited else raw or inherited or "0"
            reason = "entity_invisible" if first(e, 60, 0) else layers.get(layer, "")
            if reason:
                yield row(record="excluded", kind=kind, layer=layer, reason=reason)
                continue
            handle = first(e, 5, "")
            if kind == "INSERT":
                block = first(e, 2, "")
                inner = (*path, f"{handle or f'NOHANDLE{index}'}:{block}")
                sx, sy, turn = first(e, 41, 1.0), first(e, 42, 1.0), math.radians(first(e, 50, 0.0))
                base, content = blocks.get(block, ((0.0, 0.0), []))
                place: Affine = (math.cos(turn) * sx, -math.sin(turn) * sy, math.sin(turn) * sx, math.cos(turn) * sy, first(e, 10, 0.0), first(e, 20, 0.0))
                texts = [t for t in (first(a, 1, "") for a in below) if t]
                defaults = [t for t in (first(a, 1, "") for a, _ in content if a[0][1] == "ATTDEF") if t]
                yield row(
                    record="insert", kind=kind, layer=layer, source_handle=handle, insert_path=list(inner), block=block, points=[point(m, (first(e, 10, 0.0), first(e, 20, 0.0)))],
                    rotation=first(e, 50, 0.0), scale=[sx, sy, first(e, 43, 1.0)], attributes=texts, defaults=defaults,
                )
                yield from walk([(a, []) for a in below], m, inner, layer)
                if len(inner) <= DEPTH:
                    yield from walk(content, _compose(_compose(_compose(m, _side(e)), place), (1.0, 0.0, 0.0, 1.0, -base[0], -base[1])), inner, layer)
                continue
            shape = shape_of(e, below, error)
            if shape is None:
                continue
            inside = bool(path) or not handle
            virtual += inside
            evidence = f"V{virtual:07d}" if inside else handle
            flat = m if kind in ("LINE", "POLYLINE", "ELLIPSE", "SPLINE", "MTEXT") else _compose(m, _side(e))
            scale = math.sqrt(abs(flat[0] * flat[3] - flat[1] * flat[2]))
            yield row(
                record="entity", kind=kind, layer=layer, evidence=evidence, source_handle=handle or evidence, insert_path=list(path), virtual=inside,
                points=[point(flat, p) for p in shape.get("points", [])], center=point(flat, shape["center"]) if "center" in shape else None,
                radius=shape["radius"] * scale if "radius" in shape else None, start_angle=shape.get("start_angle"), end_angle=shape.get("end_angle"),
                closed=shape["closed"], text=shape.get("text"), height=shape["height"] * scale if "height" in shape else None,
            )

    yield from walk(grouped(entities_of(parts.get("ENTITIES", []))), IDENTITY, (), "")


def read_drawings(spark: SparkSession, path: str, error: float = 2.5, pattern: str = "*", most: int | None = None) -> DataFrame:
    """The rows of all drawings under a path, or of the first by path; `drawing` is the file's name without its ending."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["stem"], frame["content"], strict=True):
                try:
                    rows = list(expand(name, content.decode("utf-8", "replace"), error))
                except (ValueError, IndexError, ArithmeticError) as e:
                    rows = [dict.fromkeys(COLUMNS) | {"drawing": name, "record": "error", "seq": 0, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=COLUMNS)

    return contents(spark, path, pattern, most).select("stem", "content").mapInPandas(task, SCHEMA)
