"""Symbol drawings in SVG: symbol definitions with normalised geometry, and the objects that use them.

A drawing is read as a stream of tags. What stands in a symbol makes its definition; outside of symbols a use
waits for the metadata that names its object.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.sources.files import contents

#: Names of tags and attributes, keys of the geometry, its decimals, and how far metadata may follow a use.
SYMBOL, USE, METADATA, REFERENCE = "symbol", "use", "metadata", "cge:PSR_Ref"
LINK, OBJECT, TERMINAL = "xlink:href", "ObjectID", "terminal-index"
DIGITS, REACH = 8, 1200
#: For each shape its entries: key, what its attributes are (a place, an extent, a length, places, a text), their names.
SHAPES: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "line": [("start", "place", ("x1", "y1")), ("end", "place", ("x2", "y2"))],
    "circle": [("center", "place", ("cx", "cy")), ("radius", "length", ("r",))],
    "polygon": [("points", "places", ("points",))],
    "polyline": [("points", "places", ("points",))],
    "rect": [("origin", "place", ("x", "y")), ("size", "extent", ("width", "height"))],
    "ellipse": [("center", "place", ("cx", "cy")), ("radius", "extent", ("rx", "ry"))],
    "path": [("d", "text", ("d",))],
}

SCHEMA = "file string, record string, seq long, symbol_id string, object_id string, signature string, terminal_count int, primitive_counts map<string,int>, geometry string, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<rest>(?:[^<>"]|"[^"]*")*)>""")
_PAIR = re.compile(r'([\w:.-]+)\s*=\s*"([^"]*)"')
_GAP = re.compile(r"[\s,]+")


class Tag(NamedTuple):
    name: str
    ends: bool
    attributes: dict[str, str]
    begin: int
    end: int


def tags(text: str) -> Iterator[Tag]:
    for m in _TAG.finditer(text):
        yield Tag(m["name"], bool(m["end"]), dict(_PAIR.findall(m["rest"])), m.start(), m.end())


def value_of(text: str | None) -> float:
    """A number, or 0 for what is none."""
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def values_of(text: str) -> list[float]:
    return [value_of(v) for v in _GAP.split(text) if v]


def measures(view_box: str) -> dict[str, Callable[[list[str]], Any]]:
    """How a symbol's attributes become values in the unit square of its view box, by kind.

    A view box that isn't four numbers is the unit square, and a side of 0 counts as 1.
    """
    given = values_of(view_box)
    corner, sides = (given[:2], [s or 1.0 for s in given[2:]]) if len(given) == 4 else ([0.0, 0.0], [1.0, 1.0])

    def place(pair: list[float]) -> list[float]:
        return [round((v - c) / s, DIGITS) for v, c, s in zip(pair, corner, sides, strict=True)]

    def places(flat: list[float]) -> list[list[float]]:
        return [place(list(pair)) for pair in zip(flat[::2], flat[1::2], strict=False)]

    return {
        "place": lambda own: place([value_of(v) for v in own]),
        "extent": lambda own: [round(value_of(v) / s, DIGITS) for v, s in zip(own, sides, strict=True)],
        "length": lambda own: round(value_of(own[0]) / max(sides), DIGITS),
        "places": lambda own: places(values_of(own[0])),
        "text": lambda own: " ".join(own[0].split()),
        "box": lambda own: [round(v, DIGITS) for v in (*corner, *sides)],
    }


def definition(view_box: str, body: list[Tag]) -> tuple[dict[str, Any], dict[str, int]]:
    """Geometry in the unit square, in an order of its own, and the counts of its shapes."""
    measure = measures(view_box)
    shapes, ports = [], []
    for tag in body:
        own = lambda names, a=tag.attributes: [a.get(n, "") for n in names]
        if tag.name in SHAPES:
            shapes.append({"type": tag.name} | {key: measure[kind](own(names)) for key, kind, names in SHAPES[tag.name]})
        elif tag.name == USE and TERMINAL in tag.attributes:
            ports.append({"index": int(value_of(tag.attributes[TERMINAL])), "point": measure["place"](own(("x", "y")))})
    text = {id(s): json.dumps(s, ensure_ascii=False, sort_keys=True) for s in shapes}
    ordered = sorted(shapes, key=lambda s: text[id(s)])
    geometry = {"view_box": measure["box"]([]), "terminals": sorted(ports, key=lambda p: p["index"]), "primitives": ordered}
    return geometry, dict(sorted(Counter(s["type"] for s in shapes).items()))


def encoded(geometry: dict[str, Any]) -> str:
    """The text whose digest is the geometry's signature."""
    return json.dumps(geometry, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def records(text: str) -> Iterator[dict[str, Any]]:
    """Definitions in order, then uses in order, as columns of SCHEMA without file and number."""
    uses: list[dict[str, Any]] = []
    symbol: dict[str, str] | None = None
    body: list[Tag] = []
    waiting: tuple[str, int] | None = None  # the symbol of the last use, and where its tag ends
    found = False  # whether its metadata has begun
    for tag in tags(text):
        if symbol is not None:
            if tag.name == SYMBOL and tag.ends:
                if symbol.get("id"):
                    geometry, counts = definition(symbol.get("viewBox", ""), body)
                    shown = encoded(geometry)
                    yield {
                        "record": "definition", "symbol_id": symbol["id"], "signature": hashlib.sha256(shown.encode()).hexdigest(),
                        "terminal_count": len(geometry["terminals"]), "primitive_counts": counts, "geometry": shown,
                    }
                symbol = None
            elif not tag.ends:
                body.append(tag)
        elif tag.name == SYMBOL and not tag.ends:
            symbol, body, waiting = tag.attributes, [], None
        elif tag.name == USE and not tag.ends:
            link = tag.attributes.get(LINK, "")
            waiting, found = ((link[1:], tag.end) if link.startswith("#") and len(link) > 1 else None), False
        elif waiting and tag.name == METADATA:
            found = not tag.ends and tag.begin - waiting[1] <= REACH
            waiting = waiting if found else None
        elif waiting and found and tag.name == REFERENCE and tag.attributes.get(OBJECT):
            uses.append({"record": "use", "symbol_id": waiting[0], "object_id": tag.attributes[OBJECT]})
            waiting = None
    yield from uses


def read_symbols(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """Definitions and uses of all symbol drawings under a path; `file` is the name without its ending.

    A file that can't be read gives one row of record `error`.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["stem"], frame["content"], strict=True):
                try:
                    rows = list(records(content.decode("utf-8-sig")))
                except ValueError as e:
                    rows = [{"record": "error", "error": f"{type(e).__name__}: {e}"}]
                whole = ({"file": name, "seq": k} | r for k, r in enumerate(rows))
                yield pd.DataFrame([[r.get(c) for c in COLUMNS] for r in whole], columns=COLUMNS)

    return contents(spark, path, pattern, most).select("stem", "content").mapInPandas(task, SCHEMA)


def signature(geometry: DataFrame) -> DataFrame:
    """`geometry` (geometry: text of the canonical form, ...) with signature."""
    return geometry.withColumn("signature", F.sha2(F.col("geometry").cast("binary"), 256))
