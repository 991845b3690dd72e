"""The workbook in which people check a recognised drawing against the truth."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from meshwright.plans.recognise import Network
from meshwright.sinks.documents import write_workbook

NEW_ROWS = 30
VERDICTS = ["correct", "wrong", "unsure"]


def sheets(network: Network, drawing: Any) -> dict[str, list[list[Any]]]:
    """Instructions, equipment, terminals, crossings, rows for what was missed, and nodes of one drawing."""
    own = {name: [r.asDict(recursive=True) for r in getattr(network, name).where(F.col("drawing") == F.lit(drawing)).collect()] for name in ("equipment", "terminals", "events", "nodes")}
    devices = {r["equipment"]: r for r in own["equipment"]}
    equipment = [[r["equipment"], r["physical_type"], r["source"], ",".join(r["handles"]), r["confidence"], "", ""] for r in own["equipment"]]
    terminals = [[f"{r['equipment']}.{r['rank']}", r["equipment"], devices[r["equipment"]]["physical_type"], r["px"], r["py"], r["confidence"], "", ""] for r in own["terminals"]]
    crossings = [[r["kind"], r["x"], r["y"], r["state"], ",".join(r["handles"]), "", ""] for r in own["events"]]
    nodes = [[r["root"], ",".join(r["equipment"]), r["terminals"], ",".join(r["handles"]), "", ""] for r in own["nodes"]]
    check = ["verdict", "remark"]
    return {
        "instructions": [["sheet", "what to do"], *([s, "choose a verdict for every row"] for s in ("equipment", "terminals", "crossings", "nodes")), ["missed", "one row for each device that was not found"]],
        "equipment": [["equipment", "type", "basis", "handles", "confidence", *check], *equipment],
        "terminals": [["terminal", "equipment", "type", "x", "y", "confidence", *check], *terminals],
        "crossings": [["kind", "x", "y", "state", "handles", *check], *crossings],
        "missed": [["id", "type", "x", "y", "remark"], *([f"NEW{i:03d}", "", "", "", ""] for i in range(1, NEW_ROWS + 1))],
        "nodes": [["node", "equipment", "terminals", "handles", *check], *nodes],
    }


def write_annotation(path: str | Path, network: Network, drawing: Any) -> None:
    rows = sheets(network, drawing)
    lists = {}
    for name, own in rows.items():
        if "verdict" in own[0]:
            column = chr(ord("A") + own[0].index("verdict"))
            lists[name] = {f"{column}2:{column}{max(len(own), 2)}": VERDICTS}
    write_workbook(path, rows, lists)
