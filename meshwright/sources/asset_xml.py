"""Asset models in CIM/RDF XML: objects, references, terminals, warnings, and files that can't be read."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.sources.files import contents

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
SCHEMA = "file string, record string, seq long, object_id string, class string, name string, subtype string, properties map<string,string>, references map<string,string>, detail string"
COLUMNS = ["file", "record", "seq", "object_id", "class", "name", "subtype", "properties", "references", "detail"]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _rows(name: str, content: bytes) -> list[tuple]:
    out = []
    for seq, (_, element) in enumerate(ET.iterparse(BytesIO(content), events=("end",))):
        object_id = element.get(f"{_RDF}ID")
        if not object_id:
            continue
        properties, references = {}, {}
        for child in element:
            text = re.sub(r"\s+", " ", child.text or "").strip()
            target = (child.get(f"{_RDF}resource") or "").removeprefix("#")
            if text:
                properties[_local(child.tag)] = text
            if target:
                references[_local(child.tag)] = target
        cls = _local(element.tag)
        if cls == "Terminal" and not ("Terminal.ConductingEquipment" in references and "Terminal.ConnectivityNode" in references):
            out.append((name, "warning", seq, object_id, cls, None, None, None, None, "terminal_missing_equipment_or_node"))
        elif cls != "ConnectivityNode":
            kind = "terminal" if cls == "Terminal" else "object"
            out.append((name, kind, seq, object_id, cls, properties.get("Naming.name", ""), properties.get("PowerSystemResource.subType", ""), properties, references, None))
        element.clear()
    return out


def read_models(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """The records of all models under a path, or of the first by path. Any fault rejects its whole file, as one row of record `error`."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                try:
                    rows = _rows(name, content)
                except ET.ParseError as e:
                    rows = [(name, "error", 0, None, None, None, None, None, None, f"ParseError: {e}")]
                yield pd.DataFrame(rows, columns=COLUMNS)

    return contents(spark, path, pattern, most).select("name", "content").mapInPandas(task, SCHEMA)


#: How an object, its name, and a terminal with its equipment are written.
OBJECT = r'(?s)<cim:([A-Za-z0-9_]+)\b[^>]*\brdf:ID="([^"]+)"[^>]*>(.*?)</cim:\1>'
NAME = r"(?s)<cim:Naming\.name>(.*?)</cim:Naming\.name>"
TERMINAL = r"(?s)<cim:Terminal\b[^>]*>(.*?)</cim:Terminal>"
EQUIPMENT = r'<cim:Terminal\.ConductingEquipment\b[^>]*\brdf:resource="#([^"]+)"'


def scanned_objects(texts: DataFrame) -> DataFrame:
    """(file, object_id, class, name) of the objects in (file, text) rows, found by pattern, without reading the files as XML.

    The last of an id counts; white space in a name is one space. A file that is no XML has what can be found in it.
    """
    part = lambda k: F.regexp_extract_all("text", F.lit(OBJECT), k)
    each = texts.where("text is not null").select("file", F.posexplode(F.arrays_zip(part(1).alias("class"), part(2).alias("object_id"), part(3).alias("body"))).alias("seq", "o"))
    name = F.trim(F.regexp_replace(F.regexp_extract(F.col("o.body"), NAME, 1), r"\s+", " "))
    return each.groupBy("file", F.col("o.object_id").alias("object_id")).agg(F.max_by(F.struct(F.col("o.class").alias("class"), name.alias("name")), "seq").alias("l")).select("file", "object_id", "l.*")


def scanned_terminals(texts: DataFrame) -> DataFrame:
    """(file, object_id, n): how many terminals name each equipment, found by pattern in (file, text) rows."""
    bodies = texts.where("text is not null").select("file", F.explode(F.regexp_extract_all("text", F.lit(TERMINAL), 1)).alias("body"))
    own = bodies.select("file", F.regexp_extract("body", EQUIPMENT, 1).alias("object_id")).where("object_id <> ''")
    return own.groupBy("file", "object_id").agg(F.count("*").alias("n"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.xml", most: int | None = None) -> DataFrame:
    """(file, text) of the first files by path, for the scans by pattern; bytes that are no UTF-8 become replacement characters."""
    return contents(spark, path, pattern, most).select(F.col("stem").alias("file"), F.decode(F.col("content"), "UTF-8").alias("text"))


def objects(records: DataFrame) -> DataFrame:
    """(file, object_id, class, name, ...): the last record of an id is the object."""
    own = records.where("record = 'object'")
    last = own.groupBy("file", "object_id").agg(F.max_by(F.struct("class", "name", "subtype", "properties", "references"), "seq").alias("o"))
    return last.select("file", "object_id", "o.*")


def terminals(records: DataFrame) -> DataFrame:
    """(file, terminal_id, equipment_id, node_id, sequence)."""
    r, p = F.col("references"), F.col("properties")
    return records.where("record = 'terminal'").select(
        "file", F.col("object_id").alias("terminal_id"), r["Terminal.ConductingEquipment"].alias("equipment_id"), r["Terminal.ConnectivityNode"].alias("node_id"),
        F.coalesce(p["Terminal.sequenceNumber"], F.lit("")).alias("sequence"),
    )


def references(records: DataFrame) -> DataFrame:
    """(file, object_id, name, target) for every reference of an object."""
    return objects(records).select("file", "object_id", F.explode("references").alias("name", "target"))
