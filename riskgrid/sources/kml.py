"""KML sources: SC1 geometry rows, SC2 feature inventory, SC9 state boundaries.

Files are read with Spark's XML reader, one row for each Placemark however deep its folders are nested, so a large file is
split over tasks; geometry elements stay raw XML and become WKT in Arrow batches.  The inventory, which needs the nesting,
takes whole documents (a text column, or files) and walks each as a stream of elements.

WKT keeps the numbers as they are written.  A MultiGeometry of one kind becomes that MULTI kind, of several kinds a
GEOMETRYCOLLECTION, nested ones included; nothing is left out.  Defined results: a feature without geometry has null WKT; a
geometry that can't be read, or a document that isn't XML, says so in ``error``.
"""

from __future__ import annotations

import io
import re
import warnings
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: KML's containers and geometry elements, with the WKT kind of the latter and of several of them.
CONTAINERS = ("Document", "Folder")
KINDS = {"Point": ("POINT", "MULTIPOINT"), "LineString": ("LINESTRING", "MULTILINESTRING"), "LinearRing": ("LINEARRING", "GEOMETRYCOLLECTION"),
         "Polygon": ("POLYGON", "MULTIPOLYGON")}
TYPE_NAMES = {"POINT": "Point", "LINESTRING": "LineString", "LINEARRING": "LinearRing", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint",
              "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon", "GEOMETRYCOLLECTION": "GeometryCollection"}
GEOMETRIES = (*KINDS, "MultiGeometry")
_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\Z")

INVENTORY = "seq int, depth int, feature_type string, name string, description string, geometry_type string, wkt string, error string"


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _line(element) -> tuple[str, bool]:
    """'lon,lat[,z] ..' as '(lon lat[ z], ..)', and whether it has z."""
    text = next((c.text for c in element if _tag(c) == "coordinates"), None) or ""
    points = [p.split(",") for p in text.split()]
    if not points or any(len(p) not in (2, 3) or not all(map(_NUMBER.match, p)) for p in points):
        raise ValueError("coordinates")
    z = any(len(p) == 3 for p in points)
    return "(" + ", ".join(" ".join(p if len(p) == 3 or not z else [*p, "0"]) for p in points) + ")", z


def _body(element) -> tuple[str, str, bool]:
    """WKT kind, text after the kind, and whether it has z."""
    tag = _tag(element)
    if tag == "MultiGeometry":
        members = [_body(c) for c in element if _tag(c) in GEOMETRIES]
        if not members:
            raise ValueError("empty MultiGeometry")
        z = any(m[2] for m in members)
        kinds = {m[0] for m in members}
        many = dict(KINDS.values()).get(kinds.pop()) if len(kinds) == 1 else None
        if many in (None, "GEOMETRYCOLLECTION"):
            return "GEOMETRYCOLLECTION", "(" + ", ".join(_text(*m) for m in members) + ")", z
        return many, "(" + ", ".join(m[1] for m in members) + ")", z
    if tag == "Polygon":
        rings = [_line(r) for side in ("outerBoundaryIs", "innerBoundaryIs") for b in element if _tag(b) == side
                 for r in b if _tag(r) == "LinearRing"]
        if not rings:
            raise ValueError("no ring")
        return "POLYGON", "(" + ", ".join(r[0] for r in rings) + ")", any(r[1] for r in rings)
    text, z = _line(element)
    return KINDS[tag][0], text, z


def _text(kind: str, body: str, z: bool) -> str:
    return f"{kind}{' Z' if z else ''} {body}"


def _wkt(element) -> tuple[str | None, str | None, str | None]:
    """Geometry type, WKT and error of a geometry element."""
    try:
        kind, body, z = _body(element)
        return TYPE_NAMES[kind], _text(kind, body, z), None
    except ValueError as e:
        return None, None, f"geometry: {e}"


def walk(text: str) -> Iterator[list]:
    """``INVENTORY`` rows of a document, in the order in which features begin; elements are dropped once read."""
    rows: list[list] = []
    features: list[list] = []                              # open features, outermost first
    path: list[str] = []
    try:
        for event, element in ElementTree.iterparse(io.BytesIO(text.encode()), ("start", "end")):
            tag = _tag(element)
            if event == "start":
                if tag in CONTAINERS or tag == "Placemark":
                    features.append([len(rows), len(features), tag, None, None, None, None, None])
                    rows.append(features[-1])
                path.append(tag)
                continue
            path.pop()
            owner = path[-1] if path else ""
            if features and owner in (*CONTAINERS, "Placemark"):
                if tag in ("name", "description"):
                    features[-1][3 if tag == "name" else 4] = element.text
                elif tag in GEOMETRIES and owner == "Placemark":
                    features[-1][5:8] = _wkt(element)
            if tag in CONTAINERS or tag == "Placemark":
                features.pop()
                element.clear()
    except ElementTree.ParseError as e:
        rows.append([len(rows), 0, None, None, None, None, None, f"not XML: {e}"])
    return rows


def inventory(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """SC2: the ``carry`` columns and an ``INVENTORY`` row for each feature of each document in ``text_col`` (null: none), containers
    included, in document order (``seq``) with their nesting ``depth``."""
    made = T.StructType.fromDDL(INVENTORY)
    schema = T.StructType([docs.schema[c] for c in carry] + made.fields)
    kinds = [pa.int32(), pa.int32()] + [pa.string()] * 6

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("__kml")):
                rows = walk(text.as_py()) if text.is_valid else []
                if rows:
                    take = pa.array([i] * len(rows))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in carry), *(
                        pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], schema.names)

    return docs.select(*carry, F.col(text_col).alias("__kml")).mapInArrow(run, schema)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """SC2 over files: ``path`` of the file and its ``INVENTORY``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return inventory(files, "value", ["path"])


def features(inventoried: DataFrame) -> DataFrame:
    """SC1 over an inventory: the features that have a geometry, of any type."""
    return inventoried.where(F.col("wkt").isNotNull())


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """SC1 over files: ``name, description, geometry_type, wkt`` of every Placemark with a readable geometry."""
    raw = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "description", *GEOMETRIES)])
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(raw).load(path)
    schema = T.StructType.fromDDL("name string, description string, geometry_type string, wkt string")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tag = next((t for t in GEOMETRIES if r[t] is not None), None)
                kind, text, _ = _wkt(ElementTree.fromstring(f"<{tag}>{r[tag]}</{tag}>")) if tag else (None, None, None)
                if text is not None:
                    rows.append((r["name"], r["description"], kind, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], schema.names)

    return marks.mapInArrow(run, schema)


STATES = "uf string, state string, region string, wkt string"


def states(placemarks: DataFrame) -> DataFrame:
    """SC9: features with name = UF code and description = 'STATE / REGION' as ``STATES``."""
    parts = F.split(F.col("description"), r"\s*/\s*")
    return placemarks.select(F.col("name").alias("uf"), F.get(parts, F.lit(0)).alias("state"), F.get(parts, F.lit(1)).alias("region"), "wkt")


def read_states(spark: SparkSession, path: str | None) -> DataFrame:
    """SC9 over files.  A missing file gives a warning and an empty layer with the same schema; other faults are raised."""
    try:
        if path:
            return states(read_kml(spark, path))
        warnings.warn("no file of state boundaries: the layer is empty", stacklevel=2)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"state boundaries: {path} is missing, the layer is empty", stacklevel=2)
    return spark.createDataFrame([], STATES)
