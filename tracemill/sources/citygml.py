"""CityGML LoD2 buildings as triangles."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.grouped import triangulate_ring


def local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse(content: bytes) -> list[tuple[int, np.ndarray, tuple[float, float, float]]]:
    """(number, triangles, (mean x, mean y, min z)) of each building: outer rings of three dimensions only.

    A building part belongs to the building around it; rings inside ``interior``
    are holes and are left out.
    """
    out, depth, hole, rings = [], 0, 0, []
    for event, e in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        name = local_name(e.tag)
        if event == "start":
            depth += name == "Building"
            hole += name == "interior"
            continue
        if name == "interior":
            hole -= 1
        elif name == "posList" and depth and not hole and e.text:
            values = np.array(e.text.split(), float)
            if len(values) >= 12 and len(values) % 3 == 0:
                ring = values.reshape(-1, 3)
                if np.allclose(ring[0], ring[-1]):
                    rings.append(ring)
        elif name == "Building":
            depth -= 1
            if not depth:
                parts = [t for t in map(triangulate_ring, rings) if len(t)]
                if parts:
                    points = np.concatenate(rings)
                    out.append((len(out), np.concatenate(parts), (*points[:, :2].mean(axis=0), points[:, 2].min())))
                rings = []
                e.clear()
    return out


def is_citygml(head: Column) -> Column:
    """Whether a file's first bytes look like CityGML rather than an error page."""
    text = F.lower(F.decode(F.substring(head, 1, 4096), "ISO-8859-1"))
    return text.contains("citymodel") | (text.contains("<?xml") & ~text.contains("<html"))


def buildings(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """tile, building, triangle, ax..cz, ground_x, ground_y, ground_z from GML files or zips of them.

    ``files`` has a path and the content; files that are no XML give no rows.
    """
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    schema = f"tile string, building int, triangle int, {', '.join(f'{n} double' for n in names)}, ground_x double, ground_y double, ground_z double"

    def documents(data: bytes):
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from (z.read(n) for n in sorted(z.namelist()) if n.lower().endswith((".gml", ".xml")))
        else:
            yield data

    def read(batches):
        for batch in batches:
            for tile, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for document in documents(data or b""):
                    try:
                        found = parse(document)
                    except ET.ParseError:
                        continue
                    for number, triangles, ground in found:
                        flat = triangles.reshape(-1, 9)
                        n = len(flat)
                        columns = [pa.array([tile] * n), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), *[pa.array(flat[:, i]) for i in range(9)], *[pa.array([float(g)] * n) for g in ground]]
                        yield pa.RecordBatch.from_arrays(columns, names=["tile", "building", "triangle", *names, "ground_x", "ground_y", "ground_z"])

    return files.select(path, content).mapInArrow(read, schema)
