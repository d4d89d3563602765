"""Small constant tables, and unions of many frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, bool) or isinstance(value, (int, float)):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """``VALUES`` table with the given DDL schema, for a few hundred constant rows: a relation of known size."""
    struct = T.StructType.fromDDL(schema)
    names = [f"`{f.name}`" for f in struct.fields]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    if not body:
        return spark.createDataFrame([], struct)
    casts = ", ".join(f"CAST({n} AS {f.dataType.simpleString()}) AS {n}" for n, f in zip(names, struct.fields))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name as a balanced tree, so that analysis does not walk a growing chain once per frame."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + (frames[-1:] if len(frames) % 2 else [])
    return frames[0]
