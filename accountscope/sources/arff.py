"""Attribute-typed text tables: a declaring header, then comma-separated rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"""^\s*@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)
_NUMERIC = {"numeric", "real", "integer"}
#: Lines at the top of a file that may belong to its header.
MAX_HEADER_LINES = 20_000


def read_header(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(name, SQL type)`` per declared attribute; reads only the first lines."""
    size = 64
    while True:
        lines = [row[0] for row in spark.read.text(path).take(size)]
        end = next((i for i, line in enumerate(lines) if line.strip().lower().startswith("@data")), None)
        if end is not None:
            break
        if len(lines) < size or size >= MAX_HEADER_LINES:
            raise ValueError(f"{path}: no @data line")
        size *= 4
    found = []
    for line in lines[:end]:
        declared = _ATTRIBUTE.match(line)
        if declared:
            name, kind = declared.groups()
            found.append((name.strip("'\""), "DOUBLE" if kind.lower() in _NUMERIC else "STRING"))
    return found


def read_arff(
    spark: SparkSession, path: str, text_columns: tuple[str, ...] = ("UserID",), position: str | None = None
) -> DataFrame:
    """Declared columns as DOUBLE or STRING; ``?`` is NULL and ``%`` lines are comments.

    ``text_columns`` stay text even when declared numeric, so that long ids keep
    every digit until they are cast to BIGINT. ``position`` names a column that
    orders the rows as they stand in the files.
    """
    header = read_header(spark, path)
    line = F.trim("value")
    rows = spark.read.text(path).where(
        (line != "") & ~line.startswith("%") & ~F.rlike(F.lower(line), F.lit(r"^@(relation|attribute|data)\b"))
    )
    ddl = ", ".join(f"`c{i}` STRING" for i in range(len(header)))
    options = {"quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    parsed = rows.select(F.from_csv(line, F.lit(ddl), options).alias("r"), *([place.alias(position)] if position else []))
    columns = []
    for i, (name, kind) in enumerate(header):
        value = F.col(f"r.c{i}")
        columns.append((value.try_cast("double") if kind == "DOUBLE" and name not in text_columns else value).alias(name))
    return parsed.select(*columns, *([position] if position else []))
