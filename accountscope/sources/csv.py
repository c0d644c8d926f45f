"""CSV with a header: surplus fields drop a row, missing fields read NULL, doubled quotes escape.

A quote opens a field only as its first character; anywhere else it is an ordinary character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountscope.session import broadcast_if_small

# A last field added to every record: where it ends up tells how many fields came before it.
_END = "\u0001"


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


# A field as it is written: quoted (doubled quotes inside; what follows the closing quote is literal) or bare, where
# quotes are ordinary characters. All repetitions are possessive: one step per field, no matter how long the line.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPENS = rf'^{_FIELDS}"{_INSIDE}\z'
_STAYS_OPEN = rf'^{_INSIDE}(?:\z|"[^,]*+,{_FIELDS}"{_INSIDE}\z)'
#: A record of more characters than this is an error: most likely a stray quote opened it.
MAX_RECORD_CHARS = 256_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).alias("at"),
    )


def _after(entry: Column, fixed: Column, swaps: Column) -> Column:
    """State after some lines: what the last line that decides it alone left, or the entry state, swapped since."""
    return F.coalesce(fixed, entry).bitwiseXOR(swaps)


def _glue(lines: DataFrame) -> DataFrame:
    """Join lines that belong to one quoted record, without reading any file in one task.

    A line maps the state before it (0: between records, 1: inside a quoted field) to the state after it. Most lines
    end in the same state from either; the others keep the state or swap it. So the state before any line follows from
    the last deciding line and the number of swaps since: running values per file block, and over the (few) blocks of
    a file. A file that ends inside a quoted field is an error.
    """
    from_0, from_1 = F.col("value").rlike(_OPENS).cast("int"), F.col("value").rlike(_STAYS_OPEN).cast("int")
    mapped = lines.withColumns({"block": F.col("at.block"), "pos": F.col("at.pos"), "s0": from_0, "s1": from_1})
    by_block = Window.partitionBy("file", "block").orderBy("pos")
    sofar = by_block.rowsBetween(Window.unboundedPreceding, 0)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when(F.col("s0") > F.col("s1"), 1).otherwise(0)
    swaps = (F.sum(swap).over(sofar) % 2).cast("int")
    mapped = mapped.withColumn("swaps", swaps)
    # A deciding line's state, as seen past all swaps of the block so far.
    decided = F.when(F.col("s0") == F.col("s1"), F.col("s0").bitwiseXOR(F.col("swaps")))
    mapped = mapped.withColumn("decided", decided)
    fixed, swapped = F.last("decided", True).over(before), F.coalesce(F.lag("swaps").over(by_block), F.lit(0))
    inside = mapped.withColumns({f"before_{e}": _after(F.lit(e), fixed, swapped) for e in (0, 1)})
    position = F.struct("block", "pos")
    blocks = inside.groupBy("file", "block").agg(
        F.max_by(F.when(F.col("before_0") == 0, F.col("s0")).otherwise(F.col("s1")), "pos").alias("exit_0"),
        F.max_by(F.when(F.col("before_1") == 0, F.col("s0")).otherwise(F.col("s1")), "pos").alias("exit_1"),
        F.max(F.when(F.col("before_0") == 0, position)).alias("last_0"),
        F.max(F.when(F.col("before_1") == 0, position)).alias("last_1"),
    )
    by_file = Window.partitionBy("file").orderBy("block")
    upto, earlier = by_file.rowsBetween(Window.unboundedPreceding, 0), by_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("swaps", (F.sum(F.when(F.col("exit_0") > F.col("exit_1"), 1).otherwise(0)).over(upto) % 2).cast("int"))
    blocks = blocks.withColumn("decided", F.when(F.col("exit_0") == F.col("exit_1"), F.col("exit_0").bitwiseXOR(F.col("swaps"))))
    entry = _after(F.lit(0), F.last("decided", True).over(earlier), F.coalesce(F.lag("swaps").over(by_file), F.lit(0)))
    entered = blocks.withColumn("entry", entry)
    own_last = F.when(F.col("entry") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    own_exit = F.when(F.col("entry") == 0, F.col("exit_0")).otherwise(F.col("exit_1"))
    entered = entered.withColumns({"own_last": own_last, "own_exit": own_exit})
    ends_open = F.last("own_exit").over(by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1
    broken = F.when(ends_open, F.raise_error(F.concat(F.lit("a quoted field is open at the end of "), F.col("file"))).cast("int"))
    entered = entered.select("file", "block", F.coalesce(broken, F.col("entry")).alias("entry"),
                             F.last("own_last", True).over(earlier).alias("open_since"))
    joined = inside.join(entered, ["file", "block"])
    starts = F.when(F.when(F.col("entry") == 0, F.col("before_0")).otherwise(F.col("before_1")) == 0, position)
    owned = joined.withColumn("at", F.coalesce(F.last(starts, True).over(sofar), F.col("open_since")))
    pieces = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    record = F.array_join(F.transform(pieces, lambda p: p["value"]), "\n")
    glued = owned.groupBy("file", "name", "at").agg(record.alias("value"))
    long = F.raise_error(F.concat(F.lit("a record is too long, perhaps after a stray quote, in "), F.col("file"))).cast("string")
    return glued.withColumn("value", F.when(F.length("value") > MAX_RECORD_CHARS, long).otherwise(F.col("value")))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool | None = None, surplus: str = "skip",
    header: bool = True, position: str | None = None,
) -> DataFrame:
    """Typed table from one file or a folder; columns are found by the names in each file's header.

    A header that lacks a name, or has one that the schema lacks, is an error. ``header=False`` takes columns by place.
    ``multi_line=None`` looks whether any record spans lines; if none does, lines are parsed where they are read, with
    the same result. Every file is split over tasks either way. ``surplus="fail"`` raises on a row with too many fields
    instead of skipping it. ``position`` names a column that orders the rows as they stand in the files.
    """
    return _read(spark, path, schema, multi_line, surplus, header, position).drop("__file")


def read_csv_many(
    spark: SparkSession, folder: str, schema: T.StructType | str, label: str = "label", multi_line: bool | None = None,
    header: bool = True,
) -> DataFrame:
    """Every CSV of a folder as one table; ``label`` holds the file name without its ending."""
    name = F.regexp_replace(F.col("__file"), r"\.[^.]*$", "")
    return _read(spark, folder, schema, multi_line, header=header).withColumn(label, name).drop("__file")


def _fields(value: Column, n: int) -> Column:
    """The first ``n`` fields of a record and its end mark, as an array of strings."""
    ddl = ", ".join(f"`c{i}` STRING" for i in range(n + 1))
    parsed = F.from_csv(F.concat(value, F.lit("," + _END)), F.lit(ddl), {"escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true", "lineSep": "\n"})
    return F.transform(F.array(parsed), lambda r: F.array(*[r[f"c{i}"] for i in range(n + 1)]))[0]


def _places(records: DataFrame, names: list[str]) -> DataFrame:
    """``file, head, places``: where each file's first record stands, and the place of every name in it."""
    first = records.where("at.block = 0 AND value <> ''").groupBy("file").agg(F.min("at").alias("head"), F.min_by("value", "at").alias("header"))
    found = F.filter(_fields(F.regexp_replace("header", "^\ufeff", ""), len(names)), lambda x: x != _END)
    found = F.transform(found, F.trim)
    wanted = F.array(*map(F.lit, names))
    same = F.array_sort(found) == F.array_sort(wanted)
    wrong = F.raise_error(F.concat(F.lit("columns of "), F.col("file"), F.lit(f" are not {', '.join(names)}: "), F.col("header")))
    places = F.when(F.coalesce(same, F.lit(False)), F.transform(wanted, lambda n: F.array_position(found, n).cast("int"))).otherwise(wrong.cast("array<int>"))
    return first.select("file", "head", places.alias("places"))


def _read(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool | None, surplus: str = "skip",
    header: bool = True, position: str | None = None,
) -> DataFrame:
    if surplus not in ("skip", "fail"):
        raise ValueError("surplus must be 'skip' or 'fail'")
    wanted = _schema(schema)
    names = wanted.fieldNames()
    lines = _lines(spark, path)
    if multi_line is None:
        multi_line = not lines.where(F.col("value").rlike(_OPENS)).isEmpty()
    # A line break inside a quoted field is part of the value, whichever kind it is.
    records = (_glue(lines) if multi_line else lines).withColumn("value", F.regexp_replace("value", "\r\\z", ""))
    if header:
        places = broadcast_if_small(_places(records, names))
        records = records.join(places, "file").where(F.col("at") != F.col("head"))
    else:
        records = records.withColumn("places", F.array(*[F.lit(i + 1) for i in range(len(names))]))
    parsed = records.where(F.col("value") != "").select(
        _fields(F.col("value"), len(names)).alias("r"), "places", F.col("name").alias("__file"), "file", "at")
    complete = F.coalesce(F.array_contains("r", _END), F.lit(False))
    if surplus == "fail":
        complete = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("row with too many fields")).cast("boolean"))
    typed = []
    for i, f in enumerate(wanted.fields):
        field = F.get("r", F.get("places", F.lit(i)) - 1)
        value = F.when((field != "") & (field != _END), field)
        typed.append((value if f.dataType == T.StringType() else value.try_cast(f.dataType)).alias(f.name))
    if position:
        typed.append(F.struct("file", "at.block", "at.pos").alias(position))
    return parsed.where(complete).select(*typed, "__file")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
