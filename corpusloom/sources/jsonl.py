"""JSON-lines corpora with line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import first_present

# Fixed value: the fields that may hold a record's text, in order.
TEXT_FIELDS = ("text", "content", "original_text")
CHUNK_PATTERNS = ("*.chunk.*.jsonl*", "*shard*.jsonl*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of every line, blank ones included; numbers start at 0 in each file, and a last line without a line feed
    counts. gzip and zstd files are read as they are.

    Spark reads files in splits; the lines of each split are counted, and a line's number is its place in the split after all earlier
    splits of the file, so no file is one task.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    counts = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("file").alias("_f"), F.col("_at").alias("_a"), (F.sum("_n").over(Window.partitionBy("file").orderBy("_at")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_id")) - 1
    joined = lines.withColumn("_in", inside).join(starts, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_a")))
    return joined.select("file", (F.col("_first") + F.col("_in")).cast("long").alias("line_no"), "value")


def parsed(lines: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """``lines`` with ``record``. A malformed line has a null record, keeps its number, and is dropped only by ``valid``; with
    ``strict`` it stops the job."""
    whole = StructType([*schema.fields]).add("_corrupt", "string")
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.from_json("value", schema if strict else whole, mode)
    if strict:
        return lines.withColumn("record", record)
    good = record["_corrupt"].isNull() & F.trim("value").startswith("{")
    return lines.withColumn("record", F.when(good, F.struct(*[record[f.name].alias(f.name) for f in schema.fields])))


def valid(parsed_lines: DataFrame) -> DataFrame:
    """Lines that hold an object."""
    return parsed_lines.where(F.col("record").isNotNull())


def text_of(record: str, schema: StructType) -> Column:
    """A record's text: the first of its text fields that is there."""
    return first_present(*[F.col(f"{record}.{f}") for f in TEXT_FIELDS if f in schema.fieldNames()])


def checked_chunks(names: list[str], readers: int) -> list[str]:
    """The chunks that readers share, sorted: surplus ones are dropped, and fewer than readers must divide them."""
    found = sorted(names)
    if not found:
        raise ValueError("there is no chunk")
    if len(found) > readers:
        return found[: len(found) - len(found) % readers]
    if readers % len(found):
        raise ValueError(f"{len(found)} chunks do not divide {readers} readers")
    return found
