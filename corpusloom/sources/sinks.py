"""Writers: chunks, Parquet shards, token streams, records of provenance, tables for people."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.layout import round_robin, split_validation


def write_round_robin(df: DataFrame, path: str, row: str, chunks: int, validation: int = 0, columns: list[str] | None = None, compression: str = "none") -> None:
    """JSON lines: the first ``validation`` rows to ``split=val``, the others dealt to ``split=train/chunk=k`` in row order."""
    split, chunk = split_validation(F.col(row), validation, chunks)
    rows = df.withColumns({"split": split, "chunk": F.coalesce(chunk, F.lit(-1))})
    keep = [*(columns or df.columns), "split", "chunk"]
    rows.repartition("split", "chunk").sortWithinPartitions("split", "chunk", row).select(*keep).write.partitionBy("split", "chunk").option("compression", compression).json(path)


def write_parquet_shards(df: DataFrame, path: str, rows_per_file: int = 125_000, rows_per_group: int = 10_000) -> None:
    """zstd Parquet with a bounded number of rows a file and a row group."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", rows_per_group).parquet(path)


def publish(df: DataFrame, path: str) -> bool:
    """Writes Parquet beside ``path`` and renames it when it is complete, so that readers never see a part; False if there is a result
    under that name already, which stays."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    df.write.parquet(draft.toString())
    if not files.exists(target) and files.rename(draft, target):
        return True
    files.delete(draft, True)
    return False


def write_token_stream(stream: DataFrame, path: str, start: str = "start") -> None:
    """A token stream in order of its offsets, so that readers of a prefix or a range prune files by their statistics."""
    stream.repartitionByRange(start).sortWithinPartitions(start).write.option("compression", "zstd").parquet(path)


def extended(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """An existing stream with new documents after it; the prefix is not made again."""
    end = existing.agg(F.coalesce(F.max(F.col("start") + F.col("n_tokens")), F.lit(0)).alias("_end"))
    return existing.unionByName(fresh.withColumn("start", F.col("start") + F.lit(end.first()["_end"])))


def provenance(df: DataFrame, **facts: object) -> str:
    """One JSON record of what a data set is: its rows and given facts."""
    return json.dumps({"rows": df.count(), **facts}, sort_keys=True)


def with_chunks(df: DataFrame, row: str, chunks: int) -> DataFrame:
    """``df`` with its round-robin ``chunk`` and ``line``."""
    chunk, line = round_robin(F.col(row), chunks)
    return df.withColumns({"chunk": chunk, "line": line})


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, as JSON has none."""
    wide = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(wide) if wide else df


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with nulls for what is not finite."""
    finite(df).write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.option("header", "true").csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table; for results of at most ``most`` rows (more is an error, not cut)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *map(line, rows)])


def page(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A self-contained page with the rows as JSON; ``</`` can't end the script early."""
    rows = [json.loads(r[0]) for r in finite(df).select(F.to_json(F.struct(*df.columns))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a page has at most {most} rows")
    data = json.dumps(rows).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><script>const rows = {data};</script>'
