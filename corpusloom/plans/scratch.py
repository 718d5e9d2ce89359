"""Tables that an iterative or multi-pass plan writes once and reads again.

They live in the shared folder that the session names in ``spark.checkpoint.dir``, so that they survive the loss of any executor
and cut the lineage; only where that setting is absent and the master is local (tests, a laptop) a temporary folder takes its place.
Results that outlive their plan are deleted when the program ends, or before that by ``release``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the session has none, the context's checkpoint folder, or a temporary one if the
    master is local. On a cluster a folder of one machine would lose tables, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder in ("", "<undefined>"):
        context = spark.sparkContext
        folder = context.getCheckpointDir() or _OWN.setdefault(context.applicationId, "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not folder:
            folder = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Results that are kept, by path, with the session that can delete them.
_KEPT: dict[str, SparkSession] = {}


def release() -> None:
    """Deletes all kept results; whoever still needs one has written it elsewhere."""
    for path, spark in [*_KEPT.items()]:
        with contextlib.suppress(Exception):  # a session that has stopped can't delete, and then nothing else can
            remove(spark, path)
        _KEPT.pop(path, None)


atexit.register(release)


class Scratch:
    """Written tables of one plan; leaving the ``with`` block deletes all but those that ``keep`` wrote."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
        self._made: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        for path in self._made:
            remove(self.spark, path)

    def path(self, name: str) -> str:
        """A fresh folder that is deleted with the rest."""
        path = f"{self.folder}/{len(self._made)}-{name}"
        self._made.append(path)
        return path

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        """``df`` written and read again."""
        return self._written(df, self.path(name))

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Like ``table``, for what outlives the block, until ``release``."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        _KEPT[path] = self.spark
        return self._written(df, path)

    def drop(self, df_path: str) -> None:
        """Deletes one folder early."""
        remove(self.spark, df_path)
        self._made.remove(df_path)
