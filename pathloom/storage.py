"""Staging in the folder that driver and executors share, and files through Spark's own file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Staged tables that are still there, by application.
_STAGED: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own, but only if all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    if (given := sc.getConf().get("spark.checkpoint.dir")) is None and (given := sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset, and executors can't see a folder of the driver's")
        sc.setCheckpointDir(tempfile.mkdtemp())
        given = sc.getCheckpointDir()
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``clear`` deletes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED[app] = set()
        atexit.register(_at_exit, spark)
    _STAGED[app].add(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and rereads it, which cuts the lineage and computes it once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(staged: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark, path = staged.sparkSession, staged.staged_path
    Files(spark, path).delete(path)
    _STAGED.get(spark.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has staged. Results that aren't written yet can't be read afterwards."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, set()):
        Files(spark, path).delete(path)


def _at_exit(spark: SparkSession) -> None:
    live = SparkContext._active_spark_context
    if live is not None and live is spark.sparkContext and live._jsc is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001  the process ends; what can't be deleted stays
            pass


class Files:
    """Small files and folders on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def create(self, name: str, text: str = "") -> bool:
        """Creates a file with ``text``; False if it is there already."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def move(self, source: str, target: str) -> bool:
        """Renames a file that is there; False if it isn't, as where another was faster."""
        try:
            return self.fs.rename(self.path(source), self.path(target))
        except Exception:  # noqa: BLE001  file systems differ in whether a missing file is an error
            if self.exists(source):
                raise
            return False

    def replace(self, source: str, target: str) -> None:
        """Renames over ``target`` in one step."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.path(target).toUri() if "://" in target else self.jvm.java.net.URI("file:///"),
            self.conf,
        )
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = spark_array(self.jvm, "org.apache.hadoop.fs.Options$Rename", [getattr(options, "Rename").OVERWRITE])
        context.rename(self.path(source), self.path(target), rename)

    def free_percent(self, name: str) -> float:
        """Free space of the file system that holds a folder, or its nearest parent, in percent; 100 where that isn't told."""
        at = self.path(name)
        while not self.fs.exists(at) and at.getParent() is not None:
            at = at.getParent()
        status = self.fs.getStatus(at)
        whole = status.getCapacity()
        return 100.0 * status.getRemaining() / whole if 0 < whole < (1 << 63) - 1 else 100.0

    def size(self, name: str) -> int:
        """Bytes of all files below a folder."""
        return self.fs.getContentSummary(self.path(name)).getLength()

    def private_folder(self, name: str) -> str:
        """Creates a folder that only its owner may enter; returns the mode of one that is there already, in octal."""
        folder = self.path(name)
        if not self.fs.exists(folder):
            self.fs.mkdirs(folder)
            self.fs.setPermission(folder, self.jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
        return f"{self.fs.getFileStatus(folder).getPermission().toShort():o}"

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


def spark_array(jvm, kind: str, values: list):
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    cls = jvm
    for part in kind.replace("$", ".").split("."):
        cls = getattr(cls, part)
    out = gateway.new_array(cls, len(values))
    for i, v in enumerate(values):
        out[i] = v
    return out
