"""Cutting a plan in two: a table written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session, as in tests, gets a folder of its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="mediacast-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; the files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    later_gone(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def later_gone(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver's Python ends."""
    atexit.register(_remove, spark, path)


def free(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended already; the shared folder's owner cleans up
        pass


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """What the driver holds as one file, in any store that Hadoop knows; readers see the old file or the new one, whole."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
    try:
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        publish(spark, aside, path)
    except BaseException:
        _remove(spark, aside)
        raise


def publish(spark: SparkSession, aside: str, path: str) -> None:
    """Rename ``aside`` over ``path`` in one step, as far as the store has that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    source, target = (make(x).getFileSystem(conf).makeQualified(make(x)) for x in (aside, path))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, how)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header at ``path``, replacing what is there in one step. For results of a bounded size: one task writes."""
    spark = df.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        df.coalesce(1).write.option("header", True).csv(folder)
        make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in fs.listStatus(make(folder)) if f.getPath().getName().startswith("part-"))
        publish(spark, part.toString(), path)
    finally:
        _remove(spark, folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application; Spark's file server carries it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="mediacast-ship-"))
    with zipfile.ZipFile(folder / "mediacast_core.zip", "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(folder / "mediacast_core.zip"))
    _shipped.add(sc.applicationId)
