"""Session defaults and the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan here relies on; a session that sets them already keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(name: str = "lodestar", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share.

    Only a session in one process (tests, local runs) that names none gets a temporary one, deleted when Python ends; on a
    cluster a missing spark.checkpoint.dir is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not _local(sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodestar-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: lineage ends, and a lost executor costs nothing but its tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like `cut`, as a columnar table: readers take the columns they need, and the planner knows its size."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_file(spark: SparkSession, uri: str):
    """The file system and the path of a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_shared(spark: SparkSession, data: bytes, stem: str, suffix: str = "") -> str:
    """Write bytes to a new file in the shared folder; its URI."""
    fs, path = _shared_file(spark, f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}{suffix}")
    stream = fs.create(path)
    stream.write(bytearray(data))
    stream.close()
    return path.toString()


def get_shared(spark: SparkSession, uri: str) -> bytes:
    """The bytes of a small file."""
    fs, path = _shared_file(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def drop_shared(spark: SparkSession, uri: str) -> None:
    """Delete a file or folder of the shared folder that nothing reads any more."""
    fs, path = _shared_file(spark, uri)
    fs.delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application; on a cluster they have no copy of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, buf = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(put_shared(spark, buf.getvalue(), root.name, ".zip"))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
