"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent one is made on this machine, but only for a session whose tasks run
    here too; on a cluster that is an error, as its hosts don't see each other's folders.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        known = context.getCheckpointDir()
        if not known and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
        found = known.rsplit("/", 1)[0] if known else "file://" + tempfile.mkdtemp(prefix="attestor-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    context = spark.sparkContext
    if (name := context.applicationId) not in _folders:
        _folders[name] = f"{shared_folder(spark)}/attestor/{name}"
        atexit.register(delete, context._jvm, context._jsc.hadoopConfiguration(), _folders[name])
    return _folders[name]


def delete(jvm, configuration, path: str) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(configuration).delete(target, True)
    except (Py4JError, OSError):  # the JVM has gone: the folder is left
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            delete(context._jvm, context._jsc.hadoopConfiguration(), folder)
