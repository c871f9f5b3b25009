"""Shared helpers: scratch tables in the cluster's shared folder, column names, text buffers."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of op2 and op3: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent and all of Spark runs in one process (tests) a folder of our own is
    made; on a cluster no one else would see it, so there a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="tidalframe-")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/tidalframe-{label}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm_path.getFileSystem(conf).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts lineage: a lost executor costs at most the tasks it ran, and later passes read the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the classifiers. A null id counts as an empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def worker_state() -> dict:
    """What one Python worker keeps from task to task, such as loaded tokenizers."""
    return sys.modules.setdefault("tidalframe_worker_state", types.ModuleType("tidalframe_worker_state")).__dict__


def share(spark: SparkSession, value: object) -> Broadcast:
    """``value`` broadcast by value, classes of this package and all."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(broadcast: Broadcast) -> object:
    """What ``share`` was given; a worker keeps the last one from task to task."""
    state, packed = worker_state(), broadcast.value
    if state.get("packed") != packed:
        state["packed"], state["shared"] = packed, cloudpickle.loads(packed)
    return state["shared"]
