"""Session-level helpers: checkpoint folder, size checks before broadcasting."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once its count has been taken (about 20 MB of narrow rows).
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(importlib.util.find_spec("hemispark").origin).parent
    target = Path(tempfile.mkdtemp(prefix="hemispark-")) / "hemispark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("hemispark") / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` (a folder that all executors share).

    Only where that setting is absent, as in local tests, a folder of our own is set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hemispark-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed_checkpoint(df: DataFrame) -> DataFrame:
    """As :func:`checkpoint`, for rows with texts: each Arrow batch is written as one compressed block.

    Spark compresses checkpointed rows in small frames; in blocks by column texts take about a third of that.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from pa.ipc.open_stream(block.as_buffer())

    return checkpoint(df.mapInArrow(pack, "block binary")).mapInArrow(unpack, df.schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcasting if it proves to have at most ``rows`` rows.

    The count stops after ``rows + 1`` rows, so checking costs no more than the bound.
    """
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join whose left side may have one key with a third of all rows.

    The right side is broadcast where it proves small; else left rows are spread over ``salts`` sub-keys
    and the (one row per key) right side is replicated over them.
    """
    right, small = broadcast_if_small(right)
    if small:
        return left.join(right, on, how)
    spread = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
