"""Session, storage and join helpers that all operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def canon(c: Column | str) -> Column:
    """A name as it is compared: no backslash, no trailing blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rtrim(F.translate(c, "\\", ""), F.lit(BLANKS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; set to a local one only where unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_netquarry_dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="netquarry-")
            spark._netquarry_dir = found
            spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors, gives AQE real sizes.

    What is written stays until release(), release_all() or the end of the session."""
    spark = df.sparkSession
    path = f"{_steps_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._netquarry_path = path
    return out


def _steps_dir(spark: SparkSession) -> str:
    """The folder of this application's steps; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/netquarry/{spark.sparkContext.applicationId}"
    if path not in _SWEPT:
        _SWEPT.add(path)
        atexit.register(_sweep, spark, path)
    return path


_SWEPT: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)


def release(df: DataFrame | None) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_netquarry_path", None)
    if path:
        _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Deletes every step of this application, once the results that read them are written: for sessions that run many queries."""
    _delete(spark, _steps_dir(spark))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(df: DataFrame, by: list[str], name: str = "n", start: int = 1) -> DataFrame:
    """df with consecutive numbers in the order of distinct keys `by`: range partitions are numbered each by itself, after as many as
    the ones before hold."""
    p = materialise(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "numbered")
    before, front = start, []
    for r in sorted(p.groupBy("_p").count().collect()):  # a row per partition
        front.append((r[0], before))
        before += r[1]
    front_df = F.broadcast(df.sparkSession.createDataFrame(front, "_p int, _front long"))
    return p.join(front_df, "_p").withColumn(name, F.col("_front") + F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1).drop("_p", "_front")


def broadcast_if_small(df: DataFrame, most_rows: int = 20_000) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it is counted to hold at most most_rows; the count reads no more than most_rows + 1."""
    if df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df), True
    return df, False


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: joined by sorting. Spark would broadcast it wherever it guesses it to be small, and
    it guesses from compressed files and from the rows before they are repeated."""
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 8, by: Column | None = None) -> DataFrame:
    """big joined with small, of which each row is repeated once per salt, so a hot key of big is spread over `salts` tasks.

    `small` must be much smaller than `big` (a dictionary, a set of orphans, one row per key)."""
    by = F.monotonically_increasing_id() if by is None else F.xxhash64(by)
    left = big.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 500_000) -> Iterator[pa.Table]:
    """Tables of about `least` rows, of rows sorted by keys, that never end within a block of equal keys: what a task holds follows the
    size of the blocks, not that of its partition."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            for k in keys:
                x = t.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new)
            if len(starts):
                yield t.slice(0, int(starts[-1])).combine_chunks()
                t = t.slice(int(starts[-1]))
                rows = t.num_rows
            else:
                rows = 0  # one block so far: more of it may come
            held = t.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    base = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "netquarry-warehouse"),
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
