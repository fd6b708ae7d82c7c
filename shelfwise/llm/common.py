"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII blanks, nothing else.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    The session's ``spark.checkpoint.dir`` is used where it is set. Only a local-mode
    session without it (tests) gets a temporary folder; elsewhere the warehouse is shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if own is None and sc.master.startswith("local[") or sc.master == "local":
            own = own or tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(own or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
    return sc.getCheckpointDir()


#: Scratch tables are read once or twice: smaller files are worth the time.
STORED_CODEC = "zstd"
#: The tables that each running ``stored_step`` has stored so far, the innermost last.
_steps: list[list[DataFrame]] = []


def stored_step(step: Callable[[], DataFrame], what: str) -> DataFrame:
    """The ``stored`` result of a step; the tables that the step has stored on its way are discarded."""
    _steps.append([])
    try:
        found = stored(step(), what)
    finally:
        made = _steps.pop()
    for t in made:
        if t is not found:
            discard(t)
    freed(found.sparkSession)
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike ``checkpoint()`` this runs the plan once and keeps the rows columnar, so later
    steps read only the columns they need. A lost executor costs nothing afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=STORED_CODEC)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    if _steps:
        _steps[-1].append(found)
    return found


def stored_parts(df: DataFrame, column: str, what: str, parts: int) -> list[DataFrame]:
    """``stored`` in parts by a column of numbers from 0, each of which can be read and discarded by itself, without that column."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path, compression=STORED_CODEC)
    whole = df.sparkSession.read.schema(df.schema).parquet(path)
    found = [whole.filter(F.col(column) == i).drop(column) for i in range(parts)]
    for i, part in enumerate(found):
        part._stored_at = f"{path}/{column}={i}"
    return found


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing will read again; others are left alone."""
    if path := getattr(df, "_stored_at", None):
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where the texts of a column have so many bytes; a longer text is one alone."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def salted_order(key: Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random order of keys."""
    return F.xxhash64(key.cast("string"), F.lit(seed))


def threshold_sample(rows: DataFrame, key: str, limit: int, seed: int = 7) -> DataFrame:
    """About ``limit`` of the rows at most, chosen by a hash of ``key``; all if there are no more.

    A count gives the threshold, so the rows are picked where they lie: no task and no driver
    sees more than the sample. Its size differs from the limit by a few square roots of it.
    """
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(salted_order(F.col(key), seed), F.lit(1 << 40)) < int((1 << 40) * limit / n))


def clashing(docs: DataFrame, *names: str) -> list[str]:
    """Which of the names ``docs`` has, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    return [n for n in names if n.lower() in taken]


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    while clashing(docs, name):
        name = f"_{name}"
    return name


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, salt_by: str, hashed: bool = False) -> DataFrame:
    """Inner join on ``key`` whose hot keys are dealt to several tasks each.

    ``right`` is stored, has a key once and in ``weight`` the left rows that have it. A key with more
    rows than half a shuffle partition holds on average is hot, and is dealt to a task for each half.
    Those keys are fewer than twice the shuffle partitions, whatever the data, so they are
    broadcast to mark the rows. ``weight`` isn't returned. ``hashed``: a task holds its share of
    ``right`` as a hash, so that no left rows are sorted; it has to be much smaller than ``left``.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.sum(weight)).first()[0] or 0
    fair = max(1000, -(-total // (2 * partitions)))
    hot = F.broadcast(right.filter(F.col(weight) > fair).select(key, F.ceil(F.col(weight) / fair).cast("int").alias("_ways")))
    salt = F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_ways")).cast("int"), F.lit(0))
    salts = F.coalesce(F.sequence(F.lit(0), F.col("_ways") - 1), F.array(F.lit(0)))
    salted = left.join(hot, key, "left").withColumn("_salt", salt).drop("_ways")
    dealt = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_ways", weight)
    return salted.join(dealt.hint("shuffle_hash") if hashed else dealt, [key, "_salt"]).drop("_salt")
