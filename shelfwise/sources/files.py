"""Readers and writers: typed, lenient and encoded CSV, Parquet, JSON, folders by month."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, else the warehouse; a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="spark-scratch-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to a new scratch folder and read back: its plan isn't run again, and a lost executor loses nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_typed(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Header CSV by a given schema; column names are trimmed. A byte-order mark is skipped by Spark."""
    df = spark.read.schema(schema).option("header", True).csv(path if isinstance(path, str) else list(path))
    return df.toDF(*[c.strip() for c in df.columns])


def number_or_zero(c: Column) -> Column:
    """Thousands separators out; what isn't a number is 0."""
    return F.coalesce(F.regexp_replace(c, ",", "").try_cast("long"), F.lit(0).cast("long"))


def read_sales_csv(spark: SparkSession, path: str | Sequence[str], schema: str, mapping: dict[str, str], numbers: Sequence[str], date: str) -> DataFrame:
    """Raw sales: strings throughout, renamed, numbers repaired, dates yyyyMMdd or null."""
    raw = read_csv_typed(spark, path, schema).withColumnsRenamed(mapping)
    return raw.withColumns({**{c: number_or_zero(F.col(c)) for c in numbers}, date: F.try_to_date(date, "yyyyMMdd")})


def ingest_csv_to_parquet(spark: SparkSession, path: str | Sequence[str], schema: str, mapping: dict[str, str], numbers: Sequence[str], date: str, out: str) -> None:
    read_sales_csv(spark, path, schema, mapping, numbers, date).write.mode("append").option("compression", "snappy").parquet(out)


def read_csv_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ragged lines: extra fields are dropped, missing ones null; bad cells are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


#: Character sets that Spark's CSV reader takes.
SPARK_CHARSETS = {"UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32", "ISO-8859-1", "US-ASCII"}


def recoded(c: Column, source: str, target: str) -> Column:
    """Texts whose bytes in one character set are read in another; what doesn't fit is replaced. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.encode(source, "replace").decode(target, "replace"), na_action="ignore")

    return run(c)


def decoded_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(line): the lines below the header of text files in any character set whose characters hold no line feed; empty lines are left out.

    Files are split by bytes as Spark splits any text. A split that begins a file drops its first
    line, the header. Bad bytes become U+FFFD.
    """
    raw = spark.read.text(path).filter(F.length("value") > 0)
    placed = raw.select(F.col("value").cast("binary").alias("bytes"), F.concat_ws("@", "_metadata.file_path", "_metadata.file_block_start").alias("place"), (F.col("_metadata.file_block_start") == 0).alias("begins"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            header = batch["begins"].astype(bool) & (batch["place"] != batch["place"].shift(fill_value=last))
            last = batch["place"].iloc[-1] if len(batch) else last
            yield pd.DataFrame({"line": [bytes(b).decode(encoding, "replace") for b in batch["bytes"][~header]]}, dtype=object)

    return placed.mapInPandas(decode, "line string")


def read_csv_encoded(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV in another character set; what doesn't fit a column's type is null.

    A set that Spark's reader doesn't take (such as CP949, Shift-JIS) is decoded line by line before
    lines are split into fields, so a character may hold the byte of a separator, quote or
    backslash. There a quoted field must not hold a line feed.
    """
    if encoding.upper() in SPARK_CHARSETS:
        return spark.read.option("header", True).schema(schema).option("encoding", encoding).csv(path)
    return decoded_lines(spark, path, encoding).select(F.from_csv("line", schema).alias("r")).select("r.*")


def read_monthly_folders(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """CSV under month folders such as 2025-03 (or month=2025-03, as Spark writes them); adds month from the path."""
    df = spark.read.schema(schema).option("header", True).csv(f"{root}/*/*.csv")
    return df.withColumn("month", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]+=)?(\d{4}-\d{2})/[^/]*$", 1))


def union_sources(dfs: Sequence[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """All rows; columns that a source lacks are null, or the default given."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def in_target_list(df: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose key a list names."""
    return df.join(targets.select(key), key, "left_semi")


def source_schema_report(df: DataFrame) -> DataFrame:
    """A row per column: its place, name and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
