"""Helpers that the operators of this subpackage share.

Lineage is cut with tables written under the folder named by ``spark.checkpoint.dir`` (shared by all
executors), so that a lost executor costs a re-read and never a recomputation of non-deterministic rows.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root

#: ASCII whitespace as the contracts define it.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder of this application, below the one that all executors share."""
    return f"{shared_root(spark)}/lodestone-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more, which it does when the driver collects garbage:
    in the first round plans go, in the second the shuffles that only they referred to."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results are lazy and read them, so whoever writes a result calls this afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows from now on, as rows are whole texts here and every task
    holds several copies of a batch. A session that has chosen a size of its own, whatever it is, keeps it. Only the registered
    queries and the pipeline call this; the operators leave the session as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(col: str | Column) -> Column:
    """CRC-32 of a value as text; null for null."""
    return F.crc32(F.encode((F.col(col) if isinstance(col, str) else col).cast("string"), "UTF-8"))


def held_out(col: str, mod: int, rest: int) -> Column:
    """True where crc32(id as text) mod ``mod`` is ``rest``; a null id is never held out."""
    return F.coalesce(crc_of(col) % mod == rest, F.lit(False))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, salts: int | None = None) -> DataFrame:
    """Attach the one row of ``groups`` per key to every row, without a task that holds a whole hot key.

    Rows get a salt from column ``by``. Each key's group row is copied once for each salt that its rows
    really have (at most ``salts`` and at most the number of rows), and the wide join runs on (key, salt).
    There are as many salts as shuffle partitions, 256 at least. Keys must not be null; rows whose key has no group are dropped.
    """
    salts = salts or max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    present = salted.select(*keys, "__salt").distinct()
    copies = present.join(groups, keys)
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def bitmap(keys: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """A hash bitmap of fixed size over the rows of ``keys``: at most 2**(bits-15) rows of 4 KB, written once."""
    h = F.pmod(F.xxhash64(*cols), F.lit(1 << bits))
    made = (
        keys.select(h.alias("__h"))
        .groupBy(F.shiftright("__h", 15).alias("__slot"))
        .agg(F.bitmap_construct_agg(F.expr("__h & 32767L")).alias("__bits"))
    )
    return scratch(made, "bitmap")


def with_maybe(rows: DataFrame, made: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """``rows`` with ``__maybe``: false only if no key of the broadcast ``bitmap`` equals the row's ``cols``."""
    byte = F.conv(F.hex(F.substring("__bits", F.expr("cast((__h & 32767L) div 8 as int) + 1"), F.lit(1))), 16, 10)
    return (
        rows.withColumn("__h", F.pmod(F.xxhash64(*cols), F.lit(1 << bits)))
        .withColumn("__slot", F.shiftright("__h", 15))
        .join(F.broadcast(made), "__slot", "left")
        .withColumn("__byte", F.coalesce(byte.cast("long"), F.lit(0).cast("long")))
        .withColumn("__maybe", F.expr("shiftright(__byte, cast(__h & 7L as int)) & 1L") == 1)
        .drop("__h", "__slot", "__bits", "__byte")
    )


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that name a row by id and text, never null; rows that share them are repetitions."""
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")).alias("__key"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"),
    ]


def keep_rows(docs: DataFrame, every: DataFrame, kept: DataFrame, id_col: str, text_col: str, bits: int = 24) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names, once each, with all their columns.

    ``every`` and ``kept`` hold ``row_key`` columns: one row per row of ``docs``, and those that stay. Only rows that
    (nearly) go, or are repeated, are shuffled; a broadcast bitmap of fixed size lets all others pass.
    """
    names = ["__key", "__hash"]
    counted = every.groupBy(*names).agg(F.count("*").alias("__n"))
    marked = counted.join(kept.select(*names, F.lit(True).alias("__stays")).distinct(), names, "left")
    touched = scratch(marked.filter(F.col("__stays").isNull() | (F.col("__n") > 1)), "touched-rows")
    # Columns go by their places, so that none can clash with the helpers' names.
    columns = [f"c{i}" for i in range(len(docs.columns))]
    key, text_hash = row_key(columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)])
    keyed = docs.toDF(*columns).withColumns({"__key": key, "__hash": text_hash})
    rows = with_maybe(keyed, bitmap(touched, names, bits), names, bits)
    gone = touched.filter(F.col("__stays").isNull()).select(*names)
    checked = rows.filter("__maybe").join(gone, names, "left_anti").dropDuplicates(names)
    return rows.filter(~F.col("__maybe")).select(*columns).unionByName(checked.select(*columns)).toDF(*docs.columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that what a task holds and sends back at once stays small where whole texts go along."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def accepted(docs: DataFrame, text_col: str, judge: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose texts ``judge`` accepts, with all their columns, whatever these are called."""
    at = docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(judge(b.column(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
