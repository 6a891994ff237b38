"""Sources and sinks: delimited files, archives, Parquet; atomic writes; samples; generated tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's checkpoint folder; a local session without one gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="palisade-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """A storage boundary: ``df`` written and read back; its past is cut."""
    path = f"{shared_folder(df.sparkSession)}/palisade/{uuid.uuid4().hex}/{re.sub('[^A-Za-z0-9_-]', '-', name)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- reading

_SCHEMAS: dict[tuple[str, int, int], T.StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; the schema of a single file that hasn't changed is not read from its footer again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    if not status.isFile():
        return spark.read.parquet(path)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        if len(_SCHEMAS) > 1000:
            _SCHEMAS.clear()
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",", normalize_names: bool = False) -> DataFrame:
    """A headed text table.  Without ``schema`` all columns are strings; cast with ``conform``, as inferring reads all data twice."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.toDF(*[normalized(c) for c in df.columns]) if normalize_names else df


def read_inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """As ``read_delimited`` with types inferred from the data; for exploring."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)


def normalized(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower())).strip("_") or "column"


def extract_member(archive: str | Path, member: str, folder: str | Path) -> Path:
    """One file of a ZIP archive, put beside by rename; names that leave the folder are refused."""
    folder = Path(folder)
    target = (folder / Path(member).name).resolve()
    if folder.resolve() not in target.parents:
        raise ValueError("the member's name leaves the folder")
    folder.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + f".{uuid.uuid4().hex}.part")
    with zipfile.ZipFile(archive) as z, z.open(member) as source, part.open("wb") as out:
        while chunk := source.read(1 << 20):
            out.write(chunk)
    part.rename(target)
    return target


def cleaned(df: DataFrame, casts: dict[str, str], required: Iterable[str] = (), between: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Casts that give null where a value does not fit, then rows with the required columns inside their ranges."""
    out = df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in casts.items()})
    for c in required:
        out = out.where(F.col(c).isNotNull())
    for c, (low, high) in (between or {}).items():
        out = out.where(F.col(c).between(low, high))
    return out


# ---------------------------------------------------------------- writing


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> int:
    """ZSTD Parquet that appears at ``path`` whole or not at all; the number of rows that can be read there."""
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(part)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(path)) or not fs.rename(fs_path(part), fs_path(path)):
        fs.delete(fs_path(part), True)
        raise FileExistsError(path)
    return spark.read.parquet(path).count()


# ---------------------------------------------------------------- relational helpers of data preparation


def distinct_union(*parts: DataFrame) -> DataFrame:
    """Rows of any part once; a dimension from several columns of facts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _part() -> Column:
    return F.shiftright("_at", 33).alias("_part")


def _kept_in_order(df: DataFrame) -> DataFrame:
    """``df``, whose partitions are in order, stored with ``_at``, which grows along partitions and rows.

    It is stored once and read for all that follows: a second run of the same plan may be partitioned otherwise.
    """
    return stored(df.withColumn("_at", F.monotonically_increasing_id()), "in-order")


def _before() -> Window:
    """A window over one row a partition."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def places(df: DataFrame, name: str = "_place") -> DataFrame:
    """``df``, whose partitions are in order, with each row's place from 0: its place in its partition and the rows of those before."""
    kept = _kept_in_order(df)
    counts = kept.groupBy(_part()).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.coalesce(F.sum("_n").over(_before()), F.lit(0)) - F.col("_first")).alias("_offset"))
    numbered = kept.withColumn("_part", _part()).join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Partitions and rows in an order, nulls first; no task holds more than its range."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``row_number() OVER (ORDER BY order)`` without a single-partition window; the order should leave no ties."""
    return places(in_order(df, order), "_place").select(*df.columns, (F.col("_place") + 1).alias(name))


def running_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``sum(value) OVER (ORDER BY order)`` with the default frame, in which peers have one sum: a row for each distinct order key.

    Peers are added up first.  Ranges of keys are summed on their own and get the total of the ranges before.
    """
    peers = df.groupBy(*order).agg(F.sum(value).alias("_peers"))
    kept = _kept_in_order(in_order(peers, order)).withColumn("_part", _part())
    totals = kept.groupBy("_part").agg(F.sum("_peers").alias("_total"))
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(_before()), F.lit(0)).alias("_offset"))
    inner = kept.withColumn("_inner", F.sum("_peers").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    return inner.join(F.broadcast(offsets), "_part").select(*order, (F.coalesce("_inner", F.lit(0)) + F.col("_offset")).alias(name))


def until_covered(df: DataFrame, key: str, order: Column, rows: int) -> DataFrame:
    """Keys of ``df``, in an order of their own, until the keys taken have ``rows`` rows or more in all."""
    frequencies = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_order", order)
    sums = running_sums(frequencies, ["_order", key], "_rows", "_sum")
    return frequencies.join(sums, ["_order", key]).where(F.col("_sum") - F.col("_rows") < rows).select(key)


def even_sample(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``size`` rows at even steps of an order; all rows if there are fewer.

    Row k is taken where k * size // total steps up.
    """
    placed = places(in_order(df, order))
    total = placed.count()
    step = lambda k: F.floor(k * F.lit(min(size, total)) / F.lit(max(1, total)))
    return placed.where(step(F.col("_place") + 1) > step(F.col("_place"))).select(*df.columns)


def seeded_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows, the same for the same rows and seed: those of the smallest hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(size)


def bucket_of(c: Column, buckets: int = 10_000) -> Column:
    """Bucket of a string by the first 32 bits of its MD5, which other engines can compute too."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def synthetic_events(spark: SparkSession, rows: int, id_width: int = 18, allowed_share: float = 0.5, hot_share: float = 0.3, keys: int = 1000, seed: int = 0) -> DataFrame:
    """Events with controlled selectivities and a hot join key, generated on the executors."""
    unit = lambda k: bucket_of(F.concat(F.lit(f"{seed + k}-"), F.col("id").cast("string")), 1_000_000) / 1e6
    return spark.range(rows).select(
        F.rpad(F.concat(F.lit("ev-"), F.lpad(F.col("id").cast("string"), 12, "0")), id_width, "x").alias("event_id"),
        (F.to_timestamp(F.lit("2026-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("id") % 31_536_000)).alias("event_time"),
        (unit(1) * 180 - 90).alias("latitude"),
        (unit(2) * 360 - 180).alias("longitude"),
        (unit(3) < allowed_share).alias("policy_allowed"),
        F.when(unit(4) < hot_share, F.lit("key-hot")).otherwise(F.concat(F.lit("key-"), bucket_of(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")), keys).cast("string"))).alias("join_key"),
        (unit(5) * 9).alias("magnitude"),
    )


def hash_of(*columns: str) -> Column:
    """60 bits of the MD5 of the values as text, which other engines can compute too; a null is no text."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count, XOR of row hashes and total text length: equal for equal bags of rows."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(hash_of(*columns)).alias("hash_xor"),
        F.sum(F.length(F.concat_ws("", *[F.col(c).cast("string") for c in columns]))).cast("decimal(38,0)").alias("text_length"),
    )
