"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that is broadcast at most, as the rows' text and numbers take them.
MAX_BROADCAST_BYTES = 64 << 20
#: A key is joined by broadcast if it makes up more than this share of all rows; so there are at most so many of them.
HOT_SHARE = 10_000
_SCRATCH: list[str] = []


def build_session(app: str = "granthika", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset (tests): it gets
    a temporary folder; on a cluster that is an error, as other machines couldn't read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-granthika-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call gets; ``clear_scratch`` deletes it."""
    _SCRATCH.append(f"{shared_dir(spark)}/granthika/{tag}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch() -> int:
    """Deletes what ``scratch_path`` has named so far in this process; returns the number of paths.

    For the end of a job: results that are read lazily from scratch tables must be written before.
    """
    from pyarrow import fs

    n = len(_SCRATCH)
    while _SCRATCH:
        files, path = fs.FileSystem.from_uri(_SCRATCH.pop())
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)
    return n


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts lineage where a result is read several times; a lost executor costs nothing, as the files are shared.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, tag: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written once in the shared folder for each ``mark`` and read from there after that.

    The mark must name all that the table depends on. A second small table is written last, so one that was left half
    written is written anew.
    """
    path = f"{shared_dir(spark)}/granthika/{tag}-{mark}"
    if read_if_there(spark, f"{path}/done", "mark string") is None:
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).select(F.lit(mark).alias("mark")).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows")


def fingerprint(rows: DataFrame, *parts: object) -> str:
    """Mark of the files that ``rows`` is read from (paths, sizes, times) and of ``parts``; without files no mark occurs twice."""
    meta = F.col("_metadata")
    if not rows.inputFiles():
        return uuid.uuid4().hex
    files = rows.select(meta["file_path"].alias("p"), meta["file_size"].alias("s"), meta["file_modification_time"].alias("t")).distinct()
    found = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("x")).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, repr((found.n, str(found.x), parts))).hex


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, about: texts by their length, arrays of texts likewise, other values 8 each."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        if kind == "string" or kind == "binary":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            size = size + F.coalesce(F.aggregate(name, F.lit(0), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.size(name), F.lit(0))
        else:
            size = size + 8
    return size


def measured(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take, about, by one aggregate."""
    return df.agg(F.sum(row_bytes(df).cast("long"))).first()[0] or 0


def broadcast_within(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only where ``df`` has been measured and is within the bound.

    Beyond the bound the side is returned as it is, and Spark joins it by shuffle.
    """
    return F.broadcast(df) if measured(df) <= max_bytes else df


def only(rows: DataFrame, key: str, wanted: DataFrame, others: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted`` and so not in ``others``; between them they hold every key.

    Wide rows stay where they are if the smaller side is within the bound of a broadcast; else they are shuffled once.
    """
    a, b = measured(wanted), measured(others)
    if min(a, b) > max_bytes:
        return rows.join(wanted, key, "left_semi")
    return rows.join(F.broadcast(wanted), key, "left_semi") if a <= b else rows.join(F.broadcast(others), key, "left_anti")


def join_counted(rows: DataFrame, found: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found``, which has one row a key with the number ``n`` of its rows.

    Keys that make up more than a ten-thousandth of all rows are ten thousand at most and are joined by broadcast, so no
    task gets all rows of a frequent key; the others are joined by shuffle. ``found`` is read several times.
    """
    least = max(1_000, (found.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE)
    hot, rest = F.broadcast(found.where(F.col(n) > least)), found.where(F.col(n) <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, how))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores where its scan has fewer tasks than that; large tables have more and stay as they are.

    For work that is much dearer than a shuffle of its input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def computed_once(df: DataFrame) -> DataFrame:
    """``df``, whose column expressions the optimizer can't copy into each place that uses them.

    For parsed JSON and joined texts that long expressions refer to many times: a generator stands between the projections.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
