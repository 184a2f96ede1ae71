"""Session helpers: a local session for tests and bench, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("daybook")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may go without the setting; there the one machine
    is the cluster and a temporary folder is as shared as it gets.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="daybook-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    run = f"{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    return f"{shared_folder(spark)}/daybook/{run}"


def settle(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage, so that later writes cannot change it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tidy_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside the block shuffle files go with the action that wrote them, not once the driver collects its garbage.

    For steps that each end in ``settle``; a frame that is evaluated twice shuffles twice.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def session_like(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """Another session of the application with the same settings but for some; ``spark`` stays as it is."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


# What a broadcast may have at most. Paths and counts of 100 TB in parts of 128 MB are some
# 800,000 rows of 200 bytes.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 200_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Settle a table of short rows and broadcast it if its rows and their bytes allow.

    Beyond the limits the join is left to shuffle, with skew handled at run time.
    """
    df = settle(df)
    # Numbers and dates take eight bytes at most; nested columns are not what this is for.
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes = [F.coalesce(F.octet_length(f"`{name}`"), F.lit(0)) for name in texts] + [F.lit(8 * len(df.columns))]
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum(sizes, F.lit(0)).cast("bigint")).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= SMALL_ROWS and (found["bytes"] or 0) <= SMALL_BYTES else df


def read_or_empty(
    spark: SparkSession, schema: T.StructType | str, load: Callable[[], DataFrame]
) -> DataFrame:
    """``load()``, or no rows of ``schema`` where the path holds nothing yet."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
