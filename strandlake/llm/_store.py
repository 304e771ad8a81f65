"""Where jobs cut their lineage, what they leave there, and how inputs are read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Folders of written tables that were not removed yet, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, and the master is local, so that there is one machine
    only (tests), a folder made once per application and removed at the end of
    the process. Elsewhere an unset folder is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        own = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[app] = "file://" + own
    return _own[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path that is not in use; what is written there counts as a table of this application."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages restart from the files, whatever executor is lost."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove written tables; what is not there is no error."""
    jvm, have = spark._jvm, _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in have:
            have.remove(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() returned and that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are removed at the end, but for those put into the list that this yields."""
    before = set(_written.get(spark.sparkContext.applicationId, []))
    kept: list[DataFrame] = []
    yield kept
    keep = {getattr(df, "_written_at", None) for df in kept}
    remove(spark, *[p for p in list(_written.get(spark.sparkContext.applicationId, [])) if p not in before and p not in keep])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns.  Names match exactly first, then by letter case; the first of several equal names counts, so extra columns cannot clash."""
    have = df.columns
    at = []
    for name in names:
        exact = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not exact:
            raise ValueError(f"no column {name!r} among {have}")
        at.append(exact[0])
    flat = df.toDF(*[f"c{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of few splits is small, and one task would do all the work. Tables of many splits stay as they are, and so do shuffled ones, whose partitions are adapted at run time."""
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which a counted side may be broadcast: Spark's own threshold (0 where broadcasting is switched off)."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.removesuffix("b")
    try:
        return max(0, int(text[:-1]) * unit[text[-1]] if text[-1] in unit else int(text))
    except ValueError:
        return 10 << 20


def small_or_shuffled(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted rows stay under the session's threshold; otherwise as it is, for a shuffled join that AQE may split."""
    spark = df.sparkSession
    return F.broadcast(df) if df.count() * row_bytes <= broadcast_limit(spark) else df
