"""Session helpers: sessions for tests and benches, shared storage, lineage cuts, code shipping.

Anything written between two stages goes to the folder that the cluster names in
``spark.checkpoint.dir``; only a session without that setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def local_session(cores: str = "8", partitions: int = 8, app: str = "lectern") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash.

    A place without a scheme is one of Hadoop's default file system. Without the setting, only a local session gets a
    folder of this machine: executors elsewhere would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        return _own_dirs[context.applicationId]
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, plan_chars: int | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files survive lost executors, and a later reader may prune columns. ``plan_chars`` bounds the text of the plan that
    the driver keeps, for plans with a large constant. ``settings`` of the session hold while ``df`` is written.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    wanted = {SHUFFLE_CLEANUP: "true"} | (settings or {})  # the table is what later steps read
    if plan_chars is not None:
        wanted["spark.sql.maxPlanStringLength"] = str(plan_chars)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.lectern_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.lectern_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that functions pickled by reference resolve there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lectern-zip-")) / "lectern_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
