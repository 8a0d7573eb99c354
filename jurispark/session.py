"""Session factory and table loading."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "jurispark") -> SparkSession:
    """A session in UTC with adaptive execution; settings given on submit win over these."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only the columns a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, least: int = 0) -> DataFrame:
    """rows dealt out by key to some tasks a core, for work whose cost is in what each row becomes: a small file is read by one task, however much is made of its rows.
    At least `least` tasks; their number is fixed, as otherwise tasks with few bytes to read would be put together again."""
    return rows.repartition(tasks(rows.sparkSession, least), key)


def tasks(spark: SparkSession, least: int = 0) -> int:
    """Some tasks a core, and as many as a shuffle has, or `least`."""
    return max(least, 3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; on one machine, where none is set, a folder of the warehouse."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "stored") -> DataFrame:
    """df computed once and kept as a table in the shared folder, so that later reads survive a lost executor; it goes when the application ends."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Removes a folder when the application ends."""
    system, place = _hadoop(spark, path)
    system.deleteOnExit(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run in it leaves no shuffle files behind, which otherwise stay until the driver happens to collect its garbage; for writes, whose plans nothing else reads."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def version_of(spark: SparkSession, path: str) -> str:
    """What tells whether a table's files have changed: their names, sizes and times, in one digest; "" where there are none."""
    system, place = _hadoop(spark, path)
    if not system.exists(place):
        return ""
    files, found = system.listFiles(place, True), hashlib.sha256()
    lines = []
    while files.hasNext():
        f = files.next()
        lines.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for line in sorted(lines):
        found.update(line.encode())
    return found.hexdigest()


_BUILT: dict[tuple[str, str], tuple[str, str]] = {}


def built_once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of what write(path) makes of a source table, written at the first call of an application, and again when the source's files have changed."""
    key, version = (spark.sparkContext.applicationId, name), version_of(spark, source)
    if _BUILT.get(key, ("", ""))[0] != version:
        path = shared_path(spark, "built")
        write(path)
        remove_at_end(spark, path)
        _BUILT[key] = version, path
    return _BUILT[key][1]


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once a context; needless where it is installed on them or in PYTHONPATH.

    Executors fetch the archive from the driver whenever they start, so it lives as long as the context: the context holds its folder.
    """
    context = spark.sparkContext
    if getattr(context, "_jurispark_shipped", None) or _on_python_path():
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="jurispark-")
    archive = Path(folder.name) / "jurispark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._jurispark_shipped = folder


def _on_python_path() -> bool:
    home = str(Path(__file__).resolve().parents[1])
    return home in os.environ.get("PYTHONPATH", "").split(":")
