"""Running a pipeline over stored tables: a log row for each run, dry runs, and the sources' time of their last run.

A store is a folder with one folder a table and one a version in it. A run writes new versions of the tables that its pipeline gives, and only when all
are written does its log row say success; readers take the newest version of the newest such run, so a run that fails halfway changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id long, pipeline string, started_at timestamp, finished_at timestamp, status string, indexed long, skipped long, errors long, error_sample string, tables array<string>"


@dataclass(frozen=True)
class Pipeline:
    """run takes the store's tables by name and gives (tables to replace, one row of statistics: indexed, skipped, errors, error_sample, or None)."""

    run: Callable[[dict[str, DataFrame]], tuple[dict[str, DataFrame], DataFrame | None]]
    sources: tuple[str, ...] = ()


@dataclass
class Store:
    spark: SparkSession
    path: str
    pipelines: dict[str, Pipeline] = field(default_factory=dict)

    def runs(self) -> DataFrame:
        """The log: the last row of each run; one that was cut off stays `running`."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.path}/_runs")
        except Exception as e:  # a store without runs has no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)
        last = F.max_by(F.struct(*(c for c in rows.columns if c != "run_id")), F.coalesce("finished_at", F.lit(datetime(1970, 1, 1))))
        return rows.groupBy("run_id").agg(last.alias("r")).select("run_id", "r.*")

    def tables(self) -> dict[str, DataFrame]:
        """The newest version of every table, of successful runs only."""
        done = self.runs().where("status = 'success'").select("run_id", F.explode("tables").alias("name")).groupBy("name").agg(F.max("run_id").alias("run_id"))
        return {r["name"]: self.spark.read.parquet(f"{self.path}/{r['name']}/v{r['run_id']}") for r in done.collect()}  # a row a table

    def _log(self, run_id: int, name: str, started: datetime, status: str, finished: datetime | None = None, stats: dict | None = None, tables: list[str] | None = None) -> None:
        s = {"indexed": 0, "skipped": 0, "errors": 0, "error_sample": None} | (stats or {})
        row = (run_id, name, started, finished, status, s["indexed"], s["skipped"], s["errors"], s["error_sample"], tables or [])
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/_runs")

    def seed(self, tables: dict[str, DataFrame]) -> None:
        """The first version of tables, as a run named seed."""
        self.pipelines = {"seed": Pipeline(lambda _: (tables, None))} | self.pipelines
        self.run("seed")

    def run(self, name: str, dry_run: bool = False) -> dict[str, DataFrame]:
        """Runs a pipeline and gives the tables it replaces; a dry run writes neither tables nor log. KeyError for an unknown name."""
        if name not in self.pipelines:
            raise KeyError(f"unknown pipeline {name}, known are {', '.join(sorted(self.pipelines))}")
        pipeline = self.pipelines[name]
        if dry_run:
            return pipeline.run(self.tables())[0]
        now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
        run_id, started = (self.runs().agg(F.max("run_id")).first()[0] or 0) + 1, now()
        self._log(run_id, name, started, "running")
        try:
            replaced, stats = pipeline.run(self.tables())
            for table, rows in replaced.items():
                rows.write.mode("overwrite").parquet(f"{self.path}/{table}/v{run_id}")
            found = stats.first().asDict() if stats is not None else {}
        except Exception as e:
            self._log(run_id, name, started, "failed", now(), {"errors": 1, "error_sample": str(e)[:500]})
            raise
        self._log(run_id, name, started, "success", now(), {k: v for k, v in found.items() if k in ("indexed", "skipped", "errors", "error_sample")}, list(replaced))
        return self.tables()

    def source_stamps(self) -> DataFrame:
        """(source, last_ingested_at) of the sources that a successful run was for."""
        own = [(name, s) for name, p in self.pipelines.items() for s in p.sources]
        of = self.spark.createDataFrame(own, "pipeline string, source string")
        return self.runs().where("status = 'success'").join(of, "pipeline").groupBy("source").agg(F.max("finished_at").alias("last_ingested_at"))

    def ingestion_status(self, sources: DataFrame, documents: DataFrame, most: int = 5) -> DataFrame:
        """Each source (source, name, ...) with its documents, its last run's time and its last runs, the newest first."""
        own = [(name, s) for name, p in self.pipelines.items() for s in p.sources]
        of = self.spark.createDataFrame(own, "pipeline string, source string")
        rows = self.runs().join(of, "pipeline").groupBy("source").agg(F.slice(F.sort_array(F.collect_list(F.struct("run_id", "pipeline", "started_at", "status", "indexed", "errors")), asc=False), 1, most).alias("recent_runs"))
        counts = documents.groupBy("source").agg(F.count("*").alias("documents"))
        out = sources.join(counts, "source", "left").join(self.source_stamps(), "source", "left").join(rows, "source", "left")
        return out.withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long")).orderBy("name", "source")
