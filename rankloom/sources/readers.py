"""Sources and sinks: survey exports, delimited files, a store of named sheets, and resumable batches."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.tables import checkpoint_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_survey(spark: SparkSession, path: str, sample: str, schema: str) -> DataFrame:
    """Questionnaire export: quoted multi-line CSV, of which only answers (status ``IP Address``) are kept, tagged with the sample.

    Leading description rows have another status, so they go by value and not by place. Answers hold line feeds, so a file is read by
    one task: export large surveys in several files.
    """
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return rows.where(F.col("Status") == "IP Address").withColumn("sample", F.lit(sample))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8", partitions: int | None = None) -> DataFrame:
    """Delimited text with a stated schema. Gzip files cannot be split; ``partitions`` spreads them after the read."""
    rows = spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding)
    return rows.repartition(partitions) if partitions else rows


def read_all_text(spark: SparkSession, path: str) -> DataFrame:
    """A sheet exported as CSV, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


class SheetStore:
    """Named result tables, one dataset per sheet, partitioned by run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @staticmethod
    def file_name(name: str) -> str:
        return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", name.strip().lower()))

    def write(self, name: str, run: str, df: DataFrame) -> None:
        """Replaces one run of a sheet."""
        df.write.mode("overwrite").parquet(f"{self.root}/{self.file_name(name)}/run={run}")

    def sheets(self) -> list[str]:
        """Names of the sheets that are there, in order."""
        if not exists(self.spark, self.root):
            return []
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(place)
        return sorted(f.getPath().getName() for f in files if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))

    def read(self, name: str) -> DataFrame:
        """All runs of a sheet; fails if there is none."""
        return self.spark.read.parquet(f"{self.root}/{self.file_name(name)}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


class BatchStore:
    """A pull in batches of keys that can be resumed: finished batches are kept, and the last row per key counts.

    Rows lie in ``data/batch=<name>``, and each attempt at a batch leaves one row in ``manifest``: when it began, whether it finished, its rows or its error. A batch counts once it is in
    the manifest as finished; what a lost or failed attempt has written is replaced by the next one.
    """

    ATTEMPT = "batch string, attempt int, began timestamp, finished boolean, rows long, error string"

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root, list(keys)
        self.data, self.log = f"{root}/data", f"{root}/manifest"

    def manifest(self) -> DataFrame:
        """All attempts so far; none before the first start."""
        if exists(self.spark, self.log):
            return self.spark.read.schema(self.ATTEMPT).parquet(self.log)
        return self.spark.createDataFrame([], self.ATTEMPT)

    def finished(self) -> set[str]:
        return {r["batch"] for r in self.manifest().where("finished").select("batch").distinct().collect()}

    def pull(self, batches: Sequence[str], read: Callable[[str], DataFrame], attempts: int = 3) -> list[str]:
        """Reads and writes the batches that are not finished, each up to ``attempts`` times in this call; returns those pulled now.

        A batch that fails does not keep the others from being pulled; the last error is raised at the end.
        """
        done, tried = self.finished(), {r["batch"]: r["n"] for r in self.manifest().groupBy("batch").agg(F.max("attempt").alias("n")).collect()}
        pulled, failure = [], None
        for batch in (b for b in batches if b not in done):
            for _ in range(attempts):
                tried[batch] = tried.get(batch, 0) + 1
                began = datetime.datetime.now(datetime.UTC)
                try:
                    read(batch).write.mode("overwrite").parquet(f"{self.data}/batch={batch}")
                    rows = self.spark.read.parquet(f"{self.data}/batch={batch}").count()
                except Exception as error:  # whatever the source raises: the attempt is noted and tried again
                    failure = error
                    self._note(batch, tried[batch], began, False, None, str(error)[:1000])
                else:
                    self._note(batch, tried[batch], began, True, rows, None)
                    pulled.append(batch)
                    break
        missing = set(batches) - done - set(pulled)
        if missing:
            raise RuntimeError(f"batches without a finished attempt: {sorted(missing)}") from failure
        return pulled

    def _note(self, batch: str, attempt: int, began: datetime.datetime, finished: bool, rows: int | None, error: str | None) -> None:
        self.spark.createDataFrame([(batch, attempt, began, finished, rows, error)], self.ATTEMPT).coalesce(1).write.mode("append").parquet(self.log)

    def rows(self) -> DataFrame | None:
        """Rows of all finished batches."""
        done = sorted(self.finished())
        if not done:
            return None
        return self.spark.read.option("basePath", self.data).parquet(*[f"{self.data}/batch={b}" for b in done]).withColumn("batch", F.col("batch").cast("string"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted keys that no finished batch has: all of them before the first start."""
        rows = self.rows()
        return wanted if rows is None else wanted.join(rows.select(*self.keys).distinct(), self.keys, "left_anti")

    def latest(self, order: str) -> DataFrame:
        """The last row of each key over all finished batches."""
        rows = self.rows()
        if rows is None:
            raise FileNotFoundError(f"no finished batch in {self.root}")
        w = W.partitionBy(*self.keys).orderBy(F.col(order).desc())
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
