"""Tables as Parquet folders with a commit list, shared by batch and streaming jobs.

A run writes its rows to `<table>/run_id=<run>/attempt=<id>` and, when they are complete, adds an empty
marker file to `<table>/_commits`. The marker's name holds everything a reader needs: place in the
order of commits, whether the run replaces the table or adds to it, run and attempt. Readers list that
folder (names only) and read exactly the parts that count, so half-written runs are invisible and old
runs are never scanned. A run that is started again takes its old place in the order and its new
attempt replaces the old one; its readers see the table as it was before the run (`before`).

Streams add a part and a marker with every micro-batch. `compact` gathers what counts into few files by a commit of its
own, and `expire` removes parts and markers that lie behind the newest compaction or replacing run.
"""

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schemas

#: Run ids of compactions begin with this.
COMPACTION = "compaction-"

# application id -> folder, for sessions on one machine without a configured folder
_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints: `spark.checkpoint.dir`.

    Only a session on a single machine may go without the setting and gets one temporary folder; on a
    cluster the executors could not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="holdfast-"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the context a checkpoint folder if it has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))


class Commit(NamedTuple):
    place: int
    mode: str
    run_id: str
    attempt: str


class TableStore:
    """The engine's tables under one base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def commits(self, name: str) -> list[Commit]:
        """The newest attempt of each run, in the order in which the runs were first committed."""
        fs, folder = self._files(f"{self.path(name)}/_commits")
        if not fs.exists(folder):
            return []
        found = sorted(Commit(int(p), m, r, a) for p, m, r, a in (f.getPath().getName().split("~") for f in fs.listStatus(folder)))
        runs: dict[str, Commit] = {}
        for c in found:
            runs[c.run_id] = Commit(runs[c.run_id].place if c.run_id in runs else c.place, c.mode, c.run_id, c.attempt)
        return sorted(runs.values())

    def write(self, name: str, df: DataFrame, run_id: str, mode: str = "replace") -> None:
        """Write a run's rows, which replace the table or are appended to it, and commit them."""
        if mode not in ("replace", "append") or "~" in run_id or "/" in run_id:
            raise ValueError(f"Unknown mode or unusable run id: {mode}, {run_id}")
        self._refuse_gathered(name, run_id)
        attempt = uuid.uuid4().hex
        df.write.parquet(f"{self.path(name)}/run_id={run_id}/attempt={attempt}")
        self._mark(name, mode, run_id, attempt)

    def _refuse_gathered(self, name: str, run_id: str) -> None:
        """A run that a compaction has gathered cannot be repeated: its rows are among those of others."""
        commits = self.commits(name)
        own = [i for i, c in enumerate(commits) if c.run_id == run_id]
        if own and any(c.run_id.startswith(COMPACTION) for c in commits[own[0] + 1 :]):
            raise ValueError(f"Run {run_id} cannot be repeated: a compaction has gathered it.")

    def _mark(self, name: str, mode: str, run_id: str, attempt: str) -> None:
        fs, folder = self._files(f"{self.path(name)}/_commits")
        # one writer per table at a time: jobs are scheduled, not concurrent
        last = max((int(f.getPath().getName().split("~")[0]) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{last + 1:012d}~{mode}~{run_id}~{attempt}"), False).close()

    def compact(self, name: str, file_rows: int = 5_000_000) -> int:
        """Gather the parts that count into few files, as a replacing commit; returns how many parts there were.

        Rows stay as they are. Readers that have listed the older commits are not disturbed: their parts stay until
        `expire`. A table of one part is left alone.
        """
        commits = self.commits(name)
        start = max((i for i, c in enumerate(commits) if c.mode == "replace"), default=0)
        if len(commits) - start < 2:
            return len(commits) - start
        rows = self.snapshot(name)
        files = max(1, -(-rows.count() // file_rows))  # from the files' footers
        run_id, attempt = f"{COMPACTION}{commits[-1].place:012d}", uuid.uuid4().hex
        rows.coalesce(files).write.parquet(f"{self.path(name)}/run_id={run_id}/attempt={attempt}")
        self._mark(name, "replace", run_id, attempt)
        return len(commits) - start

    def expire(self, name: str) -> int:
        """Remove the parts and markers that the table as it is does not need; returns how many parts went.

        What the runs log (`log`) and older states (`before`) are then gone, and readers of older states must be done.
        Attempts that were never committed are left alone: a writer may be at work.
        """
        commits = self.commits(name)
        start = max((i for i, c in enumerate(commits) if c.mode == "replace"), default=0)
        needed = {(c.run_id, c.attempt) for c in commits[start:]}
        fs, folder = self._files(f"{self.path(name)}/_commits")
        gone = 0
        for marker in (fs.listStatus(folder) if commits else []):
            _, _, run_id, attempt = marker.getPath().getName().split("~")
            if (run_id, attempt) not in needed:
                fs.delete(marker.getPath(), False)
                gone += fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/run_id={run_id}/attempt={attempt}"), True)
        return gone

    def exists(self, name: str) -> bool:
        return bool(self.commits(name))

    def _read(self, name: str, commits: list[Commit]) -> DataFrame:
        schema = schemas.TABLES.get(name)
        if not commits:
            if schema is None:
                raise ValueError(f"no table {name} under {self.base}")
            return self.spark.createDataFrame([], schema).withColumn("run_id", F.lit(None).cast("string"))
        reader = self.spark.read.option("basePath", self.path(name))
        if schema is not None:
            reader = reader.schema(T.StructType([*schema.fields, T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())]))
        rows = reader.parquet(*[f"{self.path(name)}/run_id={c.run_id}/attempt={c.attempt}" for c in commits])
        return rows.drop("attempt").withColumn("run_id", F.col("run_id").cast("string"))

    def log(self, name: str) -> DataFrame:
        """Rows of every run; an absent table is empty."""
        return self._read(name, self.commits(name))

    def snapshot(self, name: str, before: str | None = None) -> DataFrame:
        """The table as it is (or was before the run `before`): the newest replacing run and all that were appended after it."""
        commits = self.commits(name)
        if before is not None:
            end = next((i for i, c in enumerate(commits) if c.run_id == before), len(commits))
            commits = commits[:end]
        start = max((i for i, c in enumerate(commits) if c.mode == "replace"), default=0)
        return self._read(name, commits[start:]).drop("run_id")


def load_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, whole or with only the named columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
