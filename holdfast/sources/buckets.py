"""Tables in hash buckets of a key, updated by copy-on-write.

An upsert reads and writes only the buckets that its keys fall into: rescoring one customer in a hundred thousand
touches one bucket, whatever the table's size. Each commit is one small file that lists, for every bucket, the folder
whose files count; a reader opens the newest one and no others. Folders are never changed, so readers of an older
commit keep seeing it until `expire` removes what no kept commit lists.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.plans.kept import kept

_BUCKET = "_bucket"


class BucketTable:
    """One table under `path`, with one row per key, in `buckets` hash buckets (fixed when the table is first written)."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        found = self._commits()
        self.buckets = self._state(found[-1])["buckets"] if found else buckets

    # --- commits -----------------------------------------------------------------

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _commits(self) -> list[tuple[int, str, str]]:
        """(place, run, file name) of all commits in order."""
        fs, folder = self._fs(f"{self.path}/_state")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted((int(n.split("~")[0]), n.split("~")[1], n) for n in names if not n.startswith("_"))

    def _state(self, commit: tuple[int, str, str]) -> dict:
        fs, file = self._fs(f"{self.path}/_state/{commit[2]}")
        stream = fs.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _before(self, run_id: str) -> tuple[int, dict | None]:
        """The place of a run and the state that it starts from. A run may be repeated as long as none came after it."""
        found = self._commits()
        own = [i for i, c in enumerate(found) if c[1] == run_id]
        if own and found[-1][1] != run_id:
            raise ValueError(f"Run {run_id} cannot be repeated: later runs were built on it.")
        earlier = [c for c in found if c[1] != run_id]
        place = found[own[0]][0] if own else (found[-1][0] + 1 if found else 1)
        return place, self._state(earlier[-1]) if earlier else None

    def _commit(self, place: int, run_id: str, schema: T.StructType, files: dict[int, str]) -> None:
        text = json.dumps({"buckets": self.buckets, "key": self.key, "schema": schema.jsonValue(), "files": {str(b): f for b, f in sorted(files.items())}})
        fs, hidden = self._fs(f"{self.path}/_state/_{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # complete before it is seen; of two attempts of a run the later name counts
        tries = sum(1 for c in self._commits() if c[1] == run_id)
        fs.rename(hidden, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_state/{place:012d}~{run_id}~{tries:06d}"))

    # --- reading -----------------------------------------------------------------

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict | None, wanted: set[int] | None = None) -> DataFrame:
        if state is None:
            raise ValueError(f"no table at {self.path}")
        schema = T.StructType.fromJson(state["schema"])
        folders = [f"{self.path}/{f}" for b, f in state["files"].items() if wanted is None or int(b) in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def snapshot(self, before: str | None = None) -> DataFrame:
        """The table as it is, or was before the run `before`."""
        if before is not None:
            first = min((c[0] for c in self._commits() if c[1] == before), default=1 << 62)
            earlier = [c for c in self._commits() if c[0] < first]
            return self._read(self._state(earlier[-1]) if earlier else None)
        found = self._commits()
        return self._read(self._state(found[-1]) if found else None)

    def lookup(self, *keys) -> DataFrame:
        """The rows of a few keys, from their buckets alone."""
        found = self._commits()
        state = self._state(found[-1]) if found else None
        kind = T.StructType.fromJson(state["schema"])[self.key].dataType if state else T.StringType()
        wanted = {r[0] for r in self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)])).select(self.bucket(F.col("k"))).collect()}
        return self._read(state, wanted).where(F.col(self.key).isin(*keys))

    # --- writing -----------------------------------------------------------------

    def _store(self, rows: DataFrame, run_id: str) -> tuple[dict[int, str], set[int]]:
        """Write rows (with their bucket) and list the folders of the buckets that have any."""
        folder = f"run_id={run_id}/attempt={uuid.uuid4().hex}"
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        fs, at = self._fs(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        written = {int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")}
        return {b: f"{folder}/{_BUCKET}={b}" for b in written}, written

    def replace(self, rows: DataFrame, run_id: str) -> None:
        """Write the whole table anew. `rows` holds one row per key, no key being null."""
        place, _ = self._before(run_id)
        files, _ = self._store(rows.withColumn(_BUCKET, self.bucket(F.col(self.key))), run_id)
        self._commit(place, run_id, rows.schema, files)

    def upsert(self, changes: DataFrame, run_id: str) -> DataFrame:
        """Put in the changed rows (one per key) in place of those of the same keys; returns the rows that went.

        The changes are computed once. Only the buckets of their keys are read and written, joined bucket by bucket.
        """
        place, state = self._before(run_id)
        if state is None:
            self.replace(changes, run_id)
            return changes.limit(0)
        schema = T.StructType.fromJson(state["schema"])
        own = kept(changes.select(*schema.fieldNames()).withColumn(_BUCKET, self.bucket(F.col(self.key))))
        touched = {r[0] for r in own.select(_BUCKET).distinct().collect()}  # at most `buckets` numbers
        old = self._read(state, touched).withColumn(_BUCKET, self.bucket(F.col(self.key)))
        on = [_BUCKET, self.key]
        stays = old.join(own.select(*on), on, "left_anti").select(*schema.fieldNames(), _BUCKET)
        files, _ = self._store(stays.unionByName(own), run_id)
        self._commit(place, run_id, schema, {int(b): f for b, f in state["files"].items() if int(b) not in touched} | files)
        return old.join(own.select(*on), on, "left_semi").select(*schema.fieldNames())

    def expire(self, keep: int = 5) -> int:
        """Remove old commits but the newest `keep`, and the attempts that none of these lists; returns how many attempts went."""
        found = self._commits()
        fs, _ = self._fs(self.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        listed = {f.rsplit("/", 1)[0] for c in found[-keep:] for f in self._state(c)["files"].values()}
        for _, _, name in found[:-keep]:
            fs.delete(path(f"{self.path}/_state/{name}"), False)
        gone = 0
        for run in fs.globStatus(path(f"{self.path}/run_id=*/attempt=*")) or []:
            name = "/".join(run.getPath().toString().split("/")[-2:])
            if name not in listed:
                fs.delete(run.getPath(), True)
                gone += 1
        return gone
