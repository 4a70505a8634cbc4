"""Durable state: versioned Parquet tables behind numbered manifests.

A run writes new versions of the tables that change and then the next manifest, so either all of them are visible or none. A
manifest is never replaced: the newest one counts, so a reader always finds one, and of two writers with the same number
one fails. A table is one or more parts; a run that only adds rows adds a part. Paths go through Hadoop's file system API,
so a store on any file system that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import STATE

#: Parts of a table that are read as they are; with more, the next run writes it anew as one.
PARTS = 64
#: A lock older than this was left by a run that died.
LOCK_AGE = timedelta(hours=6)


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Write beside the name, then move there; FileExistsError if the name is taken."""
        new, path = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(path.getParent())
        if self._fs.exists(path) or not self._fs.rename(new, path):
            self._fs.delete(new, False)
            raise FileExistsError(f"{path} is there")

    def _newest(self) -> int:
        """The number of the newest manifest, 0 if there is none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self) -> dict:
        number = self._newest()
        return json.loads(self._text(f"manifests/{number:010}.json") or "") if number else {"run_id": None, "tables": {}}

    def _publish(self, run_id: str | None, tables: dict[str, list[str]], after: int) -> None:
        self._put(f"manifests/{after + 1:010}.json", json.dumps({"run_id": run_id, "tables": tables}, sort_keys=True))

    def _parts(self, table: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STATE[table])
        return self.spark.read.schema(STATE[table]).parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def read(self, table: str) -> DataFrame:
        """A table of the current version; columns that an older version lacks are null."""
        return self._parts(table, self.manifest()["tables"].get(table, []))

    def commit(self, run_id: str, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Write all tables, whole or (in append) the rows that are new, then make them visible together."""
        number, now = self._newest(), self.manifest()
        parts = {k: list(v) for k, v in now["tables"].items()}
        for name, df in {**tables, **(append or {})}.items():
            before = parts.get(name, []) if name in (append or {}) else []
            if len(before) >= PARTS:
                df, before = self._parts(name, before).unionByName(df.select(*_columns(name))), []
            version = f"v={run_id}-{uuid.uuid4().hex[:8]}"
            df.select(*_columns(name)).write.option("compression", "zstd").parquet(f"{self.root}/{name}/{version}")
            parts[name] = [*before, version]
        self._publish(run_id, parts, number)

    def stage(self, run_id: str, name: str, df: DataFrame) -> DataFrame:
        """Write an intermediate table of a run beside the state and read it back: computed once, and safe from lost executors."""
        path = f"{self.root}/runs-staged/{run_id}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bootstrap(self, source: str, now: datetime, max_age: timedelta = timedelta(hours=72)) -> str:
        """Take over a backup into an empty store if its newest run is recent: "restored", "present", "missing", "damaged" or "stale".

        A stale or damaged backup leaves the store empty; state that is there is never touched.
        """
        if self._newest():
            return "present"
        other = StateStore(self.spark, source)
        if not other._text("MANIFEST"):
            return "missing"
        try:
            newest = other.read("runs").agg({"started_at": "max"}).first()[0]
            if newest is None or now - newest > max_age:
                return "stale"
            self.restore(source)
        except (OSError, ValueError):
            return "damaged"
        return "restored"

    def lock(self, owner: str = "") -> Lock:
        return Lock(self, owner)

    def _sums(self, table: str) -> dict:
        """Rows of a table and a sum over hashes of their content, in any order."""
        r = self.read(table).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*_columns(table)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content")).first()
        return {"rows": r["rows"], "content": r["content"]}

    def _copy(self, other: StateStore, tables: list[str]) -> dict[str, list[str]]:
        for t in tables:
            other.read(t).write.option("compression", "zstd").parquet(f"{self.root}/{t}/copied")
        return {t: ["copied"] for t in tables}

    def backup(self, target: str, skip: tuple[str, ...] = ("raw_pages",)) -> dict:
        """Copy the current tables (but those in skip), compressed, and a manifest with their rows and content sums; never over an existing backup."""
        other = StateStore(self.spark, target)
        if other._text("MANIFEST"):
            raise FileExistsError(target)
        now = self.manifest()
        tables = sorted(t for t in now["tables"] if t not in skip)
        other._publish(now["run_id"], other._copy(self, tables), other._newest())
        sums = {t: self._sums(t) for t in tables}
        if sums != (copied := {t: other._sums(t) for t in tables}):
            raise OSError(f"backup differs: {sums} and {copied}")
        body = {"run_id": now["run_id"], "tables": sums, "rows": {t: v["rows"] for t, v in sums.items()}}
        body["sha256"] = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        other._put("MANIFEST", json.dumps(body, sort_keys=True))
        return body

    def restore(self, source: str) -> None:
        """Take over a backup whose manifest and content are as they were written, into an empty store."""
        if self._newest():
            raise FileExistsError(f"{self.root} has state; a restore never overwrites it")
        other = StateStore(self.spark, source)
        body = json.loads(other._text("MANIFEST") or "{}")
        claimed = body.pop("sha256", None)
        if claimed != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
            raise OSError("the backup's manifest is damaged")
        for t, sums in body["tables"].items():
            if other._sums(t) != sums:
                raise OSError(f"the backup's {t} is damaged")
        self._publish(body["run_id"], self._copy(other, sorted(body["tables"])), 0)


def _columns(table: str) -> list[str]:
    return [part.split()[0] for part in STATE[table].split(", ")]


def newest_backup(backups: DataFrame, reports: DataFrame) -> DataFrame:
    """backups (run_id, at, path) that may be restored: the newest, unless a report (run_id, at) newer than it has no backup."""
    newest = backups.agg(F.max("at").alias("newest"))
    lost = reports.join(backups.select("run_id"), "run_id", "left_anti").agg(F.max("at").alias("lost"))
    b, r = newest.first()["newest"], lost.first()["lost"]
    if b is None or r is not None and r > b:
        return backups.limit(0)
    return backups.where(F.col("at") == F.lit(b)).orderBy("run_id").limit(1)


class Lock:
    """One run at a time: a file that must not exist yet, with its owner and time. One older than LOCK_AGE is taken over."""

    def __init__(self, store: StateStore, owner: str = ""):
        self.store, self.path, self.owner = store, store._path(f"{store.root}/LOCK"), owner or uuid.uuid4().hex

    def _create(self) -> bool:
        """Hadoop's create without overwriting fails if the file is there."""
        fs = self.store._fs
        if not fs.createNewFile(self.path):
            return False
        stream = fs.create(self.path, True)
        try:
            stream.write(bytearray(json.dumps({"owner": self.owner, "at": datetime.now(timezone.utc).isoformat()}).encode()))
        finally:
            stream.close()
        return True

    def __enter__(self) -> Lock:
        if self._create():
            return self
        fs = self.store._fs
        try:
            since = datetime.fromtimestamp(fs.getFileStatus(self.path).getModificationTime() / 1000, timezone.utc)
        except Exception as gone:  # released between the two calls
            raise RuntimeError("another run held this state; try again") from gone
        if datetime.now(timezone.utc) - since < LOCK_AGE:
            raise RuntimeError(f"another run holds this state: {self.store._text('LOCK')}")
        # Only one of several can move the old lock away.
        if not fs.rename(self.path, self.store._path(f"{self.store.root}/.lock-{uuid.uuid4().hex}")) or not self._create():
            raise RuntimeError("another run has just taken this state over")
        return self

    def __exit__(self, *_) -> None:
        text = self.store._text("LOCK")
        if text is not None and json.loads(text or "{}").get("owner") == self.owner:
            self.store._fs.delete(self.path, False)
