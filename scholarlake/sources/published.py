"""Published builds: tables written beside one another, and a log of states that says which one readers use.

A state is a small JSON document. The next version of a log is a file that is created only if it is not there yet, so
of two writers that read the same version one wins and the other is told: compare and swap, without a lock. A writer
that is lost leaves a build that no state names.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Somebody else has written the version that this writer wanted to write."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a session without other machines gets a temporary one, and a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholarlake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once below the shared folder, for what is read more than once."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, lengths and times of a table's files: another one, if the table is written anew."""
    fs, where = _path(spark, path)
    files, found = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


class Log:
    """The versions of one name below a folder."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.folder = spark, f"{root.rstrip('/')}/{name}", f"{root.rstrip('/')}/{name}/_log"

    def versions(self) -> list[int]:
        fs, where = _path(self.spark, self.folder)
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def state(self, version: int | None = None) -> dict | None:
        """The state of a version, or of the last one; None if there is none."""
        found = self.versions()
        if not found:
            return None
        fs, where = _path(self.spark, f"{self.folder}/{(version or found[-1]):012d}.json")
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version or found[-1]}

    def commit(self, state: dict, after: int) -> int:
        """Writes the version that comes after `after` (0: the first); Conflict if it is there already."""
        fs, where = _path(self.spark, f"{self.folder}/{after + 1:012d}.json")
        # the whole text is in place before the name is: a reader never sees half a state
        _, draft = _path(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(where) or not self._placed(draft, where):
            fs.delete(draft, False)
            raise Conflict(f"{self.folder} already has version {after + 1}")
        return after + 1

    def _placed(self, draft, where) -> bool:
        """A rename that does not overwrite: the file system's own, where two of them cannot both succeed."""
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, where, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def publish(self, write: Callable[[str], dict], layout: int, check: Callable[[str, dict], str | None] | None = None) -> dict:
        """Writes a build to a new folder, checks it, and only then makes it the active one.

        `write` gets the folder and gives what the state is to hold; `check` gives what is wrong, if anything. If another
        build was published meanwhile, this one follows it. A build that fails its check stays unpublished.
        """
        folder = f"{self.root}/build-{uuid.uuid4().hex}"
        state = write(folder) | {"folder": folder, "layout": layout}
        if check and (wrong := check(folder, state)):
            raise ValueError(f"{folder}: {wrong}")
        while True:
            try:
                return state | {"version": self.commit(state, (self.versions() or [0])[-1])}
            except Conflict:
                continue

    def active(self, layout: int) -> dict | None:
        """The state that readers use; an error if its layout is another one, None if nothing is published."""
        found = self.state()
        if found and found.get("layout") != layout:
            raise ValueError(f"{self.root} has layout {found.get('layout')}, not {layout}")
        return found

    def retired(self) -> list[dict]:
        """The states of builds that were published before the active one."""
        return [self.state(v) for v in self.versions()[:-1]]
