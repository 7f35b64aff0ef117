"""Pair outputs as a sequence of commits: staged, published at once, with where they come from.

A table is a folder with `data/<commit>/`, written by one attempt each, and `log/<version>.json`,
one small file for each commit. A writer stages its rows in a folder of its own, then puts the next file into the log, which
fails if another writer has put it there first; then it drops the rows whose keys the other has
written and tries again. Readers take only folders that the log names. So a run that is killed
half-way leaves nothing that is read, a repeated run writes only what is missing, and of two writers
each key is kept from the one that published first. Files are moved by Hadoop's file contexts, on any
store with a rename that fails where the target exists.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echofold import __version__
from echofold.streaming.incremental import KEYS

#: Columns that tell where a row comes from.
PROVENANCE = ["input_build", "code_version", "options", "version"]


class _Log:
    """The published versions of a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{path}/log")
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri() if self.folder.toUri().getScheme() else self.jvm.java.net.URI("file:///"),
                                                                             spark.sparkContext._jsc.hadoopConfiguration())
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def entries(self) -> list[dict]:
        """All commits in order; a commit is a few hundred bytes."""
        if not self.fs.exists(self.folder):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.folder) if s.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            stream = self.fs.open(self._at(name))
            try:
                out.append(json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            finally:
                stream.close()
        return out

    def publish(self, entry: dict) -> bool:
        """Put the entry into the log under its version; False if that version is taken."""
        temp = self._at(f"_{uuid.uuid4().hex}")
        self.fs.mkdirs(self.folder)
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self.files.rename(self.files.makeQualified(temp), self.files.makeQualified(self._at(f"{entry['version']:020d}.json")), self.gateway.new_array(rename, 0))
        except Exception as e:
            self.fs.delete(temp, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True


def _of(spark: SparkSession, path: str, entries: list[dict]) -> DataFrame | None:
    """The rows of some commits."""
    out = None
    for e in entries:
        schema = StructType.fromJson(json.loads(e["schema"]))
        d = spark.read.schema(schema).option("basePath", f"{path}/data/{e['folder']}").parquet(f"{path}/data/{e['folder']}").withColumn("version", F.lit(e["version"]).cast("long"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_commits(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """All published rows with PROVENANCE, up to `version` if given; None where nothing is published."""
    return _of(spark, path, [e for e in _Log(spark, path).entries() if version is None or e["version"] <= version])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The log: version, folder, rows, written_at, input_build, code_version, options."""
    rows = [(e["version"], e["folder"], e["rows"], e["written_at"], e["input_build"], e["code_version"], json.dumps(e["options"], sort_keys=True)) for e in _Log(spark, path).entries()]
    return spark.createDataFrame(rows, "version long, folder string, rows long, written_at string, input_build string, code_version string, options string")


def write_pairs(df: DataFrame, path: str, input_build: str, options: dict | None = None, keys: list[str] | None = None, partition_by: list[str] | None = None,
                code_version: str = __version__) -> int | None:
    """Publish the rows of `df` whose keys are not in the table yet; the version, or None if nothing was missing.

    Rows carry the build of the input, the version of the code and the options they were made with.
    A key may have several rows; they come from one commit. Rows are spread by the whole key, so a
    large line is written by many tasks. NULL keys equal NULL.
    """
    spark, keys, log = df.sparkSession, keys or KEYS, _Log(df.sparkSession, path)
    said = json.dumps(options or {}, sort_keys=True)
    seen = log.entries()
    todo = _not_in(df, _of(spark, path, seen), keys)
    todo = todo.withColumn("input_build", F.lit(input_build)).withColumn("code_version", F.lit(code_version)).withColumn("options", F.lit(said))
    while True:
        folder = uuid.uuid4().hex
        at = f"{path}/data/{folder}"
        writer = todo.repartition(*keys).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(at)
        held = spark.read.schema(todo.schema).option("basePath", at).parquet(at)
        rows = held.count()
        while rows:
            entry = {"version": len(seen), "folder": folder, "rows": rows, "schema": todo.schema.json(), "written_at": datetime.now(UTC).isoformat(),
                     "input_build": input_build, "code_version": code_version, "options": options or {}}
            if log.publish(entry):
                return entry["version"]
            new = log.entries()[len(seen):]
            seen += new
            left = _not_in(held, _of(spark, path, new), keys)
            if left.count() != rows:          # the other writer had some of our keys: stage what is left
                break
        else:
            return None
        todo = left


def _not_in(df: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    if done is None:
        return df
    there = done.select(*[F.col(c).alias(f"_d_{c}") for c in keys]).distinct()
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return df.join(there, on, "left_anti")
