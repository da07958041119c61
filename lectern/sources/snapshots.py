"""Tables that change together: a snapshot names the folders of every table, and one small file makes it current.

A change writes its folders first and then commits the next version, so readers see all of it or
nothing; older versions stay readable until their folders are deleted. Of two writers that start
from one version, one commits and the other gets ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.shared import exists


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Snapshot:
    """``tables``: folders by table, oldest first. ``facts``: small numbers and names that go with them."""

    version: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def folders(self, table: str) -> list[str]:
        return self.tables.get(table, [])

    def added(self, facts: dict, **folders: str) -> Snapshot:
        """The next version, with one folder more for each table named."""
        return Snapshot(self.version + 1, self.tables | {t: [*self.folders(t), f] for t, f in folders.items()}, self.facts | facts)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, f"{path}/versions"):
        return []
    hadoop, files = _file_system(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in files.listStatus(hadoop)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """A version, or the current one; before the first commit an empty one."""
    known = versions(spark, path)
    if version is None:
        if not known:
            return Snapshot()
        version = known[-1]
    if version not in known:
        raise ValueError(f"no version {version}")
    text = spark.read.text(f"{path}/versions/{version:012}.json", wholetext=True).first()[0]
    return Snapshot(**json.loads(text))


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> Snapshot:
    """Make ``snapshot`` current: it is written aside and renamed, which succeeds once."""
    target, files = _file_system(spark, f"{path}/versions/{snapshot.version:012}.json")
    aside, _ = _file_system(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = files.create(aside)
    out.write(bytearray(json.dumps(snapshot.__dict__).encode()))
    out.close()
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        raise Conflict(f"version {snapshot.version} is committed already")
    return snapshot


def new_folder(path: str, table: str) -> str:
    return f"{path}/{table}/part=p{uuid.uuid4().hex}"


def table(spark: SparkSession, path: str, snapshot: Snapshot, name: str, schema: str | None = None) -> DataFrame | None:
    """The rows of all folders of a table, or None where it has none yet."""
    folders = snapshot.folders(name)
    if not folders:
        return None
    reader = spark.read.option("basePath", f"{path}/{name}")
    return (reader.schema(schema) if schema else reader).parquet(*folders).drop("part")
