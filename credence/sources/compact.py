"""Compaction of landed days: many small files become few, beside a sink that goes on writing.

Compacted files lie in a folder that readers of the landing zone do not see, ``_compact/data/<run>/dt=...``. A manifest, one file per
version, says per day which compacted files are live and which landed files they replace. It is written last and
under a name that must not exist yet, so that a compaction is visible as a whole or not at all, and of two at the same
time one fails. A reader takes the newest manifest, all landed files that it does not replace, and its compacted files:
before, during and after, every record once. Nothing is deleted; compacted files are compressed, and their sizes are those of their lines.
"""

from __future__ import annotations

import json
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credence.sources.files import LANDED, json_lines, or_empty

FILE_BYTES = 128 * 1024 * 1024


class Files:
    """The file system of a path, through Spark's own client."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def size(self, p: str) -> int:
        """Bytes of a file's lines; a compressed file tells them at its end."""
        size = self.fs.getFileStatus(self.path(p)).getLen()
        if not p.endswith(".gz"):
            return size
        end = self.fs.open(self.path(p))
        try:
            end.seek(size - 4)
            return sum(end.read() << 8 * i for i in range(4))
        finally:
            end.close()

    def create(self, p: str, text: str) -> None:
        """A new file; an error if it is there already."""
        out = self.fs.create(self.path(p), False)
        out.write(bytearray(text.encode()))
        out.close()


def _manifest_name(version: int) -> str:
    return f"{version:012d}.json"


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, dict[str, list[str]]]]:
    """(version, {day: {"live": compacted files, "replaced": landed files}}); version 0 and nothing before the first run."""
    folder = f"{root}/_compact/manifest"
    names = Files(spark, root).names(folder)
    if not names:
        return 0, {}
    text = spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()["value"]
    return int(names[-1].split(".")[0]), json.loads(text)


def landed_files(spark: SparkSession, root: str, day: str | None = None) -> list[str]:
    """Landed files that the sink has committed."""
    def read() -> DataFrame:
        return json_lines(spark, LANDED).json(root)
    rows = or_empty(spark, read, LANDED)
    return sorted((rows if day is None else rows.where(F.col("dt") == date.fromisoformat(day))).inputFiles())


def _of_day(path: str, day: str) -> bool:
    return f"/dt={day}/" in path


def compact(spark: SparkSession, root: str, day: str, file_bytes: int = FILE_BYTES) -> int | None:
    """Rewrites what landed on ``day`` (yyyy-mm-dd) since the last compaction, with the files that it made; the new version.

    None if there is nothing to do: fewer than two files. ``day`` may be today: later files wait for another run.
    """
    version, known = manifest(spark, root)
    entry = known.get(day, {"live": [], "replaced": []})
    fresh = [p for p in landed_files(spark, root, day) if _of_day(p, day) and p not in set(entry["replaced"])]
    if not fresh or len(fresh) + len(entry["live"]) < 2:
        return None
    files = Files(spark, root)
    sizes = [sum(files.size(p) for p in paths) for paths in (fresh, entry["live"])]
    count = max(1, -(-sum(sizes) // file_bytes))
    run = f"{root}/_compact/data/{version + 1:012d}-{spark.sparkContext.applicationId}"
    if count > 1 and entry["live"]:         # by themselves, as their parts are larger
        old = min(max(1, round(count * sizes[1] / sum(sizes))), count - 1)
        rows = _packed(_read(spark, root, fresh, [], LANDED), count - old).unionByName(_packed(_read(spark, root, [], entry["live"], LANDED), old))
    else:
        rows = _packed(_read(spark, root, fresh, entry["live"], LANDED), count)
    rows.write.mode("overwrite").partitionBy("dt").json(run, compression="gzip")
    live = [f"{run}/dt={day}/{n}" for n in files.names(f"{run}/dt={day}") if not n.startswith(("_", "."))]
    known = {**known, day: {"live": live, "replaced": [*entry["replaced"], *fresh]}}
    files.create(f"{root}/_compact/manifest/{_manifest_name(version + 1)}", json.dumps(known, indent=1))
    return version + 1


def _packed(rows: DataFrame, files: int) -> DataFrame:
    """Rows for so many files: whole parts of files go together, and rows are shuffled only where the parts are too few."""
    return rows.coalesce(files) if rows.rdd.getNumPartitions() >= files else rows.repartition(files)


def scattered_days(spark: SparkSession, paths: list[str], file_bytes: int | None = None) -> list[str]:
    """Days (dt=...) that hold more files than their bytes need: one per ``file_bytes`` begun."""
    files, file_bytes = Files(spark, paths[0]) if paths else None, file_bytes or FILE_BYTES
    days: dict[str, list[int]] = {}
    for p in paths:
        days.setdefault(p.rsplit("/", 2)[1], []).append(files.size(p))
    return sorted(day for day, sizes in days.items() if len(sizes) > max(1, -(-sum(sizes) // file_bytes)))


def _read(spark: SparkSession, root: str, landed: list[str], live: list[str], schema: StructType) -> DataFrame:
    parts = []
    if landed:
        parts.append(json_lines(spark, schema).option("basePath", root).json(landed))
    runs: dict[str, list[str]] = {}
    for p in live:
        runs.setdefault(p.split("/dt=")[0], []).append(p)
    for base, paths in runs.items():
        parts.append(json_lines(spark, schema).option("basePath", base).json(paths))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_live(spark: SparkSession, root: str, schema: StructType = LANDED) -> DataFrame:
    """Every landed record once, from compacted files where there are any. The files are fixed when this is called."""
    # The manifest first: files that it replaces are left out even if it is older than the listing that follows.
    _, known = manifest(spark, root)
    replaced = {p for e in known.values() for p in e["replaced"]}
    landed = [p for p in landed_files(spark, root) if p not in replaced]
    return _read(spark, root, landed, [p for e in known.values() for p in e["live"]], schema)
