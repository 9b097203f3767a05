"""Resumable jobs: stages stored under a name that their inputs decide."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources.storage import shared_folder


def input_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of a folder's Parquet files; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select("path", "length", "modificationTime")


class StagedRun:
    """Stages below one folder per state of the inputs and version of the settings.

    A stage is written beside its place and moved there when complete, so what lies in place is whole: a
    rerun, in this session or another with the same shared folder, takes it and goes on from the first
    missing stage.  A changed, added or removed input file gives another folder.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: str):
        self.spark = spark
        state = input_files(spark, folder).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "path", "length", "modificationTime")), 1, 12), 16, 10).cast("decimal(38,0)")).alias("sum"),
        ).first()
        name = hashlib.md5(f"{folder}|{state['n']}|{state['sum']}|{settings}".encode()).hexdigest()
        self.root = f"{shared_folder(spark).rstrip('/')}/tidepanel-run-{name}"

    def _system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def complete(self, name: str) -> bool:
        place, system = self._system(f"{self.root}/{name}")
        return system.exists(place)

    def place(self, name: str, save: Callable[[str], None]) -> str:
        """The path of a stage, saved by ``save(path)`` unless it is there; the first of two writers wins."""
        path = f"{self.root}/{name}"
        if not self.complete(name):
            draft = f"{self.root}/_draft-{uuid.uuid4().hex}"
            save(draft)
            (source, system), (target, _) = self._system(draft), self._system(path)
            if not system.exists(target):
                system.rename(source, target)
        return path

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self.place(name, lambda path: make().write.parquet(path)))
