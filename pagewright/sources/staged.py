"""Tables that are committed batch by batch: each batch whole or not at all, and once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class StagedTable:
    """A table at a path: Parquet folders under data/, and in commits/ a small file for each committed batch, which names its folder.

    A batch is written to a folder of its own first; creating its commit file, which fails where there is one, makes it part
    of the table.  Readers follow the commit files, so that what a killed run left behind is never read, on any file system with
    atomic creation, and a batch that is committed again (by a retry, or by a stream after a restart) is skipped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        path, fs = self._at(f"commits/{batch}.json")
        return fs.exists(path)

    def stage(self, df: DataFrame) -> str:
        """Writes rows to a folder that no commit names yet."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, folder: str, batch: str) -> bool:
        """Makes a staged folder the batch, unless there is one."""
        path, fs = self._at(f"commits/{batch}.json")
        try:
            out = fs.create(path, False)
        except Exception:  # noqa: BLE001 (whatever the file system raises: the file is there, or the error stands)
            if fs.exists(path):
                return False
            raise
        try:
            out.write(bytearray(json.dumps({"batch": batch, "folder": folder}).encode()))
        finally:
            out.close()
        return True

    def commit(self, df: DataFrame, batch: str) -> bool:
        """Adds the rows as a batch; False, and nothing written, if the batch is there."""
        return not self.committed(batch) and self.publish(self.stage(df), batch)

    def folders(self) -> list[str]:
        """Of the committed batches, in their order."""
        path, fs = self._at("commits")
        if not fs.exists(path):
            return []
        rows = self.spark.read.schema("batch string, folder string").json(f"{self.path}/commits/*.json")
        return [r.folder for r in rows.where("folder is not null").orderBy("batch").collect()]  # a row a batch

    def read(self) -> DataFrame | None:
        """The rows of all committed batches; None before the first."""
        found = self.folders()
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in found)) if found else None


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Starts a stream into a staged table, a batch a micro-batch: one that is run again after a failure is not added again."""
    table = StagedTable(rows.sparkSession, path)
    return rows.writeStream.foreachBatch(lambda df, i: table.commit(df, f"{i:020d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
