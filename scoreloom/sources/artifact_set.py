"""A folder of artifacts written as a whole: a job that fails leaves the set that was there before.

``df.write.format("artifact_set").mode("overwrite").save(folder)`` takes ``name`` (relative to the folder) and ``body``. Tasks write
below a hidden folder beside it; the commit moves that into place, an abort deletes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scoreloom.session import DEFAULT_MICRO_BATCH, payload_batches, shared_uri, ship_package
from scoreloom.sources.storage import OBJECT_STORES, delete_folder, exists, io_map, list_names, make_folder, move_folder, open_store, write_file


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    files: int
    length: int


class ArtifactSet(DataSource):
    """The sink's name and what it takes."""

    @classmethod
    def name(cls) -> str:
        return "artifact_set"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a set of artifacts is written as a whole: use mode('overwrite')")
        return SetWriter(self.options["path"])


class SetWriter(DataSourceArrowWriter):
    """Made once per job, so all its tasks share a hidden folder."""

    def __init__(self, folder: str):
        store, _ = open_store(folder)
        if store.type_name in OBJECT_STORES:
            raise ValueError("this store cannot move a folder; let tasks write their artifacts in place")
        self.folder = folder.rstrip("/")
        head, _, base = self.folder.rpartition("/")
        self.hidden = f"{head}/.{base}."
        self.staged, self.old = (f"{self.hidden}{uuid.uuid4().hex}.{kind}" for kind in ("new", "old"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = length = 0
        for batch in iterator:
            bodies = batch.column("body").to_pylist()
            io_map(write_file, [f"{self.staged}/{n}" for n in batch.column("name").to_pylist()], bodies)
            files, length = files + len(bodies), length + sum(map(len, bodies))
        return Written(files, length)

    def commit(self, messages: list[Written | None]) -> None:
        """Put the new set in the old one's place. Should the driver be lost between the two moves, ``recover_set`` puts the old
        one back."""
        make_folder(self.staged)  # a set may be empty
        recover_set(self.folder)
        if exists(self.folder):
            move_folder(self.folder, self.old)
        try:
            move_folder(self.staged, self.folder)
        except Exception:
            recover_set(self.folder)
            raise
        delete_folder(self.old)

    def abort(self, messages: list[Written | None]) -> None:
        delete_folder(self.staged)


def recover_set(folder: str) -> None:
    """Where a commit was lost between its two moves, the old set lies hidden beside its place: put it back."""
    head, _, base = folder.rstrip("/").rpartition("/")
    if exists(folder):
        return
    for name in sorted(list_names(head)) if exists(head) else []:
        if name.startswith(f".{base}.") and name.endswith(".old"):
            move_folder(f"{head}/{name}", folder)
            return


def save_set(artifacts: DataFrame, folder: str, batch_rows: int = DEFAULT_MICRO_BATCH) -> None:
    """Write ``name, body`` rows as the whole set of ``folder``; a task holds ``batch_rows`` bodies at a time."""
    spark = artifacts.sparkSession
    ship_package(spark)
    spark.dataSource.register(ArtifactSet)
    with payload_batches(spark, batch_rows):
        artifacts.select("name", "body").write.format("artifact_set").mode("overwrite").save(shared_uri(spark, folder))
