"""One file of exactly the wanted name per report, as a Spark data source to write to.

Tasks write their reports below a staging folder of the job; only when all have
succeeded does the commit move each file to its name. A task that is tried again or
runs twice leaves files that no commit names, and a failed job leaves none at all.
"""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# tasks get the code of this module with the writer, no install on executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "report_files"


def _place(path: str):
    """File system and path within it, for plain paths and URIs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """(file name, dataset, staged file) of each report of a task."""

    files: list[tuple[str, str, str]]


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        system, staging = _place(self.staging)
        system.create_dir(staging, recursive=True)
        files = []
        for row in iterator:
            staged = f"{staging}/{uuid.uuid4().hex}"
            with system.open_output_stream(staged) as out:
                out.write((row["document"] or "").encode())
            files.append((row["file_name"], row["dataset_id"], staged))
        return Staged(files)

    def commit(self, messages) -> None:
        system, path = _place(self.path)
        # tables whose files would have one name: the last one by id has it
        for name, _, staged in sorted(f for m in messages if m for f in m.files):
            system.move(staged, f"{path}/{name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, staging = _place(self.staging)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class ReportFiles(DataSource):
    """Rows (dataset_id, file_name, document) to files below the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])
