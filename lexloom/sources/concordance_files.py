"""A data source that writes a concordance in three forms in one pass, and commits them together.

A task writes JSON lines, CSV and the bare full contexts beside each other, a folder for each keyword, below
`_temporary/<run>`; when all tasks are done the driver moves the files into place, and a run that fails leaves nothing. In
a stream a batch's files are named by its number, so a batch that is repeated replaces its own. Paths are those of
pyarrow's file systems; all executors have to see them.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

FORMS = ("json", "csv", "text")
#: The column that text files hold.
CONTEXT = "full_context"


def _plain(v):
    return v.isoformat() if isinstance(v, date | datetime) else str(v) if isinstance(v, Decimal | bytes) else v


#: Characters that stand as their codes in the name of a partition's folder, beside control characters.
CODED = "\"#%'*/:=?\\\x7f{[]^"


def folder_name(keyword: str | None) -> str:
    """The folder of a keyword, in which slashes are underscores: a partition that Spark's readers know."""
    if keyword in (None, ""):
        return "keyword_folder=__HIVE_DEFAULT_PARTITION__"
    safe = keyword.replace("/", "_").replace("\\", "_")
    return "keyword_folder=" + "".join(f"%{ord(c):02X}" if c in CODED or c < " " else c for c in safe)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where each is, and where it goes below the folder."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Files:
    """Open files of one keyword at a time: rows come sorted by keyword."""

    def __init__(self, folder: str, run: str, columns: list[str], word: str):
        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.temporary, self.columns, self.word = f"{self.base}/_temporary/{run}", columns, word

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task, done, now, out = uuid.uuid4().hex, Written(), object(), {}
        parts: dict[str, int] = {}
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    keyword = folder_name(row[self.word])
                    if keyword != now:
                        self._close(out)
                        now, out = keyword, self._open(keyword, task, parts, done)
                    json_file, csv_file, text_file = (out[f] for f in FORMS)
                    json_file.write((json.dumps({k: _plain(v) for k, v in row.items() if v is not None}, ensure_ascii=False) + "\n").encode())
                    line = io.StringIO()
                    csv.writer(line, lineterminator="\n", quoting=csv.QUOTE_STRINGS).writerow([_plain(row[c]) for c in self.columns])
                    csv_file.write(line.getvalue().encode())
                    text_file.write(((row.get(CONTEXT) or "") + "\n").encode())
        finally:
            self._close(out)
        return done

    def _open(self, keyword: str, task: str, parts: dict[str, int], done: Written) -> dict:
        parts[keyword] = parts.get(keyword, -1) + 1
        out = {}
        for form in FORMS:
            place = f"{form}/{keyword}/part-{task}-{parts[keyword]}.{'txt' if form == 'text' else form}"
            self.system.create_dir(f"{self.temporary}/{form}/{keyword}", recursive=True)
            out[form] = self.system.open_output_stream(f"{self.temporary}/{place}")
            done.files.append((f"{self.temporary}/{place}", place))
        out["csv"].write((",".join(self.columns) + "\n").encode())
        return out

    @staticmethod
    def _close(out: dict) -> None:
        for f in out.values():
            f.close()

    def publish(self, messages: list[Written | None], prefix: str = "") -> None:
        for message in messages:
            for was, place in message.files if message else ():
                path, _, name = place.rpartition("/")
                self.system.create_dir(f"{self.base}/{path}", recursive=True)
                self.system.move(was, f"{self.base}/{path}/{prefix}{name}")
        self.drop()

    def drop(self) -> None:
        if self.system.get_file_info(self.temporary).type != fs.FileType.NotFound:
            self.system.delete_dir(self.temporary)
        above = self.temporary.rpartition("/")[0]
        if self.system.get_file_info(above).type != fs.FileType.NotFound and not self.system.get_file_info(fs.FileSelector(above)):
            self.system.delete_dir(above)


class _Batch(DataSourceArrowWriter):
    def __init__(self, files: _Files):
        self.where = files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.where.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.where.publish(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.where.drop()


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, files: _Files):
        self.where = files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.where.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, base, mark = self.where.system, self.where.base, f"batch{batchId}-"
        if system.get_file_info(base).type != fs.FileType.NotFound:  # of an earlier try of this batch
            for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
                if info.type == fs.FileType.File and info.base_name.startswith(mark):
                    system.delete_file(info.path)
        self.where.publish(messages, mark)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.where.drop()


class ConcordanceFiles(DataSource):
    """format("concordance_files"); option path: the folder, word: the keyword's column."""

    @classmethod
    def name(cls) -> str:
        return "concordance_files"

    def _files(self, schema) -> _Files:
        return _Files(self.options["path"], uuid.uuid4().hex, [f.name for f in schema], self.options.get("word", "word"))

    def writer(self, schema, overwrite: bool) -> _Batch:
        files = _Files(self.options["path"], uuid.uuid4().hex, [f.name for f in schema], self.options.get("word", "word"))
        if overwrite and files.system.get_file_info(files.base).type != fs.FileType.NotFound:
            files.system.delete_dir_contents(files.base)
        return _Batch(files)

    def streamWriter(self, schema, overwrite: bool) -> _Stream:
        return _Stream(self._files(schema))
