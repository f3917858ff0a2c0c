"""Timetable text files, one per feed and table, written by the tasks and moved into place by one commit.

``df.write.format("feed_files").option("folder", ...).option("table", "stops")`` lays rows out as ``<folder>/<feed>/<table>.txt`` with a header, the
layout that ``readers.feed_table`` reads. Tasks stream their rows to a hidden folder of their own attempt; the commit takes the files of the attempts that
succeeded, and a job that fails or a task that is tried again leaves nothing behind. Rows must come with all rows of a feed in one task, in order of
feed (``sinks.feed_sink`` sees to it): a feed's table is one text, so it is one task's stream, whatever its length; no rows are held.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FEED = "feed"
FLUSH_BYTES = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    feeds: list[str]


def _files(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _text(value: object) -> str:
    return "" if value is None else str(int(value)) if isinstance(value, bool) else str(value)


class FeedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder, self.table = options["folder"].rstrip("/"), options["table"]
        self.columns = [f.name for f in schema.fields if f.name != FEED]
        if FEED not in schema.names or not self.columns:
            raise ValueError("a feed table has a column feed and others")
        self.job = uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_feed_files_{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _files(self.folder)
        attempt = str(TaskContext.get().taskAttemptId())
        feeds: list[str] = []
        out, held = None, io.StringIO()
        lines = csv.writer(held, lineterminator="\n")

        def flush() -> None:
            out.write(held.getvalue().encode())
            held.seek(0)
            held.truncate()

        for row in iterator:
            feed = row[FEED]
            if feed is None or "/" in str(feed) or str(feed) in ("", ".", ".."):
                raise ValueError(f"no folder can be named {feed!r}")
            if not feeds or str(feed) != feeds[-1]:
                if out is not None:
                    flush()
                    out.close()
                feeds.append(str(feed))
                store.create_dir(f"{self._staging(root)}/{attempt}", recursive=True)
                out = store.open_output_stream(f"{self._staging(root)}/{attempt}/{feed}")
                lines.writerow(self.columns)
            lines.writerow([_text(row[c]) for c in self.columns])
            if held.tell() >= FLUSH_BYTES:
                flush()
        if out is not None:
            flush()
            out.close()
        if len(set(feeds)) != len(feeds):
            raise ValueError("rows of a feed must come together")
        return Written(attempt, feeds)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _files(self.folder)
        done = [m for m in messages if isinstance(m, Written)]
        every = [f for m in done for f in m.feeds]
        if len(set(every)) != len(every):
            self.abort(messages)
            raise ValueError("rows of a feed must come in one task")
        for message in done:
            for feed in message.feeds:
                store.create_dir(f"{root}/{feed}", recursive=True)
                store.move(f"{self._staging(root)}/{message.attempt}/{feed}", f"{root}/{feed}/{self.table}.txt")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _files(self.folder)
        from pyarrow import fs

        if store.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(root))


class FeedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def writer(self, schema: StructType, overwrite: bool) -> FeedWriter:
        return FeedWriter(self.options, schema)
