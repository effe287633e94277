"""Cursor-paged collections as a Spark data source, in batch and as a stream.

A collection is a set of chains; a chain is a run of pages, each naming the
cursor of the next. A batch read walks each chain in a task of its own, a page
in memory at a time. A stream plans the pages of a trigger on the driver by
following the cursors, and reads them in as many tasks; its offset is the
cursor of each chain, so a restart goes on where the last committed trigger
ended and no page is read into a table twice.

Pages are fetched by a function of the cursor. The one here opens folders
``cursor=<cursor>`` of JSON lines in any file system that Arrow knows; a client
of a service takes its place with the same signature.

A page that can't be had is tried ``tries`` times. Then the read fails, or, with
``failed`` set to ``record``, gives a row that holds the chain, the cursor and
the error instead of items; the chain ends there, since what comes after it is
unknown. A stream takes a page without a file for one that has yet to come.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "chain string, cursor string, item string, error string"


def folder_page(path: str, cursor: str) -> tuple[str | None, list[str]]:
    """(next cursor, items as JSON) of a page that lies in a folder."""
    system, root = fs.FileSystem.from_uri(path)
    files = [f for f in system.get_file_info(fs.FileSelector(f"{root}/cursor={cursor}")) if f.base_name.endswith(".json")]
    after, items = None, []
    for f in sorted(files, key=lambda f: f.path):
        with system.open_input_stream(f.path) as stream:
            for line in stream.readall().decode("utf-8").splitlines():
                page = json.loads(line)
                after = page.get("next") or after
                items += [json.dumps(i, ensure_ascii=False) for i in page.get("items", [])]
    if not files:
        raise FileNotFoundError(f"page {cursor} has no file")
    return after, items


class Chain(InputPartition):
    """Pages to read: a whole chain from a cursor on, or just the cursors listed."""

    def __init__(self, chain: str, cursors: list[str], follow: bool):
        super().__init__((chain, tuple(cursors), follow))
        self.chain, self.cursors, self.follow = chain, cursors, follow


class Pages:
    """Options of a read, and the walk along chains."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.starts: dict[str, str] = json.loads(options["starts"])
        self.tries = int(options.get("tries", "3"))
        self.record = options.get("failed", "raise") == "record"

    def page(self, cursor: str) -> tuple[str | None, list[str]]:
        for k in range(self.tries):
            try:
                return folder_page(self.path, cursor)
            except (OSError, ValueError):
                if k + 1 == self.tries:
                    raise
                time.sleep(min(2**k, 60) / 10)
        raise ValueError("tries must be positive")

    def rows(self, part: Chain) -> Iterator[tuple]:
        cursors = list(part.cursors)
        while cursors:
            cursor = cursors.pop(0)
            try:
                after, items = self.page(cursor)
            except (OSError, ValueError) as e:
                if not self.record:
                    raise
                yield part.chain, cursor, None, str(e)
                return
            for item in items:
                yield part.chain, cursor, item, None
            if part.follow and after:
                cursors.append(after)


class BatchReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[Chain]:
        return [Chain(name, [cursor], True) for name, cursor in self.pages.starts.items()]

    def read(self, partition: Chain) -> Iterator[tuple]:
        return self.pages.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are the cursor that each chain goes on from; null where it has ended.

    A page that isn't there yet ends the walk and is looked for in the next trigger.
    """

    def __init__(self, pages: Pages):
        self.pages = pages
        self.done = dict(pages.starts)

    def initialOffset(self) -> dict:
        return dict(self.pages.starts)

    def _walk(self, cursor: str | None, until: str | None = None) -> tuple[list[str], str | None]:
        """(cursors passed, cursor after them)."""
        seen: list[str] = []
        while cursor and cursor != until:
            try:
                after, _ = self.pages.page(cursor)
            except FileNotFoundError:
                break
            seen.append(cursor)
            cursor = after
        return seen, cursor

    def latestOffset(self) -> dict:
        return {name: self._walk(cursor)[1] for name, cursor in self.done.items()}

    def partitions(self, start: dict, end: dict) -> list[Chain]:
        cursors = [(name, self._walk(start[name], end[name])[0]) for name in start]
        return [Chain(name, [c], False) for name, some in cursors for c in some]

    def read(self, partition: Chain) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        self.done = dict(end)  # later walks start here; Spark's checkpoint holds the offset itself


class PagedSource(DataSource):
    """``paged``: options path, starts (JSON of chain to first cursor), tries, failed (raise or record)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(Pages(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Pages(self.options))
