"""A streaming source of file events: what is made, changes or goes under a folder, as rows.

Each tick lists the folder where the query's driver is and compares it with what has been told so far. A file whose time or length differs is told
once it has been quiet for `settle` seconds, so that a burst of writes is one event. Events go to a journal, a file a batch, before they are
told; an offset is the number of the last. A query that starts again from its checkpoint is given the batches after its offset as they
were, and then what happened meanwhile: every event once.
"""

from __future__ import annotations

import fnmatch
import json
import re
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "event string, path string, modified_ns long, length long"
#: Batches after which a journal also holds everything that is known, so that a start reads few files.
WHOLE = 64


def _system(path: str):
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


class FileEvents(DataSource):
    """Format file_events. Options: path, the folder; journal, a folder of its own that outlives the query, as its checkpoint does; pattern, of file names
    (default *.jsonl); settle, in seconds (default 0.25)."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> FileEventsReader:
        return FileEventsReader(self.options)


class FileEventsReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern, self.settle = options.get("pattern", "*.jsonl"), float(options.get("settle", "0.25"))
        self.root, self.journal = options["path"].rstrip("/"), options["journal"].rstrip("/")
        self.known: dict[str, tuple[int, int]] | None = None  # as told up to the batch `at`
        self.at = 0
        self.seen: dict[str, tuple[tuple[int, int], float]] = {}  # what differs, and since when

    def initialOffset(self) -> dict:
        return {"batch": 0}

    # journal

    def _file(self, number: int) -> str:
        return f"{self.journal}/{number}.json"

    def _load(self, number: int) -> dict | None:
        system, path = _system(self._file(number))
        try:
            with system.open_input_file(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _save(self, number: int, content: dict) -> None:
        """A journal file appears whole or not at all."""
        system, path = _system(self._file(number))
        system.create_dir(_system(self.journal)[1], recursive=True)
        with system.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(content).encode())
        system.move(f"{path}.new", path)

    def _know(self, number: int) -> None:
        """Bring what is known to the state after a batch."""
        if self.known is None or self.at > number:
            back = []
            at = number
            while at > 0 and "whole" not in (own := self._load(at) or {}):
                back.append(own)
                at -= 1
            self.known = {p: tuple(x) for p, x in own["whole"].items()} if at > 0 else {}
            self.at = at
        while self.at < number:
            self._apply((self._load(self.at + 1) or {"events": []})["events"])
            self.at += 1

    def _apply(self, events: list) -> None:
        for event, path, *identity in events:
            if event == "remove":
                self.known.pop(path, None)
            else:
                self.known[path] = tuple(identity)

    # batches

    def list(self) -> dict[str, tuple[int, int]]:
        """Time and length of the files that are there."""
        from pyarrow import fs

        system, root = _system(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {x.path: (x.mtime_ns or 0, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number = start["batch"]
        if own := self._load(number + 1):  # told before, to a query that didn't finish it
            return iter([tuple(x) for x in own["events"]]), {"batch": number + 1}
        self._know(number)
        there, now = self.list(), time.monotonic()
        differ = {p: there.get(p) for p in there.keys() | self.known.keys() if there.get(p) != self.known.get(p)}
        self.seen = {p: self.seen[p] if p in self.seen and self.seen[p][0] == x else (x, now) for p, x in differ.items()}
        quiet = sorted(p for p, (_, since) in self.seen.items() if now - since >= self.settle)
        if not quiet:
            return iter([]), start
        events = [("remove", p, *self.known[p]) if differ[p] is None else ("modify" if p in self.known else "create", p, *differ[p]) for p in quiet]
        for p in quiet:
            del self.seen[p]
        self._apply(events)
        self._save(number + 1, {"events": events} | ({"whole": self.known} if (number + 1) % WHOLE == 0 else {}))
        self.at = number + 1
        return iter(events), {"batch": number + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for number in range(start["batch"] + 1, end["batch"] + 1):
            for x in (self._load(number) or {"events": []})["events"]:
                yield tuple(x)

    def commit(self, end: dict) -> None:
        """Journals stay: the last whole one and what follows are what a start needs. Those before the last two whole ones go."""
        last = end["batch"] // WHOLE * WHOLE - WHOLE
        if last > 0 and end["batch"] % WHOLE == 0:
            system, _ = _system(self.journal)
            for number in range(last - WHOLE, last):
                try:
                    system.delete_file(_system(self._file(number))[1])
                except FileNotFoundError:
                    pass


def file_events(spark: SparkSession, root: str, journal: str, pattern: str = "*.jsonl", settle: float = 0.25):
    """The stream of (event, path, modified_ns, length): create, modify and remove."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("journal", journal).option("pattern", pattern).option("settle", str(settle)).load(root)
