"""A stream source that hands out at most so many lines a second."""

from __future__ import annotations

import io
import time

import pyarrow.fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Lines of a batch, at most.
MOST = 100_000


class RatedLines(DataSource):
    """Options: path (a text file or a folder of them; local or a URI that pyarrow opens), rate (lines a second; 0: no limit)."""

    @classmethod
    def name(cls) -> str:
        return "rated_lines"

    def schema(self) -> str:
        return "ID string, Key string, Value string"

    def simpleStreamReader(self, schema):  # noqa: N802
        rate = int(self.options.get("rate", "0"))
        if rate < 0:
            raise ValueError("the rate is 0 (no limit) or more")
        return _Reader(self.options["path"], rate)


class _Reader(SimpleDataSourceStreamReader):
    """An offset is the file's name, its lines and bytes so far, and the lines of all files.

    The allowance counts from the offset at (re)start, so a restart neither bursts nor stalls.
    """

    def __init__(self, path: str, rate: int):
        self.path, self.rate, self.began, self.base = path, rate, None, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "line": 0, "byte": 0, "all": 0}

    def _files(self):
        fs, top = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        info = fs.get_file_info(top)
        if info.type == pyarrow.fs.FileType.Directory:
            inside = fs.get_file_info(pyarrow.fs.FileSelector(top))
            return fs, sorted(f.path for f in inside if f.type == pyarrow.fs.FileType.File)
        return fs, [top]

    def _rows(self, start: dict, most: int) -> tuple[list, dict]:
        """Up to so many lines from an offset on, and the offset after them."""
        fs, files = self._files()
        at, rows = dict(start), []
        for path in files:
            name = path.rsplit("/", 1)[-1]
            if name < at["file"] or len(rows) >= most:
                continue
            if name > at["file"]:
                at |= {"file": name, "line": 0, "byte": 0}
            with fs.open_input_file(path) as f:
                f.seek(at["byte"])
                for raw in io.BufferedReader(f):
                    if len(rows) >= most:
                        break
                    at = {"file": name, "line": at["line"] + 1, "byte": at["byte"] + len(raw), "all": at["all"] + 1}
                    value = raw.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                    rows.append((f"leader-{name}-{at['line']}", f"{name}:{at['line']}", value))
        return rows, at

    def read(self, start: dict):
        if self.began is None:
            self.began, self.base = time.monotonic(), start["all"]
        due = MOST if not self.rate else self.base + int((time.monotonic() - self.began) * self.rate) - start["all"]
        rows, at = self._rows(start, min(MOST, due))
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter(self._rows(start, end["all"] - start["all"])[0])
