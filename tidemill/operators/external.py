"""A stage that any executable runs: JSON tuples on its stdin, one JSON envelope for each on its stdout."""

from __future__ import annotations

import json
import os
import queue
import shutil
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "ID string, Key string, Value string, Timestamp timestamp"


def external(df: DataFrame, command: str, *args: str, timeout: float | None = None) -> DataFrame:
    """Rows that the executable returns for each row; the process lives as long as its partition.

    An envelope without OriginalTupleId or OutputTuples is skipped. Children of one row that share its ID get `#i`
    appended, so that later dedup keeps them. The process's own memory isn't part of any checkpoint. With a timeout, a
    process that says nothing for so many seconds fails the task.
    """
    path = shutil.which(command) or os.path.abspath(command)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    argv = [path, *args]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        lines: queue.Queue = queue.Queue(maxsize=10_000)

        def pump() -> None:
            for line in p.stdout:
                lines.put(line)
            lines.put(None)

        def feed() -> None:
            for b in batches:
                for r in b.itertuples(index=False):
                    when = None if pd.isna(r.Timestamp) else r.Timestamp.isoformat()
                    p.stdin.write(json.dumps({"ID": r.ID, "Key": r.Key or "", "Value": r.Value or "", "Timestamp": when}) + "\n")
                p.stdin.flush()
            p.stdin.close()

        def said() -> str | None:
            try:
                return lines.get(timeout=timeout)
            except queue.Empty:
                raise TimeoutError(f"{argv[0]} said nothing for {timeout} s") from None

        failed: list[BaseException] = []

        def feeder() -> None:
            try:
                feed()
            except BaseException as e:  # noqa: BLE001  raised again below, in the task's own thread
                failed.append(e)
                p.kill()

        threading.Thread(target=pump, daemon=True).start()
        threading.Thread(target=feeder, daemon=True).start()
        rows = []
        try:
            while (line := said()) is not None:
                rows += parse_envelope(line)
                if len(rows) >= 5000:
                    yield frame(rows)
                    rows = []
            if failed:
                raise failed[0]
            if p.wait(timeout=timeout):
                raise RuntimeError(f"{argv[0]} ended with {p.returncode}")
            yield frame(rows)
        finally:
            p.kill()

    return df.select("ID", "Key", "Value", "Timestamp").mapInPandas(run, OUT)


def parse_envelope(line: str) -> list[tuple]:
    try:
        e = json.loads(line)
    except ValueError:
        return []
    if not isinstance(e, dict) or not e.get("OriginalTupleId") or not isinstance(e.get("OutputTuples"), list):
        return []
    out, many = [], len(e["OutputTuples"]) > 1
    for i, t in enumerate(e["OutputTuples"]):
        if not isinstance(t, dict):
            continue
        name = t.get("ID") or e["OriginalTupleId"]
        out.append((f"{name}#{i}" if many and name == e["OriginalTupleId"] else name, _text(t.get("Key")), _text(t.get("Value")), t.get("Timestamp")))
    return out


def _text(v) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v)


def frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["ID", "Key", "Value", "Timestamp"])
    return df.assign(Timestamp=pd.to_datetime(df["Timestamp"], utc=True, format="ISO8601", errors="coerce").dt.tz_localize(None))
