"""Logs that grow, read as a stream: each micro-batch brings the lines that were completed since the last one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_STEP = 1 << 16
_SPLIT = 8 << 20  # bytes of a log that one task reads
_HEAD = 1024  # bytes by which a replaced file is told


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: bool):
        self.file, self.start, self.end, self.first = file, start, end, first


class TailReader(DataSourceStreamReader):
    """Offsets are, for each file, the bytes up to its last complete line and a digest of its first bytes."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.known = options["path"], options.get("suffix", ".jsonl"), {}

    def _files(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, top = self._files()
        out = {k: list(v) for k, v in self.known.items()}
        for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                out[f.path] = self._offset(system, f.path, f.size, *self.known.get(f.path, (0, "")))
        self.known = out
        return out

    def _offset(self, system: fs.FileSystem, path: str, size: int, start: int, head: str) -> list:
        with system.open_input_file(path) as f:
            seen = min(start, _HEAD)
            if size < start or (seen and hashlib.sha256(f.read_at(seen, 0)).hexdigest() != head):
                raise ValueError(f"{path} was cut or replaced: it had {start} bytes that were read")
            at = size
            while at > start:
                low = max(start, at - _STEP)
                end = f.read_at(at - low, low).rfind(b"\n")
                if end >= 0:
                    at = low + end + 1
                    return [at, hashlib.sha256(f.read_at(min(at, _HEAD), 0)).hexdigest()]
                at = low
            return [start, head]

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.known = {k: list(v) for k, v in end.items()} | {k: v for k, v in self.known.items() if v[0] >= end.get(k, (0,))[0]}
        out = []
        for file, (stop, _) in sorted(end.items()):
            begin = start.get(file, (0, ""))[0]
            if stop < begin:
                raise ValueError(f"{file} was cut: {begin} bytes of it were read")
            out += [_Range(file, a, min(a + _SPLIT, stop), a == begin) for a in range(begin, stop, _SPLIT)]
        return out or [_Range("", 0, 0, True)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.end > part.start:
            system, _ = self._files()
            with system.open_input_file(part.file) as f:
                data, at = f.read_at(part.end - part.start, part.start), part.start
                if not part.first and f.read_at(1, part.start - 1) != b"\n":  # the line belongs to the range before
                    cut = data.find(b"\n") + 1
                    data, at = (data[cut:], at + cut) if cut else (b"", part.end)
                while data and not data.endswith(b"\n"):
                    more = f.read_at(_STEP, at + len(data))
                    data += more[: more.find(b"\n") + 1] if b"\n" in more else more
                    if not more:
                        break
            lines = data.split(b"\n")[:-1]
            starts, texts = [], []
            for line in lines:
                if line.strip():
                    starts.append(at)
                    texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line) + 1
            for i in range(0, len(texts), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(texts[i : i + 10_000])), pa.array(starts[i : i + 10_000], pa.int64()), pa.array(texts[i : i + 10_000], pa.string())], ["file", "start", "value"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, start long, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of (file, start, value): the lines of the logs in a folder, each once, ``start`` being its byte in the file.

    A last line without its end stays until that comes. Blank lines are left out. A log that was cut or replaced ends the
    stream with an error: what was read from it can't be taken back. New logs join; logs that vanish stay as they were read. The
    folder is one that all executors reach: a path, or a URI that Arrow can open. Grown logs are read by ranges of 8 MB.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", folder).option("suffix", suffix).load()
