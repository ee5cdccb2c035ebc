"""A data source of log lines whose partitions are byte ranges of a snapshot of file lengths.

The files and their lengths are listed once, when a scan is planned; what is appended later is not read. Each
partition reads its ranges by seeking: a line belongs to the range that it begins in, so a range that begins inside
a line skips to the next one and reads its last line to the end, but not beyond the snapshot. A line's offset is
where it was found; no shuffle counts bytes. Small files and ranges share a partition, large files are split.

Options decide what is read at all, as seeks; `logs.raw_lines` filters the lines that come back once more:

    files                 a JSON list of file paths
    start, end            handles: lines that begin at these bytes or between them
    head                  the first n bytes: lines that lie in them whole
    tail                  the last n bytes: lines of them, but for the first, maybe partial one

They are options and not pushed filters, because Spark (4.1) keeps what a Python source accepts for a relation, not for
each of its scans: two differently filtered uses of one relation in a query would both read the same ranges.

Columns head_bytes and tail_bytes hold the smallest head and tail window that a line lies in.

As a stream, its offset is a map from file to the byte after the last complete line read: a line that is still
being written waits for its end, a restart goes on where the checkpoint says, and a file that has become shorter
was replaced and is read anew. The map has an entry a file, so a stream should watch a folder of live logs,
not a whole archive.

Files are reached through pyarrow's file systems (local, S3, GCS, HDFS with libhdfs). Options: path (a JSON list, or one path),
glob (*.jsonl), modified_after (ISO time), split_bytes, batch_bytes and those above.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Executors need no copy of this package: the module travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "log_lines"
SPLIT, BATCH = 64 << 20, 4 << 20
SCHEMA = "file_path string, file_size bigint, modified_at timestamp, offset bigint, nbytes bigint, terminated boolean, head_bytes bigint, tail_bytes bigint, raw binary"
ARROW = pa.schema([("file_path", pa.string()), ("file_size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("offset", pa.int64()), ("nbytes", pa.int64()), ("terminated", pa.bool_()), ("head_bytes", pa.int64()), ("tail_bytes", pa.int64()), ("raw", pa.binary())])


@dataclass(frozen=True)
class LogFile:
    path: str
    size: int
    modified: float


@dataclass
class Ranges(InputPartition):
    """Ranges of bytes [lo, hi) to take line starts from, with their files."""

    ranges: list[tuple[LogFile, int, int]] = field(default_factory=list)

    @property
    def nbytes(self) -> int:
        return sum(hi - lo for _, lo, hi in self.ranges)


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def listed(paths: list[str], glob: str, modified_after: str | None = None) -> list[LogFile]:
    since = datetime.fromisoformat(modified_after).replace(tzinfo=timezone.utc).timestamp() if modified_after else None
    found = {}
    for path in paths:
        local = "://" not in path and not path.startswith("file:")
        system, at = fs.FileSystem.from_uri(("file://" + path) if local else path)
        scheme = "file://" if local or path.startswith("file:") else path[: path.index("://") + 3]
        info = system.get_file_info(at)
        infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
        for x in infos:
            if x.is_file and fnmatch(x.base_name, glob) and not x.base_name.startswith(("_", ".")) and x.size:
                modified = x.mtime.timestamp() if x.mtime else 0.0
                if since is None or modified > since:
                    found[scheme + x.path] = LogFile(scheme + x.path, x.size, modified)
    return [found[k] for k in sorted(found)]


def split(ranges: list[tuple[LogFile, int, int]], size: int) -> list[Ranges]:
    """Ranges cut to at most `size` bytes, and partitions of about so many."""
    out, held = [], Ranges([])
    for f, lo, hi in ranges:
        for at in range(lo, hi, size):
            own = f, at, min(at + size, hi)
            if held.ranges and held.nbytes + own[2] - own[1] > size:
                out.append(held)
                held = Ranges([])
            held.ranges.append(own)
    return [*out, held] if held.ranges else out


def line_blocks(file, lo: int, hi: int, size: int, block: int = BATCH) -> Iterator[tuple[int, list[bytes], bool]]:
    """Lines that begin in [lo, hi) of a file of `size` bytes: offset of the first, the lines of a block, and whether the last has its end."""
    at = lo
    if lo:  # the byte before tells whether a line begins at lo
        file.seek(lo - 1)
        at = lo - 1
        while at < hi:
            part = file.read(min(block, size - at))
            cut = part.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(part)
            if not part:
                return
    file.seek(at)
    rest = b""  # bytes of a line that has begun at `at`
    end = at
    while at < hi:
        part = file.read(min(block, size - end))
        end += len(part)
        whole, rest = rest + part, b""
        if not part or end >= size:
            lines = whole.split(b"\n")
            closed = lines[-1] == b""
            if closed:
                lines.pop()
        else:
            cut = whole.rfind(b"\n") + 1
            whole, rest = whole[:cut], whole[cut:]
            lines, closed = whole[:-1].split(b"\n") if whole else [], True
        own, after = [], at
        for i, line in enumerate(lines):
            if after >= hi:
                closed = True
                break
            own.append(line)
            after += len(line) + 1
        if own:
            yield at, own, closed or len(own) < len(lines)
        at += sum(map(len, lines)) + len(lines)
        if not part or end >= size:
            return


def batches(partition: Ranges, block: int = BATCH) -> Iterator[pa.RecordBatch]:
    for f, lo, hi in partition.ranges:
        with _open(f.path) as file:
            for at, lines, closed in line_blocks(file, lo, hi, f.size, block):
                n, offsets, ended = [len(x) for x in lines], [], [True] * len(lines)
                ended[-1] = closed
                for x in n:
                    offsets.append(at)
                    at += x + 1
                head = [o + x + e for o, x, e in zip(offsets, n, ended)]
                tail = [f.size - o + (o > 0) for o in offsets]
                columns = [[f.path] * len(n), [f.size] * len(n), [int(f.modified * 1e6)] * len(n), offsets, n, ended, head, tail, lines]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        number = lambda name: int(self.options[name]) if name in self.options else None
        start, end, head, tail = map(number, ("start", "end", "head", "tail"))
        only = set(json.loads(self.options["files"])) if "files" in self.options else None
        wanted = []
        for f in listed(json.loads(self.options["path"]), self.options.get("glob", "*.jsonl"), self.options.get("modified_after")):
            lo = max(start or 0, f.size - tail + 1 if tail is not None and tail < f.size else 0)
            hi = min(x for x in (f.size, end, head) if x is not None)
            if lo < hi and (only is None or f.path in only):
                wanted.append((f, lo, hi))
        return split(wanted, int(self.options.get("split_bytes", SPLIT))) or [Ranges([])]

    def read(self, partition):
        yield from batches(partition, int(self.options.get("batch_bytes", BATCH)))


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _files(self) -> list[LogFile]:
        return listed(json.loads(self.options["path"]), self.options.get("glob", "*.jsonl"))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {f.path: end for f in self._files() if (end := self._complete(f))}

    def _complete(self, f: LogFile, block: int = 1 << 16) -> int:
        """The byte after the file's last line end."""
        with _open(f.path) as file:
            end = f.size
            while end:
                begin = max(0, end - block)
                file.seek(begin)
                cut = file.read(end - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                end = begin
        return 0

    def partitions(self, start, end):
        wanted = []
        for path, hi in sorted(end.items()):
            lo = start.get(path, 0)
            lo = lo if lo <= hi else 0  # shorter than before: another file
            if lo < hi:
                wanted.append((LogFile(path, hi, 0.0), lo, hi))
        return split(wanted, int(self.options.get("split_bytes", SPLIT))) or [Ranges([])]

    def read(self, partition):
        yield from batches(partition, int(self.options.get("batch_bytes", BATCH)))


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return LogReader(dict(self.options))

    def streamReader(self, schema):
        return LogStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def options(paths: str | list[str], **more) -> dict[str, str]:
    return {"path": json.dumps([paths] if isinstance(paths, str) else list(paths))} | {k: str(v) for k, v in more.items() if v is not None}
