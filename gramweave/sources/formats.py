"""Data sources for spark.read.format(...) and df.write.format(...): `gfa`, sequence graphs, and `patterns`, files of patterns of one length.

    register(spark)
    nodes = spark.read.format("gfa").load(path)                          # name, label: the S records
    links = spark.read.format("gfa").option("record", "L").load(path)    # src, src_rev, dst, dst_rev
    nodes.write.format("gfa").mode("append").save(path)                  # S or L records, by the columns
    patterns = spark.read.format("patterns").load(path)                  # file, pattern_id, pattern

A path is a file or a folder, local or in a store that pyarrow.fs knows by its URI. Files are read in ranges of `split` bytes (an option; 32 MB): a range of a
graph has the lines that begin in it, one of a pattern file the patterns, told by the header's length. A task writes one file under a name that
readers pass over, and the driver gives it its name when all tasks have ended, so a failed or repeated task leaves nothing.

A record with too few fields, a pattern file without number= or length= in its header, or one that is shorter than these say is an error.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SPLIT = 32 << 20
S_RECORD, L_RECORD = "name string, label string", "src string, src_rev boolean, dst string, dst_rev boolean"


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, by name; without those whose name begins with _ or a point."""
    from pyarrow import fs

    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    first: int = 0
    length: int = 0


class _Ranges(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.record = options.get("record", "S")

    def partitions(self) -> list[Range]:
        return [Range(name, a, min(a + self.split, size)) for name, size in _files(self.path) for a in range(0, size, self.split)] or [Range("", 0, 0)]


class GfaReader(_Ranges):
    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        with io.BufferedReader(_opened(self.path)[0].open_input_file(partition.file), 1 << 20) as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # the line that begins before this range, or the break that ends it
            while f.tell() < partition.end and (line := f.readline()):
                fields = line.decode().rstrip("\r\n").split("\t")
                if fields[0] != self.record:
                    continue
                if len(fields) < (3 if self.record == "S" else 5):
                    raise ValueError(f"{partition.file}: a record {self.record} with {len(fields)} fields")
                yield (fields[1], fields[2]) if self.record == "S" else (fields[1], fields[2] == "-", fields[3], fields[4] == "-")


@dataclass
class Written(WriterCommitMessage):
    held: str
    name: str


class GfaWriter(DataSourceWriter):
    def __init__(self, options: dict, nodes: bool, overwrite: bool):
        if overwrite:
            raise ValueError("gfa appends files to a folder: use mode append")
        self.path, self.nodes = options["path"], nodes

    def write(self, rows: Iterator) -> Written:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        name = f"{'1-nodes' if self.nodes else '2-links'}-{uuid.uuid4().hex}.gfa"
        with store.open_output_stream(f"{at}/_{name}") as f:
            for row in rows:
                fields = ["S", row[0], row[1]] if self.nodes else ["L", row[0], "-" if row[1] else "+", row[2], "-" if row[3] else "+", "0M"]
                if any(x is None or re.search(r"[\t\r\n]", str(x)) for x in fields):
                    raise ValueError(f"a field of a graph is null or holds a tab or a line break: {fields}")
                f.write(("\t".join(map(str, fields)) + "\n").encode())
        return Written(f"{at}/_{name}", f"{at}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                _opened(self.path)[0].move(m.held, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                _opened(self.path)[0].delete_file(m.held)


class GfaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gfa"

    def schema(self) -> str:
        if self.options.get("record", "S") not in ("S", "L"):
            raise ValueError("record is S or L")
        return S_RECORD if self.options.get("record", "S") == "S" else L_RECORD

    def reader(self, schema) -> GfaReader:
        return GfaReader(self.options)

    def writer(self, schema, overwrite: bool) -> GfaWriter:
        if schema.names not in (["name", "label"], ["src", "src_rev", "dst", "dst_rev"]):
            raise ValueError("gfa takes the columns name, label or src, src_rev, dst, dst_rev")
        return GfaWriter(self.options, schema.names[0] == "name", overwrite)


class PatternReader(_Ranges):
    def partitions(self) -> list[Range]:
        out = []
        for name, size in _files(self.path):
            with io.BufferedReader(_opened(self.path)[0].open_input_file(name)) as f:
                header = f.readline().decode()
                begin = f.tell()
            number, length = (re.search(rf"(?:^|\s){x}=(\d+)", header) for x in ("number", "length"))
            if not number or not length or int(length[1]) < 1 or begin + int(number[1]) * int(length[1]) > size:
                raise ValueError(f"{name}: a pattern file needs number= and length= in its header, and as many bytes")
            n, m = int(number[1]), int(length[1])
            step = max(1, self.split // m)
            out += [Range(name, begin + a * m, begin + min(a + step, n) * m, a, m) for a in range(0, n, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            with io.BufferedReader(_opened(self.path)[0].open_input_file(partition.file), 1 << 20) as f:
                f.seek(partition.start)
                for i in range((partition.end - partition.start) // partition.length):
                    yield partition.file, partition.first + i, f.read(partition.length).decode()


class PatternSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patterns"

    def schema(self) -> str:
        return "file string, pattern_id long, pattern string"

    def reader(self, schema) -> PatternReader:
        return PatternReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    spark.dataSource.register(GfaSource)
    spark.dataSource.register(PatternSource)
