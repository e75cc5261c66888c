"""A keyed, replayable topic in a shared folder, as a Spark data source: `format("topic")` for streams and tables, reading and writing.

A topic has partitions with offsets, as a message broker's has. Tasks write Parquet files, one for each topic partition; a commit adds
one numbered manifest that names them with their offsets, so a batch appears whole or not at all, and a batch that a producer
repeats is not added twice. Rows of a key stay in one partition, in the order in which they were committed. Readers work on files and
offsets that the manifests give; nothing but the manifests goes through the driver.

Options: path (any that pyarrow opens); partitions (of a new topic, 4); startingOffsets (earliest or latest, for a stream without a
checkpoint); group (keeps the offsets that a stream has processed, see `committed`); producer and batchId (of a table write that may be
repeated). One producer commits at a time: a second one that takes the same number fails and is repeated by Spark."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, partition int, offset long"
_FILE = pa.schema([("key", pa.string()), ("value", pa.string())])
#: Characters of keys and values that a task holds of all partitions together, and the rows of one, before it writes a row group.
HELD_CHARS = 16 << 20
HELD_ROWS = 1024


@dataclass
class Segment(InputPartition):
    """Rows [skip, skip + take) of a file, which begin at `offset` of a topic partition."""

    file: str
    partition: int
    offset: int
    skip: int
    take: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]


class Folder:
    """The manifests of a topic."""

    def __init__(self, path: str, partitions: int = 4):
        self.path, self.partitions = path, partitions

    def _at(self, name: str):
        fs, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        return fs, f"{root}/{name}"

    def _read(self, name: str) -> dict | None:
        fs, path = self._at(name)
        if fs.get_file_info(path).type != pa.fs.FileType.File:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _write(self, name: str, content: dict) -> None:
        """All at once: to another name first, which is then moved."""
        fs, path = self._at(name)
        other = f"{path}.{uuid.uuid4().hex}"
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(other) as f:
            f.write(json.dumps(content).encode())
        fs.move(other, path)

    def manifests(self) -> list[dict]:
        fs, path = self._at("log")
        if fs.get_file_info(path).type != pa.fs.FileType.Directory:
            return []
        names = sorted(i.base_name for i in fs.get_file_info(pa.fs.FileSelector(path)) if i.base_name.endswith(".json"))
        return [self._read(f"log/{n}") for n in names]

    def count(self, manifests: list[dict]) -> int:
        """Partitions of the topic: those it began with."""
        return manifests[0]["partitions"] if manifests else self.partitions

    def ends(self) -> dict[str, int]:
        found = self.manifests()
        out = {str(p): 0 for p in range(self.count(found))}
        for m in found:
            for p, _, offset, rows in m["files"]:
                out[str(p)] = offset + rows
        return out

    def segments(self, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
        out = []
        for m in self.manifests():
            for p, file, offset, rows in m["files"]:
                low, high = max(offset, start.get(str(p), 0)), min(offset + rows, end.get(str(p), 0))
                if low < high:
                    out.append(Segment(file, p, low, low - offset, high - low))
        return out

    def read(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        fs, path = self._at(segment.file)
        with fs.open_input_file(path) as f:
            yield from self._rows(pq.ParquetFile(f), segment)

    def _rows(self, file: pq.ParquetFile, segment: Segment) -> Iterator[pa.RecordBatch]:
        """A row group at a time, as a batch would join several of them: a group is as small in bytes as `write` holds."""
        done = 0
        for batch in (b for g in range(file.num_row_groups) for b in file.iter_batches(4096, row_groups=[g])):
            low, high = max(segment.skip - done, 0), min(segment.skip + segment.take - done, batch.num_rows)
            if low < high:
                rows, first = batch.slice(low, high - low), segment.offset + done + low - segment.skip
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([segment.partition] * rows.num_rows, pa.int32()), pa.array(range(first, first + rows.num_rows), pa.int64())], ["key", "value", "partition", "offset"])
            done += batch.num_rows

    def write(self, rows: Iterator, partitions: int) -> Written:
        """Write rows(key, value) of a task, in files of their partitions: the crc32 of the key, 0 without one."""
        fs, _ = self._at("")
        writers: dict[int, tuple[str, object, list]] = {}
        counts: dict[int, int] = {}
        chars = 0

        def flush(p: int) -> None:
            name, writer, held = writers[p]
            if not held:
                return
            writer.write_table(pa.table([pa.array([k for k, _ in held], pa.string()), pa.array([v for _, v in held], pa.string())], schema=_FILE))
            held.clear()

        fs.create_dir(self._at("data")[1], recursive=True)
        for row in rows:
            key, value = row["key"], row["value"]
            p = zlib.crc32(key.encode()) % partitions if key is not None else 0
            if p not in writers:
                name = f"data/{uuid.uuid4().hex}.parquet"
                writers[p] = (name, pq.ParquetWriter(self._at(name)[1], _FILE, filesystem=fs), [])
            writers[p][2].append((key, value))
            counts[p] = counts.get(p, 0) + 1
            chars += len(key or "") + len(value or "")
            if chars >= HELD_CHARS:
                for q in writers:
                    flush(q)
                chars = 0
            elif len(writers[p][2]) >= HELD_ROWS:
                chars -= sum(len(k or "") + len(v or "") for k, v in writers[p][2])
                flush(p)
        for p in writers:
            flush(p)
            writers[p][1].close()
        return Written([(p, writers[p][0], counts[p]) for p in sorted(writers)])

    def commit(self, messages: list, producer: str, batch: str) -> None:
        found = self.manifests()
        files = [f for m in messages if m is not None for f in m.files]
        if any(m["producer"] == producer and m["batch"] == batch for m in found):
            return self.abort(messages)
        ends, listed = self.ends(), []
        for p, file, rows in sorted(files):
            listed.append((p, file, ends[str(p)], rows))
            ends[str(p)] += rows
        name = f"log/{len(found):012d}.json"
        if self._read(name) is not None:
            raise RuntimeError(f"{name} of the topic was taken by another producer")
        self._write(name, {"partitions": self.count(found), "producer": producer, "batch": batch, "files": listed})

    def abort(self, messages: list) -> None:
        for m in messages:
            for _, file, _ in m.files if m is not None else []:
                fs, path = self._at(file)
                if fs.get_file_info(path).type == pa.fs.FileType.File:
                    fs.delete_file(path)


class _Reader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Segment]:
        return self.folder.segments({}, self.folder.ends()) or [Segment("", 0, 0, 0, 0)]

    def read(self, partition: Segment):
        yield from self.folder.read(partition) if partition.take else ()


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder, starting: str, group: str | None):
        self.folder, self.starting, self.group = folder, starting, group

    def initialOffset(self) -> dict:
        ends = self.folder.ends()
        return ends if self.starting == "latest" else dict.fromkeys(ends, 0)

    def latestOffset(self) -> dict:
        return self.folder.ends()

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.folder.segments(start, end) or [Segment("", 0, 0, 0, 0)]

    def read(self, partition: Segment):
        yield from self.folder.read(partition) if partition.take else ()

    def commit(self, end: dict) -> None:
        if self.group:
            self.folder._write(f"groups/{self.group}.json", end)


class _Writer(DataSourceWriter):
    def __init__(self, folder: Folder, producer: str, batch: str):
        self.folder, self.producer, self.batch = folder, producer, batch
        self.count = folder.count(folder.manifests())

    def write(self, iterator) -> Written:
        return self.folder.write(iterator, self.count)

    def commit(self, messages: list) -> None:
        self.folder.commit(messages, self.producer, self.batch)

    def abort(self, messages: list) -> None:
        self.folder.abort(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: Folder, producer: str):
        self.folder, self.producer = folder, producer
        self.count = folder.count(folder.manifests())

    def write(self, iterator) -> Written:
        return self.folder.write(iterator, self.count)

    def commit(self, messages: list, batchId: int) -> None:
        self.folder.commit(messages, self.producer, str(batchId))

    def abort(self, messages: list, batchId: int) -> None:
        self.folder.abort(messages)


class Topic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> Folder:
        return Folder(self.options["path"], int(self.options.get("partitions", 4)))

    def reader(self, schema) -> _Reader:
        return _Reader(self._folder())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self._folder(), self.options.get("startingoffsets", self.options.get("startingOffsets", "earliest")), self.options.get("group"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._folder(), self.options.get("producer", uuid.uuid4().hex), self.options.get("batchid", self.options.get("batchId", "0")))

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self._folder(), self.options.get("producer", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Topic)


def committed(path: str, group: str) -> dict[str, int] | None:
    """The offsets up to which a group's stream has processed the topic."""
    return Folder(path)._read(f"groups/{group}.json")
