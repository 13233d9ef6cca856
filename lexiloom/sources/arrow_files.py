"""Feather files and unsigned 16-bit token files: parts that a commit makes visible, read by range."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import checkpoint_root


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; plain paths and ``file:`` are local or mounted."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def shared_path(spark: SparkSession, path: str) -> str:
    """``path`` as driver and tasks both see it.

    A path without a scheme lies in Spark's default file system. On a cluster a local one is an
    error, since each executor would keep its own files, unless it lies in the shared checkpoint folder.
    """
    if "://" not in path and not path.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        path = path if default.startswith("file:") else f"{default.rstrip('/')}/{path.lstrip('/')}"
    plain = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    if path.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
        root = plain(checkpoint_root(spark)).rstrip("/")
        if not plain(path).startswith(f"{root}/"):
            raise ValueError(f"{path} is local to each machine; name a file system that all executors share")
    return path


MANIFESTS = "_manifests"


def committed_parts(path: str) -> list[dict] | None:
    """The parts (file, first, n) of the last committed write below ``path``, or None if nothing was committed."""
    fs, root = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    names = sorted(f.path for f in found if f.path.endswith(".json"))
    if not names:
        return None
    with fs.open_input_stream(names[-1]) as stream:
        return json.loads(stream.read())["parts"]


@dataclass
class PartMessage(WriterCommitMessage):
    partition: int
    file: str
    n: int


class PartWriter(DataSourceArrowWriter):
    """Part files that become visible together, by one manifest that the driver writes after the last task.

    Every task attempt writes a file of its own in the folder of this run; only the attempts that Spark
    accepted are listed, in order of their partitions. A failed run is removed and leaves the former state.
    An overwriting run replaces all parts, an appending one continues behind the last. One run at
    a time may write below a path.
    """

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, f"run-{uuid.uuid4().hex}"

    def encode(self, batches: Iterator[pa.RecordBatch], stream) -> int:
        """Write ``batches`` to ``stream``; returns how much the part holds."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_fs(self.path)
        fs.create_dir(f"{root}/{self.run}", recursive=True)
        task = TaskContext.get()
        name = f"{self.run}/part-{task.partitionId():06d}-{task.taskAttemptId()}{self.suffix}"
        with fs.open_output_stream(f"{root}/{name}") as stream:
            n = self.encode(iterator, stream)
        return PartMessage(task.partitionId(), name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        parts = [] if self.overwrite else committed_parts(self.path) or []
        first = parts[-1]["first"] + parts[-1]["n"] if parts else 0
        for m in sorted((m for m in messages if m is not None and m.n), key=lambda m: m.partition):
            parts.append({"file": m.file, "first": first, "n": m.n})
            first += m.n
        folder = f"{root}/{MANIFESTS}"
        fs.create_dir(folder, recursive=True)
        older = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".json"))
        number = int(older[-1].rsplit("/", 1)[-1][:-5]) + 1 if older else 0
        with fs.open_output_stream(f"{folder}/{number:09d}.new") as stream:
            stream.write(json.dumps({"parts": parts}).encode())
        fs.move(f"{folder}/{number:09d}.new", f"{folder}/{number:09d}.json")
        # The new state stands; what it does not name is waste.
        listed = {f"{root}/{p['file']}" for p in parts}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.type == pafs.FileType.File and "/run-" in info.path and info.path not in listed:
                fs.delete_file(info.path)
        for name in older:
            fs.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        if fs.get_file_info(f"{root}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.run}")


class FeatherWriter(PartWriter):
    suffix = ".feather"

    def encode(self, batches, stream):
        writer, rows = None, 0
        for batch in batches:
            if writer is None:
                writer = ipc.new_file(stream, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
        return rows


class FeatherSink(DataSource):
    """``df.write.format("feather_parts")``: one feather file per partition, visible after the commit."""

    @classmethod
    def name(cls):
        return "feather_parts"

    def writer(self, schema, overwrite):
        return FeatherWriter(self.options["path"], overwrite)


def write_feather(df: DataFrame, path: str, append: bool = False) -> DataFrame:
    """One feather file per partition; returns the list of (file, n_rows) that ``path`` holds then.

    Replaces what was written before, or adds to it with ``append``.
    """
    spark = df.sparkSession
    path = shared_path(spark, path)
    spark.dataSource.register(FeatherSink)
    df.write.format("feather_parts").mode("append" if append else "overwrite").save(path)
    _, root = open_fs(path)
    rows = [(f"{root}/{p['file']}", p["n"]) for p in committed_parts(path)]
    return spark.createDataFrame(rows, "file STRING, n_rows BIGINT")


def list_files(spark: SparkSession, path: str, suffix: str) -> list[pafs.FileInfo]:
    fs, root = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f for f in found if f.path.endswith(suffix)), key=lambda f: f.path)


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feather files as a DataFrame; each task streams its files batch by batch."""
    path = shared_path(spark, path)
    parts = committed_parts(path)
    if parts is None:  # files of another writer
        names = [f.path for f in list_files(spark, path, ".feather")]
    else:
        names = [f"{open_fs(path)[1]}/{p['file']}" for p in parts]
    files = spark.createDataFrame([(n,) for n in names], "file STRING").repartition(max(1, len(names)), "file")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(name) as source:
                    reader = ipc.open_file(source)
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    return files.mapInArrow(load, schema)


def feather_schema(path: str) -> pa.Schema:
    """Column names and types of one feather file, without reading its rows."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as source:
        return ipc.open_file(source).schema


class TokenBinWriter(PartWriter):
    suffix = ".bin"

    def encode(self, batches, stream):
        written = 0
        for batch in batches:
            flat = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not (0 <= flat.min() and flat.max() < 1 << 16):
                raise ValueError("a token id needs more than 16 bits")
            stream.write(flat.astype("<u2").tobytes())
            written += len(flat)
        return written


def write_token_bin(blocks: DataFrame, path: str, parts: int, append: bool = False) -> None:
    """(block_id, ids) to little-endian uint16 part files, as one sequence in order of block_id.

    Parts are ranges of block ids and start where the part before ends. What ``path`` held is
    replaced, or continued with ``append``; a run that fails changes nothing.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(TokenBinSource)
    ordered = blocks.select("block_id", "ids").repartitionByRange(parts, "block_id").sortWithinPartitions("block_id")
    ordered.select("ids").write.format("token_bin").mode("append" if append else "overwrite").save(shared_path(spark, path))


class TokenRange(InputPartition):
    def __init__(self, path: str, first_pos: int, start: int, count: int):
        self.path, self.first_pos, self.start, self.count = path, first_pos, start, count


class TokenBinReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.tokens_per_split = int(options.get("tokensPerSplit", 1 << 24))

    def partitions(self):
        splits = []
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        parts = None if info.type == pafs.FileType.File else committed_parts(self.path)
        if parts is None:  # files of another writer, one behind the other in order of their names
            files, first = [], 0
            for f in [info] if info.type == pafs.FileType.File else list_files(None, self.path, ".bin"):
                if f.size % 2:
                    raise ValueError(f"{f.path}: odd size, not a uint16 token file")
                files.append((f.path, first, f.size // 2))
                first += f.size // 2
        else:
            files = [(f"{root}/{p['file']}", p["first"], p["n"]) for p in parts]
        for name, first, n in files:
            for start in range(0, n, self.tokens_per_split):
                splits.append(TokenRange(name, first, start, min(self.tokens_per_split, n - start)))
        return splits

    def read(self, partition):
        fs, _ = open_fs(self.path)
        step = 1 << 18
        with fs.open_input_file(partition.path) as source:
            source.seek(partition.start * 2)
            done = 0
            while done < partition.count:
                want = min(step, partition.count - done)
                ids = np.frombuffer(source.read(want * 2), dtype="<u2").astype(np.int32)
                pos = np.arange(len(ids), dtype=np.int64) + partition.first_pos + partition.start + done
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(ids)], ["pos", "token"])
                done += want


class TokenBinSource(DataSource):
    """Reads (pos BIGINT, token INT); writes rows with a column ``ids``, also appending."""

    @classmethod
    def name(cls):
        return "token_bin"

    def schema(self):
        return "pos BIGINT, token INT"

    def reader(self, schema):
        return TokenBinReader(self.options)

    def writer(self, schema, overwrite):
        return TokenBinWriter(self.options["path"], overwrite)


def read_token_bin(spark: SparkSession, path: str, tokens_per_split: int = 1 << 24) -> DataFrame:
    path = shared_path(spark, path)
    spark.dataSource.register(TokenBinSource)
    return spark.read.format("token_bin").option("tokensPerSplit", tokens_per_split).load(path)
