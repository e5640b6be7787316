"""Files as Python data sources: digests by ranges of bytes and whole, and a sink of run folders that commits.

Files are read a MiB at a time, so that they may be of any size; their places are paths or URIs that pyarrow's file systems open on
the executors. What a source or sink does on an executor is pickled with it.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Bytes that are hashed at once, and that a task of a source reads, about.
CHUNK, RANGE = 1 << 20, 256 << 20
#: Children of a node of a Merkle tree of chunks.
FAN = 1024


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def listed(place: str) -> list[tuple[str, int]]:
    """(path, bytes) of the regular files at or below a place."""
    system, path = opened(place)
    info = system.get_file_info(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file)


@dataclass
class Part(InputPartition):
    """Ranges of files: (path, its bytes, first byte, end)."""

    ranges: list[tuple[str, int, int, int]]


def _parts(ranges: list[tuple[str, int, int, int]], size: int) -> list[InputPartition]:
    """Ranges in groups of about `size` bytes."""
    out: list[Part] = []
    held = 0
    for r in ranges:
        if not out or held + r[3] - r[2] > size:
            out.append(Part([]))
            held = 0
        out[-1].ranges.append(r)
        held += r[3] - r[2]
    return list(out) or [Part([])]


def _blocks(system: fs.FileSystem, path: str, at: int, end: int) -> Iterator[bytes]:
    with system.open_input_file(path) as f:
        f.seek(at)
        while at < end:
            block = f.read(min(CHUNK, end - at))
            if not block:
                raise OSError(f"{path} ended at byte {at} of {end}")
            at += len(block)
            yield block


class _Digests(DataSourceReader):
    def __init__(self, place: str, whole: bool, size: int):
        self.place, self.whole, self.size = place, whole, size

    def partitions(self) -> list[InputPartition]:
        files = listed(self.place)
        if self.whole:
            return _parts([(p, n, 0, n) for p, n in files], self.size)
        return _parts([(p, n, a, min(a + self.size, n)) for p, n in files for a in range(0, max(n, 1), self.size)], self.size)

    def read(self, partition: Part) -> Iterator[tuple[Any, ...]]:
        system, _ = opened(self.place)
        for path, n, at, end in partition.ranges:
            if self.whole:
                digest = hashlib.sha256()
                for block in _blocks(system, path, at, end):
                    digest.update(block)
                yield path, digest.hexdigest(), n
            else:
                for k, block in enumerate(_blocks(system, path, at, end)):
                    yield path, n, at // CHUNK + k, hashlib.sha256(b"\0" + block).hexdigest()


class FileDigests(DataSource):
    """(path, sha256, length) of every file below `path`; one task reads a file from its first byte to its last."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, sha256 string, length long"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Digests(self.options["path"], True, int(self.options.get("range", RANGE)))


class ChunkDigests(DataSource):
    """(path, length, nr, hash) of every MiB of every file below `path`; many tasks read a file. An empty file has no chunk."""

    @classmethod
    def name(cls) -> str:
        return "chunk_digests"

    def schema(self) -> str:
        return "path string, length long, nr long, hash string"

    def reader(self, schema: Any) -> DataSourceReader:
        size = int(self.options.get("range", RANGE))
        return _Digests(self.options["path"], False, max(CHUNK, size - size % CHUNK))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, length) of every file below a folder, of any size."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("path", folder).load()


def chunk_hashes(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """(path, length, nr, hash) of every MiB of every file below a folder, by tasks of `size` bytes."""
    spark.dataSource.register(ChunkDigests)
    return spark.read.format("chunk_digests").option("path", folder).option("range", size).load()


def merkle_roots(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(path, length, root): the root of the Merkle tree over a file's chunks, each node the hash of up to `fan` children in order.

    A file of one chunk has its hash as root. What two versions of a large file differ in is found by comparing nodes.
    """
    most = chunks.agg(F.max("nr")).first()[0]
    nodes = chunks.withColumn("width", F.ceil(F.col("length") / CHUNK))
    while most is not None and most > 0:
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "hash"))), lambda c: c["hash"]), "")
        up = nodes.groupBy("path", "length", "width", F.floor(F.col("nr") / fan).alias("up")).agg(F.min("hash").alias("own"), children.alias("all"))
        nodes = up.select("path", "length", F.ceil(F.col("width") / fan).alias("width"), F.col("up").alias("nr"), F.when(F.col("width") == 1, F.col("own")).otherwise(F.sha2(F.concat(F.lit("\1"), "all"), 256)).alias("hash"))
        most //= fan
    return nodes.select("path", "length", F.col("hash").alias("root"))


#: Hexadecimal digits of a path's hash by which its leaf of a tree of files is known.
DIGITS = 5


def tree_levels(hashes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(prefix, digest, n_files): a Merkle tree over files (path, sha256), from its leaves, by the first hexadecimal digits of a path's hash, to the root ''.

    No task sees more than the files of a leaf or 16 nodes. Two trees are compared from the root down.
    """
    listed_ = lambda rows: F.sha2(F.array_join(F.array_sort(F.collect_list(rows)), "\n"), 256)
    level = hashes.groupBy(F.substring(F.sha2("path", 256), 1, digits).alias("prefix")).agg(listed_(F.concat_ws("\0", "path", "sha256")).alias("digest"), F.count("*").alias("n_files"))
    out = level
    for n in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, n).alias("prefix")).agg(listed_(F.concat_ws(" ", "prefix", "digest")).alias("digest"), F.sum("n_files").alias("n_files"))
        out = out.unionByName(level)
    return out


def tree_digest(hashes: DataFrame) -> DataFrame:
    """(digest, n_files): one SHA-256 over all (path, sha256), in the order of the paths' code points.

    The exact digest is a chain, so one task streams the sorted rows through it and holds one batch of them at a time; use
    tree_levels() where its order need not be that of another tool.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for path, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest.update(f"{path}\0{sha}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n])], names=["digest", "n_files"])

    one = hashes.select("path", "sha256").repartition(1).sortWithinPartitions("path").mapInArrow(chain, "digest string, n_files long")
    return one.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.max("n_files"), F.lit(0)).alias("n_files"))


#: Columns of run records and the files that they become.
RECORD_FILES = {"commit_txt": "commit.txt", "matrix": "matrix.json", "timings": "timings.json", "config": "config.json"}


@dataclass
class Written(WriterCommitMessage):
    """Files of a task that wait to be moved: (waiting, final)."""

    moves: list[tuple[str, str]]


class _RunWriter(DataSourceWriter):
    def __init__(self, place: str, columns: list[str]):
        self.place, self.columns = place, columns

    def write(self, rows: Iterator[Any]) -> Written:
        system, root = opened(self.place)
        moves: list[tuple[str, str]] = []
        try:
            for row in rows:
                values = dict(zip(self.columns, row, strict=True))
                run = values["run_id"]
                if not run or "/" in run or run.startswith("."):
                    raise ValueError(f"no name of a run folder: {run!r}")
                system.create_dir(f"{root}/{run}", recursive=True)
                for column, name in RECORD_FILES.items():
                    if values[column] is None:
                        continue
                    waiting = f"{root}/{run}/.{name}.{uuid.uuid4().hex}.new"
                    moves.append((waiting, f"{root}/{run}/{name}"))
                    with system.open_output_stream(waiting) as f:
                        f.write(values[column].encode())
        except BaseException:
            self._clear(moves)
            raise
        return Written(moves)

    def _clear(self, moves: list[tuple[str, str]]) -> None:
        system, _ = opened(self.place)
        for waiting, _final in moves:
            if system.get_file_info(waiting).is_file:
                system.delete_file(waiting)

    def commit(self, messages: list[Any]) -> None:
        system, _ = opened(self.place)
        moves = [m for message in messages if message for m in message.moves]
        if len({final for _, final in moves}) < len(moves):
            self._clear(moves)
            raise ValueError("a run has more than one record")
        for waiting, final in moves:
            system.move(waiting, final)
        for folder in {final.rpartition("/")[0] for _, final in moves}:  # what killed tasks left
            self._clear([(f.path, "") for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith(".") and f.base_name.endswith(".new")])

    def abort(self, messages: list[Any]) -> None:
        self._clear([m for message in messages if message for m in message.moves])


class RunRecords(DataSource):
    """A sink of run records: four files in a folder for each run."""

    @classmethod
    def name(cls) -> str:
        return "run_records"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _RunWriter(self.options["path"], schema.names)


def write_run_record(records: DataFrame, folder: str) -> None:
    """Run records (run_id, commit_txt, matrix, timings, config) as texts: four files in a folder for each run; null writes none.

    Tasks write files that readers pass over; when all tasks are done each is moved over the one of its name, so that a reader
    sees the old file or the new one. A task that fails or is killed leaves all old records as they were. Only names reach the driver.
    """
    records.sparkSession.dataSource.register(RunRecords)
    records.select("run_id", *RECORD_FILES).write.format("run_records").option("path", folder).mode("append").save()


def differing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(prefix, mine, theirs) of the leaves in which two trees of tree_levels() differ."""
    leaf = lambda d, name: d.where(F.length("prefix") == F.lit(DIGITS)).select("prefix", F.col("digest").alias(name))
    return leaf(mine, "mine").join(leaf(theirs, "theirs"), "prefix", "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))
