"""fvecs, ivecs and bvecs files as a Spark data source.

A record is a 32-bit little-endian dimension and that many little-endian values:
32-bit floats (``float``), 32-bit integers (``int``) or bytes (``byte``).  The data
source reaches local paths and the stores that Arrow knows (``hdfs://``, ``s3://``,
``gs://``); a file whose records have one length is cut at record borders and read
in parallel.  ``read_vecs`` goes through Spark's own file reader instead.

    spark.dataSource.register(VecsDataSource)
    spark.read.format("vecs").option("elementType", "float").load(path)
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = {"float": np.dtype("<f4"), "int": np.dtype("<i4"), "byte": np.dtype("u1")}
_SQL = {"float": "float", "int": "int", "byte": "int"}
SPLIT_BYTES = 64 << 20


def _kind(name: str) -> np.dtype:
    if name not in KINDS:
        raise ValueError(f"elementType must be one of {', '.join(KINDS)}, not {name!r}")
    return KINDS[name]


def decode(data: bytes, kind: str = "float") -> Iterator[np.ndarray]:
    """The vectors of a file's bytes; fails on a truncated record."""
    dtype, at = _kind(kind), 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError(f"truncated header at byte {at}")
        (dim,) = struct.unpack_from("<I", data, at)
        end = at + 4 + dim * dtype.itemsize
        if end > len(data):
            raise ValueError(f"truncated record at byte {at}")
        yield np.frombuffer(data, dtype, dim, at + 4)
        at = end


def encode(vectors, kind: str = "float") -> bytes:
    """The bytes of a file of these vectors."""
    dtype = _kind(kind)
    return b"".join(struct.pack("<I", len(v)) + np.asarray(v).astype(dtype).tobytes() for v in vectors)


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    start: int
    stop: int
    dim: int | None = None


def _store(path: str):
    """File system and path of a local path or URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _element_type(options: dict) -> str:
    return options.get("elementtype", options.get("elementType", "float"))


class VecsReader(DataSourceReader):
    """Reads files by byte ranges; with option ``split`` false, each file whole."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], _element_type(options)
        self.split = options.get("split", "true").lower() != "false"

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes, by name; hidden files are left out."""
        from pyarrow.fs import FileSelector, FileType

        fs, path = _store(self.path)
        info = fs.get_file_info(path)
        found = fs.get_file_info(FileSelector(path)) if info.type == FileType.Directory else [info]
        if any(f.type == FileType.NotFound for f in found):
            raise FileNotFoundError(self.path)
        return sorted((f.path, f.size) for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))

    def partitions(self):
        fs, _ = _store(self.path)
        parts, before = [], 0
        for path, size in self.files():
            if not size:
                continue
            with fs.open_input_file(path) as f:
                (dim,) = struct.unpack("<I", f.read(4).ljust(4, b"\0"))
                record = 4 + dim * _kind(self.kind).itemsize
                even = size % record == 0
                if even and size <= SPLIT_BYTES:  # a small file is looked through at once
                    f.seek(0)
                    even = bool((np.ascontiguousarray(np.frombuffer(f.read(), np.uint8).reshape(-1, record)[:, :4]).view("<u4") == dim).all())
                if even and self.split:
                    step = max(1, SPLIT_BYTES // record)
                    parts += [_Range(path, before + at, at * record, min(size, (at + step) * record), dim) for at in range(0, size // record, step)]
                    before += size // record
                else:
                    parts.append(_Range(path, before, 0, size))
                    f.seek(0)
                    before += sum(1 for _ in decode(f.read(), self.kind))
        return parts or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range):
        if partition.stop == partition.start:
            return
        with _store(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.start)
            data = f.read(partition.stop - partition.start)
        if partition.dim is None:
            for i, v in enumerate(decode(data, self.kind)):
                yield partition.first + i, len(v), v.tolist()
            return
        dtype = _kind(self.kind)
        records = np.frombuffer(data, np.uint8).reshape(-1, 4 + partition.dim * dtype.itemsize)
        if not (np.ascontiguousarray(records[:, :4]).view("<u4") == partition.dim).all():
            raise ValueError(f"{partition.path} has records of several lengths; read it with option split false")
        values = np.ascontiguousarray(records[:, 4:]).view(dtype) if partition.dim else np.empty((len(records), 0), dtype)
        for i, v in enumerate(values.tolist()):
            yield partition.first + i, partition.dim, v


@dataclass
class _Written(WriterCommitMessage):
    path: str


class VecsWriter(DataSourceWriter):
    """One file per partition, in the order of the rows; readers take the files by name."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.kind = options["path"], _element_type(options)
        self.at, self.overwrite = schema.names.index("embedding"), overwrite
        fs, path = _store(self.path)
        fs.create_dir(path, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = _store(self.path)
        # A repeated task writes another hidden file; commit gives one of them its name.
        hidden = f"{path}/.part-{context.partitionId():05d}.vecs.{context.taskAttemptId()}"
        with fs.open_output_stream(hidden) as f:
            for row in iterator:
                f.write(encode([row[self.at]], self.kind))
        return _Written(hidden)

    def commit(self, messages):
        from pyarrow.fs import FileSelector, FileType

        fs, path = _store(self.path)
        if self.overwrite:
            # What stood here goes only now that all new files are written.
            new = {m.path.rpartition("/")[2] for m in messages if m is not None}
            for old in fs.get_file_info(FileSelector(path)):
                if old.base_name not in new:
                    (fs.delete_dir if old.type == FileType.Directory else fs.delete_file)(old.path)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                fs.move(m.path, f"{folder}/{name[1:].rpartition('.')[0]}")

    def abort(self, messages):
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class VecsDataSource(DataSource):
    """Format ``vecs``: ``vec_id, dim, embedding``."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        kind = self.options.get("elementType", "float")
        _kind(kind)
        return f"vec_id bigint, dim int, embedding array<{_SQL[kind]}>"

    def reader(self, schema) -> VecsReader:
        return VecsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VecsWriter:
        return VecsWriter(dict(self.options), schema, overwrite)


def read_vecs(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """Vectors of files in any store that Spark reads: ``vec_id, dim, embedding``.

    Each file is one record of Spark's binary reader, so files should be of moderate size, as
    ``write_vecs`` makes them; the data source ``vecs`` splits large local files.  Ids number the
    vectors in the order of file names.
    """
    import pandas as pd

    def explode(batches):
        for batch in batches:
            for path_, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(path_, i, len(v), v.tolist()) for i, v in enumerate(decode(data, kind))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "at", "dim", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(explode, f"path string, at long, dim int, embedding array<{_SQL[kind]}>")
    sizes = rows.groupBy("path").count()
    before, names = 0, []
    for r in sizes.orderBy("path").collect():
        names.append((r["path"], before))
        before += r["count"]
    starts = spark.createDataFrame(names, "path string, start long")
    return rows.join(F.broadcast(starts), "path").select((F.col("start") + F.col("at")).alias("vec_id"), "dim", "embedding")


def write_vecs(rows: DataFrame, path: str, kind: str = "float", order: str = "vec_id") -> None:
    """Write ``embedding`` ordered by ``order``: a range sort, one file per partition."""
    rows.sparkSession.dataSource.register(VecsDataSource)
    rows.orderBy(order).select("embedding").write.format("vecs").option("elementType", kind).mode("overwrite").save(path)


def write_matrix(matrix: np.ndarray, path: str, kind: str = "float") -> None:
    """Write a small matrix, such as centroids, as one file."""
    fs, place = _store(path)
    with fs.open_output_stream(place) as f:
        f.write(encode(matrix, kind))
