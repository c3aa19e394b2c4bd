"""Folders of volume files as a partitioned data source: one ``<key>.npy`` file per volume.

``spark.read.format("npy_volumes")`` after :func:`register`, or :func:`scan_npy_folder`.
The driver lists names and sizes only. Files are opened in tasks: small ones many to a task; with
``planes`` set, a large one is cut by byte ranges, and a task seeks to the planes of its tiles.
A schema without ``voxels`` makes tasks read headers alone; with ``keys``, the files of these keys are
opened and nothing is listed. A filter on the key is not pushed to the listing: Spark 4.1 keeps filters
pushed to a Python source with the relation, so that a second filter of the same DataFrame would
answer for the first.

The folder must be one that pyarrow opens (local or mounted path, ``file:``, ``hdfs:``,
``s3:``, ``gs:``); for a store that only Spark reads, use :func:`cohortlake.sources.io.read_npy_volumes`.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "npy_volumes"
WHOLE = "subject string, dims array<int>, voxels array<float>"
TILES = "subject string, tile int, origin int, dims array<int>, voxels array<float>"
ARROW = {"subject": pa.string(), "tile": pa.int32(), "origin": pa.int32(), "dims": pa.list_(pa.int32()), "voxels": pa.list_(pa.float32())}
BATCH_BYTES = 16 << 20


class NpyVolumes(DataSource):
    """Options: ``path``; ``planes`` (planes of a tile, 0: whole volumes); ``keys`` (a JSON list; all files without it);
    ``partition_bytes`` (of a task) and ``open_cost`` (bytes that opening a file counts as)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TILES if int(self.options.get("planes", 0)) else WHOLE

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options, schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("npy_volumes replaces the files of the keys it writes and no others: use mode append")
        return NpyWriter(self.options["path"])


class NpyReader(DataSourceReader):
    def __init__(self, options, columns: Sequence[str]):
        self.path, self.columns = options["path"], list(columns)
        self.planes = int(options.get("planes", 0))
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.open_cost = int(options.get("open_cost", 1 << 20))
        self.keys = json.loads(options["keys"]) if "keys" in options else None
        unknown = set(self.columns) - set(ARROW) | ({"tile", "origin"} & set(self.columns) if not self.planes else set())
        if unknown:
            raise ValueError(f"npy_volumes has no columns {sorted(unknown)}")

    def partitions(self) -> list[InputPartition]:
        """``(file name, first byte, end byte)`` lists of about ``partition_bytes``; ranges count from the first voxel."""
        files, base = fs.FileSystem.from_uri(self.path)
        if self.keys is None:
            found = files.get_file_info(fs.FileSelector(base))
        else:
            found = files.get_file_info([f"{base}/{k}.npy" for k in sorted(set(self.keys)) if k and "/" not in k])
        sizes = sorted((i.base_name, i.size) for i in found if i.type == fs.FileType.File and i.extension == "npy" and i.base_name[0] not in "._")
        out, group, held = [], [], 0
        for name, size in sizes:
            if "voxels" not in self.columns:
                size = 0
            step = self.partition_bytes if self.planes else max(size, 1)
            for lo in range(0, max(size, 1), step):
                last = lo + step >= size
                cost = self.open_cost + min(step, size - lo)
                if group and held + cost > self.partition_bytes:
                    out.append(InputPartition(group))
                    group, held = [], 0
                group.append((name, lo, sys.maxsize if last else lo + step))
                held += cost
        return [*out, InputPartition(group)]  # an empty folder has one part without files

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name, lo, hi in partition.value:
            with files.open_input_file(f"{base}/{name}") as f:
                for row in self._rows(f, name[:-len(".npy")], lo, hi):
                    rows.append(row)
                    held += 4 * len(row.get("voxels", ())) + 64
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], ARROW[c]) for c in self.columns], names=self.columns)

    def _rows(self, f, subject: str, lo: int, hi: int) -> Iterator[dict]:
        version = np.lib.format.read_magic(f)
        header = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        if version not in header:
            raise ValueError(f"{subject}.npy: format version {version} is not supported")
        shape, fortran, dtype = header[version](f)
        if dtype.hasobject:
            raise ValueError(f"{subject}.npy: holds objects, not numbers")
        body, wanted = f.tell(), "voxels" in self.columns

        def voxels(first: int, count: int, whole: np.ndarray | None = None) -> np.ndarray:
            """Voxels ``first .. first + count - 1`` in C order."""
            if whole is not None:
                return whole[first:first + count]
            f.seek(body + first * dtype.itemsize)
            raw = f.read(count * dtype.itemsize)
            if len(raw) != count * dtype.itemsize:
                raise ValueError(f"{subject}.npy: ends before its last voxel")
            return np.frombuffer(raw, dtype).astype(np.float32)

        size = int(np.prod(shape, dtype=np.int64))
        # columns first: a plane is spread over the whole file
        turned = voxels(0, size).reshape(shape[::-1]).T.ravel() if fortran and wanted and len(shape) > 1 else None
        if not self.planes:
            yield {"subject": subject, "dims": list(shape), **({"voxels": voxels(0, size, turned)} if wanted else {})}
            return
        dims = [d for d in shape if d != 1] or [1]
        if not size:
            return
        plane = size // dims[0]
        for tile in range(max(-(-(dims[0] - 1) // self.planes), 1)):
            origin = tile * self.planes
            if lo <= origin * plane * dtype.itemsize < hi:
                row = {"subject": subject, "tile": tile, "origin": origin, "dims": dims}
                if wanted:
                    row["voxels"] = voxels(origin * plane, min(self.planes + 1, dims[0] - origin) * plane, turned)
                yield row


class NpyWriter(DataSourceArrowWriter):
    """A file per row, under a hidden name until it is whole: an attempt that dies leaves no half volume, and its
    successor writes the same files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        for batch in iterator:
            x = {n: batch.column(n) for n in ("subject", "dims", "voxels")}
            for subject, dims, vox in zip(x["subject"].to_pylist(), x["dims"].to_pylist(), x["voxels"], strict=True):
                if not subject or "/" in subject or subject[0] in "._":
                    raise ValueError(f"{subject!r} cannot name a file")
                if dims is None or not vox.is_valid:
                    raise ValueError(f"{subject}: no volume to write")
                hidden = f"{base}/.{uuid.uuid4().hex}"
                with files.open_output_stream(hidden) as out:
                    volume = np.asarray(vox.values.to_numpy(zero_copy_only=False), dtype="<f4").reshape(dims)
                    np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(volume))
                    out.write(volume.tobytes())
                files.move(hidden, f"{base}/{subject}.npy")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        """Whole files stay: their names are those that a repeated write replaces."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyVolumes)


def write_npy_folder(df: DataFrame, path: str, key: str = "subject", dims: str = "dims", voxels: str = "voxels") -> None:
    """A file ``<key>.npy`` (float32, C order) for each row. Keys must be unique (``assert_unique``
    reports those that are not), name a file and have a volume; null voxels become NaN. Files of other keys stay."""
    register(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("subject"), F.col(dims).cast("array<int>").alias("dims"),
                     F.col(voxels).cast("array<float>").alias("voxels"))
    rows.write.format(NAME).mode("append").save(path)


def scan_npy_folder(spark: SparkSession, path: str, planes: int = 0, headers_only: bool = False,
                    keys: Sequence[str] | None = None, **options) -> DataFrame:
    """Volumes ``subject, dims, voxels`` of a folder; with ``planes``, their tiles ``subject, tile, origin, dims, voxels``
    as :func:`cohortlake.operators.arrays.volume_tiles` cuts them. ``headers_only`` leaves ``voxels`` out and unread;
    ``keys`` opens the files of these volumes alone (those there are), without a listing.

    Numbers of any type become float; an empty folder gives no rows; a volume without voxels has no tile. Files in
    Fortran order are read whole for every tile range. Names that start with a dot or an underscore are no volumes."""
    register(spark)
    schema = TILES if planes else WHOLE
    if headers_only:
        schema = schema.rsplit(",", 1)[0]
    if keys is not None:
        options["keys"] = json.dumps([str(k) for k in keys])
    return spark.read.format(NAME).schema(schema).options(planes=planes, **options).load(path)
