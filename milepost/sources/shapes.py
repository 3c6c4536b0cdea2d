"""Bare shapefiles as a Spark data source: layers that many tasks read and write.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").load("file:///data/roads.shp")

The index (.shx) holds the place of every shape and the records of the table
(.dbf) are all of one length, so a task reads its range of records from all three
files and nothing else.  Planning reads the sizes of the files and the header of
the table.  ``.schema(...)`` names the columns wanted; the others, the geometry
among them, are then not decoded.

Defined results: a record without a shape has a null geometry and a shape without
a record null columns; deleted records are left out; a column of ``.schema(...)``
that the table lacks is null; without a .dbf there is the geometry alone.  A folder is the layers in it, with the
columns of the first by name.

Writing makes a folder of layers, one or more a task: a task holds one of about
``rangeBytes``, puts it below ``_parts``, and the layers of the tasks that count
are moved into the folder once all are there.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from . import formats

#: Bytes of .shp and .dbf that a task reads, about.
RANGE_BYTES = 64 << 20
#: Bytes of shapes that are held at a time, one shape at least.
HELD_BYTES = 4 << 20
#: Records that are held at a time.
HELD_ROWS = 4096
_HEADER = 100


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it.  Names in local paths are
    as they are written, not percent-encoded."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _size(path: str) -> int:
    system, inner = opened(path)
    return system.get_file_info(inner).size or 0


class _Bytes:
    """Ranges of a file."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)

    def __call__(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)


def _table(dbf: str | None) -> tuple[list[tuple[str, str, int]], int, int, int]:
    """Fields, number of records, size of the header and of a record."""
    if not dbf:
        return [], 0, 0, 0
    read = _Bytes(dbf)
    header = struct.unpack_from("<H", read(0, 32), 8)[0]
    return formats._dbf_fields(read(0, header))


class ShapefileSource(DataSource):
    """Options: ``path`` (the .shp); ``shx`` and ``dbf``, where they are not the
    path with another ending (``dbf`` may be empty: no table); ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _layers(self) -> list[Layer]:
        path = self.options["path"]
        if path.lower().endswith(".shp"):
            stem = path.rpartition(".")[0]
            return [Layer(path, self.options.get("shx", f"{stem}.shx"), self.options.get("dbf", f"{stem}.dbf") or None)]
        system, inner = opened(path)
        names = sorted(f.base_name[:-4] for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.endswith(".shp"))
        if not names:
            raise FileNotFoundError(f"no .shp in {path}")
        return [Layer(*(f"{path.rstrip('/')}/{n}.{ending}" for ending in ("shp", "shx", "dbf"))) for n in names]

    def schema(self) -> T.StructType:
        kinds = [T.StructField(n, T.DoubleType() if k in "NF" else T.StringType()) for n, k, _ in _table(self._layers()[0].dbf)[0]]
        return T.StructType([*kinds, T.StructField("geometry", formats.GEOMETRY)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._layers(), schema, int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("layers are added to a folder, none is replaced: mode append")
        return _Writer(self.options["path"].rstrip("/"), schema, json.loads(self.options["width"]), self.options.get("prj", ""), int(self.options.get("rangeBytes", RANGE_BYTES)))


@dataclass
class Layer:
    """The paths of a layer's files."""

    shp: str
    shx: str
    dbf: str | None


class _Range(InputPartition):
    """Records of a layer from ``start`` up to ``end``."""

    def __init__(self, layer: Layer, start: int, end: int):
        self.layer, self.start, self.end = layer, start, end


class _Reader(DataSourceReader):
    def __init__(self, layers: list[Layer], schema: T.StructType, range_bytes: int):
        self.layers, self.schema, self.range_bytes = layers, schema, range_bytes

    def partitions(self) -> list[InputPartition]:
        return [part for layer in self.layers for part in self._ranges(layer)]

    def _ranges(self, layer: Layer) -> list[InputPartition]:
        records = max((_size(layer.shx) - _HEADER) // 8, _table(layer.dbf)[1])
        size = _size(layer.shp) + (_size(layer.dbf) if layer.dbf else 0)
        tasks = max(1, min(records, -(-size // self.range_bytes)))
        ends = [records * n // tasks for n in range(tasks + 1)]
        return [_Range(layer, a, b) for a, b in zip(ends, ends[1:])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for start in range(partition.start, partition.end, HELD_ROWS):
            yield from self._rows(partition.layer, start, min(start + HELD_ROWS, partition.end))

    def _rows(self, layer: Layer, start: int, end: int) -> Iterator[pa.RecordBatch]:
        wanted = {f.name for f in self.schema}
        records = self._records(layer.dbf, start, end)
        held, size = [], 0
        for n, (shape, length) in enumerate(self._shapes(layer, start, end) if "geometry" in wanted else ((None, 0) for _ in range(start, end))):
            if records[n] is None:
                continue
            held.append({**records[n], "geometry": shape})
            size += length
            if size > HELD_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        value = lambda r, f: str(r[f.name]) if isinstance(f.dataType, T.StringType) and r.get(f.name) is not None else r.get(f.name)
        return pa.RecordBatch.from_arrays([pa.array([value(r, f) for r in rows], to_arrow_type(f.dataType)) for f in self.schema], names=self.schema.names)

    def _records(self, dbf: str | None, start: int, end: int) -> list[dict | None]:
        """The table's values by place; none for a deleted record."""
        fields, count, header, width = _table(dbf)
        last = max(start, min(end, count))
        out: list[dict | None] = []
        if last > start:
            wanted = {f.name for f in self.schema}
            data = _Bytes(dbf)(header + start * width, (last - start) * width)
            out = [formats.dbf_record(data[n * width : (n + 1) * width], fields, wanted) for n in range(last - start)]
        return out + [{}] * (end - start - len(out))

    def _shapes(self, layer: Layer, start: int, end: int) -> Iterator[tuple[dict | None, int]]:
        """Geometries by place and their sizes in bytes.  Shapes that lie in the
        order of the index are read together."""
        index = _Bytes(layer.shx)(_HEADER + 8 * start, 8 * (end - start))
        places = [(2 * at, 2 * size) for at, size in struct.iter_unpack(">2i", index[: len(index) // 8 * 8])]
        read, data, begin = _Bytes(layer.shp), b"", 0
        for n, (at, size) in enumerate(places):
            if not begin <= at <= at + 8 + size <= begin + len(data):
                begin, stop = at, at + 8 + size
                for later, more in places[n + 1 :]:
                    if later < stop or later + 8 + more - begin > HELD_BYTES:
                        break
                    stop = later + 8 + more
                data = read(begin, stop - begin)
            yield formats._shape(data[at - begin + 8 : at - begin + 8 + size]) if size >= 4 else None, size
        for _ in range(end - start - len(places)):
            yield None, 0


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, width: dict[str, int], prj: str, range_bytes: int):
        self.path, self.schema, self.width, self.prj, self.range_bytes = path, schema, width, prj, range_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        names = [f.name for f in self.schema if f.name != "geometry"]
        numeric = {f.name for f in self.schema if isinstance(f.dataType, T.NumericType)}
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/_parts", recursive=True)
        made = lambda: formats.Layer(names, numeric, self.width, self.prj)
        layer, written = made(), []

        def put() -> None:
            # a name of this attempt's own
            written.append(f"part-{uuid.uuid4().hex}")
            for ending, content in layer.files().items():
                with system.open_output_stream(f"{inner}/_parts/{written[-1]}.{ending}") as f:
                    f.write(content)

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                layer.add(row["geometry"], [formats.dbf_text(row[c], c in numeric) for c in names])
                if len(layer.shp) + len(layer.dbf) >= self.range_bytes:
                    put()
                    layer = made()
        if layer.rows:
            put()
        return _Written(written)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            # the .shp, by which a layer is found, comes last
            for ending in ("prj", "cpg", "dbf", "shx", "shp"):
                system.move(f"{inner}/_parts/{name}.{ending}", f"{inner}/{name}.{ending}")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = opened(self.path)
        if system.get_file_info(f"{inner}/_parts").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_parts")
