"""Arrays in files as tables: a Spark data source that reads byte ranges in many tasks.

A .npy file, an uncompressed member of an .npz archive or a raw file of known shape is cut
into ranges of its outermost dimension; each task reads its own range in pieces of a few
megabytes, so no file or array is ever whole in memory. Filters on dimensions are pushed
down: on the outermost one they leave out ranges, on the others they leave out bytes where
the gaps are wide. Compressed members cannot be cut and are streamed by one task. Pickled
arrays are refused. Files are opened through Arrow's file systems (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

CHUNK = 4 << 20


def open_file(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


@dataclass
class Layout:
    """Where an array lies in its file, dims in the order of storage (outermost first)."""

    path: str
    shape: tuple[int, ...]
    dims: tuple[str, ...]
    dtype: str
    offset: int
    packed: str | None = None  # a compressed member's name

    @property
    def row_items(self) -> int:
        n = 1
        for s in self.shape[1:]:
            n *= s
        return n


def _npy_header(f) -> tuple[tuple[int, ...], bool, object]:
    import numpy as np

    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def block_paths(folder: str) -> list[str]:
    """The block-*.npy files of a folder, in order; a folder's path ends with a slash."""
    from pyarrow import fs

    folder = folder.rstrip("/")
    store, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    scheme = folder.removesuffix(inner)
    return sorted(scheme + f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("block-") and f.base_name.endswith(".npy"))


def layout_of(path: str, dims: list[str], member: str | None = None, shape: str | None = None, dtype: str = "<f4") -> Layout:
    """Layout of an array from the file's own header, or from shape ("-1,12,325": -1 from the size) and dtype for raw files."""
    import numpy as np

    packed = None
    with open_file(path) as f:
        if path.endswith(".npz"):
            with zipfile.ZipFile(f) as z:
                info = z.getinfo(member + ".npy" if member and not member.endswith(".npy") else member or z.namelist()[0])
                with z.open(info) as inner:
                    (sizes, turned, kind), skip = _npy_header(inner), inner.tell()
                packed = info.filename if info.compress_type != zipfile.ZIP_STORED else None
            f.seek(info.header_offset + 26)
            name, extra = (int.from_bytes(f.read(2), "little") for _ in range(2))
            offset = info.header_offset + 30 + name + extra + skip if packed is None else skip
        elif path.endswith(".npy"):
            (sizes, turned, kind), offset = _npy_header(f), f.tell()
        else:
            if not shape:
                raise ValueError("a raw file needs a shape")
            kind, turned, offset = np.dtype(dtype), False, 0
            sizes = [int(x) for x in shape.split(",")]
            known = int(np.prod([s for s in sizes if s >= 0]))
            sizes = tuple(f.size() // (known * kind.itemsize) if s < 0 else s for s in sizes)
            if int(np.prod(sizes)) * kind.itemsize != f.size():
                raise ValueError(f"{path} does not hold an array of {sizes}")
    if kind.hasobject:
        raise ValueError(f"{path} holds pickled objects")
    while len(sizes) > len(dims) and sizes[-1] == 1:  # a last dimension of one channel
        sizes = sizes[:-1]
    if len(sizes) != len(dims):
        raise ValueError(f"{path} has {len(sizes)} dimensions, not {len(dims)}")
    return Layout(path, tuple(sizes)[::-1] if turned else tuple(sizes), tuple(dims)[::-1] if turned else tuple(dims), kind.str, offset, packed)


def runs_of(items, gap: int) -> list[tuple[int, int]]:
    """Ranges (from, to) that cover sorted item numbers, joined where less than `gap` items lie between."""
    import numpy as np

    at = np.flatnonzero(np.diff(items) > max(gap, 1))
    return list(zip(items[np.r_[0, at + 1]].tolist(), (items[np.r_[at, len(items) - 1]] + 1).tolist())) if len(items) else []


def read_rows(f, lay: Layout, first: int, last: int, items, gap_bytes: int):
    """(array [last - first, len(items)], bytes read) of rows first to last; items are sorted places in a row."""
    import numpy as np

    kind = np.dtype(lay.dtype)
    runs = runs_of(items, gap_bytes // kind.itemsize)
    row = lay.row_items * kind.itemsize
    if runs == [(0, lay.row_items)]:
        body = f.read_at((last - first) * row, lay.offset + first * row)
        return np.frombuffer(body, kind).reshape(last - first, -1)[:, items], len(body)
    out, read = np.empty((last - first, len(items)), kind), 0
    for r in range(first, last):
        at = 0
        for a, b in runs:
            body = f.read_at((b - a) * kind.itemsize, lay.offset + r * row + a * kind.itemsize)
            n = np.searchsorted(items, b) - at
            out[r - first, at : at + n] = np.frombuffer(body, kind)[items[at : at + n] - a]
            at, read = at + n, read + len(body)
    return out, read


@dataclass
class Rows(InputPartition):
    """Rows first to last of a file, whose own first row is row `base` of the whole array."""

    first: int
    last: int
    file: int = 0
    base: int = 0


@dataclass
class Chosen:
    """What filters leave of each dimension: a range, or a set of values."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    values: dict[str, set] = field(default_factory=dict)

    def add(self, f, names: set[str]) -> bool:
        """Takes a filter; false if it is not one on a dimension."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name not in names:
            return False
        if isinstance(f, (EqualTo, In)):
            given = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[name] = self.values[name] & given if name in self.values else given
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low[name] = max(self.low.get(name, f.value), f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high[name] = min(self.high.get(name, f.value), f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def mask(self, name: str, at):
        """Which of an array of values of a dimension are wanted."""
        import numpy as np

        ok = np.ones(len(at), bool)
        if name in self.low:
            ok &= at >= self.low[name]
        if name in self.high:
            ok &= at <= self.high[name]
        return ok & np.isin(at, list(self.values[name])) if name in self.values else ok


class NdArraySource(DataSource):
    """Format `ndarray`. Options: path (a file, or a folder with a slash at its end that holds blocks of rows, block-*.npy), dims ("t,node"), member, shape, dtype, split_bytes, gap_bytes, label_<dim> (a .npy vector of longs).

    Columns: each dim (its place, or its label where it has one), for the dim `stamp` names
    its label as an extra column `label`, and value (double; NaN and infinities are null).
    """

    @classmethod
    def name(cls) -> str:
        return "ndarray"

    def schema(self) -> str:
        dims = self.options["dims"].split(",")
        return ", ".join([*(f"{d} long" for d in dims), *(["label long"] if "stamp" in self.options else []), "value double"])

    def reader(self, schema) -> DataSourceReader:
        return NdArrayReader(dict(self.options))


class NdArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.dims = options, options["dims"].split(",")
        path = options["path"]
        files = block_paths(path) if path.endswith("/") else [path]
        if not files:
            raise ValueError(f"{path} holds no blocks")
        self.lays = [layout_of(f, self.dims, options.get("member"), options.get("shape"), options.get("dtype", "<f4")) for f in files]
        self.lay = self.lays[0]
        self.rows = sum(x.shape[0] for x in self.lays)
        if any(x.shape[1:] != self.lay.shape[1:] or x.dims != self.lay.dims for x in self.lays):
            raise ValueError("blocks differ in shape")
        self.chosen = Chosen()

    def pushFilters(self, filters):
        for f in filters:
            if not self.chosen.add(f, set(self.dims)):
                yield f

    def _labels(self, dim: str, first: int = 0, last: int | None = None):
        """Values of a dimension's places first to last: its labels where it has some."""
        import numpy as np

        size = self.rows if dim == self.lay.dims[0] else self.lay.shape[self.lay.dims.index(dim)]
        last = size if last is None else last
        path = self.options.get(f"label_{dim}")
        if path is None or (path and dim == self.options.get("stamp")):
            return np.arange(first, last)
        return self._vector(path, first, last)

    def _vector(self, path: str, first: int, last: int):
        import numpy as np

        one = layout_of(path, ["i"], self.options.get("label_member") if path.endswith(".npz") else None)
        with open_file(path) as f:
            if one.packed:
                with zipfile.ZipFile(f) as z, z.open(one.packed) as inner:
                    inner.read(one.offset)
                    body = inner.read()
                return np.frombuffer(body, one.dtype)[first:last].astype(np.int64)
            return read_rows(f, one, first, last, np.zeros(1, np.int64), 0)[0][:, 0].astype(np.int64)

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows of about split_bytes, without those that no filter leaves anything of."""
        import numpy as np

        row = max(1, self.lay.row_items * np.dtype(self.lay.dtype).itemsize)
        step = max(1, int(self.options.get("split_bytes", 64 << 20)) // row)
        outer = self.lay.dims[0]
        low, high = 0, self.rows - 1
        if f"label_{outer}" not in self.options or outer == self.options.get("stamp"):
            low, high = max(low, self.chosen.low.get(outer, low)), min(high, self.chosen.high.get(outer, high))
            if outer in self.chosen.values:
                wanted = sorted(v for v in self.chosen.values[outer] if v is not None)
                low, high = (max(low, wanted[0]), min(high, wanted[-1])) if wanted else (1, 0)
        out, base = [], 0
        for n, lay in enumerate(self.lays):
            a, z = max(low - base, 0), min(high - base + 1, lay.shape[0])
            if a < z:
                out += [Rows(0, lay.shape[0], n, base)] if lay.packed else [Rows(x, min(x + step, z), n, base) for x in range(a, z, step)]
            base += lay.shape[0]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if partition is None:  # what Spark asks for where no range is left
            return
        lay = self.lays[partition.file]
        inner = np.indices(lay.shape[1:]).reshape(len(lay.shape) - 1, -1) if len(lay.shape) > 1 else np.zeros((0, 1), np.int64)
        values = {d: self._labels(d) for d in lay.dims[1:]}
        ok = np.ones(lay.row_items, bool)
        for d, at in zip(lay.dims[1:], inner):
            ok &= self.chosen.mask(d, values[d])[at]
        items = np.flatnonzero(ok)
        if not len(items):
            return
        columns = {d: values[d][at[items]] for d, at in zip(lay.dims[1:], inner)}
        gap = int(self.options.get("gap_bytes", 1 << 16))
        step = max(1, CHUNK // max(1, 8 * len(items)))
        with open_file(lay.path) as f:
            stream = self._stream(f, lay, partition, items, step) if lay.packed else ((a, read_rows(f, lay, a, min(a + step, partition.last), items, gap)[0]) for a in range(partition.first, partition.last, step))
            for at, block in stream:
                yield from self._batches(partition.base + at, block, columns)

    def _stream(self, f, lay: Layout, partition: Rows, items, step: int):
        import numpy as np

        kind = np.dtype(lay.dtype)
        with zipfile.ZipFile(f) as z, z.open(lay.packed) as inner:
            inner.read(lay.offset)
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                body = inner.read(n * lay.row_items * kind.itemsize)
                yield a, np.frombuffer(body, kind).reshape(n, -1)[:, items]

    def _batches(self, at: int, block, columns) -> Iterator[pa.RecordBatch]:
        import numpy as np

        outer, rows = self.lay.dims[0], len(block)
        names = self._labels(outer, at, at + rows)
        keep = self.chosen.mask(outer, names)
        if not keep.any():
            return
        block, width = block[keep].astype(np.float64), block.shape[1]
        cols = {outer: np.repeat(names[keep], width)} | {d: np.tile(v, int(keep.sum())) for d, v in columns.items()}
        out = [pa.array(cols[d].astype(np.int64)) for d in self.dims]
        stamp = self.options.get("stamp")
        if stamp == outer:
            out.append(pa.array(np.repeat(self._vector(self.options[f"label_{stamp}"], at, at + rows)[keep], width)))
        elif stamp:
            out.append(pa.array(self._vector(self.options[f"label_{stamp}"], 0, self.lay.shape[self.lay.dims.index(stamp)])[cols[stamp]]))
        flat = block.reshape(-1)
        out.append(pa.array(flat, mask=~np.isfinite(flat)))
        yield pa.RecordBatch.from_arrays(out, names=[*self.dims, *(["label"] if stamp else []), "value"])


def read_ndarray(spark: SparkSession, path: str, dims: list[str], **options) -> DataFrame:
    """An array file as rows (dims..., value); see NdArraySource. Switches filter push-down of Python data sources on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NdArraySource)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format("ndarray").options(path=path, dims=",".join(dims), **given).load()


def read_series_folder(spark: SparkSession, folder: str, ids: bool = True, **options) -> DataFrame:
    """(t, node, ts, value) of a folder with targets.npy [T, N], unix_timestamps.npy and, with ids, node_ids.npy."""
    folder = folder.rstrip("/")
    labels = {"label_t": f"{folder}/unix_timestamps.npy", "stamp": "t"} | ({"label_node": f"{folder}/node_ids.npy"} if ids else {})
    d = read_ndarray(spark, f"{folder}/targets.npy", ["t", "node"], **labels, **options)
    return d.select("t", "node", F.timestamp_seconds("label").alias("ts"), "value")


def read_series_archive(spark: SparkSession, path: str, values: str = "targets", times: str = "unix_timestamps", **options) -> DataFrame:
    """(t, node, ts, value) of an archive of unix times [T] and values [T, N]; without compression it is read by many tasks."""
    d = read_ndarray(spark, path, ["t", "node"], member=values, label_t=path, label_member=times, stamp="t", **options)
    return d.select("t", "node", F.timestamp_seconds("label").alias("ts"), "value")


def write_ndarray_blocks(panel: DataFrame, folder: str, width: int, block_rows: int = 4096, dtype: str = "<f4") -> DataFrame:
    """Writes a panel (t long, node long, value), both counted from 0, as arrays [block_rows, width] in files block-*.npy; returns their manifest (path, first, rows).

    Each block is written by the task that has its rows, whole and under its own name, so a
    task that runs again leaves the same files. Cells that the panel lacks are NaN. The last
    block ends at the last t that it holds; a block without any row is not written, so t must have none missing for whole blocks.
    """
    folder = folder.rstrip("/")

    def save(key, pdf):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        first = int(key[0]) * block_rows
        rows = block_rows if pdf["more"].iloc[0] else int(pdf["t"].max()) - first + 1
        m = np.full((rows, width), np.nan, np.dtype(dtype))
        m[pdf["t"].to_numpy() - first, pdf["node"].to_numpy()] = pdf["value"].to_numpy(dtype=float)
        path = f"{inner}/block-{int(key[0]):09d}.npy"
        with store.open_output_stream(path) as f:
            np.save(f, m)
        return pd.DataFrame({"path": [path], "first": [first], "rows": [rows]})

    b = F.floor(F.col("t") / block_rows)
    last = panel.agg(F.max(b).alias("z"))  # one row
    dealt = panel.select("t", "node", "value", b.alias("block")).crossJoin(F.broadcast(last)).withColumn("more", F.col("block") < F.col("z")).drop("z")
    written = dealt.groupBy("block").applyInPandas(save, "path string, first long, rows long")
    return panel.sparkSession.createDataFrame(written.collect(), written.schema)  # runs the writing; a row a block
