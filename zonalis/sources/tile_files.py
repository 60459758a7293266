"""Trees of binary tile files as a Spark data source, read and written: format ``gridtiles``.

``<root>/<grp>/<var>/[std_][level_][year_]mm.bin[.gz]`` holds one tile, rows of latitude from the first, as little-endian float32
(``f32``) or gzipped 16-bit codes (``f16-gz``). ``meta.json`` beside the tiles has the encoding, the levels and, for codes, the range
of every tile; ``manifest.json`` at the root pools them.

Reading plans whole tiles: filters on grp, var, kind, level, year and month pick files before any is opened. With the option
``rows`` = ``tiles`` a row is a tile (``values`` array<float>), else a cell. Tasks write their tiles aside under names of their own;
only the commit moves those of successful attempts into place and then records their ranges. An aborted write leaves the tree as it was.

The root is a path or a URI that Arrow's file systems open; on a cluster all hosts must see it. A tile has the size of the grid, so
a task holds one at a time. Missing cells are NULL. Options: path, nlat, nlon, rows, tilesPerPartition; for writing encoding,
gzipLevel. Mode ``append`` refuses tiles that exist; ``overwrite`` replaces the tiles it writes and no other.
"""

from __future__ import annotations

import gzip
import json
import operator
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from zonalis.constants import MISSING_CODE, QUANT_STEPS
from zonalis.session import ship_package

FORMAT = "gridtiles"
KEYS = ("grp", "var", "kind", "level", "year", "month")
TILE_KEYS = "grp string, var string, kind string, level int, year int, month int"
CELLS = f"{TILE_KEYS}, lat_idx int, lon_idx int, value double"
TILES = f"{TILE_KEYS}, values array<float>"
CODES, FLOATS = "f16-gz", "f32"
ENDING = {CODES: ".bin.gz", FLOATS: ".bin"}
NAME = re.compile(r"(std_)?((?:\d+_)*)(\d{2})\.bin(\.gz)?$")
STAGED = "_staged"


def opened(root: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(root) if "://" in root else (afs.LocalFileSystem(), root.removeprefix("file:").rstrip("/"))


def _json(fs: afs.FileSystem, path: str) -> dict | None:
    if fs.get_file_info(path).type != afs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _put(fs: afs.FileSystem, path: str, content: bytes) -> None:
    """A file that appears whole."""
    with fs.open_output_stream(f"{path}.new") as f:
        f.write(content)
    fs.move(f"{path}.new", path)


@dataclass(frozen=True)
class Tile:
    path: str
    grp: str
    var: str
    kind: str
    level: int | None
    year: int | None
    month: int
    span: tuple[float, float] | None           # range of the codes; None: float32


def tile_name(kind: str, level: int | None, year: int | None, month: int) -> str:
    return ("std_" if kind == "std" else "") + "".join(f"{x}_" for x in (level, year) if x is not None) + f"{month:02d}"


def tiles_of(fs: afs.FileSystem, root: str, grp: str, var: str, meta: dict, names: Iterable[str]) -> list[Tile]:
    """The tiles of a variable in its present encoding, by their names."""
    encoding = meta.get("encoding", FLOATS)
    out = []
    for name in names:
        m = NAME.match(name)
        if not m or name != name[:m.end(3)] + ENDING[encoding]:
            continue
        numbers = [int(x) for x in m[2].split("_") if x]
        if len(numbers) > 2:
            continue
        level, year = numbers if len(numbers) == 2 else (numbers[0], None) if numbers and meta.get("levels") else (None, numbers[0] if numbers else None)
        stem = name[:m.end(3)]
        if encoding == CODES and stem not in meta["tiles"]:
            continue                                       # moved in by a write that never ended
        span = (meta["tiles"][stem]["vmin"], meta["tiles"][stem]["vmax"]) if encoding == CODES else None
        out.append(Tile(f"{root}/{grp}/{var}/{name}", grp, var, "std" if m[1] else "mean", level, year, int(m[3]), span))
    return out


def folders(fs: afs.FileSystem, root: str) -> list[tuple[str, str, dict]]:
    """(grp, var, meta) of every variable with a meta.json."""
    found = fs.get_file_info(afs.FileSelector(root, recursive=True, allow_not_found=True))
    at = sorted(i.path for i in found if i.base_name == "meta.json" and f"/{STAGED}/" not in i.path)
    return [(*p.split("/")[-3:-1], _json(fs, p)) for p in at]


def encoded(values: np.ndarray, encoding: str, level: int = 9) -> tuple[bytes, float | None, float | None]:
    """Bytes of a tile and the range of its codes: (0, 1) without values, one wide for a constant."""
    if encoding == FLOATS:
        return values.astype("<f4").tobytes(), None, None
    there = np.isfinite(values)
    low, high = (float(values[there].min()), float(values[there].max())) if there.any() else (0.0, 1.0)
    if high - low < 1e-12:
        high = low + 1.0
    q = np.full(values.shape, MISSING_CODE, "<u2")
    q[there] = np.rint((values[there] - low) / (high - low) * QUANT_STEPS).astype("<u2")
    return gzip.compress(q.tobytes(), level, mtime=0), low, high


def decoded(content: bytes, span: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing) of a tile."""
    if span is None:
        v = np.frombuffer(content, "<f4").astype(float)
        return v, ~np.isfinite(v)
    q = np.frombuffer(gzip.decompress(content), "<u2")
    return span[0] + q * (span[1] - span[0]) / QUANT_STEPS, q == MISSING_CODE


# reading ---------------------------------------------------------------------------------------
COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt,
           ds.LessThanOrEqual: operator.le}


def passes(tile: Tile, f: ds.Filter) -> bool:
    value = getattr(tile, f.attribute[0])
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    return value in f.value if isinstance(f, ds.In) else f.value is not None and COMPARE[type(f)](value, f.value)


class TilePartition(ds.InputPartition):
    def __init__(self, tiles: list[Tile]):
        super().__init__(len(tiles))
        self.tiles = tiles


class TileReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.nlat, self.nlon = options["path"], int(options["nlat"]), int(options["nlon"])
        self.whole = options.get("rows", "cells") == "tiles"
        self.each = int(options.get("tilesPerPartition", 16))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in KEYS and type(f) in (*COMPARE, ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[TilePartition]:
        fs, root = opened(self.root)
        tiles: list[Tile] = []
        for grp, var, meta in folders(fs, root):
            probe = Tile("", grp, var, "", None, None, 0, None)
            if all(passes(probe, f) for f in self.filters if f.attribute[0] in ("grp", "var")):
                names = [i.base_name for i in fs.get_file_info(afs.FileSelector(f"{root}/{grp}/{var}"))]
                tiles += [t for t in tiles_of(fs, root, grp, var, meta, sorted(names)) if all(passes(t, f) for f in self.filters)]
        return [TilePartition(tiles[k:k + self.each]) for k in range(0, len(tiles), self.each)] or [TilePartition([])]

    def read(self, partition: TilePartition) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        n = self.nlat * self.nlon
        lat, lon = (pa.array(x.astype(np.int32)) for x in np.divmod(np.arange(n), self.nlon))
        for t in partition.tiles:
            with fs.open_input_stream(t.path, compression=None) as f:
                v, missing = decoded(f.read(), t.span)
            if len(v) != n:
                raise ValueError(f"{t.path}: {len(v)} values, expected {n}")
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            if self.whole:
                one = pa.array([pa.array(v.astype(np.float32), mask=missing)], pa.list_(pa.float32()))
                cols, names = [pa.array([getattr(t, k)], x) for k, x in zip(KEYS, types)] + [one], [*KEYS, "values"]
            else:
                keys = [pa.repeat(pa.scalar(getattr(t, k), x), n) for k, x in zip(KEYS, types)]
                cols, names = keys + [lat, lon, pa.array(v, mask=missing)], [*KEYS, "lat_idx", "lon_idx", "value"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


# writing ---------------------------------------------------------------------------------------
@dataclass
class Written(ds.WriterCommitMessage):
    """(staged file, grp, var, level, name without ending, range) of the tiles of one task."""

    files: list[tuple]


class TileWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        missing = [c for c in (*KEYS, "values") if c not in schema.names]
        if missing:
            raise ValueError(f"{FORMAT} writes rows of ({TILES}); missing: {', '.join(missing)}")
        self.root, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.n = int(options["nlat"]) * int(options["nlon"])
        self.encoding, self.level = options.get("encoding", CODES), int(options.get("gzipLevel", 9))
        if self.encoding not in ENDING:
            raise ValueError(f"encoding is one of {', '.join(ENDING)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.root)
        aside = f"{root}/{STAGED}/{self.run}/{uuid.uuid4().hex}"
        fs.create_dir(aside, recursive=True)
        files = []
        for batch in iterator:
            keys = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in KEYS]
            values = batch.column(batch.schema.get_field_index("values"))
            for (grp, var, kind, level, year, month), v in zip(zip(*keys), values):
                v = v.values.to_numpy(zero_copy_only=False).astype(float)          # missing becomes NaN
                if len(v) != self.n:
                    raise ValueError(f"a tile of {var} has {len(v)} values, expected {self.n}")
                content, low, high = encoded(v, self.encoding, self.level)
                path = f"{aside}/{len(files)}"
                with fs.open_output_stream(path, compression=None) as f:
                    f.write(content)
                level = level or None                      # a surface field has no level in its name
                files.append((path, grp, var, level, tile_name(kind, level, year, month), low, high))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.root)
        by: dict[tuple[str, str], list[tuple]] = {}
        for m in messages:
            for f in m.files if m else []:
                by.setdefault((f[1], f[2]), []).append(f)
        for (grp, var), files in by.items():
            folder, names = f"{root}/{grp}/{var}", [f[4] for f in files]
            if len(set(names)) < len(names):
                raise ValueError(f"a tile of {grp}/{var} came twice")
            there = [i.base_name for i in fs.get_file_info([f"{folder}/{n}{ENDING[self.encoding]}" for n in names]) if i.type == afs.FileType.File]
            if there and not self.overwrite:
                raise FileExistsError(f"{folder}/{there[0]} exists; mode overwrite replaces it")
        for (grp, var), files in by.items():
            folder = f"{root}/{grp}/{var}"
            fs.create_dir(folder, recursive=True)
            for path, *_, name, _, _ in files:
                fs.move(path, f"{folder}/{name}{ENDING[self.encoding]}")
            _record(fs, folder, self.encoding, files)
        fs.delete_dir(f"{root}/{STAGED}/{self.run}")
        refresh_manifest(self.root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.root)
        if fs.get_file_info(f"{root}/{STAGED}/{self.run}").type == afs.FileType.Directory:
            fs.delete_dir(f"{root}/{STAGED}/{self.run}")


def _record(fs: afs.FileSystem, folder: str, encoding: str, files: list[tuple]) -> None:
    """Bring the variable's meta.json up to date with tiles that were moved in."""
    meta = _json(fs, f"{folder}/meta.json") or {}
    ranges = meta.get("tiles", {}) if meta.get("encoding") == CODES else {}
    meta["encoding"] = encoding
    if encoding == CODES:
        meta |= {"nan_sentinel": MISSING_CODE, "quantization_levels": QUANT_STEPS + 1,
                 "tiles": ranges | {f[4]: {"vmin": f[5], "vmax": f[6]} for f in files}}
    else:
        meta.pop("tiles", None)
    levels = sorted(set(meta.get("levels") or []) | {f[3] for f in files if f[3] is not None})
    if levels:
        meta["levels"] = levels
    _put(fs, f"{folder}/meta.json", json.dumps(meta, indent=1, sort_keys=True).encode())


def refresh_manifest(root: str) -> None:
    """Pool the metas of all variables at the root."""
    fs, base = opened(root)
    groups: dict[str, dict] = {}
    for grp, var, meta in folders(fs, base):
        groups.setdefault(grp, {})[var] = meta
    _put(fs, f"{base}/manifest.json", json.dumps({"groups": groups}, indent=1, sort_keys=True).encode())


class GridTiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TILES if self.options.get("rows", "cells") == "tiles" else CELLS

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed into the planning of files."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridTiles)
