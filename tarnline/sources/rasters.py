"""Raster files as tables, for elevation: tiles (bounds, resolution, size), blocks, and pixels (tile_id, row, col, value).

Reads GeoTIFF files of one band in strips or tiles, uncompressed, deflated, LZW or PackBits, with or without a horizontal or
floating-point predictor, and ESRI ASCII grids. tile_index and pixels take whole files through Spark's binary reader.

block_index reads headers only and lists every block of every file with its place and bytes. sample_blocks joins points to
that list and decodes only the blocks they fall into; RasterPixels is a data source that plans one partition for each row of
blocks and leaves those outside a pushed box unread. Both read ranges of files, by way of Arrow's file systems. Files that can't be read are left out of all tables but skipped, which names them.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

TILE = "tile_id string, west double, south double, east double, north double, res double, width int, height int, nodata double"
PIXEL = "tile_id string, row long, col long, value double"
BLOCK = f"{TILE}, epsg int, path string, block_row int, block_col int, block_height int, block_width int, start long, bytes long, dtype string, packed int, predictor int"
PLACED = "tile_id string, row long, col long, x double, y double, value double"
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
#: Bytes of a file read to find its header; what a header names beyond them is read apart.
HEAD_BYTES = 16_384
#: Ways of packing that are known (fixed values): none, LZW, deflate (two numbers), PackBits.
PACKED = (1, 5, 8, 32946, 32773)
UNREADABLE = (ValueError, KeyError, IndexError, struct.error, zlib.error, OSError, TypeError)
#: Groups that the points of one block are dealt out to at most; each group decodes the block once.
SALT = 8


class Header(NamedTuple):
    west: float
    south: float
    east: float
    north: float
    res: float
    width: int
    height: int
    nodata: float
    epsg: int | None
    block_height: int
    block_width: int
    starts: tuple[int, ...]
    sizes: tuple[int, ...]
    dtype: str
    packed: int
    predictor: int

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)


def _tags(file) -> dict[int, tuple]:
    """The tags of the first image of a TIFF file (anything that seeks and reads)."""
    head = file.read(HEAD_BYTES)

    def part(at: int, n: int) -> bytes:
        if at + n <= len(head):
            return head[at : at + n]
        file.seek(at)
        return file.read(n)

    end = {b"II": "<", b"MM": ">"}[head[:2]]
    magic, at = struct.unpack(end + "HI", head[2:8])
    if magic != 42:
        raise ValueError("not a TIFF file")
    (n,) = struct.unpack(end + "H", part(at, 2))
    rows = part(at + 2, 12 * n)
    out: dict[int, tuple] = {0: (end,)}
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", rows, 12 * i)
        if (code := _TYPES.get(kind)) is None:
            continue
        size = struct.calcsize(end + code) * count
        raw = rows[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else part(struct.unpack_from(end + "I", rows, 12 * i + 8)[0], size)
        values = struct.unpack(f"{end}{count}{code}", raw)
        out[tag] = (b"".join(values),) if kind == 2 else values
    return out


def _epsg(keys: tuple) -> int | None:
    """The code of the projected or else the geographic system, of a directory of geographic keys."""
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    return named.get(3072) or named.get(2048)


def header(file) -> Header:
    t = _tags(file)
    width, height, end = t[256][0], t[257][0], t[0][0]
    step, tie = t[33550], t[33922]
    west, north = tie[3] - tie[0] * step[0], tie[4] + tie[1] * step[1]
    nodata = float(t[42113][0].split(b"\0")[0]) if 42113 in t else -9999.0
    bits, form, packed, predictor = (t.get(k, (v,))[0] for k, v in ((258, 8), (339, 1), (259, 1), (317, 1)))
    if packed not in PACKED or predictor not in (1, 2, 3) or t.get(277, (1,))[0] != 1:
        raise ValueError("packed in an unknown way, or of several bands")
    if 324 in t:
        block, starts, sizes = (t[323][0], t[322][0]), t[324], t[325]
    else:
        block, starts, sizes = (min(t.get(278, (height,))[0], height), width), t[273], t[279]
    return Header(west, north - height * step[1], west + width * step[0], north, step[0], width, height, nodata, _epsg(t.get(34735, ())), *block, starts, sizes, f"{end}{'uif'[form - 1]}{bits // 8}", packed, predictor)


def unlzw(body: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, the high bit first, widened one code early."""
    out = bytearray()
    table: list[bytes] = []
    last, width, at, held, bits = b"", 9, 0, 0, 0
    while at < len(body) or bits >= width:
        while bits < width:
            if at >= len(body):
                return bytes(out)
            held, bits, at = (held & 0xFFF) << 8 | body[at], bits + 8, at + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW")
        out += entry
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out)


def lzw(body: bytes) -> bytes:
    """What unlzw reads."""
    codes: list[tuple[int, int]] = [(256, 9)]
    table = {bytes((i,)): i for i in range(256)}
    size, width, now = 258, 9, b""
    for i in range(len(body)):
        grown = now + body[i : i + 1]
        if grown in table:
            now = grown
            continue
        codes.append((table[now], width))
        table[grown] = size
        size += 1
        if size + 1 > (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            codes.append((256, width))
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
        now = body[i : i + 1]
    if now:
        codes.append((table[now], width))
        size += 1
        if size + 1 > (1 << width) and width < 12:
            width += 1
    codes.append((257, width))
    held = n = 0
    for code, w in codes:
        held, n = held << w | code, n + w
    pad = -n % 8
    return (held << pad).to_bytes((n + pad) // 8, "big")


def unpackbits(body: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(body):
        n = body[at]
        if n < 128:
            out += body[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += body[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def decoded(h: Header | object, body: bytes, rows: int) -> np.ndarray:
    """The values of a block with so many rows (a strip may hold fewer than others), as doubles."""
    raw = {1: bytes, 5: unlzw, 32773: unpackbits}.get(h.packed, zlib.decompress)(body)
    dtype, wide = np.dtype(h.dtype), h.block_width
    if h.predictor == 3:
        # bytes of a row by significance, each the difference to the one before
        planes = np.frombuffer(raw, np.uint8)[: rows * wide * dtype.itemsize].reshape(rows, -1).cumsum(axis=1, dtype=np.uint8)
        values = planes.reshape(rows, dtype.itemsize, wide).transpose(0, 2, 1)
        return np.ascontiguousarray(values).view(f">f{dtype.itemsize}").reshape(rows, wide).astype(float)
    values = np.frombuffer(raw, dtype)[: rows * wide].reshape(rows, wide)
    if h.predictor == 2:
        values = values.astype(dtype.newbyteorder("=")).cumsum(axis=1, dtype=dtype.newbyteorder("="))
    return values.astype(float)


def _block_rows(height: int, block_height: int, block_row: int, tiled: bool) -> int:
    return block_height if tiled else min(block_height, height - block_row * block_height)


def geotiff(body: bytes, with_pixels: bool = True) -> tuple[tuple, np.ndarray | None]:
    """(west, south, east, north, res, width, height, nodata) and the values, row 0 the northern one."""
    h = header(io.BytesIO(body))
    if not with_pixels:
        return h[:8], None
    high, wide = h.block_height, h.block_width
    out = np.full((-(-h.height // high) * high, h.across * wide), h.nodata)
    for i, (start, size) in enumerate(zip(h.starts, h.sizes, strict=True)):
        r, c = divmod(i, h.across)
        rows = _block_rows(h.height, high, r, wide != h.width)
        out[r * high : r * high + rows, c * wide : c * wide + wide] = decoded(h, body[start : start + size], rows)
    return h[:8], out[: h.height, : h.width]


def ascii_grid(body: bytes, with_pixels: bool = True) -> tuple[tuple, np.ndarray | None]:
    """The same for an ESRI ASCII grid."""
    words = body.split()
    head: dict[str, float] = {}
    while words and words[0][:1].isalpha():
        head[words[0].decode().lower()] = float(words[1])
        words = words[2:]
    width, height, res = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    west = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - res / 2
    south = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - res / 2
    top = (west, south, west + width * res, south + height * res, res, width, height, head.get("nodata_value", -9999.0))
    return top, np.array(words, float).reshape(height, width) if with_pixels else None


def _read(path: str, body: bytes, with_pixels: bool) -> tuple[tuple, np.ndarray | None] | None:
    try:
        return (ascii_grid if path.lower().endswith((".asc", ".grd")) else geotiff)(body, with_pixels)
    except UNREADABLE:
        return None


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,asc,grd,TIF,TIFF,ASC,GRD}").load(path).select("path", "content")


def _open(uri: str) -> pa.NativeFile:
    """A file by the name that Spark gives it."""
    system, path = pa.fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return system.open_input_file(path)


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for every readable raster file under a path; tiles are named by their file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            rows = [(_name(p), *r[0]) for p, b in zip(own.path, own.content, strict=True) if (r := _read(p, b, False))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in TILE.split(", ")])

    return _files(spark, path).mapInPandas(run, TILE)


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of all readable raster files under a path that hold data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for p, b in zip(own.path, own.content, strict=True):
                if (r := _read(p, b, True)) is None:
                    continue
                (*_, nodata), values = r
                for at in range(0, len(values), 256):
                    part = values[at : at + 256]
                    row, col = np.nonzero((part != nodata) & ~np.isnan(part))
                    yield pd.DataFrame({"tile_id": _name(p), "row": row + at, "col": col, "value": part[row, col]})

    return _files(spark, path).mapInPandas(run, PIXEL)


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """path and reason of the raster files under a path that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            rows = []
            for p, b in zip(own.path, own.content, strict=True):
                try:
                    (ascii_grid if p.lower().endswith((".asc", ".grd")) else geotiff)(b)
                except UNREADABLE as e:
                    rows.append((p, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "reason"])

    return _files(spark, path).mapInPandas(run, "path string, reason string")


def _block_table(path: str, h: Header) -> list[tuple]:
    return [(_name(path), *h[:8], h.epsg, path, i // h.across, i % h.across, h.block_height, h.block_width, a, n, h.dtype, h.packed, h.predictor) for i, (a, n) in enumerate(zip(h.starts, h.sizes, strict=True))]


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for every block of every readable GeoTIFF under a path: its tile, system, place, bytes, and what decodes it. Headers are read, blocks are not."""
    names = [f.split()[0] for f in BLOCK.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for p in own.path:
                try:
                    with _open(p) as f:
                        yield pd.DataFrame(_block_table(p, header(f)), columns=names).astype({"epsg": "Int32"})
                except UNREADABLE:
                    continue

    return files.mapInPandas(run, BLOCK)


def sample_blocks(places: DataFrame, index: DataFrame) -> DataFrame:
    """Places (tile_id, row, col and any other columns) with the value of their pixel, null for no data. Only blocks that hold a place are read and decoded, once for each of a few groups of a block's places; places outside their tile are left out."""
    other = [c for c in places.columns if c not in ("tile_id", "row", "col")]
    sizes = index.select("tile_id", "block_height", "block_width", "width", "height").distinct()
    met = places.join(sizes, "tile_id").filter("row between 0 and height - 1 and col between 0 and width - 1").drop("width", "height")
    met = met.withColumn("block_row", F.expr("cast(row div block_height as int)")).withColumn("block_col", F.expr("cast(col div block_width as int)")).drop("block_height", "block_width")
    at = ["tile_id", "block_row", "block_col"]
    need = index.select(*at, "path", "height", "width", "block_height", "block_width", "start", "bytes", "dtype", "packed", "predictor", "nodata")
    dealt = met.join(need, at).repartition(*at, F.pmod(F.xxhash64("row", "col"), F.lit(SALT))).sortWithinPartitions("path", "start")
    schema = dealt.select("tile_id", "row", "col", *other).withColumn("value", F.lit(None).cast("double")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, values, file, opened = None, None, None, None
        for own in batches:
            got = np.full(len(own), np.nan)
            for (path, start), part in own.reset_index(drop=True).groupby(["path", "start"], sort=False):
                b = next(part.itertuples())
                if key != (path, start):
                    if opened != path:
                        file, opened = _open(path), path
                    rows = _block_rows(b.height, b.block_height, b.block_row, b.block_width != b.width)
                    key, values = (path, start), decoded(b, file.read_at(b.bytes, b.start), rows)
                got[part.index] = values[part["row"] - b.block_row * b.block_height, part["col"] - b.block_col * b.block_width]
                got[part.index[got[part.index] == b.nodata]] = np.nan
            out = own[["tile_id", "row", "col", *other]].copy()
            out["value"] = got
            yield out

    return dealt.mapInPandas(run, schema).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


class BlockRow(InputPartition):
    """Blocks of a file that lie next to each other, west to east."""

    def __init__(self, path: str, head: Header, row: int) -> None:
        self.path, self.head, self.row = path, head, row


class RasterPixels(DataSource):
    """spark.read.format("raster_pixels").load(folder): pixels that hold data, with the place of their middle in the tile's own system.

    Comparisons of x and y with numbers are pushed down (the filters stay in the plan, too): files outside the box aren't
    planned, and of the others only the rows of blocks that meet it are read.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_pixels"

    def schema(self) -> str:
        return PLACED

    def reader(self, schema) -> DataSourceReader:
        return _PixelReader(self.options["path"])


class _PixelReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.low, self.high = {"x": -np.inf, "y": -np.inf}, {"x": np.inf, "y": np.inf}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and (c := f.attribute[0]) in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[c] = max(self.low[c], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[c] = min(self.high[c], f.value)
            yield f

    def partitions(self) -> list[BlockRow]:
        uri = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
        system, root = pa.fs.FileSystem.from_uri(uri)
        scheme = uri.split("://")[0] + "://"
        out = []
        for info in sorted(system.get_file_info(pa.fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if not info.path.lower().endswith((".tif", ".tiff")):
                continue
            try:
                with system.open_input_file(info.path) as f:
                    h = header(f)
            except UNREADABLE:
                continue
            if h.east < self.low["x"] or h.west > self.high["x"]:
                continue
            step = (h.north - h.south) / h.height * h.block_height
            out += [BlockRow(scheme + info.path, h, r) for r in range(-(-h.height // h.block_height)) if h.north - (r + 1) * step <= self.high["y"] and h.north - r * step >= self.low["y"]]
        return out

    def read(self, partition: BlockRow | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        h, r = partition.head, partition.row
        rows = _block_rows(h.height, h.block_height, r, h.block_width != h.width)
        with _open(partition.path) as f:
            for c in range(h.across):
                left = h.west + c * h.block_width * h.res
                if left > self.high["x"] or left + h.block_width * h.res < self.low["x"]:
                    continue
                i = r * h.across + c
                values = decoded(h, f.read_at(h.sizes[i], h.starts[i]), rows)[: h.height - r * h.block_height, : h.width - c * h.block_width]
                row, col = np.nonzero((values != h.nodata) & ~np.isnan(values))
                own = values[row, col]
                row, col = row + r * h.block_height, col + c * h.block_width
                x, y = h.west + (col + 0.5) * h.res, h.north - (row + 0.5) * h.res
                yield pa.record_batch([pa.array([_name(partition.path)] * len(row)), pa.array(row), pa.array(col), pa.array(x), pa.array(y), pa.array(own)], names=[n.split()[0] for n in PLACED.split(", ")])


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterPixels)


def encoded(values: np.ndarray, west: float, north: float, res: float, nodata: float = -9999.0, epsg: int | None = None, packed: int = 1, predictor: int = 1, block: int = 0) -> bytes:
    """A GeoTIFF of one band in the array's own type, in strips of block rows (0: one strip)."""
    height, width = values.shape
    high = block or height
    dtype = values.dtype.newbyteorder("<")
    parts = []
    for at in range(0, height, high):
        own = values[at : at + high].astype(dtype)
        if predictor == 2:
            own = np.diff(own, axis=1, prepend=np.zeros((len(own), 1), dtype)).astype(dtype)
            raw = own.tobytes()
        elif predictor == 3:
            planes = own.astype(dtype.newbyteorder(">")).view(np.uint8).reshape(len(own), width, dtype.itemsize).transpose(0, 2, 1).reshape(len(own), -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(own), 1), np.uint8)).astype(np.uint8).tobytes()
        else:
            raw = own.tobytes()
        parts.append({1: bytes, 5: lzw}.get(packed, zlib.compress)(raw))
    starts, body = [], b""
    for part in parts:
        starts.append(8 + len(body))
        body += part
    body += b"\0" * (len(body) % 2)
    form = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    keys = (1, 1, 0, 1, 3072 if epsg and epsg > 20000 else 2048, 0, 1, epsg) if epsg else ()
    tags = [(256, "I", (width,)), (257, "I", (height,)), (258, "H", (dtype.itemsize * 8,)), (259, "H", (packed,)), (273, "I", tuple(starts)), (277, "H", (1,)), (278, "I", (high,)), (279, "I", tuple(map(len, parts))), (317, "H", (predictor,)), (339, "H", (form,)), (33550, "d", (res, res, 0.0)), (33922, "d", (0.0, 0.0, 0.0, west, north, 0.0))]
    tags += [(34735, "H", keys)] * bool(keys) + [(42113, "s", repr(float(nodata)).encode() + b"\0")]
    directory, extra, beyond = b"", b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, code, vals in tags:
        raw = vals if code == "s" else struct.pack(f"<{len(vals)}{code}", *vals)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", beyond + len(extra))
        extra += raw if len(raw) > 4 else b""
        directory += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], len(vals)) + field
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + directory + struct.pack("<I", 0) + extra


def write_tiles(tiles: DataFrame, pixels_: DataFrame, path: str, kinds: tuple[tuple[int, int], ...] = ((5, 3), (8, 2), (1, 1)), block: int = 8) -> DataFrame:
    """Writes tiles (as of tile_index, and epsg if there is one) with their pixels as GeoTIFF files into a folder that all executors share, and returns tile_id and path. Ways of packing and predictors go by turns; a file has its final name once it is whole."""
    own = tiles.select("tile_id", "west", "north", "res", "nodata", *(["epsg"] if "epsg" in tiles.columns else [])).groupBy("tile_id")

    def put(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"tile_id": [], "path": []})
        t = left.iloc[0]
        values = np.full((right.row.max() + 1, right.col.max() + 1), t.nodata)
        values[right.row, right.col] = right.value
        packed, predictor = kinds[zlib.crc32(t.tile_id.encode()) % len(kinds)]
        values = values.astype(np.int32) if predictor == 2 else values
        body = encoded(values, t.west, t.north, t.res, t.nodata, int(t.epsg) if "epsg" in left else None, packed, predictor, block)
        system, folder = pa.fs.FileSystem.from_uri(path)
        system.create_dir(folder)
        name = f"{folder}/{t.tile_id}.tif"
        with system.open_output_stream(f"{name}.{id(body)}.part") as f:
            f.write(body)
        system.move(f"{name}.{id(body)}.part", name)
        return pd.DataFrame({"tile_id": [t.tile_id], "path": [name]})

    return own.cogroup(pixels_.groupBy("tile_id")).applyInPandas(put, "tile_id string, path string")
