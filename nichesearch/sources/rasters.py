"""Predictor rasters as a grid table: (row, col, predictors array), NULL for nodata.

The grid is cut to windows, as high and wide as the largest strip or tile of any layer and of at least
``WINDOW`` cells. A window is a task's unit of work: it reads the ranges of bytes of
the blocks that it meets, of all layers, and gives finished rows, so that no task holds a layer, no cell is shuffled, and
a wish for part of the grid reads that part only. The driver reads the headers and compares them.
Supported are 2-D ``.npy`` arrays and single-band GeoTIFFs and BigTIFFs (strips or
tiles; uncompressed, deflate or LZW; horizontal and floating-point prediction), of any size. An array in
columns (Fortran's order) is read in bands of columns. Paths are opened by ``pyarrow.fs``.
"""

from __future__ import annotations

import ast
import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..schema import UnreadableRasters

NPY, GEOTIFF = (".npy",), (".tif", ".tiff")
#: Cells of a window at least, and rows of a batch at most.
WINDOW, BATCH = 1 << 18, 1 << 15
#: Bytes ``n`` at a place of a file.
Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Grid:
    cells: DataFrame  # row, col, predictors
    names: tuple[str, ...]
    height: int
    width: int
    transform: tuple[float, ...] | None = None
    crs: str | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def is_georeferenced(self) -> bool:
        return self.transform is not None


class _Whole:
    """Ranges of bytes, of which none may be missing."""

    def __init__(self, read: Read, size: int):
        self._read, self.size = read, size

    def __call__(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise ValueError(f"the file ends before {at + n}")
        return bytes(self._read(at, n))


def _of_bytes(data: bytes) -> _Whole:
    return _Whole(lambda at, n: data[at : at + n], len(data))


def _of_file(f: pa.NativeFile) -> _Whole:
    return _Whole(lambda at, n: f.read_at(n, at), f.size())


def _npy_head(read: _Whole) -> dict:
    if read(0, 6) != b"\x93NUMPY":
        raise ValueError("no .npy header")
    wide = read(6, 1)[0] >= 2
    begin = 12 if wide else 10
    size = struct.unpack("<I" if wide else "<H", read(8, begin - 8))[0]
    stated = ast.literal_eval(read(begin, size).decode("latin1"))
    if len(stated["shape"]) != 2:
        return {"dims": len(stated["shape"])}
    dtype = np.dtype(stated["descr"])
    if dtype.hasobject:
        raise ValueError("objects in .npy")
    (height, width), columns = stated["shape"], stated["fortran_order"]
    if read.size < begin + size + height * width * dtype.itemsize:
        raise ValueError("the file ends before its array")
    # as strips of whole rows, or of whole columns
    tile = (max(1, min(width, WINDOW // max(1, height))), max(1, height)) if columns else (max(1, width), 1)
    return {"dims": 2, "height": height, "width": width, "transform": None, "crs": None, "dtype": dtype, "begin": begin + size, "columns": columns, "tile": tile}


def _npy(read: Read, head: dict, top: int, left: int, rows: int, cols: int) -> np.ndarray:
    height, width, dtype = head["height"], head["width"], head["dtype"]
    if head["columns"]:
        data = np.frombuffer(read(head["begin"] + left * height * dtype.itemsize, cols * height * dtype.itemsize), dtype)
        return data.reshape(cols, height).T[top : top + rows].astype(float)
    data = np.frombuffer(read(head["begin"] + top * width * dtype.itemsize, rows * width * dtype.itemsize), dtype)
    return data.reshape(rows, width)[:, left : left + cols].astype(float)


#: Fixed values of the TIFF format: bytes and struct codes by field type.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_KINDS = {1: "u", 2: "i", 3: "f"}


def _tags(read: _Whole) -> tuple[str, dict[int, tuple]]:
    start = read(0, min(16, read.size))
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack_from(order + "H", start, 2)[0] if order and len(start) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF header")
    place, many, room = ("I", "H", 4) if magic == 42 else ("Q", "Q", 8)  # of an offset, of the number of tags, bytes of a value held in its tag
    take = lambda code, at: struct.unpack(order + code, read(at, struct.calcsize(order + code)))
    at = take(place, 4 if magic == 42 else 8)[0]
    n = take(many, at)[0]
    entry = struct.Struct(order + "HH" + place)
    step = entry.size + room
    listed = read(at + struct.calcsize(many), n * step)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = entry.unpack_from(listed, step * i)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        held = listed[step * i + entry.size : step * (i + 1)]
        if size * count > room:
            held = read(struct.unpack(order + place, held)[0], size * count)
        tags[tag] = (held[:count].split(b"\0")[0].decode("latin1"),) if code == "s" else struct.unpack_from(order + code * count, held)
    return order, tags


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, each width left one code early; 256 clears, 257 ends."""
    out, held, bits, width = [], 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise ValueError("a damaged LZW stream")
        found = table[code] if code < len(table) else last + last[:1]
        out.append(found)
        if last:
            table.append(last + found[:1])
        last = found
        width = min(12, max(9, (len(table) + 1 if len(table) >= 511 else 0).bit_length()))
    return b"".join(out)


def _undone(raw: bytes, rows: int, width: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """A strip's or tile's values without the prediction."""
    if predictor == 3:  # bytes of all first, all second ... places of a row's values, each as a difference
        planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * width * dtype.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, dtype.itemsize, width).transpose(0, 2, 1)).view(dtype.newbyteorder(">"))[:, :, 0]
    tile = np.frombuffer(raw, dtype, rows * width).reshape(rows, width)
    return np.cumsum(tile, axis=1, dtype=dtype) if predictor == 2 else tile


def _crs(tags: dict[int, tuple]) -> str | None:
    keys = tags.get(34735, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(3072) or found.get(2048)
    return f"EPSG:{code}" if code and code != 32767 else None


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}


def _tiff_head(read: _Whole) -> dict:
    order, tags = _tags(read)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bands, width, height = one(277, 1), one(256, 0), one(257, 0)
    if bands != 1:
        return {"bands": bands}
    compression, predictor, kind = one(259, 1), one(317, 1), _KINDS[one(339, 1)]
    if compression not in _UNPACK or predictor not in (1, 2, 3) or (predictor == 3) > (kind == "f"):
        raise ValueError(f"compression {compression} with predictor {predictor}")
    tiled = 322 in tags
    tile = (one(322, width), one(323, height)) if tiled else (width, min(height, one(278, height)))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if any(a + n > read.size for a, n in zip(offsets, sizes, strict=True)) or len(offsets) < -(-width // tile[0]) * -(-height // tile[1]):
        raise ValueError("the file ends before its values")
    transform = None
    if 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, _) = tags[33550], tags[33922][:6]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    nodata = tags.get(42113, ("",))[0].strip()
    return {
        "bands": 1, "height": height, "width": width, "transform": transform or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "crs": _crs(tags),
        "dtype": np.dtype(f"{order}{kind}{one(258, 8) // 8}"), "compression": compression, "predictor": predictor, "tiled": tiled, "tile": tile, "blocks": np.array([offsets, sizes], np.int64).T, "nodata": float(nodata) if nodata else None,
    }


def _tiff(read: Read, head: dict, top: int, left: int, rows: int, cols: int) -> np.ndarray:
    """Of the blocks that the window meets."""
    tile_w, tile_h = head["tile"]
    values = np.zeros((rows, cols), head["dtype"])
    across = -(-head["width"] // tile_w)
    for down in range(top // tile_h, -(-(top + rows) // tile_h)):
        for over in range(left // tile_w, -(-(left + cols) // tile_w)):
            y, x = down * tile_h, over * tile_w
            high = tile_h if head["tiled"] else min(tile_h, head["height"] - y)
            tile = _undone(_UNPACK[head["compression"]](read(*head["blocks"][down * across + over])), high, tile_w, head["dtype"], head["predictor"])
            y0, y1, x0, x1 = max(y, top), min(y + high, top + rows), max(x, left), min(x + tile_w, left + cols)
            values[y0 - top : y1 - top, x0 - left : x1 - left] = tile[y0 - y : y1 - y, x0 - x : x1 - x]
    out = values.astype(float)
    if head["nodata"] is not None:
        out[out == head["nodata"]] = np.nan
    return out


def _is_npy(name: str) -> bool:
    return PurePosixPath(name).suffix.lower() in NPY


def _head(name: str, read: _Whole) -> dict:
    return _npy_head(read) if _is_npy(name) else _tiff_head(read)


def _values(name: str, read: Read, head: dict, *window: int) -> np.ndarray:
    return (_npy if _is_npy(name) else _tiff)(read, head, *window)


def header(name: str, data: bytes) -> dict:
    """What a layer is, without its values."""
    return _head(name, _of_bytes(data))


def decode(name: str, data: bytes) -> dict:
    """A layer that is held as a whole."""
    head = _head(name, read := _of_bytes(data))
    if head.get("dims", 2) == 2 and head.get("bands", 1) == 1:
        head["values"] = _values(name, read, head, 0, 0, head["height"], head["width"])
    return head


def npy_bytes(values: np.ndarray) -> bytes:
    """A layer as a ``.npy`` file."""
    out = io.BytesIO()
    np.save(out, np.asarray(values, float))
    return out.getvalue()


def tiff_bytes(values: np.ndarray, transform: tuple[float, ...], epsg: int = 4326) -> bytes:
    """A layer of 64-bit floats as a GeoTIFF of deflated strips of one row; NaN is nodata. The transform has no rotation."""
    values = np.asarray(values, "<f8")
    height, width = values.shape
    a, _, x, _, e, y = transform
    strips = [zlib.compress(row.tobytes()) for row in values]
    begins = [8 + sum(map(len, strips[:i])) for i in range(height)]
    geographic = epsg == 4326
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg)
    tags = [
        (256, "I", [width]), (257, "I", [height]), (258, "H", [64]), (259, "H", [8]), (262, "H", [1]), (273, "I", begins), (277, "H", [1]), (278, "I", [1]), (279, "I", list(map(len, strips))),
        (339, "H", [3]), (33550, "d", [a, -e, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x, y, 0.0]), (34735, "H", list(keys)), (42113, "s", b"nan\0"),
    ]
    body, at = b"".join(strips), 8 + sum(map(len, strips))
    entries, kinds = [], {"H": 3, "I": 4, "d": 12, "s": 2}
    extra = b""
    for tag, code, v in tags:
        data = v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
        if len(data) > 4:
            extra += b"\0" * (len(extra) % 2)
            place = struct.pack("<I", at + len(extra))
            extra += data
        else:
            place = data.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", tag, kinds[code], len(v)) + place)
    return struct.pack("<2sHI", b"II", 42, at + len(extra)) + body + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def _stated(path: str, suffix: str) -> dict:
    """A layer's header; whatever is wrong with its bytes is the same gap."""
    try:
        with files.opened(path) as f:
            return _head(path, _of_file(f))
    except FileNotFoundError as e:
        raise UnreadableRasters("unreadable_raster", f"no raster at {path}", suffix) from e
    except Exception as e:
        raise UnreadableRasters("unreadable_raster", f"{path} can't be read: {type(e).__name__}: {e}", suffix) from e


def _windows(heads: list[dict], part: tuple[int, int, int, int]) -> tuple[int, int, list[tuple[int, int]]]:
    """Height and width of windows, and the corners (top, left) of those that meet the ``part`` (first and last row, first and last column)."""
    width, height = heads[0]["width"], heads[0]["height"]
    high, wide = (max(h["tile"][i] for h in heads) for i in (1, 0))
    wide = min(width, wide * max(1, min(-(-WINDOW // (high * wide)), -(-width // wide))))
    high = min(height, high * max(1, WINDOW // (high * wide)))
    r0, r1, c0, c1 = part
    return high, wide, [(t, x) for t in range(r0 // high * high, r1 + 1, high) for x in range(c0 // wide * wide, c1 + 1, wide)]


_CELLS = "row int, col int, predictors array<double>"


def _cells(spark: SparkSession, paths: tuple[str, ...], heads: list[dict], part: tuple[int, int, int, int]) -> DataFrame:
    """``_CELLS`` of a part of the grid, a window after the other."""
    width, height, k = heads[0]["width"], heads[0]["height"], len(heads)
    r0, r1, c0, c1 = part
    if r0 > r1 or c0 > c1:
        return spark.createDataFrame([], _CELLS)
    high, wide, corners = _windows(heads, part)
    shared = spark.sparkContext.broadcast(heads)  # of a layer the places of its blocks: 16 bytes a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [files.opened(p) for p in paths]
        for batch in batches:
            for i in batch.column("id").to_pylist():
                top, left = corners[i]
                y0, y1, x0, x1 = max(top, r0), min(top + high, height, r1 + 1), max(left, c0), min(left + wide, width, c1 + 1)
                each = [_values(p, _of_file(f), h, y0, x0, y1 - y0, x1 - x0).ravel() for p, f, h in zip(paths, opened, shared.value, strict=True)]
                rows, cols = np.divmod(np.arange((y1 - y0) * (x1 - x0)), x1 - x0)
                for a in range(0, len(rows), BATCH):
                    own = np.stack([v[a : a + BATCH] for v in each], axis=1)
                    values = pa.ListArray.from_arrays(np.arange(0, own.size + 1, k, dtype=np.int32), pa.array(own.ravel(), from_pandas=True))
                    yield pa.RecordBatch.from_arrays([pa.array((rows[a : a + BATCH] + y0).astype(np.int32)), pa.array((cols[a : a + BATCH] + x0).astype(np.int32)), values], names=["row", "col", "predictors"])
        for f in opened:
            f.close()

    return spark.range(0, len(corners), 1, len(corners)).mapInArrow(run, _CELLS)


def read_predictors(spark: SparkSession, paths: list[str] | tuple[str, ...], part: tuple[int, int, int, int] | None = None) -> Grid:
    """Read and align a stack of layers, or of ``part`` of it (first and last row, first and last column); raises UnreadableRasters rather than guess."""
    suffixes = [PurePosixPath(p).suffix.lower() for p in paths]
    for suffix in suffixes:
        if suffix not in NPY + GEOTIFF:
            raise UnreadableRasters("unsupported_predictor_format", f"no reader for {suffix!r}; there are readers for {', '.join(NPY + GEOTIFF)}", suffix)
    heads = [_stated(p, s) for p, s in zip(paths, suffixes, strict=True)]
    for path, h in zip(paths, heads, strict=True):
        if h.get("dims", 2) != 2:
            raise UnreadableRasters("unsupported_predictor_shape", f"{path} has {h['dims']} dimensions, not 2", str(h["dims"]))
        if h.get("bands", 1) != 1:
            raise UnreadableRasters("unsupported_multiband_raster", f"{path} has {h['bands']} bands, not 1", str(h["bands"]))
    if len({s in GEOTIFF for s in suffixes}) > 1:
        raise UnreadableRasters("mixed_predictor_georeferencing", "layers with and without georeference can't be stacked")
    for what in ("shape", "transform", "crs"):
        seen = {(h["height"], h["width"]) if what == "shape" else h[what] for h in heads}
        if len(seen) > 1:
            raise UnreadableRasters("misaligned_predictors", f"layers differ in {what}: {sorted(map(str, seen))}")
    head = heads[0]
    whole = (0, head["height"] - 1, 0, head["width"] - 1)
    if part:
        whole = (max(0, part[0]), min(whole[1], part[1]), max(0, part[2]), min(whole[3], part[3]))
    cells = _cells(spark, tuple(paths), heads, whole)
    return Grid(cells, tuple(PurePosixPath(p).stem for p in paths), head["height"], head["width"], head["transform"], head["crs"])


# --- surfaces

_TILES = "tile_row int, tile_col int, file string, height int, width int"


def write_surface(cells: DataFrame, folder: str, height: int, width: int, transform: tuple[float, ...], epsg: int = 4326, tile: int = 512) -> None:
    """Cells (row, col, value) as GeoTIFFs of ``tile`` x ``tile`` cells in a new ``folder``, and the table of them, ``tiles``.

    Cells are dealt to the tasks of their tiles; a task holds one tile. NULL and absent cells are nodata; of a cell that
    comes twice the greatest value stays; cells outside of the grid are left out; a tile without any cell has no file.
    """
    a, b, c, d, e, f = map(float, transform)
    own = cells.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    place = {"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")}
    rows = own.select("row", "col", F.col("value").cast("double").alias("value")).withColumns(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = None, np.zeros((0, 0))

        def finished() -> pa.RecordBatch:
            top, left = held[0] * tile, held[1] * tile
            moved = (a, b, a * left + b * top + c, d, e, d * left + e * top + f)
            name = files.written_by_task(f"{folder}/layers", ".tif", tiff_bytes(values, moved, epsg))
            types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, name, *values.shape), types, strict=True)], names=[x.split()[0] for x in _TILES.split(", ")])

        for batch in batches:
            row, col, value, down, over = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "col", "value", "tile_row", "tile_col"))
            cuts = [0, *(np.flatnonzero((np.diff(down) != 0) | (np.diff(over) != 0)) + 1).tolist(), len(row)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if (own := (int(down[x]), int(over[x]))) != held:
                    if held is not None:
                        yield finished()
                    held = own
                    values = np.full((min(tile, height - own[0] * tile), min(tile, width - own[1] * tile)), np.nan)
                at = (row[x:y] - held[0] * tile, col[x:y] - held[1] * tile)
                np.fmax.at(values, at, value[x:y].astype(float))
        if held is not None:
            yield finished()

    rows.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").mapInArrow(run, _TILES).write.parquet(f"{folder}/tiles")


def read_surface(spark: SparkSession, folder: str, tile: int = 512) -> DataFrame:
    """(row, col, value) of all cells of the tiles of a folder, a tile a task's unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with files.opened(f"{folder}/layers/{r['file']}") as f:
                    read = _of_file(f)
                    values = _tiff(read, _tiff_head(read), 0, 0, r["height"], r["width"])
                for y, line in enumerate(values):
                    n = len(line)
                    columns = [np.full(n, r["tile_row"] * tile + y, np.int32), (np.arange(n) + r["tile_col"] * tile).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(line, from_pandas=True)], names=["row", "col", "value"])

    return spark.read.schema(_TILES).parquet(f"{folder}/tiles").mapInArrow(run, "row int, col int, value double")
