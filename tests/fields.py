"""Writers and small tables for the tests: rasters by our own encoder, occurrence files."""

import csv
import io
import struct
import zlib

import numpy as np

SIDE = 60


def layers(noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows, cols = np.meshgrid(np.arange(SIDE), np.arange(SIDE), indexing="ij")
    return {"temp": rows / SIDE + noise * rng.normal(size=(SIDE, SIDE)), "precip": np.sin(cols / 8) + noise * rng.normal(size=(SIDE, SIDE))}


def npy(folder, values, **more):
    paths = []
    for name, v in (values | more).items():
        path = folder / f"{name}.npy"
        np.save(path, v)
        paths.append(str(path))
    return paths


def lzw(data):
    """TIFF's LZW, by the book: 9 to 12 bits, wider one code early, cleared when full."""
    codes, bits = [], []

    def emit(code, width):
        bits.append(format(code, f"0{width}b"))

    table, width = {bytes((i,)): i for i in range(256)}, 9
    emit(256, width)
    n, own = 258, b""
    for byte in data:
        more = own + bytes((byte,))
        if more in table:
            own = more
            continue
        emit(table[own], width)
        table[more] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            emit(256, width)
            table, width, n = {bytes((i,)): i for i in range(256)}, 9, 258
        own = bytes((byte,))
    if own:
        emit(table[own], width)
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    emit(257, width)
    stream = "".join(bits)
    stream += "0" * (-len(stream) % 8)
    return bytes(int(stream[i : i + 8], 2) for i in range(0, len(stream), 8)) + bytes(codes)


def predicted(block, predictor):
    """Rows of values as differences, of values or of planes of bytes."""
    if predictor == 2:
        return np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(block.dtype).tobytes()
    if predictor == 3:
        planes = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(*block.shape, -1).transpose(0, 2, 1).reshape(len(block), -1)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    return block.tobytes()


def tiff(path, values, origin=(10.0, 50.0), size=1.0, epsg=4326, nodata="nan", bands=1, deflate=False, tile=None, packed=None, predictor=1, dtype="<f8", big=False):
    """A GeoTIFF of strips of one row, or of tiles; 64-bit floats unless told otherwise."""
    values = np.asarray(values, dtype)
    h, w = values.shape
    if tile:
        blocks = []
        for top in range(0, h, tile):
            for left in range(0, w, tile):
                block = np.zeros((tile, tile), dtype)
                part = values[top : top + tile, left : left + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [values[i : i + 1] for i in range(h)]
    compression = 8 if deflate else {None: 1, "lzw": 5}[packed]
    blocks = [{1: bytes, 5: lzw, 8: zlib.compress}[compression](predicted(b, predictor)) for b in blocks]
    out = io.BytesIO()
    out.write(b"II+\0\x08\0\0\0" + b"\0" * 8 if big else b"II*\0\0\0\0\0")
    places = []
    for b in blocks:
        places.append(out.tell())
        out.write(b)
    sizes = [len(b) for b in blocks]
    keys = (1, 1, 0, 2, 1024, 0, 1, 2, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    kind = {"f": 3, "i": 2, "u": 1}[values.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * values.dtype.itemsize]), (259, 3, [compression]), (277, 3, [bands]), (317, 3, [predictor]), (339, 3, [kind]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0]), (34735, 3, list(keys)), (42113, 2, nodata)]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [1]), (279, 4, sizes)]
    codes, room, word = {3: "H", 4: "I", 12: "d"}, 8 if big else 4, "Q" if big else "I"
    entries = []
    for tag, kind, v in sorted(tags, key=lambda t: t[0]):
        data = v.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(v)}{codes[kind]}", *v)
        n = len(data) if kind == 2 else len(v)
        if len(data) > room:
            at = out.tell()
            out.write(data)
            data = struct.pack(f"<{word}", at)
        entries.append(struct.pack(f"<HH{word}", tag, kind, n) + data.ljust(room, b"\0"))
    at = out.tell()
    out.write(struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + b"\0" * room)
    data = bytearray(out.getvalue())
    data[8:16] = struct.pack("<Q", at) if big else data[8:16]
    data[4:8] = data[4:8] if big else struct.pack("<I", at)
    path.write_bytes(bytes(data))
    return str(path)


def table(path, header, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)
