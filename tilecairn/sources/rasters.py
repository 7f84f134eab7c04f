"""Raster files by windows: TIFF and ASCII grids, of which only the blocks that are asked for are read."""

from __future__ import annotations

import re
import struct
import zlib
from collections import OrderedDict
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
from pyarrow import fs as arrow_fs

# Tags, types and compressions of TIFF files, and names of color interpretations by their code.
TYPE_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000
COLOURS = "undefined gray palette red green blue alpha hue saturation lightness cyan magenta yellow black pan coastal rededge nir swir mwir lwir tir otherir sar_ka sar_k sar_ku sar_x sar_c sar_s sar_l sar_p".split()
#: Decoded blocks that an open image keeps, in bytes.
KEPT_BYTES = 64 << 20


def open_at(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, in Hadoop's spelling too, and the path in it."""
    path = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "/", path))
    return arrow_fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Image:
    """One raster of a file: of its overviews the others are ``overviews``. ``origin`` is the outer corner of the first
    pixel and ``step`` the size of a pixel, to the right and (mostly negative) downwards, in units of ``crs``."""

    width: int
    height: int
    bands: int
    kind: str
    nodata: float | None = None
    crs: str | None = None
    origin: tuple[float, float] = (0.0, 0.0)
    step: tuple[float, float] = (1.0, -1.0)
    colours: list[str] = field(default_factory=list)
    palette: dict[str, list[int]] | None = None
    items: list[dict[str, str]] = field(default_factory=list)
    overviews: list[Image] = field(default_factory=list)

    def window(self, top: int, bottom: int, left: int, right: int) -> np.ndarray:
        """Bands x rows x columns of a part of the raster."""
        raise NotImplementedError

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east and north in units of the reference system."""
        xs = sorted((self.origin[0], self.origin[0] + self.width * self.step[0]))
        ys = sorted((self.origin[1], self.origin[1] + self.height * self.step[1]))
        return xs[0], ys[0], xs[1], ys[1]


class TiffImage(Image):
    """A directory of a TIFF file."""

    def attach(self, read, order: str, tags: dict) -> TiffImage:
        self.read, self.order = read, order
        self.compression, self.predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
        self.apart = tags.get(284, [1])[0] == 2
        self.block = (tags[323][0], tags[322][0]) if 322 in tags else (min(self.height, tags.get(278, [self.height])[0]), self.width)
        self.offsets, self.counts = (tags[324], tags[325]) if 322 in tags else (tags[273], tags[279])
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        if self.compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD):
            raise ValueError(f"TIFF compression {self.compression} needs an image library")
        return self

    def _block(self, i: int) -> np.ndarray | None:
        """Rows x columns x bands (one, if they are apart) of a block; None where the file leaves it out."""
        if i in self.kept:
            self.kept.move_to_end(i)
            return self.kept[i]
        if not self.counts[i]:
            return None
        h, w = self.block
        n = 1 if self.apart else self.bands
        dtype = np.dtype(self.kind).newbyteorder(self.order)
        raw = _plain(self.read(self.offsets[i], self.counts[i]), self.compression, h * w * n * dtype.itemsize)
        rows = len(raw) // (w * n * dtype.itemsize)
        if self.predictor == 3:
            part = np.frombuffer(raw, np.uint8)[: rows * w * n * dtype.itemsize].reshape(rows, -1).copy()
            part = np.cumsum(part.reshape(rows, -1, n), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, w * n)
            part = np.ascontiguousarray(part.transpose(0, 2, 1)).view(np.dtype(self.kind).newbyteorder(">")).reshape(rows, w, n)
        else:
            part = np.frombuffer(raw, dtype)[: rows * w * n].reshape(rows, w, n)
            if self.predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.dtype(self.kind))
        part = part.astype(np.dtype(self.kind), copy=False)
        self.kept[i] = part
        while len(self.kept) > 1 and sum(p.nbytes for p in self.kept.values()) > KEPT_BYTES:
            self.kept.popitem(last=False)
        return part

    def window(self, top: int, bottom: int, left: int, right: int) -> np.ndarray:
        h, w = self.block
        across, down = -(-self.width // w), -(-self.height // h)
        out = np.full((self.bands, bottom - top, right - left), self.nodata if self.nodata is not None and np.can_cast(np.min_scalar_type(self.nodata), self.kind, "same_kind") else 0, self.kind)
        for y in range(top // h, -(-bottom // h)):
            for x in range(left // w, -(-right // w)):
                for plane in range(self.bands if self.apart else 1):
                    part = self._block((plane * down + y) * across + x)
                    if part is None:
                        continue
                    a, b = max(top, y * h), min(bottom, y * h + part.shape[0], self.height)
                    c, d = max(left, x * w), min(right, x * w + w, self.width)
                    if a < b and c < d:
                        cut = part[a - y * h : b - y * h, c - x * w : d - x * w].transpose(2, 0, 1)
                        out[plane : plane + len(cut) if self.apart else self.bands, a - top : b - top, c - left : d - left] = cut
        return out


def _plain(data: bytes, compression: int, size: int) -> bytes:
    """The bytes of a block."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return _packbits(data) if compression == PACKBITS else _lzw(data)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first: 256 clears the table, 257 ends."""
    out, table, last = bytearray(), [], b""
    bits = held = at = 0
    width = 9
    single = [bytes([i]) for i in range(256)]
    while True:
        while held < width:
            if at == len(data):
                return bytes(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFFFF, held + 8, at + 1
        code = bits >> (held - width) & (1 << width) - 1
        held -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [*single, b"", b""], 9, b""
            continue
        if not table:
            table = [*single, b"", b""]
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))


def _directories(read) -> tuple[str, list[dict]]:
    """The byte order and the tags of each directory of a TIFF file, classic or big."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = order and struct.unpack_from(order + "H", head, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    count, each, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    inline, size = (8, 8) if big else (4, 2)
    at = struct.unpack_from(order + word, head, 8 if big else 4)[0]
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + count, read(at, size))[0]
        body = read(at + size, n * each + inline)
        tags: dict = {}
        for i in range(n):
            tag, kind, many = struct.unpack_from(order + "HH" + word, body, i * each)
            code = TYPE_CODES.get(kind, "B")
            bytes_ = many * struct.calcsize("=" + code)
            where = i * each + each - inline
            raw = body[where : where + bytes_] if bytes_ <= inline else read(struct.unpack_from(order + word, body, where)[0], bytes_)
            tags[tag] = raw.rstrip(b"\0") if code == "s" else list(struct.unpack(f"{order}{many * len(code)}{code[0]}", raw))
        out.append(tags)
        at = struct.unpack_from(order + word, body, n * each)[0]
    return order, out


def _tiff_image(tags: dict, read, order: str) -> TiffImage:
    bits, bands = tags.get(258, [8])[0], tags.get(277, [1])[0]
    if bits % 8:
        raise ValueError(f"TIFF samples of {bits} bits are not read")
    kind = f"{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(339, [1])[0]]}{bits // 8}"
    image = TiffImage(tags[256][0], tags[257][0], bands, np.dtype(kind).name)
    if text := tags.get(42113, b"").decode("ascii", "replace").strip():
        image.nodata = float(text)
    if 33550 in tags and 33922 in tags:
        sx, sy = tags[33550][:2]
        c, r, _, x, y, _ = tags[33922][:6]
        image.origin, image.step = (x - c * sx, y + r * sy), (sx, -sy)
    elif 34264 in tags:
        m = tags[34264]
        if m[1] or m[4]:
            raise ValueError("rotated rasters are not read")
        image.origin, image.step = (m[3], m[7]), (m[0], m[5])
    keys = tags.get(34735, [])
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if keys:
        if geo.get(1025) == 2:  # the place names the centre of a pixel
            image.origin = (image.origin[0] - image.step[0] / 2, image.origin[1] - image.step[1] / 2)
        code = geo.get(3072) or (geo.get(2048) if geo.get(1024) == 2 else None)
        image.crs = f"EPSG:{code}" if code and code != 32767 else None
    image.items = [{} for _ in range(bands)]
    if 42112 in tags:
        for item in ElementTree.fromstring(tags[42112].decode()).iter("Item"):
            if item.get("sample") is not None and int(item.get("sample")) < bands:
                image.items[int(item.get("sample"))][(item.get("role") or item.get("name") or "").lower()] = item.text or ""
    plain = {0: ["gray"], 1: ["gray"], 2: ["red", "green", "blue"], 3: ["palette"]}.get(tags.get(262, [1])[0], [])
    extra = ["alpha" if e in (1, 2) else "undefined" for e in tags.get(338, [])]
    names = (plain + extra + ["undefined"] * bands)[:bands]
    image.colours = [i.get("colorinterp", n).lower() for i, n in zip(image.items, names, strict=True)]
    if 320 in tags:
        table = np.array(tags[320]).reshape(3, -1) // 257
        image.palette = {str(i): [*(int(v) for v in table[:, i]), 255] for i in range(table.shape[1])}
    return image.attach(read, order, tags)


class GridImage(Image):
    """An ASCII grid, of which the places of every so many rows are known."""

    EVERY = 64

    def attach(self, file, offsets: list[int]) -> GridImage:
        self.file, self.offsets = file, offsets
        return self

    def window(self, top: int, bottom: int, left: int, right: int) -> np.ndarray:
        first = top // self.EVERY
        last = min(len(self.offsets) - 1, -(-bottom // self.EVERY))
        self.file.seek(self.offsets[first])
        values = np.array(self.file.read(self.offsets[last] - self.offsets[first]).split(), float).reshape(-1, self.width)
        return values[None, top - first * self.EVERY : bottom - first * self.EVERY, left:right].astype(self.kind)


def _lines(file, size: int = 1 << 20):
    """The lines of a file, with their ends."""
    rest = b""
    while chunk := file.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (line + b"\n" for line in whole)
    if rest:
        yield rest


def grid_index(file, every: int = GridImage.EVERY) -> tuple[dict[str, float], list[int]]:
    """The fields of an ASCII grid's header, and where every so many rows begin, and the end: one pass over the file.
    Rows may be broken into lines, but every so many rows one has to begin on a line of its own."""
    header: dict[str, float] = {}
    at, values, offsets = 0, 0, []
    for line in _lines(file):
        parts = line.split()
        if len(parts) == 2 and parts[0][:1].isalpha() and not offsets:
            header[parts[0].decode().lower()] = float(parts[1])
        elif parts:
            if not header.keys() >= {"ncols", "nrows"}:
                raise ValueError("neither a TIFF file nor an ASCII grid")
            if values % (int(header["ncols"]) * every) == 0:
                offsets.append(at)
            values += len(parts)
        at += len(line)
    if not values or values != header["ncols"] * header["nrows"] or len(offsets) != -(-int(header["nrows"]) // every):
        raise ValueError(f"the grid has {values} values, or its rows do not begin on lines")
    return header, [*offsets, at]


def _grid_image(file, assume: str | None, index: tuple | None = None) -> GridImage:
    header, offsets = index or grid_index(file)
    step = header.get("cellsize") or header["dx"]
    down = header.get("cellsize") or header["dy"]
    west = header["xllcorner"] if "xllcorner" in header else header["xllcenter"] - step / 2
    south = header["yllcorner"] if "yllcorner" in header else header["yllcenter"] - down / 2
    image = GridImage(int(header["ncols"]), int(header["nrows"]), 1, "float32", header.get("nodata_value", -9999.0), assume, (west, south + header["nrows"] * down), (step, -down), ["gray"], items=[{}])
    return image.attach(file, offsets)


def open_image(path: str, assume_lonlat: bool = True, index: tuple | None = None) -> Image:
    """A raster file with its overviews. A file without a reference system is taken to be in longitude and latitude,
    if that is wanted, else it raises. ``index`` is what grid_index() gave for an ASCII grid."""
    system, where = open_at(path)
    file = system.open_input_file(where)
    assume = "EPSG:4326" if assume_lonlat else None

    def read(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    if read(0, 4)[:2] in (b"II", b"MM"):
        order, found = _directories(read)
        images = [_tiff_image(t, read, order) for t in found if not t.get(254, [0])[0] & 4]
        image = images[0]
        image.overviews = [i for t, i in zip(found[1:], images[1:], strict=False) if t.get(254, [0])[0] & 1]
        for o in image.overviews:
            o.crs, o.origin, o.nodata = image.crs, image.origin, image.nodata
            o.step = (image.step[0] * image.width / o.width, image.step[1] * image.height / o.height)
        image.crs = image.crs or assume
    else:
        file.seek(0)
        image = _grid_image(file, assume, index)
    if image.crs is None:
        raise ValueError(f"{path} has no reference system")
    return image


def info(path: str) -> dict:
    """What a raster file is: size, bands, reference system, place, overviews."""
    i = open_image(path)
    bands = [{"band": k + 1, "type": i.kind, "colorinterp": i.colours[k] if k < len(i.colours) else "undefined", "nodata": i.nodata} | ({"description": i.items[k]["description"]} if i.items and "description" in i.items[k] else {}) for k in range(i.bands)]
    w, s, e, n = i.bounds
    return {"size": [i.width, i.height], "crs": i.crs, "geotransform": [i.origin[0], i.step[0], 0.0, i.origin[1], 0.0, i.step[1]], "corners": {"upper_left": [w, n], "lower_right": [e, s], "center": [(w + e) / 2, (s + n) / 2]}, "bands": bands, "overviews": [[o.width, o.height] for o in i.overviews], "palette": i.palette}
