"""GeoTIFF rasters: a directory of tags, and strips or tiles that may be packed.

Classic and large files in both byte orders; bands beside each other or one after the other; values of 8 to 64 bits;
no packing, PackBits, LZW or deflate, with horizontal or floating-point prediction. A task reads the segments that its
lines need. The geotransform comes from the scale and tie point or the matrix, the ignore value from its tag.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from lumenfold.sources.rasters import Layout, NotThisFormat, Raster, moved, steps_of

# Sizes and codes of the types of tags, the tags that are read, kinds of samples, and keys of coordinate systems.
TAG_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAGS = {256: "width", 257: "height", 258: "bits", 259: "packing", 273: "offsets", 277: "bands", 278: "rows", 279: "counts", 284: "planes", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 339: "kinds", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "keys", 42113: "nodata"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
USER_DEFINED = 32767
PROJECTED, GEOGRAPHIC = 3072, 2048


def directory(file: pa.NativeFile) -> tuple[str, dict]:
    """(byte order, values of TAGS by name) of the first image."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise NotThisFormat("no mark of the format")
    large = version == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if large else struct.unpack(f"{order}I", head[4:8])[0]
    count_size, entry, inside = (8, 20, 8) if large else (2, 12, 4)
    n = struct.unpack(f"{order}{'Q' if large else 'H'}", file.read_at(count_size, at))[0]
    table, out = file.read_at(entry * n, at + count_size), {}
    for i in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", table, i * entry)
        count = struct.unpack_from(f"{order}{'Q' if large else 'I'}", table, i * entry + 4)[0]
        if tag not in TAGS or kind not in TAG_TYPES:
            continue
        code = TAG_TYPES[kind]
        size = struct.calcsize(f"{order}{code}") * count
        place = i * entry + (12 if large else 8)
        if size <= inside:
            raw = table[place : place + size]
        else:
            raw = file.read_at(size, struct.unpack_from(f"{order}{'Q' if large else 'I'}", table, place)[0])
        out[TAGS[tag]] = raw.split(b"\0")[0].decode("ascii", "replace") if code == "s" else np.frombuffer(raw, np.dtype(code[0]).newbyteorder(order)).tolist()
    return order, out


@dataclass(frozen=True)
class Segments(Raster):
    """Strips or tiles: ``segments`` holds (offset, bytes) of those from line ``top`` on, in the order of the file."""

    across: int = 1  # in a line of segments
    size: tuple[int, int] = (1, 1)  # lines and samples of one
    planes: bool = False  # each band has its own segments
    packing: int = NONE
    predictor: int = 1
    order: str = "<"
    segments: tuple[tuple[int, int], ...] = ()
    top: int = 0  # line of segments that ``segments`` starts with
    down: int = 0  # lines of segments in ``segments``

    @property
    def unit_of_lines(self) -> int:
        return self.size[0]

    def part(self, at: int, count: int) -> Segments:
        low, high = at // self.size[0], -(-(at + count) // self.size[0])
        each = self.across * self.down
        kept = [self.segments[p * each + (low - self.top) * self.across : p * each + (high - self.top) * self.across] for p in range(self.bands if self.planes else 1)]
        return replace(self, segments=tuple(s for own in kept for s in own), top=low, down=high - low)

    def _segment(self, file: pa.NativeFile, place: tuple[int, int], lines: int) -> np.ndarray:
        """[line][sample][band of the segment]"""
        depth = 1 if self.planes else self.bands
        kind, width = np.dtype(self.kind), self.size[1]
        length = lines * width * depth * kind.itemsize
        offset, size = place
        if size == 0:  # a segment that isn't stored holds nothing
            return np.full((lines, width, depth), self.ignore[0] if self.ignore else 0, kind)
        data = unpacked(file.read_at(size, offset), self.packing, length)
        if len(data) < length:
            raise ValueError(f"{self.path}: a segment of {len(data)} bytes in place of {length}")
        return unpredicted(data[:length], self.predictor, (lines, width, depth), kind)

    def stored(self, file: pa.NativeFile, at: int, count: int, bands: Sequence[int]) -> np.ndarray:
        tall, wide = self.size
        out = np.zeros((count, self.width, len(bands)), np.dtype(self.kind))
        for row in range(at // tall, -(-(at + count) // tall)):
            y = row * tall
            full = tall if self.across > 1 or wide != self.width else min(tall, self.height - y)  # tiles are stored whole
            low, high = max(at, y), min(at + count, y + tall, self.height)
            for column in range(self.across):
                x, right = column * wide, min(self.width, (column + 1) * wide)
                for plane in sorted(set(bands)) if self.planes else [0]:
                    place = self.segments[(plane if self.planes else 0) * self.across * self.down + (row - self.top) * self.across + column]
                    own = self._segment(file, place, full)[low - y : high - y, : right - x]
                    if self.planes:
                        for k in (i for i, b in enumerate(bands) if b == plane):
                            out[low - at : high - at, x:right, k] = own[:, :, 0]
                    else:
                        out[low - at : high - at, x:right] = own[:, :, list(bands)]
        return out


def unpacked(data: bytes, packing: int, length: int) -> bytes:
    if packing == NONE:
        return data
    if packing in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    return _from_lzw(data, length) if packing == LZW else _from_packbits(data)


def _from_packbits(data: bytes) -> bytes:
    """Runs: a count of literal bytes, or one byte repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _from_lzw(data: bytes, length: int) -> bytes:
    """Codes of 9 to 12 bits, the first bit first; 256 clears the table and 257 ends. A width grows one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    out, words, last, bits, held, wide, size = [], list(start), b"", 0, 0, 9, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= wide:
            code = held >> (bits - wide) & ((1 << wide) - 1)
            bits -= wide
            if code == 257 or size >= length:
                return b"".join(out)
            if code == 256:
                words, last, wide = list(start), b"", 9
                continue
            if not last:
                word = words[code]
            else:
                if code > len(words):
                    raise ValueError("a code that the table doesn't hold")
                word = words[code] if code < len(words) else last + last[:1]
                words.append(last + word[:1])
            out.append(word)
            size += len(word)
            last = word
            wide = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return b"".join(out)


def unpredicted(data: bytes, predictor: int, shape: tuple[int, int, int], kind: np.dtype) -> np.ndarray:
    """Values from differences along the line: of values (2), or of their bytes by significance (3)."""
    if predictor == 1:
        return np.frombuffer(data, kind).reshape(shape)
    lines, width, depth = shape
    if predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}").newbyteorder(kind.byteorder)
        found = np.cumsum(np.frombuffer(data, whole).reshape(shape), axis=1, dtype=np.dtype(f"u{kind.itemsize}"))
        return found.astype(whole).view(kind)
    if predictor != 3 or kind.kind != "f":
        raise ValueError(f"prediction {predictor} of {kind} is not known")
    rows = np.frombuffer(data, np.uint8).reshape(lines, width * kind.itemsize, depth)
    planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(lines, kind.itemsize, width * depth)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(f">f{kind.itemsize}")).reshape(shape)


def opened(file: pa.NativeFile, path: str, whole: Callable[[str], bytes]) -> Raster:
    order, tags = directory(file)
    one = lambda name, default=None: tags[name][0] if name in tags else default
    width, height, bands = one("width"), one("height"), one("bands", 1)
    if None in (width, height) or "offsets" not in tags or "counts" not in tags:
        raise ValueError(f"{path}: its directory tells no image")
    bits, kinds = set(tags.get("bits", [1])), set(tags.get("kinds", [1]))
    if len(bits) > 1 or len(kinds) > 1 or not kinds <= set(SAMPLES) or not bits <= {8, 16, 32, 64}:
        raise ValueError(f"{path}: samples of {bits} bits and kinds {kinds} are not read")
    packing, predictor = one("packing", NONE), one("predictor", 1)
    if packing not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError(f"{path}: packing {packing} is not known")
    kind = np.dtype(f"{SAMPLES[kinds.pop()]}{bits.pop() // 8}").newbyteorder(order)
    size = (one("tile_height"), one("tile_width")) if "tile_width" in tags else (min(one("rows", height), height), width)
    across, down = -(-width // size[1]), -(-height // size[0])
    planes = one("planes", 1) == 2
    segments = tuple(zip(tags["offsets"], tags["counts"], strict=True))
    if len(segments) < across * down * (bands if planes else 1):
        raise ValueError(f"{path}: {len(segments)} segments are too few")
    nodata = tags.get("nodata", "").strip()
    ignore = (float(nodata),) if nodata and nodata.lower() != "nan" else ()
    ends = [a + n for a, n in segments]
    if packing == NONE and predictor == 1 and across == 1 and size[1] == width and "tile_width" not in tags and ends[:-1] == [a for a, _ in segments[1:]]:
        steps = steps_of("bsq" if planes else "bip", width, height, bands, kind.itemsize)  # strips that follow each other are one array
        return Raster(path, "gtiff", width, height, bands, kind.str, segments[0][0], steps, gt=transform(tags), projection=projection(tags), ignore=ignore)
    return Segments(path, "gtiff", width, height, bands, kind.str, gt=transform(tags), projection=projection(tags), ignore=ignore, across=across, size=size, planes=planes, packing=packing, predictor=predictor, order=order, segments=segments, down=down)


def transform(tags: dict) -> tuple[float, ...] | None:
    if "matrix" in tags:
        m = tags["matrix"]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif "scale" in tags and len(tags.get("tie", ())) >= 6:
        (dx, dy), (px, py, _, gx, gy) = tags["scale"][:2], tags["tie"][:5]
        gt = (gx - px * dx, dx, 0.0, gy + py * dy, 0.0, -dy)
    else:
        return None
    if _keys(tags).get(1025) == 2:  # the place is that of a pixel's centre
        gt = (gt[0] - (gt[1] + gt[2]) / 2, gt[1], gt[2], gt[3] - (gt[4] + gt[5]) / 2, gt[4], gt[5])
    return gt


def _keys(tags: dict) -> dict[int, int]:
    keys = tags.get("keys", [])
    return {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}


def projection(tags: dict) -> str | None:
    keys = _keys(tags)
    code = keys.get(PROJECTED, keys.get(GEOGRAPHIC))
    return f"EPSG:{code}" if code not in (None, USER_DEFINED) else None


def layout(raster: Raster, interleave: str, rows: int = 256) -> Layout:
    """An unpacked file, its strips one after the other; one of more than 4 GB is a large file."""
    if interleave not in ("bsq", "bip"):
        raise ValueError("the format has the orders bsq and bip")
    kind = np.dtype(raster.kind).newbyteorder("<")
    w, h, n = raster.width, raster.height, raster.bands
    planes = n if interleave == "bsq" else 1
    strips = -(-h // rows)
    length = w * h * n * kind.itemsize
    large = length + 16 * strips * planes > 4_000_000_000
    long, code = ("Q", 16) if large else ("I", 4)
    line = w * kind.itemsize * (1 if planes > 1 or n == 1 else n)
    counts = [min(rows, h - i * rows) * line for i in range(strips)] * planes
    number = {"u": 1, "i": 2, "f": 3}[kind.kind]
    entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [kind.itemsize * 8] * n), 259: (3, [NONE]), 262: (3, [1]), 273: (code, counts), 277: (3, [n]), 278: (4, [rows]), 279: (code, counts), 284: (3, [2 if planes > 1 else 1]), 339: (3, [number] * n)}
    if n > 1:
        entries[338] = (3, [0] * (n - 1))
    if raster.gt is not None:
        g = raster.gt
        if g[2] or g[4]:
            entries[34264] = (12, [g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
        else:
            entries |= {33550: (12, [g[1], -g[5], 0.0]), 33922: (12, [0.0, 0.0, 0.0, g[0], g[3], 0.0])}
        if raster.projection and raster.projection.startswith("EPSG:"):
            number = int(raster.projection[5:])
            geographic = 4000 <= number < 5000
            entries[34735] = (3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, number])
    if raster.ignore:
        entries[42113] = (2, f"{raster.ignore[0]:.17g}\0".encode())
    raw = {t: (k, len(v), v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{TAG_TYPES[k][0]}", *v)) for t, (k, v) in sorted(entries.items())}
    first, entry, inside = (16, 20, 8) if large else (8, 12, 4)
    at = first + (8 if large else 2) + entry * len(raw) + (8 if large else 4)
    places = {}
    for t, (_, _, v) in raw.items():
        if len(v) > inside:
            at += at % 2
            places[t] = at
            at += len(v)
    start = -(-at // 16) * 16
    offsets = (np.cumsum([0, *counts[:-1]]) + start).tolist()
    raw[273] = (code, len(offsets), struct.pack(f"<{len(offsets)}{long}", *offsets))
    out = bytearray(start)
    out[:first] = struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if large else struct.pack("<2sHI", b"II", 42, first)
    struct.pack_into("<Q" if large else "<H", out, first, len(raw))
    for i, (t, (k, count, v)) in enumerate(raw.items()):
        here = first + (8 if large else 2) + i * entry
        struct.pack_into(f"<HH{long}", out, here, t, k, count)
        if t in places:
            struct.pack_into(f"<{long}", out, here + (12 if large else 8), places[t])
            out[places[t] : places[t] + len(v)] = v
        else:
            out[here + (12 if large else 8) : here + (12 if large else 8) + len(v)] = v
    steps = steps_of(interleave, w, h, n, kind.itemsize)
    return Layout(moved(replace(raster, kind=kind.str, steps=steps), start), bytes(out))
