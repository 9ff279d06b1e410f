"""Planetary data: labels of nested keys and values (version 3) or XML (version 4), at the head of the values or beside them."""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa

from lumenfold.sources.rasters import Layout, NotThisFormat, Raster, beside, moved, steps_of

# Types of samples by their names, and orders of storage.
TYPES3 = {"MSB_INTEGER": ">i", "INTEGER": ">i", "SUN_INTEGER": ">i", "MAC_INTEGER": ">i", "LSB_INTEGER": "<i", "PC_INTEGER": "<i", "VAX_INTEGER": "<i", "MSB_UNSIGNED_INTEGER": ">u", "UNSIGNED_INTEGER": ">u", "SUN_UNSIGNED_INTEGER": ">u", "MAC_UNSIGNED_INTEGER": ">u", "LSB_UNSIGNED_INTEGER": "<u", "PC_UNSIGNED_INTEGER": "<u", "VAX_UNSIGNED_INTEGER": "<u", "IEEE_REAL": ">f", "REAL": ">f", "FLOAT": ">f", "SUN_REAL": ">f", "MAC_REAL": ">f", "PC_REAL": "<f"}
TYPES4 = {"SignedByte": "i1", "UnsignedByte": "u1"} | {f"{s}{o}{n}": f"{b}{k}{n}" for o, b in (("MSB", ">"), ("LSB", "<")) for n in (2, 4, 8) for s, k in (("Signed", "i"), ("Unsigned", "u"))} | {f"IEEE754{o}{p}": f"{b}f{n}" for o, b in (("MSB", ">"), ("LSB", "<")) for p, n in (("Single", 4), ("Double", 8))}
ORDERS = {"BAND_SEQUENTIAL": "bsq", "LINE_INTERLEAVED": "bil", "SAMPLE_INTERLEAVED": "bip"}
MISSING = ("MISSING_CONSTANT", "MISSING", "NULL", "INVALID_CONSTANT", "CORE_NULL")
LABEL = 1 << 20  # bytes of a label at most


def _parsed(text: str):
    text = text.strip()
    if text[:1] in "({" and text:
        return [_parsed(p) for p in re.findall(r'"[^"]*"(?:\s*<[^>]*>)?|\'[^\']*\'|[^,(){}]+', text[1:-1]) if p.strip()]
    if text[:1] == '"':
        return text[1 : text.index('"', 1)] if '"' in text[1:] else text[1:]
    if text[:1] == "'":
        return text.strip("'")
    plain = re.sub(r"\s*<[^>]*>\s*$", "", text)
    if m := re.fullmatch(r"(\d+)#([0-9A-Fa-f]+)#", plain):
        whole = int(m[2], int(m[1]))
        return whole
    for kind in (int, float):
        try:
            return kind(plain)
        except ValueError:
            continue
    return text


def parse_label(text: str) -> dict:
    """Keys and values of a label; OBJECT and GROUP are nested, those of one name a list."""
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    out: dict = {}
    open_, at = [out], 0
    entry = re.compile(r'\s*(\^?[A-Za-z][\w:]*)(?:[ \t]*=\s*("[^"]*"|\([^)]*(?:\([^)]*\)[^)]*)*\)(?:\s*<[^>]*>)?|\{[^}]*\}|[^\r\n]*))?[^\r\n]*')
    while at < len(text) and (m := entry.match(text, at)):
        at = m.end()
        key, value = m[1].upper(), m[2]
        if key == "END" and value is None:
            break
        if key in ("OBJECT", "GROUP") and value is not None:
            inner: dict = {}
            open_[-1].setdefault(_parsed(value).upper(), []).append(inner)
            open_.append(inner)
        elif key in ("END_OBJECT", "END_GROUP"):
            if len(open_) > 1:
                open_.pop()
        elif value is not None:
            open_[-1].setdefault(key, _parsed(value))
    return out


def _bytes_of(word: object, text: str) -> bool:
    return isinstance(word, int) and re.search(rf"{word}\s*<\s*BYTES?\s*>", text, re.I) is not None


def opened3(file: pa.NativeFile, path: str, whole: Callable[[str], bytes]) -> Raster:
    head = file.read_at(min(LABEL, file.size()), 0)
    if not re.match(rb"\s*(?:CCSD|ODL_VERSION|PDS_VERSION_ID|/\*)", head[:200]) or b"PDS_VERSION_ID" not in head:
        raise NotThisFormat("no label")
    text = head.decode("latin-1")
    label = parse_label(text)
    name = next((n for n in ("IMAGE", "QUBE", "SPECTRAL_QUBE") if n in label and f"^{n}" in label), None)
    if name is None:
        raise ValueError(f"{path}: its label tells of no image")
    image, pointer = label[name][0], label[f"^{name}"]
    raw = re.search(rf"\^{name}\s*=\s*(\([^)]*\)|[^\r\n]*)", text)[1]
    words = pointer if isinstance(pointer, list) else [pointer]
    data = next((beside(path, w) for w in words if isinstance(w, str)), path)
    number = next((w for w in words if isinstance(w, int)), 1)
    offset = number - 1 if _bytes_of(number, raw) else (number - 1) * int(label.get("RECORD_BYTES", 1))
    if name == "IMAGE":
        w, h, n = int(image["LINE_SAMPLES"]), int(image["LINES"]), int(image.get("BANDS", 1))
        kind, bits = TYPES3.get(str(image["SAMPLE_TYPE"]).upper()), int(image["SAMPLE_BITS"])
        order = ORDERS.get(str(image.get("BAND_STORAGE_TYPE", "BAND_SEQUENTIAL")).upper())
        around = int(image.get("LINE_PREFIX_BYTES", 0)), int(image.get("LINE_SUFFIX_BYTES", 0))
        scale, shift = float(image.get("SCALING_FACTOR", 1)), float(image.get("OFFSET", 0))
    else:
        axes, items = [str(a).upper() for a in image["AXIS_NAME"]], [int(v) for v in image["CORE_ITEMS"]]
        if any(int(v) for v in np.ravel(image.get("SUFFIX_ITEMS", 0))):
            raise ValueError(f"{path}: planes beside the core are not read")
        order = {("SAMPLE", "LINE", "BAND"): "bsq", ("SAMPLE", "BAND", "LINE"): "bil", ("BAND", "SAMPLE", "LINE"): "bip"}.get(tuple(axes))
        size = dict(zip(axes, items, strict=True))
        w, h, n = size.get("SAMPLE", 0), size.get("LINE", 0), size.get("BAND", 0)
        kind, bits, around = TYPES3.get(str(image["CORE_ITEM_TYPE"]).upper()), 8 * int(image["CORE_ITEM_BYTES"]), (0, 0)
        scale, shift = float(image.get("CORE_MULTIPLIER", 1)), float(image.get("CORE_BASE", 0))
    if kind is None or order is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"{path}: its samples are not read here")
    kind = np.dtype(f"{kind}{bits // 8}")
    steps = steps_of(order, w, h, n, kind.itemsize)
    if any(around):
        line = w * (1 if order == "bsq" else n) * kind.itemsize + sum(around)
        if order == "bil":
            raise ValueError(f"{path}: bytes around the lines of each band are not read")
        offset, steps = offset + around[0], (line, steps[1], line * h if order == "bsq" else steps[2])
    ignore = tuple(float(image[k]) for k in MISSING if isinstance(image.get(k), int | float))
    centre = image.get("BAND_BIN", [{}])[0] if isinstance(image.get("BAND_BIN"), list) else {}
    waves = centre.get("BAND_BIN_CENTER", image.get("BAND_BIN_CENTER"))
    waves = tuple(float(v) for v in waves) if isinstance(waves, list) and len(waves) == n else ()
    return Raster(data, "pds3", w, h, n, kind.str, offset, steps, gt=_map(label), ignore=ignore, scale=scale, shift=shift, wavelengths=waves, unit=centre.get("BAND_BIN_UNIT", image.get("BAND_BIN_UNIT")))


def _map(label: dict) -> tuple[float, ...] | None:
    """From the map's scale (kilometres a pixel) and the place of its origin in pixels."""
    own = label.get("IMAGE_MAP_PROJECTION", [{}])[0]
    try:
        size = float(own["MAP_SCALE"]) * 1000
        return (-(float(own["SAMPLE_PROJECTION_OFFSET"]) + 0.5) * size, size, 0.0, (float(own["LINE_PROJECTION_OFFSET"]) + 0.5) * size, 0.0, -size)
    except (KeyError, TypeError, ValueError):
        return None


def layout3(raster: Raster, interleave: str) -> Layout:
    """A label at the head of the values."""
    kind = np.dtype(raster.kind)
    names = {v: k for k, v in reversed(TYPES3.items())}
    base = ("<" if kind.str[0] == "<" else ">") + kind.kind
    order = {v: k for k, v in ORDERS.items()}[interleave]
    missing = f"  MISSING_CONSTANT = {raster.ignore[0]!r}\r\n" if raster.ignore else ""
    waves = f"  BAND_BIN_CENTER = ({', '.join(repr(float(w)) for w in raster.wavelengths)})\r\n" if raster.wavelengths else ""
    waves += f'  BAND_BIN_UNIT = "{raster.unit}"\r\n' if raster.wavelengths and raster.unit else ""
    record = 512

    def text(records: int) -> str:
        return (
            f"PDS_VERSION_ID = PDS3\r\nRECORD_TYPE = FIXED_LENGTH\r\nRECORD_BYTES = {record}\r\nLABEL_RECORDS = {records}\r\n^IMAGE = {records + 1}\r\n"
            f"OBJECT = IMAGE\r\n  LINES = {raster.height}\r\n  LINE_SAMPLES = {raster.width}\r\n  BANDS = {raster.bands}\r\n  BAND_STORAGE_TYPE = {order}\r\n"
            f"  SAMPLE_TYPE = {names[base]}\r\n  SAMPLE_BITS = {kind.itemsize * 8}\r\n{missing}{waves}END_OBJECT = IMAGE\r\nEND\r\n"
        )

    records = -(-(len(text(10**6))) // record)
    head = text(records).encode("latin-1").ljust(records * record)
    return Layout(moved(raster, len(head)), head)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _find(element: ElementTree.Element, *names: str) -> ElementTree.Element | None:
    """The first element of these names, each inside the one before, at any depth."""
    for e in element.iter():
        if _local(e) == names[0] and e is not element:
            found = e if len(names) == 1 else _find(e, *names[1:])
            if found is not None:
                return found
    return None


def _text(element: ElementTree.Element | None, default: str | None = None) -> str | None:
    return default if element is None or element.text is None else element.text.strip()


def opened4(file: pa.NativeFile, path: str, whole: Callable[[str], bytes]) -> Raster:
    head = file.read_at(min(4096, file.size()), 0)
    if b"<Product_" not in head or b"pds" not in head.lower():
        raise NotThisFormat("no label")
    root = ElementTree.fromstring(file.read_at(file.size(), 0))
    area = next((e for e in root.iter() if _local(e).startswith("File_Area")), None)
    array = None if area is None else next((e for e in area.iter() if re.match(r"Array(_[23]D.*)?$", _local(e))), None)
    if array is None:
        raise ValueError(f"{path}: its label tells of no array")
    axes = sorted(((int(_text(_find(a, "sequence_number"))), _text(_find(a, "axis_name")).lower(), int(_text(_find(a, "elements")))) for a in array.iter() if _local(a) == "Axis_Array"))
    kind = TYPES4.get(_text(_find(array, "data_type"), ""))
    if kind is None or not 2 <= len(axes) <= 3:
        raise ValueError(f"{path}: its array is not read here")
    kind = np.dtype(kind)
    if _text(_find(array, "axis_index_order"), "Last Index Fastest").startswith("First"):
        axes = axes[::-1]
    steps, size, step = {}, {}, kind.itemsize
    for _, name, n in reversed(axes):
        own = "sample" if name in ("sample", "x", "column") else "line" if name in ("line", "y", "row") else "band"
        if own in steps:
            raise ValueError(f"{path}: axes {[a[1] for a in axes]}")
        steps[own], size[own], step = step, n, step * n
    missing = _find(array, "Special_Constants")
    ignore = () if missing is None else tuple(float(e.text) for e in missing if re.fullmatch(r"\s*[-+.\deE]+\s*", e.text or ""))
    data = beside(path, _text(_find(area, "file_name")))
    return Raster(
        data, "pds4", size.get("sample", 1), size.get("line", 1), size.get("band", 1), kind.str, int(_text(_find(array, "offset"), "0")), (steps.get("line", step), steps.get("sample", step), steps.get("band", step)),
        ignore=ignore, scale=float(_text(_find(array, "scaling_factor"), "1")), shift=float(_text(_find(array, "value_offset"), "0")),
    )


def layout4(raster: Raster, interleave: str) -> Layout:
    """A label beside the values."""
    kind = np.dtype(raster.kind)
    names = {np.dtype(v): k for k, v in TYPES4.items()}
    order = {"bsq": ("Band", "Line", "Sample"), "bil": ("Line", "Band", "Sample"), "bip": ("Line", "Sample", "Band")}[interleave]
    size = {"Band": raster.bands, "Line": raster.height, "Sample": raster.width}
    axes = "".join(f"<Axis_Array><axis_name>{a}</axis_name><elements>{size[a]}</elements><sequence_number>{i}</sequence_number></Axis_Array>" for i, a in enumerate(order, 1))
    missing = f"<Special_Constants><missing_constant>{raster.ignore[0]!r}</missing_constant></Special_Constants>" if raster.ignore else ""
    name = raster.path.rsplit("/", 1)[-1]
    text = (
        f'<?xml version="1.0"?>\n<Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1"><File_Area_Observational><File><file_name>{name}</file_name></File>'
        f'<Array_3D_Image><offset unit="byte">0</offset><axes>3</axes><axis_index_order>Last Index Fastest</axis_index_order>'
        f"<Element_Array><data_type>{names[kind]}</data_type></Element_Array>{axes}{missing}</Array_3D_Image></File_Area_Observational></Product_Observational>\n"
    )
    return Layout(raster, aside={re.sub(r"\.[^./]*$", "", raster.path) + ".xml": text.encode()})
