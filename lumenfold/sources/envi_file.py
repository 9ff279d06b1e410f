"""ENVI rasters as ``Raster``: a header beside the values."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from lumenfold.sources.envi import TYPES, bands_of, parse_header, sample_type, write_header
from lumenfold.sources.rasters import Layout, NotThisFormat, Raster, steps_of


def opened(file: pa.NativeFile, path: str, whole: Callable[[str], bytes]) -> Raster:
    text = None
    for name in (path + ".hdr", re.sub(r"\.[^./]*$", "", path) + ".hdr"):
        try:
            text = whole(name).decode(errors="replace")
            break
        except (FileNotFoundError, OSError):
            continue
    if text is None or not text.lstrip().startswith("ENVI"):
        raise NotThisFormat("no header beside it")
    head = parse_header(text)
    width, height, bands = (int(head[k]) for k in ("samples", "lines", "bands"))
    kind = sample_type(head)
    told = bands_of(head)
    return Raster(
        path, "envi", width, height, bands, kind.str, int(head.get("header offset", 0)), steps_of(str(head.get("interleave", "bsq")).lower(), width, height, bands, kind.itemsize),
        gt=transform(head), projection=projection(head), ignore=(float(head["data ignore value"]),) if "data ignore value" in head else (),
        names=tuple(b[1] for b in told) if head.get("band names") else (), wavelengths=tuple(b[2] for b in told) if head.get("wavelength") else (),
        unit=head.get("wavelength units"), good=tuple(b[4] for b in told) if head.get("bbl") else (), first=int(head.get("y start", 1)) - 1,
    )


def transform(head: dict) -> tuple[float, ...] | None:
    """The geotransform of ``map info``: a reference pixel (from 1), its place and the size of a pixel."""
    info = head.get("map info")
    if not isinstance(info, list) or len(info) < 7:
        return None
    px, py, gx, gy, dx, dy = (float(v) for v in info[1:7])
    return (gx - (px - 1) * dx, dx, 0.0, gy + (py - 1) * dy, 0.0, -dy)


def projection(head: dict) -> str | None:
    from lumenfold.operators.projection import from_map_info

    if isinstance(head.get("map info"), list):
        try:
            return from_map_info(head["map info"]).proj_string()
        except (ValueError, IndexError):
            pass
    text = head.get("coordinate system string")
    return ", ".join(text) if isinstance(text, list) else text


def layout(raster: Raster, interleave: str) -> Layout:
    kind = np.dtype(raster.kind)
    codes = {v: k for k, v in TYPES.items()}
    if (code := codes.get(kind.str[1:])) is None:
        raise ValueError(f"the format has no type {kind}")
    head = {"samples": raster.width, "lines": raster.height, "bands": raster.bands, "header offset": 0, "file type": "ENVI Standard", "data type": code, "interleave": interleave, "byte order": int(kind.str[0] == ">")}
    if raster.ignore:
        head["data ignore value"] = raster.ignore[0]
    for key, values in (("band names", raster.names), ("wavelength", raster.wavelengths), ("bbl", [int(g) for g in raster.good])):
        if values:
            head[key] = list(values)
    if raster.unit:
        head["wavelength units"] = raster.unit
    if raster.gt is not None:
        if raster.gt[2] or raster.gt[4]:
            raise ValueError("the format's map has no rotation")
        head["map info"] = ["Arbitrary", 1, 1, raster.gt[0], raster.gt[3], raster.gt[1], -raster.gt[5]]
    return Layout(raster, aside={re.sub(r"\.(img|dat|raw|bsq|bil|bip)$", "", raster.path) + ".hdr": write_header(head).encode()})
