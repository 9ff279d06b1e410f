"""Spectral units. Wavelengths convert by a factor, frequencies and wavenumbers by their reciprocal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanometres in a unit of length, and the product of a reciprocal unit's value and its wavelength in nm.
LENGTHS = {
    "centimeters": 1e7, "cm": 1e7, "meters": 1e9, "m": 1e9, "micrometers": 1e3, "microns": 1e3, "um": 1e3,
    "millimeters": 1e6, "mm": 1e6, "nanometers": 1.0, "nm": 1.0, "angstroms": 0.1,
}
RECIPROCALS = {"wavenumber": 1e7, "1/cm": 1e7, "ghz": 299792458.0, "mhz": 299792458000.0}


def _cases(unit: Column, of_length, of_reciprocal) -> Column:
    out = F.lit(None).cast("double")
    name = F.lower(F.trim(unit))
    for key, value in LENGTHS.items():
        out = F.when(name == key, of_length(value)).otherwise(out)
    for key, value in RECIPROCALS.items():
        out = F.when(name == key, of_reciprocal(value)).otherwise(out)
    return out


def to_nm(value: Column, unit: Column) -> Column:
    """A value of a unit in nanometres; NULL for unknown units and for 0 of a reciprocal one."""
    return _cases(unit, lambda f: value * F.lit(f), lambda f: F.try_divide(F.lit(f), value))


def from_nm(value: Column, unit: Column) -> Column:
    return _cases(unit, lambda f: value / F.lit(f), lambda f: F.try_divide(F.lit(f), value))


def convert(value: Column, unit: Column, target: Column) -> Column:
    return from_nm(to_nm(value, unit), target)
