"""Functions of band math: built-in ones, and those that users add or put in their place.

A function gets Column arguments of single values and gives a Column of one; band math applies it element by element.
Functions over a whole spectrum take arrays and give a value for each pixel.
"""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def dot(a: Column, b: Column) -> Column:
    """The sum of products, where missing values count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def angle(a: Column, b: Column) -> Column:
    """The angle between two spectra in radians; missing values count as 0."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))))


@dataclass(frozen=True)
class BandFunction:
    build: Callable[..., Column]
    arity: int
    whole: bool = False  # takes whole spectra
    params: tuple[str, ...] = ()  # names of the arguments, for calls by name


BUILT_IN = {
    "sin": BandFunction(F.sin, 1),
    "cos": BandFunction(F.cos, 1),
    "tan": BandFunction(F.tan, 1),
    "arcsin": BandFunction(lambda x: finite(F.asin(x)), 1),
    "arccos": BandFunction(lambda x: finite(F.acos(x)), 1),
    "arctan": BandFunction(F.atan, 1),
    "arctan2": BandFunction(F.atan2, 2, params=("a", "b")),
    "dotprod": BandFunction(dot, 2, whole=True),
    "spectral_angle": BandFunction(angle, 2, whole=True),
}


class Registry(dict):
    """Names are taken in lower case; a later function of the same name holds."""

    def __init__(self, **own: BandFunction):
        super().__init__(BUILT_IN | {k.lower(): v for k, v in own.items()})

    def register(self, name: str, build: Callable[..., Column], arity: int = 1, whole: bool = False, params: tuple[str, ...] = ()) -> None:
        self[name.lower()] = BandFunction(build, arity, whole, params)

    def plug_in(self, *names: str) -> None:
        """Adds the functions of plugins, each a dotted name of a callable that gives {name: BandFunction}; one that
        fails is passed over and one that takes the place of another is told, both by a warning."""
        for name in names:
            module, _, attribute = name.rpartition(".")
            try:
                found = dict(getattr(importlib.import_module(module), attribute)())
            except Exception as fault:  # a faulty plugin doesn't stop the others
                warnings.warn(f"plugin {name} was passed over: {fault!r}", stacklevel=2)
                continue
            for key, function in found.items():
                if key.lower() in self:
                    warnings.warn(f"{key} of plugin {name} takes the place of another", stacklevel=2)
                self[key.lower()] = function
