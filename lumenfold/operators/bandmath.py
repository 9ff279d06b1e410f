"""Band math: expressions over cubes, bands, spectra and numbers, turned into one DataFrame of Catalyst columns.

Cubes are (key…, spectrum), bands (key…, value), keyed by pixel and, for batches, by dataset; a spectrum is a list of
numbers. All images that an expression names are joined by pixel once, each dataset once; spectra and numbers are
literals. Then every node is an expression over that row: pixel arrays meet by ``zip_with``, so nothing is exploded.

Precedence, low to high: comparison (left to right), + -, * /, ** (once, not chained), a sign, a term. A sign binds
tighter than **. Names ignore case. Missing values stay missing; x / 0 and powers without a real value are missing.
``a op b`` keeps the order of its operands for every kind, also number / cube and arctan2(band, cube).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.dtypes import result_dtype
from lumenfold.functions.registry import Registry, finite
from lumenfold.sources.envi import result_header

TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>"[^"]*"|'[^']*')|(?P<op>\*\*|==|!=|>=|<=|[-+*/<>(),=]))""")
COMPARE = ("==", "!=", ">", "<", ">=", "<=")
ANGLES = ("sin", "cos", "tan", "arcsin", "arccos", "arctan", "arctan2")
MARK = "variable "  # before the names of columns, so that a variable may be named like a key
RANK = {"cube": 3, "band": 2, "spectrum": 1, "number": 0, "boolean": 0}


class BandMathError(ValueError):
    """An expression that can't be read, or whose parts don't fit together."""


@dataclass(frozen=True)
class Image:
    """A variable: a cube or band with its keys, for example ("ds_id", "y", "x"). With the number of its bands, what
    doesn't fit is told before anything runs."""

    kind: str
    frame: DataFrame
    keys: tuple[str, ...] = ("y", "x")
    bands: int | None = None
    dtype: str | None = None  # numpy's name of the type of its values, if it is known
    header: dict | None = None  # what is known of it, in the keys of an ENVI header


@dataclass(frozen=True)
class Typed:
    kind: str
    column: Column
    length: int | None = None
    dtype: str | None = None
    source: str | None = None  # the image that tells what is known of the result


Variable = Image | Sequence[float | None] | float


def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a, b))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": F.try_divide, "**": power}
COMPARISONS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        if (m := TOKEN.match(text, at)) is None:
            raise BandMathError(f"can't read {text[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Compiler:
    """Reads an expression from left to right and builds its columns as it goes."""

    def __init__(self, text: str, names: Mapping[str, Typed], functions: Registry):
        self.todo, self.names, self.functions, self.used = tokens(text), names, functions, set()

    def peek(self) -> str:
        return self.todo[0][1] if self.todo else ""

    def eat(self, value: str) -> bool:
        if hit := bool(self.todo) and self.todo[0] == ("op", value):
            self.todo.pop(0)
        return hit

    def whole(self) -> Typed:
        out = self.comparison()
        if self.todo:
            raise BandMathError(f"unexpected {self.peek()!r}")
        return out

    def chain(self, ops: Sequence[str], part: Callable[[], Typed], once: bool = False) -> Typed:
        out = part()
        while self.todo and self.todo[0][0] == "op" and self.peek() in ops:
            op = self.todo.pop(0)[1]
            out = self.binary(op, out, part())
            if once:
                break
        return out

    def comparison(self) -> Typed:
        return self.chain(COMPARE, self.sum)

    def sum(self) -> Typed:
        return self.chain("+-", self.product)

    def product(self) -> Typed:
        return self.chain("*/", self.raised)

    def raised(self) -> Typed:
        return self.chain(("**",), self.signed, once=True)

    def signed(self) -> Typed:
        if not self.eat("-"):
            return self.term()
        x = self.term()
        if x.kind not in RANK or x.kind == "boolean":
            raise BandMathError(f"no sign for a {x.kind}")
        return replace(x, column=F.transform(x.column, lambda v: -v) if x.kind in ("cube", "spectrum") else -x.column)

    def term(self) -> Typed:
        if not self.todo:
            raise BandMathError("the expression ends too soon")
        if self.eat("("):
            out = self.comparison()
            if not self.eat(")"):
                raise BandMathError("a parenthesis is open")
            return out
        kind, text = self.todo.pop(0)
        if kind == "number":
            return Typed("number", F.lit(float(text)))
        if kind == "string":
            return Typed("string", F.lit(text[1:-1]))
        if kind == "name" and text.lower() in ("true", "false"):
            return Typed("boolean", F.lit(float(text.lower() == "true")))
        if kind == "name":
            return self.call(text.lower()) if self.eat("(") else self.variable(text.lower())
        raise BandMathError(f"unexpected {text!r}")

    def variable(self, name: str) -> Typed:
        self.used.add(name)
        if name not in self.names:
            raise BandMathError(f"{name} stands for nothing")
        return self.names[name]

    def call(self, name: str) -> Typed:
        args, named = [], {}
        while not self.eat(")"):
            if len(self.todo) > 1 and self.todo[0][0] == "name" and self.todo[1] == ("op", "="):
                key = self.todo.pop(0)[1].lower()
                self.todo.pop(0)
                named[key] = self.comparison()
            elif named:
                raise BandMathError("a positional argument follows a named one")
            else:
                args.append(self.comparison())
            if not self.eat(",") and self.peek() != ")":
                raise BandMathError(f"unexpected {self.peek()!r} in the arguments of {name}")
        return self.applied(name, [*args, *self.by_name(name, len(args), named)])

    def by_name(self, name: str, first: int, named: dict[str, Typed]) -> list[Typed]:
        """Named arguments in the order of a function's parameters, after so many positional ones."""
        f = self.functions.get(name)
        if not named or f is None or not f.params:
            return list(named.values())
        left = [p.lower() for p in f.params[first:]]
        if sorted(left) != sorted(named):
            raise BandMathError(f"{name} takes {', '.join(f.params)}")
        return [named[p] for p in left]

    def applied(self, name: str, args: Sequence[Typed]) -> Typed:
        if (f := self.functions.get(name)) is None:
            raise BandMathError(f"no function {name}")
        if len(args) != f.arity:
            raise BandMathError(f"{name} takes {f.arity} arguments")
        if f.whole:
            kinds = sorted((x.kind for x in args), key=lambda k: -RANK.get(k, 9))
            if kinds not in (["cube", "spectrum"], ["cube", "cube"], ["spectrum", "spectrum"]):
                raise BandMathError(f"{name} doesn't take {' and '.join(kinds)}")
            fit(args)
            kind = "band" if "cube" in kinds else "number"
            return Typed(kind, f.build(*(x.column for x in args)), None, None if kind == "number" else result_dtype(args[0].dtype, args[1].dtype), source_of(args))
        out = elementwise(f.build, args)
        if name in ANGLES and out.kind != "number":
            return replace(out, dtype=result_dtype(max(args, key=lambda x: RANK.get(x.kind, 0)).dtype, None, "trig"))
        return out

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in COMPARISONS:
            out = elementwise(lambda x, y: COMPARISONS[op](x, y).cast("int"), [a, b])
            return out if out.kind == "number" else replace(out, dtype="int8")
        if RANK.get(a.kind) == RANK.get(b.kind) == 0 and "boolean" in (a.kind, b.kind):
            raise BandMathError(f"no {op} for {a.kind} and {b.kind}")
        return elementwise(ARITHMETIC[op], [a, b])


def fit(args: Sequence[Typed]) -> int | None:
    lengths = {x.length for x in args if x.length is not None and x.kind in ("cube", "spectrum")}
    if len(lengths) > 1:
        raise BandMathError(f"numbers of bands differ: {sorted(lengths)}")
    return lengths.pop() if lengths else None


def elementwise(build: Callable[..., Column], args: Sequence[Typed]) -> Typed:
    """``build`` over single values, spread over the bands where an argument has them."""
    kinds = {x.kind for x in args}
    if not kinds <= RANK.keys():
        raise BandMathError(f"no arithmetic on a {(kinds - RANK.keys()).pop()}")
    if kinds >= {"band", "spectrum"} and "cube" not in kinds:
        raise BandMathError("a band and a spectrum don't fit together")
    kind = max(kinds, key=RANK.get)
    kind = "number" if RANK[kind] == 0 else kind
    wide = [x for x in args if x.kind in ("cube", "spectrum")]
    made = {"kind": kind, "length": fit(wide), "dtype": dtype_of(kind, args), "source": source_of(args)}
    if not wide:
        return Typed(column=build(*(x.column for x in args)), **made)
    if len(args) == 1:
        return Typed(column=F.transform(args[0].column, build), **made)
    a, b = args
    if len(wide) == 2:
        return Typed(column=F.zip_with(a.column, b.column, build), **made)
    if a is wide[0]:
        return Typed(column=F.transform(a.column, lambda v: build(v, b.column)), **made)
    return Typed(column=F.transform(b.column, lambda v: build(a.column, v)), **made)


def dtype_of(kind: str, args: Sequence[Typed]) -> str | None:
    """The type of arithmetic on values: of a cube by promotion of both types, of a band or spectrum that of the first
    operand which is one; numbers have none."""
    if kind == "cube" and len(args) == 2:
        return result_dtype(args[0].dtype, args[1].dtype)
    return None if kind == "number" else next(x.dtype for x in args if x.kind == kind)


def source_of(args: Sequence[Typed]) -> str | None:
    """The first of the operands of the highest kind tells what is known of a result."""
    return max((x for x in args if x.source is not None), key=lambda x: RANK.get(x.kind, 0), default=Typed("number", F.lit(0))).source


def variables_of(text: str) -> set[str]:
    """The names that an expression uses, in lower case."""
    found = tokens(text)
    return {x.lower() for i, (kind, x) in enumerate(found) if kind == "name" and x.lower() not in ("true", "false") and found[i + 1 : i + 2] not in ([("op", "(")], [("op", "=")])}


class Reader(Compiler):
    """Reads an expression without regard to what fits together."""

    def __init__(self, text: str):
        super().__init__(text, {}, Registry())
        self.any = Typed("number", F.lit(0.0))

    def variable(self, name: str) -> Typed:
        return self.any

    def applied(self, name: str, args: Sequence[Typed]) -> Typed:
        return self.any

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        return self.any


def parses(text: str) -> bool:
    try:
        Reader(text).whole()
    except BandMathError:
        return False
    return True


@dataclass(frozen=True)
class Result:
    """What an expression gives: ``frame`` holds its keys and ``spectrum`` or ``value``, or there is a ``column`` only.
    ``dtype`` is the type by the types of its images, ``header`` what is known of it."""

    kind: str
    frame: DataFrame | None
    column: Column | None
    keys: tuple[str, ...] = ()
    dtype: str | None = None
    header: dict | None = None

    def typed(self) -> DataFrame:
        """The frame with its values in the type of the result, fractions cut off where that has none. What the type
        can't hold is missing; unsigned types take the next larger type of Spark."""
        if self.frame is None:
            raise BandMathError("a number has no frame")
        name = "spectrum" if self.kind == "cube" else "value"
        if self.dtype is None or self.dtype.startswith("complex"):
            return self.frame
        one = lambda v: stored_as(v, self.dtype)
        return self.frame.withColumn(name, F.transform(name, one) if self.kind == "cube" else one(F.col(name)))

    def save(self, path: str, format: str = "envi", ignore: float | None = None) -> dict:
        """Writes a cube or band of one dataset as one raster file with what is known of it; that is returned."""
        from lumenfold.sources.datasource import write_file

        if self.kind not in ("cube", "band") or self.keys != ("y", "x") or not self.header:
            raise BandMathError("a cube or band by y and x with a header is saved")
        head = self.header
        frame = self.typed() if self.kind == "cube" else self.typed().withColumn("spectrum", F.array("value"))
        kind = np.dtype(self.dtype or "float32")
        whole = lambda k: [float(v) for v in head[k]] if head.get(k) else None
        options = {"width": int(head["samples"]), "height": int(head["lines"]), "bands": int(head["bands"]), "kind": kind.str[1:], "ignore": ignore, "wavelengths": whole("wavelength"), "unit": head.get("wavelength units"), "names": head.get("band names"), "good": [bool(v) for v in whole("bbl")] if head.get("bbl") else None, "gt": envi_transform(head)}
        write_file(frame.select("y", "x", "spectrum"), path, format, **options)
        return head


def envi_transform(head: Mapping) -> list[float] | None:
    from lumenfold.sources.envi_file import transform

    found = transform(dict(head))
    return None if found is None else list(found)


#: Spark's type, least and largest value of each type of values.
STORED = {n: (t, int(np.iinfo(n).min), int(np.iinfo(n).max)) for n, t in (("int8", "tinyint"), ("uint8", "smallint"), ("int16", "smallint"), ("uint16", "int"), ("int32", "int"), ("uint32", "bigint"), ("int64", "bigint"), ("uint64", "decimal(20,0)"))}


def stored_as(value: Column, dtype: str) -> Column:
    if dtype not in STORED:
        return value.cast({"float32": "float", "float16": "float"}.get(dtype, "double"))
    kind, low, high = STORED[dtype]
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)) if kind != "decimal(20,0)" else value.try_cast(kind)
    return F.when((value > low - 1) & (value < high + 1), whole.try_cast(kind))


def compute(text: str, variables: Mapping[str, Variable], functions: Registry | None = None) -> Result:
    """An expression over images, spectra and numbers."""
    variables = {k.lower(): v for k, v in variables.items()}
    names: dict[str, Typed] = {}
    used = variables_of(text)
    images: list[tuple[str, Image]] = []
    for name, v in variables.items():
        if isinstance(v, Image):
            names[name] = Typed(v.kind, F.col(f"`{MARK}{name}`"), v.bands, v.dtype, name)
            if name in used:
                images.append((name, v))
        elif isinstance(v, int | float):
            names[name] = Typed("number", F.lit(float(v)))
        else:
            names[name] = Typed("spectrum", F.array(*(F.lit(x).cast("double") for x in v)), len(v), "float64")
    result = Compiler(text, names, functions or Registry()).whole()
    if not images:
        return Result(result.kind, None, result.column)
    frame, keys = None, ()
    taken: list[tuple[DataFrame, str, str]] = []
    for name, image in sorted(images, key=lambda x: -len(x[1].keys)):
        value = "spectrum" if image.kind == "cube" else "value"
        same = next((other for source, v, other in taken if source is image.frame and v == value), None)
        if same is not None:  # the same dataset again: no second read or join
            frame = frame.withColumn(MARK + name, F.col(f"`{same}`"))
            continue
        own = image.frame.select(*image.keys, F.col(value).alias(MARK + name))
        frame, keys = (own, image.keys) if frame is None else (frame.join(own, [k for k in image.keys if k in keys]), keys)
        taken.append((image.frame, value, MARK + name))
    source = variables[result.source].header if result.source else None
    head = None if source is None else result_header(source, result.kind)
    return Result(result.kind, frame.select(*keys, result.column.alias("spectrum" if result.kind == "cube" else "value")), None, tuple(keys), result.dtype, head)


def evaluate(text: str, variables: Mapping[str, Variable], functions: Registry | None = None) -> tuple[str, DataFrame | Column]:
    """(kind, result): a frame of keys and ``spectrum`` or ``value`` for images, else a Column."""
    found = compute(text, variables, functions)
    return found.kind, found.column if found.frame is None else found.frame
