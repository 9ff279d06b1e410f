"""The type of a result from the types of its operands, by numpy's promotion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("uint8", "uint16", "uint32", "uint64", "int16", "int32", "int64", "float32", "float64", "complex64", "complex128")


def result_dtype(a: str | None, b: str | None = None, operation: str = "arithmetic") -> str | None:
    """operation: "arithmetic", "compare" (a boolean) or "trig" (floats stay, others become float32).

    With one type only, that of the other operand being unknown, it is the result.
    """
    if operation not in ("arithmetic", "compare", "trig"):
        raise ValueError(f"no operation {operation}")
    if a is None or (b is None and operation != "trig"):
        return b if a is None else a
    if operation == "compare":
        return "bool"
    if operation == "trig":
        return a if np.issubdtype(np.dtype(a), np.floating) else "float32"
    return np.result_type(a, b).name


def result_dtypes(a: Column, b: Column, operation: str = "arithmetic") -> Column:
    """The same for columns of type names."""
    pairs = F.create_map(*(F.lit(x) for p in TYPES for q in TYPES for x in (f"{p} {q}", result_dtype(p, q, operation))))
    both = F.try_element_at(pairs, F.concat_ws(" ", a, b))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
