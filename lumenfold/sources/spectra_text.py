"""Spectra as delimited text, wavelength lists, match reports and saved expressions.

Lines are rows with their number; a column of a file becomes a spectrum by one aggregate. Files of one raster's
spectra are small, and many files are read at once (each by its path).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUTS = ("none", "first", "odd")
PAD = 9999  # fixed value: fills shorter spectra in an export
MOST_SPECTRA = 10_000  # of one file, each two columns wide


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files; whole files, since lines have no other order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line", "text")).where(F.trim("text") != "")


def import_spectra(lines: DataFrame, delimiter: str = ",", header: bool = True, layout: str = "first", ignore: float | None = None) -> DataFrame:
    """(path, column, name, wavelengths, values): a spectrum for each column of values.

    layout: "none" has values only, "first" has wavelengths in the first column, "odd" before each column of values.
    With a header the names are those of the value columns.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    order = Window.partitionBy("path").orderBy("line")
    cells = F.split(F.trim("text"), "\\s+" if delimiter == " " else "[" + ("\\t" if delimiter == "\t" else delimiter) + "]")
    numbered = lines.select("path", (F.row_number().over(order) - 1).alias("row"), cells.alias("cells"))
    long = numbered.select("path", "row", "cells", F.posexplode("cells").alias("at", "cell"))
    first = {"none": 0, "first": 1, "odd": 1}[layout]
    is_value = F.col("at") % 2 == 1 if layout == "odd" else F.col("at") >= first
    wave = {"none": F.lit(None).cast("double"), "first": F.trim(F.get("cells", F.lit(0))).try_cast("double"), "odd": F.trim(F.get("cells", F.col("at") - 1)).try_cast("double")}[layout]
    value = F.trim("cell").try_cast("double")
    if ignore is not None:
        value = F.when(value != ignore, value)
    body = long.where(is_value & (F.col("row") >= int(header))).select("path", "row", "at", wave.alias("w"), F.when(~F.isnan(value), value).alias("v"))
    if layout == "odd":
        body = body.where("w IS NOT NULL")  # a shorter spectrum ends
    ordered = F.array_sort(F.collect_list(F.struct("row", "w", "v")))
    index = F.floor(F.col("at") / 2) if layout == "odd" else F.col("at") - first
    spectra = body.groupBy("path", "at").agg(ordered.alias("s")).select("path", "at", index.cast("int").alias("column"), F.transform("s", lambda x: x.w).alias("wavelengths"), F.transform("s", lambda x: x.v).alias("values"))
    if not header:
        return spectra.select("path", "column", F.concat(F.lit("spectrum "), F.col("column") + 1).alias("name"), "wavelengths", "values")
    names = long.where((F.col("row") == 0) & is_value).select("path", "at", F.trim("cell").alias("name"))
    return spectra.join(names, ["path", "at"]).select("path", "column", "name", "wavelengths", "values")


@F.arrow_udf(T.StringType())
def number_text(values: pa.Array) -> pa.Array:
    """Numbers as the format writes them, the shortest text that leads back to them."""
    return pa.array([None if v is None else repr(v) for v in values.cast(pa.float64()).to_pylist()], pa.string())


def export_spectra(spectra: DataFrame) -> DataFrame:
    """(row, text): tab-separated pairs of wavelength and value for each spectrum, in the order of ``position``.

    spectra: (position, name, unit, wavelengths, values). A spectrum without wavelengths has the numbers of its bands;
    shorter spectra are filled, missing values are NaN. A line of the file holds a pair of every spectrum, so one
    file takes at most MOST_SPECTRA of them.
    """
    n, longest = spectra.agg(F.count(F.lit(1)), F.max(F.size("values"))).first()
    if n > MOST_SPECTRA:
        raise ValueError(f"{n} spectra are too many for the lines of one file; {MOST_SPECTRA} at most")
    waved = F.col("wavelengths").isNotNull()
    head = F.concat(F.when(waved, F.concat(F.lit("Wavelength ("), F.coalesce("unit", F.lit("")), F.lit(")"))).otherwise("Band"), F.lit("\t"), F.coalesce("name", F.lit("")))
    joined = lambda cell: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "own", cell.alias("cell")))), lambda c: c.cell), "\t")
    own = spectra.withColumn("own", F.monotonically_increasing_id())  # of equal positions
    heads = own.groupBy().agg(joined(head).alias("text")).where("text <> ''").select(F.lit(0).alias("row"), "text")
    rows = own.select("position", "own", waved.alias("waved"), F.size("values").alias("size"), "wavelengths", "values", F.explode(F.sequence(F.lit(0), F.lit((longest or 0) - 1)) if (longest or 0) > 0 else F.array().cast("array<int>")).alias("i"))
    at = F.when(F.col("waved"), number_text(F.get("wavelengths", F.col("i")))).otherwise(F.col("i").cast("string"))
    value = F.get("values", F.col("i"))
    pair = F.concat(F.coalesce(at, F.lit("NaN")), F.lit("\t"), F.when(value.isNull() | F.isnan(value), "NaN").otherwise(number_text(value)))
    cells = rows.select("position", "own", (F.col("i") + 1).alias("row"), F.when(F.col("i") < F.col("size"), pair).otherwise(f"{PAD}\t{PAD}").alias("pair"))
    return heads.union(cells.groupBy("row").agg(joined(F.col("pair")).alias("text"))).orderBy("row")


def export_pixel_spectra(rows: DataFrame) -> DataFrame:
    """(line, text): pixels of a region as columns of a text, by x and y, bands as rows after a header.
    rows: (x, y, band, value). A line holds a value of every pixel, as the file does; missing ones are NaN."""
    cell = F.struct("x", "y", F.coalesce(F.col("value").cast("string"), F.lit("NaN")).alias("v"))
    pixels = rows.groupBy("band").agg(F.array_sort(F.collect_list(cell)).alias("p"))
    line = lambda f: F.array_join(F.transform("p", f), "\t")
    head = pixels.orderBy("band").limit(1).select(F.lit(0).alias("line"), F.concat(F.lit("band\t"), line(lambda p: F.concat(F.lit("("), p.x, F.lit(" "), p.y, F.lit(")")))).alias("text"))
    body = pixels.select((F.col("band") + 1).alias("line"), F.concat(F.col("band").cast("string"), F.lit("\t"), line(lambda p: p.v)).alias("text"))
    return head.union(body).orderBy("line")


def import_wavelengths(lines: DataFrame, index: int = 0, by: str = "row") -> list[float]:
    """The wavelengths in a row or column of a small CSV. The delimiter is the first of comma, tab and space that
    occurs; the first row is a header if a cell of it isn't a number."""
    texts = [r["text"] for r in lines.orderBy("line").select("text").collect()]  # one short file
    delimiter = next((d for d in (",", "\t", " ") if any(d in t for t in texts)), ",")
    cells = [[c.strip() for c in (t.split() if delimiter == " " else t.split(delimiter))] for t in texts]

    def number(c: str) -> bool:
        try:
            float(c)
        except ValueError:
            return False
        return True

    if cells and not all(map(number, cells[0])):
        cells = cells[1:]
    return [float(c) for c in (cells[index] if by == "row" else [row[index] for row in cells])]


def match_report(matches: DataFrame) -> DataFrame:
    """Matches as lines for a text file, best first, ties by the other columns."""
    others = [c for c in matches.columns if c not in ("score", "ref_id")]
    return matches.orderBy("score", "ref_id", *others).select(F.to_csv(F.struct(*matches.columns)).alias("value"))


def scatter_selection(points: DataFrame) -> DataFrame:
    """(row, col, x_band, y_band) of selected points, ready for a CSV with a header."""
    return points.select(F.col("y").alias("row"), F.col("x").alias("col"), F.col("px").alias("x_band"), F.col("py").alias("y_band"))


def filled(value: Column, ignore: float) -> Column:
    """Missing values as the ignore value, at a sink only."""
    return F.coalesce(value, F.lit(ignore))
