import pytest
from pyspark.sql import functions as F

from lumenfold.operators.bandmath import BandMathError, Image, evaluate, parses, variables_of


@pytest.fixture(scope="module")
def images(spark):
    rows = [(y, x, [float(10 * y + x), 1.0]) for y in range(3) for x in range(4)]
    cube = spark.createDataFrame(rows, "y int, x int, spectrum array<double>")
    band = cube.select("y", "x", F.lit(2.0).alias("value"))
    return {"c": Image("cube", cube, bands=2), "b": Image("band", band), "s": [1.0, 2.0], "n": 4.0}


def values(result):
    kind, df = result
    return {(r["y"], r["x"]): r["spectrum" if kind == "cube" else "value"] for r in df.collect()}


def number(spark, text, **names):
    return spark.range(1).select(evaluate(text, names)[1].alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("(2 * 3 + 4) / 2", 5), ("-2 ** 2", 4), ("2 - 3 - 4", -5), ("8 / 4 / 2", 1), ("1 < 2 < 1", 0), ("1 + 1 == 2", 1), ("1 / 0", None), (".5 + 1.", 1.5), ("n * N", 16)])
def test_numbers(spark, text, want):
    assert number(spark, text, n=4.0) == want


@pytest.mark.parametrize("text", ["a ** b ** c", "--a", "a +", "(a", "f(x = 1, 2)", "1e5", "a b", "", "a $ b"])
def test_what_does_not_parse(text):
    assert not parses(text)


@pytest.mark.parametrize("text", ["a*(b>0.2)+c<0.2", "-a**b", "f(a, k = 'x')", "TRUE + a"])
def test_what_parses(text):
    assert parses(text)


def test_variables():
    assert variables_of("Sin(A) + b * f(c, name = D) == true") == {"a", "b", "c", "d"}


@pytest.mark.parametrize(("text", "kind", "at_2_3"), [("c + b", "cube", [25.0, 3.0]), ("b - c", "cube", [-21.0, 1.0]), ("c * s", "cube", [23.0, 2.0]), ("n / c", "cube", [4 / 23, 4.0]), ("b ** 2 + n", "band", 8.0), ("dotprod(s, c)", "band", 25.0), ("c > 1", "cube", [1, 0]), ("(c + b) + (c + n)", "cube", [52.0, 8.0])])
def test_kinds(images, text, kind, at_2_3):
    result = evaluate(text, images)
    assert result[0] == kind
    assert values(result)[2, 3] == pytest.approx(at_2_3)


def test_missing_stays_missing(spark):
    cube = spark.createDataFrame([(0, 0, [None, 0.0, -1.0])], "y int, x int, spectrum array<double>")
    assert values(evaluate("(c * 2) ** 0.5", {"c": Image("cube", cube)}))[0, 0] == [None, 0.0, None]
    assert values(evaluate("1 / c", {"c": Image("cube", cube)}))[0, 0] == [None, None, -1.0]
    assert values(evaluate("arcsin(c * 2)", {"c": Image("cube", cube)}))[0, 0] == [None, 0.0, None]


@pytest.mark.parametrize("text", ["b + s", "c + t", "unknown + 1", "nofunction(c)", "sin(c, c)", "c + 'x'", "true + 1", "dotprod(c, b)"])
def test_what_does_not_fit(images, text):
    with pytest.raises(BandMathError):
        evaluate(text, images | {"t": [1.0, 2.0, 3.0]})


def test_one_dataset_is_joined_once(images):
    plan = evaluate("c + c * c", {"c": images["c"], "C": images["c"]})[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
