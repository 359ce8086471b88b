"""Type inference on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from colscope.operators import infer as inf
from colscope.operators.infer import drop_ragged, infer_types, value_types

VALUES = [
    ("01-02-2020", "Date", "DD-MM-YYYY", 0), ("2020-02-01", "Date", "YYYY-MM-DD", 0), ("01/02/20", "Date", "DD/MM/YY", 0),
    ("01-02-20", "Date", "DD-MM-YY", 0), ("01/02/2020", "Date", "DD/MM/YYYY", 0),
    ("2020-02-01T10:11:12Z", "Date", "YYYY-MM-DDThh:mm:ssZ", 0), ("01-02-2020 10:11:12", "Date", "DD-MM-YYYY HH:MM:SS", 0),
    ("2020-02-01 10:11:12", "Date", "YYYY-MM-DD HH:MM:SS", 0), ("01/02/20 10:11:12", "Date", "DD/MM/YY HH:MM:SS", 0),
    ("01/02/2020 10:11:12", "Text", "Text", 0), ("1500", "Number", "", 0), ("2500.46", "Number", "", 2), ("-3", "Number", "", 0),
    ("0", "Percentage", "", 0), ("1", "Percentage", "", 0), ("0.5", "Percentage", "", 2), ("1.", "Percentage", "", 2),
    ("5e", "Text", "Text", 0), ("1e3", "Number", "", 0), ("1E3", "Text", "Text", 0), ("+1", "Text", "Text", 0), ("", "Null", "", 0),
    ("  ", "Null", "", 0), ("\t7 \n", "Number", "", 0), ("121 - Street", "Text", "Text", 0), ("-", "Text", "Text", 0),
    (".5", "Text", "Text", 0), ("-0.5", "Number", "", 2),
]


def test_values(spark):
    df = spark.createDataFrame([(v,) for v, *_ in VALUES], "v string")
    assert [tuple(r) for r in value_types(df, "v").collect()] == VALUES


PREVIEW = {
    "row": [str(9 - i) for i in range(10)], "river": ["Oder", "Rhine", "Elbe", "Oder", "Rhine"] * 2, "gauge": [f"km {i}.5 left" for i in range(10)],
    "depth_cm": [str(37 * i + 11) for i in range(10)], "flow": [f"{i * 13}.{i}7" for i in range(9)] + ["4"],
    "ice": ["0", "0.05", "1", "0.9", "0.33"] * 2, "salt": ["0.2", "3", "0.4", "5.5", "0"] * 2, "class": list("VWXYZVWXYZ"),
    "alarm": ["1", "0", "0", "0", "1"] * 2, "note": [""] * 10, "seen": ["31-12-1999", "1999-12-31"] * 5, "cleaned": ["28-02-2001", ""] * 5,
    "turbid": ["3", "no"] * 5,
}
EXPECTED = {
    "row": ("Number", "", 0), "river": ("Category", "Category", 0), "gauge": ("Category", "Category", 0), "depth_cm": ("Number", "", 0),
    "flow": ("Number", "", 2), "ice": ("Percentage", "", 2), "salt": ("Number", "", 2), "class": ("Category", "Category", 0),
    "alarm": ("Number", "", 0), "note": ("Text", "Text", 0), "seen": ("Category", "Category", 0),
    "cleaned": ("Date", "DD-MM-YYYY", 0), "turbid": ("Category", "Category", 0),
}


@pytest.mark.parametrize("sample", [100, None])
@pytest.mark.parametrize("older", [False, True])
def test_columns(spark, sample, older):
    df = spark.createDataFrame(list(zip(*PREVIEW.values())), ", ".join(f"{c} string" for c in PREVIEW))
    expected = dict(EXPECTED, alarm=("Percentage", "", 0)) if older else EXPECTED
    found = infer_types(df, sample_rows=sample, legacy=older)
    assert {r["column"]: (r.datatype, r.format, r.decimal) for r in found.collect()} == expected


def test_twenty_values_make_text(spark):
    df = spark.range(40).select(F.concat(F.lit("v"), F.col("id") % 19).alias("few"), F.concat(F.lit("v"), F.col("id") % 20).alias("many"))
    for sample in (100, None):
        assert {r["column"]: r.datatype for r in infer_types(df, sample_rows=sample).collect()} == {"few": "Category", "many": "Text"}


def test_ragged_lines(spark):
    lines = spark.createDataFrame([("a,b,c",), ("",), ("a,b",), ("a,b,c,d",), (",,",)], "line string")
    assert [r.line for r in drop_ragged(lines, "line", 3).collect()] == ["a,b,c", ",,"]


def test_numbers_and_their_text_agree(spark):
    fractions = [0.0, -0.0, 1.0, 0.5, 1e-3, 9.99e-4, -5.0, 9999999.0, 1e7, 1e300, float("nan"), float("inf"), None]
    wholes = [0, 1, 2, -1, 10**12, None]
    row = spark.createDataFrame([(*fractions, *wholes)], ", ".join(
        [f"d{i} double" for i in range(len(fractions))] + [f"l{i} long" for i in range(len(wholes))]))
    floats = row.select("*", *[F.col(f"d{i}").cast("float").alias(f"f{i}") for i in range(len(fractions))])
    as_text = floats.select(*[F.col(c).cast("string") for c in floats.columns])
    assert sorted(infer_types(floats).collect()) == sorted(infer_types(as_text).collect())


def test_ragged_lines_are_told_by_the_parse(spark):
    lines = ["a,b,c", 'a,"b,c",d', 'a,"say ""hi, you""",c', "a,b", "a,b,c,d", "", None, ",,", '"","",""', 'a,"b,c', "a;b;c"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, `a.line` string")
    kept = {r.i for r in inf.drop_ragged(df, "a.line", 3).collect()}
    assert kept == {0, 1, 2, 7, 8}
    assert {r.i for r in inf.ragged_lines(df, "a.line", 3).collect()} == set(range(len(lines))) - kept
    assert {r.i for r in inf.drop_ragged(df, "a.line", 1).collect()} == {5, 10}
    assert {r.i for r in inf.drop_ragged(df, "a.line", 3, ";").collect()} == {10}
    assert inf.drop_ragged(df.limit(0), "a.line", 3).count() == 0
