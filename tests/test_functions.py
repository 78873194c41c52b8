"""Golden cases of the formulas and parsers."""

import pytest
from pyspark.sql import functions as F

from quantiva.functions import kernels as K
from quantiva.functions import labels as L
from quantiva.functions import parsing as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("clear", "explicit", "want"), [(13.0, False, 14.12), (4.0, False, 4.42), (4.0, True, 4.0)])
def test_developed_length(spark, clear, explicit, want):
    assert float(one(spark, K.developed_length(F.lit(14), F.lit(clear), F.lit(explicit)))) == want


def test_stirrups(spark):
    assert float(one(spark, K.stirrup_length(F.lit(0.25), F.lit(0.45), F.lit(8)))) == 1.36
    assert one(spark, K.stirrup_count(F.lit(4.5), F.lit(0.15))) == 31


@pytest.mark.parametrize(("raw", "want"), [(0.25, 0.25), (25.0, 0.25), (250.0, 0.25), (3.5, 3.5), (None, None)])
def test_unit_gate(spark, raw, want):
    got = one(spark, K.unit_gate(F.lit(raw).cast("double")))
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize(("text", "want"), [("3.50", 3.5), ("350", 3.5), ("3500 mm", 3.5), ("16'-0\"", 4.877), ("2,5 m", 2.5), ("abc", None), (None, None)])
def test_length(spark, text, want):
    got = one(spark, P.length_metres(F.lit(text).cast("string")))
    assert (None if got is None else round(got, 4)) == want


def test_labels(spark):
    assert one(spark, P.family_of(F.lit("LG1"))) == "longrine"
    assert one(spark, P.family_of(F.lit("Q9"))) == "autre"
    assert one(spark, P.section_values(F.lit("P1(25x40)"))) == [25.0, 40.0]
    assert one(spark, P.section_values(F.lit("P1(2x40)"))) is None
    assert [tuple(g) for g in one(spark, P.rebar_groups(F.lit("6HA14+4T12")))] == [(6, 14), (4, 12)]
    assert one(spark, K.nearest_diameter(F.lit(18))) == 16
    assert one(spark, P.reverse_text(F.lit("(53X52)-02N"))) == "N20-(25X35)"


def test_references_of_many_digits(spark):
    """Keys of a larger catalogue have six digits; a label's own reference keeps its limit of four."""
    t = spark.createDataFrame([("P119999",), ("LG20001",), ("S1234",)], "t string")
    read = lambda **limit: [r["r"] for r in t.select(L.parse_reference(F.col("t"), **limit)["reference"].alias("r")).collect()]
    assert read(digits=9) == ["P119999", "LG20001", "S1234"] and read() == [None, None, "S1234"]


@pytest.mark.parametrize("parse", [L.parse_label, L.section_cm, L.parse_reference, P.room_dims, P.length_metres])
def test_parsers_grow_with_the_grammar(spark, parse):
    """A value that is named often is worked out once: the plan names a pattern some tens of times, not thousands."""
    plan = spark.createDataFrame([("P1 25x35",)], "t string").select(parse(F.col("t")).alias("v"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_extract(") < 60
