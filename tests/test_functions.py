import datetime
import math

from pyspark.sql import functions as F

from lodeworks.functions import columns as c
from lodeworks.functions import names as n
from lodeworks.functions import values as v

D = datetime.date


def one(spark, *cols, **row):
    schema = ", ".join(f"{k} {'double' if isinstance(x, float) else 'int' if isinstance(x, int) else 'string'}" for k, x in row.items())
    df = spark.createDataFrame([tuple(row.values())], schema) if row else spark.range(1)
    return tuple(df.select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).first())


def test_days(spark):
    texts = ["2024-02-29", " 02/29/2024 ", "29-FEB-2024", "2024-02-29 00:00:00", "20240229", "31/31/2024", "", None, "soon"]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(v.to_day(F.col("t")).alias("d")).collect()]
    assert got == [D(2024, 2, 29)] * 5 + [None] * 4


def test_strict_day_and_tell(spark):
    t = F.col("t")
    assert one(spark, v.strict_day(t), v.new_year_tell(t), t="01-JAN-1990") == (D(1990, 1, 1), True)
    assert one(spark, v.strict_day(t), v.new_year_tell(t), t="1-JAN-1990") == (None, False)


def test_truthy(spark):
    df = spark.createDataFrame([(x,) for x in [" yes ", "T", "1", "n", "0", "False", "maybe", "", None]], "t string")
    assert [r[0] for r in df.select(v.truthy(F.col("t"))).collect()] == [True] * 3 + [False] * 3 + [None] * 3


def test_guards(spark):
    x, y = F.col("x"), F.col("y")
    assert one(spark, v.ratio(x, y), v.clip(x, 0.0, 1.0), x=3.0, y=0.0) == (None, 1.0)
    nulls = F.lit(None).cast("double")
    assert one(spark, v.clip(nulls, 0.0), v.ratio(nulls, F.lit(1.0)), v.lookup(F.lit(None).cast("string"), {"a": "b"}, "z"), v.lookup(F.lit("q"), {"a": "b"})) == (None, None, "z", None)


def test_fiscal_year_and_whole_days(spark):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, v.fiscal_year(day("2020-09-30")), v.fiscal_year(day("2020-10-01")), v.days_between(day("2020-01-02 00:00:00"), day("2020-01-01 12:00:00")), v.days_between(day("2020-01-01"), day("2020-01-03"))) == (2020, 2021, -1, 2)


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in [-1.0, 0.0, 0.25, 2.99, 3.0, None]], "x double")
    assert [r[0] for r in df.select(v.bucket(F.col("x"), [0.0, 0.25, 3.0])).collect()] == [None, 0, 1, 1, None, None]


def test_formats(spark):
    assert one(spark, v.dollars(F.lit(-1234.5)), v.percent(F.lit(0.451), 1)) == ("-$1,234", "45.1%")


def test_mode_takes_the_smallest_of_equals_and_no_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "x string")
    assert df.agg(v.mode(F.col("x")), v.string_set(F.col("x"))).first() == ("a", "a;b")


def test_exact_sum(spark):
    df = spark.createDataFrame([(x,) for x in [0.1] * 10 + [math.nan, math.inf, None]], "x double")
    assert df.agg(c.exact_sum(F.col("x"))).first()[0] == 1.0
    assert df.limit(0).agg(c.exact_sum(F.col("x"))).first()[0] == 0.0


def test_normal_names(spark):
    names = {
        "The Acme & Sons, Inc.": "ACME AND SONS",
        "ACME  TECH LLC DBA Other": "ACME TECHNOLOGY",
        "Inc.": "INC",
        "acme IT svcs": "ACME IT SERVICES",
        "acme usa inc f/k/a Old": "ACME UNITED STATES",
        "Müller-Bau AB": "M LLER BAU",
        "The": None,
        "...": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in names], "t string").select("t", n.normal_name(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == names


def test_token_set_ratio(spark):
    df = spark.createDataFrame([("A B C", "C B A"), ("A B", "A B X"), ("ABCD", "WXYZ"), (None, "A"), ("", ""), ("", "A")], "a string, b string")
    assert [r[0] for r in df.select(n.token_set_ratio("a", "b")).collect()] == [1.0, 1.0, 0.0, None, 0.0, 0.0]


def test_free_name(spark):
    assert c.free_name(spark.createDataFrame([(1, 2)], "Node int, _node int"), "node") == ["__node"]
