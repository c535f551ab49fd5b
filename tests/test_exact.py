from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from shop_rows import money, only
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercato.functions.calendar import month_from_index, month_index
from mercato.functions.exact import percent, rounded_ratio


def test_average_is_rounded_once(spark):
    # 500,001 scores of 4.28 and 500,000 of 4.29 average 4.2849999..., two roundings would give 4.29.
    row = only(
        spark.range(1_000_001)
        .select(F.when(F.col("id") < 500_001, 4.28).otherwise(4.29).cast("decimal(10,2)").alias("x"))
        .agg(F.sum("x").alias("s"), F.count("x").alias("n"))
        .select(rounded_ratio("s", "n").alias("avg"))
    )
    assert row["avg"] == money("4.28")


def test_zero_and_missing_divisors_give_null(spark):
    row = only(
        spark.sql("select 5 as a, 0 as zero, cast(null as bigint) as missing").select(
            rounded_ratio("a", "zero").alias("x"),
            percent("a", "missing").alias("y"),
            percent("missing", "a").alias("z"),
        )
    )
    assert row == {"x": None, "y": None, "z": None}


def _expected(num: Decimal, den: Decimal, places: int) -> Decimal:
    quotient = Fraction(num) / Fraction(den)
    digits = abs(quotient) * 10**places
    whole, rest = divmod(digits.numerator, digits.denominator)
    whole += 2 * rest >= digits.denominator
    return Decimal(-whole if quotient < 0 else whole).scaleb(-places)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.decimals("-99999999999999999999", "99999999999999999999", places=2),
            st.decimals("0.01", "9999999999999999", places=2),
            st.booleans(),
        ),
        min_size=20,
        max_size=60,
    )
)
def test_ratio_agrees_with_fractions(spark, pairs):
    pairs = [(n, -d if negative else d) for n, d, negative in pairs]
    # Quotients exactly on a half as well.
    pairs += [(Decimal(k) / 100, Decimal(2)) for k in range(-5, 6)]
    df = spark.createDataFrame(pairs, "n decimal(38,2), d decimal(38,2)")
    for row in df.select("n", "d", rounded_ratio("n", "d").alias("q")).collect():
        assert row.q == _expected(row.n, row.d, 2), (row.n, row.d)


def test_percent_rounds_halves_away_from_zero(spark):
    df = spark.createDataFrame([(1, 800), (-1, 800), (1, 3), (2, 3)], "a bigint, b bigint")
    got = [r[0] for r in df.select(percent("a", "b")).collect()]
    assert got == [Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP) for x in ("0.125", "-0.125", "33.333", "66.667")]


def test_month_index_round_trip(spark):
    df = spark.sql("select explode(sequence(date'1999-11-01', date'2001-02-01', interval 1 month)) as m")
    rows = df.select(F.col("m").cast("timestamp_ntz").alias("m"), month_index("m").alias("i")).withColumn(
        "back", month_from_index("i")
    )
    collected = rows.orderBy("m").collect()
    assert all(r.m == r.back for r in collected)
    assert [r.i - collected[0].i for r in collected] == list(range(16))
