"""Table operators: renames, decimals, keys."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidyloom as tl


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Customer ID", "a.b.c", "100%"])
    assert tl.clean_column_names(df).columns == ["customer_id", "abc", "100pct"]


@pytest.mark.parametrize("names", [["A B", "a_b"], ["()", "x"], ["a", "A "]])
def test_unusable_clean_names_are_refused(spark, names):
    with pytest.raises(ValueError):
        tl.clean_column_names(spark.createDataFrame([(1, 2)], names))


@pytest.mark.parametrize(
    "rename, expected",
    [
        ({"a": "b", "b": "a"}, ["b", "a", "c.d"]),
        ({"zz": "q"}, ["a", "b", "c.d"]),
        ({"A": "q"}, ["a", "b", "c.d"]),
        ({"c.d": "c`d"}, ["a", "b", "c`d"]),
    ],
)
def test_rename_present(spark, rename, expected):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c.d"])
    renamed = tl.rename_cols(df, rename)
    assert renamed.columns == expected
    assert tuple(renamed.head()) == (1, 2, 3)


def test_rename_to_a_taken_name_is_refused(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    with pytest.raises(ValueError):
        tl.rename_cols(df, {"a": "B"})


def test_decimals_at_any_depth(spark):
    schema = (
        "d decimal(12,2), a array<decimal(2,1)>, s struct<x:decimal(5,2),y:string>, "
        "m map<string,decimal(5,2)>, i int"
    )
    row = (Decimal("123456789.12"), [Decimal("1.5")], (Decimal("2.25"), "y"), {"k": Decimal("3.5")}, 1)
    df = spark.createDataFrame([row], schema)
    doubles = tl.clean_dtypes(df)
    assert doubles.schema.simpleString() == (
        "struct<d:double,a:array<double>,s:struct<x:double,y:string>,m:map<string,double>,i:int>"
    )
    assert doubles.head().asDict(recursive=True) == {
        "d": 123456789.12,
        "a": [1.5],
        "s": {"x": 2.25, "y": "y"},
        "m": {"k": 3.5},
        "i": 1,
    }
    assert tl.to_pandas_safe(df).select("d").head()[0] == 123456792.0
    assert tl.to_pandas_safe(df, T.DoubleType()).toPandas()["d"][0] == 123456789.12
    assert tl.clean_dtypes(doubles) is doubles


ZEROS = [
    (0, 0.0, False, "0", True),
    (0, 1.0, False, "0", False),
    (0, None, False, "0", False),
    (0, float("nan"), False, "0", False),
    (0, -0.0, False, "abc", True),
    (0, 0.0, True, "0", False),
    (None, None, None, None, False),
]


@pytest.fixture(scope="module")
def zeros(spark):
    return spark.createDataFrame(ZEROS, "i int, d double, b boolean, t string, expected boolean")


def test_all_zero(zeros):
    test = tl.all_zero(zeros, ["i", "d", "b"])
    assert all(r[0] == r[1] for r in zeros.select("expected", test).collect())
    assert zeros.filter(tl.all_zero(zeros, ["i", "t"])).count() == 0
    with pytest.raises(ValueError):
        tl.all_zero(zeros, [])


def test_all_zero_reaches_the_scan(spark, zeros, tmp_path):
    zeros.write.parquet(str(tmp_path / "z"))
    df = spark.read.parquet(str(tmp_path / "z"))
    kept = df.filter(tl.all_zero(df, ["i", "d"]))
    assert "EqualNullSafe(i,0)" in plan_of(kept) and "EqualNullSafe(d,-0.0)" in plan_of(kept)
    assert kept.count() == 3


def test_negative_zero_alone_in_a_file(spark, tmp_path):
    spark.sql("select -0.0D d from range(1000)").coalesce(1).write.parquet(str(tmp_path / "n"))
    df = spark.read.parquet(str(tmp_path / "n"))
    assert df.filter(tl.all_zero(df, ["d"])).count() == 1000


def expected_key(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def test_hashed_column_text_and_order(spark):
    df = spark.createDataFrame([(1, "x", 1e7, True)], "b int, a string, c double, d boolean")
    key = expected_key("xa1b10000000.0ctrued")
    for cols in (["a", "b", "c", "d"], ["d", "c", "b", "a"]):
        assert tl.get_hashed_column(df, cols, "key").head()["key"] == key
    spaced = tl.get_hashed_column(df, ["a", "b"], "key", sep="|").head()["key"]
    assert spaced == expected_key("x|a|1|b")


def test_hashed_column_nulls_and_zeros(spark):
    df = spark.createDataFrame([(0, 0.0), (0, None), (None, None)], "i int, d double").coalesce(1)
    keys = [r["k"] for r in tl.get_hashed_column(df, ["i", "d"], "k", zero_override=True).collect()]
    assert keys == [0, None, None]
    texts = tl.get_hashed_column(df, ["i", "d"], "k", nulls="text")
    assert [r["k"] for r in texts.collect()] == [
        expected_key("0.0d0i"),
        expected_key("nand0i"),
        expected_key("nandNonei"),
    ]
    assert tl.get_hashed_column(df, "i", "k").schema["k"].dataType == T.LongType()
    for bad in ([], ["i"]):
        with pytest.raises(ValueError):
            tl.get_hashed_column(df, bad, "k", nulls="drop" if bad else "null")


def test_hashing_needs_no_shuffle_and_reads_only_its_columns(spark, tmp_path):
    spark.range(10).selectExpr("id a", "id b", "id c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(tl.get_hashed_column(df, ["a", "b"], "k").select("k"))
    assert "Exchange" not in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan


def test_keyed_table(spark):
    df = spark.sql("select 1 `Order ID`, 2 `Line-No`, cast(1.50 as decimal(18,2)) `Price (USD)`")
    keyed = tl.keyed_table(df, ["order_id", "line_no"], "key", zero_override=True)
    assert keyed.dtypes == [
        ("order_id", "int"),
        ("line_no", "int"),
        ("price_usd", "double"),
        ("key", "bigint"),
    ]
    assert keyed.head()["key"] == expected_key("2line_no1order_id")


def test_operators_run_on_streams(spark, tmp_path):
    source = spark.sql("select id `Order ID`, cast(id as decimal(10,2)) `Price ($)` from range(100)")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def flow(df):
        df = tl.keyed_table(df, ["order_id"], "key", zero_override=True)
        df = tl.rename_cols(tl.with_hash_str(df, "print", skip=["key"]), {"price_$": "price"})
        return df.filter(~tl.all_zero(df, ["price"])).withColumn("label", tl.clean_label("print"))

    query = (
        flow(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = flow(spark.read.parquet(str(tmp_path / "in")))
    assert streamed.count() == 99
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()
