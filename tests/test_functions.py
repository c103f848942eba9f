"""Column functions against literal samples and plain-Python expectations."""

import base64
import datetime as dt
import hashlib
import json
import random
import struct
import time
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidyloom as tl
from tidyloom.functions.fingerprints import canonical_json, record_json

NAMES = {
    "Customer ID": "customer_id",
    " Total-Price (USD) ": "total_price_usd",
    "# of Items": "num_of_items",
    "Pct % Off": "pct_pct_off",
    "A&B+C": "aandbandc",
    "x|y,/z": "xoryorz",
    "a.b.c": "abc",
    "()": "",
    "__Lead -": "_lead_",
    "Año": "año",
    "A:B": "a_b",
    "100%": "100pct",
    "a\tb": "a\tb",
    "\x1f X \n": "x",
}


def column_of(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def results(df, col):
    return [row["r"] for row in df.select("i", col.alias("r")).orderBy("i").collect()]


def test_names_on_driver_and_in_columns(spark):
    assert {name: tl.clean_column_name(name) for name in NAMES} == NAMES
    df = column_of(spark, [*NAMES, None])
    assert results(df, tl.clean_label("v")) == [*NAMES.values(), None]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_clean_names_hold_none_of_the_replaced_characters(name):
    assert not set(tl.clean_column_name(name)) & set(" :-#%&+|,/;().ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def test_levels(spark):
    texts = [
        "(2) powertrain",
        "None",
        "powertrain",
        "(lvl 12b3) x (9) y",
        "() z",
        "(7)nospace",
        None,
        "(99999999999999999999) big",
        "x (\n3) y",
    ]
    df = column_of(spark, texts)
    assert results(df, tl.clean_level("v")) == [
        "powertrain",
        "None",
        "powertrain",
        "x y",
        "z",
        "(7)nospace",
        None,
        "big",
        "x y",
    ]
    assert results(df, tl.get_num_value("v")) == [2, None, None, 12, None, None, None, None, 3]


def test_strict_level_number_stops_on_texts_without_one(spark):
    fine = column_of(spark, ["(2) a", "None", None])
    assert results(fine, tl.get_num_value("v", strict=True)) == [2, None, None]
    with pytest.raises(Exception, match="no level number in: powertrain"):
        results(column_of(spark, ["powertrain"]), tl.get_num_value("v", strict=True))


INTEGER_TEXTS = {
    "double": [
        (3.7, "3"),
        (-3.7, "-3"),
        (0.0, "0"),
        (-0.5, "0"),
        (1000000000000000.0, "1000000000000000"),
        (9000000000000000.0, "9000000000000000"),
        (-1e+18, "-1000000000000000000"),
        (float("nan"), "nan"),
        (float("inf"), "inf"),
        (-float("inf"), "-inf"),
        (10000000000.0, "10000000000"),
    ],
    "float": [
        (3.5, "3"),
        (-3.5, "-3"),
        (float("nan"), "nan"),
    ],
    "bigint": [
        (0, "0"),
        (-5, "-5"),
        (4611686018427387904, "4611686018427387904"),
    ],
    "boolean": [
        (True, "1"),
        (False, "0"),
    ],
    "decimal(20,3)": [
        (Decimal("3.700"), "3"),
        (Decimal("-3.999"), "-3"),
        (Decimal("-0.5"), "0"),
        (Decimal("12345678901234567.1"), "12345678901234567"),
    ],
    "decimal(38,0)": [
        (Decimal("1.000000000000000000000000000E+37"), "10000000000000000000000000000000000000"),
    ],
    "string": [
        ("3.7", "3.7"),
        (" 3 ", "3"),
        ("007", "7"),
        ("+5", "5"),
        ("-0", "0"),
        ("-007", "-7"),
        ("abc", "abc"),
        ("", ""),
        ("1e3", "1e3"),
        ("9" * 60, "9" * 60),
        ("0", "0"),
        (" 12\n", "12"),
        ("--1", "--1"),
        ("+", "+"),
    ],
    "date": [
        (dt.date(2020, 1, 2), "2020-01-02"),
    ],
    "timestamp_ntz": [
        (dt.datetime(2020, 1, 2, 3, 4, 5), "2020-01-02 03:04:05"),
        (dt.datetime(2020, 1, 2, 3, 4, 5, 7), "2020-01-02 03:04:05.000007"),
    ],
}


@pytest.mark.parametrize("dtype", INTEGER_TEXTS)
def test_integer_text(spark, dtype):
    df = column_of(spark, [value for value, _ in INTEGER_TEXTS[dtype]], dtype)
    got = results(df, tl.convert_value(F.col("v"), df.schema["v"].dataType))
    assert got == [text for _, text in INTEGER_TEXTS[dtype]]


def test_integer_text_of_an_instant_has_no_zone(spark):
    df = spark.sql("SELECT timestamp'2020-01-02 03:04:05+00:00' AS v, 0 AS i")
    assert results(df, tl.convert_value(F.col("v"), df.schema["v"].dataType)) == ["2020-01-02 03:04:05"]


def test_integer_text_passes_over_long_texts_once(spark):
    texts = ["0" * 20_000 + "x", "0" * 20_000, "-" + "0" * 20_000 + " ", "0" * 20_000 + "x 1"]
    start = time.perf_counter()
    got = results(column_of(spark, texts * 20), tl.convert_value(F.col("v"), T.StringType()))
    assert got == [texts[0], "0", "0", texts[3]] * 20 and time.perf_counter() - start < 20


def test_integer_text_of_null(spark):
    for dtype in ("string", "double", "boolean", "decimal(5,1)", "int"):
        df = column_of(spark, [None], dtype)
        spark_type = df.schema["v"].dataType
        assert results(df, tl.convert_value(F.col("v"), spark_type)) == [None]
        assert results(df, tl.convert_value(F.col("v"), spark_type, none_text=True)) == ["None"]


def test_float_text_equals_python_repr(spark):
    rng = random.Random(7)
    values = [1e7, 1e15, 1e16, 1.5e-7, 0.0001, 0.00012345, 0.001, -0.0, 5e-324, 1e22, 1e100, 2.0**-44, 0.1 + 0.2]
    values += [rng.random() * 10 ** rng.randint(-8, 15) for _ in range(20000)]
    values += [round(rng.random() * 10 ** rng.randint(0, 9), 2) for _ in range(20000)]
    values += [float("nan"), float("inf"), -float("inf")]
    df = column_of(spark, values, "double")
    assert results(df, tl.float_text(F.col("v"), T.DoubleType())) == [repr(v) for v in values]


def test_float_text_of_32_bits_equals_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate(
        [rng.standard_normal(20000), rng.random(20000) * 10.0 ** rng.integers(-3, 15, 20000)]
    ).astype("float32")
    df = column_of(spark, [float(v) for v in values], "float")
    expected = [
        np.format_float_positional(v, unique=True, trim="0") if abs(v) < 1e7 else f"{int(v)}.0"
        for v in values
    ]
    got = results(df, tl.float_text(F.col("v"), T.FloatType()))
    plain = [(g, e) for g, e, v in zip(got, expected, values) if abs(v) >= 1e-4]
    assert len(plain) > 39000 and all(g == e for g, e in plain)


def test_float_text_always_reads_back(spark):
    rng = random.Random(8)
    values = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(20000)]
    values = [v for v in values if v == v]
    df = column_of(spark, values, "double")
    assert [float(t) for t in results(df, tl.float_text(F.col("v"), T.DoubleType()))] == values


def test_times_do_not_follow_the_session_time_zone(spark):
    # 02:30 on that day does not exist in New York.
    df = spark.sql(
        "select 0 i, timestamp_micros(1583643600000450) t, timestamp_ntz'2020-03-08 02:30:00' n, "
        "timestamp_ntz'0001-01-01 00:00:00.1' o, date'2018-11-04' d"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = set()
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            columns = [tl.iso_text(F.col(f.name), f.dataType) for f in df.schema if f.name != "i"]
            texts.add(tuple(df.select(*columns).head()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert texts == {
        ("2020-03-08T05:00:00.000450+00:00", "2020-03-08T02:30:00", "0001-01-01T00:00:00.100000", "2018-11-04")
    }


URLS = {
    "s3://bucket/hello/world": ("bucket", "hello/world", "s3://bucket/hello/world"),
    "s3://b/k/x?y=1": ("b", "k/x?y=1", "s3://b/k/x?y=1"),
    "s3://b?x=1": ("b", "?x=1", "s3://b?x=1"),
    "s3://b#x": ("b", "#x", "s3://b/#x"),
    "s3://b/k?": ("b", "k", "s3://b/k"),
    "s3://b/k??": ("b", "k??", "s3://b/k??"),
    "s3://b/a b#c": ("b", "a b#c", "s3://b/a b#c"),
    "s3://my_bucket//k": ("my_bucket", "k", "s3://my_bucket//k"),
    "s3://b": ("b", "", "s3://b"),
    "s3://b/a;p": ("b", "a;p", "s3://b/a;p"),
    "S3://b/K": ("b", "K", "s3://b/K"),
    " s3://b/k\n1": ("b", "k1", "s3://b/k1"),
    "folder/file.csv": ("", "folder/file.csv", "folder/file.csv"),
}


def test_urls(spark):
    df = column_of(spark, [*URLS, None])
    got = [tuple(r) for r in results(df, tl.split_url("v"))]
    assert got == [*URLS.values(), (None, None, None)]


def test_urls_of_any_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab/?#;:@.%&=_ \t-S3", k=rng.randint(0, 14))) for _ in range(3000)]
    urls = [rng.choice(["s3://", "S3a://"]) + "bucket/" + text.strip() for text in texts]
    for url, (bucket, key, _) in zip(urls, results(column_of(spark, urls), tl.split_url("v"))):
        assert bucket == "bucket" and not key.startswith("/")
        rest = url.split("bucket/", 1)[1].replace("\t", "").lstrip("/")
        assert key in (rest, rest.removesuffix("?"))


# Fingerprints: literal texts and digests.


RECORDS = [
    {
        "b": True,
        "f": 1.5,
        "z": None,
        "k": 3,
        "s": 'NA"T\\x',
        "d": dt.date(2020, 2, 29),
        "t": dt.datetime(2020, 1, 2, 3, 4, 5),
        "l": [10, 9, 1],
        "w": ["b", "a", "B", "é"],
        "n": {"y": [2, 1], "x": {"deep": "v", "a": 1}},
        "m": {"q": 2, "p": 1},
        "ll": [[9, 1], [0, 2], [10, 10]],
        "ls": [{"a": 2, "b": "x"}, {"a": 1, "b": "y"}],
    },
    {
        "b": False,
        "f": 1e7,
        "z": "é\u007f\n\t\r\b\f\u0001\u001f😀",
        "k": -(2**40),
        "s": "",
        "d": dt.date(1, 1, 1),
        "t": dt.datetime(2020, 1, 2, 3, 4, 5, 7),
        "l": [],
        "w": ["\U0001f600", "￮"],
        "n": {"y": [], "x": {"deep": "中文 mixed 中", "a": 0}},
        "m": {},
        "ll": [[1, 9], [2, 0]],
        "ls": [],
    },
]
RECORD_TYPE = (
    "b boolean, f double, z string, k bigint, s string, d date, t timestamp_ntz, l array<int>, "
    "w array<string>, n struct<y:array<int>,x:struct<deep:string,a:int>>, m map<string,int>, "
    "ll array<array<int>>, ls array<struct<a:int,b:string>>"
)


# Fixed values.
RECORD_TEXTS = [
    '[["b",true],["d","2020-02-29"],["f",1.5],["k",3],["l",[1,9,10]],["ll",[[0,2],[1,9],[10,10]]],["ls",[[["a",1],["b","y"]],[["a",2],["b","x"]]]],["m",[["p",1],["q",2]]],["n",[["x",[["a",1],["deep","v"]]],["y",[1,2]]]],["s","NA\\"T\\\\x"],["t","2020-01-02T03:04:05"],["w",["B","a","b","\\u00e9"]],["z",null]]',
    '[["b",false],["d","0001-01-01"],["f",10000000.0],["k",-1099511627776],["l",[]],["ll",[[0,2],[1,9]]],["ls",[]],["m",[]],["n",[["x",[["a",0],["deep","\\u4e2d\\u6587 mixed \\u4e2d"]]],["y",[]]]],["s",""],["t","2020-01-02T03:04:05.000007"],["w",["\\uffee","\\ud83d\\ude00"]],["z","\\u00e9\\u007f\\n\\t\\r\\b\\f\\u0001\\u001f\\ud83d\\ude00"]]',
]
RECORD_DIGESTS = [
    "tV__YI87MXEuFekrR89enJ31msz7Vhg4BCSu1T8DxiE=",
    "okSmQHFfQqYOeoYcFKUpL1W6-se1JDlBPMP6WpMsdX8=",
]
SKIPPED = ("z", "deep", "p", "a")
SKIPPED_TEXTS = [
    '[["b",true],["d","2020-02-29"],["f",1.5],["k",3],["l",[1,9,10]],["ll",[[0,2],[1,9],[10,10]]],["ls",[[["b","x"]],[["b","y"]]]],["m",[["q",2]]],["n",[["x",[]],["y",[1,2]]]],["s","NA\\"T\\\\x"],["t","2020-01-02T03:04:05"],["w",["B","a","b","\\u00e9"]]]',
    '[["b",false],["d","0001-01-01"],["f",10000000.0],["k",-1099511627776],["l",[]],["ll",[[0,2],[1,9]]],["ls",[]],["m",[]],["n",[["x",[]],["y",[]]]],["s",""],["t","2020-01-02T03:04:05.000007"],["w",["\\uffee","\\ud83d\\ude00"]]]',
]
SKIPPED_DIGESTS = [
    "YIwWgJozfCufqzPTau-_UOnroSTT3rbLaSAoNy1kQqA=",
    "g9_djz5nYTCCDvXDI40Bx8hrI9WoquYW4IqKBY-53K4=",
]
SHA512_DIGESTS = [
    "SC98sk5Y0nnJe20ddyTH4mx0WGNzGnmG28ZLAOBSm-SWhILArR8VcJJ5kAfBq_8607-aMRh5_5-cWwqHlld5Mg==",
    "vUVys1c9J4YdFl1rjmjUxsJcQipUSqn4_pBGPw1wY6_FTtye89Bmwj0talJEKaSkz1MMJUqINgQiUuladIbAtw==",
]
VALUE_DIGESTS = {
    "l": [
        "pLqAa996DiN_NG39XZc2Ea8bzdV2TxRUwm_va4mmCdc=",
        "T1PNoYwrqgwDVLtfmj7L5e0Sq02OEbqHPC8RFhICuUU=",
    ],
    "ll": [
        "D_wmZSrTAPNXmeSORWSmranSgnKQxCXcVomI9cZ5Ay8=",
        "xLeV183uev5Xbi7Bt8ExlsArhxsvV0qfuCqU8bHhQ_0=",
    ],
    "ls": [
        "3qFx7Hh3VOe0AxmSBXWx9HqGL4aSRQ7RTPllsk_wUas=",
        "T1PNoYwrqgwDVLtfmj7L5e0Sq02OEbqHPC8RFhICuUU=",
    ],
    "m": [
        "nnEBYzZUxXqlUDI6Iv_g-7wL58ofTSfUOsZMGgkjrEs=",
        "T1PNoYwrqgwDVLtfmj7L5e0Sq02OEbqHPC8RFhICuUU=",
    ],
    "s": [
        "UW8qUnGwYVpFsPiJcc5UfwytP-kuEgHIImhY0zHly3s=",
        "Eq4yyx7ALQHto1gbEnwf7jsNxTVy7WuvI5choD2C4SY=",
    ],
    "z": [
        "dCNOmK_nSY-12vHzasLXiswzlGT5UHA7jAGYkvmCuQs=",
        "3iTGvRy-ZvMYU3wCRWN0zdDV2Qdqi5qsL-fZRBZ4kKc=",
    ],
    "t": [
        "JcqCWA2w-VTwAcTdJn0z-8tPGJAjmMlP8AcPLYVulXE=",
        "45IWZMkLzgBCiC4u-DwU4PZAoNPm0l_s5KoAUjVyXOg=",
    ],
    "k": [
        "TgdAhWK-24tgzgXB3s_jrRa3IjCWfeAfZAt-Rym0n84=",
        "hFfSzVIcLupZW1iyPSxnURUji4Bc29N7K8JCQr0zKBE=",
    ],
}


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, RECORD_TYPE).coalesce(1)


@pytest.mark.parametrize(
    "skip, texts, digests",
    [((), RECORD_TEXTS, RECORD_DIGESTS), (SKIPPED, SKIPPED_TEXTS, SKIPPED_DIGESTS)],
)
def test_record_fingerprints(records, skip, texts, digests):
    got = records.select(tl.record_json(records, skip=skip), tl.row_hash_str(records, skip=skip)).collect()
    assert [tuple(row) for row in got] == list(zip(texts, digests))


@pytest.mark.parametrize(
    "value, text",
    [
        ('{"b": [3, "x", null, true, {"z": 1, "a": [2, 1]}, 1.50, [9, 1], false, "a", 10], "a": "é\\n"}',
         '[["a","\\u00e9\\n"],["b",[false,true,1.5,3,10,"a","x",[1,9],[["a",[1,2]],["z",1]],null]]]'),
        ("[]", "[]"),
        ("{}", "[]"),
        ("null", "null"),
        ('"q\\"x"', '"q\\"x"'),
        ("[1e20, 0.1, 12345678901234567890, 1.0, 0.12345678901234567891]", "[0.1,0.12345678901234567891,1,12345678901234567890,1e+20]"),
        ('[{"skip": 1}, {"k": 2, "skip": 0}]', '[[],[["k",2]]]'),
    ],
)
def test_variants_are_written_by_value(spark, value, text):
    df = spark.createDataFrame([(value,)], "j string").select(F.parse_json("j").alias("v"), F.lit(1).alias("n"))
    found = df.select(canonical_json(F.col("v"), df.schema["v"].dataType, ["skip"])).head()[0]
    assert found == text
    digest = base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode()
    assert df.select(tl.get_hash_str(F.col("v"), df.schema["v"].dataType, ["skip"])).head()[0] == digest
    row = base64.urlsafe_b64encode(hashlib.sha256(f'[["n",1],["v",{text}]]'.encode()).digest()).decode()
    assert df.select(tl.row_hash_str(df, skip=["skip"])).head()[0] == row


def test_variants_within_lists_maps_and_records(spark):
    df = spark.sql("""SELECT array(parse_json('2'), parse_json('"a"'), parse_json('1')) AS l, map('k', parse_json('[2, 1]')) AS m,
        named_struct('y', parse_json('{"b": 1, "a": 2}'), 'x', CAST(NULL AS variant)) AS s, CAST(NULL AS variant) AS n""")
    found = df.select(record_json(df)).head()[0]
    assert found == '[["l",[1,2,"a"]],["m",[["k",[1,2]]]],["n",null],["s",[["x",null],["y",[["a",2],["b",1]]]]]]'
    bad = spark.sql("SELECT array(named_struct('v', parse_json('1'))) AS a")
    with pytest.raises(ValueError, match="inside records of a list"):
        tl.row_hash_str(bad)


def test_sha512_of_region_is_fixed(spark):
    regions = [(0, "AFRICA"), (1, "AMERICA"), (2, "ASIA")]
    df = spark.createDataFrame(regions, "r_regionkey int, r_name string")
    expected = {
        k: base64.urlsafe_b64encode(hashlib.sha512(f'[["r_name","{n}"],["r_regionkey",{k}]]'.encode()).digest()).decode() for k, n in regions
    }
    assert {r["r_regionkey"]: r["hash_str"] for r in tl.with_hash_str(df, sha512=True).collect()} == expected


def test_sha512_query_equals_hashlib(spark):
    import __spark_entry__

    smoke = __spark_entry__.SMOKE_DIR
    customers = spark.read.parquet(f"{smoke}/customer.parquet").collect()
    found = {r["c_custkey"]: r["hash_str"] for r in __spark_entry__.row_fingerprint_sha512(spark, smoke).collect()}
    assert len(found) == len(customers)
    for r in customers:
        text = json.dumps([[k, r[k]] for k in sorted(r.asDict())], separators=(",", ":"))
        assert found[r["c_custkey"]] == base64.urlsafe_b64encode(hashlib.sha512(text.encode()).digest()).decode()


def test_sha512_fingerprint(records):
    got = [row[0] for row in records.select(tl.row_hash_str(records, sha512=True)).collect()]
    assert got == SHA512_DIGESTS


@pytest.mark.parametrize("name", VALUE_DIGESTS)
def test_fingerprint_of_one_value(records, name):
    dtype = records.schema[name].dataType
    got = [row[0] for row in records.select(tl.get_hash_str(F.col(name), dtype)).collect()]
    assert got == VALUE_DIGESTS[name]


def test_fingerprint_ignores_list_and_column_order(spark):
    df = spark.createDataFrame([([3, 1], 5), ([1, 3], 5)], "a array<int>, b int").coalesce(1)
    swapped = df.select("b", "a")
    prints = [r[0] for d in (df, swapped) for r in d.select(tl.row_hash_str(d)).collect()]
    assert len(set(prints)) == 1


def test_fingerprint_of_missing_parts(spark):
    df = spark.createDataFrame(
        [(None, None, None)], "a array<int>, s struct<x:int>, m map<string,int>"
    )
    assert df.select(tl.record_json(df)).head()[0] == '[["a",null],["m",null],["s",null]]'
    assert df.select(tl.record_json(df, skip=["a", "s", "m"])).head()[0] == "[]"


def test_fingerprint_needs_a_text(spark):
    df = spark.sql("select binary('x') b, 1 a")
    with pytest.raises(ValueError, match="binary"):
        tl.record_json(df)
    assert df.select(tl.record_json(df, skip=["b"])).head()[0] == '[["a",1]]'


# Plain functions as UDFs.


@tl.py_or_udf(returnType="int")
def plus(a, b=1):
    """Sum."""
    return a + b


@tl.py_or_udf(null_safe=True)
def shout(text):
    return text.upper() + "!"


def test_function_on_values_and_columns(spark):
    assert plus(2) == 3 and plus(2, b=5) == 7 and plus.__doc__ == "Sum."
    df = column_of(spark, [1, 2], "int")
    assert results(df, plus(F.col("v"))) == [2, 3]
    assert results(df, plus(F.col("v"), b=F.col("i"))) == [1, 3]


def test_null_safe_function(spark):
    assert shout(None) is None and shout("a") == "A!"
    assert results(column_of(spark, ["a", None]), shout(F.col("v"))) == ["A!", None]


def test_default_return_type_is_text(spark):
    length = tl.py_or_udf()(len)
    assert results(column_of(spark, ["ab"]), length(F.col("v"))) == ["2"]
