"""

Queries that go through files write to a fresh folder on shared storage: the one the session names in
``spark.checkpoint.dir``, or a temporary one where it is unset and Spark runs locally.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tidyloom as tl  # noqa: E402

try:  # the training-data operators may be left out
    from tidyloom.llm import queries as _llm
except ImportError:
    _llm = None

if __name__ in sys.modules:
    # Tasks carry the functions below, so this file need not be on the executors.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMOKE_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(func: Query) -> Query:
        _QUERIES[func.__name__] = func
        if sql is not None:
            _ORACLES[func.__name__] = sql
        return func

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | (_llm.QUERIES if _llm else {})


def oracle_sql() -> dict[str, str]:
    return _ORACLES | (_llm.ORACLES if _llm else {})


def entry(spark: SparkSession) -> DataFrame:
    """Load by entry, then clean names, key and plain numbers in one projection."""
    return keyed_lineitem(spark, SMOKE_DIR)


# Shared by the queries.


def test_catalog(sf_dir: str) -> dict:
    return {
        name: {"file_path": f"{sf_dir}/{name}.parquet", "file_format": "parquet"} for name in TABLES
    }


def load(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return tl.load_data(spark, test_catalog(sf_dir), name, **options)


def month(timestamp: str) -> Column:
    return F.substring(F.col(timestamp).cast("string"), 1, 7)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name where every executor can write and read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def round_trip(
    spark: SparkSession, df: DataFrame, fmt: str, load: dict | None = None, save: dict | None = None
) -> DataFrame:
    """Save by entry, load by entry."""
    catalog = {
        "there": {
            "file_path": shared_folder(spark),
            "file_format": fmt,
            "load": load or {},
            "save": save or {},
        }
    }
    tl.save_data(df, catalog, "there")
    return tl.load_data(spark, catalog, "there")


# Loading by entry


@query("SELECT * FROM orders")
def load_entry_parquet(spark, sf_dir):
    return load(spark, sf_dir, "orders")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def load_entry_columns(spark, sf_dir):
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    orders = load(spark, sf_dir, "orders", columns=columns)
    return orders.filter("o_orderstatus = 'F'").drop("o_orderstatus")


@query(
    "SELECT 'customer' AS entry, count(*) AS n FROM customer "
    "UNION ALL SELECT 'lineitem', count(*) FROM lineitem"
)
def load_inputs_pair(spark, sf_dir):
    """Two entries in one call: a file under a folder, and an entry that is the table itself."""
    entries = {
        "store": {"file_path": f"{sf_dir}/", "file_format": "parquet"},
        "lineitem": test_catalog(sf_dir)["lineitem"],
    }
    loaded = tl.load_inputs(spark, entries, {"store": "customer.parquet", "lineitem": None})
    names = {"store": "customer", "lineitem": "lineitem"}
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(names[entry]).alias("entry"), "n")
        for entry, df in loaded.items()
    ]
    return counts[0].unionAll(counts[1])


CUSTOMER_SQL = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0"


@query(CUSTOMER_SQL)
def load_sql_query(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    catalog = {"debtors": {"file_path": CUSTOMER_SQL, "file_format": "sql_query"}}
    return tl.load_data(spark, catalog, "debtors")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def load_sql_table(spark, sf_dir):
    load(spark, sf_dir, "supplier").createOrReplaceTempView("supplier_table")
    catalog = {"supplier": {"file_path": "supplier_table", "file_format": "sql"}}
    return tl.load_data(spark, catalog, "supplier")


# Saving and loading again


@query(
    "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, "
    "o_totalprice::VARCHAR AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate, "
    "o_orderpriority FROM orders"
)
def roundtrip_csv(spark, sf_dir):
    # Without a schema every csv column is text.
    return round_trip(spark, load(spark, sf_dir, "orders"), "csv")


WHOLE_TEXTS_SQL = (
    "SELECT doc_id AS id, ' ' || text || chr(9) AS text FROM documents WHERE text <> '' "
    "UNION ALL SELECT conv_id * 1000 + turn, ' ' || text || chr(9) FROM conversations WHERE text <> ''"
)


def whole_texts(spark, sf_dir):
    """Texts with blanks at both ends, line breaks, quotes and separators."""
    turns = load(spark, sf_dir, "conversations")
    ids = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    texts = texts.unionAll(turns.select(ids, "text")).filter("text <> ''")
    return texts.select("id", F.concat(F.lit(" "), "text", F.lit("\t")).alias("text"))


@query(WHOLE_TEXTS_SQL)
def roundtrip_csv_texts(spark, sf_dir):
    texts = whole_texts(spark, sf_dir)
    return round_trip(spark, texts, "csv", load={"schema": texts.schema, "multiLine": True, "rangeBytes": 1_000_000})


@query(WHOLE_TEXTS_SQL)
def roundtrip_tsv_texts(spark, sf_dir):
    texts = whole_texts(spark, sf_dir)
    load_options = {"schema": texts.schema, "multiLine": True, "sep": "\t"}
    return round_trip(spark, texts, "csv", load=load_options, save={"sep": "\t"})


@query(WHOLE_TEXTS_SQL)
def roundtrip_xml_texts(spark, sf_dir):
    texts = whole_texts(spark, sf_dir)
    row = {"rowTag": "document"}
    return round_trip(spark, texts, "xml", load={**row, "schema": texts.schema}, save=row)


@query("SELECT * FROM events")
def roundtrip_csv_schema(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return round_trip(spark, events, "csv", load={"schema": events.schema})


@query(
    "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size, "
    "p_retailprice::VARCHAR AS p_retailprice FROM part"
)
def roundtrip_tsv(spark, sf_dir):
    folder = shared_folder(spark)
    catalog = {
        "written": {"file_path": folder, "file_format": "csv", "save": {"sep": "\t"}},
        "read": {"file_path": folder, "file_format": "table"},
    }
    tl.save_data(load(spark, sf_dir, "part"), catalog, "written")
    return tl.load_data(spark, catalog, "read")


@query("SELECT * FROM lineitem")
def roundtrip_orc(spark, sf_dir):
    return round_trip(spark, load(spark, sf_dir, "lineitem"), "orc")


@query("SELECT * FROM documents")
def load_json_lines(spark, sf_dir):
    return round_trip(spark, load(spark, sf_dir, "documents"), "json", load={"multiLine": False})


@query("SELECT * FROM orders")
def roundtrip_json_schema(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return round_trip(spark, orders, "json", load={"schema": orders.schema, "multiLine": False})


@query("SELECT * FROM supplier")
def roundtrip_xml(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier")
    row = {"rowTag": "supplier"}
    return round_trip(spark, supplier, "xml", load={**row, "schema": supplier.schema}, save=row)


@query("SELECT * FROM lineitem")
def roundtrip_feather(spark, sf_dir):
    return round_trip(spark, load(spark, sf_dir, "lineitem"), "feather")


@query(
    "SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1)::BIGINT AS place "
    "FROM embeddings"
)
def roundtrip_feather_arrays(spark, sf_dir):
    there = round_trip(spark, load(spark, sf_dir, "embeddings"), "feather")
    parts = there.select("vec_id", "label", F.posexplode("embedding").alias("at", "part"))
    place = (F.col("at") + 1).cast("bigint").alias("place")
    return parts.select("vec_id", "label", F.col("part").cast("double").alias("value"), place)


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus, "
    "CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, o_orderpriority FROM orders"
)
def roundtrip_partitioned_dynamic(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    save = {"partitionBy": ["o_orderstatus"], "partitionOverwriteMode": "dynamic", "rebalance": True}
    catalog = {
        "there": {"file_path": shared_folder(spark), "file_format": "parquet", "save": save}
    }
    tl.save_data(orders, catalog, "there")
    changed = orders.filter("o_orderstatus = 'P'")
    changed = changed.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    tl.save_data(changed, catalog, "there")
    return tl.load_data(spark, catalog, "there").select(*orders.columns)


@query("SELECT * FROM orders")
def publish_clean_table(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = load(spark, sf_dir, "orders").withColumn("o_totalprice", price)
    catalog = {"orders": {"file_path": "unused", "file_format": "parquet"}}
    prefix = f"t{uuid.uuid4().hex}"
    return spark.table(
        tl.publish_data(orders, catalog, "orders", prefix=prefix, path=shared_folder(spark))
    )


@query("SELECT * FROM customer")
def save_sql_table(spark, sf_dir):
    catalog = {"saved": {"file_path": f"t{uuid.uuid4().hex}", "file_format": "sql"}}
    tl.save_data(load(spark, sf_dir, "customer"), catalog, "saved", path=shared_folder(spark))
    return tl.load_data(spark, catalog, "saved")


# Formats without a reader in Spark


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def load_fixed_width(spark, sf_dir):
    widths = {"s_suppkey": 20, "s_name": 30, "s_nationkey": 8, "s_acctbal": 24}
    supplier = load(spark, sf_dir, "supplier")
    line = F.concat(*[F.rpad(F.col(n).cast("string"), w, " ") for n, w in widths.items()])
    folder = shared_folder(spark)
    supplier.select(line.alias("value")).write.text(folder)
    load_options = {"widths": list(widths.values()), "schema": supplier.schema}
    catalog = {"lines": {"file_path": folder, "file_format": "fwf", "load": load_options}}
    return tl.load_data(spark, catalog, "lines")


@query(
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, "
    "sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1"
)
def load_json_documents(spark, sf_dir):
    """A pretty-printed document per month, each in a file of its own."""
    orders = load(spark, sf_dir, "orders", columns=["o_orderdate", "o_totalprice"])
    months = orders.groupBy(month("o_orderdate").alias("month")).agg(
        F.count("*").alias("orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
    )
    document = F.to_json(F.struct("month", "orders", "cents"), {"pretty": "true"})
    folder = shared_folder(spark)
    months.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    catalog = {"months": {"file_path": folder, "file_format": "json"}}
    return tl.load_data(spark, catalog, "months")


@query(
    "SELECT page_id, 0 AS table_no, 0 AS row_no, 'page|address' AS cells FROM pages "
    "UNION ALL SELECT page_id, 0, 1, page_id::VARCHAR || '|' || url FROM pages"
)
def html_tables(spark, sf_dir):
    """Every page, whole, behind a rendered table with its own number and address."""
    pages = load(spark, sf_dir, "pages")
    address = F.replace("url", F.lit("&"), F.lit("&amp;"))
    rendered = F.concat(
        F.lit("<table><tr><th>page</th><th>address</th></tr>\n<tr><td>"),
        F.col("page_id").cast("string"),
        F.lit("</td><td>"),
        address,
        F.lit("</td></tr></table>"),
        F.col("html"),
    )
    rows = tl.html_tables(pages.withColumn("html", rendered), "html", "page_id")
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("SELECT * FROM orders")
def load_json_array(spark, sf_dir):
    """All orders as one array in one file, read in ranges of 100 KB by several tasks."""
    orders = load(spark, sf_dir, "orders")
    folder = shared_folder(spark)
    element = F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value")
    array_lines(orders.select(element)).write.text(folder)
    load_options = {"schema": orders.schema, "rangeBytes": 100_000}
    catalog = {"array": {"file_path": folder, "file_format": "json", "load": load_options}}
    return tl.load_data(spark, catalog, "array")


def array_lines(elements: DataFrame) -> DataFrame:
    """The elements in ``value`` as the lines of one array, in one partition: one file is what this is about.

    The rows pass through their task one by one: which is the first and which the last is told by their numbers, without a sort.
    """
    last = elements.count() - 1
    place = F.monotonically_increasing_id()
    opening, closing = F.when(place == 0, "[").otherwise(""), F.when(place == last, "]").otherwise(",")
    return elements.repartition(1).select(F.concat(opening, "value", closing).alias("value"))


SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"


@query(SUPPLIER_SQL)
def load_fixed_width_inferred(spark, sf_dir):
    """Rendered suppliers, read without positions or types: both come from all lines."""
    supplier = load(spark, sf_dir, "supplier")
    line = F.concat_ws(
        "  ", F.rpad(F.col("s_suppkey").cast("string"), 12, " "), F.rpad("s_name", 30, " "), F.lpad(F.col("s_nationkey").cast("string"), 5, " "),
        F.lpad(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), 20, " "),
    )
    folder = shared_folder(spark)
    supplier.select(line.alias("value")).write.text(folder)
    load_options = {"names": supplier.columns, "inferTypes": True}
    return tl.load_data(spark, {"lines": {"file_path": folder, "file_format": "fwf", "load": load_options}}, "lines")


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate FROM lineitem"
)
def load_table_inferred_types(spark, sf_dir):
    """Line items as tab-separated text, with types inferred from all rows."""
    folder = shared_folder(spark)
    catalog = {
        "written": {"file_path": folder, "file_format": "csv", "save": {"sep": "\t"}},
        "read": {"file_path": folder, "file_format": "table", "load": {"inferTypes": True}},
    }
    tl.save_data(load(spark, sf_dir, "lineitem"), catalog, "written")
    return tl.load_data(spark, catalog, "read")


# Checks of rows

LINEITEM_RULES = {
    "small": "l_quantity < 45",
    "late": "l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00'",
    "discounted": "l_discount > 0",
    "open": "l_linestatus = 'O' OR l_returnflag <> 'N'",
}


@query(
    "SELECT 'rows' AS rule, count(*) AS n FROM lineitem "
    "UNION ALL SELECT 'small', count(*) FROM lineitem WHERE NOT l_quantity < 45 "
    "UNION ALL SELECT 'late', count(*) FROM lineitem WHERE NOT l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' "
    "UNION ALL SELECT 'discounted', count(*) FROM lineitem WHERE NOT l_discount > 0 "
    "UNION ALL SELECT 'open', count(*) FROM lineitem WHERE NOT (l_linestatus = 'O' OR l_returnflag <> 'N')"
)
def check_counts_of_save(spark, sf_dir):
    """Rows that break each rule, counted by the write itself."""
    catalog = {"there": {"file_path": shared_folder(spark), "file_format": "parquet", "save": {"checks": LINEITEM_RULES}}}
    counts = tl.save_data(load(spark, sf_dir, "lineitem"), catalog, "there")
    return spark.createDataFrame(list(counts.items()), "rule string, n bigint")


@query(
    "SELECT rule, l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter(["
    "CASE WHEN NOT l_quantity < 45 THEN 'small' END, CASE WHEN NOT l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' THEN 'late' END, "
    "CASE WHEN NOT l_discount > 0 THEN 'discounted' END, CASE WHEN NOT (l_linestatus = 'O' OR l_returnflag <> 'N') THEN 'open' END"
    "], lambda x: x IS NOT NULL)) AS rule FROM lineitem)"
)
def rows_that_break_rules(spark, sf_dir):
    return tl.broken_rows(load(spark, sf_dir, "lineitem"), LINEITEM_RULES).select("rule", "l_orderkey", "l_linenumber")


# File inventory


def monthly_orders(spark: SparkSession, sf_dir: str) -> dict:
    """A catalog whose first entry holds the F orders in one folder per month."""
    orders = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND month(o_orderdate) != 2")
    save = {"partitionBy": "month", "rebalance": True}
    folder = shared_folder(spark)
    catalog = {
        "orders_by_month": {"file_path": folder, "file_format": "parquet", "save": save},
        "gone": {"file_path": f"{folder}-gone", "file_format": "parquet"},
    }
    tl.save_data(orders.withColumn("month", month("o_orderdate")), catalog, "orders_by_month")
    return catalog


@query(
    "SELECT DISTINCT e.entry, 'month=' || strftime(l_shipdate, '%Y-%m') AS filename "
    "FROM lineitem, (VALUES ('orders_by_month'), ('gone')) AS e(entry) "
    "WHERE e.entry = 'gone' OR strftime(l_shipdate, '%Y-%m') NOT IN (SELECT "
    "strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) <> 2)"
)
def missing_inputs(spark, sf_dir):
    catalog = monthly_orders(spark, sf_dir)
    lineitem = load(spark, sf_dir, "lineitem", columns=["l_shipdate"])
    # Distinct before the join: the aggregate of the few months is what meets the inventory.
    months = lineitem.groupBy(month("l_shipdate").alias("month")).agg(F.count("*").alias("rows"))
    shipped = months.filter("rows > 0").select(
        F.explode(F.array(*map(F.lit, catalog))).alias("entry"),
        F.concat(F.lit("month="), "month").alias("filename"),
    )
    return tl.missing_inputs(shipped, tl.file_inventory(spark, catalog))


@query(
    "SELECT 'month=' || strftime(o_orderdate, '%Y-%m') AS folder, count(*) > 0 AS has_files "
    "FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) <> 2 GROUP BY 1"
)
def file_inventory(spark, sf_dir):
    catalog = monthly_orders(spark, sf_dir)
    # Spark's own marker files lie beside the folders.
    files = tl.file_inventory(spark, catalog).filter("name LIKE 'month=%/%'")
    return files.groupBy(F.substring_index("name", "/", 1).alias("folder")).agg(
        (F.sum("length") > 0).alias("has_files")
    )


@query(
    "SELECT 'month=' || strftime(o_orderdate, '%Y-%m') || '/part=' || (o_orderkey % 3) AS folder, "
    "CAST(ceil(count(*) / 40.0) AS BIGINT) AS files FROM orders GROUP BY 1"
)
def inventory_names_and_counts(spark, sf_dir):
    """Two levels of folders, each with as many files of 40 rows as its rows need."""
    orders = load(spark, sf_dir, "orders").withColumn("month", month("o_orderdate"))
    # A folder is one task's, and its cost are files, not bytes: a few folders a task, which no size of partitions joins.
    tasks = 16 * spark.sparkContext.defaultParallelism
    orders = orders.withColumn("part", F.col("o_orderkey") % 3).repartition(tasks, "month", "part")
    save = {"partitionBy": ["month", "part"], "maxRecordsPerFile": 40, "checksums": False}
    catalog = {"orders": {"file_path": shared_folder(spark), "file_format": "parquet", "save": save}}
    tl.save_data(orders, catalog, "orders")
    files = tl.file_inventory(spark, catalog).filter("length > 0 AND name LIKE '%.parquet' AND name NOT LIKE '%/.%'")
    return files.groupBy(F.substring_index("name", "/", 2).alias("folder")).agg(F.count("*").alias("files"))


@query(
    "SELECT 'orders_by_month' AS entry, count(*) > 0 AS there, 'true' AS needs_filename FROM orders "
    "UNION ALL SELECT 'lineitem', count(*) > 0, 'false' FROM lineitem UNION ALL SELECT 'gone', false, NULL"
)
def entries_needing_filename(spark, sf_dir):
    catalog = monthly_orders(spark, sf_dir)
    catalog["lineitem"] = test_catalog(sf_dir)["lineitem"]
    summary = tl.entry_summary(spark, catalog)
    needs = F.col("needs_filename").cast("string").alias("needs_filename")
    return summary.select("entry", F.col("exists").alias("there"), needs)


# Names and types


@query(
    "SELECT p_partkey AS part_key, p_name AS name_of_part, p_brand AS brandorlabel, "
    "p_size AS size_num, p_retailprice AS pct_price_usd FROM part"
)
def clean_names(spark, sf_dir):
    dirty = {
        "p_partkey": " Part Key ",
        "p_name": "Name - of: Part",
        "p_brand": "Brand/Label",
        "p_size": "Size #",
        "p_retailprice": "% Price (USD.)",
    }
    return load(spark, sf_dir, "part").select(*[F.col(c).alias(n) for c, n in dirty.items()]).transform(
        tl.clean_column_names
    )


def clean_sql(text: str) -> str:
    """The name rule as nested DuckDB replacements."""
    sql = f"trim(lower({text}))"
    for pattern, new in (
        ("[ :_\\-]+", "_"), ("#", "num"), ("%", "pct"), ("[&+]+", "and"), ("[|,/;]+", "or"), ("[().]+", "")
    ):
        sql = f"regexp_replace({sql}, '{pattern}', '{new}', 'g')"
    return sql


@query(
    f"SELECT o_orderkey AS id, {clean_sql('o_orderpriority')} AS label FROM orders "
    f"UNION ALL SELECT conv_id * 1000 + turn, {clean_sql('role')} FROM conversations "
    f"UNION ALL SELECT s_suppkey, {clean_sql('s_name')} FROM supplier"
)
def clean_label_values(spark, sf_dir):
    parts = [
        load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"),
        load(spark, sf_dir, "conversations").select(F.col("conv_id") * 1000 + F.col("turn"), "role"),
        load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"),
    ]
    return (
        parts[0].unionAll(parts[1]).unionAll(parts[2])
        .select("id", tl.clean_label("o_orderpriority").alias("label"))
    )


@query(f"SELECT doc_id, md5({clean_sql('text')}) AS label_md5 FROM documents")
def clean_label_texts(spark, sf_dir):
    documents = load(spark, sf_dir, "documents", columns=["doc_id", "text"])
    return documents.select("doc_id", F.md5(tl.clean_label("text")).alias("label_md5"))


@query(
    "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer"
)
def rename_present(spark, sf_dir):
    customer = load(spark, sf_dir, "customer")
    return tl.rename_cols(
        customer, {"c_custkey": "id", "c_acctbal": "balance", "absent": "x", "C_NAME": "y"}
    )


@query("SELECT * EXCLUDE (l_partkey, l_suppkey), l_partkey AS l_suppkey, l_suppkey AS l_partkey FROM lineitem")
def rename_swap(spark, sf_dir):
    swap = {"l_partkey": "l_suppkey", "l_suppkey": "l_partkey"}
    return tl.rename_cols(load(spark, sf_dir, "lineitem"), swap)


def with_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as decimals: plain, in an array and in a record."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        price.alias("price"),
        F.array(price, price).alias("prices"),
        F.struct(price.alias("value")).alias("record"),
    )


@query(
    "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS price, "
    "o_totalprice::DECIMAL(18,2)::DOUBLE AS listed, o_totalprice::DECIMAL(18,2)::DOUBLE AS held "
    "FROM orders"
)
def decimals_to_double(spark, sf_dir):
    return tl.clean_dtypes(with_decimals(spark, sf_dir)).select(
        "o_orderkey", "price", F.col("prices")[1].alias("listed"), F.col("record.value").alias("held")
    )


@query(
    "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::FLOAT::DOUBLE AS price, "
    "o_totalprice::DECIMAL(18,2)::FLOAT::DOUBLE AS listed, o_totalprice::DECIMAL(18,2)::FLOAT::DOUBLE AS held FROM orders"
)
def decimals_to_float(spark, sf_dir):
    floats = tl.to_pandas_safe(with_decimals(spark, sf_dir))
    # Compared as doubles, which hold every float exactly.
    return floats.select(
        "o_orderkey",
        F.col("price").cast("double").alias("price"),
        F.col("prices")[1].cast("double").alias("listed"),
        F.col("record.value").cast("double").alias("held"),
    )


# Keys


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0 AND l_tax = 0")
def all_zero_rows(spark, sf_dir):
    lineitem = load(spark, sf_dir, "lineitem")
    zero = tl.all_zero(lineitem, ["l_discount", "l_tax"])
    return lineitem.filter(zero).select("l_orderkey", "l_linenumber")


def hash_sql(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 15))::BIGINT"


LINE_KEY = "l_linenumber || 'l_linenumber' || l_orderkey || 'l_orderkey' || l_partkey || 'l_partkey'"


@query(f"SELECT l_orderkey, l_linenumber, {hash_sql(LINE_KEY)} AS line_hash FROM lineitem")
def hashed_column(spark, sf_dir):
    lineitem = load(spark, sf_dir, "lineitem")
    hashed = tl.get_hashed_column(lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], "line_hash")
    return hashed.select("l_orderkey", "l_linenumber", "line_hash")


ORDER_KEY = (
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'o_orderdate' || o_orderstatus || 'o_orderstatus' "
    "|| o_totalprice || 'o_totalprice'"
)


@query(f"SELECT o_orderkey, {hash_sql(ORDER_KEY)} AS order_hash FROM orders")
def hashed_column_types(spark, sf_dir):
    """A timestamp, a text and a floating-point number."""
    orders = load(spark, sf_dir, "orders")
    columns = ["o_totalprice", "o_orderstatus", "o_orderdate"]
    hashed = tl.get_hashed_column(orders, columns, "order_hash")
    return hashed.select("o_orderkey", "order_hash")


SCALED = "(l_extendedprice * l_extendedprice * l_quantity / 7 - l_quantity)"


@query(
    f"SELECT l_orderkey, l_linenumber, {hash_sql(f'{SCALED} || {chr(39)}scaled{chr(39)}')} AS hash "
    "FROM lineitem"
)
def hashed_column_large_numbers(spark, sf_dir):
    """Doubles beyond 1e7, which Spark itself prints with an exponent."""
    lineitem = load(spark, sf_dir, "lineitem")
    scaled = lineitem.withColumn("scaled", F.expr(SCALED))
    hashed = tl.get_hashed_column(scaled, ["scaled"], "hash")
    return hashed.select("l_orderkey", "l_linenumber", "hash")


RATES = "l_discount || 'l_discount' || l_tax || 'l_tax'"


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 "
    f"ELSE {hash_sql(RATES)} END AS rate_hash FROM lineitem"
)
def hashed_column_zero_override(spark, sf_dir):
    lineitem = load(spark, sf_dir, "lineitem")
    hashed = tl.get_hashed_column(lineitem, ["l_tax", "l_discount"], "rate_hash", zero_override=True)
    return hashed.select("l_orderkey", "l_linenumber", "rate_hash")


FLAGS = "l_linestatus || 'l_linestatus' || l_quantity || 'l_quantity'"
FLAGS_AS_TEXT = (
    "coalesce(l_linestatus, 'None') || 'l_linestatus' || coalesce(l_quantity::VARCHAR, 'nan') "
    "|| 'l_quantity'"
)


@query(
    f"SELECT l_orderkey, l_linenumber, ({hash_sql(FLAGS)})::VARCHAR AS null_hash, "
    f"{hash_sql(FLAGS_AS_TEXT)} AS text_hash FROM (SELECT l_orderkey, l_linenumber, "
    "nullif(l_linestatus, 'O') AS l_linestatus, nullif(l_quantity, 1) AS l_quantity FROM lineitem)"
)
def hashed_column_nulls(spark, sf_dir):
    lineitem = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"),
        F.nullif("l_quantity", F.lit(1.0)).alias("l_quantity"),
    )
    columns = ["l_linestatus", "l_quantity"]
    hashed = lineitem.transform(tl.get_hashed_column, columns, "null_hash").transform(
        tl.get_hashed_column, columns, "text_hash", nulls="text"
    )
    # As text, so that no reader of the result turns a column with nulls into floating point.
    return hashed.select(
        "l_orderkey", "l_linenumber", F.col("null_hash").cast("string").alias("null_hash"), "text_hash"
    )


@query(
    "SELECT l_orderkey AS order_key, l_linenumber AS line_num, l_extendedprice::DECIMAL(18,2)::DOUBLE AS price_usd, "
    "* EXCLUDE (l_orderkey, l_linenumber, l_extendedprice), "
    + hash_sql("l_partkey || 'l_partkey' || l_linenumber || 'line_num' || l_orderkey || 'order_key'")
    + " AS line_hash FROM lineitem"
)
def keyed_lineitem(spark, sf_dir):
    names = {"l_orderkey": "Order Key", "l_linenumber": "Line-#", "l_extendedprice": "Price (USD)"}
    lineitem = load(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    dirty = lineitem.withColumn("l_extendedprice", price).withColumnsRenamed(names)
    return tl.keyed_table(dirty, ["order_key", "line_num", "l_partkey"], "line_hash", True)


# Fingerprints


def fingerprint_sql(json_text: str) -> str:
    return f"translate(to_base64(unhex(sha256({json_text}))), '+/', '-_')"


CUSTOMER_JSON = (
    "'[[\"c_acctbal\",' || c_acctbal || '],[\"c_custkey\",' || c_custkey || '],[\"c_mktsegment\",\"' "
    "|| c_mktsegment || '\"],[\"c_name\",\"' || c_name || '\"],[\"c_nationkey\",' || c_nationkey || ']]'"
)


@query(f"SELECT c_custkey, {fingerprint_sql(CUSTOMER_JSON)} AS hash_str FROM customer")
def row_fingerprint(spark, sf_dir):
    return tl.with_hash_str(load(spark, sf_dir, "customer")).select("c_custkey", "hash_str")


EVENT_TIME = (
    "CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"
)
EVENT_JSON = (
    "'[[\"event_type\",\"' || event_type || '\"],[\"props\",\"' || replace(props, '\"', '\\\"') "
    f"|| '\"],[\"ts\",\"' || {EVENT_TIME} || '\"],[\"user_id\",' || user_id || '],[\"value\",' "
    "|| value || ']]'"
)


@query(f"SELECT event_id, {fingerprint_sql(EVENT_JSON)} AS hash_str FROM events")
def row_fingerprint_skip(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return tl.with_hash_str(events, skip=["event_id"]).select("event_id", "hash_str")


ESCAPED_TEXT = (
    "array_to_string(list_transform(string_split(text, ''), lambda c: CASE "
    "WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN unicode(c) = 10 THEN '\\n' "
    "WHEN unicode(c) = 13 THEN '\\r' WHEN unicode(c) = 9 THEN '\\t' WHEN unicode(c) = 8 THEN '\\b' "
    "WHEN unicode(c) = 12 THEN '\\f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c "
    "WHEN unicode(c) < 65536 THEN format('\\u{:04x}', unicode(c)) "
    "ELSE format('\\u{:04x}\\u{:04x}', 55296 + ((unicode(c) - 65536) >> 10), "
    "56320 + ((unicode(c) - 65536) & 1023)) END), '')"
)
DOCUMENT_JSON = (
    "'[[\"doc_id\",' || doc_id || '],[\"lang\",\"' || lang || '\"],[\"n_chars\",' || n_chars || "
    f"'],[\"source\",\"' || source || '\"],[\"text\",\"' || {ESCAPED_TEXT} || '\"]]'"
)


@query(f"SELECT doc_id, {fingerprint_sql(DOCUMENT_JSON)} AS hash_str FROM documents")
def row_fingerprint_documents(spark, sf_dir):
    """Whole texts in four languages, escaped to ASCII."""
    return tl.with_hash_str(load(spark, sf_dir, "documents")).select("doc_id", "hash_str")


@query(
    "SELECT vec_id, " + fingerprint_sql(
        "'[' || array_to_string(list_transform(list_sort(embedding), lambda x: x::VARCHAR), ',') || ']'"
    ) + " AS hash_str FROM embeddings"
)
def value_fingerprint(spark, sf_dir):
    """The fingerprint of a list does not depend on its order."""
    embeddings = load(spark, sf_dir, "embeddings")
    dtype = embeddings.schema["embedding"].dataType
    shuffled = F.reverse("embedding")
    return embeddings.select("vec_id", tl.get_hash_str(shuffled, dtype).alias("hash_str"))


# A list of two lists: the one that starts with -1 comes first.
NESTED_JSON = (
    "'[[\"order\",[[\"date\",\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"],[\"keys\",[[-1,' "
    "|| o_custkey || '],[' || least(o_orderkey, o_custkey) || ',' || greatest(o_orderkey, o_custkey) "
    "|| ']]],[\"none\",null]]],[\"urgent\",' || (o_orderpriority = '1-URGENT') || ']]'"
)


@query(f"SELECT o_orderkey, {fingerprint_sql(NESTED_JSON)} AS hash_str FROM orders")
def row_fingerprint_nested(spark, sf_dir):
    keys = F.array(F.array("o_custkey", "o_orderkey"), F.array(F.col("o_custkey"), F.lit(-1).cast("bigint")))
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.struct(
            F.lit(None).cast("string").alias("none"),
            keys.alias("keys"),
            F.to_date("o_orderdate").alias("date"),
            F.lit(1).alias("o_orderkey"),
        ).alias("order"),
    )
    return tl.with_hash_str(orders, skip=["o_orderkey"]).select("o_orderkey", "hash_str")


# The checking engine has no SHA-512: the tests hold this one against Python's.
@query()
def row_fingerprint_sha512(spark, sf_dir):
    customer = load(spark, sf_dir, "customer")
    return tl.with_hash_str(customer, sha512=True).select("c_custkey", "hash_str")


VARIANT_JSON = (
    "'[[\"a\",' || event_id || '],[\"b\",[true,' || user_id || ',\"' || event_type || '\",[[\"k\",' || (props ->> 'k') || ']],null]]]'"
)


@query(f"SELECT event_id, {fingerprint_sql(VARIANT_JSON)} AS hash_str FROM events")
def value_fingerprint_variant(spark, sf_dir):
    """A list of a record, a null, a text, a number and a truth value, whose order does not count."""
    events = load(spark, sf_dir, "events")
    text = F.concat(
        F.lit('{"b": ['), "props", F.lit(', null, "'), "event_type", F.lit('", '), F.col("user_id").cast("string"),
        F.lit(', true], "a": '), F.col("event_id").cast("string"), F.lit("}"),
    )
    events = events.withColumn("value", F.parse_json(text))
    return events.select("event_id", tl.get_hash_str(F.col("value"), events.schema["value"].dataType).alias("hash_str"))


# Values


LEVEL = "'(' || p_size || ') ' || p_type || ' (b) ' || p_brand"


def level() -> Column:
    return F.concat(
        F.lit("("), "p_size", F.lit(") "), "p_type", F.lit(" (b) "), "p_brand"
    )


@query(f"SELECT p_partkey, regexp_replace({LEVEL}, '\\([^)]*\\) ', '', 'g') AS level FROM part")
def level_name(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", tl.clean_level(level()).alias("level"))


@query(
    "SELECT p_partkey, try_cast(nullif(regexp_extract(regexp_extract("
    f"{LEVEL}, '\\([^)]*\\) '), '[0-9]+'), '') AS BIGINT) AS number, "
    "try_cast(nullif(regexp_extract(regexp_extract(p_name, '\\([^)]*\\) '), '[0-9]+'), '') AS BIGINT)"
    "::VARCHAR AS no_number FROM part"
)
def level_number(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        tl.get_num_value(level()).alias("number"),
        tl.get_num_value("p_name").cast("string").alias("no_number"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT::VARCHAR AS price, "
    "trunc(-l_extendedprice)::BIGINT::VARCHAR AS refund, l_partkey::VARCHAR AS part, "
    "l_extendedprice::VARCHAR AS price_text, l_partkey::VARCHAR AS padded, "
    "l_returnflag AS flag, (l_returnflag = 'R')::INT::VARCHAR AS returned, "
    "trunc(l_extendedprice)::BIGINT::VARCHAR AS exact, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped, "
    "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '.000007' AS fraction FROM lineitem"
)
def integer_text(spark, sf_dir):
    lineitem = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price"),
        (-F.col("l_extendedprice")).alias("refund"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").cast("string").alias("price_text"),
        F.concat(F.lit(" +00"), "l_partkey", F.lit(" ")).alias("padded"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("exact"),
        F.col("l_shipdate").alias("shipped"),
        (F.col("l_shipdate") + F.expr("INTERVAL '0.000007' SECOND")).alias("fraction"),
    )
    keys = ["l_orderkey", "l_linenumber"]
    return lineitem.select(
        *keys,
        *[
            tl.convert_value(F.col(f.name), f.dataType).alias(f.name)
            for f in lineitem.schema
            if f.name not in keys
        ],
    )


URL = "^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://([^/?#]*))?/*([^?]*(?:\\?.+)?)\\??$"


@query(
    f"SELECT page_id, regexp_extract(url, '{URL}', 1, 's') AS bucket, "
    f"regexp_extract(url, '{URL}', 2, 's') AS key, url AS whole FROM pages"
)
def split_url(spark, sf_dir):
    pages = load(spark, sf_dir, "pages", columns=["page_id", "url"])
    return pages.select("page_id", tl.split_url("url").alias("s")).select(
        "page_id", "s.bucket", "s.key", F.col("s.url").alias("whole")
    )


@tl.py_or_udf(returnType=T.StringType(), null_safe=True)
def short_name(name, mark="#"):
    return name.split(mark)[-1].lstrip("0") or "0"


@query(
    "SELECT c_custkey, coalesce(nullif(ltrim(split_part(c_name, '#', 2), '0'), ''), '0') AS short, "
    "'7' AS plain FROM customer"
)
def udf_or_plain(spark, sf_dir):
    customer = load(spark, sf_dir, "customer", columns=["c_custkey", "c_name"])
    plain = F.lit(short_name("Customer#007")).alias("plain")
    return customer.select("c_custkey", short_name(F.col("c_name")).alias("short"), plain)
