"""The canonical retail tables, read from the star-schema Parquet files.

``read_*`` functions return DataFrames in the canonical columns; ``CTES`` holds the same
mappings as DuckDB SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import once


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _with_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines joined to their orders. A task holds its share of the orders, whose keys are unique and fewer, and sorts no lines."""
    return lines.join(orders.hint("shuffle_hash"), lines["l_orderkey"] == orders["o_orderkey"])


def sales_lines(spark: SparkSession, d: str) -> DataFrame:
    """sale_date, ship_date, sale_time, store, pos_no, trade_no, item_code, qty, amount; returns are negative."""
    lines, orders = _table(spark, d, "lineitem"), _table(spark, d, "orders")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return _with_orders(lines, orders).select(
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        (F.col("l_orderkey") % 24 * 10000 + F.col("l_orderkey") % 60 * 100).cast("string").alias("sale_time"),
        (F.col("o_custkey") % 50).cast("string").alias("store"),
        (F.col("o_custkey") % 3).cast("string").alias("pos_no"),
        F.col("l_orderkey").cast("string").alias("trade_no"),
        F.col("l_partkey").cast("string").alias("item_code"),
        (sign * F.col("l_quantity")).cast("long").alias("qty"),
        (sign * F.round("l_extendedprice")).cast("long").alias("amount"),
    )


def item_master(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_code"), F.col("p_name").alias("item_name"), F.col("p_type").alias("cat_l"), F.col("p_brand").alias("cat_m"), F.col("p_size").cast("string").alias("cat_s"))


def promotions(spark: SparkSession, d: str) -> DataFrame:
    """A promotion row per order line: its ship date begins it, its quantity is its length in days."""
    lines, orders, part = (_table(spark, d, t) for t in ("lineitem", "orders", "part"))
    joined = _with_orders(lines, orders).join(part, lines["l_partkey"] == part["p_partkey"])
    start = F.col("l_shipdate").cast("date")
    end = F.when(F.col("l_linenumber") == 7, F.make_date(F.lit(9999), F.lit(12), F.lit(31))).otherwise(F.date_add(start, F.col("l_quantity").cast("int")))
    form = F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("form : "), F.col("l_returnflag"), F.lit(" + "), F.col("l_returnflag")))
    return joined.select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("event_code"),
        F.concat(F.month("l_shipdate"), F.lit("월 "), "p_name", F.lit(" ("), "l_linenumber", F.lit(")")).alias("event_name"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" : "), F.substring("o_orderpriority", 3, 20)).alias("event_kind"),
        form.alias("event_form"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.when(F.col("l_tax") > 0, F.col("l_linestatus")).alias("basis"),
        F.round(F.col("l_extendedprice") * F.col("l_discount")).cast("long").alias("cost"),
        F.round("p_retailprice").cast("long").alias("event_price"),
        F.when((F.col("l_discount") > 0) & (F.col("o_orderpriority").substr(1, 1) != "1"), F.round(F.col("p_retailprice") * (1 - F.col("l_discount")), 4)).alias("discount_price"),
        F.col("l_partkey").cast("string").alias("item_code"),
        F.col("p_name").alias("item_name"),
        F.col("l_returnflag").alias("promo_type"),
    )


def app_events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.col("event_type").alias("event_name"),
        F.replace("props", F.lit('"'), F.lit('""')).alias("event_value"),
        F.concat(F.lit("media"), F.col("user_id") % 5).alias("media_source"),
        F.concat(F.lit("camp"), F.col("event_id") % 7).alias("campaign"),
        F.when(F.col("user_id") % 2 == 0, "android").otherwise("ios").alias("platform"),
        F.col("user_id").cast("string").alias("device_id"),
        F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "참").otherwise("false").alias("is_primary"),
    )


def item_map(spark: SparkSession, d: str) -> DataFrame:
    """Online item codes of all items; codes that events name and no item has stay unmatched."""
    part = _table(spark, d, "part")
    return part.select(F.col("p_partkey").cast("string").alias("pos_item_code"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("online_item_code"), F.col("p_type").alias("category_l"), F.col("p_brand").alias("category_m"), F.col("p_name").alias("item_name"), F.col("p_retailprice").cast("string").alias("price"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts made of documents, with a date, a query and a stored reply."""
    first = F.split(F.substring_index("text", " ", 5), " ")  # the first five words, without a split of the whole text
    word = lambda i: F.regexp_replace(F.get(first, F.lit(i)), "[^a-zA-Z]", "")
    lists = F.concat(F.lit('"flavor_and_category":["'), word(1), F.lit('","'), word(2), F.lit('"],"collab_and_brand":["'), F.col("source"), F.lit('"],"promotion_type":'), F.when(F.col("doc_id") % 3 == 0, F.lit('["1+1"]')).when(F.col("doc_id") % 3 == 1, F.lit('"sale"')).otherwise(F.lit("[]")), F.lit(',"tpo_context":["'), word(3), F.lit('"]'))
    product = F.concat(F.lit('{"name":"'), word(0), F.lit('","price":'), F.col("n_chars"), F.lit(',"capacity":"'), F.col("lang"), F.lit('"'))
    reply = F.when(F.col("doc_id") % 11 == 0, F.lit("no reply")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Result: {"metadata":['), product, F.lit("}],"), lists, F.lit("} end"))).otherwise(F.concat(F.lit('{"metadata":['), product, F.lit(","), lists, F.lit('},{"name":"'), word(4), F.lit('"}]}')))
    return _table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 9 != 0, F.col("doc_id").cast("string")).alias("post_id"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2300).cast("int")).alias("post_date"),
        F.concat(F.lit("세븐일레븐 "), "source", F.lit(")"), "lang").alias("query"),
        F.col("lang").alias("cat_m"),
        F.concat(F.lit("https://blog.example/p/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "/").otherwise("")).alias("url"),
        F.concat(F.lit("https://blog.example/p/"), F.col("doc_id") % 500).alias("link"),
        F.col("text").alias("body"),
        F.col("n_chars").alias("likes"),
        reply.alias("reply"),
    )


def keyword_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with comma lists of keywords: the first words of a document."""
    words_of = lambda text: F.filter(F.split(F.regexp_replace(text, "[^a-zA-Z ]", ""), " "), lambda w: F.length(w) > 0)
    # eleven words are asked for; a text whose head has more needn't be split whole (the head's last word may be cut)
    words = once(words_of(F.substring("text", 1, 500)), lambda head: F.when(F.size(head) > 11, head).otherwise(words_of(F.col("text"))))
    none = F.lit("해당 없음")
    return _table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("세븐일레븐 "), "source", F.lit(")"), "lang").alias("query"),
        F.concat("source", F.lit(")"), "lang").alias("product_name"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 10 == 0, none).otherwise(F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 7).cast("int")), ", ")).alias("review_keywords"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("없음")).otherwise(F.array_join(F.slice(words, F.lit(8), (F.col("doc_id") % 5).cast("int")), ", ")).alias("hin_keywords"),
    )


PERIODS = [("VALENTINE", "1997-02-08", "1997-02-14"), ("CHILDRENS_DAY", "1997-04-29", "1997-05-05"), ("PARENTS_DAY", "1997-05-02", "1997-05-08"), ("CHRISTMAS", "1997-12-19", "1997-12-25")]


def periods(spark: SparkSession) -> DataFrame:
    """Named date ranges; two of them overlap."""
    return spark.createDataFrame(PERIODS, "period_key string, s string, e string").select("period_key", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))


_word = "regexp_replace(coalesce(string_split(text, ' ')[{}], ''), '[^a-zA-Z]', '', 'g')"
_words_null = "regexp_replace(string_split(text, ' ')[{}], '[^a-zA-Z]', '', 'g')"
_lists = f"""'"flavor_and_category":["' || {_words_null.format(2)} || '","' || {_words_null.format(3)} || '"],"collab_and_brand":["' || source || '"],"promotion_type":' || CASE doc_id % 3 WHEN 0 THEN '["1+1"]' WHEN 1 THEN '"sale"' ELSE '[]' END || ',"tpo_context":["' || {_words_null.format(4)} || '"]'"""
_product = f"""'{{"name":"' || {_words_null.format(1)} || '","price":' || n_chars || ',"capacity":"' || lang || '"'"""

CTES = {
    "sales": """sales AS (SELECT CAST(o_orderdate AS DATE) AS sale_date, CAST(l_shipdate AS DATE) AS ship_date,
        CAST(l_orderkey % 24 * 10000 + l_orderkey % 60 * 100 AS VARCHAR) AS sale_time, CAST(o_custkey % 50 AS VARCHAR) AS store,
        CAST(o_custkey % 3 AS VARCHAR) AS pos_no, CAST(l_orderkey AS VARCHAR) AS trade_no, CAST(l_partkey AS VARCHAR) AS item_code,
        CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity AS BIGINT) AS qty,
        CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice) AS BIGINT) AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "items": "items AS (SELECT CAST(p_partkey AS VARCHAR) AS item_code, p_name AS item_name, p_type AS cat_l, p_brand AS cat_m, CAST(p_size AS VARCHAR) AS cat_s FROM part)",
    "promo": """promo AS (SELECT l_orderkey || '-' || l_linenumber AS event_code, month(l_shipdate) || '월 ' || p_name || ' (' || l_linenumber || ')' AS event_name,
        substr(o_orderpriority, 1, 1) || ' : ' || substr(o_orderpriority, 3, 20) AS event_kind,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'form : ' || l_returnflag || ' + ' || l_returnflag END AS event_form, CAST(l_shipdate AS DATE) AS start_date,
        CASE WHEN l_linenumber = 7 THEN DATE '9999-12-31' ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS end_date,
        CASE WHEN l_tax > 0 THEN l_linestatus END AS basis, CAST(round(l_extendedprice * l_discount) AS BIGINT) AS cost, CAST(round(p_retailprice) AS BIGINT) AS event_price,
        CASE WHEN l_discount > 0 AND o_orderpriority NOT LIKE '1%' THEN round(p_retailprice * (1 - l_discount), 4) END AS discount_price,
        CAST(l_partkey AS VARCHAR) AS item_code, p_name AS item_name, l_returnflag AS promo_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "app": """app AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, event_type AS event_name, replace(props, '"', '""') AS event_value, 'media' || user_id % 5 AS media_source,
        'camp' || event_id % 7 AS campaign, CASE WHEN user_id % 2 = 0 THEN 'android' ELSE 'ios' END AS platform, CAST(user_id AS VARCHAR) AS device_id,
        CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '참' ELSE 'false' END AS is_primary FROM events)""",
    "imap": "imap AS (SELECT CAST(p_partkey AS VARCHAR) AS pos_item_code, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS online_item_code, p_type AS category_l, p_brand AS category_m, p_name AS item_name FROM part)",
    "posts": f"""posts AS (SELECT doc_id AS ord, CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id AS VARCHAR) END AS post_id, DATE '1995-01-02' + CAST(doc_id % 2300 AS INTEGER) AS post_date,
        '세븐일레븐 ' || source || ')' || lang AS query, lang AS cat_m, 'https://blog.example/p/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END AS url,
        'https://blog.example/p/' || doc_id % 500 AS link, text AS body, n_chars AS likes,
        CASE WHEN doc_id % 11 = 0 THEN 'no reply' WHEN doc_id % 2 = 0 THEN 'Result: {{"metadata":[' || {_product} || '}}],' || {_lists} || '}} end'
             ELSE '{{"metadata":[' || {_product} || ',' || {_lists} || '}},{{"name":"' || {_words_null.format(5)} || '"}}]}}' END AS reply FROM documents)""",
    "krows": """kw0 AS (SELECT *, list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' '), lambda w: length(w) > 0) AS ws FROM documents),
        krows AS (SELECT doc_id AS ord, '세븐일레븐 ' || source || ')' || lang AS query, source || ')' || lang AS product_name, text AS body,
        CASE WHEN doc_id % 10 = 0 THEN '해당 없음' ELSE coalesce(array_to_string(ws[1:CAST(doc_id % 7 AS INTEGER)], ', '), '') END AS review_keywords,
        CASE WHEN doc_id % 13 = 0 THEN '없음' ELSE coalesce(array_to_string(ws[8:7 + CAST(doc_id % 5 AS INTEGER)], ', '), '') END AS hin_keywords FROM kw0)""",
    "periods": "periods AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', DATE '{s}', DATE '{e}')" for k, s, e in PERIODS) + ") t(period_key, start_date, end_date))",
}


def sql(tables: str, body: str) -> str:
    """A query over the canonical tables named, each as a CTE."""
    parts = [CTES[t] for t in tables.split()]
    return f"WITH {', '.join(parts)}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
