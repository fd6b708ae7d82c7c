"""Queries that write the source tables in another form, read them back, or work on them in steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import aggregates as A
from shelfwise.plans.registry import query
from shelfwise.sources import files as S
from shelfwise.sources.tables import item_master, keyword_rows, posts, sales_lines, sql
from shelfwise.streaming import incremental as I

ITEM_SCHEMA = "item_code string, item_name string, cat_l string, cat_m string, cat_s string"


@query("SELECT * FROM nation")
def s1_read_parquet_table(s, d):
    return S.read_parquet_table(s, f"{d}/nation.parquet")


@query(sql("items", "SELECT * FROM items"))
def s2_read_csv_typed(s, d):
    out = S.scratch_dir(s)
    S.write_csv(item_master(s, d), out)
    return S.read_csv_typed(s, out, ITEM_SCHEMA)


SALES_SCHEMA = "`판매일자` string, `상품코드` string, `수량` string, `금액` string"
SALES_NAMES = {"판매일자": "sale_date", "상품코드": "item_code", "수량": "qty", "금액": "amount"}


def _raw_sales(s, d):
    """Sales as the raw files have them: dates as digits, thousands separators, a bad number in every returned line."""
    out = S.scratch_dir(s)
    lines = sales_lines(s, d)
    qty = F.when(F.col("qty") < 0, "?").otherwise(F.col("qty").cast("string"))
    S.write_csv(lines.select(F.date_format("sale_date", "yyyyMMdd").alias("판매일자"), F.col("item_code").alias("상품코드"), qty.alias("수량"), F.format_number("amount", 0).alias("금액")), out)
    return out


RAW = sql("sales", "SELECT sale_date, item_code, CASE WHEN qty < 0 THEN 0 ELSE qty END AS qty, amount FROM sales")


@query(RAW)
def s3_read_sales_csv(s, d):
    return S.read_sales_csv(s, _raw_sales(s, d), SALES_SCHEMA, SALES_NAMES, ["qty", "amount"], "sale_date")


@query(RAW)
def s4_ingest_csv_to_parquet(s, d):
    out = S.scratch_dir(s)
    S.ingest_csv_to_parquet(s, _raw_sales(s, d), SALES_SCHEMA, SALES_NAMES, ["qty", "amount"], "sale_date", out)
    return s.read.parquet(out)


@query(sql("items", "SELECT item_code, item_name, CASE WHEN CAST(item_code AS INTEGER) % 2 = 0 THEN cat_l END AS cat_l FROM items"))
def s5_read_csv_lenient(s, d):
    """Every second line lacks its last field, the others have one too many."""
    out = S.scratch_dir(s)
    even = F.col("item_code").cast("int") % 2 == 0
    line = F.concat_ws(",", "item_code", "item_name", F.when(even, F.col("cat_l")), F.when(even, F.lit("extra")))
    # one column with another separator, so that the lines and their header are written as they are
    item_master(s, d).select(line.alias("item_code,item_name,cat_l")).write.option("header", True).option("sep", "\t").csv(out)
    return S.read_csv_lenient(s, out, "item_code string, item_name string, cat_l string")


@query(sql("items", "SELECT CAST(item_code AS BIGINT) AS item_code, item_name || ' 컵라면' AS item_name, CASE WHEN cat_m <> 'Brand#1' THEN cat_m END AS cat_m FROM items"))
def s6_read_csv_encoded(s, d):
    """Item names in CP949, which Spark's reader doesn't take."""
    out = S.scratch_dir(s)
    name = S.recoded(F.concat("item_name", F.lit(" 컵라면")), "cp949", "iso-8859-1")
    brand = F.when(F.col("cat_m") != "Brand#1", F.col("cat_m"))
    item_master(s, d).select("item_code", name.alias("item_name"), brand.alias("cat_m")).write.option("header", True).option("encoding", "ISO-8859-1").csv(out)
    return S.read_csv_encoded(s, out, "item_code long, item_name string, cat_m string", "CP949")


@query(sql("items", "SELECT * FROM items"))
def s7_convert_new_files(s, d):
    """Two calls over a growing folder: the second reads the new files alone."""
    out = S.scratch_dir(s)
    items = item_master(s, d)
    items.filter("cat_l = 'PROMO'").write.mode("append").option("header", True).csv(out)
    first = I.convert_new_files(s, out, s.createDataFrame([], "file_path string"), ITEM_SCHEMA)
    S.write_table(first, f"{out}-done")
    items.filter("cat_l <> 'PROMO'").write.mode("append").option("header", True).csv(out)
    done = s.read.parquet(f"{out}-done")
    return done.unionByName(I.convert_new_files(s, out, done, ITEM_SCHEMA)).drop("file_path")


@query(sql("sales", "SELECT strftime(sale_date, '%Y-%m') AS month, count(*) AS n, count(DISTINCT trade_no) AS n_trades FROM sales GROUP BY 1"))
def s8_read_monthly_folders(s, d):
    out = S.scratch_dir(s)
    lines = sales_lines(s, d).select("trade_no", "item_code", F.date_format("sale_date", "yyyy-MM").alias("m"))
    lines.repartition("m").write.partitionBy("m").option("header", True).csv(out)
    return S.read_monthly_folders(s, out, "trade_no string, item_code string").groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("trade_no").alias("n_trades"))


@query("SELECT c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, 'none' FROM supplier")
def s9_union_sources(s, d):
    a = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"))
    return S.union_sources([a, b], {"segment": "none"})


@query(sql("items", "SELECT * FROM items"))
def s10_write_table(s, d):
    out = S.scratch_dir(s)
    S.write_table(item_master(s, d), out)
    return s.read.parquet(out)


@query(sql("items", "SELECT * FROM items"))
def s11_write_csv(s, d):
    out = S.scratch_dir(s)
    S.write_csv(item_master(s, d), out)
    return s.read.schema(ITEM_SCHEMA).option("header", True).csv(out)


@query(sql("items", "SELECT cat_l, item_code FROM items"))
def s12_write_json_table(s, d):
    out = S.scratch_dir(s)
    S.write_json_table(A.listed_in_chunks(item_master(s, d), "cat_l", "item_code", 1000), out)
    return s.read.schema("cat_l string, chunk long, values array<string>").json(out).select("cat_l", F.explode("values").alias("item_code"))


@query(sql("sales items", "SELECT trade_no, item_code FROM sales WHERE item_code IN (SELECT item_code FROM items WHERE cat_m = 'Brand#7')"))
def s13_read_target_list(s, d):
    out = S.scratch_dir(s)
    S.write_csv(item_master(s, d).filter("cat_m = 'Brand#7'").select("item_code"), out)
    return S.in_target_list(sales_lines(s, d), S.read_csv_typed(s, out, "item_code string"), "item_code").select("trade_no", "item_code")


@query("SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, name, type FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', 'int'), ('s_acctbal', 'double')) t(name, type)")
def s14_source_schema_report(s, d):
    return S.source_schema_report(s.read.parquet(f"{d}/supplier.parquet"))


@query(sql("items", "SELECT * FROM items"))
def t1_ingest_incremental(s, d):
    src, dst = S.scratch_dir(s), S.scratch_dir(s)
    items = item_master(s, d)
    for part in ("cat_l = 'PROMO'", "cat_l <> 'PROMO'"):
        items.filter(part).write.mode("append").option("header", True).csv(src)
        I.ingest_incremental(s, src, dst, f"{dst}-checkpoint", ITEM_SCHEMA)
    return s.read.parquet(dst)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t1_windowed_counts(s, d):
    """Events as a stream: hourly counts with a watermark, complete when the input ends."""
    src, out = f"{d}/events.parquet", S.scratch_dir(s)
    schema = s.read.parquet(src).schema
    # a file source takes folders; the pattern names the table
    stream = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = I.windowed_counts(stream, "ts", "1 hour", "2 days", ["event_type"])
    sink = lambda df, _: df.write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return s.read.parquet(out)


def lower_first(batches):
    """A stand-in for the caller's enrichment: the first three characters in lower case, each by itself and as one, as in SQL."""
    lower = lambda t: "".join(c.lower()[0] for c in t[:3])
    for b in batches:
        yield b.assign(result=b["text"].map(lower, na_action="ignore"))[["ord", "result"]]


@query(sql("krows", "SELECT ord, lower(substr(body, 1, 3)) AS result FROM krows"))
def t2_enrich_pending(s, d):
    """Two runs: the second finds half of the rows done."""
    store = S.scratch_dir(s)
    rows = keyword_rows(s, d).select("ord", F.col("body").alias("text"))
    I.enrich_pending(rows.filter("ord % 2 = 0"), store, "ord", 1, lower_first)
    return I.enrich_pending(rows, store, "ord", 2, lower_first).select("ord", "result")


KW = "len(list_filter(string_split({}, ','), lambda k: trim(k) <> ''))"
WEAK = f"({KW.format('review_keywords')} <= 3 AND length(body) >= 1000)"


@query(sql("krows", f"SELECT ord, review_keywords AS old_review_keywords, CASE WHEN {WEAK} THEN lower(substr(body, 1, 3)) ELSE review_keywords END AS review_keywords FROM krows"))
def t3_reextract(s, d):
    rows = keyword_rows(s, d).withColumn("text", F.col("body"))
    weak = (T.keyword_count(F.col("review_keywords")) <= 3) & (F.length("body") >= 1000)
    return I.reextract(rows, weak, S.scratch_dir(s), "ord", 1, lower_first, "review_keywords", ["text"]).select("ord", "old_review_keywords", "review_keywords")


@query(sql("posts", "SELECT ord, cat_m AS brand, CASE WHEN coalesce(json_array_length(nullif(regexp_extract(reply, '[{].*[}]', 0, 's'), ''), '$.metadata') >= 2, false) THEN lower(substr(body, 1, 3)) ELSE reply END AS reply FROM posts"))
def t4_rerun_multi_product(s, d):
    """Replies with several products are redone, brands as a column."""
    rows = posts(s, d).withColumn("text", F.col("body"))
    redone = I.reextract(rows, T.is_multi_product(F.col("reply")), S.scratch_dir(s), "ord", 1, lower_first, "reply", ["text"])
    return redone.select("ord", F.col("cat_m").alias("brand"), "reply")
