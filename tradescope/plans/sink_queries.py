"""Queries of sinks: each writes a target in several steps and returns what it then holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradescope.registry import query
from tradescope.sinks import tables as K


def rows():
    return F.count(F.lit(1))


@query("snk01_dedup_append", "SELECT order_id, line_number, min(pk) AS pk FROM records GROUP BY 1, 2")
def snk01(t):
    x = t.stored("snk01", t("records").select("order_id", "line_number", "pk"))  # the joins behind it are made once
    hashed = {"op_hash": F.sha2(F.concat_ws("|", "order_id", "line_number"), 256)}
    path = t.scratch()
    for batch in (x.filter("order_id % 3 = 0"), x.filter("order_id % 2 = 0"), x, x):
        kept = K.append_new(batch, path, ("order_id", "line_number"), hashed)
    return kept.select("order_id", "line_number", "pk")


@query("snk02_search_documents", "SELECT pk, hs_code, date, concat_ws(' ', company_name, customs_office) AS full_text FROM records WHERE amount IS NOT NULL")
def snk02(t):
    path = t.scratch()
    found = t("records").filter("amount IS NOT NULL").select("pk", "hs_code", "date", F.concat_ws(" ", "company_name", "customs_office").alias("full_text"))
    found.write.json(path)
    return t.spark.read.schema(found.schema).json(path)


@query(
    "snk03_vector_upsert",
    """SELECT vec_id, sha256(vec_id || ':' || array_to_string([printf('%.6f', CAST(x AS DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END) FOR x IN embedding[1:10]], ',')) AS op_hash FROM embeddings""",
)
def snk03(t):
    x = t("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    doubled = x.filter("vec_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda v: v * 2))
    path = t.scratch()
    for seq, batch in enumerate((x, doubled)):
        kept = K.upsert(K.vector_rows(batch).withColumn("seq", F.lit(seq)), path, "vec_id", ["seq"])
    head = F.array_join(F.transform(F.slice("embedding", 1, 10), lambda v: F.format_string("%.6f", v)), ",")
    return kept.select("vec_id", F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), head), 256).alias("op_hash"))


@query(
    "snk04_graph_projection",
    """SELECT 'Company' AS type, edrpou AS id, arg_max(company_name, (date, pk)) AS name, count(*) AS relations FROM records GROUP BY 2
    UNION ALL SELECT 'Product', hs_code, NULL, count(DISTINCT country_code) FROM records GROUP BY 2 UNION ALL SELECT 'Country',
    country_code, NULL, 0 FROM records GROUP BY 2""",
)
def snk04(t):
    nodes, relations = K.graph_tables(t("records"))
    path = t.scratch()
    nodes.write.parquet(f"{path}/nodes")
    relations.write.partitionBy("type").parquet(f"{path}/relations")
    n, e = t.spark.read.parquet(f"{path}/nodes"), t.spark.read.parquet(f"{path}/relations")
    degree = e.groupBy(F.when(F.col("type") == "IMPORTS", "Company").otherwise("Product").alias("type"), F.col("src").alias("id")).agg(rows().alias("relations"))
    return n.join(degree, ["type", "id"], "left").select("type", "id", "name", F.coalesce("relations", F.lit(0)).alias("relations"))


@query(
    "snk05_counters",
    """SELECT 'count:hs:' || hs_code AS key, count(*)::DOUBLE AS value FROM records GROUP BY 1 UNION ALL SELECT 'count:country:'
    || country_code, count(*)::DOUBLE FROM records GROUP BY 1 UNION ALL SELECT 'amount:company:' || edrpou, round(sum(amount),
    3) FROM records GROUP BY 1""",
)
def snk05(t):
    path = t.scratch()
    kept = K.replace(K.counters(t("records")).withColumn("value", F.round("value", 3)), path)
    return kept.select("key", "value")


@query("snk06_alert_evidence", """SELECT pk, 'active' AS status, '{"company_id":' || company_id || ',"hs_code":"' || hs_code || '"}' AS evidence FROM records WHERE amount > 90000""")
def snk06(t):
    path = t.scratch()
    found = t("records").filter("amount > 90000").select("pk", F.lit("active").alias("status"), F.to_json(F.struct("company_id", "hs_code")).alias("evidence"))
    return K.append_new(found, path, "pk")


@query(
    "snk07_dead_letters",
    """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'vector' AS target_db, 'insert' AS operation, CASE WHEN o_totalprice < 2000
    THEN 'bad total' ELSE 'open priority' END AS error_message, 0 AS retry_count FROM orders WHERE o_totalprice < 2000 OR
    o_orderpriority LIKE '4%'""",
)
def snk07(t):
    error = F.when(F.col("o_totalprice") < 2000, "bad total").when(F.col("o_orderpriority").startswith("4"), "open priority")
    failed = K.dead_letters(t("orders"), "o_orderkey", error, "vector")
    return K.append_new(failed, t.scratch(), "record_id").select(failed.columns)


@query("snk08_log_days", "SELECT CAST(substr(line, 1, 10) AS DATE) AS log_date, count(*) AS n, min(line) AS first FROM logs GROUP BY 1")
def snk08(t):
    path = t.scratch()
    K.write_days(t("logs"), path, F.to_date(F.substring("line", 1, 10)))
    return t.spark.read.parquet(path).groupBy("log_date").agg(rows().alias("n"), F.min("line").alias("first"))


@query(
    "snk09_rebuild",
    """SELECT 'counters' AS target, count(DISTINCT hs_code) + count(DISTINCT country_code) + count(DISTINCT edrpou) AS n FROM records
    UNION ALL SELECT 'search', count(*) FROM records""",
)
def snk09(t):
    path, targets = t.scratch(), {"counters": K.counters, "search": lambda d: d.select("pk", F.concat_ws(" ", "company_name",
        "customs_office").alias("full_text"))}
    K.rebuild(t("records").filter("qty > 25"), targets, path)
    made = K.rebuild(t("records"), targets, path)
    return made["counters"].agg(rows().alias("n")).select(F.lit("counters").alias("target"),
        "n").union(made["search"].agg(rows().alias("n")).select(F.lit("search"), "n"))


@query(
    "snk10_upsert",
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey))
    AS status FROM orders GROUP BY 1""",
)
def snk10(t):
    x = t("orders").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    path = t.scratch()
    for part in (x.filter("order_id % 2 = 1"), x.filter("order_id % 2 = 0"), x.filter("order_id % 3 = 0")):
        kept = K.upsert(part, path, "o_custkey", ["at", "order_id"])
    return kept.select("o_custkey", "order_id", "status")


@query(
    "snk11_dataset_registry",
    """SELECT 'orders' AS name, 'parquet' AS type, count(*) AS row_count, 6::BIGINT AS columns, true AS same_in_any_order FROM orders""",
)
def snk11(t):
    x = t("orders")
    row, again = K.registry_row(x, "orders", "parquet"), K.registry_row(x.repartition(7, "o_custkey"), "orders", "parquet")
    both = row.join(again.select(F.col("checksum").alias("other")))
    fields = F.size(F.from_json("schema", "fields array<struct<name string>>")["fields"]).cast("long")
    return both.select("name", "type", "row_count", fields.alias("columns"), (F.col("checksum") == F.col("other")).alias("same_in_any_order"))
