"""Queries of sources: each writes a table out as files of the source's kind, and reads them back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tradescope.registry import query
from tradescope.sources import files, pages


def rows():
    return F.count(F.lit(1))


_LINES = StructType([StructField("order_id", LongType()), StructField("line", LongType()), StructField("qty", DoubleType()),
    StructField("amount", DoubleType())])


def order_lines(t):
    """Order lines as a table of CSV files; every line numbered 7 has words where a number belongs, and lines of one piece come twice."""
    x = t("lineitem")
    qty = F.when(F.col("l_linenumber") == 7, F.lit("many")).otherwise(F.col("l_quantity").cast("string"))
    line = F.concat_ws(",", F.col("l_orderkey"), F.col("l_linenumber"), qty, F.col("l_extendedprice"))
    path = t.scratch()
    twice = F.when(F.col("l_quantity") == 1, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    x.select(line.alias("value"), F.explode(twice).alias("n")).select("value").write.text(path)
    return files.read_delimited(t.spark, path, _LINES, header=False)


@query(
    "src01_delimited_scan",
    """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber = 7 AS bad, l_quantity >= 3 AS ok, CASE WHEN l_quantity
    = 1 THEN 2 ELSE 1 END AS times FROM lineitem),
    k AS (SELECT o, n, sum(times) AS total, sum(CASE WHEN bad THEN times ELSE 0 END) AS bad, sum(CASE WHEN NOT bad AND ok
    THEN times ELSE 0 END) AS good FROM x GROUP BY o, n)
    SELECT sum(total)::BIGINT AS total, sum(bad)::BIGINT AS bad, sum(total - bad - good)::BIGINT AS invalid, sum(greatest(good
    - 1, 0))::BIGINT AS repeats, count(*) FILTER (WHERE good > 0) AS valid FROM k""",
)
def src01(t):
    return files.scan_counts(order_lines(t), ["order_id", "line"], F.col("qty") >= 3)


@query("src02_preview_scan", "SELECT 5::BIGINT AS n, 4::BIGINT AS columns")
def src02(t):
    sample = files.preview(order_lines(t).drop(files.BAD))
    return sample.agg(rows().alias("n")).withColumn("columns", F.lit(len(sample.columns)).cast("long"))


@query(
    "src04_labelled_dataset",
    """SELECT CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS label, 2 * count(*) AS n, 2 * sum(length(text))::BIGINT AS chars
    FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1""",
)
def src04(t):
    kind = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    labelled = t("documents").join(t("labels").filter("toxic IS NOT NULL"), "doc_id").select("text", kind.alias("label"))
    path = t.scratch()
    labelled.write.json(f"{path}/set.jsonl")
    labelled.write.options(header=True, quote='"', escape='"').csv(f"{path}/set.csv")
    both = files.read_labelled(t.spark, f"{path}/set.jsonl").unionByName(files.read_labelled(t.spark, f"{path}/set.csv"))
    return both.groupBy("label").agg(rows().alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src05_log_files", "SELECT split_part(line, ' - ', 2) AS level, count(*) AS n, min(line) AS first FROM logs GROUP BY 1")
def src05(t):
    path = t.scratch()
    t("logs").select(F.explode(F.array("line", F.lit(""))).alias("value")).write.text(path)
    lines = files.read_log_lines(t.spark, path)
    return lines.groupBy(F.split("line", " - ")[1].alias("level")).agg(rows().alias("n"), F.min("line").alias("first"))


_TABLE = "'<table><tr><th>Firm name</th><th>HS code</th><th>Total amount</th></tr><tr><td>' || edrpou || '</td><td>' || hs_code || '</td><td>' || CAST(qty AS INTEGER) || '</td></tr></table>'"


def declared_pages(t):
    """Declarations as pages with a table of a header and a row."""
    cells = lambda tag, *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) for x in c], F.lit("</tr>"))
    head, row = cells("th", F.lit("Firm name"), F.lit("HS code"), F.lit("Total <b>amount</b>")), cells("td", F.col("edrpou"),
        F.col("hs_code"), F.col("qty").cast("int").cast("string"))
    return t("records").select(F.xxhash64("pk").alias("page_id"), F.concat(F.lit("<html><table>"), head, row, F.lit("</table><p>"),
        F.col("pk"), F.lit("</p>")).alias("html"))


@query("src06_html_tables", "SELECT 3 AS n_columns, 1 AS n_rows, 'Total amount' AS last_header, hs_code AS code, count(*) AS n FROM records GROUP BY 4")
def src06(t):
    found = pages.tables(declared_pages(t).unionByName(t("pages").select("page_id", "html")))
    return found.groupBy("n_columns", "n_rows", F.element_at("header", 3).alias("last_header"), F.col("rows")[0][1].alias("code")).agg(rows().alias("n"))


@query(
    "src07_html_links",
    r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html,
    '<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS a, unnest(range(1, 1 + len(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'))))
    AS pos FROM pages),
    h AS (SELECT page_id, pos, root, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a,
    '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM a),
    u AS (SELECT page_id, pos, root, substr(text, 1, 100) AS text, CASE WHEN href LIKE '%://%' THEN href WHEN href LIKE '/%'
    THEN root || href ELSE '?' END AS url FROM h),
    f AS (SELECT page_id, url, min(pos) AS pos, arg_min(text, pos) AS text FROM u WHERE lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)',
    1)) = lower(regexp_extract(root, '^[A-Za-z]+://([^/?#]*)', 1)) GROUP BY 1, 2)
    SELECT page_id, url, text, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER)
    AS position FROM f) WHERE position <= 100""",
)
def src07(t):
    return pages.links(t("pages"))


@query(
    "src08_page_titles",
    r"""WITH p AS (SELECT page_id, url, html, regexp_replace(html, '(?s)<script.*?</script>', '', 'g') AS plain FROM pages),
    x AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(plain, '<p(\s[^>]*)?>', chr(1), 'g'), chr(1))[2:],
    lambda s: trim(regexp_replace(regexp_replace(split_part(s, '</p>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda
    s: s <> '') AS ps FROM p)
    SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, array_to_string(ps, ' ') AS text,
    len(ps) AS paragraphs, strlen(html) AS bytes FROM x""",
)
def src08(t):
    return pages.page_texts(t("pages"))


@query(
    "src09_message_export",
    """SELECT role AS channel, count(*) AS n, sum(turn % 7)::BIGINT AS views, sum(length(coalesce(text, '')))::BIGINT AS chars,
    count(*) FILTER (WHERE turn % 3 = 0) AS with_media FROM conversations GROUP BY 1""",
)
def src09(t):
    x = t("conversations")
    media = F.when(F.col("turn") % 3 == 0, "photo")
    payload = F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("2024-01-01T00:00:00").alias("date"),
        "text", F.nullif(F.col("turn") % 7, F.lit(0)).alias("views"), media.alias("media")))
    m = files.normalise_messages(x.select(F.col("role").alias("channel"), payload.alias("payload")))
    return m.groupBy("channel").agg(rows().alias("n"), F.sum("views").alias("views"), F.sum("text_length").alias("chars"),
        F.count_if("has_media").alias("with_media"))


@query(
    "src10_src11_table_records",
    """SELECT edrpou AS company_name, hs_code, CAST(CAST(qty AS INTEGER) AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS country_code,
    count(*) > 0 AS kept FROM records GROUP BY 1, 2, 3""",
)
def src10(t):
    return pages.table_records(pages.tables(declared_pages(t))).select("company_name", "hs_code", "amount", "country_code", F.lit(True).alias("kept"))


@query(
    "src12_cdc_topic",
    """SELECT 'public.orders' AS "table", CASE WHEN o_orderkey % 50 = 0 THEN 'tombstone' WHEN o_orderkey % 10 = 0 THEN 'd'
    WHEN o_orderstatus = 'F' THEN 'c' ELSE 'u' END AS op, o_orderkey % 10 = 0 AS deleted, count(*) AS n,
    round(sum(CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END), 2) AS amount FROM orders GROUP BY 2, 3""",
)
def src12(t):
    x = t("orders")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.lit("hidden").alias("secret"))
    gone, op = F.col("o_orderkey") % 10 == 0, F.when(F.col("o_orderkey") % 10 == 0, "d").when(F.col("o_orderstatus") == "F", "c").otherwise("u")
    value = F.when(F.col("o_orderkey") % 50 != 0, F.to_json(F.named_struct(F.lit("op"), op, F.lit("ts_ms"), F.lit(1),
        F.lit("before"), F.when(gone, row), F.lit("after"), F.when(~gone, row))))
    messages = x.select(F.explode(F.array(F.lit("server.public.orders"), F.lit("server.public.notes"))).alias("topic"),
        F.col("o_orderkey").cast("string").alias("key"), value.alias("value"))
    path = t.scratch()
    messages.write.parquet(path)
    changes = files.unwrap_changes(t.spark.read.parquet(path), "id long, total double, secret string", ["public.orders"], ["secret"])
    return changes.groupBy("table", "op", "deleted").agg(rows().alias("n"), F.round(F.sum("total"), 2).alias("amount"))


@query(
    "src14_time_scan",
    """SELECT CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= DATE '2024-01-05' AND
    ts < DATE '2024-01-12' GROUP BY 1""",
)
def src14(t):
    path = t.scratch()
    dated = t("events").withColumn("date", F.to_date("ts"))
    dated.repartition("date").write.partitionBy("date").parquet(path)
    week = files.read_days(t.spark, path, datetime.date(2024, 1, 5), datetime.date(2024, 1, 11))
    return week.groupBy("date").agg(rows().alias("n"), F.round(F.sum("value"), 4).alias("total"))
