"""The library's operators as queries over the test tables, each with its SQL.

``q`` registers a query with the DuckDB SQL that gives the same rows; where an operator has
no SQL form the SQL is None and it is tested against literals or brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import extract, governance, lineage, metrics, quality, search, shape, validate
from docloom.plans import schema as plans
from docloom.sinks import export
from docloom.sources import files
from docloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# Records ------------------------------------------------------------------


def parties(spark: SparkSession, sf: str) -> DataFrame:
    """A nested record for each customer."""
    c, n, r = (t(spark, sf, x) for x in ("customer", "nation", "region"))
    df = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    data = F.struct(
        F.struct(F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("address")).alias("customer"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return shape.canonical(df, F.concat(F.lit("C"), F.col("c_custkey")), data, F.lit("2024-01-15 10:30:00"))


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """A record with line items for each order that has some."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    df = t(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    items = F.transform("items", lambda x: F.struct(x["l_partkey"].alias("part"), x["l_quantity"].alias("quantity")))
    data = F.struct(F.concat(F.lit("INV-"), F.col("o_orderkey")).alias("invoice_number"), F.col("o_orderstatus").alias("status"), items.alias("line_items"))
    return shape.canonical(df, F.concat(F.lit("O"), F.col("o_orderkey")), data, F.col("o_orderdate"))


#: JSON records with faults, made of orders by key.
FAULTY = """
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 7 = 2 THEN 'could not extract' ELSE 'INV-' || CAST(o_orderkey AS {text}) END AS invoice_number,
         {day} AS invoice_date,
         o_totalprice AS total,
         o_orderpriority AS note,
         o_orderkey % 5 = 0 AS lacks_total,
         o_orderkey % 11 = 0 AS null_note
  FROM orders"""
FAULTY_DUCK = FAULTY.format(
    text="VARCHAR",
    day="CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END",
)


def faulty(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(records, fields) of faulty invoices; the record is a variant."""
    t(spark, sf, "orders").createOrReplaceTempView("orders")
    df = spark.sql(FAULTY.format(text="STRING", day="CASE WHEN o_orderkey % 6 = 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"))
    number = F.when(~F.col("lacks_total"), F.col("total"))
    body = F.concat(
        F.lit('{"a_invoice_number":'), F.to_json(F.struct(F.col("invoice_number").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("invoice_number").alias("v")))) - 6),
        F.lit(',"b_invoice_date":"'), F.col("invoice_date"), F.lit('"'),
        F.when(number.isNotNull(), F.concat(F.lit(',"c_total":'), F.format_string("%.2f", number))).otherwise(""),
        F.lit(',"d_note":'), F.when(F.col("null_note"), "null").otherwise(F.concat(F.lit('"'), F.col("note"), F.lit('"'))), F.lit("}"),
    )
    records = df.select("id", F.parse_json(body).alias("v"))
    return records.select("id"), shape.fields_view(records, "v", ["id"])


#: The fields of these records in DuckDB: (id, pos, path, tag, str_val, num_val).
FIELDS = f"""
f0 AS ({FAULTY_DUCK}),
fields AS (
  SELECT id, 0 AS pos, 'a_invoice_number' AS path, 'string' AS tag, invoice_number AS str_val, CAST(NULL AS DOUBLE) AS num_val FROM f0
  UNION ALL SELECT id, 1, 'b_invoice_date', 'string', invoice_date, NULL FROM f0
  UNION ALL SELECT id, 2, 'c_total', CASE WHEN total = floor(total) THEN 'float' ELSE 'float' END, NULL, total FROM f0 WHERE NOT lacks_total
  UNION ALL SELECT id, 3, 'd_note', CASE WHEN null_note THEN 'null' ELSE 'string' END, CASE WHEN null_note THEN NULL ELSE note END, NULL FROM f0)"""

#: All issues of these records in DuckDB: (id, issue_type, severity, field_path, message).
ISSUES = rf"""{FIELDS},
required(field) AS (VALUES ('a_invoice_number'), ('b_invoice_date'), ('c_total')),
issues AS (
  SELECT f0.id, 'required_fields' AS issue_type, 'error' AS severity, field AS field_path, 'Required field ''' || field || ''' is missing' AS message
  FROM f0, required WHERE NOT EXISTS (SELECT 1 FROM fields WHERE fields.id = f0.id AND path = field)
  UNION ALL SELECT id, 'data_quality', 'warning', path, 'Field contains null value' FROM fields WHERE tag = 'null'
  UNION ALL SELECT id, 'data_quality', 'warning', path, 'Field contains empty string' FROM fields WHERE tag = 'string' AND trim(str_val) = ''
  UNION ALL SELECT id, 'format_validation', 'warning', path, 'Inconsistent date format: ''' || str_val || '''' FROM fields
    WHERE tag = 'string' AND contains(path, 'date') AND NOT regexp_matches(str_val, '^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}|\d{{2}}/\d{{2}}/\d{{2}})')
  UNION ALL SELECT id, 'data_quality', 'warning', path, 'Suspicious placeholder value: ''' || str_val || '''' FROM fields
    WHERE tag = 'string' AND regexp_matches(lower(trim(str_val)), '^((xxx+|aaa+|bbb+|ccc+)|(test|sample|placeholder|dummy)|n/?a|(tbd|tba))$')
  UNION ALL SELECT id, 'data_quality', 'error', path, 'Possible extraction error in value: ''' || substr(str_val, 1, 50) || '...''' FROM fields
    WHERE tag = 'string' AND regexp_matches(lower(str_val), 'error|failed|exception|null|undefined|could\s+not\s+extract|unable\s+to\s+process')
  UNION ALL SELECT id, 'business_rules', 'warning', path, 'Field too short: ' || length(str_val) || ' chars, minimum 3' FROM fields
    WHERE tag = 'string' AND contains(path, 'invoice_number') AND length(str_val) < 3
  UNION ALL SELECT id, 'format_validation', 'error', path, 'Field does not match expected pattern' FROM fields
    WHERE tag = 'string' AND contains(path, 'invoice_number') AND NOT regexp_matches(str_val, '^(?:^[A-Z0-9-]+$)')
  UNION ALL SELECT id, 'format_validation', 'error', path, 'Field does not match expected pattern' FROM fields
    WHERE tag = 'string' AND contains(path, 'date') AND NOT regexp_matches(str_val, '^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})')
  UNION ALL SELECT id, 'business_rules', 'error', path, 'Value above maximum' FROM fields WHERE tag = 'float' AND contains(path, 'total') AND num_val > 1000000)"""


def required_issues(spark: SparkSession, records: DataFrame, fields: DataFrame) -> DataFrame:
    required = spark.createDataFrame([("a_invoice_number",), ("b_invoice_date",), ("c_total",)], "field string")
    return validate.missing_required(records, fields, required, ["id"])


def all_issues(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, fields = faulty(spark, sf)
    found = required_issues(spark, records, fields).unionByName(
        validate.quality_issues(fields, ["id"], validate.rules_table(spark), "invoice").drop("ord")
    )
    return records, fields, found


# Shape --------------------------------------------------------------------


@q("""SELECT 'C' || c_custkey AS processing_id, c_name AS customer_name, n_name AS customer_address_nation, r_name AS customer_address_region,
             c_acctbal AS balance, c_mktsegment AS segment, 'C' || c_custkey || '_shaped' AS shaped_id, true AS is_1nf
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def prj_flatten_wide(spark: SparkSession, sf: str) -> DataFrame:
    df = shape.shaped(parties(spark, sf))
    return df.withColumnsRenamed({"_shaped_id": "shaped_id", "_1nf_compliant": "is_1nf"}).drop("_transformations")


@q("""WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
      o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
      SELECT 'O' || o_orderkey AS processing_id, 'invoice_number' AS key, 'INV-' || o_orderkey AS value FROM o
      UNION ALL SELECT 'O' || o_orderkey, 'status', o_orderstatus FROM o
      UNION ALL SELECT 'O' || l_orderkey, 'line_items_' || i || '_part', CAST(l_partkey AS VARCHAR) FROM l JOIN o ON l_orderkey = o_orderkey
      UNION ALL SELECT 'O' || l_orderkey, 'line_items_' || i || '_quantity', CAST(l_quantity AS VARCHAR) FROM l JOIN o ON l_orderkey = o_orderkey""")
def prj_flatten_long(spark: SparkSession, sf: str) -> DataFrame:
    return shape.flatten_long(invoices(spark, sf), "extraction_data", ["processing_id"])


@q("""SELECT 'C' || c_custkey AS processing_id, c_name AS customer_name, n_name IS NOT NULL AS has_address
      FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def prj_flatten_one_level(spark: SparkSession, sf: str) -> DataFrame:
    df = parties(spark, sf)
    flat = shape.flatten(df, "extraction_data", max_depth=1)
    return df.select("processing_id", flat["customer_name"].alias("customer_name"), flat["customer_address"].isNotNull().alias("has_address"))


@q("""SELECT 'C' || c_custkey AS processing_id, lower(c_name) AS client, lower(r_name) AS customer_address_region, c_acctbal AS balance,
             round(c_acctbal, 6) AS _aggregated_sum
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def prj_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = shape.Rules()
    rules.register(shape.Rule("lower", "normalize", parameters={"lowercase": True}))
    rules.register(shape.Rule("sum", "aggregate", parameters={"sum_fields": ["balance", "segment", "absent"]}))
    rules.register(shape.Rule("keep", "filter", parameters={"keep_fields": ["customer_name", "customer_address_region", "balance", "_aggregated_sum"]}))
    rules.register(shape.Rule("name", "rename", parameters={"field_mapping": {"customer_name": "client"}}))
    df = shape.shaped(parties(spark, sf), rules, ["lower", "sum", "unknown", "keep", "name"])
    return df.select("processing_id", "client", "customer_address_region", "balance", r6(F.col("_aggregated_sum")).alias("_aggregated_sum"))


@q("""SELECT 'C' || c_custkey AS processing_id, s.step, s.rule_id, s.rule_type
      FROM customer, (VALUES (0, 'auto_flatten_1nf', 'normalize'), (1, 'lower', 'normalize'), (2, 'sum', 'aggregate')) s(step, rule_id, rule_type)""")
def nf_transformation_lineage(spark: SparkSession, sf: str) -> DataFrame:
    rules = shape.Rules()
    rules.register(shape.Rule("lower", "normalize", parameters={"lowercase": True}))
    rules.register(shape.Rule("sum", "aggregate", parameters={"sum_fields": ["balance"]}))
    return shape.transformation_lineage(shape.shaped(parties(spark, sf), rules, ["lower", "sum"]), rules).select("processing_id", "step", "rule_id", "rule_type")


HASHED = """sha256(concat_ws(chr(31), 'O' || o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), '1.0'))"""


@q(f"""SELECT 'O' || o_orderkey AS processing_id, {HASHED} AS integrity_hash,
             o_orderkey % 10 <> 0 AS is_valid, CASE WHEN o_orderkey % 10 = 0 THEN 'status' ELSE '' END AS modified
      FROM orders""")
def prj_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Hash, validity and difference of records of which every tenth was changed."""
    df = t(spark, sf, "orders").withColumns({"pid": F.concat(F.lit("O"), F.col("o_orderkey")), "day": day("o_orderdate"), "changed": F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))})
    same = [F.col("pid"), F.col("o_orderpriority"), F.col("day"), F.lit("1.0")]
    stored = shape.integrity_hash(same[0], F.col("o_orderstatus"), *same[1:])
    actual = shape.integrity_hash(same[0], F.col("changed"), *same[1:])
    diff = shape.modifications({"status": (F.col("o_orderstatus"), F.col("changed")), "day": (F.col("day"), F.col("day"))})
    return df.select(F.col("pid").alias("processing_id"), stored.alias("integrity_hash"), shape.integrity_valid(F.col("pid"), F.col("o_orderstatus"), stored, actual).alias("is_valid"), F.array_join(diff, ",").alias("modified"))


@q("""SELECT 'C' || c_custkey AS processing_id, 'canonical-v1.0' AS format_version, 3 AS field_count, true AS integrity_validated, false AS has_confidence_scores FROM customer""")
def snk_audit(spark: SparkSession, sf: str) -> DataFrame:
    df = shape.audit(parties(spark, sf), F.lit(True), F.lit("2024-02-01"))
    a = F.col("audit_metadata")
    return df.select("processing_id", a["format_version"].alias("format_version"), a["field_count"].alias("field_count"), a["integrity_validated"].alias("integrity_validated"), a["has_confidence_scores"].alias("has_confidence_scores"))


@q("""SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, CAST(json_extract(props, '$.k') AS DOUBLE) AS confidence FROM events""")
def prj_derived_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    scores = F.from_json("props", "map<string,double>")
    return e.select("event_id", F.floor(F.col("value") * 1000).alias("duration_ms"), F.try_element_at(scores, F.lit("k")).alias("confidence"))


@q("""SELECT c_custkey, concat_ws(chr(31), c_name, CASE WHEN c_custkey % 3 = 0 THEN '\\N' ELSE c_mktsegment END, CAST(c_custkey AS VARCHAR)) AS canonical FROM customer""")
def prj_serialise(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select(k, shape.canonical_text(F.col("c_name"), F.when(k % 3 != 0, F.col("c_mktsegment")), k).alias("canonical"))


@q("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'absent' WHEN doc_id % 3 = 0 THEN lang ELSE 'text' END AS kind FROM documents""")
def prj_model_output(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers (JSON, plain text, failed) as variants."""
    d = t(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('"}'))).otherwise(F.col("text"))
    v = fn.coerced(F.regexp_replace(raw, r"^\{(?!\"lang)", "("), F.col("doc_id") % 3 != 2)
    return d.select("doc_id", F.coalesce(F.try_variant_get(v, "$.lang", "string"), F.when(F.try_variant_get(v, "$.extracted_text", "string").isNotNull(), "text"), F.lit("absent")).alias("kind"))


@q("""SELECT conv_id, CASE WHEN count(*) = 1 THEN max(role) ELSE '{"pages":["' || string_agg(role, '","' ORDER BY turn, role) || '"],"total_pages":' || count(*) || '}' END AS answer FROM conversations GROUP BY conv_id""")
def prj_combine_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("p"))
    return c.select("conv_id", extract.combined(F.col("p.role")).alias("answer"))


@q("""SELECT p_partkey, trim(p_name) AS cleaned, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS brand FROM part""")
def prj_clean_and_name(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return p.select("p_partkey", fn.cleaned(F.concat(F.lit("  "), F.trim("p_name"), F.lit(" \t"))).alias("cleaned"), F.initcap(F.col("p_brand")).alias("brand"))


@q("""SELECT n_nationkey, 'NationNation' || replace(n_name, 'NATION_', '') AS class_name FROM nation""")
def prj_pascal_case(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "nation").select("n_nationkey", fn.pascal_case(F.concat(F.lit("nation-"), F.col("n_name"))).alias("class_name"))


@q(f"""WITH {FIELDS} SELECT path, count(*) AS n_values, count(DISTINCT CASE WHEN tag <> 'null' THEN tag END) AS n_types FROM fields GROUP BY path""")
def nf_type_consistency(spark: SparkSession, sf: str) -> DataFrame:
    _, fields = faulty(spark, sf)
    return fields.groupBy("path").agg(F.count("*").alias("n_values"), F.count_distinct(F.when(F.col("tag") != "null", F.col("tag"))).alias("n_types"))


@q("""SELECT md5(text) AS digest, count(*) AS n_records FROM documents GROUP BY text HAVING count(*) > 1""")
def nf_duplicate_records(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select(F.md5("text").alias("digest"), F.sha2("text", 256).alias("key"))
    return shape.duplicate_records(d, ["digest", "key"]).drop("key")


@q("""SELECT 'O' || o_orderkey AS processing_id, true AS atomic, o_orderkey % 4 = 0 AS nested FROM orders""")
def nf_atomicity(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("processing_id"), F.col("o_orderkey"))
    flat = o.withColumn("v", F.parse_json(F.lit('{"a":1,"b":[],"c":{}}')))
    deep = o.withColumn("v", F.parse_json(F.when(F.col("o_orderkey") % 4 == 0, '{"a":{"k":1}}').otherwise('{"a":1}')))
    a = shape.atomic_records(shape.fields_view(flat, "v", ["processing_id"]), ["processing_id"])
    b = shape.atomic_records(shape.fields_view(deep, "v", ["processing_id"]), ["processing_id"]).select("processing_id", (~F.col("atomic")).alias("nested"))
    return a.join(b, "processing_id")


# Sources and sinks --------------------------------------------------------

CONTENT = ["%PDF-1.7 body", "<html><body>x", "GIF89a....", "BM....", "plain words", "%PDF-1.7 /Encrypt", "PK..word/x", "PK..ppt/slides/", "PK....", "{\\rtf1"]


@q("""SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 5 THEN 'pdf' WHEN 6 THEN 'word' WHEN 7 THEN 'powerpoint' WHEN 8 THEN 'excel' WHEN 9 THEN 'word' END AS format,
             doc_id % 10 NOT IN (4, 5) AS is_valid FROM documents""")
def src_format_detection(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in CONTENT])
    d = t(spark, sf, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 10).cast("int")).cast("binary").alias("content"))
    form = fn.detect_format(F.col("content"), F.lit(None).cast("string"))
    return d.select("doc_id", form.alias("format"), F.coalesce(fn.is_valid(F.col("content"), form), F.lit(False)).alias("is_valid"))


@q("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS pdf,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS exif,
             CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS html
      FROM orders""")
def src_dates(spark: SparkSession, sf: str) -> DataFrame:
    o, d, k = t(spark, sf, "orders"), F.col("o_orderdate"), F.col("o_orderkey")
    pdf = F.when(k % 5 == 0, F.when(k % 2 == 0, "D:20241345000000").otherwise("D:2024")).otherwise(F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), F.lit("Z")))
    exif = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(d, "yyyy:MM:dd HH:mm:ss"))
    html = F.when(k % 3 == 0, "soon").when(k % 3 == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.select("o_orderkey", fn.pdf_date(pdf).alias("pdf"), fn.exif_date(exif).alias("exif"), fn.html_date(html).alias("html"))


@q("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 4 = 2 THEN NULL ELSE octet_length(encode(text)) END AS n_bytes,
             CASE doc_id % 4 WHEN 1 THEN 'Missing required field: document' WHEN 2 THEN 'Invalid JSON' WHEN 3 THEN 'Missing required field: schema' END AS error
      FROM documents""")
def src_requests(spark: SparkSession, sf: str) -> DataFrame:
    d, k = t(spark, sf, "documents"), F.col("doc_id") % 4
    doc = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    body = F.when(k == 2, "not json").otherwise(F.to_json(F.struct(F.when(k != 1, doc).alias("document"), F.when(k != 3, "{}").alias("schema"))))
    return files.requests(d.select("doc_id", body.alias("body"))).select("doc_id", F.octet_length("content").alias("n_bytes"), "error")


@q(r"""SELECT page_id, substr(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)), 1, 200) AS title, CAST(NULL AS VARCHAR) AS author,
              CASE WHEN length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')) > 5000 THEN CAST(greatest(1, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')) // 3000) AS INTEGER) ELSE 1 END AS pages,
              1200.0::DOUBLE AS width
       FROM pages""")
def src_html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return t(spark, sf, "pages").select("page_id", fn.html_title(h).alias("title"), fn.html_author(h).alias("author"), fn.html_pages(h).alias("pages"), fn.html_dimensions(h)["width"].alias("width"))


@q(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS x FROM pages),
       b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', chr(10), 'g'), '(?i)<p[^>]*>', chr(10) || chr(10), 'g'), '(?i)<h[1-6][^>]*>', chr(10) || chr(10), 'g'), '(?i)<div[^>]*>', chr(10), 'g') AS x FROM a),
       c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\n\s*\n', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS x FROM b)
       SELECT page_id, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS n_chars, md5(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS digest FROM c""")
def src_html_text(spark: SparkSession, sf: str) -> DataFrame:
    x = t(spark, sf, "pages").select("page_id", fn.html_text(F.col("html")).alias("x"))
    return x.select("page_id", F.char_length("x").alias("n_chars"), F.md5("x").alias("digest"))


@q(None)
def src_html_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of HTML through the adapter registry (its text renderer)."""
    p = t(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"), F.lit("html").alias("format"))
    return files.Adapters().pages(p, None, ["page_id"]).select("page_id", "page_number", F.octet_length("image").alias("n_bytes"), "error")


@q("""SELECT p_partkey, CAST(r AS INTEGER) AS first, CAST(least(r + 9, p_size) AS INTEGER) AS last FROM part, unnest(range(1, p_size + 1, 10)) u(r)""")
def src_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.explode(files.page_ranges(F.col("p_size"), 10)).alias("r")).select("p_partkey", "r.first", "r.last")


@q("""SELECT c_name AS customer_name, c_acctbal AS balance, 'C' || c_custkey AS _meta_processing_id, '1.0' AS _meta_schema_version FROM customer""")
def snk_canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = parties(spark, sf)
    data = F.struct(F.col("extraction_data.customer.name").alias("customer_name"), F.col("extraction_data.balance").alias("balance"))
    return export.canonical_rows(df.withColumn("extraction_data", data)).drop("_meta_timestamp")


@q("""SELECT 'C' || c_custkey || '_shaped' AS _meta_processing_id, 'C' || c_custkey AS _meta_canonical_id, 1 AS _meta_transformation_count, true AS _meta_1nf_compliant, c_mktsegment AS segment FROM customer""")
def snk_shaped_rows(spark: SparkSession, sf: str) -> DataFrame:
    return export.shaped_rows(shape.shaped(parties(spark, sf))).drop("customer_name", "customer_address_nation", "customer_address_region", "balance")


@q("""SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS part, CAST(l_quantity AS VARCHAR) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def snk_tabular(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose fields are arrays of one length become rows."""
    df = invoices(spark, sf)
    lines = F.col("extraction_data.line_items")
    rec = df.select(F.substring("processing_id", 2, 20).cast("long").alias("l_orderkey"), F.struct(lines["part"].alias("part"), lines["quantity"].alias("quantity")).alias("r"))
    return export.tabular(rec, "r", ["l_orderkey"])


@q("""SELECT s_suppkey, 200 AS status, '{"name":"' || s_name || '"}' AS body FROM supplier""")
def snk_response(spark: SparkSession, sf: str) -> DataFrame:
    e = export.response(F.lit(200), F.struct(F.col("s_name").alias("name")))
    return t(spark, sf, "supplier").select("s_suppkey", e["statusCode"].alias("status"), e["body"].alias("body"))


@q("""SELECT r_regionkey || ',' || r_name AS csv FROM region""")
def snk_csv_text(spark: SparkSession, sf: str) -> DataFrame:
    return export.csv_text(t(spark, sf, "region").select("r_regionkey", "r_name"))


@q("""SELECT CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS stored, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
             CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS success_rate FROM events""")
def snk_batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return export.batch_report(t(spark, sf, "events"), F.col("event_type") != "error").withColumn("success_rate", r6(F.col("success_rate")))


@q("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings""")
def snk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings").select("vec_id", "label")
    return search.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", (F.col("label") + 100).cast("int")), "vec_id")


# Filters ------------------------------------------------------------------


def stored_points(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as points with a payload made of their ids."""
    e, k = t(spark, sf, "embeddings"), F.col("vec_id")
    x, y = search.patch_grid(F.lit(25), k % 25)
    return e.select(
        k.alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("doc"), F.floor(k / 25)).alias("document_id"), (k % 5 + 1).cast("int").alias("page_number"),
        F.when(k % 2 == 0, "pdf").otherwise("html").alias("document_type"), F.format_string("2024-01-%02dT00:00:00Z", (k % 28 + 1)).alias("processing_timestamp"),
        (k % 25).cast("int").alias("patch_index"), x.alias("patch_x"), y.alias("patch_y"), F.concat_ws(",", x, y).alias("patch_coordinates"),
        F.size("embedding").alias("embedding_dimension"), F.lit("2024-02-01").alias("storage_timestamp"), "label",
    )


POINTS = """points AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 'doc' || vec_id // 25 AS document_id, CAST(vec_id % 5 + 1 AS INTEGER) AS page_number,
         CASE WHEN vec_id % 2 = 0 THEN 'pdf' ELSE 'html' END AS document_type, format('2024-01-{:02d}T00:00:00Z', vec_id % 28 + 1) AS processing_timestamp,
         CAST(vec_id % 25 AS INTEGER) AS patch_index, CAST(vec_id % 25 % 5 * 32 AS INTEGER) AS patch_x, CAST(vec_id % 25 // 5 * 32 AS INTEGER) AS patch_y, label
  FROM embeddings)"""


@q(f"""WITH {POINTS} SELECT id, document_id, patch_x, patch_y FROM points
       WHERE document_type = 'pdf' AND page_number BETWEEN 2 AND 4 AND patch_x BETWEEN 32 AND 96 AND patch_y BETWEEN 0 AND 64 AND processing_timestamp > '2024-01-03T00:00:00Z'""")
def flt_payload(spark: SparkSession, sf: str) -> DataFrame:
    c = {"document_type": "pdf", "page_number": {"gte": 2, "lte": 4}, "spatial_box": [32, 0, 96, 64], "processing_timestamp": {"after": "2024-01-03T00:00:00Z"}}
    return stored_points(spark, sf).where(search.payload_filter(c)).select("id", "document_id", "patch_x", "patch_y")


@q("""SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def flt_lookback(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return t(spark, sf, "events").where(F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")).select("event_id", "ts")


@q("""SELECT event_id, ts, user_id FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10)""")
def flt_recent_errors(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.recent_failures(t(spark, sf, "events"), F.col("event_type") == "error", ["ts", "event_id"], 10).select("event_id", "ts", "user_id")


@q("""SELECT a.p_partkey AS a_id, b.s_suppkey AS b_id FROM part a JOIN supplier b
      ON NOT (a.p_partkey % 997 + a.p_size <= b.s_suppkey * 7 % 991 OR b.s_suppkey * 7 % 991 + 20 <= a.p_partkey % 997 OR a.p_size + 10 <= b.s_nationkey OR b.s_nationkey + 10 <= a.p_size)""")
def jn_spatial_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a = t(spark, sf, "part").select(F.col("p_partkey").alias("a_id"), (F.col("p_partkey") % 997).alias("ax"), F.col("p_size").alias("ay"), F.col("p_size").alias("aw"), F.lit(10).alias("ah"))
    b = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("b_id"), (F.col("s_suppkey") * 7 % 991).alias("bx"), F.col("s_nationkey").alias("by"), F.lit(20).alias("bw"), F.lit(10).alias("bh"))
    return search.overlap_join(a, b).select("a_id", "b_id")


# Joins --------------------------------------------------------------------


@q("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'C' || o_custkey END AS canonical_processing_id, CASE WHEN c_custkey IS NOT NULL THEN length(c_name) END AS canonical_fields
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""")
def jn_optional_context(spark: SparkSession, sf: str) -> DataFrame:
    side = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), "c_custkey").alias("processing_id"), F.char_length("c_name").cast("long").alias("canonical_fields"))
    own = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("canonical_id"))
    return governance.with_canonical(own, side).drop("canonical_id")


@q(f"""WITH {ISSUES} SELECT id, field_path FROM issues WHERE issue_type = 'required_fields'""")
def jn_missing_required(spark: SparkSession, sf: str) -> DataFrame:
    return required_issues(spark, *faulty(spark, sf)).select("id", "field_path")


@q("""SELECT d.doc_id, coalesce(l.quality, 0.5)::DOUBLE AS text_confidence, coalesce(l.quality, 0.5)::DOUBLE AS lang_confidence FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jn_default_confidence(spark: SparkSession, sf: str) -> DataFrame:
    d, label = t(spark, sf, "documents"), t(spark, sf, "labels")
    given = F.coalesce(F.col("quality").cast("double"), F.lit(0.5))
    c = metrics.same_confidence(F.array(F.lit("text"), F.lit("lang")), given)
    return d.join(label, "doc_id", "left").select("doc_id", F.element_at(c, "text").alias("text_confidence"), F.element_at(c, "lang").alias("lang_confidence"))


@q("""SELECT p_partkey, 'Field too short: ' || length(p_type) || ' chars, minimum ' || r.least AS message FROM part JOIN (VALUES ('brand#1', 7), ('brand#2', 8), ('3', 9)) r(part, least) ON contains(lower(p_brand), r.part) WHERE length(p_type) < r.least""")
def jn_contains_rule(spark: SparkSession, sf: str) -> DataFrame:
    own = [("part", p, n, None, None, None) for p, n in (("brand#1", 7), ("brand#2", 8), ("3", 9))]
    rules = spark.createDataFrame(own, "document_type string, part string, min_length int, pattern string, min_value double, max_value double")
    fields = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("path"), F.lit("string").alias("tag"), F.col("p_type").alias("str_val"), F.lit(None).cast("double").alias("num_val"))
    return validate.rule_issues(fields, rules, "part", ["p_partkey"]).select("p_partkey", "message")


@q("""WITH h AS (SELECT source, n_chars, md5(CAST(doc_id AS VARCHAR)) < '8' AS now FROM documents),
      a AS (SELECT source, round(avg(n_chars) * CASE WHEN source LIKE '%3' THEN 0.1 ELSE 1 END, 6) AS score FROM h WHERE now GROUP BY source), b AS (SELECT source, round(avg(n_chars), 6) AS score FROM h WHERE NOT now GROUP BY source)
      SELECT a.source, a.score, b.score AS baseline_score FROM a JOIN b USING (source) WHERE a.score < b.score * 0.9""")
def jn_score_regressions(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").withColumn("now", F.md5(F.col("doc_id").cast("string").cast("binary")) < "8")
    of = lambda own, by: d.where(own).groupBy("source").agg(r6(F.avg("n_chars") * by).alias("score"))
    cut = F.when(F.col("source").like("%3"), 0.1).otherwise(1.0)  # a drop that must be found
    return metrics.score_regressions(of("now", cut), of("not now", F.lit(1.0)), "source")


# Validation ---------------------------------------------------------------


@q(f"""WITH {ISSUES} SELECT * FROM issues""")
def val_issues(spark: SparkSession, sf: str) -> DataFrame:
    return all_issues(spark, sf)[2]


@q(f"""WITH {ISSUES} SELECT id, CAST(sum((severity = 'critical')::INT) AS BIGINT) AS n_critical, CAST(sum((severity = 'error')::INT) AS BIGINT) AS n_error,
             CAST(sum((severity = 'warning')::INT) AS BIGINT) AS n_warning, CAST(sum((severity = 'info')::INT) AS BIGINT) AS n_info FROM issues GROUP BY id""")
def agg_severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.severity_counts(all_issues(spark, sf)[2], ["id"])


@q(f"""WITH {ISSUES},
   per AS (SELECT id, count(*) AS n, sum((tag <> 'null' AND NOT (tag = 'string' AND trim(str_val) = ''))::INT) AS filled FROM fields GROUP BY id),
   bad AS (SELECT id, count(*) AS n_issues, sum(CASE WHEN issue_type IN ('required_fields', 'type_validation') THEN CASE severity WHEN 'error' THEN 0.8 WHEN 'warning' THEN 0.4 ELSE 0 END ELSE 0 END) AS w,
             sum(regexp_matches(lower(message), 'empty|null')::INT) AS blank, sum((severity = 'error')::INT) AS n_bad FROM issues GROUP BY id),
   s AS (SELECT f0.id, n, coalesce(n_issues, 0) AS n_issues, greatest(0, 1 - coalesce(w, 0) / n) AS a, greatest(0, filled / n - 0.1 * coalesce(blank, 0)) AS b, coalesce(n_bad, 0) AS n_bad FROM f0 JOIN per USING (id) LEFT JOIN bad USING (id))
   SELECT id, n AS n_fields, n_issues, round(a, 6)::DOUBLE AS compliance, round(b, 6)::DOUBLE AS completeness, round(0.4 * a + 0.3 * b + 0.3, 6)::DOUBLE AS overall, n_bad = 0 AND round(0.4 * a + 0.3 * b + 0.3, 9) >= 0.7 AS is_valid FROM s""")
def agg_validation_scores(spark: SparkSession, sf: str) -> DataFrame:
    records, fields, found = all_issues(spark, sf)
    s = validate.scores(records, fields, found, ["id"])
    return s.select("id", "n_fields", "n_issues", r6(F.col("compliance")).alias("compliance"), r6(F.col("completeness")).alias("completeness"), r6(F.col("overall")).alias("overall"), "is_valid")


@q("""SELECT c_custkey AS id, 'type_validation' AS issue_type, 'error' AS severity, 'tags[1]' AS field_path, 'Type mismatch: expected string, got int' AS message FROM customer WHERE c_custkey % 3 = 0""")
def val_array_items(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    tags = F.array(F.lit("string"), F.when(F.col("id") % 3 == 0, "int").otherwise("string"))
    return validate.array_item_issues(c, ["id"], "tags", tags, "string")


@q("""WITH v AS (SELECT doc_id, unnest([lang, source, lang]) AS value, unnest([0, 1, 2]) AS pos FROM documents), w AS (SELECT doc_id, unnest(['same text', source, 'same text']) AS value, unnest([0, 1, 2]) AS pos FROM documents)
      SELECT doc_id, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY pos) AS n FROM w WHERE length(value) > 5) WHERE n > 1""")
def win_duplicate_values(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(F.array(F.lit("same text"), F.col("source"), F.lit("same text"))).alias("pos", "value"))
    return shape.numbered_duplicates(d, ["doc_id"], "value", ["pos"])


@q("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Unsupported format: bmp' WHEN 1 THEN '' WHEN 2 THEN 'Unsupported file format: txt' ELSE '' END AS issues FROM documents""")
def val_image_inputs(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("data:image/bmp;base64,AA", "a/b.PNG", "c.txt", "data:image/png;base64,AA")])
    image = F.get(names, (F.col("doc_id") % 4).cast("int"))
    return t(spark, sf, "documents").select("doc_id", F.array_join(metrics.image_issues(image), ",").alias("issues"))


# Governance ---------------------------------------------------------------


def governed(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    canonical = o.select(F.concat(F.lit("O"), k).alias("processing_id"), F.col("o_orderstatus").alias("extraction_data"), F.col("o_orderdate").alias("timestamp"), F.lit("1.0").alias("schema_version"), F.when(k % 9 == 0, "").otherwise("abc").alias("integrity_hash"))
    shaped = o.select(
        F.concat(F.lit("O"), k, F.lit("_shaped")).alias("processing_id"), F.concat(F.lit("O"), F.when(k % 13 == 0, k + 1).otherwise(k)).alias("canonical_id"), F.col("o_orderdate").alias("timestamp"),
        F.array(F.lit("normalize"), F.when(k % 8 == 0, "custom").otherwise("rename")).alias("rule_types"), (k % 4).cast("int").alias("n_fields"), (k % 10 != 0).alias("is_1nf"), F.lit(True).alias("atomic"),
    )
    sides = canonical.select("processing_id", F.lit(4).alias("canonical_fields"))
    as_of = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    a = governance.results(canonical, governance.canonical_rules(as_of), ["processing_id"])
    b = governance.results(governance.with_canonical(shaped, sides), governance.shaped_rules(), ["processing_id"])
    return a.unionByName(b)


GOVERNED = """g AS (
  SELECT 'O' || o_orderkey AS processing_id, r.rule_id, r.category, r.severity,
         CASE r.rule_id WHEN 'canonical_002' THEN o_orderkey % 9 <> 0 WHEN 'canonical_003' THEN o_orderdate <= TIMESTAMP '1998-01-01' ELSE true END AS passed
  FROM orders, (VALUES ('canonical_001', 'canonical_integrity', 'critical'), ('canonical_002', 'canonical_integrity', 'error'), ('canonical_003', 'canonical_integrity', 'warning'), ('compliance_001', 'compliance', 'error'), ('compliance_002', 'compliance', 'error')) r(rule_id, category, severity)
  UNION ALL
  SELECT 'O' || o_orderkey || '_shaped', r.rule_id, r.category, r.severity,
         CASE r.rule_id WHEN 'transform_001' THEN o_orderkey % 8 <> 0 WHEN 'transform_002' THEN o_orderkey % 10 <> 0
           WHEN 'distortion_001' THEN o_orderkey % 4 >= 2 OR (o_orderkey % 13 = 0 AND o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders)) ELSE true END
  FROM orders, (VALUES ('transform_001', 'transformation_approval', 'error'), ('transform_002', 'transformation_approval', 'critical'), ('distortion_001', 'data_distortion', 'warning'), ('distortion_002', 'data_distortion', 'warning'), ('compliance_001', 'compliance', 'error'), ('compliance_002', 'compliance', 'error')) r(rule_id, category, severity))"""


@q(f"""WITH {GOVERNED} SELECT * FROM g WHERE NOT passed""")
def gov_failures(spark: SparkSession, sf: str) -> DataFrame:
    return governed(spark, sf).where("not passed").drop("recommendation")


@q(f"""WITH {GOVERNED}, s AS (SELECT 'all' AS grouping, '' AS name, * FROM g UNION ALL SELECT 'severity', severity, * FROM g UNION ALL SELECT 'category', category, * FROM g),
       n(grouping, name) AS (VALUES ('all', ''), ('severity', 'critical'), ('severity', 'error'), ('severity', 'warning'), ('severity', 'info'), ('category', 'canonical_integrity'), ('category', 'transformation_approval'), ('category', 'data_distortion'), ('category', 'compliance'), ('category', 'schema_conformance'))
       SELECT n.grouping, n.name, count(s.passed) AS n_total, CAST(coalesce(sum(s.passed::INT), 0) AS BIGINT) AS n_passed, CAST(count(s.passed) - coalesce(sum(s.passed::INT), 0) AS BIGINT) AS n_failed
       FROM n LEFT JOIN s ON n.grouping = s.grouping AND n.name = s.name GROUP BY n.grouping, n.name""")
def gov_report(spark: SparkSession, sf: str) -> DataFrame:
    return governance.report(governed(spark, sf))


@q("""SELECT rule_type, rule_type <> 'custom' AS approved FROM (VALUES ('normalize'), ('custom'), ('rename')) v(rule_type)""")
def gov_approvals(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select(F.explode(F.array(F.lit("normalize"), F.when(F.col("o_orderkey") % 8 == 0, "custom").otherwise("rename"))).alias("rule_type"))
    return governance.approvals(o)


# Lineage ------------------------------------------------------------------


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and their exports as lineage nodes."""
    at = F.lit("2024-01-15 10:30:00")
    r, n, s = (t(spark, sf, x) for x in ("region", "nation", "supplier"))
    parts = [
        lineage.stage_nodes(r, "source", F.lit("p"), F.col("r_regionkey"), at),
        lineage.stage_nodes(n, "conversion", F.lit("p"), F.col("n_nationkey"), at, F.concat(F.lit("p_source_"), F.col("n_regionkey")), F.lit(2.0), F.col("n_nationkey")),
        lineage.stage_nodes(s, "embedding", F.lit("p"), F.col("s_suppkey"), at, F.concat(F.lit("p_conversion_"), F.col("s_nationkey")), F.lit(3.0), F.lit(1024)),
        lineage.export_nodes(s, F.concat(F.lit("p"), F.col("s_suppkey")), "parquet", at, F.concat(F.lit("p_embedding_"), F.col("s_suppkey"))),
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return nodes, lineage.edges(nodes)


EDGES = """edges AS (
  SELECT 'p_source_' || n_regionkey AS parent_id, 'p_conversion_' || n_nationkey AS child_id FROM nation
  UNION ALL SELECT 'p_conversion_' || s_nationkey, 'p_embedding_' || s_suppkey FROM supplier
  UNION ALL SELECT 'p_embedding_' || s_suppkey, 'p' || s_suppkey || '_export_parquet' FROM supplier)"""


@q(f"""WITH {EDGES} SELECT parent_id AS node_id, child_id FROM edges""")
def lin_children(spark: SparkSession, sf: str) -> DataFrame:
    nodes, links = graph(spark, sf)
    return lineage.children(links, nodes)


CLOSURE = f"""WITH RECURSIVE {EDGES}, c AS (SELECT parent_id AS node_id, child_id AS other_id, 1 AS depth FROM edges
  UNION ALL SELECT c.node_id, e.child_id, c.depth + 1 FROM c JOIN edges e ON c.other_id = e.parent_id)"""


@q(f"""{CLOSURE} SELECT node_id, other_id, min(depth) AS depth FROM c GROUP BY node_id, other_id""")
def lin_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.closure(graph(spark, sf)[1])


@q(f"""{CLOSURE} SELECT node_id, other_id, min(depth) AS depth FROM c GROUP BY node_id, other_id""")
def lin_descendants_sql(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.closure_sql(graph(spark, sf)[1])


@q("""SELECT 'p_source_' || n_regionkey AS start_id, 'p' || s_suppkey || '_export_parquet' AS end_id, 4 AS n_nodes,
             'p_source_' || n_regionkey || '>p_conversion_' || n_nationkey || '>p_embedding_' || s_suppkey || '>p' || s_suppkey || '_export_parquet' AS path
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def lin_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes, links = graph(spark, sf)
    p = lineage.shortest_paths(links, nodes.where("node_type = 'source_document'"), nodes.where("node_type = 'export_output'"))
    return p.select("start_id", "end_id", "n_nodes", F.array_join("path", ">").alias("path"))


@q("""SELECT 'p' || s_suppkey || '_export_parquet' AS node_id, 'p_source_' || n_regionkey AS source_id, 4 AS n_nodes FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def lin_chain(spark: SparkSession, sf: str) -> DataFrame:
    nodes, links = graph(spark, sf)
    return lineage.chain(links, nodes, nodes.where("node_type = 'export_output'").select("node_id")).select("node_id", "source_id", "n_nodes")


@q("""WITH x AS (SELECT 'convert_to_images' AS operation, 'document_conversion' AS node_type, 2.0 AS v FROM nation UNION ALL SELECT 'generate_embeddings', 'embedding', 3.0 FROM supplier)
      SELECT 'all' AS grouping, '' AS name, sum(v)::DOUBLE AS total_time FROM x UNION ALL SELECT 'operation', operation, sum(v)::DOUBLE FROM x GROUP BY operation UNION ALL SELECT 'type', node_type, sum(v)::DOUBLE FROM x GROUP BY node_type""")
def agg_lineage_performance(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.performance_summary(graph(spark, sf)[0])


@q("""SELECT 'p_source_' || n_regionkey AS start_id, 'p' || s_suppkey || '_export_parquet' AS end_id, 5.0::DOUBLE AS total_time FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def agg_path_time(spark: SparkSession, sf: str) -> DataFrame:
    nodes, links = graph(spark, sf)
    paths = lineage.shortest_paths(links, nodes.where("node_type = 'source_document'"), nodes.where("node_type = 'export_output'"))
    return lineage.path_time(paths, nodes)


@q("""SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM supplier) AS n_nodes, (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM supplier) AS n_edges,
             (SELECT count(*) FROM region) AS n_sources, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS n_sinks""")
def agg_graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.totals(*graph(spark, sf))


# Quality ------------------------------------------------------------------


@q(f"""WITH {FIELDS}, w AS (SELECT *, CASE WHEN regexp_matches(path, 'total|amount|id|date|name') THEN 1.0 ELSE 0.5 END AS w, CASE path WHEN 'c_total' THEN 0.9 WHEN 'b_invoice_date' THEN 0.8 ELSE 0.5 END AS c FROM fields)
       SELECT id, round(sum(c * w) / sum(w), 6)::DOUBLE AS accuracy FROM w GROUP BY id""")
def agg_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    records, fields = faulty(spark, sf)
    c = records.select("id", F.explode(F.array(F.struct(F.lit("c_total").alias("field"), F.lit(0.9).alias("confidence")), F.struct(F.lit("b_invoice_date").alias("field"), F.lit(0.8).alias("confidence")))).alias("x")).select("id", "x.*")
    return quality.accuracy(fields, ["id"], c).withColumn("accuracy", r6(F.col("accuracy")))


@q(f"""WITH {FIELDS} SELECT id, round(greatest(0, least(1, 0.7 - sum(CASE WHEN tag = 'null' OR (tag = 'string' AND trim(str_val) = '') THEN 0.1 WHEN tag = 'string' AND regexp_matches(lower(str_val), 'error|failed|null') THEN 0.2 ELSE 0 END))), 6)::DOUBLE AS accuracy FROM fields GROUP BY id""")
def agg_basic_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return quality.accuracy(faulty(spark, sf)[1], ["id"]).withColumn("accuracy", r6(F.col("accuracy")))


@q(f"""WITH {FIELDS}, e(field, w) AS (VALUES ('a_invoice_number', 2.0), ('c_total', 2.0), ('d_note', 1.0), ('vendor', 1.0)),
       g AS (SELECT id, sum(w) AS s FROM fields JOIN e ON path = field WHERE tag <> 'null' AND NOT (tag = 'string' AND trim(str_val) = '') GROUP BY id)
       SELECT f0.id, round(coalesce(s, 0) / 6.0, 6)::DOUBLE AS completeness FROM f0 LEFT JOIN g USING (id)""")
def agg_completeness(spark: SparkSession, sf: str) -> DataFrame:
    records, fields = faulty(spark, sf)
    e = spark.createDataFrame([("a_invoice_number", True), ("c_total", True), ("d_note", False), ("vendor", False)], "field string, required boolean")
    return quality.completeness(fields, ["id"], e, records).withColumn("completeness", r6(F.col("completeness")))


@q(f"""WITH {FIELDS}, s AS (SELECT id, lower(trim(str_val)) AS v FROM fields WHERE tag = 'string' AND length(trim(str_val)) > 3)
       SELECT f0.id, round(coalesce(count(DISTINCT v) / nullif(count(v), 0) * 0.9 + 0.1, 1.0), 6)::DOUBLE AS consistency FROM f0 LEFT JOIN s USING (id) GROUP BY f0.id""")
def agg_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return quality.consistency(faulty(spark, sf)[1], ["id"]).withColumn("consistency", r6(F.col("consistency")))


def six(spark: SparkSession, sf: str) -> DataFrame:
    """Six dimensions for every order, made of its columns."""
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    secs = (k % 90).cast("double")
    return o.select(
        k.alias("id"), F.col("o_orderdate").alias("timestamp"), F.col("o_custkey"), F.col("o_orderpriority").alias("grp"), secs.alias("seconds"), (k % 6).cast("int").alias("n_fields"),
        ((k % 50) / 50 + 0.02).alias("accuracy"), (1 - (k % 20) / 40).alias("completeness"), F.lit(0.9).alias("consistency"),
        quality.reliability(k % 7, k % 3, k % 2 == 0, secs).alias("reliability"),
        quality.performance((k % 6).cast("double"), secs, F.lit(None).cast("double")).alias("performance"),
        quality.schema_compliance(k % 4 == 0, F.when(k % 10 != 3, k % 4).cast("int"), F.when(k % 8 == 5, 1).otherwise(0), F.when(k % 8 == 6, 1).otherwise(0)).alias("schema_compliance"),
    )


SIX = """k AS (SELECT o_orderkey AS k, o_orderdate, o_custkey, o_orderpriority, (o_orderkey % 90)::DOUBLE AS s, (o_orderkey % 6)::DOUBLE AS nf FROM orders),
six AS (SELECT k AS id, o_orderdate AS timestamp, o_custkey, o_orderpriority AS grp, s AS seconds, nf AS n_fields, (k % 50) / 50 + 0.02 AS accuracy, 1 - (k % 20) / 40 AS completeness, 0.9 AS consistency,
  greatest(0, (1 - least(0.5, (k % 7) * 0.1)) * (1 - least(0.3, (k % 3) * 0.1)) * CASE WHEN k % 2 = 0 THEN 0.8 ELSE 1 END * CASE WHEN s > 30 THEN 0.9 ELSE 1 END) AS reliability,
  (CASE WHEN s < 5 THEN 1.0 WHEN s < 15 THEN 0.9 WHEN s < 30 THEN 0.7 ELSE greatest(0.2, 1 - (s - 30) / 60) END
   + CASE WHEN s <= 0 OR nf <= 0 THEN 0.5 WHEN nf / s >= 1 THEN least(1.0, nf / s / 2) ELSE nf / s END + 0.8) / 3 AS performance,
  CASE WHEN k % 10 = 3 THEN 0.8 WHEN k % 4 = 0 AND k % 4 = 0 THEN 1.0 ELSE
    CASE WHEN k % 8 = 5 THEN 0.7 ELSE 1 END * CASE WHEN k % 8 = 6 THEN 0.8 ELSE 1 END
    * CASE WHEN k % 4 - (k % 8 = 5)::INT - (k % 8 = 6)::INT > 0 THEN greatest(0.7, 1 - (k % 4 - (k % 8 = 5)::INT - (k % 8 = 6)::INT) * 0.05) ELSE 1 END END AS schema_compliance FROM k),
a AS (SELECT *, round(accuracy * 0.25 + completeness * 0.2 + consistency * 0.15 + reliability * 0.2 + performance * 0.1 + schema_compliance * 0.1, 12) AS o FROM six)"""


@q(f"""WITH {SIX} SELECT id, round(reliability, 6)::DOUBLE AS reliability, round(performance, 6)::DOUBLE AS performance, round(schema_compliance, 6)::DOUBLE AS schema_compliance, round(o, 6)::DOUBLE AS overall_score,
       CASE WHEN o >= 0.95 THEN 'A+' WHEN o >= 0.9 THEN 'A' WHEN o >= 0.85 THEN 'B+' WHEN o >= 0.8 THEN 'B' WHEN o >= 0.7 THEN 'C+' WHEN o >= 0.6 THEN 'C' ELSE 'F' END AS grade, o >= 0.8 AS meets_production FROM a""")
def agg_overall_quality(spark: SparkSession, sf: str) -> DataFrame:
    df = quality.assessed(six(spark, sf))
    return df.select("id", *[r6(F.col(c)).alias(c) for c in ("reliability", "performance", "schema_compliance", "overall_score")], "grade", "meets_production")


@q(f"""WITH {SIX}, b AS (SELECT id, unnest(['accuracy', 'completeness', 'consistency', 'reliability', 'performance', 'schema_compliance']) AS dimension,
       unnest([accuracy, completeness, consistency, reliability, performance, schema_compliance]) AS s, unnest([0.85, 0.9, 0.8, 0.95, 0.75, 0.9]) AS target FROM six)
       SELECT dimension, count(*) AS n, CAST(sum((round(s, 9) >= target)::INT) AS BIGINT) AS n_met, round(avg(greatest(0, target - s)), 6)::DOUBLE AS mean_needed FROM b GROUP BY dimension""")
def agg_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    df = six(spark, sf)
    df = df.withColumns({d: F.round(d, 9) for d in quality.DIMENSIONS})
    return quality.benchmarks(df, ["id"]).groupBy("dimension").agg(F.count("*").alias("n"), F.sum(F.col("meets").cast("long")).alias("n_met"), r6(F.avg("needed")).alias("mean_needed"))


@q(f"""WITH {SIX} SELECT id, CAST((accuracy < 0.6)::INT + (round(reliability, 9) < 0.7)::INT + (round(schema_compliance, 9) < 0.7)::INT + (seconds > 60)::INT + (n_fields < 3)::INT AS INTEGER) AS n_risks,
       round(n_fields / greatest(seconds, 0.1), 6)::DOUBLE AS throughput FROM six""")
def agg_risks(spark: SparkSession, sf: str) -> DataFrame:
    df = six(spark, sf).withColumns({d: F.round(d, 9) for d in quality.DIMENSIONS})
    return df.select("id", F.size(quality.risks(F.col("seconds"), F.col("n_fields"))).alias("n_risks"), r6(quality.throughput(F.col("n_fields"), F.col("seconds"))).alias("throughput"))


@q(f"""WITH {SIX}, c(dimension, target, cost) AS (VALUES ('accuracy', 0.85, 50), ('completeness', 0.9, 20), ('consistency', 0.8, 30), ('reliability', 0.95, 40), ('performance', 0.75, 60), ('schema_compliance', 0.9, 25)),
       b AS (SELECT id, unnest(['accuracy', 'completeness', 'consistency', 'reliability', 'performance', 'schema_compliance']) AS dimension, unnest([accuracy, completeness, consistency, reliability, performance, schema_compliance]) AS s FROM six),
       g AS (SELECT id, dimension, round(target - round(s, 9), 9) AS needed, cost FROM b JOIN c USING (dimension) WHERE round(s, 9) < target),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(needed * 0.8, 9) DESC, dimension) AS rank FROM g)
       SELECT id, dimension, CAST(rank AS INTEGER) AS rank, dimension || ': raise by # ' || CASE WHEN needed > 0.2 THEN '(high)' ELSE '(medium)' END AS description
       FROM r WHERE rank <= 3 AND round(cost * needed, 9) <= 10""")
def agg_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    df = six(spark, sf).withColumns({d: F.round(d, 9) for d in quality.DIMENSIONS})
    return quality.recommendations(df, ["id"], 10.0).select("id", "dimension", "rank", F.regexp_replace(quality.described(), r"[0-9.]+", "#").alias("description"))


@q(f"""WITH {SIX}, r AS (SELECT id, round(accuracy, 9) AS a, round(completeness, 9) AS c, round(consistency, 9) AS k, round(reliability, 9) AS r, round(performance, 9) AS p, round(schema_compliance, 9) AS s FROM six)
       SELECT id, CAST(greatest(1, (a < 0.85)::INT + (c < 0.9)::INT + (k < 0.8)::INT + (r < 0.95)::INT + (p < 0.75)::INT + (s < 0.9)::INT) AS INTEGER) AS n,
              a < 0.85 AND 0.85 - a > 0.2 AS change_model, a >= 0.85 AND c >= 0.9 AND k >= 0.8 AND r >= 0.95 AND p >= 0.75 AND s >= 0.9 AS met FROM r""")
def agg_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    df = six(spark, sf).withColumns({d: F.round(d, 9) for d in quality.DIMENSIONS})
    found = df.select("id", quality.suggestions().alias("texts"))
    strong = F.lit(quality.ADVICE["accuracy"][1])
    return found.select("id", F.size("texts").alias("n"), F.array_contains("texts", strong).alias("change_model"), F.array_contains("texts", F.lit(quality.NO_ADVICE)).alias("met"))


@q(f"""WITH {SIX} SELECT id, round((CASE WHEN id % 3 > 0 THEN 0.8 ELSE 0.2 END) * (CASE WHEN id % 5 = 0 THEN 0.9 ELSE 1 END), 6)::DOUBLE AS confidence_score, round(least(n_fields / 4, 1), 6)::DOUBLE AS completeness_ratio,
       CASE WHEN n_fields > 0 THEN 0.8 ELSE 0.1 END::DOUBLE AS schema_compliance_score FROM six""")
def agg_execution_quality(spark: SparkSession, sf: str) -> DataFrame:
    df = six(spark, sf)
    c = quality.execution_quality(F.col("id") % 3 > 0, F.col("id") % 5 == 0, F.col("n_fields"), F.lit(4), F.lit(True))
    return df.select("id", *[r6(c[n]).alias(n) for n in ("confidence_score", "completeness_ratio", "schema_compliance_score")])


@q(f"""WITH {SIX}, w AS (SELECT o_custkey, id, o AS s, avg(o) OVER w20 AS h, count(o) OVER w5 AS n5, avg(o) OVER w5 AS r,
         (SELECT 1) AS one, list(o) OVER w100 AS past FROM a
       WINDOW w20 AS (PARTITION BY o_custkey ORDER BY timestamp, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY o_custkey ORDER BY timestamp, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w100 AS (PARTITION BY o_custkey ORDER BY timestamp, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
       SELECT id, round(coalesce(h, 0.8), 6)::DOUBLE AS historical_average, round(CASE WHEN coalesce(len(past), 0) > 0 THEN 100.0 * len(list_filter(past, lambda x: x < s)) / len(past) ELSE 50 END, 6)::DOUBLE AS percentile_rank, n5 >= 5 AND s < r - 0.15 AS alert FROM w""")
def win_quality_history(spark: SparkSession, sf: str) -> DataFrame:
    df = quality.history(quality.assessed(six(spark, sf)), ["o_custkey"], ["timestamp", "id"], "overall_score")
    return df.select("id", r6(F.col("historical_average")).alias("historical_average"), r6(F.col("percentile_rank")).alias("percentile_rank"), "alert")


@q(f"""WITH {SIX}, x AS (SELECT o_custkey, o AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY timestamp, id) - 1 AS x FROM a),
       s AS (SELECT o_custkey, count(*) AS n, regr_slope(y, x) AS slope, coalesce(regr_r2(y, x), 0) AS r2, coalesce(stddev_samp(y), 0) AS v, arg_min(y, x) AS f, arg_max(y, x) AS l FROM x GROUP BY o_custkey)
       SELECT o_custkey, n AS n_samples, round(slope, 6)::DOUBLE AS slope, round(r2, 6)::DOUBLE AS confidence, round(v, 6)::DOUBLE AS volatility, round((l - f) / f / 30 * 100, 6)::DOUBLE AS change_rate,
       CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0.005 THEN 'improving' WHEN slope < -0.005 THEN 'declining' WHEN v > 0.1 THEN 'volatile' ELSE 'stable' END AS direction FROM s WHERE n >= 3""")
def agg_trends(spark: SparkSession, sf: str) -> DataFrame:
    df = quality.trends(quality.assessed(six(spark, sf)), ["o_custkey"], ["timestamp", "id"], "overall_score", 30)
    return df.select("o_custkey", "n_samples", *[r6(F.col(c)).alias(c) for c in ("slope", "confidence", "volatility", "change_rate")], "direction")


@q(f"""WITH {SIX} SELECT o_custkey, id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY timestamp DESC, id DESC) AS n FROM a) WHERE n <= 5""")
def win_history_cap(spark: SparkSession, sf: str) -> DataFrame:
    return quality.last_rows(six(spark, sf), ["o_custkey"], [F.desc("timestamp"), F.desc("id")], 5).select("o_custkey", "id")


@q(f"""WITH {SIX} SELECT grp, round(arg_max(o, (timestamp, id)) - arg_min(o, (timestamp, id)), 6)::DOUBLE AS change FROM a GROUP BY grp""")
def win_accuracy_trend(spark: SparkSession, sf: str) -> DataFrame:
    at = F.struct("timestamp", "id")
    return quality.assessed(six(spark, sf)).groupBy("grp").agg(r6(F.max_by("overall_score", at) - F.min_by("overall_score", at)).alias("change"))


@q(f"""WITH {SIX}, h AS (SELECT o_custkey, o, CASE WHEN o >= 0.95 THEN 'A+' WHEN o >= 0.9 THEN 'A' WHEN o >= 0.85 THEN 'B+' WHEN o >= 0.8 THEN 'B' WHEN o >= 0.7 THEN 'C+' WHEN o >= 0.6 THEN 'C' ELSE 'F' END AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY timestamp DESC, o DESC) AS n FROM a)
       SELECT o_custkey, count(*) AS n_history, string_agg(g, ',' ORDER BY n) AS grades FROM h WHERE n <= 100 GROUP BY o_custkey""")
def agg_quality_export(spark: SparkSession, sf: str) -> DataFrame:
    h = quality.analytics(quality.assessed(six(spark, sf)), ["o_custkey"])
    return h.select("o_custkey", F.size("history").cast("long").alias("n_history"), F.array_join(F.col("history.grade"), ",").alias("grades"))


# Metrics ------------------------------------------------------------------


@q("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n, (user_id % 10 <> 0)::INT AS ok FROM events)
      SELECT event_type, count(*) AS total_operations, CAST(sum(ok) AS BIGINT) AS success_count, round(avg(ok), 6)::DOUBLE AS success_rate, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value,
             max(CASE WHEN r = n // 2 THEN value END) AS p50_value, max(CASE WHEN r = CAST(floor(n * 0.95) AS BIGINT) THEN value END) AS p95_value FROM x GROUP BY event_type""")
def agg_latency(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.latency_summary(t(spark, sf, "events"), ["event_type"], "value", F.col("user_id") % 10 != 0)
    return df.withColumns({"success_rate": r6(F.col("success_rate")), "avg_value": r6(F.col("avg_value"))}).drop("error_count")


@q("""SELECT event_type, count(*) AS n_runs, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(stddev_samp(value), 6) AS stdev_value,
             avg(value) > 40 * 1.5 AS regression FROM events GROUP BY event_type""")
def agg_run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.run_statistics(t(spark, sf, "events"), ["event_type"], "value")
    df = df.withColumn("regression", metrics.is_regression(F.col("mean_value"), F.lit(40.0)))
    return df.withColumns({c: r6(F.col(c)) for c in ("mean_value", "median_value", "stdev_value")})


@q("""WITH w AS (SELECT event_id, avg(value) OVER a AS x, avg(value) OVER b AS y, count(*) OVER c AS n FROM events
        WINDOW a AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), c AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
      SELECT event_id, round(CASE WHEN n = 10 THEN y - x END, 6) AS increase FROM w""")
def win_leak(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.leak(t(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value")
    return df.select("event_id", r6(F.col("increase")).alias("increase"))


@q("""WITH w AS (SELECT event_type, value, row_number() OVER o AS r, (value > lag(value) OVER o)::INT AS up FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id))
      SELECT event_type, round(avg(up), 6)::DOUBLE AS rising_share, round(arg_max(value, r) - arg_min(value, r), 6) AS total_growth, avg(up) > 0.8 AND arg_max(value, r) - arg_min(value, r) > 50 AS leaking FROM w GROUP BY event_type""")
def win_growth(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.growth(t(spark, sf, "events"), ["event_type"], ["ts", "event_id"], "value", 50)
    return df.withColumns({"rising_share": r6(F.col("rising_share")), "total_growth": r6(F.col("total_growth"))})


@q("""SELECT event_id, CASE WHEN value % 100 > 95 THEN 'critical' WHEN value % 100 > 90 THEN 'warning' WHEN event_type = 'error' THEN 'degraded' ELSE 'healthy' END AS health,
             CASE WHEN value % 100 >= 85 THEN 'critical' WHEN value % 100 >= 70 THEN 'warning' ELSE 'ok' END AS memory FROM events""")
def sf_health(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("value") % 100
    return t(spark, sf, "events").select("event_id", metrics.health(F.when(F.col("event_type") == "error", 0.9).otherwise(0.1), p).alias("health"), metrics.memory_status(p, F.lit(100.0)).alias("memory"))


@q("""SELECT event_type, m.name AS metric, count(m.v) AS n, round(sum(m.v) / count(m.v), 6)::DOUBLE AS mean, min(m.v) AS low, max(m.v) AS high
      FROM (SELECT event_type, unnest(['value', 'user']) AS name, unnest([value, user_id::DOUBLE]) AS v FROM events) m GROUP BY event_type, m.name""")
def agg_per_metric(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("user", F.col("user_id").cast("double"))
    long = e.unpivot(["event_type"], ["value", "user"], "metric", "v")
    return long.groupBy("event_type", "metric").agg(F.count("v").alias("n"), r6(metrics.ratio(F.sum("v"), F.count("v"))).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


MESSAGES = ["connection timeout", "HTTP 429", "rate limit exceeded", "Unauthorized", "CUDA oom", "schema mismatch", "setup missing", "strange"]
CATEGORY = """CASE event_id % 8 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'unknown' WHEN 3 THEN 'authentication' WHEN 4 THEN 'resource_exhausted' WHEN 5 THEN 'validation_error' WHEN 6 THEN 'configuration_error' ELSE 'unknown' END"""


@q(f"""SELECT {CATEGORY} AS category, count(*) AS n_errors, CAST(sum((event_id % 8 NOT IN (3, 5, 6))::INT) AS BIGINT) AS n_retryable FROM events GROUP BY 1""")
def sf_error_categories(spark: SparkSession, sf: str) -> DataFrame:
    m = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 8).cast("int"))
    e = t(spark, sf, "events").select(metrics.classify(m, F.lit("RuntimeError")).alias("c"))
    return e.groupBy(F.col("c.category").alias("category")).agg(F.count("*").alias("n_errors"), F.sum(F.col("c.is_retryable").cast("long")).alias("n_retryable"))


@q("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(pow(2, event_id % 9), 60) WHEN 1 THEN least(event_id % 9 + 1, 60) ELSE 1 END::DOUBLE AS delay, greatest(CASE event_id % 3 WHEN 0 THEN least(pow(2, event_id % 9), 60) WHEN 1 THEN event_id % 9 + 1 ELSE 1 END, 15)::DOUBLE AS with_recovery FROM events""")
def sf_retry_delay(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    s = F.get(F.array(*map(F.lit, ["exponential_backoff", "linear_backoff", "fixed_delay"])), (k % 3).cast("int"))
    n = (k % 9 + 1).cast("double")
    return t(spark, sf, "events").select("event_id", metrics.retry_delay(s, n).cast("double").alias("delay"), metrics.retry_delay(s, n, recovery=F.lit(30.0)).cast("double").alias("with_recovery"))


@q("""SELECT event_type, event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND event_type = 'error'""")
def str_due_actions(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").where("event_type = 'error'").withColumn("execute_at", F.col("ts"))
    return metrics.due(e, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_type", "event_id", "ts")


@q("""SELECT quality AS category, count(*) AS n, CAST(sum((quality = 1 AND toxic = 0)::INT) AS BIGINT) AS tp, CAST(sum((quality = 0 AND toxic = 0)::INT) AS BIGINT) AS fp, CAST(sum((quality = 1 AND toxic = 1)::INT) AS BIGINT) AS fn, CAST(sum((quality = 0 AND toxic = 1)::INT) AS BIGINT) AS tn FROM labels GROUP BY quality""")
def agg_confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    label = t(spark, sf, "labels").withColumn("category", F.col("quality"))
    c = metrics.confusion(label, ["category"], F.col("quality") == 1, F.col("toxic") == 0)
    return c.select("category", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "tp", "fp", "fn", "tn")


@q("""WITH c AS (SELECT sum((quality = 1 AND toxic = 0)::INT) AS tp, sum((quality = 0 AND toxic = 0)::INT) AS fp, sum((quality = 1 AND toxic = 1)::INT) AS fn, count(*) AS n FROM labels)
      SELECT round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall, round((n - fp - fn) / n, 6)::DOUBLE AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c""")
def agg_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.confusion(t(spark, sf, "labels"), [], F.col("quality") == 1, F.col("toxic") == 0)
    return c.select(*[r6(F.col(x)).alias(x) for x in ("precision", "recall", "accuracy", "f1")])


@q("""WITH r AS (SELECT lang, doc_id % 10 <> 0 AS ok, doc_id % 4 + 1 AS e, doc_id % 3 + 1 AS g FROM documents), s AS (SELECT lang, ok, e = g AS m, 0.4 * ok::INT + 0.3 * least(e, g) / greatest(e, g) + 0.2 AS s FROM r)
      SELECT lang, CAST(sum((ok AND m)::INT) AS BIGINT) AS tp, CAST(sum((ok AND NOT m)::INT) AS BIGINT) AS fp, CAST(sum((NOT ok)::INT) AS BIGINT) AS fn, round(avg(s), 6)::DOUBLE AS mean_score FROM s GROUP BY lang""")
def agg_accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    d, k = t(spark, sf, "documents"), F.col("doc_id")
    e, g = (k % 4 + 1), (k % 3 + 1)
    r = d.select("lang", (k % 10 != 0).alias("conversion_success"), (e == g).alias("page_count_match"), metrics.document_score(k % 10 != 0, e, g, F.lit(1.0), F.lit(0.0)).alias("overall_score"))
    return metrics.accuracy_report(r, ["lang"]).select("lang", "tp", "fp", "fn", r6(F.col("mean_score")).alias("mean_score"))


MODEL_SQL = """m(client, rank, most, cost, factor, docs) AS (VALUES ('CustomGPT5', 3, 10, 0.030, 2.0, true), ('CustomGPT5Mini', 2, 5, 0.005, 1.5, true), ('CustomOpus4', 3, 8, 0.025, 1.8, true), ('CustomSonnet4', 2, 6, 0.015, 1.6, true), ('CustomHaiku', 1, 4, 0.003, 1.2, false)),
r AS (SELECT p_partkey, CAST(p_size % 12 + 1 AS INTEGER) AS images, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS need FROM part),
x AS (SELECT *, (cost + cost * factor * images)::DOUBLE AS price FROM r JOIN m ON images <= most AND rank >= need)"""


def model_requests(spark: SparkSession, sf: str) -> DataFrame:
    level = F.get(F.array(*map(F.lit, ["simple", "moderate", "complex"])), (F.col("p_partkey") % 3).cast("int"))
    return t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 12 + 1).alias("images"), level.alias("complexity"))


@q(f"""WITH {MODEL_SQL} SELECT p_partkey, client, round(price, 6) AS estimated_cost FROM x""")
def flt_model_requirements(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.suitable(model_requests(spark, sf), metrics.models(spark))
    return x.select("p_partkey", "client", r6(F.col("estimated_cost")).alias("estimated_cost"))


@q(f"""WITH {MODEL_SQL} SELECT p_partkey, arg_min(client, price) AS cheapest FROM x GROUP BY p_partkey""")
def top_cheapest_model(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cheapest(metrics.suitable(model_requests(spark, sf), metrics.models(spark)), ["p_partkey"]).select("p_partkey", "cheapest")


@q(f"""WITH {MODEL_SQL}, a AS (SELECT client, (cost + cost * factor * 3)::DOUBLE AS price, rank >= 2 AS ok, docs FROM m) SELECT client, CAST(row_number() OVER (ORDER BY ok DESC, price, docs DESC) AS INTEGER) AS rank FROM a""")
def top_cost_effectiveness(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.models(spark).withColumns({"price": metrics.cost(F.col("cost"), F.col("image_factor"), F.lit(3)), "ok": F.col("capability_rank") >= 2})
    return m.select("client", F.row_number().over(Window.orderBy(F.desc("ok"), "price", F.desc("for_documents"))).alias("rank"))  # five rows


@q("""SELECT * FROM (VALUES ('CustomGPT5', 1, 'CustomOpus4'), ('CustomGPT5', 2, 'CustomSonnet4'), ('CustomGPT5', 3, 'CustomHaiku'), ('CustomGPT5Mini', 1, 'CustomSonnet4'), ('CustomGPT5Mini', 2, 'CustomHaiku'),
      ('CustomOpus4', 1, 'CustomSonnet4'), ('CustomOpus4', 2, 'CustomHaiku'), ('CustomSonnet4', 1, 'CustomHaiku')) v(client, step, fallback)""")
def sch_fallback_chains(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fallback_chains(metrics.models(spark))


@q("""SELECT p_partkey, CAST(floor(448 * (p_size / (p_size + 7))) AS INTEGER) AS width, 448 AS height, CAST(least(greatest(1, floor(500 / ((8.27 * 300) * (11.69 * 300) * 3 / 1048576))), p_size) AS INTEGER) AS batch FROM part""")
def sf_geometry(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("p_size")
    size = fn.fitted(w, w + 7, 448, 448)
    return t(spark, sf, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), fn.page_batch(F.lit(300), w, 500.0).alias("batch"))


# Search -------------------------------------------------------------------

SCORE = "list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i]))"
NORM = "sqrt(list_sum(list_transform({0}.vector, lambda x: x * x)))"
TOP = f"""WITH {POINTS}, n AS (SELECT a.*, {NORM.format('a')} AS n FROM points a),
  s AS (SELECT b.id AS query_id, a.id, {SCORE} / (a.n * b.n) AS score FROM n a, n b WHERE b.id % 100 = 0 :where),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0)
  SELECT query_id, id, round(score, 5) AS score FROM r WHERE rank <= :k"""


def hundredth(points: DataFrame) -> DataFrame:
    return points.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


@q(TOP.replace(":where", "").replace(":k", "10"))
def top_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    p = stored_points(spark, sf)
    return search.top_k(p, hundredth(p), 10).select("query_id", "id", F.round("score", 5).alias("score"))


@q(TOP.replace(":where", "AND a.document_type = 'pdf' AND a.patch_x BETWEEN 0 AND 64 AND a.patch_y BETWEEN 0 AND 64").replace(":k", "20"))
def top_region_search(spark: SparkSession, sf: str) -> DataFrame:
    p = stored_points(spark, sf)
    where = search.payload_filter({"document_type": "pdf", "spatial_box": [0, 0, 64, 64]})
    return search.top_k(p, hundredth(p), 20, where=where).select("query_id", "id", F.round("score", 5).alias("score"))


@q(f"""WITH {POINTS}, n AS (SELECT a.*, {NORM.format('a')} AS n FROM points a),
  s AS (SELECT b.label AS query_id, a.document_id AS id, b.id AS qi, max({SCORE} / (a.n * b.n)) AS best FROM n a, n b WHERE b.id % 50 = 0 GROUP BY b.label, a.document_id, b.id),
  t AS (SELECT query_id, id, sum(best) AS score FROM s GROUP BY query_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t)
  SELECT query_id, id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def top_late_interaction(spark: SparkSession, sf: str) -> DataFrame:
    p = stored_points(spark, sf)
    pages = p.select(F.col("document_id").alias("id"), F.col("patch_index").alias("vec_idx"), "vector")
    asked = p.where("id % 50 = 0").select(F.col("label").alias("query_id"), F.col("id").alias("q_idx"), F.col("vector").alias("query_vector"))
    return search.max_sim(pages, asked, 5).select("query_id", "id", F.round("score", 5).alias("score"))


@q(f"""WITH {POINTS} SELECT document_id || '#' || page_number AS query_id, len(arg_min(vector, patch_index)) AS dim FROM points GROUP BY document_id, page_number""")
def top_first_patches(spark: SparkSession, sf: str) -> DataFrame:
    return search.first_patches(stored_points(spark, sf)).select("query_id", F.size("query_vector").cast("long").alias("dim"))


@q(f"""WITH {POINTS} SELECT document_id, count(*) AS points_count, round(count(*) * 64 * 4 / 1048576.0, 2)::DOUBLE AS estimated_vector_size_mb, round(count(*) * 0.5, 2)::DOUBLE AS estimated_payload_size_mb, 'healthy' AS collection_health FROM points GROUP BY document_id""")
def agg_storage(spark: SparkSession, sf: str) -> DataFrame:
    return search.storage(stored_points(spark, sf), ["document_id"]).select("document_id", "points_count", "estimated_vector_size_mb", "estimated_payload_size_mb", "collection_health")


@q("""SELECT doc_id, CAST(i AS INTEGER) AS patch_index, CAST(i % g * 32 AS INTEGER) AS patch_x, CAST(i // g * 32 AS INTEGER) AS patch_y
      FROM (SELECT doc_id, doc_id % 7 + 1 AS n, CAST(ceil(sqrt(doc_id % 7 + 1)) AS BIGINT) AS g FROM documents), unnest(range(n)) u(i)""")
def prj_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of pages with 1 to 7 patches each, on their grid."""
    k = F.col("doc_id")
    vectors = F.transform(F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda i: F.array(i.cast("float"), F.lit(1.0).cast("float")))
    pages = t(spark, sf, "documents").select(k.cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.lit("pdf").alias("document_type"), F.lit("2024").alias("processing_timestamp"), vectors.alias("vectors"))
    return search.points_of(pages, F.lit("2024-02-01")).select(F.col("document_id").cast("long").alias("doc_id"), "patch_index", "patch_x", "patch_y")


@q("""SELECT event_type, CASE WHEN avg(value) / 10000 < 0.01 THEN 'excellent' WHEN avg(value) / 10000 < 0.05 THEN 'good' WHEN avg(value) / 10000 < 0.1 THEN 'acceptable' WHEN avg(value) / 10000 < 0.5 THEN 'slow' ELSE 'poor' END AS rating FROM events GROUP BY event_type""")
def agg_search_rating(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy("event_type").agg(search.rating(F.avg("value") / 10000).alias("rating"))


@q(f"""WITH {POINTS}, n AS (SELECT a.*, {NORM.format('a')} AS n FROM points a), f AS (SELECT document_id || '#' || page_number AS query_id, arg_min(vector, patch_index) AS vector FROM points GROUP BY document_id, page_number),
  b AS (SELECT *, {NORM.format('f')} AS n FROM f), s AS (SELECT b.query_id, a.id, {SCORE} / (a.n * b.n) AS score FROM n a, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.7)
  SELECT query_id, id, round(score, 5) AS score FROM r WHERE rank <= 10""")
def top_patch_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """One query for each page, its first patch: the ten best patches over 0.7."""
    p = stored_points(spark, sf)
    return search.top_k(p, search.first_patches(p), 10, 0.7).select("query_id", "id", F.round("score", 5).alias("score"))


@q(TOP.replace(":where", "").replace(":k", "10").replace("SELECT query_id, id, round(score, 5) AS score FROM r WHERE rank <= 10", "SELECT r.query_id, r.id, CAST(rank AS INTEGER) AS rank, document_id, page_number, patch_x || ',' || patch_y AS patch_coordinates FROM r JOIN points USING (id) WHERE rank <= 10"))
def prj_search_results(spark: SparkSession, sf: str) -> DataFrame:
    """What the search finds for every hundredth point, with the points' payloads."""
    p = stored_points(spark, sf)
    found = search.results(search.top_k(p, hundredth(p), 10), p)
    return found.select("query_id", "id", "rank", "document.document_id", "document.page_number", "spatial.patch_coordinates")


# Groups and sets ----------------------------------------------------------


@q("""SELECT coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END, 'UNKNOWN') AS port, count(*) AS n FROM documents GROUP BY 1""")
def agg_group_count(spark: SparkSession, sf: str) -> DataFrame:
    port = F.coalesce(F.when(F.col("doc_id") % 9 != 0, F.col("source")), F.lit("UNKNOWN"))
    return t(spark, sf, "documents").groupBy(port.alias("port")).agg(F.count("*").alias("n")).orderBy("port")


@q("""SELECT l_orderkey, count(*) AS n_rows, max(l_linenumber) AS reported, count(*) <> max(l_linenumber) AS differs FROM lineitem GROUP BY l_orderkey""")
def agg_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.max("l_linenumber").alias("reported"))
    return g.withColumn("differs", F.col("n_rows") != F.col("reported"))


@q("""SELECT coalesce(l_returnflag, 'total') AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def agg_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).select(F.coalesce("l_returnflag", F.lit("total")).alias("flag"), "n", "quantity")


@q("""SELECT c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    c, s = t(spark, sf, "customer"), t(spark, sf, "supplier")
    return c.select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind")).unionByName(s.select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind")))


@q("""SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 AND c_nationkey % 5 > 0)""")
def set_missing(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").where("c_acctbal > 9000 and c_nationkey % 5 > 0")
    return t(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select("n_nationkey")


@q("""SELECT DISTINCT lang, source FROM documents""")
def set_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("lang", "source").distinct()


# Streams ------------------------------------------------------------------


@q("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def str_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tumbling(t(spark, sf, "events"), "ts", "1 hour", "2 hours", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@q("""WITH s AS (SELECT *, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
      SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def str_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sessions(t(spark, sf, "events"), "ts", "30 minutes", "2 hours", ["user_id"], F.count("*").alias("n"))


@q("""SELECT doc_id, length(text) AS result FROM documents""")
def str_memoised(spark: SparkSession, sf: str) -> DataFrame:
    """A function with a cache that already holds a third of the inputs."""
    d = t(spark, sf, "documents").select("doc_id", "text")
    run = lambda x: x.select("_key", F.char_length("text").alias("result"))
    _, cache = jobs.memoised(d.where("doc_id % 3 = 0"), None, F.col("text"), run)
    out, _ = jobs.memoised(d, cache, F.col("text"), run)
    return out.select("doc_id", "result")


@q(None)
def str_circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return jobs.breaker(e.select(F.concat(F.lit("c"), F.col("user_id") % 20).alias("circuit"), "event_id", seconds.alias("at"), (F.col("value") > 20).alias("ok")))


@q("""WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  s AS (SELECT user_id, n, CASE WHEN failed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, CASE WHEN e.failed THEN s.rate + 1 ELSE s.rate * 0.9::DOUBLE END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
  SELECT user_id, round(arg_max(rate, n), 6) AS error_rate FROM s GROUP BY user_id""")
def win_error_decay(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    return metrics.decayed(e, ["user_id"], ["ts", "event_id"], "failed").withColumn("error_rate", F.round("error_rate", 6))


# Schemas ------------------------------------------------------------------

INVOICE = {
    "title": "invoice-record", "type": "object", "required": ["number", "total"],
    "properties": {
        "number": {"type": "string"}, "total": {"type": "number"}, "paid": {"type": "boolean"},
        "vendor": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "address": {"type": "object", "properties": {"city": {"type": "string"}}}}},
        "line_items": {"type": "array", "items": {"type": "object", "properties": {"item": {"type": "string"}, "qty": {"type": "integer"}}}},
        "tags": {"type": "array"}, "class": {"type": "null"},
    },
}


@q("""SELECT * FROM (VALUES ('InvoiceRecord', 'number', 'string', false), ('InvoiceRecord', 'total', 'float', false), ('InvoiceRecord', 'paid', 'bool', true), ('InvoiceRecord', 'vendor', 'Vendor', true),
      ('InvoiceRecord', 'line_items', 'LineItemsItem[]', true), ('InvoiceRecord', 'tags', 'string[]', true), ('InvoiceRecord', 'class', 'string', true), ('Vendor', 'name', 'string', false), ('Vendor', 'address', 'Address', true),
      ('Address', 'city', 'string', true), ('LineItemsItem', 'item', 'string', true), ('LineItemsItem', 'qty', 'int', true)) v(class_name, field_name, field_type, optional)""")
def sch_compiled_fields(spark: SparkSession, sf: str) -> DataFrame:
    return plans.fields(INVOICE, spark)


@q("""SELECT * FROM (VALUES ('error', 'MISSING_ARRAY_ITEMS', '$.properties.tags.items'), ('error', 'UNSUPPORTED_TYPE', '$.properties.class.type'), ('warning', 'RESERVED_KEYWORD_PROPERTY', '$.properties.class')) v(severity, code, field_path)""")
def sch_issues(spark: SparkSession, sf: str) -> DataFrame:
    return plans.validated(INVOICE).table(spark).select("severity", "code", "field_path")


@q("""SELECT o_orderkey, 'INV-' || o_orderkey AS number, round(o_totalprice, 2) AS total FROM orders""")
def sch_typed_read(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON, read with the schema that a JSON schema compiles to."""
    kind = plans.compiled({"type": "object", "required": ["number"], "properties": {"number": {"type": "string"}, "total": {"type": "number"}}})
    o = t(spark, sf, "orders")
    body = F.to_json(F.struct(F.concat(F.lit("INV-"), F.col("o_orderkey")).alias("number"), F.round("o_totalprice", 2).alias("total")))
    return o.select("o_orderkey", F.from_json(body, kind).alias("r")).select("o_orderkey", "r.*")


# Model calls ----------------------------------------------------------------

ANSWER_SCHEMA = {"title": "answer", "type": "object", "required": ["number", "vendor"], "properties": {"number": {"type": "string"}, "vendor": {"type": "string"}}}


@q("""SELECT doc_id AS document_id, doc_id % 10 <> 0 AS success, doc_id % 3 = 0 AND doc_id % 10 <> 0 AS fallback_applied, CASE WHEN doc_id % 10 = 0 THEN 'timeout' END AS category,
             CAST(CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_missing FROM documents""")
def run_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through two stand-in models: the first fails on every third, both on every tenth."""

    def first(pages: list[bytes], prompt: str) -> str:
        n = int(pages[0].split(b"|")[0])
        if n % 3 == 0 or n % 10 == 0:
            raise RuntimeError("connection timeout")
        return extract.stub(["number", "vendor"])(pages, prompt)

    def second(pages: list[bytes], prompt: str) -> str:
        if int(pages[0].split(b"|")[0]) % 10 == 0:
            raise RuntimeError("connection timeout")
        return extract.stub(["number", "vendor"])(pages, prompt)

    d = t(spark, sf, "documents")
    pages = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.concat_ws("|", "doc_id", "text").cast("binary").alias("image"))
    out = extract.process(pages, ANSWER_SCHEMA, {"a": first, "b": second}, ["a", "b"], F.lit("2024-01-15 10:30:00"))
    missing = out["issues"].where("issue_type = 'required_fields'").groupBy(F.col("processing_id").cast("long").alias("document_id")).agg(F.count("*").alias("n_missing"))
    errors = out["errors"].select("document_id", F.col("handling.category").alias("category"))
    answers = out["answers"].select("document_id", "success", "fallback_applied")
    return answers.join(errors, "document_id", "left").join(missing, "document_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0).cast("long")))


@q("""SELECT event_type, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS cold_seconds, round(avg(CASE WHEN event_id % 3 = 1 THEN value END), 6) AS warm_seconds,
             round(sum(CASE WHEN event_id % 3 = 2 THEN value END) / sum(CASE WHEN event_id % 3 = 2 THEN 4 END), 6) AS batch_seconds_per_image FROM events GROUP BY event_type""")
def sta_inference_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.get(F.array(*map(F.lit, ["cold", "warm", "batch"])), (F.col("event_id") % 3).cast("int"))
    e = t(spark, sf, "events").select("event_type", kinds.alias("kind"), F.col("value").alias("seconds"), F.lit(4).alias("images"))
    b = metrics.inference_benchmark(e, ["event_type"])
    return b.select("event_type", *[r6(F.col(c)).alias(c) for c in ("cold_seconds", "warm_seconds", "batch_seconds_per_image")])


@q("""SELECT p_partkey, 3 AS n_fields, round(0.8 * CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 1 END, 6)::DOUBLE AS confidence, CASE WHEN p_size % 5 = 0 THEN 'CustomGPT5' WHEN p_size % 3 = 0 THEN 'CustomHaiku' WHEN p_size % 3 = 1 THEN 'CustomSonnet4' ELSE 'CustomOpus4' END AS client FROM part""")
def agg_field_confidences(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    c = metrics.same_confidence(F.array(*map(F.lit, "abc")), 0.8 * F.when(size % 2 == 0, 0.9).otherwise(1.0))
    level = F.get(F.array(*map(F.lit, ["simple", "moderate", "complex"])), size % 3)
    client = metrics.suggested_client(level, F.when(size % 5 == 0, "CustomGPT5"))
    return t(spark, sf, "part").select("p_partkey", F.size(c).alias("n_fields"), r6(F.element_at(c, "b")).alias("confidence"), client.alias("client"))


@q("""SELECT user_id, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id""")
def agg_memory_history(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.latency_summary(t(spark, sf, "events"), ["user_id"], "value", F.lit(True))
    low, high = F.col("min_value"), F.col("max_value")
    return s.select("user_id", F.col("total_operations").alias("n"), r6(low).alias("low"), r6(high).alias("high"), r6(F.col("avg_value")).alias("mean"), r6(high - low).alias("spread"))


@q("""SELECT doc_id, array_to_string(list_sort(list_filter(['document_id', 'page_number', 'document_type', 'processing_timestamp'], lambda x: x <> CASE doc_id % 3 WHEN 0 THEN 'document_id' WHEN 1 THEN 'page_number' ELSE '' END)), ',') AS missing FROM documents""")
def set_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Required payload keys that a record lacks, as a set difference."""
    need = F.array(*map(F.lit, search.REQUIRED_PAYLOAD))
    have = F.array(F.when(F.col("doc_id") % 3 == 0, "document_id").when(F.col("doc_id") % 3 == 1, "page_number").otherwise(""))
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_except(need, have)), ",").alias("missing"))


@q("""SELECT doc_id, CAST(doc_id % 3 + 1 AS INTEGER) AS pages, 'Doc ' || doc_id AS title, 612.0::DOUBLE AS width, '2024-01-15T10:30:00' AS created FROM documents""")
def src_pdf_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    body = F.concat(F.lit("%PDF-1.4 /Title (Doc "), k, F.lit(") /CreationDate (D:20240115103000Z) /MediaBox [0 0 612 792] "), F.repeat(F.lit("<< /Type /Page >> "), (k % 3 + 1).cast("int")), F.lit("/Type /Pages"))
    m = t(spark, sf, "documents").select("doc_id", fn.pdf_metadata(body.cast("binary")).alias("m"))
    return m.select("doc_id", F.col("m.page_count").alias("pages"), "m.title", "m.dimensions.width", F.col("m.creation_date").alias("created"))


@q("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CAST(doc_id % 200 + 1 AS INTEGER) END AS width, CASE WHEN doc_id % 3 < 2 THEN 7 END AS height FROM documents""")
def src_image_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    b = F.lpad(F.hex(k % 200 + 1), 2, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452000000"), b, F.lit("00000007"))
    gif = F.concat(F.lit("474946383961"), b, F.lit("000700"))
    content = F.unhex(F.when(k % 3 == 0, png).when(k % 3 == 1, gif).otherwise("FFD8FF"))
    d = t(spark, sf, "documents").select("doc_id", fn.image_dimensions(content).alias("d"))
    return d.select("doc_id", "d.width", "d.height")


from docloom import queries_images, queries_storage  # noqa: E402, F401  register their queries
