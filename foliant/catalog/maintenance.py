"""Keyed tables: lookups, changes, ordering and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog.base import query, table
from foliant.functions.text import command_args, command_name
from foliant.operators import filters, keyed, listings, tables
from foliant.plans.sizing import scratch_path

NOW = "2024-02-01 00:00:00"
STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

# ---- projections and lookups -------------------------------------------------------------------


@query("p1_list_titles", "SELECT p_partkey AS id, p_name AS title FROM part ORDER BY id")
def p1_list_titles(spark, sf_dir):
    return tables.list_titles(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(
    "p2_get_by_id",
    r"""WITH r AS (SELECT CAST(event_id AS VARCHAR) AS asked FROM events UNION ALL SELECT event_type FROM events
               UNION ALL SELECT '-' || event_id FROM events)
    SELECT doc_id, text FROM documents
    WHERE doc_id IN (SELECT CAST(asked AS BIGINT) FROM r WHERE regexp_matches(asked, '^[0-9]+$'))""",
)
def p2_get_by_id(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    asked = events.select(
        F.explode(
            F.array(
                F.col("event_id").cast("string"),
                "event_type",
                F.concat(F.lit("-"), F.col("event_id").cast("string")),
            )
        ).alias("asked")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return filters.get_by_id(docs, "doc_id", asked, "asked")


@query(
    "p3_exists_key",
    "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer",
)
def p3_exists_key(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select("c_custkey")
    return filters.exists_key(probes, "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "p4_filter_types",
    "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click')",
)
def p4_filter_types(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return filters.filter_types(events, "event_type", ["view", "click"])


# Values are blank where the cleaned text is: labels and digits make some of them so.
BLANKED_SQL = r"""SELECT conv_id, turn, regexp_replace(role, '^user$', '  ') AS title,
    CASE WHEN starts_with(text, 'T') THEN chr(10) || chr(9) ELSE text END AS content FROM conversations"""


def blanked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.regexp_replace("role", "^user$", "  ").alias("title"),
        F.when(F.startswith("text", F.lit("T")), F.lit("\n\t")).otherwise(F.col("text")).alias("content"),
    )


@query(
    "p5_drop_blank_any",
    rf"""WITH b AS ({BLANKED_SQL}) SELECT * FROM b
    WHERE {STRIPPED.format('title')} <> '' AND {STRIPPED.format('content')} <> ''""",
)
def p5_drop_blank_any(spark, sf_dir):
    return filters.drop_blank(blanked(spark, sf_dir), ["title", "content"], "any")


@query(
    "p5_drop_blank_all",
    rf"""WITH b AS ({BLANKED_SQL}) SELECT * FROM b
    WHERE {STRIPPED.format('title')} <> '' OR {STRIPPED.format('content')} <> ''""",
)
def p5_drop_blank_all(spark, sf_dir):
    return filters.drop_blank(blanked(spark, sf_dir), ["title", "content"], "all")


@query(
    "p8_allowed_values",
    """SELECT c_custkey, lower(trim(c_mktsegment)) AS c_mktsegment,
    lower(trim(c_mktsegment)) IN ('building', 'machinery') AS valid FROM customer""",
)
def p8_allowed_values(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return filters.allowed_values(customers, "c_mktsegment", ["building", "machinery"])


# ---- ordering ----------------------------------------------------------------------------------


@query(
    "o1_newest_first",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey",
)
def o1_newest_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return tables.newest_first(orders, "o_orderdate", "o_orderkey")


@query("o2_list_documents", "SELECT doc_id AS id, source AS title FROM documents ORDER BY id")
def o2_list_documents(spark, sf_dir):
    return tables.list_titles(table(spark, sf_dir, "documents"), "doc_id", "source")


@query("o3_limit_n", "SELECT doc_id, n_chars, text FROM documents ORDER BY n_chars, doc_id LIMIT 5")
def o3_limit_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    return tables.limit_n(docs, ["n_chars", "doc_id"], 5)


@query("o4_list_keys", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY s_suppkey")
def o4_list_keys(spark, sf_dir):
    return tables.list_keys(
        table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"]
    )


# ---- changes -----------------------------------------------------------------------------------


@query(
    "t2_insert_rows",
    """SELECT doc_id, text, CAST('2023-01-01' AS TIMESTAMP) AS created_at FROM documents
    UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY item_id), text,
    CAST('2024-02-01' AS TIMESTAMP) FROM benchmark""",
)
def t2_insert_rows(spark, sf_dir):
    old = F.lit("2023-01-01 00:00:00").cast("timestamp")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", old.alias("created_at"))
    fresh = table(spark, sf_dir, "benchmark")
    return tables.insert_rows(docs, "doc_id", fresh, ["item_id"], "created_at", F.lit(NOW).cast("timestamp"))


@query(
    "t3_insert_if_absent",
    """SELECT c_custkey, c_name FROM customer
    UNION ALL SELECT p_partkey, p_name FROM part
        WHERE p_partkey % 50 <> 0 AND p_partkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT NULL, p_name FROM part WHERE p_partkey % 50 = 0""",
)
def t3_insert_if_absent(spark, sf_dir):
    """Some new rows have no key, the others come twice under different names."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    part = table(spark, sf_dir, "part")
    parts = part.selectExpr("IF(p_partkey % 50 = 0, NULL, p_partkey) AS c_custkey", "p_name AS c_name")
    again = part.where("p_partkey % 50 <> 0").selectExpr("p_partkey AS c_custkey", "concat(p_name, '~') AS c_name")
    return tables.insert_if_absent(customers, "c_custkey", parts.unionByName(again))


@query(
    "t4_insert_unique",
    """WITH known AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    e AS (SELECT CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, event_id FROM events),
    f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e)
    SELECT user_id, event_id,
           user_id IS NULL OR (n = 1 AND user_id NOT IN (SELECT c_custkey FROM known)) AS accepted FROM f""",
)
def t4_insert_unique(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    batch = table(spark, sf_dir, "events").selectExpr("IF(event_id % 11 <> 0, user_id, NULL) AS user_id", "event_id")
    accepted, rejected = tables.insert_unique(
        known.select(F.col("c_custkey").alias("user_id")), "user_id", batch, "event_id"
    )
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False))
    )


@query(
    "t5_update_by_id",
    """SELECT d.doc_id, CASE WHEN b.item_id IS NULL THEN d.source ELSE 'edited' END AS title,
    CASE WHEN b.item_id IS NULL THEN d.text ELSE b.text END AS content
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def t5_update_by_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("content")
    )
    changes = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit("edited").alias("title"), F.col("text").alias("content")
    )
    earlier = changes.select("doc_id", F.lit("edit").alias("title"), F.lit("").alias("content"))
    return tables.update_by_id(docs, "doc_id", changes.unionByName(earlier))


@query(
    "t6_delete_by_key",
    """SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def t6_delete_by_key(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return tables.delete_by_key(customers, "c_custkey", urgent.withColumnRenamed("o_custkey", "c_custkey"))


@query(
    "t7_replace_group",
    """WITH fresh AS (SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber, o_totalprice AS l_quantity
                  FROM orders WHERE o_orderstatus = 'P')
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_orderkey NOT IN (SELECT l_orderkey FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def t7_replace_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"),
        F.col("o_totalprice").alias("l_quantity"),
    )
    return tables.replace_group(lines, "l_orderkey", fresh)


# ---- the same on tables kept in buckets ----------------------------------------------------------


def in_buckets(spark, sf_dir, rows, key):
    """``rows`` as a table of 64 buckets, opened again after it was made."""
    base = scratch_path(spark, "keyed")
    keyed.create_keyed(rows, base, key, 64)
    return keyed.open_keyed(spark, base)


@query(
    "t3_insert_buckets",
    """SELECT c_custkey, c_name FROM customer
    UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""",
)
def t3_insert_buckets(spark, sf_dir):
    """Parts under keys that no customer has are appended; no file of the customers is written again."""
    customers = in_buckets(spark, sf_dir, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("c_name"))
    return customers.add_absent(parts).rows()


@query(
    "t5_update_buckets",
    """SELECT d.doc_id, CASE WHEN b.item_id IS NULL THEN d.source ELSE 'edited' END AS title,
    CASE WHEN b.item_id IS NULL THEN d.text ELSE b.text END AS content
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def t5_update_buckets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    changes = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit("edited").alias("title"), F.col("text").alias("content")
    )
    kept = in_buckets(spark, sf_dir, docs, "doc_id")
    return kept.change(changes, lambda part: tables.update_by_id(part, "doc_id", changes)).rows()


@query(
    "t6_delete_buckets",
    """SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def t6_delete_buckets(spark, sf_dir):
    customers = in_buckets(spark, sf_dir, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.change(urgent, lambda part: tables.delete_by_key(part, "c_custkey", urgent)).rows()


@query(
    "t7_replace_buckets",
    """WITH fresh AS (SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber, o_totalprice AS l_quantity
                  FROM orders WHERE o_orderstatus = 'P')
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_orderkey NOT IN (SELECT l_orderkey FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def t7_replace_buckets(spark, sf_dir):
    """A group is a key: its bucket is rewritten, not a folder for each group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity")
    )
    kept = in_buckets(spark, sf_dir, lines, "l_orderkey")
    return kept.change(fresh, lambda part: tables.replace_group(part, "l_orderkey", fresh)).rows()


# ---- reports -----------------------------------------------------------------------------------


@query(
    "g2_affected_rows",
    """SELECT c_custkey AS o_custkey, count(o_orderkey) AS n_deleted,
    CASE WHEN count(o_orderkey) = 0 THEN 'not found' ELSE 'deleted' END AS status
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def g2_affected_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tables.affected_rows(orders, "o_custkey", gone)


@query(
    "g4_render_listing",
    """WITH n AS (SELECT p_brand, p_partkey, p_name,
               row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS no FROM part)
    SELECT p_brand, (no - 1) // 50 + 1 AS listing_page, count(*) AS n_lines,
           string_agg('ID: ' || p_partkey || ' | ' || p_name, chr(10) ORDER BY p_partkey) AS listing
    FROM n GROUP BY ALL""",
)
def g4_render_listing(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return listings.render_listing(parts, ["p_brand"], "p_partkey", "p_name", "ID: %d | %s", page_rows=50)


@query(
    "g4_empty_listing",
    """SELECT r_name, coalesce(string_agg(n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey), 'No records.') AS listing,
    1 AS listing_page, count(n_nationkey) AS n_lines
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 5 AND n_regionkey <> 2 GROUP BY r_name""",
)
def g4_empty_listing(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey > 5 AND n_regionkey <> 2")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    listing = listings.render_listing(named, ["r_name"], "n_nationkey", "n_name", "%d: %s")
    return listings.with_empty_message(regions, listing, ["r_name"], "No records.")


@query(
    "g5_throughput_stats",
    r"""WITH runs AS (SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS tokens,
                 count(*) - 1 AS seconds, any_value(role ORDER BY turn) AS role FROM conversations GROUP BY conv_id),
    t AS (SELECT role, seconds, CASE WHEN seconds > 0
             THEN CAST(round_even(CAST(tokens AS DOUBLE) / seconds, 2) AS DOUBLE) ELSE 0.0 END AS tps FROM runs)
    SELECT role, count(*) AS n_runs, CAST(round_even(avg(tps), 4) AS DOUBLE) AS avg_tps, max(tps) AS max_tps,
           CAST(sum(seconds) AS DOUBLE) AS total_time FROM t GROUP BY role""",
)
def g5_throughput_stats(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    runs = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.sum(words).alias("tokens"),
            (F.count(F.lit(1)) - 1).alias("seconds"),
            F.min_by("role", "turn").alias("role"),
        )
    )
    return listings.throughput_stats(runs, ["role"], "tokens", "seconds")


FIRST_WORD_SQL = rf"lower(split_part({STRIPPED.format('text')}, ' ', 1))"


@query(
    "s2_split_command",
    rf"""SELECT conv_id, turn, {FIRST_WORD_SQL} AS cmd,
    CASE WHEN contains(s, ' ') THEN substr(s, strpos(s, ' ') + 1) ELSE '' END AS args
    FROM (SELECT *, {STRIPPED.format('text')} AS s FROM conversations)""",
)
def s2_split_command(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", command_name(F.col("text")).alias("cmd"), command_args(F.col("text")).alias("args")
    )


@query(
    "j4_route_commands",
    rf"""WITH h AS (SELECT DISTINCT {FIRST_WORD_SQL} AS cmd FROM documents)
    SELECT conv_id, turn, {FIRST_WORD_SQL} AS cmd,
    CASE WHEN h.cmd IS NOT NULL THEN 'run ' || h.cmd END AS handler,
    CASE WHEN h.cmd IS NULL THEN 'Unknown command: ' || {FIRST_WORD_SQL} END AS output
    FROM conversations LEFT JOIN h ON h.cmd = {FIRST_WORD_SQL} WHERE {FIRST_WORD_SQL} <> ''""",
)
def j4_route_commands(spark, sf_dir):
    cmd = command_name(F.col("text")).alias("cmd")
    known = table(spark, sf_dir, "documents").select(cmd).distinct()
    handlers = known.withColumn("handler", F.concat(F.lit("run "), F.col("cmd")))
    routed = listings.route_commands(table(spark, sf_dir, "conversations"), "text", handlers)
    return routed.select("conv_id", "turn", "cmd", "handler", "output")
