"""Paging, dump import, table setup and the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog.base import corpus, derived_path, query, table
from foliant.functions import text
from foliant.operators import tables
from foliant.operators.filters import default_created, min_arity
from foliant.operators.snippets import tasks_for
from foliant.plans.sizing import scratch_path, spread
from foliant.sources import dumps, pages
from foliant.sources.index import open_or_build_index, path_exists, reload_index
from foliant.sources.media import list_media

# ---- pages -------------------------------------------------------------------------------------

PAGES_SQL = """ln AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    pg AS (SELECT doc_id, p + 1 AS page_num, array_to_string(lines[p * 5 + 1 : p * 5 + 5], chr(10)) AS content
           FROM ln, unnest(range(CAST(ceil(len(lines) / 5.0) AS BIGINT))) r(p))"""


@query("a1_paginate", f"WITH {PAGES_SQL} SELECT doc_id, page_num, content FROM pg")
def a1_paginate(spark, sf_dir):
    return pages.paginate(table(spark, sf_dir, "documents"), "doc_id", "text", 5)


@query(
    "a2_extraction_report",
    rf"""WITH {PAGES_SQL}, t AS (SELECT doc_id, count(*) AS n_pages,
        CAST(sum(length(regexp_replace(content, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS n_chars FROM pg GROUP BY doc_id)
    SELECT *, n_chars = 0 AS scanned FROM t""",
)
def a2_extraction_report(spark, sf_dir):
    return pages.extraction_report(a1_paginate(spark, sf_dir))


@query(
    "a5_reload_index",
    f"""WITH {PAGES_SQL} SELECT doc_id, page_num,
    len(list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda w: w <> '')) AS dl
    FROM pg""",
)
def a5_reload_index(spark, sf_dir):
    """The next search uses the new generation of the index, which is over pages of five lines instead of whole documents."""
    base = scratch_path(spark, "reloaded")
    open_or_build_index(spark, base, corpus(spark, sf_dir))
    reload_index(a1_paginate(spark, sf_dir), base)
    return open_or_build_index(spark, base, None).doc_stats()


# ---- dump import -------------------------------------------------------------------------------

# Posts made of documents: one language is no post type, another has an unreadable date, a third has none; every tenth
# post has nothing but white space.
POSTS_SQL = """src AS (SELECT doc_id, source AS author, CASE WHEN doc_id % 10 = 3 THEN chr(9) ELSE text END AS content,
    CASE WHEN doc_id % 10 = 3 THEN chr(10) ELSE text END AS title,
    CASE lang WHEN 'de' THEN '0000-00-00 00:00:00' WHEN 'fr' THEN '' ELSE '2024-01-05 10:00:00' END AS created,
    CASE lang WHEN 'es' THEN 'revision' WHEN 'fr' THEN 'page' ELSE 'post' END AS post_type FROM documents)"""
NOW = "2024-02-01 00:00:00"


def dump_path(spark, sf_dir):
    """A dump of the documents as posts, written by Spark once for each application."""
    path = derived_path(spark, sf_dir, "dump")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        docs = spread(table(spark, sf_dir, "documents"))
        lang, blank = F.col("lang"), F.col("doc_id") % 10 == 3
        created = F.when(lang == "de", "0000-00-00 00:00:00").when(lang == "fr", "").otherwise("2024-01-05 10:00:00")
        kind = F.when(lang == "es", "revision").when(lang == "fr", "page").otherwise("post")
        filled = {
            0: F.col("doc_id").cast("string"),
            dumps.AUTHOR_COL: text.quote_value(F.col("source")),
            dumps.DATE_COL: text.quote_value(created),
            dumps.CONTENT_COL: text.quote_value(F.when(blank, "\t").otherwise(F.col("text"))),
            dumps.TITLE_COL: text.quote_value(F.when(blank, "\n").otherwise(F.col("text"))),
            dumps.TYPE_COL: text.quote_value(kind),
        }
        values = [filled.get(i, F.lit("''")) for i in range(23)]
        dumps.write_sql_dump(docs, path, "wp_posts", values)
    return path


def dumped_tuples(spark, sf_dir):
    return dumps.read_sql_dump(spark, dump_path(spark, sf_dir), "wp_posts")


def dumped_posts(spark, sf_dir):
    return dumps.post_rows(dumped_tuples(spark, sf_dir), F.lit(NOW))


@query(
    "a6_read_sql_dump",
    f"""WITH {POSTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, author, content, title, post_type FROM src""",
)
def a6_read_sql_dump(spark, sf_dir):
    def value(i):
        return text.unquote_value(F.get("values", F.lit(i)))

    return dumped_tuples(spark, sf_dir).select(
        F.get("values", F.lit(0)).alias("id"),
        value(dumps.AUTHOR_COL).alias("author"),
        value(dumps.CONTENT_COL).alias("content"),
        value(dumps.TITLE_COL).alias("title"),
        value(dumps.TYPE_COL).alias("post_type"),
    )


@query(
    "a6_read_sql_dump_mixed",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents",
)
def a6_read_sql_dump_mixed(spark, sf_dir):
    """Lines that end in CR and LF, several statements on a line, and another table's rows between those asked for."""
    path = derived_path(spark, sf_dir, "mixed-dump")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        number = F.col("doc_id").cast("string")
        line = F.concat(
            F.lit("SET @x = 1; /* it's; */ INSERT INTO `other` VALUES ('no; rows', "), number, F.lit("); INSERT INTO `mixed` VALUES ("),
            number, F.lit(","), text.quote_value(F.col("text")), F.lit("); insert into `other` values ("), number, F.lit(",'neither')"),
        )
        docs = spread(table(spark, sf_dir, "documents"))
        docs.select(line.alias("value")).write.option("lineSep", ";\r\n").text(path)
    return dumps.read_sql_dump(spark, path, "mixed").select(
        F.get("values", F.lit(0)).alias("id"), text.unquote_value(F.get("values", F.lit(1))).alias("text")
    )


ACCEPTED_SQL = "post_type <> 'revision' AND doc_id % 10 <> 3"


@query(
    "a8_import_posts",
    f"""WITH {POSTS_SQL} SELECT row_number() OVER (ORDER BY doc_id) AS id, title, content, post_type,
    TRY_CAST(CASE WHEN created = '' THEN '{NOW}' ELSE created END AS TIMESTAMP) AS created_at,
    CASE WHEN created = '' THEN '{NOW}' ELSE created END AS created_text
    FROM src WHERE {ACCEPTED_SQL}""",
)
def a8_import_posts(spark, sf_dir):
    """Imported twice; the second run clears the table first, so each post is there once."""
    path = scratch_path(spark, "posts")
    posts = dumped_posts(spark, sf_dir)
    dumps.import_posts(posts, path)
    dumps.import_posts(posts, path, truncate=True)
    return spark.read.parquet(path)


@query(
    "g1_import_stats",
    f"""WITH {POSTS_SQL} SELECT
    count(*) FILTER ({ACCEPTED_SQL}) AS imported,
    count(*) FILTER (NOT ({ACCEPTED_SQL})) AS skipped,
    count(*) FILTER ({ACCEPTED_SQL} AND created = '0000-00-00 00:00:00') AS undated FROM src""",
)
def g1_import_stats(spark, sf_dir):
    return dumps.import_stats(dumped_posts(spark, sf_dir))


@query(
    "a7_list_media",
    """SELECT row_number() OVER (ORDER BY s_suppkey) AS ordinal, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS supplier
    FROM supplier WHERE s_suppkey % 3 <> 0""",
)
def a7_list_media(spark, sf_dir):
    """A file for each supplier, in folders; files of another kind among them are not listed."""
    path = derived_path(spark, sf_dir, "media")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
        files = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("of"), key).alias("k"), "s_name")
        files = files.repartition(tasks_for(files), "k")  # a small table's scan is one task, which would write all files
        files.where("s_suppkey % 3 = 0").select("k", "s_name").write.partitionBy("k").mode("append").csv(path)
        files.where("s_suppkey % 3 <> 0").select("k", "s_name").write.partitionBy("k").mode("append").text(path)
    listed = list_media(spark, path, "txt")
    return listed.select("ordinal", F.regexp_extract("path", "k=of([0-9]+)/", 1).alias("supplier"))


@query(
    "p6_min_arity",
    """SELECT doc_id, text FROM documents WHERE len(string_split(text, ' ')) >= 21""",
)
def p6_min_arity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", " ").alias("values"))
    return min_arity(docs, "values").drop("values")


@query(
    "p7_default_created",
    f"""SELECT doc_id, CASE WHEN lang = 'fr' OR lang = 'de' THEN '{NOW}' ELSE '2024-01-05 10:00:00' END AS created
    FROM documents""",
)
def p7_default_created(spark, sf_dir):
    given = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", None).otherwise("2024-01-05 10:00:00")
    created = default_created(given, F.lit(NOW))
    return table(spark, sf_dir, "documents").select("doc_id", created.alias("created"))


@query(
    "s4_unquote_value",
    r"""SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE replace(text, '\\', '\') END AS plain FROM documents""",
)
def s4_unquote_value(spark, sf_dir):
    """Literals in single quotes, in double quotes and NULL."""
    single = text.quote_value(F.col("text"))
    body = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    double = F.concat(F.lit('"'), body, F.lit('" '))
    literal = F.when(F.col("lang") == "de", "null ").when(F.col("lang") == "en", double).otherwise(single)
    return table(spark, sf_dir, "documents").select("doc_id", text.unquote_value(literal).alias("plain"))


TUPLES_SQL = """v AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
    generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""


@query(
    "s5_split_tuples",
    f"WITH {TUPLES_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, value FROM v",
)
def s5_split_tuples(spark, sf_dir):
    """A dump with one statement a document and one tuple a line, read back as tuples."""
    path = derived_path(spark, sf_dir, "lines-dump")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        row = F.transform(
            F.split("text", "\n"),
            lambda v: F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(" , "), text.quote_value(v), F.lit(")")),
        )
        statement = F.concat(F.lit("INSERT INTO `lines` VALUES\n"), F.array_join(row, ",\n"))
        docs = table(spark, sf_dir, "documents").select(statement.alias("value"))
        docs.write.option("lineSep", dumps.BREAK).text(path)
    tuples = dumps.read_sql_dump(spark, path, "lines")
    return tuples.select(
        F.get("values", F.lit(0)).alias("id"), text.unquote_value(F.get("values", F.lit(1))).alias("value")
    )


@query(
    "s6_split_values",
    f"""WITH {TUPLES_SQL}, c AS (SELECT doc_id, count(*) AS n_values,
        string_agg(value, '|' ORDER BY n) AS joined FROM v GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS id, n_values, joined FROM c""",
)
def s6_split_values(spark, sf_dir):
    """One tuple a document with its lines as values, and an empty last value that is dropped."""
    path = derived_path(spark, sf_dir, "values-dump")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        values = F.array_join(F.transform(F.split("text", "\n"), text.quote_value), " ,\n")
        statement = F.concat(
            F.lit("insert into `Docs` values ("), F.col("doc_id").cast("string"), F.lit(","), values, F.lit(", )")
        )
        docs = table(spark, sf_dir, "documents").select(statement.alias("value"))
        docs.write.option("lineSep", dumps.BREAK).text(path)
    tuples = dumps.read_sql_dump(spark, path, "docs")
    rest = F.slice("values", F.lit(2), F.size("values"))
    return tuples.select(
        F.get("values", F.lit(0)).alias("id"),
        F.size(rest).alias("n_values"),
        F.array_join(F.transform(rest, text.unquote_value), "|").alias("joined"),
    )


# ---- table setup -------------------------------------------------------------------------------


@query("t1_ensure_table", "SELECT c_custkey, c_name FROM customer")
def t1_ensure_table(spark, sf_dir):
    """Ensured twice around an insert: the second call must leave the rows alone."""
    path = scratch_path(spark, "ensured")
    name = f"ensured_{path.rsplit('-', 1)[1]}"
    tables.ensure_table(spark, name, "c_custkey BIGINT, c_name STRING", path)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.insertInto(name)
    tables.ensure_table(spark, name, "c_custkey BIGINT, c_name STRING", path)
    spark.sql(f"DROP TABLE {name}")  # the rows stay at their location
    return spark.read.parquet(path)


@query("t8_truncate", "SELECT count(*) AS n_before, 0 AS n_after FROM customer")
def t8_truncate(spark, sf_dir):
    path = scratch_path(spark, "emptied")
    name = f"emptied_{path.rsplit('-', 1)[1]}"
    tables.ensure_table(spark, name, "c_custkey BIGINT, c_name STRING", path)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.insertInto(name)
    before = spark.table(name).count()
    tables.truncate(spark, name)
    counted = spark.createDataFrame([(spark.table(name).count(),)], "n_after bigint")
    spark.sql(f"DROP TABLE {name}")
    return counted.select(F.lit(before).alias("n_before"), "n_after")


# ---- scalar functions --------------------------------------------------------------------------


@query("s3_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def s3_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query(
    "s3_escape_html",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '''', '&#39;'), '"', '&#34;') AS escaped FROM pages""",
)
def s3_escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("s7_slug", "SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_]', '', 'g') AS slug FROM part")
def s7_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query(
    "s8_sse_escape",
    r"""SELECT doc_id, replace(text, chr(10), '\n') AS escaped,
    replace(replace(text, chr(10), '\n'), '\n', chr(10)) AS restored FROM documents""",
)
def s8_sse_escape(spark, sf_dir):
    escaped = text.sse_escape(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", escaped.alias("escaped"), text.sse_unescape(escaped).alias("restored")
    )


@query(
    "s10_rebase_path",
    "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS path FROM pages",
)
def s10_rebase_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.rebase_path(F.col("url"), "http://").alias("path"))


@query(
    "s11_preview",
    r"""SELECT doc_id, CASE WHEN length(text) <= 255 THEN text
    ELSE regexp_replace(substr(text, 1, 247), '(?s)^(.*) [^ ]*$', '\1') || '...' END AS preview FROM documents""",
)
def s11_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(
    "s12_split_contact",
    """SELECT conv_id, turn, contains(text, ' ') AS accepted,
    CASE WHEN contains(text, ' ') THEN split_part(text, ' ', 1) END AS email,
    CASE WHEN contains(text, ' ') THEN regexp_replace(substr(text, strpos(text, ' ') + 1), '<[^>]*>', '', 'g') END AS message
    FROM conversations""",
)
def s12_split_contact(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.contact_parts(F.col("text")).alias("c")
    )
    return parts.select("conv_id", "turn", "c.accepted", "c.email", "c.message")
