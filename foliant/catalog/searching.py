"""Full-text queries over ``documents``; the queries are words of the ``benchmark`` passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog.base import (
    POSTINGS_SQL,
    QUERIES_SQL,
    TOKENS_SQL,
    benchmark_words,
    bm25_sql,
    corpus,
    derived_path,
    query,
    search_index,
    table,
    words_sql,
)
from foliant.functions.querytext import query_fields
from foliant.functions.text import build_prompt, clean_query, tokens
from foliant.operators.display import join_snippets, rank_display, remap_marks
from foliant.operators.search import (
    hit_counts,
    match,
    queries_of,
    search_first_n,
    search_ranked,
    skip_empty,
    with_snippets,
)
from foliant.operators.snippets import word_pattern
from foliant.plans.sizing import spread
from foliant.sources.index import (
    PAGE,
    build_postings,
    corpus_stats,
    open_or_build_index,
    reload_index,
    tokenize_pages,
    vocabulary,
)


def rounded_score():
    return (F.round("score", 6) + 0.0).alias("score")  # + 0.0: a rounded negative may be -0.0



def two_words(spark, sf_dir, field="must"):
    words = benchmark_words(spark, sf_dir)
    return queries_of(words, **{field: F.slice("w", 1, 2)})


def matches(hits):
    return hits.select("query_id", "doc_id")


# ---- index -------------------------------------------------------------------------------------


@query(
    "f1_tokenize",
    f"WITH {TOKENS_SQL} SELECT doc_id, len(toks) AS dl, array_to_string(toks, ' ') AS words FROM tok",
)
def f1_tokenize(spark, sf_dir):
    toks = tokenize_pages(spread(corpus(spark, sf_dir)))
    return toks.select("doc_id", "dl", F.array_join("toks", " ").alias("words"))


@query(
    "f2_build_postings",
    f"""WITH {TOKENS_SQL},
    pos AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS p FROM tok)
    SELECT term, doc_id, 1 AS page_num, count(*) AS tf,
           string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions
    FROM pos GROUP BY term, doc_id""",
)
def f2_build_postings(spark, sf_dir):
    postings = build_postings(tokenize_pages(spread(corpus(spark, sf_dir))))
    return postings.select(
        "term", *PAGE, "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


@query(
    "f3_corpus_stats",
    f"WITH {POSTINGS_SQL} SELECT n_docs, total_tokens, round(avgdl, 6) AS avgdl FROM stats",
)
def f3_corpus_stats(spark, sf_dir):
    stats = corpus_stats(tokenize_pages(spread(corpus(spark, sf_dir))))
    return stats.withColumn("avgdl", F.round("avgdl", 6))


@query("f3_vocabulary", f"WITH {POSTINGS_SQL} SELECT term, df, cf FROM vocab")
def f3_vocabulary(spark, sf_dir):
    return vocabulary(build_postings(tokenize_pages(spread(corpus(spark, sf_dir)))))


@query("f3_doc_stats", f"WITH {TOKENS_SQL} SELECT doc_id, 1 AS page_num, len(toks) AS dl FROM tok")
def f3_doc_stats(spark, sf_dir):
    return search_index(spark, sf_dir).doc_stats()


@query(
    "a3_write_index",
    f"WITH {POSTINGS_SQL} SELECT term, doc_id, tf, dl FROM post",
)
def a3_write_index(spark, sf_dir):
    index = reload_index(corpus(spark, sf_dir), derived_path(spark, sf_dir, "rebuilt"), kept_seconds=60)
    return index.postings.select("term", "doc_id", "tf", "dl")


@query(
    "a4_open_or_build_index",
    f"WITH {POSTINGS_SQL} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM post GROUP BY doc_id",
)
def a4_open_or_build_index(spark, sf_dir):
    path = derived_path(spark, sf_dir, "opened")
    open_or_build_index(spark, path, corpus(spark, sf_dir))
    reopened = open_or_build_index(spark, path, None)
    return reopened.postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens")
    )


# ---- matching ----------------------------------------------------------------------------------


@query(
    "f4_match_term",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok)
    SELECT query_id, doc_id FROM q JOIN t ON t.term = q.w[1]""",
)
def f4_match_term(spark, sf_dir):
    words = benchmark_words(spark, sf_dir)
    return matches(match(search_index(spark, sf_dir), queries_of(words, must=F.slice("w", 1, 1))))


@query(
    "f5_match_all",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok),
    u AS (SELECT query_id, unnest(list_distinct(w[1:2])) AS term, len(list_distinct(w[1:2])) AS n FROM q),
    h AS (SELECT query_id, doc_id, n FROM u JOIN t USING (term))
    SELECT query_id, doc_id FROM h GROUP BY query_id, doc_id HAVING count(*) = any_value(n)""",
)
def f5_match_all(spark, sf_dir):
    return matches(match(search_index(spark, sf_dir), two_words(spark, sf_dir)))


@query(
    "f6_match_any",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok)
    SELECT DISTINCT query_id, doc_id FROM q JOIN t ON t.term = q.w[1] OR t.term = q.w[2]""",
)
def f6_match_any(spark, sf_dir):
    return matches(match(search_index(spark, sf_dir), two_words(spark, sf_dir, "should")))


@query(
    "f7_match_not",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok)
    SELECT query_id, a.doc_id FROM q JOIN t a ON a.term = q.w[1]
    WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.term = q.w[2] AND b.doc_id = a.doc_id)""",
)
def f7_match_not(spark, sf_dir):
    words = benchmark_words(spark, sf_dir)
    asked = queries_of(words, must=F.slice("w", 1, 1), must_not=F.slice("w", 2, 1))
    return matches(match(search_index(spark, sf_dir), asked))


PHRASE_SQL = """ph AS (
    SELECT query_id, a.doc_id, count(*) AS tf, any_value(a.dl) AS dl
    FROM q JOIN pos a ON a.term = q.w[3] JOIN pos b ON b.term = q.w[4] AND b.doc_id = a.doc_id AND b.p = a.p + 1
    GROUP BY query_id, a.doc_id),
    phdf AS (SELECT query_id, count(*) AS df FROM ph GROUP BY query_id)"""


@query(
    "f8_match_phrase",
    f"""WITH {POSTINGS_SQL}, {QUERIES_SQL}, {PHRASE_SQL}
    SELECT query_id, doc_id, round({bm25_sql('df')}, 6) + 0.0 AS score FROM ph JOIN phdf USING (query_id), stats""",
)
def f8_match_phrase(spark, sf_dir):
    asked = queries_of(benchmark_words(spark, sf_dir), phrase=F.slice("w", 3, 2))
    hits = match(search_index(spark, sf_dir), asked)
    return hits.select("query_id", "doc_id", rounded_score())


@query(
    "f8_long_phrase",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}
    SELECT query_id, doc_id FROM q JOIN tok
      ON contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || array_to_string(w[3:7], ' ') || ' ')""",
)
def f8_long_phrase(spark, sf_dir):
    """Five words of each passage: pairs of frequent words are read as pairs, and the rarest piece decides on the pages."""
    asked = queries_of(benchmark_words(spark, sf_dir), phrase=F.slice("w", 3, 5))
    return matches(match(search_index(spark, sf_dir), asked))


PREFIX_SQL = """px AS (
    SELECT query_id, doc_id, sum(tf) AS tf, any_value(dl) AS dl
    FROM q JOIN post ON starts_with(post.term, substr(q.w[5], 1, 3)) GROUP BY query_id, doc_id),
    pxdf AS (SELECT query_id, count(*) AS df FROM px GROUP BY query_id)"""


@query(
    "f9_match_prefix",
    f"""WITH {POSTINGS_SQL}, {QUERIES_SQL}, {PREFIX_SQL}
    SELECT query_id, doc_id, round({bm25_sql('df')}, 6) + 0.0 AS score FROM px JOIN pxdf USING (query_id), stats""",
)
def f9_match_prefix(spark, sf_dir):
    asked = queries_of(benchmark_words(spark, sf_dir), prefix=F.substring(F.get("w", F.lit(4)), 1, 3))
    hits = match(search_index(spark, sf_dir), asked)
    return hits.select("query_id", "doc_id", rounded_score())


# ---- ranking -----------------------------------------------------------------------------------

ALL_TWO_SQL = f"""two AS (SELECT query_id, unnest(w[1:2]) AS term, generate_subscripts(w[1:2], 1) AS u FROM q),
    hit AS (SELECT query_id, doc_id, count(*) AS units, sum({bm25_sql('df')}) AS score
            FROM two JOIN post USING (term) JOIN vocab USING (term), stats GROUP BY query_id, doc_id)"""


@query(
    "f10_bm25",
    f"""WITH {POSTINGS_SQL}, {QUERIES_SQL}, {ALL_TWO_SQL}
    SELECT query_id, doc_id, round(score, 6) + 0.0 AS score FROM hit""",
)
def f10_bm25(spark, sf_dir):
    hits = match(search_index(spark, sf_dir), two_words(spark, sf_dir, "should"))
    return hits.select("query_id", "doc_id", rounded_score())


RANKED_SQL = f"""{POSTINGS_SQL}, {QUERIES_SQL}, {ALL_TWO_SQL},
    ranked AS (SELECT query_id, doc_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS rank_no
               FROM hit WHERE units = 2 QUALIFY rank_no <= 5)"""


@query(
    "f11_search_ranked",
    f"WITH {RANKED_SQL} SELECT query_id, doc_id, rank_no, round(score, 6) + 0.0 AS score FROM ranked",
)
def f11_search_ranked(spark, sf_dir):
    best = search_ranked(search_index(spark, sf_dir), two_words(spark, sf_dir))
    return best.select("query_id", "doc_id", "rank_no", rounded_score())


@query(
    "f11_search_pruned",
    f"""WITH {POSTINGS_SQL}, {QUERIES_SQL}, {ALL_TWO_SQL},
    ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS rank_no
               FROM hit QUALIFY rank_no <= 5)
    SELECT query_id, doc_id, rank_no, round(score, 6) + 0.0 AS score FROM ranked""",
)
def f11_search_pruned(spark, sf_dir):
    """Best five of either word, block by block: only blocks that can still beat the fifth are read to the end."""
    best = search_ranked(search_index(spark, sf_dir), two_words(spark, sf_dir, "should"), prune_hits=0)
    return best.select("query_id", "doc_id", "rank_no", rounded_score())


@query(
    "f12_search_first_n",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank_no
    FROM q JOIN t ON t.term = q.w[1] QUALIFY rank_no <= 3""",
)
def f12_search_first_n(spark, sf_dir):
    asked = queries_of(benchmark_words(spark, sf_dir), must=F.slice("w", 1, 1))
    return search_first_n(search_index(spark, sf_dir), asked).select("query_id", "doc_id", "rank_no")


# Words with their places, windows and fragments of ``shown`` (query_id, doc_id, rank_no) for the words of ``asked``
# (query_id, u, term), u from 0. Single words never overlap, so each hit is a run of its own.
def snippet_sql(n: int) -> str:
    pattern = word_pattern()
    return f"""txt AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS raw, regexp_split_to_array(text, '{pattern}') AS gap
            FROM documents WHERE doc_id IN (SELECT doc_id FROM shown)),
    ends AS (SELECT doc_id, i, raw[i] AS word, gap[i] AS gap, sum(length(gap[i]) + length(raw[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e
             FROM (SELECT doc_id, raw, gap, unnest(range(1, len(raw) + 1)) AS i FROM txt)),
    folded AS (SELECT *, strip_accents(lower(word)) AS term FROM ends),
    placed AS (SELECT doc_id, term, gap, e, e - length(word) AS b, row_number() OVER d - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS dl,
               coalesce(lag(e) OVER d, 0) AS before FROM folded WHERE term <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    marks AS (SELECT query_id, doc_id, n AS k, u, dl FROM shown JOIN asked USING (query_id) JOIN placed USING (doc_id, term)
              UNION ALL SELECT query_id, doc_id, n, NULL, dl FROM shown JOIN placed USING (doc_id)
              WHERE n = 0 OR regexp_matches(gap, '[.:][ \t\r\n]+$')),
    wins AS (SELECT *, count(u) OVER a + 999 * count(DISTINCT u) OVER a AS score,
             max(CASE WHEN u IS NOT NULL THEN k + 1 END) OVER a AS last,
             max(CASE WHEN u IS NULL THEN k END) OVER (PARTITION BY query_id, doc_id ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st
             FROM marks WINDOW a AS (PARTITION BY query_id, doc_id ORDER BY k RANGE BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
    tries AS (SELECT query_id, doc_id, k, u, 0 AS b, score, dl, greatest(0, least(k - CAST(trunc(({n} - (last - k)) / 2.0) AS BIGINT), dl - {n})) AS start
              FROM wins WHERE u IS NOT NULL
              UNION ALL SELECT h.query_id, h.doc_id, h.k, h.u, 1, s.score + CASE WHEN s.k = 0 THEN 120 ELSE 100 END, h.dl, s.k
              FROM wins h JOIN wins s ON s.query_id = h.query_id AND s.doc_id = h.doc_id AND s.u IS NULL AND s.k = h.st
              WHERE h.u IS NOT NULL AND h.dl > {n} AND h.st < h.k),
    best AS (SELECT query_id, doc_id, start, least(start + {n}, dl) - 1 AS stop, dl FROM tries
             QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, k, u, b) = 1),
    pieces AS (SELECT query_id, doc_id, start, stop, best.dl, n, e, text,
               CASE WHEN n = start AND start > 0 THEN '' ELSE substr(text, CAST(before + 1 AS BIGINT), CAST(b - before AS BIGINT)) END
               || CASE WHEN EXISTS (SELECT 1 FROM asked x WHERE x.query_id = best.query_id AND x.term = placed.term)
                  THEN '<b>' || substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)) || '</b>'
                  ELSE substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)) END AS piece
               FROM best JOIN placed USING (doc_id) JOIN txt USING (doc_id) WHERE n BETWEEN start AND stop),
    snip AS (SELECT query_id, doc_id, CASE WHEN any_value(start) > 0 THEN '...' ELSE '' END || string_agg(piece, '' ORDER BY n)
             || CASE WHEN any_value(stop) < any_value(dl) - 1 THEN '...' ELSE substr(any_value(text), CAST(max(e) + 1 AS BIGINT)) END AS snippet
             FROM pieces GROUP BY query_id, doc_id)"""


TWO_ASKED_SQL = "asked AS (SELECT query_id, unnest(w[1:2]) AS term, generate_subscripts(w[1:2], 1) - 1 AS u FROM q)"


@query(
    "f13_snippet",
    f"""WITH {RANKED_SQL}, shown AS (SELECT query_id, doc_id, rank_no FROM ranked), {TWO_ASKED_SQL}, {snippet_sql(20)}
    SELECT query_id, doc_id, rank_no, snippet FROM shown JOIN snip USING (query_id, doc_id)""",
)
def f13_snippet(spark, sf_dir):
    index, asked = search_index(spark, sf_dir), two_words(spark, sf_dir)
    shown = with_snippets(search_ranked(index, asked), index, asked, 20)
    return shown.select("query_id", "doc_id", "rank_no", "snippet")


@query(
    "f14_highlight",
    r"""WITH m AS (SELECT doc_id, replace(replace(text, ' de ', ' <b>de</b> '), ' the ', ' <b>the</b> ') AS marked FROM documents),
    e AS (SELECT doc_id, replace(replace(marked, '<b>', '[bold bright_red]'), '</b>', '[/bold bright_red]') AS t FROM m)
    SELECT doc_id, replace(replace(t, '[', '\['), '\[bold', '[bold') AS shown FROM e""",
)
def f14_highlight(spark, sf_dir):
    marked = F.col("text")
    for word in ("de", "the"):
        marked = F.replace(marked, F.lit(f" {word} "), F.lit(f" <b>{word}</b> "))
    shown = remap_marks(marked, ("<b>", "</b>"), ("[bold bright_red]", "[/bold bright_red]"))
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("shown"))


@query(
    "f15_rank_display",
    f"""WITH {RANKED_SQL}
    SELECT query_id, doc_id, 1 AS page_num, rank_no AS match_no,
           CAST(round_even(score, 4) AS DOUBLE) + 0.0 AS shown_score FROM ranked""",
)
def f15_rank_display(spark, sf_dir):
    return rank_display(search_ranked(search_index(spark, sf_dir), two_words(spark, sf_dir)), 4)


@query(
    "f16_no_match_report",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok),
    c AS (SELECT query_id, count(*) AS n FROM q JOIN t a ON a.term = q.w[1]
          JOIN t b ON b.term = q.w[-1] AND b.doc_id = a.doc_id GROUP BY query_id)
    SELECT query_id, coalesce(n, 0) AS n_total, least(coalesce(n, 0), 5) AS n_returned,
           CASE WHEN coalesce(n, 0) = 0 THEN 'No matches found' END AS message
    FROM q LEFT JOIN c USING (query_id)""",
)
def f16_no_match_report(spark, sf_dir):
    words = benchmark_words(spark, sf_dir)
    asked = queries_of(words, must=F.array(F.get("w", F.lit(0)), F.element_at("w", -1)))
    return hit_counts(match(search_index(spark, sf_dir), asked), asked, 5)


@query(
    "f17_stored_only_column",
    f"""WITH s AS (SELECT doc_id, source, unnest({words_sql('text')}) AS term FROM documents)
    SELECT DISTINCT b.item_id AS query_id, s.doc_id, s.source
    FROM benchmark b JOIN s ON s.term = ({words_sql('b.text')})[1]""",
)
def f17_stored_only_column(spark, sf_dir):
    """The stored column comes back with the hit but is not searched itself."""
    asked = queries_of(benchmark_words(spark, sf_dir), must=F.slice("w", 1, 1))
    hits = matches(match(search_index(spark, sf_dir), asked))
    stored = table(spark, sf_dir, "documents").select("doc_id", "source")
    return hits.join(stored, "doc_id").select("query_id", "doc_id", "source")


# ---- all columns of a table --------------------------------------------------------------------

COLUMNS_SQL = f"""cols AS (SELECT page_id AS doc_id, 'url' AS c, {words_sql('url')} AS w FROM pages
          UNION ALL SELECT page_id, 'html', {words_sql('html')} FROM pages),
    cpos AS (SELECT doc_id, c, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p FROM cols),
    lens AS (SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS dl FROM cols GROUP BY doc_id),
    stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lens),
    post AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM cpos JOIN lens USING (doc_id) GROUP BY term, doc_id),
    vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def web_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id").withColumn("page_num", F.lit(1))


def web_index(spark, sf_dir):
    """One index over both text columns of ``pages``."""
    base = derived_path(spark, sf_dir, "web-index")
    return open_or_build_index(spark, base, web_rows(spark, sf_dir), columns=("url", "html"))


@query(
    "f18_whole_table_match",
    f"""WITH q AS (SELECT item_id AS query_id, unnest(({words_sql('text')})[1:2]) AS term FROM benchmark),
    qd AS (SELECT DISTINCT query_id, term FROM q),
    need AS (SELECT query_id, count(*) AS n FROM qd GROUP BY query_id),
    c AS (SELECT 'url' AS column_id, page_id, unnest({words_sql('url')}) AS term FROM pages
          UNION ALL SELECT 'html', page_id, unnest({words_sql('html')}) FROM pages),
    cd AS (SELECT DISTINCT column_id, page_id, term FROM c)
    SELECT query_id, page_id AS doc_id, count(*) AS n_column_hits
    FROM qd JOIN cd USING (term) JOIN need USING (query_id)
    GROUP BY query_id, page_id, n HAVING count(DISTINCT term) = n""",
)
def f18_whole_table_match(spark, sf_dir):
    words = benchmark_words(spark, sf_dir)
    asked = queries_of(words, must=F.array_distinct(F.slice("w", 1, 2)))
    return match(web_index(spark, sf_dir), asked, count_columns=True).select("query_id", "doc_id", "n_column_hits")


@query(
    "f18_ranked_columns",
    f"""WITH {COLUMNS_SQL}, {QUERIES_SQL}, {ALL_TWO_SQL},
    ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), doc_id) AS rank_no
               FROM hit QUALIFY rank_no <= 5)
    SELECT query_id, doc_id, rank_no, round(score, 6) + 0.0 AS score FROM ranked""",
)
def f18_ranked_columns(spark, sf_dir):
    """Best five pages for either of two words, wherever they stand."""
    best = search_ranked(web_index(spark, sf_dir), two_words(spark, sf_dir, "should"))
    return best.select("query_id", "doc_id", "rank_no", rounded_score())


@query(
    "f18_phrase_columns",
    f"""WITH {COLUMNS_SQL}, q AS (SELECT doc_id AS query_id, w[41] AS one, w[42] AS two FROM cols WHERE c = 'html'),
    ph AS (SELECT query_id, a.doc_id, count(*) AS tf FROM q JOIN cpos a ON a.term = one
           JOIN cpos b ON b.term = two AND b.doc_id = a.doc_id AND b.c = a.c AND b.p = a.p + 1 GROUP BY query_id, a.doc_id),
    phdf AS (SELECT query_id, count(*) AS df FROM ph GROUP BY query_id)
    SELECT query_id, doc_id, round({bm25_sql('df')}, 6) + 0.0 AS score
    FROM ph JOIN phdf USING (query_id) JOIN lens USING (doc_id), stats""",
)
def f18_phrase_columns(spark, sf_dir):
    """Pages that have two neighbouring words of some page side by side in one of their columns."""
    asked = web_rows(spark, sf_dir).select(F.col("doc_id").alias("query_id"), tokens(F.col("html")).alias("w"))
    hits = match(web_index(spark, sf_dir), queries_of(asked, phrase=F.slice("w", 41, 2)), digits=6)
    return hits.select("query_id", "doc_id", "score")


@query(
    "f18_chosen_column",
    f"""WITH {COLUMNS_SQL}, q AS (SELECT doc_id AS query_id, w[2] AS host, w[3][1:2] AS start, w[4] AS other FROM cols WHERE c = 'url'),
    here AS (SELECT term, doc_id, count(*) AS tf FROM cpos WHERE c = 'url' GROUP BY term, doc_id),
    wd AS (SELECT query_id, doc_id, tf, count(*) OVER (PARTITION BY query_id) AS df FROM q JOIN here ON term = host),
    px AS (SELECT query_id, doc_id, sum(tf) AS tf FROM q JOIN here ON starts_with(term, start) GROUP BY query_id, doc_id),
    pd AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS df FROM px),
    both_ AS (SELECT * FROM wd UNION ALL SELECT * FROM pd),
    hit AS (SELECT query_id, doc_id, count(*) AS units, sum({bm25_sql('df')}) AS score
            FROM both_ JOIN lens USING (doc_id), stats GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, round(score, 6) + 0.0 AS score FROM hit h JOIN q USING (query_id)
    WHERE units = 2 AND NOT EXISTS (SELECT 1 FROM here x WHERE x.term = other AND x.doc_id = h.doc_id AND other <> 'com')""",
)
def f18_chosen_column(spark, sf_dir):
    """Words, prefixes and exclusions that look at the address only: pages of a host outside a top-level domain."""
    asked = web_rows(spark, sf_dir).select(F.col("doc_id").alias("query_id"), tokens(F.col("url")).alias("w"))
    asked = queries_of(
        asked,
        must=F.slice("w", 2, 1),
        prefix=F.substring(F.get("w", F.lit(2)), 1, 2),
        must_not=F.filter(F.slice("w", 4, 1), lambda t: t != "com"),
        columns=F.array(F.lit("url")),
    )
    return match(web_index(spark, sf_dir), asked, digits=6).select("query_id", "doc_id", "score")


@query(
    "p9_skip_empty_query",
    r"""SELECT conv_id AS query_id, turn, text FROM conversations
    WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""",
)
def p9_skip_empty_query(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "text")
    return skip_empty(log, "text")


@query(
    "f19_query_text",
    f"""WITH {TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok),
    words AS (
        SELECT query_id * 4 AS query_id, unnest(list_distinct(w)) AS term, len(list_distinct(w)) AS n FROM q
        UNION ALL SELECT query_id * 4 + 1, unnest(w[1:2]), 1 FROM q),
    ph AS (SELECT query_id * 4 + 3, doc_id FROM q JOIN tok ON contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || w[1] || ' ' || w[2] || ' ')
           AND contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || w[3] || ' ' || w[4] || ' '))
    SELECT query_id, doc_id FROM words JOIN t USING (term) GROUP BY query_id, doc_id HAVING count(DISTINCT term) >= any_value(n)
    UNION ALL SELECT query_id * 4 + 2, a.doc_id FROM q JOIN t a ON a.term = q.w[1] WHERE
        NOT EXISTS (SELECT 1 FROM t b WHERE b.term = q.w[2] AND b.doc_id = a.doc_id)
        AND EXISTS (SELECT 1 FROM t c WHERE starts_with(c.term, q.w[3][1:2]) AND c.doc_id = a.doc_id)
        AND EXISTS (SELECT 1 FROM t c WHERE starts_with(c.term, q.w[4][1:2]) AND c.doc_id = a.doc_id)
    UNION ALL SELECT * FROM ph""",
)
def f19_query_text(spark, sf_dir):
    """Each passage as typed, and typed forms of its words with OR, with NOT and two prefixes, and with two phrases."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", tokens(F.col("text")).alias("w"))
    w = lambda i: F.get("w", F.lit(i))
    forms = [
        F.col("text"),
        F.concat(w(0), F.lit(" OR "), w(1)),
        F.concat(w(0), F.lit(" NOT "), w(1), F.lit(" "), w(2).substr(1, 2), F.lit("* "), w(3).substr(1, 2), F.lit("*")),
        F.concat(F.lit('"'), w(0), F.lit(" "), w(1), F.lit('" "'), w(2), F.lit(" "), w(3), F.lit('"')),
    ]
    typed = items.select("item_id", F.posexplode(F.array(*forms)).alias("form", "typed"))
    asked = typed.select((F.col("item_id") * 4 + F.col("form")).alias("query_id"), "typed")
    return matches(match(search_index(spark, sf_dir), queries_of(asked, **query_fields(F.col("typed")))))


FIRST_SQL = f"""{TOKENS_SQL}, {QUERIES_SQL}, t AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM tok),
    shown AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank_no
              FROM q JOIN t ON t.term = q.w[1] QUALIFY rank_no <= 3),
    asked AS (SELECT query_id, w[1] AS term, 0 AS u FROM q)"""


@query(
    "g3_join_snippets",
    f"""WITH {FIRST_SQL}, {snippet_sql(10)}
    SELECT query_id, string_agg('Snippet: ' || snippet, chr(10) ORDER BY rank_no) AS context
    FROM shown JOIN snip USING (query_id, doc_id) GROUP BY query_id""",
)
def g3_join_snippets(spark, sf_dir):
    """The fragments of the first three documents of each search, joined as context."""
    index, asked = search_index(spark, sf_dir), queries_of(benchmark_words(spark, sf_dir), must=F.slice("w", 1, 1))
    found = with_snippets(search_first_n(index, asked), index, asked, 10)
    return join_snippets(found, ["query_id"], "rank_no", "snippet")


@query(
    "f20_grounded_prompt",
    f"""WITH {FIRST_SQL}, {snippet_sql(10)},
    context AS (SELECT query_id, string_agg('Snippet: ' || snippet, chr(10) ORDER BY rank_no) AS context
                FROM shown JOIN snip USING (query_id, doc_id) GROUP BY query_id)
    SELECT item_id AS query_id, CASE WHEN coalesce(context, '') <> '' THEN 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || text
           ELSE text END AS prompt FROM benchmark LEFT JOIN context ON query_id = item_id""",
)
def f20_grounded_prompt(spark, sf_dir):
    """The whole way from a search over its snippets and their context to the prompt that asks about them."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked.join(g3_join_snippets(spark, sf_dir), "query_id", "left").select(
        "query_id", build_prompt(F.col("context"), F.col("text")).alias("prompt")
    )


@query(
    "s1_clean_query",
    r"""SELECT doc_id, c AS cleaned, c = '' AS is_error FROM (
    SELECT doc_id, regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s*]', '', 'g'), '^\s+|\s+$', '', 'g') AS c
    FROM documents)""",
)
def s1_clean_query(spark, sf_dir):
    cleaned = clean_query(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", cleaned.alias("cleaned"), (cleaned == "").alias("is_error")
    )
