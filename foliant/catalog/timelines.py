"""Time axis, retrieval context, throttling and token streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog.base import benchmark_words, query, search_index, table, words_sql
from foliant.catalog.streams import run_once, stream_of
from foliant.functions.instants import micros
from foliant.functions.text import build_prompt, rebase_path
from foliant.operators import context, timeline
from foliant.operators.search import queries_of, search_first_n
from foliant.streaming import throttle, tokens
from foliant.streaming.sessions import session_last_search

# The slides of the player, ten seconds each.
SLIDES = [(0, 0.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 30.0), (3, 30.0, 40.0)]


def slides(spark):
    return spark.createDataFrame(SLIDES, "idx int, start double, end double")


def minute_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.minute("ts").cast("double").alias("t")
    )


SLIDE_SQL = "CASE WHEN minute(ts) < 40 THEN CAST(minute(ts) // 10 AS INTEGER) END"


@query("j1_interval_lookup", f"SELECT event_id, user_id, {SLIDE_SQL} AS idx FROM events")
def j1_interval_lookup(spark, sf_dir):
    points = minute_events(spark, sf_dir)
    return timeline.interval_lookup(points, "t", slides(spark)).select(
        "event_id", "user_id", "idx"
    )


@query(
    "j1_interval_lookup_many",
    """WITH s AS (SELECT p_partkey AS idx, p_partkey * 0.05::DOUBLE AS s, p_partkey * 0.05::DOUBLE + p_size / 100.0::DOUBLE AS e FROM part)
    SELECT event_id, any_value(value) AS value, min(idx) AS idx
    FROM events LEFT JOIN s ON value >= s.s AND value < s.e GROUP BY event_id""",
)
def j1_interval_lookup_many(spark, sf_dir):
    start = F.col("p_partkey") * 0.05
    spans = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), start.alias("start"), (start + F.col("p_size") / 100.0).alias("end")
    )
    points = table(spark, sf_dir, "events").select("event_id", "value")
    return timeline.interval_lookup(points, "value", spans)


@query(
    "j2_carry_forward",
    f"""WITH p AS (SELECT event_id, user_id, ts, {SLIDE_SQL} AS idx FROM events)
    SELECT event_id, user_id, coalesce(last_value(idx IGNORE NULLS) OVER
        (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS shown FROM p""",
)
def j2_carry_forward(spark, sf_dir):
    found = timeline.interval_lookup(minute_events(spark, sf_dir), "t", slides(spark))
    shown = timeline.carry_forward(found, ["user_id"], ["ts", "event_id"], "idx", "shown", F.lit(0))
    return shown.select("event_id", "user_id", "shown")


# Searches are views (those of a small value found nothing), prompts are purchases; the text of
# a prompt is made of the event's own properties.
PROMPT_SQL = "CASE WHEN value < 20 THEN 'Based ON ' ELSE 'about ' END || props"
CONTEXT_SQL = f"""s AS (SELECT user_id, ts, event_id, 'hit ' || value AS found FROM events
               WHERE event_type = 'view' AND value >= 2),
    p AS (SELECT user_id, ts, event_id, {PROMPT_SQL} AS prompt FROM events WHERE event_type = 'purchase'),
    j AS (SELECT p.event_id, p.user_id, p.prompt,
          CASE WHEN contains(lower(p.prompt), 'based on') THEN s.found END AS last_search
          FROM p ASOF LEFT JOIN s ON s.user_id = p.user_id AND s.ts <= p.ts)"""


def session_log(spark, sf_dir):
    lead = F.when(F.col("value") < 20, "Based ON ").otherwise("about ")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", F.concat(lead, F.col("props")).alias("prompt")
    )


def found_by_view():
    successful = (F.col("event_type") == "view") & (F.col("value") >= 2)
    return F.when(successful, F.concat(F.lit("hit "), F.col("value").cast("string")))


def prompts_with_context(spark, sf_dir):
    return context.attach_last_search(
        session_log(spark, sf_dir), "user_id", ["ts", "event_id"],
        F.col("event_type") == "purchase", found_by_view(), F.col("prompt"),
    )


@query("j3_attach_last_search", f"WITH {CONTEXT_SQL} SELECT event_id, user_id, last_search FROM j")
def j3_attach_last_search(spark, sf_dir):
    return prompts_with_context(spark, sf_dir).select("event_id", "user_id", "last_search")


@query(
    "s9_build_prompt",
    f"""WITH {CONTEXT_SQL} SELECT event_id, CASE WHEN coalesce(last_search, '') <> ''
    THEN 'CONTEXT:' || chr(10) || last_search || chr(10) || chr(10) || 'QUESTION: ' || prompt
    ELSE prompt END AS full_prompt FROM j""",
)
def s9_build_prompt(spark, sf_dir):
    full = build_prompt(F.col("last_search"), F.col("prompt"))
    return prompts_with_context(spark, sf_dir).select("event_id", full.alias("full_prompt"))


@query(
    "j5_link_media",
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS term FROM documents),
    q AS (SELECT item_id, ({words_sql('text')})[1] AS term FROM benchmark),
    d AS (SELECT item_id AS link_id, min(doc_id) AS document_id FROM q JOIN t USING (term) GROUP BY item_id),
    m AS (SELECT conv_id AS link_id, 'static/conv' || conv_id || '/frame_' || turn || '.jpg' AS path FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY path) - 1 AS i,
          count(*) OVER (PARTITION BY link_id) AS n FROM m)
    SELECT link_id, document_id, substr(path, 8) AS frame_path,
           CAST(round_even(i * (10.0::DOUBLE / greatest(n - 1, 1)), 1) AS DOUBLE) AS timestamp_sec
    FROM n JOIN d USING (link_id)""",
)
def j5_link_media(spark, sf_dir):
    """Turns stand for the frames of a folder, benchmark items for the search that finds its document."""
    asked = queries_of(benchmark_words(spark, sf_dir), must=F.slice("w", 1, 1))
    first = search_first_n(search_index(spark, sf_dir), asked, 1)
    documents = first.select(F.col("query_id").alias("link_id"), F.col("doc_id").alias("document_id"))
    path = F.format_string("static/conv%d/frame_%d.jpg", "conv_id", "turn")
    media = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("link_id"), path.alias("path"))
    linked = timeline.link_media(documents, media)
    return linked.withColumn("frame_path", rebase_path(F.col("frame_path")))


# ---- sampling ----------------------------------------------------------------------------------


@query(
    "w1_even_timestamps",
    """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
               count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, CAST(round_even(i * (10.0::DOUBLE / greatest(n - 1, 1)), 1) AS DOUBLE) AS timestamp_sec
    FROM n""",
)
def w1_even_timestamps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return timeline.even_timestamps(events, ["user_id"], ["ts", "event_id"]).drop("ts")


SAMPLED_SQL = """n AS (SELECT event_id, user_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number FROM events),
    c AS (SELECT user_id, least(90, count(*)) AS hi FROM events GROUP BY user_id),
    k AS (SELECT user_id, i + 1 AS sample_no, CAST(trunc(15.0::DOUBLE + i * (hi - 15) / 3.0::DOUBLE) AS BIGINT) AS frame_number
          FROM c, range(4) r(i))"""


@query(
    "w2_sample_even_rows",
    f"""WITH {SAMPLED_SQL} SELECT user_id, event_id, sample_no, frame_number,
    frame_number / 1.5::DOUBLE AS timestamp FROM n JOIN k USING (user_id, frame_number)""",
)
def w2_sample_even_rows(spark, sf_dir):
    return even_samples(spark, sf_dir).drop("ts")


def even_samples(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return timeline.sample_even_rows(
        events, ["user_id"], ["ts", "event_id"], start=10.0, duration=50.0, n=4, fps=1.5
    )


@query(
    "w4_index_to_time",
    f"""WITH {SAMPLED_SQL} SELECT event_id, sample_no,
    printf('frame_%d_%.2fs.jpg', sample_no, frame_number / 1.5::DOUBLE) AS name
    FROM n JOIN k USING (user_id, frame_number)""",
)
def w4_index_to_time(spark, sf_dir):
    seconds = timeline.index_to_time(F.col("frame_number"), F.lit(1.5))
    name = timeline.sample_name(F.col("sample_no"), seconds, "frame")
    return even_samples(spark, sf_dir).select("event_id", "sample_no", name.alias("name"))


@query(
    "w3_sample_midpoints",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events),
    k AS (SELECT i + 1 AS sample_no, 1704067200.0::DOUBLE + i * 432000.0 + 216000.0 AS target FROM range(4) r(i)),
    c AS (SELECT user_id, sample_no, target, min(t) AS t FROM e, k WHERE t >= target GROUP BY ALL)
    SELECT user_id, sample_no, target, t, min(event_id) AS event_id
    FROM c JOIN e USING (user_id, t) GROUP BY ALL""",
)
def w3_sample_midpoints(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seconds = micros(events, "ts") / F.lit(1e6)
    events = events.select("user_id", "event_id", seconds.alias("t"))
    first_day = F.lit(1704067200.0)
    return timeline.sample_midpoints(events, ["user_id"], "t", "event_id", first_day, 4 * 432000.0, 4)


@query(
    "w5_prev_next",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    coalesce(lag(l_partkey) OVER w, l_partkey) AS prev_value,
    coalesce(lead(l_partkey) OVER w, l_partkey) AS next_value
    FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)""",
)
def w5_prev_next(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    return timeline.prev_next(lines, ["l_orderkey"], order, "l_partkey").drop("l_suppkey", "l_quantity")


# ---- throttling --------------------------------------------------------------------------------


def chain_sql(gap: str) -> str:
    """Accepted times of each user, one after the other."""
    return f"""RECURSIVE acc AS (
        SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
        UNION ALL
        SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL {gap})
        FROM acc a WHERE a.ts IS NOT NULL),
    ok AS (SELECT user_id, ts FROM acc WHERE ts IS NOT NULL),
    e AS (SELECT event_id, events.user_id, events.ts, ok.ts AS since,
          row_number() OVER (PARTITION BY events.user_id, events.ts ORDER BY event_id) AS tie
          FROM events ASOF JOIN ok ON ok.user_id = events.user_id AND ok.ts <= events.ts)"""


@query(
    "r1_cooldown",
    f"""WITH {chain_sql('6 HOUR')}
    SELECT user_id, event_id, ts, ts = since AND tie = 1 AS accepted,
    CASE WHEN NOT (ts = since AND tie = 1)
         THEN (21600000000 - (epoch_us(ts) - epoch_us(since))) // 1000000 + 1 END AS retry_after FROM e""",
)
def r1_cooldown(spark, sf_dir):
    return throttle.cooldown(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600)


@query(
    "r2_rate_limit",
    """SELECT event_id, user_id, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3""",
)
def r2_rate_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return throttle.rate_limit(events, ["user_id"], "ts", "event_id", 3, "day")


@query(
    "r2_rate_limit_anchored",
    f"""WITH {chain_sql('1 DAY')}
    SELECT user_id, event_id, ts, since AS period_start FROM e
    QUALIFY row_number() OVER (PARTITION BY user_id, since ORDER BY ts, event_id) <= 3""",
)
def r2_rate_limit_anchored(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return throttle.rate_limit_anchored(events, ["user_id"], "ts", "event_id", 3, "day")


# ---- token streams -----------------------------------------------------------------------------

# Each line of a document is a token, and a row without token ends the stream; streams of one
# language end in an error.
FRAMES_SQL = """l AS (SELECT doc_id, lang, unnest(list_append(string_split(text, chr(10)), NULL)) AS chunk,
               generate_subscripts(list_append(string_split(text, chr(10)), NULL), 1) - 1 AS seq FROM documents),
    fr AS (SELECT doc_id, seq, 'data: ' || coalesce(replace(chunk, chr(10), '\\n'),
           CASE WHEN lang = 'es' THEN '[ERROR] model gone' ELSE '[DONE]' END) || chr(10) || chr(10) AS frame FROM l)"""


def framed_lines(spark, sf_dir):
    lines = F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(lines).alias("seq", "chunk"))
    rows = rows.withColumn("error", F.when(F.col("lang") == "es", "model gone"))
    return tokens.frame_token_stream(rows, "chunk", "error")


@query("r3_frame_token_stream", f"WITH {FRAMES_SQL} SELECT doc_id, seq, frame FROM fr")
def r3_frame_token_stream(spark, sf_dir):
    return framed_lines(spark, sf_dir).select("doc_id", "seq", "frame")


@query(
    "r4_assemble_token_stream",
    r"""SELECT doc_id, 0 AS part,
    replace(replace(text, chr(10), ''), '\n', chr(10)) ||
        CASE WHEN lang = 'es' THEN chr(10) || '[ERROR] model gone' ELSE '' END AS text,
    CASE WHEN lang = 'es' THEN 'error' ELSE 'done' END AS status FROM documents""",
)
def r4_assemble_token_stream(spark, sf_dir):
    frames = framed_lines(spark, sf_dir)
    return tokens.assemble_token_stream(frames, "doc_id", "seq", "frame")


# R5 is the streaming form of j3: its named query runs the stream over the events in one go.
@query("r5_session_last_search", f"WITH {CONTEXT_SQL} SELECT event_id, user_id, last_search FROM j")
def r5_session_last_search(spark, sf_dir):
    events = stream_of(spark, sf_dir, "events")
    lead = F.when(F.col("value") < 20, "Based ON ").otherwise("about ")
    log = events.withColumn("prompt", F.concat(lead, F.col("props")))
    out = session_last_search(
        log, "user_id", "ts", "event_id", F.col("event_type") == "purchase", found_by_view(), F.col("prompt")
    )
    return run_once(spark, out, "r5").select("event_id", "user_id", "last_search")


@query(
    "r1_cooldown_stream",
    f"""WITH {chain_sql('6 HOUR')}
    SELECT user_id, event_id, ts, ts = since AND tie = 1 AS accepted FROM e""",
)
def r1_cooldown_stream(spark, sf_dir):
    out = throttle.cooldown_stream(stream_of(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600)
    return run_once(spark, out, "r1").select("user_id", "event_id", "ts", "accepted")


@query(
    "r2_rate_limit_stream",
    """SELECT event_id, user_id, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3""",
)
def r2_rate_limit_stream(spark, sf_dir):
    events = stream_of(spark, sf_dir, "events")
    out = throttle.rate_limit_stream(events, ["user_id"], "ts", "event_id", 3, "day")
    return run_once(spark, out, "r2").select("event_id", "user_id", "ts")


@query(
    "r4_assemble_stream",
    r"""SELECT doc_id, replace(replace(text, chr(10), ''), '\n', chr(10)) ||
        CASE WHEN lang = 'es' THEN chr(10) || '[ERROR] model gone' ELSE '' END AS text,
    CASE WHEN lang = 'es' THEN 'error' ELSE 'done' END AS status FROM documents""",
)
def r4_assemble_stream(spark, sf_dir):
    docs = stream_of(spark, sf_dir, "documents")
    lines = F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string")))
    sent = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("sent")
    rows = docs.select("doc_id", "lang", sent, F.posexplode(lines).alias("seq", "chunk"))
    rows = rows.withColumn("error", F.when(F.col("lang") == "es", "model gone"))
    frames = tokens.frame_token_stream(rows, "chunk", "error")
    return run_once(spark, tokens.assemble_stream(frames, "doc_id", "seq", "frame", "sent"), "r4")


@query(
    "r4_assemble_stream_parts",
    rf"""WITH {FRAMES_SQL}
    SELECT doc_id, seq // 5 AS part, string_agg(CASE WHEN chunk IS NOT NULL THEN replace(chunk, '\n', chr(10))
           WHEN lang = 'es' THEN chr(10) || '[ERROR] model gone' ELSE '' END, '' ORDER BY seq) AS text,
    CASE WHEN count(*) = count(chunk) THEN 'open' WHEN any_value(lang) = 'es' THEN 'error' ELSE 'done' END AS status
    FROM l GROUP BY doc_id, part""",
)
def r4_assemble_stream_parts(spark, sf_dir):
    """Every document's lines as a stream that is given out in parts of five frames."""
    docs = stream_of(spark, sf_dir, "documents")
    lines = F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string")))
    sent = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("sent")
    rows = docs.select("doc_id", "lang", sent, F.posexplode(lines).alias("seq", "chunk"))
    rows = rows.withColumn("error", F.when(F.col("lang") == "es", "model gone"))
    frames = tokens.frame_token_stream(rows, "chunk", "error")
    return run_once(spark, tokens.assemble_stream_parts(frames, "doc_id", "seq", "frame", "sent", 5), "r4-parts")
