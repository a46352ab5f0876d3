"""Best fragment of a text around the hits of a query.

Everything is columns: a page's words come with their places in the text, the hits of a query are taken from them, each hit and
each sentence start opens a window of n words that is scored by a sliding frame, and the best window is cut out of the text with
its hits marked. The rows of one page and query stay together through all steps, so there is one shuffle of narrow rows by
(query, page), and the text joins them once at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import fold, fold_map

# Weights of the fragment score.
FIRST_HIT, REPEAT_HIT, TEXT_START, SENTENCE_START = 1000, 1, 120, 100
SENTENCE_END = r"[.:][ \t\r\n]+\z"

PAGE = ["doc_id", "page_num"]
AT = ["query_id", *PAGE]


def tasks_for(df: DataFrame) -> int:
    """Few rows with much work each still use all cores."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_pattern() -> str:
    """Runs of letters, numbers and private use, with the accents that folding deletes."""
    return r"[\p{L}\p{N}\p{Co}" + fold_map()[2] + "]+"


def placed_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, content) with ``words``: array<struct<i, word, begin, end, opens>>, one row a page.

    ``word`` is folded, ``begin`` and ``end`` are places in the text from 0, ``opens`` says that a sentence begins. Pages must
    be different; a page without words has an empty array.
    """
    pages = pages.repartition(tasks_for(pages), *PAGE)
    pattern = word_pattern()
    raw = F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(0))
    parts = pages.select(
        *PAGE, F.posexplode(F.arrays_zip(F.split("content", pattern, -1).alias("gap"), raw.alias("word"))).alias("i", "p")
    )
    at = Window.partitionBy(*PAGE).orderBy("i")
    size = F.length("p.gap") + F.coalesce(F.length("p.word"), F.lit(0))
    ends = parts.withColumn("end", F.sum(size).over(at)).select(
        *PAGE, "i", "p.gap", fold(F.col("p.word")).alias("word"), (F.col("end") - F.length("p.word")).cast("int").alias("begin"), F.col("end").cast("int").alias("end")
    )
    kept = ends.where("word <> ''").withColumn("n", F.row_number().over(at) - 1)
    opens = (F.col("n") == 0) | F.col("gap").rlike(SENTENCE_END)
    words = kept.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct(F.col("n").alias("i"), "word", "begin", "end", opens.alias("opens")))).alias("words")
    )
    empty = F.array().cast("array<struct<i:int,word:string,begin:int,end:int,opens:boolean>>")
    return pages.join(words, PAGE, "left").withColumn("words", F.coalesce("words", empty))


def unit_hits(words: Column, units: Column) -> Column:
    """array<struct<k, u, len>>: first word, unit and words of every place where a unit stands, in order."""
    folded = F.transform(words, lambda w: w["word"])
    box = F.array(F.struct(folded.alias("f")))

    def at(b: Column) -> Column:
        def of(word: Column, k: Column) -> Column:
            def stands(u: Column) -> Column:
                size = F.size(u["words"])
                same = (word == F.get(u["words"], F.lit(0))) & ((size == 1) | (F.slice(b["f"], k + 1, F.greatest(size, F.lit(1))) == u["words"]))
                return F.when(u["is_prefix"], F.startswith(word, F.get(u["words"], F.lit(0)))).otherwise(same)

            marked = F.transform(units, lambda u, i: F.struct(stands(u).alias("stands"), k.alias("k"), i.alias("u"), F.size(u["words"]).alias("len")))
            return F.transform(F.filter(marked, lambda m: m["stands"]), lambda m: F.struct(m["k"].alias("k"), m["u"].alias("u"), m["len"].alias("len")))

        return F.flatten(F.transform(b["f"], of))

    return F.get(F.transform(box, at), F.lit(0))


def _places(hits: DataFrame, n: int, most_units: int) -> DataFrame:
    """(query, page, start, runs): where the best window of ``n`` words begins, and overlapping hits as one run each.

    ``hits``: (query, page, dl, k, u, len), with u null for the sentence starts. Windows begin at a hit, placed so that
    the hits lie in the middle, or at the sentence of a hit; of equal scores the first in the order of hits wins.
    """
    ordered = Window.partitionBy(*AT).orderBy("k")
    ahead = ordered.rangeBetween(Window.currentRow, n - 1)
    hit = F.col("u").isNotNull()
    # Different units of a window: one bit for each.
    bits = [
        F.bit_count(F.coalesce(F.bit_or(F.when(F.col("u").between(i, i + 59), F.expr(f"shiftleft(1L, u - {i})"))).over(ahead), F.lit(0).cast("bigint")))
        for i in range(0, most_units, 60)
    ]
    different = reduce(lambda a, b: a + b, bits)
    scored = hits.select(
        "*",
        (FIRST_HIT * different + REPEAT_HIT * (F.count("u").over(ahead) - different)).alias("score"),
        F.max(F.when(hit, F.struct("k", "u", (F.col("k") + F.col("len")).alias("end")))).over(ahead)["end"].alias("last"),
    )
    back = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sentence = F.when(~hit, F.struct(F.col("k").alias("at"), F.col("score").alias("score")))
    by_hit = Window.partitionBy(*AT).orderBy("k", "u")
    before = F.max(F.col("k") + F.col("len") - 1).over(by_hit.rowsBetween(Window.unboundedPreceding, -1))
    told = scored.withColumn("sentence", F.max(sentence).over(back)).withColumn("fresh", hit & (before.isNull() | (F.col("k") > before)))
    told = told.withColumn("run", F.count_if("fresh").over(by_hit.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    told = told.withColumn("run_last", F.max(F.col("k") + F.col("len") - 1).over(Window.partitionBy(*AT, "run"))).where(hit)
    spare = F.lit(n) - (F.col("last") - F.col("k"))
    middle = F.col("k") - F.when(spare >= 0, F.floor(spare / 2)).otherwise(F.ceil(spare / 2)).cast("int")
    place = F.greatest(F.lit(0), F.least(middle, F.col("dl") - n))
    here = F.struct(F.col("score").cast("bigint").alias("score"), (-F.col("k")).alias("k"), (-F.col("u")).alias("u"), F.lit(0).alias("b"), place.cast("int").alias("start"))
    bonus = F.when(F.col("sentence.at") == 0, TEXT_START).otherwise(SENTENCE_START)
    there = F.struct(
        (F.col("sentence.score") + bonus).cast("bigint").alias("score"), (-F.col("k")).alias("k"), (-F.col("u")).alias("u"), F.lit(-1).alias("b"), F.col("sentence.at").alias("start")
    )
    tried = F.when((F.col("dl") > n) & (F.col("sentence.at") < F.col("k")), F.greatest(here, there)).otherwise(here)
    run = F.when(F.col("fresh"), F.struct(F.col("k").alias("first"), F.col("run_last").alias("last")))
    return told.groupBy(*AT).agg(F.max(tried)["start"].alias("start"), F.sort_array(F.collect_list(run)).alias("runs"))


def _cut_out(n: int, marks: tuple[str, str], cut: str) -> Column:
    """The fragment out of content, words, start and runs (array<struct<first, last>> in order)."""
    dl = F.size("words")
    end = F.least(F.col("start") + n, dl) - 1
    text = lambda a, b: F.substring(F.col("content"), a + 1, F.greatest(b - a, F.lit(0)))
    begin = F.when(F.col("start") > 0, F.get("words", F.col("start"))["begin"]).otherwise(F.lit(0))
    shown = F.filter("runs", lambda r: r["first"].between(F.col("start"), end))
    spans = F.transform(
        shown, lambda r: F.struct(F.get("words", r["first"])["begin"].alias("a"), F.get("words", F.least(r["last"], end))["end"].alias("b"))
    )
    box = F.array(F.struct(spans.alias("s")))

    def pieces(x: Column) -> Column:
        marked = F.transform(
            x["s"],
            lambda s, i: F.concat(
                text(F.when(i == 0, begin).otherwise(F.get(x["s"], i - 1)["b"]), s["a"]), F.lit(marks[0]), text(s["a"], s["b"]), F.lit(marks[1])
            ),
        )
        at = F.coalesce(F.get(x["s"], F.size(x["s"]) - 1)["b"], begin)
        whole = end >= dl - 1
        rest = F.when(whole, text(at, F.length("content"))).otherwise(F.concat(text(at, F.get("words", end)["end"]), F.lit(cut)))
        return F.concat(F.when(F.col("start") > 0, F.lit(cut)).otherwise(F.lit("")), F.array_join(marked, ""), rest)

    return F.get(F.transform(box, pieces), F.lit(0))


def fragments(rows: DataFrame, n: int, marks: tuple[str, str], cut: str, most_units: int) -> DataFrame:
    """(query_id, doc_id, page_num, snippet) of rows (query_id, doc_id, page_num, content, words, units), one for each query and page.

    ``units`` is array<struct<words array<string>, is_prefix boolean>>, the words already folded; no row has more than
    ``most_units``.
    """
    sentences = F.transform(F.filter("words", lambda w: w["opens"]), lambda w: F.struct(w["i"].alias("k"), F.lit(None).cast("int").alias("u"), F.lit(None).cast("int").alias("len")))
    found = rows.select(*AT, F.size("words").alias("dl"), unit_hits(F.col("words"), F.col("units")).alias("hits"), sentences.alias("sentences"))
    narrow = found.where(F.size("hits") > 0).select(*AT, "dl", F.explode(F.concat("hits", "sentences")).alias("h")).select(*AT, "dl", "h.*")
    places = _places(narrow.repartition(tasks_for(rows), *AT), n, max(1, most_units))
    none = F.array().cast("array<struct<first:int,last:int>>")
    ready = rows.join(places, AT, "left").withColumn("start", F.coalesce("start", F.lit(0))).withColumn("runs", F.coalesce("runs", none))
    return ready.select(*AT, _cut_out(n, marks, cut).alias("snippet"))
