"""Inverted index over pages of text, kept as Parquet tables.

tokens    doc_id, page_num, cols, dl           one row per page: the words of each column, and how many in all
postings  bucket, term, column_id, doc_id, page_num, tf, dl, leads, positions
pairs     the same, for neighbouring frequent words; the term is both words with a blank between
vocab     term, df, cf
pair_vocab  term, df, cf
bounds    term, block, n, cf, most             of the postings by page length, see below
texts     part, doc_id, page_num, c0, c1 ..    the columns of the pages
stats     n_docs, total_tokens, avgdl, buckets, columns, frequent   one row

Postings are found inside each page (sort the words of some pages by word and page, cut at the changes), so no
shuffle is needed to build them. One shuffle lays them out: by hash bucket of the term, each
bucket spread over several files by page, sorted by term. Rows of one file travel together, as compressed Arrow batches. A word that stands on a third of all
pages is thereby written by many tasks, while a lookup reads one bucket folder and
skips row groups by the term's min/max. The page length is repeated in the postings, so scoring
joins no length table.

A page may have several columns; positions count inside a column, ``dl`` counts the whole page, and ``leads``
marks one posting of each word and page, so that pages with a word can be counted without a shuffle by page.

Pages of similar length form a block (``block_of``). For each word and block the index knows the number of postings and
the largest share that one of them can bring to a score; a ranked search leaves out blocks that cannot reach its best.

Texts are laid out by hash part of the document and sorted by page in each file, so the pages of a result are read from
their parts only. They are not shuffled: each task that reads them writes a file in every part.

An index lives in generations: each build writes a folder of its own, and a pointer file names the current one. A reader
keeps the generation it opened.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt
from typing import TYPE_CHECKING
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.scoring import length_share
from foliant.functions.text import tokens
from foliant.plans.sizing import SPLIT_BYTES, estimated_bytes, lookup_join, spread

if TYPE_CHECKING:
    import pyarrow as pa

MIN_PER_FILE, MAX_PER_FILE = 500_000, 2_000_000  # a task sorts the postings of one file, and should not spill
UNSPLIT_FILES = 16  # a smaller index is little work, however frequent a word
FREQUENT_WORDS = 2_048  # words that pair postings are kept for, at most
FREQUENT_PART = 20  # a word is frequent if one in so many pages has it
PAGE = ["doc_id", "page_num"]
WORDS_AT_ONCE = 1 << 20  # words that a task turns into postings at a time, or one page
PACK_ROWS = 2_000_000  # postings that a task deals out to files at a time
FILES_OF_PART = 4  # times the files by page, from which texts are shuffled
KEPT_SECONDS = 24 * 3600.0  # how long a replaced generation stays for those who read it


def tokenize_pages(pages: DataFrame, content: str = "content") -> DataFrame:
    toks = pages.select(*PAGE, tokens(F.col(content)).alias("toks"))
    return toks.withColumn("dl", F.size("toks"))


def tokenize_columns(pages: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, page_num, cols, dl): the words of each column, and their number in all columns."""
    cols = pages.select(*PAGE, F.array(*[tokens(F.col(f"`{c}`")) for c in columns]).alias("cols"))
    return cols.withColumn("dl", F.aggregate("cols", F.lit(0), lambda n, c: n + F.size(c)))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with a bounded number of words, or one page."""
    ends = np.cumsum(batch.column("dl").to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _rank(order: pa.Array) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank


def _inverted(part: pa.RecordBatch, frequent: list[str] | None) -> pa.RecordBatch | None:
    """Postings of the words of some pages, or of their pairs of frequent neighbours: sorted by word and page, cut at the changes.

    The order is that of the files, so that whoever sorts the rows of many parts only merges them.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = part.column("cols").flatten()
    words = texts.flatten().dictionary_encode()
    terms, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    n_columns, sizes = len(texts) // part.num_rows, pc.list_value_length(texts).to_numpy()
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if frequent is not None:
        often = pc.is_in(terms, value_set=pa.array(frequent, terms.type)).to_numpy(zero_copy_only=False)[code]
        first = np.flatnonzero(often[:-1] & often[1:] & (text[:-1] == text[1:]))
        both, code = np.unique(code[first] * len(terms) + code[first + 1], return_inverse=True)
        terms = pc.binary_join_element_wise(terms.take(pa.array(both // len(terms))), terms.take(pa.array(both % len(terms))), " ")
        text, at = text[first], at[first]
    if not len(code):
        return None
    page, column = text // n_columns, text % n_columns
    by_page = pc.sort_indices(part.select(PAGE), sort_keys=[(c, "ascending") for c in PAGE], null_placement="at_start")
    key = (_rank(pc.sort_indices(terms))[code] * part.num_rows + _rank(by_page)[page]) * n_columns + column
    order = np.argsort(key, kind="stable")  # places stay in order
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    offsets = np.append(starts, len(key)).astype(np.int32)
    at_page = key[starts] // n_columns
    leads = np.concatenate([[True], at_page[1:] != at_page[:-1]])
    here = order[starts]
    rows = pa.array(page[here])
    return pa.RecordBatch.from_arrays(
        [
            terms.take(pa.array(code[here])),
            pa.array(column[here].astype(np.int32)),
            *[part.column(c).take(rows) for c in PAGE],
            pa.array(np.diff(offsets)),
            part.column("dl").take(rows),
            pa.array(leads),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order].astype(np.int32))),
        ],
        ["term", "column_id", *PAGE, "tf", "dl", "leads", "positions"],
    )


def _postings(toks: DataFrame, cols: Column, frequent: list[str] | None, layout: Layout | None = None) -> DataFrame:
    """Postings as rows, or packed for the files of a layout."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                found = _inverted(part, frequent)
                if found is not None:
                    yield found

    def invert_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held, n = [], 0
        for found in invert(batches):
            held.append(found)
            n += found.num_rows
            if n >= PACK_ROWS:
                yield layout.packed(pa.concat_batches(held))
                held, n = [], 0
        if held:
            yield layout.packed(pa.concat_batches(held))

    page = ", ".join(f"{c} {toks.schema[c].dataType.simpleString()}" for c in PAGE)
    rows = toks.where(F.col("dl") > 0).select(*PAGE, "dl", cols.alias("cols"))
    if layout is None:
        return rows.mapInArrow(invert, f"term string, column_id int, {page}, tf int, dl int, leads boolean, positions array<int>")
    return rows.mapInArrow(invert_and_pack, PACKED)


def build_postings(toks: DataFrame) -> DataFrame:
    """(term, column_id, doc_id, page_num, tf, dl, leads, positions); nothing is shuffled."""
    return _postings(toks, F.array("toks") if "toks" in toks.columns else F.col("cols"), None)


def build_pairs(toks: DataFrame, frequent: list[str]) -> DataFrame:
    """Postings of neighbours that are both among the frequent words; the position is that of the first."""
    return _postings(toks, F.col("cols"), frequent)


PACKED = "file int, rows binary"
PACKING = {
    "compression": "zstd",
    "use_dictionary": ["term", "tf", "dl"],
    "column_encoding": {c: "DELTA_BINARY_PACKED" for c in (*PAGE, "positions.list.element")},
    "write_statistics": False,
    "store_schema": False,
}


@dataclass(frozen=True)
class Layout:
    """Files of a table: ``buckets`` folders by a key, each of ``splits`` files by page.

    crc32 is the same in Spark and in Python, so the folders of known words need no job.
    """

    buckets: int
    splits: int

    def packed(self, postings: pa.RecordBatch) -> pa.RecordBatch:
        """(file, rows): the postings of each file in their order, as a small Parquet file."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        terms = postings.column("term").dictionary_encode()
        folders = np.array([crc32(t.encode()) % self.buckets for t in terms.dictionary.to_pylist()], np.int64)
        file = folders[terms.indices.to_numpy()] * self.splits + self._split(postings)
        order = np.argsort(file, kind="stable")
        rows, file = postings.take(pa.array(order)), file[order]
        starts = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]]))
        packs = []
        for begin, end in zip(starts, [*starts[1:], len(file)]):
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_batches([rows.slice(begin, end - begin)]), sink, **PACKING)
            packs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(file[starts].astype(np.int32)), pa.array(packs, pa.binary())], ["file", "rows"])

    def _split(self, rows: pa.RecordBatch) -> np.ndarray:
        """By page only, so that a word of every page is spread over all files of its folder."""
        if self.splits == 1:
            return np.zeros(rows.num_rows, np.int64)
        import pyarrow.compute as pc

        mixed = np.zeros(rows.num_rows, np.uint64)
        for c in PAGE:
            values = pc.fill_null(rows.column(c).cast("int64"), -1).to_numpy(zero_copy_only=False).astype(np.uint64)
            mixed = (mixed ^ values) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(self.splits)).astype(np.int64)

    def unpacked(self, packs: DataFrame) -> DataFrame:
        """Postings of the packs, those of one file in one task, with their bucket."""
        splits = self.splits

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa
            import pyarrow.parquet as pq

            for batch in batches:
                for file, pack in zip(batch.column("file").to_pylist(), batch.column("rows")):
                    rows = pq.read_table(pa.BufferReader(pack.as_buffer()), use_threads=False)
                    bucket = pa.array(np.full(rows.num_rows, file // splits, np.int32))
                    yield from rows.append_column("bucket", bucket).to_batches()

        return packs.repartitionById(self.buckets * splits, F.col("file")).mapInArrow(unpack, _POSTINGS)


def vocabulary(postings: DataFrame) -> DataFrame:
    """Pages with the word in any column, and occurrences in all."""
    return postings.groupBy("term").agg(
        F.count_if("leads").alias("df"), F.sum("tf").cast("bigint").alias("cf")
    )


def corpus_stats(toks: DataFrame) -> DataFrame:
    """Pages without words count too."""
    return toks.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_tokens"),
    ).withColumn("avgdl", F.col("total_tokens") / F.greatest("n_docs", F.lit(1)))


def block_of(dl: Column) -> Column:
    """Pages whose lengths differ by less than a half or so share a block."""
    return F.floor(F.log2(F.greatest(dl, F.lit(1))) * 2).cast("int")


def block_bounds(postings: DataFrame, avgdl: Column, n_columns: int = 1) -> DataFrame:
    """(term, block, n, cf, most): pages, occurrences, and the largest share that those of one page have, idf left aside.

    A page's occurrences in all columns count together, so ``most`` takes the sum over columns from above.
    """
    share = length_share(F.col("tf"), F.col("dl"), avgdl)
    keys = ["term", "block", "column_id"] if n_columns > 1 else ["term", "block"]
    by_column = postings.withColumn("block", block_of(F.col("dl"))).groupBy(*keys).agg(
        F.count_if("leads").alias("n"), F.sum("tf").cast("bigint").alias("cf"), F.max(share).alias("most")
    )
    if n_columns == 1:
        return by_column
    return by_column.groupBy("term", "block").agg(*[F.sum(c).alias(c) for c in ("n", "cf", "most")])


def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Index:
    """Tables of an index, stored or computed from pages as needed.

    ``n_docs`` and ``avgdl`` are constants of a stored index and scalar subqueries otherwise. Only a stored index has pairs
    of its ``frequent`` words and bounds.
    """

    spark: SparkSession
    tokens: DataFrame
    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    pages: DataFrame
    n_docs: Column
    avgdl: Column
    columns: tuple[str, ...] = ("content",)
    buckets: int | None = None
    pairs: DataFrame | None = None
    pair_vocab: DataFrame | None = None
    bounds: DataFrame | None = None
    frequent: frozenset[str] = frozenset()
    texts: DataFrame | None = None
    path: str | None = None

    @classmethod
    def of(cls, pages: DataFrame, columns: tuple[str, ...] = ("content",)) -> "Index":
        toks = tokenize_columns(spread(pages), list(columns))
        postings, stats = build_postings(toks), corpus_stats(toks)
        n_docs, avgdl = stats.select("n_docs").scalar(), stats.select("avgdl").scalar()
        return cls(
            pages.sparkSession, toks, postings, vocabulary(postings), stats, pages, n_docs, avgdl, tuple(columns)
        )

    def doc_stats(self) -> DataFrame:
        return self.tokens.select(*PAGE, "dl")

    def texts_of(self, hits: DataFrame, column: str, known: list[int] | None) -> DataFrame:
        """(doc_id, page_num, content): a column of the pages that ``hits`` names, each page once.

        ``known`` are the documents, if few enough to be pushed into the scan as literals.
        """
        wanted = hits.select(*PAGE).distinct()
        table, name, keys = self.pages, f"`{column}`", PAGE
        if self.texts is not None:
            table, name, keys = self.texts, f"c{self.columns.index(column)}", ["part", *PAGE]
            wanted = wanted.withColumn("part", _bucket(F.col("doc_id").cast("string"), self.buckets))
            if known is not None:
                table = table.where(F.col("part").isin(sorted({crc32(str(d).encode()) % self.buckets for d in known})))
        if known is not None:
            table = table.where(F.col("doc_id").isin(known))
        found = lookup_join(table, wanted, keys, "left_semi", spread_by=PAGE, bounded_by=None if known is None else 0)
        return found.select(*PAGE, F.coalesce(name, F.lit("")).alias("content"))

    def of_terms(self, table: DataFrame, known: list[str]) -> DataFrame:
        """Rows of a term-keyed table whose words are known; folders of other words are not read."""
        if self.buckets and "bucket" in table.columns:
            table = table.where(F.col("bucket").isin(sorted({crc32(t.encode()) % self.buckets for t in known}))).drop("bucket")
        return table.where(F.col("term").isin(known))

    def lookup(self, table: DataFrame, terms: DataFrame, known: list[str] | None) -> DataFrame:
        """Rows of a term-keyed table joined to wanted terms; frequent words are split over tasks.

        ``known`` are the words, if few enough to be pushed into the scan as literals.
        """
        keys = ["term"]
        if self.buckets and "bucket" in table.columns:
            terms = terms.withColumn("bucket", _bucket(F.col("term"), self.buckets))
            keys = ["bucket", "term"]
            if known is not None:
                folders = {crc32(t.encode()) % self.buckets for t in known}
                table = table.where(F.col("bucket").isin(sorted(folders)))
        if known is not None:
            table = table.where(F.col("term").isin(known))
        return lookup_join(
            table,
            terms,
            keys,
            spread_by=PAGE if "doc_id" in table.columns else keys,
            bounded_by=None if known is None else 0,
        )


_POSTINGS = (
    "term string, column_id int, doc_id bigint, page_num int, tf int, dl int, leads boolean, positions array<int>, bucket int"
)
SCHEMAS = {
    "tokens": "doc_id bigint, page_num int, cols array<array<string>>, dl int",
    "postings": _POSTINGS,
    "pairs": _POSTINGS,
    "vocab": "term string, df bigint, cf bigint",
    "pair_vocab": "term string, df bigint, cf bigint",
    "texts": "doc_id bigint, page_num int, part int",  # and the columns
    "bounds": "term string, block int, n bigint, cf bigint, most double",
    "stats": "n_docs bigint, total_tokens bigint, avgdl double, buckets int, columns array<string>, frequent array<string>",
}


def _text_fields(n: int) -> str:
    return "".join(f", c{i} string" for i in range(n))


def _dealt_texts(texts: DataFrame, layout: Layout) -> DataFrame:
    """Texts stay in the tasks that read them, each of which writes a file in every part, unless that makes many small files."""
    if estimated_bytes(texts) <= FILES_OF_PART * layout.splits * SPLIT_BYTES:
        return spread(texts)
    file = F.col("part") * layout.splits + F.pmod(F.xxhash64(*PAGE), F.lit(layout.splits)).cast("int")
    return texts.repartitionById(layout.buckets * layout.splits, file)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def _layout(total_tokens: int, tokens_per_file: int | None, cores: int) -> tuple[int, int]:
    """(buckets, files in each). Both grow with the square root of the corpus, so that even the postings
    of one word on every page are written and read by many tasks."""
    if tokens_per_file is None:
        tokens_per_file = min(MAX_PER_FILE, max(MIN_PER_FILE, total_tokens // (4 * cores)))
    files = max(1, ceil(total_tokens / tokens_per_file))
    if files <= UNSPLIT_FILES:
        return files, 1
    return ceil(sqrt(files)), ceil(sqrt(files))


def write_index(
    pages: DataFrame,
    path: str,
    tokens_per_file: int | None = None,
    columns: tuple[str, ...] = ("content",),
    frequent_df: int | None = None,
) -> Index:
    """Write the tables under ``path``, which must be new.

    Words on ``frequent_df`` pages or more (by default on a twentieth of all), the most frequent ``FREQUENT_WORDS`` of them at
    most, get pair postings.
    """
    spark = pages.sparkSession

    def write(rows: DataFrame, name: str, *folders: str) -> None:
        made = rows.write.mode("errorifexists").option("compression", "zstd")
        (made.partitionBy(*folders) if folders else made).parquet(f"{path}/{name}")

    write(tokenize_columns(spread(pages), list(columns)), "tokens")
    toks = _read(spark, path, "tokens")
    totals = corpus_stats(toks).first()
    layout = Layout(*_layout(totals["total_tokens"], tokens_per_file, spark.sparkContext.defaultParallelism))

    def by_word(packs: DataFrame, name: str) -> DataFrame:
        write(layout.unpacked(packs).sortWithinPartitions("bucket", "term", *PAGE), name, "bucket")
        return _read(spark, path, name)

    def by_term(df: DataFrame, name: str) -> DataFrame:
        write(df.sortWithinPartitions("term"), name)
        return _read(spark, path, name)

    part = _bucket(F.col("doc_id").cast("string"), layout.buckets).alias("part")
    texts = pages.select(*PAGE, part, *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    write(_dealt_texts(texts, layout).sortWithinPartitions("part", *PAGE), "texts", "part")
    postings = by_word(_postings(toks, F.col("cols"), None, layout), "postings")
    bounds = by_term(block_bounds(postings, F.lit(totals["avgdl"]), len(columns)), "bounds")
    vocab = by_term(bounds.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")), "vocab")
    least = frequent_df if frequent_df is not None else max(2, totals["n_docs"] // FREQUENT_PART)
    often = vocab.where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(FREQUENT_WORDS)
    frequent = sorted(r["term"] for r in often.select("term").collect())
    pairs = by_word(_postings(toks, F.col("cols"), frequent, layout), "pairs")
    by_term(vocabulary(pairs), "pair_vocab")
    # Written last: a path with this table holds a whole index.
    summary = spark.createDataFrame([(*totals, layout.buckets, list(columns), frequent)], SCHEMAS["stats"])
    summary.coalesce(1).write.mode("errorifexists").parquet(f"{path}/stats")
    return open_index(spark, path)


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop(spark, path)
    return files.exists(target)


def open_index(spark: SparkSession, path: str) -> Index:
    """The whole index at ``path``."""
    tables = {n: _read(spark, path, n) for n in SCHEMAS if n != "texts"}
    known = tables["stats"].first()
    columns = tuple(known["columns"])
    texts = spark.read.schema(SCHEMAS["texts"] + _text_fields(len(columns))).parquet(f"{path}/texts")
    pages = texts.select(*PAGE, *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
    return Index(
        spark, tables["tokens"], tables["postings"], tables["vocab"], tables["stats"], pages,
        F.lit(known["n_docs"]), F.lit(known["avgdl"]), columns, known["buckets"], tables["pairs"],
        tables["pair_vocab"], tables["bounds"], frozenset(known["frequent"]), texts, path,
    )


# ---- generations ---------------------------------------------------------------------------------

POINTER = "CURRENT"


def current_generation(spark: SparkSession, base: str) -> str | None:
    """Folder of the generation that the pointer names, if there is one."""
    target, files = _hadoop(spark, f"{base}/{POINTER}")
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{base}/{name.strip()}"


def _point_to(spark: SparkSession, base: str, name: str) -> None:
    """Replace the pointer in one step: readers see the old name or the new one."""
    draft, files = _hadoop(spark, f"{base}/.{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(name.encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"), option)


def drop_generations(spark: SparkSession, base: str, older_than: float = KEPT_SECONDS) -> list[str]:
    """Delete generations that are not current and were last written more than ``older_than`` seconds ago."""
    target, files = _hadoop(spark, base)
    now, dropped = time.time(), []
    current = current_generation(spark, base)
    for status in files.listStatus(target) if files.exists(target) else []:
        name = status.getPath().getName()
        if name.startswith("gen-") and f"{base}/{name}" != current and now - status.getModificationTime() / 1000 > older_than:
            files.delete(status.getPath(), True)
            dropped.append(name)
    return dropped


def reload_index(pages: DataFrame, base: str, kept_seconds: float = KEPT_SECONDS, **options) -> Index:
    """Build a new generation, make it the current one, and drop those replaced more than ``kept_seconds`` ago.

    Whoever has opened an earlier generation goes on reading it. If two reloads run at once, each builds a
    generation of its own, and the one that ends last is current.
    """
    spark = pages.sparkSession
    name = f"gen-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    index = write_index(pages, f"{base}/{name}", **options)
    _point_to(spark, base, name)
    drop_generations(spark, base, kept_seconds)
    return index


def open_or_build_index(spark: SparkSession, base: str, pages: DataFrame | None, **options) -> Index:
    """Use the current index under ``base``; build it if missing; fail if there is no source either."""
    current = current_generation(spark, base)
    if current is not None:
        return open_index(spark, current)
    if pages is None:
        raise FileNotFoundError(f"no index at {base} and no pages to build it from")
    return reload_index(pages, base, **options)
