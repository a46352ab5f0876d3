"""Near-duplicates by HyperMinHash: banded sketches, corrected estimates, verification on full shingle sets.

Documents with equal shingle sets form a class, and only classes are compared. Bands of registers throw classes into
buckets; of each bucket, the class that meets most others anywhere is the hub, and all members are compared with it.
That is linear in the rows and joins most groups, since copies are closest to what they were copied from. Members that
are not joined to their hub are then compared with all other members of the hub, block by block: on their registers, and
where the estimate lets a pair pass, on the full sets. Every pair of a bucket is so either joined already or compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import in_batches, query
from foliant.llm.repeats import forget, settle, tagged
from foliant.llm.sketches import BANDS, REGISTERS, ROWS, estimate, sets_of, sketching

if TYPE_CHECKING:
    import pyarrow as pa

PERCENT = 80
WORDS = 5
BLOCK = 128  # classes in a block that is compared by registers
SET_BLOCK = 64  # .. and by full sets
SIGMAS = 6  # standard deviations by which an estimate may miss the similarity


def least_estimate(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Estimates below this are out: the bound is ``SIGMAS`` deviations below the similarity asked for.

    Registers of small sets repeat their few values, so the sample is no larger than the set.
    """
    share = percent / 100
    return share - SIGMAS * np.sqrt(share * (1 - share) / np.minimum(REGISTERS, np.maximum(sizes, 1)))


def _size_allows(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _estimating(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, size_a, registers_a, b, ..) that the estimate lets pass."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            size_a, size_b = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            near = estimate(_registers(batch.column("registers_a")), _registers(batch.column("registers_b")))
            good = (near >= least_estimate(np.minimum(size_a, size_b), percent)) & _size_allows(size_a, size_b, percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return keep


def _members(block: pa.StructArray) -> tuple[list[bytes], list[bytes], np.ndarray]:
    return block.field("node").to_pylist(), block.field("component").to_pylist(), block.field("n_shingles").to_numpy()


def _comparing(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of a hub's members (``here``: outside its component; ``there``: all) to the members that may have a link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for hub, here, there in zip(batch.column("hub"), batch.column("here"), batch.column("there"), strict=True):
                    one, two = here.values, there.values
                    (nodes_one, groups_one, sizes_one), (nodes_two, groups_two, sizes_two) = _members(one), _members(two)
                    all_one, all_two = _registers(one.field("registers")), _registers(two.field("registers"))
                    number = {g: k for k, g in enumerate({*groups_one, *groups_two})}
                    of_two = np.array([number[g] for g in groups_two])
                    hit = np.zeros(len(nodes_two), bool)
                    for i, node in enumerate(nodes_one):
                        good = estimate(all_two, all_one[i]) >= least_estimate(np.minimum(sizes_two, sizes_one[i]), percent)
                        good &= _size_allows(sizes_two, sizes_one[i], percent) & (of_two != number[groups_one[i]])
                        hit |= good
                        if good.any():
                            yield hub.as_py(), node
                    for j in np.flatnonzero(hit):
                        yield hub.as_py(), nodes_two[j]

        yield from in_batches(rows(), pa.schema([("hub", pa.binary()), ("node", pa.binary())]))

    return compare


def _linking(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of members with their full sets to links, for each member one link to each component it is linked with."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for here, there in zip(batch.column("here"), batch.column("there"), strict=True):
                    one, two = here.values, there.values
                    (nodes_one, groups_one, sizes_one), (nodes_two, groups_two, sizes_two) = _members(one), _members(two)
                    members = np.frombuffer(b"".join(two.field("members").to_pylist()), np.uint64)
                    owner = np.repeat(np.arange(len(nodes_two)), sizes_two)
                    order = np.argsort(members, kind="stable")
                    members, owner = members[order], owner[order]
                    for i, own in enumerate(one.field("members").to_pylist()):
                        own = np.frombuffer(own, np.uint64)
                        first, after = np.searchsorted(members, own, "left"), np.searchsorted(members, own, "right")
                        count = after - first
                        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                        common = np.bincount(owner[at], minlength=len(nodes_two))
                        near = 100 * common >= percent * (sizes_one[i] + sizes_two - common)
                        linked = {groups_two[j]: nodes_two[j] for j in np.flatnonzero(near) if groups_two[j] != groups_one[i]}
                        for other in linked.values():
                            yield nodes_one[i], other

        yield from in_batches(rows(), pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return link


def _shingling(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, pairs) to one row for each pair with the whole set of the text."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = (
                (pair["a"], pair["b"], members)
                for text, pairs in zip(batch.column("text").cast(pa.binary()), batch.column("pairs").to_pylist(), strict=True)
                for members in [sets_of([text.as_py()], words)[0].tobytes()]
                for pair in pairs
            )
            yield from in_batches(rows, pa.schema([("a", pa.binary()), ("b", pa.binary()), ("members", pa.binary())]))

    return shingle


def _verifying(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            good = []
            for both in batch.column("sets"):
                one, two = (np.frombuffer(m.as_py(), np.uint64) for m in both.values)
                common = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): every node of the edges (a, b) with the least node that can be reached from it.

    Alternates large-star and small-star steps until the edges are stars around the least nodes. Each step is a
    grouped minimum and a join; edges are written to the shared folder after each round.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges.sparkSession, now, large)
        now = after
        if mark == seen:
            break
        seen = mark
    least_nodes = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least_nodes).distinct()


def _blocks(named: DataFrame, facts: DataFrame, column: str, size: int) -> DataFrame:
    """(hub, here, there): every block of a hub's members outside its component with every block of all its members."""
    counts = named.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outside").cast("int")).alias("n_outside"))
    counts = settle(counts.where("n_outside > 0 AND n > 1"), "near-sizes")
    rows = settle(named.join(counts, "hub").join(facts, "node"), "near-open")
    number = lambda n, salt: F.expr(f"pmod(xxhash64({salt}, node), CAST(ceil({n} / {size}) AS BIGINT))")
    packed = F.collect_list(F.struct("node", "component", "n_shingles", column))
    here = rows.where("outside").groupBy("hub", number("n_outside", 1).alias("i")).agg(packed.alias("here"))
    there = rows.groupBy("hub", number("n", 2).alias("j")).agg(packed.alias("there"))
    return here.join(there, "hub").select("hub", "here", "there")


def _sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, n_shingles, members): the full sets of some classes."""
    wanted = nodes.join(classes.select("node", "n_shingles", "one"), "node")
    found = (
        texts.alias("t")
        .join(wanted.alias("w"), F.expr("t.doc_id <=> w.one.doc_id AND t.tag = w.one.tag"))
        .select("t.text", F.expr("array(struct(w.node AS a, w.node AS b)) AS pairs"), "w.n_shingles")
    )
    made = found.mapInArrow(_shingling(words), "a binary, b binary, members binary")
    # Rows that repeat an id and a text bring the same set twice.
    return made.groupBy(F.col("a").alias("node")).agg(F.min("members").alias("members")).withColumn(
        "n_shingles", F.expr("CAST(octet_length(members) DIV 8 AS BIGINT)")
    )


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are near enough."""
    ends = pairs.select(F.col("a").alias("node"), "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "a", "b"))
    wanted = (
        ends.join(classes.select("node", "one"), "node")
        .groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.tag").alias("tag"), F.pmod(F.xxhash64("a", "b"), F.lit(64)).alias("part"))
        .agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    )
    # Rows that repeat an id and a text would bring a set twice; sets of a pair are two different ones.
    found = (
        texts.alias("t")
        .join(wanted.alias("w"), F.expr("t.doc_id <=> w.doc_id AND t.tag = w.tag"))
        .select("t.text", "w.pairs")
        .mapInArrow(_shingling(words), "a binary, b binary, members binary")
    )
    both = found.groupBy("a", "b").agg(F.collect_set("members").alias("sets")).where("size(sets) = 2")
    return both.mapInArrow(_verifying(percent), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``words`` words after lower-casing A-Z; with fewer words, all of
    them as one; null, empty and blank texts have an empty set, which is linked with nothing. Two documents are linked
    if their sets share at least ``percent`` of their union; component_id is the smallest doc_id reachable over links,
    and kept says that it is the document's own. Rows without id are linked like others but name no component unless
    nothing else is there. Candidates come from bands: a link at 85 percent is missed with a probability below 1e-8, one
    at just 80 percent below 1e-5. There is no bound on a group or on links.
    """
    return _decided(tagged(docs, id_col, text_col), percent, words).select(
        "doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept")
    )


def _decided(texts: DataFrame, percent: int, words: int) -> DataFrame:
    """(doc_id, tag, n_shingles, component, component_id) of rows of ``tagged``; component is null for empty sets."""
    spark = texts.sparkSession
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, tag bigint, n_shingles bigint, node binary, registers binary"
    sketches = settle(texts.mapInArrow(sketching(words), rows), "near-sketches")
    classes = settle(
        sketches.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("lowest"),
            F.min(F.struct("doc_id", "tag")).alias("one"),
            F.min("n_shingles").alias("n_shingles"),
            F.min("registers").alias("registers"),
        ),
        "near-classes",
    )
    bands = classes.select(
        "node",
        F.posexplode(F.array(*[F.expr(f"xxhash64({i}, substring(registers, {1 + ROWS * i}, {ROWS}))") for i in range(BANDS)])).alias("band", "bucket"),
    ).select("bucket", "node")
    # Grouped sides are written before they are joined: then both sides of each join are plain exchanges, and Spark can
    # split the partitions of hot buckets and hubs.
    crowds = settle(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-crowds")
    met = settle(bands.join(crowds, "bucket"), "near-buckets")
    fame = met.groupBy("node").agg(F.sum("n").alias("fame"))
    hubs = met.join(fame, "node").groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("hub")).select("bucket", "hub.node")
    hubs = settle(hubs, "near-hubs")
    members = settle(
        met.join(hubs.withColumnRenamed("node", "hub"), "bucket").where("node <> hub").select("hub", "node").distinct(), "near-members"
    )
    forget(spark, crowds, met, hubs)

    facts = classes.select("node", "n_shingles", "registers")
    side = lambda name, as_: facts.select(F.col("node").alias(name), F.col("n_shingles").alias(f"size_{as_}"), F.col("registers").alias(f"registers_{as_}"))
    allowed = F.expr(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    close = (
        members.join(side("node", "a"), "node")
        .join(side("hub", "b"), "hub")
        .where(allowed)
        .withColumnsRenamed({"node": "a", "hub": "b"})
        .mapInArrow(_estimating(percent), "a binary, b binary")
    )
    pairs = settle(close, "near-pairs")
    links = settle(_verified(pairs, classes, texts, percent, words), "near-links")
    joined = components(links)

    # Members outside their hub's component meet all members of the hub: first by registers, to find those that may have
    # a link, and these by their full sets.
    grouped = members.unionByName(members.select("hub", F.col("hub").alias("node")).distinct())
    named = (
        grouped.join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(joined.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
        .withColumn("outside", F.col("component") != F.coalesce("hub_component", "hub"))
        .select("hub", "node", "component", "outside")
    )
    named = settle(named, "near-grouped")
    by_registers = _blocks(named, facts, "registers", BLOCK).mapInArrow(_comparing(percent), "hub binary, node binary")
    hopeful = settle(named.join(by_registers.distinct(), ["hub", "node"]), "near-hopeful")
    sets = _sets(hopeful.select("node").distinct(), classes, texts, words)
    more = settle(_blocks(hopeful, sets, "members", SET_BLOCK).mapInArrow(_linking(percent), "a binary, b binary").distinct(), "near-links")
    final = components(links.unionByName(more))

    named_classes = (
        classes.select("node", "lowest")
        .join(final, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named_classes = settle(named_classes, "near-named")
    lowest = named_classes.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_node = named_classes.join(lowest, "component").select("node", "component", "component_id")
    return (
        sketches.join(by_node, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "tag", "n_shingles", "component", "component_id")
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS
) -> DataFrame:
    """The whole rows of one document of each component that ``near_duplicates`` finds.

    It is the one with the smallest id, a row without id only where none has one; of rows that share this id, the one with the
    smallest digest of its text. Texts without words are alike to none and stay. A row that is repeated whole, or with other values in
    other columns, stays once. Columns of any name may be there; an empty table stays empty.
    """
    key = lambda doc_id, tag: F.concat_ws("=", F.hex(tag), doc_id.cast("string"))  # noqa: E731  concat_ws leaves a null id out
    decided = _decided(tagged(docs, id_col, text_col), percent, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")).alias("first")
    chosen = decided.where("component IS NOT NULL").groupBy("component").agg(first).select("first.doc_id", "first.tag")
    kept = chosen.unionByName(decided.where("component IS NULL").select("doc_id", "tag"))
    kept = kept.select(key(F.col("doc_id"), F.col("tag")).alias("key")).distinct()
    tag = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))  # as in ``tagged``
    rows = docs.select(key(F.col(f"`{id_col}`"), tag).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*[F.col(f"row.`{c}`") for c in docs.columns])


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=3)
