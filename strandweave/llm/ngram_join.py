"""N-gram Jaccard join through a count-vector R-tree, and the components of its links.

1. Texts become sets of shingle hashes; rows of one set go on as one node.
2. Every set lists the shingles of its prefix, in an order common to all sets that puts frequent
   shingles last: sets of the wanted similarity share one there. The nodes of a prefix shingle are a
   block; blocks of the same nodes are one.
3. In a block an R-tree over count vectors finds the pairs that may be similar.
4. Pairs are verified on the whole sets, and links joined to components. Rounds in which each component
   offers only its likeliest partners come first, so a large group of near copies is soon one
   component without all of its pairs; the last round takes all pairs between different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.batches import given_back, whole_groups
from strandweave.llm.common import join_groups, packed, text_of, unpacked
from strandweave.llm.components import connected_components
from strandweave.llm.count_tree import (
    PAIRS,
    CountTree,
    bounds,
    count_vector,
    shingle_sets,
    similar_enough,
    unpacked_vectors,
)
from strandweave.llm.exact_dedup import filter_blocks, probe, repeated_bits
from strandweave.llm.subwords import chunks
from strandweave.session import save_scratch, ship_package

WORDS, PERCENT = 5, 80
#: A shingle of more than one set in so many counts as frequent and comes late in the order of shingles.
FREQUENT_SHARE = 1000
#: Nodes of a block that are searched together.
CHUNK = 1024
#: Likeliest partners that a component offers in a round.
PARTNERS = 3
#: Bytes of rows that a task searches at a time.
TASK_BYTES = 8 << 20
OWN = ("n_shingles", "component_id")


def set_signatures(docs: DataFrame, words: int) -> DataFrame:
    """``(id, n, signature)`` of ``(id, text)``: the set's size and a digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                sets = shingle_sets(texts, words)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                    ],
                    ["id", "n", "signature"],
                )

    return docs.mapInArrow(lambda batches: given_back(run(batches)), "id long, n long, signature binary")


def frequent_shingles(docs: DataFrame, words: int, n_docs: int) -> DataFrame:
    """``(shingle, n)``: shingles of over one row in ``FREQUENT_SHARE``, as far as batches show them.

    They only shape the order of shingles, on which no result depends. There are at most
    ``FREQUENT_SHARE`` times the mean set size of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(1)):
                sets = shingle_sets(texts, words)
                shingles, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= max(3, len(sets) // (2 * FREQUENT_SHARE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"]
                )

    counted = docs.mapInArrow(lambda batches: given_back(run(batches)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") * FREQUENT_SHARE > n_docs).filter("n > 10")


def sketches(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``(id, n, vector, prefix)`` of sets; ``frequent`` shingles, rarest first, end the order."""
    by_shingle = np.argsort(frequent)
    known = frequent[by_shingle]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                sets = shingle_sets(texts, words)
                prefixes, vectors = [], []
                for s in sets:
                    length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[at] == s
                        late = np.argsort(by_shingle[at[often]], kind="stable")
                        s = np.concatenate([s[~often], s[often][late]])
                    prefixes.append(s[:length].view(np.int64))
                    vectors.append(count_vector(s))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(vectors, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "vector", "prefix"],
                )

    return docs.mapInArrow(lambda batches: given_back(run(batches)), "id long, n long, vector binary, prefix array<long>")


def shared_blocks(prefixes: DataFrame, percent: int) -> DataFrame:
    """``(block, id, n, size)`` from ``(id, n, prefix)``: nodes that share a prefix shingle.

    Blocks whose sizes rule out any pair are left out, and of blocks with the same nodes one stays.
    """
    rows = prefixes.select("id", "n", F.explode("prefix").alias("block"))
    block = Window.partitionBy("block")
    low = F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1))
    shared = rows.select(
        "block",
        "id",
        "n",
        F.count(F.lit(1)).over(block).alias("size"),
        F.min("id").over(block).alias("least"),
        F.sum(low).over(block).alias("mark"),
        F.sum(low * (F.col("id") % 1009 + 1) % 1_000_003).over(block).alias("mark_2"),
    ).filter("size > 1")
    shared = save_scratch(shared)
    # Of two nodes, both sizes are known here.
    sizes = shared.groupBy("size", "least", "mark", "mark_2", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    possible = sizes.filter((F.col("size") > 2) | (100 * F.col("low") >= percent * F.col("high")))
    first = possible.groupBy("size", "least", "mark", "mark_2").agg(F.min("block").alias("block")).select("block")
    return shared.join(first, "block", "left_semi").select("block", "id", "n", "size")


def _groups(blocks: DataFrame, everything: bool, salt: int) -> DataFrame:
    """Rows ``(place, block, part_a, part_b, part, id, label)`` dealt into groups of about ``CHUNK`` nodes.

    In a round a large block is dealt by hash. With ``everything`` each pair of nodes of different
    labels meets: a block's commonest label is dealt into parts of its own, which meet all parts of
    the other nodes but not each other.
    """
    hashed = F.xxhash64("id", F.lit(salt))
    if not everything:
        part = F.pmod(hashed, F.ceil(F.col("size") / CHUNK)).cast("int")
        return blocks.select("block", part.alias("part_a"), part.alias("part_b"), part.alias("part"), "id", "label")
    by_label = blocks.groupBy("block", "label").agg(F.count(F.lit(1)).alias("m"))
    main = by_label.groupBy("block").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("size"))
    main = main.select("block", "size", F.col("top.label").alias("main"), F.col("top.m").alias("m"))
    rows = blocks.select("block", "id", "label").join(main, "block")
    n_main, n_rest = F.ceil(F.col("m") / CHUNK), F.ceil((F.col("size") - F.col("m")) / CHUNK)
    is_main = F.col("label") == F.col("main")
    rows = rows.withColumn("n_main", n_main.cast("int")).withColumn("n_parts", (n_main + n_rest).cast("int"))
    part = F.when(is_main, F.pmod(hashed, n_main)).otherwise(n_main + F.pmod(hashed, F.greatest(n_rest, F.lit(1))))
    rows = rows.withColumn("part", part.cast("int"))
    others = F.when(
        F.col("part") < F.col("n_main"), F.sequence("n_main", F.col("n_parts") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("n_parts") - 1))
    met = rows.withColumn("other", F.explode(others))
    return met.select(
        "block", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "id", "label"
    )


def _search(table: pa.Table, percent: int, partners: int | None) -> pa.RecordBatch:
    """Pairs of nodes with different labels that may be similar, from rows sorted by ``place``.

    Rows ``(a, b, null)``, and ``(null, null, block)`` for blocks that had more pairs than ``partners`` let through.
    """
    place = table["place"].to_numpy()
    ids, labels, part = table["id"].to_numpy(), table["label"].to_numpy(), table["part"].to_numpy()
    first_part, second_part = table["part_a"].to_numpy(), table["part_b"].to_numpy()
    sizes = table["n"].to_numpy()
    vectors = unpacked_vectors(table["vector"].to_pylist())
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    ends = np.append(starts[1:], len(place))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held, found = [0], []

    def bound() -> None:
        """Keep, with what they may share, those of the held pairs whose finest bound is high enough."""
        a, b = (np.concatenate(parts) for parts in zip(*held, strict=True))
        held.clear()
        n_held[0] = 0
        most = bounds(vectors, a, b)
        enough = similar_enough(most, sizes[a] + sizes[b], percent)
        found.append((a[enough], b[enough], most[enough]))

    def hold(a: np.ndarray, b: np.ndarray) -> None:
        wanted = (labels[a] != labels[b]) & (ids[a] != ids[b])
        # Two parts meet to be compared with each other; each with itself has its own group.
        wanted &= (first_part[a] == second_part[a]) | (part[a] != part[b])
        wanted &= (100 * sizes[a] >= percent * sizes[b]) & (100 * sizes[b] >= percent * sizes[a])
        held.append((a[wanted], b[wanted]))
        n_held[0] += len(held[-1][0])
        if n_held[0] >= 4 * PAIRS:
            bound()

    twos = starts[ends - starts == 2]
    hold(twos, twos + 1)
    for begin, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - begin > 2 and (labels[begin:end] != labels[begin]).any():
            for left, right in CountTree(sizes[begin:end], vectors[begin:end], percent).parts():
                hold(left + begin, right + begin)
    held.append((twos[:0], twos[:0]))
    bound()
    a, b, most = (np.concatenate(parts) for parts in zip(*found, strict=True))
    cut = np.empty(0, np.int64)
    if partners is not None and len(a):
        # The likeliest pairs of each label of each group.
        share = most / (sizes[a] + sizes[b] - most)
        kept = np.zeros(len(a), bool)
        for one in (a, b):
            order = np.lexsort((-share, labels[one], place[one]))
            new = np.concatenate(
                [[True], (labels[one][order][1:] != labels[one][order][:-1]) | (place[one][order][1:] != place[one][order][:-1])]
            )
            begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            kept[order[np.arange(len(order)) - begin < partners]] = True
        cut = np.unique(table["block"].to_numpy()[a[~kept]])
        a, b = a[kept], b[kept]
    low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    none = lambda n: pa.nulls(n, pa.int64())
    columns = [(pa.array(low), none(len(cut))), (pa.array(high), none(len(cut))), (none(len(low)), pa.array(cut))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(parts) for parts in columns], ["a", "b", "block"])


def candidates(groups: DataFrame, vectors: DataFrame, percent: int, partners: int | None) -> DataFrame:
    """Distinct rows of ``_search`` over all groups; ``partners`` limits a round's offers."""
    rows = groups.join(vectors, "id")
    rows = rows.withColumn("place", F.xxhash64("block", "part_a", "part_b"))
    rows = rows.repartition("place").sortWithinPartitions("place", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "place", TASK_BYTES):
            yield _search(table, percent, partners)

    rows = rows.select("place", "block", "part_a", "part_b", "part", "id", "label", "n", "vector")
    return rows.mapInArrow(lambda batches: given_back(run(batches)), "a long, b long, block long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity. ``texts`` is a saved ``(id, text)``.

    A node paired with very many others is copied once for each thousand of them, so that no join key is hot.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("n_copies"))
    dealt = pairs.join(load, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("n_copies")).cast("int"))
    left = texts.join(load, texts["id"] == load["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"), F.col("text").alias("text_a")
    )
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = dealt.select("a", "copy", "b").join(right, "b").join(left, ["a", "copy"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for first, some in chunks(batch.column("text_a")):
                one = shingle_sets(some, words)
                other = shingle_sets(batch.column("text_b").slice(first, len(one)), words)
                for i, (x, y) in enumerate(zip(one, other, strict=True)):
                    shared = np.intersect1d(x, y, assume_unique=True).size
                    if similar_enough(shared, len(x) + len(y), percent):
                        kept.append(first + i)
            chosen = batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], ["a", "b"])

    return both.mapInArrow(lambda batches: given_back(run(batches)), "a long, b long").distinct()


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``(id, text)`` rows whose id is not among ``dropped``; a Bloom filter spares the others a shuffle."""
    n_blocks = filter_blocks(dropped.count(), 16, 1 << 28)
    named = dropped.select(F.col("id").cast("string").alias("name"))
    # Each name twice, as the filter holds what is there more than once.
    bitmaps = save_scratch(repeated_bits(named.unionByName(named), "name", n_blocks))
    probed = probe(docs.withColumn("name", F.col("id").cast("string")), "name", bitmaps, n_blocks)
    probed = probed.select("doc.id", "doc.text", "maybe")
    clear = probed.filter(~F.col("maybe")).select("id", "text")
    return clear.unionByName(probed.filter("maybe").select("id", "text").join(dropped, "id", "left_anti"))


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, text)`` rows whose id is among ``wanted``, found like in ``_without``."""
    n_blocks = filter_blocks(wanted.count(), 16, 1 << 28)
    named = wanted.select(F.col("id").cast("string").alias("name"))
    bitmaps = save_scratch(repeated_bits(named.unionByName(named), "name", n_blocks))
    probed = probe(docs.withColumn("name", F.col("id").cast("string")), "name", bitmaps, n_blocks)
    return probed.filter("maybe").select("doc.id", "doc.text").join(wanted, "id", "left_semi")


def _labelled(blocks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Blocks with the component of each node; those of one component alone are left out."""
    if labels is None:
        return blocks.withColumn("label", F.col("id"))
    known = blocks.join(labels.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left")
    known = known.withColumn("label", F.coalesce("label", "id"))
    mixed = known.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("block")
    return known.join(mixed, "block", "left_semi")


def link_components(nodes: DataFrame, words: int = WORDS, percent: int = PERCENT, n_docs: int | None = None) -> DataFrame:
    """``(node, root)`` of ``(id, text)`` with distinct sets: components of two nodes and more."""
    n_docs = nodes.count() if n_docs is None else n_docs
    frequent = frequent_shingles(nodes, words, n_docs).orderBy("n", "shingle").collect()
    order = np.array([row.shingle for row in frequent], np.int64).view(np.uint64)
    sketch = save_scratch(sketches(nodes, words, percent, order).filter("n > 0"))
    vectors = sketch.select("id", "n", "vector")
    blocks = save_scratch(shared_blocks(sketch.select("id", "n", "prefix"), percent))
    links, labels, tested, salt, texts = None, None, None, 0, None
    everything = False
    while True:
        groups = _groups(_labelled(blocks, labels).drop("n"), everything, salt)
        searched = save_scratch(candidates(groups, vectors, percent, None if everything else PARTNERS))
        # Blocks searched whole, of which no pair was held back, are done.
        held_back = searched.filter("block IS NOT NULL").select("block")
        large = blocks.filter(F.col("size") > CHUNK).select("block")
        blocks = save_scratch(blocks.join(held_back.unionByName(large).distinct(), "block", "left_semi"))
        found = searched.filter("block IS NULL").select("a", "b")
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = save_scratch(found)
        ends = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = save_scratch(_only(nodes, save_scratch(ends)))
        new = save_scratch(verified(found, texts, words, percent))
        n_new = new.count()
        links = new if links is None else links.unionByName(new)
        tested = found if tested is None else tested.unionByName(found)
        if n_new:
            labels = save_scratch(connected_components(links))
        if everything:
            break
        salt += 1
        # When a round finds hardly anything, take all that is left.
        everything = n_new * 20 <= max(1, 0 if labels is None else labels.count())
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components_by_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row ``(id, n_shingles, component_id)`` per row of ``docs``.

    Texts whose shingle sets have a Jaccard similarity of ``percent`` are linked; ``component_id`` is the
    smallest id that links reach. Null and empty texts, and texts without words, are linked with nothing.
    Ids are whole numbers: a row without one is linked with nothing and has no component, rows that
    share one count as one node.
    """
    ship_package(docs.sparkSession)
    n_docs = docs.count()
    id_value = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(id_value.alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    signed = save_scratch(set_signatures(rows, words))
    real = signed.filter("n > 0 AND id IS NOT NULL")
    groups = real.groupBy("signature").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n_rows"))
    copies = groups.filter("n_rows > 1")
    # Of each set the row with the smallest id is its node; the others follow it.
    follows = join_groups(real.select("id", "signature"), copies, "signature", "n_rows", n_docs)
    follows = save_scratch(follows.filter("id <> node").select("id", "node").distinct())
    roots = link_components(_without(rows.filter("id IS NOT NULL"), follows.select("id").distinct()), words, percent, n_docs)
    led = follows.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows")).join(roots, "node", "left")
    led = save_scratch(led.withColumn("root", F.coalesce("root", "node")))
    moved = join_groups(follows, led, "node", "n_rows", max(1, follows.count())).select("id", "root")
    moved = moved.unionByName(roots.select(F.col("node").alias("id"), "root"))
    known = save_scratch(moved.groupBy("id").agg(F.min("root").alias("root")))
    return signed.join(known, "id", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Every row with ``n_shingles`` and ``component_id``, see ``components_by_id``.

    Rows that share an id get the largest of their set sizes. Columns named like an added one are replaced.
    """
    found = components_by_id(docs, id_col, text_col, **options)
    facts = found.groupBy(F.col("id").alias("__id")).agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    )
    rows = packed(docs).withColumn("__id", F.col(f"doc.`{id_col}`").cast("long"))
    return unpacked(rows.join(facts.filter("__id IS NOT NULL"), "__id", "left"), *OWN)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row of each component stays, the one with the smallest id, and every row without links.

    Rows that share the smallest id are one document here and all stay.
    """
    found = components_by_id(docs, id_col, text_col, **options)
    dropped = save_scratch(found.filter("id <> component_id").select(F.col("id").alias("__dropped")).distinct())
    return docs.join(dropped, docs[id_col].cast("long") == dropped["__dropped"], "left_anti")
