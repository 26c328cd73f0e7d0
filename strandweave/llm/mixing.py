"""Mixing of sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a 60-bit hash. A source takes whole copies of all its documents, and of one more
copy those documents whose hash is below a threshold that spends the rest of its budget. The threshold
is found digit by digit: sizes are summed by source and leading hash digit, the bucket in which the
budget runs out is found, and only that bucket is summed by its next digit. Nothing is sorted,
and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import join_groups, packed, text_of, unpacked
from strandweave.session import save_scratch

#: Hash digits, of 15 bits each.
DIGITS, DIGIT_BITS = 4, 15
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def hash60(*columns: Column) -> Column:
    """The first 15 hex digits of the MD5 of the joined values, as a number."""
    joined = F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """Never null and ordered by code point, with a null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(key, n_docs, source_size, target)`` of one row ``(key, n_docs, source_size)`` per source.

    The total is shared by weight; a source stops at ``most`` times its size and what it can't
    take is shared again among the others, which comes to min(most * size, level * weight) for the
    largest level (total - stopped) / (weights left) along the sources by most * size / weight.
    There is one row per source here, as in any list of weights, so the order needs one small task.
    """
    everything = Window.orderBy("key")
    place = F.row_number().over(everything) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long"))
    cap = F.col("source_size") * most
    below = Window.orderBy((cap / F.col("weight")), "key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(below), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    )
    levelled = weighed.withColumn("level", level)
    levelled = levelled.withColumn("level", F.max("level").over(whole))
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return levelled.select("key", "n_docs", "source_size", target.alias("target"))


def _digit(hashed: str, level: int) -> Column:
    shift = DIGIT_BITS * (DIGITS - 1 - level)
    return F.shiftright(F.col(hashed), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def _narrow(open_rows: DataFrame, level: int) -> DataFrame:
    """Per source the bucket of this digit in which its budget ``rest`` runs out, and what is left for it."""
    sums = open_rows.groupBy("key", "prefix", "rest", _digit("hash", level).alias("digit")).agg(
        F.sum("size").alias("bucket_size"), F.count(F.lit(1)).alias("bucket_docs")
    )
    so_far = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)))
    boundary = sums.filter("before <= rest AND rest < before + bucket_size")
    return boundary.select(
        "key",
        (F.col("prefix") * (1 << DIGIT_BITS) + F.col("digit")).alias("prefix"),
        (F.col("rest") - F.col("before")).alias("rest"),
        "bucket_docs",
    )


def thresholds(rows: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """``(key, prefix, rest, bucket_docs)``: the hash at which a source's budget runs out, and what is left there."""
    start = plan.select("key", "n_docs", "rest", F.lit(0).cast("long").alias("prefix")).filter("rest > 0")
    open_rows = join_groups(rows.select("key", "hash", "size"), start, "key", "n_docs", total).drop("n_docs")
    for level in range(DIGITS):
        found = save_scratch(_narrow(open_rows, level))
        if level + 1 < DIGITS:
            shift = DIGIT_BITS * (DIGITS - 1 - level)
            inside = rows.select("key", "hash", "size").withColumn("prefix", F.shiftright("hash", shift))
            # A bucket is 1/32768 of a source; ties beyond that are only rows of one hash.
            joined = inside.withColumn("place", F.concat_ws("/", "prefix", "key")).drop("key", "prefix").join(
                _small(found.withColumn("place", F.concat_ws("/", "prefix", "key")).drop("bucket_docs")), "place"
            )
            open_rows = save_scratch(joined.select("key", "hash", "size", "prefix", "rest"))
            rows = open_rows
    return found


def _small(per_source: DataFrame) -> DataFrame:
    """One row per source: broadcast while there are few sources, else joined."""
    return F.broadcast(per_source) if per_source.count() <= 100_000 else per_source


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    split_last: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Every row (or its ``columns``) with ``size, source_size, target, taken``.

    ``size`` counts words (null text: 0). Sources, by code point with null last, have the weights in
    turn; their targets add up to all sizes. ``taken`` is what the mix takes of the row: whole copies
    plus, below the source's hash threshold, one more. The row at the threshold gives the words
    still missing, or with ``split_last=False`` all or none of its words, whichever is nearer. Rows equal in
    id and text share that remainder evenly. Columns named like an added one are replaced; empty
    tables, sources without words and repeated rows are fine.
    """
    source, text = F.col(f"doc.`{source_col}`"), F.col(f"doc.`{text_col}`")
    rows = packed(docs).select(
        F.struct(*[F.col(f"doc.`{c}`") for c in columns or docs.columns]).alias("doc"),
        _source_key(source).alias("key"),
        hash60(F.col(f"doc.`{id_col}`"), text).alias("hash"),
        word_count(text).alias("size"),
    )
    sized = save_scratch(rows)
    total = sized.count()
    sources = sized.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    plan = source_targets(save_scratch(sources), weights, most)
    goal = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("cast(round(target) AS bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    plan = save_scratch(plan.withColumn("copies", copies).withColumn("rest", goal - copies * F.col("source_size")))
    ends = thresholds(sized.select("key", "hash", "size"), plan, total)
    ends = ends.select("key", F.col("prefix").alias("last_hash"), F.col("rest").alias("last_rest"), "bucket_docs")
    whole_plan = save_scratch(plan.join(ends, "key", "left"))
    rows = join_groups(sized, whole_plan, "key", "n_docs", total)
    if split_last:
        at_end = F.expr("last_rest div bucket_docs")
    else:
        at_end = F.when(F.col("last_rest") * 2 >= F.col("bucket_docs") * F.col("size"), F.col("size")).otherwise(0)
    more = (
        F.when(F.col("last_hash").isNull() | (F.col("hash") > F.col("last_hash")), F.lit(0))
        .when(F.col("hash") < F.col("last_hash"), F.col("size"))
        .otherwise(at_end)
    )
    taken = (F.col("copies") * F.col("size") + more).cast("long")
    return unpacked(rows.withColumn("taken", taken), *OWN)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, with the columns of ``docs``.

    Repeats are rows of their own. No document is cut; see ``split_last`` of ``mix``.
    """
    own = [name for name in docs.columns if name.lower() in OWN]
    safe = docs.withColumnsRenamed({name: f"__{name}" for name in own})
    rows = mix(safe, split_last=False, **options).filter("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), F.expr("taken div size")))
    repeated = rows.withColumn("__copy", copies)
    return repeated.select(*safe.columns).withColumnsRenamed({f"__{name}": name for name in own})
