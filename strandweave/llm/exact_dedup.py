"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

The first pass counts the Bloom bits that the text hashes set and keeps the bits set more than
once as bitmaps. The second pass probes every row: a row whose bits are not all among the
repeated ones has a text of its own and passes straight through. Only the others, which are
possible repeats, are hashed to SHA-256, shuffled and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import join_groups, packed, text_of, unpacked
from strandweave.session import save_scratch

#: Bits of one bitmap row (fixed by Spark's bitmap functions).
BLOCK_BITS = 32768
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def filter_blocks(n_rows: int, bits_per_row: int, max_bits: int) -> int:
    """Number of bitmap blocks, a power of two."""
    wanted = min(max(n_rows * bits_per_row, BLOCK_BITS), max_bits)
    return max(1, 1 << ((wanted - 1).bit_length()) - BLOCK_BITS.bit_length() + 1)


def _bits(hashed: Column, n_blocks: int) -> tuple[Column, Column, Column]:
    """The block of a 64-bit hash and its two bits there."""
    low = lambda shift, n: F.shiftrightunsigned(hashed, shift).bitwiseAND(F.lit(n - 1)).cast("int")
    return low(0, n_blocks), low(34, BLOCK_BITS), low(49, BLOCK_BITS)


def repeated_bits(docs: DataFrame, text_col: str, n_blocks: int) -> DataFrame:
    """First pass: ``(block, bitmap)`` of the Bloom bits that more than one row sets."""
    block, first, second = _bits(F.xxhash64(text_of(text_col)), n_blocks)
    set_bits = docs.select(block.alias("block"), F.explode(F.array_distinct(F.array(first, second))).alias("bit"))
    repeated = set_bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap"))


def _is_set(bit: str) -> Column:
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, {bit} div 8 + 1, 1)")), 16, 10).cast("int")
    return F.expr(f"1 << ({bit} % 8)").bitwiseAND(byte) != 0


def probe(docs: DataFrame, text_col: str, bitmaps: DataFrame, n_blocks: int) -> DataFrame:
    """Second pass: packed rows with ``maybe``, whether the text may occur more than once."""
    rows = packed(docs)
    block, first, second = _bits(F.xxhash64(text_of(F.col(f"doc.`{text_col}`"))), n_blocks)
    rows = rows.select("doc", block.alias("block"), first.alias("bit_1"), second.alias("bit_2"))
    probed = rows.join(F.broadcast(bitmaps), "block", "left")
    maybe = F.col("bitmap").isNotNull() & _is_set("bit_1") & _is_set("bit_2")
    return probed.select("doc", F.coalesce(maybe, F.lit(False)).alias("maybe"))


def mark_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """Every row with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest
    id stays, null ids being smallest; among rows of equal text and id exactly one stays.
    ``group_size`` counts all rows of the text. Other columns are carried; those named like an
    added one are replaced. An empty table gives an empty result.

    The broadcast bitmaps hold at most ``max_filter_bits`` bits (32 MiB by default) whatever the
    input: with more rows than ``max_filter_bits / bits_per_row`` the filter lets more rows with
    texts of their own into the shuffle, so raise it with executor memory; results never change.
    """
    n_rows = docs.count()
    n_blocks = filter_blocks(n_rows, bits_per_row, max_filter_bits)
    bitmaps = save_scratch(repeated_bits(docs, text_col, n_blocks))
    probed = probe(docs, text_col, bitmaps, n_blocks)
    row_id, sha = F.col(f"doc.`{id_col}`"), F.sha2(text_of(F.col(f"doc.`{text_col}`")), 256)
    single = probed.filter(~F.col("maybe")).select(
        "doc",
        row_id.alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        sha.alias("text_sha256"),
    )
    # Saved, so that the tags that tell equal rows apart never change.
    suspects = save_scratch(
        probed.filter("maybe").select("doc", sha.alias("text_sha256"), F.monotonically_increasing_id().alias("tag"))
    )
    groups = suspects.groupBy("text_sha256").agg(
        F.max(F.struct(row_id.alias("keep_id"), F.col("tag").alias("keep_tag"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = save_scratch(groups.select("text_sha256", "best.keep_id", "best.keep_tag", "group_size"))
    repeats = join_groups(suspects, groups, "text_sha256", "group_size", n_rows).withColumn(
        "kept", F.col("tag") == F.col("keep_tag")
    )
    return unpacked(single, *OWN).unionByName(unpacked(repeats, *OWN))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows that ``mark_duplicates`` keeps, with the columns of ``docs``."""
    own = [name for name in docs.columns if name.lower() in OWN]
    safe = docs.withColumnsRenamed({name: f"__{name}" for name in own})
    kept = mark_duplicates(safe, id_col, text_col, **options).filter("kept")
    return kept.select(*safe.columns).withColumnsRenamed({f"__{name}": name for name in own})
