"""Reads and contigs projected from text tables, so that any text corpus can drive the engine.

Letters a..z stand for the four bases in turn, a letter listed in ``no_call`` becomes N, all
other characters are dropped. A text yields overlapping windows; the last window is cut at the
end of the text, so the windows of a text cover all of it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ_LEN = 151
STRIDE = 50
NO_CALL = "q"


def text_to_dna(text: Column, no_call: str = NO_CALL) -> Column:
    letters = string.ascii_lowercase
    bases = "".join("N" if c in no_call else "ACGT"[i % 4] for i, c in enumerate(letters))
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), letters, bases)


def reads_from_text(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    read_len: int = READ_LEN,
    stride: int = STRIDE,
    no_call: str = NO_CALL,
) -> DataFrame:
    """``reads(read_id LONG, seq STRING)`` with ``read_id = id * 2^32 + offset``."""
    dna = df.select(F.col(id_col).alias("id"), text_to_dna(F.col(text_col), no_call).alias("dna"))
    # Each match moves on by a stride and looks ahead for its window, so a text is read once.
    pattern = F.lit(f"(?=(.{{1,{read_len}}})).{{1,{stride}}}")
    n_windows = 1 + F.greatest(F.ceil((F.length("dna") - read_len) / stride), F.lit(0)).cast("int")
    windows = F.slice(F.regexp_extract_all("dna", pattern, F.lit(1)), F.lit(1), n_windows)
    at = dna.filter(F.length("dna") > 0).select("id", F.posexplode(windows).alias("n", "seq"))
    return at.select((F.shiftleft(F.col("id"), 32) + F.col("n") * stride).alias("read_id"), "seq")


def contigs_from_text(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One contig per text, ``contigs(contig_id, sequence, length, mean_coverage)``."""
    dna = df.select(
        (F.col(id_col) + 1).cast("bigint").alias("contig_id"),
        text_to_dna(F.col(text_col), no_call="").alias("sequence"),
    )
    return dna.select(
        "contig_id",
        "sequence",
        F.length("sequence").alias("length"),
        F.lit(1.0).cast("float").alias("mean_coverage"),
    )
