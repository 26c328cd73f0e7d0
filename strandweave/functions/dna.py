"""DNA scalar functions as Spark column expressions.

Two representations are used. A *string* k-mer is plain ``ACGT`` text. A *packed* k-mer is a
``LONG`` with two bits per base, first base in the highest bits, so numeric order equals
alphabetical order. ``k`` is limited to 31 so that a packed value is never negative.

An oriented node is ``2 * packed (k-1)-mer + strand`` where the (k-1)-mer is the smaller of the
two strands and ``strand`` is 0 when the read direction is that smaller one. The opposite
strand of node ``v`` is ``v ^ 1``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base alphabets.
BASES = "ACGT"  # packed digits 0 1 2 3
COMPLEMENTS = "TGCA"
DIGITS = "0123"
READ_CODES = {"A": 1, "T": 2, "G": 3, "C": 4}  # codes of an encoded read; anything else is 0

MAX_K = 31


def check_k(k: int) -> int:
    if not 2 <= k <= MAX_K:
        raise ValueError(f"k must be between 2 and {MAX_K}, got {k}")
    return k


def mask(n_bases: int) -> int:
    return (1 << (2 * n_bases)) - 1


# ---- strings ---------------------------------------------------------------------------


def revcomp(seq: Column) -> Column:
    """Reverse complement of a string; a base outside ACGT becomes N."""
    known = F.regexp_replace(seq, "[^ACGT]", "N")
    return F.reverse(F.translate(known, BASES, COMPLEMENTS))


def canonical(seq: Column) -> Column:
    """The alphabetically smaller strand of an ACGT string."""
    return F.least(seq, revcomp(seq))


def has_no_call(seq: Column) -> Column:
    """True when the sequence has any base outside ACGT (case-insensitive)."""
    return seq.rlike("[^ACGTacgt]")


def encode(seq: Column) -> Column:
    """Read codes, one small integer per base."""
    codes = "".join(str(c) for c in READ_CODES.values())
    digits = F.translate(
        F.regexp_replace(F.upper(seq), "[^ACGT]", "0"), "".join(READ_CODES), codes
    )
    letters = F.filter(F.split(digits, ""), lambda d: d != "")
    return F.transform(letters, lambda d: d.cast("tinyint"))


def decode(codes: Column) -> Column:
    """Inverse of :func:`encode`; unknown codes become N."""
    letters = F.array(*[F.lit(x) for x in "N" + "".join(READ_CODES)])
    return F.array_join(
        F.transform(
            codes,
            lambda c: F.when(c.between(1, 4), F.element_at(letters, c.cast("int") + 1)).otherwise("N"),
        ),
        "",
    )


def pack(seq: Column) -> Column:
    """Packed form of an upper-case ACGT string of at most 31 bases."""
    return F.conv(F.translate(seq, BASES, DIGITS), 4, 10).cast("bigint")


def unpack(packed: Column, n_bases: int) -> Column:
    """String form of a packed k-mer; four bases at a time are looked up in a constant array."""
    parts = []
    for at in range(0, n_bases, 4):
        size = min(4, n_bases - at)
        words = F.split(F.lit(" ".join("".join(word) for word in itertools.product(BASES, repeat=size))), " ")
        code = F.shiftright(packed.cast("bigint"), 2 * (n_bases - at - size)).bitwiseAND(F.lit(4**size - 1))
        parts.append(F.get(words, code.cast("int")))
    return F.concat(*parts)


def parse_kmer(seq: Column, k: int) -> Column:
    """Canonical packed k-mer of an ASCII window, or NULL when it is not k upper-case bases."""
    return F.when(seq.rlike(f"^[{BASES}]{{{k}}}$"), pack(canonical(seq)))


def canonical_kmer(seq: Column, k: int) -> Column:
    """Canonical packed k-mer of a string in any case; an invalid string fails the job."""
    valid = F.upper(seq)
    return F.when(valid.rlike(f"^[{BASES}]{{{k}}}$"), pack(canonical(valid))).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {k}-mer over {BASES}: "), seq)).cast("bigint")
    )


# ---- packed ----------------------------------------------------------------------------


def _group_mask(width: int) -> int:
    """64-bit mask that selects every other group of ``width`` bits, lowest group first."""
    return sum(((1 << width) - 1) << at for at in range(0, 64, 2 * width))


def revcomp_packed(packed: Column, k: int) -> Column:
    """Reverse complement of a packed k-mer.

    Inverting all bits complements every base. Swapping neighbouring groups of 2, 4, 8, 16 and
    32 bits then reverses the order of the 32 bases, and a final shift drops the unused ones.
    """
    x = F.bitwise_not(packed)
    for width in (2, 4, 8, 16):
        m = F.lit(_group_mask(width)).cast("bigint")
        x = F.shiftleft(x.bitwiseAND(m), width).bitwiseOR(
            F.shiftrightunsigned(x, width).bitwiseAND(m)
        )
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def canonical_packed(packed: Column, k: int) -> Column:
    return F.least(packed, revcomp_packed(packed, k))


def prefix(packed: Column) -> Column:
    """All bases but the last."""
    return F.shiftright(packed, 2)


def suffix(packed: Column, k: int) -> Column:
    """All bases but the first."""
    return packed.bitwiseAND(F.lit(mask(k - 1)))


def first_base(packed: Column, k: int) -> Column:
    return base_letter(F.shiftright(packed, 2 * (k - 1)))


def last_base(packed: Column) -> Column:
    return base_letter(packed.bitwiseAND(F.lit(3)))


def base_letter(digit: Column) -> Column:
    return F.translate(digit.cast("string"), DIGITS, BASES)


def complement_base(base: Column) -> Column:
    return F.translate(base, BASES, COMPLEMENTS)


# ---- oriented nodes --------------------------------------------------------------------


def node_of(packed: Column, packed_rc: Column) -> Column:
    """Oriented node of a (k-1)-mer given both its strands; a palindrome is forward."""
    return F.when(packed <= packed_rc, packed * 2).otherwise(packed_rc * 2 + 1)


def node_id(packed: Column, n_bases: int) -> Column:
    return node_of(packed, revcomp_packed(packed, n_bases))


def twin(node: Column) -> Column:
    return node.bitwiseXOR(F.lit(1).cast("bigint"))


def forward_id(canonical_idx: Column) -> Column:
    return canonical_idx * 2


def reverse_id(canonical_idx: Column) -> Column:
    return canonical_idx * 2 + 1


def is_forward(node: Column) -> Column:
    return node.bitwiseAND(F.lit(1).cast("bigint")) == 0


def canonical_idx(node: Column) -> Column:
    """Packed canonical (k-1)-mer of an oriented node."""
    return F.shiftright(node, 1)


def node_string(node: Column, n_bases: int) -> Column:
    """(k-1)-mer text of an oriented node, read in the node's direction."""
    text = unpack(canonical_idx(node), n_bases)
    return F.when(is_forward(node), text).otherwise(revcomp(text))
