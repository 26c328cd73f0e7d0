r"""Document fingerprints: Merkle trees over sections and paragraphs, in DataFrame operations only.

A text is cut, losing nothing, into sections (ended by blank lines), paragraphs (lines) and leaves (up
to five words within a sentence). Leaves are hashed, and each node above hashes its children. Equal
roots mean equal texts; where roots differ, the branches that differ show where.

A fingerprint is written ``root/section{paragraph[leaf.leaf],paragraph[leaf]};section{...}``: 64 hex digits
for the root, 12 for each node below, 8 for each leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import text_of
from strandweave.session import save_scratch

SECTION_END = r"(?<=\n[ \t\r]{0,20}\n)(?=[^\n \t\r])"
PARAGRAPH_END = r"(?<=\n)"
SENTENCE_END = r"(?<=[.!?;][ \t])(?=[^ \t])"
LEAF_WORDS = 5
#: A sentence without words is a leaf itself, an empty one too.
LEAF = r"\G(?:\s*+(?:\S++\s*+){1,%d}|\s++)|\A\z" % LEAF_WORDS
#: More than any array holds.
ALL = 1 << 30
#: Rows that are put in order together, about, and most such buckets.
BUCKET_ROWS, MAX_BUCKETS = 64, 1 << 14


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _paragraph(text: Column) -> Column:
    """``struct<hash, leaves>`` of one paragraph; of each leaf's hash the first eight digits are kept."""
    runs = lambda sentence: F.regexp_extract_all(sentence, F.lit(LEAF), F.lit(0))
    leaves = F.transform(F.flatten(F.transform(F.split(text, SENTENCE_END), runs)), F.md5)
    short = lambda leaf: F.substring(leaf, 1, 8)
    return _let(leaves, lambda x: F.struct(F.md5(F.array_join(x, "")).alias("hash"), F.transform(x, short).alias("leaves")))


def _section(paragraphs: Column) -> Column:
    return _let(paragraphs, lambda x: F.struct(F.md5(F.array_join(x["hash"], "")).alias("hash"), x.alias("paragraphs")))


def tree(text: Column) -> Column:
    """Sections of paragraphs: ``array<struct<hash, paragraphs: array<struct<hash, leaves>>>>``."""
    section = lambda one: _section(F.transform(F.split(one, PARAGRAPH_END), _paragraph))
    return F.transform(F.split(text, SECTION_END), section)


def shared_branches(start: Column) -> Column:
    """``struct<sections, paragraphs>``: what is settled by the beginning of a text, however it goes on.

    So many whole sections, and so many whole paragraphs of the next section.
    """
    n_lines = lambda one: F.size(F.split(one, "\n")) - 1
    return _let(
        F.split(start, SECTION_END),
        lambda x: F.struct((F.size(x) - 1).alias("sections"), n_lines(F.element_at(x, -1)).alias("paragraphs")),
    )


def grown_tree(text: Column, known: Column, same: Column) -> Column:
    """The tree of a text that begins like the one of tree ``known``.

    ``same`` are the ``shared_branches`` of the common beginning; their nodes are taken over, all others hashed.
    """
    beginning = F.coalesce(F.get(known, same["sections"])["paragraphs"], F.array())

    def section(one: Column, i: Column) -> Column:
        n = F.when(i == 0, same["paragraphs"]).otherwise(0)
        rest = F.slice(F.split(one, PARAGRAPH_END), n + 1, F.lit(ALL))
        return _section(F.concat(F.slice(beginning, F.lit(1), n), F.transform(rest, _paragraph)))

    rest = F.slice(F.split(text, SECTION_END), same["sections"] + 1, F.lit(ALL))
    return F.concat(F.slice(known, F.lit(1), same["sections"]), F.transform(rest, section))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections["hash"], ""), 256)


def leaf_hashes(sections: Column) -> Column:
    """All leaves' hashes."""
    return F.flatten(F.transform(sections, lambda s: F.flatten(s["paragraphs"]["leaves"])))


def written(sections: Column) -> Column:
    """The fingerprint as text."""
    short = lambda hashed: F.substring(hashed, 1, 12)

    def paragraph(p: Column) -> Column:
        return F.concat(short(p["hash"]), F.lit("["), F.array_join(p["leaves"], "."), F.lit("]"))

    def section(s: Column) -> Column:
        return F.concat(short(s["hash"]), F.lit("{"), F.array_join(F.transform(s["paragraphs"], paragraph), ","), F.lit("}"))

    return F.concat(root(sections), F.lit("/"), F.array_join(F.transform(sections, section), ";"))


def n_shared(one: Column, other: Column) -> Column:
    """How many leaves two arrays share, with repeats."""
    side = lambda leaves, n: F.transform(leaves, lambda x: F.struct(x.alias("leaf"), F.lit(n).alias("side")))
    both = F.sort_array(F.concat(side(one, 0), side(other, 1)))
    start = F.struct(F.lit("").alias("leaf"), F.lit(0).alias("left"), F.lit(0).alias("shared"))

    def walk(state: Column, x: Column) -> Column:
        # Of equal leaves those of the first come first; each of the second then takes one.
        left = F.when(state["leaf"] == x["leaf"], state["left"]).otherwise(0)
        takes = F.when((x["side"] == 1) & (left > 0), 1).otherwise(0)
        left = F.when(x["side"] == 0, left + 1).otherwise(left - takes)
        return F.struct(x["leaf"].alias("leaf"), left.alias("left"), (state["shared"] + takes).alias("shared"))

    return F.aggregate(both, start, walk)["shared"]


def _same_start(one: Column, other: Column) -> Column:
    """How many nodes at the start of two arrays have equal hashes."""
    equal = F.zip_with(one["hash"], other["hash"], lambda a, b: F.coalesce(a == b, F.lit(False)))
    return _let(equal, lambda x: F.when(F.array_contains(x, False), F.array_position(x, False) - 1).otherwise(F.size(x)).cast("int"))


def first_difference(one: Column, other: Column) -> Column:
    """``struct<section, paragraph>`` (from 0) where two trees first differ, found by descent.

    Sections with equal hashes are not looked into. Of equal trees it is the number of sections and 0.
    """
    inside = lambda sections, s: F.coalesce(F.get(sections, s)["paragraphs"], F.slice(sections[0]["paragraphs"], F.lit(1), F.lit(0)))
    return _let(
        _same_start(one, other),
        lambda s: F.struct(s.alias("section"), _same_start(inside(one, s), inside(other, s)).alias("paragraph")),
    )


def leaves_from(sections: Column, place: Column) -> Column:
    """The leaves of the branches from a place ``struct<section, paragraph>`` on."""
    rest = F.transform(
        F.slice(sections, place["section"] + 1, F.lit(ALL)),
        lambda s, i: F.flatten(
            F.slice(s["paragraphs"]["leaves"], F.when(i == 0, place["paragraph"]).otherwise(0) + 1, F.lit(ALL))
        ),
    )
    return F.flatten(rest)


def likeness(one: Column, other: Column) -> Column:
    """Leaves that two trees share, with repeats, by the leaves of the larger one: from 0 to 1.

    The branches before the first difference are shared whole; only leaves behind it are compared. That
    takes equal leaves from both sides, so the sum is the same as over all leaves.
    """
    larger = F.greatest(F.size(leaf_hashes(one)), F.size(leaf_hashes(other)))

    def count(place: Column) -> Column:
        mine = leaves_from(one, place)
        return F.size(leaf_hashes(one)) - F.size(mine) + n_shared(mine, leaves_from(other, place))

    return _let(first_difference(one, other), count) / larger


def differing_paragraphs(one: Column, other: Column) -> Column:
    """Numbers ``(section, paragraph)`` of the first tree's paragraphs that the second tree has not.

    Sections with equal hashes are not looked into.
    """
    same_sections = other["hash"]
    known = F.flatten(other["paragraphs"])["hash"]
    places = F.transform(
        one,
        lambda s, i: F.when(F.array_contains(same_sections, s["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.filter(
                F.transform(
                    s["paragraphs"],
                    lambda p, j: F.when(
                        ~F.array_contains(known, p["hash"]), F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"))
                    ),
                ),
                lambda place: place.isNotNull(),
            )
        ),
    )
    return F.flatten(places)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with ``tree`` and ``fingerprint`` of its whole text; null counts as empty."""
    with_tree = docs.withColumn("tree", tree(text_of(text_col)))
    return with_tree.withColumn("fingerprint", written(F.col("tree")))


def in_order(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into ranges of ids: the rows with ``bucket``, and ``(bucket, first_id, before)``.

    ``before`` is the bucket that precedes in a ring, with the last bucket before the first.
    """
    n_rows = docs.count()
    n = max(1, min(MAX_BUCKETS, n_rows // BUCKET_ROWS))
    steps = [i / n for i in range(1, n)] or [0.5]
    # At most MAX_BUCKETS numbers come to the driver.
    bounds = docs.agg(F.percentile_approx(id_col, steps, 10 * n + 10_000).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    size = 1 << len(bounds).bit_length()
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    widths = [size >> i for i in range(1, size.bit_length())]
    # How many bounds are below the id, by halving.
    step = lambda at, w: at + F.when(F.get(held, at + w - 1) < F.col(id_col), w).otherwise(0)
    bucket = F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), step) if bounds else F.lit(0)
    rows = docs.withColumn("bucket", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(bucket))
    firsts = rows.groupBy("bucket").agg(F.min(id_col).alias("first_id"))
    ring = Window.orderBy("bucket")
    everything = Window.partitionBy()
    before = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(everything))
    return rows, save_scratch(firsts.withColumn("before", before))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **own: Column) -> DataFrame:
    """``(id, text, next_text)``: each row with the text of the next one by id, the last with the first's.

    Ids are integers, ordered with null first, equal ids by text. Ranges of ids are ordered apart; a range also
    gets a copy of the row that begins the next one, so no order over all rows is needed. ``own`` are further
    columns made of ``text``; the next row's have the prefix ``next_``.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    dealt, firsts = in_order(rows, "id")
    known = dealt.join(F.broadcast(firsts), "bucket")
    is_first = F.col("id").eqNullSafe(F.col("first_id"))
    places = F.when(
        is_first, F.array(F.struct("bucket", F.lit(0).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy")))
    ).otherwise(F.array(F.struct("bucket", F.lit(0).alias("copy"))))
    placed = known.select("id", "text", F.explode(places).alias("place")).select("id", "text", "place.*")
    if own:
        # Made after the shuffle, so that only texts are sent.
        placed = placed.repartition("bucket").select("*", *[column.alias(name) for name, column in own.items()])
    order = Window.partitionBy("bucket").orderBy("copy", F.col("id").asc_nulls_first(), "text")
    names = ["text", *own]
    nexts = [F.lead(name).over(order).alias(f"next_{name}") for name in names]
    followed = placed.select("id", "copy", *names, *nexts).filter("copy = 0")
    return followed.drop("copy")


def edited(text: Column, other: Column, share: int = 4) -> Column:
    """The text with its last ``floor(length / share)`` code points replaced by the first as many of another."""
    n = F.floor(F.length(text) / share).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(other, F.lit(1), n))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, and their likeness.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_section,
    edit_paragraph)``: the edited text ends with the next document's beginning; ``near_next`` compares with the
    next document itself. The last two say where the trees of the text and the edited text first differ (from 0;
    both null where they are equal). An empty table gives an empty result; a single document is its own next.
    """
    rows = with_next(docs, id_col, text_col, own=tree(F.col("text")))
    n_kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    changed = rows.select(
        "*",
        edited(F.col("text"), F.col("next_text")).alias("edited"),
        shared_branches(F.substring("text", F.lit(1), n_kept)).alias("same"),
    )
    trees = changed.select("*", grown_tree(F.col("edited"), F.col("own"), F.col("same")).alias("changed"))
    own, new = F.col("own"), F.col("changed")
    result = trees.select(
        F.col("id").alias(id_col),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(own).alias("fingerprint"),
        written(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, F.col("next_own")).alias("near_next"),
        F.when(root(own) != root(new), first_difference(own, new)).alias("place"),
    )
    return result.select("*", F.col("place.section").alias("edit_section"), F.col("place.paragraph").alias("edit_paragraph")).drop("place")
