"""The registered queries: every operator applied to the given tables.

Each entry is a function of ``(spark, sf_dir)`` and, where another engine can say the same in
SQL, a statement for it. All of them read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.operators import abundance as ab
from strandweave.operators import compare, components, contigs, graph, kmers, mapping, ordering, reads, unitigs
from strandweave.plans import oracle_sql as sql
from strandweave.plans.assembly import AssemblyOptions, assemble
from strandweave.session import save_scratch, scratch_path, spread
from strandweave.sources import fastq, kmer_dump, outputs
from strandweave.sources.text_reads import contigs_from_text, reads_from_text
from strandweave.streaming import mapping as streaming

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 31  # assembly of documents
K_GRAPH = 15  # graph tables, on conversations
K_PRUNE = 15  # pruning of documents
K_MAP = 11  # mapping of documents to benchmark items, short enough for ambiguous votes
MIN_HITS = 3
FLOOR, RELATIVE = 3, 0.34


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# ---- inputs ------------------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet").select(*columns))


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return reads_from_text(_table(spark, sf, "documents", "doc_id", "text"), "doc_id")


def _counts(spark: SparkSession, sf: str, k: int = K, min_count: int = 2) -> DataFrame:
    return kmers.count_reads(_reads(spark, sf), k, min_count)


def _small_counts(spark: SparkSession, sf: str, k: int = K_GRAPH, min_count: int = 2) -> DataFrame:
    table = _table(spark, sf, "conversations", "conv_id", "text")
    return kmers.count_reads(reads_from_text(table, "conv_id"), k, min_count)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(_small_counts(spark, sf), K_GRAPH)


def _contigs(spark: SparkSession, sf: str) -> DataFrame:
    return contigs_from_text(_table(spark, sf, "benchmark", "item_id", "text"), "item_id")


def _item_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct k-mers of the benchmark items."""
    return kmers.extract_kmers(_contigs(spark, sf), K, "contig_id", "sequence").select("kmer").distinct()


def _assigned(spark: SparkSession, sf: str, vote: str = "majority") -> DataFrame:
    return mapping.map_reads(_reads(spark, sf), _contigs(spark, sf), k=K_MAP, min_hits=MIN_HITS, vote=vote)


def _text(kmer: str = "kmer", k: int = K):
    return dna.unpack(F.col(kmer), k)


_DOC_COUNTS = sql.counts(K)
_SMALL = sql.counts(K_GRAPH, 2, "conversations", "conv_id")
_SMALL_EDGES = f"{_SMALL}, {sql.edges(K_GRAPH)}"
_ITEM_KMERS = (
    f"{sql.contigs()}, {sql.windows(K, 'contigs', 'contig_id', 'sequence', 'ck')}, "
    "items AS (SELECT DISTINCT kmer FROM ck)"
)


# ---- reads -------------------------------------------------------------------------------


@query(sql.statement(sql.reads(), select="SELECT read_id, seq, length(seq) AS len FROM reads"))
def reads_projected(spark, sf):
    return _reads(spark, sf).select("read_id", "seq", F.length("seq").cast("bigint").alias("len"))


@query(sql.statement(sql.reads(), select="SELECT read_id, seq FROM reads WHERE NOT contains(seq, 'N')"))
def reads_drop_n(spark, sf):
    return reads.drop_no_calls(_reads(spark, sf)).select("read_id", "seq")


@query(
    sql.statement(
        sql.reads(),
        select="""SELECT count(*) FILTER (NOT contains(seq, 'N')) AS n_reads,
  count(*) FILTER (contains(seq, 'N')) AS n_dropped,
  coalesce(sum(length(seq)) FILTER (NOT contains(seq, 'N')), 0)::BIGINT AS n_bases,
  coalesce(max(length(seq)) FILTER (NOT contains(seq, 'N')), 0) AS max_len FROM reads""",
    )
)
def read_stats(spark, sf):
    stats = reads.read_stats(_reads(spark, sf))
    return stats.withColumn("max_len", F.col("max_len").cast("bigint"))


@query(sql.statement(sql.reads(), select="SELECT length(seq) AS len, count(*) AS n_reads FROM reads GROUP BY 1"))
def read_length_hist(spark, sf):
    hist = reads.length_histogram(_reads(spark, sf))
    return hist.select(F.col("len").cast("bigint").alias("len"), "n_reads")


@query(
    sql.statement(
        sql.reads(),
        select="""SELECT read_id, translate(seq, 'ATGC', '1234') AS codes, length(seq) AS len
FROM reads WHERE NOT contains(seq, 'N')""",
    )
)
def read_encode(spark, sf):
    encoded = reads.encode_reads(_reads(spark, sf))
    return encoded.select(
        "read_id", F.array_join("codes", "").alias("codes"), F.col("len").cast("bigint").alias("len")
    )


@query(sql.statement(sql.reads(), select="SELECT read_id, seq FROM reads"))
def read_decode(spark, sf):
    return reads.decode_reads(reads.encode_reads(_reads(spark, sf), drop_with_n=False))


# ---- scalar functions --------------------------------------------------------------------


@query(
    sql.statement(
        sql.reads(), select="SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM reads"
    )
)
def revcomp(spark, sf):
    return _reads(spark, sf).select("read_id", dna.revcomp(F.col("seq")).alias("revcomp"))


@query(
    sql.statement(
        sql.reads(),
        select="""SELECT read_id, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS canonical
FROM reads WHERE NOT contains(seq, 'N')""",
    )
)
def canonical(spark, sf):
    kept = reads.drop_no_calls(_reads(spark, sf))
    return kept.select("read_id", dna.canonical(F.col("seq")).alias("canonical"))


@query(sql.statement(_ITEM_KMERS, select=f"SELECT kmer, {sql._pack('kmer')} AS packed FROM items"))
def kmer_pack(spark, sf):
    text = _item_kmers(spark, sf).select(_text().alias("kmer"))
    return text.select("kmer", dna.pack(F.col("kmer")).alias("packed"))


@query(sql.statement(_ITEM_KMERS, select=f"SELECT {sql._pack('kmer')} AS packed, kmer FROM items"))
def kmer_unpack(spark, sf):
    return _item_kmers(spark, sf).select(F.col("kmer").alias("packed"), _text().alias("kmer"))


@query(
    sql.statement(
        _ITEM_KMERS,
        select=f"""SELECT kmer, {sql._pack(sql._rc('kmer'))} AS packed_rc,
  least({sql._pack(sql._rc('kmer'))}, {sql._pack('kmer')}) AS packed_canonical FROM items""",
    )
)
def kmer_revcomp_packed(spark, sf):
    kmer = F.col("kmer")
    return _item_kmers(spark, sf).select(
        _text().alias("kmer"),
        dna.revcomp_packed(kmer, K).alias("packed_rc"),
        dna.canonical_packed(kmer, K).alias("packed_canonical"),
    )


@query(
    sql.statement(
        _ITEM_KMERS,
        select=f"""SELECT kmer, left(kmer, {K - 1}) AS prefix, right(kmer, {K - 1}) AS suffix,
  left(kmer, 1) AS first_base, right(kmer, 1) AS last_base,
  translate(right(kmer, 1), 'ACGT', 'TGCA') AS last_complement FROM items""",
    )
)
def kmer_split(spark, sf):
    kmer = F.col("kmer")
    return _item_kmers(spark, sf).select(
        _text().alias("kmer"),
        dna.unpack(dna.prefix(kmer), K - 1).alias("prefix"),
        dna.unpack(dna.suffix(kmer, K), K - 1).alias("suffix"),
        dna.first_base(kmer, K).alias("first_base"),
        dna.last_base(kmer).alias("last_base"),
        dna.complement_base(dna.last_base(kmer)).alias("last_complement"),
    )


@query(
    sql.statement(
        f"{sql.contigs()}, {sql.windows(K, 'contigs', 'contig_id', 'sequence', 'ck')}",
        select=f"SELECT contig_id, pos, {sql._pack('kmer')} AS packed FROM ck",
    )
)
def kmer_parse(spark, sf):
    at = _contigs(spark, sf).filter(F.length("sequence") >= K).select(
        "contig_id", "sequence", F.explode(F.sequence(F.lit(1), F.length("sequence") - K + 1)).alias("pos")
    )
    window = F.substring("sequence", F.col("pos"), F.lit(K))
    return at.select("contig_id", F.col("pos").cast("bigint").alias("pos"), dna.parse_kmer(window, K).alias("packed"))


@query(
    sql.statement(
        f"{_ITEM_KMERS}, p AS (SELECT left(kmer, {K - 1}) AS s FROM items)",
        select=f"""SELECT s AS node_text, CASE WHEN s <= {sql._rc('s')} THEN 2 * {sql._pack('s')}
  ELSE 2 * {sql._pack(sql._rc('s'))} + 1 END AS node, least(s, {sql._rc('s')}) AS canonical_text,
  (s <= {sql._rc('s')})::BIGINT AS forward FROM p""",
    )
)
def node_ids(spark, sf):
    node = F.col("node")
    placed = _item_kmers(spark, sf).select(dna.node_id(dna.prefix(F.col("kmer")), K - 1).alias("node"))
    return placed.select(
        dna.node_string(node, K - 1).alias("node_text"),
        "node",
        dna.unpack(dna.canonical_idx(node), K - 1).alias("canonical_text"),
        dna.is_forward(node).cast("bigint").alias("forward"),
    )


@query(
    sql.statement(
        _ITEM_KMERS,
        select=f"""SELECT {sql._pack('kmer')} AS idx, 2 * {sql._pack('kmer')} AS forward_id,
  2 * {sql._pack('kmer')} + 1 AS reverse_id, 2 * {sql._pack('kmer')} + 1 AS twin_of_forward,
  2 * {sql._pack('kmer')} AS twin_of_reverse FROM items""",
    )
)
def twin_ids(spark, sf):
    idx = F.col("kmer")
    fwd, rev = dna.forward_id(idx), dna.reverse_id(idx)
    return _item_kmers(spark, sf).select(
        idx.alias("idx"),
        fwd.alias("forward_id"),
        rev.alias("reverse_id"),
        dna.twin(fwd).alias("twin_of_forward"),
        dna.twin(rev).alias("twin_of_reverse"),
    )


# ---- k-mers ------------------------------------------------------------------------------


@query(
    sql.statement(
        sql.reads(),
        sql.windows(K),
        select="""SELECT read_id, count(*) AS n_kmers, min(kmer) AS lowest, max(kmer) AS highest,
  sum(pos)::BIGINT AS pos_sum FROM kmers GROUP BY read_id""",
    )
)
def kmer_extract(spark, sf):
    found = kmers.extract_kmers(_reads(spark, sf), K)
    per_read = found.groupBy("read_id").agg(
        F.count("*").alias("n_kmers"),
        F.min("kmer").alias("low"),
        F.max("kmer").alias("high"),
        F.sum("pos").alias("pos_sum"),
    )
    return per_read.select(
        "read_id", "n_kmers", _text("low").alias("lowest"), _text("high").alias("highest"), "pos_sum"
    )


@query(sql.statement(_DOC_COUNTS, select="SELECT kmer, cnt FROM counts"))
def kmer_count(spark, sf):
    return _counts(spark, sf).select(_text().alias("kmer"), "cnt")


@query(
    sql.statement(sql.counts(K_GRAPH, 1, "conversations", "conv_id"), select="SELECT kmer, cnt FROM counts")
)
def kmer_count_min1(spark, sf):
    return _small_counts(spark, sf, min_count=1).select(_text(k=K_GRAPH).alias("kmer"), "cnt")


@query(
    sql.statement(
        sql.counts(7, 2, "conversations", "conv_id"), select="SELECT kmer, least(cnt, 20) AS cnt FROM counts"
    )
)
def kmer_count_capped(spark, sf):
    table = _table(spark, sf, "conversations", "conv_id", "text")
    found = kmers.extract_kmers(reads_from_text(table, "conv_id"), 7, id_col=None)
    return kmers.count_kmers(found, 2, max_count=20).select(_text(k=7).alias("kmer"), "cnt")


@query(sql.statement(_DOC_COUNTS, select="SELECT cnt, count(*) AS n_kmers FROM counts GROUP BY cnt"))
def kmer_spectrum(spark, sf):
    return kmers.spectrum(_counts(spark, sf))


@query(
    sql.statement(
        sql.counts(K_GRAPH, 2), select="SELECT cnt, count(*) AS n_kmers FROM counts GROUP BY cnt"
    )
)
def kmer_merge_chunks(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "text", "lang")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    parts = [
        kmers.count_reads(reads_from_text(docs.filter(chunk), "doc_id"), K_GRAPH, 1)
        for chunk in (english, ~english)
    ]
    return kmers.spectrum(kmers.merge_counts(*parts, min_count=2))


@query(sql.statement(_DOC_COUNTS, select="SELECT kmer, cnt FROM counts ORDER BY cnt DESC, kmer LIMIT 100"))
def kmer_topk(spark, sf):
    return kmers.top_kmers(_counts(spark, sf), 100).select(_text().alias("kmer"), "cnt")


@query(
    sql.statement(
        _SMALL, select="SELECT kmer || chr(9) || cnt::VARCHAR AS line, kmer, cnt FROM counts"
    )
)
def kmer_dump_scan(spark, sf):
    lines = save_scratch(kmer_dump.dump_lines(_small_counts(spark, sf), K_GRAPH))
    parsed = kmer_dump.parse_dump(lines, K_GRAPH)
    return lines.join(parsed, "kmer").select(
        F.col("value").alias("line"), _text(k=K_GRAPH).alias("kmer"), "cnt"
    )


# ---- graph -------------------------------------------------------------------------------


@query(
    sql.statement(
        _SMALL_EDGES,
        select="SELECT DISTINCT unnest([src // 2, dst // 2]) AS canonical FROM edges",
    )
)
def nodes(spark, sf):
    return graph.nodes(_small_counts(spark, sf), K_GRAPH)


@query(sql.statement(_SMALL_EDGES, select="SELECT kmer, dir::BIGINT AS dir, src, dst, w, label FROM edges"))
def edges(spark, sf):
    return _edges(spark, sf).select(
        _text(k=K_GRAPH).alias("kmer"), F.col("dir").cast("bigint").alias("dir"), "src", "dst", "w", "label"
    )


@query(
    sql.statement(
        _DOC_COUNTS,
        sql.edges(K),
        select="""SELECT dir::BIGINT AS dir, label, count(*) AS n_edges, sum(w)::BIGINT AS w_sum, min(src) AS min_src,
  max(src) AS max_src, min(dst) AS min_dst, max(dst) AS max_dst,
  sum(src % 1000003)::BIGINT AS src_check, sum(dst % 1000003)::BIGINT AS dst_check FROM edges GROUP BY dir, label""",
    )
)
def edges_by_label(spark, sf):
    every = graph.build_edges(_counts(spark, sf), K)
    return every.groupBy(F.col("dir").cast("bigint").alias("dir"), "label").agg(
        F.count("*").alias("n_edges"),
        F.sum("w").alias("w_sum"),
        F.min("src").alias("min_src"),
        F.max("src").alias("max_src"),
        F.min("dst").alias("min_dst"),
        F.max("dst").alias("max_dst"),
        F.sum(F.col("src") % 1000003).alias("src_check"),
        F.sum(F.col("dst") % 1000003).alias("dst_check"),
    )


@query(
    sql.statement(
        f"""{_SMALL_EDGES}, seen_back AS (
SELECT eid, w, xor(dst, 1::BIGINT) AS src, xor(src, 1::BIGINT) AS dst FROM edges)""",
        select="""SELECT a.eid, b.eid AS twin_eid, b.src AS twin_src, b.dst AS twin_dst, b.label AS twin_label
FROM seen_back a JOIN edges b USING (src, dst, w)""",
    )
)
def edge_twins(spark, sf):
    eid = F.col("kmer") * 2 + F.col("dir")
    return graph.edge_twins(_edges(spark, sf)).select(
        eid.alias("eid"), dna.twin(eid).alias("twin_eid"), "twin_src", "twin_dst", "twin_label"
    )


@query(
    sql.statement(
        sql.counts(6, 2, "conversations", "conv_id"),
        sql.edges(6),
        select="""SELECT eid, src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY kmer, dir) AS rank FROM edges""",
    )
)
def edge_ranks(spark, sf):
    # Even k, where a palindromic k-mer gives two parallel edges.
    every = graph.build_edges(_small_counts(spark, sf, k=6), 6)
    return graph.edge_ranks(every).select(
        (F.col("kmer") * 2 + F.col("dir")).alias("eid"), "src", "dst", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    sql.statement(
        _SMALL_EDGES,
        select="""SELECT node, sum(o)::BIGINT AS outdeg, sum(i)::BIGINT AS indeg FROM (
  SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node""",
    )
)
def node_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(
    sql.statement(
        _DOC_COUNTS,
        sql.edges(K),
        select="""SELECT outdeg, indeg, count(*) AS n_nodes FROM (
  SELECT node, sum(o)::BIGINT AS outdeg, sum(i)::BIGINT AS indeg FROM (
    SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node)
GROUP BY outdeg, indeg""",
    )
)
def degree_hist(spark, sf):
    every = graph.degrees_at_nodes(kmers.saved_counts(_reads(spark, sf), K), K)
    return every.groupBy("outdeg", "indeg").agg(F.count("*").alias("n_nodes"))


@query(
    sql.statement(
        _SMALL_EDGES,
        select="""SELECT node, outdeg, (1 + sum(outdeg) OVER (ORDER BY node) - outdeg)::BIGINT AS first FROM (
  SELECT src AS node, count(*) AS outdeg FROM edges GROUP BY src)""",
    )
)
def csr_offsets(spark, sf):
    return graph.out_offsets(_edges(spark, sf))


@query(sql.statement(_SMALL_EDGES, sql.linear(), select="SELECT node FROM linear"))
def linear_nodes(spark, sf):
    return graph.linear_nodes(_edges(spark, sf))


# ---- pruning -----------------------------------------------------------------------------

_PRUNE_COUNTS = sql.counts(K_PRUNE)
_FLOORED = f"{_PRUNE_COUNTS}, live0 AS MATERIALIZED (SELECT kmer, cnt FROM counts WHERE cnt >= {FLOOR})"


def _pass_sql(i: int, k: int = K_PRUNE, relative: float = RELATIVE) -> str:
    """One relative pass over ``live<i>``, as weak<i> and live<i + 1>."""
    step = sql.edges(k, f"live{i}").replace("ends AS", f"ends{i} AS").replace("FROM ends", f"FROM ends{i}")
    step = step.replace("edges AS", f"edges{i} AS")
    return f"""{step},
weak{i} AS MATERIALIZED (SELECT DISTINCT e.kmer FROM edges{i} e
  JOIN (SELECT src, max(w) AS m FROM edges{i} GROUP BY src) x ON x.src = e.src
  WHERE e.w::FLOAT < {relative}::FLOAT * x.m::FLOAT),
live{i + 1} AS MATERIALIZED (SELECT * FROM live{i} WHERE kmer NOT IN (SELECT kmer FROM weak{i}))"""


@query(
    sql.statement(
        _PRUNE_COUNTS,
        select=f"""SELECT count(*) FILTER (cnt < {FLOOR}) AS dropped, count(*) FILTER (cnt >= {FLOOR}) AS kept,
  (sum(cnt) FILTER (cnt >= {FLOOR}))::BIGINT AS kept_weight FROM counts""",
    )
)
def floor_prune(spark, sf):
    before = save_scratch(_counts(spark, sf, K_PRUNE))
    after = graph.floor_prune(before, FLOOR)
    return after.agg(F.count("*").alias("kept"), F.sum("cnt").alias("kept_weight")).select(
        (before.agg(F.count("*")).scalar() - F.col("kept")).alias("dropped"), "kept", "kept_weight"
    )


@query(sql.statement(_FLOORED, _pass_sql(0), select="SELECT kmer FROM weak0"))
def relative_prune_pass(spark, sf):
    floored = save_scratch(graph.floor_prune(_counts(spark, sf, K_PRUNE), FLOOR))
    return graph.weak_kmers(floored, K_PRUNE, RELATIVE).select(_text(k=K_PRUNE).alias("kmer"))


@query(
    sql.statement(
        _FLOORED,
        *[_pass_sql(i) for i in range(3)],
        select="""SELECT cnt, count(*) AS n_kmers, (SELECT count(*) FROM weak2) AS left_to_prune
FROM live3 GROUP BY cnt""",
    )
)
def prune_fixpoint(spark, sf):
    counts = save_scratch(_counts(spark, sf, K_PRUNE))
    live = save_scratch(graph.prune(counts, K_PRUNE, FLOOR, RELATIVE))
    still_weak = graph.weak_kmers(live, K_PRUNE, RELATIVE).agg(F.count("*")).scalar()
    return kmers.spectrum(live).withColumn("left_to_prune", still_weak)


# ---- unitigs -----------------------------------------------------------------------------

_UNITIGS = f"{_DOC_COUNTS}, {sql.edges(K)}, {sql.unitigs(K)}"
_SMALL_UNITIGS = f"{_SMALL_EDGES}, {sql.unitigs(K_GRAPH)}"


def _unitigs(spark: SparkSession, sf: str) -> DataFrame:
    return unitigs.compact_unitigs(kmers.saved_counts(_reads(spark, sf), K), K, drop_counts=True)


def _small_unitigs(spark: SparkSession, sf: str) -> DataFrame:
    return unitigs.compact_unitigs(save_scratch(_small_counts(spark, sf)), K_GRAPH)


@query(
    sql.statement(
        _SMALL_EDGES,
        sql.linear(),
        select="SELECT eid, src, dst FROM edges WHERE src NOT IN (SELECT node FROM linear)",
    )
)
def unitig_starts(spark, sf):
    starts = unitigs.unitig_starts(save_scratch(_small_counts(spark, sf)), K_GRAPH)
    return starts.select((F.col("kmer") * 2 + F.col("dir")).alias("eid"), "src", "dst")


@query(
    sql.statement(
        _UNITIGS,
        select="""SELECT uid, ring::BIGINT AS ring, src, dst, w_sum, n_edges, bases,
  round((w_sum::FLOAT / n_edges::FLOAT)::FLOAT::DOUBLE, 3) AS mean_w FROM unitigs""",
    )
)
def unitig_table(spark, sf):
    return _unitigs(spark, sf).select(
        "uid",
        F.col("ring").cast("bigint").alias("ring"),
        "src",
        "dst",
        "w_sum",
        "n_edges",
        "bases",
        F.round(F.col("mean_w").cast("double"), 3).alias("mean_w"),
    )


@query(
    sql.statement(
        _UNITIGS, select="SELECT uid, src, w_sum, n_edges, bases FROM unitigs WHERE ring = 1"
    )
)
def unitig_rings(spark, sf):
    return _unitigs(spark, sf).filter("ring").select("uid", "src", "w_sum", "n_edges", "bases")


@query(sql.statement(_UNITIGS, select="SELECT uid, twin_uid FROM unitigs"))
def unitig_twins(spark, sf):
    return _unitigs(spark, sf).select("uid", "twin_uid")


@query(
    sql.statement(
        _UNITIGS,
        select="""SELECT count(*) AS n_unitigs, sum(ring)::BIGINT AS n_rings, sum(n_edges)::BIGINT AS n_edges,
  max(n_edges) AS longest, round(max((w_sum::FLOAT / n_edges::FLOAT)::FLOAT)::DOUBLE, 3) AS max_mean_w FROM unitigs""",
    )
)
def unitig_stats(spark, sf):
    stats = unitigs.unitig_stats(_unitigs(spark, sf))
    return stats.withColumn("max_mean_w", F.round(F.col("max_mean_w").cast("double"), 3))


@query(
    sql.statement(
        _SMALL_UNITIGS,
        select=f"SELECT uid, {sql.node_text('src', K_GRAPH - 1)} || bases AS sequence FROM unitigs",
    )
)
def unitig_sequences(spark, sf):
    return unitigs.unitig_sequence(_small_unitigs(spark, sf), K_GRAPH)


# ---- components and contigs --------------------------------------------------------------

_COMPONENTS = sql.components()


def _recursive(statement: str) -> str:
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _recursive(
        sql.statement(
            _UNITIGS,
            _COMPONENTS,
            select="SELECT uid, label AS component FROM unitigs JOIN cc ON node = src // 2",
        )
    )
)
def unitig_components(spark, sf):
    return components.unitig_components(_unitigs(spark, sf)).select("uid", "component")


@query(
    _recursive(
        sql.statement(
            _SMALL_UNITIGS,
            _COMPONENTS,
            select="""SELECT label AS component, count(*) AS n_unitigs, sum(n_edges)::BIGINT AS n_edges
FROM unitigs JOIN cc ON node = src // 2 GROUP BY label""",
        )
    )
)
def component_sizes(spark, sf):
    return components.component_sizes(components.unitig_components(_small_unitigs(spark, sf)))


_CONTIG_COLUMNS = "contig_id, sequence, length, mean_coverage, n_unitigs, component"


@query(
    _recursive(
        sql.statement(
            _UNITIGS, _COMPONENTS, sql.walks(), sql.assembled(K), select=f"SELECT {_CONTIG_COLUMNS} FROM assembled"
        )
    )
)
def contig_table(spark, sf):
    found = contigs.traverse_contigs(_unitigs(spark, sf), K, drop_unitigs=True)
    return found.select("contig_id", "sequence", "length", "mean_coverage", "n_unitigs", "component")


@query(
    _recursive(
        sql.statement(
            _UNITIGS, _COMPONENTS, sql.walks(), sql.assembled(K, 100), select=f"SELECT {_CONTIG_COLUMNS} FROM assembled"
        )
    )
)
def contigs_min_length(spark, sf):
    return contigs.traverse_contigs(_unitigs(spark, sf), K, min_length=100, drop_unitigs=True)


@query(
    sql.statement(
        _SMALL_UNITIGS,
        f"texts AS (SELECT {sql.node_text('src', K_GRAPH - 1)} || bases AS s FROM unitigs)",
        select=f"SELECT DISTINCT least(s, {sql._rc('s')}) AS strand FROM texts",
    )
)
def contigs_dedup(spark, sf):
    """Removal of twins, applied to every unitig as a contig of its own."""
    found = _small_unitigs(spark, sf)
    single = unitigs.unitig_sequence(found, K_GRAPH).select(
        "sequence",
        F.lit(1.0).cast("float").alias("mean_coverage"),
        F.lit(1).alias("n_unitigs"),
        F.lit(0).alias("component"),
        F.col("uid").alias("emitted"),
    )
    return contigs.drop_twins(single).select(dna.canonical(F.col("sequence")).alias("strand"))


@query(
    sql.statement(
        sql.contigs(),
        select="""SELECT contig_id AS item, length(sequence) AS length,
  row_number() OVER (ORDER BY length(sequence) DESC, contig_id) AS rank FROM contigs""",
    )
)
def contig_ranks(spark, sf):
    sized = _contigs(spark, sf).select(
        F.col("contig_id").alias("item"), F.col("length").cast("bigint").alias("length")
    )
    ranked = ordering.with_rank(sized, [F.desc("length"), F.asc("item")], "rank")
    return ranked.select("item", "length", F.col("rank").cast("bigint").alias("rank"))


# ---- mapping and abundance ---------------------------------------------------------------

_MAJORITY = sql.majority(K_MAP, MIN_HITS)


@query(sql.statement(sql.index(K_MAP), select="SELECT kmer, contig_id FROM idx"))
def contig_index(spark, sf):
    return mapping.contig_index(_contigs(spark, sf), K_MAP).select(_text(k=K_MAP).alias("kmer"), "contig_id")


@query(sql.statement(sql.hits(K_MAP), select="SELECT read_id, pos, contig_id FROM hits"))
def read_hits(spark, sf):
    index = mapping.stored_index(_contigs(spark, sf), K_MAP)
    found = mapping.read_hits(reads.drop_no_calls(_reads(spark, sf)), index, K_MAP)
    return found.select("read_id", F.col("pos").cast("bigint").alias("pos"), "contig_id")


@query(sql.statement(_MAJORITY, select="SELECT read_id, contig_id, hits FROM assigned"))
def map_majority(spark, sf):
    return _assigned(spark, sf)


@query(sql.statement(_MAJORITY, select="SELECT read_id, contig_id, hits FROM assigned"))
def map_majority_joined(spark, sf):
    """The same by votes in SQL columns over a table of hits."""
    kept = reads.drop_no_calls(_reads(spark, sf))
    hits = mapping.read_hits(kept, mapping.stored_index(_contigs(spark, sf), K_MAP), K_MAP)
    none = F.lit(0).cast("bigint")
    voted = kept.select("read_id").join(mapping.vote_majority(hits, MIN_HITS), "read_id", "left")
    return voted.select("read_id", F.coalesce("contig_id", none).alias("contig_id"), F.coalesce("hits", none).alias("hits"))


@query(
    sql.statement(
        sql.hits(K_MAP),
        f"""best AS (SELECT read_id, contig_id, n, row_number() OVER (PARTITION BY read_id ORDER BY n DESC, contig_id) AS rn
  FROM (SELECT read_id, contig_id, count(*) AS n FROM hits GROUP BY read_id, contig_id))""",
        select=f"""SELECT k.read_id, CASE WHEN b.n >= {MIN_HITS} THEN b.contig_id ELSE 0 END AS contig_id,
  coalesce(b.n, 0) AS hits FROM kept k LEFT JOIN best b ON b.read_id = k.read_id AND b.rn = 1""",
    )
)
def map_plurality(spark, sf):
    return _assigned(spark, sf, vote="plurality")


@query(
    sql.statement(
        _MAJORITY,
        select="SELECT contig_id, count(*) AS raw_count FROM assigned WHERE contig_id <> 0 GROUP BY contig_id",
    )
)
def raw_counts(spark, sf):
    return mapping.raw_counts(_assigned(spark, sf))


@query(
    sql.statement(
        _MAJORITY,
        select="""SELECT count(*) AS n_reads, (SELECT count(*) FROM reads WHERE contains(seq, 'N')) AS n_dropped,
  count(*) FILTER (contig_id <> 0) AS n_mapped FROM assigned""",
    )
)
def mapping_summary(spark, sf):
    dropped = reads.read_stats(_reads(spark, sf)).select("n_dropped")
    return mapping.mapping_summary(_assigned(spark, sf), dropped)


_ABUNDANCE = sql.abundance(K_MAP, MIN_HITS)


def _abundance(spark: SparkSession, sf: str) -> DataFrame:
    return ab.abundance_from_assignments(_contigs(spark, sf), _assigned(spark, sf))


@query(
    sql.statement(
        _ABUNDANCE,
        select="""SELECT contig_id, contig_length, raw_count, round(rpkm, 4) AS rpkm, round(tpm, 4) AS tpm,
  1.0::DOUBLE AS mean_coverage FROM ab""",
    )
)
def abundance_rpkm_tpm(spark, sf):
    return _abundance(spark, sf).select(
        "contig_id",
        F.col("contig_length").cast("bigint").alias("contig_length"),
        "raw_count",
        F.round("rpkm", 4).alias("rpkm"),
        F.round("tpm", 4).alias("tpm"),
        F.col("mean_coverage").cast("double").alias("mean_coverage"),
    )


@query(
    sql.statement(
        sql.contigs(),
        select="""SELECT contig_id, '>contig_' || contig_id || ' length=' || length(sequence) || ' coverage=1.0' || chr(10)
  || rtrim(regexp_replace(sequence, '(.{70})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM contigs""",
    )
)
def fasta_lines(spark, sf):
    return outputs.fasta_records(_contigs(spark, sf))


def _plain(value: str, digits: int) -> str:
    text = f"round({value}, {digits})::DECIMAL(38, {digits})::VARCHAR"
    return f"regexp_replace({text}, '(\\.[0-9]+?)0+$', '\\1')"


@query(
    sql.statement(
        _ABUNDANCE,
        select=f"""SELECT contig_id, concat_ws(chr(9), 'contig_' || contig_id, contig_length, raw_count,
  {_plain('rpkm', 4)}, {_plain('tpm', 4)}, '1.0') AS value FROM ab""",
    )
)
def abundance_tsv_lines(spark, sf):
    return outputs.tsv_rows(_abundance(spark, sf))


# ---- checks against known sequences ------------------------------------------------------

_TRUTH = f"{sql.reads()}, {sql.windows(K)}, {_ITEM_KMERS}"


@query(
    sql.statement(
        _TRUTH,
        select="SELECT read_id, count(*) AS n_known FROM kmers WHERE kmer IN (SELECT kmer FROM items) GROUP BY read_id",
    )
)
def truth_semi_join(spark, sf):
    found = compare.known_kmers(kmers.extract_kmers(_reads(spark, sf), K), _item_kmers(spark, sf))
    return found.groupBy("read_id").agg(F.count("*").alias("n_known"))


@query(
    sql.statement(
        _TRUTH,
        select="""SELECT read_id, count(*) AS n_unknown FROM kmers
WHERE kmer NOT IN (SELECT kmer FROM items) GROUP BY read_id""",
    )
)
def truth_anti_join(spark, sf):
    found = compare.unknown_kmers(kmers.extract_kmers(_reads(spark, sf), K), _item_kmers(spark, sf))
    return found.groupBy("read_id").agg(F.count("*").alias("n_unknown"))


@query(
    sql.statement(
        sql.contigs(),
        f"texts AS (SELECT doc_id AS text_id, {sql._dna('')} AS sequence FROM documents)",
        select=f"""SELECT c.contig_id, t.text_id FROM contigs c JOIN texts t
ON contains(t.sequence, c.sequence) OR contains(t.sequence, {sql._rc('c.sequence')})""",
    )
)
def substring_containment(spark, sf):
    texts = contigs_from_text(_table(spark, sf, "documents", "doc_id", "text"), "doc_id").select(
        (F.col("contig_id") - 1).alias("text_id"), "sequence"
    )
    return compare.contained_in(_contigs(spark, sf), texts, K)


@query(
    sql.statement(
        f"texts AS (SELECT {sql._dna('')} AS s FROM documents)",
        select=f"""SELECT least(s, {sql._rc('s')}) AS strand, count(*) AS n FROM texts
WHERE length(s) >= 100 GROUP BY 1 HAVING count(*) > 1""",
    )
)
def repeated_contigs(spark, sf):
    texts = contigs_from_text(_table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    return compare.repeated_contigs(texts, min_length=100)


# ---- streaming and the whole run ---------------------------------------------------------


@query(
    sql.statement(
        _MAJORITY,
        select="""SELECT contig_id, count(*) AS n FROM assigned GROUP BY contig_id
UNION ALL SELECT -1, count(*) FROM reads WHERE contains(seq, 'N')""",
    )
)
def stream_map_counts(spark, sf):
    """Documents read as a stream until all of the table is done."""
    path = f"{sf}/documents.parquet"
    table = spark.read.parquet(path)
    files = spark.readStream.schema(table.schema)
    # The table may be one file, which a stream finds in its folder only, or a folder of files.
    name = "/documents.parquet"
    if any(f.endswith(name) and not f.endswith(name * 2) for f in table.inputFiles()):
        docs = files.option("pathGlobFilter", "documents.parquet").parquet(sf)
    else:
        docs = files.parquet(path)
    stream = reads_from_text(docs, "doc_id")
    mapper = mapping.ReadMapper(_contigs(spark, sf), k=K_MAP, min_hits=MIN_HITS)
    folder = scratch_path(spark)
    run = streaming.count_stream(stream, mapper, f"{folder}/counts", f"{folder}/state", availableNow=True)
    run.awaitTermination()
    return streaming.stream_totals(spark, f"{folder}/counts")


def _as_fastq(every: DataFrame) -> DataFrame:
    quality = F.expr("repeat('I', length(seq))").alias("qual")
    return every.select(F.col("read_id").cast("string").alias("name"), "seq", quality)


@query(sql.statement(sql.reads(), select="SELECT read_id, seq, length(seq) AS len FROM reads"))
def fastq_roundtrip(spark, sf):
    """The reads written as FASTQ, plain, gzip and block-gzip, and read again in small byte ranges."""
    every, folder = save_scratch(_reads(spark, sf)), scratch_path(spark)
    kinds = ("none", "gzip", "block_gzip")
    for mate, kind in enumerate(kinds):
        part = every.filter(F.pmod("read_id", F.lit(len(kinds))) == mate)
        outputs.write_fastq(_as_fastq(part), f"{folder}/{kind}", kind)
    found = fastq.read_fastq(spark, *(f"{folder}/{kind}" for kind in kinds), with_quality=True, split_bytes=1 << 16)
    whole = found.filter(F.length("qual") == F.length("seq"))
    return whole.select(F.col("name").cast("bigint").alias("read_id"), "seq", F.length("seq").cast("bigint").alias("len"))


_LANES = 5


@query(
    sql.statement(
        sql.reads(),
        f"""laned AS (
  SELECT read_id, (read_id // 4294967296) % 7 % {_LANES} AS lane FROM reads),
recorded AS (
  SELECT *, row_number() OVER (PARTITION BY lane ORDER BY read_id) - 1 AS record FROM laned)""",
        select="""SELECT read_id, (lane + 1)::INT AS mate, record, row_number() OVER (ORDER BY record, lane) - 1 AS ordinal
FROM recorded""",
    )
)
def fastq_interleaved(spark, sf):
    """The reads in five files of unequal length, sorted in each, numbered as the files take turns."""
    every, folder = _reads(spark, sf), scratch_path(spark)
    lane = F.pmod(F.pmod(F.shiftright("read_id", 32), F.lit(7)), F.lit(_LANES)).cast("int").alias("lane")
    text = F.format_string("@%d\n%s\n+\n%s", "read_id", "seq", F.expr("repeat('I', length(seq))"))
    # Records become text after they are sorted, so that only the bases travel.
    dealt = every.select(lane, "read_id", "seq").repartition(_LANES, "lane").sortWithinPartitions("lane", "read_id")
    lines = dealt.select("lane", text.alias("value"))
    lines.write.partitionBy("lane").text(f"{folder}/lanes")
    paths = [f"{folder}/lanes/lane={i}" for i in range(_LANES)]
    found = fastq.read_fastq(spark, *paths, with_quality=True, split_bytes=1 << 18, numbered=True)
    return found.select(F.col("name").cast("bigint").alias("read_id"), "mate", "record", "ordinal")


@query(ORACLES["stream_map_counts"])
def fastq_stream_counts(spark, sf):
    """The reads written as FASTQ and mapped as a stream of files."""
    folder = scratch_path(spark)
    outputs.write_fastq(_as_fastq(_reads(spark, sf)), f"{folder}/reads", "gzip")
    mapper = mapping.ReadMapper(_contigs(spark, sf), k=K_MAP, min_hits=MIN_HITS)
    stream = fastq.stream_fastq(spark, f"{folder}/reads")
    run = streaming.count_stream(stream, mapper, f"{folder}/counts", f"{folder}/state", availableNow=True)
    run.awaitTermination()
    return streaming.stream_totals(spark, f"{folder}/counts")


@query(
    sql.statement(
        _MAJORITY,
        select="""SELECT * FROM (SELECT contig_id, count(*) AS n FROM assigned GROUP BY contig_id
UNION ALL SELECT -1, count(*) FROM reads WHERE contains(seq, 'N')) WHERE n > 0""",
    )
)
def stream_update_counts(spark, sf):
    """Two halves of the reads written as FASTQ and counted in update mode as they come; each contig's last update."""
    every, folder = save_scratch(_reads(spark, sf)), scratch_path(spark)
    mapper = mapping.ReadMapper(_contigs(spark, sf), k=K_MAP, min_hits=MIN_HITS)
    for half in (0, 1):
        own = _as_fastq(every.filter(F.pmod("read_id", F.lit(2)) == half))
        outputs.fastq_records(own).write.mode("append").option("compression", "gzip").text(f"{folder}/reads")
        stream = fastq.stream_fastq(spark, f"{folder}/reads")
        streaming.keep_totals(stream, mapper, f"{folder}/kept", f"{folder}/state", availableNow=True).awaitTermination()
    return streaming.complete(spark, f"{folder}/kept")


# Two passes: the second finds nothing, which is what ends the loop.
_ASSEMBLED = ", ".join(
    part.strip()
    for part in (
        sql.counts(K),
        "live0 AS MATERIALIZED (SELECT * FROM counts)",
        _pass_sql(0, K, AssemblyOptions.relative_threshold),
        _pass_sql(1, K, AssemblyOptions.relative_threshold),
        sql.edges(K, "live2"),
        sql.unitigs(K),
        sql.components(),
        sql.walks(),
        sql.assembled(K, AssemblyOptions.min_contig_length),
        "contigs AS (SELECT contig_id, sequence FROM assembled)",
    )
)


@query(
    _recursive(
        sql.statement(
            sql.abundance(K, MIN_HITS, _ASSEMBLED),
            select="""SELECT contig_id, contig_length, raw_count, round(rpkm, 4) AS rpkm, round(tpm, 4) AS tpm, mean_coverage
FROM ab JOIN assembled USING (contig_id)""",
        )
    )
)
def assembly(spark, sf):
    """Reads to contigs to abundance in one go."""
    every = _reads(spark, sf)
    found = assemble(every, AssemblyOptions())
    assigned = mapping.map_reads(every, found, k=K, min_hits=MIN_HITS)
    return ab.abundance_from_assignments(found, assigned).select(
        "contig_id",
        F.col("contig_length").cast("bigint").alias("contig_length"),
        "raw_count",
        F.round("rpkm", 4).alias("rpkm"),
        F.round("tpm", 4).alias("tpm"),
        "mean_coverage",
    )
