"""SQL statements that state the registered queries a second time, for another engine.

They share nothing with the Spark code: k-mers are cut from strings, nodes are packed by text
substitution, chains are ranked by a fixed number of self-joins.
"""

from __future__ import annotations

from strandweave.sources.text_reads import NO_CALL, READ_LEN, STRIDE

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _dna(no_call: str) -> str:
    bases = "".join("N" if c in no_call else "ACGT"[i % 4] for i, c in enumerate(_LETTERS))
    return f"translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{bases}')"


def _rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def _pack(s: str) -> str:
    for base, bits in zip("ACGT", ("00", "01", "10", "11")):
        s = f"replace({s}, '{base}', '{bits}')"
    return f"('0b' || {s})::BIGINT"


def reads(table: str = "documents", id_col: str = "doc_id", no_call: str = NO_CALL) -> str:
    return f"""
dna AS (SELECT {id_col} AS id, {_dna(no_call)} AS dna FROM {table}),
starts AS (
  SELECT id, dna, unnest(generate_series(
    0, greatest(0, ceil((length(dna) - {READ_LEN}) / {STRIDE}.0) * {STRIDE})::BIGINT, {STRIDE})) AS beg
  FROM dna WHERE length(dna) > 0),
reads AS (SELECT id * 4294967296 + beg AS read_id, substr(dna, beg + 1, {READ_LEN}) AS seq FROM starts)"""


def contigs() -> str:
    return f"contigs AS (SELECT item_id + 1 AS contig_id, {_dna('')} AS sequence FROM benchmark)"


def windows(k: int, source: str = "reads", id_col: str = "read_id", seq: str = "seq", name: str = "kmers") -> str:
    """``name(id, pos, kmer)``: canonical string k-mers without N."""
    return f"""
{name}_at AS (
  SELECT {id_col}, {seq} AS s, {_rc(seq)} AS r, length({seq}) AS len,
         unnest(generate_series(1, length({seq}) - {k} + 1)) AS pos
  FROM {source} WHERE length({seq}) >= {k}),
{name} AS (
  SELECT {id_col}, pos, least(substr(s, pos, {k}), substr(r, len - pos - {k} + 2, {k})) AS kmer
  FROM {name}_at WHERE NOT contains(substr(s, pos, {k}), 'N'))"""


def counts(k: int, min_count: int = 2, table: str = "documents", id_col: str = "doc_id") -> str:
    return f"""{reads(table, id_col)}, {windows(k)},
counts AS (SELECT kmer, count(*) AS cnt FROM kmers GROUP BY kmer HAVING count(*) >= {min_count})"""


def edges(k: int, source: str = "counts") -> str:
    """``edges(kmer, dir, src, dst, w, label, eid)`` with integer nodes and ids."""
    pre, suf = f"substr(kmer, 1, {k - 1})", "substr(kmer, 2)"

    def node(s: str) -> str:
        return f"CASE WHEN {s} <= {_rc(s)} THEN 2 * {_pack(s)} ELSE 2 * {_pack(_rc(s))} + 1 END"

    return f"""
ends AS (SELECT kmer, cnt, {node(pre)} AS u, {node(suf)} AS v, {_pack('kmer')} AS p FROM {source}),
edges AS MATERIALIZED (
  SELECT kmer, 0 AS dir, u AS src, v AS dst, cnt AS w, right(kmer, 1) AS label, 2 * p AS eid FROM ends
  UNION ALL
  SELECT kmer, 1, xor(v, 1::BIGINT), xor(u, 1::BIGINT), cnt, translate(left(kmer, 1), 'ACGT', 'TGCA'), 2 * p + 1
  FROM ends)"""


def linear() -> str:
    return """
outs AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY src),
linear AS MATERIALIZED (
  SELECT a.node FROM outs a JOIN outs b ON b.node = xor(a.node, 1::BIGINT) WHERE a.n = 1 AND b.n = 1)"""


def _doubling(prefix: str, links: str, rounds: int) -> str:
    """``prefix_<rounds>(id, anc, dist, low)`` after that many doublings of ``links(id, anc, low)``."""
    out = [f"{prefix}_0 AS MATERIALIZED (SELECT id, anc, 1::BIGINT AS dist, low FROM {links})"]
    for i in range(rounds):
        a = f"{prefix}_{i}"
        out.append(
            f"""{prefix}_{i + 1} AS MATERIALIZED (
  SELECT a.id, coalesce(b.anc, a.anc) AS anc, a.dist + coalesce(b.dist, 0) AS dist,
         least(a.low, coalesce(b.low, a.low)) AS low
  FROM {a} a LEFT JOIN {a} b ON b.id = a.anc)"""
        )
    return ",\n".join(out)


def unitigs(k: int, chain_rounds: int = 14, ring_rounds: int = 10) -> str:
    """``unitigs(uid, ring, src, dst, w_sum, n_edges, bases, twin_uid)`` from ``edges``.

    Chains of up to ``2^chain_rounds`` edges and rings of up to ``2^ring_rounds`` are ranked.
    """
    last = f"c_{chain_rounds}"
    return f"""{linear()},
links AS (
  SELECT e.eid AS id, p.eid AS anc, e.src AS low
  FROM edges e JOIN linear l ON l.node = e.src JOIN edges p ON p.dst = e.src),
{_doubling('c', 'links', chain_rounds)},
in_ring AS MATERIALIZED (SELECT c.id, c.low FROM {last} c JOIN links l ON l.id = c.anc),
leaders AS (SELECT e.eid, r.low FROM in_ring r JOIN edges e ON e.eid = r.id AND e.src = r.low),
ring_links AS (
  SELECT l.id, l.anc, l.low FROM links l
  WHERE l.id IN (SELECT id FROM in_ring) AND l.id NOT IN (SELECT eid FROM leaders)),
{_doubling('r', 'ring_links', ring_rounds)},
placed AS (
  SELECT id, anc AS head, dist AS rank, 0 AS ring FROM {last} WHERE id NOT IN (SELECT id FROM in_ring)
  UNION ALL SELECT id, anc, dist, 1 FROM r_{ring_rounds}
  UNION ALL SELECT eid, eid, 0, 1 FROM leaders
  UNION ALL SELECT eid, eid, 0, 0 FROM edges WHERE src NOT IN (SELECT node FROM linear)),
whole AS (
  SELECT head, max(ring) AS ring, min_by(src, rank) AS src, max_by(dst, rank) AS dst, sum(w)::BIGINT AS w_sum,
         count(*) AS n_edges, string_agg(label, '' ORDER BY rank) AS bases
  FROM placed JOIN edges ON eid = id GROUP BY head),
unitigs AS MATERIALIZED (
  SELECT w.head AS uid, w.ring, w.src, w.dst, w.w_sum, w.n_edges, w.bases, t.head AS twin_uid
  FROM whole w JOIN placed t ON t.id = xor(w.head, 1::BIGINT))"""


def node_text(node: str, n_bases: int) -> str:
    """(k-1)-mer of an integer node, through its bit string."""
    bits = f"right(bin({node} // 2)::VARCHAR, {2 * n_bases})"
    padded = f"lpad({bits}, {2 * n_bases}, '0')"
    text = (
        f"list_reduce(list_transform(range({n_bases}), lambda i: "
        f"CASE substr({padded}, (2 * i + 1)::INT, 2) WHEN '00' THEN 'A' WHEN '01' THEN 'C' "
        f"WHEN '10' THEN 'G' ELSE 'T' END), lambda a, x: a || x)"
    )
    return f"CASE WHEN {node} % 2 = 0 THEN {text} ELSE {_rc(text)} END"


def components() -> str:
    """``cc(node, label)``: the smallest canonical node that unitigs lead to. Needs ``WITH RECURSIVE``."""
    return """
pairs AS (SELECT DISTINCT src // 2 AS a, dst // 2 AS b FROM unitigs
  UNION SELECT DISTINCT dst // 2, src // 2 FROM unitigs),
cc(node, label) USING KEY (node) AS (
  SELECT a, min(a) FROM pairs GROUP BY a
  UNION
  SELECT p.b, min(c.label) FROM cc c JOIN pairs p ON p.a = c.node JOIN recurring.cc r ON r.node = p.b
  WHERE c.label < r.label GROUP BY p.b)"""


def walks() -> str:
    """``steps(uid, walk, step)`` over ``unitigs`` and ``cc``: every round, each component takes one step.

    The step goes to the best unvisited unitig at the end of the last one or, where there is none, to the
    unvisited unitig whose turn to begin a walk comes first. Needs ``WITH RECURSIVE``.
    """
    return """
weighed AS (
  SELECT uid, ring, src, dst, bases, n_edges, label AS component, (w_sum::FLOAT / n_edges::FLOAT)::FLOAT AS mean_w,
         src IN (SELECT dst FROM unitigs) AS late
  FROM unitigs JOIN cc ON node = src // 2),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (
      PARTITION BY component ORDER BY late, CASE WHEN late THEN 0 ELSE -mean_w END, ring, src, uid) AS turn,
    row_number() OVER (PARTITION BY src ORDER BY mean_w DESC, ring, uid) AS choice
  FROM weighed),
steps(uid, walk, step, component, dst) USING KEY (uid) AS (
  SELECT uid, uid, 0::BIGINT, component, dst FROM ranked WHERE turn = 1
  UNION
  SELECT best.uid, best.walk, best.step, component, best.dst
  FROM (
    SELECT component, arg_min({'uid': uid, 'walk': walk, 'step': step, 'dst': dst}, place) AS best
    FROM (
      SELECT r.component, r.uid, s.walk, s.step + 1 AS step, r.dst, r.choice AS place
      FROM steps s JOIN ranked r ON r.src = s.dst
      UNION ALL
      SELECT r.component, r.uid, r.uid, 0, r.dst, 1000000000000 + r.turn
      FROM steps s JOIN ranked r ON r.component = s.component) options
    WHERE uid NOT IN (SELECT uid FROM recurring.steps)
    GROUP BY component))"""


def assembled(k: int, min_length: int = 0) -> str:
    """``assembled(contig_id, sequence, length, mean_coverage, n_unitigs, component)`` from ``steps``.

    Coverage is added up in single precision, step by step. Of equal or reverse-complement contigs the first
    one stays: components by number, in each the walks in the order in which they begin.
    """
    return f"""
walked AS (
  SELECT walk, min(component) AS component, min(turn) AS turn, count(*) AS n_unitigs,
         min_by(src, step) AS src, string_agg(bases, '' ORDER BY step) AS bases,
         list_reduce(list((mean_w * n_edges::FLOAT)::FLOAT ORDER BY step), lambda a, x: (a + x)::FLOAT) AS weight,
         sum(n_edges)::FLOAT AS n_edges
  FROM steps JOIN ranked USING (uid, component, dst) GROUP BY walk),
spelled AS (
  SELECT w.component, r.turn, n_unitigs, {node_text('w.src', k - 1)} || w.bases AS sequence,
         (weight / w.n_edges)::FLOAT AS mean_coverage
  FROM walked w JOIN ranked r ON r.uid = w.walk),
single AS (
  SELECT * FROM spelled
  QUALIFY row_number() OVER (PARTITION BY least(sequence, {_rc('sequence')}) ORDER BY component, turn) = 1),
assembled AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY length(sequence) DESC, component, turn) AS contig_id, sequence,
         length(sequence)::INT AS length, mean_coverage, n_unitigs::INT AS n_unitigs, component
  FROM single WHERE length(sequence) >= {min_length})"""


def index(k: int, source: str | None = None) -> str:
    """``idx(kmer, contig_id)`` over the benchmark items, or over ``contigs`` that ``source`` defines."""
    return f"""{contigs() if source is None else source}, {windows(k, 'contigs', 'contig_id', 'sequence', 'ck')},
idx AS MATERIALIZED (SELECT kmer, min(contig_id) AS contig_id FROM ck GROUP BY kmer)"""


def hits(k: int, source: str | None = None) -> str:
    """``hits(read_id, pos, contig_id)`` of the kept reads, and ``kept``; a given ``source`` defines ``reads`` too."""
    return f"""{f'{reads()}, ' if source is None else ''}{index(k, source)},
kept AS MATERIALIZED (SELECT * FROM reads WHERE NOT contains(seq, 'N')),
{windows(k, 'kept', name='rk')},
hits AS MATERIALIZED (SELECT read_id, pos, contig_id FROM rk JOIN idx USING (kmer))"""


def majority(k: int, min_hits: int, source: str | None = None) -> str:
    """``assigned(read_id, contig_id, hits)`` by the running-candidate vote."""
    return f"""{hits(k, source)},
lists AS (SELECT read_id, list(contig_id ORDER BY pos) AS h FROM hits GROUP BY read_id),
folded AS (
  SELECT read_id, h, list_reduce(
    list_prepend({{'c': 0::BIGINT, 'n': 0::BIGINT, 's': 0::BIGINT}},
                 list_transform(h, lambda x: {{'c': x, 'n': 0::BIGINT, 's': 0::BIGINT}})),
    lambda a, x: CASE
      WHEN a.n = 0 THEN {{'c': x.c, 'n': 1::BIGINT, 's': 1::BIGINT}}
      WHEN a.c = x.c THEN {{'c': a.c, 'n': a.n + 1, 's': a.s + 1}}
      ELSE {{'c': a.c, 'n': a.n - 1, 's': a.s}} END) AS v
  FROM lists),
scored AS (
  SELECT read_id, v.c AS c,
         CASE WHEN v.n = v.s THEN v.s ELSE len(list_filter(h, lambda x: x = v.c)) END AS hits
  FROM folded),
assigned AS MATERIALIZED (
  SELECT kept.read_id, CASE WHEN hits >= {min_hits} THEN c ELSE 0 END AS contig_id, coalesce(hits, 0)::BIGINT AS hits
  FROM kept LEFT JOIN scored USING (read_id))"""


def abundance(k: int, min_hits: int, source: str | None = None) -> str:
    return f"""{majority(k, min_hits, source)},
tally AS MATERIALIZED (
  SELECT c.contig_id, length(c.sequence) AS contig_length,
         (SELECT count(*) FROM assigned a WHERE a.contig_id = c.contig_id) AS raw_count
  FROM contigs c),
ab AS (
  SELECT contig_id, contig_length, raw_count,
         raw_count / (contig_length / 1000.0::DOUBLE)
           / (greatest((SELECT sum(raw_count) FROM tally), 1)::DOUBLE / 1e6) AS rpkm,
         raw_count / (contig_length / 1000.0::DOUBLE)
           / (SELECT CASE WHEN sum(raw_count) = 0 THEN 1 ELSE sum(raw_count / (contig_length / 1000.0::DOUBLE)) END FROM tally)
           * 1e6 AS tpm
  FROM tally)"""


def statement(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select
