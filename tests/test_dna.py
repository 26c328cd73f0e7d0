import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.operators import reads
from tests import model


def test_encode_decode_and_drop(spark):
    df = spark.createDataFrame([(1, "ATGCAT"), (2, "ATNC"), (3, "atgc"), (4, "")], "read_id long, seq string")
    kept = {r.read_id: (list(r.codes), r.len) for r in reads.encode_reads(df).collect()}
    assert kept == {1: ([1, 2, 3, 4, 1, 2], 6), 3: ([1, 2, 3, 4], 4), 4: ([], 0)}
    every = reads.encode_reads(df, drop_with_n=False)
    assert {r.read_id: r.seq for r in reads.decode_reads(every).collect()} == {
        1: "ATGCAT", 2: "ATNC", 3: "ATGC", 4: "",
    }
    stats = reads.read_stats(df).first()
    assert (stats.n_reads, stats.n_dropped, stats.n_bases, stats.max_len) == (3, 1, 10, 6)


@pytest.mark.parametrize("k", [2, 3, 4, 15, 16, 30, 31])
def test_strings_and_packed_agree(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=k)) for _ in range(200)] + ["A" * k, "T" * k]
    s, p = F.col("s"), F.col("p")
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("p", dna.pack(s))
    rows = df.select(
        "s",
        "p",
        dna.unpack(p, k).alias("back"),
        dna.revcomp(s).alias("rc"),
        dna.unpack(dna.revcomp_packed(p, k), k).alias("rc_packed"),
        dna.canonical_kmer(F.lower(s), k).alias("canon"),
        dna.node_id(p, k).alias("node"),
        dna.node_string(dna.node_id(p, k), k).alias("node_text"),
        dna.node_string(dna.twin(dna.node_id(p, k)), k).alias("twin_text"),
    ).collect()
    for r in rows:
        assert r.p == model.pack(r.s) and r.back == r.s
        assert r.rc == r.rc_packed == model.rc(r.s)
        assert r.canon == model.pack(model.canonical(r.s))
        assert r.node == model.node(r.s)
        assert r.node_text == r.s and r.twin_text == model.rc(r.s)


def test_invalid_kmers(spark):
    df = spark.createDataFrame([("ACGT",), ("ACNT",), ("acgt",), ("ACG",)], "s string")
    parsed = [r[0] for r in df.select(dna.parse_kmer(F.col("s"), 4)).collect()]
    assert parsed == [model.pack("ACGT"), None, None, None]
    with pytest.raises(PySparkException):
        df.select(dna.canonical_kmer(F.col("s"), 4)).collect()
    for k in (1, 32):
        with pytest.raises(ValueError):
            dna.check_k(k)


def test_id_algebra(spark):
    row = spark.range(7, 8).select(
        (dna.twin(dna.forward_id(F.col("id"))) == dna.reverse_id(F.col("id"))).alias("a"),
        (dna.twin(dna.reverse_id(F.col("id"))) == dna.forward_id(F.col("id"))).alias("b"),
        dna.is_forward(dna.forward_id(F.col("id"))).alias("c"),
        (~dna.is_forward(dna.reverse_id(F.col("id")))).alias("d"),
        (dna.canonical_idx(dna.reverse_id(F.col("id"))) == F.col("id")).alias("e"),
    ).first()
    assert all(row)
