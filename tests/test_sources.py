import gzip
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandweave.operators import mapping, reads
from strandweave.sources import block_gzip, fastq, kmer_dump, outputs
from tests.synthetic import simulate_pairs
from strandweave.sources.text_reads import contigs_from_text, reads_from_text
from strandweave.streaming import mapping as streaming


def _records(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randint(1, 60)
        seq = "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=size))
        # Qualities that look like headers and separators.
        out.append((f"read {i}", seq, "".join(rng.choices("@+I#", k=size))))
    return out


def _text(records, end="\n"):
    return end.join(line for name, seq, qual in records for line in (f"@{name}", seq, "+", qual)) + end


@pytest.mark.parametrize("split", [37, 100, 1000, 1 << 20])
def test_any_split_reads_every_record_once(spark, tmp_path, split):
    records = _records(40)
    path = tmp_path / "r.fastq"
    path.write_text(_text(records))
    got = fastq.read_fastq(spark, str(path), with_quality=True, split_bytes=split).collect()
    assert sorted((r.name, r.seq, r.qual) for r in got) == sorted(records)
    assert len({r.read_id for r in got}) == len(records)
    text = path.read_text()
    assert all(text[r.offset :].startswith(f"@{r.name}\n") for r in got)


def test_blocks_do_not_matter(spark, tmp_path):
    records = _records(60, 1)
    path = tmp_path / "r.fastq"
    path.write_text(_text(records))
    before, fastq.BLOCK_BYTES = fastq.BLOCK_BYTES, 17
    try:
        whole = fastq._read_range(fastq.FastqRange(str(path), str(path), 0, -1))
        assert [line.decode() for _, lines in whole for line in lines][1::4] == [s for _, s, _ in records]
        size, seen = path.stat().st_size, []
        for start in range(0, size, 50):
            for _, lines in fastq._read_range(fastq.FastqRange(str(path), str(path), start, start + 50)):
                seen += [line.decode() for line in lines][1::4]
        assert seen == [s for _, s, _ in records]
    finally:
        fastq.BLOCK_BYTES = before


def test_gzip_crlf_pairs_and_folders(spark, tmp_path):
    one, two = _records(30, 2), _records(20, 3)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.fastq").write_text(_text(one))
    (tmp_path / "a" / "y.fastq.GZ").write_bytes(gzip.compress(_text(one).encode()))
    (tmp_path / "b.fastq").write_bytes(_text(two, "\r\n").encode())
    got = fastq.read_fastq(spark, str(tmp_path / "a"), str(tmp_path / "b.fastq")).collect()
    assert len({r.read_id for r in got}) == 80
    assert sorted(r.seq for r in got if r.mate == 1) == sorted([s for _, s, _ in one] * 2)
    assert sorted(r.seq for r in got if r.mate == 2) == sorted(s for _, s, _ in two)


def test_empty_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.fastq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "empty.fastq")).count() == 0
    (tmp_path / "short.fastq").write_text("@a\nACGT\n+\n")
    (tmp_path / "wrong.fastq").write_text("a\nACGT\n+\nIIII\n")
    for name in ("short", "wrong"):
        with pytest.raises(PySparkException):
            fastq.read_fastq(spark, str(tmp_path / f"{name}.fastq")).count()
    with pytest.raises(FileNotFoundError):
        fastq.read_fastq(spark, str(tmp_path / "missing.fastq"))


def test_simulated_truth(spark, tmp_path):
    one, two, truth = simulate_pairs(spark)
    assert len(truth.transcripts) == 3 and all(len(t) == 500 for t in truth.transcripts)
    assert 400 <= truth.n_pairs <= 432 and truth.coverages == (10, 50, 200)
    paths = []
    for name, mate, how in (("r1", one, "none"), ("r2", two, "gzip")):
        paths.append(str(tmp_path / name))
        outputs.write_fastq(mate, paths[-1], how)
    loaded = fastq.read_fastq(spark, *paths, with_quality=True)
    rows = loaded.collect()
    assert len(rows) == truth.n_reads and all(len(r.seq) == len(r.qual) == 151 for r in rows)
    assert reads.read_stats(loaded).first().n_dropped == 0
    again = simulate_pairs(spark)[0]
    assert again.repartition(7).exceptAll(one).isEmpty()
    # About one base in a hundred is wrong.
    clean = simulate_pairs(spark, error_rate=0.0)[0].withColumnRenamed("seq", "clean")
    wrong = sum(
        a != b for r in one.join(clean, "name").collect() for a, b in zip(r.seq, r.clean)
    )
    assert 0.005 < wrong / (truth.n_pairs * 151) < 0.015
    assert all(any(r.clean in t for t in truth.transcripts) for r in clean.collect())


def test_text_windows_cover_the_text(spark):
    texts = [(1, "Ab c-d" * 50), (2, "xyz"), (3, ""), (4, "é!"), (5, "q" + "a" * 150), (6, "a" * 152)]
    df = spark.createDataFrame(texts, "id long, text string")
    rows = reads_from_text(df, "id").collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.read_id >> 32, []).append((r.read_id & 0xFFFFFFFF, r.seq))
    whole = {r.contig_id - 1: r.sequence for r in contigs_from_text(df, "id").collect()}
    assert set(by_text) == {1, 2, 5, 6}
    for i, windows in by_text.items():
        covered = set()
        for at, seq in windows:
            assert len(seq) <= 151 and whole[i][at : at + len(seq)] == seq.replace("N", "A")
            covered |= set(range(at, at + len(seq)))
        assert covered == set(range(len(whole[i])))
    assert by_text[5][0][1].startswith("N") and len(by_text[6]) == 2


def test_output_text(spark, tmp_path):
    contigs = spark.createDataFrame([(1, "ACGT" * 40, 12.345), (2, "ACG", 2.0)], "contig_id long, sequence string, mean_coverage float")
    path = str(tmp_path / "c.fasta")
    outputs.write_contigs_fasta(contigs, path, min_length=4)
    text = "\n".join(r.value for r in spark.read.text(path).collect()).split("\n")
    assert text[0] == ">contig_1 length=160 coverage=12.35" or text[0] == ">contig_1 length=160 coverage=12.34"
    assert [len(line) for line in text[1:]] == [70, 70, 20]
    values = spark.createDataFrame([(0.125,), (15.0,), (1e8 + 0.5,), (2.00005,)], "x double")
    assert [r[0] for r in values.select(outputs.decimal_text(F.col("x"), 2)).collect()] == ["0.12", "15.0", "100000000.5", "2.0"]


def test_streams_match_batch(spark, tmp_path):
    records = [(n, s, q) for n, s, q in _records(200, 4) if len(s) >= 20]
    folder = tmp_path / "in"
    folder.mkdir()
    contigs = spark.createDataFrame(
        [(i + 1, s, 1.0) for i, (_, s, _) in enumerate(records[:10]) if "N" not in s],
        "contig_id long, sequence string, mean_coverage float",
    )
    mapper = mapping.ReadMapper(contigs, k=7, min_hits=3)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    kept, log = str(tmp_path / "kept"), str(tmp_path / "log")

    def run():
        stream = fastq.stream_fastq(spark, str(folder))
        streaming.count_stream(stream, mapper, out, state, availableNow=True).awaitTermination()
        stream = fastq.stream_fastq(spark, str(folder))
        streaming.keep_totals(stream, mapper, kept, log, availableNow=True).awaitTermination()

    (folder / "a.fastq").write_text(_text(records[:60]))
    run()
    (folder / "b.fastq").write_text(_text(records[60:]))
    (folder / "c.fastq").write_text(_text(records[:5]))
    run()
    totals = streaming.stream_totals(spark, out)
    batch = fastq.read_fastq(spark, str(folder))
    assigned = mapper.assign(batch)
    assert streaming.stream_raw_counts(totals).exceptAll(mapping.raw_counts(assigned)).isEmpty()
    dropped = reads.read_stats(batch).select("n_dropped")
    expected = mapping.mapping_summary(assigned, dropped).first()
    assert tuple(streaming.stream_summary(totals).first()) == tuple(expected)
    assert expected.n_reads + expected.n_dropped == len(records) + 5

    assert streaming.complete(spark, kept).exceptAll(totals.filter("n > 0")).isEmpty()
    changes = streaming.updates(spark, kept).orderBy("version").collect()
    assert len({r.version for r in changes}) == 2
    for r in changes:
        assert all(other.n < r.n for other in changes if other.contig_id == r.contig_id and other.version < r.version)

    live = streaming.running_counts(fastq.stream_fastq(spark, str(folder)), mapper)
    query = live.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live").exceptAll(mapping.raw_counts(assigned)).isEmpty()


def test_stream_takes_late_files_and_numbers_them_apart(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = fastq.stream_fastq(spark, str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True
        ).start().awaitTermination()
        return spark.read.parquet(out)

    (folder / "b.fastq").write_text(_text([("x", "ACGT", "IIII")] * 3))
    assert run().count() == 3
    for name, n, age in (("a.fastq", 5, 1000), ("c.fastq", 2, 0)):
        (folder / name).write_text(_text([("x", "ACGT", "IIII")] * n))
        os.utime(folder / name, (os.path.getmtime(folder / "b.fastq") - age,) * 2)
    found = run()
    assert found.count() == 10 and found.select("read_id").distinct().count() == 10


def test_blank_lines_may_only_end_a_file(spark, tmp_path):
    path = tmp_path / "a.fastq"
    record = _text([("x", "ACGT", "IIII")])
    path.write_text(record + "\n\n\n\n\n")
    assert fastq.read_fastq(spark, str(path)).count() == 1
    path.write_text(record + "\n\n\n\n" + record)
    with pytest.raises(Exception, match="blank lines"):
        fastq.read_fastq(spark, str(path)).count()


def test_large_counts_of_a_dump_are_not_dropped(spark):
    lines = spark.createDataFrame([("ACG\t1234567890123456789",), ("TTT\t2",)], "value string")
    assert {r.cnt for r in kmer_dump.parse_dump(lines, 3).collect()} == {1234567890123456789, 2}
    lines = spark.createDataFrame([("ACG\t12345678901234567890",)], "value string")
    with pytest.raises(Exception, match="count too large"):
        kmer_dump.parse_dump(lines, 3).collect()


def _block_gzip(text: bytes, size: int) -> bytes:
    before, block_gzip.PLAIN_BYTES = block_gzip.PLAIN_BYTES, size
    try:
        return b"".join(block_gzip.packed([text[i : i + 1000] for i in range(0, len(text), 1000)]))
    finally:
        block_gzip.PLAIN_BYTES = before


@pytest.mark.parametrize("size, split", [(20, 60), (50, 100), (333, 1000), (5000, 700), (0xFF00, 1 << 20)])
def test_block_gzip_is_read_in_ranges(spark, tmp_path, size, split):
    records = _records(300, 5)
    plain, path = tmp_path / "r.fastq", tmp_path / "r.fastq.gz"
    plain.write_text(_text(records))
    path.write_bytes(_block_gzip(plain.read_bytes(), size))
    assert gzip.decompress(path.read_bytes()) == plain.read_bytes()
    found = fastq.read_fastq(spark, str(path), with_quality=True, split_bytes=split)
    want = fastq.read_fastq(spark, str(plain), with_quality=True)
    columns = ["read_id", "offset", "name", "seq", "qual"]
    assert sorted(found.select(columns).collect()) == sorted(want.select(columns).collect())
    if split < path.stat().st_size // 4:
        assert found.rdd.getNumPartitions() > 2


def test_block_gzip_starts_at_and_inside_lines(spark, tmp_path):
    """Blocks that end with a line, within one, and right before a record whose quality looks like a header."""
    text = b"".join(b"@r%d\nACGT\n+\n@@@@\n" % (i % 10) for i in range(40))
    for size in (16, 3, 4, 5, 11, 32):
        path = tmp_path / f"{size}.gz"
        path.write_bytes(_block_gzip(text, size))
        rows = fastq.read_fastq(spark, str(path), split_bytes=41).collect()
        assert sorted(r.offset for r in rows) == list(range(0, len(text), 16))


def test_broken_block_gzip(spark, tmp_path):
    path = tmp_path / "r.gz"
    whole = _block_gzip(_text(_records(50)).encode(), 200)
    path.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(PySparkException):
        fastq.read_fastq(spark, str(path), split_bytes=300).count()
    path.write_bytes(block_gzip.END * 20)
    assert fastq.read_fastq(spark, str(path), split_bytes=100).count() == 0


def test_plain_gzip_is_spread(spark, tmp_path):
    path = tmp_path / "r.gz"
    path.write_bytes(gzip.compress(_text(_records(200)).encode()))
    found = fastq.read_fastq(spark, str(path), split_bytes=100)
    assert found.count() == 200 and found.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("sizes", [(30, 30), (40, 7), (3, 20, 0, 11)])
def test_files_take_turns(spark, tmp_path, sizes):
    paths, queues = [], []
    for i, n in enumerate(sizes):
        records = [(f"{i}:{j}", seq, qual) for j, (_, seq, qual) in enumerate(_records(n, i))]
        text = _text(records).encode() if n else b""
        paths.append(str(tmp_path / f"{i}.fastq{'.gz' if i % 2 else ''}"))
        with open(paths[-1], "wb") as out:
            out.write(_block_gzip(text, 90) if i % 2 else text)
        queues.append([name for name, _, _ in records])
    want = [q[turn] for turn in range(max(sizes)) for q in queues if turn < len(q)]
    rows = fastq.read_fastq(spark, *paths, with_quality=True, split_bytes=150, numbered=True).collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.ordinal)] == want
    assert sorted(r.ordinal for r in rows) == list(range(len(want)))
    assert all(r.name == f"{r.mate - 1}:{r.record}" for r in rows)
