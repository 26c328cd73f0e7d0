"""Block-gzip: gzip files made of small members that state their own length, so that reading can begin at any of them."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

# Fixed values of the format: start of a member with an extra field, the empty member at the end of a file.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: A block has at most 64 KiB, compressed or not.
LONGEST = 1 << 16
PLAIN_BYTES = 0xFF00


def _block_length(f, at: int) -> int | None:
    """Bytes of the block that begins at ``at``; None where none does."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    extra = f.read(struct.unpack_from("<H", head, 10)[0])
    i = 0
    while i + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, i + 2)[0]
        if extra[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(extra):
            return struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + n
    return None


def is_block_gzip(fs: pafs.FileSystem, path: str) -> bool:
    with fs.open_input_file(path) as f:
        return _block_length(f, 0) is not None


def _first_block(f, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins; compressed bytes that only look like one don't lead on to others."""
    if start == 0:
        return 0
    f.seek(start)
    near = f.read(LONGEST + len(MAGIC))
    found = near.find(MAGIC)
    while found >= 0:
        at = start + found
        for _ in range(4):
            length = _block_length(f, at)
            if length is None or at + length > size:
                break
            at += length
            if at == size:
                break
        else:
            length = 0
        if at == size or length == 0:
            return start + found
        found = near.find(MAGIC, found + 1)
    return size


def measure(fs: pafs.FileSystem, path: str, size: int, start: int, stop: int) -> tuple[int, int, bool]:
    """Of the blocks that begin in ``[start, stop)``: where the first begins, their decompressed bytes, and whether
    these end with a line break. Blocks are stepped over, only the last one with content is decompressed."""
    with fs.open_input_file(path) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        at = first = _first_block(f, start, size)
        n_bytes, last = 0, None
        while at < stop:
            length = _block_length(f, at)
            if length is None or at + length > size:
                raise ValueError(f"{path}: no gzip block at byte {at}")
            f.seek(at + length - 4)
            n_plain = struct.unpack("<I", f.read(4))[0]
            if n_plain:
                n_bytes, last = n_bytes + n_plain, (at, length)
            at += length
        if last is None:
            return first, 0, True
        f.seek(last[0])
        return first, n_bytes, zlib.decompress(f.read(last[1]), 31).endswith(b"\n")


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(wbits=-15)
    body = packer.compress(data) + packer.flush()
    if len(body) > LONGEST - 26:
        packer = zlib.compressobj(0, wbits=-15)
        body = packer.compress(data) + packer.flush()
    return END[:16] + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The blocks of a file with these contents, the empty one at its end included."""
    held = b""
    for chunk in chunks:
        held += chunk
        while len(held) >= PLAIN_BYTES:
            yield _block(held[:PLAIN_BYTES])
            held = held[PLAIN_BYTES:]
    if held:
        yield _block(held)
    yield END


def write_lines(lines: DataFrame, folder: str) -> int:
    """Write ``value`` as lines, one ``part-<number>.gz`` for each partition with rows; the number of files.

    A file is written under a hidden name of its own attempt and renamed when whole, so a repeated task replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():05d}.gz"
        hidden = f"{root}/_{name}-{context.taskAttemptId()}"

        def texts() -> Iterator[bytes]:
            for batch in chain([first], batches):
                yield "".join(f"{v}\n" for v in batch.column(0).to_pylist()).encode()

        with fs.open_output_stream(hidden, compression=None) as out:
            for block in packed(texts()):
                out.write(block)
        fs.move(hidden, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return lines.select("value").mapInArrow(run, "name string").distinct().count()
