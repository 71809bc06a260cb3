"""FASTA and FASTQ files as DataFrames: a Python data source over byte ranges, numbering and pairing.

Files are cut into byte ranges that are read in parallel; a reader moves on to the first record that starts in its range and
works on blocks of megabytes with NumPy. Compressed files (gz, bz2, zst, lz4) are read whole, each by one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.flat import ranges
from ..operators.scaffold import renumber

SCHEMA = "file_no int, offset bigint, name string, seq string, qual string"
_RANGE = 32 << 20
_BATCH = 10_000


_PACKED = (".gz", ".bz2", ".zst", ".lz4")


class _Unpacked:
    """A compressed file, read from its start on."""

    def __init__(self, stream) -> None:
        self.stream, self.at, self.kept = stream, 0, b""

    def seek(self, at: int) -> None:
        if at != self.at - len(self.kept):
            raise ValueError("a compressed file is read from its start")

    def read(self, n: int) -> bytes:
        out = self.kept
        while len(out) < n and (more := self.stream.read(n - len(out))):
            out += more
            self.at += len(more)
        self.kept = b""
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    return _Unpacked(fs.open_input_stream(p, compression="detect")) if path.endswith(_PACKED) else fs.open_input_file(p)


def sniff(paths: list[str]) -> str:
    """`fasta` or `fastq` by the first byte of every file; anything else, or a mixture, is an error."""
    kinds = set()
    for p in paths:
        with _open(p) as f:
            first = f.read(1)
        if first not in (b">", b"@"):
            raise ValueError(f"{p} is neither FASTA nor FASTQ")
        kinds.add("fasta" if first == b">" else "fastq")
    if len(kinds) != 1:
        raise ValueError("no files" if not kinds else "FASTA and FASTQ files are mixed")
    return kinds.pop()


def _first_line(f, start: int) -> int:
    """Offset of the first line that starts at or behind `start`."""
    if start == 0:
        return 0
    at = start - 1
    f.seek(at)
    while chunk := f.read(1 << 16):
        end = chunk.find(b"\n")
        if end >= 0:
            return at + end + 1
        at += len(chunk)
    return at


def _strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Pieces of the bytes as a string column, without a loop over them."""
    n = stop - start
    off = np.concatenate([[0], np.cumsum(n)])
    return pa.LargeStringArray.from_buffers(n.size, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[ranges(start, n)]))).cast(pa.string())


def _lines(data: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (without line breaks) of the whole lines of a block; of the last block the rest is a line, too."""
    cut = np.flatnonzero(data == 10)
    if last and data.size and (not cut.size or cut[-1] != data.size - 1):
        cut = np.append(cut, data.size)
    start = np.concatenate([[0], cut[:-1] + 1]).astype(np.int64) if cut.size else np.empty(0, np.int64)
    full = cut > start
    stop = cut - (full & (data[np.maximum(cut - 1, 0)] == 13)) if cut.size else cut
    return start, stop


def _blocks(f, at: int, size: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(offset, bytes, last) from `at` on; send back how many bytes were used, the rest comes again with the next block."""
    f.seek(at)
    rest, last = b"", False
    while not last:
        more = f.read(size)
        last = not more
        data = rest + more
        used = yield at, np.frombuffer(data, np.uint8), last
        used = used or 0
        at, rest = at + used, data[used:]


def _synced(f, start: int) -> int | None:
    """Offset of the first FASTQ record that starts at or behind `start`; None if there is none.

    `@` may also start a quality line: the third line and the two lengths decide."""
    at, size = _first_line(f, start), 1 << 14
    while True:
        f.seek(at)
        raw = f.read(size)
        whole = len(raw) < size
        data = np.frombuffer(raw, np.uint8)
        lo, hi = _lines(data, whole)
        for i in range(lo.size - 3):
            if raw[lo[i] : lo[i] + 1] == b"@" and raw[lo[i + 2] : lo[i + 2] + 1] == b"+" and hi[i + 1] - lo[i + 1] == hi[i + 3] - lo[i + 3]:
                return at + int(lo[i])
        if whole:
            return None
        size *= 4


def fastq_batches(f, start: int, stop: int, block: int = 4 << 20) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """(offsets, names, bases, qualities) of the strict four-line records whose `@` lies within [start, stop). A cut-off record is an error."""
    at = 0 if start == 0 else _synced(f, start)
    if at is None or at >= stop:
        return
    blocks = _blocks(f, at, block)
    at, data, last = next(blocks)
    while True:
        lo, hi = _lines(data, last)
        n = lo.size // 4
        own = n if not n else int(np.searchsorted(at + lo[: 4 * n : 4], stop))
        line, end = lo[: 4 * own].reshape(own, 4), hi[: 4 * own].reshape(own, 4)
        if own:
            bad = (end[:, 0] <= line[:, 0]) | (end[:, 2] <= line[:, 2]) | (end[:, 1] - line[:, 1] != end[:, 3] - line[:, 3])
            bad |= (data[line[:, 0]] != 64) | (data[np.minimum(line[:, 2], data.size - 1)] != 43)
            if bad.any():
                raise ValueError(f"cut-off or broken FASTQ record at byte {at + int(line[np.argmax(bad), 0])}")
            yield at + line[:, 0], _strings(data, line[:, 0] + 1, end[:, 0]), _strings(data, line[:, 1], end[:, 1]), _strings(data, line[:, 3], end[:, 3])
        if own < n:
            return
        if last:
            left = lo[4 * n :], hi[4 * n :]
            if (left[1] > left[0]).any() and at + int(left[0][0]) < stop:
                raise ValueError(f"cut-off or broken FASTQ record at byte {at + int(left[0][0])}")
            return
        used = int(np.flatnonzero(data == 10)[4 * n - 1]) + 1 if n else 0
        at, data, last = blocks.send(used)


def fasta_batches(f, start: int, stop: int, block: int = 4 << 20) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, None]]:
    """(offsets, names, bases, None) of the records whose `>` lies within [start, stop); lines up to the next `>` are joined."""
    at = _first_line(f, start)
    if at >= stop:
        return
    blocks = _blocks(f, at, block)
    at, data, last = next(blocks)
    while True:
        lo, hi = _lines(data, last)
        full = lo < hi
        head = np.flatnonzero(full & (data[np.minimum(lo, data.size - 1)] == 62)) if data.size else np.empty(0, np.int64)
        n = head.size if last else max(0, head.size - 1)  # the last one may go on in the next block
        own = int(np.searchsorted(at + lo[head[:n]], stop))
        if own:
            bounds = np.append(head, lo.size)
            first, behind = head[:own] + 1, bounds[1 : own + 1]
            at_line = ranges(first, behind - first)
            size = hi[at_line] - lo[at_line]
            upto = np.concatenate([[0], np.cumsum(size)])
            per = np.concatenate([[0], np.cumsum(behind - first)])
            off = upto[per]
            seq = pa.LargeStringArray.from_buffers(own, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[ranges(lo[at_line], size)])))
            yield at + lo[head[:own]], _strings(data, lo[head[:own]] + 1, hi[head[:own]]), seq.cast(pa.string()), None
        if own < n or last or (head.size and not last and n < head.size and at + int(lo[head[n]]) >= stop):
            return
        used = int(lo[head[n]]) if n < head.size else 0
        if not head.size:  # the rest of a record that began before this range
            cut = np.flatnonzero(data == 10)
            used = int(cut[-1]) + 1 if cut.size else 0
        at, data, last = blocks.send(used)
        if at >= stop and not head.size:
            return


class _Range(InputPartition):
    def __init__(self, file_no: int, path: str, start: int, stop: int) -> None:
        self.file_no, self.path, self.start, self.stop = file_no, path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.kind = options.get("kind") or sniff(self.paths)
        self.range = int(options.get("range", _RANGE))

    def partitions(self) -> list[_Range]:
        out = []
        for i, p in enumerate(self.paths):
            if p.endswith(_PACKED):  # can't be cut
                out.append(_Range(i, p, 0, 1 << 62))
                continue
            with _open(p) as f:
                n = f.size()
            out += [_Range(i, p, s, min(n, s + self.range)) for s in range(0, n, self.range)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        batches = fasta_batches if self.kind == "fasta" else fastq_batches
        with _open(part.path) as f:
            for off, name, seq, qual in batches(f, part.start, part.stop):
                for lo in range(0, off.size, _BATCH):
                    n = min(_BATCH, off.size - lo)
                    q = pa.nulls(n, pa.string()) if qual is None else qual.slice(lo, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.file_no, np.int32)), pa.array(off[lo : lo + n]), name.slice(lo, n), seq.slice(lo, n), q], ["file_no", "offset", "name", "seq", "qual"])


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def records(spark: SparkSession, paths: list[str], kind: str | None = None, range_bytes: int = _RANGE) -> DataFrame:
    """(file_no, offset, name, seq, qual) of all records; qual is null for FASTA."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("paths", "\n".join(paths)).option("kind", kind or sniff(paths)).option("range", range_bytes).load()


def reads(spark: SparkSession, paths: list[str], paired: int = 0, cut: int = 0, range_bytes: int = _RANGE) -> DataFrame:
    """(rid, pair_id, mate, seq, qual, seqlen): ids are 1-based in order of files and records.

    paired 0: single reads (no pair ids); 1: files 2i and 2i+1 hold mates in the same order, odd and even rids; 2: mates
    follow each other. `cut` > 0 shortens reads before anything else."""
    if paired not in (0, 1, 2):
        raise ValueError("paired must be 0, 1 or 2")
    if paired == 1 and len(paths) % 2:
        raise ValueError("separate pairing needs an even number of files")
    x = records(spark, paths, None, range_bytes)
    if cut:
        x = x.withColumn("seq", F.substring("seq", 1, cut)).withColumn("qual", F.substring("qual", 1, cut))
    x = renumber(x.withColumn("at", F.struct("file_no", "offset")), "at", "no").drop("at")
    if paired == 1:
        per = {r[0]: (r[1], r[2]) for r in x.groupBy("file_no").agg(F.min("no"), F.count(F.lit(1))).collect()}  # a row a file
        firsts, before = [], 0
        for i in range(0, len(paths), 2):
            (a, n), (b, m) = per.get(i, (0, 0)), per.get(i + 1, (0, 0))
            if n != m:
                raise ValueError(f"{paths[i]} and {paths[i + 1]} hold {n} and {m} reads")
            firsts += [(i, a, before, 0), (i + 1, b, before, 1)]
            before += n
        t = spark.createDataFrame(firsts, "file_no int, first bigint, before bigint, even int")
        x = x.join(F.broadcast(t), "file_no").withColumn("no", 2 * (F.col("before") + F.col("no") - F.col("first")) + 1 + F.col("even"))  # t: a row a file
    out = x.withColumn("rid", F.col("no"))
    if paired:
        out = out.withColumn("pair_id", F.floor((F.col("rid") + 1) / 2).cast("bigint")).withColumn("mate", F.when(F.col("rid") % 2 == 1, 1).otherwise(2))
    else:
        out = out.withColumn("pair_id", F.lit(None).cast("bigint")).withColumn("mate", F.lit(None).cast("int"))
    return out.select("rid", "pair_id", "mate", "seq", "qual", F.length("seq").alias("seqlen"))


def contigs(spark: SparkSession, paths: list[str], least_len: int = 0) -> DataFrame:
    """(contig_id, title, seq, len): other letters than A C G T N n . are dropped, short contigs left out, dense numbers."""
    x = records(spark, paths, "fasta").withColumn("seq", F.regexp_replace("seq", "[^ACGTNn.]", "")).where(F.length("seq") >= least_len)
    x = renumber(x.withColumn("at", F.struct("file_no", "offset")), "at", "contig_id")
    return x.select("contig_id", F.col("name").alias("title"), "seq", F.length("seq").alias("len"))


def truth(reads_named: DataFrame, name: str = "name") -> DataFrame:
    """Strand and position that simulated reads carry as the last two fields of their names."""
    parts = F.split(name, "_")
    strand = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2)))
    return reads_named.withColumn("true_strand", strand).withColumn("true_pos", F.try_element_at(parts, F.lit(-1)).try_cast("int"))


def min_lengths(recs: DataFrame) -> DataFrame:
    """Per file the shortest read and the length of its first one."""
    n = F.length("seq")
    return recs.groupBy("file_no").agg(F.min(n).alias("min_len"), F.min_by(n, F.col("offset")).alias("first_len"))
