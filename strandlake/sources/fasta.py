"""FASTA by byte ranges: a contig is read by as many tasks as it has ranges.

Where a file has a ``.fai`` index (and, if it is blocked gzip, its blocks can be
found), contigs are planned as a table, so joins and filters choose them before a
base is read; each range then becomes a row of bases through a seek.  A file without
an index, or in plain gzip, is streamed by one task, which stops as soon as all
contigs asked for have passed.

Every row of bases carries ``halo`` more bases than it owns, so a k-mer that
crosses the edge of a range is seen once, by the range that holds its first base.

A file that cannot be read gives a row with ``error`` instead of failing the job.
Paths may be local or shared mounts, or URIs that Arrow's file systems know.

Also a Spark data source: ``register(spark)``, then ``spark.read.format("fasta").load(path)``
with filters on ``contig``, or ``.option("contigs", "chr1,chr2")``.
"""

from __future__ import annotations

import bisect
import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bases that one row owns.
RANGE = 1 << 22
_CHUNK = 1 << 22
_INDEX = "length long, offset long, line_bases long, line_width long"
CONTIGS = f"assembly string, fasta string, gzi string, contig string, ordinal int, {_INDEX}, error string"
BASES = "assembly string, contig string, ordinal int, total long, pos0 long, block binary, error string"


# files --------------------------------------------------------------------


def open_ranged(path: str):
    """A seekable binary file: a local path (``file:`` or none), or a URI of an Arrow file system."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def readable(path: str) -> bool:
    """Whether the file is there; an answer that isn't clear raises, it is never guessed."""
    try:
        open_ranged(path).close()
    except FileNotFoundError:
        return False
    return True


def compression(path: str) -> str:
    """'' , 'gzip', or 'bgzf' (gzip in blocks that say their size)."""
    with open_ranged(path) as f:
        head = f.read(18)
    if head[:2] != b"\x1f\x8b":
        return ""
    return "bgzf" if len(head) == 18 and head[3] & 4 and head[12:16] == b"BC\x02\x00" else "gzip"


def _block_size(head: bytes) -> int:
    return struct.unpack_from("<H", head, 16)[0] + 1


def block_starts(path: str) -> list[tuple[int, int]]:
    """(compressed, uncompressed) starts of the blocks of blocked gzip, by hops from head to head."""
    starts, at, plain = [], 0, 0
    with open_ranged(path) as f:
        while True:
            f.seek(at)
            head = f.read(18)
            if len(head) < 18:
                return starts
            starts.append((at, plain))
            size = _block_size(head)
            f.seek(at + size - 4)
            plain += struct.unpack("<I", f.read(4))[0]
            at += size


@functools.lru_cache(maxsize=8)
def _starts(path: str, gzi: str) -> tuple[list[int], list[int]]:
    """Starts of blocks from the ``.gzi`` index (whose first block is implied), or else by hops."""
    if not gzi:
        found = block_starts(path)
    else:
        with open_ranged(gzi) as f:
            raw = f.read()
        (n,) = struct.unpack_from("<Q", raw)
        found = [(0, 0), *struct.iter_unpack("<QQ", raw[8 : 8 + 16 * n])]
    return [c for c, _ in found], [u for _, u in found]


def read_plain(f, path: str, gzi: str, kind: str, start: int, end: int) -> bytes:
    """Bytes start..end of the uncompressed file; of blocked gzip only the blocks that hold them are read."""
    if kind == "":
        f.seek(start)
        return f.read(max(0, end - start))
    compressed, plain = _starts(path, gzi)
    at = max(0, bisect.bisect_right(plain, start) - 1)
    here, parts, offset = plain[at], [], compressed[at]
    while here < end:
        f.seek(offset)
        head = f.read(18)
        if len(head) < 18:
            break
        size = _block_size(head)
        body = zlib.decompress(head + f.read(size - 18), 31)
        parts.append(body)
        here, offset = here + len(body), offset + size
    return b"".join(parts)[start - plain[at] : end - plain[at]]


# indexes ------------------------------------------------------------------


@dataclass
class Contig:
    name: str
    length: int
    offset: int
    line_bases: int
    line_width: int

    def byte(self, base: int) -> int:
        return self.offset + base // self.line_bases * self.line_width + base % self.line_bases if self.line_bases else self.offset


def read_fai(path: str) -> list[Contig]:
    with open_ranged(path) as f:
        rows = [x.split("\t") for x in f.read().decode().splitlines() if x.strip()]
    return [Contig(r[0], *map(int, r[1:5])) for r in rows]


def _lines(path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the uncompressed file."""
    import gzip

    raw = open_ranged(path)
    with raw, (gzip.GzipFile(fileobj=raw) if compression(path) else raw) as f:
        at, tail = 0, b""
        while data := f.read(_CHUNK):
            parts = (tail + data).split(b"\n")
            tail = parts.pop()
            for p in parts:
                yield at, p + b"\n"
                at += len(p) + 1
        if tail:
            yield at, tail


def _name(header: bytes) -> str:
    found = header[1:].split()
    return found[0].decode("utf-8", "replace") if found else ""


def scan_index(path: str) -> list[Contig]:
    """The index of a file by one pass; ValueError if a contig's lines differ in length before its last."""
    contigs: list[Contig] = []
    last = False
    for at, line in _lines(path):
        if line[:1] == b">":
            contigs.append(Contig(_name(line), 0, at + len(line), 0, 0))
            last = False
            continue
        bases = len(line.strip())
        if not contigs or not bases:
            last = last or not bases
            continue
        c = contigs[-1]
        if last or (c.line_bases and bases > c.line_bases):
            raise ValueError(f"{path}: lines of {c.name} differ in length")
        if not c.line_bases:
            c.line_bases, c.line_width = bases, len(line)
        last = bases < c.line_bases
        c.length += bases
    return contigs


def fai_text(contigs: list[Contig]) -> str:
    return "".join(f"{c.name}\t{c.length}\t{c.offset}\t{c.line_bases}\t{c.line_width}\n" for c in contigs)


def gzi_bytes(starts: list[tuple[int, int]]) -> bytes:
    inner = starts[1:-1]  # neither the first block nor the empty one at the end
    return struct.pack("<Q", len(inner)) + b"".join(struct.pack("<QQ", *x) for x in inner)


def resolve(fasta: str, fai: str = "", gzi: str = "") -> tuple[str, str]:
    """The indexes to use: (fai, gzi), both '' if the file has to be streamed.

    A named index must be there; one beside the file is taken if it is.  Blocked
    gzip without ``.gzi`` is still indexed, its blocks are found by hops.
    """
    kind = compression(fasta)
    for given in (fai, gzi):
        if given and not readable(given):
            raise FileNotFoundError(given)
    fai = fai or (f"{fasta}.fai" if readable(f"{fasta}.fai") else "")
    if not fai or kind == "gzip":
        return "", ""
    if kind == "bgzf" and not gzi and readable(f"{fasta}.gzi"):
        gzi = f"{fasta}.gzi"
    return fai, gzi if kind == "bgzf" else ""


def fetch(fasta: str, contig: str, start: int = 0, end: int | None = None, fai: str = "", gzi: str = "") -> str:
    """Bases start..end of a contig, the end clipped, case kept; KeyError if there is no such contig.

    With an index only the bytes (or blocks) that hold them are read, else the file
    up to the contig's end.
    """
    fai, gzi = resolve(fasta, fai, gzi)
    start = max(0, start)
    if not fai:
        parts, seen = [], False
        for name, pos0, block in stream_blocks(fasta, RANGE, 0, {contig}):
            seen = seen or name == contig
            stop = len(block) if end is None else max(0, end - pos0)
            parts.append(block[max(0, start - pos0) : stop])
        if not seen:
            raise KeyError(contig)
        return b"".join(parts).decode("ascii")
    found = next((c for c in read_fai(fai) if c.name == contig), None)
    if found is None:
        raise KeyError(contig)
    with open_ranged(fasta) as f:
        return _bases(f, fasta, gzi, compression(fasta), found, start, found.length if end is None else end).decode("ascii")


def _bases(f, path: str, gzi: str, kind: str, c: Contig, start: int, end: int) -> bytes:
    end = min(end, c.length)
    if end <= start:
        return b""
    raw = read_plain(f, path, gzi, kind, c.byte(start), c.byte(end - 1) + 1).translate(None, b"\r\n\t ")
    if len(raw) != end - start:
        raise ValueError(f"{path}: {c.name} holds {len(raw)} bases where its index says {end - start}")
    return raw


def stream_blocks(path: str, size: int, halo: int, wanted: set[str] | None = None) -> Iterator[tuple[str, int, bytes]]:
    """(contig, pos0, block) in file order; reading stops when all ``wanted`` contigs have passed.

    An empty contig gives one empty block, so that it is seen to be there.
    """
    left = set(wanted) if wanted is not None else None
    name, keep, buffer, pos0 = "", False, bytearray(), 0

    def rest():
        at = 0
        while keep and (at < len(buffer) or not pos0 and not at):
            yield name, pos0 + at, bytes(buffer[at : at + size + halo])
            at += size

    for _, line in _lines(path):
        if line[:1] == b">":
            yield from rest()
            if left is not None and not left:
                return
            name, pos0 = _name(line), 0
            buffer.clear()
            keep = bool(name) and (wanted is None or name in wanted)
            if left is not None:
                left.discard(name)
        elif keep:
            buffer += line.strip()
            while len(buffer) >= size + halo:
                yield name, pos0, bytes(buffer[: size + halo])
                del buffer[:size]
                pos0 += size
    if buffer or not pos0:
        yield from rest()


# tables -------------------------------------------------------------------


def _planned(fasta: str, fai: str, gzi: str) -> list[tuple]:
    """(gzi, contig, ordinal, length, offset, line_bases, line_width) of a file; contig null if it has to be streamed."""
    fai, gzi = resolve(fasta, fai, gzi)
    if not fai:
        return [("", None, 0, None, None, None, None)]
    return [(gzi, c.name, i, c.length, c.offset, c.line_bases, c.line_width) for i, c in enumerate(read_fai(fai))]


def contig_table(files: DataFrame) -> DataFrame:
    """The contigs of each row of ``files`` (assembly, fasta, fai, gzi) by its index, read in tasks.

    A file to be streamed gives one row without a contig, one that cannot be read one with ``error``.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for assembly, fasta, fai, gzi in zip(*(batch.column(c).to_pylist() for c in ("assembly", "fasta", "fai", "gzi"))):
                try:
                    rows += [(assembly, fasta, *r, None) for r in _planned(fasta, fai or "", gzi or "")]
                except Exception as error:  # told as a row: the other files go on
                    rows.append((assembly, fasta, "", None, 0, None, None, None, None, said(error)))
            kinds = [pa.string()] * 4 + [pa.int32()] + [pa.int64()] * 4 + [pa.string()]
            names = ["assembly", "fasta", "gzi", "contig", "ordinal", "length", "offset", "line_bases", "line_width", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    plain = files.select("assembly", "fasta", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("fai", "gzi")])
    return plain.repartition(F.col("fasta")).mapInArrow(run, CONTIGS)


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500].replace("\n", " ")


def base_ranges(contigs: DataFrame, size: int = RANGE) -> DataFrame:
    """The rows of ``contig_table`` with pos0, one for each range of ``size`` bases; streamed files and errors keep one."""
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return contigs.select("*", F.explode(starts).alias("pos0"))


def read_bases(ranges: DataFrame, size: int = RANGE, halo: int = 0, wanted: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """assembly, contig, ordinal, total (null if streamed), pos0, block, error: the bases of each range, at most ``partitions`` tasks at a time.

    ``wanted`` contigs stop the streams early; indexed contigs are chosen by filtering ``contig_table``.
    """
    names = None if wanted is None else frozenset(wanted)

    def rows_of(row):
        assembly, fasta, gzi, contig, ordinal, pos0, error = (row[c] for c in ("assembly", "fasta", "gzi", "contig", "ordinal", "pos0", "error"))
        if error:
            yield assembly, contig, ordinal, None, 0, None, error
            return
        try:
            if contig is None:
                order: dict = {}
                for name, at, block in stream_blocks(fasta, size, halo, names):
                    yield assembly, name, order.setdefault(name, len(order)), None, at, block, None
                return
            c = Contig(contig, row["length"], row["offset"], row["line_bases"], row["line_width"])
            with open_ranged(fasta) as f:
                block = _bases(f, fasta, gzi, compression(fasta), c, pos0, pos0 + size + halo)
            yield assembly, contig, ordinal, c.length, pos0, block, None
        except Exception as problem:  # told as a row: the other files go on
            yield assembly, contig, ordinal, None, pos0, None, said(problem)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names_ = ["assembly", "contig", "ordinal", "total", "pos0", "block", "error"]
        for batch in batches:
            for row in batch.to_pylist():
                for r in rows_of(row):  # a row a batch: a task holds one range
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, kinds)], names=names_)

    spread = partitions or ranges.sparkSession.sparkContext.defaultParallelism * 4
    return ranges.repartition(spread, "fasta", "contig", "pos0").mapInArrow(run, BASES)


def contig_lengths(files: DataFrame) -> DataFrame:
    """assembly, contig, ordinal, length of all contigs: from indexes, or by a pass over files without."""
    table = contig_table(files)
    known = table.where("contig IS NOT NULL").select("assembly", "contig", "ordinal", "length")
    passed = read_bases(base_ranges(table.where("contig IS NULL AND error IS NULL"))).where("error IS NULL")
    return known.unionByName(passed.groupBy("assembly", "contig", "ordinal").agg(F.sum(F.octet_length("block")).alias("length")))


def build_indexes(spark: SparkSession, paths: list[str]) -> None:
    """Write ``.fai`` (and ``.gzi`` for blocked gzip) beside each local file, a task a file."""

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                made = {f"{path}.fai": fai_text(scan_index(path)).encode()}
                if compression(path) == "bgzf":
                    made[f"{path}.gzi"] = gzi_bytes(block_starts(path))
                for name, data in made.items():
                    with open(f"{name}.{os.getpid()}.tmp", "wb") as f:
                        f.write(data)
                    os.replace(f.name, name)  # all of it or none
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, "path string").count()


# data source --------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    fasta: str
    gzi: str
    contig: Contig | None
    start: int

    def __post_init__(self):
        super().__init__(None)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.size, self.halo = int(options.get("range", RANGE)), int(options.get("halo", 0))
        self.fai, self.gzi = options.get("fai", ""), options.get("gzi", "")
        self.wanted = {c.strip() for c in options["contigs"].split(",")} if options.get("contigs") else None

    def pushFilters(self, filters):
        """Equality and membership of ``contig`` choose contigs before anything is read."""
        for f in filters:
            kind = type(f).__name__
            if kind in ("EqualTo", "In") and tuple(f.attribute) == ("contig",):
                asked = {f.value} if kind == "EqualTo" else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self):
        planned = []
        for path in self.paths:
            fai, gzi = resolve(path, self.fai, self.gzi)
            if not fai:
                planned.append(_Range(path, "", None, 0))
                continue
            for c in read_fai(fai):
                if self.wanted is None or c.name in self.wanted:
                    planned += [_Range(path, gzi, c, at) for at in range(0, max(c.length, 1), self.size)]
        return planned or [_Range("", "", None, 0)]

    def read(self, partition):
        if not partition.fasta:
            return
        if partition.contig is None:
            for name, pos0, block in stream_blocks(partition.fasta, self.size, self.halo, self.wanted):
                yield partition.fasta, name, None, pos0, block
            return
        with open_ranged(partition.fasta) as f:
            c = partition.contig
            yield partition.fasta, c.name, c.length, partition.start, _bases(f, partition.fasta, partition.gzi, compression(partition.fasta), c, partition.start, partition.start + self.size + self.halo)


class FastaDataSource(DataSource):
    """file, contig, total, pos0, block of a FASTA file; options: contigs, range, halo, fai, gzi."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, contig string, total long, pos0 long, block binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("fasta")`` known, with filters on the contig pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaDataSource)
