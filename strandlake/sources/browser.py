"""Browser tracks: BED9 lines of all assemblies in one blocked-gzip file, the same bytes whatever the partitions.

The track is cut by contig and tile of positions, so what a piece holds does not
depend on how Spark deals rows.  Each piece is compressed in a task into blocks that
stand by themselves; the blocks, in order of contig and tile, are the file.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block before compression, and bases of a piece.
BLOCK, TILE = 65_280, 1 << 24
#: Fixed: the empty block that ends a blocked-gzip file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def blocks(data: bytes) -> bytes:
    """``data`` as blocked gzip: members of at most 64 KB that say their size, without names or times."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def track_line(run: str, label: str) -> str:
    clean = lambda text: text.replace('"', "'").replace("\n", " ")
    return f'track name="{clean(run)} {clean(label)}" description="cluster assignments ({clean(run)}, {clean(label)})" itemRgb="On" visibility=1\n'


def bed_line():
    return F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("score").cast("string"), "strand", F.col("thick_start").cast("string"), F.col("thick_end").cast("string"), "rgb")


def pieces(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """contig, tile, data: the compressed lines of each piece, by start, end, assembly and name."""
    lines = rows.select("contig", F.floor(F.col("start") / tile).alias("tile"), "start", "end", "assembly", "name", bed_line().alias("value"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartition(partitions, "contig", "tile").sortWithinPartitions("contig", "tile", "start", "end", "assembly", "name", "value").select("contig", "tile", "value")

    def run(batches):
        import pyarrow as pa

        now, held = None, []

        def done(made):
            if now is not None:
                made.append((*now, blocks("".join(held).encode())))

        def table(made):
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["contig", "tile", "data"])

        for batch in batches:
            made: list = []
            for contig, at, value in zip(*(batch.column(c).to_pylist() for c in ("contig", "tile", "value"))):
                if (contig, at) != now:
                    done(made)
                    now, held = (contig, at), []
                held.append(value + "\n")
            yield table(made)
        made = []
        done(made)
        yield table(made)

    return dealt.mapInArrow(run, "contig string, tile long, data binary")


def write_track(rows: DataFrame, path: str, run: str, label: str = "all assemblies", tile: int = TILE) -> None:
    """One file at ``path``: a track line, then all rows by contig and start; the driver passes on a partition at a time."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(hidden, True)
    try:
        stream.write(bytearray(blocks(track_line(run, label).encode())))
        for r in pieces(rows, tile).orderBy("contig", "tile").select("data").toLocalIterator():
            stream.write(bytearray(r["data"]))
        stream.write(bytearray(END))
    finally:
        stream.close()
    system.delete(target, False)
    system.rename(hidden, target)


def write_beds(rows: DataFrame, path: str, run: str = "", compression: str = "none") -> None:
    """BED9 lines, one folder for each assembly: its track line, then its rows in order of contig and start."""
    lines = rows.select("assembly", F.lit(1).alias("n"), "contig", "start", "name", bed_line().alias("value"))
    head = rows.select("assembly").distinct()
    before, after = track_line(run, "\0").rstrip("\n").split("\0")[0], track_line(run, "\0").rstrip("\n").split("\0")
    title = F.concat(F.lit(before), F.col("assembly"), F.lit(after[1]), F.col("assembly"), F.lit(after[2]))
    heads = head.select("assembly", F.lit(0).alias("n"), F.lit("").alias("contig"), F.lit(0).cast("long").alias("start"), F.lit("").alias("name"), title.alias("value"))
    ordered = heads.unionByName(lines).repartition("assembly").sortWithinPartitions("assembly", "n", "contig", "start", "name")
    ordered.select("assembly", "value").write.mode("overwrite").option("compression", compression).partitionBy("assembly").text(path)
