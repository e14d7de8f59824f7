"""FASTA by ranges: plain, blocked gzip and streamed files, indexes, early stop, the data source and the sketch of a manifest."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import assemblies, sketch
from strandlake.sources import fasta


def bgzf(data: bytes, size: int = 1000) -> bytes:
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.fixture(scope="module")
def contigs():
    rng = np.random.default_rng(1)
    made = {f"S#1#c{i}": "".join(rng.choice(list("ACGTacgtN"), n, p=[0.2, 0.2, 0.2, 0.2, 0.04, 0.04, 0.04, 0.04, 0.04])) for i, n in enumerate([5000, 61, 60, 1, 12_345])}
    return {**made, "empty": ""}


def text_of(contigs, width=60, end="\n"):
    return "".join(f">{n} some words{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in contigs.items())


@pytest.fixture(scope="module")
def files(contigs, tmp_path_factory, spark):
    """path by kind; those with an index have it beside them."""
    folder = tmp_path_factory.mktemp("fasta")
    data = text_of(contigs).encode()
    made = {"plain": data, "bgzf": bgzf(data), "hops": bgzf(data, 777), "gzip": gzip.compress(data), "stream": data, "dos": text_of(contigs, 50, "\r\n").encode()}
    paths = {}
    for kind, raw in made.items():
        paths[kind] = str(folder / f"{kind}.fa{'' if raw is data or kind == 'dos' else '.gz'}")
        with open(paths[kind], "wb") as f:
            f.write(raw)
    fasta.build_indexes(spark, [paths[k] for k in ("plain", "bgzf", "dos")])
    (folder / "hops.fa.gz.fai").write_text(fasta.fai_text(fasta.scan_index(paths["hops"])))
    return paths


KINDS = ["plain", "bgzf", "hops", "gzip", "stream", "dos"]


def listed(spark, files, kinds):
    return spark.createDataFrame([(k, files[k], "", "") for k in kinds], "assembly string, fasta string, fai string, gzi string")


def test_indexes_say_where_to_seek(files):
    assert fasta.resolve(files["plain"])[0] and fasta.resolve(files["stream"]) == ("", "") == fasta.resolve(files["gzip"])
    assert fasta.resolve(files["bgzf"])[1] and fasta.resolve(files["hops"])[1] == ""
    with pytest.raises(FileNotFoundError):
        fasta.resolve(files["plain"], "/none.fai")


@pytest.mark.parametrize("kind", KINDS)
def test_fetch_equals_a_slice(files, contigs, kind):
    s = contigs["S#1#c4"]
    for a, b in ((0, 10), (55, 65), (59, 61), (4000, 9001), (12_300, 99_999), (5, 5), (20_000, 20_010)):
        assert fasta.fetch(files[kind], "S#1#c4", a, b) == s[a:b]
    assert fasta.fetch(files[kind], "S#1#c0") == contigs["S#1#c0"] and fasta.fetch(files[kind], "empty") == ""
    with pytest.raises(KeyError):
        fasta.fetch(files[kind], "c4")


def test_fetch_reads_only_its_blocks(files, monkeypatch):
    read = []
    opened = fasta.open_ranged

    class Counting:
        def __init__(self, path):
            self.f = opened(path)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n=-1):
            data = self.f.read(n)
            read.append(len(data))
            return data

    fasta._starts(files["bgzf"], f"{files['bgzf']}.gzi")
    monkeypatch.setattr(fasta, "open_ranged", Counting)
    fasta.fetch(files["bgzf"], "S#1#c4", 6000, 6100)
    with opened(files["bgzf"]) as f:
        assert sum(read) < len(f.read()) / 3


@pytest.mark.parametrize("size,halo", [(100, 0), (700, 30), (1 << 20, 10)])
def test_every_base_is_owned_once(spark, files, contigs, size, halo):
    got = fasta.read_bases(fasta.base_ranges(fasta.contig_table(listed(spark, files, KINDS)), size), size, halo).collect()
    assert not [r for r in got if r["error"]]
    for kind in KINDS:
        for name, s in contigs.items():
            rows = sorted((r["pos0"], bytes(r["block"])) for r in got if r["assembly"] == kind and r["contig"] == name)
            assert "".join(b[:size].decode() for _, b in rows) == s
            assert [b.decode() for _, b in rows] == [s[p : p + size + halo] for p, _ in rows]
            assert [p for p, _ in rows] == list(range(0, len(s), size)) or (not s and rows == [(0, b"")])


def test_a_long_contig_is_many_tasks(spark, files):
    ranges = fasta.base_ranges(fasta.contig_table(listed(spark, files, ["plain"])).where("contig = 'S#1#c4'"), 700)
    assert ranges.count() == 18
    tasks = fasta.read_bases(ranges, 700).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8


def test_lengths(spark, files, contigs):
    got = {(r["assembly"], r["contig"]): r["length"] for r in fasta.contig_lengths(listed(spark, files, KINDS)).collect()}
    assert got == {(k, n): len(s) for k in KINDS for n, s in contigs.items()}


def test_streams_stop_early(files, monkeypatch):
    seen = []
    lines = fasta._lines

    def counted(path):
        for x in lines(path):
            seen.append(x)
            yield x

    monkeypatch.setattr(fasta, "_lines", counted)
    assert {n for n, _, _ in fasta.stream_blocks(files["stream"], 100, 0, {"S#1#c0"})} == {"S#1#c0"}
    assert len(seen) < 100


def test_uneven_lines_have_no_index(tmp_path):
    (tmp_path / "bad.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(ValueError):
        fasta.scan_index(str(tmp_path / "bad.fa"))


@pytest.mark.parametrize("kind", ["plain", "bgzf", "stream"])
def test_data_source(spark, files, contigs, kind):
    fasta.register(spark)
    df = spark.read.format("fasta").option("range", 1000).option("contigs", "S#1#c0,S#1#c1").load(files[kind])
    rows = sorted((r["contig"], r["pos0"], bytes(r["block"]).decode()) for r in df.collect())
    assert "".join(b for n, _, b in rows if n == "S#1#c0") == contigs["S#1#c0"] and {n for n, _, _ in rows} == {"S#1#c0", "S#1#c1"}
    one = spark.read.format("fasta").load(files[kind]).where("contig = 'S#1#c2'")
    assert [bytes(r["block"]).decode() for r in one.collect()] == [contigs["S#1#c2"]]
    assert kind == "stream" or one.rdd.getNumPartitions() == 1


def test_bins_in_one_pass_equal_the_two_readers(spark, files, contigs):
    k, width, scaled = 7, 100, 3
    whole = spark.createDataFrame([(n, s) for n, s in contigs.items() if s], "contig string, seq string")
    want = {(r["contig"], r["start"], r["hash"]) for r in sketch.sketch(whole, k, width, scaled, ["contig"]).collect()}
    stats = {(r["contig"], r["start"]): (r["end"] - r["start"], r["n_acgt"], r["n_kmers"]) for r in sketch.bin_stats(whole, width, ["contig"], k).collect()}
    for kind in ("plain", "bgzf", "stream"):
        for size in (200, 5000):
            bases = fasta.read_bases(fasta.base_ranges(fasta.contig_table(listed(spark, files, [kind])), size), size, k - 1)
            got = sketch.bin_sketch(bases, k, width, scaled, size, ["contig"]).collect()
            assert {(r["contig"], r["start"], h) for r in got for h in r["hashes"]} == want
            assert {(r["contig"], r["start"]): (r["span"], r["n_acgt"], r["n_kmers"]) for r in got} == stats
            assert all(list(r["hashes"]) == sorted(set(r["hashes"])) for r in got)


def rows_of(spark, files, tmp_path):
    (tmp_path / "alias.tsv").write_text("# ucsc\tassembly\tgenbank\nchr21\tx\tS#1#c0\nchr13_A_random\ty\tS#1#c4\nchrUn_1\tz\tS#1#c1\n")
    alias = str(tmp_path / "alias.tsv")
    rows = [("one", "s1", files["bgzf"], alias), ("broken", "s2", str(tmp_path / "none.fa"), alias), ("two", "s2", files["stream"], alias), ("lost", "s3", files["plain"], str(tmp_path / "no.tsv"))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, assembly string, sample string, fasta string, chrom_alias string")


def test_manifest_sketch_restarts_and_isolates(spark, files, tmp_path):
    manifest, folder = rows_of(spark, files, tmp_path), str(tmp_path / "out")
    options = dict(k=7, bin_size=100, scaled=3, min_sketch=1, chroms=["chr21", "13"], block_size=700)
    first = assemblies.sketch_manifest(manifest, folder, **options).collect()
    assert [(r["assembly"], r["status"], r["cached"]) for r in first] == [("one", "ok", False), ("broken", "failed", False), ("two", "ok", False), ("lost", "failed", False)]
    assert "FileNotFoundError" in first[1]["error"] and first[0]["n_contigs"] == 2 and first[0]["n_bins"] == first[2]["n_bins"] == 50 + 123
    bins = assemblies.read_bins(spark, folder)
    assert {(r["contig"], r["chrom"], r["placed"]) for r in bins.where("assembly = 'one'").collect()} == {("S#1#c0", "chr21", True), ("S#1#c4", "chr13", False)}
    one = bins.where("assembly = 'one'").orderBy("bin_idx").collect()
    assert [r["bin_idx"] for r in one] == list(range(173)) and [r["contig"] for r in one][0] == "S#1#c0"
    assert sorted(map(tuple, bins.where("assembly = 'two'").select("contig", "start", "hashes").collect()), key=str) == sorted(map(tuple, bins.where("assembly = 'one'").select("contig", "start", "hashes").collect()), key=str)
    assert assemblies.read_hashes(spark, folder).count() == first[0]["n_hashes"] * 2
    again = assemblies.sketch_manifest(manifest, folder, **options).collect()
    assert [r["cached"] for r in again] == [True, False, True, False] and again[0]["n_bins"] == first[0]["n_bins"]
    other = assemblies.sketch_manifest(manifest, folder, **{**options, "chroms": ["chr21"]}).collect()
    assert [(r["cached"], r["n_bins"]) for r in other if r["status"] == "ok"] == [(False, 50), (False, 50)]
    assert assemblies.read_bins(spark, folder).select("contig").distinct().count() == 1


def test_contigs_are_found_by_alias_only(spark, files, tmp_path):
    rows_of(spark, files, tmp_path)
    from strandlake.sources.files import read_chrom_alias

    table = fasta.contig_table(listed(spark, files, ["plain"]))
    alias = read_chrom_alias(spark, str(tmp_path / "alias.tsv"))
    assert assemblies.contig_of(table, alias, "chr21") == "S#1#c0" and assemblies.contig_of(table, None, "empty") == "empty"
    with pytest.raises(KeyError):
        assemblies.contig_of(table, None, "chr21")


def test_empty_and_incomplete_manifests(spark, tmp_path):
    empty = spark.createDataFrame([], "assembly string, fasta string")
    assert assemblies.sketch_manifest(empty, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        assemblies.sketch_manifest(empty.drop("fasta"), str(tmp_path / "none"))
