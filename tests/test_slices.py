"""Sliced BED files against a full scan."""

import random

import pytest

from strandlake.sources import slices


@pytest.mark.parametrize("order", ["sorted", "grouped"])
def test_slices_equal_a_full_scan(tmp_path, order):
    rnd = random.Random(7)
    contigs = [f"c{i}" for i in range(12)] + ["big#1#x"]
    if order == "sorted":
        contigs.sort()
    else:
        rnd.shuffle(contigs)
    rows = []
    for c in contigs:
        at = 0
        for _ in range(rnd.choice([3, 400, 9000])):
            at += rnd.randint(0, 90)
            rows.append([c, str(at), str(at + rnd.randint(1, 300)), f"n{len(rows)}", "0", "+"])
    path = str(tmp_path / "t.bed")
    with open(path, "w") as f:
        f.write("track name=x\n" + "".join("\t".join(r) + "\n" for r in rows))
    for _ in range(60):
        c, a = rnd.choice([*contigs, "none"]), rnd.randint(0, 400_000)
        b = a + rnd.choice([1, 50, 5000, 10**6])
        want = [r for r in rows if r[0] == c and int(r[1]) < b and int(r[2]) > a]
        assert slices.slice_bed(path, c, a, b, back=20_000, whole=0) == want == slices.slice_bed(path, c, a, b)


def test_few_bytes_are_read(tmp_path, monkeypatch):
    path = str(tmp_path / "t.bed")
    with open(path, "w") as f:
        for c in range(20):
            for i in range(20_000):
                f.write(f"c{c:02d}\t{i * 10}\t{i * 10 + 10}\tx\n")
    made = []
    own = slices.Lines.__init__
    monkeypatch.setattr(slices.Lines, "__init__", lambda self, p: (own(self, p), made.append(self))[0])
    assert len(slices.slice_bed(path, "c13", 50_000, 50_100, back=1000)) == 10
    assert made[0].read < made[0].size / 8


def test_empty_and_rebased(tmp_path):
    (tmp_path / "e.bed").write_text("")
    assert slices.slice_bed(str(tmp_path / "e.bed"), "c", 0, 9, whole=-1) == [] == slices.slice_bed(str(tmp_path / "e.bed"), "c", 5, 5)
    records = [["c", "5", "20", "n", "0", "+", "0", "30"], ["c", "90", "95"], ["c", "10", "12", "m"]]
    assert slices.rebased(records, 10, 50) == [["c", "0", "10", "n", "0", "+", "0", "10"], ["c", "0", "2", "m"]]
