"""A stretch of one contig out of a large BED file, by bisection over byte ranges.

The file is grouped by contig and sorted by start within one.  The contig's block is
found by bisection if contigs are in order of name, else by ever finer probes; its ends
and the first record at the stretch by bisection.  Records that begin before the
stretch and reach into it are looked for in ``back`` bytes before it, so one longer than
that many bytes of records is missed: take a larger ``back`` for such tracks.
"""

from __future__ import annotations

from .fasta import open_ranged

#: Bytes of one look into the file, of the look back, and of a file that is read whole.
WINDOW, BACK, WHOLE = 8192, 1 << 20, 1 << 20


class Lines:
    """The lines of a file by offset."""

    def __init__(self, path: str):
        self.f = open_ranged(path)
        self.f.seek(0, 2)
        self.size, self.read = self.f.tell(), 0

    def bytes(self, start: int, end: int) -> bytes:
        self.f.seek(start)
        data = self.f.read(max(0, min(end, self.size) - start))
        self.read += len(data)
        return data

    def first(self, at: int) -> tuple[int, list[str]] | None:
        """(offset, fields) of the first record that begins at or after ``at``; None if there is none."""
        begin, data, base = max(0, at - 1), b"", max(0, at - 1)
        while True:
            more = self.bytes(base + len(data), base + len(data) + WINDOW)
            data += more
            cut = 0 if begin == 0 and at == 0 else data.find(b"\n") + 1
            while cut or at == 0:
                end = data.find(b"\n", cut)
                if end < 0 and base + len(data) < self.size:
                    break
                line = data[cut : end if end >= 0 else len(data)]
                fields = line.decode("utf-8", "replace").rstrip("\r").split("\t")
                if len(fields) >= 3 and fields[1].isdigit() and fields[2].isdigit():
                    return base + cut, fields
                if end < 0:
                    return None
                cut = end + 1
            if not more:
                return None

    def bisect(self, low: int, high: int, after) -> int:
        """The offset of the first record in low..high for which ``after`` holds (it holds for all later ones), or ``high``."""
        while low < high:
            middle = (low + high) // 2
            found = self.first(middle)
            if found is None or found[0] >= high or after(found[1]):
                high = middle
            else:
                low = found[0] + 1
        found = self.first(low)
        return found[0] if found else self.size


def _block(lines: Lines, contig: str) -> tuple[int, int] | None:
    """Offsets of the contig's first record and of the first one after its last."""
    at = lines.bisect(0, lines.size, lambda r: r[0] >= contig)
    found = lines.first(at)
    if found and found[1][0] == contig:  # also right for a grouped file: the end is looked for from here
        before = lines.bisect(0, found[0], lambda r: r[0] == contig) if at else 0
        if lines.first(before)[1][0] != contig:
            before = found[0]
        hit = found[0]
    else:
        step, hit, before = lines.size // 64, None, 0
        while hit is None:
            for offset in range(0, lines.size, max(1, step)):
                record = lines.first(offset)
                if record and record[1][0] == contig:
                    hit = record[0]
                    break
                before = offset
            if step <= WINDOW // 8:
                break
            step //= 4
        if hit is None:
            return None
        before = lines.bisect(before, hit, lambda r: r[0] == contig)
    low, high, step = hit, lines.size, 1 << 16
    while low + step < lines.size:  # gallop to a record behind the block
        record = lines.first(low + step)
        if record is None or record[1][0] != contig:
            high = low + step if record is None else record[0]
            break
        low, step = record[0], step * 2
    return before, lines.bisect(low, high, lambda r: r[0] != contig)


def slice_bed(path: str, contig: str, start: int, end: int, back: int = BACK, whole: int = WHOLE) -> list[list[str]]:
    """The records (their fields) of ``contig`` that overlap start..end; a file of at most ``whole`` bytes is read through."""
    lines = Lines(path)
    with lines.f:
        if end <= start:
            return []
        if lines.size <= whole:
            low, high = 0, lines.size
        else:
            block = _block(lines, contig)
            if block is None:
                return []
            low, high = block
            at = lines.bisect(low, high, lambda r: r[0] != contig or int(r[1]) >= start)
            record = lines.first(max(low, at - back))
            low = record[0] if record else high
            high = min(high, lines.bisect(at, high, lambda r: r[0] != contig or int(r[1]) >= end))
        text = lines.bytes(low, high).decode("utf-8", "replace")
    rows = [x.rstrip("\r").split("\t") for x in text.split("\n")]
    return [r for r in rows if len(r) >= 3 and r[0] == contig and r[1].isdigit() and r[2].isdigit() and int(r[1]) < end and int(r[2]) > start]


def rebased(records: list[list[str]], start: int, end: int) -> list[list[str]]:
    """Records clipped to start..end and moved to its frame, columns 7 and 8 (the thick part) too; empty ones left out."""
    out = []
    for r in records:
        low, high = max(int(r[1]), start), min(int(r[2]), end)
        if high <= low:
            continue
        moved = [r[0], str(low - start), str(high - start), *r[3:]]
        if len(r) >= 8 and r[6].isdigit() and r[7].isdigit():
            thick = [min(max(int(x), low), high) - start for x in r[6:8]]
            moved[6:8] = [str(thick[0]), str(thick[1])]
        out.append(moved)
    return out
