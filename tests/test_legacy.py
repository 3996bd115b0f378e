"""Older office files that claim more than they hold, within 6 times their size and 48 MiB, and 10 seconds."""

import random
import struct
import time
import tracemalloc

import pytest

from shelfmark.sources.extract import legacy
from shelfmark.sources.extract.plain import CAP

SECTOR = 4096
FREE, END, FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def rec(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def large(name, stream):
    """A compound file of sectors of 4,096 bytes with one stream, padded beyond the small ones."""
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // SECTOR)
    tables = -(-(n + 1) // (SECTOR // 4 - 1))
    entry = lambda s, kind, start, size: s.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(s) + 2, kind, 0) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, size, 0)
    directory = (entry("Root Entry", 5, END, 0) + entry(name, 2, tables + 1, len(stream))).ljust(SECTOR, b"\0")
    fat = [FAT] * tables + [END, *range(tables + 2, tables + 1 + n), END]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 4, 0xFFFE, 12, 6) + b"\0" * 6 + struct.pack("<9I", 0, tables, tables, 0, 4096, END, 0, END, 0)
    head += struct.pack("<109I", *range(tables), *[FREE] * (109 - tables))
    return head.ljust(SECTOR, b"\0") + struct.pack(f"<{len(fat)}I", *fat).ljust(tables * SECTOR, b"\xff") + directory + stream.ljust(n * SECTOR, b"\0")


def sheet_of(*records_, strings=b""):
    start = lambda kind: rec(0x809, struct.pack("<HH", 0x600, kind) + b"\0" * 12)
    return start(5) + rec(0x85, b"\0" * 6 + b"\x03\x00Tab") + strings + rec(0x0A, b"") + start(0x10) + b"".join(records_) + rec(0x0A, b"")


def storm(size):
    """Rows of a hundred numbers each, whose row numbers start again."""
    body = b"".join(struct.pack("<HI", 15, (k << 2) | 2) for k in range(100))
    rows = [rec(0xBD, struct.pack("<HH", k % 65536, 0) + body + struct.pack("<H", 99)) for k in range(size // 612)]
    return large("Workbook", sheet_of(*rows))


def many_strings(size):
    """The shortest shared strings that there can be, and one cell for each of some."""
    n = size // 4
    raw = struct.pack("<II", n, n) + b"\x01\x00\x00x" * n
    blocks = [raw[k : k + 8224] for k in range(0, len(raw), 8224)]  # cut between strings: 8224 and 8 are multiples of 4
    cells = [rec(0xFD, struct.pack("<HHHI", k, 0, 0, k * 97 % n)) for k in range(2000)]
    return large("Workbook", sheet_of(*cells, strings=rec(0xFC, blocks[0]) + b"".join(rec(0x3C, b) for b in blocks[1:])))


def looping_tables(size):
    """Tables of tables that point at themselves, as many as are claimed."""
    head = bytearray(large("Workbook", b"x" * size))
    struct.pack_into("<II", head, 68, 1, 0xFFFFFF)
    struct.pack_into(f"<{SECTOR // 4}I", head, 2 * SECTOR, *[1] * (SECTOR // 4))
    return bytes(head)


@pytest.mark.parametrize("make, size", [(storm, 4 << 20), (storm, 16 << 20), (many_strings, 4 << 20), (looping_tables, 4 << 20), (looping_tables, 16 << 20)])
def test_hostile_files_stay_within_the_budget(make, size):
    raw = make(size)
    began = time.process_time()
    try:
        text = legacy.xls(raw)
    except ValueError:
        text = ""
    took = time.process_time() - began
    tracemalloc.start()
    try:
        legacy.xls(raw)
    except ValueError:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text.encode()) <= CAP and peak <= 6 * len(raw) + (48 << 20) and took <= 10
    if make is storm:
        assert text.startswith("Sheet: Tab\n0\t1\t2\t") and len(text.encode()) > CAP - 400


def test_rows_come_in_order_and_late_ones_on_their_own(monkeypatch):
    rng = random.Random(3)
    cells = [(r, c) for r in range(40) for c in range(5)]
    rng.shuffle(cells)
    number = lambda r, c: rec(0x203, struct.pack("<HHHd", r, c, 0, r * 10 + c))
    whole = "Sheet: Tab\n" + "\n".join("\t".join(str(r * 10 + c) for c in range(5)) for r in range(40))
    assert legacy.xls(large("Workbook", sheet_of(*[number(r, c) for r, c in cells]))) == whole
    monkeypatch.setattr(legacy, "CELLS", 20)
    assert legacy.xls(large("Workbook", sheet_of(*[number(r, c) for r, c in sorted(cells)]))) == whole
    late = legacy.xls(large("Workbook", sheet_of(*[number(r, c) for r, c in cells])))
    assert sorted(late.replace("\n", "\t").split("\t")) == sorted(whole.replace("\n", "\t").split("\t"))
    wide = [(0, c) for c in range(50)]
    assert sum(x.count("\t") + 1 for x in legacy.xls(large("Workbook", sheet_of(*[number(r, c) for r, c in wide]))).split("\n")[1:]) == 50


def test_shared_strings_are_found_by_marks():
    said = [f"s{k}é" * (k % 3 + 1) for k in range(500)]
    body = struct.pack("<II", 500, 500) + b"".join(struct.pack("<HB", len(s), 1) + s.encode("utf-16-le") for s in said)
    order = [499, 0, 64, 63, 65, 128, 1, 499]
    book = sheet_of(*[rec(0xFD, struct.pack("<HHHI", k, 0, 0, i)) for k, i in enumerate([*order, 500])], strings=rec(0xFC, body))
    assert legacy.xls(large("Workbook", book)).split("\n")[1:] == [said[i] for i in order]
