"""Older office files: compound files that hold a workbook (BIFF8) or slides.

What is held goes with the size of a file, never with what it claims: tables of sectors stop at the sectors that there are, records are looked at in place, shared strings are found again by marks, and of
a sheet at most CELLS cells wait for their row to be written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .plain import Sink

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
LIMIT = 64 << 20
CELLS = 100_000

ANSI = "cp1252"  # of strings with one byte a character


class Compound:
    """Streams of a compound file. Chains that loop or leave the file are faults."""

    def __init__(self, raw: bytes):
        if len(raw) > LIMIT or raw[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError("not a compound file")
        self.raw = raw
        self.size = 1 << struct.unpack_from("<H", raw, 30)[0]
        self.mini_size = 1 << struct.unpack_from("<H", raw, 32)[0]
        if self.size not in (512, 4096) or self.mini_size != 64:
            raise ValueError("odd sectors")
        _, first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<8I", raw, 44)
        self.count = max(0, (len(raw) - 1) // self.size)
        fat = list(struct.unpack_from("<109I", raw, 76))
        at, seen, enough = first_difat, 0, self.count // (self.size // 4) + 1
        while at < END and seen < min(n_difat, self.count) and len(fat) < 109 + enough:
            part = struct.unpack(f"<{self.size // 4}I", self.sector(at))
            fat += part[:-1]
            at, seen = part[-1], seen + 1
        self.fat: list[int] = []
        for s in fat:
            if s < END and len(self.fat) <= self.count:
                self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(s))
        mini = self.chain(first_mini) if first_mini < END else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.entries = {}
        directory = self.chain(first_dir)
        root = None
        for k in range(0, len(directory) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, k + 64)
            start, size = struct.unpack_from("<II", directory, k + 116)
            name = directory[k : k + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(name.lower(), (start, size))
        self.mini = self.chain(root[0])[: root[1]] if root and root[0] < END else b""

    def sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        part = self.raw[at : at + self.size]
        if not part:
            raise ValueError("a chain leaves the file")
        return part.ljust(self.size, b"\0")

    def chain(self, k: int) -> bytes:
        out = []
        while k < END:
            if len(out) > self.count or k >= len(self.fat):
                raise ValueError("a chain loops or leaves the table")
            out.append(self.sector(k))
            k = self.fat[k]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        k, size = self.entries[name.lower()]
        if size >= self.cutoff:
            return self.chain(k)[:size]
        out: list[bytes] = []
        while k < END and len(out) <= len(self.mini_fat):
            if k >= len(self.mini_fat):
                raise ValueError("a chain leaves the table")
            out.append(self.mini[k * 64 : k * 64 + 64])
            k = self.mini_fat[k]
        return b"".join(out)[:size]


def records(raw: bytes) -> Iterator[tuple[int, memoryview]]:
    """Kinds and bodies of records, which are not copied."""
    at, view = 0, memoryview(raw)
    while at + 4 <= len(raw):
        kind, n = struct.unpack_from("<HH", raw, at)
        yield kind, view[at + 4 : at + 4 + n]
        at += 4 + n


class Strings:
    """Reads strings out of blocks; where one goes on in the next block, that begins with the width of its characters."""

    def __init__(self, blocks: list[memoryview]):
        self.blocks, self.block, self.at = blocks, 0, 0

    def skip(self, n: int) -> None:
        while n and (room := self.room()):
            step = min(n, room)
            self.at += step
            n -= step
        if n:
            raise ValueError("strings end too soon")

    def room(self) -> int:
        while self.block < len(self.blocks) and self.at >= len(self.blocks[self.block]):
            self.block, self.at = self.block + 1, 0
        return len(self.blocks[self.block]) - self.at if self.block < len(self.blocks) else 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and (room := self.room()):
            part = bytes(self.blocks[self.block][self.at : self.at + min(n, room)])
            self.at += len(part)
            n -= len(part)
            out = out + part if out else part
        if n:
            raise ValueError("strings end too soon")
        return out

    def string(self, wanted: bool = True) -> str:
        """The next string; empty where it is only passed over."""
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, []
        while n:
            before = self.block
            room = self.room()
            if not room:
                raise ValueError("strings end too soon")
            if self.block != before:
                wide = self.take(1)[0] & 1
                room = self.room()
            k = min(n, max(1, room // (1 + wide)))
            if wanted:
                out.append(self.take(k * (1 + wide)).decode("utf-16-le" if wide else ANSI, "replace"))
            else:
                self.skip(k * (1 + wide))
            n -= k
        self.skip(4 * runs + more)
        return "".join(out)


def rk(n: int) -> float:
    """A packed number: an integer or the top of a double, perhaps times 100."""
    value = (n if n < 1 << 31 else n - (1 << 32)) >> 2 if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return value / 100 if n & 1 else value


def shown(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


class Shared:
    """The shared strings of a workbook: every MARK-th one's place is kept, and the others are found from there."""

    MARK = 64

    def __init__(self, blocks: list[memoryview], most: int):
        self.reader = Strings(blocks)
        self.marks: list[tuple[int, int]] = []
        self.n = 0
        try:
            while self.n < most and self.reader.room():
                if self.within_block(most):
                    continue
                if self.n % self.MARK == 0:
                    self.marks.append((self.reader.block, self.reader.at))
                self.reader.string(wanted=False)
                self.n += 1
        except (struct.error, ValueError) as e:
            raise ValueError("strings end too soon") from e
        self.last: tuple[int, list[str]] = (-1, [])

    def within_block(self, most: int) -> int:
        """Passes over strings without extras that end in their block; how many."""
        number, block, at, n = self.reader.block, self.reader.blocks[self.reader.block], self.reader.at, self.n
        size = len(block)
        while n < most and at + 3 <= size:
            flags = block[at + 2]
            to = at + 3 + ((block[at] | block[at + 1] << 8) << flags) if flags < 2 else size + 1
            if to > size:
                break
            if n % self.MARK == 0:
                self.marks.append((number, at))
            at, n = to, n + 1
        self.reader.at, done, self.n = at, n - self.n, n
        return done

    def get(self, k: int) -> str:
        if k >= self.n:
            return ""
        if self.last[0] != k // self.MARK:
            self.reader.block, self.reader.at = self.marks[k // self.MARK]
            some = min(self.MARK, self.n - k // self.MARK * self.MARK)
            self.last = k // self.MARK, [self.reader.string() for _ in range(some)]
        return self.last[1][k % self.MARK]


class Sheet:
    """Writes a sheet's cells as lines, a row a line in order. Rows that come late, after CELLS cells of others, are lines of their own."""

    def __init__(self, sink: Sink, title: str):
        self.sink, self.title, self.cells, self.named = sink, title, {}, False

    def put(self, row: int, col: int, value: str) -> None:
        self.cells[row, col] = value
        if len(self.cells) >= CELLS:
            self.write(CELLS // 2)

    def write(self, cells: int | None = None) -> None:
        """Writes the rows of the first so many cells, or all."""
        order = sorted(self.cells)
        if cells is not None and cells < len(order):
            edge = order[cells][0]
            cut = next((k for k in range(cells, -1, -1) if order[k][0] != edge), -1) + 1
            order = order[: cut or len(order)]
        if order and not self.named:
            self.sink.line(f"Sheet: {self.title}")
            self.named = True
        row, line = None, []
        for place in order:
            if place[0] != row and line:
                self.sink.line("\t".join(line))
                line = []
            row = place[0]
            if (value := self.cells.pop(place)).strip():
                line.append(value)
            if self.sink.full:
                return
        if line:
            self.sink.line("\t".join(line))


def chars(body: memoryview, at: int, n: int, flags: int) -> str:
    return bytes(body[at : at + n * (1 + (flags & 1))]).decode("utf-16-le" if flags & 1 else ANSI, "replace")


def xls(raw: bytes) -> str:
    """Sheets with their names; a row a line, its cells between tabs."""
    file = Compound(raw)
    book = file.stream("Workbook") or file.stream("Book")
    if book is None:
        raise ValueError("no workbook")
    sink, names, n_sheets, depth = Sink(), [], 0, 0
    strings: Shared | None = None
    sheet: Sheet | None = None
    waiting: list[memoryview] | None = None  # blocks of shared strings, until another record comes
    most = 0
    for kind, body in records(book):
        if waiting is not None:
            if kind == 0x3C:
                waiting.append(body)
                continue
            strings, waiting = Shared(waiting, most), None
        if kind == 0x2F:
            raise ValueError("protected by a password")
        if kind == 0x809:
            depth += 1
            if depth == 1 and len(body) >= 4 and struct.unpack_from("<H", body, 2)[0] == 0x10:
                if sheet:
                    sheet.write()
                sheet = Sheet(sink, names[n_sheets] if n_sheets < len(names) else str(n_sheets + 1))
                n_sheets += 1
        elif kind == 0x0A:
            depth = max(0, depth - 1)
        elif kind == 0x85 and len(body) > 8:
            names.append(chars(body, 8, body[6], body[7]))
        elif kind == 0xFC and len(body) >= 8:
            waiting, most = [body[8:]], min(struct.unpack_from("<I", body, 4)[0], len(raw))
        elif sheet and len(body) >= 6:
            row, col = struct.unpack_from("<HH", body)
            if kind == 0xFD and len(body) >= 10:
                sheet.put(row, col, strings.get(struct.unpack_from("<I", body, 6)[0]) if strings else "")
            elif kind == 0x204 and len(body) >= 9:
                sheet.put(row, col, chars(body, 9, *struct.unpack_from("<HB", body, 6)))
            elif kind == 0x27E and len(body) >= 10:
                sheet.put(row, col, shown(rk(struct.unpack_from("<I", body, 6)[0])))
            elif kind == 0x203 and len(body) >= 14:
                sheet.put(row, col, shown(struct.unpack_from("<d", body, 6)[0]))
            elif kind == 0xBD:
                for i in range((len(body) - 6) // 6):
                    sheet.put(row, col + i, shown(rk(struct.unpack_from("<I", body, 6 + 6 * i)[0])))
            if sink.full:
                return sink.text()
    if sheet:
        sheet.write()
    return sink.text()


def ppt(raw: bytes) -> str:
    """Texts of slides, in the order of the file."""
    stream = Compound(raw).stream("PowerPoint Document")
    if stream is None:
        raise ValueError("no slides")
    sink = Sink()

    def walk(at: int, end: int, depth: int) -> None:
        while at + 8 <= end and not sink.full:
            flags, kind, n = struct.unpack_from("<HHI", stream, at)
            body, stop = at + 8, min(at + 8 + n, end)
            if flags & 0xF == 0xF and depth < 64:
                walk(body, stop, depth + 1)
            elif kind in (0x0FA0, 0x0FBA):
                sink.line(stream[body:stop].decode("utf-16-le", "replace").replace("\r", "\n"))
            elif kind == 0x0FA8:
                sink.line(stream[body:stop].decode(ANSI, "replace").replace("\r", "\n"))
            at = body + n

    walk(0, len(stream), 0)
    return sink.text()
