"""Plain text: UTF-8 without NUL, the first MiB."""

from __future__ import annotations

CAP = 1 << 20


def text(raw: bytes) -> str:
    cut = raw[:CAP]
    if b"\0" in cut:
        raise ValueError("a NUL byte: not text")
    if len(raw) > CAP:  # a character may be cut in two
        end = CAP
        while end > CAP - 4:
            try:
                return cut[:end].decode()
            except UnicodeDecodeError as e:
                if e.start < CAP - 4:
                    raise
                end = e.start
    return cut.decode()


class Sink:
    """Gathers lines up to a cap in bytes, cut between characters."""

    def __init__(self, cap: int = CAP):
        self.cap, self.parts, self.n = cap, [], 0

    @property
    def full(self) -> bool:
        return self.n >= self.cap

    def line(self, s: str) -> None:
        raw = (s + "\n").encode()
        if self.n + len(raw) > self.cap:
            raw = raw[: self.cap - self.n].decode(errors="ignore").encode()
            self.n = self.cap
        self.parts.append(raw.decode())
        self.n += len(raw)

    def text(self) -> str:
        return "".join(self.parts).strip("\n")
