"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is cut in halves, and those again, down to leaves of at most `leaf`
characters wherever the cuts fall. All leaves are encoded together, in parallel threads. Then joins
are mended from the bottom up: the tokens around a join are encoded again in a window that grows until
both sides agree exactly.

Two rules make agreement exact.
* A place between characters where no piece of the pre-tokenizer can reach over, and where what
  follows has no say in what went before, splits any text: the encodings of both sides simply follow
  each other. Such places lie before white space that follows anything else, and where letters, digits
  and other signs meet (but after an apostrophe, as in contractions). A window that begins and ends at
  such places, or at the ends of the text, replaces exactly the tokens in it.
* Text with no such place near the join is one long run of one kind of character. Inside a run, a
  sequence of tokens is the encoding if and only if each two neighbours are the encoding of their own
  bytes. A window of a run whose first token is the left side's token there, and whose last token is
  the right side's, leaves only neighbours that were checked already.

Tokens in special form (such as an end-of-text mark) are told apart before, as the tokenizers library
does. Identifiers are cast to long, rows that repeat are encoded each on its own, and columns not named are not read. Null texts count as empty and give no ids; one task holds one batch of texts at a time.
"""

from __future__ import annotations

import functools
import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

LEAF = 8192
#: The pattern of byte-level BPE that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})")
RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by the public rule: printable bytes stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """A plain character of the encoder's kind for each one that `regex` puts in another: its tables of letters and digits are of another Unicode version than those of the encoder, which are the tokenizers library's."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: dict[int, str] = {}
    for plain, kind in {"a": r"\p{L}", "0": r"\p{N}", " ": r"\s"}.items():
        coder = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs, ours = set(bytes(coder.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
        out |= {ord(c): plain for c in theirs - ours}
        out |= {ord(c): "!" for c in ours - theirs if ord(c) not in out}
    return out


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = 2):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): i for k, i in said["model"]["vocab"].items() if k not in self.special}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (1 + max(*ranks.values(), *self.special.values()))
        for k, i in ranks.items():
            self.token[i] = k
        for k, i in self.special.items():
            self.token[i] = k.encode()
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf, self.threads, self.plain = leaf, threads, stand_ins()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; leaves of all texts are encoded together."""
        trees, leaves = [], []
        for text in texts:
            parts = self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]
            trees.append([self.special[p] if p in self.special else self._tree(p, leaves) for p in parts if p])
        ids = self._leaves(leaves)
        out = []
        for tree in trees:
            if len(tree) == 1 and isinstance(tree[0], tuple) and tree[0][0] == "leaf":
                out.append(ids[tree[0][1]])
                continue
            got: list[int] = []
            for node in tree:
                if isinstance(node, int):
                    got.append(node)
                else:
                    got += self._joined(node, leaves, ids)[0]
            out.append(got)
        return out

    def _leaves(self, leaves: list[str]) -> list[list[int]]:
        one = self.core.encode_ordinary
        if self.threads < 2 or len(leaves) < 8 * self.threads:
            return [one(x) for x in leaves]
        out: list[list[int]] = [[]] * len(leaves)
        with ThreadPoolExecutor(self.threads) as pool:  # the encoder runs outside Python's lock
            for k, part in enumerate(pool.map(lambda k: [one(x) for x in leaves[k :: self.threads]], range(self.threads))):
                out[k :: self.threads] = part
        return out

    def _tree(self, text: str, leaves: list[str]) -> tuple:
        if len(text) <= self.leaf:
            leaves.append(text)
            return ("leaf", len(leaves) - 1)
        half = len(text) // 2
        return ("join", self._tree(text[:half], leaves), self._tree(text[half:], leaves))

    def _joined(self, node: tuple, leaves: list[str], ids: list[list[int]]) -> tuple[list[int], str]:
        if node[0] == "leaf":
            return ids[node[1]], leaves[node[1]]
        left, a = self._joined(node[1], leaves, ids)
        right, b = self._joined(node[2], leaves, ids)
        return self.join(left, a, right, b), a + b

    def join(self, left: list[int], a: str, right: list[int], b: str) -> list[int]:
        """The ids of a + b, from the ids of a and of b."""
        reach = 16
        while True:
            a_part, b_part = a[-reach:], b[:reach]
            found = self._at_splits(left, a_part, right, b_part, len(a_part) == len(a), len(b_part) == len(b))
            if found is None and reach >= 128:
                found = self._in_run(left, a_part, right, b_part)
            if found is not None:
                return found
            reach *= 2

    def _at_splits(self, left, a, right, b, all_a, all_b):
        """A window from the last split on the left to the first on the right; the whole of a side has its end as one."""
        text, cut = a + b, len(a)
        starts = [m.start() for m in SPLIT.finditer(text.translate(self.plain))]
        lo = max((p for p in starts if p < cut), default=0 if all_a else None)
        hi = min((p for p in starts if p > cut), default=len(text) if all_b else None)
        if cut in starts:
            return left + right
        if lo is None or hi is None:
            return None
        i, j = self._back(left, len(a[lo:].encode())), self._on(right, len(b[: hi - cut].encode()))
        if i is None or j is None:  # a side alone was cut elsewhere there: look further
            return None
        return left[:i] + self.core.encode_ordinary(text[lo:hi]) + right[j:]

    def _in_run(self, left, a, right, b):
        """A window inside a run of one kind of character, agreed on by its first and last token."""
        text, cut = a + b, len(a)
        m = RUN.fullmatch(text.translate(self.plain))
        if m is None:
            return None
        size, i = 0, len(left)
        raw_a, raw_b = a.encode(), b.encode()
        while i > 1 and size + len(self.token[left[i - 1]]) < len(raw_a):
            i -= 1
            size += len(self.token[left[i]])
        while i < len(left) and size and raw_a[len(raw_a) - size] & 0xC0 == 0x80:
            size -= len(self.token[left[i]])
            i += 1
        on, j = 0, 0
        while j < len(right) and on + len(self.token[right[j]]) < len(raw_b) - 8:
            on += len(self.token[right[j]])
            j += 1
        while j and raw_b[on] & 0xC0 == 0x80:
            j -= 1
            on -= len(self.token[right[j]])
        if i >= len(left) - 1 or j <= 1:
            return None
        window = self.core.encode_ordinary((raw_a[len(raw_a) - size :] + raw_b[:on]).decode())
        if window[0] == left[i] and window[-1] == right[j - 1]:
            return left[:i] + window + right[j:]
        return None

    def _back(self, ids: list[int], size: int) -> int | None:
        """From which token on the last `size` bytes begin."""
        i = len(ids)
        while size > 0 and i:
            i -= 1
            size -= len(self.token[ids[i]])
        return i if size == 0 else None

    def _on(self, ids: list[int], size: int) -> int | None:
        i = 0
        while size > 0 and i < len(ids):
            size -= len(self.token[ids[i]])
            i += 1
        return i if size == 0 else None

    def decode(self, ids: list[int]) -> str:
        try:
            raw = self.core.decode_bytes(ids)
        except KeyError:  # special tokens
            raw = b"".join(map(self.token.__getitem__, ids))
        return raw.decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str, leaf: int = LEAF, threads: int = 2) -> Bpe:
    return Bpe(path, leaf, threads)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array of int) of each row's text. vocabulary: a file that every executor can read."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = loaded(path, leaf)
        for batch in batches:
            ids = bpe.encode_batch(texts_of(batch, "text"))
            yield pa.record_batch([batch.column(0), pa.array([np.asarray(x, dtype=np.int32) for x in ids], type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of each row's ids; null ids count as none."""
    ship(rows.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Encodes each text and decodes its ids again, and returns the digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = loaded(path, leaf)
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode_batch(texts_of(batch, "text")):
                n.append(len(ids))
                a.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
