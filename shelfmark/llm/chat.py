"""Chat formatting: a compiler for a small sandboxed template language.

A template is text with `{{ expression }}` and the blocks `{% for x in y %}`, `{% if %}`, `{% elif %}`,
`{% else %}`, `{% set x = expression %}` and `{% generation %}`; what stands in a generation block is under the
loss mask. Expressions know strings, numbers, true, false, none, names, members of turns and of `loop`
(index0, index, first, last), `+ ~ == != < <= > >= in not and or`, parentheses, and the filters of FILTERS. There are no
calls and no access to Python objects. Source is parsed into a syntax tree, constants are folded, and
closures are generated that yield the output piece by piece, so a conversation of any length streams.

Conversations are rows by turn. Their turns are sorted by turn, then role, then text, in one task a
conversation, of which a bounded part is held in memory at a time: the output has a row for each segment
of about `segment_chars` characters. Null texts and roles count as empty, rows with a null conversation
are one conversation, repeated rows are turns of their own. An empty table gives an empty result. Conversation identifiers are cast to long, and columns not named are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..runtime import ship

CONTROLS = ("###", "</turn>")
TEMPLATE = """{% for turn in messages %}{{ '###' }} {{ turn.role | escape_line }}
{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}</turn>
{% endfor %}"""
SEGMENT_CHARS = 1 << 20


class TemplateError(ValueError):
    pass


def escaper(controls: Iterable[str]) -> Callable[[str], str]:
    """Sets a backslash before each backslash and before each place where a control string begins, also inside another."""
    found = re.compile("|".join([r"\\", *(re.escape(c[0]) + (f"(?={re.escape(c[1:])})" if c[1:] else "") for c in controls)]))
    return lambda s: found.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escaper(CONTROLS),
    "escape_line": escaper((*CONTROLS, "\n")),
    "trim": lambda s: str(s).strip(),
    "upper": lambda s: str(s).upper(),
    "lower": lambda s: str(s).lower(),
    "capitalize": lambda s: str(s).capitalize(),
    "length": lambda s: len(s),
}
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: shown(a) + shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))
LEXEME = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>()|.=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def shown(x: Any) -> str:
    return "" if x is None else str(x)


class Expression:
    """Parses one expression to a tuple: ("const", value), ("name", n), ("member", e, n), ("filter", e, n), ("not", e), (operator, a, b)."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def parsed(self) -> tuple:
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def level(self, k: int) -> tuple:
        if k == len(LEVELS):
            return self.filtered()
        if k == 2 and self.peek() == "not":
            self.take()
            return ("not", self.level(2))
        tree = self.level(k + 1)
        while self.peek() in LEVELS[k]:
            tree = (self.take()[1], tree, self.level(k + 1))
        return tree

    def filtered(self) -> tuple:
        kind, word = self.take()
        if kind == "string":
            tree = ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "number":
            tree = ("const", float(word) if "." in word else int(word))
        elif kind == "name":
            tree = ("const", {"true": True, "false": False, "none": None}[word.lower()]) if word.lower() in ("true", "false", "none") else ("name", word)
        elif word == "(":
            tree = self.level(0)
            if self.take()[1] != ")":
                raise TemplateError("a parenthesis is not closed")
        else:
            raise TemplateError(f"unexpected {word!r}")
        while self.peek() in (".", "|"):
            sign = self.take()[1]
            kind, name = self.take()
            if kind != "name" or name.startswith("_") or sign == "|" and name not in FILTERS:
                raise TemplateError(f"{name!r} is not known here")
            tree = ("member" if sign == "." else "filter", tree, name)
        return tree


BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("out", e), ("set", name, e), ("for", name, e, body), ("if", [(e, body)]), ("generation", body)."""
    root: list[tuple] = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for m in BLOCK.finditer(source):
        body = stack[-1][2]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("out", Expression(m[1]).parsed()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "for":
                f = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not f:
                    raise TemplateError(f"a loop reads {rest!r}")
                stack.append(("for", (f[1], Expression(f[2]).parsed()), []))
            elif word == "if":
                stack.append(("if", [(Expression(rest).parsed(), first := [])], first))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                arms = stack.pop()[1]
                arms.append((Expression(rest).parsed() if word == "elif" else ("const", True), arm := []))
                stack.append(("if", arms, arm))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "set" and (f := re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)):
                body.append(("set", f[1], Expression(f[2]).parsed()))
            elif word == f"end{stack[-1][0]}" and len(stack) > 1:
                kind, said, inner = stack.pop()
                stack[-1][2].append(("for", *said, inner) if kind == "for" else ("if", said) if kind == "if" else ("generation", inner))
            else:
                raise TemplateError(f"unexpected block {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


def fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    if e[0] in ("member", "filter"):
        inner = fold_expression(e[1])
        if e[0] == "filter" and inner[0] == "const":
            return ("const", FILTERS[e[2]](inner[1]))
        return (e[0], inner, e[2])
    parts = [fold_expression(x) for x in e[1:]]
    if e[0] in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (e[0] == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        return ("const", evaluated((e[0], *parts))({}))
    return (e[0], *parts)


def fold(body: list[tuple]) -> list[tuple]:
    """Constants become text, decided branches are taken, and neighbouring text is merged."""
    out: list[tuple] = []
    for node in body:
        new: list[tuple] = [node]
        if node[0] == "out":
            e = fold_expression(node[1])
            new = [("text", shown(e[1]))] if e[0] == "const" else [("out", e)]
        elif node[0] == "set":
            new = [("set", node[1], fold_expression(node[2]))]
        elif node[0] == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        elif node[0] == "if":
            arms = []
            for e, arm in node[1]:
                e = fold_expression(e)
                if e[0] == "const" and not e[1]:
                    continue
                arms.append((e, fold(arm)))
                if e[0] == "const":
                    break
            new = [] if not arms else arms[0][1] if arms[0][0][0] == "const" else [("if", arms)]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def evaluated(e: tuple) -> Callable[[dict], Any]:
    """A closure for an expression."""
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "member":
        inner = evaluated(e[1])
        return lambda scope, n=e[2]: x.get(n) if isinstance(x := inner(scope), dict) else None
    if kind == "filter":
        inner, f = evaluated(e[1]), FILTERS[e[2]]
        return lambda scope: f(shown(x) if (x := inner(scope)) is None else x)
    if kind == "not":
        inner = evaluated(e[1])
        return lambda scope: not inner(scope)
    a, b = evaluated(e[1]), evaluated(e[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, f=OPERATORS[kind]: f(a(scope), b(scope))


Renderer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def generated(body: list[tuple]) -> Renderer:
    """A closure that yields the output of a body: pieces, and whether each is under the loss mask."""
    parts = [node_closure(x) for x in body]

    def run(scope, masked):
        for part in parts:
            yield from part(scope, masked)

    return run


def node_closure(node: tuple) -> Renderer:
    kind = node[0]
    if kind == "text":
        return lambda scope, masked, s=node[1]: iter(((s, masked),))
    if kind == "out":
        value = evaluated(node[1])
        return lambda scope, masked: iter(((shown(value(scope)), masked),))
    if kind == "generation":
        inner = generated(node[1])
        return lambda scope, masked: inner(scope, True)
    if kind == "set":
        value, name = evaluated(node[2]), node[1]

        def put(scope, masked):
            scope[name] = value(scope)
            return iter(())

        return put
    if kind == "if":
        arms = [(evaluated(e), generated(arm)) for e, arm in node[1]]

        def choose(scope, masked):
            for test, arm in arms:
                if test(scope):
                    yield from arm(scope, masked)
                    return

        return choose
    name, items, inner = node[1], evaluated(node[2]), generated(node[3])

    def loop(scope, masked):
        it = iter(items(scope) or ())
        now = next(it, loop)
        for i in itertools.count():
            if now is loop:
                return
            after = next(it, loop)
            yield from inner(scope | {name: now, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": after is loop}}, masked)
            now = after

    return loop


@functools.lru_cache(maxsize=16)
def compiled(source: str) -> Renderer:
    return generated(fold(parse(source)))


def segments(pieces: Iterable[tuple[str, bool]], limit: int = SEGMENT_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Output texts of about `limit` characters, each with the spans under the loss mask; a piece is never cut."""
    text: list[str] = []
    spans: list[tuple[int, int]] = []
    n = 0
    for piece, masked in pieces:
        if n >= limit:
            yield "".join(text), spans
            text, spans, n = [], [], 0
        if masked and piece:
            spans.append((n, n + len(piece)))
        text.append(piece)
        n += len(piece)
    yield "".join(text), spans


SPAN = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per segment of each conversation's output: conv_id, segment, formatted, loss_spans (code points in the segment)."""
    compiled(template)  # faults show on the driver
    ship(turns.sparkSession)

    def run(batches):
        render = compiled(template)
        for conv, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            messages = ({"turn": t, "role": role or "", "text": text or ""} for _, t, role, text in rows)
            for k, (text, spans) in enumerate(segments(render({"messages": messages}, False), segment_chars)):
                yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([k], pa.int64()), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "segment", "formatted", "loss_spans"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    schema = StructType([StructField("conv_id", LongType()), StructField("segment", LongType()), StructField("formatted", StringType()), StructField("loss_spans", SPAN)])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(merged(run), schema)


def merged(run: Callable, rows: int = 2000, size: int = 1 << 24) -> Callable:
    """Joins the small batches a function yields, until they have so many rows or bytes."""

    def bigger(batches):
        held: list[pa.RecordBatch] = []
        n = weight = 0
        for b in run(batches):
            held.append(b)
            n, weight = n + b.num_rows, weight + b.nbytes
            if n >= rows or weight >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n, weight = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return bigger


TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


class Reader:
    """Reads turns back from the output of TEMPLATE, segment by segment."""

    def __init__(self):
        self.rest = ""

    def __call__(self, segment: str) -> Iterator[tuple[str, str]]:
        text, at = self.rest + segment, 0
        while m := TURN.match(text, at):
            yield unescape(m[1]), unescape(m[2])
            at = m.end()
        self.rest = text[at:]


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from each conversation's segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The segments of a conversation stand together, in order."""

    def run(batches):
        for conv, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            read, said, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            turns = chars = size = 0
            for _, _, text, spans in rows:
                size += len(text)
                for role, turn in read(text):
                    turns += 1
                    said.update(f"{role}\n{turn}\n".encode())
                for s in spans:
                    own = unescape(text[s["start"] : s["end"]])
                    chars += len(own)
                    loss.update(own.encode())
            if read.rest:
                raise ValueError(f"conversation {conv} does not end with a turn")
            yield pa.record_batch([pa.array([x], t) for x, t in ((conv, pa.int64()), (turns, pa.int64()), (said.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(merged(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
