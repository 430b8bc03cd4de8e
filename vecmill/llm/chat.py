"""Chat formatting by a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that yield text piece by piece, each with a flag that
says whether it stands within a generation block.  Templates reach only the
values given to them: names, keys of records and the filters listed here; they
can't call, import or look into Python objects.

    {{ expression }}   {# comment #}   {% set name = expression %}
    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidy

Piece = tuple[str, bool]

#: Texts are escaped so that they hold none of the characters with which control strings begin.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}


def escape(text: str) -> str:
    """A text without ``<`` and ``[``; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def escape_line(text: str) -> str:
    """``escape``, without line breaks."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m.group(1)], text)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}

#: Turn, role, line break, text, end of turn; the assistant's texts are what a model learns to generate.
TURN, END = "<|turn|>", "<|end|>\n"
TEMPLATE = """{% for m in messages %}<|turn|>{{ m.role | escape_line }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>
{% endfor %}"""


class TemplateError(ValueError):
    """A template that does not parse, or reaches for what it was not given."""


#: What stands in an expression up to its end: strings, which may hold the signs that end it, and all else.
_INSIDE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?"""
_TAGS = re.compile(rf"(\{{\{{{_INSIDE}\}}\}}|\{{%{_INSIDE}%\}}|\{{#.*?#\}})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.()\[\]]))")
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}


class _Expression:
    """Recursive descent; nodes are ("const", v), ("name", n), ("key", e, e), ("filter", f, e), ("not", e) and (operator, e, e)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(next((kind, v) for kind, v in zip(("text", "number", "word", "sign"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.at = 0

    def parse(self):
        node = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _left(self, below: Callable, *signs: str):
        node = below()
        while sign := self._next(*signs):
            node = (sign, node, below())
        return node

    def _or(self):
        return self._left(self._and, "or")

    def _and(self):
        return self._left(self._not, "and")

    def _not(self):
        return ("not", self._not()) if self._next("not") else self._left(self._sum, "==", "!=", "<", "<=", ">", ">=", "in")

    def _sum(self):
        return self._left(self._filtered, "+", "-")

    def _filtered(self):
        node = self._atom()
        while True:
            if self._next("|"):
                name = self._word()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
            elif self._next("."):
                node = ("key", node, ("const", self._word()))
            elif self._next("["):
                node = ("key", node, self._or())
                if not self._next("]"):
                    raise TemplateError("] is missing")
            else:
                return node

    def _word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def _atom(self):
        if self._next("("):
            node = self._or()
            if not self._next(")"):
                raise TemplateError(") is missing")
            return node
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), v[1:-1]))
        if kind == "number":
            return ("const", int(v))
        if kind == "word" and v in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[v])
        if kind == "word" and v not in _WORDS:
            return ("name", v)
        raise TemplateError(f"unexpected {v!r}")


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b,
}


def _applied(f: Callable, *values):
    """``f(*values)``; values of kinds that it does not take are an error of the template."""
    try:
        return f(*values)
    except (TypeError, AttributeError) as wrong:
        raise TemplateError(str(wrong)) from wrong


def fold(node: tuple) -> tuple:
    """The expression with all parts computed that have only constants."""
    kind, *parts = node
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(parts[1])
        return ("const", _applied(FILTERS[parts[0]], inner[1])) if inner[0] == "const" else ("filter", parts[0], inner)
    parts = [fold(p) for p in parts]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind in ("not", *_OPERATORS) and all(p[0] == "const" for p in parts):
        return ("const", not parts[0][1] if kind == "not" else _applied(_OPERATORS[kind], parts[0][1], parts[1][1]))
    return (kind, *parts)


def _value(node: tuple) -> Callable[[dict], object]:
    """A closure that computes an expression from the names in scope."""
    kind, *parts = node
    if kind == "const":
        return lambda scope, v=parts[0]: v
    if kind == "name":

        def name(scope: dict, n: str = parts[0]):
            if n not in scope:
                raise TemplateError(f"no value {n!r}")
            return scope[n]

        return name
    if kind == "filter":
        inner, f = _value(parts[1]), FILTERS[parts[0]]
        return lambda scope: _applied(f, inner(scope))
    left = _value(parts[0])
    if kind == "not":
        return lambda scope: not left(scope)
    right = _value(parts[1])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    if kind == "key":

        def key(scope: dict):
            of, k = left(scope), right(scope)
            if type(of) is not dict or k not in of:
                raise TemplateError(f"no key {k!r}")
            return of[k]

        return key
    operate = _OPERATORS[kind]
    return lambda scope: _applied(operate, left(scope), right(scope))


class Template:
    """A compiled template; ``render(**values)`` yields (text, generated) pieces."""

    def __init__(self, source: str):
        self._parts = [p for p in _TAGS.split(source) if p]
        self._at = 0
        self.tree = self._body(())
        if self._at < len(self._parts):
            raise TemplateError(f"unexpected {self._parts[self._at]}")
        self._run = _block(self.tree)

    def render(self, **values) -> Iterator[Piece]:
        return self._run(values, False)

    def _tag(self) -> tuple[str, str] | None:
        part = self._parts[self._at]
        word, _, rest = part[2:-2].strip().partition(" ") if part.startswith("{%") else ("", "", "")
        return (word, rest.strip()) if word else None

    def _body(self, ends: tuple[str, ...]) -> list[tuple]:
        """Nodes up to one of the tags in ``ends``: adjacent constant texts are one node, dead branches are left out."""
        nodes: list[tuple] = []

        def text(t: str) -> None:
            if nodes and nodes[-1][0] == "text":
                t = nodes.pop()[1] + t
            nodes.append(("text", t))

        while self._at < len(self._parts):
            part, tag = self._parts[self._at], self._tag()
            if tag is not None and tag[0] in ends:
                return nodes
            self._at += 1
            if tag is None and not part.startswith(("{{", "{#")):
                if "{{" in part or "{%" in part:
                    raise TemplateError(f"a tag is never closed: {part!r}")
                text(part)
            elif tag is None and part.startswith("{{"):
                node = fold(_Expression(part[2:-2]).parse())
                text(_shown(node[1])) if node[0] == "const" else nodes.append(("show", node))
            elif tag is not None:
                for node in self._statement(*tag):
                    text(node[1]) if node[0] == "text" else nodes.append(node)
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return nodes

    def _statement(self, word: str, rest: str) -> list[tuple]:
        if word == "set":
            name, sign, expression = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"set {rest}")
            return [("set", name.strip(), fold(_Expression(expression).parse()))]
        if word == "generation":
            body = self._body(("endgeneration",))
            self._at += 1
            return [("generation", body)]
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            body = self._body(("endfor",))
            self._at += 1
            return [("for", m.group(1), fold(_Expression(m.group(2)).parse()), body)]
        if word == "if":
            branches, condition, ends = [], fold(_Expression(rest).parse()), ("elif", "else", "endif")
            while True:
                branches.append((condition, self._body(ends)))
                tag = self._tag()
                self._at += 1
                if tag[0] == "endif":
                    break
                if tag[0] == "elif":
                    condition = fold(_Expression(tag[1]).parse())
                else:
                    condition, ends = ("const", True), ("endif",)
            live = []
            for condition, body in branches:
                if condition[0] != "const":
                    live.append((condition, body))
                elif condition[1]:
                    live.append((condition, body))
                    break
            if live and live[0][0][0] == "const":
                return live[0][1]
            return [("if", live)] if live else []
        raise TemplateError(f"no statement {word!r}")


def _shown(value: object) -> str:
    return "" if value is None else str(value)


def _block(nodes: list[tuple]) -> Callable[[dict, bool], Iterator[Piece]]:
    """A closure that yields the pieces of some nodes."""
    steps = [_node(n) for n in nodes]

    def run(scope: dict, generated: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, generated)

    return run


def _node(node: tuple) -> Callable[[dict, bool], Iterable[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda scope, generated, t=node[1]: ((t, generated),)
    if kind == "show":
        value = _value(node[1])
        return lambda scope, generated: ((_shown(value(scope)), generated),)
    if kind == "set":
        value = _value(node[2])

        def put(scope: dict, generated: bool) -> tuple:
            scope[node[1]] = value(scope)
            return ()

        return put
    if kind == "generation":
        body = _block(node[1])
        return lambda scope, generated: body(scope, True)
    if kind == "for":
        value, body = _value(node[2]), _block(node[3])

        def loop(scope: dict, generated: bool) -> Iterator[Piece]:
            for item in value(scope):
                yield from body({**scope, node[1]: item}, generated)

        return loop
    branches = [(_value(c), _block(b)) for c, b in node[1]]

    def choose(scope: dict, generated: bool) -> Iterable[Piece]:
        return next((body(scope, generated) for test, body in branches if test(scope)), ())

    return choose


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of each turn, read from the formatted output as it comes."""
    shown, masked = "", ""
    for text, generated in pieces:
        shown += text
        if generated:
            masked += text
        while (end := shown.find(END)) >= 0:
            if not shown.startswith(TURN):
                raise ValueError("the output has no turn here")
            role, _, body = shown[len(TURN) : end].partition("\n")
            yield unescape(role), unescape(body), unescape(masked)
            shown, masked = shown[end + len(END) :], ""
    if shown:
        raise ValueError("the output ends within a turn")


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    def rows():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*columns, strict=True):
                yield conv, {"role": role or "", "text": text or ""}

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, (message for _, message in group)


def _ordered(conversations: DataFrame) -> DataFrame:
    kept = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Turns stream through a task in order, so a conversation of any length takes the memory of one turn.
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, formatted, loss_spans`` (array of start and end, in code points): one row per conversation.

    conversations: ``conv_id, turn, role, text``; other columns are not read.  Rows are ordered by
    turn, ties by role and text; repeated rows are turns each.  Null roles and texts are empty; rows
    without conv_id form one conversation; an empty table gives no rows.
    """

    def run(batches):
        compiled = Template(template)
        for conv, messages in _conversations(batches):
            texts, spans, at = [], [], 0
            for text, generated in compiled.render(messages=messages):
                if generated and text:
                    if spans and spans[-1]["stop"] == at:
                        spans[-1]["stop"] += len(text)
                    else:
                        spans.append({"start": at, "stop": at + len(text)})
                texts.append(text)
                at += len(text)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(texts)], pa.string()), pa.array([spans], kind)], ["conv_id", "formatted", "loss_spans"])

    return _ordered(conversations).mapInArrow(tidy(run), "conv_id long, formatted string, loss_spans array<struct<start:long, stop:long>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Digests of what is read back from the formatted conversations, without keeping them (see DIGEST).

    Order, nulls and repeats are as in ``format_conversations``.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        compiled = Template(template)
        out = []
        for conv, messages in _conversations(batches):
            turns, loss, n, loss_chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, [0]

            def counted(pieces, size=size):
                for text, generated in pieces:
                    size[0] += len(text)
                    yield text, generated

            for role, text, masked in read_turns(counted(compiled.render(messages=messages))):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, loss_chars = n + 1, loss_chars + len(masked)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size[0]))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _ordered(conversations).mapInArrow(tidy(run), DIGEST)


def digest_sql(extra: str) -> str:
    """DuckDB SQL for ``digest_conversations`` over the table and extra rows (a VALUES list)."""
    esc = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '<', '\\l'), '[', '\\b')"
    return f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT conv_id, turn, role, text, role, text FROM (VALUES {extra}) AS e(conv_id, turn, role, text)),
s AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length(replace({esc("role")}, chr(10), '\\n')) + length({esc("text")}) + {len(TURN) + 1 + len(END)} AS shown FROM a)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""
