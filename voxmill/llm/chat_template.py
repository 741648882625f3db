"""Chat formatting: a small template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set x = e %}``
and ``{% generation %} ... {% endgeneration %}``, which marks what the loss is taken on. Expressions have strings, whole
numbers, names, ``a.b`` and ``a['b']`` on dicts, ``+ == != and or not``, parentheses and filters (``| trim``). The language is
sandboxed by what it lacks: no calls, no attributes of Python objects, no names but the conversation's own.

``compile_template`` parses to a syntax tree, folds constants (literal operations, conditions that are known, runs of
text) and turns the tree into closures; rendering a conversation runs no parser.

Control strings inside texts are escaped reversibly: ``<`` + n backslashes + ``|`` gets one backslash more, so
``<|`` never occurs in an escaped text and ``read_back`` finds every turn.

Turns with a null text are empty turns, a null role is an empty role. Turns are ordered by turn, then role, then text, so ties and
repeated rows give one fixed order and all stay. Rows with a null conv_id form one conversation. Columns besides these
four are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import bound_batches

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | role) + '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\n' }}{% endfor %}"
)

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\+)\|")
_NEWLINE = "<|nl|>"
_TURN = re.compile(r"<\|im_start\|>((?:(?!\n).)*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1][1:] + "|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """As ``escape``; line feeds, which end the role of a turn, get a control string of their own."""
    return escape(role).replace("\n", _NEWLINE)


def unescape_role(role: str) -> str:
    return unescape(role.replace(_NEWLINE, "\n"))


FILTERS: dict[str, Callable[[Any], str]] = {
    "escape": lambda v: escape(_text(v)),
    "role": lambda v: escape_role(_text(v)),
    "trim": lambda v: _text(v).strip(),
}


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for something the sandbox does not have."""


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


@dataclass(frozen=True)
class Node:
    """A node of the syntax tree: ``kind`` and what belongs to it."""

    kind: str
    value: Any = None
    parts: tuple = ()


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[()\[\].+|=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(code: str) -> list[tuple[str, Any]]:
    out, at, code = [], 0, code.rstrip()
    while at < len(code):
        found = _TOKEN.match(code, at)
        if not found:
            raise TemplateError(f"cannot read {code[at:]!r}")
        string, number, name, sign = found.groups()
        if string is not None:
            out.append(("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("const", int(number)) if number else ("name", name) if name else ("sign", sign))
        at = found.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, code: str) -> None:
        self.tokens, self.at = _tokens(code), 0

    def take(self, value: Any = None, kind: str | None = None) -> Any:
        """The next token if it is of this kind or value, else None."""
        if self.at < len(self.tokens):
            k, v = self.tokens[self.at]
            if (kind is None or k == kind) and (value is None or (k != "const" and v == value)):
                self.at += 1
                return v
        return None

    def need(self, value: Any = None, kind: str | None = None) -> Any:
        found = self.take(value, kind)
        if found is None:
            raise TemplateError(f"expected {value or kind} in {self.tokens}")
        return found

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"did not expect {self.tokens[self.at][1]!r}")

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = fold(Node("or", None, (left, self.both())))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = fold(Node("and", None, (left, self.negated())))
        return left

    def negated(self) -> Node:
        if self.take("not"):
            return fold(Node("not", None, (self.negated(),)))
        left = self.joined()
        for sign in ("==", "!="):
            if self.take(sign, "sign"):
                return fold(Node(sign, None, (left, self.joined())))
        return left

    def joined(self) -> Node:
        left = self.filtered()
        while self.take("+", "sign"):
            left = fold(Node("+", None, (left, self.filtered())))
        return left

    def filtered(self) -> Node:
        left = self.atom()
        while self.take("|", "sign"):
            name = self.need(kind="name")
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name}")
            left = fold(Node("filter", name, (left,)))
        return left

    def atom(self) -> Node:
        if self.take("(", "sign"):
            node = self.either()
            self.need(")", "sign")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            node = Node("const", self.tokens[self.at][1])
            self.at += 1
        else:
            name = self.need(kind="name")
            node = Node("const", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Node("name", name)
        while True:
            if self.take(".", "sign"):
                node = Node("item", self.need(kind="name"), (node,))
            elif self.take("[", "sign"):
                kind, key = self.tokens[self.at] if self.at < len(self.tokens) else ("", None)
                if kind != "const":
                    raise TemplateError("an index is a literal")
                self.at += 1
                self.need("]", "sign")
                node = Node("item", key, (node,))
            else:
                return node


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def fold(node: Node) -> Node:
    """Replace an operation on literals by its result."""
    if node.parts and all(p.kind == "const" for p in node.parts):
        values = [p.value for p in node.parts]
        if node.kind in _BINARY:
            return Node("const", _BINARY[node.kind](*values))
        if node.kind == "not":
            return Node("const", not values[0])
        if node.kind == "filter":
            return Node("const", FILTERS[node.value](values[0]))
    if node.kind == "+" and node.parts[1].kind == "const" and isinstance(node.parts[1].value, str):
        left = node.parts[0]
        if left.kind == "+" and left.parts[1].kind == "const" and isinstance(left.parts[1].value, str):
            return Node("+", None, (left.parts[0], Node("const", left.parts[1].value + node.parts[1].value)))
    return node


def parse(template: str) -> tuple[Node, ...]:
    """Syntax tree of a template: nodes ``emit``, ``for``, ``if``, ``set`` and ``generation``."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    tags: list[tuple[str, Any]] = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                tags.append(("text", part))
        elif part.startswith("{{"):
            tags.append(("print", part[2:-2]))
        else:
            word, _, rest = part[2:-2].strip().partition(" ")
            tags.append((word, rest))
    body, at = _block(tags, 0, ())
    return body


def _whole(code: str) -> Node:
    e = _Expression(code)
    node = e.either()
    e.end()
    return node


def _block(tags: list[tuple[str, Any]], at: int, until: tuple[str, ...]) -> tuple[tuple[Node, ...], int]:
    out: list[Node] = []

    def emit(node: Node) -> None:
        if node.kind == "const":
            node = Node("const", _text(node.value))
            if out and out[-1].kind == "emit" and out[-1].parts[0].kind == "const":
                node = Node("const", out.pop().parts[0].value + node.value)
            if not node.value:
                return
        out.append(Node("emit", None, (node,)))

    while at < len(tags):
        word, rest = tags[at]
        if word in until:
            return tuple(out), at
        if word == "text":
            emit(Node("const", rest))
        elif word == "print":
            emit(_whole(rest))
        elif word == "set":
            e = _Expression(rest)
            name = e.need(kind="name")
            e.need("=", "sign")
            out.append(Node("set", name, (e.either(),)))
            e.end()
        elif word == "for":
            e = _Expression(rest)
            name = e.need(kind="name")
            e.need("in", "name")
            over = e.either()
            e.end()
            body, at = _block(tags, at + 1, ("endfor",))
            out.append(Node("for", name, (over, body)))
        elif word == "generation":
            body, at = _block(tags, at + 1, ("endgeneration",))
            out.append(Node("generation", None, (body,)))
        elif word == "if":
            arms, test = [], _whole(rest)
            while True:
                body, at = _block(tags, at + 1, ("elif", "else", "endif"))
                if test.kind != "const" or test.value:
                    arms.append((test, body))
                word, rest = tags[at]
                if word == "endif":
                    break
                test = Node("const", True) if word == "else" else _whole(rest)
            if arms and arms[0][0].kind == "const":
                for node in arms[0][1]:  # the condition is known: only its body is left
                    if node.kind == "emit":
                        emit(node.parts[0])
                    else:
                        out.append(node)
            elif arms:
                out.append(Node("if", None, tuple(arms)))
        else:
            raise TemplateError(f"did not expect {word}")
        at += 1
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return tuple(out), at


class _Sink:
    """What has been rendered, and the spans inside generation blocks, in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Node) -> Callable[[dict], Any]:
    """A closure that computes an expression from the names in scope."""
    kind, value = node.kind, node.value
    if kind == "const":
        return lambda scope: value
    if kind == "name":
        return lambda scope: scope.get(value)
    parts = [_value(p) for p in node.parts]
    if kind == "item":
        (of,) = parts
        return lambda scope: (x := of(scope)).get(value) if isinstance(x := of(scope), dict) else None
    if kind == "filter":
        (of,), use = parts, FILTERS[value]
        return lambda scope: use(of(scope))
    if kind == "not":
        (of,) = parts
        return lambda scope: not of(scope)
    left, right = parts
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    use = _BINARY[kind]
    return lambda scope: use(left(scope), right(scope))


def _action(node: Node) -> Callable[[dict, _Sink], None]:
    """A closure that renders a node."""
    if node.kind == "emit":
        of = _value(node.parts[0])
        return lambda scope, sink: sink.write(_text(of(scope)))
    if node.kind == "set":
        name, of = node.value, _value(node.parts[0])
        return lambda scope, sink: scope.__setitem__(name, of(scope))
    if node.kind == "generation":
        body = _actions(node.parts[0])

        def generation(scope: dict, sink: _Sink) -> None:
            start = sink.length
            body(scope, sink)
            sink.spans.append((start, sink.length))

        return generation
    if node.kind == "if":
        arms = [(_value(test), _actions(body)) for test, body in node.parts]

        def choose(scope: dict, sink: _Sink) -> None:
            for test, body in arms:
                if test(scope):
                    return body(scope, sink)

        return choose
    name, over, body = node.value, _value(node.parts[0]), _actions(node.parts[1])

    def loop(scope: dict, sink: _Sink) -> None:
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("for needs a list")
        for i, item in enumerate(items):
            body({**scope, name: item, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, sink)

    return loop


def _actions(nodes: tuple[Node, ...]) -> Callable[[dict, _Sink], None]:
    actions = [_action(n) for n in nodes]

    def run(scope: dict, sink: _Sink) -> None:
        for act in actions:
            act(scope, sink)

    return run


def compile_template(template: str = CHATML) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from turns (``role``, ``text``) to the formatted text and the spans under the loss mask."""
    body = _actions(parse(template))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        body({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a conversation formatted by ``CHATML``."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """``conv_id, formatted, spans``: one row per conversation.

    Turns are hash-partitioned by conversation, sorted inside the partitions and streamed, so a task holds one
    conversation and one batch at a time.
    """
    bound_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = f"conv_id {kind}, formatted string, spans array<struct<start: long, end: long>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        held: list[dict] = []
        current: Any = None
        out: list[tuple[Any, str, list]] = []
        size, id_type = 0, pa.int64()

        def flush() -> pa.RecordBatch:
            ids, texts, spans = zip(*out, strict=True)
            marks = [[{"start": a, "end": b} for a, b in s] for s in spans]
            out.clear()
            return pa.record_batch([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array(marks, span)], names=["conv_id", "formatted", "spans"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != current:
                    out.append((current, *render(held)))
                    size += len(out[-1][1])
                    held = []
                    if size > 1 << 21 or len(out) >= 2000:
                        yield flush()
                        size = 0
                current = conv
                held.append({"role": role, "text": text})
        if held:
            out.append((current, *render(held)))
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)
