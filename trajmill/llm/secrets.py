"""Secrets in texts, by fixed patterns and by assignment-aware lexing.

The lexer reads the assignments of source and configuration syntax (``name = "literal"``,
``"name": literal``, ``name := a + "b"``, ``NAME=literal``) as name-literal pairs in text order.
Names that were given a literal before stand for it (constant propagation), through any number
of steps and through ``+``.  A literal is reported when the name that receives it sounds
sensitive and the literal looks like a credential; with constants, the span is where the literal
was written.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from trajmill.llm.arrow import map_rows

# Fixed patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "literal", "constant")

# Weights of the words of a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "secret": 0.9, "credential": 0.9, "credentials": 0.9,
    "token": 0.8, "apikey": 0.9, "privatekey": 0.9, "secretkey": 1.0, "accesskey": 0.8, "bearer": 0.8, "auth": 0.6, "pass": 0.6, "key": 0.5,
    "private": 0.4, "api": 0.4, "access": 0.3, "signing": 0.4, "encryption": 0.4, "session": 0.3, "client": 0.2, "salt": 0.5, "dsn": 0.6,
}
HARMLESS = {
    "count": -0.6, "length": -0.6, "len": -0.6, "size": -0.6, "limit": -0.6, "max": -0.6, "min": -0.6, "num": -0.6, "type": -0.5, "name": -0.5,
    "file": -0.4, "path": -0.5, "url": -0.4, "uri": -0.4, "id": -0.3, "label": -0.6, "field": -0.6, "header": -0.5, "public": -0.6,
    "timeout": -0.6, "ttl": -0.6, "expires": -0.6, "enabled": -0.6, "required": -0.6, "policy": -0.6, "hint": -0.6, "regex": -0.6,
}
PLACEHOLDER = re.compile(r"(?i)change_?me|your[-_ ]|example|placeholder|dummy|redacted|none|null|true|false|undefined|todo|x{4,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}")
THRESHOLD = 0.9
LEAST_LITERAL = 6

_OPERATOR = re.compile(r":=|=>|[=:]")
_NAME_BEFORE = re.compile(r"""(?:\A|[^\w.$-])([A-Za-z_$][\w$-]*(?:\.[\w$-]+)*)["']?\]?[ \t]*\Z""")
_NAME_REACH = 160
_NAME_ONLY = re.compile(r"""[\w.$-]+["']?\]?""")
#: Characters of a literal that are scored; longer ones come from constants that are put together.
SCORED = 4096
_VALUE = re.compile(r"""[ \t]*(?:[bru]?"((?:[^"\\\n]|\\.)*)"|[bru]?'((?:[^'\\\n]|\\.)*)'|([^\s"'`,;(){}\[\]<>+=:]+(?:[+/=.:-]+[^\s"'`,;(){}\[\]<>+=:]+)*=*))""")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_weight(name: str) -> float:
    """How sensitive a target name sounds: its strongest word, less for harmless ones."""
    words = [w.lower() for w in _WORD.findall(name)]
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    weights = sorted((SENSITIVE[w] for w in words if w in SENSITIVE), reverse=True)
    if not weights:
        return 0.0
    return weights[0] + 0.3 * sum(weights[1:]) + sum(HARMLESS.get(w, 0.0) for w in words)


def literal_weight(literal: str) -> float:
    """0 for placeholders and words, up to 0.5 for long literals of many different characters."""
    if len(literal) < LEAST_LITERAL or PLACEHOLDER.search(literal) or " " in literal.strip():
        return -1.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(any(map(test, literal)) for test in (str.islower, str.isupper, str.isdigit)) + (not literal.isalnum())
    return min(0.5, 0.06 * entropy + 0.07 * (kinds - 1) + 0.004 * min(n, 40))


class Places:
    """Where a literal is written: its own places, and those of the constants in it, which are shared.

    However often constants are put together, each place is held once.
    """

    __slots__ = ("own", "parts", "told")

    def __init__(self) -> None:
        self.own: list[tuple[int, int]] = []
        self.parts: list[Places] = []
        self.told = False

    def __bool__(self) -> bool:
        return bool(self.own or self.parts)

    def _walk(self, seen: Callable[[Places], bool]) -> Iterator[tuple[int, int]]:
        stack = [self]
        while stack:
            node = stack.pop()
            if not seen(node):
                yield from node.own
                stack += node.parts

    def __iter__(self) -> Iterator[tuple[int, int]]:
        met: set[int] = set()
        return self._walk(lambda node: id(node) in met or met.add(id(node)))

    def untold(self) -> Iterator[tuple[int, int]]:
        """The places that no earlier call has given."""

        def told(node: Places) -> bool:
            before, node.told = node.told, True
            return before

        return self._walk(told)


def _name_before(text: str, at: int) -> str | None:
    """The name that ends before a place, of any length."""
    while at and text[at - 1] in " \t":
        at -= 1
    reach = _NAME_REACH
    while at > reach and _NAME_ONLY.fullmatch(text, at - reach, at):
        reach *= 4
    name = _NAME_BEFORE.search(text[max(0, at - reach) : at])
    return name[1] if name else None


def assignments(text: str) -> Iterator[tuple[str, str, Places, bool]]:
    """Name, resolved literal (its first ``SCORED`` characters), where it is written, and whether a constant took part; in text order."""
    constants: dict[str, tuple[str, Places]] = {}
    done = 0
    for op in _OPERATOR.finditer(text):
        if op.start() < done:
            continue
        name = _name_before(text, op.start())
        if not name:
            continue
        at, literal, spans, through = op.end(), "", Places(), False
        while value := _VALUE.match(text, at):
            at = value.end()
            bare = value[3]
            if bare is not None and bare in constants:
                known, places = constants[bare]
                spans.parts.append(places)
                through = True
            else:
                known = value[value.lastindex]
                spans.own.append(value.span(value.lastindex))
            if len(literal) < SCORED:
                literal = (literal + known)[:SCORED]
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if spans:
            done = at
            if text[at : at + 1] == "(":  # a call, whose value is not written here
                continue
            constants[name] = literal, spans
            yield name, literal, spans, through


def find_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """Kind, start, end (code points), target name and score, by start and then kind."""
    found: dict[tuple[int, int], tuple[str, int, int, str, float]] = {}
    spans = [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    spans += [("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    spans += [("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    for name, literal, places, through in assignments(text):
        score = name_weight(name)
        if score > 0 and (score := score + literal_weight(literal)) >= THRESHOLD:
            for start, end in places.untold():
                found.setdefault((start, end), ("constant" if through else "literal", start, end, name, round(score, 4)))
    return sorted([*spans, *found.values()], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row; ``spans`` is empty where nothing is found.

    A null text counts as empty.  Null ids and repeated rows are kept as they are.  Whole texts
    are read, of any length; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("spans", T.ArrayType(SPAN))])

    def start():
        return lambda row: [(row[0], [dict(zip(SPAN.names, s, strict=True)) for s in find_spans(row[1] or "")])]

    return map_rows(docs.select(F.col(doc_id), F.col(text)), start, schema)
