"""Secrets in texts: fixed patterns, and literals assigned to names that sound secret.

The lexer reads assignments as source and configuration files write them (``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``export NAME=literal``, ``name := literal``, ``name => literal``, ``name: type = literal``, strings in
three quotes or backticks, values and ``+`` over line ends, assignments inside a bare word). Names keep the literals they
were given, so a literal that reaches a sensitive name through another name, a ``${NAME}`` or a ``+`` is scored by the
sensitive name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regspan.llm.common import map_rows

#: Kinds in their order; the last one is what the lexer finds.
KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
MIN_LITERAL = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_OPERATOR = re.compile(r":=|=>|[:=]")
#: A name before an operator, read on the reversed text from the operator to the first sign that cannot belong to it.
_NAME_BACK = re.compile(r"""[ \t]*+\]?["'`]?([A-Za-z0-9_.-]*[A-Za-z_])""", re.A)
_QUOTED = re.compile(r'"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}|' r"'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"
                     r'"((?:[^"\\\n]|\\.)*+)"|' r"'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`", re.S)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|&+*#%!]+")
_BRACED = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.-]*)\}", re.A)
_IDENTIFIER = re.compile(r"\$?([A-Za-z_][A-Za-z0-9_.]*)$", re.A)
_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.-]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)", re.A)
#: A literal that is one reference and nothing else holds no secret: ``${name}``, or ``$NAME`` in capitals.
_ONLY_REFERENCE = re.compile(r"\$\{[A-Za-z_][A-Za-z0-9_.-]*\}$|\$[A-Z_][A-Z0-9_]*$", re.A)
#: What stands between an operator and its value: blanks, a line end before a string or before the one word of an indented line.
_GAP = re.compile(r"""[ \t]*+(?:[|>][-+]?[ \t]*+\r?\n[ \t]*+|\\?\r?\n[ \t]*+(?=["'`])|\r?\n[ \t]++(?=[^\s"'`,;(){}\[\]<>|&+*#%!:=]++[ \t]*+(?:\r?\n|$)))?""")
#: A plus sign; at the beginning of a line (as in a patch) only before a string.
_PLUS = re.compile(r"""[ \t]*+\+[ \t]*+(?:\r?\n[ \t]*+)?|[ \t]*+\r?\n[ \t]*+\+[ \t]*+(?=["'`])""")
#: A type, or a further name, up to the ``=`` that assigns: what the name before it gets stands after that one.
_HANDED = re.compile(r"""[ \t]*+(?:&(?:'\w++)?[ \t]*+(?:mut[ \t]++)?)?[A-Za-z_][\w.-]*+(?:::[\w.]++)*+"""
                     r"""(?:[\[<(][\w \t.,|&'?\[\]<>()*-]*+|[?!]?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+[ \t]*+)(?==(?![=>~]))""")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# How much a part of a name says that it holds a secret.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
                "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "private": 0.5, "key": 0.5, "access": 0.3,
                "api": 0.4, "client": 0.2, "signing": 0.4, "encryption": 0.5, "salt": 0.5, "pass": 0.7, "pin": 0.4}
# Words that stand in for a secret, and names that only talk about one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined",
                "required", "string", "optional", "redacted", "xxxxxx", "default", "test", "todo"}
_LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))
#: Blanks and angle signs make a literal look like prose or a placeholder.
PROSE = 0.6
HARMLESS = {"length", "len", "count", "file", "path", "url", "name", "id", "type", "field", "label", "hint", "policy", "expires", "max", "min"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Literal(NamedTuple):
    start: int
    end: int
    value: str  # without references that were followed


def base_spans(text: str) -> list[Span]:
    """Matches of the three fixed patterns, those that fail their length left out. A failed assignment still uses up its text."""
    out = [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [Span("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [Span("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def name_weight(name: str) -> float:
    """How sensitive a name sounds, 0 to 1: parts add up as independent evidence; a harmless last part ends it."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    doubt = 1.0
    for part in {*parts, "".join(parts[-2:])}:
        doubt *= 1.0 - NAME_WEIGHTS.get(part, 0.0)
    return 1.0 - doubt


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1, by its length, entropy and mix of signs; blanks and angle signs lower it."""
    if len(value) < MIN_LITERAL or value.lower() in PLACEHOLDERS or value[0] + value[-1] == "<>":
        return 0.0
    return _look(Counter(value))


def _look(signs: Counter) -> float:
    size = signs.total()
    if size < MIN_LITERAL or len(signs) < 4:
        return 0.0
    bits = -sum(n / size * log2(n / size) for n in signs.values())
    mixed = sum((any(c.isdigit() for c in signs), any(c.islower() for c in signs), any(c.isupper() for c in signs),
                 any(not c.isalnum() for c in signs)))
    return min(1.0, 0.25 * min(bits, 4.0) * (0.6 + 0.2 * mixed)) * (PROSE if any(c in signs for c in " \t\n<>") else 1.0)


class _Reader:
    """Reads the right sides of one text; a bare word that holds further assignments is measured once."""

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.bare_from, self.bare_to = 0, 0

    def bare_end(self, at: int) -> int:
        """End of the bare word at ``at``, or ``at``."""
        if not self.bare_from <= at < self.bare_to:
            m = _BARE.match(self.text, at)
            self.bare_from, self.bare_to = m.span() if m else (at, at)
        return self.bare_to

    def literals(self, at: int) -> tuple[list[Literal | int], int]:
        """Literals and earlier assignments on the right of an operator, and where reading stopped."""
        text, out = self.text, []
        while True:
            at = _GAP.match(text, at).end()
            m = _QUOTED.match(text, at)
            if m:
                inner, rest, last = m[m.lastindex], [], 0
                for r in _REFERENCE.finditer(inner) if "$" in inner else ():
                    node = self.known.get(r[1] or r[2])
                    if node is not None:
                        out.append(node)
                        rest.append(inner[last:r.start()])
                        last = r.end()
                value = "".join([*rest, inner[last:]])
                if not _ONLY_REFERENCE.match(value):
                    out.append(Literal(m.start(m.lastindex), m.end(m.lastindex), value))
                at = m.end()
            elif (ref := _BRACED.match(text, at)):
                if ref[1] in self.known:
                    out.append(self.known[ref[1]])
                at = ref.end()
            else:
                end = self.bare_end(at)
                if end == at:
                    return out, at
                stop = end
                while stop > at and text[stop - 1] in ".:":
                    stop -= 1
                ref = _IDENTIFIER.match(text, at, stop)
                if ref and ref[1] in self.known:
                    out.append(self.known[ref[1]])
                elif stop > at and text[at] != "$":
                    out.append(Literal(at, stop, ""))
                if _OPERATOR.search(text, at, stop):
                    return out, at  # the word is read again for the assignments inside it
                at = end
            plus = _PLUS.match(text, at)
            if not plus:
                return out, at
            at = plus.end()


def assignments(text: str) -> Iterator[tuple[list[str], list[Literal | int]]]:
    """(names, what reaches them) in the order of the text; a number stands for that earlier assignment.

    A literal without a value is the stretch of text itself. References stay references, so a long chain of joined
    constants costs no more than its text.
    """
    reader, back, size = _Reader(text), text[::-1], len(text)
    handed: tuple[int, list[str]] = (-1, [])
    done = nth = 0
    for op in _OPERATOR.finditer(text):
        if op.start() < done:
            continue
        before = handed[1] if handed[0] == op.start() else []
        m = _NAME_BACK.match(back, size - op.start(), size - done)
        if m:
            before.append(m[1][::-1])
        if not before or text.startswith("//", op.end()):
            continue
        on = _HANDED.match(text, op.end())
        if on:
            handed = (on.end(), before)
            end = reader.bare_end(op.end())
            # without blanks the whole word may be one literal as well
            found = [Literal(op.end(), end, "")] if end > on.end() and len(before) == 1 else []
        else:
            found, end = reader.literals(op.end())
            done = end if found else done
        if found:
            names = list(before)
            reader.known.update(dict.fromkeys(names, nth))
            nth += 1
            yield names, found


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals whose best name and own look together reach ``threshold``."""
    made = list(assignments(text))
    weights = [max(map(name_weight, names)) for names, _ in made]
    best: dict[Literal, float] = {}
    for nth in range(len(made) - 1, -1, -1):  # references point back, so a weight is whole before it is passed on
        if weights[nth]:
            for x in made[nth][1]:
                if isinstance(x, int):
                    weights[x] = max(weights[x], weights[nth])
                else:
                    best[x] = max(best.get(x, 0.0), weights[nth])
    looks = _looks(text, best)
    return [Span("literal", x.start, x.end) for x in sorted(best) if best[x] * looks[x] >= threshold]


def _looks(text: str, literals: Iterable[Literal]) -> dict[Literal, float]:
    """``literal_weight`` of each; bare words that end at one place share their signs, which are counted once."""
    out = {}
    signs, at, end = Counter(), -1, -1
    for x in sorted(literals, key=lambda x: (x.end, -x.start)):
        if x.value or x.start == x.end or text[x.start - 1:x.start] in ("'", '"', "`"):
            out[x] = literal_weight(x.value)
            continue
        if x.end != end:
            signs, at, end = Counter(), x.end, x.end
        signs.update(text[x.start:at])
        at = x.start
        out[x] = 0.0 if x.end - x.start <= _LONGEST_PLACEHOLDER and text[x.start:x.end].lower() in PLACEHOLDERS else _look(signs)
    return out


def spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text by start, then kind; positions count code points and ends are exclusive."""
    if not text:
        return []
    found = base_spans(text)
    if "=" in text or ":" in text:
        found += lexed_spans(text, threshold)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans: array of kind, start, end) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Null and repeated doc_ids are kept; other columns are ignored. A text is scanned whole
    whatever its length; spans that begin at one place are ordered by kind. An empty table gives no rows.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            found = [[s._asdict() for s in spans(t, threshold)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                    "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str, found: list[Span], mark: str = "[secret]") -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out, at, until = [], 0, -1
    for s in sorted(found, key=lambda s: (s.start, s.end)):
        if s.start > until:
            out += [text[at:s.start], mark]
        until = max(until, s.end)
        at = max(at, until)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; ``n_chars``, where there is one, counts the new text.

    All rows and all columns stay, in their order. Rows without a secret are unchanged, null texts too.
    """
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            texts = b.column(at_text).to_pylist()
            hits = [spans(t, threshold) for t in texts]
            new = [redacted(t, h) if h else t for t, h in zip(texts, hits)]
            cols[at_text] = pa.array(new, pa.string())
            if at_chars >= 0:
                old = cols[at_chars].to_pylist()
                cols[at_chars] = pa.array([len(t) if h else n for t, h, n in zip(new, hits, old)], cols[at_chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_rows(docs, run, docs.schema)
