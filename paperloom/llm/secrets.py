"""Secret scans by assignment-aware lexing.

Beside three fixed patterns, the text is lexed for assignments of source and
configuration syntax (``name = "literal"``, ``"name": "literal"``, ``name :=
other + 'literal'``, ``--name=literal``, ``<name>literal</name>``). Names keep
the literals that they were given, so a literal reaches every target to which
it is passed on, whatever the order of the lines. A literal is reported if one
of its targets has a sensitive name and it looks like a value, not a placeholder.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._common import own, texts_of, with_arrow_columns

#: The base patterns, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}
LEAST_VALUE = 6
HINTS = ("passw", "secret", "token", "api")

#: Sensitive parts of a name and their weights; a name's weight is the largest that its parts, or two parts in a row, have.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "pin": 0.5, "salt": 0.5, "api key": 1.0, "access key": 1.0,
    "secret key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0, "client secret": 1.0, "connection string": 0.8,
}
#: Parts that count wherever a part ends with them (dbpassword), and names whose quoted literals may hold blanks.
ENDINGS = ("password", "passwd", "passphrase", "secret", "token", "apikey")
PHRASES = ("password", "passwd", "passphrase", "pwd")
PLACEHOLDER = re.compile(r"(?i)^(?:(.)\1*|<.*>|\$\{?.*|\{\{.*|%\(?\w+.*|your[_-]?.*|change.?me.*|example.*|dummy.*|placeholder.*|redacted|none|null|nil|true|false|undefined|string|env|os\.environ.*|process\.env.*)$")
LEAST_SCORE = 0.5

NAME = re.compile(r"""(?<![\w$.-])(?:--)?([A-Za-z_$][\w.$-]*)(?:["']\]?)?[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*""")
TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</\1>")
QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
BARE = re.compile(r"""[^\s,;#"'`(){}\[\]<>]+""")
#: Longest bare term that may be the name of a constant.
LONGEST_NAME = 256
PLUS = re.compile(r"[ \t]*\+[ \t]*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int, int, int]


def name_weight(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    ends = (SENSITIVE[e] for p in parts for e in ENDINGS if p.endswith(e))
    return max([0.0, *ends, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(parts, parts[1:], strict=False))])


def literal_weight(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a secret: 0 for short, placeholder or (unless a ``phrase`` may stand there) blank-holding ones, then by the entropy of its characters."""
    if len(value) < LEAST_VALUE or PLACEHOLDER.match(value) or (any(c.isspace() for c in value) and not (phrase and 3 <= len(value.split()) <= 12)):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return min(1.0, 0.4 + 0.2 * entropy)


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a target with a sensitive name."""
    given: dict[str, list[tuple[int, int]]] = {}
    passed: list[tuple[str, str]] = []
    runs = [m.span() for m in BARE.finditer(text)]  # looked up, as a run may hold many assignments and be long
    names = [(m.start(), m.end(1)) for m in NAME.finditer(text)]

    def bare_end(at: int) -> int:
        """Where a bare term ends: with its run, before the next assignment in it, or, if it begins one, with that one's name."""
        run = bisect_right(runs, (at, len(text))) - 1
        if run < 0 or runs[run][1] <= at:
            return at
        following = bisect_left(names, (at, 0))
        if following < len(names) and names[following][0] < runs[run][1]:
            return names[following][1] if names[following][0] == at else names[following][0]
        return runs[run][1]

    for m in NAME.finditer(text):
        name, at = m[1], m.end()
        while True:
            if term := QUOTED.match(text, at):
                given.setdefault(name, []).append(term.span(2))
                end = term.end()
            else:
                end = bare_end(at)
                if end == at:
                    break
                given.setdefault(name, []).append((at, end))
                if end - at <= LONGEST_NAME:
                    passed.append((text[at:end], name))
            more = PLUS.match(text, end)
            if not more:
                break
            at = more.end()
    for m in TAG.finditer(text):
        given.setdefault(m[1], []).append(m.span(2))
    targets: dict[str, list[str]] = {}
    for source, target in passed:
        if source in given and source != target:
            targets.setdefault(source, []).append(target)
    weight = {name: name_weight(name) for name in given}
    todo = [n for n, w in weight.items() if w > 0]
    sources: dict[str, list[str]] = {}
    for source, names in targets.items():
        for name in names:
            sources.setdefault(name, []).append(source)
    while todo:  # weights flow from a target back to what it was given
        name = todo.pop()
        for source in sources.get(name, ()):
            if weight[source] < weight[name]:
                weight[source] = weight[name]
                todo.append(source)
    found = set()
    for name, spans in given.items():
        if weight[name] < LEAST_SCORE:  # a literal weighs 1 at most
            continue
        for a, b in spans:
            value = text[a:b]
            phrase = text[a - 1 : a] in ("'", '"', "`") and name.lower().endswith(PHRASES)
            if value not in given and weight[name] * literal_weight(value, phrase) >= LEAST_SCORE:
                found.add((a, b))
    return sorted(found)


def spans_of(text: str) -> list[Span]:
    """kind, start, end and the place of the value itself, in code points, by start and kind."""
    base: list[Span] = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        base += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        base += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    more: list[Span] = []
    if "=" in text or ":" in text or "</" in text:
        base.sort(key=lambda s: s[1])
        starts, reach = [s[1] for s in base], [-1, *accumulate((s[2] for s in base), max)]  # how far the spans that begin up to a place reach
        more = [("literal", a, b, a, b) for a, b in lexed(text) if reach[bisect_right(starts, a)] < b]
    return sorted(base + more, key=lambda s: (s[1], KINDS[s[0]], s[2]))


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with the values of its secrets, overlapping ones as one, replaced by ``mark``."""
    out, at, until = [], 0, -1
    for _, _, _, a, b in sorted(spans_of(text), key=lambda s: s[3:]):
        if a >= until:
            out += [text[at:a], mark]
        at = until = max(until, b)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, found: str = "found") -> DataFrame:
    """doc_id and ``found``, the secrets of every row's whole text: an array of kind, start, end and the value's own place, by start and kind.

    A null or empty text has none. Rows repeat as they are; other columns are
    ignored; an empty table gives no rows.
    """
    names = ("start", "end", "value_start", "value_end")
    kind = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in names)]))

    def make():
        return lambda batch: [pa.array([[dict(zip(("kind", *names), s, strict=True)) for s in spans_of(x)] for x in texts_of(batch)], kind)]

    span = T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in names)])
    return with_arrow_columns(docs.select("doc_id", "text"), [T.StructField(found, T.ArrayType(span))], make).drop("text")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced (a null stays null) and n_chars, where there is one, counted again; all columns kept.

    Null and empty texts stay as they are; repeated rows stay, each replaced
    alike; a very long text takes time in proportion; an empty table gives no rows.
    """
    new = own("text", docs)

    def make():
        return lambda batch: [pa.array([None if x is None else redact(x) for x in batch.column(batch.schema.names.index("text")).to_pylist()], pa.string())]

    out = with_arrow_columns(docs, [T.StructField(new, T.StringType())], make)
    return out.select(*[F.col(new).alias("text") if c == "text" else F.when(F.col("text").eqNullSafe(F.col(new)), F.col(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
