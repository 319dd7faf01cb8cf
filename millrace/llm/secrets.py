"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. Beside them a small lexer reads source and
configuration syntax (``name = "literal"``, ``"name": "literal"``, ``name: literal``,
``name => literal``, ``cfg["name"] = ...``, keyword arguments, concatenations with ``+``, literals
handed to a call, ``<name>literal</name>``, ``key="name" value="literal"`` and ``name: n`` before ``value: literal``)
into name-literal pairs, propagates constants through names (``x = "..."; password = x``),
and scores each literal by how sensitive its target's name is. Literals that score at
least THRESHOLD and lie in no base span are added as spans of kind ``lexed``.

Every assignment to a name is a definition of its own. A reference stands for the definitions of its name above it,
any of which may be in force there, as branches are not followed; only where there is none above, for those below. In a
joined value it stands for the nearest of them, and the others take that place one at a time. Whatever a
sensitive target reaches through names, at any depth, is also judged as a value of its own. Names, chains and
joined values may be of any length.

Defined results: a null or empty text has no spans; repeated rows are scanned alike;
texts of any length are scanned whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common

#: The base patterns, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

#: Name parts and how sensitive they make a target.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 1.0, "credentials": 1.0, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0,
    "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signature": 0.6, "salt": 0.6, "pass": 0.8, "pin": 0.5, "key": 0.5,
    "cert": 0.5, "dsn": 0.6, "cookie": 0.5, "session": 0.5,
}
#: Name parts that say the value describes a secret rather than being one.
HARMLESS = {"count", "limit", "max", "min", "length", "size", "type", "name", "path", "file", "url", "hint", "label", "field", "prompt", "expiry", "ttl", "policy", "public", "index", "column", "regex", "pattern"}
PLACEHOLDER = re.compile(
    r"^(?:<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|x+|\*+|\.+|changeme|change_me|example.*|your[_-].*|none|null|true|false|undefined|todo|redacted|\[redacted\])$",
    re.IGNORECASE | re.DOTALL,
)
THRESHOLD = 0.5
LEAST_LITERAL = 8
#: Values with white space: the run that looks generated by itself, the weight from which a name makes a phrase
#: a likely secret, and what is left of a phrase's score.
LEAST_RUN, STRONG, SPACED = 16, 0.8, 0.6
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY")
SCHEMES = {"bearer", "basic", "token", "digest", "apikey"}

OPERATOR = re.compile(r"=>|:=|(?<![=!<>:+*/%&|^~-])=(?![=>~])|(?<![:\w]:)(?<!:):(?![:/=])")
#: What stands before an operator, read backwards: a type, closing brackets and quotes, then the name.
NAME_BEFORE = re.compile(r"""[ \t]*(?:[\w.\[\]]*[A-Za-z_][ \t]*:[ \t]*)??(?:\]\s?)?["'`]?([\w$.-]*[A-Za-z_$])""")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)>([^<>\n]{8,})</\1>")
#: Pairs of names that hold a pair in two: the target's name first, then its value.
NAMING, VALUED = {"key", "name", "id"}, {"value", "default"}
BETWEEN = re.compile(r"""["'`]?[\s,;]*(?:- )?["'`]?""")
ENVIRONMENT = re.compile(r"[A-Z][A-Z0-9_]*")
STRING = re.compile(
    r'''[rbfuRBFU]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`]*)`)''',
    re.DOTALL,
)
REFERENCE = re.compile(r"[A-Za-z_$][\w$.]*(?![\w$.(\[])")
CALL = re.compile(r"[A-Za-z_$][\w$.]*\(")
BARE = re.compile(r"""[^\s,;#"'`()\[\]{}<>]+""")
PLUS = re.compile(r"[ \t]*(?:\+|\.\.)?[ \t]*(?:\\?\n[ \t]*)?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), leftmost and non-overlapping for each kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def sensitivity(name: str) -> float:
    """0 to 1, by the parts of the last two components of a dotted, snake or camel name."""
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    best = max((SENSITIVE.get(p, SENSITIVE.get(p.rstrip("s"), 0.0)) for p in parts + joined), default=0.0)
    return best * 0.3 if parts and (parts[-1] in HARMLESS or parts[0] in HARMLESS) else best


def randomness(value: str) -> float:
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.0) * (1.0 if classes >= 2 else 0.6)


def mixed(value: str) -> bool:
    """Whether letters and digits both occur."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def strength(value: str, weight: float = 0.0) -> float:
    """0 to 1: how much a literal for a target of this weight looks like a generated or chosen secret.

    A value with white space counts whole as a PEM private key or after an authorization scheme. Else its
    longest run counts if it looks generated, and under a strongly sensitive name the value does, lowered
    (more so if it has no digits, as prose has none)."""
    value = value.strip()
    if len(value) < LEAST_LITERAL or PLACEHOLDER.match(value):
        return 0.0
    if not (runs := value.split())[1:]:
        return randomness(value)
    if PEM.search(value):
        return 1.0
    if len(runs) == 2 and runs[0].lower() in SCHEMES:
        return strength(runs[1], weight)
    longest = max((r for r in runs if "://" not in r and mixed(r)), key=len, default="")
    best = randomness(longest) if len(longest) >= LEAST_RUN else 0.0
    if weight >= STRONG:
        best = max(best, SPACED * randomness("".join(runs)) * (1.0 if mixed(value) else 0.6))
    return best


def handed(text: str, at: int) -> list[tuple[str, int, int]]:
    """The string literals among the arguments of the call that opens at `at`, on one line and before the next operator
    (what follows a keyword is an assignment of its own), that are no names of variables."""
    found, depth = [], 0
    while at < len(text) and text[at] not in "\n=:":
        if m := STRING.match(text, at):
            group = m.lastgroup
            if mixed(m[group]) and not ENVIRONMENT.fullmatch(m[group]):
                found.append((m[group], m.start(group), m.end(group)))
            at = m.end()
            continue
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
        if not depth:
            break
    return found


def pairs(text: str) -> Iterator[tuple[int, str, list[tuple[str, int, int]], list[tuple[str, int, int]], bool]]:
    """(place, target name, literals, names referred to, whether the literals make one value), literals and names as
    (value, start, end), for each assignment. Linear: no operator looks back beyond the one before the last."""
    after, ends, naming = 0, (0, 0), None
    for op in OPERATOR.finditer(text):
        low, ends = max(after, ends[0]), (ends[1], op.end())
        if op.start() < after:  # inside a literal that was read already
            continue
        name = NAME_BEFORE.match(text[low : op.start()][::-1])
        if not name:
            continue
        target, begun = name[1][::-1], op.start() - name.end()
        at, literals, names, one = op.end(), [], [], True
        while at < len(text) and text[at] in " \t":
            at += 1
        while True:
            if m := STRING.match(text, at):
                group = m.lastgroup
                literals.append((m[group], m.start(group), m.end(group)))
            elif m := REFERENCE.match(text, at):
                names.append((m[0], m.start(), m.end()))
                if not literals and len(names) == 1 and (b := BARE.match(text, at)) and b.end() > m.end():
                    names, m = [], b  # a bare value such as KEY=abc/def
                    literals.append((m[0], m.start(), m.end()))
            elif not literals and not names and (m := CALL.match(text, at)):
                literals, one = handed(text, m.end() - 1), False
                break
            elif not literals and not names and (m := BARE.match(text, at)):
                literals.append((m[0], m.start(), m.end()))
            else:
                break
            at = m.end()
            glue = PLUS.match(text, at)
            if not ("+" in glue[0] or ".." in glue[0] or text[glue.end() : glue.end() + 1] in ('"', "'") and "\n" not in glue[0] and glue[0] == ""):
                break
            at = glue.end()
        if literals or names:
            if literals and one:
                after = max(after, literals[-1][2])
            if naming and target.lower() in VALUED and BETWEEN.fullmatch(text, naming[1], begun):
                target = naming[0]
            whole = literals[0] if len(literals) == 1 and not names else names[0] if len(names) == 1 and not literals else None
            naming = (whole[0], whole[2]) if whole and target.lower() in NAMING else None
            yield op.start(), target, literals, names, one
    for m in ELEMENT.finditer(text):
        yield m.start(), m[1], [(m[2], m.start(2), m.end(2))], [], True


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target, direct or through constants, is sensitive."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found = sorted(pairs(text), key=lambda x: x[0])
    weights = [sensitivity(name) for _, name, *_ in found]
    if not any(weights):
        return []
    defined: dict[str, list[int]] = {}
    for i, (_, name, *_) in enumerate(found):
        defined.setdefault(name, []).append(i)
    # a lone name that the text does not define is a bare value, as in KEY=abc123
    nodes = [(names, []) if not literals and len(names) == 1 and names[0][0] not in defined else (literals, [x for x, _, _ in names if x in defined]) for _, _, literals, names, _ in found]

    def reaching(name: str, i: int) -> tuple[int, int]:
        """Which part of defined[name] node i sees: those above it, else those below."""
        at = defined[name]
        k = bisect_left(at, i)
        return (0, k) if k else (int(at[0] == i), len(at))

    def nearest(name: str, i: int) -> int:
        a, b = reaching(name, i)
        return i if a == b else defined[name][a if defined[name][a] > i else b - 1]

    def joined(i: int, swapped: str = "", by: int = -1) -> tuple[list[tuple[str, int, int]], set[int]]:
        """The literals of node i's value, each node once, and its nodes; `by` stands for the name `swapped` in it."""
        value, seen, left = [], set(), [i]
        while left:
            k = left.pop()
            if k not in seen:
                seen.add(k)
                value += nodes[k][0]
                left += [by if k == i and x == swapped else nearest(x, k) for x in nodes[k][1]]
        return sorted(value, key=lambda x: x[1]), seen

    flagged: set[tuple[int, int]] = set()

    def flag(value: list[tuple[str, int, int]], weight: float) -> bool:
        """Whether the value as a whole is a secret; its literals are flagged then."""
        if value and weight * strength("".join(v for v, _, _ in value), weight) >= THRESHOLD:
            # a bare word after the name and a colon is prose unless it mixes in digits
            flagged.update((a, b) for v, a, b in value if b > a and (text[a - 1 : a] in ('"', "'", "`", ">") or any(c.isdigit() for c in v)))
            return True
        if len(value) > 1 and any(c.isspace() for v, _, _ in value for c in v):
            for x in value:  # a part with white space does not speak for the others
                flag([x], weight)
        return False

    # The most sensitive targets go first, of equal ones the last: each node is judged once, by its greatest weight, and one
    # that is part of a flagged value needs no judging.
    seen, told, opened = set(), set(), {}
    for top in sorted((i for i, w in enumerate(weights) if w), key=lambda i: (-weights[i], -i)):
        left = [top]
        while left:
            i = left.pop()
            if i in seen:
                continue
            seen.add(i)
            literals, names = nodes[i]
            if not found[i][4]:
                for x in literals:
                    flag([x], weights[top])
            elif (literals or len(names) > 1) and i not in told:
                value, parts = joined(i)
                if flag(value, weights[top]):
                    told |= parts
                for x in dict.fromkeys(names):
                    a, b = reaching(x, i)
                    for other in defined[x][a:b]:
                        if other != nearest(x, i):
                            flag(joined(i, x, other)[0], weights[top])
            for x in names:
                a, b = reaching(x, i)
                low, high = opened.get(x, (a, a))
                left += defined[x][min(a, low) : low] + defined[x][max(a, high) : b]
                opened[x] = (min(a, low), max(b, high))
    return sorted(flagged)


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans and the lexed ones that lie in none of them."""
    base = base_spans(text)
    covered: list[tuple[int, int]] = []
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    out, i = list(base), 0
    for a, b in lexed_spans(text):
        while i < len(covered) and covered[i][1] < b:
            i += 1
        if not (i < len(covered) and covered[i][0] <= a):
            out.append((a, 3, b))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    """text with every span, overlapping ones merged, replaced by mark."""
    out, at, end = [], 0, 0
    for a, _, b in all_spans(text):
        if a >= end:
            out += [text[at:a], mark] if a > end or not out else []
            at = end = b
        elif b > end:
            at = end = b
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts by kind, digest of the base spans, and all spans. No exchange."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_lexed", pa.int64())])
        for batch in common.slices(batches):
            rows = [all_spans(t) for t in common.texts_of(batch.column(1))]
            counts = [Counter(k for _, k, _ in r) for r in rows]
            yield common.batch_of(
                schema, doc_id=batch.column(0), n_assign=[c[0] for c in counts], n_access=[c[1] for c in counts], n_hex=[c[2] for c in counts], n_lexed=[c[3] for c in counts],
                base_sha256=[hashlib.sha256(written([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows], spans=[written(r) for r in rows],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with secrets in text_col replaced by mark; every row and column stays, null stays null."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in common.slices(batches):
            column = batch.column(place)
            new = pa.array([x if x is None else redacted(x, mark) for x in column.to_pylist()], column.type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
