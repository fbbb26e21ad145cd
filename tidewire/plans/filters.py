"""Filter trees over a stream, built into one Column.

A filter is an operation over operands in order: all rows not removed (if
inclusive), then its field filters, then its sub-filters.
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import Field
from .stream import SEPARATOR, Stream

OPERATIONS = ("and", "or", "pButNotQ")
DECLARED = ("xor", "nand", "nor", "xnor", "ifThen", "thenIf", "notPButQ")


@dataclass(frozen=True)
class FieldFilter:
    """Any of the values, each a tuple of parts; a last part of * is a prefix."""

    field: str
    values: tuple[tuple[str, ...], ...]
    kind: str = "primary"


@dataclass(frozen=True)
class Filter:
    op: str
    fields: tuple[FieldFilter, ...] = ()
    subs: tuple[Filter, ...] = ()
    inclusive: bool = False


#: Evaluated, it matches nothing; operators that say so skip it.
NO_FILTER = Filter("or")
MATCH_ALL = Filter("and", inclusive=True)


def term(field: str, *values: str | tuple[str, ...], kind: str = "primary") -> FieldFilter:
    return FieldFilter(field, tuple((v,) if isinstance(v, str) else tuple(v) for v in values), kind)


def all_of(*parts: FieldFilter | Filter, inclusive: bool = False) -> Filter:
    return _of("and", parts, inclusive)


def any_of(*parts: FieldFilter | Filter) -> Filter:
    return _of("or", parts, False)


def but_not(*parts: FieldFilter | Filter, inclusive: bool = False) -> Filter:
    return _of("pButNotQ", parts, inclusive)


def _of(op: str, parts, inclusive: bool) -> Filter:
    return Filter(op, tuple(p for p in parts if isinstance(p, FieldFilter)), tuple(p for p in parts if isinstance(p, Filter)), inclusive)


def compose(f: Field, value: tuple[str, ...]) -> str:
    """The term of a value's parts."""
    return (SEPARATOR if f.parts else f.separator).join(value)


def prefix_of(f: Field, value: tuple[str, ...]) -> str:
    """What terms begin with that match a value ending in *.

    A typed prefix is compared whole, so its separator belongs to it.
    """
    head = value[:-1]
    if not head:
        return ""
    if f.parts:
        return SEPARATOR.join(head)
    joined = f.separator.join(head)
    return joined + f.separator if f.prefix in ("raw", "numeric") else joined


def _begins(f: Field, c: Column, prefix: str) -> Column:
    if f.multi:
        return F.exists(c, lambda x: x.startswith(prefix)) if prefix else F.size(c) > 0
    return c.startswith(prefix) if prefix else c.isNotNull()


def _matches(f: Field, ff: FieldFilter) -> Column:
    if "first" in f.features:  # its index holds the first row of each value only; see mark_first
        f = Field(f.name, "multiTerm", f.prefix, f.width, f.separator, f.parts)
        c = F.col(f.first_column)
    else:
        c = F.col(f.column)
    wild = [v for v in ff.values if v and v[-1] == "*" and f.prefix != "none"]
    exact = [compose(f, v) for v in ff.values if v not in wild]
    parts = []
    if exact:
        parts.append(F.arrays_overlap(c, F.array(*(F.lit(x) for x in exact))) if f.multi else c.isin(*exact))
    parts += [_begins(f, c, prefix_of(f, v)) for v in wild]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def build(flt: Filter, s: Stream) -> Column:
    """The filter as a condition on the rows of ``s``, never null.

    Operations that are only declared raise.  A filter on a field that the schema
    lacks is left out.  No values make an ``and`` empty and are left out elsewhere.
    """
    if flt.op not in OPERATIONS:
        raise NotImplementedError(f"{flt.op} cannot be evaluated")
    operands: list[Column] = [~F.col("removed")] if flt.inclusive else []
    for ff in flt.fields:
        f = s.field(ff.field)
        if f is None or not f.features & {"indexed", "first", "bits"}:
            warnings.warn(f"no indexed field {ff.field}: its filter is left out", stacklevel=2)
            continue
        if ff.kind not in ("primary", "latest"):
            raise NotImplementedError(f"no index of kind {ff.kind}")
        if not ff.values:
            if flt.op == "and":
                return F.lit(False)
            continue
        c = _matches(f, ff)
        operands.append(c & F.col(f"latest_{ff.field}") if ff.kind == "latest" else c)
    operands += [build(x, s) for x in flt.subs]
    if flt.op == "pButNotQ":
        if not operands:
            raise ValueError("pButNotQ without an operand")
        return operands[0] & ~reduce(lambda a, b: a | b, operands[1:]) if operands[1:] else operands[0]
    if not operands:
        return F.lit(False)
    return reduce((lambda a, b: a & b) if flt.op == "and" else (lambda a, b: a | b), operands)


def prefixes(flt: Filter, s: Stream) -> dict[tuple[str, str], int]:
    """Net occurrences of each (field, prefix) of a filter, as occurrences() counts terms."""
    def only(x: Filter) -> Filter:
        fields = (replace(ff, values=tuple(v for v in ff.values if is_prefix(s.field(ff.field), v))) for ff in x.fields)
        return replace(x, fields=tuple(fields), subs=tuple(only(y) for y in x.subs))

    return {(field, prefix_of(s.field(field), tuple(v.split(SEPARATOR)))): n for (field, v), n in occurrences(only(flt)).items() if n}


def is_prefix(f: Field | None, value: tuple[str, ...]) -> bool:
    return f is not None and value[-1] == "*" and f.prefix != "none"


def expand(flt: Filter, s: Stream, limit: int) -> Filter:
    """Prefixes replaced by the first ``limit`` terms of the field that have them."""
    def values(ff: FieldFilter) -> FieldFilter:
        f, out = s.field(ff.field), []
        for v in ff.values:
            if f is None or v[-1] != "*" or f.prefix == "none":
                out.append(v)
                continue
            p = prefix_of(f, v)
            terms = s.df.select(F.explode(s.values(ff.field)).alias("t")).filter(F.col("t").startswith(p)).distinct().orderBy("t").limit(limit)
            out += [(r.t,) for r in terms.collect()]
        return replace(ff, values=tuple(dict.fromkeys(out)))

    return replace(flt, fields=tuple(values(x) for x in flt.fields), subs=tuple(expand(x, s, limit) for x in flt.subs))


def occurrences(flt: Filter, sign: int = 1) -> dict[tuple[str, str], int]:
    """Net occurrences of each (field, term): one for each that is wanted, less one for each that is not."""
    out: dict[tuple[str, str], int] = {}
    at = 1 if flt.inclusive else 0
    for ff in flt.fields:
        k = -sign if flt.op == "pButNotQ" and at else sign
        for v in ff.values:
            key = (ff.field, v[0] if len(v) == 1 else SEPARATOR.join(v))
            out[key] = out.get(key, 0) + k
        at += 1
    for sub in flt.subs:
        for key, n in occurrences(sub, -sign if flt.op == "pButNotQ" and at else sign).items():
            out[key] = out.get(key, 0) + n
        at += 1
    return out


_KINDS = {"~": "latest", "^": "pairedLatest", "%": "bloom"}


def parse_filters(text: str) -> Filter:
    """``field:a|b, other:c`` as an ``and``; ``~ ^ %`` before a field choose its index; ``{...}`` is JSON."""
    text = text.strip()
    if text.startswith("{"):
        return from_json(json.loads(text))
    found = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, colon, values = part.partition(":")
        if not colon:
            raise ValueError(f"no colon in {part!r}")
        kind = _KINDS.get(name[:1], "primary")
        found.append(FieldFilter(name.lstrip("~^%").strip(), tuple(parse_parts(v) for v in values.split("|") if v.strip()), kind))
    return Filter("and", tuple(found)) if found else NO_FILTER


def parse_parts(text: str) -> tuple[str, ...]:
    """``a+b+c`` as parts of a value."""
    return tuple(x.strip() for x in text.split("+"))


def from_json(d: dict) -> Filter:
    fields = tuple(FieldFilter(x["fieldName"], tuple(tuple(v["parts"] if isinstance(v, dict) else [v]) for v in x.get("values", ())), x.get("fieldType", "primary")) for x in d.get("fieldFilters") or ())
    return Filter(d["operation"], fields, tuple(from_json(x) for x in d.get("subFilters") or ()), bool(d.get("inclusiveFilter")))


def to_json(flt: Filter) -> dict:
    return {
        "operation": flt.op, "inclusiveFilter": flt.inclusive,
        "fieldFilters": [{"fieldName": x.field, "fieldType": x.kind, "values": [{"parts": list(v)} for v in x.values]} for x in flt.fields],
        "subFilters": [to_json(x) for x in flt.subs],
    }


# -- query strings ----------------------------------------------------------

_TOKEN = re.compile(r'\s*(\(|\)|[^\s()]+)')


class QueryError(ValueError):
    """The query string says something that cannot be asked."""


class _Parser:
    """Terms, ``field:term``, ``prefix*``, AND (also between neighbours), OR, NOT, + and -, parentheses."""

    def __init__(self, text: str, default: str, analyse):
        self.tokens = _TOKEN.findall(text)
        if "".join(self.tokens) != re.sub(r"\s", "", text):
            raise QueryError(text)
        self.at, self.default, self.analyse = 0, default, analyse

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def clauses(self, field: str) -> Filter:
        """One level: clauses with an occurrence each, wrapped when all are known."""
        found: list[list] = []  # [occurrence, filter]
        joined, negated = "and", False
        while (t := self.peek()) is not None and t != ")":
            if t in ("AND", "&&", "OR", "||"):
                joined = "and" if t in ("AND", "&&") else "or"
                if not found or negated:
                    raise QueryError(f"{t} has nothing before it")
                self.at += 1
                continue
            if t in ("NOT", "!"):
                negated, self.at = True, self.at + 1
                continue
            own, occurrence = self.clause(field)
            if joined == "or":
                if found and found[-1][0] == "must":
                    found[-1][0] = "should"
                occurrence = occurrence or ("not" if negated else "should")
            else:
                occurrence = occurrence or ("not" if negated else "must")
            if own is not None:
                found.append([occurrence, own])
            joined, negated = "and", False
        if negated or joined == "or":
            raise QueryError("an operator ends the query")
        return _wrap(found)

    def clause(self, field: str):
        t = self.tokens[self.at]
        self.at += 1
        occurrence = None
        if len(t) > 1 and t[0] in "+-":
            occurrence, t = ("must" if t[0] == "+" else "not"), t[1:]
        name, colon, rest = t.partition(":")
        if colon and name:
            field, t = name, rest
            if not t and self.peek() == "(":
                self.at += 1
                t = "("
        if t == "(":
            inner = self.clauses(field)
            if self.peek() != ")":
                raise QueryError("a parenthesis stays open")
            self.at += 1
            return inner, occurrence
        if not t or t == ")" or t[0] in '"[{/' or any(x in t for x in "~^?") or "*" in t[:-1] or t == "*":
            raise QueryError(f"{t!r} is neither a term nor a prefix")
        if t.endswith("*"):
            return FieldFilter(field, ((t[:-1].lower(), "*"),)), occurrence
        words = self.analyse(t)
        if not words:
            return None, occurrence
        if len(words) > 1:
            raise QueryError(f"{t!r} is a phrase")
        return FieldFilter(field, ((words[0],),)), occurrence


def _wrap(found: list[list]) -> Filter:
    must, should, never = ([x for o, x in found if o == k] for k in ("must", "should", "not"))
    want = [_one("and", [*must, _one("or", should)] if should else must)] if must else [_one("or", should)] if should else []
    if never:
        return _ordered("pButNotQ", [*want, *never], not want)
    if not want:
        raise QueryError("nothing is asked for")
    return want[0]


def _one(op: str, parts: list) -> Filter:
    return _ordered(op, parts, False)


def _ordered(op: str, parts: list, inclusive: bool) -> Filter:
    """Field filters come before sub-filters in a filter, so where order counts each part is a sub-filter."""
    if op == "pButNotQ":
        parts = [Filter("or", (p,)) if isinstance(p, FieldFilter) else p for p in parts]
    return _of(op, parts, inclusive)


def parse_query(text: str, default: str, analyse=lambda t: [t.lower()]) -> Filter:
    """A query string as a filter; phrases, ranges, fuzzy terms and inner wildcards raise."""
    p = _Parser(text, default, analyse)
    out = p.clauses(default)
    if p.peek() is not None:
        raise QueryError("a parenthesis too many")
    return out
