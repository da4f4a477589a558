"""Query language: a tree of terms, phrases, patterns and Boolean groups, its parser and its rewrites. Runs on the driver; no data is touched."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..functions.text import fold_str

DEFAULT_FIELD = "text"
#: Scores of an exact phrase and the slop of its loose form in the automatic expansion.
PHRASE_BOOST, PHRASE_SLOP = 2.0, 3
#: Prefixes of at least so many characters are scored term by term, over so many terms of the dictionary.
SCORED_PREFIX, PREFIX_TERMS = 4, 50


@dataclass(frozen=True)
class Node:
    boost: float = 1.0


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    field: str = DEFAULT_FIELD
    text: str = ""


@dataclass(frozen=True)
class Phrase(Node):
    field: str = DEFAULT_FIELD
    terms: tuple[str, ...] = ()
    slop: int = 0


@dataclass(frozen=True)
class Prefix(Node):
    field: str = DEFAULT_FIELD
    text: str = ""
    scored: bool = False


@dataclass(frozen=True)
class Wildcard(Node):
    field: str = DEFAULT_FIELD
    pattern: str = ""


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str = DEFAULT_FIELD
    text: str = ""
    edits: int = 2


@dataclass(frozen=True)
class Range(Node):
    field: str = DEFAULT_FIELD
    low: str | None = None
    high: str | None = None
    closed: tuple[bool, bool] = (True, True)


@dataclass(frozen=True)
class Bool(Node):
    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()


_LEX = re.compile(
    r"""\s*(?:
      (?P<open>\() | (?P<close>\)) | (?P<sign>[+\-!](?=\S)) | (?P<op>&&|\|\||\b(?:AND|OR|NOT)\b(?=\s|\(|$)) |
      (?P<field>[A-Za-z_][\w.]*):(?=\S) | "(?P<phrase>(?:[^"\\]|\\.)*)" |
      (?P<range>[\[{]\s*\S+\s+TO\s+\S+?\s*[\]}]) | (?P<word>(?:\\.|[^\s()":^~\[\]{}])+)
    )(?P<tail>(?:~\d*\.?\d*)?(?:\^\d+(?:\.\d+)?)?)""",
    re.X,
)
_TOKEN = re.compile(r"[^\W_]+")


def analyse(text: str) -> list[str]:
    """Tokens of query text: as the index folds and splits it."""
    return _TOKEN.findall(fold_str(text))


class ParseError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise ParseError(f"Cannot parse query at '{text[at:]}'")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def kind(self) -> str:
        return "" if self.at >= len(self.tokens) else next(k for k, v in self.tokens[self.at].groupdict().items() if v is not None and k != "tail")

    def group(self, field: str, nested: bool) -> Node:
        """Clauses joined by OR unless AND, + or - says otherwise."""
        clauses: list[list] = []  # [occurrence, node]
        joined = ""
        while self.kind() and not (nested and self.kind() == "close"):
            if self.kind() == "close":
                raise ParseError("Unbalanced )")
            sign = ""
            while self.kind() in ("op", "sign"):
                x = self.tokens[self.at][self.kind()]
                self.at += 1
                if x in ("AND", "&&"):
                    joined = "and"
                elif x in ("OR", "||"):
                    joined = "or"
                elif x in ("NOT", "!", "-"):
                    sign = "not"
                else:
                    sign = "must"
            if not self.kind() or self.kind() == "close":
                break
            node = self.clause(field)
            if joined == "and" and clauses and clauses[-1][0] == "should":
                clauses[-1][0] = "must"
            if node is not None:
                clauses.append(["must_not" if sign == "not" else "must" if sign == "must" or joined == "and" else "should", node])
            joined = ""
        pick = lambda kind: tuple(n for k, n in clauses if k == kind)
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        return Bool(must=pick("must"), should=pick("should"), must_not=pick("must_not"))

    def clause(self, field: str) -> Node | None:
        m, kind = self.tokens[self.at], self.kind()
        self.at += 1
        if kind == "field":
            if not self.kind():
                raise ParseError("A field name needs a value")
            return self.clause(m["field"])
        tail = m["tail"] or ""
        boost = float(tail.split("^")[1]) if "^" in tail else 1.0
        tilde = tail.split("^")[0][1:] if tail.startswith("~") else None
        if kind == "open":
            node = self.group(field, True)
            if self.kind() != "close":
                raise ParseError("Missing )")
            tail = self.tokens[self.at]["tail"] or ""
            self.at += 1
            return replace(node, boost=node.boost * (float(tail.split("^")[1]) if "^" in tail else 1.0))
        if kind == "phrase":
            terms = tuple(analyse(re.sub(r"\\(.)", r"\1", m["phrase"])))
            if not terms:
                return None
            return Term(boost, field, terms[0]) if len(terms) == 1 else Phrase(boost, field, terms, int(float(tilde or 0)))
        if kind == "range":
            low, high = re.split(r"\s+TO\s+", m["range"][1:-1].strip())
            return Range(boost, field, None if low == "*" else low, None if high == "*" else high, (m["range"][0] == "[", m["range"][-1] == "]"))
        word = m["word"]
        if word == "*":
            return MatchAll(boost)
        bare = re.sub(r"\\(.)", r"\1", word)
        if re.search(r"(?<!\\)[*?]", word):
            pattern = fold_str(word)
            if re.fullmatch(r"[^*?]+\*", pattern):
                return Prefix(boost, field, pattern[:-1])
            return Wildcard(boost, field, pattern)
        if tilde is not None:
            return Fuzzy(boost, field, fold_str(bare), min(2, int(float(tilde))) if tilde else 2)
        terms = tuple(analyse(bare))
        if not terms:
            return None
        return Term(boost, field, terms[0]) if len(terms) == 1 else Phrase(boost, field, terms, 0)


def parse(text: str | None, simple: bool = False) -> Node:
    """The tree of a query. `simple` takes every character literally: its words are joined by OR. Null, blank and * match all."""
    if text is None or not text.strip() or text.strip() == "*":
        return MatchAll()
    if simple:
        words = tuple(Term(text=w) for w in analyse(text))
        return words[0] if len(words) == 1 else Bool(should=words)
    return _Parser(text).group(DEFAULT_FIELD, False)


def rewrite(node: Node) -> Node:
    """Exact phrases also match loosely, at a lower score; long prefixes are scored by their terms. Descends into groups."""
    if isinstance(node, Bool):
        return replace(node, must=tuple(map(rewrite, node.must)), should=tuple(map(rewrite, node.should)), must_not=tuple(map(rewrite, node.must_not)))
    if isinstance(node, Phrase) and node.slop == 0 and len(node.terms) > 1:
        return Bool(node.boost, should=(replace(node, boost=PHRASE_BOOST), replace(node, boost=1.0, slop=PHRASE_SLOP)))
    if isinstance(node, Prefix):
        return replace(node, scored=len(node.text) >= SCORED_PREFIX)
    return node


def query_terms(node: Node) -> list[str]:
    """Plain terms of a tree in order, without those it excludes."""
    if isinstance(node, Bool):
        return list(dict.fromkeys(t for n in (*node.must, *node.should) for t in query_terms(n)))
    if isinstance(node, Phrase):
        return list(dict.fromkeys(node.terms))
    return [t for t in [getattr(node, "text", "")] if t]


def to_field(node: Node, field: str, change=lambda t: t) -> Node:
    """The same tree over another field, with each term changed; clauses of other fields stay."""
    if isinstance(node, Bool):
        f = lambda xs: tuple(to_field(x, field, change) for x in xs)
        return replace(node, must=f(node.must), should=f(node.should), must_not=f(node.must_not))
    if getattr(node, "field", None) != DEFAULT_FIELD or isinstance(node, Range):
        return node
    if isinstance(node, Phrase):
        return replace(node, field=field, terms=tuple(map(change, node.terms)))
    if isinstance(node, Term):
        return replace(node, field=field, text=change(node.text))
    return replace(node, field=field)


def like_regex(pattern: str) -> str:
    """Regular expression of a wildcard pattern: * any run, ? one character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
