"""The grammar of full-text queries and its compilation to column expressions.

    query := or        or := and ("OR" and)*        and := not (("AND")? not)*
    not := "NOT" not | atom                          atom := "phrase" | ( query ) | word

Operators are case-insensitive.  Words without any operator or quote are
alternatives; beside operators, neighbouring words must all occur.  Operators
that have nothing to stand for are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.errors import InvalidQueryError

_PIECE = re.compile(r'"((?:\\.|[^"\\])*)"?|([()])|([^\s()"]+)')
_HAN = re.compile(r"[\u3400-\u9fff]+|[^\W\u3400-\u9fff]+")
OPERATORS = ("AND", "OR", "NOT")


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # several words are a phrase
    prefix: bool = False


@dataclass(frozen=True)
class Not:
    part: Node


@dataclass(frozen=True)
class All:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Node, ...]


Node = Term | Not | All | Any


def analyse(text: str) -> list[str]:
    """The words of a text as the index has them: lower-case runs of letters and digits, Han as pairs of characters."""
    out = []
    for run in _HAN.findall(text):
        if "\u3400" <= run[0] <= "\u9fff":
            out += [run] if len(run) < 3 else [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run.lower())
    return out


def validate(query: str | None, least: int = 2, most: int = 1000) -> str:
    """The stripped query; too short or long ones raise."""
    text = (query or "").strip()
    if not text:
        raise InvalidQueryError("query is empty")
    if not least <= len(text) <= most:
        raise InvalidQueryError(f"query has {len(text)} characters; {least} to {most} are allowed")
    return text


def summary(query: str | None) -> dict:
    """What a query is made of: its pieces, phrases and whether it has operators."""
    text = query or ""
    pieces = _pieces(text)
    return {
        "original": query,
        "tokens": [p for p in pieces if p[0] != "phrase"] and [v for k, v in pieces if k != "phrase"],
        "phrases": [v for k, v in pieces if k == "phrase"],
        "has_boolean": any(k == "operator" for k, _ in pieces),
        "has_phrases": any(k == "phrase" for k, _ in pieces),
    }


def relax(query: str) -> str:
    """The query without quotes, operators and parentheses."""
    bare = re.sub(r'["()]', " ", query)
    return " ".join(w for w in bare.split() if w.upper() not in OPERATORS)


def _pieces(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _PIECE.finditer(text):
        if m[1] is not None:
            out.append(("phrase", re.sub(r"\\(.)", r"\1", m[1])))
        elif m[2]:
            out.append(("bracket", m[2]))
        else:
            out.append(("operator", m[3].upper()) if m[3].upper() in OPERATORS else ("word", m[3]))
    return out


def parse(query: str) -> Node | None:
    """The tree of a query, None where nothing of it can be searched."""
    pieces = _pieces(query)
    if not any(kind in ("operator", "phrase", "bracket") for kind, _ in pieces):
        return _group(Any, [_term(word) for _, word in pieces])
    tree, rest = _or(pieces)
    while rest:  # a closing bracket without an opening one
        more, rest = _or(rest[1:])
        tree = _group(All, [tree, more])
    return tree


def _term(text: str) -> Node | None:
    prefix = text.endswith(":*")
    words = analyse(text.removesuffix(":*"))
    return Term(tuple(words), prefix) if words else None


def _group(kind: type, parts: list[Node | None]) -> Node | None:
    held = tuple(p for p in parts if p is not None)
    return held[0] if len(held) == 1 else kind(held) if held else None


def _or(pieces: list[tuple[str, str]]):
    parts, rest = [], pieces
    while True:
        part, rest = _and(rest)
        parts.append(part)
        if rest and rest[0] == ("operator", "OR"):
            rest = rest[1:]
            continue
        return _group(Any, parts), rest


def _and(pieces: list[tuple[str, str]]):
    parts, rest = [], pieces
    while rest and rest[0] not in (("operator", "OR"), ("bracket", ")")):
        if rest[0] == ("operator", "AND"):
            rest = rest[1:]
            continue
        part, rest = _not(rest)
        parts.append(part)
    return _group(All, parts), rest


def _not(pieces: list[tuple[str, str]]):
    (kind, value), rest = pieces[0], pieces[1:]
    if (kind, value) == ("operator", "NOT"):
        if not rest or rest[0] in (("operator", "OR"), ("operator", "AND"), ("bracket", ")")):
            return None, rest
        part, rest = _not(rest)
        return (Not(part) if part else None), rest
    if (kind, value) == ("bracket", "("):
        part, rest = _or(rest)
        return part, rest[1:] if rest else rest
    return _term(value), rest


def positive_words(tree: Node | None) -> list[str]:
    """Words that count for rank: those not under a NOT, each once, in order."""
    if tree is None or isinstance(tree, Not):
        return []
    if isinstance(tree, Term):
        return list(dict.fromkeys(tree.words))
    return list(dict.fromkeys(w for p in tree.parts for w in positive_words(p)))


def padded(words: list[str] | tuple[str, ...]) -> str:
    """Words as they stand in a padded text one after the other."""
    return "".join(f" {w} " for w in words)


def matches(tree: Node, *texts: Column) -> Column:
    """Whether padded texts fulfil the tree together; a phrase lies in one of them."""
    if isinstance(tree, Not):
        return ~matches(tree.part, *texts)
    if isinstance(tree, (All, Any)):
        parts = [matches(part, *texts) for part in tree.parts]
        return reduce(lambda a, b: a & b if isinstance(tree, All) else a | b, parts)
    wanted = F.lit(f" {tree.words[0]}" if tree.prefix else padded(tree.words))
    return reduce(lambda a, b: a | b, (F.contains(text, wanted) for text in texts))
