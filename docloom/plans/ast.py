"""Syntax tree of the filter language."""

from __future__ import annotations

from dataclasses import dataclass

Literal = str | int | float


class Node:
    """A filter."""


@dataclass(frozen=True)
class All(Node):
    pass


@dataclass(frozen=True)
class Cmp(Node):
    """``op`` is one of = < > <= >=; all but = take numbers only."""

    op: str
    field: str
    value: Literal


@dataclass(frozen=True)
class TokenPrefix(Node):
    """Some token of the field's text begins with ``prefix``. ``op`` keeps the spelling that was used."""

    field: str
    prefix: str
    op: str = "has-word-starting-with"


@dataclass(frozen=True)
class HasWord(Node):
    field: str
    word: str


@dataclass(frozen=True)
class And(Node):
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    """Whatever none of the arguments matches, be the field there or not."""

    args: tuple[Node, ...]


@dataclass(frozen=True)
class Ne(Node):
    """Extension: the field isn't equal to the value, or isn't there."""

    field: str
    value: Literal


@dataclass(frozen=True)
class Contains(Node):
    """Extension: the field's text has ``part`` in it."""

    field: str
    part: str
