"""Builders for filters, and their text form."""

from __future__ import annotations

from .ast import All, And, Cmp, Contains, HasWord, Literal, Ne, Node, Not, Or, TokenPrefix

match_all = All()


def eq(field: str, value: Literal) -> Node:
    return Cmp("=", field, value)


def lt(field: str, value: Literal) -> Node:
    return Cmp("<", field, value)


def gt(field: str, value: Literal) -> Node:
    return Cmp(">", field, value)


def le(field: str, value: Literal) -> Node:
    return Cmp("<=", field, value)


def ge(field: str, value: Literal) -> Node:
    return Cmp(">=", field, value)


def starts_with(field: str, prefix: str) -> Node:
    return TokenPrefix(field, prefix, "starts-with")


def has_word(field: str, word: str) -> Node:
    return HasWord(field, word)


def has_word_starting_with(field: str, prefix: str) -> Node:
    return TokenPrefix(field, prefix)


#: An item of a collection is looked for as any value is.
has_item = eq


def and_(*args: Node) -> Node:
    return And(args)


def or_(*args: Node) -> Node:
    return Or(args)


def not_(*args: Node) -> Node:
    return Not(args)


def ne(field: str, value: Literal) -> Node:
    return Ne(field, value)


def contains(field: str, part: str) -> Node:
    return Contains(field, part)


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _field(name: str) -> str:
    plain = name.startswith(":") and len(name) > 1 and not set(name[1:]) & set(' \t\r\n\x0b\x0c()"')
    return name if plain else _quote(name)


def to_text(node: Node) -> str:
    """Text that parses to the same tree."""
    match node:
        case All():
            return "*"
        case Cmp(op, field, value):
            pass
        case Ne(field, value):
            op = "not="
        case Contains(field, value):
            op = "contains"
        case HasWord(field, value):
            op = "has-word"
        case TokenPrefix(field, value, op):
            pass
        case And(args) | Or(args) | Not(args):
            return "(" + " ".join([type(node).__name__.lower(), *map(to_text, args)]) + ")"
        case _:
            raise TypeError(f"not a filter: {node!r}")
    return f"({op} {_field(field)} {_quote(value) if isinstance(value, str) else value})"
