"""Ordered, guarded rules over a text, compiled to one column expression.

A rule table is a list of Swap, First and Stop. Swap replaces what a pattern finds, if its guards hold. First applies the first of
some swaps whose guards hold. Stop ends the table for texts that its guards accept, with what its own rules make of them. A text that
is looked at twice, by a guard and by what follows, is bound by a lambda over one element, so the expression stays as long as the table.

Patterns are Java's. Guards are patterns that must be found, or functions of the text's column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

Guard = str | Callable[[Column], Column]


@dataclass(frozen=True)
class Swap:
    pattern: str
    put: str = ""
    when: tuple[Guard, ...] = ()
    unless: tuple[Guard, ...] = ()


@dataclass(frozen=True)
class First:
    swaps: tuple[Swap, ...]


@dataclass(frozen=True)
class Stop:
    #: One of these must hold.
    when: tuple[Guard, ...]
    unless: tuple[Guard, ...] = ()
    rules: tuple = ()


Rule = Swap | First | Stop


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _holds(guard: Guard, text: Column) -> Column:
    return text.rlike(guard) if isinstance(guard, str) else guard(text)


def _all(rule: Swap | Stop, text: Column, any_of: bool) -> Column:
    out = None
    for g in rule.when:
        one = _holds(g, text)
        out = one if out is None else (out | one if any_of else out & one)
    for g in rule.unless:
        one = ~_holds(g, text)
        out = one if out is None else out & one
    return F.lit(True) if out is None else out


def apply(rules: Sequence[Rule], text: Column) -> Column:
    """The text after the rules, in their order. Null stays null."""
    for k, rule in enumerate(rules):
        if isinstance(rule, Swap) and not rule.when and not rule.unless:
            text = F.regexp_replace(text, rule.pattern, F.lit(rule.put))
        elif isinstance(rule, Swap):
            text = _guarded(rule, text)
        elif isinstance(rule, First):
            text = _first(rule, text)
        else:
            return _stopping(rule, rules[k + 1 :], text)
    return text


def _guarded(rule: Swap, text: Column) -> Column:
    return bound(text, lambda t: F.when(_all(rule, t, False), F.regexp_replace(t, rule.pattern, F.lit(rule.put))).otherwise(t))


def _first(rule: First, text: Column) -> Column:
    def chosen(t: Column) -> Column:
        out = t
        for swap in reversed(rule.swaps):
            out = F.when(_all(swap, t, False), F.regexp_replace(t, swap.pattern, F.lit(swap.put))).otherwise(out)
        return out

    return bound(text, chosen)


def _stopping(rule: Stop, rest: Sequence[Rule], text: Column) -> Column:
    return bound(text, lambda t: F.when(_all(rule, t, True), apply(rule.rules, t)).otherwise(apply(rest, t)))
