"""Boolean text rules as a tree that turns into one Column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import as_col, fold, fold_text
from siltstone.operators.fields import BadQuery


class Rule(Protocol):
    def column(self, text: Column, fold_case: bool) -> Column:
        """Does the text satisfy the rule? With ``fold_case`` the text is folded already, and terms have to be."""
        ...


@dataclass(frozen=True)
class Term:
    text: str

    def __post_init__(self):
        if not self.text.strip():
            raise BadQuery("a term is blank")

    def column(self, text, fold_case):
        return F.contains(text, F.lit(fold_text(self.text) if fold_case else self.text))


@dataclass(frozen=True)
class _Join:
    parts: tuple

    def __post_init__(self):
        if not self.parts:
            raise BadQuery("a group of rules is empty")


class And(_Join):
    def column(self, text, fold_case):
        return reduce(and_, [p.column(text, fold_case) for p in self.parts])


class Or(_Join):
    def column(self, text, fold_case):
        return reduce(or_, [p.column(text, fold_case) for p in self.parts])


@dataclass(frozen=True)
class MatchAll:
    def column(self, text, fold_case):
        return F.lit(True)


@dataclass(frozen=True)
class LexicalQuery:
    """first_of: any of these terms. mandatories: all of these, or, as a list of lists, all of one group."""

    first_of: tuple[str, ...] = ()
    mandatories: tuple = ()
    case_sensitive: bool = False

    def rule(self) -> Rule:
        parts: list[Rule] = []
        if self.mandatories:
            grouped = [isinstance(m, (list, tuple)) for m in self.mandatories]
            if all(grouped):
                parts.append(Or(tuple(And(tuple(Term(t) for t in group)) for group in self.mandatories)))
            elif any(grouped):
                raise BadQuery("mandatories are all terms or all groups")
            else:
                parts.append(And(tuple(Term(t) for t in self.mandatories)))
        if self.first_of:
            parts.append(Or(tuple(Term(t) for t in self.first_of)))
        return MatchAll() if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))

    def column(self, text: Column | str = "text") -> Column:
        rule = self.rule()
        if self.case_sensitive or isinstance(rule, MatchAll):
            return rule.column(as_col(text), False)
        # one element, so that the text is folded once for all terms
        return F.exists(F.array(fold(text)), lambda folded: rule.column(folded, True))


def lexical_hits(docs: DataFrame, query: LexicalQuery, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id of each match; unordered, as the ranking orders by id anyway."""
    return docs.where(query.column(text_col)).select(F.col(id_col).alias("id"))
