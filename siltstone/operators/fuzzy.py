"""Approximate substring match of titles, by the difflib ratio over windows of the needle's length.

Distinct titles are scored once, in an Arrow batch; titles that contain the
needle exactly are told in the JVM and never reach Python.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import fold, fold_text
from siltstone.operators.fields import BadConfig, FieldDef, FieldType
from siltstone.operators.filters import Contains, many

THRESHOLD = 0.82


def plain(s: str) -> str:
    """Without accents, case-folded."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").casefold()


def best_ratio(text: str, needle: str) -> float:
    """The best similarity of the needle to a window of its length; of both whole where the text isn't longer."""
    n = len(needle)
    if not n:
        return 0.0
    if len(text) <= n:
        return SequenceMatcher(None, needle, text).ratio()
    if needle in text:
        return 1.0
    compare = SequenceMatcher(None, needle)
    windows = dict.fromkeys(text[i : i + n] for i in range(len(text) - n + 1))

    def score(window: str) -> float:
        compare.set_seq2(window)
        return compare.ratio()

    return max(map(score, windows))


class FuzzyContains(Contains):
    threshold = THRESHOLD

    def __init__(self, field: FieldDef, threshold: float | None = None):
        super().__init__(field)
        if field.type is not FieldType.STRING:
            raise BadConfig(f"{field.name}: fuzzy match is for strings")
        self.threshold = self.threshold if threshold is None else threshold
        if not 0 < self.threshold <= 1:
            raise BadConfig("the threshold lies in (0, 1]")

    def predicate(self, params) -> Column | None:
        needles = [plain(str(v)) for v in many(params) if str(v)]
        if not needles:
            return None
        threshold = self.threshold
        raw = [fold_text(str(v)) for v in many(params) if str(v)]

        @F.pandas_udf("boolean")
        def similar(titles: pd.Series) -> pd.Series:
            known = {t: any(best_ratio(plain(t), n) >= threshold for n in needles) for t in titles.dropna().unique()}
            return titles.map(known).fillna(False).astype(bool)

        c = F.col(self.field.name).cast("string")
        exact = reduce(or_, [F.contains(fold(c), F.lit(r)) for r in raw if plain(r)] or [F.lit(False)])
        # the case is tried first, so Python sees only what is not decided
        return F.when(c.isNull(), False).when(exact, True).otherwise(similar(F.when(~exact, c)))


def fuzzy_titles(docs: DataFrame, column: str, needles: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """docs whose title is similar to a needle; each distinct title is scored once and joined back."""
    field = FieldDef(column, FieldType.STRING)
    test = FuzzyContains(field, threshold).predicate(needles)
    if test is None:
        return docs
    return docs.join(docs.select(column).distinct().where(test), column, "left_semi").select(*docs.columns)
