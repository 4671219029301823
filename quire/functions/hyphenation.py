"""Hyphenation by patterns, and whether a hyphen at a line's end belongs to the word.

A pattern is letters with scores between them; every pattern that occurs in a word, dots
marking its ends, raises the slots it covers, and odd slots may break.
"""

from __future__ import annotations

import re
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Patterns:
    """A pattern set: ``patterns`` like ``1ba`` or ``.af1t``, ``exceptions`` like ``ta-ble``."""

    def __init__(self, patterns: list[str], exceptions: list[str] = (), left: int = 2, right: int = 3) -> None:
        self.left, self.right = left, right
        self.scores = {re.sub(r"\d", "", p): [int(d) if d else 0 for d in re.split(r"[^\d]", p)] for p in patterns}
        self.exceptions = {e.replace("-", ""): [i for i, _ in self._breaks(e)] for e in exceptions}

    @staticmethod
    def _breaks(word: str):
        at = 0
        for c in word:
            if c == "-":
                yield at, c
            else:
                at += 1

    @classmethod
    def parse(cls, tex: str) -> Patterns:
        r"""The groups ``\patterns{}`` and ``\hyphenation{}`` of a TeX file, comments left out."""
        tex = re.sub(r"%.*", "", tex)
        words = lambda name: " ".join(re.findall(rf"\\{name}\{{([^}}]*)\}}", tex)).split()
        return cls(words("patterns"), words("hyphenation"))

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.scores), default=0)

    def breaks(self, word: str) -> list[int]:
        """Letters before each legal break."""
        word = word.lower()
        if word in self.exceptions:
            found = self.exceptions[word]
        else:
            dotted = f".{word}."
            slots = [0] * (len(dotted) + 1)
            for i in range(len(dotted)):
                for j in range(i + 1, min(len(dotted), i + self.longest) + 1):
                    for k, s in enumerate(self.scores.get(dotted[i:j], ())):
                        slots[i + k] = max(slots[i + k], s)
            found = [i for i in range(1, len(word)) if slots[i + 1] % 2]
        return [i for i in found if self.left <= i <= len(word) - self.right]

    def decision(self, before: str, after: str) -> str:
        """Why a line-end hyphen stays (``keep``) or goes (``drop``), first rule that holds."""
        if not before or not after:
            return "keep: empty fragment"
        if before[0].isupper() and after[0].isupper():
            return "keep: both capitalised"
        if before[-1].isdigit() or after[0].isdigit():
            return "keep: digit at the edge"
        if not after[0].islower():
            return "keep: continuation not lowercase"
        if not (before.isalpha() and after.isalpha()):
            return "keep: not all letters"
        return "drop: patterns permit" if len(before) in self.breaks(before + after) else "keep: patterns forbid"


def hyphen_decisions(before: Column, after: Column, patterns: Patterns) -> Column:
    """The decision for each row; a word that follows no pattern set keeps its hyphen."""

    @F.pandas_udf("string")
    def decide(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else patterns.decision(x, y) for x, y in zip(a, b, strict=True)])

    return decide(before, after)
