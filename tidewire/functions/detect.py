"""The mention detector: an article's body mentions minors if any of a list of patterns matches its folded text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NO, YES
from .text import fold_ascii

#: Fixed values, in the order of the published behaviour. The text is folded to ASCII before, so that the third pattern
#: can't match the letter it holds; FIXED_KEYWORDS mends that.
KEYWORDS = [
    r"\bhij[oa]s?\b",
    r"\bmenor(?:es)?(?:\s+de\s+edad)?\b",
    r"\bniñ?[oa]s?\b",
    r"\badolescentes?\b",
    r"\bhu(erf|erf)an[oa]s?\b",
    r"\binfant(e|il|es)\b",
    r"\bbebes?\b",
    r"\breci[e|e]n\s+nacid[oa]s?\b",
    r"\bNNA\b",
]
AGES = [
    r"\b\d{1,2}\s*(anos|mes(?:es)?)\b",
    r"\bde\s+\d{1,2}\s*(anos|mes(?:es)?)\b",
]
PATTERNS = KEYWORDS + AGES
FIXED_KEYWORDS = [r"\bnin[oa]s?\b" if "ñ" in p else p for p in KEYWORDS]


def alternation(patterns: list[str]) -> str:
    """One pattern for all, for folded text: it is scanned once, and the word boundary that all begin with is tested
    once at a place; a pattern with capitals ignores case, the others meet small letters only."""
    bodies = [p.removeprefix(r"\b") for p in patterns]
    return r"\b(?:" + "|".join(f"(?i:{b})" if re.search(r"(?<!\\)[A-Z]", b) else b for b in bodies) + ")"


def mentions(c: Column | str, compat: bool = True, exact: bool = False) -> Column:
    """Whether any pattern matches; false for null."""
    patterns = (KEYWORDS if compat else FIXED_KEYWORDS) + AGES
    return fold_ascii(c, exact).rlike(alternation(patterns))


def detect(c: Column | str, compat: bool = True, exact: bool = False) -> Column:
    """'Si' or 'No'."""
    return F.when(mentions(c, compat, exact), YES).otherwise(NO)


def each_pattern(c: Column | str) -> list[Column]:
    """A boolean for each pattern, named p0 to p10."""
    folded = fold_ascii(c)
    return [folded.rlike(f"(?i){p}").alias(f"p{k}") for k, p in enumerate(PATTERNS)]
