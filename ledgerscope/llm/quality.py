"""Quality rules, line first: bad lines go, and a document that loses too much text goes with them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import ship, with_columns

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture and licence notices, in English.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under",
    "log in", "lorem ipsum", "privacy policy", "sign up", "skip to content", "subscribe to our", "terms of service",
    "terms of use", "use cookies",
)
_TERMINAL = re.compile(r"[.!?…。！？;:][\"'”’»)\]]*(?=\s|$)")
_SEPARATOR = re.compile(r"(?:^|\s)[|>»›•·/\\-]+(?=\s|$)")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_chars long, clean_text string"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    boilerplate_chars: int = 400  #: a line with a phrase for each so many characters is boilerplate; text that mentions one is not
    min_words: int = 8  #: shorter lines are judged by the boilerplate and navigation rules alone
    max_symbol_words: float = 0.2  #: share of words that hold one of SYMBOLS
    max_shouted: float = 0.6  #: share of capitals among the letters
    max_exclaimed: float = 0.3  #: exclamation marks per word
    max_separators: float = 0.15  #: stand-alone separators per word, from three on
    min_distinct: float = 0.2  #: share of different words
    max_lost: float = 0.5  #: share of the word characters a kept document may lose


def line_fails(line: str, rules: LineRules) -> bool:
    """Whether one line fails the punctuation, navigation or boilerplate rules; blank lines pass."""
    words = line.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return False
    if len(_BOILERPLATE.findall(line)) * rules.boilerplate_chars > len(line):
        return True
    bars = len(_SEPARATOR.findall(line))
    if bars >= 3 and bars > rules.max_separators * n:
        return True
    if n < rules.min_words:
        return False
    if not _TERMINAL.search(line):
        return True
    if line.count("!") > rules.max_exclaimed * n:
        return True
    if any(s in line for s in SYMBOLS) and sum(any(s in w for s in b"#*$%&|<>") for w in words) > rules.max_symbol_words * n:
        return True
    capitals = sum(map(str.isupper, line))
    if capitals > 2 * n and capitals > rules.max_shouted * sum(map(str.isalpha, line)):
        return True
    return n >= 20 and len(set(words)) < rules.min_distinct * n


def repeated_words(words: list, size: int = 8) -> int:
    """Words covered by windows of ``size`` (a power of two) words that occur twice or more.

    Windows are compared exactly, by doubling: ids of pairs, of pairs of pairs, and so on.
    """
    n = len(words)
    if n <= size:
        return 0
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if len(first) == n:
        return 0
    step = 1
    while step < size:
        uniq, ids = np.unique(ids[:-step] * n + ids[step:], return_inverse=True)
        if len(uniq) == len(ids):
            return 0
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(ids)] += twice
    edge[size : size + len(ids)] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def figures(text: str | None, rules: LineRules, with_text: bool) -> tuple:
    """The figures of one whole text, in the order of FIGURES."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, WHITE))
    seen: set[str] = set()
    dup = lost = 0
    clean = []
    for line in text.split("\n"):
        if not line.strip(WHITE):
            clean.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, rules):
            lost += len(line) - sum(map(line.count, WHITE))
        else:
            clean.append(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lost, "\n".join(clean) if with_text else None


def score_quality(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """``docs`` with the base figures, ``clean_text`` (failing lines removed), ``base_failed`` and ``kept``.

    Words are runs of characters other than space and ``\\t\\n\\v\\f\\r``. A document fails the base
    rule with fewer than 20 words or over 30 % of its words inside repeated 8-word windows; it is
    kept if it passes that and loses at most ``rules.max_lost`` of its word characters to the line
    rules. A null or empty text has no words, so it fails the base rule. Rows are independent:
    repeated rows get equal results, an empty table an empty one. Columns of ``docs`` that bear a
    result's name are replaced.
    """

    @F.pandas_udf(FIGURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FIGURES.split(", ")]
        for texts in batches:
            yield pd.DataFrame([figures(t, rules, with_text) for t in texts], columns=names)

    ship(docs.sparkSession)
    base = with_columns(docs, {"__q": measured(F.col(f"`{text_col}`"))})
    out = {x.split()[0]: F.col(f"__q.{x.split()[0]}") for x in FIGURES.split(", ")}
    failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    verdict = ~failed & (out["lost_chars"] <= rules.max_lost * out["word_chars"])
    return with_columns(base, out | {"base_failed": failed, "kept": verdict}).drop("__q")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, with failing lines removed, in the columns of ``docs``."""
    scored = score_quality(docs, rules=rules).where("kept")
    return with_columns(scored, {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}).select(docs.columns)
