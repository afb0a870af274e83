"""Language identification, words first: known words by frequency, unseen words by character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, ship, with_columns

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    """Bounds of the fit and of the model, which is broadcast."""

    docs_per_lang: int = 5_000  #: labelled documents of each language that are learned from, about
    max_words: int = 200_000  #: known words, shared out evenly between the languages
    max_grams: int = 200_000  #: known n-grams of all lengths, shared out evenly between the languages
    longest: int = 5  #: characters of the longest n-grams, word ends included


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty if there is no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def grams_of(word: str, longest: int) -> Iterator[str]:
    marked = f"<{word}>"
    for at in range(len(marked)):
        for n in range(1, min(longest, len(marked) - at) + 1):
            yield marked[at : at + n]


def word_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over ``labelled(text, lang)``: counted in each task, then summed."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                seen.update((lang, w) for w in words_of(text))
                if len(seen) > 200_000:
                    yield _table(seen, "word")
                    seen.clear()
        yield _table(seen, "word")

    each = labelled.select("text", "lang").mapInPandas(counted, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(seen: Counter, name: str) -> pd.DataFrame:
    return pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["lang", name, "n"])


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """``(lang, gram, n)``: the n-grams of the counted words."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                for g in grams_of(word, longest):
                    seen[lang, g] += n
            yield _table(seen, "gram")

    return words.mapInPandas(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LangModel:
    """Log frequencies per language of known words and n-grams."""

    def __init__(self, langs: list[str], words: pd.DataFrame, grams: pd.DataFrame, totals: dict[str, int], p: LangParams):
        self.langs, self.p = langs, p
        at = {lang: k for k, lang in enumerate(langs)}
        sums = np.array([max(1, totals.get(lang, 0)) for lang in langs], float)
        self.words, self.word_logs = _logs(words, "word", at, sums)
        self.grams, self.gram_logs = {}, np.zeros((0, len(langs)))
        if len(grams):
            parts, size = [], 0
            for _, rows in grams.groupby(grams["gram"].str.len()):
                of_length = rows.groupby("lang")["n"].sum()
                index, logs = _logs(rows, "gram", at, np.array([max(1, of_length.get(lang, 1)) for lang in langs], float))
                self.grams |= {g: size + k for g, k in index.items()}
                parts.append(logs)
                size += len(logs)
            self.gram_logs = np.concatenate(parts)
        self.unseen: dict[str, list[int]] = {}

    def backed_off(self, word: str) -> list[int]:
        """Indexes of the longest known n-gram at each character of an unseen word.

        A cost for each step to a shorter n-gram would be the same in all languages, so there is none.
        """
        if (found := self.unseen.get(word)) is not None:
            return found
        marked, known = f"<{word}>", self.grams
        found = []
        for at in range(len(marked)):
            for end in range(min(at + self.p.longest, len(marked)), at, -1):
                if (k := known.get(marked[at:end])) is not None:
                    found.append(k)
                    break
        if len(self.unseen) > 100_000:
            self.unseen.clear()
        self.unseen[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counted = Counter(words_of(text))
        if not counted or not self.langs:
            return UNKNOWN, 0.0
        words, times, grams, shares = [], [], [], []
        for w, n in counted.items():
            if (k := self.words.get(w)) is not None:
                words.append(k)
                times.append(n)
            elif found := self.backed_off(w):
                grams += found
                shares += [n / len(found)] * len(found)
        total = np.zeros(len(self.langs))
        if words:
            total += np.array(times) @ self.word_logs[words]
        if grams:
            total += np.array(shares) @ self.gram_logs[grams]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _logs(rows: pd.DataFrame, name: str, at: dict[str, int], sums: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Index of the entries and their smoothed log frequencies per language."""
    index = {x: k for k, x in enumerate(rows[name].unique())}
    counts = np.full((len(index), len(at)), 0.5)
    for x, lang, n in zip(rows[name], rows["lang"], rows["n"]):
        counts[index[x], at[lang]] += n
    return index, np.log(counts / (sums + 0.5 * len(index)))


def fit(labelled: DataFrame, p: LangParams = LangParams()) -> LangModel:
    """A model of ``labelled(doc_id, text, lang)``; rows with a null lang or text are left out.

    Documents are sampled by a hash of their id, each language at its own rate, so that about
    ``docs_per_lang`` of each are learned from, whole texts. The number of different languages is
    taken to be small. Each has an equal share of the model's words and n-grams, so that a rarely
    labelled one is not crowded out.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    rates = {r["lang"]: min(1.0, p.docs_per_lang / r["n"]) for r in counted}
    langs = sorted(rates)
    if not langs:
        return LangModel([], pd.DataFrame({"lang": [], "word": [], "n": []}), pd.DataFrame({"lang": [], "gram": [], "n": []}), {}, p)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(0.0)) * 1_000_000
    words = materialize(word_counts(rows.where(drawn)), "lang-words")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    known = _most_frequent(words, "word", p.max_words // len(langs))
    grams = materialize(gram_counts(words, p.longest), "lang-grams")
    used = _most_frequent(grams, "gram", p.max_grams // len(langs))
    word_rows = words.join(known.select("word"), "word").select("lang", "word", "n").toPandas()
    gram_rows = grams.join(used.select("gram"), "gram").select("lang", "gram", "n").toPandas()
    return LangModel(langs, word_rows.sort_values(["word", "lang"]), gram_rows.sort_values(["gram", "lang"]), totals, p)


def _most_frequent(counted: DataFrame, name: str, share: int) -> DataFrame:
    """The ``share`` most frequent entries of each language that occur more than once in all."""
    often = counted.groupBy(name).agg(F.sum("n").alias("all")).where("all > 1").select(name)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
    return counted.join(often, name).withColumn("place", place).where(F.col("place") <= max(share, 1)).select(name).distinct()


def predict(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior of the language, 0 to 1), replacing columns of those names.

    A null text, one without a letter, or a model without languages gives ``und`` and score 0.
    Repeated rows get equal results; an empty table an empty one; texts are read whole.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = with_columns(docs, {"__l": scored(F.col(f"`{text_col}`"))})
    return with_columns(out, {"lang_pred": F.col("__l.lang_pred"), "score": F.col("__l.score")}).drop("__l")
