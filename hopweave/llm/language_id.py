"""Language identification, words first and character n-grams after.

Per language the model has the frequencies of words and of character n-grams of four
letters down to one. A known word is scored by its log frequency in each language. An
unseen word is scored at each of its letters by the longest known n-gram that starts
there. All scores are log posteriors over the languages under equal priors, so words
and n-grams of any length add up on one scale.

Learning reads text and language of the rows it is given, at most docs_per_language
documents of each language (chosen by a hash, in expectation). Counting is a map-side
count per task and one sum by key. What comes to the driver are `entries` entries, an
equal share for each language, its most frequent first; those that occur less than
min_count times are left out unless they are among the SURE first of their language. So
every language of the training rows is in the model, however rare it is.

Defined cases: null texts and texts without a letter give `und` and score 0, and digits,
fractions or other numerals are no letters; without any training row every text gives
`und`; ties go to the language that is first in alphabetical order; a text of any length
is scored whole; repeated rows give equal rows; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.llm.batches import map_arrow, map_documents, pieces, texts_of
from hopweave.llm.keeping import Rows
from hopweave.llm.labelled import remainder
from hopweave.llm.shared import written
from hopweave.llm.shipping import Shipped

UND = "und"
LONGEST = 4
DOCS_PER_LANGUAGE = 3000
MIN_COUNT, SURE = 3, 200
ENTRIES = 400_000
#: Languages up to which the table of their shares is broadcast; beyond, it is joined by a shuffle.
SENT = 50_000
#: Words whose scores a task keeps.
CACHE = 300_000
#: Words beyond which more words do not make a score more certain.
CERTAIN_WORDS = 30

_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case. The pattern's class has numerals that are no digits too (fractions, circled numbers)."""
    found = _runs(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def count_words(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, word, n: counted in each task, then summed."""

    def run(batches):
        import pyarrow as pa

        def packed(found):
            lang, word = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

        found: Counter = Counter()
        for b in batches:
            for part in pieces(b, 1):
                for lang, text in zip(part.column(0).to_pylist(), texts_of(part, 1), strict=True):
                    found.update((lang, w) for w in words_of(text))
                if len(found) > 500_000:
                    yield packed(found)
                    found = Counter()
        if found:
            yield packed(found)

    part = map_arrow(rows.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")), run, "lang string, word string, n long")
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_entries(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, kind (0: word, n: n-gram), entry, n: words are counted over all texts first, so the n-grams of a word are made once."""
    words = written(count_words(rows, lang_col, text_col), "words")
    word = F.concat(F.lit("^"), "word", F.lit("$"))
    ends = F.length(word)

    def of(k: int):
        return F.transform(F.sequence(F.lit(1), ends - (k - 1)), lambda i: F.struct(F.lit(k).alias("kind"), F.substr(word, i, F.lit(k)).alias("entry")))

    own = F.array(F.struct(F.lit(0).alias("kind"), F.col("word").alias("entry")))
    each = F.concat(own, *(F.when(ends >= k, of(k)).otherwise(F.array().cast("array<struct<kind:int,entry:string>>")) for k in range(1, LONGEST + 1)))
    return words.select("lang", "n", F.inline(each)).groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log posteriors of entries: one row of `scores` for each known word and n-gram."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.langs = sorted({c[0] for c in counts})
        column = {x: i for i, x in enumerate(self.langs)}
        self.row: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        n = sum(len({c[2] for c in counts if c[1] == k}) for k in range(LONGEST + 1))
        found, kind_of = np.zeros((n, len(self.langs))), np.zeros(n, int)
        at = 0
        for lang, kind, entry, count in counts:
            r = self.row[kind].setdefault(entry, at)
            at += r == at
            found[r, column[lang]] += count
            kind_of[r] = kind
        self.scores = np.zeros((n, len(self.langs)))
        for k in range(LONGEST + 1):
            own = kind_of == k
            if own.any():
                c = found[own]
                logs = np.log((c + 0.5) / (c.sum(0) + 0.5 * len(c)))
                self.scores[own] = logs - np.logaddexp.reduce(logs, axis=1, keepdims=True)

    def word(self, word: str) -> np.ndarray:
        """Scores of a word, by itself if known, else by its n-grams."""
        r = self.row[0].get(word)
        if r is not None:
            return self.scores[r]
        marked, found = f"^{word}$", []
        for i in range(len(marked)):
            for k in range(min(LONGEST, len(marked) - i), 0, -1):
                r = self.row[k].get(marked[i : i + k])
                if r is not None:
                    found.append(r)
                    break
        return self.scores[found].mean(0) if found else np.zeros(len(self.langs))


class Predictor:
    """Scores texts; keeps scores of words between texts."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows = model, Rows(CACHE)
        self.table = np.zeros((1024, max(1, len(model.langs))))

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UND, 0.0
        self.rows.trim()
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        if new := self.rows.new:
            self.rows.new = []
            while len(self.rows) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for r, w in enumerate(new, len(self.rows) - len(new)):
                self.table[r] = self.model.word(w)
        mean = self.table[rows].mean(0) * min(len(words), CERTAIN_WORDS)
        p = np.exp(mean - mean.max())
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, min_count: int = MIN_COUNT, entries: int = ENTRIES) -> LanguageModel:
    """A model of the rows with a language and a text."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("t").isNotNull())
    share = written(rows.groupBy("lang").count().select("lang", (F.lit(docs_per_language) / F.col("count")).alias("share")), "shares")
    share = F.broadcast(share) if share.count() <= SENT else share
    u = (F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    counts = written(count_entries(rows.join(share, "lang").where(u < F.col("share")), "lang", "t"), "entries")
    langs = counts.select("lang").distinct().count()
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "kind", "entry"))
    first = counts.withColumn("place", place).where(F.col("place") <= max(SURE, entries // max(1, langs)))
    kept = first.where((F.col("n") >= min_count) | (F.col("place") <= SURE)).select("lang", "kind", "entry", "n")
    return LanguageModel(sorted(tuple(r) for r in kept.collect()))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score, one row per row of docs; from the text alone."""
    shipped = Shipped(docs.sparkSession, model)

    def make():
        p = shipped.get(Predictor)
        return lambda texts: list(zip(*map(p.predict, texts), strict=True))

    return map_documents(docs, make, "lang_pred string, score double", id_col, text_col)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
