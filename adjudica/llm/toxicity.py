"""Operator 7, toxicity: a learnt weighted lexicon matched by Aho-Corasick.

Text is folded first: lower case, look-alike letters of other scripts to Latin,
and digits or signs that stand for letters inside a word to those letters. The
lexicon holds word beginnings; the longest entry that begins a word counts.
Words inside an exception phrase do not count. The score is a logistic function
of the matched weight, divided by a power of the number of words.

Learning is distributed: document frequencies of every folded word beginning are
counted over all labelled rows with Spark aggregates, and entries are chosen by
smoothed log odds. An entry occurs in ``MIN_SHARE`` of the toxic rows at least, so the
number of entries is at most the mean number of word beginnings in a text divided by
that share, however many rows there are; only they reach the driver. The logistic
curve is fitted on some ``SAMPLE_DOCS`` labelled rows, drawn by a hash of the row.
Labelled texts are shuffled once and written, as three actions read them.

Defined results: null and empty texts score the curve's floor; texts of any
length are matched whole, in one pass; repeated rows score alike; rows without a
label are not learnt from, and repeated labels count each; without labels the
lexicon is empty and every score is the floor; extra columns stay.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_shuffles, ship

ship(__name__)

#: More entries than this would not fit MIN_SHARE and texts of any usual length: an error, not a cut.
MAX_ENTRIES = 1_000_000
#: Expected size of the sample that the logistic curve is fitted on; its square root bounds the noise.
SAMPLE_DOCS = 8_000
#: Word beginnings of these lengths, and whole words, are candidates.
PREFIXES = (4, 5, 6, 8)
MIN_DOCS = 5
MIN_SHARE = 0.001
MIN_LOG_ODDS = 3.0
#: The matched weight is divided by (words + 20) to this power.
LENGTH_POWER = 0.25

# Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ӏ": "l",
}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Harmless phrases that hold a lexicon word.
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "clown fish", "clownfish", "idiot proof", "pond scum", "soap scum"]

FOLD = str.maketrans(HOMOGLYPHS)
IN_WORD = str.maketrans(SUBSTITUTES)
ZERO_WIDTH = str.maketrans(dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD]))


def fold_word(word: str) -> str:
    """A word without outer punctuation; signs count as letters only between letters."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "@$"):
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    word = word[a:b]
    if word.isalpha() or not any(map(str.isalpha, word)):
        return word
    return word.translate(IN_WORD)


def fold(text: str) -> str:
    """Folded words, one space before and after each."""
    text = text.translate(ZERO_WIDTH)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(FOLD)
    else:
        text = text.lower()
    return " " + " ".join(w for w in map(fold_word, text.split()) if w) + " "


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if n < len(word)] + [word] * (3 <= len(word) <= 24)


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    slope: float = 1.0
    offset: float = -2.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, w in self.weights.items():
            for spelt in {word, word.replace("l", "i")}:  # the digit 1 may stand for l
                a.add_word(" " + spelt, (len(spelt) + 1, w, False))
        for phrase in self.exceptions:
            a.add_word(" " + phrase, (len(phrase) + 1, 0.0, True))
        if len(a):
            a.make_automaton()
        return a

    def density(self, automaton, text: str) -> float:
        """Matched weight per word, longest entry at each word's start."""
        folded = fold(text)
        n = folded.count(" ") - 1
        if n <= 0 or not len(automaton):
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        spared_to: list[tuple[int, int]] = []
        for end, (length, w, harmless) in automaton.iter(folded):
            start = end - length + 1
            if harmless:
                spared_to.append((start, end))
            elif length > best.get(start, (0, 0))[0]:
                best[start] = (length, w)
        for a, b in spared_to:
            for s in [s for s in best if a <= s <= b] if len(spared_to) < 64 else ():
                best.pop(s, None)
        if len(spared_to) >= 64:
            starts = np.array(sorted(best))
            for a, b in spared_to:
                for s in starts[np.searchsorted(starts, a) : np.searchsorted(starts, b, "right")]:
                    best.pop(int(s), None)
        return sum(w for _, w in best.values()) / (n + 20) ** LENGTH_POWER

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * density + self.offset))))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-variable logistic regression with a small ridge, by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, -2.0
    b = np.array([1.0, -2.0])
    X = np.column_stack([x, np.ones_like(x)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (y - p) - 0.1 * b
        h = (X * (p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(b[0]), float(b[1])


def learn(labelled: DataFrame) -> Lexicon:
    """A lexicon from rows (text, toxic), doc_id beside them or not: Spark counts, the driver keeps the chosen entries."""

    def terms(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                words, toxic = [], []
                for text, y in zip(pdf["text"][i : i + 200], pdf["toxic"][i : i + 200], strict=True):
                    own = {b for w in set(fold(text or "").split()) for b in beginnings(w)}
                    words += own
                    toxic += [y] * len(own)
                yield pd.DataFrame({"term": words, "toxic": toxic})

    scratch = Scratch(labelled.sparkSession, "toxicity")
    wanted = labelled.where("toxic is not null and text is not null")
    rows = scratch.save(wanted.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(*[c for c in ("doc_id", "text") if c in labelled.columns]).alias("draw")))
    release_shuffles(scratch.spark)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), sum(v for k, v in size.items() if k != 1)
    lexicon = Lexicon()
    if not n1 or not n0:
        scratch.close()
        return lexicon
    bad, good = F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1))
    odds = F.log((F.col("bad") + 0.5) / n1) - F.log((F.col("good") + 0.5) / n0)
    chosen = (
        rows.select("text", "toxic")
        .mapInPandas(terms, "term string, toxic int")
        .groupBy("term")
        .agg(bad.alias("bad"), good.alias("good"))
        .where(F.col("bad") >= max(MIN_DOCS, math.ceil(n1 * MIN_SHARE)))
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_LOG_ODDS)
        .select("term", "odds")
    )
    chosen = scratch.save(chosen)
    release_shuffles(scratch.spark)
    if (n := chosen.count()) > MAX_ENTRIES:
        raise ValueError(f"{n} lexicon entries; raise MIN_SHARE")
    lexicon.weights = {r["term"]: float(r["odds"]) for r in chosen.orderBy("term").collect()}
    # Each row is drawn by itself, whatever the others are: no sort of texts, no single task.
    reach = min(2**62, math.ceil(2**62 * SAMPLE_DOCS / (n1 + n0)))
    sample = rows.where(F.col("draw").bitwiseAND(F.lit(2**62 - 1)) < reach).select("text", "toxic")
    automaton_of = lexicon

    def densities(batches):
        automaton = automaton_of.automaton()
        for pdf in batches:
            yield pd.DataFrame({"x": [automaton_of.density(automaton, t) for t in pdf["text"]], "y": pdf["toxic"].astype(int)})

    points = sample.mapInPandas(densities, "x double, y int").collect()
    x, y = np.array([p["x"] for p in points]), np.array([float(p["y"] == 1) for p in points])
    lexicon.slope, lexicon.offset = fit_curve(x, y)
    scratch.close()
    return lexicon


def score_toxicity(documents: DataFrame, lexicon: Lexicon, name: str = "toxicity_score") -> DataFrame:
    """documents with their score (0 to 1) in a column ``name``, which replaces one of that name; one pass, no shuffle."""
    documents = documents.drop(name)
    schema = documents.select("*", F.lit(0.0).alias(name)).schema

    def scan(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            import pyarrow as pa

            i = batch.schema.get_field_index("text")
            scores = [lexicon.score(lexicon.density(automaton, t or "")) for t in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return documents.mapInArrow(scan, schema)


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learnt from: crc32 of the id as text, mod 5, not 0."""
    own = labels.where("toxic is not null").select("doc_id", "toxic")
    return (
        documents.select("doc_id", "text")
        .where((F.crc32(F.col("doc_id").cast("string")) % 5) != 0)
        # One plan at every size: few labels would be broadcast, more of them would have the texts shuffled.
        .join(own.hint("merge"), "doc_id")
        .select("doc_id", "text", "toxic")
    )
