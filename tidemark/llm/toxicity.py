"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matches, exception phrases, a score normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_sample

#: Letters of other scripts that look like Latin ones, after lower-casing.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    }
)
#: Latin letters that no accent makes, as plain ones.
LATIN = str.maketrans({"ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe"})
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
TABLE = bytearray(b" " * 256)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha():
        TABLE[_c] = ord(chr(_c).lower())
for _a, _b in SUBSTITUTES.items():
    TABLE[ord(_a)] = ord(_b)
TABLE = bytes(TABLE)
PLAIN = {k: chr(TABLE[k]) for k in range(128)}
INNER = re.compile(r"(?<![\w@$])[!@$]+|[!@$]+(?![\w@$])")
ZERO_WIDTH = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
MARKS = re.compile("[\u0300-\u036f]+")
WORD = re.compile(r"[\w@$!]+")
NO_LETTER = re.compile(r"[\W\d_]+")


def mixed(word: re.Match) -> str:
    """A word that mixes scripts in Latin letters; a word of one script as it is."""
    w = word[0]
    letters = [c for c in w if c.isalpha()]
    latin = sum(c.isascii() for c in letters)
    return w.translate(HOMOGLYPHS) if 0 < latin < len(letters) else w


def fold(text: str) -> str:
    """Words of letters, each between single spaces: accents dropped, digits and signs read as letters, homoglyphs where a word mixes scripts.

    Letters of other scripts stay, so texts in them are judged by their own words.
    """
    if text.isascii():
        return " " + " ".join(INNER.sub(" ", text).encode().translate(TABLE).decode().split()) + " "
    text = MARKS.sub("", unicodedata.normalize("NFKD", ZERO_WIDTH.sub("", text))).lower().translate(LATIN)
    text = INNER.sub(" ", WORD.sub(mixed, text)).translate(PLAIN)
    return " " + " ".join(NO_LETTER.sub(" ", text).split()) + " "


#: Letters of the beginnings of words that are terms, as weights of whole words miss their inflections.
STEMS = range(4, 7)


def terms(folded: str) -> set[str]:
    """Candidate terms of a text: its words, and their beginnings; a space marks a word's edge."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update([f" {w[:k]}" for k in STEMS if len(w) > k])
    return out


@dataclass
class ToxicityModel:
    """Weights by term, exception phrases, and the logistic that turns a normalised sum into a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: tuple[float, ...] = (0.0, 0.0, -2.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(phrase, (len(phrase), 0.0))
        found.make_automaton()
        return found


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of terms that no exception phrase covers; of terms at one word the heaviest."""
    if not len(automaton):
        return []
    terms_, exempt = {}, []
    for end, (size, weight) in automaton.iter(folded):
        begin = end + 1 - size
        if weight == 0.0:
            exempt.append((begin, end + 1))
        elif weight > terms_.get(begin, (0, 0.0))[1]:
            terms_[begin] = (end + 1, weight)
    exempt.sort()
    begins, reach = [b for b, _ in exempt], list(accumulate((e for _, e in exempt), max))
    covered = lambda b, e: (k := bisect_right(begins, b)) and reach[k - 1] >= e
    return [(b, e, w) for b, (e, w) in sorted(terms_.items()) if not covered(b, e)]


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """The sum of weights as its logarithm, and normalised by the root of the number of words."""
    total = sum(w for _, _, w in matches(folded, automaton))
    return math.log1p(total), total / math.sqrt(folded.count(" ") or 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights and intercept by Newton's method, classes weighted equally half-way."""
    if not len(y) or y.min() == y.max():
        return (*([0.0] * x.shape[1]), 4.0 if len(y) and y.min() == 1 else -4.0)
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    pull = np.full(a.shape[1], ridge)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(pull), a.T @ (p - y) + pull * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 16_000,
    least_weight: float = 2.5,
    seed: int = 3,
) -> ToxicityModel:
    """A model from labelled rows where `learn` (over the id) holds; a sample of about ``most_rows`` of them, by a hash.

    A term's weight is the log of how much likelier toxic texts hold it; uses that an exception phrase
    will cover count against it, so a term that is mostly harmless is not learned. A term whose beginning has been taken already is left out.
    Phrases of a term and a neighbour word that only clean texts hold become exceptions. Counts are made by Spark. All terms over
    least_weight and all exceptions are used: a term lies in `least` toxic texts of the sample or more and a phrase in three clean ones, so the
    sample bounds their number, and the driver gets them and two numbers for each sampled row.
    """
    rows = labelled_sample(docs, labels, learn, id_col, text_col, label_col, most_rows, seed).withColumnRenamed("label", "toxic")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(slope=(0.0, 0.0, 4.0 if toxic else -4.0))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        names = ["term", "toxic", "clean"]

        def flush() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))], names)
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[y].update(terms(fold(text.as_py() or "")))
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield flush()
        yield flush()

    a, b = F.sum("toxic"), F.sum("clean")
    weight = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    counted = rows.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(a.alias("a"), b.alias("b"), weight.alias("w"))
    least = max(3, round(0.004 * toxic))
    best = counted.filter((F.col("a") >= least) & (F.col("w") >= least_weight)).collect()
    weights: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["term"].rstrip()), -r["a"], r["term"])):
        if not any(r["term"].rstrip()[:k] in weights for k in range(1, len(r["term"]))):
            weights[r["term"]] = float(r["w"])
    model = ToxicityModel(weights)

    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found, label = [], []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                t, own = fold(text.as_py() or ""), set()
                for begin, end, _ in matches(t, automaton):
                    stop = t.find(" ", max(end - 1, begin + 1))
                    before, after = t.rfind(" ", 0, begin), t.find(" ", stop + 1)
                    own |= {t[before : stop + 1]} if before >= 0 else set()
                    own |= {t[begin : after + 1]} if after >= 0 else set()
                found += own
                label += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(label, pa.int32())], ["phrase", "toxic"])

    held = rows.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    model.exceptions = [r["phrase"] for r in held.filter("a = 0 and n >= 3").orderBy("phrase").collect()]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = [features(fold(t.as_py() or ""), automaton) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in x], pa.float64()), pa.array([f[1] for f in x], pa.float64()), batch.column(1)], ["x0", "x1", "toxic"])

    got = rows.mapInArrow(measure, "x0 double, x1 double, toxic int").toPandas()
    model.slope = fit_logistic(got[["x0", "x1"]].to_numpy(), got["toxic"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from score 0.5), terms: the matched terms of each text.

    Defined results: null and empty texts hold no term and get the score of a text without terms. Repeated rows and other columns
    don't matter; one row in is one row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the bounded sample makes it

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        automaton = m.automaton()
        for batch in batches:
            scores, held = [], []
            for text in batch.column(1):
                t = fold(text.as_py() or "")
                x = features(t, automaton)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope[0] * x[0] + m.slope[1] * x[1] + m.slope[2])))))
                held.append(sorted({t[b:e].strip() for b, e, _ in matches(t, automaton)}) if x[0] else [])
            predicted = [int(s >= 0.5) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(held, pa.list_(pa.string()))], ["id", "score", "predicted", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, terms array<string>").withColumnRenamed("id", id_col)
