"""Language of texts and of their spans: scripts narrow candidates, then Viterbi over per-word scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample

#: Code point ranges of scripts, by the lead byte of their UTF-8 form.
SCRIPT_OF_LEAD_BYTE = (
    ("latin", 0x00, 0xCD),
    ("greek", 0xCE, 0xCF),
    ("cyrillic", 0xD0, 0xD4),
    ("armenian", 0xD5, 0xD6),
    ("hebrew", 0xD7, 0xD7),
    ("arabic", 0xD8, 0xDF),
    ("indic", 0xE0, 0xE0),
    ("asian", 0xE1, 0xE2),
    ("kana_han", 0xE3, 0xE9),
    ("hangul", 0xEA, 0xED),
    ("other", 0xEE, 0xFF),
)
SCRIPT = np.zeros(256, np.int8)
for _k, (_, _a, _b) in enumerate(SCRIPT_OF_LEAD_BYTE):
    SCRIPT[_a : _b + 1] = _k
#: A byte of a word: a letter of ASCII or any byte of a longer code point.
LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
BUCKETS = 1 << 15
ANY_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def gram_buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the three bytes around each byte of a word, first gram of each word, lengths of words, scripts of words)."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    letter = LETTER[b]
    b = np.where(letter, b, 32).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    mid = letter[1:-1]
    buckets = (h[mid] >> np.uint32(17)).astype(np.int32)
    begins = np.flatnonzero(mid & ~letter[:-2])
    ends = np.flatnonzero(mid & ~letter[2:]) + 1
    length = ends - begins
    script = np.maximum.reduceat(SCRIPT[b[1:-1][mid]] * (b[1:-1][mid] >= 0xC0), np.cumsum(length) - length) if len(length) else length
    return buckets, np.cumsum(length) - length, length, script


@dataclass
class LanguageModel:
    """Log probabilities of hashed byte trigrams by language, and the scripts that each language is written in."""

    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages, True: a candidate for words of that script

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, and its bytes."""
        buckets, begins, length, script = gram_buckets(text.lower().encode())
        if not len(length):
            return np.zeros((0, len(self.langs)), np.float32), length
        scores = np.add.reduceat(self.table[buckets], begins, axis=0)
        return np.where(self.scripts[script], scores, np.float32(-1e4)), length


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language of each word of each text, where a change of language costs `penalty`; all texts step together."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    sizes = np.array([len(scores[k]) for k in order])
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(scores)
    if not len(sizes) or not sizes[0]:
        return out
    langs = scores[order[0]].shape[1]
    kind = np.min_scalar_type(-langs)  # wide enough for the number of any language
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
    at = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty((at[-1], langs), np.float32)
    for rank, k in enumerate(order):
        flat[at[: sizes[rank]] + rank] = scores[k]
    moved, source = np.zeros((at[-1], langs), bool), np.zeros(at[-1], kind)
    value = flat[: live[0]].copy()
    last = np.empty(live[0], kind)
    for t in range(1, sizes[0]):
        n = live[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        top = value.argmax(1)
        other = value[np.arange(n), top] - penalty
        a, b = at[t], at[t + 1]
        source[a:b] = top
        moved[a:b] = value < other[:, None]
        value = np.maximum(value, other[:, None]) + flat[a:b]
    last[: len(value)] = value.argmax(1)
    label = np.empty(at[-1], kind)
    state = np.zeros(live[0], kind)
    for t in range(sizes[0] - 1, -1, -1):
        n, more = live[t], live[t + 1] if t + 1 < sizes[0] else 0
        state[more:n] = last[more:n]
        a, b = at[t], at[t + 1]
        label[a:b] = state[:n]
        if t:
            state[:n] = np.where(moved[a:b][np.arange(n), state[:n]], source[a:b], state[:n])
    for rank, k in enumerate(order):
        out[k] = label[at[: sizes[rank]] + rank]
    return out


def learn_languages(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 8000, seed: int = 8
) -> LanguageModel:
    """A model from the rows where `learn` holds and the language is not null.

    Grams are counted by Spark over a sample of about ``most_rows`` rows, chosen by a hash of id and text.
    What reaches the driver is a count for each language and bucket, not texts.
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = bounded_sample(rows, ["id", "text"], most_rows, seed).select("text", "lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        script: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buckets, _, length, scripts = gram_buckets(text.lower().encode())
                total[lang] = total.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)
                script[lang] = script.get(lang, 0) + np.bincount(scripts, weights=length, minlength=len(SCRIPT_OF_LEAD_BYTE)).astype(np.int64)
        for lang, counts in total.items():
            counts = np.concatenate([counts, script[lang]])
            where = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where)), pa.array(where, pa.int32()), pa.array(counts[where], pa.int64())], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPT_OF_LEAD_BYTE), len(langs)))
    column = {x: k for k, x in enumerate(langs)}
    counts[counted["bucket"].to_numpy(int), counted["lang"].map(column).to_numpy(int)] = counted["n"].to_numpy(float)
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    table = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
    common = scripts >= 0.001 * np.maximum(scripts.sum(0), 1)
    common[~common.any(1)] = True  # a script that no language is written in rules none out
    return LanguageModel(langs, table, common)


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0
) -> DataFrame:
    """id, lang_pred, score, spans of (first word, words, language).

    A word is a run of letters. Its script rules out languages that aren't written in it, byte
    trigrams score the rest, and Viterbi with a switching penalty labels spans of words. The text's
    language is the one with the most letters, the score its share of them.

    Defined results: null texts and texts without a letter are ``und`` with score 0 and no spans, as is every text when
    nothing could be learned. Repeated ids and other columns don't matter; one row in is one row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for part, texts in _parts(batch, 1):
                langs, scores, spans = zip(*label_texts(m, texts, penalty), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, spans array<struct<first: int, words: int, lang: string>>")
    return out.withColumnRenamed("id", id_col)


def _parts(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about `most` characters, or one row, with their texts."""
    at, held, texts = 0, 0, []
    for k, value in enumerate(batch.column(column)):
        texts.append(value.as_py() or "")
        held += len(texts[-1])
        if held >= most or k == batch.num_rows - 1:
            yield batch.slice(at, len(texts)), texts
            at, held, texts = k + 1, 0, []


def label_texts(m: LanguageModel, texts: list[str], penalty: float) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text."""
    texts = [t if t and m.langs and ANY_LETTER.search(t) else "" for t in texts]
    found = [m.words(t) if t else (np.zeros((0, len(m.langs)), np.float32), np.zeros(0, int)) for t in texts]
    out: list[tuple[str, float, list[dict]]] = []
    for labels, (_, length) in zip(viterbi([s for s, _ in found], penalty), found, strict=True):
        if not len(labels):
            out.append((UNKNOWN, 0.0, []))
            continue
        share = np.bincount(labels, weights=length, minlength=len(m.langs))
        best = int(share.argmax())
        begins = np.flatnonzero(np.diff(labels, prepend=-1))
        words = np.diff(begins, append=len(labels))
        spans = [{"first": f, "words": n, "lang": m.langs[labels[f]]} for f, n in zip(begins.tolist(), words.tolist(), strict=True)]
        out.append((m.langs[best], float(share[best] / share.sum()), spans))
    return out


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float, text_col: str = "text", penalty: float = 6.0) -> DataFrame:
    """The rows, with all columns, whose text has a language that labels at least least_share of its letters; no shuffle."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, column):
                kept = [lang != UNKNOWN and score >= least_share for lang, score, _ in label_texts(shared.value, texts, penalty)]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
