"""Quality of texts by a generalised additive model with pairwise interactions: boosted trees give lookup tables, scores are sums of their entries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_sample

#: Bytes of a text that are measured at once, and words among which repeats are counted.
PIECE, WINDOW = 1 << 20, 500
#: What is measured of a text, in order.
FEATURES = [
    "words", "word_length", "longest_word", "words_a_line", "lines", "capitals", "shouted_words", "digits", "marks", "exclamations", "symbols", "bars",
    "other_scripts", "blanks", "sentence_length", "same_as_before", "distinct_words", "distinct_pairs", "commonest_word", "repeated_lines", "wordless",
]
CLASSES = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b".,;:?'\"()-", "exclamations": b"!", "symbols": b"#$%&*+@^~`",
    "bars": b"|<>{}[]\\/=_", "blanks": b" \t\n\v\f\r", "other_scripts": bytes(range(128, 256)), "stops": b".!?",
}
MEMBERS = np.zeros((256, len(CLASSES)), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    MEMBERS[list(_bytes), _k] = 1
LETTERS = bytes(c for c in range(256) if chr(c).isalpha() or c >= 128)


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text's bytes in pieces that end between words."""
    at = 0
    while at < len(raw):
        to = len(raw) if at + PIECE >= len(raw) else raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to]
        at = to


def measure(raw: bytes) -> list[float]:
    """The features of a text's bytes, all of them zero where there are none."""
    classes = np.zeros(len(CLASSES), np.int64)
    n = size = longest = shouted = wordless = same = kinds = pairs = couples = common = 0
    lines: Counter = Counter()
    for piece in pieces(raw):
        classes += np.bincount(np.frombuffer(piece, np.uint8), minlength=256) @ MEMBERS
        words = piece.split()
        n += len(words)
        sizes = list(map(len, words))
        size += sum(sizes)
        longest = max(longest, *sizes) if sizes else longest
        shouted += sum(map(bytes.isupper, words))
        wordless += sum(w.translate(None, LETTERS) == w for w in words)
        same += sum(map(eq, words, words[1:]))
        for at in range(0, len(words), WINDOW):
            some = words[at : at + WINDOW]
            seen = Counter(some)
            kinds += len(seen)
            common += max(seen.values())
            pairs += len(set(zip(some, some[1:])))
            couples += len(some) - 1
        lines.update(hash(x) for x in piece.split(b"\n") if x.strip())
    total = len(raw) or 1
    part = dict(zip(CLASSES, (classes / total).tolist(), strict=True))
    m, many = max(1, n), sum(lines.values())
    found = {
        "words": math.log1p(n), "word_length": size / m, "longest_word": math.log1p(longest), "words_a_line": math.log1p(n / max(1, many)), "lines": math.log1p(many),
        "shouted_words": shouted / m, "sentence_length": math.log1p(n / (1 + part["stops"] * total)), "same_as_before": same / m, "distinct_words": kinds / m,
        "distinct_pairs": pairs / max(1, couples), "commonest_word": common / m, "repeated_lines": 1 - len(lines) / max(1, many) if many else 0.0, "wordless": wordless / m,
    } | part
    return [float(found[f]) for f in FEATURES]


@dataclass
class QualityModel:
    """Bin edges and a table of values for each feature, tables over the bins of pairs of features, and an intercept; all in log odds."""

    edges: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * len(FEATURES))
    single: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)] * len(FEATURES))
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1, np.int64)] * len(FEATURES))
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The summands of each row, one column for each feature and then one for each pair."""
        b = self.bins(x)
        own = [t[b[:, k]] for k, t in enumerate(self.single)]
        both = [t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]] for (i, j), t in self.pairs.items()]
        return np.stack(own + both, 1)

    def names(self) -> list[str]:
        return FEATURES + [f"{FEATURES[i]} x {FEATURES[j]}" for i, j in self.pairs]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.parts(x).sum(1), -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a range of bins; 0 where none has `least` weight on both sides."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0.0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 3) -> np.ndarray:
    """The values by bin of a tree of at most `leaves` leaves over gradient and curvature sums by bin, best cut first."""
    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        cuts = [(*best_cut(g[a:b], h[a:b], ridge, least), a, b) for a, b in ranges]
        gain, k, a, b = max(cuts)
        if gain <= 1e-12:
            break
        ranges.remove((a, b))
        ranges += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, values by cell) of the tree of depth two over a table: a cut of the rows, and of the columns on each side; or the other way round."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            value, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + ridge)
            for rows in (slice(0, k), slice(k, None)):
                gs, hs = a[rows].sum(0), b[rows].sum(0)
                own, c = best_cut(gs, hs, ridge, least)
                gain += own + gs.sum() ** 2 / (hs.sum() + ridge)
                for columns in (slice(0, c), slice(c, None)) if own > 0 else (slice(0, None),):
                    value[rows, columns] = -gs[columns].sum() / (hs[columns].sum() + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, value.T if turned else value)
    return best


def fit_tables(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 250, rate: float = 0.1, ridge: float = 2.0, least: float = 1.0, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40
) -> QualityModel:
    """Boosts log odds: in each round one shallow tree for each feature in turn; then the pairs that the residuals gain most by, in turns too.

    Bin edges are quantiles of all values and of the distinct ones, so that a feature that is mostly zero has bins for the rest.
    A pair's tree cuts both features, so its table holds what no sum of single tables can.
    """
    n = x.shape[1]
    model = QualityModel([np.zeros(0)] * n, [np.zeros(1)] * n, {}, [np.zeros(1, np.int64)] * n)
    model.intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(y) or y.min() == y.max():
        return model
    grid = np.arange(1, bins // 2) / (bins // 2)
    for k in range(n):
        model.edges[k] = np.unique(np.concatenate([np.quantile(x[:, k], grid), np.quantile(np.unique(x[:, k]), grid)]))
    b = model.bins(x)
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, table in enumerate(model.single):
            g, h = (np.bincount(b[:, k], v, len(table)) for v in slopes())
            step = rate * shallow_tree(g, h, ridge, least)
            table += step
            f += step[b[:, k]]

    # neighbouring bins of about equal numbers of rows make the coarse bins of pairs
    for k, table in enumerate(model.single):
        share = np.cumsum(np.bincount(b[:, k], minlength=len(table))) / len(y)
        model.coarse[k] = np.unique(np.minimum((np.concatenate([[0], share[:-1]]) * pair_bins).astype(np.int64), pair_bins - 1), return_inverse=True)[1]
    cells = np.stack([c[b[:, k]] for k, c in enumerate(model.coarse)], 1)
    width = [int(c.max()) + 1 for c in model.coarse]

    def tables(i: int, j: int) -> Iterator[np.ndarray]:
        return (np.bincount(cells[:, i] * width[j] + cells[:, j], v, width[i] * width[j]).reshape(width[i], width[j]) for v in slopes())

    gains = {(i, j): quadrants(*tables(i, j), ridge, least)[0] for i, j in combinations(range(n), 2)}
    chosen = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:pairs] if gains[p] > 0]
    model.pairs = {p: np.zeros((width[p[0]], width[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * quadrants(*tables(i, j), ridge, least)[1]
            table += step
            f += step[cells[:, i], cells[:, j]]
    return model


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = 16_000,
    seed: int = 5,
) -> QualityModel:
    """A model from labelled rows where `learn` (over the column `id`) holds, from a sample of about ``most_rows`` of them, by a hash.

    Texts are measured by Spark; the driver gets one row of FEATURES numbers for each sampled text, and fits the tables from these.
    """
    rows = labelled_sample(docs, labels, learn, id_col, text_col, label_col, most_rows, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measure((t.as_py() or "").encode()) for t in batch.column(0)]
            values = pa.array(np.array(x).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), values), batch.column(1)], ["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toPandas()  # about most_rows rows
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, got["label"].to_numpy()])  # one order of rows, however they arrive, so sums and tables are the same each time
    return fit_tables(x[order], got["label"].to_numpy(float)[order])


def score_quality(docs: DataFrame, model: QualityModel, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from `least`), weakest: the feature or pair of features that takes most from the score.

    A batch of texts is measured, its features are binned by binary search, and the entries of all tables are added.

    Defined results: null and empty texts have the score of a text whose features are all zero. Repeated rows and other columns don't matter;
    one row in is one row out, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousands of numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = m.names()
        for batch in batches:
            x = np.array([measure((t.as_py() or "").encode()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            scores, weakest = m.scores(x), m.parts(x).argmin(1)
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= least).astype(np.int32)), pa.array([names[k] for k in weakest], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "predicted", "weakest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, weakest string").withColumnRenamed("id", id_col)
