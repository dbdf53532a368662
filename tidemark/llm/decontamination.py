"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Items under so many code points are sought without edits and between word borders: a piece of them is no evidence.
SHORT = 20
SPACES = re.compile(r"\s+")


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return SPACES.sub(" ", text.lower()).strip()


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of even length: with at most `budget` edits, one piece stays untouched."""
    cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of the text, end of the first such part); one bit for each pattern place."""
    m, full = len(pattern), (1 << len(pattern)) - 1
    places: dict[str, int] = {}
    for k, ch in enumerate(pattern):
        places[ch] = places.get(ch, 0) | 1 << k
    up, down, score, top = full, 0, m, 1 << (m - 1)
    best, end = m, 0
    for j, ch in enumerate(text):
        eq = places.get(ch, 0)
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & full
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = (mh | ~(xv | ph)) & full
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def build(items: list[tuple[int, str]], rate: float) -> tuple[dict[int, tuple[str, int]], ahocorasick.Automaton]:
    """Texts and error budgets by item, and the automaton of all pieces."""
    texts, owners = {}, {}
    for key, (_, text) in enumerate(items):
        budget = int(len(text) * rate) if len(text) >= SHORT else 0
        texts[key] = text, budget
        for at, piece in pieces(text, budget):
            owners.setdefault(piece, []).append((key, at))
    automaton = ahocorasick.Automaton()
    for piece, who in owners.items():
        automaton.add_word(piece, (len(piece), who))
    automaton.make_automaton()
    return texts, automaton


def stands_alone(text: str, begin: int, end: int) -> bool:
    """Whether a part of a text is not cut out of longer words."""
    return not (text[begin].isalnum() and begin and text[begin - 1].isalnum() or text[end - 1].isalnum() and text[end : end + 1].isalnum())


def find(text: str, texts: dict[int, tuple[str, int]], automaton: ahocorasick.Automaton) -> list[tuple[int, int, int, int]]:
    """(item, distance, begin, end) of each part of a normalised text within an item's budget; overlapping candidates give the best one."""
    starts: dict[int, set[int]] = {}
    for end, (size, who) in automaton.iter(text):
        for item, at in who:
            starts.setdefault(item, set()).add(end - size + 1 - at)
    out = []
    for item, places in starts.items():
        pattern, budget = texts[item]
        if len(pattern) < SHORT:
            out += [(item, 0, s, s + len(pattern)) for s in sorted(places) if stands_alone(text, s, s + len(pattern))]
            continue
        areas: list[list[int]] = []
        for s in sorted(places):
            a, b = max(0, s - budget), min(len(text), s + len(pattern) + budget)
            if areas and a <= areas[-1][1] - len(pattern):
                areas[-1][1] = max(areas[-1][1], b)
            else:
                areas.append([a, b])
        last = -1
        for a, b in areas:
            distance, end = myers(pattern, text[a:b])
            if distance <= budget and a + end > last:
                part = text[max(a, a + end - len(pattern) - budget) : a + end]
                _, back = myers(pattern[::-1], part[::-1])
                out.append((item, distance, a + end - back, a + end))
                last = a + end
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.08,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_chars: int = 4_000_000,
) -> DataFrame:
    """id, item_id, distance, budget, begin, end: parts of texts within an edit budget of a benchmark item.

    The budget is ``rate`` times the item's length; items under SHORT code points have none and must stand between word borders. Texts and items are lower-cased and white space is collapsed; begin and end
    count code points of the normalised text. The items are the stated query set: they are read in blocks of bounded
    size, each searched against all documents in one pass without a shuffle.

    Defined results: null texts hold nothing; null and empty items are not searched; equal items each give rows; repeated documents
    each give rows; empty tables give an empty result. Ids of either table are of any type. Other columns are not read.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_col, item_text, block_chars)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kind}, item_id {item_kind.simpleString()}, distance int, budget int, begin int, end int"
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts, automaton = build(shared.value, rate)
            for batch in batches:
                found = []
                for k, text in enumerate(batch.column(1)):
                    if texts and (t := text.as_py()):
                        found += [(k, *x) for x in find(normalise(t), texts, automaton)]
                k, item, distance, begin, end = zip(*found, strict=True) if found else ((),) * 5
                ids = batch.column(0).take(pa.array(k, pa.int64()))
                items = pa.array([shared.value[i][0] for i in item], to_arrow_type(item_kind))
                columns = [ids, items, *(pa.array(x, pa.int32()) for x in (distance, [texts[i][1] for i in item], begin, end))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "distance", "budget", "begin", "end"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> list[list[tuple[object, str]]]:
    """Items and normalised texts in blocks of at most block_chars code points, or one item."""
    blocks: list[list[tuple[object, str]]] = [[]]
    held = 0
    for row in benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).toLocalIterator():
        text = normalise(row["text"] or "")
        if not text:
            continue
        if held + len(text) > block_chars and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((row["item"], text))
        held += len(text)
    return blocks


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000
) -> DataFrame:
    """The rows, with all columns, that hold no part within an item's edit budget; no shuffle."""
    column = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts, automaton = build(shared.value, rate)
            for batch in batches:
                kept = [not (texts and (t := text.as_py()) and find(normalise(t), texts, automaton)) for text in batch.column(column)]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
