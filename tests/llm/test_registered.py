"""The registered queries and the pipeline over the smallest tables, against plain versions; those with SQL are in tests/test_queries.py."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import byte_bpe, decontamination, language_id, queries, toxicity
from tidemark.llm.common import crc_fold
from tidemark.llm.queries import RANKS

AT = "/root/testdata/sf0.001"


def rows_of(name, at=AT):
    return pq.read_table(f"{at}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"] or "") for r in rows_of("documents")]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def tokens(library, pairs):
    for i, t in pairs:
        ids = library.encode_ordinary(t)
        yield i, len(ids), sha(" ".join(map(str, ids))), sha(t)


def joined_components(prints, near):
    """The index of each item's component, by all pairs."""
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if root[a] != root[b] and near(a, b):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def least_distances(pairs, item, budget):
    """For each text, the least edit distance of an item to any of its parts, by the plain recurrence over all texts at once."""
    gap = "\0" * (budget + 2)
    whole = np.frombuffer(gap.join(["", *(t for _, t in pairs), ""]).encode("utf-32-le"), np.uint32)
    at = np.arange(len(whole) + 1, dtype=np.int32)
    row, new = np.zeros(len(whole) + 1, np.int32), np.zeros(len(whole) + 1, np.int32)
    for k, ch in enumerate(item, 1):
        new[0] = k
        np.add(row[:-1], whole != ord(ch), out=new[1:])
        row += 1
        np.minimum(new[1:], row[1:], out=new[1:])
        new -= at
        np.minimum.accumulate(new, out=new)
        new += at
        row, new = new, row
    begin = len(gap)
    for i, t in pairs:
        yield i, int(row[begin : begin + len(t) + 1].min())
        begin += len(t) + len(gap)


def brute_leaks(pairs):
    found = {}
    normal = [(i, decontamination.normalise(t)) for i, t in pairs]
    for r in rows_of("benchmark"):
        item = decontamination.normalise(r["text"] or "")
        budget = int(len(item) * 0.08)
        if len(item) >= decontamination.SHORT:
            found |= {(i, r["item_id"]): d for i, d in least_distances(normal, item, budget) if d <= budget}
    return found


def test_op4(spark, docs):
    found = queries.op4_decontamination(spark, AT).collect()
    least = defaultdict(lambda: 10**9)
    for r in found:
        least[r.doc_id, r.item_id] = min(least[r.doc_id, r.item_id], r.distance)
    assert dict(least) == brute_leaks(docs) and least


def test_short_items_must_stand_alone(spark):
    docs = spark.createDataFrame([("a", "say Yes or no"), ("b", "yesterday"), ("c", "x yes"), (None, "yes")], "doc_id string, text string")
    items = spark.createDataFrame([(1.5, " YES "), (2.5, ""), (3.5, None)], "item_id double, text string")
    found = {(r.doc_id, r.item_id, r.distance, r.begin, r.end) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {("a", 1.5, 0, 4, 7), ("c", 1.5, 0, 2, 5), (None, 1.5, 0, 0, 3)}


def test_op5(spark, docs):
    rows = queries.op5_sharding(spark, AT).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None) for i, t in docs)
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    assert set(held) == set(range(24)) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in held.values())


def test_op6(spark, docs, library):
    assert Counter(map(tuple, queries.op6_byte_bpe(spark, AT).collect())) == Counter(tokens(library, docs))


def test_op7(spark, docs):
    prints = []
    for _, t in docs:
        w = t.encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
        prints.append(sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(s)))
    root = joined_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(docs, root, strict=True):
        least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(docs, prints, root, strict=True))
    assert Counter(map(tuple, queries.op7_simhash(spark, AT).collect())) == want


def test_op8_held_out(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in rows_of("documents", at)}
    found = {r.doc_id: r for r in queries.op8_language_id(spark, at).collect()}
    assert found.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in found.items())
    judged = [found[i].lang_pred == x for i, x in truth.items() if found[i].held_out and x and found[i].lang_pred != "und"]
    assert len(judged) > 150 and np.mean(judged) >= 0.98


def test_op3_held_out(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in rows_of("labels", at)}
    found = {r.doc_id: r for r in queries.op3_toxicity(spark, at).collect()}
    assert found.keys() == {r["doc_id"] for r in rows_of("documents", at)}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in found.items())
    held = [(found[i].predicted, y) for i, y in truth.items() if found[i].held_out and y is not None]
    assert np.mean([p == y for p, y in held]) >= 0.95
    assert sum(p for p, y in held if y) >= 0.5 * sum(y for _, y in held)


def plain_label(model, text, penalty=6.0):
    """(language, score) by scoring each word's byte trigrams one by one and trying every change of language at every word."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()) if regex.search(r"\p{L}", text) else []
    value, paths = None, []
    for w in words:
        padded, own = b" " + w + b" ", np.zeros(len(model.langs), np.float32)
        for x, y, z in zip(padded, padded[1:], padded[2:], strict=False):
            h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            own = own + model.table[h >> 17]
        script = max((k for c in w if c >= 0xC0 for k, (_, low, high) in enumerate(language_id.SCRIPT_OF_LEAD_BYTE) if low <= c <= high), default=0)
        own = np.where(model.scripts[script], own, np.float32(-1e4))
        if value is None:
            value, paths = own, [[k] for k in range(len(own))]
            continue
        new, extended = [], []
        for k in range(len(own)):
            best = max(range(len(own)), key=lambda j: (value[j] - np.float32(penalty * (j != k)), j == k, -j))
            new.append(value[best] - np.float32(penalty * (best != k)) + own[k])
            extended.append([*paths[best], k])
        value, paths = np.array(new, np.float32), extended
    if value is None:
        return "und", 0.0
    share = Counter()
    for w, k in zip(words, paths[int(value.argmax())], strict=True):
        share[k] += len(w)
    best = min(share, key=lambda k: (-share[k], k))
    return model.langs[best], share[best] / sum(share.values())


def test_op8(spark, docs):
    """Every row's language and score, given the model that the query learns."""
    model = language_id.learn_languages(spark.read.parquet(f"{AT}/documents.parquet"), crc_fold(F.col("doc_id"), 4) != 2)
    found = {r.doc_id: r for r in queries.op8_language_id(spark, AT).collect()}
    assert found.keys() == {i for i, _ in docs}
    for i, t in docs:
        lang, score = plain_label(model, t)
        assert found[i].lang_pred == lang and found[i].score == pytest.approx(score), i


def plain_toxicity(model, folded):
    """(score, terms): every place of every term by str.find, the heaviest at a place, without those inside an exception phrase."""
    def places(x):
        at = folded.find(x)
        while at >= 0:
            yield at, at + len(x)
            at = folded.find(x, at + 1)

    exempt = [p for x in model.exceptions if x not in model.weights for p in places(x)]
    heaviest = {}
    for term, weight in model.weights.items():
        for a, b in places(term):
            if weight > heaviest.get(a, (0, 0.0))[1]:
                heaviest[a] = (b, weight)
    held = [(a, b, w) for a, (b, w) in heaviest.items() if not any(x <= a and b <= y for x, y in exempt)]
    total = sum(w for *_, w in held)
    x = model.slope[0] * math.log1p(total) + model.slope[1] * total / math.sqrt(folded.count(" ") or 1) + model.slope[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), {folded[a:b].strip() for a, b, _ in held}


def test_op3(spark, docs):
    """Every row's score and number of terms, given the model that the query learns."""
    model = toxicity.learn_toxicity(spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet"), crc_fold(F.col("id"), 5) != 0)
    found = {r.doc_id: r for r in queries.op3_toxicity(spark, AT).collect()}
    assert found.keys() == {i for i, _ in docs} and model.weights
    for i, t in docs:
        score, held = plain_toxicity(model, toxicity.fold(t))
        assert found[i].score == pytest.approx(score) and found[i].n_terms == len(held) and found[i].predicted == (found[i].score >= 0.5), i


def similarity(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_pipeline(spark, docs, library):
    """Language by the planted languages; then every stage decided plainly, over what the stage before keeps."""
    table = spark.read.parquet(f"{AT}/documents.parquet")
    identified = corpus_pipeline.language_stage(spark, table, AT)
    kept = [(r.doc_id, r.text) for r in identified.collect()]
    planted = {r["doc_id"]: r["lang"] for r in rows_of("documents")}
    readable = [i for i, t in docs if planted[i] and regex.search(r"\p{L}{3}", t)]
    assert {i for i, _ in kept} <= {i for i, t in docs if regex.search(r"\p{L}", t)} and len({i for i, _ in kept} & set(readable)) >= 0.98 * len(readable)
    by = defaultdict(list)
    for i, t in kept:
        by[t].append(i)
    kept = [(max(v), t) for t, v in by.items()]
    parts = defaultdict(list)
    for d, r in zip(kept, joined_components(kept, lambda a, b: similarity(kept[a][1], kept[b][1]) >= 0.8), strict=True):
        parts[r].append(d)
    kept = [min(p) for p in parts.values()]
    leaks = {i for i, _ in brute_leaks(kept)}
    want = Counter(tokens(library, [d for d in kept if d[0] not in leaks]))
    assert Counter(map(tuple, corpus_pipeline.run(spark, AT).collect())) == want and leaks


def test_pipeline_stages_take_nulls_clashes_and_empty_tables(spark):
    text = " ".join(f"wort{k} und{k % 7} noch{k} ein satz{k}" for k in range(60))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _copy string, _row_key string, node string, row string, part string, key string"
    rows = [(i, t, "de", "x", 0, f"a{k}", "b", "c", "d", "e", "f") for k, (i, t) in enumerate([(1, text), (1, text), (2, text), (3, None), (4, ""), (None, text + " ende"), (None, text + " ende"), (5, "!!! ...")])]
    docs = spark.createDataFrame(rows, schema)
    for table, want in ((docs, [(2, "a2")]), (docs.limit(0), [])):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, AT)
            assert left.columns == docs.columns
        assert [(r.doc_id, r._copy) for r in left.collect()] == want
        assert corpus_pipeline.STAGES[-1][1](spark, left, AT).count() == len(want)
