"""Near copies against plain Jaccard similarities, and the pipeline's stages on edge cases."""

import random
from collections import defaultdict

import pytest

from tidemark.llm import near_copies as near
from tidemark.llm.exact_dedup import keep_one
from tidemark.llm.near_copies import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in pairs], SCHEMA)


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}


def plain_roots(pairs, least=0.8):
    """The index of each row's component by the similarity of all pairs."""
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def near_corpus(seed=11):
    """Texts of 60 to 200 words with near copies of one to four changed words, and unlike texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 7))) for _ in range(400)]
    out = []
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 200))
        out.append((10 * k, " ".join(base)))
        for c in range(k % 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), 1 + c):
                copy[at] = rng.choice(vocabulary)
            out.append((10 * k + 1 + c, " ".join(copy)))
    hot = rng.choices(vocabulary, k=120)  # a group whose members are not all near each other
    for c in range(80):
        copy = list(hot)
        for at in rng.sample(range(len(copy)), rng.randint(0, 3)):
            copy[at] = rng.choice(vocabulary)
        out.append((1000 + c, " ".join(copy)))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies(spark, monkeypatch, block):
    """Exactly the components of all pairs of a similarity of 0.8 or more, however many of a component are compared in one task."""
    monkeypatch.setattr(near, "BLOCK", block)
    pairs = near_corpus()
    docs = documents(spark, pairs).repartition(3)
    found = near_copies(docs)
    root = plain_roots(pairs)
    least = {}
    for (i, _), r in zip(pairs, root, strict=True):
        least[r] = min(i, least.get(r, i))
    assert {r.doc_id: r.keep_id for r in found.collect()} == {i: least[r] for (i, _), r in zip(pairs, root, strict=True)}
    assert sorted(r.doc_id for r in keep_one(docs, found).collect()) == sorted(set(least.values()))
    assert len(set(root)) < len(pairs) - 60 and near_copies(docs.limit(0)).count() == 0


def test_links_at_the_bound(spark):
    """Sets of 8 of 10 and of 7 of 9 equal shingles: 0.8 is linked, less is not."""
    words = [f"w{k}" for k in range(13)]
    long = [f"v{k}" for k in range(60)]
    base, same = " ".join(words), " ".join(["x", *words[1:]])
    pairs = [(1, base), (2, same), (3, " ".join(long)), (4, " ".join([*long[:50], "y", *long[51:]])), (5, " ".join([*long[:20], "y", *long[21:40], "z", *long[41:]])), (6, base.upper()), (7, "  " + base + "\n")]
    root = plain_roots(pairs)
    want = {i: min(j for (j, _), q in zip(pairs, root, strict=True) if q == r) for (i, _), r in zip(pairs, root, strict=True)}
    assert {r.doc_id: r.keep_id for r in near_copies(documents(spark, pairs)).collect()} == want


def test_recall_on_given_tables(spark):
    """Of all pairs of distinct texts of a similarity of 0.8 or more, found by a plain index of shingles, 0.98 are joined; none is joined that no such pairs link."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    pairs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    sets, holders = [shingles(t) for _, t in pairs], defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    linked = set()
    for a, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for b in holders[x]:
                shared[b] += 1
        linked |= {(a, b) for b, n in shared.items() if b < a and n / (len(s) + len(sets[b]) - n) >= 0.8}
    root = list(range(len(pairs)))
    for a, b in linked:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    found = {r.doc_id: r.keep_id for r in near_copies(documents(spark, pairs)).collect()}
    joined = [found[pairs[a][0]] == found[pairs[b][0]] for a, b in linked]
    assert len(joined) >= 4 and sum(joined) >= 0.98 * len(joined)
    of = dict(zip((i for i, _ in pairs), root, strict=True))
    assert all(of[i] == of[k] for i, k in found.items())


def test_near_copies_with_repeated_and_null_ids(spark):
    words = lambda k: [f"w{k}x{n}" for n in range(80)]
    text = lambda k, last="": " ".join(words(k)[:79] + [last or f"w{k}x79"])
    pairs = [(1, text(0)), (5, text(0, "a")), (5, text(1)), (2, text(2)), (2, text(2, "b")), (None, text(3)), (None, text(3, "c")), (None, text(2, "d")), (5, text(1))]
    docs = documents(spark, pairs)
    kept = sorted((r.doc_id or 0, r.text[:2], r.text) for r in keep_one(docs, near_copies(docs)).collect())
    assert [x[:2] for x in kept] == [(0, "w3"), (1, "w0"), (2, "w2"), (5, "w1")] and kept[3][2] == text(1)
