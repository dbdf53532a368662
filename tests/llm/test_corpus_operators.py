"""Source divergence, cross-tokenizer alignment and the quality model against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, cross_tokenizer, quality, queries
from tidemark.llm import source_divergence as divergence

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_divergence(docs, least=3, most=200, scale=10**9):
    """docs: (text, lang, source)"""
    docs = [tuple(x or "" for x in d) for d in docs]
    small = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n, d, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = [w.translate(small) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n[lang, source].update(words)
        d[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in d[lang].items() if k >= least)
        whole = sum((n[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return [1 + scale * (c[t] + 1) // total for t in kept]

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(map(f, p[s], p[r])), r) for r in sources if r != s]
            term = [(f(a, b), t) for t, a, b in zip(kept, p[s], q, strict=True) if n[lang, s][t] and a > b]
            for part, rows in (("pair", pair), ("term", term)):
                ranked = sorted(rows, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return out


DIVERGENCE = "text string, lang string, source string, term string, part string, n bigint, names string"


def test_source_divergence(spark):
    rng = random.Random(2)
    words = ["a", "B", "ab", "é", "É", "x1y", "don't", "\U0001f600", "名前", "zz", "q\u00a0r", "tail\x00s"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "ü"])) for _ in range(150)]
    docs += [("", "fr", "s1"), (None, "fr", "s2"), ("only here", "it", "s9"), ("wort " * 4000, "en", "s1"), docs[0], docs[0]]
    rows = spark.createDataFrame([(*x, "t", "p", 1, "n") for x in docs], DIVERGENCE).repartition(5)
    for most in (200, 4):
        found = [tuple(r) for r in divergence.source_divergence(rows, most_terms=most).collect()]
        assert Counter(found) == Counter(plain_divergence(docs, most=most))
    assert divergence.source_divergence(rows.limit(0)).count() == 0


def test_source_divergence_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for part in divergence.term_pieces("Ab c, d\u00e9f  ghijklmnop 1 q".encode()) for w in part] == [b"ab", b"c", "d\u00e9f".encode(), b"ghijklmnop", b"q"]
    assert not list(divergence.term_pieces(b""))


def test_shares_are_exact_for_counts_beyond_longs(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(8 * 10**15, 3 * 10**16)], "c bigint, n bigint").select(divergence.share(F.col("c"), F.col("n"), 10**9)).first()
    assert row[0] == 1 + 10**9 * (8 * 10**15 + 1) // (3 * 10**16)


def plain_links(docs):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by loops over every token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = dict(zip(map(chr, [*shown, *range(256, 324)]), [*shown, *(k for k in range(256) if k not in shown)], strict=True))
    raw_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))

    def raw_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("\u2581", " ").encode()

    held, links, shown = [], [], []
    for _, t in docs:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        u, v = list(map(raw_a, x)), list(map(raw_b, y))
        if not t or not b"".join(u) == b"".join(v) == (" " + t).encode():
            held.append((0, 0)), links.append([]), shown.append(None)
            continue
        i = j = p = q = 0
        groups = [([], [])]
        while i < len(x) or j < len(y):
            if p <= q:
                p, i = p + len(u[i]), i + 1
                groups[-1][0].append(x[i - 1])
            else:
                q, j = q + len(v[j]), j + 1
                groups[-1][1].append(y[j - 1])
            if p == q:
                groups.append(([], []))
        groups.pop()
        held.append((len(x), len(y)))
        links.append([(m, n) for g in groups for m in g[0] for n in g[1]])
        shown.append((len(groups), ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)))
    count = Counter(pair for own in links for pair in set(own))
    top = defaultdict(int)
    for (m, _), n in count.items():
        top[m] = max(top[m], n)
    for (i, _), n, own, text in zip(docs, held, links, shown, strict=True):
        best = sum(count[p] == top[p[0]] for p in own)
        sha = hashlib.sha256(text[1].encode()).hexdigest() if text else ""
        yield i, *n, text[0] if text else 0, len(own), best, sum(count[p] for p in own), sha


def odd_texts():
    rng = random.Random(4)
    kinds = ["the cat sat ", "Stra\u00dfe \u00e9t\u00e9 ", "\U0001f600\U0001f3fd", "\u4f60\u597d\u4e16\u754c", "x" * 9, " " * 7, "\n\n\t", "<s></s><|endoftext|><0x41>", "12345", "don't!!", "\x00\x1c\u200d", "ab" * 5]
    out = [(k, "".join(rng.choices(kinds, k=rng.randint(1, 12)))) for k in range(60)]
    return out + [(100, None), (101, ""), (102, " "), (103, "\u2581 meta \u2581space"), (104, "ab" * 3000), (105, "xab" + "ab" * 2000), (106, "\ufb01 \uff21 \u0130"), (107, "word " * 3000), (5, out[5][1]), (None, "word word"), (None, "word word")]


@pytest.mark.parametrize("small", [False, True])
def test_cross_tokenizer(spark, monkeypatch, small):
    docs = odd_texts()
    rows = spark.createDataFrame([(i, t, "a", 1, "k") for i, t in docs], "doc_id bigint, text string, a string, block int, at string").repartition(3)
    if small:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        monkeypatch.setattr(cross_tokenizer, "PARTS", 2)
    try:
        pattern = public_tokenizers.PATTERN if small else None
        found = cross_tokenizer.cross_tokenizer_links(rows, partial(cross_tokenizer.byte_level, A, pattern), partial(cross_tokenizer.pieces, B))
        assert Counter(map(tuple, found.collect())) == Counter(plain_links(docs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cross_tokenizer.cross_tokenizer_links(rows.limit(0), partial(cross_tokenizer.byte_level, A), partial(cross_tokenizer.pieces, B)).count() == 0


def test_both_libraries_give_the_same_ids():
    """Every code point of the basic plane and some beyond, between letters, digits, marks and blanks."""
    slow, quick = cross_tokenizer.byte_level(A), cross_tokenizer.byte_level(A, public_tokenizers.PATTERN)
    assert slow.raw == quick.raw
    points = [c for c in [*range(0x10000), *range(0x1F300, 0x1F700), *range(0x10400, 0x10500)] if not 0xD800 <= c <= 0xDFFF]
    texts = ["\n".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    assert slow.encode(texts) == quick.encode(texts)


def test_wide_groups_and_slices_give_equal_links(monkeypatch):
    """Tokens that never end together: counting equal tokens first, and expanding in slices, change nothing."""
    a, b = (cross_tokenizer.Tokens(lambda t: [], [b"", b"x", b"xy", b"yx", b"y"]) for _ in range(2))
    ids = [[1, *[3] * 40, 4], [2] * 41, [1, 4]], [[2] * 41, [1, *[3] * 40, 4], [2]]
    want = cross_tokenizer.aligned(*ids, a, b)
    for name, value in (("MANY_LINKS", 10**9), ("EXPANDED", 7), ("MANY_LINKS", 0)):
        monkeypatch.setattr(cross_tokenizer, name, value)
        got = cross_tokenizer.aligned(*ids, a, b)
        assert all(list(x) == list(y) for x, y in zip(want, got, strict=True))
    assert want[1].tolist() == [42 * 41, 42 * 41, 2] and want[2][2] == b"1,4|2"


def test_op12(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    assert Counter(map(tuple, queries.op12_cross_tokenizer(spark, "/root/testdata/sf0.001").collect())) == Counter(plain_links(docs))


def plain_features(text):
    """The features of a text of one piece, by plain counting."""
    raw = (text or "").encode()
    if not raw:
        return dict.fromkeys(quality.FEATURES, 0.0)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(words))
    part = {k: sum(c in v for c in raw) / len(raw) for k, v in quality.CLASSES.items()}
    windows = [words[k : k + 500] for k in range(0, len(words), 500)]
    part |= {
        "words": math.log1p(len(words)), "word_length": sum(map(len, words)) / m, "longest_word": math.log1p(max(map(len, words), default=0)),
        "words_a_line": math.log1p(len(words) / max(1, len(lines))), "lines": math.log1p(len(lines)), "shouted_words": sum(w.isupper() for w in words) / m,
        "sentence_length": math.log1p(len(words) / (1 + sum(c in b".!?" for c in raw))), "same_as_before": sum(a == b for a, b in zip(words, words[1:])) / m,
        "distinct_words": sum(len(set(w)) for w in windows) / m, "distinct_pairs": sum(len(set(zip(w, w[1:]))) for w in windows) / max(1, sum(len(w) - 1 for w in windows)),
        "commonest_word": sum(max(w.count(x) for x in set(w)) for w in windows) / m, "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "wordless": sum(not any(chr(c).isalpha() and c < 128 or c >= 128 for c in w) for w in words) / m,
    }
    return part


def plain_score(model, x):
    """The sum of table entries, bins found by counting edges."""
    b = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
    total = model.intercept + sum(t[k] for t, k in zip(model.single, b, strict=True))
    total += sum(t[model.coarse[i][b[i]]][model.coarse[j][b[j]]] for (i, j), t in model.pairs.items())
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


ODD = [None, "", " ", "\n\n", "A", "!!! ???", "the The THE\nthe The THE\nnew | line $$$", "你好。 été\x00", "same " * 1300, "x" * 5000, "one\ntwo\none\n", "12 34 56"]


def test_features_and_scores_follow_plain_versions(spark):
    rng = np.random.default_rng(3)
    x = np.array([quality.measure((t or "").encode()) for t in ODD])
    for t, row in zip(ODD, x, strict=True):
        want = plain_features(t)
        assert row == pytest.approx([want[f] for f in quality.FEATURES], abs=1e-12), t
    many = x[rng.integers(0, len(x), 400)] + rng.normal(0, 0.05, (400, x.shape[1]))
    model = quality.fit_tables(many, (many[:, 0] + many[:, 5] > np.median(many[:, 0])).astype(float), rounds=20, pair_rounds=5)
    assert model.pairs
    rows = [(k, t, "x", 0.5) for k, t in enumerate(ODD)] + [(3, "again", "x", 1.0), (None, "again", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, id string, score double")
    found = quality.score_quality(docs, model).collect()
    want = Counter((i, round(plain_score(model, quality.measure((t or "").encode())), 9)) for i, t, *_ in rows)
    assert Counter((r.doc_id, round(r.score, 9)) for r in found) == want and all(r.predicted == (r.score >= 0.3) and r.weakest in model.names() for r in found)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_texts_of_several_pieces_are_whole(monkeypatch):
    text = " ".join(f"word{k}" for k in range(400)).encode()
    whole = quality.measure(text)
    monkeypatch.setattr(quality, "PIECE", 100)
    parts = dict(zip(quality.FEATURES, quality.measure(text), strict=True))
    for f, v in zip(quality.FEATURES, whole, strict=True):
        if f not in ("commonest_word", "distinct_pairs", "lines", "words_a_line", "repeated_lines"):  # counted within a piece
            assert parts[f] == pytest.approx(v), f


def test_pairs_hold_what_single_tables_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 1] > 0.5) != (x[:, 3] > 0.5)).astype(float)
    model = quality.fit_tables(x, y, rounds=30, pair_rounds=60)
    assert next(iter(model.pairs)) == (1, 3)
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.95
    alone = quality.fit_tables(x, y, rounds=30, pairs=0)
    assert np.mean((alone.scores(x) >= 0.5) == y) < 0.65


def brute_tree(g, h, ridge, least):
    """The greatest sum of squared gradients over curvatures that two cuts, the best first, give."""
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    ranges = [(0, len(g))]
    for _ in range(2):
        options = [(gain(a, k) + gain(k, b) - gain(a, b), a, k, b) for a, b in ranges for k in range(a + 1, b) if min(h[a:k].sum(), h[k:b].sum()) >= least]
        if not options or max(options)[0] <= 1e-12:
            break
        _, a, k, b = max(options)
        ranges = [r for r in ranges if r != (a, b)] + [(a, k), (k, b)]
    return {(a, b): -g[a:b].sum() / (h[a:b].sum() + ridge) for a, b in ranges}


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(8)
    for _ in range(50):
        g, h = rng.normal(0, 1, 9), rng.random(9)
        tree = quality.shallow_tree(g, h, 1.0, 0.5)
        for (a, b), v in brute_tree(g, h, 1.0, 0.5).items():
            assert tree[a:b] == pytest.approx([v] * (b - a))
    assert not quality.shallow_tree(np.zeros(5), np.ones(5), 1.0, 1.0).any()


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "c", 0)], "doc_id int, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id int, quality int")
    for some in (labels, labels.limit(0), labels.filter("doc_id = 7")):
        model = quality.learn_quality(docs, some, F.lit(True))
        scores = [r.score for r in quality.score_quality(docs, model).collect()]
        assert len(scores) == 2 and all(0 < s < 1 for s in scores)


def test_op11_held_out(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{at}/labels.parquet").to_pylist()}
    found = {r.doc_id: r for r in queries.op11_quality(spark, at).collect()}
    assert found.keys() == set(pq.read_table(f"{at}/documents.parquet", columns=["doc_id"]).column(0).to_pylist())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[i].predicted, y) for i, y in truth.items() if found[i].held_out and y is not None]
    assert np.mean([p == y for p, y in held]) >= 0.95 and sum(not y for _, y in held) > 5


def test_samples_are_bounded(spark):
    rows = spark.range(9000).selectExpr("cast(null as bigint) AS id", "concat('text ', id) AS text")
    for bound in (8000, 100):
        assert 0.7 * bound <= common.bounded_sample(rows, ["id", "text"], bound, 1).count() <= 1.3 * bound
    assert common.bounded_sample(rows.withColumn("text", F.lit("same")), ["id", "text"], 100, 1).count() == 1
    assert common.bounded_sample(rows.limit(0), ["id", "text"], 100, 1).count() == 0
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('t', id) AS text")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (None, 1)], "doc_id bigint, y int")
    got = common.labelled_sample(docs, labels, F.col("id") >= 0, "doc_id", "text", "y", 200, 1).collect()
    assert 120 <= len(got) <= 280 and {r.label for r in got} == {0, 1}
