"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, repeats and clashing names."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import byte_bpe, chat, decontamination, language_id, sharding, simhash, toxicity, warc
from tidemark.llm.common import shared_path
from tidemark.llm.exact_dedup import exact_dedup, keep_one
from tidemark.llm.queries import RANKS, encoded_digests
from tidemark.llm.substring_dedup import remove_repeated

SCHEMA = "doc_id bigint, text string, lang string, id string, keep_id string, shard string, fingerprint string, pos string"


def documents(spark, pairs, lang="en"):
    return spark.createDataFrame([(i, t, lang, "x", "x", "x", "x", "x") for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 7))) for _ in range(60)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = words(40)
    out = [(i, words(rng.randint(0, 60))) for i in range(40)]
    out += [(40 + i, f"{words(rng.randint(0, 9))}  {shared}\n{words(5)}") for i in range(12)]
    out += [(60 + i, shared) for i in range(5)] + [(70, None), (71, ""), (72, " \t\n"), (73, "éàü ß 你好  x"), (74, words(4000)), (75, "a" * 3000)]
    return [*out, out[3], (None, shared), (None, "alone")]


def test_exact_dedup(spark, corpus):
    docs = documents(spark, corpus)
    rows = exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    assert Counter((r.doc_id, r.text_sha256) for r in rows) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = [i for i in by[r.text_sha256] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(by[r.text_sha256]))
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(by.keys())
    kept = keep_one(docs, exact_dedup(docs))
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup(docs.limit(0)).count() == 0


def brute_removed(corpus, n=13):
    words = [(i, (t or "").encode().split()) for i, t in corpus]
    first = {}
    for i, w in words:
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, 2**63 - 1), 2**63 - 1 if i is None else i)
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (2**63 - 1 if i is None else i):
                gone[s : s + n] = [True] * n
        yield i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()


@pytest.mark.parametrize("n", [13, 5])
def test_substring_dedup(spark, corpus, n):
    found = remove_repeated(documents(spark, corpus), n).collect()
    assert Counter(map(tuple, found)) == Counter(brute_removed(corpus, n))
    assert remove_repeated(documents(spark, corpus).limit(0)).count() == 0


def test_substring_dedup_over_batches(spark, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert Counter(map(tuple, remove_repeated(documents(spark, corpus)).collect())) == Counter(brute_removed(corpus))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sharding(spark, corpus):
    docs = documents(spark, corpus)
    rows = sharding.uniform_shards(docs, shards=7).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(corpus) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.uniform_shards(docs.limit(0), 7).count() == 0


def test_matrix_is_exact_and_hypergeometric():
    m = np.array(sharding.communication_matrix([100, 0, 57, 1000], 24, 1))
    assert m.sum(1).tolist() == [100, 0, 57, 1000] and np.ptp(m.sum(0)) <= 1
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


def test_byte_bpe(spark, corpus):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs = [*corpus, (80, "it's 12 o'clock!!\r\n\t  <|endoftext|> \x1c\x85 x"), (81, "😀" * 90), (82, "the cat " * 40 + "aaaabbbb" * 80)]
    rows = encoded_digests(documents(spark, pairs)).collect()
    want = []
    for i, t in pairs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert encoded_digests(documents(spark, pairs).limit(0)).count() == 0


def brute_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def test_simhash(spark, corpus):
    rows = simhash.simhash_components(documents(spark, corpus)).collect()
    prints = [brute_fingerprint(t, 3) for _, t in corpus]
    least = {}
    parts = brute_components(prints)
    for (i, _), p in zip(corpus, parts, strict=True):
        least[p] = min(x for x in (least.get(p), i) if x is not None) if (least.get(p), i) != (None, None) else None
    want = Counter((i, f, least[p]) for (i, _), f, p in zip(corpus, prints, parts, strict=True))
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in rows) == want
    assert simhash.simhash_components(documents(spark, corpus).limit(0)).count() == 0


def test_anchored_links_find_every_close_pair(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for k in range(120):  # near ones, chains, and a dense group
        base = prints[0] if k < 60 else rng.choice(prints)
        prints.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    prints = sorted({0, 2**64 - 1, *prints})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint bigint")
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.anchored_links(df)).collect()}
    parts, mine = defaultdict(set), defaultdict(set)
    for p, k in zip(prints, brute_components(prints), strict=True):
        parts[k].add(p)
        mine[found.get(p, p)].add(p)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(30)] + [(100, 101)], "u bigint, v bigint")
    found = {(r.node, r.root) for r in simhash.components(links).collect()}
    assert found == {(k, 0) for k in range(1, 31)} | {(101, 100)}


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_decontamination(spark, corpus):
    rng = random.Random(2)
    items = [(k, " ".join("".join(rng.choices("abcde", k=5)) for _ in range(12))) for k in range(6)] + [(90, None), (91, "short"), (92, "")]

    def spoil(t, n):
        t = list(t)
        for k in rng.sample(range(len(t)), n):
            t[k] = rng.choice(["", "z", t[k] + "q"])
        return "".join(t)

    docs = [(100 + k, f"start {spoil(items[k % 6][1], k % 9)}\n END".upper()) for k in range(54)] + corpus
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, id string")
    found = decontamination.contaminated(documents(spark, docs), bench).collect()
    want = set()
    for d, t in docs:
        for i, x in items[:6]:
            if distance(x, decontamination.normalise(t or "")) <= int(len(x) * 0.08):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in found} == want and want
    for r in found:
        text = decontamination.normalise(dict(docs)[r.doc_id])
        assert distance(items[r.item_id][1], text[r.begin : r.end]) == r.distance
    kept = decontamination.keep_clean(documents(spark, docs), bench)
    assert kept.count() == len([d for d, _ in docs if d not in {w for w, _ in want}])
    blocks = decontamination.contaminated(documents(spark, docs), bench, block_chars=100)
    assert Counter(map(tuple, blocks.collect())) == Counter(map(tuple, found))
    assert decontamination.contaminated(documents(spark, docs).limit(0), bench).count() == 0
    assert decontamination.contaminated(documents(spark, docs), bench.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(3)
    letters = {"aa": "abcdef", "bb": "ghijkl", "el": "αβγδεζ"}
    say = lambda x, n: " ".join("".join(rng.choices(letters[x], k=4)) for _ in range(n))
    rows = [(k, say(x, 30), x) for k, x in enumerate(["aa", "bb", "el"] * 20)]
    docs = spark.createDataFrame(rows + [(100, None, "aa"), (101, "123 ... «»", None), (102, "", "bb"), (103, say("aa", 20) + " " + say("bb", 60), None)], "doc_id bigint, text string, lang string")
    model = language_id.learn_languages(docs, F.col("doc_id") % 4 != 2)
    found = {r.doc_id: r for r in language_id.identify_languages(docs, model).collect()}
    assert all(found[i].lang_pred == x and found[i].score == 1.0 for i, _, x in rows)
    assert [(found[k].lang_pred, found[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert [(s.first, s.words, s.lang) for s in found[103].spans] == [(0, 20, "aa"), (20, 60, "bb")] and found[103].lang_pred == "bb"
    assert language_id.keep_identified(docs, model, 0.9).count() == 60
    nothing = language_id.learn_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) for n in (0, 1, 5, 6, 2)]
    from itertools import product

    for s, labels in zip(scores, language_id.viterbi(scores, 0.8), strict=True):
        value = lambda p, s=s: sum(float(s[k, x]) for k, x in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert len(labels) == len(s)
        if len(s):
            assert value(labels) == pytest.approx(max(map(value, product(range(3), repeat=len(s)))), abs=1e-5)


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("bcdfglmnprstaeiou", k=6)) for _ in range(200)]
    rows, labels = [], []
    for k in range(400):
        text, bad = rng.choices(words, k=40), k % 4 == 0
        if bad:
            text[5] = rng.choice(["zzbadword", "zzuglyword"])
        elif k % 40 == 1:
            text[5:7] = ["zzbadword", "removal"]
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad), "x"))
    rows += [(900, "say zzb4dw0rd now"), (901, "say zzbаdwоrd now"), (902, None), (903, ""), (904, "zzbadword removal service")]
    marks = spark.createDataFrame([*labels, (5000, 1, "x"), (1, None, "x")], "doc_id bigint, toxic int, id string")
    docs = documents(spark, rows)
    model = toxicity.learn_toxicity(docs, marks, F.col("id") % 5 != 0)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(found[k].predicted == y for k, y, _ in labels) >= 396
    assert [found[k].predicted for k in (900, 901, 902, 903, 904)] == [1, 1, 0, 0, 0]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.learn_toxicity(docs.limit(0), marks.limit(0), F.lit(True)).weights == {}


def test_warc(spark):
    pages = [(k, f"http://x/{k}", "<p>same</p>" if k % 3 == 0 else f"<p>é {k}</p>\r\n\r\n") for k in range(30)]
    pages += [(40, None, None), (41, "http://a b", ""), (None, "u", "<p>null id</p>"), (7, "again", "other text"), (42, "long", "q" * 300_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, id string")
    folder = shared_path(spark, "warc-test")
    found = warc.read_warc(warc.write_warc(df.repartition(3), folder), folder, bodies=True).collect()
    keep = {}
    for i, _, t in pages:
        keep[t or ""] = max([x for x in (keep.get(t or ""), i) if x is not None], default=None)
    want = Counter()
    for i, _, t in pages:
        body, first = (t or "").encode(), keep[t or ""]
        own = i == first
        want[None if i is None else str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else str(first)] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    assert {bytes(r.payload) for r in found if r.record_type == "response"} == {t.encode() for t in keep}
    assert warc.read_warc(warc.write_warc(df.limit(0), folder + "-none"), folder + "-none").count() == 0


def test_warc_damage_is_an_error():
    raw = warc.record("u", "1", b"payload" * 50, None) + warc.record("u", "2", b"", "1")
    assert [(f["WARC-Type"], n) for f, n, _ in warc.read_records(io.BytesIO(raw))] == [("response", 350), ("revisit", 0)]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(io.BytesIO(raw[:-9])))
    import gzip

    broken = gzip.compress(gzip.decompress(warc.record("u", "1", b"payload", None)).replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(broken)))


def brute_turns(rows):
    want = defaultdict(list)
    for k, (i, n, r, t) in enumerate(rows):
        want[i if i is not None else f"alone {k}"].append((n is not None, n or 0, r or "", t or ""))
    return Counter(
        (None if isinstance(i, str) else i, tuple((a, b) for _, _, a, b in sorted(v))) for i, v in want.items()
    )


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "", "a\n### b: c </turn>\n", "\\\\", "</turn>", None, "x" * 5000]
    rows = []
    for k in range(90):
        first = "hello" if k % 2 else f"hi {k}"
        rows += [(k, 0, "user", first), (k, 1, "assistant", odd[k % 7]), (k, 2, "us:er\\", odd[k % 5]), (k, 3, "assistant", "end")][: k % 5 + 1]
    rows += [(500, 1, None, "tie b"), (500, 1, None, "tie a"), (500, None, "user", "null turn"), (None, 0, "user", "no id"), (None, 1, "user", "no id"), (7, 0, "user", "again")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, pack string, stem string")
    found = chat.read_conversations(chat.format_conversations(df, pack_size=8)).collect()
    assert Counter((r.conv_id, tuple((t.role, t.text) for t in r.turns)) for r in found) == brute_turns(rows)
    for r in found:
        assert r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted_chars == sum(len(chat.format_turn(t.role, t.text)) for t in r.turns)
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_emits_shared_turns_once(spark):
    """A hot first turn, a hot second one and conversations that are all alike: each shared turn lies in one pack."""
    rows = []
    for k in range(300):
        rows += [(k, 0, "user", "hello"), (k, 1, "assistant", "shared" if k < 200 else f"own {k}"), (k, 2, "user", f"more {k % 3}")][: 2 if k < 40 else 3]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    packs = chat.format_conversations(df, pack_size=16).collect()
    vocabulary, _ = byte_bpe.kept_tables(RANKS, public_tokenizers.PATTERN, byte_bpe.read_ranks(RANKS))
    emitted = [vocabulary.decode(np.array(p.ids, np.int32)).decode() for p in packs]
    assert [sum(t.count(x) for t in emitted) for x in ("### user: hello ", "### assistant: shared ")] == [1, 1]
    assert max(len(p.conversations) for p in packs) < 120 and sum(len(p.conversations) for p in packs) == 300
    stems = {p.pack: p for p in packs if not p.conversations}
    for p in packs:
        up = stems.get(p.stem)
        assert len(p.positions) == len(p.ids) and p.depth == (up.depth if up else 0) + (not p.conversations)
        for n in p.nodes:
            start = up.positions[-1] + 1 if n.parent < 0 and up else p.nodes[n.parent].position + p.nodes[n.parent].end - p.nodes[n.parent].begin if n.parent >= 0 else 0
            assert n.position == start == p.positions[n.begin]
    found = chat.read_conversations(chat.format_conversations(df, pack_size=16)).collect()
    assert Counter((r.conv_id, tuple((t.role, t.text) for t in r.turns)) for r in found) == brute_turns(rows)


def characters(texts):
    return [np.frombuffer(t.encode("utf-32-le"), np.int32) for t in texts]


def test_tree_shares_turns_and_positions():
    ids, nodes, last = chat.pack_tree([[("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c"), ("user", "d")], [("user", "a")], []], characters)
    text = ids.astype(np.int32).tobytes().decode("utf-32-le")
    assert text.count("### user: a") == 1 and last == [1, 3, 0, -1]
    for k in last[:3]:
        chain, up = [], k
        while up >= 0:
            chain.append(nodes[up])
            up = nodes[up]["parent"]
        assert "".join(text[a:b] for a, b in nodes[k]["attends"]) == "".join(text[n["begin"] : n["end"]] for n in reversed(chain))
        assert nodes[k]["position"] == sum(n["end"] - n["begin"] for n in chain[1:])
    assert [text[slice(*nodes[k]["loss"])] for k in (1, 2)] == ["b", "c"]


def test_long_turns_are_parsed_without_a_pattern():
    turns = [("us:er\\", "x" * 3_000_000 + "\\ </turn>\n### a: "), ("", ""), ("\\:", " </turn>")]
    assert chat.parse_turns("".join(chat.format_turn(*t) for t in turns)) == turns
    with pytest.raises(ValueError):
        chat.parse_turns("### user: open")


def test_substring_dedup_tells_windows_apart_by_hash_and_check():
    import pyarrow as pa
    from tidemark.llm import substring_dedup

    def row(doc, key, check):
        combiner = substring_dedup.Combiner(True)
        combiner.add(doc, np.array([key], np.uint64), np.array([check], np.int32))
        return combiner.flush()

    def gone(*rows):
        met = pa.Table.from_batches([row(*r) for r in rows]).combine_chunks().to_batches()[0]
        return substring_dedup.Comparer(True).take(met).column(0).to_pylist()

    assert gone((1, 5 << 32, 7), (2, (5 << 32) + 1, 7)) == [] == gone((1, 5 << 32, 7), (2, 5 << 32, 8))
    assert gone((1, 5 << 32, 7), (2, 5 << 32, 7)) == [2]


def test_substring_dedup_holds_one_row_of_a_hot_window_over_batches():
    from tidemark.llm import substring_dedup

    comparer, found = substring_dedup.Comparer(False), []
    for doc in range(50):  # each batch is one document with the same window
        combiner = substring_dedup.Combiner(False)
        combiner.add(doc, np.array([9], np.uint64), np.zeros(1, np.int32))
        found += comparer.take(combiner.flush()).column(0).to_pylist()
    assert sorted(found) == list(range(50)) and comparer.open[2] == 0


def test_substring_dedup_levels(spark, corpus):
    from tidemark.llm import substring_dedup

    assert [substring_dedup.window_lengths(n) for n in (5, 13, 50)] == [[5], [7, 13], [7, 13, 25, 50]]
    found = remove_repeated(documents(spark, corpus), 30).collect()  # three levels
    assert Counter(map(tuple, found)) == Counter(brute_removed(corpus, 30))
    with pytest.raises(TypeError):
        remove_repeated(documents(spark, corpus), id_col="id")


def test_keep_one_keeps_columns_of_any_name(spark):
    schema = "doc_id bigint, text string, _copy bigint, _row_key string, key string, row string, rank string"
    docs = spark.createDataFrame([(1, "a", 66, "x", "k", "r", "n"), (2, "a", 77, "y", "k2", "r2", "n2"), (3, "b", 5, "z", "k3", "r3", "n3"), (3, "b", 4, "z", "k3", "r3", "n3")], schema)
    kept = keep_one(docs, exact_dedup(docs)).collect()
    assert sorted(map(tuple, kept)) == [(2, "a", 77, "y", "k2", "r2", "n2"), (3, "b", 4, "z", "k3", "r3", "n3")]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_of_a_hot_text(spark, keep):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 700) END AS text").repartition(9)
    rows = exact_dedup(docs, keep=keep).collect()
    by = defaultdict(list)
    for k in range(4000):
        by["hot" if k % 3 == 0 else f"t{k % 700}"].append(k)
    best = {"max": max, "min": min}[keep]
    want = {i: (best(ids), len(ids), i == best(ids)) for ids in by.values() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == want and len(rows) == 4000


def test_exact_dedup_merges_sorted_runs(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") > 8


def test_more_than_127_languages():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(4, 200)).astype(np.float32)
    scores[:, 150] += 50
    assert [x.tolist() for x in language_id.viterbi([scores], 6.0)] == [[150] * 4]


def test_toxicity_keeps_other_scripts():
    assert toxicity.fold("дурак жизнь 你好 плохой") == " дурак жизнь 你好 плохои "
    assert toxicity.fold("zzbаdwоrd zzb4dw0rd Größe") == " zzbadword zzbadword grosse "


def test_toxicity_in_another_script(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("бвгджзиклмнпрст", k=6)) for _ in range(200)]
    rows, labels = [], []
    for k in range(300):
        text = rng.choices(words, k=30)
        if k % 4 == 0:
            text[7] = "гадостный"
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0), "x"))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, id string")
    model = toxicity.learn_toxicity(docs, marks, F.col("id") % 5 != 0)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in toxicity.score_toxicity(docs, model).collect())


def test_exceptions_are_found_by_search():
    model = toxicity.ToxicityModel({" bad ": 1.0, " ugl": 2.0}, [" bad debt ", " not bad "])
    automaton = model.automaton()
    rng = random.Random(4)
    for _ in range(200):
        t = " " + " ".join(rng.choices(["bad", "debt", "not", "ugly", "ugl", "x"], k=12)) + " "
        want = []
        for term, w in model.weights.items():
            for b in range(len(t)):
                e = b + len(term)
                if t.startswith(term, b) and not any(t.startswith(p, x) and x <= b and e <= x + len(p) for p in model.exceptions for x in range(len(t))):
                    want.append((b, e, w))
        assert toxicity.matches(t, automaton) == sorted(want)
    import time

    began = time.time()
    toxicity.matches(" bad debt" * 60_000 + " ", automaton)
    assert time.time() - began < 20


def test_many_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    pages = spark.createDataFrame([(k, f"u{k}", f"{k} " * 300) for k in range(120)], "page_id bigint, url string, html string")
    folder = shared_path(spark, "warc-many")
    archives = warc.write_warc(pages.repartition(4), folder)
    read = warc.read_warc(archives, folder)
    assert archives.count() > 20 and read.rdd.getNumPartitions() == archives.count()
    assert read.filter("record_type = 'response'").count() == 120


def test_warc_takes_ids_of_any_type(spark):
    pages = spark.createDataFrame([("b", "u", "same"), ("a", "u", "same"), ("c", "u", None)], "page_id string, url string, html string")
    folder = shared_path(spark, "warc-text")
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(pages, folder), folder).collect()}
    assert found == {("b", "response", None), ("a", "revisit", "b"), ("c", "response", None)}


def test_large_blocks_are_numbered_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 10)
    monkeypatch.setattr(sharding, "MOST", 3)
    docs = spark.range(500).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    rows = sharding.uniform_shards(docs, shards=7).collect()
    for s in range(7):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (71, 72)


def test_long_pieces_are_merged_in_rounds():
    ranks = byte_bpe.read_ranks(RANKS)
    vocabulary = byte_bpe.Vocabulary(ranks)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    for k in range(300):
        piece = "".join(rng.choices(["ab", "aaaaab", "abcdefghijklmnopqrstuvwxyz", "the and ing", "=- ", "а你éx"][k % 6], k=rng.randint(2, 600))).encode()
        want = library._core_bpe.encode_single_piece(piece)
        assert vocabulary.merge_wide(vocabulary.byte_id[np.frombuffer(piece, np.uint8)]).tolist() == want
        assert np.frombuffer(vocabulary.encode_pieces([piece])[0], np.int32).tolist() == want


def test_hot_fingerprints_and_a_hot_centre(spark):
    links = spark.range(1, 3000).selectExpr("id AS u", "0L AS v").unionByName(spark.createDataFrame([(5000, 6000)], "u bigint, v bigint"))
    found = {(r.node, r.root) for r in simhash.components(links).collect()}
    assert found == {(k, 0) for k in range(1, 3000)} | {(6000, 5000)}
    docs = spark.range(600).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a b c d' END AS text", "'x' AS part")
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()} == {(k, k % 2) for k in range(600)}


def test_a_null_id_is_not_the_text_null(spark):
    rows = spark.createDataFrame([("null", "one payload", 4), (None, "one payload", 3), ("a", "other", 1), (None, "lone", 2)], "doc_id string, text string, n int")
    kept = keep_one(rows, exact_dedup(rows))
    assert {(r.doc_id, r.n) for r in kept.collect()} == {("null", 4), ("a", 1), (None, 2)}
    folder = shared_path(spark, "warc")
    pages = rows.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(pages, folder), folder).collect()}
    assert found == {("null", "response", None), (None, "revisit", "null"), ("a", "response", None), (None, "response", None)}


def test_long_shared_conversations_take_one_round(spark):
    """Seventy conversations of a hundred equal turns, some that go on or stop before: a stem, not a hundred."""
    said = [("user" if k % 2 == 0 else "assistant", f"turn {k} ok") for k in range(100)]
    own = {c: said if c < 70 else said[:40] + [("user", f"other {c % 3}")] for c in range(140)} | {200: said[:100] + [("user", "more")], 201: said[:7]}
    rows = [(c, k, r, t) for c, turns in own.items() for k, (r, t) in enumerate(turns)]
    packs = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).cache()
    stems = [p for p in packs.collect() if not p.conversations]
    assert len(stems) <= 4 and sorted(len(p.nodes) for p in stems)[:1] == [7]
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_conversations(packs).collect()}
    assert back == {c: (turns, "".join(t for r, t in turns if r == "assistant")) for c, turns in own.items()}
    packs.unpersist()
