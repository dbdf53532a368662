"""Needles, patterns and searches over the index of grams, against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.names import country_codes
from tidemark.operators import grams, matching

WORDS = ["Sport", "News", "ring", "HD", "4K", "Kids+", "Ciné", "RTL", "x", "1080p", "US:", "(Backup)", "Ö3", "A&E", "fox"]


@pytest.fixture(scope="module")
def known(spark):
    rng = random.Random(6)
    names = [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(300)] + ["", "+", "ring", "String", "ringing", "a.b", None]
    rows = [(k, n, k % 3, k % 5) for k, n in enumerate(names)]
    streams = spark.createDataFrame(rows, "stream_id bigint, name string, provider_id bigint, group_id bigint").repartition(3)
    return matching.Catalogue.of(streams, country_codes(spark))


@pytest.mark.parametrize("split", [50_000, 20])
def test_needles(spark, known, monkeypatch, split):
    monkeypatch.setattr(grams, "SPLIT", split)
    index = matching.name_index(known.streams)
    texts = ["ring", "RING", "hd", "x", "+", "kids+", "a&e", "sport news", "no such", "o", "é", "fox hd", "", "."]
    needles = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, "ring")], "channel_id bigint, text string")
    found = {(r.channel_id, r.stream_id) for r in matching.by_needle(needles, known.streams, index).select("channel_id", "stream_id").collect()}
    clean = {r.stream_id: (r.clean or "").lower() for r in known.streams.collect()}
    want = {(k, i) for k, t in [*enumerate(texts), (99, "ring")] if t for i, c in clean.items() if re.search(f"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])", c)}
    assert found == want and want


def test_patterns(spark, known):
    patterns = [(1, 0, "(?i)ring", None), (2, 1, "^US:", [1]), (3, 2, "(Sport|News) HD", None), (4, 3, r"\d{4}p$", [0, 2]), (5, 4, ".*", None), (6, 5, "(?:fox)+ ?4K", None), (1, 6, "(?i)ring", [2]), (7, 7, "[Rr]ing", None)]
    found = {(r.channel_id, r.step, r.stream_id) for r in matching.by_pattern(patterns, known.streams, known.index).collect()}
    rows = [(r.stream_id, r.name, r.provider_id) for r in known.streams.select("stream_id", "name", "provider_id").collect()]
    want = {(c, s, i) for c, s, p, only in patterns for i, n, provider in rows if n is not None and re.search(p, n) and (only is None or provider in only)}
    assert found == want


def test_many_patterns_have_one_plan(spark, known):
    plan = lambda n: matching.by_pattern([(k, k, f"(?i)word{k}.*hd", None) for k in range(n)], known.streams, known.index)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(3) == plan(600)


def test_search(spark, known):
    for needle in ("ring", "HD", "x", "news hd", "Kids+", "é"):
        found = {r.stream_id for r in matching.having(known, needle).collect()}
        key = spark.range(1).select(matching.match_key(F.lit(needle))).first()[0]
        want = {r.stream_id for r in known.streams.collect() if (r.key is not None and key in r.key) or (r.name is not None and needle.lower() in r.name.lower())}
        assert found == want, needle


def test_letters_that_patterns_require():
    runs = lambda p: [r for r in grams.required_runs(p)]
    assert runs("(?i)^us: .*ring") == ["us", "ring"] and runs("a|b") == [] and runs("(abc)+d?ef") == ["abc", "ef"]
    assert runs("x{0,3}hello") == ["hello"] and runs("(") == [] and runs(r"\p{L}abc") == [] and runs("[a-z]+") == [] and runs("(?!abc)def") == ["def"]
    assert grams.run_grams(["ring", "us"]) == ["ing", "rin"]


def test_a_catalogue_is_kept_while_its_files_are(spark, tmp_path):
    at = str(tmp_path / "streams")
    row = lambda *names: spark.createDataFrame([(k, n, 1, 1) for k, n in enumerate(names)], "stream_id bigint, name string, provider_id bigint, group_id bigint")
    row("one").write.parquet(at)
    countries = country_codes(spark)
    first = matching.Catalogue.of(spark.read.parquet(at), countries, "streams")
    assert first is matching.Catalogue.of(spark.read.parquet(at), countries, "streams") and first.streams.count() == 1
    row("two", "three").write.mode("append").parquet(at)
    second = matching.Catalogue.of(spark.read.parquet(at), countries, "streams")
    assert second is not first and second.streams.count() == 3


def test_names_are_worked_on_once_however_many_streams_bear_them(spark):
    said = ["US: Sport One HD", "Sport One FHD", "Sport Two", None, "News ring"]
    schema = "stream_id bigint, name string, provider_id bigint, group_id bigint"
    many = spark.createDataFrame([(k, said[k % 5], k % 3, k % 4) for k in range(200)], schema)
    few, known = (matching.Catalogue(d, country_codes(spark)) for d in (many.filter("stream_id < 5"), many))
    assert known.names.count() == few.names.count() == 5
    assert known.index.postings.count() == few.index.postings.count()
    assert sorted((r.stream_id, r.name or "", r.clean) for r in known.streams.collect()) == sorted((r.stream_id, r.name or "", r.clean) for r in matching.prepared(many, country_codes(spark)).collect())
    assert known.streams.count() == 200


def test_claims_of_names_keep_to_groups_and_providers_of_streams(spark):
    said = ["US: Sport One HD", "Sport One FHD", "Sport Two", None, "News ring"]
    rows = [(k, said[k % 5], k % 3, k % 4) for k in range(200)]
    known = matching.Catalogue(spark.createDataFrame(rows, "stream_id bigint, name string, provider_id bigint, group_id bigint"), country_codes(spark))
    rules = spark.createDataFrame([(1, 0, None, None), (2, 10, [0, 1], None), (3, 0, None, None)], "channel_id bigint, step_order bigint, providers array<bigint>, exclude_regions array<string>")
    lines = [(1, "alias", 0, "Sport Two"), (1, "alias", 1, "Sport One"), (1, "exclude", 0, "fhd"), (2, "contains", 0, "sport"), (3, "contains", 0, "ring")]
    lines = spark.createDataFrame(lines, "channel_id bigint, kind string, position bigint, line string")
    patterns = [(2, 3, "Sport", [1, 2]), (3, 4, "(?i)RING", [2]), (3, 0, "News", [0])]
    out = spark.createDataFrame([(2,)], "group_id bigint")
    found = {tuple(r) for r in matching.matched(rules, lines, patterns, known, out, country_codes(spark), []).select("channel_id", "stream_id", "step").collect()}
    want = set()
    for stream, name, provider, group in rows:
        if group == 2 or name is None:
            continue
        if name == "Sport Two":
            want.add((1, stream, 0))
        if name == "US: Sport One HD":
            want.add((1, stream, 1))
        if "Sport" in name and provider < 2:
            want.add((2, stream, 3 if provider == 1 else 10))
        if "ring" in name:
            want.add((3, stream, 0))
    assert found == want
