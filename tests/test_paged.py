"""The paged data source, exact medians and marks of names, against plain versions."""

import json
import os
import random
import statistics

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import metrics, selection
from tidemark.sources.paged import Paged


def lay_down(at, pages):
    for k, page in enumerate(pages, 1):
        os.makedirs(f"{at}/page={k}")
        with open(f"{at}/page={k}/part.json", "w") as f:
            json.dump(page, f)
        open(f"{at}/page={k}/_SUCCESS", "w").close()


@pytest.fixture(scope="module")
def paged(spark):
    spark.dataSource.register(Paged)
    return spark.read.format("paged")


@pytest.mark.parametrize("with_count", [True, False])
def test_pages_in_order(paged, tmp_path, with_count):
    rows = [{"id": k, "name": f"n{k}", "tags": ["x"]} for k in range(23)]
    pages = [{"results": rows[k : k + 5], "next": "more" if k + 5 < 23 else None} | ({"count": 23} if with_count else {}) for k in range(0, 23, 5)]
    lay_down(tmp_path, pages)
    d = paged.schema("page int, ord int, id bigint, name string, missing string").option("page_size", "5").load(str(tmp_path))
    assert d.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in d.collect()] == [(k // 5 + 1, k % 5, k, f"n{k}", None) for k in range(23)]


def test_whole_rows_bare_lists_and_empty_listings(spark, paged, tmp_path):
    for name, page in (("list", [{"a": 1}, 2]), ("empty", {"results": [], "next": None, "count": 0}), ("none", {"next": None})):
        lay_down(tmp_path / name, [page])
    load = lambda name: [tuple(r) for r in spark.read.format("paged").load(f"file://{tmp_path}/{name}").collect()]
    assert load("list") == [(1, 0, '{"a": 1}'), (1, 1, "2")] and load("empty") == load("none") == []


@pytest.mark.parametrize("bins", [2, 7, selection.BINS])
def test_medians(spark, bins):
    rng = random.Random(9)
    groups = {"a": [5], "b": [1, 2], "c": [7] * 9, "d": [rng.randrange(-(10**12), 10**12) for _ in range(101)], "e": [rng.randrange(50) for _ in range(400)], "f": [0, 10**12]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("g", None)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, v bigint").repartition(3)
    found = {r.g: (r.median, r.most) for r in selection.medians(d, "g", F.col("v"), bins).collect()}
    assert found == {g: (statistics.median(vs), max(vs)) for g, vs in groups.items()}
    assert selection.medians(d.limit(0), "g", F.col("v"), bins).count() == 0


def test_every_mark_of_the_property_goes(spark):
    """Each code point of the Unicode property Diacritic, between letters, leaves no trace; letters stay."""
    marks = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and regex.match(r"\p{Diacritic}", chr(c))]
    assert len(marks) > 900
    d = spark.createDataFrame([(c, f"a{chr(c)}b") for c in marks], "c int, t string")
    odd = {r.c: r.f for r in d.select("c", names.fold(F.col("t")).alias("f")).collect() if regex.search(r"\p{Diacritic}", r.f)}
    assert not odd
    kept = spark.createDataFrame([("Ciné हि",), ("x_y-z",)], "t string").select(names.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in kept] == ["Cine हि", "x_y-z"]


def test_a_page_of_metrics(spark):
    rows = spark.createDataFrame([("q\"1\\", 2.0, "b"), ("a\nb", 0.5, None), ("z", float("nan"), "c")], "p string, v double, s string")
    d = metrics.family(rows, "f", F.col("v"), {"p": F.col("p"), "s": F.col("s")}).unionByName(metrics.family(rows.limit(1), "up", F.lit(1), {}))
    found = [r.line for r in metrics.page(d, {"up": ("gauge", "Up."), "f": ("counter", "Some."), "none": ("gauge", "-")}).orderBy("line_no").collect()]
    assert found == ["# HELP up Up.", "# TYPE up gauge", "up 1", "# HELP f Some.", "# TYPE f counter", 'f{p="a\\nb",s=""} 0.5', 'f{p="q\\"1\\\\",s="b"} 2']


def test_a_page_reads_its_samples_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(k, k % 2) for k in range(10)], "p bigint, v bigint").mapInPandas(counted, "p bigint, v bigint")
    d = metrics.families(rows, [("f", F.col("v"), {"p": F.col("p")}), ("g", F.when(F.col("v") > 0, F.col("p")), {"p": F.col("p")})])
    about = {"f": ("gauge", "F."), "g": ("gauge", "G.")}
    assert metrics.page(d, about).count() == 2 + 10 + 2 + 5 and seen.value == 10


def test_counts_of_providers_are_those_of_histograms_and_leads(spark):
    best = spark.createDataFrame([(1, 5, True, False, 900, 1080, True), (2, 5, False, False, 0, 720, False), (3, 5, True, False, 100, 480, False)], "stream_id bigint, probed_at bigint, alive boolean, black boolean, bitrate_kbps bigint, height bigint, usable boolean")
    catalogue = spark.createDataFrame([(1, 0, 1, 7), (2, 0, 1, 7), (3, 0, 2, 7), (3, 1, 3, 8), (4, 0, 9, 7), (4, 1, 1, 7)], "channel_id bigint, slot bigint, stream_id bigint, provider_id bigint")
    known = metrics.provider_streams(catalogue, best)
    counts = {r.provider_id: r.asDict() for r in metrics.provider_counts(known).collect()}
    for column, values in (("state", metrics.STATES), ("resolution", metrics.RESOLUTIONS)):
        for r in metrics.histogram(known, column, values).collect():
            assert counts[r.provider_id][f"{column}_{r[column]}"] == r.streams
    assert {(r.provider_id, r.channels, r.healthy) for r in metrics.rank1(catalogue, best).collect()} == {(7, 4, 2)}
    assert (counts[7]["channels"], counts[7]["healthy"], counts[8]["channels"], counts[8]["healthy"]) == (4, 2, None, None)
