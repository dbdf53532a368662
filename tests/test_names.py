"""Names, keys and alias lines."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names

CASES = [
    ("USA: HBO East FHD H265", "HBO East", ["USA"], "fhd", 1080, "hevc", [], False),
    ("⁨HBO East⁩ ᴴᴰ", "HBO East", [], "", 0, "", [], False),
    ("HBO +1", "HBO + 1", [], "", 0, "", [], True),
    ("|XX| |SPORT| Movie Network HD", "Movie Network", ["XX", "SPORT"], "hd", 720, "", [], False),
    ("Sports Alpha 1 HD TH MY", "Sports Alpha 1", [], "hd", 720, "", ["TH", "MY"], False),
    ("Sports Alpha 1 HD MY 50FPS TH", "Sports Alpha 1", [], "hd", 720, "", ["TH", "MY"], False),
    ("Sports Alpha 1 TH MY", "Sports Alpha 1 TH MY", [], "", 0, "", [], False),
    ("Discovery ID HD", "Discovery ID", [], "hd", 720, "", [], False),
    ("Sports Alpha MY HD", "Sports Alpha MY", [], "hd", 720, "", [], False),
    ("TNT - HD", "TNT", [], "hd", 720, "", [], False),
    ("BBC One - London HD", "BBC One - London", [], "hd", 720, "", [], False),
    ("UK-FAST: Sci-Fi Channel 2160p", "Sci-Fi Channel", ["UK-FAST"], "uhd", 2160, "", [], False),
    ("Águila (Multi) [b c] 4K HD", "Aguila", [], "hd", 720, "", [], False),
    ("", "", [], "", 0, "", [], False),
    (None, "", [], "", 0, "", [], False),
    ("HD", "", [], "hd", 720, "", [], False),
]


def test_parts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, name string")
    got = names.with_parts(df, "name", names.country_codes(spark)).orderBy("i").collect()
    for r, want in zip(got, CASES, strict=True):
        assert (r.clean, r.prefixes, r.tier, r.height, r.codec, r.regions, r.timeshift) == want[1:], want[0]
    assert got[12].brackets == ["Multi", "b c"]


def test_keys(spark):
    df = spark.createDataFrame([("The Discovery-Channel",), ("THE DISCOVERY CHANNEL",), ("AMC",), ("AMC+",)], "n string")
    a, b, c, d = [r.k for r in df.select(names.match_key(F.col("n")).alias("k")).collect()]
    assert a == b and c == "amc" and d == "amc+"
    r = names.with_keys(names.with_parts(spark.createDataFrame([("US East: News [A b] 4K HEVC",)], "n string"), "n", [])).first()
    assert set(r.quality_keys) == {"uhd", "4k", "2160p", "hevc", "h265", "x265"}
    assert set(r.tail_keys) - set(r.quality_keys) == {"ab", "a", "b"}
    assert set(r.section_keys) == {"us", "useast", "news"}


@pytest.mark.parametrize(
    "line, text, require, reject, tags, no_tags",
    [
        ("@AU beIN Sports", "beIN Sports", ["au"], [], [], []),
        ('@US: @!"New York" CNN ~4K ~!hevc', "CNN", ["us"], ["newyork"], ["4k"], ["hevc"]),
        ("@Home", "@Home", [], [], [], []),
        ('~"event only"', "", [], [], ["eventonly"], []),
        ("", "", [], [], [], []),
    ],
)
def test_alias(spark, line, text, require, reject, tags, no_tags):
    r = names.with_alias(spark.createDataFrame([(line,)], "line string"), "line").first()
    assert (r.text, r.require, r.reject, r.require_tags, r.reject_tags) == (text, require, reject, tags, no_tags)
