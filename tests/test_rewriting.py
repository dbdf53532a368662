import pytest

from tidemark.functions.rewriting import _pair, jvm_pair, rewritten

URL = "http://a.example/live/user/pass/12.ts"


@pytest.mark.parametrize(
    ("search", "replace", "want"),
    [
        ("user/pass", "u2/p2", "http://a.example/live/u2/p2/12.ts"),
        ("(user)/(pass)", "$2/$1", "http://a.example/live/pass/user/12.ts"),
        ("(user)/(pass)", r"\2/\g<1>", "http://a.example/live/pass/user/12.ts"),
        ("(?P<one_name>user)/pass", r"\g<one_name>/x", "http://a.example/live/user/x/12.ts"),
        ("(?<one>user)/pass", "$<one>/$&$$", "http://a.example/live/user/$&$$/12.ts"),
        ("(?P<s>s)(?P=s)", "SS", "http://a.example/live/user/paSS/12.ts"),
        ("user", "$3", "http://a.example/live/$3/pass/12.ts"),
        ("[[u]ser", "x", "http://a.example/live/x/pass/12.ts"),
        ("nothing", "x", URL),
        ("user", r"\\", "http://a.example/live/\\/pass/12.ts"),
        ("user", r"\q", None),
        ("", "x", None),
        ("(user", "x", None),
        (None, None, None),
    ],
)
def test_patterns(spark, search, replace, want):
    df = spark.createDataFrame([(URL, search, replace)], "url STRING, search STRING, replace STRING")
    found = df.withColumn("pair", jvm_pair("search", "replace"))
    assert found.select(rewritten(found["url"], found["pair"])).first()[0] == want


def test_bad_pairs_give_nothing():
    assert _pair("user", "\\") == (None, None)
