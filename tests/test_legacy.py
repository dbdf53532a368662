import pytest

from tidemark.sources.legacy import PREFIXES, TIMESHIFT, taken_apart


@pytest.mark.parametrize(
    ("pattern", "names"),
    [
        (r"(?i)^(?:A\s+B|A\s*B|C\+)\s*$", ["A B", "C+"]),
        (r"^" + TIMESHIFT + PREFIXES + r"(?:[A-Za-z0-9]{1,3}\s+){0,2}News\s*(?:\s*(?:HD|FHD|SD|UHD)x)*$", ["News"]),
        (r"One", ["One"]),
        (r"\[4K\]", ["[4K]"]),
        (r"One|Two", []),
        (r"(?:One|(Two))", []),
        (r"One.*", []),
        (r"(?:One|)", []),
        ("One\\", []),
        ("", []),
    ],
)
def test_names(pattern, names):
    found = taken_apart(pattern)
    assert found["aliases"] == names
    assert bool(found["reason"]) == (not names)


def test_guards():
    found = taken_apart(r"(?i)^(?!\s*(?:AU|n\.z)\s*(?:[:|]|\s))" + TIMESHIFT + PREFIXES + "One")
    assert (found["regions"], found["timeshift"], found["radio"]) == (["AU", "N.Z"], True, True)
