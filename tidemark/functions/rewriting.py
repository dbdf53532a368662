"""Search and replace patterns of logins, in the regex dialect of the JVM.

Patterns arrive in two spellings of groups, ``$1``/``$<name>`` and ``\\1``/``\\g<name>``, and are few: one pair a login.
They are translated once, row by row; URLs are then rewritten by a built-in function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SEARCH = re.compile(r"(?P<open>\(\?P?<(?P<name>[A-Za-z_]\w*)>)|(?P<back>\(\?P=(?P<back1>\w+)\)|\\k<(?P<back2>\w+)>)|(?P<escape>\\.)|(?P<set>\[\^?\]?)|(?P<end>\])|(?P<amp>&&)|(?P<other>.)", re.S)
REPLACE = re.compile(r"\$(?P<n1>\d{1,2})|\$<(?P<name1>[A-Za-z_]\w*)>|\\g<(?P<name2>[A-Za-z_]\w*)>|\\g<(?P<n2>\d{1,2})>|\\(?P<n3>[1-9]\d?)|(?P<slash>\\\\)|(?P<bad>\\)|(?P<plain>[^\\$]+|\$)", re.S)


def _jvm_name(name: str) -> str:
    """Names of groups may hold letters and digits alone there."""
    return "g" + name.replace("_", "0u0")


def jvm_search(pattern: str) -> str | None:
    """The pattern for the JVM; None where it is empty or does not compile."""
    plain, out, in_set = "", "", False
    for m in SEARCH.finditer(pattern):
        text, kind = m[0], m.lastgroup
        if in_set:
            in_set = text != "]"
            plain += text
            out += "\\" + text[0] + "\\" + text[1:] if kind == "amp" else "\\" + text if text.startswith("[") else text
        elif m["name"]:
            plain, out = plain + f"(?P<{m['name']}>", out + f"(?<{_jvm_name(m['name'])}>"
        elif m["back"]:
            name = m["back1"] or m["back2"]
            plain, out = plain + f"(?P={name})", out + f"\\k<{_jvm_name(name)}>"
        else:
            in_set = kind == "set"
            plain += text
            out += text[:-1] + "\\]" if in_set and text.endswith("]") else text
    try:
        re.compile(plain)
    except (re.error, OverflowError):
        return None
    return out if pattern else None


def jvm_replacement(text: str, groups: int, names: set[str]) -> str | None:
    """The replacement for the JVM; None for an escape that has no meaning. References to no group stay as text."""
    out = ""
    for m in REPLACE.finditer(text):
        number, name = m["n1"] or m["n2"] or m["n3"], m["name1"] or m["name2"]
        if m["bad"]:
            return None
        if number:
            known = 1 <= int(number) <= groups or len(number) == 2 and 1 <= int(number[0]) <= groups
            out += f"${number}" if known else f"\\${number}"
        elif name:
            out += f"${{{_jvm_name(name)}}}" if name in names else "" if names else f"\\$<{name}>"
        else:
            out += "\\\\" if m["slash"] else m["plain"].replace("$", "\\$")
    return out


def _pair(search: str | None, replace: str | None) -> tuple[str | None, str | None]:
    found = jvm_search(search or "")
    if found is None:
        return None, None
    names = set(re.findall(r"\(\?P?<([A-Za-z_]\w*)>", search))
    groups = re.compile(re.sub(r"\\k<(\w+)>", r"(?P=\1)", re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", search))).groups
    made = jvm_replacement(replace or "", groups, names)
    return (None, None) if made is None else (found, made)


@F.pandas_udf(StructType([StructField("search", StringType()), StructField("replace", StringType())]))
def jvm_pair(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for search, replace in batches:
        yield pd.DataFrame([_pair(s, r) for s, r in zip(search, replace, strict=True)], columns=["search", "replace"], dtype=object)


def rewritten(url: Column, pair: Column) -> Column:
    """url with the pair's pattern replaced everywhere; null where the pair is unusable."""
    return F.when(pair["search"].isNotNull(), F.regexp_replace(url, pair["search"], pair["replace"]))
