"""Rules of an older kind, one generated regex after the other, turned into names and guards where that is certain."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tidemark.functions.names import match_key
from tidemark.sources.rules import scope

# Parts that generated patterns are made of, as they stand in the documents.
TIMESHIFT = r"(?!.*\+\s*1(?![0-9]))"
PREFIXES = r"(?:(?!Radio:)[^:|]{1,25}[:|]\s*){0,3}"
QUALITY_TAIL = r"(?:\s*(?:HD|FHD|SD|UHD"
REGIONS = r"\(\?!\\s\*\(\?:(?P<regions>[^)]+)\)\\s\*\(\?:\[:\|\]\|\\s\)\)"
WORDS = r"\(\?:\[A-Za-z0-9\]\{1,\d+\}\\s\+\)\{0,\d+\}"
# Why a pattern gives no names.
NOT_FLAT, NOT_PLAIN = "core is not a flat alternation", "branch is not a plain name: "
# End of fixed values.

HEAD = re.compile(rf"(?:\(\?i\))?\^?(?:{REGIONS})?(?P<timeshift>{re.escape(TIMESHIFT)})?(?P<radio>{re.escape(PREFIXES)})?(?:{WORDS})?")
BARE = re.compile(r"\\.|(?P<bare>[][{}()*+?^$|]|\\\Z)", re.S)
PARTS = StructType(
    [
        StructField("aliases", ArrayType(StringType())),
        StructField("regions", ArrayType(StringType())),
        StructField("timeshift", BooleanType()),
        StructField("radio", BooleanType()),
        StructField("reason", StringType()),
    ]
)


def _bare(text: str) -> list[re.Match]:
    """Places of characters with a meaning that no backslash takes from them."""
    return [m for m in BARE.finditer(text) if m["bare"]]


def _name(branch: str) -> str | None:
    """The plain text that a branch stands for; None where it is not one."""
    spaced = re.sub(r"\\s[*+?]?", " ", branch)
    return None if _bare(spaced) else " ".join(re.sub(r"\\(.)", r"\1", spaced, flags=re.S).split()) or None


def taken_apart(pattern: str) -> dict:
    """Names and guards of a generated pattern; `reason` says why there are no names."""
    head = HEAD.match(pattern)
    regions = [r for part in (head["regions"] or "").split("|") if (r := part.replace("\\", "").strip().upper())]
    out = {"aliases": [], "regions": list(dict.fromkeys(regions)), "timeshift": bool(head["timeshift"]), "radio": bool(head["radio"]), "reason": ""}
    core = pattern[head.end() :].partition(QUALITY_TAIL)[0].removesuffix("$").removesuffix("\\s*").strip()
    grouped = core.startswith("(?:") and core.endswith(")")
    core = core[3:-1] if grouped else core
    bars = [m for m in _bare(core) if m["bare"] == "|"]
    if any(m["bare"] in "()" for m in _bare(core)) or (bars and not grouped):
        return out | {"reason": NOT_FLAT}
    ends = [-1, *(m.start() for m in bars), len(core)]
    branches = [core[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]
    names = [_name(b) for b in branches]
    if None in names:
        return out | {"reason": NOT_PLAIN + branches[names.index(None)][:40]}
    return out | {"aliases": list(dict.fromkeys(names))}


@F.pandas_udf(PARTS)
def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for patterns in batches:
        yield pd.DataFrame([taken_apart(p or "") for p in patterns], columns=PARTS.names)


def patterns(docs: DataFrame) -> DataFrame:
    """Every pattern of the documents' channels with its parts and whether its names can stand for it.

    A pattern bound to providers can only where all patterns of its channel are bound to the same; `bound` is that scope.
    """
    row = "channel_id STRING, name STRING, enabled BOOLEAN, patterns ARRAY<STRUCT<pattern: STRING, m3u_accounts: STRING, step_order: BIGINT>>"
    d = docs.select(F.explode(F.from_json("body", "channels ARRAY<STRING>")["channels"]).alias("row")).select(F.from_json("row", row).alias("r")).select("r.*")
    d = d.select(F.col("channel_id").try_cast("bigint").alias("channel_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.posexplode_outer("patterns").alias("ord", "p"))
    d = d.withColumn("scope", scope(F.col("p.m3u_accounts"))).withColumn("said", F.coalesce(F.to_json("scope"), F.lit("")))
    per = Window.partitionBy("channel_id")
    bound = F.when(F.min("said").over(per) == F.max("said").over(per), F.col("scope"))
    d = d.withColumn("bound", bound).withColumn("parts", F.when(F.col("p").isNotNull(), parts("p.pattern")))
    usable = (F.size("parts.aliases") > 0) & (F.col("scope").isNull() | F.col("bound").isNotNull())
    return d.withColumn("usable", F.coalesce(usable, F.lit(False)))


def converted(found: DataFrame) -> DataFrame:
    """One rule per channel: its names without those that only repeat a key, regions, scope, and the patterns that stay.

    Arrays are as long as a channel's rule is.
    """
    named = found.filter("usable").select("channel_id", "ord", F.posexplode("parts.aliases").alias("nth", "alias"))
    first = F.row_number().over(Window.partitionBy("channel_id", match_key(F.col("alias"))).orderBy("ord", "nth"))
    named = named.withColumn("n", first).filter("n = 1").groupBy("channel_id").agg(F.array_sort(F.collect_list(F.struct("ord", "nth", "alias"))).alias("a"))
    left = F.when(F.col("p").isNotNull() & ~F.col("usable"), F.struct("ord", F.coalesce("p.pattern", F.lit("")).alias("pattern")))
    d = found.groupBy("channel_id", "name", "enabled").agg(
        F.array_sort(F.collect_list(left)).alias("left"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts.regions")))).alias("exclude_regions"), F.max("bound").alias("bound"),
        F.coalesce(F.bool_or("parts.timeshift"), F.lit(False)).alias("timeshift"), F.coalesce(F.bool_or("parts.radio"), F.lit(False)).alias("radio"), F.count("p").alias("patterns"),
    )
    d = d.join(named, "channel_id", "left")
    aliases = F.coalesce(F.transform("a", lambda x: x["alias"]), F.array().cast("array<string>"))
    kept = F.transform("left", lambda x: x["pattern"])
    return d.select("channel_id", "name", "enabled", aliases.alias("aliases"), F.when(F.size(aliases) > 0, F.col("bound")).alias("providers"), "exclude_regions", kept.alias("kept"), "timeshift", "radio", "patterns")


def totals(rules: DataFrame) -> DataFrame:
    """Channels, those with names, those with patterns left, patterns, and the guards that any pattern had."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rules.agg(
        F.count(F.lit(1)).alias("channels"), F.count_if(F.size("aliases") > 0).alias("converted"), F.count_if(F.size("kept") > 0).alias("kept_regex"),
        F.coalesce(F.sum("patterns"), F.lit(0)).alias("patterns"), some("timeshift").alias("exclude_timeshift"), some("radio").alias("exclude_radio"),
    )
