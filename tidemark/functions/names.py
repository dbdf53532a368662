"""Noisy stream names taken apart: sections in front, quality and market tags behind, and keys to compare them by.

All of it is column expressions. A name's tail is read through a string with one letter a word (K a known tag, C a country
code, E an empty token, N anything else), so that "the longest tail of tags" is a regular expression and no loop is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of quality (tier, height), codec, audio and others, as names spell them.
QUALITY = {"UHD": ("uhd", 2160), "4K": ("uhd", 2160), "FHD": ("fhd", 1080), "HD": ("hd", 720), "SD": ("sd", 480), "LQ": ("sd", 360)}
CODEC = {"hevc": ["HEVC", "H265", "H.265", "X265"], "h264": ["AVC", "H264", "H.264", "X264"]}
FLAGS = ["AAC", "AC3", "DTS", "DD", "DD+", "ATMOS", "2.0", "5.1", "7.1", "RAW", "MULTI", "HDR", "VIP", "BACKUP", "ALT"]
DECORATION = "[¹²³ʰ-˿ᴬ-ᶿ⁰-₟⁦-⁩]+"
# Words of a whole name that tell its tier, the best tier first.
TIER_WORDS = {"uhd": "UHD|4K|2160P|2160I", "fhd": "FHD|1080P|1080I", "hd": "HD|720P|720I", "sd": "SD|LQ|576P|576I|480P|480I|360P"}
# Brackets, and tags that are a number of lines or of frames a second.
BRACKETED = r"\[[^\]]*\]|\([^)]*\)"
RESOLUTION, RATE = r"^([0-9]{3,4})[PI]$", r"^([0-9]{2,3})FPS$"
# End of fixed values.

DIACRITIC = regex.compile(r"\p{Diacritic}")
#: Words of a section at most, and characters before its separator.
SECTION_WORDS, SECTION_CHARS, SECTIONS = 4, 25, 3


def country_codes(spark: SparkSession) -> list[str]:
    """Two-letter country codes that the JVM knows (ISO 3166-1)."""
    return sorted(spark.sparkContext._jvm.java.util.Locale.getISOCountries())


@lru_cache(maxsize=1)
def marks() -> str:
    """The Unicode property Diacritic as a class of the JVM's patterns, which have no name for it: its ranges, found once by asking for every code point."""
    held = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and DIACRITIC.match(chr(c))]
    starts = [c for k, c in enumerate(held) if not k or held[k - 1] != c - 1]
    ends = [c for k, c in enumerate(held) if k + 1 == len(held) or held[k + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]+"


def fold(text: Column) -> Column:
    """Decoration dropped, then compatibility decomposition, then marks dropped; in this order, so a superscript HD goes."""
    plain = F.regexp_replace(text, DECORATION, "")
    loose = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), plain, F.lit(True))
    # ASCII needs no decomposition; most names are that.
    return F.regexp_replace(F.when(plain.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(loose), marks(), "")


def match_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(fold(text)), "[^a-z0-9+]+", "")


def tier_of(name: Column) -> Column:
    """The tier that a raw name says anywhere, between anything but letters and digits in front and letters behind."""
    says = lambda t: F.upper(name).rlike(f"(^|[^A-Z0-9])({TIER_WORDS[t]})([^A-Z]|$)")
    return reduce(lambda out, t: out.when(says(t), t), list(TIER_WORDS)[1:], F.when(says("uhd"), "uhd")).otherwise("unknown")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _keys(texts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(texts, match_key), lambda k: k != ""))


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _pick(cases: dict, key: Column) -> Column:
    return reduce(lambda out, kv: out.when(key == kv[0], F.lit(kv[1])), list(cases.items())[1:], F.when(key == next(iter(cases)), F.lit(next(iter(cases.values())))))


def with_parts(df: DataFrame, name: str, countries: list[str]) -> DataFrame:
    """df with `clean`, `prefixes`, `brackets`, `regions`, `timeshift`, `tier`, `height`, `codec`, `fps` and `flags` of a name.

    A null name counts as empty. A trailing country code is a market tag only where a known tag stands to its left.
    """
    d = df
    for batch in _part_steps(df.sparkSession, name, tuple(countries)):
        d = d.withColumns(batch)
    return d.select(*df.columns, "clean", "prefixes", "brackets", "regions", "timeshift", "tier", "height", "codec", "fps", "flags")


@lru_cache(maxsize=8)
def _part_steps(spark: SparkSession, name: str, countries: tuple[str, ...]) -> list[dict[str, Column]]:
    """The columns of with_parts, in batches that each read those before. They are the same for every table, so a session builds them once."""
    steps: list[dict[str, Column]] = [{}]
    add = lambda column, value: steps[-1].__setitem__(column, value)
    then = lambda: steps.append({})
    add("_folded", fold(F.coalesce(F.col(name), F.lit(""))))
    add("prefixes", F.array().cast("array<string>"))
    then()
    inner = F.transform(F.regexp_extract_all("_folded", F.lit(f"({BRACKETED})")), lambda b: F.trim(F.substring(b, F.lit(2), F.length(b) - 2)))
    add("brackets", F.filter(inner, lambda b: b != ""))
    add("_text", F.regexp_replace("_folded", BRACKETED, " "))
    then()
    add("timeshift", F.col("_text").rlike(r"\+\s*[0-9]"))
    for k in range(SECTIONS):
        add(f"_t{k}", F.regexp_replace("_text", r"^[\s:|]+", ""))
        then()
        t = F.col(f"_t{k}")
        add(f"_h{k}", F.regexp_extract(t, r"^([^:|]*?)\s*[:|]", 1))
        then()
        head = F.col(f"_h{k}")
        ok = (head != "") & (F.length(head) <= SECTION_CHARS) & (F.size(F.split(head, r"\s+")) <= SECTION_WORDS)
        add("prefixes", F.when(ok, F.array_append("prefixes", head)).otherwise(F.col("prefixes")))
        add("_text", F.when(ok, F.regexp_replace(t, r"^[^:|]*?\s*[:|]\s*", "")).otherwise(t))
        then()
    add("_words", words(F.regexp_replace("_text", r"\+", "+ ")))
    then()
    add("_tokens", F.transform("_words", lambda w: F.upper(F.regexp_replace(w, r"^[.,\-_]+|[.,\-_]+$", ""))))
    codecs = {spelling: codec for codec, spellings in CODEC.items() for spelling in spellings}
    known: Callable[[Column], Column] = lambda t: t.isin(*QUALITY, *codecs, *FLAGS) | t.rlike(RESOLUTION) | t.rlike(RATE)
    kind = lambda t: F.when(t == "", "E").when(known(t), "K").when(t.isin(*countries), "C").otherwise("N")
    then()
    add("_kinds", F.array_join(F.transform("_tokens", kind), ""))
    then()
    add("_tail", F.regexp_extract("_kinds", "([KCE]*)$", 1))
    then()
    add("_from", F.length("_kinds") - F.length("_tail"))
    then()
    add("_till", F.col("_from") + F.length(F.regexp_extract("_tail", "^([CE]*)", 1)))
    said = F.filter("_words", lambda w, i: (i < F.col("_from")) | ((i < F.col("_till")) & (F.substring(F.col("_kinds"), i + 1, F.lit(1)) == "C")))
    then()
    tidy = F.regexp_replace(F.array_join(said, " "), r"^[\s\-_.]+|[\s\-_.]+$", "")
    add("clean", F.regexp_replace(tidy, r"\s+", " "))
    add("_tags", F.slice("_tokens", F.col("_till") + 1, F.greatest(F.size("_tokens") - F.col("_till"), F.lit(0))))
    # Runs of market tags come from the last one on, each in its own order.
    before = lambda i: F.length(F.regexp_replace(F.substring(F.col("_kinds"), F.lit(1), i), "[^K]", ""))
    runs = F.transform("_words", lambda w, i: F.struct((-before(i)).alias("run"), i.alias("i"), w.alias("w"), F.substring(F.col("_kinds"), i + 1, F.lit(1)).alias("k")))
    at = F.filter(runs, lambda r: (r["i"] >= F.col("_till")) & (r["k"] == "C"))
    add("regions", F.transform(F.array_sort(at), lambda r: r["w"]))
    then()
    add("_size", _last(F.filter("_tags", lambda t: t.isin(*QUALITY) | t.rlike(RESOLUTION))))
    then()
    lines = F.regexp_extract("_size", RESOLUTION, 1).try_cast("bigint")
    add("height", F.coalesce(_pick({k: v[1] for k, v in QUALITY.items()}, F.col("_size")).cast("bigint"), lines, F.lit(0).cast("bigint")))
    ladder = F.when(lines >= 2000, "uhd").when(lines >= 1000, "fhd").when(lines >= 700, "hd").when(lines.isNotNull(), "sd")
    add("tier", F.coalesce(_pick({k: v[0] for k, v in QUALITY.items()}, F.col("_size")), ladder, F.lit("")))
    codec = F.transform(F.filter("_tags", lambda t: t.isin(*codecs)), lambda t: _pick(codecs, t))
    rates = F.filter(F.transform(F.filter("_tags", lambda t: t.rlike(RATE)), lambda t: F.regexp_extract(t, RATE, 1).cast("bigint")), lambda x: x > 0)
    add("codec", F.coalesce(_last(codec), F.lit("")))
    add("fps", F.coalesce(_last(rates), F.lit(0).cast("bigint")))
    add("flags", F.array_sort(F.array_distinct(F.filter("_tags", lambda t: t.isin(*FLAGS)))))
    return steps


def with_keys(parts: DataFrame) -> DataFrame:
    """Parts with `key`, `quality_keys` (all spellings of the tags), `tail_keys` (and of the brackets) and `section_keys`."""
    columns = _key_columns(parts.sparkSession)
    return parts.withColumns({c: columns[c] for c in ("key", "quality_keys")}).withColumns({c: columns[c] for c in ("tail_keys", "section_keys")})


@lru_cache(maxsize=8)
def _key_columns(spark: SparkSession) -> dict[str, Column]:
    """The columns of with_keys, which a session builds once."""
    none = F.array().cast("array<string>")
    of_tier = {t: [s for s, v in QUALITY.items() if v[0] == t] for t in ("uhd", "fhd", "hd", "sd")}
    tier = reduce(lambda rest, kv: F.when(F.col("tier") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), of_tier.items(), none)
    codec = reduce(lambda rest, kv: F.when(F.col("codec") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), CODEC.items(), none)
    tag = lambda c, unit: F.when(F.col(c) > 0, F.array(F.concat(F.col(c).cast("string"), F.lit(unit)))).otherwise(none)
    spelled = F.concat(tier, tag("height", "p"), codec, tag("fps", "fps"), F.col("flags"))
    bracket = F.concat(F.col("brackets"), F.flatten(F.transform("brackets", words)))

    def starts(text: Column) -> Column:
        w = words(text)
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(w), F.lit(SECTION_WORDS))), lambda i: F.array_join(F.slice(w, 1, i), " "))).otherwise(none)

    sections = F.concat(F.flatten(F.transform("prefixes", starts)), F.col("regions"), starts(F.col("clean")))
    return {
        "key": match_key(F.col("clean")), "quality_keys": _keys(spelled), "tail_keys": F.array_union("quality_keys", _keys(bracket)), "section_keys": _keys(sections),
    }


def with_alias(lines: DataFrame, line: str) -> DataFrame:
    """Lines of rules with `text` and what it is narrowed by: `require`, `reject` (@X, @!X in front), `require_tags`, `reject_tags` (~X, ~!X behind)."""
    d = lines.withColumn("_line", F.trim(F.coalesce(F.col(line), F.lit(""))))
    d = d.withColumn("_head", F.regexp_extract("_line", r'^((?:@!?(?:"[^"]+"|\S+)\s+)*)', 1))
    d = d.withColumn("_rest", F.substring(F.col("_line"), F.length("_head") + 1, F.length("_line")))
    d = d.withColumn("_tail", F.regexp_extract("_rest", r'((?:(?:^|\s+)~!?(?:"[^"]+"|\S+))*)$', 1))
    d = d.withColumn("text", F.trim(F.substring(F.col("_rest"), F.lit(1), F.length("_rest") - F.length("_tail"))))
    front = F.regexp_extract_all("_head", F.lit(r'(@!?(?:"[^"]+"|\S+))\s'))
    back = F.regexp_extract_all("_tail", F.lit(r'(~!?(?:"[^"]+"|\S+))'))
    for name, found, no in [("require", front, False), ("reject", front, True), ("require_tags", back, False), ("reject_tags", back, True)]:
        marks = (lambda q: F.substring(q, 2, 1) == "!") if no else (lambda q: F.substring(q, 2, 1) != "!")
        d = d.withColumn(name, _keys(F.filter(found, marks)))
    return d.drop("_line", "_head", "_rest", "_tail")
