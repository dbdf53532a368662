"""Which streams the rules of channels claim, and at which step.

Names and rules meet by equi-joins: whole names by key, names with an inline section by (section, rest), needles and patterns by their rarest
gram. Joins carry ids; what a rule says besides is a filter on the pairs found. All that depends on a name alone is done once for each distinct name;
streams come in last, by the id of their name. Nothing grows with streams times rules but what is claimed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import SECTION_WORDS, match_key, with_alias, with_keys, with_parts, words
from tidemark.operators import grams
from tidemark.sources.scratch import written

SPEC = ["require", "reject", "require_tags", "reject_tags"]


def taken_apart(streams: DataFrame, countries: list[str]) -> DataFrame:
    """The distinct names of streams with their parts and keys.

    They are dealt over all cores first: they are few bytes, and taking them apart costs far more than moving them.
    """
    cores = streams.sparkSession.sparkContext.defaultParallelism
    return with_keys(with_parts(streams.select("name").distinct().repartition(cores, "name"), "name", countries))


def by_name(streams: DataFrame, names: DataFrame) -> DataFrame:
    """Streams with what `names` (name, ...) say of their names; null is a name like any other."""
    return streams.join(names.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name"))).drop("_name")


def prepared(streams: DataFrame, countries: list[str]) -> DataFrame:
    """Streams (stream_id, name, provider_id, group_id) with parts and keys of their names."""
    return by_name(streams, taken_apart(streams, countries))


def stored(d: DataFrame) -> DataFrame:
    """Prepared streams or compiled lines, written once, so that joins do not take names apart again."""
    return written(d, "names")


def name_index(names: DataFrame) -> grams.Index:
    """Grams of prepared names: of the names as they are, of their clean names, and of their keys."""
    return grams.indexed(names, {k: F.col(k) for k in ("name", "clean", "key")})


class Catalogue:
    """Distinct names (name_id, name, parts and keys), the streams that bear them, and an index of the names, written when first asked for.

    With a name for what the caller reads, they are kept for the application while the files that it comes from stay as they are.
    """

    _known: dict[tuple, Catalogue] = {}

    def __init__(self, streams: DataFrame, countries: list[str]):
        self._raw, self._countries = streams, countries
        self._names = self._rows = self._index = None

    @classmethod
    def of(cls, streams: DataFrame, countries: list[str], name: str | None = None) -> Catalogue:
        version = file_versions(streams) if name else ()
        if not version:
            return cls(streams, countries)
        at = (streams.sparkSession.sparkContext.applicationId, name, tuple(countries), version)
        if at not in cls._known:
            while len(cls._known) >= 4:
                cls._known.pop(next(iter(cls._known)))
            cls._known[at] = cls(streams, countries)
        return cls._known[at]

    @property
    def names(self) -> DataFrame:
        if self._names is None:
            self._names = stored(taken_apart(self._raw, self._countries).withColumn("name_id", F.monotonically_increasing_id()))
        return self._names

    @property
    def rows(self) -> DataFrame:
        """The streams with the id of their name in its place."""
        if self._rows is None:
            self._rows = written(by_name(self._raw, self.names.select("name", "name_id")).drop("name"), "streams")
        return self._rows

    @property
    def streams(self) -> DataFrame:
        said = [c for c in self.names.columns if c not in ("name", "name_id")]
        return self.bearing(self.names).select(*self._raw.columns, *said)

    @property
    def index(self) -> grams.Index:
        if self._index is None:
            self._index = name_index(self.names)
        return self._index

    def bearing(self, found: DataFrame) -> DataFrame:
        """What was found of names (name_id, ...) for each stream that bears one."""
        return self.rows.join(found, "name_id")


def file_versions(rows: DataFrame) -> tuple:
    """Paths, sizes and times of the files that rows come from; empty where they come from none."""
    spark = rows.sparkSession
    out = []
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def compiled(lines: DataFrame, countries: list[str]) -> DataFrame:
    """Lines of rules (channel_id, kind, position, line) with what they ask for; aliases are keyed like names."""
    d = with_alias(lines, "line")
    keyed = with_parts(d.select("channel_id", "kind", "position", "text", *SPEC), "text", countries)
    return keyed.select("channel_id", "kind", "position", "text", *SPEC, match_key(F.col("clean")).alias("alias_key"), match_key(F.col("text")).alias("tag"))


def by_key(aliases: DataFrame, streams: DataFrame) -> DataFrame:
    """Aliases and the streams whose whole name has their key."""
    return aliases.join(streams, aliases["alias_key"] == streams["key"])


def by_section(aliases: DataFrame, streams: DataFrame) -> DataFrame:
    """Aliases and the streams whose name is a section that the alias requires, then the alias."""
    w = words(F.col("clean"))
    cuts = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.least(F.size(w) - 1, F.lit(SECTION_WORDS)))).otherwise(F.array().cast("array<int>"))
    split = lambda i: F.struct(match_key(F.array_join(F.slice(w, 1, i), " ")).alias("section"), match_key(F.array_join(F.slice(w, i + 1, F.size(w)), " ")).alias("rest"))
    s = streams.withColumn("cut", F.explode(F.transform(cuts, split))).filter((F.col("cut.section") != "") & (F.col("cut.rest") != ""))
    a = aliases.withColumn("section", F.explode("require"))
    return a.join(s, (a["section"] == s["cut.section"]) & (a["alias_key"] == s["cut.rest"])).drop("section", "cut")


def by_needle(needles: DataFrame, streams: DataFrame, index: grams.Index) -> DataFrame:
    """Needles and the streams whose clean name has them between word bounds. Distinct needles find distinct names by their rarest gram."""
    n = needles.withColumn("needle", F.lower("text")).filter("needle <> ''")
    edged = grams.grams(grams.spaced(F.col("needle")))
    asked = n.select(F.col("needle").alias("query")).distinct().withColumn("needle", F.col("query"))
    asked = asked.select("query", F.when(F.size(edged) > 0, edged).otherwise(grams.signs(F.col("needle"))).alias("grams"))
    quoted = F.regexp_replace("query", r"([^a-z0-9\s])", r"\\$1")
    pattern = F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))
    met = grams.candidates(asked, index, "clean").filter(F.rlike(F.lower("said"), pattern))
    return n.join(met, n["needle"] == met["query"]).join(streams, F.col("said") == F.col("clean")).drop("needle", "query", "said")


def patterns_met(patterns: list[tuple[int, int, str, list[int] | None]], names: DataFrame, index: grams.Index) -> DataFrame:
    """names with channel_id, step and providers (only) of each pattern that finds their name; patterns: (channel_id, step, pattern, providers).

    A pattern finds candidates by the rarest gram of the letters that it requires, one that requires none has all names. The plan is one for any number of patterns.
    """
    spark = names.sparkSession
    patterns = sorted({(c, s, p, None if only is None else tuple(only)) for c, s, p, only in patterns}, key=str)
    rows = spark.createDataFrame([(c, s, p, None if only is None else list(only)) for c, s, p, only in patterns], "channel_id bigint, step bigint, pattern string, only array<bigint>")
    texts = sorted({p[2] for p in patterns})
    asked = spark.createDataFrame([(t, grams.run_grams(grams.required_runs(t))) for t in texts], "query string, grams array<string>")
    met = grams.candidates(asked, index, "name").filter(F.rlike("said", F.col("query")))
    return rows.join(met, rows["pattern"] == met["query"]).join(names, F.col("said") == F.col("name")).select(*names.columns, "channel_id", "step", "only")


def admitted(providers: str) -> Column:
    """Whether a list of providers, if there is one, has the stream's."""
    return F.col(providers).isNull() | F.array_contains(providers, F.col("provider_id"))


def by_pattern(patterns: list[tuple[int, int, str, list[int] | None]], streams: DataFrame, index: grams.Index) -> DataFrame:
    """Streams whose raw name a pattern finds, and whose provider it admits; patterns as for patterns_met."""
    none = F.array().cast("array<string>")
    return patterns_met(patterns, streams, index).filter(admitted("only")).select(*streams.columns, "channel_id", "step", *[none.alias(c) for c in SPEC])


def spec_holds() -> Column:
    """No rejected section or tag; any of the required sections, all of the required tags."""
    sections = ~F.arrays_overlap("reject", "section_keys") & ((F.size("require") == 0) | F.arrays_overlap("require", "section_keys"))
    return sections & ~F.arrays_overlap("reject_tags", "tail_keys") & (F.size(F.array_except("require_tags", "tail_keys")) == 0)


def guard_holds(regions: list[str], timeshift: bool = True, radio: bool = True) -> Column:
    """Neither timeshift, nor radio (unless the channel wants radio), nor a denied region that the alias does not name."""
    out = F.lit(True)
    if timeshift:
        out = out & ~F.col("timeshift")
    if radio:
        out = out & (F.col("wants_radio") | ~F.exists("prefixes", lambda p: F.lower(p).startswith("radio")))
    denied = F.coalesce(F.col("exclude_regions"), F.array(*map(F.lit, regions)).cast("array<string>"))
    denied = F.filter(denied, lambda r: ~F.array_contains("require", match_key(r)))
    return out & ~F.arrays_overlap(denied, F.transform("prefixes", lambda p: F.upper(F.trim(p))))


def excluded(hits: DataFrame, excludes: DataFrame, one: str = "stream_id") -> DataFrame:
    """Pairs of channel and stream (or name, by the id that `one` says) among the hits that one of the channel's exclude lines names.

    A line names a stream by its name, by a tag, or, where it has no text, by its tail alone; a blank line names none.
    """
    x = excludes.select(F.col("channel_id").alias("x_channel"), "alias_key", "tag", *SPEC)
    d = hits.select("channel_id", one, "key", "quality_keys", "section_keys", "tail_keys").distinct().join(x, F.col("channel_id") == F.col("x_channel"))
    named = (F.col("alias_key") != "") | (F.col("tag") != "")
    text = ((F.col("key") != "") & (F.col("key") == F.col("alias_key"))) | ((F.col("tag") != "") & F.array_contains("quality_keys", F.col("tag")))
    tail = (F.size("require_tags") > 0) | (F.size("reject_tags") > 0)
    return d.filter(F.when(named, text).otherwise(tail) & spec_holds()).select("channel_id", one).distinct()


def matched(rules: DataFrame, lines: DataFrame, patterns: list, known: Catalogue, excluded_groups: DataFrame, countries: list[str], regions: list[str]) -> DataFrame:
    """channel_id, stream_id and the smallest step at which the channel's rule claims the stream.

    rules: channel_id, step_order, providers and exclude_regions (null: no scope, the global denylist). lines: channel_id, kind
    (alias, contains, exclude), position, line. An alias's step is its place, a needle's comes after all
    aliases, a pattern's is its own. What rules claim are distinct names; the streams that bear them, their groups and providers come in last.
    """
    c = written(compiled(lines, countries), "rules")
    aliases, needles, outs = (c.filter(F.col("kind") == k) for k in ("alias", "contains", "exclude"))
    per = aliases.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_aliases"),
        F.bool_or(F.lower("text").rlike(r"^\s*radio\b") | F.array_contains("require", F.lit("radio"))).alias("wants_radio"),
    )
    r = rules.join(per, "channel_id", "left").fillna({"n_aliases": 0, "wants_radio": False})
    names = known.names
    cols = ["channel_id", "kind", "position", "name_id", *SPEC]
    found = [by_key(aliases, names.select("name_id", "key")).select(cols), by_section(aliases, names.select("name_id", "clean")).select(cols)]
    found.append(by_needle(needles, names.select("name_id", "clean"), known.index).select(cols))
    d = reduce(DataFrame.unionByName, found).withColumns({"step": F.lit(None).cast("bigint"), "only": F.lit(None).cast("array<bigint>")})
    if patterns:
        none = {c: F.array().cast("array<string>") for c in SPEC}
        p = patterns_met(patterns, names.select("name_id", "name"), known.index).withColumns({"kind": F.lit("pattern"), "position": F.lit(0).cast("bigint"), **none})
        d = d.unionByName(p.select(*cols, "step", "only"))
    d = d.join(names.select("name_id", "key", "prefixes", "timeshift", "quality_keys", "tail_keys", "section_keys"), "name_id")
    d = d.join(r, "channel_id").filter(spec_holds() & guard_holds(regions))
    d = d.withColumn("step", F.coalesce("step", F.col("step_order") + F.col("position") + F.when(F.col("kind") == "contains", F.col("n_aliases")).otherwise(0)))
    d = written(d.select("channel_id", "name_id", "step", "providers", "only", "key", "quality_keys", "section_keys", "tail_keys"), "claims")
    best = d.join(excluded(d, outs, "name_id"), ["channel_id", "name_id"], "left_anti").groupBy("channel_id", "name_id", "providers", "only").agg(F.min("step").alias("step"))
    inside = known.rows.join(excluded_groups.select("group_id"), "group_id", "left_anti").select("stream_id", "name_id", "provider_id")
    claimed = inside.join(best, "name_id").filter(admitted("providers") & admitted("only"))
    return claimed.groupBy("channel_id", "stream_id").agg(F.min("step").alias("step"))


def having(known: Catalogue, needle: str) -> DataFrame:
    """Prepared streams with the needle in their key (as a key) or in their raw name; candidates by its rarest gram."""
    one = known.names.sparkSession.range(1)
    key, name = match_key(F.lit(needle)), F.lit(needle)
    asked = {"key": (key, F.contains("said", key)), "name": (name, F.contains(F.lower("said"), F.lit(needle.lower())))}
    met = known.names
    for kind, (text, has) in asked.items():
        texts = grams.candidates(one.select(F.lit(kind).alias("query"), grams.grams(grams.inner(text)).alias("grams")), known.index, kind).filter(has)
        met = met.join(texts.select("said", F.lit(True).alias(f"_by_{kind}")), F.col(kind) == F.col("said"), "left").drop("said")
    return known.bearing(met.filter("_by_key OR _by_name").drop("_by_key", "_by_name")).select(known.streams.columns)


def search_sections(known: Catalogue, needle: str, most: int = 8) -> DataFrame:
    """For each key found: its most frequent prefixes and sections (a report with a top-k), as key, kind, name, streams, place.

    A stream's section is the first word of its first prefix, or of its name without one.
    """
    section = F.get(words(F.coalesce(F.get("prefixes", F.lit(0)), F.col("clean"))), F.lit(0))
    said = [F.transform("prefixes", lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("name"))), F.array(F.struct(F.lit("section").alias("kind"), section.alias("name")))]
    d = having(known, needle).select("key", F.explode(F.concat(*said)).alias("r")).select("key", "r.*").filter(F.coalesce("name", F.lit("")) != "")
    d = d.groupBy("key", "kind", "name").agg(F.count(F.lit(1)).alias("streams"))
    place = F.row_number().over(Window.partitionBy("key", "kind").orderBy(F.desc("streams"), "name"))
    return d.withColumn("place", place).filter(F.col("place") <= most)


def search(known: Catalogue, needle: str) -> DataFrame:
    """Streams whose name has the needle, by key: how many, their providers, three samples and sections.

    Samples are the names of the three smallest ids, taken with a window before grouping; no list of a key's streams is built.
    """
    d = having(known, needle).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("stream_id")))
    out = d.groupBy("key").agg(
        F.count(F.lit(1)).alias("streams"), F.array_join(F.array_sort(F.collect_set(F.col("provider_id").cast("string"))), ",").alias("providers"),
        F.max(F.when(F.col("n") == 1, F.col("name"))).alias("sample_1"), F.max(F.when(F.col("n") == 2, F.col("name"))).alias("sample_2"), F.max(F.when(F.col("n") == 3, F.col("name"))).alias("sample_3"),
    )
    return out


def claimers(found: DataFrame, claims: DataFrame) -> DataFrame:
    """For each key found: its streams, those that a channel claims, and the channels that do; counted in two steps, so no set of a key is built."""
    d = found.select("key", "stream_id").distinct().join(claims.select("stream_id", "channel_id").distinct(), "stream_id", "left")
    streams = d.groupBy("key", "stream_id").agg(F.count("channel_id").alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("streams"), F.count_if(F.col("n") > 0).alias("claimed"))
    channels = d.filter("channel_id IS NOT NULL").select("key", "channel_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("claimers"))
    return streams.join(channels, "key", "left").fillna(0, ["claimers"])
