"""Metric families about providers, as rows and as exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.sources.scratch import written

STATES = ["alive", "low_bitrate", "black", "dead", "unmeasured"]
RESOLUTIONS = ["uhd", "fhd", "hd", "sd", "unknown"]


def state(floor_kbps: int = 500) -> Column:
    low = (F.col("bitrate_kbps") > 0) & (F.col("bitrate_kbps") < floor_kbps)
    return F.when(F.col("probed_at").isNull(), "unmeasured").when(~F.col("alive"), "dead").when(F.col("black"), "black").when(low, "low_bitrate").otherwise("alive")


def resolution() -> Column:
    h = F.col("height")
    ladder = F.when(h >= 2160, "uhd").when(h >= 1080, "fhd").when(h >= 720, "hd").when(h > 0, "sd").otherwise("unknown")
    return F.when(F.col("state").isin("dead", "unmeasured"), "unknown").otherwise(ladder)


def provider_streams(catalogue: DataFrame, best: DataFrame) -> DataFrame:
    """Each provider's distinct streams with state, resolution, what is known of them, and how many channels each leads."""
    d = catalogue.groupBy("provider_id", "stream_id").agg(F.count_if(F.col("slot") == 0).alias("led")).join(best, "stream_id", "left")
    return d.withColumn("state", state()).withColumn("resolution", resolution())


def histogram(streams: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of each of the values for each provider, zeros too; one aggregation, then one row a value."""
    per = streams.groupBy("provider_id").agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return per.select("provider_id", F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("streams")) for v in values])).alias("r")).select("provider_id", "r.*")


def provider_counts(streams: DataFrame) -> DataFrame:
    """One row a provider, in one aggregation: streams by state (a column each) and by resolution, the channels that it leads, and those that a usable stream leads; null where it leads none."""
    led = F.sum("led")
    healthy = F.sum(F.when(F.coalesce("usable", F.lit(False)), F.col("led")).otherwise(0))
    counts = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in (("state", STATES), ("resolution", RESOLUTIONS)) for v in values]
    return streams.groupBy("provider_id").agg(*counts, F.when(led > 0, led).alias("channels"), F.when(led > 0, healthy).alias("healthy"))


def bitrate_medians(streams: DataFrame) -> DataFrame:
    """Interpolated median of measured bitrates for each resolution and for all. Spark counts distinct bitrates for it, map-side first; rows are not gathered."""
    d = streams.filter(F.col("bitrate_kbps") > 0).withColumn("resolution", F.explode(F.array(F.lit("all"), "resolution")))
    return d.groupBy("provider_id", "resolution").agg(F.median("bitrate_kbps").alias("median_kbps"))


def ages(streams: DataFrame, now: int) -> DataFrame:
    """Median and greatest age of verdicts; nearly all ages differ, so they are selected by histograms rather than gathered."""
    found = selection.medians(streams, "provider_id", F.lit(now) - F.col("probed_at"))
    return found.select("provider_id", F.col("median").alias("median_age"), F.col("most").alias("oldest_age"))


def rank1(catalogue: DataFrame, best: DataFrame) -> DataFrame:
    """Channels that a provider leads, and how many of those with a stream that is usable."""
    d = catalogue.filter("slot = 0").join(best.select("stream_id", "usable"), "stream_id", "left")
    return d.groupBy("provider_id").agg(F.count(F.lit(1)).alias("channels"), F.count_if(F.coalesce("usable", F.lit(False))).alias("healthy"))


def run_families(history: DataFrame, phases: list[str], phase: str) -> DataFrame:
    """(family, label, value): lifetime totals, the last run, and one row a phase, 1 on the one that is active."""
    last = F.struct("started_at", "run_id")
    totals = history.agg(
        F.count(F.lit(1)).alias("runs_total"), F.count("error").alias("runs_failed_total"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_total") for c in ("probed", "dead", "reordered")],
        F.floor(F.max("started_at") / 1000 + 0.5).cast("bigint").alias("last_run_start_seconds"), F.max_by(F.col("error").isNotNull().cast("bigint"), last).alias("last_run_failed"),
    )
    rows = totals.unpivot([], totals.columns, "family", "value").filter(F.col("value").isNotNull()).select("family", F.lit("").alias("label"), "value")
    hot = [F.struct(F.lit("run_phase").alias("family"), F.lit(p).alias("label"), F.lit(int(p == phase)).cast("bigint").alias("value")) for p in phases]
    return rows.unionByName(history.sparkSession.range(1).select(F.explode(F.array(*hot)).alias("r")).select("r.*"))


def exposition(samples: DataFrame, family: str, kind: str, text: str, labels: list[str], value: str) -> DataFrame:
    """Lines of one family: (family, line_no, line); heads first, then one a sample with escaped labels. Infinite and missing values are left out."""
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    pairs = [F.concat(F.lit(f'{c}="'), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels]
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    line = F.concat(F.lit(family + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string"))
    heads = samples.sparkSession.range(2).select(F.lit(family).alias("family"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, f"# HELP {family} {text}").otherwise(f"# TYPE {family} {kind}").alias("line"))
    return heads.unionByName(samples.filter(finite).select(F.lit(family).alias("family"), F.lit(2).cast("bigint").alias("line_no"), line.alias("line")))


def page(families: DataFrame, about: dict[str, tuple[str, str]]) -> DataFrame:
    """The whole text of several families (family, labels: an array of (name, value), value), as line_no and line.

    `about` has each family's kind and help, in the order of the page; a family without samples has no lines. Samples of a family are in order of their labels. Lines are numbered by
    family first, so no task numbers the whole page. The samples are written once: they are read for lines, for heads, and to count both.
    """
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    rows = families.sparkSession.createDataFrame([(f, k, kind, text) for k, (f, (kind, text)) in enumerate(about.items())], "family string, place int, kind string, text string")
    number = F.col("value").cast("double")
    finite = written(families.filter(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))), "samples").join(rows, "family")
    label = F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit('="'), escape(F.coalesce(x["value"], F.lit(""))), F.lit('"'))), ",")
    named = F.when(F.size("labels") > 0, F.concat("family", F.lit("{"), label, F.lit("}"))).otherwise(F.col("family"))
    shown = F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))
    samples = finite.select("place", F.lit(2).alias("part"), F.concat_ws(" ", named, shown).alias("line"))
    there = finite.select("place", "family", "kind", "text").distinct()
    heads = [F.struct(F.lit(0).alias("part"), F.concat_ws(" ", F.lit("# HELP"), "family", "text").alias("line")), F.struct(F.lit(1).alias("part"), F.concat_ws(" ", F.lit("# TYPE"), "family", "kind").alias("line"))]
    lines = samples.unionByName(there.select("place", F.explode(F.array(*heads)).alias("h")).select("place", "h.*"))
    within = F.row_number().over(Window.partitionBy("place").orderBy("part", "line"))
    lines = lines.withColumn("within", within)
    before = F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a family
    ahead = lines.groupBy("place").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", before)
    return lines.join(ahead, "place").select((F.col("ahead") + F.col("within")).cast("bigint").alias("line_no"), "line")


def family(rows: DataFrame, name: str, value: Column, labels: dict[str, Column]) -> DataFrame:
    """Rows as samples of one family: family, labels, value."""
    return families(rows, [(name, value, labels)])


def families(rows: DataFrame, samples: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """Rows as samples of several families (name, value, labels), in one pass over the rows: family, labels, value."""
    none = F.array().cast("array<struct<name: string, value: string>>")
    pairs = lambda labels: F.array(*[F.struct(F.lit(k).alias("name"), c.cast("string").alias("value")) for k, c in labels.items()]) if labels else none
    said = [F.struct(F.lit(name).alias("family"), pairs(labels).alias("labels"), value.cast("double").alias("value")) for name, value, labels in samples]
    return rows.select(F.explode(F.array(*said)).alias("s")).select("s.*")


def worker_status(heartbeat: Column, enabled: Column, now: int, stale: int = 120_000) -> list[Column]:
    """What a worker is said to be doing, the age of its heartbeat, and whether it runs."""
    age = F.lit(now) - heartbeat
    fresh = F.coalesce(age < stale, F.lit(False))
    status = F.when(~enabled, "disabled").when(heartbeat.isNull(), "absent").when(fresh, "active").otherwise("stale")
    return [status.alias("worker"), F.floor(age / 1000 + 0.5).cast("bigint").alias("heartbeat_age_seconds"), fresh.cast("int").alias("running")]


def freshness(managed: Column, cached: Column, now: int, target: int) -> list[Column]:
    """Age of the oldest verdict and whether it is past the target. What the worker manages comes before all that is cached."""
    age = F.lit(now) - F.coalesce(managed, cached)
    return [F.floor(age / 1000 + 0.5).cast("bigint").alias("oldest_age_seconds"), (age > target).alias("breaching")]


def lane_families(lanes: DataFrame) -> DataFrame:
    """(provider, family, value) of lanes (limit, queued, done, dead, failed, current): dead ones are among the done, failed ones are not."""
    values = {
        "lane_limit": F.col("limit"), "lane_queued": F.col("queued"), "lane_done": F.col("done"), "lane_dead": F.coalesce("dead", F.lit(0)), "lane_failed": F.col("failed"),
        "lane_in_flight": F.coalesce(F.size("current"), F.lit(0)), "lane_completed": F.col("done") + F.coalesce("failed", F.lit(0)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("family"), v.cast("bigint").alias("value")) for k, v in values.items()])
    return lanes.select("provider", F.explode(rows).alias("r")).select("provider", "r.*")
