"""Which channels a time policy lets through, and when held ones open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import epg_current, epg_next

MINUTE = 60_000
#: What holds for a channel that neither an explicit policy nor a name pattern covers.
FALLBACK = ("always", 0, 0, False)


def glob(text: Column, pattern: str) -> Column:
    """Whole-text match of a pattern with * and ?, whatever the case."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return F.coalesce(text.ilike(like), F.lit(False))


def with_policy(channels: DataFrame, policies: DataFrame, patterns: list[tuple[str, str, int, int, bool]]) -> DataFrame:
    """Each channel with mode, grace_minutes, window_minutes and require_live.

    An explicit policy of the group wins over the first pattern that its name matches, that over the fallback. `patterns` are
    (glob, mode, grace, window, require_live); they are configuration, so a chain of conditions inside the projection will do.
    """
    cols = ["mode", "grace_minutes", "window_minutes", "require_live"]
    types = ["string", "bigint", "bigint", "boolean"]

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(values, types, cols, strict=True)])

    named = reduce(lambda rest, p: F.when(glob(F.col("group_name"), p[0]), literal(p[1:])).otherwise(rest), reversed(patterns), literal(FALLBACK))
    explicit = policies.select(F.col("group_id"), F.struct(*cols).alias("explicit"))
    return channels.join(explicit, "group_id", "left").withColumn("policy", F.coalesce("explicit", named)).select(*channels.columns, "policy.*")


def gated(channels: DataFrame, epg: DataFrame, now: int) -> DataFrame:
    """Channels with a policy, and whether it lets them through at `now`: allowed, reason, detail, eligible_at.

    Both sides of the programme join are one row a tvg_id. An event opens after its grace, strictly, and closes after its window.
    """
    on_air = epg_current(epg, now).select("tvg_id", "title", "start_ms", "is_live", F.lit(True).alias("on_air"))
    d = channels.join(on_air, "tvg_id", "left").join(epg_next(epg, now), "tvg_id", "left")
    mode, live = F.col("mode"), F.col("require_live")
    grace = F.col("grace_minutes") * MINUTE
    opens_next = F.when(live, F.col("next_live_ms")).otherwise(F.col("next_ms")) + grace
    opens, closes = F.col("start_ms") + grace, F.col("start_ms") + F.col("window_minutes") * MINUTE
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit('"'), F.col("title"), F.lit('"')))
    at = F.concat(F.date_format(F.timestamp_millis("start_ms"), "HH:mm"), F.lit("Z"))

    def verdict(reason: str, detail: Column | None = None, eligible: Column | None = None) -> Column:
        null = F.lit(None)
        fields = [F.lit(reason == ""), F.lit(reason), (null if detail is None else detail).cast("string"), (null if eligible is None else eligible).cast("bigint")]
        return F.struct(*[f.alias(n) for f, n in zip(fields, ["allowed", "reason", "detail", "eligible_at"], strict=True)])

    out = (
        F.when(mode == "never", verdict("group excluded"))
        .when(mode.isin("always", "assigned"), verdict(""))
        .when(F.col("on_air").isNull(), verdict("no EPG data", eligible=opens_next))
        .when(live & ~F.coalesce(F.col("is_live"), F.lit(False)), verdict("no live programme", title, opens_next))
        .when(F.lit(now) < opens, verdict("before kickoff", F.concat_ws(" ", at, title), opens))
        .when(F.lit(now) > closes, verdict("event window passed", title, opens_next))
        .otherwise(verdict(""))
    )
    return d.select(*channels.columns, out.alias("v")).select(*channels.columns, "v.*")
