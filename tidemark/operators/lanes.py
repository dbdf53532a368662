"""Logins of providers as lanes: which there are, what URL each plays, and how many probes it has room for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.probing import playback_url
from tidemark.functions.rewriting import jvm_pair, rewritten


def logins(providers: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per login: the first default profile as login 0, then other active ones as they stand; without any, a plain login 0.

    `profiles` has provider_id, profile_id, ord, name, is_default, is_active, max_streams, viewers, search and replace. A bound of
    null or zero is the provider's.
    """
    active = profiles.filter(F.coalesce("is_active", F.lit(True))).withColumn("is_default", F.coalesce("is_default", F.lit(False)))
    same = Window.partitionBy("provider_id", "is_default").orderBy("ord", "profile_id")
    active = active.withColumn("nth", F.row_number().over(same)).filter(~F.col("is_default") | (F.col("nth") == 1)).drop("nth")
    d = providers.select("provider_id", "account_type", F.col("max_streams").alias("most")).join(active, "provider_id", "left")
    plain = F.col("profile_id").isNull()
    d = d.withColumn("is_default", F.coalesce("is_default", F.lit(True)))
    order = Window.partitionBy("provider_id").orderBy(F.desc("is_default"), "ord", "profile_id")
    return d.select(
        "provider_id",
        F.when(F.col("is_default"), F.lit(0)).otherwise(F.col("profile_id")).cast("bigint").alias("login_id"),
        "profile_id",
        F.when(plain, "default").otherwise(F.col("name")).alias("name"),
        "is_default",
        F.coalesce(F.nullif("max_streams", F.lit(0)), "most").cast("bigint").alias("max_streams"),
        F.coalesce("viewers", F.lit(0)).cast("bigint").alias("viewers"),
        (F.col("account_type") == "XC").alias("rebuilds"),
        F.when(~plain, F.coalesce("search", F.lit(""))).alias("search"),
        F.when(~plain, F.coalesce("replace", F.lit(""))).alias("replace"),
        F.row_number().over(order).cast("bigint").alias("nth"),
    )


def targets(streams: DataFrame, lines: DataFrame) -> DataFrame:
    """Each stream's URL under each login of its provider, with `taken` for the first login that reaches a URL, and `issue`.

    Streams without logins keep their URL under login 0. Patterns are compiled for logins, before streams meet them.
    """
    pairs = lines.withColumn("pair", F.when(F.col("search").isNotNull(), jvm_pair("search", "replace")))
    half = F.col("rebuilds") & ((F.col("search") == "") | (F.col("replace") == ""))
    pairs = pairs.withColumn("plain", F.col("search").isNull()).withColumn("unusable", ~F.col("plain") & (half | F.col("pair.search").isNull()))
    pairs = pairs.select("provider_id", "login_id", "nth", "rebuilds", "plain", "unusable", "pair")
    d = streams.select("stream_id", "provider_id", "url").join(pairs, "provider_id", "left")
    d = d.withColumn("login_id", F.coalesce("login_id", F.lit(0).cast("bigint"))).withColumn("unusable", F.coalesce("unusable", F.lit(False)))
    new = rewritten(F.col("url"), F.col("pair"))
    moved = F.when(F.col("plain") | F.col("unusable") | new.isNull(), F.col("url"))
    target = moved.when(F.col("rebuilds"), playback_url(F.col("url"), new)).otherwise(new)
    first = F.row_number().over(Window.partitionBy("stream_id", "target").orderBy("nth")) == 1
    d = d.withColumn("target", target).withColumn("taken", first)
    issue = F.when(F.col("unusable"), "unusable-pattern").when(~F.col("taken"), "duplicate-url")
    return d.select("stream_id", "provider_id", "login_id", F.col("target").alias("url"), "taken", issue.alias("issue"))


def issues(found: DataFrame) -> DataFrame:
    """How many streams each login had each issue with."""
    return found.filter(F.col("issue").isNotNull()).groupBy("provider_id", "login_id", "issue").agg(F.count(F.lit(1)).alias("streams"))


def budgets(lines: DataFrame, provider_viewers: DataFrame, profile_viewers: DataFrame) -> DataFrame:
    """Each login's bound and the viewers it is charged with.

    A login has the larger of its own and its sessions' viewers. What a provider has beyond these goes to its default login,
    or, without one, to each login its share, rounded up.
    """
    d = lines.join(profile_viewers.select("profile_id", F.col("viewers").alias("seen")), "profile_id", "left")
    d = d.join(provider_viewers.select("provider_id", F.col("viewers").alias("all_seen")), "provider_id", "left")
    own = F.greatest(F.col("viewers"), F.coalesce("seen", F.lit(0)))
    per = Window.partitionBy("provider_id")
    d = d.withColumn("own", own).withColumn("open", F.greatest(F.coalesce("all_seen", F.lit(0)) - F.sum("own").over(per), F.lit(0)))
    d = d.withColumn("led", F.max(F.col("is_default").cast("int")).over(per) == 1).withColumn("n", F.count(F.lit(1)).over(per))
    rest = F.when(F.col("is_default"), F.col("open")).when(F.col("led"), F.lit(0)).otherwise(F.ceil(F.col("open") / F.col("n")))
    return d.select("provider_id", "login_id", F.col("max_streams").alias("base"), (F.col("own") + rest).cast("bigint").alias("viewers"))


def sustained(lanes: DataFrame, most: int) -> DataFrame:
    """Lanes with the share of a cap over all lanes that each can hold, one at least; its limit where the cap does not bind."""
    total = lanes.agg(F.sum("limit").alias("t")).scalar()
    share = F.greatest(F.lit(1), F.least("limit", F.floor(F.lit(most) * F.col("limit") / total)))
    bound = F.lit(most > 0) & (F.lit(most) < total)
    return lanes.withColumn("sustained", F.when(bound, share).otherwise(F.col("limit")).cast("bigint"))


def outcomes(jobs: DataFrame, lanes: DataFrame) -> DataFrame:
    """What each lane did: queued, done, dead and failed jobs, and the percentage of its room that was busy.

    `jobs` has provider_id, login_id, state (done, dead, failed or queued), began and ended; `lanes` has the limit of each login, or, without login_id, that of all logins of a provider.
    """
    state = F.col("state")
    counts = [F.count_if(state.isin(*of)).alias(name) for name, of in {"done": ("done", "dead"), "dead": ("dead",), "failed": ("failed",)}.items()]
    d = jobs.groupBy("provider_id", "login_id").agg(F.count(F.lit(1)).alias("queued"), *counts, F.sum(F.col("ended") - F.col("began")).alias("busy"), (F.max("ended") - F.min("began")).alias("span"))
    d = d.join(lanes, [c for c in ("provider_id", "login_id") if c in lanes.columns], "left")
    room = F.col("span") * F.col("limit")
    return d.select("provider_id", "login_id", "queued", "done", "dead", "failed", F.when(room > 0, F.col("busy") / room * 100).otherwise(F.lit(0.0)).alias("utilisation"))


def by_provider(found: DataFrame) -> DataFrame:
    """Lanes' counts folded to providers, with the logins that took part."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("queued", "done", "dead", "failed")]
    return found.groupBy("provider_id").agg(*sums, F.array_sort(F.collect_set("login_id")).alias("logins"))


def slice_size(backlog: Column, oldest: Column, deadline: int, tick: int, most: int, least: int = 25) -> Column:
    """Jobs for one tick, so that the oldest is done by the deadline; past it, as many as allowed."""
    ticks = F.greatest((F.lit(deadline) - oldest) / F.lit(tick), F.lit(1.0))
    needed = F.floor(backlog / ticks + F.lit(0.5))
    paced = F.greatest(F.least(F.lit(least), backlog), F.least(needed, F.lit(most), backlog))
    return F.when(backlog <= 0, 0).when(oldest >= deadline, F.least(backlog, F.lit(most))).otherwise(paced).cast("bigint")


def wait(base: int, most: int, stopped: Column, worked: Column, wakes: list[Column], now: Column) -> Column:
    """Time to the next pass: the base tick after a pass that did something, else to the first known wake, within bounds."""
    base, first = max(base, 1000), F.least(*wakes) if len(wakes) > 1 else wakes[0]
    idle = F.least(F.greatest(first - now, F.lit(base)), F.lit(max(most, base)))
    return F.when(stopped | worked | first.isNull(), F.lit(base)).otherwise(idle).cast("bigint")


def limits(lanes: DataFrame, idle: bool, reserve: int, pause: bool = False) -> DataFrame:
    """Lanes (with limit, viewers) that may start something, and how much: their limit less their viewers, and less a reserve while anybody watches.

    Where passes pause while anybody watches, no lane may.
    """
    free = F.col("limit") - F.coalesce("viewers", F.lit(0)) - F.lit(0 if idle else reserve)
    return lanes.withColumn("free", free).filter((F.col("free") > 0) & F.lit(idle or not pause))


def shrunk(limit: Column, watching: bool, reserve: int, worker_busy: Column) -> Column:
    """A lane's room for a check on demand: less the reserve while anybody watches, less one that the worker holds."""
    return F.greatest(limit - F.lit(reserve if watching else 0) - worker_busy.cast("int"), F.lit(0))
