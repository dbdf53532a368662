"""Column functions for short texts: patterns, urls, hosts, keys, and how numbers and times are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of names that nobody can register.
PRIVATE_SUFFIXES = [".localhost", ".local", ".lan", ".home", ".home.arpa", ".internal", ".localdomain", ".ts.net"]
# Words that mean true.
TRUE_WORDS = ["1", "true", "yes", "on"]
# Policy modes under which a channel's own assignment is ranked.
RANKS_ASSIGNED = ["assigned", "after_epg_start"]
# A shown difference of so many kbps is worth acting on.
NOTABLE_KBPS = 500
# End of fixed values.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def anywhere(pattern: Column) -> Column:
    """A pattern that finds another anywhere in a text, whatever its case, where a match must span the whole text."""
    return F.concat(F.lit("(?i).*"), pattern, F.lit(".*"))


def matches_fully(text: Column, pattern: str) -> Column:
    """Whether the first match of a pattern is the whole text; not the same as an anchored pattern."""
    return text.rlike(pattern) & (F.regexp_extract(text, pattern, 0) == text)


def url_fault(url: Column) -> Column:
    """Why a url is refused before a probe; empty where it is not."""
    text = F.coalesce(url, F.lit(""))
    return F.when(F.trim(text) == "", "empty url").when(text.startswith("-"), 'refusing a url that begins with "-"').otherwise("")


def number(text: Column, otherwise: Column) -> Column:
    """A finite number that a text holds, or the fallback for anything else."""
    value = F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), otherwise)


def truth(text: Column, otherwise: bool) -> Column:
    """Whether a text says yes; the fallback where it is unset or empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(otherwise)).otherwise(F.lower(F.trim(text)).isin(TRUE_WORDS))


def clamped(text: Column, otherwise: float, least: float, most: float) -> Column:
    """A query option between bounds. An absent option counts as 0 and so as the lower bound; only what is no number gives the fallback."""
    value = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0.0)).otherwise(number(text, F.lit(None).cast("double")))
    return F.when(value.isNull(), F.lit(float(otherwise))).otherwise(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), value)))


def host_of(header: Column) -> Column:
    """The host of a header without port and brackets, in lower case; null where there is none. Several colons are a bare IPv6 address."""
    raw = F.lower(F.trim(header))
    bracketed = F.nullif(F.regexp_extract(raw, r"^\[([^\]]*)\]", 1), F.lit(""))
    colons = F.length(raw) - F.length(F.translate(raw, ":", ""))
    plain = F.when(colons == 1, F.nullif(F.substring_index(raw, ":", 1), F.lit(""))).otherwise(raw)
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).when(raw.startswith("["), bracketed).otherwise(plain)


def origin_host(origin: Column) -> Column:
    """The host that an origin names: null where there is no origin, empty where it is opaque or no url."""
    raw = F.trim(origin)
    authority = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).when((raw == "null") | (authority == ""), "").otherwise(F.coalesce(host_of(authority), F.lit("")))


def private_ipv4(host: Column) -> Column:
    part = lambda k: F.get(F.split(host, "[.]"), F.lit(k)).try_cast("int")
    a, b = part(0), part(1)
    ranges = a.isin(127, 10) | (a == 192) & (b == 168) | (a == 172) & b.between(16, 31) | (a == 169) & (b == 254) | (a == 100) & b.between(64, 127)
    whole = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (F.greatest(*[F.coalesce(part(k), F.lit(999)) for k in range(4)]) <= 255)
    return F.coalesce(whole & ranges, F.lit(False))


def private_ipv6(host: Column) -> Column:
    tail = F.substring_index(host, ":", -1)
    local = host.rlike("^f[cd][0-9a-f]{0,2}:") | host.rlike("^fe[89ab][0-9a-f]?:")
    inner = F.when(host.isin("::1", "::"), True).when(F.contains(tail, F.lit(".")), private_ipv4(tail)).otherwise(local)
    return F.contains(host, F.lit(":")) & inner


def allowed_host(host: Column, allowed: list[str]) -> Column:
    """Whether a host may be answered: a listed one or one under a listed suffix, a name without dots, a private suffix or address; an absent one may."""
    listed = F.lit("*" in allowed)
    for entry in allowed:
        listed = listed | (host == entry) | (host.endswith(entry) if entry.startswith(".") else F.lit(False))
    bare = ~F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(":"))
    suffix = F.lit(False)
    for s in PRIVATE_SUFFIXES:
        suffix = suffix | host.endswith(s)
    return host.isNull() | listed | bare | suffix | private_ipv4(host) | private_ipv6(host)


def host_list(raw: Column) -> Column:
    """Hosts of a list by commas or white space, in lower case and without ports."""
    parts = F.filter(F.split(F.lower(F.coalesce(raw, F.lit(""))), r"[,\s]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(host_of(x), x))


def lane_key(provider: Column, profile: Column) -> Column:
    return F.concat_ws(":", provider.cast("string"), profile.cast("string"))


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def shown_rate(kbps: Column) -> Column:
    """kbps, or Mbps with one place from 1000 on; halves go up."""
    tenths = _rounded(kbps / 100)
    mega = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" Mbps"))
    return F.when(kbps >= 1000, mega).otherwise(F.concat(_rounded(kbps).cast("string"), F.lit(" kbps")))


def shown_delta(kbps: Column) -> Column:
    sign = F.when(kbps > 0, "+").when(kbps < 0, "−").otherwise("")
    return F.concat(sign, shown_rate(F.abs(kbps)))


def tone(kbps: Column) -> Column:
    return F.when(kbps >= NOTABLE_KBPS, "good").when(kbps <= -NOTABLE_KBPS, "bad").otherwise("muted")


def _past(seconds: Column, steps: list[tuple[int, int, str]]) -> Column:
    """Text for an age: of (limit, unit in seconds, letter) the first whose limit lies above; the last has no limit."""
    out = None
    for limit, unit, letter in steps:
        text = F.concat(_rounded(seconds / unit).cast("string"), F.lit(f"{letter} ago"))
        out = F.when(seconds < limit, text) if out is None else out.when(seconds < limit, text) if limit else out.otherwise(text)
    return out


def since(at: Column, now: int) -> Column:
    """How long ago a verdict is from; 'never probed' without one."""
    age = F.greatest(_rounded((F.lit(now) - at) / 1000), F.lit(0))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "never probed").otherwise(_past(age, [(90, 1, "s"), (5400, 60, "m"), (172800, 3600, "h"), (0, 86400, "d")]))


def ago(at: Column, now: int) -> Column:
    return _past(F.greatest(_rounded((F.lit(now) - at) / 1000), F.lit(0)), [(60, 1, "s"), (3600, 60, "m"), (0, 3600, "h")])


def duration(ms: Column) -> Column:
    """45s, 2m 30s, 3h 5m; a remainder of nothing is left out."""
    s = F.greatest(_rounded(ms / 1000), F.lit(0))
    hours = F.floor(s / 3600).cast("bigint")
    minutes = _rounded((s - hours * 3600) / 60)
    text = lambda whole, letter, rest, small: F.concat(whole.cast("string"), F.lit(letter), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(small))).otherwise(""))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, text(F.floor(s / 60), "m", s % 60, "s")).otherwise(text(hours, "h", minutes, "m"))


def clock(at: Column) -> Column:
    """The time of day in the session's zone."""
    return F.date_format(F.timestamp_millis(at), "HH:mm")


def is_fragment(query: str, name: Column) -> Column:
    """Whether a search term is one word within a longer name, which an alias could not say."""
    needle = query.strip().lower()
    found = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return (F.size(found) >= 2) & (F.size(found) > len(needle.split())) & F.array_contains(found, needle)


def qualifier(prefix: Column) -> Column:
    return F.when(prefix.rlike(r"\s"), F.concat(F.lit('@"'), prefix, F.lit('"'))).otherwise(F.concat(F.lit("@"), prefix))


def described(reason: Column, detail: Column) -> Column:
    return F.when(F.coalesce(detail, F.lit("")) != "", F.concat(reason, F.lit(" — "), detail)).otherwise(reason)


def described_scope(event_only: Column, include: Column, exclude: Column) -> Column:
    """A scope in one sentence: the excludes are a veto over the rest."""
    events = F.when(event_only, "channels in groups set to after EPG start or assigned")
    groups = F.when(F.size(include) > 0, F.concat(F.lit("groups matching "), F.array_join(include, ", ")))
    admitted = F.coalesce(F.nullif(F.concat_ws(", or ", events, groups), F.lit("")), F.lit("every probe"))
    veto = F.when(F.size(exclude) > 0, F.concat(F.lit(" — except groups matching "), F.array_join(exclude, ", "))).otherwise("")
    return F.concat(F.lit("Learning from "), admitted, veto, F.lit("."))
