"""URL rules: canonical posting URLs, record keys, safe links."""

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import vocab
from jobstrata.functions.text import let, strip


@dataclass(frozen=True)
class SiteRules:
    """How one site's links become posting URLs."""

    domain: str
    job_patterns: tuple
    asset_pattern: str = vocab.ASSET_PATTERN
    nav_pattern: str = None
    replay_prefix: str = vocab.REPLAY_PREFIX
    unwrap_levels: int = 1
    unwrap_anchored: bool = False
    unwrap_absolute_only: bool = True
    check_host: bool = False
    require_job_url: bool = True
    resolve_relative: bool = True
    relative_slash: bool = True


def numbered_site(domain: str) -> SiteRules:
    """Numeric posting paths plus the older REF= pages."""
    d = re.escape(domain)
    return SiteRules(
        domain=domain,
        job_patterns=(
            r"(?:https?://)?(?:www\.)?" + d + r"/(\d{4,8})/([a-z0-9][a-z0-9\-]{2,})/?$",
            r"detalhe_anuncio[_\w]*\.asp[^\"']*REF=\d+",
        ),
        unwrap_levels=3, unwrap_anchored=True, check_host=True,
    )


def slug_site(domain: str) -> SiteRules:
    """Blog-style slugs, optionally below a date path."""
    return SiteRules(
        domain=domain,
        job_patterns=(
            r"(?:https?://)?(?:www\.)?" + re.escape(domain)
            + r"/(?:\d{4}/\d{2}/\d{2}/)?([a-z0-9\-]{5,})/?$",
        ),
        asset_pattern=vocab.ASSET_PATTERN_NO_ZIP, nav_pattern=vocab.NAV_PATH_PATTERN,
        resolve_relative=False,
    )


def era_site(domain: str) -> SiteRules:
    """Links are cleaned but not rejected: the page layouts filter by link pattern."""
    return SiteRules(
        domain=domain, job_patterns=(vocab.JOB_LINK_PATTERN,), require_job_url=False,
        replay_prefix=r"/noFrame/replay/\d{14}[a-z_]*/", unwrap_absolute_only=False,
        relative_slash=False,
    )


def absolute_url(href: Column, rules: SiteRules) -> Column:
    href = strip(href)
    host = F.lit("http://" + rules.domain)
    rooted = F.when(href.startswith("/"), F.concat(host, href))
    if rules.relative_slash:
        rooted = rooted.otherwise(F.concat(host, F.lit("/"), href))
    else:
        rooted = rooted.otherwise(href)
    return F.when(href.startswith("http"), href).otherwise(rooted)


def unwrap_replay(url: Column, rules: SiteRules) -> Column:
    """Drop the archive replay prefix, as often as the site nests it."""
    head = "^" if rules.unwrap_anchored else r"^(?s:.*?)"
    target = r"(https?://.+)" if rules.unwrap_absolute_only else r"(.+)"
    for _ in range(rules.unwrap_levels):
        url = F.regexp_replace(url, "(?i)" + head + rules.replay_prefix + target, "$1")
    return url


def resolve_url(href: Column, rules: SiteRules) -> Column:
    """Link target without replay prefix, absolute where the site's links are relative."""
    raw = strip(href)
    if not rules.require_job_url:
        replayed = raw.rlike("(?i)" + rules.replay_prefix)
        return F.when(replayed, unwrap_replay(raw, rules)).otherwise(absolute_url(href, rules))
    return unwrap_replay(absolute_url(href, rules) if rules.resolve_relative else raw, rules)


def is_posting_url(url: Column, rules: SiteRules) -> Column:
    """Whether a resolved URL is a posting of the site."""
    if not rules.require_job_url:
        return url.isNotNull()
    accepted = url.rlike("(?iU)" + "|".join(f"(?:{p})" for p in rules.job_patterns))
    accepted = accepted & ~url.rlike("(?i)" + rules.asset_pattern)
    if rules.nav_pattern:
        accepted = accepted & ~url.rlike("(?i)" + rules.nav_pattern)
    if rules.check_host:
        host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
        accepted = accepted & host.contains(rules.domain)
    return accepted


def canonical_url(href: Column, rules: SiteRules) -> Column:
    """Canonical posting URL, or null when the link is not a posting of the site."""
    return let(resolve_url(href, rules), lambda url: F.when(is_posting_url(url, rules), url))


def record_key(url: Column, ts: Column = None, title: Column = None, mode: str = "url") -> Column:
    """First 16 hex digits of SHA-256 of the URL, or of timestamp and URL.

    ``url`` counts a posting once ever; ``snapshot_url`` once per snapshot, and an empty
    URL is replaced by the title so such rows stay distinct.
    """
    if mode == "url":
        text = url
    elif mode == "snapshot_url":
        stand_in = F.concat_ws("|", title, ts) if title is not None else F.lit("")
        text = F.concat_ws("|", ts, F.when(F.coalesce(url, F.lit("")) == "", stand_in).otherwise(url))
    else:
        raise ValueError(f"unknown key mode: {mode}")
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def safe_external_url(url: Column, fallback: str) -> Column:
    u = strip(url)
    bare = F.concat(F.lit("https://"), u)
    host = F.regexp_extract(bare, r"^https://([^/?#]*)", 1)
    valid = host.rlike(r"^[^\s<>^|\\{}\[\]\"`%]+$")
    lower_host = F.concat(F.lit("https://"), F.lower(host), F.substr(bare, F.length(host) + 9))
    with_path = F.when(bare.rlike(r"^https://[^/?#]*$"), F.concat(lower_host, F.lit("/"))).otherwise(lower_host)
    return (
        F.when(F.coalesce(u, F.lit("")) == "", F.lit(fallback))
        .when(u.rlike("(?i)^https?://"), u)
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(valid, with_path)
        .otherwise(F.lit(fallback))
    )
