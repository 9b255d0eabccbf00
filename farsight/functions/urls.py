"""URL validity, canonical dedupe keys, host keys and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farsight.functions.text import fold, once, trim_ws

# scheme, userinfo, host, port, path, query of an absolute http(s) URL
ABSOLUTE_HTTP = (
    r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]\s]*\]|[^/?#@:\s\[\]]+)(?::\d*)?"
    r"(/[^?#]*)?(?:\?([^#]*))?(?:#[\s\S]*)?$"
)
# Tracking parameters that never select other content.
TRACKING = r"^(?i:utm_[^=]*|gclid|fbclid|msclkid|mc_eid|_ga)(?:=|$)"
# Characters of a path or query that are percent-encoded in an absolute URL.
ESCAPED = r"[\x00-\x20\"<>\\^`{|}\x7F-\x{10FFFF}]"


def is_absolute_http(url: Column) -> Column:
    """Absolute http/https URL with a host; null counts as not."""
    return F.coalesce(url.rlike(ABSOLUTE_HTTP), F.lit(False))


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, ABSOLUTE_HTTP, 1)), F.lit(""))


def normalize_host(host: Column) -> Column:
    """Lower case with one leading ``www.`` removed."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _escape(c: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(
                ch.rlike(ESCAPED),
                F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1"),
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(ESCAPED), encoded).otherwise(c)


def _without_dot_segments(path: Column) -> Column:
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.array_append(acc, seg)),
    )
    return F.when(path.contains("/."), F.array_join(folded, "/")).otherwise(path)


def canonical_path(path: Column) -> Column:
    """Dot segments folded, characters escaped, trailing slashes dropped; '' becomes '/'."""
    escaped = once(once(path, _without_dot_segments), _escape)
    trimmed = F.rtrim(escaped, F.lit("/"))
    return once(trimmed, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def canonical_query(query: Column) -> Column:
    """``?``-led query without tracking parameters, sorted; '' when nothing is left.

    The sort is by code unit and precedes any lower-casing.
    """
    kept = F.array_sort(
        F.filter(
            F.split(F.ltrim(once(query, _escape), F.lit("?")), "&"),
            lambda p: (p != "") & ~p.rlike(TRACKING),
        )
    )
    joined = once(
        kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise("")
    )
    return F.when(query == "", F.lit("")).otherwise(joined)


def url_key(url: Column) -> Column:
    """Canonical dedupe key, null for anything but an absolute http(s) URL.

    Scheme, port, user info, fragment, trailing slashes and tracking
    parameters do not count; host ``www.`` and letter case do not either.
    """

    def from_pieces(pieces: Column) -> Column:
        # '#host#path#query'; none of the three can hold a '#'. A URL that is not
        # absolute http(s) was left as it was.
        key = F.concat(
            normalize_host(pieces[1]),
            once(pieces[2], canonical_path),
            once(pieces[3], canonical_query),
        )
        return F.when((F.size(pieces) == 4) & (pieces[0] == ""), F.lower(key))

    def split_up(t: Column) -> Column:
        return F.when(
            ~t.startswith("#"), F.split(F.regexp_replace(t, ABSOLUTE_HTTP, "#$1#$2#$3"), "#")
        )

    def with_host(key: Column) -> Column:
        return F.when(~key.startswith("/"), key)

    return once(once(once(trim_ws(url), split_up), from_pieces), with_host)


def stable_id(url: Column) -> Column:
    """First 16 hex digits of SHA-256 over the trimmed lower-case URL (not the key)."""
    return F.substring(F.sha2(fold(url), 256), 1, 16)


def allowlist_host(entry: Column) -> Column:
    """Host key of an allowlist entry (URL or bare host); null when blank.

    A bare entry that has a path stays ``host/path`` and so matches no host.
    """
    bare = F.btrim(trim_ws(entry), F.lit("/"))
    return F.nullif(normalize_host(F.coalesce(url_host(trim_ws(entry)), bare)), F.lit(""))
