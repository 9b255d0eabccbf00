"""Query registry and shared table and SQL helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.session import local_table, spread, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under ``name`` with its SQL, if any."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """The driver tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table over all cores, for work that is heavy per row."""
        return spread(getattr(self, name).select(*columns))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# --- SQL fragments (RE2 regex flavour) --------------------------------------------

_URL = (
    r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]\s]*\]|[^/?#@:\s\[\]]+)(?::\d*)?"
    r"(/[^?#]*)?(?:\?([^#]*))?(?:#(?s:.)*)?$"
)
_TRACK = "^(?i:utm_[^=]*|gclid|fbclid|msclkid|mc_eid|_ga)(?:=|$)"


def sql_is_http(url: str) -> str:
    return f"regexp_matches({url}, '{_URL}')"


def sql_host(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, '{_URL}', 1)), '')"


def sql_norm_host(url: str) -> str:
    return f"regexp_replace({sql_host(url)}, '^www\\.', '')"


def sql_url_key(url: str) -> str:
    u = f"trim({url})"
    kept = (
        f"list_sort(list_filter(string_split(coalesce(regexp_extract({u}, '{_URL}', 3), ''), '&'), "
        f"lambda p: p <> '' AND NOT regexp_matches(p, '{_TRACK}')))"
    )
    path = f"rtrim(coalesce(regexp_extract({u}, '{_URL}', 2), ''), '/')"
    return (
        f"CASE WHEN {sql_is_http(u)} THEN lower({sql_norm_host(u)} || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END) END"
    )


def sql_stable_id(url: str) -> str:
    return f"substr(sha256(lower(trim({url}))), 1, 16)"


# --- shared inputs ----------------------------------------------------------------

# Language path segment of a page URL: the run it belongs to.
PAGE_RUN = r"^[a-z]+://[^/]+/([a-z]+)/"


def page_run():
    return F.regexp_extract("url", PAGE_RUN, 1)


SQL_PAGE_RUN = f"regexp_extract(url, '{PAGE_RUN}', 1)"

# Topic groups used on the invented prose: words that occur in it.
THEMES = [
    ("articles", 0, ["the", "der", "la"]),
    ("joins", 1, ["and", "und", "the"]),
    ("origins", 2, ["of", "de", "the"]),
]


def theme_keywords(spark: SparkSession) -> DataFrame:
    """(group_id, group_ord, pass, term): pass p of a group looks for its keyword p."""
    rows = [(g, o, p, t) for g, o, ks in THEMES for p, t in enumerate(ks, 1)]
    return local_table(spark, rows, "group_id string, group_ord int, pass int, term string")


SQL_THEMES = (
    "(SELECT * FROM (VALUES "
    + ", ".join(f"('{g}', {o}, {p}, '{t}')" for g, o, ks in THEMES for p, t in enumerate(ks, 1))
    + ") AS v(group_id, group_ord, pass, term))"
)
