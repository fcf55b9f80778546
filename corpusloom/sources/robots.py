"""robots.txt: rules for all agents, delay and sitemaps; and whether a URL may be fetched.

Files are parsed by the standard library (one small file a site); matching URLs with rules is by expression. The first rule
that fits decides; a rule without a path allows all; no rule, no bar.
"""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY = "struct<rules:array<struct<allow:boolean,path:string>>,crawl_delay:int>"


def read_policy(text: str | None) -> dict:
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    entry = parser.default_entry
    rules = [{"allow": bool(r.allowance), "path": r.path} for r in entry.rulelines] if entry else []
    return {"rules": rules, "crawl_delay": entry.delay if entry and entry.delay else None}


def _policies(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_policy(t) for t in texts], columns=["rules", "crawl_delay"]).astype({"crawl_delay": "Int32"})


def _keys(urls: pd.Series) -> pd.Series:
    def key(url: str | None) -> str | None:
        if url is None:
            return None
        p = urlparse(unquote(url))
        return quote(urlunparse(("", "", p.path, p.params, p.query, p.fragment))) or "/"

    return urls.map(key)


def policy(text: Column) -> Column:
    return F.pandas_udf(_policies, POLICY)(text)


def match_key(url: Column) -> Column:
    """The part of a URL that rules are held against."""
    return F.pandas_udf(_keys, "string")(url)


def is_allowed(rules: Column, key: Column) -> Column:
    fits = F.filter(rules, lambda r: (r["path"] == "*") | F.startswith(key, r["path"]))
    return F.coalesce(F.try_element_at(fits, F.lit(1))["allow"], F.lit(True))


def sitemap_urls(text: Column) -> Column:
    """array<string>, whether or not a space follows the colon."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.lower(x).startswith("sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?i)\Asitemap:", ""))), lambda u: u != "")


def allowed(urls: DataFrame, robots: DataFrame, on: str = "site") -> DataFrame:
    """urls (site, url) and `allowed`; robots: one row a site (site, robots_txt)."""
    rules = robots.select(on, policy(F.col("robots_txt")).alias("_policy"))
    joined = urls.withColumn("_key", match_key(F.col("url"))).join(rules, on, "left")
    return joined.withColumn(
        "allowed",
        is_allowed(F.coalesce(F.col("_policy.rules"), F.expr("cast(array() as array<struct<allow:boolean,path:string>>)")), F.col("_key"))
    ).drop("_key", "_policy")
