"""Site configurations: a JSON array of sites, with a default for each key that may be left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import slugify, strip

SCHEMA = (
    "name string, start_url string, output_dir string, delay double, max_pages int, max_depth int, save_format string, headless_mode string, use_hybrid boolean, "
    "use_trafilatura boolean, find_sitemap boolean, respect_robots boolean, download_docs boolean, strict_domain boolean, exclude_keywords array<string>, "
    "require_keywords array<string>, remove_email boolean, remove_pnr boolean, remove_phone boolean, remove_ip boolean, incremental boolean"
)
#: incremental: true where a file leaves it out, so that such sites run.
DEFAULTS = {
    "name": "Unknown", "delay": 0.5, "max_pages": 0, "max_depth": 0, "save_format": ".md", "headless_mode": "headless", "use_hybrid": True, "use_trafilatura": False, "find_sitemap": True,
    "respect_robots": True, "download_docs": False, "strict_domain": True, "remove_email": False, "remove_pnr": False, "remove_phone": False, "remove_ip": False, "incremental": True,
}


def keyword_list(text: Column) -> Column:
    """array<string> of words with commas between, as one types them: trimmed, in lower case, without empty ones."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda w: F.lower(strip(w)))
    return F.filter(words, lambda w: w != "")


def with_defaults(sites: DataFrame) -> DataFrame:
    """All keys, keywords in lower case, the domain of start_url, and an output folder made of the name."""
    none = F.array().cast("array<string>")
    cols: dict[str, Column] = {k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()}
    cols |= {k: F.transform(F.coalesce(k, none), F.lower) for k in ("exclude_keywords", "require_keywords")}
    full = sites.withColumns(cols)
    return full.withColumns(
        {
            "output_dir": F.coalesce("output_dir", F.concat(F.lit("server_data/"), slugify(F.col("name")))),
            "domain": F.lower(F.regexp_extract("start_url", r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)),
        }
    )


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(SCHEMA).json(path, multiLine=True))
