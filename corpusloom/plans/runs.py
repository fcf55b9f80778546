"""A run: captured pages of one or many sites to records, changes, files and statistics, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PII, clean_hash
from ..functions.urls import domain_core, parts_struct
from ..operators.extract import page_records, parse_pages
from ..operators.frontier import accepted, normalized
from ..operators.incremental import cache_rows, to_save, upsert, with_status
from ..operators.route import session_expired
from ..operators.settle import settled
from ..operators.stats import run_stats
from ..sources import responses, robots
from ..sources.sinks import payloads


@dataclass
class Run:
    """What a run gives, all lazy: `records` is worked out anew for each of the others, unless keep() is called."""

    records: DataFrame
    saved: DataFrame
    cache: DataFrame
    stats: DataFrame
    links: DataFrame
    documents: DataFrame | None = None

    def keep(self) -> Run:
        """Holds the records on the executors, in memory or on disk, from their first use until release()."""
        self.records.persist()
        return self

    def release(self) -> None:
        self.records.unpersist()


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def run_site(
    pages: DataFrame, cache: DataFrame, crawled_at: Column, save_format: Column | str = ".md", pii: list[str] | dict[str, Column] = tuple(PII), incremental: Column | bool = True,
    mode: Column | str = "headless", domain: Column | None = None, keep: tuple[str, ...] = (), exclude: Column | None = None, require: Column | None = None, rules: Column | None = None,
) -> Run:
    """pages: (url, html, the columns to keep; rendered, if known). URLs are filtered before anything is parsed, then
    normalised. Settings can be columns of what is kept."""
    if "rendered" not in pages.columns:
        pages = pages.withColumn("rendered", F.lit(False))
    wanted = normalized(accepted(pages, domain, exclude, require, rules))
    parsed = parse_pages(wanted.withColumn("expired", session_expired(F.col("html"), _column(mode))), "expired", "rendered", *keep)
    records = page_records(parsed.withColumn("found", F.col("page.links")), crawled_at, pii)
    hashed = records.withColumn("content_hash", clean_hash(F.col("plain_text")))
    seen = with_status(hashed, cache, incremental)
    status = F.when(F.col("expired"), "expired").when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
    done = seen.withColumn("status", status)
    good = done.where(~F.col("status").isin("failed", "expired"))
    links = good.select(*keep, "url", F.posexplode("found").alias("position", "href"))
    return Run(
        done, payloads(to_save(good, save_format), save_format),
        upsert(cache, cache_rows(good, content_hash=F.col("content_hash"))),
        run_stats(done, *(k for k in keep if not k.startswith("_"))), links
    )


def run_sites(
    pages: DataFrame, sites: DataFrame, cache: DataFrame, crawled_at: Column, robots_txt: DataFrame | None = None,
    captured: DataFrame | None = None
) -> Run:
    """All sites in one plan, each with its own settings (see sources.config): the domain and whether it is strict, keywords,
    robots rules (robots_txt: site, robots_txt), kinds of personal data, file format, incremental, kind of session, and
    documents (of captured: the responses, with site). max_pages and max_depth are for operators.frontier.crawl, delays for
    operators.schedule.

    A page belongs to the site in its column `site`, if there is one, else to the site of its domain. Sites are few, a row
    each in a configuration file, and joined as such.
    """
    settings = sites.select(
        F.col("name").alias("site"), domain_core(F.col("domain")).alias("_domain"),
        F.struct(
            F.when(
                F.col("strict_domain"), F.col("domain")
            ).alias("domain"), "exclude_keywords", "require_keywords", "respect_robots", "save_format", "incremental", "headless_mode", "download_docs", *PII,
        ).alias("_set"),
    )
    if "site" in pages.columns:
        known = pages.join(settings.drop("_domain"), "site")
    else:
        known = settled(pages, _p=parts_struct(F.col("url"))).withColumn(
            "_domain", domain_core(F.col("_p.authority"))
        ).drop("_p").join(settings, "_domain").drop("_domain")
    none = F.expr("cast(array() as array<struct<allow:boolean,path:string>>)")
    rules = None
    if robots_txt is not None:
        known = known.join(robots_txt.select("site", robots.policy(F.col("robots_txt")).alias("_policy")), "site", "left")
        rules = F.when(F.col("_set.respect_robots"), F.coalesce(F.col("_policy.rules"), none)).otherwise(none)
    of = lambda k: F.col(f"_set.{k}")
    run = run_site(
        known, cache, crawled_at, of("save_format"), {k: of(k) for k in PII}, of("incremental"), of("headless_mode"), of("domain"), ("site", "_set"), of("exclude_keywords"), of("require_keywords"), rules,
    )
    if captured is not None:
        wanted = captured.join(settings.where("_set.download_docs").select("site"), "site")
        run.documents = responses.documents(wanted, by=("site",))
    return run
