"""Dates of pages: free texts, taken from the first place that has one. Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how visible text says when a page was published or changed.
VISIBLE = (
    r"(?iU)(?:senast\s+uppdaterad|uppdaterad|publicerad|ändrad)[\s\:\*]*"
    r"(\d{1,2}\s+(?:januari|februari|mars|april|maj|juni|juli|augusti|september|oktober|november|december)\s+\d{4}|\d{4}-\d{2}-\d{2})"
)


def first_given(*candidates: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates), F.lit(""))


def page_dates(published: Column, modified: Column, visible: Column) -> tuple[Column, Column]:
    """(published_date, modified_date): what tags and scripts said, else the last date in the visible text."""
    pub, mod = F.coalesce(published, F.lit("")), F.coalesce(modified, F.lit(""))
    whole = F.regexp_extract_all(visible, F.lit(VISIBLE), F.lit(0))
    date = F.coalesce(F.try_element_at(F.regexp_extract_all(visible, F.lit(VISIBLE), F.lit(1)), F.lit(-1)), F.lit(""))
    phrase = F.lower(F.coalesce(F.try_element_at(whole, F.lit(-1)), F.lit("")))
    new_mod = F.when((mod == "") & F.contains(phrase, F.lit("uppdaterad")), date).otherwise(mod)
    new_pub = F.when((pub == "") & F.contains(phrase, F.lit("publicerad")), date).otherwise(pub)
    return new_pub, F.when((new_mod == "") & (new_pub == ""), date).otherwise(new_mod)
