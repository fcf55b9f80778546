"""Texts: personal data, content hashes, chunks, Markdown. Catalyst expressions only. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import SPACE, resolve, strip

#: What counts as personal data (with Unicode classes) and what it becomes, in the order it is looked for.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PERSON_NUMBER = r"(?U)(?<!\d)(?:19|20)?\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]|[6-9]\d)[\-\+]?\d{4}(?!\d)"
PHONE = r"(?U)(?<!\d)(?:(?:\+|00)46[\s\-]*\(?0\)?[\s\-]*[1-9]|0[\s\-]*\(?[1-9]\)?)[\s\-]*\d(?:[\s\-]*\d){4,8}\b"
IP = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
PII = {
    "remove_email": (EMAIL, "[E-POST]"), "remove_pnr": (PERSON_NUMBER, "[PERSONNUMMER]"),
    "remove_phone": (PHONE, "[TELEFON]"), "remove_ip": (IP, "[IP-ADRESS]")
}
DEFAULT_HEADING = "Huvudinnehåll"
MAX_WORDS, OVERLAP = 400, 50


def clean_pii(text: Column, flags: list[str] | dict[str, Column] = tuple(PII)) -> Column:
    """flags: the names of the kinds to mask, or a boolean column for each."""
    for name, (pattern, mark) in PII.items():
        if name in flags:
            masked = F.regexp_replace(text, pattern, F.lit(mark))
            text = F.when(flags[name], masked).otherwise(text) if isinstance(flags, dict) else masked
    return text


def clean_hash(text: Column) -> Column:
    """SHA-256 of the text without white space, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(text, SPACE + "+", "")), 256)


def words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def bound(value: Column, fn) -> Column:
    """fn(value), where value is worked out once, however often fn uses it: inside a lambda, a plain expression is evaluated anew for each element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _windows(heading: Column, own: Column, max_words: int, overlap: int) -> Column:
    step = max_words - overlap
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(own) - overlap) / step).cast("int") - 1)),
        lambda k: F.struct(
            F.when(k == 0, heading).otherwise(F.concat(heading, F.lit(" (del "), (k + 1).cast("string"), F.lit(")"))).alias("heading"),
            F.array_join(F.slice(own, k * step + 1, max_words), " ").alias("content"),
        ),
    )


def _section_chunks(heading: Column, text: Column, max_words: int, overlap: int) -> Column:
    none = F.array().cast("array<struct<heading:string,content:string>>")

    def cut(body: Column) -> Column:
        whole = F.array(F.struct(heading.alias("heading"), body.alias("content")))
        return F.when(body == "", none).otherwise(
            bound(
                F.split(body, SPACE + "+"),
                lambda own: F.when(F.size(own) <= max_words, whole).otherwise(_windows(heading, own, max_words, overlap))
            )
        )

    return bound(F.coalesce(strip(text), F.lit("")), cut)


def semantic_chunks(sections: Column, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> Column:
    """Chunks of array<struct<heading,text>>: a section of up to max_words words as it is, a longer one in windows that
    overlap; array<struct<heading,content,chunk_index,total_chunks>>. No sections, no chunks."""
    if not 0 < overlap < max_words:
        raise ValueError("the overlap must be over 0 and under the window")
    flat = F.flatten(
        F.transform(sections, lambda s: _section_chunks(F.coalesce(s["heading"], F.lit(DEFAULT_HEADING)), s["text"], max_words, overlap))
    )
    number = lambda f: F.transform(
        f,
        lambda c, i: F.struct(
            c["heading"].alias("heading"), c["content"].alias("content"), (i + 1).alias("chunk_index"),
            F.size(f).alias("total_chunks")
        )
    )
    return bound(flat, number)


def text_chunks(text: Column, heading: Column | None = None, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> Column:
    """The chunks of one section."""
    title = F.lit(DEFAULT_HEADING) if heading is None else heading
    return semantic_chunks(F.array(F.struct(title.alias("heading"), F.coalesce(text, F.lit("")).alias("text"))), max_words, overlap)


def plain_text(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n"), s["text"])), "\n\n")


def markdown_sections(markdown: Column) -> Column:
    """array<struct<heading,text>>: cut before each heading line; what has no text is left out."""
    raw = F.transform(F.split(markdown, r"(?m)(?=^#{1,6}\s)"), strip)
    heading = r"(?U)\A#{1,6}\s+([^\n]+)"
    made = F.transform(
        raw,
        lambda r: F.struct(
            F.when(r.rlike(heading), strip(F.regexp_extract(r, heading, 1))).otherwise(DEFAULT_HEADING).alias("heading"),
            strip(F.regexp_replace(r, heading, "")).alias("text"),
        ),
    )
    return F.filter(made, lambda s: s["text"] != "")


def absolute_markdown_links(text: Column, base: Column) -> Column:
    """[text](href) with href as seen from base; complete ones, mail addresses and anchors stay.

    The text is cut at its links and each href resolved by expression, so links of any kind need no Python.
    """
    link = r"\[([^\]]*)\]\(([^)]+)\)"
    mark = "\x00"
    pieces = F.split(F.regexp_replace(text, link, f"{mark}$1{mark}$2{mark}"), mark)
    fixed = F.transform(
        pieces,
        lambda p, i: F.when(i % 3 == 1, F.concat(F.lit("["), p, F.lit("]")))
        .when(i % 3 == 2, F.concat(F.lit("("), F.when(p.rlike(r"\A(?:https?://|mailto:|#)"), p).otherwise(resolve(base, p)), F.lit(")")))
        .otherwise(p),
    )
    return F.when(F.contains(text, F.lit(mark)) | ~text.rlike(link), text).otherwise(F.array_join(fixed, ""))
