"""What becomes of a response, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DROPPED_TYPES = ["image/", "video/", "audio/", "font/", "zip", "octet-stream"]
DOCUMENT_TYPES = ["application/pdf", "application/vnd", "application/msword"]
TEXT_TYPES = ["text", "html", "json", "xml"]
SESSION_INDICATORS = [
    'name="password"', 'action="login"', 'id="loginform"', 'type="password"', "cas/login", "adfs/ls", "saml",
    "inloggning krävs", "du måste logga in"
]
NO_HEAD = [403, 405]
LEAST_HTML = 1000
NO_TEXT = ["Ingen text", "No text"]
LEAST_TEXT = 50
SHORT_ERROR = 30


def _holds(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def content_route(content_type: Column, download_documents: Column | bool = False) -> Column:
    """drop, document (to be downloaded), skip_document, page (has a body), or empty (of a type without one)."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    wanted = download_documents if isinstance(download_documents, Column) else F.lit(download_documents)
    return (
        F.when(_holds(kind, DROPPED_TYPES), "drop")
        .when(_holds(kind, DOCUMENT_TYPES), F.when(wanted, "document").otherwise("skip_document"))
        .when(_holds(kind, TEXT_TYPES), "page")
        .otherwise("empty")
    )


def probed_type(status: Column, content_type: Column) -> Column:
    """What a HEAD request tells: the type in lower case ('' if none is named); null where HEAD isn't allowed."""
    return F.when(~status.isin(NO_HEAD), F.lower(F.coalesce(content_type, F.lit(""))))


def js_render_needed(html: Column) -> Column:
    return F.coalesce((F.length(html) < LEAST_HTML) | F.contains(F.lower(html), F.lit("enable javascript")), F.lit(False))


def session_expired(html: Column, mode: Column | None = None, indicators: list[str] = SESSION_INDICATORS) -> Column:
    """mode: only login_then_headless sessions can expire."""
    hit = F.coalesce(_holds(F.lower(html), indicators), F.lit(False))
    return hit if mode is None else hit & (mode == "login_then_headless")


def save_gate(text: Column, save_format: Column | str = ".md") -> Column:
    form = save_format if isinstance(save_format, Column) else F.lit(save_format)
    return F.coalesce((F.length(text) > LEAST_TEXT) & ~form.isin(NO_TEXT), F.lit(False))


def status_label(failed: Column, expired: Column, unchanged: Column, rendered: Column) -> Column:
    return (
        F.when(expired, "Session utgången")
        .when(failed, "Fel")
        .when(unchanged, "Oförändrad")
        .when(rendered, "Hämtad (Webbläsare)")
        .otherwise("Hämtad (Standard)")
    )


def table_title(title: Column) -> Column:
    """A title as a table can show it: without null characters, and with words where there is none."""
    return F.when(F.coalesce(title, F.lit("")) == "", "Ingen titel").otherwise(F.replace(title, F.lit("\x00"), F.lit("")))


def short_error(message: Column) -> Column:
    return F.substring(message, 1, SHORT_ERROR)
