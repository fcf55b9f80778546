"""What a run tells those who wait for it: a log on the driver, and a message to a web address."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import summary_line

#: Fixed values.
LOG_BYTES, LOG_BACKUPS = 5 * 1024 * 1024, 2
TABLE_ROWS, LOG_ROWS = 100, 500


def summary(stats: DataFrame, name: str = "site") -> str:
    """The summary lines of all sites (a row each), by name."""
    return "\n".join(r["line"] for r in summary_line(stats, name).orderBy("line").collect())


def post(address: str, text: str, seconds: float = 10) -> bool:
    """Sends {"text": text}; whether that went well: a message that can't be sent is no reason for a run to fail."""
    try:
        request = urllib.request.Request(address, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds):
            return True
    except (OSError, ValueError):
        return False


def run_log(folder: str, name: str) -> logging.Logger:
    """A log on the driver: <folder>/logs/<name>.log, of some MB, with two older ones."""
    os.makedirs(f"{folder}/logs", exist_ok=True)
    log = logging.getLogger(f"corpusloom.{name}")
    log.setLevel(logging.DEBUG)
    if not log.handlers:
        handler = logging.handlers.RotatingFileHandler(
            f"{folder}/logs/{name}.log", maxBytes=LOG_BYTES, backupCount=LOG_BACKUPS, encoding="utf-8"
        )
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log


def newest(rows: DataFrame, at: str, n: int = TABLE_ROWS) -> DataFrame:
    """The n rows a table shows: the newest, newest first."""
    return rows.orderBy(F.desc(at), *(c for c in rows.columns if c != at)).limit(n)


def cookie_header(cookies: Column) -> Column:
    """array<struct<name,value>> as the value of a Cookie header."""
    return F.array_join(F.transform(cookies, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")
