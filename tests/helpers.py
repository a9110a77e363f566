"""Small builders shared by the tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline.operators.extract import extract_lines
from faultline.schemas import LOG_EVENTS, RAW_LINES

AS_OF = datetime(2026, 9, 1, 12, 0, 0)
BASE = datetime(2025, 11, 5, 6, 0, 0)


def as_of():
    return F.lit(AS_OF)


def lines(spark, values, run="r"):
    rows = [(run, "f.log", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RAW_LINES)


def parse(spark, values, run="r"):
    return extract_lines(lines(spark, values, run), as_of())


def events(spark, rows, run="r"):
    """rows of (seconds after BASE, service, level, message, status)."""
    data = [
        (run, i, BASE + timedelta(seconds=s), svc, lvl, msg, code, None, None, False, "test")
        for i, (s, svc, lvl, msg, code) in enumerate(rows)
    ]
    return spark.createDataFrame(data, LOG_EVENTS)


# An own outage, as a table: second after BASE, service, level, request, message. A search index
# fills its disk, the catalogue that asks it slows down, and the shop front loses its pages.
_OUTAGE = [
    (20, "search-index", "INFO", "", "segment merge took {n} ms"), (95, "shop-front", "INFO", "q{n}", "page served in {n} ms"),
    (170, "catalog-api", "INFO", "q{n}", "listing built from {n} rows"), (230, "shop-front", "DEBUG", "", "session store holds {n} keys"),
    (300, "search-index", "INFO", "", "segment merge took {n} ms"), (365, "catalog-api", "INFO", "q{n}", "listing built from {n} rows"),
    (430, "shop-front", "INFO", "q{n}", "page served in {n} ms"), (480, "search-index", "WARNING", "", "disk has {n} MB left"),
    (540, "catalog-api", "INFO", "q{n}", "listing built from {n} rows"), (545, "search-index", "CRITICAL", "", "disk full, index is read only"),
    (550, "search-index", "CRITICAL", "", "disk full, index is read only"), (555, "search-index", "CRITICAL", "", "disk full, index is read only"),
    (602, "catalog-api", "ERROR", "q{n}", "search gave no answer in {n} ms"), (605, "catalog-api", "ERROR", "q{n}", "search gave no answer in {n} ms"),
    (608, "catalog-api", "ERROR", "q{n}", "search gave no answer in {n} ms"), (663, "catalog-api", "CRITICAL", "q{n}", "giving up on search"),
    (665, "shop-front", "ERROR", "q{n}", "page failed with status 502"), (668, "shop-front", "ERROR", "q{n}", "page failed with status 502"),
    (671, "shop-front", "ERROR", "q{n}", "page failed with status 502"),
]


def _line(n, second, service, level, request, message):
    at = f"{BASE + timedelta(seconds=second):%Y-%m-%d %H:%M:%S}"
    return f"[{at}] [{service}] [{level}] " + (f"[{request}] " if request else "").format(n=n) + message.format(n=100 + n) + "\n"


OUTAGE = "".join(_line(n, *row) for n, row in enumerate(_OUTAGE))
