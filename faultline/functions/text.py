"""Text expressions: levels, status codes, request ids, masks and tokens.

Everything here is a Column built from JVM functions, so it stays inside
whole-stage code generation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import fixed

WHITESPACE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
WORD = r"[\p{L}\p{N}_]+"

# Word characters and boundaries follow Unicode, and '.' stops at line feeds only.
UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Trim all white space; the character-set trim is slow, so only padded texts take it."""
    padded = text.rlike(r"^[\s\x0b\x1c-\x1f\x85\xa0]|[\s\x0b\x1c-\x1f\x85\xa0]\z")
    return F.when(padded, F.trim(text, F.lit(WHITESPACE))).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_error(level: Column) -> Column:
    return level.isin(fixed.ERROR_LEVELS)


def is_critical(level: Column) -> Column:
    return level == "CRITICAL"


def is_5xx(status_code: Column) -> Column:
    return status_code.between(500, 599)


def normalize_level(level: Column) -> Column:
    word = F.upper(strip(level))
    known = F.when(word.isin(fixed.LEVELS), word)
    for synonym, target in fixed.LEVEL_SYNONYMS.items():
        known = known.when(word == synonym, F.lit(target))
    return known.otherwise(F.lit("INFO"))


def extract_status_code(text: Column) -> Column:
    digits = F.regexp_extract(text, UNICODE + fixed.STATUS_CODE, 1)
    return blank_to_null(digits).cast("int")


def extract_request_id(text: Column) -> Column:
    pair = F.when(text.contains("_id="), blank_to_null(F.regexp_extract(text, UNICODE + fixed.REQUEST_KEY_VALUE, 1)))
    uuid = blank_to_null(F.regexp_extract(text, UNICODE + fixed.REQUEST_UUID, 1))
    return F.coalesce(F.trim(pair, F.lit(fixed.REQUEST_TRIM)), uuid)


def contains_any(lowered: Column, words: list[str]) -> Column:
    hit = lowered.contains(words[0])
    for word in words[1:]:
        hit = hit | lowered.contains(word)
    return hit


def operational_tags(lowered: Column) -> Column:
    """Names of the phrase groups in a lower-case text; plain substring search beats patterns here."""
    hits = [F.when(contains_any(lowered, words), F.lit(tag)) for tag, words in fixed.OPERATIONAL_PHRASES.items()]
    return F.array_compact(F.array(*hits))


def mentions_dependency(text: Column) -> Column:
    return contains_any(F.lower(text), fixed.DEPENDENCY_WORDS)


def add_template(df: DataFrame, source: str, target: str) -> DataFrame:
    """Column ``target``: ``source`` with variable parts masked, blanks collapsed, in lower case.

    Every mask is a step of its own behind a plain substring or one-character test, so a
    text pays only for the masks it can need.
    """
    out = df.withColumn(target, F.col(source))
    text = F.col(target)
    tests = {
        "<TIMESTAMP>": text.contains(":") & text.contains("-"),
        "<UUID>": text.contains("-"),
        "<HEX>": text.contains("0x"),
        "<EMAIL>": text.contains("@"),
    }
    digit = text.rlike(r"\p{Nd}")
    for mask, pattern in fixed.MESSAGE_MASKS:
        masked = F.regexp_replace(text, UNICODE + pattern, mask)
        out = out.withColumn(target, F.when(tests.get(mask, digit), masked).otherwise(text))
    # A single plain blank stays as it is; anything else that is blank becomes one.
    collapsed = F.regexp_replace(text, UNICODE + r" \s+|[\s&&[^ ]]\s*", " ")
    return out.withColumn(target, F.lower(F.trim(collapsed)))


def tokens(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit("(" + WORD + ")"), F.lit(1))


def is_infra_service(name: Column) -> Column:
    return F.lower(name).rlike("|".join(fixed.INFRA_KEYWORDS))


def service_type(name: Column) -> Column:
    lowered = F.lower(name)
    kind = None
    for label, words in fixed.SERVICE_TYPE_KEYWORDS:
        hit = lowered.rlike("|".join(words))
        kind = F.when(hit, F.lit(label)) if kind is None else kind.when(hit, F.lit(label))
    return kind.otherwise(F.lit("application"))


def two_decimals(number: Column) -> Column:
    """Two-decimal text with exact halves rounded to even."""
    return F.format_string("%.2f", F.bround(number, 2))
