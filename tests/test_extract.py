from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.functions import text, time
from faultline.operators.extract import extract_csv, shift_timeline, tag_counts
from helpers import AS_OF, as_of, events, lines, parse

STAMP = datetime(2026, 8, 19, 10, 14)

CASES = {
    "bracket": (
        "[2026-08-19 10:14:00] [ticket-desk] [CRITICAL] [q-77/b] seat map could not be locked",
        dict(service_name="ticket-desk", level="CRITICAL", request_id="q-77/b", message="seat map could not be locked", timestamp=STAMP),
    ),
    "json": (
        '{"level": "fatal", "status": 429, "time": "2026-08-19T10:14:00Z", "msg": "quota used up", "service_name": "mail-out"}',
        dict(service_name="mail-out", level="CRITICAL", status_code=429, message="quota used up", timestamp=STAMP),
    ),
    "syslog": (
        "2026-08-19 10:14:00 tram-radio WARN: no echo from stop 31",
        dict(service_name="tram-radio", level="WARNING", message="no echo from stop 31", timestamp=STAMP, format="syslog"),
    ),
    "no_request": ("[2025-03-02 23:59:01] [ferry-board] [INFO] berth free", dict(request_id=None, message="berth free")),
    "only_brackets": ("[2025-03-02 23:59:01] [ferry-board] [INFO] [moored]", dict(request_id=None, message="moored", format="bracket")),
    "three_brackets": ("[2025-03-02 23:59:01] [ferry-board] [INFO]", dict(message=None, format="bracket")),
    "fallback": (
        "2026-08-19 10:00:00 something ERROR in order-service[22] code 503",
        dict(service_name="order-service", level="ERROR", status_code=503, format="fallback",
             message="something  in order-service[22] code 503", timestamp=datetime(2026, 8, 19, 10)),
    ),
    "unknown": ("hello world", dict(service_name="system", level="INFO", timestamp=AS_OF, ts_defaulted=True, message="hello world")),
    "scalar": ("123", dict(format="fallback", message="123")),
    "array": ("[1,2]", dict(format="fallback", message="1,2")),
    "status_word": ('{"message":"x 500","status":"OK"}', dict(status_code=None)),
    "status_float": ('{"message":"x 500","status":401.0}', dict(status_code=None)),
    "status_zero": ('{"message":"x 500","status":0}', dict(status_code=500)),
    "quoted_false": ('{"message":"false","msg":"b"}', dict(message="false")),
    "quoted_zero": ('{"message":"0","msg":"b","status":"0"}', dict(message="0", status_code=0)),
    "quoted_braces": ('{"message":"{}","severity":"[]"}', dict(message="{}")),
    "bare_false": ('{"message":false,"msg":0,"log":"c"}', dict(message="c")),
    "zeros": ('{"message":0.00,"msg":-0.0e3,"log":"c"}', dict(message="c")),
    "empty_things": ('{"message":{},"msg":[ ],"log":"c"}', dict(message="c")),
    "null_value": ('{"message":null,"msg":"","log":"c"}', dict(message="c")),
    "last_wins": ('{"message":"a","message":"b"}', dict(message="b", details={"message": "b"})),
    "separator": ("[2025-03-02 23:59:01] [a\x1eb] [INFO] c\x1ed\ue01e1", dict(service_name="a\x1eb", message="c\x1ed\ue01e1", format="bracket")),
    "separator_json": ('{"message":"x\ue01e0"}', dict(message="x\ue01e0")),
    "year_from_as_of": ("[Mar 2 23:59:01] [s] [INFO] m", dict(timestamp=datetime(2026, 3, 2, 23, 59, 1), ts_defaulted=False)),
    "aliases": ('{"msg":"b","log":"c","severity":"fatal","logger":"l"}', dict(message="b", level="CRITICAL", service_name="l")),
    "no_message": ('{"a":1}', dict(message='{"a":"1"}', service_name="unknown-service")),
    "trace_level": ("[2026-08-19 10:01:00] [x] [TRACE] m", dict(level="INFO")),
    "trailing_text": ('{"a":1} tail', dict(format="fallback")),
    "two_objects": ('{"a":1},{"a":2}', dict(format="fallback")),
    "fraction": ("at 2026-08-19 10:00:00.500 done", dict(status_code=500)),
    "bad_stamp": ("[someday] [svc] [INFO] m", dict(timestamp=AS_OF, ts_defaulted=True)),
    "accent": ("[2026-08-19 10:01:00] [café] [INFO] é500 déjà", dict(status_code=None, service_name="café")),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = parse(spark, [c[0] for c in CASES.values()]).collect()
    return {name: next(r for r in rows if r["line_no"] == i) for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_line_rules(parsed, name):
    for column, expected in CASES[name][1].items():
        got = parsed[name][column]
        assert (got or None) == expected if expected is None else got == expected, (column, got)


def test_blank_lines_give_no_event(spark):
    assert parse(spark, ["   ", "", "\t"]).count() == 0


@pytest.mark.parametrize(
    "value,code",
    [("Checkout failed with status code 500", 500), ("User received 404 Not Found", 404), ("Regular timeout", None), ("x5000", None)],
)
def test_status_code(spark, value, code):
    assert spark.range(1).select(text.extract_status_code(F.lit(value)).alias("c")).first()["c"] == code


@pytest.mark.parametrize(
    "value,rid",
    [
        ("Error trace req_id=e36a445d-7521-4f3e-8c3b-2877a9442a8b in component", "e36a445d-7521-4f3e-8c3b-2877a9442a8b"),
        ("Error trace request_id=req-9901 in component", "req-9901"),
        ("trace_id='(a1)', b", "a1"),
        ("at e36a445d-7521-4f3e-8c3b-2877a9442a8b.", "e36a445d-7521-4f3e-8c3b-2877a9442a8b"),
        ("nothing", None),
    ],
)
def test_request_id(spark, value, rid):
    assert spark.range(1).select(text.extract_request_id(F.lit(value)).alias("c")).first()["c"] == rid


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2026-08-19 10:14:00", STAMP), ("2026-08-19T10:14:00Z", STAMP), ("2026-08-19T12:14:00+02:00", STAMP),
        ("2026/08/19 10:14:00", STAMP), ("19/Aug/2026:10:14:00 +0000", STAMP), ("Wed, 19 Aug 2026 10:14:00 +0000", STAMP),
        ("08/19/2026 10:14:00", STAMP), ("2026-08-19 10:14:00,000", STAMP),
        ("19 Aug 2026 10:14:00", STAMP), ("20260819T101400Z", STAMP), ("202608191014", STAMP), ("20260819T121400+0200", STAMP),
        ("Wed Aug 19 10:14:00 2026", STAMP), ("Wed Aug 19 10:14:00 CEST 2026", STAMP), ("August 19th, 2026 10:14 AM", STAMP),
        ("Aug 19, 2026 10:14:00 pm", datetime(2026, 8, 19, 22, 14)), ("19-Aug-2026 12:14:00 AM", datetime(2026, 8, 19, 0, 14)),
        ("19.08.2026 10:14", STAMP), ("8/19/26 10:14", STAMP), ("31/12/2026", datetime(2026, 12, 31)), ("12/31/1999", datetime(1999, 12, 31)),
        ("10:14:00 2026-08-19", STAMP), ("2026-08-19 12:14:00 +0200", STAMP), ("2026-08-19T05:14-05:00", STAMP), ("2026 Sept 9", datetime(2026, 9, 9)),
        ("2026-08-19T10:14:00.123456789Z", STAMP.replace(microsecond=123456)), ("99:99", None), ("12:61:00 Aug 19 2026", None),
        ("19 Foo 2026", None), ("Aug 19 10:14:00", None), ("1755598440", None), ("30 Feb 2026", None), ("", None), ("2026-13-45", None), ("10:14", None), ("x", None),
    ],
)
def test_timestamps(spark, value, expected):
    assert spark.range(1).select(time.parse_timestamp(F.lit(value)).alias("t")).first()["t"] == expected


@pytest.mark.parametrize(
    "value,expected",
    [("Aug 19 10:14:00", datetime(2026, 8, 19, 10, 14)), ("Wed 19 Aug", datetime(2026, 8, 19)), ("10:14", datetime(2026, 9, 1, 10, 14)), ("Feb 29 10:14:00", None), ("x", None)],
)
def test_missing_parts_come_from_as_of(spark, value, expected):
    assert spark.range(1).select(time.parse_timestamp(F.lit(value), as_of()).alias("t")).first()["t"] == expected


def test_csv_rules(spark):
    rows = spark.createDataFrame(
        [("r", 0, "2026-08-19 10:14:00", "api", "error", "got 500", ""),
         ("r", 1, "", "", "", "got 500", "abc"),
         ("r", 2, None, None, None, None, "404")],
        "run_id string, line_no bigint, Time string, Component string, TYPE string, Log string, Code string",
    )
    out = extract_csv(rows, ["Time", "Component", "TYPE", "Log", "Code"], as_of()).orderBy("line_no").collect()
    assert [r["status_code"] for r in out] == [500, None, 404]
    assert [r["service_name"] for r in out] == ["api", "unknown-service", "unknown-service"]
    assert out[0]["level"] == "ERROR" and out[1]["timestamp"] == AS_OF
    assert out[2]["message"] == '{"Code":"404"}'


def test_message_masks(spark):
    cases = {
        "at 2026-08-19T10:14:00Z done": "at <timestamp> done",
        "from 10.0.0.1 port 80": "from <ip> port <num>",
        "id e36a445d-7521-4f3e-8c3b-2877a9442a8b": "id <uuid>",
        "ptr 0xDEADbeef": "ptr <hex>",
        "mail Jo.Doe@example.org now": "mail <email> now",
        "  a   b\t7 ": "a b <num>",
        "é5 x5 5": "é5 x5 <num>",
        "only words\u00a0here\n": "only words here",
        "abcdefab-abcd-abcd-abcd-abcdefabcdef": "<uuid>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    rows = text.add_template(df, "m", "t").collect()
    assert {r["m"]: r["t"] for r in rows} == cases


def test_tags(spark):
    rows = events(spark, [(0, "a", "INFO", "Connection refused, then TIMED OUT", None), (1, "a", "INFO", "fine", None)])
    assert {r["tag"]: r["n"] for r in tag_counts(rows).collect()} == {"connection_refused": 1, "timeout": 1}


def test_shift_moves_stamped_events_only(spark):
    rows = parse(spark, ["[2026-08-19 10:14:00] [a] [INFO] m", "no stamp"])
    anchor = F.lit("2026-08-19 10:14:00").cast("timestamp")
    out = {r["line_no"]: r["timestamp"] for r in shift_timeline(rows, as_of(), anchor).collect()}
    assert out == {0: AS_OF, 1: AS_OF}


def test_levels(spark):
    words = ["warn", " Fatal ", "trace", "INFO", "debug", "critical"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.normalize_level(F.col("w")).alias("l")).collect()
    assert [r["l"] for r in got] == ["WARNING", "CRITICAL", "INFO", "INFO", "DEBUG", "CRITICAL"]
