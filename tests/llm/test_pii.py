"""Strict spans against the plain patterns, accepted candidates on writings the fit has not seen."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import boosting, pii
from faultline.llm import queries as q

SCHEMA = "doc_id long, text string, id string, spans int, start int, redacted string"


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd, even = d[-1::-2], d[-2::-2]
        if 16 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["@", "a", "b.c", ".", "-", "+", "1", "23", "255", "256", "4111111111111111", "4111 1111-1111 1111", " ", "(", ")", "é", "_%", "\n", "00", "٣", "🙂"]), max_size=25))
def test_strict(parts):
    assert pii.strict("".join(parts)) == plain("".join(parts))


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_long_runs(model):
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "1 " * 100_000, "+" * 100_000, "a@" * 50_000, "+1" + " " * 200_000, "(" * 100_000):
        assert isinstance(model.accepted(text, pii.strict(text)), list)


def test_accepts_writings_and_leaves_lookalikes(model):
    rng = random.Random(77)
    hits, false = {k: 0 for k in pii.KINDS}, 0
    for n in range(400):
        kind = pii.KINDS[n % 4]
        before, own, after = pii.writings(rng, kind)
        text = f"thing of the order {before}{own}{after} and then some"
        start = text.index(own)
        spans = pii.strict(text) + [s[:3] for s in model.accepted(text, pii.strict(text))]
        hits[kind] += (kind, start, start + len(own)) in spans
        odd = f"thing of the order {pii.lookalike(rng)} and then some"
        false += len(model.accepted(odd, pii.strict(odd)))
    assert min(hits.values()) >= 80, hits
    assert false <= 8, false


def test_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pii.find(docs, model).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.strict] for r in got} == {i: plain(t) for i, t in text.items()}
    again = q.QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == (r.spans.count(",") + 1 if r.spans else 0) for r in again)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "x 🙂 a@b.cd, 1.2.3.4 +1 (234) 567-8901"), (3, "x 🙂 a@b.cd, 1.2.3.4 +1 (234) 567-8901"), (4, "z " * 300_000)]
    df = spark.createDataFrame([(i, t, "", 1, 2, "") for i, t in rows], SCHEMA)
    got = pii.find(df, model).collect()
    assert len(got) == 6 and [r.redacted for r in got if r.doc_id == 3] == ["x 🙂 [email], [ip] [phone]"] * 2
    assert pii.find(df.limit(0), model).collect() == []
    assert pii.learn(df.limit(0)).limits.keys() == set(pii.KINDS)


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(x[:1000], y[:1000])
    p = trees.probability(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.95 and abs(p.mean() - y[1000:].mean()) < 0.05
