"""Every stage of the pipeline against a plain loop over its own input."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from faultline.functions.staging import stage
from faultline.llm import mixing, quality
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import plain_print, reach

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, step in cp.STAGES:
        out.append(stage(step(spark, out[-1], SF), f"test_{name}"))
    return out


def test_columns(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns


def test_quality(spark, stages):
    model = quality.learn(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r.doc_id for r in stages[0].collect() if model.score(quality.describe(r.text.encode())[None])[0] >= 0.3]
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(want) and len(want) < stages[0].count()


def test_lines(stages):
    before = [(r.doc_id, r.text, r.source) for r in stages[1].collect()]
    after = sorted((r.doc_id, r.text, r.n_chars) for r in stages[2].collect())
    want = sorted((i, t, len(t)) for i, t, *_ in brute_lines(before, 10))
    assert after == want


def test_simhash(stages):
    rows = [(r.doc_id, plain_print(r.text)) for r in stages[2].collect()]
    top = reach([p for _, p in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), t in zip(rows, top, strict=True):
        least[t] = min(i, least.get(t, i))
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(least.values())


def test_mixing(stages):
    want = Counter()
    for r in mixing.plan_mix(stages[3]).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in stages[4].collect()) == +want


def test_packing(spark, stages):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    pieces, times = defaultdict(dict), Counter(r.doc_id for r in stages[4].collect())
    seen = Counter()
    for r in stages[5].collect():
        pieces[r.doc_id][r.start] = r.ids
        seen[r.doc_id] += r.length
    for i, t in texts.items():
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        assert seen[i] == times[i] * len(ids)
        if times[i] == 1:
            assert b"".join(x for _, x in sorted(pieces[i].items())) == b"".join(n.to_bytes(4, "little") for n in ids)
    assert cp.run(spark, SF).count() == stages[5].count()


ODD = "doc_id long, text string, lang string, source string, n_lines int, n_removed string, row int, score double, copies long, rank int, k1 long, text_2 string, size long, sequence_id int, id string"


def odd_rows(spark):
    line = "a line that every source carries"
    body = lambda i: f"Document number {i} tells of the river {i * 7} and of the hills beyond it, {i * 13} in all."
    rows = [(i, f"{body(i)}\n{line}\nIt ends with {i}.", "en", f"s{i % 12}") for i in range(60)]
    rows += [rows[3], rows[3], (None, body(70), "en", "s1"), (None, body(70), "en", "s1"), (None, None, None, None), (80, None, None, None), (81, "", None, "s2")]
    rows += [(82, body(82), None, None), (83, "The long one goes on and on. " * 40_000, "en", "s3")]
    return spark.createDataFrame([(*r, 1, "x", 2, 0.5, 3, 4, 5, "t", 6, 7, "i") for r in rows], ODD)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows_and_empty_tables(spark, name):
    step, docs = dict(cp.STAGES)[name], odd_rows(spark)
    before = Counter(r.doc_id for r in docs.collect())
    out = step(spark, docs, SF)
    if name == "packing":
        pieces = out.select("doc_id", "start", "length", "doc_tokens", "sequence_id").collect()
        assert Counter(r.doc_id for r in pieces if r.start == 0) == before
        assert [(r.length, r.doc_tokens) for r in pieces if r.doc_id in (80, 81)] == [(1, 1)] * 2
        assert sum(r.length for r in pieces if r.doc_id == 83) == next(r.doc_tokens for r in pieces if r.doc_id == 83) > 200_000
        assert step(spark, docs.limit(0), SF).collect() == []
        return
    assert out.columns == docs.columns
    rows = out.collect()
    after = Counter(r.doc_id for r in rows)
    assert {(r.n_lines, r.n_removed, r.row, r.score, r.copies, r.rank, r.k1, r.size) for r in rows} <= {(1, "x", 2, 0.5, 3, 4, 5, 6)}
    if name == "quality":
        assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    elif name == "line_dedup":
        assert after == before
        carried = [r.doc_id for r in rows if "every source" in (r.text or "")]
        assert carried == [0] and next(r for r in rows if r.doc_id == 83).text.count("long one") == 40_000
        assert {r.text for r in rows if r.doc_id in (80, 81)} == {None, ""}
    elif name == "simhash":
        assert after[3] == 1 and after[None] == before[None] and after[80] == 1 and 81 not in after
    else:
        assert set(after) <= set(before) and after[80] == after[81] == 0 or after[80] <= 2
    assert step(spark, docs.limit(0), SF).collect() == []


@pytest.mark.parametrize("name,step", cp.STAGES)
def test_batches_to_python_are_bounded_by_bytes(spark, name, step):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    step(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == cp.BATCH_SIZE


def test_a_text_goes_to_python_once(spark):
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, source string")

    def into_python(df):
        plan = quality.score(df, model, keep_row=True)._jdf.queryExecution().optimizedPlan()
        return plan.children().apply(0).output().size()

    assert into_python(docs) == 1
    assert into_python(docs.withColumn("text", F.col("text").cast("binary"))) == 2
    kept = quality.score(docs, model, keep_row=True).select("row.*").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, docs.collect()))
