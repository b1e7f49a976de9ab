from __future__ import annotations

import os

import corpus_pipeline as cp
import pytest
from opskpi.llm.queries import llm_queries
from opskpi.llm.staging import Staging

from tests.conftest import SF_SMALL
from tests.llm import test_lines, test_setjoin, test_suffixes
from tests.llm.cases import awkward, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_and_ordered():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "suffix_dedup", "packing"]
    assert cp.ORACLE_SQL is None
    assert [int(n[2:].split("_")[0]) for n in llm_queries()] == list(range(1, 14))


@pytest.fixture(scope="module")
def rows():
    return [(i, t[:2500] if t else t) for i, t in awkward()] + test_lines.near_lines()[:20]


def test_each_stage_on_its_own_input(spark, rows):
    stage = dict(cp.STAGES)
    docs = frame(spark, rows, clash=False)

    def pairs(df):
        assert df.columns == COLUMNS
        out = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert all(r["n_chars"] == len(r["text"] or "") for r in df.collect())
        return out

    def frame_of(own):
        return frame(spark, own, clash=False)

    first = pairs(stage["language_id"](spark, docs, ""))
    assert all(any(c.isalpha() for c in t or "") for _, t in first)
    second = pairs(stage["line_dedup"](spark, frame_of(first), ""))
    want = [(i, t) for i, t, _, gone in test_lines.brute(first, whole=True) if not gone or test_setjoin.words(t)]
    assert sorted(second, key=repr) == sorted(want, key=repr)
    third = pairs(stage["jaccard_join"](spark, frame_of(second), ""))
    kept = {i for i, c, _, k in test_setjoin.brute(second) if k}
    kept |= {i for i, _ in second if i is None and (None, None) not in second}
    assert {i for i, _ in third} == {i for i in kept} and len(third) == len({i for i, _ in third})
    fourth = pairs(stage["suffix_dedup"](spark, frame_of(third), ""))
    left = {i: k.decode("utf-8", "ignore") for i, _, s, k in test_suffixes.brute(third, 400)
            if not s or test_setjoin.words(k.decode("utf-8", "ignore"))}
    assert dict(fourth) == left
    packed = stage["packing"](spark, frame_of(fourth), "").collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in fourth}


def test_few_rejected_texts_shuffle_no_document(spark, rows):
    docs = frame(spark, [*rows, (-9, "12345 67890")], clash=False)
    out = dict(cp.STAGES)["language_id"](spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the anti-join alone, against a table whose size is known when it is planned
    assert plan.count("Join") == 1 and "BroadcastHashJoin" in plan and "Aggregate" not in plan
    assert -9 not in {r["doc_id"] for r in out.collect()}


def test_extra_columns_with_clashing_names(spark):
    names = ("_th", "_id", "th", "id", "k", "r", "d", "kept", "rejected", "ids", "row", "n")
    text = awkward()[0][1]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *("?" for _ in names)) for i, t in ((1, text), (2, text), (3, text[::-1]))],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} string" for n in names))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [*COLUMNS, *names], name
    assert [r["doc_id"] for r in docs.collect()] == [1] or docs.count() <= 2
    assert cp.packing(spark, docs, "").count() >= 1


def test_twins_leave_one(spark):
    text = awkward()[0][1]
    got = cp.jaccard_join(spark, frame(spark, [(4, text), (4, text), (9, text)], clash=False), "").collect()
    assert [r["doc_id"] for r in got] == [4]


def test_line_dedup_verifies_without_the_texts_of_all_lines(spark, rows, monkeypatch):
    held, put = {}, Staging.put

    def seen(self, df, label="t"):
        held[label] = {p.split("-")[-1] for p in (os.listdir(self.root) if os.path.isdir(self.root) else [])}
        return put(self, df, label)

    monkeypatch.setattr(Staging, "put", seen)
    cp.line_dedup(spark, frame(spark, rows, clash=False), "").count()
    assert "forms" in held["members"]                                # lines that met others, each with its sketch, once
    assert "members" in held["links"] and not held["links"] & {"forms", "keys"}


def test_empty_table_through_all_stages(spark):
    docs = frame(spark, [], clash=False)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_whole_run(spark):
    out = cp.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    docs = out.select("doc_id").distinct().count()
    assert 0.6 * n < docs <= n
