from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opskpi.llm.cells import by_cell, with_cells
from opskpi.llm.components import connected_components
from opskpi.llm.local import IdMemory, Links, key_runs, prefix_hash, span_hash, text_chunks, word_spans
from opskpi.llm.staging import Staging, scratch
from tests.llm.cases import Sets


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    n = 120
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(90)] + [(5, 5), (7, 8), (8, 7)]
    edges += [(i, i + 1) for i in range(200, 260)]  # a long chain
    sets = Sets(range(300))
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["comp"] for r in connected_components(
        spark.createDataFrame([*edges, (None, 3)], "a long, b long"), Staging(spark, "t")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in touched}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), Staging(spark, "t")).count() == 0


def test_shuffles_of_a_staged_table_go(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = held(), spark.conf.get(conf)
    df = spark.range(3000).repartition(3, F.col("id") % 7).groupBy((F.col("id") % 5).alias("k")).count()
    table = Staging(spark, "t").put(df)
    for _ in range(100):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(conf) == own
    assert {(r["k"], r["count"]) for r in table.collect()} == {(k, 600) for k in range(5)}


def test_scratch_tables_go(spark):
    kept = Staging(spark, "kept")
    with scratch(spark):
        inner = Staging(spark, "inner")
        table = inner.put(spark.range(5).toDF("x"))
        out = kept.put(table.where("x > 1"))
        assert table.count() == 5
    assert out.count() == 3
    left = spark._jvm.org.apache.hadoop.fs.Path(inner.root)
    assert not left.getFileSystem(spark._jsc.hadoopConfiguration()).exists(left)


def test_hub_is_one_component(spark):
    edges = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = connected_components(edges, Staging(spark, "t"))
    assert got.count() == 5000 and got.select("comp").distinct().collect()[0][0] == 0


def test_every_pair_meets_in_one_cell(spark):
    members = spark.range(40).select(F.col("id").alias("node"), (F.col("id") % 2).alias("comp"))
    members = members.union(spark.createDataFrame([(100, 9)], "node long, comp long"))
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    met = {}
    for r in by_cell(with_cells(members, sizes, 6)).collect():
        met.setdefault((r["comp"], r["cx"], r["cy"]), []).append((r["node"], r["blk"]))
    seen = {}
    for (comp, cx, cy), own in met.items():
        for i, bi in own:
            for j, bj in own:
                if i < j and (cx == cy or bi != bj):
                    seen[comp, i, j] = seen.get((comp, i, j), 0) + 1
    expected = {(c, i, j): 1 for c in (0, 1) for i in range(c, 40, 2) for j in range(i + 2, 40, 2)}
    assert seen == expected


def test_key_runs_over_batch_borders():
    keys = np.sort(np.random.default_rng(3).integers(0, 40, 200))
    t = pa.table({"k": keys, "v": np.arange(200)})
    for size in (1, 3, 7, 200):
        for least in (1, 2, 5):
            got = [(x.column("k")[0].as_py(), x.column("v").to_pylist()) for x in
                   key_runs(iter(t.to_batches(max_chunksize=size)), ["k"], least)]
            want = [(int(k), np.flatnonzero(keys == k).tolist()) for k in np.unique(keys) if (keys == k).sum() >= least]
            assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_link_matrix_is_the_closure(seed):
    rng = np.random.default_rng(seed)
    m = rng.random((25, 25)) < 0.05
    links, sets = Links(25), Sets(range(25))
    links.link_matrix(m)
    for i, j in zip(*np.nonzero(m), strict=True):
        sets.join(int(i), int(j))
    assert links.roots().tolist() == [sets.find(i) for i in range(25)]


def test_span_hashes_name_equal_words():
    texts = ["one two  three", None, "", "two\tthree\r\none", "tw o"]
    chunks = list(text_chunks(texts, lower=False))
    assert [(a, b) for a, b, _, _ in chunks] == [(0, 5)]
    _, _, buf, _ = chunks[0]
    a, b = word_spans(buf)
    h = span_hash(prefix_hash(buf), a, b)
    raw = buf.tobytes()
    names = [raw[i:j] for i, j in zip(a, b, strict=True)]
    assert names == b"one two three two three one tw o".split()
    assert len(set(h.tolist())) == len(set(names))
    assert len({(n, x) for n, x in zip(names, h.tolist(), strict=True)}) == len(set(names))


def test_id_memory_lays_out_what_it_learned():
    memory = IdMemory(3)
    words = {7: [1, 2], 9: [], 4: [5], 8: [6, 6, 6], 2: [1]}
    asked = []

    def learn_for(keys):
        def learn(places):
            asked.extend(int(keys[p]) for p in places)
            return [np.asarray(words[int(keys[p])], "<u4").tobytes() for p in places]
        return learn

    for keys in ([7, 9, 7], [7, 4, 8, 9], [2, 8, 7], []):
        k = np.asarray(keys, np.uint64)
        ids, end = memory.lay_out(k, learn_for(k))
        assert ids.tolist() == [x for w in keys for x in words[w]]
        assert end.tolist() == np.cumsum([len(words[w]) for w in keys]).tolist()
    assert asked.count(7) == 2  # the memory of three was full once
