"""The pipeline and the registered queries of this package against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lakelens.llm import base, load, mixing, quality, token_output
from tests.llm.conftest import prose
from tests.llm.test_operators import plain_classes, plain_hits, plain_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(9)
    good = [prose(rnd, rnd.randint(30, 200)) for _ in range(90)]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(good)]
    docs += [(100 + i, " ".join(f"{w}$$$ ###" for w in good[i].split()), "en", "src0", 9) for i in range(45)]
    docs += [(200 + i, good[i] + " end", "en", "src1", 9) for i in range(8)] + [(210, good[3], "en", "src2", 9), (220, None, None, None, None), (221, "", "en", "src0", 0)]
    docs += [(230, prose(rnd, 30) + " " + " ".join(good[0].split()[:3]) + " leaked question of ten words or more about some thing " + prose(rnd, 40), "en", "src1", 9)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(35)]
    return docs, labels, [("q1", "Leaked question of ten words or more, about SOME thing")]


def write(spark, folder):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, items = write(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~quality.held_out(0, 5)))
    scores = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    kept = [d for d in docs if scores[d[0]] >= 0.3]
    kept = [d for d, c in zip(kept, plain_classes(kept), strict=True) if d[0] == c[1]]
    hits = {d: h for d, _, h, _ in plain_hits([d[:2] for d in kept], items)}
    kept = [d for d in kept if not hits[d[0]]]
    assert 230 not in {d[0] for d in kept} and not {200, 210} & {d[0] for d in kept}
    size = {d[0]: len(re.findall(r"[^ \t-\r]+", d[1] or "")) for d in kept}
    total, copies, taken = collections.Counter(), collections.Counter(r.doc_id for r in got), collections.Counter()
    for d in kept:
        total[d[3]] += size[d[0]]
        taken[d[3]] += size[d[0]] * copies[d[0]]
    target = plain_targets(dict(total))
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in target) and set(copies) <= set(size) and max(copies.values()) <= 2
    tokenizer, at = Tokenizer.from_file(token_output.tokenizer_path()), 0
    text = {d[0]: d[1] or "" for d in kept}
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array([*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    write(spark, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "n-gram Jaccard join":  # in test_operators
            assert stage(spark, table, str(tmp_path)).columns == COLUMNS
    empty = table.where("false")
    assert quality.stage(spark, empty, str(tmp_path)).count() == 0
    assert mixing.stage(spark, empty, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    queries, sql = load()
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries) == list(range(1, 11))
    assert set(sql) <= set(queries)


def test_slices_cover_all_rows():
    offsets = np.array([0, 3, 3, 10, 30, 31])
    assert [r for i, j in base.slices(offsets, 8) for r in range(i, j)] == list(range(5))
    assert base.ranges(np.array([4, 0]), np.array([2, 3])).tolist() == [4, 5, 0, 1, 2]


def test_spread_of_shares(spark):
    # ids with two labels teach nothing
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.training_rows(docs, labels, "quality", 10).select(F.col("doc_id")).collect()] == [2]
