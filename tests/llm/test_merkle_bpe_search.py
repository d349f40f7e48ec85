"""Merkle manifest, byte-level BPE and ranked search against plain versions on odd cases and empty tables; their queries on a written folder."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.llm import base, byte_bpe, lexical_search, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, node int, tree string, top string, n int, b long, ids string"


@pytest.fixture(scope="module")
def rows(fixture_rows):
    langs = [None, "de", "en", "", "fr", "Z", "é"]
    out = [(r[0], r[1], "en" if k % 3 else langs[k % len(langs)], r[2], None if k % 5 == 0 else len(r[1] or "")) for k, r in enumerate(fixture_rows)]
    return [*out, out[8], out[8], (77, "only one of its tongue", "xx", None, 22)]


@pytest.fixture(scope="module")
def wide(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "t", "u", 5, 6, "v") for r in rows], DOCS).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout):
    """(root, siblings before and after each node by level)."""
    path, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k - k % fanout : k - k % fanout + fanout]
            path[leaf].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        at = [k // fanout for k in at]
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0] if nodes else None, path


def plain_manifest(rows, fanout):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r, plain_leaf(*r)))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in names:
        trees[t].sort(key=lambda x: ((x[0][0] is not None, x[0][0] or 0), x[1]))
        built[t] = plain_tree([x[1] for x in trees[t]], fanout)
    root, over = plain_tree([built[t][0] for t in names], fanout)
    for k, t in enumerate(names):
        for (r, leaf), path in zip(trees[t], built[t][1], strict=True):
            path = path + over[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = plain_leaf(*r[:4], r[4] + 1 if bad and r[4] is not None else r[4])
            for before, after in path:
                h = sha(before + h + after)
            yield r[0], leaf, built[t][0], root, sha("".join(a + b for a, b in path)), h, h == root


@pytest.mark.parametrize("fanout", [2, 3, 5, 20])
def test_manifest(wide, rows, fanout):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    got = merkle.manifest(wide, fanout, tampered).withColumn("fold", merkle.folded(F.coalesce("bad", "leaf"), F.col("path")))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")), "fold", F.col("fold") == F.col("root")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows, fanout), key=str)


def test_manifest_of_many_leaves_and_of_none(spark, wide):
    few = [(i, f"t{i}", "en" if i < 1100 else "de", "s", i) for i in range(1137)]
    df = spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle.manifest(df).withColumn("fold", merkle.folded(F.col("leaf"), F.col("path"))).select("doc_id", "subroot", "root", merkle.siblings(F.col("path")), "fold").collect()
    want = {(a, c, d, e) for a, _, c, d, e, _, _ in plain_manifest(few, 2)}
    assert {tuple(r[:4]) for r in got} == want and all(r.fold == r.root for r in got)
    assert merkle.manifest(wide.limit(0)).collect() == []


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(*byte_bpe.public_bpe())


@pytest.fixture(scope="module")
def plain_bpe(bpe):
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=byte_bpe.public_bpe()[1], mergeable_ranks=bpe.ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(2)
    out = ["", " ", "\n\n  x", "\x1c\x1d a\x1f", "a" * 511, "a" * 512, "a" * 513, "a" * 5000, "ab" * 700, "<|endoftext|>", "日本語" * 300, "\x00", "É" * 256, "x" + " " * 3000]
    out += ["".join(rnd.choice("abcde") for _ in range(3000)), "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(4000))]
    return out + ["".join(rnd.choice("etaoinsrhl") for _ in range(rnd.randint(1, 80))) for _ in range(1500)]


def test_bpe_is_that_of_the_library(bpe, plain_bpe):
    texts = odd_texts()
    ids, n = bpe.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain_bpe.encode_ordinary(t) for t in texts]
    again, _ = bpe.encode(texts)
    assert (again == ids).all()
    small = byte_bpe.ByteBpe(*byte_bpe.public_bpe(), memory=100)  # forgets all pieces before each call
    small.encode(texts[:40])
    assert small.encode(texts)[0].tolist() == ids.tolist()
    assert bpe.decode(ids)[0].tobytes() == "".join(texts).encode()
    with pytest.raises(ValueError):
        bpe.decode(np.array([len(bpe.lengths)], np.int32))


def test_pair_table_finds_all_and_only_its_pairs():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 300, 4000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 300, 4000).astype(np.uint64))
    pairs = byte_bpe.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    a, b = np.divmod(np.arange(90_000), 300)
    want = np.full(90_000, byte_bpe._NONE, np.int32)
    want[(keys >> np.uint64(32)).astype(int) * 300 + (keys & np.uint64(2**32 - 1)).astype(int)] = np.arange(len(keys))
    assert (pairs(a.astype(np.int32), b.astype(np.int32)) == want).all()
    assert (pairs(np.array([-1], np.int32), np.array([5], np.int32)) == byte_bpe._NONE).all()


def test_bpe_on_frames(spark, wide, rows, plain_bpe):
    got = byte_bpe.decode(byte_bpe.encode(wide, *byte_bpe.public_bpe()), *byte_bpe.public_bpe()).collect()
    want = [(r[0], tuple(plain_bpe.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows]
    assert sorted(((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in got), key=str) == sorted(want, key=str)
    assert byte_bpe.decode(byte_bpe.encode(wide.limit(0), *byte_bpe.public_bpe()), *byte_bpe.public_bpe()).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in byte_bpe.decode(null, *byte_bpe.public_bpe()).collect()] == [(1, [], b"")]


def plain_words(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))


def plain_search(docs, items):
    found = [(d, plain_words(t)) for d, t in docs]
    found = [(d, w, len(w)) for d, w in found if w]
    n, size = len(found), sum(x[2] for x in found)
    for item, text in items:
        scores = [0] * len(found)
        for term in plain_words(text):
            df = sum(term in w for _, w, _ in found)
            weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for k, (_, w, length) in enumerate(found):
                tf = w.count(term)
                m = 25 + (75 * length * n) // size
                scores[k] += weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        best = sorted((-s, d is None, d or 0) for s, (d, _, _) in zip(scores, found, strict=True) if s > 0)[:10]
        yield from ((item, rank + 1, None if null else d, -s) for rank, (s, null, d) in enumerate(best))


ITEMS = [(1, "The one word; lost"), (1, "hunter22 token ABC é"), (2, None), (3, ""), (None, "one"), (4, "zzz qqq"), (5, "of the and to in"), (6, "One ONE one"), (7, "The one word; lost"), (8, "Σ日本 c")]


@pytest.fixture(scope="module")
def items(spark, rows):
    more = [*ITEMS, (9, rows[8][1][:600]), (10, rows[8][1])]
    return more, spark.createDataFrame([(*r, 1, "k") for r in more], "item_id long, text string, rank int, key string")


@pytest.mark.parametrize("block,stages,together", [(11, 4, 512), (4, 3, 512), (5, 1, 3)])
def test_search(wide, rows, items, monkeypatch, block, stages, together):
    for name, value in (("BLOCK_BITS", block), ("STAGES", stages), ("ITEMS", together)):
        monkeypatch.setattr(lexical_search, name, value)
    got = lexical_search.search(wide, items[1]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_search([r[:2] for r in rows], items[0]), key=str)


def test_search_of_nothing(wide, items):
    assert lexical_search.search(wide.limit(0), items[1]).collect() == []
    assert lexical_search.search(wide, items[1].limit(0)).collect() == []
    assert lexical_search.search(wide.where("doc_id = 1"), items[1]).collect() == []


@pytest.fixture(scope="module")
def written(spark, wide, items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    wide.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    items[1].select("item_id", "text").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_queries_on_a_folder(spark, written, rows, items, plain_bpe):
    got = merkle.op11(spark, written)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows, 2), key=str)
    got = byte_bpe.op12(spark, written).collect()
    want = [(r[0], len(t := plain_bpe.encode_ordinary(r[1] or "")), sha(" ".join(map(str, t))), sha(r[1] or "")) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = lexical_search.op13(spark, written)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search([r[:2] for r in rows], items[0]), key=str)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_lexical_search"])
def test_same_as_sql(spark, folder, name):
    from check_oracle import compare, duck

    assert compare(base.QUERIES[name](spark, folder), duck(folder), base.SQL[name]) is None
