"""The registered queries on a written folder of odd rows against plain versions of all their columns, and cases that operators must not miss."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.llm import base, chosen_path, decontamination, mixing, quality, secrets, spot_signatures, suffix_dedup, token_output, toxicity, warc

from .test_operators import plain_classes, plain_hits, plain_repeats, plain_secrets, plain_signatures, plain_targets, same


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def written(spark, fixture_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(fixture_rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    words = fixture_rows[8][1].split()
    items = [(1, " ".join(words[20:45])), (2, " ".join(words[40:52]).upper()), (3, "hunter22 and"), (4, None), (5, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], int(r[0] % 2), int(r[0] % 3 == 0)) for r in fixture_rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(3, "u", "x" * 50), (1, None, "x" * 50), (2, "c", None), (5, "u", ""), (9, "n", "alone é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, items, pages


def rows_of(df, *names):
    assert df.columns[: len(names)] == list(names)
    return [tuple(r[: len(names)]) for r in df.collect()]


def test_op1(spark, written, fixture_rows):
    want = []
    for r, (n, spans, kept) in zip(fixture_rows, plain_repeats([r[1] for r in fixture_rows]), strict=True):
        want.append((r[0], n, sum(b - a for a, b in spans), len(spans), kept))
    same(rows_of(suffix_dedup.op1(spark, written[0]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)


def test_op2(spark, written, fixture_rows):
    from tokenizers import Tokenizer

    tokenizer, want, start = Tokenizer.from_file(token_output.tokenizer_path()), collections.Counter(), 0
    got = sorted(rows_of(token_output.op2(spark, written[0]), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1])
    for r in fixture_rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((d, n, c) for d, _, n, c in got) == want
    for _, at, n, _ in got:
        assert at == start
        start += n
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda i: (i is not None, i))


def test_op2_files_have_stripes_that_can_be_skipped(spark, tmp_path):
    from pyarrow import orc

    rnd = random.Random(1)
    texts = [(i, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 9) for _ in range(60))) for i in range(6000)]
    token_output.write_tokens(spark.createDataFrame(texts, "doc_id long, text string"), f"{tmp_path}/a", token_output.tokenizer_path(), shards=2, stripe=100_000)
    files = [orc.ORCFile(str(p)) for p in (tmp_path / "a").glob("*.orc")]
    assert len(files) == 2 and all(f.nstripes > 1 for f in files)
    spans = sorted((f.read_stripe(k, ["doc_id"])["doc_id"].to_numpy().min(), f.read_stripe(k, ["doc_id"])["doc_id"].to_numpy().max()) for f in files for k in range(f.nstripes))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # so the statistics of a stripe exclude all others
    found = token_output.find_tokens(spark, f"{tmp_path}/a", [17, 5999])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [17,5999])]" in plan and found.count() == 2


def test_other_settings_of_a_tokenizer_are_kept(tmp_path):
    import json

    with open(token_output.tokenizer_path()) as f:
        settings = json.load(f)
    settings["normalizer"]["normalizers"] = settings["normalizer"]["normalizers"][:2]  # no lower case
    (tmp_path / "t.json").write_text(json.dumps(settings))
    encoder = token_output.ChunkEncoder(str(tmp_path / "t.json"))
    texts = ["Don't SHOUT at  me", "plain words", ""]
    ids, n = encoder.encode(texts, None)
    assert not encoder.known and ids.tolist() == [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]


def test_op3(spark, written, fixture_rows):
    order = sorted(fixture_rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    likeness = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    unclear = {13, 20}  # three rows have id 13, in the order of their hashes
    for k, (d, t, _) in enumerate(order):
        if d in unclear:
            continue
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, far = plain_signatures(t), plain_signatures(edited), plain_signatures(after)
        want.append((d, len(t), sha(edited), 8 * len(own), 8 * len(other), round(likeness(own, other), 9), round(likeness(own, far), 9)))
    got = rows_of(spot_signatures.op3(spark, written[0]), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert len(got) == len(fixture_rows)
    same([(d, n, e, len(f), len(g), round(a, 9), round(b, 9)) for d, n, e, f, g, a, b in got if d not in unclear], want)
    prints = collections.defaultdict(set)
    for r in got:
        prints[r[0], r[1]].add(r[3])
    assert all(len(v) == 1 for v in prints.values())  # equal texts, equal fingerprints


def test_op4(spark, written, fixture_rows):
    want = []
    for d, t, _ in fixture_rows:
        found = plain_secrets(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        want.append((d, *(sum(k == x for k, _, _ in found) for x in ("assign", "access", "hex")), sha(joined)))
    df = secrets.op4(spark, written[0])
    same(rows_of(df, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), want)
    assert df.columns[5] == "spans"


@pytest.mark.parametrize("op,remainder,modulus,least", [(toxicity.op5, 1, 3, 0.7), (quality.op10, 0, 5, 0.3)])
def test_op5_and_op10(spark, written, fixture_rows, op, remainder, modulus, least):
    got = rows_of(op(spark, written[0]), "doc_id", "held_out", "score", "predicted")
    assert collections.Counter(r[0] for r in got) == collections.Counter(r[0] for r in fixture_rows)
    for d, out, score, predicted in got:
        assert 0 <= score <= 1 and predicted == int(score >= least)
        assert out == (None if d is None else zlib.crc32(str(d).encode()) % modulus == remainder)


def test_op6(spark, written, fixture_rows):
    want = [(d, n, hit, len(items), sha(",".join(sorted(map(str, items)))), hit > 0) for d, n, hit, items in plain_hits([r[:2] for r in fixture_rows], written[1])]
    same(rows_of(decontamination.op6(spark, written[0]), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_op7(spark, written, fixture_rows):
    got = mixing.op7(spark, written[0])
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    size = collections.Counter()
    for r in fixture_rows:
        size[r[2]] += len((r[1] or "").split())
    target, taken = plain_targets(dict(size)), collections.Counter()
    for r in got.collect():
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken


@pytest.mark.parametrize("share", [0.25, 1.5])
def test_repeated_rows_do_not_move_a_source_off_its_target(spark, share):
    # one row, 40 % of a source, or all of it: whatever its hash, it is divided
    rows = [(i, "a b c d e", "s" if i % 2 else "t") for i in range(1500)]
    rows += [(90_001, "a b c d e", "s")] * 500 + [(90_000, "a b c d e", "t")] * 500 + [(90_002, "a b c d e", "u")] * 300 + [(90_003, "a b c d e", None)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(df, share=share).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t"), F.max("copies").alias("most")).collect()
    assert len(got) == 4
    for r in got:
        assert abs(r.n - r.t) <= 5 and r.most <= 2


def test_op8(spark, written, fixture_rows):
    same(rows_of(chosen_path.op8(spark, written[0]), "doc_id", "class_id", "n_links", "n_text_links"), plain_classes(fixture_rows))


def test_recall_of_the_join(spark):
    """Pairs right at the bound, against brute force."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(100):
        w = [word() for _ in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: (k := rnd.choice([89, 90, 91]))] + [word() for _ in range(100 - k)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_classes(rows)
    same([r[:4] for r in chosen_path.classes(df).collect()], want)
    assert sum(r[2] for r in want) > 30
    assert chosen_path.runs_for(0.99) == 3 and chosen_path.runs_for(chosen_path.RECALL) == 10
    assert chosen_path.expected_recall(10, 0.8) > 1 - 2e-7 > chosen_path.expected_recall(3, 0.8)


def test_op9(spark, written):
    want = []
    for p in written[2]:
        raw = (p[2] or "").encode()
        first = min(q[0] for q in written[2] if (q[2] or "") == (p[2] or ""))
        want.append((p[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p[0] == first else "revisit", None if p[0] == first else first))
    same(rows_of(warc.op9(spark, written[0]), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), want)


def test_pairs_of_neutral_terms_are_learned(spark):
    rnd, filler = random.Random(4), [f"w{i:03d}" for i in range(60)]
    rows = []
    for i in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        w = rnd.sample(filler, 12) + ["fool" if a else "calm", "rabble" if b else "people"]
        rnd.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows if i < 1000], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 1000) >= 0.95 * 500


def test_stages_keep_columns_of_any_name(spark, written, fixture_rows):
    names = "doc_id long, text string, source string, __t string, __quality double, __rest int, kept_id long, chosen boolean, threshold long"
    df = spark.createDataFrame([(*r, "mine", -1.0, 7, 8, True, 9) for r in fixture_rows], names)
    mine = ("mine", -1.0, 7, 8, True, 9)
    for stage in (quality.stage, chosen_path.stage, decontamination.stage, mixing.stage):
        out = stage(spark, df, written[0])
        assert out.columns == df.columns and {tuple(r[3:]) for r in out.collect()} <= {mine}
    for stage in (quality.stage, decontamination.stage):
        assert stage(spark, df.limit(0), written[0]).count() == 0
    assert token_output.stage(spark, df.limit(0), written[0]).count() == 0


def test_no_registered_query_lacks_a_check():
    checked = {"op1_suffix_dedup", "op2_token_output", "op3_spot_signatures", "op4_secrets", "op5_toxicity", "op6_decontamination", "op7_mixing", "op8_chosen_path", "op9_warc", "op10_quality", "op11_merkle_manifest", "op12_byte_bpe", "op13_lexical_search"}
    from lakelens.llm import load

    assert set(load()[0]) == checked and set(base.SQL) <= checked
