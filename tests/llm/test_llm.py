"""The training-data operators against brute force, exact round trips, planted cases and awkward input."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import pickle
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scrubline import storage
from scrubline.llm import decontaminate, html_density, lm_bloom, lsh_forest, packing, prefix_bpe, quality, queries, simhash, token_histogram, token_table
from scrubline.llm.cached_encoder import CachedEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ODD = [(1, "a b c d e"), (1, "a b c d e"), (2, ""), (3, None), (None, "x y"), (None, None), (4, LONG), (5, "\n \t"), (6, "Ünïcode 中文 😀 text")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t, "bits", 7, "k", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, value string, bucket int, key string, tokens double")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.sql(queries.ORACLES[name])
    same_rows(df.collect(), df.columns, found.fetchall(), list(found.columns))


# 1 decontamination
def test_masks_are_lossless():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(all(m[i] == "0" or at + i not in gone for i in range(len(m))) for m in decontaminate.MASKS for at in range(decontaminate.WINDOW - len(m) + 1))


def brute_overlaps(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, text in docs:
        w = words(text)
        for item, passage in items:
            p = words(passage)
            width, allowed = min(13, len(p)), min(2, len(p) // 5)
            for shift in range(-len(p), len(w)):
                good = [i for i in range(max(0, shift), min(len(w), shift + len(p)) - width + 1) if width and sum(w[i + k] != p[i + k - shift] for k in range(width)) <= allowed]
                if good:
                    out.add((d, item, good[0], good[-1] + width, good[0] - shift))
    return out


def test_overlaps_equal_brute_force(spark):
    random.seed(1)
    vocabulary = [f"w{i}" for i in range(12)]
    make = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(k, make(n)) for k, n in enumerate((13, 14, 20, 30, 5, 1, 0, 7, 10, 12, 9))]
    docs = []
    for d in range(40):
        words = make(30)
        passage = list(items[d % 11][1] or ["none"])
        for _ in range(d % 4):
            passage[random.randrange(len(passage))] = "other"
        docs.append((d, " ".join([*words[:15], *passage[d % 3 :], *words[15:]])))
    docs += [(50, None), (51, ""), (None, " ".join(items[0][1])), (7, docs[7][1])]
    items = [(k, " ".join(p)) for k, p in items] + [(90, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_overlaps(docs, items)
    for block in (100_000, 40):  # one broadcast, and several
        got = decontaminate.overlaps(frame, bench, block=block).drop("text_hash").collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    clean = {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, *_ in expected}


def test_short_parts_are_lossless():
    for n in range(1, decontaminate.WINDOW):
        for gone in itertools.combinations(range(n), decontaminate.allowed(n)):
            assert any(not set(range(at, at + size)) & set(gone) for at, size in decontaminate.parts_of(n))


def test_overlaps_of_few_words_equal_brute_force(spark):
    """Texts of one, two or three words hit themselves in many alignments and in long runs."""
    random.seed(3)
    make = lambda n, k: " ".join(random.choice("abc"[:k]) for _ in range(n))
    docs = [(k, make(random.randrange(20, 90), 1 + k % 3)) for k in range(12)] + [(20, "a " * 60 + "b " + "a " * 60)]
    items = [(k, make(random.randrange(3, 80), 1 + k % 3)) for k in range(9)] + [(20, "a " * 45 + "c " + "a " * 30)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(frame, bench).drop("text_hash").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_overlaps(docs, items))


def test_a_repeated_word_in_text_and_item(spark):
    """n equal words meet m of them in n + m alignments, not n * m hits."""
    import time

    n, m = 20_000, 2_000
    frame, bench = spark.createDataFrame([(1, "so " * n)], "doc_id long, text string"), spark.createDataFrame([(1, "so " * m)], "item_id long, text string")
    start = time.time()
    rows = decontaminate.overlaps(frame, bench).drop("text_hash").collect()
    assert time.time() - start < 60
    expected = {(1, 1, max(0, s), min(n, s + m), max(0, s) - s) for s in range(13 - m, n - 12)}
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)


def test_many_items_that_share_a_beginning(spark):
    shared = " ".join(f"s{k}" for k in range(20))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(F.lit(shared + " "), F.expr("concat_ws(' ', transform(sequence(1, 20), k -> concat('i', id, '_', k)))")).alias("text"))
    docs = spark.createDataFrame([(1, f"x y {shared} z"), (2, "x y i77_1 i77_2 i77_3 i77_4 i77_5 i77_6 i77_7 i77_8 i77_9 i77_10 i77_11 i77_12 i77_13 z"), (3, "nothing of it")], "doc_id long, text string")
    for block in (250_000, 100_000):  # two blocks, and four
        got = decontaminate.overlaps(docs, items, block=block).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("doc_start").alias("low"), F.max("doc_end").alias("high")).collect()
        # two words after the shared ones may differ, so the last accepted window ends on one of them
        assert sorted((r.doc_id, r.n, r.low, r.high) for r in got if r.doc_id == 1) == [(1, 10_000, 2, 23)]
        assert sorted((r.doc_id, r.n) for r in got if r.doc_id != 1) == [(2, 1)]


def test_decontamination_runs_no_python(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_decontamination_of_awkward_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d e", 3)], "item_id long, text string, tokens int")
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, t in ODD if i != 1)
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == len(ODD) and decontaminate.overlaps(odd.limit(0), bench).count() == 0


# 2 sorted string tables
def test_token_tables_round_trip(spark, odd, tmp_path):
    tool = Tokenizer.from_file(BYTES)
    folder = str(tmp_path / "t")
    token_table.write_tables(odd, folder, BYTES, 2, shard_bytes=2000)
    got = token_table.starts(token_table.read_tables(spark, folder)).orderBy("start").collect()
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    at = 0
    by_id = {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        by_id.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    for i, t in ODD:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        assert (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) in by_id[i]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder + "/shards").collect()
    shards = [token_table.Shard(data) for r in files for _, data in token_table.shards_in(bytes(r.content))]
    assert len(shards) > len(files) and len([1 for s in shards for _ in s.lookup(1)]) == 2 and not any(s.lookup(99) for s in shards) and len([1 for s in shards for _ in s.lookup(None)]) == 2


def test_table_lookup_by_manifest(spark, tmp_path):
    tool, folder = Tokenizer.from_file(BYTES), str(tmp_path / "t")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    token_table.write_tables(docs, folder, BYTES, 2, shard_bytes=60_000, partition_bytes=200_000)
    manifest = spark.read.parquet(folder + "/manifest")
    assert manifest.select("file").distinct().count() > 1 and manifest.count() > manifest.select("file").distinct().count()
    table = token_table.Table(spark, folder)
    rows = docs.collect()
    for r in rows[::25]:
        assert [x.tolist() for x in table.lookup(r.doc_id)] == [[*tool.encode(r.text or "", add_special_tokens=False).ids, 2]]
    assert table.lookup(-5) == [] and table.lookup(None) == [] and table.lookup(10**12) == []


def test_ids_that_do_not_fit(spark, odd, tmp_path):
    for end, width in ((70_000, 2), (2, 3), (-1, 4)):
        with pytest.raises(ValueError):
            token_table.write_tables(odd, str(tmp_path / "w"), BYTES, end, width=width)


def test_shard_lookup_over_many_blocks():
    w = token_table.ShardWriter(0, 0, 0, 4)
    ids = {k: np.arange(k % 700, dtype=np.uint32) for k in range(-500, 500, 3)}
    for k, v in ids.items():
        w.add(token_table.table_key(k), v)
    shard = token_table.Shard(w.finish() + b"\n")
    assert len(shard.index) > 3 and all(np.array_equal(shard.lookup(k)[0], v) for k, v in ids.items()) and shard.lookup(-499) == [] and [k for k, _ in shard] == list(ids)
    with pytest.raises(ValueError):
        token_table.Shard(w.finish()[:-9])


def test_no_documents_no_tokens(spark, odd, tmp_path):
    token_table.write_tables(odd.limit(0), str(tmp_path / "e"), BYTES, 2)
    assert token_table.starts(token_table.read_tables(spark, str(tmp_path / "e"))).count() == 0


STRANGE = ["", " ", "\n\n", "a  b", " lead", "trail ", "a \n b", "x  y", "don't I'll", "1234 ½ ²", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "ΣΑΣ İı", "é é", "\x1ca\x1d b", "tab\tsep", "中文 字", "😀😀", "a b", "ա֋", "Ა"]


@pytest.mark.parametrize(("path", "kind"), [(BYTES, CachedEncoder), (WORDS, prefix_bpe.PrefixBpe)])
def test_encoders_equal_the_library(path, kind, documents):
    mine, library = kind(path), Tokenizer.from_file(path)
    random.seed(2)
    signs = "ab cD\n\t .,'!1é Σ  \x1c中😀"
    texts = STRANGE + ["".join(random.choice(signs) for _ in range(random.randrange(40))) for _ in range(400)] + [r.text for r in documents.limit(60).collect()]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = mine.encode(t)
        assert (got if isinstance(got, bytes) else got[1]) == struct.pack(f"<{len(e.ids)}I", *e.ids), t
        if isinstance(got, tuple):
            assert got[2].decode() == library.decode(e.ids, skip_special_tokens=False) == mine.decode(e.ids)


# 3 language model
def _words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [b"\n"]


def _middle(count):
    """The stored count of a bigram seen ``count`` times: the middle of its range between powers of 1.5, rounded up."""
    edges = [math.ceil(1.5**k - 1e-9) for k in range(63)]
    level = max(k for k, e in enumerate(edges) if e <= count)
    return (edges[level] + edges[level + 1] - 1) / 2


def brute_scores(rows, false_share):
    """``rows`` of id, text and whether held out, scored by a model kept in dictionaries."""
    singles, pairs = Counter(), Counter()
    for _, text, out in rows:
        if not out:
            singles.update(_words(text))
            pairs.update(zip([None, *_words(text)], _words(text), strict=False))
    n, v = sum(singles.values()), len(singles)
    rate = lambda c: c[1] / (c[1] + 2 * c[2] + 1) if c[1] else 0.5
    d1, d2 = (rate(Counter(c.values())) for c in (singles, pairs))
    followers, sums = Counter(), Counter()
    for (a, _), c in pairs.items():
        followers[a] += 1
        sums[a] += _middle(c)

    def p(a, b):
        one = max(singles[b] - d1, 0) / n + d1 * v / n / (v + 1)
        if a not in followers:
            return one
        whole = sums[a] + false_share * (v + 1 - followers[a]) * (1 - d2)
        return ((max(_middle(pairs[a, b]) - d2, 0) if pairs[a, b] else 0) + d2 * followers[a] * one) / whole

    out = []
    for i, text, held in rows:
        w = _words(text)
        base = sum(math.log10((singles[x] + 1) / (n + v + 1)) for x in w)
        out.append((str(i), held, len(w), sum(singles[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([None, *w], w, strict=False))))
    return sorted(out)


def _near(got, expected):
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5] == pytest.approx(e[5], rel=1e-9) and g[6] == pytest.approx(e[6], rel=1e-9), g[0]


def test_scores_equal_a_model_in_dictionaries(spark, documents, odd, monkeypatch):
    hidden = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (small, odd):
        rows = [(r.doc_id, r.text, zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2) for r in frame.collect()]
        expected = brute_scores(rows, 2.0**-40)
        # many probes: the filter never affirms what it doesn't hold
        for sizes in ({}, {"bucket_bytes": 5_000, "segment_bytes": 60_000}):
            _near(sorted((str(r[0]), *r[1:]) for r in lm_bloom.score_documents(frame, hidden, probes=(40, 40), **sizes).collect()), expected)
    usual = {(str(r.doc_id), r.n_tokens): r.score for r in lm_bloom.score_documents(small, hidden).collect()}
    wrong = [i for i, _, n, *_, score in brute_scores([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in small.collect()], 0) if abs(usual[i, n] - score) > 0.02 * abs(score)]
    assert len(wrong) <= 0.02 * len(usual)
    assert lm_bloom.score_documents(odd.limit(0), hidden).count() == 0
    assert {r.score for r in lm_bloom.score_documents(odd, F.lit(True)).collect()} == {0.0}
    held = [r for r in lm_bloom.score_documents(documents, hidden).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filters_do_not_pass_through_the_driver(spark, monkeypatch):
    """Only names and sizes of the buckets' files do; where Python can't open the shared folder, broadcasts give the same scores."""
    small, sizes = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {"bucket_bytes": 5_000, "segment_bytes": 60_000}
    context, sent, asked = spark.sparkContext, [], []
    send, own_folder = context.broadcast, lm_bloom.own_folder

    def broadcast(value):
        sent.append(len(pickle.dumps(value)))
        return send(value)

    def folder(*args):
        asked.append(own_folder(*args))
        return asked[-1]

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(lm_bloom, "own_folder", folder)
    with monkeypatch.context() as m:
        m.setattr(lm_bloom, "Segment", None)  # none is made here
        got = sorted(lm_bloom.score_documents(small, F.col("doc_id") % 7 == 2, **sizes).collect())
    assert len(sent) == 1 and sent[0] < 60_000
    assert not os.path.exists(asked[0].removeprefix("file://"))
    monkeypatch.setattr(lm_bloom, "opened_folder", lambda *_: None)
    assert sorted(lm_bloom.score_documents(small, F.col("doc_id") % 7 == 2, **sizes).collect()) == got and len(sent) > 3


def test_folders_that_python_opens(spark, tmp_path):
    uri = storage.opened_folder(spark, f"{tmp_path}/a b")
    assert uri == f"file://{tmp_path}/a%20b" and os.path.isdir(f"{tmp_path}/a b")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    assert storage.opened_folder(spark, "viewfs://kept/in/c") is None


def test_texts_in_pieces():
    text = "  Ab c  defgh\n\t" + LONG + " "
    whole = np.concatenate(list(lm_bloom.pieces(text)))
    assert len(whole) == len(_words(text)) and whole[-1] == lm_bloom.END
    for size in (1, 7, 1000):
        assert np.array_equal(np.concatenate(list(lm_bloom.pieces(text, size))), whole)


def test_probabilities_add_up_to_one(spark):
    """Over the vocabulary and the unknown word, after frequent, rare and unknown words, with the filter's own errors."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    model, segments = lm_bloom.train(texts, 400_000, bucket_bytes=20_000)
    segments = list(segments)
    names = np.unique(np.concatenate([s.names for s in segments]))
    counts = np.zeros(len(names), np.int64)
    rows = np.zeros((4, len(names)), np.int64)
    for s in segments:
        found, columns = s.words(names)
        rows[:, found] = columns
    counts = rows[0]
    assert (counts > 0).sum() == model.v and counts.sum() == model.n and len(model.deal.hot)
    words = names[counts > 0]
    single = np.append(model.single(counts[counts > 0]), model.single(np.zeros(1)))
    assert single.sum() == pytest.approx(1, abs=1e-9)
    rng = np.random.default_rng(5)
    sums = []
    for name in [*rng.choice(len(names), 120, False), *np.searchsorted(names, model.deal.hot[:5]), int(np.searchsorted(names, lm_bloom.START))]:
        v = np.full(len(words), names[name])
        hashes = lm_bloom.bigram_hash(v, words)
        buckets = model.deal.of_bigrams(v, hashes)
        levels = np.zeros(len(words) + 1, np.uint8)
        for k, s in enumerate(segments):
            mine = np.flatnonzero(model.homes[buckets] == k)
            levels[mine] = s.levels(buckets[mine], hashes[mine])
        own = rows[:, name].copy()
        own[1:3] = model.sums.get(int(names[name]), own[1:3])
        sums.append(model.after(single, levels, *(np.full(len(single), x) for x in own[1:])).sum())
    sums = np.array(sums)
    assert np.median(np.abs(sums - 1)) < 0.02 and abs(sums.mean() - 1) < 0.02 and sums.max() < 1.6


def test_bigrams_seen_once_count(spark):
    rows = [(i, "alpha beta gamma") for i in range(30)] + [(30, "alpha delta"), (31, "epsilon zeta"), (100, "alpha delta"), (101, "alpha zeta")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_bloom.score_documents(frame, F.col("doc_id") >= 100).collect()}
    assert abs(got[100].base_score - got[101].base_score) < 1e-9 and got[100].score > got[101].score + 0.1


def test_levels_survive_the_filter():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    levels = lm_bloom.level_of(rng.geometric(0.1, len(hashes)))
    m, bits = lm_bloom._filter(hashes, levels, (16, 10))
    deal = lm_bloom.Deal(4)
    table = lm_bloom.Segment([{"bucket": 3, "m": m, "probes": [16, 10], "bits": bits, "n": 0, "words": b""}], deal)
    at = np.full(len(hashes), 3)
    found = table.levels(at, hashes)
    assert (found >= levels).all() and (found == levels).mean() > 0.98 and (table.levels(at, hashes + np.uint64(1)) > 0).mean() < 0.01 and not table.levels(at + 1, hashes).any()


# 4 neighbours
def test_forest_finds_exact_scores_and_ties(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in base[i % 290]], "x") for i in range(300)] + [(400, None, ""), (401, [0.0] * 16, ""), (402, [1.0, None] * 8, ""), (403, [float("nan")] * 16, ""), (404, [1.0], ""), (None, [1.0] * 16, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    for sizes in ({}, {"block": 60, "group": 16}):
        got = lsh_forest.search(frame, frame.where("vec_id % 50 = 0"), 5, **sizes).collect()
        unit = base[np.arange(300) % 290]
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        hits = 0
        for q in range(0, 300, 50):
            cosines = unit @ unit[q]
            cosines[q] = -9
            truth = sorted(range(300), key=lambda i: (-round(cosines[i], 12), i))[:5]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [r[0] for r in mine] == [1, 2, 3, 4, 5] and all(abs(s - cosines[i]) < 1e-12 for _, i, s in mine)
            hits += len(set(truth) & {i for _, i, _ in mine})
        assert hits >= 0.9 * 30 and {r.query_id for r in got} == set(range(0, 300, 50))
    assert lsh_forest.search(frame.limit(0), frame, 5).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, round(r.score, 6)) for r in lsh_forest.search(few, few.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.707107)]


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = [r.vec_id for r in rows]
    got = {}
    for r in lsh_forest.search(frame, frame.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k, i in enumerate(ids):
        if i % 50 == 0:
            cosines = unit @ unit[k]
            cosines[k] = -9
            hits += len({ids[j] for j in np.argsort(-cosines)[:5]} & got[i])
    assert hits >= 0.9 * 5 * len(got)


def test_descent_and_ascent_equal_brute_force():
    """In a group's sorted strings: the longest matching prefixes, and all rows under a prefix."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    code = rng.integers(0, 1 << 12, 200)
    code[:40] = code[0]  # ties
    asked = np.concatenate([code[:5], rng.integers(0, 1 << 12, 20)])
    index = pa.table({"id": pa.array(np.arange(200)), "code": pa.array(code)})
    common = lambda x, y: 12 - int(x ^ y).bit_length()
    pairs = lambda t: [(q, i) for q, b, ids in zip(*(t[c].to_pylist() for c in ("query", "block", "ids")), strict=True) for i in np.frombuffer(ids, np.int64).tolist() if i % 3 == b]
    found = lsh_forest._descended(3, 4)(index, pa.table({"query": pa.array(np.arange(25)), "code": pa.array(asked)}))
    got = {}
    for q, i in pairs(found):
        got.setdefault(q, []).append(i)
    assert all(max(common(asked[q], code[i]) for i in got[q]) == max(common(asked[q], c) for c in code) and 4 <= len(got[q]) <= 8 for q in range(25))
    for level in (0, 3, 7, 12):
        found = lsh_forest._ascended(3, 12)(index, pa.table({"query": pa.array(np.arange(25)), "code": pa.array(asked), "level": pa.array(np.full(25, level))}))
        expected = sorted((q, i) for q in range(25) for i in range(200) if common(asked[q], code[i]) >= level)
        assert sorted(pairs(found)) == expected


def test_clustered_vectors_need_few_candidates(spark):
    """Where neighbours are near, few rows are scored and none is missed; equal vectors are named by their smallest ids."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((100, 32))
    base = np.repeat(centres, 10, 0) + 0.15 * rng.standard_normal((1000, 32))
    base[500:700] = base[500]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    got = {}
    rows = lsh_forest.search(frame, frame.where("vec_id % 50 = 0"), 5, group=64).collect()
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 1000, 50):
        cosines = np.round(unit @ unit[q], 12)
        cosines[q] = -9
        assert got[q] == np.lexsort((np.arange(1000), -cosines))[:5].tolist()
    assert np.mean([r.candidates for r in rows]) < 100


# 5 token counts
def test_context_limits(spark, odd, documents):
    for frame in (odd, documents):
        lengths = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch([r.text or "" for r in frame.collect()], add_special_tokens=False)]
        got = {r.context_limit: r for r in token_histogram.context_limits(token_histogram.length_histogram(frame, BYTES)).collect()}
        assert set(got) == set(lengths)
        for limit, r in got.items():
            assert (r.n_docs, r.docs_within, r.docs_over) == (lengths.count(limit), sum(x <= limit for x in lengths), sum(x > limit for x in lengths))
            assert (r.tokens_within, r.truncated_tokens, r.total_tokens, r.total_docs) == (sum(x for x in lengths if x <= limit), sum(min(x, limit) for x in lengths), sum(lengths), len(lengths))
            assert r.quantile == r.docs_within / len(lengths)
    assert token_histogram.context_limits(token_histogram.length_histogram(odd.limit(0), BYTES)).count() == 0


# 6 near duplicates
def brute_fingerprint(text, width=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[top(a)] = top(b)
    return {p: top(p) for p in parent}


def test_near_duplicates(spark, documents, odd):
    for frame in (documents, odd):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in frame.collect()]
        tops = brute_components({p for _, p in rows})
        least = {}
        for i, p in rows:
            if i is not None:
                least[tops[p]] = min(least.get(tops[p], i), i)
        expected = sorted((str(i), f"{p:016x}", str(least.get(tops[p]))) for i, p in rows)
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame).collect()) == expected
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_in_hot_groups(spark):
    random.seed(6)
    values = {random.getrandbits(64) & ~(1 << 63) for _ in range(60)}
    values |= {v ^ 1 << random.randrange(63) for v in list(values)} | {random.getrandbits(20) for _ in range(200)}
    full = (1 << 64) - 1
    assert {tuple(sorted(p)) for p in simhash.linked(sorted(values), full, 2)} == {tuple(sorted((a, b))) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2}
    frame = spark.createDataFrame([(v,) for v in values], "value long")
    for hot in (4096, 8):
        got = {r.value: r.component for r in simhash.classes(frame, 2).collect()} if hot == 4096 else None
        edges = simhash.links(frame, 2, hot).collect()
        tops = brute_components(values)
        parent = {v: v for v in values}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in edges:
            assert 0 < (r.a ^ r.b).bit_count() <= 2
            parent[top(r.a)] = top(r.b)
        assert len({(top(v), tops[v]) for v in values}) == len(set(tops.values())) == len({top(v) for v in values})
        if got:
            assert len(set(got.values())) == len(set(tops.values())) and all(got[v] <= v for v in values)


def test_keep_one(spark, odd):
    random.seed(7)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for g in range(30):
        text = [random.choice(words) for _ in range(200)]
        near = list(text)
        near[random.randrange(200)] = "changed"
        rows += [(10 * g, " ".join(text)), (10 * g + 1, " ".join(text)), (10 * g + 2, " ".join(near)), (10 * g + 3, " ".join(near[::-1]))]
    random.shuffle(rows)
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(x for g in range(30) for x in (10 * g, 10 * g + 3))
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "4", "6", "None"]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def _kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.keep_one(rows).collect())


def _jaccard(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_verifies_similarity(spark):
    """A repeated line doesn't make different texts near-duplicates, nor the same text with it another one."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    line = text(10)
    apart = [f"{text(200)} {' '.join([line] * 30)}" for _ in range(6)]
    base = text(300)
    same = [base, f"{base} {' '.join([line] * 5)}"]
    assert _jaccard(*apart[:2]) < 0.2 and _jaccard(*same) >= 0.8
    assert _kept(spark, apart + same) == list(range(7))


@pytest.mark.parametrize(("common", "own"), [(4, (0, 1)), (12, (1, 2)), (20, (2, 3)), (6, (0, 1))])
def test_keep_one_misses_no_short_pair(spark, common, own):
    """Every pair of similarity 0.8 or more is found, however few its shingles."""
    rng = random.Random(common)
    texts = []
    for _ in range(40):
        words = [f"u{rng.randrange(10**9)}" for _ in range(common + 4)]
        texts += [" ".join([*words, *(f"{side}{k}" for k in range(n))]) for side, n in zip("xy", own, strict=True)]
    assert all(_jaccard(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert _kept(spark, texts) == list(range(0, 80, 2))


def test_the_budget_of_bits_is_lossless():
    """For all numbers of common and own shingles of a similarity of 0.8 or just above, the chance that more bits differ."""
    votes = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    for n in [*range(1, 48), 80, 150]:
        for common in range(math.ceil(0.8 * n), n + 1):
            own, most = n - common, int(common / 0.8 + 1e-9) - n
            for other in {max(0, most - 1), max(0, most)} if most >= 0 else ():
                differ = 0.0
                for k, p in enumerate(votes(common)):
                    a = sum(q for x, q in enumerate(votes(own)) if 2 * (k + x) > n)
                    b = sum(q for x, q in enumerate(votes(other)) if 2 * (k + x) > common + other)
                    differ += p * (a * (1 - b) + b * (1 - a))
                missed = sum(math.comb(128, k) * differ**k * (1 - differ) ** (128 - k) for k in range(simhash.BUDGET + 1, 129))
                assert missed < 1e-7, (common, own, other)


def test_keep_one_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = up[j], up[i]
            up = [new if x == old else x for x in up]
    least = {}
    for k, (name, _) in enumerate(rows):
        least.setdefault(up[k], name)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(least.values())


# 7 sharding
def plain_best_fit(sizes, capacity):
    bins, where = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[k]]
        if fits:
            where[k] = min(fits)[1]
        else:
            bins.append(max(capacity, sizes[k]))
            where[k] = len(bins) - 1
        bins[where[k]] -= sizes[k]
    return where


def _bins(sizes, ranges):
    """The bin of each item, equal sizes in their order."""
    seen, where = Counter(), []
    for s in sizes:
        where.append(next(b for size, first, end, b in ranges if size == s and first <= seen[s] < end))
        seen[s] += 1
    return where


def test_packing():
    random.seed(8)
    for _ in range(60):
        sizes = [random.randint(1, 70) for _ in range(random.randint(0, 120))]
        assert _bins(sizes, packing.best_fit_decreasing(list(Counter(sizes).items()), 60)) == plain_best_fit(sizes, 60)
    sizes = [1000, *[random.randint(1, 40) for _ in range(500)]]
    loads = Counter()
    for s, b in zip(sizes, _bins(sizes, packing.pack_into(list(Counter(sizes).items()), 8)), strict=True):
        loads[b] += s
    assert sorted(loads) == list(range(8)) and loads.most_common(1)[0][1] in (1000, max(loads.values()))
    even = sorted(loads.values())[:-1] if max(loads.values()) == 1000 else sorted(loads.values())
    assert max(even) - min(even) <= 0.05 * max(even)


@pytest.mark.parametrize("ranked", [250_000, 7])
def test_shards_equal_plain_best_fit_decreasing(spark, documents, monkeypatch, ranked):
    """All groups of the documents, packed one by one without a tree or a histogram."""
    monkeypatch.setattr(packing, "RANKED", ranked)
    rows = documents.collect()
    texts = Counter()
    for r in rows:
        texts[r.text] += len((r.text or "").encode()) + 8
    order = sorted(texts, key=lambda t: (-texts[t], hashlib.sha256(t.encode()).digest() if t is not None else b""))
    sizes = [texts[t] for t in order]
    expected = Counter()
    for size, b in zip(sizes, plain_best_fit(sizes, 60_000), strict=True):
        expected[b, size] += 1
    got = {}
    by_id = {r.doc_id: r.text for r in rows}
    for r in packing.shard_documents(documents, None, 60_000).collect():
        got.setdefault(r.shard, set()).add(by_id[r.doc_id])
    assert Counter((b, texts[t]) for b, ts in got.items() for t in ts) == expected
    for shards in (24,):
        slots = {}
        for r in packing.shard_documents(documents, shards).collect():
            slots.setdefault(r.shard, []).append(r.slot)
        assert sorted(slots) == list(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(spark, documents, odd):
    for frame, shards in ((documents, 24), (odd, 3)):
        rows = packing.shard_documents(frame, shards).collect()
        texts = sorted(((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in frame.collect()))
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == texts
        groups = {}
        for r in rows:
            groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert all(len(s) == 1 for (size, crc), s in groups.items() if size > 8)
        for s in range(shards):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))
    by_capacity = packing.shard_documents(documents, None, 60_000).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s <= 60_000 or r.n == 1 for r in by_capacity)
    assert packing.shard_documents(odd.limit(0), 24).count() == 0


# 8 html
PAGES = {
    "<html><body><nav>Menu</nav><div class='ad'>Buy</div><article><h1>T &amp; x</h1><p><b>One<br>two <p>Three</article><footer>f</footer>": "T & x\nOne two\nThree",
    "<body><div id=c><p>A first paragraph with enough words in it to be told from a menu.<p>And <a href=x>a linked</a> second one, of some length too.</div><ul><li><a href=1>Home</a><li><a href=2>About</a></ul>": "A first paragraph with enough words in it to be told from a menu.\nAnd a linked second one, of some length too.",
    "<article><p>Text one.</p><div class='comments'><p>Reader says something rather long about this text here.</p></div><form><input><label>x</label></form><p>Text two.</p></article>": "Text one.\nText two.",
    "<article><script>var t='</p>';</script><style>p{}</style><!-- c --><p>a\n  b&nbsp;c</p></article>": "a b c",
    "plain": "plain", "": "", "<p": "", "<nav>only menu</nav>": "",
}


def test_pages(spark):
    rows = [(k, "u", h, 1) for k, h in enumerate(PAGES)] + [(None, None, None, 2), (0, "u", list(PAGES)[0], 3), (99, "u", "<p>" + "<div>" * 5000 + "deep", 4)]
    got = html_density.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in got if r.page_id in range(len(PAGES))][: len(PAGES)] == list(PAGES.values()) and all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 99] == ["deep"]


_TEXT = " ".join(f"Sentence {k} of a text that tells something at some length, with a comma and a stop." for k in range(4))
_LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(30)) + "</ul>"


@pytest.mark.parametrize("home", ["article", "div", "section", "main"])
def test_densities_decide_what_is_text(home):
    """A list of links beside a text goes, in an article and outside one; short paragraphs and single links stay."""
    page = lambda inner: html_density.main_text(f"<html><body>{inner}</body></html>")
    text = f"Title\n{_TEXT}\nShort.\nSee this.\n{_TEXT}"
    own = f"<h1>Title</h1><p>{_TEXT}</p><p>Short.</p><p><a href=x>See this.</a></p>"
    assert page(f"<{home}>{own}{_LINKS}<p>{_TEXT}</p></{home}>") == text
    assert page(f"<{home}>{own}<p>{_TEXT}</p></{home}><div>{_LINKS}</div>") == text
    assert page(f"<div>{_LINKS}</div><{home}><h1>Title</h1><div><p>{_TEXT}</p><p>Short.</p></div></{home}>") == f"Title\n{_TEXT}\nShort."
    # links within sentences are text
    wiki = f"<p>{' '.join(f'<a href=/{k}>Link {k}</a> stands in a sentence that is longer than its link.' for k in range(9))}</p>"
    assert page(f"<{home}><p>{_TEXT}</p>{wiki}</{home}>").count("stands") == 9


def test_sibling_articles_reach_the_threshold():
    found = html_density.main_text(f"<body><article><p>{_TEXT}</p><p>{_TEXT}</p></article><article><p>{_TEXT}</p><p>{_TEXT}</p></article><div>{_LINKS}</div></body>")
    assert found == "\n".join([_TEXT] * 4)


def test_names_as_a_whole():
    kept = [("section", 'id="related-work"'), ("div", 'id="search-methods"'), ("h2", 'id="social-history"'), ("p", 'class="notice-period"'), ("h2", 'class="header"'), ("p", 'class="comment"')]
    gone = [("div", 'class="ad"'), ("div", 'class="ad-slot"'), ("section", 'class="related-posts"'), ("div", 'id="cookieNotice"'), ("ul", 'class="share-buttons"'), ("div", 'class="post-comments"')]
    for tag, name in kept:
        assert html_density.main_text(f"<article><p>{_TEXT}</p><{tag} {name}>Kept words.</{tag}></article>") == f"{_TEXT}\nKept words."
    for tag, name in gone:
        assert html_density.main_text(f"<article><p>{_TEXT}</p><{tag} {name}>Gone words.</{tag}></article>") == _TEXT


def test_deep_pages_take_linear_time():
    import time

    for page in ("<p>" + "<div>" * 80_000 + "deep", "<article>" + "<div class=x>" * 80_000 + "deep", "<span>" * 40_000 + "<p>" * 40_000 + "deep", "<b>" * 80_000 + "</i>" * 80_000 + "deep", "<ul><li>" * 20_000 + "<div>" * 20_000 + "<li>" * 20_000 + "deep", "<div>" * 40_000 + "deep" + "</nav>" * 80_000):
        start = time.time()
        assert html_density.main_text(page) == "deep"
        assert time.time() - start < 4


def test_given_pages(spark):
    from html import unescape

    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(unescape(b.replace("<b>", "").replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert html_density.main_text(r.html) == "\n".join(b for b in blocks if b)


# 9 encoding
def test_encoded_documents(spark, odd):
    library = Tokenizer.from_file(WORDS)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.encode_documents(odd, WORDS).collect())
    expected = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected) and prefix_bpe.encode_documents(odd.limit(0), WORDS).count() == 0


# 10 quality
def test_quality(spark, odd):
    random.seed(9)
    good = [f"{a}{b}" for a in "bcdfgk" for b in ("ane", "ilo", "ure", "oti")]
    rows, labels = [], []
    for i in range(900):
        words = [random.choice(good) for _ in range(60)]
        low, toxic = i % 5 == 0, i % 7 == 0
        if low:
            words = [w + "###" for w in words]
        if toxic:
            words[random.randrange(60)] = random.choice(("nastyone", "nastytwo"))
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else f"s{i % 40}"))
        if i % 2:
            labels.append((i, 0 if low else 1, 1 if toxic else 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame([*labels, labels[0], (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, marks).collect()}
    right = sum(got[i] == (i % 5 > 0 and i % 7 > 0) for i in got if i % 2 == 0)
    assert right >= 0.97 * 450
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    strange = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") > 2, F.lit("s")))
    assert quality.classify(strange, marks).count() == len(ODD) and quality.classify(strange, marks.limit(0)).where("not kept").count() == 0
    assert quality.classify(strange.limit(0), marks).count() == 0 and quality.keep_good(strange, marks.limit(0)).count() == len(ODD)


def brute_sites(rows):
    """Shares of hosts and paths shrunk by moments, in plain Python."""
    groups = lambda key: {k: [b for h, p, b in rows if key(h, p) == k] for k in {key(h, p) for h, p, _ in rows}}

    def strength(found):  # of (number, share, prior)
        n = sum(x[0] for x in found)
        s = sum(x[0] * (x[1] - x[2]) ** 2 for x in found)
        chance = sum(x[2] * (1 - x[2]) for x in found)
        spread = (s - chance) / max(n - sum(x[0] ** 2 for x in found) / n, 1e-9)
        typical = sum(x[0] * x[2] * (1 - x[2]) for x in found) / n
        return min(1e6, max(1.0, typical / spread - 1)) if spread > 0 else 1e6

    share = sum(b for *_, b in rows) / len(rows)
    hosts = groups(lambda h, p: h)
    k = strength([(len(b), sum(b) / len(b), share) for b in hosts.values()])
    host_share = {h: (sum(b) + k * share) / (len(b) + k) for h, b in hosts.items()}
    paths = groups(lambda h, p: (h, p))
    k = strength([(len(b), sum(b) / len(b), host_share[h]) for (h, _), b in paths.items()])
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    out = {}
    for (h, p), b in paths.items():
        own = (sum(b) + k * host_share[h]) / (len(b) + k)
        out[h, p] = (host_share[h], own, logit(own) - logit(share))
    return out


def test_site_shares_equal_brute_force(spark):
    random.seed(12)
    hot = [("a", f"p{i % 3}", float(random.random() < 0.7)) for i in range(300)]
    cold = [(f"h{random.randrange(30)}", random.choice(("x", "y", None)), float(random.random() < 0.15)) for _ in range(250)]
    for rows in (hot + cold + [(None, None, 0.25), (None, "x", 0.5), ("single", "x", 1.0)], [("a", "x", 0.5)] * 4):
        frame = spark.createDataFrame(rows, "host string, path string, bad double")
        got = {(r.host, r.path): (r.host_share, r.path_share, r.shift) for r in quality.site_posteriors(frame).collect()}
        expected = brute_sites(rows)
        assert got.keys() == expected.keys()
        for k, values in expected.items():
            assert got[k] == pytest.approx(values, rel=1e-9, abs=1e-9)
    assert quality.site_posteriors(frame.limit(0)).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 1.0)] * 80 + [("a", "x", 0.0)] * 20 + [("b", "x", 0.0)] * 100 + [("c", "x", 1.0), (None, None, 0.0)]
    got = {r.host: (r.host_share, r.path_share) for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, bad double")).collect()}
    assert got["a"][0] > 0.7 and got["b"][0] < 0.1 and got["b"][0] < got["c"][0] < 1.0 and None in got


def test_posteriors_follow_from_evidence_and_site(spark, documents):
    """The query's columns by brute force: site shares from all rows' evidence, posterior from both."""
    got = quality.classify(documents, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    by_id = {r.doc_id: (r.source, r.lang) for r in documents.collect()}
    sites = brute_sites([(*by_id[r.doc_id], r.evidence) for r in got])
    for r in got:
        host, path, shift = sites[by_id[r.doc_id]]
        p = min(1 - 1e-6, max(1e-6, r.evidence))
        assert (r.host_share, r.path_share) == pytest.approx((host, path), rel=1e-6)
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-(math.log(p / (1 - p)) + shift))), rel=1e-5) and r.kept == (r.posterior < 0.5)


def test_columns_named_like_the_operators_own(spark, documents):
    """Columns of the documents that bear names the stages use come back unchanged."""
    names = ("bad", "posterior", "site_host", "shift", "own_hash", "kept_id", "hash", "text_hash", "tokens")
    docs = documents.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, DATA)
        assert left.columns == docs.columns, name
        assert left.where(" or ".join(f"{n} <> concat('{n}-', doc_id)" for n in names)).count() == 0, name


# pipeline
def test_pipeline(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, DATA)
        assert docs.columns == documents.columns and 0 < docs.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id for r in last.collect()}


def test_texts_are_sent_in_bounded_batches(spark):
    from scrubline.llm import common

    session = spark.newSession()
    common.bounded_batches(session)
    assert session.conf.get(common.BATCH_SETTING) == common.BATCH
    session.conf.set(common.BATCH_SETTING, "1234567b")  # a session's own bound stays
    common.bounded_batches(session)
    assert session.conf.get(common.BATCH_SETTING) == "1234567b"
    session.conf.set(common.BATCH_SETTING, "1000b")
    rows = [(k, "x" * 700 * k) for k in range(6)]
    sizes = session.createDataFrame(rows, "id long, text string").coalesce(1).mapInArrow(lambda bs: (b for b in bs), "id long, text string")
    assert sorted((r.id, r.text) for r in sizes.collect()) == rows
