"""Ranked search, fill-in-the-middle and token files against plain versions of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logloom.llm import fill_in_middle, queries, ranked_search, token_files

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=20):
    """Rows (item position, rank, doc_id, score) of all pairs, scored one by one."""
    counted = [(i, c, c.total()) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for at, (_, text) in enumerate(items):
        found = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(at, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_postings": 40, "k": 3}, {"block_terms": 12, "k": 5}])
def test_search_against_all_pairs(spark, options, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_ROUND", 2)
    rnd = random.Random(3)
    words = ["Ab", "ab", "c3", "é", "É", "中文", "x", "the", "the", "z9", "qq"]
    docs = [(i, rnd.choice([" ", "-", "\n", "__"]).join(rnd.choices(words, k=rnd.randrange(14)))) for i in range(120)]
    docs += [(500, "ab the x"), (501, "ab the x"), (500, "ab the x"), (None, "ab the x"), (600, None), (601, ""),
             (602, " -- "), (700, "rare " + "the " * 5000)]
    items = [(1, "Ab the x"), (2, "rare the THE the"), (3, None), (4, "--"), (5, "nowhere"), (6, "é É 中文 z9 z9 qq c3"),
             (6, "é É 中文 z9 z9 qq c3"), (None, "x x")]
    bench = spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, score double")
    table = spark.createDataFrame([(*d, [1], 7) for d in docs], "doc_id long, text string, terms array<int>, item int")
    got = ranked_search.search(table, bench, **options).collect()
    want = ranked(docs, items, options.get("k", 20))
    # repeated items have ranks of their own; rows of one rank differ in nothing else
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == \
        Counter((items[at][0], rank, i, s) for at, rank, i, s in want)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), bench).count() == 0
    assert ranked_search.search(docs, bench.limit(0)).count() == 0
    assert ranked_search.search(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_search_stops_early_and_long_texts_are_cut(monkeypatch):
    n = 20_000
    rng = np.random.default_rng(1)
    impact = np.concatenate([rng.integers(1, 1000, n), rng.integers(1, 1000, n)])
    impact[:30] = impact[n:n + 30] = 5000
    shard = ranked_search.Shard(2, np.repeat([0, 1], n), np.tile(np.arange(n), 2), impact)
    docs, scores, accesses = shard.best(np.array([0, 1]), np.array([3, 2]), 20, 0)
    assert accesses < n / 10 and sorted(docs.tolist()) == list(range(30)) and set(scores.tolist()) == {25_000}
    monkeypatch.setattr(ranked_search, "SLICE", 5)
    text = "Alpha beta-gamma  é " * 50
    assert ranked_search.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_rows(spark):
    rnd = random.Random(5)
    signs = ["a", "Z", " ", "\n", "é", "中", "😀", "̈", "<", ">", "S>", "<P", "\0"]
    docs = [(i, "".join(rnd.choices(signs, k=rnd.randrange(60)))) for i in range(400)]
    docs += [(None, "no id"), (None, None), (9, ""), (9, "x<M>y"), (7, "same"), (7, "same"), (8, "é😀" * 1_200_000)]
    table = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, output string, form int")
    found = fill_in_middle.fill_in_middle(table)
    found = found.withColumn("back", fill_in_middle.restored(found["output"], found["form"])).collect()
    want = Counter((*plain_fim(i, t), t or "") for i, t in docs)
    assert Counter(tuple(r) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(table.limit(0)).count() == 0


@pytest.mark.parametrize("segment", [7, 16, 1 << 20])
def test_pieces_of_any_segment_size(segment, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "SEGMENT", segment)
    rnd = random.Random(segment)
    for _ in range(60):
        texts = ["".join(rnd.choices("ab é中😀\n", k=rnd.choice([0, 1, 2, 5, 40, 200]))) for _ in range(rnd.randrange(12))]
        first = [rnd.randrange(len(t) + 1) for t in texts]
        second = [rnd.randrange(a, len(t) + 1) for a, t in zip(first, texts)]
        column = pa.array(["skipped", *texts]).cast(pa.binary()).slice(1)
        got = fill_in_middle._split(column, np.array(first, np.int64), np.array(second, np.int64))
        want = [(t[:a], t[a:b], t[b:]) for t, a, b in zip(texts, first, second)]
        assert [tuple(x.decode() for x in row) for row in zip(*(p.to_pylist() for p in got))] == want


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    packed = np.frombuffer(token_files.pack_bits(ids, width), np.uint8)
    assert len(packed) == -(-1001 * width // 8)
    assert (token_files.unpack_bits(packed, 0, 1001, width) == ids).all()
    for a, n in ((0, 0), (5, 1), (17, 100), (1000, 1), (333, 668)):
        assert (token_files.unpack_bits(packed, a, n, width) == ids[a:a + n]).all()


def test_segments_give_any_document():
    rng = np.random.default_rng(2)
    lengths = [1, 300, 0, 77, 5000]
    ids = rng.integers(0, 50_257, sum(lengths), dtype=np.uint32)
    data = (token_files.segment_bytes(3, 12, [4, None, -1, 7, 7], lengths, ids, 16, block=64) + b"\n") * 2
    for found in token_files.segments(data):
        assert (found.part, found.start) == (3, 12) and found.n_ids == len(ids)
        assert [None if null else int(d) for d, null in zip(found.doc_ids, found.nulls)] == [4, None, -1, 7, 7]
        for k, (first, n) in enumerate(zip(np.cumsum([0, *lengths]), lengths)):
            assert (found.document(k) == ids[first:first + n]).all()
        assert (found.ids(60, 200) == ids[60:260]).all()
    with pytest.raises(ValueError):
        token_files.Segment(memoryview(b"none" + data))


@pytest.mark.parametrize("sizes", [{}, {"segment_ids": 40, "range_bytes": 900, "least_bytes": 200, "segments_a_file": 2}])
def test_files_hold_the_tokenizers_ids(spark, tmp_path, sizes):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choices(["Hello", "world", "é中", "\n\n", "x1,", "<|endoftext|>"], k=rnd.randrange(12))))
            for i in rnd.sample(range(-50, 400), 150)]
    docs += [(None, "no id"), (None, None), (11_000, ""), (11_000, "twice"), (11_000, "twice"), (5000, "long " * 3000)]
    docs += [(7777, f"hot {k}") for k in range(80)]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, ids string").repartition(5)
    folder = f"{tmp_path}/files"
    token_files.write_tokens(table, folder, BPE, **sizes)
    found = sorted(token_files.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(BPE), 0
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in docs)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == want
    assert [r.doc_id for r in found] == sorted((i for i, _ in docs), key=lambda i: (i is None, i or 0))


def test_files_of_an_empty_table(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", BPE)
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_token_files_query_against_the_tokenizer(spark):
    tokenizer, start = Tokenizer.from_file(BPE), 0
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op13_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_fill_in_middle"])
def test_new_queries_against_sql(spark, name):
    from verify import compare, duck

    assert compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None
