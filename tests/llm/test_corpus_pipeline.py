"""The pipeline's stages and the registered text queries, against plain versions of their rules."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from logloom.llm import decontamination, packing, quality, queries
from test_near_copies import groups_of_all_pairs

SF = "/root/testdata/sf0.001"


def blankless(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    frames, at = {}, docs
    for name, function in corpus_pipeline.STAGES:
        at = function(spark, at, SF)
        if name != "best_fit_packing":
            assert at.columns == docs.columns
            at = spark.createDataFrame(at.collect(), at.schema)
        frames[name] = at
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in frames.items()}

    model = queries.quality_model(spark, SF)
    good = sorted(r.doc_id for r in quality.score_texts(docs, model).filter("predicted = 1").collect())
    assert ids["quality_classifier"] == good and 0 < len(good) < len(rows)

    best = {}
    for i in good:
        key, rank = blankless(rows[i]), (-len(rows[i]), i)
        best[key] = min(best.get(key, rank), rank)
    assert ids["exact_dedup"] == sorted(i for _, i in best.values())

    kept = ids["exact_dedup"]
    group, pairs = groups_of_all_pairs([(i, rows[i]) for i in kept])
    assert ids["simhash_near_dedup"] == sorted(set(group.values())) and pairs

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for i in ids["simhash_near_dedup"]:
        text = " " + decontamination.clean(rows[i]) + " "
        if not any(" " + decontamination.clean(item) + " " in text for item in items):
            clean.append(i)
    assert set(ids["benchmark_decontamination"]) <= set(clean)
    assert len(clean) - len(ids["benchmark_decontamination"]) <= 2  # half an item or reordered

    assert sorted(set(ids["best_fit_packing"])) == ids["benchmark_decontamination"]
    pieces = frames["best_fit_packing"].collect()
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    assert max(sizes.values()) <= 2048
    whole = packing.TokenIds(queries.public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(whole.encode(rows[i])) // 4 + 1 for i in ids["benchmark_decontamination"])
    assert sum(sizes.values()) == tokens


ODD = [(None, "no id " * 30), (None, None), (1, ""), (2, "The same text of some words. " * 9),
       (2, "The same text of some words. " * 9), (3, "The same text  of some words. " * 9), (4, "long " * 300_000)]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows, further columns with clashing names, no rows."""
    function = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, row int, sha string, node long, length int, features string"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in ODD], schema)
    found = function(spark, docs, SF)
    rows = found.collect()
    assert function(spark, docs.limit(0), SF).count() == 0
    if name == "best_fit_packing":
        assert len({(r.doc_id, r.piece) for r in rows}) >= 5 and sum(r.piece == 0 for r in rows) == len(ODD)
        return
    assert found.columns == docs.columns and all((r.row, r.sha, r.node) == (1, "x", 2) for r in rows)
    got = [(r.doc_id, r.text) for r in rows]
    assert all(r in ODD for r in got)
    if name == "exact_dedup":  # blanks do not count, most code points win
        assert sorted(got, key=str) == sorted([ODD[0], ODD[2], ODD[5], ODD[6]], key=str)
    elif name == "simhash_near_dedup":  # the smallest id stays, repeated rows once
        assert sorted(got, key=str) == sorted([ODD[0], ODD[2], ODD[3], ODD[6]], key=str)
    elif name == "benchmark_decontamination":
        assert len(got) == len(ODD)


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns)


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_exact_dedup", "op7_url_filter"])
def test_queries_against_sql(spark, name):
    from verify import compare, duck

    assert compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


def test_queries_without_sql_cover_their_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name in ("op3_quality_classifier", "op4_token_counts", "op6_language_id", "op10_simhash_near_dedup"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).collect()) == sorted(docs)
    assert {r.doc_id for r in queries.QUERIES["op5_best_fit_packing"](spark, SF).collect()} == set(docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert queries.QUERIES["op9_html_extraction"](spark, SF).count() == pages
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    items = {r.item_id: decontamination.clean(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    verbatim = {(i, k) for i, t in docs.items() for k, item in items.items()
                if f" {item} " in f" {decontamination.clean(t)} "}
    assert verbatim <= found and verbatim


def test_hashes_are_lower_case_hex(spark):
    row = queries.QUERIES["op2_exact_dedup"](spark, SF).first()
    assert len(row.text_sha256) == len(hashlib.sha256(b"").hexdigest()) and row.text_sha256 == row.text_sha256.lower()
