"""Substring dedup of texts and repeated rows under a null id."""

from logloom.llm import substring_dedup


def test_texts_of_equal_32_bit_hash_keep_their_own_words(spark):
    """Two texts that Spark's 32-bit hash does not tell apart, both under a null id; one repeats a third."""
    made = spark.range(400_000).selectExpr("concat_ws(' ', 'x' || id, 'y' || id, 'z' || id, 'u' || id, 'v' || id, 'w' || id) AS text")
    made = made.selectExpr("text", "hash(text) AS h")
    h = made.groupBy("h").count().filter("count > 1").orderBy("h").first()["h"]
    a, b = [r.text for r in made.filter(made.h == h).collect()][:2]
    docs = spark.createDataFrame([(None, a), (None, b), (7, a)], "doc_id long, text string")
    found = substring_dedup.remove_repeats(docs, window=5, gram=2).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in found) == sorted([(0, ""), (0, b), (7, "")])


def test_runs_of_repeated_rows_are_listed_once(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(None, text)] * 30, "doc_id long, text string").selectExpr(
        "1L AS high", "2L AS low", "cast(text AS binary) AS text")
    found = substring_dedup.repeated_runs(docs, 5, 2, 8_192, 1_000_000).collect()
    assert len(found) == 1 and len(found[0].runs) == len(set(found[0].runs)) <= 50
