"""URL rules that end inside a token of a URL."""

from logloom.llm import url_rules


def test_rule_that_ends_inside_a_token(spark):
    rules = url_rules.rule_table(spark, [("block", "example.com", "/priv"), ("block", "", "/sec")])
    urls = ["http://example.com/private/x", "http://example.com/priv", "http://example.com/pri", "http:///secret"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert found == {0: "block", 1: "block", 2: "allow", 3: "block"}
