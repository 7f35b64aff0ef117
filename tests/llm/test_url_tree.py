"""Path-template trees below the fourth segment and beside many siblings."""

from echofold.llm import url_filter

RULES = (("t.net", "/a/b/c/d/spam/x", "block"), ("t.net", "/a/b/c/d/good/x", "allow"), ("t.net", "/m/bad/x", "block"), ("t.net", "/m/fine/x", "allow"),
         ("t.net", "/good/x", "allow"), ("t.net", "/spam/x", "block"))


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r.page_id].removeprefix("http://t.net"): r for r in url_filter.judge_urls(df, RULES).collect()}


def test_segments_after_the_fourth_count(spark):
    urls = [f"http://t.net/a/b/c/d/{s}/{k}{i}" for s in ("good", "spam") for k in "xy" for i in range(30)]
    got = judged(spark, [*urls, "http://t.net/a/b/c/d", "http://t.net/a/b/c/d/"])
    for i in range(30):
        good, spam = got[f"/a/b/c/d/good/y{i}"], got[f"/a/b/c/d/spam/y{i}"]
        assert (good.verdict, spam.verdict) == ("allow", "block")
        assert good.template.startswith("/a/b/c/d/good/") and spam.template.startswith("/a/b/c/d/spam/")
    assert (got["/a/b/c/d"].template, got["/a/b/c/d"].rule) == ("/a/b/c/d", None)


def test_merge_and_smoothing_below_the_first_level(spark):
    urls = [f"http://t.net/m/{s}/{k}{i}" for s in ("bad", "fine") for k in "xy" for i in range(30)]
    # Of the second level: two sections apart, and one without labels that leans on its parent.
    got = judged(spark, [*urls, "http://t.net/m/none/y1", "http://t.net/m/else/y2"])
    assert got["/m/bad/y1"].verdict == "block" and got["/m/fine/y1"].verdict == "allow"
    assert got["/m/none/y1"].template.startswith("/m/{*}/") and abs(got["/m/none/y1"].purity - 0.5) < 1e-6


def test_rare_siblings_do_not_pool_sections_with_evidence(spark):
    sections = [f"http://t.net/{s}/{k}{i}" for s in ("good", "spam") for k in "xy" for i in range(30)]
    few, many = (judged(spark, [*sections, *(f"http://t.net/r{i}/y" for i in range(n))]) for n in (3, 300))
    for got in (few, many):
        assert {got[f"/good/y{i}"].verdict for i in range(30)} == {"allow"} and {got[f"/spam/y{i}"].verdict for i in range(30)} == {"block"}
        assert got["/good/y1"].template.startswith("/good/") and got["/r1/y"].template.startswith("/{*}")
    assert all(few[u].purity == many[u].purity for u in few)
