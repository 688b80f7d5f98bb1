"""URL filter: names are split by the counts of all words, however rare."""

from sparrowline.llm import urls


def test_rare_words_split_names(spark):
    text = " ".join(["common"] * 50 + ["usual"] * 40 + ["glimmer"] * 3 + ["haven"] * 3 + ["x" * 30])
    docs = spark.createDataFrame([(i, text) for i in range(4)] + [(9, "vile glimmer")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    few, full = urls.fit(docs, labels, vocabulary=2), urls.fit(docs, labels)
    assert "glimmer" not in few.words and full.segment("glimmerhaven") == ("glimmer", "haven")
    assert "x" * 24 not in full.words and full.words["x" * 30] == 4
    assert few.total == full.total == sum(full.words.values())
    few.blocked, few.allowed = full.blocked, full.allowed
    given = ["http://glimmerhaven.com/usual/7", "http://a.vileglimmer.net/", "none", None, "http://glimmerhaven.com/usual/7", "http://12/3"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, few, ()).collect()}
    assert len(got) == len(given) and got[0].block_score != 0
    for row in got.values():
        assert abs(row.block_score - full.score(row.host, row.path)) < 1e-9
