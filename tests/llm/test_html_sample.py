"""HTML model: the sample is of pages that give labels."""

from sparrowline.llm import html_training


def test_rare_labelled_pages_are_found(spark):
    menu = "<nav><a href=/a>home</a><a href=/b>about</a></nav>"
    text = "".join(f"<p>some words of a longer paragraph number {i} that is main text</p>" for i in range(6))
    rows = [(i, f"<html><body>{menu}<!-- <main> --><p>no labels in page {i}</p></body></html>") for i in range(60)]
    rows += [(100 + i, f"<html><body>{menu}<main>{text}</main><footer>{menu}</footer></body></html>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert html_training.fit(pages, sample=3).base != 1.0
    assert html_training.fit(pages.filter("page_id < 60"), sample=3).base == 1.0
