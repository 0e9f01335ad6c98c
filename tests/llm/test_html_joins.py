from specweave.llm import html_text


def test_main_blocks_are_joined_by_an_empty_line(spark):
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Big news</h1><p>This is a long text, with words. And more of them.</p></article><footer>&copy; me</footer>"
    row = html_text.extract_main_text(spark.createDataFrame([(4, "u", page)], "page_id long, url string, html string"), 400).first()
    assert row.text == "Big news\n\nThis is a long text, with words. And more of them."
    assert row.n_chars == len(row.text)
