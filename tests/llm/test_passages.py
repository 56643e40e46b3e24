"""Passages of over 50 words on fewer lines than a window."""

from brightloom.llm import line_dedup


def test_long_passages_on_one_or_two_lines(spark):
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    one, left, right, fifty, ends = w(0, 51), w(100, 130), w(200, 221), w(300, 350), w(400, 460)
    texts = [f"a\n{one}\nb\n{left}\n{right}\nc\n{fifty}\nd", f"e\n {one}\nf\n{left}\n\n{right}\ng\n{fifty}\nh\n{ends}\ni\n{ends}", one, f"{left}\n{right}", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r["__n_removed"]) for r in line_dedup.remove_repeats(docs).collect()}
    assert got == {0: (texts[0], 0), 1: (f"e\nf\n\ng\n{fifty}\nh\n{ends}\ni", 4), 2: ("", 1), 3: ("", 2), 4: ("short", 0)}
