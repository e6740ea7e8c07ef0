import html
import re

import pytest
from oracle import same

from docquarry import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, tiny, name):
    same(catalogue.queries()[name](spark, tiny), catalogue.oracle_sql()[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, tiny, name):
    from docquarry.formats.html import extract_markup

    assert name == "html_text"
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html").collect()
    found = catalogue.queries()[name](spark, tiny).collect()
    assert len(found) == len(pages) > 0
    # Every word of an article's paragraphs is in the text, and no markup is.
    texts = {r.page_id: r.text for r in found}
    for r in pages:
        assert texts[r.page_id] == extract_markup(r.html).full_text and "<p>" not in texts[r.page_id] and "track(" not in texts[r.page_id]
        assert set(html.unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", r.html, re.S)[1])).split()) <= set(texts[r.page_id].split()) | set(re.sub("<[^>]*>", "", html.unescape(r.html)).split())


def test_entry_module_has_all(spark, tiny):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert "n_links" in entry.entry(spark).columns


def test_contains_match_needs_the_whole_passage(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, passage[:70]), (2, f"so: {passage}!"), (3, passage)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["contains_match"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_needles_in_blocks_and_unusual_ones(spark, monkeypatch):
    from docquarry.operators import relational as R

    monkeypatch.setattr(R, "NEEDLES", 2)
    docs = spark.createDataFrame([(3, "abc def"), (1, "xdefx"), (2, None), (None, "abc"), (4, "")], "i long, t string")
    needles = spark.createDataFrame([(1, "abc"), (2, "def"), (3, "zzz"), (4, None), (5, ""), (6, "def"), (7, "c d")], "k long, w string")
    found = {tuple(r) for r in R.contains_match(docs, "i", "t", needles, "k", "w", fallback=-1).collect()}
    assert found == {(1, 3), (2, 1), (3, -1), (4, -1), (5, 1), (6, 1), (7, 3)}


def test_paths_of_any_depth(spark):
    from docquarry.operators import relational as R

    nodes = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(7)] + [(9, 8, "lost")], "id long, parent long, name string")
    found = {r.node: (r.path, r.depth) for r in R.nested_paths(nodes, "id", "parent", "name").collect()}
    assert found == {i: ("/".join(map(str, range(i + 1))), i) for i in range(7)}


CUT = ["a &amp;&amp", "a&am", "R&", "&quo", "b &lt", "&amp;amp", "a &copy 1", "a &#38", "&ampere;", "&lt;i&gt; &quot;x&quot; &amp; y"]


@pytest.mark.parametrize("name", ["html_headings", "html_metadata", "html_links", "html_links_per_page"])
def test_references_that_a_cut_left_without_semicolon(spark, tmp_path, name):
    page = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{0}</title></head><body><h1>{0}</h1><p><a href="/a?b=1&copy=2">{0}</a> <a href="/a?b=1&amp;copy=2">x</a></p></body></html>'
    spark.createDataFrame([(i, page.format(t)) for i, t in enumerate(CUT)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same(catalogue.queries()[name](spark, str(tmp_path)), catalogue.oracle_sql()[name], str(tmp_path))


def test_references_are_read_as_browsers_do_unless_told_otherwise():
    from docquarry.formats.html import extract_markup

    heading = "<h1>R&amp;D &copy &#169; &ampx</h1>"
    assert extract_markup(heading).full_text == "R&D © © &x"
    assert extract_markup(heading, terminated=True).full_text == "R&D &copy © &ampx"


@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if n.startswith("html_")))
def test_markup_is_read_once_a_row(spark, tiny, name):
    """explode's own filter on what it gets must not read the page a second time."""
    plan = catalogue.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_few_pages_are_objects_at_a_time(spark):
    import pyarrow as pa

    from docquarry.operators import web

    pages = [None if i % 7 == 3 else f"<p>page {i}</p>" for i in range(1000)] + ["", f"<p>{'long ' * 300_000}</p>", f"<p>{'more ' * 300_000}</p>", "<p>last</p>"]
    found = list(web._pages(iter([pa.array(pages), pa.array([], pa.string()), pa.array(["<p>x</p>"])]), False))
    assert max(map(len, found)) <= 256 and sum(len(f.field("text")[i].as_py() or "") > 1 << 20 for f in found for i in range(len(f))) == 2
    assert all(sum(len(t.as_py() or "") for t in f.field("text")) < 3 << 20 for f in found)
    expected = [None if m is None else m.removeprefix("<p>").removesuffix("</p>").strip() for m in [*pages, "<p>x</p>"]]
    assert [r.as_py() and r.as_py()["text"] for f in found for r in f] == expected
    # Each text stays with its row, though answers come in smaller batches than pages go in.
    rows = spark.createDataFrame(list(enumerate(pages[:1000])), "page_id long, html string").coalesce(1)
    assert sorted(tuple(r) for r in web.texts(rows).collect()) == list(enumerate(expected[:1000]))
