"""Element tables, selectors and product formats on odd pages."""

import pytest
from pyspark.sql import functions as F

from brindle.sources import elements as el
from brindle.sources import products

PAGE = """<!DOCTYPE html><html lang=pt><head><title>T &amp; U</title><script>if (a < b) { "<p>no</p>" }</script></head>
<body><div class="a b" id="x"><p>one <b>two</b><p>three<ul><li>i<li class=b>j <div class="b"><span data-k="v w">deep</span></div></ul></div>
<div class=b><span data-k="vv">other</span><br/><img src=x></div></body></html>"""


@pytest.fixture(scope="module")
def table(spark):
    pages = spark.createDataFrame([("1", PAGE, 7), (None, "<div class=b><span data-k=v>null</span></div>", 8), ("2", None, 9), ("3", "", 9), ("4", "<a><b><c" + "<div>" * 300 + "x" * 50_000, 9)], "page string, html string, text int")
    return el.elements(pages).cache()


def found(table, selector):
    return [(r.page, r.tag, r.text[:20]) for r in el.select(table, selector, ["page"]).where("page = '1' OR page IS NULL").orderBy(F.col("page").desc_nulls_last(), "node").collect()]


def test_elements(table):
    rows = {(r.page, r.node): r for r in table.collect()}
    assert {p for p, _ in rows} == {"1", None, "4"}
    assert [r.tag for (p, _), r in sorted(((k, v) for k, v in rows.items() if k[0] == "1"))] == "html head title script body div p b p ul li li div span div span br img".split()
    assert rows["1", 2].text == "T & U" and rows["1", 3].text == 'if (a < b) { "<p>no</p>" }' and "if (a" not in rows["1", 1].text
    assert rows["1", 5].classes == ["a", "b"] and rows["1", 5].id == "x" and rows["1", 13].path == [0, 4, 5, 9, 11, 12]
    assert max(len(r.path) for (p, _), r in rows.items() if p == "4") >= 300


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("div.b span", [("1", "span", "deep"), ("1", "span", "other"), (None, "span", "null")]),
        ("#x span", [("1", "span", "deep")]),
        ("div > span", [("1", "span", "deep"), ("1", "span", "other"), (None, "span", "null")]),
        (".a > p", [("1", "p", "one two"), ("1", "p", "three")]),
        ("div div > span[data-k]", [("1", "span", "deep")]),
        ("span[data-k~=w], b", [("1", "b", "two"), ("1", "span", "deep")]),
        ("[data-k^='v'][data-k$=v]", [("1", "span", "other"), (None, "span", "null")]),
        ("li.b *", [("1", "div", "deep"), ("1", "span", "deep")]),
        ("title", [("1", "title", "T & U")]),
        (".nothing .b", []),
    ],
)
def test_selectors(table, selector, want):
    assert found(table, selector) == want


def test_unknown_selectors_are_errors(table):
    for bad in ("a:first-child", "", "a + b"):
        with pytest.raises(ValueError):
            el.select(table, bad, ["page"])


def test_products_of_odd_pages(spark):
    rows = [("https://h/produto/5/x", "script state", '<script id="__NEXT_DATA__">{broken</script><h1>Only a heading</h1>'), ("https://h/produto/5/x", "script state", '<script id="__NEXT_DATA__">{broken</script><h1>Only a heading</h1>'), ("u", "numbered ids", None), ("v", "none such", "<h1>x</h1>"), (None, "shop template", "<h1>a</h1><b class=price>12,5</b>"), ("w", "numbered ids", '<p id="valVista">R$ 10,00</p><p class="precode"><del>R$ 9,00</del></p>')]
    got = {r.url: r for r in products.read_products(spark.createDataFrame(rows, "url string, format string, html string")).collect()}
    assert len(got) == 5
    assert (got["https://h/produto/5/x"].title, got["https://h/produto/5/x"].product_id, got["https://h/produto/5/x"].outcome) == ("Only a heading", "5", "ok")
    assert got["https://h/produto/5/x"].sources == {"product_id": r"url:/produto/(\d+)", "title": "css:h1"}
    assert got["u"].outcome == "no_product" and got["v"].outcome == "unknown_format" and str(got[None].price) == "12.5000"
    assert (str(got["w"].price), str(got["w"].pix_price), got["w"].original_price) == ("10.0000", "10.0000", None)
