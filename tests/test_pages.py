"""Page shredding and extraction."""

import datetime
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pricewell.sources import cards, contract_pages, pages, tables

RESULT_PAGE = """
<html><head><title>Реестр</title></head><body>
<main><div class="wide search-results__total">По запросу нашлось 4 508 записей</div>
<section>
<div class="search-registry-entry-block odd"><p>Закупка</p>
  <a class="registry-entry__header-mid__number" href="/contract/card?id=31">№ 31-07</a>
  <div class="price-block__value">42 000,10 ₽</div><div class="data-block__value">подписан 09.11.2023</div>
  <div class="registry-entry__body-href">Лицей &laquo;Север&raquo;</div>
</div>
<div class="search-registry-entry-block">
  <div class="data-block__value">28.03.2024</div><div class="price-block__value">по соглашению</div>
  <a href="https://z.example/contract/88" class="big registry-entry__header-mid__number">88</a>
</div>
<div class="search-registry-entry-block"><i>снято с публикации</i></div>
</section></main></body></html>
"""


def page_frame(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id BIGINT, html STRING")


def test_cards(spark):
    df = page_frame(spark, RESULT_PAGE, "<html><body><div>empty</div></body></html>", None)
    found = cards.search_cards(df, ["page_id"], "https://site.org").orderBy("card_no").collect()
    assert [(r.registry_no, r.date, r.price) for r in found] == [("№ 31-07", "09.11.2023", 42000.1), ("88", "28.03.2024", None)]
    assert [r.url for r in found] == ["https://site.org/contract/card?id=31", "https://z.example/contract/88"]
    assert (found[0].customer, found[1].customer, found[0].status) == ("Лицей «Север»", "", "")
    totals = {r.page_id: r.site_total for r in cards.site_totals(df, ["page_id"]).collect()}
    assert totals == {0: 4508, 1: 0, 2: 0}


def test_largest_number(spark):
    df = spark.createDataFrame([("1 234 найденных, 3 страницы",), ("нет",)], "t STRING")
    assert [r[0] for r in df.select(cards.largest_number(F.col("t"))).collect()] == [1234, None]


COMMON = """<html><body><table>
<tr><td>Дата заключения контракта</td><td> 01.02.2025 </td></tr>
<tr><td>ЗАКАЗЧИК</td><td>Школа №1</td></tr>
<tr><td>Цена контракта</td><td>1 500,50 ₽</td></tr>
</table></body></html>"""
PAYMENTS = """<html><body><table class="blockInfo specification">
<tr><th>№</th><th>Имя</th></tr>
<tr><td>1</td><td>Бумага для офисной техники</td><td>okpd2: 17.12.14 KTRU: 17.12.14.110-01</td><td>шт</td><td>10</td>
<td>150,05</td><td>1 500,50</td></tr>
<tr><td>2</td><td>Ручка</td><td></td><td>шт</td><td>5</td></tr>
</table><table class="other"><tr><td>a</td><td>b</td><td>c</td><td>d</td><td>e</td></tr></table></body></html>"""
FILES = """<a href="/a/doc.docx">Договор</a><a href="https://y.org/scan.PDF"></a>
<a href="/f/x.pdf">Печатная форма</a><a href="/page">other</a>"""


def test_contract_tabs(spark):
    common = spark.createDataFrame([(1, "https://s.org/common-info.html?reestrNumber=77&x=1", COMMON)], "k INT, url STRING, html STRING")
    facts = contract_pages.common_facts(common, ["k"], "url").first()
    assert (facts.reestr_number, facts.sign_date) == ("77", datetime.date(2025, 2, 1))
    assert (facts.customer, facts.supplier, facts.total_price) == ("Школа №1", "Не указан", 1500.5)
    assert (facts.currency, facts.execution_status) == ("RUB", "Не указан")
    items = contract_pages.line_items(spark.createDataFrame([(1, PAYMENTS)], "k INT, html STRING"), ["k"]).first()[1]
    assert [(i.item_number, i.okpd2_code, i.ktru_code, i.quantity, i.unit_price) for i in items] == [
        ("1", "17.12.14", "17.12.14.110-01", 10.0, 150.05), ("2", None, None, 5.0, None)
    ]
    found = contract_pages.attachments(spark.createDataFrame([(1, FILES)], "k INT, html STRING"), ["k"], "https://s.org/x")
    files = found.first()[1]
    assert [(f.name, f.url, f.file_type, f.is_printed_form) for f in files] == [
        ("Договор", "https://s.org/a/doc.docx", "docx", False),
        ("scan.PDF", "https://y.org/scan.PDF", "pdf", False),
        ("Печатная форма", "https://s.org/f/x.pdf", "pdf", True),
    ]
    form = found.select(
        contract_pages.printed_form(F.col("attachments"), F.lit("2025-01-01").cast("date"))["name"],
        contract_pages.printed_form(F.col("attachments"), F.lit("2024-12-31").cast("date"))["name"],
    ).first()
    assert tuple(form) == ("Печатная форма", None)


class Outline(HTMLParser):
    """Start tags and texts as the standard parser sees them."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.tags, self.links, self.texts, self.hidden = [], [], [], None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.links += [dict(attrs).get("href")] if tag == "a" else []
        self.hidden = tag if tag in ("script", "style") else None

    def handle_endtag(self, tag):
        self.hidden = None

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.texts.append("".join(data.split()))


def test_shredding_agrees_with_the_standard_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    shredded = {r.page_id: r for r in pages.shredded(df, ["page_id"]).collect()}
    for row in df.collect():
        mine, outline = shredded[row.page_id], Outline(row.html)
        assert [e.tag for e in mine.elements] == outline.tags
        assert [e.href for e in mine.elements if e.tag == "a"] == outline.links
        assert "".join("".join(t.split()) for t in mine.texts) == "".join(outline.texts)


TRICKY = """<DIV Class='a  b' id=x><p>one &amp; two<br/>three<!-- no --><b>four</p>
<script>if (a < b) { "<div>" }</script><a href="x?a=1&amp;b=2" title="a > b">five</a></div> < six"""


def test_tricky_markup(spark):
    row = pages.shredded(page_frame(spark, TRICKY), ["page_id"]).first()
    assert [(e.tag, e.parent, e.last) for e in row.elements] == [
        ("div", -1, 5), ("p", 0, 3), ("br", 1, 2), ("b", 1, 3), ("script", 0, 4), ("a", 0, 5)
    ]
    assert row.elements[0].classes == " a b " and row.elements[0].id == "x"
    assert row.elements[5].href == "x?a=1&b=2"
    assert row.texts == ["one & two", "three", "four", "five", "< six"]
    texts = pages.page_elements(page_frame(spark, TRICKY), ["page_id"]).orderBy("idx").select("text").collect()
    assert [t[0] for t in texts] == ["", "one & two three", "", "four", "", "five"]


def test_whole_pages_are_read(spark):
    html = "<div>" + "<p>x</p>" * 60_000 + "<a href='/end.pdf'>end</a></div>"
    df = page_frame(spark, *[html] * 12)
    rows = pages.shredded(df, ["page_id"]).select(F.size("elements"), F.size("texts")).collect()
    assert [tuple(r) for r in rows] == [(60_002, 60_001)] * 12
    assert pages.page_links(df, ["page_id"], F.lit("https://s.org/a/b")).first().url == "https://s.org/end.pdf"


@pytest.mark.parametrize(
    "href, url",
    [
        ("/a", "https://h.org/a"), ("//o.org/a", "https://o.org/a"), ("b", "https://h.org/x/b"), ("http://z/", "http://z/"),
        ("../b.html", "https://h.org/b.html"), ("./b/../c/./d#e", "https://h.org/x/c/d#e"), ("?p=2", "https://h.org/x/y?p=2"),
        ("#top", "https://h.org/x/y?z=1#top"), ("", "https://h.org/x/y?z=1"), ("../../../b", "https://h.org/b"),
        ("b?q=/../c", "https://h.org/x/b?q=/../c"), ("..", "https://h.org/"), ("mailto:a@b", "mailto:a@b"),
    ],
)
def test_absolute_urls(spark, href, url):
    row = spark.range(1).select(pages.absolute_url(F.lit(href), F.lit("https://h.org/x/y?z=1"))).first()
    assert row[0] == url == (urljoin("https://h.org/x/y?z=1", href))


BROKEN = ["<a ", "<a x='", '<p x="', "</i>", "<i>" * 3 + "</b>", "<!-- ", "<script>", "<", "<!doctype "]


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_pages_take_linear_time(piece):
    def seconds(n):
        shredder = pages._Shredder()
        start = time.process_time()
        shredder.page(piece * n + "<b>end</b>")
        return time.process_time() - start

    seconds(1_000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.02)


def test_deep_nesting_with_stray_ends():
    shredder = pages._Shredder()
    start = time.process_time()
    shredder.page("<div>" * 60_000 + "</span>" * 60_000 + "text" + "</div>" * 60_000)
    assert time.process_time() - start < 5
    assert shredder.texts == ["text"] and shredder.columns["t_to"][0] == 1


def test_labels_in_nested_markup(spark):
    html = """<div class="page"><div><span>Валюта</span><div>USD</div></div><table><tr><td>ЗАКАЗЧИК (сокр.)</td>
    <td><b>Дом</b> 7</td></tr></table><p>Поставщик</p><td>x</td></div>"""
    df = spark.createDataFrame([(1, "<tr><td>Поставщик:</td><td>ООО</td></tr>"), (2, html), (3, None)], "k INT, html STRING")
    got = pages.beside_labels(df, ["k"], ["заказчик", "Поставщик", "Цена"], ["td"]).collect()
    assert {r.k: r["values"] for r in got} == {1: [None, "ООО", None], 2: ["Дом7", None, None], 3: [None, None, None]}


def test_pages_are_spread_over_bounded_tasks(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1_000, 1, 3 * cores)
    assert tables.spread_pages(rows, rows, "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(tables, "TASK_PAGES", 100)
    spread = tables.spread_pages(rows, rows, "id")
    assert spread.rdd.getNumPartitions() == -(-1_000 // (100 * cores)) * cores
    assert sorted(r.id for r in spread.collect()) == list(range(1_000))


def test_attributes_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(pages, "KNOWN_TEXTS", 2)
    shredder = pages._Shredder()
    long = "x" * pages.KNOWN_CHARS
    shredder.page(f"<p class=a id=b><p class=a id=b><a href='{long}'><i class=c><b class=d></b>" + "<br>" * 3)
    assert shredder.columns["classes"] == [" a ", " a ", "  ", " c ", " d ", "  ", "  ", "  "]
    assert shredder.columns["href"][2] == long and shredder.columns["id"][:3] == ["b", "b", None]
    assert len(shredder.known) == 2


def test_cells_of_chosen_tables(spark):
    inner = '<table class="payments"><tr><th>c<b>d</b></th></tr></table>'
    html = f'<table class="notes"><tr><td>x</td></tr></table><table class="a line-items"><tr><td>1 &amp; 2</td><td>{inner}</td></tr><tr></tr></table>'
    rows = pages.table_cells(page_frame(spark, html, "", None), ["page_id"], "line-items|payments").orderBy("page_id").collect()
    # the rows of the inner table come for each of the two tables that hold them
    assert [r.cells for r in rows] == [[["1 & 2", "cd", "cd"], ["cd"], [], ["cd"]], [], []]


def test_tabs_are_never_broadcast(spark):
    from pricewell.operators import joins

    common = spark.createDataFrame([(1,), (2,)], "o_orderkey LONG")
    items = spark.createDataFrame([(1, [1])], "o_orderkey LONG, line_items ARRAY<INT>")
    files = spark.createDataFrame([(2, ["a"])], "o_orderkey LONG, attachments ARRAY<STRING>")
    joined = joins.contract_pages(common, items, files, "o_orderkey")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().toString()
    assert sorted(map(tuple, joined.collect())) == [(1, [1], []), (2, [], ["a"])]


def test_tags_are_remembered_only_if_they_end_alone():
    shredder = pages._Shredder()
    for html in ('<td class="a">x</td><td class="a">y</td>', "<a href=\"x>1</a>", "<a href=\"x>2</a>\">3</a>"):
        shredder.page(html)
    assert sorted(shredder.known_tags) == ["</a>", "</td>", '<td class="a">']
    assert shredder.columns["href"] == [None, None, '"x', "x>2</a>"]  # an open quote is text of the value
