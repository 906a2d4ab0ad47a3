import html as entities
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import op9_html as html
from gapwise.llm.op9_html import build, extract, render

CASES = [
    ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<div>one<br>two<br><br>three</div>four", "one\ntwo\n\nthree\nfour"),
    ("  a \n b <i> c</i>  d", "a b c d"),
    ("x&amp;y &lt;z&gt; &eacute;&#33;", "x&y <z> é!"),
    ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol><li>z</ul>", "- x\n- y\n  3. n\n  4. m\n- z"),
    ("<ul><li><p>a</p><p>b</p></li></ul>c", "- a\n\n  b\n\nc"),
    ("<h1>T</h1>text<hr>more", "T\n\ntext\n\nmore"),
    ("<pre>\n a  b\n\n  c</pre>d", " a  b\n\n  c\n\nd"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("<table><tbody><tr><td>a<br>b</td><td>c</td></tr></tbody></table>z", "a  c\nb\n\nz"),
    ("<table><tr><td colspan=2>wide one</td></tr><tr><td>x<td>y</table>", "wide one\nx  y"),
    ("<table>stray<tr><td>cell</table>", "stray\n\ncell"),
    ("<table><caption>C</caption><tr><td>1</table>", "C\n1"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    ("a<table><tr><td><ul><li>p<li>q</ul><td>r</table>", "a\n\n- p  r\n- q"),
    ("<head><title>t</title><style>s</style></head><body>b", "b"),
    ("<script>if (a<b) document.write('</p>')</script>seen<noscript>n</noscript>", "seen"),
    ("<p hidden>no<p style='color:red; display : none'>no<p style=visibility:hidden>no<p>yes", "yes"),
    ("<details><summary>s</summary>closed</details><details open><summary>t</summary>open</details>", "s\nt\nopen"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("a <!-- <p>no --> b<!DOCTYPE x><?php x ?>c", "a bc"),
    ("1 < 2 and <3 </ p> x", "1 < 2 and <3 </ p> x"),
    ("<a href='x\">link</a> <img alt=no> end", "link end"),
    ("<b>bold<i>both</b>it</i>", "boldbothit"),
    ("<p>a</div></span>b</p>c", "ab\n\nc"),
    ("<textarea>a &amp; <b></textarea>", "a & <b>"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<q>said</q>", '"said"'),
    ("", ""),
    ("<", "<"),
    ("no tags", "no tags"),
    ("<!-- never closed", ""),
    ("<script>never closed", ""),
    ("<div", "<div"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_text(page, text):
    assert render(page)[0] == text


def test_tree_has_implied_tags():
    root = build("<table><td>a<td>b<tr><td>c</table>")
    table = root.children[0]
    assert [c.tag for c in table.children] == ["tbody"]
    assert [[c.tag for c in row.children] for row in table.children[0].children] == [["td", "td"], ["td"]]


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert render(deep)[0] == "x"
    assert render("<table><tr><td>" * 300 + "y")[0].strip() == "y"
    long = "<p>" + "word " * 200_000
    assert len(render(long)[0]) == 999_999
    quotes = "<a href=\"x" * 5_000
    assert isinstance(render(quotes)[0], str)


def test_all_visible_words_come_out(spark, tiny_dir):
    """Against a plain removal of tags, on pages whose only hidden parts are head, scripts and styles."""
    import html
    import re

    pages = spark.read.parquet(f"{tiny_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert len(found) == pages.count()
    for p in pages.collect():
        body = re.sub(r"(?is)<head\b.*?</head>|<(script|style|title|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", p["html"])
        words = re.findall(r"\w+", html.unescape(re.sub(r"<[^>]*>", " ", body)))
        marks = re.sub(r"(?m)^\s*(?:- |\d+\. )", "", found[p["page_id"]])
        assert "".join(words) == "".join(re.findall(r"\w+", marks))


def test_odd_rows(spark):
    rows = [(1, None, "t"), (1, None, "t"), (None, "<p>x", "t"), (2, "", None), (3, "<p>x</p>" * 20_000, "t")]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string")
    found = sorted((r["page_id"] or 0, len(r["text"]), r["n_blocks"]) for r in extract(pages).collect())
    assert found == [(0, 1, 1), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 59_998, 20_000)]
    assert extract(pages.limit(0)).count() == 0


# -- size ------------------------------------------------------------------------------------

HARD = {
    "a table with one long cell": lambda n: "<table><tr><td>" + "w" * (10 * n) + "<td>b" + "<tr><td>a<td>b" * n,
    "a table with very many columns": lambda n: "<table><tr>" + "<td>abcdefgh" * n + "<tr><td>" + "word<br>" * n,
    "many long rows, one of them tall": lambda n: "<table>" + "<tr><td>" + "x<br>" * n + "<td>y" * n,
    "open blocks": lambda n: "<div>" * (4 * n) + "x",
    "a paragraph open outside a button": lambda n: "<p><button>" + "<div>a" * (4 * n),
    "unmatched ends": lambda n: "<div>" * (2 * n) + "</span>" * (2 * n),
    "quotes that close in the next tag": lambda n: '<a href="x> t ' * (4 * n),
    "a quote that never closes": lambda n: '<b "' + "<b >t " * (4 * n),
    "quotes of two kinds": lambda n: "<b '>t " + '<b ">' * (4 * n),
    "tags that never end": lambda n: "<a " * (8 * n),
    "nested quotations": lambda n: "<blockquote>x" * n,
    "nested lists": lambda n: "<ul><li>x" * n,
    "nested tables": lambda n: "<table><tr><td>x" * n,
    "one long line": lambda n: "<b>x</b> " * (8 * n),
}


@pytest.mark.parametrize("kind", HARD)
def test_time_and_output_grow_with_the_page(kind):
    """Four times the page: at most five times the output, and nothing like the square of the time."""
    small, large = HARD[kind](2000), HARD[kind](8000)
    html.render(small)
    seconds = []
    for page in (small, large):
        began = time.process_time()
        text = html.render(page)[0]
        seconds.append((time.process_time() - began, len(text)))
    assert seconds[1][1] <= 5 * seconds[0][1] + 100
    assert len(text) < 60 * len(large)
    assert seconds[1][0] <= 7 * seconds[0][0] + 0.3


def test_no_visible_text_is_lost_at_the_bounds_of_layout():
    words = [f"w{i}" for i in range(3000)]
    for page in (
        "<table>" + "".join(f"<tr><td>{w}" for w in words[:-1]) + f"<td>{'long ' * 500}{words[-1]}",
        "<table><tr>" + "".join(f"<td>{w}" for w in words),
        "<table><tr><td>" + "<br>".join(words[:1500]) + "".join(f"<td>{w}" for w in words[1500:]),
        "".join(f"<table><tr><td>{w}" for w in words),
        "".join(f"<ul><li>{w}" for w in words),
        "".join(f"<blockquote><ol><li>{w}" for w in words),
    ):
        found = re.findall(r"w\d+", html.render(page)[0])
        assert sorted(found) == sorted(words)


# -- an independent layout -------------------------------------------------------------------


def grid(rows):
    """A table of plain cells by hand: columns as wide as their longest cell, two spaces apart."""
    widths = [max(len(row[c]) for row in rows if c < len(row)) for c in range(max(map(len, rows)))]
    return [("  ".join(cell.ljust(widths[c]) for c, cell in enumerate(row))).rstrip() for row in rows]


def outline(items, depth, ordered):
    """A nested list by hand: items are (text, items below)."""
    found = []
    for number, (text, below) in enumerate(items, 1):
        mark = f"{number}. " if ordered[depth % len(ordered)] else "- "
        found.append(mark + text)
        found += [" " * len(mark) + line for line in outline(below, depth + 1, ordered)]
    return found


def markup(items, depth, ordered, closed):
    name = "ol" if ordered[depth % len(ordered)] else "ul"
    inner = "".join(f"<li>{t}{markup(b, depth + 1, ordered, closed) if b else ''}{'</li>' if closed else ''}" for t, b in items)
    return f"<{name}>{inner}</{name}>"


CELL = st.text("abc<>&", min_size=1, max_size=12)
ITEMS = st.recursive(
    st.lists(st.tuples(st.text("xyz", min_size=1, max_size=6), st.just([])), min_size=1, max_size=3),
    lambda below: st.lists(st.tuples(st.text("xyz", min_size=1, max_size=6), below | st.just([])), min_size=1, max_size=3),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(CELL, min_size=1, max_size=5), min_size=1, max_size=6), st.booleans(), st.booleans())
def test_tables_against_a_layout_by_hand(rows, closed, grouped):
    def cell(text):
        return f"<td>{entities.escape(text)}{'</td>' if closed else ''}"

    body = "".join(f"<tr>{''.join(map(cell, row))}{'</tr>' if closed else ''}" for row in rows)
    page = f"<table>{'<tbody>' if grouped else ''}{body}</table>"
    assert html.render(page)[0].split("\n") == grid(rows)


@settings(max_examples=150, deadline=None)
@given(ITEMS, st.lists(st.booleans(), min_size=1, max_size=3), st.booleans())
def test_lists_against_a_layout_by_hand(items, ordered, closed):
    assert html.render(markup(items, 0, ordered, closed))[0].split("\n") == outline(items, 0, ordered)


BITS = (
    "<div> </div> <p> </p> <table> </table> <tr> <td> </td> <ul> <li> </ul> text <a> </a> <b> <h1> </h1> <br> <hr> <pre> </pre> <option> "
    "<select> <dl> <dt> <dd> <button> <head> <body> <caption> <th> <thead> <tfoot> < > \" ' & <q> </q> <details> <summary> <!-- --> <!x <"
).split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40))
def test_any_tags_in_any_order(bits):
    text, blocks, tables = html.render("".join(bits))
    assert text.count("text") <= bits.count("text") and blocks >= 0 and tables >= 0
