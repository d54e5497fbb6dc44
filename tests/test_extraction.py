"""Elements and links on hand-made pages."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkscore.operators import elements as reader
from linkscore.operators.elements import elements
from linkscore.operators.links import extract_links, first_item, malformed_links, page_metadata
from linkscore.operators.links import link_items, with_keywords


def rows(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def links_of(pages, *columns, containers=("",)):
    return rows(extract_links(pages, containers).orderBy("page_id", "container", "link_pos"), *columns)


def tags(pages):
    found = elements(pages, containers=()).orderBy("page_id", "pos")
    return rows(found, "tag", "text", "text_stripped")


@pytest.mark.parametrize(
    ("html", "found"),
    [
        # an end tag closes down to the nearest open element of its name
        ("<p>a<b>b<p>c</p>d</b>e</p>f", [("p", "abcde", "abcde"), ("p", "c", "c")]),
        # an end tag without a start is ignored, and nothing closes implicitly
        ("</p><li>a<li>b</ul>c", [("li", "abc", "abc"), ("li", "bc", "bc")]),
        # void elements have no content, with or without a slash or an end tag
        ("<p>a<br>b<br/>c<br></br>d<hr>e</p>", [("p", "abcde", "abcde")]),
        # script, style, template and comments are not text; CDATA is
        ("<p>a<script>b</script><style>c</style><!-- d --><template>e<i>f</i></template>g</p>",
         [("p", "ag", "ag")]),
        # entities, with and without semicolon; unknown ones stay
        ("<p>&amp; &lt &#65;&#x42; &nosuch; &eacute;&#150;</p>",
         [("p", "& < AB &nosuch \xe9–", "& < AB &nosuch \xe9–")]),
        # blanks between tags collapse, except in preformatted text
        ("<p><b>a</b>   <i>b</i> \n <i>c</i></p>", [("p", "a b\nc", "abc")]),
        ("<p><pre>  \n </pre>x</p>", [("p", "  \n x", "x")]),
        ("<TITLE>T</TITLE><H1> a </H1>", [("title", "T", "T"), ("h1", " a ", "a")]),
        ("<p>open at the end", [("p", "open at the end")]),
        ("<p>&#xD800;&#99999999;</p>", [("p", "\ufffd\ufffd")]),
        ("", []),
        (None, []),
        ("just text", []),
        # markup the parser gives up on
        ("<p>a</p><![nonsense[x]]>", []),
    ],
)
def test_reading_markup(make_pages, html, found):
    if found and len(found[0]) == 2:
        found = [(t, text, text) for t, text in found]
    assert tags(make_pages(html)) == found


def test_positions_nest(make_pages):
    page = make_pages("<body><p>a<a href='/x'>l</a></p><li>b</li></body>")
    spans = {r.tag: (r.pos, r.end_pos) for r in elements(page).collect()}
    assert spans["body"][0] < spans["p"][0] < spans["a"][0] < spans["a"][1]
    assert spans["a"][0] < spans["p"][1] <= spans["li"][0] < spans["body"][1]


def test_links_only_mode_gives_the_same_links(make_pages):
    html = "<body><p>1<p>2<a href='/a'>a</a><li>3<h1>4</h1><p>5<a href='/b'>b</a></body>"
    lean = elements(make_pages(html), for_links=True)
    assert {r.text for r in lean.collect() if r.tag == "h1"} == set()
    assert links_of(make_pages(html), "context.previous_text", "context.next_text") == [
        ("2a345b", "345b"), ("5b", None)
    ]


def test_only_links_with_a_target_count(make_pages):
    page = make_pages('<a name="x">1</a><a href="">2</a><a href>3</a><a href="/y">4</a>')
    assert links_of(page, "href", "text", "link_pos") == [("/y", "4", 1)]


def test_container_scope(make_pages):
    html = "<div><a href='/1'>1</a><div><a href='/2'>2</a></div></div><a href='/3'>3</a>"
    page = make_pages(html)
    assert links_of(page, "href", containers=("body",)) == []
    assert links_of(page, "href", containers=("",)) == ["/1", "/2", "/3"]
    # a link inside two matching containers is listed for each, outer container first
    assert links_of(page, "link_pos", "href", containers=("div",)) == [
        (1, "/1"), (2, "/2"), (3, "/2")
    ]
    assert links_of(page, "container", "href", containers=("div", ""))[0] == ("", "/1")
    assert links_of(page, "href", containers=("div.menu",)) == []


def test_first_mention_spans_containers(make_pages):
    html = "<div><a href='http://a.com/1'>x</a><div><a href='http://a.com/2'>y</a></div></div>"
    texts = links_of(make_pages(html), "processed_text", containers=("div",))
    assert texts == ["x a 1", "y 2", "y 2"]


@pytest.mark.parametrize(
    ("rel", "kept"),
    [("NoFollow", None), ("noopener", None), ("noopener \n noreferrer", "noopener noreferrer"),
     ("nofollow noopener", "nofollow noopener"), ("", None), (" Me ", "Me")],
)
def test_rel(make_pages, rel, kept):
    assert links_of(make_pages(f'<a href="/x" rel="{rel}">x</a>'), "rel") == [kept]


def test_context_picks_the_nearest_block_and_then_cleans_it(make_pages):
    page = make_pages('<p>A</p><a href="/l">l</a><p>Read more</p><p>B</p>')
    assert links_of(page, "context.previous_text", "context.next_text") == [("A", None)]
    page = make_pages("<li>x <a href='/l'>l<p>inside</p></a></li>")
    assert links_of(page, "context.previous_text", "context.next_text") == [("x linside", "inside")]


def test_heading_hierarchy_is_innermost_first(make_pages):
    page = make_pages('<h2>Top <a href="/l">l</a></h2>')
    assert links_of(page, "context.heading_hierarchy") == [["Topl"]]
    page = make_pages("<h1> A <h3>B <a href='/l'>l</a></h3></h1><a href='/m'>m</a>")
    assert links_of(page, "context.heading_hierarchy") == [["Bl", "ABl"], None]


@pytest.mark.parametrize(
    ("content", "kept"),
    [("x" * 10, None), ("x" * 11, "x" * 11), ("x" * 300, "x" * 300), ("x" * 301, "x" * 300 + "..."),
     ("  " + "x" * 11 + " ", "x" * 11), ("", None)],
)
def test_description_length(make_pages, content, kept):
    html = f'<meta name="description" content="{content}"><title> T </title><a href="/x">x</a>'
    assert rows(page_metadata(make_pages(html)), "title", "description") == [("T", kept)]
    assert links_of(make_pages(html), "metadata.title", "metadata.description") == [("T", kept)]


def test_first_title_and_description_count(make_pages):
    html = (
        "<a href='/x'>x</a><title>one</title><meta name=Description content='not this one, case'>"
        "<meta name=description><meta name=description content='long enough but second'>"
        "<title>two</title>"
    )
    assert rows(page_metadata(make_pages(html)), "title", "description") == [("one", None)]
    assert links_of(make_pages(html), "metadata.title", "metadata.description") == [("one", None)]


def test_metadata_of_a_page_without_elements(make_pages):
    assert rows(page_metadata(make_pages("text", None)), "title") == [None, None]


def test_text_assembly_keeps_first_occurrences_in_order(make_pages):
    page = make_pages(
        "<title>b</title><a href='http://www.a.com/b/c-home' title='b' aria-label='a'>b</a><p>c</p>"
    )
    assert links_of(page, "processed_text") == ["b a c"]


def test_malformed_links_go_to_the_errors(make_pages):
    page = make_pages("<a href='http://[x/'>1</a><a href='/ok'>2</a>", url="http://s")
    assert links_of(page, "href", "link_pos") == [("/ok", 1)]
    found = malformed_links(elements(page, ("",)))
    assert rows(found, "error", "url") == [("invalid_link", "http://s")]


def test_items_per_keyword_and_the_oldest(make_pages):
    page = make_pages("<a href='/1'>1</a><a href='/2'>2</a>", "<a href='/3'>3</a>")
    items = link_items(with_keywords(extract_links(page, ("",)), ["k", "l"]))
    assert items.count() == 6
    assert rows(first_item(items).orderBy("keyword"), "keyword", "href") == [
        ("k", "/1"), ("l", "/1")
    ]


def test_large_page_ids_keep_their_order(spark):
    ids = [2**62, 2**62 + 1, 5]
    pages = spark.createDataFrame(
        [(i, f"http://{i}/", "<a href='/x'>x</a><a href='/y'>y</a>") for i in ids],
        "page_id bigint, url string, html string",
    )
    in_order = extract_links(pages, ("",)).orderBy("seq").select("page_id", "link_pos").collect()
    assert [tuple(r) for r in in_order] == [(i, n) for i in sorted(ids) for n in (1, 2)]


def test_markup_is_read_once_and_never_shuffled(make_pages):
    plan = extract_links(make_pages("<a href='/x'>x</a>"))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    exchanges = [line for line in text.split("\n") if "Exchange " in line]
    assert len(exchanges) == 1


def test_deeply_nested_page(make_pages):
    depth = 3000
    html = "<div>" * depth + "<a href='/x'>x</a>"
    assert links_of(make_pages(html), "href") == ["/x"]
    assert extract_links(make_pages(html), ("div",)).agg(F.count("*")).first()[0] == depth


def test_text_in_proportion_to_the_page(make_pages):
    """Thousands of links in a heading, a paragraph and items that never end."""
    n = 4_000
    html = "<h1>Menu<p>" + "".join(f"<li><a href='/{i}'>link {i}" for i in range(n))
    page = make_pages(html)
    sizes = elements(page, ("",), for_links=True).select(
        F.sum(F.octet_length("page_text") + F.octet_length("page_stripped")), F.count("*")
    ).first()
    assert sizes[0] < 3 * len(html) and sizes[1] < 3 * n
    links = extract_links(page, ("",)).select(
        "link_pos", F.length("text").alias("n"), F.length("context.previous_text").alias("before"),
        F.length(F.col("context.heading_hierarchy")[0]).alias("heading"),
    ).collect()
    text = ["Menu", *(f"link {i}" for i in range(n))]
    total = sum(map(len, text))
    assert len(links) == n and {r["heading"] for r in links} == {total}
    left = total - len(text[0])
    for r, own in zip(sorted(links), text[1:]):
        assert (r["n"], r["before"]) == (left, left)
        left -= len(own)


def test_one_order_over_containers(make_pages):
    html = "<body><a href='/0'>0</a><div><a href='/1'>1</a><div><a href='/2'>2</a></div></div><a href='/3'>3</a></body>"
    found = rows(
        extract_links(make_pages(html, html), ("", "body", "div")).orderBy("seq"),
        "page_id", "seq", "container", "link_pos", "href",
    )
    assert len({r[1] for r in found}) == len(found) == 2 * (4 + 4 + 3)
    one = [(c, n, h) for page, _, c, n, h in found if page == 1]
    assert one == [
        *(("", i + 1, f"/{i}") for i in range(4)), *(("body", i + 1, f"/{i}") for i in range(4)),
        ("div", 1, "/1"), ("div", 2, "/2"), ("div", 3, "/2"),
    ]


@pytest.mark.parametrize("for_links", [False, True])
def test_elements_are_handed_back_slice_by_slice(monkeypatch, for_links):
    """A batch's elements are many times its size: they are never all there at once."""
    monkeypatch.setattr(reader, "SLICE_BYTES", 400)
    long = "<body><p>x</p>" + '<a href="/y">y</a>' * 40 + "</body>"
    pages = [f'<body><li><a href="/{i}">é {i}</a></li></body>' for i in range(60)] + [None, "", long, "", "<a"]
    read = reader._elements_udf(("body",), for_links).func
    parts = list(read(iter([pa.array(pages), pa.array([], pa.string()), pa.array(pages[:2])])))
    assert max(len(p) for p in parts) <= 12
    one = [p for page in [*pages, *pages[:2]] for p in read(iter([pa.array([page], pa.string())]))]
    assert pa.concat_arrays(parts).to_pylist() == pa.concat_arrays(one).to_pylist()
