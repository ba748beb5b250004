import html
import re

from slipstream.llm.html_pages import read_page
from slipstream.llm.html_text import main_class, main_text


def texts(spark, pages, extra=""):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' main", "'y' texts", "'z' text")
    return {r.page_id: (r.text, r.n_chars) for r in main_text(rows).collect()}


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        want = " ".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def shop_page(k: int, body: str) -> str:
    """A template without article elements: only repetition tells its parts apart."""
    return (
        f"<html><head><title>Shop {k}</title></head><body><div class='x1'><ul><li><a href='/a'>Home</a><li><a href='/b'>Offers</a></ul></div>"
        f"<div class='x2'>We use biscuits on this site.</div><div class='x3'><h1>Item {k}</h1>{body}</div>"
        f"<div class='comments'><p>I like item {k} so very much that I could write about it all day</p></div>"
        "<div class=sidebar>Top ten</div><form><label>Mail</label> <input name=q value='>'></form><div class='x9'>Terms apply.</div></body></html>"
    )


def test_template_of_a_host_without_semantic_tags(spark):
    body = "<p>Some <i>long</i> text about number {0} &amp; its   many\n uses.</p><p>A second one, {0}&nbsp;times<br>over.</p>" * 3
    pages = [(k, f"http://shop.example/{k}?q", shop_page(k, body.format(k * k))) for k in range(12)]
    got = texts(spark, pages)
    for k in range(12):
        part = f"Some long text about number {k * k} & its many uses. A second one, {k * k} times over."
        want = " ".join([f"Item {k}", *[part] * 3])
        assert got[k] == (want, len(want))


def test_repeated_articles_are_kept_and_broken_pages_do_not_crash(spark):
    same = "<body><nav>Menu</nav><article><p>One text on every page.</article><footer>Foot</footer>"
    pages = [(k, "http://copies.example/x", same) for k in range(10)]
    pages += [
        (20, None, None), (21, "no url", ""), (22, "http://a.example/", "plain text & more"), (23, "http://b.example/", "<p>open <b>bold"),
        (24, "http://c.example/", "<article><p>x < y and a > b</p><script>if (a<b) '</p>'</script><!-- <p>no</p> --> tail</article>"),
        (25, "http://d.example/", "<div " * 3000), (26, "http://e.example/", "<div>" * 3000 + "deep"), (27, "http://f.example/", "<script>var x = 1;"),
        (28, "http://g.example/", "<article><header><h1>T</h1></header><p>Body.</p><aside>no</aside><div class='ad'>no</div></article>"),
    ]
    got = texts(spark, pages)
    assert all(got[k][0] == "One text on every page." for k in range(10))
    assert got[20] == ("", 0) and got[21] == ("", 0) and got[22][0] == "plain text & more" and got[23][0] == "open bold"
    assert got[24][0] == "x < y and a > b tail" and got[26][0] == "deep" and got[27][0] == "" and got[28][0] == "T Body."
    assert texts(spark, []) == {}


def test_the_main_class_is_the_deepest_that_holds_most_slot_text():
    def row(node, parent, role, chars):
        return {"node": node, "parent": parent, "role": role, "chars": chars, "vector": 1, "support": 5}

    tree = [row(0, None, "", 100), row(1, 0, "html", 100), row(2, 1, "body", 100), row(3, 2, "div.a", 90), row(4, 2, "div.b", 10), row(5, 3, "p", 90)]
    assert main_class(tree) == 3
    tree += [row(6, 4, "main", 40), row(7, 6, "article", 38)]
    assert main_class(tree) == 7
    assert main_class(tree[:1]) == 0


def test_blocks_follow_the_page():
    page = read_page("<p>a<b>b</b>c<p>d<br>e<ul><li>f<li>g</ul>h")
    assert [b.text for b in page.blocks] == ["abc", "d", "e", "f", "g", "h"]


def test_long_broken_pages_take_linear_time():
    for page in ("<div " * 100_000, "<div>" * 20_000 + "x", "<a href=\"" * 50_000 + ">", "<p>x" * 50_000, "</div>" * 50_000 + "y"):
        assert len(read_page(page).blocks) <= 50_000


def test_a_telling_word_on_the_wrapper_of_the_text_loses_nothing(spark):
    """Many pages, a minority layout and single pages; small boxes of the same names still go."""
    kinds = ["content has-sidebar", "header-fixed", "search-page widget", "content"]
    page = "<body><div class='{0}'>{1}<div class=related>See {2}</div></div><div class='sidebar'>Top {2}</div></body>"
    words = [f"Page {k} has a text of its own that is long enough, {k * k}." for k in range(24)]
    wide = [(k, "http://wide.example/", page.format(kinds[k % 4], f"<article><p>{words[k]}</p></article>", k)) for k in range(12)]
    plain = [(k, "http://plain.example/", page.format(kinds[1 if k == 12 else 3], f"<p>{words[k]}</p>", k)) for k in range(12, 23)]
    single = [(23, "http://single.example/", page.format(kinds[0], f"<p>{words[23]}</p>", 1))]
    got = texts(spark, wide + plain + single)
    assert {k: got[k][0] for k in got} == dict(enumerate(words))
    form = "<body><form><main class='content search'><p>Long text of the page.</p></main></form></body>"
    assert texts(spark, [(1, "http://form.example/", form)])[1][0] == "Long text of the page."


def test_all_slots_of_a_page_are_kept(spark):
    """Several articles with classes of their own, text beside them, and pages with their text in a sibling of main."""
    two = "<body><div class=lead>Lead {0}.</div><article class='part-a'>First part {0}.</article><article class='part-b'>Second {0}.</article><div class=end>End {0}.</div></body>"
    main = "<body><main><h1>Title {0}</h1><p>A long text of page {0} in main.</p></main></body>"
    apart = "<body><main><h1>Title {0}</h1></main><div class=body><p>A long text of page {0} beside main.</p></div></body>"
    pages = [(k, "http://two.example/", two.format(k)) for k in range(10)]
    pages += [(k, "http://main.example/", (apart if k > 27 else main).format(k)) for k in range(10, 30)]
    got = texts(spark, pages)
    for k in range(30):
        want = f"Lead {k}. First part {k}. Second {k}. End {k}." if k < 10 else f"Title {k} A long text of page {k} {'beside' if k > 27 else 'in'} main."
        assert got[k][0] == want


def test_template_text_of_a_host_with_empty_and_odd_pages(spark):
    """No telling names: classes of parts of the pages are template as well, and in an article too."""
    menu = "<div class='x1'><ul><li>Home<li>Offers</ul></div>"
    page = "<body>{menu}<article class=z><h1>Item {k}</h1><p>Text {k} of its own.</p><div class=x4>Call us now.</div></article><div class=x5>Terms apply.</div></body>"
    pages = [(k, "http://odd.example/", page.format(k=k, menu=menu if k % 5 else "")) for k in range(40)]
    pages += [(k, "http://odd.example/", "" if k % 2 else None) for k in range(40, 80)] + [(80, "http://odd.example/", "<div class=q>Broken")]
    pages += [(k, "http://part.example/", f"<body><div class=p>Text {k}</div>{'<div class=x7>Old site.</div>' if k < 10 else ''}</body>") for k in range(100, 140)]
    pages += [(k, "http://part.example/", f"<body><div class=p>Text {k}</div><div class=x7>Old site.</div></body>") for k in range(140, 149)]
    got = texts(spark, pages)
    assert all(got[k][0] == f"Item {k} Text {k} of its own." for k in range(40)) and got[80][0] == "Broken"
    assert all(got[k][0] == "" for k in range(40, 80)) and all(got[k][0] == f"Text {k}" for k in range(100, 149))


def test_words_and_repetition_take_nothing_from_an_article(spark):
    page = (
        "<body><nav>Menu</nav><article><h1>Item {0}</h1><h2>Summary</h2><p>Text {0} of its own.</p><div class='related-work'><p>On login forms {0}.</p></div>"
        "<section id='comments-on-theory'><p>Theory {0} here.</p></section><p>One closing line.</p><div class='ad-slot-2'>Buy {0}</div>"
        "<div class='comment-list'><p>Nice one, {0}!</p></div></article><footer>Foot</footer></body>"
    )
    pages = [(k, "http://many.example/" if k < 12 else "http://one.example/", page.format(k)) for k in range(13)]
    got = texts(spark, pages)
    for k in range(13):
        assert got[k][0] == f"Item {k} Summary Text {k} of its own. On login forms {k}. Theory {k} here. One closing line."
