import json
import random

from openbound.llm import html_extract as H

PAGES = "page_id long, url string, html string, host string, salt string, wrapper int, text int"


def _page(i, rnd, article=True):
    paras = [f"Paragraph {j} of story {i} tells &quot;{rnd.random()}&quot; &amp; more &lt;b&gt; caf&eacute; &#x41;." for j in range(rnd.randint(1, 9))]
    body = "".join(f"<p><b>{p}</b>\n\t next</p>" if rnd.random() < .5 else f"<p>{p} next" for p in paras)
    mid = f"<h2>Part {i}</h2><ul><li>one<li>two <a href='x'>link</a></ul>" if rnd.random() < .5 else ""
    want = [f"Title {i}", *[p.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").replace("&eacute;", "é")
                            .replace("&#x41;", "A") + " next" for p in paras]] + ([f"Part {i}", "one", "two link"] if mid else [])
    notice = "<div class='cookie-notice'><p>We use cookies</p></div>" if rnd.random() < .5 else ""
    tag = "article" if article else "div id=x1"
    end = tag.split()[0]
    html = (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body>"
            f"{notice}<header><p>Site name</p></header><nav><ul>{'<li><a href=/a>A</a></li>' * rnd.randint(1, 6)}</ul></nav>"
            f"<{tag}><h1>Title {i}</h1>{body}{mid}<aside>see also</aside><form><p>Mail?</p><input></form>"
            f"<div class='ad'>buy {i}</div><section id='comments'><p>I agree {i}</p></section></{end}>"
            f"<div class=sidebar><p>Side {i} <a href=q>q</a></p></div><!-- <p>no</p> --><footer>&copy; {i}</footer></body></html>")
    return html, "\n".join(want)


def test_main_text_of_generated_pages():
    rnd = random.Random(3)
    for article in (True, False):
        pages = [_page(i, rnd, article) for i in range(40)]
        w = None
        for h, _ in pages:
            w = H.add_page(w, H.skeleton(h))
        rules = H.decide(json.loads(json.dumps(w)))
        for h, want in pages:
            assert H.extract(h, rules) == want


def test_alignment_is_union_free():
    a = H.skeleton("<body><p>x<p>y<div class=k>1</div></body>")
    b = H.skeleton("<body><div class=k>1</div><h2>t</h2></body>")
    body = H.merge(a, b)[3][0]
    assert [(i[0], i[1], i[2]) for i in body[3]] == [("p", 0, 0), ("div.k", 1, 1), ("h2", 0, 1)]
    assert body[3][1][3][0][4][3] is not None          # text that never differs stays a template string
    g = H.skeleton("<body>" + "<h2>a</h2><p>b</p>" * 5 + "</body>")[3][0][3]
    assert len(g) == 1 and g[0][0] == H.GROUP and [i[0] for i in g[0][3]] == ["h2", "p"]
    tags = ["h2", "p", "ul", "pre", "table", "dl"]
    rnd = random.Random(1)
    big = H.skeleton("<body>" + "".join(f"<{t}>x</{t}>" for t in rnd.choices(tags, k=300)) + "</body>")
    assert len(json.dumps(big)) < 20_000


def test_parse_odd_markup():
    text = lambda h: H.extract(h)
    assert text("") == "" and text(None) == "" and text("<article>") == ""
    assert text("<article>a < b &amp &am</article") == "a < b & &am"
    assert text("<article><p title='a>b'>x<br>y&nbsp; z</p><p>1</article><p>out") == "x y z\n1"
    assert text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert text("<article><p>q\"r</p><a href=\"x>broken</article>").startswith('q"r')
    long = "word " * 200_000
    assert text(f"<article><p>{long}</p></article>") == long.strip()


def test_query_rows(spark):
    rnd = random.Random(5)
    pages = [(i, f"https://Host{i % 3}.org:80/x/{i}", *_page(i, rnd)) for i in range(60)]
    rows = [(i, u, h) for i, u, h, _ in pages] + [(100, None, None), (101, "::odd", ""), (None, pages[0][1], pages[0][2]), (5, *pages[5][1:3])]
    df = spark.createDataFrame([(i, u, h, "a", "b", 1, 2) for i, u, h in rows], PAGES)
    got = sorted(((str(r["page_id"]), r["url"], r["text"]) for r in H.extract_pages(df).collect()), key=str)
    want = {i: t for i, _, _, t in pages}
    assert got == sorted(((str(i), u, "" if i in (100, 101) else want[0 if i is None else i]) for i, u, _ in rows), key=str)
    assert H.extract_pages(df.limit(0)).count() == 0
    assert H.infer_wrappers(df).count() == 4


def test_partitions_without_rows(spark):
    df = spark.createDataFrame([(1, "http://a", "<article>x</article>", "a", "b", 1, 2)], PAGES).repartition(5)
    assert [r["text"] for r in H.extract_pages(df.filter("page_id > 0")).collect()] == ["x"]


def test_host_of_two_templates(spark):
    rnd = random.Random(8)
    made = [_page(i, rnd, article=i % 3 == 0) for i in range(30)]
    urls = ["https://mixed.org/x", None, "::odd"]          # the last two share the host ''
    df = spark.createDataFrame([(30 * k + i, u, h, "a", "b", 1, 2) for k, u in enumerate(urls) for i, (h, _) in enumerate(made)], PAGES)
    got = {r["page_id"]: r["text"] for r in H.extract_pages(df).collect()}
    assert got == {30 * k + i: want for k in range(3) for i, (_, want) in enumerate(made)}


def test_copies_of_a_page_are_no_template(spark):
    rnd = random.Random(12)
    page, want = _page(0, rnd, article=False)
    same = "<body><div><p>said twice</p><p>said twice</p><p>said twice</p></div></body>"
    single = "<body><nav><a href=a>A</a></nav><div><h1>Only</h1><p>One paragraph of text.</p></div></body>"
    rows = [(0, "https://copies.org/", page, want)] * 5 + [(1, "https://same.org/", same, "\n".join(["said twice"] * 3))]
    rows += [(2, "https://single.org/", single.replace("<nav>", f"<nav><a href=b>{i}</a>"), "Only\nOne paragraph of text.") for i in range(4)]
    df = spark.createDataFrame([(i, u, h, "a", "b", 1, 2) for i, u, h, _ in rows], PAGES).repartition(4)
    got = sorted((r["page_id"], r["text"]) for r in H.extract_pages(df).collect())
    assert got == sorted((i, w) for i, _, _, w in rows)


def test_text_equal_on_different_pages_is_a_template():
    wrapper = None
    pages = [f"<body><div><h1>T{i}</h1><p>Body {i} text</p><h5>Filed under news</h5></div></body>" for i in range(3)]
    for h in pages:
        wrapper = H.add_page(wrapper, H.skeleton(h))
    assert [H.extract(h, H.decide(wrapper)) for h in pages] == [f"T{i}\nBody {i} text" for i in range(3)]


def test_elements_without_end_tag():
    for tag in ("button", "select", "object", "canvas", "audio", "video", "noscript", "svg", "math"):
        assert H.extract(f"<article><p>a</p><{tag} class=x><p>b</p></article>") == "a\nb"
        assert H.extract(f"<article><p>a</p><{tag}>no</{tag}><p>b</p><{tag}><p>c</p></article>") == "a\nb\nc"
    for tag in ("script", "style", "textarea", "iframe"):
        assert H.extract(f"<article><p>a</p><{tag}><p>b</p></article>") == "a"
