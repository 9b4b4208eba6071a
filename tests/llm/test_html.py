"""Main text of pages."""

from pyspark.sql import functions as F

from llm_tables import write
from tillpoint.llm import html_extraction as hx

SCHEMA = "page_id long, url string, html string, host string, slot string, token string"


def page(body: str, site: str = "", tail: str = "</body></html>") -> str:
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t='</p><p>no';</script></head>"
            f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy</div>{site}{body}"
            f"<footer>&copy; all</footer>{tail}")


def texts(spark, folder, pages):
    sf = write(spark, folder, "pages", [(i, u, h, "x", "y", "z") for i, u, h in pages], SCHEMA)
    rows = hx.op4_html(spark, sf).collect()
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(pages)
    return {r.page_id: r.text for r in rows}


def test_parts_that_are_not_the_article(spark, tmp_path):
    body = ("<article><h1>Title &amp; more</h1><p>One  two\n three&nbsp;four &lt;b&gt; caf&eacute;<p><b>Un<i>closed</i>"
            "<aside>side</aside><div class='newsletter-form'>join</div><form><p>name<input></form>"
            "<p hidden>gone</p><!-- <p>comment</p> --><ul><li>a<li>b</ul>"
            "<section id='comments'><p>first!</p></section><p>Same</p><p>Same</p></article>"
            "<aside><p>related</p></aside><div role='alert'>cookies</div>")
    got = texts(spark, tmp_path, [(k, "http://a.example/x", page(body)) for k in range(4)])
    assert set(got.values()) == {"Title & more\nOne two three four <b> café\nUnclosed\na\nb\nSame\nSame"}


def test_slot_without_a_named_element(spark, tmp_path):
    """The template finds the main slot of hosts that use plain divs."""
    def body(k):
        return (f"<div class='wrap'><div class='links'><a>{k}</a></div><div class='content-{k}'><p>{'word ' * 40}{k}</p>"
                f"<p>{'more ' * 30}{k}</p></div><div class='box'>short</div></div>")
    got = texts(spark, tmp_path, [(k, "https://b.example/", page(body(k))) for k in range(6)])
    assert got[3] == " ".join(["word"] * 40) + " 3\n" + " ".join(["more"] * 30) + " 3"


def test_odd_pages(spark, tmp_path):
    art = "<article><p>Text</p></article>"
    pages = [(None, None, None), (1, None, ""), (2, "not a url", "   "), (3, "http://c.example", "plain & <b>text"),
             (4, "http://c.example", page("<article><p>cut &am", tail="")[:-len("<footer>&copy; all</footer>")]),
             (5, "http://c.example", page(art)), (5, "http://c.example", page(art)), (6, "http://c.example", "a < b > c <3"),
             (7, "http://d.example", page("<article>" + "<p>long text</p>" * 30_000 + "</article>")),
             (8, "http://c.example", "<p>open <a href='x"), (9, "http://e.example", "<nav>only</nav>")]
    got = texts(spark, tmp_path, pages)
    assert got[None] == got[1] == got[2] == got[9] == ""
    assert got[3] == "plain & text" and got[4] == "cut &am" and got[5] == "Text" and got[6] == "a < b > c <3"
    assert got[7].count("\n") == 29_999 and got[8] == "open"


def test_empty_table(spark, tmp_path):
    assert texts(spark, tmp_path, []) == {}


def test_classes_group_tokens_with_equal_vectors(spark):
    pages = spark.createDataFrame([(k, "u", page("<article><p>a b c d e f</p>" + "<p>x</p>" * k + "</article>")) for k in range(1, 5)],
                                  "page_id long, url string, html string").withColumn("host", F.lit("h"))
    sums = {r.token: r for r in hx.token_sums(pages).collect()}
    body, article, p = (sums[t] for t in ("/html/body", "/html/body/article", "/html/body/article/p"))
    assert (body.one, body.two, body.pages, body.times) == (article.one, article.two, 4, 4)
    assert p.times == 14 and (p.one, p.two) != (body.one, body.two)
    assert hx.main_slots(hx.token_sums(pages)).first().slot == "/html/body/article"


def test_many_hosts_are_joined_by_salted_keys(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"h{k % 3}") for k in range(60)], "page_id long, url string, host string")
    slots = spark.createDataFrame([("h0", "/a"), ("h1", "/b")], "host string, slot string")
    few, many = (sorted(hx.with_hosts(pages, slots, most, 4).select("page_id", "slot").collect()) for most in (5000, 1))
    assert few == many and len(few) == 60


def varying(k, name, n=20):
    return " ".join(f"{name}{k}x{j}" for j in range(n))


def test_every_slot_of_a_host_without_named_elements(spark, tmp_path):
    """A lead of a quarter of the text, a body, a caption; texts of the template
    and menus go, whatever the elements are called."""
    def body(k):
        return (f"<div class=wrap><div class=brand>The Daily</div><div class=lead>{varying(k, 'lead', 10)}</div>"
                f"<div class=body><p>{varying(k, 'p', 30)}<p>Read on<p>{varying(k, 'q')}</div>"
                f"<ul class=more><li><a>{varying(k, 'l', 3)}</a> | <li><a>b</a></ul><table><tr><td>{varying(k, 't', 4)}</table>"
                f"<div class='post-comments'>{varying(k, 'c', 300)}</div></div>")
    got = texts(spark, tmp_path, [(k, "https://d.example/", page(body(k))) for k in range(20)])
    for k, text in got.items():
        assert text.split("\n") == [varying(k, "lead", 10), varying(k, "p", 30), varying(k, "q"), varying(k, "t", 4)]


def test_copies_do_not_become_template(spark, tmp_path):
    one = page(f"<div><p>{varying(0, 'a')}</p><p>{varying(0, 'b')}</p></div>")
    pages = [(k, "https://e.example/", one) for k in range(6)] + [
        (10 + k, "https://e.example/", page(f"<div><p>{varying(k, 'y')}</p><p>{varying(k, 'z')}</p></div>")) for k in range(1, 4)]
    got = texts(spark, tmp_path, pages)
    assert all(got[k] == f"{varying(0, 'a')}\n{varying(0, 'b')}" for k in range(6))


def test_names_of_another_meaning_stay_in_the_article(spark, tmp_path):
    body = lambda k: (f"<article class='social-history'><div class='post-header'><h1>T{k}</h1></div>"  # noqa: E731
                      f"<p>{varying(k, 'p')}<br>and on</p><div class='share-price-related'>{varying(k, 's', 14)}</div>"
                      f"<div id='ad-1' class='box'>buy</div><div class='share-buttons'>tweet</div></article>")
    got = texts(spark, tmp_path, [(k, "https://f.example/", page(body(k))) for k in range(4)])
    assert all(got[k] == f"T{k}\n{varying(k, 'p')} and on\n{varying(k, 's', 14)}" for k in got)


def test_template_of_random_hosts_against_brute_force(spark):
    """Texts that stand once on at least half of a host's pages, and with them
    another token of the same vector, are its template."""
    import random
    rnd = random.Random(3)
    rows, want = [], {}
    for h in range(8):
        fixed = [(f"s{j}", " ".join(rnd.choice("abcdef") * 3 for _ in range(4)) + f" {j}", rnd.random()) for j in range(6)]
        shown = [[f for f in fixed if rnd.random() < f[2]] for _ in range(rnd.randint(3, 12))]
        for k, some in enumerate(shown):
            rows.append((100 * h + k, "u", "<body>" + "".join(f"<div class={c}>{t}</div>" for c, t, _ in some)
                         + f"<p>{varying(100 * h + k, 'v')}</p></body>", f"h{h}"))
        often = {f: sum(f in some for some in shown) for f in fixed}
        vectors = {(f"/body/div.{hx._DIGITS.sub('0', c)}", t): tuple((c, t, x) in some for some in shown) for c, t, x in fixed}
        vectors |= {("/body", None): (1,) * len(shown), ("/body/div.s0", None): tuple(map(len, shown))}
        want[f"h{h}"] = {hx._text_hash(*key) for key, v in vectors.items() if key[1] and 2 * sum(v) >= len(shown)
                         and sum(w == v for w in vectors.values()) > 1}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.host: r for r in hx.main_slots(hx.token_sums(pages)).collect()}
    for h, texts_of in want.items():
        assert set(got[h].constant) == texts_of and got[h].slot == "/body"
    assert any(want.values())


def test_given_pages(spark):
    import re
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in hx.op4_html(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:  # their articles hold only headings, paragraphs, bold text and breaks
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>|<br>|<[^>]*\Z", "", inner))
        want = [" ".join(b.split()) for b in map(hx.html.unescape, blocks)]
        assert got[r.page_id] == "\n".join(b for b in want if b), r.page_id
