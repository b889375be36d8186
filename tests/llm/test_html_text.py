import random

import pytest
from plumeworks.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ('<div class="comments"><p>x</p></div><article><header><h1>T</h1></header>a&nbsp;&lt;b&gt;<br>c<form>f</form><aside>z</aside></article>', "T\na <b> c"),
        ("<body><header>h</header><main><p>one <b>two</b></p></main><footer>f", "one two"),
        ("<nav>n<ul><li>m</ul></nav><p>x</p><!-- c --><style>p{}</style><script>t('</p>')</script>", "x"),
        ("<article><p><b>open<br><p>more</article><footer>no", "open\nmore"),
        ('<div class="cookie-notice">no</div><div id="sidebar">no</div><div>yes</div>', "yes"),
        ("<article><p>" + "\u0130" * 50 + "</p><SCRIPT>no</Script><p>abc def ghi</p></article>", "\u0130" * 50 + "\nabc def ghi"),
        ("<article>x<p>" + "y " * 50000 + "</p></article>", "x\n" + " ".join("y" * 50000)),
    ],
)
def test_one_page(page, text):
    assert html_text.main_text(page) == text


def test_template_text_goes_where_a_page_has_no_article(spark):
    rows = [(i, f"https://a.org/{i}", f"<div>Welcome to A</div><div><p>own {i}</p><p>more {i * 7}</p></div><div>Bye</div>") for i in range(9)]
    rows += [(20, "https://b.org/1", "<div>Welcome to A</div><p>only page</p>"), (21, None, None), (22, "x", "")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("own 3\nmore 21", 13)
    assert got[20][0] == "Welcome to A\nonly page" and got[21] == ("", 0) and got[22] == ("", 0)


def test_classes_must_keep_their_order():
    seen = {1: [1, 0], 2: [1, 5], 3: [1, 2], 4: [1, 7]}
    assert html_text.valid_tokens(seen, [[1, 2], [3], [4]]) == {1, 2, 3, 4}
    assert html_text.valid_tokens(seen, [[2, 1], [3]]) == {3}
    assert html_text.valid_tokens(seen, [[1, 2], [3, 4]]) == {1, 2}


def test_copies_of_an_article_stay(spark):
    rows = [(i, "https://a.org/x", "<nav>n</nav><article>same</article>") for i in range(9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 9 and {r["text"] for r in got} == {"same"}


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_template_without_hints_or_article(spark):
    """Hosts whose markup has neither an article nor a telling name: links, a short notice, the text, and a line that all pages share."""
    rng, rows, want = random.Random(4), [], {}
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    for i in range(24):
        top, paragraphs = some(4), [some(rng.randint(15, 40)) for _ in range(rng.randint(1, 5))]
        links = "".join(f'<div><a href="/{k}">{some(1)}</a></div>' for k in range(6))
        own = "".join(f"<p>{x}</p>" for x in paragraphs)
        rows.append((i, f"https://x{i % 2}.org/{i}", f'<body><div class="q1">{links}</div><div class="q2">{some(5)}</div><div class="q3"><h2>{top}</h2>{own}<p>Printed on paper</p></div><div class="q4">{some(6)}</div></body>'))
        want[i] = "\n".join([top, *paragraphs])
    got = html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def plain_classes(pages):
    """Tokens by their occurrence vectors, by hand."""
    counts = [html_text.counted_tokens(*html_text.parsed(p)) for p in pages]
    vectors = {}
    for token in set().union(*counts):
        vectors.setdefault(tuple(c.get(token, [0])[0] for c in counts), []).append(token)
    n = lambda v: sum(x > 0 for x in v)
    most = max(map(n, vectors))
    return {frozenset(c) for v, c in vectors.items() if n(v) >= max(html_text.LEAST_PAGES, html_text.SUPPORT * most)}


def test_classes_are_those_of_the_occurrence_vectors(spark):
    rng = random.Random(7)
    pages = {h: sorted({"".join(rng.choice(("<div>a</div>", "<p>b</p>", "<ul><li>c</ul>", "<section><h1>d</h1></section>", f"<p>{rng.randint(0, 3)}</p>")) for _ in range(rng.randint(1, 6))) for _ in range(12)}) for h in ("one", "two")}
    rows = [(h, p) for h, some in pages.items() for p in some + some[:3]]
    got = {r["host"]: {frozenset(c) for c in r["template"]} for r in html_text.templates(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()}
    assert got == {h: plain_classes(some) for h, some in pages.items()}


def test_deep_nesting_is_parsed_in_linear_time():
    import time

    page = "<html><body>" + "".join(f"<div>word{i} " for i in range(4000))
    began = time.time()
    text = html_text.main_text(page)
    assert time.time() - began < 2 and text.split("\n")[-1] == "word3999"
