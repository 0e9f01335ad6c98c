"""Pages written by hand, with the text that has to come out, and broken markup."""

import time

import pytest

from specweave.llm import html_text

P1 = "The council met on Tuesday evening, and after three hours it agreed on a new plan for the old harbour."
P2 = "Work starts in spring. Nobody expects it to end before next winter, but the money is there &amp; approved."
PAGES = [
    (f'<html><head><title>Harbour | Daily</title><style>p{{color:red}}</style></head><body><header class="site-header"><p>The Daily</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/s">Sport</a></li></ul></nav><article><h1>A plan for the harbour</h1><p>{P1}</p><p>{P2}</p></article><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Cats</a></li></ul></aside><footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>', ["A plan for the harbour", P1, P2.replace("&amp;", "&")]),
    (f'<body><div id=cookie-notice class="cookie banner"><p>We use cookies on this site.</p><button>Accept</button></div><div class="menu navbar"><a href=x>Home</a><a href=y>About</a></div><div class="post-content"><h2>Harbour</h2><p>{P1}<p>{P2}</div><div class="comments"><h3>Comments</h3><div class="comment"><p>Great article, thanks a lot!</p></div></div><div class="footer">Privacy policy</div></body>', ["Harbour", P1, P2.replace("&amp;", "&")]),
    (f'<body><nav><a href=/>Home</a></nav><main><p>{P1}</p><div class="ad advert"><p>Buy now, free shipping!</p></div><p>{P2}</p></main><form class="newsletter"><label>Email address</label><input><button>Subscribe</button></form><footer>Imprint</footer></body>', [P1, P2.replace("&amp;", "&")]),
]


@pytest.fixture(scope="module")
def model():
    return html_text.train()


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_pages_by_hand(model, number):
    page, want = PAGES[number]
    found = html_text.blocks(page)
    kept = model.keep([found], {})[0]
    assert [b[1] for b, k in zip(found, kept) if k] == want


@pytest.mark.parametrize("page, want", [
    ("<a title=don't>Hello</a> it's fine", ["Hello it's fine"]),
    ("<select><option>a<p>main", ["a", "main"]),
    ("<select><option>a</option></select><p>main", ["main"]),
    ("<script src=/a/>var x=1;</script>after", ["after"]),
    ("<svg><svg></svg>in</svg>out", ["out"]),
    ("<svg><path><p>after an open image</p></svg>", ["after an open image"]),
    ("<p>one<object>fall back</object>two", ["one", "two"]),
    ("<object>never closed<p>yes", ["never closed", "yes"]),
    ("<!-->x<!--->y<!-- no -->z", ["xyz"]),
    ("a < b and <b>c</b>", ["a < b and c"]),
    ("<p title='a>b'>q</p>r", ["q", "r"]),
    ("<div/>still inside</div>", ["still inside"]),
    ("x<br>y</br>z &lt;b&gt; &nbsp; &amp;c", ["x y z <b> &c"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<p>cut off <a href='", ["cut off"]),
    ("", []),
])
def test_markup(page, want):
    assert [b[1] for b in html_text.blocks(page)] == want


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 300_000, "<b>" * 200_000 + "</i>" * 200_000, "<a x=\"<a y='" * 100_000, "<!--x--!>" * 100_000, "<textarea>" * 100_000, "<select>" * 50_000 + "</select>" + "<p>a" * 50_000, "<ul><li>" * 100_000 + "<li>" * 50_000, "<" * 500_000, "<object></object>" * 50_000])
def test_time_grows_with_the_page(page):
    began = time.time()
    html_text.blocks(page)
    assert time.time() - began < 10


def test_empty_repeated_clashing_and_long_pages(spark, model):
    schema = "page_id long, url string, html string, text int, n_chars string"
    assert html_text.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + f"<p>{P1}</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGES[0][0], 5, "x"), (1, "u", PAGES[0][0], 6, "y"), (2, None, long, None, None)]
    out = html_text.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert [x.text for x in out[:2]] == ["\n\n".join(PAGES[0][1])] * 2
    assert out[2].n_chars == len(out[2].text) >= 2900 * len(P1)
