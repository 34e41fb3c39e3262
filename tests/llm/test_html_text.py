import time

from marketlens.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header>Site <b>name</b></header>
<div id="menu"><a href=x>Home</a></div><div class="cookie-notice"><p>We use cookies</p></div><!-- <p>no</p> -->
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>One  two<br>three<p>x &lt; y < z &nbsp; caf&eacute;<aside>Side</aside><ul><li>a<li>b</ul><div class="ad">buy</div>
<form><input>Name</form><blockquote>q</blockquote></article><section class="comments"><article class=comment><p>First!</p></article></section></main><footer>&copy; f</footer></body></html>"""


def test_article_without_furniture():
    assert H.main_text(PAGE) == "Title & more\nOne two three\nx < y < z café\na\nb\nq"


def test_cut_and_unclosed_markup():
    assert H.main_text("<article><p>a &am") == "a &am"
    assert H.main_text("<article><p>a &amp<p class='x") == "a &"
    assert H.main_text("<article><p>a<!-- cut") == "a"
    assert H.main_text("<div class=ad>x<article><p>kept</article>") == "kept"
    assert H.main_text("<article><b>x<i>y</article><footer>z") == "xy"
    assert H.main_text("<article></div></p>x</article>") == "x"
    assert H.main_text(None) == H.main_text("") == H.main_text("<") == H.main_text("<nav>x</nav>") == ""


def test_pages_without_a_marked_article():
    body = "<div><a href=a>Home</a></div><div><a href=b>News and more</a></div><h1>Short title</h1><p>" + "A long paragraph. " * 12 + "</p><p>short.</p><p>" + "Another one. " * 15
    text = H.main_text("<body>" + body + "</p><div><a>Link one</a> <a>Link two</a></div><p>&copy; 2020</p></body>").split("\n")
    assert text[0] == "Short title" and text[2] == "short." and len(text) == 4
    assert H.main_text("plain &amp; simple") == "plain & simple"


def test_surge_and_dive():
    assert H.window_sums([1, 2, 3, 4], 3) == [6, 9, 7, 4]
    assert H.surge_and_dive([0, 0, 5, 90, 0, 80, 0, 0, 3], 0.25) == (2, 6)
    assert H.surge_and_dive([0, 4, 0, 9, 0], 0.0) == (1, 4)
    assert H.surge_and_dive([], 0.25) == H.surge_and_dive([0, 0], 0.25) == (0, 0)


def test_long_page_is_read_whole():
    many = "".join(f"<p>paragraph {i}</p>" for i in range(20_000))
    assert H.main_text(f"<article>{many}</article>").count("\n") == 19_999


def test_operator(spark, folder):
    pages = spark.createDataFrame([(1, "u", PAGE, "mine", 2), (1, "u", PAGE, "mine", 2), (None, None, None, None, None)], "page_id int, url string, html string, text string, n_chars int")
    rows = H.extract(pages).collect()
    assert sorted(r.text for r in rows) == sorted([H.main_text(PAGE)] * 2 + [""]) and {r.n_chars for r in rows} == {2, None}
    assert H.extract(pages.limit(0)).count() == 0
    html = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in H.query(spark, folder).collect():
        assert r.text == H.main_text(html[r.page_id]) and r.n_chars == len(r.text)


def test_marks_weigh_lines_and_drop_none_between():
    assert H.main_text("<main><p>Body</p></main><section><article>teaser</article></section>") == "Body\nteaser"
    assert H.main_text("<main><p>Lead one.</p><p>Lead two.</p><article><p>text</p></article></main>") == "Lead one.\nLead two.\ntext"
    body = "<p>" + "A long unmarked paragraph. " * 20 + "</p>"
    assert H.main_text(f"{body}<article><p>One.</p></article><p>between</p><article><p>Two.</p></article>").split("\n")[1:] == ["One.", "between", "Two."]
    assert H.main_text("<p>stray</p><article>" + body * 3 + "</article><p>stray</p>").count("\n") == 2
    assert H.main_text("<div class=ad><article><p>buy</p></article></div><p>The body of the page") == "The body of the page"
    assert H.main_text("<div><div class=ad>x<article><p>kept</article></div>") == "kept"


def test_one_long_block_and_closing_lists_lose_nothing():
    sizes = [300, 300, 300, 300, 20_000, 300, 300, 300, 300]
    text = H.main_text("".join(f"<p>{'x' * n}.</p>" for n in sizes))
    assert [len(t) - 1 for t in text.split("\n")] == sizes
    recipe = "<p>" + "Mix it all and bake it. " * 20 + "</p><p>" + "Serve it warm. " * 20 + "</p><ul>" + "".join(f"<li>item {i}</li>" for i in range(20)) + "</ul>"
    assert H.main_text(recipe).count("\n") == 21
    assert H.main_text(recipe + "<div><a>Link one</a> <a>Link two</a></div><p>&copy; 2020</p>") == H.main_text(recipe)


def test_end_tags_without_an_open_element_are_passed_over_in_linear_time():
    page = "<article>" + "<div>" * 40_000 + "<p>The text stays where it stands.</p>" + "</span>" * 40_000 + "</article>"
    start = time.process_time()
    assert H.main_text(page) == "The text stays where it stands."
    assert time.process_time() - start < 10
