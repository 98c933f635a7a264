import pytest

from lodestore.llm.markup import best_region, clean, clean_documents, fit_weights, found_elements, labelled_pages


def found(text):
    _, kinds, elements = clean(text)
    return kinds, elements


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<style>p{}</style><h2 id=x>Q&amp;A <b>one</b></h2>\n<ul>\n<li>first\n<li>se<i>co</i>nd</li>\n</ul><pre><code>if a &lt; b:\n  go()</code></pre><p>Words follow here.</p>", ("html", [("html", "heading", "Q&A one"), ("html", "list_item", "first"), ("html", "list_item", "second"), ("html", "code", "if a < b: go()")])),
        ("# A *b* c ##\n\nTitle `two`\n=====\n\n- x [y](http://z)\n1. n\\*m\n\n~~~ py\n# no heading\n~~~\n\nHere $a_b$ and $$x^2$$ hold.", ("markdown", [("markdown", "heading", "A b c"), ("markdown", "heading", "Title two"), ("markdown", "list_item", "x y"), ("markdown", "list_item", "n*m"), ("markdown", "code", "# no heading"), ("markdown", "formula", "a_b"), ("markdown", "formula", "x^2")])),
        ("=== H ''i'' ===\n\n# one [[a|b]]\n# two [http://x y]\n\n*c\n*d\n\n<syntaxhighlight lang=\"go\">\n== no ==\n</syntaxhighlight>\n\nText.<ref name=\"r\">n</ref> Here <math>\\|p\\| < 1</math> holds. {{stub}} __NOTOC__", ("wiki", [("wiki", "heading", "H i"), ("wiki", "list_item", "one b"), ("wiki", "list_item", "two y"), ("wiki", "list_item", "c"), ("wiki", "list_item", "d"), ("wiki", "code", "== no =="), ("wiki", "formula", "\\|p\\| < 1")])),
        ("\\documentclass{article}\n\\begin{document}\n\n\\section*{Q\\&A \\emph{of} it}\\label{s}\n\n\\begin{itemize}\n  \\item 5\\% \\href{http://x}{more}\n  \\item last\n\\end{itemize}\n\nHere \\( a_1 \\) and $b$ hold.~\\cite{k} % note\n\n\\begin{verbatim}\n# x = 1\n\\end{verbatim}\n\n\\begin{equation}\nv \\to 1\n\\end{equation}\n\n\\end{document}", ("latex", [("latex", "heading", "Q&A of it"), ("latex", "list_item", "5% more"), ("latex", "list_item", "last"), ("latex", "formula", "a_1"), ("latex", "formula", "b"), ("latex", "code", "# x = 1"), ("latex", "formula", "v \\to 1")])),
    ],
)
def test_elements(text, want):
    kinds, elements = found(text)
    assert kinds == [want[0]]
    assert sorted(elements) == sorted(want[1])


@pytest.mark.parametrize("text", ["We tried 5 * 83 * 2 settings.", "If a < b && b > 88 then it wins.", "Version C# 28 and F# were not compared.", "Open run_book_v2 first.", "It costs $ 3 now, earlier $ 7.", "See note [72] of the trial.", "The path was D:\\kernel\\kernel.", "Take 92^2 or 2**92 as a bound.", "Size is 28 x 28 (= valve). R&D asked item # 51.", "The source -> sink step took ~46 hours; a|b works."])
def test_signs_in_plain_text_are_no_marks(text):
    assert found(text) == ([], [])


def test_two_kinds_in_one_text():
    kinds, elements = found("<h1>One</h1>\n\n<p>Some words of text.</p>\n\nTwo\n---\n\n- item **b**")
    assert kinds == ["html", "markdown"]
    assert ("html", "heading", "One") in elements
    assert ("markdown", "heading", "Two") in elements


def test_clean_text_keeps_structure_and_drops_furniture():
    text = "<head><title>t</title><style>a{}</style></head><nav><a href=1>Home</a><a href=2>Shop</a></nav><h1>Pump</h1><p>The pump was checked in May and ran well.</p><ul><li>open</li></ul><footer><a href=3>Imprint</a></footer><script>track()</script>"
    out = clean(text)[0]
    assert "# Pump" in out
    assert "- open" in out
    assert "<" not in out
    assert "track" not in out


def test_region_is_the_best_run():
    assert best_region([-1, 2, 3, -1, 2, -9, 4]) == (1, 5)
    assert best_region([]) == (0, 0)
    assert best_region([-1, -2]) == (0, 0)
    w = fit_weights()
    assert w["word"] > 0 > w["tag:script"] if "tag:script" in w else w["word"] > 0


def test_long_and_unclosed_texts_end():
    assert clean("<pre>" + "x " * 200_000)[1] == ["html"]
    assert clean("\\section{" * 2_000)[1] == ["latex"]
    assert clean("*" * 100_000 + " a")[0]
    assert clean("[[" * 50_000)[1] == []


def test_tables(spark):
    rows = [("a", "# H", 1, "k"), ("a", "# H", 2, "k"), ("n", None, 1, "k"), ("e", "", 1, "k"), ("b", " \n", 1, "k"), (None, "# X", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id string, content string, clean int, kinds string")
    got = {tuple(r) for r in found_elements(clean_documents(df)).collect()}
    assert got == {("a", "markdown", "document", ""), ("a", "markdown", "heading", "H")}
    assert found_elements(clean_documents(df.limit(0))).count() == 0


def test_every_known_tag_is_stripped():
    text = '<h1>Pump</h1><details open><summary>More</summary><p>The <var>x</var> and <samp>out</samp> of the pump were read.</p></details><figure><figcaption>The room</figcaption></figure><table><caption>Sizes</caption><tr><td>one valve</td></tr></table><video controls><source src="a.mp4">No film here</video><select name=q><option value=1>red</option></select><noscript>Turn it on</noscript><svg width=4><path d="M0 0"/></svg><p>It ran well in May, and nobody saw a leak.</p>'
    out, kinds, elements = clean(text)
    assert kinds == ["html"]
    assert elements == [("html", "heading", "Pump")]
    assert "<" not in out
    for word in ("More", "The x and out of the pump", "The room", "Sizes", "No film here", "nobody saw a leak"):
        assert word in out
    assert clean("<details><summary>More</summary>It ran well.</details>")[1] == ["html"]


@pytest.mark.parametrize("text", ["Give it <time> and <var> as they stand.", "A map<data> or list<object> will do."])
def test_names_in_angle_brackets_are_no_tags(text):
    assert clean(text) == (text, [], [])


def test_templates_nest_to_any_depth():
    deep = "{{a|" * 40 + "x" + "}}" * 40
    out = clean(f"== Use ==\nThe pump {deep}was checked in May. It {{{{b}}}}ran ''well'' for ten days.")[0]
    assert "{" not in out
    assert "The pump was checked in May. It ran well for ten days." in out
    assert len(clean("== Use ==\nThe pump ran. " + "{{" * 100_000 + "}}" * 100_000)[0]) < 100


@pytest.mark.parametrize("text", ["\x05 9 \x06", "\x0599\x06 # H", "# A \x0312\x04 b\x05\x06", "\x017\x02 <b>x</b>", "<p>\x05 3 \x06\x03 4 \x04</p>", "".join(map(chr, range(1, 9))) * 3])
def test_marker_characters_in_a_text_are_blanks(text):
    out, _, elements = clean(text)
    assert not set(out) & set(map(chr, range(1, 7)))
    assert all(not set(c) & set(map(chr, range(1, 7))) for _, _, c in elements)


MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate("Home Shop Cart Login Help Terms".split())) + "</ul></nav>"
FOOT = "<footer><ul><li><a href=4>Imprint</a></li><li><a href=5>Privacy</a></li></ul></footer>"
BODY = "<h1>Pump room</h1><p>The pump was checked in May and ran <b>well</b> for ten days.</p><ul><li>Open the valve</li><li>Note the <a href=9>time</a></li></ul><p>Nobody saw a leak.</p>"


def test_the_region_decides_which_elements_come_out():
    """Menus, footers and link bars go with the region, and come back when words and tags score alike."""
    content = [("html", "heading", "Pump room"), ("html", "list_item", "Open the valve"), ("html", "list_item", "Note the time")]
    assert clean(MENU + BODY + FOOT)[2] == content
    assert clean(f"{MENU}\n{BODY}\n\n{FOOT}")[2] == content
    assert clean(BODY)[2] == content
    flat = {"word": 1.0, "tag": 0.0, "command": 0.0}
    assert len(clean(MENU + BODY + FOOT, flat)[2]) == len(content) + 8
    bar = "<div><a href=a>One</a> | <a href=b>Two</a> | <a href=c>Three</a> | <a href=c>Four</a></div>"
    assert "Two" not in clean(bar + BODY)[0]
    wiki = "{{Infobox\n| name = pump\n| size = 3\n}}\n== Use ==\nThe '''pump''' moves [[water|cold water]] into the tank. It was built in March.\n* first step\n\n[[Category:Pumps]]\n[[Category:Tanks]]\n__NOTOC__"
    assert clean(wiki)[2] == [("wiki", "heading", "Use"), ("wiki", "list_item", "first step")]


def test_weights_from_a_labelled_table(spark):
    rows = [(p, i, c, t) for p in range(30) for i, (c, t) in enumerate([(False, MENU), (True, BODY), (False, FOOT)])] + [(99, 0, None, "x"), (98, 0, True, None), (None, 0, True, "x")]
    table = spark.createDataFrame(rows, "page int, part int, content boolean, text string")
    pages = labelled_pages(table, most=20)
    assert len(pages) == 20
    assert pages[0] == [(False, MENU), (True, BODY), (False, FOOT)]
    assert pages == labelled_pages(table.repartition(3), most=20)
    weights = fit_weights(pages)
    assert weights["tag:a"] < 0 < weights["word"]
    assert clean(MENU + BODY, weights)[2][0] == ("html", "heading", "Pump room")
    assert labelled_pages(table.limit(0)) == []


def test_what_is_kept_nests_to_any_depth():
    text = "# A\n\n" + "> " * 12 + "- x `a` and `b` of $c$\n\nThe pump was checked in May."
    assert "\x05" not in clean(text)[0]
