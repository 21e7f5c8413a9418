import pytest

from driftline.llm.markup import clean_documents, clean_text, clean_title, elements, marked_elements, markup_of

CASES = {
    "markdown": (
        "# A **b** `c`\n\n- [ ] do [this](http://x/y) now\n  - _sub_ item\n1) one\n\n```go\nx := 1\n# no heading\n```\n\n> # quoted\n> - no\n\n| a | b |\n|---|---|\n| - x | y |\n\n<!-- # gone\n- gone -->\n\nThe $2^{3}$ bound, $5 and $6.\n\nSet `- x` here\n===\n\n$$\na_i\n$$",
        [("heading", "A b c"), ("list_item", "do this now"), ("list_item", "sub item"), ("list_item", "one"), ("code_block", "x := 1 # no heading"), ("formula", "2^{3}"), ("heading", "Set - x here"), ("formula", "a_i")],
    ),
    "html": (
        "<h2 id=x>A&nbsp;<i>b</i> &lt; c</h2><ul><li>one<li>two <b>x</b><ol><li>in</ol></ul><pre class=k><code>a &amp;&amp; b\n  c</code></pre><blockquote><ul><li>no</ul></blockquote><table><tr><td><ul><li>no</ul></td></tr></table><script>h()</script><p>so \\(x_1\\) it is</p><!-- <h1>no</h1> -->",
        [("heading", "A b < c"), ("list_item", "one"), ("list_item", "two x"), ("list_item", "in"), ("code_block", "a && b c"), ("formula", "x_1")],
    ),
    "wiki": (
        "== A '''b''' [[P|q]] ==\n* one [http://x/y two]\n** sub\n# three\n{|\n| * no\n|}\n<source lang=go>\n* x\n</source>\nIs <math>a^2</math> so<ref>z</ref>.",
        [("heading", "A b q"), ("list_item", "one two"), ("list_item", "sub"), ("list_item", "three"), ("code_block", "* x"), ("formula", "a^2")],
    ),
    "latex": (
        "% note\n\\section*{A \\emph{b}~c\\_d}\n\\begin{itemize}\n\\item one \\href{http://x}{two}\n\\item \\texttt{3}\\begin{enumerate}\\item in\\end{enumerate}\n\\end{itemize}\n\\begin{verbatim}\n\\item x % y\n\\end{verbatim}\n\\begin{quote}\\begin{itemize}\\item no\\end{itemize}\\end{quote}\n\\[ a \\ge 3 \\]\nIf $b_i$ holds.",
        [("heading", "A b c_d"), ("list_item", "one two"), ("list_item", "3"), ("list_item", "in"), ("code_block", "\\item x % y"), ("formula", "a \\ge 3"), ("formula", "b_i")],
    ),
}


@pytest.mark.parametrize("kind", CASES)
def test_elements(kind):
    text, want = CASES[kind]
    assert markup_of(text) == kind and sorted(elements(text)) == sorted(want)
    assert sorted(elements(text.replace("\n", "\r\n"))) == sorted(want)


@pytest.mark.parametrize("text", ["a < b and c > 2 * 3 * 4", "It went from $12 to $45 a week.", "#42 is older\n--dry-run prints", "Option<Peer> and x_y_z", "", "   "])
def test_plain_text_has_no_elements(text):
    assert elements(text) == []


@pytest.mark.parametrize("title,want", [
    ("fix **a** `b_c` [d](http://x)", "fix a b_c d"), ("## top", "top"), ("x <b>y</b> &amp; z&nbsp;w", "x y & z w"), ("'''a''' [[P|q]]", "a q"), ("\\texttt{a\\_b} c", "a_b c"), ("Option<Peer> in a_b_c", None), ("#42 2 * 3 * 4", None), ("plain", None), ("  two  blanks ", None),
])
def test_titles(title, want):
    assert clean_title(title) == want


PROSE = "A sentence, long enough, with commas, to count here. " * 4
LINKED = [f"Page {i} of all" for i in range(5)]


@pytest.mark.parametrize("text", [
    "<nav><ul>" + "".join(f"<li><a href=/x>{x}</a></li>" for x in LINKED) + f"</ul></nav><article><h1>T</h1><p>{PROSE}</p><ul><li>kept</ul></article><footer><h4>More</h4><ul>" + "".join(f"<li><a href=/y>{x}</a>" for x in LINKED) + "</ul></footer>",
    f"# T\n\n{PROSE}\n\n- kept\n\n## Links\n\n" + "\n".join(f"- [{x}](http://x/y)" for x in LINKED),
    "\n".join(f"* [http://x/y {x}]" for x in LINKED) + f"\n== T ==\n{PROSE}\n* kept\n",
    f"\\section{{T}}\n{PROSE}\n\\begin{{itemize}}\n\\item kept\n\\end{{itemize}}\n\\section{{Links}}\n\\begin{{itemize}}\n" + "".join(f"\\item \\href{{http://x}}{{{x}}}\n" for x in LINKED) + "\\end{itemize}",
])
def test_navigation_is_left_out_by_its_score(text, monkeypatch):
    from driftline.llm import markup

    assert elements(text) == [("heading", "T"), ("list_item", "kept")]
    monkeypatch.setattr(markup, "main_content", lambda root: [root])
    assert len(elements(text)) >= 7


@pytest.mark.parametrize("text,want", [
    ("# [T](http://x/y)\n\n- [one](http://x/y)\n", [("heading", "T"), ("list_item", "one")]),
    ("# T\n\n## [U](http://x/y)\n\n- see [one](http://x/y) for the reason\n- [two](http://x/y)\n- and three\n", [("heading", "T"), ("heading", "U"), ("list_item", "see one for the reason"), ("list_item", "two"), ("list_item", "and three")]),
    ("<div><h3>A</h3></div><div><pre>x</pre></div><p><a href=x>y</a></p><ul><li>b</ul>", [("heading", "A"), ("code_block", "x"), ("list_item", "b")]),
])
def test_short_parts_and_single_references_stay(text, want):
    assert elements(text) == want


@pytest.mark.parametrize("text,want", [
    ("# T\n\n> # one\n> - two\ngoes on\n> > three\n> ```\n> x = 1\n> ```\n\n| a | b |\n|---|---|\n| `c` | **d** \\| e |\n", "# T\n# one\n- two goes on\nthree\n```\nx = 1\n```\na\nb\nc\nd | e"),
    ("<h1>T</h1><blockquote><p>one</p></blockquote><table><tr><td>a<td>b</tr></table>", "# T\none\na\nb"),
    ("== T ==\n'''x''' [[P|q]]\n<blockquote>\none\n* two\n</blockquote>\n{| class=\"k\"\n|+ cap\n! h !! i\n|-\n| style=\"s\" | a || [[P|b]]\nmore\n|}\n", "# T\nx q\none\n- two\ncap\nh\ni\na\nb more"),
    ("\\section{T}\n\\begin{quote}one\n\\begin{itemize}\\item two\\end{itemize}\\end{quote}\n\\begin{table}[h]\\caption{Cap}\\begin{tabular}{l|r}\\hline a & b \\\\ c \\& d & e \\\\\\end{tabular}\\end{table}\n\\begin{tabular*}{\\textwidth}{ll}f & g\\end{tabular*}\n", "# T\none\n- two\nCap\na\nb\nc & d\ne\nf\ng"),
])
def test_quotes_and_tables_are_text_but_no_elements(text, want):
    assert clean_text(text) == want and elements(text) == [("heading", "T")]


@pytest.mark.parametrize("text,want", [
    ("# T\n\n> # q\nThe bound $x_1$ holds.", [("heading", "T"), ("formula", "x_1")]),  # no paragraph goes on behind a quoted heading
    ("# T\n\n    > run\n    | sort\n", [("heading", "T"), ("code_block", "> run | sort")]),
    ("- ```\n  x\n- a\n\n1. ```\ny\n   ```\n2. b\n", [("code_block", "x"), ("list_item", "a"), ("code_block", "y"), ("list_item", "b")]),
    ("10. ten\n\n    ```go\n    x := 1\n    ```\n    - deep\n", [("list_item", "ten"), ("code_block", "x := 1"), ("list_item", "deep")]),
    ("- ```\n  y\n  ```\n- a\n\n      z\n\n  more\n\n    - deep\n", [("code_block", "y"), ("list_item", "a"), ("code_block", "z"), ("list_item", "deep")]),
    ("- a\n-\n  late\n- - inner\n", [("list_item", "a"), ("list_item", "late"), ("list_item", "inner")]),
    ("# T\n\n$$ unclosed\n- kept\n", [("heading", "T"), ("list_item", "kept")]),
    ("$$\na\n$$ where $b$ is\n- c\n", [("formula", "a"), ("formula", "b"), ("list_item", "c")]),
    ("So $$\na\n$$ and\n# T\n", [("formula", "a"), ("heading", "T")]),
    ("# T\n\n|x| < 1 for $y_1$\n\n| a | b |\n|---|---|\n- c | d\n", [("heading", "T"), ("formula", "y_1"), ("list_item", "c | d")]),
    ("Write `<!--` for\n\n- kept\n\nor <!-- alone\n# T\n", [("list_item", "kept"), ("heading", "T")]),
    ("# T\ntext\n<ul><li>one</ul>\n", [("heading", "T"), ("list_item", "one")]),
])
def test_markdown_parts_that_meet_others_are_found(text, want):
    assert sorted(elements(text)) == sorted(want)


def test_deep_quotes():
    assert clean_text("# T\n\n" + ">" * 5000 + " x\n") == "# T\nx"


def test_tables(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "", " ", 2), (3, "**a**", "# h\n\n- x\n- x", 3), (3, "**a**", "# h\n\n- x\n- x", 3), (4, "p", "q " * 200_000, 4)], "side_id bigint, title string, body string, element int")
    rows = {tuple(r) for r in marked_elements(df, "side_id", "title", "body").collect()}
    assert rows == {(3, "title", "title", "a"), (3, "body", "heading", "h"), (3, "body", "list_item", "x")}
    assert marked_elements(df.limit(0), "side_id", "title", "body").count() == 0
    assert [r.clean_text for r in clean_documents(df.filter("side_id in (1, 3)").distinct().orderBy("side_id"), "body").collect()] == [None, "# h\n- x\n- x"]
