"""What of a page is visible: a table of cases with the text that the HTML and CSS rules give."""

import pytest

from rowsight.llm.rendering import render

CASES = [
    ("<div style='visibility:hidden'>x<span style='visibility:visible'>y</span></div>", "y"),
    ("<div style='visibility:hidden'>x<p>z</p><p style='VISIBILITY : Visible'>y</p></div>w", "y\nw"),
    ("<div style='visibility:visible'>a<b style='visibility:collapse'>b<i style='visibility:inherit'>c</i></b></div>", "a"),
    ("<div style='visibility:hidden;color:red;visibility:visible'>a</div>", "a"),
    ("<div style='display:none'>x<span style='visibility:visible;display:block'>y</span></div>z", "z"),
    ("<div style='color:red; display : none'>x</div>z", "z"),
    ("<div hidden>x</div><div hidden='until-found'>y</div>z", "z"),
    ("<details>gone<summary>head</summary><p>body</p></details>after", "head\nafter"),
    ("<details><p>body</p></details>after", "after"),
    ("<details open><summary>head</summary><p>body</p></details>", "head\n\nbody"),
    ("<details><summary>one</summary><summary>two</summary><details open><summary>in</summary>x</details></details>", "one"),
    ("<dialog>closed</dialog><dialog open>said</dialog>", "said"),
    ("<table style='visibility:hidden'><tr><td>a</td><td style='visibility:visible'>b</td></tr></table>", "b"),
    ("<ul><li style='visibility:hidden'>a</li><li>b</li></ul>", "- b"),
    ("<p style='visibility:hidden'>a<br>b<br>c</p>d", "d"),
    ("<p style='-x-visibility:hidden'>a</p>", "a"),
    ("<script>x</script><template><p>y</p></template><noscript>z</noscript>w", "w"),
    ("<input type=hidden value=a><label>b</label>", "b"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_visibility(html, text):
    # blank lines between blocks are the layout's matter
    assert [x for x in render(html).split("\n") if x] == [x for x in text.split("\n") if x]


def test_deep_trees():
    assert render("<i>" * 5000 + "x") == "x"
    assert render("<div style='visibility:hidden'>" + "<i>" * 5000 + "x</i>") == ""
