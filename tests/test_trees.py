"""Malformed pages and the trees that browsers make of them."""

import pytest

from tallygrain.functions.evidence import Node, Tree, is_struck, page_evidence


def told(node):
    """The tree as text: elements in brackets, by name."""
    out = "".join(told(c) if isinstance(c, Node) else c for c in node.children)
    return f"[{node.tag}:{out}]" if node.tag else out


TREES = [
    ("<ul><li>a<li>b</ul>c", "[ul:[li:a][li:b]]c"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "[ul:[li:a[ul:[li:b][li:c]]][li:d]]"),
    ("<p>a<p>b", "[p:a][p:b]"),
    ("<p>a<div>b</div>c", "[p:a][div:b]c"),
    ("<p>a<span>b<div>c</div>", "[p:a[span:b]][div:c]"),
    ("<div>a</p>b</div>", "[div:a[p:]b]"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "[dl:[dt:a][dd:b][dt:c][dd:d]]"),
    ("<select><option>a<option>b<optgroup><option>c</select>d", "[select:[option:a][option:b][optgroup:[option:c]]]d"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "[table:[tbody:[tr:[td:a][td:b]][tr:[td:c]]]]d"),
    ("<table><td>a</table>", "[table:[tbody:[tr:[td:a]]]]"),
    ("<table><thead><tr><th>h<tbody><tr><td>a</table>", "[table:[thead:[tr:[th:h]]][tbody:[tr:[td:a]]]]"),
    ("<table>a<tr><td>b</table>c", "a[table:[tbody:[tr:[td:b]]]]c"),
    ("<table><tr><div>a</div><td>b</table>", "[div:a][table:[tbody:[tr:[td:b]]]]"),
    ("<table><tr><td><table><tr><td>a</table>b</table>c", "[table:[tbody:[tr:[td:[table:[tbody:[tr:[td:a]]]]b]]]]c"),
    ("<table><tr><td>a</div>b</table>c", "[table:[tbody:[tr:[td:ab]]]]c"),
    ("<div><table><tr><td><p>a</table>b</div>c", "[div:[table:[tbody:[tr:[td:[p:a]]]]]b]c"),
    ("<div><button>a</div>b</button>c</div>d", "[div:[button:ab]c]d"),
    ("<td>a</td>b", "ab"),
    ("<s>a<p>b</s>c</p>d", "[s:a][p:[s:b]c]d"),
    ("<p><b>a<p>b</b>c", "[p:[b:a]][p:[b:b]c]"),
    ("<p><s>a</p>b</s>c", "[p:[s:a]][s:b]c"),
    ("<a>a<a>b</a>c", "[a:a][a:b]c"),
    ("<b>a<i>b</b>c</i>d", "[b:a[i:b]][i:c]d"),
    ("<table><tr><td><s>a<td>b</table>c", "[table:[tbody:[tr:[td:[s:a]][td:b]]]]c"),
    ("<h1>a<h2>b</h2>c", "[h1:a][h2:b]c"),
    ("<div>a</span>b</div>", "[div:ab]"),
    ("<div>a<br>b</br>c<img>d</div>", "[div:a[br:]b[br:]c[img:]d]"),
    ("a</body></html>b", "ab"),
    ("<html><body>a<body>b</body>", "[html:[body:ab]]"),
    ("<html><head><title>t</title><body>a", "[html:[head:[title:t]][body:a]]"),
    ("<div><p>a</div>b", "[div:[p:a]]b"),
    ("<ruby>a<rt>b<rt>c</ruby>", "[ruby:a[rt:b][rt:c]]"),
    ("<script>if (a < b) '<li>'</script>c", "[script:if (a < b) '<li>']c"),
    ("", ""),
    ("<", "<"),
    ("<table><tr><div>a<td>b</table>c", "[div:a][table:[tbody:[tr:[td:b]]]]c"),
    ("<table><caption>a<tr><td>b</table>c", "[table:[caption:a][tbody:[tr:[td:b]]]]c"),
    ("<table><colgroup><col><col><tr><td>b</table>c", "[table:[colgroup:[col:][col:]][tbody:[tr:[td:b]]]]c"),
    ("</table></td></p>", "[p:]"),
]


@pytest.mark.parametrize(("html", "want"), TREES)
def test_trees(html, want):
    tree = Tree(html)
    assert told(tree.root) == want
    for node in tree.root.walk():  # every element knows where it is
        assert all(c.parent is node for c in node.children if isinstance(c, Node))


def struck(html):
    return {t.strip(): is_struck(n) for t, n in Tree(html).root.texts() if t.strip()}


def test_what_is_struck():
    assert struck('<ul><li class="was-price was price-was"><s>£9</s><li>£5</ul>') == {"£9": True, "£5": False}
    assert struck("<p><del>£9</del> <b>£5</p><p>£4") == {"£9": True, "£5": False, "£4": False}
    assert struck("<s>£9<p>£8</s>£7</p>") == {"£9": True, "£8": True, "£7": False}
    assert struck("<table><tr><td><s>£9<td>£5</table>") == {"£9": True, "£5": False}


def test_evidence_of_a_list_without_end_tags():
    html = '<html><body><h1>Tea</h1><ul><li class="strike">£9.00<li>£5.00</ul></body>'
    got = {e["value"]: e["struck"] for e in page_evidence(html, None)}
    assert got.get("5.00") is False and got.get("9.00", True) is True


def test_deep_and_odd_pages_end():
    for junk in ("<table>" * 50 + "a", "<s><p>" * 60 + "</s>" * 60, "<a><div>" * 40 + "</a></div>" * 40, "</" * 100, "<li>" * 500, "<b>" * 300 + "<p>" * 300 + "x"):
        assert Tree(junk).root is not None
