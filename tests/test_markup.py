import pytest

from folioflow.operators import dom, markup
from folioflow.operators.markup import Look, Rules


def body(text):
    return dom.inner_html(markup.body_of(dom.parse(text)))


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p><b>x<br><p>y</p><p>z", "<p><b>x<br></b></p><p><b>y</b></p><p><b>z</b></p>"),
        ("<b>1<p>2</b>3</p>4", "<b>1</b><p><b>2</b>3</p>4"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<table><td>x<td>y<tr><th>z</table>q", "<table><tbody><tr><td>x</td><td>y</td></tr><tr><th>z</th></tr></tbody></table>q"),
        ("<p>a<span/>b</p>c", "<p>a<span>b</span></p>c"),
        ('<body><script>var t="</p>";</script><p>x', '<script>var t="</p>";</script><p>x</p>'),
        ("a&nbsp;&lt;<!-- c -->d", "a&nbsp;&lt;<!-- c -->d"),
    ],
)
def test_tree(page, want):
    assert body(page) == want


def units(page, **rules):
    return list(markup.body_units(page, Rules(**rules).compiled()))


def test_candidates_and_tokens():
    found = units('<body>loose<div><p>a <em class="x">b</em> <sup>1</sup><br>c</p><p>Figure 3.1</p><div>own <p>inner</p></div></div><script>x</script><p> </p><p>d</p></body>')
    assert [(k, o, i) for k, _, o, i in found] == [
        (0, "a {{etm_o_00000}}b{{etm_c_00000}} {{etm_n_00001}}{{etm_n_00002}}c", False), (1, "Figure 3.1", True),
        (2, "own {{etm_o_00000}}inner{{etm_c_00000}}", False), (4, "d", False),
    ]


def test_rules():
    page = '<body><div class="whole">x <p>y</p></div><p class="skip">no</p><p>a <span class="keep">b</span></p><p data-k="secret">c</p><p>SKIP me</p></body>'
    found = units(page, priority=(".whole",), ignore=(".skip",), reserve=(".keep",), filters=("secret", "skip ME"), scope="html")
    assert [(o, i) for _, _, o, i in found] == [("x {{etm_o_00000}}y{{etm_c_00000}}", False), ("no", True), ("a {{etm_n_00000}}", False), ("c", True), ("SKIP me", True)]
    assert [o for _, _, o, _ in units("<ul><li>a</li></ul><p>b</p>", translate_tags="li")] == ["a"]
    assert units("<body class=x><p>a</p>", ignore=("body.x",)) == []


def inject(page, said, **look):
    rules = Rules().compiled()
    keys_ = {markup.keys.uid_of("body", "p", k): t for k, t in said.items()}
    text, n = markup.inject_body(page, "p", keys_, rules, Look(**look))
    return text.partition("<body>")[2].removesuffix("</body></html>"), n


PAGE = '<p id="q">a <em id="e" class="x">b</em></p>'
SAID = {0: "u {{etm_o_00000}}v{{etm_c_00000}} <"}


def test_positions():
    em = '<em class="x">v</em>'
    new = f'<p class="et-translation" style="display:block;color:red" lang="ar-EG" dir="rtl">u {em} &lt;</p>'
    look = {"color": "red", "lang": "ar-EG", "direction": "rtl"}
    assert inject(PAGE, SAID, position="below", **look) == (PAGE + new, 1)
    assert inject(PAGE, SAID, position="above", **look) == (new + PAGE, 1)
    only = '<p id="q" class="et-translation" style="color:red" lang="ar-EG" dir="rtl">u <em id="e" class="x">v</em> &lt;</p>'
    assert inject(PAGE, SAID, position="only", **look)[0] == only
    table, _ = inject(PAGE, SAID, position="right", **look)
    assert table == f'<table class="et-translation-table" width="100%"><tbody><tr><td width="45%" valign="top">{PAGE}</td><td width="10%"></td><td width="45%" valign="top">{new}</td></tr></tbody></table>'
    left, _ = inject(PAGE, SAID, position="left", gap_kind="space_count", gap_spaces=2)
    assert "<td>\xa0\xa0</td>" in left and left.index("et-translation") < left.index('id="q"')


def test_inline_items_lines_and_colours():
    assert inject("<ul><li id=i>item</li></ul>", {0: "x"})[0] == '<ul><li id="i">item<br></br><span class="et-translation">x</span></li></ul>'
    assert inject("<p>a<br>b</p>", {0: "x{{etm_n_00000}}y"})[0] == '<p>a<br></br><span class="et-translation">x</span><br></br>b<br></br><span class="et-translation">y</span></p>'
    assert inject("<p>a</p>", {0: "x"}, original_color="blue")[0].startswith('<p style="color:blue">a</p>')


def test_untouched_and_broken():
    assert markup.inject_body("<p>a", "p", {}, Rules().compiled(), Look()) == ("<p>a", 0)
    with pytest.raises(ValueError):
        inject(PAGE, {0: "lost tokens"})
    with pytest.raises(ValueError):
        inject(PAGE, {0: " "})


def test_decoding():
    assert markup.decode_page("é".encode("utf-16")) == "é" and markup.decode_page(b"\xfe\xff\x00a") == "a" and markup.decode_page(b"\xef\xbb\xbfa") == "a"
    for bad in (b"\xff\xfea", b"\xff"):
        with pytest.raises(ValueError):
            markup.decode_page(bad)
    page = '<?xml version="1.0"?><!DOCTYPE html [<!ENTITY a "b>c">]><p>x'
    a, b = markup.doctype_range(page)
    assert page[a:b].endswith("]>") and page[b:] == "<p>x"


def test_selectors():
    tree = dom.parse('<div class="x y"><p id=a lang="en-US">1</p><p data-k="q z">2</p><em><span>3</span></em></div>')
    hits = lambda s: [e.name + e.attributes.get("id", "") for e in tree.walk() if dom.selector(s)(e)]
    assert hits(".x > p") == ["pa", "p"] and hits("[lang|=en], em > span") == ["pa", "span"] and hits("p + p") == ["p"] and hits("p:not(#a)") == ["p"] and hits('div.x.y [data-k^="q"]') == ["p"]
    for bad in ("", "p:::", "[", ">"):
        with pytest.raises((ValueError, IndexError, KeyError)):
            dom.selector(bad)
