"""Operator 8: main text of web pages by two passes of block rules.

A page is split into blocks at the tags that break lines. Each block carries
its length, the share of its words that are stop words, the share of its
characters inside links, and what its ancestors say (an article, a menu, an
advert, ...). The first pass decides the blocks whose evidence is clear: stop
words and length make text, links without stop words make a menu, and so do
three list items of links in a row. The second lets the undecided, mostly short
ones inherit the label of the nearest decided neighbour, of the following one
where both are as near. The page's edges count as boilerplate.

An article or main element bounds the text if it holds at least half as much of
it as is found outside by the block rules; else the rules decide the whole page.
Inside it, the edges count as text, text wins between neighbours as near, and
names drop whole containers of adverts, notices, sharing and comments alone. A
form is boilerplate unless it holds the article, or all text there is.

A null html is an empty one, whose text is ''; so is that of a page of
boilerplate alone. Broken markup is read as far as it goes: unknown end tags
are ignored, open elements end with the page, a "<" that opens no tag is text.
Rows stand for themselves: repeated ones give equal results, null ids and urls
come back as they are, and an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

# Frequent function words of the languages expected.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could did do for from had has have he her his i if
    in into is it its me more my no not of on one or our out she so some than that the their them then there they this
    to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer es für hat
    ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer
    wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle elles en est et être eux il ils je la le les leur lui mais ne nos
    notre nous on ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous
    al algo con como cual cuando de del desde donde el ella ellos en entre era es esta este esto ha hay la las le lo los
    mas más me mi muy no nos o para pero por que se ser si sin sobre son su sus también tiene todo un una uno y ya
    """.split()
)
# Elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = frozenset("nav header footer aside menu dialog button canvas audio video head".split())
FORM_TAGS = frozenset("form fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
BOILER_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner
    cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay lightbox toast
    newsletter subscribe subscription signup signin login register
    sidebar sidebars side aside widget widgets rail menu menus nav navbar navigation breadcrumb breadcrumbs tabs
    header masthead topbar footer foot bottombar copyright legal
    share sharing social related recommended recommendations popular trending more
    comment comments commentlist disqus reply replies respond feedback
    search form pagination pager paging toolbar skip hidden noprint tags
    """.split()
)
#: Inside an article, names drop a container only if nothing but these and words for parts of a page is in them.
INSIDE_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion
    cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup
    share sharing social comment comments commentlist disqus reply replies respond sidebar
    """.split()
)
PART_NAMES = frozenset("area banner bar block box btn button buttons container content form group inner item items label left links list outer panel right section slot thread unit widget wrap wrapper".split())
#: Names of containers that stand for the article where a page has no article or main element.
TEXT_NAMES = frozenset(
    "article article-body article-content articlebody content main main-content maincontent page-content post post-body post-content entry entry-content story story-body text-content body-text".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element, and the elements that keep them from looking further up.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    words: int
    stop: float
    links: float
    heading: bool
    article: bool  # inside an article or main element, or one named like these where there is none
    boiler: bool  # inside an element that says so
    form: bool = False  # inside a form that doesn't hold the article
    item: bool = False  # in a list or table
    label: bool | None = None


def _says_boiler(tag: str, attributes: str, inside: bool = False) -> bool:
    """inside: in an article."""
    if tag in BOILER_TAGS:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    named = tag not in HEADINGS
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in BOILER_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and named:
            for word in value.split():
                parts = [p.lower() for p in NAME_PART.findall(word)]
                if inside:
                    if INSIDE_NAMES & set(parts) and all(p in INSIDE_NAMES or p in PART_NAMES or p.isdigit() for p in parts):
                        return True
                    continue
                # "has-sidebar" and the like name what stands inside
                if parts and parts[0] not in ("has", "with", "no", "without", "is") and BOILER_NAMES & set(parts) and not {"article", "content", "main", "story", "post"} & set(parts[-1:]):
                    return True
    return False


def _says_text(tag: str, attributes: str) -> int:
    """2 for an article or main element, 1 for a container named like one, else 0."""
    if tag in ("article", "main"):
        return 2
    if attributes and tag in ("div", "section", "td"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role" and value == "main" or name == "itemprop" and value == "articlebody":
                return 2
            if name in ("class", "id") and TEXT_NAMES & set(value.replace("_", "-").split()):
                return 1
    return 0


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, boilerplate, how much of an article, in a form
    open_: Counter = Counter()
    piece: list[str] = []
    linked = anchors = 0
    heading = in_article_header = False

    def flush() -> None:
        nonlocal linked, heading
        if piece:
            text = " ".join("".join(piece).split())
            piece.clear()
            if text:
                words = text.split(" ")
                stops = sum(w.strip(".,;:!?\"'()[]«»“”¿¡").lower() in STOP_WORDS for w in words)
                _, boiler, article, form = stack[-1] if stack else ("", False, 0, False)
                if boiler and heading and in_article_header:
                    boiler = False
                out.append(Block(text, len(words), stops / len(words), min(1.0, linked / len(text)), heading, article, boiler, form, bool(stack) and stack[-1][0] in ("li", "dd", "dt", "td", "th")))
        linked, heading = 0, False

    def pop_to(tag: str) -> None:
        while stack:
            top = stack.pop()[0]
            open_[top] -= 1
            if top == tag:
                return

    def say(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        piece.append(text)
        if anchors:
            linked += len(text)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                anchors = 0
            elif tag not in INLINE:
                if open_[tag] or tag == "p":
                    heading = heading or tag in HEADINGS
                    flush()
                if open_[tag]:
                    pop_to(tag)
                    in_article_header = any(t == "header" and a for t, _, a, _ in stack) if tag == "header" else in_article_header
            elif open_[tag]:
                pop_inline(stack, open_, tag)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            if tag not in ("svg", "math", "noscript", "select", "object"):
                continue
            piece.append(" ")
            continue
        if tag == "a":
            anchors = 1
            continue
        if tag in INLINE:
            if tag == "br":
                piece.append(" ")
            elif tag not in VOID and attributes and _says_boiler(tag, attributes, bool(stack and stack[-1][2])):
                flush()
                _, _, article, form = stack[-1] if stack else ("", False, 0, False)
                stack.append((tag, True, article, form))
                open_[tag] += 1
            continue
        flush()
        if open_["p"] and tag not in VOID:
            pop_to("p")
        if tag in VOID:
            continue
        if tag in ENDS:
            ends, stops_at = ENDS[tag]
            for t, *_ in reversed(stack):
                if t in stops_at:
                    break
                if t in ends:
                    pop_to(t)
                    break
        if tag == "body" and open_["head"]:
            pop_to("head")
        _, boiler, article, form = stack[-1] if stack else ("", False, 0, False)
        own, says = _says_boiler(tag, attributes, article > 0), _says_text(tag, attributes)
        if tag == "header" and article and not boiler:
            in_article_header = True
        stack.append((tag, boiler or own, max(article, says), says < 2 and (form or tag in FORM_TAGS)))
        open_[tag] += 1
        heading = tag in HEADINGS
    flush()
    level = 2 if any(b.article == 2 and not b.boiler for b in out) else 1
    for b in out:
        b.article = b.article >= level
    return out


def pop_inline(stack: list, open_: Counter, tag: str) -> None:
    """Ends the innermost inline element of the name, which was kept for what it says of its text."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i]
            open_[tag] -= 1
            return


SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH, LINKS_MOST = 0.15, 0.28, 0.4


def dense(b: Block) -> bool | None:
    """What length, stop words and links say: True for text, False for boilerplate, None where they don't."""
    if b.links > LINKS_MOST:
        return None if b.stop > 0 and b.article else False  # in an article, a link may be a sentence
    if len(b.text) < SHORT or b.heading:
        return None
    if b.stop >= STOP_HIGH or b.stop >= STOP_LOW and len(b.text) >= LONG:
        return True
    return None if b.stop >= STOP_LOW or b.article or len(b.text) < LONG else False


def first_pass(found: list[Block]) -> None:
    """Labels the blocks whose evidence is clear; an article that isn't believed is forgotten."""
    boxed = lambda b: b.boiler or b.form
    if not any(b.article and not boxed(b) for b in found) and not any(dense(b) and not boxed(b) for b in found):
        for b in found:  # all there is stands in forms
            b.form = False
    inside = sum(len(b.text) for b in found if b.article and not boxed(b) and len(b.text) >= SHORT and b.links <= LINKS_MOST)
    outside = sum(len(b.text) for b in found if not b.article and not boxed(b) and dense(b))
    bounded = any(b.article and not boxed(b) for b in found) and 2 * inside >= outside
    run: list[Block] = []
    for b in [*found, None]:
        if b is not None:
            b.article = bounded and b.article
            if boxed(b) or bounded and not b.article:
                b.label = False
            elif b.text.startswith(("©", "(c)", "(C)", "Copyright ")) and len(b.text) < LONG and not b.article:
                b.label = False
            else:
                b.label = dense(b)
        if b is not None and b.item and b.links > 0.9:
            run.append(b)
            continue
        # a list of links is a menu, one of sentences in links is not
        if len(run) >= 3 and not sum(x.stop > 0 for x in run) * 2 > len(run):
            for x in run:
                x.label = False
        run = []


def second_pass(found: list[Block]) -> list[bool]:
    """The labels, with the undecided ones inherited from the nearest decided neighbour."""
    n = len(found)

    def nearest(order: range) -> list[tuple[int, bool]]:
        # inside an article, what its tags drop is passed over, and its edge is text
        out, edge = [(0, False)] * n, order[0] - order.step if n else 0
        last = within = (edge, False)
        before = False
        for i in order:
            b = found[i]
            if b.article != before:
                within, before = (i - order.step, True), b.article
            out[i] = within if b.article else last
            if b.label is not None:
                last = (i, b.label)
                if b.article and not b.boiler and not b.form:
                    within = last
        return out

    left, right = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for i, b in enumerate(found):
        if b.label is not None:
            out.append(b.label)
            continue
        (p, before), (q, after) = left[i], right[i]
        if b.article and q - i == i - p:
            out.append(before or after)
        else:
            out.append(after if q - i <= i - p else before)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    first_pass(found)
    return "\n\n".join(b.text for b, good in zip(found, second_pass(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """pages(html) with text and n_chars, without html; columns of these names give way."""
    kept = pages.drop("text", "n_chars")
    fields = [f for f in kept.schema.fields if f.name != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few pages at a time: their texts are in memory twice
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                cols = [part.column(i) for i, n in enumerate(part.schema.names) if n != "html"]
                names = [n for n in part.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
