"""Main text of web pages by two-pass block rules.

The page becomes blocks: text between the starts and ends of block elements.  First pass, each block by
itself: boilerplate if it stands in an element made for that (menus, forms, ...), in one named so, or
if its characters are mostly links; content if it is long enough and rich in stop words; otherwise
undecided.  Second pass: an undecided block takes the label of the nearest block that was decided by its
words or links, before or after, within its container; of two as near that differ, the one after, as
headings lead their text.  Marked boilerplate ends with its element and says nothing of its neighbours.
Where a page marks its article, blocks outside are boilerplate, and an undecided block within counts as
content unless both neighbours say otherwise.  Where no block of a page is decided to be content, as in
languages without known stop words, the runs of undecided blocks with the most text are the content.

Tags are read as browsers do: a quote opens a value only after "=", and "/>" closes foreign elements only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

#: A tag from its "<" on: name, attributes.  Every character is met once, as nothing is given back.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: The same for a value whose quote never ends: the tag ends at the first ">".
CUT_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Elements that "/>" does close.
FOREIGN = frozenset("svg math".split())
#: Elements whose content isn't text.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
#: Elements whose whole content is left out.
LEFT_OUT = frozenset("nav footer aside form button select dialog head".split())
CONTAINERS = frozenset("article main".split())
NESTED = LEFT_OUT | CONTAINERS | frozenset("body div section header ul ol dl table figure details fieldset".split())
BLOCKS = NESTED | frozenset("html p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption blockquote pre address hr figcaption summary option legend center hgroup tbody thead tfoot".split())
#: Parts of class names and ids (fixed lists): a name is boilerplate if it has one of the first and otherwise such and neutral ones only.
NAMED = frozenset("""
ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar
navigation newsletter notice notices notification notifications pager pagination popup promo promoted promotion related replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets
""".split())
NEUTRAL = frozenset("""
and area articles bar block bottom box btn button buttons column container content el element footer form global group header holder icons id in inner item items js left level links list main media mobile more
of outer page panel policy popular post posts primary right row secondary section side site slot small sm sticky stories sub the thread to top unit wrap wrapper
""".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: The commonest words of four languages.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his i if in is it its my no not of on or our she so that the their them then there they this to was we were what when which who will with would you your
au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tu un une vos votre vous
aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
al algo como con de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una uno y ya
""".split())


@dataclass
class Rules:
    short: int = 70  # characters; below, a block isn't decided by its words
    stop_words: float = 0.15  # share of words, at least, of content
    links: float = 0.5  # share of characters in links, at most


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    inside: bool  # in an article
    container: int


def named_boilerplate(names: str) -> bool:
    """Whether one of the names, whole, is made of boilerplate's words: "site-footer" is, "social-history" isn't."""
    for name in names.split():
        parts = [x.lower() for x in PARTS.findall(name) if len(x) > 1]
        if any(x in NAMED for x in parts) and all(x in NAMED or x in NEUTRAL for x in parts):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, bad, inside, container
    link, containers, at, n = False, 0, 0, len(page)

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(x for x, _ in parts)).split())
            if text:
                linked = len("".join("".join(html.unescape(x).split()) for x, in_link in parts if in_link))
                _, bad, inside, container = stack[-1]
                out.append(Block(text, linked, bad, inside, container))
            parts.clear()

    last = page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last:  # no more tags: browsers drop a tag that never ends
            end = re.compile(r"</?[a-zA-Z!?]").search(page, at) if start >= 0 else None
            parts.append((page[at : end.start() if end else n], link))
            break
        if start > at:
            parts.append((page[at:start], link))
        c = page[start + 1 : start + 2]
        if c in ("!", "?"):
            opening, close = next(((x, y) for x, y in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x, start)), ("<", ">"))
            end = page.find(close, start + len(opening))
            at = end + len(close) if end >= 0 else n
            continue
        m = TAG.match(page, start) or CUT_TAG.match(page, start)
        if not m:
            parts.append(("<", link))
            at = start + 1
            continue
        at, closing, name, rest = m.end(), c == "/", m[1].lower(), m[2]
        if name in RAW:
            if not closing and not (name in FOREIGN and rest.endswith("/")):
                ends = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = ends.end() if ends else n
            continue
        if name == "br":
            parts.append((" ", link))
        elif name == "a":
            link = not closing
        if name not in BLOCKS:
            continue
        end_block()
        link = False
        if name not in NESTED:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            _, bad, inside, container = stack[-1]
            if name in CONTAINERS and not bad:
                containers += 1
                inside, container = True, containers
            if name == "body":
                bad = False
            elif name in LEFT_OUT or name == "header" and not inside:
                bad = True
            elif not bad and name not in CONTAINERS and rest:
                for key, *values in ATTRIBUTE.findall(rest):
                    key, value = key.lower(), "".join(values).strip()
                    bad |= key in ("class", "id") and named_boilerplate(value) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true"
            stack.append((name, bad, inside, container))
    end_block()
    return out


def stop_share(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def densest_runs(blocks: list[Block], decided: list[bool | None]) -> list[bool | None]:
    """Of the runs of undecided blocks, those with a quarter of the longest one's text or more are content, the others not."""
    runs = [list(g) for open_, g in groupby(range(len(blocks)), lambda i: decided[i] is None) if open_]
    size = [sum(len(blocks[i].text) for i in run) for run in runs]
    out = list(decided)
    for run, k in zip(runs, size):
        for i in run:
            out[i] = 4 * k >= max(size)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The page's content blocks, in order, joined by an empty line; white space in a block is one space."""
    blocks = blocks_of(page or "")
    decided: list[bool | None] = []
    for b in blocks:
        if b.bad or b.linked > rules.links * len(b.text):
            decided.append(False)
        elif len(b.text) >= rules.short and stop_share(b.text) >= rules.stop_words:
            decided.append(True)
        else:
            decided.append(None)
    # An article that is marked holds the content, unless it has next to none of it.
    weight = lambda inside: sum(len(b.text) for b, d in zip(blocks, decided) if d is not False and b.inside is inside)
    if (within := weight(True)) and 4 * within >= weight(False):
        decided = [d if b.inside else False for b, d in zip(blocks, decided)]
    if True not in decided and not any(b.inside and d is None for b, d in zip(blocks, decided)):
        decided = densest_runs(blocks, decided)
    labels: list[bool] = []
    n = len(blocks)
    before: list[tuple[bool, int] | None] = [None] * n
    after: list[tuple[bool, int] | None] = [None] * n
    for places, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in places:
            if last is not None and blocks[last].container == blocks[i].container:
                near[i] = (bool(decided[last]), abs(i - last))
            if decided[i] is not None and not blocks[i].bad:
                last = i
    for i, (b, d) in enumerate(zip(blocks, decided)):
        if d is not None:
            labels.append(d)
        elif b.inside:
            labels.append(not (before[i] and after[i] and not before[i][0] and not after[i][0]))
        else:
            x, y = before[i], after[i]
            labels.append(y[0] if y and (not x or y[1] <= x[1]) else x[0] if x else False)
    return "\n\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract_html(pages: DataFrame, rules: Rules = Rules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id, url, text, n_chars (code points).

    Null or empty pages, and pages without content, have the empty text.  Pages are read alone and whole, in
    time that grows with their length: repeated rows, null ids and urls come out as they are.  Other columns
    are left out, whatever their names.  Empty in, empty out.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [main_text(x, rules) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {x: rows.schema[x].dataType.simpleString() for x in ("id", "url")}
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
