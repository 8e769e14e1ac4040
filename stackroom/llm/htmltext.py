"""Operator 7, HTML extraction: two-pass block rules over the blocks of a page.

Markup is cut into blocks (runs of inline content between block-level tags) in one walk over the page, in time
proportional to its length. Blocks in containers that say by their tag or role what they are (navigation, page
header and footer, sidebar, hidden parts) are boilerplate at once. A class or id says so only if one of
its names is made of such words (CUES) and of words without meaning of their own (PLAIN): "cookie-banner" does,
"notice-board" and "related-work" don't; and a container that is named for the page's layout, or a form, that
holds most of the page's dense text is left to the passes. A surer word (SURE) does so beside any other ones if the
container holds a control, and not most of the dense text. Neighbours alike in tag and class that each hold a link to
reply are comments, whatever they are called, if a text stands before them. First pass: stop-word density, length and link density decide each block
as good or bad, or leave it open. Where no language of STOP_WORDS is the page's, or a block's script has no
such words, length, sentence ends and link density decide alone. Second pass: open short blocks take the label
of the nearest decided neighbours. If the page marks its main region (article, main, role=main), only that
region counts there, and an open block is dropped only between two bad ones, so short paragraphs and headings
stay.

Text: character references decoded, white space inside a block made one space, trimmed, blocks joined in
page order by one line break.

Defined cases: a null, empty or markup-only page has an empty text; unclosed and stray tags are closed or
ignored as a browser would, and an article inside an unclosed menu or advert starts afresh; a quote that is
never closed ends with its tag; an open block as near to a good as to a bad one is good on marked pages and
takes the later one's label on others; repeated rows are extracted row by row; a very long page is walked
whole; an empty table gives an empty table; further columns stay, and one with an output's name is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, ship

OPENED = re.compile(r"</?[a-zA-Z][^\s/>]*")
#: One attribute, with the white space and slashes before it; a quote opens a value only behind "=".
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]*)|(["'])([^\s>]*)))?""")
TAIL = re.compile(r"[\s/]*>")
#: A whole tag whose quotes are where they should be, which most are; nothing here is tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'<>=]++|=\s*+(?:"[^"<]*+"|'[^'<]*+')?+)*+)>""")
#: Attributes that matter.
TELLING = re.compile("class|id|role|hidden|style", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
DROPPED = set("nav footer aside head svg button select option dialog canvas object audio video map menu fieldset".split())
MAIN = {"article", "main"}
BARRIERS = {"ul", "ol", "dl", "table", "div", "section", "article"}
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "option"}
#: Roles that say what a container is.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words in a class or id that say what a container is: by its place on the page, and by what it holds.
LAYOUT = set("nav navbar navigation menu menubar submenu sidebar aside footer foot header masthead topbar breadcrumb breadcrumbs pagination pager toolbar search modal overlay dialog popup skip login signup".split())
HELD = set("cookie cookies consent gdpr notice notices notification alert banner ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations newsletter subscribe subscription teaser".split())
CUES = LAYOUT | HELD
#: Those of them that tell beside any other word, if the container also has a control, such as a button or a field.
SURE = set("cookie cookies consent gdpr newsletter disqus comments commentlist advert adverts adsense sponsored".split())
HEADINGS = {"h2", "h3", "h4", "h5", "h6"}
CONTROLS = {"button", "input", "select", "textarea", "form"}
#: First words of the link under a reader's comment, in the languages of STOP_WORDS.
REPLY = {"reply", "antworten", "répondre", "responder"}
#: What a form says of itself: like a name of layout, for some pages stand in one form as a whole.
FORM = "<form>"
#: Words that go with them and say nothing themselves.
PLAIN = set("site page main top bottom left right upper lower global local primary secondary first last list lists box boxes area section sections wrapper wrap container holder block blocks content contents widget widgets inner outer bar bars item items link links button buttons module panel slot unit form forms row col column group groups post posts article articles blog thread threads level text title message messages icon icons fixed sticky mobile desktop js the user reader readers and or of in on entry more bottombar media posts story stories web default small large wide inline new".split())
#: On the main region itself and inside it, a header is the article's own.
OWN_HEADER = {"header"}
#: Frequent words of the languages of the tables; fixed values.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as by be at are from this or an which not have but his they he she we you had has their were been".split(),
    "de": "der die das und in zu den von mit ist im für auf nicht ein eine dem des sich als auch es an er so dass aus bei nach wie wird sind".split(),
    "fr": "de la le et les des en un une du que qui dans est pour par sur au pas plus ce il avec ne se sont aux ou son mais".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha este es".split(),
}
STOP = {k: frozenset(v) for k, v in STOP_WORDS.items()}
ANY_STOP = frozenset().union(*STOP.values())
WORD = re.compile(r"[^\W\d_]+")
WIDE = re.compile(r"[\u1100-\u11FF\u2E80-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\U00020000-\U0003FFFF]")
SENTENCE = re.compile(r"[.!?\u2026\u3002\uFF01\uFF1F\u061F\u06D4\u0964][\"'\u201D\u2019\u00BB)\]\u300D\u300F]*$")
GOOD, BAD, OPEN = 1, -1, 0
SHORT, LONG, LINKS, DENSE = 70, 200, 0.5, 0.15
#: Least share of a language's stop words for a page to be in it, and least share of the page's dense text that frees a layout container.
KNOWN, MOST = 0.2, 0.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    __slots__ = ("parts", "links", "main", "dropped", "cue", "text", "words", "label", "reply", "head")

    def __init__(self, main: bool, dropped: bool, cue: int):
        self.parts: list[str] = []
        self.links, self.main, self.dropped, self.cue, self.text, self.words, self.label = 0, main, dropped, cue, "", [], OPEN
        self.reply = self.head = False


class Element:
    """What is inside an open element: where its blocks begin, whether it has a control or a reply link, and its children with such links."""

    __slots__ = ("start", "kind", "cue", "block", "parts", "reply", "control", "kids")

    def __init__(self, start: int, kind: tuple[str, str], cue: int, block: Block):
        self.start, self.kind, self.cue, self.block, self.parts = start, kind, cue, block, len(block.parts)
        self.reply = self.control = False
        self.kids: list[tuple[tuple[str, str], int, int]] = []


def named(value: str) -> tuple[set[str], bool]:
    """The cues among the names of a class or id, and whether a name has a sure one beside other words."""
    out: set[str] = set()
    sure = False
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        found = CUES.intersection(words)
        if found and all(w in CUES or w in PLAIN for w in words):
            out |= found
        elif not SURE.isdisjoint(words):
            sure = True
    return out, sure


@lru_cache(4096)
def _told(class_: str, id_: str, role: str, style: str, hidden: bool, aria: str) -> tuple[bool, frozenset[str], frozenset[str], bool, str]:
    """(is it hidden, cues of its names, roles, has it a sure cue beside other words, its first class)."""
    cues, sure = named(f"{class_} {id_}")
    return hidden or aria.lower() == "true" or HIDDEN.search(style) is not None, frozenset(cues), frozenset(role.lower().split()), sure, next(iter(class_.split()), "")


NOTHING = (False, frozenset(), frozenset(), False, "")


def _says(found: dict[str, str]) -> tuple[bool, frozenset[str], frozenset[str], bool, str]:
    get = found.get
    return _told(get("class", ""), get("id", ""), get("role", ""), get("style", ""), "hidden" in found, get("aria-hidden", ""))


def _attributes(page: str, at: int, last_quote: int) -> tuple[dict[str, str], int]:
    """A tag's attributes from behind its name, and where the tag ends."""
    found: dict[str, str] = {}
    while True:
        end = TAIL.match(page, at)
        if end:
            return found, end.end()
        m = ATTRIBUTE.match(page, at)
        if m is None or m.end() == at:
            return found, len(page)
        if m[5] and m.end() <= last_quote and (close := page.find(m[5], m.start(6))) >= 0:
            value, at = page[m.start(6) : close], close + 1
        else:
            value, at = next((x for x in (m[2], m[3], m[4], m[6]) if x is not None), ""), m.end()
        found.setdefault(m[1].lower(), value)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    # open elements: name, dropped, main, link, place of the first dropped one, cue container; each includes what stands above
    stack: list[tuple[str, bool, bool, bool, int, int]] = []
    open_at: dict[str, list[int]] = {}  # places of open elements by name
    block_at: list[int] = []
    barrier_at: list[int] = []
    dropped = main = link = False
    first_dropped, cue, cues = -1, 0, 0
    soft: dict[int, bool] = {0: False}  # cue container -> its words are of layout alone
    doubted: dict[int, int] = {}  # container with a sure cue beside other words, of which no control is known -> the cue container around it
    inside: list[Element] = []
    lists: list[tuple[int, int, list[tuple[int, int]]]] = []  # containers of comments: their blocks, and those of the comments
    now = Block(main, dropped, cue)
    last_end, last_quote = page.rfind(">"), max(page.rfind('"'), page.rfind("'"))

    def flush() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(main, dropped, cue)

    def say(text: str) -> None:
        if text:
            now.parts.append(text)
            if link:
                now.links += len(text.strip())

    def leave(name: str) -> None:
        e = inside.pop()
        if name in ("a", "button") and e.block is now:
            said = "".join(now.parts[e.parts :]).lower().split()
            e.reply = e.reply or (0 < len(said) <= 3 and said[0] in REPLY)
        if e.control or name in CONTROLS:
            doubted.pop(e.cue, None) if e.cue else None
        if len(e.kids) > 1 and name in BLOCK:
            kinds = Counter(kind for kind, _, _ in e.kids)
            comments = [(i, j) for kind, i, j in e.kids if kinds[kind] > 1]
            if comments:
                lists.append((e.start, len(out), comments))
        if inside:
            up = inside[-1]
            up.control = up.control or e.control or name in CONTROLS
            up.reply = up.reply or e.reply
            if e.reply and name in BLOCK:
                up.kids.append((e.kind, e.start, len(out)))
            elif e.kids and name not in BLOCK:
                # a part of a line stands for what it holds
                most, least = (up.kids, e.kids) if len(up.kids) > len(e.kids) else (e.kids, up.kids)
                most += least
                up.kids = most

    def close(k: int) -> None:
        nonlocal dropped, main, link, first_dropped, cue
        for x in reversed(stack[k:]):
            open_at[x[0]].pop()
            leave(x[0])
        while block_at and block_at[-1] >= k:
            block_at.pop()
        while barrier_at and barrier_at[-1] >= k:
            barrier_at.pop()
        del stack[k:]
        _, dropped, main, link, first_dropped, cue = stack[-1] if stack else ("", False, False, False, -1, 0)

    at = 0
    while at < len(page):
        k = page.find("<", at)
        if k < 0 or k > last_end:  # no tag can end any more
            break
        nxt = page[k + 1 : k + 2]
        if nxt in ("!", "?"):
            say(page[at:k])
            if page.startswith("<!--", k):
                end = page.find("-->", k + 2)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", k):
                end = page.find("]]>", k)
                at = end + 3 if end >= 0 else len(page)
            else:
                at = page.find(">", k) + 1
            continue
        m = TAG.match(page, k)
        said = NOTHING
        if m is not None:
            say(page[at:k])
            name, at = m[2].lower(), m.end()
            if m[3] and TELLING.search(m[3]):
                said = _says(_attributes(page, m.start(3), last_quote)[0])
        else:
            m = OPENED.match(page, k)
            if m is None:
                say(page[at : k + 1])
                at = k + 1
                continue
            say(page[at:k])
            name = m[0].lstrip("</").lower()
            attributes, at = _attributes(page, m.end(), last_quote)
            said = _says(attributes)
        if nxt == "/":
            places = open_at.get(name)
            k = places[-1] if places else None
            if name in BLOCK or (k is not None and block_at and block_at[-1] >= k):
                flush()
            if k is not None and (name in BLOCK or not (block_at and block_at[-1] > k)):
                close(k)
                if name in BLOCK:
                    now = Block(main, dropped, cue)
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            if name in CONTROLS and inside:
                inside[-1].control = True
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                say(" ")
            elif name in CONTROLS and inside:
                inside[-1].control = True
            continue
        if name in BLOCK:
            flush()
            # a paragraph ends at any block; list items and rows end at the next of their kind
            k = max((open_at[x][-1] for x in {"p", name} & SELF_ENDING if open_at.get(x)), default=None)
            if k is not None and not (barrier_at and barrier_at[-1] > k):
                close(k)
            if name in MAIN and dropped and not main and stack[first_dropped][0] not in ("form", "head", "dialog"):
                # an article doesn't belong to a menu or advert that was never closed
                close(first_dropped)
        elif name in ("td", "th"):
            say(" ")
        hidden, words, role, sure, kind = said
        whole = name in ("html", "body")
        own = frozenset() if whole or not words else words - LAYOUT if name in MAIN else words - OWN_HEADER if main else words
        if name == "form" or "form" in role:
            own = own | {FORM}
        drop = dropped or hidden or name in DROPPED or (name == "header" and not main) or (not whole and not ROLES.isdisjoint(role))
        in_cue = cue
        if own and not drop and (not cue or soft[cue]):
            cues += 1
            in_cue = cues
            soft[cues] = own <= LAYOUT | {FORM}
        elif sure and not own and not drop and not whole and name in BLOCK and name not in MAIN and (not cue or soft[cue]):
            cues += 1
            in_cue = cues
            soft[cues], doubted[cues] = True, cue
        is_main = main or ((name in MAIN or "main" in role) and not drop and not (in_cue and not soft[in_cue]))
        if name not in BLOCK and page[at - 2 : at] == "/>":
            continue
        if is_main and not main and in_cue and soft[in_cue]:
            in_cue = 0  # the main region inside a layout container is the page's own word against it
        place = len(stack)
        stack.append((name, drop, is_main, link or name == "a", first_dropped if dropped else place if drop else -1, in_cue))
        open_at.setdefault(name, []).append(place)
        if name in BLOCK:
            block_at.append(place)
        if name in BARRIERS:
            barrier_at.append(place)
        _, dropped, main, link, first_dropped, cue = stack[-1]
        if name in BLOCK:
            now = Block(main, dropped, cue)
            now.head = name in HEADINGS
        elif not now.parts:
            now.dropped, now.main, now.cue = dropped, main, cue
        elif dropped != now.dropped or cue != now.cue:
            flush()
        inside.append(Element(len(out), (name, kind), in_cue if in_cue in doubted else 0, now))
    say(page[at:])
    flush()
    close(0)
    for b in out:
        text = "".join(b.parts)
        b.text = " ".join((html.unescape(text) if "&" in text else text).split())
    for k in doubted:  # ascending, and what is around a container comes before it
        doubted[k] = doubted.get(doubted[k], doubted[k])
    long = [0, *accumulate(len(b.text) >= SHORT for b in out)]
    change = [0] * (len(out) + 1)
    for i, j, comments in lists:
        # what goes with the comments in their container goes too, if that is no text
        for x, y in [(i, j)] if sum(long[y] - long[x] for x, y in comments) == long[j] - long[i] else comments:
            change[x] += 1
            change[y] -= 1
    for b, n in zip(out, accumulate(change), strict=False):
        b.cue, b.reply = doubted.get(b.cue, b.cue), n > 0
    out = [b for b in out if b.text and not b.dropped]
    if any(b.main for b in out):
        out = [b for b in out if b.main]
    for b in out:
        b.words = WORD.findall(b.text.lower())
    language = language_of(out)
    for b in out:
        b.label = _first_pass(b, language)
    return _without_comments(_without_cues(out, soft))


def _without_comments(blocks: list[Block]) -> list[Block]:
    """Drop blocks of comments that follow a text of some length, and the heading right before them; of a page without such a text they are the text."""
    first = next((i for i, b in enumerate(blocks) if b.reply), len(blocks))
    if sum(len(b.text) for b in blocks[:first] if b.label == GOOD) < LONG:
        return blocks
    return [b for b, after in zip(blocks, [*blocks[1:], None], strict=True) if not (b.reply or (b.head and after is not None and after.reply))]


def _without_cues(blocks: list[Block], soft: dict[int, bool]) -> list[Block]:
    """Drop what cue containers hold, but for layout containers with most of the page's dense text."""
    dense: dict[int, int] = {}
    for b in blocks:
        if b.label == GOOD:
            dense[b.cue] = dense.get(b.cue, 0) + len(b.text)
    total = sum(n for k, n in dense.items() if not k or soft[k])
    return [b for b in blocks if not b.cue or (soft[b.cue] and dense.get(b.cue, 0) > MOST * total)]


def language_of(blocks: list[Block]) -> str | None:
    """The language of STOP_WORDS that the page's text outside of links is in, if any."""
    n, hits = 0, dict.fromkeys(STOP, 0)
    for b in blocks:
        if len(b.text) >= SHORT and 2 * b.links <= len(b.text):
            n += len(b.words)
            for k, some in STOP.items():
                hits[k] += sum(map(some.__contains__, b.words))
    best = max(hits, key=hits.get)
    return best if n and hits[best] >= KNOWN * n else None


def _first_pass(b: Block, language: str | None) -> int:
    n = len(b.text)
    density = b.links / n
    if density > LINKS:
        return BAD
    wide = len(WIDE.findall(b.text)) if not b.text.isascii() else 0
    n += 2 * wide  # an ideograph stands for about a word
    if n < SHORT:
        return BAD if density > 0.2 and not b.main else OPEN
    foreign = not b.text.isascii() and 2 * len(b.text.encode("latin-1", "ignore")) < len(b.text)
    if language is None or not b.words or foreign:
        if SENTENCE.search(b.text) or (n >= LONG and density <= 0.2):
            return GOOD
        return OPEN if b.main or n < LONG else BAD
    if sum(map(ANY_STOP.__contains__, b.words)) >= DENSE * len(b.words):
        return GOOD
    return GOOD if b.main and n >= LONG else OPEN if b.main or n < LONG else BAD


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    marked = any(b.main for b in blocks)
    label = [b.label for b in blocks]
    decided = [i for i, x in enumerate(label) if x != OPEN]
    out, k = [], 0
    for i, b in enumerate(blocks):
        if label[i] == OPEN:
            while k < len(decided) and decided[k] < i:
                k += 1
            left, right = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
            if left is None and right is None:
                good = marked
            elif left is None or right is None:
                good = label[left if right is None else right] == GOOD or marked
            elif marked:
                good = GOOD in (label[left], label[right])
            else:
                good = label[left if i - left < right - i else right] == GOOD
        else:
            good = label[i] == GOOD
        if good:
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """The input's columns and the main text of `column` under `name`."""
    ship(pages.sparkSession)

    def run(x: pa.Array) -> pa.Array:
        return pa.array([main_text(h) for h in x.to_pylist()], pa.string())

    return pages.withColumn(name, F.arrow_udf(run, T.StringType()).asNondeterministic()(F.col(column)))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return e.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
