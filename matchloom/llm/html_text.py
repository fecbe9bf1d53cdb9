"""HTML main text by two-pass block rules.

A page is read once, in linear time, for tags, comments and raw elements (script, style and the like, whose content is skipped).  Text
between block-level tags is a block.  Blocks inside menus, headers, footers, asides, forms, adverts, notices, comments and
the like (by element, role, class or id) are out; inline elements of that kind are out alone, up to their closing tag.  If a page marks its article
(``article``, ``main`` or that role), text outside of it is out as well.  An article in a container
that is out by class or id alone (``layout-with-sidebar``) is in, unless another one is in fewer of them.

The first pass judges the other blocks by themselves: many link characters: out; rich in stop words, or very long: in; else open.  In the second pass an open block
takes the label of its nearest decided neighbour within its own article, or page if none is marked; of two equally near ones the good one counts.  With no
decided neighbour it is in if it is in an article, or holds no link where none is marked.  Both passes and the reading are linear in the page: one sweep each way,
and a counter of the elements that are open.

Edge cases: null or empty html gives an empty text; unclosed elements end with their parent or with the page; a page of
plain text is one block; character references are decoded once, as HTML5 says; repeated rows and null ids are kept; pages of any length are
read whole; columns other than the three named are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Elements whose content isn't markup, or is no text of the page.
RAW = frozenset("script style noscript template iframe svg math textarea select object title".split())
_TAG = r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
_QUOTED = r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"
TAG = re.compile(rf"{_TAG}(?P<attrs>{_QUOTED})>|<[!?][^>]*+>")
#: Where quotes don't count.
LOOSE_TAG = re.compile(rf"{_TAG}(?P<attrs>[^>]*+)>|<[!?][^>]*+>")
OPEN = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Elements that end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
OUT = frozenset("nav aside footer form menu dialog button head label fieldset frameset search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments respond reply replies disqus widget widgets pagination pager toolbar skip copyright disclaimer paywall form search".split()
)
#: In an article these hold its own parts more often than not.
KEPT_IN_ARTICLE = frozenset(("header",))
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it its more no not of on one or our she so some than that the their them then there these they "
    "this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und "
    "uns unter vom von vor war was wenn wer wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del desde donde el ella en entre era es esta este fue ha han hasta la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya".split()
)
LONG = 140
SHORT = 40
STOP_SHARE = 0.2
LINK_SHARE = 0.5
PARENTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
WORD = re.compile(r"\w+")


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, name (lower case; none for comments, declarations and raw elements), whether it closes, and attributes of each tag.

    Linear in the page: past the last ``>`` no tag is looked for, and once a tag doesn't end outside of quotes it ends at the next
    ``>``, and quotes are ordinary characters from there on.
    """
    last, at, pattern = page.rfind(">") + 1, 0, TAG
    while opened := OPEN.search(page, at):
        start = at = opened.start()
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            at = len(page) if at < 0 else at + 3
            yield start, at, None, False, ""
            continue
        m = pattern.match(page, at, last) if at < last else None
        if m is None and at < last and pattern is TAG:
            pattern = LOOSE_TAG
            m = pattern.match(page, at, last)
        if m is None:
            at += 1
            continue
        at, name = m.end(), m["name"] and m["name"].lower()
        if name in RAW and not m["close"] and not (name in ("svg", "math") and m["attrs"].endswith("/")):
            stop = RAW_END[name].search(page, at)
            at, name = stop.end() if stop else len(page), None
        yield start, at, name, bool(m["close"]), m["attrs"] or ""


class Block:
    __slots__ = ("article", "depth", "heading", "label", "links", "out", "parts")

    def __init__(self, out: bool, article: int, depth: int, heading: bool):
        self.out, self.article, self.depth, self.heading = out, article, depth, heading
        self.parts: list[str] = []
        self.links = 0
        self.label = None


def words_of(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    names: set[str] = set()
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names.update(re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return names, role, hidden


def blocks(page: str) -> list[Block]:
    """The page's blocks with what contains them."""
    found: list[Block] = []
    # name, whether it is inline, elements around that are out by themselves and by class or id (since the article began), number of the article around
    stack: list[tuple[str, bool, int, int, int]] = [("", False, 0, 0, 0)]
    # of each article: containers that are out by class or id
    depths = [0]
    # beside the stack: how often each name is on it, and by place the nearest element up from there that isn't inline, so that nothing has to be searched for in vain
    standing: Counter[str] = Counter()
    base = [0]
    block: Block | None = None
    links = articles = at = 0

    def push(entry: tuple[str, bool, int, int, int]) -> None:
        base.append(base[-1] if entry[1] else len(stack))
        stack.append(entry)
        standing[entry[0]] += 1

    def pop(to: int) -> None:
        while len(stack) > to:
            standing[stack.pop()[0]] -= 1
            base.pop()

    def place(name: str) -> int:
        """The topmost element of this name; 0 if there is none."""
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name) if standing[name] else 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece or (block is None and not piece.strip()):
            return
        _, inline, hard, soft, article = stack[-1]
        if inline:
            marks = hard + soft
            _, _, hard, soft, article = stack[base[-1]]
            if marks and not hard + soft:
                return
        if block is None:
            block = Block(hard + soft > 0, article, depths[article], any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-4:]))
            found.append(block)
        block.parts.append(piece)
        if links:
            block.links += len(piece.strip())

    for start, stop, name, closes, attributes in tokens(page):
        text(page[at:start])
        at = stop
        if name is None:
            continue
        if name == "a":
            links = 0 if closes else 1
            continue
        if name == "br":
            text(" ")
            continue
        inline = name not in BLOCK and name not in OUT
        if inline:
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            # of inline elements only marked ones are on the stack, and those of the same name in them
            at_name = place(name)
            if closes:
                if at_name:
                    _, _, hard, soft, article = stack[at_name]
                    hard, soft = hard - stack[at_name - 1][2], soft - stack[at_name - 1][3] if article == stack[at_name - 1][4] else 0
                    above = stack[at_name + 1 :]
                    if any(not x[1] for x in above):
                        # closed within a block that began in it
                        block = None
                    pop(at_name)
                    for n, i, h, s, a in above:
                        push((n, i, h - hard, s - soft if a == article else s, a))
                continue
            if not at_name:
                if not attributes:
                    continue
                names, role, hidden = words_of(attributes)
                if not (hidden or role in OUT_ROLES or names & OUT_WORDS):
                    continue
        block, links = (None, 0) if name in BLOCK or name in OUT else (block, links)
        if closes:
            if to := place(name):
                pop(to)
            continue
        if name in VOID:
            continue
        if len(stack) > 1 and not inline:
            i = base[-1]
            while i > 0:
                if stack[i][0] == "p" and name in BLOCK:
                    pop(i)
                    break
                if stack[i][0] in CLOSES.get(name, ()):
                    pop(i)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[i][0] not in ("td", "th", "tr", "p") or stack[i][0] in PARENTS.get(name, ()):
                    break
                i = base[i - 1]
        _, _, hard, soft, article = stack[-1]
        names, role, hidden = words_of(attributes) if attributes else (set(), "", False)
        own_article = name in ("article", "main") or role in ("article", "main")
        if article:
            names -= KEPT_IN_ARTICLE
        hard += hidden or name in OUT or role in OUT_ROLES or (name == "header" and not article)
        soft += bool(names & OUT_WORDS) and not own_article and name not in ("body", "html")
        if own_article and not hard and not article:
            articles += 1
            article = articles
            depths.append(soft)
            soft = 0
        push((name, inline, hard, soft, article))
    text(page[at:] if page[at:].find("<") < 0 else re.sub(r"<[^>]*\Z", "", page[at:]))
    return found


def clean(block: Block) -> str:
    return " ".join(html.unescape("".join(block.parts)).split())


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = [(b, t) for b in blocks(page or "") if (t := clean(b))]
    inside = [b.depth for b, _ in found if b.article and not b.out]
    marked = bool(inside)
    least = min(inside, default=0)
    for b, _ in found:
        b.out = b.out or bool(b.article and marked and b.depth > least)
    # first pass: each block by itself
    for b, t in found:
        if b.out or (marked and not b.article):
            b.label = False
        elif b.links / len(t) > LINK_SHARE and not b.heading:
            b.label = False
        else:
            seen = WORD.findall(t.lower())
            stops = sum(w in STOP_WORDS for w in seen) / max(1, len(seen))
            if SHORT <= len(t) and stops >= STOP_SHARE or len(t) >= 4 * LONG:
                b.label = True
    # second pass: open blocks by the nearest decided ones around them, of the same article where articles are marked; of two equally near ones by the good one
    near: list[list[tuple[int, bool, bool]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            b = found[i][0]
            key = b.article if marked else 0
            if b.label is None:
                if key in last:
                    near[i].append((abs(last[key][0] - i), not last[key][1], last[key][1]))
            elif not (marked and b.out):
                last[key] = i, b.label
    for (b, _), sides in zip(found, near, strict=True):
        if b.label is None:
            b.label = min(sides)[2] if sides else bool(b.article) if marked else not b.links
    return "\n".join(t for b, t in found if b.label)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").transform(mapped, run, SCHEMA)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .common import table

    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
