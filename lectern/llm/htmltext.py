"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of blocks: runs of text between block-level tags. Inline tags stay inside a block,
a line break is white space, and nothing of scripts, styles, form controls and the page head becomes a block. A
small linear classifier over tags, class and id words, length, link share and punctuation gives each block
the log odds of being content. These are the capacities of its edges to the two terminals: a content block
costs its odds to label as boilerplate, and the other way round. Smoothness edges tie each block to the next
(stronger the closer they stand in the document tree) and to the next block under the same parent. The
minimum cut, found by augmenting paths, separates content from boilerplate at least cost.

Class and id words, roles and forms enter as costs. A name whose last word tells of boilerplate (``site-footer``,
``ad-slot``) costs much, one that only holds such a word (``legal-news``) little. An element of the first kind that
turns out to wrap the page (it holds ``main``, the only article, or most of the text with the only top heading; a form:
most of the text) costs nothing. Neither does ``main`` or the page's only article for its own name, nor, where no other
prose is left on the page, an element whose name can also be that of an article (``notice``, ``legal``). Readers' comments
are found by their structure besides: elements of one kind side by side after the first prose, short, without headings and
each with an author and a date, or within something named a discussion. Only menus, footers, sidebars and dialogs by their tags, page headers and what is
hidden have a capacity that no sum of smoothness edges reaches.

Defined results: null or empty html gives an empty text of 0 characters; a page without an accepted block
likewise; stray, unclosed and nested tags are read as a browser would close them, as far as blocks go, and an
element whose text would be dropped is read through if it is never closed; repeated rows are extracted one by
one; an empty table gives an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math textarea select option button title head audio video canvas noframes map".split())
OPAQUE = set("script style textarea title iframe noframes".split())
#: What may stand in a page's head; any other opened tag ends it.
IN_HEAD = set("html head title meta link script style base basefont bgsound noscript noframes template".split())
BOILER = set("nav footer aside menu dialog".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": set(), "tbody": {"thead", "tbody", "tr", "td", "th"}}
LIST_ROOTS = set("ul ol dl table".split())
#: What a button or a list of options cannot hold; a tag of these ends it.
SHORT = set("select option button".split())
HARD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets comment comments reply replies respond disqus cookie cookies consent gdpr notice notices notification "
    "alert disclaimer share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar masthead topbar "
    "skip search copyright legal paywall teaser teasers".split()
)
#: Words that say nothing of the kind of an element.
PLAIN_WORDS = set(
    "wrap wrapper container outer inner area box block slot list item items section group left right top bottom primary secondary col column row grid bar panel button buttons "
    "link links icon icons unit holder zone region module media form field id js the of and".split()
)
#: With these before them, words for texts mean the texts of other pages.
OTHERS = set("related recommended sponsored promoted".split())
TEXTS = set("posts articles stories links content items news reading videos entries".split())
#: Words that make a class tell of the page around, as in ``with-sidebar``.
AROUND = set("has with no without layout columns open closed".split())
#: Names that tell of boilerplate beside an article, but may also be the name of one.
MAY_HOLD = set("notice notices notification alert disclaimer legal search teaser teasers widget widgets social related recommended share sharing paywall sidebar aside".split())
#: Names of what readers write, of what may be that, and of entries that an author dates.
READERS = set("comment comments reply replies respond disqus".split())
TALKS = set("discussion discussions responses feedback userposts thread threads".split())
ENTRIES = set("live update updates timeline liveblog".split())
AUTHOR_WORDS = set("author user username byline commenter avatar nick nickname vcard poster member".split())
DATE_WORDS = set("date time timestamp when posted ago datetime published".split())
#: A comment: how far above its author or date it begins at most, and how many characters comments have on average at most.
SIGNED_UPWARDS, COMMENT_CHARS = 4, 1500
HARD_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_WORDS = set("article content main post entry story body text maincontent articlebody postbody entrycontent".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
MARKS = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SIGNS = re.compile(r"\b(class|itemprop|rel)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

CERTAIN = 1000.0
MUCH, LITTLE, GOOD = -8.0, -1.0, 4.5
NEAR, FAR, SIBLING = 1.2, 0.35, 0.5
#: How far up an element is looked for that a tag closes.
UPWARDS = 64


def words_in(name: str) -> list[str]:
    """The words of a class or id; ``commentlist`` and its like count as ``comments``."""
    words = [w.lower() for w in PIECES.findall(name)]
    return ["comments" if w.startswith("comment") and not w.startswith("commenta") and not w.startswith("commentin") else w for w in words]


def name_kind(name: str) -> str:
    """What a class or id says: ``boiler``, ``perhaps`` (holds a word of boilerplate), ``header``, ``good`` or nothing."""
    words = words_in(name)
    if not words or AROUND.intersection(words):
        return ""
    telling = [w for w in words if w not in PLAIN_WORDS]
    hard = HARD_WORDS.intersection(telling)
    if hard:
        # a container of several kinds, as in content-sidebar-wrap, is none of them
        mixed = len(telling) < len(words) and len(hard) < len(telling) and words[-1] in PLAIN_WORDS
        of_others = len(telling) > 1 and telling[0] in OTHERS and telling[-1] in TEXTS
        return "boiler" if (telling[-1] in HARD_WORDS and not mixed) or of_others or len(hard) == len(telling) else "perhaps"
    if telling and telling[-1] == "header":
        return "header"
    return "good" if GOOD_WORDS.intersection(words) else ""


class Element:
    """An element with what its own tag and attributes say; ``state`` adds what the elements around it say."""

    __slots__ = ("tag", "parent", "depth", "certain", "boiler", "perhaps", "header", "good", "wraps", "known", "n_chars", "holder", "sealed", "name", "signed")

    def __init__(self, tag: str, parent: Element | None, marks: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.certain = tag in BOILER
        self.boiler = tag == "form"
        self.header = tag == "header"
        self.good = tag in ("article", "main")
        self.perhaps = self.wraps = False
        self.known = None
        self.n_chars = 0
        self.name: tuple[str, ...] = ()
        #: Bit 1: an author stands in it, bit 2: a date.
        self.signed = 0
        if marks and tag not in ("html", "body"):
            self._read(marks)
        #: The nearest element, from itself on, that looks like boilerplate, and whether one around it is so for certain.
        self.holder = self if self.boiler else parent.holder if parent else None
        self.sealed = self.certain or bool(parent and parent.sealed)

    def holders(self) -> Iterator[Element]:
        node = self.holder
        for _ in range(UPWARDS):
            if node is None:
                return
            yield node
            node = node.parent.holder if node.parent else None

    def _read(self, marks: str) -> None:
        for name, value in MARKS.findall(marks):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                self.name += tuple(words_in(value))
                kinds = {name_kind(part) for part in value.split()}
                self.boiler = self.boiler or "boiler" in kinds
                self.perhaps = self.perhaps or "perhaps" in kinds
                self.header = self.header or "header" in kinds
                self.good = self.good or "good" in kinds
            elif name == "role":
                self.boiler = self.boiler or value.lower() in HARD_ROLES
                self.good = self.good or value.lower() in ("main", "article")
            elif name == "itemprop":
                self.good = self.good or value.lower() == "articlebody"
            elif name == "hidden" and "until" not in value or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                self.certain = True

    def state(self) -> tuple[bool, float, bool]:
        """(certainly boilerplate, cost, inside something good)."""
        chain, node = [], self
        while node is not None and node.known is None:
            chain.append(node)
            node = node.parent
        certain, cost, good = node.known if node is not None else (False, 0.0, False)
        for node in reversed(chain):
            if node.certain or node.header and not good and not node.wraps:
                certain = True
            elif node.boiler and not node.wraps:
                cost, good = MUCH, False
            elif cost > MUCH:
                if node.good:
                    good, cost = True, 0.0
                elif node.perhaps:
                    cost = LITTLE
            node.known = (certain, cost, good)
        return certain, cost, good


def signs(tag: str, marks: str) -> int:
    """Whether an element tells an author (1), a date (2), both or nothing."""
    found = 2 if tag == "time" else 0
    if marks:
        for name, value in SIGNS.findall(marks):
            words = AUTHOR_WORDS | DATE_WORDS if name.lower() != "rel" else {"author"}
            words = words.intersection(w.lower() for w in PIECES.findall(value))
            found |= (1 if words & AUTHOR_WORDS else 0) | (2 if words & DATE_WORDS else 0)
    return found


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with its innermost block-level element, whose wrappers are marked."""
    heads: list[Element] = []
    units: dict[Element, None] = {}  # elements that hold an author or a date, or lie side by side in a discussion
    top = Element("", None, "")
    pieces: list[str] = []
    blocks: list[Block] = []
    in_link, linked = 0, 0
    muted: list[str] = []  # open elements whose text is dropped
    end = 0
    page_length = len(page)
    lower = page.lower() if len(page.lower()) == page_length else page
    last_end: dict[str, int] = {}  # of each dropped kind of element, where its last closing tag stands
    opened: Counter[str] = Counter()  # open elements by tag

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, top, linked))
            pieces.clear()
            linked = 0

    # no tag ends after the last ">", and only up to it a search for one cannot fail from every "<" anew
    last = page.rfind(">") + 1
    skip_to = 0
    for match in TAG.finditer(page, 0, last):
        start = match.start()
        if start < skip_to:
            continue
        if not muted and start > end:
            part = page[max(end, skip_to) : start]
            pieces.append(part)
            if in_link:
                linked += len(part)
        end = match.end()
        if end == last and match.group().startswith(("<!--", "<![CDATA[")) and not match.group().endswith(("-->", "]]>")):
            end = skip_to = page_length
            break
        closing, tag, marks = match.group(1), match.group(2), match.group(3)
        if tag is None:
            closing, tag, marks = match.group(4), match.group(5), match.group(6)
            if tag is None:
                continue
        tag = tag.lower()
        if muted == ["head"] and not closing and tag not in IN_HEAD:
            muted.clear()
        while muted and muted[-1] in SHORT and tag not in SHORT and tag not in INLINE and tag not in VOID:
            muted.pop()
        if tag in RAW:
            if closing:
                if tag in muted:
                    while muted.pop() != tag:
                        pass
                if tag == "button" and not muted:
                    flush()
                continue
            if marks.endswith("/") and tag in ("svg", "iframe", "object"):
                continue
            flush()
            if tag in OPAQUE:
                close = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, end)
                end = skip_to = close.end() if close else page_length
                continue
            if tag != "head" and tag not in last_end:
                last_end[tag] = lower.rfind(f"</{tag}")
            if tag == "head" or tag in SHORT or last_end[tag] >= end:
                muted.append(tag)
            continue
        if tag == "body" and "head" in muted:
            muted.clear()
        if muted:
            continue
        sign = 0 if closing else signs(tag, marks)
        if tag in INLINE:
            sign_upwards(top, sign, units)
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while top.tag != tag:
                    opened[top.tag] -= 1
                    top = top.parent
                opened[tag] -= 1
                top = top.parent
                in_link = 0
            continue
        if top.tag == "p":
            opened["p"] -= 1
            top = top.parent
        closes = CLOSED_BY_SAME.get(tag)
        if closes and any(opened[t] for t in closes):
            node, goal = top, None
            for _ in range(UPWARDS):
                if node.parent is None or node.tag in LIST_ROOTS:
                    break
                if node.tag in closes:
                    goal = node.parent
                node = node.parent
            while goal is not None and top is not goal:
                opened[top.tag] -= 1
                top = top.parent
        top = Element(tag, top, marks)
        opened[tag] += 1
        sign_upwards(top, sign, units)
        if in_talk(top):
            units[top] = None
        if tag in ("main", "article", "h1"):
            heads.append(top)
    if not muted and end < page_length:
        pieces.append(page[max(end, skip_to) :].split("<!--")[0])
    flush()
    mark_comments(blocks, units)
    mark_wrappers(blocks, heads)
    return blocks


def sign_upwards(element: Element, sign: int, units: dict[Element, None]) -> None:
    """Notes an author or a date at the elements that may be the comment it belongs to."""
    for _ in range(SIGNED_UPWARDS if sign else 0):
        if element.parent is None or element.signed | sign == element.signed:
            return
        element.signed |= sign
        units[element] = None
        element = element.parent


def in_talk(element: Element) -> bool:
    """Whether it may be one of the contributions to something named a discussion, also one list deeper."""
    around = element.parent
    if around is not None and around.tag in LIST_ROOTS and not TALKS.intersection(around.name):
        around = around.parent
    return element.tag in ("li", "div", "article", "section", "dd") and around is not None and named_talk(around)


def named_talk(element: Element) -> bool:
    return bool(TALKS.intersection(element.name)) or {"user", "posts"} <= set(element.name)


def is_prose(block: Block) -> bool:
    return len(block.text) >= 40 and block.text[-1] in ".!?\"'”»…" and 2 * block.linked < len(block.text) and block.element.tag not in HEADINGS


def mark_comments(blocks: list[Block], units: dict[Element, None]) -> None:
    """Finds readers' comments by their structure and marks them, and what holds nothing else, as boilerplate."""
    groups: dict[tuple[int, str, str], list[Element]] = {}
    for unit in units:
        if unit.parent is not None and not ENTRIES.intersection(unit.name) and not ENTRIES.intersection(unit.parent.name):
            groups.setdefault((id(unit.parent), unit.tag, unit.name[0] if unit.name else ""), []).append(unit)
    groups = {k: g for k, g in groups.items() if all(in_talk(u) for u in g) and (len(g) > 1 or g[0].signed) or len(g) > 1 and all(u.signed == 3 for u in g)}
    if not groups:
        return
    of_unit = {unit: key for key, group in groups.items() for unit in group}
    chars, bad, first = Counter(), set(), {}
    first_prose = len(blocks)
    held: list[tuple[Block, tuple | None]] = []
    for i, block in enumerate(blocks):
        node, key = block.element, None
        for _ in range(UPWARDS):
            if node is None:
                break
            if node in of_unit:
                key = of_unit[node]  # the outermost counts
                chars[key] += len(block.text)
                first.setdefault(key, i)
                if block.element.tag in ("h1", "h2", "h3"):
                    bad.add(key)
            node = node.parent
        held.append((block, key))
        if key is None and first_prose == len(blocks) and is_prose(block) and not block.element.sealed and block.element.holder is None:
            first_prose = i
    marked = set()
    for key, group in groups.items():
        if key not in bad and first.get(key, -1) > first_prose and chars[key] <= COMMENT_CHARS * len(group):
            marked.add(key)
            for unit in group:
                unit.boiler = True
    around = {group[0].parent for key, group in groups.items() if key in marked}
    around |= {p.parent for p in around if p.tag in LIST_ROOTS and p.parent is not None and named_talk(p.parent)}
    around = {p for p in around if p.tag not in ("", "html", "body", "main", "article")}
    for block, key in held:
        if key not in marked and (is_prose(block) or block.element.tag in ("h1", "h2")):
            node = block.element
            for _ in range(UPWARDS):
                if node is None:
                    break
                around.discard(node)
                node = node.parent
    for parent in around:
        parent.boiler = True


def mark_wrappers(blocks: list[Block], heads: list[Element]) -> None:
    """Finds the elements that look like boilerplate but hold the page: ``heads`` are its main, article and h1 elements."""
    mains = [h for h in heads if h.tag == "main"]
    articles = [h for h in heads if h.tag == "article" and not h.sealed]
    plain = [h for h in articles if not h.boiler]
    titles = [h for h in heads if h.tag == "h1"]
    total = 0
    for block in blocks:
        if not block.element.sealed:
            total += len(block.text)
            for holder in block.element.holders():
                holder.n_chars += len(block.text)
    if plain or len(articles) != 1 or READERS.intersection(articles[0].name) or 2 * articles[0].n_chars <= total:
        articles = plain
    above, title_above = set(), set()
    for found, heads in ((above, mains or (articles if len(articles) == 1 else [])), (title_above, titles if len(titles) == 1 else [])):
        for head in heads:
            node = head.parent
            while node is not None and node not in found:
                found.add(node)
                node = node.parent
    for node in (*above, *mains, *(articles if len(articles) == 1 else [])):
        node.wraps = True
    for block in blocks:
        for node in block.element.holders():
            if 2 * node.n_chars > total and (node in title_above or node.tag == "form"):
                node.wraps = True


def odds(block: Block) -> float:
    """Log odds that a block is content; -CERTAIN where the kind of its element decides."""
    element = block.element
    certain, cost, good = element.state()
    if certain:
        return -CERTAIN
    n = len(block.text)
    link_share = min(1.0, block.linked / n)
    words = block.text.count(" ") + 1
    score = cost - 1.0 + min(2.5, n / 80) - 4.0 * link_share * (words < 40)
    if block.text[-1] in ".!?:;\"'”»…)":
        score += 0.8
    if good:
        score += GOOD
    if element.tag in HEADINGS:
        score += 1.8 if element.tag == "h1" else 1.0
    elif element.tag in ("p", "blockquote", "pre"):
        score += 0.8
    elif element.tag == "li" and not good:
        score -= 0.8
    if block.text[0] == "©" or block.text.startswith("Copyright"):
        score -= 6.0
    return score


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the content side of a minimum cut.

    ``gains``: log odds, the difference of the two terminal capacities. What a block could send straight
    from one terminal to the other is left out, as it does not change the cut. Each block with capacity left
    from the source searches the nearest one with capacity left to the sink. Where it reaches none, no later
    path can lead from what it reached to the sink, so all that is content and is not searched again.
    """
    n = len(gains)
    left = list(gains)  # above 0: from the source; below: to the sink
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        near[a][b] = near[a].get(b, 0.0) + capacity
        near[b][a] = near[b].get(a, 0.0) + capacity
    tiny = 1e-9
    content = [False] * n
    for source in range(n):
        while left[source] > tiny and not content[source]:
            came, queue, goal = {source: source}, deque([source]), None
            while queue and goal is None:
                a = queue.popleft()
                for b, capacity in near[a].items():
                    if capacity > tiny and b not in came and not content[b]:
                        came[b] = a
                        if left[b] < -tiny:
                            goal = b
                            break
                        queue.append(b)
            if goal is None:
                for a in came:
                    content[a] = True
                break
            path = [goal]
            while path[-1] != source:
                path.append(came[path[-1]])
            flow = min(left[source], -left[goal], *(near[b][a] for a, b in zip(path, path[1:], strict=False)))
            left[source] -= flow
            left[goal] += flow
            for a, b in zip(path, path[1:], strict=False):
                near[b][a] -= flow
                near[a][b] += flow
    return content


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def wrap_by_name(blocks: list[Block]) -> bool:
    """Where no prose is left: reads the elements through that hold the most of it, two paragraphs at least, and may be articles by name."""
    prose, n_chars = Counter(), Counter()
    for block in blocks:
        if not block.element.sealed and is_prose(block):
            chain = list(block.element.holders())
            if all(not h.wraps and HARD_WORDS.intersection(h.name) and HARD_WORDS.intersection(h.name) <= MAY_HOLD for h in chain):
                prose.update(chain[-1:])
                n_chars[chain[-1] if chain else None] += len(block.text)
    held = [h for h in prose if prose[h] > 1]
    if not held:
        return False
    best = max(held, key=lambda h: n_chars[h])
    for block in blocks:
        chain = list(block.element.holders())
        if best in chain:
            for holder in chain:
                holder.wraps = True
        node = block.element
        while node is not None and node.known is not None:
            node.known = None
            node = node.parent
    return True


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    edges, last_under = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR if distance(blocks[i - 1].element, block.element) <= 2 else FAR))
        parent = id(block.element.parent)
        before = last_under.get(parent)
        if before is not None and before < i - 1:
            edges.append((before, i, SIBLING))
        last_under[parent] = i
    kept = minimum_cut([odds(b) for b in blocks], edges)
    if not any(k and is_prose(b) for b, k in zip(blocks, kept, strict=True)) and wrap_by_name(blocks):
        kept = minimum_cut([odds(b) for b in blocks], edges)
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
