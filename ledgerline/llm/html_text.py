"""HTML main text by tree scoring.

Paragraphs pass points for their length and commas to their ancestors; an ancestor's sum is discounted by its link
density. The best container is kept with those siblings that score well beside it. Elements that hold no article text
by their kind or style are left out before. Forms, and blocks whose role or name says that they are no article (menus,
adverts, comments, ...), are only suspects: they stay if they hold the page's article or most of its plain text, as
wrappers of whole pages do. Names that articles use too (header, related, share, ...) make a suspect only outside
an article; inside one such a block is scored by itself, and stays if it has a heading or enough plain text. Every
step is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import per_text

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_END = re.compile(r"</([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that never hold article text.
OUT = frozenset("head script style noscript template nav footer aside button select option datalist textarea title iframe object svg math canvas audio video map dialog menu input label fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Parts of class names and ids that make an element a suspect wherever it is, unless one of the second stands before them.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promoted sidebar sidebars"
    " comments commentlist respond disqus cookie cookies consent gdpr popup popups modal overlay lightbox newsletter subscribe signup signin login outbrain taboola"
    " navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager masthead topbar toolbar skiplink tagcloud".split()
)
WITHOUT = frozenset("has no with without hide show".split())
#: Those of what readers write, which may be longer than the article.
REMARKS = frozenset("comments commentlist respond disqus comment commentary reply replies discussion responses feedback".split())
#: Share of the plain text (of the article it is in, else of the page) that a suspect must hold to stay; of remarks too.
MOST, NEARLY_ALL = 0.67, 0.9
#: Parts that articles use as well.
DOUBTFUL = frozenset(
    "promotion banner banners rail comment commentary reply replies discussion responses feedback notice notices notification alert alerts subscription register"
    " share sharing social follow related recommended recommendations teaser teasers trending popular nav navigate paging footer foot header skip widget widgets tags toc print hidden legal copyright disclaimer form search".split()
)
ARTICLE = frozenset("article post entry story content body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Points that a doubtful block inside an article needs, if it has no heading, and the share of links that it may have.
ENOUGH, MOST_LINKS = 2.5, 0.33
#: Ancestors that a block passes points to.
LEVELS = 12
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of these kinds, unless one of the second stands between.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("tr td th", "table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements inside which an outer paragraph goes on.
_FENCES = frozenset("td th table article section div body".split())
#: Points that an element has from its kind.
KIND = {"article": 30.0, "main": 20.0, "section": 2.0, "div": 1.0, "blockquote": 1.0, "pre": 1.0, "ul": -2.0, "ol": -2.0, "dl": -2.0, "table": -1.0}


class _Node:
    __slots__ = ("chars", "doubtful", "heading", "kind", "kept", "links", "out", "own", "parent", "points", "share")

    def __init__(self, kind: str, parent: _Node | None, out: bool, doubtful: bool = False, share: float = 0.0) -> None:
        """share: of a suspect, what it must hold to stay."""
        self.kind, self.parent, self.out, self.doubtful, self.share = kind, parent, out, doubtful, share
        self.points, self.own, self.chars, self.links = KIND.get(kind, 0.0), 0.0, 0, 0
        self.heading = self.kept = False


def _judge(kind: str, attributes: str, inside_article: bool) -> tuple[bool, bool, float]:
    """Whether an element is out, whether its name makes it doubtful, and the share it must hold if it is a suspect (else 0)."""
    if kind in OUT or (kind == "header" and not inside_article):
        return True, False, 0.0
    suspect = MOST if kind == "form" else 0.0
    if not attributes or attributes.isspace():
        return False, False, suspect
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return kind not in ("html", "body"), False, 0.0
    block = kind in BLOCKS
    if found.get("role", "").lower() in ROLES and kind not in ("html", "body"):
        return not block, False, MOST
    if kind in KEPT:
        return False, False, suspect
    parts = _WORDS.split(html.unescape(f"{found.get('class', '')} {found.get('id', '')}").lower())
    named = {x for before, x in zip(["", *parts], parts) if before not in WITHOUT}
    share = NEARLY_ALL if not REMARKS.isdisjoint(named) else MOST
    if not NAMES.isdisjoint(named):
        return not block, False, share
    if not block or DOUBTFUL.isdisjoint(named):
        return False, False, suspect
    known = inside_article or not ARTICLE.isdisjoint(named)
    return False, known and not suspect, suspect if known else share


def blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """The elements of a page, parents before children, and its text blocks in order, each with its element; blocks of elements that are out don't come."""
    root = _Node("html", None, False)
    made, open_, found, pieces, links = [root], [root], [], [], 0
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each kind
    ended = None  # kinds that have an end tag anywhere
    articles = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            node = open_[-1]
            if text and not node.out:
                found.append((node, text))
                node.chars += len(text)
                node.links += min(links, len(text))
            pieces.clear()
        links = 0

    def close(upto: int) -> None:
        nonlocal articles
        flush()
        articles -= sum(n.kind in ("article", "main") for n in open_[upto:])
        for x in open_[upto:]:
            where[x.kind].pop()
        del open_[upto:]

    def last(kinds: frozenset[str]) -> int:
        """The place of the innermost open element of these kinds, 0 if there is none."""
        return max((where[x][-1] for x in kinds if where.get(x)), default=0)

    anchor = 0
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not open_[-1].out:
            decoded = html.unescape(text) if "&" in text else text
            pieces.append(decoded)
            if anchor:
                links += len(decoded.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and not open_[-1].out:
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        kind = m[2].lower()
        if m[1]:
            if kind == "a":
                anchor = 0
            if kind in BLOCKS:  # an inline element's end doesn't end blocks
                if where.get(kind):
                    close(where[kind][-1])
                flush()
            elif kind == "br" and not open_[-1].out:
                pieces.append(" ")
            continue
        if kind == "a":
            anchor = 1
        if kind == "br":
            if not open_[-1].out:
                pieces.append(" ")
            continue
        block = kind in BLOCKS
        if block:
            flush()
            if where.get("p") and where["p"][-1] > last(_FENCES):  # an open paragraph ends here
                close(where["p"][-1])
            if kind in ENDS:
                kinds, fence = ENDS[kind]
                while (k := last(kinds)) > last(fence):
                    close(k)
                    if kind not in ("tr", "tbody", "thead", "tfoot"):
                        break
        if kind == "body" and open_[-1].kind == "head":
            close(len(open_) - 1)
        if kind in VOID:
            continue
        out, doubtful, share = _judge(kind, m[3] or m[4], articles > 0) if not open_[-1].out else (True, False, 0.0)
        if block or out:
            if out and not block:
                pieces.append(" ")
            if block or kind in RAW or kind in OUT or out:
                node = _Node(kind, open_[-1], out, doubtful, share)
                made.append(node)
                if block and kind not in RAW:
                    open_.append(node)
                    where[kind].append(len(open_) - 1)
                    articles += kind in ("article", "main")
                elif kind in RAW:
                    end = re.compile(rf"</{kind}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                else:  # the text around an inline element that is out stays one block
                    if ended is None:
                        ended = {x.lower() for x in _END.findall(page)}
                    depth, skip = 1, re.compile(rf"<(/?){re.escape(kind)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
                    while depth and kind in ended and (e := skip.search(page, at)):
                        at = e.end()
                        depth += -1 if e[1] else 1
                    anchor = anchor if kind != "a" else 0  # its end is passed over with it
    flush()
    return made, found


def _add_up(made: list[_Node]) -> None:
    """Every element's own characters become those of all that is in it."""
    for x in reversed(made):
        if x.parent:
            x.parent.chars += x.chars
            x.parent.links += x.links


def _without_suspects(made: list[_Node], found: list[tuple[_Node, str]]) -> list[tuple[_Node, str]]:
    """found without the blocks of suspects that hold neither the page's article nor most of the plain text.

    made has its own characters, before and after; what is out has none after.
    """
    own = [(x.chars, x.links) for x in made]
    _add_up(made)
    plain = {id(x): x.chars - x.links for x in made}
    article = {id(x): plain[id(x)] if x.kind in ("article", "main") else 0 for x in made}
    inner = dict.fromkeys(article, 0)  # plain text of the articles inside an element
    for x in reversed(made):
        if x.parent:
            inner[id(x.parent)] += max(article[id(x)], inner[id(x)])
    page, region = made[0], {}
    for x in made:
        within = region[id(x.parent)] if x.parent else page
        region[id(x)] = x if x.kind in ("article", "main") else within
        x.out |= bool(x.parent and x.parent.out)
        if x.share and not x.out:
            if within is page and inner[id(page)]:
                x.out = 2 * inner[id(x)] <= inner[id(page)]
            else:
                x.out = plain[id(x)] < x.share * plain[id(within)] or not plain[id(x)]
    for x, (chars, links) in zip(made, own):
        x.chars, x.links = (0, 0) if x.out else (chars, links)
    return [(node, text) for node, text in found if not node.out]


def _without_doubtful(made: list[_Node], found: list[tuple[_Node, str]]) -> list[tuple[_Node, str]]:
    """found without the blocks of doubtful elements that have neither a heading nor enough plain text."""
    for node, text in found:
        node.heading |= node.kind in HEADINGS
        node.own += _points(node, text)
    for x in reversed(made):
        if x.parent:
            x.parent.heading |= x.heading
            x.parent.own += x.own
    for x in made:
        x.out |= bool(x.parent and x.parent.out) or (x.doubtful and not (x.chars and x.links <= MOST_LINKS * x.chars and (x.heading or x.own >= ENOUGH)))
    return [(node, text) for node, text in found if not node.out]


def _points(node: _Node, text: str) -> float:
    return 0.0 if node.kind in HEADINGS else 1.0 + sum(map(text.count, ",\N{ARABIC COMMA}\N{IDEOGRAPHIC COMMA}\N{FULLWIDTH COMMA}")) + min(len(text) / 100.0, 3.0)


def main_text(page: str | None) -> str:
    """The blocks of the best container and of its good siblings, joined by line ends; "" if there are none."""
    if not page:
        return ""
    made, found = blocks(page)
    if any(x.share for x in made):
        found = _without_suspects(made, found)
    _add_up(made)
    if any(x.doubtful for x in made):
        found = _without_doubtful(made, found)
    if not found:
        return ""
    for node, text in found:
        points = _points(node, text)
        # text that stands in a container itself makes it the parent
        at = (node.parent or node) if node.kind in ("p", "pre", "td", "th", "li", "dd", "dt", "blockquote") or node.kind in HEADINGS else node
        for level in range(LEVELS):
            at.kept = True  # for now: has a part in the points
            at.points += points * (1.0 if not level else 0.5 if level == 1 else 1.0 / (3 * level))
            if not at.parent:
                break
            at = at.parent
    scored = [x for x in made if x.kept]
    for x in scored:
        x.kept = False
    value = lambda x: x.points * (1 - x.links / max(x.chars, 1)) if x.points > 0 else x.points
    best = max(scored, key=value)
    least, beside = max(10.0, 0.2 * value(best)), best.parent
    siblings = {id(x): x for x in scored if x.parent is beside and value(x) >= least}
    best.kept = True
    place: dict[int, _Node] = {}  # of an element below the best container's parent: the child of that parent it is in
    for x in made:
        if x.parent is beside and beside:
            place[id(x)] = x
        elif x.parent and id(x.parent) in place:
            place[id(x)] = place[id(x.parent)]
    for node, text in found:  # siblings: well-scored containers, plain paragraphs without many links, the title
        at = place.get(id(node))
        if at and not at.kept:
            at.kept = id(at) in siblings or at.kind == "h1" or (at.kind == "p" and at.links < 0.25 * at.chars and len(text) > 80)
    for x in made:
        x.kept |= bool(x.parent and x.parent.kept)
    return "\n".join(text for node, text in found if node.kept)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """doc_id (the key), text, n_chars for every row; a null or empty page, or one without blocks, has the empty text.

    Rows are independent: repeated rows and null keys are as any other. Pages are read whole, broken markup too.
    """

    def run(htmls: list[str | None]) -> list[tuple]:
        return [(t, len(t)) for t in map(main_text, htmls)]

    return per_text(pages, key, page, run, "text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # the url rides along in the key, so that nothing has to be joined back
    keyed = pages.select(F.struct("page_id", "url").alias("key"), "html")
    return extract(keyed, "key", "html").select("doc_id.page_id", "doc_id.url", "text", "n_chars")
