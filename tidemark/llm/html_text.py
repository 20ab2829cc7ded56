"""Main text of web pages, with the templates of their sites removed.

A page's markup is read into a light tree. Every block with text, whether its
tag or class names it a menu, notice or advert or not, is hashed with all in it;
Spark counts on how many distinct pages of a host each hash stands, and those
on many are taken out of the host's pages. What differs from page to page and
so recurs nowhere (adverts in rotation, a page's own form) goes by its element, its
role or the whole of a class that names it; comments also by their heading, their
item type or their shape. Nothing goes that holds the article.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import join_hot, slices, staged, unlike

#: A subtree is a template's if it is on so many distinct pages of a host, and on so large a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: One of so many words is a template's too if it is on so many distinct pages, and on this smaller share: of a large host's sections or rotating notices. Shorter ones (cells, headings) may be equal by chance.
MANY_PAGES, MANY_SHARE, MANY_WORDS = 10, 0.01, 5

# Names of elements, roles and words in class or id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Never text, and parts of a page that are no article (of these, the last four go unless they hold the main element).
DROPPED = frozenset("head script style noscript template iframe svg annotation annotation-xml button select input textarea canvas audio video noembed noframes title".split())
PARTS = frozenset("form dialog label nav footer aside menu".split())
ASIDE = frozenset("nav footer aside menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are a block of prose by themselves: never a template inside an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt blockquote pre table tbody thead tfoot tr td th b i em strong a span code sub sup u s small cite q figure figcaption br hr img".split())
#: Elements within a line: no template by themselves.
INLINE = frozenset("b i em strong a span code sub sup u s small cite q br hr img".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Elements that a class or id may name.
CONTAINERS = frozenset("div section ul ol dl table center details fieldset figure span ins header article".split())
#: A class names such a part if it is one of NAMES, or of these and PLAIN with hyphens or underscores between.
COMMENTS = frozenset("comment comments commentlist disqus respond replies responses feedback".split())
#: Words beside one of these that make a class tell something about an article instead, as in has-comments and comment-count.
NOT_COMMENTS = frozenset("has no not open closed enabled disabled allow allowed with without count counts number link links".split())
#: A heading that says that comments follow, in the languages of most pages.
COMMENTS_HEADING = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|user|visitor|your)s?'?\s+)?(?:comments?|responses?|replies|kommentare?|leserkommentare|commentaires?|comentarios?|commenti|reacties)\W*\d*\W*"
    r"|(?:leave|post|add|write)\s+(?:a|your)\s+(?:comment|reply|response)\W*|(?:join|start)\s+the\s+(?:discussion|conversation)\W*",
    re.I,
)
#: A class of what tells who wrote a comment and when.
BYLINES = frozenset("author avatar byline commenter date datetime nick nickname posted time timestamp user username".split())
#: Comments by shape: so many records of one kind beside one another, each with a byline, no heading and at most so many words.
RECORDS, RECORD_WORDS = 2, 250
NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav widget widgets cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer masthead "
    "pagination pager toolbar topbar paywall".split()
)
PLAIN = frozenset("area bar block body bottom box button buttons center column container content footer form group header holder inner item items left link links list main outer pane panel policy post posts right section site slot text thread top unit wrap wrapper".split())
#: What an opening tag closes before it, within the given elements.
CLOSES = {"li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())), "option": (frozenset(["option"]), frozenset(["select"]))}
_CLOSE_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemtype|itemprop)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_JOINT = re.compile(r"[-_]+")
_SPLIT = re.compile(r"[-_\s]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RECORD_TAGS = frozenset("div li section article dd tr".split())
#: A block with so large a share of the prose of its article (or, on a page without one, of the page, and so many words) is the article's body and no template.
BODY_SHARE, PART_SHARE, BODY_WORDS = 0.5, 0.2, 50
#: Bits of a subtree's hash: the lowest is always set, the next one if the subtree has MANY_WORDS words.
_MASK, _SOME, _LONG = (1 << 63) - 4, 1, 2


#: How an element is marked: as never text, as a part by tag or role, as a part by name, as reader comments.
_GONE, _PART, _NAMED, _COMMENTS = 1, 2, 3, 4


class Node:
    """An element; after measure() with the hash of the subtree, its words, and what it holds."""

    __slots__ = ("article", "byline", "children", "hash", "heading", "label", "main", "mark", "parent", "prose", "size", "tag", "titled", "words")

    def __init__(self, tag: str, parent: Node | None, label: str, mark: int):
        self.tag, self.parent, self.label, self.mark = tag, parent, label, mark
        self.children: list = []


def _named(token: str) -> int:
    """The mark that a class or id gives."""
    parts = _JOINT.split(token)
    if not COMMENTS.isdisjoint(parts) and NOT_COMMENTS.isdisjoint(parts):
        return _COMMENTS
    if not all(p in NAMES or p in PLAIN for p in parts):
        return 0
    return 0 if NAMES.isdisjoint(parts) else _NAMED


def _mark(tag: str, attributes: str) -> tuple[int, str]:
    """How an element is marked by its tag, role, class or id; its class and id."""
    if tag in DROPPED:
        return _GONE, ""
    mark, label = _PART if tag in PARTS else 0, ""
    if not attributes:
        return mark, label
    for name, value in _ATTRIBUTE.findall(attributes):
        value = html.unescape(value.strip("\"'")).lower()
        name = name.lower()
        if name in ("class", "id"):
            label += " " + value
            if tag in CONTAINERS:
                mark = max(mark, max(map(_named, value.split()), default=0))
        elif name == "itemprop" and value == "comment" or name == "itemtype" and value.rstrip("/").endswith(("/comment", "/usercomments")):
            mark = _COMMENTS
        elif name == "role":
            mark = max(mark, _PART if value in ROLES else 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            mark = max(mark, _PART)
    if tag in ("html", "body", "main"):  # a page's class may name what stands in it
        mark = 0
    return mark, label


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and texts. Left-out end tags are made up for, wrong ones passed over."""
    root = here = Node("", None, "", 0)
    at, end = 0, len(page)
    match = _TOKEN.match
    while at < end:
        opening = page.find("<", at)
        if opening < 0:
            here.children.append(page[at:])
            break
        if opening > at:
            here.children.append(page[at:opening])
        m = match(page, opening)
        if not m:  # a sign by itself
            here.children.append("<")
            at = opening + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in _CLOSE_P:
            node = here
            while node.tag not in BLOCKS and node.parent is not None:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            node, last = here, None
            while node.parent is not None and node.tag not in within:
                last = node if node.tag in closed else last
                node = node.parent
            if last is not None:
                here = last.parent
        mark, label = _mark(tag, m[3])
        node = Node(tag, here, label, mark)
        here.children.append(node)
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            node.children.append(page[at : stop.start() if stop else end])
            close = page.find(">", stop.start()) if stop else -1
            at = close + 1 if close >= 0 else end
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
        elif tag not in VOID and m[3].endswith("/") and tag not in ("svg", "path"):
            here = node  # the slash means nothing outside void elements
    return root


def _walk(root: Node):
    """All nodes below root, each after its parent."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def measure(tree: Node) -> Node:
    """tree with what each node holds: a main element, headings of the first rank, letters, words, its largest article, and a hash.

    The hash is of the subtree's names, classes and text, white space aside; it
    is 0 where there is no text. What is never text counts nothing.
    """
    from xxhash import xxh3_64_intdigest

    for n in reversed(list(_walk(tree))):
        n.main, n.heading, n.article, n.size, n.words, n.hash = n.tag == "main", n.tag == "h1", -1, 0, 0, 0
        n.prose, n.titled, n.byline = 0, n.tag in HEADINGS, n.tag == "time" or not BYLINES.isdisjoint(_SPLIT.split(n.label))
        if n.mark == _GONE:
            n.main = n.heading = False
            continue
        parts = [n.tag, n.label]
        for c in n.children:
            if isinstance(c, Node):
                n.main |= c.main
                n.heading |= c.heading
                n.article = max(n.article, c.article)
                n.size += c.size
                n.words += c.words
                n.prose += c.prose
                n.titled |= c.titled
                n.byline |= c.byline
                if c.words:
                    parts.append(str(c.hash))
            elif own := c.split():
                n.words += len(own)
                n.size += len(c)
                parts.append(" ".join(own))
        n.prose = 0 if n.mark else n.prose + n.words - sum(c.words for c in n.children if isinstance(c, Node))
        if n.tag == "article" and n.mark != _COMMENTS:
            n.article = max(n.article, n.size)
        if n.words:
            n.hash = xxh3_64_intdigest("\x00".join(parts)) & _MASK | _SOME | (_LONG if n.words >= MANY_WORDS else 0)
    _mark_comments(tree)
    return tree


def _text_of(node: Node) -> str:
    return " ".join(" ".join(c if isinstance(c, str) else _text_of(c) for c in node.children).split())


def _mark_comments(tree: Node) -> None:
    """Mark comments that no name tells: what a heading says to be some, and like records with bylines; neither where it holds the article or stands before its end.

    A heading's part is the block that it begins, or, where that holds the
    article too, what follows it there.
    """
    started = False
    for n in list(_walk(tree)):
        if n.mark == _GONE:
            continue
        started = started or n.tag in ("article", "main") or n.tag == "h1"
        if not started or not n.words:
            continue
        blocks = [c for c in n.children if isinstance(c, Node) and c.words]
        for k, c in enumerate(blocks):
            if c.tag in HEADINGS and c.tag != "h1" and c.words <= 8 and COMMENTS_HEADING.fullmatch(html.unescape(_text_of(c))):
                rest = blocks[k:]
                if k == 0 and not (n.main or n.heading or n.article >= 0) and n.tag not in ("", "html", "body"):
                    n.mark = n.mark or _COMMENTS
                elif not any(b.main or b.heading or b.article >= 0 or 2 * b.prose > tree.prose for b in rest):
                    for b in rest:
                        b.mark = b.mark or _COMMENTS
                break
        kinds: dict = {}
        for c in blocks:
            if c.tag in RECORD_TAGS and c.byline and not (c.titled or c.main) and c.words <= RECORD_WORDS:
                kinds.setdefault((c.tag, c.label), []).append(c)
        for own in kinds.values():
            if len(own) >= RECORDS and not any(p.tag in ("article", "main") for p in _above(own[0])) and tree.article >= 0:
                for c in own:
                    c.mark = c.mark or _COMMENTS


def _above(node: Node):
    while (node := node.parent) is not None:
        yield node


def _holds(node: Node, tree: Node) -> bool:
    """Whether a node holds the page's article: the main element, the largest article or the heading; without any of these, half of the text."""
    if tree.main or tree.article >= 0 or tree.heading:
        return node.main or node.heading or node.article >= 0 and node.article == tree.article
    return 2 * node.size >= tree.size


def dropped(node: Node, tree: Node) -> bool:
    """Whether an element goes by what it is: never text, or a marked part that does not hold the article."""
    if node.mark == _GONE:
        return True
    if node.tag in ASIDE:
        return not node.main
    if node.tag == "header" and not _in_content(node):
        return not (node.main or node.article >= 0)
    if not node.mark:
        return False
    return not (node.main or node.heading if node.mark == _COMMENTS else _holds(node, tree))


def roots(tree: Node) -> list[Node]:
    """Where main text is looked for: every main element and the articles beside them, outermost ones; without a main element the whole page."""
    found: list[Node] = []
    stack = [tree]
    while stack:
        node = stack.pop()
        if dropped(node, tree):
            continue
        if node.tag in ("main", "article"):
            found.append(node)
            continue
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found if any(n.tag == "main" for n in found) else [tree]


def candidates(tree: Node) -> list[Node]:
    """Blocks with text that may be part of a template, of a measured tree, marked ones among them.

    Not: the page, its body, articles and main elements and what holds one;
    inside articles and main elements, blocks of prose and what is within them,
    and the blocks that hold their body: half of their prose, or a fifth of it
    and BODY_WORDS words without a name that marks them. On a page without such elements the block
    with half of the page's prose is taken for one. So a story that many pages
    of a host carry stays, whatever it is wrapped in.
    """
    out = []
    whole = 0 if tree.main or tree.article >= 0 else tree.prose
    stack = [(tree, 0)]  # with the prose of the article that it is in
    while stack:
        node, of = stack.pop()
        if node.tag in ("article", "main"):
            of = of or max(1, node.prose)
        if not node.words or node.tag in INLINE or of and node.tag in PROSE:
            continue
        body = of and node.tag not in PARTS and node.tag != "header" and node.prose >= (BODY_SHARE * of if node.mark else min(BODY_SHARE * of, max(BODY_WORDS, PART_SHARE * of)))
        if not of and node.tag in CONTAINERS and not node.mark and node.prose >= max(BODY_WORDS, BODY_SHARE * whole) and whole:
            body, of = True, node.prose
        if not body and node.tag not in ("", "html", "body", "article", "main") and not node.main and (node.article < 0 or node.tag in ASIDE or node.mark == _COMMENTS):
            out.append(node)
        stack.extend((c, of) for c in node.children if isinstance(c, Node))
    return out


def main_text(page: str, templates: frozenset | set = frozenset()) -> str:
    """The blocks of a page's main text, joined by two line feeds."""
    return text_and_removed(page, templates)[0]


def text_and_removed(page: str, templates: frozenset | set = frozenset()) -> tuple[str, int]:
    """main_text(), and how many outermost blocks of the page went because they are a template's."""
    tree = measure(parse(page))
    gone = {id(n) for n in candidates(tree) if n.hash in templates} if templates else set()
    blocks: list[str] = []
    pieces: list[str] = []
    removed = sum(id(n) in gone and not _under(n, gone) for n in _walk(tree)) if gone else 0

    def close():
        words = " ".join("".join(pieces).split())
        if words:
            blocks.append(words)
        pieces.clear()

    for root in roots(tree):
        close()
        stack: list = [root]
        while stack:
            node = stack.pop()
            if node is None:
                close()
            elif isinstance(node, str):
                pieces.append(html.unescape(node) if "&" in node else node)
            elif id(node) in gone or dropped(node, tree):
                continue
            elif node.tag == "br":
                pieces.append(" ")
            elif node.tag in BLOCKS:
                close()
                stack.append(None)
                stack.extend(reversed(node.children))
            else:
                stack.extend(reversed(node.children))
        close()
    return "\n\n".join(blocks), removed


def _under(node: Node, gone: set) -> bool:
    node = node.parent
    while node is not None and id(node) not in gone:
        node = node.parent
    return node is not None


def _in_content(node: Node) -> bool:
    """Whether a header is that of an article, a section or the main element, not of the page."""
    while node is not None:
        if node.tag in ("article", "main", "section"):
            return True
        node = node.parent
    return False


def _hashes(batches):
    for batch in (part for whole in batches for part in slices(whole)):
        hosts, digests = batch.column("host").to_pylist(), batch.column("page").to_pylist()
        rows = [sorted({n.hash for n in candidates(measure(parse(page)))}) if page else [] for page in batch.column("html").to_pylist()]
        flat = [(host, h, page) for host, page, own in zip(hosts, digests, rows, strict=True) for h in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "hash", "page"])


def host_of(url):
    """The host part of a url column, in lower case; empty where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return host


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """host, pages (its rows) and hashes of the host's templates, of pages (host, html).

    Rows of equal html, told by a 64-bit hash, count as one page, those without html as none.
    """
    pages = pages.select("host", "html", F.when(F.col("html") != "", F.xxhash64("html")).alias("page"))
    sizes = pages.groupBy("host", "page").agg(F.count("*").alias("copies")).groupBy("host").agg(F.sum("copies").alias("pages"), F.count("page").alias("distinct"))
    sizes = staged(sizes, "hosts")
    seen = pages.mapInArrow(_hashes, "host string, hash long, page long").distinct()
    found = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min(min_pages, many_pages))
    n, of = F.col("n"), F.col("distinct")
    usual = (n >= min_pages) & (n >= of * min_share)
    many = (n >= many_pages) & (n >= of * many_share) & (F.col("hash").bitwiseAND(F.lit(_LONG)) != 0)
    # at most 1 / share times a page's subtrees pass for one host
    lists = found.join(sizes, "host").filter(usual | many).groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    return sizes.drop("distinct").join(lists, "host", "inner")


def _sets(lists):
    """Each list of a column as a set, made once for the lists of a host."""
    made: dict = {}
    for row in lists:
        values = row.values
        own = values.to_numpy(zero_copy_only=False) if values is not None else np.zeros(0, np.int64)
        key = own.tobytes()
        if key not in made:
            made[key] = frozenset(own.tolist())
        yield made[key]


def _extract(keep: list[str]):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [text_and_removed(page, hashes) if page else ("", 0) for page, hashes in zip(batch.column("html").to_pylist(), _sets(batch.column("hashes")), strict=True)]
            sizes = np.array([len(t) for t, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([t for t, _ in found], pa.string()), pa.array(sizes), pa.array([n for _, n in found], pa.int64())], [*keep, "text", "n_chars", "n_removed"])

    return run


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """The columns ``keep`` of pages (all but the html unless given), text, n_chars and n_removed; one row per row.

    n_removed counts the page's blocks that are its site's template. Blocks of
    the text are parted by two line feeds, white space within is one space,
    character references are decoded. A null or empty page has an empty text.
    Pages without a host, or with a null url, share the empty host's templates.
    Rows that repeat a page have equal results and count once for templates; an
    empty table gives an empty result; a page of any length is read whole. A
    kept column with the name of a result gives way to it.
    """
    keep = unlike([c for c in pages.columns if c != html_col] if keep is None else keep, ["text", "n_chars", "n_removed"])
    fields = {f.name: f for f in pages.schema.fields}
    rows = pages.select(*[F.col(c).alias(f"k_{c}") for c in keep], host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = staged(templates(rows, min_pages, min_share, many_pages, many_share), "templates")
    both = join_hot(rows, found, ["host"], "pages", pages.count())
    own = [f"k_{c}" for c in keep]
    schema = T.StructType([T.StructField(o, fields[c].dataType) for o, c in zip(own, keep, strict=True)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_removed", T.LongType())])
    found = both.select(*own, "html", "hashes").mapInArrow(_extract(own), schema)
    return found.select(*[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)], "text", "n_chars", "n_removed")
