"""Main text of web pages by consensus host paths.

1. Each page is read into its element tree.  A container's score is its text
   outside boilerplate less twice the site's boilerplate and the link text below
   it (what an article or main holds, and comments, shares and the like, don't
   count against it, as they are left out of the text anyway); the best container (the deepest of equals) gets the page's vote.
2. Votes name the container's generalised path: tags and classes from the root,
   digits as ``#``, ids left out.  Spark adds them up for each host (partial
   sums before the shuffle, so a host with a third of all pages is one row from
   each task) and the path with most votes wins, ties to the deeper, then the
   later one by code point.
3. Every page is read again and its containers on the winning path give the
   text.  A page of another layout, where they hold less than a quarter of
   the text of its own best container, or less than nine tenths of it while they
   lie inside it and it isn't the body, falls back on that.

Boilerplate is what its tag, role, class or id name: menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles.  A class or id
counts as a whole: only words for boilerplate and parts of a layout (``ad-box``),
or one of ``OFF_ENDS`` after what it belongs to (``post-comments``), not one word
of many (``has-sidebar``, ``related-work``); ids of headings are anchors.  By its
class or id no element goes that holds the main element, all articles or nine
tenths of the page's text.  Blocks are
block-level elements; inside one, white space becomes one space.

Cases: a null or empty html gives the empty text; a page without any element
gives its bare text; a null url is a host of its own; unclosed or stray tags
are taken as browsers do, and a quote that is never closed is a character; what
``hidden`` or ``display: none`` hides is left out; a very long or deep page takes
memory in proportion to its length; extra columns are not read; repeated rows are
extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.session import work_dir

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
CONTAINER = frozenset("body article main section div td center".split())
CLOSES_P = BLOCK - {"body", "html", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "option": "select", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr"}
ALIKE = {"td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
#: What isn't the main text, by tag, by role, and by a word of a class or id.
OFF_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg math object button select textarea input dialog head title menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OFF_WORDS = frozenset("ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner menu nav navbar navigation header masthead footer sidebar "
                      "aside widget cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login form "
                      "search share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar comment comments disqus respond replies reply "
                      "skip copyright".split())
#: Boilerplate that lies within articles, parts of a layout, names that end
#: as boilerplate, and words that make such an end mean something else.
SOFT_WORDS = frozenset("comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe form notice".split())
PARTS = frozenset("box bar list link links item items button buttons btn icon icons wrapper wrap container inner outer area block body section panel slot unit top bottom "
                  "left right side main primary secondary site global posts articles stories news tag tags text content image title toggle row col column group".split())
OFF_ENDS = frozenset("sidebar footer nav navbar menu breadcrumb breadcrumbs pagination pager comments advert ads share replies".split())
LINKING = frozenset("has with no without is to how on of in for the a an and or hide show about from by not".split())
#: Attributes as HTML reads them: a quote opens a value only right behind ``=``, and
#: only where it is closed; anywhere else it is a character like others.
_VALUE = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|=?[^\s/>=]+(?:{_VALUE})?|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.S)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
COMMENT = re.compile(r"comment|reply|replies|teaser|related", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"[ \t\n\r\x0b\f\xa0]+")


class Node:
    """An element: what it is, its parent, and its children (texts and elements).

    ``step`` is its generalised tag and classes; the path is put together only
    when asked for, ``depth`` and ``sum`` (its slashes and checksum) tell paths
    apart without it."""

    __slots__ = ("tag", "step", "parent", "depth", "sum", "main", "off", "named", "soft", "children", "own", "bad", "link")

    def __init__(self, tag: str, step: str, parent: Node | None, off: bool, named: bool = False, soft: bool = False):
        self.tag, self.step, self.parent, self.off, self.named, self.soft, self.children = tag, step, parent, off, named, soft, []
        below = parent is not None and parent.parent is not None
        self.depth = step.count("/") + (parent.depth + 1 if below else 0)
        self.sum = crc32((("/" if below else "") + step).encode(), parent.sum if below else 0)
        self.main = tag in ("article", "main") or parent is not None and parent.main
        self.own = self.bad = self.link = 0

    @property
    def path(self) -> str:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return "/".join(reversed(steps))


def _camel(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]


def _off_name(name: str) -> bool:
    """Whether a class or id as a whole names boilerplate."""
    found = _camel(name)
    if not OFF_WORDS.intersection(found):
        return False
    return all(w in OFF_WORDS or w in PARTS for w in found) or found[-1] in OFF_ENDS and not LINKING.intersection(found)


def _make(tag: str, attributes: str, parent: Node, known: dict) -> Node:
    key = (tag, attributes)
    if (facts := known.get(key)) is None:
        values = {}
        for name, a, b, c in _ATTR.findall(attributes) if attributes.strip(" /\n\t") else ():
            values.setdefault(name.lower(), entities.unescape(a or b or c))
        names = [part for n in (("class",) if tag in HEADINGS else ("class", "id")) for part in values.get(n, "").split() if _off_name(part)]
        off = tag in OFF_TAGS or values.get("role", "").lower() in OFF_ROLES or "hidden" in values or bool(_UNSEEN.search(values.get("style", "")))
        named = not off and bool(names) and (tag not in ("body", "html", "article", "main"))
        soft = tag == "form" or named and all(SOFT_WORDS.intersection(_camel(n)) for n in names)
        kinds = sorted({_DIGITS.sub("#", c) for c in values.get("class", "").split()})
        facts = known[key] = (".".join([tag, *kinds]), off or named, named, soft)
        if len(known) > 20_000:
            known.clear()
    step, off, named, soft = facts
    # an article's own header holds its headline
    if tag == "header" and parent.main:
        off = False
    return Node(tag, step, parent, off, named, soft)


def parse(page: str, known: dict) -> Node:
    """The element tree below a root without a name."""
    root = Node("", "", None, False)
    stack, at = [root], 0
    open_: Counter = Counter()  # open elements by tag

    def close(i: int) -> None:
        open_.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "body", "html", "div", "article", "main", "section"):
                    break
            continue
        if tag in CLOSES_P and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SAME and any(open_[t] for t in ALIKE.get(tag, (tag,))):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ALIKE.get(tag, (tag,)):
                    close(i)
                    break
                if stack[i].tag in SAME[tag]:
                    break
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        node = _make(tag, m[3], stack[-1], known)
        stack[-1].children.append(node)
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue  # elements that close themselves; elsewhere the slash says nothing
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    _unmark(root)
    return root


def _unmark(root: Node) -> None:
    """Takes the mark off elements that their class or id names as boilerplate
    but that hold the main element, all articles or nearly all of the text."""
    order, todo = [], [(root, False, False)]
    while todo:
        node, inside, off = todo.pop()
        off = off or node.off and not node.named
        inside = inside or node.named
        order.append((node, inside, off))
        todo.extend((c, inside, off) for c in node.children if isinstance(c, Node))
    if not any(inside for _, inside, _ in order):
        return
    holds: dict[int, tuple[int, int, int]] = {}
    for node, inside, off in reversed(order):
        size = 0 if off else sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace())
        below = [holds[id(c)] for c in node.children if isinstance(c, Node)]
        holds[id(node)] = (size + sum(b[0] for b in below), (node.tag == "main" and not off) + sum(b[1] for b in below),
                           (node.tag == "article" and not off and not COMMENT.search(node.step.rsplit("/", 1)[-1])) + sum(b[2] for b in below))
    text, mains, articles = holds[id(root)]
    for node, _, _ in order:
        if node.named:
            own = holds[id(node)]
            if own[1] or articles and own[2] == articles or own[0] and 10 * own[0] >= 9 * text:
                node.off = node.named = node.soft = False


def weigh(root: Node) -> list[Node]:
    """All containers in page order, with the characters in and out of
    boilerplate and in links below each."""
    order, todo, found = [], [(root, False, False, False)], []
    while todo:
        node, off, link, soft = todo.pop()
        # boilerplate inside an article, and what belongs to one, is soft
        soft = soft or node.soft or node.tag in ("article", "main")
        off, link = off or node.off, link or node.tag == "a"
        order.append((node, off))
        if node.tag in CONTAINER and not off:
            found.append(node)
        for child in reversed(node.children):
            if isinstance(child, Node):
                todo.append((child, off, link, soft))
        size = sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace())
        node.own, node.bad, node.link = (0, 0 if soft else size, 0) if off else (0, 0, size) if link else (size, 0, 0)
    for node, _ in reversed(order):
        for child in node.children:
            if isinstance(child, Node):
                node.own, node.bad, node.link = node.own + child.own, node.bad + child.bad, node.link + child.link
    return found


def best(found: list[Node]) -> Node | None:
    """The container with the highest score, the deepest of equals."""
    return max(found, key=lambda n: (n.own - 2 * n.bad - 2 * max(0, n.link - n.own // 4), n.depth), default=None)


def blocks(node: Node) -> list[str]:
    """Text of each block below a container, without boilerplate."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if text := _SPACE.sub(" ", entities.unescape("".join(line))).strip():
                out.append(text)
            line.clear()

    todo: list = [node]
    first = True
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif item.off and not first:
            if item.tag in BLOCK:
                end()
        else:
            first = False
            if item.tag == "br":
                line.append(" ")
            elif item.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(item.children))
    end()
    return out


def top(root: Node) -> Node | None:
    """The page's own best container, or all of it where there is none."""
    return best(weigh(root)) or (root if root.children else None)


def extract(page: str | None, path: str | None, known: dict) -> str:
    """Text of the containers on ``path``, or of the page's own best one."""
    if not page:
        return ""
    root = parse(page, known)
    found = weigh(root)
    own = best(found) or root
    wanted = None if path is None else (path.count("/"), crc32(path.encode()))
    chosen = [n for n in found if (n.depth, n.sum) == wanted and n.path == path]
    held, all_ = sum(n.own + n.link for n in chosen), own.own + own.link
    inside = chosen and own.tag != "body" and path.startswith(own.path + "/")
    if not chosen or 4 * held < all_ or inside and 10 * held < 9 * all_:
        chosen = [own]
    return "\n".join(b for n in chosen for b in blocks(n))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        paths = []
        for page in batch.column("html").to_pylist():
            node = top(parse(page or "", known))
            paths.append(node.path if node is not None and node.own else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        texts = [extract(p, w, known) for p, w in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


#: Winning paths up to this many bytes are broadcast; beyond, they are joined.
BROADCAST = 16 << 20


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the winner of each host's vote."""
    votes = pages.mapInArrow(_vote, "host string, path string").filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.size(F.split("path", "/")).alias("depth"), "path")
    return votes.groupBy("host").agg(F.max(rank)["path"].alias("path"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    place = work_dir(spark, "host-paths")
    host_paths(rows.select("host", "html")).write.parquet(place)
    winners = spark.read.parquet(place).select(F.col("host").alias("_host"), "path")
    size = winners.agg(F.sum(F.octet_length("_host") + F.octet_length("path") + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(winners) if size <= BROADCAST else winners, F.col("host") == F.col("_host"), "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_take, "page_id long, url string, text string, n_chars long")
