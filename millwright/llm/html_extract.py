"""HTML extraction by removal of site templates.

Every block element's subtree outside of the article's prose is hashed; Spark counts on how many different articles of
its host a subtree stands, and subtrees that recur on many of them are deleted. Copies of one article count once, so
that an article found under many addresses isn't taken for a template. What recurs goes first, whatever it is called;
what the pages' own marks tell (elements' names and roles, then classes and ids) goes after it, for a block that is new
on each page recurs nowhere. Of what is left, the article (else main, else the body) gives the text.

Inside an article a class or id alone only drops adverts, reader comments and sign-up notices; other words need a second
sign, which is that links make up half of the subtree's text, or that it recurs.

Counts are of (host, subtree, article) rows made distinct, so a hot host is spread over its subtrees. Pages are parsed
twice rather than moved; if there are more templates than a broadcast may hold, each page's own ones are joined to it.

Edge cases: a null html is empty; without a host the page's recurring subtrees aren't removed; on a host of few
articles a subtree recurs if it is on all of them, two at least; unclosed and stray tags are mended as browsers do for
the common cases; repeated rows are extracted each; columns other than page_id, url and html aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored, tune

#: A subtree is template if it stands on so many different articles of its host; on a host of fewer, on all of them, two at least.
PAGES = 5
#: Templates (64-bit keys) that a broadcast may hold; beyond that pages are joined with their own.
BROADCAST_KEYS = 1_000_000

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = set("nav aside form script style noscript template iframe button select textarea input dialog object embed canvas audio video head title menu xmp noembed noframes datalist".split())
_DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what isn't the article.
_DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidebars aside header masthead footer comment comments disqus respond replies reply reactions related recommended recommendations"
    " share sharing social widget widgets login signin signup search toolbar skip".split()
)
#: Of these, the ones that need no second sign inside an article.
_STRONG_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments disqus respond replies reply cookie cookies consent gdpr newsletter subscribe subscription paywall popup modal overlay".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "html", "body", "article", "main"}
#: Blocks of prose: inside an article they are its text, however many pages quote it.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "td", "th", "tr"}
#: Parts of tables and lists: inside an article no class or id drops them.
_ROWS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "dl", "dt", "dd"}
#: An opened tag of the second kind ends an open element of the first.
_CLOSES_P = _BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "aside", "nav", "td", "th", "form", "header", "footer", "blockquote", "menu", "figure", "fieldset"}

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']|(?<==)"[^"]*"|(?<==)'[^']*'|(?<== )"[^"]*"|(?<== )'[^']*'|["'])*+(?:>|\Z)|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}


class Node:
    __slots__ = ("name", "drop", "marked", "weak", "parts", "hash")

    def __init__(self, name: str, drop: bool = False, marked: bool = False, weak: bool = False):
        """marked: dropped by class or id alone; weak: by words that need a second sign."""
        self.name, self.drop, self.marked, self.weak, self.parts, self.hash = name, drop, marked, weak, [], None


def _marks(value: str) -> set[str]:
    """The words of a class's or id's tokens that say that this isn't the article: all words of such a token do, or are numbers."""
    out: set[str] = set()
    for token in value.split():
        words = [w for w in _WORDS.findall(token) if not w.isdigit()]
        if words and _DROP_WORDS.issuperset(words):
            out.update(words)
    return out


def _node(name: str, raw: str, inside: bool) -> Node:
    """inside: of an article, whose own header holds its title."""
    if name in _DROP or name == "footer" or name == "header" and not inside:
        return Node(name, True)
    if " " not in raw and "\n" not in raw and "\t" not in raw:
        return Node(name)
    words: set[str] = set()
    for m in _ATTR.finditer(raw, len(name) + 1):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return Node(name, True)
        if key == "role" and value in _DROP_ROLES:
            return Node(name, True)
        if key in ("class", "id") and name not in _HEADINGS and name != "header" and not (inside and name in _ROWS):
            words |= _marks(value)
        if key in ("class", "id") and name == "article" and not {"comment", "reply", "related", "teaser", "ad"}.isdisjoint(_WORDS.findall(value)):
            return Node(name, True)
    return Node(name, bool(words), bool(words), inside and bool(words) and _STRONG_WORDS.isdisjoint(words))


def _mend(root: Node) -> None:
    """A class or id doesn't drop what holds the page's only article, main or h1, nor, by weak words, what isn't mostly links."""
    for names in ({"article", "main"}, {"h1"}):
        # a marked element is followed by the chain of the marked ones that hold it
        todo: list[tuple[Node, tuple | None]] = [(root, None)]
        within: dict[int, Node] = {}
        while todo:
            x, chain = todo.pop()
            if x.drop and not x.marked:
                continue
            if x.marked:
                chain = (x, chain)
            if x.name in names:
                if chain is None:
                    break
                at = chain
                while at is not None and id(at[0]) not in within:
                    within[id(at[0])] = at[0]
                    at = at[1]
            todo.extend((p, chain) for p in x.parts if not isinstance(p, str))
        else:
            for x in within.values():
                x.drop = x.marked = False
    order = list(_walk(root))
    if not any(x.weak for x in order):
        return
    chars: dict[int, tuple[int, int]] = {}  # of text, and of links in it
    for x in reversed(order):
        own = links = 0
        for p in x.parts:
            if isinstance(p, str):
                own += len(p.strip())
            else:
                a, b = chars.pop(id(p))
                own, links = own + a, links + b
        chars[id(x)] = (own, own if x.name == "a" else links)
        if x.weak and x.drop and 2 * links < own:
            x.drop = x.marked = False


class _Stack:
    """The open elements, and where the last one of each name and the last one that bounds a search stand."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        if node.name in _SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, name: str) -> int:
        own = self.at.get(name)
        return own[-1] if own else 0

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            name = self.nodes.pop().name
            self.at[name].pop()
            if name in _SCOPE:
                self.scopes.pop()


def parse(page: str) -> Node:
    """The element tree, as far as text needs it, in time proportional to the page."""
    root = Node("")
    stack, at, n = _Stack(root), 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        token, at = m[0], m.end()
        top = stack.nodes[-1]
        if token[0] != "<" or token == "<":
            top.parts.append(token)
            continue
        got = _NAME.match(token)
        if not got:
            if token.startswith("<![CDATA["):
                top.parts.append(token[9:].removesuffix("]]>"))
            continue
        name = got[1].lower()
        if token[1] == "/":
            k = stack.last(name)
            if name == "p" and not k:
                top.parts.append(Node("p"))
            # only a block's end tag reaches beyond the elements that bound a search
            if k and (name in _BLOCK or k >= stack.scopes[-1]):
                stack.cut(k)
            continue
        if name in _CLOSES_P or name in _SAME:
            ends = _SAME.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
            while (k := max(map(stack.last, ends))) and k >= stack.scopes[-1]:
                stack.cut(k)
                if name not in ("tr", "tbody"):
                    break
        inside = bool(stack.last("article") or stack.last("main"))
        node = _node(name, token[1:-1] if token.endswith(">") else token[1:], inside)
        stack.nodes[-1].parts.append(node)
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            stop = end.start() if end else n
            if name in ("textarea", "title"):
                node.parts.append(page[at:stop])
            at = n if not end else (page.find(">", stop) + 1 or n)
        elif name not in _VOID and not token.endswith("/>"):
            stack.push(node)
    _mend(root)
    return root


def text_of(node: Node, gone: frozenset | set = frozenset(), skip_dropped: bool = True) -> str:
    """The text of a subtree: blocks apart, white space single, character references decoded."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x))  # a reference ends where its text does
        elif (x.drop and skip_dropped and x is not node) or (gone and x.hash in gone):
            out.append(" ")
        else:
            if x.name in _BLOCK:
                todo.append(" ")
                out.append(" ")
            todo.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in reversed(x.parts) if not isinstance(p, str))


def containers(root: Node) -> list[Node]:
    """The article elements outside of dropped ones, else main elements, else the whole page."""
    for name in ("article", "main"):
        out, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.drop:
                continue
            if x.name == name:
                out.append(x)
            else:
                todo.extend(p for p in reversed(x.parts) if not isinstance(p, str))
        if out:
            return out
    return [root]


def hash_subtrees(root: Node) -> list[Node]:
    """Sets the hash of every block element, children first; articles, main, what holds them, and prose in them have none."""
    order = list(_walk(root))
    inner = {id(y) for x in containers(root) if x is not root for y in _walk(x)}
    text: dict[int, str] = {}
    holds: set[int] = set()
    out = []
    for x in reversed(order):
        own = [x.name]
        for p in x.parts:
            if isinstance(p, str):
                own.append("\1" + " ".join(p.split()))
            else:
                own.append("\2" + text.pop(id(p)))
                if id(p) in holds:
                    holds.add(id(x))
        if x.name in ("article", "main", "body", "html", "h1", "") and not x.drop:
            holds.add(id(x))
        text[id(x)] = xxhash.xxh64_hexdigest("".join(own))
        if x.name in _BLOCK and x.name not in ("br", "hr") and id(x) not in holds and not (x.name in _PROSE and id(x) in inner):
            x.hash = int(text[id(x)], 16)
            out.append(x)
    return out


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def _key(host: int, subtree: int) -> int:
    """One signed 64-bit number for a subtree of a host."""
    return xxhash.xxh64_intdigest(struct.pack("<qQ", host, subtree)) - (1 << 63)


def _counted(pages: DataFrame) -> DataFrame:
    """__k1, __k2, __host, key, article (hash of the page's main text) of all hashed subtrees; key null: the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, articles = [], [], []
            for k, (host, page) in enumerate(zip(batch.column("__host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                root = parse(page or "")
                own = {_key(host, x.hash) for x in hash_subtrees(root)}
                main = xxhash.xxh64_intdigest(" ".join(text_of(x) for x in containers(root))) - (1 << 63)
                row += [k] * (len(own) + 1)
                keys += [None, *own]
                articles += [main] * (len(own) + 1)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("__k1", "__k2", "__host")), pa.array(keys, pa.int64()), pa.array(articles, pa.int64())], ["__k1", "__k2", "__host", "key", "article"])

    return pages.where("__host is not null").select("__k1", "__k2", "__host", "html").mapInArrow(run, "__k1 long, __k2 long, __host long, key long, article long")


def templates(counted: DataFrame, least: int = PAGES) -> DataFrame:
    """key: the subtrees that recur on at least `least` different articles of a host, or on all of them if they are fewer (two at least)."""
    seen = stored(counted.select("__host", "key", "article").distinct().groupBy("__host", "key").count().where("key is null or count > 1"))
    of_host = seen.where("key is null").select("__host", F.col("count").alias("articles"))
    often = seen.where("key is not null").join(of_host, "__host")
    return often.where(F.col("count") >= F.least(F.lit(least), F.greatest(F.lit(2), F.col("articles")))).select("key")


def extract(pages: DataFrame, least: int = PAGES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    tune(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    rows = pages.select("page_id", "url", "html", F.when(host != "", F.xxhash64(host)).alias("__host"), F.xxhash64("page_id", "url", "html").alias("__k1"), F.xxhash64("html", "url", "page_id").alias("__k2"))
    counted = _counted(rows)
    found = stored(templates(counted, least))
    few = found.count() <= broadcast_keys
    if few:
        # at most `broadcast_keys` numbers
        known = np.sort(np.array([r.key for r in found.collect()], np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(known)
    else:
        own = counted.where("key is not null").select("__k1", "__k2", "key").join(found, "key").groupBy("__k1", "__k2").agg(F.collect_set("key").alias("__gone"))
        rows = rows.join(own, ["__k1", "__k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            lists = [None] * len(batch) if few else batch.column("__gone").to_pylist()
            for page, h, own in zip(batch.column("html").to_pylist(), batch.column("__host").to_pylist(), lists, strict=True):
                root, gone = parse(page or ""), set()
                if h is not None and (own or few and len(shared.value)):
                    nodes = hash_subtrees(root)
                    keys = [_key(h, x.hash) for x in nodes]
                    if few:
                        at = np.searchsorted(shared.value, keys)
                        hit = shared.value[np.minimum(at, len(shared.value) - 1)] == keys
                    else:
                        known_here = set(own)
                        hit = [k in known_here for k in keys]
                    gone = {x.hash for x, y in zip(nodes, hit, strict=True) if y}
                texts.append(" ".join(t for x in containers(root) if (t := text_of(x, gone))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    columns = ["page_id", "url", "html", "__host"] + ([] if few else ["__gone"])
    return rows.select(*columns).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def deleted(pages: DataFrame, least: int = PAGES) -> DataFrame:
    """What the method does: page_id and the number of hashed subtrees, and of those that recur. One row for each page with a host."""
    tune(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    rows = pages.select("html", F.when(host != "", F.xxhash64(host)).alias("__host"), F.xxhash64("page_id", "url", "html").alias("__k1"), F.xxhash64("html", "url", "page_id").alias("__k2"))
    counted = stored(_counted(rows))
    hit = counted.where("key is not null").join(stored(templates(counted, least)).withColumn("hit", F.lit(1)), "key", "left")
    return hit.groupBy("__k1", "__k2").agg(F.count("*").alias("subtrees"), F.count("hit").alias("recurring"))
