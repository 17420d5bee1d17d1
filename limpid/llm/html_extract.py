"""Main text of web pages by consensus paths of each host.

Pass one scores the containers of every page and lets each page vote for the generalised tag-class path of
the whole article around its best. Spark counts the votes of each host. Pass two extracts every page again, by
the path that won on its host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import extended, sliced, staged

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|\"(?![^\"]*\")|'(?![^']*'))*)(?:>|\Z)", re.S)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ID = re.compile(r"""(?<![\w-])id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|form|dialog|alert)""", re.I)

RAW = {"script", "style", "textarea", "title", "iframe", "xmp"}  # hold no tags; an unclosed one takes the rest of the page
#: Left out with what they hold. Those of BRIEF hold no blocks: one that is not closed ends at the next block.
BRIEF = {"select", "button", "svg", "annotation", "annotation-xml"}
LEFT_OUT = BRIEF | {"noscript", "template"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "td", "th", "tr", "table", "tbody", "aside", "header", "footer", "nav", "form", "center", "details", "dialog", "fieldset", "menu"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "caption", "thead", "tfoot", "hgroup", "summary", "address", "legend", "head", "hr"}
NEVER = {"html", "body", "article", "main"}  # no noise by their own names
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SENTENCE = 60  # characters from which a block counts as a sentence rather than a label
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
#: Words of class names and ids of what is no article text, and what they are commonly joined with.
NOISE = re.compile(
    r"ads?|adv|advert[a-z0-9]*|adsense|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|promo[a-z0-9]*|sponsor[a-z0-9]*|"
    r"sidebar|widget[a-z0-9]*|menu[a-z0-9]*|nav|navbar|navigation|breadcrumbs?|footer|masthead|siteheader|pageheader|topbar|comments?|commentlist|disqus|"
    r"repl(?:y|ies)|respond|related|recommend[a-z0-9]*|share|sharing|social|popup|modal|overlay|login|signup|search|toolbar|paginat[a-z0-9]+|pager|skiplink|copyright"
)
_BEFORE = {"site", "page", "post", "main", "top", "bottom", "global", "primary", "secondary", "entry", "article", "user"}
_AFTER = re.compile(
    r"areas?|container|wrap|wrapper|inner|box|bar|list|items?|slot|unit|form|section|block|thread|links?|buttons?|icons?|media|posts?|articles?|message|left|right|top|bottom|primary|secondary|[0-9]+"
)
#: Names of what holds an article; beside one of them a name above only tells of the layout.
ARTICLE = {"article", "post", "entry", "story", "content", "hentry", "h-entry", "single", "page", "main", "text", "news", "blog", "post-content", "entry-content", "article-body", "article-content"}
_HYPHEN = re.compile(r"(?<![a-z])(side-(?=bar)|site-(?=header)|page-(?=header)|top-(?=bar)|pop-(?=up)|log-(?=in)|sign-(?=up)|skip-(?=link))")


@lru_cache(4096)
def noise_name(name: str) -> bool:
    """Whether a class name or id as a whole is one of no article text. Names that hold other words besides
    (no-sidebar, content-sidebar-wrap, elementor-widget-text-editor) tell of the layout and are not."""
    parts = [p for p in re.split("[-_]+", _HYPHEN.sub(lambda m: m[0][:-1], name.lower())) if p]
    if len(parts) > 1 and parts[0] in _BEFORE:
        parts = parts[1:]
    if not parts or not NOISE.fullmatch(parts[0]):
        return False
    return parts[0] == "comment" or all(NOISE.fullmatch(p) or _AFTER.fullmatch(p) for p in parts[1:])


def noise_names(names: str) -> bool:
    """Whether the class names and the id of one container speak against it."""
    own = names.lower().split()
    return any(map(noise_name, own)) and not ARTICLE & set(own)


class Node:
    __slots__ = ("tag", "path", "parent", "noise", "named", "first", "last")

    def __init__(self, tag: str, path: str, parent: Node | None, noise: bool, named: bool = False, first: int = 0):
        self.tag, self.path, self.parent, self.noise = tag, path, parent, noise
        self.named = named  # noise by nothing but names
        self.first, self.last = first, first  # its blocks are those from first up to last


def _first(m: re.Match | None) -> str:
    return next((g for g in m.groups() if g is not None), "") if m else ""


def _generalised(tag: str, attrs: str) -> tuple[str, str]:
    """(path step, class and id text): digits become #, classes are sorted."""
    names = _first(_CLASS.search(attrs)) if attrs else ""
    step = tag + "".join(f".{c}" for c in sorted(re.sub(r"\d+", "#", names.lower()).split()))
    return step, f"{names} {_first(_ID.search(attrs))}" if attrs else ""


_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
_NEXT = {tag: re.compile(rf"<(?:(/{tag}\b[^>]*>?)|{tag}\b|/?(?:{'|'.join(sorted(BLOCKS - {'div'} if tag == 'button' else BLOCKS))})\b)", re.I) for tag in BRIEF}
_NEST = {tag: re.compile(rf"<(/?){tag}\b[^>]*>?", re.I) for tag in LEFT_OUT - BRIEF}


def _end(html: str, tag: str, at: int) -> int | None:
    """Where a tag of LEFT_OUT ends that was opened before ``at``; None if it is not closed."""
    if tag in BRIEF:
        m = _NEXT[tag].search(html, at)
        return m.end() if m and m[1] else None
    depth = 1
    for m in _NEST[tag].finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def parse(html: str) -> list[tuple[Node, str, int, bool]]:
    """The text blocks in page order: (innermost container, text, its characters in links, whether a heading)."""
    blocks: list[tuple[Node, str, int, bool]] = []
    root = Node("", "", None, False)
    stack: list[Node] = [root]
    text: list[str] = []
    linked = links = at = 0
    heading = False
    muted: tuple[str, int] | None = None  # an unclosed tag of LEFT_OUT, and how many containers are around it
    size = len(html)
    closed = dict.fromkeys(LEFT_OUT, size)  # up to where one may be closed

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                blocks.append((stack[-1], joined, linked, heading))
            text.clear()
        linked = 0

    def leave(k: int) -> None:
        for n in stack[k:]:
            n.last = len(blocks)
        del stack[k:]

    while at < size:
        m = _TOKEN.search(html, at)
        start = m.start() if m else size
        if start > at and not muted:
            piece = html[at:start]
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1]
        if tag in RAW:
            if not closing and not m[0].endswith("/>"):
                end = _END[tag].search(html, at)
                if tag == "xmp" and not muted:
                    text.append(html[at : end.start() if end else size])
                at = end.end() if end else size
            continue
        if tag in LEFT_OUT:
            if closing:
                if muted and muted[0] == tag:
                    muted = None
            elif not m[0].endswith("/>") and not muted:
                if at < closed[tag] and (end := _end(html, tag, at)):
                    at = end
                else:
                    muted = tag, len(stack)
                    if tag not in BRIEF:
                        closed[tag] = at  # none is closed from here on
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br" or tag == "img":
            text.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        if muted and muted[0] in BRIEF:
            muted = None
        close()
        heading = not closing and tag in HEADINGS
        if tag not in CONTAINERS and tag not in ("ul", "ol", "blockquote", "figure", "dl"):
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    leave(k)
                    if muted and k < muted[1]:
                        muted = None
                    break
            links = 0
        elif not m[0].endswith("/>"):
            attrs = m[3]
            step, names = _generalised(tag, attrs)
            up = stack[-1]
            in_article = any(n.tag in ("article", "main") for n in stack)
            sure = (up.noise and not up.named) or tag in DROPPED or (tag == "header" and not in_article)
            if not sure and attrs and tag not in ("html", "body"):
                sure = bool(_HIDDEN.search(attrs) or _ROLE.search(attrs))
            named = not sure and tag != "main" and (up.named or (tag not in NEVER and noise_names(names)))
            stack.append(Node(tag, f"{up.path}/{step}", up, sure or named, named, len(blocks)))
    close()
    leave(0)
    if blocks and all(b[0].noise for b in blocks):
        _by_links(blocks)
    return blocks


def _by_links(blocks: list[tuple[Node, str, int, bool]]) -> None:
    """Names left nothing: containers that are noise by name only become text, unless mostly links."""
    sizes = [(0, 0)]
    for _, text, linked, _ in blocks:
        sizes.append((sizes[-1][0] + len(text), sizes[-1][1] + linked))
    met: set[int] = set()
    for node, *_ in blocks:
        way = []
        while node is not None and id(node) not in met:
            met.add(id(node))
            way.append(node)
            node = node.parent
        for n in reversed(way):
            if n.named:
                size, links = (b - a for a, b in zip(sizes[n.first], sizes[n.last]))
                n.noise = 2 * links > size or (n.parent is not None and n.parent.noise)


def _sums(blocks: list[tuple[Node, str, int, bool]]) -> list[tuple[int, int, int]]:
    """Running sums over blocks that are no noise: characters, those in links, headings and sentences."""
    sums = [(0, 0, 0)]
    for node, text, linked, heading in blocks:
        size, links, texts = sums[-1]
        sums.append(sums[-1] if node.noise else (size + len(text), links + linked, texts + (linked == 0 and (heading or len(text) >= SENTENCE))))
    return sums


def whole(sums: list[tuple[int, int, int]], core: Node) -> Node:
    """The container of the whole article that ``core`` is a part of: the outermost article around it,
    or else main, or else the highest container that adds a heading or a sentence, and not mostly links,
    to what the one below holds."""
    above, n = [core], core.parent
    while n is not None and n.path:
        above.append(n)
        n = n.parent
    for tag in ("article", "main"):
        if around := [n for n in above if n.tag == tag and not n.noise]:
            return around[-1]
    top = below = core
    for n in above[1:]:
        size, links, texts = (d - c + b - a for a, b, c, d in zip(sums[n.first], sums[below.first], sums[below.last], sums[n.last]))
        if texts and 3 * links <= size:
            top = n
        below = n
    return top


def best_path(blocks: list[tuple[Node, str, int, bool]]) -> tuple[str, float] | None:
    """The path of the whole article around the container with most text outside links: a block counts
    for its container, and half for the one above."""
    scores: dict[int, tuple[float, Node]] = {}
    for node, text, linked, _ in blocks:
        if node.noise:
            continue
        gain = len(text) - 2 * linked
        if gain <= 0:
            continue
        gain += 10 * text.count(",")
        while node.parent and node.tag in ("ul", "ol", "blockquote", "figure", "dl", "table", "tbody", "tr"):
            node = node.parent
        for n, share in ((node, 1.0), (node.parent, 0.5)):
            if n is not None and n.path:
                scores[id(n)] = (scores.get(id(n), (0.0, n))[0] + gain * share, n)
    if not scores:
        return None
    score, node = max(scores.values(), key=lambda x: (x[0], -len(x[1].path), x[1].path))
    return whole(_sums(blocks), node).path, score


def _under(node: Node, path: str) -> bool:
    return node.path == path or node.path.startswith(path + "/")


def extract(blocks: list[tuple[Node, str, int, bool]], path: str | None) -> str:
    """The blocks of the whole articles around the containers of that path, one a line; those of the
    page's own best container if it has none of that path."""
    for use in (path, "own"):
        if use == "own":
            own = best_path(blocks)
            use = own[0] if own else None
        if use is None:
            continue
        cores: dict[int, Node] = {}
        for n, *_ in blocks:
            if not n.noise and _under(n, use):
                while n.path != use:
                    n = n.parent
                cores[id(n)] = n
        sums = _sums(blocks)
        paths = {whole(sums, n).path for n in cores.values()}
        kept = [b[1] for b in blocks if not b[0].noise and any(_under(b[0], p) for p in paths)]
        if kept:
            return "\n".join(kept)
    return ""


def host_of(url: str) -> F.Column:
    """Lower-case host of a URL column, without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, score): how many pages of a host have their best container there."""
    import pyarrow as pa

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            hosts, paths, scores = [], [], []
            for host, html in zip(b.column("host").to_pylist(), b.column("h").to_pylist()):
                if html and (best := best_path(parse(html))):
                    hosts.append(host)
                    paths.append(best[0])
                    scores.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])

    votes = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").alias("h")).mapInArrow(vote, "host string, path string, score double")
    return votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.floor("score")).alias("score"))


def html_extraction(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_share: float = 0.3) -> DataFrame:
    """``pages`` with two more columns: _host, _text. Input columns with the names of added ones give way to them.

    The path with most votes of a host, ties by summed score and then by name, is used on all its
    pages if it has ``least_share`` of the votes; otherwise, and on pages without that
    path, the page's own best container is. Null and empty html give an empty text. Pages
    without a url, or with one that has no host, share the empty host. Ids are not used, so null and repeated ones
    are carried through, and equal rows are pages like others, each with its vote. An empty table gives an empty result.
    """
    import pyarrow as pa

    pages = pages.drop("_host", "_text")
    votes = host_votes(pages, url_col, html_col)
    won = staged(
        votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("_limpid_path"), F.max("votes").alias("most"), F.sum("votes").alias("all"))
        .filter(F.col("most") >= least_share * F.col("all")).select(F.col("host").alias("_limpid_host"), "_limpid_path"),
        "paths",
    )
    names = pages.columns
    joined = pages.withColumn("_limpid_h", host_of(url_col)).join(won, F.col("_limpid_h") == F.col("_limpid_host"), "left").select(*[F.col(f"`{c}`") for c in names], "_limpid_h", "_limpid_path")
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [extract(parse(h), p) if h else "" for h, p in zip(b.column(at).to_pylist(), b.column(len(names) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(names) + 1)], pa.array(texts, pa.string())], [*names, "_host", "_text"])

    return joined.mapInArrow(run, extended(pages.schema, "_host string, _text string"))
