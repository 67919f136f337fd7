"""Main text of web pages by wrapper induction.

Every page becomes a tree. Runs of like siblings (same tag and class) are folded into one node, so that a tree shows a
page's layout and not its length. The commonest tree of a host is its reference, and each page of the host is aligned
with it by simple tree matching (the largest set of matched nodes that keeps parents and the order of siblings). A node
whose text is the same on all pages of the host, while their contents differ, is template; what varies is a slot. The
content is the page's article (article or main element; else all of the page but what is mostly links outside of the
smallest subtree that holds the slot with most text and the blocks beside it, or ahead of its text), without parts that HTML or their class and id name as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments of readers, and without template nodes. Names are whole words of a class or role or whole ids; names that an
article's own parts may bear, such as related or notice, count inside an article for what is mostly links only.

References and template nodes come from counts over all pages, combined before they are shuffled; what is kept of a host
is as large as one folded tree. A null or empty page has an empty text, a null url the empty host. Unclosed, wrongly
nested and cut off elements are closed as browsers do; no depth is too deep. Repeated rows give the same text each. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style textarea title iframe noembed noframes noscript template svg math head nav footer aside form button select datalist dialog menu object canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Words of a class, id or role that name what isn't content.
NAMED = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies pagination pager toolbar skip widget contentinfo complementary search".split())
#: Parts that a compound name may have besides, as in site-footer; others, as in has-sidebar or related-work, say something else.
BESIDE = frozenset("site page main top bottom left right box block list wrapper container section area bar links link posts post items item inner primary secondary global text".split())
#: Names that an article's own parts may bear too: in an article they count for what is mostly links only.
UNSURE = frozenset("banner promotion menu aside notice notices popup modal overlay subscription share sharing social related recommended recommendations respond replies toolbar skip widget complementary search".split())
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*+>?)|[^<]+|<""", re.S)
_named = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_words = re.compile(r"[A-Za-z]+")
_apart = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
_digits = re.compile(r"\d+")
#: Runs of siblings that a folded node keeps apart at most: alignment takes the product of two nodes' runs.
WIDE = 64
#: Pages of a host from which a node that never changes counts as template.
SAME = 3


class Node:
    __slots__ = ("tag", "key", "parts", "number", "bad", "holds", "up", "first", "last", "unsure")

    def __init__(self, tag: str, key: str, bad: bool):
        self.tag, self.key, self.bad = tag, key, bad
        self.parts: list = []  # texts and nodes
        self.number = -1
        self.holds = False  # an article or main element below
        self.up: Node | None = None  # the block around it, and which of the page's blocks of text are below
        self.first = self.last = 0
        self.unsure = False  # named, but maybe a part of an article


def named(kind: str, value: str) -> set[str]:
    """The names of NAMED that an attribute gives: whole words of a class or role, also compounds of such names; an id as a whole."""
    if kind == "id":
        return {value.lower()} & NAMED
    out: set[str] = set()
    for word in value.split():
        if word.lower() in NAMED:
            out.add(word.lower())
            continue
        parts = {x.lower() for x in (_words if word.islower() or word.isupper() else _apart).findall(word)}
        if parts <= NAMED | BESIDE:
            out |= parts & NAMED
    return out


def parse(page: str) -> Node:
    root = Node("#", "#", False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _token.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k].tag in BLOCK:  # an inline end tag does not close a block
                    break
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in CLOSES.get(name, ()):
                    del stack[k:]
                elif stack[k].tag in BLOCK:
                    break
        attributes = m[3]
        labels = [(g[0].lower(), g[1] or g[2] or g[3]) for g in _named.findall(attributes)] if attributes and len(attributes) > 2 else []
        names = set() if name in UNNAMED else set().union(*(named(kind, x) for kind, x in labels))
        bad = name in DROPPED or bool(names)
        node = Node(name, name + "".join("." + _digits.sub("", " ".join(x.lower().split())) for x in [x for _, x in labels if x][:1]), bad)
        node.unsure = bool(names) and name not in DROPPED and (names <= UNSURE or name not in BLOCK)
        stack[-1].parts.append(node)
        if name in ("article", "main"):
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
        elif name not in VOID and not (attributes.endswith("/>") and name not in BLOCK):
            stack.append(node)
    return root


def fold(root: Node) -> str:
    """Number the nodes by their place in the folded tree, which comes back as a line of depth:key for each node."""
    lines: list[str] = []

    def groups(nodes: list[Node]):
        """Runs of like block children of the folded nodes, in order; of more than WIDE runs all of one key become one."""
        out: list[list[Node]] = []
        last = None
        for node in nodes:
            for x in node.parts:
                if isinstance(x, Node) and x.tag not in VOID and (x.tag in BLOCK or x.bad):
                    if x.key != last:
                        out.append([])
                    out[-1].append(x)
                    last = x.key
        if len(out) > WIDE:
            named: dict[str, list[Node]] = {}
            for group in out:
                named.setdefault(group[0].key, []).extend(group)
            out = list(named.values())
        return iter(out)

    todo = [groups([root])]  # an explicit stack: elements that are never closed nest without bound
    while todo:
        group = next(todo[-1], None)
        if group is None:
            todo.pop()
            continue
        lines.append(f"{len(todo) - 1}:{group[0].key}")
        for x in group:
            x.number = len(lines) - 1
        todo.append(groups(group))
    return "\n".join(lines)


def tree(folded: str) -> list[tuple[str, list[int]]]:
    """(key, children) of each node, the last one the root."""
    nodes: list[tuple[str, list[int]]] = []
    path: list[int] = []
    top: list[int] = []
    for k, line in enumerate(folded.split("\n") if folded else []):
        depth, key = line.split(":", 1)
        del path[int(depth) :]
        (nodes[path[-1]][1] if path else top).append(k)
        nodes.append((key, []))
        path.append(k)
    nodes.append(("#", top))
    return nodes


def match(one: str, other: str) -> dict[int, int]:
    """Simple tree matching: which node of `other` each node of `one` is aligned with.

    Pairs of nodes are met from the roots down, through children with equal keys, and scored from the deepest up: a pair
    counts itself and the best order-keeping set of pairs of its children.
    """
    if one == other:
        return {k: k for k in range(one.count("\n") + 1)} if one else {}
    a, b = tree(one), tree(other)
    top = len(a) - 1, len(b) - 1
    order, below = [top], {}
    for i, j in order:  # grows as it is read; two nodes meet at one depth only
        x, y = a[i][1], b[j][1]
        named: dict[str, list[int]] = {}
        for d in y:
            named.setdefault(b[d][0], []).append(d)
        below[i, j] = [(c, d) for c in x for d in named.get(a[c][0], ())]
        order += below[i, j]
    score: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in reversed(order):
        x, y = a[i][1], b[j][1]
        if not below[i, j]:
            score[i, j], pairs[i, j] = 1, []
            continue
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p, c in enumerate(x, 1):
            row, before = table[p], table[p - 1]
            for q, d in enumerate(y, 1):
                row[q] = max(before[q], row[q - 1], before[q - 1] + score.get((c, d), 0))
        found, p, q = [], len(x), len(y)
        while p and q:
            if table[p][q] == table[p - 1][q]:
                p -= 1
            elif table[p][q] == table[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                found.append((x[p], y[q]))
        score[i, j], pairs[i, j] = table[-1][-1] + 1, found
    out: dict[int, int] = {}
    todo = [top]
    while todo:
        for i, j in pairs[todo.pop()]:
            out[i] = j
            todo.append((i, j))
    return out


def blocks(root: Node) -> list[tuple[int, bool, bool, int, int, int, str]]:
    """(node, inside an article, named as no content, first and last + 1 of the blocks around its slot, letters in links, text) of every block of text, in page order."""
    out: list = []
    text: list[str] = []
    link = 0
    extent: dict[int, tuple[int, int]] = {}

    def flush(node: Node, article: bool, bad: bool) -> None:
        nonlocal link
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((node, article, bad, link, joined))
            text.clear()
        link = 0

    shares: dict[int, tuple[int, int]] = {}

    def linked(node: Node) -> bool:
        """Whether most letters below are links; what is below is summed up once."""
        if id(node) not in shares:
            order = [(node, False)]
            for x, anchor in order:
                order += [(c, anchor or c.tag == "a") for c in x.parts if not isinstance(c, str)]
            for x, anchor in reversed(order):
                own = sum(len("".join(c.split())) for c in x.parts if isinstance(c, str))
                below = [shares[id(c)] for c in x.parts if not isinstance(c, str)]
                shares[id(x)] = own + sum(a for a, _ in below), own * anchor + sum(b for _, b in below)
        letters, inside = shares[id(node)]
        return 2 * inside > letters

    # an explicit stack, since elements that are never closed nest without bound
    todo: list[tuple] = [(iter(root.parts), root, False, False, False, True)]
    while todo:
        parts, owner, article, bad, anchor, block = todo[-1]
        for x in parts:
            if isinstance(x, str):
                text.append(x)
                if anchor:
                    link += len("".join(x.split()))
            elif x.tag == "br":
                text.append(" ")
            elif x.tag in VOID and x.tag != "hr":
                pass
            elif x.tag in BLOCK or x.bad:
                flush(owner, article, bad)
                inside = article or (x.tag in ("article", "main") and not bad)
                header = x.tag == "header" and not article
                # a name on an element that holds the article itself says nothing of the article
                lost = bad or (header or x.bad) and not (x.tag not in DROPPED and x.holds) and not (article and x.unsure and not linked(x))
                x.up, x.first = owner, len(out)
                todo.append((iter(x.parts), x, inside, lost, anchor, True))
                break
            else:
                todo.append((iter(x.parts), owner, article, bad, anchor or x.tag == "a", False))
                break
        else:  # text behind an inline element goes on in the same block
            todo.pop()
            if block:
                flush(owner, article, bad)
                owner.last = len(out)
                if owner.number >= 0:
                    low, high = extent.get(owner.number, (owner.first, owner.last))
                    extent[owner.number] = min(low, owner.first), max(high, owner.last)
    around: dict[int, tuple[int, int]] = {}

    def slot(node: Node) -> tuple[int, int]:
        """What stands around the block that holds `node`, and around all others of its kind that were folded with it."""
        holder = node.up or node
        key = holder.number if holder.number >= 0 else -2 - id(holder)
        if key not in around:
            low, high = extent.get(holder.number, (holder.first, holder.last)) if holder.number >= 0 else (holder.first, holder.last)
            top = holder.up or holder
            while top.up is not None and (top.first > low or top.last < high):
                top = top.up
            around[key] = top.first, top.last
        return around[key]

    return [(node.number, article, bad, *slot(node), link, joined) for node, article, bad, link, joined in out]


def host_of(url: str | None) -> str:
    return re.split(r"[/?#]", (url or "").split("://", 1)[-1], maxsplit=1)[0].rsplit("@", 1)[-1].lower()


def mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


PARSED = "page_id long, url string, host string, folded string, marks array<struct<node:int,mark:bigint>>, content long, blocks array<struct<node:int,article:boolean,bad:boolean,first:int,last:int,link:int,text:string>>"


def parsed(df: DataFrame) -> DataFrame:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("node", pa.int32()), ("mark", pa.int64())])), pa.int64(), pa.list_(pa.struct([("node", pa.int32()), ("article", pa.bool_()), ("bad", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()), ("link", pa.int32()), ("text", pa.string())]))]

    def read(batches):
        for batch in batches:
            rows = []
            for page, url, body in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                root = parse(body)
                folded = fold(root)
                found = blocks(root)
                own: dict[int, list[str]] = {}
                for b in found:
                    own.setdefault(b[0], []).append(b[-1])
                marks = [{"node": k, "mark": mark("\n".join(t))} for k, t in own.items()]
                keys = ("node", "article", "bad", "first", "last", "link", "text")
                rows.append((page, url, host_of(url), folded, marks, mark("\n".join(b[-1] for b in found if not b[2])), [dict(zip(keys, b)) for b in found]))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "host", "folded", "marks", "content", "blocks"])

    return common.plain(df, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(read, PARSED)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, reference, template: each host's commonest folded tree and the nodes of it whose text never changes."""
    count = pages.groupBy("host", "folded").agg(F.count("*").alias("n"))
    reference = common.keep(count.groupBy("host").agg(F.max(F.struct("n", "folded"))["folded"].alias("reference")), "references")

    def align(batches):
        known: dict[tuple[str, str], dict[int, int]] = {}
        for batch in batches:
            rows = []
            for host, folded, marks, content, ref in zip(*(batch.column(c).to_pylist() for c in ("host", "folded", "marks", "content", "reference"))):
                if (folded, ref) not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[folded, ref] = match(folded, ref)
                to = known[folded, ref]
                rows.extend((host, to[m["node"]], m["mark"], content) for m in marks if m["node"] in to)
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "node", "mark", "content"])

    aligned = pages.select("host", "folded", "marks", "content").join(reference, "host").mapInArrow(align, "host string, node int, mark long, content long")
    nodes = aligned.groupBy("host", "node").agg(F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b"), F.min("content").alias("c"), F.max("content").alias("d"))
    template = nodes.where(f"n >= {SAME} and a = b and c != d").groupBy("host").agg(F.collect_list("node").alias("template"))
    return common.keep(reference.join(template, "host", "left"), "wrappers")


def content(found: list[dict], template: set[int]) -> list[str]:
    """The texts that are content, of a page's blocks."""
    good = [k for k, b in enumerate(found) if not b["bad"] and b["node"] not in template]
    inside = [found[k]["text"] for k in good if found[k]["article"]]
    if inside or any(b["article"] for b in found):
        return inside
    letters = [len("".join(b["text"].split())) for b in found]
    plain = [k for k in good if 2 * found[k]["link"] <= letters[k]]
    if not plain:
        return []
    size: dict[tuple[int, int], int] = {}
    for k in plain:
        place = found[k]["first"], found[k]["last"]
        size[place] = size.get(place, 0) + letters[k] - found[k]["link"]
    first, last = max(size, key=lambda p: (size[p], p[0] - p[1], p))  # around the slot with most text
    start = min(k for k in plain if first <= k < last)
    # what is mostly links is a menu outside of that, and, if it is nothing but links, ahead of its text
    return [found[k]["text"] for k in good if 2 * found[k]["link"] <= letters[k] or first <= k < last and (k > start or found[k]["link"] < letters[k])]


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = common.keep(parsed(df), "parsed")
    known_hosts = wrappers(pages)

    def cut(batches):
        known: dict[tuple[str, str], dict[int, int]] = {}
        for batch in batches:
            out = []
            for folded, ref, same, found in zip(*(batch.column(c).to_pylist() for c in ("folded", "reference", "template", "blocks"))):
                template: set[int] = set()
                if same:
                    if (folded, ref) not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[folded, ref] = match(folded, ref)
                    template = {k for k, r in known[folded, ref].items() if r in set(same)}
                out.append("\n".join(content(found, template)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.select("page_id", "url", "host", "folded", "blocks").join(known_hosts, "host", "left")
    return joined.mapInArrow(cut, "page_id long, url string, text string, n_chars long")
