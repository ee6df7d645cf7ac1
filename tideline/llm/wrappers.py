"""Main text of web pages by wrapper induction.

Distinct pages of one host, in blocks dealt by their content, are aligned with a page of their block by
simple tree matching. Nodes whose text is the same on nearly all aligned pages are the host's template;
the others are its slots. Going down from the root, the slot that holds most of the varying text on most
pages is the main one, and each page's text is what is aligned with it: so a page whose article is shorter
than its adverts still gives its article. Pages that the wrapper doesn't fit form a wrapper of their own.
Markup settles what alignment leaves open: an article element around the main slot is taken whole, and
within it goes what tags or names declare to be navigation, adverts, forms, comments and the like.
A page with nothing to align with has its markup only.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import spill

BLOCK_PAGES = 32
#: Copies of a content in its host that go with the other pages.
MOST_COPIES = 256
#: A node is template if at least so many pages were aligned with it and such a share has its text.
LEAST_PAGES = 6
CONSTANT = 0.85
#: A slot is the main one within its parent if it has this share of the varying text on half of the pages.
MAIN_SHARE = 0.7
#: Pairs of children that one matching compares; beyond, only those in a band around the diagonal.
MOST_PAIRS = 10_000

#: Fixed values of HTML: elements without content, with raw text, that end an open p, and that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html option td th tr tbody thead tfoot legend summary".split())
#: What a start tag closes, up to the boundary that stops it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements, and words in class, id and role, that hold no main text.
SKIP = frozenset("head nav header footer aside form script style noscript template iframe button select textarea input dialog menu svg canvas object embed title option xmp noembed noframes".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner "
    "cookie cookies consent notice notices gdpr popup modal overlay comment comments disqus replies respond share sharing social related recommended newsletter "
    "subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget toolbar copyright search complementary contentinfo".split()
)
#: Elements that hold a whole main text, and blocks of text that hold no slot of their own.
WHOLE = ("article", "main")
LEAVES = frozenset("p li pre dt dd h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_NAME = re.compile(r"""(?ai)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?ai)(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "skip", "kids", "parent", "shape", "size", "key", "fixed", "main")

    def __init__(self, tag: str, skip: bool, parent: Node | None):
        self.tag, self.skip, self.parent = tag, skip, parent
        self.kids: list[Node | str] = []
        self.shape, self.size, self.key, self.fixed, self.main = 0, 1, None, False, False

    def elements(self) -> list[Node]:
        return [k for k in self.kids if type(k) is Node]


def named_to_skip(attributes: str) -> bool:
    if not attributes or ("=" not in attributes and "hidden" not in attributes):
        return False
    for m in _NAME.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name))]
            if parts and (parts[0] in SKIP_WORDS or parts[-1] in SKIP_WORDS):
                return True
    return bool(_HIDDEN.search(attributes))


def parse(page: str) -> Node:
    """A lenient tree: void and raw elements, implied ends of p, li, cells; stray ends are ignored."""
    root = Node("#root", False, None)
    at, here = 0, root
    opened: Counter[str] = Counter()  # the elements from here up, so that no step walks up in vain

    def leave(to: Node) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                here.kids.append(page[at:])
            return root
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                continue
            up = here
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root  # an inline end does not close blocks
                    break
                up = up.parent
            if up is not root:
                leave(up.parent)
            continue
        if tag in ENDS_P and opened["p"]:
            up = here
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "article", "section", "main", "body", "table", "button"):
                up = up.parent
            if up.tag == "p":
                leave(up.parent)
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
            close, stop = CLOSES[tag]
            up = to = here
            while up is not root and up.tag not in stop:
                if up.tag in close:
                    to = up.parent
                up = up.parent
            leave(to)
        node = Node(tag, tag in SKIP or named_to_skip(m[3]), here)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(f"(?ai)</{re.escape(tag)}(?=[\\s/>])").search(page, at)
            if not end:
                return root
            at, here = end.start(), node
            opened[tag] += 1
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            here = node
            opened[tag] += 1


def finish(root: Node, shapes: dict) -> list[Node]:
    """All elements, children first, with shape numbers that equal subtrees share, sizes, and keys of shape and text."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in n.kids if type(k) is Node)
    order.reverse()
    for n in order:
        own = n.elements()
        n.shape = shapes.setdefault((n.tag, n.skip, *[k.shape for k in own]), len(shapes))
        n.size = 1 + sum(k.size for k in own)
        n.key = hash((n.shape, *[k.key if type(k) is Node else k.strip() for k in n.kids]))
    return order


def own_text(n: Node) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(k for k in n.kids if type(k) is str))).strip()


def kids_left(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Children of a and b that pair outright, and those left between them.

    Equal subtrees at both ends pair, which an optimal matching allows: those of equal text before those of
    equal shape alone, so that a template's first and last nodes meet.
    """
    x, y = a.elements(), b.elements()
    pairs: list[tuple[Node, Node]] = []
    for same in ("key", "shape"):
        head, most = 0, min(len(x), len(y))
        while head < most and getattr(x[head], same) == getattr(y[head], same):
            head += 1
        tail = 0
        while tail < most - head and getattr(x[-1 - tail], same) == getattr(y[-1 - tail], same):
            tail += 1
        pairs += zip(x[:head], y[:head], strict=True)
        if tail:
            pairs += zip(x[-tail:], y[-tail:], strict=True)
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    return pairs, x, y


def band(n: int, m: int) -> list[tuple[int, int]]:
    """For each of n rows the columns of m to compare: all, or those around the diagonal if that are too many pairs."""
    if n * m <= MOST_PAIRS:
        return [(0, m)] * n
    half = max(abs(n - m) // n + 2, MOST_PAIRS // (2 * n))
    return [(max(0, i * m // n - half), min(m, i * m // n + half + 1)) for i in range(n)]


def known(a: Node, b: Node, memo: dict) -> int | None:
    """The score of simple tree matching, the most nodes that can be paired in order with roots on roots, if it is known."""
    if a.tag != b.tag or a.skip != b.skip:
        return 0
    return a.size if a.shape == b.shape else memo.get((a.shape, b.shape))


Row = tuple[int, list[int]]  # the first column of a row of the table, and its values; beyond them the last one holds


def value(row: Row, j: int) -> int:
    low, values = row
    return values[min(j - low, len(values) - 1)]


def table(x: list[Node], y: list[Node], memo: dict) -> list[Row]:
    """The dynamic programme over two lists of children whose scores are known, within the band."""
    best: list[Row] = [(0, [0])]
    for p, (low, high) in zip(x, band(len(x), len(y)), strict=True):
        last = best[-1]
        row = [value(last, low)]
        for j in range(low, high):
            row.append(max(value(last, j + 1), row[-1], value(last, j) + (known(p, y[j], memo) or 0)))
        best.append((low, row))
    return best


def match(a: Node, b: Node, memo: dict) -> int:
    """The score of a and b, by an explicit stack: the depth of a page is no limit."""
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        if known(p, q, memo) is not None:
            todo.pop()
            continue
        pairs, x, y = kids_left(p, q)
        need = {}
        for i, (low, high) in zip(x, band(len(x), len(y)), strict=True):
            for j in y[low:high]:
                if known(i, j, memo) is None:
                    need.setdefault((i.shape, j.shape), (i, j))
        if need:
            todo += need.values()
            continue
        memo[p.shape, q.shape] = 1 + sum(i.size for i, _ in pairs) + (table(x, y, memo)[-1][1][-1] if x and y else 0)
        todo.pop()
    return known(a, b, memo) or 0


def align(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node]]:
    """Paired nodes of an optimal simple tree matching of two trees with equal roots."""
    match(a, b, memo)
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        out.append((p, q))
        pairs, x, y = kids_left(p, q)
        todo += pairs
        if not x or not y:
            continue
        for i, (low, high) in zip(x, band(len(x), len(y)), strict=True):
            for j in y[low:high]:
                match(i, j, memo)  # a pair of equal shapes was never scored below
        best = table(x, y, memo)
        i, j = len(x), len(y)
        while i and j:
            if value(best[i], j) == value(best[i - 1], j):
                i -= 1
            elif value(best[i], j) == value(best[i], j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[i], y[j]))
    return out


def downwards(root: Node) -> list[Node]:
    """The nodes of a tree, each before its children, outside what markup skips."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(k for k in reversed(n.elements()) if not k.skip)
    return out


def induce(trees: list[Node], nodes: list[list[Node]], least: int = LEAST_PAGES, constant: float = CONSTANT) -> list[int]:
    """Mark the template's nodes as fixed and each tree's main slot as main; the places of trees that have none.

    The tree of median size stands for the wrapper; all others are aligned with it. nodes are the trees'
    nodes, children first.
    """
    memo: dict = {}
    base = sorted(trees, key=lambda t: t.size)[len(trees) // 2]
    paired = [align(base, t, memo) for t in trees]
    texts = [{id(n): text for n in own if (text := own_text(n))} for own in nodes]
    rows: dict[int, list[tuple[Node, str]]] = {}
    for pairs, text in zip(paired, texts, strict=True):
        for p, q in pairs:
            if id(q) in text:
                rows.setdefault(id(p), []).append((q, text[id(q)]))
    for pairs in rows.values():
        if len(pairs) >= least:
            common, n = Counter(t for _, t in pairs).most_common(1)[0]
            if n >= constant * len(pairs) and n >= constant * len(trees):
                for q, t in pairs:
                    q.fixed = t == common
    # each page's varying text, by the wrapper's node that it stands under; all its text, if hardly any varies
    shares: list[dict[int, float]] = []
    above = {id(n): n.parent for n in downwards(base)}
    for t, pairs, text in zip(trees, paired, texts, strict=True):
        of, own = {id(q): p for p, q in pairs}, {}
        held = sum(len(text.get(id(q), "")) for q in downwards(t))
        varies = sum(len(text.get(id(q), "")) for q in downwards(t) if not q.fixed)
        some = 5 * varies >= held
        for q in downwards(t):
            p = of.get(id(q)) or of[id(q.parent)]
            of[id(q)] = p
            if id(q) in text and not (some and q.fixed):
                own[id(p)] = own.get(id(p), 0) + len(text[id(q)])
        total, sums = max(1, varies if some else held), {}
        for p, n in own.items():
            while p is not None:
                sums[p] = sums.get(p, 0.0) + n / total
                up = above.get(p)
                p = id(up) if up is not None else None
        if held:
            shares.append(sums)
    half = lambda n, of: sorted(s.get(id(n), 0.0) / max(s.get(id(of), 0.0), 1e-9) for s in shares)[len(shares) // 2] if shares else 0.0
    here, heads = base, []
    while inner := [k for k in here.elements() if not k.skip and k.tag in BLOCK and k.tag not in LEAVES and any(c.tag in BLOCK for c in k.elements())]:
        best = max(inner, key=lambda k: half(k, here))
        if half(best, here) < MAIN_SHARE:
            break
        heads += [k for k in here.elements() if k.tag in ("h1", "h2") and here is not base]
        here = best
    # an article element around the slot, or one within it that has most of it, settles where it ends
    up, whole = here, None
    while up is not None:
        whole, up = up if up.tag in WHOLE else whole, up.parent
    if whole is None:
        whole = next((n for n in downwards(here) if n.tag in WHOLE and half(n, here) >= 0.5), here)
    mains = {id(whole)} | {id(k) for k in heads if whole is here}
    left = []
    for i, (t, pairs) in enumerate(zip(trees, paired, strict=True)):
        found = [q for p, q in pairs if id(p) in mains]
        if any(p is whole for p, _ in pairs):
            for q in found:
                q.main = True
            inside = [k for q in found for k in downwards(q)]
            fixed = sum(len(texts[i].get(id(k), "")) for k in inside if k.fixed)
            if 2 * fixed > sum(len(texts[i].get(id(k), "")) for k in inside):  # near copies, not a template
                for k in inside:
                    k.fixed = False
        else:
            left.append(i)
    return left


def region(root: Node) -> list[Node]:
    """The main slots; without any the outermost articles, else main elements, else the body less what markup skips."""
    found = outermost(root, lambda n: n.main)
    for tag in WHOLE:
        found = found or outermost(root, lambda n, tag=tag: n.tag == tag)
    return found or [root]


def outermost(root: Node, wanted) -> list[Node]:
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if wanted(n):
            found.append(n)
        elif not n.skip:
            stack.extend(reversed(n.elements()))
    return found


def main_text(root: Node) -> str:
    """The blocks of the main region, one a line."""
    lines: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts and (line := _SPACE.sub(" ", entities.unescape("".join(parts))).strip()):
            lines.append(line)
        parts.clear()

    for top in region(root):
        todo: list = [top]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif type(n) is str:
                parts.append(n)
            elif n is not top and (n.skip or n.fixed):
                if n.tag in BLOCK:
                    flush()
            elif n.tag == "br":
                parts.append("\n")
            elif n.tag in BLOCK:
                flush()
                todo.append(None)
                todo.extend(reversed(n.kids))
            else:
                todo.extend(reversed(n.kids))
        flush()
    return "\n".join(lines)


def extract_block(pages: list[str | None]) -> list[str]:
    """Texts of pages of one host; null pages are empty. Pages of equal content are one page."""
    first: dict[str, int] = {}
    for p in pages:
        first.setdefault(p or "", len(first))
    shapes: dict = {}
    trees = [parse(p) for p in first]
    nodes = [finish(t, shapes) for t in trees]
    unique: dict[int, int] = {}
    for i, t in enumerate(trees):
        unique.setdefault(t.key, i)
    todo = [i for i in unique.values() if trees[i].size > 1]
    while len(todo) > 1:
        left = induce([trees[i] for i in todo], [nodes[i] for i in todo])
        todo = [todo[i] for i in left] if len(left) < len(todo) else []
    for i, t in enumerate(trees):
        if (k := unique[t.key]) != i:
            for mine, its in zip(nodes[i], nodes[k], strict=True):
                mine.fixed, mine.main = its.fixed, its.main
    texts = [main_text(t) for t in trees]
    return [texts[first[p or ""]] for p in pages]


def host_of(url: str = "url"):
    """The host of a URL in lower case, without scheme, port and user; null or strange URLs share the host ''."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def one_each(pages: DataFrame, key: list[str]) -> DataFrame:
    """Rows of pages (key and html), each content at most once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for pdf in batches:
            keep = []
            for i, name in enumerate(pdf[key].itertuples(index=False, name=None)):
                if name not in seen:
                    seen.add(name)
                    keep.append(i)
            if keep:
                yield pdf.iloc[keep]

    return pages.mapInPandas(run, pages.schema)


def extract(pages: DataFrame, block_pages: int = BLOCK_PAGES, max_hosts: int = 100_000, most_copies: int = MOST_COPIES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty pages give an empty text. Pages are dealt by a hash of their content into blocks of about
    block_pages distinct contents of a host, so a hot host spreads over many tasks and the same contents
    meet on any cluster; a host of one content has no template, only its markup. A content with more than
    most_copies copies in its host is worked on once, and its text joined to the copies, so they gather
    nowhere, whatever their ids. Beyond max_hosts hosts their counts are joined instead of broadcast. Pages
    may be nested to any depth; nodes with very many children are matched in a band. Repeated rows and null
    ids each give a row of their own; other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", host_of().alias("_host"), F.coalesce("html", F.lit("")).alias("html"))
    p = own.withColumns({"_h": F.xxhash64("html"), "_k": F.xxhash64(F.lit(7), F.col("html"))})
    key = ["_host", "_h", "_k"]
    contents = spill(p.groupBy(*key).agg(F.count("*").alias("copies")), "contents")
    counts = contents.groupBy("_host").agg(F.count("*").alias("_n"))
    small = counts.limit(max_hosts + 1).count() <= max_hosts
    often = spill(contents.filter(F.col("copies") > most_copies).select(*key), "often")
    hot = often.limit(1).count() > 0
    rows = p.withColumn("rep", F.lit(False))
    if hot:
        few = one_each(p.join(often, key, "left_semi").select(*key, "html"), key)
        rows = rows.join(often, key, "left_anti").unionByName(few.withColumn("rep", F.lit(True)), allowMissingColumns=True)
    dealt = rows.join(F.broadcast(counts) if small else counts, "_host").withColumn("_block", F.pmod(F.xxhash64("_k"), F.ceil(F.col("_n") / block_pages)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = extract_block(pdf.sort_values(["_h", "_k"], kind="stable")["html"].tolist())
        pdf = pdf.sort_values(["_h", "_k"], kind="stable")[["page_id", "url", *key, "rep"]]
        return pdf.assign(text=text, n_chars=[len(t) for t in text])

    out = dealt.groupBy("_host", "_block").applyInPandas(run, "page_id string, url string, _host string, _h long, _k long, rep boolean, text string, n_chars long")
    columns = [F.col("page_id").cast("long").alias("page_id"), "url", "text", "n_chars"]
    if not hot:
        return out.select(*columns)
    done = spill(out, "texts")
    texts = done.filter("rep").select(*key, "text", "n_chars").dropDuplicates(key)
    copies = p.drop("html").join(often, key, "left_semi").join(texts, key)
    return done.filter(~F.col("rep")).select(*columns).unionByName(copies.select(*columns))
