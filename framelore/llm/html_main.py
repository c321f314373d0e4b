"""Main text of web pages by wrapper induction.

Pages are parsed into trees of blocks. The trees of one host are aligned by simple tree matching: two nodes match if tag and class
agree, and children are matched in order with the greatest total of matched nodes. Siblings with one label are matched one by
one; where their number differs between pages they are one repeated node. Folding a host's pages gives its wrapper. Each page is then aligned with
it, and what stands at each node is counted over all pages: a text that most of a host's different pages have at a node is template, the
others fill slots. How much text a slot takes on the average leads to the main region of a page: from the root down to the child that
holds most of it, as long as there is one. The main text is what fills the slots of that region; elements whose tag, role, class or id marks them as
furniture, and nodes that hold links only, are left out.

Copies of an article are one content, whatever stands around them: a page is known by its two longest texts, and a text is counted once for each different
pair of the two longest other texts of its pages. Pages of hosts with fewer than `pages` pages share slots with all such pages whose trees are alike.

Wrappers are folded within partitions and merged by host in two salted levels, and counts are grouped sums, so a hot host is never gathered. The sizes
of wrappers and counts are measured: small ones go to every task, larger ones are joined to the pages.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, stored

# HTML element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside blockquote body dl fieldset figure footer form header html main menu nav ol section table td th ul div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HOLDERS = frozenset("html div section main article center table tbody tr td".split())  # blocks that may be the main region
PROSE = frozenset("#text p pre".split())
FURNITURE = frozenset("nav aside footer form menu button select input dialog head script style noscript template iframe svg math textarea object embed audio video canvas title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = re.compile(r"(?:^|[^a-z])(?:nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|topbar|footer|foot|colophon|sidebars?|side|aside|rail|widgets?|ads?|advert(?:s|isement|isements|ising)?|adslot|banners?|promos?|promotion|sponsor(?:ed|s)?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|paywall|login|search|share|sharing|social|related|recommended|recommendations|pagination|pager|comments?|commentlist|replies|reply|respond|responses|discussion|disqus|forms?|copyright|skip|hidden)(?:$|[^a-z])")
KEEP = re.compile(r"(?:^|[^a-z])(?:article|content|post|entry|story|main|body|text)(?:$|[^a-z])")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
RUNS = 48  # a node with more runs of children than these has them folded by label


class Node:
    __slots__ = ("attrs", "holds", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.holds = tag, attrs, [], False  # kids: nodes and strings; holds: a block is below

    def attr(self) -> dict[str, str]:
        return {k.lower(): entities.unescape(v[1:-1] if v[:1] in "\"'" and v else v) for k, v in _ATTR.findall(self.attrs)} if self.attrs.strip(" /") else {}


def parse(text: str | None) -> Node:
    """A tree of the whole page, in linear time; never fails. Unclosed and misnested elements are closed as a browser would, roughly.

    A tag that is not finished by the end of the page is dropped; a quote that is never closed is no quote.
    """
    root = Node("#root")
    stack, at, text = [root], 0, text or ""
    size, quoted = len(text), True
    last = {q: text.rfind(q) for q in "\"'"}
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    scopes = [0]  # where in the stack elements stand that an end tag inside them does not close

    def close(depth: int) -> None:
        for n in reversed(stack[depth:]):
            places[n.tag].pop()
            if n.tag in SCOPE:
                scopes.pop()
        del stack[depth:]

    def top(tag: str) -> int:
        return places[tag][-1] if places[tag] else -1

    def add(node: Node) -> None:
        stack[-1].kids.append(node)
        if node.tag in BLOCK:
            for n in reversed(stack):
                if n.holds:
                    break
                n.holds = True

    while at < size:
        start = text.find("<", at)
        if start < 0:
            stack[-1].kids.append(text[at:])
            break
        if start > at:
            stack[-1].kids.append(text[at:start])
        sign = text[start + 1 : start + 2]
        if sign in ("!", "?"):
            ends = ("-->", start + 4) if text.startswith("<!--", start) else ("]]>", start + 9) if text.startswith("<![CDATA[", start) else (">", start + 2)
            stop = text.find(*ends)
            if ends[0] == "]]>":
                stack[-1].kids.append(entities.escape(text[start + 9 : stop if stop >= 0 else size]))
            at = stop + len(ends[0]) if stop >= 0 else size
            continue
        ending = sign == "/"
        m = _NAME.match(text, start + 1 + ending)
        if m is None:
            stack[-1].kids.append("<")
            at = start + 1
            continue
        tag, stop = m[0].lower(), m.end()
        while True:  # the end of the tag; quotes after = hide a >
            e = _END.search(text, stop)
            if e is None or e[0] == ">":
                break
            stop = text.find(e[1], e.end()) + 1 if quoted and last[e[1]] >= e.end() else e.end()
        if e is None and quoted and text.find(">", m.end()) >= 0:
            quoted = False  # quotes do not pair up on this page
            e = re.compile(">").search(text, m.end())
        if e is None:
            break
        attrs, at = text[m.end() : e.start()], e.end()
        if ending:
            if tag == "p" and not places["p"]:
                add(Node("p"))
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            elif top(tag) >= 0 and (tag in BLOCK or top(tag) >= scopes[-1]):
                close(top(tag))  # an inline end tag does not close a block
            continue
        if tag in CLOSES_P or tag in SAME:
            found = max(top(t) for t in SAME.get(tag, ("p",)))
            if found > 0 and found >= scopes[-1]:
                close(found)
        node = Node(tag, attrs)
        add(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(text, at)
            node.kids.append(text[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        places[tag].append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    return root


def furniture(node: Node) -> bool:
    """Whether a node's tag, role, class or id says that it and all below it is no main text."""
    if node.tag in FURNITURE:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    found = node.attr()
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower()
    return bool(MARKS.search(names)) and not (KEEP.search(names) and not re.search(r"comment|reply|sidebar|foot|nav|\bads?\b|related|share", names))


def _label(node: Node) -> str:
    return f"{node.tag}.{re.sub(r'[0-9]+', '0', node.attr().get('class', ''))}" if node.attrs else node.tag


class Page:
    """A page's blocks in page order: label, parent, text (None: it holds other blocks) and how many of its signs stand in links."""

    __slots__ = ("label", "links", "parent", "text")

    def __init__(self, text: str | None):
        self.label, self.parent, self.text, self.links = ["#root"], [-1], [None], [0]
        pieces: list[str] = []
        linked = 0

        def flush(label: str, at: int) -> None:
            nonlocal linked
            if told := " ".join("".join(pieces).split()):
                self._add(label, at, told, min(linked, len(told)))
            pieces.clear()
            linked = 0

        work: list[tuple] = [(parse(text), 0, False)]
        while work:  # a stack: pages can nest deeply
            n, at, inside = work.pop()
            if isinstance(n, tuple):
                flush(n[0], at)
            elif isinstance(n, str):
                told = entities.unescape(n) if "&" in n else n
                pieces.append(told)
                linked += len(told.strip()) if inside else 0
            elif n.tag == "br":
                pieces.append("\n")
            elif n.tag == "#root" or not furniture(n):
                inside = inside or n.tag == "a"
                if n.tag in BLOCK:
                    flush("#text", at)
                    if n.holds:
                        at = self._add(_label(n), at, None, 0)
                        work.append((("#text",), at, False))
                    else:
                        work.append(((_label(n),), at, False))
                work += [(k, at, inside) for k in reversed(n.kids)]
        flush("#text", 0)

    def _add(self, label: str, parent: int, text: str | None, links: int) -> int:
        self.label.append(label)
        self.parent.append(parent)
        self.text.append(text)
        self.links.append(links)
        return len(self.label) - 1


# A tree node is [label, runs, mixed, number]; a run is [repeated, nodes] of neighbours with one label, a single node if repeated. A mixed
# node has each label once, in no order.


def tree(page: Page) -> list:
    nodes = [[label, [], 0, i] for i, label in enumerate(page.label)]
    for n, p in zip(nodes[1:], page.parent[1:]):
        runs = nodes[p][1]
        if runs and runs[-1][1][0][0] == n[0]:
            runs[-1][1].append(n)
        else:
            runs.append([0, [n]])
    return nodes[0]


def score(a: list, b: list, known: dict) -> int:
    """Simple tree matching: the greatest number of nodes that match, for nodes with one label."""
    key = id(a), id(b)
    if key not in known:
        known[key] = 1 + sum(w for _, _, w in _aligned(a[1], b[1], known))
    return known[key]


def _aligned(x: list, y: list, known: dict) -> list[tuple[int, int, int]]:
    """The matched pairs of two lists of runs with their scores, in order, of the greatest total."""
    p, q = [r[1][0][0] for r in x], [r[1][0][0] for r in y]
    own = [[score(r[1][0], s[1][0], known) if a == b else 0 for b, s in zip(q, y)] for a, r in zip(p, x)]
    if p == q and len(set(p)) == len(p):  # nothing to choose
        return [(i, i, own[i][i]) for i in range(len(p))]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(q) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + own[i - 1][j - 1])
    out, i, j = [], len(p), len(q)
    while i and j:
        if own[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + own[i - 1][j - 1]:
            out.append((i - 1, j - 1, own[i - 1][j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def pairs(x: list, y: list, known: dict) -> list[tuple[int, int]]:
    p, q = [r[1][0][0] for r in x], [r[1][0][0] for r in y]
    if p == q and len(set(p)) == len(p):
        return [(i, i) for i in range(len(p))]
    return [(i, j) for i, j, _ in _aligned(x, y, known)]


def merge(a: list, b: list, known: dict) -> list:
    """The tree that both nodes' trees are part of."""
    if a[2] or b[2]:
        return [a[0], _by_label([*a[1], *b[1]], known), 1, 0]
    runs, i, j = [], 0, 0
    for p, q in [*pairs(a[1], b[1], known), (len(a[1]), len(b[1]))]:
        runs += a[1][i:p] + b[1][j:q]
        if p < len(a[1]):
            (more, some), (again, others) = a[1][p], b[1][q]
            if not more and not again and len(some) == len(others):
                runs.append([0, [merge(m, n, known) for m, n in zip(some, others)]])
            else:
                runs.append([1, [_one([*some, *others], known)]])
        i, j = p + 1, q + 1
    return [a[0], _by_label(runs, known), 1, 0] if len(runs) > RUNS else [a[0], runs, 0, 0]


def _one(nodes: list, known: dict) -> list:
    first = nodes[0]
    for n in nodes[1:]:
        first = merge(first, n, known)
    return first


def _by_label(runs: list, known: dict) -> list:
    out: dict[str, list] = {}
    for r in runs:
        out.setdefault(r[1][0][0], []).extend(r[1])
    return [[1, [_one(nodes, known)]] for nodes in out.values()]


def collapsed(node: list) -> list:
    """A page's tree with every run as one repeated node."""
    return [node[0], [[1, [_one([collapsed(n) for n in r[1]], {})]] for r in node[1]], 0, 0]


def dump(node: list) -> str:
    """In page order, flat, as trees can be deep."""
    out, work = [], [node]
    while work:
        n = work.pop()
        out.append([n[0], n[2], [[r[0], len(r[1])] for r in n[1]]])
        work += [k for r in reversed(n[1]) for k in reversed(r[1])]
    return json.dumps(out, separators=(",", ":"))


def load(told: str) -> list:
    """dump() back, nodes numbered."""
    first, places = None, []
    for i, (label, mixed, runs) in enumerate(json.loads(told)):
        node = [label, [[more, []] for more, _ in runs], mixed, i]
        if places:
            places.pop().append(node)
        else:
            first = node
        places += [r[1] for r, (_, n) in zip(reversed(node[1]), reversed(runs)) for _ in range(n)]
    return first


def numbers(page: list, wrapper: list, size: int) -> list[int]:
    """The number of the wrapper's node for each of a page's, -1 for none."""
    out, work, known = [-1] * size, [(page, wrapper)], {}
    while work:
        n, w = work.pop()
        out[n[3]] = w[3]
        if w[2]:
            at = {r[1][0][0]: r for r in w[1]}
            both = [(r, at[r[1][0][0]]) for r in n[1] if r[1][0][0] in at]
        else:
            both = [(n[1][i], w[1][j]) for i, j in pairs(n[1], w[1], known)]
        for r, s in both:
            work += [(k, s[1][0 if s[0] else min(i, len(s[1]) - 1)]) for i, k in enumerate(r[1])]
    return out


def wrappers(pages: DataFrame, least: int) -> DataFrame:
    """pages(host, html) -> (host, w) of the hosts with at least so many pages, over every page."""

    def local(batches):
        from pyspark import TaskContext

        sys.setrecursionlimit(1_000_000)  # trees are as deep as pages nest
        found: dict[str, list] = {}
        salt = TaskContext.get().partitionId() % 32

        def told():
            return pd.DataFrame([(h, salt, n, dump(w)) for h, (n, w) in found.items()], columns=["host", "salt", "n", "w"])

        for b in batches:
            for host, text in zip(b["host"], b["html"]):
                n, w = found.get(host, (0, None))
                own = tree(Page(text))
                found[host] = n + 1, merge(own if w is None else w, own, {})
            if len(found) > 20_000:
                yield told()
                found = {}
        if found:  # no empty frames: an empty string column does not convert
            yield told()

    def together(salted: bool):
        def run(batches):
            sys.setrecursionlimit(1_000_000)
            held, n, w = None, 0, None

            def told():
                return pd.DataFrame([(held[0], *([held[1]] if salted else []), n, dump(w))], columns=["host", *(["salt"] if salted else []), "n", "w"])

            for b in batches:
                for key, more, raw in zip(zip(b["host"], b["salt"]) if salted else zip(b["host"]), b["n"], b["w"]):
                    if key != held and held is not None:  # sorted by key
                        yield told()
                    n, w = (more, load(raw)) if key != held else (n + more, merge(w, load(raw), {}))
                    held = key
            if held is not None:
                yield told()

        return run

    kind = "host string, salt int, n long, w string"
    parts = pages.mapInPandas(local, kind).repartition("host", "salt").sortWithinPartitions("host", "salt").mapInPandas(together(True), kind)
    return parts.drop("salt").repartition("host").sortWithinPartitions("host").mapInPandas(together(False), "host string, n long, w string").where(F.col("n") >= least).select("host", "w")


_KINDS = "key string, node array<int>, parent array<int>, head array<int>, text array<string>, links array<int>, hash array<long>, top array<long>"


HEADING, HEADER, BODY, HOLDER, TEXT = range(1, 6)


def _head(tag: str) -> int:
    return HEADING if tag in HEADINGS else HEADER if tag == "header" else BODY if tag == "body" else HOLDER if tag in HOLDERS else TEXT if tag in PROSE else 0


def blocks(html: str | None, host: str, wrapper: str | list | None) -> tuple:
    """A page's row of _KINDS: its blocks, numbered by its host's wrapper or, without one, by its own tree."""
    from hashlib import blake2b

    from xxhash import xxh64_intdigest

    page = Page(html)
    own = tree(page)
    if wrapper is None:
        raw = dump(collapsed(own))
        key, wrapper = "#" + blake2b(raw.encode(), digest_size=16).hexdigest(), load(raw)
    else:
        key = host
    hashes = [0 if t is None else xxh64_intdigest(t) - (1 << 63) for t in page.text]
    top = list(dict.fromkeys(h for _, h in sorted((-len(t), h) for t, h in zip(page.text, hashes) if t is not None)))[:3]
    heads = [_head(x.split(".")[0]) for x in page.label]
    return key, numbers(own, wrapper, len(page.label)), page.parent, heads, page.text, page.links, hashes, top


def slots(rows: DataFrame, share: float, pages: int) -> DataFrame:
    """Blocks' rows -> (key, node, mean, linked, fixed): over the different contents that have a node, its mean length of text that is neither
    template nor link, its share of link text, and the texts (hashes) that are template."""
    each = rows.select("key", "top", F.explode(F.arrays_zip("node", "hash", "links", F.transform("text", lambda t: F.length(t)).alias("chars"))).alias("b")).where("b.chars is not null and b.node >= 0")
    others = F.slice(F.array_remove("top", F.col("b.hash")), 1, 2)
    each = each.select("key", "b.node", "b.hash", "b.links", "b.chars", F.xxhash64(others).alias("other"), F.xxhash64(F.slice("top", 1, 2)).alias("page"))
    each = stored(each.groupBy("key", "node", "hash", "other", "page").agg(F.max("chars").alias("chars"), F.max("links").alias("links")), "html-counts")
    n = each.groupBy("key", "node", "page").agg(F.lit(1).alias("one")).groupBy("key", "node").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("key", "node", "hash", "other").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    total = each.groupBy("key", "node").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    often = each.groupBy("key", "node", "hash").agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("chars"), F.sum("links").alias("links")).where(F.col("c") >= pages)
    fixed = often.join(n, ["key", "node"]).where(F.col("c") >= share * F.col("n")).groupBy("key", "node").agg(F.collect_list("hash").alias("fixed"), F.sum(F.col("chars") - F.col("links")).alias("off"))
    found = total.join(n, ["key", "node"]).join(fixed, ["key", "node"], "left").where("n >= 2")
    mean = (F.col("chars") - F.col("links") - F.coalesce("off", F.lit(0))) / F.col("n")
    return found.select("key", "node", mean.alias("mean"), (F.col("links") / F.col("chars")).alias("linked"), F.coalesce("fixed", F.expr("cast(array() as array<bigint>)")).alias("fixed"))


def main_text(row, known: dict[int, tuple[float, float, frozenset]]) -> str:
    """The main text of a page's blocks; known: of its wrapper's nodes mean, linked and fixed, as slots() gives."""
    parent, text, node = row["parent"], row["text"], row["node"]
    size = len(parent)
    used = Counter(k for k, t in zip(node, text) if t is not None)
    weight = [0.0] * size
    for i in range(size):
        if text[i] is not None:
            weight[i] = known[node[i]][0] / used[node[i]] if node[i] in known else float(len(text[i]) - row["links"][i])
    kids: list[list[int]] = [[] for _ in range(size)]
    for i in range(size - 1, 0, -1):
        weight[parent[i]] += weight[i]
        kids[parent[i]].append(i)
    at, head = 0, row["head"]
    while True:  # the region: down to the block that holds most of the text, unless headings or prose stand beside it
        some = [k for k in kids[at] if text[k] is None and head[k] in (BODY, HOLDER) and weight[k] >= 0.5 * weight[at] > 0]
        site = head[at] in (0, BODY) or at == 0 or parent[at] == 0  # a header of the body is the site's, and a short line beside the text may be a notice
        beside = sum(weight[k] for k in kids[at] if text[k] is not None and head[k] == TEXT)
        if not some or any(head[k] == HEADING or head[k] == HEADER and not site for k in kids[at]) or beside > (0.05 * weight[at] if site else 0):
            break
        at = max(some, key=lambda k: weight[k])
    inside, out = [False] * size, []
    inside[at] = True
    for i in range(at + 1, size):
        p = parent[i]
        inside[i] = inside[p] and not (head[i] == HEADER and head[p] == BODY)  # a header of the body is the site's
        if inside[i] and text[i] is not None:
            mean, linked, fixed = known.get(node[i], (0.0, 0.0, ()))
            if row["hash"][i] not in fixed and linked <= 0.8:
                out.append(text[i])
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_bytes: int = 8 << 20, share: float = 0.9, pages_of_host: int = 5) -> DataFrame:
    """(id_col, url_col, text), one row per row of pages; text is empty where nothing is main text.

    share: of a host's different contents with a node, as many must show a text there for it to be template, and pages_of_host at least.
    Null and empty pages have no text. Pages whose URL is null or has no host share a wrapper. Repeated rows get a row each; an
    empty table gives none; other columns are ignored. Very long and deep pages are read whole, in linear time up to the alignment of their trees.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), _HOST, 1), F.lit(""))).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = stored(wrappers(rows.where("html is not null").select("host", "html"), pages_of_host), "html-wrappers")
    kinds = f"id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}"
    names = [c.split()[0] for c in f"id x, url x, {_KINDS}".split(", ")]
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.length("w")), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast({r["host"]: r["w"] for r in found.collect()}) if size <= max_bytes else None

    def split(batches):
        sys.setrecursionlimit(1_000_000)
        read: dict[str, list] = {}
        for b in batches:
            out = []
            for i, url, host, text, raw in zip(b["id"], b["url"], b["host"], b["html"], b["w"] if shared is None else map(shared.value.get, b["host"])):
                if raw and host not in read:
                    read = read if len(read) < 1000 else {}
                    read[host] = load(raw)
                out.append((i, url, *blocks(text, host, read[host] if raw else None)))
            yield pd.DataFrame(out, columns=names)

    given = rows if shared is not None else rows.join(found, "host", "left")
    cut = stored(given.mapInPandas(split, f"{kinds}, {_KINDS}"), "html-blocks")
    held = slots(cut, share, pages_of_host).groupBy("key").agg(F.collect_list(F.struct("node", "mean", "linked", "fixed")).alias("slots"))
    held = stored(held, "html-slots")
    size = held.agg(F.coalesce(F.sum(F.length("key") + F.expr("aggregate(slots, 0L, (a, s) -> a + 24 + 8 * size(s.fixed))")), F.lit(0))).first()[0]
    known = spark.sparkContext.broadcast({r["key"]: {s["node"]: (s["mean"], s["linked"], frozenset(s["fixed"])) for s in r["slots"]} for r in held.collect()}) if size <= max_bytes else None

    def fill(batches):
        for b in batches:
            told = []
            for row in b.to_dict("records"):
                own = known.value.get(row["key"], {}) if known is not None else {s["node"]: (s["mean"], s["linked"], frozenset(s["fixed"])) for s in (row["slots"] if row["slots"] is not None else ())}
                told.append(main_text(row, own))
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": told})

    thin = cut.drop("top")
    out = (thin if known is not None else thin.join(held, "key", "left")).mapInPandas(fill, f"{kinds}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
