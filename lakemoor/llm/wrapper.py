"""Main text of HTML pages by wrapper induction over the pages of each host.

Pages of a host come from few templates. Their trees of line elements are aligned by simple tree
matching (the largest common tree in order, by dynamic programming over children), which merges
them into one tree a host. Nodes count what their pages hold: texts that most pages have in the
same place are template, places whose text varies are content. Siblings that look alike (paragraphs, items of a
list) are one repeated node. From the merged tree come a wrapper: the constant texts of each node,
nodes that are not the article (marked by name, class or role, or lists of links on most pages), and the region
that holds most of the text that varies. Then each page is aligned with its host's wrapper: the
article is the page's own ``article`` (else ``main``) element, else the wrapper's region.

* Each task merges the pages of a host that it reads; merged trees (bounded in nodes and texts, not
  by the pages behind them) meet in groups of FAN, in as many rounds as the number of tasks asks for, so the
  pages of a hot host are never in one task.
* Pages join the wrappers by host: a plain join with a small table that is written first, so Spark
  broadcasts it if its size allows, and else AQE splits a hot host on the side of the pages.

Bounds: a node remembers MOST_TEXTS texts (the most frequent ones, counted too low by at most one in
MOST_TEXTS of the node's texts, and by SELDOM of the pages of each merged part), a tree MOST_NODES nodes. What a tree has no room for is judged by
its own marks; no text is lost by it. Constant texts count from LEAST_PAGES pages of a host on.
Where they are more than half of an article they are kept: that page is a copy of many others.

Defined results: null or empty html, and pages without an article text, give an empty text; a null url, or one
without a host, belongs to the host of that kind; repeated rows each get their text; an empty table gives
no rows; other columns are not read. A ``br`` is white space inside its block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import query, table
from lakemoor.llm.dom import HEADINGS, Node, Page, marked, parse
from lakemoor.session import pinned

ALIKE = 0.7  # siblings with so much of their trees in common are one repeated node
MOST_TEXTS, MOST_NODES = 128, 1500
SELDOM = 0.05  # of a part's pages: texts on fewer are forgotten when parts meet
LEAST_PAGES, CONSTANT = 4, 0.7  # a text on so many of a node's pages is part of the template
LINKS, LEAST_LINKS = 0.9, 3  # a list of which so much is links
HELD = 100_000  # nodes of unfinished trees a task holds
FAN = 32

_LINES = frozenset({"p", "li", "blockquote", "pre", "dt", "dd", "figcaption", "tr"}) | HEADINGS
_NAMED = frozenset({"article", "main", "body"}) | _LINES  # elements whose name says what they are


def _comparable(a: Node, b: Node) -> bool:
    if a.tag != b.tag or marked(a.tag, a.tokens) != marked(b.tag, b.tokens):
        return False
    return a.tag in _NAMED or a.tokens == b.tokens or 3 * len(a.tokens & b.tokens) > len(a.tokens | b.tokens)


class Matching:
    """Simple tree matching of two trees: how many nodes they share, and which children go together."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def of(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """The nodes of the largest match of two comparable trees, and its pairs of children."""
        if not a.kids or not b.kids:
            return 1, []
        key = (id(a), id(b))
        if key not in self.known:
            self.known[key] = self._children(a.kids, b.kids)
        return self.known[key]

    def _children(self, left: list[Node], right: list[Node]) -> tuple[int, list[tuple[int, int]]]:
        gain = [[self.of(x, y)[0] if _comparable(x, y) else 0 for y in right] for x in left]
        best = [[0] * (len(right) + 1)]
        for row in gain:
            above, own = best[-1], [0]
            for j, value in enumerate(row):
                own.append(max(above[j + 1], own[j], above[j] + value if value else 0))
            best.append(own)
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return 1 + best[-1][-1], pairs[::-1]


def _alike(a: Node, b: Node, matching: Matching) -> bool:
    return _comparable(a, b) and 2 * matching.of(a, b)[0] > ALIKE * (a.size + b.size)


def _add_texts(own: dict, other: dict, same_page: bool) -> None:
    """Sum counts of texts, keeping the MOST_TEXTS most frequent ones less what fell out (Misra-Gries)."""
    for key, n in other.items():
        own[key] = max(own.get(key, 0), n) if same_page else own.get(key, 0) + n
    if len(own) > MOST_TEXTS and not same_page:
        less = sorted(own.values(), reverse=True)[MOST_TEXTS]
        for key in [key for key, n in own.items() if n <= less]:
            del own[key]
        for key in own:
            own[key] -= less


def merge(into: Node, other: Node, matching: Matching, same_page: bool = False, room: int = MOST_NODES) -> None:
    """Take ``other`` (which is used up) into a comparable tree; what it has alone is put in where it stands."""
    pairs = matching.of(into, other)[1]
    if not same_page:
        into.pages += other.pages
    into.times += other.times
    into.chars += other.chars
    into.link_chars += other.link_chars
    into.members += other.members
    _add_texts(into.texts, other.texts, same_page)
    if other.kids:
        partner = {j: i for i, j in pairs}
        kids, at = [], 0
        for j, kid in enumerate(other.kids):
            if j in partner:
                kids += into.kids[at : partner[j] + 1]
                at = partner[j] + 1
                merge(kids[-1], kid, matching, same_page, room)
            elif into.size + kid.size <= room:
                kids.append(kid)
        into.kids = kids + into.kids[at:]
    into.size = 1 + sum(kid.size for kid in into.kids)


def folded(page: Page) -> Node:
    """The tree of a page with siblings that look alike in one node, which lists its members."""
    nodes = page.nodes
    for at, node in enumerate(nodes):
        node.members = [at]
    for block in page.blocks:
        node = nodes[block.node]
        node.chars += len(block.text)
        node.link_chars += block.link_chars
        node.texts[block.key] = 1
    for at in range(len(nodes) - 1, 0, -1):  # children stand behind their parents, and are whole before them
        nodes[page.parents[at]].kids.append(nodes[at])
    for node in reversed(nodes):
        kids: list[Node] = []
        for kid in reversed(node.kids):
            matching = Matching()
            same = next((one for one in kids if _alike(one, kid, matching)), None)
            if same is None:
                kids.append(kid)
            else:
                merge(same, kid, matching, same_page=True)
        node.kids = kids
        node.size = 1 + sum(kid.size for kid in kids)
    return nodes[0]


class Wrapper:
    """What the merged tree of a host tells about its pages."""

    def __init__(self, tree: Node) -> None:
        self.tree = tree
        self.constant: dict[int, frozenset] = {}  # by id of a node
        self.dropped: set[int] = set()
        self.cleared: set[int] = set()  # marked nodes that hold the article all the same
        self._weigh(tree)
        raw = self._sum(tree, lambda node: self._own[id(node)])
        self._judge(tree, raw[id(tree)] / 2, raw)
        left = self._sum(tree, lambda node: 0 if id(node) in self.dropped else self._own[id(node)], self.dropped)
        self.region, above = tree, None
        while True:
            kids = [kid for kid in self.region.kids if id(kid) not in self.dropped]
            most = max(kids, key=lambda kid: left[id(kid)], default=None)
            if most is None or 2 * left[id(most)] <= left[id(self.region)]:
                break
            if most.tag in _LINES or 2 * most.times > 3 * most.pages:
                break
            self.region, above = most, self.region
        # Headings right before the region belong to it.
        self.headings: list[Node] = []
        if above is not None:
            for kid in reversed(above.kids[: above.kids.index(self.region)]):
                if kid.tag not in HEADINGS or id(kid) in self.dropped:
                    break
                self.headings.append(kid)

    def _weigh(self, tree: Node) -> None:
        self._own: dict[int, int] = {}
        for node in _walk(tree):
            texts = node.texts.items() if node.pages >= LEAST_PAGES else ()
            constant = {key: n for key, n in texts if n >= CONSTANT * node.pages}
            self.constant[id(node)] = frozenset(constant)
            fixed = sum(n * key[1] for key, n in constant.items())
            self._own[id(node)] = max(node.chars - node.link_chars - fixed, 0)

    def _sum(self, tree: Node, own, without: set[int] = frozenset()) -> dict[int, int]:
        total: dict[int, int] = {}
        for node in reversed(list(_walk(tree))):
            total[id(node)] = own(node) + sum(total[id(kid)] for kid in node.kids if id(kid) not in without)
        return total

    def _judge(self, tree: Node, half: float, raw: dict[int, int]) -> None:
        chars = self._sum(tree, lambda node: node.chars)
        links = self._sum(tree, lambda node: node.link_chars)
        for node in _walk(tree):
            if marked(node.tag, node.tokens):
                holds = raw[id(node)] > half and any(
                    one.tag in ("article", "main", "h1") and not marked(one.tag, one.tokens) for one in _walk(node)
                )
                (self.cleared if holds else self.dropped).add(id(node))
            elif node.tag not in _LINES and 2 * node.pages >= tree.pages >= LEAST_PAGES:
                lines = sum(one.times for one in _walk(node) if one.chars)
                if lines >= LEAST_LINKS * node.pages and links[id(node)] >= LINKS * chars[id(node)] > 0:
                    self.dropped.add(id(node))

    def compact(self) -> tuple:
        """The wrapper as plain values: nodes in order with their number of children."""
        return [
            (
                node.tag, node.tokens, len(node.kids), self.constant[id(node)], id(node) in self.dropped,
                id(node) in self.cleared, node is self.region, any(node is one for one in self.headings),
            )
            for node in _walk(self.tree)
        ]


def _walk(tree: Node) -> Iterator[Node]:
    """A tree's nodes, each before its children."""
    rest = [tree]
    while rest:
        node = rest.pop()
        yield node
        rest.extend(reversed(node.kids))


class Extractor:
    """Takes the articles out of the pages of one host."""

    def __init__(self, compact: list[tuple]) -> None:
        nodes = [Node(one[0], one[1]) for one in compact]
        waiting: list[tuple[Node, int]] = []
        for node, one in zip(nodes, compact):
            if waiting:
                above, missing = waiting.pop()
                above.kids.append(node)
                if missing > 1:
                    waiting.append((above, missing - 1))
            if one[2]:
                waiting.append((node, one[2]))
        self.tree = nodes[0]
        self.told = {id(node): one[3:] for node, one in zip(nodes, compact)}

    def text(self, html: str) -> str:
        page = parse(html)
        tokens = [(node.tag, node.tokens) for node in page.nodes]
        told = self._aligned(folded(page), len(tokens))
        dropped = [
            one is not None and one[1] or marked(*own) and not (one is not None and one[2])
            for own, one in zip(tokens, told)
        ]
        for at in range(1, len(dropped)):
            dropped[at] = dropped[at] or dropped[page.parents[at]]
        inside = self._region(page, [own[0] for own in tokens], told, dropped)
        blocks = [block for block in page.blocks if inside[block.node] and not dropped[block.node]]
        fixed = [block for block in blocks if told[block.node] is not None and block.key in told[block.node][0]]
        if fixed:
            # Where most of an article itself is constant, the page is one of many copies.
            size = sum(len(block.text) for block in fixed)
            whole = 1 if inside[0] else 2
            if whole * size <= sum(len(block.text) for block in blocks) and len(fixed) < len(blocks):
                gone = set(map(id, fixed))
                blocks = [block for block in blocks if id(block) not in gone]
        return "\n".join(block.text for block in blocks)

    def _aligned(self, page: Node, size: int) -> list[tuple | None]:
        """For each node of a page, what the wrapper tells about it."""
        told: list[tuple | None] = [None] * size
        matching, rest = Matching(), [(self.tree, page)]
        while rest:
            own, other = rest.pop()
            for member in other.members:
                told[member] = self.told[id(own)]
            rest += [(own.kids[i], other.kids[j]) for i, j in matching.of(own, other)[1]]
        return told

    def _region(self, page: Page, tags: list[str], told: list, dropped: list[bool]) -> list[bool]:
        """Which nodes are the article, or parts of it."""
        filled = [False] * len(tags)
        for block in page.blocks:
            filled[block.node] = not dropped[block.node] or filled[block.node]
        for at in range(len(tags) - 1, 0, -1):
            filled[page.parents[at]] = filled[page.parents[at]] or filled[at]
        for name in ("article", "main"):
            tops = [at for at, tag in enumerate(tags) if tag == name and not dropped[at] and filled[at]]
            if tops:
                return self._below(page, set(tops))
        tops = {at for at, one in enumerate(told) if one is not None and (one[3] or one[4])}
        if any(filled[at] and told[at][3] for at in tops):
            return self._below(page, tops)
        return [True] * len(tags)

    def _below(self, page: Page, tops: set[int]) -> list[bool]:
        inside: list[bool] = []
        for at, above in enumerate(page.parents):
            inside.append(at in tops or (above >= 0 and inside[above]))
        return inside


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree for the pages of each host in this task."""
    part = TaskContext.get().partitionId()
    trees: dict[str, Node] = {}
    held = 0
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            tree = folded(parse(html))
            for node in _walk(tree):
                node.members = []
            before = trees[host].size if host in trees else 0
            if host in trees:
                merge(trees[host], tree, Matching())
            else:
                trees[host] = tree
            held += trees[host].size - before
            if held > HELD:
                yield _parts(trees, part)
                trees, held = {}, 0
    if trees:
        yield _parts(trees, part)


def _parts(trees: dict[str, Node], part: int) -> pa.RecordBatch:
    columns = [
        pa.array(list(trees), pa.string()),
        pa.array([part] * len(trees), pa.int64()),
        pa.array([pickle.dumps(_forgetting(tree)) for tree in trees.values()], pa.binary()),
    ]
    return pa.record_batch(columns, names=["host", "part", "tree"])


def _forgetting(tree: Node) -> Node:
    for node in _walk(tree):
        least = SELDOM * node.pages
        node.texts = {key: n for key, n in node.texts.items() if n > least}
    return tree


def _meet(parts: pa.Table) -> pa.Table:
    """The trees of one host and of neighbouring parts as one."""
    parts = parts.sort_by([("part", "ascending"), ("tree", "ascending")])
    tree = None
    for raw in parts.column("tree"):
        other = pickle.loads(raw.as_py())
        if tree is None:
            tree = other
        else:
            merge(tree, other, Matching())
    group = pa.array([parts.column("part")[0].as_py() // FAN], pa.int64())
    tree = pa.array([pickle.dumps(_forgetting(tree))], pa.binary())
    return pa.table([parts.column("host").slice(0, 1), group, tree], names=["host", "part", "tree"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [pickle.dumps(Wrapper(pickle.loads(raw)).compact()) for raw in batch.column("tree").to_pylist()]
        yield pa.record_batch([batch.column("host"), pa.array(made, pa.binary())], names=["host", "wrapper"])


def hosts_of(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and host ('' where a url has none)."""
    host = F.regexp_extract(F.lower("url"), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("")).alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of each host of ``hosts_of`` pages."""
    schema = "host string, part long, tree binary"
    parts = pinned(pages.select("host", "html").mapInArrow(_induce, schema))
    last = parts.agg(F.max("part")).first()[0]
    rounds = 1
    while last is not None and last >= FAN**rounds:
        rounds += 1
    for _ in range(rounds):
        parts = parts.groupBy("host", F.floor(F.col("part") / FAN)).applyInArrow(_meet, schema)
    return pinned(parts.mapInArrow(_finish, "host string, wrapper binary"))


_NONE = Node("body").tag, frozenset(), 0, frozenset(), False, False, True, False


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, Extractor] = {}
    for batch in batches:
        texts = []
        for html, raw in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if raw not in known:
                if len(known) > 1000:
                    known.clear()
                known[raw] = Extractor(pickle.loads(raw) if raw is not None else [_NONE])
            texts.append(known[raw].text(html))
        sizes = pa.array([len(text) for text in texts], pa.int64())
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
        yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, ``text`` (the article's blocks, a line each) and n_chars of each row of ``pages``."""
    pages = hosts_of(pages)
    kind = dict(pages.dtypes)
    joined = pages.join(wrappers(pages), "host", "left").select("page_id", "url", "html", "wrapper")
    schema = f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"
    return joined.mapInArrow(_extract, schema)


@query()
def op13_induced_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
