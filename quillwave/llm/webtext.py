"""Main text of web pages by union-free wrappers inferred per host.

Every page becomes a tree of its block elements. Repeated siblings and repeated
short sequences of siblings are folded, which leaves a small skeleton; equal
skeletons of a host are counted, not kept. The distinct skeletons of a host are
aligned, some at a time and the results again: where they differ, an element
becomes optional or repeated, and text becomes a slot. The result is one
regular expression without unions per host, its wrapper, with numbered slots.

Every page is then matched against the wrapper of its host, which puts each of
its texts into a slot. A slot is judged by what the wrapper and the matches
say: where it is, whether it repeats, how much text it holds, how much of that
is links, and whether it is the same on all pages. Elements that HTML has for
menus, footers, forms and the like count as what they are; a class name is one
vote among several. The article is the element that HTML calls so, or else the
one that holds most of the text that differs between pages.

Defined results: null html is an empty page with empty text. Pages without a
host in their url share one wrapper. Repeated rows get equal results. Extra
columns are not read. Character references are decoded; white space inside a
block becomes one space; blocks are joined by a line feed. Pages of any length
are read whole; elements nested deeper than 150 count as siblings there.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import on_batches, written

# Element names of HTML by role, and name parts that mark what is not main text.
_BLOCKS = frozenset(
    "html body article main section div header footer nav aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre "
    "figure figcaption table thead tbody tfoot tr td th caption fieldset details summary address dialog menu hr center".split()
)
_SILENT = "script|style|noscript|template|iframe|textarea|title"
_CLOSED = "svg|select|button|object"
_ASIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert nav navbar navigation menu menus sidebar side aside rail breadcrumb breadcrumbs share sharing social related "
    "recommended comment comments commentlist respond reply replies discussion disqus footer foot masthead popup modal overlay "
    "newsletter subscribe subscription signup login search pagination pager tags widget widgets copyright legal disclaimer toolbar".split()
)
_MAIN_NAMES = frozenset("article articlebody content post entry story main text body".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = frozenset("ul ol dl table menu".split())

# Without an end tag the first kind goes on to the end of the page, the second kind is a tag like others.
_GONE = re.compile(
    rf"<!--.*?(?:-->|$)|<({_SILENT})(?![\w:-])[^>]*(?:/>|>.*?(?:</\1\s*>|$))|<({_CLOSED})(?![\w:-])[^>]*(?:/>|>.*?</\2\s*>)|<[!?][^>]*>",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAMES = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SLOT = "#"
_GROUP = "()"
_LONGEST_GROUP = 4
_DEEPEST = 150
# Elements whose content is text rather than further blocks.
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())


@dataclass
class Node:
    """An element of a page or a wrapper; ``label`` is ``#`` for text and ``()`` for a group."""

    label: str
    children: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    text: list[str] = field(default_factory=list)
    linked: int = 0
    clean: str | None = None

    def packed(self) -> list:
        return [self.label, self.optional + 2 * self.repeated, [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(raw: list) -> Node:
        return Node(raw[0], [Node.unpacked(c) for c in raw[2]], bool(raw[1] & 1), bool(raw[1] & 2))


def _label(tag: str, attributes: str) -> str:
    """Element name with its class, id and role names; digits are alike."""
    if not attributes.strip():
        return tag
    names = []
    for kind, *values in _NAMES.findall(attributes):
        value = next((v for v in values if v), "").lower()
        kind = kind.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            names.append("!hidden")
        elif kind == "role":
            names.extend(f"@{v}" for v in value.split())
        elif kind != "aria-hidden":
            names.extend(re.sub(r"\d+", "0", v) for v in value.split())
    return ".".join([tag, *sorted(set(names))])


def parse(page: str) -> Node:
    """The tree of block elements of a page, with its text runs."""
    root = Node("html")
    stack, links, run = [root], 0, None
    page = _GONE.sub(" ", page)

    def add(text: str) -> None:
        nonlocal run
        if not text:
            return
        if run is None:
            run = Node(_SLOT)
            stack[-1].children.append(run)
        run.text.append(text)
        run.linked += len(text) if links else 0

    def close(position: int) -> None:
        nonlocal run
        del stack[position:]
        run = None

    at = 0
    for tag in _TAG.finditer(page):
        add(page[at : tag.start()])
        at = tag.end()
        end, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
        if name == "a":
            links = 0 if end else 1
        elif name == "br":
            add(" ")
        elif name in _BLOCKS and name not in ("html", "hr"):
            tags = [n.label.partition(".")[0] for n in stack]
            if end:
                if name in tags[1:]:
                    close(len(tags) - 1 - tags[::-1].index(name))
                continue
            if "p" in tags[1:]:
                close(len(tags) - 1 - tags[::-1].index("p"))
                tags = tags[: len(stack)]
            if name in _CLOSES:
                floor = max((i for i, t in enumerate(tags) if t in _LISTS), default=0)
                open_ = [i for i, t in enumerate(tags) if i > floor and t in _CLOSES[name]]
                if open_:
                    close(open_[0])
            links, run = 0, None
            node = Node(_label(name, attributes))
            if len(stack) == _DEEPEST:
                stack.pop()
            stack[-1].children.append(node)
            stack.append(node)
        elif name == "hr":
            run = None
    add(page[at:])
    return root


def text_of(run: Node) -> str:
    if run.clean is None:
        run.clean = " ".join(html.unescape("".join(run.text)).split())
    return run.clean


def skeleton(node: Node) -> Node:
    """The structure of a page: its tree without texts, repetitions folded."""
    return Node(node.label, folded([skeleton(c) for c in node.children if c.label != _SLOT or text_of(c)]))


def folded(children: list[Node]) -> list[Node]:
    """Join repeated siblings, then repeated sequences of siblings, into repeated ones."""
    out: list[Node] = []
    for child in children:
        if out and out[-1].label == child.label and child.label != _GROUP:
            both = merged(out[-1], child)
            both.repeated = child.label != _SLOT
            both.optional = out[-1].optional and child.optional
            out[-1] = both
        else:
            out.append(child)
    for size in range(2, _LONGEST_GROUP + 1):
        at = 0
        while at + 2 * size <= len(out):
            labels = [n.label for n in out[at : at + size]]
            if _GROUP in labels or labels != [n.label for n in out[at + size : at + 2 * size]]:
                at += 1
                continue
            group = Node(_GROUP, out[at : at + size], repeated=True)
            end = at + size
            while labels == [n.label for n in out[end : end + size]]:
                group.children = [merged(a, b) for a, b in zip(group.children, out[end : end + size])]
                end += size
            out[at:end] = [group]
            at += 1
    return out


def _grouped_like(children: list[Node], others: list[Node]) -> list[Node]:
    """Put single occurrences of a sequence that is a group in ``others`` into a group."""
    for group in others:
        if group.label != _GROUP or any(c.label == _GROUP for c in children):
            continue
        labels = [n.label for n in group.children]
        for at in range(len(children) - len(labels) + 1):
            if [n.label for n in children[at : at + len(labels)]] == labels:
                return [*children[:at], Node(_GROUP, children[at : at + len(labels)]), *children[at + len(labels) :]]
    return children


def merged(a: Node, b: Node) -> Node:
    """Align two elements of one label into one expression that covers both."""
    left, right = _grouped_like(a.children, b.children), _grouped_like(b.children, a.children)
    longest = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            same = left[i].label == right[j].label
            longest[i][j] = longest[i + 1][j + 1] + 1 if same else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i].label == right[j].label:
            out.append(merged(left[i], right[j]))
            i, j = i + 1, j + 1
            continue
        # A mismatch: what only one side has is optional.
        take_left = j == len(right) or (i < len(left) and longest[i + 1][j] >= longest[i][j + 1])
        one = left[i] if take_left else right[j]
        i, j = (i + 1, j) if take_left else (i, j + 1)
        out.append(Node(one.label, one.children, True, one.repeated))
    return Node(a.label, folded(out), a.optional or b.optional, a.repeated or b.repeated)


def expression(node: Node) -> str:
    """The wrapper as a regular expression without unions, for people."""
    inner = " ".join(map(expression, node.children))
    body = _SLOT if node.label == _SLOT else f"({inner})" if node.label == _GROUP else f"<{node.label}>{inner}</>"
    return body + ("*" if node.optional and node.repeated else "+" if node.repeated else "?" if node.optional else "")


@lru_cache(100_000)
def plain(label: str) -> str:
    """A label with only those names that say something."""
    tag, *names = label.split(".")
    return ".".join([tag, *(n for n in names if n[0] in "@!" or set(re.split(r"[-_]+", n)) & (_ASIDE_NAMES | _MAIN_NAMES))])


def size_of(node: Node) -> int:
    return 1 + sum(map(size_of, node.children))


def _flat(node: Node) -> Iterator[Node]:
    """A node, or the members of a group and of groups in it."""
    if node.label != _GROUP:
        yield node
    else:
        for child in node.children:
            yield from _flat(child)


class Pattern:
    """A wrapper ready to match pages: for each element its parts in order, groups laid out flat."""

    def __init__(self, wrapper: Node):
        self.slots: list[list[Node]] = []
        self.root = self._laid(wrapper, [])

    def _laid(self, node: Node, above: list[Node]) -> tuple[dict[str, list[int]], list[tuple]]:
        """Places of each label, and per place: what is below, whether it may come again, first place of its group, paths of texts."""
        places: dict[str, list[int]] = {}
        parts: list[tuple] = []
        for child in node.children:
            first = len(parts) if child.label == _GROUP else None
            for part in _flat(child):
                places.setdefault(part.label, []).append(len(parts))
                if part.label == _SLOT:
                    parts.append((len(self.slots), True, first, {()}))
                    self.slots.append(above)
                else:
                    parts.append((self._laid(part, [*above, part]), part.repeated, first, text_paths(part)))
        return places, parts

    def match(self, page: Node) -> Iterator[tuple[int, Node]]:
        """The texts of a page with the numbers of their slots, in page order.

        Children follow the parts in order: a part comes again if it repeats,
        a group starts again where it repeats, optional parts are passed over.
        Of several places for an element, the next one that has room for all
        its texts is taken.
        """
        stack = [(iter(page.children), self.root, [0])]
        while stack:
            children, (places, parts), at = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                continue
            if child.label == _SLOT and not text_of(child):
                continue
            known = places.get(child.label) or places.get(plain(child.label))
            if known is None:
                continue
            place = known[0]
            if len(known) > 1:
                wanted = text_paths(child)
                order = self._order(known, parts, at[0])
                place = next((k for k in order if wanted <= parts[k][3]), order[0])
            at[0] = place + 1
            if child.label == _SLOT:
                yield parts[place][0], child
            else:
                stack.append((iter(child.children), parts[place][0], [0]))

    @staticmethod
    def _order(known: list[int], parts: list[tuple], now: int) -> list[int]:
        """The places of a label in the order in which they are tried."""
        before, after = [k for k in known if k < now], [k for k in known if k >= now]
        last = before[-1:]
        if last and last[0] == now - 1 and parts[last[0]][1]:
            return [*last, *after, *before[:-1]]
        # Back to the start of the group that the part before is in.
        loop = [k for k in before if now > 0 and parts[k][2] is not None and parts[k][2] == parts[now - 1][2]]
        return [*loop, *after, *reversed([k for k in before if k not in loop])]


def text_paths(node: Node) -> set[tuple]:
    """Paths from a node to its texts, by the names that say something."""
    if node.label == _SLOT:
        return {()}
    out: set[tuple] = set()
    for child in node.children:
        for part in _flat(child):
            if part.label != _SLOT:
                out.update((plain(part.label), *path) for path in text_paths(part))
            elif part.clean != "" and (not part.text or text_of(part)):
                out.add(())
    return out


@dataclass
class Facts:
    """Of one slot over all pages of a host."""

    pages: int = 0
    characters: int = 0
    linked: int = 0
    same: bool = False

    @property
    def own(self) -> int:
        """Characters outside of links."""
        return self.characters - self.linked


def _names(label: str) -> tuple[str, set[str], set[str]]:
    """Element, words of its names, roles."""
    tag, *names = label.split(".")
    return tag, {w for n in names if n[0] != "@" for w in re.split(r"[-_]+", n)}, {n[1:] for n in names if n[0] == "@"}


def _is_aside(node: Node) -> bool:
    """Whether HTML itself says that the element isn't main text."""
    tag, words, roles = _names(node.label)
    return tag in _ASIDE_TAGS or "!hidden" in words or bool(roles & _ASIDE_ROLES)


def _rank(node: Node) -> int:
    """How much an element says that it holds the main text."""
    tag, words, roles = _names(node.label)
    return 3 if tag == "article" else 2 if tag == "main" or "main" in roles else 1 if words & _MAIN_NAMES else 0


def kept_slots(pattern: Pattern, facts: dict[int, Facts], few: int = 5, share: float = 0.6) -> list[int]:
    """The slots that hold main text."""
    none = Facts()
    open_ = {}
    for slot, above in enumerate(pattern.slots):
        inside = next((i for i, n in enumerate(above) if n.label.partition(".")[0] in ("article", "main")), len(above))
        # A header of the site goes; an article's own header has its headline.
        site_header = any(n.label.partition(".")[0] == "header" for n in above[:inside])
        if not site_header and not any(map(_is_aside, above)):
            open_[slot] = above

    def boilerplate(slot: int) -> bool:
        return facts.get(slot, none).same and facts.get(slot, none).pages >= few

    weight = {s: 0 if boilerplate(s) else facts.get(s, none).own for s in open_}
    mass: dict[int, int] = {}
    for slot, above in open_.items():
        for node in above:
            mass[id(node)] = mass.get(id(node), 0) + weight[slot]

    def unwanted_name(above: list[Node]) -> bool:
        return any(_names(n.label)[1] & _ASIDE_NAMES for n in above)

    # The element that says it is the article and has most text, without those in asides by name.
    # Elements in the same place that differ in names that say nothing are one.
    alike: dict[tuple, set[int]] = {}
    for slot, above in open_.items():
        for depth, node in enumerate(above):
            if _rank(node) and mass[id(node)] and not unwanted_name(above[: depth + 1]):
                place = tuple(plain(n.label) for n in above[: depth + 1])
                alike.setdefault((_rank(node), place), set()).add(id(node))
    root: set[int] = set()
    rank, total = 0, sum(weight.values())
    if alike:
        best = max(alike, key=lambda k: (k[0], sum(mass[n] for n in alike[k]), -len(k[1])))
        # Names alone must not send away most of the text.
        if best[0] > 1 or sum(mass[n] for n in alike[best]) >= (1 - share) * total:
            rank, root = best[0], alike[best]
    if not root:
        # Else down from the page, as long as one element holds most of the text.
        held, level = total, 0
        while True:
            inner = {}
            for slot, above in open_.items():
                if len(above) > level and (not root or id(above[level - 1]) in root):
                    inner[id(above[level])] = above[level]
            heavy = max(inner.values(), key=lambda n: mass[id(n)], default=None)
            if heavy is None or heavy.label.partition(".")[0] in _TEXT_BLOCKS or heavy.repeated or mass[id(heavy)] < share * held or not held:
                break
            root, held, level = {id(heavy)}, mass[id(heavy)], level + 1
    whole = sum(mass[n] for n in root) if root else total
    out = []
    for slot, above in open_.items():
        below = above
        if root:
            at = next((i for i, n in enumerate(above) if id(n) in root), None)
            if at is None:
                continue
            below = above[at + 1 :]
        held = facts.get(slot, none)
        # The outermost element below the root with an unwanted name, or the slot's own.
        named_node = next((n for n in below if _names(n.label)[1] & _ASIDE_NAMES), None)
        part = mass[id(named_node)] if named_node else weight[slot]
        short = part < 0.3 * whole or not whole
        name = named_node is not None
        votes = name + (held.linked > share * held.characters) + boilerplate(slot) + (short and (name or rank < 3))
        votes += name and any(n.repeated for n in below)
        if votes < 2:
            out.append(slot)
    return out


def host_of(url: str = "url"):
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(found, F.lit(""))


def _packed(node: Node) -> str:
    return json.dumps(node.packed(), separators=(",", ":"))


def _unpacked(shape: str) -> Node:
    return Node.unpacked(json.loads(shape))


def aligned(shapes: list[str], most_nodes: int = 5_000) -> str:
    """One expression for all shapes; names that say nothing are left out where they would make it grow with the host."""
    trees = [_unpacked(s) for s in sorted(shapes, key=lambda s: (len(s), s))]
    for attempt in range(2):
        wrapper = trees[0]
        for number, tree in enumerate(trees[1:]):
            wrapper = merged(wrapper, tree)
            if not attempt and number % 8 == 7 and size_of(wrapper) > most_nodes:
                break
        if attempt or size_of(wrapper) <= most_nodes:
            break
        trees = [simplified(t) for t in trees]
    return _packed(wrapper)


def simplified(node: Node) -> Node:
    """A skeleton without the names that say nothing, folded again."""
    return Node(plain(node.label), folded([simplified(c) for c in node.children]), node.optional, node.repeated)


def wrappers(pages: DataFrame, together: int = 32) -> DataFrame:
    """(host, wrapper): the expression of every host as JSON.

    Distinct skeletons of a host are aligned ``together`` at a time, and the
    results again, so no task aligns all of a large host.
    """

    def structure(batch: pa.RecordBatch) -> Iterator[list]:
        yield [batch.column(0), [_packed(skeleton(parse(page or ""))) for page in batch.column(1).to_pylist()]]

    def align(group: pa.Table) -> pa.Table:
        return pa.table([group.column("host")[:1], pa.array([aligned(group.column("shape").to_pylist())])], names=["host", "shape"])

    seen = on_batches(pages.select(host_of().alias("host"), "html"), structure, "host string, shape string")
    shapes = written(seen.distinct(), "shapes")
    while True:
        counts = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / together).alias("parts"), F.count(F.lit(1)).alias("n"))
        counts = written(counts, "counts")
        if counts.where("n > 1").isEmpty():
            return shapes.withColumnRenamed("shape", "wrapper")
        part = F.pmod(F.xxhash64("shape"), F.col("parts")).alias("part")
        dealt = shapes.join(counts, "host").select("host", part, "shape")
        shapes = written(dealt.groupBy("host", "part").applyInArrow(align, "host string, shape string").distinct(), "shapes")


def matched(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks): the texts of each page in order, with the numbers of their slots."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        page_id, url, host, page, shape = batch.columns
        patterns: dict[str, Pattern] = {}
        blocks = []
        for raw, wrapper in zip(page.to_pylist(), shape.to_pylist()):
            if wrapper not in patterns:
                patterns[wrapper] = Pattern(_unpacked(wrapper))
            found = patterns[wrapper].match(parse(raw or ""))
            blocks.append([{"slot": s, "linked": min(n.linked, len(text_of(n))), "text": text_of(n)} for s, n in found])
        yield [page_id, url, host, blocks]

    rows = pages.select("page_id", "url", host_of().alias("host"), "html").join(known, "host")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, blocks array<struct<slot:int,linked:int,text:string>>"
    return written(on_batches(rows.select("page_id", "url", "host", "html", "wrapper"), run, schema), "matched")


def judged(known: DataFrame, blocks: DataFrame) -> DataFrame:
    """(host, kept): the numbers of the slots that hold main text."""
    # Numbered before the blocks of a page become rows.
    pages = blocks.select("host", "blocks", F.monotonically_increasing_id().alias("page"))
    each = pages.select("host", "page", F.explode("blocks").alias("b"))
    mark = F.crc32(F.col("b.text").cast("binary"))
    size = F.length("b.text").cast("bigint")
    per_page = each.groupBy("host", "page", F.col("b.slot").alias("slot")).agg(
        F.sum(size).alias("chars"), F.sum(F.col("b.linked").cast("bigint")).alias("linked"), F.min(mark).alias("low"), F.max(mark).alias("high")
    )
    facts = per_page.groupBy("host", "slot").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (F.min("low") == F.max("high")).alias("same")
    )
    # One entry per slot of a wrapper, whose size is bounded.
    listed = facts.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "linked", "same")).alias("facts"))

    def judge(batch: pa.RecordBatch) -> Iterator[list]:
        kept = []
        for shape, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            by_slot = {f["slot"]: Facts(f["pages"], f["chars"], f["linked"], f["same"]) for f in held or []}
            kept.append(kept_slots(Pattern(_unpacked(shape)), by_slot))
        yield [batch.column(0), kept]

    joined = known.join(listed, "host", "left").select("host", "wrapper", "facts")
    return written(on_batches(joined, judge, "host string, kept array<int>"), "judged")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    known = wrappers(pages)
    blocks = matched(pages, known)
    joined = blocks.join(judged(known, blocks), "host")
    kept = F.filter("blocks", lambda b: F.array_contains("kept", b["slot"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
