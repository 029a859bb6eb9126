"""HTML extraction with union-free regular expressions inferred per host.

Pages of a host become token streams (tags, texts). A stream is folded: units that repeat become groups (...)+. Pages
of one folded structure are unified; the structures of all pages of the host are then aligned one after the other with the expression so far: equal tokens match,
texts that differ become slots, a unit known to repeat is folded on the other side too, and what only one side has
becomes an optional group (...)?. The expression that remains is the host's wrapper. Its texts are fields: below `article`
or `main` where the page has one, outside menus, headers, footers, sidebars, notices, adverts, forms and comments they are
main text. Pages with and without such an element may lie on one host: each page says which it is, and
on pages without it a text that stays the same on all pages of that kind belongs to the template.

Every page is read whole, and its texts go where the wrapper's fields say. Character references are decoded, white space inside a block is one space, blocks are lines. Null and empty
pages give an empty text; unclosed tags, comments and scripts end with the page. Pages without a host share a wrapper. Repeated
rows give repeated results; extra columns are left out. Structures are met in the order of their digests, so that the result does not
depend on how the rows lie. Pages of any length are aligned; where the table of an alignment would be too large, it is taken in halves.
"""

from __future__ import annotations

import html as markup
import json
import pickle
import re
import zlib
from functools import lru_cache
from hashlib import blake2b
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.llm.url_rules import host_of
from queuemill.llm.wordcodes import chunks
from queuemill.runtime import materialise

#: Distinct pages from which a host has a template, structures a task holds, and structures that are aligned in one group.
FEW, HELD, FAN = 4, 2000, 256
#: Nodes that a task holds, and that are aligned in one group, unless a few structures have more.
NODES, LEAST_FAN = 800_000, 8
#: Wrappers that may be sent to all tasks; beyond that they are joined by a shuffle.
SENT_WRAPPERS = 20_000
#: Longest unit, in tokens, that is tried as a repeated group, and side of the largest square table that an alignment holds.
UNIT, STREAM = 24, 2000

RAW = "script|style|noscript|template|textarea|iframe|svg|object|select|option|button"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*(?<!/)>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z](?:[^<>"']|"[^"]*"|'[^']*')*>|<[!?][^>]*>|[^<]+|<""",
                   re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SECTIONS = frozenset("html head body article main section div nav header footer aside form ul ol dl table thead tbody tfoot tr figure details menu fieldset".split())
BLOCKS = SECTIONS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote figcaption title hr address summary legend".split())
CHROME_TAGS = frozenset("head nav header footer aside form menu dialog title".split())
#: Elements whose classes count although they hold lines only; they end where the next block begins.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption address summary".split())
#: Parts of class and id names that mark what isn't main text, and parts that name a mere frame around it.
CHROME_PARTS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices
popup modal sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs footer comment comments reply replies disqus share sharing social
related newsletter subscribe subscription login signup search pagination pager toolbar masthead skip""".split())
FRAME_PARTS = frozenset("wrap wrapper container layout has with no page content body main article post entry text".split())
HEADERS = frozenset(("header", "site-header", "page-header", "top-header", "global-header", "main-header"))
MAIN_TAGS = frozenset(("article", "main"))
SPACE = re.compile(r"\s+")


class Node(NamedTuple):
    kind: str              # tag, text, + or ?
    key: object            # what has to be equal to match
    text: str | None       # of a text that is the same on all pages so far
    place: str             # of a text: the sections around it
    parts: tuple           # of a group


def is_chrome(names: str) -> bool:
    """Does a class or id say that an element isn't main text?"""
    for word in names.lower().replace("_", "-").split():
        parts = set(word.split("-"))
        if word in HEADERS or parts & CHROME_PARTS and not parts & FRAME_PARTS:
            return True
        # "article-footer", "post-comments": what comes last is what it is.
        if parts & FRAME_PARTS and word.rpartition("-")[2] in CHROME_PARTS and not parts & {"has", "with", "no"}:
            return True
    return False


def signature(name: str, raw: str) -> str:
    names = " ".join(a or b or c for a, b, c in NAMED.findall(raw)) if "=" in raw else ""
    return f"{name}.{re.sub('[0-9]+', '0', names)}" if names else name


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, value, sections around, in a block of its own): tags as open and close with their signature, and texts.

    A block element ends the paragraph-like element before it, and a closing tag ends what is still open inside.
    """
    stack: list[tuple[str, str]] = []
    place = ""
    for m in TOKEN.finditer(page):
        raw = m.group()
        if raw[0] != "<" or raw == "<":
            yield "text", raw, place, False
            continue
        if m.group(1) or raw[1] in "!?":
            continue
        tag = TAG.match(raw)
        if not tag:
            continue
        name = tag.group(2).lower()
        if not tag.group(1):
            own = signature(name, raw)
            opens = name in SECTIONS or name in LINES and "." in own
            if name in BLOCKS:
                # A new block ends a line that is still open; a list item ends the item before it.
                while stack and (stack[-1][0] in LINES and (stack[-1][0] not in ("li", "dd", "dt", "blockquote") or stack[-1][0] == name)):
                    stack.pop()
                    place = "/".join(s for _, s in stack)
            if opens and not raw.endswith("/>"):
                stack.append((name, own))
                place = "/".join(s for _, s in stack)
            yield "open", own, place, name in BLOCKS
        else:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                place = "/".join(s for _, s in stack)
            yield "close", name, place, name in BLOCKS


def stream(found: list[tuple[str, str, str, bool]]) -> list[Node]:
    out = []
    for kind, value, place, _ in found:
        if kind == "text":
            value = SPACE.sub(" ", markup.unescape(value)).strip()
            if value:
                out.append(Node("text", "#", value, place, ()))
        else:
            out.append(Node("tag", f"<{value}>" if kind == "open" else f"</{value}>", None, "", ()))
    return out


def unify(a: Node, b: Node) -> Node:
    """Two nodes of one key: texts that differ become a slot, groups are aligned inside."""
    if a.kind == "text":
        return a if a.text == b.text else a._replace(text=None)
    if a.kind in "+?":
        return a._replace(parts=tuple(unify(x, y) for x, y in zip(a.parts, b.parts)))
    return a


def plus(unit: list[Node]) -> Node:
    return Node("+", ("+", tuple(n.key for n in unit)), None, "", tuple(unit))


def fold(nodes: list[Node]) -> list[Node]:
    """Adjacent equal units become one repeated group, short units first."""
    changed = True
    while changed:
        changed = False
        for size in range(2, min(UNIT, len(nodes) // 2) + 1):
            keys = [n.key for n in nodes]
            out, at, found = [], 0, False
            while at < len(nodes):
                unit = nodes[at:at + size]
                stop = at + size
                if keys[at] != keys[stop] if stop < len(nodes) else True:
                    out.append(nodes[at])
                    at += 1
                    continue
                while keys[at:at + size] == keys[stop:stop + size]:
                    unit = [unify(a, b) for a, b in zip(unit, nodes[stop:stop + size])]
                    stop += size
                if stop > at + size:
                    out.append(plus(unit))
                    found = True
                    at = stop
                else:
                    out.append(nodes[at])
                    at += 1
            if found:
                nodes, changed = out, True
                break
    return nodes


def fold_known(nodes: list[Node], groups: list[Node]) -> list[Node]:
    """A single unit that repeats elsewhere becomes a group as well."""
    for group in groups:
        keys, size = [n.key for n in group.parts], len(group.parts)
        out, at = [], 0
        while at < len(nodes):
            if nodes[at].key == keys[0] and [n.key for n in nodes[at:at + size]] == keys:
                out.append(plus(nodes[at:at + size]))
                at += size
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def _shared(a: np.ndarray, b: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """How many entries the ends of `a` and `b` share in their order at most, for each end of `b`; with a table, for each end of `a` too."""
    below = np.zeros(len(b) + 1, np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.zeros(len(b) + 1, np.int32)
        row[:-1] = np.maximum.accumulate(np.where(b == a[i], below[1:] + 1, below[:-1])[::-1])[::-1]
        below = row
        if table is not None:
            table[i] = row
    return below


BOTH, LEFT, RIGHT = range(3)


def _steps(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The longest common subsequence as steps through `a`, `b` or both. Where its table would be too large, `a` is halved and `b` cut
    where the halves share most."""
    n, m = len(a), len(b)
    if n > 1 and n * m > STREAM * STREAM:
        middle = n // 2
        cut = int(np.argmax(_shared(a[:middle][::-1], b[::-1])[::-1] + _shared(a[middle:], b)))
        return _steps(a[:middle], b[:cut]) + _steps(a[middle:], b[cut:])
    best = np.zeros((n + 1, m + 1), np.int32)
    _shared(a, b, best)
    out, i, j = [], 0, 0
    while i < n and j < m:
        step = BOTH if a[i] == b[j] else LEFT if best[i + 1, j] >= best[i, j + 1] else RIGHT
        out.append(step)
        i, j = i + (step != RIGHT), j + (step != LEFT)
    return out + [LEFT] * (n - i) + [RIGHT] * (m - j)


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The expression that covers both."""
    groups = lambda nodes: [n for n in nodes if n.kind == "+"]
    a, b = fold_known(a, groups(b)), fold_known(b, groups(a))
    # An optional group stands for its parts while aligning.
    key = lambda x: x.parts[0].key if x.kind == "?" and len(x.parts) == 1 else x.key
    codes: dict[object, int] = {}
    ka, kb = (np.array([codes.setdefault(key(x), len(codes)) for x in nodes], np.int64) for nodes in (a, b))
    same = np.flatnonzero(np.append(ka[:len(kb)] != kb[:len(ka)], True))[0]
    out, i, j = [], 0, 0
    optional = lambda x: x if x.kind == "?" else Node("?", ("?", (x.key,)), None, "", (x,))
    for step in [BOTH] * same + _steps(ka[same:], kb[same:]):
        if step == BOTH:
            x, y = (z.parts[0] if z.kind == "?" and len(z.parts) == 1 else z for z in (a[i], b[j]))
            both = unify(x, y)
            out.append(optional(both) if "?" in (a[i].kind, b[j].kind) else both)
        else:
            out.append(optional(a[i] if step == LEFT else b[j]))
        i, j = i + (step != RIGHT), j + (step != LEFT)
    return out


def expression(nodes: list[Node]) -> str:
    """The wrapper in writing."""
    out = []
    for n in nodes:
        if n.kind in "+?":
            out.append(f"({expression(list(n.parts))}){n.kind}")
        elif n.kind == "text":
            out.append("#" if n.text is None else json.dumps(n.text, ensure_ascii=False))
        else:
            out.append(n.key)
    return "".join(out)


def texts_of(nodes: list[Node], optional: bool = False) -> Iterator[tuple[Node, bool]]:
    for n in nodes:
        if n.kind == "text":
            yield n, optional
        elif n.kind in "+?":
            yield from texts_of(list(n.parts), optional or n.kind == "?")


@lru_cache(maxsize=50_000)
def is_main(place: str, has_main: bool) -> bool:
    """Do the sections around a text make it main text?"""
    inside = not has_main
    for part in place.split("/"):
        name, _, names = part.partition(".")
        if name in ("html", "body"):
            continue
        if name in MAIN_TAGS:
            inside = True
        elif name in CHROME_TAGS or names and is_chrome(names):
            # A header inside the article is the article's own.
            if not (inside and has_main and (name == "header" or "header" in names) and not (set(names.split()) - HEADERS) & CHROME_PARTS):
                return False
    return inside


def holds_main(found: list[tuple[str, str, str, bool]]) -> bool:
    """Do a page's tokens hold an article or main element that isn't itself part of a sidebar, comments or the like?"""
    return any(is_main(place, True) for place in {place for _, _, place, _ in found})


class Part(NamedTuple):
    """What some pages of a host and kind have in common."""

    key: bytes                      # places it in the order of alignment; pages of one structure share it
    nodes: tuple                    # their expression
    seen: frozenset                 # digests of FEW distinct pages, or of all


def part_of(page: str) -> tuple[bool, Part]:
    """Is a page without article or main, and what it has."""
    found = list(tokens(page))
    nodes, seen = tuple(fold(stream(found))), frozenset([blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).digest()])
    return not holds_main(found), Part(blake2b(repr([n.key for n in nodes]).encode("utf-8", "surrogatepass"), digest_size=16).digest(), nodes, seen)


def _fixed(nodes) -> frozenset:
    return frozenset(n.text for n, optional in texts_of(nodes) if n.text is not None and not optional)


def _size(nodes) -> int:
    return sum(1 + _size(n.parts) for n in nodes)


def same_structure(a: Part, b: Part) -> Part:
    return Part(a.key, tuple(unify(x, y) for x, y in zip(a.nodes, b.nodes)), frozenset(sorted(a.seen | b.seen)[:FEW]))


def together(parts: list[Part]) -> Part:
    """Pages of one structure are unified, the structures aligned one after the other."""
    alike: dict[bytes, Part] = {}
    for part in parts:
        alike[part.key] = same_structure(alike[part.key], part) if part.key in alike else part
    wrapper, seen = None, frozenset()
    for _, part in sorted(alike.items()):
        seen = frozenset(sorted(seen | part.seen)[:FEW])
        wrapper = part.nodes if wrapper is None else tuple(align(list(wrapper), list(part.nodes)))
    return Part(min(alike, default=b""), wrapper or (), seen)


def wrapper_of(every: Part, bare: Part | None) -> str:
    """The wrapper of a host's pages: its expression, and the texts of the template on pages without article or main, as JSON."""
    fixed = _fixed(bare.nodes) if bare and len(bare.seen) >= FEW else ()
    return json.dumps({"pattern": expression(list(every.nodes)), "fixed": sorted(fixed)}, ensure_ascii=False)


def infer(pages: list[str]) -> str:
    """The wrapper of some pages of one host."""
    parts = [part_of(page) for page in pages]
    bare = [part for is_bare, part in parts if is_bare]
    return wrapper_of(together([part for _, part in parts]), together(bare) if bare else None)


def main_text(page: str, wrapper: dict) -> str:
    """The main text of a page, block by block."""
    found = list(tokens(page))
    has_main = holds_main(found)
    fixed = frozenset(() if has_main else wrapper["fixed"])
    blocks: list[list[str]] = [[]]
    for kind, value, place, breaks in found:
        if kind == "text":
            if is_main(place, has_main):
                blocks[-1].append(value)
        elif breaks:
            if blocks[-1]:
                blocks.append([])
        elif value.partition(".")[0] in ("br", "wbr", "img") and kind == "open":
            blocks[-1].append(" ")
    lines = (SPACE.sub(" ", markup.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x and x not in fixed)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to what the pages of a task have in common, by host, kind and structure."""
    held: dict[tuple[str | None, bool, bytes], Part] = {}
    nodes = 0
    for batch in batches:
        for some in chunks(batch, 1):
            for host, page in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                bare, part = part_of(page)
                at = host, bare, part.key
                nodes += 0 if at in held else _size(part.nodes)
                held[at] = same_structure(held[at], part) if at in held else part
                if len(held) > HELD or nodes > NODES:
                    yield _rows_of((host, bare, part) for (host, bare, _), part in held.items())
                    held, nodes = {}, 0
    yield _rows_of((host, bare, part) for (host, bare, _), part in held.items())


PARTS = "host string, bare boolean, key binary, size long, part binary"


def _rows_of(found) -> pa.RecordBatch:
    hosts, bare, parts = zip(*found) if (found := list(found)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bare, pa.bool_()), pa.array([p.key for p in parts], pa.binary()),
                                       pa.array([_size(p.nodes) for p in parts], pa.int64()),
                                       pa.array([zlib.compress(pickle.dumps(p)) for p in parts], pa.binary())], names=["host", "bare", "key", "size", "part"])


def _read(table: pa.Table) -> list[Part]:
    return [pickle.loads(zlib.decompress(p)) for p in table.column("part").to_pylist()]


def _one_part(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_rows_of([(table.column("host")[0].as_py(), table.column("bare")[0].as_py(), together(_read(table)))])])


def _infer_host(table: pa.Table) -> pa.Table:
    parts, kinds = _read(table), table.column("bare").to_pylist()
    bare = [part for part, is_bare in zip(parts, kinds) if is_bare]
    wrapper = wrapper_of(together(parts), together(bare) if bare else None)
    fixed = json.dumps({"fixed": json.loads(wrapper)["fixed"]}, ensure_ascii=False)
    return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([wrapper], pa.string()), "fixed": pa.array([fixed], pa.string())})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, and its fixed texts alone, from all pages of each host. Pages stay where they lie; what travels is an expression for
    each structure a task met. A host of more than FAN of them, or of large ones, has them aligned in groups first."""
    texts = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    parts = materialise(texts.mapInArrow(_parts, PARTS), "page-parts")
    while True:
        sizes = parts.groupBy(F.col("host").alias("_host")).agg(F.count_distinct("bare", "key").alias("_n"), F.sum("size").alias("_nodes"))
        # Every round leaves less parts, however large they are.
        groups = F.greatest(F.ceil(F.col("_n") / FAN), F.least(F.ceil(F.col("_n") / LEAST_FAN), F.ceil(F.col("_nodes") / NODES)))
        sizes = sizes.select("_host", groups.alias("_groups")).where("_groups > 1")
        if sizes.isEmpty():
            return parts.groupBy("host").applyInArrow(_infer_host, "host string, wrapper string, fixed string")
        placed = parts.join(sizes, F.col("host").eqNullSafe(F.col("_host")), "left").withColumn(
            "_group", F.pmod(F.xxhash64("key"), F.coalesce("_groups", F.lit(1))))
        parts = materialise(placed.groupBy("host", "bare", "_group").applyInArrow(_one_part, PARTS), "page-parts")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        for part in chunks(batch, 2):
            out = []
            for page, raw in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if raw not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[raw] = json.loads(raw)
                out.append(main_text(page, known[raw]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    wrappers = materialise(infer_wrappers(pages), "wrappers")
    wrappers = wrappers.select("host", "fixed")     # an expression may be long, and only its fixed texts are asked of a page
    side = F.broadcast(wrappers) if wrappers.count() <= SENT_WRAPPERS else wrappers
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    none = json.dumps({"fixed": []})
    joined = rows.join(side, "host", "left").select("page_id", "url", "html", F.coalesce("fixed", F.lit(none)).alias("fixed"))
    return joined.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
