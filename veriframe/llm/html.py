"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its tags with their place in the tree, and its runs of text. On the pages of a host, tokens that occur
equally often on every page share an occurrence vector, and form a class. A class is valid on a page where its tokens come in
one order; valid classes nest by the stretch that they span, and together are the host's template. What
lies between template tokens are the slots. The slots' text, counted over the host, shows which of the template's
containers holds its pages' content; the slots in it are extracted. Names of elements and classes only settle which slots in
and around it are asides, and stand in for a template on hosts of too few pages."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import BROADCAST_ROWS, discard, materialize

#: Share of a host's pages that a template token must be on, and pages that a host needs for a template; as many different
#: pages must have a run of text before it is template, so that copies of one page are none.
SUPPORT, LEAST_PAGES = 0.6, 3
#: Share of the text around it that a container of the template must hold to be the content's, and share of links that makes a menu.
CONTENT, LINKS = 0.5, 0.5
#: Words from which a run is taken for content where no template tells.
LONG_RUN = 12
TAG, RUN, CONTAINER = 0, 1, 2

# Names of elements and of classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head title script style noscript template nav footer aside form button select option textarea iframe svg math canvas object dialog menu audio video map".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
MAIN = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
TEXTUAL = INLINE | set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd br hr pre blockquote table thead tbody tfoot tr td th caption figure figcaption img picture source address center".split())
NOISE = set("ad ads adbox adslot advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar comment comments commentlist disqus cookie cookies consent notice notices alert gdpr nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip disclaimer replies reply respond".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^\"'>]|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def host(url: str | None) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return m[1].lower() if m else ""


ROOT = 0


class Node:
    """A container's place in a page's tree; elements of one parent with equal tag, class and id are one place. Its key is a chain of hashes, so that no path is written out."""

    __slots__ = ("parent", "tag", "at", "depth", "key", "bare")

    def __init__(self, parent: Node | None, tag: str, part: str, at: int):
        self.parent, self.tag, self.at = parent, tag, at
        self.depth = parent.depth + 1 if parent else 0
        self.key = _key(str(parent.key), part) if parent else ROOT
        self.bare = _key(str(parent.bare), tag) if parent else ROOT


def summed(nodes: list[Node], values: list) -> list:
    """values of nodes (in the order of their making) with those of all nodes inside them."""
    values = list(values)
    for node in reversed(nodes[1:]):
        values[node.parent.at] += values[node.at]
    return values


def within(nodes: list[Node], marked: set[int]) -> list[bool]:
    """Whether each node is one of the marked keys, or inside one."""
    out = [False] * len(nodes)
    for node in nodes:
        out[node.at] = node.key in marked or node.parent is not None and out[node.parent.at]
    return out


@dataclass
class Run:
    """A run of text: the place around it, whether names mark it as an aside or as a head outside an article, whether it is in an article, its share of links."""

    node: Node
    text: str
    aside: bool
    head: bool
    main: bool
    links: float


def parse(page: str | None) -> tuple[list[tuple[Node, str]], list[Run], list[Node]]:
    """(tokens, runs, nodes): tokens (node, name) in page order, '' names a run; nodes in the order of their making.

    Broken markup is read as browsers do: unclosed elements end with their parent, stray ends are passed over. Time and memory grow with the page's length, however deep it is."""
    text, at, tokens, runs = page or "", 0, [], []
    nodes = [Node(None, "", "", 0)]
    places: dict[tuple[int, str], Node] = {}
    stack: list[tuple] = [("", nodes[0], False, False, False, False)]  # tag, node, aside, head, in an article, in a link
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(buffer)
        run = " ".join(html.unescape(raw).split())
        buffer.clear()
        if run:
            _, node, aside, head, main, _ = stack[-1]
            tokens.append((node, ""))
            runs.append(Run(node, run, aside, head, main, linked / len(raw)))
        linked = 0

    def close(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while m := TOKEN.search(text, at):
        if m.start() > at:
            buffer.append(text[at : m.start()])
            if stack[-1][5]:
                linked += m.start() - at
        at = m.end()
        if m["cdata"] is not None:
            buffer.append(html.escape(m["cdata"]))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag not in INLINE:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if tag in INLINE and stack[k][2] != stack[-1][2]:
                        flush()
                    tokens.append((stack[k][1], "/" + tag))
                    close(k)
                    break
                if stack[k][0] not in TEXTUAL and tag in TEXTUAL:
                    break  # an end of p or b does not close the element around it
            continue
        closes = CLOSES.get(tag, ()) or ({"p"} if tag in ENDS_P else ())
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in closes) else ():
            if stack[k][0] in closes:
                close(k)
                break
            if stack[k][0] not in TEXTUAL or stack[k][0] in ("table", "ul", "ol", "dl"):
                break
        _, node, aside, head, main, link = stack[-1]
        names, attrs = "", m["attrs"]
        if attrs:
            for a in ATTR.finditer(attrs):
                key, value = a[1].lower(), next((x for x in a.groups()[1:] if x is not None), "")
                if key in ("class", "id"):
                    names += "." + value.lower().replace("/", "|")
                    aside |= tag not in ("html", "body", "article", "main") and not NOISE.isdisjoint(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
                elif key == "role":
                    aside |= value.lower() in ROLES
                    main |= value.lower() in ("main", "article")
                elif key == "style":
                    aside |= bool(HIDDEN.search(value))
                else:
                    aside |= value.lower() != "false"
        aside |= tag in DROPPED
        head |= tag == "header" and not main
        main |= tag in MAIN
        link |= tag == "a"
        if tag not in TEXTUAL:
            place = (node.at, tag + names)
            if place not in places:
                places[place] = Node(node, tag, tag + names, len(nodes))
                nodes.append(places[place])
            node = places[place]
        if tag in INLINE and aside and not stack[-1][2]:
            flush()
        tokens.append((node, tag))
        if tag in RAW_END:
            end = RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, node, aside, head, main, link))
            opened[tag] += 1
    if at < len(text):
        buffer.append(text[at:])
        linked += stack[-1][5] * (len(text) - at)
    flush()
    return tokens, runs, nodes


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


@functools.lru_cache(200_000)
def tag_key(node_key: int, name: str) -> int:
    return _key(str(node_key), name)


def run_key(run: Run) -> int:
    return _key(str(run.node.key), "", run.text)


def signature(tokens: list[tuple[Node, str]], runs: list[Run]) -> list[int]:
    """Keys of all tokens in page order."""
    left = iter(runs)
    return [tag_key(node.key, name) if name else run_key(next(left)) for node, name in tokens]


def templates(pages: DataFrame) -> DataFrame:
    """pages: (page_id, host, html). (host, template): the tokens and containers on SUPPORT of a host's pages.

    A token's occurrence vector is known by the sum of a hash of page and count, which tasks add up before the shuffle, so
    a host of any size needs no task of its own. Tokens of one vector are one class. For a run of text, the pages are also
    marked by their longest run, as the different ones among them count."""
    columns, where = ["pages", "vector", "occurs", "place", "chars", "links"], ["up", "start", "depth"]  # where: the container around, a container's start tag, and how deep it is

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple, list] = {}

            def add(h: str, kind: int, key: int, place: tuple[int, int, int], mark: int, *more: int) -> None:
                s = seen.setdefault((h, kind, key), [*place, 0, *[0] * len(columns)])
                s[3] |= mark
                for k, x in enumerate(more, 4):
                    s[k] += x

            for page, h, doc in zip(pdf["page_id"], pdf["host"], pdf["html"]):
                tokens, runs, nodes = parse(doc)
                longest = max((r.text for r in runs if not r.aside), key=len, default="")
                mark = 1 << xxhash.xxh32_intdigest(longest) % 63
                count: dict[tuple, list[int]] = {}
                left = iter(runs)
                for k, (node, name) in enumerate(tokens):
                    r = None if name else next(left)
                    c = count.setdefault((TAG, tag_key(node.key, name), ROOT) if name else (RUN, run_key(r), node.key), [0, k, 0 if name or r.aside else len(r.text)])
                    c[0] += 1
                for (kind, key, up), (n, k, chars) in count.items():
                    add(h, kind, key, (up, 0, 0), mark, 1, xxhash.xxh32_intdigest(f"{page}:{n}"), n, k, n * chars, 0)
                chars, links, some = ([0] * len(nodes) for _ in range(3))
                for r in runs:
                    some[r.node.at] += 1
                    chars[r.node.at] += 0 if r.aside else len(r.text)
                    links[r.node.at] += 0 if r.aside else r.links * len(r.text)
                for node, n, c, x in zip(nodes, summed(nodes, some), summed(nodes, chars), summed(nodes, links)):
                    if n:
                        add(h, CONTAINER, node.key, (node.parent.key if node.parent else ROOT, tag_key(node.key, node.tag), node.depth), mark, 1, 0, 0, 0, c, round(x))
                add(h, TAG, 0, (ROOT, 0, 0), mark, 1, 0, 0, 0, 0, 0)
            yield pd.DataFrame([(*k, *s) for k, s in seen.items()], columns=["host", "kind", "token", *where, "marks", *columns])

    tokens = pages.mapInPandas(run, "host string, kind int, token long, " + ", ".join(f"{c} long" for c in [*where, "marks", *columns]))
    tokens = tokens.groupBy("host", "kind", "token").agg(*[F.min(c).alias(c) for c in where], F.bit_or("marks").alias("marks"), *[F.sum(c).alias(c) for c in columns])
    tokens = materialize(tokens.filter(f"pages >= {LEAST_PAGES} * {SUPPORT}"))
    size = materialize(tokens.filter(f"kind = {TAG} and token = 0").selectExpr("host", "pages host_pages"))
    often = tokens.filter(f"kind <> {TAG} or token <> 0").join(size.hint("merge"), "host").filter(f"host_pages >= {LEAST_PAGES} and pages >= {SUPPORT} * host_pages and (kind <> {RUN} or bit_count(marks) >= {LEAST_PAGES})")
    token = F.struct("kind", "token", F.xxhash64("vector", "pages", "occurs").alias("cls"), (F.col("place") / F.col("pages")).alias("place"), *where, "chars", "links")
    often = materialize(often.select("host", token.alias("t")))  # what is left of a host is bounded by its pages' length
    found = materialize(often.groupBy("host").agg(F.sort_array(F.collect_list("t")).alias("template")))
    discard(tokens, size, often)
    return found


def nest(template: list) -> dict[int, tuple[int, int]]:
    """token -> (class, depth): classes of two tokens or more, nested by the stretch from their first to their last token."""
    classes: dict[int, list[tuple[float, int]]] = {}
    for t in template:
        if t["kind"] != CONTAINER:
            classes.setdefault(t["cls"], []).append((t["place"], t["token"]))
    spans = sorted((min(ts)[0], -max(ts)[0], cls) for cls, ts in classes.items() if len(ts) > 1)
    out, outer = {}, []
    for lo, hi, cls in spans:
        while outer and -outer[-1] < -hi:
            outer.pop()
        out.update({t: (cls, len(outer)) for _, t in classes[cls]})
        outer.append(hi)
    return out


class Template:
    """A host's template, made ready for its pages."""

    def __init__(self, template: list):
        self.nested = nest(template)
        self.places = {t["token"]: t["place"] for t in template if t["kind"] != CONTAINER}
        self.texts = {t["token"] for t in template if t["kind"] == RUN}
        boxes = sorted((t for t in template if t["kind"] == CONTAINER), key=lambda t: (t["depth"], t["token"]))
        fixed: dict[int, int] = {}  # characters of template text, which is no slot
        for t in template:
            if t["kind"] == RUN:
                fixed[t["up"]] = fixed.get(t["up"], 0) + t["chars"]
        for t in reversed(boxes):
            if t["token"] != ROOT and t["token"] in fixed:
                fixed[t["up"]] = fixed.get(t["up"], 0) + fixed[t["token"]]
        self.mass = {t["token"]: (t["chars"] - fixed.get(t["token"], 0), t["links"]) for t in boxes}
        self.content, self.start = self._content(boxes)
        inside, self.menus = {self.content}, set()
        for t in boxes:
            if t["token"] != ROOT and t["up"] in inside:
                inside.add(t["token"])
                chars, links = self.mass[t["token"]]
                if links > LINKS * max(chars, 1):
                    self.menus.add(t["token"])

    def _content(self, boxes: list) -> tuple[int, int]:
        """The innermost container between template tokens that holds CONTENT of the slots' text, other than links, of the one around it, and its start tag.

        A container holds no more than one around it, so each step looks at the next candidates inside alone."""
        held = {t["token"]: self.mass[t["token"]][0] - self.mass[t["token"]][1] for t in boxes if t["token"] != ROOT and t["start"] in self.nested}
        around, inside = {ROOT: ROOT}, {}  # the candidate around each container, and the candidates next inside each
        for t in boxes:
            if t["token"] != ROOT:
                outer = around.get(t["up"], ROOT)
                around[t["token"]] = t["token"] if t["token"] in held else outer
                if t["token"] in held:
                    inside.setdefault(outer, []).append(t)
        chars, links = self.mass.get(ROOT, (0, 0))
        now, start, text = ROOT, 0, max(chars - links, 0)
        while now in inside:
            best = max(inside[now], key=lambda t: (held[t["token"]], -t["depth"], t["token"]))
            if held[best["token"]] <= 0 or held[best["token"]] < CONTENT * text:
                break
            now, start, text = best["token"], best["start"], held[best["token"]]
        return now, start

    def valid(self, keys: list[int]) -> set[int]:
        """Tokens of the classes that are valid on a page: where a class's tokens occur once, they come in the template's order."""
        order: dict[int, list[float]] = {}
        for key in keys:
            if key in self.nested:
                order.setdefault(self.nested[key][0], []).append(self.places[key])
        good = {c for c, ps in order.items() if len(set(ps)) < len(ps) or all(a <= b for a, b in zip(ps, ps[1:]))}
        return {t for t, (c, _) in self.nested.items() if c in good}


def main_text(page: str | None, template: Template | None) -> tuple[str, int]:
    """(text, number of template tokens used): the slots of the page in its template's content container.

    Without template, or where the page has not that container, the runs of its article; without one, those in the smallest
    common ancestor of the path with most text, its likes without class and id, and all paths with long runs."""
    tokens, runs, nodes = parse(page)
    used = 0
    slots = runs
    if template:
        keys = signature(tokens, runs)
        fixed = template.valid(keys)
        used = sum(k in fixed for k in keys)
        slots = [r for r in runs if run_key(r) not in template.texts] if template.texts else runs
        if template.content != ROOT and template.start in fixed and template.start in keys:
            home, menus = within(nodes, {template.content}), within(nodes, template.menus)
            return " ".join(r.text for r in slots if not r.aside and home[r.node.at] and not menus[r.node.at]), used
    plain = [r for r in slots if not r.aside and not r.head]
    if not plain and slots is not runs:
        slots = runs
        plain = [r for r in slots if not r.aside and not r.head]
    kept = [r for r in plain if r.main]
    if not kept and not any(r.main for r in slots):
        mass: dict[int, int] = {}
        for r in plain:
            mass[r.node.at] = mass.get(r.node.at, 0) + len(r.text)
        if mass:
            best = nodes[max(mass, key=lambda at: (mass[at], at))]
            long = {r.node.at for r in plain if r.text.count(" ") >= LONG_RUN}
            chosen = [at == best.at or at in long or (at in mass and nodes[at].bare == best.bare) for at in range(len(nodes))]
            share = summed(nodes, [int(x) for x in chosen])
            home = max((n for n in nodes if share[n.at] == share[0]), key=lambda n: n.depth)  # the smallest ancestor of all
            inside = within(nodes, {home.key})
            kept = [r for r in plain if inside[r.node.at]]
    return " ".join(r.text for r in kept), used


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, template_tokens): the main text of every page, from the whole html; null or empty html gives ''.

    Repeated rows and null ids or urls keep their rows (null and odd urls have no host and no template). A page of a host with fewer than
    LEAST_PAGES pages has its own tags alone to go by. Very long pages are read whole, columns of other names are passed over. White space inside a block is one space, blocks are joined by one."""
    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    src = src.withColumn("host", name)
    found = templates(src.filter("host <> ''"))
    size = found.agg(F.sum(F.size("template"))).first()[0] or 0
    joined = src.join(F.broadcast(found) if 2 * size <= BROADCAST_ROWS else found.hint("merge"), "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: dict[str, Template | None] = {}
            out = []
            for h, doc, t in zip(pdf["host"], pdf["html"], pdf["template"]):
                if h not in made:
                    made[h] = Template(list(t)) if t is not None else None
                out.append(main_text(doc, made[h]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [t for t, _ in out], "n_chars": [len(t) for t, _ in out], "template_tokens": [n for _, n in out]})

    return joined.select("page_id", "url", "host", "html", "template").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long, template_tokens long")
