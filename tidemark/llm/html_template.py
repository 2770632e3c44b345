"""Main text of web pages by template deduction over the pages of a host.

Tokens are elements told apart by their path, class and id. Tokens that share an occurrence vector over a host's pages
form an equivalence class; large frequent classes, nested by path and in the same order on a page, are the template.
Text stands in the slots that the template leaves; the main container is an article or main element, with others beside it, or
else the lowest element that holds all of them. Names of classes are evidence, read by their head word; they never take nearly all of a page away.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements whose content is not read as markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that are never part of the main text.
ASIDE = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "button", "select", "textarea", "menu", "dialog",
         "head", "title", "label", "canvas", "math", "noembed", "noframes"}
#: Words that, as the head of a class, id or role, mark menus, notices, adverts, forms and comments.
ASIDE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus discussion foot footer "
                  "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
                  "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
COMMENT_WORDS = {"comment", "comments", "disqus", "discussion", "replies", "reply", "respond"}
#: Nouns for any container: the word before them is the head. "comment-list" is comments, "search-result" is a result.
CONTAINER_WORDS = set("area bar block body bottom box btn button buttons card column container content-wrap form group header holder inner item items left link links list outer "
                      "panel posts row right section slot stories text thread title top unit wrap wrapper zone".split())
#: A name that begins or ends so tells how an element looks or what it has, not what it is.
MODIFIER_FIRST = set("has no not with without is are was js overflow show hide toggle".split())
MODIFIER_LAST = set("active closed collapsed disabled enabled expanded fixed off on open opened ready sticky visible".split())
HIDDEN = {"hidden", "is-hidden", "visually-hidden", "sr-only", "screen-reader-text"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *ASIDE}
#: A start tag of these ends an open paragraph; of these, an open one of the same kind.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "caption", "label", "button", "html", "body"}
ENDS_SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "caption", "figcaption"}
HOLDERS = {"article", "main"}


@dataclass
class Run:
    """A stretch of text: the node it stands in, its block, and whether it is in a link or in prose."""

    node: int
    block: int
    text: str
    link: bool
    prose: bool


@dataclass
class Page:
    """The elements of a page in the order they open, and its text. Node 0 is the page; a node's number is above its parent's.

    A token is the hash of a path of keys, made from the parent's, so a node costs the same at any depth.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    token: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    aside: list[int] = field(default_factory=lambda: [NOT])
    runs: list[Run] = field(default_factory=list)

    def add(self, parent: int, tag: str, key: str, aside: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.token.append(path_hash(self.token[parent], key))
        self.depth.append(self.depth[parent] + 1)
        self.aside.append(aside)
        return len(self.tag) - 1

    def spread(self, start: Callable[[int], object]) -> list:
        """Per node what ``start`` gives for the outermost of the nodes around it, itself included, for which it gives anything."""
        out: list = []
        for node in range(len(self.tag)):
            above = out[self.parent[node]] if node else None
            out.append(above if above else start(node))
        return out

    def below(self, own: list[int]) -> list[int]:
        """Sums over the subtrees."""
        out = list(own)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def asides(self) -> list[bool]:
        """Nodes in no main text. A name, or a form, is no reason to leave out nearly all of a page, or for a form half of it."""
        own, plain = [0] * len(self.tag), self.spread(lambda n: self.aside[n] == SURE)
        for run in self.runs:
            own[run.node] += 0 if plain[run.node] or run.link else len(run.text.strip())
        mass = self.below(own)
        least = {NAMED: 0.8 * mass[0], FORM: 0.5 * mass[0]}
        return [bool(x) for x in self.spread(lambda n: self.aside[n] == SURE or self.aside[n] in least and not mass[n] > least[self.aside[n]])]


#: How sure it is that an element is beside the main text: not at all, by a name, as a form, in any case.
NOT, NAMED, FORM, SURE = range(4)


def path_hash(outer: int, key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8, key=outer.to_bytes(8, "little", signed=True)).digest(), "little", signed=True) or 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


def marks(name: str) -> str | None:
    """The word by which a class, id or role marks an element as an aside, if any."""
    parts = [w.lower() for w in NAME_WORD.findall(name)]
    if not parts or parts[0] in MODIFIER_FIRST and len(parts) > 1 or parts[-1] in MODIFIER_LAST:
        return None
    while len(parts) > 1 and parts[-1] in CONTAINER_WORDS:
        parts.pop()
    return parts[-1] if parts[-1] in ASIDE_WORDS else None


_marks = lru_cache(100_000)(marks)


def _aside_of(tag: str, attributes: dict[str, str], rest: str, held: bool) -> int:
    if tag == "form":
        return FORM
    if tag in ASIDE:
        return SURE
    if tag in ("html", "body") or not rest.strip():
        return NAMED if tag == "header" and not held else NOT
    names = " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split()
    bare = ATTRIBUTE.sub(" ", rest) if attributes else rest
    if (re.search(r"display\s*:\s*none", attributes.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|$)", bare) or attributes.get("aria-hidden") == "true"
            or any(n.lower() in HIDDEN for n in attributes.get("class", "").split())):
        return SURE
    found = {word for n in names if (word := _marks(n))}
    if found & COMMENT_WORDS:
        return SURE
    if tag in HOLDERS and not held:
        return NOT
    return NAMED if found or tag == "header" and not held else NOT


def parse(html: str) -> Page:
    """Text runs and opened elements of a page. Broken markup is read as far as it goes: an end tag without start is left out.

    Places in the stack are kept by tag, so an end tag finds its start at once: the time is linear in the page, nested as it may be.
    """
    page, block, at = Page(), 0, 0
    stack: list[int] = [0]  # nodes
    places: dict[str, list[int]] = {}  # tag: places in the stack
    prose = held = 0

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def say(raw: str) -> None:
        if raw:
            page.runs.append(Run(stack[-1], block, entities.unescape(raw) if "&" in raw else raw, bool(places.get("a")), prose > 0))

    def close_to(n: int) -> None:
        nonlocal prose, held
        while len(stack) > n:
            tag = page.tag[stack.pop()]
            places[tag].pop()
            prose -= tag in PROSE
            held -= tag in HOLDERS

    while (m := MARKUP.search(html, at)) is not None:
        say(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if last(tag):
                close_to(last(tag))
            if tag in BLOCKS:
                block += 1
            continue
        if tag in BLOCKS:
            block += 1
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        if tag in ENDS_P and last("p"):
            close_to(last("p"))
        if tag in ENDS_SAME and last(tag) > max(last(outer) for outer in ENDS_SAME[tag]):
            close_to(last(tag))
        rest = m[3] or m[6] or ""
        if rest.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        attributes = _attributes(rest)
        key = tag
        for name, sign in (("class", "."), ("id", "#")):
            if attributes.get(name):
                key += sign + re.sub(r"\d+", "N", ".".join(sorted(attributes[name].split())))
        places.setdefault(tag, []).append(len(stack))
        stack.append(page.add(stack[-1], tag, key, _aside_of(tag, attributes, rest, held > 0)))
        prose += tag in PROSE
        held += tag in HOLDERS
        if tag in RAW:
            end = _raw_end(tag).search(html, at)
            at = end.end() if end else len(html)
            close_to(len(stack) - 1)
            block += 1
    say(html[at:])
    return page


@lru_cache(20)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE)


def tokens_of(page: Page) -> list[dict]:
    """A row for each token of a page, the page itself first (token 0): its parent, depth and tag, times it opens, first place, characters of main
    text below, of these in links, and a hash of all text below."""
    size = len(page.tag)
    aside, mass, link, text = page.asides(), [0] * size, [0] * size, [0] * size
    for run in page.runs:
        raw = run.text.strip()
        if raw:
            n = 0 if aside[run.node] else len(raw)
            mass[run.node] += n
            link[run.node] += n if run.link else 0
            text[run.node] = zlib.crc32(raw.encode("utf-8", "replace"), text[run.node])
    mass, link = page.below(mass), page.below(link)
    for node in range(size - 1, 0, -1):
        text[page.parent[node]] = zlib.crc32(text[node].to_bytes(4, "little"), text[page.parent[node]])
    out: dict[int, dict] = {}
    for node, token in enumerate(page.token):
        own = out.get(token)
        if own is None:
            own = out[token] = {"token": token, "parent": page.token[page.parent[node]], "depth": page.depth[node], "tag": page.tag[node], "times": 0, "place": node - 1, "mass": 0, "link": 0, "hash": 0}
        own["times"] += 1
        own["mass"] += mass[node]
        own["link"] += link[node]
        own["hash"] = zlib.crc32(text[node].to_bytes(4, "little"), own["hash"])
    return list(out.values())


@dataclass
class Template:
    """The classes of a host in page order, the containers of main text, the best first, and the tokens whose text never changes."""

    order: list[tuple[int, int]]  # token, class
    main: list[int]
    constant: set[int]

    def packed(self) -> str:
        return json.dumps([self.order, self.main, sorted(self.constant)])

    @classmethod
    def unpacked(cls, text: str) -> Template:
        order, main, constant = json.loads(text)
        return cls([tuple(x) for x in order], main, set(constant))


def deduce(tokens: list[dict], pages: int) -> Template:
    """``tokens``: token, parent, depth, tag, pages, times, vector, place, mass, link, same. Equal vectors form a class; the classes in which every
    token occurs once on each of its pages are the skeleton, in which the main container is looked for."""
    classes: dict[tuple, list[dict]] = {}
    for t in tokens:
        classes.setdefault((t["vector"], t["pages"], t["times"]), []).append(t)
    large = [sorted(c, key=lambda t: (t["place"], t["depth"], t["token"])) for c in classes.values() if len(c) > 1 or c[0]["times"] == c[0]["pages"]]
    large.sort(key=lambda c: (-c[0]["pages"], c[0]["place"], c[0]["token"]))
    order = sorted(((t["place"], t["depth"], t["token"], i) for i, c in enumerate(large) for t in c))
    skeleton = [t for c in large for t in c if t["token"] and t["times"] == t["pages"]]
    root_changes = any(t["token"] == 0 and not t["same"] for t in tokens)
    constant = {t["token"] for t in tokens if root_changes and t["same"] and t["pages"] >= 4 and t["token"]}
    return Template([(n, i) for _, _, n, i in order if n], _containers(skeleton, tokens, constant, pages), constant)


def _containers(skeleton: list[dict], tokens: list[dict], constant: set[int], pages: int = 1) -> list[int]:
    """Containers of main text, the best first: semantic ones by the text they hold, then the lowest that holds every slot, and those around
    it. 0 is the page.

    A slot is an element with text of its own, a character a page or more, that is not constant and not mostly links.
    """
    def worth(t: dict) -> float:
        return t["mass"] - 2 * t["link"]
    holders = sorted((t for t in skeleton if t["tag"] in HOLDERS and worth(t) > 0), key=lambda t: (-worth(t), -t["depth"], t["token"]))
    by_token = {t["token"]: t for t in tokens}
    outer = {n: t["parent"] if t["parent"] in by_token else 0 for n, t in by_token.items() if n}
    own = {n: [t["mass"], t["link"]] for n, t in by_token.items()}
    for n, parent in outer.items():
        if parent in own:
            own[parent][0] -= by_token[n]["mass"]
            own[parent][1] -= by_token[n]["link"]
    slots = {n: int(mass >= pages and mass > 2 * link and n not in constant) for n, (mass, link) in own.items()}
    total = sum(slots.values())
    if not total:
        return [t["token"] for t in holders]
    inside = dict(slots)
    lowest = 0
    for n in sorted(outer, key=lambda n: -by_token[n]["depth"]):
        if inside[n] == total:
            lowest = n
            break
        if outer[n] in inside:
            inside[outer[n]] += inside[n]
    known, around = {t["token"] for t in skeleton if t["tag"] not in PROSE}, []
    while lowest:
        if lowest in known:
            around.append(lowest)
        lowest = outer[lowest]
    return [t["token"] for t in holders] + around + [0]


def _holders_beside(page: Page, main: int, constant: set[int], aside: list[bool]) -> list[int]:
    """The other holders of text on a page whose main container is a holder: an article may be split over several."""
    nodes = [n for n, t in enumerate(page.token) if t == main]
    if not nodes or page.tag[nodes[0]] not in HOLDERS:
        return []
    around, node = {0, main}, nodes[0]
    while node:
        around.add(page.token[node])
        node = page.parent[node]
    within = page.spread(lambda n: page.token[n] == main)
    beside = page.spread(lambda n: n if page.tag[n] in HOLDERS and page.token[n] not in around and not within[n] else None)
    held: dict[int, int] = {}
    for run in page.runs:
        if not aside[run.node] and beside[run.node] and run.text.strip():
            token = page.token[beside[run.node]]
            held[token] = held.get(token, 0) + len(run.text.strip()) * (-1 if run.link else 1)
    return [n for n, size in held.items() if size > 0 and n not in constant]


def extract(html: str | None, template: Template | None) -> str:
    """The main text of a page by its host's template, or by the page alone where that does not fit it."""
    if not html:
        return ""
    page = parse(html)
    main, constant, aside = None, set(), page.asides()
    if template:
        opened: dict[int, int] = {}
        for node, token in enumerate(page.token):
            opened.setdefault(token, node)
        valid = _valid(template, opened)
        main = next((n for n in template.main if not n or n in opened and n in valid), None)
        constant = {n for n in template.constant if n in valid}
    if main is None:
        tokens = tokens_of(page)
        best = _containers(tokens[1:], tokens, set())
        main = best[0] if best else 0
    text = _slots(page, {main, *_holders_beside(page, main, constant, aside)}, main, constant, aside)
    return text or (_slots(page, {0}, 0, constant, aside) if main else "")


def _valid(template: Template, opened: dict[int, int]) -> set[int]:
    """Tokens of the classes that stand on this page in the template's order."""
    by_class: dict[int, list[tuple[int, int]]] = {}
    for token, i in template.order:
        if token in opened:
            by_class.setdefault(i, []).append((token, opened[token]))
    return {n for own in by_class.values() if all(a[1] < b[1] for a, b in zip(own, own[1:])) for n, _ in own}


def _slots(page: Page, mains: set[int], main: int, constant: set[int], aside: list[bool]) -> str:
    """The text in the main containers without asides and without slots that never change, a line for each block."""
    inside = page.spread(lambda n: page.token[n] in mains)
    blocks: dict[int, list[str]] = {}
    for run in page.runs:
        if aside[run.node] or not inside[run.node]:
            continue
        if constant and not (run.prose and main) and page.token[run.node] in constant:
            continue
        blocks.setdefault(run.block, []).append(run.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


_LONGS = ("token", "parent", "depth", "times", "place", "mass", "link", "hash")
_TOKENS = "_host string, page long, tag string, " + ", ".join(f"{c} long" for c in _LONGS)


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, ("_html",), 2 << 20):
        hosts, numbers, tags = [], [], []
        longs: dict[str, list[int]] = {c: [] for c in _LONGS}
        for host, page, html in zip(*(part.column(c).to_pylist() for c in ("_host", "_page", "_html"))):
            for t in tokens_of(parse(html)) if html else ():
                hosts.append(host)
                numbers.append(page)
                tags.append(t["tag"])
                for c in _LONGS:
                    longs[c].append(t[c])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(numbers, pa.int64()), pa.array(tags, pa.string()), *(pa.array(longs[c], pa.int64()) for c in _LONGS)],
                                         ["_host", "page", "tag", *_LONGS])


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        templates = [deduce(tokens.as_py(), pages.as_py()).packed() for tokens, pages in zip(batch.column("tokens"), batch.column("all"))]
        yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(templates, pa.string())], ["_host", "_template"])


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, template) from ``_host``, ``_page`` (a number of the page), ``_html``: deduced once for a host.

    An occurrence vector is not gathered: pages add a hash of their number and the token's count to an exclusive or, so equal
    vectors give equal sums, and a host with a third of all pages is aggregated before the shuffle. A token
    counts if it is on two pages and on ``support`` of the host's, so a host's row is bounded by twice the size of its pages.
    """
    found = pages.mapInArrow(_page_tokens, _TOKENS)
    by_token = found.groupBy("_host", "token", "parent", "depth", "tag").agg(
        F.count("*").alias("pages"), F.sum("times").alias("times"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.avg("place").alias("place"),
        F.sum("mass").alias("mass"), F.sum("link").alias("link"), (F.min("hash") == F.max("hash")).alias("same"))
    kept = stored(by_token.filter("pages > 1"), "page-tokens")
    whole = kept.filter("token = 0").select("_host", F.col("pages").alias("all"))
    frequent = kept.join(whole, "_host").filter(F.col("pages") >= F.col("all") * support)
    token = F.struct("token", "parent", "depth", "tag", "pages", "times", "vector", "place", "mass", "link", "same")
    return frequent.groupBy("_host").agg(F.max("all").alias("all"), F.collect_list(token).alias("tokens")).mapInArrow(_deduced, "_host string, _template string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for part in slices(batches, ("_html",), 2 << 20):
        texts = []
        for i, html in enumerate(part.column("_html").to_pylist()):
            host, template = part.column("_host")[i].as_py(), None
            if part.column("_template")[i].is_valid:
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Template.unpacked(part.column("_template")[i].as_py())
                template = known[host]
            texts.append(extract(html, template))
        yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Defined cases: a null or empty html has an empty text; pages without a host in the URL are one group; a host with
    one page, or a page that its host's template does not fit, is judged by the page alone; rows that repeat are
    extracted each; an empty table gives an empty one; other columns are not read.

    Scale: pages are parsed where they lie, twice: for their tokens (a few dozen small rows each, summed before the shuffle) and for their
    text. Templates are stored, a row for each host, so their true size decides between a broadcast and a shuffle join,
    whose hot hosts the skew join splits.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    rows = rows.withColumn("_host", F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), "://([^/?#]*)", 1)))
    found = stored(templates(rows.select("_host", F.xxhash64("_id", "_url").alias("_page"), "_html"), support), "templates")
    joined = rows.join(found, "_host", "left").select("_id", "_url", "_html", "_host", "_template")
    kind = dict(rows.dtypes)["_id"]
    out = joined.mapInArrow(_extract, f"_id {kind}, _url string, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
