"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of the text: code, chrome of the page, controls.
DROPPED = frozenset(
    "script style noscript template iframe object svg math canvas audio video head title nav footer aside button select textarea input label dialog menu".split()
)
#: An end tag closes only elements above these; a paragraph cannot hold them.
BLOCKS = frozenset(
    "html body p div section article main header hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary fieldset center hr".split()
) | {"nav", "footer", "aside", "form", "menu", "dialog"}
#: Opening one of these ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4".split())
#: Parts of names by what they say of an element: readers' remarks; other chrome; what a text may be about too, and then has few links.
REMARKS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Those that name readers' remarks whatever else the name says, but for a state; what marks a remark's author and its date.
SURELY = frozenset("comment comments commentlist commenter disqus".split())
AUTHORS = frozenset("author user username avatar commenter nick nickname poster byline".split())
DATES = frozenset("date time timestamp datetime ago posted published".split())
CHROME = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promoted promotion banner sidebar
    cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login
    recommended recommendations menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar
    toolbar popup modal overlay pager pagination paywall""".split()
)
TOPICAL = frozenset("share sharing social related more skip tags widget".split())
LIKELY = frozenset("article content main post entry body text story page column".split())
#: Parts that say where a piece stands or how it looks, and parts that make a name a state of the page, not a role: "has-sidebar".
PLACES = frozenset("box block section list area wrapper wrap container bar top bottom left right inner outer item items holder panel slot unit primary secondary read header title links buttons form message text".split())
STATES = frozenset("no not non has have with without is on off open closed show hide enabled disabled".split())
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "drop", "look", "marks", "name", "parent", "prior", "suspect")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, prior: float = 0.0, suspect: str = ""):
        self.name, self.parent, self.drop, self.prior, self.suspect, self.children = name, parent, drop, prior, suspect, []
        self.look, self.marks = "", 0


def says(name: str) -> str:
    """What one class or id says: "likely", "remark", "chrome", "maybe" (chrome, if its text is poor) or nothing."""
    parts = {x.lower() for x in NAMES.findall(name)}
    unlikely = parts & (REMARKS | CHROME)
    if parts & STATES or not (unlikely or parts & (TOPICAL | LIKELY)):
        return ""
    if parts & SURELY:
        return "remark"
    if not unlikely:
        return "likely" if parts & LIKELY else "maybe"
    if parts - unlikely - LIKELY - TOPICAL - PLACES:
        return "maybe"
    return "remark" if parts & REMARKS else "chrome"


def judged(name: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, float, str]:
    """Whether an element's subtree is dropped outright, its score before any paragraph counts, and what makes it suspect."""
    prior = {"article": 25.0, "main": 20.0, "section": 2.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}.get(name, 0.0)
    if name in DROPPED or name == "header" and not inside:
        return True, prior, ""
    suspect = "form" if name == "form" else ""
    if not attrs or name in ("html", "body"):
        return False, prior, suspect
    found: set[str] = set()
    for key, value in attrs:
        if key in ("class", "id") and value:
            found.update(map(says, value.split()))
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return True, prior, ""
        elif key == "role" and value and value.lower() in ROLES:
            return True, prior, ""
        elif key == "style" and value and HIDDEN.search(value.lower()):
            return True, prior, ""
    if "likely" in found:
        prior += 15.0
    for kind, loss in (("remark", 25.0), ("chrome", 25.0), ("maybe", 10.0)):
        if kind in found:
            # A name for each side: its text decides.
            return False, prior - loss, "maybe" if "likely" in found else kind
    return False, prior, suspect


def marked(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, int]:
    """An element's first class, and whether it marks an author (1) or a date (2)."""
    names = [v for k, v in attrs if k in ("class", "id", "itemprop", "rel") and v]
    parts = {x.lower() for v in names for x in NAMES.findall(v)}
    classes = next((v.split() for k, v in attrs if k == "class" and v), [])
    return classes[0] if classes else "", (1 if parts & AUTHORS else 0) | (2 if tag == "time" or parts & DATES else 0)


def talk(order: list[Node], chars: dict[Node, int]) -> list[Node]:
    """Readers' remarks by their structure, whatever their names: blocks that are nearly all made of three or more alike elements, each with an author, a date and no heading, behind text of another kind."""
    marks: dict[Node, int] = {}
    titled: set[Node] = set()
    for x in reversed(order):
        marks[x] = marks.get(x, 0) | x.marks
        if x.name in ("h1", "h2", "h3"):
            titled.add(x)
        if x.parent is not None:
            marks[x.parent] = marks.get(x.parent, 0) | marks[x]
            if x in titled:
                titled.add(x.parent)
    found, ahead, done = [], 0, set()
    for x in order:
        if x.parent in done:
            done.add(x)
            continue
        items = [c for c in x.children if isinstance(c, Node) and not c.drop and chars.get(c)]
        alike = [c for c in items if (c.name, c.look) == (items[0].name, items[0].look)] if len(items) > 2 else []
        signed = [c for c in alike if marks[c] == 3 and c not in titled]
        if len(signed) > 2 and len(signed) >= 0.8 * len(items) and sum(chars[c] for c in signed) >= 0.8 * chars[x] and ahead >= 140:
            found.append(x)
            done.add(x)
            continue
        ahead += sum(len(c.strip()) for c in x.children if isinstance(c, str)) if x.name != "a" else 0
    return found


def poor(x: Node, chars: int, links: int, total: int) -> bool:
    """Whether a suspect subtree is dropped: readers' remarks always, chrome unless it wraps nearly all of the page, forms that hold no more than half of it, others if short or made of links."""
    if x.suspect == "remark":
        return True
    if x.suspect == "chrome":
        return chars <= 0.8 * total or links > 0.5 * chars
    if x.suspect == "form":
        return chars <= 0.5 * total
    return links > 0.5 * chars or chars < (25 if x.name in SCORED else 0.25 * total)


class Tree(HTMLParser):
    """Element tree of possibly broken HTML: unclosed and misnested tags, a page cut anywhere."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end("p", BLOCKS - {"p"})
            if tag in CLOSES:
                for name in CLOSES[tag]:
                    self.end(name, CLOSE_WITHIN[tag])
        if tag in VOID:
            self.at.children.append(Node(tag, self.at))
            return
        node = Node(tag, self.at, *judged(tag, attrs, self.inside > 0))
        node.look, node.marks = marked(tag, attrs)
        self.at.children.append(node)
        self.at = node
        self.inside += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.end(tag, BLOCKS - {"p"} if tag not in BLOCKS else frozenset({"td", "th"}) - {tag} if tag not in ("table", "tr", "tbody", "body", "html") else frozenset())

    def end(self, tag: str, walls: frozenset[str] | set[str]) -> None:
        """Close the nearest open ``tag`` unless one of ``walls`` stands between."""
        node = self.at
        while node.parent is not None and node.name != tag:
            if node.name in walls:
                return
            node = node.parent
        if node.parent is None:
            return
        at = self.at
        while True:
            self.inside -= at.name in ("article", "main")
            if at is node:
                break
            at = at.parent
        self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def text_of(nodes: list[Node]) -> str:
    """Blocks of the subtrees in page order, one a line."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (line := SPACE.sub(" ", "".join(run)).strip()):
            blocks.append(line)
        run.clear()

    stack: list = [None]
    for x in reversed(nodes):
        stack += [None, x]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop:
            continue
        elif x.name == "br":
            run.append(" ")
        elif x.name in BLOCKS:
            flush()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    flush()
    return "\n".join(blocks)


def lengths(root: Node) -> tuple[dict[Node, int], dict[Node, int], dict[Node, int], list[Node]]:
    """Characters, characters in links and commas of every kept subtree, and the nodes in page order."""
    chars: dict[Node, int] = {}
    links: dict[Node, int] = {}
    commas: dict[Node, int] = {}
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        if x.drop:
            continue
        order.append(x)
        own = [c for c in x.children if isinstance(c, str)]
        chars[x] = sum(len(c.strip()) for c in own)
        commas[x] = sum(c.count(",") + c.count("、") + c.count("，") for c in own)
        links[x] = 0
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    for x in reversed(order):
        if x.name == "a":
            links[x] = chars[x]
        if x.parent is not None:
            chars[x.parent] += chars[x]
            links[x.parent] += links[x]
            commas[x.parent] += commas[x]
    return chars, links, commas, order


def main_text(html: str | None) -> str:
    """Text of the best container and its fitting siblings; empty if the page has none."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    chars, links, commas, order = lengths(tree.root)
    total = chars[tree.root]
    suspects = [x for x in order if x.suspect and poor(x, chars[x], links[x], total)] + talk(order, chars)
    if suspects:
        for x in suspects:
            x.drop = True
        chars, links, commas, order = lengths(tree.root)
    score: dict[Node, float] = {}
    for x in order:
        direct = x.name in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in x.children)
        if not (x.name in SCORED or direct) or not chars[x] or x.name == "li" and links[x] * 2 > chars[x]:
            continue
        points = 1 + commas[x] + min(chars[x] / 100, 3.0)
        up, level = x if direct else x.parent, 0
        while up is not None and up.name != "#root" and level < 5:
            score[up] = score.get(up, up.prior) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for x in order:
        if x.name in ("article", "main") and chars[x]:
            score.setdefault(x, x.prior)
    final = {x: s * (1 - links[x] / chars[x]) for x, s in score.items() if chars[x]}
    if not final:
        return text_of([tree.root])
    best = max(final, key=final.get)  # the first in page order among equals: dicts keep the order of insertion
    while best.parent in final and best.parent.name in ("article", "main"):
        best = best.parent
    if best.parent is None or best.name in ("article", "main", "body"):
        return text_of([x for x in (best.parent.children if best.name == "article" and best.parent else [best]) if x is best or isinstance(x, Node) and x.name == "article" and not x.drop and final.get(x, 0) >= 0.2 * final[best]])
    enough = max(10.0, 0.2 * final[best])
    chosen = []
    for x in best.parent.children:
        if x is best:
            chosen.append(x)
        elif isinstance(x, Node) and not x.drop:
            plain = chars[x] and links[x] <= 0.25 * chars[x]
            if final.get(x, 0) >= enough or x.name in ("h1", "h2", "h3") and plain or x.name in SCORED and plain and (chars[x] > 80 or commas[x] > 0):
                chosen.append(x)
    return text_of(chosen)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to ``pages``, dropping the column ``html``.

    Paragraphs pass points for length and commas to their ancestors, which are discounted by link
    density; the best container and the siblings that fit it are kept, without menus, page headers, footers, sidebars,
    notices, adverts, forms, code and readers' comments, which go by their names or by their structure (:func:`talk`). Classes and ids move the score; a subtree goes for its name only if its text is poor as well
    (:func:`poor`), so a wrapper that names a sidebar or a form around the whole page loses nothing. Every block kept is returned whole: white space inside a block is
    one space, blocks are joined by one line feed in page order.

    A null page or one without text gives an empty text; broken or cut markup is read as far as it
    goes. Each row is treated by itself, so ties, repeated rows and empty tables need no care; columns named ``text`` or
    ``n_chars`` are replaced. Work and memory are in proportion to a page.
    """
    bound_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[kept].copy()
            out["text"] = [main_text(x) for x in batch[html]]
            yield out

    schema = pages.select(*kept, F.lit("").cast("string").alias("text")).schema
    return pages.select(*kept, html).mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
