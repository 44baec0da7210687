"""Main text of web pages by tree scoring.

A forgiving parser makes a tree; paragraphs pass points for length and commas to their ancestors, half as many with each
step up; a container's points are discounted by its link density and weighed by its tag and names. The best container is
kept with those siblings that score alike, without what is marked as navigation, notice, advert, form or comment.
Pages of any depth are read and weighed without recursion, in one pass over their markup.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, rows_of, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
#: Element names by role (fixed values of the markup language).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
DROP = set("script style noscript template textarea title iframe svg noembed noframes xmp nav footer aside button select option input menu dialog head object embed canvas audio video label fieldset".split())
PARAGRAPH = set("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption div section article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "th", "tr", "thead", "tfoot", "caption"}
#: An opening tag ends an open one of these, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of names that mark what is no part of a main text, those of what is, and those that only mention others (fixed values).
_BAD = re.compile(r"ads?|advert\w*|adbox|banner|breadcrumbs?|combx|comments?|commentlist|disqus|community|consent|cookies?|disclaimer|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|alert|pager|pagination|popup|promo\w*|related|remark|replies|reply|respond|rss|search|share|sharing|shoutbox|sidebar|side|skip|skyscraper|social|sponsor\w*|subscribe|tags|toolbar|tweet|twitter|widget|login|signup|toc", re.I)
_GOOD = re.compile(r"article\w*|body|blog|content|entry|hentry|main|page|post|story|text", re.I)
_BESIDE = {"with", "has", "no", "without", "hide", "show"}
_COMMENTS = re.compile(r"comment|disqus|repl(?:y|ies)|respond|remark|shoutbox", re.I)
_BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_SPACE = re.compile(r"\s+")


def judged(names: str) -> int:
    """1 if an element's class and id speak for a main text, -1 against it, -2 for reader comments, 0 for neither."""
    good = bad = False
    for name in names.split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if any(x.lower() in _BESIDE for x in parts):
            continue
        g, b = any(_GOOD.fullmatch(x) for x in parts), any(_BAD.fullmatch(x) for x in parts)
        if b and (not g or _COMMENTS.search(name)):
            bad = True
        good |= g and not b
    if bad and not good:
        return -2 if _COMMENTS.search(names) else -1
    return int(good and not bad)


class Node:
    __slots__ = ("children", "gone", "inside", "letters", "names", "own", "parent", "role", "score", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.score, self.letters = tag, parent, [], 0.0, 0
        self.names, self.role, self.own, self.gone = "", "", True, False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def _attributes(text: str, pos: int, node: Node | None) -> int:
    """Read the attributes of a tag, from after its name, into the node; where the tag ends, -1 if it never does."""
    n = len(text)
    names = []
    while pos < n:
        if text[pos] == ">":
            if node is not None and names:
                node.names = " ".join(names)
            return pos + 1
        m = _ATTR.match(text, pos)
        if m is None:  # only space and slashes are left before the end
            pos = _next(text, pos)
            continue
        value, pos = "", m.end()
        if "=" in m[0][len(m[0]) - (m.end() - m.end(1)) :]:
            if pos < n and text[pos] in "\"'":
                end = text.find(text[pos], pos + 1)
                if end < 0:
                    return -1
                value, pos = text[pos + 1 : end], end + 1
            else:
                v = _VALUE.match(text, pos)
                value, pos = v[0], v.end()
        if node is not None:
            name = m[1].lower()
            if name in ("class", "id"):
                names.append(html.unescape(value))
            elif name == "role":
                node.role = value.lower()
            elif name == "hidden":
                node.own = False
    return -1


def _next(text: str, pos: int) -> int:
    while pos < len(text) and text[pos] != ">" and (text[pos].isspace() or text[pos] == "/"):
        pos += 1
    return pos


def parse(text: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are put right roughly as browsers do. A tag that never ends is dropped.

    One pass forward: open elements are held by tag, so that no tag looks through all that are open.
    """
    root = Node("#root", None)
    stack, opened = [root], defaultdict(list)
    pos, n = 0, len(text)

    def depth(tags, stops) -> int:
        """The depth of the innermost open element with one of the tags, 0 if there is none or a stop is further in."""
        found = max((opened[t][-1] for t in tags if opened[t]), default=0)
        return found if found >= max((opened[t][-1] for t in stops if opened[t]), default=0) else 0

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().tag].pop()

    def say(upto: int) -> None:
        if upto > pos:
            stack[-1].children.append(html.unescape(text[pos:upto]))

    ends: dict[str, re.Pattern] = {}
    at = 0  # where the search for a tag goes on, at pos or after it
    while (at := text.find("<", at)) >= 0:
        after = text[at + 1 : at + 2]
        if after == "!" or after == "?":
            say(at)
            mark, skip = ("-->", 4) if text.startswith("<!--", at) else (">", 2)
            end = text.find(mark, at + skip)
            if end < 0:
                return root
            pos = at = end + len(mark)
            continue
        closing = after == "/"
        m = _NAME.match(text, at + 1 + closing)
        if m is None:
            if closing:  # no name: read as a comment
                say(at)
                end = text.find(">", at)
                if end < 0:
                    return root
                pos = at = end + 1
            else:
                at += 1
            continue
        say(at)
        tag = m[0].lower()
        node = None if closing else Node(tag, stack[-1])
        end = _attributes(text, m.end(), node)
        if end < 0:
            return root
        short, pos, at = text[end - 2] == "/", end, end
        if closing:
            if tag == "p" and not depth({"p"}, BLOCK - {"p"}):
                continue
            if to := depth({tag}, {"td", "th", "table", "body"} - {tag} if tag not in ("html", "body", "table", "tr", "tbody", "thead", "tfoot") else ()):
                close(to)
            continue
        if tag in CLOSES_P and (to := depth({"p"}, {"td", "th", "table", "button", "object"})):
            close(to)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        if tag in ENDS and (to := depth(*ENDS[tag])):
            close(to)
        node.parent = stack[-1]
        node.inside = node.parent.inside or node.parent.tag in ("article", "main")
        stack[-1].children.append(node)
        if tag in RAW:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)
            found = ends[tag].search(text, pos)
            if found is None:
                return root
            pos = at = found.end()
        elif tag not in VOID and not (short and tag not in BLOCK):
            opened[tag].append(len(stack))
            stack.append(node)
    say(n)
    return root


def _walk(root: Node):
    """(node, whether it begins) of an element and all below it, in order; elements that are gone are left out."""
    stack = [(root, True)]
    while stack:
        n, begins = stack.pop()
        yield n, begins
        if begins and not isinstance(n, str):
            stack.append((n, False))
            stack.extend((c, True) for c in reversed(n.children) if isinstance(c, str) or not c.gone)


def mark(root: Node) -> None:
    """Say which elements are no part of a main text: by tag and role, and forms and by names unless they hold most of the page."""
    todo, named = [root], []
    while todo:
        n = todo.pop()
        n.gone = n.tag in DROP or not n.own or n.role in _BAD_ROLES or n.tag == "header" and not n.inside
        if not n.gone:
            if n.tag == "form":
                named.append((n, -1))
            elif n.names and n.tag not in ("html", "body", "article", "main") and (by := judged(n.names)) < 0:
                named.append((n, by))
            todo.extend(c for c in n.children if not isinstance(c, str))
    if not named:
        return
    for n, begins in _walk(root):
        if not isinstance(n, str) and not begins:
            n.letters = sum(len(c.strip()) if isinstance(c, str) else c.letters for c in n.children if isinstance(c, str) or not c.gone and c.tag != "a")
    for n, by in named:
        n.gone = by == -2 or 2 * n.letters <= root.letters


def measure(root: Node) -> list[tuple[Node, int, int]]:
    """The paragraphs with their letters and commas outside inner blocks; sets the link density of every element as its score."""
    paragraphs = []
    linked, stack = 0, []
    for n, begins in _walk(root):
        if isinstance(n, str):
            if begins:
                size, found = len(n.strip()), n.count(",") + n.count("、") + n.count("，")
                top = stack[-1]
                for j, v in enumerate((size, size * bool(linked), found, 0, size, found)):
                    top[j] += v
            continue
        if begins:
            stack.append([0, 0, 0, 0, 0, 0])  # letters, those in links, commas, whether blocks are inside, letters and commas outside them
            linked += n.tag == "a"
            continue
        linked -= n.tag == "a"
        letters, links, commas, blocks, inline, inline_commas = stack.pop()
        if n.tag in PARAGRAPH and inline:
            paragraphs.append((n, inline, inline_commas))
        n.score = links / letters if letters else 0.0
        if stack:
            top = stack[-1]
            top[0] += letters
            top[1] += links
            top[2] += commas
            if n.tag in BLOCK or blocks:
                top[3] = 1
            else:
                top[4] += letters
                top[5] += commas
    return paragraphs


def blocks_of(root: Node) -> list[str]:
    """The texts of the blocks of an element, in order."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        if s := _SPACE.sub(" ", "".join(line)).strip():
            out.append(s)
        line.clear()

    for n, begins in _walk(root):
        if isinstance(n, str):
            if begins:
                line.append(n)
        elif n.tag == "br":
            line.append(" " * begins)
        elif n.tag in BLOCK:
            flush()
    flush()
    return out


def main_text(text: str | None) -> str:
    """The main text of a page, one line for each block; empty for a null, empty or text-free page."""
    if not text:
        return ""
    root = parse(text)
    mark(root)
    points: dict[int, list] = {}

    def give(n: Node, score: float) -> None:
        if id(n) not in points:
            start = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0, "body": -5.0, "html": -10.0, "#root": -20.0}.get(n.tag, 0.0)
            start += 25.0 * judged(n.names) if n.names else 0.0
            if n.role in ("main", "article"):
                start += 25.0
            points[id(n)] = [n, start]
        points[id(n)][1] += score

    for n, letters, commas in measure(root):
        score = 1 + commas + min(letters / 100, 3)
        if n.tag in HEADINGS or n.tag == "li":
            score = min(score, 1) / 2
        to, share = (n if n.tag in ("div", "section", "article", "main", "td") else n.parent), 1.0
        while to is not None and share > 0.05:
            give(to, score * share)
            to, share = to.parent, share / 2
    ranked = [(s * (1 - n.score), -k, n) for k, (n, s) in enumerate(points.values())]
    if not ranked:
        kept: list = [root]
    else:
        top, _, best = max(ranked, key=lambda x: x[:2])
        kept = [best]
        if best.parent is not None:
            by = {id(n): s for s, _, n in ranked}
            least = max(10.0, top * 0.2)
            beside = [c for c in best.parent.children if not isinstance(c, str) and not c.gone]
            sure = [k for k, c in enumerate(beside) if c is best or by.get(id(c), 0) >= least or c.tag in ("article", "p", "h1") and _long(c)]
            part = [k in sure or sure[0] < k < sure[-1] and c.score < 0.5 or _alike(c, best) for k, c in enumerate(beside)]  # what stands between kept ones is kept
            kept = [c for c, keep in zip(beside, part, strict=True) if keep]
    return "\n".join(s for n in kept for s in blocks_of(n))


def _alike(n: Node, best: Node) -> bool:
    """Whether an element beside the best container is a part like it: in an article, or of its kind and names below the page's body."""
    up = best.parent
    among = up.inside or up.tag in ("article", "main") or up.role in ("main", "article") or judged(up.names) > 0
    return n.score < 0.25 and (among or n.tag == best.tag and n.names == best.names and up.tag not in ("body", "html", "#root"))


def _long(n: Node) -> bool:
    """Whether a paragraph beside the best container is one of the text: long, or a sentence, with few links."""
    s = " ".join(blocks_of(n))
    return n.tag in ("article", "h1") and bool(s) or n.score < 0.25 and len(s) > 80 or n.score == 0 and bool(re.search(r"\.( |$)", s))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. A null page is empty; repeated rows each get theirs."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(it):
        for batch in it:
            ids, urls, bodies = rows_of(batch, "page_id", "url", "html")
            texts = [main_text(b) for b in bodies]
            yield from batches({"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract(table(spark, sf_dir, "pages"))
