"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features."""
from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretally.llm.common import extended

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = frozenset("script style noscript iframe template svg math object canvas textarea title select".split())
#: Elements that carry a structural mark for what they hold.
CONTAINERS = frozenset("article main nav header footer aside form section div ul ol dl table figure button dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
                   "sup time tt u var wbr input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SHELL = frozenset("nav aside footer form button dialog menu".split())
#: Words in class, id or role that tell of navigation, notices, adverts and forms.
SHELL_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline consent cookie cookies copyright dialog disclaimer "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar "
    "widget".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses discussion".split())
BODY_WORDS = frozenset("article body content entry main post story".split())

FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "heading", "in_main", "page_main",
            "shell", "comment")
#: Labelled blocks, one a line: the features in the order above, then 1 for main text.
LABELLED = """
0 1.0 0 0.0 6 1.0 0 0 0 0 0 0
1 1.0 0 0.0 1 1.0 0 0 0 0 0 0
1 1.0 1 1.0 1 1.0 0 0 0 0 0 0
3 1.0 2 1.0 2 1.0 0 0 0 0 0 0
5 0.8 1 1.0 9 0.0 0 0 0 0 0 0
8 0.0 1 1.0 9 0.0 1 0 0 0 0 1
6 0.0 3 0.0 80 0.0 1 0 0 0 0 1
2 0.0 40 0.0 55 0.0 1 0 0 0 0 1
45 0.0 9 0.0 60 0.0 0 0 0 0 0 1
60 0.05 45 0.0 30 0.0 0 0 0 0 0 1
120 0.1 60 0.0 3 0.0 0 0 0 0 0 1
30 0.0 12 0.0 14 1.0 0 0 0 0 0 1
18 0.1 70 0.0 22 0.0 0 0 0 0 0 1
14 0.0 35 0.0 40 0.0 0 0 0 0 0 1
2 0.0 50 0.0 70 0.0 0 0 0 0 0 1
1 0.0 40 0.0 33 0.0 0 0 0 0 0 1
4 0.0 62 0.0 2 1.0 0 0 0 0 0 0
6 0.2 3 1.0 0 0.0 0 0 0 0 0 0
9 0.0 2 1.0 3 1.0 0 0 0 0 0 0
7 0.5 80 0.0 5 1.0 0 0 0 0 0 0
40 0.9 70 0.0 35 0.9 0 0 0 0 0 0
25 0.7 12 0.9 30 0.8 0 0 0 0 0 0
2 0.0 1 1.0 4 0.6 0 0 0 0 0 0
5 0.0 0 0.0 0 0.0 0 0 0 0 0 0
40 0.0 0 0.0 0 0.0 0 0 0 0 0 1
8 0.0 6 0.0 9 0.0 1 1 1 0 0 1
1 0.0 40 0.0 50 0.0 0 1 1 0 0 1
1 0.0 0 0.0 0 0.0 0 1 1 0 0 1
3 0.0 90 0.0 12 0.1 0 1 1 0 0 1
20 0.0 1 1.0 0 0.0 0 1 1 0 0 1
70 0.1 8 0.0 90 0.0 0 1 1 0 0 1
6 1.0 30 0.0 44 0.0 0 1 1 0 0 1
2 1.0 3 1.0 4 1.0 0 1 1 0 0 1
15 0.5 9 0.0 2 0.0 0 1 1 0 0 1
5 0.0 1 1.0 8 0.0 0 0 1 0 0 0
30 0.0 90 0.0 0 0.0 0 0 1 0 0 0
80 0.0 2 1.0 8 0.0 0 0 1 0 0 0
2 1.0 2 1.0 2 1.0 0 0 1 0 0 0
6 0.0 4 1.0 50 0.0 1 0 1 0 0 0
10 0.0 60 0.0 0 0.0 0 0 1 0 0 0
8 0.0 1 1.0 9 0.0 0 0 0 1 0 0
20 0.0 90 0.0 0 0.0 0 0 0 1 0 0
70 0.0 50 0.0 60 0.0 0 0 0 1 0 0
3 0.0 60 0.0 40 0.0 1 0 0 1 0 0
1 1.0 1 1.0 1 1.0 0 0 1 1 0 0
12 0.0 1 1.0 8 0.0 0 0 1 1 0 0
40 0.0 30 0.0 35 0.0 0 1 1 1 0 0
2 0.0 80 0.0 66 0.0 0 1 1 1 0 0
7 0.3 25 0.0 9 0.0 1 1 1 1 0 0
90 0.0 45 0.0 70 0.0 0 1 1 1 0 0
25 0.0 90 0.0 30 0.0 0 0 0 0 1 0
60 0.0 40 0.0 55 0.0 0 0 0 0 1 0
3 0.0 25 0.0 40 0.0 1 0 0 0 1 0
15 0.0 60 0.0 12 0.0 0 0 1 0 1 0
50 0.0 12 0.0 20 0.0 0 1 1 0 1 0
2 0.0 70 0.0 30 0.0 1 1 1 0 1 0
1 0.0 40 0.0 4 0.0 1 0 1 0 1 0
4 0.0 1 0.0 1 0.5 0 0 1 0 1 0
33 0.0 20 0.0 18 0.0 0 0 1 0 1 0
80 0.0 14 0.0 66 0.0 0 0 1 0 1 0
9 0.0 30 0.0 2 1.0 0 0 0 0 1 0
120 0.0 33 0.0 48 0.0 0 0 0 0 1 0
14 0.0 80 0.0 90 0.0 0 0 0 0 1 0
1 0.0 5 0.0 0 0.0 0 0 0 0 1 0
6 0.5 55 0.0 24 0.0 0 0 0 0 1 0
17 0.0 44 0.0 3 0.3 1 0 0 0 1 0
44 0.0 60 0.0 75 0.0 0 0 1 0 0 0
12 0.0 70 0.0 85 0.0 0 0 1 0 0 0
1 0.0 33 0.0 40 0.0 0 0 1 0 0 0
95 0.1 22 0.0 14 0.0 0 0 1 0 0 0
18 0.0 9 0.5 1 1.0 0 0 1 0 0 0
55 0.0 0 0.0 60 0.0 0 0 1 0 0 0
3 0.0 2 1.0 90 0.0 1 0 1 0 0 0
28 0.0 15 0.0 33 0.0 0 0 1 0 0 0
1 1.0 60 0.0 70 0.0 0 1 1 0 0 1
30 0.0 25 0.0 35 0.0 0 1 1 0 0 1
4 0.0 6 0.0 0 0.0 1 1 1 0 0 1
10 0.8 40 0.1 12 0.0 0 1 1 0 0 1
2 0.0 2 0.0 2 0.0 0 1 1 0 0 1
65 0.0 3 0.0 20 0.0 0 0 0 0 0 1
22 0.0 5 0.0 38 0.0 0 0 0 0 0 1
5 0.0 20 0.0 35 0.0 0 0 0 0 0 1
50 0.0 1 1.0 6 0.0 0 0 0 0 0 1
4 1.0 90 0.0 80 0.0 0 0 0 0 0 0
3 0.7 12 0.0 4 0.8 0 0 0 0 0 0
6 0.0 4 0.0 3 0.0 0 0 0 0 0 0
2 0.0 5 0.0 2 0.0 0 0 0 0 0 0
16 0.0 3 1.0 2 1.0 0 0 0 0 0 1
12 0.0 90 0.0 0 0.0 0 0 0 0 0 1
"""


def blocks_of(html: str | None) -> list[dict]:
    """Flat text blocks in page order with the marks of what encloses them.

    Tolerates missing end tags, text after the last tag, a page cut off inside a
    tag, and end tags without a start. Scripts, styles, comments and titles hold no text.
    """
    out: list[dict] = []
    stack: list[tuple[str, int, bool, bool]] = []        # container, main (2 by element, 1 by name), shell, comment
    own = (0, False, False)                               # marks of an open paragraph-like element
    text: list[str] = []
    linked, in_link, heading = 0, False, False

    def marks(name, attributes):
        words, hidden = set(), False
        if attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role", "aria-label", "itemprop"):
                    words.update(re.split(r"[^a-z]+", value.lower()))
                elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                    hidden = True
        main = 2 if name in ("article", "main") else int(bool(words & BODY_WORDS))
        comment = bool(words & COMMENT_WORDS)
        inside = any(x[1] for x in stack)
        shell = hidden or name in SHELL or name == "header" and not inside or bool(words & SHELL_WORDS) and name not in ("article", "main")
        return 0 if comment else main, shell, comment

    def close():
        nonlocal text, linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append({
                "text": whole, "words": (n := whole.count(" ") + 1), "link": min(1.0, linked / n), "heading": heading,
                "in_main": max([own[0], *(x[1] for x in stack)]), "shell": own[1] or any(x[2] for x in stack),
                "comment": own[2] or any(x[3] for x in stack)})
        text, linked = [], 0

    def add(raw):
        nonlocal linked
        if raw:
            plain = unescape(raw) if "&" in raw else raw
            text.append(plain)
            if in_link:
                linked += len(plain.split())

    html, at = html or "", 0
    while (m := TAG.search(html, at)) is not None:
        add(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if not m[4] and not m[1]:                         # the page ends inside this tag
            break
        if m[1]:
            if name == "a":
                in_link = False
            elif name in INLINE:
                continue
            else:
                close()
                own, heading = (0, False, False), False
                if name in CONTAINERS and any(x[0] == name for x in stack):
                    in_link = False
                    while stack.pop()[0] != name:
                        pass
            continue
        if name in RAW:
            close_at = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close_at.end() if close_at else len(html)
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            text.append(" ")
        elif name not in INLINE:
            close()
            heading = name in HEADINGS
            found = marks(name, m[3])
            if name in CONTAINERS and not m[3].endswith("/"):
                stack.append((name, *found))
                own = (0, False, False)
            else:
                own = found
    else:
        add(html[at:])
    close()
    return out


def features(blocks: list[dict]) -> np.ndarray:
    """One row of FEATURES for each block; a missing neighbour counts as an empty one.

    Names like "content" mark the main part only on pages without such an element.
    """
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b["words"] for b in blocks], float)
    link = np.array([b["link"] for b in blocks])
    flag = lambda k: np.array([b[k] for b in blocks], float)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    main = flag("in_main")
    main = ((main > 0) & (main == main.max())).astype(float)
    return np.column_stack([words, link, before(words), before(link), after(words), after(link), flag("heading"), main,
                            np.full(len(blocks), main.max()), flag("shell"), flag("comment")])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """Decision tree by Gini impurity: a leaf is its label, a node (feature, threshold, left, right)."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best is None:
        return int(y.mean() >= 0.5)
    left = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree == 1)
    left = x[:, tree[0]] <= tree[1]
    out = np.zeros(len(x), bool)
    out[left], out[~left] = decide(tree[2], x[left]), decide(tree[3], x[~left])
    return out


def labelled_tree(table: str = LABELLED):
    rows = np.array([[float(v) for v in line.split()] for line in table.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def extract_main(pages: DataFrame, html: str = "html", tree=None) -> DataFrame:
    """Adds ``text`` (main blocks joined by one space), ``n_chars``, ``n_blocks`` and ``n_main_blocks``.

    A null or empty page gives an empty text. A page is parsed in the row that
    holds it, whole, whatever its length; nothing is shuffled. Columns named like
    the added ones are replaced.
    """
    tree = labelled_tree() if tree is None else tree

    def extract(batches):
        for batch in batches:
            rows = []
            for source in batch.column(batch.schema.get_field_index(html)).to_pylist():
                blocks = blocks_of(source)
                chosen = [b["text"] for b, keep in zip(blocks, decide(tree, features(blocks))) if keep]
                joined = " ".join(chosen)
                rows.append((joined, len(joined), len(blocks), len(chosen)))
            text, chars, n, kept = zip(*rows) if rows else ((), (), (), ())
            held = [i for i, c in enumerate(batch.schema.names) if c not in added]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in held), pa.array(text, pa.string()), pa.array(chars, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(kept, pa.int64())],
                [*(batch.schema.names[i] for i in held), *added])

    added = ("text", "n_chars", "n_blocks", "n_main_blocks")
    return pages.mapInArrow(
        extract, extended(pages.drop(*added), "text string, n_chars long, n_blocks long, n_main_blocks long"))


def page_texts(pages: DataFrame) -> DataFrame:
    return extract_main(pages.select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
