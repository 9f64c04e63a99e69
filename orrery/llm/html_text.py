"""Main text of web pages: flat text blocks, classified by a decision tree trained on a small labelled table.

A page is cut into flat blocks at block-level tags. A block is described by its own words and link density and by those of the
blocks before and after it; besides, by whether it is a heading, stands inside elements meant for page furniture (footer,
aside and the like, but not menus, which their links tell), is named as furniture or hidden by an attribute of an element
around it, or stands in an article and in no menu of it. The tree (Gini, exact splits) is trained on the blocks of the pages made
of LAYOUTS, in which main text is marked by a leading "+"; gains of the four last features count for half (HINTS), so words and
links are asked first. Text outside an article is judged as any other text.

Cases: null and empty pages give an empty text; unclosed comments, raw texts (_RAW: scripts, styles and the like) and tags
reach to the end of the page; any other unclosed element ends with its parent, svg and select also before a tag that can't
stand in them, and nav, menu and button before an article, main or h1; "/>" ends an svg and the elements in it; texts of
formulas stand in their paragraph; a "<" that opens no tag is text; a quote opens an attribute value only after "="; a link
reaches over blocks up to its end, the next link or the end of its parent; line breaks are white space; character
references without semicolon are decoded as browsers do; rows that repeat a page_id are extracted each; an empty table
gives no rows; other columns are ignored. The time is linear in the length of a page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common

#: A comment, a declaration or a tag with its attributes; possessive, so that it never looks at a character twice.
_TOKEN = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"""
    r"""((?:[^=>]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)"""
)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea iframe title".split())
_FURNITURE = frozenset("footer aside form header button dialog head template select option optgroup svg".split())
_MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
_BREAKS = frozenset("article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
_MAIN = frozenset("article main".split())
#: Elements that an article, main or h1 ends if they are left open.
_MENUS = frozenset("nav menu button".split())
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")  # such a value ends with its "/"
_ATTRS = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|[\s\"'])(?:hidden(?![\w:-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: Words that make furniture of a name that they open or end.
_STRONG = frozenset("ad ads advert adverts advertisement comment comments cookie cookies consent newsletter sidebar breadcrumb breadcrumbs navbar footer pagination disqus promo sponsor sponsored popup modal".split())
#: Words of class names that stand for furniture, and words that may stand beside them.
_NAMES = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored comment comments reply replies respond sidebar side menu nav navbar navigation footer header breadcrumb breadcrumbs cookie cookies "
    "consent notice newsletter subscribe share sharing social related popup modal widget login signup search pagination pager disqus complementary contentinfo alert toolbar".split()
)
_BESIDE = frozenset("site page box wrap wrapper container block area section list bar inner outer top bottom left right col column link links item items post posts main body content buttons button the global primary secondary form panel slot unit".split())
_GOOD = frozenset("article content post entry story main".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose opening ends an open paragraph; an open <p> or <li> holds no other one.
_ALONE = frozenset("p li dt dd td th tr option".split())


def named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role names furniture or an attribute hides the element, and whether a name names content: every part
    of a name has to be a known word, unless a strong one opens or ends it, so "site-footer" and "user-comments" are furniture,
    but "social-history" and "side-by-side" aren't."""
    good = False
    bad = bool(attributes) and bool(_HIDDEN.search(attributes))
    for found in _ATTRS.findall(attributes) if attributes else ():
        for name in "".join(found).split():
            row = [x.lower() for x in _PARTS.split(name) if x and not x.isdigit()]
            parts = set(row)
            bad = bad or bool(parts & _NAMES) and (parts <= _NAMES | _BESIDE or bool({row[0], row[-1]} & _STRONG))
            good = good or bool(parts & _GOOD) and parts <= _GOOD | _BESIDE
    return bad, good


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool, bool, str]]:
    """(text, words, words in links, in a furniture tag, in a furniture class, in article, tag) of every flat block in order."""
    out: list = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, furniture tag, furniture class, article
    opened: Counter = Counter()
    link: int | None = None  # depth of the element that an open link stands in
    linked = 0
    tag = ""
    aside: list[str] = []  # text of an inline element named as furniture, which doesn't part the text around it
    inline: list[str] = []  # the open inline elements from that one on

    def put(s: str, inside: int) -> None:
        joined = " ".join(html.unescape(s).split())
        if joined:
            words = joined.count(" ") + 1
            out.append((joined, words, min(inside, words), stack[-1][1] if stack else False, True, stack[-1][3] if stack else False, tag))

    def flush():
        nonlocal linked
        if inline:
            inline.clear()
            put("".join(aside), 0)
            aside.clear()
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            _, bad, hint, good = stack[-1] if stack else ("", False, False, False)
            words = joined.count(" ") + 1
            out.append((joined, words, min(linked, words), bad, hint, good, tag))
        linked = 0

    def data(s: str):
        nonlocal linked
        if s and inline:
            aside.append(s)
        elif s:
            text.append(s)
            if link is not None:
                linked += len(s.split())

    def pop():
        nonlocal link
        name = stack.pop()[0]
        opened[name] -= 1
        if link is not None and len(stack) < link:
            link = None

    def pop_to(names) -> None:
        """Ends the outermost open element of these names and all in it."""
        while any(opened[n] for n in names):
            pop()

    page, at = page or "", 0
    while m := _TOKEN.search(page, at):
        data(page[at : m.start()])
        at = m.end()
        close, name = m[1], (m[2] or "").lower()
        if not name or name in _MATH:
            continue
        drawn = name == "svg" or opened["svg"] > 0
        ended = drawn and not close and m[3].endswith("/") and not _UNQUOTED.search(m[3][-200:])
        if name in _RAW and not close and not ended:
            end = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            flush()
            at = end.end() if end else len(page)
            continue
        if name == "a":
            link = None if close else len(stack)
        bad, good = (False, False) if close else named(m[3])
        if name in _INLINE:
            if name == "br":
                (aside if inline else text).append(" ")
            elif close and name in inline:
                while inline.pop() != name:
                    pass
                if not inline:
                    put("".join(aside), 0)
                    aside.clear()
                    text.append(" ")
            elif not close and name not in _VOID and (inline or bad):
                inline.append(name)
            continue
        flush()
        if close:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            tag = stack[-1][0] if stack else ""
        elif name not in _VOID and not ended:
            if name in _BREAKS and not opened["foreignobject"]:
                pop_to(("svg", "select"))
            if name in _MAIN or name == "h1":
                pop_to(_MENUS)
            if name in _ALONE and stack and stack[-1][0] == name:
                pop()
            up = stack[-1] if stack else ("", False, False, False)
            furniture = up[1] or name in _FURNITURE and not (name == "header" and up[3])
            hint = up[2] or bad and name not in ("body", "html", *_MAIN)
            stack.append((name, furniture, hint, (up[3] or good or name in _MAIN) and name not in _MENUS))
            opened[name] += 1
            tag = name
    data(page[at:])
    flush()
    return out


FEATURES = ["words", "link density", "words before", "link density before", "words behind", "link density behind", "heading", "furniture element", "named as furniture", "in an article"]
#: Features whose gains count for half, by their places.
HINTS = (6, 7, 8, 9)


def features(found: list) -> np.ndarray:
    """The FEATURES of each block."""
    n = len(found)
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    near = lambda x, d: np.concatenate([[0.0], x[:-1]]) if d < 0 else np.concatenate([x[1:], [0.0]])
    cols = [words, density, near(words, -1), near(density, -1), near(words, 1), near(density, 1)]
    cols += [np.array([b[6] in _HEADS for b in found], float), *(np.array([b[i] for b in found], float) for i in (3, 4, 5))]
    return np.stack(cols, axis=1) if n else np.zeros((0, len(FEATURES)))


#: Layouts of labelled pages: main text blocks open with "+"; "~" stands for 1 to 60 words, "~~" for 20 to 80, "^" for 1 to 4.
LAYOUTS = [
    '<head><title>~</title></head><nav><ul><li><a href=x>^</a><li><a href=x>^</a><li><a href=x>^</a></ul></nav><div class="ad">~</div><article><h1>+~</h1><p>+^<p>+~~<p>+~ <a href=x>^</a><p>+~</article><footer>&copy; ~</footer>',
    '<div class="ad">~</div><article><h1>+~</h1><p>+~</p><p>+^</p><p>+~~</p></article><footer>~</footer>',
    '<header><h1>^</h1><p>~</header><div class="sidebar"><h3>^</h3><p>~~</div><main><h2>+^</h2><p>+~<p>+<a href=x>^</a><div class="comments"><p>~</div></main><footer><p>^</footer>',
    '<div id="cookie-notice"><p>~</div><div class="content"><h1>+^</h1><p>+~<p>+^<form><p>^<input></form><aside><p>~</aside></div><div class="footer">~</div>',
    '<div class="cookie-consent">~</div><div class="site-header">^</div><div><h1>+^</h1><p>+~~<p>+~~<p>+~~</div><div class="newsletter-box">~~</div><div class="site-footer">~</div>',
    "<h1>+^</h1><p>+~~<p>+~~<p>+~~<p><a href=x>^</a> <a href=x>^</a>",
    "<p><a href=x>^</a> <a href=x>^</a><h2>+^</h2><p>+~~<p>+~~ <a href=x>^</a> ~~<p><a href=x>^</a>",
    '<nav><a href=x>^</a></nav><article><header><h1>+~</h1></header><p>+~<ul><li>+~<li>+^</ul><div class="share"><a href=x>^</a></div><section class="comments"><article><p>~</article></section></article>',
    '<div class="newsletter">~</div><article><p>+~<p>+^</article><div class="related"><h3>^</h3><ul><li><a href=x>~</a></ul></div>',
    "<table><tr><td><a href=x>^</a><tr><td><a href=x>^</a><tr><td><a href=x>^</a><tr><td><a href=x>^</a></table><div><h1>+^</h1><div>+~~</div><div>+~~</div></div><div><a href=x>^</a> <a href=x>^</a></div>",
    "<div><a href=x>^</a></div><div><a href=x>^</a></div><div><a href=x>^</a></div><h1>+^</h1><p>+~~<p>+~~<p>+^<p>+~~<div><a href=x>^</a></div><div><a href=x>^</a></div>",
    "<ul><li><a href=x>~</a><li><a href=x>~</a><li><a href=x>~</a></ul><div><div>+~~</div><blockquote>+~~</blockquote><div>+~~</div></div><ul><li><a href=x>^</a><li><a href=x>^</a></ul>",
    '<div class="navbar"><span>^</span></div><div class="post"><h2>+^</h2><p>+~<div class="grid side-by-side"><p>+^<p>+^</div><section id="social-history"><h3>+^</h3><p>+~</section><div class="ad-slot">~</div><p>+~</div><div class="comment-list"><p>^<p>~~</div>',
    "<main><p>+~<ol><li>+<a href=x>~</a><li>+<a href=x>^</a></ol><figure><img><figcaption>+^</figcaption></figure></main><nav><a href=x>^</a><a href=x>^</a></nav><footer><ul><li><a href=x>^</a><li>^</ul></footer>",
    "<nav><ul><li><a href=x>^</a><li><a href=x>^</a><li><a href=x>^</a></ul></nav><aside><p>~~</aside><article><h1>+^</h1><p>+^<p>+^</article><form><label>^</label><p>~</form>",
    "<article><p>+^</article><footer><p>~~<p><a href=x>^</a></footer>",
    "<p>+~<p>+~",
    "<nav><a href=x>^</a> <a href=x>^</a></nav><article><p>+^<p>+~</article><nav><a href=x>^</a></nav>",
    "<nav>^ <a href=x>^</a> <a href=x>^</a> <a href=x>^</a></nav><article><section><p>+^</section><div>+^</div></article><footer>~</footer>",
    "<article><h1>+^</h1><nav><a href=x>^</a><a href=x>^</a></nav><p>+~<p>+^<p>+<a href=x>~</a><p>+~</article><nav><ul><li><a href=x>~</a><li><a href=x>^</a></ul></nav>",
    "<article><p>+~~<p>+~<div class='user-comments'><p>~~<p>^<p>~</div><p hidden>~</p></article>",
    "<body><h1>+^</h1><p>+~<p>+^</body>",
    "<div>^ <a href=x>^</a> <a href=x>^</a></div><article><p>+^ <a href=x>^</a> ^<p>+^<p>+^ <a href=x>^</a><p>+~ <a href=x>~</a></article><div><a href=x>^</a> ^ <a href=x>^</a></div>",
    "<header><a href=x>^</a></header><aside>~~</aside><div><h1>+^</h1><p>+~~<p>+~~</div><aside><h3>^</h3><p>~~</aside><footer>~~</footer>",
]
#: Pages made of each layout, with lengths drawn anew.
DRAWS = 8


def labelled_pages(seed: int = 5) -> list[str]:
    """The labelled table, made of LAYOUTS."""
    draw = np.random.default_rng(seed)
    span = {"~~": (20, 80), "~": (1, 60), "^": (1, 4)}
    long = lambda m: " ".join(["w"] * int(np.exp(draw.uniform(np.log(span[m[0]][0]), np.log(span[m[0]][1] + 1)))))
    return [re.sub(r"~~|~|\^", long, page) for _ in range(DRAWS) for page in LAYOUTS]


TRAINING_PAGES = labelled_pages()
#: Blocks in a leaf of the tree.
LEAST = 2


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """(feature, threshold, left, right) nested; leaves are (label,)."""
    if depth == 0 or len(set(y)) < 2:
        return (bool(2 * y.sum() >= len(y)) if len(y) else False,)
    best, whole = None, len(y) * y.mean() * (1 - y.mean())
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), len(y) - left.sum()) < LEAST:
                continue
            cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
            cost = (cost + whole) / 2 if j in HINTS else cost
            if best is None or cost < best[0] - 1e-12:
                best = (cost, j, float(cut))
    if best is None:
        return (bool(2 * y.sum() >= len(y)),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], train_tree(x[left], y[left], depth - 1), train_tree(x[~left], y[~left], depth - 1))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, decide(tree[2], x), decide(tree[3], x))


def trained(pages=TRAINING_PAGES) -> tuple:
    found = [blocks(p) for p in pages]
    x = np.concatenate([features(b) for b in found])
    return train_tree(x, np.array([t[0].startswith("+") for b in found for t in b], float))


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, decide(tree, features(found))) if keep)


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    common.text_batches(pages.sparkSession)
    tree = tree or trained()

    @common.tidy
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                text = [main_text(h, tree) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
