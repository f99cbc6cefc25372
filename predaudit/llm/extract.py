"""Main text of pages by a tree-structured graphical model over the DOM.

Every element and every text run has a hidden label: content or not. The potentials are those of a tree: of a node given the label
of its parent and its own kind, and of its marks (words of class, id and role), its length, its links and where it stands given its label. Messages are
passed upward from the leaves and downward from the root (sum-product), which gives the exact marginal of each label given the whole page. Text whose
marginal is at least one half is kept.

Training counts labelled nodes: those of ``LABELLED``, whose marked regions show menus, notices, adverts, forms, comments and the like, and those of at most
``TRAINING_PAGES`` pages, the first by a hash of page_id, that declare their one main region themselves (``article`` or ``main``); the
region is the label. Counts are added up by Spark, and only the table of potentials is sent to the tasks.

A class on a wrapper names the layout, not what it wraps: marks of ``body``, of a declared region and of what encloses it are observed as those of wrappers, and
words that are part of a longer name (``has-sidebar``) speak against an element only if it holds less than half of the page's text.

Defined results: null or empty html has no text; references are decoded, white space within a block becomes one space, blocks are trimmed, empty ones
left out, the others joined in page order by two line feeds; rows with a null or repeated page_id are extracted like any other; a very long page is
read whole by one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predaudit.llm.arrow import to_batch
from predaudit.llm.dom import PART, Page, parse

TRAINING_PAGES = 2000
SMOOTHING = 0.1
LABELLED_WEIGHT = 3
TEXTS_WEIGHT = 2.0  # of the lengths and links of all texts of a page together: those of one region repeat each other
NEVER = frozenset(["head", "script", "style", "noscript", "template", "textarea", "iframe", "title", "select", "button"])  # no text of a page's body

_BOILERPLATE = (
    "nav", "menu", "header", "footer", "sidebar", "aside", "cookie", "consent", "notice", "banner", "ad", "ads", "advert", "advertisement", "sponsored",
    "promo", "comment", "comments", "reply", "respond", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "newsletter", "subscribe", "signup", "login", "popup", "modal", "widget", "toolbar", "masthead", "copyright", "legal", "disclaimer", "tags", "meta",
    "byline", "skip", "search", "navbar", "topbar", "sitenav", "footnav", "hidden", "alert", "gdpr", "privacy",
)  # fixed words by which templates name such regions
_CONTENT = ("content", "article", "post", "entry", "main", "story", "body", "text", "page", "maincontent", "articlebody")

MAIN = "labelledmain"  # id of the main region of made-up pages, taken off before they are counted

FEATURE = pa.schema([("feature", pa.string()), ("label", pa.int64()), ("n", pa.int64())])
TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def labelled_pages() -> list[str]:
    """Small pages with their main region in ``article``, ``main`` or a marked ``div`` and one named region of boilerplate each."""
    paragraph = "<p>A paragraph of the story with several words in it, and a second clause.</p><p>Another one.</p>"
    pages = []
    for word in _BOILERPLATE:
        for tag in ("div", "section", "ul", "p", "aside"):
            inner = "<li>One more line</li>" if tag == "ul" else "Some words that are not part of the story."
            region = f'<{tag} class="{word}">{inner}</{tag}>'
            pages.append(f"<body><article><h1>Title</h1>{paragraph}{region}</article></body>")
            pages.append(f'<body>{region}<div class="content"><h1>Title</h1>{paragraph}</div></body>')
    for word in _CONTENT:
        pages.append(f'<body><div class="nav"><a href="/">Home</a></div><div class="{word}"><h1>Title</h1>{paragraph}</div></body>')
        pages.append(f'<body><article><div class="{word}"><h2>Title</h2>{paragraph}<ul><li>An item</li></ul></div></article></body>')
    for tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog"):
        pages.append(f"<body><article>{paragraph}<{tag}><p>Words of a {tag}.</p></{tag}></article><{tag}><ul><li><a href='/'>More</a></li></ul></{tag}></body>")
    for inner in ("<blockquote>Quoted words.</blockquote>", "<ul><li>An item</li></ul>", "<table><tr><td>A cell</td></tr></table>", "<pre>code</pre>",
                  "<div>Words.</div>", "<section><h2>Part</h2><p>Words.</p></section>", "<figure><figcaption>Caption</figcaption></figure>",
                  "<p>Text with <a href='/'>a link</a>, <em>stress</em> and <b>weight</b>.</p>", "<dl><dt>Term</dt><dd>Meaning</dd></dl>"):
        pages.append(f"<body><main>{paragraph}{inner}</main></body>")
        pages.append(f"<body><article>{inner}{paragraph}</article></body>")
    menu = '<ul><li><a href="/">One</a></li><li><a href="/b">Two</a></li></ul>'
    for word in ("nav", "top", "header", "bar", "links", "footer", "bottom", "sidebar"):  # stories in elements without a name
        for story in (f"<h1>Title</h1>{paragraph}", f"<h2>Title</h2>{paragraph}{paragraph}", paragraph):
            pages.append(f'<body><div id="{word}">{menu}</div><div id="labelledmain">{story}</div></body>')
            pages.append(f'<body><div id="labelledmain">{story}</div><div class="{word}">{menu}<p>Some words.</p></div></body>')
            pages.append(f'<body><div><div id="{word}"><a href="/">Home</a></div><div id="labelledmain"><div>{story}</div></div></div></body>')
    for word in ("has", "with", "no", "fixed", "layout"):  # wrappers named after something they only make room for
        for other in ("sidebar", "header", "comments", "ad", "legal"):
            pages.append(f'<body class="{word}-{other}"><nav>{menu}</nav><article class="{other}"><h1>Title</h1>{paragraph}</article><div><p>More words.</p></div></body>')
            pages.append(f'<body><div class="{other}-{word}"><main><h1>Title</h1>{paragraph}</main></div><div>{menu}</div></body>')
    for head in ("<header><h1>Title</h1></header>", "<header><h1>Title</h1><p>Under the title.</p></header>"):  # the header of a story, not of a site
        pages.append(f"<body><header><a href='/'>Home</a></header><article>{head}{paragraph}</article></body>")
        pages.append(f"<body><article>{head}{paragraph}</article><footer>Words.</footer></body>")
    return pages


def _length(text: str) -> str:
    return f"#length {min(9, len(text.strip()).bit_length())}"


def declared_region(page: Page) -> int | None:
    """The outermost ``article`` or ``main``, if there is just one."""
    inside, roots = [False] * len(page.kind), []
    for i, kind in enumerate(page.kind):
        within = page.parent[i] >= 0 and inside[page.parent[i]]
        if kind in ("article", "main"):
            if not within:
                roots.append(i)
            within = True
        inside[i] = within
    return roots[0] if len(roots) == 1 else None


def titled(page: Page) -> list[bool]:
    """Whether a node is or holds the page's first ``h1``."""
    found = [False] * len(page.kind)
    node = next((i for i, kind in enumerate(page.kind) if kind == "h1"), 0)
    while node > 0:
        found[node] = True
        node = page.parent[node]
    return found


def large(page: Page) -> list[bool]:
    """Whether a node holds at least half of the page's text."""
    mass = [len(t.strip()) if k == "#text" else 0 for t, k in zip(page.text, page.kind)]
    for i in range(len(mass) - 1, 0, -1):
        if page.kind[i] not in NEVER:
            mass[page.parent[i]] += mass[i]
    return [2 * m >= mass[0] for m in mass]


def edge_kinds(page: Page) -> list[str]:
    """Kind of every node for its tie to the parent: the tag, whether marks can tell more, and whether a header holds the title."""
    return [
        f"{k}{'*' if m and not big else ''}{'^' if t and k == 'header' else ''}"
        for k, m, t, big in zip(page.kind, page.marks, titled(page), large(page))
    ]


def observations(page: Page) -> list[tuple[str, ...]]:
    """Features of every node that do not depend on labels."""
    n, region, big = len(page.kind), declared_region(page), large(page)
    encloses = [False] * n
    node = -1 if region is None else region
    while node >= 0:
        encloses[node] = True
        node = page.parent[node]
    linked, inside, found = [False] * n, [False] * n, []
    for i, (kind, parent) in enumerate(zip(page.kind, page.parent)):
        linked[i] = kind == "a" or (parent >= 0 and linked[parent])
        inside[i] = i == region or (parent >= 0 and inside[parent])
        if kind == "#text":
            features = (_length(page.text[i]), f"#link {linked[i]}") if page.text[i].strip() else ()
        elif encloses[i] or kind == "body":
            features = tuple(f".~{m}" for m in page.marks[i])
        else:
            features = tuple(("+" if big[i] and m.startswith(PART) else ".") + m.removeprefix(PART) for m in page.marks[i])
        if region is not None and not (encloses[i] or inside[i]) and (features or kind != "#text"):
            features += ("#out of region" if kind == "#text" else ".out of region",)
        found.append(features)
    return found


def labels_of(page: Page, declared: bool) -> list[int] | None:
    """Labels from the declared main region, less the regions in it that are named as boilerplate. None without one such region."""
    region = declared_region(page)
    roots = [] if region is None else [region]
    if not roots and not declared:
        roots = [i for i, m in enumerate(page.marks) if MAIN in m] or [i for i, m in enumerate(page.marks) if set(m) & set(_CONTENT)][:1]
    if len(roots) != 1:
        return None
    inside, title = [0] * len(page.kind), titled(page)
    for i, kind in enumerate(page.kind):
        parent = page.parent[i]
        if i == roots[0]:
            inside[i] = 1
        elif parent >= 0 and inside[parent]:
            named = {m.removeprefix(PART) for m in page.marks[i]} & set(_BOILERPLATE)
            out = kind in NEVER or kind in ("nav", "footer", "aside", "form", "menu", "dialog") or (kind == "header" and not title[i]) or named
            inside[i] = 0 if out else 1
    for i in range(roots[0], 0, -1):  # what encloses content only passes it on
        if inside[i] and page.kind[page.parent[i]] in ("#root", "html", "body", "div", "section"):
            inside[page.parent[i]] = 1
    return inside


def count(page: Page, labels: list[int], into: Counter, weight: int = 1, measured: bool = True) -> None:
    """Count a labelled page. Lengths and links of made-up text say nothing, so ``measured`` leaves them out."""
    kinds = edge_kinds(page)
    for i, features in enumerate(observations(page)):
        if i and (page.kind[i] != "#text" or features):
            into[f"{kinds[i]}|{labels[page.parent[i]]}", labels[i]] += weight
            group = "#text" if page.kind[i] == "#text" else "#element"
            if group == "#element" or measured:
                into[group, labels[i]] += weight
                for f in features:
                    if f[0] != "+":
                        into[f, labels[i]] += weight


class Model:
    """Potentials from counts: of a node's label given its parent's label and its kind, and of each feature given the label."""

    def __init__(self, counts: dict[tuple[str, int], float]):
        self.counts = counts
        self.edge_cache: dict[str, tuple] = {}
        self.own_cache: dict[tuple, float] = {}
        self.total = {g: [counts.get((g, y), 0) + 1 for y in (0, 1)] for g in ("#text", "#element")}

    def edge(self, kind: str) -> tuple[float, float, float, float]:
        """P(label of the child | label of the parent) as (0|0, 1|0, 0|1, 1|1). Kinds never seen keep their parent's label mostly."""
        if kind not in self.edge_cache:
            rows = []
            for parent in (0, 1):
                n = [self.counts.get((f"{kind}|{parent}", y), 0) + (2 if y == parent else 0.02) * SMOOTHING for y in (0, 1)]
                rows += [n[0] / sum(n), n[1] / sum(n)]
            self.edge_cache[kind] = (1.0, 0.0, 1.0, 0.0) if kind.rstrip("*") in NEVER else tuple(rows)
        return self.edge_cache[kind]

    def own(self, features: tuple[str, ...]) -> float:
        """Log-likelihood ratio of a node's features: content against not."""
        if features not in self.own_cache:
            ratio = 0.0
            for f in features:
                name = f".{f[1:]}" if f[0] == "+" else f
                seen = [self.counts.get((name, y), 0) for y in (0, 1)]
                if sum(seen):
                    total = self.total["#element" if name[0] == "." else "#text"]
                    found = math.log((seen[1] + SMOOTHING) / total[1]) - math.log((seen[0] + SMOOTHING) / total[0])
                    ratio += max(0.0, found) if f[0] == "+" else found
            self.own_cache[features] = ratio
        return self.own_cache[features]


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of every node given the whole page, by sum-product messages up and down the tree."""
    n = len(page.kind)
    parent, edges = page.parent, [model.edge(k) for k in edge_kinds(page)]
    texts = page.kind.count("#text")
    weight = min(1.0, TEXTS_WEIGHT / max(1, texts))
    logs = [model.own(f) * (weight if k == "#text" else 1.0) for k, f in zip(page.kind, observations(page))]
    belief = [(1.0, math.exp(x)) if x < 0 else (math.exp(-min(x, 300.0)), 1.0) for x in logs]
    belief[0] = (0.0, 1.0)  # the root encloses the content, if any
    up = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        b0, b1 = belief[i]
        e = edges[i]
        m0, m1 = e[0] * b0 + e[1] * b1, e[2] * b0 + e[3] * b1
        s = m0 + m1
        up[i] = m0, m1 = m0 / s, m1 / s
        p0, p1 = belief[parent[i]]
        p0, p1 = p0 * m0, p1 * m1
        s = p0 + p1 or 1.0
        belief[parent[i]] = (p0 / s, p1 / s)
    total = sum(belief[0])
    marginal = [(belief[0][0] / total, belief[0][1] / total)] + [(0.0, 0.0)] * (n - 1)
    for i in range(1, n):
        m0, m1 = up[i]
        q0, q1 = marginal[parent[i]]
        q0, q1 = (q0 / m0 if m0 else 0.0), (q1 / m1 if m1 else 0.0)  # the parent without this child's message
        e, (b0, b1) = edges[i], belief[i]
        r0, r1 = (q0 * e[0] + q1 * e[2]) * b0, (q0 * e[1] + q1 * e[3]) * b1
        s = r0 + r1
        marginal[i] = (r0 / s, r1 / s) if s else (1.0, 0.0)
    return [m[1] for m in marginal]


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    blocks: dict[int, list[str]] = {}
    for i, p in enumerate(marginals(page, model)):
        if page.kind[i] == "#text" and (p >= 0.5 or not page.text[i].strip()):
            blocks.setdefault(page.block[i], []).append(page.text[i])
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = parse(source or "")
            if labels := labels_of(page, declared=True):
                count(page, labels, found)
    yield to_batch([(f, y, n) for (f, y), n in found.items()], FEATURE)


def train(pages: DataFrame) -> dict[tuple[str, int], float]:
    """Counts of labelled nodes. The sample bounds the rows that are broadcast and the counts that are collected."""
    sample = pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(TRAINING_PAGES)
    chosen = pages.join(sample.hint("broadcast"), "page_id").select(F.col("html").cast("string").alias("html"))
    rows = (
        chosen.mapInArrow(_counted, "feature string, label long, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    )
    counts: Counter = Counter()
    for source in labelled_pages():
        page = parse(source)
        labels = labels_of(page, declared=False)
        page.marks = [tuple(m for m in marks if m != MAIN) for marks in page.marks]
        count(page, labels, counts, LABELLED_WEIGHT, measured=False)
    for row in rows:
        counts[row["feature"], row["label"]] += row["n"]
    return dict(counts)


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            rows = []
            for page_id, url, source in zip(*[c.to_pylist() for c in batch.columns]):
                text = extract(source, model)
                rows.append((page_id, url, text, len(text)))
            yield to_batch(rows, TEXT)

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(_extracted(shared), "page_id long, url string, text string, n_chars long")
