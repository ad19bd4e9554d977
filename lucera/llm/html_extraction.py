"""Operator 5: main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores positive: the probability, under weights
fitted on labelled pages, that words in such a place are main text. A tag scores negative: a
little for any, more the further that probability falls where its element begins and ends. One
linear scan (`best_region`) finds the contiguous region of greatest sum; elements whose own sum
is negative (adverts, notices, comments, forms ... inside the article) are left out of it as the
scan passes them. Blocks are cut at block-level tags and character references are decoded.

The place of a word is the set of features of the elements around it: tag names, parts of class,
id and role names, and, outside articles, whether an element is a list of links. A logistic model over
these sets is fitted on labelled pages of two sorts: pages of the table whose markup marks one
main element (article or main), at most MAX_PAGES of them (least hashes of page_id, at most
MAX_CHARS characters, a documented bound), and `seed_pages`, which hold the kinds of element
that the table's pages may lack. Both are counted alike; there is no list of elements to cut.
The features of an element that encloses the page's main text count for nothing: html, body,
what holds the body or every article, and a form or a box that holds nearly all words.

Defined results: null or empty html, and pages without words, give an empty text; an element
that is never closed ends with its parent and its names count for nothing; names such as
no-sidebar or comments-open state something and count for nothing either; ties between regions
go to the first; repeated rows, extra columns and empty tables pass through.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import small_batches, table

MAX_PAGES, MAX_CHARS = 400, 200_000
#: Cost of any tag, of a whole fall of the probability, and the score of a word that is hardly main text.
TAG_LEAST, FALL_COST, WORD_LEAST = 0.02, 1.0, 1e-5
#: Share of an element's words in links from which it is a list of links; share of a page's words it must hold to enclose them.
LINKED, ENCLOSES = 0.8, 0.9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_ITSELF = frozenset("p li td th tr dt dd option".split())
#: Parts of names that state something about an element instead of naming it.
_STATES = frozenset("no not non has is with without open closed enabled disabled free hide hidden off on".split())
#: Elements that hold the whole page only by holding its article.
_SIDES = frozenset("nav header footer aside head title menu".split())


def features(name: str, attrs: str, in_article: bool) -> tuple[str, ...]:
    """Of an element: its tag (headers and footers of an article apart) and the parts of its names."""
    out = [] if name in _INLINE else [f"{name}@article" if in_article and name in ("header", "footer") else name]
    if "=" in attrs:
        for m in _NAMES.finditer(attrs):
            for whole in (m.group(1) or m.group(2) or m.group(3) or "").split():
                parts = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", whole).lower())
                if not _STATES.intersection(parts):
                    out += [f".{p}" for p in parts]
    return tuple(dict.fromkeys(out))


class Page:
    """Tokens (kind, name, text, element), and elements: parent, feats, start, end, closed, words, linked.

    Kinds: 'w' words, 's' and 'e' start and end of an element, 'v' an element without content, 'x' a
    script, style or the like. A token belongs to the innermost element around it; -1 is none.
    """

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str, str, int]] = []
        self.name, self.parent, self.feats, self.start, self.end, self.closed = [], [], [], [], [], []
        stack, articles, links = [], 0, 0
        own, linked, number = Counter(), Counter(), Counter()
        self.in_article = []

        def close(to: int, here: bool) -> None:
            nonlocal articles, links
            while len(stack) > to:
                e = stack.pop()
                self.end[e], self.closed[e] = len(self.tokens) + (1 if here and len(stack) == to else 0), here and len(stack) == to
                articles -= self.name[e] in ("article", "main")
                links -= self.name[e] == "a"

        for m in _TOKEN.finditer(html):
            t = m.group(0)
            at = stack[-1] if stack else -1
            if m.group(1):
                self.tokens.append(("x", m.group(1).lower(), "", at))
            elif m.group(2):
                name = m.group(2).lower()
                if t[1] == "/":
                    k = next((k for k in range(len(stack) - 1, -1, -1) if self.name[stack[k]] == name), None)
                    if k is None:
                        self.tokens.append(("v", name, "", at))
                    else:
                        e = stack[k]
                        close(k, True)
                        self.tokens.append(("e", name, "", e))
                elif name in _VOID or t.endswith("/>"):
                    self.tokens.append(("v", name, "", at))
                else:
                    if name in _ENDS_ITSELF and stack and self.name[at] == name:
                        close(len(stack) - 1, False)
                        self.closed[at] = True
                    e = len(self.name)
                    self.name.append(name)
                    self.parent.append(stack[-1] if stack else -1)
                    self.feats.append(features(name, m.group(3), articles > 0))
                    self.start.append(len(self.tokens))
                    self.end.append(0)
                    self.closed.append(False)
                    self.in_article.append(articles > 0)
                    number[e] = int(name == "a")
                    stack.append(e)
                    articles += name in ("article", "main")
                    links += name == "a"
                    self.tokens.append(("s", name, "", e))
            elif t[0] != "<" or t == "<":
                n = len(t.split())
                own[at] += n
                linked[at] += n if links else 0
                self.tokens.append(("w", "", t, at))
        close(0, False)
        for e in range(len(self.name) - 1, -1, -1):
            own[self.parent[e]] += own[e]
            linked[self.parent[e]] += linked[e]
            number[self.parent[e]] += number[e]
        self.words, self.total = own, own[-1]
        for e, name in enumerate(self.name):
            if name not in _INLINE and name not in ("article", "main") and not self.in_article[e] and number[e] > 1 and linked[e] >= LINKED * own[e]:
                self.feats[e] += ("linked",)

    def enclosing(self, bad) -> set[int]:
        """Elements around the page's main text: html, body, what holds the body or every outermost
        article that is not itself bad, and a box that holds nearly all words."""
        body = next((self.start[e] for e, n in enumerate(self.name) if n == "body"), None)
        marks, until = [], -1
        for e, n in enumerate(self.name):
            if n in ("article", "main") and self.start[e] >= until and not bad(self.feats[e]):
                marks.append(self.start[e])
                until = self.end[e]
        out = set()
        for e, name in enumerate(self.name):
            lo, hi = bisect_left(marks, self.start[e]), bisect_left(marks, self.end[e])
            whole = not marks and name not in _SIDES and self.words[e] >= ENCLOSES * self.total
            if name in ("html", "body") or (body is not None and self.start[e] <= body < self.end[e]) or (marks and hi - lo == len(marks)) or whole:
                out.add(e)
        return out

    def places(self, model: Model) -> list[int]:
        """The model's number of the feature set around each element's content."""
        around = self.enclosing(model.bad)
        out = []
        for e, feats in enumerate(self.feats):
            above = out[self.parent[e]] if self.parent[e] >= 0 else 0
            drop = (e in around and self.name[e] not in ("article", "main")) or (not self.closed[e] and self.name[e] not in _ENDS_ITSELF)
            out.append(above if drop else model.place(above, feats))
        return out


class Model:
    """Logistic weights of features; feature sets met so far are numbered, 0 is the empty one."""

    MOST = 100_000

    def __init__(self, weights: dict[str, float] | None = None, bias: float = 0.0):
        self.weights, self.bias = weights or {}, bias
        self._clear()

    def _clear(self):
        self.sets, self.known, self.p = [frozenset()], {}, [self._probability(frozenset())]

    def _probability(self, s) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in s)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def bad(self, feats) -> bool:
        return self._probability(feats) < 0.5

    def place(self, above: int, feats: tuple[str, ...]) -> int:
        got = self.known.get((above, feats))
        if got is None:
            s = self.sets[above].union(feats)
            got = self.known[(above, feats)] = len(self.sets) if len(s) > len(self.sets[above]) else above
            if got == len(self.sets):
                self.sets.append(s)
                self.p.append(self._probability(s))
        return got

    @staticmethod
    def fitted(counts: dict[frozenset, list[float]], decay: float = 0.01) -> Model:
        """Weights of most likelihood for (main, other) word masses by feature set, with weight decay (Newton steps)."""
        names = sorted({f for s in counts for f in s})
        place = {f: i + 1 for i, f in enumerate(names)}
        x = np.zeros((len(counts), len(names) + 1))
        x[:, 0] = 1
        for i, s in enumerate(counts):
            x[i, [place[f] for f in s]] = 1
        mass = np.array(list(counts.values()))
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            n = mass.sum(1)
            slope = x.T @ (mass[:, 0] - n * p) - decay * w
            bend = (x * (n * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        return Model({f: float(w[place[f]]) for f in names}, float(w[0]))


#: Kinds of main text and of what is beside it, in labelled seed pages. 'm' words are main, 's' words are not.
MAIN_KINDS = [
    "<h1>m m m</h1><p>m m m m m m m m</p><p>m m m m <a href='/'>m m</a> m m m</p>", "m m m m m m m m m m", "<p>m m m m m</p><ul><li>m m m</li><li>m <a>m</a> m</li></ul><p>m m m</p>",
    "<h2>m m</h2><blockquote><p>m m m m</p></blockquote><p>m m m m m</p><ol><li><p>m m m</p></li></ol>", "<table><tbody><tr><th>m m</th><td>m m m m</td></tr></tbody></table><p>m m m m</p>",
    "<p>m m m m</p><pre>m m m m</pre><figure><figcaption>m m m</figcaption></figure><dl><dt>m</dt><dd>m m m</dd></dl>", "<div><p>m m m m m</p></div><div>m m m m m m</div><section><h3>m</h3><p>m m m m m</p></section>",
]
MAIN_BOXES = [
    "{}", "<div>{}</div>", "<article>{}</article>", "<main>{}</main>", "<section>{}</section>", "<div class='content'>{}</div>", "<div class='post'><div class='entry-content'>{}</div></div>", "<div id='main'>{}</div>",
    "<article class='post'><header><h1>m m m</h1></header>{}</article>", "<main><div class='story-body'>{}</div></main>", "<table><tr><td>{}</td></tr></table>", "<div class='article-text'>{}</div>",
]
SIDE_TAGS = "nav header footer aside form menu dialog button select".split()
SIDE_NAMES = (
    "ad ads advert adverts advertisement sponsored promo promotion sidebar widget comment comments respond discussion disqus replies notice notices cookie cookies consent gdpr banner "
    "menu nav navigation navbar breadcrumb breadcrumbs footer header masthead related recommended share sharing social newsletter subscribe signup login popup search pagination tags byline toolbar"
).split()
SIDE_BODIES = ["s s s s", "<p>s s s s s</p>", "<ul><li><a>s</a></li><li><a>s s</a></li><li><a>s</a></li></ul>", "<div><h3>s s</h3><p>s s s s s s s</p></div>", "<article class='comment'><p>s s s s s s</p></article>"]


def seed_pages() -> list[str]:
    """Labelled pages: each kind of side element before, after and inside main text of changing kinds."""
    sides = [f"<{t}>{{}}</{t}>" for t in SIDE_TAGS] + [f"<div class='{n}'>{{}}</div>" for n in SIDE_NAMES] + [f"<section id='{n}'>{{}}</section>" for n in SIDE_NAMES]
    sides += [f"<p class='{n}'>{{}}</p>" for n in ("ad", "byline")] + ["<article><footer>s s s s</footer></article>", "<div>{}</div>", "<ul>{}</ul>"]
    out = []
    for i, side in enumerate(sides):
        plain = side in ("<div>{}</div>", "<ul>{}</ul>")
        for k in range(6):
            main, box = MAIN_KINDS[(i + 2 * k) % len(MAIN_KINDS)], MAIN_BOXES[2 if k == 1 else (i * 5 + k) % len(MAIN_BOXES)]
            body = SIDE_BODIES[2] if plain else SIDE_BODIES[(i + k) % (5 if "comment" in side or "repl" in side else 4)]
            extra = side.replace("{}", body)
            if k % 2:
                page = box.format(main + extra + "<p>m m m</p>")
            else:
                page = {0: extra + box.format(main), 2: box.format(main) + extra, 4: f"<table><tr><td>{extra}</td><td>{box.format(main)}</td></tr></table>"}[k]
            out.append(f"<html><head><title>s s s</title></head><body>{page}</body></html>")
    return out


def learn(model: Model, counts: dict, page: Page, main) -> None:
    """Adds the page's words (a mass of 1 in all) by feature set; main(token index, text) -> masses of main and other words."""
    places = page.places(model)
    got = {}
    for i, (kind, _, text, e) in enumerate(page.tokens):
        if kind == "w" and (n := main(i, text, e)):
            s = model.sets[places[e] if e >= 0 else 0]
            cell = got.setdefault(s, [0.0, 0.0])
            cell[0] += n[0]
            cell[1] += n[1]
    total = sum(a + b for a, b in got.values())
    for s, (a, b) in got.items():
        cell = counts.setdefault(s, [0.0, 0.0])
        cell[0] += a / total
        cell[1] += b / total


def model_of(labelled: list[str]) -> Model:
    """Fitted on the seed pages, then on these and the labelled pages together. Words of a labelled
    page's main element that the seeds' model takes for something else teach nothing."""
    counts: dict = {}
    blank = Model()
    for html in seed_pages():
        learn(blank, counts, Page(html), lambda i, text, e: (text.split().count("m"), text.split().count("s")))
    first = Model.fitted(counts)
    for html in labelled:
        page = Page(html)
        marks = [e for e, n in enumerate(page.name) if n in ("article", "main")]
        if len(marks) != 1 or not page.closed[marks[0]]:
            continue
        a, b, places = page.start[marks[0]], page.end[marks[0]], page.places(first)

        def main(i, text, e, a=a, b=b, places=places):
            n = len(text.split())
            if not a <= i < b:
                return (0, n) if n else None
            return (n, 0) if n and first.p[places[e]] >= 0.5 else None

        learn(first, counts, page, main)
    return Model.fitted(counts)


def best_region(scores: list[float], spans: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
    """First contiguous range [a, b) of greatest positive sum, leaving out spans (nested or apart, by
    start) whose own sum is negative, and these spans; (0, 0, []) if no sum is positive."""
    total = [0.0, *accumulate(scores)]
    # sums of spans from the inside out: what is left out inside a span does not count in it
    lost, holes, inner = {}, [], []
    for a, b in sorted(spans, key=lambda s: (s[1], -s[0])):
        gone = 0.0
        while inner and inner[-1][0] >= a:
            gone += inner.pop()[1]
        own = total[b] - total[a] - gone
        if own < 0:
            lost[a] = max(b, lost.get(a, 0))
        inner.append((a, total[b] - total[a] if own < 0 else gone))
    best, a, b, run, start, i = 0.0, 0, 0, 0.0, 0, 0
    while i < len(scores):
        if run <= 0:
            run, start = 0.0, i
        if i in lost:
            holes.append((i, lost[i]))
            i = lost[i]
            continue
        run += scores[i]
        i += 1
        if run > best:
            best, a, b = run, start, i
    return a, b, [h for h in holes if a <= h[0] < b]


def scored(page: Page, model: Model) -> tuple[list[float], list[tuple[int, int]]]:
    """Scores of tokens, and spans of the elements that may be left out."""
    places = page.places(model)
    chance = [model.p[k] for k in places]
    outside = model.p[0]
    scores = []
    for kind, name, text, e in page.tokens:
        if kind == "w":
            n = len(text.split())
            p = chance[e] if e >= 0 else outside
            scores.append(n * (p if p >= 0.5 else WORD_LEAST) if n else 0.0)
        elif kind in "se" and name not in _INLINE:
            up = page.parent[e]
            fall = (chance[up] if up >= 0 else outside) - chance[e]
            scores.append(-TAG_LEAST - FALL_COST * abs(fall))
        else:
            scores.append(-TAG_LEAST)
    return scores, [(a, b) for a, b, n in zip(page.start, page.end, page.name, strict=True) if n not in _INLINE]


def main_text(html: str, model: Model) -> str:
    page = Page(html)
    a, b, holes = best_region(*scored(page, model))
    gone = dict(holes)
    blocks, now, i = [], [], a
    while i < b:
        if i in gone:
            blocks.append(now)
            now, i = [], gone[i]
            continue
        kind, name, text, _ = page.tokens[i]
        i += 1
        if kind == "w":
            now.append(text)
        elif name == "br":
            now.append(" ")
        elif kind != "x" and name not in _INLINE:
            blocks.append(now)
            now = []
    blocks.append(now)
    done = (" ".join(entities.unescape("".join(x)).split()) for x in blocks if x)
    return "\n\n".join(x for x in done if x)


def fitted(pages: DataFrame) -> Model:
    ids = pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(MAX_PAGES).distinct()
    sample = pages.select("page_id", "html").filter(F.length("html") <= MAX_CHARS).join(F.broadcast(ids), "page_id")
    return model_of([r["html"] for r in sample.orderBy(F.xxhash64("page_id"), "html").limit(MAX_PAGES).collect()])


def extracted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    small_batches(spark)
    fit = fitted(pages)
    weights, bias = fit.weights, fit.bias

    def run(batches):
        model = Model(weights, bias)
        for batch in batches:
            if len(model.sets) > Model.MOST:
                model._clear()
            text = [main_text(h or "", model) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, table(spark, sf_dir, "pages"))
