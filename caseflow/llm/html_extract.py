"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is the text between two block-level tags; inline tags and line breaks do not end it. Features are the names and the class,
id and role words of its ancestors, and its length, link share and ending. The chain is trained on labelled pages (composed ones of
known labels, and a bounded sample of the given pages that mark their article) and decoded by Viterbi.

Defined results: null or empty html, and pages without a content block, give an empty text; unclosed tags, comments and scripts
end where HTML lets them end; repeated rows give equal rows; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

#: Given pages that are learned from at most, by a hash of their html; longer ones than this many characters are not taken for that.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000
COMPOSED_PAGES, STEPS, RIDGE = 300, 150, 1e-3

# Fixed values of HTML: elements without content, with raw text, that do not break a block, and that a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("script style iframe noembed noframes template svg math canvas audio video object select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "parts", "linked")

    def __init__(self, path):
        self.path, self.parts, self.linked = path, [], 0


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of the leaf blocks of a page, in order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    cur: Block | None = None
    at, n = 0, len(page)
    hidden = links = 0

    def text(raw: str):
        nonlocal cur
        if hidden or not raw:
            return
        if cur is None:
            if raw.isspace():
                return
            cur = Block(tuple(stack))
            out.append(cur)
        cur.parts.append(raw)
        if links:
            cur.linked += len(raw)

    def pop(k: int):
        nonlocal hidden, links
        for name, _ in stack[k:]:
            hidden -= name in UNSEEN
            links -= name == "a"
        del stack[k:]

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            cur = None
        elif name == "br":
            text(" ")
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in VOID:
            continue
        closes = CLOSED_BY.get(name)
        if closes is None and name not in INLINE:
            closes = {"p"}
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p",):
                    break
        words: list[str] = []
        if "=" in m.group(3) or "hidden" in m.group(3):
            for key, *value in _NAMED.findall(m.group(3)):
                words += _WORD.findall("".join(value).lower()) if key.lower() in ("class", "id", "role") else ["hidden"]
        if m.group(3).endswith("/") and name in ("svg", "path"):
            continue
        stack.append((name, tuple(words)))
        hidden += name in UNSEEN
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            text(page[at : end.start() if end else n])
            at = end.start() if end else n
    return [(t, _features(b, t)) for b in out if (t := " ".join(html.unescape("".join(b.parts)).split()))]


def _features(b: Block, t: str) -> list[str]:
    f = {"bias"}
    for name, words in b.path:
        f.add("in:" + name)
        f.update("word:" + w for w in words)
    last = next((name for name, _ in reversed(b.path) if name not in INLINE), "")
    f.add("last:" + last)
    n = t.count(" ") + 1
    f.add(f"words:{min(n, 4) if n < 5 else 5 if n < 12 else 6 if n < 30 else 7}")
    f.add(f"links:{min(3, int(4 * b.linked / max(1, len(t))))}")
    f.add("stop" if t[-1] in ".!?\"”»:" else "open")
    return sorted(f)


# Labelled training pages. Containers whose names say what they hold, on the web at large.
_MAIN = ['<article>', '<main>', '<div class="content">', '<div class="post">', '<div class="entry-content">', '<div id="article-body">', '<section class="story">', '<div class="text">', '<div role="main">', '<div>']
_ASIDE = ['<nav>', '<header>', '<footer>', '<aside>', '<form>', '<div class="ad">', '<div class="ads banner">', '<div class="advert sponsored promo">', '<div class="sidebar widget">', '<div id="menu">', '<div class="navigation breadcrumb">',
          '<div class="footer copyright">', '<div class="header masthead">', '<div class="cookie notice">', '<div class="consent popup modal">', '<div class="comments">', '<section id="comments">', '<div class="comment reply">', '<div class="related share social">',
          '<div class="newsletter subscribe signup">', '<div class="login search">', '<div role="navigation">', '<div role="banner">', '<div role="contentinfo">', '<div role="complementary">', '<div class="hidden">', '<div class="disclaimer alert">']


def composed(rng: random.Random) -> list[tuple[list[str], int]]:
    """(features, label) of the blocks of one labelled page: words of the main text are made of m, all others of s."""
    def words(letter, a, b):
        return " ".join(letter * rng.randint(2, 9) for _ in range(rng.randint(a, b)))

    def close(tag):
        return f"</{re.match(r'<([a-z]+)', tag)[1]}>"

    def side(tag=None):
        tag = tag or rng.choice(_ASIDE)
        kind = rng.randrange(5)
        if kind == 0:
            inner = "<ul>" + "".join(f"<li><a href='#'>{words('s', 1, 3)}</a></li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        elif kind == 1:
            inner = f"<p>{words('s', 4, 40)}.</p>"
        elif kind == 2:
            inner = words("s", 3, 25) + "."
        elif kind == 3:
            inner = f"<h3>{words('s', 1, 3)}</h3><p>{words('s', 3, 30)}.</p>"
        else:
            inner = words("s", 1, 4)
        return f"{tag}{inner}{close(tag)}"

    tag = rng.choice(_MAIN)
    body = [f"<h1>{words('m', 2, 9)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 9)):
        kind = rng.randrange(12)
        if kind < 6:
            body.append(f"<p>{words('m', 1, 80)}.</p>")
        elif kind == 6:
            body.append(f"<h2>{words('m', 1, 6)}</h2>")
        elif kind == 7:
            body.append(f"<blockquote>{words('m', 5, 20)}.</blockquote>")
        elif kind == 8:
            body.append(f"<ul><li>{words('m', 2, 12)}</li><li>{words('m', 2, 12)}</li></ul>")
        elif kind == 9:
            body.append(f"<p>{words('m', 4, 20)} <a href='#'>{words('m', 1, 3)}</a> {words('m', 4, 20)}.</p>")
        elif kind == 10:
            body.append(f"<pre>{words('m', 3, 30)}</pre>")
        else:
            body.append(f"<table><tr><td>{words('m', 1, 3)}</td><td>{words('m', 1, 3)}</td></tr></table>")
        if rng.random() < 0.12:
            body.append(side(rng.choice(_ASIDE)))
    sides = ["".join(side() for _ in range(rng.randint(0, 4))) for _ in range(2)]
    page = f"<html><head><title>{words('s', 2, 8)}</title></head><body>{sides[0]}{tag}{''.join(body)}{close(tag)}{sides[1]}</body></html>"
    return [(f, int(t[0] == "m")) for t, f in blocks(page)]


_KEEP, _DROP = frozenset(("article", "main")), frozenset("nav header footer aside form head".split())
_DROP_WORDS = frozenset("ad ads advert banner sponsored sidebar menu navigation footer header cookie notice comment comments related share newsletter hidden popup".split())


def marked(page: str) -> list[tuple[list[str], int]] | None:
    """Labels of a given page that marks its article; None for others."""
    out, any_main = [], False
    for _, f in blocks(page):
        names = {x[3:] for x in f if x.startswith("in:")}
        words = {x[5:] for x in f if x.startswith("word:")}
        main = bool(names & _KEEP)
        any_main |= main
        out.append((f, int(main and not names & _DROP and not words & _DROP_WORDS)))
    return out if any_main else None


def train(pages: list[list[tuple[list[str], int]]]) -> dict:
    """Weights by the gradient of the chain's log-likelihood, all pages at once, padded to the longest."""
    pages = [p[:200] for p in pages if p]
    names = {f: i for i, f in enumerate(sorted({f for p in pages for fs, _ in p for f in fs}))}
    size, longest = len(pages), max(map(len, pages))
    y, mask = np.zeros((size, longest), int), np.zeros((size, longest), bool)
    ids, of = [], []
    for i, p in enumerate(pages):
        for t, (fs, label) in enumerate(p):
            y[i, t], mask[i, t] = label, True
            ids += [names[f] for f in fs]
            of += [i * longest + t] * len(fs)
    ids, of = np.array(ids), np.array(of)
    theta = {"w": np.zeros((len(names), 2)), "t": np.zeros((2, 2))}
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in theta.items()}
    total = mask.sum()
    for step in range(1, STEPS + 1):
        u = np.stack([np.bincount(of, theta["w"][ids, k], size * longest) for k in (0, 1)], 1).reshape(size, longest, 2)
        t = theta["t"]
        a, b = np.zeros_like(u), np.zeros_like(u)
        a[:, 0] = u[:, 0]
        for k in range(1, longest):
            x = np.logaddexp(a[:, k - 1, :1] + t[0], a[:, k - 1, 1:] + t[1]) + u[:, k]
            a[:, k] = np.where(mask[:, k, None], x, a[:, k - 1])
        for k in range(longest - 2, -1, -1):
            v = u[:, k + 1] + b[:, k + 1]
            x = np.logaddexp(t[:, 0] + v[:, :1], t[:, 1] + v[:, 1:])
            b[:, k] = np.where(mask[:, k + 1, None], x, 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        gold = np.eye(2)[y] * mask[:, :, None]
        gu = (p - gold).reshape(-1, 2)
        g = {"w": np.stack([np.bincount(ids, gu[of, k], len(names)) for k in (0, 1)], 1) / total + RIDGE * theta["w"]}
        pair = mask[:, 1:]
        e = np.exp(a[:, :-1, :, None] + t + (u + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        g["t"] = (e.sum((0, 1)) - seen) / total + RIDGE * t
        for k in theta:
            m, v = mom[k]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            theta[k] -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = theta["w"][:, 1] - theta["w"][:, 0]
    return {"w": {f: float(w[i]) for f, i in names.items()}, "t": theta["t"].tolist()}


def viterbi(scores: list[float], t: list[list[float]]) -> list[int]:
    """Best labels of a chain; scores: label 1 over label 0."""
    zero, one, back = 0.0, scores[0], []
    for s in scores[1:]:
        from0 = zero + t[0][0] >= one + t[1][0]
        from1 = zero + t[0][1] > one + t[1][1]
        back.append((0 if from0 else 1, 0 if from1 else 1))
        zero, one = (zero + t[0][0] if from0 else one + t[1][0]), (zero + t[0][1] if from1 else one + t[1][1]) + s
    out = [int(one > zero)]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1]


def main_text(page: str | None, model: dict) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    w = model["w"]
    labels = viterbi([sum(w.get(f, 0.0) for f in fs) for _, fs in found], model["t"])
    return " ".join(t for (t, _), y in zip(found, labels) if y)


def learn(pages: DataFrame) -> dict:
    rng = random.Random(7)
    upto = min(1 << 20, 1 + 4 * SAMPLE_PAGES * (1 << 20) // max(1, pages.count()))  # about four times the sample goes to the sort
    fit = pages.where(F.length("html").between(1, SAMPLE_CHARS)).select("html", F.xxhash64("html").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < upto)
    rows = fit.orderBy("h", "html").limit(SAMPLE_PAGES).collect()
    given = [x for r in rows if (x := marked(r["html"]))]
    return train([composed(rng) for _ in range(COMPOSED_PAGES)] + given)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    shared = spark.sparkContext.broadcast(learn(pages))
    kinds = dict(pages.dtypes)

    def run(batch):
        texts = [main_text(h, shared.value) for h in batch["html"].to_pylist()]
        return pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return map_batches(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
