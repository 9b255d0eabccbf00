"""Main text of web pages by boosted trees over the nodes of the page, decoded as a hierarchy.

The trees are fitted on a bounded sample of pages whose markup says what the article is. As one
site's markup says little about the next, each sample page is also rebuilt in other forms: the same
paragraphs under other elements and class names, with menus, notices, forms, side bars and reader
comments made of other pages' text around them, so that the labels are known by construction.
"""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.boosting import Trees, fit_trees
from farsight.llm.common import arrow_map, bounded_sample, texts_of
from farsight.llm.dom import Page, parse
from farsight.llm.registry import query, table

# Sample pages that the model is fitted on, and forms in which each is rebuilt.
TRAIN_PAGES, FORMS = 240, 4
MAIN = frozenset(("article", "main"))
ASIDE = frozenset(("nav", "aside", "header", "footer", "form", "menu", "dialog", "button"))
LISTS = frozenset(("li", "ul", "ol", "dl", "dt", "dd", "menu"))
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
AD_TOKENS = frozenset("ad ads advert sponsor promo banner cookie notice comment comments sidebar menu footer share related newsletter".split())


# --- features ---------------------------------------------------------------------


def features(page: Page, tokens: dict[str, float]) -> np.ndarray:
    """One row per node: subtree density, attribute words, depth, sibling and ancestor statistics."""
    nodes = page.nodes
    n = len(nodes)
    size, links, stops, lines, kids = ([getattr(x, k) for x in nodes] for k in ("own", "links", "stops", "lines", "depth"))
    kids = [0] * n
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        size[p] += size[k]
        links[p] += links[k]
        stops[p] += stops[k]
        lines[p] += lines[k]
        kids[p] += 1
    total = max(size[0], 1)
    before, seen = [0] * n, [0] * n
    low, high, main, aside = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = Counter((x.parent, x.tag) for x in nodes)
    out = np.zeros((n, WIDTH))
    for k, x in enumerate(nodes):
        p = max(x.parent, 0)
        own = sum(tokens.get(t, 0.0) for t in x.tokens)
        low[k], high[k] = min(low[p], own), max(high[p], own)
        main[k], aside[k] = main[p] or x.tag in MAIN, aside[p] or x.tag in ASIDE
        around = len(nodes[p].children)
        rest = max(size[p] - size[k], 0)
        chars = max(size[k], 1)
        seen[k] = before[p]
        before[p] += 1
        out[k] = (
            x.depth, math.log1p(size[k]), math.log1p(x.own), links[k] / chars, stops[k] / chars, lines[k],
            size[k] / max(lines[k], 1), size[k] / total, kids[k], around, same[(x.parent, x.tag)], seen[k] / max(around, 1),
            rest / max(around - 1, 1), max(links[p] - links[k], 0) / max(rest, 1), size[p] / total, links[p] / max(size[p], 1),
            own, low[k], high[k], x.tag == "p", x.tag in HEADS, x.tag in LISTS, x.tag in ("div", "section", "td"),
            main[k], aside[k],
        )
    return out


WIDTH = 25


# --- labels and rebuilt pages -----------------------------------------------------


def marked_labels(page: Page) -> list[int]:
    """1 within the article that the markup names, 0 outside, -1 for what holds both or is unknown."""
    nodes = page.nodes
    out = [-1] * len(nodes)
    mixed = set()
    for k, x in enumerate(nodes):
        if x.tag in MAIN:
            p = x.parent
            while p >= 0 and p not in mixed:
                mixed.add(p)
                p = nodes[p].parent
    if not mixed:
        return out
    for k, x in enumerate(nodes):
        above = out[x.parent] if k else -1
        if above == 0 or x.tag in ASIDE or AD_TOKENS & set(x.tokens):
            out[k] = 0
        elif above == 1 or x.tag in MAIN:
            out[k] = 1
        elif k not in mixed:
            out[k] = 0
    return out


# Class names of rebuilt pages.
_MAIN_NAMES = "content post entry story article-body main-text post-content entry-content text body-copy page-content".split()
_WRAP_NAMES = "wrapper container page layout row col site grid".split()
_SIDE = [
    ("nav", "menu"), ("ul", "menu nav-links"), ("div", "navigation"), ("div", "breadcrumb"), ("aside", "sidebar"), ("div", "side-bar widget"),
    ("div", "related links"), ("div", "ad"), ("div", "advert banner"), ("div", "sponsor"), ("div", "cookie notice"), ("div", "alert notice"),
    ("form", "search"), ("form", "newsletter signup"), ("footer", ""), ("div", "footer"), ("header", ""), ("div", "header top"), ("div", "share social"),
    ("section", "comments"), ("div", "comment-list"), ("ol", "comments replies"),
]


def rebuild(title: str, paragraphs: list[str], strange: list[str], rng: random.Random) -> tuple[str, list[str]]:
    """Another page with these paragraphs, and ``strange`` text around them: (html, its main lines)."""

    def words(most: int) -> str:
        pick = rng.choice(strange).split() or ["x"]
        a = rng.randrange(len(pick))
        return " ".join(pick[a : a + rng.randint(1, most)]) or pick[0]

    def side() -> str:
        tag, name = rng.choice(_SIDE)
        attributes = f' {rng.choice(("class", "id"))}="{name}"' if name and rng.random() < 0.85 else ""
        if "comment" in name:
            inner = "".join(f"<{w}><p>{escape(words(60))}</p></{w}>" for w in ["li" if tag == "ol" else "div"] * rng.randint(1, 6))
        elif tag in ("nav", "ul") or "menu" in name or "nav" in name or "links" in name or "bread" in name:
            items = "".join(f'<li><a href="#">{escape(words(3))}</a></li>' for _ in range(rng.randint(2, 9)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif tag == "form":
            inner = f"<label>{escape(words(4))}</label><input><button>{escape(words(2))}</button>"
        else:
            inner = escape(words(25)) if rng.random() < 0.5 else f"<p>{escape(words(25))}</p>" + f'<a href="#">{escape(words(3))}</a>' * rng.randint(0, 3)
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def sides(most: int) -> str:
        return "".join(side() for _ in range(rng.randint(0, most)))

    tag, name = rng.choice([("article", ""), ("main", ""), ("div", "n"), ("div", "n"), ("div", "n"), ("section", "n"), ("td", "n"), ("div", "")])
    name = rng.choice(_MAIN_NAMES) if name else ""
    attributes = f' {rng.choice(("class", "id"))}="{name}"' if name else ""
    body, lines = [], []
    heading = f"<h1>{escape(title)}</h1>" if title else ""
    if title:
        lines.append(title)
    for k, text in enumerate(paragraphs):
        kind = rng.random()
        if kind < 0.8:
            body.append(f"<p>{escape(text)}</p>" if rng.random() < 0.8 else f"<p>{escape(text)}")
        elif kind < 0.86:
            body.append(f"<ul><li>{escape(text)}</li></ul>")
        elif kind < 0.92:
            body.append(f"<blockquote>{escape(text)}</blockquote>")
        else:
            body.append(f"<div>{escape(text)}</div>")
        lines.append(text)
        if rng.random() < 0.06:
            body.append(side())
    if rng.random() < 0.15:
        body.append(side())
    inner = heading + "".join(body)
    content = f"<{tag}{attributes}>{inner}</{tag}>"
    if tag == "td":
        content = f"<table><tr>{content}</tr></table>"
    for _ in range(rng.randint(0, 3)):
        content = sides(1) + content + sides(1)
        content = f'<div class="{rng.choice(_WRAP_NAMES)}">{content}</div>'
    return f"<html><head><title>{escape(title)}</title></head><body>{sides(4)}{content}{sides(4)}</body></html>", lines


# --- the model --------------------------------------------------------------------


@dataclass
class Extractor:
    """Scores of attribute words and the trees over the node features."""

    tokens: dict[str, float]
    trees: Trees


def _parts(page: Page) -> tuple[str, list[str], list[str]]:
    """(title, paragraphs, other lines) of a page by its markup, or by line length where it says nothing."""
    labels = marked_labels(page)
    if all(x < 0 for x in labels):
        longest = [t for _, t in page.lines if len(t) > 80]
        return "", longest, [t for _, t in page.lines if len(t) <= 80]
    inside = [(page.nodes[k].tag, t) for k, t in page.lines if labels[k] == 1]
    title = next((t for tag, t in inside if tag in HEADS), "")
    return title, [t for tag, t in inside if tag not in HEADS], [t for k, t in page.lines if labels[k] != 1]


def fit(htmls: list[str], forms: int = FORMS, seed: int = 7) -> Extractor:
    """A model of sample pages and their rebuilt forms."""
    rng = random.Random(seed)
    pages = [parse(h) for h in htmls]
    parts = [_parts(p) for p in pages]
    strange = [t for _, paragraphs, other in parts for t in (*other, *paragraphs[:3])] or ["menu", "search"]
    found: list[tuple[Page, list[int]]] = [(p, marked_labels(p)) for p in pages]
    for title, paragraphs, _ in parts:
        for _ in range(forms if paragraphs else 0):
            take = paragraphs[: rng.randint(1, 12)]
            html, lines = rebuild(title if rng.random() < 0.8 else "", take, strange, rng)
            page = parse(html)
            found.append((page, built_labels(page, lines)))
    weight: dict[str, list[int]] = {}
    for page, labels in found:
        for x, y in zip(page.nodes, labels):
            if y >= 0:
                for t in set(x.tokens):
                    weight.setdefault(t, [0, 0])[y] += 1
    tokens = {t: math.log((b + 1) / (a + 1)) for t, (a, b) in weight.items() if a + b >= 3}
    xs, ys = [], []
    for page, labels in found:
        y = np.array(labels)
        use = y >= 0
        xs.append(features(page, tokens)[use])
        ys.append(y[use])
    x = np.concatenate(xs) if xs else np.zeros((0, WIDTH))
    y = np.concatenate(ys).astype(float) if ys else np.zeros(0)
    return Extractor(tokens, fit_trees(x, y))


def built_labels(page: Page, lines: list[str]) -> list[int]:
    """Labels of a rebuilt page: nodes of main lines alone are 1, of other lines alone 0, others -1."""
    left = Counter(" ".join(x.split()) for x in lines)
    inside, outside = [0] * len(page.nodes), [0] * len(page.nodes)
    # Main lines come in order; an equal line elsewhere on the page is rare and counts as main.
    for k, text in page.lines:
        good = left[text] > 0
        left[text] -= good
        while k >= 0:
            inside[k] += good
            outside[k] += not good
            k = page.nodes[k].parent
    return [1 if a and not b else 0 if b and not a else -1 for a, b in zip(inside, outside)]


def decode(page: Page, probability: np.ndarray) -> list[bool]:
    """Whether each node's own lines are main text, by the best consistent choice over the tree.

    A node is main, other or mixed. Below a main node there are main and other nodes, below an other
    node only other ones, below a mixed node any; a mixed node's own lines are other. A choice
    costs the log-loss of its nodes; mixed nodes cost a constant.
    """
    nodes = page.nodes
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    mixed_cost = math.log(0.5)
    n = len(nodes)
    main, other, mixed = list(yes), list(no), [mixed_cost + (no[k] if nodes[k].own else 0.0) for k in range(n)]
    for k in range(n - 1, 0, -1):
        q = nodes[k].parent
        main[q] += max(main[k], other[k])
        other[q] += other[k]
        mixed[q] += max(main[k], other[k], mixed[k])
    out, state = [False] * n, [""] * n
    for k in range(n):
        above = state[nodes[k].parent] if k else "mixed"
        options = {"mixed": (("main", main[k]), ("mixed", mixed[k]), ("other", other[k])), "main": (("main", main[k]), ("other", other[k])), "other": (("other", 0.0),)}[above]
        state[k] = max(options, key=lambda o: o[1])[0]
        out[k] = state[k] == "main"
    return out


def extract_pages(htmls: list[str], model: Extractor) -> list[str]:
    """Main text of each page: its main lines, joined by line breaks."""
    pages = [parse(h) for h in htmls]
    rows = [features(p, model.tokens) for p in pages]
    probability = model.trees.probability(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, x in zip(pages, rows):
        keep = decode(page, probability[at : at + len(x)])
        at += len(x)
        out.append("\n".join(t for k, t in page.lines if keep[k]))
    return out


def train(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", max_pages: int = TRAIN_PAGES) -> bytes:
    """A pickled model of a sample of ``max_pages`` pages, chosen by a hash of id and html."""
    html = F.coalesce(F.col(html_column), F.lit("")).alias("html")
    sample = bounded_sample(pages.select(F.col(id_column).alias("id"), html), ["id", "html"], max_pages).select("html")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        htmls = [t.decode("utf-8", "replace") for batch in batches for t in texts_of(batch, "html")]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(htmls))], pa.binary())], names=["model"])

    found = sample.coalesce(1).mapInArrow(learn, "model binary").collect()
    return found[0]["model"] if found else pickle.dumps(fit([]))


@lru_cache(maxsize=2)
def _model(data: bytes) -> Extractor:
    return pickle.loads(data)


def extract(pages: DataFrame, model: bytes, html_column: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` but the html, with ``out``: the main text, empty if there is none.

    Null and empty pages give the empty text. Repeated rows give a row each; a column named ``out`` is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c not in (html_column, out)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        htmls = [t.decode("utf-8", "replace") for t in texts_of(batch, html_column)]
        columns = [batch.column(i) for i in range(len(kept))]
        texts = []
        for a in range(0, len(htmls), 256):
            texts += extract_pages(htmls[a : a + 256], _model(shared.value))
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*kept, out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*kept).schema.fields)
    return arrow_map(pages.select(*kept, html_column), run, f"{schema}`{out}` string")


@query("op9_extract")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a model of a sample of the same table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
