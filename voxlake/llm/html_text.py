"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: the text between two borders of block elements. Each block has a vector of its tag path
(hashed names, classes and ids of the elements that are open), of its hashed words, and of its shape. A bidirectional LSTM
in numpy reads the sequence in both directions, so that a block is judged with the whole page around it, and says whether it
is main text. It is trained here: on pages of the table, labelled by what their elements say, with blocks of many kinds
added inside and outside of the article.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.batches import pieces

#: Pages that are fitted, at most; each is seen plain and in several changed forms.
SAMPLE_PAGES = 160
#: Blocks that are trained on in one go; longer pages are trained on in windows of so many.
WINDOW = 199
PATH, WORDS, SHAPE, HIDDEN = 192, 24, 6, 14
SIZE = PATH + WORDS + SHAPE
#: Only the content of raw text elements goes on to the end of the page if nothing ends it.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|textarea|iframe)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*>|<[a-zA-Z][^>]*>", re.S | re.I)
#: Elements that are skipped with all they hold, where their end is there.
_HIDDEN = frozenset("noscript template svg select".split())
_ANY_HIDDEN = re.compile(r"<(?:noscript|template|svg|select)[\s/>]", re.I)
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements inside a line of text; all others end a block. Void elements have no end.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element's name, class or id says about the text in it, for the training labels alone.
_NOT_MAIN = frozenset("nav header footer aside form head title button menu menubar navbar sidebar ad ads advert advertisement promo sponsored banner cookie cookies notice alert newsletter subscribe comment comments reply replies related share social breadcrumb pagination login search widget".split())
_MAIN = frozenset("article main content post entry story body-text articlebody".split())
#: For Spark: whether any element may be a main one. A name is ended by a blank, a mark or its quote.
_ANY_MAIN = "|".join(sorted(_MAIN))
_SAYS_MAIN = rf"""(?i)<(?:{_ANY_MAIN})[\s/>]|(?:class|id|role|itemprop)\s*=\s*(?:"(?:[^"]*[\s_-])?(?:{_ANY_MAIN})[\s_"-]|'(?:[^']*[\s_-])?(?:{_ANY_MAIN})[\s_'-]|(?:[^\s"'>]*[_-])?(?:{_ANY_MAIN})[\s_/>-])"""


def _hidden(page: str) -> dict[int, int]:
    """Where each hidden element starts and ends. An end belongs to the last start of its name; what has none isn't hidden."""
    spans: dict[int, int] = {}
    if _ANY_HIDDEN.search(page):
        opened: dict[str, list[int]] = {x: [] for x in _HIDDEN}
        for m in _TOKEN.finditer(page):
            name = m[3] and m[3].lower()
            if name in _HIDDEN:
                if not m[2]:
                    if name != "svg" or not m[4].endswith("/"):
                        opened[name].append(m.start())
                elif opened[name]:
                    spans[opened[name].pop()] = m.end()
    return spans


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """`(path, text, part of it in links)` of every leaf block with text; character references decoded, white space single."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = at = in_link = 0

    def close() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            words = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if words:
                out.append((tuple(x for _, names in stack for x in names), words, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    hidden = _hidden(page)
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] is not None:
                close()
            continue
        name = name.lower()
        if m.start() in hidden:
            at = hidden[m.start()]
            close()
            continue
        if name in _INLINE:
            if name == "br":
                text.append("\n")
            elif name == "a":
                in_link = 0 if m[2] else 1
            continue
        close()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()  # its end may be left out
            elif stack and stack[-1][0] == "p":
                stack.pop()  # a block element ends a paragraph
            if name not in _VOID and name not in _HIDDEN and not m[4].endswith("/"):
                said = [x.lower() for g in _NAMES.findall(m[4]) for x in re.split(r"[\s_-]+", "".join(g))] if m[4] else []
                stack.append((name, (name, *["." + x for x in said if x])))
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def vectors(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """A row for each block of a page."""
    out = np.zeros((len(page), SIZE), dtype="float32")
    n = len(page)
    for i, (path, text, links) in enumerate(page):
        for x in path:
            out[i, zlib.crc32(x.encode()) % PATH] = 1
        words = text.lower().split(" ")
        hashed = np.array([zlib.crc32(w.encode()) for w in words]) % WORDS
        out[i, PATH : PATH + WORDS] = np.bincount(hashed, minlength=WORDS) / len(words)
        out[i, PATH + WORDS :] = (np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, links, i / n, 1 / (n - i), text[-1] in ".!?")
    return out


class Windows(Sequence):
    """The vectors of many pages and windows, with a bit for each path feature."""

    def __init__(self):
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, v: np.ndarray) -> None:
        self.kept.append((np.packbits(v[:, :PATH] > 0, axis=1), v[:, PATH:].copy()))

    def __len__(self) -> int:
        return len(self.kept)

    def __getitem__(self, i: int) -> np.ndarray:
        bits, rest = self.kept[i]
        return np.concatenate([np.unpackbits(bits, axis=1, count=PATH), rest], axis=1, dtype="float32")


class Labeller:
    """A bidirectional LSTM with one output a block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.15, (SIZE, 4 * HIDDEN))
            self.w["h" + d] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.w["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: in, forget, out, cell
        self.w = {k: v.astype("float32") for k, v in self.w.items()}

    @classmethod
    def keeping_all(cls) -> Labeller:
        """Takes every block for main text."""
        model = cls()
        model.w = {k: np.zeros_like(v) for k, v in model.w.items()} | {"bias": np.ones(1, "float32")}
        return model

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Time first; the mask says where there is a block."""
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), SIZE), "float32"), np.zeros((steps, len(pages), 1), "float32")
        for i, p in enumerate(pages):
            x[: len(p), i], mask[: len(p), i] = p, 1
        return x, mask

    def _one_way(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        into = x.reshape(-1, SIZE) @ self.w["x" + d] + self.w["c" + d]
        into = into.reshape(steps, n, -1)
        h = c = np.zeros((n, HIDDEN), "float32")
        hs, past = np.zeros((steps, n, HIDDEN), "float32"), []
        for t in order:
            z = into[t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            u = np.tanh(new)
            m = mask[t]
            if keep:
                past.append((t, i, f, o, g, c, u, h))
            c, h = m * new + (1 - m) * c, m * (o * u) + (1 - m) * h
            hs[t] = h
        return hs, past

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._one_way(d, x, mask, False)[0] for d in "fb"], axis=2)
        return both @ self.w["out"] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks and its gradients, by backpropagation through time."""
        ways = {d: self._one_way(d, x, mask, True) for d in "fb"}
        both = np.concatenate([ways[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"])))
        m = mask[:, :, 0]
        total = m.sum()
        loss = float(-(m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        dz = m * (p - y) / total
        grads = {"out": np.einsum("tn,tnh->h", dz, both), "bias": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.w["out"]
        for k, d in enumerate("fb"):
            dh_all = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dpre, before = np.zeros((*mask.shape[:2], 4 * HIDDEN), "float32"), np.zeros_like(dh_all)
            dh = dc = np.zeros(dh_all.shape[1:], "float32")
            back = self.w["h" + d].T.copy()
            for t, i, f, o, g, c, u, h in reversed(ways[d][1]):
                mt = mask[t]
                dh = dh + dh_all[t]
                dnew_h = mt * dh
                dcell = mt * dc + dnew_h * o * (1 - u * u)
                dpre[t] = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dnew_h * u * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                before[t] = h
                dh = (1 - mt) * dh + dpre[t] @ back
                dc = (1 - mt) * dc + dcell * f
            flat = dpre.reshape(-1, 4 * HIDDEN)
            grads |= {"x" + d: x.reshape(-1, SIZE).T @ flat, "h" + d: before.reshape(-1, HIDDEN).T @ flat, "c" + d: flat.sum(axis=0)}
        return loss, grads

    def fit(self, pages: Sequence[np.ndarray], labels: list[np.ndarray], epochs: int = 30, batch: int = 16, rate: float = 0.02, seed: int = 1) -> None:
        """Adam, until an epoch's loss is small."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        by_length = np.argsort([len(y) for y in labels], kind="stable")
        groups = [by_length[i : i + batch] for i in range(0, len(pages), batch)]
        for _ in range(epochs):
            losses = []
            for g in rng.permutation(len(groups)):
                some = groups[g]
                x, mask = self.padded([pages[i] for i in some])
                y = np.zeros(mask.shape[:2], "float32")
                for k, i in enumerate(some):
                    y[: len(labels[i]), k] = labels[i]
                loss, grads = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype("float32")
            if np.mean(losses) < 2e-4:
                break


def weak_labels(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """What the elements around each block say: inside a main element, and since then in none of another kind."""
    out = np.zeros(len(page), "float32")
    for i, (path, _, _) in enumerate(page):
        main, before = False, ""
        for said in path:
            x = said.removeprefix(".")
            both = (before + said).replace(".", "-")[1:]  # `body-text` is two names
            main = False if x in _NOT_MAIN else True if x in _MAIN or both in _MAIN else main
            before = said
            if x in _NOT_MAIN:
                break
        out[i] = main
    return out


def varied(page: str, rng: np.random.Generator) -> str:
    """The page with blocks of other kinds put in, inside and outside of its article, and other elements for the article."""
    words = re.sub(r"<[^>]*>", " ", page).split() or ["text"]

    def some(n: int) -> str:
        at = int(rng.integers(0, len(words)))
        return html.escape(" ".join((words * 2)[at : at + n]))

    kinds = sorted(_NOT_MAIN - {"head", "title", "nav", "header", "footer", "aside", "form", "button", "menu"})
    def other() -> str:
        kind = str(rng.choice(kinds))
        inner = "".join(f"<p>{some(int(rng.integers(1, 60)))}</p>" for _ in range(int(rng.integers(1, 4))))
        return [
            f'<div class="{kind}">{inner}</div>', f'<section id="{kind}">{inner}</section>', f'<div class="box {kind}">{some(8)}</div>', f"<aside>{inner}</aside>",
            f'<form action="/x"><label>{some(2)}</label><input type="text"><button>{some(1)}</button></form>', f"<header><h2>{some(5)}</h2></header>", f"<nav><a href='/'>{some(1)}</a> <a href='/y'>{some(2)}</a></nav>",
            f'<div class="{kind}-list"><ul><li>{some(9)}</li><li>{some(3)}</li></ul></div>', f"<footer>{some(6)}</footer>",
        ][int(rng.integers(0, 9))]

    def own() -> str:
        return [f"<h2>{some(4)}</h2>", f"<ul><li>{some(12)}</li><li>{some(2)}</li></ul>", f"<blockquote>{some(20)}</blockquote>", f"<p>{some(2)} <a href='/z'>{some(3)}</a></p>", f"<pre>{some(9)}</pre>", f"<table><tr><td>{some(2)}</td><td>{some(1)}</td></tr></table>", f"<p>{some(1)}</p>"][int(rng.integers(0, 7))]

    parts = re.split(r"(</p>|</nav>|</article>|<article>)", page)
    out, inside = [], False
    for x in parts:
        out.append(x)
        inside = x == "<article>" or inside and x != "</article>"
        if x.startswith("<") and rng.random() < 0.25:
            out.append(other())
        if inside and x == "</p>" and rng.random() < 0.2:
            out.append(own())
    changed = "".join(out)
    name = str(rng.choice(["article", "article", "main", *sorted(_MAIN - {"article", "main"})]))
    if name == "main":
        changed = changed.replace("<article>", "<main>").replace("</article>", "</main>")
    elif name != "article":
        changed = changed.replace("<article>", f'<div class="{name}">').replace("</article>", "</div>")
    return changed


def fit(pages: DataFrame, *, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, seed: int = 11) -> Labeller | None:
    """Train on at most `sample_pages` different pages with a main element, the first by a seeded hash, plain and varied.

    Long pages are trained on whole, in windows. None without pages; if no page has a main element there is nothing to
    learn from, and the labeller keeps every block.
    """
    hashed = pages.select(F.xxhash64(F.col(html_col).cast("string"), F.lit(seed)).alias("h"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    first = [r["h"] for r in hashed.where(F.col("html").rlike(_SAYS_MAIN)).select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    # Copies are folded before anything is sent, so that as many rows as there are hashes reach the driver.
    rows = sorted(hashed.where(F.col("h").isin(first)).dropDuplicates(["h"]).collect()) if first else []
    rng = np.random.default_rng(seed)
    seen, labels = Windows(), []
    for r in rows:
        for form in range(4):
            read = blocks(varied(r["html"], rng) if form else r["html"])
            main = weak_labels(read)
            if not main.any():
                continue
            v = vectors(read)
            for start in range(0, len(read), WINDOW):
                seen.append(v[start : start + WINDOW])
                labels.append(main[start : start + WINDOW])
    if not labels:
        return None if hashed.isEmpty() else Labeller.keeping_all()
    model = Labeller()
    model.fit(seen, labels)
    return model


def main_text(pages: DataFrame, model: Labeller | None, *, page_id: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """`(page_id, url, text)` of every row: the blocks that the model takes for main text, in page order, one a line.

    The whole page is read, whatever its length. A null or empty page, one without text, and any page without a model have
    an empty text. Repeated rows are read alike; an empty table gives an empty one; only the columns named are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, raw in pieces(batches, "html"):
            read = [blocks(x.decode("utf-8", "replace")) if model else [] for x in raw]
            texts = [""] * len(read)
            order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
            start = 0
            while start < len(order):  # pages of similar length together, about 20,000 steps at once
                end = start + 1
                while end < len(order) and len(read[order[end]]) * (end + 1 - start) <= 20_000:
                    end += 1
                some = order[start:end]
                values = model.score(*model.padded([vectors(read[i]) for i in some]))
                for k, i in enumerate(some):
                    texts[i] = "\n".join(b[1] for b, v in zip(read[i], values[:, k]) if v > 0)
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string")
