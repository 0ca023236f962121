"""HTML extraction with a linear-chain conditional random field.

A page is a sequence of leaf blocks of its DOM. Each block has features from
its ancestors (tags, words of class and id) and from its text. The field gives
every sequence of labels (main text or not) a score from the features of each
block and from each pair of labels side by side; it is trained on labelled
pages by gradient steps on their likelihood, and the best sequence is found by
Viterbi's algorithm.

Labelled pages are a few by hand and a bounded sample of the crawl, whose own
markup says what the article is. Of each of these a copy is used that has lost
this markup, so that other features are learned too.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoless.llm.labelled_pages import LABELLED_PAGES
from echoless.llm.sampling import at_most

#: Elements that begin and end a block, those whose content is no text (and of these those that end at "/>"), and those
#: that have no end. Fixed values. Text in math, svg and object is inline content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = ("script", "style", "noscript", "template", "textarea", "select", "iframe", "title", "desc", "metadata")
SELF_CLOSED = ("title", "desc", "metadata")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind ends where one of the right kinds begins. Fixed values.
IMPLIED_END = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "head": {"body"},
}
#: In an article's own markup, parts that are not its text. Fixed values.
ASIDE_TAGS = {"nav", "aside", "footer", "form", "button"}
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "cookie", "cookies", "menu", "nav", "newsletter", "notice", "promo", "related", "share", "sidebar", "social", "sponsored", "tags", "widget"}
#: Words that boilerplate has often. Fixed values.
CUES = re.compile(r"\b(?:cookies?|subscribe|newsletter|sign up|log ?in|register|advertisement|sponsored|copyright|all rights reserved|privacy|terms|imprint|impressum|reply|share|follow us)\b|©", re.I)

#: Ancestors that the way to a block shows from each end.
SHOWN = 32
#: Blocks of fewer characters, or with more of them in links than this share, may be boilerplate by their words.
SHORT, LINKED = 80, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?:" + "|".join(SELF_CLOSED) + r")(?=[\s/])[^>]*+(?<=/)>"
    r"|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=silent)(?=[\s/>])[^>]*+>|$)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^>]*+)(?:>|$)|<[!?/][^>]*+(?:>|$)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text of a leaf block, the way to it (tag and words of class, id and role for each ancestor), and what it is made of.

    Of more than 2 * SHOWN ancestors the way has the outermost and the innermost.
    """

    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    link_chars: int
    keep: bool


@dataclass
class _Reader:
    """Open elements (tag, words of its names, whether kept, place of the innermost block) and the blocks so far.

    Where the open elements of each tag are is kept too, so that a tag costs the
    same however many elements are open.
    """

    stack: list = field(default_factory=list)
    places: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)
    links: int = 0
    blocks: list = field(default_factory=list)

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                shown = self.stack if len(self.stack) <= 2 * SHOWN else self.stack[:SHOWN] + self.stack[-SHOWN:]
                path = tuple((tag, names) for tag, names, _, _ in shown)
                self.blocks.append(Block(path, text, self.links, self.stack[-1][2] if self.stack else False))
        self.parts, self.links = [], 0

    def close_from(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def innermost_block(self) -> int:
        return self.stack[-1][3] if self.stack else -1

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "text":  # labels of a drawing stand apart
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            while self.stack and tag in IMPLIED_END.get(self.stack[-1][0], ()):
                self.close_from(len(self.stack) - 1)
            # A paragraph ends also if inline elements are still open in it.
            inner = self.innermost_block()
            if inner >= 0 and self.stack[inner][0] == "p":
                self.close_from(inner)
        if tag not in VOID and not rest.endswith("/"):
            names = tuple(w for m in _NAMES.finditer(rest) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())) if "=" in rest else ()
            kept, inner, at = bool(self.stack and self.stack[-1][2]), self.innermost_block(), len(self.stack)
            self.places.setdefault(tag, []).append(at)
            self.stack.append((tag, names, kept or " keep" in rest, at if tag in BLOCKS else inner))

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        at = self.places.get(tag)
        if at and (tag in BLOCKS or at[-1] >= self.innermost_block()):
            self.close_from(at[-1])

    def text(self, text: str) -> None:
        if any(element[0] == "a" for element in self.stack[-3:]):
            self.links += len(text.strip())
        self.parts.append(text)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in its order. Markup that is cut off or not closed is read as far as it goes."""
    reader, at = _Reader(), 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if tag := m["tag"] or m["tag2"]:
            tag = tag.lower()
            if m["end"] or m["end2"]:
                reader.end(tag)
            else:
                reader.start(tag, m["rest"] or m["rest2"] or "")
        elif m["silent"] and m["silent"].lower() in BLOCKS:
            reader.flush()
    if at < len(page):
        reader.text(page[at:])
    reader.flush()
    return reader.blocks


def path_features(path: tuple) -> list[str]:
    found = [f"in:{tag}" for tag, _ in path[:-1]] + [f"name:{w}" for _, names in path for w in names]
    found += [f"own:{path[-1][0]}"] if path else []
    return sorted(set(found))


def text_features(block: Block) -> list[str]:
    text = block.text
    n = len(text)
    found = [f"chars:{min(n.bit_length(), 10)}", f"links:{min(4 * block.link_chars // n, 4)}"]
    if text[-1] in ".!?:\"'”»":
        found.append("sentence")
    # Articles use these words too: they tell something only of short blocks or links, and other things within an article.
    if (n < SHORT or block.link_chars > LINKED * n) and CUES.search(text):
        found.append("cue in article" if any(tag in ("article", "main") for tag, _ in block.path) else "cue")
    return found


def article_labels(blocks: list[Block]) -> list[bool] | None:
    """What the page's own markup says is the article; None if it says nothing."""
    labels = []
    for b in blocks:
        tags = [tag for tag, _ in b.path]
        inner = b.path[min((i for i, t in enumerate(tags) if t in ("article", "main")), default=len(tags)) :]
        labels.append(bool(inner) and not any(t in ASIDE_TAGS or ASIDE_WORDS & set(names) for t, names in inner[1:]))
    return labels if any(labels) else None


def _without_articles(b: Block) -> Block:
    return Block(tuple(("div" if t in ("article", "main") else t, names) for t, names in b.path), b.text, b.link_chars, b.keep)


@dataclass
class Field:
    """Weights of features for main text (against: not), of label pairs, and of the first label."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: list[float] = field(default_factory=lambda: [0.0] * 4)
    first: float = 0.0
    cache: dict = field(default_factory=dict)

    def score(self, block: Block) -> float:
        of_path = self.cache.get(block.path)
        if of_path is None:
            if len(self.cache) > 20_000:
                self.cache.clear()
            of_path = self.cache[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return of_path + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The labels with the highest score, by Viterbi."""
        if not blocks:
            return []
        p00, p01, p10, p11 = self.pairs
        off, on, back = 0.0, self.first + self.score(blocks[0]), []
        for b in blocks[1:]:
            e = self.score(b)
            from_off, from_on = off + p00 >= on + p10, off + p01 > on + p11
            back.append((from_off, from_on))
            off, on = (off + p00 if from_off else on + p10), (off + p01 if from_on else on + p11) + e
        label, labels = on > off, []
        labels.append(label)
        for off_off, on_off in reversed(back):
            label = not (on_off if label else off_off)
            labels.append(label)
        return labels[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _gradient(crf: Field, scores: list[float], labels: list[bool]) -> tuple[list[float], list[float], float]:
    """Observed minus expected: main text at each block, each pair of labels, main text at the first block."""
    p, n = crf.pairs, len(scores)
    ahead = [(0.0, crf.first + scores[0])]
    for e in scores[1:]:
        a0, a1 = ahead[-1]
        ahead.append((_log_add(a0 + p[0], a1 + p[2]), _log_add(a0 + p[1], a1 + p[3]) + e))
    behind = [(0.0, 0.0)] * n
    for i in range(n - 2, -1, -1):
        b0, b1 = behind[i + 1]
        b1 += scores[i + 1]
        behind[i] = (_log_add(p[0] + b0, p[1] + b1), _log_add(p[2] + b0, p[3] + b1))
    total = _log_add(*ahead[-1])
    at = [labels[i] - math.exp(ahead[i][1] + behind[i][1] - total) for i in range(n)]
    pairs = [0.0] * 4
    for i in range(n - 1):
        for k in range(4):
            s, t = divmod(k, 2)
            pairs[k] -= math.exp(ahead[i][s] + p[k] + (scores[i + 1] if t else 0.0) + behind[i + 1][t] - total)
        pairs[2 * labels[i] + labels[i + 1]] += 1
    return at, pairs, at[0]


def train(examples: list[tuple[list[Block], list[bool]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Field:
    """Fit a field to labelled pages, by gradient steps whose size shrinks for each weight as it moves."""
    crf, moved = Field(), {}
    ready = [([path_features(b.path) + text_features(b) for b in blocks], labels) for blocks, labels in examples if blocks]

    def step(key, value: float, by: float) -> float:
        by -= decay * value
        moved[key] = moved.get(key, 1e-3) + by * by
        return value + rate * by / math.sqrt(moved[key])

    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(ready)
        for features, labels in ready:
            scores = [sum(crf.weights.get(f, 0.0) for f in fs) for fs in features]
            at, pairs, first = _gradient(crf, scores, labels)
            sums: dict[str, float] = {}
            for g, fs in zip(at, features):
                for f in fs:
                    sums[f] = sums.get(f, 0.0) + g
            for f, g in sums.items():
                crf.weights[f] = step(f, crf.weights.get(f, 0.0), g)
            crf.pairs = [step(k, v, g) for k, (v, g) in enumerate(zip(crf.pairs, pairs))]
            crf.first = step("first", crf.first, first)
    crf.cache = {}
    return crf


def fit(pages: DataFrame, most: int = 150, most_chars: int = 100_000) -> Field:
    """Learn from the pages labelled by hand and at most `most` pages of up to most_chars, chosen by hash."""
    examples = [(blocks, [b.keep for b in blocks]) for blocks in map(leaf_blocks, LABELLED_PAGES)] * 3
    fitting = pages.select("page_id", "html").filter(F.length("html") <= most_chars)
    for row in at_most(fitting, ["page_id", "html"], most, pages.count()).collect():
        blocks = leaf_blocks(row.html)
        if labels := article_labels(blocks):
            examples += [(blocks, labels), ([_without_articles(b) for b in blocks], labels)]
    return train(examples)


def main_text(page: str, crf: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, main in zip(blocks, crf.decode(blocks)) if main)


def extract(pages: DataFrame, crf: Field | None = None) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    A page that is null, empty or without main text gives an empty text. Rows
    that repeat are read each on its own; other columns are left alone.
    """
    crf = crf or fit(pages)
    sent = pages.sparkSession.sparkContext.broadcast((crf.weights, crf.pairs, crf.first))  # plain values: executors need not have this module

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for batch in batches:
            texts = [main_text(page or "", own) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
