"""Main text of web pages: the best contiguous region of a page, with weights from labelled pages.

A page is a sequence of tags and runs of words. Words score by the elements around them, tags score
negative, and one linear scan finds the maximum-scoring contiguous subsequence. The text is what the region
holds in blocks whose words score positive. Weights come from pages that label themselves: what stands in
<article> or <main>, outside elements that never hold text of their own, is content there. Names that hold the whole
page or all of its main text tell nothing apart and are ignored: those on html and body, those on the elements around every
<article> and <main> and on these themselves, and in pages without either those around all words.

Defined results: null or empty html, and pages without any positive word, give the text ''; a null url
stays null; repeated rows give repeated rows; an empty table gives no rows and is learnt from as such.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
NEVER = frozenset(
    "head nav aside footer form button select option label input menu dialog svg math canvas object audio video "
    "map datalist search".split()
) | RAW
MAIN = frozenset(["article", "main"])
#: Elements for something else than the page's text; a form may hold the page.
APART = (NEVER | {"header"}) - {"form"}
#: Words of class, id and role that name boilerplate.
JUNK = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social "
    "comment comments discussion disqus reply replies cookie cookies consent notice notification alert gdpr privacy "
    "newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager search skip "
    "contentinfo complementary".split()
)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"<]*"|'[^'<]*'|[^'"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z0-9]+")
#: Words that a known junk label counts as seen outside before any page is read.
PRIOR = 50


def labels_of(name: str, attributes: str) -> frozenset[str]:
    """What an element says about the words in it: its name, unless it is a mere container, and its classes."""
    out = {name} if name in NEVER or name in MAIN or name == "header" else set()
    for found in NAMES.finditer(attributes) if name not in ("html", "body") else ():
        out.update("." + part for part in PART.findall((found[1] or found[2] or found[3] or "").lower()))
    return frozenset(out)


def tokens(page: str) -> list[tuple[str, str, frozenset[str]]]:
    """(kind, value, labels around): kind is 'tag' with the tag's name, or 'text' with a raw run of text.

    Labels that tell nothing apart are left out.
    """
    parts = list(_tokens(page))
    sets = {labels for _, _, labels in parts}
    # The outermost main elements' surroundings, and else those of all words that stand in no element for something else.
    held = [x for x in sets if x & MAIN and not x & APART]
    if not held:
        held = {labels for kind, value, labels in parts if kind == "text" and value.strip() and not labels & APART}
    around = [frozenset(x.lstrip("^") for x in labels if x[0] == "^" or not labels & MAIN) for labels in held]
    idle = frozenset.intersection(*around) if around else frozenset()

    def told(labels: frozenset[str]) -> frozenset[str]:
        if labels & MAIN:
            return frozenset(x.lstrip("^") for x in labels if x[0] != "^" or x[1:] not in idle)
        return labels - idle

    kept = {labels: told(labels) for labels in sets}
    return [(kind, value, kept[labels]) for kind, value, labels in parts]


def _tokens(page: str) -> Iterator[tuple[str, str, frozenset[str]]]:
    """As they stand; in main text, ^ marks names (and forms) that are on the outermost main element or around it."""
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = []
    around: frozenset[str] = frozenset()
    at, end = 0, len(page)
    no_end: set[str] = set()
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], around
            return
        if start > at:
            yield "text", page[at:start], around
        if found := OTHER.match(page, start):
            at = found.end()
            continue
        found = TAG.match(page, start)
        if not found:
            yield "text", "<", around
            at = start + 1
            continue
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        name = name.lower()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    around = stack[k][2]
                    del stack[k:]
                    break
            yield "tag", "/" + name, around
            continue
        if name in BLOCKS:
            # An open paragraph ends where a block starts, an open item where the next one starts.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    around = stack[k][2]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        yield "tag", name, around
        if name in RAW:
            if name not in no_end:
                stop = re.compile(f"</{name}[^<>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name == "title":
                    no_end.add(name)
                else:
                    return
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, labels_of(name, attributes), around))
        inner = stack[-1][1]
        if around & MAIN:
            inner = inner - {"header", ".header"}
        around = around | inner if inner else around
        if inner & MAIN and not stack[-1][2] & MAIN:
            around = frozenset("^" + x if x[0] == "." or x == "form" else x for x in around)


def junk(labels: frozenset[str]) -> bool:
    return any(x in NEVER or x == "header" or x[1:] in JUNK and x[0] == "." for x in labels)


class Weights:
    """Scores of a word inside an element with a label, and of a tag."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        words = {k[1:]: v for k, v in counts.items() if k[0] == "w"}
        for label in {*NEVER, "header", *("." + x for x in JUNK)}:
            inside, outside = words.get(label, (0, 0))
            words[label] = (inside, outside + PRIOR)
        for label in MAIN:
            inside, outside = words.get(label, (0, 0))
            words[label] = (inside + PRIOR, outside)
        self.words = {k: math.log((a + 1) / (b + 1)) for k, (a, b) in words.items()}
        self.tags = {
            k[1:]: -min(5.0, max(0.1, math.log((b + 1) / (a + 1)))) for k, (a, b) in counts.items() if k[0] == "t"
        }
        self.seen: dict[frozenset[str], float] = {}

    def word(self, labels: frozenset[str]) -> float:
        """1 where nothing speaks against the word. Others are left out anyway, and cost little, or nothing in the main text."""
        score = self.seen.get(labels)
        if score is None:
            content = min((self.words.get(x, 0.0) for x in labels), default=0.0) >= 0
            score = self.seen[labels] = 1.0 if content else 0.0 if labels & MAIN else -0.05
        return score

    def tag(self, name: str, labels: frozenset[str]) -> float:
        """Inside an element for the main text any tag costs little: lists and links may be part of it."""
        return -0.1 if labels & MAIN else self.tags.get(name, -0.5)


def region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the maximum-scoring contiguous subsequence, the first of equals; (0, 0) if none is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += score
        if run > best:
            best, span = run, (start, k + 1)
    return span


def extract(page: str, weights: Weights) -> str:
    parts = list(tokens(page))
    scores = [
        weights.tag(value, labels) if kind == "tag" else len(value.split()) * weights.word(labels) for kind, value, labels in parts
    ]
    start, stop = region(scores)
    blocks: list[str] = []
    current: list[str] = []

    def close():
        text = " ".join(entities.unescape("".join(current)).split())
        if text:
            blocks.append(text)
        current.clear()

    for kind, value, labels in parts[start:stop]:
        if kind == "tag":
            if value.lstrip("/") in BLOCKS:
                close()
            elif value == "br":
                current.append(" ")
        elif weights.word(labels) > 0:
            current.append(value)
    close()
    return "\n\n".join(blocks)


def page_counts(page: str) -> Counter:
    """(feature, is content) -> number: words by the labels around them and tags, in a page that labels itself."""
    out: Counter = Counter()
    for kind, value, labels in tokens(page):
        content = bool(labels & MAIN) and not junk(labels)
        if kind == "tag":
            out["t" + value, content] += 1
        elif n := len(value.split()):
            for label in labels:
                out["w" + label, content] += n
    return out


def learn(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = 2000) -> Weights:
    """Weights from the pages of at most ``sample`` keys that hold <article> or <main>, chosen by the key's hash."""
    labelled = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).where(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]")
    )
    # The hashes alone meet in one task; the pages below their cut stay where they are.
    hashed = labelled.withColumn("hash", F.xxhash64("key"))
    cut = hashed.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    chosen = hashed.where(F.col("hash") <= F.lit(cut))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: Counter = Counter()
            for page in frame["html"]:
                found.update(page_counts(page))
            yield pd.DataFrame([(f, c, n) for (f, c), n in found.items()], columns=["feature", "content", "n"])

    rows = (
        chosen.select("html")
        .mapInPandas(count, "feature string, content boolean, n long")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))))
        .collect()
    )
    return Weights({f: (a, b) for f, a, b in rows})


def extract_pages(pages: DataFrame, weights: Weights | None = None, html: str = "html", **learning) -> DataFrame:
    """The input's page_id and url with text and n_chars, the text's code points."""
    weights = weights or learn(pages, html=html, **learning)
    chosen = pages.select("page_id", "url", F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [extract(page, weights) for page in frame.pop("html")]
            frame["n_chars"] = frame["text"].str.len().astype("int64")
            yield frame

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return chosen.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
