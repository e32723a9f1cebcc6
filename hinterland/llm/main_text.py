"""Main text of web pages: the contiguous region with the largest score of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.sampling import hashed_sample

#: Elements whose whole content is never main text.
SKIPPED = frozenset("""script style noscript template svg math iframe object canvas head title nav
header footer aside form button select textarea option dialog menu audio video""".split())
#: Words in class, id or role that say the same of the element that bears them, as long as
#: labelled pages don't contradict. A name says so when all its parts do or are mere filling.
_CLUTTER = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|nav|navbar|navigation|menu|"
    r"breadcrumbs?|header|footer|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|"
    r"subscription|signup|login|search|share|sharing|social|related|recommend\w*|comments?|replies|reply|"
    r"disqus|respond|contentinfo|complementary")
_FILLING = frozenset("""area article bar block box buttons col column container entry form global group inner
item items left links list main outer page post posts right row section site slot stories thread top
unit widget wrap wrapper""".split())
_OWN = frozenset("article entry post".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text where they start and where they end.
_BLOCKS = frozenset("""address article blockquote body caption center dd details div dl dt fieldset figcaption
figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr
ul""".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span "
                    "strike strong sub sup tt u var wbr br img time".split())
#: An open paragraph or list item ends where one of these starts.
_ENDS_P = _BLOCKS - {"body", "html", "li", "td", "th", "tr", "dd", "dt", "caption"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
_WORD = re.compile(r"\S+")
_SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Weights:
    """Score of a word, and by name of a tag; names inside clutter have that before them.

    ``marks`` are scores of exact class, id and role names where labelled pages tell; an element
    that bears one below ``CUT`` is clutter.
    """

    word: float
    tags: dict[str, float]
    other: float
    marks: dict[str, float] = field(default_factory=dict)


#: Words that a name starts with inside and outside articles, where it says clutter and elsewhere.
_LISTED, _UNLISTED = (1.0, 100.0), (50.0, 1.0)
#: An element goes when the log odds of its words lying in the article are below this.
CUT = -3.0


def _says_clutter(mark: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", mark.rstrip("0123456789")) if x]
    named = [x for x in parts if _CLUTTER.fullmatch(x)]
    if "header" in named and _OWN.intersection(parts):
        return False
    return bool(named) and all(x in _FILLING or x in named for x in parts)


def mark_score(mark: str, inside: float = 0.0, outside: float = 0.0) -> float:
    """Log odds of the article for words in elements of that name, after so many words seen."""
    a, b = _LISTED if _says_clutter(mark) else _UNLISTED
    return math.log((a + inside) / (b + outside))


def _element_marks(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [x for found in _NAMES.findall(attributes) for x in "".join(found).lower().split()]


def tokens(
    page: str, marks: dict[str, float] | None = None,
    observe: Callable[[list[str], int, int], None] | None = None,
) -> Iterator[tuple[str, str, bool]]:
    """``(kind, value, clutter)``: tags ``open`` / ``close`` by name, and ``text``; comments,
    declarations and the content of scripts and styles are gone.

    An element is clutter by its tag or by the score of a name it bears. The first article or main
    of a page is none for the names around it. ``observe`` is told the names of each element
    outside that article, the words it holds and those of them in the article. The work is linear
    in the page, however deep its elements lie: an end tag without a start is known by a count.
    """
    marks = marks or {}
    at, n = 0, len(page)
    stack: list[tuple] = []
    opened: Counter = Counter()
    soft = hard = False
    words = inner = 0
    article = 0  # depth of the stack at which the first article lies; -1 once it has ended

    def pop() -> str:
        nonlocal soft, hard, article
        name, soft, hard, own, had, had_inner = stack.pop()
        opened[name] -= 1
        if article > len(stack):
            article = -1
        elif observe and own and article <= 0:
            observe(own, words - had, inner - had_inner)
        return name

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m.lastindex is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                if observe:
                    count = len(_WORD.findall(text))
                    words += count
                    inner += count if article > 0 else 0
                yield "text", text, soft or hard
            continue
        name = m.group(2).lower()
        if m.group(1):
            if opened[name]:
                while pop() != name:
                    pass
            yield "close", name, soft or hard
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
            yield "open", name, True
            continue
        attributes = m.group(3)
        if stack and stack[-1][0] == "p" and name in _ENDS_P:
            pop()
        own = _element_marks(attributes) if name not in ("html", "body", "main") else []
        bad = any(marks[x] < CUT if x in marks else _says_clutter(x) for x in own)
        shut = name in SKIPPED
        first = name in ("article", "main") and article == 0 and not (bad or hard)
        if name not in _VOID and not attributes.endswith("/"):
            stack.append((name, soft, hard, own, words, inner))
            opened[name] += 1
            soft, hard = (soft or bad) and not first, hard or shut
            if first:
                article = len(stack)
            yield "open", name, soft or hard
        else:
            yield "open", name, soft or hard or bad or shut
    while observe and stack:
        pop()


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best region, joined by newlines; empty if no region scores above zero.

    Words score ``weights.word``, tags and words of clutter elements score by name, mostly below
    zero. One pass finds the contiguous run with the largest sum, the first of equal ones; a
    second one turns its tokens into text. Clutter inside the region is left out.
    """
    found = list(tokens(page, weights.marks))
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, (kind, value, clutter) in enumerate(found):
        if kind == "text":
            count = len(_WORD.findall(value))
            total += count * (weights.tags.get("clutter word", weights.other) if clutter else weights.word)
        else:
            total += weights.tags.get(f"clutter {value}" if clutter else value, weights.other)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best + 1e-9:
            best, region = total, (start, i + 1)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append(text)

    for kind, value, clutter in found[region[0]:region[1]]:
        if kind == "text":
            if not clutter:
                held.append(value)
        elif value == "br":
            held.append(" ")
        elif value not in _INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def _label(page: str) -> Counter | None:
    """Counts of words and tags inside and outside the element marked as the article, and of the
    words that named elements outside it hold; names have ``#`` before them."""
    inside: Counter = Counter()
    depth, seen = 0, False

    def observe(marks: list[str], words: int, inner: int) -> None:
        for mark in set(marks):
            inside[f"#{mark}", inner > 0] += inner or words

    for kind, value, clutter in tokens(page, observe=observe):
        if kind == "open" and value in ("article", "main"):
            depth, seen = depth + 1, True
        elif kind == "close" and value in ("article", "main"):
            depth = max(0, depth - 1)
        if kind == "text":
            name = "clutter word" if clutter else "word"
            inside[name, depth > 0] += len(_WORD.findall(value))
        else:
            inside[f"clutter {value}" if clutter else value, depth > 0] += 1
    return inside if seen else None


#: Pages that the weights are learnt from at most, taken by the order of a hash of their ids.
LABELLED_PAGES = 2000
#: Weights lie between these; the score of a word is fixed and sets the scale.
_WORD_SCORE, _LOWEST, _HIGHEST, _UNSEEN = 1.0, -6.0, -0.1, -0.5


def fit_weights(pages: DataFrame, id_col: str, html_col: str, limit: int = LABELLED_PAGES) -> Weights:
    """Tag weights from at most ``limit`` pages that mark their article themselves.

    A tag's weight follows the log ratio of its shares outside and inside marked articles, per
    word: tags of menus and footers weigh a lot, those of paragraphs little. Names in class, id and
    role are weighed by the words of their elements: of those around articles the words in the
    article speak for the name, of those beside articles all words speak against it. Without such
    pages every tag weighs the same and names keep the scores they start with.
    """
    marked = pages.where(F.lower(html_col).rlike("<(article|main)[\\s>]")).select(
        F.xxhash64(F.col(id_col).cast("string"), F.col(html_col)).alias("h"), html_col)
    sample = hashed_sample(marked, "h", marked.count(), limit).select(html_col)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(_label(page) or {})
        keys = list(total)
        yield pa.RecordBatch.from_pydict({
            "name": pa.array([k[0] for k in keys], pa.string()),
            "inside": pa.array([k[1] for k in keys], pa.bool_()),
            "n": pa.array([total[k] for k in keys], pa.int64())})

    counted = sample.mapInArrow(count, "name string, inside boolean, n long").where(
        F.col("name").rlike("^((clutter )?[a-z0-9]{1,12}|#.{1,40})$")).groupBy("name").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")).where(
        ~F.col("name").startswith("#") | (F.col("a") + F.col("b") >= 100))
    rows = {r["name"]: (r["a"], r["b"]) for r in counted.collect()}
    words_in = 1 + rows.get("word", (0, 0))[0]
    words_out = 1 + rows.get("word", (0, 0))[1] + rows.get("clutter word", (0, 0))[1]
    tags, marks = {}, {}
    for name, (a, b) in rows.items():
        if name[0] == "#":
            marks[name[1:]] = mark_score(name[1:], a, b)
        elif name != "word":
            odds = math.log(((b + 0.5) / words_out) / ((a + 0.5) / words_in))
            tags[name] = min(_HIGHEST, max(_LOWEST, -odds))
    return Weights(_WORD_SCORE, tags, _UNSEEN, marks)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars``.

    The weights come from pages that mark their article; every page is then scored by them alone.
    NULL and empty pages have an empty text; repeated rows get a row each; ids and urls may be
    NULL; other columns are ignored. Pages are read whole.
    """
    weights = fit_weights(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"),
                        F.col(html_col).cast("string"))
    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
