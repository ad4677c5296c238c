"""Main text of web pages by nearest-URL page differencing.

Pages are put in one order (host, path, page_id) across the cluster and numbered. Each page is compared
with the nearest page before and the nearest page after it on its host that is no mirror of it, among
REACH on either side. Pages become lines (one for each block of visible text, menus, footers and all), the
lines of a pair are aligned by longest common subsequence, and lines that are shared are template. They are
deleted first: all that either neighbour shares, but in what markup tells to be the article (the article
elements, or the main part of a page without any) only what both share in place and all pages within REACH
have, so a sentence that an article happens to repeat from other pages stays. A neighbour that shares a MIRROR part of the page's text
is a mirror: its lines are no template, and mirrored pages keep their text.

Of the lines that are left those go that pages do not share but markup tells to be no article: in elements
to which HTML itself gives another role (menus, footers, forms, asides, ...), or that one of their class
names or their id names in full as an advert, comment list, notice, ... Where a page has a main part or
articles, all of these are its text, whatever is nested in what, and nothing else.

Groups of GROUP neighbours are worked on together, with REACH pages on the borders given to both
sides, so a host of any size is spread evenly and every page meets its neighbours.

Defined cases: null html gives the empty text; a null url is host "" and path ""; repeated page ids
are rows of their own; unclosed, broken or truncated markup is read as far as it goes; pages of any
length count whole; pages with no neighbour lose no lines to differencing; an empty table gives no
rows; other columns ride along, whatever their names, but for html and text, which the text replaces.
"""

from __future__ import annotations

import json
import re
import zlib
from base64 import b64encode
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, table

GROUP = 128
REACH = 8  # pages to either side among which a page's neighbour is looked for
MIRROR = (0.9, 0.5)  # shares of its text from which on another page is a mirror: of a page with all its template, of what is told to be the article
CELLS = 1 << 28  # alignment cells (bits) kept at once; larger pairs are halved

# Element names by role in a page.
CHROME = frozenset("nav footer aside form dialog menu".split())
UNSEEN = frozenset("script style noscript template button select iframe svg head title textarea object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Of an element that begins, which open elements it ends whose end tag may be left out, and beyond which ones it does not look.
_PARAGRAPH = (frozenset({"p"}), frozenset("td th table caption button object".split()))
ENDS = dict.fromkeys(BLOCK - frozenset("body dd dt figcaption head html li option summary tbody td tfoot th thead title tr".split()), _PARAGRAPH)
ENDS |= {tag: (frozenset(ended.split()), frozenset(beyond.split())) for tags, ended, beyond in (
    ("li", "li", "ul ol menu"), ("dd dt", "dd dt", "dl"), ("td th", "td th", "tr table"), ("tr", "tr", "table"), ("tbody tfoot thead", "tbody tfoot thead", "table"),
) for tag in tags.split()}
ROLES = CHROME | UNSEEN | {"main", "article", "header"}
#: Class names and ids, in full, of what is no text of the page.
CHROME_NAMES = frozenset(
    """ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies cookie-notice cookie-banner cookie-consent consent notice notices
    alert sidebar side-bar comments comment comment-list comment-form disqus disqus_thread respond reply menu main-menu nav navbar navigation breadcrumb breadcrumbs newsletter
    subscribe signup share share-buttons sharing social social-share related related-posts footer site-footer site-header popup modal pagination skip-link""".split()
)
#: Of these, what an article element itself can be and still not be the page's article.
OTHER_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments reply respond related related-posts".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects (text, level) for each block of visible text; level 2: in an article, 1: in the main part, -1: in the page's chrome (a digest, if it is long)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # element, it is unseen, chrome, the main part, an article
        self.unseen = self.chrome = self.main = self.article = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text and self.chrome and len(text) > 5:  # chrome is aligned with chrome and never given out
            text = "\0" + b64encode(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=3).digest()).decode()
        if text:
            self.lines.append((text, -1 if self.chrome else 2 if self.article else 1 if self.main else 0))

    def close_from(self, at: int) -> None:
        for _, unseen, chrome, main, article in self.open[at:]:
            self.unseen -= unseen
            self.chrome -= chrome
            self.main -= main
            self.article -= article
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if (name := self.open[i][0]) in ended:
                    self.close_from(i)
                    break
                if name in beyond:
                    break
        if not attrs and tag not in ROLES:
            self.open.append((tag, False, False, False, False))
            return
        told = dict(attrs)
        names = {*(told.get("class") or "").lower().split(), (told.get("id") or "").lower()}
        role = told.get("role") or ""
        main, article = tag == "main" or role == "main", tag == "article" or role == "article"
        chrome = tag in CHROME or role in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")
        unseen = tag in UNSEEN or "hidden" in told or bool(HIDDEN.search(told.get("style") or ""))
        chrome |= tag not in ("html", "body") and bool(names & (OTHER_NAMES if main or article else CHROME_NAMES))
        chrome |= tag == "header" and not self.main and not self.article
        self.open.append((tag, unseen, chrome, main, article))
        self.unseen += unseen
        self.chrome += chrome
        self.main += main
        self.article += article

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None or (tag not in BLOCK and any(x[0] in BLOCK for x in self.open[at + 1 :])):
            return  # closes nothing, or an inline element would close blocks
        self.close_from(at)

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def page_lines(html: str | None) -> list[tuple[str, int]]:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def shared(a: Sequence, b: Sequence) -> set[int]:
    """Positions of a in a longest common subsequence of a and b."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(lead), *range(len(a) - tail, len(a))}
    there = set(b[lead : len(b) - tail])
    at = [i for i in range(lead, len(a) - tail) if a[i] in there]
    mine = {a[i] for i in at}
    other = [x for x in b[lead : len(b) - tail] if x in mine]
    return found | {at[i] for i in _align([a[i] for i in at], other)}


def _rows(a: Sequence, b: Sequence) -> list[int]:
    """Bit-parallel LCS: in row i, the zero bits below j number the LCS of a[:i] and b[:j]."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & masks.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _counts(v: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-n // 8) or 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align(a: Sequence, b: Sequence) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        head, rest = _last_row(a[:half], b), _last_row(a[half:][::-1], b[::-1])
        cut = int(np.argmax(_counts(head, len(b)) + _counts(rest, len(b))[::-1]))
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    rows, found, j = _rows(a, b), [], len(b)
    for i in range(len(a), 0, -1):
        # the LCS grows at (i, j) by a's line i-1 exactly where row i has a zero that row i-1 has not
        while j and (rows[i] >> (j - 1)) & 1:
            j -= 1
        if not j:
            break
        if (rows[i - 1] >> (j - 1)) & 1 and b[j - 1] == a[i - 1]:
            found.append(i - 1)
            j -= 1
    return found[::-1]


def _last_row(a: Sequence, b: Sequence) -> int:
    v, masks, full = (1 << len(b)) - 1, {}, (1 << len(b)) - 1
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def levels(lines: list[tuple[str, int]]) -> tuple[int, int]:
    """The least level of lines that are the page's text, and the level of its article."""
    top = max((x for _, x in lines), default=0)
    return min(1, max(0, top)), max(0, top)


def template(lines: list[tuple[str, int]], other: list[tuple[str, int]]) -> set[int] | None:
    """Positions of the lines that another page shares; None if it is a mirror."""
    if lines == other:
        return None
    least, _ = levels(lines)
    common = shared([x for x, _ in lines], [x for x, _ in other])
    size = sum(len(x) for x, own in lines if own >= least)
    return None if sum(len(lines[i][0]) for i in common if lines[i][1] >= least) >= MIRROR[least] * size else common


def main_text(lines: list[tuple[str, int]], before: Iterable[list[tuple[str, int]]], after: Iterable[list[tuple[str, int]]]) -> str:
    """The page's text; before and after are the pages to either side, the nearest first."""
    least, top = levels(lines)
    before, after = list(before), list(after)
    found = [t for side in (before, after) if (t := next((t for other in side if (t := template(lines, other)) is not None), None)) is not None]
    either, both = set().union(*found), found[0] & found[1] if len(found) == 2 else set()
    if top and both:
        told = {lines[i][0] for i in both if lines[i][1] == top}
        for other in (*before, *after):
            told &= {x for x, _ in other} if told else set()
        both = {i for i in both if lines[i][0] in told}
    left = [(text, own) for i, (text, own) in enumerate(lines) if i not in (both if top and own == top else either)]
    return " ".join(text for text, own in left if own >= least)


def with_lines(rows: DataFrame) -> DataFrame:
    """rows with ``lines``, the page's lines packed, in place of html: less to move than the markup."""
    keep = [c for c in rows.columns if c != "html"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(json.dumps(page_lines(x), ensure_ascii=False).encode("utf-8", "surrogatepass"), 6) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(packed, pa.binary())], names=[*keep, "lines"])

    return rows.select(*keep, "html").mapInArrow(work, T.StructType([*[rows.schema[c] for c in keep], T.StructField("lines", T.BinaryType())]))


def unpacked(lines: bytes) -> list[tuple[str, int]]:
    return [tuple(x) for x in json.loads(zlib.decompress(lines).decode("utf-8", "surrogatepass"))]


def numbered(rows: DataFrame) -> DataFrame:
    """(page, lines, host, at): at is each row's number in the order (host, path, page_id), found without one task seeing all."""
    url = F.coalesce("page.url", F.lit(""))
    rest = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    rows = rows.withColumns({"host": F.lower(F.regexp_extract(url, rest + r"([^/?#]*)", 1)), "path": F.regexp_extract(url, rest + r"[^/?#]*([^?#]*)", 1)})
    order = ["host", "path", "page.page_id", "page.url"]
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    first, starts = 0, []
    for p, n in counts:
        starts.append((p, first))
        first += n
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "p long, first long")
    return rows.join(F.broadcast(offsets), part == F.col("p")).select("page", "lines", "host", (F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("at"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html and others) with text in place of html."""
    keep = [c for c in pages.columns if c not in ("html", "text")]
    rows = numbered(with_lines(pages.select(F.struct(*keep).alias("page"), "html")))
    place, group = F.col("at") % GROUP, F.floor(F.col("at") / GROUP)
    groups = F.array_compact(F.array(group, F.when(place < REACH, group - 1), F.when(place >= GROUP - REACH, group + 1)))
    page = rows.schema["page"].dataType

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("at").to_numpy(), kind="stable")))
        at, host = rows.column("at").to_numpy(), rows.column("host").to_pylist()
        lines = [unpacked(x) for x in rows.column("lines").to_pylist()]

        def side(i: int, step: int) -> Iterator[list[tuple[str, int]]]:
            for j in range(i + step, i + step * (REACH + 1), step):
                if not 0 <= j < len(at) or host[j] != host[i]:
                    return
                yield lines[j]

        own = np.flatnonzero(at // GROUP == key[0].as_py())
        texts = [main_text(lines[i], side(i, -1), side(i, 1)) for i in own]
        return rows.take(pa.array(own)).select(["page"]).append_column("text", pa.array(texts, pa.string()))

    schema = T.StructType([T.StructField("page", page), T.StructField("text", T.StringType())])
    out = rows.withColumn("group", F.explode(groups)).groupBy("group").applyInArrow(work, schema)
    return out.select("page.*", "text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_main": op4_html}
ORACLES: dict[str, str] = {}
