"""Main text of web pages by text-to-tag ratios of parser events."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end the block of text before them. A line break is white space.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold others and so say where a block lies.
HOLDERS = frozenset("article aside body details dialog div dl fieldset figure footer form head header main menu nav ol section table td th tr ul".split())
#: Elements whose text is never the page's own.
ASIDE = frozenset("aside button datalist dialog fieldset footer form head iframe input label menu nav noscript object option script select style svg template textarea".split())
#: Words of class or id that mark menus, headers, footers, sidebars, notices and adverts.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising alert banner bottombar breadcrumb breadcrumbs consent cookie cookies copyright disclaimer "
    "footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popups promo promoted promotion recommended "
    "related search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar tracking warning widget widgets".split()
)
#: Words of class or id that mark what readers wrote.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Parts of a word that say what a page has or how it is laid out, not what an element is.
STATES = frozenset("has have no not with without is in on off show shown hide open opened close closed enabled disabled active inactive layout page template style theme type".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_parts = re.compile(r"[A-Za-z]+|\d+").findall
#: Smoothing over neighbouring blocks: Gaussian weights at distances 0, 1 and 2.
_KERNEL = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
#: Text is the page's own, or so only if nothing else is, or never.
OWN, SECOND, NEVER = 0, 1, 2


def _marked(attrs: list[tuple[str, str | None]]) -> int:
    """How far an element's class, id and role take its text from the page's own.

    A word of class or id marks whole, or by its first or last part
    ("site-footer", "sidebar-left"); one that names a state ("has-sidebar",
    "share-on") says nothing of the element.
    """
    found = OWN
    for name, value in attrs:
        if name in ("class", "id") and value:
            for word in value.lower().split():
                parts = _parts(word)
                if not parts or len(parts) > 1 and not STATES.isdisjoint(parts):
                    continue
                ends = {word, parts[0], parts[-1]}
                if not ends.isdisjoint(READERS):
                    return NEVER
                if not ends.isdisjoint(MARKED):
                    found = SECOND
        elif name == "role" and (value or "").lower() in ROLES:
            return NEVER
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            found = SECOND
    return found


class Events(HTMLParser):
    """Turns parser events into blocks: text, tags before and in it, where it lies, whose it is.

    Where is the number of the outermost article or main element around the
    block, else of its nearest holder. The parser keeps the open holders, not a
    tree. A ``main`` is the page's own, whatever it lies in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.wheres: list[int] = []
        self.levels: list[int] = []
        self.in_main: list[bool] = []
        self.open: list[tuple[str, int, int]] = [("", 1, OWN)]  # element, where, level
        self.times: Counter = Counter()  # open elements by name
        self.made, self.counted, self.data = 1, 0, []
        self.heading = 0

    def _main(self) -> bool:
        return self.times["article"] > 0 or self.times["main"] > 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.counted += 1
        if tag in BLOCKS:
            self.end_block()
        if tag in VOID:
            if tag == "br":
                self.data.append(" ")
            return
        if tag in ("h1", "h2", "h3"):
            self.heading += 1
        holds = tag in HOLDERS or tag in ASIDE
        marked = _marked(attrs) if attrs else OWN
        if not holds and (not marked or tag in ("html", "p", "a", "b", "i", "em", "strong", "li", "h1", "h2", "h3")):
            return
        _, where, level = self.open[-1]
        main = self._main()
        if tag in ASIDE or tag == "header" and not main or not holds:
            level = NEVER
        elif tag == "main" and level == SECOND:
            level = OWN
        elif tag not in ("body", "main"):
            level = max(level, marked)
        if not main:
            self.made += 1
            where = self.made
        self.open.append((tag, where, level))
        self.times[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.counted += 1
        if tag in BLOCKS:
            self.end_block()
        if tag in ("h1", "h2", "h3"):
            self.heading = max(0, self.heading - 1)
        while self.times[tag] > 0:
            closed = self.open.pop()[0]
            self.times[closed] -= 1
            if closed == tag:
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        tag, _, level = self.open[-1]
        if level == NEVER:
            if tag not in ("script", "style"):
                self.data.append("\0")  # text that is not the page's own
        elif not self.times["header"] or self.heading:
            self.data.append(data)

    def end_block(self) -> None:
        if not self.data:
            return
        text = " ".join("".join(self.data).split())
        if text:
            own = text.replace("\0", "").strip()
            self.texts.append(own)
            self.wheres.append(self.open[-1][1])
            self.levels.append(self.open[-1][2] if own else NEVER)
            self.in_main.append(self._main())
            self.tags.append(self.counted)
            self.counted = 0
        self.data = []


def ratios(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Smoothed text-to-tag ratio of each block."""
    found = lengths / np.maximum(1, tags)
    if len(found) < 2:
        return found
    weight = np.convolve(np.ones(len(found)), _KERNEL, "same")[: len(found)] if len(found) >= 5 else None
    if weight is None:
        padded = np.pad(found, 2)
        ones = np.pad(np.ones(len(found)), 2)
        return np.convolve(padded, _KERNEL, "same")[2:-2] / np.convolve(ones, _KERNEL, "same")[2:-2]
    return np.convolve(found, _KERNEL, "same") / weight


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the ratios (two means from the least and the greatest)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        above = values > cut
        if not above.any() or above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The text of the page's content regions, one block a line; '' if there is none.

    Each block's text-to-tag ratio, smoothed over its neighbours, falls into one
    of two clusters. A region of the upper cluster names the article around it,
    or the holder it lies in; its blocks are the result, short ones too, less
    whatever menus, forms, comments and the like hold. Only where a page has no
    article of its own do those count that lie in an element marked by class,
    and only where it has no text of its own any other text in such elements.
    """
    if not html:
        return ""
    events = Events()
    for at in range(0, len(html), 1 << 18):
        events.feed(html[at : at + (1 << 18)])
    events.close()
    events.end_block()
    levels, in_main, wheres = np.array(events.levels, dtype=np.int64), np.array(events.in_main, dtype=bool), np.array(events.wheres)
    own = levels == OWN
    if not (own & in_main).any() and ((levels == SECOND) & in_main).any():
        own |= (levels == SECOND) & in_main
    if not own.any():
        own = levels == SECOND
    if not own.any():
        return ""
    lengths = np.where(own, [len(t) for t in events.texts], 0).astype(np.float64)
    smooth = ratios(lengths, np.array(events.tags))
    content = (smooth >= threshold(smooth)) & own
    if not content.any():
        content = lengths == lengths.max()
    regions = np.unique(wheres[content])
    return "\n".join(t for t, w in zip(events.texts, own & np.isin(wheres, regions), strict=True) if w)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row a page, from its whole html.

    A null or empty html, and a page without content, have an empty text. Ids
    and urls pass as they are, null or repeated. An empty table gives no rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return chosen.mapInArrow(of, "page_id long, url string, text string, n_chars long")
