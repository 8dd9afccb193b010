"""The only Python that runs on executors: turning HTML text into element facts.

A task parses its own rows with the standard library's tokenizer and reports texts and
attributes. Every rule about what those facts mean is a Spark expression elsewhere.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from prospectry.session import bound_batches

# Elements without content, and elements whose text is not page text.
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
_UNREAD = frozenset(["script", "style", "template", "rt", "rp"])

_ROWS_PER_BATCH = 64

# Ship this module's code with each job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self, skip: str = "") -> Iterator["Element | str"]:
        """Everything inside, in document order, passing over the content of ``skip`` elements.

        No recursion, as unclosed tags nest deeply.
        """
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            yield child
            if isinstance(child, Element) and child.name != skip:
                stack.extend(reversed(child.children))

    def all(self, *names: str, css: str = "", having: str = "") -> Iterator["Element"]:
        wanted = set(css.split())
        for e in self.walk():
            if (
                isinstance(e, Element)
                and (not names or e.name in names)
                and (not wanted or wanted <= set(e.attrs.get("class", "").split()))
                and (not having or having in e.attrs)
            ):
                yield e

    def first(self, *names: str, css: str = "", having: str = "") -> "Element | None":
        return next(self.all(*names, css=css, having=having), None)

    def text(self, gap: str = "") -> str:
        """Readable text. Script and style text counts only inside its own element."""
        own = self.name in _UNREAD
        return gap.join(t for t in self.walk() if isinstance(t, str) and (own or not isinstance(t, Unread)))


class Unread(str):
    """Text that is kept out of the page text."""


class _Reader(HTMLParser):
    """Builds the element tree as written: unclosed elements stay open, stray ends are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self._open = [self.root]
        self._counts: dict[str, int] = {}
        self._pending: list[str] = []

    def updatepos(self, i, j):
        """Lines are not counted, as nobody asks for them."""
        return j

    def _flush(self) -> None:
        if self._pending:
            text = "".join(self._pending)
            self._pending.clear()
            unread = any(self._counts.get(n) for n in _UNREAD)
            self._open[-1].children.append(Unread(text) if unread else text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self._open[-1].children.append(element)
        if tag not in _VOID:
            self._open.append(element)
            self._counts[tag] = self._counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self._counts.get(tag):
            return
        while True:
            closed = self._open.pop()
            self._counts[closed.name] -= 1
            if closed.name == tag:
                return

    def handle_data(self, data):
        self._pending.append(data)

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[6:])
            self._flush()

    def _skip(self, data):
        self._flush()

    handle_comment = handle_decl = handle_pi = _skip

    def close(self):
        super().close()
        self._flush()


def read_html(html: str) -> Element:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


# --- facts of one results page -------------------------------------------------------------

# CSS classes that mark the parts of a listing on a results page.
FULL_CONTAINER = "Nv2PK tH5CWc THOPZb"
ANY_CONTAINER = "Nv2PK"
LISTING_ANCHOR = "hfpxzc"
HEADLINE = "qBF1Pd"
STARS = "ZkP5Je"
RATING = "MW4etd"
REVIEWS = "UY7F9"
CATEGORY_LIST = "category-list-display"
TEXT_BLOCK = "W4Efsd"
PHONE = "UsdlK"


def _listing_facts(box: Element) -> dict:
    # One walk for all rules: a results page has many boxes, and each rule looks at few kinds of elements.
    inside: dict[str, list[Element]] = {"a": [], "div": [], "span": []}
    for e in box.walk():
        if isinstance(e, Element) and e.name in inside:
            inside[e.name].append(e)

    def marked(name: str, css: str, having: str = "") -> Iterator[Element]:
        return (e for e in inside[name] if css in e.attrs.get("class", "").split() and (not having or having in e.attrs))

    link = next(marked("a", LISTING_ANCHOR), None)
    headline = next(marked("div", HEADLINE), None)
    stars = next(marked("span", STARS, "aria-label"), None)
    rating = stars.first("span", css=RATING) if stars else None
    reviews = stars.first("span", css=REVIEWS) if stars else None
    categories = next(marked("div", CATEGORY_LIST), None)
    labelled = (a for a in inside["a"] if "website" in a.attrs.get("aria-label", "").lower())
    valued = (a for a in inside["a"] if a.attrs.get("data-value") == "Website")
    website = next(labelled, None) or next(valued, None)

    def block(e: Element) -> dict:
        phone = e.first("span", css=PHONE)
        return {"text": e.text(" "), "phone": phone.text() if phone else None}

    return {
        "link_href": link.attrs.get("href") if link else None,
        "link_label": link.attrs.get("aria-label") if link else None,
        "headline": headline.text(" ") if headline else None,
        "rating_text": rating.text() if rating else None,
        "reviews_text": reviews.text() if reviews else None,
        "category_texts": [e.text(" ") for e in categories.all("a", "span", "div")] if categories else [],
        "blocks": [block(e) for e in marked("div", TEXT_BLOCK)],
        "has_website_anchor": website is not None,
        "website_href": website.attrs.get("href") if website else None,
    }


def results_page_facts(html: str) -> list[dict]:
    """Facts of every listing container, in page order."""
    page = read_html(html)
    boxes = list(page.all("div", css=FULL_CONTAINER)) or list(page.all("div", css=ANY_CONTAINER))
    return [_listing_facts(b) for b in boxes]


# --- facts of one detail panel -------------------------------------------------------------


def panel_facts(html: str) -> dict:
    panel = read_html(html)
    company, badge = panel.first("strong"), panel.first("small")
    rows = []
    for row in list(panel.all("tr"))[1:]:
        cells = list(row.all("td"))
        if len(cells) >= 2:
            rows.append({"label": cells[0].text().strip(), "value": cells[1].text().strip()})
    return {
        "company": company.text() if company else None,
        "badge": badge.text() if badge else None,
        "rows": rows,
    }


# --- facts of one site page ----------------------------------------------------------------


def _join_text(page: Element, skip: str = "") -> str:
    texts = (t.strip() for t in page.walk(skip) if isinstance(t, str) and not isinstance(t, Unread))
    return " ".join(t for t in texts if t)


def site_page_facts(html: str) -> dict:
    page = read_html(html)
    title = page.first("title")
    has_noscript = page.first("noscript") is not None
    return {
        "text": _join_text(page, "noscript"),
        "full_text": _join_text(page) if has_noscript else None,
        "title": title.text() if title else None,
        "h1_count": sum(1 for _ in page.all("h1")),
        "img_count": sum(1 for _ in page.all("img")),
        "metas": [{k: m.attrs.get(k) for k in ("name", "property", "content")} for m in page.all("meta")],
        "scripts": [{"src": s.attrs.get("src"), "body": s.text()} for s in page.all("script")],
        "styles": [s.text() for s in page.all("style")],
        "stylesheets": [
            e.attrs["href"] for e in page.all("link", having="href")
            if "stylesheet" in e.attrs.get("rel", "").split()
        ],
        "marked_attributes": ["ng-version"] if page.first(having="ng-version") else [],
    }


# --- running a fact finder over a table ----------------------------------------------------


def parse_column(
    pages: DataFrame, html: str, facts: Callable[[str], object], dtype: T.DataType, out: str
) -> DataFrame:
    """Replace the HTML column by what ``facts`` finds in it; other columns pass through.

    Batches are bounded in bytes on the way in, whatever the session's settings, and cut small on
    the way out, so a worker holds a few pages at a time.
    """
    bound_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(out, dtype)])
    arrow = to_arrow_type(dtype)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_PER_BATCH):
                part = batch.slice(start, _ROWS_PER_BATCH)
                found = [None if h is None else facts(h) for h in part.column(html).to_pylist()]
                columns = [part.column(n) for n in names]
                columns.append(pa.array(found, type=arrow))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    return pages.select(*names, html).mapInArrow(run, schema)
