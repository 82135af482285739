"""Web pages as arrays of elements and texts, one row per page.

A page stays one row from the raw HTML to the extracted fields, so nothing about it
is shuffled. Elements are listed in document order and know the range of their
descendants and of their texts, which makes a subtree one slice of the array.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = pa.struct(
    [
        ("idx", pa.int32()),
        ("parent", pa.int32()),
        ("last", pa.int32()),
        ("tag", pa.string()),
        ("classes", pa.string()),
        ("id", pa.string()),
        ("href", pa.string()),
        ("t_from", pa.int32()),
        ("t_to", pa.int32()),
    ]
)
ELEMENT_DDL = (
    "STRUCT<idx: INT, parent: INT, last: INT, tag: STRING, classes: STRING, id: STRING, href: STRING,"
    " t_from: INT, t_to: INT>"
)

# A selected element: the selector's number, then the element's fields.
HIT = pa.struct([("selector", pa.int32()), *(ELEMENT.field(n) for n in ("idx", "last", "href", "t_from", "t_to"))])
HIT_DDL = "STRUCT<selector: INT, idx: INT, last: INT, href: STRING, t_from: INT, t_to: INT>"

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Texts of these are no page text.
HIDDEN_TAGS = frozenset(["script", "style", "template"])
# Pages are handed back in pieces of about this many characters.
PIECE_CHARS = 4_000_000


# A tag with its attributes (a quoted value may hold any character), a comment or a declaration.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""",
    re.DOTALL,
)
# The same without quoted values, for the rest of a page after a quote that is never closed.
PLAIN_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
TAG_START = re.compile(r"</?[a-zA-Z]")


ATTRIBUTE = re.compile(
    r"""(?<![^\s"'/])(class|id|href)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.IGNORECASE
)
# The classes with blanks around each, the id and the link target of a tag.
NO_ATTRIBUTES = ("  ", None, None)
# Attributes and whole tags up to this length are remembered: few of a site's tags differ.
KNOWN_CHARS, KNOWN_TEXTS = 200, 10_000
# A tag that ends at its first closing mark whatever follows it: its quotes are closed, its values quoted.
WHOLE_TAG = re.compile(r"""</?[a-zA-Z][^\s/>="'<]*+(?:(?=[\s/])(?:[^>"'=<]|="[^"<>]*+"|='[^'<>]*+')*+)?>""")
CELL_TAGS = ("td", "th")


def _attributes(text: str) -> tuple[str, str | None, str | None]:
    if "=" not in text:
        return NO_ATTRIBUTES
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        value = values[0] or values[1] or values[2]
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return f" {' '.join(found.get('class', '').split())} ", found.get("id"), found.get("href")


RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}


@dataclass(frozen=True)
class Selector:
    """Elements by tag, class and link target."""

    tag: str
    css: str = ""
    link_part: str = ""
    linked: bool = False

    def picks(self, classes: str, href: str | None) -> bool:
        """``classes`` has blanks around each class."""
        return (
            (not self.css or f" {self.css} " in classes)
            and (not self.link_part or (href is not None and self.link_part in href))
            and (not self.linked or href is not None)
        )


class _Shredder:
    """Collects the elements and texts of many pages in flat columns."""

    def __init__(
        self,
        chosen: Sequence[Selector] = (),
        labels: Sequence[str] = (),
        label_tags: Sequence[str] = (),
        keep_own: bool = False,
        cells_of: str = "",
    ) -> None:
        self.columns: dict[str, list] = {field.name: [] for field in ELEMENT}
        self.texts: list[str] = []
        self.keep_own = keep_own
        self.known: dict[str, tuple[str, str | None, str | None]] = {}
        self.own_texts: dict[int, str] = {}
        self.hits: list[tuple[int, int]] = []
        self.values: list[list[str | None]] = []
        self.cells_of = re.compile(cells_of) if cells_of else None
        self.cells: list[list[list[str]]] = []
        self.known_tags: dict[str, tuple[str, str, str]] = {}
        self.element_offsets, self.text_offsets, self.hit_offsets = [0], [0], [0]
        self.labels, self.label_tags = [label.lower() for label in labels], frozenset(label_tags)
        self.by_tag: dict[str, list[tuple[int, Selector]]] = {}
        for number, selector in enumerate(chosen):
            self.by_tag.setdefault(selector.tag, []).append((number, selector))

    def page(self, html: str) -> None:
        """Collects a page in time linear in its length.

        A mark that begins no tag is text. Where a quoted value swallows the rest of the page, quotes
        no longer count from there on, so no part of a page is read more than twice.
        """
        columns, texts, by_tag, hits = self.columns, self.texts, self.by_tag, self.hits
        tags, last, t_to = columns["tag"], columns["last"], columns["t_to"]
        add_tag, add_last, add_t_to, add_text = tags.append, last.append, t_to.append, texts.append
        add_idx, add_parent, add_t_from = columns["idx"].append, columns["parent"].append, columns["t_from"].append
        add_classes, add_id, add_href = columns["classes"].append, columns["id"].append, columns["href"].append
        known, known_tag, learn_tag = self.known, self.known_tags.get, self._known_tag
        own_texts = self.own_texts if self.keep_own else None
        first_element, first_text = len(tags), len(texts)
        open_tags: list[str] = []
        open_at: list[int] = []
        open_count: dict[str, int] = {}
        # elements and texts of this page so far
        elements = found_texts = position = 0
        match, find, last_end = TOKEN.match, html.find, html.rfind(">")
        start = find("<")
        while True:
            token = None
            while start >= 0:
                if start > last_end:  # nothing is closed from here on, but for a comment that runs to the end
                    start = find("<!--", start)
                    if start < 0:
                        break
                end = find(">", start, start + KNOWN_CHARS) + 1
                token = known_tag(html[start:end]) if end else None
                if token is not None:
                    break
                token = match(html, start)
                if token is None and match == TOKEN.match and TAG_START.match(html, start):
                    match = PLAIN_TOKEN.match
                    token = match(html, start)
                if token is not None:
                    end, token = token.end(), learn_tag(token)
                    break
                start = find("<", start + 1)
            if token is None:
                start = len(html)
            if start > position:
                piece = html[position:start]
                text = (unescape(piece) if "&" in piece else piece).strip()
                if text and not (open_tags and open_tags[-1] in HIDDEN_TAGS):
                    add_text(text)
                    found_texts += 1
                    if own_texts is not None and open_at:
                        at = open_at[-1] + first_element
                        own = own_texts.get(at)
                        own_texts[at] = f"{own} {text}" if own else text
            if token is None:
                break
            position = end
            closing, tag, attributes = token
            if tag is not None:
                if closing:
                    if open_count.get(tag):
                        closed = None
                        while closed != tag:
                            at, closed = open_at.pop() + first_element, open_tags.pop()
                            open_count[closed] -= 1
                            last[at] = elements - 1
                            t_to[at] = found_texts
                else:
                    classes, its_id, href = known.get(attributes) or self._known(attributes)
                    add_idx(elements)
                    add_parent(open_at[-1] if open_at else -1)
                    add_last(elements)
                    add_tag(tag)
                    add_classes(classes)
                    add_id(its_id)
                    add_href(href)
                    add_t_from(found_texts)
                    add_t_to(found_texts)
                    for number, selector in by_tag.get(tag, ()):
                        if selector.picks(classes, href):
                            hits.append((number, first_element + elements))
                    elements += 1
                    if tag not in VOID_TAGS and not attributes.endswith("/"):
                        open_tags.append(tag)
                        open_at.append(elements - 1)
                        open_count[tag] = open_count.get(tag, 0) + 1
                        if tag in RAW_END:
                            end = RAW_END[tag].search(html, position)
                            position = end.start() if end else len(html)
            start = find("<", position)
        for at in open_at:
            last[at + first_element] = elements - 1
            t_to[at + first_element] = found_texts
        if self.labels:
            self.values.append(self._labelled(first_element, first_text))
        if self.cells_of:
            self.cells.append(self._cells(first_element, texts[first_text:]))
        self.element_offsets.append(len(tags))
        self.text_offsets.append(len(texts))
        self.hit_offsets.append(len(hits))

    def _known(self, attributes: str) -> tuple[str, str | None, str | None]:
        found = _attributes(attributes)
        if len(attributes) <= KNOWN_CHARS and len(self.known) < KNOWN_TEXTS:
            self.known[attributes] = found
        return found

    def _known_tag(self, token: re.Match) -> tuple[str, str | None, str]:
        """Closing mark, tag and attributes; remembered where they follow from the tag's text alone."""
        closing, tag, attributes = token.groups()
        found = closing, tag and tag.lower(), attributes
        whole = token.group()
        if tag and len(whole) <= KNOWN_CHARS and len(self.known_tags) < KNOWN_TEXTS and WHOLE_TAG.fullmatch(whole):
            self.known_tags[whole] = found
        return found

    def _cells(self, first_element: int, texts: list[str]) -> list[list[str]]:
        """The texts of the cells of each row below the chosen tables."""
        tags, classes, last = self.columns["tag"], self.columns["classes"], self.columns["last"]
        t_from, t_to, chosen = self.columns["t_from"], self.columns["t_to"], self.cells_of.search
        below = lambda at, wanted: (x for x in range(at + 1, first_element + last[at] + 1) if tags[x] in wanted)
        return [
            ["".join(texts[t_from[x] : t_to[x]]) for x in below(row, CELL_TAGS)]
            for table in range(first_element, len(tags))
            if tags[table] == "table" and chosen(classes[table])
            for row in below(table, ("tr",))
        ]

    def _labelled(self, first_element: int, first_text: int) -> list[str | None]:
        """For each label the text beside it: of the next other element under the same parent."""
        columns, texts = self.columns, self.texts[first_text:]
        starts = [0]
        for text in texts:
            starts.append(starts[-1] + len(text))
        whole = "".join(texts)
        lower = whole.lower()
        if len(lower) != len(whole):  # lower case of some characters is longer
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in whole)
        spots = [at for at in range(first_element, len(columns["tag"])) if columns["tag"][at] in self.label_tags]
        reach = lambda at: (starts[columns["t_from"][at]], starts[columns["t_to"][at]])
        found: list[str | None] = []
        for label in self.labels:
            places, at = [], lower.find(label)
            while at >= 0:
                places.append(at)
                at = lower.find(label, at + 1)
            spot = None
            for x in spots if places else ():
                begin, end = reach(x)
                near = bisect_left(places, begin)
                if near < len(places) and places[near] + len(label) <= end:
                    spot = x
                    break
            found.append(None if spot is None else self._beside(spot, spots, reach, whole, first_element))
        return found

    def _beside(self, spot: int, spots: list[int], reach, whole: str, first_element: int) -> str | None:
        columns = self.columns
        parent = columns["parent"][spot]
        end = columns["last"][first_element + parent] if parent >= 0 else len(columns["tag"]) - first_element
        same = lambda x: columns["tag"][x] == columns["tag"][spot] and columns["classes"][x] == columns["classes"][spot]
        text = lambda x: whole[slice(*reach(x))]
        for x in spots[bisect_left(spots, first_element + parent + 1) :]:
            if x - first_element > end:
                return None
            # an equal copy of the label is no value either
            if columns["t_to"][x] > columns["t_from"][x] and not (same(x) and text(x) == text(spot)):
                return text(x)
        return None

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        flat = pa.StructArray.from_arrays(
            [pa.array(self.columns[field.name], field.type) for field in ELEMENT], fields=list(ELEMENT)
        )
        elements = pa.ListArray.from_arrays(pa.array(self.element_offsets, pa.int32()), flat)
        return elements, self._texts()

    def _texts(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.text_offsets, pa.int32()), pa.array(self.texts, pa.string()))

    def hit_arrays(self) -> tuple[pa.Array, pa.Array]:
        """The selected elements of each page in document order, and the texts."""
        pick = lambda name: pa.array([self.columns[name][at] for _, at in self.hits], HIT.field(name).type)
        numbers = pa.array([number for number, _ in self.hits], pa.int32())
        flat = pa.StructArray.from_arrays([numbers, *(pick(f.name) for f in list(HIT)[1:])], fields=list(HIT))
        return pa.ListArray.from_arrays(pa.array(self.hit_offsets, pa.int32()), flat), self._texts()

    def own_arrays(self) -> tuple[pa.Array, pa.Array]:
        """Elements, and for each the texts that stand in it directly."""
        own = pa.array([self.own_texts.get(at, "") for at in range(len(self.columns["tag"]))], pa.string())
        return self.arrays()[0], pa.ListArray.from_arrays(pa.array(self.element_offsets, pa.int32()), own)

    def cell_arrays(self) -> tuple[pa.Array]:
        return (pa.array(self.cells, pa.list_(pa.list_(pa.string()))),)

    def label_arrays(self) -> tuple[pa.Array]:
        return (pa.array(self.values, pa.list_(pa.string())),)


def _reader(make: Callable[[], _Shredder], arrays: str, names: Sequence[str]):
    """The function that reads the pages of a task's batches, some characters at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, start = batch.column(batch.num_columns - 1), 0
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            while start < batch.num_rows:
                shredder, chars, row = make(), 0, start
                while row < batch.num_rows and chars < PIECE_CHARS:
                    html = htmls[row].as_py() or ""
                    shredder.page(html)
                    chars += len(html)
                    row += 1
                kept = [key.slice(start, row - start) for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *getattr(shredder, arrays)()], names=[*batch.schema.names[:-1], *names]
                )
                start = row

    return read


def _read(pages: DataFrame, keys: Sequence[str], html: str, make, arrays: str, added: dict[str, str]) -> DataFrame:
    chosen = pages.select(*keys, html)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    schema = ", ".join([*fields, *(f"{name} {kind}" for name, kind in added.items())])
    return chosen.mapInArrow(_reader(make, arrays, list(added)), schema)


def shredded(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """The page keys with ``elements`` and ``texts`` in place of the HTML."""
    added = {"elements": f"ARRAY<{ELEMENT_DDL}>", "texts": "ARRAY<STRING>"}
    return _read(pages, keys, html, _Shredder, "arrays", added)


def selected(pages: DataFrame, keys: Sequence[str], chosen: Sequence[Selector], html: str = "html") -> DataFrame:
    """The page keys with ``hits`` and ``texts``: the elements that any selector picks, in document order.

    A hit has the selector's number; an element that several selectors pick is a hit of each.
    """
    added = {"hits": f"ARRAY<{HIT_DDL}>", "texts": "ARRAY<STRING>"}
    return _read(pages, keys, html, lambda: _Shredder(chosen), "hit_arrays", added)


def beside_labels(
    pages: DataFrame, keys: Sequence[str], labels: Sequence[str], label_tags: Sequence[str], html: str = "html"
) -> DataFrame:
    """The page keys with ``values``: for each label the text beside it, null without one.

    A label is the first element of the tags whose text contains it, in any case; its value is the first
    other element of the tags with a text under the same parent.
    """
    make = lambda: _Shredder((), labels, label_tags)
    return _read(pages, keys, html, make, "label_arrays", {"values": "ARRAY<STRING>"})


def table_cells(pages: DataFrame, keys: Sequence[str], classes: str, html: str = "html") -> DataFrame:
    """The page keys with ``cells``: of each row below the tables of some classes, a pattern, the texts of its cells.

    Text pieces are joined without blanks. Rows of a table inside a table come once for each that is chosen.
    """
    make = lambda: _Shredder(cells_of=classes)
    return _read(pages, keys, html, make, "cell_arrays", {"cells": "ARRAY<ARRAY<STRING>>"})


def text_of(element: Column, texts: Column, base: Column | int = 0) -> Column:
    """All text below an element, pieces stripped and joined without blanks."""
    start = element["t_from"] - base + 1
    return F.array_join(F.slice(texts, start, element["t_to"] - element["t_from"]), "")


def below(elements: Column, element: Column, base: Column | int = 0) -> Column:
    """The descendants of an element."""
    return F.slice(elements, element["idx"] - base + 2, element["last"] - element["idx"])


def page_elements(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per element with the text that stands in it directly, pieces joined by a blank."""
    added = {"elements": f"ARRAY<{ELEMENT_DDL}>", "own": "ARRAY<STRING>"}
    rows = _read(pages, keys, "html", lambda: _Shredder(keep_own=True), "own_arrays", added)
    each = rows.select(*keys, F.explode(F.arrays_zip("elements", "own")).alias("e"))
    return each.select(*keys, "e.elements.*", F.col("e.own").alias("text")).drop("t_from", "t_to")


def page_links(pages: DataFrame, keys: Sequence[str], base: Column) -> DataFrame:
    """Links of each page in document order, made absolute."""
    rows = shredded(pages, keys)
    linked = F.filter("elements", lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    return rows.select(*keys, F.posexplode(F.transform(linked, lambda e: e["href"])).alias("position", "href")).withColumn(
        "url", absolute_url(F.col("href"), base)
    )


def absolute_url(href: Column, base: Column) -> Column:
    """A link target against the address of its page."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    target = F.regexp_extract(href, "^([^?#]*)", 1)
    tail = F.substring(href, F.length(target) + 1, F.length(href))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(target.startswith("/"), F.concat(host, _without_dots(target), tail))
        .when(target != "", F.concat(host, _without_dots(F.concat(folder, target)), tail))
        .when(tail.startswith("?"), F.concat(host, path, tail))
        .otherwise(F.concat(F.regexp_extract(base, "^([^#]*)", 1), tail))
    )


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, with the steps ``.`` and ``..`` carried out."""
    steps = F.split(F.substring(path, 2, 1_000_000_000), "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    # a path that ends in such a step is a folder
    folder = F.element_at(steps, -1).isin(".", "..") & (F.size(walked) > 0)
    whole = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))
    return F.when(F.contains(path, F.lit("/.")), whole).otherwise(path)
