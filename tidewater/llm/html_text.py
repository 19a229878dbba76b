"""Visible text of HTML pages by layout-aware rendering.

Each page goes through a small tree builder (implied end tags, implied rows, raw-text
elements, elements closed by their ancestors' ends) whose open and close events drive a
renderer: blocks are set on lines of their own, paragraphs and the like apart by an empty
line, list items marked and indented, preformatted text kept, and table cells laid out in
columns of even width, cells over several columns or rows in their place. Text that a browser
does not show is left out: head, scripts, styles and other non-rendered elements, what SVG
does not draw, the ``hidden`` attribute, inline styles ``display: none`` and ``visibility:
hidden`` (which a ``visible`` inside it lifts again), closed ``details`` and ``dialog``. The
text in form fields and on buttons is shown; of a select, all options are.

Both parts work from lists and an explicit stack, so depth of nesting is no limit, and
pages are independent rows: a long or broken page only delays its own batch.

Defined results:
* a null or blank page has the empty text; a page without tags is one run of text;
* unknown elements are inline; a stray end tag is ignored (``</p>`` alone is an empty
  paragraph, ``</br>`` a line break); what follows an unclosed ``<`` is text;
* each row has one result row, repeated rows and null ids too; an empty table gives an
  empty result; other columns than the page id and the html are not looked at.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import text_chunks

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = set(
    "head script style title template noscript noembed noframes iframe object audio video canvas datalist "
    "annotation annotation-xml param rp area base link meta".split()
)
#: Of an svg, text is drawn inside the first, and nothing inside the second.
DRAWN, UNDRAWN = {"text", "foreignobject"}, set("defs desc metadata symbol clippath mask pattern marker".split())
#: Elements whose white space is kept.
KEPT = {"pre", "xmp", "textarea"}
APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre xmp blockquote table figure hr".split())
BLOCK = APART | set(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html "
    "legend li main menu nav option optgroup search section summary caption textarea".split()
)
#: A start tag of the key ends open elements of the first set, up to one of the second.
_ITEM, _CELLS = {"ul", "ol", "menu", "dir"}, {"td", "th"}
ENDS = {
    "li": ({"li"}, _ITEM),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": (_CELLS, {"table", "tr"}),
    "th": (_CELLS, {"table", "tr"}),
    "tr": (_CELLS | {"tr"}, {"table"}),
    "tbody": (_CELLS | {"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": (_CELLS | {"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": (_CELLS | {"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
_CLOSES_P = BLOCK - {"body", "html", "legend", "option", "optgroup", "caption", "textarea"}
_STOP = {"table", "td", "th", "caption", "html", "body"}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
_INTEGER = re.compile(r"[ \t\n\r\f]*([-+]?[0-9]+)")
# Fixed value: types of input whose value is not text on the page.
_NO_TEXT = set("hidden password checkbox radio file image color range date time month week datetime-local".split())
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_QUOTED = re.compile(r"""=[ \t\n\r\f]*(["'])""")
_WHITE = re.compile(r"[ \t\n\r\f]+")


def _tag_end(page: str, at: int, last: dict[str, int], failed: set[int]) -> int:
    """Place of the ``>`` that ends the tag at ``at``, past quoted values; -1 if there is none.

    ``last`` has the page's last quote of each kind and ``failed`` the places from which no
    end is found, both kept for the page, so that broken pages take linear time.
    """
    first = end = page.find(">", at)
    place, passed = at, []
    while end >= 0 and place not in failed:
        passed.append(place)
        quote = _QUOTED.search(page, place, end)
        if not quote:
            return end
        if quote[1] not in last:
            last[quote[1]] = page.rfind(quote[1])
        if last[quote[1]] < quote.end():
            break
        close = page.find(quote[1], quote.end())
        place = close + 1
        end = page.find(">", place) if close > end else end
    failed.update(passed)
    return first


def _parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is text, open or close."""
    at, low, last, failed = 0, None, {}, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        named = _NAME.match(page, start + 1)
        if not named and page[start + 1 : start + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            at = start + 1
            continue
        end = _tag_end(page, start, last, failed)
        if end < 0:
            yield "text", "", page[start:]
            return
        at = end + 1
        if not named:
            continue
        name = named[1].lower()
        if page[start + 1] == "/":
            yield "close", name, ""
            continue
        yield "open", name, page[named.end() : end]
        if name in RAW:
            low = low or page.lower()
            stop = low.find(f"</{name}", at) if len(low) == len(page) else page.find(f"</{name}", at)
            stop = len(page) if stop < 0 else stop
            if name in KEPT and stop > at:
                yield "text", "", page[at:stop].replace("&", "&amp;") if name == "xmp" else page[at:stop]
            at = stop


def _given(rest: str) -> dict[str, str]:
    """Attributes of a start tag; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(rest):
        out.setdefault(k.lower(), html.unescape(v[1:-1] if v[:1] in ("'", '"') else v))
    return out


def _number(text: str | None, default: int, low: int, high: int) -> int:
    m = _INTEGER.match(text or "")
    return min(max(int(m[1][:12]), low), high) if m else default


def _shown(name: str, rest: str, visible: bool) -> tuple[bool, bool]:
    """Whether an element is displayed, and whether it is visible in ``visible`` surroundings."""
    if name in HIDDEN:
        return False, visible
    low = rest.lower()
    if name in ("details", "dialog") or "hidden" in low or "style" in low:
        given = _given(rest)
        if name == "dialog" and "open" not in given:
            return False, visible
        style = dict(_STYLE.findall(given.get("style", "").lower()))
        seen = style.get("visibility", "inherit")
        visible = visible if seen in ("inherit", "unset") else seen not in ("hidden", "collapse")
        return "hidden" not in given and style.get("display") != "none", visible
    return True, visible


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """Open, close and text events of a well-formed tree for ``page``."""
    stack: list[str] = []
    count: Counter[str] = Counter()

    def push(name: str) -> None:
        stack.append(name)
        count[name] += 1

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            count[stack[-1]] -= 1
            yield "close", stack.pop(), ""

    def open_at(names: set[str], stops: set[str]) -> int:
        if not any(count[n] for n in names):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                return i
            if stack[i] in stops:
                return -1
        return -1

    for kind, name, rest in _parts(page):
        if kind == "text":
            yield "text", "", rest
        elif kind == "open":
            if name in ENDS:
                while (i := open_at(*ENDS[name])) >= 0:
                    yield from close_to(i)
            if name in _CLOSES_P and (i := open_at({"p"}, _STOP)) >= 0:
                yield from close_to(i)
            if name in _CELLS and count["table"] and open_at({"tr"}, {"table"}) < 0:
                push("tr")
                yield "open", "tr", ""
            yield "open", name, rest
            if name in VOID or (rest.endswith("/") and (count["svg"] or count["math"]) and not count["foreignobject"]):
                yield "close", name, ""
            else:
                push(name)
        elif name in ("p", "br") and open_at({name}, _STOP) < 0:
            yield "open", name, ""
            yield "close", name, ""
        elif (i := open_at({name}, set() if name in _STOP else {"table", "td", "th"} - {name})) >= 0:
            yield from close_to(i)
    yield from close_to(0)


class Flow:
    """Lines of one block of text: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.apart = False
        self.indent = 0
        self.mark = ""

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *more = data.split("\n")
            self.words.append(first)
            for line in more:
                self.end_line(keep_empty=True)
                self.words.append(line)
        else:
            self.words.append(_WHITE.sub(" ", data))

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.words)
        line = line.rstrip() if keep_empty else re.sub(" {2,}", " ", line).strip(" ")
        self.words.clear()
        if line or keep_empty:
            self.put(line)

    def put(self, line: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = False
        pad = "  " * self.indent
        if self.mark:
            pad, self.mark = pad[:-2] + self.mark, ""
        self.lines.append((pad + line).rstrip())

    def block(self, apart: bool) -> None:
        self.end_line()
        self.apart = self.apart or apart


def _laid_out(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Cells of each row as (column, columns, lines): each at the first place that no cell from above covers.

    What reaches down is held as disjoint intervals (first column, end, first row free again),
    so a cell costs the same however many columns or rows it spans.
    """
    placed, down = [], []
    for y, row in enumerate(rows):
        at, k, cells, new = 0, 0, [], []
        for lines, across, deep in row:
            while k < len(down) and down[k][0] <= at:
                at, k = max(at, down[k][1]), k + 1
            cells.append((at, across, lines))
            if deep > 1:
                new.append((at, at + across, y + deep))
            at += across
        placed.append(cells)
        left = [x for x in down if x[2] > y + 1]
        down = _disjoint(sorted(left + new)) if new else left
    return placed


def _disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals in order without overlaps: of two that meet, the later one is cut to what is beyond the first."""
    out: list[tuple[int, int, int]] = []
    for start, end, until in spans:
        start = max(start, out[-1][1]) if out else start
        if start < end:
            out.append((start, end, until))
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table, columns padded to the widest cell and two blanks apart.

    Cells are (lines, columns, rows); a place that a cell from a row above covers stays empty.
    Columns in which no cell begins take no room, however many a cell spans.
    """
    placed = _laid_out(rows)
    columns = sorted({at for cells in placed for at, _, _ in cells})
    widths = [0] * len(columns)
    spread = [[(i := bisect_left(columns, at), bisect_left(columns, at + across, i), lines) for at, across, lines in cells] for cells in placed]
    for single in (True, False):
        for cells in spread:
            for i, j, lines in cells:
                if (j - i == 1) == single:
                    widths[j - 1] += max(max(map(len, lines), default=0) - sum(widths[i:j]) - 2 * (j - i - 1), 0)
    starts = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for cells in spread:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for i, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[i]) + lines[k]
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    """Rendered text of one page."""
    flow, outer, hidden, kept = Flow(), [], 0, 0
    lists: list[list] = []  # [ordered, number] of open lists
    tables: list[list] = []  # rows of open tables
    spans: list[tuple[int, int]] = []  # columns and rows of open cells
    shut: list[tuple[str, bool, bool]] = []  # open elements, whether they hide, and visibility around them
    visible = True
    closed: list[int] = []  # depth of closed details whose summary is shown
    svg: list[tuple[int, bool]] = []  # depth of open svg and drawn elements, and whether text shows there
    for kind, name, rest in events(page or ""):
        if kind == "text":
            if svg and not svg[-1][1]:
                continue
            if not hidden and visible and (not closed or "summary" in (x[0] for x in shut[closed[-1] :])):
                data = html.unescape(rest) if "&" in rest else rest
                flow.text(data, kept > 0)
            continue
        if kind == "open":
            around = visible
            shows, visible = _shown(name, rest, visible)
            hides = not shows or (bool(svg) and name in UNDRAWN)
            shut.append((name, hides, around))
            hidden += hides
            if hidden:
                continue
            if name == "svg" or (svg and name in DRAWN):
                svg.append((len(shut), name != "svg"))
                flow.block(False) if name in DRAWN else None
            if name == "details" and not re.search(r"\bopen\b", rest):
                closed.append(len(shut))
            if name == "br":
                flow.end_line(keep_empty=not "".join(flow.words).strip())
            elif name == "table":
                flow.block(True)
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in _CELLS and tables:
                outer.append(flow)
                given = _given(rest) if "span" in rest.lower() else {}
                spans.append((_number(given.get("colspan"), 1, 1, 1000), _number(given.get("rowspan"), 1, 1, 65534)))
                flow = Flow()
            elif name == "input" and visible:
                given = _given(rest)
                if given.get("type", "text").lower() not in _NO_TEXT and given.get("value"):
                    flow.text(f" {given['value']} ", kept > 0)
            elif name in BLOCK:
                flow.block(name in APART and not (name in _ITEM and lists))
                if name in _ITEM:
                    start = _number(_given(rest).get("start"), 1, -(10**9), 10**9) if name == "ol" else 1
                    lists.append([name == "ol", start - 1])
                    flow.indent += 1
                elif name == "li" and lists:
                    lists[-1][1] = _number(_given(rest).get("value"), lists[-1][1] + 1, -(10**9), 10**9)
                    flow.mark = f"{lists[-1][1]}. " if lists[-1][0] else "- "
                elif name in ("blockquote", "dd"):
                    flow.indent += 1
                elif name in KEPT:
                    kept += 1
            elif name in ("td", "th"):
                flow.words.append(" ")
            continue
        _, hides, visible = shut.pop()
        if not hidden:
            if closed and closed[-1] > len(shut):
                closed.pop()
            if svg and svg[-1][0] > len(shut):
                svg.pop()
                flow.block(False) if name in DRAWN else None
            if name == "table" and tables:
                flow.end_line()
                lines = table_lines(tables.pop())
                for line in lines:
                    flow.put(line)
                flow.apart = True
            elif name in _CELLS and tables and outer:
                flow.end_line()
                if tables[-1]:
                    tables[-1][-1].append((flow.lines, *spans[-1]))
                spans.pop()
                flow = outer.pop()
            elif name in BLOCK:
                if name in KEPT:
                    flow.end_line(keep_empty="".join(flow.words).strip() != "")
                    kept -= 1
                flow.block(name in APART and not (name in _ITEM and len(lists) > 1))
                if name in _ITEM and lists:
                    lists.pop()
                    flow.indent -= 1
                elif name in ("blockquote", "dd"):
                    flow.indent -= 1
                elif name == "li":
                    flow.mark = ""
        hidden -= hides
    flow.end_line()
    return "\n".join(flow.lines).strip("\n")


def extract_text(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per page: the key, text, n_chars, n_lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, source):
            out = [visible_text(page) for page in batch.column(source).to_pylist()]
            counts = [[len(x) for x in out], [x.count("\n") + 1 if x else 0 for x in out]]
            columns = [batch.column(key), pa.array(out, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.record_batch(columns, names=[key, "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(key).cast("long").alias(key), F.col(source).cast("string").alias(source))
    return rows.mapInArrow(run, f"{key} long, text string, n_chars long, n_lines long")
