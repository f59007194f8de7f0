"""Main text of web pages by differencing each page with the page of the nearest URL.

Pages are dealt by ranges of (host, path, page_id) and read in that order; a page is paired with the one before or
after it on the same host, whichever shares the longer path (the one before, if equal); pages with the very same text are
passed over, so copies never meet each other.  Runs of equal pages at the ends of a task's range meet their neighbours in a second
step: one narrow row for each end says which run lies next, and joins fetch its lines.

All text lines (blocks) of a pair, those of menus, headers and footers too, are aligned by longest common subsequence (Hirschberg's, on bit
vectors: memory linear in the lines, repeated or not), and shared lines are deleted.  In an article or main element, articles
on neighbouring pages quote the same passages and carry the same licence lines; there a shared line is deleted only if it mostly consists of
links or if its element is one that is named after boilerplate.

What differencing can't see comes last: lines that no neighbour shares but whose markup says that they are no text (forms, asides,
elements whose class, id or role names an advert, notice, menu, share bar or comment list: reader comments differ from page to page), and lines
outside the article of pages that have one.  Scripts, styles and other elements that are never shown are not read at all.

Null html gives an empty text.  A null or odd URL counts as host and path ''.  Repeated rows are copies of each other and meet the
same neighbour.  A page without a neighbour of other text keeps its unruled lines.  Pages end anywhere: open elements end with the page.  Very long
pages and pages of very many equal lines are read whole.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import os
import pickle
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._spark import Scratch, batch_rows, map_frames, partitions

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW = {n: re.compile(rf"</{n}\b", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head noscript template svg canvas object select datalist audio video".split())  # never shown as text
_DROP = _HIDDEN | frozenset("nav header footer aside form button dialog menu".split())
_BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html", "caption", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments commentlist disqus reply replies respond share sharing social related recommended widget "
    "toolbar pagination pager skip login search".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


def _noise(name: str, attrs: str) -> bool:
    if name in ("html", "body", "main"):
        return False
    for key, *values in _MARK.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id"):
            found = set(_WORDS.findall(value)) & _NOISE
            if found and (name != "article" or found & {"comment", "comments", "reply"}):
                return True
        elif key == "role" and value.strip() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


Line = tuple[str, bool, bool, bool]


def _parse(page: str) -> list[Line]:
    """(line, mostly links, in an article, ruled out by markup) for each block of text that is shown."""
    out: list[Line] = []
    stack: list[tuple[str, int, bool]] = []  # name, 0 text / 1 ruled out by class / 2 by tag / 3 not shown, in an article
    parts: list[str] = []
    linked = [0]
    links = 0

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                core = stack[-1][2] if stack else False
                out.append((text, 2 * linked[0] > len(text), core, bool(stack and stack[-1][1])))
            parts.clear()
        linked[0] = 0

    def text(raw: str) -> None:
        if raw and not (stack and stack[-1][1] == 3):
            t = html.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if links:
                linked[0] += len(" ".join(t.split()))

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a" and links:
                links -= 1
            if any(x[0] == name for x in stack):
                if name in _BLOCK or name in _DROP:
                    close()
                while True:
                    top = stack[-1][0]
                    if top in _BLOCK or top in _DROP:
                        close()
                    stack.pop()
                    if top == name:
                        break
            continue
        if name in _RAW:
            rest = _RAW[name].search(page, at)
            at = len(page) if rest is None else (page.find(">", rest.end()) + 1 or len(page))
            continue
        if name == "br" or name in ("td", "th"):
            parts.append(" ") if parts else None
        if name in _VOID:
            if name == "hr":
                close()
            continue
        if name in _BLOCK or name in _DROP:
            close()
        if name in _ENDS_P and stack:
            # A new block ends an open paragraph, with what is open in it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK or stack[k][0] in _DROP:
                    break
        if name == "li" or name in ("tr", "dt", "dd"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "table", "dl") or stack[k][0] in _DROP:
                    break
        if m["attrs"].rstrip().endswith("/") and name not in _BLOCK:
            continue
        state, core = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if name in _HIDDEN:
            state = 3
        elif name in _DROP:
            state = max(state, 2)
        elif _noise(name, m["attrs"]) and state < 2:
            state = 1
        elif name in ("article", "main") and state == 1:
            state = 0
        if name in ("article", "main"):
            core = True
        if name == "a":
            links += 1
        stack.append((name, state, core))
    text(page[at:])
    close()
    return out


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The lengths of the longest common subsequences of a and b[:j], for every j: one pass of bit vectors of len(b) bits."""
    masks: dict[str, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = masks.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    out = [0]
    for bit in f"{v:0{len(b)}b}"[::-1] if b else "":
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b (Hirschberg's halving)."""
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            out.add(k - 1)
            k, m = k - 1, m - 1
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.add(i)
            continue
        half = (i + k) // 2
        left, right = _lengths(a[i:half], b[j:m]), _lengths(a[half:k][::-1], b[j:m][::-1])
        cut = j + max(range(m - j + 1), key=lambda x: left[x] + right[m - j - x])
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return out


Page = tuple[list[Line], bool]


def candidates(page: str | None) -> Page:
    """A page's lines, and whether it has an article."""
    found = _parse(page or "")
    return found, any(core and not ruled for _, _, core, ruled in found)


def own(page: Page) -> list[str]:
    """The lines that markup doesn't rule out; pages that agree in these are copies."""
    lines, article = page
    return [t for t, _, core, ruled in lines if not ruled and (core or not article)]


def decide(page: Page, near: list[str] | None) -> list[tuple[str, str]]:
    """Each line with what becomes of it: 'kept', 'shared' (deleted by differencing) or 'ruled' (by markup alone)."""
    lines, article = page
    shared = common([x[0] for x in lines], near) if near else set()
    out = []
    for i, (line, linky, core, ruled) in enumerate(lines):
        quoted = article and core and not linky and not ruled
        out.append((line, "shared" if i in shared and not quoted else "ruled" if ruled or article and not core else "kept"))
    return out


def main_text(page: Page, near: list[str] | None) -> str:
    """near: all lines of the nearest page of other text."""
    return "\n\n".join(t for t, fate in decide(page, near) if fate == "kept")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    batch_rows(spark, 200)
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = pages.select(
        "page_id",
        "url",
        "html",
        F.lower(F.regexp_replace(F.substring_index(F.regexp_extract(rest, r"^[^/?#]*", 0), "@", -1), r"^www\.", "")).alias("host"),
        F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"(\.html?)?/*$", "").alias("path"),
    )
    order = ("host", "path", "page_id")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(page=[zlib.compress(pickle.dumps(candidates(x))) for x in batch["html"]])[["page_id", "url", "page", "host", "path"]]

    # Pages are parsed where they are read: their lines are dealt out, packed.
    parsed = map_frames(rows, parse, "page_id long, url string, page binary, host string, path string")
    dealt = parsed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        before, held, slot = None, None, 0  # the last page of the run before, the run, its number

        for batch in batches:
            done = []
            for page, url, lines, host, path in zip(batch["page_id"], batch["url"], batch["page"], batch["host"], batch["path"], strict=True):
                found = pickle.loads(zlib.decompress(lines))
                row = (None if pd.isna(page) else int(page), url, path, found)
                if held is not None and held.host == host and held.text == own(found):
                    held.pages.append(row)
                    if len(held.pages) > MOST_HELD:
                        done += held.spill(task, slot)
                    continue
                if held is not None:
                    done += held.close(task, slot, before, (host, path, [x[0] for x in found[0]]))
                    before, slot = held.last(), slot + 1
                held = _Run(host, own(found), [row])
            yield _frame(done)
        if held is not None:
            yield _frame(held.close(task, slot, before, None))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for batch in batches for x in batch.itertuples(index=False)]
        found = []
        for side, step in ((0, 1), (1, -1)):
            last = None  # the end before, and what stands before it: (task, slot, its own neighbour?)
            for x in rows[::step]:
                if (x.has_before, x.has_after)[side]:
                    at = (x.task, x.slot, True)
                else:
                    at = None if last is None else last[1] if last[0].key == x.key else (last[0].task, last[0].slot, False)
                    if at is not None:
                        found.append((x.task, x.slot, side, *at))
                last = (x, at)
        yield pd.DataFrame(found, columns=["task", "slot", "side", "at_task", "at_slot", "its_own"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                near = [pickle.loads(x) if x is not None else None for x in (row.before, row.after)]
                done.append(_finish(near[0], row.host, (None if pd.isna(row.page_id) else int(row.page_id), row.url, row.path, pickle.loads(row.page)), near[1]))
            yield _frame(done)[["page_id", "url", "text", "n_chars"]]

    scratch = Scratch(spark, "pages", "zstd")
    made = scratch.keep(map_frames(dealt, run, f"{_SCHEMA}, host string, path string, task int, slot int, page binary, key binary, before binary, after binary, first_page binary, last_page binary"))
    ends = made.where("slot IS NOT NULL AND page IS NULL")
    narrow = ends.where("key IS NOT NULL").select("task", "slot", "key", F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"))
    # Two rows of 40 bytes for each task are ordered in one.
    met = scratch.keep(map_frames(narrow.repartition(1).sortWithinPartitions("task", "slot"), meet, "task int, slot int, side int, at_task int, at_slot int, its_own boolean"))
    at = ends.select(F.col("task").alias("at_task"), F.col("slot").alias("at_slot"), "before", "after", "first_page", "last_page")
    there = met.join(at, ["at_task", "at_slot"]).select("task", "slot", F.expr("CASE WHEN side = 0 THEN IF(its_own, before, last_page) END AS before"), F.expr("CASE WHEN side = 1 THEN IF(its_own, after, first_page) END AS after"))
    near = ends.select("task", "slot", "before", "after").unionByName(there).groupBy("task", "slot").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    opened = made.where("page IS NOT NULL").select("page_id", "url", "path", "host", "page", "task", "slot").join(near, ["task", "slot"])
    out = scratch.keep(made.where("slot IS NULL").select("page_id", "url", "text", "n_chars").unionByName(map_frames(opened, finish, _SCHEMA)))
    scratch.keep_only(out)
    return out


MOST_HELD = 1000  # copies in a row that a task holds
_SCHEMA = "page_id long, url string, text string, n_chars long"
_COLUMNS = ["page_id", "url", "text", "n_chars", "host", "path", "task", "slot", "page", "key", "before", "after", "first_page", "last_page"]


class _Run:
    """Pages in a row, of one host, with the same text; pages are (page_id, url, path, candidates).  Neighbours are (host, path, lines)."""

    def __init__(self, host: str, text: list[str], pages: list[tuple]):
        self.host, self.text, self.pages = host, text, pages
        self.front, self.spilled = self._lines(pages[0]), False

    def _lines(self, page: tuple) -> tuple:
        return self.host, page[2], [x[0] for x in page[3][0]]

    def last(self) -> tuple:
        return self._lines(self.pages[-1])

    def spill(self, task: int, slot: int) -> list[tuple]:
        """Gives the pages held, but for the last, as ones that wait for the run's neighbours."""
        given, self.pages, self.spilled = self.pages[:-1], self.pages[-1:], True
        return [(page, url, "", 0, self.host, path, task, slot, pickle.dumps(found), *[None] * 5) for page, url, path, found in given]

    def close(self, task: int, slot: int, before: tuple | None, after: tuple | None) -> list[tuple]:
        if before is not None and after is not None and not self.spilled:
            return [_finish(before, self.host, x, after) for x in self.pages]
        # The last page is held back by spill(), so it is given here.
        out = self.spill(task, slot) + [(self.pages[-1][0], self.pages[-1][1], "", 0, self.host, self.pages[-1][2], task, slot, pickle.dumps(self.pages[-1][3]), *[None] * 5)]
        open_end = before is None or after is None
        digest = hashlib.blake2b(pickle.dumps((self.host, self.text)), digest_size=16).digest() if open_end else None
        known = [x and pickle.dumps(x) for x in (before, after)]
        out.append((None, None, None, None, self.host, None, task, slot, None, digest, *known, pickle.dumps(self.front), pickle.dumps(self.last())))
        return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _COLUMNS]
    kinds = {"page_id": "Int64", "n_chars": "Int64", "task": "Int32", "slot": "Int32"}
    return pd.DataFrame({n: pd.array(list(c), dtype=kinds[n]) if n in kinds else pd.Series(list(c), dtype=object) for n, c in zip(_COLUMNS, columns, strict=True)})


def _finish(before: tuple | None, host: str, page: tuple, after: tuple | None) -> tuple:
    near = [x for x in (before, after) if x is not None and x[0] == host]
    best = max(near, key=lambda x: len(os.path.commonprefix([x[1], page[2]])), default=None)
    text = main_text(page[3], best and best[2])
    return (page[0], page[1], text, len(text), *[None] * 10)
