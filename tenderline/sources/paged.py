"""A batch data source over numbered pages: ``spark.read.format("paged_json")``.

Pages come from files ``<root>/<window>/<page>.json`` or, given a template with {window}, {page} and {size}, over HTTP. One
partition is one (window, page), planned from the first page's total count. A page is asked for three times with growing
pauses; a page that must have items and has none raises ``Incomplete`` after that, which fails the task, so Spark tries it anew
and then fails the job rather than losing rows. HTTP is not covered by tests: nothing answers here.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .errors import Incomplete, Response, Temporary

ATTEMPTS, PAUSE_S, PAGE_SIZE, MOST_PAGES = 3, 0.1, 999, 1000
#: HTTP states that may pass.
TEMPORARY = frozenset({429, 500, 502, 503, 504})


def build_url(base: str, params: dict[str, object]) -> str:
    """The URL with all parameters that are neither null nor blank, and JSON asked for."""
    given = {k: str(v) for k, v in params.items() if v is not None and str(v).strip()}
    return f"{base}?{urllib.parse.urlencode(given | {'type': 'json'})}"


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // max(size, 1)))


class Pages:
    """Fetches one page's text."""

    def __init__(self, options: dict):
        self.root, self.template = options.get("root"), options.get("template")
        self.size = int(options.get("page_size", PAGE_SIZE))
        self.pause = float(options.get("pause_s", PAUSE_S))

    def text(self, window: str, page: int) -> str:
        for k in range(ATTEMPTS):
            try:
                return self._once(window, page)
            except Temporary:
                if k == ATTEMPTS - 1:
                    raise
                time.sleep(self.pause * 2**k)
        raise AssertionError

    def _once(self, window: str, page: int) -> str:
        if self.template:
            url = self.template.format(window=urllib.parse.quote(window), page=page, size=self.size)
            try:
                with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
                    return r.read().decode()
            except urllib.error.HTTPError as e:
                raise (Temporary if e.code in TEMPORARY else Response)(f"HTTP {e.code}") from e
            except OSError as e:
                raise Temporary(str(e)) from e
        try:
            with open(os.path.join(self.root, window, f"{page}.json"), encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError as e:
            raise Temporary(str(e)) from e

    def checked(self, window: str, page: int, required: bool) -> tuple[str, int, int]:
        """(text, total count, items); an empty page that must not be empty is asked for again."""
        for k in range(ATTEMPTS):
            text = self.text(window, page)
            total, n = _counts(text)
            if n or not required:
                return text, total, n
            time.sleep(self.pause * 2**k)
        raise Incomplete(f"page {page} of {window} is empty")


def _counts(text: str) -> tuple[int, int]:
    try:
        body = json.loads(text)["response"]["body"]
        items = body.get("items") or []
        items = items.get("item", []) if isinstance(items, dict) else items
        return int(body["totalCount"]), len(items) if isinstance(items, list) else 1
    except (KeyError, TypeError, ValueError) as e:
        raise Response("the page has no envelope") from e


class _Part(InputPartition):
    def __init__(self, window: str, page: int, required: bool):
        self.window, self.page, self.required = window, page, required


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.windows = [w for w in options.get("windows", "").split(",") if w]

    def partitions(self):
        pages, out = Pages(self.options), []
        for w in self.windows:
            _, total, n = pages.checked(w, 1, False)
            if total and not n:
                pages.checked(w, 1, True)
            count = page_count(total, n or pages.size)
            if count > int(self.options.get("most_pages", MOST_PAGES)):
                raise Incomplete(f"{w} needs {count} pages")
            out += [_Part(w, k, total > 0) for k in range(1, count + 1)]
        return out

    def read(self, partition):
        text, total, n = Pages(self.options).checked(partition.window, partition.page, partition.required)
        yield partition.window, partition.page, total, n, text


class _PushReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        """A window asked for by name is the only one whose pages are fetched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("window",):
                self.windows = [w for w in self.windows if w == f.value]
            elif isinstance(f, In) and f.attribute == ("window",):
                self.windows = [w for w in self.windows if w in f.value]
            else:
                yield f


class PagedJson(DataSource):
    """Options: windows (joined by commas), root or template, page_size, most_pages, pause_s, pushdown.

    ``pushdown=true`` needs spark.sql.python.filterPushdown.enabled in the session.
    """

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "window string, page_no int, total_count bigint, n_items int, page string"

    def reader(self, schema):
        return (_PushReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


def growing_pages(fetch, most: int = 100) -> list:
    """All pages of a window whose total may rise meanwhile: the page count follows a rise and ignores a fall."""
    out, count, size, page = [], 1, 0, 1
    while page <= count:
        if page > most:
            raise Incomplete("too many pages")
        total, items = fetch(page)
        size = size or len(items)
        count = max(count, page_count(total, size) if size else 1)
        out.append(items)
        page += 1
    return out


def cumulative_pages(fetch, most: int = 1000) -> list:
    """Pages until as many items as the first page's total have come; an empty page before that is an error."""
    out, got, want, page = [], 0, None, 1
    while want is None or got < want:
        if page > most:
            raise Incomplete("too many pages")
        total, items = fetch(page)
        want = total if want is None else want
        if not items and got < want:
            raise Incomplete(f"page {page} is empty")
        out.append(items)
        got += len(items)
        page += 1
    return out
