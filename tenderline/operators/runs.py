"""Running a collection: page and time budgets, one run for equal requests, repeats until complete, and what a client is told."""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable, Hashable, Iterable
from concurrent.futures import Future

from ..sources.errors import Incomplete, Unauthorized

#: Pages of all windows, seconds of an enrichment and of the repeats until a period is complete.
MOST_PAGES, ENRICH_S, COMPLETE_S = 1000, 20.0, 300.0
#: A key's value in a URL or message.
SECRET = re.compile(r"(?i)(serviceKey=)[^&\s]+")


class PageBudget:
    """Pages that all windows of a run share. Every window has its first page; the further ones come out of the rest."""

    def __init__(self, most: int = MOST_PAGES):
        self.left = most

    def windows(self, windows: list, fetch: Callable) -> list:
        """``fetch(window, pages that it may take)`` gives a window's pages, in the order of the windows. Raises Incomplete beyond the budget."""
        if len(windows) > self.left:
            raise Incomplete(f"{len(windows)} pages at least, {self.left} may be read")
        self.left -= len(windows)
        out = []
        for w in windows:
            pages = fetch(w, self.left + 1)
            if len(pages) > self.left + 1:
                raise Incomplete(f"{len(pages)} pages of a window, {self.left + 1} may be read")
            self.left -= max(0, len(pages) - 1)
            out.append(pages)
        return out


def within(keys: Iterable, lookup: Callable, seconds: float = ENRICH_S, clock: Callable[[], float] = time.monotonic) -> tuple[dict, int]:
    """(answers, how many keys were left): ``lookup(key, seconds left)`` for one key after another until the time is over or a lookup runs into it."""
    end, out, keys = clock() + seconds, {}, list(dict.fromkeys(keys))
    for k in keys:
        left = end - clock()
        if left <= 0:
            break
        try:
            out[k] = lookup(k, left)
        except TimeoutError:
            break
    return out, len(keys) - len(out)


class SingleFlight:
    """Equal requests that overlap share one run and its result or error; a settled one is forgotten."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), {}

    def __call__(self, key: Hashable, run: Callable):
        with self._lock:
            mine = key not in self._running
            shared = self._running.setdefault(key, Future())
        if not mine:
            return shared.result()
        try:
            shared.set_result(run())
        except BaseException as e:  # noqa: BLE001  whoever waits gets the same error
            shared.set_exception(e)
        finally:
            with self._lock:
                del self._running[key]
        return shared.result()


def until_complete(load: Callable, done: Callable, seconds: float = COMPLETE_S, clock: Callable[[], float] = time.monotonic) -> tuple[object, bool]:
    """(last answer, whether it is done): ``load()`` again and again until ``done(answer)`` or the time is over; at least once."""
    began = clock()
    while True:
        answer = load()
        if done(answer):
            return answer, True
        if clock() - began >= seconds:
            return answer, False


def flags(env: dict[str, str] | None = None) -> dict[str, bool]:
    """Whether a service key is there and whether enrichment is switched on."""
    env = os.environ if env is None else env
    return {"key_configured": bool(env.get("DATA_GO_KR_SERVICE_KEY", "").strip()), "enrichment_enabled": env.get("ENRICHMENT_ENABLED") == "true"}


def answer(status: str, errors: list[tuple[object, Exception]]) -> tuple[int, list[str], str | None]:
    """(HTTP state, messages without secrets, source whose approval is missing) of a run with ``errors`` of (window, error).

    Only a failed run with a refused key is an error to a client (403); the source is shopping if one of those messages names it, else standard.
    """
    refused = [str(e).lower() for _, e in errors if isinstance(e, Unauthorized)]
    blocked = status == "failed" and bool(refused)
    source = ("shopping" if any("shopping mall" in m for m in refused) else "standard") if blocked else None
    return Unauthorized.status if blocked else 200, [SECRET.sub(r"\1[REDACTED]", str(e)) for _, e in errors], source
