"""Online sources. Off unless called; every fetcher takes its HTTP function, so tests need no network."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from citeloom.config import Options
from citeloom.errors import ApiError, ExtractError, NetworkError

# The retry schedule, in seconds.
FIRST_WAIT, LONGEST_WAIT, GROWTH = 0.1, 5.0, 1.5
Get = Callable[[str], bytes]


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310 - https by configuration
        return r.read()


def retried(action: Callable[[], object], budget: float, sleep: Callable[[float], None] = time.sleep) -> object | None:
    """Result of ``action``, tried again with growing waits until ``budget`` seconds are used up; then None."""
    waited, wait = 0.0, FIRST_WAIT
    while True:
        try:
            return action()
        except Exception:  # noqa: BLE001 - every failure counts as passing
            pause = wait * random.uniform(0.5, 1.5)  # noqa: S311
            if waited + pause > budget:
                return None
            sleep(pause)
            waited += pause
            wait = min(LONGEST_WAIT, wait * GROWTH)


def fetch_archive(paper_id: str, options: Options, get: Get = http_get) -> bytes:
    """A paper's source archive; one attempt, any failure and an empty body are errors."""
    url = f"{options.arxiv_base_url}/e-print/{paper_id}"
    body = _once(url, paper_id, get)
    if not body:
        raise ApiError(f"Empty response for {paper_id}")
    return body


def _once(url: str, what: str, get: Get) -> bytes:
    try:
        return get(url)
    except urllib.error.HTTPError as cause:
        raise ApiError(f"Failed to download {what}: HTTP {cause.code}") from cause
    except OSError as cause:  # no answer at all
        raise NetworkError(f"{what}: {cause}") from cause


def fetch_metadata(paper_id: str, options: Options, get: Get = http_get) -> str | None:
    """arXiv's description of a paper; one attempt. A failure is an error, or None with ``permissive``."""
    try:
        return _once(f"{options.arxiv_base_url}/bibtex/{paper_id}", f"BibTeX of {paper_id}", get).decode("utf-8", "replace")
    except ExtractError:
        if options.permissive:
            return None
        raise


def fetch_bibtex(arxiv_id: str, options: Options, get: Get = http_get, sleep=time.sleep) -> str | None:
    """arXiv's BibTeX of a paper, None once the retries are used up or where the answer is no entry (which is not asked for again)."""

    def once() -> str:
        return get(f"{options.arxiv_base_url}/bibtex/{arxiv_id}").decode("utf-8")

    text = retried(once, options.api_timeout_secs, sleep)
    return text if text is not None and all(x in text for x in ("@", "author", "title")) else None


def fetch_dblp(query: str | None, options: Options, get: Get = http_get, sleep=time.sleep) -> str | None:
    """DBLP's JSON answer to a search (``dblp_query`` of a title), None without one, without hits and once the retries are used up."""
    if not query:
        return None

    def once() -> tuple[str, object]:
        text = get(f"{options.dblp_base_url}/search/publ/api?q={urllib.parse.quote(query, safe='+')}&format=json").decode("utf-8")
        return text, json.loads(text)

    answer = retried(once, options.api_timeout_secs, sleep)
    if answer is None:
        return None
    try:
        hits = answer[1]["result"]["hits"]
        return answer[0] if int(hits["@total"]) > 0 and hits["hit"] else None
    except (KeyError, TypeError, ValueError):
        return None


def _fetched(df: DataFrame, key: str, value: str, kind: str, fetch: Callable[[str], object], tasks: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], value: [fetch(k) for k in pdf[key]]})

    field = df.schema[key].dataType.simpleString()
    # As many tasks as requests may be in flight: each asks for its share one after the other.
    return df.select(key).distinct().repartition(tasks, key).mapInPandas(run, f"{key} {field}, {value} {kind}")


def archives(papers: DataFrame, options: Options, get: Get = http_get) -> DataFrame:
    """(paper_id, content) of the papers' archives, one download each."""
    return _fetched(papers, "paper_id", "content", "binary", lambda p: fetch_archive(p, options, get), options.requests)


def bibtex(ids: DataFrame, options: Options, get: Get = http_get) -> DataFrame:
    """``arxiv`` rows (arxiv_id, bibtex); write them as a table, so that no id is asked for twice."""
    return _fetched(ids, "arxiv_id", "bibtex", "string", lambda i: fetch_bibtex(i, options, get), options.requests)


def metadata(ids: DataFrame, options: Options, get: Get = http_get) -> DataFrame:
    """(arxiv_id, bibtex) of the papers themselves."""
    return _fetched(ids, "arxiv_id", "bibtex", "string", lambda i: fetch_metadata(i, options, get), options.requests)


def dblp(queries: DataFrame, options: Options, get: Get = http_get) -> DataFrame:
    """(query, json) answers for distinct searches."""
    return _fetched(queries, "query", "json", "string", lambda q: fetch_dblp(q, options, get), options.requests)
