"""Options, from the environment by default."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: str) -> str:
    return os.environ.get(name) or default


@dataclass(frozen=True)
class Options:
    """Behaviour of extraction and merging; the defaults reproduce the established results.

    starred: keep ``\\section*`` and ``\\section[short]`` sections. extended_cites: also read ``\\parencite`` and its
    like. fix_label_lines: look for the author behind a label that spans lines. scope: ``global`` resolves a key over all
    papers, ``paper`` within its own. dedup_normalized: print one entry per normalised key. permissive: a paper that
    fails gets an error message instead of stopping the job. mirror: folder of archives; arxiv_table: parquet of (arxiv_id, bibtex);
    dblp_table: parquet of (query, json) answers or (hit_id, info) records; what is not given is downloaded, unless offline.
    requests: downloads in flight at a time.
    """

    arxiv_base_url: str = field(default_factory=lambda: _env("ARXIV_BASE_URL", "https://arxiv.org"))
    dblp_base_url: str = field(default_factory=lambda: _env("DBLP_BASE_URL", "https://dblp.org"))
    api_timeout_secs: float = field(default_factory=lambda: float(_env("API_TIMEOUT_SECS", "30")))
    requests: int = field(default_factory=lambda: int(_env("CITELOOM_REQUESTS", "8")))
    mirror: str = field(default_factory=lambda: _env("CITELOOM_MIRROR", ""))
    arxiv_table: str = field(default_factory=lambda: _env("CITELOOM_ARXIV", ""))
    dblp_table: str = field(default_factory=lambda: _env("CITELOOM_DBLP", ""))
    offline: bool = field(default_factory=lambda: _env("CITELOOM_OFFLINE", "") not in ("", "0"))
    starred: bool = False
    extended_cites: bool = False
    fix_label_lines: bool = False
    scope: str = "global"
    dedup_normalized: bool = False
    permissive: bool = False

    def __post_init__(self) -> None:
        if self.scope not in ("global", "paper"):
            raise ValueError("scope must be 'global' or 'paper'")
