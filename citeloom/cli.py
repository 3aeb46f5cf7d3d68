"""Command line: ``python -m citeloom.cli -p ID [ID ...] [--mirror FOLDER] [--arxiv TABLE] [--dblp TABLE] [-o OUTPUT]``."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from citeloom.api import extract_survey
from citeloom.config import Options
from citeloom.errors import ExtractError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="citeloom", description="Survey text and BibTeX of papers.")
    p.add_argument("-p", "--paper-ids", nargs="+", action="extend", required=True, metavar="ID")
    p.add_argument("-o", "--output", help="writes OUTPUT.tex and OUTPUT.bib instead of printing")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--mirror", help="folder of archives named by id; without it they are downloaded")
    p.add_argument("--arxiv", help="parquet table (arxiv_id, bibtex); without it it is downloaded")
    p.add_argument("--dblp", help="parquet table of answers (query, json) or records (hit_id, info); without it DBLP is asked")
    p.add_argument("--offline", action="store_true", help="download nothing: entries without a table to verify them stay as they are")
    p.add_argument("--permissive", action="store_true", help="papers that fail do not stop the others")
    return p


def options_of(a: argparse.Namespace) -> Options:
    given = {"mirror": a.mirror, "arxiv_table": a.arxiv, "dblp_table": a.dblp, "offline": a.offline, "permissive": a.permissive}
    return Options(**{k: v for k, v in given.items() if v})


def write_outputs(result: dict[str, str], output: str | None) -> None:
    if output:
        Path(output).with_suffix(".tex").write_text(result["survey_text"], encoding="utf-8")
        Path(output).with_suffix(".bib").write_text(result["bibtex"], encoding="utf-8")
    else:
        print(f"--- survey.tex ---\n{result['survey_text']}")
        print(f"--- bibliography.bib ---\n{result['bibtex']}")


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING)
    try:
        write_outputs(extract_survey(a.paper_ids, options_of(a)), a.output)
    except ExtractError as cause:
        logging.error("%s", cause)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
