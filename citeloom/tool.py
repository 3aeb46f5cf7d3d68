"""One-paper tool function for agent servers; ``python -m citeloom.tool`` serves it over standard input."""

from __future__ import annotations

from collections.abc import Callable

from citeloom.api import extract_survey

Extract = Callable[[list[str]], dict[str, str]]


def survey_message(paper_id: str, extract: Extract = extract_survey) -> str:
    """Related work and bibliography of one paper as text; any failure becomes a message."""
    try:
        result = extract([paper_id])
    except Exception as cause:  # noqa: BLE001 - the caller wants text
        return f"Error processing arXiv paper {paper_id}: {cause}"
    return f"Related work:\n{result['survey_text']}\n\nBibliography:\n{result['bibtex']}"


def serve(extract: Extract = extract_survey, library=None) -> None:
    """Runs the tool as an MCP server; ``library`` is FastMCP's class, by default the installed one."""
    if library is None:
        from fastmcp import FastMCP as library  # an optional dependency

    server = library("Related work and bibliography of papers")

    @server.tool(name="arvix_survey", description="Related work and bibliography of one paper")
    def arvix_survey(arvix_id: str) -> str:
        return survey_message(arvix_id, extract)

    server.run()


if __name__ == "__main__":
    serve()
