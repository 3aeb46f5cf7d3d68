"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

PAPERS_IN = "ord INT, paper_id STRING"
PAPERS = "ord INT, paper_id STRING, title STRING, authors STRING"
FILES = "ord INT, paper_id STRING, path STRING, content STRING"
ARCHIVES = "ord INT, paper_id STRING, content BINARY"
SECTIONS = (
    "ord INT, paper_id STRING, kind STRING, pos INT, title STRING, content STRING, citations ARRAY<STRING>"
)
BIB = "ord INT, file_ord INT, pos INT, key STRING, entry_type STRING, fields MAP<STRING,STRING>"
DBLP_INFO = (
    "STRUCT<title: STRING, year: STRING, venue: STRING, url: STRING, volume: STRING, doi: STRING, "
    "authors: STRUCT<author: ARRAY<STRUCT<text: STRING>>>>"
)
DBLP = f"key STRING, hit_pos INT, info {DBLP_INFO}"
DBLP_RESPONSE = f"STRUCT<result: STRUCT<hits: STRUCT<`@total`: STRING, hit: ARRAY<STRUCT<info: {DBLP_INFO}>>>>>"
ARXIV = "arxiv_id STRING, bibtex STRING"
OUTPUT = "survey_text STRING, bibtex STRING"
