"""DuckDB statements that give the same rows as ``queries``."""

from __future__ import annotations

from citeloom.functions import bbl, text

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def clean(x: str) -> str:
    spaced = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\s\x{{A0}}]', ' ', 'g')"
    words = f"list_filter(regexp_split_to_array({spaced}, '{_WS}+'), lambda w: w <> '')"
    return f"lower(coalesce(array_to_string({words}, '_'), ''))"


def clean_title(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^[[:punct:]\s]+|[[:punct:]\s]+$', '', 'g')"


def norm_key(author: str, title: str, year: str) -> str:
    first = f"CASE WHEN contains({author}, ',') THEN split_part({author}, ',', 1) ELSE split_part({author}, ' and ', 1) END"
    head = trim(f"split_part({first}, 'et al', 1)")
    words = f"list_filter(string_split({clean(title)}, '_'), lambda w: strlen(w) > 3)[1:3]"
    return f"""array_to_string(list_concat(list_concat(
      [CASE WHEN {author} IS NULL THEN 'unknown' ELSE list_last(string_split({clean(head)}, '_')) END],
      CASE WHEN {title} IS NULL THEN []::VARCHAR[] ELSE {words} END),
      CASE WHEN {year} IS NOT NULL AND {clean(year)} <> '' THEN [{clean(year)}] ELSE []::VARCHAR[] END), '_')"""


def nonempty(x: str) -> str:
    return f"nullif({x}, '')"


_F = "fields['{}']"
AUTHOR, TITLE, YEAR, RAW = (_F.format(x) for x in ("author", "title", "year", "raw"))
_KEY = norm_key(AUTHOR, TITLE, YEAR)

_ARXIV = "coalesce(" + ", ".join(
    nonempty(rf"regexp_extract({_F.format(f)}, 'arXiv:?{_WS}*([0-9]+\.[0-9]+)', 1)") for f in ("title", "journal", "note", "raw")
) + r", nullif(regexp_extract(key, '^([0-9]{4}\.[0-9]+)$', 1), ''))"

_CITE = text.cite_pattern()
_PHRASES = "|".join(text.RELATED_PHRASES)


def keys_of(x: str) -> str:
    groups = f"regexp_extract_all({x}, '{_CITE}', 1)"
    split = f"flatten(list_transform({groups}, lambda g: list_transform(string_split(g, ','), lambda k: {trim('k')})))"
    return f"list_sort(list_distinct({split}))"


_LAST = "SELECT * FROM bib QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC, file_ord DESC, pos DESC, entry_id DESC) = 1"

_QUOTED = bbl.QUOTED.replace("'", "''")
# One item: the title by its three rules, the author by its two.
_ITEM_TITLE = rf"""CASE
  WHEN regexp_extract(raw, '{bbl.ARTICLE_TITLE}', 1) <> '' THEN regexp_extract(raw, '{bbl.ARTICLE_TITLE}', 1)
  WHEN contains(raw, '\newblock') THEN list_filter(list_transform(string_split(raw, '\newblock'), lambda b: {trim('b')}), lambda b: b <> '')[2]
  ELSE nullif(regexp_extract(raw, '{_QUOTED}', 1), '') END"""
_PERSONS = r"array_to_string(regexp_extract_all(regexp_extract(raw, '\\bibfield\{author\}\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)', 1), 'PERSON', 1), ', ')".replace("PERSON", bbl.PERSON)
_LINE = trim("string_split(raw, chr(10))[2]")
_ITEM_AUTHOR = f"""CASE WHEN contains(raw, '\\bibfield{{author}}') THEN {nonempty(_PERSONS)}
  ELSE {trim(f"CASE WHEN contains({_LINE}, 'et al.') THEN split_part({_LINE}, 'et al.', 1) ELSE split_part({_LINE}, 'et~al.', 1) END")} END"""
_ONE_LINE = rf"regexp_replace({RAW}, '\\bibitem(\[[^\]]*\])?%\s*\n\s*', '\\bibitem\1')"
_ITEM = "^" + bbl.ITEM_HEAD

_ITEMS = f"""
SELECT * FROM (SELECT entry_id, {trim(_ONE_LINE)} AS raw FROM bib WHERE {RAW} IS NOT NULL)
WHERE regexp_matches(raw, '{_ITEM}')
"""

_DOCS = r"""
SELECT ord, paper_id, string_agg('\' || kind || '{' || coalesce(title, '') || '}' || chr(10) || content || chr(10) || chr(10), ''
                                 ORDER BY pos, section_id) AS latex
FROM sections WHERE content IS NOT NULL GROUP BY ord, paper_id
"""


def _parts(kind: str) -> str:
    return rf"""
SELECT ord, '{kind}' AS kind, unnest(range(len(ps))) AS pos, unnest(ps) AS part
FROM (SELECT ord, string_split(latex, '\{kind}')[2:] AS ps FROM docs)
"""


_HEAD = "^" + _WS + r"*\{([^}]*)\}"

_SECTIONS = rf"""
WITH docs AS ({_DOCS}), parts AS ({_parts('section')} UNION ALL {_parts('subsection')}),
t AS (SELECT *, {trim(f"regexp_extract(part, '{_HEAD}', 1)")} AS title,
             {trim(f"regexp_replace(part, '{_HEAD}', '')")} AS content FROM parts)
SELECT ord, kind, pos::INTEGER AS pos, title, md5(content) AS content_md5, array_to_string({keys_of('content')}, '|') AS citations
FROM t WHERE regexp_matches(lower(title), '{_PHRASES}')
"""


def _rewriting(sections: str) -> str:
    return rf"""uses AS (
  SELECT section_id, unnest(range(len(old))) AS at_, unnest(old) AS old, unnest(inn) AS inn
  FROM (SELECT section_id, regexp_extract_all(content, '{_CITE}', 0) AS old, regexp_extract_all(content, '{_CITE}', 1) AS inn FROM {sections})),
k AS (
  SELECT section_id, at_, old, unnest(range(len(string_split(inn, ',')))) AS n, {trim("unnest(string_split(inn, ','))")} AS key FROM uses),
m AS (
  SELECT section_id, at_, old, split_part(old, '{{', 1) || '{{' || string_agg(coalesce(new, k.key), ', ' ORDER BY n) || '}}' AS text
  FROM k LEFT JOIN keys USING (key) GROUP BY section_id, at_, old),
swaps AS (
  SELECT section_id, list(struct_pack(a := old, b := text) ORDER BY at_) AS s FROM m GROUP BY section_id),
"""


_FOLDED = """CASE WHEN s IS NULL THEN content ELSE
  list_reduce(list_prepend(struct_pack(a := content, b := ''), s), lambda x, y: struct_pack(a := replace(x.a, y.a, y.b), b := '')).a END"""
_REWRITE = rf"""
WITH last AS ({_LAST}),
keys AS (SELECT key, {_KEY} AS new FROM last WHERE key IS NOT NULL),
{_rewriting('sections')}
done AS (SELECT section_id, md5({_FOLDED}) AS normalized_md5 FROM sections LEFT JOIN swaps USING (section_id))
SELECT * FROM done
"""

_AUTHORS = (
    "list_filter(list_transform(info.authors.author, lambda aa: aa.text), lambda tt: tt IS NOT NULL)"
)
_PLAIN_AUTHORS = rf"array_to_string(list_transform({_AUTHORS}, lambda n: regexp_replace(n, '\s+\p{{N}}+$', '')), ' and ')"


def word_set(title: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({clean(title)}, '_'), lambda w: w <> '')))"


def shared(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda w: list_contains({b}, w)))"


def words(x: str, sep: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{sep}'), lambda w: w <> '')"


_SCORE = f"""(CASE WHEN y = info.year THEN 1 ELSE 0 END
     + CASE WHEN t = h THEN 3 WHEN contains(t, h) OR contains(h, t) THEN 2
            WHEN {shared(words('t', _WS + '+'), words('h', _WS + '+'))} > 2 THEN 1 ELSE 0 END
     + CASE WHEN {shared(words('a', '[ ~]'), words('names', '[ ~]'))} >= 5 THEN 2 ELSE 0 END)"""

_MATCH = rf"""
ents AS (SELECT entry_id, fields, {_ARXIV} AS arxiv_id, {word_set(TITLE)} AS ws FROM bib),
hits AS (SELECT hit_id, info, {word_set('info.title')} AS hs FROM dblp),
able AS (SELECT * FROM ents WHERE {TITLE} IS NOT NULL AND {YEAR} IS NOT NULL AND {AUTHOR} IS NOT NULL AND len(ws) > 0),
near AS (
  SELECT ws, hs FROM (SELECT DISTINCT ws FROM able) a JOIN (SELECT DISTINCT hs FROM hits WHERE len(hs) > 0) b
  ON 3 * len(list_intersect(ws, hs)) >= len(ws) + len(hs)),
pairs AS (
  SELECT entry_id, hit_id, info, arxiv_id, {YEAR} AS y, {AUTHOR} AS a, replace(replace(lower({TITLE}), '{{', ''), '}}', '') AS t,
         lower(info.title) AS h, array_to_string({_AUTHORS}, ' and ') AS names
  FROM able JOIN near USING (ws) JOIN hits USING (hs)),
scored AS (
  SELECT entry_id, hit_id, info, arxiv_id, (info.title IS NULL OR info.year IS NULL) AS broken,
    {_SCORE} AS score
  FROM pairs),
best AS (
  SELECT entry_id, arg_max(struct_pack(i := info, s := score), (score, -hit_id)) AS b, bool_or(broken) AS broken
  FROM scored GROUP BY entry_id)
"""

_ANSWERS = rf"""
named AS (SELECT entry_id, {_ARXIV} AS arxiv_id, {TITLE} AS t, {AUTHOR} AS a, {YEAR} AS y FROM bib),
answers AS (
  SELECT arxiv_id, trim_(t) AS t, trim_(a) AS a, coalesce(regexp_extract(y, '\d{{4}}'), '') AS y FROM (
    SELECT arxiv_id, arg_max(struct_pack(t := t, a := a, y := y), entry_id) AS e FROM named
    WHERE arxiv_id IS NOT NULL AND t IS NOT NULL AND a IS NOT NULL GROUP BY arxiv_id), LATERAL (SELECT e.t AS t, e.a AS a, e.y AS y))
""".replace("trim_(", "strip(")
_ANSWERS = _ANSWERS.replace("strip(t)", "translate(t, '{}\\\"', '')").replace("strip(a)", "translate(a, '{}\\\"', '')")

_VERIFIED = rf"""
WITH {_ANSWERS}, {_MATCH},
merged AS (
  SELECT e.entry_id, x.arxiv_id IS NOT NULL AS by_arxiv, x.arxiv_id IS NULL AND NOT coalesce(m.broken, true) AND m.b.s >= 2 AS by_dblp,
    x.t, x.a, x.y, m.b.i AS info, e.fields
  FROM ents e LEFT JOIN answers x USING (arxiv_id) LEFT JOIN best m ON m.entry_id = e.entry_id),
v AS (
  SELECT entry_id, by_arxiv OR by_dblp AS verified,
    CASE WHEN by_arxiv THEN 'arXiv' WHEN by_dblp THEN 'DBLP' ELSE fields['verified_source'] END AS source,
    CASE WHEN by_arxiv THEN t WHEN by_dblp THEN info.title ELSE {TITLE} END AS title,
    CASE WHEN by_arxiv THEN a WHEN by_dblp AND len({_AUTHORS}) > 0 THEN {_PLAIN_AUTHORS} ELSE {AUTHOR} END AS author,
    CASE WHEN by_arxiv THEN y WHEN by_dblp THEN info.year ELSE {YEAR} END AS year,
    CASE WHEN by_dblp THEN coalesce(info.venue, fields['booktitle']) ELSE fields['booktitle'] END AS booktitle,
    CASE WHEN by_dblp THEN coalesce(info.doi, fields['doi']) ELSE fields['doi'] END AS doi
  FROM merged)
"""

_LAST_PAPERS = """
SELECT ord, paper_id, p.t AS title, p.a AS authors FROM (
  SELECT ord, paper_id, arg_max(struct_pack(t := title, a := authors), (loaded_at, fetched_at)) AS p FROM papers GROUP BY ord, paper_id)
"""


def cut(x: str, limit: int) -> str:
    """Texts over ``limit`` bytes keep whole characters of ``limit - 3`` bytes."""
    heads = f"list_filter(list_transform(range(0, {limit - 2}), lambda n: left({x}, n)), lambda h: strlen(h) <= {limit - 3})"
    return f"CASE WHEN strlen({x}) > {limit} THEN list_max({heads}) || '...' ELSE {x} END"


def described(field: str, default: str) -> str:
    """The value as a BibTeX text holds it: up to a closing brace, trimmed."""
    value = trim(f"split_part({field}, '}}', 1)")
    return f"coalesce({cut(value, 100)}, '{default}')"


_QUERY = f"replace(replace(replace(replace({TITLE}, '{{', ''), '}}', ''), '*', ''), ' ', '+')"
_QUERY_TEXT = clean("replace(query, '+', ' ')")
_BY_SEARCH = rf"""
WITH {_ANSWERS},
last AS (
  SELECT ord, key, fields, {_ARXIV} AS arxiv_id, {_QUERY} AS query FROM bib
  QUALIFY row_number() OVER (PARTITION BY ord, key ORDER BY file_ord DESC, pos DESC, entry_id DESC) = 1),
hits AS (SELECT hit_id, info, {clean('info.title')} AS t_clean FROM dblp),
ents AS (SELECT *, row_number() OVER () AS entry_id, {_QUERY_TEXT} AS t_clean FROM last),
pairs AS (
  SELECT e.entry_id, h.hit_id, h.info, {YEAR} AS y, {AUTHOR} AS a, replace(replace(lower({TITLE}), '{{', ''), '}}', '') AS t,
         lower(info.title) AS h, array_to_string({_AUTHORS}, ' and ') AS names, length(query) % 2 = 0 AS void
  FROM ents e JOIN hits h USING (t_clean)
  WHERE e.t_clean <> '' AND {TITLE} IS NOT NULL AND {YEAR} IS NOT NULL AND {AUTHOR} IS NOT NULL),
scored AS (
  SELECT entry_id, hit_id, info, void OR info.title IS NULL OR info.year IS NULL AS broken, {_SCORE} AS score FROM pairs),
best AS (
  SELECT entry_id, arg_max(struct_pack(i := info, s := score), (score, -hit_id)) AS b, bool_or(broken) AS broken FROM scored GROUP BY entry_id),
m AS (
  SELECT e.*, x.arxiv_id IS NOT NULL AS by_arxiv, x.arxiv_id IS NULL AND NOT coalesce(b.broken, true) AND b.b.s >= 2 AS by_dblp, x.t, x.y, b.b.i AS info
  FROM ents e LEFT JOIN answers x USING (arxiv_id) LEFT JOIN best b USING (entry_id))
SELECT ord, key, by_arxiv OR by_dblp AS verified,
  CASE WHEN by_arxiv THEN 'arXiv' WHEN by_dblp THEN 'DBLP' ELSE fields['verified_source'] END AS source,
  CASE WHEN by_arxiv THEN t WHEN by_dblp THEN info.title ELSE {TITLE} END AS title,
  CASE WHEN by_arxiv THEN y WHEN by_dblp THEN info.year ELSE {YEAR} END AS year
FROM m
"""

_PIPELINE = rf"""
WITH docs AS (
  SELECT ord, paper_id, '\documentclass{{article}}' || chr(10) || string_agg('\' || kind || '{{' || coalesce(title, '') || '}}' || chr(10) || content, chr(10)
    ORDER BY pos, section_id) AS latex
  FROM sections WHERE content IS NOT NULL GROUP BY ord, paper_id),
parts AS ({_parts('section')} UNION ALL {_parts('subsection')}),
found AS (
  SELECT row_number() OVER () AS section_id, * FROM (
    SELECT *, {trim(f"regexp_extract(part, '{_HEAD}', 1)")} AS title, {trim(f"regexp_replace(part, '{_HEAD}', '')")} AS content FROM parts)
  WHERE regexp_matches(lower(title), '{_PHRASES}')),
items AS (
  SELECT entry_id, regexp_extract(raw, '{_ITEM}', 1) AS key, {_ITEM_AUTHOR} AS author,
    nullif(regexp_extract(raw, '{bbl.YEAR}', 1), '') AS year, {clean_title(_ITEM_TITLE)} AS title
  FROM ({_ITEMS})),
last AS (
  SELECT i.* FROM items i JOIN bib b USING (entry_id) WHERE b.ord IN (SELECT ord FROM docs)
  QUALIFY row_number() OVER (PARTITION BY i.key ORDER BY ord DESC, file_ord DESC, pos DESC, entry_id DESC) = 1),
keys AS (SELECT key, {norm_key('author', 'title', 'year')} AS new FROM last),
{_rewriting('found')}
normal AS (SELECT f.*, {_FOLDED} AS normalized FROM found f LEFT JOIN swaps USING (section_id)),
body AS (
  SELECT ord, string_agg('\section{{' || title || '}}' || chr(10) || chr(10) || normalized || chr(10) || chr(10), ''
    ORDER BY CASE kind WHEN 'section' THEN 0 ELSE 1 END, pos) AS body FROM normal GROUP BY ord),
told AS ({_LAST_PAPERS}),
r AS (
  SELECT d.ord, d.paper_id, '% Paper ID: ' || d.paper_id || chr(10) || '% Title: ' || {described('title', 'Unknown Title')} || chr(10)
    || '% Authors: ' || {described('authors', 'Unknown Authors')} || chr(10) || chr(10) || coalesce(body, '') AS part
  FROM docs d LEFT JOIN told USING (paper_id) LEFT JOIN body ON body.ord = d.ord)
SELECT ord, paper_id, md5(part) AS part_md5, length(part)::INTEGER AS size FROM r
"""

SQL: dict[str, str] = {
    "clean_titles": f"SELECT entry_id, {clean(TITLE)} AS clean, {clean_title(TITLE)} AS title FROM bib WHERE {TITLE} IS NOT NULL",
    "norm_citation_key": f"SELECT entry_id, {_KEY} AS normalized_key FROM bib",
    "arxiv_id_extract": f"SELECT * FROM (SELECT entry_id, {_ARXIV} AS arxiv_id FROM bib) WHERE arxiv_id IS NOT NULL",
    "parse_bbl_entries": f"""
SELECT entry_id, regexp_extract(raw, '{_ITEM}', 1) AS key, {_ITEM_AUTHOR} AS author,
       nullif(regexp_extract(raw, '{bbl.YEAR}', 1), '') AS year, {clean_title(_ITEM_TITLE)} AS title
FROM ({_ITEMS})
""",
    "parse_bbl_files": f"""
SELECT ord, file_ord, (row_number() OVER (PARTITION BY ord, file_ord ORDER BY b.pos, b.entry_id) - 1)::INTEGER AS pos,
       regexp_extract(i.raw, '{_ITEM}', 1) AS key, nullif(regexp_extract(i.raw, '{bbl.YEAR}', 1), '') AS year
FROM bib b JOIN ({_ITEMS}) i USING (entry_id)
""",
    "bib_consolidate": f"SELECT key, entry_id, ord, entry_type, {TITLE} AS title FROM ({_LAST})",
    "bib_consolidate_paper": """
SELECT ord, key, entry_id FROM bib
QUALIFY row_number() OVER (PARTITION BY ord, key ORDER BY file_ord DESC, pos DESC, entry_id DESC) = 1
""",
    "bib_promoted": f"""
SELECT entry_id, key, {AUTHOR} AS author, {TITLE} AS title,
  CASE WHEN {YEAR} IS NULL THEN NULL ELSE regexp_extract({YEAR}, '\\d{{4}}') END AS year,
  array_to_string(list_sort(list_filter(map_keys(fields), lambda k: k NOT IN ('author', 'title', 'year', 'raw'))), '|') AS others
FROM bib
""",
    "cite_keys_sections": f"SELECT section_id, array_to_string({keys_of('content')}, '|') AS keys FROM sections",
    "related_sections": _SECTIONS,
    "related_titles": f"""
SELECT title, count(*) AS n, coalesce(regexp_matches(lower(title), '{_PHRASES}'), false) AS related FROM sections GROUP BY title
""",
    "normalize_citations": _REWRITE,
    "missing_citations": f"""
WITH c AS (SELECT unnest({keys_of('content')}) AS key FROM sections)
SELECT key, count(*) AS n_sections FROM c WHERE key <> '' AND key NOT IN (SELECT key FROM bib WHERE key IS NOT NULL) GROUP BY key
""",
    "dblp_best_match": f"WITH {_MATCH} SELECT entry_id, b.i.url AS url, b.s AS score FROM best WHERE NOT broken AND b.s >= 2",
    "dblp_json_hits": f"""
SELECT hit_id, info.title AS title, replace(replace(replace(replace(info.title, '{{', ''), '}}', ''), '*', ''), ' ', '+') AS query,
       CASE WHEN len({_AUTHORS}) > 0 THEN {_PLAIN_AUTHORS} END AS authors
FROM dblp
""",
    "bibtex_parse": f"""
WITH {_ANSWERS} SELECT arxiv_id, arxiv_id AS key, 'misc' AS entry_type, t AS title, a AS author, y AS year FROM answers
""",
    "verify_merge": _VERIFIED + "SELECT * FROM v",
    "verify_stats": _VERIFIED
    + """SELECT count(*) AS entries, count(*) FILTER (verified) AS verified, count(*) FILTER (verified AND source = 'arXiv') AS from_arxiv,
       count(*) FILTER (verified AND source = 'DBLP') AS from_dblp FROM v""",
    "main_tex_choice": """
SELECT DISTINCT ord, paper_id, CASE ord % 3 WHEN 0 THEN 'main.tex' WHEN 1 THEN 'zz.tex' ELSE 'article.tex' END AS path
FROM sections WHERE content IS NOT NULL
""",
    "include_expand": r"""
SELECT ord, paper_id, md5(latex) AS latex_md5, length(latex)::INTEGER AS size FROM (
  SELECT ord, paper_id, '\documentclass{article}' || chr(10) || string_agg(content, chr(10) ORDER BY pos, section_id) AS latex
  FROM sections WHERE content IS NOT NULL GROUP BY ord, paper_id)
""",
    "included_files": """
SELECT ord, paper_id, string_agg('sec/s' || section_id || '.tex', '|' ORDER BY pos, section_id) AS included
FROM sections WHERE content IS NOT NULL GROUP BY ord, paper_id
""",
    "archive_files": r"""
SELECT paper_id, 'sec/s' || section_id || '.tex' AS path, md5(content) AS content_md5 FROM sections WHERE content IS NOT NULL
UNION ALL
SELECT paper_id, CASE ord % 3 WHEN 0 THEN 'main.tex' WHEN 1 THEN 'zz.tex' ELSE 'article.tex' END,
  md5('\documentclass{article}' || chr(10) || string_agg('\input{sec/s' || section_id || '}', chr(10) ORDER BY pos, section_id))
FROM sections WHERE content IS NOT NULL GROUP BY ord, paper_id
""",
    "described_papers": f"""
SELECT ord, paper_id, CASE WHEN ord % 2 = 0 THEN 'Unknown Title' ELSE {described('title', 'Unknown Title')} END AS title,
  CASE WHEN ord % 2 = 0 THEN 'Unknown Authors' ELSE {described('authors', 'Unknown Authors')} END AS authors, ord % 2 = 1 AS described
FROM ({_LAST_PAPERS})
""",
    "verify_by_search": _BY_SEARCH,
    "survey_pipeline": _PIPELINE,
    "bib_lookup": "SELECT entry_id, ord, entry_type FROM bib WHERE key = 'b1'",
    "bbl_scan": r"""
WITH f AS (SELECT DISTINCT ord, paper_id, regexp_replace('sec/s' || section_id || '.tex', '\d\.tex$', '.bbl') AS path
  FROM sections WHERE content IS NOT NULL AND ord % 5 <> 0)
SELECT ord, paper_id, (row_number() OVER (PARTITION BY ord ORDER BY path) - 1)::INTEGER AS file_ord, path FROM f
""",
    "bibtex_render": f"""
SELECT key, normalized_key, '@' || coalesce(entry_type, 'article') || '{{' || normalized_key || ',' || chr(10) || coalesce(body, '') || '}}' || chr(10) || chr(10) AS bibtex
FROM (
  SELECT key, entry_type, {_KEY} AS normalized_key,
    array_to_string(list_transform(list_sort(list_filter(map_entries(fields), lambda e: e.key <> 'raw' AND e.value IS NOT NULL)),
      lambda e: '  ' || e.key || ' = {{' || replace(replace(e.value, '{{', ''), '}}', '') || '}},' || chr(10)), '') AS body
  FROM ({_LAST}))
""",
    "survey_render": r"""
WITH s AS (
  SELECT ord, kind, pos, arg_max(struct_pack(t := title, c := content), section_id) AS s FROM sections GROUP BY ord, paper_id, kind, pos),
b AS (
  SELECT ord, string_agg('\section{' || coalesce(s.t, '') || '}' || chr(10) || chr(10) || coalesce(s.c, '') || chr(10) || chr(10), ''
                         ORDER BY CASE kind WHEN 'section' THEN 0 ELSE 1 END, pos) AS body FROM s GROUP BY ord),
p AS (
  SELECT ord, paper_id, arg_max(struct_pack(t := title, a := authors), (loaded_at, fetched_at)) AS p FROM papers GROUP BY ord, paper_id),
r AS (
  SELECT ord, paper_id, '% Paper ID: ' || paper_id || chr(10) || '% Title: ' || coalesce(p.t, '') || chr(10) || '% Authors: '
    || coalesce(p.a, '') || chr(10) || chr(10) || coalesce(body, '') AS part FROM p LEFT JOIN b USING (ord))
SELECT ord, paper_id, md5(part) AS part_md5, length(part)::INTEGER AS size FROM r
""",
    "paper_metadata": """
SELECT ord, paper_id, epoch_us(loaded_at) AS loaded_us,
  CASE WHEN strlen(title) > 60 THEN list_max(list_filter(list_transform(range(0, 58), lambda n: left(title, n)), lambda h: strlen(h) <= 57)) || '...'
       ELSE title END AS title
FROM papers
""",
}
