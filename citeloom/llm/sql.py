"""DuckDB statements for the queries that SQL can express over whole tables."""

from __future__ import annotations

from citeloom.llm.survivorship import FILLERS

_SQUEEZE = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def squeeze(x: str) -> str:
    return _SQUEEZE.format(x)


_RECORDS = f"""
WITH e AS (
  SELECT entry_id, coalesce({squeeze("key")}, '') AS k, coalesce({squeeze("entry_type")}, '') AS t,
         list_sort(list_filter(list_transform(map_entries(fields), lambda x: struct_pack(
             n := {squeeze("x.key")}, v := {squeeze("x.value")})),
           lambda x: x.v IS NOT NULL AND x.n <> 'raw')) AS f
  FROM bib),
r AS (
  SELECT entry_id, (k, t, f) AS rec,
         len(list_filter(f, lambda x: x.n = 'title' AND x.v <> '')) > 0 AS titled
  FROM e),
g AS (
  SELECT entry_id, CASE WHEN titled THEN min(entry_id) OVER (PARTITION BY rec, titled) ELSE entry_id END AS first_id
  FROM r)
"""

def _keys(least: int) -> str:
    return _KEYS + f"""
p AS (
  SELECT x.k AS key_a, y.k AS key_b, count(*) AS n_ab
  FROM f x JOIN f y ON x.basket = y.basket AND x.k < y.k GROUP BY ALL HAVING count(*) >= {least}),
a AS (
  SELECT key_a, key_b, n_ab, na.n AS n_a, nb.n AS n_b, n_all
  FROM p JOIN n na ON na.k = key_a JOIN n nb ON nb.k = key_b CROSS JOIN total)
"""


_PAIRS = """
SELECT key_a, key_b, n_ab, n_a, n_b, n_all, round(n_ab::DOUBLE * n_all / (n_a * n_b), 6) AS lift,
       round((n_ab + 0.5::DOUBLE) * (n_all - n_a - n_b + n_ab + 0.5::DOUBLE)
             / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio
FROM a
"""

_KEYS = r"""
WITH raw AS (
  SELECT paper_id, kind, pos,
         list_filter(list_transform(citations, lambda k: regexp_replace(k, '^\s+|\s+$', '', 'g')),
                     lambda k: k IS NOT NULL AND k <> '') AS ks
  FROM sections),
b AS (
  SELECT row_number() OVER () AS basket, list_distinct(flatten(list(coalesce(ks, []::VARCHAR[])))) AS ks
  FROM raw GROUP BY paper_id, kind, pos),
total AS (SELECT count(*) AS n_all FROM b),
f AS (SELECT basket, unnest(ks) AS k FROM b),
n AS (SELECT k, count(*) AS n FROM f GROUP BY k),
"""

_FIELD = "fields['{0}']"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _usable() -> str:
    values = {"key": "key", "entry_type": "entry_type"}
    fields = ("key", "entry_type", "title", "author", "year", "journal", "doi", "pages")
    rows = " UNION ALL ".join(
        f"SELECT dup_group, version_id, verified_source, fetched_at, '{f}' AS field_name, {values.get(f, _FIELD.format(f))} AS whole, "
        f"{_TRIM.format(values.get(f, _FIELD.format(f)))} AS v FROM bib_versions WHERE dup_group IS NOT NULL"
        for f in fields
    )
    fillers = ", ".join(f"'{x}'" for x in FILLERS)
    return rf"""
WITH raw AS ({rows}),
s AS (SELECT *, {squeeze("v")} AS bare, regexp_replace(v, '[{{}}]', '', 'g') AS plain FROM raw WHERE v IS NOT NULL),
ok AS (
  SELECT * FROM s
  WHERE bare <> '' AND bare NOT IN ({fillers}) AND NOT contains(v, chr(65533))
    AND NOT regexp_matches(v, '(\.\.\.|…)[\s\]}})"'']*$')
    AND CASE field_name
      WHEN 'year' THEN regexp_matches(plain, '^[12]\d{{3}}$')
      WHEN 'doi' THEN regexp_matches(plain, '(?i)^(https?://[^/\s]+/|doi:\s*)?10\.\d{{4,9}}/\S+$')
      WHEN 'pages' THEN regexp_matches(plain, '^0*[1-9]\d*\s*[-‐-―]+\s*0*[1-9]\d*$')
      WHEN 'entry_type' THEN bare NOT IN ('misc', 'unknown', 'other')
      WHEN 'key' THEN NOT regexp_matches(plain, '^\W*[A-Za-z]{{0,5}}\W*\d{{1,3}}\W*$')
      WHEN 'author' THEN NOT regexp_matches(
        v, '(?i)(\bet[\s~]+al\b\.?|\band\s+others\b|\bet[\s~]+alii\b)[\s.\]}})"'']*$')
      ELSE true END)
"""


def _survivors() -> str:
    return _usable() + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dup_group, field_name ORDER BY
      CASE verified_source WHEN 'arXiv' THEN 2 WHEN 'DBLP' THEN 1 ELSE 0 END DESC,
      fetched_at DESC NULLS LAST, version_id) AS rn
  FROM ok)
SELECT dup_group, field_name, version_id FROM ranked WHERE rn = 1
"""


def _records() -> str:
    """All choices of DOI, title, authors and publication of each group, by brute force over its versions."""
    fields = ("key", "entry_type", "title", "author", "year", "journal", "doi", "pages")
    columns = ", ".join(f"max(whole) FILTER (field_name = '{f}') AS \"{f}\"" for f in fields)
    return _usable() + rf""",
v AS (
  SELECT dup_group, version_id, CASE verified_source WHEN 'arXiv' THEN 2 WHEN 'DBLP' THEN 1 ELSE 0 END::HUGEINT AS cls,
    coalesce(epoch_us(fetched_at), 0)::HUGEINT AS at_, {columns},
    coalesce(max(bare) FILTER (field_name = 'doi'), '') AS sd, coalesce(max(bare) FILTER (field_name = 'title'), '') AS st
  FROM ok GROUP BY ALL),
w AS (SELECT *, cls * 4611686018427387904 + at_ + 1 AS t FROM v),
one AS (SELECT DISTINCT dup_group FROM v),
d AS (
  SELECT dup_group, doi, sd, t FROM (
    SELECT * FROM w WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dup_group, cls ORDER BY at_ DESC, version_id) = 1)
  UNION ALL SELECT dup_group, NULL, '', 0 FROM one),
heads AS (SELECT dup_group, list(sd) AS hs FROM d WHERE sd <> '' GROUP BY dup_group),
ti AS (
  SELECT dup_group, title, sd, st, t FROM (
    SELECT w.*, CASE WHEN sd = '' THEN '' WHEN list_contains(hs, sd) THEN sd ELSE 'other' END AS s
    FROM w LEFT JOIN heads USING (dup_group) WHERE title IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY w.dup_group, cls, s ORDER BY at_ DESC, version_id) = 1)
  UNION ALL SELECT dup_group, NULL, '', '', 0 FROM one),
dt AS (
  SELECT dup_group, row_number() OVER () AS choice, doi, title, d.sd AS d_sd, ti.st AS t_st, (d.t > 0)::HUGEINT + (ti.t > 0)::HUGEINT AS n, d.t + ti.t AS t
  FROM d JOIN ti USING (dup_group) WHERE ti.sd = '' OR d.sd = '' OR ti.sd = d.sd),
a AS (
  SELECT choice, arg_max(w.author, w.t) AS author, max(w.t) AS t FROM dt JOIN w USING (dup_group)
  WHERE w.author IS NOT NULL AND (w.st = '' OR t_st = '' OR w.st = t_st) GROUP BY choice),
p AS (
  SELECT choice, arg_max(struct_pack(j := w.journal, y := w.year, p := w.pages), (k, w.t)) AS pub, max(k) AS k, arg_max(w.t, (k, w.t)) AS t
  FROM (SELECT *, ((journal IS NOT NULL)::INT + (year IS NOT NULL)::INT + (pages IS NOT NULL)::INT)::HUGEINT AS k FROM w) w JOIN dt USING (dup_group)
  WHERE k > 0 AND (w.journal IS NULL OR w.sd = '' OR d_sd = '' OR w.sd = d_sd) GROUP BY choice),
best AS (
  SELECT dup_group, arg_max(struct_pack(doi := doi, title := title, author := a.author, pub := pub),
    ((dt.n + (a.t IS NOT NULL)::INT + coalesce(p.k, 0)), (dt.t + coalesce(a.t, 0) + coalesce(p.t, 0)))) AS b
  FROM dt LEFT JOIN a USING (choice) LEFT JOIN p USING (choice) GROUP BY dup_group),
ke AS (
  SELECT dup_group, arg_max(key, t) FILTER (key IS NOT NULL) AS key, arg_max(entry_type, t) FILTER (entry_type IS NOT NULL) AS entry_type
  FROM w GROUP BY dup_group)
SELECT dup_group, ke.key, ke.entry_type, b.title, b.author, b.pub.j AS journal, b.pub.y AS year, b.pub.p AS pages, b.doi
FROM best JOIN ke USING (dup_group)
"""


# Runs of nine words shared by a document and an item lead to diagonals; on each, a passage may run over replaced words (gaps) as long as
# neighbouring ones are ten apart, so it lies between the first gap of one pair that is too close and the second gap of the next such pair.
_LEAKS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '(?m)^@@ [^\n]*?@@[^\n]*$', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text <> ''),
i AS (
  SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '(?m)^@@ [^\n]*?@@[^\n]*$', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
ig AS (SELECT item_id, j, array_to_string(w[j:j + 8], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 7)) AS j FROM i)),
dg AS (SELECT doc_id, k, array_to_string(w[k:k + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 7)) AS k FROM d)),
diagonal AS (SELECT DISTINCT doc_id, item_id, k - j AS shift FROM dg JOIN ig USING (g)),
cell AS (
  SELECT doc_id, item_id, shift, j, dw[j + shift] = iw[j] AS same FROM (
    SELECT doc_id, item_id, shift, d.w AS dw, i.w AS iw, unnest(range(greatest(1, 1 - shift), least(len(i.w), len(d.w) - shift) + 1)) AS j
    FROM diagonal JOIN d USING (doc_id) JOIN i USING (item_id))),
gap AS (SELECT doc_id, item_id, shift, j, lag(j) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS last FROM cell WHERE NOT same),
clash AS (SELECT * FROM gap WHERE j - last < 10),
opening AS (
  SELECT doc_id, item_id, shift, last + 1 AS a FROM clash
  UNION ALL SELECT doc_id, item_id, shift, min(j) FROM cell GROUP BY ALL),
closing AS (
  SELECT doc_id, item_id, shift, j - 1 AS b FROM clash
  UNION ALL SELECT doc_id, item_id, shift, max(j) FROM cell GROUP BY ALL),
span AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY a) AS n FROM opening)
  JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY b) AS n FROM closing) USING (doc_id, item_id, shift, n))
SELECT DISTINCT doc_id, item_id FROM (
  SELECT doc_id, item_id, shift, n, max(j) - min(j) + 1 AS words FROM span JOIN cell USING (doc_id, item_id, shift)
  WHERE same AND j BETWEEN a AND b GROUP BY ALL)
WHERE words >= 20
"""

SQL: dict[str, str] = {
    "p2_found": _survivors(),
    "p2_records": _records(),
    "p3_found": r"""
SELECT section_id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '\s+'), lambda w: length(w))) > 4000
                        THEN 'forced' ELSE 'clean' END AS cut
FROM sections WHERE length(content) > 4000
""",
    "p3_rejoined": "SELECT section_id, md5(content) AS content_md5, true AS fits, true AS laps FROM sections WHERE content IS NOT NULL",
    "p7_placed": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p8_found": _LEAKS,
    "p5_found": _RECORDS + "SELECT first_id, entry_id FROM g WHERE first_id <> entry_id",
    "p5_records": _RECORDS + "SELECT first_id AS entry_id, count(*) AS copies FROM g GROUP BY first_id",
    "p6_found": _keys(5) + "SELECT key_a, key_b FROM a WHERE n_ab::HUGEINT * n_all >= 5 * n_a::HUGEINT * n_b",
    "p6_associations": _keys(5) + _PAIRS,
    "p6_pairs": _keys(1) + _PAIRS,
}
