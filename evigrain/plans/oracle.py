"""The queries of the core in SQL, written from the semantics, for an engine whose \\b and \\s are ASCII.

Words are compared after splitting at everything that is no letter, digit or underscore.
"""

from __future__ import annotations

from evigrain import lexicon as lex
from evigrain.lexicon import DEFAULT_QUESTION
from evigrain.operators.scoring import expand
from evigrain.schemas import CHECKED_FIELDS, EVIDENCE_COLUMNS, SOURCE_FIELDS, VISIBLE_COLUMNS

SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TERMS = expand(DEFAULT_QUESTION)
TEXT_COLUMNS = EVIDENCE_COLUMNS[:-1]


# A comma before the closing brace is no JSON, whatever a lenient parser makes of it.
STRICT_JSON = r"CASE WHEN NOT regexp_matches(field_sources_json, ',\s*\}\s*$') THEN try_cast(field_sources_json AS JSON) END"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{SPACE}]+', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({collapsed(x)}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z0-9-]{{1,}}'), lambda w: lower(w))"


def words(x: str) -> str:
    return rf"string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}\p{{M}}_]+')"


def bonus(low: str) -> str:
    return " + ".join(f"CASE WHEN contains({low}, {lit(p)}) THEN {b} ELSE 0 END" for p, b in lex.BONUSES.items())


def relevance(low: str, split: str, terms: list[str]) -> str:
    parts = [f"CASE WHEN contains({low}, {lit(t)}) THEN 4.0 ELSE 0 END" if " " in t else f"least(len(list_filter({split}, lambda w: w = {lit(t)})), 5) * 1.25" for t in terms]
    return f"CAST({' + '.join(parts)} + {bonus(low)} AS DOUBLE)"


def all_hits(x: str, patterns: list[str], limit: int) -> str:
    found = " || ".join(f"regexp_extract_all({x}, {lit('(?i)' + p)})" for p in patterns)
    return f"list_transform(({found})[1:{limit}], lambda h: {collapsed('h')})"


def unique_join(values: str, limit: int) -> str:
    tidy = f"list_filter(list_transform({values}, lambda v: {collapsed('v')}), lambda v: v <> '')"
    first = f"list_filter({tidy}, lambda v, i: list_position(list_transform({tidy}, lambda u: lower(u)), lower(v)) = i)"
    return f"nullif(array_to_string(({first})[1:{limit}], '; '), '')"


def names(x: str, patterns: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({x}, {lit('(?i)' + p)}) THEN {lit(n)} END" for n, p in patterns)
    return f"list_filter([{cases}], lambda n: n IS NOT NULL)"


PASSAGES = "p AS (SELECT DISTINCT passage_id, source_file, source_path, page_number, chunk_index, text FROM passage)"
PAGES = "g AS (SELECT DISTINCT * EXCLUDE (parsed_at) FROM page_document)"
ROWS = "r AS (SELECT DISTINCT row_id, " + ", ".join(f"coalesce(nullif({c}, ''), 'Not reported') AS {c}" for c in TEXT_COLUMNS) + ", query_relevance_score FROM sepsis_atlas_results)"
SCORED = f"{PASSAGES}, l AS (SELECT *, lower(coalesce(text, '')) AS low, {words('text')} AS w FROM p), s AS (SELECT * EXCLUDE (low, w), {relevance('low', 'w', TERMS)} AS score FROM l)"
_ORDER = "score DESC, source_file NULLS LAST, page_number NULLS LAST, chunk_index NULLS LAST, passage_id NULLS LAST"


def ranked(k: int) -> str:
    return f"{SCORED}, k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY {_ORDER}) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= {k})"


STUDIES = f"{ranked(8)}, c AS (SELECT source_file, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS text, string_agg(coalesce(text, ''), ' ' ORDER BY rank) AS joined FROM k GROUP BY source_file)"


def fields(x: str) -> dict[str, str]:
    akin = [n for n, _ in lex.PREDICTORS if any(t in n.lower() or n.lower() in t for t in TERMS)]
    found = names(x, lex.PREDICTORS)
    said = " OR ".join(f"contains(lower(s), {lit(w)})" for w in lex.POPULATION_WORDS)
    outcome = f"list_filter({sentences(x)}, lambda s: regexp_matches(s, {lit('(?i)' + lex.OUTCOME_SENTENCE)}))[1]"
    return {
        "population": f"nullif({collapsed(f'substring(list_filter({sentences(x)}, lambda s: {said})[1], 1, 260)')}, '')",
        "sample_size": unique_join(f"({all_hits(x, lex.SAMPLE_PATTERNS, 4)} || {all_hits(x, lex.DEATH_PATTERNS, 2)})", 5),
        "predictor": unique_join(f"(list_filter({found}, lambda n: list_contains({listed(akin)}, n)) || {found})" if akin else found, 6),
        "outcome": f"coalesce({unique_join(all_hits(x, lex.OUTCOME_PATTERNS, 3), 3)}, nullif({collapsed(f'substring({outcome}, 1, 220)')}, ''))",
        "method": unique_join(names(x, lex.METHODS), 5),
        "timing": unique_join(all_hits(x, lex.TIMING_PATTERNS, 3), 3),
        "effect_size": unique_join(all_hits(x, lex.EFFECT_PATTERNS, 6), 6),
        "performance": unique_join(all_hits(x, lex.PERFORMANCE_PATTERNS, 8), 8),
    }


def expanded(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    parts = [f"list_filter({tokens(x)}, lambda w: NOT list_contains({listed(lex.STOPWORDS)}, w))"]
    for key, more in lex.EXPANSIONS.items():
        test = f"list_contains({words(x)}, {lit(key)})" if len(key) <= 2 else f"contains({low}, {lit(key)})"
        parts.append(f"CASE WHEN {test} THEN {listed(more)} ELSE [] END")
    every = "list_distinct(" + " || ".join(parts) + ")"
    return f"CASE WHEN len({every}) > 0 THEN {every} ELSE {listed(lex.DEFAULT_TERMS)} END"


def windows(x: str) -> str:
    return f"list_transform({x}, lambda s, i: array_to_string({x}[greatest(i - 1, 1):i + 1], ' '))"


def _clean() -> str:
    lines = rf"string_split_regex(replace(coalesce(text, ''), chr(13), chr(10)), '[\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    line = stripped(r"regexp_replace(x, '[ \t]+', ' ', 'g')")
    tidy = f"array_to_string(list_transform({lines}, lambda x: {line}), chr(10))"
    glue = r"regexp_replace(replace(regexp_replace(p, '^\n+|\n+$', '', 'g'), '-' || chr(10), ''), '[ \t\n]+', ' ', 'g')"
    return f"WITH {PAGES} SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({tidy}, '\\n{{2,}}'), lambda p: {stripped(glue)}), lambda p: p <> ''), chr(10) || chr(10)) AS clean_text FROM g"


def _segment(limit: int, overlap: int, columns: str) -> str:
    units = f"flatten(list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n[{SPACE}]*\\n'), lambda x: {stripped('x')}), lambda x: x <> ''), lambda x: CASE WHEN length(x) > {limit} THEN {sentences('x')} ELSE [x] END))"
    # A fold over the units: the texts finished, the text at hand, its counted length, and whether there is one.
    whole = collapsed("a.cur")
    full = f"(a.has AND a.n + length(b.cur) + 1 > {limit})"
    tail = f"(length({whole}) > {overlap})" if overlap else "FALSE"
    step = f"""{{'out': CASE WHEN {full} AND {whole} <> '' THEN list_append(a.out, {whole}) ELSE a.out END,
      'cur': CASE WHEN {full} THEN CASE WHEN {tail} THEN right({whole}, {overlap}) || chr(10) || b.cur ELSE b.cur END WHEN a.has THEN a.cur || chr(10) || b.cur ELSE b.cur END,
      'n': CASE WHEN {full} THEN CASE WHEN {tail} THEN {overlap} ELSE 0 END ELSE a.n END + length(b.cur) + 1, 'has': TRUE}}"""
    start = "{'out': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT, 'has': FALSE}"
    fold = f"list_reduce(list_transform(u, lambda x: {{'out': []::VARCHAR[], 'cur': x, 'n': 0::BIGINT, 'has': TRUE}}), lambda a, b: {step}, {start})"
    name = "coalesce(nullif(file_name, ''), nullif(regexp_extract(file_path, '[^/]*$'), ''), 'unknown')"
    return f"""WITH {PAGES}, n AS (SELECT {name} AS source_file, page_number, coalesce(nullif(page_number, 0)::VARCHAR, nullif(page_label, ''), 'Not reported') AS page, {units} AS u FROM g),
    f AS (SELECT * EXCLUDE (u), {fold} AS a FROM n),
    o AS (SELECT * EXCLUDE (a), CASE WHEN {whole} <> '' THEN list_append(a.out, {whole}) ELSE a.out END AS parts FROM f),
    e AS (SELECT * EXCLUDE (parts), unnest(parts) AS text, unnest(range(1, len(parts) + 1))::INTEGER AS chunk_index FROM o)
    SELECT regexp_replace(source_file, '([^/])\\.[^./]*$', '\\1') || ':p' || page || ':c' || chunk_index AS passage_id, {columns} FROM e"""


def _anchor() -> str:
    f = fields("text")
    values = ", ".join(f"coalesce({f[n]}, 'Not reported') AS {n}" for n in ("predictor", "outcome", "effect_size", "performance"))
    base = "predictor || ' ' || outcome"
    terms = f"array_to_string(list_sort(list_distinct({expanded(base)} || {listed(lex.ANCHOR_TERMS)})), ' ')"
    quotes = " OR ".join(f"({v} <> 'Not reported' AND contains(lower(win), lower({v})))" for v in ("effect_size", "performance"))
    term = "list_sum([0.0] || list_transform(t, lambda x: CASE WHEN contains(x, ' ') THEN CASE WHEN contains(lower(win), x) THEN 4.0 ELSE 0 END ELSE least(CASE WHEN contains(x, '-') THEN len(regexp_extract_all(' ' || lower(win) || ' ', '[^\\p{L}\\p{N}\\p{M}_]' || x || CASE WHEN x LIKE '%-' THEN '[\\p{L}\\p{N}_]' ELSE '[^\\p{L}\\p{N}\\p{M}_]' END)) ELSE len(list_filter(ws, lambda w: w = x)) END, 5) * 1.25 END))"
    return f"""WITH {STUDIES}, v AS (SELECT source_file, joined, {values} FROM c), t0 AS (SELECT *, {terms} AS q FROM v), t1 AS (SELECT *, {expanded('q')} AS t FROM t0),
    s0 AS (SELECT *, {sentences('joined')} AS ss FROM t1), s1 AS (SELECT * EXCLUDE (ss, joined), unnest({windows('ss')}) AS win, unnest(range(1, len(ss) + 1)) AS i FROM s0),
    s2 AS (SELECT *, {words('win')} AS ws FROM s1),
    s3 AS (SELECT source_file, i, win, {term} + {bonus('lower(win)')} + CASE WHEN {quotes} THEN 5 ELSE 0 END AS score FROM s2)
    SELECT source_file, nullif({collapsed('substring(win, 1, 700)')}, '') AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, i) AS n FROM s3) WHERE n = 1"""


def _value_windows(values: str) -> str:
    """CTEs over v(source_file, joined, field, value) that end in `fa`: the best window of each value."""
    number = r"'\d+(?:\.\d+)?'"
    return f"""v AS ({values}),
    fq AS (SELECT *, regexp_extract_all(value, {number}) AS nums, list_distinct(list_filter({tokens('value')}, lambda w: length(w) > 2 AND NOT list_contains({listed(lex.STOPWORDS)}, w))[1:10]) AS ws, {sentences('joined')} AS ss FROM v WHERE value IS NOT NULL),
    f1 AS (SELECT source_file, field, value, nums, ws, unnest({windows('ss')}) AS win, unnest(range(1, len(ss) + 1)) AS i FROM fq),
    fz AS (SELECT *, len(list_filter(nums, lambda n: contains(win, n))) * 3 + len(list_filter(ws, lambda w: contains(lower(win), w))) + CASE WHEN contains(lower(win), lower(value)) THEN 8 ELSE 0 END AS score FROM f1),
    fa AS (SELECT source_file, field, nullif({collapsed('substring(win, 1, 700)')}, '') AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY source_file, field ORDER BY score DESC, i) AS n FROM fz) WHERE n = 1)"""


def _field_anchor() -> str:
    return f"""WITH {STUDIES}, {_value_windows(f"SELECT source_file, joined, 'population' AS field, {fields('text')['population']} AS value FROM c")}
    SELECT c.source_file, anchor FROM c LEFT JOIN fa USING (source_file)"""


def _every_field() -> str:
    return " UNION ALL ".join(f"SELECT source_file, joined, '{n}' AS field, {x} AS value FROM c" for n, x in fields("text").items())


def _evidence_rows() -> str:
    f = fields("text")
    made = ", ".join(f"coalesce({x}, 'Not reported') AS {n}" for n, x in f.items())
    return f"""{_anchor().rsplit('SELECT source_file, nullif', 1)[0]}, an AS (SELECT source_file, nullif{_anchor().rsplit('SELECT source_file, nullif', 1)[1]}), {_value_windows(_every_field()).replace('v AS (', 'fv AS (', 1).replace('FROM v WHERE', 'FROM fv WHERE')},
    js AS (SELECT source_file, json_group_object(field, anchor) AS field_sources_json FROM fa GROUP BY source_file),
    mp AS (SELECT k.source_file, passage_id, page_number, source_path, row_number() OVER (PARTITION BY k.source_file ORDER BY CASE WHEN contains(lower(coalesce(k.text, '')), lower(coalesce(an.anchor, ''))) THEN 0 ELSE 1 END, rank) AS n, max(score) OVER (PARTITION BY k.source_file) AS top FROM k JOIN an USING (source_file)),
    ev AS (SELECT regexp_replace(c.source_file, '([^/])\\.[^./]*$', '\\1') AS study_name, {made}, {lit(lex.FALLBACK_NOTE)} AS notes, c.source_file, coalesce(CAST(mp.page_number AS VARCHAR), 'Not reported') AS source_page, mp.passage_id AS source_passage_id,
      {_uri('mp.source_path', 'mp.page_number')} AS source_link, coalesce(an.anchor, '') AS source_anchor, coalesce(js.field_sources_json, '{{}}') AS field_sources_json, {lit(DEFAULT_QUESTION)} AS query, mp.top AS query_relevance_score
      FROM c JOIN an USING (source_file) JOIN mp ON mp.source_file = c.source_file AND mp.n = 1 LEFT JOIN js ON js.source_file = c.source_file WHERE c.text <> ''), {validated('ev')}
    SELECT {', '.join(f"coalesce(nullif({c}, ''), 'Not reported') AS {c}" for c in TEXT_COLUMNS if c not in ('field_sources_json', 'support_status', 'support_notes'))}, new_status AS support_status, new_notes AS support_notes, query_relevance_score FROM vv"""


def _anchor_passages() -> str:
    return f"""WITH {STUDIES}, v AS (SELECT source_file, coalesce({fields('text')['population']}, 'Not reported') AS quote FROM c),
    m AS (SELECT k.source_file, passage_id, row_number() OVER (PARTITION BY k.source_file ORDER BY CASE WHEN contains(lower(coalesce(text, '')), lower(quote)) THEN 0 ELSE 1 END, rank) AS n FROM k JOIN v USING (source_file))
    SELECT source_file, passage_id FROM m WHERE n = 1"""


def _uri(path: str, page: str) -> str:
    return f"CASE WHEN nullif({path}, '') IS NULL THEN 'Not reported' ELSE 'file://' || replace(url_encode({path}), '%2F', '/') || CASE WHEN coalesce({page}, 0) <> 0 THEN '#page=' || {page} ELSE '' END END"


KNOWN = "kf AS (SELECT DISTINCT file_path AS path FROM page_document WHERE file_path IS NOT NULL)"
FOLDER = "/srv/atlas/articles/"


def resolved(source: str) -> str:
    """The first of a row's five places that is a known file, as `pdf_path`."""
    link = "CASE WHEN source_link LIKE 'file://%' THEN url_decode(regexp_extract(source_link, '^file://[^/]*(/[^?#]*)', 1)) END"
    inside = lambda c: f"CASE WHEN {c} NOT IN ('', 'Not reported') THEN CASE WHEN {c} LIKE '/%' THEN {c} ELSE '{FOLDER}' || {c} END END"
    places = [link, "CASE WHEN source_file LIKE '/%' THEN source_file END", inside("source_file"), inside("study_name"), f"CASE WHEN lower(study_name) NOT LIKE '%.pdf' THEN {inside('study_name')} || '.pdf' END"]
    return f"{KNOWN}, pd AS (SELECT *, coalesce({', '.join(f'(SELECT path FROM kf WHERE path = {p})' for p in places)}) AS pdf_path FROM {source})"


_STATIC = """coalesce(nullif(substring(regexp_replace(substring(name, 1, length(name) - length(suffix)), '[^\\p{L}\\p{N}._-]', '_', 'g'), 1, 90), ''), 'source') || '-' || substring(sha1(path), 1, 12) || CASE WHEN lower(suffix) = '.pdf' THEN suffix ELSE '.pdf' END"""
_PAGE = "CASE WHEN isfinite(try_cast({0} AS DOUBLE)) AND abs(try_cast({0} AS DOUBLE)) < 2147483648 THEN CAST(trunc(try_cast({0} AS DOUBLE)) AS INTEGER) END"


def validated(source: str) -> str:
    """CTEs over `source` that end in `vv` with new_status and new_notes."""
    stop = listed([*lex.STOPWORDS, *lex.GENERIC_WORDS])
    cols = []
    for f in CHECKED_FIELDS:
        value, own = collapsed(f), collapsed(f"coalesce(nullif(CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.{f}') END, ''), anchor)")
        ws = f"list_distinct(list_filter({tokens(value)}, lambda w: length(w) > 2 AND NOT list_contains({stop}, w))[1:8])"
        nums = f"regexp_extract_all({value}, '\\d+(?:\\.\\d+)?')"
        ok = f"len(list_filter({nums}, lambda n: contains({own}, n))) > 0 OR len(list_filter({ws}, lambda w: contains(lower({own}), w))) >= least(2, greatest(1, len({ws})))"
        cols.append(f"CASE WHEN {value} <> '' AND {value} <> 'Not reported' THEN ({ok}) END AS ok_{f}")
    checked = " + ".join(f"(ok_{f} IS NOT NULL)::INT" for f in CHECKED_FIELDS)
    good = " + ".join(f"coalesce(ok_{f}, FALSE)::INT" for f in CHECKED_FIELDS)
    weak = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ok_{f} THEN '{f}' END" for f in CHECKED_FIELDS) + "], lambda x: x IS NOT NULL), ', ')"
    none = "(anchor = '' OR anchor = 'Not reported')"
    return f"""va AS (SELECT *, {collapsed('source_anchor')} AS anchor, {STRICT_JSON} AS j FROM {source}), vb AS (SELECT *, {', '.join(cols)} FROM va),
    vc AS (SELECT *, {checked} AS nc, {good} AS ng, {weak} AS weak FROM vb),
    vv AS (SELECT *, CASE WHEN {none} THEN 'unsupported' WHEN nc = 0 THEN 'needs review' WHEN ng = nc THEN 'supported' WHEN ng > 0 THEN 'partial' ELSE 'needs review' END AS new_status,
    CASE WHEN {none} THEN 'No source anchor was extracted.' WHEN nc = 0 THEN 'Only missing values were extracted.' WHEN ng = nc THEN 'All reported fields have lexical support in the source anchor.'
    WHEN ng > 0 THEN 'Review fields: ' || weak || '.' ELSE 'Reported fields were not found lexically in the source anchor.' END AS new_notes FROM vc)"""


def _relevant(source: str = "r", terms: list[str] | None = None) -> str:
    text = " || ' ' || ".join(TEXT_COLUMNS)
    return f"q0 AS (SELECT *, lower({text}) AS low, {words(text)} AS w FROM {source}), q AS (SELECT * EXCLUDE (low, w), {relevance('low', 'w', terms or TERMS)} AS relevance FROM q0), k AS (SELECT * FROM q WHERE relevance > 0 OR (SELECT max(relevance) FROM q) <= 0)"


_TIES = "study_name, predictor, source_file, source_passage_id, source_anchor, effect_size, performance"
_MISSING_CELLS = " + ".join(f"({c} = 'Not reported')::INT" for c in VISIBLE_COLUMNS)
_HIDDEN = ", ".join(f"CASE WHEN regexp_matches({c}, '(?i)mortal|death|auc|auroc|odds|hazard|regression|sepsis|septic') THEN 'Not reported' ELSE {c} END AS {c}" for c in TEXT_COLUMNS)
_F = fields("text")

ORACLE: dict[str, str] = {
    "clean_page_text": _clean(),
    "sentence_split": f"WITH {PASSAGES}, s AS (SELECT passage_id, {sentences('text')} AS ss FROM p) SELECT passage_id, unnest(range(1, len(ss) + 1)) AS sentence_no, unnest(ss) AS sentence FROM s",
    "tokenize": f"WITH {PASSAGES}, t AS (SELECT passage_id, {tokens('text')} AS t FROM p) SELECT passage_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(t[1:5], ' ') AS first_tokens FROM t",
    "segment_pages": _segment(2400, 250, "source_file, page_number, chunk_index, text"),
    "segment_small": _segment(300, 40, "chunk_index, text"),
    "expand_rows": f"WITH {ROWS}, x AS (SELECT row_id, predictor || ' ' || outcome AS q FROM r) SELECT DISTINCT row_id, array_to_string(list_sort({expanded('q')}), '|') AS terms FROM x",
    "score_passages": f"WITH {SCORED} SELECT passage_id, score FROM s",
    "retrieve_topk_per_file": f"WITH {ranked(8)} SELECT source_file, passage_id, rank, score FROM k",
    "retrieve_global_capped": f"WITH {ranked(3)} SELECT passage_id, source_file, score FROM k ORDER BY {_ORDER} LIMIT 60",
    "gate_min_score": f"WITH {ranked(8)} SELECT source_file, passage_id, rank FROM k QUALIFY max(score) OVER (PARTITION BY source_file) >= 20",
    "study_context": f"WITH {STUDIES} SELECT source_file, text FROM c",
    "extract_fields": f"WITH {STUDIES} SELECT source_file, {', '.join(f'{x} AS {n}' for n, x in _F.items())} FROM c",
    "extract_passage_fields": f"WITH {PASSAGES} SELECT passage_id, {', '.join(f'{_F[n]} AS {n}' for n in ('sample_size', 'predictor', 'outcome', 'method', 'timing', 'effect_size', 'performance'))} FROM p WHERE text IS NOT NULL",
    "sentence_window_anchor": _anchor(),
    "field_anchor": _field_anchor(),
    "anchor_passages": _anchor_passages(),
    "field_source_anchors": f"WITH {STUDIES}, {_value_windows(_every_field())} SELECT source_file, field, anchor FROM fa",
    "evidence_rows": _evidence_rows(),
    "resolve_pdf": f"""WITH {ROWS}, d AS (SELECT row_id, CASE WHEN row_id % 5 IN (0, 4) THEN source_link ELSE 'Not reported' END AS source_link, CASE row_id % 5 WHEN 1 THEN '{FOLDER}' || source_file WHEN 2 THEN source_file ELSE 'Not reported' END AS source_file,
      CASE row_id % 5 WHEN 3 THEN regexp_replace(source_file, '\\.pdf$', '') WHEN 4 THEN 'unknown' ELSE study_name END AS study_name FROM r), {resolved('d')} SELECT row_id, pdf_path FROM pd""",
    "source_links": f"WITH {ROWS}, x AS (SELECT row_id, source_file, {_PAGE.format('source_page')} AS pg, 'Not reported' AS source_link, 'Not reported' AS study_name FROM r), {resolved('x')} SELECT DISTINCT row_id, {_uri('pdf_path', 'pg')} AS link FROM pd",
    "validate_support": f"WITH {ROWS}, {validated('r')} SELECT DISTINCT row_id, new_status AS support_status, new_notes AS support_notes FROM vv",
    "repair_table": f"""WITH {ROWS}, d AS (SELECT * REPLACE (CASE WHEN support_status = 'partial' THEN 'legacy anchor' ELSE support_status END AS support_status, CASE WHEN row_id % 7 = 0 THEN 'https://example.org/' || source_file ELSE source_link END AS source_link,
      CASE WHEN row_id % 3 = 0 THEN 'Not reported' ELSE source_file END AS source_file, CASE WHEN row_id % 3 = 0 THEN 'Not reported' ELSE study_name END AS study_name) FROM r), {resolved('d')},
      nm AS (SELECT *, regexp_extract(pdf_path, '[^/]*$') AS name, pdf_path AS path, {_PAGE.format('source_page')} AS pg, {stripped('source_anchor')} AS own FROM pd), sx AS (SELECT *, regexp_extract(name, '[^.](\\.[^.]+)$', 1) AS suffix FROM nm),
      ln AS (SELECT * REPLACE (CASE WHEN path IS NOT NULL THEN '/app/static/source_pdfs/' || url_encode({_STATIC}) || coalesce('#page=' || pg, '') WHEN source_link <> '' AND source_link NOT LIKE 'file://%' THEN source_link ELSE 'Not reported' END AS source_link,
        CASE WHEN field_sources_json IN ('', 'Not reported') AND own <> '' THEN CAST(json_merge_patch('{{}}', {', '.join(f"CASE WHEN {stripped(f)} NOT IN ('', 'Not reported') THEN json_object('{f}', own) ELSE '{{}}' END" for f in SOURCE_FIELDS)}) AS VARCHAR) ELSE field_sources_json END AS field_sources_json) FROM sx), {validated('ln')}
      SELECT DISTINCT row_id, source_file, source_page, 'Legacy CSV' AS source_passage_id, source_link, CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_sort(json_keys(j)), ',') ELSE '' END AS fields,
        CASE WHEN support_status IN ('', 'Not reported', 'legacy anchor') THEN new_status ELSE support_status END AS support_status FROM vv""",
    "repair_legacy_table": f"""WITH {ROWS}, o AS (SELECT row_id, study_name AS source_file, source_anchor, predictor, outcome, {', '.join(f"'Not reported' AS {f}" for f in CHECKED_FIELDS if f not in ('predictor', 'outcome'))},
      CASE WHEN predictor <> 'Not reported' OR outcome <> 'Not reported' THEN json_object('predictor', source_anchor) ELSE '{{}}' END AS old_json, '{{}}' AS field_sources_json FROM r), {validated('o')}
      SELECT DISTINCT row_id, source_file, 'Not indexed' AS source_page, 'Legacy CSV' AS source_passage_id, 'Not reported' AS source_link, new_status AS support_status FROM vv""",
    "rank_rows": f"WITH {ROWS}, {_relevant()} SELECT row_id, relevance, support_status FROM k",
    "rank_rows_fallback": f"WITH {ROWS}, h AS (SELECT row_id, {_HIDDEN}, query_relevance_score FROM r), {_relevant('h', expand('zzyzx qwxv'))} SELECT row_id, relevance FROM k",
    "facet_options": f"WITH {ROWS} SELECT DISTINCT support_status AS value FROM r WHERE trim(support_status) <> '' AND support_status <> 'Not reported' UNION ALL SELECT DISTINCT method FROM r WHERE trim(method) <> '' AND method <> 'Not reported'",
    "facet_filter": f"WITH {ROWS} SELECT row_id, study_name, method, support_status FROM r WHERE support_status IN ('supported', 'partial') AND method IN ('Neural network', 'Poisson regression')",
    "sidebar_metrics": f"WITH {ROWS} SELECT count(*) AS n_rows, count(DISTINCT study_name) AS n_studies, count(*) FILTER (lower(support_status) LIKE '%supported%') AS n_supported FROM r",
    "result_metrics": f"WITH {ROWS}, {_relevant()}, m AS (SELECT * FROM k WHERE support_status IN ('supported', 'partial')) SELECT count(*) AS n_rows, count(DISTINCT study_name) AS n_studies, CAST(coalesce(sum({_MISSING_CELLS}), 0) AS BIGINT) AS n_missing, coalesce(round_even(avg(relevance), 2), 0.0) AS mean_relevance FROM m",
    "result_table": f"WITH {ROWS}, {_relevant()} SELECT {', '.join(VISIBLE_COLUMNS)}, relevance AS query_relevance FROM k",
    "unique_source_review": f"WITH {ROWS}, {_relevant()}, u AS (SELECT *, concat_ws('|', source_passage_id, source_file, source_page, substring(source_anchor, 1, 300)) AS source_key FROM k) SELECT source_key, relevance, support_status FROM u QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY relevance DESC, support_status, {_TIES}) = 1",
    "field_source_groups": f"""WITH {ROWS}, j AS (SELECT row_id, {STRICT_JSON} AS j FROM r), o AS (SELECT row_id, j, json_keys(j) AS ks FROM j WHERE json_type(j) = 'OBJECT'),
      e AS (SELECT row_id, unnest(ks) AS field, unnest(range(1, len(ks) + 1)) AS pos, j FROM o), f AS (SELECT row_id, field, pos, json_extract_string(j, '$."' || field || '"') AS source FROM e)
      SELECT row_id, source, string_agg(field, ', ' ORDER BY pos) AS fields FROM f WHERE source <> '' GROUP BY row_id, source""",
    "source_cards": f"""WITH {ROWS} SELECT DISTINCT study_name || ' | ' || source_file || ' | page ' || source_page AS title, source_link, replace(replace(replace(replace(replace(source_anchor, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS quote_html, support_status, support_notes FROM r""",
    "static_names": f"""WITH {PAGES}, n AS (SELECT DISTINCT file_path, regexp_extract(file_path, '[^/]*$') AS name FROM g WHERE file_path IS NOT NULL), x AS (SELECT *, regexp_extract(name, '[^.](\\.[^.]+)$', 1) AS suffix FROM n)
      SELECT file_path, coalesce(nullif(substring(regexp_replace(substring(name, 1, length(name) - length(suffix)), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), 1, 90), ''), 'source') || '-' || substring(sha1(file_path), 1, 12) || CASE WHEN lower(suffix) = '.pdf' THEN suffix ELSE '.pdf' END AS static_name FROM x""",
    "vision_gate": f"WITH {PAGES} SELECT page_id, length({stripped("coalesce(text, '')")}) < 500 OR coalesce(embedded_image_count, 0) > 0 AS wanted FROM g",
    "audit_trail": f"WITH {ranked(8)} SELECT source_file, page_number AS source_page, passage_id AS source_passage_id, {_uri('source_path', 'page_number')} AS source_link, score, text FROM k",
}
