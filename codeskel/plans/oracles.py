"""DuckDB oracle SQL for the correctness gate.

Written independently of the Spark code: line tables, window functions and a
recursive CTE (JS/TS brace state) instead of row-local array folds.  The
Python oracle is specialised to the ``code_files`` template (it tags template
lines by shape and applies the syntax-tree keep rules to them).  Every query
runs on the pre-registered tables only; ``code_files`` is the shared CTE.
"""

from __future__ import annotations

import re

from ..operators.brace import JS_SIG_RE
from ..sources.files import IGNORED_DIRS
from ..sources.fixtures import code_files_cte

NL = "chr(10)"

# Python str.isspace() class in RE2 syntax; the same set as the Spark helpers.
_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

_JS_SIG = JS_SIG_RE.replace("(?U)", "")  # the corpus is ASCII there


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_q('^' + _WS + '+|' + _WS + '+$')}, '', 'g')"


def lstrip_len_sql(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, {_q('^' + _WS + '+')}, '')))"


def lead_ws_sql(x: str) -> str:
    return f"regexp_extract({x}, {_q('^' + _WS + '*')}, 0)"


def splitlines_sql(x: str) -> str:
    arr = f"string_split_regex({x}, {_q(_BREAK)})"
    return f"(CASE WHEN {arr}[-1] = '' THEN {arr}[1:len({arr}) - 1] ELSE {arr} END)"


def tokens_floor_sql(n: str) -> str:
    return f"greatest(1, cast(floor({n} / 3.8::DOUBLE) AS INTEGER))"


def tokens_ceil_sql(t: str) -> str:
    return f"(CASE WHEN {t} IS NULL OR {t} = '' THEN 0 ELSE greatest(1, cast(ceil(length({t}) / 3.8::DOUBLE) AS INTEGER)) END)"


def round1_sql(x: str) -> str:
    return f"(floor(({x}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE)"


def ext_sql(path: str) -> str:
    base = f"regexp_extract({path}, '[^/]*$', 0)"
    return f"lower(regexp_extract({base}, '^\\.*[^.].*(\\.[^.]*)$', 1))"


def lang_sql(ext: str) -> str:
    return (
        f"(CASE WHEN {ext} = '.py' THEN 'python' WHEN {ext} IN ('.ts','.js','.tsx','.jsx') THEN 'js_ts' "
        f"WHEN {ext} IN ('.java','.cpp','.c','.cs') THEN 'c_like' ELSE 'generic' END)"
    )


_IGNORED = "[" + ",".join(f"'{d}'" for d in IGNORED_DIRS) + "]"
_SUPPORTED = "('.py','.ts','.js','.tsx','.jsx','.java','.cpp','.cs')"


def ignored_pred_sql(path: str) -> str:
    """No directory of the path is an ignored one."""
    d = f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"
    return f"NOT list_has_any(string_split(replace({d}, '\\', '/'), '/'), {_IGNORED})"


def scan_pred_sql(path: str) -> str:
    return f"({ignored_pred_sql(path)} AND {ext_sql(path)} IN {_SUPPORTED})"


# ------------------------------------------------------------------ skeletons

_FILES_CTES = f"""
{code_files_cte('duckdb')},
f AS (
  SELECT repo, path, content, {lang_sql(ext_sql('path'))} AS language, {splitlines_sql('content')} AS arr
  FROM code_files
),
ln AS (
  SELECT repo, path, language, len(arr) AS n,
         generate_subscripts(arr, 1) - 1 AS i, unnest(arr) AS line
  FROM f
)"""

# JS/TS: recursive state machine over lines, per file
_JS_CTES = f"""
jl AS (
  SELECT repo, path, n, i, line, {lead_ws_sql('line')} AS ws, s,
         (regexp_matches(s, '^(import |export |//|/\\*|\\*|type |interface )') OR sig) AS kept,
         sig AND (s LIKE '%function%' OR s LIKE '%=>%' OR s LIKE '%(%') AS is_method,
         (s LIKE 'class %' OR s LIKE '% class %') AS is_class,
         regexp_matches(s, '^(const |let |var )') AS decl,
         (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS net
  FROM (SELECT *, {strip_sql('line')} AS s, regexp_matches(line, {_q(_JS_SIG)}) AS sig FROM ln WHERE language = 'js_ts')
),
jl2 AS (
  SELECT *, kept AND contains(line, '{{') AND (s LIKE '%function%' OR s LIKE '%=>%' OR s LIKE '%(%') AND net > 0 AS opener
  FROM jl
),
jst AS (
  WITH RECURSIVE st(repo, path, i, in_body, depth, start, was_in, close_open) AS (
    SELECT DISTINCT repo, path, -1, false, 0, -1, false, CAST(NULL AS INTEGER) FROM jl2
    UNION ALL
    SELECT l.repo, l.path, l.i,
      CASE WHEN l.kept THEN st.in_body OR l.opener
           WHEN st.in_body THEN st.depth + l.net > 0 ELSE false END,
      CASE WHEN l.kept AND NOT st.in_body AND l.opener THEN l.net
           WHEN NOT l.kept AND st.in_body THEN st.depth + l.net ELSE st.depth END,
      CASE WHEN l.kept AND NOT st.in_body AND l.opener THEN l.i ELSE st.start END,
      st.in_body,
      CASE WHEN NOT l.kept AND st.in_body AND st.depth + l.net <= 0 THEN st.start END
    FROM st JOIN jl2 l ON l.repo = st.repo AND l.path = st.path AND l.i = st.i + 1
  )
  SELECT * FROM st WHERE i >= 0
),
jout AS (
  SELECT l.repo, l.path, l.i, 0 AS sub,
    CASE WHEN l.kept THEN l.line
         WHEN t.was_in AND t.close_open IS NULL THEN NULL
         WHEN t.was_in THEN o.ws || '  /* [Body compressed: ' || cast(l.i - t.close_open AS VARCHAR) || ' lines] */'
         WHEN l.decl THEN CASE WHEN contains(l.line, '=') THEN split_part(l.line, '=', 1) || '= ...;' ELSE l.line END
    END AS txt
  FROM jl2 l JOIN jst t ON t.repo = l.repo AND t.path = l.path AND t.i = l.i
  LEFT JOIN jl2 o ON o.repo = l.repo AND o.path = l.path AND o.i = t.close_open
  UNION ALL
  SELECT l.repo, l.path, l.i, 1, l.line
  FROM jl2 l JOIN jst t ON t.repo = l.repo AND t.path = l.path AND t.i = l.i
  WHERE NOT l.kept AND t.was_in AND t.close_open IS NOT NULL
),
js_sk AS (
  SELECT g.repo, g.path,
         coalesce((SELECT string_agg(txt, {NL} ORDER BY i, sub) FROM jout o
                   WHERE o.repo = g.repo AND o.path = g.path AND o.txt IS NOT NULL), '') AS skeleton,
         cast(count(*) FILTER (WHERE g.is_method) AS INTEGER) AS method_count,
         cast(count(*) FILTER (WHERE g.is_class) AS INTEGER) AS class_count
  FROM jl2 g GROUP BY g.repo, g.path
)"""

# C-like: depth since the last reset line is state independent; bodies are
# the run starts of the merged opener / closer event sequence.
_C_CTES = f"""
cl AS (
  SELECT repo, path, n, i, line, ws, s, rule1,
         (NOT rule1 AND contains(line, '(') AND contains(line, ')')
          AND (s LIKE '%{{' OR coalesce(lead(s) OVER (PARTITION BY repo, path ORDER BY i) LIKE '{{%', false))) AS sig,
         net, (s LIKE '%class %' OR s LIKE '%interface %' OR s LIKE '%struct %') AS is_class,
         (s = '}}' OR s = '}};') AS closer
  FROM (
    SELECT *, {strip_sql('line')} AS s, {lead_ws_sql('line')} AS ws,
           (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS net,
           (regexp_matches({strip_sql('line')}, '^(package |import |#include|using |//|/\\*|\\*|@)')
            OR contains({strip_sql('line')}, 'class ') OR contains({strip_sql('line')}, 'interface ')) AS rule1
    FROM ln WHERE language = 'c_like')
),
cl2 AS (
  SELECT *, sig AND contains(line, '{{') AS reset, NOT rule1 AND NOT sig AS counted,
         sum(CASE WHEN NOT rule1 AND NOT sig THEN net ELSE 0 END)
           OVER (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
  FROM cl
),
cl3 AS (
  SELECT *, last_value(CASE WHEN reset THEN net - cs END IGNORE NULLS)
              OVER (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base
  FROM cl2
),
cev AS (
  SELECT repo, path, i, CASE WHEN reset AND net > 0 THEN 'O' ELSE 'E' END AS t
  FROM cl3 WHERE (reset AND net > 0) OR (counted AND base IS NOT NULL AND base + cs <= 0)
),
csel AS (
  SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY repo, path ORDER BY i) AS pt FROM cev)
  WHERE (t = 'O' AND (pt IS NULL OR pt = 'E')) OR (t = 'E' AND pt = 'O')
),
cpair AS (
  SELECT repo, path, o, c FROM (
    SELECT repo, path, t, i AS o, lead(i) OVER (PARTITION BY repo, path ORDER BY i) AS c FROM csel)
  WHERE t = 'O'
),
cout AS (
  SELECT l.repo, l.path, l.i, 0 AS sub,
    CASE WHEN l.rule1 OR l.sig THEN l.line
         WHEN p.o IS NOT NULL AND l.i = p.c THEN o.ws || '    /* [Body compressed: ' || cast(l.i - p.o AS VARCHAR) || ' lines] */'
         WHEN p.o IS NOT NULL THEN NULL
         WHEN l.closer THEN l.line END AS txt
  FROM cl3 l
  LEFT JOIN cpair p ON p.repo = l.repo AND p.path = l.path AND l.i > p.o AND l.i <= coalesce(p.c, l.n)
  LEFT JOIN cl3 o ON o.repo = l.repo AND o.path = l.path AND o.i = p.o
  UNION ALL
  SELECT l.repo, l.path, l.i, 1, l.line
  FROM cl3 l JOIN cpair p ON p.repo = l.repo AND p.path = l.path AND l.i = p.c
  WHERE NOT (l.rule1 OR l.sig)
),
c_sk AS (
  SELECT g.repo, g.path,
         coalesce((SELECT string_agg(txt, {NL} ORDER BY i, sub) FROM cout o
                   WHERE o.repo = g.repo AND o.path = g.path AND o.txt IS NOT NULL), '') AS skeleton,
         cast(count(*) FILTER (WHERE g.sig) AS INTEGER) AS method_count,
         cast(count(*) FILTER (WHERE g.is_class) AS INTEGER) AS class_count
  FROM cl3 g GROUP BY g.repo, g.path
)"""

def generic_sql(content: str, arr: str) -> str:
    marker = f"'# ... [Compressed ' || cast(len({arr}) - 25 AS VARCHAR) || ' lines] ...'"
    return (
        f"(CASE WHEN len({arr}) <= 30 THEN {content} ELSE array_to_string("
        f"list_concat({arr}[1:15], [{marker}], {arr}[len({arr}) - 9:len({arr})]), {NL}) END)"
    )


# Python, specialised to the template: tag lines by shape, apply the keep
# rules of the syntax-tree skeleton, collapse gaps with windows.
_PY_KEEP = (
    r"^(import |from )|^[A-Z]+ = |^    \"size\": |^}$|^@dataclass$|^class |^    \"\"\"Part "
    r"|^    @staticmethod$|^    def .*[:,]$|^            b\):$|^        \"\"\"Run |^        # compute$|^def main"
)

_PY_CTES = f"""
pf AS (
  SELECT repo, path, content, n, contains(content, {NL} || 'BROKEN = (') AS malformed,
         starts_with(content, '\"\"\"') AS moddoc
  FROM (SELECT repo, path, content, len(arr) AS n FROM f WHERE language = 'python')
),
pl AS (
  SELECT l.repo, l.path, l.i, l.n, l.line, {lstrip_len_sql('l.line')} AS ind,
         (p.moddoc AND l.i < 9) OR regexp_matches(l.line, {_q(_PY_KEEP)}) AS k
  FROM ln l JOIN pf p ON p.repo = l.repo AND p.path = l.path
  WHERE NOT p.malformed
),
pl2 AS (
  SELECT *,
    lag(k) OVER w AS pk, lag(ind) OVER w AS pind,
    min(CASE WHEN k THEN i END) OVER (PARTITION BY repo, path ORDER BY i
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nk
  FROM pl WINDOW w AS (PARTITION BY repo, path ORDER BY i)
),
pout AS (
  SELECT repo, path, i,
    CASE WHEN k THEN line
         WHEN pk IS NULL OR pk THEN repeat(' ', coalesce(pind, 0) + 4) || '...  # [Body compressed: '
              || cast(coalesce(nk, n) - i AS VARCHAR) || ' lines]' END AS txt
  FROM pl2
),
py_sk AS (
  SELECT p.repo, p.path,
    CASE WHEN p.malformed THEN {generic_sql('p.content', 'arr')}
         ELSE coalesce((SELECT string_agg(txt, {NL} ORDER BY i) FROM pout o
                        WHERE o.repo = p.repo AND o.path = p.path AND o.txt IS NOT NULL), '') END AS skeleton,
    CASE WHEN p.malformed THEN 0 ELSE
      cast(regexp_count_sql AS INTEGER) END AS method_count,
    CASE WHEN p.malformed THEN 0 ELSE 1 END::INTEGER AS class_count
  FROM (SELECT pf.*, f.arr FROM pf JOIN f USING (repo, path)) p
)"""


def _py_ctes() -> str:
    # one def line per method plus def main(); ``def`` lines at column 0 or 4
    count = f"len(regexp_extract_all(p.content, '(?m)^(    )?def '))"
    return _PY_CTES.replace("regexp_count_sql", count)


_GEN_CTES = f"""
g_sk AS (
  SELECT repo, path, {generic_sql('content', 'arr')} AS skeleton, 0::INTEGER AS method_count, 0::INTEGER AS class_count
  FROM f WHERE language = 'generic'
)"""


def _all_skeletons() -> str:
    return (
        "WITH " + _FILES_CTES + "," + _JS_CTES + "," + _C_CTES + "," + _py_ctes() + "," + _GEN_CTES + """,
sk AS (
  SELECT * FROM js_sk UNION ALL SELECT * FROM c_sk UNION ALL SELECT * FROM py_sk UNION ALL SELECT * FROM g_sk
),
fm AS (
  SELECT f.repo, f.path, f.language, s.skeleton, s.method_count, s.class_count,
         cast(len(f.arr) AS INTEGER) AS original_lines,
         cast(len(""" + splitlines_sql("s.skeleton") + """) AS INTEGER) AS skeleton_lines,
         cast(length(f.content) AS INTEGER) AS original_char_count,
         cast(length(s.skeleton) AS INTEGER) AS skeleton_char_count,
         """ + tokens_floor_sql("length(f.content)") + """ AS raw_tokens_est,
         """ + tokens_floor_sql("length(s.skeleton)") + """ AS skeleton_tokens_est
  FROM f JOIN sk s ON s.repo = f.repo AND s.path = f.path
),
fm2 AS (
  SELECT *, greatest(0.0::DOUBLE, """ + round1_sql(
            "(1.0::DOUBLE - skeleton_tokens_est::DOUBLE / raw_tokens_est::DOUBLE) * 100.0::DOUBLE"
        ) + """) AS reduction_pct
  FROM fm
)"""
    )


_METRIC_COLS = (
    "original_lines, skeleton_lines, original_char_count, skeleton_char_count, raw_tokens_est, "
    "skeleton_tokens_est, reduction_pct, method_count, class_count"
)


def file_skeleton_metrics() -> str:
    return _all_skeletons() + f"\nSELECT repo, path, {_METRIC_COLS} FROM fm2"


def skeleton_of(language: str) -> str:
    return (
        _all_skeletons()
        + f"\nSELECT repo, path, skeleton, method_count, class_count FROM fm2 WHERE language = '{language}'"
    )


def _scanned_metrics() -> str:
    return _all_skeletons() + f",\nsm AS (SELECT * FROM fm2 WHERE {scan_pred_sql('path')})"


def _summary_select(src: str, group: str) -> str:
    consumed = "total_skeleton_tokens"
    saved = f"greatest(0, total_raw_tokens - {consumed})"
    pct = f"(CASE WHEN total_raw_tokens > 0 THEN {round1_sql(f'{saved}::DOUBLE / total_raw_tokens::DOUBLE * 100.0::DOUBLE')} ELSE 0.0::DOUBLE END)"
    ratio = f"cast({round1_sql(f'total_raw_tokens::DOUBLE / greatest(1, {consumed})::DOUBLE')} AS VARCHAR) || 'x'"
    return f"""
SELECT repo, total_files_scanned, total_raw_tokens, total_skeleton_tokens,
       0::BIGINT AS selective_method_fetches, 0::BIGINT AS method_tokens_fetched,
       {consumed} AS total_consumed_tokens, {saved} AS saved_tokens, {pct} AS reduction_pct,
       {ratio} AS compression_ratio
FROM (SELECT repo, count(*) AS total_files_scanned, sum(raw_tokens_est)::BIGINT AS total_raw_tokens,
             sum(skeleton_tokens_est)::BIGINT AS total_skeleton_tokens
      FROM {src} GROUP BY {group})"""


def repo_summary() -> str:
    return _scanned_metrics() + _summary_select("sm", "repo")


def repo_summary_with_fetches() -> str:
    consumed = "(total_skeleton_tokens + mt)"
    saved = f"greatest(0, total_raw_tokens - {consumed})"
    pct = f"(CASE WHEN total_raw_tokens > 0 THEN {round1_sql(f'{saved}::DOUBLE / total_raw_tokens::DOUBLE * 100.0::DOUBLE')} ELSE 0.0::DOUBLE END)"
    ratio = f"cast({round1_sql(f'total_raw_tokens::DOUBLE / greatest(1, {consumed})::DOUBLE')} AS VARCHAR) || 'x'"
    return f"""WITH su AS ({repo_summary()}),
ft AS ({method_fetch_totals()}),
j AS (SELECT su.repo, total_files_scanned, total_raw_tokens, total_skeleton_tokens,
             coalesce(ft.selective_method_fetches, 0)::BIGINT AS mf, coalesce(ft.method_tokens_fetched, 0)::BIGINT AS mt
      FROM su LEFT JOIN ft ON ft.repo = su.repo)
SELECT repo, total_files_scanned, total_raw_tokens, total_skeleton_tokens, mf AS selective_method_fetches,
       mt AS method_tokens_fetched, {consumed} AS total_consumed_tokens, {saved} AS saved_tokens, {pct} AS reduction_pct,
       {ratio} AS compression_ratio
FROM j"""


def repo_summary_rollup() -> str:
    return _scanned_metrics() + _summary_select("sm", "ROLLUP (repo)")


def code_structure_counts() -> str:
    return _all_skeletons() + """
SELECT repo, language, count(*) AS files, sum(class_count)::BIGINT AS class_count,
       sum(method_count)::BIGINT AS method_count
FROM fm2 GROUP BY repo, language"""


def scan_history() -> str:
    return _scanned_metrics() + f"""
SELECT repo, path AS filename, raw_tokens_est AS raw_tokens, skeleton_tokens_est AS skeleton_tokens,
       greatest(0, raw_tokens_est - skeleton_tokens_est) AS saved_tokens,
       {round1_sql('greatest(0, raw_tokens_est - skeleton_tokens_est)::DOUBLE / raw_tokens_est::DOUBLE * 100.0::DOUBLE')} AS reduction_pct
FROM sm"""


def scan_running_totals() -> str:
    w = "OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return _scanned_metrics() + f"""
SELECT repo, path, count(*) {w} AS files_scanned, (sum(raw_tokens_est) {w})::BIGINT AS raw_tokens_cum,
       (sum(skeleton_tokens_est) {w})::BIGINT AS skeleton_tokens_cum
FROM sm"""


def scan_history_last20() -> str:
    return scan_history().replace(
        "\nSELECT repo, path AS filename", "\n, h AS (SELECT repo, path AS filename", 1
    ) + """)
SELECT repo, filename, raw_tokens, skeleton_tokens, saved_tokens, reduction_pct,
       cast(cnt - rd + 1 AS INTEGER) AS seq
FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS cnt FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY filename DESC) AS rd FROM h) WHERE rd <= 20)"""


def scan_supported_files() -> str:
    return f"""WITH {code_files_cte('duckdb')}
SELECT repo, path, {ext_sql('path')} AS ext FROM code_files WHERE {scan_pred_sql('path')}"""


# ------------------------------------------------------------------ documents

def skeleton_generic_docs() -> str:
    arr = splitlines_sql("text")
    return f"""
SELECT doc_id, source AS repo, cast(len(arr) AS INTEGER) AS original_lines, {generic_sql('text', 'arr')} AS skeleton
FROM (SELECT doc_id, source, text, {arr} AS arr FROM documents)"""


def file_token_estimates() -> str:
    return f"""
SELECT doc_id, cast(length(text) AS INTEGER) AS n_chars, {tokens_floor_sql('length(text)')} AS tokens_floor,
       {tokens_ceil_sql('text')} AS tokens_ceil
FROM documents"""


def file_lines() -> str:
    return f"""
SELECT doc_id, cast(i + 1 AS INTEGER) AS line_no, line, {strip_sql('line')} AS stripped,
       cast({lstrip_len_sql('line')} AS INTEGER) AS indent
FROM (SELECT doc_id, generate_subscripts(arr, 1) - 1 AS i, unnest(arr) AS line
      FROM (SELECT doc_id, {splitlines_sql('text')} AS arr FROM documents))"""


# ------------------------------------------------------------------ search

def lf_lines_sql(x: str) -> str:
    arr = f"string_split({x}, {NL})"
    return f"(CASE WHEN {arr}[-1] = '' THEN {arr}[1:len({arr}) - 1] ELSE {arr} END)"


_DOC_LINES = f"""
dl AS (
  SELECT repo, path, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line
  FROM (SELECT source AS repo, printf('docs/%08d.txt', doc_id) AS path, {lf_lines_sql('text')} AS arr FROM documents)
)"""


def _report(matches: str, symbols: str) -> str:
    return f"""
c AS (SELECT symbol, repo, count(*) AS ref_count FROM {matches} GROUP BY symbol, repo),
t AS (SELECT *, row_number() OVER (PARTITION BY symbol, repo ORDER BY path, line_no) AS rk FROM {matches})
SELECT t.symbol, t.repo, c.ref_count, cast(t.rk AS INTEGER) AS rank, t.path, cast(t.line_no AS INTEGER) AS line_no, t.text
FROM t JOIN c ON c.symbol = t.symbol AND c.repo = t.repo WHERE t.rk <= 50
UNION ALL
SELECT symbol, NULL, 0::BIGINT, NULL::INTEGER, NULL, NULL::INTEGER, NULL
FROM {symbols} WHERE symbol NOT IN (SELECT symbol FROM c)"""


def find_references(symbol: str = "ther") -> str:
    return f"""WITH {_DOC_LINES},
sy AS (SELECT {_q(symbol)} AS symbol),
m AS (SELECT {_q(symbol)} AS symbol, repo, path, line_no, {strip_sql('line')} AS text FROM dl WHERE contains(line, {_q(symbol)})),
{_report('m', 'sy')}"""


def find_references_code(symbol: str = "helper") -> str:
    return f"""WITH {code_files_cte('duckdb')},
dl AS (
  SELECT repo, path, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line
  FROM (SELECT repo, path, {lf_lines_sql('content')} AS arr FROM code_files WHERE {ignored_pred_sql('path')})
),
sy AS (SELECT {_q(symbol)} AS symbol),
m AS (SELECT {_q(symbol)} AS symbol, repo, path, line_no, {strip_sql('line')} AS text FROM dl WHERE contains(line, {_q(symbol)})),
{_report('m', 'sy')}"""


def find_references_multi() -> str:
    return f"""WITH {_DOC_LINES},
sy AS (SELECT DISTINCT w AS symbol FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark)
       WHERE w <> ''),
m AS (SELECT sy.symbol, dl.repo, dl.path, dl.line_no, {strip_sql('dl.line')} AS text
      FROM dl JOIN sy ON contains(dl.line, sy.symbol)),
{_report('m', 'sy')}"""


# ------------------------------------------------------------------ lookups

def _method_bodies_ctes(req_sql: str | None = None, extra_ctes: str = "") -> str:
    from ..sources.fixtures import method_requests_sql

    return f"""WITH {code_files_cte('duckdb')},{extra_ctes}
req AS ({req_sql or method_requests_sql()}),
f AS (SELECT repo, path, content, {ext_sql('path')} AS ext, {splitlines_sql('content')} AS arr FROM code_files),
ln AS (SELECT repo, path, ext, len(arr) AS n, generate_subscripts(arr, 1) - 1 AS i, unnest(arr) AS line FROM f),
lnf AS (
  SELECT *, s <> '' AND NOT starts_with(s, '#') AS code,
         sum(net) OVER (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs
  FROM (SELECT *, {strip_sql('line')} AS s, {lstrip_len_sql('line')} AS ind,
               (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS net
        FROM ln)
),
pyok AS (SELECT repo, path FROM f WHERE ext = '.py' AND NOT contains(content, {NL} || 'BROKEN = (')),
pydef AS (
  SELECT l.repo, l.path, l.i, l.ind, regexp_extract(l.s, '^(?:async\\s+)?def\\s+([A-Za-z0-9_]+)\\s*\\(', 1) AS name
  FROM lnf l JOIN pyok USING (repo, path) WHERE regexp_matches(l.s, '^(async\\s+)?def\\s+')
),
pynext AS (
  SELECT d.repo, d.path, d.name, d.i AS s,
         coalesce(min(l.i) FILTER (WHERE l.i > d.i AND l.code AND l.ind <= d.ind), max(l.n)) AS nx
  FROM pydef d JOIN lnf l ON l.repo = d.repo AND l.path = d.path
  GROUP BY d.repo, d.path, d.name, d.i
),
pyast AS (
  SELECT r.repo, r.path, r.method, p.s, max(l.i) AS e
  FROM req r JOIN pynext p ON p.repo = r.repo AND p.path = r.path AND p.name = r.method
  JOIN lnf l ON l.repo = p.repo AND l.path = p.path AND l.i >= p.s AND l.i < p.nx AND l.code
  WHERE p.s = (SELECT min(p2.s) FROM pynext p2 WHERE p2.repo = p.repo AND p2.path = p.path AND p2.name = p.name)
  GROUP BY r.repo, r.path, r.method, p.s
),
calls AS (
  SELECT repo, path, i, unnest(regexp_extract_all(line, '([A-Za-z0-9_]+)\\s*\\(', 1)) AS name FROM lnf
),
starts AS (
  SELECT r.repo, r.path, r.method, min(c.i) AS s
  FROM req r JOIN calls c ON c.repo = r.repo AND c.path = r.path AND c.name = r.method
  WHERE NOT EXISTS (SELECT 1 FROM pyast a WHERE a.repo = r.repo AND a.path = r.path AND a.method = r.method)
  GROUP BY r.repo, r.path, r.method
),
fb AS (
  SELECT st.repo, st.path, st.method, st.s,
         coalesce(min(l.i) FILTER (WHERE l.i > st.s AND l.i <= least(st.s + 149, l.n - 1) AND (
                    (l.ext = '.py' AND l.code AND l.ind <= h.ind)
                    OR (l.ext <> '.py' AND l.cs - (h.cs - h.net) <= 0 AND contains(l.line, '}}')))),
                  least(st.s + 149, max(l.n) - 1)) AS e
  FROM starts st JOIN lnf h ON h.repo = st.repo AND h.path = st.path AND h.i = st.s
  JOIN lnf l ON l.repo = st.repo AND l.path = st.path
  GROUP BY st.repo, st.path, st.method, st.s
),
rng AS (SELECT repo, path, method, s, e FROM pyast UNION ALL SELECT repo, path, method, s, e FROM fb),
bod AS (
  SELECT g.repo, g.path, g.method, string_agg(l.line, {NL} ORDER BY l.i) AS body
  FROM rng g JOIN lnf l ON l.repo = g.repo AND l.path = g.path AND l.i BETWEEN g.s AND g.e
  GROUP BY g.repo, g.path, g.method
),
mb AS (
  SELECT r.repo, r.path, r.method,
         CASE WHEN f.path IS NULL THEN 'file not found' WHEN b.body IS NULL OR b.body = '' THEN 'method not found'
              ELSE 'found' END AS status,
         b.body AS body0
  FROM req r LEFT JOIN f ON f.repo = r.repo AND f.path = r.path
  LEFT JOIN bod b ON b.repo = r.repo AND b.path = r.path AND b.method = r.method
),
mb2 AS (
  SELECT repo, path, method, status,
         CASE WHEN status = 'found' THEN body0 END AS body,
         CASE WHEN status = 'found' THEN {tokens_ceil_sql('body0')} ELSE 0 END::INTEGER AS tokens
  FROM mb
)"""


def method_bodies() -> str:
    return _method_bodies_ctes() + """
SELECT repo, path, method, status, body, tokens,
       CASE status WHEN 'file not found' THEN 'Error: File ''' || path || ''' not found.'
                   WHEN 'method not found' THEN 'Method ''' || method || ''' not found in ''' || path || '''.'
                   ELSE '=== METHOD BODY: ' || method || ' in ' || path || ' (~' || cast(tokens AS VARCHAR)
                        || ' tokens) ===' || chr(10) || body END AS result
FROM mb2"""


def method_fetch_totals() -> str:
    return _method_bodies_ctes() + """
SELECT repo, count(*) AS selective_method_fetches, sum(tokens)::BIGINT AS method_tokens_fetched
FROM mb2 WHERE status = 'found' GROUP BY repo"""


# ------------------------------------------------------------------ gaps, ranges, prompts, refs

def skeleton_gaps() -> str:
    return f"""WITH d AS (SELECT doc_id, {splitlines_sql('text')} AS arr FROM documents),
l AS (SELECT doc_id, len(arr) AS n, generate_subscripts(arr, 1) - 1 AS i, unnest(arr) AS line FROM d),
k AS (SELECT *, length({strip_sql('line')}) >= 40 AS k, {lstrip_len_sql('line')} AS ind FROM l),
k2 AS (SELECT *, lag(k) OVER w AS pk, lag(ind) OVER w AS pind,
              min(CASE WHEN k THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nk
       FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, i, CASE WHEN k THEN line WHEN pk IS NULL OR pk THEN repeat(' ', coalesce(pind, 0) + 4)
               || '...  # [Body compressed: ' || cast(coalesce(nk, n) - i AS VARCHAR) || ' lines]' END AS txt FROM k2)
SELECT d.doc_id, coalesce((SELECT string_agg(txt, {NL} ORDER BY i) FROM o WHERE o.doc_id = d.doc_id AND txt IS NOT NULL), '') AS skeleton
FROM d"""


def body_ranges() -> str:
    return "WITH " + _FILES_CTES + "," + _JS_CTES + "," + _C_CTES + """,
jr AS (
  SELECT repo, path, close_open + 1 AS body_start, i + 1 AS body_end FROM jst WHERE close_open IS NOT NULL
  UNION ALL
  SELECT t.repo, t.path, t.start + 1, NULL FROM jst t
  JOIN (SELECT repo, path, max(i) AS mi FROM jst GROUP BY repo, path) m ON m.repo = t.repo AND m.path = t.path AND m.mi = t.i
  WHERE t.in_body
)
SELECT repo, path, cast(body_start AS INTEGER) AS body_start, cast(body_end AS INTEGER) AS body_end FROM jr
UNION ALL
SELECT repo, path, cast(o + 1 AS INTEGER), cast(c + 1 AS INTEGER) FROM cpair"""


def compress_messages() -> str:
    hit = "(role = 'assistant' AND length(text) > 1000)"
    return f"""SELECT conv_id, turn, role,
  CASE WHEN {hit} THEN '[Tool Output: Compressed ' || cast(len(arr) AS VARCHAR) || ' lines (~'
       || cast({tokens_ceil_sql('text')} AS VARCHAR) || ' tokens)]' || {NL} || array_to_string(arr[1:5], {NL}) || {NL} || '...'
       ELSE text END AS content,
  {hit} AS compressed
FROM (SELECT *, {splitlines_sql('text')} AS arr FROM conversations)"""


def prompt_assembly() -> str:
    b = "'=== [CACHE_BOUNDARY: {}] ==='"
    return f"""WITH d AS (SELECT doc_id AS conv_id, {generic_sql('text', 'arr')} AS skeleton
           FROM (SELECT doc_id, text, {splitlines_sql('text')} AS arr FROM documents)),
s AS (SELECT conv_id, turn, text AS system FROM conversations WHERE role = 'system')
SELECT s.conv_id, s.turn,
  {b.format('SYSTEM_PROMPT')} || {NL} || {strip_sql('s.system')} || {NL} || {NL} ||
  {b.format('REPO_SKELETON')} || {NL} || {strip_sql('d.skeleton')} || {NL} || {NL} ||
  {b.format('USER_CONTEXT_START')} || {NL} AS cached_prompt,
  {tokens_ceil_sql('s.system')} AS system_tokens, {tokens_ceil_sql('d.skeleton')} AS skeleton_tokens
FROM (SELECT d.conv_id, s.turn, coalesce(s.system, '') AS system FROM d LEFT JOIN s ON d.conv_id = s.conv_id) s
JOIN d ON d.conv_id = s.conv_id"""


def repo_ref_normalise() -> str:
    return f"""WITH r AS (SELECT url AS ref, {strip_sql("coalesce(url, '')")} AS t0 FROM pages),
r2 AS (SELECT ref, CASE WHEN t0 = '' THEN '.' ELSE t0 END AS t FROM r),
r3 AS (SELECT ref, t,
         (starts_with(t, 'http://') OR starts_with(t, 'https://') OR starts_with(t, 'git@')
          OR contains(t, 'github.com') OR contains(t, 'gitlab.com') OR ends_with(t, '.git')) AS is_url,
         CASE WHEN starts_with(t, 'github.com/') OR starts_with(t, 'gitlab.com/') THEN 'https://' || t ELSE t END AS u
       FROM r2)
SELECT ref, is_url, CASE WHEN is_url THEN u END AS url,
       CASE WHEN is_url THEN replace(string_split(rtrim(u, '/'), '/')[-1], '.git', '')
            ELSE coalesce(nullif(string_split(rtrim(t, '/'), '/')[-1], ''), t) END AS repo_name
FROM r3"""


# ------------------------------------------------------------------ reports

def _sampled(n: int) -> str:
    return f"""
hl AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path DESC) AS rd FROM sm),
h20 AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rank FROM hl WHERE rd <= 20),
smp AS (SELECT repo, path, rank FROM h20 WHERE rank <= {n})"""


def _map_header_sql() -> str:
    rule = "=" * 65
    return (
        f"'{rule}' || {NL} || 'CODESKEL REPOSITORY SKELETON MAP' || {NL} || 'Files Scanned: ' || "
        "cast(total_files_scanned AS VARCHAR) || ' | Raw Tokens: ~' || cast(total_raw_tokens AS VARCHAR) || "
        f"' -> Skeleton Tokens: ~' || cast(total_skeleton_tokens AS VARCHAR) || {NL} || 'Overall Reduction: ' || "
        "cast(reduction_pct AS VARCHAR) || '% | Compression Ratio: ' || compression_ratio || "
        f"{NL} || '{rule}' || {NL} || {NL}"
    )


def skeleton_map() -> str:
    return _scanned_metrics() + ",\nsu AS (" + _summary_select("sm", "repo") + f""")
SELECT repo, NULL::VARCHAR AS path, {_map_header_sql()} AS entry FROM su
UNION ALL
SELECT repo, path, '--- FILE: ' || path || ' (Raw: ~' || cast(raw_tokens_est AS VARCHAR) || ' tokens -> Skeleton: ~'
       || cast(skeleton_tokens_est AS VARCHAR) || ' tokens | Reduction: ' || cast(reduction_pct AS VARCHAR) || '%) ---'
       || {NL} || skeleton || {NL} AS entry
FROM sm"""


def sequence_diagram() -> str:
    from .report import DIAGRAM_FILE, DIAGRAM_KIND, DIAGRAM_NO_FILES, DIAGRAM_READ, DIAGRAM_REPO

    clean = "replace(replace({x}, '\\', '/'), '\"', '')"

    def put(pattern: str, *values: str) -> str:
        parts = re.split("%d|%s", pattern.replace("%%", "\0"))
        out = [_q(parts[0].replace("\0", "%"))]
        for v, rest in zip(values, parts[1:], strict=True):
            out += [v, _q(rest.replace("\0", "%"))]
        return " || ".join(out)

    place = "cast(rank - 1 AS VARCHAR)"
    return _scanned_metrics() + "," + _sampled(3) + f""",
sr AS (SELECT smp.repo, smp.path, smp.rank, sm.reduction_pct FROM smp JOIN sm ON sm.repo = smp.repo AND sm.path = smp.path),
nd AS (SELECT repo, string_agg({put(DIAGRAM_FILE, place, clean.format(x='path'))}, '' ORDER BY rank) AS nodes,
              string_agg({put(DIAGRAM_READ, place, place, 'cast(reduction_pct AS VARCHAR)')}, '' ORDER BY rank) AS arrows
       FROM sr GROUP BY repo)
SELECT r.repo, {_q(DIAGRAM_KIND)} || {put(DIAGRAM_REPO, clean.format(x='r.repo'))} || coalesce(nd.nodes, {_q(DIAGRAM_NO_FILES)})
       || coalesce(nd.arrows, '') AS diagram
FROM (SELECT DISTINCT repo FROM sm) r LEFT JOIN nd ON nd.repo = r.repo"""


def callable_candidates() -> str:
    head = strip_sql("replace(replace(split_part(s, '(', 1), 'def ', ''), 'function ', '')")
    return f"""WITH {code_files_cte('duckdb')},
f AS (SELECT repo, path, {splitlines_sql('content')} AS arr FROM code_files WHERE {scan_pred_sql('path')}),
l AS (SELECT repo, path, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line FROM f),
c AS (SELECT repo, path, line_no, {head} AS head
      FROM (SELECT *, {strip_sql('line')} AS s FROM l)
      WHERE (starts_with(s, 'def ') OR starts_with(s, 'function ') OR contains(line, ' class ')) AND contains(s, '(')),
c2 AS (SELECT repo, path, line_no, CASE WHEN head = '' THEN '' ELSE string_split_regex(head, {_q(_WS + '+')})[-1] END AS name FROM c),
bad AS (SELECT repo, path, min(line_no) AS b FROM c2 WHERE name = '' GROUP BY repo, path)
SELECT c2.repo, c2.path, cast(c2.line_no AS INTEGER) AS line_no, c2.name
FROM c2 LEFT JOIN bad ON bad.repo = c2.repo AND bad.path = c2.path
WHERE (bad.b IS NULL OR c2.line_no < bad.b) AND c2.name <> ''"""


def sample_file_pair() -> str:
    return _scanned_metrics() + "," + _sampled(1) + """
SELECT smp.repo, smp.path AS filename, f.content AS original, sm.skeleton, sm.raw_tokens_est AS raw_tokens,
       sm.skeleton_tokens_est AS skeleton_tokens
FROM smp JOIN f ON f.repo = smp.repo AND f.path = smp.path JOIN sm ON sm.repo = smp.repo AND sm.path = smp.path"""


# ------------------------------------------------------------------ streaming, tree source

def stream_skeletons() -> str:
    from ..operators.skeleton import METRIC_COLUMNS

    return _scanned_metrics() + f"""
SELECT repo, path, skeleton, {', '.join(METRIC_COLUMNS)} FROM sm"""


def stream_scan_totals() -> str:
    return _scanned_metrics() + """
SELECT repo, count(*) AS total_files_scanned, sum(raw_tokens_est)::BIGINT AS total_raw_tokens,
       sum(skeleton_tokens_est)::BIGINT AS total_skeleton_tokens
FROM sm GROUP BY repo"""


def skeleton_map_sink() -> str:
    text = "CASE WHEN path IS NULL THEN entry[1:length(entry) - 1] ELSE entry END"
    return f"""WITH mp AS ({skeleton_map()}),
l AS (SELECT repo, unnest(string_split({text}, chr(10))) AS value FROM mp)
SELECT repo, count(*) AS n_lines, sum(length(value))::BIGINT AS n_chars,
       sum(cast('0x' || substring(md5(value), 1, 8) AS BIGINT))::BIGINT AS checksum
FROM l GROUP BY repo"""


def scan_tree_supported() -> str:
    return f"""WITH {code_files_cte('duckdb')}
SELECT repo, path, 'ok' AS status, length(content)::INTEGER AS n_chars FROM code_files WHERE {scan_pred_sql('path')}"""


def scan_tree() -> str:
    return f"WITH {code_files_cte('duckdb')}\nSELECT repo, path, content FROM code_files"


def deep_dive_samples() -> str:
    head = strip_sql("replace(replace(split_part(s, '(', 1), 'def ', ''), 'function ', '')")
    extra = f"""
scn AS (SELECT repo, path FROM code_files WHERE {scan_pred_sql('path')}),
hl AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path DESC) AS rd FROM scn),
h20 AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rank FROM hl WHERE rd <= 20),
smp AS (SELECT repo, path, rank FROM h20 WHERE rank <= 4),
dl0 AS (SELECT c.repo, c.path, s.rank, {splitlines_sql('c.content')} AS arr
        FROM code_files c JOIN smp s ON s.repo = c.repo AND s.path = c.path),
dl1 AS (SELECT repo, path, rank, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line FROM dl0),
dc AS (SELECT repo, path, rank, line_no, {head} AS head
       FROM (SELECT *, {strip_sql('line')} AS s FROM dl1)
       WHERE (starts_with(s, 'def ') OR starts_with(s, 'function ') OR contains(line, ' class ')) AND contains(s, '(')),
dc2 AS (SELECT *, CASE WHEN head = '' THEN '' ELSE string_split_regex(head, {_q(_WS + '+')})[-1] END AS name FROM dc),
dbad AS (SELECT repo, path, min(line_no) AS b FROM dc2 WHERE name = '' GROUP BY repo, path),
cc AS (SELECT dc2.repo, dc2.path, dc2.rank, dc2.line_no, dc2.name FROM dc2
       LEFT JOIN dbad ON dbad.repo = dc2.repo AND dbad.path = dc2.path
       WHERE (dbad.b IS NULL OR dc2.line_no < dbad.b) AND dc2.name <> ''),"""
    req = "SELECT DISTINCT repo, path, name AS method FROM cc"
    return _method_bodies_ctes(req, extra) + """,
acc AS (
  SELECT cc.repo, cc.path, cc.rank, cc.line_no, cc.name AS method,
         '=== METHOD BODY: ' || cc.name || ' in ' || cc.path || ' (~' || cast(m.tokens AS VARCHAR) || ' tokens) ==='
         || chr(10) || m.body AS text
  FROM cc JOIN mb2 m ON m.repo = cc.repo AND m.path = cc.path AND m.method = cc.name
  WHERE m.status = 'found'
),
acc2 AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS k
         FROM acc WHERE NOT contains(text, 'not found') AND NOT contains(text, 'Error'))
SELECT repo, cast(rank AS INTEGER) AS rank, path, cast(line_no AS INTEGER) AS line_no, method, text FROM acc2 WHERE k = 1"""


def summary_json() -> str:
    """Spark's compact JSON of the summary struct, with the last-20 history."""
    hist = scan_history_last20().replace(
        "\nSELECT repo, filename, raw_tokens, skeleton_tokens, saved_tokens, reduction_pct,\n       cast(cnt - rd + 1 AS INTEGER) AS seq",
        ",\nlh AS (SELECT repo, filename, raw_tokens, skeleton_tokens, saved_tokens, reduction_pct,\n       cast(cnt - rd + 1 AS INTEGER) AS seq",
        1,
    )
    item = ("'{\"filename\":\"' || filename || '\",\"raw_tokens\":' || cast(raw_tokens AS VARCHAR) || "
            "',\"skeleton_tokens\":' || cast(skeleton_tokens AS VARCHAR) || ',\"saved_tokens\":' || "
            "cast(saved_tokens AS VARCHAR) || ',\"reduction_pct\":' || cast(reduction_pct AS VARCHAR) || '}'")
    summ = _summary_select("sm", "repo")
    return hist + f"""),
su AS ({summ}),
hj AS (SELECT repo, '[' || string_agg({item}, ',' ORDER BY seq) || ']' AS history FROM lh GROUP BY repo)
SELECT su.repo, '{{"total_files_scanned":' || cast(total_files_scanned AS VARCHAR)
  || ',"total_raw_tokens":' || cast(total_raw_tokens AS VARCHAR)
  || ',"total_skeleton_tokens":' || cast(total_skeleton_tokens AS VARCHAR)
  || ',"selective_method_fetches":' || cast(selective_method_fetches AS VARCHAR)
  || ',"method_tokens_fetched":' || cast(method_tokens_fetched AS VARCHAR)
  || ',"total_consumed_tokens":' || cast(total_consumed_tokens AS VARCHAR)
  || ',"saved_tokens":' || cast(saved_tokens AS VARCHAR)
  || ',"reduction_pct":' || cast(reduction_pct AS VARCHAR)
  || ',"compression_ratio":"' || compression_ratio || '","history":' || coalesce(hj.history, '[]') || '}}' AS summary_json
FROM su LEFT JOIN hj ON hj.repo = su.repo"""


def repo_report() -> str:
    """The markdown report composed from the summary, diagram, deep-dive and map oracles."""
    from . import report as R

    lit = _q

    def num(x: str) -> str:
        return f"format('{{:,}}', {x})"

    def row(name: str, value: str) -> list[str]:
        return [lit(f"| {name} | "), value, lit(" |\n")]

    report = " || ".join([
        lit(R.REPORT_TITLE), "su.repo", lit(R.REPORT_TABLE),
        *row("files", "cast(su.total_files_scanned AS VARCHAR)"),
        *row("tokens as written", num("su.total_raw_tokens")),
        *row("tokens as skeletons", num("su.total_skeleton_tokens")),
        *row("tokens saved", num("su.saved_tokens")),
        *row("saved, percent", "cast(su.reduction_pct AS VARCHAR)"),
        *row("ratio", "su.compression_ratio"),
        lit(R.REPORT_MAP), "coalesce(ex.excerpt, '')", lit(R.REPORT_MAP_END),
        "CASE WHEN bb.b IS NULL THEN '' ELSE " + lit(R.REPORT_BODIES_HEAD) + " || bb.b END",
        lit(R.REPORT_DIAGRAM), "dg.diagram", lit(R.REPORT_END),
    ])
    snippet_item = " || ".join([
        lit(R.REPORT_BODY[0]), "method", lit(R.REPORT_BODY[1]), "path", lit(R.REPORT_BODY[2]),
        "substring(text, 1, 500)", lit(R.REPORT_BODY[3]),
    ])
    return f"""WITH
su AS ({repo_summary()}),
dg AS ({sequence_diagram()}),
dd AS ({deep_dive_samples()}),
mp AS ({skeleton_map()}),
bb AS (SELECT repo, string_agg({snippet_item}, '' ORDER BY k) AS b
       FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank) AS k FROM dd) WHERE k <= 3 GROUP BY repo),
mb4 AS (SELECT repo, count(*) AS n, string_agg(path || ':' || method || chr(10) || text, chr(10) || chr(10)
               ORDER BY path || ':' || method) AS t FROM dd GROUP BY repo),
sf AS ({sample_file_pair()}),
me AS (SELECT repo, string_agg(entry, chr(10) ORDER BY path) AS entries
       FROM mp WHERE path IS NOT NULL GROUP BY repo),
ex AS (SELECT h.repo, substring(h.entry || coalesce(me.entries, ''), 1, 3500) AS excerpt
       FROM (SELECT repo, entry FROM mp WHERE path IS NULL) h LEFT JOIN me ON me.repo = h.repo)
SELECT su.*, dg.diagram, {report} AS markdown_report, coalesce(mb4.n, 0)::INTEGER AS n_bodies,
       coalesce(mb4.t, '') AS method_bodies, sf.filename AS sample_filename, sf.original AS sample_original,
       sf.skeleton AS sample_skeleton, sf.raw_tokens AS sample_raw_tokens, sf.skeleton_tokens AS sample_skeleton_tokens
FROM su LEFT JOIN dg ON dg.repo = su.repo LEFT JOIN bb ON bb.repo = su.repo LEFT JOIN ex ON ex.repo = su.repo
LEFT JOIN mb4 ON mb4.repo = su.repo LEFT JOIN sf ON sf.repo = su.repo"""


def repo_report_snippet() -> str:
    return f"""WITH r AS ({repo_report()})
SELECT repo, total_files_scanned, total_raw_tokens, total_skeleton_tokens, saved_tokens, reduction_pct,
       compression_ratio, array_to_string({splitlines_sql('markdown_report')}[1:25], chr(10)) AS snippet
FROM r"""


def find_references_header() -> str:
    none_msg = "'No references found for symbol ''' || symbol || '''.'"
    found_msg = "'Found ' || cast(ref_count AS VARCHAR) || ' reference(s) to ''' || symbol || ''':'"
    return f"""WITH r AS ({find_references_multi()})
SELECT symbol, repo, CASE WHEN ref_count = 0 THEN {none_msg} ELSE {found_msg} END AS header
FROM r WHERE rank IS NULL OR rank = 1"""
