"""Synthetic source-code corpus ``code_files(repo, path, ext, content)``.

The test tables hold prose, not code, so a deterministic corpus of source files
is derived from ``part`` (one file per part) and ``lineitem`` (one method per
line item).  The SQL is shared by Spark and the DuckDB oracle; only the ordered
string aggregate is spelled differently.  It grows linearly with ``lineitem``.

Template rules (k = l_linenumber, name = run_{l_orderkey}_{l_linenumber}):
  ext by p_partkey % 5: .py .ts .java .js .md
  prefix node_modules/ when p_partkey % 11 = 0, build/ when % 13 = 0
  nested if-block when (l_orderkey + l_linenumber) % 7 = 0
  .py: decorator when k % 3 = 0, one-line def when k = 1 and l_orderkey odd,
       wrapped parameters when l_orderkey % 5 = 0, docstring when k even,
       leading comment when k odd and l_orderkey % 3 = 0, module docstring when
       p_partkey % 3 = 0, decorated class when p_partkey % 4 = 0, unbalanced
       bracket at the end (unparsable) when p_partkey % 17 = 0
  .js: async when k % 4 = 0, export when k = 2
  .java: brace on its own line when k = 3
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"

_METHOD_PY = f"""
  CASE WHEN m.l_linenumber % 3 = 0 THEN '    @staticmethod' || {_NL} ELSE '' END ||
  CASE
    WHEN m.l_linenumber = 1 AND m.l_orderkey % 2 = 1
      THEN '    def ' || m.name || '(self): return 1' || {_NL} || {_NL}
    ELSE
      CASE WHEN m.l_orderkey % 5 = 0
        THEN '    def ' || m.name || '(self, a,' || {_NL} || '            b):' || {_NL}
        ELSE '    def ' || m.name || '(self, x: int) -> int:' || {_NL} END ||
      CASE WHEN m.l_linenumber % 2 = 0 THEN '        \"\"\"Run ' || m.name || '.\"\"\"' || {_NL}
           WHEN m.l_orderkey % 3 = 0 THEN '        # compute' || {_NL}
           ELSE '' END ||
      repeat('        x = x + 1' || {_NL}, m.l_linenumber) ||
      CASE WHEN m.nested THEN '        if x > 3:' || {_NL} || '            x = x - 1' || {_NL} ELSE '' END ||
      '        return x' || {_NL} || {_NL}
  END"""

_METHOD_TS = f"""
  '  ' || m.name || '(x: number): number {{' || {_NL} ||
  repeat('    x = helper(x);' || {_NL}, m.l_linenumber) ||
  CASE WHEN m.nested THEN '    if (x > 3) {{' || {_NL} || '      x = x - 1;' || {_NL} || '    }}' || {_NL} ELSE '' END ||
  '    return x;' || {_NL} || '  }}' || {_NL}"""

_METHOD_JS = f"""
  CASE WHEN m.l_linenumber % 4 = 0 THEN 'async ' WHEN m.l_linenumber = 2 THEN 'export ' ELSE '' END ||
  'function ' || m.name || '(x) {{' || {_NL} ||
  repeat('  x = helper(x);' || {_NL}, m.l_linenumber) ||
  CASE WHEN m.nested THEN '  if (x > 3) {{' || {_NL} || '    x = x - 1;' || {_NL} || '  }}' || {_NL} ELSE '' END ||
  '  return x;' || {_NL} || '}}' || {_NL}"""

_METHOD_JAVA = f"""
  CASE WHEN m.l_linenumber = 3
    THEN '  public int ' || m.name || '(int x)' || {_NL} || '  {{' || {_NL}
    ELSE '  public int ' || m.name || '(int x) {{' || {_NL} END ||
  repeat('    x = Math.abs(x);' || {_NL}, m.l_linenumber) ||
  CASE WHEN m.nested THEN '    if (x > 3) {{' || {_NL} || '      x = x - 1;' || {_NL} || '    }}' || {_NL} ELSE '' END ||
  '    return x;' || {_NL} || '  }}' || {_NL}"""

_METHOD_MD = f"""
  'Line ' || cast(m.l_orderkey AS string) || ' ' || cast(m.l_linenumber AS string) || ': ' ||
  repeat('word ', m.l_linenumber) || {_NL}"""

_HEADER = f"""
  CASE p.ext
    WHEN '.py' THEN
      CASE WHEN p.p_partkey % 3 = 0
        THEN '\"\"\"Module part_' || cast(p.p_partkey AS string) || '.' || {_NL} || {_NL} ||
             'Generated fixture.\"\"\"' || {_NL} ELSE '' END ||
      'import os' || {_NL} || 'from typing import List' || {_NL} ||
      'LIMIT = ' || cast(p.p_size AS string) || {_NL} ||
      'CONFIG = {{' || {_NL} || '    \"size\": ' || cast(p.p_size AS string) || ',' || {_NL} || '}}' || {_NL} || {_NL} ||
      CASE WHEN p.p_partkey % 4 = 0 THEN '@dataclass' || {_NL} ELSE '' END ||
      'class Part' || cast(p.p_partkey AS string) || ':' || {_NL} ||
      '    \"\"\"Part ' || cast(p.p_partkey AS string) || ' helpers.\"\"\"' || {_NL} ||
      '    rate = 0.5' || {_NL} || {_NL}
    WHEN '.ts' THEN
      'import {{ helper }} from \"./helper\";' || {_NL} ||
      'const LIMIT = ' || cast(p.p_size AS string) || ';' || {_NL} ||
      'export class Part' || cast(p.p_partkey AS string) || ' {{' || {_NL}
    WHEN '.js' THEN
      'const helper = require(\"./helper\");' || {_NL} ||
      'const twice = (x) => {{' || {_NL} || '  return x * 2;' || {_NL} || '}};' || {_NL}
    WHEN '.java' THEN
      'package parts.' || lower(p.p_type) || ';' || {_NL} ||
      'import java.util.List;' || {_NL} ||
      'public class Part' || cast(p.p_partkey AS string) || ' {{' || {_NL}
    ELSE '# Part ' || cast(p.p_partkey AS string) || {_NL} || {_NL}
  END"""

_FOOTER = f"""
  CASE p.ext
    WHEN '.py' THEN
      'def main():' || {_NL} || '    return Part' || cast(p.p_partkey AS string) || '()' || {_NL} ||
      CASE WHEN p.p_partkey % 17 = 0 THEN 'BROKEN = (' || {_NL} ELSE '' END
    WHEN '.ts' THEN '}}' || {_NL}
    WHEN '.js' THEN 'module.exports = {{ twice }};' || {_NL}
    WHEN '.java' THEN '}}' || {_NL}
    ELSE ''
  END"""

_ORDER = "m.l_orderkey, m.l_linenumber, m.l_suppkey, m.l_extendedprice"

_AGG = {
    "spark": f"listagg(m.mtext, '') WITHIN GROUP (ORDER BY {_ORDER})",
    "duckdb": f"string_agg(m.mtext, '' ORDER BY {_ORDER})",
}

_TEMPLATE = """
WITH p AS (
  SELECT p_partkey, p_brand, p_type, p_size,
         CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java'
                            WHEN 3 THEN '.js' ELSE '.md' END AS ext,
         CASE WHEN p_partkey % 11 = 0 THEN 'node_modules/'
              WHEN p_partkey % 13 = 0 THEN 'build/' ELSE '' END AS prefix
  FROM {part}
),
mn AS (
  SELECT p.p_partkey, p.ext, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice,
         'run_' || cast(l.l_orderkey AS string) || '_' || cast(l.l_linenumber AS string) AS name,
         (l.l_orderkey + l.l_linenumber) % 7 = 0 AS nested
  FROM p JOIN {lineitem} l ON l.l_partkey = p.p_partkey
),
m AS (
  SELECT m.p_partkey, m.l_orderkey, m.l_linenumber, m.l_suppkey, m.l_extendedprice,
         CASE m.ext WHEN '.py' THEN {py} WHEN '.ts' THEN {ts} WHEN '.js' THEN {js}
                    WHEN '.java' THEN {java} ELSE {md} END AS mtext
  FROM mn m
),
b AS (
  SELECT m.p_partkey, {agg} AS body FROM m GROUP BY m.p_partkey
)
SELECT p.p_brand AS repo,
       p.prefix || lower(p.p_type) || '/part_' || cast(p.p_partkey AS string) || p.ext AS path,
       p.ext AS ext,
       {header} || coalesce(b.body, '') || {footer} AS content
FROM p LEFT JOIN b ON b.p_partkey = p.p_partkey
"""


def code_files_sql(dialect: str = "duckdb", part: str = "part", lineitem: str = "lineitem") -> str:
    """The corpus as one SQL query; ``dialect`` is ``spark`` or ``duckdb``."""
    return _TEMPLATE.format(
        part=part,
        lineitem=lineitem,
        py=_METHOD_PY,
        ts=_METHOD_TS,
        js=_METHOD_JS,
        java=_METHOD_JAVA,
        md=_METHOD_MD,
        agg=_AGG[dialect],
        header=_HEADER,
        footer=_FOOTER,
    )


_MATERIALIZED: dict[tuple[str, str], DataFrame] = {}


def build_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code_files(repo, path, ext, content)`` built by Spark from part and lineitem."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # spark.sql(..., **dfs) formats the text, so literal braces are doubled first
    text = code_files_sql("spark", part="@PART@", lineitem="@LINEITEM@")
    text = text.replace("{", "{{").replace("}", "}}").replace("@PART@", "{part}").replace("@LINEITEM@", "{lineitem}")
    return spark.sql(text, part=part, lineitem=lineitem)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as an input table: built once per session and kept persisted.

    It stands in for a stored files table, so it is spread over the cores by a
    hash of ``path`` (the skeletonizers are row-local and CPU-bound).  The
    lineage is short and deterministic, so a lost executor recomputes it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    df = _MATERIALIZED.get(key)
    if df is None:
        df = build_code_files(spark, sf_dir).repartition("path").persist(StorageLevel.MEMORY_AND_DISK)
        _MATERIALIZED[key] = df
    return df


def code_files_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus for a query that reads it a single time: nothing is persisted for it, unless it already is."""
    df = _MATERIALIZED.get((spark.sparkContext.applicationId, sf_dir))
    return build_code_files(spark, sf_dir) if df is None else df


def is_kept(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the corpus is persisted, and so spread over the cores already."""
    return (spark.sparkContext.applicationId, sf_dir) in _MATERIALIZED


_REQUESTS = """
WITH p AS (
  SELECT p_partkey, p_brand,
         CASE WHEN p_partkey % 11 = 0 THEN 'node_modules/' WHEN p_partkey % 13 = 0 THEN 'build/' ELSE '' END
         || lower(p_type) || '/part_' || cast(p_partkey AS string) ||
         CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' WHEN 3 THEN '.js' ELSE '.md' END
         AS path
  FROM {part}
)
SELECT p.p_brand AS repo, p.path AS path,
       'run_' || cast(l.l_orderkey AS string) || '_' || cast(l.l_linenumber AS string) AS method
FROM p JOIN {lineitem} l ON l.l_partkey = p.p_partkey
UNION ALL SELECT p_brand, path, 'missing_' || cast(p_partkey AS string) FROM p
UNION ALL SELECT p_brand, path || '.bak', 'main' FROM p
"""


def method_requests_sql(part: str = "part", lineitem: str = "lineitem") -> str:
    """Method lookups: every line item asks for its method; each part also asks
    for a method that does not exist and for a file that does not exist."""
    return _REQUESTS.format(part=part, lineitem=lineitem)


def method_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(method_requests_sql("{part}", "{lineitem}"), part=part, lineitem=lineitem)


def code_files_cte(dialect: str = "duckdb") -> str:
    """``code_files AS (...)`` for use inside a WITH clause of an oracle query."""
    return f"code_files AS ({code_files_sql(dialect)})"
