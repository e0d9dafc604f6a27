"""File-table sources: scan filters (S2, S3, S5), decoding (S4), repo references.

The primary input is a table ``files(repo, path, content)`` -- one row per file
of many repositories.  Filters are column predicates, so on a parquet/Delta
files table they are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_utf8_ignore, normalize_newlines, py_strip
from ..operators.skeleton import file_ext

# --- fixed values ---------------------------------------------------------
# Directory names whose subtrees are skipped by the scans.
IGNORED_DIRS = ("venv", ".git", "__pycache__", "node_modules", ".gemini", "dist", "build", ".idea", ".vscode")
# Extensions picked up by the skeleton scan.
SUPPORTED_EXTS = (".py", ".ts", ".js", ".tsx", ".jsx", ".java", ".cpp", ".cs")
# Hosts whose bare "host/..." references get an https:// prefix.
URL_HOSTS = ("github.com", "gitlab.com")
# --------------------------------------------------------------------------


def parent_dir(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def is_ignored_dir(dir_col: Column) -> Column:
    """Any component of the (``\\`` -> ``/``) directory is an ignored name."""
    parts = F.split(F.translate(dir_col, "\\", "/"), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def scan_filter(path: str = "path", root: Column | None = None, supported_only: bool = True) -> Column:
    """S2 + S3 as one predicate over the repo-relative ``path``.

    ``root`` (optional) is the directory the walk started from; the directory
    test sees ``root/dir`` so a repo under an ignored directory is skipped.
    """
    d = parent_dir(path)
    if root is not None:
        d = F.concat_ws("/", root, d)
    cond = ~F.coalesce(is_ignored_dir(d), F.lit(False))
    if supported_only:
        cond = cond & file_ext(path).isin(*SUPPORTED_EXTS)
    return cond


def scan_supported_files(files: DataFrame, root: Column | None = None) -> DataFrame:
    """Files the skeleton scan would read, with their extension."""
    return files.filter(scan_filter("path", root)).withColumn("ext", file_ext("path"))


def relative_path(full_path, root) -> Column:
    """Os.path.relpath for paths under ``root``."""
    fp = F.col(full_path) if isinstance(full_path, str) else full_path
    r = F.regexp_replace(F.col(root) if isinstance(root, str) else root, "/+$", "")
    under = fp.startswith(F.concat(r, F.lit("/")))
    return F.when(under, F.substring(fp, F.length(r) + 2, 1 << 30)).otherwise(fp)


def decode_content(binary_col: str = "content_bytes") -> Column:
    """UTF-8 decode dropping bad bytes, then text-mode newlines."""
    return normalize_newlines(decode_utf8_ignore(F.col(binary_col)))


def repo_ref_normalise(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Classify references as URL or local path and derive the repo name."""
    raw = F.col(ref)
    t = py_strip(F.coalesce(raw, F.lit("")))
    t = F.when(t == "", F.lit(".")).otherwise(t)
    is_url = (
        t.startswith("http://")
        | t.startswith("https://")
        | t.startswith("git@")
        | t.contains(URL_HOSTS[0])
        | t.contains(URL_HOSTS[1])
        | t.endswith(".git")
    )
    bare = t.startswith(URL_HOSTS[0] + "/") | t.startswith(URL_HOSTS[1] + "/")
    url = F.when(bare, F.concat(F.lit("https://"), t)).otherwise(t)
    url_name = F.replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), F.lit(".git"), F.lit(""))
    # local: basename of the absolute path; "." and "/" edge cases keep the path itself
    local = F.regexp_replace(t, "/+$", "")
    local_name = F.element_at(F.split(local, "/"), -1)
    local_name = F.when(local_name == "", t).otherwise(local_name)
    return refs.select(
        raw.alias("ref"),
        is_url.alias("is_url"),
        F.when(is_url, url).alias("url"),
        F.when(is_url, url_name).otherwise(local_name).alias("repo_name"),
    )
