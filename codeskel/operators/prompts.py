"""Prompt assembly with cache boundaries (P11) and message compression.

Both are row-local column expressions: no shuffle, stream-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, split_lines, tokens_ceil

# --- fixed values ---------------------------------------------------------
BOUNDARY = "=== [CACHE_BOUNDARY: {name}] ==="
BOUNDARY_NAMES = ("SYSTEM_PROMPT", "REPO_SKELETON", "USER_CONTEXT_START")
COMPRESS_ROLE = "tool"
COMPRESS_MIN_CHARS = 1000
KEEP_HEAD_LINES = 5
# --------------------------------------------------------------------------


def _boundary(name: str) -> str:
    return BOUNDARY.format(name=name)


def assemble_prompts(df: DataFrame, system: str = "system", skeleton: str = "skeleton") -> DataFrame:
    """Add ``cached_prompt``, ``system_tokens``, ``skeleton_tokens``.

    Token counts are taken on the unstripped inputs, the prompt holds the
    stripped parts between the three boundary markers.
    """
    sys_c, sk_c = F.coalesce(F.col(system), F.lit("")), F.coalesce(F.col(skeleton), F.lit(""))
    prompt = F.concat(
        F.lit(_boundary(BOUNDARY_NAMES[0]) + "\n"),
        py_strip(sys_c),
        F.lit("\n\n" + _boundary(BOUNDARY_NAMES[1]) + "\n"),
        py_strip(sk_c),
        F.lit("\n\n" + _boundary(BOUNDARY_NAMES[2]) + "\n"),
    )
    return df.withColumn("cached_prompt", prompt).withColumn("system_tokens", tokens_ceil(F.col(system))).withColumn(
        "skeleton_tokens", tokens_ceil(F.col(skeleton))
    )


def compress_messages(
    df: DataFrame, role: str = COMPRESS_ROLE, limit: int = COMPRESS_MIN_CHARS, content: str = "content"
) -> DataFrame:
    """Shorten long messages of ``role``: a summary line, the first 5 lines, ``...``.

    Order and all other messages are unchanged.
    """
    c = F.col(content)
    lines = split_lines(c)
    summary = F.concat(
        F.lit("[Tool Output: Compressed "),
        F.size(lines).cast("string"),
        F.lit(" lines (~"),
        tokens_ceil(c).cast("string"),
        F.lit(" tokens)]\n"),
        F.array_join(F.slice(lines, 1, KEEP_HEAD_LINES), "\n"),
        F.lit("\n..."),
    )
    hit = (F.col("role") == role) & (F.length(c) > limit)
    return df.withColumn("compressed", hit).withColumn(content, F.when(hit, summary).otherwise(c))
