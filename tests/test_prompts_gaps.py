"""Prompt assembly (P11), message compression (P12) and gap collapse with any keep rule (K5)."""

import math
import time

from pyspark.sql import functions as F

from codeskel.operators.prompts import assemble_prompts, compress_messages
from codeskel.operators.python import collapse_dropped
from codeskel.functions.text import split_lines


def _ceil_tokens(t):
    return 0 if not t else max(1, math.ceil(len(t) / 3.8))


def test_prompt_assembly_markers_and_tokens(spark):
    df = spark.createDataFrame([("  be brief \n", "class A:\n    ...\n")], "system string, skeleton string")
    r = assemble_prompts(df).first()
    assert r.cached_prompt == (
        "=== [CACHE_BOUNDARY: SYSTEM_PROMPT] ===\nbe brief\n\n"
        "=== [CACHE_BOUNDARY: REPO_SKELETON] ===\nclass A:\n    ...\n\n"
        "=== [CACHE_BOUNDARY: USER_CONTEXT_START] ===\n"
    )
    assert (r.system_tokens, r.skeleton_tokens) == (_ceil_tokens("  be brief \n"), _ceil_tokens("class A:\n    ...\n"))


def test_compress_only_long_messages_of_role(spark):
    long_text = "\n".join(f"line {i} " + "x" * 40 for i in range(40))
    rows = [(1, 0, "tool", long_text), (1, 1, "tool", "short"), (1, 2, "user", long_text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    out = {r.turn: r for r in compress_messages(df).collect()}
    head = "\n".join(long_text.splitlines()[:5])
    assert out[0].content == (
        f"[Tool Output: Compressed {len(long_text.splitlines())} lines (~{_ceil_tokens(long_text)} tokens)]\n{head}\n..."
    )
    assert out[1].content == "short" and out[2].content == long_text
    assert [out[t].compressed for t in (0, 1, 2)] == [True, False, False]


def test_gap_collapse(spark):
    text = "keep this long line\nx\n  y\nkeep another long one\n\nz\n"
    df = spark.createDataFrame([(text,)], "t string").withColumn("l", split_lines(F.col("t")))
    keep = F.transform(F.col("l"), lambda ln: F.length(ln) >= 10)
    got = df.select(collapse_dropped(F.col("l"), keep).alias("s")).first().s
    marker = "...  # [Body compressed: 2 lines]"
    assert got == f"keep this long line\n    {marker}\nkeep another long one\n    {marker}"


def test_gaps_look_at_each_line_once(spark):
    """Eight times the lines take at most about eight times as long (flags computed anew for every line: 64 times)."""
    def seconds(n):
        text = "\n".join(["a", "b" * 50] * (n // 2))
        df = spark.createDataFrame([(text,)], "text string").select(F.split("text", "\n").alias("ln"))
        keep = F.transform("ln", lambda x: F.length(F.trim(x)) >= 40)
        t = time.time()
        (row,) = df.select(collapse_dropped(F.col("ln"), keep).alias("s")).collect()
        assert row.s.count("Body compressed: 1 lines") == n // 2
        return time.time() - t

    seconds(100)
    small, large = seconds(1_000), seconds(8_000)
    assert large < 12 * small + 2
