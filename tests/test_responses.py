"""Response parsing cascade: Spark expressions vs a plain-Python model of the spec."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import responses as R
from tallyspark.functions.labels import DEFAULT_CLASSES as CL


def model_parse(text: str, thinking: bool) -> str:
    """Independent Python model of the documented cascade (steps 1-6)."""
    s = text.strip()
    if thinking:
        m = re.search(R.FINAL_PATTERN, s, re.IGNORECASE)
        if m and m.group(1).lower() in CL:
            return m.group(1).lower()
        i = s.find(R.THINKING_END)
        if i >= 0:
            rest = s[i + len(R.THINKING_END):].lower()
            hit = next((c for c in CL if re.search(r"\b" + re.escape(c) + r"\b", rest)), None)
            if hit:
                return hit
    t = re.sub(R.PREFIX_PATTERN, "", s.lower())
    for c in CL:
        if re.search(r"\b" + re.escape(c) + r"\b", t) or t.strip().startswith(c):
            return c
    for c, subs in R.DEFAULT_SYNONYMS:
        if any(x in t for x in subs):
            return c
    return "LABEL_NOT_FOUND"


CASES = [
    "Final Classification: Ideation", "final classification:   behavior and more", "Final Classification: unsure",
    "<thinking>maybe attempt?</thinking> indicator", "<thinking>x</thinking></thinking> behavior",
    "The post is classified as: attempt", "Attempts", "behaviors noted", "no explicit risk",
    "none of these", "not attempt but ideation", "\n  ideation \t", "theft of a plan", "classified as behaviour",
    "This is category: indicator.", "suicidal thoughts present", "I see self-harm", "", "   ",
    " attempt ", "Ideation: strong", "café ideation", "ideationally speaking",
]


@pytest.mark.parametrize("thinking", [True, False])
def test_cascade_matches_model(spark, thinking):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, r string")
    got = {r.i: r.l for r in df.select("i", R.extract_label("r", CL, thinking=thinking).alias("l")).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == model_parse(c, thinking), (c, got[i])


def test_vocabulary_order_beats_position(spark):
    df = spark.createDataFrame([("attempt then indicator",)], "r string")
    assert df.select(R.extract_label("r", CL).alias("l")).first().l == "indicator"


def test_after_marker(spark):
    rows = [("Q ### Response: <think>indicator</think> attempt",), ("no marker attempt",),
            ("x ### Response: behavior ### Response: attempt",), ("### Response:\n<think>a\nb</think>\n nothing",)]
    df = spark.createDataFrame(rows, "r string")
    got = [r.l for r in df.select(R.extract_label_after_marker("r", "### Response:", CL).alias("l")).collect()]
    assert got == ["attempt", "LABEL_NOT_FOUND", "behavior", "LABEL_NOT_FOUND"]


def test_classify_status(spark):
    rows = [(None, None, None), (2, True, None), (3, True, None), (1, False, None), (1, True, None), (0, True, None),
            (1, True, "boom"), (None, True, None)]
    df = spark.createDataFrame(rows, "fr int, hp boolean, err string")
    got = [r.s for r in df.select(R.classify_status("fr", "hp", "err", F.lit("ok")).alias("s")).collect()]
    assert got == ["NO_CANDIDATES", "CONTENT_BLOCKED", "CONTENT_BLOCKED", "NO_CONTENT", "ok", "UNKNOWN_ERROR",
                   "API_ERROR", "ok"]


def test_render_prompt_and_missing_template(spark):
    from tallyspark.functions import prompts as PR
    prompts = spark.createDataFrame([("s", False, "A {} B"), ("s", True, "T: {}")], "style string, thinking boolean, template string")
    posts = spark.createDataFrame([(1, "x {} y", "s", False), (2, "z", "s", True)], "index long, post string, style string, thinking boolean")
    got = {r["index"]: r.prompt for r in PR.render(posts, prompts).collect()}
    assert got == {1: "A x {} y B", 2: "T: z"}
    bad = spark.createDataFrame([(3, "q", "other", False)], "index long, post string, style string, thinking boolean")
    with pytest.raises(Exception):
        PR.render(bad, prompts).collect()
    t = spark.createDataFrame([("p", "a")], "post string, label string").select(
        PR.render_training("Post: {}\nLabel: {}", "post", "label", "</s>").alias("t")).first().t
    assert t == "Post: p\nLabel: a</s>"


@pytest.mark.parametrize("thinking", [True, False])
def test_projected_cascade_equals_expression(spark, thinking):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, r string")
    a = sorted(df.select("i", R.extract_label("r", CL, thinking=thinking).alias("l")).collect())
    b = sorted(R.with_extracted_label(df, "r", "l", CL, thinking=thinking).select("i", "l").collect())
    assert a == b
