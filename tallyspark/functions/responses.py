"""Free-text model responses -> class labels, as column expressions (TXT1-TXT3, TXT7).

No Python worker is involved: each parser is one ``coalesce`` of regex /
substring tests generated from the (ordered) class vocabulary, so precedence is
vocabulary order, not position in the text. Python's ``\\b \\w \\s`` and
``str.strip`` are Unicode-aware; the Java patterns use ``(?U)`` to match.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.labels import (API_ERROR, CONTENT_BLOCKED, DEFAULT_CLASSES, LABEL_NOT_FOUND,
                                         NO_CANDIDATES, NO_CONTENT, UNKNOWN_ERROR)

# The response-parsing patterns and fallback keyword rules of the
# default vocabulary (class -> substrings that imply it, tried in this order).
FINAL_PATTERN = r"final classification:\s*([a-zA-Z]+)"
THINKING_END = "</thinking>"
PREFIX_PATTERN = r"^(the|this|post|is|classified|as|category|:|\s)+"
DEFAULT_SYNONYMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("indicator", ("indicator", "no explicit")),
    ("ideation", ("ideation", "suicidal thought")),
    ("behavior", ("behavior", "self-harm", "plan")),
    ("attempt", ("attempt", "suicide attempt")),
)
THINK_BLOCK = r"(?s)<think>.*?</think>"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _quote(s: str) -> str:
    """Literal text inside a Java regex."""
    return "\\Q" + s + "\\E" if "\\E" not in s else "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def ustrip(col: Column) -> Column:
    """Unicode-aware ``str.strip()`` (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def _whole_word(text: Column, word: str) -> Column:
    return text.rlike(r"(?U)\b" + _quote(word.lower()) + r"\b")


def default_rules(classes: Sequence[str]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    if tuple(classes) == DEFAULT_CLASSES:
        return DEFAULT_SYNONYMS
    return tuple((c, (c.lower(),)) for c in classes)


def _rules(classes: Sequence[str], synonyms) -> list:
    if isinstance(synonyms, Mapping):
        return list(synonyms.items())
    return list(synonyms or default_rules(classes))


def _cascade(s: Column, t: Column, ts: Column, classes: Sequence[str], thinking: bool, rules: list) -> Column:
    """The label cascade over the stripped text ``s``, the prefix-stripped lower text ``t``
    and its stripped form ``ts`` (see ``extract_label``)."""
    steps: list[Column] = []
    if thinking:
        g = F.lower(F.regexp_extract(s, "(?iU)" + FINAL_PATTERN, 1))
        steps.append(F.when(g.isin([c for c in classes]), g))
        pos = F.instr(s, THINKING_END)
        after = F.lower(s.substr(pos + len(THINKING_END), F.lit(1 << 30)))
        found = None
        for c in classes:
            found = (F.when(_whole_word(after, c), F.lit(c)) if found is None
                     else found.when(_whole_word(after, c), F.lit(c)))
        steps.append(F.when(pos > 0, found))
    word = None
    for c in classes:
        cond = _whole_word(t, c) | ts.startswith(F.lit(c.lower()))
        word = F.when(cond, F.lit(c)) if word is None else word.when(cond, F.lit(c))
    steps.append(word)
    kw = None
    for c, subs in rules:
        cond = None
        for sub in subs:
            one = F.contains(t, F.lit(sub))
            cond = one if cond is None else (cond | one)
        kw = F.when(cond, F.lit(c)) if kw is None else kw.when(cond, F.lit(c))
    if kw is not None:
        steps.append(kw)
    return F.coalesce(*steps, F.lit(LABEL_NOT_FOUND))


def extract_label(col: str | Column, classes: Sequence[str] = DEFAULT_CLASSES, thinking: bool = False,
                  synonyms: Sequence[tuple[str, Sequence[str]]] | Mapping[str, Sequence[str]] | None = None) -> Column:
    """Class label from a free-text response (TXT1; TXT2 is ``thinking=False``).

    1. (thinking) ``Final Classification: <word>`` if the word is a class;
    2. (thinking) after the first ``</thinking>``: first class (vocabulary order) as a whole word;
    3. lower-case, strip a run of filler prefixes (no word boundary, as in the source rule);
    4. first class matching as a whole word or as the start of the text (plurals);
    5. keyword rules in order; 6. ``LABEL_NOT_FOUND``.
    For large tables prefer ``with_extracted_label``, which projects the shared
    intermediate texts once per row.
    """
    s = ustrip(_c(col))
    t = F.regexp_replace(F.lower(s), "(?U)" + PREFIX_PATTERN, "")
    return _cascade(s, t, ustrip(t), classes, thinking, _rules(classes, synonyms))


def with_extracted_label(df, col: str, out_col: str, classes: Sequence[str] = DEFAULT_CLASSES,
                         thinking: bool = False, synonyms=None):
    """``df`` + ``out_col`` = ``extract_label(col)``, with the stripped / lower-cased /
    prefix-stripped texts projected once as columns instead of recomputed inside
    every branch of the cascade."""
    x = df.withColumn("_rsp_s", ustrip(F.col(col)))
    x = x.withColumn("_rsp_t", F.regexp_replace(F.lower(F.col("_rsp_s")), "(?U)" + PREFIX_PATTERN, ""))
    x = x.withColumn("_rsp_ts", ustrip(F.col("_rsp_t")))
    lab = _cascade(F.col("_rsp_s"), F.col("_rsp_t"), F.col("_rsp_ts"), classes, thinking, _rules(classes, synonyms))
    return x.withColumn(out_col, lab).drop("_rsp_s", "_rsp_t", "_rsp_ts")


def extract_label_after_marker(col: str | Column, marker: str, classes: Sequence[str] = DEFAULT_CLASSES) -> Column:
    """Generative-model parse (TXT3): text after ``marker`` (up to a second marker),
    ``<think>...</think>`` blocks removed, first class (vocabulary order) that occurs
    as a substring; no marker or no class -> ``LABEL_NOT_FOUND``."""
    parts = F.split(_c(col), _quote(marker))
    seg = F.when(F.size(parts) >= 2, F.element_at(parts, 2))
    body = ustrip(F.regexp_replace(ustrip(seg), THINK_BLOCK, ""))
    found = None
    for c in classes:
        cond = F.contains(body, F.lit(c))
        found = F.when(cond, F.lit(c)) if found is None else found.when(cond, F.lit(c))
    return F.coalesce(found, F.lit(LABEL_NOT_FOUND))


def marker_found(col: str | Column, marker: str) -> Column:
    return F.contains(_c(col), F.lit(marker))


def classify_status(finish_reason: str | Column, has_parts: str | Column, error: str | Column,
                    parsed_label: Column) -> Column:
    """Provider finish state -> label or status sentinel (TXT7).

    error -> API_ERROR; no finish state and no parts info -> NO_CANDIDATES;
    2 (safety) / 3 (recitation) -> CONTENT_BLOCKED; 1 (stop) or unknown state
    with parts -> parsed label, without parts -> NO_CONTENT; other -> UNKNOWN_ERROR.
    """
    fr, hp, err = _c(finish_reason), _c(has_parts), _c(error)
    return (F.when(err.isNotNull(), F.lit(API_ERROR))
            .when(fr.isNull() & hp.isNull(), F.lit(NO_CANDIDATES))
            .when(fr.isin(2, 3), F.lit(CONTENT_BLOCKED))
            .when(fr.isNull() | (fr == 1), F.when(F.coalesce(hp, F.lit(False)), parsed_label).otherwise(F.lit(NO_CONTENT)))
            .otherwise(F.lit(UNKNOWN_ERROR)))
