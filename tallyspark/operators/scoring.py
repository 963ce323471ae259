"""Batch scoring with a user model (SCR1-SCR4).

The scorer is any ``fn(list[str]) -> array[n, K]`` of logits, built once per
task by a user factory (model load), fed Arrow batches by ``mapInPandas`` and
sub-batched to ``batch_size`` texts. Failures are isolated per row (SCR3): a
failing sub-batch is retried row by row and a failing row becomes an
``API_ERROR`` row with ``success = False`` instead of failing the job.
Scorer output is expensive and may be non-deterministic: materialise it
(``sinks.append_predictions`` / checkpoint) before using it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.labels import API_ERROR, DEFAULT_CLASSES
from tallyspark.session import ship_package
from tallyspark.sources.attempts import AttemptLog

ScorerFactory = Callable[[], Callable[[list[str]], np.ndarray]]
ResponderFactory = Callable[[], Callable[[list[str]], list[str]]]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def score_table(df: DataFrame, scorer_factory: ScorerFactory, classes: Sequence[str] = DEFAULT_CLASSES,
                text_col: str = "post", id_col: str = "index", batch_size: int = 16,
                keep: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """-> (id, keep..., predicted_label, probs ARRAY<DOUBLE>, success, error) (SCR1, SCR3).

    The input's own partitions are scored side by side; give ``partitions`` to deal the rows out anew
    (one shuffle) where few files hold much work.
    """
    cls = list(classes)
    ship_package(df.sparkSession)
    keep = [c for c in keep if c not in (id_col, text_col)]
    src = df.select(id_col, text_col, *keep)
    if partitions:
        src = src.repartition(partitions)
    dtypes = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            n = len(texts)
            probs: list = [None] * n
            errors: list = [None] * n
            for lo in range(0, n, batch_size):
                chunk = texts[lo:lo + batch_size]
                try:
                    z = np.asarray(scorer(chunk), dtype=float).reshape(len(chunk), len(cls))
                    p = _softmax(z)
                    for j in range(len(chunk)):
                        probs[lo + j] = p[j].tolist()
                except Exception:  # noqa: BLE001 - isolate the failing row(s)
                    for j, t in enumerate(chunk):
                        try:
                            z = np.asarray(scorer([t]), dtype=float).reshape(1, len(cls))
                            probs[lo + j] = _softmax(z)[0].tolist()
                        except Exception as e:  # noqa: BLE001
                            errors[lo + j] = f"ERROR: {type(e).__name__} - {e}"
            pred = [cls[int(np.argmax(p))] if p is not None else API_ERROR for p in probs]
            out = pdf[[id_col, *keep]].copy()
            out["predicted_label"] = pred
            out["probs"] = probs
            out["success"] = [e is None for e in errors]
            out["error"] = errors
            yield out

    schema = ", ".join([f"`{id_col}` {dtypes[id_col]}"] + [f"`{c}` {dtypes[c]}" for c in keep]
                       + ["predicted_label string", "probs array<double>", "success boolean", "error string"])
    return src.mapInPandas(run, schema)


def resume_score(todo: DataFrame, existing: DataFrame, scorer_factory: ScorerFactory,
                 classes: Sequence[str] = DEFAULT_CLASSES, text_col: str = "post", id_col: str = "index",
                 batch_size: int = 16, retry_errors: bool = False) -> DataFrame:
    """Score only ids not yet in ``existing`` and return existing + new (SCR2, JN3).

    Failed rows in ``existing`` are kept (not retried) unless ``retry_errors``.
    The id key is cast to the source's type before the anti join. ``existing`` is read twice:
    give a written table, not a scoring plan.
    """
    ex = existing if not retry_errors else existing.where(F.col("success"))
    key_t = todo.schema[id_col].dataType
    done = ex.select(F.col(id_col).cast(key_t).alias(id_col)).distinct()
    new = score_table(todo.join(done, id_col, "left_anti"), scorer_factory, classes, text_col, id_col, batch_size)
    return ex.select(*new.columns).unionByName(new)


def read_latest(spark, path: str, id_col: str = "index") -> DataFrame:
    """An append-only prediction table, one row per id (successful attempts win).

    Tasks are at-least-once, so a retried task may have appended the same id
    twice; the de-duplication makes the sink idempotent on read.
    """
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c != id_col]
    best = F.max_by(F.struct(*cols), F.struct(F.col("success").cast("int"), F.col("predicted_label")))
    return df.groupBy(id_col).agg(best.alias("_r")).select(id_col, "_r.*")


def resume_score_to(todo: DataFrame, path: str, scorer_factory: ScorerFactory,
                    classes: Sequence[str] = DEFAULT_CLASSES, text_col: str = "post", id_col: str = "index",
                    batch_size: int = 16, retry_errors: bool = False, batch: str | None = None) -> DataFrame:
    """Durable resumable scoring (SCR2 + SNK3): score the ids that the attempt log at ``path`` doesn't
    have, append them, and return one row per id with its number of ``attempts``.

    Failed rows are attempts too; they are tried again only with ``retry_errors``. Safe to rerun
    after a crash; a ``batch`` that is named and run again replaces its own rows.
    """
    log = AttemptLog(todo.sparkSession, path, id_col)
    new = score_table(log.unseen(todo.dropDuplicates([id_col]), retry_errors, batch), scorer_factory, classes, text_col, id_col, batch_size)
    log.append(new, batch)
    return log.latest()


def respond(df: DataFrame, responder_factory: ResponderFactory, prompt_col: str = "prompt", id_col: str = "index",
            batch_size: int = 16, keep: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Text in, text out (a hosted or local generator supplied by the caller) with
    per-row failure isolation -> (id, keep..., response, error)."""
    ship_package(df.sparkSession)
    keep = [c for c in keep if c not in (id_col, prompt_col)]
    src = df.select(id_col, prompt_col, *keep)
    if partitions:
        src = src.repartition(partitions)
    dtypes = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = responder_factory()
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").astype(str).tolist()
            resp: list = [None] * len(prompts)
            errs: list = [None] * len(prompts)
            for lo in range(0, len(prompts), batch_size):
                chunk = prompts[lo:lo + batch_size]
                try:
                    resp[lo:lo + len(chunk)] = list(responder(chunk))
                except Exception:  # noqa: BLE001
                    for j, t in enumerate(chunk):
                        try:
                            resp[lo + j] = responder([t])[0]
                        except Exception as e:  # noqa: BLE001
                            errs[lo + j] = f"ERROR: {type(e).__name__} - {e}"
            out = pdf[[id_col, *keep]].copy()
            out["response"] = resp
            out["error"] = errs
            yield out

    schema = ", ".join([f"`{id_col}` {dtypes[id_col]}"] + [f"`{c}` {dtypes[c]}" for c in keep]
                       + ["response string", "error string"])
    return src.mapInPandas(run, schema)


def evaluate_responder(df: DataFrame, prompts: DataFrame, responder_factory: ResponderFactory,
                       classes: Sequence[str] = DEFAULT_CLASSES, thinking_col: str = "thinking",
                       true_col: str = "label", id_col: str = "index") -> DataFrame:
    """Render -> respond -> parse -> predictions table (SCR4); feed it to ``metrics.run_summary``."""
    from tallyspark.functions import prompts as PR
    from tallyspark.functions import responses as R
    rendered = PR.render(df, prompts)
    r = respond(rendered, responder_factory, "prompt", id_col, keep=[true_col, thinking_col])
    r = R.with_extracted_label(r, "response", "_lt", classes, thinking=True)
    r = R.with_extracted_label(r, "response", "_lp", classes, thinking=False)
    parsed = F.when(F.col(thinking_col), F.col("_lt")).otherwise(F.col("_lp"))
    label = F.when(F.col("error").isNotNull(), F.lit(API_ERROR)).otherwise(parsed)
    return r.select(id_col, true_col, F.coalesce(F.col("response"), F.col("error")).alias("predicted_text"),
                    label.alias("predicted_label"), F.col("error").isNull().alias("success"))


# --- deterministic reference scorers (tests, examples, oracle checks) ----------------------

class LengthScorer:
    """Closed-form logits ``((len(text) + 31 k) mod 97) / 10`` — reproducible in SQL."""

    def __init__(self, n_classes: int = 4):
        self.k = n_classes

    def __call__(self, texts: list[str]) -> np.ndarray:
        n = np.array([len(t) for t in texts], dtype=np.int64)[:, None]
        return ((n + 31 * np.arange(self.k)[None, :]) % 97) / 10.0


def length_scorer_factory(n_classes: int = 4) -> Callable[[], LengthScorer]:
    return lambda: LengthScorer(n_classes)


class FailingLengthScorer(LengthScorer):
    """Fails on texts whose length is a multiple of 50."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        for t in texts:
            if len(t) % 50 == 0:
                raise ValueError(f"no answer for {len(t)} characters")
        return super().__call__(texts)


def failing_scorer_factory(n_classes: int = 4) -> Callable[[], FailingLengthScorer]:
    return lambda: FailingLengthScorer(n_classes)


class LengthResponder:
    """Answers ``Final Classification: <class[len(prompt) mod K]>``."""

    def __init__(self, classes: Sequence[str] = DEFAULT_CLASSES):
        self.classes = list(classes)

    def __call__(self, prompts: list[str]) -> list[str]:
        return [f"Final Classification: {self.classes[len(p) % len(self.classes)]}" for p in prompts]
