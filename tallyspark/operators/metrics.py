"""Classification metrics as relational plans (AGG1-AGG12, FLT2, AGG25-AGG27).

Design: the only data-sized step is one partial+final aggregation of the input
into *confusion cells* ``(group..., true_label, predicted_label, n)``. Cells are
a sufficient statistic for accuracy, per-class precision/recall/F1, macro and
weighted averages and the run counters, so everything after the first shuffle
works on at most ``groups x labels^2`` rows. Each metric is one linear chain
(input -> cells -> per-label stats -> one row per group): no joins and no
second scan of the input, and all label-set variants come out of one aggregate.

Semantics follow scikit-learn with ``zero_division=0``: support(c) counts rows
with true == c, predicted(c) counts rows with pred == c (over all rows, also
rows whose other side is outside the label list), F1 = 2tp / (support + predicted).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.labels import (API_ERROR, CONTENT_BLOCKED, DEFAULT_CLASSES, LABEL_NOT_FOUND,
                                         NO_CANDIDATES, NO_CONTENT, SENTINELS)

LABEL_SETS = ("fixed", "true", "union")


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Driver-side schema check (PRJ4): fail early with the missing names."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {df.columns}")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_cells(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label",
                    group_cols: Sequence[str] = (), weight_col: str | None = None) -> DataFrame:
    """Long confusion table over *all* label pairs (map-side combined count).

    ``weight_col`` counts each row that many times: metrics can then run on
    pre-aggregated cells (``weight_col='n'``) or on bootstrap weights.
    """
    require_columns(df, [true_col, pred_col, *group_cols, *([weight_col] if weight_col else [])])
    n = F.sum(F.col(weight_col)).cast("long") if weight_col else F.count(F.lit(1))
    return (df.groupBy(*group_cols, F.col(true_col).cast("string").alias("true_label"),
                       F.col(pred_col).cast("string").alias("predicted_label"))
            .agg(n.alias("n")))


def exclude_status(df: DataFrame, pred_col: str = "predicted_label",
                   excluded: Sequence[str] = SENTINELS) -> DataFrame:
    """Drop rows whose prediction is a sentinel (FLT2). NULL predictions are kept."""
    return df.where(~F.coalesce(F.col(pred_col).isin(list(excluded)), F.lit(False)))


def confusion_from_cells(cells: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """Dense K x K matrix (AGG2): rows true, columns pred, pairs outside the list dropped.

    Cells are folded into one map per group (at most labels^2 entries) and the
    K x K grid is generated from it, so densifying needs no join.
    """
    g = list(group_cols)
    key = F.concat_ws("\u0001", F.col("true_label"), F.col("predicted_label"))
    inlist = F.col("true_label").isin(list(classes)) & F.col("predicted_label").isin(list(classes))
    m = cells.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.when(inlist, F.struct(key, F.col("n"))))).alias("_m"))
    pairs = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"))
                      for t in classes for p in classes])
    x = m.select(*g, "_m", F.explode(pairs).alias("cell")).select(*g, "_m", "cell.*")
    n = F.try_element_at(F.col("_m"), F.concat_ws("\u0001", F.col("true_label"), F.col("predicted_label")))
    return x.select(*g, "true_label", "predicted_label", F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def confusion(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
              pred_col: str = "predicted_label", group_cols: Sequence[str] = (), weight_col: str | None = None) -> DataFrame:
    return confusion_from_cells(confusion_cells(df, true_col, pred_col, group_cols, weight_col), classes, group_cols)


def confusion_wide(conf: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """Display form of a dense matrix: one row per true label, one column per class."""
    return (conf.groupBy(*group_cols, "true_label").pivot("predicted_label", list(classes))
            .agg(F.sum("n")).fillna(0))


def _stat_fields(counters: Sequence[tuple[str, Column]]) -> list[str]:
    return ["support", "pred_n", "tp", "total"] + [name for name, _ in counters]


def label_stats(cells: DataFrame, group_cols: Sequence[str] = (), valid: Column | None = None,
                counters: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Per (group, label): tp, support (true count), pred_n (predicted count) over *valid*
    cells, plus ``total`` and named counters over all cells (counted on the true side).

    Each cell is exploded into its true side and its predicted side, then one
    aggregation sums them: no join, and the NULL label row keeps the row total.
    """
    g = list(group_cols)
    n = F.col("n")
    nv = n if valid is None else F.when(valid, n).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    hit = F.col("true_label") == F.col("predicted_label")
    true_side = F.struct(F.col("true_label").alias("label"), nv.cast("long").alias("support"), zero.alias("pred_n"),
                         F.when(hit, nv).otherwise(F.lit(0)).cast("long").alias("tp"), n.cast("long").alias("total"),
                         *[F.when(cond, n).otherwise(F.lit(0)).cast("long").alias(name) for name, cond in counters])
    pred_side = F.struct(F.col("predicted_label").alias("label"), zero.alias("support"), nv.cast("long").alias("pred_n"),
                         zero.alias("tp"), zero.alias("total"), *[zero.alias(name) for name, _ in counters])
    sides = cells.select(*g, F.explode(F.array(true_side, pred_side)).alias("s")).select(*g, "s.*")
    return sides.groupBy(*g, "label").agg(*[F.sum(c).cast("long").alias(c) for c in _stat_fields(counters)])


def class_stats(cells: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, label) tp / support / pred_n (labels never NULL)."""
    return label_stats(cells, group_cols).where(F.col("label").isNotNull()).select(
        *group_cols, "label", "tp", "support", "pred_n")


def _prf(tp: Column, sup: Column, pn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, pn), _ratio(tp, sup), _ratio(2 * tp, sup + pn)


def _in_set(label_set: str, classes: Sequence[str]) -> Column:
    lab, sup, pn = F.col("label"), F.col("support"), F.col("pred_n")
    if label_set == "fixed":
        return F.coalesce(lab.isin(list(classes)), F.lit(False))
    if label_set == "true":
        return lab.isNotNull() & (sup > 0)
    if label_set == "union":
        return lab.isNotNull() & ((sup + pn) > 0)
    raise ValueError(f"label_set must be one of {LABEL_SETS}")


def _set_aggs(label_set: str, classes: Sequence[str], suffix: str = "") -> list[Column]:
    inset = _in_set(label_set, classes)
    p, r, f = _prf(F.col("tp"), F.col("support"), F.col("pred_n"))
    k = F.lit(len(classes)) if label_set == "fixed" else F.count_if(inset)
    sup_in = F.sum(F.when(inset, F.col("support")).otherwise(F.lit(0)))

    def macro(x: Column) -> Column:
        return _ratio(F.sum(F.when(inset, x).otherwise(F.lit(0.0))), k)

    def wavg(x: Column) -> Column:
        return _ratio(F.sum(F.when(inset, x * F.col("support")).otherwise(F.lit(0.0))), sup_in)

    return [macro(f).alias(f"f1_macro{suffix}"), macro(p).alias(f"precision_macro{suffix}"),
            macro(r).alias(f"recall_macro{suffix}"), wavg(f).alias(f"f1_weighted{suffix}"),
            wavg(p).alias(f"precision_weighted{suffix}"), wavg(r).alias(f"recall_weighted{suffix}"),
            sup_in.cast("long").alias(f"support{suffix}")]


def group_metrics(stats: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, group_cols: Sequence[str] = (),
                  label_sets: dict[str, str] | None = None, counters: Sequence[str] = (),
                  with_stats_map: bool = False) -> DataFrame:
    """One row per group: n (valid rows), accuracy, macro / weighted P/R/F1 for each
    requested label set (``{suffix: label_set}``) and the counters, from ``label_stats``."""
    sets = label_sets or {"": "fixed"}
    aggs = [F.sum("support").cast("long").alias("n"), _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            F.sum("total").cast("long").alias("total")]
    for suffix, ls in sets.items():
        aggs += _set_aggs(ls, classes, suffix)
    aggs += [F.sum(c).cast("long").alias(c) for c in counters]
    if with_stats_map:
        entry = F.when(F.col("label").isNotNull(), F.struct(F.col("label"), F.struct("tp", "support", "pred_n")))
        aggs.append(F.map_from_entries(F.collect_list(entry)).alias("stats"))
    return stats.groupBy(*group_cols).agg(*aggs)


def _class_rows(grp: DataFrame, classes: Sequence[str], group_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per-class rows for a fixed vocabulary from the group row's stats map (absent class -> zeros)."""
    g = list(group_cols)
    x = grp.select(*g, *keep, "stats", F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("class_pos", "label"))
    st = F.try_element_at(F.col("stats"), F.col("label"))
    tp = F.coalesce(st["tp"], F.lit(0)).cast("long")
    sup = F.coalesce(st["support"], F.lit(0)).cast("long")
    pn = F.coalesce(st["pred_n"], F.lit(0)).cast("long")
    p, r, f = _prf(tp, sup, pn)
    return x.select(*g, *keep, "label", F.col("class_pos").cast("int").alias("class_pos"), p.alias("precision"),
                    r.alias("recall"), f.alias("f1"), sup.alias("support"), tp.alias("tp"), pn.alias("pred_n"))


def per_class_from_cells(cells: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
                         group_cols: Sequence[str] = (), label_set: str = "fixed") -> DataFrame:
    """Per-class precision / recall / F1 / support over a label set (AGG4, AGG9, LBL11).

    label_set: 'fixed' = ``classes`` (absent classes get zero rows); 'true' = labels
    present in the true column; 'union' = labels present on either side.
    """
    g = list(group_cols)
    stats = label_stats(cells, g)
    if label_set == "fixed":
        return _class_rows(group_metrics(stats, classes, g, with_stats_map=True), classes, g)
    st = stats.where(_in_set(label_set, classes))
    p, r, f = _prf(F.col("tp"), F.col("support"), F.col("pred_n"))
    return st.select(*g, "label", F.lit(None).cast("int").alias("class_pos"), p.alias("precision"), r.alias("recall"),
                     f.alias("f1"), "support", "tp", "pred_n")


def per_class(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
              pred_col: str = "predicted_label", group_cols: Sequence[str] = (),
              label_set: str = "fixed", weight_col: str | None = None) -> DataFrame:
    return per_class_from_cells(confusion_cells(df, true_col, pred_col, group_cols, weight_col), classes, group_cols,
                                label_set)


def averages_from_per_class(per: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Macro (AGG5) and support-weighted (AGG6) averages of a per-class table."""
    g = list(group_cols)
    sup = F.sum("support")
    return per.groupBy(*g).agg(
        F.avg("f1").alias("f1_macro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), sup).alias("f1_weighted"),
        _ratio(F.sum(F.col("precision") * F.col("support")), sup).alias("precision_weighted"),
        _ratio(F.sum(F.col("recall") * F.col("support")), sup).alias("recall_weighted"),
    )


def accuracy_from_cells(cells: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact-match share over all rows (AGG3), with the row count."""
    g = list(group_cols)
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0))
    return cells.groupBy(*g).agg(F.sum("n").cast("long").alias("n"), _ratio(F.sum(hit), F.sum("n")).alias("accuracy"))


_SUMMARY = ("n", "accuracy", "f1_macro", "precision_macro", "recall_macro", "f1_weighted", "precision_weighted",
            "recall_weighted")


def summary_from_cells(cells: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES,
                       group_cols: Sequence[str] = (), label_set: str = "fixed") -> DataFrame:
    g = list(group_cols)
    gm = group_metrics(label_stats(cells, g), classes, g, {"": label_set})
    return gm.select(*g, *_SUMMARY)


def summary(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
            pred_col: str = "predicted_label", group_cols: Sequence[str] = (),
            label_set: str = "fixed", weight_col: str | None = None) -> DataFrame:
    """n, accuracy, macro and weighted P/R/F1 per group (AGG3-AGG6): one aggregation chain."""
    return summary_from_cells(confusion_cells(df, true_col, pred_col, group_cols, weight_col), classes, group_cols,
                              label_set)


def macro(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
          pred_col: str = "predicted_label", group_cols: Sequence[str] = (), label_set: str = "fixed") -> DataFrame:
    return summary(df, classes, true_col, pred_col, group_cols, label_set).select(
        *group_cols, "f1_macro", "precision_macro", "recall_macro")


def weighted(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
             pred_col: str = "predicted_label", group_cols: Sequence[str] = (), label_set: str = "fixed") -> DataFrame:
    return summary(df, classes, true_col, pred_col, group_cols, label_set).select(
        *group_cols, "f1_weighted", "precision_weighted", "recall_weighted")


def classification_report(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
                          pred_col: str = "predicted_label", group_cols: Sequence[str] = (),
                          digits: int | None = None, weight_col: str | None = None) -> DataFrame:
    """Per-class rows + 'accuracy', 'macro avg', 'weighted avg' rows (AGG7).

    ``row_order`` keeps the printed order (classes, accuracy, macro, weighted).
    """
    g = list(group_cols)
    cells = confusion_cells(df, true_col, pred_col, g, weight_col)
    grp = group_metrics(label_stats(cells, g), classes, g, with_stats_map=True)
    k = len(classes)
    rows = _class_rows(grp, classes, g)
    class_rows = rows.select(*g, F.col("label").alias("row_label"), F.col("class_pos").alias("row_order"),
                             "precision", "recall", F.col("f1").alias("f1_score"), "support")
    summary_rows = grp.select(*g, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row_label"), F.lit(k).alias("row_order"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1_score"), F.col("n").alias("support")),
        _report_row("macro avg", k + 1, "precision_macro", "recall_macro", "f1_macro"),
        _report_row("weighted avg", k + 2, "precision_weighted", "recall_weighted", "f1_weighted"),
    )).alias("r")).select(*g, "r.*")
    out = class_rows.unionByName(summary_rows)
    if digits is not None:
        out = out.select(*g, "row_label", "row_order", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")], "support")
    return out


def _report_row(label: str, order: int, p: str, r: str, f: str) -> Column:
    return F.struct(F.lit(label).alias("row_label"), F.lit(order).alias("row_order"), F.col(p).alias("precision"),
                    F.col(r).alias("recall"), F.col(f).alias("f1_score"), F.col("support").alias("support"))


def run_summary(df: DataFrame, classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
                pred_col: str = "predicted_label", group_cols: Sequence[str] = (),
                excluded: Sequence[str] = SENTINELS, run_ts: str | None = None, weight_col: str | None = None) -> DataFrame:
    """One summary row per run (AGG8): outcome counters and metrics over non-excluded rows.

    Single chain: input -> cells -> label stats (sentinel cells weigh 0 for the
    metrics but feed the counters) -> one row per group. Zero valid rows gives
    0.0 for every metric. ``run_ts`` (``yyyy-MM-dd HH:mm:ss``) is injected rather
    than read from the clock, so reruns are reproducible (DTE1).
    """
    g = list(group_cols)
    cells = confusion_cells(df, true_col, pred_col, g, weight_col)
    p = F.col("predicted_label")
    valid = ~F.coalesce(p.isin(list(excluded)), F.lit(False))
    counters = [("api_errors_count", p == API_ERROR), ("content_blocked_count", p == CONTENT_BLOCKED),
                ("no_content_count", p == NO_CONTENT), ("no_candidates_count", p == NO_CANDIDATES),
                ("labels_not_found_in_response", p == LABEL_NOT_FOUND)]
    stats = label_stats(cells, g, valid, counters)
    gm = group_metrics(stats, classes, g, {"": "fixed"}, [c for c, _ in counters])
    gm = gm.fillna(0, ["total", "n", *[c for c, _ in counters]])  # no rows at all: every counter is 0
    zero = F.lit(0.0)
    cols = [*g]
    if run_ts is not None:
        cols.append(F.date_format(F.to_timestamp(F.lit(run_ts)), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return gm.select(
        *cols,
        F.col("total").alias("total_posts"),
        F.col("total").alias("api_calls_attempted"),
        (F.col("total") - F.col("api_errors_count")).alias("api_calls_succeeded"),
        "api_errors_count", "content_blocked_count", "no_content_count", "no_candidates_count",
        "labels_not_found_in_response", F.col("n").alias("valid_predictions_for_metrics"),
        *[F.when(F.col("n") > 0, F.coalesce(F.col(c), zero)).otherwise(zero).alias(c)
          for c in ("accuracy", "f1_macro", "f1_weighted", "precision_weighted", "recall_weighted")],
    )


def class_distribution(df: DataFrame, label_col: str = "label", group_cols: Sequence[str] = (),
                       sort: bool = False) -> DataFrame:
    """Class counts and proportions, NULL labels excluded (AGG1).

    The total comes from the aggregated table (at most groups x labels rows);
    ``sort`` orders that small table by count descending for display.
    """
    g = list(group_cols)
    counts = df.where(F.col(label_col).isNotNull()).groupBy(*g, F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    out = counts.select(*g, "label", "n", (F.col("n") / F.sum("n").over(w)).alias("proportion"))
    return out.orderBy(*g, F.desc("n"), "label") if sort else out


def agreement_count(a: DataFrame, b: DataFrame, key: str = "index", label_col: str = "predicted_label") -> DataFrame:
    """Rows where two tables give the same label for a key (AGG12 / JN9)."""
    j = a.select(key, F.col(label_col).alias("_a")).join(b.select(key, F.col(label_col).alias("_b")), key)
    return j.agg(F.count(F.lit(1)).alias("n_common"),
                 F.count_if(F.col("_a") == F.col("_b")).alias("n_same"))


def evaluate(df: DataFrame, classes: Sequence[str] | None = None, true_col: str = "label",
             pred_col: str = "predicted_label", group_cols: Sequence[str] = ()) -> DataFrame:
    """Evaluation bundle (AGG10): n, accuracy, weighted and macro over the union label set."""
    cells = confusion_cells(df, true_col, pred_col, group_cols)
    return summary_from_cells(cells, classes or DEFAULT_CLASSES, group_cols, "union")


def evaluate_rows(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label", group_cols: Sequence[str] = ()) -> DataFrame:
    """The whole evaluation bundle (AGG10): (section, name, precision, recall, value, n), in printed order by ``place``.

    ``size``: number of rows; ``class``: share and number of rows of each true label, most
    frequent first; ``metric``: accuracy, weighted and macro F1 over the labels that occur on either side;
    ``report``: precision, recall, F1 (``value``) and support of each of these, and their averages.
    Rows without a true or predicted label count in the size only. An empty table has size 0 and nothing else;
    with ``group_cols`` each group has its bundle. One scan and two small aggregations.
    """
    g = list(group_cols)
    stats = label_stats(confusion_cells(df, true_col, pred_col, g), g)
    one = F.struct("label", "support", "pred_n", "tp")
    per = stats.groupBy(*g).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("_n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("_hits"),
                                F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), one))).alias("_l"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    def row(section: str, name: Column | str, value: Column | None, n: Column, precision: Column | None = None, recall: Column | None = None) -> Column:
        none = F.lit(None).cast("double")
        cells = [F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name")]
        cells += [(none if c is None else c.cast("double")).alias(k) for k, c in (("precision", precision), ("recall", recall), ("value", value))]
        return F.struct(*cells, n.cast("long").alias("n"))

    def scores(x: Column) -> tuple[Column, Column, Column]:
        return ratio(x["tp"], x["pred_n"]), ratio(x["tp"], x["support"]), ratio(2 * x["tp"], x["support"] + x["pred_n"])
    labels, n = F.col("_l"), F.col("_n")
    support = F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x["support"])

    def mean(k: int, weighted: bool) -> Column:
        total = F.aggregate(labels, F.lit(0.0), lambda a, x: a + scores(x)[k] * (x["support"] if weighted else F.lit(1)))
        return ratio(total, support if weighted else F.size(labels))
    classes = F.array_sort(F.filter(labels, lambda x: x["support"] > 0), lambda a, b: F.when(a["support"] != b["support"], F.sign(b["support"] - a["support"])).when(
        a["label"] < b["label"], -1).otherwise(1).cast("int"))
    rows = F.concat(
        F.array(row("size", "rows", None, n)),
        F.transform(classes, lambda x: row("class", x["label"], ratio(x["support"], support), x["support"])),
        F.when(n > 0, F.array(row("metric", "accuracy", ratio(F.col("_hits"), n), n), row("metric", "weighted_f1", mean(2, True), support),
                              row("metric", "macro_f1", mean(2, False), support))).otherwise(F.array()),
        F.transform(labels, lambda x: row("report", x["label"], scores(x)[2], x["support"], scores(x)[0], scores(x)[1])),
        F.when(n > 0, F.array(*[row("report", f"{kind} avg", mean(2, kind == "weighted"), support, mean(0, kind == "weighted"), mean(1, kind == "weighted"))
                                for kind in ("macro", "weighted")])).otherwise(F.array()))
    return per.select(*g, F.posexplode(rows).alias("place", "r")).select(*g, "place", "r.*")


# --- soft / probabilistic evaluation aggregates (AGG25-AGG27) ----------------------------

def soft_f1_cost(df: DataFrame, probs_col: str, true_idx_col: str, n_classes: int,
                 group_cols: Sequence[str] = (), eps: float = 1e-7) -> DataFrame:
    """Macro soft-F1 cost ``1 - mean_c 2tp/(2tp+fp+fn+eps)`` with soft counts (AGG25).

    Per-class soft counts are computed with one aggregation over the K array slots.
    """
    g = list(group_cols)
    y = F.col(true_idx_col)
    aggs = []
    for c in range(n_classes):
        p = F.element_at(F.col(probs_col), c + 1)
        yc = F.when(y == c, F.lit(1.0)).otherwise(F.lit(0.0))
        aggs += [F.sum(p * yc).alias(f"tp{c}"), F.sum(p * (1 - yc)).alias(f"fp{c}"), F.sum((1 - p) * yc).alias(f"fn{c}")]
    s = df.groupBy(*g).agg(*aggs)
    f1s = [(2 * F.col(f"tp{c}")) / (2 * F.col(f"tp{c}") + F.col(f"fp{c}") + F.col(f"fn{c}") + F.lit(eps))
           for c in range(n_classes)]
    mean = f1s[0]
    for f in f1s[1:]:
        mean = mean + f
    return s.select(*g, (F.lit(1.0) - mean / n_classes).alias("soft_f1_cost"))


def log_loss(df: DataFrame, probs_col: str, true_idx_col: str, group_cols: Sequence[str] = (),
             eps: float = 1e-15) -> DataFrame:
    """Mean cross-entropy of the true class probability (AGG26)."""
    p_true = F.element_at(F.col(probs_col), F.col(true_idx_col).cast("int") + 1)
    return df.groupBy(*group_cols).agg(F.avg(-F.log(F.greatest(p_true, F.lit(eps)))).alias("log_loss"))


def ordinal_bce(df: DataFrame, logits_col: str, target_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """BCE-with-logits averaged over rows x (K-1) thresholds (AGG27), numerically stable form."""
    terms = F.zip_with(F.col(logits_col), F.col(target_col),
                       lambda z, y: F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))
    row_sum = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return df.groupBy(*group_cols).agg((F.sum(row_sum) / F.sum(F.size(F.col(logits_col)))).alias("ordinal_bce"))
