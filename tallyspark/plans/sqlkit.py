"""Small SQL builders for the DuckDB oracle (metric CTE chains over confusion cells)."""

from __future__ import annotations

from collections.abc import Sequence

SENTINEL_SQL = ("('LABEL_NOT_FOUND','API_ERROR','CONTENT_BLOCKED','NO_CONTENT','NO_CANDIDATES',"
                "'UNKNOWN_ERROR','API_ERROR_OR_EXTRACTION_FAILED')")


def values_list(items: Sequence[str], col: str = "label", pos: bool = False) -> str:
    if pos:
        rows = ", ".join(f"('{c}', {i})" for i, c in enumerate(items))
        return f"(VALUES {rows}) v({col}, class_pos)"
    rows = ", ".join(f"('{c}')" for c in items)
    return f"(VALUES {rows}) v({col})"


def cells(src: str, g: str, t: str = "label", p: str = "predicted_label", where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    return (f"SELECT {g}, CAST({t} AS VARCHAR) AS true_label, CAST({p} AS VARCHAR) AS predicted_label, "
            f"count(*) AS n FROM {src} {w} GROUP BY ALL")


def stats(cells_name: str, g: str) -> str:
    return f"""SELECT {g}, label, sum(tp) AS tp, sum(sup) AS support, sum(pn) AS pred_n FROM (
        SELECT {g}, true_label AS label, CASE WHEN true_label = predicted_label THEN n ELSE 0 END AS tp, n AS sup, 0 AS pn
        FROM {cells_name}
        UNION ALL SELECT {g}, predicted_label AS label, 0 AS tp, 0 AS sup, n AS pn FROM {cells_name}
    ) WHERE label IS NOT NULL GROUP BY ALL"""


def per_class(cells_name: str, stats_name: str, g: str, classes: Sequence[str], label_set: str = "fixed") -> str:
    gcols = [c.strip() for c in g.split(",")]
    using = ", ".join(gcols + ["label"])
    if label_set == "fixed":
        base = (f"SELECT grp.*, v.label, v.class_pos FROM (SELECT DISTINCT {g} FROM {cells_name}) grp "
                f"CROSS JOIN {values_list(classes, pos=True)}")
        src = f"(SELECT b.*, s.tp, s.support, s.pred_n FROM ({base}) b LEFT JOIN {stats_name} s USING ({using}))"
    elif label_set == "true":
        src = f"(SELECT *, NULL::INTEGER AS class_pos FROM {stats_name} WHERE support > 0)"
    else:
        src = f"(SELECT *, NULL::INTEGER AS class_pos FROM {stats_name})"
    return f"""SELECT {g}, label, class_pos,
        coalesce(coalesce(tp, 0)::DOUBLE / nullif(coalesce(pred_n, 0), 0), 0.0) AS precision,
        coalesce(coalesce(tp, 0)::DOUBLE / nullif(coalesce(support, 0), 0), 0.0) AS recall,
        coalesce(2.0 * coalesce(tp, 0) / nullif(coalesce(support, 0) + coalesce(pred_n, 0), 0), 0.0) AS f1,
        CAST(coalesce(support, 0) AS BIGINT) AS support
        FROM {src}"""


def averages(per_name: str, g: str) -> str:
    return f"""SELECT {g}, avg(f1) AS f1_macro, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
        coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0) AS f1_weighted,
        coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0) AS precision_weighted,
        coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0) AS recall_weighted
        FROM {per_name} GROUP BY ALL"""


def accuracy(cells_name: str, g: str) -> str:
    return f"""SELECT {g}, CAST(sum(n) AS BIGINT) AS n,
        coalesce(sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END)::DOUBLE / nullif(sum(n), 0), 0.0) AS accuracy
        FROM {cells_name} GROUP BY ALL"""


def metric_chain(src: str, g: str, classes: Sequence[str], label_set: str = "fixed", t: str = "label",
                 p: str = "predicted_label", where: str = "", prefix: str = "") -> str:
    """CTE fragments ``{prefix}cells, {prefix}stats, {prefix}per, {prefix}avg, {prefix}acc``."""
    c, s, pc, a, ac = (f"{prefix}{x}" for x in ("cells", "stats", "per", "avg", "acc"))
    return (f"{c} AS ({cells(src, g, t, p, where)}),\n{s} AS ({stats(c, g)}),\n"
            f"{pc} AS ({per_class(c, s, g, classes, label_set)}),\n{a} AS ({averages(pc, g)}),\n"
            f"{ac} AS ({accuracy(c, g)})")


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr}"
