"""DuckDB SQL twins of ``plans.views`` (used only by the oracle).

Each entry is a CTE body; ``with_views(...)`` prepends the ones a query needs,
in dependency order.
"""

from __future__ import annotations

CLS = "['indicator','ideation','behavior','attempt']"

def _sums(n: int) -> str:
    """List of n sums of a vector: of the values whose 0-based position mod n is 0 to n - 1."""
    return "[" + ", ".join(f"list_sum(CAST(embedding[{r + 1}:len(embedding):{n}] AS DOUBLE[]))" for r in range(n)) + "]"


VIEWS: dict[str, str] = {
    "posts_labeled": """
        SELECT d.doc_id AS "index", d.text AS post,
               CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'attempt' WHEN l.toxic = 1 THEN 'behavior'
                    WHEN l.quality = 0 THEN 'ideation' ELSE 'indicator' END AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "posts_unlabeled": """
        SELECT d.doc_id AS "index", d.text AS post FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "predictions": f"""
        SELECT m.model, p."index", p.post, p.label,
               CASE WHEN (p."index" * 7 + m.model * 13) % 97 = 0 THEN 'LABEL_NOT_FOUND'
                    WHEN (p."index" * m.mult + m.model) % 10 < 7 THEN p.label
                    ELSE {CLS}[(p."index" + m.model) % 4 + 1] END AS predicted_label
        FROM posts_labeled p CROSS JOIN (VALUES (0, 3), (1, 7), (2, 9), (3, 11), (4, 13)) m(model, mult)""",
    "predictions_large": """
        SELECT l_linestatus, l_returnflag AS label,
               CASE WHEN (l_orderkey + l_linenumber) % 10 < 7 THEN l_returnflag
                    ELSE ['A','N','R'][l_partkey % 3 + 1] END AS predicted_label
        FROM lineitem""",
    "raw_sheet": f"""
        SELECT conv_id * 4096 + turn AS row_pos, CASE WHEN turn = 0 THEN conv_id END AS idx, text AS title,
               CASE WHEN turn = 0 THEN {CLS}[conv_id % 4 + 1] ELSE 'ignored' END AS label
        FROM conversations""",
    "logits": f"""
        SELECT vec_id AS "index", {_sums(4)} AS logits,
               {_sums(3)} AS ord_logits, CAST(label % 4 AS INTEGER) AS true_idx
        FROM embeddings""",
    "run_metrics": """
        SELECT run, CAST(ep AS DOUBLE) AS epoch, step,
               10.0 / (v + 10) AS eval_loss, v / (v + 9) AS eval_accuracy, v / (v + 10) AS eval_f1_weighted,
               v / (v + 11) AS eval_precision_weighted, v / (v + 9) AS eval_recall_weighted,
               12.0 / (v + 12) AS train_loss, 0.00005 / ep AS learning_rate
        FROM (SELECT CAST(user_id % 5 + 1 AS INTEGER) AS run, floor(event_id / 100) + 1 AS ep,
                     max(event_id) AS step, avg(value) AS v
              FROM events GROUP BY ALL)""",
    "run_metrics_frac": """
        SELECT run, CAST(ep AS DOUBLE) - 0.0093 * run AS epoch, step,
               10.0 / (v + 10) AS eval_loss, v / (v + 9) AS eval_accuracy, v / (v + 10) AS eval_f1_weighted,
               v / (v + 11) AS eval_precision_weighted, v / (v + 9) AS eval_recall_weighted,
               12.0 / (v + 12) AS train_loss, 0.00005 / ep AS learning_rate
        FROM (SELECT CAST(user_id % 5 + 1 AS INTEGER) AS run, floor(event_id / 100) + 1 AS ep,
                     max(event_id) AS step, avg(value) AS v
              FROM events GROUP BY ALL)""",
    "run_log": """
        SELECT CAST(user_id % 5 AS INTEGER) AS run, event_id AS pos,
               CASE WHEN event_type IN ('purchase', 'error') THEN 'eval' ELSE 'train' END AS kind,
               event_id / 50.0 AS epoch, event_id AS step,
               CASE WHEN event_type NOT IN ('purchase', 'error') THEN value END AS loss,
               CASE WHEN event_type NOT IN ('purchase', 'error') THEN value / 1000.0 END AS learning_rate,
               CASE WHEN event_type IN ('purchase', 'error') THEN value END AS eval_loss,
               CASE WHEN event_type IN ('purchase', 'error') THEN value / (value + 10) END AS eval_f1_weighted
        FROM events""",
    "responses": """
        SELECT "index", label,
               replace(['Final Classification: {L}', '<thinking>attempt?</thinking> {L}',
                        'The post is classified as: {L}', '{L}s', 'no explicit mention', 'none of these',
                        'not attempt but ideation', chr(10) || '  {L} ' || chr(9)]["index" % 8 + 1], '{L}', label)
                 AS response,
               CASE WHEN "index" % 17 <> 0 THEN CAST("index" // 3 % 5 AS INTEGER) END AS finish_reason,
               CASE WHEN "index" % 17 <> 0 THEN "index" % 11 <> 0 END AS has_parts,
               CASE WHEN "index" % 13 = 0 THEN 'timeout' END AS error
        FROM (SELECT "index" * 5 + model AS "index", label FROM predictions)""",
}

DEPENDS = {
    "predictions": ["posts_labeled"],
    "responses": ["posts_labeled", "predictions"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views (and their dependencies) once each."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
