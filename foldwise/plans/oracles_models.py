"""DuckDB oracle SQL, part 3: what is deterministic in the model queries."""

from __future__ import annotations

from .oracles import EMB, EMB_DIMS, confusion_sql, folds, metrics_sql, rule_view_sql, with_

F_ = [f"f{i + 1}" for i in range(EMB_DIMS)]


def _moments(src: str, name: str) -> str:
    """Mean and scale of every column per context, one row each."""
    cols = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN var_pop({c}) > 0 THEN sqrt(var_pop({c})) ELSE 1.0 END AS s_{c}" for c in F_)
    return f"{name} AS (SELECT ctx, {cols} FROM {src} GROUP BY ctx)"


def _scaled(src: str, mom: str, name: str) -> str:
    cols = ", ".join(f"(r.{c} - m.m_{c}) / m.s_{c} AS {c}" for c in F_)
    return f"{name} AS (SELECT r.* EXCLUDE ({', '.join(F_)}), {cols} FROM {src} r JOIN {mom} m ON r.ctx = m.ctx)"


MANHATTAN = "round(" + " + ".join(f"abs(t.{c} - c.{c})" for c in F_) + ", 9)"
EUCLIDEAN = "round(sqrt(" + " + ".join(f"(t.{c} - c.{c}) * (t.{c} - c.{c})" for c in F_) + "), 9)"


def _neighbours(queries: str, rows: str, on: str, name: str, most: int = 11) -> str:
    """The nearest rows of every query row, by both metrics."""
    return f"""{name}_d AS (SELECT t.ctx, t.grp, t.row_key, t.label, c.row_key AS ck, c.label AS cl,
    {EUCLIDEAN} AS euclidean, {MANHATTAN} AS manhattan FROM {queries} t JOIN {rows} c ON t.ctx = c.ctx AND {on}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, ctx, grp, row_key ORDER BY dist, ck) AS r
    FROM (UNPIVOT {name}_d ON euclidean, manhattan INTO NAME metric VALUE dist)) WHERE r <= {most})"""


def _votes(src: str, name: str) -> str:
    return f"""{name}_v AS (SELECT metric, k, ctx, grp, row_key, label, cl, count(*) AS votes
    FROM {src} JOIN (SELECT unnest([3, 5, 7, 9, 11]) AS k) ks ON r <= k GROUP BY ALL),
{name} AS (SELECT metric, k, ctx, grp, row_key, label, cl AS prediction FROM (SELECT *, row_number() OVER (
    PARTITION BY metric, k, ctx, grp, row_key ORDER BY votes DESC, cl) AS rn FROM {name}_v) WHERE rn = 1)"""


BEST = """scores AS (SELECT ctx, metric, k, avg(f1) AS score FROM (SELECT ctx, metric, k, grp, avg(f1) AS f1 FROM vm_per
    GROUP BY ALL) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(score, 9) DESC, metric, k) = 1 AS is_best FROM scores)"""

CONTEXTS = [EMB, folds("emb", "ef"),
            "cx AS (SELECT CAST(c.ctx AS INTEGER) AS ctx, e.* FROM ef e JOIN range(10) c(ctx) ON e.fold <> c.ctx)",
            """rk AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY md5('42|' || ctx || '|' || CAST(row_key AS VARCHAR)), row_key) AS rk,
    count(*) OVER (PARTITION BY ctx) AS gn FROM cx)"""]

_search = [*CONTEXTS, "hv AS (SELECT *, rk <= ceil(gn * CAST(0.1 AS DOUBLE)) AS is_val, 0 AS grp FROM rk)",
           _moments("(SELECT * FROM hv WHERE NOT is_val)", "mi"), _scaled("hv", "mi", "hs"),
           _neighbours("(SELECT * FROM hs WHERE is_val)", "(SELECT * FROM hs WHERE NOT is_val)", "TRUE", "vn"),
           _votes("vn", "vp"), confusion_sql("vp", ["ctx", "metric", "k", "grp"], "vc"),
           metrics_sql("vc", ["ctx", "metric", "k", "grp"], "vm"), BEST]

_test = [_moments("cx", "mo"),
         "tx AS (SELECT fold AS ctx, 0 AS grp, * FROM ef)", _scaled("tx", "mo", "ts"),
         "cg AS (SELECT *, 0 AS grp FROM cx)", _scaled("cg", "mo", "cs"),
         _neighbours("ts", "cs", "TRUE", "tn"), _votes("tn", "tp"),
         "ch AS (SELECT p.* FROM tp p JOIN ranked b ON b.is_best AND p.ctx = b.ctx AND p.metric = b.metric AND p.k = b.k)",
         confusion_sql("ch", ["ctx", "k", "metric"], "tc"), metrics_sql("tc", ["ctx", "k", "metric"], "tm")]

ORACLES: dict[str, str] = {}
ORACLES["knn_cv"] = with_(*_search, *_test) + """SELECT CAST(ctx + 1 AS INTEGER) AS fold, accuracy, macro_f1 AS f1,
  '{"metric": "' || metric || '", "n_neighbors": ' || k || '}' AS parameters, k AS best_k, metric AS best_metric FROM tm"""

# Inner folds of each context; every inner fold is scaled by the others' moments
_inner = [*CONTEXTS, "kf AS (SELECT *, CAST((rk - 1) % 9 AS INTEGER) AS inner_fold FROM rk)",
          "kc AS (SELECT k.* EXCLUDE (ctx), k.ctx * 9 + i.grp AS ctx, i.grp, k.ctx AS outer_ctx FROM kf k CROSS JOIN range(9) i(grp))",
          _moments("(SELECT * FROM kc WHERE inner_fold <> grp)", "mi"), _scaled("kc", "mi", "ks_"),
          _neighbours("(SELECT * FROM ks_ WHERE inner_fold = grp)", "(SELECT * FROM ks_ WHERE inner_fold <> grp)", "TRUE", "vn"),
          _votes("vn", "vp0"), "vp AS (SELECT * EXCLUDE (ctx), (ctx - grp) // 9 AS ctx FROM vp0)",
          confusion_sql("vp", ["ctx", "metric", "k", "grp"], "vc"),
          metrics_sql("vc", ["ctx", "metric", "k", "grp"], "vm"), BEST]
ORACLES["knn_inner_kfold"] = with_(*_inner) + \
    "SELECT CAST(ctx AS INTEGER) AS ctx, metric, k, round(score, 6) AS score, is_best FROM ranked"

ORACLES["predict_proba_sums"] = with_(EMB, folds("emb", "ef")) + """SELECT row_key, label,
  (SELECT count(DISTINCT label) FROM ef WHERE fold <> 0) AS n_classes, TRUE AS in_range, 1.0 AS proba_sum
  FROM ef WHERE fold = 0"""
ORACLES["model_registry_list"] = "SELECT 'phase1' AS phase, 'emb' AS dataset, 'DT, RF' AS classifiers"
ORACLES["final_test_sizes"] = with_(*rule_view_sql()) + """SELECT dataset, count(*) FILTER (WHERE fold <> 0) AS train_rows,
  count(*) FILTER (WHERE fold = 0) AS test_rows, count(DISTINCT label) FILTER (WHERE fold <> 0) AS num_classes,
  4 AS num_features FROM rv GROUP BY dataset"""

