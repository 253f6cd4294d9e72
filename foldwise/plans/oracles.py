"""DuckDB oracle SQL for the registered queries.

Each string runs on the pre-registered driver tables.  The labelled views
and the fold assignment are written here as plain SQL (global windows), so
they check the skew-safe Spark forms against the textbook definitions.
"""

from __future__ import annotations

from .rules import LI_FEATURES, RULES, PHASE_AFTER, PHASE_BEFORE

EMB_DIMS = 64

LI = """li AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
                   strftime(l_shipdate, '%Y-%m-%d')) AS row_key,
         l_returnflag AS label,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity,
         l_extendedprice AS extendedprice, l_discount AS discount,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE l_tax END AS tax,
         l_suppkey AS suppkey
  FROM lineitem)"""

EMB = "emb AS (SELECT vec_id AS row_key, label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i + 1}" for i in range(EMB_DIMS)) + " FROM embeddings)"

ORD = """ord AS (SELECT o_orderkey AS row_key, o_orderpriority AS label, o_totalprice AS totalprice,
  CAST(o_custkey % 100 AS DOUBLE) AS cust_mod FROM orders)"""

DOC = """doc AS (SELECT d.doc_id AS row_key, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS n_chars,
  CAST(length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), ' ', '')) + 1 AS DOUBLE) AS n_words,
  CAST(length(regexp_replace(coalesce(d.text, ''), '[^0-9]', '', 'g')) AS DOUBLE) AS n_digits,
  CAST(length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) + 1 AS DOUBLE) AS n_lines
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EV = """ev AS (SELECT event_id AS row_key, event_type AS label, value, CAST(user_id AS DOUBLE) AS user_id,
  CAST(NULLIF(regexp_extract(props, '(\\d+)', 1), '') AS DOUBLE) AS k FROM events)"""


def folds(src: str, name: str = "f", group: str = "", seed: int = 42, n: int = 10) -> str:
    """E1 as the textbook global window: fold = (class offset + rank - 1) mod n."""
    g = f"{group}, " if group else ""
    pg = f"PARTITION BY {group} " if group else ""
    return f"""{name} AS (
  SELECT * EXCLUDE (_rn, _coff), CAST((_coff + _rn - 1) % {n} AS INTEGER) AS fold FROM (
    SELECT s.*,
      row_number() OVER (PARTITION BY {g}label ORDER BY md5('{seed}|' || CAST(row_key AS VARCHAR)), row_key) AS _rn,
      count(*) OVER ({pg}ORDER BY label RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - count(*) OVER (PARTITION BY {g}label) AS _coff
    FROM {src} s))"""


def rr(num: str, den: str, d: int = 4) -> str:
    """Half-up ratio rounding with integer arithmetic (same rule as metrics.ratio_round)."""
    return f"(floor(({2 * 10 ** d} * ({num}) + ({den})) / (2 * ({den}))) / {float(10 ** d)})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def moments_sql(src: str, features: list[str], name: str = "mom", n: int = 10) -> str:
    """Training moments per fold context, straight from the rows of the other folds."""
    parts = []
    for i, c in enumerate(features):
        parts.append(f"""SELECT x.ctx, '{c}' AS feature, {i} AS feature_idx, count(*) AS n_rows, count({c}) AS n,
      avg({c}) AS mean,
      CASE WHEN count({c}) = 0 THEN 0.0 ELSE sqrt(coalesce(var_pop({c}), 0) * count({c}) / count(*)) END AS std
    FROM (SELECT s.*, c.ctx FROM {src} s JOIN range({n}) c(ctx) ON s.fold <> c.ctx) x GROUP BY x.ctx""")
    body = "\n    UNION ALL\n    ".join(parts)
    return f"""{name} AS (SELECT *, CASE WHEN std > 0 THEN std ELSE 1.0 END AS scale FROM (
    {body}))"""


def rule_view_sql() -> list[str]:
    return [LI, "lid AS (SELECT *, CAST(suppkey % 16 + 1 AS INTEGER) AS dataset FROM li)",
            folds("lid", "rv", group="dataset")]


def rule_preds_sql() -> str:
    sel = "\n  UNION ALL ".join(
        f"SELECT row_key, dataset, fold, label, '{ph}' AS phase, '{clf}' AS classifier, {sql} AS prediction FROM rv"
        for (clf, ph), (sql, _) in RULES.items())
    return f"preds AS ({sel})"


def confusion_sql(src: str, group: list[str], name: str = "conf") -> str:
    g = ", ".join(group)
    gg = f"{g}, " if g else ""
    return f"{name} AS (SELECT {gg}label AS actual, prediction AS predicted, count(*) AS n FROM {src} GROUP BY ALL)"


def metrics_sql(conf: str, group: list[str], name: str = "met") -> str:
    g = ", ".join(group)
    gg = f"{g}, " if g else ""
    j = " AND ".join(f"a.{c} = b.{c}" for c in group) or "TRUE"
    return f"""{name}_sides AS (
  SELECT {gg}actual AS label, n AS n_actual, 0 AS n_pred, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM {conf}
  UNION ALL SELECT {gg}predicted AS label, 0, n, 0 FROM {conf}),
{name}_per AS (SELECT {gg}label, CAST(sum(n_actual) AS BIGINT) AS support, CAST(sum(n_pred) AS BIGINT) AS n_pred,
  CAST(sum(tp) AS BIGINT) AS tp,
  CASE WHEN sum(n_pred) > 0 THEN sum(tp) / sum(n_pred) ELSE 0.0 END AS precision,
  CASE WHEN sum(n_actual) > 0 THEN sum(tp) / sum(n_actual) ELSE 0.0 END AS recall,
  CASE WHEN sum(n_actual) + sum(n_pred) > 0 THEN 2.0 * sum(tp) / (sum(n_actual) + sum(n_pred)) ELSE 0.0 END AS f1
  FROM {name}_sides GROUP BY ALL),
{name} AS (SELECT a.*, b.macro_f1, b.n_labels FROM
  (SELECT {gg}{rr('sum(CASE WHEN actual = predicted THEN n ELSE 0 END)', 'sum(n)')} AS accuracy,
          CAST(sum(n) AS BIGINT) AS n_samples FROM {conf} GROUP BY ALL) a
  JOIN (SELECT {gg}round(avg(f1), 4) AS macro_f1, count(*) AS n_labels FROM {name}_per GROUP BY ALL) b ON {j})"""


def knn_sql(ks: list[int], metric: str, suf: str = "") -> list[str]:
    """Exact k-NN in fold context, row x row, for the oracle only."""
    feats = [f"f{i + 1}" for i in range(EMB_DIMS)]
    unp = "\n    UNION ALL ".join(f"SELECT row_key, fold, label, {i} AS j, {c} AS v FROM ef" for i, c in enumerate(feats))
    agg = "sum(abs(t.z - c.z))" if metric == "manhattan" else "sqrt(sum((t.z - c.z) * (t.z - c.z)))"
    kmax = max(ks)
    klist = ", ".join(str(k) for k in ks)
    return [EMB, folds("emb", "ef"), moments_sql("ef", feats),
            f"lng AS ({unp})",
            """sc AS (SELECT l.row_key, l.fold, l.label, m.ctx, l.j,
       CASE WHEN m.n = 0 THEN 0.0 ELSE coalesce((l.v - m.mean) / m.scale, 0.0) END AS z
     FROM lng l JOIN mom m ON m.feature_idx = l.j)""",
            f"""dist{suf} AS (SELECT t.row_key, t.fold, t.label, c.row_key AS cand_key, c.label AS cand_label,
       round({agg}, 9) AS dist
     FROM sc t JOIN sc c ON c.ctx = t.fold AND c.j = t.j AND c.fold <> t.fold
     WHERE t.ctx = t.fold GROUP BY ALL)""",
            f"""nn{suf} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY dist, cand_key) AS nn_rank
       FROM dist{suf}) WHERE nn_rank <= {kmax})""",
            f"""votes{suf} AS (SELECT ks.k, row_key, fold, label, cand_label, count(*) AS votes
       FROM nn{suf} nn JOIN (SELECT unnest([{klist}]) AS k) ks ON nn.nn_rank <= ks.k GROUP BY ALL)""",
            f"""kpred{suf} AS (SELECT k, row_key, fold, label, cand_label AS prediction FROM (
       SELECT *, row_number() OVER (PARTITION BY k, row_key ORDER BY votes DESC, cand_label) AS r FROM votes{suf}) WHERE r = 1)"""]


def _knn_grid_folds() -> list[str]:
    e = knn_sql([3, 5, 7, 9, 11], "euclidean", "_e")
    m = knn_sql([3, 5, 7, 9, 11], "manhattan", "_m")
    return e + m[5:] + [
        """gp AS (SELECT 'euclidean' AS metric, * FROM kpred_e UNION ALL SELECT 'manhattan', * FROM kpred_m)""",
        confusion_sql("gp", ["metric", "k", "fold"]),
        metrics_sql("conf", ["metric", "k", "fold"])]


def fold_summary_sql(src: str, group: list[str], metrics=("accuracy", "f1"), sep: str = " ± ") -> str:
    """J1 with exact decimal means: half-even for the number, half-up for the text."""
    g = ", ".join(group)
    cols = []
    for m in metrics:
        s4 = f"sum(CAST(round({m} * 10000) AS BIGINT))"
        n = "count(*)"
        q = f"floor({s4} / {n})"
        rem = f"({s4} - {q} * {n})"
        he = f"CAST(({q} + CASE WHEN 2 * {rem} > {n} THEN 1 WHEN 2 * {rem} = {n} THEN {q} % 2 ELSE 0 END) / 10000.0 AS DOUBLE)"
        hu = f"CAST(({q} + CASE WHEN 2 * {rem} >= {n} THEN 1 ELSE 0 END) / 10000.0 AS DOUBLE)"
        sd = f"round_even(stddev_samp({m}), 4)"
        cols += [f"{he} AS {m}_mean", f"{sd} AS {m}_std",
                 f"CAST(CAST({hu} AS DECIMAL(12,4)) AS VARCHAR) || '{sep}' || "
                 f"coalesce(CAST(CAST({sd} AS DECIMAL(12,4)) AS VARCHAR), 'nan') AS {m}_text"]
    return f"SELECT {g}, " + ", ".join(cols) + f" FROM {src} GROUP BY {g}"


ORACLES: dict[str, str] = {}

ORACLES["stratified_folds"] = with_(LI, folds("li")) + "SELECT row_key, label, fold FROM f"
ORACLES["plain_folds"] = with_(ORD, """f AS (SELECT row_key, CAST((row_number() OVER (
  ORDER BY md5('42|' || CAST(row_key AS VARCHAR)), row_key) - 1) % 10 AS INTEGER) AS fold FROM ord)""") + \
    "SELECT row_key, fold FROM f"
ORACLES["holdout_split"] = with_(EMB, folds("(SELECT row_key, label FROM emb)"),
                                 """c AS (SELECT f.row_key, x.ctx FROM f JOIN range(10) x(ctx) ON f.fold <> x.ctx),
r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY md5('42|' || ctx || '|' || CAST(row_key AS VARCHAR)), row_key) AS rk,
  count(*) OVER (PARTITION BY ctx) AS gn FROM c)""") + \
    "SELECT CAST(ctx AS INTEGER) AS ctx, row_key, rk <= ceil(gn * CAST(0.1 AS DOUBLE)) AS is_val FROM r"
ORACLES["fold_sizes"] = with_(LI, folds("li")) + "SELECT fold, label, count(*) AS n FROM f GROUP BY ALL"

ORACLES["table_profile"] = with_(LI) + """SELECT count(*) AS n_rows, 7::BIGINT AS n_cols, 4::BIGINT AS n_double_cols,
  1::BIGINT AS n_integer_cols, 2::BIGINT AS n_string_cols, 0::BIGINT AS n_other_cols,
  sum((row_key IS NULL)::BIGINT + (label IS NULL)::BIGINT + (quantity IS NULL OR isnan(quantity))::BIGINT
      + (extendedprice IS NULL OR isnan(extendedprice))::BIGINT + (discount IS NULL OR isnan(discount))::BIGINT
      + (tax IS NULL OR isnan(tax))::BIGINT + (suppkey IS NULL)::BIGINT)::BIGINT AS n_missing FROM li"""
ORACLES["class_count"] = with_(LI) + "SELECT count(DISTINCT label) AS n_classes FROM li"
ORACLES["class_distribution"] = with_(EV) + f"""SELECT label, n, {rr('n', 'sum(n) OVER ()')} AS share,
  row_number() OVER (ORDER BY n DESC, label) = 1 AS is_dominant FROM (SELECT label, count(*) AS n FROM ev GROUP BY label)"""
_cols = ", ".join(["label", *LI_FEATURES])
ORACLES["tables_equal"] = with_(*rule_view_sql(), "t AS (" + "\nUNION ALL\n".join(
    f"""SELECT {a} AS dataset_a, {a + 1} AS dataset_b,
  (SELECT count(*) FROM (SELECT {_cols} FROM rv WHERE dataset = {a} EXCEPT ALL SELECT {_cols} FROM rv WHERE dataset = {a + 1})) AS n_only_a,
  (SELECT count(*) FROM (SELECT {_cols} FROM rv WHERE dataset = {a + 1} EXCEPT ALL SELECT {_cols} FROM rv WHERE dataset = {a})) AS n_only_b"""
    for a in range(1, 17, 2)) + ")") + "SELECT *, n_only_a = 0 AND n_only_b = 0 AS equal FROM t"

ORACLES["tables_equal_ordered"] = """WITH r AS (SELECT l_orderkey // 2 AS pair, l_orderkey % 2 AS side, l_returnflag AS f, l_linestatus AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS position FROM lineitem),
m AS (SELECT coalesce(a.pair, b.pair) AS pair, a.pair AS pa, b.pair AS pb, a.f AS fa, a.s AS sa, b.f AS fb, b.s AS sb
  FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT * FROM r WHERE side = 1) b
  ON a.pair = b.pair AND a.position = b.position)
SELECT pair, count(pa) AS n_rows_a, count(pb) AS n_rows_b,
  count(*) FILTER (WHERE pa IS NULL OR pb IS NULL OR fa IS DISTINCT FROM fb OR sa IS DISTINCT FROM sb) AS n_different,
  count(*) FILTER (WHERE pa IS NULL OR pb IS NULL OR fa IS DISTINCT FROM fb OR sa IS DISTINCT FROM sb) = 0 AS equal
FROM m GROUP BY pair"""
ORACLES["impute_mean"] = with_(LI) + """SELECT row_key,
  round(coalesce(quantity, (SELECT avg(quantity) FROM li)), 6) AS quantity,
  round(coalesce(tax, (SELECT avg(tax) FROM li)), 6) AS tax FROM li"""
ORACLES["standardize_by_fold"] = with_(LI, folds("li"), moments_sql("f", LI_FEATURES)) + \
    "SELECT CAST(ctx AS INTEGER) AS ctx, feature, n_rows, n, round(mean, 6) AS mean, round(std, 6) AS std FROM mom"
ORACLES["standardize_rows"] = with_(LI, folds("li"), moments_sql("f", LI_FEATURES)) + \
    "SELECT f.row_key, f.fold, " + ", ".join(
        f"round((SELECT CASE WHEN m.n = 0 THEN 0.0 ELSE (coalesce(f.{c}, m.mean) - m.mean) / m.scale END "
        f"FROM mom m WHERE m.ctx = f.fold AND m.feature = '{c}'), 6) AS {c}" for c in LI_FEATURES) + " FROM f"
ORACLES["class_weights"] = with_(DOC) + """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
  FROM (SELECT label, count(*) AS n FROM doc GROUP BY label)"""
ORACLES["label_index"] = with_(EV) + """SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, n
  FROM (SELECT label, count(*) AS n FROM ev GROUP BY label)"""

ORACLES["knn_cv_manhattan"] = with_(*knn_sql([3], "manhattan"), confusion_sql("kpred", ["fold"]),
                                    metrics_sql("conf", ["fold"])) + "SELECT * FROM met"
ORACLES["knn_predict_euclidean"] = with_(*knn_sql([5], "euclidean")) + \
    "SELECT row_key, fold, label, prediction FROM kpred"
ORACLES["knn_predict_manhattan"] = with_(*knn_sql([5], "manhattan")) + \
    "SELECT row_key, fold, label, prediction FROM kpred"
ORACLES["knn_grid_cv"] = with_(*_knn_grid_folds(), "gf AS (SELECT metric, k, fold, accuracy, macro_f1 AS f1 FROM met)") + \
    fold_summary_sql("gf", ["metric", "k"])
ORACLES["knn_grid_best"] = with_(*_knn_grid_folds(), "gf AS (SELECT metric, k, fold, accuracy, macro_f1 AS f1 FROM met)",
                                 "s AS (" + fold_summary_sql("gf", ["metric", "k"]) + ")") + \
    """SELECT metric, k, f1_mean, f1_std FROM s
  ORDER BY f1_mean DESC, CASE metric WHEN 'euclidean' THEN 1 ELSE 2 END * 100 + k LIMIT 1"""

_RP = with_(*rule_view_sql(), rule_preds_sql())
ORACLES["rule_confusion"] = _RP + \
    "SELECT phase, classifier, label AS actual, prediction AS predicted, count(*) AS n FROM preds GROUP BY ALL"
ORACLES["accuracy_macro_f1"] = with_(*rule_view_sql(), rule_preds_sql(), confusion_sql("preds", ["phase", "classifier"]),
                                     metrics_sql("conf", ["phase", "classifier"])) + "SELECT * FROM met"
ORACLES["per_class_f1"] = with_(*rule_view_sql(), rule_preds_sql(), confusion_sql("preds", ["phase", "classifier"]),
                                metrics_sql("conf", ["phase", "classifier"])) + \
    """SELECT phase, classifier, label, support, n_pred, tp, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM met_per"""
_one = lambda clf, ph: with_(*rule_view_sql(), rule_preds_sql(),
                             f"p AS (SELECT * FROM preds WHERE classifier = '{clf}' AND phase = '{ph}')",
                             "dom AS (SELECT DISTINCT label AS l FROM p UNION SELECT DISTINCT prediction FROM p)",
                             """full_conf AS (SELECT a.l AS actual, b.l AS predicted,
   (SELECT count(*) FROM p WHERE p.label = a.l AND p.prediction = b.l) AS n FROM dom a, dom b)""")
ORACLES["confusion_wide"] = _one("RF", PHASE_BEFORE) + \
    """SELECT actual, CAST(sum(CASE WHEN predicted = 'A' THEN n ELSE 0 END) AS BIGINT) AS A,
  CAST(sum(CASE WHEN predicted = 'N' THEN n ELSE 0 END) AS BIGINT) AS N,
  CAST(sum(CASE WHEN predicted = 'R' THEN n ELSE 0 END) AS BIGINT) AS R
  FROM full_conf GROUP BY actual"""
ORACLES["confusion_row_percent"] = _one("SVM", PHASE_AFTER) + \
    f""", cube_t AS (SELECT actual, predicted, CAST(sum(n) AS BIGINT) AS n, grouping(actual) AS ga, grouping(predicted) AS gp
  FROM full_conf GROUP BY CUBE (actual, predicted))
SELECT actual, predicted, n,
  CASE WHEN sum(CASE WHEN gp = 1 THEN n END) OVER (PARTITION BY actual, ga) > 0
        THEN {rr('100 * n', 'sum(CASE WHEN gp = 1 THEN n END) OVER (PARTITION BY actual, ga)', 2)} ELSE 0.0 END AS row_pct,
  ga = 1 AS is_row_total, gp = 1 AS is_col_total FROM cube_t"""
ORACLES["confusion_row_percent"] = ORACLES["confusion_row_percent"].replace("\n, cube_t AS", ",\ncube_t AS")
ORACLES["prediction_distribution"] = _RP + f"""SELECT phase, classifier, prediction AS predicted, count(*) AS n,
  {rr('100 * count(*)', 'sum(count(*)) OVER (PARTITION BY phase, classifier)', 2)} AS pct FROM preds
  GROUP BY phase, classifier, prediction"""
ORACLES["correct_flags"] = _RP + f"""SELECT row_key, label, prediction, prediction = label AS correct FROM preds
  WHERE classifier = 'MLP' AND phase = '{PHASE_BEFORE}'"""
