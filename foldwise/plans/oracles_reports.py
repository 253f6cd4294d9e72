"""DuckDB oracle SQL, part 2: selection (H), fold records and reports (J),
scalar functions (S, K, B)."""

from __future__ import annotations

from ..operators.report import CLASSIFIER_ORDER, PARAM_LAYOUT
from .catalog_reports import CONSTANT_RULE
from .oracles import LI, confusion_sql, metrics_sql, rule_preds_sql, rule_view_sql, with_
from .rules import LI_FEATURES, PARAM_SQL, PARAM_TYPES, PHASE_AFTER, PHASE_BEFORE, RULES

SQL_TYPE = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def he4(col: str) -> str:
    """Exact half-even mean of 4-decimal values, as DOUBLE."""
    s4 = f"sum(CAST(round({col} * 10000) AS BIGINT))"
    n = f"count({col})"
    q = f"floor({s4} / {n})"
    rem = f"({s4} - {q} * {n})"
    return (f"CAST(({q} + CASE WHEN 2 * {rem} > {n} THEN 1 WHEN 2 * {rem} = {n} THEN {q} % 2 ELSE 0 END)"
            f" / 10000.0 AS DOUBLE)")


def hu4(col: str) -> str:
    s4 = f"sum(CAST(round({col} * 10000) AS BIGINT))"
    n = f"count({col})"
    q = f"floor({s4} / {n})"
    rem = f"({s4} - {q} * {n})"
    return f"CAST(({q} + CASE WHEN 2 * {rem} >= {n} THEN 1 ELSE 0 END) / 10000.0 AS DOUBLE)"


def sd4(col: str) -> str:
    return f"round_even(stddev_samp({col}), 4)"


def txt(mean: str, std: str, sep: str) -> str:
    return (f"coalesce(CAST(CAST({mean} AS DECIMAL(12,4)) AS VARCHAR), 'nan') || '{sep}' || "
            f"coalesce(CAST(CAST({std} AS DECIMAL(12,4)) AS VARCHAR), 'nan')")


def summary_sql(src: str, group: list[str], sep: str = " ± ", extra: str = "") -> str:
    g = ", ".join(group)
    cols = []
    for m in ("accuracy", "f1"):
        cols += [f"{he4(m)} AS {m}_mean", f"{sd4(m)} AS {m}_std", f"{txt(hu4(m), sd4(m), sep)} AS {m}_text"]
    return f"SELECT {g}, " + ", ".join(cols) + (f", {extra}" if extra else "") + f" FROM {src} GROUP BY {g}"


def rule_folds_ctes() -> list[str]:
    params = ",\n    ".join(f"CAST({sql} AS {SQL_TYPE[PARAM_TYPES[c]]}) AS {c}" for c, sql in PARAM_SQL.items())
    key = "classifier || '|' || phase"
    n_after = " ".join(f"WHEN '{c}|{p}' THEN {len(cols)}" for (c, p), (_, cols) in RULES.items())
    sel = " ".join(f"WHEN '{c}|{p}' THEN '{', '.join(cols)}'" for (c, p), (_, cols) in RULES.items())
    return [*rule_view_sql(), rule_preds_sql(),
            confusion_sql("preds", ["phase", "dataset", "classifier", "fold"]),
            metrics_sql("conf", ["phase", "dataset", "classifier", "fold"]),
            f"""rf AS (SELECT phase, 'dataset_' || dataset AS dataset_name, dataset, classifier, fold1 AS fold,
    accuracy, f1,
    {params},
    {len(LI_FEATURES)} AS n_features_before,
    CAST(CASE {key} {n_after} END AS INTEGER) AS n_features_after,
    CASE {key} {sel} END AS selected_features
  FROM (SELECT * EXCLUDE (fold, macro_f1), fold + 1 AS fold1, macro_f1 AS f1 FROM met))"""]


RF = rule_folds_ctes()
SUMM = f"summ AS ({summary_sql('rf', ['phase', 'dataset_name', 'dataset', 'classifier'])})"


def final_test_ctes(fold: int = 0, name: str = "ft") -> list[str]:
    return [confusion_sql(f"(SELECT * FROM preds WHERE fold = {fold})", ["phase", "dataset", "classifier"], f"conf{name}"),
            metrics_sql(f"conf{name}", ["phase", "dataset", "classifier"], f"met{name}"),
            f"""{name} AS (SELECT 'dataset_' || dataset AS dataset_name, dataset, phase, classifier,
    accuracy AS test_accuracy, macro_f1 AS test_f1_macro, n_samples AS test_rows, n_labels AS num_classes FROM met{name})"""]


def dgroup(col: str) -> str:
    return f"CASE WHEN {col} BETWEEN 1 AND 8 THEN '1-8' WHEN {col} BETWEEN 9 AND 16 THEN '9-16' END"


def clf_order(col: str) -> str:
    return "CASE upper(" + col + ") " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSIFIER_ORDER)) + \
        " ELSE 999 END"


def text_of(col: str, typ: str) -> str:
    if typ == "double":
        return (f"regexp_replace(regexp_replace(CAST(CAST({col} AS DECIMAL(20,10)) AS VARCHAR), '0+$', ''),"
                f" '\\.$', '')")
    return f"CAST({col} AS VARCHAR)"


def modal_ctes() -> list[str]:
    parts = []
    for clf, layout in PARAM_LAYOUT.items():
        for p, _ in layout:
            parts.append(f"SELECT classifier, phase, '{p}' AS param, {text_of(p, PARAM_TYPES[p])} AS value,"
                         f" dataset * 100 + fold AS seq FROM rf WHERE classifier = '{clf}'")
    stacked = "\n  UNION ALL ".join(parts)
    return [f"stk AS ({stacked})",
            """cnt AS (SELECT classifier, phase, param, value, count(*) AS n, min(seq) AS first_seq
  FROM stk WHERE value IS NOT NULL GROUP BY ALL)""",
            """best AS (SELECT classifier, phase, param, value FROM (SELECT *, row_number() OVER
  (PARTITION BY classifier, phase, param ORDER BY n DESC, first_seq) AS r FROM cnt) WHERE r = 1)""",
            """modal AS (SELECT p.classifier, p.phase, p.param, coalesce(b.value, 'N/A') AS value
  FROM (SELECT DISTINCT classifier, phase, param FROM stk) p
  LEFT JOIN best b ON p.classifier = b.classifier AND p.phase = b.phase AND p.param = b.param)"""]


def param_text_sql() -> str:
    whens = []
    for clf, layout in PARAM_LAYOUT.items():
        pieces = []
        for i, (p, name) in enumerate(layout):
            v = f"max(CASE WHEN param = '{p}' THEN value END)"
            piece = f"'{'' if i == 0 else ', '}{name}=' || {v}"
            if clf == "SVM" and p == "best_gamma":
                piece = f"CASE WHEN max(CASE WHEN param = 'best_kernel' THEN value END) = 'linear' THEN '' ELSE {piece} END"
            pieces.append(piece)
        whens.append(f"WHEN '{clf}' THEN " + " || ".join(pieces))
    return ("ptext AS (SELECT classifier, phase, CASE classifier " + " ".join(whens) +
            " ELSE 'N/A' END AS best_hyperparameters FROM modal GROUP BY classifier, phase)")


def perm_ctes(rule: str, n_repeats: int = 10, feats: list[str] = LI_FEATURES) -> list[str]:
    cols = ", ".join(feats)
    pcols = ", ".join(f"b.{c} AS p_{c}" for c in feats)
    sw = ", ".join(f"CASE WHEN f.feat = '{c}' THEN b.p_{c} ELSE a.{c} END AS {c}" for c in feats)
    flist = ", ".join(f"'{c}'" for c in feats)
    idx = "CASE feat " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(feats)) + " END"
    return [*rule_view_sql(),
            f"base AS (SELECT row_key, dataset, label, {cols} FROM rv)",
            """pa AS (SELECT *, row_number() OVER (PARTITION BY dataset
  ORDER BY md5('42|a|' || CAST(row_key AS VARCHAR)), row_key) AS pos FROM base)""",
            f"""pb AS (SELECT b.dataset, r.rep, {pcols},
  ((b.pos - 1 + 1 + CAST(floor(r.frac * (b.n - 1)) AS BIGINT)) % b.n) + 1 AS pos
  FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM pa) b
  CROSS JOIN (SELECT rep, CAST('0x' || substr(md5('42|shift|' || rep), 1, 12) AS BIGINT) / 281474976710656.0 AS frac
    FROM (SELECT unnest(range({n_repeats})) AS rep)) r)""",
            f"""sw AS (SELECT a.dataset, b.rep, f.feat, a.label, {sw}
  FROM pa a JOIN pb b ON a.dataset = b.dataset AND a.pos = b.pos CROSS JOIN (SELECT unnest([{flist}]) AS feat) f)""",
            f"pp AS (SELECT dataset, rep, feat, label, {rule} AS prediction FROM sw)",
            confusion_sql("pp", ["dataset", "rep", "feat"], "pconf"),
            metrics_sql("pconf", ["dataset", "rep", "feat"], "pm"),
            "pf1 AS (SELECT dataset, rep, feat, avg(f1) AS f1 FROM pm_per GROUP BY ALL)",
            f"bp AS (SELECT dataset, label, {rule} AS prediction FROM base)",
            confusion_sql("bp", ["dataset"], "bconf"),
            metrics_sql("bconf", ["dataset"], "bm"),
            "bf1 AS (SELECT dataset, avg(f1) AS base_f1 FROM bm_per GROUP BY ALL)",
            f"""imp AS (SELECT p.dataset, p.feat AS feature, CAST({idx} AS INTEGER) AS feature_idx,
  max(b.base_f1) - avg(p.f1) AS importance, coalesce(stddev_pop(p.f1), 0.0) AS importance_std
  FROM pf1 p JOIN bf1 b ON p.dataset = b.dataset GROUP BY p.dataset, p.feat)"""]


SELECT_SQL = """, sv AS (SELECT *, round(importance, 9) AS v FROM imp),
st AS (SELECT *, round(avg(v) OVER (PARTITION BY dataset), 9) AS mean_v, count(*) OVER (PARTITION BY dataset) AS p,
  row_number() OVER (PARTITION BY dataset ORDER BY v DESC, feature_idx DESC) AS fb FROM sv),
st2 AS (SELECT *, sum(CASE WHEN v > mean_v THEN 1 ELSE 0 END) OVER (PARTITION BY dataset) AS n_above FROM st),
st3 AS (SELECT *, n_above = 0 AS fallback,
  CASE WHEN n_above > 0 THEN v > mean_v ELSE fb <= greatest(1, floor(p / 2)) END AS sel,
  CASE WHEN n_above > 0 THEN feature_idx ELSE fb END AS ord FROM st2)
SELECT dataset, p AS n_features_before, CAST(sum(sel::INTEGER) AS BIGINT) AS n_features_after,
  string_agg(CASE WHEN sel THEN feature END, ', ' ORDER BY ord) AS selected_text, bool_and(fallback) AS used_fallback
FROM st3 GROUP BY dataset, p"""

O: dict[str, str] = {}

_rf_rule = RULES[("RF", PHASE_BEFORE)][0]
_mlp_rule = RULES[("MLP", PHASE_BEFORE)][0]
O["permutation_importance_rule"] = with_(*perm_ctes(_rf_rule)) + \
    "SELECT dataset, feature, feature_idx, round(importance, 6) + 0.0 AS importance, round(importance_std, 6) + 0.0 AS importance_std FROM imp"
O["select_above_mean"] = with_(*perm_ctes(_rf_rule)).rstrip("\n") + SELECT_SQL
O["select_fallback_top_half"] = with_(*perm_ctes(CONSTANT_RULE)).rstrip("\n") + SELECT_SQL
O["importance_rank"] = with_(*perm_ctes(_mlp_rule)) + """SELECT dataset, feature, round(importance, 6) + 0.0 AS importance,
  CAST(rank() OVER (PARTITION BY dataset ORDER BY round(importance, 9) DESC) AS INTEGER) AS rank FROM imp"""

O["rule_folds"] = with_(*RF) + "SELECT * FROM rf"
O["fold_summary"] = with_(*RF) + summary_sql(f"(SELECT * FROM rf WHERE phase = '{PHASE_BEFORE}')",
                                             ["phase", "dataset_name", "dataset", "classifier"])
_p2extra = ("first(n_features_before) AS avg_features_before, "
            "CAST(round(avg(n_features_after), 1) AS DOUBLE) AS avg_features_after")
O["phase2_summary"] = with_(*RF) + summary_sql(f"(SELECT * FROM rf WHERE phase = '{PHASE_AFTER}')",
                                               ["phase", "dataset_name", "classifier"], extra=_p2extra)
O["combine_summaries"] = with_(*RF, "s1 AS (" + summary_sql(f"(SELECT * FROM rf WHERE phase = '{PHASE_BEFORE}')",
                                                            ["phase", "dataset_name", "classifier"]) + ")",
                               "s2 AS (" + summary_sql(f"(SELECT * FROM rf WHERE phase = '{PHASE_AFTER}')",
                                                       ["phase", "dataset_name", "classifier"], extra=_p2extra) + ")") + \
    """SELECT *, CAST(NULL AS INTEGER) AS avg_features_before, CAST(NULL AS DOUBLE) AS avg_features_after FROM s1
  UNION ALL BY NAME SELECT * FROM s2"""
O["modal_params"] = with_(*RF, *modal_ctes()) + "SELECT classifier, phase, param, value FROM modal"
O["param_summary"] = with_(*RF, *modal_ctes(), param_text_sql()) + "SELECT * FROM ptext"
_cells = ", ".join(f"coalesce(max(CASE WHEN classifier = '{c}' THEN {txt('f1_mean', 'f1_std', ' +/- ')} END), 'N/A') AS {c}"
                   for c in CLASSIFIER_ORDER)
O["results_pivot"] = with_(*RF, SUMM) + f"SELECT dataset_name, phase, {_cells} FROM summ GROUP BY dataset_name, phase"
O["phase_comparison"] = with_(*RF, SUMM) + f"""SELECT {dgroup('dataset')} AS dataset_group, classifier, phase,
  {he4('f1_mean')} AS mean, coalesce({sd4('f1_mean')}, 0.0) AS std, count(*) AS n_datasets FROM summ GROUP BY ALL"""
O["best_classifier"] = with_(*RF, SUMM, f"""bc AS (SELECT phase, classifier, {he4('f1_mean')} AS mean,
  coalesce({sd4('f1_mean')}, 0.0) AS std FROM summ GROUP BY ALL)""") + \
    f"""SELECT *, row_number() OVER (PARTITION BY phase ORDER BY mean DESC, {clf_order('classifier')}) = 1 AS is_best FROM bc"""
O["feature_reduction"] = with_(*RF) + f"""SELECT dataset, round(avg(n_features_before), 1) AS features_before,
  round(avg(n_features_after), 1) AS features_after FROM rf WHERE classifier = 'SVM' AND phase = '{PHASE_AFTER}' GROUP BY dataset"""
O["std_comparison"] = with_(*RF, SUMM) + f"""SELECT {dgroup('dataset')} AS dataset_group, classifier, phase,
  {he4('f1_std')} AS mean_f1_std FROM summ GROUP BY ALL"""
_FT = [*rule_view_sql(), rule_preds_sql(), *final_test_ctes()]
_spine = " UNION ALL ".join(f"SELECT '{c}' AS classifier, {i} AS clf_order" for i, c in enumerate(CLASSIFIER_ORDER))
O["test_f1_pivot"] = with_(*_FT, f"sp AS ({_spine})", f"""pv AS (SELECT classifier,
  {he4(f"CASE WHEN phase = '{PHASE_BEFORE}' THEN test_f1_macro END")} AS before_fs,
  {he4(f"CASE WHEN phase = '{PHASE_AFTER}' THEN test_f1_macro END")} AS after_fs FROM ft GROUP BY classifier)""") + \
    """SELECT sp.classifier, sp.clf_order, coalesce(pv.before_fs, 0.0) AS before_fs, coalesce(pv.after_fs, 0.0) AS after_fs
  FROM sp LEFT JOIN pv ON sp.classifier = pv.classifier"""
O["test_f1_by_group"] = with_(*_FT, f"sp AS (SELECT * FROM ({_spine}) CROSS JOIN (SELECT unnest(['1-8', '9-16']) AS dataset_group))",
                              f"""pv AS (SELECT {dgroup('dataset')} AS dataset_group, classifier,
  {he4(f"CASE WHEN phase = '{PHASE_BEFORE}' THEN test_f1_macro END")} AS before_fs,
  {he4(f"CASE WHEN phase = '{PHASE_AFTER}' THEN test_f1_macro END")} AS after_fs FROM ft GROUP BY ALL)""") + \
    """SELECT sp.dataset_group, sp.classifier, sp.clf_order, coalesce(pv.before_fs, 0.0) AS before_fs,
  coalesce(pv.after_fs, 0.0) AS after_fs FROM sp LEFT JOIN pv ON sp.classifier = pv.classifier AND sp.dataset_group = pv.dataset_group"""
O["dataset_classifier_matrix"] = with_(*_FT) + "SELECT dataset, " + ", ".join(
    f"max(CASE WHEN classifier = '{c}' THEN test_f1_macro END) AS {c}" for c in CLASSIFIER_ORDER) + \
    f" FROM ft WHERE phase = '{PHASE_BEFORE}' GROUP BY dataset"



O["merge_dedupe_results"] = with_(*RF, f"""runs AS (SELECT dataset_name, phase, classifier, f1 AS test_f1_macro, 'run' || fold || '.csv' AS source_file,
    fold * 100000 + dataset * 100 + {clf_order('classifier')} * 10 + CASE WHEN phase = '{PHASE_BEFORE}' THEN 0 ELSE 1 END AS seq
    FROM rf WHERE dataset % fold = 0)""",
                                  """lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, phase, classifier
  ORDER BY seq DESC) AS r FROM runs) WHERE r = 1)""") + \
    f"""SELECT dataset_name, phase, classifier, test_f1_macro, source_file,
  CAST(regexp_extract(dataset_name, '(\\d+)$', 1) AS BIGINT) AS dataset_sort, {clf_order('classifier')} AS classifier_sort
  FROM lastr"""
O["global_mean_std"] = with_(*RF) + f"""SELECT phase, classifier, {he4('accuracy')} AS accuracy_mean,
  {sd4('accuracy')} AS accuracy_std, {he4('f1')} AS f1_mean, {sd4('f1')} AS f1_std, count(*) AS n_folds FROM rf GROUP BY ALL"""
_num_text = lambda c: (f"coalesce(regexp_replace(regexp_replace(CAST(CAST({c} AS DECIMAL(20,10)) AS VARCHAR), '0+$', ''), '\\.$', ''), 'N/A')")
FOLD_TEXT = f"""CASE classifier
    WHEN 'SVM' THEN 'kernel=' || best_kernel || ', C=' || {_num_text('best_c')} || ', gamma=' || coalesce(best_gamma, 'N/A')
    WHEN 'KNN' THEN 'k=' || best_k || ', metric=' || best_metric
    WHEN 'DT' THEN 'max_depth=' || {_num_text('best_max_depth')} || ', min_samples_split=' || best_min_split || ', criterion=' || best_criterion
    WHEN 'RF' THEN 'n_estimators=' || best_n_estimators || ', max_depth=' || {_num_text('best_max_depth')}
      || ', min_samples_split=' || best_min_samples_split
    WHEN 'MLP' THEN 'hidden_layers=' || best_hidden_layers || ', lr=' || {_num_text('best_learning_rate')} || ', alpha=' || {_num_text('best_alpha')}
  END"""
O["sorted_folds"] = with_(*RF) + f"""SELECT phase, dataset_name, classifier, fold, CAST(row_number() OVER (
  PARTITION BY phase, dataset_name, classifier ORDER BY fold) AS INTEGER) AS fold_rank, accuracy, f1, {FOLD_TEXT} AS parameters FROM rf"""
O["align_features"] = with_(LI) + "SELECT row_key, quantity, extendedprice, discount, tax FROM li"
O["schema_diff"] = """SELECT * FROM (VALUES ('quantity', 1, 5, 'moved'), ('extendedprice', 2, 6, 'moved'),
  ('discount', 3, 7, 'moved'), ('tax', 4, 8, 'moved'), ('suppkey', 5, 3, 'moved'),
  ('orderkey', NULL, 1, 'extra'), ('partkey', NULL, 2, 'extra'), ('linenumber', NULL, 4, 'extra'),
  ('returnflag', NULL, 9, 'extra'), ('linestatus', NULL, 10, 'extra'), ('shipdate', NULL, 11, 'extra')
  ) t("column", model_position, table_position, status)"""
O["fold_lookup"] = with_(*RF, f"rft AS (SELECT *, {FOLD_TEXT} AS parameters FROM rf)") + "SELECT dataset, fold, " + ", ".join(
    f"max(CASE WHEN classifier = '{c}' THEN accuracy END) AS {c}_acc, max(CASE WHEN classifier = '{c}' THEN f1 END) AS {c}_f1, "
    f"max(CASE WHEN classifier = '{c}' THEN parameters END) AS {c}_parameters" for c in CLASSIFIER_ORDER) + f" FROM rft WHERE phase = '{PHASE_BEFORE}' GROUP BY dataset, fold"

_strict = lambda c: (f"CASE lower(trim({c})) WHEN 'svm' THEN 'SVM' WHEN 'knn' THEN 'kNN' WHEN 'dt' THEN 'DT' "  # noqa: E731
                     "WHEN 'rf' THEN 'RF' WHEN 'mlp' THEN 'MLP' END")
_report = lambda c: (f"CASE WHEN upper(trim({c})) = 'KNN' THEN 'kNN' WHEN upper(trim({c})) IN ('SVM', 'DT', 'RF', 'MLP') "  # noqa: E731
                     f"THEN upper(trim({c})) ELSE upper(trim({c})[1]) || lower(trim({c})[2:]) END")
_rename = ("CASE WHEN classifier = 'kNN' AND k = 'k' THEN 'n_neighbors' "
           "WHEN classifier = 'MLP' AND k = 'hidden_layers' THEN 'hidden_layer_sizes' "
           "WHEN classifier = 'MLP' AND k = 'lr' THEN 'learning_rate_init' ELSE k END")
_num = "TRY_CAST(raw AS DOUBLE)"
_kind = (f"CASE WHEN raw IN ('N/A', 'None') THEN 'null' WHEN lower(raw) IN ('true', 'false') THEN 'bool' "
         f"WHEN starts_with(raw, '(') AND ends_with(raw, ')') THEN 'tuple' "
         f"WHEN starts_with(raw, '[') AND ends_with(raw, ']') THEN 'list' "
         f"WHEN {_num} IS NOT NULL AND {_num} = floor({_num}) THEN 'int' WHEN {_num} IS NOT NULL THEN 'float' ELSE 'text' END")
O["parse_params"] = with_(*RF, *modal_ctes(), param_text_sql(),
                          # the texts' only commas within a value are those of "(64, 64)" and "(64,)"
                          f"""pt AS (SELECT {_strict('classifier')} AS classifier, phase, string_split(regexp_replace(
    best_hyperparameters, '\\(([0-9 ]*),([0-9 ]*)\\)', '(\\1;\\2)', 'g'), ',') AS items FROM ptext)""",
                          """kv AS (SELECT classifier, phase, i AS pos, trim(split_part(items[i + 1], '=', 1)) AS k,
    replace(trim(split_part(items[i + 1], '=', 2)), ';', ',') AS raw
  FROM (SELECT *, unnest(range(len(items))) AS i FROM pt))""") + \
    f"""SELECT classifier, phase, CAST(pos AS INTEGER) AS pos, {_rename} AS param, raw, {_kind} AS kind,
  CASE WHEN ({_kind}) IN ('int', 'float') THEN {_num} END AS number,
  CASE WHEN ({_kind}) IN ('tuple', 'list') THEN array_to_string(list_transform(list_filter(
    string_split(regexp_replace(raw, '[()\\[\\]\\s]', '', 'g'), ','), lambda s: s <> ''), lambda s: CAST(TRY_CAST(s AS INTEGER) AS VARCHAR)), ',') END AS ints
  FROM kv"""
O["normalize_names"] = with_(*RF, """nm AS (SELECT DISTINCT unnest([classifier, lower(classifier), ' ' || lower(classifier) || ' ']) AS name
  FROM (SELECT DISTINCT classifier FROM rf))""") + \
    f"SELECT name, {_strict('name')} AS canonical, {_report('name')} AS report_name FROM nm"
O["natural_sort"] = with_(*RF) + f"""SELECT dataset_name, classifier,
  CAST(regexp_extract(dataset_name, '(\\d+)$', 1) AS INTEGER) AS dataset_num,
  CAST(regexp_extract(dataset_name, '(\\d+)$', 1) AS BIGINT) AS dataset_sort,
  {clf_order('classifier')} AS classifier_sort,
  {dgroup("CAST(regexp_extract(dataset_name, '(\\d+)$', 1) AS INTEGER)")} AS dataset_group
  FROM (SELECT DISTINCT dataset_name, classifier FROM rf)"""
O["format_split_pm"] = with_(*RF, SUMM, f"""piv AS (SELECT dataset_name, phase, {_cells} FROM summ GROUP BY dataset_name, phase)""",
                             "lng AS (UNPIVOT piv ON " + ", ".join(CLASSIFIER_ORDER) + " INTO NAME classifier VALUE cell)") + \
    """SELECT dataset_name, phase, classifier, cell, trim(string_split(cell, '+/-')[1]) AS mean_text,
  trim(string_split(cell, '+/-')[-1]) AS std_text FROM lng"""
O["params_json"] = with_(*RF) + """SELECT phase, dataset_name, fold,
  '{"criterion":"' || best_criterion || '","max_depth":' || coalesce(CAST(CAST(best_max_depth AS INTEGER) AS VARCHAR), 'null')
  || ',"min_samples_split":' || CAST(best_min_split AS VARCHAR) || '}' AS params_json,
  'max_depth, min_samples_split, criterion' AS param_names
  FROM rf WHERE classifier = 'DT'"""
O["select_datasets"] = with_(*RF) + f"""SELECT dataset, classifier, count(*) AS n_folds,
  max(CAST(regexp_matches(dataset_name, '^dataset_[1-8]$') AS INTEGER)) AS in_first_group
  FROM rf WHERE dataset IN (3, 4, 5, 6) AND classifier IN ('SVM', 'RF') GROUP BY dataset, classifier"""

ORACLES = O

O["results_roundtrip"] = with_(*RF) + f"""SELECT dataset_name, {dgroup('dataset')} AS dataset_group,
  CASE WHEN classifier = 'KNN' THEN 'kNN' ELSE classifier END AS classifier_name,
  {he4('f1')} AS f1_mean, {sd4('f1')} AS f1_std, count(*) AS n_folds
  FROM rf WHERE phase = '{PHASE_BEFORE}' AND dataset BETWEEN 1 AND 8 GROUP BY ALL"""
