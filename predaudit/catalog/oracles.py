"""Reference SQL for the registered queries, written for DuckDB without this library's operators."""

from __future__ import annotations

from predaudit.catalog.views import FAULTY, SPECS, faulty_spec, view_sql

ORACLES: dict[str, str] = {}


def r(x: str) -> str:
    """The rounding of the queries: about nine significant digits."""
    return (
        f"(case when abs({x}) < 5e-7 then cast(0 as double) when abs({x}) < 1e3 then round({x}, 6) "
        f"when abs({x}) < 1e6 then round({x}, 3) when abs({x}) < 1e9 then round({x}, 0) else round({x}, -3) end)"
    )


def with_view(name: str, body: str) -> str:
    return f"with v as ({view_sql(name)}), {body.strip()}"


def keys(by: list[str]) -> str:
    return "".join(f"{k}, " for k in by)


def grouped(by: list[str]) -> str:
    return f"group by {', '.join(by)}" if by else ""


def tall(source: str, metrics: list[str], by: list[str] = (), attribute: str = "''", raw: bool = False) -> str:
    value = (lambda m: f"cast({m} as double)") if raw else (lambda m: r(f"cast({m} as double)"))
    return " union all ".join(
        f"select {keys(by)}{attribute} as attribute, '{m}' as metric, {value(m)} as value "
        f"from {source} where {m} is not null"
        for m in metrics
    )


def div0(a: str, b: str) -> str:
    return f"(case when {b} = 0 then 0 else cast({a} as double) / {b} end)"


def div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def total(condition: str) -> str:
    return f"cast(count(*) filter (where {condition}) as double)"


# --- classification ---------------------------------------------------------------------------


def binary_metrics(by: list[str]) -> str:
    """Every binary metric straight from the four cells, AUC from mean ranks."""
    part = f"partition by {', '.join(by)}" if by else ""
    return f"""
c as (select {keys(by)}{total('true_label = 1 and prediction = 1')} as tp, {total('true_label = 0 and prediction = 1')} as fp,
  {total('true_label = 0 and prediction = 0')} as tn, {total('true_label = 1 and prediction = 0')} as fn,
  -avg(case when true_label = 1 then ln(sc) else ln(1 - sc) end) as log_loss
  from (select *, greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16) as sc from v) {grouped(by)}),
k as (select {keys(by)}true_label, rank() over ({part} order by score)
  + (count(*) over ({'partition by ' + ', '.join([*by, 'score'])}) - 1) / cast(2 as double) as mid from v),
a as (select {keys(by)}{div('sum(case when true_label = 1 then mid end) - sum(true_label) * (sum(true_label) + 1) / cast(2 as double)',
  'sum(true_label) * cast(count(*) - sum(true_label) as double)')} as roc_auc from k {grouped(by)}),
m as (select {''.join(f'c.{k}, ' for k in by)}(tp + tn) / (tp + fp + tn + fn) as accuracy, {div0('tp', '(tp + fp)')} as "precision",
  {div0('tp', '(tp + fn)')} as recall, {div0('2 * tp', '(2 * tp + fp + fn)')} as f1_score,
  {div0('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} as matthews_corr,
  {div('2 * (tp * tn - fn * fp)', '((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))')} as cohen_kappa, roc_auc, log_loss
  from c join a on {' and '.join(f'c.{k} = a.{k}' for k in by) or 'true'})
"""


BINARY = ["accuracy", '"precision"', "recall", "f1_score", "matthews_corr", "cohen_kappa", "roc_auc", "log_loss"]


def unquoted(sql: str) -> str:
    return sql.replace("""'"precision"'""", "'precision'")


SEGMENTS = ["c_mktsegment", "r_name"]
ORACLES["clf_metrics"] = unquoted(with_view("risk", binary_metrics([]) + tall("m", BINARY)))
ORACLES["clf_metrics_by_segment"] = unquoted(with_view("risk", binary_metrics(SEGMENTS) + tall("m", BINARY, SEGMENTS)))


def label_tables(by: list[str]) -> str:
    on = " and ".join([f"x.{k} = v.{k}" for k in by] + ["true"])
    return f"""
l as (select distinct {keys(by)}label from (select {keys(by)}true_label as label from v union select {keys(by)}prediction from v)),
t as (select {''.join(f'x.{k}, ' for k in by)}x.label, {total('v.true_label = x.label')} as support,
  {total('v.prediction = x.label')} as predicted, {total('v.prediction = x.label and v.true_label = x.label')} as hits
  from l x join v on {on} group by {''.join(f'x.{k}, ' for k in by)}x.label),
s as (select *, {div0('hits', 'predicted')} as prec, {div0('hits', 'support')} as rec,
  {div0('2 * hits', '(predicted + support)')} as f1 from t),
m as (select {keys(by)}sum(hits) / sum(support) as accuracy, sum(prec * support) / sum(support) as "precision",
  sum(rec * support) / sum(support) as recall, sum(f1 * support) / sum(support) as f1_score,
  {div0('sum(hits) * sum(support) - sum(predicted * support)',
        '(sqrt(sum(support) * sum(support) - sum(predicted * predicted)) * sqrt(sum(support) * sum(support) - sum(support * support)))')} as matthews_corr,
  (sum(hits) / sum(support) - sum(predicted * support) / (sum(support) * sum(support)))
    / (1 - sum(predicted * support) / (sum(support) * sum(support))) as cohen_kappa from s {grouped(by)})
"""


OVR = """
w as (select label, score, true_label = label as pos from (
  select true_label, 0 as label, score_0 as score from v union all select true_label, 1, score_1 from v
  union all select true_label, 2, score_2 from v)),
k as (select label, pos, rank() over (partition by label order by score)
  + (count(*) over (partition by label, score) - 1) / cast(2 as double) as mid from w),
o as (select label, count(*) filter (where pos) as positives, count(*) filter (where not pos) as negatives,
  (sum(mid) filter (where pos) - count(*) filter (where pos) * (count(*) filter (where pos) + 1) / cast(2 as double))
  / (count(*) filter (where pos) * cast(count(*) filter (where not pos) as double)) as roc_auc from k group by label)
"""
MULTI = ["accuracy", '"precision"', "recall", "f1_score", "matthews_corr", "cohen_kappa"]
ORACLES["clf_metrics_multiclass"] = unquoted(
    with_view(
        "orders_scored",
        f"{label_tables([])}, {OVR}, u as (select sum(roc_auc * positives) / sum(positives) as roc_auc_ovr from o) "
        + tall("m", MULTI)
        + " union all "
        + tall("u", ["roc_auc_ovr"]),
    )
)
ORACLES["mcc_kappa"] = with_view(
    "orders_scored",
    label_tables(["o_orderpriority"]) + tall("m", ["matthews_corr", "cohen_kappa"], ["o_orderpriority"]),
)
ORACLES["confusion_matrix"] = with_view(
    "orders_scored",
    """l as (select true_label as label from v union select prediction from v)
select a.label as truth, b.label as prediction, count(v.o_orderkey) as n from l a cross join l b
left join v on v.true_label = a.label and v.prediction = b.label group by a.label, b.label""",
)
ORACLES["class_report"] = with_view(
    "orders_scored",
    label_tables([])
    + f"""
select cast(label as varchar) as label, {r('prec')} as "precision", {r('rec')} as recall, {r('f1')} as f1_score,
  cast(support as bigint) as support from s
union all select 'accuracy', {r('accuracy')}, {r('accuracy')}, {r('accuracy')}, (select cast(sum(support) as bigint) from s) from m
union all select 'macro avg', {r('avg(prec)')}, {r('avg(rec)')}, {r('avg(f1)')}, cast(sum(support) as bigint) from s
union all select 'weighted avg', {r('"precision"')}, {r('recall')}, {r('f1_score')}, (select cast(sum(support) as bigint) from s) from m""",
)
ORACLES["most_confused"] = with_view(
    "orders_scored",
    f"""
c as (select c_mktsegment, true_label, prediction, count(*) as n from v group by all),
w as (select *, row_number() over (partition by c_mktsegment, true_label order by n desc, prediction) as k
  from c where true_label <> prediction),
t as (select c_mktsegment, true_label, count(*) as support, avg(cast(true_label = prediction as int)) as accuracy from v group by all)
select t.c_mktsegment, cast(t.true_label as varchar) as label, t.support, {r('t.accuracy')} as accuracy,
  coalesce(cast(w.prediction as varchar), 'None (perfect classification)') as most_confused_with
from t left join w on w.k = 1 and w.c_mktsegment = t.c_mktsegment and w.true_label = t.true_label""",
)
ORACLES["roc_auc"] = with_view(
    "risk",
    binary_metrics(["r_name"])
    + f"""select m.r_name, cast(tp + fn as bigint) as positives, cast(fp + tn as bigint) as negatives, {r('m.roc_auc')} as roc_auc
from m join c on c.r_name = m.r_name""",
)
ORACLES["multiclass_auc"] = with_view(
    "orders_scored",
    OVR + f"select cast(label as varchar) as label, positives, negatives, {r('roc_auc')} as roc_auc from o",
)
ORACLES["log_loss"] = with_view(
    "risk", binary_metrics(["c_mktsegment"]) + f"select c_mktsegment, {r('log_loss')} as log_loss from m"
)
CURVE = """
d as (select score, sum(true_label) as pos, count(*) - sum(true_label) as neg from v group by score),
q as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
  sum(pos) over () as p, sum(neg) over () as n from d)
"""
ORACLES["roc_points"] = with_view(
    "risk",
    CURVE
    + f"""select score as threshold, {r(div('fp', 'n'))} as fpr, {r(div('tp', 'p'))} as tpr from q
union all select -1, 0, 0""",
)
ORACLES["pr_points"] = with_view(
    "risk",
    CURVE
    + f"""select score as threshold, {r(div0('tp', '(tp + fp)'))} as "precision", {r(div('tp', 'p'))} as recall from q
union all select -1, 1, 0""",
)
ORACLES["label_histogram"] = with_view(
    "orders_scored",
    """u as (select 'Predicted' as type, prediction as value from v union all select 'Actual', true_label from v)
select type, cast(value as varchar) as value, count(*) as n from u group by all""",
)
ORACLES["pred_distribution"] = with_view(
    "orders_scored",
    f"""
c as (select prediction, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as q from v group by prediction)
select '' as label, 'unique_predictions' as metric, cast(count(*) as double) as value from c
union all select '', 'most_common_prediction', (select cast(prediction as double) from c order by n desc, prediction limit 1)
union all select '', 'prediction_entropy', {r('-sum(q * log2(q + 1e-10))')} from c
union all select cast(prediction as varchar), 'class_proportion', {r('q')} from c""",
)

# --- regression -------------------------------------------------------------------------------

RESIDUALS = "e as (select *, true_value - prediction as res from v)"
REG = (
    "r2_score mean_squared_error root_mean_squared_error mean_absolute_error mean_absolute_percentage_error "
    "explained_variance_score residual_mean residual_std residual_skewness residual_kurtosis relative_mae "
    "relative_rmse max_error pearson_correlation"
).split()


def over(by: list[str]) -> str:
    return f"(partition by {', '.join(by)})" if by else "()"


def reg_metrics(by: list[str]) -> str:
    return f"""{RESIDUALS},
c as (select *, res - avg(res) over {over(by)} as d from e),
m as (select {keys(by)}1 - sum(res * res) / (count(*) * var_pop(true_value)) as r2_score, avg(res * res) as mean_squared_error,
  sqrt(avg(res * res)) as root_mean_squared_error, avg(abs(res)) as mean_absolute_error,
  avg(abs(res) / greatest(abs(true_value), 2.220446049250313e-16)) as mean_absolute_percentage_error,
  1 - var_pop(res) / var_pop(true_value) as explained_variance_score, avg(res) as residual_mean, stddev_pop(res) as residual_std,
  avg(d * d * d) / power(avg(d * d), 1.5) as residual_skewness, avg(d * d * d * d) / power(avg(d * d), 2) - 3 as residual_kurtosis,
  avg(abs(res)) / avg(abs(true_value)) as relative_mae, sqrt(avg(res * res)) / avg(abs(true_value)) as relative_rmse,
  max(abs(res)) as max_error, covar_pop(true_value, prediction) / (stddev_pop(true_value) * stddev_pop(prediction)) as pearson_correlation,
  count(*) as n from c {grouped(by)})
"""


FLAGS = ["l_returnflag", "l_linestatus"]
ORACLES["reg_metrics"] = with_view("items", reg_metrics([]) + tall("m", REG))
ORACLES["reg_metrics_by_flag"] = with_view("items", reg_metrics(FLAGS) + tall("m", REG, FLAGS))
JB = "n / 6.0 * (power(residual_skewness, 2) + power(residual_kurtosis, 2) / 4)"
ORACLES["jarque_bera"] = with_view(
    "items",
    reg_metrics(["l_returnflag"])
    + f"select l_returnflag, n, {r(JB)} as statistic, {r(f'exp(-({JB}) / 2)')} as p_value from m",
)


def horner(coefficients: tuple[float, ...], x: str) -> str:
    """Value of a polynomial, highest power first."""
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


# The published rational form of the normal distribution function below 7.07, and polynomials of the p-value.
UPPER = f"""exp(-x * x / 2) * {horner((0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376), 'x')}
  / {horner((0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752), 'x')}"""
FITTED = f"""case when m <= 0.302 then 1 when m <= 0.5 then {horner((81.218052, -138.55152, 80.709644, -19.828315, 2.76773), 'm')}
  when m <= 0.9 then {horner((-32.355711, 94.029866, -97.490286, 40.662806, -4.901232), 'm')}
  when m <= 1.31 then {horner((2.423045, -12.234627, 23.186922, -19.558097, 6.198765), 'm')} else 0 end"""
ORACLES["ks_normality"] = with_view(
    "items",
    f"""{RESIDUALS},
z as (select l_returnflag, (res - avg(res) over w) / stddev_samp(res) over w as z, row_number() over (partition by l_returnflag order by res) as i,
  count(*) over w as n from e window w as (partition by l_returnflag)),
u as (select *, abs(z) as x from z),
f as (select *, case when z > 0 then 1 - ({UPPER}) else {UPPER} end as f from u),
d as (select l_returnflag, any_value(n) as n, max(greatest(i * 1.0 / n - f, f - (i - 1) * 1.0 / n)) as d from f group by l_returnflag),
m as (select *, (sqrt(n) - 0.01 + 0.85 / sqrt(n)) * d as m, least(n, 100) as s, case when n > 100 then d * power(n / 100.0, 0.49) else d end as k from d),
p as (select *, exp(-7.01256 * k * k * (s + 2.78019) + 2.99587 * k * sqrt(s + 2.78019) - 0.122119 + 0.974598 / sqrt(s) + 1.67997 / s) as tail from m)
select l_returnflag, n, {r('d')} as statistic, {r(f'least(1, greatest(0, case when tail > 0.1 then {FITTED} else tail end))')} as p_value from p""",
)


def outliers(by: list[str]) -> str:
    on = " and ".join([f"e.{k} = c.{k}" for k in by] + ["true"])
    e = "".join(f"e.{k}, " for k in by)
    outside = "res < q25 - thr or res > q75 + thr"
    return f"""{RESIDUALS},
q as (select {keys(by)}quantile_cont(res, 0.25) as q25, quantile_cont(res, 0.75) as q75 from e {grouped(by)}),
c as (select *, 1.5 * (q75 - q25) as thr from q)
select {e}count(*) as n, {r('any_value(q25)')} as q25, {r('any_value(q75)')} as q75, {r('any_value(thr)')} as outlier_threshold,
  count(*) filter (where {outside}) as outlier_count,
  {r(f'100.0 * {total(outside)} / count(*)')} as outlier_percentage
from e join c on {on} {f"group by {', '.join(f'e.{k}' for k in by)}" if by else ''}"""


ORACLES["residual_outliers"] = with_view("items", outliers(["l_returnflag"]))
ORACLES["residual_outliers_overall"] = with_view("items", outliers([]))
ORACLES["error_bands"] = with_view(
    "items",
    f"""{RESIDUALS}, s as (select *, stddev_pop(res) over (partition by l_linestatus) as std from e)
select l_linestatus, """
    + ", ".join(f"{r(f'avg(cast(abs(res) <= {k} * std as int))')} as errors_within_{k}_std" for k in (1, 2, 3))
    + " from s group by l_linestatus",
)
ORACLES["quartile_perf"] = with_view(
    "items",
    f"""{RESIDUALS}, b as (select quantile_cont(true_value, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from e),
i as (select 'quartile_' || k as bin, q[k] as lo, q[k + 1] as hi from b, unnest([1, 2, 3, 4]) u(k))
select bin, {r('1 - sum(res * res) / (count(*) * var_pop(true_value))')} as r2, {r('avg(abs(res))')} as mae,
  count(*) as sample_count from e join i on true_value between lo and hi group by bin""",
)
ORACLES["qq_points"] = with_view(
    "items",
    f"""{RESIDUALS}, g as (select range / 100.0 as prob from range(1, 100)),
q as (select quantile_cont(res, [{', '.join(f'{i / 100}' for i in range(1, 100))}]) as q from e)
select {r('cast(prob as double)')} as prob, {r('q[cast(prob * 100 as int)]')} as sample from g, q""",
)
ORACLES["reg_distribution"] = with_view(
    "items",
    f"""c as (select *, prediction - avg(prediction) over (partition by l_returnflag) as d from v)
select l_returnflag, {r('avg(prediction)')} as prediction_mean, {r('stddev_pop(prediction)')} as prediction_std,
  {r('min(prediction)')} as prediction_min, {r('max(prediction)')} as prediction_max,
  {r('(max(prediction) - min(prediction))')} as prediction_range, {r('median(prediction)')} as prediction_median,
  {r('avg(d * d * d) / power(avg(d * d), 1.5)')} as prediction_skewness,
  {r('(avg(d * d * d * d) / power(avg(d * d), 2) - 3)')} as prediction_kurtosis from c group by l_returnflag""",
)

# --- fairness ---------------------------------------------------------------------------------


def unpivoted(attributes: list[str], columns: str) -> str:
    return "w as (" + " union all ".join(
        f"select '{a}' as attribute, cast({a} as varchar) as \"group\", {columns} from v where {a} is not null" for a in attributes
    ) + ")"


def binary_groups(attributes: list[str], by: list[str] = ()) -> str:
    return f"""{unpivoted(attributes, f'{keys(by)}true_label, prediction')},
g as (select {keys(by)}attribute, "group", count(*) as n, avg(cast(prediction = 1 as int)) as positive_rate,
  {div0(total('true_label = 1 and prediction = 1'), total('true_label = 1'))} as tpr,
  {div0(total('true_label = 0 and prediction = 1'), total('true_label = 0'))} as fpr,
  avg(cast(true_label = prediction as int)) as accuracy from w group by {keys(by)}attribute, "group")"""


def gaps(columns: dict[str, str], by: list[str] = ()) -> str:
    parts = ", ".join(f"max({c}) - min({c}) as {name}" for c, name in columns.items())
    return f"""a as (select {keys(by)}attribute, {div0('min(positive_rate)', 'max(positive_rate)')} as disparate_impact_ratio,
  {parts} from g group by {keys(by)}attribute having count(*) > 1)"""


def overall_bias(names: list[str], by: list[str] = ()) -> str:
    union = " union all ".join(
        [f"select {keys(by)}abs(1 - disparate_impact_ratio) as x from a"] + [f"select {keys(by)}{n} from a" for n in names]
    )
    return f"b as (select {keys(by)}least(1, avg(x)) as overall_bias_score from ({union}) {grouped(by)})"


CLASS_GAPS = {
    "positive_rate": "demographic_parity_diff",
    "tpr": "tpr_difference",
    "fpr": "fpr_difference",
    "accuracy": "accuracy_difference",
}


def fairness(view: str, groups: str, columns: dict[str, str], by: list[str] = ()) -> str:
    names = list(columns.values())
    return with_view(
        view,
        f"{groups}, {gaps(columns, by)}, {overall_bias(names, by)} "
        + tall("a", ["disparate_impact_ratio", *names], by, "attribute")
        + " union all "
        + tall("b", ["overall_bias_score"], by),
    )


RISK = ["c_mktsegment", "o_orderpriority", "r_name"]
ORACLES["fairness_groups"] = with_view(
    "risk",
    binary_groups(RISK)
    + f""" select attribute, "group", n, {r('positive_rate')} as positive_rate, {r('tpr')} as tpr, {r('fpr')} as fpr,
  {r('accuracy')} as accuracy from g""",
)
ORACLES["fairness_metrics"] = fairness("risk", binary_groups(RISK), CLASS_GAPS)
ORACLES["fairness_metrics_by_region"] = fairness("risk", binary_groups(RISK[:2], ["r_name"]), CLASS_GAPS, ["r_name"])
ORACLES["fairness_docs"] = fairness("docs", binary_groups(["lang", "source"]), CLASS_GAPS)
ORACLES["fairness_multiclass"] = fairness(
    "orders_scored",
    f"""{unpivoted(['o_orderpriority', 'c_mktsegment'], 'true_label, prediction')},
g as (select attribute, "group", count(*) as n, avg(prediction) as positive_rate,
  avg(cast(true_label = prediction as int)) as accuracy from w group by attribute, "group")""",
    {"positive_rate": "demographic_parity_diff", "accuracy": "accuracy_difference"},
)
REGRESSION_GROUPS = f"""h as (select *, prediction > (select median(prediction) from v) as above from v),
w as (select 'l_returnflag' as attribute, l_returnflag as "group", above, true_value - prediction as res, true_value, prediction from h
  union all select 'l_linestatus', l_linestatus, above, true_value - prediction, true_value, prediction from h),
g as (select attribute, "group", count(*) as n, avg(cast(above as int)) as positive_rate, avg(abs(res)) as mae_raw,
  avg(abs(res)) / (select avg(abs(true_value)) from v) as mae, sqrt(avg(res * res)) as rmse,
  1 - sum(res * res) / (count(*) * var_pop(true_value)) as r2, avg(prediction) as mean_prediction,
  stddev_pop(prediction) as std_prediction, median(prediction) as median_prediction from w group by attribute, "group")"""
ORACLES["fairness_regression"] = fairness(
    "items",
    REGRESSION_GROUPS,
    {"positive_rate": "demographic_parity_diff", "mae": "mae_difference", "r2": "r2_difference"},
)
ORACLES["bias_score"] = with_view(
    "risk",
    f"""{binary_groups(RISK[:2], ['r_name'])}, {gaps(CLASS_GAPS, ['r_name'])}, {overall_bias(list(CLASS_GAPS.values()), ['r_name'])},
k as (select r_name, count(*) as attributes, count(*) filter (where disparate_impact_ratio < 0.8) as attributes_with_bias from a group by r_name)
select b.r_name, {r('overall_bias_score')} as overall_bias_score, attributes, attributes_with_bias,
  case when overall_bias_score > 0.3 then 'high' when overall_bias_score > 0.1 then 'moderate' else 'low' end as bias_severity
from b join k on k.r_name = b.r_name""",
)
ORACLES["group_stats"] = with_view(
    "risk",
    binary_groups(RISK)
    + f""" select attribute, "group", n, {r('100.0 * n / (select count(*) from v)')} as percentage_of_total,
  {r('positive_rate')} as positive_rate, {r('accuracy')} as accuracy from g""",
)
ORACLES["group_stats_regression"] = with_view(
    "items",
    REGRESSION_GROUPS
    + f""" select attribute, "group", n, {r('100.0 * n / (select count(*) from v)')} as percentage_of_total, """
    + ", ".join(f"{r(c)} as {c}" for c in ("positive_rate", "rmse", "r2", "mean_prediction", "std_prediction", "median_prediction"))
    + f", {r('mae_raw')} as mae from g",
)
ORACLES["group_distribution"] = with_view(
    "orders_scored",
    f"""{unpivoted(['o_orderpriority', 'c_mktsegment'], 'prediction')}
select attribute, "group", cast(prediction as varchar) as value, count(*) as n,
  {r('count(*) / cast(sum(count(*)) over (partition by attribute, "group") as double)')} as share
from w group by attribute, "group", prediction""",
)
ORACLES["intersectional"] = with_view(
    "risk",
    f"""z as (select *, 1 as one from v)
select coalesce(c_mktsegment, '*') as c_mktsegment, coalesce(o_orderpriority, '*') as o_orderpriority, coalesce(r_name, '*') as r_name,
  count(*) as n, {r('avg(prediction)')} as mean_prediction, {r('avg(cast(prediction = 1 as int))')} as positive_rate,
  {r('avg(cast(true_label = prediction as int))')} as accuracy,
  {r(div0(total('true_label = 1 and prediction = 1'), total('true_label = 1')))} as tpr,
  {r(div0(total('true_label = 0 and prediction = 1'), total('true_label = 0')))} as fpr,
  cast(3 - grouping(c_mktsegment) - grouping(o_orderpriority) - grouping(r_name) as int) as level
from z group by cube (c_mktsegment, o_orderpriority, r_name)""",
)
ORACLES["intersectional_pairs"] = with_view(
    "items",
    f"""z as (select * from v) select l_returnflag, l_linestatus, count(*) as n, {r('avg(prediction)')} as mean_prediction,
  {r('avg(abs(true_value - prediction))')} as mae from z group by l_returnflag, l_linestatus""",
)
ORACLES["group_boxes"] = with_view(
    "items",
    f"""q as (select l_returnflag, quantile_cont(prediction, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from v group by l_returnflag)
select 'l_returnflag' as attribute, v.l_returnflag as "group", count(*) as n, """
    + ", ".join(f"{r(f'any_value(q[{i}])')} as \"{c}\"" for i, c in enumerate(("min", "q1", "median", "q3", "max"), 1))
    + """, count(*) filter (where prediction < q[2] - 1.5 * (q[4] - q[2]) or prediction > q[4] + 1.5 * (q[4] - q[2])) as outliers
from v join q on q.l_returnflag = v.l_returnflag group by v.l_returnflag""",
)
ORACLES["group_matrix"] = with_view(
    "risk",
    binary_groups(RISK)
    + f' select attribute, "group", {r("positive_rate")} as positive_rate, {r("accuracy")} as accuracy, {r("tpr")} as tpr from g',
)

# --- data quality -----------------------------------------------------------------------------

NULL_COLUMNS = ["l_orderkey", "l_tax", "l_returnflag", "l_quantity", "constant_col", "l_linestatus"]
NULL_NUMERIC = ["l_orderkey", "l_tax", "l_quantity", "constant_col"]


def completeness(columns: list[str]) -> str:
    cells = " + ".join(f"count(*) filter (where {c} is null)" for c in columns)
    holed = " + ".join(f"cast(count({c}) < count(*) as int)" for c in columns)
    anywhere = " or ".join(f"{c} is null" for c in columns)
    return f"""k as (select count(*) as n, {cells} as lost, {holed} as holed,
  count(*) filter (where {anywhere}) as rows_with_missing from v),
comp as (select n, n * {len(columns)} as cells, lost, holed, rows_with_missing, 1 - lost / (n * cast({len(columns)} as double)) as completeness_rate,
  100.0 * lost / (n * cast({len(columns)} as double)) as missing_percentage,
  100.0 * holed / {len(columns)} as percentage_columns_with_missing,
  100.0 * rows_with_missing / n as percentage_rows_with_missing from k)"""


ORACLES["completeness"] = with_view(
    "nulls",
    completeness(NULL_COLUMNS)
    + f""" select n as rows, cast({len(NULL_COLUMNS)} as bigint) as columns, cells, lost as missing_cells,
  {r('completeness_rate')} as completeness_rate, {r('missing_percentage')} as missing_percentage,
  cast(holed as bigint) as columns_with_missing, {r('percentage_columns_with_missing')} as percentage_columns_with_missing,
  rows_with_missing, {r('percentage_rows_with_missing')} as percentage_rows_with_missing from comp""",
)
ORACLES["missing_by_column"] = with_view(
    "nulls",
    "z as (select * from v) "
    + " union all ".join(
        f"select l_linestatus, '{c}' as \"column\", count(*) - count({c}) as missing_count, "
        f"{r(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_percentage from z group by l_linestatus"
        for c in NULL_COLUMNS
        if c != "l_linestatus"
    ),
)
ORACLES["duplicates"] = with_view(
    "copies",
    f"""d as (select distinct * from v), n as (select (select count(*) from v) as a, (select count(*) from d) as b)
select a as rows, b as distinct_rows, a - b as duplicate_rows, {r('100.0 * (a - b) / a')} as duplicate_percentage from n""",
)
ORACLES["duplicates_by_digest"] = with_view(
    "copies",
    f"""d as (select lang, count(*) as b from (select distinct * from v) group by lang),
n as (select lang, count(*) as a from v group by lang)
select n.lang, a as rows, b as distinct_rows, a - b as duplicate_rows, {r('100.0 * (a - b) / a')} as duplicate_percentage
from n join d on d.lang is not distinct from n.lang""",
)


def profile(c: str) -> str:
    numeric = c in NULL_NUMERIC
    head = f"""select '{c}' as "column", count(*) - count({c}) as missing_count, {r(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_percentage,
  count(distinct {c}) as unique_values, (select cast({c} as varchar) from v where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as most_frequent"""
    if not numeric:
        return head + "".join(
            f', cast(-1 as double) as "{m}"' for m in ("mean", "std", "min", "max", "median", "skewness", "kurtosis")
        ) + " from v"
    x = f"(cast({c} as double) - (select avg(cast({c} as double)) from v))"
    skew = f"avg(power({x}, 3)) / nullif(power(var_pop({c}), 1.5), 0)"
    kurt = f"avg(power({x}, 4)) / nullif(power(var_pop({c}), 2), 0) - 3"
    parts = {
        "mean": f"avg(cast({c} as double))",
        "std": f"stddev_samp({c})",
        "min": f"cast(min({c}) as double)",
        "max": f"cast(max({c}) as double)",
        "median": f"median(cast({c} as double))",
        "skewness": f"coalesce({skew}, -1)",
        "kurtosis": f"coalesce({kurt}, -1)",
    }
    return head + "".join(f', {r(f"({e})")} as "{m}"' for m, e in parts.items()) + " from v"


ORACLES["column_profile"] = with_view(
    "nulls", "z as (select 1) " + " union all ".join(profile(c) for c in NULL_COLUMNS)
)
ITEM_NUMERIC = ["l_orderkey", "l_linenumber", "prediction", "true_value", "l_quantity", "l_discount", "l_tax"]


def stacked(columns: list[str], by: list[str] = ()) -> str:
    return "w as (" + " union all ".join(
        f"select {keys(by)}'{c}' as \"column\", cast({c} as double) as x from v where {c} is not null" for c in columns
    ) + ")"


ORACLES["iqr_outliers"] = with_view(
    "items",
    f"""{stacked(ITEM_NUMERIC, ['l_returnflag'])},
q as (select l_returnflag, "column", quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from w group by all)
select w.l_returnflag, w."column", count(*) as n, {r('any_value(q1)')} as q1, {r('any_value(q3)')} as q3,
  count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as outlier_count,
  {r('100.0 * ' + total('x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)') + ' / count(*)')} as outlier_percentage
from w join q on q.l_returnflag = w.l_returnflag and q."column" = w."column" group by w.l_returnflag, w."column" """,
)


def corr(a: str, b: str, source: str = "v") -> str:
    return (
        f"(select case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 "
        f"then covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end "
        f"from {source} where {a} is not null and {b} is not null)"
    )


ORACLES["corr_matrix"] = with_view(
    "nulls",
    "z as (select 1) "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, {r(f'coalesce({corr(a, b)}, -9)')} as corr"
        for a in NULL_NUMERIC
        for b in NULL_NUMERIC
    ),
)
ORACLES["vector_quality"] = with_view(
    "nulls",
    f"""z as (select * from v) select l_linestatus, count(*) - count(l_tax) as missing, cast(0 as bigint) as infinite,
  {r('(count(distinct l_tax) + max(cast(l_tax is null as int))) / cast(count(*) as double)')} as diversity from z group by l_linestatus""",
)
ORACLES["class_balance"] = with_view(
    "orders_scored",
    f"""c as (select o_orderpriority, true_label, count(*) as n from v group by all)
select o_orderpriority, count(*) as classes, {r('min(n) / cast(max(n) as double)')} as class_balance_ratio from c group by o_orderpriority""",
)
SKEW = "avg(power(x - m, 3)) / nullif(power(var_pop(x), 1.5), 0)"
ORACLES["column_flags"] = with_view(
    "nulls",
    f"""{stacked(NULL_NUMERIC)}, c as (select *, avg(x) over (partition by "column") as m from w)
select "column", var_pop(x) = 0 as zero_variance, coalesce(abs({SKEW}) > 3, false) as highly_skewed from c group by "column" """,
)
ORACLES["extreme_values"] = (
    "with w as ("
    + " union all ".join(f"select '{c}' as \"column\", cast({c} as double) as x from events" for c in ("event_id", "user_id", "value"))
    + """), s as (select "column", avg(x) as m, stddev_pop(x) as d from w group by "column")
select w."column", count(x) as n, count(*) filter (where abs(x - m) / d > 3) as extremes
from w join s on s."column" = w."column" group by w."column" """
)
ORACLES["profiling_summary"] = (
    "select count(*) as total_rows, cast(11 as bigint) as total_columns, cast(8 as bigint) as numeric_columns, "
    "cast(2 as bigint) as categorical_columns, cast(1 as bigint) as datetime_columns from lineitem"
)
ORACLES["quality_scores"] = with_view(
    "nulls",
    f"""{completeness(NULL_COLUMNS)}, d as (select count(*) as b from (select distinct * from v)),
t as (select 'l_returnflag' as c, l_returnflag as x from v union all select 'l_linestatus', l_linestatus from v),
u as (select c, count(distinct x) as k, count(distinct x) filter (where x = lower(x) and regexp_matches(x, '[a-z]')) as low from t group by c),
s as (select count(*) filter (where k < n / 2.0 and k > 1 and low > 0 and low < k) as bad from u, comp),
{stacked(NULL_NUMERIC)}, z as (select "column", avg(x) as m, stddev_pop(x) as sd from w group by "column"),
y as (select w."column", count(*) as k, count(*) filter (where abs(x - m) > 4 * sd and sd > 0) as wild from w join z on z."column" = w."column" group by all),
p as (select count(*) filter (where wild > 0.01 * k) as wild from y)
select {r('completeness_rate')} as completeness, {r('1 - (n - b) / cast(n as double)')} as uniqueness,
  {r('greatest(0, 1 - 0.1 * bad)')} as consistency,
  {r('greatest(0, 1 - (case when (select count(*) - count(l_tax) from v) > 0 then 0.3 else 0 end) - 0.05 * wild)')} as validity
from comp, d, s, p""",
)
ORDER_COLUMNS = (
    "o_orderkey prediction true_label o_orderpriority c_mktsegment o_totalprice score_0 score_1 score_2".split()
)
ORDER_NUMERIC = [c for c in ORDER_COLUMNS if c not in ("o_orderpriority", "c_mktsegment")]


def quality(columns: list[str], numeric: list[str], truth: str, texts: int) -> str:
    """The tall quality metrics as CTE ``qm`` for a view without NaN or infinity."""
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    high = " + ".join(f"coalesce(cast(abs({corr(a, b)}) > 0.95 as int), 0)" for a, b in pairs)
    return f"""{completeness(columns)}, dd as (select count(*) as b from (select distinct * from v)),
{stacked(numeric)}, iq as (select "column", quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from w group by "column"),
io as (select w."column", count(*) as k, count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as bad
  from w join iq on iq."column" = w."column" group by w."column"),
oo as (select 100.0 * sum(bad) / sum(k) as outlier_percentage, count(*) filter (where bad > 0) as columns_with_outliers from io),
cc as (select {truth}, count(*) as k from v group by {truth}),
sk as (select count(*) filter (where skew > 3) as skewed from (select abs({SKEW}) as skew
  from (select *, avg(x) over (partition by "column") as m from w) group by "column")),
qq as (select *, {len(numeric)} as numeric_columns, {texts} as categorical_columns, {len(columns)} as total_columns,
  n - b as duplicate_rows, 100.0 * (n - b) / n as duplicate_percentage, 0 as predictions_missing, 0 as predictions_infinite,
  (select count(distinct prediction) from v) / cast(n as double) as prediction_diversity, 0 as true_values_missing,
  0 as true_values_infinite, (select case when count(*) <= 20 then min(k) / cast(max(k) as double) end from cc) as class_balance_ratio,
  {high} as highly_correlated_features, nullif(skewed, 0) as highly_skewed_features, holed as columns_with_missing
  from comp, dd, oo, sk),
qm as (select *, greatest(0, 1 - 0.3 * missing_percentage / 100 - least(0.2, 0.2 * duplicate_percentage / 100)
  - least(0.2, 0.2 * outlier_percentage / 100)) as confidence_score from qq)"""


QUALITY = (
    "completeness_rate missing_percentage columns_with_missing percentage_columns_with_missing rows_with_missing "
    "percentage_rows_with_missing duplicate_rows duplicate_percentage numeric_columns categorical_columns total_columns "
    "outlier_percentage columns_with_outliers predictions_missing predictions_infinite prediction_diversity "
    "true_values_missing true_values_infinite class_balance_ratio highly_correlated_features highly_skewed_features "
    "confidence_score"
).split()
ORDER_QUALITY = quality(ORDER_COLUMNS, ORDER_NUMERIC, "true_label", 2)
ORACLES["quality_metrics"] = with_view("orders_scored", ORDER_QUALITY + " " + tall("qm", QUALITY))
ORACLES["metric_categories"] = with_view(
    "orders_scored",
    f"""{ORDER_QUALITY}, t as ({tall('qm', QUALITY, raw=True)}),
c as (select *, case when regexp_matches(metric, 'accuracy|precision|recall|f1|r2|rmse|mae') then 'Performance'
  when regexp_matches(metric, 'completeness|quality|missing|duplicate') then 'Quality'
  when regexp_matches(metric, 'bias|fairness|disparate|demographic') then 'Bias' else 'Other' end as category from t)
select category, metric, {r(div0('100.0 * value', 'sum(value) over (partition by category)'))} as percentage from c""",
)


def histogram(columns: list[str], bins: int, by: list[str] = (), rename: dict[str, str] | None = None) -> str:
    names = rename or {}
    w = "w as (" + " union all ".join(
        f"select {keys(by)}'{names.get(c, c)}' as \"column\", cast({c} as double) as x from e where {c} is not null" for c in columns
    ) + ")"
    part = ", ".join([*by, '"column"'])
    return f"""{w}, s as (select *, min(x) over (partition by {part}) as lo, max(x) over (partition by {part}) as hi from w),
k as (select *, least({bins}, coalesce(cast(floor((x - lo) * {bins} / nullif(hi - lo, 0)) as int) + 1, 1)) as bin from s)
select {keys(by)}"column", cast(bin as int) as bin, {r(f'(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / {bins}))')} as lower,
  {r(f'(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / {bins}))')} as upper, count(*) as n from k group by {part}, bin"""


ORACLES["histograms"] = with_view("nulls", "e as (select * from v), " + histogram(NULL_NUMERIC, 10))
ORACLES["residual_histograms"] = with_view(
    "items",
    RESIDUALS + ", " + histogram(["res", "true_value", "prediction"], 30, ["l_returnflag"],
                                 {"res": "residual", "true_value": "actual", "prediction": "predicted"}),
)
ORACLES["column_boxes"] = with_view(
    "items",
    f"""{stacked(ITEM_NUMERIC)}, q as (select "column", count(*) as n, quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from w group by "column")
select "column", n, """
    + ", ".join(f'{r(f"q[{i}]")} as "{c}"' for i, c in enumerate(("min", "q1", "median", "q3", "max"), 1))
    + " from q",
)
ORACLES["distribution_summary"] = with_view(
    "items",
    f"""z as (select * from v) select l_linestatus, {r('avg(prediction)')} as mean, {r('median(prediction)')} as median,
  {r('stddev_pop(prediction)')} as std from z group by l_linestatus""",
)
ORACLES["completeness_cells"] = with_view(
    "nulls",
    completeness(NULL_COLUMNS)
    + " select 'Complete' as label, cells - lost as cells from comp union all select 'Missing', lost from comp",
)
ORACLES["residual_points"] = with_view(
    "items",
    f"""{RESIDUALS} select l_orderkey as "index", true_value as actual, prediction as predicted, res as residual,
  abs(res) as absolute_error from e""",
)

# --- validation -------------------------------------------------------------------------------

ISSUES = f"""{completeness(NULL_COLUMNS)}, d as (select count(*) as b from (select distinct * from v)),
pc as (select l_quantity, count(*) as k from v group by l_quantity),
pf as (select count(*) as kinds, min(k) as lo, max(k) as hi from pc),
f as (select *, n - b as copies, 100.0 * (n - b) / n as share from comp, d, pf),
{stacked(NULL_NUMERIC)}, s as (select "column", avg(x) as m, stddev_samp(x) as sd, min(x) as lo, max(x) as hi, count(*) as k from w group by "column"),
x5 as (select w."column", count(*) as wild from w join s on s."column" = w."column" where sd > 0 and abs(x - m) / sd > 5 group by w."column"),
ml as (select count(*) - count(l_tax) as lost from v),
issues as (
select 'missing_overall' as rule, case when missing_percentage > 50 then 'error' else 'warning' end as severity, '' as "column", cast(-1 as bigint) as affected_rows
  from f where missing_percentage > 20
union all select 'duplicates', case when share > 10 then 'warning' else 'info' end, '', copies from f where share > 10 or copies > 1
union all select 'sample_size', case when n < 10 then 'error' else 'warning' end, '', -1 from f where n < 100
union all select 'protected_absent', 'error', 'absent', -1
union all select 'prediction_constant', 'error', '', -1 from f where kinds = 1
union all select 'prediction_diversity', 'warning', '', -1 from f where kinds <> 1 and kinds < 0.01 * n
union all select 'prediction_imbalance', 'warning', '', -1 from f where kinds <= 20 and lo < 0.01 * hi
union all select 'truth_nan', 'warning', '', -1 from ml where lost > 0
union all select 'zero_variance', 'warning', "column", -1 from s where lo = hi and k > 1
union all select 'extreme_values', 'warning', "column", wild from x5
{''.join(f'''
union all select 'missing_column', 'warning', '{c}', count(*) - count({c}) from v having (count(*) - count({c})) > 0.5 * count(*)''' for c in NULL_COLUMNS)}
{''.join(f'''
union all select 'high_cardinality', 'warning', '{c}', -1 from v having count(distinct {c}) > 50''' for c in ('l_returnflag', 'l_linestatus'))}
union all select 'protected_cardinality', 'warning', 'l_linestatus', -1 from v having count(distinct l_linestatus) > 50)
"""
ORACLES["validation_issues"] = with_view("nulls", ISSUES + "select * from issues")
def faults(name: str) -> str:
    """Every rule of validation on one faulty table, as rows of ``(data, rule, severity, column, affected_rows, value)``."""
    columns, spec = FAULTY[name][1], faulty_spec(name)
    numbers, texts = ([c for c, k in columns.items() if k == kind] for kind in ("number", "text"))
    gap = {c: f"({c} is null or isnan(cast({c} as double)))" if c in numbers else f"({c} is null)" for c in columns}
    cells = " + ".join(f"count(*) filter (where {g})" for g in gap.values())
    rows = [
        "select 'empty_data', 'error', '', -1, -1.0 from f where n = 0",
        "select 'missing_overall', case when missing > 50 then 'error' else 'warning' end, '', -1, missing from f where missing > 20",
        "select 'duplicates', case when share > 10 then 'warning' else 'info' end, '', copies, share from f where share > 10 or copies > 1",
        "select 'sample_size', case when n < 10 then 'error' else 'warning' end, '', -1, n from f where n < 100",
    ]
    if not numbers:
        rows.append("select 'no_numeric_columns', 'warning', '', -1, -1.0 from f")
    rows += [f"select 'protected_absent', 'error', '{a}', -1, -1.0 from f" for a in spec.protected if a not in columns]
    if "prediction" in columns:
        rows += [
            "select 'prediction_nan', 'error', '', -1, nans from p where nans > 0",
            "select 'prediction_infinite', 'error', '', -1, infs from p where infs > 0",
            "select 'prediction_constant', 'error', '', -1, -1.0 from p where kinds = 1",
            "select 'prediction_diversity', 'warning', '', -1, kinds from p where kinds <> 1 and kinds < 0.01 * n",
            "select 'prediction_imbalance', 'warning', '', -1, -1.0 from p where kinds <= 20 and lo < 0.01 * hi",
        ]
    else:
        rows.append("select 'no_predictions', 'error', '', -1, -1.0 from f where n > 0")
    if spec.truth:
        rows.append(f"select 'truth_nan', 'warning', '', -1, count(*) filter (where {gap[spec.truth]}) from v having count(*) filter (where {gap[spec.truth]}) > 0")
    for c in columns:
        lost = f"count(*) filter (where {gap[c]})"
        rows.append(f"select 'missing_column', 'warning', '{c}', {lost}, 100.0 * {lost} / count(*) from v having {lost} > 0.5 * count(*)")
        if c in texts:
            rows.append(f"select 'high_cardinality', 'warning', '{c}', -1, count(distinct {c}) from v having count(distinct {c}) > 50")
        if c in spec.protected:
            rows.append(f"select 'protected_cardinality', 'warning', '{c}', -1, count(distinct {c}) from v having count(distinct {c}) > 50")
    for c in numbers:
        rows.append(f"select 'zero_variance', 'warning', '{c}', -1, -1.0 from v where not {gap[c]} having count(*) > 1 and min({c}) = max({c})")
        rows.append(
            f"""select 'extreme_values', 'warning', '{c}', count(*), count(*) from (select abs(x - avg(x) over ()) / nullif(stddev_samp(x) over (), 0) as z
  from (select cast({c} as double) as x from v where not {gap[c]} and not isinf(cast({c} as double)))) where z > 5 having count(*) > 0"""
        )
    predicted = f"""p as (select count(*) as kinds, min(k) as lo, max(k) as hi, coalesce(sum(k) filter (where x is null), 0) as nans,
  coalesce(sum(k) filter (where isinf(x)), 0) as infs, sum(k) as n
  from (select case when not {gap['prediction']} then cast(prediction as double) end as x, count(*) as k from v group by x)),""" if "prediction" in columns else ""
    return f"""select '{name}' as "data", rule, severity, col as "column", cast(affected as bigint) as affected_rows, {r('cast(value as double)')} as value from (
with v as ({view_sql(name)}), c as (select count(*) as n, {cells} as lost from v), d as (select count(*) as b from (select distinct * from v)), {predicted}
f as (select n, n - b as copies, 100.0 * (n - b) / nullif(n, 0) as share, 100.0 * lost / nullif(n * {len(columns)}, 0) as missing from c, d)
{' union all '.join(rows)}) z(rule, severity, col, affected, value)"""


ORACLES["validation_rules"] = " union all ".join(faults(name) for name in FAULTY)
ORACLES["validation_summary"] = with_view(
    "nulls",
    ISSUES
    + """select count(*) as total_issues, count(*) filter (where severity = 'error') as error_count,
  count(*) filter (where severity = 'warning') as warning_count, count(*) filter (where severity = 'info') as info_count,
  count(*) filter (where severity = 'error') = 0 as is_valid from issues""",
)
ORACLES["prediction_match"] = """
select (select count(*) from orders) as data_rows, (select count(*) from lineitem) as prediction_rows,
  (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) as data_unmatched,
  (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) as predictions_unmatched"""

# --- roles and configuration ------------------------------------------------------------------


ORACLES["problem_type"] = "with " + ", ".join(
    f"v_{name} as ({view_sql(name)})" for name in ("docs", "orders_scored", "items", "risk")
) + ", f as (" + " union all ".join(
    f"""select '{name}' as data, count(distinct prediction) as pd, bool_and(prediction = floor(prediction)) as pi,
  count(distinct {truth}) as yd, bool_and({truth} = floor({truth})) as yi, {discrete} as discrete from v_{name}"""
    for name, truth, discrete in (
        ("docs", "true_label", "true"),
        ("orders_scored", "true_label", "true"),
        ("items", "true_value", "false"),
        ("risk", "true_label", "true"),
    )
) + """)
select data, 'engine' as mode, case when pd = 2 then 'binary' when pi and pd <= 20 then 'multiclass'
  when yd <= 20 and yi then case when yd = 2 then 'binary' else 'multiclass' end else 'regression' end as problem from f
union all select data, 'analyzer', case when pd = 2 then 'binary' when pd <= 20 then 'multiclass' else 'regression' end from f
union all select data, 'config', case when pd = 2 then 'binary' when pd <= 20 and pi then 'multiclass' else 'regression' end from f
union all select data, 'column', case when pd = 2 then 'binary' when pd <= 20 and discrete then 'multiclass' else 'regression' end from f"""
ORACLES["problem_type_by_flag"] = with_view(
    "items",
    """z as (select * from v) select l_returnflag, case when count(distinct prediction) = 2 then 'binary'
  when bool_and(prediction = floor(prediction)) and count(distinct prediction) <= 20 then 'multiclass'
  when bool_and(true_value = floor(true_value)) and count(distinct true_value) <= 20 then
    case when count(distinct true_value) = 2 then 'binary' else 'multiclass' end
  else 'regression' end as problem from z group by l_returnflag""",
)
ORACLES["configuration_issues"] = with_view(
    "risk",
    """n as (select count(*) as n, count(distinct prediction) as k from v)
select 'missing_column' as issue, 'absent' as "column"
union all select 'sample_size', '' from n where n < 10
union all select 'regression_with_few_predictions', 'prediction' from n where k <= 10""",
)
ORACLES["prepared_missing"] = with_view(
    "nulls",
    "z as (select 1), m as ("
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as missing_count, count(*) as n from v" for c in NULL_COLUMNS
    )
    + f""") select "column", missing_count, {r('100.0 * missing_count / n')} as missing_percentage from m where missing_count > 0""",
)

# The name keywords of each role, in tie order of the roles.
ROLE_WORDS = {
    "prediction": ["prediction", "pred", "predicted", "predict", "output", "y_pred", "forecast", "estimate", "score", "class", "label"],
    "true_value": ["true", "actual", "real", "ground_truth", "target", "y_true", "label", "correct", "reference", "expected"],
    "probability": ["prob", "probability", "confidence", "score", "likelihood", "prob_", "proba", "confidence_score"],
    "protected_attribute": [
        "gender", "race", "ethnicity", "age", "religion", "disability", "sexual_orientation", "nationality", "protected", "sensitive", "demographic",
        "group", "category",
    ],
    "timestamp": ["time", "date", "timestamp", "created", "updated", "datetime", "period", "when", "at"],
    "identifier": ["id", "identifier", "key", "index", "row", "record", "unique", "uuid", "guid"],
}
DOC_COLUMNS = {
    "doc_id": "int", "prediction": "int", "true_label": "int", "score": "float", "lang": "text", "source": "text", "toxic": "int", "n_chars": "int",
}
CUSTOMER_COLUMNS = {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_mktsegment": "text", "c_acctbal": "float"}


def column_sql(columns: dict[str, str], source: str) -> str:
    """Facts of every column."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        low, high = (f"cast(min({c}) as double)", f"cast(max({c}) as double)") if kind == "float" else ("null", "null")
        dated = f"count(*) filter (where {c} is not null and try_cast({c} as timestamp) is null) = 0" if kind == "text" else "null"
        parts.append(
            f"""select {i} as ordinal, '{c}' as "column", '{kind}' as kind, count(*) as "rows", count(*) filter (where {c} is null) as missing,
  count(distinct {c}) as n_values, {low} as low, {high} as high, {dated} as dated from {source}"""
        )
    return "fx as (" + " union all ".join(parts) + ")"


def role_sql(columns: dict[str, str], source: str, token: bool = False) -> str:
    """Roles from the best of name and data scores; data scores replace name scores."""
    words = ", ".join(f"({i}, '{role}', '{w}')" for i, (role, ws) in enumerate(ROLE_WORDS.items()) for w in ws)
    inside = (
        "when list_contains(string_split(n, '_'), word) or contains('_' || n || '_', '_' || word || '_') then 0.8 else 0 end"
        if token
        else "when starts_with(n, word) or ends_with(n, word) then 0.8 when contains(n, word) then 0.6 else 0 end"
    )
    return f"""{column_sql(columns, source)}, kw(tie, role, word) as (values {words}),
ns as (select ordinal, tie, role, max(case when n = word then 1.0 {inside}) as score from (select *, lower("column") as n from fx), kw group by all),
rs as (select ns.*, "column", coalesce(case
  when role in ('prediction', 'true_value') and n_values = 2 and kind in ('int', 'bool') then 0.7
  when role = 'probability' and kind = 'float' and low >= 0 and high <= 1 then 0.8
  when role = 'protected_attribute' and kind = 'text' and n_values < 20 then 0.4
  when role = 'timestamp' and (kind = 'time' or (kind = 'text' and missing < "rows" and dated)) then 0.9
  when role = 'identifier' and n_values = "rows" and n_values > 10 then 0.8 end, score) as s from ns join fx using (ordinal)),
rk as (select *, row_number() over (partition by ordinal order by s desc, tie) as k from rs),
ro as (select ordinal, any_value("column") as "column", max(case when k = 1 then case when s < 0.3 then 'feature' else role end end) as role,
  cast(max(case when k = 1 then case when s < 0.3 then 0.5 else s end end) as double) as confidence,
  coalesce(string_agg(role, ',' order by k) filter (where k <= 3 and s > 0.3), '') as suggestions from rk group by ordinal)"""


ORACLES["column_roles"] = with_view("docs", role_sql(DOC_COLUMNS, "v") + ' select "column", role, confidence, suggestions from ro')
ORACLES["column_roles_by_token"] = f'with {role_sql(CUSTOMER_COLUMNS, "customer", token=True)} select "column", role, confidence from ro'
ORACLES["suggest_columns"] = with_view("docs", role_sql(DOC_COLUMNS, "v") + " select \"column\", confidence from ro where role = 'protected_attribute'")
PROTECTED_SQL = " or ".join(f"contains(n, '{w}')" for w in [*ROLE_WORDS["protected_attribute"], "sex"])
ORACLES["protected_attributes"] = with_view(
    "docs",
    f"""w as (select * rename (lang as language_group) from v), {column_sql({("language_group" if c == "lang" else c): k for c, k in DOC_COLUMNS.items()}, 'w')}
select "column" from (select *, lower("column") as n from fx) where ({PROTECTED_SQL}) and (kind = 'text' or n_values <= 10)""",
)


def config_sql(least: float) -> str:
    def first(role: str) -> str:
        return f"min_by(\"column\", ordinal) filter (where role = '{role}' and confidence >= {least})"

    def every(role: str) -> str:
        return f"coalesce(string_agg(\"column\", ',' order by ordinal) filter (where role = '{role}' and confidence >= {least}), '')"

    return f"""cf as (select {first('prediction')} as prediction, {first('true_value')} as truth, {every('probability')} as probabilities,
  {every('protected_attribute')} as protected, {first('timestamp')} as "timestamp", {first('identifier')} as identifier, {every('feature')} as features from ro)"""


ORACLES["data_config"] = with_view("docs", f"{role_sql(DOC_COLUMNS, 'v')}, {config_sql(0)} select * from cf")
NUMERIC_DOCS = [c for c, k in DOC_COLUMNS.items() if k != "text"]
SMART = f"""{role_sql(DOC_COLUMNS, 'v')}, {config_sql(0.5)},
sp as (select prediction, {{truth}} as truth, "timestamp", identifier, probabilities, {{protected}} as protected, features from cf),
sm as (select * replace (case when features <> '' then features else (select string_agg(c, ',' order by i) from
  (select unnest({NUMERIC_DOCS}) as c, unnest(range({len(NUMERIC_DOCS)})) as i) where not list_contains(
    list_concat([prediction, truth, "timestamp", identifier], string_split(probabilities, ','), string_split(protected, ',')), c)) end as features) from sp)"""
ORACLES["smart_config"] = with_view(
    "docs",
    SMART.format(
        truth="'true_label'",
        protected="array_to_string(list_concat(['lang'], list_filter(string_split(protected, ','), lambda c: c <> 'lang' and c <> '')), ',')",
    )
    + " select * from sm",
)
PLAIN_SMART = SMART.format(truth="truth", protected="protected")
ORACLES["config_confidence"] = with_view(
    "docs",
    f"""{PLAIN_SMART}, cc as (select case when prediction is not null then (select confidence from ro where "column" = prediction) end as p,
  case when truth is not null then (select confidence from ro where "column" = truth) end as t,
  case when protected <> '' then (select avg(confidence) from ro where list_contains(string_split(protected, ','), "column")) end as a,
  (select 1 - sum(missing) * 1.0 / sum("rows") from fx) as complete, least(1, (select max("rows") from fx) / 1000.0) as size from sm)
select p as prediction_column, t as true_value_column, a as protected_attributes,
  {r(f"(complete + size + {len(NUMERIC_DOCS) / len(DOC_COLUMNS)!r} + coalesce((coalesce(p, 0) + coalesce(t, 0) + coalesce(a, 0)) / nullif((p is not null)::int + (t is not null)::int + (a is not null)::int, 0), 0.5)) / 4")} as overall from cc""",
)
ORACLES["suggested_analyses"] = with_view(
    "docs",
    f"""{PLAIN_SMART} select concat_ws(',', 'quality', case when prediction is not null then 'performance' end, case when protected <> '' then 'bias' end,
  case when features <> '' or {len(NUMERIC_DOCS)} > 0 then 'explainability' end) as analyses from sm""",
)

# --- explanations -----------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def target_corr(features: list[str], by: list[str] = ()) -> str:
    return "tc as (" + " union all ".join(
        f"""select {keys(by)}'{f}' as feature, coalesce(covar_pop({f}, true_value)
  / nullif(stddev_pop({f}) * stddev_pop(true_value), 0), 0) as corr from v {grouped(by)}"""
        for f in features
    ) + ")"


ORACLES["target_corr"] = with_view(
    "items", target_corr(FEATURES, ["l_returnflag"]) + f" select l_returnflag, feature, {r('corr')} as corr from tc"
)
ORACLES["interactions"] = with_view(
    "items",
    target_corr(FEATURES)
    + ", p as ("
    + " union all ".join(
        f"""select '{a}' as feature_a, '{b}' as feature_b, abs(covar_pop({a} * {b}, true_value)
  / (stddev_pop({a} * {b}) * stddev_pop(true_value))) as x from v"""
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i + 1 :]
    )
    + f""") select feature_a, feature_b, {r('greatest(0, x - greatest(abs(a.corr), abs(b.corr)))')} as strength
from p join tc a on a.feature = feature_a join tc b on b.feature = feature_b""",
)
def first_split(features: list[str], target: str, score: str) -> str:
    """The best split of each key; ``score(n, s, t)`` is what a side adds, from its size and the sums of the target and its square."""
    values = " union all ".join(f"select l_returnflag, '{f}' as feature, {i} as i, cast({f} as double) as x, {target} as y from v" for i, f in enumerate(features))

    def side(n: str, s: str) -> str:
        return f"({score.format(n=n, s=s)})"

    return f"""a as ({values}),
c as (select l_returnflag, feature, i, x, cast(count(*) as double) as n, sum(y) as s from a group by all),
g as (select *, sum(n) over w as ln, sum(s) over w as ls, sum(n) over k as tn, sum(s) over k as ts, dense_rank() over w - 1 as code
  from c window w as (partition by l_returnflag, feature order by x), k as (partition by l_returnflag, feature)),
b as (select l_returnflag, feature, i, code, cast(tn as bigint) as n, {side('ln', 'ls')} + {side('(tn - ln)', '(ts - ls)')} - {side('tn', 'ts')} as gain from g where ln < tn)
select l_returnflag, feature, cast(code as int) as code, {r('gain')} as gain, n from b
qualify row_number() over (partition by l_returnflag order by gain desc, i, code) = 1"""


ORACLES["perm_importance"] = f"""with b as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, l_extendedprice as y, l_quantity as q, l_discount as d from lineitem),
p as (select b.*, k, row_number() over w as i, count(*) over (partition by k) as n from b, (select unnest(range(5)) as k) t
  window w as (partition by k order by md5(id || ':' || k || ':43'), id)),
o as (select a.y, a.k, a.q, a.d, o.q as oq, o.d as od from p a join p o on o.k = a.k and o.i = a.i % a.n + 1),
base as (select avg(power(y - q * 1500.0 * (1 - d), 2)) as loss from b),
l as (select k, 'l_quantity' as feature, avg(power(y - oq * 1500.0 * (1 - d), 2)) as loss from o group by k
  union all select k, 'l_discount', avg(power(y - q * 1500.0 * (1 - od), 2)) from o group by k
  union all select k, 'l_tax', avg(power(y - q * 1500.0 * (1 - d), 2)) from o group by k)
select feature, round(avg(l.loss) - any_value(base.loss), 1) + 0.0 as importance from l, base group by feature"""
SQUARES, GINI = "{s} * {s} / {n}", "({s} * {s} + ({n} - {s}) * ({n} - {s})) / {n}"
ORACLES["surrogate_splits"] = (
    f"select 'binary' as problem, * from ({with_view('picked', first_split(FEATURES, 'cast(true_label as double)', GINI))}) z union all "
    f"select 'regression', * from ({with_view('items', first_split(FEATURES, 'true_value - avg(true_value) over (partition by l_returnflag)', SQUARES))}) z"
)
WIDE = list(SPECS["wide"].features)
FILLED = "x as (select o_totalprice as y, " + ", ".join(f"coalesce({c}, avg({c}) over ()) as {c}" for c in WIDE) + " from v)"
WIDE_CORR = "tc as (" + " union all ".join(f"select '{c}' as feature, coalesce(corr({c}, y), 0) as corr from x" for c in WIDE) + ")"
ORACLES["interactions_wide"] = with_view(
    "wide",
    f"{FILLED}, {WIDE_CORR}, p as ("
    + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, abs(corr({a} * {b}, y)) as x from x" for i, a in enumerate(WIDE) for b in WIDE[i + 1 :])
    + f""") select feature_a, feature_b, {r('greatest(0, x - greatest(abs(a.corr), abs(b.corr)))')} as strength
from p join tc a on a.feature = feature_a join tc b on b.feature = feature_b""",
)
IMPORTANCE_STATS = """im as (select feature, abs(corr) as v, row_number() over (order by abs(corr)) as i,
  row_number() over (order by abs(corr) desc) as d, sum(abs(corr)) over () as total, count(*) over () as n from tc),
st as (select max(v) as top_feature_importance, sum(v) filter (where d <= 3) as top_3_importance_sum,
  sum(v) filter (where d <= 3) / sum(v) as importance_concentration,
  greatest(0, least(1, (max(n) + 1 - 2 * sum((n + 1 - i) * v / total)) / max(n))) as importance_gini,
  cast(count(*) filter (where v > 0.01) as double) as num_important_features,
  count(*) filter (where v > 0.01) / cast(max(n) as double) as feature_diversity,
  avg(v) as mean_importance, stddev_pop(v) as std_importance, min(v) as min_importance, max(v) as max_importance,
  median(v) as median_importance, cast(count(*) filter (where v > 0.01) as double) as effective_feature_count,
  -sum(v / total * log2(v / total)) filter (where v > 0) as importance_entropy,
  count(*) filter (where v > 0.01) / cast(max(n) as double) as feature_utilization_rate from im)"""
STATS = (
    "top_feature_importance top_3_importance_sum importance_concentration importance_gini num_important_features "
    "feature_diversity mean_importance std_importance min_importance max_importance median_importance "
    "effective_feature_count importance_entropy feature_utilization_rate"
).split()
ORACLES["importance_stats"] = with_view(
    "items",
    f"{target_corr(FEATURES)}, {IMPORTANCE_STATS} select " + ", ".join(f"{r(s)} as {s}" for s in STATS) + " from st",
)
ORACLES["feature_ranking"] = with_view(
    "items",
    f"""{target_corr(FEATURES, ['l_returnflag'])}, i as (select l_returnflag, feature, abs(corr) as v from tc),
q as (select l_returnflag, quantile_cont(v, 0.25) as lo, quantile_cont(v, 0.75) as hi from i group by l_returnflag)
select i.l_returnflag, cast(row_number() over (partition by i.l_returnflag order by v desc, feature) as int) as rank, feature,
  {r('v')} as importance, {r('100 * v / sum(v) over (partition by i.l_returnflag)')} as importance_percentage,
  case when v > hi then 'high' when v > lo then 'medium' else 'low' end as level
from i join q on q.l_returnflag = i.l_returnflag""",
)
ORACLES["top_features"] = with_view(
    "items",
    target_corr(FEATURES)
    + f" select feature, {r('abs(corr)')} as importance from tc order by abs(corr) desc, feature limit 3",
)
ORACLES["top_correlations"] = with_view(
    "items",
    target_corr(FEATURES)
    + f""" select feature, {r('corr')} as corr, case when corr < 0 then 'negative' else 'positive' end as sign
from tc order by abs(corr) desc, feature limit 3""",
)
ORACLES["importance_histogram"] = with_view(
    "items",
    target_corr(FEATURES)
    + ", e as (select abs(corr) as importance from tc), "
    + histogram(["importance"], 20),
)
ORACLES["encoded_features"] = with_view(
    "items",
    """z as (select 1), x as (select true_value, dense_rank() over (order by l_returnflag) - 1 as a, dense_rank() over (order by l_linestatus) - 1 as b from v)
"""
    + " union all ".join(
        f"select '{f}' as feature, {r(f'(covar_pop({c}, true_value) / (stddev_pop({c}) * stddev_pop(true_value)))')} as corr from x"
        for f, c in (("l_returnflag", "a"), ("l_linestatus", "b"))
    ),
)
def explained(correlations: str, features: list[str], source: str, target: str) -> str:
    """Every explainability metric of a table, correlation importance and all pairs."""
    pairs = " union all ".join(
        f"""select '{a}' as feature_a, '{b}' as feature_b, abs(covar_pop({a} * {b}, {target})
  / (stddev_pop({a} * {b}) * stddev_pop({target}))) as x from {source}"""
        for i, a in enumerate(features)
        for b in features[i + 1 :]
    )
    return f"""{correlations}, {IMPORTANCE_STATS}, p as ({pairs}) {tall("st", STATS)}
union all select feature, 'feature_importance', {r('abs(corr)')} from tc
union all select feature, 'target_correlation', {r('corr')} from tc
union all select feature_a || '×' || feature_b, 'feature_interactions', {r('greatest(0, x - greatest(abs(a.corr), abs(b.corr)))')}
from p join tc a on a.feature = feature_a join tc b on b.feature = feature_b"""


ORACLES["explain_metrics"] = with_view("items", explained(target_corr(FEATURES), FEATURES, "v", "true_value"))
ORACLES["explain_all_pairs"] = with_view("wide", explained(f"{FILLED}, {WIDE_CORR}", WIDE, "x", "y"))

# --- overall score ----------------------------------------------------------------------------

RISK_COLUMNS = "o_orderkey prediction true_label score c_mktsegment o_orderpriority r_name".split()
RISK_NUMERIC = ["o_orderkey", "prediction", "true_label", "score"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def risk_scores(attributes: list[str]) -> str:
    """The score of every analysis of the risk view: ``accuracy, overall_bias_score, confidence_score, diversity``."""
    columns = [c for c in RISK_COLUMNS if c in attributes or c not in RISK]
    codes = ", ".join(f"dense_rank() over (order by {a}) as a{i}" for i, a in enumerate(attributes))
    useful = " + ".join(f"cast(abs(covar_pop(a{i}, y) / (stddev_pop(a{i}) * stddev_pop(y))) > 0.01 as int)" for i in range(len(attributes)))
    return f"""{binary_groups(attributes).replace('w as (', 'bw as (').replace('from w ', 'from bw ')}, {gaps(CLASS_GAPS)},
{overall_bias(list(CLASS_GAPS.values()))}, {quality(columns, RISK_NUMERIC, 'true_label', len(attributes))},
acc as (select avg(cast(true_label = prediction as int)) as accuracy from v), co as (select true_label as y, {codes} from v),
ex as (select ({useful}) / {len(attributes)}.0 as diversity from co)"""


RISK_SCORE = r("(0.4 * accuracy + 0.3 * (1 - overall_bias_score) + 0.2 * confidence_score + 0.1 * diversity)")
ORACLES["overall_score"] = with_view("risk", f"{risk_scores(RISK)} select {RISK_SCORE} as overall_score from acc, b, qm, ex")
ORACLES["audit_auto"] = with_view(
    "risk",
    f"""{risk_scores(RISK)} select (select case when count(distinct prediction) = 2 then 'binary' else 'multiclass' end from v) as problem_type,
  {RISK_SCORE} as overall_score from acc, b, qm, ex""",
)
ORACLES["score_parts"] = " union all ".join(
    f"""select * from (with u as ({view_sql('risk')}), v as (select * exclude (r_name) from u where r_name = '{region}'), {risk_scores(RISK[:2])}
select '{region}' as r_name, analysis, {r('score')} as score, weight from (
  select 'performance' as analysis, accuracy as score, cast(0.4 as double) as weight from acc union all select 'bias', 1 - overall_bias_score, 0.3 from b
  union all select 'quality', confidence_score, 0.2 from qm union all select 'explainability', diversity, 0.1 from ex)) z"""
    for region in REGIONS
)
ORACLES["audit_status"] = """select * from (values ('performance', 'done', ''), ('bias', 'skipped', 'no protected attribute'), ('quality', 'done', ''),
  ('explainability', 'done', '')) t(analysis, status, reason) where (select count(*) from orders) > 0"""

# --- monitoring -------------------------------------------------------------------------------

ORACLES["windowed_metrics"] = with_view(
    "timed",
    f"""z as (select *, strftime(date_trunc('day', ts), '%Y-%m-%d') as day from v),
c as (select day, count(*) as n, {total('true_label = 1 and prediction = 1')} as tp, {total('true_label = 0 and prediction = 1')} as fp,
  {total('true_label = 1 and prediction = 0')} as fn, avg(cast(true_label = prediction as int)) as accuracy from z group by day)
select day, n, {r('accuracy')} as accuracy, {r(div0('tp', '(tp + fp)'))} as "precision", {r(div0('tp', '(tp + fn)'))} as recall,
  {r(div0('2 * tp', '(2 * tp + fp + fn)'))} as f1_score, {r('(tp + fp) / n')} as positive_rate, {r('(tp + fn) / n')} as base_rate from c""",
)
ORACLES["windowed_scores"] = with_view(
    "timed",
    f"""e as (select cast(date_trunc('day', ts) as date) as d, true_label as y, greatest(0, least(999, floor(score * 1000))) as k,
  greatest(least(score, 1 - 1e-15), 1e-15) as s, score from v),
c as (select d, k, cast(sum(y) as double) as pos, cast(sum(1 - y) as double) as neg from e group by d, k),
b as (select *, coalesce(sum(neg) over (partition by d order by k rows between unbounded preceding and 1 preceding), 0) as below from c),
a as (select d, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as roc_auc from b group by d)
select strftime(d, '%Y-%m-%d') as day, count(*) as n, cast(sum(y) as bigint) as positives, {r('any_value(roc_auc)')} as roc_auc,
  {r('avg(-case when y = 1 then ln(s) else ln(1 - s) end)')} as log_loss, {r('avg(power(score - y, 2))')} as brier_score from e join a using (d) group by d""",
)
ORACLES["windowed_drift"] = f"""with t as (select date_trunc('day', cast(ts as timestamp)) as d, event_type, value from events),
x as (select min(value) as lo, max(value) as hi from events),
n as (select d, 'value' as "column", cast(least(floor((value - lo) * 10 / (hi - lo)), 9) + 1 as varchar) as bin from t, x
  union all select d, 'event_type', event_type from t),
c as (select d, "column", bin, count(*) as n from n group by all), w as (select distinct d, "column" from c),
l as (select *, lag(d) over (partition by "column" order by d) as p from w),
k as (select l.d, l.p, l."column", bin from l join c on c."column" = l."column" and (c.d = l.d or c.d = l.p) where p is not null group by all),
s as (select k.*, greatest(coalesce(b.n, 0) / (select sum(n) from c z where z.d = k.p and z."column" = k."column"), 1e-4) as a,
  greatest(coalesce(e.n, 0) / (select sum(n) from c z where z.d = k.d and z."column" = k."column"), 1e-4) as f from k
  left join c b on b.d = k.p and b."column" = k."column" and b.bin = k.bin left join c e on e.d = k.d and e."column" = k."column" and e.bin = k.bin)
select strftime(d, '%Y-%m-%d') as day, "column", {r('sum((f - a) * ln(f / a))')} as psi from s group by d, "column" """
ORACLES["drift_psi"] = f"""
with e as (select *, extract(day from ts) > 15 as late from events),
s as (select min(value) as lo, max(value) as hi from e where not late),
w as (select 'event_type' as "column", event_type as bin, late from e
  union all select 'value', cast(case when value < lo then 0 when value > hi then 11
    else least(coalesce(floor((value - lo) * 10 / nullif(hi - lo, 0)), 0), 9) + 1 end as varchar), late from e, s where value is not null),
c as (select "column", bin, count(*) filter (where not late) as base, count(*) filter (where late) as cur from w group by all),
p as (select "column", greatest(base / cast(sum(base) over (partition by "column") as double), 1e-4) as a,
  greatest(cur / cast(sum(cur) over (partition by "column") as double), 1e-4) as b from c)
select "column", {r('sum((b - a) * ln(b / a))')} as psi from p group by "column" """
ORACLES["windowed_multiclass"] = f"""
with base as ({view_sql("timed_orders")}), v as (select strftime(ts, '%Y-%m-%d') as day, true_label, prediction from base),
{label_tables(["day"]).strip()},
c as (select day, count(*) as n from v group by day)
select m.day, c.n, {r('accuracy')} as accuracy, {r('"precision"')} as "precision", {r('recall')} as recall, {r('f1_score')} as f1_score,
  {r('matthews_corr')} as matthews_corr, {r('case when isnan(cohen_kappa) then null else cohen_kappa end')} as cohen_kappa
from m join c on c.day = m.day"""
ORACLES["duplicates_of_events"] = f"""
with n as (select (select count(*) from events) as a, (select count(*) from (select distinct * from events)) as b)
select a as rows, b as distinct_rows, a - b as duplicate_rows, {r('100.0 * (a - b) / a')} as duplicate_percentage from n"""
WIDE_COLUMNS = (
    "l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax o_custkey o_totalprice p_size p_retailprice "
    "c11 c12 c13 c14 c15 c16 c17 c18 c19 c20 c21"
).split()
ORACLES["corr_wide"] = with_view(
    "wide",
    "z as (select 1) "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as corr from v"
        for i, a in enumerate(WIDE_COLUMNS)
        for b in WIDE_COLUMNS[i + 1 :]
    ),
)
ORACLES["column_facts"] = with_view(
    "nulls",
    "z as (select 1) "
    + " union all ".join(
        f"select '{c}' as \"column\", '{kind}' as kind, count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as \"distinct\" from v"
        for c, kind in (
            ("l_orderkey", "int"), ("l_tax", "float"), ("l_returnflag", "text"), ("l_quantity", "float"), ("constant_col", "float"), ("l_linestatus", "text"),
        )
    ),
)
ORACLES["top_interactions"] = f"select * from ({ORACLES['interactions']}) z order by strength desc, feature_a, feature_b limit 3"
