"""Per-bin point-cloud features."""

from __future__ import annotations

from binflow.bindings import load
from binflow.operators import features as ops
from binflow.params import FEATURE_GROUPS, FEATURE_NAMES
from binflow.registry import query
from binflow.registry.rounding import places_of, rounded

# Expressions over rows of {points} with has_roi, grouped by bin.
PLAIN_SQL = {
    "mean_x": "avg(x)",
    "mean_y": "avg(y)",
    "std_x": "stddev_pop(x)",
    "std_y": "stddev_pop(y)",
    "median_x": "quantile_cont(x, 0.5)",
    "median_y": "quantile_cont(y, 0.5)",
    "iqr_x": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "iqr_y": "quantile_cont(y, 0.75) - quantile_cont(y, 0.25)",
    "ratio_spread": "(quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / nullif(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 0)",
    "skew_x": "(avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*avg(x)*avg(x)*avg(x)) / nullif(pow(var_pop(x), 1.5), 0)",
    "skew_y": "(avg(y*y*y) - 3*avg(y)*avg(y*y) + 2*avg(y)*avg(y)*avg(y)) / nullif(pow(var_pop(y), 1.5), 0)",
    "kurt_x": "kurtosis_pop(x)",
    "kurt_y": "kurtosis_pop(y)",
    "angle": "case when var_pop(x) > 0 or var_pop(y) > 0 then atan2(2*covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 end",
    "eigen_ratio": """((var_pop(x)+var_pop(y))/2 + sqrt(pow((var_pop(x)-var_pop(y))/2, 2) + pow(covar_pop(x, y), 2)))
        / nullif((var_pop(x)+var_pop(y))/2 - sqrt(pow((var_pop(x)-var_pop(y))/2, 2) + pow(covar_pop(x, y), 2)), 0)""",
    "left_edge_fraction": "avg(case when x <= 0.05e0*1.36e0 then 1e0 else 0e0 end)",
    "right_edge_fraction": "avg(case when x >= (1-0.05e0)*1.36e0 then 1e0 else 0e0 end)",
    "top_edge_fraction": "avg(case when y <= 0.05e0 then 1e0 else 0e0 end)",
    "bottom_edge_fraction": "avg(case when y >= 1-0.05e0 then 1e0 else 0e0 end)",
    "total_edge_fraction": """avg(case when x <= 0.05e0*1.36e0 or x >= (1-0.05e0)*1.36e0
        or y <= 0.05e0 or y >= 1-0.05e0 then 1e0 else 0e0 end)""",
}
# Common table expressions for the features that need more than one pass.
STEPS_SQL = """roi as (select bin_id, seq, x, y from {points} where has_roi),
    span as (select bin_id, count(*) as n, quantile_cont(x, 0.25) as x1, quantile_cont(x, 0.75) as x3,
                    quantile_cont(y, 0.25) as y1, quantile_cont(y, 0.75) as y3,
                    min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb from roi group by bin_id),
    core as (select r.bin_id, avg(case when x between x1 and x3 and y between y1 and y3 then 1e0 else 0e0 end) as core_fraction
             from roi r join span s on r.bin_id = s.bin_id group by r.bin_id),
    per_y as (select bin_id, y, count(*) as c from roi group by bin_id, y),
    dup as (select bin_id, sum(case when c > 1 then c else 0 end) / sum(c)::double as duplicate_fraction,
                   max(c) / sum(c)::double as max_duplicate_fraction from per_y group by bin_id),
    cells as (select r.bin_id, 'x' as axis, case when xb > xa then least(floor((x - xa) / (xb - xa) * 10), 9) end as cell, count(*) as c
              from roi r join span s on r.bin_id = s.bin_id group by all
              union all
              select r.bin_id, 'y', case when yb > ya then least(floor((y - ya) / (yb - ya) * 10), 9) end, count(*)
              from roi r join span s on r.bin_id = s.bin_id group by all),
    var1 as (select bin_id, axis, sqrt(greatest(sum(c*c) / 10e0 - pow(sum(c) / 10e0, 2), 0)) / (sum(c) / 10e0) as cv
             from cells where cell is not null group by bin_id, axis),
    cvs as (select bin_id, max(case when axis = 'x' then cv end) as cv_x, max(case when axis = 'y' then cv end) as cv_y
            from var1 group by bin_id),
    roll as (select bin_id, seq, x, y,
                    case when count(*) over w = 10 then avg(y) over w end as roll
             from roi window w as (partition by bin_id order by seq, x, y rows between 9 preceding and current row)),
    temporal as (select bin_id, var_pop(roll) as t_y_var from roll group by bin_id),
    hits as (select bin_id, trigger_id, max(case when has_roi then 1e0 else 0e0 end) as hit from {points} group by all),
    trig as (select bin_id, avg(hit) as roi_trigger_fraction from hits group by bin_id)"""
_SIDE = {
    "core_fraction": "core",
    "duplicate_fraction": "dup",
    "max_duplicate_fraction": "dup",
    "cv_x": "cvs",
    "cv_y": "cvs",
    "t_y_var": "temporal",
    "roi_trigger_fraction": "trig",
}


def features_sql(names: list[str] | tuple[str, ...], places: int = 6) -> str:
    """Query text for a list of features, one row per bin."""
    plain = [name for name in names if name in PLAIN_SQL]
    sides = sorted({_SIDE[name] for name in names if name in _SIDE})
    tables = ["base"] if plain else []
    plain_sql = ", ".join(f"{PLAIN_SQL[name]} as {name}" for name in plain)
    base = f",\n    base as (select bin_id, {plain_sql} from roi group by bin_id)" if plain else ""
    tables += sides
    joins = tables[0] + "".join(f" full join {t} using (bin_id)" for t in tables[1:])
    columns = ", ".join(f"round({name}, {places_of(name, places)}) as {name}" for name in names)
    return f"with {STEPS_SQL}{base}\nselect bin_id, {columns} from {joins}"


def _register(group: str, names: tuple[str, ...]) -> None:
    query(group, features_sql(names))(
        lambda spark, sf: rounded(ops.named_features(load(spark, sf, "points"), list(names)))
    )


for _group, _names in FEATURE_GROUPS.items():
    _register(_group, _names)


@query("flow_features", features_sql(FEATURE_NAMES))
def flow_features(spark, sf):
    return rounded(ops.flow_features(load(spark, sf, "points")))


_SWITCHES = {
    "spatial_stats": {"median_x": False, "median_y": False},
    "temporal": {"t_y_var": False},
    "clipping_detection": {"duplicate_fraction": False, "max_duplicate_fraction": False},
}
_KEPT = [n for n in FEATURE_NAMES if n not in {k for group in _SWITCHES.values() for k in group}]


@query("select_features", features_sql(_KEPT))
def select_features(spark, sf):
    return rounded(ops.select_features(ops.flow_features(load(spark, sf, "points"), _SWITCHES), _SWITCHES))


@query(
    "rolling_mean_y",
    f"with {STEPS_SQL} select bin_id, seq, round(x, 6) as x, round(y, 6) as y, round(roll, 6) as roll from roll",
)
def rolling_mean_y(spark, sf):
    roi = load(spark, sf, "points").filter("has_roi").select("bin_id", "seq", "x", "y")
    return rounded(ops.rolling_mean_y(roi))
