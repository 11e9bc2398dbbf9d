"""The starting tables of tables.py as SQL common table expressions."""

from __future__ import annotations

from ..functions import numerics as nm


def r(expr: str, digits: int = 6) -> str:
    """Rounded output value without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)::double"


def h(*parts: str) -> str:
    """The key hash of numerics.key_hash; each part is a SQL expression."""
    return f"cast('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) as bigint)"


def _poly(x: str, coefficients) -> str:
    text = f"{coefficients[-1]!r}::double"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}::double)"
    return text


def erf_sql(x: str) -> str:
    y, s, inv = f"abs({x})", f"({x} * {x})", f"(1e0 / ({x} * {x}))"
    near = f"{y} * {_poly(s, nm.ERF_SMALL_NUM)} / {_poly(s, nm.ERF_SMALL_DEN)}"
    mid = f"1e0 - exp(-{s}) * {_poly(y, nm.ERFC_MID_NUM)} / {_poly(y, nm.ERFC_MID_DEN)}"
    far = (f"1e0 - exp(-{s}) / {y} * ({nm.INV_SQRT_PI!r}::double - {inv} * {_poly(inv, nm.ERFC_FAR_NUM)}"
           f" / {_poly(inv, nm.ERFC_FAR_DEN)})")
    return (f"(case when {x} = 0 then 0e0 else sign({x}) * (case when {y} <= 0.46875 then {near}"
            f" when {y} <= 4 then {mid} else {far} end) end)")


def gaussian_sql(mu: str, sigma: str, upper: list[float], lower: list[float]) -> str:
    """List of normalised normal masses; mu and sigma are column names already clamped."""
    def cdf(edges):
        values = ", ".join(f"{e!r}::double" for e in edges)
        scaled = f"list_transform([{values}], lambda e: ((e - {mu}) / {sigma}) / sqrt(2e0))"
        return f"list_transform({scaled}, lambda z: 0.5e0 * (1e0 + {erf_sql('z')}))"

    mass = f"list_transform(list_zip({cdf(upper)}, {cdf(lower)}), lambda x: x[1] - x[2])"
    return scaled_sql(mass)


def scaled_sql(p: str) -> str:
    return f"(case when list_sum({p}) > 0 then list_transform({p}, lambda v: v / list_sum({p})) else [0.2e0,0.2e0,0.2e0,0.2e0,0.2e0] end)"


def two_level_sql(mu: str) -> str:
    return f"list_transform([5e0,4e0,3e0,2e0,1e0], lambda v: greatest(0e0, 1e0 - abs({mu} - v)))"


def entropy_sql(p: str) -> str:
    return f"(0e0 - list_sum(list_transform({p}, lambda v: case when v > 1e-12 then v * ln(v) else 0e0 end)))"


def jsd_sql(p: str, q: str) -> str:
    mid = "(0.5e0 * (x[1] + x[2]) + 1e-12::double)"
    return (f"(0.5e0 * list_sum(list_transform(list_zip({p}, {q}), lambda x: x[1] * ln((x[1] + 1e-12::double) / {mid})"
            f" + x[2] * ln((x[2] + 1e-12::double) / {mid}))))")


def mos_sql(p: str) -> str:
    return f"(5e0*{p}[1] + 4e0*{p}[2] + 3e0*{p}[3] + 2e0*{p}[4] + {p}[5])"


def std_sql(p: str, m: str) -> str:
    return "sqrt(" + " + ".join(f"{p}[{i + 1}]*({5 - i}e0 - {m})*({5 - i}e0 - {m})" for i in range(5)) + ")"


def level_columns(p: str, prefix: str = "p", digits: int = 6) -> str:
    return ", ".join(f"{r(f'{p}[{i + 1}]', digits)} as {prefix}{5 - i}" for i in range(5))


def avg_rank(order: str, by: str = "", desc: bool = False) -> str:
    """Average rank as a window expression."""
    part = f"partition by {by} " if by else ""
    direction = " desc" if desc else ""
    peers = ", ".join(x for x in (by, order) if x)
    return (f"(rank() over ({part}order by {order}{direction})"
            f" + (count(*) over (partition by {peers}) - 1) / 2e0)")


def corr_sql(x: str, y: str, small: str = "null") -> str:
    scale = f"sqrt(var_pop({x}) * count(*) * var_pop({y}) * count(*))"
    return f"(case when count(*) < 3 or {scale} < 1e-15 then {small} else covar_pop({x}, {y}) * count(*) / {scale} end)"


def times_rank(order: str, by: str, m: str = "m") -> str:
    """Average rank of rows that count ``m`` times each."""
    return f"(sum({m}) over (partition by {by} order by {order} range unbounded preceding) - (sum({m}) over (partition by {by}, {order}) - 1) / 2e0)"


def times_corr(x: str, y: str, m: str = "m") -> str:
    """Pearson coefficient of rows that count ``m`` times each; NULL below three or without spread."""
    n, mean = f"sum({m})::double", lambda a, b: f"(sum({m} * {a} * {b}) - sum({m} * {a}) * sum({m} * {b}) / sum({m})::double)"
    xx, yy = mean(x, x), mean(y, y)
    return f"(case when {n} >= 3 and {xx} > 1e-9 and {yy} > 1e-9 then {mean(x, y)} / sqrt({xx} * {yy}) end)"


def draws_sql(units: str, by: str, key: str, repeats: int, seed: str) -> dict[str, str]:
    """CTEs ``ix`` (units with index and size) and ``dr`` (by, rep, key, m): draws with replacement; rep 0 takes all once."""
    part, cols = (f"partition by {by} ", f"{by}, ") if by else ("", "")
    on = f"using ({cols}idx)"
    return {"ix": f"select {cols}{key}, row_number() over ({part}order by {key}) - 1 as idx, count(*) over ({part.strip()}) as n from (select distinct {cols}{key} from {units})",
            "pk": f"select {cols}rep + 1 as rep, {h(seed, 'rep', 'idx')} % n as idx, count(*) as m from (select {cols}idx, n, unnest(range({repeats})) as rep from ix) group by all union all select {cols}0, idx, 1 from ix",
            "dr": f"select {cols}rep, {key}, m, n from pk join ix {on}"}


def metrics_sql(source: str, pred: str, gt: str, by: str) -> str:
    """n, srcc, plcc, mae, rmse, bias per group, unrounded."""
    return f"""select {by}, count(*) as n, {corr_sql('rx', 'ry')} as srcc, {corr_sql('px', 'py')} as plcc,
        avg(abs(px - py)) as mae, sqrt(avg((px - py) * (px - py))) as rmse, avg(px - py) as bias from (
        select *, {pred} as px, {gt} as py, {avg_rank(pred, by)} as rx, {avg_rank(gt, by)} as ry from {source}) group by {by}"""


WEIGHT = "(case dimension when 'overall' then 0.5e0 else 0.25e0 end)"


LEVELS_UP = [5.5, 4.5, 3.5, 2.5, 1.5]
LEVELS_DOWN = [4.5, 3.5, 2.5, 1.5, 0.5]


def split_sql(key: str, salt: str = "split") -> str:
    bucket = f"{h(repr(salt), key)} % 10"
    return f"(case when {bucket} < 7 then 'train' when {bucket} < 8 then 'val' else 'test' end)"


UNIT_MEANS = """count(*) as n_lines,
    (cast(sum(cast(round(l_quantity) as bigint)) as double) / count(*) - 1) / 49 as q,
    cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) / 10 as d,
    cast(sum(cast(round(l_tax * 100) as bigint)) as double) / count(*) / 8 as t"""


def unpivot(source: str, keys: str, **columns: tuple[str, str, str]) -> str:
    parts = []
    for i, dim in enumerate(("overall", "sharpness", "color")):
        cols = ", ".join(f"{c[i]} as {n}" for n, c in columns.items())
        parts.append(f"select {keys}, '{dim}' as dimension, {cols} from {source}")
    return " union all ".join(parts)


def _unit(c: str) -> str:
    return f"({c} - lo_{c}) / (hi_{c} - lo_{c})"


def _grade(c: str, m: str) -> str:
    return f"0.4e0 * (1e0 + 4e0 * ({_unit(c)})) + 0.6e0 * {m}"


SCORES_QDT = ("1e0 + 4e0 * q", "1e0 + 4e0 * d", "1e0 + 4e0 * t")
_K = "cast(json_extract_string(props, '$.k') as bigint)"

# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "base": ("", f"select l_orderkey as image_id, {UNIT_MEANS} from lineitem group by 1"),
    "preds_wide": ("base", """select image_id, 1e0 + 4e0 * q as overall_mu, 0.002e0 + 0.5e0 * abs(q - d) as overall_sigma_sq,
        1e0 + 4e0 * d as sharpness_mu, 0.002e0 + 0.5e0 * abs(d - t) as sharpness_sigma_sq,
        1e0 + 4e0 * t as color_mu, 0.002e0 + 0.5e0 * abs(t - q) as color_sigma_sq from base"""),
    "preds": ("preds_wide", unpivot("preds_wide", "image_id", mu=("overall_mu", "sharpness_mu", "color_mu"),
                                    sigma_sq=("overall_sigma_sq", "sharpness_sigma_sq", "color_sigma_sq"))),
    "clamped": ("preds", """select *, greatest(1e0, least(5e0, mu)) as m,
        greatest(sqrt(greatest(sigma_sq, 0e0)), 0.1e0) as s from preds"""),
    "labelled": ("clamped", f"""select image_id, dimension, mu, sigma_sq, m, s,
        case when s < 0.15 then {two_level_sql('m')} else {gaussian_sql('m', 's', LEVELS_UP, LEVELS_DOWN)} end as probs
        from clamped"""),
    "cross_units": ("", f"select l_orderkey as image_id, {UNIT_MEANS} from lineitem where l_returnflag <> 'A' group by 1"),
    "cross_scores": ("cross_units", unpivot("cross_units", "image_id", score=SCORES_QDT)),
    "cross_raw": ("cross_scores", """select *, list_transform([5e0,4e0,3e0,2e0,1e0],
        lambda v: exp(-2e0 * abs(v - score))) as e from cross_scores"""),
    "cross_levels": ("cross_raw", f"select image_id, dimension, {scaled_sql('e')} as cross_probs from cross_raw"),
    "distances": ("base", "select image_id, 30e0 + 40e0 * t as distance from base"),
    "order_ends": ("", """select min(o_totalprice) as lo_o_totalprice, max(o_totalprice) as hi_o_totalprice,
        min(o_custkey) as lo_o_custkey, max(o_custkey) as hi_o_custkey,
        min(date_diff('day', timestamp '1970-01-01', o_orderdate)) as lo_day,
        max(date_diff('day', timestamp '1970-01-01', o_orderdate)) as hi_day from orders"""),
    "truth_wide": ("preds_wide order_ends", f"""select image_id, {_grade('o_totalprice', 'overall_mu')} as overall,
        {_grade('o_custkey', 'sharpness_mu')} as sharpness, {_grade('day', 'color_mu')} as color,
        o_orderpriority as category, o_orderstatus as source, {split_sql('image_id')} as split,
        strftime(o_orderdate, '%Y-%m') as month
        from (select *, o_orderkey as image_id, date_diff('day', timestamp '1970-01-01', o_orderdate) as day
              from orders, order_ends) join preds_wide using (image_id)"""),
    "truth": ("truth_wide", unpivot("truth_wide", "image_id, category, source, split, month", gt=("overall", "sharpness", "color"))),
    "paired": ("preds truth", "select * from preds join truth using (image_id, dimension)"),
    "panel_units": ("", f"""select l_orderkey as image_id, 'rater_' || lower(l_returnflag || l_linestatus) as model,
        {UNIT_MEANS} from lineitem group by 1, 2"""),
    "panel": ("panel_units", unpivot("panel_units", "image_id, model", score=SCORES_QDT)),
    "panel_overall": ("panel", "select image_id, model, score from panel where dimension = 'overall'"),
    "ratings": ("", f"""select event_id as ord, 'judge_' || cast({_K} % 4 as varchar) as model_id, user_id as image_id,
        1e0 + 4e0 * least(value, 100e0) / 100 as score, {_K} * 10 + 100 as latency_ms, event_type as arm,
        case when event_type = 'error' then case when {_K} < 50 then 'api error' else 'parse error' end else '' end as error
        from events"""),
    "emb": ("", f"""select vec_id, embedding, cast(label >= 7 as int) as is_ood, 'c' || label as category,
        {split_sql('vec_id', 'emb')} as split from embeddings"""),
    "emb_ref": ("emb", "select vec_id, embedding from emb where is_ood = 0 and split in ('train', 'val')"),
    "emb_eval": ("emb", "select vec_id, embedding, is_ood, category from emb where is_ood = 1 or split = 'test'"),
    "text_pairs": ("", """select doc_id as pair_id, item_id, source as engine, lang as tier, b.text as reference,
        d.text as hypothesis from documents d join benchmark b on d.doc_id % (select count(*) from benchmark) = b.item_id"""),
    "binary_rows": ("", """select doc_id, lang, quality as label, n_chars::double as score
        from labels join documents using (doc_id)"""),
    "supplier_units": ("", f"select l_suppkey as image_id, {UNIT_MEANS} from lineitem group by 1"),
    "supplier_level": ("supplier_units", """select u.*, (s_acctbal - lo) / (hi - lo) as level from supplier_units u
        join supplier on s_suppkey = image_id, (select min(s_acctbal) lo, max(s_acctbal) hi from supplier)"""),
    "suppliers": ("supplier_level", unpivot(
        "supplier_level", "image_id", pred_a=SCORES_QDT, pred_b=SCORES_QDT[1:] + SCORES_QDT[:1],
        gt=tuple(f"1e0 + 4e0 * (0.5e0 * level + 0.5e0 * {a})" for a in "qdt"))),
}


def with_views(names: list[str], sql: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` every needed view (dependencies first), then the extra ones, then the query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in VIEWS[name][0].split():
                add(need)
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({VIEWS[n][1]})" for n in ordered] + [f"{n} as ({q})" for n, q in (extra or {}).items()]
    return (f"with {', '.join(parts)} " if parts else "") + sql
