"""DuckDB twins of the named queries (same column names, same rounding).

Conventions shared with the Spark side:
- draw key ``h`` = ('0x' || substr(md5(concat_ws('|', id, ..., seed)), 1, 15))::BIGINT,
  ties broken by id;
- test size ``(n * pct + 99) // 100`` in integers;
- doubles rounded to 6 decimals; sums cast to BIGINT (DuckDB widens to HUGEINT).
"""

from __future__ import annotations

from assay_spark import constants as _C

ORACLE: dict[str, str] = {}


def H(*parts: str, seed: int = 42) -> str:
    """SQL draw-key integer over the given SQL expressions."""
    inner = ", ".join([f"CAST({p} AS VARCHAR)" for p in parts] + [f"'{seed}'"])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"


def _vectors() -> str:
    return ("SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y, "
            "label AS stratum FROM embeddings")


def _strat_split(src: str, seed: int = 42, pct: int = 20, by: str = "", id_col: str = "row_id",
                 stratum: str = "stratum", key: tuple = ("row_id",), tiebreak: str = "row_id") -> str:
    """Subquery: rows of ``src`` with a 'split' column from the exact
    largest-remainder stratified split (partitioned by ``by`` if given)."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    join_by = f"{by}, {stratum}" if by else stratum
    return f"""
    (WITH e AS (SELECT *, {H(*key, seed=seed)} AS h FROM ({src})),
     cnt AS (SELECT {g}{stratum}, count(*) AS sn FROM e GROUP BY {g}{stratum}),
     q AS (SELECT *, (tot * {pct} + 99) // 100 AS m FROM (SELECT *, sum(sn) OVER ({part}) AS tot FROM cnt)),
     q2 AS (SELECT *, (m * sn) // tot AS fl, (m * sn) % tot AS rem FROM q),
     a AS (SELECT {g}{stratum}, fl + CASE WHEN row_number() OVER ({part} ORDER BY rem DESC, {stratum})
                  <= m - sum(fl) OVER ({part}) THEN 1 ELSE 0 END AS alloc FROM q2),
     r AS (SELECT *, row_number() OVER (PARTITION BY {join_by} ORDER BY h, {tiebreak}) AS rk FROM e)
     SELECT r.* EXCLUDE (h, rk), CASE WHEN rk <= alloc THEN 'test' ELSE 'train' END AS split
     FROM r JOIN a USING ({join_by}))"""


def _standardized(src: str) -> str:
    """(row_id, y, split, x standardised with train statistics)."""
    return f"""
    (WITH s AS (SELECT * FROM {src}),
     dims AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s WHERE split = 'train'),
     st AS (SELECT list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd
            FROM (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM dims GROUP BY i))
     SELECT s.* EXCLUDE (x), list_transform(s.x, lambda v, i: CASE WHEN st.sd[i] = 0 THEN 0.0
            ELSE (v - st.mu[i]) / st.sd[i] END) AS x FROM s, st)"""


def _knn_pred(z: str, k: int = 5) -> str:
    return f"""
    (WITH z AS (SELECT * FROM {z}),
     p AS (SELECT t.row_id, t.y, r.y AS ny, r.row_id AS nid,
                  list_sum(list_transform(list_zip(t.x, r.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
           FROM z t JOIN z r ON t.split = 'test' AND r.split = 'train'),
     nn AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, nid) AS kk FROM p)
     SELECT row_id, any_value(y) AS y, avg(ny) AS y_hat FROM nn WHERE kk <= {k} GROUP BY row_id)"""


def _metrics(pred: str) -> str:
    return f"""SELECT round(avg((y_hat - y) * (y_hat - y)), 6) AS mse,
       round(avg(abs(y_hat - y)), 6) AS mae,
       round(1 - sum((y_hat - y) * (y_hat - y)) / (count(y_hat) * var_pop(y)), 6) AS r2,
       count(y_hat) AS n
FROM {pred}"""


ORACLE["flagship_knn_eval"] = _metrics(_knn_pred(_standardized(_strat_split(_vectors()))))


# ====================================================================== step 1
_LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem"
                                for c in _LINE_NUM)

ORACLE["profile_describe"] = f"""
SELECT "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75
FROM ({_LINE_LONG}) GROUP BY "column"
"""

_DOCS = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

ORACLE["null_report"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls, '{t}' AS dtype FROM {_DOCS}"
    for c, t in [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
                 ("quality", "int"), ("toxic", "int")])

ORACLE["attach_target"] = f"SELECT doc_id, lang, quality, toxic FROM {_DOCS}"

ORACLE["skew_kurt_adj"] = """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop,
       round(stddev_samp(value), 6) AS std_samp, round(skewness(value), 6) AS skew_adj,
       round(kurtosis(value), 6) AS kurt_adj
FROM events GROUP BY event_type"""

ORACLE["quantile_topcode"] = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.9995) AS q FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, round(e.value, 6) AS value,
       round(greatest(0.0, least(e.value, q.q)), 6) AS value_capped
FROM events e JOIN q USING (event_type)"""

ORACLE["quantiles"] = "SELECT event_type, count(value) AS n, " + ", ".join(
    f"round(quantile_cont(value, {q}), 6) AS q{i}" for i, q in enumerate([0.0, 0.1, 0.25, 0.5, 0.9, 0.9995, 1.0])
) + " FROM events GROUP BY event_type"

ORACLE["zscore_flag"] = """
WITH s AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY event_type),
f AS (SELECT e.event_type, coalesce(abs((e.value - s.mu) / s.sd) > 3.5, false) AS o FROM events e JOIN s USING (event_type))
SELECT event_type, CAST(count_if(o) AS BIGINT) AS outliers, count(*) AS n, round(count_if(o) / count(*), 6) AS share
FROM f GROUP BY event_type"""

ORACLE["cap_filter"] = "SELECT event_type, count(*) AS n FROM events WHERE value <= 100.0 GROUP BY event_type"

ORACLE["histogram_bins"] = """
WITH mm AS (SELECT event_type, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 25.0 AS w
            FROM events GROUP BY event_type),
b AS (SELECT e.event_type, CAST(CASE WHEN mm.w = 0 THEN 0 ELSE least(floor((e.value - mm.lo) / mm.w), 24) END AS INTEGER) AS bin
      FROM events e JOIN mm USING (event_type) WHERE e.value IS NOT NULL),
c AS (SELECT event_type, bin, count(*) AS cnt FROM b GROUP BY ALL),
g AS (SELECT event_type, CAST(unnest(range(0, 25)) AS INTEGER) AS bin, lo, w FROM mm)
SELECT g.event_type, g.bin, round(g.lo + g.bin * g.w, 6) AS lo, round(g.lo + (g.bin + 1) * g.w, 6) AS hi,
       coalesce(c.cnt, 0) AS count
FROM g LEFT JOIN c USING (event_type, bin)"""

ORACLE["box_stats"] = """
WITH q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q),
w AS (SELECT e.event_type, min(CASE WHEN e.value BETWEEN f.lf AND f.uf THEN e.value END) AS whisker_lo,
             max(CASE WHEN e.value BETWEEN f.lf AND f.uf THEN e.value END) AS whisker_hi,
             CAST(count_if(NOT (e.value BETWEEN f.lf AND f.uf)) AS BIGINT) AS outliers
      FROM events e JOIN f USING (event_type) GROUP BY e.event_type)
SELECT q.event_type, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(w.whisker_lo, 6) AS whisker_lo, round(w.whisker_hi, 6) AS whisker_hi, w.outliers
FROM q JOIN w USING (event_type)"""

ORACLE["corr_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(_LINE_NUM) for b in _LINE_NUM[i:])

ORACLE["label_map"] = """
SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Auto' WHEN 'BUILDING' THEN 'Building'
       WHEN 'FURNITURE' THEN 'Furniture' WHEN 'MACHINERY' THEN 'Machinery' END AS label FROM customer"""

ORACLE["align_columns"] = """
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, CAST(0.0 AS DOUBLE) AS l_missing, round(l_tax, 6) AS l_tax
FROM lineitem"""

ORACLE["log_axis"] = """
WITH s AS (SELECT CASE WHEN p_size >= 50 THEN 'Infinite' ELSE CAST(p_size AS VARCHAR) END AS numsamp,
                  avg(p_retailprice / 1000.0) AS mean FROM part GROUP BY 1),
l AS (SELECT *, CASE WHEN TRY_CAST(numsamp AS DOUBLE) > 0 THEN ln(TRY_CAST(numsamp AS DOUBLE)) END AS lnx FROM s)
SELECT numsamp, round(mean, 6) AS mean, round(coalesce(lnx, max(lnx) OVER () + 0.5), 6) AS x FROM l"""

ORACLE["any_nan"] = """
SELECT label AS stratum, bool_or(len(list_filter(CAST(embedding AS DOUBLE[]), lambda v: isnan(v) OR v IS NULL)) > 0) AS any_nan
FROM embeddings GROUP BY label"""

ORACLE["shape_report"] = """
SELECT label AS stratum, count(*) AS rows, CAST(min(len(embedding)) AS INTEGER) AS min_len,
       CAST(max(len(embedding)) AS INTEGER) AS max_len FROM embeddings GROUP BY label"""

ORACLE["numeric_only"] = "SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer"

ORACLE["drop_all_null_rows"] = f"SELECT doc_id, quality, toxic FROM {_DOCS} WHERE quality IS NOT NULL OR toxic IS NOT NULL"

# ====================================================================== step 2
_ORD_TOP = f"""(SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY {H('o_orderkey')}, o_orderkey) AS draw_rank
               FROM orders)"""

ORACLE["sample_n"] = f"SELECT o_orderkey, o_orderpriority, draw_rank FROM {_ORD_TOP} WHERE draw_rank <= 1800"

ORACLE["split_exact"] = f"""
SELECT o_orderkey, CASE WHEN rk <= (count(*) OVER () * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {H('o_orderkey')}, o_orderkey) AS rk FROM orders)"""

ORACLE["stratified_split"] = "SELECT o_orderkey, o_orderpriority, split FROM " + _strat_split(
    "SELECT o_orderkey, o_orderpriority FROM orders", id_col="o_orderkey", stratum="o_orderpriority",
    key=("o_orderkey",), tiebreak="o_orderkey")

ORACLE["stratified_sample"] = f"""
WITH d AS (SELECT doc_id, lang, {H('doc_id')} AS h FROM documents),
c AS (SELECT lang, 100 // count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM d)),
r AS (SELECT d.doc_id, d.lang, c.m, row_number() OVER (PARTITION BY d.lang ORDER BY h, doc_id) AS draw
      FROM d JOIN c USING (lang))
SELECT doc_id, lang, draw FROM r WHERE draw <= m"""

ORACLE["stratified_sample_replace"] = f"""
WITH d AS (SELECT doc_id, lang, {H('doc_id')} AS h FROM documents),
c AS (SELECT lang, count(*) AS sn, 100 // count(*) OVER () AS m FROM d GROUP BY lang),
dr AS (SELECT lang, draw, 1 + {H('lang', 'draw', seed=42 + 7919)} % sn AS pos
       FROM (SELECT lang, sn, CAST(unnest(range(1, m + 1)) AS INTEGER) AS draw FROM c)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS pos FROM d)
SELECT r.doc_id, r.lang, dr.draw FROM r JOIN dr USING (lang, pos)"""


def _permuted(pos: str, n: str, parts: tuple, seed: int, rounds: int = 24) -> str:
    """Place of ``pos`` in the keyed permutation of 0..n-1 (swap-or-not rounds)."""
    partner = f"((({H(*parts, 'i', seed=seed)}) % {n} - x + {n}) % {n})"
    flip = f"({H(*parts, 'i', f'greatest(x, {partner})', seed=seed + 1)}) % 2 = 1"
    return (f"list_reduce(list_concat([CAST({pos} AS BIGINT)], range({rounds})), "
            f"lambda x, i: CASE WHEN {flip} THEN {partner} ELSE x END)")


def _grid_draw(replace: bool = False) -> str:
    """The full grid: one rank per stratum, positions drawn per cell."""
    sizes, repeats = list(_C.SUBSAMPLE_SIZES), _C.SUBSAMPLE_REPEATS
    last = "c.rec // s.k" if replace else "least(c.rec // s.k, s.sn)"
    place = (f"{H('stratum', 'draw', 'rec', 'sub', seed=42 + 7919)} % sn" if replace
             else _permuted("draw - 1", "sn", ("stratum", "rec", "sub"), 42 + 7919))
    return f"""(WITH v AS (SELECT vec_id AS row_id, label AS stratum FROM embeddings),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {H('row_id')}, row_id) AS rk FROM v),
        s AS (SELECT stratum, count(*) AS sn, count(*) OVER () AS k FROM v GROUP BY stratum),
        c AS (SELECT * FROM (SELECT unnest({sizes}) AS rec) CROSS JOIN (SELECT CAST(unnest(range(1, {repeats + 1})) AS INTEGER) AS sub)),
        dr AS (SELECT rec, sub, stratum, draw, 1 + {place} AS rk
               FROM (SELECT s.*, c.*, unnest(range(1, {last} + 1)) AS draw FROM s, c))
        SELECT r.row_id, r.stratum, dr.rec, dr.sub, CAST(dr.draw AS INTEGER) AS draw FROM r JOIN dr USING (stratum, rk))"""


ORACLE["subsamples_grid"] = "SELECT rec, sub, row_id, stratum, draw, split FROM " + _strat_split(
    "SELECT * FROM " + _grid_draw(), seed=43, by="rec, sub", key=("row_id", "rec", "sub"),
    tiebreak="row_id, rec, sub")

ORACLE["exclude_drawn"] = f"SELECT o_orderkey, o_orderpriority FROM {_ORD_TOP} WHERE draw_rank > 1800"

ORACLE["overlap_report"] = f"""
WITH s AS (SELECT * FROM {_strat_split("SELECT * FROM " + _grid_draw(replace=True), seed=43, by="rec, sub",
                                        key=("row_id", "draw", "rec", "sub"), tiebreak="row_id, draw, rec, sub")}),
p AS (SELECT rec, sub, row_id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr,
             max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS te FROM s GROUP BY ALL)
SELECT rec, sub, CAST(sum(tr) AS BIGINT) AS train_ids, CAST(sum(te) AS BIGINT) AS test_ids,
       CAST(sum(tr * te) AS BIGINT) AS both_ids FROM p GROUP BY rec, sub"""

ORACLE["dedupe_first"] = """
SELECT user_id, event_type, min(event_id) AS event_id, round(arg_min(value, event_id), 6) AS value
FROM events GROUP BY user_id, event_type"""


# ====================================================================== step 3
import math as _math  # noqa: E402

_V = "(SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y, label AS stratum FROM embeddings)"


def _vh(n: int) -> str:
    """The ``n`` dimensions with the largest |correlation| with the target, in rank order."""
    return f"""(WITH _d AS (SELECT y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {_V}),
     _c AS (SELECT i, CASE WHEN min(v) = max(v) OR min(y) = max(y) THEN 0.0 ELSE round(abs(corr(v, y)), 9) END AS c FROM _d GROUP BY i),
     _k AS (SELECT list(i ORDER BY c DESC, i) AS keep FROM (SELECT * FROM _c ORDER BY c DESC, i LIMIT {n}))
     SELECT v.row_id, list_transform(_k.keep, lambda q: v.x[q]) AS x FROM {_V} v, _k)"""


def _long_sql(src: str, keys: str, vec: str) -> str:
    return (f"SELECT {keys}, CAST(generate_subscripts({vec}, 1) - 1 AS INTEGER) AS i, "
            f"round(unnest({vec}), 6) AS value FROM {src}")


def _pairs(z: str, n: int) -> str:
    return (f"flatten(list_transform(range(1, {n}), lambda a: "
            f"list_transform(range(a + 1, {n + 1}), lambda b: {z}[a] * {z}[b])))")


ORACLE["standardize"] = f"""
WITH d AS (SELECT row_id, unnest(x) AS v, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS i FROM {_V}),
s AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM d GROUP BY i)
SELECT row_id, i, round(CASE WHEN sd = 0 THEN 0.0 ELSE (v - mu) / sd END, 6) AS value FROM d JOIN s USING (i)"""

ORACLE["standardize_cols"] = "WITH s AS (SELECT l_returnflag, " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _LINE_NUM) + " FROM lineitem GROUP BY l_returnflag) " \
    "SELECT l_orderkey, l_linenumber, l_returnflag, " + ", ".join(
    f"round(CASE WHEN sd_{c} = 0 THEN 0.0 ELSE ({c} - mu_{c}) / sd_{c} END, 6) AS {c}_z" for c in _LINE_NUM) + \
    " FROM lineitem JOIN s USING (l_returnflag)"

ORACLE["impute_mean"] = f"""
SELECT doc_id, lang, round(coalesce(CAST(quality AS DOUBLE), avg(CAST(quality AS DOUBLE)) OVER (PARTITION BY lang)), 6) AS quality
FROM {_DOCS}"""

_SPLIT_V = _strat_split("SELECT * FROM " + _V)

ORACLE["scale_to_bound"] = f"""
WITH s AS (SELECT * FROM {_SPLIT_V}),
m AS (SELECT max(list_max(list_transform(x, lambda v: abs(v)))) AS s FROM s WHERE split = 'train'),
z AS (SELECT s.row_id, s.split, list_transform(s.x, lambda v: v * CASE WHEN m.s = 0 THEN 0.0 ELSE 6.0 / m.s END) AS x FROM s, m)
{_long_sql('z', 'row_id, split', 'x')}"""

ORACLE["max_abs"] = f"SELECT stratum, round(max(list_max(list_transform(x, lambda v: abs(v)))), 6) AS max_abs FROM {_V} GROUP BY stratum"

ORACLE["correlators_pairs"] = f"""
WITH c AS (SELECT row_id, list_concat(x, {_pairs('x', 18)}) AS c FROM {_vh(18)})
{_long_sql('c', 'row_id', 'c')}"""

ORACLE["pairs_long"] = f"""
SELECT row_id, CAST(a - 1 AS INTEGER) AS i, CAST(b - 1 AS INTEGER) AS j, round(x[a] * x[b], 6) AS product
FROM {_vh(18)} v, range(1, 19) r1(a), range(1, 19) r2(b) WHERE a < b"""

_Z3 = "list_filter(x, lambda v, i: (i - 1) % 3 = 2)"
ORACLE["expand_modes"] = " UNION ALL ".join(
    f"SELECT * FROM (WITH r AS (SELECT row_id, {expr} AS r FROM {_vh(18)}) {_long_sql('r', 'row_id', 'r')}) "
    f"CROSS JOIN (SELECT '{mode}' AS mode)"
    for mode, expr in [
        ("s", "x"),
        ("ss", "flatten(list_transform(range(1, 19), lambda a: list_transform(x, lambda q: x[a] * q)))"),
        ("z", _Z3),
        ("zz", _pairs(_Z3, 6)),
        ("szz", f"list_concat(x, {_pairs(_Z3, 6)})"),
    ])

_W2 = (2 * _math.pi) ** 2
_STEP_VALUES = ", ".join(f"({k + 1}, {repr((0.0 + 0.4 * (k + 1)) / 2.0)})" for k in range(10))
ORACLE["response_features"] = f"""
WITH s AS (SELECT v.row_id, t.step, list_transform(v.x, lambda a: 1.0 - {repr(2.0 * _W2)} / ({repr(_W2)} + a * a)
                  * pow(sin(sqrt({repr(_W2)} + a * a) * t.th), 2)) AS z
           FROM {_vh(18)} v, (VALUES {_STEP_VALUES}) t(step, th)),
c AS (SELECT row_id, CAST(step AS INTEGER) AS step, list_concat(z, {_pairs('z', 18)}) AS c FROM s)
SELECT row_id, step, count(*) AS n, round(sum(v), 6) AS sum, round(sum(v * v), 6) AS sumsq, round(sum(v * pos), 6) AS wsum,
       round(min(v), 6) AS min, round(max(v), 6) AS max
FROM (SELECT row_id, step, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM c) GROUP BY row_id, step"""

ORACLE["shot_noise"] = f"""
WITH e AS (SELECT row_id, unnest(x) AS e, generate_subscripts(x, 1) - 1 AS i FROM {_vh(18)}),
g AS (SELECT e.*, s.shots, l.loop FROM e, (SELECT unnest({list(_C.SHOT_COUNTS_DRAWN)}) AS shots) s, (SELECT unnest(range(1, {_C.SHOT_LOOPS + 1})) AS loop) l),
dr AS (SELECT row_id, shots, loop, i, e, unnest(range(1, shots + 1)) AS j FROM g WHERE shots > 0),
k AS (SELECT row_id, shots, loop, i, count_if(CAST({H('row_id', 'shots', 'loop', 'i', 'j')} AS DOUBLE)
             / CAST(1152921504606846976 AS DOUBLE) < (1.0 + e) / 2.0) AS k
      FROM dr GROUP BY row_id, shots, loop, i, e)
SELECT row_id, shots, loop, CAST(i AS INTEGER) AS i, round(CAST(2 AS DOUBLE) * k / shots - 1.0, 6) AS value FROM k
UNION ALL
SELECT row_id, shots, loop, CAST(i AS INTEGER) AS i, round(e, 6) AS value FROM g WHERE shots = 0"""

ORACLE["transpose"] = f"""
SELECT CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS row_id, row_id AS col_id, round(unnest(x), 6) AS value FROM {_V}"""

ORACLE["embed_map"] = f"SELECT row_id, round(list_sum(list_transform(x, lambda v: tanh(v))), 6) AS sum, CAST(len(x) AS INTEGER) AS n FROM {_V}"

# ====================================================================== step 4
ORACLE["rbf_kernel"] = f"""
WITH v AS (SELECT row_id, x FROM {_V}),
c AS (SELECT row_id AS centre_id, x AS cx FROM (SELECT *, row_number() OVER (ORDER BY {H('row_id', seed=7)}, row_id) AS rk FROM v) WHERE rk <= 16)
SELECT v.row_id, c.centre_id, round(exp(list_sum(list_transform(list_zip(v.x, c.cx), lambda q: (q[1] - q[2]) * (q[1] - q[2])))
       * {repr(-1.0 / (2.0 * 2.0 ** 2))}), 6) AS k
FROM v, c"""

_PLAIN_SPLIT = f"""(SELECT row_id, x, y, CASE WHEN rk <= (count(*) OVER () * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {H('row_id')}, row_id) AS rk FROM {_V}))"""

ORACLE["knn_regression"] = f"SELECT row_id, y, round(y_hat, 6) AS y_hat FROM {_knn_pred(_PLAIN_SPLIT)}"

ORACLE["knn_join"] = f"""
WITH z AS (SELECT * FROM {_PLAIN_SPLIT}),
p AS (SELECT t.row_id, r.row_id AS nn_id,
             list_sum(list_transform(list_zip(t.x, r.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
      FROM z t JOIN z r ON t.split = 'test' AND r.split = 'train'),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY d, nn_id) AS INTEGER) AS nn_rank FROM p)
SELECT row_id, nn_rank, nn_id, round(d, 6) AS nn_dist2 FROM nn WHERE nn_rank <= 5"""

ORACLE["corr_matrix_vec"] = f"""
WITH d AS (SELECT row_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS i, unnest(x) AS v FROM {_V})
SELECT a.i, b.i AS j, round(corr(a.v, b.v), 6) AS corr FROM d a JOIN d b ON a.row_id = b.row_id AND a.i <= b.i
GROUP BY a.i, b.i"""

ORACLE["knn_join_pruned"] = """
WITH o AS (SELECT o_orderkey AS row_id, o_orderstatus = 'P' AS asks, o_totalprice / 1000.0 AS a,
                  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 10.0 AS b FROM orders),
p AS (SELECT t.row_id, min({'d': (t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b), 'i': r.row_id}, 5) AS near
      FROM o t JOIN o r ON t.asks AND NOT r.asks GROUP BY t.row_id)
SELECT row_id, CAST(i AS INTEGER) AS nn_rank, near[i].i AS nn_id, round(near[i].d, 6) AS nn_dist2
FROM (SELECT row_id, near, unnest(range(1, len(near) + 1)) AS i FROM p)"""

ORACLE["assign_centroids"] = f"""
WITH d AS (SELECT stratum, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {_V}),
c AS (SELECT stratum AS cluster, list(mu ORDER BY i) AS cx FROM (SELECT stratum, i, avg(v) AS mu FROM d GROUP BY ALL) GROUP BY stratum),
p AS (SELECT v.row_id, c.cluster, list_sum(list_transform(list_zip(v.x, c.cx), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
      FROM {_V} v, c)
SELECT row_id, CAST(arg_min(cluster, (d, cluster)) AS INTEGER) AS cluster, round(min(d), 6) AS dist2 FROM p GROUP BY row_id"""

# ====================================================================== step 5
_PART_PRED = """(SELECT p.p_partkey, p.p_brand, p.p_size, p.p_retailprice AS y, m.y_hat
   FROM part p JOIN (SELECT p_size, avg(p_retailprice) AS y_hat FROM part GROUP BY p_size) m USING (p_size))"""

ORACLE["regression_metrics"] = f"""
SELECT p_brand, round(avg((y_hat - y) * (y_hat - y)), 6) AS mse, round(avg(abs(y_hat - y)), 6) AS mae,
       round(1 - sum((y_hat - y) * (y_hat - y)) / (count(*) * var_pop(y)), 6) AS r2, count(*) AS n,
       round(sqrt(avg((y_hat - y) * (y_hat - y))), 6) AS rmse, round(avg(abs((y_hat - y) / nullif(y, 0.0))), 6) AS mape
FROM {_PART_PRED} GROUP BY p_brand"""

ORACLE["fit_line"] = f"""
SELECT p_brand, round(regr_slope(y_hat, y), 6) AS slope, round(regr_intercept(y_hat, y), 6) AS intercept,
       round(regr_r2(y_hat, y), 6) AS r2, CAST(regr_count(y_hat, y) AS BIGINT) AS n
FROM {_PART_PRED} GROUP BY p_brand"""

ORACLE["rollup_scores"] = """
SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std,
       count(c_acctbal) AS n FROM customer GROUP BY ALL"""

ORACLE["rollup_metric_model"] = """
SELECT l_returnflag AS metric, l_linestatus AS model, round(avg(l_discount), 6) AS mean,
       round(stddev_samp(l_discount), 6) AS std, count(l_discount) AS n FROM lineitem GROUP BY ALL"""

ORACLE["summary_join"] = """
SELECT c_mktsegment, round(avg(c_acctbal), 6) AS value_mean, round(stddev_samp(c_acctbal), 6) AS value_std
FROM customer GROUP BY c_mktsegment"""

_PAIRS = """(SELECT CAST(c_nationkey AS VARCHAR) AS n_key, c_mktsegment AS model, avg(c_acctbal) AS mean,
             stddev_samp(c_acctbal) AS std FROM customer GROUP BY c_nationkey, c_mktsegment)"""

ORACLE["pair_mean_std"] = f"SELECT n_key, model, round(mean, 6) AS mean, round(std, 6) AS std FROM {_PAIRS}"

ORACLE["bar_table"] = f"""
SELECT n_key, model, round(mean, 6) AS mean, round(std, 6) AS std,
       CASE model WHEN 'AUTOMOBILE' THEN 'Auto' WHEN 'BUILDING' THEN 'Building' WHEN 'FURNITURE' THEN 'Furniture'
                  WHEN 'MACHINERY' THEN 'Machinery' END AS label,
       CAST(CASE model WHEN 'FURNITURE' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'BUILDING' THEN 4 END AS INTEGER) AS model_pos,
       round(std * f, 6) AS err, round(mean + std * f, 6) AS upper, round(mean - std * f, 6) AS lower
FROM (SELECT *, CASE WHEN model = 'MACHINERY' THEN 2.0 ELSE 1.0 END AS f FROM {_PAIRS})
WHERE model IN ('FURNITURE', 'AUTOMOBILE', 'MACHINERY', 'BUILDING')"""

_PART_RES = "(SELECT p_size AS cell, p_brand AS algorithm, avg(p_retailprice) / 1000.0 AS mse FROM part GROUP BY ALL)"

ORACLE["leaderboard"] = f"SELECT cell, algorithm, round(mse, 6) AS mse FROM {_PART_RES} ORDER BY mse, algorithm, cell LIMIT 10"

ORACLE["leaderboard_per_cell"] = f"""
SELECT cell, algorithm, round(mse, 6) AS mse, pos FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cell ORDER BY mse, algorithm) AS INTEGER) AS pos FROM {_PART_RES})
WHERE pos <= 3"""

ORACLE["best_model"] = f"SELECT cell, arg_min(algorithm, (mse, algorithm)) AS best_algorithm, round(min(mse), 6) AS best_mse FROM {_PART_RES} GROUP BY cell"

ORACLE["shot_curve"] = """
WITH s AS (SELECT CASE WHEN p_size >= 50 THEN 'Infinite' ELSE CAST(p_size AS VARCHAR) END AS shots,
                  avg(p_retailprice / 1000.0) AS mean, stddev_samp(p_retailprice / 1000.0) AS std, count(*) AS n
           FROM part GROUP BY 1),
l AS (SELECT *, CASE WHEN TRY_CAST(shots AS DOUBLE) > 0 THEN ln(TRY_CAST(shots AS DOUBLE)) END AS lnx FROM s)
SELECT shots, round(mean, 6) AS mean, round(std, 6) AS std, n, round(coalesce(lnx, max(lnx) OVER () + 0.5), 6) AS x FROM l"""

ORACLE["scores_long"] = """
SELECT p_partkey, 'mse' AS metric, p_brand AS model, CAST(r AS INTEGER) AS run,
       round(CASE r WHEN 1 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END, 6) AS score
FROM part, (SELECT unnest([1, 2]) AS r)
UNION ALL SELECT p_partkey, 'mae', p_type, 1, round(p_retailprice / 2.0, 6) FROM part"""

ORACLE["union_results"] = """
SELECT p_brand AS algorithm, round(avg(p_retailprice), 6) AS mse, 'brand' AS source, CAST(NULL AS INTEGER) AS numsamp FROM part GROUP BY p_brand
UNION ALL
SELECT p_type, round(avg(p_retailprice), 6), NULL, max(p_size) FROM part GROUP BY p_type"""

ORACLE["results_frame"] = """
SELECT p_partkey, 'size' AS "Algorithm", round(CAST(p_size AS DOUBLE), 6) AS "MSE" FROM part
UNION ALL SELECT p_partkey, 'price', round(p_retailprice, 6) FROM part"""

ORACLE["to_long"] = """
SELECT c_custkey, 'nation' AS col_name, round(CAST(c_nationkey AS DOUBLE), 6) AS value FROM customer
UNION ALL SELECT c_custkey, 'acctbal', round(c_acctbal, 6) FROM customer"""

ORACLE["to_wide"] = """
SELECT l_returnflag AS metric, round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END), 6) AS "F",
       round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 6) AS "O" FROM lineitem GROUP BY l_returnflag"""

ORACLE["distinct_labels"] = "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"

# ====================================================================== step 6
ORACLE["ols_single"] = """
SELECT p_brand, round(regr_intercept(p_retailprice, p_size), 6) AS intercept,
       round(regr_slope(p_retailprice, p_size), 6) AS slope, count(*) AS n FROM part GROUP BY p_brand"""


# ====================================================================== inventory completions
ORACLE["drop_null_columns"] = f"SELECT doc_id, lang, source, n_chars FROM {_DOCS}"

ORACLE["where_all"] = """
SELECT p_partkey, p_type, p_size, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_type = 'LARGE' AND p_size = 10"""

ORACLE["tag"] = f"SELECT cell, algorithm, round(mse, 6) AS mse, 4 AS act, 100 AS rec, 'raw' AS source FROM {_PART_RES}"

ORACLE["ordered_categories"] = """
SELECT c_custkey, c_mktsegment, CAST(CASE c_mktsegment WHEN 'FURNITURE' THEN 1 WHEN 'AUTOMOBILE' THEN 2
       WHEN 'MACHINERY' THEN 3 WHEN 'BUILDING' THEN 4 END AS INTEGER) AS pos
FROM customer WHERE c_mktsegment IN ('FURNITURE', 'AUTOMOBILE', 'MACHINERY', 'BUILDING')"""

ORACLE["cast_float"] = """
SELECT l_orderkey, l_linenumber, round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 6) AS l_extendedprice FROM lineitem"""

ORACLE["zip_arrays"] = f"""
SELECT row_id, CAST(p - 1 AS INTEGER) AS pos, round(x[p], 6) AS a, round(x[32 + p], 6) AS b
FROM {_V}, range(1, 33) r(p)"""

ORACLE["join_predictions"] = f"SELECT p_partkey, round(y_hat, 6) AS y_hat, round(y, 6) AS y FROM {_PART_PRED}"

ORACLE["mean_abs"] = " UNION ALL ".join(
    f"SELECT '{c}_z' AS col_name, round(avg(abs(({c} - mu) / sd)), 6) AS mean_abs "
    f"FROM lineitem, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM lineitem)" for c in _LINE_NUM)

ORACLE["top_features"] = """
SELECT p_type, feature, round(importance, 6) AS importance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY p_type ORDER BY importance DESC, feature) AS INTEGER) AS rank
  FROM (SELECT p_type, p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY ALL))
WHERE rank <= 3"""

ORACLE["head_rows"] = "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100"

ORACLE["except_rows"] = f"""
SELECT o_orderkey, o_orderpriority FROM orders
EXCEPT ALL SELECT o_orderkey, o_orderpriority FROM {_ORD_TOP} WHERE draw_rank <= 1800"""

ORACLE["concat_vectors"] = f"""
WITH c AS (SELECT row_id, list_concat(x[1:32], x[33:64]) AS c FROM {_V})
{_long_sql('c', 'row_id', 'c')}"""

ORACLE["one_body"] = f"""
WITH s AS (SELECT v.row_id, t.step, list_transform(v.x, lambda a: 1.0 - {repr(2.0 * _W2)} / ({repr(_W2)} + a * a)
                  * pow(sin(sqrt({repr(_W2)} + a * a) * t.th), 2)) AS z
           FROM {_vh(18)} v, (VALUES {_STEP_VALUES}) t(step, th))
SELECT row_id, CAST(step AS INTEGER) AS step, count(*) AS n, round(sum(v), 6) AS sum, round(sum(v * pos), 6) AS wsum,
       round(min(v), 6) AS min, round(max(v), 6) AS max
FROM (SELECT row_id, step, unnest(z) AS v, generate_subscripts(z, 1) AS pos FROM s) GROUP BY row_id, step"""


_GRID_CELLS = f"""(WITH c AS (SELECT * FROM {_strat_split("SELECT * FROM " + _grid_draw(), seed=43, by="rec, sub",
                                                       key=("row_id", "rec", "sub"), tiebreak="row_id, rec, sub")}),
  j AS (SELECT c.rec, c.sub, c.row_id, c.split, v.x, v.y FROM c JOIN {_V} v USING (row_id)),
  d AS (SELECT rec, sub, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM j WHERE split = 'train'),
  st AS (SELECT rec, sub, list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd
         FROM (SELECT rec, sub, i, avg(v) AS mu, stddev_pop(v) AS sd FROM d GROUP BY ALL) GROUP BY rec, sub)
  SELECT j.rec, j.sub, j.row_id, j.split, j.y,
         list_transform(j.x, lambda v, i: CASE WHEN st.sd[i] = 0 THEN 0.0 ELSE (v - st.mu[i]) / st.sd[i] END) AS x
  FROM j JOIN st USING (rec, sub))"""

ORACLE["evaluate_grid_knn"] = f"""
WITH z AS (SELECT * FROM {_GRID_CELLS}),
p AS (SELECT t.rec, t.sub, t.row_id, t.y, r.y AS ny, r.row_id AS nid,
             list_sum(list_transform(list_zip(t.x, r.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
      FROM z t JOIN z r ON t.rec = r.rec AND t.sub = r.sub AND t.split = 'test' AND r.split = 'train'),
nn AS (SELECT *, row_number() OVER (PARTITION BY rec, sub, row_id ORDER BY d, nid) AS kk FROM p),
knn AS (SELECT rec, sub, row_id, any_value(y) AS y, avg(ny) AS y_hat FROM nn WHERE kk <= 5 GROUP BY ALL),
mu AS (SELECT rec, sub, avg(y) AS y_hat FROM z WHERE split = 'train' GROUP BY ALL),
mean AS (SELECT z.rec, z.sub, z.row_id, z.y, mu.y_hat FROM z JOIN mu USING (rec, sub) WHERE z.split = 'test'),
pred AS (SELECT *, 'knn' AS algorithm FROM knn UNION ALL SELECT *, 'mean' AS algorithm FROM mean)
SELECT rec, sub, round(avg((y_hat - y) * (y_hat - y)), 6) AS mse, round(avg(abs(y_hat - y)), 6) AS mae,
       round(1 - sum((y_hat - y) * (y_hat - y)) / (count(y_hat) * var_pop(y)), 6) AS r2, count(y_hat) AS n,
       algorithm, 'raw' AS source
FROM pred GROUP BY rec, sub, algorithm"""


_DISJOINT_DRAW = f"""(WITH g AS (SELECT v.*, c.rec, {H('row_id', 'rec')} AS h
          FROM (SELECT vec_id AS row_id, label AS stratum FROM embeddings) v CROSS JOIN (SELECT unnest({list(_C.SUBSAMPLE_SIZES)}) AS rec) c),
    cnt AS (SELECT rec, stratum, rec // count(*) OVER (PARTITION BY rec) AS m FROM g GROUP BY rec, stratum),
    r AS (SELECT g.*, row_number() OVER (PARTITION BY rec, stratum ORDER BY h, row_id) AS rk FROM g)
    SELECT r.row_id, r.stratum, r.rec, CAST((r.rk - 1) // cnt.m + 1 AS INTEGER) AS sub,
           r.rk - ((r.rk - 1) // cnt.m) * cnt.m AS draw
    FROM r JOIN cnt USING (rec, stratum) WHERE cnt.m > 0 AND r.rk <= cnt.m * {_C.SUBSAMPLE_REPEATS})"""

ORACLE["subsamples_disjoint"] = "SELECT rec, sub, row_id, stratum, draw, split FROM " + _strat_split(
    "SELECT * FROM " + _DISJOINT_DRAW, seed=43, by="rec, sub", key=("row_id", "rec", "sub"),
    tiebreak="row_id, rec, sub")


def _resp(z: str, th: str) -> str:
    return (f"list_transform({z}, lambda a: 1.0 - {repr(2.0 * _W2)} / ({repr(_W2)} + a * a) "
            f"* pow(sin(sqrt({repr(_W2)} + a * a) * {th}), 2))")


_CMP_CELLS = f"""(WITH c AS (SELECT * FROM {_strat_split("SELECT * FROM " + _grid_draw(), seed=43, by="rec, sub",
                                                      key=("row_id", "rec", "sub"), tiebreak="row_id, rec, sub")}),
  j AS (SELECT c.rec, c.sub, c.row_id, c.split, v.x, e.y FROM c JOIN {_vh(8)} v USING (row_id)
        JOIN (SELECT vec_id AS row_id, CAST(label AS DOUBLE) AS y FROM embeddings) e USING (row_id)),
  m AS (SELECT rec, sub, max(list_max(list_transform(x, lambda v: abs(v)))) AS s FROM j WHERE split = 'train' GROUP BY ALL),
  sc AS (SELECT j.rec, j.sub, j.row_id, j.split, j.y,
                list_transform(j.x, lambda v: v * CASE WHEN m.s = 0 THEN 0.0 ELSE 6.0 / m.s END) AS x
         FROM j JOIN m USING (rec, sub)),
  st AS (SELECT sc.*, t.step, {_resp('sc.x', 't.th')} AS z FROM sc, (VALUES {_STEP_VALUES}) t(step, th)),
  emb AS (SELECT rec, sub, row_id, split, y, flatten(list(list_concat(z, {_pairs('z', 8)}) ORDER BY step)) AS x
          FROM st GROUP BY rec, sub, row_id, split, y),
  one AS (SELECT rec, sub, row_id, split, y, flatten(list(z ORDER BY step)) AS x FROM st GROUP BY rec, sub, row_id, split, y)
  SELECT *, 'raw' AS source FROM sc
  UNION ALL SELECT *, 'embedding' FROM emb
  UNION ALL SELECT *, 'one_body' FROM one)"""

ORACLE["compare_sources_knn"] = f"""
WITH z AS (SELECT * FROM {_CMP_CELLS}),
p AS (SELECT t.rec, t.sub, t.source, t.row_id, t.y, r.y AS ny, r.row_id AS nid,
             list_sum(list_transform(list_zip(t.x, r.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
      FROM z t JOIN z r ON t.rec = r.rec AND t.sub = r.sub AND t.source = r.source
                       AND t.split = 'test' AND r.split = 'train'),
nn AS (SELECT *, row_number() OVER (PARTITION BY rec, sub, source, row_id ORDER BY d, nid) AS kk FROM p),
knn AS (SELECT rec, sub, source, row_id, any_value(y) AS y, avg(ny) AS y_hat FROM nn WHERE kk <= 5 GROUP BY ALL),
mu AS (SELECT rec, sub, source, avg(y) AS y_hat FROM z WHERE split = 'train' GROUP BY ALL),
mean AS (SELECT z.rec, z.sub, z.source, z.row_id, z.y, mu.y_hat FROM z JOIN mu USING (rec, sub, source)
         WHERE z.split = 'test'),
pred AS (SELECT *, 'knn' AS algorithm FROM knn UNION ALL SELECT *, 'mean' AS algorithm FROM mean),
res AS (SELECT rec, sub, source, algorithm, avg((y_hat - y) * (y_hat - y)) AS mse FROM pred GROUP BY ALL)
SELECT rec, source, algorithm, round(avg(mse), 6) AS mean, round(stddev_samp(mse), 6) AS std, count(mse) AS n
FROM res GROUP BY rec, source, algorithm"""


ORACLE["shot_sweep_exact"] = f"""
WITH s AS (SELECT * FROM {_SPLIT_V}),
m AS (SELECT max(list_max(list_transform(x, lambda v: abs(v)))) AS s FROM s WHERE split = 'train'),
sc AS (SELECT s.row_id, s.split, s.y, list_transform(s.x, lambda v: v * CASE WHEN m.s = 0 THEN 0.0 ELSE 1.0 / m.s END) AS x
       FROM s, m),
e AS (SELECT row_id, split, y, unnest(x) AS e, generate_subscripts(x, 1) - 1 AS i FROM sc),
g AS (SELECT e.*, sh.shots, l.loop FROM e, (SELECT unnest({list(_C.SHOT_COUNTS_DRAWN)}) AS shots) sh, (SELECT unnest(range(1, {_C.SHOT_LOOPS + 1})) AS loop) l),
dr AS (SELECT row_id, shots, loop, i, e, unnest(range(1, shots + 1)) AS j FROM g WHERE shots > 0),
k AS (SELECT row_id, shots, loop, i, count_if(CAST({H('row_id', 'shots', 'loop', 'i', 'j')} AS DOUBLE)
             / CAST(1152921504606846976 AS DOUBLE) < (1.0 + e) / 2.0) AS k
      FROM dr GROUP BY row_id, shots, loop, i, e),
nv AS (SELECT row_id, shots, loop, i, CAST(2 AS DOUBLE) * k / shots - 1.0 AS v FROM k
       UNION ALL SELECT row_id, shots, loop, i, e FROM g WHERE shots = 0),
z AS (SELECT nv.shots, nv.loop, nv.row_id, sc.split, sc.y, list(nv.v ORDER BY nv.i) AS x
      FROM nv JOIN sc USING (row_id) GROUP BY nv.shots, nv.loop, nv.row_id, sc.split, sc.y),
p AS (SELECT t.shots, t.loop, t.row_id, t.y, r.y AS ny, r.row_id AS nid,
             list_sum(list_transform(list_zip(t.x, r.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
      FROM z t JOIN z r ON t.shots = r.shots AND t.loop = r.loop AND t.split = 'test' AND r.split = 'train'),
nn AS (SELECT *, row_number() OVER (PARTITION BY shots, loop, row_id ORDER BY d, nid) AS kk FROM p),
knn AS (SELECT shots, loop, row_id, any_value(y) AS y, avg(ny) AS y_hat FROM nn WHERE kk <= 5 GROUP BY ALL),
mu AS (SELECT shots, loop, avg(y) AS y_hat FROM z WHERE split = 'train' GROUP BY ALL),
mean AS (SELECT z.shots, z.loop, z.row_id, z.y, mu.y_hat FROM z JOIN mu USING (shots, loop) WHERE z.split = 'test'),
pred AS (SELECT *, 'knn' AS algorithm FROM knn UNION ALL SELECT *, 'mean' AS algorithm FROM mean),
res AS (SELECT shots, loop, algorithm, avg((y_hat - y) * (y_hat - y)) AS mse FROM pred GROUP BY ALL),
cur AS (SELECT algorithm, CAST(shots AS VARCHAR) AS shots, avg(mse) AS mean, stddev_samp(mse) AS std, count(mse) AS n
        FROM res GROUP BY algorithm, shots),
l AS (SELECT *, CASE WHEN TRY_CAST(shots AS DOUBLE) > 0 THEN ln(TRY_CAST(shots AS DOUBLE)) END AS lnx FROM cur)
SELECT algorithm, shots, round(mean, 6) AS mean, round(std, 6) AS std, n,
       round(coalesce(lnx, max(lnx) OVER () + 0.5), 6) AS x FROM l"""


ORACLE["rank_linear_single"] = """
WITH s AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS b, avg(CAST(p_size AS DOUBLE)) AS mu FROM part GROUP BY p_brand)
SELECT p.p_brand, CAST(0 AS INTEGER) AS feature, round(avg(abs(s.b * (CAST(p.p_size AS DOUBLE) - s.mu))), 6) AS importance,
       CAST(1 AS INTEGER) AS rank
FROM part p JOIN s USING (p_brand) GROUP BY p.p_brand"""


ORACLE["rank_permutation_pair"] = f"""
WITH p AS (SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) AS b, p_retailprice AS y FROM part),
c AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
             covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM p),
w AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ka, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS kb FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY {H('row_id')}, row_id) AS rk, count(*) OVER () AS n FROM p),
d AS (SELECT r.*, o.a AS da, o.b AS db FROM r JOIN r o ON o.rk = r.rk % r.n + 1),
e AS (SELECT avg(pow(my + ka * (a - ma) + kb * (b - mb) - y, 2)) AS base,
             avg(pow(my + ka * (da - ma) + kb * (b - mb) - y, 2)) AS ea,
             avg(pow(my + ka * (a - ma) + kb * (db - mb) - y, 2)) AS eb FROM d, w),
i AS (SELECT CAST(0 AS INTEGER) AS feature, ea - base AS importance FROM e UNION ALL SELECT CAST(1 AS INTEGER), eb - base FROM e)
SELECT feature, round(importance, 3) AS importance,
       CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i"""


# ------------------------------------------------------------- sources and sinks
_LINE_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in _LINE_NUM)
ORACLE["read_wide"] = f"SELECT l_orderkey, l_linenumber, {_LINE_COLS} FROM lineitem"
_PART_CELLS = """(SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice, CASE WHEN p_size <= 40 THEN 'train' ELSE 'test' END AS split,
    CAST(200 AS INTEGER) AS rec, CAST(p_size % 4 AS INTEGER) AS sub, CAST(length(p_type) % 3 AS INTEGER) AS act, CAST(1 AS INTEGER) AS version
    FROM part)"""
ORACLE["read_cells"] = f"SELECT *, 'X' AS kind FROM {_PART_CELLS}"
ORACLE["read_cells_columns"] = f"SELECT p_partkey, 'X' AS kind, split, rec, sub, act, version FROM {_PART_CELLS}"
ORACLE["write_cells"] = f"SELECT * FROM {_PART_CELLS} WHERE act = 1"
ORACLE["write_vectors"] = _long_sql(_V, "row_id", "x")
ORACLE["matrix_roundtrip"] = _long_sql(f"(SELECT row_number() OVER (ORDER BY row_id) - 1 AS sample, x FROM {_V})", "sample", "x")
ORACLE["matrix_nulls"] = _long_sql(
    f"(SELECT row_number() OVER (ORDER BY row_id) - 1 AS sample, list_transform(x, lambda e: CASE WHEN e >= 0 THEN e END) AS x FROM {_V})", "sample", "x")
ORACLE["from_scores"] = """
SELECT c_custkey, r_name AS model, s.metric, CAST(s.run AS INTEGER) AS run, s.score
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN (VALUES ('mse', 'AFRICA', 1, CAST(0.5 AS DOUBLE)), ('mse', 'AFRICA', 2, 0.25), ('mse', 'ASIA', 1, 1.5), ('r2', 'ASIA', 1, 0.75),
             ('r2', 'ASIA', 2, 0.125), ('r2', 'EUROPE', 1, 0.0625)) s(metric, model, run, score) ON s.model = r_name"""
