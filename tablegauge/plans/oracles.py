"""The same results as plain SQL over the benchmark tables, written independently of the library."""

from __future__ import annotations

from tablegauge.operators.external import EXTERNAL_INDICES
from tablegauge.operators.metafeatures import EXTERNAL_NAMES, feature_name
from tablegauge.operators.verdicts import MODELS

ORACLES: dict[str, str] = {}


def slug(name: str) -> str:
    return feature_name("x", "y_z", name)[len("x_y_"):]


def column(model: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in model)


LABELLED = "(SELECT * FROM documents JOIN labels USING (doc_id))"

# --- sources, cleaning, encoding, scaling ----------------------------------------------------

ORACLES["src_csv"] = f"""
SELECT doc_id::DOUBLE AS doc_id, n_chars::DOUBLE AS n_chars,
       dense_rank() OVER (ORDER BY lang) - 1 AS lang, dense_rank() OVER (ORDER BY quality) - 1 AS label
FROM {LABELLED}"""
ORACLES["src_csv_regex_sep"] = """
SELECT o_orderkey::DOUBLE AS c0, o_custkey::DOUBLE AS c1, o_totalprice AS c2,
       dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS label FROM orders"""
ORACLES["src_libsvm"] = "SELECT " + ", ".join(
    f"embedding[{i}]::DOUBLE AS f{i}" for i in range(1, 65)) + \
    ", dense_rank() OVER (ORDER BY label) - 1 AS label FROM embeddings"
ORACLES["src_arff"] = f"""
SELECT doc_id::DOUBLE AS doc_id, n_chars::DOUBLE AS n_chars,
       dense_rank() OVER (ORDER BY lang) - 1 AS lang, quality::BIGINT AS label
FROM {LABELLED} WHERE toxic <> 1"""
ORACLES["src_flatten_nested"] = "SELECT vec_id, 64 AS n_features, " + ", ".join(
    f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0 AS f{i}" for i in range(64)) + " FROM embeddings"
ORACLES["src_dispatch"] = f"""
SELECT doc_id::DOUBLE AS doc_id, (lang = 'de')::INT::DOUBLE AS lang_0, (lang = 'en')::INT::DOUBLE AS lang_1,
       (lang = 'es')::INT::DOUBLE AS lang_2, (lang = 'fr')::INT::DOUBLE AS lang_3,
       dense_rank() OVER (ORDER BY quality) - 1 AS label FROM {LABELLED}"""
ORACLES["clean_project_target"] = "SELECT c_custkey, c_acctbal, c_mktsegment AS label FROM customer"
ORACLES["clean_skip_header_limit"] = """
SELECT c_custkey::DOUBLE AS key, c_acctbal AS balance, c_mktsegment AS segment
FROM customer ORDER BY c_custkey LIMIT 1000"""
ORACLES["clean_na_tokens"] = """
SELECT event_id, nullif(event_type, 'error') AS event_type, props FROM events"""
ORACLES["clean_dropna"] = """
SELECT event_id, event_type, props FROM events WHERE event_type <> 'error' AND props IS NOT NULL"""

_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n FROM {t}"
    for t in ("region", "nation", "supplier", "customer", "orders", "lineitem"))
_LIMIT = """CASE WHEN n <= 16 THEN ceil(n / 3.0::DOUBLE) WHEN n <= 100000
 THEN ceil(least(0.00854480458::DOUBLE * n + 1.31494511e-8::DOUBLE * n * n + 14.017948334463796::DOUBLE, n / 4.0::DOUBLE))
 ELSE n / 100.0::DOUBLE END::DOUBLE"""
ORACLES["enc_nominal_limit"] = f"SELECT name, n, {_LIMIT} AS nominal_limit FROM ({_COUNTS})"
ORACLES["enc_infer_nominal"] = f"""
SELECT *, n_distinct <= nominal_limit AS is_nominal FROM (
 SELECT "column", n_distinct, n AS n_rows, {_LIMIT} AS nominal_limit FROM (
  SELECT 'event_type' AS "column", count(DISTINCT event_type) AS n_distinct, count(*) AS n FROM events
  UNION ALL SELECT 'props', count(DISTINCT props), count(*) FROM events))"""
ORACLES["enc_label"] = """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
       dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders"""
ORACLES["enc_categories"] = """
SELECT 'p_brand' AS "column", p_brand AS category, row_number() OVER (ORDER BY p_brand) - 1 AS code
FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 'p_size', p_size::VARCHAR, row_number() OVER (ORDER BY p_size) - 1
FROM (SELECT DISTINCT p_size FROM part)"""
ORACLES["enc_cast_numeric"] = " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) FILTER (try_cast({value} AS DOUBLE) IS NULL) AS n_text FROM orders"
    for name, value in (("rank", "substr(o_orderpriority, 1, 1)"), ("o_orderpriority", "o_orderpriority"),
                        ("o_orderstatus", "o_orderstatus")))


def _dummies(first: int) -> str:
    return "SELECT c_custkey, c_acctbal, " + ", ".join(
        f"(c_nationkey = {k})::INT::DOUBLE AS c_nationkey_{k}" for k in range(first, 25)) + " FROM customer"


ORACLES["enc_dummy"] = _dummies(0)
ORACLES["enc_dummy_drop_first"] = _dummies(1)
ORACLES["scale_standardize"] = "SELECT l_orderkey, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}"
    for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem"
ORACLES["scale_standardize_groups"] = """
SELECT c_custkey, c_mktsegment, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) + 0.0
 AS c_acctbal FROM customer WINDOW w AS (PARTITION BY c_mktsegment)"""
ORACLES["scale_destandardize"] = """
SELECT l_orderkey, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem"""

# --- classes, bags, splits ---------------------------------------------------------------------

ORACLES["class_counts"] = f"SELECT quality AS label, count(*) AS count FROM {LABELLED} GROUP BY quality"
ORACLES["class_binary_check"] = f"SELECT doc_id, quality FROM {LABELLED}"


def _roles(source: str, label: str) -> str:
    return f"""SELECT majority, minority, n_majority, n_minority, round(n_majority / n_minority, 9) AS imbalance_ratio
FROM (SELECT max(l) FILTER (r = 1) AS majority, max(l) FILTER (r = 2) AS minority,
             max(n) FILTER (r = 1) AS n_majority, max(n) FILTER (r = 2) AS n_minority
      FROM (SELECT {label} AS l, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {label}) AS r
            FROM {source} GROUP BY {label}))"""


ORACLES["class_roles"] = _roles(LABELLED, "quality")
ORACLES["class_imbalance"] = f"""SELECT imbalance_ratio FROM (
{_roles("(SELECT (o_orderstatus = 'F')::INT AS f FROM orders)", "f")})"""
ORACLES["class_balanced_weights"] = f"""
SELECT doc_id, quality, round(CASE WHEN quality = minority THEN imbalance_ratio ELSE 1 END::DOUBLE, 9) AS weight
FROM {LABELLED}, ({_roles(LABELLED, "quality")})"""
ORACLES["sample_bag_plan"] = f"""
SELECT name, n AS n_samples, size AS sample_size,
       CAST(round_even((5 * n / (0.63::DOUBLE * size))::DOUBLE, 0) AS BIGINT) AS n_bags
FROM (SELECT *, (CASE WHEN n > 1000 THEN 500 WHEN n > 500 THEN n // 2 END)::BIGINT AS size FROM ({_COUNTS}))"""
ORACLES["sample_bag_quotas"] = """
SELECT label, count, CAST(round_even(0.3333::DOUBLE * count, 0) AS BIGINT) AS quota
FROM (SELECT c_mktsegment AS label, count(*) AS count FROM customer GROUP BY 1)"""


def _draw(source: str, final: str, fraction: str = "size::DOUBLE / n",
          n_bags: str = "CAST(round_even((5 * n / (0.63::DOUBLE * size))::DOUBLE, 0) AS BIGINT)") -> str:
    """Stratified bags by modular permutations of the hash-ordered rows of every class."""
    return f"""WITH src AS ({source}),
tot AS (SELECT n, CASE WHEN n > 1000 THEN 500 ELSE n // 2 END AS size FROM (SELECT count(*) AS n FROM src)),
cls AS (SELECT label, count(*) AS nc FROM src GROUP BY label),
q AS (SELECT label, nc, CAST(round_even({fraction} * nc, 0) AS BIGINT) AS quota, {n_bags} AS n_bags,
 list_min(list_filter(range(nc, nc + 1000), lambda x:
  len(list_filter(range(2, CAST(floor(sqrt(x)) AS BIGINT) + 1), lambda d: x % d = 0)) = 0)) AS p FROM cls, tot),
d AS (SELECT *, '42-' || bag_id || '-' || label AS key FROM (SELECT *, unnest(range(1, n_bags + 1)) AS bag_id FROM q)),
h AS (SELECT *, ('0x' || substr(md5('a-' || key), 1, 15))::BIGINT % (p - 1) + 1 AS a,
      ('0x' || substr(md5('c-' || key), 1, 15))::BIGINT % p AS c FROM d),
j AS (SELECT bag_id, label, nc, quota, j, (a * j + c) % p AS pos
      FROM (SELECT *, unnest(range(0, quota + p - nc)) AS j FROM h)),
k AS (SELECT *, row_number() OVER (PARTITION BY bag_id, label ORDER BY j) AS rn FROM j WHERE pos < nc),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || row_id), row_id) - 1 AS pos FROM src),
bags AS (SELECT k.bag_id::INT AS bag_id, r.* EXCLUDE (pos) FROM k JOIN r USING (label, pos) WHERE rn <= quota)
{final}"""


_CUSTOMERS = "SELECT c_custkey AS row_id, (c_mktsegment = 'BUILDING')::INT AS label, c_acctbal FROM customer"
_ORDERS = "SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS label FROM orders"
ORACLES["sample_bags"] = _draw(_ORDERS, "SELECT bag_id, row_id, label FROM bags")
ORACLES["sample_fraction"] = _draw(
    _ORDERS, "SELECT bag_id, label, count(*) AS n, count(DISTINCT row_id) AS n_distinct FROM bags GROUP BY ALL",
    "0.25::DOUBLE", "10")
ORACLES["src_bag_scan"] = _draw(
    _CUSTOMERS, "SELECT row_id, label, round(c_acctbal, 6) + 0.0 AS acctbal FROM bags WHERE bag_id = 3")
ORACLES["sink_bags_roundtrip"] = _draw(_CUSTOMERS, "SELECT bag_id, row_id, label FROM bags")
ORACLES["split_stratified"] = f"""
SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || row_id), row_id)
 <= round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY label), 0) AS is_test FROM ({_CUSTOMERS})"""
ORACLES["folds_stratified"] = f"""
SELECT row_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('fold-42-' || row_id), row_id) - 1) % 5)::INT
 AS fold FROM ({_CUSTOMERS})"""

# --- agreement with the classes ------------------------------------------------------------------


def _agreement(source: str) -> str:
    """CTEs up to ``v``: per group g all quantities the index formulas use."""
    return f"""WITH src AS ({source}),
c AS (SELECT g, class, cluster, count(*)::DOUBLE AS n FROM src GROUP BY ALL),
a AS (SELECT g, class, sum(n) AS m FROM c GROUP BY ALL),
b AS (SELECT g, cluster, sum(n) AS m, max(n) AS top FROM c GROUP BY ALL),
t AS (SELECT g, sum(n) AS n, sum(n * (n - 1) / 2) AS tp FROM c GROUP BY g),
pa AS (SELECT g, sum(m * (m - 1) / 2) AS pa, -sum(m / n * ln(m / n)) AS hc FROM a JOIN t USING (g) GROUP BY g),
pb AS (SELECT g, sum(m * (m - 1) / 2) AS pb, -sum(m / n * ln(m / n)) AS hk, sum(top) / max(n) AS purity
       FROM b JOIN t USING (g) GROUP BY g),
i AS (SELECT c.g, sum(c.n / t.n * ln(c.n * t.n / (a.m * b.m))) AS mi, -sum(c.n / t.n * log2(c.n / b.m)) AS ent
      FROM c JOIN a USING (g, class) JOIN b USING (g, cluster) JOIN t ON t.g = c.g GROUP BY c.g),
e AS (SELECT g, sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1)
       + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1)
       - lgamma(n - x - y + k + 1))) AS emi
      FROM (SELECT a.g, a.m AS x, b.m AS y, t.n AS n,
             unnest(range(greatest(1, a.m + b.m - t.n)::BIGINT, least(a.m, b.m)::BIGINT + 1))::DOUBLE AS k
            FROM a JOIN b USING (g) JOIN t USING (g)) GROUP BY g),
v AS (SELECT *, pa - tp AS fn, pb - tp AS fp, n * (n - 1) / 2 - pa - pb + tp AS tn, n * (n - 1) / 2 AS m,
       greatest(mi, 0) / nullif(hc, 0) AS hom, greatest(mi, 0) / nullif(hk, 0) AS com
      FROM t JOIN pa USING (g) JOIN pb USING (g) JOIN i USING (g) JOIN e USING (g))
"""


_FORMULAS = {
    "Entropy": "ent", "Purity": "purity", "Precision": "tp / (tp + fp)", "Recall": "tp / (tp + fn)",
    "F": "2 * tp / (2 * tp + fn + fp)", "Weighted-F": "2 * tp / (2 * tp + fn + fp)",
    "Folkes-Mallows": "tp / sqrt((tp + fp) * (tp + fn))", "Rand": "(tp + tn) / m",
    "Adjusted-Rand": "(tp - pa * pb / m) / ((pa + pb) / 2 - pa * pb / m)",
    "Adjusted-Mutual-Info": "(mi - emi) / ((hc + hk) / 2 - emi)",
    "Normalized-Mutual-Info": "mi / ((hc + hk) / 2)", "Homogeneity": "hom", "Completeness": "com",
    "V-Measure": "2 * hom * com / (hom + com)", "Jaccard": "tp / (tp + fn + fp)",
    "Hubert Γ̂": "(m * tp - pa * pb) / (sqrt(pa) * sqrt(pb) * sqrt(m - pa) * sqrt(m - pb))",
    "Kulczynski": "(tp / (tp + fp) + tp / (tp + fn)) / 2", "McNemar": "(tn - fp) / sqrt(tn + fp)",
    "Phi": "(tp * tn - fn * fp) / ((tp + fn) * (tp + fp) * (fn + tn) * (fp + tn))",
    "Russel-Rao": "tp / m", "Rogers-Tanimoto": "(tp + tn) / (tp + tn + 2 * (fn + fp))",
    "Sokal-Sneath1": "tp / (tp + 2 * (fn + fp))", "Sokal-Sneath2": "(tp + tn) / (tp + tn + (fn + fp) / 2)",
}

_LINES = "SELECT 1 AS g, l_returnflag AS class, l_linestatus AS cluster FROM lineitem"
_YEARS = "SELECT year(l_shipdate)::INT AS g, l_returnflag AS class, l_linestatus AS cluster FROM lineitem"
_EMBEDDED = "SELECT 1 AS g, (label >= 5)::INT AS class, label AS cluster FROM embeddings"
for _name in EXTERNAL_INDICES:
    if _name == "Phi":
        ORACLES["ext_phi"] = _agreement(f"SELECT 1 AS g, quality AS class, lang AS cluster FROM {LABELLED}") + \
            f"SELECT round({_FORMULAS['Phi']} * 1e9, 15) AS value FROM v"
    else:
        ORACLES[f"ext_{slug(_name)}"] = _agreement(_LINES) + f"SELECT round({_FORMULAS[_name]}, 9) AS value FROM v"
ORACLES["ext_weighted_f_beta2"] = _agreement(_LINES) + \
    "SELECT round(5 * tp / (5 * tp + 4 * fn + fp), 9) AS value FROM v"


def _long(source: str, digits: int, key: str, names: list[str]) -> str:
    return _agreement(source) + " UNION ALL ".join(
        f"SELECT {key}'{n}' AS index_name, round({_FORMULAS[n]}, {digits}) + 0.0 AS value FROM v" for n in names)


_ALL_BUT_PHI = [n for n in EXTERNAL_INDICES if n != "Phi"]
ORACLES["ext_all"] = _long(_EMBEDDED, 8, "", _ALL_BUT_PHI)
ORACLES["ext_by_year"] = _long(_YEARS, 7, "g AS year, ", _ALL_BUT_PHI)
ORACLES["ext_entropy_per_cluster"] = """
WITH c AS (SELECT l_linestatus AS cluster, l_returnflag AS class, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
b AS (SELECT cluster, sum(n) AS m FROM c GROUP BY ALL)
SELECT cluster, max(m)::BIGINT AS size, round(-sum(n / m * log2(n / m)), 9) AS entropy
FROM c JOIN b USING (cluster) GROUP BY cluster"""
ORACLES["ext_entropy_noise"] = """
WITH c AS (SELECT CASE WHEN l_discount < 0.005 THEN -1 WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS cluster,
            l_returnflag AS class, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
b AS (SELECT cluster, sum(n) AS m FROM c GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c)
SELECT 'drop_from_sum' AS noise, round(-sum(n / t * log2(n / m)) FILTER (cluster <> -1), 9) AS value
FROM c JOIN b USING (cluster), t
UNION ALL SELECT 'partition', round(-sum(n / t * log2(n / m)), 9) FROM c JOIN b USING (cluster), t"""
ORACLES["pair_confusion"] = _agreement(_LINES) + \
    'SELECT tp AS "TP", fn AS "FN", fp AS "FP", tn AS "TN" FROM v'
ORACLES["contingency_table"] = """
SELECT year(l_shipdate)::INT AS year, l_returnflag AS class, l_linestatus AS cluster, count(*) AS n
FROM lineitem GROUP BY ALL"""
ORACLES["agg_mode"] = """
SELECT year, cluster, class AS mode, n FROM (
 SELECT *, row_number() OVER (PARTITION BY year, cluster ORDER BY n DESC, class) AS r FROM (
  SELECT year(l_shipdate)::INT AS year, l_linestatus AS cluster, l_returnflag AS class, count(*) AS n
  FROM lineitem GROUP BY ALL)) WHERE r = 1"""

# --- quality of a clustering by itself --------------------------------------------------------------

_POINTS = """WITH x AS (SELECT l_returnflag || '-' || l_linestatus AS k, l_quantity AS q, l_extendedprice AS e FROM lineitem),
t AS (SELECT count(*)::DOUBLE AS n, avg(q) AS mq, avg(e) AS me, var_pop(q) * count(*) AS tqq,
       var_pop(e) * count(*) AS tee, covar_pop(q, e) * count(*) AS tqe FROM x),
m AS (SELECT k, count(*)::DOUBLE AS nk, avg(q) AS cq, avg(e) AS ce, var_pop(q) * count(*) AS wqq,
       var_pop(e) * count(*) AS wee, covar_pop(q, e) * count(*) AS wqe FROM x GROUP BY k),
s AS (SELECT count(*)::DOUBLE AS kk, sum(wqq + wee) AS wgss, sum(wqq) AS qq, sum(wee) AS ee, sum(wqe) AS qe,
       sum((wqq + wee) / nk) AS disp, sum(nk * ln((wqq + wee) / nk)) AS logdisp,
       sum(nk * ln((wqq * wee - wqe * wqe) / nk / nk)) AS logdet,
       sum(nk * ((cq - mq) ** 2 + (ce - me) ** 2)) AS bgss, sum(nk * sqrt((cq - mq) ** 2 + (ce - me) ** 2)) AS bsum
      FROM m, t),
r AS (SELECT k, sum(sqrt((q - cq) ** 2 + (e - ce) ** 2)) AS own, sum(sqrt((q - mq) ** 2 + (e - me) ** 2)) AS tom,
       avg(sqrt((q - cq) ** 2 + (e - ce) ** 2)) AS sk FROM x JOIN m USING (k), t GROUP BY k),
p AS (SELECT i.k, sqrt((i.cq - j.cq) ** 2 + (i.ce - j.ce) ** 2) AS d, (a.sk + b.sk) AS ss
      FROM m i JOIN m j ON i.k <> j.k JOIN r a ON a.k = i.k JOIN r b ON b.k = j.k),
u AS (SELECT (SELECT sum(worst) FROM (SELECT max(ss / d) AS worst FROM p GROUP BY k)) AS worst,
       (SELECT min(d * d) FROM p) AS least, (SELECT max(d) FROM p) AS most,
       (SELECT sum(own) FROM r) AS own, (SELECT sum(tom) FROM r) AS tom, (SELECT sum(sk) FROM r) AS wsum),
z AS (SELECT *, qq * ee - qe * qe AS detw, tqq * tee - tqe * tqe AS dett FROM s, t, u)
"""
for _key, _formula in {
    "wgss": "round(ln(wgss), 8)", "bgss": "round(ln(bgss), 8)", "ball_hall": "round(ln(disp / kk), 8)",
    "banfeld_raftery": "round(logdisp, 3)", "log_ss_ratio": "round(ln(bgss / wgss), 6)",
    "calinski_harabasz": "round((n - kk) / (kk - 1) * bgss / wgss, 6)",
    "det_ratio": "round(dett / detw, 6)", "ksq_detw": "round(ln(kk * kk * detw), 8)",
    "log_det_ratio": "round(n * ln(dett / detw), 3)", "scott_symons": "round(logdet, 3)",
    "trace_wib": "round((ee * (tqq - qq) - qe * (tqe - qe) - qe * (tqe - qe) + qq * (tee - ee)) / detw, 6)",
    "davies_bouldin": "round(worst / kk, 6)", "ray_turi": "round(ln(wgss / (least * n)), 8)",
    "pbm": "round((tom * most / (kk * own)) ** 2, 6)",
    "score": "round(1 - 1 / exp(exp(bsum / (kk * n) - wsum)), 6)",
}.items():
    ORACLES[f"int_{_key}"] = _POINTS + f"SELECT {_formula} AS value FROM z"
ORACLES["int_scatter"] = _POINTS + """
SELECT k AS cluster, i, round(sign(a) * ln(1 + abs(a)), 6) + 0.0 AS x0, round(sign(b) * ln(1 + abs(b)), 6) + 0.0 AS x1
FROM (SELECT k, 0::INT AS i, wqq AS a, wqe AS b FROM m UNION ALL SELECT k, 1::INT, wqe, wee FROM m)"""
ORACLES["int_moments"] = _POINTS + """
SELECT k AS cluster, nk::BIGINT AS size, round(cq, 6) AS c0, round(ce, 4) AS c1, round(ln(wqq + wee), 8) AS log_wgss FROM m"""

_VECTORS = """WITH v AS (SELECT vec_id AS id, label AS k, (label >= 5)::INT AS g, embedding::DOUBLE[] AS x FROM embeddings),
"""
_PAIRS = """pr AS (SELECT a.id AS i, b.id AS j, a.g AS g, a.k AS ki, b.k AS kj, list_distance(a.x, b.x) AS d
 FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id),
"""
_ALL_PAIRS = _PAIRS.replace("a.g AS g", "0 AS g").replace("a.g = b.g AND ", "")
_PAIR_RESULTS = """sil AS (SELECT g, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
  SELECT g, i, max(CASE WHEN ki = kj THEN mean END) AS a, min(CASE WHEN ki <> kj THEN mean END) AS b FROM (
   SELECT g, i, ki, kj, avg(d) AS mean FROM pr GROUP BY ALL) GROUP BY g, i) GROUP BY g),
half AS (SELECT g, d, ki = kj AS w, row_number() OVER (PARTITION BY g ORDER BY d) AS lo,
  row_number() OVER (PARTITION BY g ORDER BY d DESC) AS hi,
  count(*) FILTER (ki = kj) OVER (PARTITION BY g) AS nw FROM pr WHERE i < j),
cd AS (SELECT g, (sum(d) FILTER (w) - sum(d) FILTER (lo <= nw)) / (sum(d) FILTER (hi <= nw) - sum(d) FILTER (lo <= nw)) AS c,
  min(d) FILTER (NOT w) / max(d) FILTER (w) AS dunn FROM half GROUP BY g)
"""
for _key in ("silhouette", "c", "dunn"):
    ORACLES[f"int_{_key}"] = _VECTORS + _ALL_PAIRS + _PAIR_RESULTS + \
        f"SELECT round({_key}, 8) AS value FROM {'sil' if _key == 'silhouette' else 'cd'}"

#: Per group g and cluster k: size, centroid, squared and plain distances; per group the mean.
_CENTROIDS = """dim AS (SELECT id, g, k, unnest(x) AS val, unnest(range(1, 65)) AS i FROM v),
cen AS (SELECT g, k, list(mean ORDER BY i) AS c FROM (SELECT g, k, i, avg(val) AS mean FROM dim GROUP BY ALL) GROUP BY g, k),
glo AS (SELECT g, list(mean ORDER BY i) AS m FROM (SELECT g, i, avg(val) AS mean FROM dim GROUP BY ALL) GROUP BY g),
ro AS (SELECT v.id, v.g, v.k, list_distance(x, c) AS own, list_distance(x, m) AS tom
       FROM v JOIN cen USING (g, k) JOIN glo ON glo.g = v.g),
cl AS (SELECT ro.g, ro.k, count(*)::DOUBLE AS nk, sum(own * own) AS w, avg(own) AS sk,
       max(list_distance(c, m)) AS cm FROM ro JOIN cen USING (g, k) JOIN glo ON glo.g = ro.g GROUP BY ALL),
cc AS (SELECT a.g, a.k, list_distance(a.c, b.c) AS d, x.sk + y.sk AS ss FROM cen a JOIN cen b ON a.g = b.g AND a.k <> b.k
       JOIN cl x ON x.g = a.g AND x.k = a.k JOIN cl y ON y.g = b.g AND y.k = b.k),
wo AS (SELECT g, sum(worst) AS worst, min(least) AS least, max(most) AS most FROM (
       SELECT g, k, max(ss / d) AS worst, min(d * d) AS least, max(d) AS most FROM cc GROUP BY g, k) GROUP BY g)
"""
_ONE_GROUP = _VECTORS.replace("(label >= 5)::INT AS g", "0 AS g")
ORACLES["pair_centroid_distances"] = _ONE_GROUP + _CENTROIDS + """
SELECT round(worst, 6) AS worst_ratios, round(least, 9) AS least_square, round(most, 9) AS greatest FROM wo"""
ORACLES["pair_row_centroid_distances"] = _ONE_GROUP + _CENTROIDS + """
SELECT id AS row_id, round(own, 6) AS to_centroid, round(tom, 6) AS to_mean FROM ro"""
ORACLES["cluster_fixed_centroids"] = _ONE_GROUP + _CENTROIDS + """
SELECT row_id, cluster, round(d, 6) AS distance FROM (
 SELECT v.id AS row_id, cen.k AS cluster, list_distance(x, c) AS d,
  row_number() OVER (PARTITION BY v.id ORDER BY list_distance(x, c), cen.k) AS r FROM v JOIN cen ON v.g = cen.g)
WHERE r = 1"""
ORACLES["pair_distances"] = """
SELECT a.vec_id AS row_id, b.label AS cluster, count(*) AS n,
       round(sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS total_distance
FROM embeddings a, embeddings b GROUP BY ALL"""
ORACLES["pair_euclidean"] = """
SELECT vec_id AS row_id, round(list_distance(e[1:32], e[33:64]), 9) AS distance,
       round(list_distance(e[1:32], e[33:64]) ** 2, 9) AS squared_distance
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"""
ORACLES["int_by_group"] = _VECTORS + _PAIRS + _PAIR_RESULTS + ", " + _CENTROIDS + """,
sm AS (SELECT cl.g, count(*)::DOUBLE AS kk, sum(nk) AS n, sum(w) AS wgss, sum(nk * cm * cm) AS bgss,
       sum(nk * cm) AS bsum, sum(sk) AS wsum FROM cl GROUP BY g)
""" + " UNION ALL ".join(
    f"SELECT g AS label, '{name}' AS index_name, round({f}, 7) + 0.0 AS value FROM sm JOIN wo USING (g) JOIN sil USING (g) JOIN cd USING (g)"
    for name, f in {
        "WGSS": "wgss", "BGSS": "bgss", "Calinski-Harabasz": "(n - kk) / (kk - 1) * bgss / wgss",
        "Silhouette": "silhouette", "C": "c", "Dunn": "dunn", "Davies-Bouldin": "worst / kk",
        "Score": "1 - 1 / exp(exp(bsum / (kk * n) - wsum))"}.items())

# --- feature vectors, votes, reports ------------------------------------------------------------------

_GROUPINGS = """SELECT {g} AS g, l_returnflag AS class, {cluster} AS cluster FROM lineitem"""
_KEYED = _GROUPINGS.format(g="year(l_shipdate) || '|kmeans'", cluster="l_linestatus") + " UNION ALL " + \
    _GROUPINGS.format(g="year(l_shipdate) || '|hierarchical'", cluster="floor(l_quantity / 10)::INT::VARCHAR")
_NAMES = [n for n in EXTERNAL_NAMES if n != "Phi"]
ORACLES["metafeatures_pivot"] = _agreement(_KEYED) + \
    "SELECT split_part(g, '|', 1)::INT AS bag_id, " + ", ".join(
        f"max(round({_FORMULAS[n]}, 7) + 0.0) FILTER (g LIKE '%|{a}') AS {feature_name(a, 'external_indices', n)}"
        for a in ("kmeans", "hierarchical") for n in _NAMES) + " FROM v GROUP BY 1"

_HARD = "SELECT year(l_shipdate)::INT AS bag_id, avg(l_quantity) > 25.5 AS is_hard FROM lineitem GROUP BY 1"
_SCORES = " UNION ALL ".join(
    f"SELECT year(l_shipdate)::INT AS bag_id, '{m}' AS model, round(avg((l_quantity > {5 * (i + 1)})::INT), 6) AS est_f1 "
    "FROM lineitem GROUP BY 1" for i, m in enumerate(MODELS))
ORACLES["agg_hardness_vote"] = f"SELECT avg(is_hard::INT) >= 0.5 AS is_hard FROM ({_HARD})"
ORACLES["agg_f1_mean"] = f"SELECT model, round(avg(est_f1), 8) AS est_f1 FROM ({_SCORES}) GROUP BY model"
_REPORTED = [(a, n) for a in ("kmeans", "hierarchical") for n in ("Rand", "F")]
ORACLES["report_consolidated"] = _agreement(_KEYED) + f""", sc AS ({_SCORES}), ha AS ({_HARD}),
wide AS (SELECT split_part(g, '|', 1)::INT AS bag_id, """ + ", ".join(
    f"max(round({_FORMULAS[n]}, 7)) FILTER (g LIKE '%|{a}') AS {a}_external_indices_{n.lower()}" for a, n in _REPORTED) + \
    " FROM v GROUP BY 1), est AS (SELECT bag_id, " + ", ".join(
        f"max(round(est_f1, 7)) FILTER (model = '{m}') AS {column(m)}" for m in MODELS) + """ FROM sc GROUP BY 1)
SELECT 'Bag ' || bag_id AS bag, is_hard, * EXCLUDE (bag_id, is_hard) FROM wide JOIN est USING (bag_id) JOIN ha USING (bag_id)
UNION ALL BY NAME SELECT 'Dataset' AS bag, (SELECT avg(is_hard::INT) >= 0.5 FROM ha) AS is_hard, """ + ", ".join(
        f"round(avg(est_f1) FILTER (model = '{m}'), 7) AS {column(m)}" for m in MODELS) + " FROM sc"
ORACLES["sink_bag_metadata"] = """
SELECT c_mktsegment AS class, count(*) AS count, sum(count(*)) OVER ()::BIGINT AS n_samples, 2::INT AS n_features
FROM customer GROUP BY 1"""
ORACLES["sink_results"] = f"""
SELECT 'CLASSIFICATION COMPLEXITY' AS section, 'is hard to classify' AS name,
       CASE WHEN avg(is_hard::INT) >= 0.5 THEN 'True' ELSE 'False' END AS text, NULL::DOUBLE AS number FROM ({_HARD})
UNION ALL SELECT 'ESTIMATED F1 SCORES', model, NULL, round(avg(est_f1), 6) FROM ({_SCORES}) GROUP BY model"""
ORACLES["sink_metainfo"] = """
SELECT 'run-1' AS run_id, 'parquet' AS dataset_filetype, '{"label": "c_mktsegment"}' AS dataset_config,
       false AS oneshot, count(*) AS n_rows FROM customer"""
ORACLES["sink_result_text"] = ORACLES["sink_results"].replace("round(avg(est_f1), 6)", "round(avg(est_f1), 2)")

ORACLES["int_scatter_wide"] = """
WITH p AS (SELECT label, i, embedding[i]::DOUBLE AS a, embedding[i % 64 + 1]::DOUBLE AS b
           FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT label::VARCHAR AS cluster, (i - 1)::INT AS i, round(sum(a * a) - sum(a) * sum(a) / count(*), 4) AS diagonal,
       round(sum(a * b) - sum(a) * sum(b) / count(*), 4) AS beside FROM p GROUP BY ALL"""

# --- planted clusterings ----------------------------------------------------------------------------

for _name in ("kmeans", "ward", "spectral", "hdbscan"):
    ORACLES[f"cluster_{_name}_planted"] = """
SELECT vec_id AS row_id, min(vec_id) OVER (PARTITION BY label) AS first_row FROM embeddings"""
# Sums of squares of one partition over the four free features; the planted axes are constant in a label.
_SQUARES = """
x AS (SELECT label, g, unnest([1, 2, 3, 4]) AS f, unnest(embedding[1:4])::DOUBLE AS v FROM {source}),
s AS (SELECT g, f, count(*) AS n, sum(v) AS t, sum(v * v) AS q FROM x GROUP BY g, f),
w AS (SELECT g, max(n) AS n, sum(q - t * t / n) AS wgss FROM s GROUP BY g)"""
ORACLES["cluster_summary_planted"] = "WITH " + _SQUARES.format(source="(SELECT *, label AS g FROM embeddings)") + """
SELECT n AS size, round(wgss, 6) AS inertia FROM w"""
ORACLES["int_hartigan_planted"] = "WITH e AS (SELECT *, greatest(label, 1) AS g FROM embeddings), " + _SQUARES.format(
    source="e") + """,
m AS (SELECT sum(n) AS n, count(*) AS k, sum(wgss) AS w FROM w),
-- labels 0 and 1 share a cluster: two axes vary in it
a AS (SELECT 2 * 2500.0::DOUBLE * count(*) FILTER (label = 0) * count(*) FILTER (label = 1) / count(*) AS w FROM embeddings WHERE label < 2),
f AS (SELECT sum(q - t * t / n) AS d FROM (SELECT label, f, count(*) AS n, sum(v) AS t, sum(v * v) AS q FROM x GROUP BY label, f))
SELECT 'Hartigan' AS index_name, round((m.n - m.k - 1) * (m.w + a.w - f.d) / f.d / 1000, 4) AS thousands FROM m, a, f"""

# --- F1 ---------------------------------------------------------------------------------------------

ORACLES["f1_weighted"] = """
WITH s AS (SELECT year(l_shipdate)::INT AS year, (l_quantity > 40)::INT AS l, (l_extendedprice > 50000)::INT AS p FROM lineitem),
f AS (SELECT year, c, count(*) FILTER (l = c)::DOUBLE AS n, 2.0::DOUBLE * count(*) FILTER (l = c AND p = c)
       / (count(*) FILTER (l = c) + count(*) FILTER (p = c)) AS f1 FROM s, (SELECT unnest([0, 1]) AS c) GROUP BY year, c),
o AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, c) AS r FROM f)
SELECT year, round(max(f1) FILTER (r = 1), 9) AS f1_majority, round(max(f1) FILTER (r = 2), 9) AS f1_minority,
       round(max(n) / min(n), 9) AS imbalance_ratio,
       round((max(f1) FILTER (r = 1) + max(n) / min(n) * max(f1) FILTER (r = 2)) / (1 + max(n) / min(n)), 9) AS weighted_f1
FROM o GROUP BY year"""
ORACLES["f1_knn"] = """
WITH v AS (SELECT vec_id AS id, (label >= 5)::INT AS l, embedding::DOUBLE[] AS x FROM embeddings),
h AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY md5('42-' || id), id)
      <= round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY l), 0) AS is_test FROM v),
n AS (SELECT a.id, b.l, list_distance(a.x, b.x) AS d,
       row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r
      FROM h a JOIN h b ON a.is_test AND NOT b.is_test),
w AS (SELECT id, k, weights, sum(CASE WHEN l = 1 THEN wt ELSE 0 END) / sum(wt) AS share FROM (
  SELECT id, l, k, weights, CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE ELSE 1 / d END AS wt
  FROM n, (SELECT unnest([3, 5, 9]) AS k), (SELECT unnest(['uniform', 'distance']) AS weights) WHERE r <= k) GROUP BY ALL)
SELECT id AS row_id, k, weights, round(share, 6) AS share, (share > 0.5)::INT AS prediction FROM w"""

# --- classes moved apart: every prediction is right ----------------------------------------------------
for _key, _name in {"decision_tree": "decision tree", "random_forest": "random forest", "logistic": "logistic regression",
                    "knn_search": "k-nearest neighbor", "gbt": "xgboost", "svm_rff": "support vector machine",
                    "svm_late": "support vector machine"}.items():
    ORACLES[f"f1_{_key}_planted"] = f"""
SELECT '{_name}' AS model, CASE WHEN count(DISTINCT label >= 5) = 2 THEN 1.0::DOUBLE END AS true_f1 FROM embeddings"""
