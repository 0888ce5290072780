"""The queries of the catalogue in SQL, for engines that read the same tables."""

from __future__ import annotations

from tallywise.operators.anomaly import GAP_PROBABILITIES, RATIO_PROBABILITIES
from tallywise.operators.summary import BOXPLOT_STATS
from tallywise.plans import catalog as C

TXN = """
txn AS (
  SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS vendor,
         l_shipdate AS posted_ts, o_custkey AS cardholder, o_orderpriority AS description,
         o_orderdate AS txn_ts, CAST(date_trunc('month', o_orderdate) AS DATE) AS ym,
         c_nationkey AS agency_number, n_name AS agency_name, p_type AS mcc,
         CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
              ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

LOANS = """
loans AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS row_id,
         CASE WHEN l_quantity % 10 <> 0 THEN l_quantity END AS quantity, l_extendedprice AS price,
         CASE WHEN l_discount > 0 THEN l_discount END AS discount, p_retailprice AS retail,
         CASE WHEN l_linenumber <> 7 THEN p_type END AS kind, p_brand AS brand, o_orderpriority AS priority,
         CASE WHEN p_size % 9 <> 0 THEN c_mktsegment END AS segment,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey),
split AS (
  SELECT *, CAST('0x' || substr(md5(row_id || '|0'), 1, 8) AS BIGINT) % 1000 < 700 AS is_train FROM loans)"""

SCORED = """
scored AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS actual, value AS pred FROM events)"""

PIXELS = """
pixels AS (
  SELECT l_suppkey AS image_id, CAST(round(l_quantity) AS INTEGER) % 5 * 50 AS r,
         CAST(round(l_discount * 100) AS INTEGER) * 20 AS g, CAST(round(l_tax * 100) AS INTEGER) * 30 AS b
  FROM lineitem),
colors AS (SELECT image_id, r, g, b, count(*) AS n FROM pixels GROUP BY ALL)"""

CELLS = """
cells AS (
  SELECT l_suppkey AS frame_id, l_linenumber AS "row", CAST(l_partkey % 80 AS INTEGER) AS col,
         max(l_discount * 10) AS score, max(l_quantity / 4) AS d0, max(l_quantity / 2) AS d1,
         max(l_tax * 100 + 2) AS d2, max(l_tax * 200 + 3) AS d3, max(l_tax * 2) AS angle
  FROM lineitem GROUP BY ALL),
ends AS (
  SELECT *, CAST(trunc(col * 4.0::DOUBLE + cos(angle) * d1 + sin(angle) * d2) AS INTEGER) AS end_x,
         CAST(trunc("row" * 4.0::DOUBLE - sin(angle) * d1 + cos(angle) * d2) AS INTEGER) AS end_y
  FROM cells WHERE score >= 0.5),
boxes AS (
  SELECT frame_id, "row", col, score, CAST(trunc(end_x - (d1 + d3)) AS INTEGER) AS start_x,
         CAST(trunc(end_y - (d0 + d2)) AS INTEGER) AS start_y, end_x, end_y FROM ends)"""

CUTS = """
cuts AS (
  SELECT o_custkey AS video_id, o_orderkey AS seq, 43200.0::DOUBLE AS duration, o_orderkey % 97 = 0 AS bad,
         CAST(o_orderkey % 43200 + 1 AS DOUBLE) AS sec FROM orders)"""


def rnd(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) AS {name}"


def even(expr: str, places: int = 2) -> str:
    scale = float(10 ** places)
    return f"round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale}"


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def box(source: str, key: str, value: str) -> str:
    return f"""
q AS (SELECT {key}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
             quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY {key}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
box AS (
  SELECT {key}, count({value}) AS "count", min({value}) AS "min", any_value(q1) AS q1, any_value(median) AS median,
         any_value(q3) AS q3, max({value}) AS "max", any_value(iqr) AS iqr, any_value(lo) AS lower_bound,
         any_value(hi) AS upper_bound, count(*) FILTER ({value} < lo OR {value} > hi) AS num_outliers
  FROM {source} JOIN f USING ({key}) GROUP BY {key})"""


BOX_COLUMNS = ("min", "q1", "median", "q3", "max", "iqr", "lower_bound", "upper_bound")


def box_select(key: str) -> str:
    cols = ", ".join(rnd(f'"{c}"', f'"{c}"') for c in BOX_COLUMNS)
    return f'SELECT {key}, "count", {cols}, num_outliers FROM box'


def box_matrix() -> str:
    named = ["count", *BOX_COLUMNS, "num_outliers"]
    long = " UNION ALL ".join(
        f"SELECT strftime(ym, '%Y-%m') AS m, '{s}' AS stat, {even(f'round("{c}"::DOUBLE, 6)')} AS value FROM box"
        for s, c in zip(BOXPLOT_STATS, named))
    months = ", ".join(f"max(value) FILTER (m = '{m}') AS \"{m}\"" for m in C.MONTHS)
    return f"WITH {TXN}, amounts AS (SELECT ym, amount::DOUBLE AS x FROM txn), {box('amounts', 'ym', 'x')}, long AS ({long}) SELECT stat, {months} FROM long GROUP BY stat"


def ratio_cte(stat: str) -> str:
    one = ("sum(amount)::DOUBLE / count(amount)" if stat == "mean" else "quantile_cont(amount::DOUBLE, 0.5)")
    return f"""{TXN},
stats AS (SELECT vendor, mcc, {one} AS group_stat FROM txn GROUP BY vendor, mcc),
ratios AS (
  SELECT t.*, group_stat, CASE WHEN group_stat = 0 THEN 0 ELSE amount::DOUBLE / group_stat END AS raw,
         round(CASE WHEN group_stat = 0 THEN 0 ELSE amount::DOUBLE / group_stat END, 9) AS ratio
  FROM txn t LEFT JOIN stats USING (vendor, mcc))"""


def probs(values) -> str:
    return "[" + ", ".join(repr(float(p)) for p in values) + "]"


RATIO_BINNED = f"""
edges AS (SELECT list_transform(quantile_cont(ratio, {probs(RATIO_PROBABILITIES)}), lambda e: round(e, 9)) AS e FROM ratios),
binned AS (SELECT ratios.*, CAST(1 + len(list_filter(e[2:], lambda x: x < ratio)) AS INTEGER) AS bin_id FROM ratios, edges)"""

RATIO_OUT = "orderkey, linenumber, partkey, vendor, mcc"


def describe(source: str, value: str, places: int = 6) -> str:
    return f"""SELECT count({value}) AS "count", {rnd(f'avg({value})', 'mean', places)}, {rnd(f'stddev_samp({value})', 'std', places)},
  {rnd(f'min({value})', '"min"', places)}, {rnd(f'quantile_cont({value}, 0.25)', 'q25', places)},
  {rnd(f'quantile_cont({value}, 0.5)', 'q50', places)}, {rnd(f'quantile_cont({value}, 0.75)', 'q75', places)},
  {rnd(f'max({value})', '"max"', places)} FROM {source}"""


def mom(entity: str) -> str:
    return f"""{TXN},
m AS (SELECT {entity}, ym, sum(amount)::DOUBLE AS monthly_spend FROM txn GROUP BY {entity}, ym HAVING sum(amount) <> 0),
ch AS (SELECT *, (monthly_spend / lag(monthly_spend) OVER (PARTITION BY {entity} ORDER BY ym) - 1) * 100 AS pct_change FROM m)"""


def mom_out(entity: str, source: str = "ch", extra: str = "") -> str:
    return f"SELECT {entity}, ym, {rnd('monthly_spend', 'monthly_spend', 4)}, {rnd('pct_change', 'pct_change', 4)}{extra} FROM {source}"


def velocity(source: str, entity: str, period: str, sigmas: float = 4.0) -> str:
    return f"""
c AS (SELECT {entity}, {period} AS period, count(*) AS txns FROM {source} GROUP BY 1, 2),
v AS (SELECT *, avg(txns) OVER w AS mean, stddev_samp(txns) OVER w AS std FROM c WINDOW w AS (PARTITION BY {entity})),
f AS (SELECT *, coalesce(txns > mean + {sigmas} * std, false) AS anomaly FROM v)"""


DAY = "CAST(txn_ts AS DATE)"
WEEK = "CAST(date_trunc('week', txn_ts) AS DATE)"


def velocity_query(entity: str, period: str) -> str:
    return f"""WITH {TXN}, {velocity('txn', entity, period)}
SELECT {entity}, period, txns, {rnd('mean', 'mean')}, {rnd('std', 'std')}, anomaly FROM f"""


def refund(keys: str) -> str:
    return f"""
t AS (SELECT {keys}, count(*) FILTER (amount > 0) AS total_purchases, count(*) FILTER (amount < 0) AS total_refunds,
        coalesce(sum(amount) FILTER (amount > 0), 0)::DOUBLE AS amt_purchased,
        coalesce(sum(amount) FILTER (amount < 0), 0)::DOUBLE AS amt_refunded, count(amount) AS transaction_count
      FROM txn GROUP BY {keys}),
r AS (SELECT *, total_refunds::DOUBLE / nullif(transaction_count, 0) AS refund_txn_ratio,
        abs(amt_refunded) / nullif(amt_purchased + abs(amt_refunded), 0) AS refund_amt_ratio FROM t),
p AS (SELECT *, coalesce(refund_txn_ratio > 0.5, false) AS high_refund_rate,
        coalesce(refund_amt_ratio > 0.5, false) AS large_refund_amt FROM r)"""


def refund_out(keys: str) -> str:
    return (f"SELECT {keys}, total_purchases, total_refunds, {rnd('amt_purchased', 'amt_purchased')}, "
            f"{rnd('amt_refunded', 'amt_refunded')}, transaction_count, {rnd('refund_txn_ratio', 'refund_txn_ratio')}, "
            f"{rnd('refund_amt_ratio', 'refund_amt_ratio')}, high_refund_rate, large_refund_amt FROM p")


GAPS = f"""
g AS (SELECT *, {days('txn_ts', "lag(txn_ts) OVER (PARTITION BY cardholder ORDER BY txn_ts, orderkey, linenumber, partkey, vendor, amount)")}
        AS days_since_last FROM txn)"""

FILLED = ", ".join(f"coalesce({c}, 'UNK') AS {c}" for c in C.CATEGORIES)
WOE = f"""
fit AS (SELECT {FILLED}, label FROM split WHERE is_train),
tot AS (SELECT sum(label)::DOUBLE AS pos, count(*) - sum(label)::DOUBLE AS neg FROM fit),
cat AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS category, count(*) AS n, sum(label)::BIGINT AS pos FROM fit GROUP BY {c}" for c in C.CATEGORIES)}),
woe AS (SELECT col, category, n, cat.pos, CASE WHEN n = 1 THEN 0 ELSE
          ln(((cat.pos + 1.0) / (tot.pos + 2.0)) / ((n - cat.pos + 1.0) / (tot.neg + 2.0))) END AS woe FROM cat, tot)"""

CURVE = """
d AS (SELECT pred, sum(actual)::BIGINT AS pos, count(*) - sum(actual)::BIGINT AS neg FROM scored GROUP BY pred),
u AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
        (sum(pos) OVER ())::DOUBLE AS p, (sum(neg) OVER ())::DOUBLE AS q FROM d
      WINDOW w AS (ORDER BY pred DESC ROWS UNBOUNDED PRECEDING))"""


def decile(pred: str) -> str:
    return f"""
n AS (SELECT count(*) AS n FROM scored),
o AS (SELECT *, CAST((row_number() OVER (ORDER BY {pred} DESC, id) - 1) * 10 // n AS INTEGER) AS decile FROM scored, n)"""


GAINS = f"""
g AS (SELECT decile, count(*) AS "count", sum(actual)::BIGINT AS actual FROM o GROUP BY decile),
c AS (SELECT *, "count" - actual AS non_actual, (sum("count") OVER w)::BIGINT AS cum_count,
        (sum(actual) OVER w)::BIGINT AS cum_actual, (sum("count" - actual) OVER w)::BIGINT AS cum_non_actual,
        (sum(actual) OVER ())::DOUBLE AS pa, (sum("count" - actual) OVER ())::DOUBLE AS pn,
        row_number() OVER (ORDER BY decile) AS i FROM g WINDOW w AS (ORDER BY decile ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, {even('cum_actual / pa')} AS sa, {even('cum_non_actual / pn')} AS sn, pa / 10 * i AS if_random FROM c)"""

WORDS = r"""list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')), '\s+'), lambda w: w <> '')"""
STOPS = "[" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "]"
TOKENS = f"tok AS (SELECT doc_id, list_filter({WORDS}, lambda w: NOT list_contains({STOPS}, w)) AS tokens FROM documents)"

TERMS = rf"""
t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
        lambda w: NOT list_contains({STOPS}, w)) AS w FROM documents),
grams AS (SELECT doc_id, unnest(w || list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
voc AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000)"""

POSTS = """
labels_all AS (SELECT list_sort(list_distinct(list(lang) || list(source))) AS voc FROM documents)"""


def boost(d: int) -> str:
    damp = (1.0, 0.95, 0.9)[d - 1]
    whens = " ".join(f"WHEN b{d} = '{w}' THEN {amount * damp!r}" for w, amount in C.BOOSTERS.items())
    return f"(CASE {whens} ELSE 0.0 END)::DOUBLE"


NEG = ", ".join(f"'{w}'" for w in C.NEGATIONS)
LEX = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in C.LEXICON)
SENTIMENT = rf"""
lex(token, valence) AS (VALUES {LEX}),
tk AS (SELECT doc_id AS id, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE AS e,
         list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'),
           lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')), lambda w: w <> '') AS t FROM documents),
ix AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM tk),
fl AS (SELECT id, t[i] AS token, CASE WHEN i > 1 THEN t[i-1] END AS b1, CASE WHEN i > 2 THEN t[i-2] END AS b2,
         CASE WHEN i > 3 THEN t[i-3] END AS b3 FROM ix),
rz AS (SELECT id, valence + CASE WHEN valence > 0 THEN {boost(1)} + {boost(2)} + {boost(3)}
         ELSE -({boost(1)} + {boost(2)} + {boost(3)}) END AS v,
         coalesce(b1 IN ({NEG}), false) OR coalesce(b2 IN ({NEG}), false) OR coalesce(b3 IN ({NEG}), false) AS negated
       FROM fl JOIN lex USING (token)),
vl AS (SELECT id, CASE WHEN negated THEN v * -0.74::DOUBLE ELSE v END AS v FROM rz),
ag AS (SELECT id, sum(round(v, 6)::DECIMAL(18,6))::DOUBLE AS s,
         coalesce(sum(round(v + 1, 6)::DECIMAL(18,6)) FILTER (v > 0), 0)::DOUBLE AS p,
         coalesce(sum(round(1 - v, 6)::DECIMAL(18,6)) FILTER (v < 0), 0)::DOUBLE AS m,
         count(*) FILTER (v <> 0) AS k FROM vl GROUP BY id),
al AS (SELECT tk.id, e, len(t) AS len, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(m, 0) AS m, coalesce(k, 0) AS k
       FROM tk LEFT JOIN ag USING (id)),
sh AS (SELECT id, CASE WHEN s > 0 THEN s + e WHEN s < 0 THEN s - e ELSE 0 END AS s,
         CASE WHEN p > m THEN p + e ELSE p END AS p, CASE WHEN p < m THEN m + e ELSE m END AS m, (len - k)::DOUBLE AS z FROM al),
sentiment AS (SELECT id, coalesce(m / nullif(p + m + z, 0), 0) AS neg, coalesce(z / nullif(p + m + z, 0), 0) AS neu,
         coalesce(p / nullif(p + m + z, 0), 0) AS pos, s / sqrt(s * s + 15) AS compound FROM sh)"""
RATED = "rated AS (SELECT doc_id AS id, CAST(doc_id % 5 + 1 AS INTEGER) AS score, text, neg, neu, pos, compound FROM documents LEFT JOIN sentiment ON id = doc_id)"


def kmeans() -> str:
    """Rounds of assignment and mean for each image and number of colours until its centres stay; for WITH RECURSIVE."""
    dist = "(r - c.r) * (r - c.r) + (g - c.g) * (g - c.g) + (b - c.b) * (b - c.b)"
    near = f"CAST(list_position(list_transform(cs, lambda c: {dist}), list_min(list_transform(cs, lambda c: {dist}))) - 1 AS INTEGER)"
    mean = ", ".join(f"sum({c} * n)::DOUBLE / sum(n)::DOUBLE AS {c}" for c in "rgb")
    ks = ", ".join(f"({k})" for k in C.KMEANS_K)
    return f"""{PIXELS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) - 1 AS rank FROM colors),
first_centers AS (SELECT image_id, k, list(struct_pack(c := rank::INTEGER, r := r::DOUBLE, g := g::DOUBLE, b := b::DOUBLE) ORDER BY rank) AS cs
  FROM ranked, (VALUES {ks}) AS t(k) WHERE rank < k GROUP BY image_id, k),
rounds AS (SELECT image_id, k, 0 AS turn, cs, TRUE AS moves FROM first_centers
  UNION ALL
  SELECT image_id, k, turn + 1, now, now <> cs FROM (
    SELECT *, list_transform(cs, lambda c: coalesce(list_filter(found, lambda f: f.c = c.c)[1], c)) AS now FROM (
      SELECT image_id, k, turn, cs, list(struct_pack(c := c, r := r, g := g, b := b)) AS found FROM (
        SELECT image_id, k, turn, cs, c, {mean} FROM (
          SELECT image_id, k, turn, cs, r, g, b, n, {near} AS c FROM rounds JOIN colors USING (image_id) WHERE moves)
        GROUP BY image_id, k, turn, cs, c)
      GROUP BY image_id, k, turn, cs))),
rest AS (SELECT image_id, k, arg_max(cs, turn) AS cs FROM rounds GROUP BY image_id, k),
centers AS (SELECT image_id, k, x.c AS cluster, x.r AS cr, x.g AS cg, x.b AS cb FROM (SELECT image_id, k, unnest(cs) AS x FROM rest)),
per AS (SELECT image_id, k, {near} AS cluster, sum(n)::BIGINT AS n FROM rest JOIN colors USING (image_id) GROUP BY image_id, k, {near}),
shares AS (SELECT *, {even('n / (sum(n) OVER (PARTITION BY image_id, k))::DOUBLE')} AS share FROM per)"""


def stream_windows(period: str, days_long: int) -> str:
    return f"""
mark AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events),
win AS (SELECT user_id, CAST(date_trunc('{period}', ts) AS DATE) AS window_start, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events),
closed AS (SELECT win.* FROM win, mark WHERE window_start + INTERVAL {days_long} DAY <= w)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["table_shape"] = """SELECT count(*) AS n_rows, 11::BIGINT AS n_columns,
  'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns FROM lineitem"""
    q["preview_rows"] = "SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM orders ORDER BY o_orderkey LIMIT 500"
    q["monthly_summary"] = f"WITH {TXN} SELECT ym, {rnd('sum(amount)::DOUBLE', 'total_amount')}, count(amount) AS transaction_count FROM txn GROUP BY ym"
    q["monthly_boxplot"] = f"WITH {TXN}, amounts AS (SELECT ym, amount::DOUBLE AS x FROM txn), {box('amounts', 'ym', 'x')} {box_select('ym')}"
    q["boxplot_event_type"] = f"WITH {box('events', 'event_type', 'value')} {box_select('event_type')}"
    q["monthly_boxplot_matrix"] = box_matrix()
    q["top_agencies"] = f"""WITH {TXN} SELECT agency_number || ' – ' || agency_name AS agency_label, {rnd('sum(amount)::DOUBLE', 'total')}
FROM txn GROUP BY agency_number, agency_name ORDER BY total DESC, agency_label LIMIT 20"""
    q["top_descriptions"] = f"WITH {TXN} SELECT description, {rnd('sum(amount)::DOUBLE', 'total')} FROM txn GROUP BY description ORDER BY total DESC, description LIMIT 20"
    q["top_vendors"] = f"WITH {TXN} SELECT vendor, {rnd('sum(amount)::DOUBLE', 'total')} FROM txn GROUP BY vendor ORDER BY total DESC, vendor LIMIT 40"
    q["top_reasons"] = f'WITH {TXN} SELECT description, count(*) AS "count" FROM txn GROUP BY description ORDER BY 2 DESC, 1 LIMIT 20'
    per_vendor = f"WITH {TXN}, per AS (SELECT vendor, count(DISTINCT mcc) AS n_mccs FROM txn GROUP BY vendor)"
    q["mccs_per_vendor"] = f"{per_vendor} SELECT * FROM per"
    q["top_vendors_by_mccs"] = f"{per_vendor} SELECT * FROM per ORDER BY n_mccs DESC, vendor LIMIT 10"
    q["mean_mccs_per_vendor"] = f"{per_vendor} SELECT {rnd('avg(n_mccs)', 'mean_mccs')} FROM per"
    q["rating_counts"] = 'SELECT CAST(doc_id % 5 + 1 AS INTEGER) AS score, count(*) AS "count" FROM documents GROUP BY 1'
    types = {"row_id": "string", "quantity": "double", "price": "double", "discount": "double", "retail": "double",
             "kind": "string", "brand": "string", "priority": "string", "segment": "string", "label": "int"}
    q["profile_columns"] = f"WITH {LOANS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM loans"""
        for c, t in types.items())
    q["null_rates"] = f"WITH {LOANS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {even(f'avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100')} AS null_rate FROM loans""" for c in types)
    q["class_share"] = f"""WITH {LOANS}, c AS (SELECT label, count(*) AS counts FROM loans GROUP BY label)
SELECT label, counts, {even('counts / (sum(counts) OVER ())::DOUBLE * 100')} AS perc FROM c"""

    stat = {"mean": "sum(amount)::DOUBLE / count(amount)", "median": "quantile_cont(amount::DOUBLE, 0.5)"}
    q["vendor_mcc_mean"] = f"WITH {TXN} SELECT vendor, mcc, {rnd(stat['mean'], 'vendor_mcc_avg')} FROM txn GROUP BY vendor, mcc"
    q["vendor_mcc_median"] = f"WITH {TXN} SELECT vendor, mcc, {rnd(stat['median'], 'vendor_mcc_median')} FROM txn GROUP BY vendor, mcc"
    q["zero_median_groups"] = f"WITH {TXN}, m AS (SELECT {stat['median']} AS m FROM txn GROUP BY vendor, mcc) SELECT count(*) AS n_groups FROM m WHERE m = 0"
    ratio_out = f"{RATIO_OUT}, {rnd('amount::DOUBLE', 'amount')}, {rnd('group_stat', 'group_stat')}, {rnd('raw', 'ratio')}"
    q["ratio_to_mean"] = f"WITH {ratio_cte('mean')} SELECT {ratio_out} FROM ratios"
    q["ratio_to_median"] = f"WITH {ratio_cte('median')} SELECT {ratio_out} FROM ratios"
    q["describe_ratio"] = f"WITH {ratio_cte('median')} {describe('ratios', 'ratio')}"
    labels = ", ".join(f"({i + 1}, '{a * 100:.4f}–{b * 100:.4f}%')" for i, (a, b) in enumerate(zip(RATIO_PROBABILITIES, RATIO_PROBABILITIES[1:])))
    q["ratio_bins"] = f"""WITH {ratio_cte('median')}, {RATIO_BINNED}, labels(bin_id, label) AS (VALUES {labels})
SELECT bin_id, label, count(ratio) AS "count" FROM labels LEFT JOIN binned USING (bin_id) GROUP BY bin_id, label"""
    q["ratio_bin_stats"] = f"""WITH {ratio_cte('mean')}, {RATIO_BINNED}
SELECT bin_id, count(*) AS "count", {rnd('min(ratio)', '"min"')}, {rnd('max(ratio)', '"max"')} FROM binned GROUP BY bin_id"""
    q["ratio_bin_rows"] = f"WITH {ratio_cte('median')}, {RATIO_BINNED} SELECT {RATIO_OUT}, {rnd('amount::DOUBLE', 'amount')}, bin_id FROM binned"
    q["ratio_extremes"] = f"""WITH {ratio_cte('median')},
lo AS (SELECT *, 'low' AS side FROM ratios WHERE raw < 0 ORDER BY raw, {RATIO_OUT} LIMIT 5),
hi AS (SELECT *, 'high' AS side FROM ratios WHERE raw > 1.5 ORDER BY raw DESC, {RATIO_OUT} LIMIT 5)
SELECT {ratio_out}, side FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi)"""

    lag = days("posted_ts", "txn_ts")
    q["posting_lag_stats"] = f"""WITH {TXN} SELECT {lag} AS lag_days, count(amount) AS transaction_count,
  {rnd('min(amount)::DOUBLE', 'min_amount')}, {even('sum(amount)::DOUBLE / count(amount)')} AS mean_amount,
  {rnd('max(amount)::DOUBLE', 'max_amount')} FROM txn GROUP BY 1"""
    q["long_lags"] = f"WITH {TXN} SELECT orderkey, linenumber, partkey, vendor, {rnd('amount::DOUBLE', 'amount')}, {lag} AS lag_days FROM txn WHERE {lag} > 100"

    q["cardholder_mom"] = f"WITH {mom('cardholder')} {mom_out('cardholder')}"
    q["vendor_mom"] = f"WITH {mom('vendor')} {mom_out('vendor')}"
    q["describe_mom"] = f"WITH {mom('cardholder')} {describe('ch', 'pct_change', 3)}"
    q["mom_extreme_history"] = f"""WITH {mom('cardholder')},
lo AS (SELECT cardholder FROM ch WHERE pct_change < -100 ORDER BY pct_change, cardholder, ym LIMIT 2),
hi AS (SELECT cardholder FROM ch WHERE pct_change > 1000 ORDER BY pct_change DESC, cardholder, ym LIMIT 2),
x AS (SELECT *, 'low' AS side FROM ch WHERE cardholder IN (SELECT * FROM lo)
      UNION ALL SELECT *, 'high' FROM ch WHERE cardholder IN (SELECT * FROM hi)) {mom_out('cardholder', 'x', ', side')}"""
    q["vendor_mom_trimmed"] = f"""WITH {mom('vendor')},
x AS (SELECT * FROM ch WHERE vendor NOT IN (SELECT vendor FROM ch WHERE pct_change < -20000 OR pct_change > 20000)) {mom_out('vendor', 'x')}"""
    q["vendor_mom_beyond"] = f"WITH {mom('vendor')}, x AS (SELECT * FROM ch WHERE pct_change > 2000 OR pct_change < -2000) {mom_out('vendor', 'x')}"
    q["flagged_share"] = f"""WITH {mom('cardholder')}, n AS (SELECT count(DISTINCT cardholder) AS n_total FROM txn),
x AS (SELECT 'over_1000' AS rule, count(DISTINCT cardholder) AS n_flagged FROM ch WHERE pct_change > 1000
      UNION ALL SELECT 'over_5000', count(DISTINCT cardholder) FROM ch WHERE pct_change > 5000)
SELECT n_total, n_flagged, {rnd('n_flagged::DOUBLE / n_total * 100', 'pct_flagged')}, rule FROM x, n"""
    spike_out = (f"vendor, ym, {rnd('monthly_tot', 'monthly_tot', 3)}, n_months, {rnd('monthly_avg', 'monthly_avg', 3)}, "
                 f"{rnd('monthly_std', 'monthly_std', 3)}")
    totals = "m AS (SELECT vendor, ym, sum(amount)::DOUBLE AS monthly_tot FROM txn GROUP BY vendor, ym)"
    flag = "coalesce(abs(monthly_tot - monthly_avg) > {k} * monthly_std AND monthly_tot > 5000, false) AS anomaly"
    q["vendor_monthly_spike"] = f"""WITH {TXN}, {totals},
s AS (SELECT vendor, avg(amount::DOUBLE) AS monthly_avg, stddev_samp(amount::DOUBLE) AS monthly_std FROM txn GROUP BY vendor),
x AS (SELECT m.*, count(*) OVER (PARTITION BY vendor) AS n_months, monthly_avg, monthly_std FROM m LEFT JOIN s USING (vendor))
SELECT {spike_out}, {flag.format(k=7.0)} FROM x WHERE n_months > 3"""
    q["vendor_monthly_spike_own_history"] = f"""WITH {TXN}, {totals},
x AS (SELECT *, count(*) OVER w AS n_months, avg(monthly_tot) OVER w AS monthly_avg, stddev_samp(monthly_tot) OVER w AS monthly_std
      FROM m WINDOW w AS (PARTITION BY vendor))
SELECT {spike_out}, {flag.format(k=2.0)} FROM x WHERE n_months > 3"""

    q["refund_cardholder"] = f"WITH {TXN}, {refund('cardholder, ym')} {refund_out('cardholder, ym')}"
    q["refund_vendor"] = f"WITH {TXN}, {refund('vendor, ym')} {refund_out('vendor, ym')}"
    q["refund_anomalies"] = (f"WITH {TXN}, {refund('cardholder, ym')} {refund_out('cardholder, ym')} "
                             "WHERE high_refund_rate AND large_refund_amt AND p.amt_refunded < -300 "
                             "ORDER BY p.amt_refunded DESC, cardholder, ym LIMIT 20")
    q["velocity_day_cardholder"] = velocity_query("cardholder", DAY)
    q["velocity_week_cardholder"] = velocity_query("cardholder", WEEK)
    q["velocity_day_vendor"] = velocity_query("vendor", DAY)
    q["velocity_week_vendor"] = velocity_query("vendor", WEEK)
    vel_out = f"txns, {rnd('mean', 'mean')}, {rnd('std', 'std')}, anomaly"
    q["velocity_hour_user"] = f"WITH {velocity('events', 'user_id', 'date_trunc($$hour$$, ts)'.replace('$$', chr(39)))} SELECT user_id, period, {vel_out} FROM f"
    share = f"{rnd('n_flagged::DOUBLE / n_total * 100', 'pct_flagged')}"
    vel = {p: velocity("txn", "vendor", e) for p, e in (("day", DAY), ("week", WEEK))}
    q["velocity_flagged_share"] = " UNION ALL ".join(
        f"SELECT * FROM (WITH {TXN}, {v}, x AS (SELECT count(DISTINCT vendor) AS n_total, count(DISTINCT vendor) FILTER (anomaly) AS n_flagged FROM f) "
        f"SELECT n_total, n_flagged, {share}, '{p}' AS period FROM x)" for p, v in vel.items())
    q["days_since_last"] = f"WITH {TXN}, {GAPS} SELECT cardholder, orderkey, linenumber, partkey, vendor, {rnd('amount::DOUBLE', 'amount')}, days_since_last FROM g"
    q["days_since_last_event"] = f"SELECT user_id, event_id, {days('ts', 'lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS days_since_last FROM events"
    q["gap_bins"] = f"""WITH {TXN}, {GAPS},
edges AS (SELECT list_sort(list_distinct(quantile_cont(days_since_last::DOUBLE, {probs(GAP_PROBABILITIES)}))) AS e FROM g WHERE days_since_last IS NOT NULL),
bins AS (SELECT e, unnest(range(1, len(e))) AS i FROM edges),
hits AS (SELECT 1 + len(list_filter(e[2:], lambda x: x < days_since_last)) AS i, count(*) AS n FROM g, edges WHERE days_since_last IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin_id, {rnd('e[i]', 'lo')}, {rnd('e[i + 1]', 'hi')}, '(' || e[i] || ', ' || e[i + 1] || ']' AS label, coalesce(n, 0) AS "count"
FROM bins LEFT JOIN hits USING (i)"""
    q["long_gaps"] = f"WITH {TXN}, {GAPS} SELECT cardholder, max(days_since_last) AS days_since_last FROM g WHERE days_since_last > 240 GROUP BY cardholder"

    q["parsed_order_text"] = f"""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS moment,
  CASE WHEN o_orderkey % 7 <> 0 THEN {rnd('o_totalprice::DECIMAL(18,2)::DOUBLE', 'x').rpartition(' AS ')[0]} END AS amount FROM orders"""
    q["hash_split"] = f"WITH {LOANS} SELECT row_id, is_train FROM split"
    means = ", ".join(f"(SELECT avg({c}) FROM split WHERE is_train) AS m_{c}" for c in C.NUMBERS)
    filled = ", ".join(rnd(f"coalesce({c}, m_{c})", c, 3) for c in C.NUMBERS)
    q["impute_mean"] = f"WITH {LOANS}, m AS (SELECT {means}) SELECT row_id, {filled} FROM split, m WHERE NOT is_train"
    rate = lambda c, side: even(f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) FROM split WHERE {side}) * 100")
    q["null_rate_report"] = f"WITH {LOANS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {rate(c, 'is_train')} AS train_before, 0.0::DOUBLE AS train_after,
  {rate(c, 'NOT is_train')} AS test_before, 0.0::DOUBLE AS test_after""" for c in C.NUMBERS)
    q["fill_unknown"] = f"WITH {LOANS} SELECT row_id, {FILLED} FROM loans"
    q["woe_table"] = f"""WITH {LOANS}, {WOE} SELECT col AS "column", category, n, pos, {rnd('woe', 'woe')} FROM woe"""
    joins = " ".join(f"LEFT JOIN woe w{i} ON w{i}.col = '{c}' AND w{i}.category = coalesce(t.{c}, 'UNK')" for i, c in enumerate(C.CATEGORIES))
    weights = ", ".join(rnd(f"coalesce(w{i}.woe, 0)", c) for i, c in enumerate(C.CATEGORIES))
    q["woe_apply"] = f"WITH {LOANS}, {WOE} SELECT row_id, {weights} FROM split t {joins} WHERE NOT is_train"
    q["class_weights"] = f"""WITH {LOANS}, c AS (SELECT label, count(*) AS n FROM loans GROUP BY label)
SELECT label, n, {rnd('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)', 'balanced_weight')},
  {rnd('(SELECT n FROM c WHERE label = 0)::DOUBLE / (SELECT n FROM c WHERE label = 1)', 'scale_pos_weight')} FROM c"""
    q["confusion_metrics"] = f"""WITH {SCORED}, x AS (SELECT count(*) FILTER (actual = 1 AND pred >= 50) AS tp,
  count(*) FILTER (actual = 0 AND pred >= 50) AS fp, count(*) FILTER (actual = 1 AND pred < 50) AS fn,
  count(*) FILTER (actual = 0 AND pred < 50) AS tn FROM scored)
SELECT *, {rnd('(tp + tn)::DOUBLE / (tp + fp + fn + tn)', 'accuracy')}, {rnd('tp::DOUBLE / (tp + fp)', 'precision')},
  {rnd('tp::DOUBLE / (tp + fn)', 'recall')}, {rnd('2.0::DOUBLE * tp / (2 * tp + fp + fn)', 'f1')} FROM x"""
    q["roc_points"] = f"WITH {SCORED}, {CURVE} SELECT {rnd('pred', 'threshold')}, fp, tp, {rnd('fp / q', 'fpr')}, {rnd('tp / p', 'tpr')} FROM u"
    q["pr_points"] = f"WITH {SCORED}, {CURVE} SELECT {rnd('pred', 'threshold')}, {rnd('tp::DOUBLE / (tp + fp)', 'precision')}, {rnd('tp / p', 'recall')} FROM u"
    q["auc_exact"] = f"WITH {SCORED}, {CURVE} SELECT {rnd('sum(neg * (2 * tp - pos))::DOUBLE / 2 / (max(p) * max(q))', 'auc', 9)} FROM u"
    q["deciles"] = f"WITH {SCORED}, {decile('pred')} SELECT id, decile FROM o"
    q["deciles_tied"] = f"WITH {SCORED}, {decile('floor(pred / 100)')} SELECT id, decile FROM o"
    q["gains_table"] = f"""WITH {SCORED}, {decile('pred')}, {GAINS}
SELECT decile, "count", actual, non_actual, cum_count, cum_actual, cum_non_actual, sa AS percent_cum_actual,
  sn AS percent_cum_non_actual, {rnd('if_random', 'if_random')}, {even('cum_actual / if_random')} AS lift,
  {rnd('abs(sa - sn) * 100', 'ks')}, {even('cum_actual / cum_count::DOUBLE * 100')} AS gain,
  {rnd('10000.0::DOUBLE * 0.1 * non_actual', 'revenue')}, 10000.0::DOUBLE * actual AS cost,
  {rnd('10000.0::DOUBLE * 0.1 * non_actual - 10000.0 * actual', 'profit')} FROM s"""
    q["profit_sensitivity"] = f"""WITH {SCORED}, {decile('pred')}, rates(rate) AS (VALUES (0.04::DOUBLE), (0.08::DOUBLE), (0.12::DOUBLE)),
g AS (SELECT decile, count(*) AS "count", sum(actual)::BIGINT AS actual FROM o GROUP BY decile),
x AS (SELECT *, 10000.0::DOUBLE * rate * ("count" - actual) - 10000.0::DOUBLE * actual AS profit FROM g, rates)
SELECT decile, "count", actual, rate, {rnd('profit', 'profit')},
  {rnd('coalesce(sum(profit) FILTER (profit > 0) OVER (PARTITION BY rate), 0)', 'profitable_sum')} FROM x"""

    q["tokens_clean"] = f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tok"
    q["lemma_lookup"] = f"""WITH {TOKENS} SELECT doc_id, array_to_string(list_transform(tokens,
  lambda w: CASE WHEN w LIKE '%s' AND length(w) > 4 THEN w[1:length(w) - 1] ELSE w END), ' ') AS lemmas FROM tok"""
    q["tag_indicators"] = f"""WITH {POSTS} SELECT doc_id AS id,
  array_to_string(list_transform(voc, lambda v: CASE WHEN v = lang OR v = source THEN '1' ELSE '0' END), '') AS indicators FROM documents, labels_all"""
    q["tags_restored"] = "SELECT doc_id AS id, array_to_string(list_sort([lang, source]), ',') AS tags FROM documents"
    q["label_counts"] = "SELECT label, count(*) AS n FROM (SELECT unnest([lang, source]) AS label FROM documents) GROUP BY label"
    q["tfidf_weights"] = f"""WITH {TERMS}, n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, term, tf, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN voc USING (term), n)
SELECT doc_id, term, tf, {rnd('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'weight')} FROM x"""
    q["tfidf_vocabulary"] = f"WITH {TERMS} SELECT * FROM voc"
    q["jaccard_mean"] = f"""WITH x AS (SELECT list_distinct([lang, source]) AS a,
  list_distinct([CASE WHEN n_chars > 1000 THEN lang ELSE 'en' END, 'src1']) AS b FROM documents)
SELECT {rnd('avg(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b))) * 100', 'jaccard')} FROM x"""
    q["lexicon_sentiment"] = f"WITH {SENTIMENT} SELECT id, {rnd('neg', 'neg')}, {rnd('neu', 'neu')}, {rnd('pos', 'pos')}, {rnd('compound', 'compound')} FROM sentiment"
    q["sentiment_by_rating"] = f"""WITH {SENTIMENT}, {RATED} SELECT score, {', '.join(rnd(f'avg({c})', f'vader_{c}') for c in ('neg', 'neu', 'pos', 'compound'))}
FROM rated GROUP BY score"""
    half = "1.96 * stddev_samp(compound) / sqrt(count(compound))"
    q["sentiment_interval"] = f"""WITH {SENTIMENT}, {RATED} SELECT score, count(*) AS n, {rnd('avg(compound)', 'vader_compound', 4)},
  {rnd(f'avg(compound) - {half}', 'vader_compound_low', 4)}, {rnd(f'avg(compound) + {half}', 'vader_compound_high', 4)} FROM rated GROUP BY score"""
    q["most_contrary_text"] = f"""WITH {SENTIMENT}, {RATED},
a AS (SELECT 'one_star_positive' AS kind, id, score, text FROM rated WHERE score = 1 ORDER BY round(pos, 6) DESC, id LIMIT 1),
b AS (SELECT 'five_star_negative' AS kind, id, score, text FROM rated WHERE score = 5 ORDER BY round(neg, 6) DESC, id LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b"""
    q["model_sentiment"] = f"""WITH z AS (SELECT doc_id AS id, length(text) % 7 / 2.0::DOUBLE AS a, length(text) % 5 / 2.0::DOUBLE AS b,
  (length(text) - length(replace(text, 'a', ''))) % 3 / 2.0::DOUBLE AS c FROM documents),
s AS (SELECT id, exp(a) AS a, exp(b) AS b, exp(c) AS c FROM z)
SELECT id, {rnd('a / (a + b + c)', 'neg')}, {rnd('b / (a + b + c)', 'neu')}, {rnd('c / (a + b + c)', 'pos')} FROM s"""

    q["region_enrich"] = f"""WITH f AS (SELECT CASE n_name WHEN 'NATION_7' THEN 'NATION 7' ELSE n_name END AS province, count(*) AS suppliers,
  max(s_acctbal) AS top_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, province, suppliers, {rnd('top_balance', 'top_balance')} FROM nation LEFT JOIN f ON n_name = province"""
    q["point_in_polygon"] = """WITH p AS (SELECT c_custkey AS place_id, (c_custkey * 7 % 400) / 2.0::DOUBLE AS lon, (c_custkey * 13 % 120) / 2.0::DOUBLE AS lat FROM customer),
b AS (SELECT n_name AS name, n_nationkey AS ord, n_nationkey * 7.0::DOUBLE AS x, n_nationkey % 5 * 10.0::DOUBLE AS y FROM nation)
SELECT place_id, coalesce(arg_max(name, ord), '') AS region FROM p LEFT JOIN b ON lon > x AND lon < x + 12 AND lat > y AND lat < y + 15 GROUP BY place_id"""
    q["mean_color"] = f"WITH {PIXELS} SELECT image_id, {', '.join(f'CAST(floor(avg({c})) AS INTEGER) AS {c}' for c in 'rgb')} FROM pixels GROUP BY image_id"
    q["mode_color"] = f"""WITH {PIXELS} SELECT image_id, r, g, b, n, n_pixels FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS n_pixels,
  row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS i FROM colors) WHERE i = 1"""
    q["kmeans_palette"] = f"WITH RECURSIVE {kmeans()} SELECT image_id, k, cluster, {rnd('cr', 'cr')}, {rnd('cg', 'cg')}, {rnd('cb', 'cb')} FROM centers"
    q["cluster_share"] = f"WITH RECURSIVE {kmeans()} SELECT image_id, k, cluster, n, share FROM shares"
    q["palette_strip"] = f"""WITH RECURSIVE {kmeans()}, w AS (SELECT *, CAST(floor(share * 300 + 1) AS BIGINT) AS width_px FROM shares JOIN centers USING (image_id, k, cluster))
SELECT image_id, k, cluster, CAST(floor(cr) AS INTEGER) AS r, CAST(floor(cg) AS INTEGER) AS g, CAST(floor(cb) AS INTEGER) AS b, share,
  CAST(coalesce(sum(width_px) OVER (PARTITION BY image_id, k ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_px, width_px FROM w"""
    q["decode_boxes"] = f'WITH {CELLS} SELECT frame_id, "row", col, {rnd("score", "score")}, start_x, start_y, end_x, end_y FROM boxes'
    scaled = ", ".join(f"CAST(trunc({c} * ({w}::DOUBLE / 320)) AS INTEGER) AS {c}" for c, w in
                       (("start_x", 1000), ("start_y", 562), ("end_x", 1000), ("end_y", 562)))
    q["rescale_boxes"] = f'WITH {CELLS} SELECT frame_id, "row", col, {rnd("score", "score")}, {scaled} FROM boxes'
    packed_box = "struct_pack(start_x := start_x, start_y := start_y, end_x := end_x, end_y := end_y, score := score)"
    area = "(b.end_x - b.start_x + 1)::DOUBLE * (b.end_y - b.start_y + 1)"
    side = lambda l, c: f"greatest(least({l}.end_{c}, b.end_{c}) - greatest({l}.start_{c}, b.start_{c}) + 1, 0)::DOUBLE"
    free = lambda l: f"list_filter({l}[2:], lambda b: {area} <> 0 AND {side(l + '[1]', 'x')} * {side(l + '[1]', 'y')} / ({area}) <= 0.3)"
    q["nms_boxes"] = f"""WITH RECURSIVE {CELLS},
merged AS (SELECT frame_id, start_x, start_y, end_x, end_y, max(score) AS score FROM boxes GROUP BY ALL),
frames AS (SELECT frame_id, list({packed_box} ORDER BY score DESC, start_x, start_y, end_x, end_y) AS l FROM merged GROUP BY frame_id),
picked AS (SELECT frame_id, l[1] AS k, {free('l')} AS rest FROM frames
  UNION ALL SELECT frame_id, rest[1], {free('rest')} FROM picked WHERE len(rest) > 0)
SELECT frame_id, k.start_x AS start_x, k.start_y AS start_y, k.end_x AS end_x, k.end_y AS end_y, {rnd('k.score', 'score')} FROM picked"""
    q["timeline_segments"] = f"""WITH {CUTS}, ok AS (SELECT * FROM cuts WHERE NOT bad),
s AS (SELECT video_id, row_number() OVER w AS part, coalesce(lag(sec) OVER w, 0) AS start_s, sec AS end_s FROM ok WINDOW w AS (PARTITION BY video_id ORDER BY seq)),
l AS (SELECT video_id, count(*) + 1 AS part, arg_max(sec, seq) AS start_s, max(duration) AS end_s FROM ok GROUP BY video_id)
SELECT * FROM s UNION ALL SELECT * FROM l WHERE start_s < end_s"""
    q["timeline_rejects"] = f"WITH {CUTS} SELECT video_id, seq, '1:2' AS cut FROM cuts WHERE bad"

    q["stream_velocity"] = f"WITH {stream_windows('day', 1)} SELECT user_id, window_start, count(*) AS txns FROM closed GROUP BY ALL"
    q["stream_velocity_week"] = f"WITH {stream_windows('week', 7)} SELECT user_id, window_start, count(*) AS txns FROM closed GROUP BY ALL"
    q["stream_velocity_flag"] = f"""WITH {stream_windows('day', 1)}, c AS (SELECT user_id, window_start, count(*) AS txns FROM win GROUP BY 1, 2),
b AS (SELECT user_id, avg(txns) AS mean, stddev_samp(txns) AS std FROM c GROUP BY user_id)
SELECT user_id, window_start, txns, coalesce(txns > mean + 2.0 * std, false) AS anomaly FROM c JOIN b USING (user_id), mark
WHERE window_start + INTERVAL 1 DAY <= w"""
    q["stream_refunds"] = f"""WITH {stream_windows('day', 1)}, r AS (SELECT user_id, window_start, count(*) AS txns, count(*) FILTER (event_type = 'error') AS refunds,
  coalesce(sum(value) FILTER (event_type = 'error'), 0)::DOUBLE AS a, sum(value)::DOUBLE AS t FROM closed GROUP BY 1, 2)
SELECT user_id, window_start, txns, refunds, {rnd('refunds::DOUBLE / txns', 'refund_txn_ratio')}, {rnd('a / nullif(t, 0)', 'refund_amt_ratio')} FROM r"""
    q["stream_gap"] = f"SELECT user_id, event_id, {days('ts', 'lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS days_since_last, false AS late FROM events"
    q["stream_gap_state"] = q["stream_gap"]
    q["text_lines"] = """SELECT trim(line) AS line, count(*) AS n
FROM (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents) GROUP BY trim(line)"""
    q["stream_distinct"] = "SELECT event_id, user_id FROM events"
    return q
