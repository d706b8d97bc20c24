"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from flowlens.sources.flows import FLOWS_SQL, PREDICTIONS_SQL

#: Instants, running attack ends, states, onsets and run numbers.
_STATES = """inst AS (SELECT source_file, Stime, count(*) AS flow_count, sum(Binary_Label)::BIGINT AS attack_count, max(Ltime) AS max_ltime,
           max(CASE WHEN Binary_Label = 1 THEN Ltime END) AS max_attack_ltime FROM flows GROUP BY ALL),
act AS (SELECT *, coalesce(max(max_attack_ltime) OVER (PARTITION BY source_file ORDER BY Stime ROWS UNBOUNDED PRECEDING) >= Stime, false) AS active FROM inst),
pre AS (SELECT *, lag(active) OVER w AS prev_active, lag(Stime) OVER w AS previous_stime FROM act WINDOW w AS (PARTITION BY source_file ORDER BY Stime)),
st AS (SELECT *, active AND coalesce(NOT prev_active, false) AS confirmed, active AND coalesce(NOT prev_active, true) AS run_start FROM pre),
states AS (SELECT *, CASE WHEN active THEN sum(run_start::INT) OVER (PARTITION BY source_file ORDER BY Stime ROWS UNBOUNDED PRECEDING)::BIGINT END AS run FROM st)"""

_RUNS = """runs AS (SELECT source_file, run, min(Stime) AS onset_stime, max(Stime) AS last_stime, max(max_attack_ltime) AS end_ltime,
           arg_min(coalesce(previous_stime, -1), Stime) AS prev0, arg_min(confirmed, Stime) AS confirmed_onset, count(*) AS bins,
           sum((attack_count > 0 AND attack_count < flow_count)::INT)::BIGINT AS mixed_bins, sum(flow_count)::BIGINT AS flow_count, sum(attack_count)::BIGINT AS attack_count
         FROM states WHERE active GROUP BY ALL),
cat AS (SELECT printf('FLOW-E%06d', row_number() OVER (ORDER BY source_file, onset_stime, run)) AS event_id, source_file, run, onset_stime, last_stime, end_ltime,
          CASE WHEN prev0 >= 0 THEN prev0 END AS previous_stime, onset_stime - CASE WHEN prev0 >= 0 THEN prev0 END AS gap_seconds, last_stime - onset_stime AS span_seconds,
          strftime(make_timestamp(onset_stime * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS onset_utc, confirmed_onset, bins, mixed_bins, flow_count, attack_count FROM runs)"""

_LABELS = """nxt AS (SELECT *, min(CASE WHEN confirmed THEN Stime END) OVER (PARTITION BY source_file ORDER BY Stime ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_onset FROM states),
labels AS (SELECT source_file, Stime, horizon, coalesce((next_onset - Stime <= horizon)::INT, 0) AS future_attack, next_onset - Stime AS seconds_to_attack, next_onset
           FROM nxt, (SELECT unnest([60, 300, 900, 1800]) AS horizon) WHERE NOT active)"""

_SESS = """times AS (SELECT DISTINCT Stime FROM flows),
cut AS (SELECT Stime, coalesce((Stime - lag(Stime) OVER (ORDER BY Stime) > 21600)::INT, 0) AS new FROM times),
num AS (SELECT Stime, (sum(new) OVER (ORDER BY Stime))::INT AS temporal_session FROM cut),
sess AS (SELECT flows.*, temporal_session FROM flows JOIN num USING (Stime))"""

_HOLD = """rk AS (SELECT *, row_number() OVER (PARTITION BY temporal_session ORDER BY Stime, Ltime, source_file, record_id) AS a,
          row_number() OVER (PARTITION BY temporal_session ORDER BY Stime DESC, Ltime DESC, source_file DESC, record_id DESC) AS b, (SELECT max(temporal_session) FROM sess) AS last FROM sess),
hold AS (SELECT *, CASE WHEN temporal_session = last THEN 'test' WHEN temporal_session = last - 1 THEN 'validation' ELSE 'train' END AS split,
          (a <= 4 AND temporal_session > 0) OR (b <= 4 AND temporal_session < last) AS purged FROM rk)"""

_POS = "pos AS (SELECT *, row_number() OVER (ORDER BY Stime, Ltime, source_file, record_id) - 1 AS position FROM sess)"

_FOLDS = (
    _POS
    + """,
stop AS (SELECT max(position) + 1 AS stop FROM pos WHERE Binary_Label = 1),
pt AS (SELECT i, least(greatest(1, stop * i // 4), stop - 1) AS p FROM stop, (SELECT unnest([1, 2, 3]) AS i)),
bt AS (SELECT i, pos.Stime AS t FROM pt JOIN pos ON pos.position = pt.p),
bd AS (SELECT i, (SELECT count(*) FROM pos WHERE pos.Stime <= bt.t) AS b FROM bt),
lt AS (SELECT i, b, (SELECT max(Ltime) FROM pos WHERE position < b - 4) AS e FROM bd),
pu AS (SELECT i, b, greatest(b + 4, (SELECT min(position) FROM pos WHERE position >= b AND Stime > e)) AS r FROM lt),
blk AS (SELECT pos.*, (SELECT count(*) FROM bd WHERE b <= position)::INT AS development_block, EXISTS (SELECT 1 FROM pu WHERE position >= b - 4 AND position < r) AS gone FROM pos),
folds AS (SELECT blk.*, fold::INT AS fold, CASE WHEN development_block = fold THEN 'validation' ELSE 'train' END AS role FROM blk, (SELECT unnest([1, 2, 3]) AS fold) WHERE NOT gone AND development_block <= fold)"""
)

_SPLIT = """ev AS (SELECT next_onset, row_number() OVER (ORDER BY next_onset, source_file) AS i FROM (SELECT DISTINCT source_file, next_onset FROM labels WHERE future_attack = 1)),
nn AS (SELECT count(*) AS n FROM ev),
sz AS (SELECT n, CASE WHEN n - greatest(1, floor(0.6 * n)) - greatest(1, floor(0.2 * n)) < 1 THEN n - 2 ELSE greatest(1, floor(0.6 * n)) END::BIGINT AS tr,
              CASE WHEN n - greatest(1, floor(0.6 * n)) - greatest(1, floor(0.2 * n)) < 1 THEN 1 ELSE greatest(1, floor(0.2 * n)) END::BIGINT AS va FROM nn),
bb AS (SELECT (SELECT sum(next_onset) FROM ev, sz WHERE i IN (tr, tr + 1))::BIGINT // 2 AS b1, (SELECT sum(next_onset) FROM ev, sz WHERE i IN (tr + va, tr + va + 1))::BIGINT // 2 AS b2),
spl AS (SELECT labels.*, CASE WHEN Stime <= b1 - 2700 THEN 'train' WHEN Stime >= b1 + 2700 AND Stime <= b2 - 2700 THEN 'validation' WHEN Stime >= b2 + 2700 THEN 'test' ELSE 'purged' END AS split FROM labels, bb)"""

_BLOCK = """src AS (SELECT * REPLACE ('part-' || (srcip::BIGINT % 2)::VARCHAR AS source_file) FROM sess),
pos AS (SELECT *, row_number() OVER (ORDER BY Stime, Ltime, source_file, record_id) - 1 AS position FROM src),
chg AS (SELECT *, (lag(position) OVER w IS NULL OR lag(temporal_session) OVER w <> temporal_session OR lag(source_file) OVER w <> source_file)::INT AS new FROM pos WINDOW w AS (ORDER BY position)),
blocked AS (SELECT *, (sum(new) OVER (ORDER BY position) - 1)::BIGINT AS block FROM chg)"""

_RATES = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 8) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 8) AS f1, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 8) AS fpr"""
_COUNTS = "count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp"


def _auc(source: str, by: str) -> str:
    return f"""auc AS (SELECT {by}, round(sum(won) / nullif(sum(pos)::DOUBLE * sum(neg), 0), 8) AS roc_auc FROM (
  SELECT {by}, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * neg)::DOUBLE AS won
  FROM (SELECT {by}, y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {source} GROUP BY ALL)) GROUP BY ALL)"""


def _ap(source: str, by: str) -> str:
    return f"""ap AS (SELECT {by}, round(sum(gain) / nullif(sum(pos)::DOUBLE, 0), 8) AS average_precision FROM (
  SELECT {by}, pos, pos * (sum(pos) OVER w)::DOUBLE / ((sum(pos) OVER w) + (sum(neg) OVER w))::DOUBLE AS gain
  FROM (SELECT {by}, y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL)"""


_GRID_BY = "algorithm, variant, feature_count, fold"
_BOARD = (
    PREDICTIONS_SQL
    + f""",
grid AS (SELECT * FROM (VALUES ('tree', 'all', 0.5::DOUBLE, 204), ('tree', 'top_10', 0.4::DOUBLE, 10), ('forest', 'all', 0.45::DOUBLE, 204), ('forest', 'top_10', 0.35::DOUBLE, 10), ('lstm', 'all', 0.3::DOUBLE, 204), ('lstm', 'top_10', 0.6::DOUBLE, 10)) t(algorithm, variant, t, feature_count)),
gp AS (SELECT preds.* REPLACE ((y_score >= t)::INT AS y_pred), algorithm, variant, feature_count FROM preds, grid WHERE NOT (algorithm = 'lstm' AND variant = 'top_10' AND fold = 2)),
bm AS (SELECT *, {_RATES} FROM (SELECT {_GRID_BY}, {_COUNTS} FROM gp GROUP BY ALL)),
{_auc("gp", _GRID_BY)}, {_ap("gp", _GRID_BY)},
res AS (SELECT * FROM bm JOIN auc USING ({_GRID_BY}) JOIN ap USING ({_GRID_BY})),
board AS (SELECT algorithm, variant, min(feature_count) AS features_min, max(feature_count) AS features_max,
  """
    + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in ("f1", "fpr", "roc_auc", "average_precision"))
    + """ FROM res GROUP BY algorithm, variant HAVING list_sort(list(DISTINCT fold)) = [0, 1, 2]) """
)

_HIST = """hist AS (SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'Normal Traffic' WHEN 1 THEN 'SYN Flood - High Intensity' WHEN 2 THEN 'BENIGN' WHEN 3 THEN 'normal' WHEN 4 THEN 'SYN Flood - Low Intensity' ELSE 'Attack ' || event_type END AS prediction,
  (event_id * 7 % 100)::DOUBLE / 100::DOUBLE AS confidence, 'model-' || (user_id % 3)::VARCHAR AS model, ts AS timestamp FROM events),
sev AS (SELECT *,
  CASE WHEN starts_with(lower(trim(prediction)), 'normal') THEN 'safe' WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'warning' ELSE 'safe' END AS severity_scenario,
  CASE WHEN lower(prediction) LIKE '%normal%' OR lower(prediction) LIKE '%benign%' THEN 'safe' WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'warning' WHEN confidence >= 0.4 THEN 'info' ELSE 'safe' END AS severity_dashboard,
  CASE WHEN lower(trim(prediction)) = 'normal' THEN 'safe' WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'warning' ELSE 'safe' END AS severity_mail FROM hist),
rnk AS (SELECT *, CASE severity_dashboard WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS rank FROM sev)"""

_SCEN = """samp AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS sample_id, l_returnflag AS traffic_group,
  (l_quantity * 4) / greatest((l_partkey % 20)::DOUBLE, 1) >= 4 AS s1, l_extendedprice / 200 >= 140 AS s2, l_orderkey % 10000 <= 5000 AS s3, 0.7::DOUBLE + l_tax * 3 >= 0.82::DOUBLE AS s4,
  (l_quantity * 6) / greatest((l_suppkey % 90)::DOUBLE, 1) >= 3 AS s5, (l_returnflag <> 'N')::INT AS y FROM lineitem),
sc AS (SELECT *, s1::INT + s2::INT + s3::INT + s4::INT + s5::INT AS k FROM samp),
sd AS (SELECT *, CASE k WHEN 5 THEN 'SYN Flood - High Intensity' WHEN 4 THEN 'SYN Flood - Medium Intensity' WHEN 3 THEN 'SYN Flood - Low Intensity' ELSE 'Normal Traffic' END AS prediction,
  CASE k WHEN 5 THEN 0.95 WHEN 4 THEN 0.86 WHEN 3 THEN 0.77 WHEN 2 THEN 0.46 WHEN 1 THEN 0.54 ELSE 0.62 END::DOUBLE AS confidence, (k >= 3)::INT AS p FROM sc),
se AS (SELECT *, CASE WHEN k < 3 THEN 'safe' WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'warning' ELSE 'safe' END AS severity, p = y AS correct FROM sd)"""


def _causal(w: int) -> str:
    sx, sxx, half = w * (w - 1) / 2, w * (w - 1) * (2 * w - 1) / 6, (w + 1) // 2
    frac = lambda cond, name: f"round(coalesce(count(*) FILTER ({cond}) / nullif(count(f.n), 0)::DOUBLE, 0), 6) AS {name}_{w}s"
    distinct = ", ".join(f"count(DISTINCT {c}) AS {n}_{w}s" for n, c in (("distinct_src_ips", "srcip"), ("distinct_dst_ips", "dstip"), ("distinct_src_ports", "sport"), ("distinct_dst_ports", "dsport")))
    entropy = lambda c: f"SELECT source_file, t, round(log2(sum(c)::DOUBLE) - sum(c * log2(c::DOUBLE)) / sum(c)::DOUBLE, 6) AS e FROM (SELECT source_file, t, {c}, count(*) AS c FROM m WHERE n IS NOT NULL GROUP BY ALL) GROUP BY ALL"
    return f"""WITH {FLOWS_SQL},
q AS (SELECT DISTINCT source_file, Stime AS t FROM flows),
fl AS (SELECT source_file AS sf, Ltime, dur, sbytes + dbytes AS by_, Spkts + Dpkts AS pk, coalesce(srcip, 'UNKNOWN') AS srcip, coalesce(dstip, 'UNKNOWN') AS dstip, coalesce(sport, 'UNKNOWN') AS sport, coalesce(dsport, 'UNKNOWN') AS dsport, lower(proto) AS pr, upper(state) AS sta, 1 AS n FROM flows),
m AS (SELECT q.source_file, q.t, f.* FROM q LEFT JOIN fl f ON f.sf = q.source_file AND f.Ltime > q.t - {w} AND f.Ltime <= q.t),
a AS (SELECT f.source_file, f.t AS Stime, count(f.n) AS completed_flows_{w}s, coalesce(sum(pk), 0)::BIGINT AS total_packets_{w}s, coalesce(sum(by_), 0)::BIGINT AS total_bytes_{w}s,
  round(coalesce(avg(dur), 0), 6) AS duration_mean_{w}s, round(coalesce(sqrt(greatest(avg(dur * dur) - avg(dur) * avg(dur), 0)), 0), 4) AS duration_std_{w}s,
  round(coalesce(sum(pk), 0)::DOUBLE / {w}, 6) AS packets_per_second_{w}s, round(coalesce(sum(by_), 0)::DOUBLE / {w}, 6) AS bytes_per_second_{w}s,
  {frac("pr = 'tcp'", "tcp_fraction")}, {frac("pr = 'udp'", "udp_fraction")}, {frac("sta = 'FIN'", "state_fin_fraction")}, {frac("sta = 'CON'", "state_con_fraction")}, {frac("sta = 'INT'", "state_int_fraction")},
  round((2 * count(*) FILTER (Ltime > f.t - {half}) - count(f.n))::DOUBLE / (count(f.n) - count(*) FILTER (Ltime > f.t - {half}) + 1), 6) AS flow_rate_growth_{w}s,
  round(({w}::DOUBLE * coalesce(sum((Ltime - (f.t - {w} + 1))::DOUBLE), 0) - {sx}::DOUBLE * count(f.n)) / ({w}::DOUBLE * {sxx}::DOUBLE - {sx}::DOUBLE * {sx}::DOUBLE), 8) AS flow_count_trend_{w}s, {distinct}
  FROM m f GROUP BY f.source_file, f.t),
e1 AS ({entropy("dstip")}), e2 AS ({entropy("dsport")})
SELECT a.*, coalesce(e1.e, 0) AS dst_ip_entropy_{w}s, coalesce(e2.e, 0) AS dst_port_entropy_{w}s
FROM a LEFT JOIN e1 ON e1.source_file = a.source_file AND e1.t = Stime LEFT JOIN e2 ON e2.source_file = a.source_file AND e2.t = Stime"""


def _five(source: str, column: str, by: str) -> str:
    return f"SELECT {by}, count({column}) AS n, min({column})::DOUBLE AS min, round(quantile_cont({column}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({column}::DOUBLE, 0.95), 6) AS p95, max({column})::DOUBLE AS max FROM {source} GROUP BY ALL"


_W = f"WITH {FLOWS_SQL}, "
_LAB = f"{_W}{_STATES}, {_LABELS} "
_LAGS = ", ".join(f"lag(record_id, {4 - i}) OVER w AS record_id_t{i:02d}" if i < 4 else "record_id AS record_id_t04" for i in range(5))
_NUMBER = r"CASE WHEN regexp_matches(trim(sport), '^[+-]?0[xX][0-9a-fA-F]+$') THEN ('0x' || substr(trim(sport), 3))::BIGINT::DOUBLE WHEN regexp_matches(trim(sport), '^[0-9]+$') THEN trim(sport)::DOUBLE ELSE 0::DOUBLE END"

SQL: dict[str, str] = {
    "attack_run_catalog": f"{_W}{_STATES}, {_RUNS} SELECT * FROM cat",
    "attack_categories": f"""{_W}{_STATES}, {_RUNS},
per AS (SELECT source_file, run, attack_cat, count(*) AS n FROM flows JOIN (SELECT source_file, Stime, run FROM states WHERE active) USING (source_file, Stime) WHERE Binary_Label = 1 GROUP BY ALL)
SELECT event_id, cat.source_file, cat.run, primary_category, primary_flows, categories FROM cat JOIN (
  SELECT source_file, run, (list(attack_cat ORDER BY n DESC, attack_cat))[1] AS primary_category, max(n) AS primary_flows, string_agg(attack_cat, '|' ORDER BY attack_cat) AS categories FROM per GROUP BY ALL) p
  ON p.source_file = cat.source_file AND p.run = cat.run""",
    "onset_diagnostics_by_file": f"{_W}{_STATES}, {_RUNS} SELECT source_file, count(*) AS runs, count(*) FILTER (confirmed_onset) AS confirmed, count(*) FILTER (NOT confirmed_onset) AS boundary, sum(mixed_bins)::BIGINT AS mixed_bins, sum(attack_count)::BIGINT AS attack_count FROM cat GROUP BY ALL",
    "event_span_summary": f"{_W}{_STATES}, {_RUNS} {_five('cat', 'span_seconds', 'confirmed_onset')}",
    "raw_transitions": f"WITH {FLOWS_SQL} SELECT source_file, count(*) FILTER (t) AS transitions FROM (SELECT source_file, Binary_Label = 1 AND lag(Binary_Label) OVER (PARTITION BY source_file ORDER BY record_id) = 0 AS t FROM flows) GROUP BY ALL",
    "backward_steps": f"WITH {FLOWS_SQL} SELECT source_file, count(*) FILTER (b) AS backward_steps FROM (SELECT source_file, Stime < lag(Stime) OVER (PARTITION BY source_file ORDER BY (record_id * 7919) % 10007 * 1000000 + record_id) AS b FROM flows) GROUP BY ALL",
    "instants": f"{_W}{_STATES} SELECT * FROM inst",
    "temporal_audit_profile": f"""WITH {FLOWS_SQL} SELECT count(*) AS n_rows, count(DISTINCT source_file) AS files, min(Stime) AS min_stime, round(median(Stime::DOUBLE), 6) AS median_stime, max(Stime) AS max_stime, max(Ltime) AS max_ltime,
  strftime(make_timestamp(min(Stime) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_utc, strftime(make_timestamp(max(Stime) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_utc,
  round(avg((Ltime - Stime)::DOUBLE), 6) AS mean_duration, round(median((Ltime - Stime)::DOUBLE), 6) AS median_duration, max((Ltime - Stime)::DOUBLE) AS max_duration,
  count(*) FILTER (Ltime < Stime) AS negative_durations, count(*) FILTER (Ltime = Stime) AS zero_durations, count(*) FILTER (NOT Stime BETWEEN 946684800 AND 4102444800) AS implausible_times,
  count(*) FILTER (Stime IS NULL) AS missing_times, sum(Binary_Label)::BIGINT AS attacks FROM flows""",
    "per_file_audit": f"""WITH {FLOWS_SQL}, b AS (SELECT *, Stime < lag(Stime) OVER (PARTITION BY source_file ORDER BY record_id) AS back FROM flows)
SELECT source_file, count(*) AS n_rows, min(Stime) AS min_stime, max(Stime) AS max_stime, count(*) FILTER (Ltime < Stime) AS ends_before_start, sum(Binary_Label)::BIGINT AS attacks, count(*) FILTER (back) AS backward_steps FROM b GROUP BY ALL""",
    "label_histogram": f"WITH {FLOWS_SQL} SELECT Binary_Label::VARCHAR AS value, count(*) AS n FROM flows GROUP BY ALL",
    "category_histogram": f"WITH {FLOWS_SQL} SELECT attack_cat AS value, count(*) AS n FROM flows GROUP BY ALL",
    "audit_readiness": f"""WITH {FLOWS_SQL}, p AS (SELECT count(*) AS n, count(*) FILTER (Ltime < Stime) AS neg, count(*) FILTER (NOT Stime BETWEEN 946684800 AND 4102444800) AS imp, count(*) FILTER (Stime IS NULL) AS mis, coalesce(sum(Binary_Label), 0) AS a FROM flows),
r AS (SELECT list_filter([CASE WHEN n = 0 THEN 'no rows' END, CASE WHEN neg > 0 THEN 'negative durations' END, CASE WHEN imp > 0 THEN 'implausible times' END, CASE WHEN mis > 0 THEN 'missing times' END, CASE WHEN a = 0 OR a = n THEN 'a single class' END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT len(l) = 0 AS ready, coalesce(array_to_string(l, '|'), '') AS reasons FROM r""",
    "prospective_labels": f"{_LAB} SELECT * FROM labels",
    "label_diagnostics": f"""{_LAB}, s AS ({_five("labels WHERE future_attack = 1", "seconds_to_attack", "horizon")}),
d AS (SELECT horizon, count(*) AS n_rows, count(*) FILTER (future_attack = 1) AS positives, count(*) FILTER (future_attack = 0) AS negatives, round(avg(future_attack), 6) AS prevalence,
  count(DISTINCT (source_file, next_onset)) FILTER (future_attack = 1) AS events, count(DISTINCT (source_file, next_onset)) FILTER (next_onset IS NOT NULL) AS events_ahead FROM labels GROUP BY ALL)
SELECT d.*, s.min, s.median, s.p95, s.max, round(events / greatest(events_ahead, 1)::DOUBLE, 6) AS coverage FROM d LEFT JOIN s USING (horizon)""",
    "label_examples": f"""{_LAB} SELECT horizon, future_attack, source_file, Stime, seconds_to_attack, coalesce(seconds_to_attack <= horizon, false) = (future_attack = 1) AS obeys_rule
FROM (SELECT *, row_number() OVER (PARTITION BY horizon, future_attack ORDER BY source_file, Stime) AS r FROM labels) WHERE r = 1""",
    "derived_onsets": f"{_W}{_STATES} SELECT printf('DERIVED-E%06d', row_number() OVER (ORDER BY source_file, Stime)) AS event_id, source_file, Stime AS onset_stime FROM states WHERE confirmed",
    "catalog_labels": f"""{_W}{_STATES}, {_RUNS}, {_LABELS} SELECT l.source_file, l.Stime, horizon, future_attack, seconds_to_attack, next_onset, event_id AS next_event_id
FROM labels l LEFT JOIN cat ON cat.source_file = l.source_file AND cat.onset_stime = l.next_onset AND cat.confirmed_onset WHERE horizon = 300""",
    **{f"causal_window_features_{w}": _causal(w) for w in (600, 1800, 3600)},
    "prior_attack_share": f"""{_LAB}, pa AS (SELECT u.source_file, u.Stime, count(f.Ltime) AS prior FROM (SELECT DISTINCT source_file, Stime FROM labels) u LEFT JOIN flows f ON f.source_file = u.source_file AND f.Binary_Label = 1 AND f.Ltime > u.Stime - 1800 AND f.Ltime <= u.Stime GROUP BY ALL)
SELECT horizon, future_attack, count(*) AS n_rows, round(avg((prior > 0)::INT::DOUBLE), 8) AS share FROM labels JOIN pa USING (source_file, Stime) GROUP BY ALL""",
    "attack_free_history": f"WITH {FLOWS_SQL}, u AS (SELECT DISTINCT source_file, Stime FROM flows) SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.source_file = u.source_file AND f.Binary_Label = 1 AND f.Ltime > u.Stime - 600 AND f.Ltime <= u.Stime)",
    "precursor_ranking": f"""{_LAB}, u AS (SELECT DISTINCT source_file, Stime FROM labels),
a AS (SELECT u.source_file, u.Stime, count(f.Ltime)::DOUBLE AS f0, coalesce(sum(sbytes + dbytes), 0)::DOUBLE AS f1, round(coalesce(avg(dur), 0), 6) AS f2, round(coalesce(count(*) FILTER (lower(proto) = 'tcp') / nullif(count(f.Ltime), 0)::DOUBLE, 0), 6) AS f3,
  round((2 * count(*) FILTER (f.Ltime > u.Stime - 900) - count(f.Ltime))::DOUBLE / (count(f.Ltime) - count(*) FILTER (f.Ltime > u.Stime - 900) + 1), 6) AS f4
  FROM u LEFT JOIN flows f ON f.source_file = u.source_file AND f.Ltime > u.Stime - 1800 AND f.Ltime <= u.Stime GROUP BY ALL),
long AS (SELECT horizon, future_attack AS y_true, unnest([0, 1, 2, 3, 4]) AS i, unnest([f0, f1, f2, f3, f4]) AS y_score FROM labels JOIN a USING (source_file, Stime)),
{_auc("long", "horizon, i")},
s AS (SELECT horizon, i, CASE WHEN (var_pop(y_score) FILTER (y_true = 1) + var_pop(y_score) FILTER (y_true = 0)) / 2 > 0 THEN (avg(y_score) FILTER (y_true = 1) - avg(y_score) FILTER (y_true = 0)) / sqrt((var_pop(y_score) FILTER (y_true = 1) + var_pop(y_score) FILTER (y_true = 0)) / 2) ELSE 0 END AS d,
  round(median(y_score) FILTER (y_true = 1), 6) AS median_positive, round(median(y_score) FILTER (y_true = 0), 6) AS median_negative FROM long GROUP BY ALL),
j AS (SELECT horizon, i, round(d, 6) AS smd, median_positive, median_negative, round(greatest(roc_auc, 1 - roc_auc), 6) AS auc FROM s JOIN auc USING (horizon, i) WHERE roc_auc IS NOT NULL)
SELECT horizon, (row_number() OVER (PARTITION BY horizon ORDER BY auc DESC, abs(smd) DESC, i))::INT AS place, ['completed_flows_1800s', 'total_bytes_1800s', 'duration_mean_1800s', 'tcp_fraction_1800s', 'flow_rate_growth_1800s'][i + 1] AS feature, auc, smd, median_positive, median_negative FROM j""",
    "natural_sessions": f"{_W}{_SESS} SELECT record_id, temporal_session FROM sess",
    "session_summary": f"{_W}{_SESS} SELECT temporal_session, count(*) AS n_rows, min(Stime) AS min_stime, max(Ltime) AS max_ltime, sum(Binary_Label)::BIGINT AS attacks, coalesce(string_agg(DISTINCT CASE WHEN Binary_Label = 1 THEN attack_cat END, '|' ORDER BY CASE WHEN Binary_Label = 1 THEN attack_cat END), '') AS categories FROM sess GROUP BY ALL",
    "session_holdout_purged": f"{_W}{_SESS}, {_HOLD} SELECT record_id, temporal_session, split, purged FROM hold",
    "partition_summary": f"{_W}{_SESS}, {_HOLD} SELECT CASE WHEN purged THEN 'purged' ELSE split END AS part, count(*) AS n_rows, min(Stime) AS min_stime, max(Stime) AS max_stime, max(Ltime) AS max_ltime, sum(Binary_Label)::BIGINT AS attacks, count(DISTINCT temporal_session) AS sessions FROM hold GROUP BY ALL",
    "purge_events": f"""{_W}{_SESS}, s AS (SELECT temporal_session, max(Ltime) AS e, min(Stime) AS b FROM sess GROUP BY ALL)
SELECT l.temporal_session AS left_session, r.temporal_session AS right_session, 4 AS rows_each_side, r.b - l.e AS gap_seconds FROM s l JOIN s r ON r.temporal_session = l.temporal_session + 1""",
    "expanding_folds": f"{_W}{_SESS}, {_FOLDS} SELECT record_id, development_block, fold, role FROM folds",
    "fold_summary": f"{_W}{_SESS}, {_FOLDS} SELECT fold, role, count(*) AS n_rows, sum(Binary_Label)::BIGINT AS attacks, min(Stime) AS min_stime, max(Ltime) AS max_ltime FROM folds GROUP BY ALL",
    "event_anchored_split": f"{_LAB}, {_SPLIT} SELECT source_file, Stime, horizon, split FROM spl",
    "split_diagnostics": f"{_LAB}, {_SPLIT} SELECT split, horizon, count(*) AS n_rows, count(*) FILTER (future_attack = 1) AS positives, count(DISTINCT (source_file, next_onset)) FILTER (future_attack = 1) AS events, min(Stime) AS min_stime, max(Stime) AS max_stime FROM spl GROUP BY ALL",
    "viable_horizons": f"""{_LAB}, {_SPLIT}, b AS (SELECT horizon, split, sum(future_attack) AS p, count(*) AS n FROM spl WHERE split <> 'purged' GROUP BY ALL)
SELECT horizon, coalesce(string_agg(split, '|' ORDER BY split) FILTER (p > 0 AND p < n), '') AS both_classes, count(*) FILTER (p > 0 AND p < n) = 3 AS viable FROM b GROUP BY ALL""",
    "window_manifest": f"""{_W}{_SESS}, {_BLOCK}, l AS (SELECT block, temporal_session, source_file, position, {_LAGS}, lag(Stime, 4) OVER w AS start_stime, Ltime AS end_ltime, record_id AS target_record_id, Binary_Label AS target_label, row_number() OVER w AS r FROM blocked WINDOW w AS (PARTITION BY block ORDER BY position))
SELECT * EXCLUDE (r, position), row_number() OVER (ORDER BY position) - 1 AS window_id FROM l WHERE r >= 5""",
    "window_counts": f"{_W}{_SESS}, {_BLOCK} SELECT block, count(*) AS n_rows, greatest(0, count(*) - 4)::BIGINT AS windows, ceil(greatest(0, count(*) - 4) / 2::DOUBLE)::BIGINT AS batches FROM blocked GROUP BY ALL",
    "realized_window_means": f"{_W}{_SESS}, {_BLOCK} SELECT block, target_record_id, mean_dur, mean_sbytes FROM (SELECT block, record_id AS target_record_id, round(avg(dur) OVER w, 6) AS mean_dur, round(avg(sbytes) OVER w, 6) AS mean_sbytes, row_number() OVER (PARTITION BY block ORDER BY position) AS r FROM blocked WINDOW w AS (PARTITION BY block ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE r >= 5",
    "realized_windows_flat": f"""{_W}{_SESS}, {_BLOCK} SELECT block, target_record_id, target_label, flat FROM (SELECT block, record_id AS target_record_id, Binary_Label AS target_label, row_number() OVER (PARTITION BY block ORDER BY position) AS r,
  string_agg(sbytes::VARCHAR || '.0,' || Spkts::VARCHAR || '.0', ',') OVER (PARTITION BY block ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS flat FROM blocked) WHERE r >= 5""",
    "dedupe_clean": f"WITH {FLOWS_SQL} SELECT DISTINCT attack_cat, label, proto, state, coalesce(is_ftp_login, 0) AS is_ftp_login, Binary_Label FROM (SELECT DISTINCT attack_cat, Binary_Label AS label, proto, state, CASE WHEN record_id % 3 = 0 THEN (record_id % 5)::INT END AS is_ftp_login, Binary_Label FROM flows) UNION ALL SELECT * FROM (SELECT attack_cat, label, proto, state, 0, Binary_Label FROM (SELECT DISTINCT attack_cat, Binary_Label AS label, proto, state, CASE WHEN record_id % 3 = 0 THEN (record_id % 5)::INT END AS v, Binary_Label FROM flows) WHERE v IS NULL OR v = 0 GROUP BY ALL HAVING count(*) > 1)",
    "normalize_category": f"WITH {FLOWS_SQL} SELECT record_id, CASE record_id % 5 WHEN 0 THEN 'Fuzzer' WHEN 1 THEN 'Backdoor' WHEN 2 THEN 'BENIGN' WHEN 3 THEN 'BENIGN' ELSE attack_cat END AS category FROM flows",
    "null_inf_fill": f"WITH {FLOWS_SQL} SELECT record_id, CASE WHEN record_id % 4 < 3 THEN 0 ELSE dur END AS dur, CASE WHEN record_id % 3 = 0 THEN 0 ELSE sbytes END AS sbytes, state FROM flows",
    "hex_coercion": f"WITH {FLOWS_SQL} SELECT record_id, {_NUMBER} AS sport FROM flows",
    "cleaned_names": f"WITH {FLOWS_SQL} SELECT record_id, dur AS flow_dur_s FROM flows",
    "robust_scaled": f"""{_W}{_SESS}, {_HOLD}, t AS (SELECT record_id, dur, ln(1 + sbytes * 1000::DOUBLE) AS sbytes, Spkts::DOUBLE AS Spkts, {_NUMBER} AS sport FROM hold WHERE split = 'train' AND NOT purged),
s AS (SELECT """
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS q_{c}" for c in ("dur", "sbytes", "Spkts", "sport"))
    + " FROM t) SELECT record_id, "
    + ", ".join(f"round((({c} - m_{c}) / q_{c})::FLOAT::DOUBLE, 4) AS {c}" for c in ("dur", "sbytes", "Spkts", "sport"))
    + " FROM t, s",
    "onehot_service": f"{_W}{_SESS}, {_HOLD} SELECT record_id, (service IS NULL)::INT AS service___MISSING__, coalesce(service = '-', false)::INT AS service_dash, coalesce(service = 'dns', false)::INT AS service_dns, coalesce(service = 'http', false)::INT AS service_http FROM hold WHERE split = 'train' AND NOT purged",
    "binary_metrics": f"WITH {PREDICTIONS_SQL} SELECT *, {_RATES} FROM (SELECT source_file, {_COUNTS} FROM preds GROUP BY ALL)",
    "roc_auc": f"WITH {PREDICTIONS_SQL}, {_auc('preds', 'source_file')} SELECT * FROM auc",
    "average_precision": f"WITH {PREDICTIONS_SQL}, {_ap('preds', 'source_file')} SELECT * FROM ap",
    "metrics_by_type": f"WITH {PREDICTIONS_SQL} SELECT *, {_RATES} FROM (SELECT attack_type, count(*) FILTER (y_pred = 0) AS fn, count(*) FILTER (y_pred = 1) AS tp FROM preds WHERE y_true = 1 GROUP BY ALL), (SELECT count(*) FILTER (y_pred = 0) AS tn, count(*) FILTER (y_pred = 1) AS fp FROM preds WHERE y_true = 0)",
    "fold_leaderboard": f"WITH {_BOARD} SELECT * FROM board",
    "winner_selection": f"WITH {_BOARD} SELECT algorithm, variant, f1_mean, fpr_mean, features_max FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY f1_mean DESC, fpr_mean, features_max, variant) AS r FROM board) WHERE r = 1",
    "development_vs_test": f"WITH {_BOARD} SELECT algorithm, variant, res.f1 AS test_f1, f1_mean, round(res.f1 - f1_mean, 6) AS difference FROM res JOIN board USING (algorithm, variant) WHERE fold = 0",
    "heuristic_score": f"WITH {_SCEN} SELECT sample_id, prediction, confidence, severity, coalesce(array_to_string(list_filter([CASE WHEN s1 THEN 'syn_ack_ratio' END, CASE WHEN s2 THEN 'high_packet_rate' END, CASE WHEN s3 THEN 'short_duration_burst' END, CASE WHEN s4 THEN 'single_service_focus' END, CASE WHEN s5 THEN 'forward_backward_imbalance' END], lambda x: x IS NOT NULL), '|'), '') AS triggered, correct FROM se",
    "scenario_groups": f"WITH {_SCEN} SELECT traffic_group, count(*) AS n_rows, count(*) FILTER (correct) AS n_correct, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'safe') AS safe FROM se GROUP BY ALL",
    "scenario_summary": f"WITH {_SCEN} SELECT count(*) AS n_rows, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, round(avg(confidence), 6) AS mean_confidence, round(count(*) FILTER (y = p) / count(*)::DOUBLE, 6) AS accuracy FROM se",
    "severity_three_rules": f"WITH {_HIST} SELECT seq, severity_scenario, severity_dashboard, severity_mail FROM sev",
    "severity_counts": f"WITH {_HIST} SELECT "
    + ", ".join(f"count(*) FILTER (severity_dashboard = '{s}') AS {s}" for s in ("critical", "warning", "info", "safe"))
    + ", count(*) FILTER (severity_dashboard <> 'safe') AS active, coalesce(bool_or(lower(prediction) LIKE '%syn flood%'), false) AS syn_flood FROM sev",
    "ranked_history": f"WITH {_HIST} SELECT seq, prediction, confidence, rank FROM rnk ORDER BY rank, timestamp DESC, seq DESC LIMIT 100",
    "newest_history": f"WITH {_HIST} SELECT seq, prediction, model FROM hist WHERE model <> 'model-1' ORDER BY timestamp DESC, seq DESC LIMIT 20",
    "threat_types": f"WITH {_HIST} SELECT prediction, min(seq) AS first_seq, count(*) AS n FROM hist GROUP BY ALL ORDER BY 2 LIMIT 5",
    "most_recent_prediction": f"WITH {_HIST} SELECT prediction, confidence FROM hist ORDER BY timestamp DESC, seq DESC LIMIT 1",
    "decided_history": f"WITH {_HIST} SELECT seq, concat_ws('-', seq::VARCHAR, prediction, prediction, model) AS alert_id, 'resolved' AS status FROM hist WHERE seq % 9 = 0 AND prediction = 'Normal Traffic'",
    "mock_predictions": "SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'Suspicious Traffic' ELSE 'Normal Traffic' END AS prediction, CASE event_id % 3 WHEN 0 THEN 0.97 WHEN 1 THEN 0.82 ELSE 0.42 END::DOUBLE AS confidence FROM events",
    "scenario_template": f"""WITH {_HIST}, e AS (SELECT seq, lower(prediction) LIKE '%syn flood%' AS a, unnest([0, 1]) AS step FROM hist)
SELECT seq, step, CASE WHEN a THEN 23357 ELSE 49152 END::DOUBLE + step AS sport, CASE WHEN a THEN 0.6921604882400858 ELSE 1.2 END::DOUBLE AS dur, CASE WHEN a THEN 500 ELSE 0.02 END::DOUBLE AS tcprtt,
  CASE WHEN a THEN -0.3333333333333333 ELSE 0 END::DOUBLE AS ct_dst_ltm, 0::DOUBLE AS other FROM e""",
    "scenario_ranges": "SELECT * FROM (VALUES ('normal', 2000::BIGINT, 2000::BIGINT, 0::BIGINT, 'safe'), ('syn_flood_low', 2000, 2000, 0, 'warning'), ('syn_flood_medium', 2000, 2000, 0, 'critical'), ('syn_flood_high', 2000, 2000, 0, 'critical')) AS t(traffic_group, n_rows, n_ids, n_outside, expected_severity)",
    "scenario_times": f"WITH {FLOWS_SQL} SELECT record_id, 5 * (row_number() OVER (ORDER BY record_id) - 1)::BIGINT AS seconds FROM flows",
    "record_fingerprint": f"""WITH {FLOWS_SQL}, p AS (SELECT record_id // 10000 AS p, count(*) AS n, sha256(string_agg(record_id::VARCHAR, ',' ORDER BY record_id)) AS d FROM flows GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY p)) AS sha256 FROM p""",
    "scenario_windows": f"""WITH {_HIST}, e AS (SELECT seq, confidence, lower(prediction) LIKE '%syn flood%' AS a, CASE WHEN lower(prediction) LIKE '%medium%' THEN 1.5 WHEN lower(prediction) LIKE '%high%' THEN 2.0 ELSE 1.0 END::DOUBLE AS p, unnest([0, 1, 2]) AS step FROM hist)
SELECT seq, step, 49152::DOUBLE + step AS sport, CASE WHEN a THEN greatest(0.001::DOUBLE, 0.04::DOUBLE / p) ELSE 1.2 END::DOUBLE AS dur, CASE WHEN a THEN 1200 * p ELSE 320 END * (step + 1) / 3::DOUBLE AS sbytes,
  CASE WHEN a THEN 900000 * p ELSE 1200 END * (step + 1) / 3::DOUBLE AS Sload, CASE WHEN a THEN 40 * p ELSE 2 END::DOUBLE AS ct_srv_src, CASE WHEN a THEN confidence * 8 ELSE 0 END::DOUBLE AS sloss, CASE WHEN a THEN 254 ELSE 31 END::DOUBLE AS sttl, 0::DOUBLE AS other FROM e""",
    "labelled_features": f"""{_LAB}, u AS (SELECT DISTINCT source_file, Stime FROM labels),
a AS (SELECT u.source_file, u.Stime, count(f.Ltime) AS completed_flows_600s, coalesce(sum(sbytes + dbytes), 0)::BIGINT AS total_bytes_600s, coalesce(sum(Binary_Label), 0) AS prior
  FROM u LEFT JOIN flows f ON f.source_file = u.source_file AND f.Ltime > u.Stime - 600 AND f.Ltime <= u.Stime GROUP BY ALL)
SELECT source_file, Stime, horizon, future_attack, completed_flows_600s, total_bytes_600s FROM labels JOIN a USING (source_file, Stime) WHERE prior = 0""",
    "window_rows": f"""{_W}{_SESS}, {_BLOCK}, l AS (SELECT block, position, row_number() OVER (PARTITION BY block ORDER BY position) AS r FROM blocked),
e AS (SELECT block, position, row_number() OVER (ORDER BY position) - 1 AS window_id FROM l WHERE r >= 5)
SELECT window_id, (b.position - e.position + 4)::INT AS step, record_id, sbytes FROM e JOIN blocked b ON b.block = e.block AND b.position BETWEEN e.position - 4 AND e.position""",
    "train_nesting": f"""{_W}{_SESS}, {_FOLDS}, t AS (SELECT fold, record_id FROM folds WHERE role = 'train')
SELECT f.fold, (SELECT count(*) FROM t a WHERE a.fold = f.fold - 1 AND a.record_id NOT IN (SELECT record_id FROM t b WHERE b.fold = f.fold)) AS lost, (SELECT count(*) FROM t a WHERE a.fold = f.fold AND a.record_id NOT IN (SELECT record_id FROM t b WHERE b.fold = f.fold - 1)) AS added FROM (SELECT unnest([2, 3])::INT AS fold) f""",
    "disorder": f"""WITH {FLOWS_SQL}, o AS (SELECT *, (record_id * 7919) % 10007 * 1000000 + record_id AS k FROM flows),
l AS (SELECT *, lag(Stime) OVER w AS s, lag(Ltime) OVER w AS e, lag(k) OVER w AS pk FROM o WINDOW w AS (PARTITION BY source_file ORDER BY k))
SELECT source_file, count(*) AS n_rows, count(*) FILTER (Stime < s OR (Stime = s AND Ltime < e)) AS out_of_order, count(*) FILTER (k = pk) AS repeated FROM l GROUP BY ALL""",
    "stream_sliding_measures": f"""WITH {FLOWS_SQL}, w AS (SELECT *, Ltime - Ltime % 300 - unnest([0, 300]) AS start_s FROM flows)
SELECT source_file, start_s, start_s + 600 AS end_s, count(*) AS flows, sum(sbytes + dbytes)::BIGINT AS bytes, sum(Binary_Label)::BIGINT AS attacks
FROM w WHERE start_s + 600 <= (SELECT max(Ltime) FROM flows) - 600 GROUP BY source_file, start_s""",
}
