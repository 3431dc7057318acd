"""The queries in SQL that DuckDB runs over the same tables."""

from __future__ import annotations

# What masked text holds for each pattern, in order. There is no look-behind here, so
# the character before a path is matched and put back.
MASKS = [
    (r"\b\d{4}[-/.]\d{2}[-/.]\d{2}[ T\-]\d{2}[:.]\d{2}[:.]\d{2}(?:[.,]\d+)?\b", "<TS>"),
    (r"\b\d{6}\s+\d{6}\b", "<TS>"),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", "<DATE>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TIME>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\bblk_-?\d+\b", "<BLK>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}\b", "<IP>:<PORT>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "<IP>"),
    (r"\bhttps?://[^\s\"'>]+", "<URL>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"(^|[^A-Za-z0-9])/(?:[\w\-.]+/)+[\w\-.]*", r"\1<PATH>"),
    (r"\b[A-Za-z]:\\(?:[\w\-. ]+\\)*[\w\-. ]*", "<PATH>"),
    (r"\b\d+\b", "<NUM>"),
]


def _masked(x: str) -> str:
    out = f"regexp_replace({x}, '[\\r\\n]+$', '')"
    for pattern, replacement in MASKS:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{replacement}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _demo(x: str) -> str:
    bias = " + ".join(f"CASE WHEN contains(lower({x}), '{w}') THEN 0.15 ELSE 0 END" for w in ("fatal", "panic", "kerndtlb", "exception"))
    return f"least(1.0::DOUBLE, ('0x' || substr(sha256({x}), 1, 2))::INT / 255.0::DOUBLE + {bias})"


def _hash(ds: str, group: str) -> str:
    return f"(('0x' || substr(sha256({ds} || '::' || {group}), 1, 16))::UBIGINT % 1000000)::BIGINT"


LINES = (
    "lines AS (SELECT lang AS source, doc_id::VARCHAR AS group_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, "
    "chr(10)), 1) - 1)::BIGINT AS line_no FROM documents)"
)
SEQS = (
    "seqs AS (SELECT d.lang AS source, d.doc_id::VARCHAR AS group_id, coalesce(l.toxic, 0) AS label, len(string_split(d.text, chr(10)))::BIGINT AS n_lines "
    "FROM documents d LEFT JOIN labels l USING (doc_id))"
)
PRED = (
    "pred AS (SELECT fold, row_id, y_true, CASE WHEN p_anomaly >= 0.5 THEN 1 ELSE 0 END AS y_pred, p_anomaly FROM (SELECT d.lang AS fold, d.doc_id AS "
    f"row_id, coalesce(l.toxic, 0) AS y_true, {_demo('d.text')} AS p_anomaly FROM documents d LEFT JOIN labels l USING (doc_id)))"
)
SPLIT = f"split AS (SELECT *, CASE WHEN h < 800000 THEN 'train' WHEN h < 900000 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_hash('source', 'group_id')} AS h FROM seqs))"
RANKED = (
    "ranked AS (SELECT *, sum(y_true) OVER w AS tp, row_number() OVER w AS rank, row_number() OVER w - sum(y_true) OVER w AS fp, "
    "sum(y_true) OVER (PARTITION BY fold) AS p, count(*) OVER (PARTITION BY fold) - sum(y_true) OVER (PARTITION BY fold) AS n "
    "FROM pred WINDOW w AS (PARTITION BY fold ORDER BY p_anomaly DESC, row_id ROWS UNBOUNDED PRECEDING))"
)
CONF = (
    "conf AS (SELECT fold, count(*) FILTER (y_true=1 AND y_pred=1) tp, count(*) FILTER (y_true=0 AND y_pred=1) fp, count(*) FILTER (y_true=0 AND y_pred=0) "
    "tn, count(*) FILTER (y_true=1 AND y_pred=0) fn FROM pred GROUP BY fold)"
)
_PROD = "(tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)"
_PREC, _REC = "CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END", "CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END"
THRESH = (
    "thresh AS (SELECT fold, prec AS precision, rec AS recall, CASE WHEN prec+rec>0 THEN 2*prec*rec/(prec+rec) ELSE 0 END AS f1, CASE WHEN fp+tn>0 THEN "
    f"fp::DOUBLE/(fp+tn) ELSE 0 END AS fpr, CASE WHEN {_PROD}=0 THEN 0 ELSE (tp::DOUBLE*tn-fp::DOUBLE*fn)/sqrt({_PROD}) END AS mcc FROM (SELECT *, {_PREC} "
    f"AS prec, {_REC} AS rec FROM conf))"
)
AUC = (
    "auc AS (SELECT fold, CASE WHEN max(p)>0 AND max(n)>0 THEN sum(CASE WHEN y_true=1 THEN below + tied/2.0 ELSE 0 END)/(max(p)::DOUBLE*max(n)) END AS "
    "auc_roc FROM (SELECT *, count(*) FILTER (y_true=0) OVER (PARTITION BY fold ORDER BY p_anomaly RANGE UNBOUNDED PRECEDING) - count(*) FILTER (y_true=0) "
    "OVER (PARTITION BY fold, p_anomaly) AS below, count(*) FILTER (y_true=0) OVER (PARTITION BY fold, p_anomaly) AS tied FROM ranked) GROUP BY fold)"
)
AP = "ap AS (SELECT fold, CASE WHEN max(p)>0 THEN sum(CASE WHEN y_true=1 THEN tp::DOUBLE/rank/p ELSE 0 END) END AS auc_pr FROM ranked GROUP BY fold)"
FAR = (
    "far AS (SELECT f.fold, g.v AS fpr_at_recall FROM (SELECT DISTINCT fold FROM pred) f LEFT JOIN (SELECT fold, arg_min(fp, rank)/max(n)::DOUBLE AS v "
    "FROM ranked WHERE p>0 AND n>0 AND tp::DOUBLE/p >= 0.95 GROUP BY fold) g ON f.fold=g.fold)"
)
PANEL = (
    "panel AS (SELECT t.fold, precision, recall, f1, fpr, mcc, auc_roc, auc_pr, fpr_at_recall AS fpr_at_95_recall FROM thresh t JOIN auc USING (fold) JOIN "
    "ap USING (fold) JOIN far USING (fold))"
)
ALL_METRICS = ", ".join(["WITH " + PRED, RANKED, CONF, THRESH, AUC, AP, FAR, PANEL])
CELLS = "cells AS (SELECT source AS axis, lang AS condition, doc_id % 5 AS seed, 'chars' AS metric, avg(n_chars::DOUBLE) AS value FROM documents GROUP BY 1, 2, 3)"
MARGINS = "z AS (SELECT ln(q / (1 - q)) AS m, y_true AS y FROM (SELECT greatest(1e-7, least(1 - 1e-7, p_anomaly)) AS q, y_true FROM pred))"


def _newton(steps: int, target: str, columns: tuple[str, ...]) -> str:
    """CTEs n0 .. n<steps>: Newton steps, 5 at most in each weight, of a logistic model on one or two columns of z."""
    names = ("a", "b")[: len(columns)]
    out = [f"n0 AS (SELECT {', '.join(f'0.0::DOUBLE AS {n}' for n in names)})"]
    margin = " + ".join(f"{n} * {c}" for n, c in zip(names, columns, strict=True))
    for k in range(steps):
        sums = [f"sum(({target} - p) * {c}) AS g{i}" for i, c in enumerate(columns)] + [f"sum(p * (1 - p) * {columns[i]} * {columns[j]}) AS h{i}{j}" for i in range(len(columns)) for j in range(i, len(columns))]
        step = ["g0 / h00"] if len(columns) == 1 else ["(h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)", "(h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)"]
        moved = ", ".join(f"{n} + greatest(-5, least(5, {x})) AS {n}" for n, x in zip(names, step, strict=True))
        out.append(f"n{k + 1} AS (SELECT {moved} FROM n{k}, (SELECT {', '.join(sums)} FROM (SELECT z.*, 1 / (1 + exp(-({margin}))) AS p FROM z, n{k})))")
    return ", ".join(out)


#: Signed rank tests of cells of a few pairs: every choice of signs is enumerated.
RANK_TESTS = """r AS (SELECT *, row_number() OVER (PARTITION BY axis, condition, metric ORDER BY seed) AS place FROM cells),
diffs AS (SELECT a.axis, a.condition, a.metric, a.value - b.value AS d FROM r a JOIN r b ON a.axis = b.axis AND a.metric = b.metric AND a.place = b.place AND b.condition = 'en' AND a.condition <> 'en'),
sizes AS (SELECT axis, condition, metric, count(*) AS n FROM diffs GROUP BY ALL),
placed AS (SELECT *, rank() OVER (PARTITION BY axis, condition, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY axis, condition, metric, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM diffs WHERE d <> 0),
g AS (SELECT axis, condition, metric, count(*) AS m, sum(rk) AS total, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS plus, list(rk ORDER BY rk) AS rks FROM placed GROUP BY ALL),
signs AS (SELECT axis, condition, metric, plus, list_sum([CASE WHEN (mask >> (j - 1)) & 1 = 1 THEN rks[j] ELSE 0 END for j in range(1, m + 1)]) AS s FROM (SELECT *, unnest(range(0, (1 << m)::BIGINT)) AS mask FROM g)),
shares AS (SELECT axis, condition, metric, avg((s <= plus + 1e-9)::INT) AS le, avg((s >= plus - 1e-9)::INT) AS ge FROM signs GROUP BY ALL),
tests AS (SELECT c.axis, c.condition, c.metric, coalesce(n, 0)::BIGINT AS n, CASE WHEN n > 1 THEN coalesce(least(plus, total - plus), 0) ELSE 0 END::DOUBLE AS statistic,
          CASE WHEN n > 1 THEN coalesce(least(1.0::DOUBLE, 2 * least(le, ge)), 1) ELSE 1 END::DOUBLE AS p
          FROM (SELECT DISTINCT axis, condition, metric FROM cells WHERE condition <> 'en') c LEFT JOIN sizes USING (axis, condition, metric) LEFT JOIN g USING (axis, condition, metric) LEFT JOIN shares USING (axis, condition, metric))"""
SUMMARY = "avg(value) AS mean, CASE WHEN count(value)<=1 THEN 0 ELSE stddev_samp(value) END AS std, min(value) AS min, max(value) AS max, count(value) AS n"
CONFIDENCE = "c AS (SELECT fold, row_id, y_true, greatest(p_anomaly, 1-p_anomaly) AS conf, (CASE WHEN p_anomaly > 1-p_anomaly THEN 1 ELSE 0 END <> y_true)::INT AS wrong FROM pred)"
RISK = (
    "risk AS (SELECT *, row_number() OVER w AS rank, sum(wrong) OVER w AS loss, sum(CASE WHEN wrong=0 THEN 0 WHEN y_true=1 THEN 5 ELSE 1 END) OVER w AS "
    "cost, count(*) OVER (PARTITION BY fold) AS total, sum(wrong) OVER (PARTITION BY fold) AS e FROM c WINDOW w AS (PARTITION BY fold ORDER BY conf DESC, "
    "row_id ROWS UNBOUNDED PRECEDING))"
)


def _tau(rows: str, budget: float) -> str:
    """Smallest threshold within the budget for each fold of rows (fold, conf, wrong)."""
    return (
        f"(SELECT f.fold, coalesce(b.tau, 1.0) AS tau, b.risk, coalesce(b.coverage, 0) AS coverage, b.tau IS NOT NULL AS feasible FROM (SELECT DISTINCT fold FROM {rows}) f LEFT JOIN "
        f"(SELECT fold, min(tau) AS tau, arg_min(errors::DOUBLE/accepted, tau) AS risk, arg_min(accepted::DOUBLE/total, tau) AS coverage FROM "
        f"(SELECT t.fold, t.tau, count(*) FILTER (r.conf >= t.tau) AS accepted, sum(CASE WHEN r.conf >= t.tau THEN r.wrong ELSE 0 END) AS errors, count(*) AS total FROM "
        f"(SELECT DISTINCT fold, conf AS tau FROM {rows} UNION SELECT DISTINCT fold, 0.5 FROM {rows} UNION SELECT DISTINCT fold, 1.0 FROM {rows}) t JOIN {rows} r ON t.fold=r.fold GROUP BY 1, 2) "
        f"WHERE accepted>0 AND errors::DOUBLE/accepted <= {budget} GROUP BY fold) b ON f.fold=b.fold)"
    )


def _windows(total: str, window: int, stride: int) -> str:
    return f"unnest(generate_series(0, CASE WHEN {total} < {window} THEN 0 ELSE ({total}-{window})//{stride} END))"


CHAT = "chat AS (SELECT conv_id::VARCHAR AS group_id, turn, text FROM conversations)"
SETS = "sets AS (SELECT DISTINCT source, substr(sha256(text), 1, 32) AS hash, text FROM lines), multi AS (SELECT hash, count(DISTINCT source) AS k FROM sets GROUP BY hash)"
GRAMS = (
    "grams AS (SELECT source, w[i] || ' ' || w[i+1] AS ngram, count(*) AS cnt FROM (SELECT source, w, unnest(generate_series(1, len(w)-1)) AS i FROM "
    "(SELECT source, regexp_extract_all(text, '[^\\s]+') AS w FROM lines) WHERE len(w) >= 2) GROUP BY 1, 2)"
)
REF = "ev AS (SELECT event_id, ts, event_type AS key, value FROM events)"


def _ks(samples: str, by: str) -> str:
    """KS of samples (by, side, value)."""
    series = "list_sum([2.0*(CASE WHEN j%2=1 THEN 1 ELSE -1 END)*exp(-2.0*lam*lam*j*j) for j in generate_series(1, 100)])"
    cols = ", ".join(f"{b}" for b in by.split(","))
    return (
        f"SELECT {cols}, n_a, n_b, CASE WHEN d<=1e-12 THEN 0 ELSE d END AS d, CASE WHEN d<=1e-12 OR n_a=0 OR n_b=0 THEN 1.0 ELSE greatest(0, least(1, {series})) END AS p FROM "
        f"(SELECT *, (sqrt(n_a::DOUBLE*n_b/(n_a+n_b)) + 0.12 + 0.11/sqrt(greatest(n_a::DOUBLE*n_b,1e-9)/(n_a+n_b)))*d AS lam FROM "
        f"(SELECT {cols}, max(na) AS n_a, max(nb) AS n_b, max(CASE WHEN na>0 AND nb>0 THEN abs(ca::DOUBLE/na - cb::DOUBLE/nb) ELSE 0 END) AS d FROM "
        f"(SELECT {cols}, value, sum(a) OVER (PARTITION BY {cols} ORDER BY value) AS ca, sum(b) OVER (PARTITION BY {cols} ORDER BY value) AS cb, sum(a) OVER (PARTITION BY {cols}) AS na, sum(b) OVER (PARTITION BY {cols}) AS nb FROM "
        f"(SELECT {cols}, value, count(*) FILTER (side='a') AS a, count(*) FILTER (side='b') AS b FROM {samples} GROUP BY {cols}, value)) GROUP BY {cols}))"
    )


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


SQL: dict[str, str] = {
    "mask_lines": f"WITH {LINES} SELECT group_id, line_no, {_masked('text')} AS masked FROM lines",
    "template_counts": f"WITH {LINES} SELECT source, {_masked('text')} AS masked, count(*) AS cnt FROM lines GROUP BY 1, 2",
    "collapse_masks": f"WITH {LINES} SELECT source, regexp_replace({_masked('text')}, '<[A-Z]+>', '<NUM>', 'g') AS collapsed, count(*) AS cnt FROM lines GROUP BY 1, 2",
    "mask_stats": (
        f"WITH {LINES} SELECT source, count(*) AS n_lines, sum(len(regexp_extract_all(m, '<[A-Z]+>')))::BIGINT AS n_masks FROM (SELECT source, "
        f"{_masked('text')} AS m FROM lines) GROUP BY source"
    ),
    "read_numbered_lines": (
        "SELECT 'events' AS system, row_number() OVER (ORDER BY event_id) - 1 AS line_no, concat_ws(' ', CASE WHEN event_type='error' THEN 'E' ELSE '-' END, "
        "event_type, user_id::VARCHAR, props) AS value FROM events"
    ),
    "block_keys": (
        "SELECT 'blk_-' || conv_id AS group_id, turn AS line_no, least(4096, length('on blk_-' || conv_id || ': ' || text || ' blk_7'))::BIGINT AS n_chars "
        "FROM conversations"
    ),
    "label_csv_read": "SELECT d.doc_id::VARCHAR AS group_id, coalesce(l.toxic, 0)::BIGINT AS label FROM documents d LEFT JOIN labels l USING (doc_id)",
    "csv_sink": f"WITH {CELLS} SELECT axis, condition, seed::VARCHAR AS seed, printf('%.3f', value) AS value FROM cells",
    "custom_masks": (
        f"WITH {LINES} SELECT group_id, line_no, lower(trim(regexp_replace(regexp_replace("
        "regexp_replace(regexp_replace(text, '[\\r\\n]+$', ''), '[A-Z][a-z]+', '<NAME>', 'g'), '[0-9]+', '<N>', 'g'), '\\s+', ' ', 'g'))) AS masked FROM lines"
    ),
    "leakage_gate": (
        f"WITH {LINES}, t AS (SELECT DISTINCT source, text FROM lines), s AS (SELECT text FROM t GROUP BY text HAVING count(*) > 1), "
        "g AS (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1) SELECT target, "
        "EXISTS (SELECT 1 FROM t JOIN s USING (text) WHERE t.source = target) OR EXISTS (SELECT 1 FROM documents d JOIN g USING (source) WHERE d.lang = target) AS leaks FROM (SELECT DISTINCT source AS target FROM lines)"
    ),
    "plugin_scorer": f"WITH {LINES} SELECT group_id, round(count(*) FILTER (text = '')::DOUBLE / count(*), 6) AS p_anomaly FROM lines GROUP BY 1",
    "label_prefix_parse": "SELECT event_id AS line_no, (event_type='error')::BIGINT AS label, event_type || ' ' || user_id || ' ' || props AS text FROM events",
    "session_keys": "SELECT conv_id::VARCHAR AS group_id, turn AS line_no, least(4096, length('[instance: ' || conv_id || '] ' || text))::BIGINT AS n_chars FROM conversations",
    "label_csv_join": f"WITH {SEQS} SELECT source, label::BIGINT AS label, count(*) AS n FROM seqs GROUP BY 1, 2",
    "session_sequences": f"WITH {CHAT} SELECT group_id, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM chat GROUP BY 1",
    "session_truncated": (
        f"WITH {CHAT} SELECT group_id, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER "
        "(PARTITION BY group_id ORDER BY turn) AS r FROM chat) WHERE r<=3 GROUP BY 1"
    ),
    "flatten_lengths": (
        f"WITH {CHAT} SELECT group_id, count(*) OVER (PARTITION BY group_id) AS length, row_number() OVER (PARTITION BY group_id ORDER BY turn) - 1 AS pos, "
        "length(text)::BIGINT AS n_chars FROM chat"
    ),
    "sliding_windows": (
        f"WITH t AS (SELECT max(event_id)+1 AS total FROM events), k AS (SELECT {_windows('total', 100, 20)} AS k, total FROM t) SELECT k::BIGINT AS k, "
        "(k*20)::BIGINT AS start, least(total, k*20+100)::BIGINT AS \"end\", count(*) AS n_lines, max((event_type='error')::INT)::BIGINT AS label FROM k JOIN "
        "events ON event_id >= k*20 AND event_id < k*20+100 GROUP BY k, total"
    ),
    "sliding_windows_padded": (
        f"WITH t AS (SELECT max(event_id)+1 AS total FROM events), k AS (SELECT {_windows('total', 96, 36)} AS k, total FROM t), s AS (SELECT k, k*36 AS start, "
        "least(total, k*36+96) AS e FROM k UNION ALL SELECT max(k)+1, max(total)-96, max(total) FROM k HAVING max(k)*36+96 < max(total)) SELECT k::BIGINT AS "
        "k, start::BIGINT AS start, e::BIGINT AS \"end\", count(*) AS n_lines, max((event_type='error')::INT)::BIGINT AS label FROM s JOIN events ON event_id "
        ">= start AND event_id < e GROUP BY 1, 2, 3"
    ),
    "window_specs": (
        f"WITH {LINES}, t AS (SELECT source, count(*) AS total FROM lines GROUP BY 1), k AS (SELECT source, total, {_windows('total', 100, 20)} AS k FROM t) "
        "SELECT source, k::BIGINT AS k, (k*20)::BIGINT AS start, least(total, k*20+100)::BIGINT AS \"end\", source || '_' || k AS group_id FROM k"
    ),
    "window_coverage": (
        "WITH t AS (SELECT max(event_id)+1 AS total FROM events), w AS (SELECT unnest(generate_series(0, (total-36)//96)) * 96 AS s FROM t), c AS (SELECT "
        "event_id, EXISTS (SELECT 1 FROM w WHERE event_id >= s AND event_id < s + 36) AS ok FROM events) SELECT 'events' AS source, count(*) FILTER "
        "(ok)::BIGINT AS covered, count(*) FILTER (NOT ok)::BIGINT AS uncovered FROM c"
    ),
    "dataset_profile": (
        f"WITH {SEQS} SELECT source, count(*) AS n, count(*) FILTER (label=0) AS normal, count(*) FILTER (label=1) AS anomalous, round(avg(label::DOUBLE), 6) "
        "AS anomaly_fraction FROM seqs GROUP BY 1"
    ),
    "sequence_length_profile": f"WITH {SEQS} SELECT source, round(avg(n_lines), 6) AS mean_lines, round(quantile_cont(n_lines, 0.95), 6) AS p95_lines FROM seqs GROUP BY 1",
    "hash_split": f"WITH {SEQS}, {SPLIT} SELECT group_id, split FROM split",
    "split_stats": (
        f"WITH {SEQS}, {SPLIT}, e AS (SELECT * FROM (SELECT DISTINCT source FROM split), (SELECT unnest(['train', 'val', 'test']) AS split)) SELECT e.source, "
        "e.split, count(s.group_id) AS n, coalesce(sum(s.label), 0)::BIGINT AS anomalies, round(CASE WHEN count(s.group_id)>0 THEN "
        "coalesce(sum(s.label),0)::DOUBLE/count(s.group_id) ELSE 0 END, 6) AS anomaly_fraction FROM e LEFT JOIN split s ON e.source=s.source AND "
        "e.split=s.split GROUP BY 1, 2"
    ),
    "split_manifest": f"WITH {SEQS}, {SPLIT} SELECT DISTINCT source, group_id, split FROM split",
    "chrono_split": (
        "WITH t AS (SELECT max(event_id)+1 AS total FROM events) SELECT CASE WHEN event_id::DOUBLE/total < 0.8::DOUBLE THEN 'train' WHEN "
        "event_id::DOUBLE/total < 0.8::DOUBLE+0.1::DOUBLE THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(event_id) AS first, max(event_id) AS last "
        "FROM events, t GROUP BY 1"
    ),
    "loso_folds": (
        "SELECT a.lang AS target, b.lang AS source, CASE WHEN a.lang=b.lang THEN 'test' ELSE 'train' END AS role FROM (SELECT DISTINCT lang FROM documents) a, "
        "(SELECT DISTINCT lang FROM documents) b"
    ),
    "loso_compose": (
        f"WITH {SEQS}, {SPLIT}, f AS (SELECT a.source AS target, s.*, CASE WHEN a.source=s.source THEN 'test' ELSE 'train' END AS role FROM (SELECT DISTINCT "
        "source FROM split) a, split s) SELECT target, role, count(*) AS n, sum(label)::BIGINT AS anomalies, 'whole' AS mode FROM f GROUP BY 1, 2 UNION ALL "
        "SELECT target, role, count(*), sum(label)::BIGINT, 'splits' FROM f WHERE (role='test' AND split='test') OR (role='train' AND split<>'test') GROUP BY "
        "1, 2"
    ),
    "strip_labels": f"WITH {SEQS} SELECT source, sum(CASE WHEN source='en' THEN 0 ELSE label END)::BIGINT AS anomalies FROM seqs GROUP BY 1",
    "class_weights": (
        f"WITH {SEQS}, n AS (SELECT source, count(*) AS n, count(*) FILTER (label=0) AS n0, count(*) FILTER (label=1) AS n1 FROM seqs GROUP BY 1) SELECT "
        "source, round(CASE WHEN n0>0 THEN least(10.0::DOUBLE, n::DOUBLE/(2*n0)) ELSE 10 END, 6) AS weight_0, round(CASE WHEN n1>0 THEN least(10.0::DOUBLE, "
        "n::DOUBLE/(2*n1)) ELSE 10 END, 6) AS weight_1 FROM n"
    ),
    "majority_baseline": (
        f"WITH {PRED}, t AS (SELECT fold, count(*) AS n, sum(y_true) AS pos FROM pred GROUP BY 1), m AS (SELECT a.fold, CASE WHEN 2*sum(b.pos) > sum(b.n) THEN "
        "1 ELSE 0 END AS y FROM t a JOIN t b ON a.fold<>b.fold GROUP BY 1) SELECT fold, count(*) FILTER (y_true=1 AND y=1) AS tp, count(*) FILTER (y_true=0 "
        "AND y=1) AS fp, count(*) FILTER (y_true=0 AND y=0) AS tn, count(*) FILTER (y_true=1 AND y=0) AS fn FROM pred JOIN m USING (fold) GROUP BY 1"
    ),
    "fraction_sample": (
        f"WITH {SEQS} SELECT source, group_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || group_id), group_id) AS r, "
        "count(*) OVER (PARTITION BY source) AS n FROM seqs) WHERE r <= greatest(1, round(n*0.05::DOUBLE))"
    ),
    "stratified_split": (
        f"WITH {PRED} SELECT row_id, CASE WHEN r <= greatest(1, round(n*0.5::DOUBLE)) THEN 'calibration' ELSE 'held_out' END AS part FROM (SELECT *, "
        "row_number() OVER (PARTITION BY fold, y_true ORDER BY sha256('42:' || row_id), row_id) AS r, count(*) OVER (PARTITION BY fold, y_true) AS n FROM pred)"
    ),
    "leakage_audit": (
        f"WITH {LINES}, {SETS}, g AS (SELECT DISTINCT source AS group_id, lang AS target FROM documents), gm AS (SELECT group_id, count(*) AS k FROM g GROUP BY "
        "1), gs AS (SELECT target, count(*) FILTER (k>1) AS shared_groups FROM g JOIN gm USING (group_id) GROUP BY 1), c AS (SELECT source AS target, count(*) "
        "AS n FROM lines GROUP BY 1), s AS (SELECT source AS target, count(*) AS test_unique, count(*) FILTER (k>1) AS shared_lines, count(*) FILTER (k=1) AS "
        "alone FROM (SELECT DISTINCT source, hash FROM sets) JOIN multi USING (hash) GROUP BY 1) SELECT c.target, (SELECT count(*) FROM lines)-n AS "
        "train_lines, n AS test_lines, (SELECT count(*) FROM multi)-alone AS train_unique, test_unique, shared_lines, shared_groups, shared_lines=0 AND "
        "shared_groups=0 AS clean FROM c JOIN s USING (target) JOIN gs USING (target)"
    ),
    "leakage_samples": (
        f"WITH {LINES}, {SETS} SELECT target, hash, text FROM (SELECT source AS target, hash, text, row_number() OVER (PARTITION BY source ORDER BY hash) AS r "
        "FROM sets JOIN multi USING (hash) WHERE k>1) WHERE r<=16"
    ),
    "line_intersection": f"WITH {LINES}, {SETS} SELECT x.source AS a, y.source AS b, count(*) AS n FROM sets x JOIN sets y ON x.hash=y.hash AND x.source<y.source GROUP BY 1, 2",
    "ngram_counts": f"WITH {LINES}, {GRAMS} SELECT source, ngram, cnt FROM grams",
    "ood_distance_matrix": (
        f"WITH {LINES}, {GRAMS}, t AS (SELECT source, count(*) AS types, sum(cnt::DOUBLE*cnt) AS sq FROM grams GROUP BY 1), d AS (SELECT x.source AS a, "
        "y.source AS b, count(*) AS shared, sum(x.cnt::DOUBLE*y.cnt) AS dot FROM grams x JOIN grams y ON x.ngram=y.ngram AND x.source<>y.source GROUP BY 1, 2) "
        "SELECT p.source AS a, q.source AS b, coalesce(shared, 0) AS shared, round(1 - coalesce(shared,0)::DOUBLE/(p.types+q.types-coalesce(shared,0)), 6) AS "
        "jaccard, round(1 - greatest(-1, least(1, coalesce(dot,0)/(sqrt(p.sq)*sqrt(q.sq)))), 6) AS cosine FROM t p JOIN t q ON p.source<>q.source LEFT JOIN d "
        "ON d.a=p.source AND d.b=q.source"
    ),
    "demo_scores": f"WITH {PRED} SELECT row_id, round(p_anomaly, 6) AS p_anomaly FROM pred",
    "validate_requests": (
        "WITH r AS (SELECT doc_id//40 AS request_id, (doc_id%39)::VARCHAR AS id, string_split(text, chr(10)) AS lines FROM documents), v AS (SELECT *, "
        "count(*) OVER (PARTITION BY request_id) AS k, sum(len(lines)) OVER (PARTITION BY request_id) AS total, count(*) OVER (PARTITION BY request_id, id) AS "
        "same FROM r) SELECT request_id, id, CASE WHEN length(id)<1 OR length(id)>128 THEN 'id length' WHEN len(lines)<1 OR len(lines)>256 THEN 'line count' "
        "WHEN list_max([octet_length(encode(x)) for x in lines]) > 4096 THEN 'line bytes' WHEN k>64 THEN 'sequence count' WHEN total>4096 THEN 'total lines' "
        "WHEN same>1 THEN 'duplicate id' END AS reason FROM v"
    ),
    "score_job": (
        "WITH r AS (SELECT doc_id//40 AS request_id, (doc_id%39)::VARCHAR AS id, doc_id, text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, "
        f"chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT doc_id, string_agg({_masked('line')}, "
        "chr(10) ORDER BY i) AS masked, count(*) AS n, max(octet_length(encode(line))) AS longest FROM l GROUP BY 1), v AS (SELECT *, count(*) OVER (PARTITION "
        "BY request_id) AS k, sum(n) OVER (PARTITION BY request_id) AS total, count(*) OVER (PARTITION BY request_id, id) AS same FROM r JOIN m USING "
        f"(doc_id)), q AS (SELECT request_id, id, {_demo('masked')} AS p FROM v WHERE n<=256 AND longest<=4096 AND k<=64 AND total<=4096 AND same=1) SELECT "
        "request_id, id, round(p, 6) AS p_anomaly, round(greatest(p, 1-p), 6) AS confidence, CASE WHEN greatest(p, 1-p) < 0.7::DOUBLE THEN 'abstain' WHEN p >= "
        "0.5 THEN 'anomaly' ELSE 'normal' END AS decision, CASE WHEN greatest(p, 1-p) < 0.7::DOUBLE THEN printf('confidence=%.4f < tau=0.7000', greatest(p, "
        "1-p)) END AS reason FROM q"
    ),
    "selective_decision": (
        f"WITH {PRED} SELECT row_id, CASE WHEN greatest(p_anomaly, 1-p_anomaly) < 0.7::DOUBLE THEN 'abstain' WHEN p_anomaly > 1-p_anomaly THEN 'anomaly' ELSE "
        "'normal' END AS decision FROM pred"
    ),
    "serving_decision": (
        f"WITH {PRED}, q AS (SELECT *, greatest(p_anomaly, 1-p_anomaly) AS c FROM pred) SELECT row_id, CASE WHEN c < 0.7::DOUBLE THEN 'abstain' WHEN p_anomaly "
        ">= 0.5 THEN 'anomaly' ELSE 'normal' END AS decision, CASE WHEN c < 0.7::DOUBLE THEN printf('confidence=%.4f < tau=0.7000', c) END AS reason FROM q"
    ),
    "confusion_counts": f"WITH {PRED}, {CONF} SELECT * FROM conf",
    "threshold_metrics": f"WITH {PRED}, {CONF}, {THRESH} SELECT fold, {_r('precision', 'recall', 'f1', 'fpr', 'mcc')} FROM thresh",
    "confusion_matrix": (
        f"WITH {PRED} SELECT fold, y_true::BIGINT AS y_true, round(avg((y_pred=0)::INT), 6) AS share_0, round(avg((y_pred=1)::INT), 6) AS share_1 FROM pred "
        "GROUP BY 1, 2"
    ),
    "auc_roc": f"WITH {PRED}, {RANKED}, {AUC} SELECT fold, {_r('auc_roc')} FROM auc",
    "auc_pr": f"WITH {PRED}, {RANKED}, {AP} SELECT fold, {_r('auc_pr')} FROM ap",
    "fpr_at_recall": f"WITH {PRED}, {RANKED}, {FAR} SELECT fold, {_r('fpr_at_recall')} FROM far",
    "metric_panel": f"{ALL_METRICS} SELECT fold, {_r('precision', 'recall', 'f1', 'fpr', 'mcc', 'auc_roc', 'auc_pr', 'fpr_at_95_recall')} FROM panel",
    "macro_metrics": f"{ALL_METRICS}, u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM panel" for m in ("precision", "recall", "f1", "fpr", "mcc", "auc_roc", "auc_pr", "fpr_at_95_recall")) + f"), s AS (SELECT metric, {SUMMARY} FROM u GROUP BY 1) SELECT metric, {_r('mean', 'std', 'min', 'max')}, n FROM s",
    "seed_aggregates": (
        f"WITH {CELLS}, s AS (SELECT condition, metric, {SUMMARY} FROM cells GROUP BY 1, 2) SELECT condition, metric, {_r('mean', 'std', 'min', 'max')}, n, "
        "printf('%.2f ± %.2f', 100*(mean/10000.0::DOUBLE), 100*(std/10000.0::DOUBLE)) AS headline FROM s"
    ),
    "roc_curve": (
        f"WITH {PRED}, {RANKED} SELECT fold, rank, round(p_anomaly, 6) AS threshold, round(fp/n::DOUBLE, 6) AS fpr, round(tp/p::DOUBLE, 6) AS tpr FROM ranked "
        "WHERE p>0 AND n>0"
    ),
    "pr_curve": (
        f"WITH {PRED}, {RANKED} SELECT fold, rank, round(p_anomaly, 6) AS threshold, round(tp/p::DOUBLE, 6) AS recall, round(tp/rank::DOUBLE, 6) AS precision "
        "FROM ranked WHERE p>0"
    ),
    "curve_areas": (
        f"WITH {PRED}, {RANKED} SELECT fold, round(sum(CASE WHEN y_true=0 THEN tp/(p::DOUBLE*n) ELSE 0 END), 6) AS roc_area, round(sum(CASE WHEN y_true=1 THEN "
        "tp::DOUBLE/rank/p ELSE 0 END), 6) AS pr_area FROM ranked GROUP BY 1"
    ),
    "logits_softmax": (
        f"WITH {PRED}, q AS (SELECT row_id, greatest(1e-7, least(1-1e-7, p_anomaly)) AS q FROM pred) SELECT row_id, round(ln(q/(1-q)), 6) AS z1, round(q, 6) AS "
        "p1 FROM q"
    ),
    "reliability_bins": (
        f"WITH {PRED}, {CONFIDENCE}, i AS (SELECT unnest(generate_series(0, 14)) AS i), b AS (SELECT fold, i, i/15.0::DOUBLE AS lo, (i+1)/15.0::DOUBLE AS hi "
        "FROM (SELECT DISTINCT fold FROM c), i) SELECT b.fold, i::BIGINT AS bin, round(lo, 6) AS lower, round(hi, 6) AS upper, count(c.row_id) AS n, "
        "round(avg(conf), 6) AS mean_conf, round(avg(1-wrong), 6) AS accuracy FROM b LEFT JOIN c ON b.fold=c.fold AND conf >= lo AND (conf < hi OR i=14) GROUP "
        "BY 1, 2, 3, 4"
    ),
    "ece_mce": (
        f"WITH {PRED}, {CONFIDENCE}, g AS (SELECT fold, least(14, floor(conf*15)) AS b, count(*) AS n, abs(avg(conf)-avg(1-wrong)) AS gap FROM c GROUP BY 1, "
        f"2), s AS (SELECT fold, sum(n*gap)/sum(n) AS ece, max(gap) AS mce FROM g GROUP BY 1) SELECT fold, {_r('ece', 'mce')}, ece <= 0.05 AS calibrated FROM s"
    ),
    "apply_temperature": (
        f"WITH {PRED}, q AS (SELECT row_id, greatest(1e-7, least(1-1e-7, p_anomaly)) AS q FROM pred) SELECT row_id, round(1/(1+exp(-ln(q/(1-q))/2.5::DOUBLE)), "
        "6) AS p1 FROM q"
    ),
    "apply_platt": (
        f"WITH {PRED}, q AS (SELECT row_id, greatest(1e-7, least(1-1e-7, p_anomaly)) AS q FROM pred) SELECT row_id, round(1/(1+exp(-(0.7::DOUBLE*ln(q/(1-q)) - "
        "0.2::DOUBLE))), 6) AS p1 FROM q"
    ),
    "aurc": (
        f"WITH {PRED}, {CONFIDENCE}, {RISK}, best AS (SELECT fold, sum(CASE WHEN rank > total-e THEN (rank-(total-e))::DOUBLE/rank ELSE 0 END)/max(total) AS "
        "optimal FROM risk GROUP BY 1), m AS (SELECT fold, avg(loss::DOUBLE/rank) AS aurc, avg(cost::DOUBLE/rank) AS cost_aurc FROM risk GROUP BY 1) SELECT "
        "fold, round(aurc, 6) AS aurc, round(optimal, 6) AS optimal, round(aurc-optimal, 6) AS excess, round(cost_aurc, 6) AS cost_aurc FROM m JOIN best USING "
        "(fold)"
    ),
    "risk_coverage": f"WITH {PRED}, {CONFIDENCE}, {RISK} SELECT fold, rank, round(rank::DOUBLE/total, 6) AS coverage, round(loss::DOUBLE/rank, 6) AS risk FROM risk",
    "tau_for_budget": f"WITH {PRED}, {CONFIDENCE} SELECT fold, {_r('tau', 'risk', 'coverage')}, feasible FROM {_tau('c', 0.45)}",
    "coverage_at_risk": (
        f"WITH {PRED}, {CONFIDENCE}, {RISK} SELECT fold, round(coalesce(max(CASE WHEN loss::DOUBLE/rank <= 0.45::DOUBLE THEN rank::DOUBLE/total END), 0), 6) AS "
        "coverage FROM risk GROUP BY 1"
    ),
    "tau_shift": (
        f"WITH {PRED}, {CONFIDENCE}, src AS (SELECT 'fr' AS fold, conf, wrong FROM c WHERE fold<>'fr'), own AS (SELECT fold, conf, wrong FROM c WHERE "
        "fold='fr'), small AS (SELECT fold, conf, wrong FROM c WHERE fold='fr' AND row_id%20=0), t AS (SELECT 'source' AS setting, tau FROM "
        f"{_tau('src', 0.45)} UNION ALL SELECT 'target_small', tau FROM {_tau('small', 0.45)} UNION ALL SELECT 'target_full', tau FROM {_tau('own', 0.45)}) "
        "SELECT setting, round(tau, 6) AS tau, round(sum(CASE WHEN conf>=tau THEN wrong END)::DOUBLE/nullif(count(*) FILTER (conf>=tau), 0), 6) AS risk, "
        "round(count(*) FILTER (conf>=tau)::DOUBLE/count(*), 6) AS coverage FROM t, own GROUP BY setting, tau"
    ),
    "cell_summary": (
        f"WITH {CELLS}, s AS (SELECT axis, condition, metric, {SUMMARY} FROM cells GROUP BY 1, 2, 3) SELECT axis, condition, metric, "
        f"{_r('mean', 'std', 'min', 'max')}, n FROM s"
    ),
    "paired_compare": (
        f"WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY axis, condition, metric ORDER BY seed) AS place FROM cells) SELECT a.axis, a.condition, "
        "a.metric, count(*) AS n, round(avg(a.value-b.value), 6) AS delta_mean FROM r a JOIN r b ON a.axis=b.axis AND a.metric=b.metric AND a.place=b.place "
        "AND b.condition='en' AND a.condition<>'en' GROUP BY 1, 2, 3"
    ),
    "cliffs_delta": (
        f"WITH {CELLS}, s AS (SELECT a.axis, a.condition, a.metric, sum(CASE WHEN a.value>b.value THEN 1 WHEN a.value<b.value THEN -1 ELSE 0 "
        "END)::DOUBLE/count(*) AS delta FROM cells a JOIN cells b ON a.axis=b.axis AND a.metric=b.metric AND b.condition='en' AND a.condition<>'en' GROUP BY "
        "1, 2, 3) SELECT axis, condition, metric, round(delta, 6) AS delta, CASE WHEN abs(delta)<0.147 THEN 'negligible' WHEN abs(delta)<0.33 THEN 'small' "
        "WHEN abs(delta)<0.474 THEN 'medium' ELSE 'large' END AS band FROM s"
    ),
    "fit_temperature": (
        f"WITH {PRED}, {MARGINS}, {_newton(12, 'y', ('m',))}, t AS (SELECT CASE WHEN a > 1e-3 THEN least(1e3, greatest(1e-3, 1 / a)) ELSE 1e3 END::DOUBLE AS t FROM n12), "
        "e AS (SELECT t, avg(ln(1 + exp(-s))) AS before, avg(ln(1 + exp(-s / t))) AS after FROM (SELECT CASE WHEN y = 1 THEN m ELSE -m END AS s FROM z), t GROUP BY t) "
        "SELECT round(t, 5) AS temperature, round(before, 5) AS nll_before, round(least(before, after), 5) AS nll_after FROM e"
    ),
    "fit_platt": (
        f"WITH {PRED}, zz AS (SELECT ln(q / (1 - q)) AS m, y_true AS y FROM (SELECT greatest(1e-7, least(1 - 1e-7, p_anomaly)) AS q, y_true FROM pred)), "
        "c AS (SELECT sum(y) AS pos, sum(1 - y) AS neg FROM zz), z AS (SELECT m, 1.0::DOUBLE AS one, CASE WHEN y = 1 THEN (pos + 1)::DOUBLE / (pos + 2) ELSE 1::DOUBLE / (neg + 2) END AS t FROM zz, c), "
        f"{_newton(12, 't', ('m', 'one'))} SELECT round(a, 5) AS a, round(b, 5) AS b FROM n12"
    ),
    "leakage_group_samples": (
        "WITH g AS (SELECT DISTINCT lang AS target, source AS group_id FROM documents WHERE source IS NOT NULL), m AS (SELECT group_id FROM g GROUP BY 1 HAVING count(*) > 1) "
        "SELECT target, group_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY group_id) AS r FROM g JOIN m USING (group_id)) WHERE r <= 16"
    ),
    "signed_rank": f"WITH {CELLS}, {RANK_TESTS} SELECT axis, condition, metric, n, round(statistic, 6) AS statistic, round(p, 6) AS p FROM tests",
    "joint_significance": (
        f"WITH {CELLS}, {RANK_TESTS}, k AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY p, condition) - 1 AS k, count(*) OVER (PARTITION BY axis) AS m FROM tests), "
        "h AS (SELECT axis, condition, metric, n, statistic, p, max(least(1.0::DOUBLE, p * (m - k))) OVER w AS adjusted, min((p < 0.05::DOUBLE / (m - k))::INT) OVER w = 1 AS rejected "
        "FROM k WINDOW w AS (PARTITION BY axis ORDER BY p, condition ROWS UNBOUNDED PRECEDING)), "
        "s AS (SELECT a.axis, a.condition, a.metric, sum(CASE WHEN a.value > b.value THEN 1 WHEN a.value < b.value THEN -1 ELSE 0 END)::DOUBLE / count(*) AS delta "
        "FROM cells a JOIN cells b ON a.axis = b.axis AND a.metric = b.metric AND b.condition = 'en' AND a.condition <> 'en' GROUP BY 1, 2, 3), "
        "j AS (SELECT h.*, coalesce(delta, 0)::DOUBLE AS delta FROM h LEFT JOIN s USING (axis, condition, metric)) "
        "SELECT axis, condition, metric, n, round(statistic, 6) AS statistic, round(p, 6) AS p, round(adjusted, 6) AS adjusted, rejected, round(delta, 6) AS delta, "
        "CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS band, "
        "rejected AND abs(delta) > 0.33 AS significant FROM j"
    ),
    "manifest_document": f"WITH {SEQS}, {SPLIT} SELECT DISTINCT group_id, split FROM split",
    "sketch_folds": (
        f"WITH {LINES}, t AS (SELECT DISTINCT source AS target FROM lines), f AS (SELECT target, role FROM t, (SELECT unnest(['test', 'train']) AS role)) "
        "SELECT target, role, (SELECT count(*) FROM documents d WHERE (d.lang = target) = (role = 'test')) AS n, "
        "(SELECT count(DISTINCT text) FROM lines l WHERE (l.source = target) = (role = 'test')) AS texts, TRUE AS texts_near, TRUE AS quantile_near FROM f"
    ),
    "holm": (
        f"WITH {PRED}, t AS (SELECT fold, d.source AS unit, min(p_anomaly) AS p FROM pred JOIN documents d ON d.doc_id=row_id GROUP BY 1, 2), k AS (SELECT *, "
        "row_number() OVER (PARTITION BY fold ORDER BY p, unit) - 1 AS k, count(*) OVER (PARTITION BY fold) AS m FROM t) SELECT fold, unit, round(p, 6) AS p, "
        "round(max(least(1.0::DOUBLE, p*(m-k))) OVER w, 6) AS adjusted, min((p < 0.05::DOUBLE/(m-k))::INT) OVER w = 1 AS rejected FROM k WINDOW w AS "
        "(PARTITION BY fold ORDER BY p, unit ROWS UNBOUNDED PRECEDING)"
    ),
    "ablation_matrix": (
        f"WITH {CELLS}, s AS (SELECT axis, condition, metric, {SUMMARY} FROM cells GROUP BY 1, 2, 3) SELECT s.axis, s.condition, s.metric, round(s.mean, 6) AS "
        "mean, round(s.std, 6) AS std, s.n, s.condition='en' AS baseline, round(s.mean-b.mean, 6) AS delta FROM s LEFT JOIN s b ON s.axis=b.axis AND "
        "s.metric=b.metric AND b.condition='en'"
    ),
    "head_to_head": (
        f"{ALL_METRICS}, b AS (SELECT max(recall) AS r, min(precision) AS p FROM panel), "
        "m AS (SELECT 'scorer' AS method, fold, f1 AS v, avg(f1) OVER () AS macro FROM panel "
        "UNION ALL SELECT 'highest recall', 'de', r, p FROM b UNION ALL SELECT 'highest recall', 'es', NULL, p FROM b "
        "UNION ALL SELECT 'macro only', NULL, NULL, 0.8::DOUBLE UNION ALL SELECT 'folds only', 'en', 0.25::DOUBLE, NULL) SELECT method, "
        + ", ".join(f"coalesce(printf('%.2f', 100*max(CASE WHEN fold='{f}' THEN v END)), '—') AS {f}" for f in ("de", "en", "es", "fr"))
        + ", coalesce(printf('%.2f', 100*max(macro)), '—') AS macro FROM m GROUP BY 1"
    ),
    "loss_tail": (
        "WITH s AS (SELECT lang, doc_id//50 AS step, avg(n_chars::DOUBLE) AS value FROM documents GROUP BY 1, 2), w AS (SELECT *, count(*) OVER (PARTITION BY "
        "lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY step DESC) AS r, lag(value) OVER (PARTITION BY lang ORDER BY step) AS prev FROM s) SELECT "
        "lang, count(*) AS n, min((r >= greatest(2, ceil(n*0.1::DOUBLE)) OR prev IS NULL OR value <= prev+1e-9)::INT)=1 AS falling FROM w GROUP BY 1"
    ),
    "ks_two_sample": (
        f"WITH {REF}, s AS (SELECT key, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'b' ELSE 'a' END AS side, value FROM ev), k AS ({_ks('s', 'key')}) SELECT "
        "key, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, round(d, 6) AS d, round(p, 6) AS p FROM k"
    ),
    "stream_drift": (
        f"WITH {REF}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r, "
        "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN row_number() OVER (PARTITION BY key, ts < TIMESTAMP '2024-01-11' ORDER BY ts DESC, event_id DESC) END AS q FROM ev), "
        "s AS (SELECT key, 'a' AS side, value FROM l WHERE r <= 1024 UNION ALL SELECT key, 'b', value FROM l WHERE q <= 1024), "
        f"k AS ({_ks('s', 'key')}) SELECT key, n_a::BIGINT AS n, {_r('d', 'p')}, d>0.1 AND p<0.05 AND n_a>8 AS drift FROM k"
    ),
    "drift_report": (
        f"WITH {REF}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r<=1024), s AS "
        f"(SELECT key, 'a' AS side, value FROM l UNION ALL SELECT key, 'b', value FROM ev WHERE ts < TIMESTAMP '2024-01-11'), k AS ({_ks('s', 'key')}), f AS "
        "(SELECT key, min(value) AS minimum, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, "
        f"max(value) AS maximum, avg(value) AS mean FROM l GROUP BY 1) SELECT key, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, {_r('d', 'p')}, d>0.1 AND p<0.05 AND "
        f"n_a>8 AS drift, {_r('minimum', 'q1', 'median', 'q3', 'maximum', 'mean')} FROM k JOIN f USING (key)"
    ),
    "drift_windows": (
        f"WITH {REF}, a AS (SELECT key, strftime(ts, '%Y-%m-%d') AS window_start, value FROM ev), s AS (SELECT key, window_start, 'a' AS side, value FROM a "
        "UNION ALL SELECT i.key, i.window_start, 'b', e.value FROM (SELECT DISTINCT key, window_start FROM a) i JOIN ev e ON e.key=i.key AND e.ts < TIMESTAMP "
        f"'2024-01-11'), k AS ({_ks('s', 'key,window_start')}) SELECT key, window_start, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, {_r('d', 'p')}, d>0.1 AND "
        "p<0.05 AND n_a>8 AS drift FROM k"
    ),
    "five_number_summary": (
        f"WITH {REF}, f AS (SELECT key, count(*) AS n, min(value) AS minimum, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
        "quantile_cont(value, 0.75) AS q3, max(value) AS maximum, avg(value) AS mean FROM ev GROUP BY 1) SELECT key, n, "
        f"{_r('minimum', 'q1', 'median', 'q3', 'maximum', 'mean')} FROM f"
    ),
    "stream_mask": f"SELECT conv_id, turn, {_masked('text')} AS masked FROM conversations",
    "checksum_verify": (
        "SELECT t || '.parquet' AS name, CASE WHEN t < 'l' THEN 'ok' WHEN t < 'o' THEN 'mismatch' ELSE 'new' END AS status "
        "FROM (SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS t) "
        "UNION ALL SELECT 'gone.parquet', 'missing'"
    ),
    "file_digests": (
        "SELECT conv_id // 100 AS part, sha256(string_agg(text || chr(10), '' ORDER BY conv_id, turn)) AS sha256, sum(strlen(text) + 1)::BIGINT AS bytes "
        "FROM conversations GROUP BY 1"
    ),
    "predictions_quarantine": (
        f"WITH {PRED} SELECT CASE row_id % 10 WHEN 3 THEN 'not a record' WHEN 4 THEN 'no y_true' ELSE 'read' END AS reason, count(*) AS n, "
        "sum(CASE WHEN row_id % 10 IN (3, 4) THEN 0 ELSE y_true END)::BIGINT AS positives FROM pred GROUP BY 1"
    ),
    "window_texts": (
        f"WITH t AS (SELECT max(event_id)+1 AS total FROM events), k AS (SELECT {_windows('total', 96, 36)} AS k, total FROM t), "
        "s AS (SELECT k, k*36 AS start, least(total, k*36+96) AS e FROM k UNION ALL SELECT max(k)+1, max(total)-96, max(total) FROM k HAVING max(k)*36+96 < max(total)) "
        "SELECT 'events_' || k AS group_id, count(*) AS n_lines, sha256(string_agg(event_type || ' ' || props, chr(10) ORDER BY event_id)) AS digest, "
        "max((event_type='error')::INT)::BIGINT AS label FROM s JOIN events ON event_id >= start AND event_id < e GROUP BY k"
    ),
    "stream_session_lines": (
        "WITH e AS (SELECT user_id AS key, ts, event_id, event_type || ' ' || props AS text, (event_type='error')::INT AS label, "
        "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), "
        "g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e) "
        "SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_lines, max(label)::BIGINT AS label, "
        "sha256(array_to_string(list(text ORDER BY ts, event_id)[1:50], chr(10))) AS digest FROM g GROUP BY key, g"
    ),
    "stream_sessions": (
        "WITH e AS (SELECT user_id AS key, ts, (event_type='error')::INT AS label, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 "
        "HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT "
        "key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_lines, max(label)::BIGINT AS label FROM g GROUP BY key, g"
    ),
    "stream_windows": (
        "WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR * k AS start, (event_type='error')::INT AS label FROM events, (SELECT unnest([0, "
        "1]) AS k)) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_lines, max(label)::BIGINT AS label FROM w GROUP BY 1"
    ),
    "stream_score": (
        f"WITH m AS (SELECT conv_id, turn, {_masked('text')} AS masked FROM conversations), q AS (SELECT conv_id, turn, {_demo('masked')} AS p FROM m) SELECT "
        "conv_id, turn, round(p, 6) AS p_anomaly, round(greatest(p, 1-p), 6) AS confidence, CASE WHEN greatest(p, 1-p) < 0.7::DOUBLE THEN 'abstain' WHEN p >= "
        "0.5 THEN 'anomaly' ELSE 'normal' END AS decision FROM q"
    ),
    "predictions_roundtrip": f"WITH {PRED} SELECT fold, row_id::VARCHAR AS group_id, y_true::BIGINT AS y_true, y_pred::BIGINT AS y_pred, round(p_anomaly, 6) AS p_anomaly FROM pred",
    "run_grid": f"WITH {CELLS} SELECT axis, condition, seed, value/1000.0::DOUBLE AS score FROM cells",
}
SQL["report_sink"] = SQL["split_stats"]
