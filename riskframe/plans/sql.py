"""SQL text of the shared views, for the comparison queries."""

from riskframe.functions.columns import MERCHANTS
from riskframe.sources.transactions import EVENT_TO_TYPE

_TYPE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TO_TYPE.items()) + " END"
_MERCHANT_LIST = "[" + ", ".join(f"'{m}'" for m in MERCHANTS) + "]"

TX = f"""
tx_base AS (
  SELECT event_id AS tx_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) + 1 AS INTEGER) AS step,
         {_TYPE_CASE} AS type,
         round(value * 8, 2) AS amount,
         'C' || CAST(user_id AS VARCHAR) AS nameOrig,
         least(greatest(coalesce(c_acctbal, 0e0), 0e0), 10000e0) AS oldbalanceOrg,
         'M' || CAST(event_id % 10 + 1 AS VARCHAR) AS nameDest,
         least(greatest(coalesce(s_acctbal, 0e0), 0e0), 20000e0) AS oldbalanceDest,
         ({_MERCHANT_LIST})[CAST(event_id % 8 + 1 AS BIGINT)] AS merchant
  FROM events
  LEFT JOIN customer ON c_custkey = user_id
  LEFT JOIN supplier ON s_suppkey = event_id % 10 + 1),
tx_balance AS (
  SELECT *, greatest(oldbalanceOrg - amount, 0e0) AS newbalanceOrg, oldbalanceDest + amount AS newbalanceDest
  FROM tx_base),
tx_risk AS (
  SELECT *,
         least(greatest(0.012e0
           + CASE WHEN type = 'TRANSFER' THEN 0.01e0 ELSE 0e0 END
           + CASE WHEN type = 'CASH_OUT' THEN 0.006e0 ELSE 0e0 END
           + CASE WHEN amount > 1500e0 THEN 0.006e0 ELSE 0e0 END
           + CASE WHEN newbalanceOrg = 0e0 THEN 0.005e0 ELSE 0e0 END, 0e0), 0.25e0) AS risk,
         CAST((tx_id * 7919 + 17) % 10007 AS DOUBLE) / 10007e0 AS u1,
         CAST((tx_id * 104729 + 7) % 10007 AS DOUBLE) / 10007e0 AS u2
  FROM tx_balance),
tx AS (
  SELECT *, CAST(u1 < risk AS INTEGER) AS isFraud, CAST(amount > 200000e0 AS INTEGER) AS isFlaggedFraud
  FROM tx_risk)"""

SCORED = TX + """,
scored AS (
  SELECT tx_id, isFraud AS label, least(1e0, 10e0 * risk + 0.5e0 * u2) AS score FROM tx)"""

SCORED_MODELS = TX + """,
scored_models AS (
  SELECT 'rule' AS model, tx_id, merchant, type, isFraud AS label, least(1e0, 10e0 * risk + 0.5e0 * u2) AS score FROM tx
  UNION ALL SELECT 'noise', tx_id, merchant, type, isFraud, u2 FROM tx
  UNION ALL SELECT 'amount', tx_id, merchant, type, isFraud, least(1e0, amount / 4000e0) FROM tx)"""


def with_views(views: str, body: str) -> str:
    return f"WITH {views.strip()}\n{body.strip()}"


def tx_sql(body: str) -> str:
    """``body`` over the view ``tx``; it may start with further views after a comma."""
    body = body.strip()
    return with_views(TX, body)


def scored_sql(body: str) -> str:
    return with_views(SCORED, body)


def models_sql(body: str) -> str:
    return with_views(SCORED_MODELS, body)


def ratio(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0e0), 0e0)"


def ratios(digits: int = 9) -> str:
    """The four ratios of columns tp, fp, tn, fn, rounded."""
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    f1 = ratio(f"(2e0 * {p} * {r})", f"({p} + {r})")
    return (
        f"round({ratio('tp + tn', 'tp + fp + tn + fn')}, {digits}) AS accuracy, "
        f"round({p}, {digits}) AS precision, round({r}, {digits}) AS recall, round({f1}, {digits}) AS f1"
    )


def counts_at(threshold: str, label: str = "label", score: str = "score") -> str:
    return (
        f"CAST(count(*) FILTER (WHERE {score} >= {threshold} AND {label} = 1) AS BIGINT) AS tp, "
        f"CAST(count(*) FILTER (WHERE {score} >= {threshold} AND {label} = 0) AS BIGINT) AS fp, "
        f"CAST(count(*) FILTER (WHERE {score} < {threshold} AND {label} = 0) AS BIGINT) AS tn, "
        f"CAST(count(*) FILTER (WHERE {score} < {threshold} AND {label} = 1) AS BIGINT) AS fn"
    )


def curve_views(source: str, by: str = "") -> str:
    """Views ``curve`` (running counts per score) and ``points`` (curve coordinates) over ``source``."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
per_score AS (SELECT {b}score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY {b}score),
curve AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS pp,
         sum(pos) OVER ({part}) AS positives, sum(n) OVER ({part}) AS total
  FROM per_score),
points AS (
  SELECT *, {ratio('tp', 'positives')} AS r, {ratio('tp - pos', 'positives')} AS r0,
         {ratio('pp - tp', 'total - positives')} AS f,
         {ratio('(pp - n) - (tp - pos)', 'total - positives')} AS f0,
         {ratio('tp', 'pp')} AS pr,
         CASE WHEN pp = n THEN {ratio('tp', 'pp')} ELSE {ratio('tp - pos', 'pp - n')} END AS pr0
  FROM curve)"""


ROC = (
    "CASE WHEN max(positives) > 0 AND max(positives) < max(total) "
    "THEN sum((f - f0) * (r + r0) / 2e0) END"
)
PR = "coalesce(sum((r - r0) * (pr + pr0) / 2e0), 0e0)"
AP = "coalesce(sum((r - r0) * pr), 0e0)"


SEQ = TX + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY nameOrig ORDER BY step, tx_id) AS rn FROM tx),
codes AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS code FROM (SELECT DISTINCT type FROM tx)),
wins AS (
  SELECT ranked.*, CAST(code AS INTEGER) AS type_idx, CAST((rn - 1) // 20 AS INTEGER) AS win_id,
         CAST((rn - 1) % 20 AS INTEGER) AS pos
  FROM ranked JOIN codes USING (type)),
full_wins AS (SELECT nameOrig, win_id, max(isFraud) AS label FROM wins GROUP BY nameOrig, win_id HAVING count(*) = 20),
seq_rows AS (
  SELECT nameOrig, win_id, pos, type_idx, amount, oldbalanceOrg, newbalanceOrg, label
  FROM wins JOIN full_wins USING (nameOrig, win_id))"""


def seq_sql(body: str) -> str:
    """``body`` over ``seq_rows``: one row per element of every full window of 20."""
    return with_views(SEQ, body)
