"""DuckDB SQL for the catalog queries.

Everything is computed from true values: keys, dates, prices and segments.  The messy text is
only ever produced (for the change log), never read.
"""

from ledgerspark.schema import KEYWORDS

BASE = """
WITH t AS (
  SELECT o_orderkey AS k, n.copy, o_orderkey * 10 + n.copy AS ord, c_mktsegment AS seg,
         CAST(o_custkey % 40 AS BIGINT) AS v, CAST(o_orderdate AS DATE) AS dt,
         CAST(round(o_totalprice * 100) AS BIGINT)
           * CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE 1 END AS true_cents
  FROM orders JOIN customer ON o_custkey = c_custkey
  CROSS JOIN (VALUES (0), (1), (2)) n(copy)
  WHERE n.copy = 0 OR (n.copy = 1 AND o_orderkey % 41 = 0) OR (n.copy = 2 AND o_orderkey % 67 = 0)
), named AS (
  SELECT *, seg || ' vendor ' || v AS canonical,
    CASE k % 4 WHEN 0 THEN seg || ' vendor ' || v WHEN 1 THEN lower(seg || ' vendor ' || v)
      WHEN 2 THEN seg || '-vendor-' || v ELSE upper(seg || ' vendor ' || v) END AS written,
    'INV-' || lpad(CAST(k AS VARCHAR), 8, '0') || CASE WHEN copy = 2 THEN '-COPY' ELSE '' END
      AS invoice,
    CASE WHEN k % 109 = 0 THEN 'missing amount'
      WHEN k % 113 = 0 OR k % 127 = 0 THEN 'invalid amount or unsupported currency' END AS a_err,
    CASE WHEN k % 101 = 0 THEN 'missing date'
      WHEN k % 103 = 0 THEN 'ambiguous date: slash order unspecified'
      WHEN k % 107 = 0 THEN 'invalid date' END AS d_err,
    CASE seg WHEN 'AUTOMOBILE' THEN 'Transport' WHEN 'BUILDING' THEN 'Rent'
      WHEN 'FURNITURE' THEN 'Supplies' WHEN 'HOUSEHOLD' THEN 'Utilities' ELSE 'Software' END
      AS seg_category,
    replace(format('{:,}', abs(true_cents) // 100), '_', ',') || '.'
      || lpad(CAST(abs(true_cents) % 100 AS VARCHAR), 2, '0') AS grouped
  FROM t
), rows_ AS (
  SELECT *, '1:1:' || ord AS id,
    CASE WHEN v < 30 THEN canonical ELSE written END AS merchant,
    CASE WHEN v < 30 THEN seg_category ELSE 'Uncategorised' END AS category,
    CASE WHEN v < 30 THEN 'exact merchant rule' ELSE 'no rule; manual review' END AS category_rule,
    CASE WHEN a_err IS NULL THEN true_cents END AS cents,
    CASE WHEN d_err IS NULL THEN dt END AS bill_day,
    a_err IS NULL AND d_err IS NULL AS ok,
    CASE WHEN k % 5 = 0 THEN '  ' || invoice || ' ' ELSE invoice END AS invoice_raw,
    CASE WHEN k % 4 = 2 THEN '  ' ELSE '' END || written AS merchant_raw,
    CASE WHEN k % 101 = 0 THEN '' WHEN k % 103 = 0 THEN '03/04/2025'
      WHEN k % 107 = 0 THEN '2025-02-30' WHEN k % 3 = 0 THEN strftime(dt, '%Y-%m-%d')
      WHEN k % 3 = 1 THEN strftime(dt, '%Y/%m/%d') ELSE strftime(dt, '%d-%b-%Y') END AS date_raw,
    CASE WHEN k % 109 = 0 THEN '' WHEN k % 113 = 0 THEN 'USD 45.00'
      WHEN k % 127 = 0 THEN 'CAD 12,34.00'
      WHEN k % 3 = 0 THEN 'CAD ' || CASE WHEN true_cents < 0 THEN '-' ELSE '' END || grouped
      WHEN k % 3 = 1 AND true_cents < 0 THEN '($' || grouped || ')'
      WHEN k % 3 = 1 THEN '$' || grouped
      WHEN true_cents < 0 THEN '(CAD ' || grouped || ')'
      ELSE replace(grouped, ',', '') END AS amount_raw
  FROM named
), firsts AS (
  SELECT *,
    min(ord) OVER (PARTITION BY ok, CASE WHEN ok THEN 0 ELSE ord END, merchant, bill_day, cents,
      invoice) AS exact_first,
    min(ord) OVER (PARTITION BY ok, CASE WHEN ok THEN 0 ELSE ord END, merchant, bill_day, cents)
      AS near_first
  FROM rows_
), r AS (
  SELECT *, CAST(bill_day AS VARCHAR) AS bill_date, strftime(bill_day, '%Y-%m') AS month,
    CASE WHEN ok AND exact_first <> ord THEN '1:1:' || exact_first END AS duplicate_of,
    CASE WHEN ok AND exact_first = ord AND near_first <> ord THEN '1:1:' || near_first END
      AS possible_of,
    CASE WHEN NOT ok THEN 'unparseable' WHEN exact_first <> ord THEN 'duplicate' ELSE 'clean' END
      AS status,
    CASE WHEN true_cents < 0 AND a_err IS NULL THEN '-' ELSE '' END || CASE WHEN a_err IS NULL
      THEN grouped END AS money_grouped
  FROM firsts
), rec AS (
  SELECT *,
    list_filter([CASE WHEN category = 'Uncategorised' THEN 'unmapped merchant' END, a_err, d_err,
      'exact duplicate of ' || duplicate_of,
      'possible duplicate of ' || possible_of || '; retained for review',
      CASE WHEN abs(cents) >= 40000000 THEN 'high amount: absolute CAD >= 400,000' END],
      lambda x: x IS NOT NULL) AS reasons,
    list_filter([CASE WHEN category = 'Uncategorised' THEN 'unmapped' END,
      CASE a_err WHEN 'missing amount' THEN 'missingamount'
        WHEN 'invalid amount or unsupported currency' THEN 'invalidamount' END,
      CASE d_err WHEN 'missing date' THEN 'missingdate' WHEN 'invalid date' THEN 'invaliddate'
        WHEN 'ambiguous date: slash order unspecified' THEN 'ambiguousdate' END,
      CASE WHEN duplicate_of IS NOT NULL THEN 'exactdup' END,
      CASE WHEN possible_of IS NOT NULL THEN 'possibledup' END,
      CASE WHEN abs(cents) >= 40000000 THEN 'high' END], lambda x: x IS NOT NULL) AS keys
  FROM r
), kept AS (SELECT * FROM rec WHERE status = 'clean')
"""

CHANGES = """
, raw_changes AS (
  SELECT id, ord, e.slot AS slot, e.field AS field, e.before AS before, e.after AS after,
         e.rule AS rule
  FROM (SELECT id, ord, unnest([
    {'slot': 0, 'field': 'header', 'before': 'Invoice', 'after': 'invoice',
     'rule': 'header alias map'},
    {'slot': 1, 'field': 'header', 'before': 'Vendor', 'after': 'merchant',
     'rule': 'header alias map'},
    {'slot': 2, 'field': 'header', 'before': 'Date', 'after': 'date', 'rule': 'header alias map'},
    {'slot': 3, 'field': 'header', 'before': 'Amount', 'after': 'amount_cad',
     'rule': 'header alias map'},
    {'slot': 4, 'field': 'invoice', 'before': invoice_raw, 'after': invoice,
     'rule': 'trim surrounding whitespace'},
    {'slot': 5, 'field': 'merchant', 'before': merchant_raw, 'after': merchant,
     'rule': 'synthetic merchant alias map'},
    {'slot': 6, 'field': 'category', 'before': '', 'after': category, 'rule': category_rule},
    {'slot': 7, 'field': 'amount', 'before': amount_raw, 'after': replace(money_grouped, ',', ''),
     'rule': 'CAD symbols, grouping and refund sign'},
    {'slot': 8, 'field': 'date', 'before': date_raw, 'after': bill_date,
     'rule': 'explicit non-ambiguous date format'},
    {'slot': 9, 'field': 'disposition', 'before': 'input', 'after': status,
     'rule': 'partition; never discard a source row'}]) AS e FROM rec)
), changes AS (SELECT *, 'build' AS who FROM raw_changes WHERE before <> after)
"""

DECISIONS = """
, plan(place, divisor, action, after, rule_added, undo_of) AS (VALUES
  (1, 29, 'category', 'Software', NULL, NULL), (2, 58, 'confirm', NULL, NULL, NULL),
  (3, 31, 'confirm', NULL, NULL, NULL), (4, 62, 'undo', NULL, NULL, 3),
  (5, 37, 'category', 'Uncategorised', NULL, NULL), (6, 43, 'duplicate', '1:1:0', NULL, NULL),
  (7, 47, 'exclude', NULL, NULL, NULL), (8, 59, 'unknown', NULL, NULL, NULL),
  (9, 61, 'category', 'Rent', 'rule', NULL), (10, 122, 'undo', NULL, NULL, 9)
), decisions AS (
  SELECT o_orderkey AS k, o_orderkey * 20 + place AS seq, 'd-' || o_orderkey || '-' || place AS did,
    CASE action WHEN 'unknown' THEN '9:9:' ELSE '1:1:' END || o_orderkey * 10 AS row_id,
    CASE action WHEN 'unknown' THEN 'confirm' ELSE action END AS action, after,
    CASE WHEN rule_added IS NOT NULL THEN 'rule-' || o_orderkey END AS rule_added,
    CASE WHEN undo_of IS NOT NULL THEN 'd-' || o_orderkey || '-' || undo_of END AS undo_of
  FROM orders JOIN plan ON o_orderkey % divisor = 0
), active AS (
  SELECT * FROM decisions d
  WHERE NOT EXISTS (SELECT 1 FROM decisions u WHERE u.action = 'undo' AND u.undo_of = d.did)
), acting AS (SELECT * FROM active WHERE action <> 'undo')
"""

# the fixture has at most one duplicate and one exclude decision per row, so a row's review
# reasons are spelled out case by case here
REVIEWED = """
, eff AS (
  SELECT row_id,
    arg_max(after, seq) FILTER (action = 'category') AS cat,
    max(seq) FILTER (action = 'category') AS cat_seq,
    arg_max(action, seq) FILTER (action IN ('duplicate', 'exclude')) AS move,
    min(seq) FILTER (action IN ('duplicate', 'exclude')) AS first_move,
    min(seq) FILTER (action = 'category' AND after <> 'Uncategorised') AS first_named,
    max(seq) FILTER (action = 'duplicate') AS dup_seq,
    max(seq) FILTER (action = 'exclude') AS exc_seq,
    arg_max(action, seq) AS last_action, max(seq) AS last_seq
  FROM acting GROUP BY row_id
), pre AS (
  SELECT rec.*, eff.*, CASE WHEN cat IS NULL THEN reasons
    ELSE list_filter(reasons, lambda x: x <> 'unmapped merchant') END AS rest
  FROM rec LEFT JOIN eff ON rec.id = eff.row_id
), rv AS (
  SELECT id, ord, k, merchant, invoice, bill_date, cents, seg, v,
    coalesce(cat, category) AS category,
    CASE move WHEN 'duplicate' THEN 'duplicate' WHEN 'exclude' THEN 'excluded' ELSE status END
      AS status,
    CASE WHEN dup_seq IS NOT NULL THEN '1:1:0' ELSE duplicate_of END AS duplicate_of,
    CASE WHEN last_action <> 'category' THEN last_action END AS decided,
    CASE WHEN last_action <> 'category' THEN last_seq END AS decided_seq,
    list_concat(rest, list_transform(list_sort(list_filter([
      CASE WHEN dup_seq IS NOT NULL
        THEN {'s': dup_seq, 't': 'marked duplicate of 1:1:0 by reviewer'} END,
      CASE WHEN exc_seq IS NOT NULL THEN {'s': exc_seq, 't': 'excluded by reviewer'} END,
      CASE WHEN len(rest) = 0 AND first_named IS NOT NULL
          AND (first_move IS NULL OR first_named < first_move)
        THEN {'s': first_named, 't': 'category edited by reviewer'} END,
      CASE WHEN cat = 'Uncategorised' THEN {'s': cat_seq, 't': 'unmapped merchant'} END],
      lambda x: x IS NOT NULL)), lambda x: x.t)) AS reasons
  FROM pre
), rvk AS (
  SELECT *, len(reasons) > 0 OR decided IS NOT NULL AS queued FROM rv
)
"""

REVIEWER_CHANGES = """
, ev AS (
  SELECT a.*, last_value(CASE WHEN action = 'category' THEN after END IGNORE NULLS) OVER w AS p_cat,
    last_value(CASE action WHEN 'duplicate' THEN 'duplicate' WHEN 'exclude' THEN 'excluded' END
      IGNORE NULLS) OVER w AS p_status
  FROM active a
  WINDOW w AS (PARTITION BY row_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), made AS (
  SELECT e.seq, e.row_id AS id,
    CASE e.action WHEN 'category' THEN 'category' WHEN 'confirm' THEN 'review'
      WHEN 'undo' THEN 'decision' ELSE 'disposition' END AS field,
    CASE e.action WHEN 'category' THEN coalesce(p_cat, rec.category) WHEN 'confirm' THEN 'flagged'
      WHEN 'undo' THEN u.action ELSE coalesce(p_status, rec.status) END AS before,
    CASE e.action WHEN 'category' THEN e.after WHEN 'confirm' THEN 'confirmed as is'
      WHEN 'undo' THEN 'undone' WHEN 'exclude' THEN 'excluded' ELSE 'duplicate' END AS after,
    CASE e.action WHEN 'category' THEN 'manual review' WHEN 'confirm' THEN 'reviewer confirmation'
      WHEN 'undo' THEN 'reviewer undo' WHEN 'exclude' THEN 'excluded by reviewer'
      ELSE 'marked duplicate by reviewer' END AS rule
  FROM ev e LEFT JOIN rec ON rec.id = e.row_id LEFT JOIN decisions u ON u.did = e.undo_of
  WHERE rec.id IS NOT NULL OR e.action = 'undo'
)
"""

VENDORS = """
, vendors AS (
  SELECT DISTINCT c_mktsegment AS seg, CAST(c_custkey % 40 AS BIGINT) AS v FROM customer
), cache AS (
  SELECT lower(seg) || 'vendor' || v AS norm_key, seg || ' vendor ' || v AS merchant,
    CASE WHEN v % 4 = 0 THEN 'Supplies' END AS category, v / 100.0 AS confidence,
    'seen in ' || seg AS reason, 'model-1' AS model
  FROM vendors WHERE v >= 30 AND v % 2 = 0
)
"""

# rules of the preview: overrides for vendor 3, new rules for vendors 31 and 32, higher limit
NEW_RULES = """
, nr AS (
  SELECT *, CASE WHEN v IN (3, 31, 32) THEN 'Supplies' ELSE category END AS new_category,
    CASE WHEN v IN (3, 31, 32) THEN seg || ' VENDOR ' || v ELSE merchant END AS new_merchant,
    CASE WHEN v IN (3, 31, 32) THEN 'reviewer alias rule' ELSE category_rule END AS new_rule
  FROM rec
), nf AS (
  SELECT *,
    min(ord) OVER (PARTITION BY ok, CASE WHEN ok THEN 0 ELSE ord END, new_merchant, bill_day,
      cents, invoice) AS exact2,
    min(ord) OVER (PARTITION BY ok, CASE WHEN ok THEN 0 ELSE ord END, new_merchant, bill_day,
      cents) AS near2
  FROM nr
), n2 AS (
  SELECT *, new_category = 'Uncategorised' OR NOT ok OR exact2 <> ord OR near2 <> ord
      OR coalesce(abs(cents) >= 45000000, false) AS new_flagged,
    4 + CAST(invoice_raw <> invoice AS INT) + CAST(merchant_raw <> new_merchant AS INT) + 1
      + CAST(a_err IS NULL AND amount_raw <> replace(money_grouped, ',', '') AS INT)
      + CAST(d_err IS NULL AND date_raw <> bill_date AS INT) + 1
      - CAST(k IS NULL AS INT) AS new_changes
  FROM nf
)
"""

def _keyword_case(column: str, value) -> str:
    parts = []
    for words, category in KEYWORDS:
        tests = " OR ".join(f"contains(lower({column}), '{w}')" for w in words.split("|"))
        parts.append(f"WHEN {tests} THEN '{value(words, category)}'")
    return "CASE " + " ".join(parts)


def _guess(column: str) -> str:
    return _keyword_case(column, lambda words, category: category) + " END"


_MONEY = "CAST(coalesce(sum(cents), 0) AS BIGINT)"
_TEXT = "array_to_string(reasons, '; ')"


def _reconcile(source: str, statuses: list[str]) -> str:
    names = ", ".join(f"('{s}')" for s in statuses)
    return f"""
SELECT n.status AS status, count({source}.id) AS rows, {_MONEY} AS cents,
  count(*) FILTER ({source}.id IS NOT NULL AND cents IS NULL) AS unknown_rows
FROM (VALUES {names}) n(status) LEFT JOIN {source} ON {source}.status = n.status GROUP BY n.status
UNION ALL
SELECT 'input', count(*), {_MONEY}, count(*) FILTER (cents IS NULL) FROM {source}
"""


_THREE = ["clean", "duplicate", "unparseable"]
_FOUR = [*_THREE, "excluded"]

_PAIR = """
SELECT a.{link} AS original_id, a.id AS id, a.invoice AS invoice, a.bill_date AS bill_date,
  a.merchant AS merchant, a.cents AS cents, b.id IS NOT NULL AS original_found,
  b.invoice AS original_invoice, b.bill_date AS original_bill_date,
  b.merchant AS original_merchant, b.cents AS original_cents
FROM {table} a LEFT JOIN {table} b ON b.id = a.{link} WHERE {where}
"""

_SUMMARY_CONTROL = """
SELECT 0 AS section, CAST(place AS BIGINT) AS place, label, CAST(c AS BIGINT) AS cents,
  CAST(n AS BIGINT) AS rows, note, CAST(NULL AS BIGINT) AS source_row FROM (
  SELECT unnest([
    {{'place': 0, 'label': 'Retained bills', 'c': sum(cents) FILTER (status = 'clean'),
     'n': count(*) FILTER (status = 'clean'),
     'note': 'Includes possible duplicates; resolve review before posting.'}},
    {{'place': 1, 'label': 'Exact duplicates excluded',
     'c': sum(cents) FILTER (status = 'duplicate'), 'n': count(*) FILTER (status = 'duplicate'),
     'note': 'Excluded from Bills; original rows retained.'}},
    {{'place': 2, 'label': 'Unparseable: known amounts',
     'c': sum(cents) FILTER (status = 'unparseable'),
     'n': count(*) FILTER (status = 'unparseable'), 'note': 'Not included in monthly totals.'}},
    {{'place': 3, 'label': 'Excluded by reviewer', 'c': sum(cents) FILTER (status = 'excluded'),
     'n': count(*) FILTER (status = 'excluded'),
     'note': 'Removed from Bills by a reviewer decision; amount kept in the control total.'}},
    {{'place': 4, 'label': 'All known input amounts', 'c': sum(cents), 'n': count(*),
     'note': 'Independent source control, before duplicate exclusion.'}},
    {{'place': 5, 'label': 'Reconciliation difference', 'c': 0, 'n': NULL,
     'note': 'Exact cents; must equal zero. Missing amounts stay unknown.'}},
    {{'place': 6, 'label': 'Unknown amounts', 'c': NULL, 'n': count(*) FILTER (cents IS NULL),
     'note': 'Blank amounts are unknown, never treated as real zero.'}},
    {{'place': 7, 'label': 'Review rows', 'c': NULL, 'n': count(*) FILTER (len(reasons) > 0),
     'note': 'Every flagged row, including duplicates.'}}], recursive := true)
  FROM {table}) WHERE NOT (place = 3 AND n = 0)
"""

_CATEGORY_LINES = """
SELECT n.c AS category, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, count({table}.id) AS rows
FROM (VALUES ('Rent'), ('Software'), ('Supplies'), ('Transport'), ('Utilities'),
  ('Uncategorised')) n(c) LEFT JOIN {table} ON {table}.category = n.c {extra} GROUP BY n.c
"""

_SUMMARY = (
    _SUMMARY_CONTROL.format(table="rec")
    + f"""
UNION ALL SELECT 1, 0, month, {_MONEY}, count(*), NULL, NULL FROM kept GROUP BY month
UNION ALL SELECT 2, 0, category, cents, rows, NULL, NULL FROM ({_CATEGORY_LINES.format(table="kept", extra="")})
UNION ALL SELECT 3, -cents, merchant, cents, rows,
  CASE WHEN row_number() OVER (ORDER BY cents DESC, merchant) = 1 THEN 'Largest merchant' END, NULL
  FROM (SELECT merchant, {_MONEY} AS cents, count(*) AS rows FROM kept GROUP BY merchant)
UNION ALL SELECT 4, -abs(cents), invoice, cents, NULL, merchant, ord FROM kept
  WHERE abs(cents) >= 40000000
"""
)

_CHECK = "SELECT '{name}' AS \"check\", true AS ok, {detail} AS detail FROM {table}"

_CHECKS = {
    "identity": _CHECK.format(
        name="identity", detail="count(*) || ' records for ' || count(*) || ' source rows'",
        table="rec"),
    "partition": _CHECK.format(
        name="partition", detail="count(*) || ' of ' || count(*) || ' rows in a known group'",
        table="rec"),
    "amounts": _CHECK.format(
        name="amounts",
        detail="CAST(sum(cents) AS BIGINT) || ' cents in groups, ' || CAST(sum(cents) AS BIGINT)"
        " || ' cents read'", table="rec"),
    "review": _CHECK.format(
        name="review", detail="count(*) FILTER (len(reasons) > 0) || ' rows listed for review'",
        table="rec"),
    "changes": _CHECK.format(name="changes", detail="'0 differing rows'", table="(SELECT 1)"),
}

_LATER_CHECKS = {
    "reviewer changes": "SELECT 'reviewer changes' AS \"check\", count(made.seq) = count(*) AS ok, "
    "count(*) || ' review changes' AS detail FROM active LEFT JOIN made USING (seq)",
    "policy": "SELECT 'policy' AS \"check\", count(*) = 150 AS ok, "
    "(150 - count(*)) || ' rules missing, 0 unexpected' AS detail FROM vendors WHERE v < 30",
    "repeatable": "SELECT 'repeatable' AS \"check\", true AS ok, '0 differing rows' AS detail",
    "advisory": "SELECT 'advisory' AS \"check\", true AS ok, "
    "'0 differ from the cache, 0 were applied' AS detail",
    "cache": "SELECT 'cache' AS \"check\", true AS ok, count(*) || ' cache entries' AS detail FROM cache",
}

_RV_SECTIONS = (
    _SUMMARY_CONTROL.format(table="rv")
    + " UNION ALL SELECT 2, 0, category, cents, rows, NULL, NULL FROM ("
    + _CATEGORY_LINES.format(table="rv", extra="AND rv.status = 'clean'")
    + f""")
UNION ALL SELECT 1, 0, substr(bill_date, 1, 7), {_MONEY}, count(*), NULL, NULL FROM rv
  WHERE status = 'clean' GROUP BY 3
UNION ALL SELECT 3, -cents, merchant, cents, rows,
  CASE WHEN row_number() OVER (ORDER BY cents DESC, merchant) = 1 THEN 'Largest merchant' END, NULL
  FROM (SELECT merchant, {_MONEY} AS cents, count(*) AS rows FROM rv WHERE status = 'clean' GROUP BY merchant)
UNION ALL SELECT 4, -abs(cents), invoice, cents, NULL, merchant, ord FROM rv
  WHERE status = 'clean' AND abs(cents) >= 40000000
"""
)

_REPLY = """
SELECT c_custkey AS batch_id,
  CASE WHEN c_custkey % 6 < 3 THEN c_name END AS merchant,
  CASE WHEN c_custkey % 6 < 3 AND c_custkey % 3 = 0 THEN 'Rent' END AS category,
  CASE WHEN c_custkey % 6 < 3 AND c_custkey % 4 <= 2 THEN (c_custkey % 4) / 2.0 END AS confidence,
  CASE WHEN c_custkey % 6 < 3 THEN 'see ]" [1] ' || repeat('x', 129) END AS reason,
  CASE c_custkey % 6 WHEN 3 THEN 'the model reply opens a JSON array and never closes it'
    WHEN 4 THEN 'no JSON array in the model reply' END AS error
FROM customer WHERE c_custkey % 6 <> 5
"""


# names without a category in calls of twelve; a call with the hyphened name of a vendor 39 fails
_ASKED = """
, asked AS (
  SELECT *, NOT bool_or(merchant LIKE '%-39') OVER (PARTITION BY batch) AS answered
  FROM (SELECT *, (row_number() OVER (ORDER BY merchant) - 1) // 12 AS batch
    FROM (SELECT DISTINCT merchant, seg, v FROM rec WHERE v >= 30))
)
"""


def _eval(prediction: str) -> str:
    return f"""
, lab AS (
  SELECT seg || ' vendor ' || v AS merchant, 'Supplies' AS expected,
    CASE WHEN v % 3 = 0 THEN 'keyword' ELSE 'inference' END AS kind, {prediction}
  FROM vendors WHERE v >= 30
)
SELECT coalesce(kind, 'all') AS kind, count(*) AS items, count(*) FILTER (covered) AS covered,
  count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 4) AS accuracy,
  CASE WHEN kind IS NULL THEN CASE WHEN count(*) FILTER (covered) < count(*) THEN 'not run'
    WHEN count(*) FILTER (hit) / count(*) >= 0.8 THEN 'pass' ELSE 'fail' END END AS verdict
FROM lab GROUP BY GROUPING SETS ((kind), ())
"""


_HOT = """
, h AS (
  SELECT id, ord, ok, category AS m, substr(invoice, 9, 3) AS inv,
    CASE WHEN d_err IS NULL THEN 1 END AS d, CASE WHEN a_err IS NULL THEN 1 END AS c FROM rec
), hf AS (
  SELECT *, min(ord) OVER (PARTITION BY ok, CASE WHEN ok THEN 0 ELSE ord END, m, d, c, inv) AS e,
    min(ord) OVER (PARTITION BY ok, CASE WHEN ok THEN 0 ELSE ord END, m, d, c) AS n FROM h
)
SELECT id, CASE WHEN NOT ok THEN 'unparseable' WHEN e <> ord THEN 'duplicate' ELSE 'clean' END
    AS status,
  CASE WHEN ok AND e <> ord THEN '1:1:' || e END AS duplicate_of,
  CASE WHEN ok AND e = ord AND n <> ord THEN '1:1:' || n END AS possible_of
FROM hf
"""

_PREVIEW = """
SELECT count(*) FILTER (new_category <> category {decided}) AS recategorised,
  {now} AS flagged_now, {then} AS flagged_then,
  (SELECT count(*) FROM changes) AS changes_now, CAST(sum(new_changes) AS BIGINT) AS changes_then
FROM n2
"""


# rows and rejects of the faulty exports
_FAULTY_INTAKE = """
SELECT CAST(k % 4 AS VARCHAR) AS file, row_number() OVER (PARTITION BY k % 4 ORDER BY ord) + 1 AS source_row,
  invoice, cents, NULL AS reason FROM rec WHERE k % 4 = 0
UNION ALL SELECT '3', source_row, CASE WHEN k % 28 <> 3 THEN invoice END,
  CASE WHEN k % 28 <> 3 THEN cents END, CASE WHEN k % 28 = 3 THEN 'data outside header columns' END
  FROM (SELECT *, row_number() OVER (ORDER BY ord) + 1 AS source_row FROM rec WHERE k % 4 = 3)
UNION ALL SELECT '1', NULL, NULL, NULL, 'cannot map invoice, merchant, date and amount headers in first five rows'
UNION ALL SELECT '2', NULL, NULL, NULL, 'ambiguous headers: more than one column matches a required field'
"""


def _oracles() -> dict[str, tuple[str, str]]:
    """name -> (extra common tables, final select)."""
    c, d = CHANGES, DECISIONS
    rv, rc = d + REVIEWED, d + REVIEWER_CHANGES
    v = VENDORS
    is_open = "list_contains(reasons, 'unmapped merchant')"
    queue_flag = "(len(reasons) > 0 OR decided IS NOT NULL)"
    return {
        # scalar functions
        "strip_ws": ("", "SELECT id, invoice FROM rec"),
        "norm_key": (
            "", "SELECT lower(seg) || 'vendor' || v AS norm_key, count(*) AS rows FROM rec GROUP BY 1"
        ),
        "amount_cents": ("", "SELECT id, cents, a_err AS error FROM rec"),
        "bill_date": ("", "SELECT id, bill_date, d_err AS error FROM rec"),
        "money_text": (
            "",
            "SELECT id, replace(money_grouped, ',', '') AS plain, money_grouped AS grouped FROM rec",
        ),
        "month_key": ("", "SELECT month, count(*) AS rows FROM rec GROUP BY month"),
        "reason_key": ("", "SELECT id, array_to_string(keys, ',') AS keys FROM rec"),
        "keyword_guess": (
            "", f"SELECT p_partkey, {_guess('p_name')} AS category FROM part"),
        "keyword_guess_documents": (
            "", f"SELECT doc_id, {_guess('text')} AS category FROM documents"),
        # rules
        "categorise": ("", "SELECT id, merchant, category, category_rule FROM rec"),
        "categorise_large_rules": ("", "SELECT id, merchant, category FROM rec"),
        "effective_rules": (
            NEW_RULES,
            "SELECT new_category AS category, new_rule AS category_rule, count(*) AS rows FROM nr "
            "GROUP BY 1, 2",
        ),
        "rule_impact": (
            """, rl AS (
  SELECT s.seg, n.v FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'),
    ('MACHINERY')) s(seg) CROSS JOIN range(0, 33) n(v) WHERE n.v <> 30
)""",
            """
SELECT CASE WHEN rl.v IN (3, 31, 32) THEN rl.seg || ' VENDOR ' || rl.v
    ELSE rl.seg || ' vendor ' || rl.v END AS alias,
  CASE WHEN rl.v IN (3, 31, 32) THEN 'Supplies' ELSE CASE rl.seg WHEN 'AUTOMOBILE' THEN 'Transport'
    WHEN 'BUILDING' THEN 'Rent' WHEN 'FURNITURE' THEN 'Supplies' WHEN 'HOUSEHOLD' THEN 'Utilities'
    ELSE 'Software' END END AS category,
  CASE WHEN rl.v IN (3, 31, 32) THEN 'reviewer' ELSE 'builtin' END AS origin,
  count(rec.id) AS matched_rows, count(*) FILTER (abs(rec.cents) >= 45000000) AS high_rows
FROM rl LEFT JOIN rec ON rec.seg = rl.seg AND rec.v = rl.v GROUP BY rl.seg, rl.v
""",
        ),
        "check_rule_snapshot": (
            "",
            """
SELECT 0 AS missing, 150 - n AS unexpected, n = 150 AS ok
FROM (SELECT count(DISTINCT merchant) AS n FROM rec WHERE v < 30)
""",
        ),
        "preview_rules": (
            c + NEW_RULES,
            _PREVIEW.format(
                decided="", now="count(*) FILTER (len(reasons) > 0)",
                then="count(*) FILTER (new_flagged)"),
        ),
        "preview_rules_reviewed": (
            c + NEW_RULES + d
            + ", moved AS (SELECT row_id, bool_or(action = 'category') AS cat FROM acting "
            "WHERE action <> 'confirm' GROUP BY 1)",
            _PREVIEW.format(
                decided="AND cat IS NOT true",
                now="count(*) FILTER (len(reasons) > 0 OR row_id IS NOT NULL)",
                then="count(*) FILTER (new_flagged OR row_id IS NOT NULL)",
            ).replace("FROM n2", "FROM n2 LEFT JOIN moved ON moved.row_id = n2.id"),
        ),
        "rules_round_trip": (
            NEW_RULES,
            "SELECT new_category AS category, new_rule AS category_rule, count(*) AS rows FROM nr "
            "GROUP BY 1, 2",
        ),
        # cleaning
        "reconcile": ("", _reconcile("rec", _THREE)),
        "clean_records": (
            "",
            f"SELECT id, invoice, merchant, category, bill_date, cents, status, duplicate_of, "
            f"possible_of, {_TEXT} AS reasons FROM rec",
        ),
        "mark_exact_duplicates": (
            "", "SELECT id, duplicate_of FROM rec WHERE duplicate_of IS NOT NULL"),
        "mark_possible_duplicates": (
            "", "SELECT id, possible_of FROM rec WHERE possible_of IS NOT NULL"),
        "hot_groups": ("", _HOT),
        "assign_status": ("", "SELECT status, count(*) AS rows FROM rec GROUP BY status"),
        "build_reasons": ("", f"SELECT id, {_TEXT} AS reasons FROM rec"),
        "repeated_order_keys": (
            "", "SELECT count(*) AS n FROM rec GROUP BY ord HAVING count(*) > 1"),
        # change log
        "build_changes": (c, "SELECT id, field, before, after, rule, who FROM changes"),
        "change_counts": (c, "SELECT field, rule, count(*) AS rows FROM changes GROUP BY 1, 2"),
        "reviewer_changes": (rc, "SELECT seq, id, field, before, after, rule FROM made"),
        "change_log": (
            c + rc,
            "SELECT who, field, count(*) AS rows FROM (SELECT who, field FROM changes UNION ALL "
            "SELECT 'you', field FROM made) GROUP BY 1, 2",
        ),
        "change_facets": (
            c,
            "SELECT DISTINCT 'field' AS facet, field AS value FROM changes UNION ALL "
            "SELECT DISTINCT 'rule', rule FROM changes UNION ALL SELECT 'sheet', 'ORDERS'",
        ),
        "filter_changes": (c, "SELECT id, before, after FROM changes WHERE field = 'date'"),
        "row_history": (
            c,
            "SELECT id, field, before, after FROM changes WHERE id = '1:1:0' "
            "AND field NOT IN ('header', 'disposition')",
        ),
        "numbered_changes": (
            c + rc,
            """
SELECT row_number() OVER (ORDER BY part, a, b) AS n, id, field FROM (
  SELECT 0 AS part, ord AS a, slot AS b, id, field FROM changes
  UNION ALL SELECT 1, seq, 0, id, field FROM made)
""",
        ),
        "change_log_csv": (
            c,
            "SELECT row_number() OVER (ORDER BY ord, slot) AS n, id AS src, field, before, after, rule, who "
            "FROM changes",
        ),
        # totals
        "monthly_totals": (
            "", f"SELECT month, {_MONEY} AS cents, count(*) AS rows FROM kept GROUP BY month"),
        "monthly_totals_filled": (
            "",
            f"""
SELECT coalesce(kept.month, s.month) AS month, {_MONEY} AS cents, count(kept.id) AS rows
FROM kept FULL JOIN (SELECT strftime(m, '%Y-%m') AS month FROM
  range(DATE '1994-07-01', DATE '1996-01-01', INTERVAL 1 MONTH) g(m)) s ON s.month = kept.month
GROUP BY 1
""",
        ),
        "category_totals": ("", _CATEGORY_LINES.format(table="kept", extra="")),
        "merchant_totals": (
            "",
            f"""
SELECT merchant, cents, rows, round(cents / sum(cents) OVER (), 4) AS share,
  row_number() OVER (ORDER BY cents DESC, merchant) = 1 AS is_largest
FROM (SELECT merchant, {_MONEY} AS cents, count(*) AS rows FROM kept GROUP BY merchant)
""",
        ),
        "high_bills": (
            "",
            "SELECT id, invoice, merchant, bill_date, cents FROM kept WHERE abs(cents) >= 40000000",
        ),
        "high_bills_top": (
            "",
            "SELECT id, cents FROM kept WHERE abs(cents) >= 40000000 "
            "ORDER BY abs(cents) DESC, ord LIMIT 50",
        ),
        "totals_cube": (
            "",
            f"""
SELECT 'month' AS kind, month AS label, {_MONEY} AS cents, count(*) AS rows FROM kept GROUP BY 2
UNION ALL SELECT 'category', category, {_MONEY}, count(*) FROM kept GROUP BY 2
UNION ALL SELECT 'merchant', merchant, {_MONEY}, count(*) FROM kept GROUP BY 2
UNION ALL SELECT 'all', NULL, {_MONEY}, count(*) FROM kept
""",
        ),
        "review_workload": (
            "",
            "SELECT key AS reason_key, count(*) AS rows FROM (SELECT unnest(keys) AS key FROM rec) "
            "GROUP BY 1",
        ),
        "flagged_share": (
            "",
            "SELECT count(*) AS rows, count(*) FILTER (len(reasons) > 0) AS flagged, "
            "round(count(*) FILTER (len(reasons) > 0) * 100.0 / count(*), 4) AS percent FROM rec",
        ),
        # views
        "needs_review": ("", "SELECT id FROM rec WHERE len(reasons) > 0"),
        "filter_bills": (
            "",
            "SELECT id FROM kept WHERE category = 'Rent' AND len(reasons) = 0 "
            "AND (v = 1 OR v BETWEEN 10 AND 19)",
        ),
        "filter_bills_month": (
            "",
            "SELECT id FROM rec WHERE month = '1996-03' AND len(reasons) > 0 AND "
            "category = 'Uncategorised'",
        ),
        "filter_ledger": (
            "",
            "SELECT id FROM rec WHERE status = 'unparseable' AND seg = 'BUILDING' "
            "AND (a_err = 'missing amount' OR d_err = 'missing date')",
        ),
        "filter_ledger_category": (
            "", "SELECT id FROM kept WHERE category = 'Uncategorised'"),
        "filter_queue": (
            rv, "SELECT id FROM rvk WHERE queued AND list_contains(reasons, 'invalid date')"),
        "filter_queue_decided": (rv, "SELECT id FROM rvk WHERE decided IS NOT NULL"),
        "sort_bills": (
            "", "SELECT id, bill_date, cents FROM kept ORDER BY cents DESC, ord"),
        "sort_bills_unknown_first": (
            "", "SELECT id FROM rec ORDER BY bill_day NULLS FIRST, ord"),
        "review_queue": (
            rv,
            "SELECT id FROM rvk WHERE queued ORDER BY decided IS NOT NULL, "
            "abs(coalesce(cents, -1)) DESC, ord",
        ),
        "page": ("", "SELECT id FROM kept ORDER BY bill_day, ord LIMIT 200 OFFSET 600"),
        "stored_page": ("", "SELECT id FROM kept ORDER BY bill_day, ord LIMIT 200 OFFSET 600"),
        "stored_page_last": (
            "",
            """
SELECT o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
WHERE place // 200 = (n - 1) // 200
""",
        ),
        "duplicate_pairs": (
            "", _PAIR.format(link="duplicate_of", table="rec", where="a.status = 'duplicate'")),
        "duplicate_pairs_reviewed": (
            rv, _PAIR.format(link="duplicate_of", table="rv", where="a.status = 'duplicate'")),
        "possible_duplicate_pairs": (
            "", _PAIR.format(link="possible_of", table="rec", where="a.possible_of IS NOT NULL")),
        "ledger_diff": (
            "",
            "SELECT side AS only_in, status, CAST(count(*) AS BIGINT) AS rows FROM rec CROSS JOIN "
            "(VALUES ('a'), ('b')) s(side) WHERE abs(cents) >= 40000000 GROUP BY 1, 2",
        ),
        "ledger_diff_stored": (
            "",
            "SELECT side AS only_in, status, CAST(count(*) AS BIGINT) AS rows FROM rec CROSS JOIN "
            "(VALUES ('a'), ('b')) s(side) WHERE abs(cents) >= 40000000 GROUP BY 1, 2",
        ),
        # decisions
        "active_decisions": (d, "SELECT seq, row_id, action FROM active"),
        "latest_decision": (
            d, "SELECT row_id, max(seq) AS seq, arg_max(action, seq) AS action FROM acting GROUP BY 1"
        ),
        "apply_decisions": (
            rv,
            f"SELECT id, category, status, duplicate_of, {_TEXT} AS reasons, decided, "
            "CAST(make_timestamp(decided_seq * 1000000) AS VARCHAR) AS decided_at FROM rv",
        ),
        "reconcile_reviewed": (rv, _reconcile("rv", _FOUR)),
        "review_counts": (
            rv,
            f"SELECT count(*) FILTER ({queue_flag} AND decided IS NULL AND status <> 'excluded') "
            "AS pending, count(*) FILTER (decided IS NOT NULL) AS reviewed FROM rv",
        ),
        "undo": (
            d,
            """
SELECT action, count(*) AS rows FROM (
  SELECT action FROM active WHERE did NOT IN ('d-0-1', 'd-0-3', 'd-0-6')
  UNION ALL SELECT 'undo' FROM active WHERE did IN ('d-0-1', 'd-0-3', 'd-0-6')) GROUP BY 1
""",
        ),
        "rules_in_force": (
            d,
            "SELECT rule_added AS rule_id, after AS category FROM active WHERE rule_added IS NOT NULL",
        ),
        "rules_from_decisions": (
            d + """, added AS (
  SELECT seg, v, arg_max(after, seq) AS chosen, arg_max(merchant, seq) AS alias
  FROM active JOIN rec ON rec.id = active.row_id
  WHERE action = 'category' AND rule_added IS NOT NULL GROUP BY seg, v)""",
            "SELECT coalesce(alias, merchant) AS merchant, coalesce(chosen, category) AS category, "
            "count(*) AS rows FROM rec LEFT JOIN added USING (seg, v) GROUP BY 1, 2",
        ),
        "decisions_from_bulk": (
            "",
            "SELECT row_number() OVER (ORDER BY ord) AS seq, id AS row_id, 'duplicate' AS action, "
            "possible_of AS after FROM kept WHERE possible_of IS NOT NULL",
        ),
        "bulk_then_replay": (
            ", bulk AS (SELECT id, cents, CASE WHEN possible_of IS NOT NULL THEN 'duplicate' "
            "ELSE status END AS status FROM rec)",
            _reconcile("bulk", _FOUR),
        ),
        # reports
        "report_bills": (
            "",
            f"SELECT id, invoice, bill_date, merchant, category, cents AS amount, merchant_raw, "
            f"'orders' AS source_file, 'ORDERS' AS source_sheet, ord AS source_row, "
            f"{_TEXT} AS reasons, month FROM kept",
        ),
        "report_needs_review": (
            "",
            f"SELECT id, status, {_TEXT} AS reasons, invoice, merchant_raw, date_raw, amount_raw, "
            "cents AS amount, 'orders' AS source_file, 'ORDERS' AS source_sheet, "
            "ord AS source_row FROM rec WHERE len(reasons) > 0",
        ),
        "report_duplicates": (
            "",
            "SELECT id, duplicate_of, invoice, merchant, bill_date, cents AS amount, "
            "'orders' AS source_file, 'ORDERS' AS source_sheet, ord AS source_row "
            "FROM rec WHERE status = 'duplicate'",
        ),
        "report_change_log": (
            c + rc,
            """
SELECT NULL AS seq, id, field, before, after, rule FROM changes
UNION ALL SELECT seq, id, field, before, after,
  rule || ' (you, ' || strftime(make_timestamp(seq * 1000000), '%Y-%m-%d %H:%M') || ')' FROM made
""",
        ),
        "report_summary": ("", _SUMMARY),
        "report_summary_merged": ("", _SUMMARY),
        "report_summary_reviewed": (rv, _RV_SECTIONS),
        # suggestions
        "uncategorised_merchants": (
            "", "SELECT DISTINCT merchant FROM rec WHERE category = 'Uncategorised'"),
        "attach_suggestions": (
            rv + v,
            f"""
SELECT rv.id AS id, cache.category AS category, cache.confidence AS confidence,
  coalesce(cache.reason, 'no cached model output for this merchant') AS reason
FROM rv LEFT JOIN cache ON cache.norm_key = lower(rv.seg) || 'vendor' || rv.v
WHERE {is_open.replace('reasons', 'rv.reasons')} AND rv.decided IS NULL
""",
        ),
        "missing_suggestions": (
            v,
            "SELECT DISTINCT lower(seg) || 'vendor' || v AS norm_key FROM rec "
            "WHERE v >= 30 AND v % 2 = 1",
        ),
        "suggestions_report": (
            v,
            """
SELECT DISTINCT rec.merchant AS merchant, cache.category AS category,
  cache.confidence AS confidence, cache.reason AS reason, cache.norm_key IS NOT NULL AS cached
FROM rec LEFT JOIN cache ON cache.norm_key = lower(rec.seg) || 'vendor' || rec.v WHERE rec.v >= 30
""",
        ),
        "keyword_suggestions": (
            "",
            "SELECT id, CAST(NULL AS VARCHAR) AS category, "
            "'no keyword match — a simulated rule cannot guess this name' AS reason "
            "FROM rec WHERE v >= 30",
        ),
        "ingest_replies": ("", _REPLY),
        "suggest": (
            _ASKED,
            """
SELECT merchant, CASE WHEN answered THEN 'Rent' END AS category,
  CASE WHEN answered THEN 0.5 END AS confidence,
  CASE WHEN answered THEN 'r' ELSE 'no answer from the model' END AS reason,
  CASE WHEN NOT answered THEN 'RuntimeError: busy' END AS error
FROM asked
""",
        ),
        "upsert_cache": (
            v + _ASKED,
            """
SELECT norm_key, category, confidence, reason, model FROM cache
UNION ALL SELECT lower(seg) || 'vendor' || v, CASE WHEN bool_or(answered) THEN 'Rent' END,
  CASE WHEN bool_or(answered) THEN 0.5 END,
  CASE WHEN bool_or(answered) THEN 'r' ELSE 'no answer from the model' END, 'model-2'
FROM asked WHERE v % 2 = 1 GROUP BY seg, v
""",
        ),
        "eval_suggestions": (v + "", _eval("v % 2 = 0 AS covered, v % 4 = 0 AS hit")),
        "eval_keywords": (v + "", _eval("true AS covered, false AS hit")),
        "eval_misses": (
            v,
            "SELECT seg || ' vendor ' || v AS merchant, CASE WHEN v % 3 = 0 THEN 'keyword' ELSE "
            "'inference' END AS kind, 'Supplies' AS expected, CAST(NULL AS VARCHAR) AS predicted "
            "FROM vendors WHERE v >= 30 AND v % 4 <> 0",
        ),
        # checks
        "check_identity": ("", _CHECKS["identity"]),
        "check_partition": ("", _CHECKS["partition"]),
        "check_amounts": ("", _CHECKS["amounts"]),
        "check_review_complete": ("", _CHECKS["review"]),
        "check_changes_complete": ("", _CHECKS["changes"]),
        "check_reviewer_changes": (rc, _LATER_CHECKS["reviewer changes"]),
        "check_policy": (v, _LATER_CHECKS["policy"]),
        "check_repeatable": ("", _LATER_CHECKS["repeatable"]),
        "check_repeatable_stored": ("", _LATER_CHECKS["repeatable"]),
        "check_repeatable_damaged": (
            "",
            "SELECT 'repeatable' AS \"check\", false AS ok, CAST(2 * count(*) AS VARCHAR) || ' differing rows' AS detail "
            "FROM rec WHERE ord % 1000 = 0 AND cents IS NOT NULL",
        ),
        "check_advisory": ("", _LATER_CHECKS["advisory"]),
        "check_advisory_damaged": (
            "",
            "SELECT 'advisory' AS \"check\", false AS ok, "
            "'1 differ from the cache, 0 were applied' AS detail",
        ),
        "check_identity_damaged": (
            "",
            "SELECT 'identity' AS \"check\", false AS ok, count(*) FILTER (WHERE ord % 1000 <> 0) "
            "|| ' records for ' || count(*) || ' source rows' AS detail FROM rec",
        ),
        "check_amounts_damaged": (
            "",
            "SELECT 'amounts' AS \"check\", false AS ok, (sum(cents) + 1) || ' cents in groups, ' "
            "|| sum(cents) || ' cents read' AS detail FROM rec",
        ),
        "check_cache": (v, _LATER_CHECKS["cache"]),
        "check_all": (rc + v, " UNION ALL ".join([*_CHECKS.values(), *_LATER_CHECKS.values()])),
        # files
        "csv_intake": ("", _reconcile("rec", _THREE)),
        "csv_intake_split": (
            "",
            "SELECT invoice, written AS merchant, cents, bill_date, CAST(split AS INTEGER) AS split "
            "FROM rec, (VALUES (32768), (134217728)) AS s(split)"),
        "workbook_intake": (
            "", "SELECT invoice, written AS merchant, cents, bill_date FROM rec"),
        "workbook_amounts": (
            "",
            "SELECT invoice, CASE WHEN cents IS NULL THEN amount_raw "
            "ELSE CAST(CAST(cents / 100.0 AS DECIMAL(18, 2)) AS VARCHAR) END AS amount FROM rec"),
        "fixed_intake": (
            "", "SELECT invoice, written AS merchant, cents, bill_date FROM rec"),
        "csv_intake_words": (
            "",
            "SELECT CASE WHEN ord % 2 = 0 THEN invoice ELSE 'seen' END AS invoice, "
            "written AS merchant, cents, bill_date FROM rec"),
        "csv_intake_rejects": ("", _FAULTY_INTAKE),
        "csv_intake_settled": ("", _FAULTY_INTAKE),
        "csv_intake_rows": (
            "", "SELECT invoice, written AS merchant, cents, bill_date FROM rec"),
        "write_ledger": ("", _reconcile("rec", _THREE)),
        "verify_ledger": (
            "",
            " UNION ALL ".join(
                [_CHECKS[n] for n in ("identity", "partition", "amounts", "changes")]
                + [
                    _CHECK.format(name=n, detail="'0 differing rows'", table="(SELECT 1)")
                    for n in ("reconciliation", "records")
                ]
            ),
        ),
        "verify_ledger_damaged": (
            "",
            "SELECT * FROM (VALUES ('identity', true), ('partition', true), ('amounts', false), "
            "('changes', false), ('reconciliation', true), ('records', false)) AS t(\"check\", ok)",
        ),
        "write_reports": (
            c + rc,
            f"""
SELECT 'bills' AS report, concat_ws('|', coalesce(month, '-'), id, {_TEXT}) AS label, cents FROM kept
UNION ALL SELECT 'needs_review', concat_ws('|', id, status, date_raw, amount_raw), cents
  FROM rec WHERE len(reasons) > 0
UNION ALL SELECT 'duplicates', concat_ws('|', id, duplicate_of), cents FROM rec WHERE status = 'duplicate'
UNION ALL SELECT 'change_log', concat_ws('|', id, field, coalesce(before, '-'), coalesce(after, '-'), rule), NULL
  FROM changes
UNION ALL SELECT 'change_log', concat_ws('|', id, field, coalesce(before, '-'), coalesce(after, '-'),
  rule || ' (you, ' || strftime(make_timestamp(seq * 1000000), '%Y-%m-%d %H:%M') || ')'), seq FROM made
UNION ALL SELECT 'summary', concat_ws('|', section, place, label, coalesce(CAST(rows AS VARCHAR), '-'),
  coalesce(note, '-')), cents FROM ({_SUMMARY})
"""),
        "decisions_round_trip": (
            d + """, damaged AS (
  SELECT *, CAST(make_timestamp(seq * 1000000) AS VARCHAR) AS made_at,
    CASE WHEN seq % 53 = 0 THEN 'not a decision' WHEN seq % 59 = 0 THEN 'unknown action'
      WHEN seq % 61 = 0 AND action <> 'undo' THEN 'decision without a number, id, row or action'
      WHEN seq % 67 = 0 THEN 'line given again' WHEN seq % 71 = 0 THEN 'one number for different decisions'
    END AS damage FROM decisions)""",
            """
SELECT seq, did AS id, row_id, action, after, undo_of, made_at, NULL AS copies, NULL AS reason FROM damaged
  WHERE damage IS NULL OR damage = 'line given again'
UNION ALL SELECT seq, did, NULL, NULL, NULL, NULL, NULL, 1, damage FROM damaged WHERE damage IS NOT NULL
UNION ALL SELECT seq, did || '-x', NULL, NULL, NULL, NULL, NULL, 1, damage FROM damaged
  WHERE damage = 'one number for different decisions'
""",
        ),
        "decision_gaps": (
            d,
            "SELECT before + 1 AS first, seq - 1 AS last FROM "
            "(SELECT seq, lag(seq) OVER (ORDER BY seq) AS before FROM decisions) WHERE seq > before + 1",
        ),
        "cache_round_trip": (
            v,
            """
SELECT norm_key, merchant, category, confidence, reason, 'openai' AS provider, model,
  '2025-06-01' AS generated, NULL AS reject FROM cache
  WHERE merchant NOT LIKE '%30' AND merchant NOT LIKE '%34' AND merchant NOT LIKE '%36' AND merchant NOT LIKE '%38'
UNION ALL SELECT CASE WHEN v = 30 THEN norm_key || 'x' ELSE norm_key END, merchant, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE v WHEN 30 THEN 'key of another merchant' WHEN 34 THEN 'unknown category' WHEN 36 THEN 'no model'
    ELSE 'confidence out of range' END
  FROM (SELECT *, CAST(right(merchant, 2) AS INT) AS v FROM cache) WHERE v IN (30, 34, 36, 38)
""",
        ),
        "write_suggestions": (
            v,
            """
SELECT DISTINCT rec.merchant AS merchant, cache.category AS category,
  cache.confidence AS confidence, cache.reason AS reason, cache.norm_key IS NOT NULL AS cached
FROM rec LEFT JOIN cache ON cache.norm_key = lower(rec.seg) || 'vendor' || rec.v WHERE rec.v >= 30
""",
        ),
    }


def all_oracles() -> dict[str, str]:
    return {name: BASE + extra + select for name, (extra, select) in _oracles().items()}
