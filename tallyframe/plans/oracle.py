"""DuckDB SQL for the correctness oracle.

These texts restate, in plain SQL over the driver's tables, what the Spark
operators compute.  They work on the statement *fields* directly instead of
cell arrays, so they check the Spark cell pipeline independently.
"""

from __future__ import annotations

# ---- fixed values, written out apart from the code that they check ----------
CURRENCY_PATTERNS = {
    "USD": [r"\$", r"usd", r"dollar", r"united states", r"us\s+dollar"],
    "EUR": [r"€", r"eur", r"euro", r"european"],
    "GBP": [r"£", r"gbp", r"pound", r"sterling", r"british"],
    "INR": [r"₹", r"inr", r"rupee", r"rs\.", r"indian"],
    "JPY": [r"¥", r"jpy", r"yen", r"japanese"],
    "CNY": [r"¥", r"cny", r"yuan", r"rmb", r"chinese"],
    "AUD": [r"aud", r"australian", r"a\$"],
    "CAD": [r"cad", r"canadian", r"c\$"],
    "CHF": [r"chf", r"swiss", r"franc"],
    "SGD": [r"sgd", r"singapore", r"s\$"],
}
PROCESSOR_CURRENCIES = ["INR", "USD", "EUR", "GBP"]
RULES_SQL = """rules(id, enum_name, patterns, category, processor_type, is_active) AS (VALUES
  (1, 'furniture_shop', ['furniture'], 'shopping', 'icici_bank', true),
  (2, 'machines', ['machin', 'nation_1'], 'utilities', 'icici_bank', true),
  (3, 'cars', ['automobile', '-urgent'], 'transport', 'icici_bank', true),
  (4, 'household_off', ['household'], 'other', 'icici_bank', false),
  (5, 'other_bank_rule', ['building'], 'shopping', 'hdfc_bank', true),
  (6, 'usd_payments', [' usd'], 'transfer', 'icici_bank', true),
  (7, 'france_spend', ['never-printed'], 'transfer', 'icici_bank', false))"""
# ---------------------------------------------------------------------------

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_D = "\\d(_?\\d)*"
PY_FLOAT_RE = f"^[+-]?(({_D}\\.?({_D})?|\\.{_D})(e[+-]?{_D})?|inf|infinity|nan)$"


def number_text(x: str) -> str:
    """What float() reads: ASCII digits, no (also no-break) space around."""
    return (f"regexp_replace(translate({x}, '０１２３４５６７８９', '0123456789'), "
            "'^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')")


def strip(x: str) -> str:
    return STRIP.format(x=x)


def validate_amount(x: str) -> str:
    cleaned = number_text(f"translate({x}, ',₹$€', '')")
    v = f"TRY_CAST(replace({cleaned}, '_', '') AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({cleaned}, '{PY_FLOAT_RE}', 'i') AND NOT isnan({v}) "
            f"AND {v} BETWEEN 0 AND 1e12 THEN {v} END)")


def is_py_float(x: str) -> str:
    return f"coalesce(regexp_matches({number_text(x)}, '{PY_FLOAT_RE}', 'i'), false)"


def sanitize(x: str, max_len: int = 1000) -> str:
    s = f"substring({strip(x)}, 1, {max_len})"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        s = f"replace({s}, '{a}', '{b}')"
    for pat, rep in (("javascript:", "javascript"), ("vbscript:", "vbscript"), ("data:", "data"),
                     ("on[\\p{L}\\p{N}_]+\\s*=", "event_handler")):
        s = f"regexp_replace({s}, '{pat}', '[BLOCKED:{rep}]', 'gi')"
    return f"coalesce({s}, '')"


def detect_currency(x: str, codes=PROCESSOR_CURRENCIES) -> str:
    parts = []
    for c in codes:
        pat = "|".join(CURRENCY_PATTERNS[c])
        parts.append(f"CASE WHEN regexp_matches(lower({x}), '{pat}') THEN '{c}' END")
    hits = f"list_filter([{', '.join(parts)}], lambda h: h IS NOT NULL)"
    return f"(CASE WHEN length({x}) > 0 AND len({hits}) = 1 THEN {hits}[1] END)"


def usable(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN length({s}) > 0 AND {s} <> 'nan' THEN {s} END)"


def py_text(x: str) -> str:
    return f"coalesce({x}, 'nan')"


STATEMENT_ROWS = """
sr0 AS (
  SELECT 'statements/' || lower(n.n_name) || '.csv' AS path,
         o.o_orderkey + 2 AS sheet_row,
         CAST(o.o_orderkey AS VARCHAR) AS s_no,
         CASE WHEN o.o_orderkey % 97 = 0 THEN 'N/A'
              WHEN o.o_orderkey % 3 = 0 THEN strftime(o.o_orderdate, '%d/%m/%Y')
              ELSE strftime(o.o_orderdate, '%d-%m-%Y') END AS txn_date,
         CASE WHEN o.o_orderkey % 89 = 0 THEN 'Opening Balance b/f'
              WHEN o.o_orderkey % 83 = 0 THEN ''
              ELSE 'UPI-' || c.c_mktsegment || '-' || n.n_name || '-' || o.o_orderpriority ||
                   CASE WHEN o.o_orderkey % 13 = 0 THEN ' USD'
                        WHEN o.o_orderkey % 17 = 0 THEN ' <b>EUR & co</b>' ELSE '' END END AS remarks,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 53 = 0
              THEN '-' || CAST(CAST(o.o_totalprice AS DECIMAL(14,2)) AS VARCHAR)
              WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 59 = 0
              THEN chr(160) || CAST(CAST(o.o_totalprice AS DECIMAL(14,2)) AS VARCHAR)
              WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 61 = 0
              THEN regexp_replace(CAST(CAST(o.o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '(\\d)(\\d{3}\\.)', '\\1_\\2')
              WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 67 = 0
              THEN translate(CAST(CAST(o.o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '0123456789', '０１２３４５６７８９')
              WHEN o.o_orderstatus = 'F' THEN CAST(CAST(o.o_totalprice AS DECIMAL(14,2)) AS VARCHAR)
              WHEN o.o_orderstatus = 'P' THEN format('{:,.2f}', o.o_totalprice) END AS withdrawal,
         CASE WHEN o.o_orderstatus = 'O' THEN CAST(CAST(o.o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS deposit,
         CAST(CAST(c.c_acctbal AS DECIMAL(14,2)) AS VARCHAR) AS balance
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
sr AS (
  SELECT * FROM sr0
  UNION ALL
  SELECT 'statements/replay.csv' AS path, sheet_row, s_no, txn_date, remarks, withdrawal, deposit, balance
  FROM sr0 WHERE CAST(s_no AS BIGINT) % 10 = 0
)"""


def _kept(lenient: bool = False) -> str:
    d, w, dp, r = py_text("txn_date"), py_text("withdrawal"), py_text("deposit"), py_text("remarks")
    has_date = f"({strip(d)} NOT IN ('', 'nan', 'None'))"
    def amount(x: str) -> str:
        return f"({is_py_float(x)} OR {validate_amount(x)} IS NOT NULL)" if lenient else is_py_float(x)

    has_w = f"({strip(w)} NOT IN ('', 'nan', 'None') AND {amount(w)})"
    has_d = f"({strip(dp)} NOT IN ('', 'nan', 'None') AND {amount(dp)})"
    indicators = ["transaction remarks", "transaction date", "withdrawal amount", "deposit amount",
                  "balance", "cheque number"]
    header_like = " OR ".join(f"contains(lower({r}), '{i}')" for i in indicators)
    return f"""
kept AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY sheet_row) AS row_number
  FROM sr
  WHERE {has_date} AND ({has_w} OR {has_d}) AND NOT ({header_like})
    AND lower({strip(r)}) NOT IN ('nan', 'none', '')
)"""


def _typed() -> str:
    dt = strip(py_text("txn_date"))
    date = (f"(CASE WHEN regexp_full_match({dt}, '(3[01]|[12][0-9]|0[1-9]|[1-9])-(1[0-2]|0[1-9]|[1-9])-[0-9]{{4}}') "
            f"THEN try_strptime({dt}, '%d-%m-%Y') "
            f"WHEN regexp_full_match({dt}, '(3[01]|[12][0-9]|0[1-9]|[1-9])/(1[0-2]|0[1-9]|[1-9])/[0-9]{{4}}') "
            f"THEN try_strptime({dt}, '%d/%m/%Y') END)")
    rm = strip(py_text("remarks"))
    w, dp = py_text("withdrawal"), py_text("deposit")
    cur = f"coalesce({detect_currency(usable(w))}, {detect_currency(usable(dp))}, {detect_currency(usable(rm))})"
    return f"""
typed0 AS (
  SELECT path, sheet_row, row_number,
         {date} AS d0, {rm} AS rm,
         {validate_amount(w)} AS debit_amount,
         {validate_amount(dp)} AS credit_amount,
         {validate_amount(py_text('balance'))} AS balance,
         {strip(py_text('s_no'))} AS ref,
         coalesce({cur}, '{PROCESSOR_CURRENCIES[0]}') AS cur, {cur} IS NOT NULL AS cur_known
  FROM kept
),
typed AS (
  SELECT path, sheet_row, row_number,
         (d0 IS NOT NULL AND rm <> '' AND rm <> 'nan') AS is_valid,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN d0 END AS transaction_date,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN {sanitize('rm')} END AS description,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN debit_amount END AS debit_amount,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN credit_amount END AS credit_amount,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN balance END AS balance,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN ref END AS reference_number,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN
              CASE WHEN debit_amount > 0 THEN 'debit' ELSE 'credit' END END AS transaction_type,
         cur_known,
         CASE WHEN d0 IS NOT NULL AND rm <> '' AND rm <> 'nan' THEN cur END AS currency
  FROM typed0
),
hashed AS (
  SELECT *, CASE WHEN is_valid THEN sha256(lower(
           strftime(transaction_date, '%Y-%m-%d') || '_' || description || '_' ||
           coalesce(CAST(debit_amount AS VARCHAR), 'None') || '_' ||
           coalesce(CAST(credit_amount AS VARCHAR), 'None') || '_' || reference_number)) END
         AS transaction_hash
  FROM typed
),
txn AS (
  SELECT * EXCLUDE (rk) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_hash ORDER BY path, sheet_row) AS rk
    FROM hashed WHERE is_valid) WHERE rk = 1
),
per_order AS (SELECT l_orderkey, sum(l_quantity) AS order_qty FROM lineitem GROUP BY l_orderkey),
splits AS (
  SELECT t.transaction_hash,
         lower({strip('s.s_name')}) AS person_name,
         l.l_quantity * 100 / greatest(100.0, p.order_qty) AS percentage,
         coalesce(nullif(t.debit_amount, 0.0), nullif(t.credit_amount, 0.0), 0.0)
           * ((l.l_quantity * 100 / greatest(100.0, p.order_qty)) / 100) AS amount,
         t.currency,
         l.l_linestatus = 'F' AS is_settled,
         l.l_linenumber
  FROM lineitem l JOIN per_order p ON l.l_orderkey = p.l_orderkey
  JOIN txn t ON CAST(t.reference_number AS BIGINT) = l.l_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""


def with_base(select: str, lenient: bool = False) -> str:
    """Full statement with the shared CTE chain in front of ``select``."""
    return "WITH " + ",".join([STATEMENT_ROWS, _kept(lenient), _typed()]) + "\n" + select


MONEY = "CAST(round(sum(CAST({x} AS DECIMAL(38,6))), 2) AS DOUBLE)"


STOPWORDS_SQL = "['to', 'from', 'the', 'and', 'or', 'in', 'on', 'at', 'by', 'for']"


def pattern_words(x: str) -> str:
    words = f"regexp_split_to_array({strip(f'lower({x})')}, '\\s+')"
    kept = f"list_filter({words}, lambda w: length(w) >= 3 AND NOT list_contains({STOPWORDS_SQL}, w))"
    cleaned = f"list_transform({kept}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    return f"list_filter({cleaned}, lambda w: length(w) >= 3)"


def split_items(spec: str) -> str:
    parts = f"list_transform(string_split({spec}, ','), lambda p: string_split({strip('p')}, ':'))"
    ok = (f"list_filter({parts}, lambda a: len(a) = 2 AND {is_py_float('a[2]')} "
          f"AND NOT isnan(TRY_CAST({strip('a[2]')} AS DOUBLE)) "
          f"AND TRY_CAST({strip('a[2]')} AS DOUBLE) > 0 AND TRY_CAST({strip('a[2]')} AS DOUBLE) <= 100)")
    return f"list_transform({ok}, lambda a: TRY_CAST({strip('a[2]')} AS DOUBLE))"


def split_status(spec: str) -> str:
    s = strip(f"coalesce({spec}, '')")
    items = split_items(s)
    total = f"coalesce(list_sum({items}), 0.0)"
    return (f"(CASE WHEN {s} = '' THEN 'none' WHEN len({items}) = 0 OR {total} > 100 THEN 'rejected' "
            f"ELSE 'ok' END)")


CATEGORIES_SQL = ("['income', 'food', 'transport', 'shopping', 'entertainment', 'utilities', "
                  "'healthcare', 'transfer', 'investment', 'other']")


def ingest_ctes() -> str:
    """Decisions, history, rule match and per-row outcome of the derived run."""
    suggested = f"coalesce({pattern_words('h.description')}[1], 'transaction')"
    choice = strip("coalesce(category_choice, '')")
    return f"""
valid AS (SELECT * FROM hashed WHERE is_valid),
hist_tx AS (SELECT DISTINCT transaction_hash FROM valid WHERE transaction_date < TIMESTAMP '1996-01-01'),
hist_sk AS (SELECT DISTINCT transaction_hash FROM valid
            WHERE transaction_date >= TIMESTAMP '1996-01-01' AND transaction_date < TIMESTAMP '1996-07-01'
              AND CAST(reference_number AS BIGINT) % 2 = 0),
dec0 AS (SELECT transaction_hash, min(reference_number) AS reference_number, min(description) AS description,
                CAST(min(reference_number) AS BIGINT) AS k
         FROM valid GROUP BY transaction_hash),
dec AS (
  SELECT transaction_hash,
         CASE WHEN k % 11 = 0 THEN 'skip' WHEN k % 19 = 0 THEN 'new_pattern' ELSE 'process' END AS action,
         CASE WHEN contains(description, '2-HIGH') THEN '2' WHEN contains(description, '3-MEDIUM') THEN 'Travel'
              WHEN contains(description, '4-NOT') THEN '3'
              WHEN contains(description, '5-LOW') THEN '99' ELSE '' END AS category_choice,
         CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN 'ok' ELSE 'order ' || reference_number END AS reason,
         CASE WHEN k % 4 = 0 THEN lower(string_split(description, '-')[3]) || ':50'
              WHEN k % 4 = 1 THEN 'alice:30, ' || upper(string_split(description, '-')[3]) || ' :20'
              WHEN k % 4 = 2 THEN 'alice:80,bob:40' ELSE '' END AS splits_spec,
         lower(string_split(description, '-')[3]) AS pattern,
         CASE WHEN k % 2 = 0 THEN lower(string_split(description, '-')[3]) || '_spend' ELSE '' END AS d_enum_name,
         'shopping' AS d_enum_category,
         CASE WHEN k % 29 = 0 THEN 'gbp' WHEN k % 31 = 0 THEN 'JPY' END AS d_currency
  FROM dec0 WHERE k % 23 <> 0),
{RULES_SQL},
pats AS (SELECT id, enum_name, category, unnest(patterns) AS pattern,
                generate_subscripts(patterns, 1) AS pos
         FROM rules WHERE is_active AND processor_type = 'icici_bank'),
hit AS (SELECT h.path, h.sheet_row, arg_min(p.id, p.id * 1000 + p.pos) AS enum_id
        FROM hashed h JOIN pats p ON contains(lower(h.description), lower(p.pattern))
        GROUP BY h.path, h.sheet_row),
firsts AS (SELECT transaction_hash, min(path || chr(1) || lpad(CAST(sheet_row AS VARCHAR), 20, '0')) AS fk
           FROM valid GROUP BY transaction_hash),
o1 AS (
  SELECT h.* REPLACE (CASE WHEN NOT h.cur_known AND upper(d.d_currency) IN ('INR', 'USD', 'EUR', 'GBP')
                           THEN upper(d.d_currency) ELSE h.currency END AS currency), r.id AS enum_id, r.enum_name, r.category AS enum_category,
         CASE WHEN d.action = 'process' AND r.id IS NOT NULL AND d.category_choice = '2' THEN 'skip'
              WHEN d.action = 'process' AND r.id IS NOT NULL AND d.category_choice = '3' THEN 'new_pattern'
              ELSE d.action END AS action,
         CASE WHEN r.id IS NOT NULL AND d.category_choice IN ('2', '3') THEN '' ELSE d.category_choice END AS category_choice,
         d.reason, d.splits_spec, d.pattern AS d_pattern, d.d_enum_name,
         d.d_enum_category,
         t.transaction_hash IS NOT NULL AS in_tx, s.transaction_hash IS NOT NULL AS in_sk,
         (h.path || chr(1) || lpad(CAST(h.sheet_row AS VARCHAR), 20, '0')) = f.fk AS is_first,
         (r.id IS NOT NULL AND (d.action IS NULL OR NOT (d.action = 'new_pattern'
            OR (d.action = 'process' AND d.category_choice = '3')))) AS matched,
         CASE WHEN lower({strip("coalesce(d.pattern, '')")}) = '' THEN {suggested}
              ELSE lower({strip("coalesce(d.pattern, '')")}) END AS np
  FROM hashed h LEFT JOIN hit ON h.path = hit.path AND h.sheet_row = hit.sheet_row
  LEFT JOIN rules r ON r.id = hit.enum_id
  LEFT JOIN dec d ON d.transaction_hash = h.transaction_hash
  LEFT JOIN hist_tx t ON t.transaction_hash = h.transaction_hash
  LEFT JOIN hist_sk s ON s.transaction_hash = h.transaction_hash
  LEFT JOIN firsts f ON f.transaction_hash = h.transaction_hash),
o2 AS (
  SELECT *,
    CASE WHEN action = 'skip' THEN 'skipped' WHEN length({strip("coalesce(reason, '')")}) IN (1, 2) THEN 'needs_review'
         WHEN matched THEN 'processed' WHEN action IS NULL THEN 'needs_review' ELSE 'processed' END AS decided,
    CASE WHEN NOT matched AND action IS NOT NULL AND action <> 'skip' THEN
         CASE WHEN length({strip("coalesce(d_enum_name, '')")}) >= 3 THEN {strip("coalesce(d_enum_name, '')")}
              ELSE np || '_transaction' END END AS new_enum_name
  FROM o1),
o3 AS (
  SELECT o2.*, er.id AS existing_enum_id, CASE WHEN matched THEN enum_id ELSE er.id END AS used_enum_id,
    CASE WHEN matched THEN enum_category ELSE coalesce(er.category, d_enum_category) END AS enum_cat
  FROM o2 LEFT JOIN rules er ON er.enum_name = o2.new_enum_name AND er.processor_type = 'icici_bank'),
o4 AS (
  SELECT *,
    CASE WHEN NOT is_valid THEN 'invalid' WHEN in_tx THEN 'duplicate' WHEN in_sk THEN 'auto_skipped'
         WHEN transaction_type = 'credit' AND credit_amount IS NULL THEN 'error_skipped'
         ELSE decided END AS own,
    CASE WHEN {choice} = '' THEN enum_cat
         WHEN regexp_full_match({choice}, '[0-9]+') THEN
              coalesce(CASE WHEN TRY_CAST({choice} AS INTEGER) BETWEEN 1 AND 10
                            THEN {CATEGORIES_SQL}[TRY_CAST({choice} AS INTEGER)] END, enum_cat)
         WHEN length({choice}) >= 2 THEN lower({choice})
         ELSE enum_cat END AS transaction_category,
    CASE WHEN length({strip("coalesce(reason, '')")}) >= 3 THEN {strip("coalesce(reason, '')")}
         WHEN matched THEN 'Transaction: ' || enum_name ELSE 'General transaction' END AS final_reason
  FROM o3),
outcomes AS (
  SELECT *,
    CASE WHEN is_valid AND NOT is_first AND own = 'processed' THEN 'duplicate'
         WHEN is_valid AND NOT is_first AND own = 'skipped' THEN 'auto_skipped'
         ELSE own END AS outcome
  FROM o4),
created AS (
  SELECT 7 + row_number() OVER (ORDER BY path, sheet_row, new_enum_name) AS id, new_enum_name AS enum_name,
         np AS pattern, enum_cat AS category
  FROM (SELECT *, row_number() OVER (PARTITION BY new_enum_name ORDER BY path, sheet_row) AS rk
        FROM outcomes WHERE outcome = 'processed' AND new_enum_name IS NOT NULL AND existing_enum_id IS NULL)
  WHERE rk = 1)"""


def with_ingest(select: str) -> str:
    return "WITH " + ",".join([STATEMENT_ROWS, _kept(), _typed(), ingest_ctes()]) + "\n" + select


def with_all_answers(select: str) -> str:
    """As ``with_ingest``, with a proper decision for every transaction."""
    text = with_ingest(select)
    for old, new in (("FROM dec0 WHERE k % 23 <> 0", "FROM dec0"), ("THEN 'ok' ELSE", "THEN 'okay' ELSE")):
        assert old in text
        text = text.replace(old, new)
    return text


def with_rules_at_once(select: str) -> str:
    """As ``with_ingest``, rows taken one by one: a rule counts from the row after the
    one that creates it.  ``w3`` walks the rows that have a decision in order, with the
    rules created so far as its state."""
    short = f"length({strip("coalesce(c.reason, '')")}) IN (1, 2)"
    walk = f"""
pos AS (SELECT path, sheet_row, row_number() OVER (ORDER BY path, sheet_row) AS i FROM hashed),
walked AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY p.i) AS step, p.i, lower(h.description) AS low, hit.enum_id IS NOT NULL AS old_hit, d.action, d.category_choice AS choice,
         d.reason, d.d_enum_category AS category,
         CASE WHEN lower({strip("coalesce(d.pattern, '')")}) = '' THEN coalesce({pattern_words('h.description')}[1], 'transaction')
              ELSE lower({strip("coalesce(d.pattern, '')")}) END AS np, {strip("coalesce(d.d_enum_name, '')")} AS given
  FROM hashed h JOIN pos p ON p.path = h.path AND p.sheet_row = h.sheet_row JOIN dec d ON d.transaction_hash = h.transaction_hash
  JOIN firsts f ON f.transaction_hash = h.transaction_hash AND f.fk = (h.path || chr(1) || lpad(CAST(h.sheet_row AS VARCHAR), 20, '0'))
  LEFT JOIN hit ON h.path = hit.path AND h.sheet_row = hit.sheet_row
  WHERE h.transaction_hash NOT IN (SELECT transaction_hash FROM hist_tx) AND h.transaction_hash NOT IN (SELECT transaction_hash FROM hist_sk)
    AND NOT (h.transaction_type = 'credit' AND h.credit_amount IS NULL)),
w3 AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(name VARCHAR, pattern VARCHAR, category VARCHAR, born BIGINT)[]) AS made
  UNION ALL
  SELECT step, CASE WHEN act <> 'skip' AND NOT short AND (NOT hit OR act = 'new_pattern') AND name NOT IN (SELECT enum_name FROM rules WHERE processor_type = 'icici_bank')
                         AND NOT list_contains(list_transform(made, lambda r: r.name), name)
                    THEN list_append(made, {{'name': name, 'pattern': np, 'category': category, 'born': i}}) ELSE made END
  FROM (SELECT *, CASE WHEN hit AND action = 'process' AND choice = '2' THEN 'skip' WHEN hit AND action = 'process' AND choice = '3' THEN 'new_pattern' ELSE action END AS act
        FROM (SELECT c.step, w.made, c.i, c.np, c.action, c.choice, c.category, {short} AS short, CASE WHEN length(c.given) >= 3 THEN c.given ELSE c.np || '_transaction' END AS name,
                     c.old_hit OR len(list_filter(w.made, lambda r: contains(c.low, r.pattern))) > 0 AS hit
              FROM w3 w JOIN walked c ON c.step = w.step + 1))),
made AS (SELECT 7 + row_number() OVER (ORDER BY r.born) AS id, r.name AS enum_name, r.pattern, r.category, r.born
         FROM (SELECT unnest(made) AS r FROM w3 WHERE step = (SELECT max(step) FROM w3))),
allrules AS (SELECT id, enum_name, category, processor_type, CAST(NULL AS BIGINT) AS born FROM rules UNION ALL SELECT id, enum_name, category, 'icici_bank', born FROM made),
hit_all AS (
  SELECT p.path, p.sheet_row, coalesce(any_value(hit.enum_id), min(m.id)) AS enum_id
  FROM hashed h JOIN pos p ON p.path = h.path AND p.sheet_row = h.sheet_row LEFT JOIN hit ON h.path = hit.path AND h.sheet_row = hit.sheet_row
  LEFT JOIN made m ON m.born < p.i AND contains(lower(h.description), m.pattern)
  GROUP BY p.path, p.sheet_row),
o1 AS ("""
    text = ingest_ctes()
    for old, new in (
            ("\no1 AS (", walk), ("LEFT JOIN hit ON h.path = hit.path AND h.sheet_row = hit.sheet_row\n  LEFT JOIN rules r ON r.id = hit.enum_id\n  LEFT JOIN dec d",
                                  "JOIN pos pp ON pp.path = h.path AND pp.sheet_row = h.sheet_row\n  LEFT JOIN hit_all hit ON h.path = hit.path AND h.sheet_row = hit.sheet_row\n"
                                  "  LEFT JOIN allrules r ON r.id = hit.enum_id\n  LEFT JOIN dec d"),
            (", r.id AS enum_id, r.enum_name,", ", pp.i, r.id AS enum_id, r.enum_name,"),
            ("LEFT JOIN rules er ON er.enum_name = o2.new_enum_name AND er.processor_type = 'icici_bank'",
             "LEFT JOIN allrules er ON er.enum_name = o2.new_enum_name AND er.processor_type = 'icici_bank' AND (er.born IS NULL OR er.born < o2.i)"),
            ("outcomes AS (\n  SELECT *,", "settled AS (SELECT transaction_hash, min(i) AS first_i FROM o4 WHERE own IN ('processed', 'skipped') GROUP BY transaction_hash),\n"
                                            "outcomes AS (\n  SELECT o4.*,"),
            ("NOT is_first AND own = 'processed'", "i <> first_i AND own = 'processed'"), ("NOT is_first AND own = 'skipped'", "i <> first_i AND own = 'skipped'"),
            ("         ELSE own END AS outcome\n  FROM o4)", "         ELSE own END AS outcome\n  FROM o4 LEFT JOIN settled ON settled.transaction_hash = o4.transaction_hash)")):
        assert text.count(old) == 1, old
        text = text.replace(old, new)
    return "WITH RECURSIVE " + ",".join([STATEMENT_ROWS, _kept(), _typed(), text]) + "\n" + select


def split_structs(spec: str) -> str:
    """Accepted split pieces as a list of {person, percentage} structs."""
    s = strip(f"coalesce({spec}, '')")
    parts = f"list_transform(string_split({s}, ','), lambda p: string_split({strip('p')}, ':'))"
    ok = (f"list_filter({parts}, lambda a: len(a) = 2 AND {is_py_float('a[2]')} "
          f"AND NOT isnan(TRY_CAST({strip('a[2]')} AS DOUBLE)) "
          f"AND TRY_CAST({strip('a[2]')} AS DOUBLE) > 0 AND TRY_CAST({strip('a[2]')} AS DOUBLE) <= 100)")
    return (f"list_transform({ok}, lambda a: {{'person': {strip('a[1]')}, "
            f"'percentage': TRY_CAST({strip('a[2]')} AS DOUBLE)}})")


SYMBOL_SQL = ("CASE {c} WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'INR' THEN '₹' "
              "WHEN 'JPY' THEN '¥' WHEN 'CNY' THEN '¥' WHEN 'AUD' THEN 'A$' WHEN 'CAD' THEN 'C$' "
              "WHEN 'CHF' THEN 'CHF' WHEN 'SGD' THEN 'S$' ELSE {c} END")
