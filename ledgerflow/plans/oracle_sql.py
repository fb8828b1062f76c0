"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly in SQL from the rules, not generated from the Spark plans. Each
query is ``WITH <the CTEs it needs> SELECT ...`` over the pre-registered test-data
views. Exact decimal rules: DuckDB divides decimals in DOUBLE, so half-up rounding
of a quotient is done in integer arithmetic on millionths (``_div2``), which is
what Spark's exact decimal division + ``round`` gives.
"""

from __future__ import annotations

# The CSV missing-value tokens, written out here: the oracle takes nothing from the engine.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)


def _div2(num: str, den: str, scale100: bool = False) -> str:
    """SQL for round_half_up(num / den [* 100], 2) as DOUBLE; num, den decimals of scale <= 6."""
    a = f"CAST(({num}) * 1000000 AS HUGEINT)"
    b = f"CAST(({den}) * 1000000 AS HUGEINT)"
    mult = 10000 if scale100 else 100
    return (f"(CASE WHEN ({den}) = 0 OR ({den}) IS NULL OR ({num}) IS NULL THEN NULL ELSE "
            f"sign({a}) * sign({b}) * ((2 * abs({a}) * {mult} + abs({b})) // (2 * abs({b}))) / 100.0 END)")


def _norm(c: str) -> str:
    return f"NULLIF(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def _nulltok(c: str) -> str:
    return f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}"


_DATE_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y"]  # noqa
_PARSE_DATE = "CAST(COALESCE(" + ", ".join(
    f"try_strptime(trim(date_raw), '{f}')" for f in _DATE_FORMATS) + ") AS DATE)"
_PARSE_AMOUNT = ("TRY_CAST(regexp_replace(replace(regexp_replace(amount_raw, '[€$£\\s]', '', 'g'), ',', '.'), "
                 "'[^0-9.\\-]', '', 'g') AS DECIMAL(28,6))")

RAW_COLS = ["date_raw", "department_code", "department", "txn_type", "expense_type", "amount_raw",
            "owner", "counterparty", "project"]

CTE: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTE[name] = (sql, deps or [])


# The ledger binding (FIXTURES.md §5), written as given there.
cte("ledger_raw", """
  WITH base AS (
    SELECT l.l_orderkey AS k, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
           CAST(l.l_shipdate AS DATE) AS d,
           CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amt,
           CASE l.l_returnflag WHEN 'N' THEN 'Revenu' WHEN 'A' THEN 'Dépense' ELSE 'depense' END AS tt,
           n.n_nationkey AS nk, n.n_name AS nn, c.c_name AS cn, s.s_name AS sn, p.p_type AS pt, p.p_brand AS pb,
           o.o_orderkey AS ok, l.l_orderkey * 8 + l.l_linenumber AS place
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN part p ON l.l_partkey = p.p_partkey
  ), dirty AS (
    SELECT
      CASE WHEN k % 89 = 0 THEN 'pas une date' ELSE CAST(d AS VARCHAR(10)) END AS date_raw,
      concat('DEPT', lpad(CAST(nk + 1 AS VARCHAR(10)), 3, '0')) AS department_code,
      CASE WHEN ln = 2 THEN concat('  ', replace(nn, '_', '  '), ' ') ELSE replace(nn, '_', ' ') END AS department,
      tt AS txn_type,
      CASE WHEN tt = 'Revenu' THEN NULL ELSE pt END AS expense_type,
      CASE WHEN k % 97 = 0 THEN 'n/d'
           WHEN ln % 4 = 0 THEN replace(CAST(amt AS VARCHAR(30)), '.', ',')
           WHEN ln % 4 = 1 THEN concat('€ ', CAST(amt AS VARCHAR(30)))
           WHEN ln % 4 = 2 THEN concat('-', CAST(amt AS VARCHAR(30)), ' $')
           ELSE CAST(amt AS VARCHAR(30)) END AS amount_raw,
      CASE WHEN k % 103 = 0 THEN '   ' ELSE concat('Owner ', CAST(ok % 40 AS VARCHAR(10))) END AS owner,
      CASE WHEN tt = 'Revenu' THEN cn ELSE sn END AS counterparty,
      pb AS project, k, place
    FROM base
  )
  SELECT date_raw, department_code, department, txn_type, expense_type, amount_raw, owner, counterparty, project, place * 2 + 1 AS ordinal FROM dirty
  UNION ALL
  SELECT date_raw, department_code, department, txn_type, expense_type, amount_raw, owner, counterparty, project, place * 2 + 2 FROM dirty WHERE k % 101 = 0
""")

cte("ledger_nulled", "SELECT ordinal, " + ", ".join(_nulltok(c) for c in RAW_COLS) + " FROM ledger_raw", ["ledger_raw"])

cte("ledger_dedup", "SELECT * EXCLUDE (ordinal), count(*) AS n_copies, min(ordinal) AS ordinal FROM ledger_nulled GROUP BY ALL",
    ["ledger_nulled"])

cte("ledger_parsed", f"""
  SELECT {_PARSE_DATE} AS txn_date,
         {_norm('department_code')} AS department_code,
         {_norm('department')} AS department,
         {_norm('txn_type')} AS txn_type,
         COALESCE({_norm('expense_type')}, 'N/A') AS expense_type,
         {_PARSE_AMOUNT} AS amount,
         {_norm('owner')} AS owner,
         {_norm('counterparty')} AS counterparty,
         {_norm('project')} AS project,
         date_raw, amount_raw, n_copies, ordinal
  FROM ledger_dedup
""", ["ledger_dedup"])

cte("ledger_all", """
  SELECT txn_date, department_code, department, txn_type, expense_type, amount, owner, counterparty, project,
         CAST(CASE WHEN amount IS NULL THEN NULL
                   WHEN lower(trim(coalesce(txn_type, ''))) IN ('depense', 'dépense') THEN -abs(amount)
                   ELSE abs(amount) END AS DECIMAL(28,6)) AS signed_amount,
         CAST(year(txn_date) AS INTEGER) AS year, CAST(month(txn_date) AS INTEGER) AS month,
         CAST(quarter(txn_date) AS INTEGER) AS quarter, CAST(weekofyear(txn_date) AS INTEGER) AS iso_week,
         dayname(txn_date) AS day_name, CAST(dayofyear(txn_date) AS INTEGER) AS day_of_year,
         strftime(txn_date, '%Y-%m') AS year_month, CAST(year(txn_date) AS INTEGER) AS fiscal_year,
         date_raw, amount_raw, n_copies, ordinal,
         list_filter([CASE WHEN txn_date IS NULL THEN 'txn_date' END,
                      CASE WHEN amount IS NULL THEN 'amount' END,
                      CASE WHEN department IS NULL THEN 'department' END,
                      CASE WHEN txn_type IS NULL THEN 'txn_type' END,
                      CASE WHEN owner IS NULL THEN 'owner' END,
                      CASE WHEN counterparty IS NULL THEN 'counterparty' END,
                      CASE WHEN project IS NULL THEN 'project' END], lambda x: x IS NOT NULL) AS reasons
  FROM ledger_parsed
""", ["ledger_parsed"])

CLEAN_COLS = ("txn_date, department_code, department, txn_type, expense_type, amount, owner, counterparty, "
              "project, signed_amount, year, month, quarter, iso_week, day_name, day_of_year, year_month, fiscal_year")

cte("ledger", f"SELECT {CLEAN_COLS}, ordinal FROM ledger_all WHERE len(reasons) = 0", ["ledger_all"])


def build(final_sql: str, needs: list[str]) -> str:
    """``WITH`` the needed CTEs (dependencies first) followed by ``final_sql``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final_sql
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][0]})" for n in order) + "\n" + final_sql


S = "signed_amount"
REV = f"COALESCE(SUM(CASE WHEN {S} > 0 THEN {S} ELSE 0 END), 0)"
DEP = f"COALESCE(SUM(CASE WHEN {S} < 0 THEN -{S} ELSE 0 END), 0)"

ORACLE: dict[str, str] = {}


def oracle(name: str, final_sql: str, needs: list[str] | None = None) -> None:
    ORACLE[name] = build(final_sql, needs or [])


oracle("kpi_monthly", f"""
SELECT month, CAST(revenue AS DOUBLE) AS revenue, CAST(expenses AS DOUBLE) AS expenses,
       CAST(round(SUM(revenue - expenses) OVER (ORDER BY month NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS running_balance
FROM (SELECT strftime(txn_date, '%Y-%m') AS month, {REV} AS revenue, {DEP} AS expenses
      FROM ledger GROUP BY 1) m
ORDER BY month
""", ["ledger"])


# =========================================================================== shared pieces

LORD = ("txn_date NULLS FIRST, department NULLS FIRST, txn_type NULLS FIRST, expense_type NULLS FIRST, "
        "owner NULLS FIRST, counterparty NULLS FIRST, project NULLS FIRST, amount NULLS FIRST, "
        "signed_amount NULLS FIRST, department_code NULLS FIRST")
# First row seen: the smallest place in the upload; rows that share it, by the values taken from them.
FORD = "ordinal, department, txn_date"


def _cal(d: str) -> str:
    return (f"CAST(year({d}) AS INTEGER) AS year, CAST(month({d}) AS INTEGER) AS month, "
            f"CAST(quarter({d}) AS INTEGER) AS quarter, CAST(year({d}) AS INTEGER) AS fiscal_year, "
            f"dayname({d}) AS day_name, CAST(weekofyear({d}) AS INTEGER) AS iso_week, "
            f"CAST(dayofyear({d}) AS INTEGER) AS day_of_year, strftime({d}, '%Y-%m') AS year_month")


_DEPT_ID = "TRY_CAST(NULLIF(regexp_extract(department_code, '(\\d+)', 1), '') AS BIGINT)"

_CATEGORY = """CASE
  WHEN contains(lower(expense_type), 'salaire') OR contains(lower(expense_type), 'rh')
    OR contains(lower(expense_type), 'recrutement') OR contains(lower(expense_type), 'formation') THEN 'Ressources Humaines'
  WHEN contains(lower(expense_type), 'achat') OR contains(lower(expense_type), 'stock')
    OR contains(lower(expense_type), 'fournisseur') OR contains(lower(expense_type), 'matière') THEN 'Achats & Approvisionnement'
  WHEN contains(lower(expense_type), 'loyer') OR contains(lower(expense_type), 'immobilier')
    OR contains(lower(expense_type), 'infrastructure') THEN 'Infrastructure'
  WHEN contains(lower(expense_type), 'marketing') OR contains(lower(expense_type), 'publicité')
    OR contains(lower(expense_type), 'communication') THEN 'Marketing'
  WHEN contains(lower(expense_type), 'it') OR contains(lower(expense_type), 'informatique')
    OR contains(lower(expense_type), 'logiciel') OR contains(lower(expense_type), 'tech') THEN 'IT & Technologie'
  WHEN contains(lower(expense_type), 'revenu') OR contains(lower(expense_type), 'vente')
    OR contains(lower(expense_type), 'client') THEN 'Revenus'
  ELSE 'Autres' END"""


def _department(name: str, src: str) -> None:
    """One row per name, its largest number; of names that share one the first keeps it."""
    cte(name, f"""
      SELECT CASE WHEN department_id IS NULL OR place = 1 THEN department_id
                  ELSE (top + row_number() OVER (PARTITION BY department_id IS NOT NULL AND place > 1 ORDER BY department)) END
               AS department_id, department, department_code
      FROM (SELECT *, row_number() OVER (PARTITION BY department_id ORDER BY department) AS place,
                   max(department_id) OVER () AS top
            FROM (SELECT {_DEPT_ID} AS department_id, department, department_code,
                         row_number() OVER (PARTITION BY department ORDER BY {_DEPT_ID} DESC NULLS LAST,
                                            department_code DESC NULLS LAST) AS pick
                  FROM (SELECT DISTINCT department_code, department FROM {src} WHERE department IS NOT NULL))
            WHERE pick = 1)""", [src])


def _full_dims(prefix: str, src: str) -> None:
    """Full-rebuild dimensions of ``src`` as CTEs ``{prefix}_date`` ... ``{prefix}_project``."""
    cte(f"{prefix}_date", f"""
      SELECT CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS date_id, date, {_cal('date')}
      FROM (SELECT DISTINCT txn_date AS date FROM {src} WHERE txn_date IS NOT NULL)""", [src])
    _department(f"{prefix}_department", src)
    cte(f"{prefix}_owner", f"""
      SELECT CAST(row_number() OVER (ORDER BY owner) AS BIGINT) AS owner_id, owner, department
      FROM (SELECT owner, department, row_number() OVER (PARTITION BY owner ORDER BY {FORD}) AS rn
            FROM {src} WHERE owner IS NOT NULL) WHERE rn = 1""", [src])
    cte(f"{prefix}_txn_type", f"""
      SELECT CAST(row_number() OVER (ORDER BY txn_type) AS BIGINT) AS txn_type_id, txn_type
      FROM (SELECT DISTINCT txn_type FROM {src} WHERE txn_type IS NOT NULL)""", [src])
    cte(f"{prefix}_expense_type", f"""
      SELECT CAST(row_number() OVER (ORDER BY expense_type) AS BIGINT) AS expense_type_id, expense_type,
             {_CATEGORY} AS category
      FROM (SELECT DISTINCT expense_type FROM {src} WHERE expense_type IS NOT NULL)""", [src])
    cte(f"{prefix}_counterparty", f"""
      SELECT CAST(row_number() OVER (ORDER BY counterparty) AS BIGINT) AS counterparty_id, counterparty,
             CASE WHEN txn_type = 'Revenu' THEN 'Client' ELSE 'Fournisseur' END AS kind
      FROM (SELECT counterparty, txn_type, row_number() OVER (PARTITION BY counterparty ORDER BY ordinal, txn_type) AS rn
            FROM {src} WHERE counterparty IS NOT NULL) WHERE rn = 1""", [src])
    cte(f"{prefix}_project", f"""
      SELECT CAST(row_number() OVER (ORDER BY project) AS BIGINT) AS project_id, project, start_date, end_date
      FROM (SELECT project, min(txn_date) AS start_date, max(txn_date) AS end_date
            FROM {src} WHERE project IS NOT NULL GROUP BY project)""", [src])


def _facts(name: str, resolved: str, start_sql: str = "0") -> None:
    cte(name, f"""
      SELECT CAST(({start_sql}) + row_number() OVER (ORDER BY {LORD}) AS BIGINT) AS transaction_id,
             date_id, department_id, txn_type_id, expense_type_id, owner_id, counterparty_id, project_id,
             CAST(round(amount, 2) AS DECIMAL(28,6)) AS amount, CAST(signed_amount AS DECIMAL(28,6)) AS signed_amount
      FROM {resolved} WHERE resolved""", [resolved])


def _resolve(name: str, src: str, dims: dict[str, str], strict: bool, owner_by_name: bool) -> None:
    owner_on = "l.owner = o.owner" if owner_by_name else "l.owner = o.owner AND l.department = o.department"
    ok = ("d.date_id IS NOT NULL AND dp.department_id IS NOT NULL AND tt.txn_type_id IS NOT NULL AND "
          "et.expense_type_id IS NOT NULL AND o.owner_id IS NOT NULL AND c.counterparty_id IS NOT NULL AND "
          "p.project_id IS NOT NULL") if strict else "d.date_id IS NOT NULL"
    cte(name, f"""
      SELECT l.*, d.date_id, dp.department_id, tt.txn_type_id, et.expense_type_id, o.owner_id,
             c.counterparty_id, p.project_id, ({ok}) AS resolved
      FROM {src} l
      LEFT JOIN {dims['date']} d ON l.txn_date = d.date
      LEFT JOIN {dims['department']} dp ON l.department = dp.department
      LEFT JOIN {dims['txn_type']} tt ON l.txn_type = tt.txn_type
      LEFT JOIN {dims['expense_type']} et ON l.expense_type = et.expense_type
      LEFT JOIN {dims['owner']} o ON {owner_on}
      LEFT JOIN {dims['counterparty']} c ON l.counterparty = c.counterparty
      LEFT JOIN {dims['project']} p ON l.project = p.project""", [src, *dims.values()])


# ---- load scenario: rebuild from the first upload, then load the whole ledger
cte("upload1", "SELECT * FROM ledger WHERE txn_date < DATE '1997-01-01'", ["ledger"])
_full_dims("s1", "upload1")
S1 = {k: f"s1_{k}" for k in ["date", "department", "txn_type", "expense_type", "owner", "counterparty", "project"]}
_resolve("s1_resolved", "upload1", S1, strict=False, owner_by_name=True)
_facts("s1_facts", "s1_resolved")

cte("s2_date", f"""
  SELECT * FROM s1_date
  UNION ALL
  SELECT CAST((SELECT coalesce(max(date_id), 0) FROM s1_date) + row_number() OVER (ORDER BY date) AS BIGINT) AS date_id,
         date, {_cal('date')}
  FROM (SELECT DISTINCT txn_date AS date FROM ledger l WHERE txn_date IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM s1_date x WHERE x.date = l.txn_date))""", ["s1_date", "ledger"])
cte("s2_owner", """
  SELECT * FROM s1_owner
  UNION ALL
  SELECT CAST((SELECT coalesce(max(owner_id), 0) FROM s1_owner) + row_number() OVER (ORDER BY owner, department) AS BIGINT),
         owner, department
  FROM (SELECT DISTINCT owner, department FROM ledger l WHERE owner IS NOT NULL AND department IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM s1_owner x WHERE x.owner = l.owner AND x.department = l.department))""",
    ["s1_owner", "ledger"])
cte("s2_counterparty", f"""
  SELECT * FROM s1_counterparty
  UNION ALL
  SELECT CAST((SELECT coalesce(max(counterparty_id), 0) FROM s1_counterparty)
              + row_number() OVER (ORDER BY counterparty) AS BIGINT),
         counterparty, CASE WHEN lower(trim(txn_type)) = 'revenu' THEN 'Client' ELSE 'Fournisseur' END
  FROM (SELECT counterparty, txn_type FROM (
          SELECT counterparty, txn_type, row_number() OVER (PARTITION BY counterparty ORDER BY ordinal, txn_type) AS rn
          FROM ledger WHERE counterparty IS NOT NULL AND txn_type IS NOT NULL) WHERE rn = 1) f
  WHERE NOT EXISTS (SELECT 1 FROM s1_counterparty x WHERE x.counterparty = f.counterparty)""",
    ["s1_counterparty", "ledger"])
cte("s2_project", """
  SELECT * FROM s1_project
  UNION ALL
  SELECT CAST((SELECT coalesce(max(project_id), 0) FROM s1_project) + row_number() OVER (ORDER BY project) AS BIGINT),
         project, start_date, end_date
  FROM (SELECT project, min(txn_date) AS start_date, max(txn_date) AS end_date
        FROM ledger WHERE project IS NOT NULL GROUP BY project) f
  WHERE NOT EXISTS (SELECT 1 FROM s1_project x WHERE x.project = f.project)""", ["s1_project", "ledger"])
S2 = {"date": "s2_date", "department": "s1_department", "txn_type": "s1_txn_type",
      "expense_type": "s1_expense_type", "owner": "s2_owner", "counterparty": "s2_counterparty",
      "project": "s2_project"}
_resolve("s2_resolved", "ledger", S2, strict=True, owner_by_name=False)
_facts("s2_facts", "s2_resolved")

# ---- whole-ledger rebuild (lenient facts)
_full_dims("f", "ledger")
F_DIMS = {k: f"f_{k}" for k in ["date", "department", "txn_type", "expense_type", "owner", "counterparty", "project"]}
_resolve("f_resolved", "ledger", F_DIMS, strict=False, owner_by_name=True)
_facts("f_facts", "f_resolved")


def _kpi_base(name: str, facts: str, dims: dict[str, str]) -> None:
    cte(name, f"""
      SELECT f.amount, f.signed_amount, d.year, d.quarter, d.year_month, dp.department, f.department_id,
             tt.txn_type, et.expense_type
      FROM {facts} f
      LEFT JOIN {dims['date']} d ON f.date_id = d.date_id
      LEFT JOIN {dims['department']} dp ON f.department_id = dp.department_id
      LEFT JOIN {dims['txn_type']} tt ON f.txn_type_id = tt.txn_type_id
      LEFT JOIN {dims['expense_type']} et ON f.expense_type_id = et.expense_type_id""", [facts, *dims.values()])


_kpi_base("kb1", "s1_facts", S1)
_kpi_base("kb2", "s2_facts", S2)

_Z = "CAST(0 AS DECIMAL(28,6))"


def _refresh(prefix: str, base: str) -> None:
    """Refresh parts as CTEs {prefix}_global ... {prefix}_monthly, and {prefix}_all."""
    cte(f"{prefix}_g", f"""
      SELECT coalesce(sum(coalesce(amount, {_Z})), {_Z}) AS tot, coalesce(sum(coalesce(signed_amount, {_Z})), {_Z}) AS net,
             coalesce(sum(CASE WHEN signed_amount > 0 THEN signed_amount END), {_Z}) AS rev,
             abs(coalesce(sum(CASE WHEN signed_amount < 0 THEN signed_amount END), {_Z})) AS dep,
             count(*) AS n
      FROM {base}""", [base])
    cte(f"{prefix}_global", f"""
      SELECT k AS kpi_name, 'global' AS period, v AS value, CAST(0.0 AS DOUBLE) AS evolution, CAST(NULL AS BIGINT) AS department_id,
             s AS stat_type, 'etl_auto' AS source, 0 AS part, lpad(CAST(i AS VARCHAR), 2, '0') AS position
      FROM (
        SELECT 'CA_Total' AS k, CAST(round(tot, 2) AS DOUBLE) AS v, 'sum' AS s, 0 AS i FROM {prefix}_g UNION ALL
        SELECT 'Solde_Net', CAST(round(net, 2) AS DOUBLE), 'sum', 1 FROM {prefix}_g UNION ALL
        SELECT 'Revenus', CAST(round(rev, 2) AS DOUBLE), 'sum', 2 FROM {prefix}_g UNION ALL
        SELECT 'Dépenses', CAST(round(dep, 2) AS DOUBLE), 'sum', 3 FROM {prefix}_g UNION ALL
        SELECT 'Nb_Transactions', CAST(n AS DOUBLE), 'count', 4 FROM {prefix}_g UNION ALL
        SELECT 'Valeur_Moyenne', CASE WHEN n > 0 THEN {_div2('tot', 'CAST(n AS DECIMAL(38,0))')} ELSE 0.0 END, 'avg', 5
          FROM {prefix}_g UNION ALL
        SELECT 'Ratio_Dep_Rev', CASE WHEN rev <> 0 THEN {_div2('dep', 'rev', True)} ELSE 0.0 END, 'ratio', 6 FROM {prefix}_g
      )""", [f"{prefix}_g"])
    cte(f"{prefix}_quarter", f"""
      SELECT 'CA_' || key AS kpi_name, key AS period, CAST(round(tot, 2) AS DOUBLE) AS value, CAST(0.0 AS DOUBLE) AS evolution,
             CAST(NULL AS BIGINT) AS department_id, 'sum' AS stat_type, 'etl_auto' AS source, 1 AS part,
             'CA_' || key AS position
      FROM (SELECT 'Q' || CAST(coalesce(quarter, 0) AS VARCHAR) || '_' || CAST(coalesce(year, 0) AS VARCHAR) AS key,
                   coalesce(sum(amount), {_Z}) AS tot FROM {base} GROUP BY 1)""", [base])
    cte(f"{prefix}_department", f"""
      SELECT 'CA_' || dep AS kpi_name, 'global' AS period, CAST(round(tot, 2) AS DOUBLE) AS value, CAST(0.0 AS DOUBLE) AS evolution,
             CAST(dept_id AS BIGINT) AS department_id, 'sum' AS stat_type, 'etl_auto' AS source, 2 AS part,
             'CA_' || dep AS position
      FROM (SELECT coalesce(nullif(department, ''), 'Inconnu') AS dep, coalesce(sum(amount), {_Z}) AS tot,
                   max(department_id) AS dept_id FROM {base} GROUP BY 1)""", [base])
    for part, (nm, col, pre) in enumerate([("txn_type", "txn_type", "Vol_"), ("expense_type", "expense_type", "Dep_")],
                                          start=3):
        cte(f"{prefix}_{nm}", f"""
          SELECT '{pre}' || k AS kpi_name, 'global' AS period, CAST(round(tot, 2) AS DOUBLE) AS value, CAST(0.0 AS DOUBLE) AS evolution,
                 CAST(NULL AS BIGINT) AS department_id, 'sum' AS stat_type, 'etl_auto' AS source, {part} AS part,
                 '{pre}' || k AS position
          FROM (SELECT coalesce(nullif({col}, ''), 'Autre') AS k, coalesce(sum(amount), {_Z}) AS tot
                FROM {base} GROUP BY 1)""", [base])
    cte(f"{prefix}_monthly", f"""
      SELECT 'CA_Mensuel' AS kpi_name, ym AS period, CAST(val AS DOUBLE) AS value,
             CASE WHEN prev <> 0 THEN {_div2('val - prev', 'prev', True)} ELSE 0.0 END AS evolution,
             CAST(NULL AS BIGINT) AS department_id, 'sum' AS stat_type, 'etl_auto' AS source, 5 AS part, ym AS position
      FROM (SELECT ym, val, coalesce(lag(val) OVER (ORDER BY ym), val) AS prev
            FROM (SELECT coalesce(nullif(year_month, ''), '0000-00') AS ym, round(coalesce(sum(amount), {_Z}), 2) AS val
                  FROM {base} GROUP BY 1))""", [base])
    parts = ["global", "quarter", "department", "txn_type", "expense_type", "monthly"]
    cte(f"{prefix}_all", " UNION ALL ".join(f"SELECT * FROM {prefix}_{p}" for p in parts),
        [f"{prefix}_{p}" for p in parts])


_refresh("r1", "kb1")
_refresh("r2", "kb2")

_T0 = "TIMESTAMP '2024-01-01 00:00:00'"
_T1 = "TIMESTAMP '2024-06-01 00:00:00'"
STORE_COLS = "id, kpi_name, period, value, evolution, department_id, source, stat_type, created_at, updated_at"

cte("store1", f"""
  SELECT CAST(rk AS BIGINT) AS id, kpi_name, period, value, evolution, department_id, source, stat_type,
         {_T0} + to_seconds(rk - 1) AS created_at, {_T0} + to_seconds(rk - 1) AS updated_at
  FROM (SELECT *, row_number() OVER (ORDER BY part, position) AS rk FROM r1_all)""", ["r1_all"])
cte("kept2", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kpi_name, period ORDER BY part DESC, position DESC) AS rn
                 FROM r2_all) WHERE rn = 1""", ["r2_all"])
cte("merged", f"""
  SELECT {STORE_COLS} FROM store1 s
  WHERE NOT EXISTS (SELECT 1 FROM kept2 k WHERE k.kpi_name = s.kpi_name AND k.period = s.period)
  UNION ALL
  SELECT CAST((SELECT coalesce(max(id), 0) FROM store1) + rk AS BIGINT) AS id, kpi_name, period, value, evolution,
         department_id, source, stat_type, {_T1} + to_seconds(rk - 1), {_T1} + to_seconds(rk - 1)
  FROM (SELECT *, row_number() OVER (ORDER BY part, position) AS rk FROM kept2)""", ["store1", "kept2"])

# ---- application tables bound onto the test data
cte("app_users", """
  SELECT user_id AS id,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'Prenom' || CAST(user_id AS VARCHAR) END AS firstname,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'Nom' || CAST(user_id AS VARCHAR) END AS lastname,
         CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.org' END AS email,
         CASE WHEN user_id % 50 = 0 THEN 'admin' END AS role,
         CASE WHEN user_id % 3 = 0 THEN 'google' WHEN user_id % 3 = 1 THEN NULL ELSE 'email' END AS login_type,
         min(ts) AS created_at
  FROM events GROUP BY user_id""")
cte("history", """
  SELECT o_orderkey AS id, o_custkey AS user_id, 'import_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS file_name,
         o_orderdate AS imported_at, CAST(floor(o_totalprice / 100) AS BIGINT) AS n_rows, o_orderkey % 4 AS n_errors,
         CASE WHEN o_orderstatus = 'F' THEN 'echec' WHEN o_orderkey % 4 > 0 THEN 'partiel' ELSE 'succes' END AS status,
         o_orderpriority AS department,
         CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'importer' || CAST(o_custkey % 17 AS VARCHAR) END AS imported_by,
         o_orderstatus = 'F' AS failed, o_orderkey % 7 AS n_items, o_orderstatus, o_orderpriority
  FROM orders""")
cte("history_users", """
  SELECT h.*, u.firstname, u.lastname, u.email,
         coalesce(nullif(trim(concat_ws(' ', coalesce(u.firstname, ''), coalesce(u.lastname, ''))), ''),
                  nullif(u.email, ''), nullif(h.imported_by, ''), 'User ' || coalesce(CAST(h.user_id AS VARCHAR), 'None'))
           AS user_name
  FROM history h LEFT JOIN app_users u ON h.user_id = u.id""", ["history", "app_users"])
cte("forecasts", """
  SELECT event_id AS id, event_type AS type, CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) + 30 AS end_date,
         props AS results, CAST(user_id % 25 + 1 AS BIGINT) AS department_id, user_id AS created_by, ts AS created_at
  FROM events""")

_USER_LABEL = "strftime(created_at, '%Y-%m-%d %H:%M')"
_KPI = (f"SELECT count(*) AS n_transactions, {REV} AS rev, {DEP} AS dep, COALESCE(SUM({S}), 0) AS net, "
        f"SUM(abs({S})) AS abs_sum, count({S}) AS n_s FROM ")


def _kpi_global_sql(src: str) -> str:
    return f"""
SELECT CAST(round(rev, 2) AS DOUBLE) AS total_revenue, CAST(round(dep, 2) AS DOUBLE) AS total_expenses,
       CAST(round(net, 2) AS DOUBLE) AS net_balance,
       CASE WHEN rev > 0 THEN {_div2('net', 'rev', True)} ELSE 0.0 END AS net_margin,
       n_transactions, COALESCE({_div2('abs_sum', 'CAST(n_s AS DECIMAL(38,0))')}, 0.0) AS mean_transaction
FROM ({_KPI} {src}) g"""


# =========================================================================== queries

oracle("null_tokens", "SELECT * EXCLUDE (ordinal) FROM ledger_nulled", ["ledger_nulled"])
oracle("amount_parse", f"SELECT amount_raw, {_PARSE_AMOUNT} AS amount FROM ledger_nulled", ["ledger_nulled"])
oracle("text_normalize", f"""
SELECT department AS text_raw, {_norm('department')} AS text, owner AS owner_raw, {_norm('owner')} AS owner
FROM ledger_raw""", ["ledger_raw"])
oracle("signed_amount", "SELECT txn_type, amount, signed_amount FROM ledger", ["ledger"])
oracle("signed_amount_legacy", """
SELECT txn_type, amount,
       CAST(CASE WHEN amount IS NULL THEN NULL WHEN txn_type = 'Revenu' THEN amount ELSE -amount END AS DECIMAL(28,6))
         AS signed_legacy,
       CASE WHEN txn_type = 'Revenu' THEN 'Positif' ELSE 'Négatif' END AS sign_label
FROM ledger""", ["ledger"])
oracle("calendar_attributes", """
SELECT txn_date, year, month, quarter, iso_week, day_name, day_of_year, year_month, fiscal_year FROM ledger""",
       ["ledger"])
oracle("department_id", f"SELECT department_code, {_DEPT_ID} AS department_id FROM ledger_raw", ["ledger_raw"])
oracle("expense_category", "SELECT expense_type, category FROM f_expense_type", ["f_expense_type"])
oracle("display_name", """
SELECT id, coalesce(nullif(trim(concat_ws(' ', coalesce(firstname, ''), coalesce(lastname, ''))), ''),
                    nullif(email, '')) AS display_name
FROM app_users""", ["app_users"])
oracle("json_payload", """
SELECT event_id AS id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k, coalesce(json_valid(props), false) AS is_json
FROM events""")
oracle("json_safe", f"""
SELECT CAST(to_json({{'department_id': department_id, 'n_transactions': n_transactions,
                 'ratio': CASE WHEN isnan(ratio) OR isinf(ratio) THEN NULL ELSE ratio END}}) AS VARCHAR) AS json
FROM (SELECT {_DEPT_ID} AS department_id, count(*) AS n_transactions,
             CAST({REV} AS DOUBLE) / CAST({DEP} AS DOUBLE) AS ratio
      FROM ledger GROUP BY 1)""", ["ledger"])
oracle("reject_invalid", """
SELECT date_raw, amount_raw, department, txn_type, owner, counterparty, project, reasons
FROM ledger_all WHERE len(reasons) > 0""", ["ledger_all"])
oracle("dedup_exact", "SELECT DISTINCT * EXCLUDE (ordinal) FROM ledger_nulled", ["ledger_nulled"])
oracle("period_filter", _kpi_global_sql(
    "ledger WHERE txn_date >= DATE '1996-03-01' AND txn_date < DATE '1996-04-01'"), ["ledger"])
oracle("department_filter", _kpi_global_sql(f"ledger WHERE {_DEPT_ID} = 5"), ["ledger"])
oracle("kpi_lookup", f"""
SELECT {STORE_COLS} FROM merged WHERE kpi_name = 'CA_Mensuel'
ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST LIMIT 100""", ["merged"])
oracle("forecast_read", """
SELECT id, type, start_date, end_date, department_id, created_by, created_at FROM forecasts
WHERE department_id = 3 ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST LIMIT 50""", ["forecasts"])
oracle("history_scope_admin", "SELECT id, user_id, user_name, imported_at FROM history_users", ["history_users"])
oracle("history_scope_user", "SELECT id, user_id, user_name, imported_at FROM history_users WHERE user_id = 7",
       ["history_users"])

for _n, _dim in [("dim_upsert_date", "s2_date"), ("dim_upsert_owner", "s2_owner"),
                 ("dim_upsert_counterparty", "s2_counterparty"), ("dim_upsert_project", "s2_project"),
                 ("dim_department", "f_department"), ("dim_txn_type", "f_txn_type"),
                 ("dim_expense_type", "f_expense_type"), ("fact_load", "s2_facts"),
                 ("fact_load_lenient", "f_facts"), ("kpi_base", "kb2"), ("kpi_merge", "merged")]:
    oracle(_n, f"SELECT * FROM {_dim}", [_dim])

cte("s2_appended", """
  SELECT * FROM s1_facts
  UNION ALL
  SELECT CAST((SELECT coalesce(max(transaction_id), 0) FROM s1_facts) + transaction_id AS BIGINT), date_id,
         department_id, txn_type_id, expense_type_id, owner_id, counterparty_id, project_id, amount, signed_amount
  FROM s2_facts""", ["s1_facts", "s2_facts"])
oracle("fact_append", "SELECT * FROM s2_appended", ["s2_appended"])

oracle("star_flatten", """
SELECT f.transaction_id, CAST(f.amount AS DOUBLE) AS amount, CAST(f.signed_amount AS DOUBLE) AS signed_amount,
       d.date, d.year, d.month, d.quarter, d.year_month, dp.department, tt.txn_type, et.expense_type, o.owner,
       c.counterparty, c.kind AS counterparty_kind, p.project
FROM s2_facts f
LEFT JOIN s2_date d ON f.date_id = d.date_id
LEFT JOIN s1_department dp ON f.department_id = dp.department_id
LEFT JOIN s1_txn_type tt ON f.txn_type_id = tt.txn_type_id
LEFT JOIN s1_expense_type et ON f.expense_type_id = et.expense_type_id
LEFT JOIN s2_owner o ON f.owner_id = o.owner_id
LEFT JOIN s2_counterparty c ON f.counterparty_id = c.counterparty_id
LEFT JOIN s2_project p ON f.project_id = p.project_id
ORDER BY d.date DESC NULLS LAST, f.transaction_id ASC""",
       ["s2_facts", "s2_date", "s1_department", "s1_txn_type", "s1_expense_type", "s2_owner", "s2_counterparty",
        "s2_project"])
ORACLE["star_flatten_newest"] = ORACLE["star_flatten"] + " LIMIT 50000"
cte("recoded", f"""
  SELECT * EXCLUDE (department_code),
         CASE WHEN day_of_year % 5 = 0 THEN NULL WHEN day_of_year % 7 = 0 THEN department_code || '0'
              WHEN department IN ('NATION 3', 'NATION 9') THEN 'DEPT777' ELSE department_code END AS department_code
  FROM ledger""", ["ledger"])
_department("rc_department", "recoded")
oracle("dim_department_recoded", "SELECT * FROM rc_department", ["rc_department"])
oracle("facts_recoded", """
SELECT d.department_id, count(*) AS n_facts, CAST(sum(round(l.amount, 2)) AS DOUBLE) AS amount
FROM recoded l LEFT JOIN rc_department d USING (department) GROUP BY d.department_id""", ["recoded", "rc_department"])
oracle("history_users", "SELECT id, user_id, firstname, lastname, email, user_name FROM history_users",
       ["history_users"])

oracle("kpi_global", _kpi_global_sql("ledger"), ["ledger"])
oracle("kpi_by_department", f"""
SELECT {_DEPT_ID} AS department_id, count(*) AS n_transactions, CAST({REV} AS DOUBLE) AS revenue,
       CAST({DEP} AS DOUBLE) AS expenses, CAST(COALESCE(SUM({S}), 0) AS DOUBLE) AS balance
FROM ledger GROUP BY 1""", ["ledger"])
oracle("top_expense_types", f"""
SELECT coalesce(expense_type, 'Non classé') AS expense_type, n_transactions, CAST(tot AS DOUBLE) AS total_amount,
       {_div2('tot', 'CAST(n AS DECIMAL(38,0))')} AS mean_amount
FROM (SELECT expense_type, count(*) AS n_transactions, sum(-{S}) AS tot, count({S}) AS n
      FROM ledger WHERE {S} < 0 GROUP BY expense_type)
ORDER BY total_amount DESC, expense_type NULLS FIRST LIMIT 10""", ["ledger"])
oracle("top_projects", f"""
SELECT coalesce(project, '—') AS project, n_transactions, CAST(tot AS DOUBLE) AS total_amount,
       {_div2('tot', 'CAST(n AS DECIMAL(38,0))')} AS mean_amount, CAST(rev AS DOUBLE) AS revenue,
       CAST(dep AS DOUBLE) AS expenses
FROM (SELECT project, count(*) AS n_transactions, sum(abs({S})) AS tot, count({S}) AS n,
             sum(CASE WHEN {S} > 0 THEN {S} ELSE 0 END) AS rev, sum(CASE WHEN {S} < 0 THEN -{S} ELSE 0 END) AS dep
      FROM ledger GROUP BY project)
ORDER BY total_amount DESC, project NULLS FIRST LIMIT 10""", ["ledger"])
oracle("top_counterparties", f"""
SELECT coalesce(counterparty, '—') AS counterparty, n_transactions, CAST(tot AS DOUBLE) AS total_amount
FROM (SELECT counterparty, count(*) AS n_transactions, sum(abs({S})) AS tot FROM ledger GROUP BY counterparty)
ORDER BY total_amount DESC, counterparty NULLS FIRST LIMIT 10""", ["ledger"])
oracle("load_stats", f"""
SELECT count(*) AS n_rows, 18 AS n_columns, CAST(round(coalesce(sum(amount), 0), 2) AS DOUBLE) AS total,
       CAST(round(coalesce(sum({S}), 0), 2) AS DOUBLE) AS balance,
       CAST(round(coalesce(sum(CASE WHEN {S} > 0 THEN {S} END), 0), 2) AS DOUBLE) AS revenue,
       CAST(round(coalesce(sum(CASE WHEN {S} < 0 THEN {S} END), 0), 2) AS DOUBLE) AS expenses_signed
FROM ledger""", ["ledger"])
oracle("quality_counters", """
SELECT n_read, n_duplicates, n_rejected, n_valid, n_skipped, n_inserted, least(n_read, n_valid) AS n_changed
FROM (SELECT CAST(sum(n_copies) AS BIGINT) AS n_read, CAST(sum(n_copies - 1) AS BIGINT) AS n_duplicates,
             count(*) FILTER (WHERE len(reasons) > 0) AS n_rejected, count(*) FILTER (WHERE len(reasons) = 0) AS n_valid
      FROM ledger_all) a,
     (SELECT count(*) FILTER (WHERE NOT resolved) AS n_skipped, count(*) FILTER (WHERE resolved) AS n_inserted
      FROM s2_resolved) b""", ["ledger_all", "s2_resolved"])
oracle("reject_reasons", """
SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM ledger_all) GROUP BY reason""",
       ["ledger_all"])
for _n, _part in [("refresh_global", "global"), ("refresh_quarter", "quarter"), ("refresh_department", "department"),
                  ("refresh_txn_type", "txn_type"), ("refresh_expense_type", "expense_type"),
                  ("monthly_evolution", "monthly")]:
    oracle(_n, f"SELECT * EXCLUDE (part, position) FROM r2_{_part}", [f"r2_{_part}"])
_kpi_base("kb3", "s2_appended", S2)
_refresh("r3", "kb3")
oracle("kpi_refresh_incremental", "SELECT * FROM r3_all", ["r3_all"])
oracle("kpi_refresh_all", "SELECT * FROM r2_all", ["r2_all"])
oracle("project_span", """
SELECT project, min(txn_date) AS start_date, max(txn_date) AS end_date FROM ledger
WHERE project IS NOT NULL GROUP BY project""", ["ledger"])
oracle("user_stats", """
SELECT count(*) AS total_users,
       count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-02') AS new_today,
       count(*) FILTER (WHERE created_at >= TIMESTAMP '2023-12-26 00:00:00') AS active_week,
       count(*) FILTER (WHERE login_type = 'google') AS google_users,
       count(*) FILTER (WHERE login_type = 'email' OR login_type IS NULL OR login_type = '') AS email_users,
       count(*) FILTER (WHERE role = 'admin') AS admin_count
FROM app_users""", ["app_users"])
oracle("registrations_daily", """
SELECT CAST(created_at AS DATE) AS day, count(*) AS n_users FROM app_users GROUP BY 1 ORDER BY 1""", ["app_users"])
oracle("login_split", """
SELECT coalesce(login_type, 'email') AS login_type, count(*) AS n_users FROM app_users GROUP BY 1""", ["app_users"])
oracle("activity_weekly", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, count(DISTINCT user_id) AS active_users
FROM events GROUP BY 1""")
oracle("kpi_keyword_total", """
SELECT coalesce(sum(CASE WHEN contains(strip_accents(lower(kpi_name)), 'revenu') THEN value END), 0.0) AS total
FROM merged""", ["merged"])
oracle("history_groups", """
SELECT user_name, row_number() OVER (PARTITION BY user_name ORDER BY imported_at DESC NULLS LAST, id DESC) AS item_no,
       id, strftime(imported_at, '%Y-%m-%d %H:%M') AS imported_at_label, coalesce(status, 'succes') AS status,
       CAST(to_json(list_transform(range(id % 7), lambda i: {'order': id, 'status': o_orderstatus, 'priority': o_orderpriority})) AS VARCHAR) AS data
FROM history_users""", ["history_users"])
oracle("first_per_key", f"""
SELECT owner, department, txn_date FROM (
  SELECT owner, department, txn_date, row_number() OVER (PARTITION BY owner ORDER BY {FORD}) AS rn FROM ledger)
WHERE rn = 1""", ["ledger"])
oracle("latest_n", """
SELECT id, user_id, imported_at, status FROM history ORDER BY imported_at DESC NULLS LAST, id DESC LIMIT 200""",
       ["history"])
_SEARCH = ("(coalesce(contains(lower(firstname), 'nom1'), false) OR coalesce(contains(lower(lastname), 'nom1'), false) "
           "OR coalesce(contains(lower(email), 'nom1'), false))")
oracle("users_page", f"""
SELECT id, firstname, lastname, email, coalesce(role, 'user') AS role, coalesce(login_type, 'email') AS login_type,
       {_USER_LABEL} AS created_at
FROM app_users WHERE {_SEARCH} ORDER BY id LIMIT 10 OFFSET 10""", ["app_users"])
oracle("users_search_total", f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM app_users WHERE {_SEARCH}""",
       ["app_users"])
oracle("users_list", f"""
SELECT id, firstname, lastname, email, {_USER_LABEL} AS created_at, coalesce(login_type, 'email') AS login_type,
       coalesce(role, 'user') AS role
FROM app_users ORDER BY id DESC""", ["app_users"])
oracle("users_export", f"""
SELECT id, concat_ws(',', CAST(id AS VARCHAR), coalesce(firstname, 'None'), coalesce(lastname, 'None'),
                     coalesce(email, 'None'), coalesce(role, 'user'), coalesce(login_type, 'email'),
                     coalesce({_USER_LABEL}, 'None')) AS line
FROM app_users ORDER BY id""", ["app_users"])
oracle("kpi_merge_counts", """
SELECT CAST((SELECT count(*) FROM r2_all) AS BIGINT) AS inserted,
       CAST((SELECT count(*) FROM store1 s WHERE EXISTS (SELECT 1 FROM kept2 k WHERE k.kpi_name = s.kpi_name
                                                          AND k.period = s.period))
            + (SELECT count(*) FROM r2_all) - (SELECT count(*) FROM kept2) AS BIGINT) AS replaced""",
       ["r2_all", "store1", "kept2"])
oracle("audit_status", """
SELECT id, n_errors, CASE WHEN failed THEN 'echec' WHEN n_errors > 0 THEN 'partiel' ELSE 'succes' END AS status
FROM history""", ["history"])
oracle("history_detail", """
SELECT id,
       CASE WHEN n_items > 0 THEN ['order', 'status', 'priority'] ELSE CAST([] AS VARCHAR[]) END AS columns,
       CAST(n_items AS BIGINT) AS rows_count,
       CAST(to_json(list_transform(range(least(n_items, 5)),
            lambda i: {'order': id, 'status': o_orderstatus, 'priority': o_orderpriority})) AS VARCHAR)
         AS preview
FROM history""", ["history"])

_MSG = "lower(trim(regexp_replace(coalesce(text, ''), '\\s', ' ', 'g')))"
_TOTALS = """
  (SELECT sum(CASE WHEN contains(strip_accents(lower(kpi_name)), 'revenu') THEN value END) FROM merged) AS rev_total,
  (SELECT sum(CASE WHEN contains(strip_accents(lower(kpi_name)), 'depense') THEN value END) FROM merged) AS dep_total,
  (SELECT count(*) FROM app_users) AS n_users"""
oracle("message_intent", f"""
SELECT conv_id, turn, intent,
       CASE intent
         WHEN 'empty' THEN 'Posez-moi une question sur vos données !'
         WHEN 'revenue' THEN 'Le revenu total détecté est de ' || format('{{:,.2f}}', coalesce(nullif(rev_total, 0.0), 0.0)) || ' €.'
         WHEN 'expense' THEN 'Les dépenses s''élèvent à ' || format('{{:,.2f}}', coalesce(nullif(dep_total, 0.0), 0.0)) || ' €.'
         WHEN 'users' THEN 'Il y a actuellement ' || CAST(n_users AS VARCHAR) || ' utilisateurs enregistrés.'
         ELSE 'Je peux vous aider sur les revenus, dépenses ou utilisateurs.' END AS answer
FROM (
  SELECT conv_id, turn,
         CASE WHEN m = '' THEN 'empty'
              WHEN contains(m, 'revenu') OR contains(m, 'argent') OR contains(m, 'gagné') OR contains(m, 'ca') THEN 'revenue'
              WHEN contains(m, 'dépense') OR contains(m, 'depense') OR contains(m, 'coût') OR contains(m, 'cout')
                OR contains(m, 'perdu') THEN 'expense'
              WHEN contains(m, 'utilisateur') OR contains(m, 'client') OR contains(m, 'membre') THEN 'users'
              ELSE 'help' END AS intent, {_TOTALS}
  FROM (SELECT conv_id, turn, {_MSG} AS m FROM conversations))""", ["merged", "app_users"])

oracle("email_user", """
SELECT id, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 1) AS "user" FROM app_users""",
       ["app_users"])
oracle("import_audit", """
SELECT CAST(1 AS BIGINT) AS user_id, 'ledger.csv' AS file_name, TIMESTAMP '2024-03-01 09:30:00' AS imported_at,
       n_inserted AS n_rows, n_rejected + n_skipped AS n_errors, 'Finance' AS department, 'importer1' AS imported_by,
       CASE WHEN n_rejected + n_skipped > 0 THEN 'partiel' ELSE 'succes' END AS status
FROM (SELECT count(*) FILTER (WHERE len(reasons) > 0) AS n_rejected FROM ledger_all) a,
     (SELECT count(*) FILTER (WHERE NOT resolved) AS n_skipped, count(*) FILTER (WHERE resolved) AS n_inserted
      FROM s2_resolved) b""", ["ledger_all", "s2_resolved"])

for _n, _dim in [("dim_date", "f_date"), ("dim_owner", "f_owner"), ("dim_counterparty", "f_counterparty"),
                 ("dim_project", "f_project")]:
    oracle(_n, f"SELECT * FROM {_dim}", [_dim])
ORACLE["ledger_csv_roundtrip"] = ORACLE["null_tokens"]
ORACLE["period_filter_stored"] = ORACLE["period_filter"]

# ---- first-generation cleaner: per-column Latin-1/UTF-8 repair, then its own rules.
# A value is repairable when every character is <= U+00FF and those bytes form valid
# UTF-8 (pattern below, over code points); a column is repaired only if all its
# non-null values are.
_UTF8_AS_LATIN1 = (r"^(?:[\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
                   r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
                   r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}"
                   r"|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*$")


def _repaired(c: str) -> str:
    return (f"CASE WHEN {c} = '' THEN {c} ELSE try(decode(unhex(array_to_string(list_transform("
            f"string_split({c}, ''), lambda ch: printf('%02X', unicode(ch))), '')))) END")


cte("legacy_policy", "SELECT " + ", ".join(
    f"coalesce(bool_and(coalesce(regexp_full_match({c}, '{_UTF8_AS_LATIN1}'), true)), true) AS p_{c}"
    for c in RAW_COLS) + " FROM ledger_nulled", ["ledger_nulled"])
cte("legacy_fixed", "SELECT " + ", ".join(
    f"CASE WHEN p.p_{c} THEN {_repaired('n.' + c)} ELSE n.{c} END AS {c}" for c in RAW_COLS)
    + " FROM ledger_nulled n, legacy_policy p", ["ledger_nulled", "legacy_policy"])
_LEGACY_TEXT = ["department_code", "department", "txn_type", "expense_type", "owner", "counterparty", "project"]
cte("legacy_dedup", """
  SELECT DISTINCT department_code, department, txn_type, coalesce(expense_type, 'N/A') AS expense_type,
         amount_raw, owner, counterparty, project, CAST(try_strptime(trim(date_raw), '%Y-%m-%d') AS DATE) AS txn_date
  FROM legacy_fixed""", ["legacy_fixed"])
cte("legacy_norm", "SELECT txn_date, amount_raw, " + ", ".join(
    f"trim(regexp_replace({c}, '\\s+', ' ', 'g')) AS {c}" for c in _LEGACY_TEXT)
    + f", {_PARSE_AMOUNT} AS amount FROM legacy_dedup", ["legacy_dedup"])
oracle("legacy_clean", f"""
SELECT department_code, department, owner, txn_date,
       CAST(year(txn_date) AS INTEGER) AS year, CAST(month(txn_date) AS INTEGER) AS month,
       CAST(quarter(txn_date) AS INTEGER) AS quarter, CAST(weekofyear(txn_date) AS INTEGER) AS iso_week,
       dayname(txn_date) AS day_name, CAST(dayofyear(txn_date) AS INTEGER) AS day_of_year,
       strftime(txn_date, '%Y-%m') AS year_month, CAST(year(txn_date) AS INTEGER) AS fiscal_year,
       txn_type, expense_type, amount,
       CAST(CASE WHEN amount IS NULL THEN NULL WHEN txn_type = 'Revenu' THEN amount ELSE -amount END AS DECIMAL(28,6))
         AS signed_amount,
       counterparty, project
FROM legacy_norm""", ["legacy_norm"])


# ---- uploads, dates, amounts, stored tables and the filtered report
_MIXED = [c if c not in ("amount_raw", "owner") else
          "CASE WHEN right(project, 1) IN ('3', '4') THEN replace(amount_raw, '€ ', '') ELSE amount_raw END AS amount_raw"
          if c == "amount_raw" else
          "CASE WHEN right(project, 1) >= '5' THEN owner || ' \"q\"' || chr(10) || project ELSE owner END AS owner"
          for c in RAW_COLS]
oracle("ledger_csv_mixed", "SELECT " + ", ".join(_nulltok(c) for c in RAW_COLS)
       + " FROM (SELECT " + ", ".join(_MIXED) + " FROM ledger_raw)", ["ledger_raw"])
oracle("upload_columns", "SELECT * EXCLUDE (ordinal) FROM ledger_raw", ["ledger_raw"])
oracle("upload_preview", f"""
SELECT '{",".join(RAW_COLS)}' AS columns, count(*) AS n_rows, least(count(*), 5) AS n_shown FROM ledger_raw""", ["ledger_raw"])
oracle("upload_stage", """
SELECT 'before' AS stage, count(*) AS n_rows, count(DISTINCT project) AS n_projects FROM ledger_raw
UNION ALL SELECT 'after', count(*), count(DISTINCT project) FROM ledger""", ["ledger_raw", "ledger"])
oracle("star_written", "SELECT f.*, d.year FROM s2_facts f LEFT JOIN s2_date d USING (date_id)", ["s2_facts", "s2_date"])
cte("dated", """
  SELECT CASE WHEN d IS NULL THEN date_raw WHEN day(d) % 4 = 0 THEN strftime(d, '%Y-%m-%dT10:00:00.123')
              WHEN day(d) % 4 = 1 THEN strftime(d, '%d.%m.%Y')
              WHEN day(d) % 4 = 2 THEN concat(day(d), '/', month(d), '/', year(d), ' 8:05')
              ELSE strftime(d, '%d/%m/%Y') END AS date_raw, CAST(d AS DATE) AS txn_date
  FROM (SELECT date_raw, try_strptime(date_raw, '%Y-%m-%d') AS d FROM ledger_raw)""", ["ledger_raw"])
oracle("dates_parsed", "SELECT date_raw, txn_date FROM dated", ["dated"])
cte("wide", """
  SELECT CASE WHEN department_code = 'DEPT003' THEN '9999999999' ELSE '' END
         || regexp_replace(amount_raw, '[.,]', '.00', 'g') AS amount_raw FROM ledger_raw""", ["ledger_raw"])
oracle("amounts_wide", f"""
SELECT amount_raw, amount, CAST(round(amount, 2) AS DECIMAL(28,6)) AS stored
FROM (SELECT amount_raw, {_PARSE_AMOUNT} AS amount FROM wide)""", ["wide"])
oracle("kpi_batch_saved", f"""
SELECT kpi_name, period, value, source FROM merged m WHERE kpi_name = 'CA_Mensuel'
  AND NOT EXISTS (SELECT 1 FROM ledger l WHERE strftime(l.txn_date, '%Y-%m') = m.period)
UNION ALL
SELECT 'CA_Mensuel', strftime(txn_date, '%Y-%m'), CAST({REV} AS DOUBLE), 'saved' FROM ledger GROUP BY 2""", ["merged", "ledger"])
cte("rep", f"""
  SELECT * FROM ledger WHERE txn_date >= DATE '1996-03-01' AND txn_date < DATE '1996-04-01' AND {_DEPT_ID} = 5""", ["ledger"])
oracle("kpi_report_filtered", f"""
SELECT 'kpis' AS part, '' AS key, CAST(round(coalesce(sum({S}), 0), 2) AS DOUBLE) AS value FROM rep
UNION ALL SELECT 'by_department', CAST({_DEPT_ID} AS VARCHAR), CAST(sum({S}) AS DOUBLE) FROM rep GROUP BY 2
UNION ALL SELECT 'monthly', strftime(txn_date, '%Y-%m'), CAST(round({REV} - {DEP}, 2) AS DOUBLE) FROM rep GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'top_expense_types', expense_type, CAST(sum(-{S}) AS DOUBLE) AS v FROM rep WHERE {S} < 0
                         GROUP BY 2 ORDER BY v DESC, expense_type LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_projects', project, CAST(sum(abs({S})) AS DOUBLE) AS v FROM rep
                         GROUP BY 2 ORDER BY v DESC, project LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_counterparties', counterparty, CAST(sum(abs({S})) AS DOUBLE) AS v FROM rep
                         GROUP BY 2 ORDER BY v DESC, counterparty LIMIT 10)""", ["rep"])
cte("first_rows", """
  SELECT strftime(txn_date, '%Y-%m-%d') AS txn_date, department, CAST(amount AS DOUBLE) AS amount, department_code, owner, counterparty,
         row_number() OVER (ORDER BY txn_date, department, amount, department_code, owner, counterparty) AS rn FROM ledger""",
    ["ledger"])
oracle("audit_detail", """
SELECT CAST(12 AS BIGINT) AS id, n_inserted AS n_rows, n_rejected + n_skipped AS n_errors,
       CASE WHEN n_rejected + n_skipped > 0 THEN 'partiel' ELSE 'succes' END AS status, 'version 1; 5 rows kept' AS details,
       'txn_date,department,amount,department_code,owner,counterparty' AS columns, (SELECT count(*) FROM ledger) AS rows_count,
       (SELECT CAST(to_json(list({'txn_date': txn_date, 'department': department, 'amount': amount, 'department_code': department_code,
                                  'owner': owner, 'counterparty': counterparty} ORDER BY rn)) AS VARCHAR)
        FROM first_rows WHERE rn <= 5) AS preview
FROM (SELECT count(*) FILTER (WHERE len(reasons) > 0) AS n_rejected FROM ledger_all) a,
     (SELECT count(*) FILTER (WHERE NOT resolved) AS n_skipped, count(*) FILTER (WHERE resolved) AS n_inserted
      FROM s2_resolved) b""", ["ledger", "ledger_all", "s2_resolved", "first_rows"])

# Files of one batch: each holds the rows whose project ends in its digits, and is cleaned by itself.
cte("by_file", " UNION ALL ".join(f"""
  SELECT {k} AS upload, * FROM (SELECT *, coalesce(TRY_CAST(right(project, 1) AS INTEGER), 0) AS digit FROM ledger_all
                                WHERE len(reasons) = 0) WHERE digit BETWEEN {low} AND {high}"""
                                  for k, (low, high) in enumerate([(0, 3), (2, 6), (5, 9)])), ["ledger_all"])
oracle("uploads_by_file", """
SELECT CAST(upload AS INTEGER) AS upload, txn_date, department, txn_type, owner, counterparty, project, amount, n_copies FROM by_file""", ["by_file"])
cte("known", "SELECT DISTINCT department, txn_type, expense_type FROM by_file WHERE upload = 0", ["by_file"])
oracle("star_appended", """
SELECT row_number() OVER (ORDER BY upload, txn_date, department, txn_type, expense_type, owner, counterparty, project, amount, signed_amount,
                          department_code NULLS FIRST) AS transaction_id,
       txn_date AS date, CAST(round(amount, 2) AS DECIMAL(28,6)) AS amount, signed_amount
FROM by_file
WHERE upload = 0 OR (department IN (SELECT department FROM known) AND txn_type IN (SELECT txn_type FROM known)
                     AND expense_type IN (SELECT expense_type FROM known))""", ["by_file", "known"])

oracle("users_page_stored", f"""
SELECT id, firstname, lastname, email, coalesce(role, 'user') AS role, coalesce(login_type, 'email') AS login_type,
       {_USER_LABEL} AS created_at
FROM app_users WHERE {_SEARCH} ORDER BY id LIMIT 10 OFFSET 20""", ["app_users"])
oracle("ledger_page_deep", """
SELECT ordinal, txn_date, department, project, amount FROM ledger ORDER BY txn_date DESC, ordinal LIMIT 50 OFFSET 19950""", ["ledger"])
cte("changes", """
  SELECT department, CAST(f.txn_date + INTERVAL 10 DAY AS DATE) AS since, f.owner AS owner_then, f.department_code AS code_then
  FROM (SELECT department, min({'txn_date': txn_date, 'ordinal': ordinal, 'owner': owner, 'department_code': department_code}) AS f
        FROM ledger GROUP BY department, year, quarter)""", ["ledger"])
oracle("owner_as_of", """
SELECT l.ordinal, l.department, l.txn_date, c.owner_then, c.code_then
FROM ledger l ASOF LEFT JOIN changes c ON l.department = c.department AND l.txn_date >= c.since""", ["ledger", "changes"])
oracle("forecast_facts", f"""
SELECT f.id, CAST(count(*) AS BIGINT) AS n_facts, CAST(sum(l.amount) AS DOUBLE) AS amount
FROM (SELECT {_DEPT_ID} AS department_id, txn_date, amount FROM ledger) l
JOIN forecasts f ON l.department_id = f.department_id AND l.txn_date BETWEEN f.start_date - INTERVAL 324 MONTH AND f.end_date - INTERVAL 324 MONTH
GROUP BY f.id""", ["ledger", "forecasts"])
cte("spans", """
  SELECT department, project, year, min(txn_date) AS start_date, max(txn_date) AS end_date FROM ledger GROUP BY ALL""", ["ledger"])
oracle("project_overlaps", """
SELECT a.department, a.project, a.year, count(*) AS n_spans,
       CAST(sum(date_diff('day', greatest(a.start_date, b.start_date), least(a.end_date, b.end_date)) + 1) AS BIGINT) AS n_days
FROM spans a JOIN spans b ON a.department = b.department AND a.project <> b.project AND a.start_date <= b.end_date AND b.start_date <= a.end_date
GROUP BY ALL""", ["spans"])

ORACLE["activity_weekly_sketched"] = ORACLE["activity_weekly"]
# Below the sketch's size a quantile is exact: the smallest value with at least that share of the values at or below it.
oracle("amount_medians", """
SELECT department, year_month, n, l[CAST(ceil(0.25 * n) AS INTEGER)] AS low, l[CAST(ceil(0.5 * n) AS INTEGER)] AS median,
       l[CAST(ceil(0.75 * n) AS INTEGER)] AS high
FROM (SELECT department, strftime(txn_date, '%Y-%m') AS year_month, count(*) AS n, list_sort(list(CAST(amount AS DOUBLE))) AS l
      FROM ledger GROUP BY ALL)""", ["ledger"])
