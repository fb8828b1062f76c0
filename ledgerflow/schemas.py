"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Amounts: 22 digits before the point, six behind it (rounded to two when a fact is stored).
MONEY = T.DecimalType(28, 6)
# Operands of a quotient: narrow enough that Spark keeps ten digits of the result.
QUOTIENT = T.DecimalType(28, 3)

# ---------------------------------------------------------------------------
# These must stay exactly as written for results to agree with
# the original application (column names of an upload, missing-value tokens,
# keyword rules, stored KPI names and label texts).
# ---------------------------------------------------------------------------

# Required upload columns, in the order used by the "missing columns" error.
REQUIRED_COLUMNS = [
    "Date", "DepartementID", "Département", "TypeTransaction", "TypeDépense",
    "Montant", "Responsable", "Client_Fournisseur", "Projet",
]

# Prefix of the error raised when required columns are missing.
MISSING_COLUMNS_MESSAGE = "Colonnes manquantes: "

# Upload column -> our column.
UPLOAD_TO_LEDGER = {
    "Date": "date_raw",
    "DepartementID": "department_code",
    "Département": "department",
    "TypeTransaction": "txn_type",
    "TypeDépense": "expense_type",
    "Montant": "amount_raw",
    "Responsable": "owner",
    "Client_Fournisseur": "counterparty",
    "Projet": "project",
}

# Upload columns that may be absent -> our column.
OPTIONAL_UPLOAD_TO_LEDGER = {"Entreprise": "company"}

# Tokens a pandas CSV reader turns into a missing value (pandas 2.x defaults).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Transaction types that make an amount negative (lower-cased, trimmed).
EXPENSE_TYPES = ["depense", "dépense"]
# The legacy sign rule keeps the sign only for this exact value.
LEGACY_REVENUE = "Revenu"
LEGACY_SIGN_LABELS = ("Positif", "Négatif")
# Counterparty kind.
REVENUE_TYPE = "revenu"
KIND_CLIENT, KIND_SUPPLIER = "Client", "Fournisseur"
# Expense type default.
EXPENSE_TYPE_DEFAULT = "N/A"

# Expense category rules: first match on the lower-cased text wins (plain substring).
EXPENSE_CATEGORY_RULES = [
    (["salaire", "rh", "recrutement", "formation"], "Ressources Humaines"),
    (["achat", "stock", "fournisseur", "matière"], "Achats & Approvisionnement"),
    (["loyer", "immobilier", "infrastructure"], "Infrastructure"),
    (["marketing", "publicité", "communication"], "Marketing"),
    (["it", "informatique", "logiciel", "tech"], "IT & Technologie"),
    (["revenu", "vente", "client"], "Revenus"),
]
EXPENSE_CATEGORY_DEFAULT = "Autres"

# Report labels for missing group values.
LABEL_UNCLASSIFIED = "Non classé"
LABEL_DASH = "—"
LABEL_UNKNOWN_DEPARTMENT = "Inconnu"
LABEL_OTHER = "Autre"
LABEL_NO_MONTH = "0000-00"

# Global KPI names written by the refresh, in emission order.
KPI_GLOBAL_NAMES = [
    ("CA_Total", "sum"), ("Solde_Net", "sum"), ("Revenus", "sum"), ("Dépenses", "sum"),
    ("Nb_Transactions", "count"), ("Valeur_Moyenne", "avg"), ("Ratio_Dep_Rev", "ratio"),
]
KPI_MONTHLY_NAME = "CA_Mensuel"
# Name prefixes of the per-quarter / per-department, per-transaction-type and
# per-expense-type KPIs, and the quarter key "Q<quarter>_<year>".
KPI_PREFIX_AMOUNT = "CA_"
KPI_PREFIX_VOLUME = "Vol_"
KPI_PREFIX_EXPENSE = "Dep_"
QUARTER_KEY_PREFIX = "Q"
KPI_SOURCE_REFRESH = "etl_auto"
KPI_DEFAULT_PERIOD = "global"
KPI_DEFAULT_SOURCE = "etl"
KPI_DEFAULT_STAT = "sum"

# Import status values.
STATUS_OK, STATUS_PARTIAL, STATUS_FAILED = "succes", "partiel", "echec"

# User defaults.
DEFAULT_LOGIN_TYPE = "email"
DEFAULT_ROLE = "user"
EXPORT_HEADER = "id,firstname,lastname,email,role,login_type,created_at"
# How a missing value prints in the export, and the last display-name fallback.
MISSING_TEXT = "None"
DISPLAY_NAME_FALLBACK = "User "

# Keyword answers: ordered intent rules on the trimmed lower-cased message.
INTENT_RULES = [
    ("revenue", ["revenu", "argent", "gagné", "ca"]),
    ("expense", ["dépense", "depense", "coût", "cout", "perdu"]),
    ("users", ["utilisateur", "client", "membre"]),
]
KPI_KEYWORD_REVENUE = "revenu"
KPI_KEYWORD_EXPENSE = "depense"
ANSWER_EMPTY = "Posez-moi une question sur vos données !"
ANSWER_REVENUE = "Le revenu total détecté est de {total} €."
ANSWER_EXPENSE = "Les dépenses s'élèvent à {total} €."
ANSWER_USERS = "Il y a actuellement {n} utilisateurs enregistrés."
ANSWER_HELP = "Je peux vous aider sur les revenus, dépenses ou utilisateurs."

# Row caps that are features of the reports (newest-N and top-k views).
FLATTEN_LIMIT = 50_000
KPI_READ_LIMIT = 100
FORECAST_READ_LIMIT = 50
HISTORY_READ_LIMIT = 200
TOP_K = 10
USERS_PER_PAGE = 10

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

LEDGER_RAW = T.StructType([T.StructField(c, T.StringType()) for c in UPLOAD_TO_LEDGER.values()])

LEDGER_CLEAN = T.StructType([
    T.StructField("txn_date", T.DateType()),
    T.StructField("department_code", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("expense_type", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("owner", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("signed_amount", MONEY),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()),
    T.StructField("day_name", T.StringType()),
    T.StructField("day_of_year", T.IntegerType()),
    T.StructField("year_month", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
])

# Natural keys of the dimensions (owner key is configurable, see star.upsert_owner).
DIM_KEYS = {
    "dim_date": ["date"],
    "dim_department": ["department"],
    "dim_owner": ["owner", "department"],
    "dim_txn_type": ["txn_type"],
    "dim_expense_type": ["expense_type"],
    "dim_counterparty": ["counterparty"],
    "dim_project": ["project"],
}

DIM_IDS = {
    "dim_date": "date_id",
    "dim_department": "department_id",
    "dim_owner": "owner_id",
    "dim_txn_type": "txn_type_id",
    "dim_expense_type": "expense_type_id",
    "dim_counterparty": "counterparty_id",
    "dim_project": "project_id",
}

KPI_VALUES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("kpi_name", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("evolution", T.DoubleType()),
    T.StructField("department_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("stat_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("firstname", T.StringType()),
    T.StructField("lastname", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("login_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

IMPORT_HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("imported_at", T.TimestampType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_errors", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("imported_by", T.StringType()),
    T.StructField("details", T.ArrayType(T.StringType())),
    T.StructField("data", T.StringType()),
])

# Rows of an import kept as JSON in its audit row; the whole import stays in the cleaned table.
AUDIT_DATA_ROWS = 5
