"""Fixed values of the bank's chart of accounts and code tables.

FIXED VALUES: these literals must equal the ones the reports were written
against; they are business data, not tuning knobs.  They are listed here in
the order the reports use them so that every operator reads the same list.
"""

# --- fixed values: general-ledger codes -------------------------------------
CASH_GL = "11010010001"            # the vault cash GL of every branch
CASH_GL_PREFIX = "1101"            # contra legs that touch branch cash
INTERBANK_GL = "15060010001"       # sweep postings on it are not turnover
FIXED_DEPOSIT_GLS = ("21030010001", "21130010001", "21230010001")
BUCKETED_DEPOSIT_GL = "21050010001"
TENOR_GLS = ("21030010001", "21130010001", "21230010001", "21050010001")
CASH_GL_TYPE = "5"                 # gl_master.type of cash GLs

# --- fixed values: natural-GL families that count as cash movement ----------
CASH_MOVEMENT_GL_FAMILIES = (
    "1104", "1105", "1406", "1512", "1503", "1505", "1508", "2121", "2122",
    "2123", "2124", "2101", "2111", "2104", "2114", "2102", "2112", "1501",
    "7261", "1506", "2660", "2601", "2630", "2640", "2670",
)
CASH_MOVEMENT_GL_CLASSES = ("6", "7")

# --- fixed values: transaction codes and events ------------------------------
SWEEP_CODE = "SWP"
MIGRATION_CODE = "MRG"
REVERSAL_EVENT = "REVR"
YEAR_END_EVENT = "YEND"
ATM_TRN_CODES = ("CDO", "CLD", "CLR", "CLW", "CWF", "CWO", "CWR", "ECM", "FNC", "POS")

# --- fixed values: zones (branch-group code -> zone label) -------------------
ZONES = (("YGN", "Yangon"), ("MDY", "Mandalay"), ("NPT", "Naypyitaw"))
OTHER_ZONE = "Other Cities"
OPEN_RECORD = "O"

# --- fixed values: deposit type digit (4th character of the account) --------
DEPOSIT_TYPE_CURRENT = "2"
DEPOSIT_TYPE_SAVING = "1"
DEPOSIT_TYPE_CALL = "4"
DEPOSIT_TYPE_FIXED = "3"
DEPOSIT_TYPE_EXCLUDED = "0"
DEPOSIT_ACCOUNT_PREFIX = "21"
INTERNAL_ACCOUNT_DIGIT = "5"       # 6th character: nostro / internal account

# --- fixed values: customer and account flags -------------------------------
CUSTOMER_INDIVIDUAL = "I"
CUSTOMER_CORPORATE = "C"
JOINT_ACCOUNT = "J"
SINGLE_ACCOUNT = "S"
AUTHORISED = "A"
CUSTOMER_LEG = "A"
GL_LEG = "G"
CREDIT = "C"
DEBIT = "D"

# --- fixed values: defaults that the reports take as parameters -------------
BASE_CCY = "MMK"
HEAD_OFFICE_BRANCH = "999"
LABEL_BRANCH = "001"               # the only branch whose rows carry the date text
