"""The 21 banking relations as DuckDB SQL over the raw test tables.

Used only by the SQL oracle (``oracle_sql()`` in ``__spark_entry__``): each
oracle query is prefixed with the CTEs it needs.  Names carry a ``b_``
prefix because ``customer`` also names a raw table.
"""

from __future__ import annotations

import re

ACCT = ("concat('210', cast({k} % 5 as varchar), '0', cast({k} % 10 as varchar), "
        "repeat('0', greatest(5 - length(cast({k} as varchar)), 0)), cast({k} as varchar))")


def _acct(k: str) -> str:
    return ACCT.format(k=k)


_LEDGER_SHARED = f"""
    concat('T', cast(l_orderkey as varchar)) as trn_ref_no,
    l_linenumber as ac_entry_sr_no,
    concat('X', cast(l_orderkey as varchar)) as external_ref_no,
    case when l_quantity = 50 then 'REVR' when l_quantity = 49 then 'YEND' else 'INIT' end as event,
    lpad(cast(o_custkey % 8 + 1 as varchar), 3, '0') as ac_branch,
    {{ac_no}} as ac_no,
    '{{gl}}' as cust_gl,
    {{drcr}} as drcr_ind,
    case when l_suppkey % 4 = 0 then 'USD' else 'MMK' end as ac_ccy,
    case l_linenumber when 1 then 'CDO' when 2 then 'SWP' when 3 then 'MRG' when 4 then 'POS' else 'CSD' end as trn_code,
    cast(case when l_discount = 0.1 or (o_custkey % 5 = 4 and l_returnflag = 'R') then -l_extendedprice
              when l_linenumber >= 5 then floor(l_extendedprice / 10000) * 10000
              else l_extendedprice end as decimal(22,3)) as lcy_amount,
    case when l_suppkey % 4 = 0 then cast(case when o_custkey % 5 = 4 and l_returnflag = 'R'
         then -l_quantity else l_quantity end as decimal(22,3)) end as fcy_amount,
    cast(date '2024-01-01' + cast(l_orderkey % 30 as integer) as date) as trn_dt,
    case when l_tax = 0.08 then 'U' else 'A' end as auth_stat
  from lineitem join orders on l_orderkey = o_orderkey"""

_CUST_LEG = _LEDGER_SHARED.format(
    ac_no=_acct("o_custkey"), gl="A",
    drcr="case when l_returnflag = 'R' then 'D' else 'C' end")
_GL_LEG = _LEDGER_SHARED.format(
    ac_no=("case when l_linestatus = 'F' then '11010010001' when l_partkey % 2 = 0 "
           "then '15060010001' else '91000010001' end"), gl="G",
    drcr="case when l_returnflag = 'R' then 'C' else 'D' end")

_GL_ACCOUNT = f"""
  select {_acct('c_custkey')} as ac_gl_no,
         case c_custkey % 5 when 1 then '21020010001' when 2 then '21010010001'
              when 3 then case when c_custkey % 2 = 0 then '21030010001' else '21050010001' end
              when 4 then '21110010001' else '21220010001' end as ac_natural_gl
  from customer
  union all
  select code, code from (values ('11010010001'), ('15060010001'), ('91000010001')) g(code)"""

_BAL_BRANCH = ("case when user_id % 9 = 8 then '999' else "
               "lpad(cast(user_id % 9 + 1 as varchar), 3, '0') end")

ADAPTERS: dict[str, str] = {
    "b_ledger_entry": f"select {_CUST_LEG}\n  union all\n  select {_GL_LEG}",
    "b_gl_account": _GL_ACCOUNT,
    "b_account_gl_map": _GL_ACCOUNT,
    "b_gl_master": """
  select code as gl_code,
         case when code = '11010010001' then '5' when code like '2%' then '2' else '1' end as type
  from (values ('11010010001'), ('15060010001'), ('91000010001'), ('21010010001'),
               ('21020010001'), ('21030010001'), ('21050010001'), ('21110010001'),
               ('21220010001')) g(code)""",
    "b_deposit_term": f"""
  select {_acct('c_custkey')} as acc,
         case c_custkey % 4 when 0 then 30 when 1 then 50 when 2 then 90 end as orig_tenor_days,
         case when c_custkey % 4 = 3 and c_custkey % 3 = 0 then 12 end as orig_tenor_months,
         case when c_custkey % 4 = 3 and c_custkey % 3 = 1 then 1 end as orig_tenor_years
  from customer where c_custkey % 5 = 3""",
    "b_balance_history": f"""
  select {_acct('user_id')} as account, {_BAL_BRANCH} as branch_code,
         cast(ts as date) as bkg_date,
         sum(cast(value as decimal(22,3))) as acy_opening_bal,
         sum(cast(value as decimal(22,3))) as lcy_opening_bal,
         sum(cast(value * 2 as decimal(22,3))) as acy_closing_bal,
         sum(cast(value * 2 as decimal(22,3))) as lcy_closing_bal
  from events group by 1, 2, 3
  union all
  select '11010010001' as account, {_BAL_BRANCH} as branch_code,
         cast(ts as date) as bkg_date,
         -sum(cast(value as decimal(22,3))), -sum(cast(value as decimal(22,3))),
         -sum(cast(value * 2 as decimal(22,3))), -sum(cast(value * 2 as decimal(22,3)))
  from events group by 1, 2, 3""",
    "b_calendar": "select cast(ts as date) as value_date from events group by 1",
    "b_holiday": "select d as holiday_date from (values (date '2024-01-19')) h(d)",
    "b_branch": """
  select lpad(cast(n_nationkey + 1 as varchar), 3, '0') as branch_code, n_name as branch_name
  from nation
  union all
  select c, n from (values ('999', 'HEAD_OFFICE')) h(c, n)""",
    "b_branch_group_member": """
  select lpad(cast(n_nationkey + 1 as varchar), 3, '0') as branch_code,
         case n_nationkey % 5 when 0 then 'YGN' when 1 then 'MDY' when 2 then 'NPT'
              when 3 then 'TGI' else 'BGO' end as branch_group_code
  from nation""",
    "b_branch_group": """
  select c as branch_group_code, s as record_stat
  from (values ('YGN', 'O'), ('MDY', 'O'), ('NPT', 'O'), ('TGI', 'O'), ('BGO', 'C')) g(c, s)""",
    "b_account": f"""
  select lpad(cast(c_custkey % 8 + 1 as varchar), 3, '0') as branch_code,
         {_acct('c_custkey')} as cust_ac_no, c_custkey as cust_no,
         cast(date '2024-01-01' + cast(c_custkey % 60 as integer) as date) as ac_open_date,
         case when c_custkey % 7 = 0 then 'J' else 'S' end as joint_ac_indicator,
         c_mktsegment as account_class
  from customer""",
    "b_joint_holder": f"""
  select {_acct('c_custkey')} as cust_ac_no, c_custkey - 1 as joint_holder_code
  from customer where c_custkey % 7 = 0 and c_custkey > 0""",
    "b_account_balance": f"""
  select {_acct('c_custkey')} as cust_ac_no,
         cast(c_acctbal as decimal(22,3)) as acy_withdrawable_bal,
         cast(0 as decimal(22,3)) as acy_blocked_amt
  from customer where c_custkey % 13 <> 0""",
    "b_account_closure": f"""
  select {_acct('c_custkey')} as ac_no,
         cast(date '2024-01-01' + cast(case when c_custkey % 2 = 0 then c_custkey % 45
              else (c_custkey + 3) % 45 end as integer) as date) as closing_date
  from customer where c_custkey % 11 = 0""",
    "b_account_class": """
  select c_mktsegment as account_class, lower(c_mktsegment) as description
  from customer where c_mktsegment <> 'FURNITURE' group by 1, 2""",
    "b_customer": """
  select c_custkey as customer_no,
         case when c_custkey % 6 = 0 then 'C' else 'I' end as customer_type,
         c_name as full_name, 'NRC' as unique_id_name,
         cast(c_custkey * 7 as varchar) as unique_id_value,
         concat('No ', c_name) as address_line1,
         case when c_custkey % 3 = 0 then null else concat('Ward ', c_mktsegment, ',') end as address_line2,
         concat('Zone ', cast(c_nationkey as varchar)) as address_line3,
         case when c_custkey % 4 = 0 then null else 'City' end as address_line4
  from customer""",
    "b_customer_personal": """
  select c_custkey as customer_no,
         case when c_custkey % 2 = 0 then 'U' end as customer_prefix,
         cast(date '1970-01-01' + cast(c_custkey % 9000 as integer) as date) as date_of_birth,
         case when c_custkey % 5 <> 0 then cast(c_custkey as varchar) end as telephone,
         concat('09', cast(c_custkey as varchar)) as mobile_number
  from customer where c_custkey % 6 <> 0""",
    "b_customer_corporate": """
  select c_custkey as customer_no,
         cast(date '1990-01-01' + cast(c_custkey % 9000 as integer) as date) as incorp_date
  from customer where c_custkey % 6 = 0""",
    "b_customer_professional": """
  select c_custkey as customer_no, concat('job ', c_mktsegment) as designation
  from customer where c_custkey % 2 = 0""",
    "b_field_label": "select r_name as field_name, r_regionkey as label_code from region",
}


def with_adapters(body: str) -> str:
    """Prefix ``body`` with the CTEs of every ``b_*`` relation it mentions."""
    used = [n for n in ADAPTERS if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{n} as ({ADAPTERS[n]}\n)" for n in used)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
