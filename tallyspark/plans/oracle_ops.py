"""Oracle SQL (DuckDB) of the single-operator queries.

Written in the literal relational form of each rule; see ``oracle_sql``.
Money is cast to DOUBLE and dates to text in the outermost select.
"""

from __future__ import annotations

from tallyspark.plans import params as P
from tallyspark.plans.oracle_sql import (ADDRESS, ATM, CODE_FIRST, CODE_JOINS, DAY_LISTS, HOLDERS,
                                         LATEST_SNAPSHOT, LIVE_CASH, MIX, MODED, MOVEMENTS, NET,
                                         NET_POSITION_ALL, OPEN_CLOSE_R5, OPEN_CLOSE_R6, PROFILE,
                                         VAULT, D, flow_columns, flow_entries, ratio, touching_cash,
                                         turnover_day, turnover_sql)

_ZW = f"trn_dt between {D(P.ZONE_FROM)} and {D(P.ZONE_TO)}"
_LED = ("trn_ref_no, ac_entry_sr_no, ac_no, cust_gl, drcr_ind, "
        "cast(lcy_amount as double) as lcy_amount, cast(trn_dt as varchar) as trn_dt")
_POSTABLE = ("auth_stat = 'A' and trn_code not in ('MRG') "
             "and not (ac_no = '15060010001' and trn_code in ('SWP')) "
             "and event not in ('REVR', 'YEND')")
_TD = D(P.TURNOVER_DAY)
_TD2 = D(P.TURNOVER_DAY.replace(day=11))

_MONITOR = f"with {DAY_LISTS}"
_MIX_COLS = ("cast(trn_dt as varchar) as trn_dt, branch_code, cast(current_bal as double) as current_bal, "
             "cast(saving_bal as double) as saving_bal, cast(call_bal as double) as call_bal, "
             "cast(fixed_bal as double) as fixed_bal, cast(total_dep as double) as total_dep")
_NET_COLS = ("cast(trn_dt as varchar) as trn_dt, branch, cast(current_bal as double) as current_bal, "
             "cast(saving_bal as double) as saving_bal, cast(call_bal as double) as call_bal, "
             "cast(fixed_bal as double) as fixed_bal, cast(total_dep as double) as total_dep, "
             "cast(daily_net_deposit_amt as double) as daily_net_deposit_amt")

OPERATOR_SQL: dict[str, str] = {
    # ---------------------------------------------------------------- C1
    "reversal_ref": f"""
with undone as (select distinct trn_ref_no from b_ledger_entry where event = 'REVR'),
facts as (select count(*) as n, count(*) - count(trn_ref_no) as n_null from b_ledger_entry where event = 'REVR'),
live as (
  select l.* from (select * from b_ledger_entry where {_ZW}) l
  left join undone u on u.trn_ref_no = l.trn_ref_no where u.trn_ref_no is null)
select {_LED} from live
where (select n_null from facts) = 0 and (trn_ref_no is not null or (select n from facts) = 0)""",
    "reversal_customer": f"""
with {LIVE_CASH}
select trn_ref_no, external_ref_no, ac_branch, ac_no, ac_ccy, trn_code,
       cast(lcy_amount as double) as lcy_amount from live_cash""",
    "reversal_ref_code": f"""
with undone as (
  select distinct trn_ref_no, trn_code from b_ledger_entry where event = 'REVR' and auth_stat = 'A'),
live as (
  select l.* from (select * from b_ledger_entry where trn_dt = {_TD} and {_POSTABLE}) l
  left join undone u on u.trn_ref_no = l.trn_ref_no and u.trn_code = l.trn_code where u.trn_ref_no is null)
select {_LED}, trn_code from live""",
    "postable": f"""
select {_LED}, trn_code, event from b_ledger_entry where trn_dt = {_TD} and {_POSTABLE}""",
    # ------------------------------------------------------- C2 C3 C4 C14
    "mode_window": f"""
with {turnover_day(_TD)}, {MODED}
select trn_ref_no, gl_code, drcr_ind, ac_ccy, cast(lcy_amount as double) as lcy_amount, trn_mode
from moded""",
    "cash_legs": f"""
select trn_ref_no, ac_branch, ac_no, ac_ccy, trn_code, cast(lcy_amount as double) as lcy_amount,
       cast(trn_dt as varchar) as trn_dt
from ({touching_cash(_ZW)})""",
    "tenor_first": f"""
select l.ac_no, l.cust_gl, {CODE_FIRST} as code
from (select distinct ac_no, cust_gl from b_ledger_entry) l
{CODE_JOINS}""",
    "tenor_bucket": """
select ac_no, gl_code, orig_tenor_days,
       case when gl_code = '21050010001' and orig_tenor_days <= 40 then gl_code || '(30)'
            when gl_code = '21050010001' and orig_tenor_days > 40 and orig_tenor_days <= 60
              then gl_code || '(60)'
            when gl_code in ('21030010001', '21130010001', '21230010001', '21050010001')
              then concat(gl_code, '(', cast(orig_tenor_days as varchar), ')')
            else gl_code end as tenor_code
from (select e.ac_no, coalesce(m.ac_natural_gl, e.ac_no) as gl_code, i.orig_tenor_days
      from (select distinct ac_no from b_ledger_entry) e
      left join b_account_gl_map m on m.ac_gl_no = e.ac_no
      left join b_deposit_term i on i.acc = e.ac_no) t""",
    "join_left_chain": """
select e.ac_no, e.cust_gl, a.ac_natural_gl, i.orig_tenor_days, i.orig_tenor_months,
       i.orig_tenor_years
from (select distinct ac_no, cust_gl from b_ledger_entry) e
left join b_account_gl_map a on e.ac_no = a.ac_gl_no
left join b_deposit_term i on i.acc = a.ac_gl_no""",
    "unit_amount": f"""
select ac_ccy, drcr_ind,
       cast(sum(case when ac_ccy = 'MMK' then lcy_amount else fcy_amount end) as double) as amount_unit,
       cast(sum(lcy_amount) as double) as amount_mmk
from b_ledger_entry where {_ZW} and cust_gl = 'A' group by ac_ccy, drcr_ind""",
    # ------------------------------------------------------------- zones
    "case_zone": """
select g.branch_code, g.branch_group_code,
       case g.branch_group_code when 'YGN' then 'Yangon' when 'MDY' then 'Mandalay'
            when 'NPT' then 'Naypyitaw' else 'Other Cities' end as zone
from b_branch_group_member g
join b_branch_group m on m.branch_group_code = g.branch_group_code and m.record_stat = 'O'""",
    "channel_split": f"""
select trn_code, case when trn_code in ({ATM}) then 'ATM' else 'Branch' end as source,
       count(*) as n, cast(sum(lcy_amount) as double) as amount
from b_ledger_entry group by 1, 2""",
    # ---------------------------------------------------------- R1 parts
    "business_days": f"""
{_MONITOR}
select 'report' as list, cast(day as varchar) as loop_date from report_days
union all
select 'prior', cast(day as varchar) from comparison_days""",
    "asof_max": f"""
{_MONITOR}, {LATEST_SNAPSHOT}
select cast(day as varchar) as loop_date, cast(snapshot as varchar) as max_bkg_date,
       account, branch_code from latest""",
    "semi_tuple": f"""
{_MONITOR}, {LATEST_SNAPSHOT}
select account, branch_code, cast(bkg_date as varchar) as bkg_date,
       cast(lcy_opening_bal as double) as lcy_opening_bal
from b_balance_history
where (bkg_date, account, branch_code) in (select (day, account, branch_code) from latest)""",
    "opening_cash": f"""
{_MONITOR}, {VAULT}
select cast(day as varchar) as loop_date, branch_code,
       cast(lcy_opening_bal as double) as lcy_opening_bal from vault_opening""",
    "cash_in_out": f"""
{_MONITOR}, {MOVEMENTS}
select cast(day as varchar) as loop_date, cast(day as varchar) as trn_dt, ac_branch,
       branch_name, cast(cashin as double) as cashin, cast(cashout as double) as cashout from movements""",
    "deposit_mix": f"with {MIX.strip()} select {_MIX_COLS} from mix",
    "top6_in": f"{_MONITOR}, {MIX} select {_MIX_COLS} from mix "
               "where trn_dt in (select day from comparison_days)",
    "net_deposit": f"{_MONITOR}, {MIX}, {NET} select {_NET_COLS} from net",
    "union_head_office": f"""
{_MONITOR}, {MIX}, {NET}
select cast(trn_dt as varchar) as loop_date, branch as branch_code,
       '{P.HEAD_OFFICE_LABEL}' as branch_name, 0.0 as lcy_opening_bal, 0.0 as cashin,
       0.0 as cashout, 0.0 as net_amount, 0.0 as lcy_closing_bal,
       cast(current_bal as double) as current_bal, cast(saving_bal as double) as saving_bal,
       cast(call_bal as double) as call_bal, cast(fixed_bal as double) as fixed_bal,
       cast(total_dep as double) as total_dep,
       cast(daily_net_deposit_amt as double) as daily_net_deposit_amt
from net where branch = '999'""",
    "guarded_ratio": f"""
with {MIX.strip()}
select cast(trn_dt as varchar) as trn_dt, branch_code,
       {ratio('current_bal', 'total_dep')} as cur_deposit_ratio,
       {ratio('saving_bal', 'total_dep')} as sav_deposit_ratio,
       {ratio('call_bal', 'total_dep')} as call_deposit_ratio,
       {ratio('fixed_bal', 'total_dep')} as fixed_deposit_ratio,
       {ratio('saving_bal', 'call_bal')} as saving_call_ratio
from mix""",
    "window_max_partition": """
select cast(trn_dt as varchar) as trn_dt, ac_branch, cast(total as double) as total from (
  select trn_dt, ac_branch, total, max(total) over (partition by trn_dt) as day_max
  from (select trn_dt, ac_branch, sum(lcy_amount) as total from b_ledger_entry
        where cust_gl = 'A' and drcr_ind = 'C' group by trn_dt, ac_branch) a) b
where total = day_max""",
    # ------------------------------------------------------------- flows
    "deposit_flows": f"with {flow_entries(_TD)} select ac_ccy as currency, {flow_columns()} "
                     "from flow group by ac_ccy",
    "join_left_default": f"""
with {flow_entries(D(P.NEW_DEPOSIT_DAY))}
select trn_ref_no, ac_no, drcr_ind, cast(lcy_amount as double) as lcy_amount, mode
from flow, generate_series(1, legs)""",
    "turnover": turnover_sql(_TD2),
    "net_position": NET_POSITION_ALL,
    "join_multikey_fanout": f"""
with {LIVE_CASH}
select e.ac_branch, e.ac_ccy, count(*) as n_rows
from b_ledger_entry e
join live_cash c on c.trn_ref_no = e.trn_ref_no and c.external_ref_no = e.external_ref_no
           and c.ac_branch = e.ac_branch and c.ac_ccy = e.ac_ccy and c.lcy_amount = e.lcy_amount
where e.{_ZW} and e.cust_gl = 'A'
group by e.ac_branch, e.ac_ccy""",
    # ---------------------------------------------------------- accounts
    "new_accounts": f"""
with {OPEN_CLOSE_R6}
select cast(day as varchar) as open_date, cust_ac_no as acc_no, account_class, branch_code
from opened""",
    "agg_of_union": f"""
with {OPEN_CLOSE_R6}
select branch_code, count(cust_ac_no) as n from opened group by branch_code""",
    "closures": f"""
with {OPEN_CLOSE_R6}
select cast(ac_open_date as varchar) as ac_open_date, cust_ac_no as ac_no,
       cast(closing_date as varchar) as closing_date, branch_code, account_class from closed""",
    "join_full_open_close": f"""
with {OPEN_CLOSE_R6}
select coalesce(o.branch_code, c.branch_code) as branch_code,
       cast(coalesce(o.day, c.ac_open_date) as varchar) as openingdate,
       cast(c.closing_date as varchar) as closingdate, cust_ac_no as acc_no,
       coalesce(o.account_class, c.account_class) as account_class
from opened o full join closed c using (cust_ac_no)""",
    "scalar_cross": f"""
with {OPEN_CLOSE_R5},
counts as (select (select count(*) from opened) as opened, (select count(*) from closed) as closed)
select opened, closed, opened - closed as net
from counts, b_calendar where value_date = {D(P.NEW_DEPOSIT_DAY)}""",
    "account_holders": f"""
select branch_code, cust_ac_no, cust_no, cast(ac_open_date as varchar) as ac_open_date,
       joint_ac_indicator from ({HOLDERS}) h""",
    "internal_accounts": """
select cust_ac_no, branch_code from b_account where nullif(substr(cust_ac_no, 6, 1), '') <> '5'""",
    "customer_profile": f"""
select customer_no, customer_type, full_name, customer_prefix,
       cast(date_of_birth as varchar) as date_of_birth, designation, telephone, mobile_number
from ({PROFILE}) p""",
    "address": f"""
select customer_no, nullif({ADDRESS}, '') as address from b_customer cd""",
    "fn_nvl": """
select customer_no, coalesce(telephone, mobile_number) as phone from b_customer_personal""",
    "quoted_alias": """
select cast(ac_open_date as varchar) as "Open Date", cust_ac_no as "Account No",
       cust_no as "CIF No", branch_code as "Branch Code" from b_account""",
    # ----------------------------------------------------------- generic
    "scan_ledger": f"select {_LED} from b_ledger_entry where {_ZW}",
    "const_columns": f"""
select trn_ref_no, ac_entry_sr_no, 'CASH' as mode, cast(0 as double) as clearing_amount
from b_ledger_entry where trn_dt = {_TD}""",
    "between_dates": f"""
select a.cust_ac_no, cast(a.ac_open_date as varchar) as ac_open_date,
       cast(c.closing_date as varchar) as closing_date
from b_account a left join b_account_closure c on c.ac_no = a.cust_ac_no
where a.ac_open_date between {D(P.EKYC_FROM)} and {D(P.EKYC_TO)}
  and (c.closing_date is null or c.closing_date not between {D(P.EKYC_FROM)} and {D(P.EKYC_TO)})""",
    "prefix_filter": """
select branch_code, count(*) as n, cast(sum(lcy_closing_bal) as double) as closing
from b_balance_history
where account = '11010010001' or (account like '21%' and nullif(substr(account, 9, 3), '') <> '000')
group by branch_code""",
    "substr_type": """
select nullif(substr(account, 4, 1), '') as type, count(*) as n,
       cast(sum(lcy_closing_bal) as double) as closing
from b_balance_history where account like '21%' group by 1""",
    "signed_side": f"""
select drcr_ind,
       case when (drcr_ind = 'D' and lcy_amount >= 0) or (drcr_ind = 'C' and lcy_amount < 0) then 'debit'
            when (drcr_ind = 'C' and lcy_amount >= 0) or (drcr_ind = 'D' and lcy_amount < 0) then 'credit'
       end as side,
       count(*) as n, cast(sum(abs(lcy_amount)) as double) as amount
from b_ledger_entry where {_ZW} group by 1, 2""",
    "anti_notin": """
select cast(value_date as varchar) as loop_date from b_calendar
where dayofweek(value_date) not in (0, 6)
  and value_date not in (select holiday_date from b_holiday)""",
    "join_inner_dims": f"""
select b.branch_name, g.type, count(*) as n, cast(sum(e.lcy_amount) as double) as amount
from b_ledger_entry e join b_gl_master g on e.ac_no = g.gl_code
join b_branch b on e.ac_branch = b.branch_code
where e.{_ZW} group by b.branch_name, g.type""",
    "agg_sum": """
select cast(trn_dt as varchar) as trn_dt, ac_branch, cast(sum(lcy_amount) as double) as amount,
       count(*) as n
from b_ledger_entry group by trn_dt, ac_branch""",
    "agg_minmax_count": """
select ac_no, cast(min(trn_dt) as varchar) as first_dt, cast(max(trn_dt) as varchar) as last_dt,
       count(trn_ref_no) as n
from b_ledger_entry where cust_gl = 'A' group by ac_no""",
    "distinct_dates": """
select distinct cast(trn_dt as varchar) as trn_dt from b_ledger_entry where event = 'REVR'""",
    "fn_dates": """
select cast(value_date as varchar) as value_date, dayofweek(value_date) not in (0, 6) as weekday,
       upper(strftime(value_date, '%d-%b-%y')) as label
from b_calendar""",
}
