"""Plain SQL for every registered query, to be run by another engine on the same tables.

Written query by query, without the shared pass and the combined measures of the Spark
plans, so that agreement means something.
"""

from __future__ import annotations

_ACCOUNT = """account as (
  select cast(p_partkey as varchar(20)) as name, p_brand as parent_account,
         case p_type when 'ECONOMY' then 'Income' when 'PROMO' then 'Income'
                     when 'LARGE' then 'Expense' when 'MEDIUM' then 'Expense'
                     when 'SMALL' then 'Asset' else 'Liability' end as root_type
  from part)"""

_GL_ENTRY = """gl_entry as (
  select cast(l_partkey as varchar(20)) as account, cast(l_shipdate as date) as posting_date,
         case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2))
              else cast(0 as decimal(18,2)) end as debit,
         case when l_returnflag <> 'R' then cast(l_extendedprice as decimal(18,2))
              else cast(0 as decimal(18,2)) end as credit,
         cast(year(l_shipdate) as varchar(4)) as fiscal_year,
         cast(null as varchar(20)) as party, cast(null as varchar(20)) as party_type,
         'Journal Entry' as voucher_type
  from lineitem
  union all
  select 'AR', cast(o_orderdate as date), cast(0 as decimal(18,2)),
         cast(o_totalprice as decimal(18,2)), cast(year(o_orderdate) as varchar(4)),
         cast(o_custkey as varchar(20)), 'Customer',
         case when o_orderstatus = 'F' then 'Payment Entry' else 'Sales Invoice' end
  from orders)"""

_SALES_INVOICE = """sales_invoice as (
  select cast(o_orderdate as date) as posting_date, cast(o_totalprice as decimal(18,2)) as total,
         case o_orderstatus when 'F' then 'Paid' when 'P' then 'Overdue'
                            else 'Unpaid' end as status
  from orders)"""

_PURCHASE_INVOICE = """purchase_invoice as (
  select cast(l_shipdate as date) as posting_date, cast(l_extendedprice as decimal(18,2)) as total,
         case l_linestatus when 'F' then 'Paid' else 'Unpaid' end as status
  from lineitem)"""

_EMPLOYEE = """employee as (
  select cast(event_id as varchar(20)) as name, cast(ts as date) as date_of_joining
  from events where event_type = 'signup')"""

_CASH = """cash_category as (
  select * from (values (1, 'Brand#11'), (2, 'Brand#12'), (3, 'Brand#13')) v(ord, parent_account))"""

_EXPENSE = """expense_category as (
  select * from (values (1, 'Brand#14'), (2, 'Brand#15'), (3, 'Brand#16'), (4, 'Brand#17'),
    (5, 'Brand#18'), (6, 'Brand#19'), (7, 'Brand#20'), (8, 'Brand#21'), (9, 'Brand#22'))
    v(ord, parent_account))"""

_CASH_IN = "('Brand#11', 'Brand#12', 'Brand#13')"
_EXPENSE_IN = (
    "('Brand#14', 'Brand#15', 'Brand#16', 'Brand#17', 'Brand#18', "
    "'Brand#19', 'Brand#20', 'Brand#21', 'Brand#22')"
)

_LEDGER = (_ACCOUNT, _GL_ENTRY)


def _with(ctes: tuple[str, ...], query: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + query


def _paid_daily(table: str, name: str) -> str:
    return f"""select posting_date, cast(sum(total) as double) as {name}
from {table} where lower(rtrim(status)) = 'paid' group by posting_date"""


def _balances(parents: str, rows: str, name: str) -> str:
    return f"""select g.account as account_type, a.parent_account as account_parent,
       cast(sum(g.debit - g.credit) as double) as {name}
from gl_entry g join account a on a.name = g.account
where a.parent_account in {parents} and {rows}
group by g.account, a.parent_account"""


def _category_totals(name: str, parents: str, rows: str) -> str:
    return f"""{name} as (
  select a.parent_account, sum(g.debit - g.credit) as total
  from gl_entry g join account a on a.name = g.account
  where a.parent_account in {parents} and {rows}
  group by a.parent_account)"""


def _rollup(category: str, cur: str, prev: str) -> str:
    return f"""select cast(c.ord as integer) as ord, c.parent_account,
       cast(coalesce(cur.total, 0) as double) as {cur},
       cast(coalesce(prev.total, 0) as double) as {prev}
from {category} c
left join cur on cur.parent_account = c.parent_account
left join prev on prev.parent_account = c.parent_account"""


def _root_totals(root_type: str, year: str) -> str:
    return f"""select cast(sum(g.debit) as double) as debit,
       cast(sum(g.credit) as double) as credit,
       cast(sum(g.debit) - sum(g.credit) as double) as net
from account a join gl_entry g on a.name = g.account
where a.root_type = '{root_type}' and g.fiscal_year = '{year}'"""


def _net(root_type: str) -> str:
    return f"""coalesce((select sum(g.debit) - sum(g.credit)
  from account a join gl_entry g on a.name = g.account
  where a.root_type = '{root_type}' and g.fiscal_year = '2000'), 0)"""


_TOP_CUSTOMERS = """select party as customer, sum(credit) as total_annual
from gl_entry where party_type = 'Customer' and voucher_type = 'Payment Entry'
group by party order by total_annual desc nulls last, customer nulls last limit 5"""

_MONTH_CUR = "month(g.posting_date) = month(date '2000-03-15')"
_MONTH_PREV = "month(g.posting_date) = month(date '2000-03-15') - 1"
_YEAR_CUR = "g.fiscal_year = '2000'"
_YEAR_PREV = "g.fiscal_year = '1999'"

_DAY_SERIES = """select '{series}' as series,
  cast(row_number() over (order by day nulls first) as integer) as ord,
  strftime(day, '%d/%m/%Y') as label, cast(value as double) as value from ({rows}) t"""

_PLACE_SERIES = """select '{series}' as series, cast(c.ord as integer) as ord,
  c.parent_account as label,
  cast(coalesce(t.total, 0) as double) as value
  from {category} c left join {totals} t on t.parent_account = c.parent_account"""


def _dashboard() -> str:
    ctes = (
        _ACCOUNT,
        _GL_ENTRY,
        _SALES_INVOICE,
        _PURCHASE_INVOICE,
        _EMPLOYEE,
        _CASH,
        _EXPENSE,
        _category_totals("cash_cur", _CASH_IN, _YEAR_CUR),
        _category_totals("cash_prev", _CASH_IN, _YEAR_PREV),
        _category_totals("expense_cur", _EXPENSE_IN, _MONTH_CUR),
        _category_totals("expense_prev", _EXPENSE_IN, _MONTH_PREV),
        f"top_customers as ({_TOP_CUSTOMERS})",
    )
    days = {
        "sales_paid": """select posting_date as day, sum(total) as value from sales_invoice
            where lower(rtrim(status)) = 'paid' group by posting_date""",
        "purchase_paid": """select posting_date as day, sum(total) as value from purchase_invoice
            where lower(rtrim(status)) = 'paid' group by posting_date""",
        "income": """select posting_date as day, sum(debit - credit) as value from gl_entry
            where account in (select name from account where parent_account = 'Brand#1')
            group by posting_date""",
        "headcount": """select date_of_joining as day, count(name) as value from employee
            group by date_of_joining""",
    }
    places = {
        "cash_cur": "cash_category",
        "cash_prev": "cash_category",
        "expense_cur": "expense_category",
        "expense_prev": "expense_category",
    }
    parts = [_DAY_SERIES.format(series=s, rows=rows) for s, rows in days.items()]
    parts += [
        _PLACE_SERIES.format(series=s, category=category, totals=s)
        for s, category in places.items()
    ]
    parts.append(
        """select 'top_customers', cast(row_number() over (
  order by total_annual desc nulls last, customer nulls last) as integer),
  customer, cast(total_annual as double) from top_customers"""
    )
    parts += [
        f"""select 'net_{root.lower()}', cast(1 as integer), '{root.lower()}',
  cast({_net(root)} as double)"""
        for root in ("Income", "Expense")
    ]
    return _with(ctes, "\nunion all\n".join(parts))


def oracle_queries() -> dict[str, str]:
    queries = _queries()
    lists = f"""select series, list(label order by ord) as labels, list("value" order by ord) as "values"
from ({queries["dashboard_series"]}) s group by series"""
    large = ("income_daily", "expense_category_rollup", "dashboard_series")
    return (
        queries
        | {"dashboard_lists": lists}
        | {f"{name}_large_chart": queries[name] for name in large}
        | {"dashboard_series_compact": queries["dashboard_series"]}
        | {"top_customers_by_payment_pruned": queries["top_customers_by_payment"]}
    )


def _queries() -> dict[str, str]:
    return {
        "sales_paid_daily": _with((_SALES_INVOICE,), _paid_daily("sales_invoice", "total_si")),
        "purchase_paid_daily": _with(
            (_PURCHASE_INVOICE,), _paid_daily("purchase_invoice", "total_pi")
        ),
        "income_daily": _with(
            _LEDGER,
            """select g.posting_date, a.parent_account as account_parent,
       cast(sum(g.debit - g.credit) as double) as total_pendapatan
from gl_entry g join account a on a.name = g.account
where a.parent_account = 'Brand#1' group by g.posting_date, a.parent_account""",
        ),
        "top_customers_by_payment": _with(
            (_GL_ENTRY,),
            f"""select customer, cast(total_annual as double) as total_annual
from ({_TOP_CUSTOMERS}) t""",
        ),
        "cash_balance_by_account": _with(_LEDGER, _balances(_CASH_IN, _YEAR_CUR, "total")),
        "cash_balance_by_account_prev": _with(_LEDGER, _balances(_CASH_IN, _YEAR_PREV, "total")),
        "cash_category_rollup": _with(
            (
                *_LEDGER,
                _CASH,
                _category_totals("cur", _CASH_IN, _YEAR_CUR),
                _category_totals("prev", _CASH_IN, _YEAR_PREV),
            ),
            _rollup("cash_category", "total_cur", "total_prev"),
        ),
        "expense_by_account_month": _with(_LEDGER, _balances(_EXPENSE_IN, _MONTH_CUR, "total_kas")),
        "expense_by_account_prev_month": _with(
            _LEDGER, _balances(_EXPENSE_IN, _MONTH_PREV, "total_kas")
        ),
        "expense_by_account_prev_month_calendar": _with(
            _LEDGER,
            _balances(
                _EXPENSE_IN,
                "g.posting_date >= date '2000-02-01' and g.posting_date < date '2000-03-01'",
                "total_kas",
            ),
        ),
        "expense_category_rollup": _with(
            (
                *_LEDGER,
                _EXPENSE,
                _category_totals("cur", _EXPENSE_IN, _MONTH_CUR),
                _category_totals("prev", _EXPENSE_IN, _MONTH_PREV),
            ),
            _rollup("expense_category", "total_biaya", "total_biaya_prev"),
        ),
        "headcount_by_join_date": _with(
            (_EMPLOYEE,),
            """select date_of_joining, count(name) as jumlah_employee
from employee group by date_of_joining""",
        ),
        "income_totals_cur": _with(_LEDGER, _root_totals("Income", "2000")),
        "expense_totals_cur": _with(_LEDGER, _root_totals("Expense", "2000")),
        "income_totals_prev": _with(_LEDGER, _root_totals("Income", "1999")),
        "expense_totals_prev": _with(_LEDGER, _root_totals("Expense", "1999")),
        "income_vs_expense": _with(
            _LEDGER,
            f"""select cast({_net("Income")} as double) as pendapatan,
       cast({_net("Expense")} as double) as beban""",
        ),
        "dashboard_series": _dashboard(),
    }
