"""The same queries as SQL for DuckDB, written independently of the library."""

from __future__ import annotations

RAW = """
raw0 as (
  select case when l_returnflag = 'R' then 'C' else '' end || cast(l_orderkey as varchar) as InvoiceNo,
         cast(l_partkey as varchar) as StockCode,
         case when l_partkey % 50 = 0 then null else p_name end as Description,
         cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as int) as Quantity,
         o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int) as InvoiceDate,
         cast(case when l_partkey % 70 = 0 then 0 else p_retailprice end as decimal(12,2)) as UnitPrice,
         case when o_orderkey % 40 = 0 then null
              when o_orderkey % 500 = 3 then 1000000 + o_orderkey
              else o_custkey end as CustomerID,
         case when l_suppkey % 20 = 0 then null else n_name end as Country
  from lineitem
  join orders on l_orderkey = o_orderkey
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey),
raw as (select * from raw0 union all select * from raw0 where CustomerID % 25 = 0)"""

CLEAN = RAW + """,
present as (select * from raw where CustomerID is not null and Description is not null),
single as (select distinct * from present),
coded as (select * from single where length(regexp_replace(StockCode, '[^0-9]', '', 'g')) > 1),
lines as (
  select InvoiceNo, StockCode, upper(Description) as Description, Quantity, InvoiceDate, UnitPrice, CustomerID,
         Country, case when InvoiceNo like 'C%' then 'Cancelled' else 'Completed' end as Transaction_Status,
         cast(InvoiceDate as date) as InvoiceDay, cast(UnitPrice * Quantity as double) as Spend
  from coded where Description not in ('small ring', 'red widget') and UnitPrice > 0)"""

FEATURES = CLEAN + """,
base as (
  select CustomerID, count(*) as n, max(InvoiceDay) as last_day, min(InvoiceDay) as first_day,
         count(distinct InvoiceNo) as Total_Transactions,
         cast(sum(Quantity) as bigint) as Total_Products_Purchased,
         sum(UnitPrice * Quantity)::double as Total_Spend,
         count(distinct StockCode) as Unique_Products_Purchased,
         count(distinct case when Transaction_Status = 'Cancelled' then InvoiceNo end) as Cancellation_Frequency
  from lines group by CustomerID),
latest as (select max(InvoiceDay) as d from lines),
days as (
  select CustomerID, k from (
    select CustomerID, k, row_number() over (partition by CustomerID order by n desc, k) as r from (
      select CustomerID, isodow(InvoiceDate) - 1 as k, count(*) as n from lines group by all)) where r = 1),
hours as (
  select CustomerID, k from (
    select CustomerID, k, row_number() over (partition by CustomerID order by n desc, k) as r from (
      select CustomerID, hour(InvoiceDate) as k, count(*) as n from lines group by all)) where r = 1),
countries as (
  select CustomerID, k from (
    select CustomerID, k, row_number() over (partition by CustomerID order by n desc, k) as r from (
      select CustomerID, Country as k, count(*) as n from lines where Country is not null group by all)) where r = 1),
monthly as (
  select CustomerID, year(InvoiceDate) as Year, month(InvoiceDate) as Month,
         sum(UnitPrice * Quantity)::double as Total_Spend
  from lines group by all),
ordered as (
  select *, row_number() over (partition by CustomerID order by Year, Month) - 1 as Ordinal from monthly),
months as (
  select CustomerID, avg(Total_Spend) as m, coalesce(stddev_samp(Total_Spend), 0) as s,
         case when count(*) > 1 then regr_slope(Total_Spend, Ordinal) else 0 end as t
  from ordered group by CustomerID),
features as (
  select b.CustomerID,
         datediff('day', last_day, latest.d) as Days_Since_Last_Purchase,
         Total_Transactions, Total_Products_Purchased, Total_Spend,
         Total_Spend / Total_Transactions as Average_Transaction_Value,
         Unique_Products_Purchased,
         datediff('day', first_day, last_day) / (n - 1) as Average_Days_Between_Purchases,
         days.k as Day_Of_Week, hours.k as Hour,
         case when c.k is null then null when c.k = 'NATION_0' then 1 else 0 end as Is_UK,
         Cancellation_Frequency, Cancellation_Frequency / Total_Transactions as Cancellation_Rate,
         m as Monthly_Spending_Mean, s as Monthly_Spending_Std, t as Spending_Trend
  from base b cross join latest
  join days on days.CustomerID = b.CustomerID join hours on hours.CustomerID = b.CustomerID
  join months on months.CustomerID = b.CustomerID left join countries c on c.CustomerID = b.CustomerID
  where n >= 2)"""

WHOLE = [
    "Days_Since_Last_Purchase", "Total_Transactions", "Total_Products_Purchased", "Unique_Products_Purchased",
    "Day_Of_Week", "Hour", "Is_UK", "Cancellation_Frequency",
]
FEATURE_NAMES = [
    "Days_Since_Last_Purchase", "Total_Transactions", "Total_Products_Purchased", "Total_Spend",
    "Average_Transaction_Value", "Unique_Products_Purchased", "Average_Days_Between_Purchases", "Day_Of_Week",
    "Hour", "Is_UK", "Cancellation_Frequency", "Monthly_Spending_Mean", "Monthly_Spending_Std", "Spending_Trend",
]
SHORT = ["Days_Since_Last_Purchase", "Day_Of_Week", "Hour", "Is_UK"]
FEATURE_LIST = ", ".join(
    f"cast({c} as int) as {c}" if c in SHORT else c if c in WHOLE else f"round({c}, 6) as {c}" for c in FEATURE_NAMES
)

RECOMMEND = FEATURES + """,
customers as (select f.*, c_mktsegment as cluster from features f join customer on c_custkey = f.CustomerID),
sold as (select l.*, cluster from lines l join customers c on c.CustomerID = l.CustomerID),
best as (
  select cluster, StockCode, Description, cast(sum(Quantity) as bigint) as Quantity
  from sold group by cluster, StockCode, Description),
top as (
  select * from (
    select *, row_number() over (partition by cluster order by Quantity desc, StockCode, Description) as Rank
    from best) where Rank <= 10),
bought as (select distinct CustomerID, cluster, StockCode from sold),
options as (
  select c.CustomerID, c.cluster, t.StockCode, t.Description,
         row_number() over (partition by c.CustomerID order by t.Rank) as Position
  from customers c join top t on t.cluster = c.cluster
  where not exists (select 1 from bought b where b.CustomerID = c.CustomerID and b.StockCode = t.StockCode)),
picked as (select * from options where Position <= 3),
slots as (
  select CustomerID,
         max(case when Position = 1 then StockCode end) as Rec1_StockCode,
         max(case when Position = 1 then Description end) as Rec1_Description,
         max(case when Position = 2 then StockCode end) as Rec2_StockCode,
         max(case when Position = 2 then Description end) as Rec2_Description,
         max(case when Position = 3 then StockCode end) as Rec3_StockCode,
         max(case when Position = 3 then Description end) as Rec3_Description
  from picked group by CustomerID),
recommended as (
  select c.*, s.* exclude (CustomerID) from customers c left join slots s on s.CustomerID = c.CustomerID)"""

REC_LIST = ", ".join(f"Rec{i}_{part}" for i in (1, 2, 3) for part in ("StockCode", "Description"))

LINE_LIST = (
    "InvoiceNo, StockCode, Description, Quantity, cast(InvoiceDate as varchar) as InvoiceDate, "
    "cast(UnitPrice as double) as UnitPrice, CustomerID, Country"
)
RAW_LIST = LINE_LIST.replace("CustomerID", "cast(CustomerID as double) as CustomerID")
STATUS = "case when InvoiceNo like 'C%' then 'Cancelled' else 'Completed' end as Transaction_Status"

ROWS = {
    "s1_csv_scan": f"select {RAW_LIST} from raw",
    "s2_normalize_nulls": (
        "select InvoiceNo, StockCode, nullif(Description, 'green bolt') as Description, Quantity, cast(InvoiceDate as varchar) as InvoiceDate, "
        "cast(UnitPrice as double) as UnitPrice, cast(CustomerID as double) as CustomerID, nullif(Country, 'NATION_3') as Country from raw"
    ),
    "c1_drop_missing": f"select {RAW_LIST} from raw where CustomerID is not null and Description is not null",
    "c2_dedupe": (
        f"select {RAW_LIST} from (select distinct * from raw "
        "where CustomerID is not null and Description is not null)"
    ),
    "c3_status": f"select {RAW_LIST}, {STATUS} from raw",
    "c4_anomalous_codes": (
        "select distinct StockCode from raw where length(regexp_replace(StockCode, '[^0-9]', '', 'g')) <= 1"
    ),
    "c5_drop_anomalous": (
        f"select {RAW_LIST} from raw where length(regexp_replace(StockCode, '[^0-9]', '', 'g')) > 1"
    ),
    "c6_drop_service": (
        f"select {RAW_LIST} from raw where CustomerID is not null and Description is not null "
        "and Description not in ('small ring', 'red widget')"
    ),
    "c7_upper": f"select {RAW_LIST.replace('Description', 'upper(Description) as Description')} from raw",
    "c8_positive_price": f"select {RAW_LIST} from raw where UnitPrice > 0",
    "f1_parse_timestamp": "select InvoiceNo, StockCode, cast(InvoiceDate as varchar) as InvoiceDate from raw",
}

LINES = {
    "c9_service_pct": (
        "select round(avg(case when Description in ('small ring', 'red widget') then 1.0::double else 0 end) * 100, 6) "
        "as service_pct from coded"
    ),
    "c10_clean": f"select {LINE_LIST}, Transaction_Status from lines",
    "t5_stock_codes": "select distinct StockCode from present",
    "f_line_columns": (
        "select InvoiceNo, StockCode, cast(CustomerID as double) as CustomerID, cast(InvoiceDay as varchar) as InvoiceDay, Spend as Total_Spend, "
        "cast(isodow(InvoiceDate) - 1 as int) as Day_Of_Week, cast(hour(InvoiceDate) as int) as Hour, "
        "cast(year(InvoiceDate) as int) as Year, cast(month(InvoiceDate) as int) as Month, "
        "cast(datediff('day', InvoiceDay, date '1999-01-01') as int) as Days_Before_1999, "
        "cast(length(regexp_replace(StockCode, '[^0-9]', '', 'g')) as int) as Digits, "
        "case when Country = 'NATION_0' then 1 else 0 end as Is_Home, "
        "case when InvoiceNo like 'C%' then 1 else 0 end as Is_Cancelled from lines"
    ),
    "a1_last_day": "select CustomerID, cast(max(InvoiceDay) as varchar) as InvoiceDay from lines group by CustomerID",
    "a2_recency": (
        "select CustomerID, cast(datediff('day', max(InvoiceDay), (select max(InvoiceDay) from lines)) as int) "
        "as Days_Since_Last_Purchase from lines group by CustomerID"
    ),
    "a3_transactions": (
        "select CustomerID, count(distinct InvoiceNo) as Total_Transactions from lines group by CustomerID"
    ),
    "a4_quantity": (
        "select CustomerID, cast(sum(Quantity) as bigint) as Total_Products_Purchased from lines group by CustomerID"
    ),
    "a5_spend": (
        "select CustomerID, round(sum(UnitPrice * Quantity)::double, 6) as Total_Spend from lines group by CustomerID"
    ),
    "a6_avg_transaction": (
        "select CustomerID, round(sum(UnitPrice * Quantity)::double / count(distinct InvoiceNo), 6) "
        "as Average_Transaction_Value from lines group by CustomerID"
    ),
    "a7_unique_products": (
        "select CustomerID, count(distinct StockCode) as Unique_Products_Purchased from lines group by CustomerID"
    ),
    "a10_cancellations": (
        "select CustomerID, count(distinct InvoiceNo) filter (where InvoiceNo like 'C%') as Cancellation_Frequency "
        "from lines group by CustomerID"
    ),
    "a11_cancellation_rate": (
        "select CustomerID, round(count(distinct InvoiceNo) filter (where InvoiceNo like 'C%') "
        "/ count(distinct InvoiceNo), 6) as Cancellation_Rate from lines group by CustomerID"
    ),
    "w1_gap_closed_form": (
        "select CustomerID, round(datediff('day', min(InvoiceDay), max(InvoiceDay)) / (count(*) - 1), 6) "
        "as Average_Days_Between_Purchases from lines group by CustomerID having count(*) > 1"
    ),
    "w1_gap_window": (
        "select CustomerID, round(avg(gap), 6) as Average_Days_Between_Purchases from (select CustomerID, "
        "datediff('day', lag(InvoiceDay) over (partition by CustomerID order by InvoiceDate, InvoiceNo, StockCode), "
        "InvoiceDay) as gap from lines) where gap is not null group by CustomerID"
    ),
    "j2_multi_line_customers": (
        "select CustomerID, count(*) as Lines from lines group by CustomerID having count(*) >= 2"
    ),
    "j5_lines_with_cluster": (
        f"select {LINE_LIST}, Transaction_Status, c_mktsegment as cluster from lines "
        "join customer on c_custkey = CustomerID"
    ),
    "j8_global_last_day": "select cast(max(InvoiceDay) as varchar) as Most_Recent_Day from lines",
}

CUT = "(select quantile_cont(Total_Spend, 0.95) from features)"
REMAINDER = "cast(2 - least(CustomerID % 7, 2) as int)"
SCALED = [c for c in FEATURE_NAMES if c not in ("Is_UK", "Day_Of_Week")]
SCALED_TABLE = (
    "scaled as (select CustomerID, Is_UK, Day_Of_Week, "
    + ", ".join(
        f"case when stddev_pop({c}) over () = 0 then 0 "
        f"else ({c} - avg({c}) over ()) / stddev_pop({c}) over () end as {c}"
        for c in SCALED
    )
    + " from features)"
)
POINT = "Days_Since_Last_Purchase", "Total_Transactions", "Total_Spend"


def _distance(centroid: list[float]) -> str:
    return " + ".join(f"({c} - {x}) ** 2" for c, x in zip(POINT, centroid, strict=True))


FEATURE_QUERIES = {
    "a8_favorite_day": "select CustomerID, cast(k as int) as Day_Of_Week from days",
    "a9_favorite_hour": "select CustomerID, cast(k as int) as Hour from hours",
    "a12_main_country": "select CustomerID, k as Country from countries",
    "a12_home_country": (
        "select b.CustomerID, case when b.CustomerID % 40 = 0 or k is null then null "
        "when k = 'NATION_0' then 1 else 0 end as Is_UK "
        "from base b left join countries c on c.CustomerID = b.CustomerID"
    ),
    "j3_left_join_home": (
        "select b.CustomerID, case when k = 'NATION_0' then 1 else 0 end as Is_UK "
        "from base b left join countries c on c.CustomerID = b.CustomerID"
    ),
    "a13_monthly_spend": (
        "select CustomerID, cast(Year as int) as Year, cast(Month as int) as Month, "
        "round(Total_Spend, 6) as Total_Spend from monthly"
    ),
    "a14_monthly_stats": (
        "select CustomerID, round(m, 6) as Monthly_Spending_Mean, round(s, 6) as Monthly_Spending_Std from months"
    ),
    "a15_trend": "select CustomerID, round(t, 6) as Spending_Trend from months",
    "w2_month_ordinal": (
        "select CustomerID, cast(Year as int) as Year, cast(Month as int) as Month, "
        "round(Total_Spend, 6) as Total_Spend, cast(Ordinal as int) as Ordinal from ordered"
    ),
    "a17_features": f"select CustomerID, {FEATURE_LIST} from features",
    "a17_features_with_rate": (
        f"select CustomerID, {FEATURE_LIST}, round(Cancellation_Rate, 6) as Cancellation_Rate from features"
    ),
    "j4_drop_outlier_lines": (
        f"select {LINE_LIST}, Transaction_Status from lines "
        f"where CustomerID not in (select CustomerID from features where Total_Spend > {CUT})"
    ),
    "m9_append_cluster": (
        f"select CustomerID, {FEATURE_LIST}, c_mktsegment as cluster from features "
        "join customer on c_custkey = CustomerID"
    ),
    "m2_split": (
        f"select CustomerID, round(Total_Spend, 6) as Total_Spend, "
        f"case when Total_Spend > {CUT} then 'outlier' else 'inlier' end as Part from features"
    ),
    "m2_flags": (
        f"select CustomerID, case when Total_Spend > {CUT} then -1 else 1 end as Outlier_Scores, "
        f"case when Total_Spend > {CUT} then 1 else 0 end as Is_Outlier from features"
    ),
    "m3_threshold": (
        f"select round({CUT}, 6) as threshold, count(*) filter (where Total_Spend > {CUT}) as outliers, "
        "count(*) as customers from features"
    ),
    "m5_scale": (
        f"select CustomerID, Is_UK, cast(Day_Of_Week as int) as Day_Of_Week, {', '.join(f'round({c}, 6) as {c}' for c in SCALED)} from scaled"
    ),
    "m6b_covariance": " union all ".join(
        f"select '{a}' as first, '{b}' as second, "
        f"round(covar_pop(coalesce({a}, 0), coalesce({b}, 0)), 6) as covariance from scaled"
        for i, a in enumerate(FEATURE_NAMES)
        for b in FEATURE_NAMES[i:]
    ),
    "m7b_assign": (
        "select CustomerID, cast(case when d0 <= d1 and d0 <= d2 then 0 when d1 <= d2 then 1 else 2 end as int) "
        f"as cluster from (select CustomerID, {_distance([10.0, 20.0, 200000.0])} as d0, "
        f"{_distance([100.0, 10.0, 100000.0])} as d1, {_distance([400.0, 5.0, 50000.0])} as d2 from features)"
    ),
    "m8_relabel": (
        "select CustomerID, cast(new as int) as cluster from "
        f"(select CustomerID, {REMAINDER} as old from features) join (select old, "
        f"row_number() over (order by n desc, old) - 1 as new from (select {REMAINDER} as old, count(*) as n "
        "from features group by all)) using (old)"
    ),
    "m8_relabel_fixed": (
        f"select CustomerID, case {REMAINDER} when 0 then 1 when 1 then 2 else 0 end as cluster from features"
    ),
    "a18_cluster_sizes": f"select {REMAINDER} as cluster, count(*) as Customers from features group by all",
    "m10_quality": f"""
select count(*)::int as clusters,
       round((sum(n * ((c1 - g1) ** 2 + (c2 - g2) ** 2 + (c3 - g3) ** 2)) / (count(*) - 1))
             / (sum(within) / (sum(n) - count(*))), 6) as calinski_harabasz,
       round(avg(worst), 6) as davies_bouldin
from (
  select s.*, (select max((s.radius + o.radius)
                          / sqrt((s.c1 - o.c1) ** 2 + (s.c2 - o.c2) ** 2 + (s.c3 - o.c3) ** 2))
               from spread o where o.cluster <> s.cluster) as worst
  from spread s)
cross join (select avg({POINT[0]}) as g1, avg({POINT[1]}) as g2, avg({POINT[2]}) as g3 from features)""",
    # every pair of points
    "m10_silhouette": """
select round(avg(case when b is null then null when alone or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6)
         as silhouette
from (
  select CustomerID, max(a) as a, min(b) as b, max(alone) as alone
  from (
    select p.CustomerID, case when o.cluster = p.cluster then sum(d) / greatest(count(*) - 1, 1) end as a,
           case when o.cluster <> p.cluster then sum(d) / count(*) end as b,
           o.cluster = p.cluster and count(*) = 1 as alone
    from points p, points o,
         lateral (select (p.x1 - o.x1) ** 2 + (p.x2 - o.x2) ** 2 + (p.x3 - o.x3) ** 2 as d) t
    group by p.CustomerID, p.cluster, o.cluster)
  group by CustomerID)""",
}
QUALITY_TABLES = f"""
points as (select CustomerID, {REMAINDER} as cluster, {POINT[0]} as x1, {POINT[1]} as x2, {POINT[2]} as x3 from features),
centres as (
  select cluster, count(*) as n, avg(x1) as c1, avg(x2) as c2, avg(x3) as c3 from points group by cluster),
spread as (
  select cluster, n, c1, c2, c3, sum(d) as within, avg(sqrt(d)) as radius
  from (select c.*, (x1 - c1) ** 2 + (x2 - c2) ** 2 + (x3 - c3) ** 2 as d from points p join centres c
        on c.cluster = p.cluster) group by all)"""

# eigenvalues and eigenvectors of the covariance by cyclic Jacobi rotations, one in each step, of a matrix that is one
# list, row by row
N = len(FEATURE_NAMES)
ROTATIONS = 10 * N * (N - 1) // 2
COMPONENTS = f"""
vectors as (
  select CustomerID, list_value({", ".join(f"coalesce({c}, 0)::double" for c in FEATURE_NAMES)}) as r from scaled),
means as (select list(m order by i) as mu from (select i, avg(r[i + 1]) as m from vectors, range({N}) t(i) group by i)),
covariances as (
  select list(c order by k) as m
  from (select k, covar_samp(r[k // {N} + 1], r[k % {N} + 1]) as c from vectors, range({N * N}) t(k) group by k)),
pairs as (
  select list(p order by p, q) as ps, list(q order by p, q) as qs from range({N}) a(p), range({N}) b(q) where p < q),
jacobi(k, m, v) as (
  select 0, m, list_transform(range({N * N}), lambda i: case when i // {N} = i % {N} then 1.0 else 0.0 end::double)
  from covariances
  union all
  select k + 1,
         list_transform(range({N * N}), lambda i: case when i // {N} = p then c * b[i + 1] - s * b[q * {N} + i % {N} + 1]
                                                       when i // {N} = q then s * b[p * {N} + i % {N} + 1] + c * b[i + 1]
                                                       else b[i + 1] end),
         list_transform(range({N * N}), lambda i: case when i % {N} = p then c * v[i + 1] - s * v[i - p + q + 1]
                                                       when i % {N} = q then s * v[i - q + p + 1] + c * v[i + 1]
                                                       else v[i + 1] end)
  from (
    select *, list_transform(range({N * N}), lambda i: case when i % {N} = p then c * m[i + 1] - s * m[i - p + q + 1]
                                                            when i % {N} = q then s * m[i - q + p + 1] + c * m[i + 1]
                                                            else m[i + 1] end) as b
    from (
      select *, t * c as s
      from (
        select *, 1 / sqrt(t * t + 1) as c
        from (
          select *, case when pq = 0 then 0
                         else (case when qq >= pp then 1 else -1 end) * (case when pq > 0 then 1 else -1 end)
                              / (abs((qq - pp) / (2 * pq)) + sqrt(((qq - pp) / (2 * pq)) ** 2 + 1)) end as t
          from (
            select *, m[p * {N} + p + 1] as pp, m[q * {N} + q + 1] as qq, m[p * {N} + q + 1] as pq
            from (select k, m, v, ps[k % len(ps) + 1] as p, qs[k % len(ps) + 1] as q from jacobi, pairs
                  where k < {ROTATIONS}))))))),
components as (
  select *, row_number() over (order by value desc) as component
  from (
    select m[i * {N} + i + 1] as value, list_transform(range({N}), lambda j: v[j * {N} + i + 1]) as axis
    from jacobi, range({N}) t(i) where k = {ROTATIONS})),
axes as (
  select component, list_transform(axis, lambda x: x * sign(list_max(axis) + list_min(axis))) as axis from components)"""
TREES, SAMPLE = 100, 256
_SPLIT = """varying[(('0x' || substr(h, 1, 8))::bigint % len(varying)) + 1]"""


def _ends(of: str, over: str) -> str:
    return ", ".join(f"{of}(r[{i}]) {over}" for i in range(1, N + 1))


# trees grown level by level: the rows of each node, then the nodes, then the way of every customer down each tree
FOREST = f"""
numbers as (
  select CustomerID, list_value({", ".join(f"coalesce({c}, 0)::double" for c in FEATURE_NAMES)}) as r,
         md5(CustomerID || ':0') as own from features),
drawn as (
  select tree, CustomerID, r, count(*) over (partition by tree) as size from (
    select tree, CustomerID, r, row_number() over (partition by tree order by
             (('0x' || substr(own, 1, 8))::bigint + (tree + 1) * ('0x' || substr(own, 9, 8))::bigint) % 4294967291,
             CustomerID) as place
    from numbers, range({TREES}) t(tree)) where place <= {SAMPLE}),
grown(tree, level, node, size, CustomerID, r) as (
  select tree, 0, 1, size, CustomerID, r from drawn
  union all
  select tree, level + 1, 2 * node + case when r[f + 1] <= low[f + 1] + u * (high[f + 1] - low[f + 1]) then 0 else 1 end,
         size, CustomerID, r
  from (
    select *, {_SPLIT} as f, ('0x' || substr(h, 9, 13))::bigint / 4503599627370496::double as u
    from (
      select *, list_filter(range({N}), lambda i: high[i + 1] > low[i + 1]) as varying, md5('0:' || tree || ':' || node) as h
      from (
        select *, count(*) over here as n, list_value({_ends("min", "over here")}) as low,
               list_value({_ends("max", "over here")}) as high
        from grown window here as (partition by tree, node))
      where n > 1 and level < ceil(log2(greatest(size, 2))))
    where len(varying) > 0)),
nodes as (
  select *, len(varying) = 0 or n < 2 or level >= ceil(log2(greatest(size, 2))) as leaf,
         case when len(varying) > 0 then {_SPLIT} end as f,
         ('0x' || substr(h, 9, 13))::bigint / 4503599627370496::double as u
  from (
    select *, list_filter(range({N}), lambda i: high[i + 1] > low[i + 1]) as varying, md5('0:' || tree || ':' || node) as h
    from (
      select tree, level, node, max(size) as size, count(*) as n, list_value({_ends("min", "")}) as low,
             list_value({_ends("max", "")}) as high
      from grown group by tree, level, node))),
ways(CustomerID, r, tree, node) as (
  select CustomerID, r, tree, 1 from numbers, range({TREES}) t(tree)
  union all
  select w.CustomerID, w.r, w.tree,
         2 * w.node + case when w.r[f + 1] <= low[f + 1] + u * (high[f + 1] - low[f + 1]) then 0 else 1 end
  from ways w join nodes s on s.tree = w.tree and s.node = w.node where not leaf),
scores as (
  select CustomerID, 2 ** (-sum((level + {{short}}) / greatest({{whole}}, 1e-12)) / {TREES}) as score
  from ways w join nodes s on s.tree = w.tree and s.node = w.node where leaf group by CustomerID),
cut as (select quantile_cont(score, 0.95) as at from scores)"""
_PATH = "case when {n} > 2 then 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} when {n} = 2 then 1 else 0 end"
FOREST = FOREST.format(short=_PATH.format(n="n"), whole=_PATH.format(n="size"))
FEATURE_QUERIES |= {
    "m1_isolation_forest": (
        f"select CustomerID, {FEATURE_LIST}, case when score > cut.at then -1 else 1 end as Outlier_Scores, "
        "case when score > cut.at then 1 else 0 end as Is_Outlier from features join scores using (CustomerID), cut"
    ),
    "m6c_explained_variance": (
        "select cast(component as int) as component, round(value / sum(value) over (), 6) as share from components"
    ),
    "m6_pca": "select CustomerID, "
    + ", ".join(f"max(x) filter (component = {i}) as PC{i}" for i in range(1, 7))
    + " from (select CustomerID, component, round(list_dot_product(list_transform(range("
    + f"{N}), lambda i: r[i + 1] - mu[i + 1]), axis), 4) as x from vectors, means, axes where component <= 6) group by CustomerID",
}

REC_QUERIES = {
    "rec1_best_sellers": "select * from best",
    "rec2_top10": "select cluster, StockCode, Description, Quantity, cast(Rank as int) as Rank from top",
    "rec3_purchases": "select * from bought",
    "rec4_candidates": (
        "select CustomerID, cluster, StockCode, Description, cast(Position as int) as Position from picked"
    ),
    "rec5_wide": f"select CustomerID, cluster, {REC_LIST} from recommended",
    "rec6_recommend": f"select CustomerID, {FEATURE_LIST}, cluster, {REC_LIST} from recommended",
    "s3_csv_sink": (
        f"select cast(CustomerID as double) as CustomerID, {FEATURE_LIST}, cluster, {REC_LIST} from recommended"
    ),
    "s5_sample_rows": (
        f"select CustomerID, {REC_LIST} from recommended "
        "order by md5(cast(CustomerID as varchar) || ':0'), CustomerID limit 10"
    ),
    "s4_preview": (
        f"select CustomerID, {FEATURE_LIST}, cluster, {REC_LIST} from recommended "
        "order by cluster, CustomerID limit 5"
    ),
}


def _oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for head, tails in ((RAW, ROWS), (CLEAN, LINES), (FEATURES, FEATURE_QUERIES), (RECOMMEND, REC_QUERIES)):
        for name, tail in tails.items():
            tables = head
            if " scaled" in tail or name in ("m6_pca", "m6c_explained_variance"):
                tables += ",\n" + SCALED_TABLE
            if name in ("m6_pca", "m6c_explained_variance"):
                tables = f"recursive {tables.strip()},{COMPONENTS}"
            if name == "m1_isolation_forest":
                tables = f"recursive {tables.strip()},{FOREST}"
            if name.startswith("m10_"):
                tables += "," + QUALITY_TABLES
            found[name] = f"with {tables.strip()}\n{tail}"
    return found


ORACLES = _oracles()
