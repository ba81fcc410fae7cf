"""DuckDB SQL for the deterministic queries, written independently of the Spark plans.

Bootstrapped forests have no SQL counterpart. The ``_exact`` queries run the same jobs with
trees that see all rows and features; their SQL tries every split of every feature.
"""

from __future__ import annotations

from acceptance.queries import LAST_FULL_YEAR, YEAR
from tillcast.sources.star import CUSTOMERS, DATES, FACT, TERRITORIES
from tillcast.sources.warehouse import mart_sql

# The categories of the test tables, in sorted order.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NATIONS = sorted(f"NATION_{i}" for i in range(25))
PROMOTIONS = ["0", "1", "2"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _key(day: str) -> str:
    return f"CAST(year({day}) * 10000 + month({day}) * 100 + day({day}) AS INTEGER)"


def _day(key: str) -> str:
    return f"CAST(strptime(CAST({key} AS VARCHAR), '%Y%m%d') AS DATE)"


LINE_TOTAL = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"

STAR = f"""
fact AS (
  SELECT l_orderkey AS SalesOrderID, {_key("o_orderdate")} AS OrderDateKey,
         {_key("l_shipdate")} AS ShipDateKey, o_custkey AS CustomerKey,
         n_regionkey AS TerritoryKey, CAST(l_quantity AS INTEGER) AS OrderQty,
         l_extendedprice / l_quantity AS UnitPrice, l_discount AS UnitPriceDiscount,
         {LINE_TOTAL} AS LineTotal,
         {LINE_TOTAL} * (1 + CAST(l_tax AS DECIMAL(4,2))) AS TotalDue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
dates AS (
  SELECT DISTINCT {_key("o_orderdate")} AS DateKey,
         CAST(year(o_orderdate) AS INTEGER) AS Year,
         CAST(month(o_orderdate) AS INTEGER) AS Month,
         CAST(quarter(o_orderdate) AS INTEGER) AS Quarter,
         CAST(CASE WHEN day(o_orderdate) = 31 THEN NULL
                   WHEN month(o_orderdate) * 100 + day(o_orderdate)
                        IN (101, 204, 413, 414, 501, 1225) THEN 1
                   ELSE 0 END AS INTEGER) AS IsHolidaySL
  FROM orders
),
territories AS (SELECT r_regionkey AS TerritoryKey, r_name AS TerritoryName FROM region),
customers AS (
  SELECT c_custkey AS CustomerKey, c_mktsegment AS Gender,
         CAST(c_custkey % 3 AS INTEGER) AS EmailPromotion, n_name AS CountryRegionName
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
dated AS (SELECT * FROM fact JOIN dates ON OrderDateKey = DateKey)"""

DAYS = f"date_diff('day', {_day('OrderDateKey')}, {_day('ShipDateKey')})"

SHIPPING = f"CAST(sum({DAYS}) // count({DAYS}) AS BIGINT) AS AvgShippingTime"

DRIVER_AGGREGATES = f"""
  count(DISTINCT SalesOrderID) AS TotalOrders, avg(UnitPrice) AS AvgUnitPrice,
  avg(UnitPriceDiscount) AS AvgDiscount, count(DISTINCT CustomerKey) AS UniqueCustomers,
  {SHIPPING}"""

MARTS = f"""{STAR},
monthly AS (
  SELECT Year, Month, coalesce(Quarter, 0) AS Quarter, coalesce(IsHolidaySL, 0) AS IsHolidaySL,
         TotalSales, TotalQty, TotalOrders, AvgUnitPrice, AvgDiscount, UniqueCustomers,
         AvgShippingTime
  FROM (SELECT Year, Month, Quarter, IsHolidaySL,
               CAST(sum(LineTotal) AS DOUBLE) AS TotalSales,
               CAST(sum(OrderQty) AS BIGINT) AS TotalQty, {DRIVER_AGGREGATES}
        FROM dated GROUP BY Year, Month, Quarter, IsHolidaySL)
),
regional AS (
  SELECT TerritoryName, Year, Month, CAST(sum(OrderQty) AS BIGINT) AS TotalSales,
         {DRIVER_AGGREGATES}
  FROM dated JOIN territories USING (TerritoryKey) GROUP BY TerritoryName, Year, Month
),
customer_month AS (
  SELECT c.CustomerKey, Year, Month, CAST(sum(TotalDue) AS DOUBLE) AS TotalSpent,
         CAST(sum(OrderQty) AS BIGINT) AS TotalQuantity, count(SalesOrderID) AS PurchaseCount,
         Gender, EmailPromotion, CountryRegionName
  FROM dated d JOIN customers c ON d.CustomerKey = c.CustomerKey
  GROUP BY c.CustomerKey, Year, Month, Gender, EmailPromotion, CountryRegionName
)"""

ROUNDED_DRIVERS = (
    "TotalOrders, round(AvgUnitPrice, 6) AS AvgUnitPrice, round(AvgDiscount, 12) AS AvgDiscount, "
    "UniqueCustomers, AvgShippingTime"
)
MEAN_DRIVERS = (
    "round(avg(TotalOrders), 6) AS TotalOrders, round(avg(AvgUnitPrice), 6) AS AvgUnitPrice, "
    "round(avg(AvgDiscount), 12) AS AvgDiscount, "
    "round(avg(UniqueCustomers), 6) AS UniqueCustomers, "
    "round(avg(AvgShippingTime), 6) AS AvgShippingTime"
)
MONTHS = "(SELECT CAST(m AS INTEGER) AS Month FROM range(1, 13) AS t(m))"
CALENDAR = f"CAST({YEAR} AS INTEGER) AS Year, Month, CAST((Month - 1) // 3 + 1 AS INTEGER) AS Quarter"
CUSTOMER_ROW = (
    "CustomerKey, Year, Month, round(TotalSpent, 6) AS TotalSpent, TotalQuantity, PurchaseCount, "
    "Gender, EmailPromotion, CountryRegionName"
)
LINEAR_FEATURES = [
    "Year", "Month", "Quarter", "IsHolidaySL", "MonthIndex", "TotalOrders", "AvgUnitPrice",
    "AvgDiscount", "UniqueCustomers", "AvgShippingTime",
]


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _latest(condition: str) -> str:
    return _with(
        MARTS,
        f"SELECT {CUSTOMER_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY CustomerKey "
        "ORDER BY Year DESC, Month DESC) AS recency FROM customer_month "
        f"WHERE {condition}) WHERE recency = 1",
    )


def _indicators(column: str, values: list[str]) -> str:
    return ", ".join(
        f"CAST(CASE WHEN CAST({column} AS VARCHAR) = '{v}' THEN 1 ELSE 0 END AS DOUBLE) "
        f'AS "{column}_{v}"'
        for v in values[1:]
    )


def _scaled(column: str) -> str:
    return (
        f"round(({column} - avg({column}) OVER ()) / "
        f"(CASE WHEN stddev_pop({column}) OVER () = 0 THEN 1 "
        f"ELSE stddev_pop({column}) OVER () END), 6) AS {column}"
    )


def _vocabulary(column: str, order: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", CAST(row_number() OVER (ORDER BY {order}) - 1 "
        f'AS INTEGER) AS position, CAST({column} AS VARCHAR) AS "value" '
        f"FROM (SELECT DISTINCT {column} FROM customer_month WHERE {column} IS NOT NULL)"
    )


def _least_squares(label: str, output: str, year: str, months: str = MONTHS) -> str:
    """Forecast by sequential Gram-Schmidt over the standardised features.

    Future rows are carried along; means, deviations and projections use training rows
    only. A feature whose remainder vanishes depends on earlier ones and is skipped.
    """
    xs = [f"x{i}" for i in range(len(LINEAR_FEATURES))]
    over = "FILTER (WHERE known) OVER ()"
    history = ", ".join(
        f"CAST({f} AS DOUBLE) AS {x}" for f, x in zip(LINEAR_FEATURES, xs, strict=True)
    )
    ctes = [
        MARTS,
        "indexed AS (SELECT *, (Year - min(Year) OVER ()) * 12 + Month AS MonthIndex FROM monthly)",
        f"target AS (SELECT CAST({year} AS INTEGER) AS Year, (SELECT min(Year) FROM monthly) AS first_year)",
        "future AS (SELECT t.Year, m.Month, (m.Month - 1) // 3 + 1 AS Quarter, 0 AS IsHolidaySL, "
        "(t.Year - first_year) * 12 + m.Month AS MonthIndex, p.* EXCLUDE (Month) "
        f"FROM {months} m, target t JOIN (SELECT Month, "
        + ", ".join(f"avg({d}) AS {d}" for d in LINEAR_FEATURES[5:])
        + " FROM monthly GROUP BY Month) p ON p.Month = m.Month)",
        f"r AS (SELECT true AS known, Year, Month, Quarter, CAST({label} AS DOUBLE) AS y, {history} FROM indexed "
        f"UNION ALL SELECT false, Year, Month, Quarter, NULL, {history} FROM future)",
        "s0 AS (SELECT known, Year, Month, Quarter, 0.0::DOUBLE AS fitted, "
        f"avg(y) {over} AS level, y - avg(y) {over} AS y, "
        + ", ".join(
            f"({x} - avg({x}) {over}) / CASE WHEN stddev_pop({x}) {over} = 0 THEN 1 "
            f"ELSE stddev_pop({x}) {over} END AS {x}"
            for x in xs
        )
        + " FROM r)",
    ]
    for k, q in enumerate(xs):
        norm = f"sum({q} * {q}) {over}"
        used = f"{norm} > 1e-9 * count(*) {over}"

        def share(other: str, q: str = q, norm: str = norm, used: str = used) -> str:
            return f"CASE WHEN {used} THEN {q} * (sum({q} * {other}) {over}) / ({norm}) ELSE 0 END"

        rest = "".join(f", {x} - {share(x)} AS {x}" for x in xs[k + 1 :])
        ctes.append(
            f"s{k + 1} AS (SELECT known, Year, Month, Quarter, level, fitted + {share('y')} AS fitted, "
            f"y - {share('y')} AS y{rest} FROM s{k})"
        )
    return _with(
        ",\n".join(ctes),
        "SELECT Year, Month, CAST(Quarter AS INTEGER) AS Quarter, "
        f"round(level + fitted, 2) AS {output} FROM s{len(xs)} WHERE NOT known",
    )


#: Depth of the trees that are grown in SQL.
TREE_DEPTH = 5


def _tree(ctes: list[str], features: list[str], classes: bool, depth: int) -> list[str]:
    """Grow a tree on ``train`` (id, y and the features) and send ``ahead`` (id and the
    features) down it: ends with ``told`` (id, prediction).

    Every value of every feature is tried as the largest on the left. The split of largest
    gain wins, of equal ones the first feature's lowest; it lies midway to the feature's next
    value in all rows. Siblings that end in the same class become one leaf.
    """

    def impurity(n: str, s: str, q: str) -> str:
        if classes:
            return f"(1 - ({s} / {n}) ** 2 - (({n} - {s}) / {n}) ** 2)"
        return f"(({q} - {s} * {s} / {n}) / {n})"

    def long(rows: str) -> str:
        return " UNION ALL ".join(
            f"SELECT id, {i} AS f, CAST({x} AS DOUBLE) AS v FROM {rows}" for i, x in enumerate(features)
        )

    out = [
        *ctes,
        f"long AS MATERIALIZED ({long('train')})",
        f"far AS MATERIALIZED ({long('ahead')})",
        "cut AS MATERIALIZED (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS t "
        "FROM (SELECT DISTINCT f, v FROM long))",
        "at0 AS (SELECT id, CAST(y AS DOUBLE) AS y, 1 AS node FROM train)",
    ]
    for d in range(depth):
        left, right = impurity("nl", "sl", "ql"), impurity("(n - nl)", "(s - sl)", "(q - ql)")
        out += [
            f"held{d} AS (SELECT node, f, v, count(*) AS c, sum(y) AS s, sum(y * y) AS q "
            f"FROM at{d} JOIN long USING (id) GROUP BY node, f, v)",
            f"tried{d} AS (SELECT node, f, v, sum(c) OVER o AS nl, sum(s) OVER o AS sl, sum(q) OVER o AS ql, "
            f"sum(c) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM held{d} "
            "WINDOW w AS (PARTITION BY node, f), o AS (PARTITION BY node, f ORDER BY v))",
            f"gained{d} AS (SELECT node, f, v, round(1 - (nl / n * {left} + (n - nl) / n * {right}) "
            f"/ {impurity('n', 's', 'q')}, 11) AS gain FROM tried{d} WHERE nl < n AND {impurity('n', 's', 'q')} > 0)",
            f"best{d} AS MATERIALIZED (SELECT node, f, t FROM (SELECT *, row_number() OVER (PARTITION BY node "
            f"ORDER BY gain DESC, f, v) AS nth FROM gained{d} WHERE gain > 0) JOIN cut USING (f, v) WHERE nth = 1)",
            f"at{d + 1} AS MATERIALIZED (SELECT a.id, y, CASE WHEN b.node IS NULL THEN a.node "
            f"ELSE 2 * a.node + CAST(v > t AS INTEGER) END AS node FROM at{d} a "
            f"LEFT JOIN best{d} b ON a.node = b.node LEFT JOIN long l ON l.id = a.id AND l.f = b.f)",
        ]
    levels = " UNION ".join(
        f"SELECT node, count(*) AS n, sum(y) AS s FROM at{d} GROUP BY node" for d in range(depth + 1)
    )
    out.append(f"stat AS MATERIALIZED ({levels})")
    out.append(f"kept{depth} AS (SELECT 0 AS node WHERE false)")
    for d in reversed(range(depth)):
        same = "(l.s > l.n - l.s) = (r.s > r.n - r.s)" if classes else "false"
        out.append(
            f"kept{d} AS MATERIALIZED (SELECT b.* FROM best{d} b JOIN stat l ON l.node = 2 * b.node "
            f"JOIN stat r ON r.node = 2 * b.node + 1 WHERE NOT ({same}) "
            f"OR l.node IN (SELECT node FROM kept{d + 1}) OR r.node IN (SELECT node FROM kept{d + 1}))"
        )
    out.append("go0 AS (SELECT id, 1 AS node FROM ahead)")
    for d in range(depth):
        out.append(
            f"go{d + 1} AS (SELECT a.id, CASE WHEN b.node IS NULL THEN a.node "
            f"ELSE 2 * a.node + CAST(v > t AS INTEGER) END AS node FROM go{d} a "
            f"LEFT JOIN kept{d} b ON a.node = b.node LEFT JOIN far l ON l.id = a.id AND l.f = b.f)"
        )
    out.append(f"told AS (SELECT id, s / n AS prediction FROM go{depth} JOIN stat USING (node))")
    return out


FOREST_FEATURES = [f for f in LINEAR_FEATURES if f != "MonthIndex"]
DRIVERS = LINEAR_FEATURES[5:]


def _sales_tree() -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in ("IsHolidaySL", *DRIVERS))
    ctes = [
        MARTS,
        f"train AS MATERIALIZED (SELECT row_number() OVER () AS id, TotalSales AS y, {', '.join(FOREST_FEATURES)} "
        "FROM monthly WHERE CAST('0x' || substr(md5('42|' || Year || '|' || Month || '|' || Quarter "
        "|| '|' || IsHolidaySL), 1, 8) AS BIGINT) % 100 < 80)",
        f"ahead AS (SELECT Month AS id, {CALENDAR}, g.* FROM {MONTHS} CROSS JOIN (SELECT {means} FROM monthly) g)",
    ]
    return _with(
        ",\n".join(_tree(ctes, FOREST_FEATURES, classes=False, depth=TREE_DEPTH)),
        "SELECT Year, Month, Quarter, round(prediction, 2) AS PredictedSales FROM ahead JOIN told USING (id)",
    )


def _regional_tree(condition: str = "true") -> str:
    features = [f"x{i}" for i in range(len(REGIONS) - 1)] + ["MonthIndex", *DRIVERS]
    marks = ", ".join(
        f"CAST(TerritoryName = '{name}' AS INTEGER) AS x{i}" for i, name in enumerate(REGIONS[1:])
    )
    means = ", ".join(f"avg({c}) AS {c}" for c in DRIVERS)
    index = "({year} - (SELECT min(Year) FROM regional)) * 12 + {month} AS MonthIndex"
    ctes = [
        MARTS,
        f"train AS MATERIALIZED (SELECT row_number() OVER () AS id, TotalSales AS y, {marks}, "
        f"{index.format(year='Year', month='Month')}, {', '.join(DRIVERS)} FROM regional)",
        f"ahead AS MATERIALIZED (SELECT row_number() OVER () AS id, TerritoryName, m.Month, {marks}, "
        f"{index.format(year=YEAR, month='m.Month')}, p.* EXCLUDE (Month) "
        f"FROM (SELECT DISTINCT TerritoryName FROM regional) CROSS JOIN {MONTHS} m "
        f"JOIN (SELECT Month, {means} FROM regional GROUP BY Month) p ON p.Month = m.Month)",
    ]
    return _with(
        ",\n".join(_tree(ctes, features, classes=False, depth=TREE_DEPTH)),
        f"SELECT TerritoryName, CAST({YEAR} AS INTEGER) AS Year, Month, round(prediction, 2) AS PredictedSales "
        f"FROM ahead JOIN told USING (id) WHERE {condition}",
    )


def _customer_tree(condition: str = "true", top: int | None = None) -> str:
    marks = [
        f"CAST({c} AS VARCHAR) = '{v}'"
        for c, values in (("Gender", SEGMENTS), ("CountryRegionName", NATIONS), ("EmailPromotion", PROMOTIONS))
        for v in values[1:]
    ]
    numbers = ["Year", "Month", "TotalSpent", "TotalQuantity", "PurchaseCount"]
    features = [*numbers, *[f"x{i}" for i in range(len(marks))]]
    ctes = [
        MARTS,
        "train AS MATERIALIZED (SELECT row_number() OVER () AS id, CustomerKey, CASE WHEN "
        "lead(PurchaseCount) OVER (PARTITION BY CustomerKey ORDER BY Year, Month) > 0 THEN 1 ELSE 0 END AS y, "
        f"{', '.join(numbers)}, "
        + ", ".join(f"CAST({m} AS INTEGER) AS x{i}" for i, m in enumerate(marks))
        + " FROM customer_month)",
        "ahead AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CustomerKey "
        f"ORDER BY Year DESC, Month DESC) AS recency FROM train WHERE {condition}) WHERE recency = 1)",
    ]
    place = "" if top is None else (
        ", row_number() OVER (ORDER BY prediction DESC, CustomerKey) AS Place"
    )
    return _with(
        ",\n".join(_tree(ctes, features, classes=True, depth=TREE_DEPTH)),
        "SELECT CustomerKey, Year, Month, round(prediction, 9) AS PurchaseProbability, "
        f"CAST(prediction > 0.5 AS INTEGER) AS Prediction{place} FROM ahead JOIN told USING (id)"
        + ("" if top is None else f" QUALIFY Place <= {top}"),
    )


def _future_linear() -> str:
    profile = f"SELECT Month, {MEAN_DRIVERS} FROM monthly GROUP BY Month"
    return _with(
        MARTS,
        f"SELECT {CALENDAR.replace('Month', 'p.Month', 1)}, CAST(0 AS INTEGER) AS IsHolidaySL, "
        f"CAST(({YEAR} - (SELECT min(Year) FROM monthly)) * 12 + Month AS INTEGER) AS MonthIndex, "
        f"p.* EXCLUDE (Month) FROM ({profile}) p WHERE Month BETWEEN 1 AND 12",
    )


#: Columns of each mart as the check compares them.
PUSHED = {
    "monthly_sales": "Year, Month, Quarter, IsHolidaySL, round(CAST(TotalSales AS DOUBLE), 4) AS TotalSales, "
    + ROUNDED_DRIVERS,
    "monthly_demand": "Year, Month, Quarter, IsHolidaySL, CAST(TotalQty AS BIGINT) AS TotalQty, "
    + ROUNDED_DRIVERS,
    "regional_monthly": "TerritoryName, Year, Month, CAST(TotalSales AS BIGINT) AS TotalSales, "
    + ROUNDED_DRIVERS,
    "customer_monthly": "CustomerKey, Year, Month, round(CAST(TotalSpent AS DOUBLE), 6) AS TotalSpent, "
    "CAST(TotalQuantity AS BIGINT) AS TotalQuantity, PurchaseCount, Gender, EmailPromotion, CountryRegionName",
}


def _pushed(mart: str) -> str:
    """The aggregate as it is generated for this database, over the star's tables."""
    names = {FACT: "fact", DATES: "dates", TERRITORIES: "territories", CUSTOMERS: "customers"}
    sql = mart_sql(mart, "duckdb", names)
    if "AvgShippingTime" in PUSHED[mart]:
        columns = PUSHED[mart].replace("AvgShippingTime", "CAST(AvgShippingTime AS BIGINT) AS AvgShippingTime")
    else:
        columns = PUSHED[mart]
    return _with(STAR, f"SELECT {columns} FROM ({sql})")


ORACLES: dict[str, str] = {
    "fact_sales_detail": _with(
        STAR,
        "SELECT * EXCLUDE (LineTotal, TotalDue), CAST(LineTotal AS DOUBLE) AS LineTotal, "
        "CAST(TotalDue AS DOUBLE) AS TotalDue FROM fact",
    ),
    "dim_date": _with(STAR, "SELECT * FROM dates"),
    "dim_customer": _with(STAR, "SELECT * FROM customers"),
    "dim_territory": _with(STAR, "SELECT * FROM territories"),
    "datekey_to_date": _with(
        STAR,
        f"SELECT SalesOrderID, OrderDateKey, ShipDateKey, {_day('OrderDateKey')} AS OrderDate, "
        f"{_day('ShipDateKey')} AS ShipDate FROM fact",
    ),
    "shipping_days": _with(
        STAR,
        "SELECT SalesOrderID, OrderDateKey, ShipDateKey, "
        f"CAST({DAYS} AS INTEGER) AS ShippingDays FROM fact",
    ),
    "quarter_of_month": _with(
        STAR,
        "SELECT DateKey, Month, CAST((Month - 1) // 3 + 1 AS INTEGER) AS Quarter FROM dates",
    ),
    "null_default_columns": _with(
        STAR,
        "SELECT DateKey, coalesce(Quarter, 0) AS Quarter, "
        "coalesce(IsHolidaySL, 0) AS IsHolidaySL FROM dates",
    ),
    "two_decimals": _with(
        MARTS,
        "SELECT TerritoryName, Year, Month, printf('%.2f', AvgUnitPrice) AS AvgUnitPrice "
        "FROM regional",
    ),
    "monthly_sales": _with(
        MARTS,
        "SELECT Year, Month, Quarter, IsHolidaySL, round(TotalSales, 4) AS TotalSales, "
        f"{ROUNDED_DRIVERS} FROM monthly",
    ),
    "monthly_demand": _with(
        MARTS, f"SELECT Year, Month, Quarter, IsHolidaySL, TotalQty, {ROUNDED_DRIVERS} FROM monthly"
    ),
    "regional_monthly": _with(
        MARTS, f"SELECT TerritoryName, Year, Month, TotalSales, {ROUNDED_DRIVERS} FROM regional"
    ),
    "customer_monthly": _with(MARTS, f"SELECT {CUSTOMER_ROW} FROM customer_month"),
    "join_fact_date": _with(
        STAR,
        "SELECT SalesOrderID, OrderDateKey, Year, Month, Quarter, IsHolidaySL, OrderQty FROM dated",
    ),
    "join_fact_territory": _with(
        STAR,
        "SELECT SalesOrderID, TerritoryName, Year, Month, OrderQty "
        "FROM dated JOIN territories USING (TerritoryKey)",
    ),
    "join_fact_customer": _with(
        STAR,
        "SELECT SalesOrderID, f.CustomerKey, Gender, EmailPromotion, CountryRegionName, OrderQty "
        "FROM fact f JOIN customers c ON f.CustomerKey = c.CustomerKey",
    ),
    "distinct_orders_customers": _with(
        STAR,
        "SELECT Year, Month, count(DISTINCT SalesOrderID) AS TotalOrders, "
        "count(DISTINCT CustomerKey) AS UniqueCustomers FROM dated GROUP BY Year, Month",
    ),
    "integer_avg_shipping": _with(
        STAR, f"SELECT Year, Month, {SHIPPING} FROM dated GROUP BY Year, Month"
    ),
    "raw_group_null_default": _with(
        STAR,
        "SELECT Year, Month, coalesce(q, 0) AS Quarter, coalesce(h, 0) AS IsHolidaySL, Lines "
        "FROM (SELECT Year, Month, Quarter AS q, IsHolidaySL AS h, count(SalesOrderID) AS Lines "
        "FROM dated GROUP BY ALL)",
    ),
    "month_index": _with(
        MARTS,
        "SELECT Year, Month, Quarter, IsHolidaySL, "
        "CAST((Year - (SELECT min(Year) FROM monthly)) * 12 + Month AS INTEGER) AS MonthIndex "
        "FROM monthly",
    ),
    "year_bounds": _with(STAR, "SELECT min(Year) AS MinYear, max(Year) AS MaxYear FROM dated"),
    "month_profile_sales": _with(
        MARTS, f"SELECT Month, {MEAN_DRIVERS} FROM monthly GROUP BY Month"
    ),
    "month_profile_demand": _with(
        MARTS, f"SELECT Month, {MEAN_DRIVERS} FROM monthly GROUP BY Month"
    ),
    "month_profile_regional": _with(
        MARTS, f"SELECT Month, {MEAN_DRIVERS} FROM regional GROUP BY Month"
    ),
    "global_feature_means": _with(
        MARTS, f"SELECT round(avg(IsHolidaySL), 6) AS IsHolidaySL, {MEAN_DRIVERS} FROM monthly"
    ),
    "territory_names": _with(
        STAR, "SELECT DISTINCT TerritoryName FROM dated JOIN territories USING (TerritoryKey)"
    ),
    "future_months_sales": _future_linear(),
    "future_months_demand": _future_linear(),
    "future_months_forest": _with(
        MARTS,
        f"SELECT {CALENDAR}, g.* FROM {MONTHS} CROSS JOIN (SELECT round(avg(IsHolidaySL), 6) "
        f"AS IsHolidaySL, {MEAN_DRIVERS} FROM monthly) g",
    ),
    "territory_month_spine": _with(
        MARTS,
        f"SELECT TerritoryName, CAST({YEAR} AS INTEGER) AS Year, m.Month, p.* EXCLUDE (Month) "
        f"FROM (SELECT DISTINCT TerritoryName FROM regional) CROSS JOIN {MONTHS} m "
        f"JOIN (SELECT Month, {MEAN_DRIVERS} FROM regional GROUP BY Month) p ON p.Month = m.Month",
    ),
    "json_records": _with(
        MARTS,
        "SELECT '{\"TerritoryName\":\"' || TerritoryName || '\",\"Year\":' || Year || ',\"Month\":' "
        "|| Month || ',\"Quarter\":' || Quarter || '}' AS \"value\" "
        f"FROM (SELECT DISTINCT TerritoryName FROM regional) CROSS JOIN "
        f"(SELECT {CALENDAR} FROM {MONTHS})",
    ),
    "json_records_mart": _with(
        MARTS,
        "SELECT '{\"TerritoryName\":\"' || TerritoryName || '\",\"Year\":' || Year || ',\"Month\":' || Month "
        "|| ',\"TotalSales\":' || TotalSales || ',\"AvgUnitPrice\":' || round(AvgUnitPrice, 6) "
        "|| ',\"AvgDiscount\":' || round(AvgDiscount, 12) || '}' AS \"value\" FROM regional",
    ),
    "monthly_sales_in_order": _with(
        MARTS,
        "SELECT Year, Month, Quarter, IsHolidaySL, round(TotalSales, 4) AS TotalSales, row_number() OVER "
        "(ORDER BY Year, Month, Quarter, IsHolidaySL, TotalSales) AS Place FROM monthly",
    ),
    **{f"pushed_{mart}": _pushed(mart) for mart in PUSHED},
    "next_purchase_label": _with(
        MARTS,
        "SELECT CustomerKey, Year, Month, PurchaseCount, "
        "CAST(CASE WHEN lead(PurchaseCount) OVER (PARTITION BY CustomerKey ORDER BY Year, Month) "
        "> 0 THEN 1 ELSE 0 END AS INTEGER) AS NextPurchase FROM customer_month",
    ),
    "latest_customer_month": _latest("true"),
    "latest_customer_month_in_year": _latest(f"Year = {LAST_FULL_YEAR}"),
    "latest_customer_month_in_month": _latest("Month = 3"),
    "category_vocabulary": _with(
        MARTS,
        " UNION ALL ".join(
            [
                _vocabulary("Gender", "Gender"),
                _vocabulary("EmailPromotion", "EmailPromotion"),
                _vocabulary("CountryRegionName", "CountryRegionName"),
            ]
        ),
    ),
    "indicators_customer": _with(
        MARTS,
        f"SELECT CustomerKey, Year, Month, {_indicators('Gender', SEGMENTS)}, "
        f"{_indicators('CountryRegionName', NATIONS)}, "
        f"{_indicators('EmailPromotion', PROMOTIONS)} FROM customer_month",
    ),
    "indicators_territory": _with(
        MARTS,
        f"SELECT TerritoryName, Year, Month, {_indicators('TerritoryName', REGIONS)}, "
        "CAST((Year - (SELECT min(Year) FROM regional)) * 12 + Month AS INTEGER) AS MonthIndex "
        "FROM regional",
    ),
    "scale_monthly": _with(
        MARTS,
        f"SELECT {', '.join(_scaled(c) for c in LINEAR_FEATURES)}, "
        "round(TotalSales, 4) AS TotalSales FROM (SELECT *, "
        "(Year - min(Year) OVER ()) * 12 + Month AS MonthIndex FROM monthly)",
    ),
    "scale_customer": _with(
        MARTS,
        "SELECT CustomerKey, "
        + ", ".join(_scaled(c) for c in ("TotalSpent", "TotalQuantity", "Year", "Month"))
        + ", PurchaseCount FROM customer_month",
    ),
    "align_columns": _with(
        MARTS,
        "SELECT CustomerKey, Year, Month, PurchaseCount, TotalQuantity, "
        'CAST(0 AS DOUBLE) AS "Gender_UNHEARD_OF" FROM customer_month',
    ),
    "holdout_split": _with(
        MARTS,
        "SELECT *, CAST(Bucket < 80 AS INTEGER) AS InTraining FROM (SELECT Year, Month, Quarter, "
        "IsHolidaySL, CAST('0x' || substr(md5('42|' || Year || '|' || Month || '|' || Quarter "
        "|| '|' || IsHolidaySL), 1, 8) AS BIGINT) % 100 AS Bucket FROM monthly)",
    ),
    "forecast_sales": _least_squares("TotalSales", "PredictedSales", str(YEAR)),
    "forecast_sales_one_month": _least_squares(
        "TotalSales", "PredictedSales", str(YEAR), "(SELECT CAST(7 AS INTEGER) AS Month)"
    ),
    "forecast_demand": _least_squares("TotalQty", "PredictedDemand", str(YEAR)),
    "forecast_demand_default_year": _least_squares(
        "TotalQty", "PredictedDemand", "(SELECT max(Year) FROM monthly)"
    ),
    "forecast_sales_forest_exact": _sales_tree(),
    "forecast_regional_exact": _regional_tree(),
    "forecast_regional_one_territory_exact": _regional_tree("TerritoryName = 'EUROPE'"),
    "score_customers_exact": _customer_tree(),
    "score_customers_in_year_exact": _customer_tree(f"Year = {LAST_FULL_YEAR}"),
    "top_customers_exact": _customer_tree(top=10),
}
