"""SQL text of the logical inputs, mirroring ``replenish.sources.tables``."""

from replenish.plans.registry import common

common(
    "med",
    """SELECT p_partkey AS medicine_id, p_name AS medicine_name, p_type AS category, p_retailprice AS unit_price,
       CASE p_partkey % 4 WHEN 0 THEN 180 WHEN 1 THEN 365 WHEN 2 THEN 730 ELSE 1095 END AS shelf_life_days,
       p_brand AS storage_type FROM part""",
)
common(
    "disp",
    """SELECT 'RX-' || l_orderkey || '-' || l_linenumber AS prescription_id, l_partkey AS medicine_id,
       l_quantity AS quantity, l_shipdate AS ts, l_orderkey AS basket_id, l_linenumber AS line,
       l_returnflag AS location, CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS insurance FROM lineitem""",
)
common(
    "rx",
    """SELECT disp.*, o_orderpriority = '1-URGENT' AS is_emergency, 1 + o_custkey % 90 AS patient_age
       FROM disp JOIN orders ON o_orderkey = basket_id""",
    "disp",
)
common(
    "ev",
    """SELECT event_id AS prescription_id, event_type AS medicine_id, user_id, value AS quantity, ts,
       event_type AS category, event_type = 'error' AS is_emergency, 'Store' || (1 + user_id % 3) AS location,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS patient_age, CAST(hour(ts) AS BIGINT) AS hour_of_day,
       CASE WHEN event_type = 'purchase' THEN 'Yes' ELSE 'No' END AS insurance FROM events""",
)
common(
    "stock",
    """SELECT s.*, m.* EXCLUDE (medicine_id),
       floor(total_dispensed * (30 + s.medicine_id % 51) / 100.0) AS current_inventory, avg_quantity * 30 AS reorder_point
       FROM (SELECT medicine_id, sum(quantity) AS total_dispensed, avg(quantity) AS avg_quantity,
                    count(*) AS prescription_count, max(ts) AS last_dispensed FROM disp GROUP BY 1) s
       JOIN med m ON m.medicine_id = s.medicine_id""",
    "disp",
    "med",
)
common(
    "ord",
    """SELECT medicine_id, quantity, basket_id, line,
       CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'APPROVED' ELSE 'DELIVERED' END AS status,
       (6 - CAST(substr(o_orderpriority, 1, 1) AS INT)) / 5.0 AS priority,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '5-LOW' THEN 'LOW'
            ELSE 'NORMAL' END AS urgency,
       o_orderdate AS created_at, p_retailprice AS unit_cost, 'PO-' || basket_id || '-' || line AS order_id,
       quantity * p_retailprice AS total_cost
       FROM disp JOIN orders ON o_orderkey = basket_id JOIN part ON p_partkey = medicine_id""",
    "disp",
)
common(
    "alert",
    """SELECT *, 'LOW_STOCK' AS alert_type,
       CASE WHEN current_inventory < reorder_point * 0.5 THEN 'high' ELSE 'medium' END AS severity,
       medicine_name || ': ' || greatest(0, CAST(current_inventory AS BIGINT)) || ' units remaining' AS message,
       last_dispensed AS created_at, shelf_life_days = 180 AS is_resolved
       FROM stock WHERE current_inventory < reorder_point""",
    "stock",
)
common("daily", "SELECT medicine_id, CAST(ts AS DATE) AS date, sum(quantity) AS demand FROM disp GROUP BY 1, 2", "disp")
common(
    "evdaily",
    "SELECT user_id AS medicine_id, CAST(ts AS DATE) AS date, sum(quantity) AS demand FROM ev GROUP BY 1, 2",
    "ev",
)
common(
    "evdense",
    """SELECT g.medicine_id, CAST(g.date AS DATE) AS date, coalesce(d.demand, 0) AS demand
       FROM (SELECT medicine_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS date
             FROM evdaily GROUP BY 1) g
       LEFT JOIN evdaily d ON d.medicine_id = g.medicine_id AND d.date = CAST(g.date AS DATE)""",
    "evdaily",
)
common(
    "dense",
    """SELECT g.medicine_id, CAST(g.date AS DATE) AS date, coalesce(d.demand, 0) AS demand
       FROM (SELECT medicine_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS date
             FROM daily GROUP BY 1) g
       LEFT JOIN daily d ON d.medicine_id = g.medicine_id AND d.date = CAST(g.date AS DATE)""",
    "daily",
)
common(
    "base",
    """SELECT medicine_id, i AS h, mean_selling, std_selling,
       greatest(0, v) AS forecast, greatest(0, v - 1.96 * std_selling) AS lower_q, v + 1.96 * std_selling AS upper_q
       FROM (SELECT *, mean_selling + 0.2 * mean_selling * sin(2 * pi() * i / 7) AS v
             FROM (SELECT medicine_id, avg(demand) AS mean_selling, coalesce(stddev_samp(demand), 0) AS std_selling
                   FROM daily GROUP BY 1), (SELECT unnest(range(30)) AS i))""",
    "daily",
)
