"""DuckDB SQL with the same answers as the registered queries.

Written from the definitions and not from the Spark plans: the segment SQL is one
SELECT per definition, windows are plain windows.
"""

from __future__ import annotations

from rillmark.operators import definitions as d
from rillmark.operators.definitions import Segment, standard_segments

VIEWS = """
WITH base AS (
  SELECT *, event_id AS n, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, epoch_us(ts)//1000 AS ms FROM events),
fx_readings AS (
  SELECT 'dev-'||lpad(CAST(user_id AS VARCHAR),5,'0') AS device_id, event_id AS sequence, ms AS timestamp_ms, value, n
  FROM base),
fx_storefront AS (
  SELECT 'evt-'||lpad(CAST(event_id AS VARCHAR),8,'0') AS event_id,
    'profile-'||lpad(CAST(user_id*7+least(event_id%13,6) AS VARCHAR),8,'0') AS profile_id,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                    WHEN 'purchase' THEN 'purchase' ELSE 'cart_abandon' END AS event_type,
    1706745600000 - 4*(1706745600000-ms) AS timestamp_ms,
    CASE WHEN k=99 THEN NULL WHEN k<30 THEN 'electronics' WHEN k%8=0 THEN 'electronics' WHEN k%8=1 THEN 'apparel'
         WHEN k%8=2 THEN 'home' WHEN k%8=3 THEN 'beauty' WHEN k%8=4 THEN 'sports' WHEN k%8=5 THEN 'books'
         WHEN k%8=6 THEN 'toys' ELSE 'grocery' END AS category,
    CASE WHEN event_type IN ('click','purchase')
         THEN CAST(CAST(value AS DECIMAL(18,2))*3 AS DECIMAL(18,2)) END AS price, n
  FROM base),
fx_webhooks AS (
  SELECT 'wh-'||lpad(CAST(event_id AS VARCHAR),9,'0') AS webhook_id,
    'msg-'||lpad(CAST(event_id//2 AS VARCHAR),9,'0') AS message_id,
    CASE (event_id//2)%3 WHEN 0 THEN 'mail' WHEN 1 THEN 'text' ELSE 'push' END AS channel,
    CASE WHEN event_id%2=0 THEN 'sent' WHEN k<90 THEN 'delivered' WHEN k<97 THEN 'bounced' ELSE 'failed' END AS status,
    1704067200000 + (ms-1704067200000)//60 AS timestamp_ms,
    CASE (event_id//2)%3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS provider, n
  FROM base),
fx_copies AS (
  SELECT event_id AS n, 0 AS copy FROM events UNION ALL SELECT event_id, 1 FROM events WHERE event_id%20=0),
fx_arrival AS (SELECT n, copy, (n*7919+copy*104729)%1000003 AS arrival FROM fx_copies),
now AS (SELECT max(timestamp_ms) AS t FROM fx_storefront),
hook_now AS (SELECT max(timestamp_ms) AS t FROM fx_webhooks),
hooks AS (SELECT *, date_trunc('minute', make_timestamp(timestamp_ms*1000)) AS minute FROM fx_webhooks),
rollup AS (SELECT minute, channel, status, count(*) AS event_count FROM hooks GROUP BY ALL)
"""

DAY = "CAST(86400000 AS BIGINT)"


def _segment_sql(s: Segment, now: str = "(SELECT t FROM now)", own: bool = False) -> str:
    """The profiles of one segment as of ``now``, or each as of its own newest event."""
    upto = f"FROM fx_storefront WHERE timestamp_ms <= {now}"
    if own:
        now, upto = "max(own_t)", "FROM own_storefront WHERE timestamp_ms <= own_t"
    at = "own_t" if own else now
    bought = f"{upto} AND event_type='purchase' AND timestamp_ms >= {at} - {s.window_days}*{DAY}"
    cart = "coalesce(max(CASE WHEN event_type='add_to_cart' THEN timestamp_ms END),0)"
    purchase = "coalesce(max(CASE WHEN event_type='purchase' THEN timestamp_ms END),0)"
    idle = f"{s.min_days}*86400"
    body = {
        d.PURCHASE_COUNT: f"{bought} GROUP BY profile_id HAVING count(*) >= {s.min_count}",
        d.PURCHASE_VALUE: f"{bought} GROUP BY profile_id HAVING sum(coalesce(price,0)) >= {s.min_value}",
        d.CART_ABANDON: f"{upto} GROUP BY profile_id HAVING {cart} > {purchase} "
                        f"AND {now}//1000 - {cart}//1000 >= {idle}",
        d.CATEGORY_VIEWS: f"{upto} AND event_type='page_view' AND category='{s.category}' "
                          f"GROUP BY profile_id HAVING count(*) >= {s.min_count}",
        d.RECENTLY_ACTIVE: f"{upto} AND timestamp_ms >= {at} - {s.min_hours}*CAST(3600000 AS BIGINT) "
                           "GROUP BY profile_id",
        d.NEVER_PURCHASED: f"{upto} GROUP BY profile_id HAVING count(*) FILTER (event_type='purchase') = 0",
        d.CHURN_RISK: f"{upto} GROUP BY profile_id HAVING count(*) FILTER (event_type='purchase') >= 1 "
                      f"AND {now}//1000 - max(timestamp_ms)//1000 >= {idle}",
        d.MULTI_CATEGORY: f"{upto} AND event_type='page_view' GROUP BY profile_id "
                          f"HAVING count(DISTINCT coalesce(category,'')) >= {s.min_distinct}",
    }[s.family]
    return f"SELECT '{s.id}' AS segment_id, profile_id {body}"


def _members(name: str, days_back: int = 0) -> str:
    now = f"((SELECT t FROM now) - {days_back}*{DAY})"
    return f", {name} AS (" + "\nUNION ALL ".join(_segment_sql(s, now) for s in standard_segments()) + ")"


# The 50 standard segments, written out.
DEFINITIONS = """, defs AS (SELECT * FROM (VALUES
  ('purchase_count_min_1_7d', 'purchase_count_min', 1, 7, '', 0.0, 0, 0, 0),
  ('purchase_count_min_1_30d', 'purchase_count_min', 1, 30, '', 0.0, 0, 0, 0),
  ('purchase_count_min_1_90d', 'purchase_count_min', 1, 90, '', 0.0, 0, 0, 0),
  ('purchase_count_min_2_7d', 'purchase_count_min', 2, 7, '', 0.0, 0, 0, 0),
  ('purchase_count_min_2_30d', 'purchase_count_min', 2, 30, '', 0.0, 0, 0, 0),
  ('purchase_count_min_2_90d', 'purchase_count_min', 2, 90, '', 0.0, 0, 0, 0),
  ('purchase_count_min_3_7d', 'purchase_count_min', 3, 7, '', 0.0, 0, 0, 0),
  ('purchase_count_min_3_30d', 'purchase_count_min', 3, 30, '', 0.0, 0, 0, 0),
  ('purchase_count_min_3_90d', 'purchase_count_min', 3, 90, '', 0.0, 0, 0, 0),
  ('purchase_count_min_5_7d', 'purchase_count_min', 5, 7, '', 0.0, 0, 0, 0),
  ('purchase_count_min_5_30d', 'purchase_count_min', 5, 30, '', 0.0, 0, 0, 0),
  ('purchase_count_min_5_90d', 'purchase_count_min', 5, 90, '', 0.0, 0, 0, 0),
  ('cart_abandon_1d', 'cart_abandon_days', 0, 0, '', 0.0, 0, 1, 0),
  ('cart_abandon_3d', 'cart_abandon_days', 0, 0, '', 0.0, 0, 3, 0),
  ('cart_abandon_7d', 'cart_abandon_days', 0, 0, '', 0.0, 0, 7, 0),
  ('cart_abandon_14d', 'cart_abandon_days', 0, 0, '', 0.0, 0, 14, 0),
  ('cart_abandon_30d', 'cart_abandon_days', 0, 0, '', 0.0, 0, 30, 0),
  ('category_view_min_electronics_3', 'category_view_min', 3, 0, 'electronics', 0.0, 0, 0, 0),
  ('category_view_min_electronics_5', 'category_view_min', 5, 0, 'electronics', 0.0, 0, 0, 0),
  ('category_view_min_apparel_3', 'category_view_min', 3, 0, 'apparel', 0.0, 0, 0, 0),
  ('category_view_min_apparel_5', 'category_view_min', 5, 0, 'apparel', 0.0, 0, 0, 0),
  ('category_view_min_home_3', 'category_view_min', 3, 0, 'home', 0.0, 0, 0, 0),
  ('category_view_min_home_5', 'category_view_min', 5, 0, 'home', 0.0, 0, 0, 0),
  ('category_view_min_beauty_3', 'category_view_min', 3, 0, 'beauty', 0.0, 0, 0, 0),
  ('category_view_min_beauty_5', 'category_view_min', 5, 0, 'beauty', 0.0, 0, 0, 0),
  ('category_view_min_sports_3', 'category_view_min', 3, 0, 'sports', 0.0, 0, 0, 0),
  ('category_view_min_sports_5', 'category_view_min', 5, 0, 'sports', 0.0, 0, 0, 0),
  ('category_view_min_books_3', 'category_view_min', 3, 0, 'books', 0.0, 0, 0, 0),
  ('category_view_min_books_5', 'category_view_min', 5, 0, 'books', 0.0, 0, 0, 0),
  ('category_view_min_toys_3', 'category_view_min', 3, 0, 'toys', 0.0, 0, 0, 0),
  ('category_view_min_toys_5', 'category_view_min', 5, 0, 'toys', 0.0, 0, 0, 0),
  ('category_view_min_grocery_3', 'category_view_min', 3, 0, 'grocery', 0.0, 0, 0, 0),
  ('category_view_min_grocery_5', 'category_view_min', 5, 0, 'grocery', 0.0, 0, 0, 0),
  ('purchase_value_min_100_30d', 'purchase_value_min', 0, 30, '', 100.0, 0, 0, 0),
  ('purchase_value_min_100_90d', 'purchase_value_min', 0, 90, '', 100.0, 0, 0, 0),
  ('purchase_value_min_250_30d', 'purchase_value_min', 0, 30, '', 250.0, 0, 0, 0),
  ('purchase_value_min_250_90d', 'purchase_value_min', 0, 90, '', 250.0, 0, 0, 0),
  ('purchase_value_min_500_30d', 'purchase_value_min', 0, 30, '', 500.0, 0, 0, 0),
  ('purchase_value_min_500_90d', 'purchase_value_min', 0, 90, '', 500.0, 0, 0, 0),
  ('recently_active_1h', 'recently_active_hours', 0, 0, '', 0.0, 1, 0, 0),
  ('recently_active_6h', 'recently_active_hours', 0, 0, '', 0.0, 6, 0, 0),
  ('recently_active_24h', 'recently_active_hours', 0, 0, '', 0.0, 24, 0, 0),
  ('recently_active_72h', 'recently_active_hours', 0, 0, '', 0.0, 72, 0, 0),
  ('never_purchased', 'never_purchased', 0, 0, '', 0.0, 0, 0, 0),
  ('churn_risk_14d', 'churn_risk_days', 0, 0, '', 0.0, 0, 14, 0),
  ('churn_risk_30d', 'churn_risk_days', 0, 0, '', 0.0, 0, 30, 0),
  ('churn_risk_60d', 'churn_risk_days', 0, 0, '', 0.0, 0, 60, 0),
  ('multi_category_shopper_min_2', 'multi_category_shopper_min', 0, 0, '', 0.0, 0, 0, 2),
  ('multi_category_shopper_min_3', 'multi_category_shopper_min', 0, 0, '', 0.0, 0, 0, 3),
  ('multi_category_shopper_min_4', 'multi_category_shopper_min', 0, 0, '', 0.0, 0, 0, 4)
) AS v(id, family, min_count, window_days, category, min_value, min_hours, min_days, min_distinct))"""

SIZES = (", sizes AS (SELECT defs.id AS segment_id, count(m.profile_id) AS n "
         "FROM defs LEFT JOIN members m ON m.segment_id = defs.id GROUP BY defs.id)")

MEMBERS = _members("members")


OWN_MEMBERS = (", own_storefront AS (SELECT *, max(timestamp_ms) OVER (PARTITION BY profile_id) AS own_t FROM fx_storefront), "
               "members AS (" + "\nUNION ALL ".join(_segment_sql(s, own=True) for s in standard_segments()) + ")")


def _one_family(segment_id: str) -> str:
    chosen = next(s for s in standard_segments() if s.id == segment_id)
    return f"{VIEWS} SELECT profile_id FROM ({_segment_sql(chosen)})"


def _diff(left: str, right: str) -> str:
    return f"""
SELECT defs.id AS segment_id, count(pair.l) AS left_n, count(pair.r) AS right_n,
  count(*) FILTER (pair.l IS NOT NULL AND pair.r IS NULL) AS only_left,
  count(*) FILTER (pair.r IS NOT NULL AND pair.l IS NULL) AS only_right,
  count(*) FILTER ((pair.l IS NULL) <> (pair.r IS NULL)) = 0 AS exact
FROM defs LEFT JOIN (
  SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, a.profile_id AS l, b.profile_id AS r
  FROM {left} a FULL JOIN {right} b ON a.segment_id = b.segment_id AND a.profile_id = b.profile_id
) pair ON pair.segment_id = defs.id GROUP BY defs.id"""


DELTA = """
SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, coalesce(a.profile_id, b.profile_id) AS profile_id,
  CASE WHEN a.profile_id IS NULL THEN 'added' ELSE 'removed' END AS change
FROM before a FULL JOIN members b ON a.segment_id = b.segment_id AND a.profile_id = b.profile_id
WHERE a.profile_id IS NULL OR b.profile_id IS NULL"""

# The digest tree: 16 bits of the sequence per level.
DIGEST = """
, pairs AS (SELECT device_id, sequence AS pos,
    sequence||':'||CAST(round(value*1000) AS BIGINT)||CASE WHEN count(*)>1 THEN ':'||count(*) ELSE '' END AS txt
  FROM fx_readings GROUP BY device_id, sequence, round(value*1000)),
level1 AS (SELECT device_id, pos>>16 AS pos, sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS txt
  FROM pairs GROUP BY device_id, pos>>16),
level2 AS (SELECT device_id, pos>>16 AS pos, sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS txt
  FROM level1 GROUP BY device_id, pos>>16),
level3 AS (SELECT device_id, pos>>16 AS pos, sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS txt
  FROM level2 GROUP BY device_id, pos>>16),
digests AS (SELECT device_id, sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS digest FROM level3 GROUP BY device_id)
"""

DELIVERED_READINGS = """
, arrived AS (SELECT device_id, sequence, row_number() OVER (ORDER BY arrival, copy, n) AS place
  FROM fx_readings JOIN fx_arrival USING (n)),
firsts AS (SELECT device_id, sequence, min(place) AS place FROM arrived GROUP BY ALL),
held AS (SELECT place, row_number() OVER (PARTITION BY device_id ORDER BY place) AS nth FROM firsts),
trace AS (SELECT sample, CAST(sum(grown) OVER (ORDER BY sample) AS BIGINT) AS entries FROM (
  SELECT (place-1)//500+1 AS sample, count(*) FILTER (nth <= 16) AS grown FROM held GROUP BY 1))
"""

# A memory of the last 3 admitted sequences per device, kept in a list from arrival to arrival.
FORGETFUL = """
, arrived AS (SELECT device_id, list({'held': [sequence], 'taken': [{'sequence': sequence, 'copy': copy}]}
    ORDER BY arrival, copy, n) AS rows FROM fx_readings JOIN fx_arrival USING (n) GROUP BY device_id),
walked AS (SELECT device_id, list_reduce(rows, lambda memory, row: CASE WHEN list_contains(memory.held, row.held[1]) THEN memory
    ELSE {'held': list_concat(memory.held, row.held)[-3:], 'taken': list_concat(memory.taken, row.taken)} END) AS memory FROM arrived),
kept AS (SELECT device_id, unnest(memory.taken) AS row FROM walked)
SELECT device_id, row.sequence AS sequence, row.copy AS copy FROM kept
"""

FORGETFUL_SHARDS = """
, arrived AS (SELECT ('0x' || substr(md5(event_id), 1, 8))::BIGINT % 16 AS shard,
    list({'held': [event_id], 'taken': [{'event_id': event_id, 'copy': copy}]} ORDER BY arrival, copy, n) AS rows
  FROM fx_storefront JOIN fx_arrival USING (n) GROUP BY shard),
walked AS (SELECT list_reduce(rows, lambda memory, row: CASE WHEN list_contains(memory.held, row.held[1]) THEN memory
    ELSE {'held': list_concat(memory.held, row.held)[-64:], 'taken': list_concat(memory.taken, row.taken)} END) AS memory FROM arrived),
kept AS (SELECT unnest(memory.taken) AS row FROM walked)
SELECT row.event_id AS event_id, row.copy AS copy FROM kept
"""

LAGS = """
, lags AS (SELECT s.event_id, CASE s.n%40 WHEN 1 THEN -10 WHEN 2 THEN 300000000
    ELSE s.n*37%250 END AS lag_ms
  FROM fx_storefront s WHERE s.n%50<>0)
"""



def _timeline() -> str:
    """Every definition at every moment of a profile, by windows over its moments."""
    segments = standard_segments()
    days = sorted({s.window_days for s in segments if s.window_days})
    categories = sorted({s.category for s in segments if s.category})
    ever = "OVER (PARTITION BY m.profile_id ORDER BY m.ms)"
    back = "OVER (PARTITION BY m.profile_id ORDER BY m.ms RANGE BETWEEN CAST({d} AS BIGINT)*86400000 PRECEDING AND CURRENT ROW)"
    views = ", ".join(f"count(*) FILTER (event_type='page_view' AND coalesce(category,'')='{c}') AS v_{c}" for c in categories)
    sums = ", ".join([*(f"sum(v_{c}) {ever} AS seen_{c}" for c in categories),
                      *(f"sum(bought) {back.format(d=d)} AS bought_{d}" for d in days),
                      *(f"sum(spent) {back.format(d=d)} AS spent_{d}" for d in days)])

    def holds(s: Segment) -> str:
        return {
            d.PURCHASE_COUNT: f"bought_{s.window_days} >= {s.min_count}",
            d.PURCHASE_VALUE: f"spent_{s.window_days} >= {s.min_value}",
            d.CART_ABANDON: f"cart > purchase AND ms//1000 - cart//1000 >= {s.min_days}*86400",
            d.CATEGORY_VIEWS: f"seen_{s.category} >= {s.min_count}",
            d.RECENTLY_ACTIVE: "TRUE",
            d.NEVER_PURCHASED: "bought_ever = 0",
            d.CHURN_RISK: "FALSE",
            d.MULTI_CATEGORY: f"kinds >= {s.min_distinct}",
        }[s.family]

    flags = "\n  UNION ALL ".join(f"SELECT profile_id, event_id, ms, '{s.id}' AS segment_id, {holds(s)} AS member FROM states"
                                  for s in segments)
    return f"""
, first_seen AS (SELECT profile_id, ms, count(*) AS fresh FROM (
    SELECT profile_id, coalesce(category,'') AS c, min(timestamp_ms) AS ms FROM fx_storefront
    WHERE event_type='page_view' GROUP BY 1, 2) GROUP BY 1, 2),
moments AS (SELECT s.profile_id, s.timestamp_ms AS ms, min(event_id) AS event_id,
    count(*) FILTER (event_type='purchase') AS bought, coalesce(sum(price) FILTER (event_type='purchase'), 0) AS spent,
    coalesce(max(timestamp_ms) FILTER (event_type='add_to_cart'), 0) AS carted,
    coalesce(max(timestamp_ms) FILTER (event_type='purchase'), 0) AS paid, {views}
  FROM fx_storefront s GROUP BY 1, 2),
states AS MATERIALIZED (SELECT m.profile_id, m.event_id, m.ms, sum(bought) {ever} AS bought_ever, max(carted) {ever} AS cart,
    max(paid) {ever} AS purchase, sum(coalesce(fresh, 0)) {ever} AS kinds, {sums}
  FROM moments m LEFT JOIN first_seen f ON f.profile_id = m.profile_id AND f.ms = m.ms),
flags AS ({flags}),
steps AS (SELECT *, lag(member, 1, FALSE) OVER (PARTITION BY profile_id, segment_id ORDER BY ms) AS was FROM flags)
SELECT profile_id, event_id, segment_id, CASE WHEN member THEN 'enter' ELSE 'exit' END AS change
FROM steps WHERE member <> was"""


def _percentiles(value: str) -> str:
    ranks = ", ".join(f"min(CASE WHEN cc >= greatest(1, floor(CAST({share} AS DOUBLE)*n)) THEN v END) AS {name}"
                      for share, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    return f""", h AS (SELECT {value} AS v, count(*) AS c FROM lags GROUP BY 1),
      r AS (SELECT v, sum(c) OVER (ORDER BY v) AS cc, sum(c) OVER () AS n FROM h)
      SELECT {ranks}, min(v) AS min_ms, max(v) AS max_ms, CAST(max(n) AS BIGINT) AS n FROM r"""


DASHBOARD = VIEWS + """
SELECT minute, channel, status, count(DISTINCT webhook_id) AS distinct_count FROM hooks
WHERE timestamp_ms >= (SELECT (t - 6*CAST(3600000 AS BIGINT))//60000*60000 FROM hook_now) GROUP BY ALL"""

COUNTS = VIEWS + "SELECT channel, status, count(*) AS count FROM fx_webhooks GROUP BY ALL"
ROLLUP = VIEWS + "SELECT minute, channel, status, event_count FROM rollup"
EVENT_ROWS = VIEWS + "SELECT event_id, profile_id, event_type, timestamp_ms FROM fx_storefront"
READING_KEYS = VIEWS + "SELECT device_id, sequence FROM fx_readings"
ALL_MEMBERS = VIEWS + MEMBERS + "SELECT segment_id, profile_id FROM members"

ORACLES: dict[str, str] = {
    "topic_snapshot": EVENT_ROWS,
    "topic_stream": EVENT_ROWS,
    "decode_records": VIEWS + "SELECT event_id, k FROM base UNION ALL SELECT event_id, 0 FROM base WHERE event_id%50=1",
    "parse_webhooks": VIEWS + """SELECT webhook_id, message_id, channel, status, provider,
      CASE WHEN n%30=0 THEN 1706745600000 ELSE timestamp_ms END AS timestamp_ms
      FROM fx_webhooks WHERE n%40<>0 AND n%60<>0""",
    "keyed_partitions": VIEWS + """SELECT device_id, count(*) AS n, CAST(1 AS BIGINT) AS n_partitions,
      CAST(0 AS BIGINT) AS n_misplaced FROM fx_readings GROUP BY device_id""",
    "event_store_append": VIEWS + """SELECT event_id, profile_id, event_type, timestamp_ms, category,
      CAST(price AS VARCHAR) AS price, strftime(make_timestamp(timestamp_ms*1000), '%Y-%m-%d') AS event_date FROM fx_storefront""",
    "undelivered_replay": READING_KEYS,
    "table_reset": VIEWS + "SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n FROM fx_webhooks",
    "membership_snapshot": ALL_MEMBERS,
    "membership_delta": VIEWS + _members("before", 7) + MEMBERS + DELTA,
    "summary_json": VIEWS + """, c AS (SELECT channel, status, count(*) AS n FROM fx_webhooks GROUP BY ALL)
      SELECT '{"generated_at":"2024-02-01T00:00:00Z","rows":['||string_agg('{"channel":"'||channel||'","status":"'||status
        ||'","count":'||n||'}', ',' ORDER BY channel, status)||']}' AS body FROM c""",
    "json_rows": VIEWS + """SELECT '{"channel":"'||channel||'","status":"'||status||'","count":'||count(*)||'}' AS value
      FROM fx_webhooks GROUP BY channel, status""",
    "scalar_time": VIEWS + f"""SELECT webhook_id, minute, timestamp_ms - {DAY} AS day_ago_ms,
      timestamp_ms//1000 AS clock_sec, strftime(make_timestamp(timestamp_ms*1000), '%Y-%m-%d %H:%M:%S.%g') AS at_text
      FROM hooks""",
    "scalar_map": VIEWS + """SELECT event_id, coalesce(category,'') AS category,
      CAST(coalesce(price,0) AS DOUBLE) AS price_or_zero FROM fx_storefront""",
    "scalar_string": VIEWS + """SELECT event_id, 'evt-'||lpad(CAST(n AS VARCHAR),8,'0') AS padded_id,
      event_id||'|'||CAST(CAST(coalesce(price,0) AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
      CAST(CAST(coalesce(price,0) AS DECIMAL(18,2)) AS VARCHAR) AS price_part FROM fx_storefront""",
    "filter_events": VIEWS + f"""SELECT event_id FROM fx_storefront, now
      WHERE event_type='purchase' AND timestamp_ms BETWEEN t - 30*{DAY} AND t""",
    "dedup_readings": VIEWS + "SELECT DISTINCT device_id, sequence FROM fx_readings JOIN fx_arrival USING (n)",
    "dedup_events": VIEWS + "SELECT DISTINCT event_id FROM fx_storefront JOIN fx_arrival USING (n)",
    "dedup_webhooks": VIEWS + "SELECT DISTINCT webhook_id FROM fx_webhooks JOIN fx_arrival USING (n)",
    "dedup_first": VIEWS + """SELECT device_id, sequence, copy FROM fx_readings JOIN fx_arrival USING (n)
      QUALIFY row_number() OVER (PARTITION BY device_id, sequence ORDER BY arrival, copy, n) = 1""",
    "dedup_verdict": VIEWS + """SELECT event_id, copy,
      row_number() OVER (PARTITION BY event_id ORDER BY arrival, copy, n) = 1 AS accepted
      FROM fx_storefront JOIN fx_arrival USING (n)""",
    "dedup_counts": VIEWS + """SELECT count(*) FILTER (nth = 1) AS accepted, count(*) FILTER (nth > 1) AS rejected FROM (
      SELECT row_number() OVER (PARTITION BY event_id ORDER BY arrival, copy, n) AS nth
      FROM fx_storefront JOIN fx_arrival USING (n))""",
    "dedup_bounded": VIEWS + FORGETFUL,
    "dedup_bounded_stream": VIEWS + FORGETFUL,
    "dedup_stream_late": VIEWS + "SELECT event_id, timestamp_ms FROM fx_storefront",
    "dedup_sharded": VIEWS + FORGETFUL_SHARDS,
    "dedup_sharded_stream": VIEWS + FORGETFUL_SHARDS,
    "dedup_state_size": VIEWS + """SELECT CAST(sum(least(n, 16)) AS BIGINT) AS entries, count(*) AS devices FROM (
      SELECT device_id, count(DISTINCT sequence) AS n FROM fx_readings GROUP BY device_id)""",
    "dedup_state_peak": VIEWS + DELIVERED_READINGS + """SELECT max(entries) AS peak,
      (SELECT count(DISTINCT device_id)*16 FROM fx_readings) AS bound,
      max(entries) <= (SELECT count(DISTINCT device_id)*16 FROM fx_readings) AS ok FROM trace""",
    "dedup_state_trace": VIEWS + DELIVERED_READINGS + "SELECT sample, entries FROM trace",
    "duplicate_stats": VIEWS + """SELECT count(DISTINCT event_id) AS unique_n, count(*) AS delivered_n,
      round((count(*)-count(DISTINCT event_id))/count(*), 6) AS dup_fraction
      FROM fx_storefront JOIN fx_arrival USING (n)""",
    "diff_sets": VIEWS + MEMBERS + _members("before", 1) + DEFINITIONS + _diff("members", "before"),
    "segments_validate": VIEWS + MEMBERS + DEFINITIONS + _diff("members", "members"),
    "multiset_diff": VIEWS + """SELECT event_id, count(*) AS left_n, CAST(1 AS BIGINT) AS right_n
      FROM fx_storefront JOIN fx_arrival USING (n) GROUP BY event_id HAVING count(*) <> 1""",
    "rollup_reconcile": VIEWS + """, expected AS (SELECT channel, status, count(*) AS e FROM fx_webhooks GROUP BY ALL),
      actual AS (SELECT channel, status, CAST(sum(event_count) AS BIGINT) AS a FROM rollup
        WHERE NOT (channel='mail' AND (epoch_us(minute)//60000000)%7=0) GROUP BY ALL)
      SELECT channel, status, coalesce(e,0) AS expected_n, coalesce(a,0) AS actual_n, coalesce(e,0)=coalesce(a,0) AS exact
      FROM expected FULL JOIN actual USING (channel, status)""",
    "lost_records": VIEWS + """SELECT count(*) AS sent, count(*) FILTER (n%97<>0) AS landed,
      count(*) FILTER (n%97=0) AS lost FROM fx_readings""",
    "state_digest": VIEWS + DIGEST + "SELECT device_id, digest FROM digests",
    "table_digest": VIEWS + DIGEST + """
      , named AS (SELECT sha256(device_id) AS pos, device_id||':'||digest AS txt FROM digests),
      six AS (SELECT left(pos,6) AS pos, sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS txt FROM named GROUP BY left(pos,6)),
      three AS (SELECT left(pos,3) AS pos, sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS txt FROM six GROUP BY left(pos,3))
      SELECT sha256(string_agg(txt, ',' ORDER BY pos, txt)) AS digest FROM three""",
    "event_lag": VIEWS + LAGS + "SELECT event_id, lag_ms FROM lags",
    "event_lag_stream": VIEWS + LAGS + "SELECT event_id, lag_ms FROM lags",
    "lag_percentiles": VIEWS + LAGS + _percentiles("lag_ms"),
    "lag_percentiles_fractional": VIEWS + LAGS + _percentiles("lag_ms/8"),
    "consumer_lag": VIEWS + """SELECT CAST(n%6 AS INTEGER) AS partition,
      count(*) - CASE WHEN n%6=5 THEN 0 ELSE count(*) FILTER (n%10<>0) END AS lag FROM fx_storefront GROUP BY n%6""",
    "loss_by_rate": VIEWS + """, offered AS (SELECT ([30,50,70,90,110,150,200,300])[n%8+1] AS rate, k FROM base),
      judged AS (SELECT rate, rate>100 AND k < (rate-100)//2 AS diverted FROM offered),
      per_rate AS (SELECT rate, count(*) AS sent, count(*) FILTER (diverted) AS diverted FROM judged GROUP BY rate)
      SELECT rate, sent, diverted, round(diverted/sent, 6) AS fraction,
        (SELECT min(rate) FROM per_rate WHERE diverted>0) AS first_lossy_rate FROM per_rate""",
    "throughput": VIEWS + "SELECT minute, round(count(*)/60, 6) AS rows_per_sec FROM hooks GROUP BY minute",
    "store_counts": VIEWS + "SELECT count(*) AS rows_n, count(DISTINCT profile_id) AS profiles_n FROM fx_storefront",
    "rollup_ratio": VIEWS + """SELECT (SELECT count(*) FROM fx_webhooks) AS raw_n, count(*) AS rollup_n,
      round(count(*)/(SELECT count(*) FROM fx_webhooks), 6) AS ratio FROM rollup""",
    "delivery_recompute": COUNTS,
    "delivery_rollup_counts": COUNTS,
    "delivery_summary": COUNTS,
    "channel_counts": VIEWS + "SELECT channel, count(*) AS count FROM fx_webhooks GROUP BY channel",
    "minute_rollup": ROLLUP,
    "minute_rollup_merge": ROLLUP,
    "minute_rollup_stream": ROLLUP,
    "minute_windows": ROLLUP,
    "dashboard_raw": DASHBOARD,
    "dashboard_rollup": DASHBOARD,
    "dashboard_totals": VIEWS + """, c AS (SELECT channel, status, count(*) AS count FROM fx_webhooks GROUP BY ALL)
      SELECT channel, status, count, CAST(sum(count) OVER (PARTITION BY channel) AS BIGINT) AS channel_total,
        CAST(sum(count) OVER () AS BIGINT) AS grand_total, round(count/greatest(max(count) OVER (), 1), 6) AS share FROM c""",
    "message_lifecycle": VIEWS + """SELECT message_id, webhook_id, status, timestamp_ms,
      row_number() OVER (PARTITION BY message_id ORDER BY timestamp_ms, webhook_id) AS position FROM fx_webhooks""",
    "as_of": VIEWS + "SELECT t AS as_of_ms FROM now",
    "profile_stats": VIEWS + """SELECT profile_id, count(*) AS events_n,
      count(*) FILTER (event_type='purchase') AS purchases_n, max(timestamp_ms) AS last_event_ms,
      coalesce(max(timestamp_ms) FILTER (event_type='add_to_cart'),0) AS last_cart_ms,
      coalesce(max(timestamp_ms) FILTER (event_type='purchase'),0) AS last_purchase_ms
      FROM fx_storefront GROUP BY profile_id""",
    "category_views": VIEWS + """SELECT profile_id, category, count(*) AS views FROM fx_storefront
      WHERE event_type='page_view' AND category IS NOT NULL GROUP BY ALL""",
    "profile_timeline": VIEWS + """SELECT profile_id, event_id,
      row_number() OVER (PARTITION BY profile_id ORDER BY timestamp_ms, event_id) AS position FROM fx_storefront""",
    "rolling_purchases": VIEWS + "SELECT event_id, " + ", ".join(
        f"count(*) OVER w{d} AS n_{d}d, CAST(sum(price) OVER w{d} AS DOUBLE) AS value_{d}d" for d in (7, 30, 90))
    + " FROM fx_storefront WHERE event_type='purchase' WINDOW " + ", ".join(
        f"w{d} AS (PARTITION BY profile_id ORDER BY timestamp_ms RANGE BETWEEN CAST({d} AS BIGINT)*86400000 PRECEDING AND CURRENT ROW)"
        for d in (7, 30, 90)),
    "membership_timeline": VIEWS + _timeline(),
    "segment_purchase_count": _one_family("purchase_count_min_2_30d"),
    "segment_purchase_value": _one_family("purchase_value_min_100_90d"),
    "segment_cart_abandon": _one_family("cart_abandon_7d"),
    "segment_category_views": _one_family("category_view_min_electronics_3"),
    "segment_recently_active": _one_family("recently_active_24h"),
    "segment_never_purchased": _one_family("never_purchased"),
    "segment_churn_risk": _one_family("churn_risk_30d"),
    "segment_multi_category": _one_family("multi_category_shopper_min_3"),
    "segment_definitions": VIEWS + MEMBERS + DEFINITIONS + SIZES
    + "SELECT defs.*, sizes.n FROM defs JOIN sizes ON sizes.segment_id = defs.id",
    "segment_membership_all": ALL_MEMBERS,
    "segments_incremental": VIEWS + OWN_MEMBERS + "SELECT segment_id, profile_id FROM members",
    "segments_finalize": ALL_MEMBERS,
    "segment_sizes": VIEWS + MEMBERS + DEFINITIONS + SIZES + "SELECT segment_id, n FROM sizes",
    "members_of": _one_family("purchase_count_min_2_30d"),
    "profile_segments": VIEWS + MEMBERS
    + "SELECT profile_id, string_agg(segment_id, ',' ORDER BY segment_id) AS segments FROM members GROUP BY profile_id",
}
