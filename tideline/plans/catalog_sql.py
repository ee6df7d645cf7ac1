"""Common pieces of the catalog's SQL oracles."""

#: Legs of the events table: purchases are leg 0, clicks leg 1; t in seconds since the first of both.
LEGS = """ev AS (SELECT event_id, user_id, value, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS leg
                FROM events WHERE event_type IN ('purchase', 'click')),
   legs AS (SELECT event_id, user_id, value, leg, (us - (SELECT min(us) FROM ev)) / 1e6 AS t FROM ev)"""
