"""Pieces of the SQL that checks the queries."""

from __future__ import annotations

#: The white space of tallyloom.functions.text in RE2 notation.
_WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


#: CTE ``valid`` (user_id, item_id, category, behavior, ts): the valid rows of the log, repeated ones once.
VALID = f"""norm AS (SELECT upper({_strip('userId')}) AS user_id, upper({_strip('itemId')}) AS item_id,
  lower(regexp_replace({_strip('category')}, '{_WS}+', ' ', 'g')) AS category, lower({_strip('behavior')}) AS behavior,
  CASE WHEN "timestamp" >= 100000000000 THEN "timestamp" // 1000 ELSE "timestamp" END AS ts FROM user_behavior_log),
 valid AS (SELECT DISTINCT user_id, item_id, category, behavior, ts FROM norm WHERE regexp_full_match(user_id, 'U[0-9]+') AND regexp_full_match(item_id, 'I[0-9]+')
  AND category <> '' AND behavior IN ('pv', 'buy', 'cart', 'fav') AND ts > 0)"""
#: Text of a day number.
DAY = "strftime(DATE '1970-01-01' + CAST({0} AS INTEGER), '%Y-%m-%d')"
