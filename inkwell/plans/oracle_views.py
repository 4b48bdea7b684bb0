"""DuckDB texts of the FIXTURES.md §3 views, inlined as CTEs into oracle SQL.

The driver pre-registers only the raw tables, so each oracle query carries the
views it needs. These are the fixed view definitions, not operator logic.
"""

from __future__ import annotations

_CATS = ("['national','international','politics','business','finance','sports','technology','science',"
         "'automobile','education','health','entertainment','lifestyle','crime','environment','jobs',"
         "'defence','real_estate','opinion']")

VIEWS = {
    "articles": f"""SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title,
  text AS content, lang AS language, source AS source_name,
  ({_CATS})[CAST(doc_id % 19 + 1 AS INT)] AS category_slug,
  TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST((doc_id * 7919) % 43200 AS INT)) AS publish_time
FROM documents""",
    "interactions": """SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'like' WHEN 'signup' THEN 'bookmark'
    WHEN 'purchase' THEN 'share' ELSE 'comment' END AS interaction_type,
  CASE WHEN event_type = 'view' THEN value END AS time_spent_seconds
FROM events""",
    "ievents": """SELECT *, CASE WHEN interaction_type = 'like' THEN
    CASE WHEN row_number() OVER (PARTITION BY user_id, item_id, interaction_type ORDER BY ts, event_id) % 2 = 1
         THEN 'like' ELSE 'unlike' END ELSE interaction_type END AS action
FROM interactions""",
    "users": """SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'fr' END AS language
FROM (SELECT DISTINCT user_id FROM events) u""",
    "preferences": f"""SELECT user_id, language AS preferred_languages,
  concat_ws(',', c[CAST(user_id % 19 + 1 AS INT)], c[CAST((user_id + 5) % 19 + 1 AS INT)],
            c[CAST((user_id + 11) % 19 + 1 AS INT)]) AS preferred_categories,
  user_id % 5 <> 0 AS notification_enabled
FROM (SELECT user_id, language, {_CATS} AS c FROM users WHERE user_id % 7 <> 0) u""",
    "sources": """SELECT DISTINCT source AS source_name, 1 + CAST(substring(source, 4) AS INT) % 3 AS priority,
  CAST(5 + CAST(substring(source, 4) AS INT) % 6 AS DOUBLE) / CAST(10 AS DOUBLE) AS reliability_score
FROM documents""",
    "scrape_log": """SELECT event_id AS seq, ts, concat('src', user_id % 20) AS source_name,
  CASE WHEN event_type IN ('error', 'signup') OR (event_type = 'view' AND user_id % 2 = 0)
       THEN 'error' ELSE 'success' END AS status
FROM events""",
    "comments": """SELECT conv_id * 100 + turn AS comment_id, conv_id AS item_id,
  CASE WHEN turn = 0 THEN NULL ELSE conv_id * 100 + turn - 1 END AS parent_id, role AS user_role, text AS content
FROM conversations""",
    "categories": f"""SELECT unnest({_CATS}) AS category_slug, unnest(range(1, 20)) AS display_order""",
    "vectors": """SELECT vec_id AS article_id, embedding FROM embeddings""",
}

_DEPS = {"ievents": ("interactions",), "preferences": ("users",)}
_ORDER = ("articles", "interactions", "ievents", "users", "preferences", "sources", "scrape_log",
          "comments", "categories", "vectors")


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the CTEs for ``views`` (and their dependencies)."""
    need: set[str] = set()

    def add(v: str) -> None:
        for d in _DEPS.get(v, ()):
            add(d)
        need.add(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in _ORDER if v in need)
    text = body.strip()
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
