"""How the driver's tables play the part of a catalogue, its reviews and its users.

The statements are plain enough for Spark and DuckDB alike: ``{name}`` stands for a
table.  ``frame`` runs one in Spark; ``cte`` gives it as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

STATEMENTS = {
    # author: the first and the last supplier of a part; some parts have one only
    "creators": """
        SELECT l_partkey AS item_id, CASE WHEN l_partkey % 3 = 0 OR min(s_name) = max(s_name) THEN min(s_name)
               ELSE concat(min(s_name), ' and ', max(s_name)) END AS author
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_partkey""",
    "items": """
        SELECT p_partkey AS item_id, CASE WHEN p_partkey % 97 = 5 THEN ' ' ELSE p_name END AS title, author,
               concat(p_type, ' ', p_size, ' (', p_brand, ')', CASE WHEN p_partkey % 11 = 0 THEN ', None' WHEN p_partkey % 7 = 0 THEN '/Inform 7, inform' ELSE '' END) AS system,
               CASE WHEN p_partkey % 5 = 0 THEN concat(p_type, '/Puzzle') ELSE p_type END AS genre,
               concat(replace(p_name, ' ', ', '), ', ', p_type, CASE WHEN p_partkey % 13 = 0 THEN ', IFComp 2019, Red' WHEN p_partkey % 17 = 0 THEN ', not a game' ELSE '' END) AS tags,
               CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat('released ', 1970 + p_size, '-01-01') END AS published,
               concat('<p>A ', p_name, '</p>of <b>', p_brand, '</b>') AS description,
               CASE p_partkey % 6 WHEN 0 THEN 'en-US' WHEN 1 THEN 'en, fr' WHEN 2 THEN 'und' WHEN 3 THEN 'tok' WHEN 4 THEN 'spanglish' ELSE 'de (in part); xx/en' END AS language
        FROM {part} LEFT JOIN creators ON p_partkey = item_id""",
    "reviews": """
        SELECT event_id, concat(CASE WHEN user_id % 10 = 3 THEN 'X-' ELSE 'u' END, user_id) AS user_id,
               CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS item_id,
               CASE WHEN event_type = 'error' THEN NULL ELSE 1 + CAST(CAST(floor(value) AS BIGINT) % 9 AS DOUBLE) / 2 END AS rating
        FROM {events}""",
    "users": "SELECT concat('u', c_custkey) AS user_id, c_name AS name FROM {customer} WHERE c_custkey % 7 <> 0",
    "plays": """
        SELECT DISTINCT concat('u', o_custkey) AS user_id, l_partkey % 100 AS item_id
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'""",
    # Means of known ratings, and the mean drawn to 3.5 with the weight of 5
    "stats": """
        SELECT item_id, count(rating) AS review_count, {round2}(avg(rating)) AS avg_rating,
               {round2}((5 * CAST(3.5 AS DOUBLE) + count(rating) * {round2}(avg(rating))) / (5 + count(rating))) AS bayesian_avg
        FROM reviews GROUP BY item_id HAVING count(rating) > 0""",
}

#: Statements that a statement stands on.
NEEDS = {"items": ("creators",), "stats": ("reviews",)}


def cte(*names: str) -> str:
    """``WITH name AS (...), ...`` for DuckDB."""
    wanted: list[str] = []
    for name in names:
        wanted += [x for x in (*NEEDS.get(name, ()), name) if x not in wanted]
    fill = {t: t for t in TABLES} | {"round2": "round2"}
    parts = []
    for name in wanted:
        text = STATEMENTS[name].format(**fill)
        while "round2(" in text:
            text = _half_even(text)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(parts)


def _half_even(text: str) -> str:
    """Replace the last, thus innermost-first, round2(x) by DuckDB's function."""
    at = text.rindex("round2(")
    depth, end = 0, at + 6
    for end in range(at + 6, len(text)):
        depth += {"(": 1, ")": -1}.get(text[end], 0)
        if not depth:
            break
    return f"{text[:at]}round_even({text[at + 7 : end]}, 2){text[end + 1 :]}"


#: Labelled interactions (inter) and their split (parts).
LABELLED = cte("users", "reviews", "stats") + """, lab AS (SELECT user_id, item_id, CAST(max(CASE WHEN rating > coalesce(bayesian_avg, 3.5) + 0.25 THEN 1 ELSE 0 END) AS INT) AS label
  FROM reviews LEFT JOIN stats USING (item_id) WHERE user_id IN (SELECT user_id FROM users) AND regexp_full_match(user_id, '[a-z0-9]+')
  AND (rating > coalesce(bayesian_avg, 3.5) + 0.25 OR rating < coalesce(bayesian_avg, 3.5) - 0.25) GROUP BY 1, 2),
  u2 AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS nu FROM lab), i2 AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS ni FROM u2 WHERE nu >= 2),
  inter AS (SELECT user_id, item_id, label FROM i2 WHERE ni >= 2),
  sp0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY md5('42|' || user_id || '|' || item_id), item_id) AS place, count(*) OVER (PARTITION BY user_id, label) AS n FROM inter),
  sp1 AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 ELSE greatest(1, round_even(n * 0.1, 0)) END AS nt, CASE WHEN n < 3 THEN 0 WHEN n < 4 THEN 1 ELSE greatest(1, round_even(n * 0.1, 0)) END AS nv FROM sp0),
  parts AS (SELECT user_id, item_id, label, CASE WHEN label = 0 THEN 'train' WHEN place <= nt THEN 'test' WHEN place <= nt + nv AND place < n THEN 'val' ELSE 'train' END AS split FROM sp1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the statements as a DataFrame."""
    if name == "stats":
        from recoflow.operators.documents import rating_stats

        return rating_stats(frame(spark, sf_dir, "reviews"))
    text = STATEMENTS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    for need in NEEDS.get(name, ()):
        text, used[need] = text.replace(f" {need} ", f" {{{need}}} "), frame(spark, sf_dir, need)
    return spark.sql(text, **used)
