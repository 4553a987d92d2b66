"""Queries of sources, sinks and field normalisation (inventory A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recoflow.functions import text as T
from recoflow.operators import documents as docs_ops
from recoflow.operators import facets, filters, interactions
from recoflow.plans import duck as D
from recoflow.plans.fixtures import cte, frame, table
from recoflow.plans.registry import query
from recoflow.sources import tables as src

ITEMS = cte("items")


# --- A: sources and sinks ---------------------------------------------------------


@query("a01_ingest", "SELECT p_partkey AS item_id, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part")
def a01(spark, sf):
    """Ingest to Parquet with id and type normalisation (A1, A2, A3), read back."""
    path = src.scratch(spark)
    part = src.normalised_ids(table(spark, sf, "part"), "item_id", ("item_id", "p_partkey", "id"))
    src.ingest(src.as_text(part, keep=("item_id",)), path)
    return src.read(spark, path, ["item_id", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@query("a04_ordered_write", "SELECT row_number() OVER (ORDER BY p_partkey) AS place, p_partkey FROM part")
def a04(spark, sf):
    """Written in key order, places numbered as read (A4)."""
    path = src.scratch(spark)
    src.ordered(table(spark, sf, "part"), "p_partkey").write.parquet(path)
    return src.numbered(src.read(spark, path), "p_partkey").select("place", "p_partkey")


@query("a05_skip_if_present", "SELECT 'kept' AS state, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT 'replaced', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25")
def a05(spark, sf):
    """A second ingest leaves what is there; overwriting replaces it (A5)."""
    path, whole = src.scratch(spark), table(spark, sf, "lineitem")
    part = whole.where("l_quantity > 25")
    src.ingest(whole, path)
    src.ingest(part, path)
    kept = src.read(spark, path, ["l_orderkey", "l_linenumber"])
    other = src.scratch(spark)
    src.ingest(whole, other)
    src.ingest(part, other, overwrite=True)
    replaced = src.read(spark, other, ["l_orderkey", "l_linenumber"])
    return kept.select(F.lit("kept").alias("state"), "*").unionByName(replaced.select(F.lit("replaced").alias("state"), "*"))


@query("a06_manifest", "SELECT 'part' AS name, (SELECT count(*) FROM part) AS n_rows, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate'")
def a06(spark, sf):
    """Rows, columns and an order-insensitive digest of tables (A6); digest not shown."""
    return src.manifest({n: table(spark, sf, n) for n in ("part", "lineitem")}).select("name", "n_rows", "columns")


@query("a07_manifest_diff", "SELECT 'changed' AS name, 'changed' AS status")
def a07(spark, sf):
    """Manifests differ exactly where tables do."""
    part = table(spark, sf, "part")
    one = src.manifest({"same": part, "changed": part})
    two = src.manifest({"same": part.repartition(3, "p_brand"), "changed": part.withColumn("p_size", F.when(F.col("p_partkey") == 3, -1).otherwise(F.col("p_size")))})
    return src.manifest_diff(one, two)


@query("a07_row_diff", "SELECT p_partkey, p_size, 'left' AS side FROM part WHERE p_partkey % 50 = 7 UNION ALL SELECT p_partkey, p_size + 1, 'right' FROM part WHERE p_partkey % 50 = 7")
def a07_rows(spark, sf):
    from recoflow.operators.evaluate import differences

    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return differences(part, part.withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 50 == 7).cast("int")))


# --- B: fields --------------------------------------------------------------------


@query("b01_b06_clean_fields", f"{ITEMS}, {D.FACTS} SELECT item_id, {D.join('authors_l')} AS authors, {D.join('systems_l')} AS systems, {D.join('genres_l')} AS genres, {D.join(D.TAGS)} AS tags FROM facts")
def b01(spark, sf):
    """Split, ordered dedupe, tag filter, genres, authors, systems."""
    return frame(spark, sf, "items").select("item_id", T.joined(T.clean_authors("author")).alias("authors"), T.joined(T.clean_systems("system")).alias("systems"), T.joined(T.genres("genre")).alias("genres"), T.joined(T.filtered_tags("tags")).alias("tags"))


@query("b07_merged_tags", f"{ITEMS}, {D.FACTS} SELECT item_id, {D.join('tags_l')} AS tags FROM facts")
def b07(spark, sf):
    return frame(spark, sf, "items").select("item_id", T.joined(T.merged_tags("genre", "tags")).alias("tags"))


@query("b08_year", f"{ITEMS} SELECT item_id, {D.YEAR} AS year FROM items")
def b08(spark, sf):
    return frame(spark, sf, "items").select("item_id", T.year_of("published").alias("year"))


@query("b09_languages", f"{ITEMS} SELECT item_id, CASE language WHEN 'en-US' THEN 'English' WHEN 'en, fr' THEN 'English, French' WHEN 'und' THEN '' WHEN 'tok' THEN 'Toki Pona' WHEN 'spanglish' THEN 'Spanglish' ELSE 'German, XX, English' END AS languages FROM items")
def b09(spark, sf):
    return frame(spark, sf, "items").select("item_id", T.language_names("language").alias("languages"))


@query("b10_descriptions", f"{ITEMS} SELECT item_id, trim(regexp_replace(regexp_replace(replace(description, '</p>', ' '), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM items")
def b10(spark, sf):
    return frame(spark, sf, "items").select("item_id", T.description_text("description").alias("text"))


@query("b10_pages_text")
def b10_pages(spark, sf):
    """The text of whole HTML pages, entities decoded."""
    return table(spark, sf, "pages").select("page_id", T.description_text("html").alias("text"))


_RECORDED = "lower(x) NOT IN ('none', 'n/a', 'na', 'null', 'nan', 'unknown')"


@query("b11_placeholders", f"{ITEMS}, {D.FACTS} SELECT item_id, " + D.join(f"list_filter({D.split('system', ',')}, lambda x: {_RECORDED})") + " AS system, " + D.join(f"list_filter(systems_l, lambda x: {_RECORDED})") + " AS system_clean FROM facts")
def b11(spark, sf):
    """Placeholders go from the original and from the clean column."""
    clean = T.joined(T.clean_systems("system"))
    return frame(spark, sf, "items").select("item_id", T.without_placeholders("system").alias("system"), T.without_placeholders(clean).alias("system_clean"))


@query("b12_clean_or_original", f"{ITEMS}, {D.FACTS} SELECT item_id, {D.join('tags_l')} AS tags, coalesce(genre, '') AS genre FROM facts")
def b12(spark, sf):
    cleaned = docs_ops.clean_fields(frame(spark, sf, "items"))
    return cleaned.select("item_id", docs_ops.clean_or_original(cleaned, "tags").alias("tags"), docs_ops.clean_or_original(cleaned, "genre").alias("genre"))


@query("b13_token_sets", f"{ITEMS} SELECT item_id, CAST(len({D.distinct(D.lower(D.split('tags', ',')))}) AS BIGINT) AS n_tokens FROM items")
def b13(spark, sf):
    return frame(spark, sf, "items").select("item_id", F.size(T.tokens("tags")).cast("long").alias("n_tokens"))


@query("b14_b18_query_text", f"{ITEMS}, {D.FACTS} SELECT item_id, {D.profile('systems_l', 'tags_l')} AS query_text FROM facts")
def b14(spark, sf):
    """Rendered profile of an item's clean fields."""
    return frame(spark, sf, "items").select("item_id", T.profile_text(T.clean_systems("system"), T.merged_tags("genre", "tags")).alias("query_text"))


@query("b15_parsed_profiles", f"{ITEMS}, {D.FACTS} SELECT item_id, {D.join('systems_l')} AS systems, {D.join('tags_l')} AS tags FROM facts")
def b15(spark, sf):
    """Profiles parsed back from their text."""
    parsed = b14(spark, sf).select("item_id", T.parsed_profile("query_text").alias("p"))
    return parsed.select("item_id", T.joined(F.col("p.systems")).alias("systems"), T.joined(F.col("p.tags")).alias("tags"))


@query("b16_canonical_picks", f"""{ITEMS}, {D.FACTS}, n AS (SELECT v AS value, count(*) AS n FROM (SELECT item_id, unnest(tags_l) AS v FROM facts) GROUP BY v),
  ranks AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) AS place FROM n ORDER BY place LIMIT 8),
  picks AS (SELECT DISTINCT item_id AS query_id, unnest(tags_l) AS value FROM facts)
  SELECT query_id, string_agg(picks.value, ', ' ORDER BY coalesce(place, 1::BIGINT << 60), picks.value) AS picks FROM picks LEFT JOIN ranks USING (value) GROUP BY query_id""")
def b16(spark, sf):
    items = frame(spark, sf, "items")
    tags = T.merged_tags("genre", "tags")
    picks = items.select(F.col("item_id").alias("query_id"), F.explode(tags).alias("value"))
    found = interactions.canonical(picks, "query_id", docs_ops.top_values(items, tags, 8))
    return found.select("query_id", T.joined(F.col("values")).alias("picks"))


@query("b17_document_text", f"{ITEMS}, {D.FACTS} SELECT item_id, concat_ws('. ', 'Title: ' || title, 'Author: ' || {D.join('authors_l')}, CASE WHEN len(systems_l) > 0 THEN 'Systems: ' || {D.join('systems_l')} END, CASE WHEN len(tags_l) > 0 THEN 'Tags: ' || {D.join('tags_l')} END, 'Description: ' || trim(substr(description, 1, 500))) AS doc_text FROM facts")
def b17(spark, sf):
    return frame(spark, sf, "items").select("item_id", T.document_text("title", T.clean_authors("author"), T.clean_systems("system"), T.merged_tags("genre", "tags"), "description").alias("doc_text"))


_SHOWN = f"""{ITEMS}, each AS (SELECT item_id, unnest({D.split('tags', ',')}) AS value FROM items),
  counted AS (SELECT lower(value) AS key, value, count(*) AS n FROM each GROUP BY 1, 2),
  labels AS (SELECT key, arg_min(value, struct_pack(a := -n, b := value)) AS label FROM counted GROUP BY key),
  sizes AS (SELECT lower(value) AS key, count(DISTINCT item_id) AS n_items FROM each GROUP BY 1)"""


@query("b19_displayed_tags", f"{_SHOWN}, own AS (SELECT DISTINCT item_id, lower(value) AS key FROM each) SELECT item_id, string_agg(label, ', ' ORDER BY n_items DESC, label) AS display FROM own JOIN labels USING (key) JOIN sizes USING (key) GROUP BY item_id")
def b19(spark, sf):
    return docs_ops.displayed(frame(spark, sf, "items"), "tags")


@query("b20_profile_display", f"{ITEMS}, {D.FACTS}, tn AS (SELECT v, count(*) AS n FROM (SELECT unnest(tags_l) AS v FROM facts) GROUP BY 1), o AS (SELECT item_id, string_agg(v, ', ' ORDER BY n DESC, v) AS t FROM (SELECT item_id, unnest(tags_l) AS v FROM facts) JOIN tn USING (v) GROUP BY 1) SELECT item_id, {D.join('systems_l')} || ' // ' || {D.join('tags_l')} AS display, {D.join('systems_l')} || ' // ' || coalesce(t, '') AS by_frequency FROM facts LEFT JOIN o USING (item_id)")
def b20(spark, sf):
    """Profiles as a page shows them, tags as given and by frequency in the corpus."""
    parsed = b14(spark, sf).select("item_id", T.parsed_profile("query_text").alias("p"))
    tags = parsed.select("item_id", F.explode("p.tags").alias("value"))
    counts = tags.groupBy("value").agg((-F.count("*")).alias("place"))
    ordered = interactions.canonical(tags, "item_id", counts)
    shown = lambda t: F.concat(T.joined(F.col("p.systems")), F.lit(" // "), T.joined(t))
    frequent = F.coalesce("values", F.array().cast("array<string>"))
    return parsed.join(ordered, "item_id", "left").select("item_id", shown(F.col("p.tags")).alias("display"), shown(frequent).alias("by_frequency"))


@query("b21_rating_cells", f"{cte('stats')} SELECT item_id, printf('%.1f', avg_rating) || ' (' || review_count || ')' AS cell FROM stats")
def b21(spark, sf):
    return frame(spark, sf, "stats").select("item_id", T.rating_cell("avg_rating", "review_count").alias("cell"))


@query("b22_saved_filters", "SELECT p_partkey AS filter_id, 'system' AS field, p_type AS value FROM part UNION ALL SELECT p_partkey, 'min_rating', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'tags', p_name FROM part")
def b22(spark, sf):
    part = table(spark, sf, "part")
    number = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("many"))
    spec = F.concat(F.lit("Systems: "), F.col("p_type"), F.lit("; rating:"), number, F.lit("; colour: red; tag:'"), F.col("p_name"), F.lit("' ;;"))
    return filters.parsed_filters(part.select(F.col("p_partkey").alias("filter_id"), spec.alias("spec")), "filter_id", "spec")


@query("b23_picker_labels", f"{ITEMS}, {D.FACTS} SELECT item_id, title || ' — ' || coalesce(author, '') || CASE WHEN year IS NULL THEN '' ELSE ' (' || year || ')' END AS label FROM facts")
def b23(spark, sf):
    year = F.coalesce(F.concat(F.lit(" ("), T.year_of("published").cast("string"), F.lit(")")), F.lit(""))
    return frame(spark, sf, "items").select("item_id", F.concat("title", F.lit(" — "), T.text_of("author"), year).alias("label"))


@query("b23_author_labels", f"{ITEMS}, {D.FACTS}, a AS (SELECT DISTINCT unnest(authors_l) AS author_id, item_id FROM facts) SELECT author_id, author_id || '  ·  ' || count(*) || CASE WHEN count(*) = 1 THEN ' game' ELSE ' games' END AS label FROM a GROUP BY 1")
def b23_authors(spark, sf):
    """Authors but catch-all ones, with the number of their items."""
    n = filters.without_names(docs_ops.by_author(frame(spark, sf, "items")), "author_id").groupBy("author_id").agg(F.count("*").alias("n"))
    return n.select("author_id", F.concat("author_id", F.lit("  ·  "), F.col("n").cast("string"), F.when(F.col("n") == 1, " game").otherwise(" games")).alias("label"))


@query("b23_reviewer_labels", f"{cte('reviews', 'users')} SELECT u.user_id, name || '  ·  ' || count(r.user_id) || ' reviews' AS label FROM users u LEFT JOIN reviews r USING (user_id) GROUP BY u.user_id, name")
def b23_reviewers(spark, sf):
    """Reviewers with the number of their reviews."""
    n = frame(spark, sf, "reviews").groupBy("user_id").agg(F.count("*").alias("n"))
    users = frame(spark, sf, "users").join(n, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return users.select("user_id", F.concat(F.coalesce("name", "user_id"), F.lit("  ·  "), F.col("n").cast("string"), F.lit(" reviews")).alias("label"))


# --- E: vocabularies and statistics -------------------------------------------------


@query("e01_e02_rating_stats", f"{cte('stats')} SELECT item_id, review_count, avg_rating, bayesian_avg FROM stats")
def e01(spark, sf):
    return frame(spark, sf, "stats")


@query("e04_casings", f"{_SHOWN} SELECT key, label, n_items FROM labels JOIN sizes USING (key)")
def e04(spark, sf):
    return docs_ops.casings(frame(spark, sf, "items"), T.split_values("tags", ","))


_COUNTS = f"{ITEMS}, {D.FACTS}, n AS (SELECT v AS value, count(*) AS n_items FROM (SELECT unnest(tags_l) AS v FROM facts) GROUP BY v)"


@query("e05_value_counts", f"{_COUNTS} SELECT value, n_items FROM n")
def e05(spark, sf):
    return docs_ops.value_counts(frame(spark, sf, "items"), T.merged_tags("genre", "tags"))


@query("e06_top_values", f"{_COUNTS} SELECT value, n_items, row_number() OVER (ORDER BY n_items DESC, value) AS place FROM n ORDER BY place LIMIT 10")
def e06(spark, sf):
    return docs_ops.top_values(frame(spark, sf, "items"), T.merged_tags("genre", "tags"), 10)


@query("e15_topics", f"""{_SHOWN}, kinds AS (SELECT item_id, unnest({D.split('genre')}) AS value FROM items),
  kc AS (SELECT lower(value) AS key, value, count(*) AS n FROM kinds GROUP BY 1, 2),
  kl AS (SELECT key, arg_min(value, struct_pack(a := -n, b := value)) AS label FROM kc GROUP BY key),
  own AS (SELECT item_id, lower(value) AS key FROM each UNION SELECT item_id, lower(value) FROM kinds)
  SELECT key, coalesce(labels.label, kl.label) AS label, count(DISTINCT item_id) AS n_items FROM own LEFT JOIN labels USING (key) LEFT JOIN kl USING (key) GROUP BY 1, 2""")
def e15(spark, sf):
    return docs_ops.topics(frame(spark, sf, "items"))


@query("e16_reviewer_counts", f"{cte('users', 'reviews')} SELECT u.user_id, u.name, count(r.event_id) AS n_reviews FROM users u LEFT JOIN reviews r ON u.user_id = r.user_id GROUP BY 1, 2")
def e16(spark, sf):
    users, counts = frame(spark, sf, "users"), frame(spark, sf, "reviews").groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(counts, "user_id", "left").select("user_id", "name", F.coalesce("n", F.lit(0)).alias("n_reviews"))


@query("e17_distribution", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def e17(spark, sf):
    found = facets.distribution(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p90", "p99")], "max")


@query("e19_corpus_facets", f"{ITEMS}, g AS (SELECT unnest({D.distinct(D.split('genre'))}) AS value FROM items), s AS (SELECT unnest({D.distinct(D.split('system'))}) AS value FROM items), a AS (SELECT unnest({D.AUTHORS}) AS value FROM items), t AS (SELECT unnest({D.distinct(D.split('tags', ','))}) AS value FROM items) SELECT 'genre' AS facet, value, count(*) AS n FROM g GROUP BY value UNION ALL SELECT 'system', value, count(*) FROM s GROUP BY value UNION ALL SELECT 'author', value, count(*) FROM a GROUP BY value UNION ALL SELECT 'tags', value, count(*) FROM t GROUP BY value")
def e19(spark, sf):
    everything = frame(spark, sf, "items").withColumn("query_id", F.lit(0))
    return facets.facet_counts(everything, ("genre", "system", "author", "tags")).drop("query_id")


_VALUES = {"genre": D.distinct(D.split("genre")), "system": D.distinct(D.split("system")), "author": D.AUTHORS, "tags": D.distinct(D.split("tags", ","))}
_EACH = " UNION ALL ".join(f"SELECT item_id, '{f}' AS facet, unnest({v}) AS value FROM items" for f, v in _VALUES.items())


@query("e19_vocabularies", f"{ITEMS}, ev AS ({_EACH}), cs AS (SELECT facet, lower(value) AS key, value, count(*) AS n FROM ev GROUP BY 1, 2, 3), lb AS (SELECT facet, key, arg_min(value, struct_pack(a := -n, b := value)) AS label FROM cs GROUP BY 1, 2), sz AS (SELECT facet, lower(value) AS key, count(DISTINCT item_id) AS n FROM ev GROUP BY 1, 2) SELECT facet, label, n FROM lb JOIN sz USING (facet, key)")
def e19_vocabularies(spark, sf):
    """The values that filters offer, canonically cased."""
    return facets.vocabularies(frame(spark, sf, "items"))


@query("e19_years", f"{ITEMS}, {D.FACTS} SELECT unnest(range(max(year), min(year) - 1, -1))::INT AS year FROM facts")
def e19_years(spark, sf):
    """All years from the last to the first, those without items too."""
    return facets.year_list(docs_ops.clean_fields(frame(spark, sf, "items")))


@query("e21_coverage", f"{_COUNTS} SELECT round((SELECT sum(n_items) FROM (SELECT n_items FROM n ORDER BY n_items DESC, value LIMIT 5)) / (SELECT sum(n_items) FROM n), 6) AS share")
def e21(spark, sf):
    found = docs_ops.coverage(frame(spark, sf, "items"), T.merged_tags("genre", "tags"), 5)
    return found.select(F.round("share", 6).alias("share"))
