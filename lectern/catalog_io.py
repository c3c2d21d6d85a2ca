"""Registered queries of sources, sinks, plans and rarely used operators; files go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import COMMENT_SQL, POSTS_SQL, TOKENS_SQL, URL_SQL, _post_urls, conversation_lists, post_words, posts, query
from .functions import nested, text, urls, values
from .operators import filters, ml, normalize, relate, stats, tokens
from .plans import charts, preprocess
from .session import table
from .session_scratch import materialised, scratch_folder
from .sources import tabular, words

# --- sources and sinks


@query("csv_round_trip", """SELECT event_id::VARCHAR AS event_id, event_type, props, '["' || event_type || '"]' AS tags FROM events""")
def csv_round_trip(spark, sf):
    path = f"{scratch_folder(spark)}/events"
    e = table(spark, sf, "events").select("event_id", "event_type", "props", F.array("event_type").alias("tags"))
    tabular.write_csv(e, path)
    return tabular.read_csv(spark, path)


@query("csv_tolerant", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def csv_tolerant(spark, sf):
    base = scratch_folder(spark)
    tabular.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), f"{base}/there")
    missing = tabular.read_csv_or_empty(spark, f"{base}/missing", "n_nationkey string, n_name string")
    return relate.append(missing, tabular.read_csv_or_empty(spark, f"{base}/there", "n_nationkey string, n_name string"))


@query("pickle_preferred", "SELECT n_nationkey, n_name FROM nation")
def pickle_preferred(spark, sf):
    """Of a missing Parquet table, a pickled frame and a CSV file, the pickle is read."""
    base = scratch_folder(spark)
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    tabular.write_pickle(n, f"{base}/n.pkl")
    tabular.write_csv(n.limit(0), f"{base}/n.csv")
    found, _ = tabular.read_preferred(spark, f"{base}/n.parquet", f"{base}/n.pkl", f"{base}/n.csv")
    return tabular.as_frame(spark, found)


@query("written_twice", "SELECT kind, count(*)::BIGINT AS n, sum(r_regionkey)::BIGINT AS keys FROM region, (VALUES ('parquet'), ('csv')) AS k(kind) GROUP BY kind")
def written_twice(spark, sf):
    base = f"{tabular.Layout(scratch_folder(spark)).path('datasets', 'region')}"
    tabular.write_both(table(spark, sf, "region"), base)
    one = lambda kind: tabular.as_frame(spark, f"{base}.{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.col("r_regionkey").cast("long")).alias("keys"))
    return relate.union_all(one("parquet"), one("csv"))


@query("layout_paths", "SELECT p AS part, 'x/' || p || '/a.csv' AS path FROM (VALUES ('datasets'), ('wordcloud/raw'), ('wordcloud/filtered'), ('tfidf'), ('kmeans'), ('lda'), ('stopwords')) AS t(p)")
def layout_paths(spark, sf):
    return spark.createDataFrame([(p, tabular.Layout("x/").path(p, "a.csv")) for p in tabular.Layout.PARTS], "part string, path string")


def _word_files(spark, sf) -> tuple[str, str]:
    """A general list of the region names and one of the nation names, with a note, a blank line and repetitions."""
    base = scratch_folder(spark)
    notes = spark.createDataFrame([("# note",), ("",), ("  ",)], "value string")
    for name, column in (("region", "r_name"), ("nation", "n_name")):
        names = table(spark, sf, name).select(F.concat(F.lit(" "), F.col(column)).alias("value"))
        notes.unionByName(names).unionByName(names).write.text(f"{base}/{name}")
    return f"{base}/region", f"{base}/nation"


@query("stopword_layers", "SELECT NULL::INT AS section, r_name AS keyword FROM region UNION ALL SELECT 2, n_name FROM nation")
def stopword_layers(spark, sf):
    common, local = _word_files(spark, sf)
    return words.layered_stopwords(spark, [common], {2: local})


@query("stopword_files", """SELECT 'clean' AS kind, count(*)::BIGINT + 1 AS n FROM region UNION ALL SELECT 'raw', count(*)::BIGINT + 3 FROM region""")
def stopword_files(spark, sf):
    path, _ = _word_files(spark, sf)
    sized = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return relate.union_all(sized(words.read_stopwords(spark, path), "clean"), sized(words.read_stopwords_raw(spark, path), "raw"))


@query("command_line_searches", """SELECT strftime(d, '%Y%m%d') AS search_date, keyword, sort AS search_sort, 46::INT AS links_wanted,
  'https://search.naver.com/search.naver?ssc=tab.blog.all&query=' || keyword || '&sm=tab_opt&nso=so%3A' || sort || '%2Cp%3Afrom' || strftime(d, '%Y%m%d') || 'to' || strftime(d, '%Y%m%d') AS search_url
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-06-30', INTERVAL 1 DAY)) AS d), (VALUES ('abc')) AS k(keyword), (VALUES ('r'), ('dd')) AS s(sort)""")
def command_line_searches(spark, sf):
    from .__main__ import main

    out = f"{scratch_folder(spark)}/searches"
    main(["searches", out, "--keywords", "abc"])
    return spark.read.parquet(out).select("search_date", "keyword", "search_sort", F.col("links_wanted").cast("int").alias("links_wanted"), "search_url")


# --- schema


@query("prepare_again", rf"""WITH {POSTS_SQL} SELECT title, section, doc, 'blog' AS ch, '2024-02-03' AS date FROM posts""")
def prepare_again(spark, sf):
    raw = posts(spark, sf).select("title", F.col("doc").alias("content"), F.lit("Blog").alias("source"), F.col("section").cast("string").alias("section"), F.lit("20240203").alias("date"))
    return normalize.prepare(normalize.prepare(raw)).select("title", "section", "doc", "ch", "date")


@query("default_columns", "SELECT n_nationkey, n_name, 'blog' AS ch, 0 AS likes FROM nation")
def default_columns(spark, sf):
    return normalize.with_defaults(table(spark, sf, "nation").select("n_nationkey", "n_name"), n_name="none", ch="blog", likes=0)


# --- functions


@query("text_extras", rf"""WITH {POSTS_SQL} SELECT rid, trim(regexp_replace(doc, '\s+', ' ', 'g')) AS cleaned, trim(title) AS title, len(regexp_extract_all(doc, '[^\s]+'))::BIGINT AS n FROM posts""")
def text_extras(spark, sf):
    doc = F.col("doc")
    return posts(spark, sf).select(
        "rid", text.clean_markup_text(doc).alias("cleaned"), text.strip_title_suffix(F.concat("title", F.lit(" :  Site ")), "Site").alias("title"), text.token_count(doc).cast("bigint").alias("n")
    )


@query("string_lists", """SELECT conv_id, count(*)::BIGINT AS n, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def string_lists(spark, sf):
    """Lists written with single quotes, as another language prints them."""
    c = conversation_lists(spark, sf)
    listed = F.concat(F.lit("['"), F.array_join(F.transform("said", lambda x: x["role"]), "', '"), F.lit("']"))
    found = nested.parse_string_list(listed)
    return c.select("conv_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, " ").alias("roles"))


@query("link_quota", "SELECT 50000::BIGINT AS links, 46::BIGINT AS each")
def link_quota(spark, sf):
    return spark.createDataFrame([values.quota(20_000, 2.5, 547, 1, 2, 40)], "links bigint, each bigint")


@query("comment_normalise", f"""SELECT conv_id, count(*)::BIGINT AS n, trim(min_by(text, place)) AS first, sum(turn)::BIGINT AS likes, '2024-03-05' AS day FROM ({COMMENT_SQL}) GROUP BY conv_id""")
def comment_normalise(spark, sf):
    plain = F.transform("said", lambda x: F.struct(F.concat(F.lit(" "), x["text"]).alias("comment_content"), x["turn"].cast("string").alias("comment_like"), F.lit("2024.3.5.").alias("comment_date")))
    c = conversation_lists(spark, sf).select("conv_id", nested.normalize_comments(plain).alias("c"))
    likes = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["comment_like"])
    return c.select("conv_id", F.size("c").cast("bigint").alias("n"), F.trim(nested.first_content(F.col("c"))).alias("first"), likes.alias("likes"), F.col("c")[0]["comment_date"].alias("day"))


# --- filters, joins, sets


@query("complete_rows", """SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 3""")
def complete_rows(spark, sf):
    c = conversation_lists(spark, sf)
    roles, likes = nested.join_delimited(F.transform("said", lambda x: x["role"])), nested.join_delimited(F.transform("said", lambda x: F.lit("3")))
    count = F.when(F.size("said") >= 3, F.size("said")).otherwise(0).cast("string")
    said = c.select("conv_id", F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("1").alias("post_like_count"), F.lit(None).cast("string").alias("like_count"),
        roles.alias("comments_text"), roles.alias("comment_times"), likes.alias("comment_like_counts"), count.alias("comment_count"))
    return filters.complete_comment_rows(said)[0].select("conv_id")


@query("keyword_filter", "SELECT event_id, 'strict' AS kind FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'blank too' FROM events WHERE event_type IN ('click') OR user_id % 5 = 0")
def keyword_filter(spark, sf):
    e = table(spark, sf, "events")
    strict = filters.with_keywords(e.withColumn("keyword", F.col("event_type")), ["click", "view"]).select("event_id", F.lit("strict").alias("kind"))
    blank = e.withColumn("keyword", F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.col("event_type")))
    return strict.unionByName(filters.with_keywords(blank, ["click"], blank_too=True).select("event_id", F.lit("blank too").alias("kind")))


@query("vocabulary_union", f"WITH {TOKENS_SQL} SELECT DISTINCT keyword FROM tokens WHERE section IN (1, 3)")
def vocabulary_union(spark, sf):
    t = post_words(spark, sf)
    return relate.union_sets(t.where("section = 1"), t.where("section = 3"))


@query("link_rows", f"SELECT replace({URL_SQL}, 'https://m.', 'https://') AS canonical_url, {URL_SQL} AS url FROM pages")
def link_rows(spark, sf):
    canonical = urls.canonical_post_url(F.col("url"))
    return relate.link_rows(_post_urls(spark, sf).select(F.array(canonical).alias("links"))).select("canonical_url", "url")


@query("largest_order", "SELECT o_custkey, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey")
def largest_order(spark, sf):
    return stats.max_per(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "largest")


@query("probability_sums", "SELECT 1.0::DOUBLE AS least, 1.0::DOUBLE AS most, 1.0::DOUBLE AS mean")
def probability_sums(spark, sf):
    d = table(spark, sf, "labels").select((F.col("quality") * 0.25).alias("topic_0"), (1 - F.col("quality") * 0.25).alias("topic_1"))
    return ml.probability_check(d, 2)


# --- tokens


def _said(spark, sf) -> DataFrame:
    said = F.transform("said", lambda x: F.struct(x["text"].alias("comment_content"), x["turn"].alias("comment_like"), F.lit("").alias("comment_date")))
    first = F.col("said")[0]["text"]
    return conversation_lists(spark, sf).select(F.col("conv_id").alias("rid"), F.lit(1).alias("section"), F.lit(0).alias("like"), F.size("said").alias("comment_cnt"), F.lit("a title of two").alias("title"), first.alias("doc"), said.alias("comment_list"))


WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


@query("comment_token_rows", f"""SELECT conv_id AS post_idx, place::INT AS comment_idx, text AS comment_text, len({WORDS_SQL})::BIGINT AS n_tokens,
  array_to_string(list_filter({WORDS_SQL}, lambda x: length(x) >= 2), ' ') AS nouns FROM ({COMMENT_SQL})""")
def comment_token_rows(spark, sf):
    rows = tokens.comment_rows(tokens.tokenised(_said(spark, sf), tokens.regex_analyser))
    return rows.select("post_idx", "comment_idx", "comment_text", F.size("comment_token_list").cast("bigint").alias("n_tokens"), F.array_join("comment_token_noun", " ").alias("nouns"))


@query("noun_table", f"""SELECT conv_id::VARCHAR AS rid, '["title","of","two"]' AS title_nouns, sum(len(list_filter({WORDS_SQL}, lambda x: length(x) >= 2)))::BIGINT AS n_comment_nouns FROM conversations GROUP BY conv_id""")
def noun_table(spark, sf):
    """Written as CSV with JSON columns, and read again."""
    path = f"{scratch_folder(spark)}/nouns"
    tabular.write_csv(tokens.noun_table(tokens.tokenised(_said(spark, sf), tokens.regex_analyser)), path)
    back = tabular.read_csv(spark, path)
    return back.select("rid", F.col("title_token_noun").alias("title_nouns"), F.size(nested.parse_string_list(F.col("comment_token_noun"))).cast("bigint").alias("n_comment_nouns"))


@query("one_comment_table", "SELECT text AS comment_content, turn::INT AS comment_like FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def one_comment_table(spark, sf):
    c = _said(spark, sf)
    first = c.agg(F.min("rid")).first()[0]
    return tokens.comment_table(c, first).select("comment_content", F.col("comment_like").cast("int").alias("comment_like"))


# --- plans


@query("chart_points", f"""WITH {POSTS_SQL}, c AS (SELECT section, lang, count(*) AS n FROM posts GROUP BY ALL)
  SELECT 'posts' AS chart, '' AS series, section::VARCHAR AS x, sum(n)::DOUBLE AS y FROM c GROUP BY section
  UNION ALL SELECT 'langs', lang, section::VARCHAR, round(n / sum(n) OVER (PARTITION BY section), 6) FROM c""")
def chart_points(spark, sf):
    p = posts(spark, sf)
    shares = stats.share_table(p, "lang", ["section"])
    counted = p.groupBy("section").agg(F.count("*").alias("n"))
    return relate.union_all(charts.bars("posts", counted, "section", "n"), charts.bars("langs", shares, "section", "ratio", "lang").withColumn("y", F.round("y", 6)))


@query("preprocess_run")
def preprocess_run(spark, sf):
    """Posts cleaned, freed of near-duplicates, saved and loaded again: rows of both files, and the report."""
    base = scratch_folder(spark)
    raw = posts(spark, sf).select("rid", "title", F.col("doc").alias("content"), F.col("section").cast("string").alias("section"), F.lit("20240203").alias("date"))
    run = preprocess.preprocess(raw)
    preprocess.save(run, f"{base}/posts", f"{base}/log")
    kept, log = preprocess.load_results(spark, f"{base}/posts", f"{base}/log")
    sized = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    return relate.union_all(run.report, sized(kept, "saved posts"), sized(log, "saved log"))


@query("cluster_terms_by_section")
def cluster_terms_by_section(spark, sf):
    """The heaviest terms of the clusters that K-means finds in each section alone."""
    p = materialised(posts(spark, sf).select("rid", "section", text.words(F.col("doc")).alias("tokens")))
    return ml.cluster_terms_by_section(p, [1, 2, 3, 4])


@query("refresh_posts")
def refresh_posts(spark, sf):
    """Posts without comment columns, whose pages are parsed again."""
    from .streaming.ingest import refresh

    u = F.concat(F.lit("https://blog.naver.com/b/"), F.col("page_id").cast("string"))
    pages = table(spark, sf, "pages").select(u.alias("url"), "html")
    old = normalize.backfill_columns(table(spark, sf, "pages").select(u.alias("url"), u.alias("canonical_url"), F.lit("2").alias("comment_count"), F.lit("t").alias("title")))
    return refresh(old, pages).select("canonical_url", "title", "comment_count", "comment_times")
