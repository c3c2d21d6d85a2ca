"""Fixed schemas of the data model."""

COMMENTS = "array<struct<comment_content:string,comment_like:bigint,comment_date:string>>"
LINK = "section string, date string, search_date string, search_sort string, keyword string, canonical_url string, url string"
#: Columns of a crawled post, in the order of its file.
CRAWLED = (
    "title content post_like_count like_count comment_count comments_text comment_times comment_like_counts comments_json "
    "url canonical_url keyword source section date search_date search_sort post_date writer"
).split()
RAW = ", ".join(f"{c} string" for c in CRAWLED)
#: Columns of a prepared post.
PREPARED = ["title", "doc", "like", "comment_cnt", "comment_list", "ch", "date", "section"]
PREPARED_DDL = f"title string, doc string, like bigint, comment_cnt bigint, comment_list {COMMENTS}, ch string, date string, section int"
DUPLICATE_LOG = "removed_index bigint, kept_index bigint, title string, similarity double, date string, section int"
#: Columns of a post that a new parse of its page replaces.
REPARSED = "post_like_count like_count comment_count comments_text comment_times comment_like_counts comments_json post_date writer".split()
