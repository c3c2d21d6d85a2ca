"""Column functions on hand-written rows."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import nested, text, urls, values


def column(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_to_int(spark):
    rows = [None, "", " 12 ", "1,234", "7.0", "1.5", "12개", "-5", "abc", " ", "+3", "1.0.0"]
    assert column(spark, values.to_int, rows) == [0, 0, 12, 1234, 7, 15, 12, -5, 0, 0, 3, 10]
    assert column(spark, lambda c: values.parse_int(c, None), ["-5", "a1b2", "", None]) == [5, 12, None, None]
    assert column(spark, values.to_count, ["3.9", "-3.9", "x", None]) == [3, -3, 0, 0]


def test_dates(spark):
    rows = ["20240131", "20240131.0", "2024-01-31", "2024.01.31.", "2024-01-31T00:10:11+0900", "3시간 전", "20241301", None, "2024/1/5", "2024.02.30."]
    assert column(spark, values.normalize_date, rows) == ["2024-01-31"] * 5 + ["", "", "", "2024-01-05", ""]
    assert column(spark, values.day_of_millis, ["1704067200000", "x", None]) == ["20240101", "", ""]


def test_sections(spark):
    rows = [("2", None), ("1구간", None), ("0", "2024-03-31"), ("0", "20240401"), ("", "2024-12-31"), (None, "2025-06-30"), ("9", "2025-07-01"), ("0", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, d string")
    got = [r.y for r in df.select("i", values.normalize_section(F.col("s"), F.col("d")).alias("y")).orderBy("i").collect()]
    assert got == [2, 1, 1, 2, 3, 4, 0, 0]
    assert column(spark, values.map_channel, [" Naver BLOG", "네이버 카페", None, " X "]) == ["blog", "cafe", "", "x"]


def plain_noise(t):
    t = html.unescape(t)
    t = re.sub(r"(https?://\S+|www\.\S+)", " ", re.sub(r"<[^>]+>", " ", t))
    t = "".join(c if c.isascii() and (c.isalnum() or c.isspace()) or "가" <= c <= "힣" or c.isspace() else " " for c in t)
    return re.sub(r"\s+", " ", t).strip()


def test_cleaning_matches_plain_python(spark):
    rng = random.Random(4)
    parts = ["&amp;lt;b&gt;", "<b>굵게</b>", "http://a.b/c", "www.x", "\xa0", "　", "\x1c", "ㅋㅋㅋ", "ㅋ", "ㅠㅠ", "👨‍👩", "☀️", "\t", "\n", "가나", "abc", "1", "!", "<", ">", "\x85", " "]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(1500)] + [None, "", "!!!"]
    assert column(spark, text.clean_noise, rows) == [plain_noise(t or "") for t in rows]
    assert column(spark, text.clean_strict, ["a<b>b</b>ㅋhttps://x.y 끝! www.z", None]) == ["ab 끝 www z", ""]
    assert column(spark, text.remove_repeated_laughs, ["ㅋㅋㅋ하ㅋ", "ㅎㅎㅋㅋ"]) == [" 하ㅋ", "  "]
    assert column(spark, text.remove_emoji, ["a👨‍👩b☀️"]) == ["a b "]
    assert column(spark, text.clean_markup_text, ["a​&nbsp;b  c", None]) == ["a b c", ""]
    assert column(spark, lambda c: text.strip_title_suffix(c, "네이버 블로그"), ["제목 : 네이버 블로그 ", "x"]) == ["제목", "x"]
    assert column(spark, text.token_count, ["", " a  b ", None]) == [0, 2, 0]
    assert column(spark, lambda c: F.array_join(text.words(c), " "), ["Ab c de_1 é éa"]) == ["ab de_1 éa"]


def test_comments(spark):
    parse = lambda c: F.to_json(nested.parse_comments(c))
    rows = [None, "", "not json", '{"a":1}', "[]", '[{"comment_content":"a","comment_like":"3"}]']
    assert column(spark, parse, rows) == ["[]"] * 5 + ['[{"comment_content":"a","comment_like":"3"}]']
    built = lambda c: F.to_json(nested.build_comments(F.lit(None).cast("string"), c, F.lit("20240101 || x"), F.lit("1,000")))
    got = column(spark, built, ["a || b || c", None])
    assert got[0] == '[{"comment_content":"a","comment_like":1000,"comment_date":"2024-01-01"},{"comment_content":"b","comment_like":0,"comment_date":""},{"comment_content":"c","comment_like":0,"comment_date":""}]'
    assert got[1].startswith('[{"comment_content":"","comment_like":1000')
    strict = lambda c: F.to_json(nested.clean_comments_strict(c))
    assert column(spark, strict, ['[{"content":"x!"},{"comment_content":"ㅋ"},5]'])[0].startswith('[{"comment_content":"x","comment_like":0')
    normal = lambda c: F.to_json(nested.normalize_comments(nested.parse_comments(c)))
    assert column(spark, normal, ['[{"comment_content":" a ","comment_like":"2.0","comment_date":"2024.01.02."}]']) == ['[{"comment_content":"a","comment_like":2,"comment_date":"2024-01-02"}]']


def test_token_lists(spark):
    join = lambda f: lambda c: F.array_join(f(c), ",")
    assert column(spark, join(nested.flatten_mixed), ['[["a"],["b"]]', "['a','b']", '["a",["b","c"]]', "bad"]) == ["a,b", "a,b", "a,b,c", ""]
    assert column(spark, join(nested.parse_string_list), ["['a','b']", "", None]) == ["a,b", "", ""]
    keep = lambda c: nested.without(c, F.array(F.lit("x")), 2)
    assert column(spark, join(keep), [["x", "aa", "aa", "b"]], "array<string>") == ["aa,aa"]
    assert column(spark, join(nested.split_options), ["a, b|a,,c "]) == ["a,b,c"]
    assert column(spark, values.argmax, [[0.1, 0.5, 0.5]], "array<double>") == [1]
    assert values.quota(20_000, 2.5, 547, 1, 2, 40) == (50_000, 46)


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://blog.naver.com/abc/123", "https://blog.naver.com/abc/123"),
        ("http://m.blog.naver.com/abc/123?x=1#y", "https://blog.naver.com/abc/123"),
        ("//blog.naver.com/PostView.naver?blogId=a&amp;logNo=5", "https://blog.naver.com/a/5"),
        ("https:\\/\\/blog.naver.com\\/abc\\/9", "https://blog.naver.com/abc/9"),
        ("https://blog.naver.com/PostList.naver/1", None),
        ("https://blog.naver.com/abc", None),
        ("https://example.com/blog.naver.com/abc/1", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, wanted):
    assert column(spark, urls.canonical_post_url, [url]) == [wanted]


def test_other_urls(spark):
    assert column(spark, urls.to_mobile_url, ["https://blog.naver.com/a/1", "x"]) == ["https://m.blog.naver.com/a/1", "x"]
    page = '<a href="https://blog.naver.com/b/2">x</a> <div data-url="https://m.blog.naver.com/a/1"></div> "titleHref": "https:\\/\\/blog.naver.com\\/c\\/3" https://blog.naver.com/b/2'
    assert column(spark, lambda c: F.array_join(urls.extract_post_links(c), " "), [page]) == ["https://blog.naver.com/b/2 https://blog.naver.com/a/1 https://blog.naver.com/c/3"]


def test_allowed_characters_in_one_pass(spark):
    from lectern.functions import text

    rows = [("  a\x1c\u3000b\u00a0--\U0001f600ㅋ각 \t\n9é_Z\x0b ",), ("",), ("…",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    a, b = (df.select(c).collect() for c in (text.only_allowed(F.col("t")).alias("t"), text.collapse_ws(text.keep_allowed(F.col("t"))).alias("t")))
    assert a == b and a[0].t == "a b 각 9 Z"
