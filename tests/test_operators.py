"""Operators against brute force on small frames."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import urls
from lectern.operators import dedupe, filters, ml, normalize, pages, relate, stats, tfidf, tokens
from lectern.plans import analysis, charts, preprocess, progress
from lectern.sources import tabular, words
from lectern.streaming import ingest


def titled(rng, n):
    rows = []
    for i in range(n):
        base = rng.choice(["the quick brown fox jumps over it", "lorem ipsum dolor sit amet once", ""])
        rows.append((i, rng.choice(["a", "b", None]), "".join(c if rng.random() > 0.12 else rng.choice("xyz") for c in base), "2024-01-01", 1))
    return rows


def brute_greedy(rows, least):
    kept, log, groups = {}, [], []
    for i, t, d, *_ in rows:
        if t not in kept:
            kept[t] = []
            groups.append(t)
        hit = next(((j, x) for j, e in kept[t] if (x := dedupe.ratio(d, e)) >= least), None)
        if hit:
            log.append((i, hit[0], round(hit[1], 4)))
        else:
            kept[t].append((i, d))
    return [i for t in groups for i, _ in kept[t]], log


@pytest.mark.parametrize(("seed", "block"), [(1, 500), (2, 7)])
def test_near_duplicates_match_the_sequential_rules(spark, monkeypatch, seed, block):
    monkeypatch.setattr(dedupe, "BLOCK", block)
    rows = titled(random.Random(seed), 90)
    df = spark.createDataFrame(rows, "rid long, title string, doc string, date string, section int")
    kept, log = dedupe.drop_similar(df, 0.75)
    wanted, wanted_log = brute_greedy(rows, 0.75)
    assert [r.rid for r in kept.orderBy("group_rid", "rid").collect()] == wanted
    got = sorted((r.removed_index, r.kept_index, r.similarity) for r in log.collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(wanted_log)] and all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(got, sorted(wanted_log), strict=True))
    gone = {b for a, t, d, *_ in rows for b, u, e, *_ in rows if a < b and t is not None and t == u and dedupe.ratio(d, e) >= 0.75}
    assert sorted(r.rid for r in dedupe.drop_any_similar(df, 0.75).collect()) == [r[0] for r in rows if r[0] not in gone]


def test_bounds_never_fall_below_the_ratio():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.choice([5, 60, 199, 200, 250, 900])
        letters = "abcdefgh      " + "".join(map(chr, range(0x4E00, 0x4E00 + rng.choice([1, 40]))))
        a = "".join(rng.choice(letters) for _ in range(n))
        b = list(a)
        for _ in range(rng.choice([0, 3, 40, 300])):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(letters) * rng.randint(0, 3)
            b = b or ["x"]
        b = "".join(b)
        for autojunk in (True, False):
            assert dedupe._most(dedupe._Text(a), dedupe._Text(b), autojunk) >= dedupe.ratio(a, b, autojunk) - 1e-12


def test_pairs_of_a_block_are_those_of_the_plain_matcher(monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("etaoin shrdlu ETAOIN.,é가") for _ in range(n)) for n in (3, 40, 150, 260, 700, 1500)]
    texts = []
    for t in base * 6:
        t = list(t)
        for _ in range(rng.choice([0, 1, len(t) // 12, len(t) // 7, len(t) // 4])):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "YZ", "Q"])
        texts.append("".join(t) or "x")
    runs, one = [], dedupe._ratio_from
    monkeypatch.setattr(dedupe, "_ratio_from", lambda *a: runs.append(1) or one(*a))
    found = 0
    for kept_second in (True, False):
        for autojunk in (True, False):
            wanted = {(a, b, dedupe.ratio(*((texts[b], texts[a]) if kept_second else (texts[a], texts[b])), autojunk)) for b in range(len(texts)) for a in range(b)}
            wanted = {w for w in wanted if w[2] >= 0.8}
            for places in (7, 4096):
                rows = dedupe._Rows(list(range(len(texts))), texts, places)
                assert set(dedupe._similar(rows, rows, 0.8, kept_second, autojunk)) == wanted
                x, y = (dedupe._Rows(list(range(len(texts)))[k::2], texts[k::2], places) for k in (0, 1))
                assert set(dedupe._similar(x, y, 0.8, kept_second, autojunk)) == {w for w in wanted if (w[0] + w[1]) % 2}
            found += len(wanted)
    assert found > 100


def test_matcher_of_long_texts_finds_the_same_blocks(monkeypatch):
    from difflib import SequenceMatcher

    rng = random.Random(8)
    for n, letters in ((30, "ab"), (300, "abcdefgh XYZ"), (700, "".join(map(chr, range(200, 330))))):
        for _ in range(8):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = a[n // 2 :] + a[: n // 3] if rng.random() < 0.3 else "".join(c for c in a if rng.random() < 0.9)
            for autojunk in (True, False):
                for long in (0, 10_000):
                    monkeypatch.setattr(dedupe, "LONG", long)
                    assert dedupe._Matcher(None, a, b, autojunk).get_matching_blocks() == SequenceMatcher(None, a, b, autojunk).get_matching_blocks()
                    assert dedupe._ratio_from(dedupe._Matcher(None, a, b, autojunk), 0.0) == SequenceMatcher(None, a, b, autojunk).ratio()


def test_few_pairs_are_left_to_the_matcher(monkeypatch):
    """Texts of one language with capitals, as in German: the bound of blocks once left most of them."""
    rng = random.Random(6)
    words_ = ["".join(rng.choice("enisratdhulcg") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words_).capitalize() if rng.random() < 0.5 else rng.choice(words_) for _ in range(300)) for _ in range(40)]
    runs, one = [], dedupe._ratio_from
    monkeypatch.setattr(dedupe, "_ratio_from", lambda *a: runs.append(1) or one(*a))
    rows = dedupe._Rows(list(range(40)), texts, 8192)
    assert dedupe._similar(rows, rows, 0.8, True, True) == [] and len(runs) < 20


def test_copies_of_a_title_make_no_pairs(spark, monkeypatch):
    made = []
    real = dedupe.similar_pairs
    monkeypatch.setattr(dedupe, "similar_pairs", lambda *a: made.append(real(*a)) or made[-1])
    text = "one two three four " * 20
    rows = [(i, "t" if i % 2 else None, text if i % 5 else text + "five", "", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "rid long, title string, doc string, date string, section int")
    kept, log = dedupe.drop_similar(df, 0.8)
    assert sorted(r.rid for r in kept.collect()) == [0, 1] and made[0].count() == 2
    assert {(r.removed_index % 2, r.kept_index) for r in log.collect()} == {(0, 0), (1, 1)} and log.count() == 1998
    assert dedupe.drop_any_similar(df, 0.8).count() == 1000 + 1


def test_quantiles_match_exact_ones(spark):
    rng = random.Random(9)
    values = [("a", rng.choice([rng.random(), 0.5, float(rng.randint(0, 3))])) for _ in range(30_000)] + [("b", 1.0), ("b", 3.0), ("c", None), (None, 2.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    shares = {"low": 0.0, "x": 0.013, "q1": 0.25, "m": 0.5, "top": 0.999, "most": 1.0}
    got = {r.g: r for r in stats.quantiles(df, "v", shares, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        exact = np.quantile([v for h, v in values if h == g and v is not None], list(shares.values()))
        assert [got[g][k] for k in shares] == pytest.approx(exact.tolist())
    assert stats.plot_cap(df.limit(0), "v").first().cap == 1.0
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        stats.box_stats(df, "v", "g").explain()
    assert "percentile(" not in plan.getvalue()


def test_groups_of_quantiles_are_not_dealt_to_one_task(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 2.0)], "g string, v double")
    for made, small in ((stats.describe(df, ["v"]), 1), (stats.box_stats(df, "v", "g"), 0)):  # describe also joins its two results
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            made.explain()
        assert "BroadcastHashJoin" in plan.getvalue() and plan.getvalue().count("SortMergeJoin") == small


def test_stand_in_of_the_analyser_runs_without_python(spark):
    comments = [("a b_2", 1, ""), (None, 2, ""), (" ", 3, "")]
    rows = [(1, 1, 0, 3, None, "Ein Wort, é1!", comments), (2, 1, 0, 0, "", " ", [])]
    df = spark.createDataFrame(rows, "rid long, section int, like long, comment_cnt long, title string, doc string, comment_list array<struct<comment_content:string,comment_like:long,comment_date:string>>")
    made = tokens.tokenised(df, tokens.regex_analyser)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        made.explain()
    assert "Python" not in plan.getvalue()
    slow = tokens.tokenised(df, lambda: tokens.regex_analyser())
    assert made.orderBy("rid").collect() == slow.select(made.columns).orderBy("rid").collect()


def test_tokens_leave_the_worker_in_pieces():
    import pandas as pd

    texts = pd.Series(["x" * 100_000] * 7 + [None, "a b"])
    out = list(tokens.in_pieces(iter([texts, texts[:0]]), lambda t: (t or "").split(), lambda t: len(t or "")))
    assert [v for s in out for v in s] == [(t or "").split() for t in texts]
    assert [len(s) for s in out] == [2, 2, 2, 3, 0]


def test_only_whole_entities_of_pages(spark):
    from lectern.functions import text as cleaners

    row = spark.createDataFrame([("&amp;quot; &quot;x&amp;y &copy &amp",)], "t string")
    got = row.select(cleaners.named_entities(F.col("t"), {"quot": '"', "amp": "&"})).first()[0]
    assert got == '&quot; "x&y &copy &amp'


def test_ratio_cases():
    assert (dedupe.ratio("", ""), dedupe.ratio("", "a"), dedupe.ratio("abc", "abc")) == (1.0, 0.0, 1.0)
    long = "x".join(str(i) for i in range(150))
    assert dedupe.ratio(long, long + "yy", autojunk=False) > 0.99


def test_weights_match_the_formula(spark):
    import math

    docs = {1: "a b b c", 2: "b c d", 3: "e"}
    df = spark.createDataFrame([(i, w) for i, t in docs.items() for w in t.split()], "rid long, keyword string")
    got = {(r.rid, r.keyword): r.tfidf for r in tfidf.tfidf(df, ["rid"]).collect()}
    n_of = {w: sum(w in t.split() for t in docs.values()) for w in "abcde"}
    for i, t in docs.items():
        raw = {w: t.split().count(w) * (math.log(4 / (1 + n_of[w])) + 1) for w in set(t.split())}
        size = math.sqrt(sum(x * x for x in raw.values()))
        for w, x in raw.items():
            assert got[i, w] == pytest.approx(x / size)
    vocab = ml.vocabulary(df, "rid", 1, 1.0)
    assert vocab == list("abcde")
    rows = spark.createDataFrame([(i, t.split()) for i, t in docs.items()], "rid long, tokens array<string>")
    for r in ml.vectors(rows, vocab).collect():
        assert [got.get((r.rid, w), 0.0) for w in vocab] == pytest.approx(list(r.features.toArray()))


def test_a_vocabulary_of_any_size_is_whole(spark):
    n = (1 << 18) + 1000
    df = spark.range(n).selectExpr("id as rid", "concat('w', id) as keyword")
    vocab = ml.vocabulary(df, "rid", 1, 1.0)
    assert len(vocab) == n and vocab == sorted(vocab)
    rows = spark.createDataFrame([(1, [vocab[-1], vocab[5], vocab[-1], "none"])], "rid long, tokens array<string>")
    held = ml.vectors(rows, vocab, weighted=False).first().features
    assert (held.size, held.indices.tolist(), held.values.tolist()) == (n, [5, n - 1], [1.0, 2.0])
    assert [r.keyword for r in ml.matrix_terms(spark, np.eye(1, n, n - 1), vocab, "topic", 2).orderBy("rank").collect()] == [vocab[-1], vocab[0]]


def test_concentration_of_nothing_is_null(spark):
    posts = spark.createDataFrame([(1, 1), (2, 2)], "rid long, section int")
    words_ = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "b")], "rid long, section int, keyword string")
    got = {r.section: r for r in tokens.section_metrics(posts, words_).collect()}
    assert got[1].hhi_top20 == pytest.approx(5 / 9) and (got[2].noun_count, got[2].hhi_top20) == (0, None)


def test_tagging(spark):
    df = spark.createDataFrame([(1, "새 제목", "본문 a", [("댓글 둘", 1, "d"), ("", 0, "d")])], "rid long, title string, doc string, comment_list array<struct<comment_content:string,comment_like:bigint,comment_date:string>>")
    out = tokens.tokenised(df, tokens.regex_analyser)
    r = out.first()
    assert r.title_token_noun == ["제목"] and r.doc_token_verb == [] and r.comment_token_noun == [["댓글"], []]
    assert [(c.post_idx, c.comment_idx, c.comment_text, c.comment_token_noun) for c in tokens.comment_rows(out).collect()] == [(1, 0, "댓글 둘", ["댓글"]), (1, 1, "", [])]


POST = """<html><head><meta property="og:title" content="글 제목 : 네이버 블로그"><meta property="naverblog:nickname" content="쓴이"></head><body>
<div id="_post_property" commentcount="12" adddate="1704067200000"></div>
<div class="se-main-container"><p>짧음</p></div><div class="se-main-container"><p>이것은 충분히 긴 본문입니다.</p><script>var x = "안 보임";</script> 그리고 더 있습니다 &amp; 끝<br>줄</div>
<li class="u_likeit_list like"><span class="u_likeit_list_count">1,204</span></li>
<ul><li class="u_cbox_comment"><div class="u_cbox_comment_box"><span class="u_cbox_contents">첫 <b>댓글</b></span><span class="u_cbox_date" data-value="2024-01-02T03:04:05+0900">어제</span>
<a class="u_cbox_btn_recomm" style="display: none"><em class="u_cbox_cnt_recomm">9</em></a><a class="u_cbox_btn_recomm"><em class="u_cbox_cnt_recomm">3</em></a></div></li>
<li class="u_cbox_comment"><div class="u_cbox_comment_box"><span class="u_cbox_contents"> </span></div></li>
<li class="u_cbox_comment"><div><div class="u_cbox_comment_box"><span class="u_cbox_contents">안쪽</span></div></div></li>
<li class="u_cbox_comment"><div class="u_cbox_comment_box"><span class="u_cbox_contents">둘째</span><span class="u_cbox_date">오늘</span></div></li></ul></body></html>"""


def test_posts_out_of_pages(spark):
    got = pages.parse_post(POST)
    assert (got["title"], got["writer"], got["post_date"], got["post_like_count"], got["comment_count"]) == ("글 제목", "쓴이", "20240101", 1204, 12)
    assert got["content"] == "이것은 충분히 긴 본문입니다. 그리고 더 있습니다 & 끝 줄"
    assert (got["comments_text"], got["comment_times"], got["comment_like_counts"]) == ("첫 댓글 || 둘째", "2024-01-02T03:04:05+0900 || 오늘", "3 || 0")
    assert pages.parse_post(None)["content"] == "" and pages.parse_post("<p>" * 50_000)["title"] == ""
    assert pages.parse_post('<script>{"commentCount" : 7}</script>')["comment_count"] == 7
    assert pages.parse_post("<button class='x comment_btn_y'><span class='a num b'>1 5</span></button>")["comment_count"] == 15
    assert pages.parse_post(POST, most_comments=1)["comments_text"] == "첫 댓글"
    assert pages.parse_pages(spark.createDataFrame([("u", POST), ("v", None)], "url string, html string")).count() == 2


def test_encoding_is_told_from_whole_files(spark, tmp_path):
    rows = "".join(f"{i},plain\n" for i in range(200_000))  # two megabytes before the first letter that tells
    (tmp_path / "late.csv").write_bytes(("n,title\n" + rows + "7,제목\n").encode("cp949"))
    late = tabular.read_csv(spark, f"file://{tmp_path}/late.csv")
    assert late.count() == 200_001 and late.where("title = '제목'").count() == 1
    folder = tmp_path / "folder"
    folder.mkdir()
    for i, encoding in enumerate(("utf-8-sig", "cp949", "ascii")):
        (folder / f"{i}.csv").write_bytes(("n,title\n" + f"{i},{'plain' if encoding == 'ascii' else '제목'}\n").encode(encoding))
    got = {r.n: r.title for r in tabular.read_csv(spark, f"file://{folder}").collect()}
    assert got == {"0": "제목", "1": "제목", "2": "plain"}
    (tmp_path / "none.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        tabular.read_csv(spark, f"file://{tmp_path}/none.csv")


def test_csv_round_trip_in_all_encodings(spark, tmp_path):
    body = 'title,content\n"제목 ""하나""","줄\n둘 \\\\ 끝"\n'
    for name, encoding in (("a", "utf-8-sig"), ("b", "utf-8"), ("c", "cp949"), ("d", "euc-kr")):
        (tmp_path / f"{name}.csv").write_bytes(body.encode(encoding))
        row = tabular.read_csv(spark, f"file://{tmp_path}/{name}.csv").first()
        assert (row.title, row.content) == ('제목 "하나"', "줄\n둘 \\\\ 끝"), encoding
    assert tabular.read_csv_or_empty(spark, f"file://{tmp_path}/none.csv", "a int").count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert tabular.read_csv_or_empty(spark, f"file://{tmp_path}/empty.csv", "a int").columns == ["a"]
    df = spark.createDataFrame([("t", [("c", 1, None)])], "title string, comment_list array<struct<comment_content:string,comment_like:bigint,comment_date:string>>")
    tabular.write_csv(df, f"file://{tmp_path}/out")
    assert tabular.read_csv(spark, f"file://{tmp_path}/out").first().comment_list == '[{"comment_content":"c","comment_like":1,"comment_date":null}]'
    tabular.export_csv_utf8(df, str(tmp_path / "x" / "one.csv"))
    assert (tmp_path / "x" / "one.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert tabular.read_preferred(spark, f"file://{tmp_path}/no.parquet", f"file://{tmp_path}/b.csv")[1].endswith("b.csv")


def test_stop_word_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("﻿# note\n 가 \n\n나\n가\n", encoding="utf-8")
    path = f"file://{tmp_path}/s.txt"
    get = lambda d: sorted(r.keyword for r in d.collect())
    assert get(words.read_stopwords(spark, path)) == ["# note", "가", "나"]
    assert get(words.read_stopwords(spark, path, "drop")) == ["가", "나"]
    assert get(words.read_stopwords_raw(spark, path)) == ["", " 가 ", "# note", "가", "나"]
    layers = words.layered_stopwords(spark, [path], {2: path})
    tokens_ = spark.createDataFrame([(1, 1, "가"), (1, 2, "다")], "rid long, section int, keyword string")
    assert get(tokens.without_words(tokens_, layers)) == ["다"] and layers.count() == 4
    assert words.calendar(spark).count() == 547 and words.calendar(spark, most=3).count() == 3


def test_preprocessing_run(spark, tmp_path):
    rows = [("같은 제목!", "아주 긴 본문 하나 둘 셋 넷", "1", "2", '[{"text":"좋아요&amp;ㅋㅋ","like_count":"2","time":"2024-01-01"}]', "Blog", "1", "20240105"),
            ("같은 제목", "아주 긴 본문 하나 둘 셋 다섯", "0", "0", "", "cafe", "1", "20240106"), ("다른", "<b>본문</b>", "0", "0", "", "cafe", "", "20260101")]
    raw = spark.createDataFrame(rows, "title string, content string, like_count string, comment_count string, comments_json string, source string, section string, date string")
    for c in ("comments_text", "comment_times", "comment_like_counts"):
        raw = raw.withColumn(c, F.lit(""))
    out = preprocess.preprocess(raw, order=("date",))
    kept = out.posts.collect()
    assert [(r.title, r.ch, r.section, r.date) for r in kept] == [("같은 제목", "blog", 1, "2024-01-05")]
    assert kept[0].comment_list[0].comment_content == "좋아요"
    assert [(r.removed_index, r.kept_index) for r in out.duplicate_log.collect()] == [(1, 0)]
    assert [r.value for r in out.report.collect()] == [2, 1, 1, 1, 0, 1]
    assert out.preview.count() == 1
    preprocess.save(out, f"file://{tmp_path}/p", f"file://{tmp_path}/l")
    posts, log = preprocess.load_results(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/l")
    assert posts.count() == 1 == log.count()
    again = preprocess.preprocess(posts, order=("date",))
    assert [r.title for r in again.posts.collect()] == ["같은 제목"]


def test_analysis_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    posts = docs.select(F.col("doc_id").alias("rid"), F.col("text").alias("doc"), (F.col("doc_id") % 4 + 1).cast("int").alias("section"))
    out = analysis.analyse(posts, n_init=1, iterations=3, min_df=3)
    n = posts.where("doc <> ''").count()
    assert out.cluster_shares.agg(F.sum("doc_count")).first()[0] == n == out.topic_shares.agg(F.sum("doc_count")).first()[0]
    assert out.cluster_terms.count() == 45 and out.topic_terms.count() == 75
    assert out.cluster_terms.where("rank = 1").agg(F.sum("cluster_size")).first()[0] == n
    check = ml.probability_check(out.topics, 5).first()
    assert abs(check.least - 1) < 1e-6 and abs(check.most - 1) < 1e-6


def test_incremental_collecting(spark, tmp_path):
    page = lambda i: (f"https://blog.naver.com/b/{i}", POST.replace("글 제목", f"글 {i}"))
    path = lambda x: f"file://{tmp_path}/{x}"
    schema = "url string, html string"
    for urls in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([page(i) for i in urls] + [("https://other.example/x", "y")], schema).write.mode("append").parquet(path("in"))
        ingest.collect(spark, path("in"), path("posts"), path("state")).awaitTermination()
    got = spark.read.parquet(path("posts"))
    assert sorted(r.canonical_url[-1] for r in got.collect()) == ["1", "2", "3"]
    ingest.collect(spark, path("in"), path("posts"), path("state")).awaitTermination()
    assert spark.read.parquet(path("posts")).count() == 3
    old = got.drop("batch").withColumn("comment_times", F.when(F.col("canonical_url").endswith("1"), "").otherwise(F.col("comment_times"))).withColumn("writer", F.lit("?"))
    new = {r.canonical_url[-1]: r for r in ingest.refresh(old, spark.createDataFrame([page(1), page(2)], schema)).collect()}
    assert new["1"].comment_times.startswith("2024-01-02") and [new[k].writer for k in "123"] == ["쓴이", "?", "?"]
    o = ingest.Options(keywords=["의대 증원"])
    plan = ingest.searches(spark, o)
    assert plan.count() == 1094 and plan.first().links_wanted == 46


def test_schema_evolution_and_filters(spark):
    df = spark.createDataFrame([("https://blog.naver.com/a/1", "3", "d", None), ("x", "", "d", "s")], "url string, like_count string, date string, source string")
    out = normalize.backfill_columns(df, "site")
    assert [(r.canonical_url, r.post_like_count, r.search_date, r.source) for r in out.orderBy("url").collect()] == [("https://blog.naver.com/a/1", "3", "d", "site"), (None, "", "d", "s")]
    assert filters.with_url(out).count() == 1 and filters.with_keywords(df, ["a"]).count() == 2
    k = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "keyword string")
    assert filters.with_keywords(k, ["a"]).count() == 1 and filters.with_keywords(k, ["a"], blank_too=True).count() == 3
    assert normalize.with_defaults(k, like=0).columns == ["keyword", "like"]
    assert relate.union_sets(k, k).count() == 4
    top = spark.createDataFrame([(1, 0.5), (2, 0.5)], "rid long, ratio double")
    assert stats.max_per(top, "ratio", "rid", "m").first().m == 2


def test_collecting_stops_at_the_target(spark, tmp_path):
    base = f"file://{tmp_path}"
    page = lambda i: (f"https://blog.naver.com/b/{i % 30}", f'<meta property="og:title" content="t{i}"><div class="se-main-container">text {i}</div>')
    for part in range(3):
        spark.createDataFrame([page(10 * part + i) for i in range(20)], "url string, html string").write.mode("append").parquet(f"{base}/in")
        ingest.collect(spark, f"{base}/in", f"{base}/posts", f"{base}/state", ingest.Options(target=25)).awaitTermination()
        got = [r.canonical_url for r in spark.read.parquet(f"{base}/posts").collect()]
        assert len(got) == len(set(got)) == min(25, 20 + 10 * part)


def test_links_are_saved_after_each_day_up_to_the_target(spark, tmp_path):
    path = f"file://{tmp_path}/links"
    day = lambda d: (f"2024010{d}", spark.createDataFrame([(f"https://blog.naver.com/b/{d * 4 + i}", f"k{i}") for i in (0, 1, 2, 3, 4, 4)], "canonical_url string, keyword string"))
    assert ingest.save_links(day(1)[1], path, "20240101") == 5
    assert ingest.save_links(day(1)[1], path, "20240101") == 5  # a day that is run again
    seen = []
    days = ((seen.append(d), day(d))[1] for d in range(1, 9))
    assert ingest.collect_links(days, path, ingest.Options(target=6, link_multiplier=2.0)) == 12 and seen == [1, 2, 3]
    links = spark.read.parquet(path)
    assert links.count() == links.select("canonical_url").distinct().count() == 12


def test_links_with_entities_are_found(spark):
    html = '<a href="https:&#x2F;&#x2F;blog.naver.com&#47;abc&#x2F;77">x</a> "https:\\/\\/blog.naver.com\\/d\\/8"'
    got = spark.createDataFrame([(html,)], "h string").select(urls.extract_post_links(F.col("h")).alias("l")).first().l
    assert got == ["https://blog.naver.com/abc/77", "https://blog.naver.com/d/8"]


def test_tokens_of_a_recorded_analysis(spark):
    """Forms and tags as an analyser gives them: nouns of two letters or more, verbs and adjectives are told apart."""
    recorded = {
        "의사가 병원에 갔다": [("의사", "NNG"), ("가", "JKS"), ("병원", "NNG"), ("에", "JKB"), ("가", "VV"), ("었", "EP"), ("다", "EF")],
        "서울은 크고 물이 맑다": [("서울", "NNP"), ("은", "JX"), ("크", "VA"), ("고", "EC"), ("물", "NNG"), ("이", "JKS"), ("맑", "VA"), ("다", "EF")],
    }
    one, two = recorded
    df = spark.createDataFrame([(1, 2, 0, 2, one, two, [(one,), (None,)]), (2, 2, 0, 0, None, " ", [])], "rid long, section int, like int, comment_cnt int, title string, doc string, comment_list array<struct<comment_content:string>>")
    made = tokens.tokenised(df, lambda: lambda t: recorded[t])
    rows = {r.rid: r for r in made.collect()}
    assert (rows[1].title_token_noun, rows[1].title_token_verb, rows[1].title_token_adj) == (["의사", "병원"], ["가"], [])
    assert (rows[1].doc_token_noun, rows[1].doc_token_verb, rows[1].doc_token_adj) == (["서울"], [], ["크", "맑"])
    assert rows[1].comment_token_noun == [["의사", "병원"], []] and rows[2].doc_token_list == rows[2].title_token_noun == []
    assert [(r.comment_idx, r.comment_token_verb) for r in tokens.comment_rows(made).collect()] == [(0, ["가"]), (1, [])]
    assert [tuple(r) for r in tokens.noun_table(made).where("rid = 1").collect()] == [(1, 2, 0, 2, ["의사", "병원"], ["서울"], ["의사", "병원"])]


def test_exports_of_any_length_begin_with_a_mark(spark, tmp_path):
    df = spark.range(25_000).selectExpr("id", "concat('값, ', id) v", "array(id) a")
    tabular.export_csv_utf8(df, str(tmp_path / "one.csv"), rows_at_once=7000)
    lines = (tmp_path / "one.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0] == "id,v,a" and len(lines) == 25_001 and lines[-1] == '24999,"값, 24999",[24999]'
    tabular.write_csv(df, f"file://{tmp_path}/many")
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfid,") for p in (tmp_path / "many").glob("part-*"))
    assert tabular.read_csv(spark, f"file://{tmp_path}/many").columns == ["id", "v", "a"]


def test_chart_tables_and_progress(spark):
    box = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0, 6)], "g string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers long")
    assert {(r.chart, r.series, r.x, r.y) for r in charts.boxes("box", box, "g").collect()} >= {("box", "q1", "a", 1.0), ("box", "outliers", "a", 6.0)}
    sets = spark.createDataFrame([(1, 2, 3)], "only_a long, only_b long, both long")
    assert {(r.x, r.y) for r in charts.venn("venn", sets).collect()} == {("only_a", 1.0), ("only_b", 2.0), ("both", 3.0)}
    seen = progress.Counted(spark.range(1234), "rows")
    assert seen.df.selectExpr("sum(id)").first()[0] == 1233 * 617 and seen.rows == 1234


def test_command_line_collects_and_refreshes(spark, tmp_path):
    from lectern.__main__ import main

    base = f"file://{tmp_path}"
    rows = [(f"https://blog.naver.com/b/{i}", f'<meta property="og:title" content="t{i}"><div class="se-main-container">text {i}</div>') for i in range(6)]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{base}/in")
    paths = [f"{base}/in", f"{base}/posts", f"{base}/state"]
    main(["collect", *paths, "--target", "4"])
    assert spark.read.parquet(f"{base}/posts").count() == 4
    main(["collect", *paths, "--target", "5"])  # the rest of the same pages
    assert spark.read.parquet(f"{base}/posts").count() == 5
    main(["collect", *paths, "--no-resume"])
    assert spark.read.parquet(f"{base}/posts").count() == 6
    main(["refresh", f"{base}/posts", f"{base}/in", f"{base}/new", "--keywords", "k", "--keep-keywords"])
    assert spark.read.parquet(f"{base}/new").count() == 6
