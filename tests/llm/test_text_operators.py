"""Per-text operators: personal data, toxicity, language, licences."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import language_id, licenses, pii, queries, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, label string, score double, n long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0.5, 7) for i, t in enumerate(texts)], DOCS)


# --- personal data


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns_on_random_text():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "@", ".", "1", "25", "300", " ", "-", "+", "_", "%", "(", ")", "é", "4587121519400672", "x.y", "\n"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


HOSTILE = [
    "a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1" + " " * 200_000, "1" * 100_000 + ".1" * 3, "1 " * 30_000,
    "token " * 50_000, "key=" * 50_000, "5551234567 " * 20_000, "a@b.cd then 5551234567 " * 5000, "token = a1b2c3d4e5f6a7b8c9d0 " * 5000,
    "".join(f"u{i}name@x.yz u{i}name +1555{i:07d} 555{i:07d} " for i in range(3000)),
]


def test_rules_take_linear_time_on_hostile_texts():
    for text in HOSTILE:
        pii.base_spans(text)
        pii.secret_spans(text)


def test_the_field_takes_linear_time_on_hostile_texts():
    field = pii.Field.fit([])
    for text in HOSTILE:
        began = time.perf_counter()
        pii.spans_of(text, field)
        assert time.perf_counter() - began < 30, text[:40]


FIT = ["Mail a.bcdef@mail.example.com or 10.0.0.1 or 4587121519400672 or +1 (555) 123-4567 now 12345 6 x7 and 2.0 of 1999"] * 30


def test_links_carry_labels_to_repetitions_and_leave_others_alone():
    field = pii.Field.fit(FIT)
    text = "Write to johnsmith77@mail.example.com. Later johnsmith77 said 12 4587121519400672 x; card 4587121519400672. Then 99999 99999."
    base, full = pii.spans_of(text, field)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in full if (s, k, e) not in base] == [("email", "johnsmith77"), ("card", "4587121519400672")]
    assert set(base) <= set(full)
    lone = "Numbers 4587121519400671 and 4587121519400671 again, 5551234567 twice 5551234567, version 300.1.1.1 of 2.0"
    assert pii.spans_of(lone, field) == ([], [])


def test_messages_change_what_shapes_alone_say():
    """Whole spans over several tokens, keys one edit apart, and numbers without their country code."""
    field = pii.Field.fit(FIT)
    alone = pii.Field(field.unary, field.chain, np.zeros(3))
    cases = [
        ("call +1 555 123 4567 now, or 15551234567 at night", [("phone", "15551234567")]),
        ("call +1 (555) 123-4567 now, or 555 123 4567 at night", [("phone", "555 123 4567")]),
        ("call +44 20 7946 0958 now, or 2079460958 at night", [("phone", "2079460958")]),
        ("card 4587121519400672 mistyped as 4587121519400673", [("card", "4587121519400673")]),
        ("anna.smith@mail.example.com wrote; then anna.smith left", [("email", "anna.smith")]),
        ("token = a1b2c3d4e5f6a7b8c9d0 was set, so a1b2c3d4e5f6a7b8c9d0 leaks", [("secret", "a1b2c3d4e5f6a7b8c9d0")] * 2),
        ("see build a1b2c3d4e5f6a7b8c9d0 and order 15551234567", []),
    ]
    for text, wanted in cases:
        base, full = pii.spans_of(text, field)
        assert [(pii.KINDS[k], text[s:e]) for s, k, e in full if (s, k, e) not in base] == wanted, text
        ruled = [x for x in wanted if x[0] == "secret"][:1]
        _, unlinked = pii.spans_of(text, alone)
        assert [(pii.KINDS[k], text[s:e]) for s, k, e in unlinked if (s, k, e) not in base] == ruled, text


def test_weights_of_links_follow_the_counts():
    agree = pii.Field.fit(["card 4587121519400672 or 4587121519400672 and 4587121519400672"] * 50)
    clash = pii.Field.fit(["10.20.30.40 is abcdefg@10203040.com and 10203040.abcdefg@x.yz"] * 50 + ["+45871215194 of 45871215194@mail.com"] * 400)
    assert agree.skip[0] > pii.Field.fit([]).skip[0] > clash.skip[0]


@pytest.mark.parametrize("times", [5, 20, 200])
def test_every_repetition_of_a_match_is_labelled(times):
    field = pii.Field.fit(FIT)
    for first, bare, kind in (("mail johnsmith77@mail.example.com", "johnsmith77", "email"), ("call +14155550123456 .", "14155550123456", "phone")):
        text = f"{first} and" + f" then {bare} was" * times
        base, full = pii.spans_of(text, field)
        assert len(base) == 1 and [(pii.KINDS[k], text[s:e]) for s, k, e in full[1:]] == [(kind, bare)] * times
        before = f"{bare} was then " * times + first
        assert len(pii.spans_of(before, field)[1]) == times + 1


def test_messages_match_enumeration_on_a_tree():
    rng = np.random.default_rng(2)
    k = pii.N_LABELS
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)) * 0.5, [1.5, 1.0, 0.5])
    n = pii.Nodes.__new__(pii.Nodes)
    n.shape, n.label, n.chain, n.skip = [(0, 3), (0, 5), (0, 9)], [0, 0, 0], [(0, 1)], [(1, 2, 0)]
    node = np.array([field.unary[list(f)].sum(0) for f in n.shape])
    joint = node[0][:, None, None] + node[1][None, :, None] + node[2][None, None] + field.chain[:, :, None] + (np.eye(k) * 1.5)[None]
    p = np.exp(joint) / np.exp(joint).sum()
    got = field.marginals(n, settled=1e-9)
    for axes, i in (((1, 2), 0), ((0, 2), 1), ((0, 1), 2)):
        assert np.allclose(got[i], p.sum(axes), atol=1e-6)


def test_pii_frames(spark):
    field = pii.Field.fit([])
    d = docs(spark, ["mail x.yz@ab.cd é", None, "", "mail x.yz@ab.cd é", "w " * 200_000 + "10.0.0.1"])
    rows = {r.doc_id: r for r in pii.find_pii(d, field).collect()}
    assert rows[0].spans == "email:5:15" and rows[3] == (3, *rows[0][1:]) and rows[1].spans == rows[2].spans == ""
    assert rows[4].spans == "ip:400000:400008" and rows[4].n_ip == 1
    done = {r.doc_id: r for r in pii.redact(d, field).collect()}
    assert done[0].text == "mail <EMAIL> é" and done[1].text is None and done[0].label == "x"
    assert pii.find_pii(d.limit(0), pii.fit_field(d.limit(0))).count() == 0
    assert pii.redact_text("abcdef", [(1, 0, 3), (2, 2, 4)]) == "a<EMAIL>ef"


# --- toxicity


def test_toxicity_finds_held_out_and_misspelt_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "no", "ri", "tel", "san", "ko"]) for _ in range(rng.randint(1, 4)))
    bad = ["grumpfox", "zlokvard"]
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    toxic = [" ".join([word() for _ in range(59)] + [rng.choice(bad)]) for _ in range(300)]
    model = toxicity.fit_model(toxic[:200], clean[:200])
    assert np.mean([model.score(t) >= 0.5 for t in toxic[200:]]) > 0.97
    assert np.mean([model.score(t) >= 0.5 for t in clean[200:]]) < 0.05
    assert model.score(" ".join(word() for _ in range(5000)) + " zlokvaard") >= 0.5
    d = docs(spark, [toxic[0], None, "", "!!", toxic[0]])
    rows = {r.doc_id: r for r in toxicity.score_toxicity(d, model).collect()}
    assert rows[0].predicted == 1 == rows[4].predicted and rows[1].score == rows[2].score == rows[3].score == 0.0
    assert [r.score for r in toxicity.score_toxicity(d, None).collect()] == [0.0] * 5
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


def test_bags_of_words_hold_their_ngrams():
    words = ["ab", "toxic", "é", "sixteenletterword"]
    bags = toxicity.Bags(words)
    value = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    means = bags.means(value[bags.buckets])
    for i, w in enumerate(words):
        assert means[i] == pytest.approx(toxicity.unit_means(toxicity._codes(w), value)[0][0])
        assert sorted(bags.buckets[bags.of(np.array([i]))]) == sorted(np.concatenate(toxicity._gram_ids(toxicity._codes(w))))


def test_unit_means_match_a_plain_loop():
    value = np.random.default_rng(0).normal(size=1 << toxicity.BITS)
    for text in ("a bc  def, ghijk!", "x", "é日本 no", "  "):
        c = toxicity._codes(text)
        mean, start, end = toxicity.unit_means(c, value)
        assert np.allclose(mean, [value[np.concatenate(toxicity._gram_ids(c[s - 1 : e + 1]))].mean() for s, e in zip(start, end, strict=True)])


def test_toxicity_query_accuracy(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert (held.toxic == held.predicted).mean() > 0.95 and got.score.between(0, 1).all()
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.03


def test_fits_take_a_bounded_sample_where_one_id_has_many_rows(spark, monkeypatch):
    took = {}
    monkeypatch.setattr(toxicity, "fit_model", lambda toxic, clean: took.update(toxic=len(toxic), clean=len(clean)))
    monkeypatch.setattr(language_id.Codes, "fit", classmethod(lambda cls, x, langs: took.update(langs=len(langs))))
    d = spark.range(20_000).selectExpr("if(id % 2 = 0, 7, id) doc_id", "concat('text ', id) text", "if(id % 3 = 0, 'a', 'b') lang")
    toxicity.fit_toxicity(d, spark.createDataFrame([(7, 1), (9, 0), (11, 0)], "doc_id long, toxic int"), fit_rows=100)
    language_id.fit_languages(d, per_language=50)
    assert took["toxic"] == 100 and took["clean"] == 2 and took["langs"] <= 100
    empty = language_id.fit_languages(spark.createDataFrame([(1, "12", "a")], "doc_id long, text string, lang string"))
    assert empty is None


# --- language


def test_language_query_accuracy(spark):
    got = queries.op8_language_id(spark, SF).toPandas()
    told = spark.read.parquet(f"{SF}/documents.parquet").toPandas().merge(got, on="doc_id")
    held = told[told.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.98
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]


def test_mixed_texts_are_flagged(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 200")
    codes = language_id.fit_languages(d.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = d.where("crc32(cast(doc_id as string)) % 4 = 2").select("doc_id", "lang", F.substring("text", 1, 400).alias("text"))
    a, b = held.where("lang = 'en'"), held.where("lang = 'es'").select(F.col("text").alias("other"), F.monotonically_increasing_id().alias("doc_id"))
    mixed = a.select(F.monotonically_increasing_id().alias("doc_id"), "text").join(b, "doc_id").select("doc_id", F.concat_ws(" ", "text", "other").alias("text"))
    flagged = lambda x: language_id.identify(x, codes).agg(F.avg(F.col("ambiguous").cast("int"))).first()[0]
    assert flagged(held) < 0.02 and flagged(mixed) > 10 * max(flagged(held), 0.01)


def test_language_cases(spark):
    train = spark.createDataFrame([(i, "the cat sat on the mat", "en") if i % 2 else (i, "der hund und die katze", "de") for i in range(40)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    codes = language_id.fit_languages(train)
    assert codes.languages == ["de", "en"]
    d = docs(spark, ["the mat", "und der", None, "", "123 !!", "the " * 100_000])
    rows = {r.doc_id: r for r in language_id.identify(d, codes).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert rows[2].score == 0 and 0 <= rows[0].score <= 1
    assert sorted(r.doc_id for r in language_id.keep_identified(d, codes, ambiguous_below=0.0).collect()) == [0, 1, 5]
    none = language_id.fit_languages(train.limit(0))
    assert none is None and {r.lang_pred for r in language_id.identify(d, none).collect()} == {"und"}
    assert language_id.identify(d.limit(0), codes).count() == 0


@pytest.mark.parametrize("k", [1, 2, 4, 5, 9])
def test_codewords_differ(k):
    code = language_id.codewords(k)
    assert len({tuple(r) for r in code.tolist()}) == k and set(np.unique(code)) <= {-1.0, 1.0}


# --- licences


def test_licence_scan_matches_a_plain_search():
    rng = random.Random(5)
    parts = ["Under", "the", "MIT", "License", "apache", "version", "2", "cc", "BY", "nc", "-", ",", "é", "x"]
    scanner = licenses.Scanner()
    for _ in range(5000):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(rng.randint(0, 30)))
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = scanner.scan(text.encode())
        starts = [i for i, _ in places]
        assert got[:5] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("mit or apache-2.0", ("mit or apache-2.0", {"mit", "apache-2"}, True)),
        ("(mit and gpl-3.0-only) or isc tail", ("(mit and gpl-3.0-only) or isc", {"mit", "gpl-3", "isc"}, True)),
        ("mit and gpl-2.0 with classpath-exception-2.0\nor mit", ("mit and gpl-2.0 with classpath-exception-2.0", {"mit", "gpl-2"}, False)),
        ("mit or (", ("mit", {"mit"}, True)),
        ("(mit or (gpl-3 and", ("(mit or (gpl-3", {"mit", "gpl-3"}, True)),
        ("odd-thing and mit", ("odd-thing and mit", {"mit"}, None)),
        ("gpl-3 and mit or bsd", ("gpl-3 and mit or bsd", {"gpl-3", "mit", "bsd"}, True)),
    ],
)
def test_expressions(text, wanted):
    said, value = licenses.parse_expression(text)
    assert (said, value["labels"], value["permissive"]) == wanted


def test_expression_needs_an_operand():
    assert licenses.parse_expression("and or )") is None and licenses.parse_expression("") is None


def test_licence_frames(spark):
    d = docs(spark, ["Under the MIT License. SPDX-License-Identifier: (BSD-3-Clause OR MIT)\nx", None, "", "w " * 300_000 + "CC BY-NC", "GNU General Public License, version 3."])
    rows = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert (rows[0].base_labels, rows[0].labels, rows[0].score, rows[0].expression, rows[0].permissive) == ("mit", "bsd,mit", 1.0, "(bsd-3-clause or mit)", True)
    assert (rows[1].n_words, rows[1].labels, rows[1].score, rows[1].first_word) == (0, "", 0.0, None) and rows[2][1:] == rows[1][1:]
    assert (rows[3].first_word, rows[3].n_words, rows[4].labels) == (300_000, 300_003, "gpl-3")
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_places_of_many_phrases_take_linear_time():
    scanner = licenses.Scanner()
    for n in (1000, 300_000):
        began = time.perf_counter()
        got = scanner.scan(b"cc by nc " * n + b"under the mit license")
        assert got[:6] == (3 * n + 4, n + 1, 0, 3 * n, "cc-by-nc,mit", "cc-by-nc,mit"), n
    assert time.perf_counter() - began < 20


def test_expressions_in_prose(spark):
    cases = {
        "Released under the MIT License. Or not": ("mit", True, "mit"),
        "Dual licensed under the MIT License or the Apache License, Version 2.0.": ("mit or apache-2", True, "apache-2,mit"),
        "licensed under the GNU General Public License version 2 and CC BY-NC 4.0": ("gpl-2 and cc-by-nc", False, "cc-by-nc,gpl-2"),
        "distributed under GNU Lesser General Public License, or something": ("lgpl", False, "lgpl"),
        "licensed under a strange rule": (None, None, ""),
        "under the mit license": (None, None, "mit"),
    }
    got = licenses.scan_licenses(docs(spark, list(cases))).orderBy("doc_id").collect()
    assert [(r.expression, r.permissive, r.labels) for r in got] == list(cases.values())


def test_licences_of_the_whole_table_are_parsed(spark):
    got = queries.op10_licenses(spark, SF).toPandas()
    licensed = got[got.labels != ""]
    assert len(licensed) and licensed.expression.notna().mean() > 0.5
