"""Operators over whole tables: mixing, join, neighbours, decontamination, chat, archives, pipeline."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import ann, chat, decontaminate, jaccard_join, mixing, oracles, queries, warc
from lectern.llm.common import CLEAN_UP, Scratch
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


# --- mixing


def plain_schedule(weights, blocks):
    """Slot by slot: of all released blocks the earliest deadline, then as the operator breaks ties."""
    total = sum(weights.values())
    share = {k: Fraction(w) / total for k, w in weights.items()}
    done, out, slot = dict.fromkeys(weights, 0), [], 0
    while any(done[k] < blocks[k] for k in weights):
        free = [k for k in weights if done[k] < blocks[k] and math.floor(done[k] / share[k]) <= slot]
        if free:
            k = min(free, key=lambda k: (math.ceil((done[k] + 1) / share[k]), ((done[k] + 1) / share[k]).denominator == 1, -share[k], k))
            out.append((k, done[k], slot))
            done[k] += 1
        slot += 1
    return out


def test_schedule_matches_a_plain_one():
    rng = random.Random(1)
    for _ in range(40):
        weights = {f"s{i}": Fraction(rng.randint(1, 30), 7) for i in range(rng.randint(1, 8))}
        blocks = {k: rng.randint(0, 40) for k in weights}
        assert list(mixing.schedule(weights, blocks)) == plain_schedule(weights, blocks)


def test_mix_keeps_all_rows_and_the_targets(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, 1) for i in range(6000)] + [(0, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, source string, mix_row int")
    got = mixing.mix(d, {"a": 0.5, "b": 0.3}, block_rows=4, range_rows=500).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows) and not got.duplicated(["mix_block", "mix_row"]).any()
    first = got[got.mix_block < 200].groupby(got.source.fillna("")).mix_block.nunique()
    assert abs(first["a"] - 100) <= 1 and abs(first["b"] - 60) <= 1 and abs(first[""] - 40) <= 1
    assert (got.groupby("mix_block").size() <= 4).all() and (got.groupby("mix_block").source.nunique(dropna=False) == 1).all()
    assert mixing.mix(d.limit(0)).count() == 0
    again = mixing.mix(d.repartition(7), {"a": 0.5, "b": 0.3}, block_rows=4, range_rows=500).toPandas()
    key = ["doc_id", "mix_block", "mix_row"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))


@pytest.mark.parametrize("n", [3, 1500])
def test_schedule_stays_within_one_block_of_the_exact_targets(n):
    rng = random.Random(n)
    weights = {"third": 0.3333, "rare": 0.0001} | {f"s{i}": rng.random() ** 3 + 1e-6 for i in range(n)}
    scale = (1 - 0.3334) / sum(list(weights.values())[2:])
    weights = {k: w if k in ("third", "rare") else w * scale for k, w in weights.items()}
    total = sum(map(Fraction, weights.values()))
    slots = 300_000 if n == 3 else 20_000
    blocks = {k: math.ceil(w * slots) + 2 for k, w in weights.items()}
    taken = -1
    for name, k, slot in mixing.schedule(weights, blocks):
        assert slot > taken  # one block in a slot
        taken = slot
        share = Fraction(weights[name]) / total
        # after the block's slot k + 1 are done, before it k: both within one block of the share
        assert k + 1 - share * (slot + 1) < 1 and share * slot - k < 1 and share * (slot + 1) - k <= 1


def test_mix_holds_more_than_1000_sources_to_their_targets(spark):
    rows = [(i, f"s{i % 1200}") for i in range(12_000)] + [(12_000 + i, "big") for i in range(12_000)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(d, {"big": 0.3333}, block_rows=4, range_rows=500).toPandas()
    assert sorted(got.doc_id) == list(range(24_000)) and not got.duplicated(["mix_block", "mix_row"]).any()
    assert (got.groupby("mix_block").source.nunique() == 1).all() and (got.groupby("mix_block").size() <= 4).all()
    big = sorted(set(got[got.source == "big"].mix_block))
    assert len(big) == 3000 and all(abs(k - 0.3333 * slot) <= 1 for k, slot in enumerate(big))
    after = mixing.mix(d, {"big": 1.0}, block_rows=4).toPandas()
    assert len(after) == 24_000 and after[after.source == "big"].mix_block.max() == 2999 == after[after.source != "big"].mix_block.min() - 1


# --- join


def brute_components(rows, words, num):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(set(jaccard_join.shingle_hashes((text or "").encode(), words).tolist()))
    ids, root, links = sorted(sets), {i: i for i in sets}, defaultdict(set)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                links[i].add(j)
                links[j].add(i)
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), len(links[i])) for i in ids}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, monkeypatch, words, num):
    """Families of near copies larger than a block, a shared passage, short texts, ties and repeated rows."""
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "FEW_IDS", 0 if words == 3 else 100_000)
    rng = random.Random(words)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    texts = [edited(rng, base, rng.randint(0, 5)) for _ in range(70)]
    texts += [" ".join(passage + [f"w{rng.randrange(400)}" for _ in range(rng.choice([10, 200]))]) for _ in range(40)]
    texts += [edited(rng, [f"q{k}_{i}" for i in range(rng.randint(9, 90))], rng.randint(0, 2)) for k in range(8) for _ in range(5)]
    texts += ["a b", "A  b\t", "a b c", "c", "c", "", " \n", None, "a b c d e f", "a b c d e f g", " ".join(["same"] * 500), " ".join(["same"] * 9000)]
    texts += texts[:12]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "a b", "y")], "doc_id long, text string, n string").repartition(5)
    got = jaccard_join.similar_components(d, words, num, 100).collect()
    wanted = brute_components(rows, words, num)
    assert {r.doc_id: (r.component_id, r.n_links) for r in got if r.doc_id is not None} == wanted
    assert len(got) == len(rows) + 1 and [r.component_id for r in got if r.doc_id is None] == [None]


def test_different_texts_with_one_id_both_stay(spark):
    one, two, far = (" ".join(f"{x}{i}" for i in range(40)) for x in ("a", "b", "c"))
    rows = [(1, one, "p"), (2, one, "q"), (2, two, "r"), (3, far, "s"), (3, far + " end", "t"), (3, far, "s"), (4, "short", "u"), (4, "other", "v"), (None, one, "w"), (None, one, "w")]
    want = [("1", "p"), ("2", "r"), ("3", "s"), ("4", "u"), ("4", "v"), ("None", "w"), ("None", "w")]
    for parts in (1, 7):
        d = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(parts)
        assert sorted((str(r.doc_id), r.n) for r in jaccard_join.one_of_each(d).collect()) == want


def test_join_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    d = spark.createDataFrame([(3, text, "p"), (1, text, "q"), (1, text, "q"), (2, "other words", "r"), (4, "", "s"), (5, None, "t"), (None, text, "u")], "doc_id long, text string, n string")
    assert sorted((str(r.doc_id), r.n) for r in jaccard_join.one_of_each(d).collect()) == [("1", "q"), ("2", "r"), ("4", "s"), ("5", "t"), ("None", "u")]
    assert jaccard_join.similar_components(d.limit(0)).count() == 0


def test_frequent_table_is_bounded_and_never_changes_results(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda rows: sorted((r.doc_id, r.component_id, r.n_links) for r in rows)
    assert key(jaccard_join.similar_components(d, frequent=20).collect()) == key(jaccard_join.similar_components(d).collect())


# --- neighbours


def brute_nearest(ids, x, queries_, k):
    out = {}
    for q in queries_:
        s = ann.exact_cosine(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_neighbours_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = queries.op5_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    p = e.toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding).astype(float)
    wanted = brute_nearest(ids, x, np.flatnonzero(ids % 50 == 0), 5)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert all(len(v) == 5 for v in found.values()) and set(found) == set(wanted)
    assert sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted) >= 0.9 * 5 * len(wanted)
    at = {i: k for k, i in enumerate(ids)}
    for q, v in found.items():
        assert v == sorted(v, key=lambda t: (-t[1], t[0]))
        for i, s in v:
            assert s == pytest.approx(float(ann.exact_cosine(x[at[q]][None], x[at[i]][None])[0]), abs=1e-12)


def test_neighbours_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1), (6, [inf, 1.0], 1), (7, [1.0, 1.0, 1.0], 1), (8, [3.0, 0.0], 1), (8, [3.0, 0.0], 1), (50, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(d, "vec_id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 8, 0.0)]
    assert ann.nearest(d.limit(0), "vec_id % 50 = 0").count() == 0


def test_a_very_common_vector_is_cut_into_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 0.0, 0.5, 0.25] if i % 3 else rng.normal(size=4).tolist()) for i in range(3000)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = np.arange(3000), np.array([v for _, v in rows])
    wanted = brute_nearest(ids, x, [i for i in range(0, 3000, 50) if i % 3], 5)
    got = defaultdict(list)
    for r in ann.nearest(d, "vec_id % 50 = 0", block_rows=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(got[q] == [i for i, _ in v] for q, v in wanted.items())


def test_parts_are_balanced():
    x = ann.normalised(np.random.default_rng(1).normal(size=(1000, 8)))
    graph = ann.neighbour_graph(x)
    part = ann.balanced_parts(graph, x, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.15 * 1000 / 8)
    assert (part[graph] == part[:, None]).mean() > 0.3  # 1 in 8 by chance


# --- decontamination


def test_decontamination_cases(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    words = item.split()
    long = " ".join(f"x{i}" for i in range(30_000))
    texts = {
        1: f"{long} {item.upper()}! {long}",  # whole, in a long text
        2: " ".join(words[:20]),  # 16 of 20 shingles
        3: " ".join(words[:19]),  # 15 of 20
        4: f"{' '.join(words[:12])} gap {' '.join(words[12:])}",  # a gap costs 4
        5: "tiny two", 6: "one tiny two three", 7: None, 8: "", 9: "!!",
    }
    d = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(2, texts[2], 1), (None, item, 1)], "doc_id long, text string, q int")
    b = spark.createDataFrame([(10, item), (11, "Tiny, two"), (12, ""), (13, None), (14, "!"), (None, item), (10, item)], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained(d, b, broadcast_rows=limit).collect()}
        assert got == {(1, 10): (20, 20), (2, 10): (16, 20), (4, 10): (16, 20), (5, 11): (1, 1), (6, 11): (1, 1)}
    left = decontaminate.decontaminate(d, b)
    assert left.columns == ["doc_id", "text", "q"] and sorted(str(r.doc_id) for r in left.collect()) == ["3", "7", "8", "9", "None"]
    assert decontaminate.contained(d, b.limit(0)).count() == 0 == decontaminate.contained(d.limit(0), b).count()
    assert decontaminate.decontaminate(d, b.limit(0)).count() == d.count()


# --- chat


def test_chat_cases(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"),
            (4, 5, "user", "a"), (4, 6, "assistant", "b"), (4, 7, "user", "c"), (5, 0, "user", "b"), (6, 0, "user", "a"), (6, 1, "user", "b"),
            (7, 0, None, None), (7, 0, None, None), (8, 0, "bad <|im_start|>", "x<|im_end|>"), (None, 0, "user", "a")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.render_chats(d).collect()}
    assert set(got) == {3, 5, 6, 7, 8} and got[3].n_copies == 2 and got[3].n_turns == 3
    assert got[3].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[7].chat == "<|im_start|>user\n<|im_end|>\n" and got[8].chat.count("<|im_end|>") == 1 == got[8].chat.count("<|im_start|>")
    assert chat.render_chats(d.limit(0)).count() == 0


def test_a_long_chain_of_snapshots_leaves_the_longest(spark):
    rows = [(n, t, "user", f"turn {t}") for n in range(1, 40) for t in range(n)]
    got = chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(39, 39)]


# --- archives


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (2**60 + 1, None, big), (3, "u", None), (4, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", "x")]
    rows += [(100 + i, "u", f"{i} " * 3000) for i in range(4)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").coalesce(1)
    index, scratch = warc.archive(d)
    got = {r.page_id: r for r in warc.read_archive(index).collect()}
    assert set(got) == {r[0] for r in rows} and (got[None].record_type, got[None].payload_bytes) == ("response", 1)
    assert [(got[i].record_type, got[i].refers_to) for i in (2, 5, 2**60 + 1)] == [("response", None), ("revisit", 2), ("revisit", 2)]
    assert {got[i].payload_bytes for i in (2, 5, 2**60 + 1)} == {len(big.encode())} and got[3].payload_bytes == got[4].payload_bytes == 0
    assert got[6].record_type == got[7].record_type == "response"
    assert got[2].url == "http://b X: y" and got[2**60 + 1].url is None
    files = index.groupBy("file").count().collect()
    assert len(files) > 1
    # every member stands alone, and members fill the file
    for f in files:
        at = 0
        with warc._open(f.file, "r") as s:
            for r in sorted((r for r in index.collect() if r.file == f.file), key=lambda r: r.offset):
                assert r.offset == at
                head, payload = warc.read_record(s, r.offset, r.length)
                assert head["warc-record-id"].strip("<>") == r.record_id and head["warc-type"] == r.record_type
                if head["warc-type"] == "response":
                    assert len(payload) == int(head["x-payload-length"])
                at += r.length
            assert at == s.size()
    empty, _ = warc.archive(d.limit(0))
    assert warc.read_archive(empty).count() == 0


def test_streams_of_several_members_and_torn_ones(tmp_path):
    one, two = warc.record(1, None, "d", b"x" * 3_000_000, 3_000_000, None), warc.record(2, "u", "d", None, 5, 1)
    gz = lambda b: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + z.flush()
    (tmp_path / "a.gz").write_bytes(gz(one) + gz(two + one))
    rows = list(warc.normalise_file(f"file://{tmp_path}/a.gz", f"file://{tmp_path}/b.gz"))
    assert [r[4] for r in rows] == ["response", "revisit", "response"]
    for torn in (gz(one[:-10]), gz(one)[:-8], gz(two) + gz(one)[:-8], gz(two) + gz(one)[:4]):
        (tmp_path / "c.gz").write_bytes(torn)
        with pytest.raises(ValueError):
            list(warc.normalise_file(f"file://{tmp_path}/c.gz", f"file://{tmp_path}/d.gz"))
    # cut at the end of a record, within the stream
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "c.gz").write_bytes(z.compress(one) + z.flush(zlib.Z_SYNC_FLUSH))
    with pytest.raises(ValueError):
        list(warc.normalise_file(f"file://{tmp_path}/c.gz", f"file://{tmp_path}/d.gz"))


def test_pages_without_an_id_are_kept(spark):
    big = "x" * 200
    rows = [(None, "u", big), (4, "u", big), (9, "u", big), (None, "u", big * 2), (None, "v", big * 2)]
    index, _ = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read_archive(index).collect())
    assert got == [("4", 200, "response", "None"), ("9", 200, "revisit", "4"), ("None", 200, "revisit", "4"), ("None", 400, "response", "None"), ("None", 400, "response", "None")]


# --- pipeline


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34", "en", "src0", 5), (10**6 + 1, None, "en", "src0", 0), (10**6 + 2, docs.first().text + " tail.", "en", "src0", 9)], docs.schema)
    docs = docs.unionByName(extra)
    kept = corpus_pipeline.language(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} >= {10**6, 10**6 + 1}
    assert kept.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    wanted = {i for i, (root, _) in brute_components(rows, 5, 80).items() if root == i}
    assert {r.doc_id for r in one.collect()} == wanted and 10**6 + 2 not in wanted and one.schema == docs.schema
    clean = corpus_pipeline.benchmark_leaks(spark, one, SF)
    from tests.oracle import connect

    hit = {r[0] for r in connect(SF).execute(oracles.OP6).fetchall()}
    assert {r.doc_id for r in clean.collect()} == wanted - hit
    safe = corpus_pipeline.personal_data(spark, clean, SF)
    assert safe.schema.names == docs.schema.names and safe.count() == clean.count()
    assert all("@" not in r.text or "." not in r.text.split("@", 1)[1][:30] for r in safe.collect())
    mixed = corpus_pipeline.source_mix(spark, safe, SF)
    assert mixed.columns == [*docs.columns, "mix_block", "mix_row"] and mixed.count() == safe.count()


# --- cases of repeated ids, chains, ties, clashing names


def test_texts_of_one_id_share_a_component(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in ("a", "b"))
    rows = [(3, one), (4, two), (5, one), (5, two), (5, two), (6, two + " end"), (7, "else")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in jaccard_join.similar_components(d, 3, 90, 100).collect()}
    assert got == {(3, 38): (3, 1), (4, 38): (3, 2), (5, 38): got[5, 38], (6, 39): (3, 2), (7, 1): (7, 0)} and got[5, 38][0] == 3
    rng = random.Random(11)
    base = [[f"{k}w{rng.randrange(300)}" for _ in range(60)] for k in range(12)]
    rows = [(rng.randrange(60), edited(rng, rng.choice(base), rng.randint(0, 2))) for _ in range(150)]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(set(jaccard_join.shingle_hashes(t.encode(), 3).tolist()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {(r.doc_id, r.component_id) for r in got} == {(i, find(i)) for i in sets} and len(got) == len(rows)


def chain(n, words=60, seed=1):
    """Texts each of which replaces one word of the one before."""
    rng, now, out = random.Random(seed), [f"s{i}" for i in range(words)], []
    for i in range(n):
        now[rng.randrange(words)] = f"n{i}"
        out.append((i, " ".join(now)))
    return out


def test_work_on_a_chain_grows_with_its_length(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    made = {}
    real = jaccard_join.Scratch.write

    def write(self, df, name):
        out = real(self, df, name)
        if name in ("pairs", "placed", "links"):
            made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "write", write)
    for n in (5000, 20_000):
        rows = chain(n)
        got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
        sets = [set(jaccard_join.shingle_hashes(t.encode(), 3).tolist()) for _, t in rows]
        alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
        links = Counter(x for i in range(n) for j in range(i + 1, min(i + 8, n)) if alike(i, j) for x in (i, j))
        first = list(range(n))
        for i in range(1, n):
            first[i] = next((first[j] for j in range(i - 1, max(-1, i - 8), -1) if alike(i, j)), i)
        assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (first[i], links[i]) for i in range(n)}
    assert all(large < 5 * small for small, large in made.values())  # four times the documents


def test_sketches_rule_out_no_similar_sets():
    """pairs on the border of the threshold, of sizes around a power of two, whose sketches may have to be folded."""
    rng = np.random.default_rng(5)
    for num in (80, 90):
        similar = jaccard_join.Similarity(num, 100)
        sets = []
        for n in (1, 2, 9, 63, 64, 65, 120, 129, 500, 513, 1024, 1030, 5000):
            u = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            more = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            for k in sorted({0, similar.slack(n) // 2, similar.slack(n), n // 2}):
                sets += [np.unique(u[k:]), np.unique(np.concatenate([u[k:], more[: k // 2]])), np.unique(np.concatenate([u, more[:k]]))]
        sizes = np.array([len(s) for s in sets])
        every, sketches = np.arange(len(sets)), [jaccard_join.sketch(s) for s in sets]
        linked = np.zeros((len(sets), len(sets)), bool)
        for x in every:
            for y in every[:x]:
                common = len(np.intersect1d(sets[x], sets[y]))
                linked[x, y] = linked[y, x] = common and 100 * common >= num * (sizes[x] + sizes[y] - common)
        for x in every:
            in_x, in_y = jaccard_join.likely(similar, sketches, sizes, every[x : x + 1], every)
            assert not (linked[x] & ~in_y).any() and in_x[x] >= linked[x].any()
    assert linked.sum() > 100
    far = [rng.integers(0, 1 << 63, 700, dtype=np.uint64) for _ in range(60)]
    assert not any(v.any() for v in jaccard_join.likely(similar, [jaccard_join.sketch(s) for s in far], np.full(60, 700), np.arange(30), np.arange(30, 60)))


def test_whole_sets_are_moved_only_to_likely_partners(spark, monkeypatch):
    """what many texts have in common brings them together, but only similar ones are verified."""
    monkeypatch.setattr(jaccard_join, "FEW_IDS", 0)
    rng = random.Random(7)
    common = [" ".join(f"c{k}_{i}" for i in range(40)) for k in range(3)]
    texts = [f"{common[k % 3]} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for k in range(400)]
    texts += [edited(rng, t.split(), 1) for t in texts[:20]]
    moved, real = [], jaccard_join.map_groups

    def map_groups(df, keys, f, schema):
        if "set" in df.columns and "rep" in df.columns:
            moved.append(df.count())
        return real(df, keys, f, schema)

    monkeypatch.setattr(jaccard_join, "map_groups", map_groups)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.similar_components(d, 3, 90, 100, frequent=0).collect()  # as when more are frequent than the table tells apart
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == brute_components(list(enumerate(texts)), 3, 90)
    assert 40 <= moved[0] <= 60  # 20 pairs


def test_shuffle_files_of_a_write_go_with_it(spark):
    """they stayed until the driver collected its garbage."""
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    assert spark.conf.get(CLEAN_UP) == "false"
    seen = []
    for tidy in (False, True):
        scratch = Scratch(spark, tidy=tidy)
        before = held()
        scratch.drop(scratch.write(spark.range(20_000).repartition(7, "id"), "x"))
        time.sleep(1)
        seen.append(held() - before)
    assert seen[0] > 0 >= seen[1] and spark.conf.get(CLEAN_UP) == "false"


def test_turns_of_one_number_go_by_role_and_text(spark):
    rows = [(1, 0, "user", t) for t in "hgfedcba"] + [(1, 0, None, "z"), (1, 0, "a", "y"), (1, 0, "user", None), (1, 0, "user", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.render_chats(d).collect()
    said = [x.split("\n", 1) for x in got[0].chat.replace("<|im_start|>", "").split("<|im_end|>\n")[:-1]]
    assert said == [["user", "z"], ["a", "y"], ["user", ""], ["user", ""], *[["user", t] for t in "abcdefgh"]]


def test_snapshots_match_brute_force(spark):
    rng = random.Random(6)
    turns = []
    for c in range(120):
        n, seed = rng.randint(1, 6), rng.randrange(6)
        for t in range(n):
            turns.append((c, t, "user" if t % 2 == 0 else None, f"{seed}-{t}" if t < 4 or rng.random() < 0.5 else f"x{c}"))
    whole = defaultdict(list)
    for c, _, role, text in turns:
        whole[c].append((role or "user", text))
    first = {}
    for c in sorted(whole):
        first.setdefault(tuple(whole[c]), c)
    kept = {c: k for k, c in first.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in first)}
    got = {r.conv_id: r for r in chat.render_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert set(got) == set(kept) and 0 < len(kept) < len(first)
    assert all(got[c].n_turns == len(k) and got[c].n_copies == sum(tuple(v) == k for v in whole.values()) for c, k in kept.items())


def test_vectors_of_any_finite_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (4, [-1e-300, -1e-300])]
    got = [(r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4] and np.allclose([s for _, s in got], [1, 0.5**0.5, 0.5**0.5, -1], atol=1e-15)


@pytest.mark.parametrize("n", [3, 700])
def test_a_query_finds_as_many_rows_as_there_are(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] + rng.normal(0, 0.01, 8)).tolist()) for i in range(n)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.nearest(d, "vec_id % 50 = 0", k=120, recall=0.01).collect())
    assert got == {i: min(120, n - 1) for i in range(0, n, 50)}


def test_extra_columns_may_have_any_name(spark):
    text = " ".join(f"w{i}" for i in range(50))
    names = "_key key gone part held at hit _bit _w _m _id line nth first own _source _h _range _i _k _parts _place _before _slot _slots row PART".split()
    names = [n for i, n in enumerate(names) if n.lower() not in [x.lower() for x in names[:i]]]
    rows = [(3, text, "s"), (1, text, "s"), (1, text, "s"), (2, "other words", "t"), (2, "more", "t"), (None, text, None)]
    d = spark.createDataFrame([(*r, *[f"{r[0]}{n}" for n in names]) for r in rows], ", ".join(["doc_id long, text string, source string", *[f"{n} string" for n in names]]))
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = jaccard_join.one_of_each(d)
    clean = decontaminate.decontaminate(d, b)
    mixed = mixing.mix(d)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "None"] and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "2", "None"]
    for out in (kept, clean, mixed):
        assert out.columns[: len(d.columns)] == d.columns
        assert all(r[n] == f"{r.doc_id}{n}" for r in out.collect() for n in names)
    assert mixed.count() == 6


def test_shared_folders_are_needed_off_one_machine(spark, monkeypatch):
    from lectern.llm import common

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


WORDS = {"en": "the cat sat on a mat and saw this dog with that bird", "de": "der hund und die katze sind nicht im haus mit dem vogel"}


def small_corpus(spark, folder):
    """Documents with nulls, empty and long texts, copies, leaks, personal data and repeated rows."""
    rng = random.Random(8)
    item = " ".join(f"w{i}x" for i in range(30))
    said = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "er"]) for _ in range(n))
    rows = [(i, said(lang, rng.randint(20, 60)), lang, f"src{i % 3}", 0) for i in range(80) for lang in ("en" if i % 2 else "de",)]
    rows += [(100, None, "en", "src0", 0), (101, "", "en", None, 0), (102, "12 34", None, "src1", 0), (103, rows[5][1] + " end", "en", "src2", 0), (104, rows[5][1], "en", "src2", 0)]
    rows += [(105, said("en", 20) + f" {item} " + said("en", 20), "en", "src0", 0), (106, said("en", 30) + " mail jo.doe@ab.example.com or +1 555 555 0100 now", "en", "src0", 0)]
    rows += [(107, said("de", 20_000), "de", "src1", 0), (3, rows[3][1], "en", "src0", 0), (None, said("en", 40), "en", "src1", 0)]
    d = spark.createDataFrame([(*r, "keep me") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `_key` string")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_the_whole_pipeline_on_a_small_corpus(spark, tmp_path):
    folder = f"file://{tmp_path}"
    small_corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows]
    gone = {100, 101, 102, 103, 104, 105}
    assert sorted(i for i in ids if i is not None) == sorted({r.doc_id for r in docs.collect() if r.doc_id is not None} - gone) and ids.count(None) == 1
    assert rows[0].asDict().keys() == {*docs.columns, "mix_block", "mix_row"} and {r["_key"] for r in rows} == {"keep me"}
    text = next(r.text for r in rows if r.doc_id == 106)
    assert "<EMAIL>" in text and "<PHONE>" in text and "@" not in text
    assert all(r.n_chars == len(r.text) for r in rows) and len({(r.mix_block, r.mix_row) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path, name):
    folder = f"file://{tmp_path}"
    small_corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and set(docs.columns) <= set(empty.columns)
    out = stage(spark, docs, folder).collect()
    assert {r["_key"] for r in out} == {"keep me"}
    lost = Counter(r.doc_id for r in docs.collect()) - Counter(r.doc_id for r in out)
    assert lost == {"language": {100: 1, 101: 1, 102: 1}, "near_duplicates": {103: 1, 104: 1, 3: 1}, "benchmark_leaks": {105: 1}}.get(name, {})


# --- shared parts


def test_filters_of_ids_lose_none(spark):
    from lectern.llm.common import maybe_among

    d = spark.range(20_000).selectExpr("if(id % 100 = 7, null, id) id", "'x' held", "id part")
    ids = spark.range(0, 20_000, 50).selectExpr("id k").unionAll(spark.sql("select cast(null as long)"))
    inside = {r.id for r in maybe_among(d, "id", ids, 400).collect()}
    outside = [r.id for r in maybe_among(d, "id", ids, 400, among=False).collect()]
    wanted = set(range(0, 20_000, 50))
    assert wanted <= inside and len(inside) < 600 and None not in inside
    assert not wanted & set(outside) and len(inside) + len(outside) == 20_000 and outside.count(None) == 200
    assert maybe_among(d, "id", ids.limit(0), 0).count() == 0 and maybe_among(d.limit(0), "id", ids, 400).count() == 0


@pytest.mark.parametrize("kind", ["path", "star", "random", "cliques"])
def test_components_of_graphs(spark, kind):
    from lectern.llm.common import Scratch
    from lectern.llm.components import components

    rng = random.Random(kind)
    name = list({rng.randrange(-(2**62), 2**62) for _ in range(1600)})[:1500]
    edges = {
        "path": [(i, i + 1) for i in range(1000)],
        "star": [(700, i) for i in range(1500)],
        "random": [(rng.randrange(1500), rng.randrange(1500)) for _ in range(900)],
        "cliques": [(10 * k + i, 10 * k + j) for k in range(100) for i in range(8) for j in range(8)],
    }[kind]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in ((name[a], name[b]) for a, b in edges if a != b):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    d = spark.createDataFrame([(name[a], name[b]) for a, b in edges], "u long, v long").repartition(3)
    got = [(r.node, r.root) for r in components(d, Scratch(spark)).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)


def test_rows_leave_alike_whether_ids_are_few_or_many(spark, monkeypatch):
    from lectern.llm import common

    d = spark.range(3000).selectExpr("if(id % 100 = 7, null, id) id", "'x' held", "id part")
    gone = spark.range(0, 3000, 5).selectExpr("id k")
    for few in (100_000, 10):
        monkeypatch.setattr(common, "FEW_IDS", few)
        got = [r.part for r in common.without(d, "id", gone, 600).collect()]
        assert sorted(got) == [i for i in range(3000) if i % 100 == 7 or i % 5]
