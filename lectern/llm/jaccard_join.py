"""N-gram Jaccard join by grouped prefixes: exact components of documents with similar shingle sets.

1. Every text becomes its set of shingles, as 64-bit hashes. Texts with equal
   sets are one class, represented by its smallest id.
2. Shingles get a global order: rare ones by hash, frequent ones after them by
   the logarithm of their count. Counts are exact for a sixteenth of all
   shingles; of the rest, those frequent within a task's chunk are counted. At
   most `FREQUENT` shingles are told apart as frequent (a bounded table); the
   order is the same for all documents whatever it holds, so results don't
   depend on it, only speed does.
3. The prefix of a set of size n are its first n - ceil(t n) + l(n) shingles in
   that order, l(n) = 1 + (n - ceil(t n)) // 2. Two sets with similarity t share
   at least min(l, l') shingles of their prefixes. Classes with the same size
   and prefix collapse into one group.
4. Shingles that several prefixes hold form buckets; groups with fewer of them
   than any partner would need are filtered out. A group's home is its largest
   bucket, so similar groups mostly have the same home, and a bucket holds few
   homes, however many groups. Pairs of homes are filtered by the sizes of their
   groups and by the number of buckets they share: natively from buckets of few
   homes; in those of many, by matrix products within blocks of their groups. So
   no bucket emits the pairs of its groups.
5. Homes are expanded to their groups' members and cut into blocks, and the tasks
   are every pair of blocks of one home, and a home's blocks with the smaller
   homes paired with it. First sketches go there, one to two bits for each shingle: the
   parities of the number of shingles by hash. Two sets differ in as many
   shingles as their sketches do in bits, or more, so pairs that differ too much
   go without loss. Whole sets of what is left are verified exactly in the same
   tasks, from which a forest and each member's number of links go on. So whole
   sets are moved to tasks where they have a likely partner only. A chain of
   documents, each similar to the next few, has few pairs of homes, so its work
   grows with its length; a family of n texts that are all similar has n^2 / 2
   links to count, in blocks.
6. Components of the verified links, and of the texts of one id, are the result.

Each hash has 64 bits; in a corpus of 10^9 shingles two different ones share a
hash with a probability of 3 in 100, and a verdict changes only if that falls on
the boundary of a pair.

Defined results: a text without words is empty, has size 0 and links with
nothing (not even another empty text); a null id gives a null component; rows
with the same id and set count once; different texts with one id share a
component, and each counts its own links (an id linked by two of its texts
counts once for each); extra columns are ignored; an empty table gives an empty
result. No cap on partners, buckets or group sizes: larger ones are cut into
more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_IDS, Scratch, map_batches, map_groups, maybe_among, named, spare, texts, without
from .components import components

#: Most shingles that are told apart as frequent: 16 bytes each go to the driver and back to every task.
FREQUENT = 1 << 18
#: Exact counts are taken of shingles whose hash lies below this, a sixteenth of the range.
COUNTED_BELOW = np.uint64(1 << 60)
#: Shingles of a chunk; of those outside the counted part, the ones that occur CHUNK_LEAST times in it are counted.
CHUNK, CHUNK_LEAST = 1 << 20, 4
#: Homes of a bucket up to which their pairs are formed natively; members of a block.
SMALL_BUCKET, BLOCK = 24, 800
#: Shingles of a block of members, on average: long texts make smaller blocks.
BLOCK_SHINGLES = 1 << 20

_WORD = xxhash.xxh64_intdigest


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; of fewer words, of the whole sequence.

    A-Z is lower-cased; words are separated by ASCII white space.
    """
    ws = raw.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORD, ws), np.uint64, len(ws))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


class Similarity:
    """A threshold num/den of the Jaccard similarity, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den or 2 * num < den:
            raise ValueError("the threshold must lie between one half and one")
        self.num, self.den = num, den

    def slack(self, n):
        return n - -(-self.num * n // self.den)

    def shared(self, n):
        """l(n): prefix shingles that a set of size n shares with any similar set that isn't smaller."""
        return 1 + self.slack(n) // 2

    def prefix(self, n):
        return self.slack(n) + self.shared(n)

    def smallest(self, n):
        """The smallest size that a similar set can have."""
        return -(-self.num * n // self.den)

    # the same as SQL over columns
    def sql_shared(self, n: str) -> str:
        return f"(1 + ({n} - ({self.num} * {n} + {self.den - 1}) div {self.den}) div 2)"

    def sql_smallest(self, n: str) -> str:
        return f"(({self.num} * {n} + {self.den - 1}) div {self.den})"


def _count_chunks(words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            some = (u < COUNTED_BELOW) | (c >= CHUNK_LEAST)
            return pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(c[some])], ["h", "n"])

        for b in batches:
            for raw in texts(b.column(0)):
                held.append(shingle_hashes(raw, words))
                n += len(held[-1])
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return go


class Order:
    """The global order of shingles."""

    def __init__(self, frequent: np.ndarray, level: np.ndarray):
        self.frequent, self.level = frequent, level

    def keys(self, u: np.ndarray) -> np.ndarray:
        """Places in the order: the level in the top bits, the hash below."""
        key = u >> np.uint64(6)
        if len(self.frequent) and len(u):
            at = np.minimum(np.searchsorted(self.frequent, u), len(self.frequent) - 1)
            key |= np.where(self.frequent[at] == u, self.level[at], 0).astype(np.uint64) << np.uint64(58)
        return key


def global_order(docs: DataFrame, words: int, scratch: Scratch, most: int = FREQUENT) -> Order:
    """Levels of at most `most` frequent shingles: all with at least c texts, for the least c > 2 that fits."""
    counts = map_batches(docs.select("text"), _count_chunks(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    kept = scratch.write(counts, "counts")
    # how many shingles have each leading bits of a count: at most 512 rows
    coarse = F.expr("shiftleft(shiftright(n, greatest(0, cast(floor(log2(n)) as int) - 3)), greatest(0, cast(floor(log2(n)) as int) - 3))")
    sizes = sorted(((r.c, r.k) for r in kept.groupBy(coarse.alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for c, k in sizes:
        total += k
        if total > most:
            break
        least = c
    h, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if least is not None:
        got = kept.where(F.col("n") >= least).toArrow()
        h, n = got["h"].to_numpy(), got["n"].to_numpy()
    scratch.drop(kept)
    level = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) + 1, 31).astype(np.uint8)
    order = np.argsort(h.view(np.uint64))
    return Order(h.view(np.uint64)[order], level[order])


NODES = "doc_id long, n long, s1 long, s2 long, g long, sketch binary, prefix array<long>"
#: Fewest bits of a sketch.
LEAST_BITS = 64


def _signature(u: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed numbers."""
    s1 = (u * np.uint64(0xD6E8FEB86659FD93) ^ (u >> np.uint64(32))).sum(dtype=np.uint64)
    s2 = np.bitwise_xor.reduce(u * np.uint64(0xA0761D6478BD642F), initial=np.uint64(0))
    return int(np.uint64(s1).view(np.int64)), int(np.uint64(s2).view(np.int64))


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n shingles: the power of two from n on."""
    return max(LEAST_BITS, 1 << (n - 1).bit_length()) if n else 0


def sketch(u: np.ndarray) -> bytes:
    """For each bit, whether an odd number of hashes falls on it."""
    m = sketch_bits(len(u))
    return np.packbits(np.bincount((u & np.uint64(max(m, 1) - 1)).astype(np.int64), minlength=m) & 1).tobytes() if m else b""


def likely(similar: Similarity, sketches: list[bytes], n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets numbered x, and which of those numbered y, have a partner among the others that sketches and sizes don't rule out.

    Similar sets have sketches of one size or one twice the other's, which is then folded.
    """
    bits = np.array([8 * len(s) for s in sketches], np.int64)
    unpacked = {m: np.unpackbits(np.frombuffer(b"".join(s for s in sketches if 8 * len(s) == m), np.uint8)).reshape(-1, m) for m in np.unique(bits).tolist()}
    place = np.zeros(len(bits), np.int64)
    for m in unpacked:
        place[bits == m] = np.arange((bits == m).sum())
    in_x, in_y = np.zeros(len(n), bool), np.zeros(len(n), bool)
    for m in unpacked:
        for mx, my in ((m, m), (m, 2 * m), (2 * m, m)):
            a, b = x[bits[x] == mx], y[bits[y] == my]
            if not len(a) or not len(b):
                continue
            rows = []
            for ids, own in ((a, mx), (b, my)):
                r = unpacked[own][place[ids]]
                rows.append((r if own == m else r[:, :m] ^ r[:, m:]).astype(np.float32))
            differ = rows[0].sum(1)[:, None] + rows[1].sum(1)[None] - 2 * (rows[0] @ rows[1].T)
            na, nb = n[a][:, None], n[b][None]
            may = differ * (similar.den + similar.num) <= (similar.den - similar.num) * (na + nb)
            may &= (np.minimum(na, nb) >= similar.smallest(np.maximum(na, nb))) & (a[:, None] != b[None])
            in_x[a[may.any(1)]] = True
            in_y[b[may.any(0)]] = True
    return in_x, in_y


def _nodes(words: int, similar: Similarity, order: Order):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, g, sketches, prefixes = [], [], [], [], [], []
            for raw in texts(b.column(1)):
                u = shingle_hashes(raw, words)
                signed = _signature(u)
                n.append(len(u))
                s1.append(signed[0])
                s2.append(signed[1])
                sketches.append(sketch(u))
                key = order.keys(u)
                prefixes.append(np.sort(key)[: similar.prefix(len(u)) if len(u) else 0])
                g.append(_WORD(prefixes[-1].tobytes()))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            groups = pa.array(np.array(g, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in (n, s1, s2)], groups, pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "n", "s1", "s2", "g", "sketch", "prefix"],
            )

    return go


Sets = tuple[np.ndarray, np.ndarray]  # all members one after another, and how many each set has


def common_counts(sets: Sets, a: np.ndarray, b: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets numbered a with those numbered b, by products of incidence matrices, some columns at a time."""
    flat, lengths = sets
    out = np.zeros((len(a), len(b)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    _, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    some = n[inverse] > 1
    row, column = row[some], (np.cumsum(n > 1) - 1)[inverse[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        lo, hi = np.searchsorted(column, [at, at + chunk])
        m = np.zeros((len(lengths), min(chunk, int(column[-1]) + 1 - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(m[a] @ m[b].T).astype(np.int64)
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest vertex that each vertex reaches in a symmetric matrix of links."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dealt(rows: DataFrame, member: str, size) -> DataFrame:
    """Rows of large groups dealt to pairs (i, j) of blocks: a row once for each block of its group."""
    rows = rows.withColumn("_b", F.ceil(size / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64(member), F.col("_b")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return rows.withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).drop("_b", "_o")


def _home_pairs(similar: Similarity):
    """The pairs of different homes that hold a pair of groups that passes, of one pair of blocks of a bucket."""

    def go(rows: pa.Table) -> pa.RecordBatch | None:
        i, j = (rows[c][0].as_py() for c in ("i", "j"))
        block, home, n = (rows[c].to_numpy() for c in ("block", "home", "n"))
        homes, of = np.unique(home, return_inverse=True)
        if len(homes) == 1:
            return None  # members of one home are compared anyway
        lists = rows["set"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        once = np.unique(np.stack([row, flat]), axis=1)
        distinct = np.bincount(once[0], minlength=len(lengths))
        lost = int((lengths - distinct).max())  # shingles of one group that clash
        most = np.bincount(of).argmax()  # the most common home is compared with the others only
        if i == j:
            a, b = np.flatnonzero(of != most), np.arange(len(n))
        else:
            a, b = np.flatnonzero(block == i), np.flatnonzero(block != i)
        if not len(a) or not len(b):
            return None
        common = common_counts((once[1], distinct), a, b)
        x, y = n[a][:, None], n[b][None]
        passes = (common + lost >= np.minimum(similar.shared(x), similar.shared(y))) & (np.minimum(x, y) >= similar.smallest(np.maximum(x, y)))
        passes &= of[a][:, None] != of[b][None]
        x, y = np.nonzero(passes)
        pair = np.unique(np.sort(np.stack([of[a[x]], of[b[y]]]), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(homes[pair[0]]), pa.array(homes[pair[1]])], ["a", "b"])

    return go


def _members_of_task(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Members of a task, each once, with their keys, and the numbers of those that are compared with each other: block i of home a with its block j, or with guests g."""
    key = np.stack([rows[c].to_numpy() for c in ("rep", "n", "s1", "s2")])
    _, first = np.unique(key, axis=1, return_index=True)  # rows that occur twice
    rows, key = rows.take(pa.array(first)), key[:, first]
    a, i, j, g = (rows[c][0].as_py() for c in ("a", "i", "j", "g"))
    own = rows["own"].to_numpy()
    # the block's own pairs are counted along with its first guests
    return rows, key, np.flatnonzero(own), np.arange(len(own)) if i == j and g == 0 else np.flatnonzero(~own)


#: Columns of a task's members: own tells those of block i of home a.
MEMBERS = "rep long, n long, s1 long, s2 long, copies long, a long, i int, j int, g int, own boolean"


def _likely_members(similar: Similarity):
    """The members of one task that may have a link there, by their sketches."""

    def go(rows: pa.Table) -> pa.RecordBatch | None:
        rows, key, x, y = _members_of_task(rows)
        if not len(x) or not len(y):
            return None
        in_x, in_y = likely(similar, rows["sketch"].to_pylist(), key[1], x, y)
        kept = rows.drop_columns(["sketch"]).filter(pa.array(in_x | in_y)).combine_chunks()
        return kept.to_batches()[0] if len(kept) else None

    return go


def _verify(similar: Similarity):
    """A forest of the links of one task, and each member's number of links in it."""

    def go(rows: pa.Table) -> pa.RecordBatch | None:
        rows, key, x, y = _members_of_task(rows)
        rep, n, copies = key[0], key[1], rows["copies"].to_numpy()
        flat = np.frombuffer(b"".join(rows["set"].to_pylist()), np.uint64)
        linked = np.zeros((len(n), len(n)), bool)
        if len(x) and len(y):
            common = common_counts((flat, n), x, y)
            part = common * (similar.den + similar.num) >= similar.num * (n[x][:, None] + n[y][None])
            linked[np.ix_(x, y)] = part
            linked[np.ix_(y, x)] |= part.T
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return None
        label = forest(linked[np.ix_(some, some)])
        order = np.argsort(rep[some], kind="stable")
        least = np.full(len(some), -1, np.int64)  # the smallest id of each tree
        least[label[order][::-1]] = rep[some][order][::-1]
        columns = [*key[:, some], least[label], (linked @ copies)[some]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "n", "s1", "s2", "v", "links"])

    return go


def _member_sets(words: int):
    """The whole sets of texts that are the members they were moved for."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = zip(*(b.column(k).to_pylist() for k in ("n", "s1", "s2")), strict=True)
            sets, fits = [], []
            for raw, (n, *signed) in zip(texts(b.column(0)), wanted, strict=True):
                u = shingle_hashes(raw, words)
                fits.append(len(u) == n and list(_signature(u)) == signed)
                sets.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *b.columns[1:]], ["set", *b.schema.names[1:]]).filter(pa.array(fits, pa.bool_()))

    return go


def similar_components(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents it links with) of every row.

    Two documents link when den * intersection >= num * union of their sets of
    `words`-word shingles; component_id is the smallest id that links reach.
    """
    spark = docs.sparkSession
    similar, scratch = Similarity(num, den), Scratch(spark, tidy=True)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = global_order(docs, words, scratch, frequent)
    full = scratch.write(map_batches(docs, _nodes(words, similar, order), NODES), "nodes")
    total = full.count()
    nodes = full.select("doc_id", "n", "s1", "s2", "g")
    known = nodes.where("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "s1", "s2", "g").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies"))

    # groups: classes with the same size and prefix; only ids are moved. Keys of the join are new to Spark, so that it can split a large group
    apart = lambda *names: [F.bitwise_not(c).alias(f"_{c}") for c in names]
    hubs = classes.groupBy("n", "g").agg(F.min("rep").alias("gid")).select(*apart("n", "g"), "gid")
    members = classes.select("*", *apart("n", "g")).join(hubs.hint("merge"), ["_n", "_g"])
    members = scratch.write(members.select("rep", "n", "s1", "s2", "copies", "gid"), "members")
    aside = known.select("doc_id", "n").join(members.where("rep = gid").select(F.col("gid").alias("doc_id"), "n"), ["doc_id", "n"], "left_anti")
    aside = scratch.write(aside.distinct(), "aside")
    whole = full.where("n > 0 and doc_id is not null").select("doc_id", "n", "prefix")
    ids, n_aside = aside.select("doc_id"), aside.count()
    if n_aside <= FEW_IDS:
        prefixes = whole.join(F.broadcast(aside), ["doc_id", "n"], "left_anti")
    else:  # only prefixes that may be of no group are moved
        # no left_anti join: Spark would push it below the filter and move all prefixes
        marked = aside.withColumn("_aside", F.lit(True))
        unsure = maybe_among(whole, "doc_id", ids, n_aside).join(marked, ["doc_id", "n"], "left").where("_aside is null").drop("_aside")
        prefixes = maybe_among(whole, "doc_id", ids, n_aside, among=False).unionByName(unsure)

    # buckets of shared prefix shingles: counts are partial sums, and only what may be shared is moved
    spread = prefixes.select(F.col("doc_id").alias("gid"), "n", F.explode("prefix").alias("tok"))
    sizes = scratch.write(spread.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = maybe_among(spread, "tok", sizes.select("tok"), sizes.count()).join(sizes.hint("merge"), "tok")
    index = shared.groupBy("gid", "n").agg(F.collect_set(F.struct("size", "tok")).alias("toks"))
    index = index.where(f"size(toks) >= {similar.sql_shared(similar.sql_smallest('n'))}").withColumn("home", F.expr("array_max(toks).tok"))
    index = scratch.write(index, "index")

    # pairs of homes. A bucket holds few homes, as its members' homes are at least as large: their pairs are formed natively,
    # and those go on that share enough buckets for some pair of their groups. Buckets of many homes go by blocks of groups
    each = index.select("gid", "n", "home", F.explode("toks.tok").alias("tok"))
    held = scratch.write(each.groupBy("tok", "home").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "held")
    homes = held.groupBy("tok").agg(F.count("*").alias("homes")).where("homes > 1")
    one = held.join(homes.where(F.col("homes") <= SMALL_BUCKET), "tok").select("tok", "home", "lo", "hi")
    other = one.select("tok", *[F.col(c).alias(f"{c}2") for c in ("home", "lo", "hi")])
    few = one.join(other, "tok").where("home < home2").groupBy("home", "home2")
    few = few.agg(F.count("*").alias("k"), *[f(c).alias(c) for c, f in (("lo", F.min), ("lo2", F.min), ("hi", F.max), ("hi2", F.max))])
    fit = f"hi >= {similar.sql_smallest('lo2')} and hi2 >= {similar.sql_smallest('lo')} and k >= least({similar.sql_shared('lo')}, {similar.sql_shared('lo2')})"
    few = few.where(fit).select(F.col("home").alias("a"), F.col("home2").alias("b"))
    many_homes = homes.where(F.col("homes") > SMALL_BUCKET).select("tok")
    # 31 bits of each shared shingle: equal ones stay equal, and a clash only lets a pair through to be verified
    masked = F.expr("transform(toks, x -> cast(x.tok & 2147483647 as int))").alias("set")
    large = each.join(many_homes, "tok", "left_semi").join(sizes, "tok").join(index.select("gid", "n", masked), ["gid", "n"])
    many = map_groups(_dealt(large, "gid", F.col("size")), ["tok", "i", "j"], _home_pairs(similar), "a long, b long")
    at_home = members.join(index.select("gid", "n", "home").hint("merge"), ["gid", "n"], "left").withColumn("home", F.coalesce("home", F.xxhash64("gid", "n")))
    at_home = scratch.write(at_home.select("rep", "n", "s1", "s2", "copies", "gid", "home"), "at_home")
    within = at_home.groupBy("home").agg(F.count("*").alias("k")).where("k > 1").select(F.col("home").alias("a"), F.col("home").alias("b"))
    pairs = few.unionByName(many).unionByName(within)
    pairs = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    scratch.drop(sizes, aside, members, held)

    # homes cut into blocks, and the tasks: pairs of blocks of paired homes
    used = pairs.select(F.explode(F.array("a", "b")).alias("home")).distinct()
    weight = F.greatest(F.count("*").cast("double"), F.sum("n") * F.lit(BLOCK / BLOCK_SHINGLES))
    cut = at_home.groupBy("home").agg(weight.alias("weight")).withColumn("blocks", F.ceil(F.col("weight") / F.lit(BLOCK)).cast("int"))
    cut = scratch.write(cut.join(used, "home"), "cut")
    block = F.pmod(F.xxhash64("rep", "s1"), F.col("blocks")).cast("int").alias("block")
    placed = at_home.select("*", *apart("home")).join(cut.select(*apart("home"), "blocks").hint("merge"), "_home")
    placed = scratch.write(placed.select("rep", "n", "s1", "s2", "copies", "home", block), "placed")
    # a pair's smaller home is a guest of the larger one, whose blocks take their guests together, about BLOCK at a time
    end = lambda c: cut.select(F.col("home").alias(c), F.col("weight").alias(f"w{c}"), F.col("blocks").alias(f"n{c}"))
    cross = pairs.where("a <> b").join(end("a"), "a").join(end("b"), "b")
    larger = F.expr("wa > wb or wa = wb and a > b")
    pick = lambda x, y, name: F.when(larger, F.col(x)).otherwise(F.col(y)).alias(name)
    cross = cross.select(pick("a", "b", "host"), pick("na", "nb", "host_blocks"), pick("b", "a", "guest"), pick("nb", "na", "guest_blocks"), pick("wb", "wa", "weight"))
    groups = cross.groupBy("host").agg(F.ceil(F.sum("weight") / F.lit(BLOCK)).cast("int").alias("groups"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    guests = cross.withColumn("block", up_to("guest_blocks")).join(groups, "host").withColumn("g", F.pmod(F.xxhash64("guest", "block"), F.col("groups")).cast("int"))
    guests = guests.withColumn("i", up_to("host_blocks")).select(F.col("guest").alias("home"), "block", F.col("host").alias("a"), "i", F.col("i").alias("j"), "g")
    own = cut.join(groups.withColumnRenamed("host", "home"), "home", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    own = own.withColumn("i", up_to("blocks")).withColumn("g", up_to("groups")).select("home", F.col("i").alias("block"), F.col("home").alias("a"), "i", F.col("i").alias("j"), "g")
    two = cut.where("blocks > 1").withColumn("i", up_to("blocks")).withColumn("j", up_to("blocks")).where("i < j")
    two = two.select("home", F.explode(F.array("i", "j")).alias("block"), F.col("home").alias("a"), "i", "j", F.lit(0).alias("g"))
    tasks = guests.unionByName(own).unionByName(two).groupBy("home", "block").agg(F.collect_list(F.struct("a", "i", "j", "g")).alias("tasks"))
    moved = placed.join(tasks, ["home", "block"]).withColumnRenamed("rep", "doc_id")

    # sketches, which leave the members of each task that may have a link there
    known_sketches = full.where("n > 0").select("doc_id", "n", "s1", "s2", "sketch")
    sketched = maybe_among(known_sketches, "doc_id", placed.select("rep"), total).join(moved, ["doc_id", "n", "s1", "s2"])
    sketched = sketched.withColumn("t", F.explode("tasks")).withColumnRenamed("doc_id", "rep")
    own = ((F.col("home") == F.col("t.a")) & (F.col("block") == F.col("t.i"))).alias("own")
    sketched = sketched.select("rep", "n", "s1", "s2", "copies", "t.*", own, "sketch")
    left = scratch.write(map_groups(sketched, ["a", "i", "j", "g"], _likely_members(similar), MEMBERS), "left")

    # whole sets of those, verified block by block
    tasks = left.groupBy(F.col("rep").alias("doc_id"), "n", "s1", "s2", "copies").agg(F.collect_list(F.struct("a", "i", "j", "g", "own")).alias("tasks"))
    reps = left.select("rep").distinct()
    wide = maybe_among(docs, "doc_id", reps, reps.count()).join(tasks, "doc_id")
    wide = wide.select("text", F.col("doc_id").alias("rep"), "n", "s1", "s2", "copies", "tasks")
    task = "array<struct<a: long, i: int, j: int, g: int, own: boolean>>"
    sets = map_batches(wide, _member_sets(words), f"set binary, rep long, n long, s1 long, s2 long, copies long, tasks {task}")
    sets = sets.withColumn("t", F.explode("tasks")).select("set", "rep", "n", "s1", "s2", "copies", "t.*")
    checked = scratch.write(map_groups(sets, ["a", "i", "j", "g"], _verify(similar), "u long, n long, s1 long, s2 long, v long, links long"), "links")
    scratch.drop(index, pairs, cut, placed, left)

    # texts of one id belong together
    several = known.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("x"), F.max(F.struct("n", "s1", "s2")).alias("y")).where("x <> y").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").join(at_home.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(checked.select("u", "v").unionByName(ties), scratch).select(F.col("node").alias("rep"), "root")
    links = checked.groupBy("n", "s1", "s2").agg(F.sum("links").alias("links"))

    verdict = at_home.join(roots, "rep", "left").join(links, ["n", "s1", "s2"], "left")
    verdict = verdict.select("n", "s1", "s2", F.coalesce("root", "rep").alias("_root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    out = nodes.join(verdict, ["n", "s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("_root", "doc_id")).otherwise(F.col("doc_id"))
    result = scratch.write(
        out.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        ),
        "result",
    )
    scratch.drop_all_but(result)
    return result


def _told_apart(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """One row of each id and text, the first by its columns as JSON, with `key`: the id, or for all but the first text of an id a number above all ids.

    The order of the numbers depends on the rows only. Rows with a null id all stay.
    """
    line, nth, first, own = spare([*docs.columns, key], "line", "nth", "first", "own")
    wide = docs.where("doc_id is not null").withColumn(line, F.to_json(F.struct(*named(docs))))
    w = Window.partitionBy("doc_id", "text").orderBy(line)
    once = scratch.write(wide.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(line, nth), "once")
    # a struct, so that a null text comes first
    least = once.groupBy(F.col("doc_id").alias(own)).agg(F.min(F.struct("text")).alias(first))
    told = scratch.write(once.join(least.hint("merge"), F.col("doc_id") == F.col(own)).withColumn(first, F.col(f"{first}.text").eqNullSafe(F.col("text"))), "told")
    most = told.agg(F.max(own).alias("m")).first().m
    extra = told.where(~F.col(first)).orderBy("doc_id", "text").withColumn(key, F.lit(int(most) + 1) + F.monotonically_increasing_id())
    extra = scratch.write(extra.drop(first, own), "extra")
    same = F.col("doc_id").cast("long")
    out = told.where(F.col(first)).drop(first, own).withColumn(key, same).unionByName(extra)
    return out.unionByName(docs.where("doc_id is null").withColumn(key, same))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the row of the smallest id, and all rows with a null id.

    Rows with one id and one text are one row; different texts with one id are
    documents of their own, removed by similarity only. Extra columns may have any name.
    """
    columns, scratch = named(docs), Scratch(docs.sparkSession, tidy=True)
    key, gone_key = spare(docs.columns, "key", "gone")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    docs = _told_apart(docs, key, scratch) if repeated else docs.withColumn(key, F.col("doc_id").cast("long"))
    found = similar_components(docs, words, num, den, key)
    gone = scratch.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_key)).distinct(), "gone")
    return without(docs, key, gone, gone.count()).select(columns)
