"""Near-duplicate groups by Order MinHash, verified by banded alignment.

Words are runs of letters, digits and non-ASCII characters in lower case; a k-mer is five words
(a shorter text is one k-mer), labelled with its occurrence number in the text.  Each of
``SKETCHES`` hash orders picks the ``PICKS`` smallest k-mers of a text and hashes them in text order,
so texts that keep order as well as content share sketches.  Texts that share one are candidates.
Of few k-mers a sketch says too little: where the shorter text has fewer than ``SHORT``, candidates
share one of their rarest k-mers instead (prefix filter, below), which no similar pair fails to do.

The similarity of two texts is 1 - d / n: d the edit distance of their k-mer sequences (found on
the diagonals that d may reach, the band), n the longer length.  At 0.8 or more they are linked;
groups are the connected components.

Identical word sequences are collapsed first, so a group of exact copies counts once.  Texts that
share a sketch or a rare k-mer are a bucket, and a bucket has a leader, the first text in one of
``ORDERS`` random orders.  In a round a text meets one leader, chosen by hash from those of its buckets
that hold several components; so a leader unlike most of a group leaves only some of it open.  Links of a round join texts to leaders, so these stars are
contracted first and only distinct edges between leaders are spread along.  What is open after
``ROUNDS`` rounds goes through an exact filter: two similar texts share at least one of the rarest
fifth of their k-mers (prefix filter; boilerplate is frequent and so never in it).  Every text
outside its bucket's largest component meets the components that share such a k-mer: their members
lie in cells of about ``CELL`` texts, and in a cell it is compared with those that share one, the
likeliest first, until one is similar.  Work on a large group is thus at most one pair per text and
round, texts travel once for each cell and not for each pair, and no candidate is left out; similar
texts of ``SHORT`` k-mers or more that share no sketch are missed.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, located, map_texts, small, work_dir, written

WORDS = 5
SKETCHES = 40
PICKS = 4
#: Pairs whose shorter text has fewer k-mers are found by the exact prefix filter, not by sketches.
SHORT = 25
SIMILARITY = 0.8
ROUNDS = 3
#: Random orders that leaders are the first of.
ORDERS = 8
#: Texts of one side in a cell of the exact filter (about).
CELL = 1024
#: First prefix k-mers that texts compare to meet once.
HEAD = 16


def shingler():
    """Function from a text to the 64-bit hashes of its k-mers, in text order."""
    rnd = np.random.default_rng(20240607)
    byte = rnd.integers(1, 2 ** 63, 256, dtype=np.uint64)
    is_word = np.zeros(256, bool)
    is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(base), -1, 2 ** 64))
    state = {"n": 0}

    def powers(n: int):
        if n > state["n"]:
            n = max(n, 2 * state["n"], 1 << 14)
            up, down = np.full(n, base), np.full(n, back)
            up[0] = down[0] = 1
            state.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
        return state["up"], state["down"]

    def shingles(text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        mask = np.concatenate(([False], is_word[raw], [False]))
        turn = np.flatnonzero(mask[1:] != mask[:-1])
        starts, ends = turn[::2], turn[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[raw] * up[:len(raw)], dtype=np.uint64)))
        words = (total[ends] - total[starts]) * down[starts]
        words ^= words >> np.uint64(29)
        k = min(WORDS, len(words))
        n = len(words) - k + 1
        out = np.full(n, np.uint64(k))
        for j in range(k):
            out = (out ^ words[j:j + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out
    return shingles


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers told apart by how often they occurred before in the text."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    if new.all():
        return kmers
    at = np.arange(len(s))
    times = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(kmers)
    out[order] = s + times.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return out


def sketcher():
    """Function from labelled k-mers, more than ``PICKS``, to the sketch keys of a text."""
    seeds = np.random.default_rng(7).integers(1, 2 ** 63, SKETCHES, dtype=np.uint64)
    slots = np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    m1, m2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def sketch(x: np.ndarray) -> np.ndarray:
        step = max(1, 400_000 // len(x))
        parts = []
        for i in range(0, SKETCHES, step):
            v = (x[None, :] ^ seeds[i:i + step, None]) * m1
            v ^= v >> np.uint64(31)
            v *= m2
            parts.append(np.sort(np.argpartition(v, PICKS - 1, axis=1)[:, :PICKS], axis=1))
        at = np.concatenate(parts)
        key = slots.copy()
        for j in range(PICKS):
            key = (key ^ x[at[:, j]]) * m1
            key ^= key >> np.uint64(30)
        return key.view(np.int64)
    return sketch


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the longest common subsequence: of the values that occur once in each sequence those in
    the same order (longest increasing subsequence of their places), and all common copies of the others."""
    va, ia, na = np.unique(a, return_index=True, return_counts=True)
    vb, ib, nb = np.unique(b, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    once = (na[xa] == 1) & (nb[xb] == 1)
    rest = int(np.minimum(na[xa], nb[xb])[~once].sum())
    places = ib[xb[once]][np.argsort(ia[xa[once]])]
    if len(places) < 2 or (np.diff(places) > 0).all():
        return rest + len(places)
    tails: list[int] = []
    for x in places.tolist():
        at = bisect_left(tails, x)
        tails[at:at + 1] = [x]
    return rest + len(tails)


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int, band: int | None = None) -> int | None:
    """The edit distance of two sequences if it is at most ``limit``, else None.  Only the diagonals within the
    limit are looked at: the furthest position reached on each with 0, 1, 2, ... edits.  A narrower ``band``
    around the first and last diagonal gives the distance of the best alignment inside it."""
    la, lb = len(a), len(b)
    goal = lb - la
    if abs(goal) > limit:
        return None
    band = limit if band is None else band
    low, high = max(-band + min(0, goal), -la), min(band + max(0, goal), lb)
    xs, ys = a.tolist(), b.tolist()
    stops: dict[int, np.ndarray] = {}

    def slide(d: int, i: int) -> int:
        if i >= la or i + d >= lb or xs[i] != ys[i + d]:
            return i
        if d not in stops:
            first, last = max(0, -d), min(la, lb - d)
            stops[d] = np.append(np.flatnonzero(a[first:last] != b[first + d:last + d]) + first, last).astype(np.int32)
        return int(stops[d][np.searchsorted(stops[d], i)])

    reach = {0: slide(0, 0)}
    edits = 0
    while reach.get(goal, -1) < la:
        edits += 1
        if edits > limit:
            return None
        now = {}
        spare = limit - edits
        for d in range(max(-edits, goal - spare, low), min(edits, goal + spare, high) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            if i >= max(0, -d):
                now[d] = slide(d, min(i, la, lb - d))
        reach = now
    return edits


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the alignment leaves at most the allowed edits; narrow bands are tried first."""
    n = max(len(a), len(b))
    limit = int(n * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > limit or n - most_common(a, b) > limit:
        return False
    band = 4
    while band < limit:
        if edit_distance_within(a, b, limit, band) is not None:
            return True
        band *= 8
    return edit_distance_within(a, b, limit) is not None


def _sketches(src: DataFrame, similarity: float) -> DataFrame:
    """rid, id, place, number of k-mers, digest of the word sequence, sketch keys (from ``SHORT`` k-mers on) and
    labelled k-mers (of texts that a text of fewer than ``SHORT`` can be similar to) of every row."""
    longest = (SHORT - 1) / similarity + 1e-9

    def make():
        shingles, sketch = shingler(), sketcher()

        def work(texts):
            out = []
            for t in texts:
                s = shingles(t)
                if len(s):
                    x = labelled(s)
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                sketch(x) if len(s) >= SHORT else [], x.view(np.int64) if len(s) <= longest else []))
                else:  # no word: equal only to texts with the same characters but blanks
                    out.append((0, hashlib.blake2b("".join(t.split()).encode("utf-8", "surrogatepass"),
                                                   digest_size=16, person=b"no words").digest(), [], []))
            return list(zip(*out)) or [[], [], [], []]
        return work
    return map_texts(src, make, "n int, digest binary, keys array<long>, few array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    both = (pairs.join(texts.select(F.col("rid").alias("a"), F.col("kmers").alias("ka")), "a")
            .join(texts.select(F.col("rid").alias("b"), F.col("kmers").alias("kb")), "b").select("a", "b", "ka", "kb"))
    near = similar
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ka, kb = t.column(2), t.column(3)  # read in place, row by row
            keep = [near(np.frombuffer(ka[i].as_buffer(), np.uint32), np.frombuffer(kb[i].as_buffer(), np.uint32),
                         similarity) for i in range(t.num_rows)]
            yield t.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return both.mapInArrow(run, "a long, b long")


def _table(df: DataFrame, path: str) -> DataFrame:
    """A written table in at most a few files per core: what links texts is small beside the texts."""
    return written(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), path)


def components(edges: DataFrame, root: str) -> DataFrame:
    """(rid, comp) of every vertex of the edges (a, b): comp is the smallest rid of its component.  Labels
    spread to neighbours and then jump to their label's label, until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _table(both, f"{root}/edges")
    labels = _table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).toDF("rid", "comp"),
                    f"{root}/labels-0")
    step = 0
    while True:
        step += 1
        near = (both.join(labels.withColumnsRenamed({"rid": "b"}), "b").groupBy("a").agg(F.min("comp").alias("m")))
        spread = labels.join(near, F.col("rid") == F.col("a")).select(
            "rid", F.col("comp").alias("was"), F.least("comp", "m").alias("next"))
        jump = labels.toDF("next", "far")
        out = _table(spread.join(jump, "next", "left").select(
            "rid", F.least("next", F.coalesce("far", "next")).alias("comp"), "was"), f"{root}/labels-{step}")
        labels = out.select("rid", "comp")
        if out.where("comp <> was").isEmpty():
            return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept, n_kmers, __file, __row``.

    Rows of one near-duplicate group share ``class_id``, the smallest id in the group (null ids last, then the
    first row by place); that one row is ``kept``, also among repeated rows.  Null text counts as empty; texts
    without a word are grouped only with texts of the same characters but blanks.  No rows from an empty table."""
    root = work_dir(docs.sparkSession, "near-dedup")
    src = located(docs, [id_col, text_col], f"{root}/input").withColumnsRenamed({id_col: "id", text_col: "text"})
    src = src.withColumn("text", F.coalesce("text", F.lit("")))
    rows = written(_sketches(src.withColumn("rid", F.monotonically_increasing_id()), similarity), f"{root}/rows")

    reps = rows.groupBy("digest").agg(F.min("rid").alias("rep"))
    reps = written(reps, f"{root}/representatives")
    of_reps = lambda c: (rows.where(F.size(c) > 0).select("rid", "n", c)
                         .join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi")
                         .select("rid", "n", F.explode(c).alias("key")))
    few = _table(of_reps("few").withColumnRenamed("key", "kmer"), f"{root}/short-kmers")
    rare = _table(_prefixes(few, similarity).select("rid", "n", F.col("kmer").alias("key")), f"{root}/short-keys")
    keys = of_reps("keys").unionByName(rare)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    shared = _table(shared, f"{root}/keys")
    members = _table(keys.join(small(shared, shared.count(), 40), "key"), f"{root}/members")

    need = _table(members.select("rid").distinct().join(rows.select("rid", "__file", "__row"), "rid"), f"{root}/need")
    texts = src.join(small(need, need.count(), 250), ["__file", "__row"]).select("rid", "text")

    def make():
        shingles = shingler()
        # 32 bits of each k-mer's hash are plenty to align two texts
        return lambda ts: [[(shingles(t) >> np.uint64(32)).astype(np.uint32).tobytes() for t in ts]]
    texts = written(map_texts(texts, make, "kmers binary"), f"{root}/kmers")

    comp = _linked(members, texts, similarity, root)
    labelled_rows = (rows.select("rid", "id", "n", "digest", "__file", "__row").join(reps, "digest")
                     .join(comp.withColumnsRenamed({"rid": "rep"}), "rep", "left")
                     .withColumn("comp", F.coalesce("comp", "rep")))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("__file").alias("file"),
                     F.col("__row").alias("row"))
    groups = labelled_rows.groupBy("comp").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("class_size"))
    return labelled_rows.join(groups, "comp").select(
        F.col("id").alias(id_col), F.col("top.id").alias("class_id"), "class_size",
        ((F.col("__file") == F.col("top.file")) & (F.col("__row") == F.col("top.row"))).alias("kept"),
        F.col("n").alias("n_kmers"), "__file", "__row")


def _linked(members: DataFrame, texts: DataFrame, similarity: float, root: str) -> DataFrame:
    """(rid, comp) of the texts that have a verified link."""
    spark = members.sparkSession
    comp = spark.createDataFrame([], "rid long, comp long")
    tested = spark.createDataFrame([], "x long, y long")
    for r in range(ROUNDS + 1):
        now = members.select("key", "rid", "n").join(comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        mixed = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        open_ = _table(now.join(mixed.select("key"), "key"), f"{root}/open-{r}")
        if open_.isEmpty():
            break
        if r < ROUNDS:
            pairs = _with_leaders(open_, r, similarity).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
            pairs = _table(pairs.join(tested, ["x", "y"], "left_anti"), f"{root}/pairs-{r}")
            found = _verified(pairs, texts, similarity)
            tested = tested.unionByName(pairs.select("x", "y"))
        else:
            found = _rare_links(open_, texts, similarity, root)
        found = _table(found, f"{root}/links-{r}")
        if not found.isEmpty():
            comp = _merged(comp, found, f"{root}/components-{r}")
    return comp


def _merged(comp: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """The components after new links (a, b): only the components that the links join are worked on, as vertices.
    Each vertex ``a`` first becomes its smallest ``b``; labels spread along what is left between these."""
    known = lambda c: comp.select(F.col("rid").alias(c), F.col("comp").alias(f"c{c}"))
    if not comp.isEmpty():
        links = (links.join(known("a"), "a", "left").join(known("b"), "b", "left")
                 .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"))
    star = _table(links.groupBy("a").agg(F.min("b").alias("hub")), f"{root}/stars")
    of = lambda c, to: star.toDF(c, to)
    hubs = (links.join(of("b", "far"), "b", "left").join(of("a", "near"), "a")
            .select(F.col("near").alias("a"), F.coalesce("far", "b").alias("b")).where("a <> b"))
    between = _table(_ordered(hubs.toDF("x", "y")), f"{root}/hubs")
    label = (components(between, root) if not between.isEmpty()
             else comp.sparkSession.createDataFrame([], "rid long, comp long")).toDF("hub", "label")
    of_hub = star.join(label, "hub", "left").select(F.col("a").alias("rid"), F.coalesce("label", "hub").alias("to"))
    ends = links.select(F.col("b").alias("rid")).distinct().join(star.select(F.col("a").alias("rid")), "rid", "left_anti")
    ends = ends.join(label.withColumnRenamed("hub", "rid"), "rid", "left").select("rid", F.coalesce("label", "rid").alias("to"))
    new = _table(of_hub.unionByName(ends), f"{root}/new")
    moved = comp.join(new.toDF("comp", "to"), "comp", "left").select("rid", F.coalesce("to", "comp").alias("comp"))
    fresh = new.join(comp.select("rid"), "rid", "left_anti").select("rid", F.col("to").alias("comp"))
    return _table(moved.unionByName(fresh), f"{root}/merged")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_leaders(open_: DataFrame, r: int, similarity: float) -> DataFrame:
    """Of each text at most one pair (a, b): the text and one of the leaders of its buckets, by a hash of both.  In
    the first round a bucket's leader is its first text in the bucket's random order; later the first one of its
    largest component, so that only the texts outside it are compared."""
    lead = F.struct(F.xxhash64("rid", F.lit(r), F.pmod("key", F.lit(ORDERS))).alias("h"), F.col("rid").alias("x"),
                    F.col("n").alias("m"), F.col("comp").alias("cx"))
    if r == 0:
        first = open_.groupBy("key").agg(F.min(lead).alias("l"))
    else:
        parts = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min(lead).alias("l"))
        first = parts.groupBy("key").agg(F.max_by("l", F.struct("size", "l.h")).alias("l"))
    met = open_.join(first, "key").where((F.col("comp") != F.col("l.cx")) & F.least("n", "l.m").__ge__(
        F.greatest("n", "l.m") * F.lit(similarity - 1e-9)))
    choice = F.struct(F.xxhash64("l.x", "rid").alias("by"), F.col("l.x").alias("x"))
    return met.groupBy("rid").agg(F.min(choice).alias("c")).select(F.col("rid").alias("a"), F.col("c.x").alias("b"))


def _prefixes(kmers: DataFrame, similarity: float) -> DataFrame:
    """Of the rows (rid, n, kmer, ...) those of each text's n - ceil(similarity * n) + 1 rarest k-mers that other
    texts have too: a k-mer of one text alone is in no pair, but counts as rare."""
    often = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("rid").orderBy("df", "kmer")
    return (kmers.join(often, "kmer").withColumn("place", F.row_number().over(rarest))
            .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1).where("df > 1"))


def _rare_links(open_: DataFrame, texts: DataFrame, similarity: float, root: str) -> DataFrame:
    """Links (a, b) between components whose texts share one of their rarest k-mers, for texts outside the largest
    component of some open bucket; one for each such text, component and cell suffices.  A text of n k-mers has at
    least ceil(similarity * n) in common with a similar one, so its n - ceil(similarity * n) + 1 rarest hold one of
    them, in the order of all open texts."""
    sizes = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    docs = open_.join(main, "key").groupBy("rid", "n", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("minor"))
    docs = _table(docs, f"{root}/open-texts")
    told = labelled

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                kmers = told(np.frombuffer(t.column(1)[i].as_buffer(), np.uint32).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kmers), t.column(0)[i].as_py(), np.int64)), pa.array(kmers.view(np.int64))],
                    names=["rid", "kmer"])
    kmers = texts.join(docs.select("rid"), "rid", "left_semi").select("rid", "kmers").mapInArrow(spread, "rid long, kmer long")
    kmers = _table(kmers, f"{root}/open-kmers")
    prefix = _prefixes(kmers.join(docs, "rid"), similarity)
    prefix = _table(prefix.select("rid", "n", "comp", "minor", "kmer", "place"), f"{root}/open-prefixes")
    sets = F.transform(F.array_sort(F.collect_list(F.struct("place", "kmer"))), lambda s: s["kmer"])
    own = _table(prefix.groupBy("rid").agg(sets.alias("prefix"), F.max("minor").alias("minor")), f"{root}/prefix-sets")
    # Which text has to look into which component: one whose lengths fit, and that will not all look for it.  Two
    # texts that share some of their first k-mers meet under the first of these only.
    head = own.select("rid", F.slice("prefix", 1, HEAD).alias("head"))
    headed = prefix.join(head, "rid")
    held = headed.groupBy("kmer", "comp").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("rid").alias("first"), F.min("minor").alias("all_minor"),
        F.when(F.count(F.lit(1)) == 1, F.first("head")).otherwise(F.array().cast("array<long>")).alias("its_head"))
    least = F.lit(similarity - 1e-9)
    common = F.array_intersect("head", "its_head")
    seeks = (headed.where("minor").select(F.col("rid").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("m"), "kmer", "head")
             .join(held, "kmer").where((F.col("cx") != F.col("comp")) & (F.col("n1") >= F.col("m") * least)
                                       & (F.col("m") >= F.col("n0") * least)
                                       & ~(F.col("all_minor") & (F.col("first") > F.col("x")))
                                       & ((F.size(common) == 0) | (F.get(common, F.lit(0)) == F.col("kmer"))))
             .select("x", "comp").distinct())
    seeks = _table(seeks, f"{root}/seeks")
    held = prefix.select("rid", "comp").distinct()
    sides = (held.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("rows"))
             .join(seeks.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("columns")), "comp"))
    sides = _table(sides, f"{root}/sides")
    n_cells = max(1, -(-(held.count() + seeks.count()) // CELL))
    cell = F.pmod(F.xxhash64("comp", "i", "j"), F.lit(n_cells)).alias("cell")
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = own.join(texts, "rid")
    base = (held.join(sides, "comp").withColumn("i", F.pmod(F.xxhash64("rid"), F.col("rows"))).withColumn("j", to("columns"))
            .select("rid", "comp", cell, F.concat_ws("-", "comp", "i", "j").alias("at")).join(own, "rid"))
    asked = (seeks.withColumnRenamed("x", "rid").join(sides, "comp").withColumn("j", F.pmod(F.xxhash64("rid"), F.col("columns")))
             .withColumn("i", to("rows")).select("rid", "comp", cell, F.concat_ws("-", "comp", "i", "j").alias("at"))
             .join(own, "rid"))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # column ids of its own for the cogroup
    return asked.groupBy("cell").cogroup(base.groupBy("cell")).applyInPandas(_first_links(similarity), "a long, b long")


def _first_links(similarity: float):
    """cogroup function: of each text the first similar member that shares a prefix k-mer, for each place it asks at."""
    near = similar

    def run(asked: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(k, np.uint32) for k in base["kmers"]]
        rids, minor = base["rid"].to_numpy(), base["minor"].to_numpy()
        lists: dict = {}
        for row, (at, prefix) in enumerate(zip(base["at"], base["prefix"])):
            for k in prefix.tolist():
                lists.setdefault((at, k), []).append(row)
        out = []
        for x, at, prefix, kmers, small_ in zip(asked["rid"], asked["at"], asked["prefix"], asked["kmers"], asked["minor"]):
            hits: dict = {}
            for k in prefix.tolist():
                for row in lists.get((at, k), ()):
                    hits[row] = hits.get(row, 0) + 1
            text = np.frombuffer(kmers, np.uint32)
            for row in sorted(hits, key=lambda r: (-hits[r], rids[r])):
                if minor[row] and small_ and rids[row] > x:
                    continue  # that text asks for this one
                if near(text, texts[row], similarity):
                    out.append((x, rids[row]))
                    break
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return run
