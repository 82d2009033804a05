"""Document fingerprints by I-Match, with DataFrame functions only.

Terms are runs of letters, digits and non-ASCII characters in lower case, known by a 64-bit hash.  The
lexicon holds the terms inside a band of inverse document frequency, ``BAND``, counted over all
documents: neither words that every text has nor words of one text.  ``SUBSETS`` randomised lexicon
subsets each keep a random share of it; a text's distinct terms in a subset, sorted, are hashed, and
the hashes of all subsets are its fingerprint.

A share that suits short texts would leave long ones no chance: one changed term in a subset changes
its hash.  So subsets come in levels, each half as dense as the one before and contained in it, and
a text uses the level at which a subset holds about ``TERMS`` to twice as many of its terms, and the
next.  Texts whose sizes differ by less than a factor of two share at least one level; likeness is
the share of equal hashes among the subsets of shared levels that hold a term of either text.

A text without a term of the lexicon is known by the hash of all its distinct terms, and one without
any term by the hash of its characters; such a fingerprint is like equal ones only.

Lower ends of the band bound the lexicon: at most (mean distinct terms of a text) times the highest
document ratio, whatever the number of documents.  It is broadcast only where its count proves it small.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, located, pick, small, work_dir, written

#: Least and largest inverse document frequency of lexicon terms: in one of 20 to one of 2 000 documents.
BAND = (math.log(20), math.log(2000))
SUBSETS = 15
TERMS = 2
#: Bits of a term's hash that each subset looks at: the sparsest level keeps one of 2**BITS terms.
BITS = 12
EMPTY = "-"


def terms(text: Column) -> Column:
    """The hashes of a text's distinct terms."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def level(n_terms: Column) -> Column:
    """The denser of the two levels of a text with so many distinct terms."""
    return F.least(F.lit(BITS - 1), F.greatest(F.lit(0), F.floor(F.log2(n_terms / F.lit(TERMS))))).cast("int")


def _in_subset(term: Column, r: int, lev: Column) -> Column:
    """Whether subset ``r`` of a level holds the term: the first bits, as many as the level, of the subset's
    own field of the term's hash are zero."""
    per = 64 // BITS
    field = term if r < per else F.xxhash64(term, F.lit(r // per))
    mask = (F.lit(1 << BITS) - F.call_function("shiftright", F.lit(1 << BITS), lev)).cast("long")
    return F.call_function("shiftright", field, F.lit(BITS * (r % per))).bitwiseAND(mask) == 0


def lexicon(docs: DataFrame, text_col: str, path: str, band: tuple[float, float] = BAND) -> DataFrame:
    """``term``: the terms inside the band, counted over all documents (null counts as empty), written to ``path``."""
    text = pick(docs, text_col).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = text.count()
    often = text.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return written(often.where(F.col("df").between(n * math.exp(-band[1]), n * math.exp(-band[0]))).select("term"), path)


def sampled(text: Column) -> Column:
    """Of a text: its level, its terms that are in any subset of that level (the next level's are among them),
    and the hash that stands for a text without lexicon terms."""
    made = F.transform(F.array(terms(text)), lambda t: F.struct(
        t.alias("all"), level(F.size(t)).alias("level")))  # one element: the terms are made once
    return F.transform(made, lambda s: F.struct(
        s["level"].alias("level"),
        F.filter(s["all"], lambda h: reduce(lambda a, b: a | b, [_in_subset(h, r, s["level"]) for r in range(SUBSETS)]))
        .alias("terms"),
        F.when(F.size(s["all"]) > 0, F.xxhash64(F.array_sort(s["all"]))).otherwise(F.xxhash64(text)).alias("whole")))[0]


def fingerprints(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``key, level, hashes, fingerprint`` of rows (key, s), ``s`` made by ``sampled`` and ``key`` different in
    every row; ``known`` is the lexicon.  ``hashes`` is null for a text without lexicon terms."""
    src = texts.select("key", "s.level", "s.whole", "s.terms")
    kept = (src.select("key", F.explode("terms").alias("term")).join(small(known, known.count(), 40), "term")
            .groupBy("key").agg(F.array_sort(F.collect_list("term")).alias("kept")))
    out = src.select("key", "level", "whole").join(kept, "key", "left")

    def hash_of(lev: Column, r: int) -> Column:
        own = F.filter("kept", lambda t: _in_subset(t, r, lev))
        return F.when(F.size(own) > 0, F.lower(F.right(F.hex(F.xxhash64(own)), F.lit(8)))).otherwise(F.lit(EMPTY))
    hashes = F.array(*[hash_of(F.col("level") + i, r) for i in (0, 1) for r in range(SUBSETS)])
    out = out.withColumn("hashes", F.when(F.col("kept").isNotNull(), hashes))
    return out.select("key", "level", "hashes", F.when(F.col("hashes").isNotNull(), F.concat_ws(
        ":", F.col("level"), F.array_join("hashes", "."))).otherwise(
        F.concat(F.lit("all:"), F.lower(F.hex("whole")))).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes of two fingerprints, given the prefixes of their columns (level, hashes, fingerprint)."""
    la, lb, ha, hb = (F.col(f"{p}{c}") for c in ("level", "hashes") for p in (a, b))
    dense = lambda h: F.slice(h, 1, SUBSETS)
    sparse = lambda h: F.slice(h, SUBSETS + 1, SUBSETS)

    def share(x: Column, y: Column) -> Column:
        of = lambda test: F.size(F.filter(F.zip_with(x, y, test), lambda v: v))
        both = of(lambda p, q: (p == q) & (p != EMPTY))
        either = of(lambda p, q: (p != EMPTY) | (q != EMPTY))
        return F.when(either > 0, both / either).otherwise(F.lit(0.0))
    same = F.col(f"{a}fingerprint") == F.col(f"{b}fingerprint")
    return (F.when(same, 1.0).when(ha.isNull() | hb.isNull(), 0.0).when(la == lb, share(ha, hb))
            .when(la + 1 == lb, share(sparse(ha), dense(hb))).when(la == lb + 1, share(dense(ha), sparse(hb)))
            .otherwise(0.0))


def edited(docs: DataFrame, id_col: str, text_col: str, root: str) -> DataFrame:
    """``key, next_key, id, next_id, n_chars, text, edited``: every document and its text with the last quarter
    (rounded down) replaced by as many first characters, or all, of the next document by id; after the last
    comes the first.  Null ids come last; of equal ids the row that comes first by file and row."""
    src = located(docs, [id_col, text_col], f"{root}/input").toDF("id", "text", "file", "row")
    src = src.withColumn("text", F.coalesce("text", F.lit("")))
    order = in_order(src.select("id", "file", "row", F.char_length("text").cast("long").alias("n")), f"{root}/order",
                     F.col("id").isNull(), F.col("id"), F.col("file"), F.col("row"))
    n = order.count()
    following = order.select(F.pmod(F.col("pos") + 1, F.lit(max(n, 1))).alias("pos"), F.col("pos").alias("key"),
                             F.col("file").alias("pfile"), F.col("row").alias("prow"), F.col("n").alias("n_chars"))
    links = written(following.join(order.select("pos", "file", "row"), "pos").withColumnRenamed("pos", "next_key"),
                    f"{root}/links")
    # a text travels once by its place; its first characters then go to the document before it
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    given = src.join(links, ["file", "row"]).select(
        F.col("pfile").alias("file"), F.col("prow").alias("row"), "key", "next_key", F.col("id").alias("next_id"),
        "n_chars", F.left("text", quarter).alias("first"))
    return src.join(given, ["file", "row"]).select(
        "key", "next_key", "id", "next_id", "n_chars", "text",
        F.concat(F.left("text", (F.col("n_chars") - quarter).cast("int")), "first").alias("edited"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_id``: the fingerprints of its text and of its edited text (see ``edited``) under the lexicon
    of all documents, and how like its fingerprint is to the edited text's and to the next document's.

    Null text counts as empty.  Equal texts have equal fingerprints, also in repeated rows, which are documents of
    their own; equal ids follow one another by place in their files.  Texts of any length are read whole.  A single
    document is its own next one; an empty table gives no rows."""
    root = work_dir(docs.sparkSession, "imatch")
    known = lexicon(docs, text_col, f"{root}/lexicon")
    rows = edited(docs, id_col, text_col, root).select(
        "key", "next_key", "id", "next_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sampled(F.col("text")).alias("own"), sampled(F.col("edited")).alias("cut"))
    rows = written(rows, f"{root}/sampled")
    both = rows.select((F.col("key") * 2).alias("key"), F.col("own").alias("s")).unionByName(
        rows.select((F.col("key") * 2 + 1).alias("key"), F.col("cut").alias("s")))
    made = written(fingerprints(both, known), f"{root}/fingerprints")
    own = made.where("key % 2 = 0").withColumn("key", F.call_function("shiftright", F.col("key"), F.lit(1)))
    cut = made.where("key % 2 = 1").withColumn("key", F.call_function("shiftright", F.col("key"), F.lit(1)))
    named = lambda df, p, key: df.select(F.col("key").alias(key), *[
        F.col(c).alias(f"{p}{c}") for c in ("level", "hashes", "fingerprint")])
    out = (rows.drop("own", "cut").join(named(own, "a_", "key"), "key").join(named(cut, "b_", "key"), "key")
           .join(named(own, "c_", "next_key"), "next_key"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("a_fingerprint").alias("fingerprint"),
                      F.col("b_fingerprint").alias("edited_fingerprint"), likeness("a_", "b_").alias("near_edited"),
                      likeness("a_", "c_").alias("near_next"), "next_id")
