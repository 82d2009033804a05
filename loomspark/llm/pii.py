"""Personal data by weak supervision, with DataFrame functions only.

1. Patterns find candidate spans of four kinds (email, ip, card, phone).  The base patterns with
   their checks are certain; looser ones (written-out addresses, local phone numbers, shorter card
   numbers) are only candidates.  A pattern's matches and the text between them give the offsets.
2. Labelers vote +1, -1 or abstain on every candidate: the strict pattern (+1 or none), a gazetteer (top-level
   domains, card issuers, reserved networks, area codes), the words before it, and what touches it.
3. Expectation-maximisation over the counts of vote patterns (a small table: at most 3 to the
   number of labelers, per kind) estimates each labeler's reliability and, for each pattern of
   votes, the probability that such a span is personal data.
4. These probabilities are the soft labels of the final span classifier, naive Bayes over what the
   span looks like (shape, length, neighbours, words before).  Candidates that it accepts and that
   overlap no base span are added to the base spans.

Counts cover all candidates of the corpus.  Only tables of bounded size reach the driver: vote
patterns and feature weights (shapes are hashed to ``SHAPES`` values).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, work_dir, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Runs begin where a run can begin (or where the last match ended)
# and give nothing back, which finds the same matches without trying every later start again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser candidates
LOOSE_EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++"
               r"(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++")
LOOSE_PHONE = r"(?<![0-9.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])"

# Gazetteers
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
AREA = r"^\(?(?:[2-9][0-9]{2})"
CUES = {"email": r"(?i)(?:mail|contact|write|schreib|contacto|courriel)[^A-Za-z]{0,12}$",
        "ip": r"(?i)(?:\bip|address|host|server|client|from)[^A-Za-z]{0,8}$",
        "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)[^A-Za-z]{0,12}$",
        "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|fono)[^A-Za-z]{0,12}$"}
AGAINST = r"(?i)(?:version|ver|isbn|build|section|page|item|order|ref|no|nr|id|[$€£#])[^A-Za-z]{0,3}$"

BEFORE, AFTER = 24, 4
SHAPES = 512
VOTERS = ("pattern", "gazetteer", "context", "edges")
SPAN = "kind string, base boolean, seg_len long, match string, before string, after string, pos int"


def _matches(text: Column, kind: str, pattern: str, base: bool, when: Column) -> Column:
    """The matches of a pattern in order, each with the length and the end of the text since the last one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # zipped first, so that each array is made once and not again for every element
    rows = F.arrays_zip(found.alias("m"), between.alias("seg"), F.slice(between, F.lit(2), F.size(found)).alias("next"))
    one = lambda r, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.char_length(r["seg"]).cast("long").alias("seg_len"),
        r["m"].alias("match"), F.right(r["seg"], F.lit(BEFORE)).alias("before"),
        F.substring(r["next"], 1, AFTER).alias("after"), i.alias("pos"))
    made = F.filter(F.transform(rows, one), lambda r: r["match"].isNotNull())
    return F.when(when, made).otherwise(F.array().cast(f"array<struct<{_struct()}>>"))


def _struct() -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in SPAN.split(", "))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    value = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    twice = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
                        lambda s, i: s + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _passes(kind: Column, match: Column) -> Column:
    """The checks that a base match must pass."""
    d = _digits(match)
    n = F.char_length(d)
    small_parts = match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    return (F.when(kind == "ip", small_parts)
            .when(kind == "card", F.when(n.between(16, 19), luhn(d)).otherwise(False))
            .when(kind == "phone", n.between(8, 15)).otherwise(True))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, id, spans``: every row with its raw matches, in one pass over the text."""
    t = F.col("text")
    at, digit, plus = t.contains("@"), t.rlike("[0-9]"), t.contains("+")
    said = t.contains("(at)") | t.contains("[at]") | t.contains("(AT)") | t.contains("[AT]")
    spans = F.concat(
        _matches(t, "email", EMAIL, True, at), _matches(t, "ip", IP, True, digit & t.contains(".")),
        _matches(t, "card", CARD, True, digit), _matches(t, "phone", PHONE, True, plus),
        _matches(t, "email", LOOSE_EMAIL, False, said), _matches(t, "phone", LOOSE_PHONE, False, digit))
    return pick(docs, id_col, text_col).toDF("id", "text").select(
        F.monotonically_increasing_id().alias("rid"), "id", F.coalesce(t, F.lit("")).alias("text")).select(
        "rid", "id", spans.alias("spans"))


def placed(found: DataFrame) -> DataFrame:
    """One row per candidate with its start and end.  Base matches that fail their checks go, except card numbers of
    13 to 15 digits that pass the Luhn check, which stay as candidates."""
    s = found.select("rid", F.explode("spans").alias("s")).select("rid", "s.*")
    upto = Window.partitionBy("rid", "kind", "base").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("match").cast("long")
    s = (s.withColumn("end", F.sum(F.col("seg_len") + length).over(upto)).withColumn("start", F.col("end") - length)
         .withColumn("strict", F.col("base") & _passes(F.col("kind"), F.col("match"))))
    d = _digits(F.col("match"))
    short = F.when((F.col("kind") == "card") & F.char_length(d).between(13, 15), luhn(d)).otherwise(False)
    return s.where(F.col("strict") | ~F.col("base") | short).drop("base", "seg_len", "pos")


def votes(spans: DataFrame) -> DataFrame:
    """The labelers' votes: +1 personal data, -1 not, 0 no opinion."""
    kind, match, d = F.col("kind"), F.col("match"), _digits(F.col("match"))
    tld = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    cue = reduce(lambda c, k: c.when(kind == k, F.col("before").rlike(CUES[k])), KINDS, F.when(F.lit(False), False))
    touches = F.col("before").rlike(r"[A-Za-z0-9_/]$") | F.col("after").rlike(r"^(?:[A-Za-z0-9_/]|[.-][0-9])")
    return spans.select(
        "*",
        F.when(F.col("strict"), 1).otherwise(0).alias("pattern"),
        F.when(kind == "email", F.when(tld.isin(*DOMAINS), 1).otherwise(-1))
         .when(kind == "card", F.when(d.rlike(ISSUERS), 1).otherwise(-1))
         .when(kind == "ip", F.when(match.rlike(RESERVED), -1).otherwise(0))
         .otherwise(F.when(match.startswith("+") | match.rlike(AREA), 1).otherwise(-1)).alias("gazetteer"),
        F.when(cue, 1).when(F.col("before").rlike(AGAINST), -1).otherwise(0).alias("context"),
        F.when(touches, -1).otherwise(1).alias("edges"))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation over (votes, count) rows of one kind: the probability of +1 for each pattern of
    votes, and of each labeler the chance to vote +1, -1 or 0 on personal data and on other spans."""
    k = len(patterns[0][0])
    post = {v: 0.5 + 0.35 * sum(v) / k for v, _ in patterns}  # start from the majority
    table: dict = {}
    for _ in range(rounds):
        good = sum(n * post[v] for v, n in patterns)
        all_ = sum(n for _, n in patterns)
        prior = (good + 1) / (all_ + 2)
        for j in range(k):
            for x in (1, -1, 0):
                yes = sum(n * post[v] for v, n in patterns if v[j] == x)
                no = sum(n * (1 - post[v]) for v, n in patterns if v[j] == x)
                # a labeler is taken to be better than chance: one vote's worth of belief in it
                table[j, x] = ((yes + (2 if x == 1 else 1)) / (good + 4), (no + (2 if x == -1 else 1)) / (all_ - good + 4))
        for v, _ in patterns:
            yes, no = prior, 1 - prior
            for j, x in enumerate(v):
                yes, no = yes * table[j, x][0], no * table[j, x][1]
            post[v] = yes / (yes + no)
    return post, table


def _features(s: DataFrame) -> Column:
    shape = F.regexp_replace(F.regexp_replace(F.lower("match"), "[a-z]+", "a"), "[0-9]", "9")
    last = F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1)
    return F.array(
        F.concat(F.lit("shape:"), F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("string")),
        F.concat(F.lit("length:"), F.least(F.char_length("match"), F.lit(40)).cast("string")),
        F.concat(F.lit("word:"), F.pmod(F.xxhash64(F.lower(last)), F.lit(SHAPES)).cast("string")),
        F.concat(F.lit("left:"), F.when(F.col("before").rlike(r"[\p{L}0-9]$"), "in").when(
            F.col("before").rlike(r"\s$|^$"), "free").otherwise("mark")),
        F.concat(F.lit("right:"), F.when(F.col("after").rlike(r"^[\p{L}0-9]"), "in").when(
            F.col("after").rlike(r"^\s|^$"), "free").otherwise("mark")))


def classified(spans: DataFrame, root: str) -> DataFrame:
    """Spans with ``label`` (probability from the votes) and ``score`` (of the trained classifier)."""
    spark = spans.sparkSession
    voted = written(votes(spans), f"{root}/votes")
    counted = voted.groupBy("kind", *VOTERS).agg(F.count(F.lit(1)).alias("n")).collect()  # <= 4 * 3**4 rows
    soft, prior = [], {}
    for kind in KINDS:
        own = [(tuple(r[v] for v in VOTERS), float(r["n"])) for r in counted if r["kind"] == kind]
        if own:
            post, _ = reliabilities(sorted(own))
            soft += [(kind, *v, p) for v, p in post.items()]
            good, all_ = sum(n * post[v] for v, n in own), sum(n for _, n in own)
            prior[kind] = (good, all_ - good)
    schema = "kind string, " + ", ".join(f"{v} int" for v in VOTERS) + ", label double"
    labelled = voted.join(F.broadcast(spark.createDataFrame(soft, schema)), ["kind", *VOTERS])
    feats = labelled.select("rid", "kind", "start", "end", "strict", "label", _features(labelled).alias("features"))
    sums = (feats.select("kind", "label", F.explode("features").alias("f")).groupBy("kind", "f")
            .agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")))
    base = spark.createDataFrame([(k, y, n) for k, (y, n) in prior.items()], "kind string, good double, bad double")
    weights = sums.join(F.broadcast(base), "kind").select(
        "kind", "f", F.log((F.col("yes") + 0.5) / (F.col("good") + 1)).alias("wy"),
        F.log((F.col("no") + 0.5) / (F.col("bad") + 1)).alias("wn"))
    # at most 4 * (2 * SHAPES + 46) weights: one map per kind
    table = weights.groupBy("kind").agg(F.map_from_entries(F.collect_list(
        F.struct("f", F.col("wy") - F.col("wn")))).alias("w")).join(base, "kind")
    odds = F.aggregate("features", F.log((F.col("good") + 0.5) / (F.col("bad") + 0.5)), lambda a, f: a + F.col("w")[f])
    return feats.join(F.broadcast(table), "kind").withColumn(
        "score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))).drop("features", "w", "good", "bad")


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(rank, s["kind"]).alias("a"), s["start"].alias("b"), s["end"].alias("c"),
        F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("d"))))
    return F.array_join(F.transform(keyed, lambda s: s["d"]), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, base, added``, two arrays of (kind, start, end, score); offsets are code
    points, end exclusive.  Null counts as empty and has no spans; no rows from an empty table."""
    root = work_dir(docs.sparkSession, "personal-data")
    found = written(candidates(docs, id_col, text_col), f"{root}/candidates")
    spans = classified(placed(found.where(F.size("spans") > 0)), root)
    kept = spans.where(F.col("strict") | (F.col("score") >= 0.5))
    one = F.struct("kind", "start", "end", "score")
    own = kept.groupBy("rid").agg(F.collect_list(F.when(F.col("strict"), one)).alias("base"),
                                  F.collect_list(F.when(~F.col("strict"), one)).alias("more"))
    free = lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    own = own.select("rid", "base", F.filter("more", free).alias("added"))
    none = F.array().cast("array<struct<kind: string, start: long, end: long, score: double>>")
    return found.select("rid", "id").join(own, "rid", "left").select(
        F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, their digest, and the list of all spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(id_col, *[n(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))
