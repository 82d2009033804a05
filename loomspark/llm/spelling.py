"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

One inserted or deleted letter changes one letter's count by one, a replaced letter two of them: the count
vectors of two such words have an L1 distance of at most two, at most one up and one down.  Letters
are dealt to ``BINS`` bins of about equal weight first, which can only shorten distances.

Words lie in trees by length: a word searches the tree of its own length for replaced letters and the
tree of the next length for inserted ones.  The upper levels of all trees come from a bounded sample of
words (``SAMPLE_WORDS``); their leaves are cells, and a word is sent to the cells whose boxes it can
reach.  In a cell a k-d tree with tight boxes is searched for all words at once, node by node.  Words in
a leaf are compared by their counts, and pairs that are near by counts by their letters in order.
Cells with more than ``CELL_WORDS`` words, or words that search them, are split, and every part of one
side meets every part of the other.

Each pair is found once; a task returns, for each word it has found a neighbour for, their number and
the best one, so that no list of pairs is ever put together.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, work_dir, written

RUN = r"[A-Za-zÀ-ÿ]"
BINS = 32
SAMPLE_WORDS = 20_000
#: Sample words in a leaf of the upper levels at least; words in a cell and in a leaf of its tree at most.
SAMPLE_LEAF = 32
CELL_WORDS = 8192
ASKED_WORDS = 65_536
LEAF_WORDS = 32


def runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``id, run``: the maximal runs of Latin letters of at least so many code points, A to Z in lower case.  Null
    texts have none."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    run = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(
        F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return pick(docs, id_col, text_col).toDF("id", "text").select("id", F.explode(found).alias("run")).select(
        "id", run.alias("run"))


def with_typos(run: Column, doc_id: Column, every: int = 97) -> Column:
    """The run, without one of its letters where ``every`` divides the crc32 h of ``<doc_id>:<run>``: that at place
    h modulo the length.  A null id counts as empty."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.left(run, at), F.substr(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of the words (column ``word``) with at least so many code points and occurrences."""
    return (words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and the words' lengths."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, np.fromiter(map(len, words), np.int64, len(words))


def deal(words: list[str]) -> dict[int, int]:
    """Code point to bin: the most frequent first, each into the lightest bin so far."""
    codes, n = np.unique(letters(words)[0], return_counts=True)
    load, out = [0] * BINS, {}
    for k in sorted(range(len(codes)), key=lambda i: (-n[i], codes[i])):
        out[int(codes[k])] = at = load.index(min(load))
        load[at] += int(n[k])
    return out


def vectors(words: list[str], bins: dict[int, int]) -> np.ndarray:
    """Letter counts by bin (letters that the bins do not know: by their code point), at most 255 a bin."""
    raw, sizes = letters(words)
    codes, inverse = np.unique(raw, return_inverse=True)
    dealt = np.array([bins.get(int(c), int(c) % BINS) for c in codes], np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    return np.minimum(np.bincount(row * BINS + dealt[inverse], minlength=len(words) * BINS), 255).reshape(
        len(words), BINS).astype(np.int16)


def split(v: np.ndarray) -> tuple[int, int] | None:
    """The bin and the count at which a set of vectors is cut nearest to its middle; None if all are equal."""
    best = None
    for d in np.argsort(-v.var(axis=0), kind="stable")[:4]:
        values, n = np.unique(v[:, d], return_counts=True)
        if len(values) > 1:
            below = np.cumsum(n)[:-1]
            k = int(np.argmin(np.abs(below - len(v) / 2)))
            off = abs(int(below[k]) - len(v) / 2)
            if best is None or off < best[0]:
                best = off, int(d), int(values[k])
    return best and best[1:]


def upper_tree(v: np.ndarray, first: int) -> tuple[list, int]:
    """Nodes of the upper levels over sample vectors, children behind parents: (bin, cut, low, high) of inner nodes,
    the number of the cell of leaves; and the next free number of a cell."""
    nodes: list = []

    def grow(part: np.ndarray) -> int:
        nonlocal first
        at = len(nodes)
        cut = split(part) if len(part) >= 2 * SAMPLE_LEAF else None
        if cut is None:
            nodes.append(first)
            first += 1
            return at
        nodes.append(None)
        low = part[:, cut[0]] <= cut[1]
        nodes[at] = (*cut, grow(part[low]), grow(part[~low]))
        return at
    grow(v)
    return nodes, first


def cells_of(nodes: list, v: np.ndarray, up: int, down: int) -> list[tuple[np.ndarray, int]]:
    """(rows, cell): the cells that vectors reach with at most so many counts up and down (0, 0: their own)."""
    out = []
    room = np.full((len(v), BINS), 0, np.int16)  # what each bin has been raised or lowered by, to stay in a box

    def walk(at: int, rows: np.ndarray, moved: np.ndarray) -> None:
        if not len(rows):
            return
        node = nodes[at]
        if not isinstance(node, tuple):
            out.append((rows, node))
            return
        d, cut, low, high = node
        here = v[rows, d] + moved[:, d]
        for child, target in ((low, np.minimum(here, cut)), (high, np.maximum(here, cut + 1))):
            new = moved.copy()
            new[:, d] = target - v[rows, d]
            ok = (np.maximum(new, 0).sum(axis=1) <= up) & (np.maximum(-new, 0).sum(axis=1) <= down)
            walk(child, rows[ok], new[ok])
    walk(0, np.arange(len(v)), room)
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced (equal lengths) or one inserted letter (b longer by one)."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :n], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= n


def near_pairs(asked: list[str], base: list[str], bins: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of words one edit apart, base words all of one length, asked ones of that length or all one
    shorter.  Of equal lengths only pairs in ascending order of the words."""
    same = len(asked[0]) == len(base[0])
    up, down = 1, int(same)
    va, vb = vectors(asked, bins), vectors(base, bins)
    ca, cb = letters(asked)[0].reshape(len(asked), -1), letters(base)[0].reshape(len(base), -1)

    def code(v: np.ndarray) -> np.ndarray:  # counts up to four as as many bits: the bits that differ are the distance
        bits = ((1 << np.minimum(v, 4).astype(np.uint64)) - np.uint64(1)).reshape(len(v), 2, 16)
        return (bits << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    ta, tb = code(va), code(vb)
    out_i, out_j = [], []

    def leaf(rows: np.ndarray, words: np.ndarray) -> None:
        for s in range(0, len(rows), 4096):
            r = rows[s:s + 4096]
            far = sum(np.bitwise_count(ta[r, k][:, None] ^ tb[words, k][None, :]) for k in (0, 1))
            i, j = np.nonzero(far <= up + down)
            i, j = r[i], words[j]
            ok = one_edit(ca[i], cb[j])
            out_i.append(i[ok])
            out_j.append(j[ok])
    stack = [(np.arange(len(va)), np.arange(len(vb)))]
    while stack:
        rows, words = stack.pop()
        box = vb[words]
        below = np.maximum(box.min(axis=0) - va[rows], 0).sum(axis=1)
        above = np.maximum(va[rows] - box.max(axis=0), 0).sum(axis=1)
        rows = rows[(below <= up) & (above <= down)]
        if not len(rows):
            continue
        cut = split(box) if len(words) > LEAF_WORDS else None
        if cut is None:
            leaf(rows, words)
        else:
            low = box[:, cut[0]] <= cut[1]
            stack += [(rows, words[low]), (rows, words[~low])]
    i, j = np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])
    if same:
        a, b = np.array(asked, dtype=str), np.array(base, dtype=str)
        ok = a[i] < b[j]
        i, j = i[ok], j[ok]
    return i, j


def _best_found(bins: dict[int, int]):
    """cogroup function: of a cell's words and those that search it, every word with a neighbour: their number and
    the best one."""
    search = near_pairs

    def run(asked: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cell, held in base.groupby("cell", sort=False):  # words of one length
            wb, nb = held["word"].tolist(), held["n"].to_numpy()
            for _, part in asked[asked["cell"] == cell].groupby("size", sort=False):
                wa, na = part["word"].tolist(), part["n"].to_numpy()
                i, j = search(wa, wb, bins)
                wa_, wb_ = np.array(wa, dtype=object), np.array(wb, dtype=object)
                out.append(pd.DataFrame({"word": np.concatenate((wa_[i], wb_[j])), "near": np.concatenate((wb_[j], wa_[i])),
                                         "near_n": np.concatenate((nb[j], na[i]))}))
        if not out:
            return pd.DataFrame({"word": [], "n_near": [], "near": [], "near_n": []})
        pairs = pd.concat(out).sort_values(["word", "near_n", "near"], ascending=[True, False, True])
        first = pairs.drop_duplicates("word")
        return first.assign(n_near=pairs.groupby("word", sort=True).size().to_numpy())[["word", "n_near", "near", "near_n"]]
    return run


def neighbours(words: DataFrame, root: str) -> DataFrame:
    """``word, n_near, near, near_n`` of the words (``word, n``, each once) that have a neighbour: how many, and the
    one with the largest n (ties: the smallest in code-point order)."""
    src = words.select("word", "n", F.char_length("word").alias("size"))
    some = [r["word"] for r in src.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).select("word").collect()]
    bins = deal(some)
    by_size: dict[int, list] = {}
    for w in sorted(some):
        by_size.setdefault(len(w), []).append(w)
    trees, n_cells = {}, 0
    for k in sorted(by_size):
        trees[k], n_cells = upper_tree(vectors(by_size[k], bins), n_cells)
    to_vectors, reach = vectors, cells_of

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, size = b.column("word").to_pylist(), b.column("size").to_numpy()
            n = b.column("n").to_numpy()
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                v = to_vectors([word[i] for i in at], bins)
                # a length that the sample has not seen is one cell of its own, below zero
                for asks, length, up, down in ((False, k, 0, 0), (True, k, 1, 1), (True, k + 1, 1, 0)):
                    for rows, cell in reach(trees.get(length, [-length]), v, up, down):
                        r = at[rows]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([word[i] for i in r], pa.string()), pa.array(n[r]), pa.array(np.full(len(r), k, np.int32)),
                             pa.array(np.full(len(r), cell, np.int64)), pa.array([asks] * len(r), pa.bool_())],
                            names=["word", "n", "size", "cell", "asks"])
    sent = written(src.mapInArrow(send, "word string, n long, size int, cell long, asks boolean"), f"{root}/sent")
    parts = (sent.groupBy("cell").agg(F.ceil(F.count_if(~F.col("asks")) / CELL_WORDS).alias("rows"),
                                      F.ceil(F.count_if("asks") / ASKED_WORDS).alias("columns")).where("rows > 0"))
    parts = written(parts, f"{root}/cells")
    spot = F.xxhash64("word")
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    base = (sent.where("not asks").join(parts, "cell").withColumn("i", F.pmod(spot, F.col("rows"))).withColumn("j", to("columns"))
            .select("cell", "i", "j", "word", "n"))
    again = words.sparkSession.read.schema(sent.schema).parquet(f"{root}/sent")  # column ids of its own for the cogroup
    asked = (again.where("asks").join(parts.select(*[F.col(c).alias(c) for c in parts.columns]), "cell")
             .withColumn("j", F.pmod(spot, F.col("columns"))).withColumn("i", to("rows"))
             .select("cell", "i", "j", "word", "n", "size"))
    found = asked.groupBy("cell", "i", "j").cogroup(base.groupBy("cell", "i", "j")).applyInPandas(
        _best_found(bins), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of words with counts (``word, n``).

    Near words differ by one inserted, deleted or replaced code point.  ``form`` is the near word of largest
    count, ties to the smallest in code-point order, if its count is at least ``times`` (2 or more, so that forms
    cannot go round) the word's; ``root`` is where the forms end, the word itself without one.
    Repeated words are added up; null words and counts take no part; an empty table gives no rows."""
    if times < 2:
        raise ValueError("times must be 2 or more")
    root = work_dir(words.sparkSession, "spelling")
    once = pick(words, "word", "n").where("word is not null and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    once = written(once, f"{root}/words")
    near = neighbours(once, root)
    fits = F.col("near_n") >= F.col("n") * times
    out = written(once.join(near, "word", "left").select(
        "word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("near_n")).alias("form_n")), f"{root}/forms")
    ends = out.where("form is not null").select("word", F.col("form").alias("last"))
    step = 0
    while True:  # every step doubles how far a word has followed its forms
        far = ends.select(F.col("word").alias("last"), F.col("last").alias("next"))
        ends = written(ends.join(far, "last", "left").select("word", F.coalesce("next", "last").alias("last"),
                                                             F.col("next").isNotNull().alias("on")), f"{root}/roots-{step}")
        if ends.where("on").isEmpty():
            break
        ends, step = ends.drop("on"), step + 1
    return out.join(ends.select("word", "last"), "word", "left").select(
        "word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
