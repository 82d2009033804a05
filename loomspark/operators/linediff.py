"""Line diffs as a Spark job (F27): which lines two versions of a file differ in.

Lines travel as rows of 64-bit hashes; no file is ever one Python value.

1. *Anchors* are lines that occur once on either side (a grouping by file and line).  Anchors that follow
   one another on both sides are merged into blocks with windows, so there are about as many blocks
   as changes.
2. Of the blocks those that keep their order are chosen: all, where none moved, else the heaviest chain, in one
   small task per file over the blocks' places alone.
3. Lines between chosen blocks are gaps.  A gap whose sides have no line in common is changed whole.  Only the
   others are compared line by line, about ``BUCKET_LINES`` lines of gaps in a call: common ends first, then the
   longest common subsequence, in one way for gaps of any size (rows of bits in a band that widens until no
   longest one can lie outside; some hundred rows are held at a time).
4. Changed lines meet their texts again by file and number.
"""
from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stored

#: Pairs of lines that ``changed`` holds in one table.
GAP_CELLS = 4_000_000
#: Lines of a gap that share a window of the other side, and parts that a gap is walked in at each level.
BLOCK_ROWS, PARTS = 256, 64
#: How far the first band goes to either side.
BAND = 256
#: Lines of gaps that go to one Python call (about; a gap stays together).
BUCKET_LINES = 20_000
# fixed values: what ends a line
LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def lines_of(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, no, line``: the lines of each file from 1, without their ends; no line after a last end."""
    parts = F.split(F.col(content), LINE_ENDS, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return files.where(F.col(content).isNotNull()).select(key, F.posexplode(parts).alias("no", "line")).select(
        key, (F.col("no") + 1).cast("long").alias("no"), "line")


def heaviest_chain(right: np.ndarray, size: np.ndarray) -> list[int]:
    """Of blocks in the order of their left places, those whose right places ascend and whose sizes add up to most."""
    order = np.sort(right)
    best: list[tuple[int, int]] = [(0, -1)] * (len(right) + 1)  # a tree of prefix maxima over the ranks of right places
    before = [-1] * len(right)
    top = (0, -1)
    for i, (r, n) in enumerate(zip(right, size)):
        rank = bisect_left(order, r)
        k, got = rank, (0, -1)
        while k > 0:
            got = max(got, best[k])
            k -= k & -k
        before[i], now = got[1], (got[0] + int(n), i)
        top = max(top, now)
        k = rank + 1
        while k <= len(right):
            best[k] = max(best[k], now)
            k += k & -k
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("l0")
    kept = group.iloc[heaviest_chain(group["r0"].to_numpy(), group["size"].to_numpy())][["file", "l0", "r0", "size"]]
    return kept.astype({"file": object})


def changed(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places in two sequences that a longest common subsequence leaves out, from a table of every pair (all between common
    ends, if they have more than ``GAP_CELLS`` pairs).  The plain form that tests hold ``changed_places`` against;
    no query uses it."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    left, right = list(range(head, head + n)), list(range(head, head + m))
    if not n or not m or n * m > GAP_CELLS:
        return left, right
    x, y = np.array(a[head:head + n]), np.array(b[head:head + m])
    table = np.zeros((n + 1, m + 1), np.int32)  # of the rests of both
    for i in range(n - 1, -1, -1):
        row = np.where(y == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    keep_l, keep_r, i, j = set(), set(), 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            keep_l.add(head + i)
            keep_r.add(head + j)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return [k for k in left if k not in keep_l], [k for k in right if k not in keep_r]


def _common(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in ``x`` and ``y`` (codes from 0, not empty) of a longest common subsequence: the one that ``changed`` finds.

    Both are read from their ends.  A bit of a row says that a column adds nothing to the longest common subsequence
    so far (Hyyrö's rows), the carries of its sum are the columns where the row adds a line.  Rows only meet the columns of a
    band; it is wide enough when no more lines of the shorter side are left out than it goes to either side.
    The way back takes rows again from those kept at each part's begin."""
    n, m = len(x), len(y)
    order = np.argsort(y[::-1], kind="stable")
    starts = np.searchsorted(y[::-1][order], np.arange(max(x.max(), y.max()) + 2)).tolist()
    x, y, places = x[::-1].tolist(), y[::-1].tolist(), order.tolist()

    def mask(code: int, s: int, e: int) -> int:
        at, to = starts[code], starts[code + 1]
        at, to = bisect_left(places, s, at, to), bisect_left(places, e, at, to)
        if to - at <= 8:
            return sum(1 << p - s for p in places[at:to])
        bits = np.zeros(e - s, bool)
        bits[order[at:to] - s] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def moved(row: int, s: int, e: int, s1: int, e1: int) -> int:
        """A row of the columns from ``s`` to ``e`` as one from ``s1`` to ``e1``; new columns add nothing yet."""
        row = (row & ((1 << e - s) - 1)) >> s1 - s
        return row & ((1 << e1 - s1) - 1) if e1 <= e else row | ((1 << e1 - s1) - (1 << e - s1))

    def through(row: int, block: tuple, end: int, carries: list | None = None) -> int:
        """The row after a block, of the columns before ``end``."""
        first, last, s, e = block
        masks: dict[int, int] = {}
        for code in x[first:last]:
            if code not in masks:
                masks[code] = mask(code, s, min(e, end))
            met = row & masks[code]
            total, rest = row + met, row ^ met
            if carries is not None:
                carries.append(total ^ rest)
            row = total | rest
        return row

    def after(row: int, blocks: list, then: tuple, end: int) -> int:
        """The row that the block ``then`` begins with, from the one that the first of the blocks before it begins with."""
        for block, (_, _, s1, e1) in zip(blocks, [*blocks[1:], then]):
            row = moved(through(row, block, end), block[2], min(block[3], end), s1, min(e1, end))
        return row

    wide = BAND
    while True:
        low, high = min(0, m - n) - wide, max(0, m - n) + wide
        blocks = [(i, min(i + BLOCK_ROWS, n), max(0, i + low), min(m, i + BLOCK_ROWS + high)) for i in range(0, n, BLOCK_ROWS)]
        begin = (1 << blocks[0][3]) - 1
        if wide >= max(n, m):
            break
        row, length = begin, 0
        for block, (_, _, s1, e1) in zip(blocks, [*blocks[1:], (n, n, m, m)]):
            row = through(row, block, m)
            length += s1 - block[2] - (row & ((1 << s1 - block[2]) - 1)).bit_count()
            row = moved(row, block[2], block[3], s1, e1)
        left_out = min(n, m) - length
        if left_out <= wide:
            break
        wide = min(4 * wide, left_out)

    kept_x, kept_y, j = [], [], m

    def back(blocks: list, row: int) -> None:
        nonlocal j
        if len(blocks) > 1:
            step = -(-len(blocks) // PARTS)
            parts = [blocks[k:k + step] for k in range(0, len(blocks), step)]
            rows = [row]
            for part, then in zip(parts, parts[1:]):
                rows.append(after(rows[-1], part, then[0], j))
            while parts and j:
                part, row = parts.pop(), rows.pop()
                back(part, moved(row, part[0][2], part[0][3], part[0][2], min(part[0][3], j)))
            return
        (i0, i, s, _), carries = blocks[0], []
        through(row, blocks[0], j, carries)
        while i > i0 and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                kept_x.append(n - 1 - i)
                kept_y.append(m - 1 - j)
            elif carries[i - 1 - i0] >> j - s & 1:  # the row's line is one of them: the next like it
                code = x[i - 1]
                j = places[bisect_left(places, j, starts[code], starts[code + 1]) - 1] + 1
            else:
                i -= 1
    back(blocks, begin)
    return kept_x, kept_y


def changed_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sequences of any length that a longest common subsequence leaves out."""
    def alike(p: np.ndarray, q: np.ndarray) -> int:
        k = min(len(p), len(q))
        other = p[:k] != q[:k]
        return int(other.argmax()) if other.any() else k
    head = alike(a, b)
    tail = alike(a[head:][::-1], b[head:][::-1])
    out = [np.arange(head, len(a) - tail), np.arange(head, len(b) - tail)]
    x, y = a[out[0]], b[out[1]]
    both = np.intersect1d(x, y)
    if not len(both):
        return out[0], out[1]
    in_x, known = np.flatnonzero(np.isin(x, both)), np.isin(y, both)
    code = np.where(known, np.searchsorted(both, y), len(both))
    in_y = np.flatnonzero(known | np.append(True, known[:-1]))  # of lines in a row that only y has the first
    kept = _common(np.searchsorted(both, x[in_x]), code[in_y])
    return np.delete(out[0], in_x[kept[0]]), np.delete(out[1], in_y[kept[1]])


def _gap_changes(bucket: pd.DataFrame) -> pd.DataFrame:
    """The changed lines of gaps, from their rows (file, gap, side, no, h): ``file, op, no``."""
    bucket = bucket.sort_values(["file", "gap", "side", "no"], ignore_index=True)
    file, gap, new = bucket["file"], bucket["gap"], bucket["side"].to_numpy() == 1
    h = bucket["h"].to_numpy()
    ends = np.flatnonzero(((file != file.shift(-1)) | (gap != gap.shift(-1))).to_numpy()) + 1
    keep = np.zeros(len(bucket), bool)
    for first, last in zip([0, *ends], ends):
        split = first + int(np.searchsorted(new[first:last], True))
        gone, come = changed_places(h[first:split], h[split:last])
        keep[first + gone] = True
        keep[split + come] = True
    out = bucket[keep]
    return pd.DataFrame({"file": out["file"], "op": np.where(new[keep], "+", "-"), "no": out["no"]}).astype(
        {"file": object, "op": object, "no": "int64"})


def line_changes(old: DataFrame, new: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """``key, op, no, line``: the lines (``key, no, line``, numbered from 1) that only ``old`` (op -) or ``new`` (op +)
    has; what is not listed is common to both, in order.  ``files`` (column ``key``) names the files to compare, by default
    those with a line on both sides; equal files have no rows, null keys take no part.  Lines are compared by
    64-bit hashes."""
    def hashed(side: DataFrame) -> DataFrame:
        return side.select(F.col(key).alias("file"), "no", F.xxhash64("line").alias("h")).where("file is not null")
    if files is None:
        both = hashed(old).select("file").distinct().join(hashed(new).select("file").distinct(), "file")
    else:
        both = files.select(F.col(key).alias("file")).distinct()
    l_, r_ = (cut_lineage(hashed(s).join(both, "file", "left_semi")) for s in (old, new))
    tagged = l_.withColumn("side", F.lit(0)).unionByName(r_.withColumn("side", F.lit(1)))
    once = lambda s: F.count_if(F.col("side") == s) == 1
    place = lambda s: F.max(F.when(F.col("side") == s, F.col("no")))
    anchors = tagged.groupBy("file", "h").agg(once(0).alias("a"), once(1).alias("b"), place(0).alias("l"), place(1).alias("r"))
    by_left = Window.partitionBy("file").orderBy("l")
    begins = ~F.coalesce((F.lag("l").over(by_left) == F.col("l") - 1) & (F.lag("r").over(by_left) == F.col("r") - 1), F.lit(False))
    blocks = (anchors.where("a and b").withColumn("begins", begins)
              .withColumn("block", F.sum(F.col("begins").cast("int")).over(by_left))
              .groupBy("file", "block").agg(F.min("l").alias("l0"), F.min("r").alias("r0"), F.count(F.lit(1)).alias("size")))
    kind = old.schema[key].dataType.simpleString()
    back = F.coalesce(F.lag("r0").over(Window.partitionBy("file").orderBy("l0")) > F.col("r0"), F.lit(False))
    blocks = cut_lineage(blocks.withColumn("back", back).withColumn("moved", F.max("back").over(Window.partitionBy("file"))))
    chosen = cut_lineage(blocks.where("not moved").select("file", "l0", "r0", "size").unionByName(
        blocks.where("moved").groupBy("file").applyInPandas(_chosen, f"file {kind}, l0 long, r0 long, size long")))

    def gaps(side: DataFrame, start: str) -> DataFrame:
        """Lines outside the chosen blocks with the number of blocks before them."""
        marks = chosen.select("file", F.col(start).alias("no"), "size", F.lit(None).cast("long").alias("h"))
        rows = side.select("file", "no", F.lit(None).cast("long").alias("size"), "h").unionByName(marks.select("file", "no", "size", "h"))
        upto = Window.partitionBy("file").orderBy("no", F.col("size").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        rows = (rows.withColumn("gap", F.count("size").over(upto))
                .withColumn("end", F.last(F.when(F.col("size").isNotNull(), F.col("no") + F.col("size")), ignorenulls=True).over(upto)))
        return rows.where("size is null and (end is null or no >= end)").select("file", "gap", "no", "h")
    both_sides = stored(gaps(l_, "l0").withColumn("side", F.lit(0)).unionByName(gaps(r_, "r0").withColumn("side", F.lit(1))))
    common = (both_sides.groupBy("file", "gap", "h").agg(F.min("side").alias("s0"), F.max("side").alias("s1"))
              .where("s0 <> s1").select("file", "gap").distinct())
    whole = both_sides.join(common, ["file", "gap"], "left_anti").select("file", F.when(F.col("side") == 0, "-").otherwise("+").alias("op"), "no")
    mixed = stored(both_sides.join(common, ["file", "gap"], "left_semi"))
    bucket = F.pmod(F.xxhash64("file", "gap"), F.lit(1 + mixed.count() // BUCKET_LINES)).alias("bucket")
    found = whole.unionByName(mixed.groupBy(bucket).applyInPandas(_gap_changes, f"file {kind}, op string, no long"))
    text = (old.select(F.col(key).alias("file"), "no", "line", F.lit("-").alias("op"))
            .unionByName(new.select(F.col(key).alias("file"), "no", "line", F.lit("+").alias("op"))))
    return found.join(text, ["file", "op", "no"]).select(F.col("file").alias(key), "op", "no", "line")


def change_counts(changes: DataFrame, key: str) -> DataFrame:
    """``key, removed, added``: how many lines of each changed file are gone and new."""
    count: Column = F.count_if(F.col("op") == "-")
    return changes.groupBy(key).agg(count.alias("removed"), F.count_if(F.col("op") == "+").alias("added"))
