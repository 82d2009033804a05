"""Three-way reconcile of code inventories and folder comparison
(F2, A15, J3, J10, J11, P6, F12, A2, A6, Q4–Q7, A4, U1–U3).

Design: instead of two full outer joins, the three inventories (and the
acknowledgements) are tagged and unioned, then grouped once by logical name.  The
grouping is map-side combined, so a name that appears millions of times costs one
partial row per map task.  Only 256-bit content hashes travel through the shuffle;
file bodies move again only for the pairs that differ (for the text diff).
"""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage, stored
from .linediff import line_changes, lines_of
from ..functions.names import normalise_name, path_suffix

# fixed values: reconcile statuses in report order
STATUSES = ("in_sync", "content_drift", "schema_drift", "undeclared", "not_deployed",
            "no_source", "git_only", "gcs_orphan", "mapping_ghost", "bq_missing")
CRITICAL_STATUSES = ("content_drift", "not_deployed", "no_source", "mapping_ghost")
WARNING_GROUP = ("undeclared", "not_deployed", "gcs_orphan", "git_only", "bq_missing")
CRITICAL_GROUP = ("content_drift", "schema_drift", "no_source", "mapping_ghost")
# fixed values: suffixes compared by content in the folder comparison
TEXT_SUFFIXES = (".sql", ".py", ".yaml", ".yml", ".json", ".txt", ".sh")
#: Drifted paths that are sent to every executor at most (some MB); of more, bodies meet them by a shuffle.
BROADCAST_PATHS = 100_000


def trimmed_hash(content) -> "F.Column":
    """sha-256 of the content with leading/trailing whitespace removed (str.strip rules)."""
    from ..functions.sqltext import py_strip
    c = F.col(content) if isinstance(content, str) else content
    return F.sha2(py_strip(c), 256)


def with_logical_name(df: DataFrame, raw: str = "raw_name", overrides: DataFrame | None = None) -> DataFrame:
    """Add ``logical_name``: an explicit override (raw → logical) wins, else F2."""
    if overrides is None:
        return df.withColumn("logical_name", normalise_name(raw))
    o = overrides.select(F.col("raw_name").alias("_raw"), F.col("logical_name").alias("_ovr"))
    return (df.join(o, df[raw] == o["_raw"], "left")
            .withColumn("logical_name", normalise_name(raw, "_ovr")).drop("_raw", "_ovr"))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` (dict-building semantics)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def reconcile(git: DataFrame, gcs: DataFrame, mapping: DataFrame, acks: DataFrame | None = None,
              scope: str = "all", folder_filter: str | None = None,
              overrides: DataFrame | None = None) -> DataFrame:
    """One finding per logical name in git ∪ gcs ∪ mapping.

    Inputs: git/gcs (raw_name, seq, content), mapping (raw_name, seq, bq_table),
    acks (logical_name).  ``seq`` orders duplicates: the last one wins.
    """
    def tag(df, src, hashed):
        d = with_logical_name(df, overrides=overrides)
        cols = [F.col("logical_name"), F.lit(src).alias("src"), F.col("seq")]
        if hashed:
            cols += [trimmed_hash("content").alias("h"),
                     (F.col("content").isNotNull() & (F.length("content") > 0)).alias("nonempty"),
                     F.lit(None).cast("string").alias("bq_table")]
        else:
            cols += [F.lit(None).cast("string").alias("h"), F.lit(None).cast("boolean").alias("nonempty"),
                     F.col("bq_table")]
        return d.select(*cols)

    parts = [tag(git, "git", True), tag(gcs, "gcs", True), tag(mapping, "map", False)]
    if acks is not None:
        parts.append(acks.select("logical_name", F.lit("ack").alias("src"), F.lit(None).cast("long").alias("seq"),
                                 F.lit(None).cast("string").alias("h"), F.lit(None).cast("boolean").alias("nonempty"),
                                 F.lit(None).cast("string").alias("bq_table")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)

    def last(src, field):
        is_src = F.col("src") == src
        return F.max_by(F.when(is_src, F.col(field)), F.when(is_src, F.col("seq")))

    g = u.groupBy("logical_name").agg(
        F.max(F.col("src") == "git").alias("in_git"),
        F.max(F.col("src") == "gcs").alias("in_gcs"),
        F.max(F.col("src") == "map").alias("in_mapping"),
        F.max(F.col("src") == "ack").alias("acknowledged"),
        last("git", "h").alias("git_h"), last("git", "nonempty").alias("git_ne"),
        last("gcs", "h").alias("gcs_h"), last("gcs", "nonempty").alias("gcs_ne"),
        last("map", "bq_table").alias("bq_table"))
    g = g.where(F.col("in_git") | F.col("in_gcs") | F.col("in_mapping"))
    if folder_filter:
        g = g.where(F.col("logical_name").contains(folder_filter.lower()))
    scopes = {"git_gcs": ("in_git", "in_gcs"), "git_mapping": ("in_git", "in_mapping"),
              "gcs_mapping": ("in_gcs", "in_mapping")}
    if scope in scopes:
        a, b = scopes[scope]
        g = g.where(F.col(a) & F.col(b))
    gi, gc, gm = F.col("in_git"), F.col("in_gcs"), F.col("in_mapping")
    synced = F.coalesce(F.col("git_ne"), F.lit(False)) & F.coalesce(F.col("gcs_ne"), F.lit(False)) \
        & (F.col("git_h") == F.col("gcs_h"))
    status = (F.when(gm & (F.coalesce(F.col("bq_table"), F.lit("")) == ""), F.lit("bq_missing"))
              .when(gi & gc & gm, F.when(synced, F.lit("in_sync")).otherwise(F.lit("content_drift")))
              .when(gi & gc, F.lit("undeclared"))
              .when(gi & gm, F.lit("not_deployed"))
              .when(gc & gm, F.lit("no_source"))
              .when(gi, F.lit("git_only"))
              .when(gc, F.lit("gcs_orphan"))
              .otherwise(F.lit("mapping_ghost")))
    ack = F.coalesce(F.col("acknowledged"), F.lit(False))
    return g.select(
        "logical_name", status.alias("status"), ack.alias("acknowledged"),
        "in_git", "in_gcs", "in_mapping", F.coalesce(F.col("bq_table"), F.lit("")).alias("bq_table"),
    ).withColumn("critical", F.col("status").isin(*CRITICAL_STATUSES) & ~F.col("acknowledged"))


def status_summary(findings: DataFrame) -> DataFrame:
    """Count per status for all ten statuses (zero-filled); acknowledged findings count."""
    spark = findings.sparkSession
    statuses = spark.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "pos int, status string")
    counts = findings.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # the status list is a fixed ten-row table
    return (F.broadcast(statuses).join(counts, "status", "left")
            .select("status", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def finding_groups(findings: DataFrame) -> DataFrame:
    """One row: in_sync, warnings, critical (by status group), critical_open, total."""
    return findings.agg(
        F.count_if(F.col("status") == "in_sync").cast("long").alias("in_sync"),
        F.count_if(F.col("status").isin(*WARNING_GROUP)).cast("long").alias("warnings"),
        F.count_if(F.col("status").isin(*CRITICAL_GROUP)).cast("long").alias("critical"),
        F.count_if(F.col("critical")).cast("long").alias("critical_open"),
        F.count(F.lit(1)).cast("long").alias("total"))


def distinct_statuses(findings: DataFrame) -> DataFrame:
    return findings.select("status").distinct().orderBy("status")


def filter_status(findings: DataFrame, status: str = "All") -> DataFrame:
    return findings if status == "All" else findings.where(F.col("status") == status)


def acknowledge(store: DataFrame, names: DataFrame, reason: str, at=None) -> DataFrame:
    """Upsert acknowledgements by normalised name; the newest entry per name wins."""
    new = names.select(normalise_name("raw_name").alias("logical_name"), F.lit(reason).alias("reason"),
                       (at if at is not None else F.current_timestamp()).alias("acknowledged_at"))
    both = store.select("logical_name", "reason", "acknowledged_at").unionByName(new)
    return last_wins(both, ["logical_name"], "acknowledged_at")


# ── folder comparison ──────────────────────────────────────────────────────────

def _relative(df: DataFrame, folder: str | None, path: str) -> DataFrame:
    prefix = (folder or "").rstrip("/")
    prefix = prefix + "/" if prefix else ""
    d = df
    if prefix:
        d = d.where(F.col(path).startswith(prefix))
    return d.withColumn("rel_path", F.substring(F.col(path), len(prefix) + 1, 1 << 30)).where(F.col("rel_path") != "")


def compare_folders(git: DataFrame, gcs: DataFrame, folder: str | None = None,
                    file_name: str | None = None, path: str = "path", order: str = "seq") -> DataFrame:
    """Per relative path: only_in_git / only_in_gcs / identical / different.

    Common paths with a non-text suffix are identical without reading; otherwise
    missing content on either side → different (with a note), else exact equality.
    ``file_name`` keeps only that direct child of the folder."""
    def side(df, src):
        d = _relative(df, folder, path)
        if file_name is not None:
            d = d.where(F.col("rel_path") == file_name)
        return d.select("rel_path", F.lit(src).alias("src"), F.col(order).alias("seq"),
                        F.sha2(F.col("content"), 256).alias("h"),
                        F.octet_length("content").cast("long").alias("size"))

    u = side(git, "git").unionByName(side(gcs, "gcs"))

    def last(src, field):
        is_src = F.col("src") == src
        return F.max_by(F.when(is_src, F.col(field)), F.when(is_src, F.col("seq")))

    g = u.groupBy("rel_path").agg(
        F.max(F.col("src") == "git").alias("in_git"), F.max(F.col("src") == "gcs").alias("in_gcs"),
        last("git", "h").alias("git_h"), last("gcs", "h").alias("gcs_h"),
        last("git", "size").alias("git_size"), last("gcs", "size").alias("gcs_size"))
    text = F.lower(path_suffix("rel_path")).isin(*TEXT_SUFFIXES)
    missing = F.col("git_h").isNull() | F.col("gcs_h").isNull()
    status = (F.when(~F.col("in_gcs"), F.lit("only_in_git"))
              .when(~F.col("in_git"), F.lit("only_in_gcs"))
              .when(~text, F.lit("identical"))
              .when(missing, F.lit("different"))
              .when(F.col("git_h") == F.col("gcs_h"), F.lit("identical"))
              .otherwise(F.lit("different")))
    note = F.when(F.col("in_git") & F.col("in_gcs") & text & missing,
                  F.lit("Could not fetch content for comparison"))
    return g.select("rel_path", status.alias("status"), "git_size", "gcs_size",
                    (F.col("gcs_size") - F.col("git_size")).alias("size_delta"), note.alias("note"))


def compare_summary(cmp: DataFrame) -> DataFrame:
    return cmp.agg(
        *[F.count_if(F.col("status") == s).cast("long").alias(s)
          for s in ("only_in_git", "only_in_gcs", "identical", "different")],
        F.count_if(F.col("status") != "only_in_gcs").cast("long").alias("total_git"),
        F.count_if(F.col("status") != "only_in_git").cast("long").alias("total_gcs"))


@F.pandas_udf(StringType())
def _unified_diff(a: pd.Series, b: pd.Series, name: pd.Series) -> pd.Series:
    import difflib
    out = []
    for x, y, n in zip(a, b, name):
        if x is None or y is None:
            out.append(None)
            continue
        out.append("".join(difflib.unified_diff(x.splitlines(keepends=True), y.splitlines(keepends=True),
                                                fromfile=f"git/{n}", tofile=f"gcs/{n}")))
    return pd.Series(out, dtype=object)


def diff_pairs(keys: DataFrame, left: DataFrame, right: DataFrame, key: str,
               content: str = "content") -> DataFrame:
    """Unified diff for the given keys only; bodies are joined to the (few) drifted keys,
    so unchanged files never leave their scan."""
    l_ = left.select(F.col(key), F.col(content).alias("_a"))
    r_ = right.select(F.col(key), F.col(content).alias("_b"))
    pairs = keys.select(key).distinct().join(l_, key).join(r_, key)
    return pairs.select(key, _unified_diff("_a", "_b", F.col(key)).alias("unified_diff"))


def _drifted_bodies(side: DataFrame, drifted: DataFrame, folder: str | None) -> DataFrame:
    """The winning row of each drifted path, found without bodies; only these rows' bodies are joined, once."""
    rows = _relative(side, folder, "path")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_PATHS else df
    win = stored(rows.select("rel_path", "seq").join(few(drifted), "rel_path", "left_semi")
                 .groupBy("rel_path").agg(F.max("seq").alias("seq")))
    return rows.select("rel_path", "seq", "content").join(few(win), ["rel_path", "seq"]).dropDuplicates(["rel_path"])


def folder_diffs(git: DataFrame, gcs: DataFrame, cmp: DataFrame, folder: str | None = None) -> DataFrame:
    """Unified diffs, as texts, for the 'different' paths that have content on both sides (each pair is one value of
    a Python call: for files of any size use ``folder_line_changes``)."""
    drifted = cut_lineage(cmp.where((F.col("status") == "different") & F.col("note").isNull()).select("rel_path"))
    return diff_pairs(drifted, _drifted_bodies(git, drifted, folder), _drifted_bodies(gcs, drifted, folder), "rel_path")


def folder_line_changes(git: DataFrame, gcs: DataFrame, cmp: DataFrame, folder: str | None = None) -> DataFrame:
    """``rel_path, op, no, line`` of the 'different' paths with content on both sides: their changed lines, as rows.
    Bodies are written, as they are read again for the texts of changed lines."""
    drifted = cut_lineage(cmp.where((F.col("status") == "different") & F.col("note").isNull()).select("rel_path"))
    old, new = (lines_of(stored(_drifted_bodies(side, drifted, folder)), "rel_path") for side in (git, gcs))
    return line_changes(old, new, "rel_path", drifted)


def reconcile_detail(git: DataFrame, gcs: DataFrame, mapping: DataFrame, names: DataFrame,
                     overrides: DataFrame | None = None) -> DataFrame:
    """For the requested logical names: the three records side by side plus the diff
    when both git and gcs hold the name."""
    def latest(df, cols):
        d = with_logical_name(df, overrides=overrides).join(names.select("logical_name"), "logical_name", "left_semi")
        return last_wins(d.select("logical_name", "seq", *cols), ["logical_name"], "seq")
    g = latest(git, ["raw_name", "path", "content"])
    c = latest(gcs, ["raw_name", "path", "content"])
    m = latest(mapping, ["raw_name", "bq_table"])
    both = g.select("logical_name", "content").join(c.select("logical_name", F.col("content").alias("c2")), "logical_name")
    diffs = both.select("logical_name", _unified_diff("content", "c2", F.col("logical_name")).alias("unified_diff"))
    return (names.select("logical_name")
            .join(g.select("logical_name", F.col("path").alias("git_path")), "logical_name", "left")
            .join(c.select("logical_name", F.col("path").alias("gcs_path")), "logical_name", "left")
            .join(m.select("logical_name", "bq_table"), "logical_name", "left")
            .join(diffs, "logical_name", "left"))
