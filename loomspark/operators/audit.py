"""Schema audit: source column metadata against target table schemas
(J1, A9, J2, F8–F10, O3, A3, A12, P9, K4, F36, Q3, Q20).

The reference loops over tables and fetches one target schema per table; here all
tables are audited in one pass.  The per-(table, column) full outer join is a tagged
union grouped once, so duplicate column names (last one wins) and very wide tables
are handled by map-side combining instead of a skewed join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..session import cut_lineage
from ..functions.names import quoted
from ..functions.types import (MATCH, SOURCE_ONLY, TARGET_ONLY, TYPE_MISMATCH, audit_status,
                               source_to_target_type)


def column_metadata(header: DataFrame, detail: DataFrame) -> DataFrame:
    """header ⋈ detail on table_name for streamed tables (is_streamed = 1)."""
    h = header.where(F.col("is_streamed") == 1).select("table_name", "deployed_to_prod")
    return detail.join(h, "table_name").select("table_name", "column_name", "ordinal_position",
                                                 "data_type", "deployed_to_prod")


def audit_tables(meta: DataFrame) -> DataFrame:
    """Distinct audited tables with their batch: prod iff deployed_to_prod = 1, else uat
    (null included)."""
    return (meta.select("table_name", "deployed_to_prod").dropDuplicates()
            .select("table_name", F.when(F.col("deployed_to_prod").eqNullSafe(1), "prod")
                    .otherwise("uat").alias("batch")).dropDuplicates())


def schema_audit(meta: DataFrame, target: DataFrame) -> DataFrame:
    """One row per (batch, table, column) over source ∪ target columns.

    meta: table_name, column_name, ordinal_position, data_type, deployed_to_prod
          (already restricted to streamed tables, see ``column_metadata``).
    target: table_name, column_name, ordinal_position, data_type, description.
    A table with no target schema yields only Source Only rows."""
    tables = audit_tables(meta)
    src = meta.select("table_name", "column_name", F.lit(True).alias("is_src"),
                      F.col("ordinal_position").cast("long").alias("ord"),
                      F.trim("data_type").alias("type"), F.lit(None).cast("string").alias("descr"))
    tgt = (target.join(tables.select("table_name").distinct(), "table_name", "left_semi")
           .select("table_name", "column_name", F.lit(False).alias("is_src"),
                   F.col("ordinal_position").cast("long").alias("ord"),
                   F.trim("data_type").alias("type"), F.coalesce("description", F.lit("")).alias("descr")))

    def last(is_src, field):
        cond = F.col("is_src") == is_src
        return F.max_by(F.when(cond, F.col(field)), F.when(cond, F.col("ord")))

    g = src.unionByName(tgt).groupBy("table_name", "column_name").agg(
        F.max(F.col("is_src")).alias("in_source"), F.max(~F.col("is_src")).alias("in_target"),
        F.max(F.when(F.col("is_src"), F.col("ord"))).alias("source_ordinal"),
        F.max(F.when(~F.col("is_src"), F.col("ord"))).alias("target_ordinal"),
        last(True, "type").alias("source_type"), last(False, "type").alias("actual_type"),
        last(False, "descr").alias("target_description"))
    expected = source_to_target_type(F.col("source_type"))
    rows = g.select(
        "table_name", "column_name", "source_ordinal", "target_ordinal",
        F.coalesce("source_type", F.lit("")).alias("source_type"),
        F.when(F.col("in_source"), expected).otherwise(F.lit("")).alias("expected_type"),
        F.coalesce("actual_type", F.lit("")).alias("actual_type"),
        F.coalesce("target_description", F.lit("")).alias("target_description"),
        audit_status("in_source", "in_target", expected, "actual_type").alias("status"))
    return tables.join(rows, "table_name")


def audit_order(audit: DataFrame) -> DataFrame:
    """Source columns by source ordinal, then target-only columns by target ordinal."""
    return audit.orderBy("batch", "table_name", F.col("source_ordinal").isNull(),
                         F.coalesce("source_ordinal", "target_ordinal"), "column_name")


def audit_findings(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("status") != MATCH)


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per batch: tables, total_columns and the count of each status, plus match_pct."""
    s = audit.groupBy("batch").agg(
        F.countDistinct("table_name").cast("long").alias("tables"),
        F.count(F.lit(1)).cast("long").alias("total_columns"),
        F.count_if(F.col("status") == MATCH).cast("long").alias("match"),
        F.count_if(F.col("status") == TYPE_MISMATCH).cast("long").alias("type_mismatch"),
        F.count_if(F.col("status") == TARGET_ONLY).cast("long").alias("target_only"),
        F.count_if(F.col("status") == SOURCE_ONLY).cast("long").alias("source_only"))
    return s.withColumn("match_pct", match_pct("match", "total_columns"))


def match_pct(match, total):
    m, t = F.col(match), F.col(total)
    return F.when(t > 0, F.round(m * 100.0 / t, 1)).otherwise(F.lit(0.0))


def schema_ddl_rows(meta: DataFrame) -> DataFrame:
    """Target DDL as rows (batch, table, position, name, type, mode=NULLABLE), ordered by
    source ordinal.  Rows, not one array per table: a very wide table never has to fit in
    one task; ``sources.sinks.write_ddl`` lays them out per table."""
    tables = audit_tables(meta)
    return (meta.join(tables, "table_name")
            .select("batch", "table_name", F.col("ordinal_position").cast("long").alias("position"),
                    F.col("column_name").alias("name"),
                    source_to_target_type(F.col("data_type")).alias("type"),
                    F.lit("NULLABLE").alias("mode")))


def schema_ddl_arrays(ddl_rows: DataFrame) -> DataFrame:
    """K4: per (batch, table) the target DDL as one JSON array, fields in position order (as many as the
    table has columns)."""
    field = F.struct("position", F.struct("name", "type", "mode").alias("f"))
    return ddl_rows.groupBy("batch", "table_name").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(field)), lambda s: s["f"])).alias("fields"))


# fixed values: sheet-label rules (characters replaced by '_', maximum width, reserved label)
LABEL_ILLEGAL = r"[\\/?*\[\]:]"
LABEL_WIDTH = 31
LABEL_RESERVED = "Summary"


def short_unique_labels(names: DataFrame, col: str = "table_name", reserved: str = LABEL_RESERVED,
                        width: int = LABEL_WIDTH) -> DataFrame:
    """Label per name: characters \\ / ? * [ ] : → '_', at most ``width`` characters; later
    names with the same label get '_2', '_3', … (order by name; the reserved label counts
    as taken).  All labels differ: a numbered label that equals another label is numbered on
    until it is free (a label without a number stays)."""
    from .ranks import row_number_balanced
    cleaned = F.substring(F.regexp_replace(F.col(col), LABEL_ILLEGAL, "_"), 1, width)
    d = names.select(col).distinct().withColumn("_clean", cleaned)
    # many long names can share one truncated label: number them without a hot window
    d = row_number_balanced(d, ["_clean"], [col], "_rn")
    d = d.withColumn("_i", F.col("_rn") + F.when(F.col("_clean") == reserved, 1).otherwise(0))
    number = F.col("_i").cast("string")
    label = F.when(F.col("_i") == 1, F.col("_clean")).otherwise(
        F.concat(F.expr(f"substring(_clean, 1, {width} - length(cast(_i as string)) - 1)"), F.lit("_"), number))
    while True:
        d = cut_lineage(d.select(col, "_clean", "_i", label.alias("label")))
        taken = d.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_i") > 1, F.col(col))).alias("_first"))
        taken = taken.where("_n > 1")
        if taken.isEmpty():
            return d.select(col, "label")
        top = d.groupBy("_clean").agg(F.max("_i").alias("_top"))
        lost = F.col("_first").isNotNull() & (F.col("_first")[col] != F.col(col))
        d = (d.join(taken, "label", "left").join(top, "_clean")
             .withColumn("_i", F.col("_i") + F.when(lost, F.col("_top")).otherwise(0)))


# ── schema tree of a DataFrame (Q20) ───────────────────────────────────────────

def _children(t):
    """What a schema tree shows below a type: its fields, also those of an array's elements; no fields for a leaf."""
    while isinstance(t, ArrayType):
        t = t.elementType
    return t.fields if isinstance(t, StructType) else []


def leaf_fields(schema: StructType, prefix: str = "", mode: str | None = None):
    """(dot-path, type, mode) of every leaf; structs and arrays of structs contribute only their leaves, to any
    depth.  Arrays and all leaves inside them are REPEATED; others NULLABLE/REQUIRED.  A map is a leaf, and so is a
    struct without fields."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        m = mode or ("REPEATED" if isinstance(f.dataType, ArrayType) else ("NULLABLE" if f.nullable else "REQUIRED"))
        below = _children(f.dataType)
        if below:
            out.extend(leaf_fields(StructType(below), path, m if m == "REPEATED" else None))
        else:
            out.append((path, f.dataType.simpleString(), m))
    return out


def _leaf_counts(c, t) -> list:
    """For each leaf below a value, in the order of ``leaf_fields``: how many of its values are not null in one row.
    Arrays are added up over their elements, whatever their depth."""
    if isinstance(t, StructType) and t.fields:
        return [n for f in t.fields for n in _leaf_counts(c.getField(f.name), f.dataType)]
    if isinstance(t, ArrayType) and _children(t):
        zero = F.lit(0).cast("long")

        def total(k: int):
            return F.coalesce(F.aggregate(c, zero, lambda n, x: n + _leaf_counts(x, t.elementType)[k]), zero)
        return [total(k) for k in range(len(leaf_fields(StructType().add("x", t))))]
    return [F.when(c.isNotNull(), 1).otherwise(0).cast("long")]


def flatten_columns(df: DataFrame) -> DataFrame:
    """Every leaf of structs as a top-level column named by its dot-path; arrays stay whole."""
    def leaves(c, t, path):
        if isinstance(t, StructType) and t.fields:
            return [x for f in t.fields for x in leaves(c.getField(f.name), f.dataType, f"{path}.{f.name}")]
        return [c.alias(path)]
    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(quoted(f.name)), f.dataType, f.name)])


def leaf_profile(df: DataFrame) -> DataFrame:
    """One aggregate over the table → (path, type, mode, non_null, row_count) per leaf.  Below arrays ``non_null``
    counts the values of all elements."""
    leaves = leaf_fields(df.schema)
    counts = [n for f in df.schema.fields for n in _leaf_counts(F.col(quoted(f.name)), f.dataType)]
    one = df.select(*[n.alias(f"_n{i}") for i, n in enumerate(counts)]).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_n{i}") for i in range(len(counts))])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(m).alias("mode"),
                              F.col(f"_n{i}").cast("long").alias("non_null")) for i, (p, t, m) in enumerate(leaves)])
    return one.select(F.explode(rows).alias("leaf"), F.col("_rows").cast("long").alias("row_count")).select("leaf.*", "row_count")
