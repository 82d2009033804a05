"""The scope table of SQL statements: their tokens as rows, each with the parenthesis it stands in and
the clause it belongs to (for F24 and A14).

Statements are cut into tokens by one regular expression, and everything else is windows over the rows of a
statement: the running count of parentheses gives the depth, the last parenthesis opened to a depth the
scope, the last clause keyword in a scope the clause.  Parentheses belong to the scope around them, so
the tokens of a scope read as if nothing were nested in it.  Nothing is parsed beyond that.  Short statements take
the same rules as array functions in their own rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions

# possessive loops: a literal of any length is matched without recursion
_STRING = (r"'''(?:[^'\\]|\\.|'(?!''))*+'''|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|\b[rR]'[^']*+'|\b[rR]\"[^\"]*+\""
           r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"")
_COMMENT = r"--[^\n]*+|#[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
#: A dotted name with its quotes, a number, an emptied literal, or one character.
TOKEN = (r"(?:`[^`]*+`|[A-Za-z_]\w*(?:-\w+)+(?=\s*\.)|[A-Za-z_]\w*+)(?:\s*\.\s*(?:`[^`]*+`|\w+|\*))*+"
         r"|[0-9][\w.]*+|''|\"\"|\S")

# fixed values: words that begin a clause (ON and USING go on with FROM), and words that end a WHERE
CLAUSES = {w: w for w in ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "UNION",
                          "INTERSECT", "EXCEPT", "WITH", "SET", "VALUES", "INSERT", "MERGE", "UPDATE", "DELETE", "WHEN")}
CLAUSES |= {"JOIN": "FROM", "ON": "FROM", "USING": "FROM"}
AFTER_WHERE = ("GROUP", "HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT", "WHEN")
# fixed values: words that a statement can begin with
STARTS = ("SELECT", "WITH", "FROM", "VALUES", "INSERT", "MERGE", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE", "CALL",
          "DECLARE", "SET", "BEGIN", "COMMIT", "ROLLBACK", "EXPORT", "LOAD", "GRANT", "REVOKE", "EXPLAIN", "SHOW", "DESCRIBE",
          "DESC", "USE", "EXECUTE", "IF", "LOOP", "WHILE", "FOR", "REPEAT", "ASSERT", "TABLE")


def blank_sql(c) -> Column:
    """Comments replaced by a blank and string literals emptied, so rules see only SQL tokens."""
    col = F.col(c) if isinstance(c, str) else c
    # comments, literals and quoted names are matched together, so none is looked for inside another
    bare = F.regexp_replace(col, f"(?s)({_STRING}|`[^`]*+`)|{_COMMENT}", "$1 ")
    # of a literal its closing quote stays, twice; of a quoted name all
    return F.regexp_replace(bare, f"(?s)(`[^`]*+`)|(?:{_STRING})(?<=(['\"]))", "$1$2$2")


def scope_table(stmts: DataFrame, sql: str, keep: Sequence[str]) -> DataFrame:
    """One row per token (one with a null token for a statement without any; none for a null statement): the
    columns of ``keep`` and

    ``sid`` (one per row of ``stmts``), ``pos``, ``token``, ``word`` (the token in upper case), ``depth``, ``scope``
    (place of the parenthesis it stands in, -1 outside), ``clause``, ``place`` (from 1 in its scope), ``before``
    (the six words before it in its scope), ``then`` (the next token in its scope), ``follows`` (the next token),
    ``selects`` (whether a SELECT stands before it in its scope), ``broken`` (whether quotes or parentheses of
    the statement do not match)."""
    s = blank_sql(sql)
    src = stmts.where(F.col(sql).isNotNull()).select(*keep, s.alias("_s")).withColumn("sid", F.monotonically_increasing_id())
    rest = F.regexp_replace(F.regexp_replace("_s", "`[^`]*`", ""), "''|\"\"", "")
    src = src.withColumn("open_quote", rest.rlike(r"['\"`]|/\*"))
    rows = src.select(*keep, "sid", "open_quote", F.posexplode_outer(F.regexp_extract_all("_s", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    in_order = Window.partitionBy("sid").orderBy("pos")
    whole = Window.partitionBy("sid")
    turn = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    rows = (rows.withColumn("word", F.upper("token")).withColumn("after", F.sum(turn).over(in_order))
            .withColumn("depth", F.col("after") - F.when(F.col("token") == "(", 1).otherwise(0))
            .withColumn("follows", F.lead("token").over(in_order)))
    rows = rows.withColumn("broken", F.col("open_quote") | (F.min("after").over(whole) < 0)
                           | (F.max(F.struct("pos", "after")).over(whole)["after"] != 0))
    # an opening parenthesis is a member of the scope around it and the start of its own
    rows = rows.withColumn("role", F.explode(F.when(F.col("token") == "(", F.array(
        F.struct(F.lit(False).alias("opens"), F.col("depth").alias("level")),
        F.struct(F.lit(True).alias("opens"), F.col("after").alias("level")))).otherwise(
        F.array(F.struct(F.lit(False).alias("opens"), F.col("depth").alias("level"))))))
    level = Window.partitionBy("sid", "role.level").orderBy("pos")
    rows = rows.withColumn("scope", F.coalesce(F.max(F.when(F.col("role.opens"), F.col("pos"))).over(level), F.lit(-1)))
    rows = rows.where(~F.col("role.opens")).drop("role", "after", "open_quote")
    scope = Window.partitionBy("sid", "scope").orderBy("pos")
    clause = F.create_map(*[F.lit(x) for pair in CLAUSES.items() for x in pair])
    so_far = scope.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.when(~F.col("before").rlike(r"(?:^| )(?:IS|NOT) DISTINCT$"), F.try_element_at(clause, F.col("word")))
    return (rows.withColumn("place", F.row_number().over(scope))
            .withColumn("before", F.array_join(F.array(*[F.lag("word", k).over(scope) for k in range(6, 0, -1)]), " "))
            .withColumn("clause", F.last(begun, ignorenulls=True).over(so_far))
            .withColumn("then", F.lead("token").over(scope))
            .withColumn("selects", F.coalesce(F.max(F.col("word") == "SELECT").over(so_far), F.lit(False))))


def statement_facts(table: DataFrame, known: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per statement: ``sid``, ``keep``, ``stars`` (a star that stands for columns, also in a call),
    ``has_where``, ``called`` (the first function in the first of the outermost WHERE clauses that is not among
    ``known``), ``unread`` (no statement: empty, not begun by a word that statements begin with, or broken)."""
    whole = Window.partitionBy("sid")
    named = F.col("token") == "*"
    star = ((named & ((F.col("place") == 1) | F.col("before").rlike(r"(?:^| )(?:SELECT|DISTINCT|ALL|,)$")))
            | F.col("token").endswith(".*"))
    where = F.min(F.when(F.col("word") == "WHERE", F.struct("depth", "pos", "scope"))).over(whole)
    t = table.withColumn("first", where)
    ends = F.when((F.col("pos") > F.col("first.pos")) & (
        ((F.col("scope") == F.col("first.scope")) & F.col("word").isin(*AFTER_WHERE))
        | (F.col("depth") < F.col("first.depth"))), F.col("pos"))
    t = t.withColumn("end", F.min(ends).over(whole))
    name = F.regexp_extract("token", r"(?:^|\.\s*)`?(\w+)`?$", 1)
    inside = (F.col("pos") > F.col("first.pos")) & (F.col("end").isNull() | (F.col("pos") < F.col("end")))
    call = inside & (F.col("follows") == "(") & F.col("token").rlike("^[A-Za-z_`]") & (name != "") & ~F.lower(name).isin(*known)
    begins = F.max(F.when(F.col("pos") == 0, F.col("word").isin(*STARTS, "("))).cast("boolean")
    return t.groupBy("sid", *keep).agg(
        F.coalesce(F.max(star), F.lit(False)).alias("stars"), F.coalesce(F.max(F.col("word") == "WHERE"), F.lit(False)).alias("has_where"),
        F.min(F.when(call, F.struct("pos", name.alias("name"))))["name"].alias("called"),
        (~F.coalesce(begins, F.lit(False)) | F.coalesce(F.max("broken"), F.lit(False))).alias("unread"))


_NAME = r"^(?:`|[A-Za-z_])"
_TARGET = (r"(?:^| )(?:INSERT(?: INTO| OVERWRITE)?(?: TABLE)?|MERGE(?: INTO)?|TRUNCATE TABLE|DELETE(?: FROM)?|UPDATE"
           r"|CREATE(?: OR REPLACE)?(?: TEMP| TEMPORARY| EXTERNAL)? TABLE(?: IF NOT EXISTS)?)$")
# fixed values: the words that _TARGET ends with
_TARGET_ENDS = ("INSERT", "INTO", "OVERWRITE", "TABLE", "MERGE", "DELETE", "FROM", "UPDATE", "EXISTS")
# fixed values: words after a writing word that name nothing
_NO_NAMES = ("INTO", "OVERWRITE", "TABLE", "FROM", "SET", "ROW", "VALUES", "IF", "SELECT", "WITH", "WHERE", "LATERAL", "WHEN", "DIRECTORY")


def named_objects(table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``object``, ``writes``: the objects that statements read (after FROM, JOIN, or a comma between
    sources) or write.  Quotes are taken off; names that a statement defines in a WITH, functions that give
    tables, and the FROM of a call or of IS DISTINCT FROM are no objects."""
    word, before = F.col("word"), F.col("before")
    is_name = F.col("token").rlike(_NAME) & ~word.isin(*_NO_NAMES)
    from_word = before.rlike(r"(?:^| )FROM$") & ~before.rlike(r"(?:^| )(?:DELETE|(?:IS|NOT) DISTINCT) FROM$") & (
        F.col("selects") | (F.col("place") == 2))
    source = from_word | before.rlike(r"(?:^| )JOIN$") | (before.rlike(r"(?:^| ),$") & (F.col("clause") == "FROM") & F.col("selects"))
    reads = is_name & source & (F.coalesce(F.col("follows"), F.lit("")) != "(")
    writes = is_name & before.rlike(_TARGET) & ~before.rlike(r"(?:^| )THEN (?:INSERT|UPDATE|DELETE)$|(?:^| )FOR UPDATE$")
    defines = is_name & (F.col("clause") == "WITH") & before.rlike(r"(?:^| )(?:WITH|RECURSIVE|,)$") & (
        F.upper("then").isin("AS", "("))
    plain = F.regexp_replace("token", r"[`\s]", "")
    t = (table.withColumn("name", plain)
         .withColumn("own", F.collect_set(F.when(defines, F.lower(plain))).over(Window.partitionBy("sid"))))
    t = t.where((reads | writes) & ~F.array_contains("own", F.lower("name")))
    return t.select(*keep, F.col("name").alias("object"), writes.alias("writes"))


# Statements up to SHORT characters stay in their rows.  The same rules as above, as array functions: a fold over the
# parentheses of a statement deals its tokens to scopes, and nothing is sorted.  A fold copies what it has, so longer
# statements, of any length, go through the scope table.
SHORT = 4000


def by_length(stmts: DataFrame, sql: str) -> tuple[DataFrame, DataFrame]:
    """The statements of at most SHORT characters, dealt evenly to tasks, and the longer ones; null ones are in neither."""
    is_short = F.length(sql) <= SHORT
    return stmts.where(is_short).repartition(shuffle_partitions(stmts.sparkSession)), stmts.where(~is_short)


_ITEM = "struct<pos:int,token:string,word:string,follows:string,depth:int,scope:int>"


def _word(items: Column, i: Column) -> Column:
    return F.get(items, i)["word"]


def _scopes(items: Column) -> Column:
    """Fold over the parentheses: ``open`` holds the tokens of the scopes that are still open, ``opened`` their
    places; a closing one ends the innermost.  A parenthesis too many stays in the outermost."""
    none = F.array().cast(f"array<{_ITEM}>")
    marks = F.concat(F.filter(items, lambda x: x["token"].isin("(", ")")), F.array(F.struct(
        F.size(items).alias("pos"), *[F.lit(None).cast("string").alias(c) for c in ("token", "word", "follows")])))

    def step(acc, m):
        opens, closes = F.coalesce(m["token"] == "(", F.lit(False)), F.coalesce(m["token"] == ")", F.lit(False))
        upto = m["pos"] + F.when(opens, 1).otherwise(0)  # a closing one belongs to what comes next
        run = F.transform(F.slice(items, acc["at"] + 1, upto - acc["at"]), lambda x: F.struct(
            x["pos"].alias("pos"), x["token"].alias("token"), x["word"].alias("word"), x["follows"].alias("follows"),
            acc["level"].alias("depth"), F.element_at(acc["opened"], -1).alias("scope")))
        whole = F.array(F.concat(F.element_at(acc["open"], -1), run))
        rest = F.size(acc["open"]) - 1
        below = F.slice(acc["open"], F.lit(1), rest)
        ends = closes & (rest > 0)
        level = acc["level"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(
            upto.alias("at"), level.alias("level"), F.least(acc["low"], level).alias("low"),
            F.when(opens, F.concat(acc["opened"], F.array(m["pos"])))
            .when(ends, F.slice(acc["opened"], F.lit(1), rest)).otherwise(acc["opened"]).alias("opened"),
            F.when(opens, F.concat(below, whole, F.array(none))).when(ends, below)
            .otherwise(F.concat(below, whole)).alias("open"),
            F.when(ends, F.concat(acc["done"], whole)).otherwise(acc["done"]).alias("done"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), F.lit(0).alias("low"), F.array(F.lit(-1)).alias("opened"),
                    F.array(none).alias("open"), F.array().cast(f"array<array<{_ITEM}>>").alias("done"))
    return F.aggregate(marks, zero, step, lambda acc: F.struct(
        F.filter(F.concat(acc["done"], acc["open"]), lambda x: F.size(x) > 0).alias("all"),
        ((acc["low"] < 0) | (acc["level"] != 0)).alias("uneven")))


def _starts(items: Column) -> Column:
    """The clause keywords of a scope."""
    return F.filter(items, lambda x, i: x["word"].isin(*CLAUSES) & ~F.coalesce(
        (_word(items, i - 1) == "DISTINCT") & _word(items, i - 2).isin("IS", "NOT"), F.lit(False)))


def _clause(starts: Column, x: Column) -> Column:
    """The clause that the token ``x`` of a scope stands in."""
    clause = F.create_map(*[F.lit(w) for pair in CLAUSES.items() for w in pair])
    begun = F.filter(starts, lambda s: s["pos"] <= x["pos"])
    return F.try_element_at(clause, F.get(begun, F.size(begun) - 1)["word"])


def _before(items: Column, i: Column) -> Column:
    """The six words before place ``i`` (from 0) of a scope."""
    return F.array_join(F.transform(F.slice(items, F.greatest(i - 6, F.lit(0)) + 1, F.least(i, F.lit(6))), lambda x: x["word"]), " ")


def statement_scopes(stmts: DataFrame, sql: str, keep: Sequence[str]) -> DataFrame:
    """One row per statement that is not null: the columns of ``keep``, ``scopes`` (of each scope with tokens ``items``, in
    order, and ``starts``, the clause keywords among them) and ``broken`` (whether quotes or parentheses of the
    statement do not match).  Items have ``pos``, ``token``, ``word`` (in upper case), ``follows`` (the next token of the
    statement), ``depth`` and ``scope`` (place of the parenthesis it stands in, -1 outside)."""
    src = stmts.where(F.col(sql).isNotNull()).select(*keep, blank_sql(sql).alias("_s"))
    rest = F.regexp_replace(F.regexp_replace("_s", "`[^`]*`", ""), "''|\"\"", "")
    src = src.select(*keep, rest.rlike(r"['\"`]|/\*").alias("_quote"), F.regexp_extract_all("_s", F.lit(TOKEN), F.lit(0)).alias("_t"))
    tokens = F.col("_t")
    src = src.select(*keep, "_quote", F.transform(tokens, lambda t, i: F.struct(
        i.alias("pos"), t.alias("token"), F.upper(t).alias("word"), F.get(tokens, i + 1).alias("follows"))).alias("_t"))
    flat = F.struct(F.filter(F.array(F.transform("_t", lambda x: F.struct(
        *[x[c].alias(c) for c in ("pos", "token", "word", "follows")], F.lit(0).alias("depth"), F.lit(-1).alias("scope")))),
        lambda x: F.size(x) > 0).alias("all"), F.lit(False).alias("uneven"))
    nested = F.exists("_t", lambda x: x["token"].isin("(", ")"))
    src = src.select(*keep, "_quote", F.when(nested, _scopes(F.col("_t"))).otherwise(flat).alias("_f"))
    return src.select(*keep, F.transform("_f.all", lambda x: F.struct(x.alias("items"), _starts(x).alias("starts"))).alias("scopes"),
                      (F.col("_quote") | F.col("_f.uneven")).alias("broken"))


def scope_facts(table: DataFrame, known: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row of ``statement_scopes``: ``keep``, ``stars`` (a star that stands for columns, also in a call),
    ``has_where``, ``called`` (the first function in the first of the outermost WHERE clauses that is not among
    ``known``), ``unread`` (no statement: empty, not begun by a word that statements begin with, or broken)."""
    def star(s):
        items = s["items"]
        return F.size(F.filter(items, lambda x, i: x["token"].endswith(".*") | (
            (x["token"] == "*") & ((i == 0) | _word(items, i - 1).isin("SELECT", "DISTINCT", "ALL", ","))))) > 0

    place = lambda x: F.struct(x["depth"].alias("depth"), x["pos"].alias("pos"), x["scope"].alias("scope"))
    wheres = F.transform(F.filter("all", lambda x: x["word"] == "WHERE"), place)
    t = table.select(*keep, "broken", F.exists("scopes", star).alias("stars"),
                     F.flatten(F.transform("scopes", lambda s: s["items"])).alias("all"))
    t = t.withColumn("first", F.array_min(wheres))
    first = F.col("first")
    ends = F.when(first.isNotNull(), F.array_min(F.transform(F.filter("all", lambda x: (x["pos"] > first["pos"]) & (
        ((x["scope"] == first["scope"]) & x["word"].isin(*AFTER_WHERE)) | (x["depth"] < first["depth"]))), lambda x: x["pos"])))
    t = t.withColumn("end", ends)
    name = lambda x: F.regexp_extract(x["token"], r"(?:^|\.\s*)`?(\w+)`?$", 1)
    call = lambda x: ((x["follows"] == "(") & (x["pos"] > first["pos"]) & (F.col("end").isNull() | (x["pos"] < F.col("end")))
                      & x["token"].rlike("^[A-Za-z_`]") & (name(x) != "") & ~F.lower(name(x)).isin(*known))
    called = F.when(first.isNotNull(), F.array_min(F.transform(F.filter("all", call), lambda x: F.struct(
        x["pos"].alias("pos"), name(x).alias("name")))))
    begins = F.exists("all", lambda x: (x["pos"] == 0) & x["word"].isin(*STARTS, "("))
    return t.select(*keep, "stars", first.isNotNull().alias("has_where"), called["name"].alias("called"),
                    (~begins | F.col("broken")).alias("unread"))


def scope_objects(table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``object``, ``writes``: the objects that the statements of ``statement_scopes`` read (after FROM, JOIN, or a
    comma between sources) or write.  Quotes are taken off; names that a statement defines in a WITH, functions that
    give tables, and the FROM of a call or of IS DISTINCT FROM are no objects."""
    plain = lambda x: F.regexp_replace(x["token"], r"[`\s]", "")
    is_name = lambda x: x["token"].rlike(_NAME) & ~x["word"].isin(*_NO_NAMES)
    true = lambda c: F.coalesce(c, F.lit(False))

    def reads(s, x, i):
        items = s["items"]
        last, second, third = (_word(items, i - k) for k in (1, 2, 3))
        selects = F.exists(s["starts"], lambda w: (w["word"] == "SELECT") & (w["pos"] <= x["pos"]))
        from_word = (last == "FROM") & ~true(second == "DELETE") & ~true(
            (second == "DISTINCT") & third.isin("IS", "NOT")) & ((i == 1) | selects)
        listed = (last == ",") & (_clause(s["starts"], x) == "FROM") & selects
        return true(last.isin("FROM", "JOIN", ",") & is_name(x) & ~true(x["follows"] == "(") & (
            from_word | (last == "JOIN") | listed))

    def writes(s, x, i):
        before = _before(s["items"], i)
        return true(_word(s["items"], i - 1).isin(*_TARGET_ENDS) & is_name(x) & before.rlike(_TARGET) & ~before.rlike(
            r"(?:^| )THEN (?:INSERT|UPDATE|DELETE)$|(?:^| )FOR UPDATE$"))

    def defines(s, x, i):
        return true(_word(s["items"], i - 1).isin("WITH", "RECURSIVE", ",") & _word(s["items"], i + 1).isin("AS", "(")
                    & is_name(x) & (_clause(s["starts"], x) == "WITH"))

    def likely(s):
        """Places after a word that a name of interest can follow."""
        return F.filter(F.sequence(F.lit(0), F.size(s["items"]) - 1), lambda i: _word(s["items"], i - 1).isin(
            *_TARGET_ENDS, "JOIN", ",", "WITH", "RECURSIVE"))

    def each(rule, out):
        return F.flatten(F.transform("scopes", lambda s: F.transform(
            F.filter(s["likely"], lambda i: rule(s, F.get(s["items"], i), i)), lambda i: out(F.get(s["items"], i)))))
    table = table.select(*keep, F.transform("scopes", lambda s: F.struct(
        s["items"].alias("items"), s["starts"].alias("starts"), likely(s).alias("likely"))).alias("scopes"))
    named = lambda w: lambda x: F.struct(plain(x).alias("object"), F.lit(w).alias("writes"))
    # what is both is a write
    t = table.select(*keep, each(defines, lambda x: F.lower(plain(x))).alias("own"), F.concat(
        each(writes, named(True)), each(lambda s, x, i: reads(s, x, i) & ~writes(s, x, i), named(False))).alias("found"))
    kept = F.filter("found", lambda x: ~F.array_contains(F.col("own"), F.lower(x["object"])))
    kept = F.when(F.size("own") == 0, F.col("found")).otherwise(kept)
    # outer: of an inner explode the optimizer makes a filter that works out the arrays once more
    return t.select(*keep, F.explode_outer(kept).alias("f")).where("f is not null").select(*keep, "f.object", "f.writes")
