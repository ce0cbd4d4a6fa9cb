"""Relational queries over database-catalog extracts.

Every function takes ``keys`` (for example ``["client_id", "environment"]``)
that lead all joins and groups, so many catalogs are queried together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import fill  # null_text="" renders Oracle's || (NULL counts as "")


COLUMN_RANGE = 32  # positions whose names are joined together first


def _not_recycled(name: str = "object_name") -> Column:
    return ~F.col(name).like(S.RECYCLE_BIN_PATTERN)


def _grant_targets(owner: Column) -> Column:
    expr = F.lit(None).cast("string")
    for o, targets in reversed(S.GRANT_TARGETS):
        expr = F.when(owner == o, F.lit(targets)).otherwise(expr)
    return expr


# ---------------------------------------------------------------------------
# A1: tablespace capacity
# ---------------------------------------------------------------------------

def tablespace_capacity(data_files: DataFrame, datafile_view: DataFrame, free_space: DataFrame,
                        temp_files: DataFrame, temp_header: DataFrame, tempfile_view: DataFrame,
                        names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A1: SUM of max MB per tablespace over data files and temp files, for ``names``.

    Data files join the file view by name and are left-joined to a per-file SUM of
    free space that the result never reads (Catalyst removes that join). Temp
    files are left-joined to the temp headers, which may repeat a file id; that
    fan-out is part of the result. The name filter is pushed below the union.
    """
    keys = list(keys)
    free = free_space.groupBy(*keys, "file_id").agg(F.sum("bytes").alias("free_bytes"))
    d = (data_files.join(datafile_view.select(*keys, F.col("name").alias("file_name")),
                         keys + ["file_name"], "inner")
         .join(free, keys + ["file_id"], "left")
         .select(*keys, "tablespace_name", (F.col("maxbytes") / 1024 / 1024).alias("max_mb")))
    t = (temp_files.join(temp_header.select(*keys, "file_id"), keys + ["file_id"], "left")
         .join(tempfile_view.select(*keys, F.col("file_no").alias("file_id")), keys + ["file_id"], "inner")
         .select(*keys, "tablespace_name", (F.col("maxbytes") / 1024 / 1024).alias("max_mb")))
    u = d.unionByName(t).where(F.col("tablespace_name").isin(*names))
    return u.groupBy(*keys, "tablespace_name").agg(F.sum("max_mb").alias("value"))


# ---------------------------------------------------------------------------
# A3: grant gap
# ---------------------------------------------------------------------------

def grant_gap(objects: DataFrame, tab_privs: DataFrame, keys: Sequence[str] = (),
              dedupe: bool = False) -> DataFrame:
    """A3: GRANT statements for objects of the 4 owners with too few grants.

    Views: fewer than 12 grants of privilege other than EXECUTE to the 4 owners;
    sequences: fewer than 4 SELECT grants to the 5 grantees; functions,
    procedures and packages: fewer than 4 EXECUTE grants to the 5 grantees. The
    agent's first two branches are the same view query, so each view statement
    appears twice unless ``dedupe``. The three correlated counts are one
    pre-aggregation of the grants and one left join (zero counts kept).
    """
    keys = list(keys)
    g4, g5 = F.col("grantee").isin(*S.GRANT_GRANTEES_4), F.col("grantee").isin(*S.GRANT_GRANTEES_5)
    counts = (tab_privs.where(g5)
              .groupBy(*keys, "owner", F.col("table_name").alias("object_name"))
              .agg(F.count(F.when(g4 & (F.col("privilege") != "EXECUTE"), 1)).alias("n_view"),
                   F.count(F.when(F.col("privilege") == "SELECT", 1)).alias("n_select"),
                   F.count(F.when(F.col("privilege") == "EXECUTE", 1)).alias("n_execute")))
    code_types = ["FUNCTION", "PROCEDURE", "PACKAGE"]
    cand = objects.where(F.col("owner").isin(*S.GRANT_OWNERS) & _not_recycled()
                         & F.col("object_type").isin("VIEW", "SEQUENCE", *code_types))
    j = cand.join(counts, keys + ["owner", "object_name"], "left")
    typ = F.col("object_type")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gap = (((typ == "VIEW") & (n("n_view") < S.VIEW_GRANT_MIN))
           | ((typ == "SEQUENCE") & (n("n_select") < S.CODE_GRANT_MIN))
           | (typ.isin(*code_types) & (n("n_execute") < S.CODE_GRANT_MIN)))
    owner = F.col("owner")
    parts = dict(owner=owner, name=F.col("object_name"), grantees=_grant_targets(owner), null_text="")
    command = (F.when(typ == "VIEW", fill(S.GRANT_VIEW, **parts))
               .when(typ == "SEQUENCE", fill(S.GRANT_SEQUENCE, **parts))
               .otherwise(fill(S.GRANT_CODE, **parts)))
    copies = 1 if dedupe else 2
    out = j.where(gap).select(*keys, "owner", "object_name", "object_type", command.alias("command"),
                              F.when(typ == "VIEW", F.lit(copies)).otherwise(F.lit(1)).alias("_n"))
    return (out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .drop("_n", "_copy"))


# ---------------------------------------------------------------------------
# Synonym gaps
# ---------------------------------------------------------------------------

def null_aware_not_in(left: DataFrame, right: DataFrame, keys: Sequence[str], left_col: str,
                      right_col: str) -> DataFrame:
    """``left_col NOT IN (SELECT right_col ...)`` per ``keys``, with SQL's NULL rules.

    A NULL in the list empties the result for its keys; a NULL probe value
    survives only against an empty list. Written as anti joins on the keys; without
    keys the list is summed up once (has a NULL, is empty) and both facts are read as
    scalar subqueries, so no nested-loop join is planned.
    """
    keys = list(keys)
    vals = right.select(*keys, F.col(right_col).alias("_v"))
    present = left.where(F.col(left_col).isNotNull())
    out = present.join(vals.where(F.col("_v").isNotNull()),
                       [present[k] == vals[k] for k in keys] + [present[left_col] == vals["_v"]], "left_anti")
    null_lists = vals.where(F.col("_v").isNull()).select(*keys)
    nonempty = vals.select(*keys)
    if keys:
        out = out.join(null_lists.distinct(), keys, "left_anti")
        nulls = left.where(F.col(left_col).isNull()).join(nonempty.distinct(), keys, "left_anti")
    else:
        facts = vals.agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("given"))
        out = out.where(facts.select(F.col("n") == F.col("given")).scalar())
        nulls = left.where(F.col(left_col).isNull()).where(facts.select(F.col("n") == 0).scalar())
    return out.unionByName(nulls)


def _synonym_command(name: Column, owner: Column) -> Column:
    return fill(S.CREATE_SYNONYM, name=name, owner=owner, null_text="")


def synonym_gap_tables(objects: DataFrame, synonyms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tables and views of DBAMV without a public synonym (``NOT IN``, NULL-aware)."""
    keys = list(keys)
    cand = objects.where(F.col("object_type").isin("TABLE", "VIEW")
                         & (F.col("owner") == S.SYNONYM_TABLE_OWNER) & _not_recycled()
                         & (F.col("object_name") != S.PLAN_TABLE))
    lst = synonyms.where((F.col("owner") == S.PUBLIC) & (F.col("table_owner") == S.SYNONYM_TABLE_OWNER))
    gap = null_aware_not_in(cand, lst, keys, "object_name", "table_name")
    return gap.select(*keys, "owner", "object_name",
                      _synonym_command(F.col("object_name"), F.col("owner")).alias("command"))


def synonym_gap_objects(objects: DataFrame, synonyms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """T4: functions, procedures, packages and sequences of the 4 owners without a
    public synonym on (name, owner) (``NOT EXISTS`` = anti join)."""
    keys = list(keys)
    cand = objects.where(F.col("object_type").isin(*S.SYNONYM_OBJECT_TYPES)
                         & F.col("owner").isin(*S.GRANT_OWNERS) & _not_recycled())
    syn = synonyms.where(F.col("owner") == S.PUBLIC).select(
        *keys, F.col("table_name").alias("object_name"), F.col("table_owner").alias("owner"))
    gap = cand.join(syn, keys + ["object_name", "owner"], "left_anti")
    return gap.select(*keys, "owner", "object_name",
                      _synonym_command(F.col("object_name"), F.col("owner")).alias("command"))


# ---------------------------------------------------------------------------
# Column lists and foreign keys without an index
# ---------------------------------------------------------------------------

def column_list(cols: DataFrame, object_cols: Sequence[str], name_col: str = "column_name",
                pos_col: str = "position") -> DataFrame:
    """Comma-joined column names of a constraint or index, in position order.

    Assumed behaviour of the two catalog functions the agent calls (Oracle allows at
    most 32 columns). Names are joined per range of positions first, then the ranges,
    so an object with very many columns is put together by many tasks.
    """
    def joined(order: str, value: str) -> Column:
        items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), F.col(value).alias("n"))))
        return F.array_join(F.transform(items, lambda x: x["n"]), ",")

    ranged = cols.withColumn("_range", F.floor(F.col(pos_col) / COLUMN_RANGE))
    parts = ranged.groupBy(*object_cols, "_range").agg(joined(pos_col, name_col).alias("_part"))
    return parts.groupBy(*object_cols).agg(joined("_range", "_part").alias("colunas"))


def fk_index_gap(constraints: DataFrame, indexes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CREATE INDEX statements for foreign keys whose column list no index has.

    (owner, table, columns) of FK constraints of the 2 owners MINUS those of their
    indexes (distinct, NULL-safe), joined back to the FK constraints on table and
    column list only, not owner: a match across owners is intended.
    """
    keys = list(keys)
    fk = constraints.where(F.col("owner").isin(*S.FK_OWNERS) & (F.col("constraint_type") == "R"))
    cons = fk.select(*keys, "owner", "table_name", "colunas")
    inde = indexes.where(F.col("owner").isin(*S.FK_OWNERS)).select(*keys, "owner", "table_name", "colunas")
    r = cons.subtract(inde)
    dc = fk.select(*keys, F.col("table_name").alias("_t"), F.col("colunas").alias("_c"), "constraint_name")
    j = r.join(dc, [r[k] == dc[k] for k in keys] + [r["table_name"] == dc["_t"], r["colunas"] == dc["_c"]])
    index = F.replace(F.col("constraint_name"), F.lit(S.FK_SUFFIX), F.lit(S.IX_SUFFIX))
    command = fill(S.CREATE_FK_INDEX, owner=r["owner"], index=index, table=r["table_name"], columns=r["colunas"],
                   null_text="")
    return j.select(*[r[k] for k in keys], r["owner"], r["table_name"], r["colunas"], "constraint_name",
                    command.alias("command"))


# ---------------------------------------------------------------------------
# T5: privileges of the install user
# ---------------------------------------------------------------------------

def user_privileges(tab_privs: DataFrame, role_privs: DataFrame, keys: Sequence[str] = (),
                    rules: Sequence[tuple[str, str]] = tuple(S.PRIVILEGE_RULES)) -> DataFrame:
    """T5: (NAME, VALUE) rows: package grants on the rule's package, role grants of its role."""
    keys = list(keys)
    rule = dict(rules)
    pk = tab_privs.where(F.col("table_name") == rule["PACKAGE"]).select(
        *keys, F.lit("PACKAGE").alias("NAME"), F.col("privilege").alias("VALUE"))
    rl = role_privs.where(F.col("granted_role") == rule["ROLE"]).select(
        *keys, F.lit("ROLE").alias("NAME"), F.col("granted_role").alias("VALUE"))
    return pk.unionByName(rl)


# ---------------------------------------------------------------------------
# W7, A5
# ---------------------------------------------------------------------------

def audit_tail(audit: DataFrame, n: int = S.AUDIT_ROWS, ts_col: str = "timestamp", id_col: str | None = None,
               keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` audit rows (NULL timestamps first, as Oracle sorts DESC).

    One source: a top-N (each task keeps its own top ``n`` before the merge). Many
    sources: ``row_number() <= n`` per key, which Spark plans as a group limit
    applied before the shuffle as well.
    """
    order = [F.col(ts_col).desc_nulls_first()] + ([F.col(id_col).asc()] if id_col else [])
    if not keys:
        return audit.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return audit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def registry_exists(envs: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: per environment, does the version registry table exist (COUNT(*) > 0)?"""
    keys = list(keys)
    hit = objects.where((F.col("object_name") == S.REGISTRY_OBJECT) & (F.col("owner") == S.REGISTRY_OWNER)) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return envs.join(hit, keys, "left").select(
        *envs.columns, (F.coalesce(F.col("_n"), F.lit(0)) > 0).alias("registry_exists"))
