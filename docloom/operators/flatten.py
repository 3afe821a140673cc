"""Flattening of documents into fields, and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = "array<struct<field:string,s:string,n:bigint,d:double>>"


def _entry(field: str, col: Column, kind: T.DataType) -> Column:
    def value(of: type | tuple, to: str) -> Column:
        return (col if isinstance(kind, of) else F.lit(None)).cast(to)

    return F.array(F.struct(F.lit(field).alias("field"), value(T.StringType, "string").alias("s"), value(T.IntegralType, "bigint").alias("n"), value((T.FractionalType, T.DecimalType), "double").alias("d")))


def _leaves(col: Column, kind: T.DataType, path: str) -> Column | None:
    if isinstance(kind, T.StructType):
        parts = [p for f in kind if (p := _leaves(col[f.name], f.dataType, f"{path}${f.name}" if path else f.name)) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _leaves(F.lit(None), kind.elementType, path) is None:
            return None
        return F.coalesce(F.flatten(F.transform(col, lambda x: _leaves(x, kind.elementType, path or "value"))), F.array().cast(_ENTRY))
    if isinstance(kind, T.StringType | T.NumericType):
        return _entry(path or "value", col, kind)
    return None  # booleans, dates and the like aren't indexed


def entries(df: DataFrame, id_col: str) -> DataFrame:
    """(id, field, s, n, d, at): a row for each value in a row's columns, nested ones by path; from the schema alone, in one pass.

    ``at`` orders the values of a document.
    """
    parts = [p for f in df.schema if f.name != id_col and (p := _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)) is not None]
    if not parts:
        return df.select(F.col(id_col).alias("id")).filter("false").selectExpr("id", "cast(null as string) field", "cast(null as string) s", "cast(null as bigint) n", "cast(null as double) d", "0 at")
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.concat(*parts)).alias("at", "e")).select("id", "e.*", "at")
    return rows.filter("s is not null or n is not null or d is not null")


def variant_entries(df: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """(id, field, s, n, d, at) of documents in a VARIANT column, of whatever shape."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    source = df.select(F.col(id_col).alias("id"), F.col(doc_col).alias("v"))
    rows = spark.sql(
        """
        WITH RECURSIVE w (id, field, v, at) AS (
            SELECT id, CAST(NULL AS STRING), v, CAST(array() AS ARRAY<INT>) FROM {source}
            UNION ALL
            SELECT w.id, CASE WHEN e.key IS NULL THEN w.field ELSE concat_ws('$', w.field, e.key) END, e.value, concat(w.at, array(e.pos))
            FROM w, LATERAL variant_explode(w.v) AS e
        )
        SELECT id, coalesce(field, 'value') AS field, v, schema_of_variant(v) AS shape, at FROM w
        """,
        source=source,
    )
    s = F.when(F.col("shape") == "STRING", F.try_variant_get("v", "$", "string"))
    n = F.when(F.col("shape") == "BIGINT", F.try_variant_get("v", "$", "bigint"))
    d = F.when(F.col("shape").rlike("^(DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double"))
    return rows.select("id", "field", s.alias("s"), n.alias("n"), d.alias("d"), "at").filter("s is not null or n is not null or d is not null")


def regroup(rows: DataFrame) -> DataFrame:
    """(id, s, n, d) from entries: maps from a field to its values; a repeated field keeps all of them, in order."""

    def values(c: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))), lambda x: x[c]).alias(c)

    by_field = rows.groupBy("id", "field").agg(*map(values, ("s", "n", "d")))

    def pairs(c: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.size(c) > 0, F.struct("field", c)))).alias(c)

    return by_field.groupBy("id").agg(*map(pairs, ("s", "n", "d")))
