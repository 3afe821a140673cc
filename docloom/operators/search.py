"""Queries: filter, order, page, score, and the postings that serve word queries at scale."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import tokens
from ..plans.ast import And, Cmp, HasWord, Node, Or, TokenPrefix
from ..plans.compiler import MapFields, TypedFields, compile_node
from ..plans.parser import parse

DEFAULT_AMOUNT = 1000


def query(df: DataFrame, where: str | Node = "*", id_col: str | None = None, sort_by: str | None = None, sort_order: str = "asc", offset: int = 0, amount: int | None = DEFAULT_AMOUNT) -> DataFrame:
    """The page of rows that match. Ties, and rows without an order, come by id; with a limit Spark takes the top rows and sorts no more."""
    node = parse(where) if isinstance(where, str) else where
    out = df.filter(compile_node(node, TypedFields(df.schema)))
    order = []
    if sort_by is not None:
        name = sort_by if sort_by in df.columns else sort_by.removeprefix(":")
        col = F.col(f"`{name}`") if name in df.columns else F.col(name.replace("$", "."))
        order.append(col.asc_nulls_first() if sort_order == "asc" else col.desc_nulls_last())
    if id_col is not None and (order or offset or amount is not None):
        order.append(F.col(id_col))
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if amount is None else out.limit(amount)


def query_flat(flat: DataFrame, where: str | Node = "*") -> DataFrame:
    """Rows of flattened documents (id, s, n, d) that match."""
    node = parse(where) if isinstance(where, str) else where
    return flat.filter(compile_node(node, MapFields()))


def _equals(word: str):
    return lambda t: t == word


def relevance(df: DataFrame, node: Node, flat: bool = False) -> DataFrame:
    """Add ``score``: for each word that matches, sqrt(tf) idf**2 / sqrt(tokens), times the part of clauses that match.

    Clauses without a word to weigh count 1 each. Frequencies come from one
    aggregate over all rows, one row wide, joined as literals. ``flat``: the rows
    are flattened documents (id, s, n, d), whose fields may have several texts.
    """
    leaves: list[Node] = []

    def walk(n: Node) -> None:
        if isinstance(n, And | Or):
            for a in n.args:
                walk(a)
        elif isinstance(n, HasWord | Cmp | TokenPrefix):
            leaves.append(n)

    walk(node)
    fields = MapFields() if flat else TypedFields(df.schema)

    def words_of(field: str) -> Column:
        if flat:
            return F.coalesce(F.flatten(F.transform(F.col("s")[field], tokens)), F.array().cast("array<string>"))
        return tokens(F.col(f"`{field if field in df.columns else field.removeprefix(':')}`"))

    hits = [F.coalesce(compile_node(n, fields), F.lit(False)) for n in leaves]
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(hits)]).first()
    parts: list[Column] = []
    for i, (leaf, hit) in enumerate(zip(leaves, hits, strict=True)):
        weight = F.lit(1.0)
        if isinstance(leaf, HasWord):
            words = words_of(leaf.field)
            tf = F.size(F.filter(words, _equals(leaf.word)))
            idf = F.lit(1.0) + F.log(F.lit(counts["n"]) / F.lit(counts[f"df{i}"] + 1.0))
            weight = F.sqrt(tf.cast("double")) * idf * idf / F.sqrt(F.greatest(F.size(words), F.lit(1)).cast("double"))
        parts.append(F.when(hit, weight).otherwise(0.0))
    if not parts:
        return df.withColumn("score", F.lit(1.0))
    coord = reduce(operator.add, [h.cast("int") for h in hits]) / F.lit(len(hits))
    return df.withColumn("score", reduce(operator.add, parts) * coord)


def postings(df: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(field, term, id): the distinct tokens of each row, to be written by field and sorted by term."""

    def of(c: str) -> Column:
        terms = F.transform(F.array_distinct(tokens(F.col(c))), lambda t: F.struct(F.lit(c).alias("field"), t.alias("term")))
        return F.coalesce(terms, F.array().cast("array<struct<field:string,term:string>>"))

    each = map(of, text_cols)
    return df.select(F.col(id_col).alias("id"), F.explode(F.concat(*each)).alias("p")).select("p.field", "p.term", "id")


def hits(post: DataFrame, node: Node, ids: DataFrame) -> DataFrame:
    """Ids that a word query finds in postings: semi-joins for and, union for or, anti-join for not. ``ids``: all of them."""
    match node:
        case HasWord(field, word):
            return post.filter((F.col("field") == field.removeprefix(":")) & (F.col("term") == word)).select("id").distinct()
        case TokenPrefix(field, prefix, _):
            return post.filter((F.col("field") == field.removeprefix(":")) & F.col("term").startswith(prefix)).select("id").distinct()
        case And(args) if args:
            return reduce(lambda a, b: a.join(b, "id", "left_semi"), [hits(post, a, ids) for a in args])
        case Or(args) if args:
            return reduce(DataFrame.unionByName, [hits(post, a, ids) for a in args]).distinct()
        case And() | Or():
            return ids.filter("false")
    if type(node).__name__ == "Not":
        return reduce(lambda a, b: a.join(b, "id", "left_anti"), [hits(post, a, ids) for a in node.args], ids)
    if type(node).__name__ == "All":
        return ids
    raise ValueError(f"postings can't serve {node!r}")


def fetch(df: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """Documents of the ids that were found; ids without a document are dropped."""
    return df.join(found.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left_semi")
