"""Search: structured (all words as substrings), and full text over an inverted index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_text

#: Our own scoring: BM25 with these constants; an expanded term counts less than the word itself.
K1, B = 1.2, 0.75
EXACT, PREFIX, FUZZY = 1000, 375, 450
BODY_LIMIT = 30_000


def words(query: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if w]


def matching(rows: DataFrame, query: str, label: str = "label") -> DataFrame:
    """Rows whose normalised label contains every word of the query; no words, no rows."""
    own = words(query)
    out = rows.withColumn("__norm", search_text(F.col(label)))
    for word in own:
        out = out.where(F.col("__norm").contains(word))
    return out.drop("__norm") if own else out.where(F.lit(False)).drop("__norm")


def structured(rows: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Matches in kind order; ``limit`` is the search's own cap (1 to 100)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return matching(rows, query).orderBy("ord", "id").limit(limit)


def vocabulary(docs: DataFrame) -> DataFrame:
    body = search_text(F.col("body"))
    return docs.select(F.explode(F.filter(F.split(body, " "), lambda w: w != "")).alias("term")).distinct()


def edits(word: str) -> int:
    """Typos that a query's word allows: a fifth of its letters, rounded."""
    return int(0.2 * len(word) + 0.5)


def near(term: Column, word: str) -> Column:
    most = edits(word)
    return (F.abs(F.length(term) - len(word)) <= most) & (F.levenshtein(term, F.lit(word), most) >= 0)


def _cut(size: int, n: int) -> list[tuple[int, int]]:
    """(start, length) of n pieces of a word of this size, as even as can be, the shorter ones first."""
    short, longer = size // n, size % n
    sizes = [short + (i >= n - longer) for i in range(n)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(n)]


#: Longer terms have no pieces; a word that may reach them scans them.
LONGEST = 64


def _allowed(size: int) -> list[int]:
    """The numbers of typos by which words of any length may reach a term of this size."""
    return sorted({e for n in range(1, 2 * LONGEST) if (e := edits("x" * n)) and abs(n - size) <= e})


def pieces(terms: DataFrame) -> DataFrame:
    """terms with ``key``, a row for each piece of a term: what words with typos are looked up by.

    A term at most e typos away from a word has one of its e + 1 pieces unchanged in it, moved
    by e letters at most. A term is cut for each number of typos by which words of about its
    length may reach it: a few rows a term. Terms of more than LONGEST letters have none.
    """
    cuts = [(size, e, i, at + 1, n) for size in range(1, LONGEST + 1) for e in _allowed(size) for i, (at, n) in enumerate(_cut(size, e + 1)) if n]
    table = F.broadcast(terms.sparkSession.createDataFrame(cuts, "__size int, __e int, __i int, __at int, __n int"))  # LONGEST bounds it
    rows = terms.join(table, F.length("term") == F.col("__size"))
    key = F.concat_ws(":", "__size", "__e", "__i", F.substr("term", F.col("__at"), F.col("__n")))
    return rows.withColumn("key", key).drop("__size", "__e", "__i", "__at", "__n")


def piece_keys(word: str) -> list[str]:
    """The keys of pieces() under which all terms within the word's typos are found."""
    e, out = edits(word), set()
    for size in range(max(1, len(word) - e), min(LONGEST, len(word) + e) + 1) if e else ():
        for i, (at, n) in enumerate(_cut(size, e + 1)):
            if n:
                out |= {f"{size}:{e}:{i}:{word[p : p + n]}" for p in range(max(0, at - e), min(len(word) - n, at + e) + 1)}
    return sorted(out)


def with_typos(pieces: DataFrame, query: list[str]) -> DataFrame:
    """(query_term, and the columns of pieces): terms within the typos of each word, by an equi-join on pieces.

    A word has some dozens of keys; what they find is checked by its edit distance.
    """
    keys = [(word, key, edits(word)) for word in dict.fromkeys(query) for key in piece_keys(word)]
    asked = F.broadcast(pieces.sparkSession.createDataFrame(keys, "query_term string, key string, typos int"))  # the words' keys
    found = pieces.join(asked, "key").where((F.levenshtein("term", "query_term") <= F.col("typos")))
    return found.drop("key", "typos").dropDuplicates()


def _weight(term: Column, word: Column) -> Column:
    return F.when(term == word, EXACT).when(term.startswith(word), PREFIX).otherwise(FUZZY).cast("long")


def expanded(terms: DataFrame, query: list[str], by_piece: DataFrame | None = None) -> DataFrame:
    """Terms that a query's words reach: equal, by prefix, or by typos; weights in thousandths.

    Beginnings are a filter of the scan that prunes sorted terms. Typos are looked up in ``by_piece``,
    the written pieces() of the terms; without them they are a filter of the scan as well.
    """
    out = None
    for word in query:
        term = F.col("term")
        hit = term.startswith(word) | (near(term, word) if by_piece is None else F.lit(False))
        if by_piece is not None and len(word) + edits(word) > LONGEST:
            hit = hit | ((F.length(term) > LONGEST) & near(term, word))
        own = terms.where(hit).select(F.lit(word).alias("query_term"), *terms.columns)
        out = own if out is None else out.unionByName(own)
    if by_piece is not None and query:
        out = out.unionByName(with_typos(by_piece, query).select(*out.columns).where(~F.col("term").startswith(F.col("query_term"))))
    if out is None:  # no words reach nothing
        out = terms.select(F.lit("").alias("query_term"), *terms.columns).where(F.lit(False))
    return out.withColumn("weight_milli", _weight(F.col("term"), F.col("query_term")))


class Index(NamedTuple):
    """An inverted index over fields: postings (term, field, id, tf, length), terms (term, field, df), stats (field, n, average)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def fielded(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field, words, length) of docs (id and text fields); a null field has no words."""
    split = lambda f: F.filter(F.split(search_text(F.coalesce(F.col(f), F.lit(""))), " "), lambda w: w != "")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), split(f).alias("words")) for f in fields]))
    return docs.select("id", each.alias("f")).select("id", "f.field", "f.words", F.size("f.words").cast("long").alias("length"))


def index_of(docs: DataFrame, fields: Sequence[str] = ("body",)) -> Index:
    """The index of docs (id and text fields); a null field has no words."""
    rows = fielded(docs, fields)
    postings = rows.select("id", "field", "length", F.explode("words").alias("term")).groupBy("term", "field", "id", "length").agg(F.count("*").alias("tf")).select("term", "field", "id", "tf", "length")
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("average"))
    return Index(postings, postings.groupBy("term", "field").agg(F.count("*").alias("df")), stats)


def counted(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field, length, term, tf): the words of each row of docs, counted in the row itself, without a shuffle."""
    rows = fielded(docs, fields).where("length > 0").withColumn("words", F.sort_array("words"))
    first = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i - 1)))
    rows = rows.withColumn("first", first)  # where each word begins among the sorted ones
    each = F.transform("first", lambda at, i: F.struct(F.get("words", at).alias("term"), (F.coalesce(F.get("first", i + 1), F.size("words")) - at).cast("long").alias("tf")))
    return rows.select("id", "field", "length", F.explode(each).alias("w")).select("id", "field", "length", "w.term", "w.tf")


def clustered(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The postings of index_of(), dealt and sorted by term: each is shuffled once, and added up where it lands."""
    rows = counted(docs, fields).repartitionByRange("term", "field", "id")
    return rows.groupBy("term", "field", "id", "length").agg(F.sum("tf").alias("tf")).select("term", "field", "id", "tf", "length").sortWithinPartitions("term", "field", "id")


def ranked(index: Index, query: list[str]) -> DataFrame:
    """(id, score, terms) of all documents that a query reaches, by BM25 over expanded terms, summed over fields.

    Words are expanded on the terms; only the postings of reached terms are joined.
    """
    reached = expanded(index.terms, query)
    rows = index.postings.join(reached, ["term", "field"]).join(F.broadcast(index.stats), "field")  # stats: one row a field
    return scored(rows)


def scored(rows: DataFrame) -> DataFrame:
    """(id, score, terms) of rows (id, tf, length, df, n, average, weight_milli): BM25 summed over terms and fields."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return rows.groupBy("id").agg(F.sum(F.col("weight_milli") / 1000 * idf * saturation).alias("score"), F.count("*").alias("terms"))


def full_text(docs: DataFrame, query: list[str], fields: Sequence[str] = ("body",)) -> DataFrame:
    """ranked() over documents that have no written index: words that the query doesn't reach are dropped where they are read."""
    rows = fielded(docs, fields)
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("average"))
    words_of = rows.select("id", "field", "length", F.explode("words").alias("term"))
    reached = words_of.where(reduce(lambda a, b: a | b, (F.col("term").startswith(w) | near(F.col("term"), w) for w in query)) if query else F.lit(False))
    counted = reached.groupBy("term", "field", "id", "length").agg(F.count("*").alias("tf"))
    counted = counted.withColumn("w", F.explode(F.array_compact(F.array(*[F.when(F.col("term").startswith(w) | near(F.col("term"), w), F.struct(F.lit(w).alias("query_term"), _weight(F.col("term"), F.lit(w)).alias("weight_milli"))) for w in query])))) if query else counted.withColumn("w", F.lit(None).cast("struct<query_term:string,weight_milli:bigint>"))
    dfs = reached.select("term", "field", "id").distinct().groupBy("term", "field").agg(F.count("*").alias("df"))
    return scored(counted.select("id", "term", "field", "tf", "length", "w.weight_milli").join(dfs, ["term", "field"]).join(F.broadcast(stats), "field"))  # stats: one row a field


def top(results: DataFrame, limit: int = 10) -> DataFrame:
    """The best results; ``limit`` is the search's own cap (1 to 25)."""
    if not 1 <= limit <= 25:
        raise ValueError("limit must be from 1 to 25")
    return results.orderBy(F.desc("score"), "id").limit(limit)


def first_by_key(rows: DataFrame, order: str, keys: str) -> DataFrame:
    """For each lookup key the first row that answers to it."""
    return rows.select(order, F.explode(keys).alias("key")).groupBy("key").agg(F.min(order).alias(order))


def lookup(rows: DataFrame, order: str, keys: str, wanted: list[str]) -> DataFrame:
    """The first row that answers to any of the wanted keys (at most one row)."""
    return rows.where(F.arrays_overlap(keys, F.array(*map(F.lit, wanted)))).orderBy(order).limit(1)


SCHEMAS = {"postings": "term string, field string, id long, tf long, length long", "terms": "term string, field string, df long", "stats": "field string, n long, average double"}


def write_index(docs: DataFrame, path: str, fields: Sequence[str] = ("body",)) -> Index:
    """Writes the index as Parquet, clustered by term, so that a term prunes row groups, and reads it back.

    Documents are split once; terms are counted from the written postings.
    """
    spark, made = docs.sparkSession, index_of(docs, fields)
    clustered(docs, fields).write.mode("overwrite").parquet(f"{path}/postings")
    made.stats.write.mode("overwrite").parquet(f"{path}/stats")
    spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings").groupBy("term", "field").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in Index._fields))
