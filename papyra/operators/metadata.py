"""Book metadata: keyed upserts, searches, filters, enrichment from a works table, outcome counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.functions.text import analyze, phrase_tokens

SUPER_DOCUMENTS = ("dictionary", "encyclopedia", "thesaurus", "full text", "complete works", "webster's", "unabridged")
ENRICHED = ("ratings_average", "ratings_count", "want_to_read_count", "edition_count")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; the columns ``keep`` stay as they were. Of rows of one key in ``new`` any one
    counts; make them unique first (``last_wins``). Null keys are equal to each other."""
    on = None
    a, b = old.alias("a"), new.alias("b")
    for c in keys:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    untouched = a.join(b, on, "left_anti")
    held = a.select(*[F.col(f"a.{c}").alias(f"__{c}") for c in (*keys, *keep)], F.lit(True).alias("__old"))
    joined = new.join(held, [new[c].eqNullSafe(held[f"__{c}"]) for c in keys], "left")
    fresh = joined.select(*[F.when(F.col("__old"), F.col(f"__{c}")).otherwise(new[c]).alias(c) if c in keep else new[c] for c in new.columns])
    return untouched.unionByName(fresh, allowMissingColumns=True)


def with_cover(books: DataFrame) -> DataFrame:
    """``books`` with a default cover address for the source that has one; rows without source or book_id are an error when they are read."""
    key = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("book_id", F.lit("")) != "")
    default = F.when(F.col("source") == "gutenberg", F.format_string("https://www.gutenberg.org/cache/epub/%s/pg%s.cover.medium.jpg", "book_id", "book_id"))
    cover = F.coalesce(F.nullif(F.col("cover_url"), F.lit("")), default)
    return books.withColumn("cover_url", F.when(key, cover).otherwise(F.raise_error(F.lit("source and book_id are required"))))


def chunk_metadata(chunks: DataFrame, meta: DataFrame, profile: str = "pt") -> DataFrame:
    """(doc_id, book_id, metadata): JSON of each chunk's book with ``chunk_id`` and ``title_tokens``, the tokens of title and author; a book without metadata has these two only."""
    own = meta.withColumn("title_tokens", analyze(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit(""))), profile))
    names = [c for c in own.columns if c != "book_id"]
    rows = chunks.select("doc_id", "book_id").join(own, "book_id", "left").withColumn("title_tokens", F.coalesce("title_tokens", F.array().cast("array<string>")))
    return rows.select("doc_id", "book_id", F.to_json(F.struct(F.col("doc_id").alias("chunk_id"), "book_id", *names)).alias("metadata"))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(new.columns))


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows of one key the one of greatest ``order``."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def next_id(table: DataFrame, column: str) -> DataFrame:
    """One row: the greatest id and 1, 0 for an empty table."""
    return table.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_id"))


def search_metadata(meta: DataFrame, text: str, source: str | None = None, limit: int = 10) -> DataFrame:
    """Books whose title or author holds ``text``, whatever the case, by title; % and _ are wildcards."""
    pattern = f"%{text.lower()}%"
    found = meta.where(F.lower(F.coalesce("title", F.lit(""))).like(pattern) | F.lower(F.coalesce("author", F.lit(""))).like(pattern))
    if source is not None:
        found = found.where(F.col("source") == source)
    return found.orderBy("title", "book_id").limit(limit)


def drop_super_documents(catalog: DataFrame) -> DataFrame:
    """Without titles of dictionaries, collected works and the like."""
    return catalog.where(~F.lower(F.coalesce("title", F.lit(""))).rlike("|".join(SUPER_DOCUMENTS)))


def drop_processed(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``; none for no ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def needs_enrichment(meta: DataFrame, limit: int = 100) -> DataFrame:
    """Books without ratings that have a title, by book_id."""
    return meta.where("ratings_average is null").orderBy("book_id").limit(limit).where("title is not null and title <> ''")


def lookup_works(books: DataFrame, works: DataFrame) -> DataFrame:
    """(book_id, key): for each book (book_id, title) the work whose title and authors hold the title as a phrase; shortest first, then by key.

    The join is on the first word of the phrase; the words are then compared in place.
    """
    asked = books.select("book_id", phrase_tokens(F.col("title")).alias("p")).where(F.size("p") > 0)
    text = F.concat_ws(" ", "title", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " "))
    held = works.select("key", phrase_tokens(text).alias("w")).select("key", "w", F.posexplode("w").alias("at", "word"))
    found = asked.withColumn("word", F.col("p")[0]).join(held, "word").where(F.slice("w", F.col("at") + 1, F.size("p")) == F.col("p"))
    place = F.row_number().over(W.partitionBy("book_id").orderBy(F.size("w"), "key"))
    return found.withColumn("n", place).where("n = 1").select("book_id", "key")


def enrich(meta: DataFrame, works: DataFrame) -> DataFrame:
    """``meta`` with ratings and counts of the work each unrated book was found as; others as they were."""
    found = lookup_works(meta.where("ratings_average is null"), works).join(works.select("key", *[F.col(c).alias(f"__{c}") for c in ENRICHED]), "key").drop("key")
    joined = meta.join(found, "book_id", "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ENRICHED else F.col(c) for c in meta.columns])


def outcome_counts(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def latency_quantiles(values: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """p50, p90 (0 below 10 values), p99 (0 below 100), mean, min, max and qps by the exclusive method: the place of p is p (n + 1), between its neighbours in proportion."""
    c = F.col(column)
    some = values.where(c.isNotNull())
    order = W.partitionBy(*by).orderBy(c)
    ranked = some.withColumn("__r", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*by)))

    def at(p: float):
        place = F.lit(p) * (F.col("__n") + 1)
        low = F.least(F.greatest(F.floor(place), F.lit(1)), F.greatest(F.col("__n") - 1, F.lit(1)))
        share = place - low
        return F.sum(F.when(F.col("__r") == low, c * (1 - share)).when(F.col("__r") == low + 1, c * share))

    n = F.count(F.lit(1))
    return ranked.groupBy(*by).agg(
        F.round(at(0.5), 6).alias("p50"), F.round(F.when(n >= 10, at(0.9)).otherwise(0.0), 6).alias("p90"), F.round(F.when(n >= 100, at(0.99)).otherwise(0.0), 6).alias("p99"),
        F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(1000 / F.avg(c), 6).alias("qps"),
    )
