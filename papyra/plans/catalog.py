"""Registered queries over the test tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.scoring import popularity
from papyra.functions.text import ACCENTED, PAIRS, PLAIN, analyze, normalize_whitespace, shard_key, title_key, tokens
from papyra.operators import index as ix
from papyra.operators import metadata as md
from papyra.operators.rerank import BOOK_URL, rerank_books, rerank_editions
from papyra.operators.search import first_hits, query_terms, resolve_terms, search, search_rarest
from papyra.sources.books import html_to_text
from papyra.streaming.realtime import recent_index, search_both

QUERIES = [(1, "the theand of the"), (2, "und der nicht"), (3, "queue laleenéel thxat"), (4, ""), (5, "that with then nand")]
STOPWORDS = ("the", "and", "der", "und", "que", "la", "de")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("book_id"), "text")


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "qid long, text string")


def _index(spark: SparkSession, sf_dir: str) -> ix.SearchIndex:
    return ix.build_index(_books(spark, sf_dir))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata made from documents: a title of the first five words, the source as author, numbers from doc_id."""
    d = _table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.lit("made").alias("source"), i.cast("string").alias("book_id"), F.array_join(F.slice(F.split(normalize_whitespace("text"), " "), 1, 5), " ").alias("title"), F.col("source").alias("author"),
        F.when(i % 3 != 0, (i % 50) / 10).alias("ratings_average"), F.when(i % 4 != 0, i % 40).alias("ratings_count"), F.when(i % 5 != 0, i * 7 % 20000).alias("want_to_read_count"), F.when(i % 7 != 0, (i % 30).cast("int")).alias("edition_count"),
    )


_META = """
SELECT 'made' AS source, CAST(doc_id AS VARCHAR) AS book_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 5), ' ') AS title, source AS author,
  CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 50) / 10 END AS ratings_average, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 40 END AS ratings_count,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id * 7 % 20000 END AS want_to_read_count, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 30 AS INTEGER) END AS edition_count
FROM documents
"""


def _tok(text: str) -> str:
    x = f"lower({text})"
    for a, b in PAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"list_filter(regexp_split_to_array(translate({x}, '{ACCENTED}', '{PLAIN}'), '[^a-z]+'), lambda t: length(t) BETWEEN 2 AND 25)"


_CHUNKS = f"""
norm AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
uniq AS (SELECT min(doc_id) AS ordinal, t, length(t) AS n FROM norm WHERE t <> '' GROUP BY t),
cut AS (
  SELECT ordinal, 0 AS i, 0 AS s, CASE WHEN n <= 1000 THEN n WHEN contains(substring(t, 901, 100), ' ') THEN 1000 - instr(reverse(substring(t, 901, 100)), ' ') ELSE 1000 END AS e FROM uniq
  UNION ALL
  SELECT ordinal, i + 1, s2, CASE WHEN s2 + 1000 >= n THEN n WHEN contains(substring(t, s2 + 901, 100), ' ') THEN s2 + 1000 - instr(reverse(substring(t, s2 + 901, 100)), ' ') ELSE s2 + 1000 END
  FROM (SELECT c.ordinal, i, CASE WHEN e - 100 > s THEN e - 100 ELSE e END AS s2, t, n FROM cut c JOIN uniq u ON u.ordinal = c.ordinal WHERE e < n)
),
pieces AS (SELECT ordinal, i, trim(substring(t, s + 1, e - s)) AS text FROM cut JOIN uniq USING (ordinal)),
toks AS (SELECT *, {_tok("text")} AS tokens FROM pieces WHERE text <> ''),
chunks AS (
  SELECT row_number() OVER (ORDER BY ordinal, i) - 1 AS doc_id, CAST(ordinal AS VARCHAR) AS book_id, ordinal, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY i) - 1 AS INTEGER) AS seq, text,
    CAST(len(tokens) AS INTEGER) AS dl, CAST(floor(ordinal / 100) AS BIGINT) AS segment_id, tokens FROM toks WHERE len(tokens) > 0
),
postings AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, dl FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM chunks) GROUP BY term, doc_id, dl),
vocab AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, CAST(coalesce(sum(dl), 0) AS BIGINT) AS total_len, CASE WHEN count(*) > 0 THEN sum(dl) / count(*) ELSE 0 END AS avgdl FROM chunks)
"""
_ASKED = f"""
asked AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in QUERIES)}) v(qid, text)),
terms AS (SELECT CAST(qid AS BIGINT) AS qid, token, count(*) AS qtf FROM (SELECT qid, unnest({_tok("text")}) AS token FROM asked) GROUP BY qid, token)
"""
_RESOLVED = """
resolved AS (
  SELECT DISTINCT token, term, df FROM terms JOIN vocab ON term = token
  UNION ALL
  SELECT token, term, CAST(sum(df) OVER (PARTITION BY token) AS BIGINT) FROM (SELECT DISTINCT token FROM terms WHERE token NOT IN (SELECT term FROM vocab)) x
    JOIN vocab ON levenshtein(token, term) <= CASE WHEN length(token) > 4 THEN 2 ELSE 1 END
)
"""


def _hits(k: int, k1: float = 1.5) -> str:
    return f"""
scores AS (
  SELECT qid, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM terms JOIN resolved USING (token) JOIN postings USING (term), stats GROUP BY qid, doc_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores),
hits AS (SELECT qid, rank, doc_id, book_id, score FROM ranked JOIN (SELECT doc_id, book_id FROM chunks) USING (doc_id) WHERE rank <= {k})
"""


_BASE = f"WITH RECURSIVE {_CHUNKS}"
_SEARCH = f"{_BASE}, {_ASKED}, {_RESOLVED}"
_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_POPULAR = """least(2.0, 1.0 + CASE WHEN coalesce(ratings_average, 0) <> 0 AND coalesce(ratings_count, 0) >= 10 THEN ratings_average / 5 * 0.3 ELSE 0 END
  + CASE WHEN coalesce(want_to_read_count, 0) <> 0 THEN least(0.2, log10(greatest(1, want_to_read_count)) / 20) ELSE 0 END + CASE WHEN coalesce(edition_count, 0) <> 0 THEN least(0.1, edition_count / 100) ELSE 0 END)"""

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        _found[f.__name__] = f, sql
        return f

    return add


@_query(f"SELECT doc_id, CAST(len({_tok('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_tok('text')})) AS INTEGER) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    t = tokens(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@_query(f"SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL")
def term_frequencies(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("dl"), tokens(F.col("text")).alias("tokens"))
    return ix.term_frequencies(d).select("doc_id", "term", "tf")


@_query(f"{_BASE} SELECT doc_id, book_id, seq, segment_id, dl, text FROM chunks")
def chunk_ids(spark, sf_dir):
    return ix.chunk_books(_books(spark, sf_dir)).select("doc_id", "book_id", "seq", "segment_id", "dl", "text")


@_query("SELECT min(doc_id) AS ordinal FROM documents WHERE text <> '' GROUP BY text")
def dedup_exact(spark, sf_dir):
    return ix.dedup_books(_books(spark, sf_dir)).select("ordinal")


@_query(f"{_BASE} SELECT n, total_len, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.withColumn("avgdl", F.round("avgdl", 6))


@_query(f"{_BASE} SELECT term, df FROM vocab")
def doc_freq(spark, sf_dir):
    return _index(spark, sf_dir).vocab


@_query(f"{_BASE} SELECT term, count(*) AS df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM postings GROUP BY term")
def posting_lists(spark, sf_dir):
    flat = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ")
    return ix.posting_lists(_index(spark, sf_dir).postings).select("term", "df", flat.alias("postings"))


@_query(f"{_BASE} SELECT term, doc_id, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS delta FROM postings")
def posting_deltas(spark, sf_dir):
    return ix.posting_deltas(_index(spark, sf_dir).postings).select("term", "doc_id", "tf", "delta")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@_query(f"{_BASE}, kept AS (SELECT ordinal, i, text, len(tokens) AS dl, list_filter(tokens, lambda t: t NOT IN ({_STOP})) AS k FROM toks) SELECT ordinal, text, CAST(dl AS INTEGER) AS dl, CAST(len(k) AS INTEGER) AS n_kept FROM kept WHERE len(k) > 0")
def stopword_filter(spark, sf_dir):
    return ix.chunk_books(_books(spark, sf_dir), stopwords=STOPWORDS).select("ordinal", "text", "dl", F.size("tokens").alias("n_kept"))


@_query(f"{_BASE}, added AS (SELECT * FROM vocab UNION ALL SELECT * FROM vocab WHERE df > 1) SELECT term, CAST(sum(df) AS BIGINT) AS df FROM added GROUP BY term")
def merge_terms(spark, sf_dir):
    vocab = _index(spark, sf_dir).vocab
    return ix.merge_terms(vocab, vocab.where("df > 1"))


@_query(f"{_SEARCH}, {_hits(10)} SELECT * FROM hits")
def bm25_topk(spark, sf_dir):
    return search(_index(spark, sf_dir), _queries(spark))


@_query(f"{_BASE}, terms AS (SELECT item_id AS qid, token, count(*) AS qtf FROM (SELECT item_id, unnest({_tok('text')}) AS token FROM benchmark) GROUP BY ALL), resolved AS (SELECT DISTINCT token, term, df FROM terms JOIN vocab ON term = token), {_hits(10)} SELECT * FROM hits")
def bm25_batch(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return search(_index(spark, sf_dir), asked, fuzzy=False)


@_query(f"{_SEARCH} SELECT token, term, df FROM resolved")
def fuzzy_resolve(spark, sf_dir):
    return resolve_terms(query_terms(_queries(spark)), _index(spark, sf_dir).vocab)


@_query(f"""{_BASE}, {_ASKED}, known AS (SELECT qid, term, df, CAST(row_number() OVER (PARTITION BY qid ORDER BY df, term) AS INTEGER) AS place, CAST(count(*) OVER (PARTITION BY qid) AS INTEGER) AS n_terms FROM terms JOIN vocab ON token = term),
docs AS (SELECT qid, doc_id, list_sort(list(place)) AS places, sum(tf) AS length FROM known JOIN postings USING (term) GROUP BY qid, doc_id HAVING list_contains(list(place), 1)),
steps AS (
  SELECT DISTINCT qid, 1 AS t, [1] AS need, n_terms FROM known
  UNION ALL
  SELECT s.qid, s.t + 1, CASE WHEN (SELECT count(*) FROM docs d WHERE d.qid = s.qid AND list_has_all(d.places, s.need)) > 50
    AND (SELECT count(*) FROM docs d WHERE d.qid = s.qid AND list_has_all(d.places, list_append(s.need, s.t + 1))) >= 20 THEN list_append(s.need, s.t + 1) ELSE s.need END, s.n_terms FROM steps s WHERE s.t < s.n_terms
), kept AS (SELECT qid, doc_id, CASE WHEN length < floor(avgdl * 0.5) THEN floor(avgdl) ELSE length END AS l FROM docs JOIN steps USING (qid), stats WHERE t = n_terms AND list_has_all(places, need)),
scored AS (SELECT qid, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / avgdl))), 6) AS score FROM kept JOIN known USING (qid) JOIN postings USING (term, doc_id), stats GROUP BY qid, doc_id)
SELECT qid, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10""")
def search_rarest_term(spark, sf_dir):
    return search_rarest(_index(spark, sf_dir), _queries(spark))


@_query(f"{_SEARCH}, {_hits(100)}, own AS (SELECT *, row_number() OVER (PARTITION BY qid, book_id ORDER BY rank) AS o FROM hits) SELECT qid, rank, doc_id, book_id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS place FROM own WHERE o = 1) WHERE place <= 10")
def first_hit_per_book(spark, sf_dir):
    return first_hits(search(_index(spark, sf_dir), _queries(spark), 100))


@_query(f"""{_SEARCH}, {_hits(200)}, meta AS ({_META}), b AS (
  SELECT qid, rank AS hit, book_id, coalesce(nullif(title, ''), 'Unknown') AS title, coalesce(nullif(author, ''), 'Unknown') AS author, lower(text) AS query,
    score, ratings_average, want_to_read_count, edition_count, {_POPULAR} AS pop FROM hits JOIN asked USING (qid) JOIN meta USING (book_id)
), c AS (
  SELECT qid, hit, book_id, title, author, {_KEY.format('title')} AS tk, {_KEY.format('author')} AS ak,
    round(score * (CASE WHEN contains(lower(title), query) THEN 1.5 ELSE 1.0 END * CASE WHEN list_has_any(list_filter(regexp_split_to_array(query, '\\s+'), lambda t: t <> ''), string_split({_KEY.format('author')}, ' ')) THEN 2.0 ELSE 1.0 END)
      * CASE WHEN coalesce(ratings_average, 0) <> 0 OR coalesce(want_to_read_count, 0) <> 0 OR coalesce(edition_count, 0) <> 0 THEN pop ELSE 1.0 END, 6) AS score FROM b
), d AS (SELECT *, row_number() OVER (PARTITION BY qid, tk, ak ORDER BY score DESC, hit) AS e FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, hit) AS INTEGER) AS rank FROM d WHERE e = 1)
SELECT CAST(qid AS BIGINT) AS qid, rank, book_id, title, author, score, '{BOOK_URL}' || book_id AS url FROM r WHERE rank <= 10""")
def rerank_api(spark, sf_dir):
    q = _queries(spark)
    return rerank_editions(search(_index(spark, sf_dir), q, 200), q, _meta(spark, sf_dir))


@_query(f"""{_SEARCH}, {_hits(200)}, meta AS ({_META}), q AS (SELECT qid, list_distinct({_tok('text')}) AS q FROM asked), a AS (
  SELECT h.qid, h.doc_id, h.book_id, title, author, ratings_average, want_to_read_count, len(list_intersect(q, list_distinct({_tok("title || ' ' || author")}))) AS m, len(q) AS nq, score
  FROM hits h JOIN q USING (qid) JOIN meta USING (book_id)
), c AS (SELECT *, round((score + 3.0 * 2.0 * m) * (1 + 0.3 * m / nq) * ln(1 + 1000 / avgdl) * CASE WHEN m = nq AND nq > 1 THEN 1.2 ELSE 1.0 END, 9) AS chunk FROM a, stats
), p AS (SELECT *, row_number() OVER (PARTITION BY qid, book_id ORDER BY chunk DESC, doc_id) AS p FROM c),
b AS (
  SELECT x.qid, x.book_id, x.doc_id, x.title, x.author, round((x.chunk + coalesce(0.2 * y.chunk, 0)) * CASE WHEN regexp_matches(lower(x.title), 'dictionary|encyclopedia|lexicon|glossary|index|catalog|thesaurus|concordance') THEN 0.7 ELSE 1.0 END
    * CASE WHEN x.m = x.nq THEN 1.3 ELSE 1.0 END * CASE WHEN x.ratings_average > 0 THEN 1 + x.ratings_average / 5 * 0.5 ELSE 1.0 END
    * CASE WHEN x.want_to_read_count > 0 THEN 1 + least(0.2, log10(greatest(1, x.want_to_read_count)) * 0.05) ELSE 1.0 END, 9) AS score
  FROM p x LEFT JOIN p y ON y.qid = x.qid AND y.book_id = x.book_id AND y.p = 2 WHERE x.p = 1
), d AS (SELECT *, row_number() OVER (PARTITION BY qid, author ORDER BY score DESC, doc_id) - 1 AS n FROM b),
e AS (SELECT qid, book_id, doc_id, title, author, round(score * pow(0.9, n), 6) AS score FROM d)
SELECT qid, rank, book_id, title, author, score, doc_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM e) WHERE rank <= 10""")
def rerank_library(spark, sf_dir):
    q, index = _queries(spark), _index(spark, sf_dir)
    return rerank_books(search(index, q, 200), q, _meta(spark, sf_dir), index.stats)


@_query(f"SELECT book_id, round({_POPULAR}, 6) AS popularity FROM ({_META})")
def popularity_score(spark, sf_dir):
    p = popularity(*(F.col(c) for c in md.ENRICHED))
    return _meta(spark, sf_dir).select("book_id", F.round(p, 6).alias("popularity"))


@_query(f"SELECT book_id, title, author FROM ({_META}) WHERE lower(coalesce(title, '')) LIKE '%the_an%' OR lower(coalesce(author, '')) LIKE '%the_an%' ORDER BY title, book_id LIMIT 10")
def meta_like_search(spark, sf_dir):
    return md.search_metadata(_meta(spark, sf_dir), "The_an").select("book_id", "title", "author")


@_query(f"SELECT book_id FROM (SELECT * REPLACE (CASE WHEN CAST(book_id AS BIGINT) % 9 = 0 THEN 'A Dictionary of ' || title ELSE title END AS title) FROM ({_META})) WHERE NOT regexp_matches(lower(title), 'dictionary|encyclopedia|thesaurus|full text|complete works|webster''s|unabridged')")
def super_document_filter(spark, sf_dir):
    made = F.when(F.col("book_id").cast("long") % 9 == 0, F.concat(F.lit("A Dictionary of "), "title")).otherwise(F.col("title"))
    return md.drop_super_documents(_meta(spark, sf_dir).withColumn("title", made)).select("book_id")


@_query(f"SELECT book_id, title FROM (SELECT * FROM ({_META}) WHERE ratings_average IS NULL ORDER BY book_id LIMIT 100) WHERE title <> ''")
def needs_enrichment(spark, sf_dir):
    return md.needs_enrichment(_meta(spark, sf_dir)).select("book_id", "title")


@_query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def set_membership(spark, sf_dir):
    return md.members(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def drop_processed(spark, sf_dir):
    return md.drop_processed(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _table(spark, sf_dir, "labels"), ["doc_id"])


@_query("SELECT coalesce(max(doc_id), -1) + 1 AS next_id FROM documents")
def next_id(spark, sf_dir):
    return md.next_id(_table(spark, sf_dir, "documents"), "doc_id")


def _works(spark, sf_dir):
    p = _table(spark, sf_dir, "benchmark")
    title = F.concat_ws(" ", F.lit("a"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " "))
    i = F.col("item_id")
    return p.select(F.concat(F.lit("W"), i.cast("string")).alias("key"), title.alias("title"), F.array(F.lit("someone")).alias("authors"), (i % 50 / 10).alias("ratings_average"), i.alias("ratings_count"), i.alias("want_to_read_count"), (i % 9).cast("int").alias("edition_count"))


def _found_books(spark, sf_dir):
    p = _table(spark, sf_dir, "benchmark")
    return p.select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("book_id"), F.array_join(F.slice(F.split("text", r"\s+"), 2, 2), " ").alias("title"))


_PHRASE = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"
_LOOKUP = f"""
w AS (SELECT 'W' || item_id AS key, item_id, {_PHRASE.format("'a ' || array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 12), ' ') || ' someone'")} AS w FROM benchmark),
b AS (SELECT 'B' || item_id AS book_id, {_PHRASE.format("array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 2, 3), ' ')")} AS p FROM benchmark),
f AS (SELECT book_id, key, item_id, row_number() OVER (PARTITION BY book_id ORDER BY len(string_split(w, ' ')), key) AS n FROM b JOIN w ON contains(' ' || w || ' ', ' ' || p || ' ') WHERE p <> '')
"""


@_query(f"WITH {_LOOKUP} SELECT book_id, key FROM f WHERE n = 1")
def enrich_lookup(spark, sf_dir):
    return md.lookup_works(_found_books(spark, sf_dir), _works(spark, sf_dir))


@_query(f"WITH {_LOOKUP} SELECT b.book_id, item_id % 50 / 10 AS ratings_average, item_id AS ratings_count, item_id AS want_to_read_count, CAST(item_id % 9 AS INTEGER) AS edition_count FROM b LEFT JOIN (SELECT * FROM f WHERE n = 1) USING (book_id)")
def enrich_update(spark, sf_dir):
    books = _found_books(spark, sf_dir)
    null = {"ratings_average": "double", "ratings_count": "long", "want_to_read_count": "long", "edition_count": "int"}
    return md.enrich(books.withColumns({c: F.lit(None).cast(t) for c, t in null.items()}), _works(spark, sf_dir)).drop("title")


@_query("SELECT doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents LEFT JOIN labels l USING (doc_id)")
def upsert_labels(spark, sf_dir):
    old = _table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))
    return md.upsert(old, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@_query("SELECT doc_id, min(toxic) AS toxic FROM (SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, 9 AS toxic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY doc_id")
def insert_missing(spark, sf_dir):
    old = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return md.insert_missing(old, _table(spark, sf_dir, "documents").select("doc_id", F.lit(9).alias("toxic")), ["doc_id"])


@_query("SELECT source AS outcome, count(*) AS n FROM documents GROUP BY source")
def outcome_counts(spark, sf_dir):
    return md.outcome_counts(_table(spark, sf_dir, "documents").withColumnRenamed("source", "outcome"), "outcome")


_AT = "sum(CASE WHEN r = {lo} THEN value * (1 - ({p} * (n + 1) - {lo})) WHEN r = {lo} + 1 THEN value * ({p} * (n + 1) - {lo}) END)"


def _at(p: float) -> str:
    return _AT.format(p=p, lo=f"least(greatest(floor({p} * (n + 1)), 1), greatest(n - 1, 1))")


@_query(f"""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round({_at(0.5)}, 6) AS p50, round(CASE WHEN count(*) >= 10 THEN {_at(0.9)} ELSE 0 END, 6) AS p90, round(CASE WHEN count(*) >= 100 THEN {_at(0.99)} ELSE 0 END, 6) AS p99,
  round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(1000 / avg(value), 6) AS qps FROM x GROUP BY event_type""")
def latency_quantiles(spark, sf_dir):
    return md.latency_quantiles(_table(spark, sf_dir, "events"), "value", ["event_type"])


@_query(f"""{_SEARCH}, {_hits(10)}, lg AS (SELECT doc_id AS id, text AS content FROM documents WHERE lang = 'fr'), top AS (SELECT max(doc_id) + 1 AS t FROM chunks),
rc AS (SELECT row_number() OVER (ORDER BY id) - 1 + t AS doc_id, CAST(id AS VARCHAR) AS book_id, {_tok('content')} AS tokens, CAST(len({_tok('content')}) AS INTEGER) AS dl FROM lg, top),
rp AS (SELECT term, doc_id, count(*) AS tf, dl FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM rc) GROUP BY ALL), rv AS (SELECT term, count(*) AS df FROM rp GROUP BY term), rs AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM rc),
r1 AS (SELECT qid, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN rv ON term = token JOIN rp USING (term), rs GROUP BY qid, doc_id),
u AS (SELECT qid, doc_id, book_id, score FROM hits UNION ALL SELECT qid, doc_id, book_id, score FROM r1 JOIN rc USING (doc_id))
SELECT qid, rank, doc_id, book_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) WHERE rank <= 10""")
def realtime_federated(spark, sf_dir):
    index = _index(spark, sf_dir)
    log = _table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("book_id"))).alias("metadata"))
    top = index.chunks.agg(F.max("doc_id") + 1).first()[0]
    return search_both(index, recent_index(log, top), _queries(spark))


@_query(f"SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, lpad(substring(CAST(doc_id AS VARCHAR), 1, 2), 2, '0') AS shard, {_KEY.format('source')} AS source_key FROM documents")
def content_keys(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha256"), shard_key(F.col("doc_id").cast("string")).alias("shard"), title_key(F.col("source")).alias("source_key"))


@_query()
def stem_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(analyze(F.col("text")), " ").alias("stems"))


@_query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<body[^>]*>(.*?)(</body>|$)', 1, 's'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from papyra.plans import stored  # noqa: F401  its queries register themselves here

    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
