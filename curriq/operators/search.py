"""Lexical, code, tag and facet search over tables of nodes.

A single query is answered by a narrow pass (tokens of the row met with the query's terms), and the page by
TakeOrderedAndProject: no shuffle but that of the page. Those who ask many queries of one corpus write its postings once,
laid out by token, and each query reads the files of its terms alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curriq.functions.text import CodeRules, facet_key, facet_text, holds_phrase, lexical_matches, lexical_tokens, split_tokens
from curriq.session import small_batches

FULL_SCORE, PREFIX_SCORE = 1_000_000, 500_000
MAX_QUERY_CHARS, MAX_TERMS = 512, 32


def query_terms(query: str, most: int | None = MAX_TERMS) -> list[str]:
    """The query's tokens; errors as for a request that can't be answered."""
    if not 1 <= len(query) <= MAX_QUERY_CHARS or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in query):
        raise ValueError("a query has 1 to 512 characters and no control characters")
    terms = split_tokens(query)
    if not terms:
        raise ValueError("a query needs a letter or a number")
    if most and len(set(terms)) > most:
        raise ValueError(f"a query has {most} different terms at most")
    return terms


def token_search(docs: DataFrame, text: str, query: str, every: bool = False, keep: tuple[str, ...] = (), most: int | None = MAX_TERMS) -> DataFrame:
    """Rows with any (or every) term: keep, score (floor of 1e6 x matched / terms), matched_terms (in order, comma-joined).

    most: different terms that a query may have; component texts are searched without such a bound.
    """
    terms = sorted(set(query_terms(query, most)))
    held = small_batches(docs).where(F.col(text).isNotNull()).withColumn("matched", lexical_matches(text, terms))
    n = F.size("matched").cast("long")
    hits = held.where(n == len(terms) if every else n > 0)
    score = F.expr(f"CAST({FULL_SCORE} * CAST(size(matched) AS BIGINT) AS BIGINT) div {len(terms)}")
    return hits.select(*keep, score.alias("score"), F.array_join("matched", ",").alias("matched_terms"))


def phrase_search(docs: DataFrame, text: str, query: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows that hold the query's tokens one after another."""
    terms = query_terms(query)
    hits = small_batches(docs).where(F.col(text).isNotNull()).where(holds_phrase(text, terms))
    return hits.select(*keep, F.lit(FULL_SCORE).cast("long").alias("score"), F.lit(",".join(terms)).alias("matched_terms"), F.lit(len(set(terms))).cast("long").alias("query_terms"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key): one row for each distinct token of each text."""
    return small_batches(docs).where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(lexical_tokens(text))).alias("token")).select("token", key)


def write_postings(docs: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> DataFrame:
    """Write the postings of docs under path, a folder for each bucket of tokens, and read them back."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    # a frequent token's postings are written by several tasks
    rows = postings(docs, key, text).withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8)))
    rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
    return docs.sparkSession.read.schema(f"token string, {key} {dict(docs.dtypes)[key]}, bucket int").parquet(path)


def posting_search(index: DataFrame, key: str, query: str, every: bool = False, buckets: int = 64, most: int | None = MAX_TERMS) -> DataFrame:
    """token_search by way of written postings: key, score, matched_terms; only the terms' buckets are read."""
    terms = sorted(set(query_terms(query, most)))
    at = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms]
    found = index.where(F.col("bucket").isin(*at) & F.col("token").isin(*terms)).groupBy(key).agg(F.sort_array(F.collect_set("token")).alias("matched"))
    n = F.size("matched").cast("long")
    hits = found.where(n == len(terms)) if every else found
    return hits.select(key, F.expr(f"CAST({FULL_SCORE} * CAST(size(matched) AS BIGINT) AS BIGINT) div {len(terms)}").alias("score"), F.array_join("matched", ",").alias("matched_terms"))


def index_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """documents, postings and unique tokens of the index."""
    found = postings(docs, key, text).groupBy("token").agg(F.count("*").alias("n"))
    totals = found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("postings"), F.count("*").alias("unique_tokens"))
    count = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("documents"))
    return count.join(totals, F.lit(True))  # one row each


def with_total(rows: DataFrame, total: Column, name: str) -> DataFrame:
    """rows with an aggregate of them all, joined as one row."""
    return rows.join(F.broadcast(rows.agg(total.alias(name))), F.lit(True))


def page(hits: DataFrame, order: list[Column], limit: int = 25) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    return hits.orderBy(*order).limit(limit)


def code_search(codes: DataFrame, code: str, query: str, rules: CodeRules, prefix: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exact and, if asked for, prefix hits: keep, normalized_code, score."""
    wanted, front = rules.normalize(query), rules.normalize_prefix(query)
    named = codes.where(F.col(code).isNotNull()).withColumn("normalized_code", rules.column(code))
    exact = F.col("normalized_code") == wanted
    hits = named.where(rules.starts(F.col("normalized_code"), front) | exact if prefix else exact)
    return hits.select(*keep, "normalized_code", F.when(exact, FULL_SCORE).otherwise(PREFIX_SCORE).cast("long").alias("score"))


def parent_codes(children: DataFrame, parents: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """children (child, code, scopes) with the parents (parent, code, scopes) that the pattern derives from their codes.

    scopes: a map from scope type to a set of keys. A pair is compatible if either has no scopes, or they share types and
    each shared type's sets meet.
    """
    derived = children.where(F.col("code").rlike(f"^(?:{pattern})$")).withColumn("parent_code", F.regexp_replace("code", f"^(?:{pattern})$", replacement))
    pairs = derived.join(parents.select("parent", F.col("code").alias("parent_code"), F.col("scopes").alias("parent_scopes")), "parent_code")
    shared = F.array_intersect(F.map_keys("scopes"), F.map_keys("parent_scopes"))
    meets = F.forall(shared, lambda t: F.arrays_overlap(F.col("scopes")[t], F.col("parent_scopes")[t]))
    fits = (F.size("scopes") == 0) | (F.size("parent_scopes") == 0) | ((F.size(shared) > 0) & meets)
    return pairs.select("child", "parent", "parent_code", fits.alias("compatible"))


def tag_search(nodes: DataFrame, key: str, tags: str, query: str) -> DataFrame:
    """(key, tag) for each distinct raw tag whose normalized form is the query's: two spellings give two rows."""
    return nodes.select(key, F.explode(F.array_distinct(tags)).alias("tag")).where(facet_key("tag") == facet_text(query))


def facet_rows(nodes: DataFrame, local: str, mapping: dict[str, str]) -> DataFrame:
    """nodes with `normalized`, the mapping's value for the local label's key; unknown labels have none.

    The mapping is a profile's table, a few dozen entries, so it is part of the expression and needs no join.
    """
    entries = [x for k, v in sorted(mapping.items()) for x in (F.lit(facet_text(k)), F.lit(v))]
    known = F.create_map(*entries) if entries else F.expr("map()").cast("map<string,string>")
    return nodes.withColumn("normalized", F.try_element_at(known, facet_key(local)))
