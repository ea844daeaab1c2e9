"""Filters and projections over posts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.functions.text import mentions_in
from mentionflow.functions.times import epoch_millis
from mentionflow.operators.bloom import bloom_filter
from mentionflow.operators.lookup import bounded_values, lookup_join
from mentionflow.session import checkpointed

# The mention of a post without a known one, and the language kept.
UNKNOWN = "<unk>"
LANGUAGE = "en"

# Terms that a text is searched for one by one.
TRACKED_TERMS = 400


def original_posts(posts: DataFrame, lang: str = LANGUAGE) -> DataFrame:
    """Posts in exactly the given language that are not reposts; NULL language is dropped."""
    return posts.where((F.col("lang") == lang) & ~F.col("is_retweet"))


def union_sources(*sources: DataFrame, watermark: str | None = None) -> DataFrame:
    """All rows of all sources, batch or streaming, duplicates kept.

    With ``watermark`` each source gets its own. By Spark's policy (``spark.sql.streaming.multipleWatermarkPolicy``,
    ``min`` by default) time then goes on with the slowest of them, so a source that lags loses no
    post; with one watermark behind the union, or the policy ``max``, the fastest sets the time.
    """
    if watermark is not None:
        sources = tuple(source.withWatermark("created_at", watermark) for source in sources)
    return reduce(DataFrame.unionByName, sources)


def tracked_posts(posts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Posts whose text contains one of the lower-cased terms, e.g. ``@handle``."""
    low = F.lower("text")
    found = [F.contains(low, F.lit(t)) for t in terms]
    while len(found) > 1:  # in pairs, as a chain of hundreds is too deep for the optimizer
        found = [reduce(Column.__or__, found[i : i + 2]) for i in range(0, len(found), 2)]
    return posts.where(found[0])


def _same(value: Column) -> Column:
    """Stands for a text in joins, in 32 bytes: copies of an id are told apart by it."""
    return F.unhex(F.sha2(value, 256))


def _prefixes(texts: DataFrame, lengths: Mapping[str, Sequence[int]]) -> DataFrame:
    """(_id, _same, _candidate) of each string of a ``_low`` text that could be a term: at every place where a first
    letter of a term stands, what begins there, in the lengths that terms with this letter have."""
    letters = "".join(rf"\x{{{ord(c):X}}}" for c in lengths)
    most = max(max(found) for found in lengths.values())
    begun = F.regexp_extract_all("_low", F.lit(f"(?s)(?=([{letters}].{{0,{most - 1}}}))"), 1)
    s = F.col("_begun")

    letters_of: dict[tuple[int, ...], list[str]] = {}
    for letter, found in lengths.items():
        letters_of.setdefault(tuple(sorted(found)), []).append(letter)
    cuts = F
    for found, first in letters_of.items():
        cuts = cuts.when(F.left(s, F.lit(1)).isin(first), F.array(*[F.when(F.char_length(s) >= n, F.left(s, F.lit(n))) for n in found]))
    places = texts.select("_id", "_same", begun.alias("_places")).select("_id", "_same", F.explode("_places").alias("_begun"))
    found = places.select("_id", "_same", cuts.alias("_cuts")).select("_id", "_same", F.explode("_cuts").alias("_candidate"))
    return found.where(F.col("_candidate").isNotNull())


def tracked_by_terms(
    posts: DataFrame, terms: DataFrame, term: str = "term", max_terms: int = TRACKED_TERMS, lookup: Mapping[str, int] | None = None
) -> DataFrame:
    """Posts whose lower-cased text contains one of the terms, for lists of any length.

    A short list is a search for each term. From a longer one only the lengths of its terms, by first
    letter, are known to the plan; texts are cut at those letters into candidates of these lengths. A Bloom
    filter of the terms drops most candidates where they are cut; the others are joined with the terms, without their
    texts. Both give the same rows: a text contains a term if and only if the term begins at one of its
    letters. Null terms match nothing, an empty one every text.
    """
    wanted = terms.select(F.col(term).alias("_term")).where(F.col("_term").isNotNull()).distinct()
    values = bounded_values(wanted, "_term", max_terms)
    if values is not None:
        return tracked_posts(posts, values) if values else posts.where(F.lit(False))
    wanted = checkpointed(wanted)
    shapes = wanted.groupBy(F.left("_term", F.lit(1)).alias("c")).agg(F.collect_set(F.char_length("_term")).alias("n"))
    lengths = {r["c"]: r["n"] for r in shapes.collect()}  # letters and lengths, not terms
    if "" in lengths:
        return posts.where(F.col("text").isNotNull())
    low = F.lower("text")
    candidates = _prefixes(posts.select(F.col("id").alias("_id"), _same(low).alias("_same"), low.alias("_low")), lengths)
    candidates = candidates.where(bloom_filter(wanted, "_term")(F.col("_candidate")))
    found = lookup_join(candidates, wanted, F.col("_candidate"), "_term", "left_semi", F.col("_id"), **(lookup or {}))
    return _with_found(posts, found.select("_id", "_same").distinct(), _same(low), "left_semi")


def _with_found(posts: DataFrame, found: DataFrame, same: Column, how: str = "inner") -> DataFrame:
    """Posts joined with what was found of them, by id and ``same``. It is stored, and a Bloom filter of its ids
    drops most other posts before their texts are shuffled."""
    found = checkpointed(found)
    matched = posts.where(bloom_filter(found, "_id")(F.col("id"))).withColumn("_key", same)
    condition = F.col("id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_same"))
    return matched.join(found, condition, how).drop("_id", "_same", "_key")


def tracked_by_mention(
    posts: DataFrame, handles: DataFrame, max_rows: int | None = None, lookup: Mapping[str, int] | None = None
) -> DataFrame:
    """Posts whose text mentions one of the handles, for lists of any length: mentions are taken
    from the text once and matched with the list, instead of a search for each term."""
    keys = handles.select("handle_key").distinct()
    mentioning = with_mentions(posts)
    if bounded_values(keys, "handle_key", **({} if max_rows is None else {"max_rows": max_rows})) is not None:
        return with_hits(mentioning, keys, max_rows, lookup).drop("hits")
    found = _dictionary_mentions(mentioning, keys, lookup).select("_id", "_same").distinct()
    return _with_found(mentioning, found, _same(F.to_json("mentions")), "left_semi")


def with_mentions(posts: DataFrame) -> DataFrame:
    """Posts with a ``mentions`` array taken from the text, where the source has none."""
    return posts.withColumn("mentions", mentions_in(F.col("text")))


def explode_mentions(posts: DataFrame) -> DataFrame:
    """One row per mention entity, repeats kept."""
    return posts.withColumn("mention", F.explode("mentions")).drop("mentions")


def in_dictionary(mentions: DataFrame, keys: DataFrame, **bounds: int) -> DataFrame:
    """Mentions whose lower-cased form is a ``handle_key``; spelling is kept as written."""
    return lookup_join(
        mentions, keys, F.lower("mention"), "handle_key", "left_semi", F.col("id"), **bounds
    )


def counted_mentions(
    posts: DataFrame, keys: DataFrame, fold_case: bool = False, **bounds: int
) -> DataFrame:
    """(mention, id, created_at) per dictionary mention; the text is not read."""
    narrow = posts.select("id", "created_at", "mentions")
    found = in_dictionary(explode_mentions(narrow), keys, **bounds)
    return found.withColumn("mention", F.lower("mention")) if fold_case else found


def with_hits(
    posts: DataFrame, keys: DataFrame, max_rows: int | None = None, lookup: Mapping[str, int] | None = None
) -> DataFrame:
    """Posts that mention a dictionary handle, with the sorted, lower-cased ``hits`` array; a
    handle that a post repeats is in it once.

    With a small dictionary this is a filter within each row. With a larger one mentions are matched without
    their texts, those that a Bloom filter of the dictionary lets pass, and the hits joined back. ``max_rows`` is the
    size up to which it is small; ``lookup`` holds the bounds of the join beyond.
    """
    handles = F.array_sort(F.array_distinct(F.transform("mentions", F.lower)))
    values = bounded_values(keys, "handle_key", **({} if max_rows is None else {"max_rows": max_rows}))
    if values is not None:
        hits = F.filter(handles, lambda m: m.isin(values))
        return posts.withColumn("hits", hits).where(F.size("hits") > 0)
    found = _dictionary_mentions(posts, keys, lookup)
    hits = found.groupBy("_id", "_same").agg(F.array_sort(F.collect_set("_mention")).alias("hits"))
    return _with_found(posts.drop("hits"), hits, _same(F.to_json("mentions")))


def _dictionary_mentions(posts: DataFrame, keys: DataFrame, lookup: Mapping[str, int] | None) -> DataFrame:
    """(_id, _same, _mention) of the mentions in a large dictionary, lower-cased; ``_same`` stands for a post's array."""
    wanted = checkpointed(keys.where(F.col("handle_key").isNotNull()).distinct())
    arrays = posts.select(F.col("id").alias("_id"), _same(F.to_json("mentions")).alias("_same"), F.array_distinct("mentions").alias("_all"))
    mentions = arrays.select("_id", "_same", F.explode("_all").alias("_as_written")).select("_id", "_same", F.lower("_as_written").alias("_mention"))
    mentions = mentions.where(bloom_filter(wanted, "handle_key")(F.col("_mention")))
    return lookup_join(mentions, wanted, F.col("_mention"), "handle_key", "left_semi", F.col("_id"), **(lookup or {}))


def keyed_by_mention(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """(lower-cased mention, post) for every matching mention, repeats kept."""
    exploded = explode_mentions(posts)
    found = in_dictionary(exploded, keys)
    return found.withColumn("mention", F.lower("mention"))


def primary_mention(mentions: Column, handle_keys: Sequence[str]) -> Column:
    """The first mention spelled exactly like one of a few dictionary keys, else ``<unk>``."""
    known = F.filter(F.array_distinct(mentions), lambda m: m.isin(list(handle_keys)))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(UNKNOWN))


def primary_mentions(
    posts: DataFrame, keys: DataFrame, max_rows: int | None = None, lookup: Mapping[str, int] | None = None
) -> DataFrame:
    """(id, mention) with the first mention spelled exactly like a key of a dictionary of any
    size, else ``<unk>``; one row per post. The text is not read."""
    values = bounded_values(keys, "handle_key", **({} if max_rows is None else {"max_rows": max_rows}))
    if values is not None:
        return posts.select("id", primary_mention(F.col("mentions"), values).alias("mention"))
    counted = posts.select("id", "mentions").groupBy("id", "mentions").agg(F.count(F.lit(1)).alias("_copies"))
    exploded = counted.select("id", "mentions", F.posexplode("mentions").alias("_at", "mention"))
    found = lookup_join(exploded, keys, F.col("mention"), "handle_key", "left_semi", F.col("id"), **(lookup or {}))
    first = found.groupBy(F.col("id").alias("_id"), F.col("mentions").alias("_mentions")).agg(
        F.min(F.struct("_at", "mention")).alias("_first")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("mentions").eqNullSafe(F.col("_mentions"))
    joined = counted.join(first, same, "left").select(
        "id", F.coalesce("_first.mention", F.lit(UNKNOWN)).alias("mention"), "_copies"
    )
    return joined.select("id", "mention", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def emitted_post() -> Column:
    """The post as it goes into a message: id, created_at in milliseconds, text."""
    created = epoch_millis(F.col("created_at")).alias("created_at")
    return F.struct("id", created, "text")


def optional_user() -> Column:
    return F.when(
        F.col("user").isNotNull(), F.struct(F.col("user.id").alias("id"), F.col("user.name").alias("name"))
    )


def optional_location() -> Column:
    return F.when(
        F.col("geo").isNotNull(),
        F.struct(F.col("geo.latitude").alias("latitude"), F.col("geo.longitude").alias("longitude")),
    )


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def random_rows(df: DataFrame, n: int = 15, seed: int | None = None) -> DataFrame:
    """A uniform sample of n rows; a top-n by random number, not a sort of everything."""
    return df.orderBy(F.rand(seed)).limit(n)
