"""One query per operator over the driver tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionflow import fixtures
from mentionflow.functions import labels, scoring, text, times
from mentionflow.operators import (
    dashboard,
    evaluation,
    messages,
    posts,
    sentiment,
    windows,
)
from mentionflow.operators.lookup import bounded_values
from mentionflow.plans import jobs
from mentionflow.schemas import LABELLED, POSTS, SCORED
from mentionflow.session import scratch_path
from mentionflow.sinks import files, reports
from mentionflow.sources import dictionary, labelled
from mentionflow.sources.messages import read_messages, stream_messages
from mentionflow.sources.posts import readable_posts, stream_posts, unreadable_posts
from mentionflow.streaming import jobs as streams
from mentionflow.streaming import zero_fill

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY, QUARTER = "1 day", "6 hours"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the driver tables have them."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})


def lexicon_scorer() -> scoring.Scorer:
    return scoring.lexicon_scorer(fixtures.LEXICON)


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.original_posts(fixtures.posts(spark, sf_dir))


def mentions(spark: SparkSession, sf_dir: str, fold_case: bool = False) -> DataFrame:
    return posts.counted_mentions(english(spark, sf_dir), fixtures.keys(spark), fold_case)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.scored_mentions(english(spark, sf_dir), fixtures.keys(spark), lexicon_scorer())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.labelled(spark, sf_dir).withColumn(
        "polarity", labels.to_symbol(F.col("airline_sentiment"))
    )
    return sentiment.score_text(rows, scorer=lexicon_scorer(), name="sentiment")


# Dictionary


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lines made of suppliers and customers: the former well-formed, the latter
    with one, three or trailing empty fields."""
    supplier = fixtures.table(spark, sf_dir, "supplier").select(
        F.concat_ws(",", "s_name", F.concat(F.lit("@"), F.replace("s_name", F.lit("#"), F.lit("_")))).alias("value")
    )
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    customer = fixtures.table(spark, sf_dir, "customer").select(
        F.when(segment == "BUILDING", F.concat(name, F.lit(",@"), segment, F.lit(",,")))
        .when(segment == "MACHINERY", F.concat(name, F.lit(",")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit(","), name))
        .otherwise(F.concat_ws(",", name, F.concat(F.lit("@"), segment), segment))
        .alias("value")
    )
    path = scratch_path(spark, "dictionary")
    supplier.union(customer).write.text(path)
    return dictionary.read_lines(spark, path)


@query
def dictionary_scan(spark, sf_dir):
    return dictionary.handles(supplier_lines(spark, sf_dir))


@query
def dictionary_keys(spark, sf_dir):
    return dictionary.handle_keys(supplier_lines(spark, sf_dir))


@query
def dictionary_display(spark, sf_dir):
    return dictionary.display_table(supplier_lines(spark, sf_dir))


# Posts


@query
def filter_lang_repost(spark, sf_dir):
    return plain(english(spark, sf_dir).select("id", "created_at", "lang", "retweet_count"))


@query
def post_rejects(spark, sf_dir):
    """Posts as JSON texts, some of them broken and some no object: those that can't be read."""
    text = F.to_json(F.struct("id", "lang", "retweet_count", "text", "is_retweet", "mentions"))
    k = F.col("retweet_count") % 10
    broken = F.when(k == 0, F.replace(text, F.lit(":"), F.lit(" "))).when(k == 1, F.lit("17")).otherwise(text)
    raw = fixtures.posts(spark, sf_dir).select("id", broken.alias("value"))
    good = readable_posts(raw).select("id", F.lit(True).alias("readable"))
    return good.union(unreadable_posts(raw).select("id", F.lit(False)))


@query
def extract_mentions(spark, sf_dir):
    found = posts.with_mentions(fixtures.posts(spark, sf_dir).select("id", "text"))
    return posts.explode_mentions(found).select("id", "mention")


@query
def mention_entities(spark, sf_dir):
    return posts.explode_mentions(fixtures.posts(spark, sf_dir).select("id", "mentions"))


@query
def dictionary_semi_join(spark, sf_dir):
    return plain(mentions(spark, sf_dir))


@query
def dictionary_salted_join(spark, sf_dir):
    narrow = english(spark, sf_dir).select("id", "mentions")
    return posts.in_dictionary(posts.explode_mentions(narrow), fixtures.keys(spark), max_rows=0)


@query
def key_by_mention(spark, sf_dir):
    keyed = posts.keyed_by_mention(english(spark, sf_dir), fixtures.keys(spark))
    return plain(keyed.select("mention", "id", "created_at", "text"))


@query
def primary_mention(spark, sf_dir):
    handle_keys = bounded_values(fixtures.keys(spark), "handle_key")
    return fixtures.posts(spark, sf_dir).select(
        "id", posts.primary_mention(F.col("mentions"), handle_keys).alias("mention")
    )


NO_BROADCAST = {"max_rows": 0}


def large_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three handles among those of all suppliers and customers."""
    lines = fixtures.dictionary_lines(spark).unionByName(supplier_lines(spark, sf_dir))
    return dictionary.handles(lines)


@query
def primary_mention_large(spark, sf_dir):
    keys = large_dictionary(spark, sf_dir).select("handle_key").distinct()
    return posts.primary_mentions(fixtures.posts(spark, sf_dir), keys, 0, NO_BROADCAST)


@query
def track_filter_many_terms(spark, sf_dir):
    """Beyond any list that is searched term by term; both sides of its join are shuffled."""
    terms = large_dictionary(spark, sf_dir).select(F.col("handle").alias("term"))
    return posts.tracked_by_terms(fixtures.posts(spark, sf_dir), terms, "term", 0, NO_BROADCAST).select("id", "lang")


@query
def track_filter_mentions(spark, sf_dir):
    """Posts that mention one of many handles as a whole word."""
    handles = large_dictionary(spark, sf_dir)
    return posts.tracked_by_mention(fixtures.posts(spark, sf_dir), handles, 0, NO_BROADCAST).select("id", "lang")


@query
def track_filter(spark, sf_dir):
    terms = dictionary.terms(fixtures.dictionary(spark))
    return posts.tracked_posts(fixtures.posts(spark, sf_dir), terms).select("id", "lang")


@query
def union_sources(spark, sf_dir):
    every = fixtures.posts(spark, sf_dir)
    return posts.union_sources(every, posts.original_posts(every)).select("id", "lang")


@query
def post_projection(spark, sf_dir):
    post = posts.emitted_post().alias("post")
    return fixtures.posts(spark, sf_dir).select(post).select("post.*")


@query
def optional_fields(spark, sf_dir):
    rows = fixtures.posts(spark, sf_dir).select(
        "id", posts.optional_user().alias("u"), posts.optional_location().alias("g")
    )
    return rows.select(
        "id", F.to_json("u").alias("user"), F.col("u.id").alias("user_id"),
        F.col("g.latitude").alias("latitude"), F.col("g.longitude").alias("longitude"),
        F.col("g").isNull().alias("no_location"),
    )


@query
def iso_dates(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events")
    shown = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    known = F.when(F.col("event_type") == "error", "not a date").when(F.col("event_type") != "view", shown)
    return plain(events.select("event_id", times.parse_iso(known).alias("parsed")))


@query
def post_tsv(spark, sf_dir):
    return reports.post_lines(fixtures.posts(spark, sf_dir))


def row_facts(rows: DataFrame, source: DataFrame) -> DataFrame:
    """What can be checked of rows that may be any: how many, distinct, and from the source."""
    known = rows.join(source.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    return known.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("distinct_ids"), F.count("_id").alias("known")
    )


@query
def first_rows(spark, sf_dir):
    source = fixtures.posts(spark, sf_dir).select("id", "lang")
    return row_facts(posts.first_rows(source), source)


@query
def sample_rows(spark, sf_dir):
    source = fixtures.posts(spark, sf_dir).select("id", "lang")
    return row_facts(posts.random_rows(source, seed=7), source)


# Windows


@query
def sliding_count(spark, sf_dir):
    return plain(windows.direct_count(mentions(spark, sf_dir)))


@query
def sliding_count_daily(spark, sf_dir):
    return plain(windows.direct_count(mentions(spark, sf_dir), DAY, QUARTER))


@query
def sliding_count_panes(spark, sf_dir):
    return plain(windows.sliding_count(mentions(spark, sf_dir)))


@query
def sliding_count_panes_daily(spark, sf_dir):
    return plain(windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER))


@query
def tumbling_count(spark, sf_dir):
    return plain(windows.sliding_count(mentions(spark, sf_dir), "5 minutes", "5 minutes"))


@query
def sliding_count_folded(spark, sf_dir):
    return plain(windows.sliding_count(mentions(spark, sf_dir, fold_case=True)))


@query
def sliding_count_zero_fill(spark, sf_dir):
    counts = windows.sliding_count(mentions(spark, sf_dir), "1 hour", "15 minutes")
    return plain(windows.zero_filled(counts, "15 minutes"))


@query
def zero_fill_odd_slide(spark, sf_dir):
    counts = windows.sliding_count(mentions(spark, sf_dir), "21 minutes", "7 minutes")
    return plain(windows.zero_filled(counts, "7 minutes"))


@query
def zero_fill_multi_day(spark, sf_dir):
    counts = windows.sliding_count(mentions(spark, sf_dir), "2 days", "2 days")
    return plain(windows.zero_filled(counts, "2 days"))


@query
def topk_per_window(spark, sf_dir):
    counts = windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER)
    return plain(windows.top_k(counts, k=3))


@query
def topk_overall(spark, sf_dir):
    return plain(windows.top_k_overall(windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER)))


@query
def counts_descending(spark, sf_dir):
    counts = mentions(spark, sf_dir).groupBy("mention").agg(F.count(F.lit(1)).alias("count"))
    return windows.descending(counts)


@query
def sliding_collect_dedup(spark, sf_dir):
    groups = sentiment.sentiment_groups(scored(spark, sf_dir))
    narrow = F.transform("records", lambda r: F.struct(r["tweet"]["id"].alias("id"), r["cat"].alias("cat"), r["polarity"].alias("polarity")))
    return plain(groups.select("window_start", "window_end", "mention", F.inline(narrow)))


@query
def collect_by_category(spark, sf_dir):
    rows = sentiment.scored_posts(
        english(spark, sf_dir).select("id", "created_at", "text"), lexicon_scorer()
    )
    groups = sentiment.category_groups(rows, DAY, QUARTER)
    narrow = F.transform(
        "records", lambda r: F.struct(r["id"].alias("id"), r["polarity"].alias("polarity"), F.length(r["text"]).alias("chars"))
    )
    return plain(groups.select("window_start", "window_end", "cat", F.inline(narrow)))


# Text and scores


@query
def clean_text(spark, sf_dir):
    return sentiment.clean_text(fixtures.posts(spark, sf_dir).select("id", "text"))


@query
def unclean_rows(spark, sf_dir):
    rows = fixtures.posts(spark, sf_dir).select("id", "text")
    cleaned = rows.withColumn("text", text.assert_clean(text.clean(F.col("text"))))
    return rows.select((~text.is_clean(F.col("text"))).alias("bad"), F.lit("before").alias("step")).union(
        cleaned.select((~text.is_clean(F.col("text"))).alias("bad"), F.lit("after").alias("step"))
    ).groupBy("step").agg(F.count_if("bad").alias("bad_rows"), F.count(F.lit(1)).alias("rows"))


@query
def stop_word_filter(spark, sf_dir):
    words = text.without_stop_words(text.tokens(F.col("text")), fixtures.STOP_WORDS)
    kept = documents(spark, sf_dir).select("id", F.size(text.tokens(F.col("text"))).alias("words"), words.alias("kept"))
    return kept.select("id", "words", F.size("kept").alias("kept"), F.array_join("kept", " ").alias("text"))


@query
def sentences(spark, sf_dir):
    return sentiment.sentence_rows(documents(spark, sf_dir))


@query
def sentence_scores(spark, sf_dir):
    classes = scoring.sentence_classes(F.col("text"), fixtures.LEXICON)
    return documents(spark, sf_dir).select("id", F.posexplode(classes).alias("pos", "class"))


@query
def text_score_mean(spark, sf_dir):
    return sentiment.score_text(documents(spark, sf_dir), scorer=lexicon_scorer(), name="score").drop("text")


@query
def text_score_lexicon_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return sentiment.score_by_lexicon_table(rows, fixtures.lexicon(spark))


@query
def text_score_lexicon_repeated(spark, sf_dir):
    """The same with copies of rows and words, by a join as for a lexicon too large for a plan."""
    rows, words = documents(spark, sf_dir), fixtures.lexicon(spark)
    return sentiment.score_by_lexicon_table(rows.union(rows), words.union(words), max_literals=0)


@query
def text_score_model(spark, sf_dir):
    def load():
        return lambda texts: texts.str.count("!").clip(upper=4).astype("float64")

    scorer = scoring.model_scorer(load)
    return sentiment.score_text(documents(spark, sf_dir), scorer=scorer, name="score").drop("text")


@query
def text_score_extreme(spark, sf_dir):
    classes = scoring.sentence_classes(F.col("text"), fixtures.LEXICON)
    return documents(spark, sf_dir).select("id", scoring.most_extreme(classes).alias("class"))


@query
def bucket_symbols(spark, sf_dir):
    rows = sentiment.scored_posts(documents(spark, sf_dir), lexicon_scorer())
    return rows.select("id", "polarity", "cat")


@query
def bucket_words(spark, sf_dir):
    rows = sentiment.score_text(documents(spark, sf_dir), scorer=lexicon_scorer())
    return rows.select("id", "polarity", labels.bucket(F.col("polarity"), labels.WORDS).alias("cat"))


@query
def scored_mention_rows(spark, sf_dir):
    return plain(scored(spark, sf_dir).drop("text"))


@query
def scored_mentions_large(spark, sf_dir):
    keys = large_dictionary(spark, sf_dir).select("handle_key").distinct()
    rows = sentiment.scored_mentions(
        english(spark, sf_dir), keys, lexicon_scorer(), max_literal_keys=0, lookup=NO_BROADCAST
    )
    return plain(rows.drop("text"))


# Messages


@query
def count_messages(spark, sf_dir):
    return plain(messages.count_messages(windows.sliding_count(mentions(spark, sf_dir))))


@query
def sentiment_messages(spark, sf_dir):
    groups = sentiment.sentiment_groups(scored(spark, sf_dir), DAY, QUARTER)
    built = messages.sentiment_messages(groups)
    record = F.explode(F.from_json("value", messages.SENTIMENT_VALUE)).alias("r")
    return plain(
        built.select("topic", "key", "window_start", "window_end", record).select(
            "topic", "key", "window_start", "window_end", F.col("r.tweet.id").alias("id"),
            F.col("r.tweet.created_at").alias("created_at"), F.length("r.tweet.text").alias("chars"),
            F.col("r.mention").alias("mention"), F.col("r.cat").alias("cat"),
            F.round("r.polarity", 6).alias("polarity"),
        )
    )


@query
def sentiment_message_texts(spark, sf_dir):
    """The messages as they are sent: the JSON texts themselves."""
    groups = sentiment.sentiment_groups(scored(spark, sf_dir), DAY, DAY)
    return plain(messages.sentiment_messages(groups).select("key", "window_start", "part", "parts", "value"))


@query
def flatten_messages(spark, sf_dir):
    groups = sentiment.sentiment_groups(scored(spark, sf_dir), DAY, DAY)
    return plain(messages.flattened(messages.sentiment_messages(groups)))


@query
def lenient_json(spark, sf_dir):
    broken = F.when(F.col("event_type") == "error", F.replace("props", F.lit(":"), F.lit(" ")))
    raw = fixtures.table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(broken, F.col("props")).alias("value")
    )
    received = raw.withColumn("value", messages.decoded(F.encode("value", "UTF-8")))
    return messages.lenient_json(received).select(
        "event_id", "value", F.to_json("parsed").alias("parsed"), "is_valid"
    )


def stored_count_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    counts = windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER)
    files.write_messages(messages.count_messages(counts), path=path)
    return read_messages(spark, path, messages.COUNT_TOPIC)


@query
def recount_folded(spark, sf_dir):
    return messages.recount(stored_count_messages(spark, sf_dir))


@query
def recount_all_windows(spark, sf_dir):
    return messages.recount(stored_count_messages(spark, sf_dir), latest_window=False)


@query
def recount_total(spark, sf_dir):
    return messages.recount_total(stored_count_messages(spark, sf_dir), latest_window=False)


@query
def recount_topic_rows(spark, sf_dir):
    """Count messages as a broker hands them over: bytes, headers, and its own timestamp."""
    counts = windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER)
    sent = messages.to_topic(messages.count_messages(counts))
    received = sent.select(
        "topic", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), "headers",
        F.current_timestamp().alias("timestamp"), F.monotonically_increasing_id().alias("offset"),
    )
    return messages.recount(messages.from_topic(received))


@query
def offset_range(spark, sf_dir):
    """Offsets of messages that were taken from a broker and stored."""
    kind = F.col("event_type")
    received = fixtures.table(spark, sf_dir, "events").select(
        kind.alias("topic"), F.encode(kind, "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), F.col("event_id").alias("offset"),
    )
    path = scratch_path(spark, "messages")
    files.write_messages(messages.from_topic(received), path=path)
    return messages.offset_range(read_messages(spark, path))


@query
def stream_offsets(spark, sf_dir):
    """Offsets of what streams write themselves: of counts in a message table, from two runs, the second
    of them with a repeated batch. Rows, distinct offsets and their range show that none is missing or twice there."""
    path, checkpoint = scratch_path(spark, "messages"), scratch_path(spark, "checkpoint")
    counts = streams.window_counts(ended_post_stream(spark, sf_dir, maxFilesPerTrigger="1"), fixtures.keys(spark), DAY, QUARTER)
    streams.run_bounded([streams.start_counts(counts, path, checkpoint, streams.AVAILABLE_NOW)])
    more = windows.sliding_count(mentions(spark, sf_dir), DAY, DAY)
    for _ in range(2):
        streams.count_output(path)(more, 1_000)
    found = read_messages(spark, path)
    facts = found.groupBy("topic").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("offset").alias("offsets"))
    return facts.join(messages.offset_range(found), "topic")


# Labels and evaluation


@query
def label_symbols(spark, sf_dir):
    rows = fixtures.labelled(spark, sf_dir)
    return rows.select("doc_id", labels.to_symbol(F.col("airline_sentiment")).alias("polarity"))


@query
def labelled_table_scan(spark, sf_dir):
    fixtures.labelled(spark, sf_dir).createOrReplaceTempView("labelled_posts")
    return labelled.labelled_table(spark, "labelled_posts")


@query
def labelled_export(spark, sf_dir):
    path = scratch_path(spark, "labelled")
    files.export_labelled(fixtures.labelled(spark, sf_dir), path, "airline_sentiment", "text")
    return labelled.read_labelled(spark, path, LABELLED)


@query
def label_scores(spark, sf_dir):
    return evaluation.scores_of(scored_labels(spark, sf_dir), "+")


@query
def label_mean_std(spark, sf_dir):
    spread = evaluation.label_spread(scored_labels(spark, sf_dir))
    return spread.select("polarity", *[F.round(c, 6).alias(c) for c in ("low", "mean", "high")])


@query
def precision_recall(spark, sf_dir):
    return evaluation.precision_recall(scored_labels(spark, sf_dir))


@query
def f1_macro(spark, sf_dir):
    scores = evaluation.f1_macro(scored_labels(spark, sf_dir))
    return scores.select(*[F.round(c, 9).alias(c) for c in scores.columns])


@query
def row_count(spark, sf_dir):
    return evaluation.row_count(fixtures.labelled(spark, sf_dir))


@query
def score_job(spark, sf_dir):
    source = scratch_path(spark, "labelled") + ".json"
    files.export_labelled(fixtures.labelled(spark, sf_dir), source, "airline_sentiment", "text")
    target = jobs.score_job(spark, source, scorer=lexicon_scorer())
    return labelled.read_labelled(spark, target, SCORED)


def predictions(spark: SparkSession, sf_dir: str) -> str:
    """Runs the prediction job over all documents; those without a label make short lines, and
    each tenth document is followed by a blank line."""
    docs = fixtures.documents(spark, sf_dir)
    rows = docs.join(fixtures.table(spark, sf_dir, "labels"), "doc_id", "left")
    word = F.when(F.col("quality").isNotNull(), fixtures.label_word())
    one_line = F.regexp_replace("text", r"[\n\r]+", " ")
    source = scratch_path(spark, "tsv")
    line = F.concat_ws("\t", F.lit("NA"), F.col("doc_id").cast("string"), word, one_line)
    blank = F.when(F.col("doc_id") % 10 == 0, "\n").otherwise("")
    rows.select(F.concat(line, blank).alias("value")).write.text(source)
    out = scratch_path(spark, "predictions")
    jobs.predict_job(spark, source, out, lexicon_scorer())
    return out


@query
def tsv_predictions(spark, sf_dir):
    return jobs.predicted_lines(spark, predictions(spark, sf_dir))


@query
def tsv_rejects(spark, sf_dir):
    return jobs.predicted_lines(spark, predictions(spark, sf_dir), jobs.REJECT)


# Reports and dashboard


@query
def report_topk(spark, sf_dir):
    counts = windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER)
    return plain(reports.top_k_report(counts, k=3, window=DAY))


@query
def report_sentiment(spark, sf_dir):
    rows = sentiment.scored_posts(
        english(spark, sf_dir).select("id", "created_at", "text"), lexicon_scorer()
    )
    return reports.in_report_order(reports.sentiment_report(rows, DAY, DAY))


@query
def zero_filled_dictionary(spark, sf_dir):
    counts = mentions(spark, sf_dir).groupBy("mention").agg(F.count(F.lit(1)).alias("count"))
    handles = dictionary.handles(
        fixtures.dictionary_lines(spark).unionByName(supplier_lines(spark, sf_dir))
    )
    return dashboard.counts_per_handle(handles, counts)


@query
def posneg_rollup(spark, sf_dir):
    return dashboard.positive_negative(scored(spark, sf_dir))


@query
def posneg_rollup_period(spark, sf_dir):
    since, until = [F.lit(d).cast("timestamp") for d in ("2024-01-08", "2024-01-15")]
    return dashboard.positive_negative(scored(spark, sf_dir), since, until)


# Streams. Each runs to the end of the tables; a last post two days later lets the watermark
# pass the last window, and its own windows stay open.


def ended_post_stream(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    last = fixtures.table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("m"))
    values = {
        "id": F.lit(-1), "lang": F.lit(posts.LANGUAGE), "created_at": F.expr("m + INTERVAL 2 DAYS"),
        "text": F.lit("@click"), "is_retweet": F.lit(False), "mentions": F.array(F.lit("click")),
    }
    fields = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POSTS.fields
    ]
    path = scratch_path(spark, "last-post")
    last.select(*fields).write.parquet(path)
    return posts.union_sources(fixtures.post_stream(spark, sf_dir), stream_posts(spark, path, **options))


def run_count_stream(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    path, checkpoint = scratch_path(spark, "messages"), scratch_path(spark, "checkpoint")
    counts = streams.window_counts(ended_post_stream(spark, sf_dir), fixtures.keys(spark), **options)
    started = streams.start_counts(counts, path, checkpoint, streams.AVAILABLE_NOW)
    streams.run_bounded([started])
    return read_messages(spark, path).drop("offset", "part", "parts")


@query
def stream_sliding_count(spark, sf_dir):
    return plain(run_count_stream(spark, sf_dir, panes=False))


@query
def stream_panes(spark, sf_dir):
    return plain(run_count_stream(spark, sf_dir))


@query
def stream_processing_time(spark, sf_dir):
    """The same with a micro-batch every second, until all there is has been read."""
    path, checkpoint = scratch_path(spark, "messages"), scratch_path(spark, "checkpoint")
    counts = streams.window_counts(ended_post_stream(spark, sf_dir), fixtures.keys(spark))
    started = streams.start_counts(counts, path, checkpoint, streams.every("1 second"))
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    return plain(read_messages(spark, path).drop("offset", "part", "parts"))


@query
def stream_outputs(spark, sf_dir):
    """Count messages and the top-k report from one stream; the report is returned."""
    counts_path, report_path = scratch_path(spark, "messages"), scratch_path(spark, "report")
    counts = streams.window_counts(
        ended_post_stream(spark, sf_dir), fixtures.keys(spark), DAY, QUARTER
    )
    outputs = [
        streams.count_output(counts_path),
        streams.top_k_output(report_path, k=3, window=DAY),
    ]
    checkpoint = scratch_path(spark, "checkpoint")
    streams.run_bounded([streams.start_outputs(counts, outputs, checkpoint, streams.AVAILABLE_NOW)])
    lines = spark.read.text(report_path).select("value")
    written = read_messages(spark, counts_path).select("value")
    return lines.select("value", F.lit("report").alias("output")).union(
        written.select("value", F.lit("counts").alias("output"))
    )


@query
def stream_sentiment(spark, sf_dir):
    table, out = scratch_path(spark, "scored"), scratch_path(spark, "messages")
    scoring_query = streams.start_scored_table(
        ended_post_stream(spark, sf_dir), fixtures.keys(spark), table,
        scratch_path(spark, "checkpoint"), lexicon_scorer(), trigger=streams.AVAILABLE_NOW,
    )
    streams.run_bounded([scoring_query])
    counts = streams.scored_table_counts(spark, table, DAY, QUARTER)
    outputs = [streams.sentiment_output(table, out, DAY, QUARTER)]
    checkpoint = scratch_path(spark, "checkpoint")
    streams.run_bounded([streams.start_outputs(counts, outputs, checkpoint, streams.AVAILABLE_NOW)])
    written = spark.read.parquet(out)
    record = F.explode(F.from_json("value", messages.SENTIMENT_VALUE)).alias("r")
    return plain(
        written.select("key", "window_start", "window_end", record).select(
            "key", "window_start", "window_end", F.col("r.tweet.id").alias("id"),
            F.col("r.cat").alias("cat"), F.round("r.polarity", 6).alias("polarity"),
        )
    )


@query
def stream_report_sentiment(spark, sf_dir):
    table, out = scratch_path(spark, "scored"), scratch_path(spark, "report")
    scoring_query = streams.start_scored_table(
        ended_post_stream(spark, sf_dir), fixtures.keys(spark), table,
        scratch_path(spark, "checkpoint"), lexicon_scorer(), trigger=streams.AVAILABLE_NOW,
    )
    streams.run_bounded([scoring_query])
    counts = streams.scored_table_counts(spark, table, DAY, DAY)
    outputs = [streams.sentiment_report_output(table, out, DAY, DAY, compression="gzip")]
    checkpoint = scratch_path(spark, "checkpoint")
    streams.run_bounded([streams.start_outputs(counts, outputs, checkpoint, streams.AVAILABLE_NOW)])
    return spark.read.option("lineSep", "\n").text(out).select("value")


@query
def stream_recount(spark, sf_dir):
    source, out = scratch_path(spark, "messages"), scratch_path(spark, "recount")
    counts = windows.sliding_count(mentions(spark, sf_dir), DAY, QUARTER)
    files.write_messages(messages.count_messages(counts), path=source)
    started = streams.start_recount(
        stream_messages(spark, source, messages.COUNT_TOPIC), out,
        scratch_path(spark, "checkpoint"), trigger=streams.AVAILABLE_NOW,
    )
    streams.run_bounded([started])
    return plain(streams.latest_recount(spark, out))


# Sources that are behind, open windows, empty windows


POSTS_PER_FILE = 250_000


def write_files(rows: DataFrame, path: str, files: int, before: int = 0) -> None:
    """Adds rows to a folder of ``before`` files as exactly this many, which one trigger takes; none holds all rows of a large part."""
    rows.coalesce(files).write.mode("append").parquet(path)
    none = rows.sparkSession.createDataFrame([], rows.schema)
    for _ in range(before + files - len(rows.sparkSession.read.parquet(path).inputFiles())):  # tasks without rows leave none
        none.coalesce(1).write.mode("append").parquet(path)


def lagging_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two streams of half the posts each, read part by part. The first has its posts in its first part; the
    second has them in four, in the order of time, and is days behind until it ends. The parts of a source have
    the same number of files, and a trigger takes that many."""
    every = fixtures.posts(spark, sf_dir)
    at = F.unix_micros("created_at")
    first, last = every.agg(F.min(at), F.max(at)).first()
    quarter = (last - first) // 4 + 1
    half_of, part_of = F.col("id") % 2, F.floor((at - first) / quarter)
    sizes = {(r["half"], r["part"]): r["count"] for r in every.groupBy(half_of.alias("half"), part_of.alias("part")).count().collect()}
    ended = every.where(at == last).limit(1).withColumns(
        {"id": F.lit(-1).cast("long"), "lang": F.lit(posts.LANGUAGE), "is_retweet": F.lit(False),
         "created_at": F.timestamp_micros(F.lit(last + 2 * 86_400_000_000)), "mentions": F.array(F.lit("click"))}
    )
    sources = []
    for half, parts in ((0, 1), (1, 4)):
        path = scratch_path(spark, "posts")
        mine = every.where(half_of == half)
        of_parts = [n for (h, _), n in sizes.items() if h == half]
        files = -(-max([1, sum(of_parts) if parts == 1 else max([0, *of_parts])]) // POSTS_PER_FILE)
        for part in range(parts):
            rows = mine if parts == 1 else mine.where(part_of == part)
            write_files(rows, path, files, part * files)
        ended.coalesce(1).write.mode("append").parquet(path)
        sources.append(stream_posts(spark, path, maxFilesPerTrigger=str(files)))
    return sources


@query
def stream_lagging_source(spark, sf_dir):
    """Each source has its own watermark, so the posts of the one that is behind are counted."""
    both = posts.union_sources(*lagging_sources(spark, sf_dir), watermark=streams.WATERMARK)
    path, checkpoint = scratch_path(spark, "messages"), scratch_path(spark, "checkpoint")
    counts = streams.window_counts(both, fixtures.keys(spark), DAY, QUARTER, watermark=None)
    streams.run_bounded([streams.start_counts(counts, path, checkpoint, streams.AVAILABLE_NOW)])
    return plain(read_messages(spark, path).drop("offset", "part", "parts"))


@query
def stream_early_counts(spark, sf_dir):
    """Counts of a stream that stops long before the watermark passes its last windows."""
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    feed = fixtures.post_stream(spark, sf_dir)
    started = streams.start_early_counts(
        feed, fixtures.keys(spark), path, checkpoint, DAY, QUARTER, compact_every=1, trigger=streams.AVAILABLE_NOW
    )
    streams.run_bounded([started])
    return plain(streams.early_counts(spark, path))


@query
def stream_zero_fill(spark, sf_dir):
    """Counts of a stream with zeros, up to the last window of the posts."""
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    feed = ended_post_stream(spark, sf_dir)
    counts = streams.window_counts(feed, fixtures.keys(spark), "1 hour", "15 minutes", timed=True)
    filled = zero_fill.zero_filled_stream(counts, "15 minutes", expiry="40 days")
    streams.run_bounded([streams.start_table(filled, path, checkpoint, streams.AVAILABLE_NOW)])
    last = mentions(spark, sf_dir).agg(F.max("created_at")).scalar()
    return plain(spark.read.parquet(path).where(F.col("window_start") <= last))
