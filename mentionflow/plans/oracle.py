"""The same results in SQL, for a check by another engine over the same tables."""

from __future__ import annotations

from mentionflow import fixtures

# Posts as in ``fixtures.posts_of``.
POSTS = f"""
raw AS (
  SELECT e.*, d.lang, d.source, d.n_chars, d.text AS doc_text,
         CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
),
named AS (
  SELECT *, CASE WHEN k >= 80 THEN [upper(event_type), event_type, 'user' || user_id]
                 WHEN k >= 50 THEN [upper(event_type), 'user' || user_id]
                 ELSE [event_type, 'user' || user_id] END AS mentions
  FROM raw
),
posts AS (
  SELECT event_id AS id, ts AS created_at, lang, k AS retweet_count, user_id, event_type, value,
         source = '{fixtures.REPOST_SOURCE}' AS is_retweet,
         n_chars > {fixtures.TRUNCATED_CHARS} AS is_truncated, source, mentions,
         '@' || array_to_string(mentions, ' @') || ' ' || doc_text
           || CASE WHEN event_type = 'purchase' THEN ' \U0001f389' ELSE '' END AS text
  FROM named
),
english AS (SELECT * FROM posts WHERE lang = 'en' AND NOT is_retweet)
"""

KEYS = "('click', 'view', 'purchase')"

MENTIONS = f"""{POSTS},
mentions AS (
  SELECT m AS mention, id, created_at
  FROM (SELECT id, created_at, unnest(mentions) AS m FROM english) WHERE lower(m) IN {KEYS}
)
"""

CLEAN = r"regexp_replace({0}, '[\x{{FE0F}}\x{{1F000}}-\x{{1F7FF}}]', ' ', 'g')"


def _weights() -> str:
    cases = " ".join(f"WHEN '{w}' THEN {n}" for w, n in fixtures.LEXICON.items())
    return f"CASE w {cases} ELSE 0 END"


def sentences(text: str) -> str:
    return (
        f"list_filter(string_split_regex({CLEAN.format(text)}, '[.!?]+'), "
        r"lambda s: regexp_matches(s, '\S'))"
    )


def classes(text: str) -> str:
    words = "list_transform(regexp_extract_all(lower(s), '([a-z'']+)', 1), lambda w: " + _weights() + ")"
    one = f"CAST(greatest(0, least(4, 2 + coalesce(list_sum({words}), 0))) AS INTEGER)"
    return f"list_transform({sentences(text)}, lambda s: {one})"


def mean(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 0.0::DOUBLE ELSE list_avg({classes(text)})::DOUBLE END"


def bucket(score: str, negative: str = "-", neutral: str = "=", positive: str = "+") -> str:
    return (
        f"CASE WHEN {score} < 2.0 THEN '{negative}' WHEN {score} < 2.05 THEN '{neutral}' "
        f"WHEN {score} >= 2.05 THEN '{positive}' END"
    )


def fixed(score: str, decimals: int) -> str:
    """Half up on the shortest decimal form of the number."""
    exact = f"CAST(CAST({score} AS VARCHAR) AS DECIMAL(20, 16))"
    return f"CAST(round({exact}, {decimals}) AS VARCHAR)"


def sliding(rows: str, window: str, slide: str, copies: int, columns: str = "*") -> str:
    """The rows of a relation once per window that contains them."""
    start = f"time_bucket(INTERVAL '{slide}', created_at, TIMESTAMP '1970-01-01') - k * INTERVAL '{slide}'"
    return (
        f"SELECT {columns}, {start} AS window_start, {start} + INTERVAL '{window}' AS window_end "
        f"FROM {rows}, range({copies}) t(k)"
    )


MIN5 = ("5 minutes", "1 minute", 5)
DAILY = ("1 day", "6 hours", 4)
TUMBLING = ("1 day", "1 day", 1)


def counts(window: tuple[str, str, int], key: str = "mention") -> str:
    return (
        f"SELECT window_start, window_end, {key} AS mention, count(*) AS count "
        f"FROM ({sliding('mentions', *window)}) GROUP BY ALL"
    )


def with_counts(window: tuple[str, str, int], select: str, key: str = "mention") -> str:
    return f"WITH {MENTIONS}, counts AS ({counts(window, key)}) {select}"


def zero_filled(window: str, slide: str, copies: int) -> str:
    return with_counts(
        (window, slide, copies),
        f""", seen AS (
          SELECT mention, min(window_start) AS first, (SELECT max(window_start) FROM counts) AS last
          FROM counts GROUP BY mention
        ), slots AS (
          SELECT mention, unnest(generate_series(first, last, INTERVAL '{slide}')) AS window_start
          FROM seen
        )
        SELECT window_start, window_start + INTERVAL '{window}' AS window_end, mention,
               coalesce(count, 0) AS count
        FROM slots LEFT JOIN counts USING (mention, window_start)""",
    )


ALL_COUNTS = "SELECT window_start, window_end, mention, count FROM counts"
COUNT_MESSAGES = """
SELECT 'top-counts' AS topic, mention AS key,
       CAST(json_object('count', count, 'value', mention) AS VARCHAR) AS value,
       window_start, window_end FROM counts
"""

SCORED_POSTS = f"""{POSTS},
scores AS (SELECT id, created_at, text, mentions, {mean('text')} AS polarity FROM english),
scored_posts AS (SELECT *, {bucket('polarity')} AS cat FROM scores)
"""

SCORED = f"""{SCORED_POSTS},
scored AS (
  SELECT DISTINCT mention, id, created_at, text, cat, polarity
  FROM (SELECT *, lower(unnest(mentions)) AS mention FROM scored_posts) WHERE mention IN {KEYS}
)
"""

LABELLED = """
labelled AS (
  SELECT doc_id, text,
         CASE WHEN quality = 0 THEN 'Negative' WHEN toxic = 1 THEN 'neutral' ELSE 'POSITIVE' END
           AS airline_sentiment,
         CASE WHEN quality = 0 THEN '-' WHEN toxic = 1 THEN '=' ELSE '+' END AS polarity
  FROM documents JOIN labels USING (doc_id)
)
"""

SCORED_LABELS = f"""{LABELLED},
scored AS (SELECT doc_id, polarity, {mean('text')} AS sentiment FROM labelled)
"""

COUNTERS = f"""{SCORED_LABELS},
counters AS (
  SELECT count(*) FILTER (polarity = '+') AS pos_true,
         count(*) FILTER (sentiment > 2.0) AS pos_predicted,
         count(*) FILTER (polarity = '+' AND sentiment > 2.0) AS pos_correct,
         count(*) FILTER (polarity = '-') AS neg_true,
         count(*) FILTER (sentiment <= 2.0) AS neg_predicted,
         count(*) FILTER (polarity = '-' AND sentiment <= 2.0) AS neg_correct
  FROM scored
),
rates AS (
  SELECT *, pos_correct / nullif(pos_predicted, 0)::DOUBLE AS pos_precision,
            pos_correct / nullif(pos_true, 0)::DOUBLE AS pos_recall,
            neg_correct / nullif(neg_predicted, 0)::DOUBLE AS neg_precision,
            neg_correct / nullif(neg_true, 0)::DOUBLE AS neg_recall
  FROM counters
)
"""

SUPPLIER_LINES = """
lines AS (
  SELECT s_name AS name, '@' || replace(s_name, '#', '_') AS handle FROM supplier
  UNION ALL
  SELECT CASE c_mktsegment WHEN 'BUILDING' THEN c_name ELSE '' END,
         CASE c_mktsegment WHEN 'BUILDING' THEN '@' || c_mktsegment ELSE c_name END
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
)
"""

POSNEG = """
SELECT coalesce(mention, 'Total') AS "index",
       CAST(count(*) FILTER (cat = '+') AS BIGINT) AS positive,
       CAST(count(*) FILTER (cat = '-') AS BIGINT) AS negative,
       mention IS NULL AS is_total
FROM scored {where} GROUP BY ROLLUP (mention)
"""

TOP_REPORT = f"""
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY count DESC, mention) AS rank FROM counts
),
reports AS (
  SELECT window_start, window_end,
         repeat('_', 72) || chr(10) || 'Top 3 handles in the last 86400000 ms (non-cumulative):'
           || chr(10) || '  '
           || string_agg(count || ' -> @' || mention, chr(10) || '  ' ORDER BY rank) AS value
  FROM ranked WHERE rank <= 3 GROUP BY ALL
)
"""

PREDICTION_INPUT = rf"""
input AS (
  SELECT doc_id, regexp_replace(text, '[\n\r]+', ' ', 'g') AS text,
         CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 'Negative'
              WHEN toxic = 1 THEN 'neutral' ELSE 'POSITIVE' END AS actual
  FROM documents LEFT JOIN labels USING (doc_id)
)
"""

SENTIMENT_REPORT = f"""
SELECT '    [' || {fixed('polarity', 1)} || ']: ' || text AS value FROM placed
UNION ALL
SELECT '  (' || cat || ')' FROM (SELECT DISTINCT window_start, cat FROM placed)
UNION ALL
SELECT repeat('_', 72) || chr(10) || 'Tweets with sentiment in the last 86400000 ms:'
FROM (SELECT DISTINCT window_start FROM placed)
"""

DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"

SENTIMENT_ROWS = f"WITH {SCORED}, placed AS ({sliding('scored', *DAILY)})"

ORACLE: dict[str, str] = {
    "dictionary_scan": f"""WITH {SUPPLIER_LINES}
        SELECT name, lower(handle) AS handle, substr(lower(handle), 2) AS handle_key FROM lines""",
    "dictionary_keys": f"""WITH {SUPPLIER_LINES}
        SELECT DISTINCT substr(lower(handle), 2) AS handle_key FROM lines""",
    "dictionary_display": f"WITH {SUPPLIER_LINES} SELECT handle, name FROM lines",
    "filter_lang_repost": f"WITH {POSTS} SELECT id, created_at, lang, retweet_count FROM english",
    "post_rejects": f"WITH {POSTS} SELECT id, retweet_count % 10 > 1 AS readable FROM posts",
    "extract_mentions": rf"""WITH {POSTS}
        SELECT id, unnest(regexp_extract_all(text, '(?:^|[^\w@])@(\w+)', 1)) AS mention FROM posts""",
    "mention_entities": f"WITH {POSTS} SELECT id, unnest(mentions) AS mention FROM posts",
    "dictionary_semi_join": f"WITH {MENTIONS} SELECT mention, id, created_at FROM mentions",
    "dictionary_salted_join": f"WITH {MENTIONS} SELECT mention, id FROM mentions",
    "key_by_mention": f"""WITH {POSTS}
        SELECT mention, id, created_at, text
        FROM (SELECT id, created_at, text, lower(unnest(mentions)) AS mention FROM english)
        WHERE mention IN {KEYS}""",
    "primary_mention": f"""WITH {POSTS}
        SELECT id, coalesce(list_filter(mentions, lambda m: m IN {KEYS})[1], '<unk>') AS mention
        FROM posts""",
    "primary_mention_large": f"""WITH {POSTS}, {SUPPLIER_LINES}, keys AS (
          SELECT substr(lower(handle), 2) AS key FROM lines UNION SELECT unnest(['click', 'view', 'purchase'])
        ), placed AS (
          SELECT id, mentions[place] AS mention, place FROM (SELECT id, mentions, unnest(range(1, len(mentions) + 1)) AS place FROM posts)
        ), found AS (SELECT id, min_by(mention, place) AS mention FROM placed JOIN keys ON mention = key GROUP BY id)
        SELECT id, coalesce(found.mention, '<unk>') AS mention FROM posts LEFT JOIN found USING (id)""",
    "track_filter_many_terms": f"""WITH {POSTS}, {SUPPLIER_LINES}, terms AS (
          SELECT DISTINCT lower(handle) AS term FROM lines UNION SELECT unnest(['@click', '@view', '@purchase'])
        ), pieces AS (
          SELECT DISTINCT id, '@' || unnest(string_split(lower(text), '@')[2:]) AS piece FROM posts
        ), cut AS (
          SELECT DISTINCT id, left(piece, n) AS term FROM pieces, (SELECT DISTINCT length(term) AS n FROM terms) WHERE n <= length(piece)
        ), found AS (SELECT DISTINCT id FROM cut JOIN terms USING (term))
        SELECT id, lang FROM posts JOIN found USING (id)""",
    "track_filter_mentions": rf"""WITH {POSTS}, {SUPPLIER_LINES}, keys AS (
          SELECT substr(lower(handle), 2) AS key FROM lines UNION SELECT unnest(['click', 'view', 'purchase'])
        ), found AS (
          SELECT id, lower(unnest(regexp_extract_all(text, '(?:^|[^\w@])@(\w+)', 1))) AS mention FROM posts
        ), hits AS (SELECT DISTINCT id FROM found JOIN keys ON mention = key)
        SELECT id, lang FROM posts JOIN hits USING (id)""",
    "track_filter": f"""WITH {POSTS}
        SELECT id, lang FROM posts
        WHERE contains(lower(text), '@click') OR contains(lower(text), '@view')
           OR contains(lower(text), '@purchase')""",
    "union_sources": f"WITH {POSTS} SELECT id, lang FROM posts UNION ALL SELECT id, lang FROM english",
    "post_projection": f"""WITH {POSTS}
        SELECT id, CAST(floor(epoch_us(created_at) / 1000) AS BIGINT) AS created_at, text FROM posts""",
    "optional_fields": f"""WITH {POSTS}
        SELECT id, CASE WHEN event_type <> 'error' THEN
                 CAST(json_object('id', user_id, 'name', 'user ' || user_id) AS VARCHAR) END AS "user",
               CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
               CASE WHEN event_type = 'click' THEN value END AS latitude,
               CASE WHEN event_type = 'click' THEN -value END AS longitude,
               event_type <> 'click' AS no_location
        FROM posts""",
    "iso_dates": """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN ts END AS parsed
        FROM events""",
    "post_tsv": f"""WITH {POSTS}
        SELECT concat_ws(chr(9), id, lang,
                 CASE WHEN event_type <> 'error' THEN 'user ' || user_id ELSE 'null' END,
                 CASE WHEN event_type = 'view' THEN source ELSE 'null' END,
                 CASE WHEN event_type = 'click'
                      THEN 'GeoLocation{{latitude=' || value || ', longitude=' || -value || '}}'
                      ELSE 'null' END,
                 CAST(floor(epoch_us(created_at) / 1000) AS BIGINT),
                 strftime(created_at, '%a %b %d %H:%M:%S UTC %Y'),
                 retweet_count, text, is_truncated) AS value
        FROM posts""",
    "first_rows": """SELECT least(5, count(*)) AS rows, least(5, count(*)) AS distinct_ids,
        least(5, count(*)) AS known FROM events""",
    "sample_rows": """SELECT least(15, count(*)) AS rows, least(15, count(*)) AS distinct_ids,
        least(15, count(*)) AS known FROM events""",
    "sliding_count": with_counts(MIN5, ALL_COUNTS),
    "sliding_count_panes": with_counts(MIN5, ALL_COUNTS),
    "sliding_count_daily": with_counts(DAILY, ALL_COUNTS),
    "sliding_count_panes_daily": with_counts(DAILY, ALL_COUNTS),
    "tumbling_count": with_counts(("5 minutes", "5 minutes", 1), ALL_COUNTS),
    "sliding_count_folded": with_counts(MIN5, ALL_COUNTS, "lower(mention)"),
    "sliding_count_zero_fill": zero_filled("1 hour", "15 minutes", 4),
    "zero_fill_odd_slide": zero_filled("21 minutes", "7 minutes", 3),
    "zero_fill_multi_day": zero_filled("2 days", "2 days", 1),
    "topk_per_window": with_counts(
        DAILY,
        """SELECT window_start, window_end, mention, count,
                  row_number() OVER (PARTITION BY window_start ORDER BY count DESC, mention) AS rank
           FROM counts QUALIFY rank <= 3""",
    ),
    "topk_overall": with_counts(DAILY, ALL_COUNTS + " ORDER BY count DESC, mention, window_start LIMIT 10"),
    "counts_descending": f"""WITH {MENTIONS}
        SELECT mention, count(*) AS count FROM mentions GROUP BY mention ORDER BY 2 DESC, 1""",
    "sliding_collect_dedup": f"""WITH {SCORED}, placed AS ({sliding('scored', *MIN5)})
        SELECT window_start, window_end, mention, id, cat, polarity FROM placed""",
    "collect_by_category": f"""WITH {SCORED_POSTS}, placed AS ({sliding('scored_posts', *DAILY)})
        SELECT window_start, window_end, cat, id, polarity, CAST(length(text) AS INTEGER) AS chars FROM placed""",
    "clean_text": f"WITH {POSTS} SELECT id, {CLEAN.format('text')} AS text FROM posts",
    "unclean_rows": f"""WITH {POSTS}
        SELECT 'before' AS step, count(*) FILTER (event_type = 'purchase') AS bad_rows,
               count(*) AS rows FROM posts
        UNION ALL SELECT 'after', 0, count(*) FROM posts""",
    "stop_word_filter": f"""WITH {DOCS}, words AS (
          SELECT id, regexp_extract_all(lower(text), '([a-z'']+)', 1) AS words FROM docs
        ), kept AS (
          SELECT id, len(words) AS words, list_filter(words, lambda w: w NOT IN
            ({", ".join(repr(w) for w in fixtures.STOP_WORDS)})) AS kept FROM words
        )
        SELECT id, words, len(kept) AS kept, array_to_string(kept, ' ') AS text FROM kept""",
    "sentences": f"""WITH {DOCS}, split AS (SELECT id, {sentences('text')} AS s FROM docs)
        SELECT id, CAST(pos - 1 AS INTEGER) AS pos, s[pos] AS sentence
        FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS pos FROM split)""",
    "sentence_scores": f"""WITH {DOCS}, scored AS (SELECT id, {classes('text')} AS c FROM docs)
        SELECT id, CAST(pos - 1 AS INTEGER) AS pos, c[pos] AS class
        FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS pos FROM scored)""",
    "text_score_mean": f"WITH {DOCS} SELECT id, {mean('text')} AS score FROM docs",
    "text_score_lexicon_table": f"WITH {DOCS} SELECT id, {mean('text')} AS score FROM docs",
    "text_score_lexicon_repeated": f"""WITH {DOCS}, scores AS (SELECT id, {mean('text')} AS score FROM docs)
        SELECT * FROM scores UNION ALL SELECT * FROM scores""",
    "text_score_model": """SELECT doc_id AS id,
        least(4, length(text) - length(replace(text, '!', '')))::DOUBLE AS score FROM documents""",
    "text_score_extreme": f"""WITH {DOCS}, scored AS (SELECT id, {classes('text')} AS c FROM docs)
        SELECT id, CASE WHEN len(c) > 0 THEN
          list_reduce(c, lambda a, x: CASE WHEN abs(2 - x) > abs(2 - a) THEN x ELSE a END) END AS class
        FROM scored""",
    "bucket_symbols": f"""WITH {DOCS}, scored AS (SELECT id, {mean('text')} AS polarity FROM docs)
        SELECT id, polarity, {bucket('polarity')} AS cat FROM scored""",
    "bucket_words": f"""WITH {DOCS}, scored AS (SELECT id, {mean('text')} AS polarity FROM docs)
        SELECT id, polarity, {bucket('polarity', 'negative', 'neutral', 'positive')} AS cat FROM scored""",
    "scored_mention_rows": f"WITH {SCORED} SELECT mention, id, created_at, cat, polarity FROM scored",
    "scored_mentions_large": f"WITH {SCORED} SELECT mention, id, created_at, cat, polarity FROM scored",
    "count_messages": with_counts(MIN5, COUNT_MESSAGES),
    "sentiment_messages": f"""{SENTIMENT_ROWS}
        SELECT 'sentiment' AS topic, mention AS key, window_start, window_end, id,
               CAST(floor(epoch_us(created_at) / 1000) AS BIGINT) AS created_at,
               length(text) AS chars, mention, cat, round(polarity, 6) AS polarity
        FROM placed""",
    "sentiment_message_texts": f"""WITH {SCORED}, placed AS ({sliding('scored', *TUMBLING)}),
        records AS (
          SELECT mention, window_start, id, CAST(json_object(
                   'tweet', json_object('id', id, 'created_at', CAST(floor(epoch_us(created_at) / 1000) AS BIGINT), 'text', text),
                   'mention', mention, 'cat', cat, 'polarity', polarity) AS VARCHAR) AS record
          FROM placed
        )
        SELECT mention AS key, window_start, 0 AS part, 1 AS parts, '[' || string_agg(record, ',' ORDER BY id) || ']' AS value
        FROM records GROUP BY ALL""",
    "flatten_messages": f"""WITH {SCORED}
        SELECT mention, cat, polarity, id AS tweet_id,
               make_timestamp(CAST(floor(epoch_us(created_at) / 1000) AS BIGINT) * 1000)
                 AS tweet_created_at, text AS tweet_text
        FROM scored""",
    "lenient_json": """
        WITH raw AS (SELECT event_id, CASE WHEN event_type = 'error' THEN replace(props, ':', ' ')
                                           ELSE props END AS value FROM events)
        SELECT event_id, value, CASE WHEN json_valid(value) THEN CAST(json(value) AS VARCHAR) END
                 AS parsed, json_valid(value) AS is_valid FROM raw""",
    "recount_folded": with_counts(
        DAILY,
        """SELECT lower(mention) AS handle, CAST(sum(count) AS BIGINT) AS count FROM counts
           WHERE window_end = (SELECT max(window_end) FROM counts) GROUP BY 1""",
    ),
    "recount_topic_rows": with_counts(
        DAILY,
        """SELECT lower(mention) AS handle, CAST(sum(count) AS BIGINT) AS count FROM counts
           WHERE window_end = (SELECT max(window_end) FROM counts) GROUP BY 1""",
    ),
    "recount_all_windows": with_counts(
        DAILY, "SELECT lower(mention) AS handle, CAST(sum(count) AS BIGINT) AS count FROM counts GROUP BY 1"
    ),
    "recount_total": with_counts(DAILY, "SELECT CAST(sum(count) AS BIGINT) AS total FROM counts"),
    "offset_range": """SELECT event_type AS topic, min(event_id) AS min_offset,
        max(event_id) AS max_offset FROM events GROUP BY 1""",
    "label_symbols": f"WITH {LABELLED} SELECT doc_id, polarity FROM labelled",
    "labelled_table_scan": f"WITH {LABELLED} SELECT airline_sentiment, text FROM labelled",
    "labelled_export": f"WITH {LABELLED} SELECT text, polarity FROM labelled",
    "label_scores": f"WITH {SCORED_LABELS} SELECT sentiment FROM scored WHERE polarity = '+'",
    "label_mean_std": f"""WITH {SCORED_LABELS}
        SELECT polarity, round(avg(sentiment) - stddev_samp(sentiment), 6) AS low,
               round(avg(sentiment), 6) AS mean,
               round(avg(sentiment) + stddev_samp(sentiment), 6) AS high
        FROM scored GROUP BY polarity""",
    "precision_recall": f"WITH {COUNTERS} SELECT * FROM rates",
    "f1_macro": f"""WITH {COUNTERS}, f AS (
          SELECT 2 * pos_precision * pos_recall / nullif(pos_precision + pos_recall, 0) AS p,
                 2 * neg_precision * neg_recall / nullif(neg_precision + neg_recall, 0) AS n
          FROM rates
        )
        SELECT round(p, 9) AS f1_pos, round(n, 9) AS f1_neg, round((p + n) / 2 * 100, 9) AS score FROM f""",
    "row_count": f"WITH {LABELLED} SELECT count(*) AS rows FROM labelled",
    "score_job": f"""WITH {LABELLED}
        SELECT {CLEAN.format('text')} AS text, polarity, {mean('text')} AS sentiment FROM labelled""",
    "tsv_predictions": f"""WITH {PREDICTION_INPUT},
        scored AS (SELECT *, {mean('text')} AS score FROM input
                   WHERE actual IS NOT NULL AND NOT contains(text, chr(9)))
        SELECT concat_ws(chr(9), 'NA', doc_id, {bucket('score', 'negative', 'neutral', 'positive')},
                         {fixed('score', 2)}, actual, text) AS value FROM scored""",
    "tsv_rejects": f"""WITH {PREDICTION_INPUT}
        SELECT concat_ws(chr(9), 'NA', doc_id, actual, text) AS value FROM input
        WHERE actual IS NULL OR contains(text, chr(9))
        UNION ALL SELECT '' FROM input WHERE doc_id % 10 = 0""",
    "report_topk": with_counts(DAILY, TOP_REPORT + "SELECT * FROM reports"),
    "report_sentiment": f"""WITH {SCORED_POSTS}, placed AS ({sliding('scored_posts', *TUMBLING)})
        {SENTIMENT_REPORT}""",
    "zero_filled_dictionary": f"""WITH {MENTIONS}, {SUPPLIER_LINES},
        handles AS (
          SELECT lower(handle) AS handle FROM lines
          UNION ALL SELECT unnest(['@click', '@view', '@purchase'])
        ), folded AS (SELECT '@' || lower(mention) AS handle, count(*) AS count FROM mentions GROUP BY 1)
        SELECT handle, coalesce(count, 0) AS count FROM handles LEFT JOIN folded USING (handle)""",
    "posneg_rollup": f"WITH {SCORED} {POSNEG.format(where='')}",
    "posneg_rollup_period": f"""WITH {SCORED} {POSNEG.format(
        where="WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-15'")}""",
    "stream_sliding_count": with_counts(MIN5, COUNT_MESSAGES),
    "stream_panes": with_counts(MIN5, COUNT_MESSAGES),
    "stream_processing_time": with_counts(MIN5, COUNT_MESSAGES),
    "stream_outputs": with_counts(
        DAILY,
        TOP_REPORT
        + """, messages AS (SELECT CAST(json_object('count', count, 'value', mention) AS VARCHAR) AS value
                            FROM counts)
        SELECT unnest(string_split(value, chr(10))) AS value, 'report' AS output FROM reports
        UNION ALL SELECT value, 'counts' FROM messages""",
    ),
    "stream_sentiment": f"""{SENTIMENT_ROWS}
        SELECT mention AS key, window_start, window_end, id, cat, round(polarity, 6) AS polarity
        FROM placed""",
    "stream_report_sentiment": f"""WITH {SCORED},
        once AS (SELECT DISTINCT id, created_at, text, cat, polarity FROM scored),
        placed AS ({sliding('once', *TUMBLING)})
        SELECT unnest(string_split(value, chr(10))) AS value FROM ({SENTIMENT_REPORT})""",
    "stream_offsets": with_counts(
        DAILY,
        f""", more AS ({counts(TUMBLING)}),
        n AS (SELECT (SELECT count(*) FROM counts) + (SELECT count(*) FROM more) AS n)
        SELECT 'top-counts' AS topic, n AS rows, n AS offsets, CAST(0 AS BIGINT) AS min_offset, n - 1 AS max_offset FROM n""",
    ),
    "stream_lagging_source": with_counts(DAILY, COUNT_MESSAGES),
    "stream_early_counts": with_counts(DAILY, ALL_COUNTS),
    "stream_zero_fill": zero_filled("1 hour", "15 minutes", 4),
    "stream_recount": with_counts(
        DAILY,
        """SELECT window_end, lower(mention) AS handle, CAST(sum(count) AS BIGINT) AS count
           FROM counts GROUP BY ALL""",
    ),
}
