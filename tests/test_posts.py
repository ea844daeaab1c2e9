import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mentionflow.operators import bloom, lookup, posts
from mentionflow.schemas import POSTS
from mentionflow.sources.posts import readable_posts, unreadable_posts
from mentionflow.sinks import reports
from mentionflow.sources.posts import read_posts

AT = dt.datetime(2016, 2, 7, 10, 11, 12, 345000)


def post(id, lang="en", repost=False, mentions=(), text="t", user=None, geo=None, place=None):
    return (id, lang, user, place, geo, AT, 3, text, False, repost, list(mentions))


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [
            post(1, mentions=["United", "united", "other"], text="hi @United"),
            post(2, lang=None, mentions=["klm"]),
            post(3, lang="EN", mentions=["klm"]),
            post(4, repost=True, mentions=["klm"]),
            post(5, mentions=["KLM", "united", "KLM"], user=(7, "Ann"), geo=(1.5, -2.0), place="Rome"),
            post(6, mentions=[]),
        ],
        POSTS,
    )


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([("united",), ("klm",)], "handle_key string")


def test_only_original_english_posts(frame):
    assert sorted(r.id for r in posts.original_posts(frame).collect()) == [1, 5, 6]


def test_counted_mentions_keep_spelling_and_repeats(frame, keys):
    found = posts.counted_mentions(posts.original_posts(frame), keys)
    assert sorted(r.mention for r in found.collect()) == ["KLM", "KLM", "United", "united", "united"]
    folded = posts.counted_mentions(posts.original_posts(frame), keys, fold_case=True)
    assert sorted(r.mention for r in folded.collect()) == ["klm", "klm", "united", "united", "united"]


def test_key_by_mention_is_lower_case_with_the_whole_post(frame, keys):
    found = posts.keyed_by_mention(frame.where("id = 5"), keys)
    assert sorted(r.mention for r in found.collect()) == ["klm", "klm", "united"]
    assert "text" in found.columns and "user" in found.columns


def test_hits_are_the_same_in_the_row_and_by_join(frame, keys):
    small = posts.with_hits(frame, keys)
    large = posts.with_hits(frame, keys, max_rows=1)

    def pairs(df):
        return sorted((r.id, r.h) for r in df.select("id", F.explode("hits").alias("h")).collect())

    assert pairs(small) == pairs(large)
    assert [h for i, h in pairs(small) if i == 5] == ["klm", "united"]
    assert small.where("id = 6").count() == 0


def test_semi_join_broadcasts_a_small_dictionary_only(frame, keys):
    mentions = posts.explode_mentions(frame)
    small, large = posts.in_dictionary(mentions, keys), posts.in_dictionary(mentions, keys, max_rows=1)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_dimension_bounds(spark):
    dim = spark.range(10).withColumn("s", F.lit("x" * 100))
    assert lookup.fits(dim)
    assert not lookup.fits(dim, max_rows=9)
    assert not lookup.fits(dim, max_bytes=500)
    assert lookup.bounded_values(dim, "id", 10) == list(range(10))
    assert lookup.bounded_values(dim, "id", 9) is None


def test_primary_mention_compares_raw_spelling(frame):
    first = posts.primary_mention(F.col("mentions"), ["united", "klm"])
    found = {r.id: r.m for r in frame.select("id", first.alias("m")).collect()}
    assert found == {1: "united", 2: "klm", 3: "klm", 4: "klm", 5: "united", 6: "<unk>"}


def test_large_dictionaries_give_the_same_rows(frame):
    keys = frame.sparkSession.createDataFrame([(k,) for k in ["united", "klm", *(f"k{i}" for i in range(50))]], "handle_key string")
    twice = frame.union(frame)
    first = posts.primary_mention(F.col("mentions"), ["united", "klm"])
    want = sorted((r.id, r.m) for r in twice.select("id", first.alias("m")).collect())
    none = {"max_rows": 0}
    found = posts.primary_mentions(twice, keys, 0, none)
    assert sorted((r.id, r.mention) for r in found.collect()) == want
    hits = [sorted((r.id, *r.hits) for r in posts.with_hits(twice, keys, *options).collect()) for options in ((), (0,), (0, none))]
    assert hits[0] == hits[1] == hits[2] and len(hits[0]) % 2 == 0
    handles = keys.withColumn("handle", F.concat(F.lit("@"), "handle_key"))
    tracked = posts.tracked_by_mention(frame, handles, 0, none)
    assert tracked.columns == frame.columns
    assert sorted(r.id for r in tracked.collect()) == sorted(r.id for r in posts.tracked_by_mention(frame, handles).collect())


@pytest.mark.parametrize("most_bits", [1 << 23, 1 << 10])
def test_a_bloom_filter_keeps_every_key(spark, most_bits):
    keys = spark.range(0, 3000, 3).union(spark.sql("SELECT CAST(NULL AS LONG)")).withColumnRenamed("id", "k")
    may_have = bloom.bloom_filter(keys, "k", most_bits)
    rows = spark.range(3000).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    passed = {r.id for r in rows.where(may_have(F.col("id"))).collect()}
    assert passed >= {None, *range(0, 3000, 3)}
    assert most_bits == 1 << 10 or len(passed) < 1001 + 100
    none = bloom.bloom_filter(keys.limit(0), "k")
    assert rows.where(none(F.col("id"))).count() == 0


def test_texts_without_a_hit_are_not_shuffled(spark):
    rows = [post(i, mentions=[f"h{i}"], text="long text " * 50) for i in range(2000)]
    frame = spark.createDataFrame(rows, POSTS).repartition(2)
    keys = spark.createDataFrame([(f"h{i}",) for i in range(0, 2000, 100)], "handle_key string")
    found = posts.with_hits(frame, keys, 0, {"max_rows": 0})
    assert sorted(r.id for r in found.select("id").collect()) == list(range(0, 2000, 100))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.split("Join Inner")[1].lower()  # texts meet the filter below the join
    passed = posts.bloom_filter(found.select("id"), "id")
    assert frame.where(passed(F.col("id"))).count() < 60


def test_unreadable_posts_are_routed_apart(spark):
    texts = ['{"id": 1, "text": "a"}', "{broken", "", "17", "null", None, '{"id": "x"}', '{"id": 2, "other": 1}', "[1]"]
    raw = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, offset long")
    assert sorted(r.id for r in readable_posts(raw).collect()) == [1, 2]
    assert readable_posts(raw).columns == POSTS.fieldNames()
    rejects = unreadable_posts(raw)
    assert rejects.columns == ["value", "offset"] and sorted(r.offset for r in rejects.collect()) == [1, 2, 3, 4, 5, 6, 8]


def test_track_terms_and_text_mentions(frame):
    assert [r.id for r in posts.tracked_posts(frame, ["@united", "@klm"]).collect()] == [1]
    assert posts.with_mentions(frame).where("id = 1").first().mentions == ["United"]


@pytest.mark.parametrize("n_terms", [0, 1, 400, 4000])
def test_lists_of_any_length_find_what_a_search_finds(spark, n_terms):
    rng = random.Random(n_terms)
    texts = ["see @click now", "@clickbait", "me@click.com", "@CLICK", "click", "@cl ick", "@@click", None, "", "x @Ä\n@ü@b", "\U0001f389@f\U0001f389 x", "#tag"]
    texts += ["".join(rng.choices("ab@ #", k=rng.randint(0, 30))) for _ in range(300)]
    rows = [post(i % 290, text=t) for i, t in enumerate(texts)]  # some ids stand for several posts
    frame = spark.createDataFrame(rows, POSTS)
    words = ["@click", "@ä", "@ü@b", "\n@ü", "@f\U0001f389", "#t", "b@", "aa", "@ab"]
    words += ["@" + "".join(rng.choices("ab", k=rng.randint(2, 14))) for _ in range(n_terms)]
    words = words[:n_terms]
    terms = spark.createDataFrame([(w,) for w in [*words, None]], "term string")
    expected = sorted(i % 290 for i, t in enumerate(texts) if t is not None and any(w in t.lower() for w in words))
    assert not n_terms or expected
    for limit, lookup in ((400, None), (0, None), (0, {"max_rows": 0})):
        found = posts.tracked_by_terms(frame, terms, max_terms=limit, lookup=lookup)
        assert found.columns == frame.columns
        assert sorted(r.id for r in found.collect()) == expected
    every = posts.tracked_by_terms(frame, terms.union(spark.createDataFrame([("",)], "term string")), max_terms=0)
    assert every.count() == len([t for t in texts if t is not None])


def test_union_keeps_duplicates(frame):
    assert posts.union_sources(frame, frame, frame).count() == 18


def test_projections(frame):
    one = frame.where("id = 5").select(
        posts.emitted_post().alias("p"), posts.optional_user().alias("u"), posts.optional_location().alias("g")
    ).first()
    assert tuple(one.p) == (5, 1454839872345, "t")
    assert tuple(one.u) == (7, "Ann") and tuple(one.g) == (1.5, -2.0)
    none = frame.where("id = 1").select(posts.optional_user(), posts.optional_location()).first()
    assert tuple(none) == (None, None)


def test_post_lines_show_null_for_what_is_missing(frame):
    lines = [r.value for r in reports.post_lines(frame.where("id in (2, 5)")).collect()]
    shown = "1454839872345\tSun Feb 07 10:11:12 UTC 2016\t3\tt\tfalse"
    assert lines == [
        f"2\tnull\tnull\tnull\tnull\t{shown}",
        f"5\ten\tAnn\tRome\tGeoLocation{{latitude=1.5, longitude=-2.0}}\t{shown}",
    ]


def test_posts_round_trip_through_files(spark, frame, tmp_path):
    for fmt in ("parquet", "json"):
        frame.write.format(fmt).save(str(tmp_path / fmt))
        back = read_posts(spark, str(tmp_path / fmt), fmt)
        assert back.schema == POSTS
        assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_samples_have_the_asked_size(spark):
    df = spark.range(100)
    assert posts.first_rows(df).count() == 5
    assert posts.random_rows(df, 15, seed=1).distinct().count() == 15


def test_large_lists_shuffle_only_what_the_list_may_hold(spark, monkeypatch):
    moved = []

    def lookup_join(rows, *rest, **bounds):
        moved.append(rows)
        return lookup.lookup_join(rows, *rest, **bounds)

    monkeypatch.setattr(posts, "lookup_join", lookup_join)
    text = "@known " + " ".join(f"cab{n} @user{n}" for n in range(300))
    frame = spark.createDataFrame([(n, text if n % 2 else "@other", n) for n in range(6)], "id long, text string, n int")
    terms = spark.createDataFrame([("@known",), ("cabinet7890",)], "term string")
    handles = spark.createDataFrame([("known",), ("nobody",)], "handle_key string")
    none = {"max_rows": 0}
    for found in (posts.tracked_by_terms(frame, terms, max_terms=0, lookup=none), posts.tracked_by_mention(frame, handles, 0, none)):
        assert sorted(r.id for r in found.collect()) == [1, 3, 5]
    for rows in moved:  # of hundreds of candidates and mentions a text, without arrays of all of them
        assert "array" not in {t.split("<")[0] for _, t in rows.dtypes}
        assert rows.count() < 3 * 20
