import pytest
from mentionflow.functions import text, times



def test_clean_replaces_emoji_and_variation_selector(values, X):
    rows = ["a\U0001f600b", "x️y", "plain é 中", "", None]
    assert values("string", rows, text.clean(X)) == ["a b", "x y", "plain é 中", "", None]


def test_assert_clean_passes_clean_text_and_fails_on_the_rest(values, X):
    assert values("string", ["ok", None], text.assert_clean(X)) == ["ok", None]
    with pytest.raises(Exception, match="unreadable"):
        values("string", ["\U0001f600"], text.assert_clean(X))


def test_sentences_keep_order_and_drop_blank_ones(values, X):
    rows = ["One. Two!  ?Three", "...", "", " \n. a"]
    expected = [["One", " Two", "Three"], [], [], [" a"]]
    assert values("string", rows, text.sentences(X)) == expected


def test_mentions_are_taken_as_written(values, X):
    rows = ["@United hi @united", "mail a@b.com", "@@x", "(@a) @b_1, @a", "é@c"]
    expected = [["United", "united"], [], [], ["a", "b_1", "a"], ["c"]]
    assert values("string", rows, text.mentions_in(X)) == expected


def test_stop_words_are_dropped_and_repeats_kept(values, X):
    words = text.without_stop_words(text.tokens(X), ["the"])
    assert values("string", ["The cat the CAT don't"], words) == [["cat", "cat", "don't"]]


def test_fixed_rounds_half_up_and_shows_null(values, X):
    rows = [2.125, 2.0, 1.005, None]
    assert values("double", rows, text.fixed(X, 2)) == ["2.13", "2.00", "1.01", "null"]


def test_parse_iso_gives_null_for_absent_or_bad_dates(values, X):
    shown = times.parse_iso(X).cast("string")
    rows = ["2016-02-07T10:11:12Z", "2016-02-07", "soon", None]
    assert values("string", rows, shown) == ["2016-02-07 10:11:12", "2016-02-07 00:00:00", None, None]


def test_epoch_millis_round_trip(values, X):
    back = times.epoch_millis(times.from_epoch_millis(X))
    assert values("long", [0, 1454855472123, -1], back) == [0, 1454855472123, -1]


def test_durations():
    assert times.micros("5 minutes") == 300_000_000
    assert times.micros("1 day") == 24 * times.micros("1 hour")
