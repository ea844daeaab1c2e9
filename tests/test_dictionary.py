import pytest

from mentionflow.sources import dictionary

LINES = ["Alpha Air,@AlphaAir", "x,y,", ",b", "a,", "a,b,c", "", ",,", "Beta,@BETA  ", "Alpha,@alphaair"]


@pytest.fixture
def lines(spark, tmp_path):
    path = tmp_path / "handles"
    path.write_text("\n".join(LINES))
    return dictionary.read_lines(spark, str(path))


def test_lines_with_exactly_two_fields_are_kept(lines):
    found = {(r.name, r.handle, r.handle_key) for r in dictionary.handles(lines).collect()}
    assert found == {
        ("Alpha Air", "@alphaair", "alphaair"), ("x", "y", ""), ("", "b", ""),
        ("Beta", "@beta  ", "beta  "), ("Alpha", "@alphaair", "alphaair"),
    }


def test_keys_are_distinct_without_first_character(lines):
    assert sorted(r[0] for r in dictionary.handle_keys(lines).collect()) == ["", "alphaair", "beta  "]


def test_display_table_keeps_case_and_strips_the_line(lines):
    found = [tuple(r) for r in dictionary.display_table(lines).collect()]
    assert ("@AlphaAir", "Alpha Air") in found and ("@BETA", "Beta") in found


def test_terms_are_bounded(lines):
    assert "@alphaair" in dictionary.terms(dictionary.handles(lines))
    with pytest.raises(ValueError, match="too many"):
        dictionary.terms(dictionary.handles(lines), max_terms=1)
