import pytest

from tablewash.functions.names import clean_dataset_name, normalize_name, normalize_names


@pytest.mark.parametrize("raw,expected", [
    ("First Name", "first_name"),
    ("first name", "firstname"),
    ("userID", "user_id"),
    ("HTTPServer", "http_server"),
    ("a-b", "ab"),
    ("ab", "ab"),
    ("%", ""),
    ("CustKey", "cust_key"),
    ("Acct-Bal", "acct_bal"),
    ("already_snake", "already_snake"),
])
def test_normalize_name(raw, expected):
    assert normalize_name(raw) == expected


def test_empty_name_raises_before_any_work():
    with pytest.raises(ValueError, match="empty"):
        normalize_names(["ok", "%"])


def test_collision_raises_case_insensitive():
    with pytest.raises(ValueError, match="both normalise"):
        normalize_names(["a-b", "ab"])


def test_collision_suffix():
    assert normalize_names(["a-b", "ab", "%"], on_collision="suffix") == ["ab", "ab_2", "column_2"]


def test_clean_once_equals_twice():
    names = ["First Name", "userID", "HTTPServer", "x y z"]
    once = normalize_names(names)
    assert normalize_names(once) == once


def test_dataset_name():
    assert clean_dataset_name("my-data set_1 ") == "mydataset_1"
