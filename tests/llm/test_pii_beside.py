"""Personal data beside other numbers, in groups and in the usual date forms."""

import pytest
from drawspark.llm import pii

CASES = [
    ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]), ("4111111111111111 12/27", ["4111111111111111"]), ("no 12 4111111111111111", ["4111111111111111"]),
    ("4111111111111111 161.17.88.162", ["4111111111111111", "161.17.88.162"]), ("1234 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("3782 822463 10005 99", ["3782 822463 10005"]),
    ("4111111111111111 5500000000000004", ["4111111111111111", "5500000000000004"]), ("4111111111111111 123-45-6789", ["4111111111111111", "123-45-6789"]),
    ("4111111111111111 2024-01-05", ["4111111111111111", "2024-01-05"]), ("4111111111111111 988.555.2485", ["4111111111111111", "988.555.2485"]), ("4111111111111111 12ann@x.com", ["4111111111111111", "12ann"]),
    ("GB82 WEST 1234 5698 7654 32", ["WEST 1234 5698 7654 32"]), ("GB82 WEST 1234 5698 7654 32 OK", ["WEST 1234 5698 7654 32"]), ("born 31/12/1999", ["31/12/1999"]), ("born 12/31/1999.", ["12/31/1999"]), ("am 5.6.2001 da", ["5.6.2001"]), ("1999/12/31", ["1999/12/31"]), ("31-12-1999", ["31-12-1999"]),
]
STAY = ["not 4111 1111 1111 1112", "31/13/1999 and 13/31/1999", "GB82 WEST 1234 5698 7654 33", "12 34 56", "4111111111111112 12/27"]


@pytest.fixture(scope="module")
def got(spark):
    texts = [t for t, _ in CASES] + STAY
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    return {texts[r["id"]]: r["text"] for r in rows}


@pytest.mark.parametrize("text, private", CASES)
def test_replaced(got, text, private):
    assert all(p not in got[text] for p in private), got[text]


@pytest.mark.parametrize("text", STAY)
def test_stays(got, text):
    assert got[text] == text
