import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    from helpers import odd_rows, write_tables

    body = "<p>some words of the main text here</p>"
    pages = [
        (1, "http://a.example/x", f"<html><head><title>T</title></head><body><nav><a href='/'>home</a></nav><article>{body * 3}</article><footer>foot</footer></body></html>", "n"),
        (2, None, None, "n"), (3, "u", "", "n"), (4, "u", "no markup at all &amp; done", "n"), (5, "u", "<p>unclosed <b>text", "n"), (6, "u", "x" * 100, "n"), (7, "u", "x" * 100, "n"),
        (7, "u", "x" * 100, "n"), (8, "u", "x" * 99, "n"), (9, "u", "x" * 99, "n"), (None, "u", "x" * 100, "n"), (10, "u\r\nX: y", "é\r\n\r\n" * 60, "n"), (11, "u", "<div><div>" * 2000 + "deep" + "</div>", "n"),
    ]
    labels = [(d, d % 2, 0) for d in range(1, 17)]
    return write_tables(spark, tmp_path_factory.mktemp("odd"), odd_rows(), pages, labels)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    from helpers import write_tables

    return write_tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def small():
    return SMALL
