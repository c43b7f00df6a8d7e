"""Small tables for the operators: ordinary documents, and a table of odd rows."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
#: Names that the operators use inside; here they are columns of the input.
CLASHING = ("piece", "size", "key", "id", "line", "band", "n", "label", "score", "copies", "row", "h", "blob", "word", "part", "kept", "__key", "__text", "__n", "__kept", "__row", "__drop", "__word", "__bits")


def rng_text(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def write(folder, rows, labels=()):
    folder.mkdir(parents=True, exist_ok=True)
    table = pa.Table.from_pylist(rows, SCHEMA)
    pq.write_table(table, folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(list(labels), pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    return str(folder)


def odd_rows() -> list[dict]:
    """NULLs in every column, empty and blank and very long texts, repeated rows, equal and NULL ids."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "été", "12", "x'll", "secret", "the"]
    long = rng_text(rng, 30_000, words)
    texts = [None, "", " \n\t ", "one", "two words", "two words", long, rng_text(rng, 300, words), "Here " * 500, "日本語のテキスト", "a\x00b\x1cc", "token = \"0123456789abcdef0123456789abcdef\"", rng_text(rng, 40, words) + "\n" + rng_text(rng, 40, words)]
    rows = [{"doc_id": i, "text": t, "lang": ["en", "fr", None][i % 3], "source": ["a", None, "b"][i % 3], "n_chars": None if i % 4 == 0 else len(t or "")} for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], {**rows[6], "doc_id": 3}, {**rows[3], "doc_id": None}, {**rows[4], "doc_id": None}]


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd") / "t", odd_rows(), [{"doc_id": i, "quality": i % 2, "toxic": 0} for i in range(12)])


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("none") / "t", [])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
