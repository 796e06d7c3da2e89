"""Small hostile tables for the training-data operators."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SYLLABLES = "the an re in on ti er ha en ou st nd ing ly ble".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(n)]
    return "".join(w + rng.choice((" ", " ", " ", " ", ".\n")) for w in words)


def hostile_documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, nulls everywhere, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice((5, 40, 90, 200))), rng.choice(("en", "de", None)), rng.choice(("hot", "hot", "b", None)), 1) for i in range(n)]
    base = rows[3][1] + prose(rng, 120)
    for k in range(8):
        words = base.split(" ")
        words[k * 3] = f"edit{k}"
        rows.append((n + k, " ".join(words), "en", "hot", None))
    rows += [(n + 20 + k, base, "en", "hot", None) for k in range(5)]
    rows += [(n + 40, None, None, None, None), (n + 41, "", "en", "b", 0), (n + 42, " \t\n\x0b\f\r ", "en", "b", 0), (n + 43, "one", "en", "b", 3), (n + 44, "É 日本 \U0001f600 ß " * 30, "fr", "c", None)]
    rows += [(n + 45, "the " * 30_000, "en", "hot", None), (n + 46, prose(rng, 20_000), "en", "hot", None), (n + 47, "x" * 70_000, "en", "hot", None)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], "en", "b", None), (None, base, "en", "hot", None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "conversations": pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
}


@pytest.fixture
def tables(tmp_path):
    """write(documents=rows, ...) -> folder; tables that aren't named are empty."""

    def write(**rows):
        for name, schema in SCHEMAS.items():
            cols = list(zip(*rows.get(name, []), strict=True)) or [[] for _ in schema]
            pq.write_table(pa.table([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def documents():
    return hostile_documents()
