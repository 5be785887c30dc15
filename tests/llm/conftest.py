import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept string, label bigint, id string, size bigint, ids binary"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, short, long and repeated texts, ties, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60", "other")
    texts = [None, "", " \n\t", "one", "one two", base, base, near, "x y " * 400, base + " " + " ".join(f"v{i}" for i in range(3000)), "É é 日本語 🙂\n" * 5, base.upper()]
    rows = [(i, t, None if i == 3 else "en", None if i % 5 == 0 else f"src{i % 3}", len(t or ""), i, "k", 7, "z", 1, b"") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None, None, None), (5, base, "en", "src2", len(base), 1, "k", 7, "z", 1, b"")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id < -1")


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest shared documents, or a made-up stand-in."""
    from pathlib import Path

    path = "/root/testdata/sf0.001/documents.parquet"
    if Path(path).exists():
        return spark.read.parquet(path)
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(20 + i % 150)), "en", f"src{i % 4}", 0) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
