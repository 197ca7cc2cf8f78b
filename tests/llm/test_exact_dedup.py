import hashlib
from collections import defaultdict

import pytest

from tests.llm.fixtures import documents, rows
from titrate.llm import exact_dedup


def lowered(text):
    return (text or "").encode().lower()


def expected(data):
    groups = defaultdict(list)
    for r in data:
        groups[lowered(r[1])].append(r[0])
    out = []
    for r in data:
        ids = [i for i in groups[lowered(r[1])] if i is not None]
        out.append((r[0], max(ids, default=None), len(groups[lowered(r[1])]), hashlib.sha256(lowered(r[1])).hexdigest()))
    return groups, sorted(out, key=repr)


@pytest.mark.parametrize("bucket,fold", [(exact_dedup.BUCKET_BYTES, exact_dedup.FOLD_BYTES), (2000, 500)])
def test_agrees_with_brute_force(spark, bucket, fold):
    """Also with tables so small that records overflow through several levels."""
    data = rows()
    docs = documents(spark).repartition(3, "doc_id")
    docs.write.mode("overwrite").parquet(path := f"{_folder(spark)}/docs")
    found = exact_dedup.exact_dedup(spark.read.parquet(path), bucket_bytes=bucket, fold_bytes=fold)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "uid", "topic", "key", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    got = found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups, want = expected(data)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and len({r["text_sha256"] for r in kept}) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def _folder(spark):
    import tempfile

    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_table_compares_content_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(exact_dedup.xxhash, "xxh64_intdigest", lambda content, seed: 7)
    store = exact_dedup.ContentTable(0, 1 << 20)
    for k in range(2000):
        assert store.add(str(k % 700).encode(), (1, k, k), 1)
    assert len(store.contents) == 700 and sum(store.copies) == 2000
    assert store.tops[store.contents.index(b"5")] == (1, 1405, 1405)


def test_full_table_takes_known_contents_only():
    store = exact_dedup.ContentTable(0, 10)
    assert store.add(b"x" * 50, (1, 1, 1), 1)  # a single content always fits
    assert not store.add(b"y", (1, 2, 2), 1)
    assert store.add(b"x" * 50, (1, 3, 3), 1) and store.copies == [2]


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
