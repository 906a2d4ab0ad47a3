import gzip
import hashlib

import pytest

from gapwise.llm import op2_warc as warc
from gapwise.llm.queries import queries

BIG = "<html>" + "x" * 200


def brute(rows):
    """rows: (page_id, payload).  Expected (page_id, bytes, digest, type, refers_to), for distinct ids."""
    first = {}
    for page_id, payload in rows:
        if len(payload) >= 100:
            digest = hashlib.sha256(payload).hexdigest()
            first[digest] = min(first.get(digest, page_id), page_id)
    found = []
    for page_id, payload in rows:
        digest = hashlib.sha256(payload).hexdigest()
        again = first.get(digest, page_id) != page_id
        found.append((page_id, len(payload), digest, "revisit" if again else "response", first[digest] if again else None))
    return sorted(found)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_query_matches_brute_force(spark, tiny_dir):
    pages = spark.read.parquet(f"{tiny_dir}/pages.parquet").collect()
    found = queries()["op2_warc"](spark, tiny_dir)
    rows = sorted(map(tuple, found.select(*COLUMNS).collect()))
    assert rows == brute([(p["page_id"], (p["html"] or "").encode()) for p in pages])
    assert found.where("not valid").count() == 0


def test_copies_ties_and_odd_rows(spark, tmp_path):
    rows = [
        (3, "http://a/", BIG), (1, None, BIG), (1, "http://b\n/", BIG), (2, "u", "short"), (9, "u", "short"),
        (None, "u", BIG), (4, "", None), (5, "u", ""), (6, "u", "é" * 60), (7, "u", "é" * 60),
        (None, "n", BIG + "only without id"), (None, "n", BIG + "only without id"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id int, url string, html string, digest string")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w"))
    assert found.where("valid").count() == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found.collect())
    assert kinds == sorted([
        (3, "revisit", 1), (1, "response", 0), (1, "revisit", 1), (2, "response", 0), (9, "response", 0),
        (0, "revisit", 1), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "revisit", 6),
        (0, "response", 0), (0, "revisit", 0),
    ])


def test_files_roll_are_sorted_and_the_same_again(spark, tmp_path, tiny_dir):
    pages = spark.read.parquet(f"{tiny_dir}/pages.parquet")
    params = warc.WarcParams(roll_bytes=2_000)
    one = warc.write_archives(pages, str(tmp_path / "one"), params).orderBy("name").collect()
    two = warc.write_archives(pages, str(tmp_path / "two"), params).orderBy("name").collect()
    assert [(r["name"], r["file_digest"]) for r in one] == [(r["name"], r["file_digest"]) for r in two]
    assert len(one) > len({r["partition"] for r in one})
    assert all(a["last_page"] < b["first_page"] for a, b in zip(one, one[1:]))
    for r in one:
        data = (tmp_path / "one" / r["name"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["file_digest"] and len(data) == r["bytes"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not list((tmp_path / "one").glob("_temporary/*"))


def test_broken_archives_are_errors():
    record = warc.page_record(1, "u", b"payload", "d", 0, None, warc.WarcParams())
    with pytest.raises(ValueError):
        list(warc.members(iter([record[:-9]])))
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_archives(pages, str(tmp_path / "w")).count() == 0
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
