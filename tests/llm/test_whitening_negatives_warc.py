"""Whitening, hard negatives and archives against plain versions, and their edge cases."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import hard_negatives as mining
from tallymark.llm import queries, warc
from tallymark.llm.hard_negatives import best, hard_negatives, strassen
from tallymark.llm.warc import read_warc, record_key, write_warc
from tallymark.llm.whitening import whiten
from workload.check import difference, duck

MORE = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"


# Whitening


def plain_whitening(rows, components=8):
    """Ids, exact deviations, whitened rows and shares of the variance."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows]
    n, x = len(kept), [v for _, v in kept]
    sums = [sum(column) for column in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    projected = centred @ directions[:, :components] / np.sqrt(values[:components])
    return [i for i, _ in kept], deviations, projected, values[:components] / values.sum()


def test_whitening_equals_a_plain_version(spark):
    table = spark.read.parquet(f"{MORE}/embeddings.parquet")
    ids, deviations, projected, explained = plain_whitening([(r["vec_id"], r["embedding"]) for r in table.collect()])
    found = {(r["vec_id"], r["component"]): r for r in queries.op11_embedding_whitening(spark, MORE).collect()}
    assert len(found) == 8 * len(ids)
    got = np.array([[found[i, c]["whitened"] for c in range(1, 9)] for i in ids])
    signs = np.sign((got * projected).sum(axis=0))
    assert np.abs(got - signs * projected).max() < 1e-8
    for i, deviation in zip(ids, deviations):
        assert {found[i, c]["deviation"] for c in range(1, 9)} == {deviation}
    assert {r["n"] for r in found.values()} == {len(ids)}
    for c in range(1, 9):
        assert found[ids[0], c]["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
    assert all(0 <= r["identity_error"] < 1e-9 for r in found.values())


def test_whitening_over_many_blocks_and_partitions(spark, monkeypatch):
    from tallymark.llm import whitening

    monkeypatch.setattr(whitening, "BLOCK", 60)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for i in range(300)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(7)
    ids, deviations, projected, _ = plain_whitening(rows, 4)
    found = {r["id"]: r for r in whiten(table, components=4).collect()}
    got = np.array([found[i]["whitened"] for i in ids])
    assert np.abs(np.abs(got) - np.abs(projected)).max() < 1e-9
    assert [int(found[i]["deviation"]) for i in ids] == deviations


def test_whitening_of_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [3.0, 1.0], None),
        (4, None, 0), (5, [], 0), (6, [1.0, None], 0), (7, [1.0, float("nan")], 0), (8, [float("inf"), 1.0], 0),
        (9, [1.0, 2.0, 3.0], 0), (10, [-1e300, 1.0], 0),
    ]
    table = spark.createDataFrame(rows, VECTORS).withColumn("index", F.lit("x")).withColumn("part", F.lit("x"))
    found = whiten(table).collect()
    assert sorted((r["id"] or 0) for r in found) == [0, 1, 2, 2, 10]
    assert {r["n"] for r in found} == {5} and {len(r["whitened"]) for r in found} == {2}
    # The far entry counts as -2^31 and its deviation is exact.
    x = [[100_000 + 1024, 100_000], [100_000, 100_000 + 1024], [100_000, 100_000 + 1024], [103_072, 101_024], [-(2**31), 101_024]]
    sums = [sum(c) for c in zip(*x)]
    expected = sorted(sum((5 * c - s) ** 2 for c, s in zip(v, sums)) for v in x)
    assert sorted(int(r["deviation"]) for r in found) == expected


def test_whitening_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(3)], VECTORS)
    for row in whiten(same).collect():
        assert row["deviation"] == 0 and row["whitened"] == [None, None]
        assert row["explained"] == [None, None] and row["identity_error"] == 0
    flat = spark.createDataFrame([(i, [0.5, float(i)], 0) for i in range(3)], VECTORS)
    for row in whiten(flat).collect():
        assert row["whitened"][0] is not None and row["whitened"][1] is None
    none = whiten(spark.createDataFrame([], VECTORS))
    assert none.columns == whiten(flat).columns and none.count() == 0


# Hard negatives


@pytest.mark.parametrize("sides", [(1, 1, 1), (40, 33, 70), (64, 64, 64), (65, 127, 33), (129, 64, 200)])
def test_strassen_is_exact(sides):
    rng = np.random.default_rng(sum(sides))
    left = rng.integers(-(2**27), 2**27, (sides[0], sides[1]))
    right = rng.integers(-(2**27), 2**27, (sides[1], sides[2]))
    assert (strassen(left, right, leaf=4) == left.astype(object) @ right.astype(object)).all()
    # Sums between may wrap around; the result does not.
    big = np.full((6, 6), 2**29), np.full((6, 6), 2**30)
    assert (strassen(*big, leaf=1) == 6 * 2**59).all()


def test_best_prefers_the_first_of_equal_scores():
    scores = np.array([3, 9, 9, 1, 9, 3])
    assert best(scores, 2).tolist() == [1, 2]
    assert best(scores, 5).tolist() == [1, 2, 4, 0, 5]
    assert best(scores, 9).tolist() == [1, 2, 4, 0, 5, 3]
    assert best(scores[:0], 3).tolist() == []


def plain_negatives(rows, is_anchor, most=5):
    x = {i: np.array([math.floor(256 * float(c)) for c in v]) for i, v, _ in rows}
    label = {i: l for i, _, l in rows}
    out = []
    for a in (i for i in x if is_anchor(i)):
        scored = sorted((-int(x[a] @ x[i]), i) for i in x if i != a and len(x[i]) == len(x[a]))
        for negated, p in [s for s in scored if label[s[1]] == label[a]][:most]:
            window = [s for s in scored if label[s[1]] != label[a] and 80 * -negated <= 100 * -s[0] <= 100 * -negated]
            out += [(a, p, rank, i, -negated, -score) for rank, (score, i) in enumerate(window[:most], 1)]
    return sorted(out)


def test_hard_negatives_equal_sql_and_a_plain_version(spark):
    assert difference(spark, duck(MORE), MORE, queries.op12_hard_negatives, queries.ORACLE["op12_hard_negatives"]) == ""
    rows = spark.read.parquet(f"{MORE}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, MORE).collect())) == plain_negatives(rows, lambda i: i % 100 == 0)


def test_hard_negatives_with_ties_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(mining, "ANCHORS", 3)
    monkeypatch.setattr(mining, "CANDIDATES", 11)
    rng = np.random.default_rng(5)
    # Few values, so most scores tie; one label holds two thirds of the rows.
    rows = [(i, (rng.integers(-1, 3, 5) / 16).tolist(), int(rng.integers(0, 6)) // 4) for i in range(160)]
    found = hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.5, 0.0], 2),
        (4, [0.9, 9.0, 1.0], 2), (5, None, 2), (6, [], 2), (7, [0.9, None], 2), (8, [0.9, float("nan")], 2),
        (9, [float("inf"), 0.0], 2), (11, [0.95, 0.0], None), (None, [0.95, 0.0], 2), (12, [1e300, 0.0], 2), (13, [0.0, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, VECTORS)
    clashing = table.select("*", *[F.lit("x").alias(c) for c in ("row", "id", "x", "a", "c", "score", "rank", "width")])
    found = sorted(map(tuple, hard_negatives(clashing, F.col("vec_id") == 0).collect()))
    # Each of the two equal anchors has the other and row 1 as positives, and one negative in the window.
    assert found == sorted([(0, 0, 1, 2, 65536, 58880), (0, 1, 1, 2, 65536, 58880)] * 2)
    assert hard_negatives(table.where("false"), F.col("vec_id") == 0).count() == 0
    assert hard_negatives(table, F.col("vec_id") == 77).count() == 0


# Archives


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


PAGES = "page_id long, url string, html string"


def test_warc_equals_sql(spark):
    assert difference(spark, duck(MORE), MORE, queries.op13_warc, queries.ORACLE["op13_warc"]) == ""


MAGIC_RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BODIES = {
    1: "plain",
    2: "",
    3: None,
    4: "two\r\n\r\n" + MAGIC_RECORD + "records " + MAGIC_RECORD * 3,
    5: MAGIC_RECORD,
    6: "ends with breaks\r\n\r\n\r\n",
    7: "\nWARC/1.",
    8: "WARC/1.1\r\n\nWARC/1.1\r\n\r\n",
    9: "plain",
    10: "ünï \U0001f600 " * 5,
    11: "x" * 300_000 + "\nWARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + "y" * 300_000,
    12: "content-length: 3\r\n\r\nabc",
}


@pytest.mark.parametrize("split", [1 << 26, 4096])
def test_archives_hold_what_was_written(spark, tmp_path, split):
    rows = [(i, f"http://h/{i}?a=b\r\nWARC-Type: fake", body) for i, body in BODIES.items()] + [(13, None, "last")]
    folder = str(tmp_path / "archive")
    write_warc(spark.createDataFrame(rows, PAGES).coalesce(2), folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = read_warc(spark, folder, payloads=True).collect()
        figures = read_warc(spark, folder).drop("payload").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["record_id"] for r in found) == sorted(f"<urn:x-page:{i}>" for i, _, _ in rows)
    assert sorted((r["record_id"], r["payload_digest"], r["payload_bytes"]) for r in found) == sorted(
        (r["record_id"], r["payload_digest"], r["payload_bytes"]) for r in figures
    )
    by_id = {int(r["record_id"][12:-1]): r for r in found}
    for i, url, body in rows:
        raw, record = (body or "").encode(), by_id[i]
        revisit = {3: 2, 9: 1}.get(i)
        assert record["complete"] and record["declared"] == f"sha1:{digest(raw)}" and record["said"] == len(raw)
        if revisit:
            assert record["record_type"] == "revisit" and record["refers_to"] == f"<urn:x-page:{revisit}>"
            assert bytes(record["payload"]) == b""
        else:
            assert record["record_type"] == "response" and record["refers_to"] is None
            assert bytes(record["payload"]) == raw
            assert record["payload_digest"] == digest(raw) and record["payload_bytes"] == len(raw)
        assert record["uri"] == (url and url.replace("\r", "%0D").replace("\n", "%0A"))


def test_small_payloads_are_written_again(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    folder = str(tmp_path / "a")
    write_warc(spark.createDataFrame(rows, PAGES), folder, min_bytes=4)
    found = {record: kind for record, kind in read_warc(spark, folder).select("record_id", "record_type").collect()}
    assert found == {f"<urn:x-page:{i}>": kind for i, kind in zip((1, 2, 3, 4), ("response",) * 3 + ("revisit",))}


def test_many_copies_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_KEYS", 0)
    rows = [(i, "u", "copy" if i % 3 else f"own {i}") for i in range(60)]
    folder = str(tmp_path / "a")
    write_warc(spark.createDataFrame(rows, PAGES), folder)
    kinds = read_warc(spark, folder).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r["record_type"], r["refers_to"], r["count"]) for r in kinds) == [
        ("response", None, 21), ("revisit", "<urn:x-page:1>", 39)
    ]


def test_odd_pages(spark, tmp_path):
    rows = [(None, "u", "a"), (5, "u", "a"), (5, "u", "a"), (None, None, "only nulls"), (None, None, "only nulls"), (7, "", "b")]
    table = spark.createDataFrame(rows, PAGES).select("*", *[F.lit("x").alias(c) for c in ("id", "body", "sha", "size", "first", "value", "other")])
    folder = str(tmp_path / "a")
    write_warc(table, folder)
    found = read_warc(spark, folder).select(record_key(F.col("record_id")).alias("k"), "record_type", record_key(F.col("refers_to")).alias("r"))
    assert sorted((r["k"] or "", r["record_type"], r["r"] or "") for r in found.collect()) == [
        ("", "response", ""), ("", "response", ""), ("", "revisit", "5"), ("5", "response", ""), ("5", "response", ""), ("7", "response", "")
    ]
    empty = str(tmp_path / "empty")
    write_warc(table.where("false"), empty)
    assert read_warc(spark, empty).count() == 0


def test_other_archives(spark, tmp_path):
    """Binary blocks, records of other makers, lost ends and broken places."""

    def record(name, block, length=None, version="1.0"):
        size = len(block) if length is None else length
        head = f"WARC/{version}\r\nWARC-Type: resource\r\nwarc-record-id:  {name} \r\nContent-Type: image/png\r\nContent-Length: {size}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    binary = bytes(range(256)) * 3 + b"\nWARC/1.0\r\n\xff\xfe\r\n\r\n"
    files = {
        "whole.warc": record("a", binary) + record("b", b"", version="1.1") + record("c", b"\r\n" * 40),
        "short.warc": record("d", b"all there") + record("e", b"cut off", 500),
        "broken.warc": record("f", b"fine") + b"junk" + record("g", b"never reached"),
        "none.warc": b"no archive\n",
        "blank.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r["record_id"]: r for r in read_warc(spark, str(tmp_path), payloads=True).collect()}
    assert sorted(found) == ["a", "b", "c", "d", "e", "f"]
    assert bytes(found["a"]["payload"]) == binary and found["a"]["payload_digest"] == digest(binary)
    assert bytes(found["c"]["payload"]) == b"\r\n" * 40 and found["b"]["payload_bytes"] == 0
    assert not found["e"]["complete"] and found["e"]["payload_bytes"] is None
    assert found["f"]["complete"] and bytes(found["f"]["payload"]) == b"fine"


def test_pointer_jumping_follows_long_chains(spark):
    rows = [("f", 10 * i, 10 * i + 10) for i in range(200)] + [("f", 5, 15), ("f", 15, 20), ("g", 3, 4), ("h", 0, 7)]
    chain = spark.createDataFrame(rows, "file string, start long, next long")
    found = sorted(map(tuple, warc.reachable(chain).collect()))
    assert found == sorted([("f", 10 * i) for i in range(200)] + [("h", 0)])


def test_pointer_jumping_keeps_size_estimates_small(spark):
    """Estimates that multiply from round to round took the driver's memory (they had 1.1 million digits here)."""
    chain = spark.createDataFrame([("f", 10 * i, 10 * i + 10) for i in range(300)], "file string, start long, next long")
    found = warc.reachable(chain)
    assert found.count() == 300
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**60
