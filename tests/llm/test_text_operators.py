"""Line dedup, sharding, packing and SimHash against plain versions, and their edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tallymark.llm import queries
from tallymark.llm.components import connect
from tallymark.llm.line_dedup import drop_shared_lines
from tallymark.llm.packing import WordIds, first_fit_decreasing, pack
from tallymark.llm.sharding import longest_first, shard_documents
from tallymark.llm.simhash_dedup import VantageTree, fingerprint, keep_one_per_class, near_labels, simhash_classes
from workload.check import difference, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "A shared line of text\nown line number three\n\nshort", None, None, None),
    (4, "  a SHARED line of text\t\nown line number four", "en", "b", 1),
    (4, "  a SHARED line of text\t\nown line number four", "en", "b", 1),
    (None, "a shared line of text\nand one of nobody", "en", "b", 1),
    (5, "word " * 60_000, "en", "b", 1),
    (6, "Привет, Straße!\n" * 3, "en", "b", 1),
    (7, "\n\n\n", "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """The odd rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("row", "id", "key", "keys", "size", "shard", "print", "rep", "group", "ids", "a", "b", "gone", "n", "check")
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key_of(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)


def plain_line_dedup(rows):
    first, ids = {}, defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            ids[key_of(line)].add(doc_id)
    for key, holders in ids.items():
        known = [i for i in holders if i is not None]
        if len(key) >= 10 and len(holders) >= 2 and known:
            first[key] = min(known)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in first or doc_id == first[key_of(x)]]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_matches_sql(spark):
    assert difference(spark, duck(SF), SF, queries.QUERIES["op1_line_dedup"], queries.ORACLE["op1_line_dedup"]) == ""


@pytest.mark.parametrize("which", ["odd", "clashing"])
def test_line_dedup_odd_rows(request, which):
    docs = request.getfixturevalue(which)
    found = drop_shared_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == plain_line_dedup([(r[0], r[1]) for r in ODD])


def test_line_dedup_threshold(spark):
    docs = spark.createDataFrame([(i, "held by three docs\nheld by two docs" if i < 2 else "held by three docs") for i in range(3)], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r["n_dropped"] for r in drop_shared_lines(docs, max_docs=2).collect()}
    assert found == {0: 0, 1: 1, 2: 1}


def test_line_dedup_empty(empty):
    assert drop_shared_lines(empty).collect() == []


def check_shards(rows, texts, shards):
    by_text, by_shard, load = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        by_text[r["text_crc32"]].add(r["shard"])
        by_shard[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sum(load) == sum(len((t or "").encode()) + 8 for t in texts)
    return load


def test_sharding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.QUERIES["op2_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    load = check_shards(rows, texts.values(), 24)
    assert max(load) - min(load) <= 0.01 * max(load)


@pytest.mark.parametrize("which", ["odd", "clashing"])
def test_sharding_odd_rows(request, which):
    rows = shard_documents(request.getfixturevalue(which), 3).collect()
    check_shards(rows, [r[1] for r in ODD], 3)
    assert len({r["shard"] for r in rows if r["row"]["doc_id"] in (1, 2)}) == 1


def test_sharding_empty(empty):
    assert shard_documents(empty, 3).collect() == []


def test_longest_first():
    assert longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def check_packing(rows, ids, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for (doc_id, total), pieces in by_doc.items():
        pieces.sort(key=lambda r: (r["start"], r["sequence_id"]))
        text = b"".join(bytes(r["ids"]) for r in pieces)
        assert text == ids[doc_id]
        assert [r["length"] for r in pieces] == [len(r["ids"]) // 4 for r in pieces]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return sum(r["length"] for r in rows) / (length * len(by_sequence))


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = dict(zip([r["doc_id"] for r in docs], plain_ids([r["text"] for r in docs])))
    rows = pack(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    assert check_packing(rows, ids, 4096) > 0.95
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.QUERIES["op7_packing"](spark, SF).collect()}
    assert digests == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in rows}


@pytest.mark.parametrize("which", ["odd", "clashing"])
def test_packing_odd_rows(request, which):
    rows = pack(request.getfixturevalue(which), queries.tokenizer_path(), length=64).collect()
    ids = dict(zip([r[0] for r in ODD], plain_ids([r[1] or "" for r in ODD])))
    twice = ids.pop(4)
    assert b"".join(bytes(r["ids"]) for r in rows if r["doc_id"] == 4) == twice * 2
    for doc_id, expected in ids.items():
        pieces = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 64


def test_packing_empty(empty):
    assert pack(empty, queries.tokenizer_path()).collect() == []


def test_word_ids_match_the_tokenizer():
    texts = [
        "Hello, WORLD! it's 42x don't “quoted” naïve Étude",
        "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b",
        "क़क KİLO K tab nbsp em\x1cfs!\x1c! \x85 x́y",
        "word### $$$a THAT!! | pipe, 'tis '' don''t. ... a.b,c e-mail@x.org",
        "한국어 日本語 ﬁ ǅ ß",
    ]
    words = WordIds(queries.tokenizer_path())
    expected = [ids[:-4] for ids in plain_ids(texts)]
    assert words.encode(texts) == expected
    assert words.encode(texts) == expected  # from the kept words


def plain_first_fit(sizes, length):
    """Largest first, each into the first bin that has room, by looking at all bins."""
    used, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, full in enumerate(used) if full + sizes[i] <= length), len(used))
        if at == len(used):
            used.append(0)
        out[i] = (at, used[at])
        used[at] += sizes[i]
    return [out[i] for i in range(len(sizes))]


def test_first_fit_equals_a_plain_version_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(docs, queries.tokenizer_path(), length=512, group_bytes=200_000).toPandas()
    rows["group"] = rows["sequence_id"] // 2**32
    assert rows["group"].nunique() > 1
    for _, group in rows.groupby("group"):
        group = group.assign(key=group["doc_id"].astype(str)).sort_values(["key", "start"], kind="stable")
        full, rest = group[group["length"] == 512], group[group["length"] < 512]
        assert full["sequence_id"].is_unique and (full["offset"] == 0).all()
        assert not set(full["sequence_id"]) & set(rest["sequence_id"])
        expected = plain_first_fit(rest["length"].tolist(), 512)
        base = rest["sequence_id"].min() if len(rest) else 0
        assert list(zip(rest["sequence_id"] - base, rest["offset"])) == expected


def test_checksums_are_those_of_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = pack(docs, queries.tokenizer_path()).withColumn("again", F.crc32("ids"))
    assert whole.where("again != ids_crc32").count() == 0
    slim = pack(docs, queries.tokenizer_path(), checksum=True)
    assert sorted(map(tuple, whole.drop("ids", "again").collect())) == sorted(map(tuple, slim.collect()))


def test_a_document_longer_than_many_groups(spark, monkeypatch):
    from tallymark.llm import packing

    monkeypatch.setattr(packing, "AT_ONCE", 1000)
    text = " ".join(f"word{i % 977} and more" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text[:50])], "doc_id long, text string")
    rows = pack(docs, queries.tokenizer_path(), length=256, group_bytes=50_000).toPandas()
    long = rows[rows["doc_id"] == 1].sort_values("start")
    assert (long["sequence_id"] // 2**32).nunique() > 10
    ids = b"".join(long["ids"])
    assert ids == plain_ids([text])[0] and (long["start"] == (long["length"].cumsum() - long["length"])).all()


def test_words_are_kept_by_bytes(monkeypatch):
    from tallymark.llm import packing

    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)]
    expected = WordIds(queries.tokenizer_path()).encode(texts)
    monkeypatch.setattr(packing, "KEPT_BYTES", 3000)
    words = WordIds(queries.tokenizer_path())
    for _ in range(2):
        assert [words.encode([t])[0] for t in texts] == expected
        assert words.held <= 3000 + 500 and len(words.recent) + len(words.earlier) < 60


def test_first_fit_decreasing():
    bins, offsets = first_fit_decreasing(np.array([3, 6, 4, 7, 5]), 10)
    assert bins.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [7, 0, 6, 0, 0]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rows = queries.QUERIES["op8_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(list(prints), list(prints.values()))


@pytest.mark.parametrize("which", ["odd", "clashing"])
def test_simhash_odd_rows(request, which):
    docs = request.getfixturevalue(which)
    rows = simhash_classes(docs).collect()
    known = sorted({(r[0], r[1]) for r in ODD if r[0] is not None})
    expected = plain_components([i for i, _ in known], [plain_fingerprint(t) for _, t in known])
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == sorted(
        (r[0], expected[r[0]]) for r in ODD if r[0] is not None
    )
    assert [(r["component_id"]) for r in rows if r["doc_id"] is None] == [None]
    kept = keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(
        [i for i, c in expected.items() if i == c] + [None], key=repr
    )


def test_simhash_empty(empty):
    assert simhash_classes(empty).collect() == []
    assert keep_one_per_class(empty).collect() == []


def test_long_text_fingerprint():
    text = " ".join(str(i * i) for i in range(70_000))
    assert fingerprint(text) == plain_fingerprint(text)


def test_vantage_tree_misses_no_near_pair():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**64, 3000, np.uint64)
    near = points[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    near ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    points = np.concatenate([points, near, near[:200] ^ np.uint64(5)])
    tree = VantageTree(points[::3], 64, 3)
    together = {(i, j) for _, at in tree.route(points) for i in at.tolist() for j in at.tolist() if i < j}
    close = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert tree.shards > 8 and all((i, j) in together for i, j in close.tolist() if i < j)
    labels = near_labels(points, 3)
    expected = plain_components(list(range(len(points))), [int(p) for p in points])
    assert labels.tolist() == [expected[i] for i in range(len(points))]


def test_connect_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)] + [(3, 3)]
    found = connect(spark.createDataFrame(chain + star, "a long, b long")).collect()
    assert dict(map(tuple, found)) == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)}


def test_registered():
    assert set(queries.QUERIES) <= set(entry_module.queries())


def test_digest_of_kept_text(spark):
    rows = queries.QUERIES["op1_line_dedup"](spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in rows) == sorted(
        (i, hashlib.sha256(kept.encode()).hexdigest()) for i, _, _, kept in plain_line_dedup(docs)
    )


def test_a_word_is_encoded_once_whatever_follows_it():
    words = WordIds(queries.tokenizer_path())
    texts = ["House, garden.", "house. (garden) GARDEN!", " house?\n\tgarden\x0bhouse,garden ", "", " \r\n"]
    expected = [WordIds(queries.tokenizer_path()).encode([text])[0] for text in texts]
    sent = []
    encode = words._encode_together
    words._encode_together = lambda new: sent.extend(new) or encode(new)
    assert [words.encode([text])[0] for text in texts] == expected
    assert sent == [b"house", b"garden"]
    plain = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert expected == [np.array(e.ids, "<u4").tobytes() for e in plain]
