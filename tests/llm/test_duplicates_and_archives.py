"""Components, near duplicates, embeddings, archives and the pipeline against plain versions."""

import gzip
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from vellum.llm import embeddings, fingerprints, neardup, warc
from vellum.llm.common import written
from vellum.llm.components import components

from .helpers import DOCS, ODD, docs
from .test_text_codes import check_packing

SF = "/root/testdata/sf0.001"


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(300, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows, share):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    links = [(a, b) for (a, x), (b, y) in itertools.combinations([(i, s) for i, own in sets.items() for s in own], 2) if x and y and 100 * len(x & y) >= share * len(x | y)]
    return roots_of(sets, links), {i: len(own[0]) for i, own in sets.items()}


def varied(n, seed):
    """Groups around an original: copies, edits below and above the threshold, chains, and a hub that is not the least id."""
    random = np.random.default_rng(seed)
    word = lambda: f"w{random.integers(4000)}"
    rows, i = [], 0
    for _ in range(n):
        own = [word() for _ in range(int(random.integers(30, 160)))]
        for _ in range(int(random.integers(1, 9))):
            words = list(own)
            for _ in range(int(random.integers(0, 4))):
                words[random.integers(len(words))] = word()
            rows.append((i, " ".join(words)))
            i += int(random.integers(1, 3))
            if random.random() < 0.3:
                own = words
    return rows


def test_near_duplicates(spark):
    rows = varied(30, 3) + [(9000, None), (9001, " "), (9002, "a b"), (9003, "A  b"), (9004, "a b c")]
    want, sizes = plain_components(rows, 85)
    got = neardup.minhash_near_dedup(docs(spark, rows, extra=True)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(rows) - 20
    assert {r.doc_id: r.n_shingles for r in got} == sizes and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_around_a_hub(spark, monkeypatch):
    """Members that are alike only through a hub whose id is not the least, in buckets of several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    random = np.random.default_rng(5)
    own = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):
        words = list(own)
        for at in random.choice(190, 3, False):
            words[at] = f"v{i}.{at}"
        rows.append((i, " ".join(words)))
    rows.append((50, " ".join(own)))
    want, _ = plain_components(rows, 85)
    got = {r.doc_id: r.component_id for r in neardup.minhash_near_dedup(docs(spark, rows)).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.minhash_near_dedup(docs(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[1].n_shingles == 0 and by[5].component_id == 4 and by[4].component_id == 4
    assert not by[None].kept and by[None].component_id is None
    assert neardup.minhash_near_dedup(docs(spark, [])).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id are one document, linked by each of its texts, blank ones among them."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, three), (5, three), (4, " "), (6, None), (2, two), (7, "z " * 9)]
    want, _ = plain_components(rows, 85)
    got = neardup.minhash_near_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert want[3] == want[2] == 1 and want[5] == 4
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_rows_without_an_id_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = neardup.minhash_near_dedup(docs(spark, [(None, text), (None, text + " x"), (8, text), (9, text + " y"), (None, "alone of all the words")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("None", "8", False)] * 2 + [("8", "8", True), ("9", "8", False), ("None", "None", False)])


def test_fingerprint_near_duplicates(spark):
    rows = varied(20, 8)
    want, _ = plain_components(rows, 80)
    assert {r.doc_id: r.component_id for r in fingerprints.near_duplicates(docs(spark, rows)).collect()} == want


def test_circulant_signatures():
    random = np.random.default_rng(2)
    sets = [np.sort(random.choice(1 << 60, n, False).astype(np.uint64)) for n in (0, 1, 50, 4000)]
    got = neardup.circulant_signatures(sets, 16)
    assert (got[0] == 0xFFFFFFFF).all()
    for i, s in enumerate(sets[1:], 1):
        place = neardup._permute((s ^ (s >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
        for k in range(16):
            rank = neardup._permute(place + np.uint32(k), 0x9E3779B1, 0x7FEB352D, 0x165667B1)
            assert got[i, k] == rank.min()
    a, b = np.arange(1, 2001).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(301, 2301).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = neardup.circulant_signatures([a, b], 400)
    assert abs((s[0] == s[1]).mean() - 1700 / 2300) < 0.08


def plain_links(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(good, 2) if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]
    count = dict.fromkeys([i for i, _ in rows], 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, roots_of([i for i, _ in rows], links)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_BLOCK", 8)
    random = np.random.default_rng(4)
    rows, i = [], 0
    for size in [1] * 30 + [2, 3, 5, 40]:
        centre = random.normal(size=16)
        for _ in range(size):
            rows.append((i, (centre + 0.1 * random.normal(size=16)).tolist()))
            i += 1
    rows += [(i + k, rows[-1][1]) for k in range(3)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1e200] * 16), (907, [1e-200] * 16), (908, [1.0] * 8)]
    table = spark.createDataFrame([(a, b, 0, 1) for a, b in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = embeddings.embedding_near_dedup(table).collect()
    count, roots = plain_links([r for r in rows if r[0] not in (906, 907)])
    count |= {906: 1, 907: 1}
    roots |= {906: 906, 907: 906}
    assert {r.vec_id: r.n_links for r in got} == count and {r.vec_id: r.component_id for r in got} == roots
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.embedding_near_dedup(table.where("vec_id < 0")).count() == 0


def test_embeddings_in_a_hot_cluster(spark, monkeypatch):
    """Linked pairs among many vectors that are near each other but not linked."""
    random = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(random.normal(size=64))
    def beside(x, cosine, n):
        y = random.normal(size=(n, 64))
        return cosine * x + (1 - cosine**2) ** 0.5 * unit(y - (y * x).sum(axis=-1, keepdims=True) * x)

    own = beside(centre, 0.88**0.5, 2000)
    vectors = np.concatenate([own, beside(own[:150], 0.957, 150)])
    near = np.triu(vectors @ vectors.T >= 0.95, 1)
    assert near.sum() >= 150
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = embeddings.embedding_near_dedup(table, window=4).collect()
    assert {r.vec_id: r.component_id for r in got} == roots_of(range(len(vectors)), np.argwhere(near).tolist())
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((near.sum(axis=0) + near.sum(axis=1)).tolist()))


@pytest.mark.parametrize("size", [4, 60])
def test_embeddings_in_more_partitions_than_rows(spark, size, monkeypatch):
    """Links don't depend on where the ranges of the sorted passes end."""
    random = np.random.default_rng(7)
    centres = random.normal(size=(size // 2, 16))
    vectors = np.concatenate([centres, centres + 0.02 * random.normal(size=centres.shape)])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 96)
    monkeypatch.setattr(embeddings, "RANGE_ROWS", 1)
    try:
        got = {r.vec_id: r.component_id for r in embeddings.embedding_near_dedup(table, window=min(8, size - 1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: i % (size // 2) for i in range(size)}


def test_embeddings_of_repeated_and_large_ids(spark):
    big = (1 << 53) + 1
    one, two = [1.0, 0.0, 0.1], [0.0, 1.0, 0.3]
    rows = [(big, one), (big, two), (big + 2, one), (3, two), (None, one), (None, [0.0, 0.0, 1.0]), (4, None), (5, [1.0, 0.0]), (3, None)]
    got = embeddings.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    shown = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)
    assert shown == sorted([(str(big), 2, "3", False), (str(big), 1, "3", False), (str(big + 2), 2, "3", False), ("3", 1, "3", True), ("3", 0, "3", True), ("None", 2, "3", False),
                            ("None", 0, "None", False), ("4", 0, "4", True), ("5", 0, "5", True)])


def test_embedding_recall(spark):
    """Against all pairs of 12,000 vectors, many of them planted at the threshold; the passes follow the table."""
    random = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    first = unit(random.normal(size=(10_000, 64)))
    aside = random.normal(size=(2000, 64))
    aside = unit(aside - (aside * first[:2000]).sum(axis=1, keepdims=True) * first[:2000])
    vectors = np.concatenate([first, 0.952 * first[:2000] + (1 - 0.952**2) ** 0.5 * aside])
    near = [(i, int(j)) for at in range(0, len(vectors), 1000) for i, j in np.argwhere(np.triu(vectors[at : at + 1000] @ vectors.T >= 0.95, at + 1)) + [at, 0]]
    assert len(near) >= 2000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.embedding_near_dedup(table).collect()}
    assert np.mean([got[a].component_id == got[b].component_id for a, b in near]) >= 0.999
    count = np.bincount(np.array(near).ravel(), minlength=len(vectors))
    assert all(r.n_links <= count[i] for i, r in got.items()) and sum(r.n_links for r in got.values()) >= 0.999 * 2 * len(near)
    assert embeddings.plan(10_000) == (12, 24) and embeddings.plan(10**9) == (25, 109)


PAGES = "page_id long, url string, html string, payload string, key string"


def test_archives(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "u", "x" * 1500), (5, "u", "x" * 1500), (3, "v\r\nX: y", "x" * 1500), (2, None, None), (4, "w", ""), (6, "w", "short"), (7, "w", "short"), (8, "l", long), (9, "l", long), (10, "l", long + "z"), (10, "l", long + "z"), (None, "n", "x" * 1500),
            ((1 << 53) + 1, "b", "y" * 1200), ((1 << 53) + 3, "b", "y" * 1200), (None, "b", "y" * 1200)]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], PAGES)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(warc.with_revisits(pages), path, segment_bytes=1000, records_per_file=20)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and not [r.problem for r in got if r.problem]
    best = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            best[t] = max(i, best.get(t, i))
    key = lambda r: tuple(map(str, r))
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        carrier = best.get(t)
        revisit = carrier is not None and i != carrier
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", carrier if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {t or "" for _, _, t in rows}
    assert max(r.segments for r in got) > 100
    assert warc.archive_round_trip(pages.where("page_id < 0"), f"file://{tmp_path}/none").count() == 0


def test_revisits_name_the_record(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 1500, "a", "b"), (2, "u", "x" * 1500, "a", "b"), (3, "u", "y" * 1500, "a", "b"), (3, "u", "y" * 1500, "a", "b"), (1, "u", "y" * 1500, "a", "b")], PAGES)
    warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/archives")
    heads = [f for file in (tmp_path / "archives").glob("part-*") for f, _, _ in warc.parse_records(file.read_bytes())]
    own = {f["warc-record-id"]: f for f in heads}
    revisits = [f for f in heads if f["warc-type"] == "revisit"]
    assert len(own) == 5 and len(revisits) == 2
    for f in revisits:
        if f["vellum-refers-to-page-id"] == "2":
            assert own[f["warc-refers-to"]]["vellum-page-id"] == "2" and own[f["warc-refers-to"]]["warc-type"] == "response"
        else:  # two rows tie for the response
            assert "warc-refers-to" not in f


def test_damaged_archives(spark, tmp_path):
    sha = hashlib.sha1(b"abc" * 500).hexdigest()
    records = warc.records_of(1, "u", b"abc" * 500, sha, "response", None, 400)
    assert len(records) > 3
    joined = lambda x: b"".join(r + b"\r\n\r\n" for r in x)
    other = warc.records_of(2, "u", b"abc" * 500, sha, "response", None, 400)
    (tmp_path / "one.warc").write_bytes(joined(records[::-1]))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(joined(other[:2])) + gzip.compress(joined(other[3:])))
    bad = warc.records_of(3, "u", b"abd" * 500, sha, "response", None, 9999)
    (tmp_path / "three.txt").write_bytes(joined(bad))
    cut = [r.replace(b"Total-Length: ", b"Total-Length: 1") for r in warc.records_of(4, "u", b"abc" * 500, sha, "response", None, 400)]
    (tmp_path / "four.txt").write_bytes(joined(cut))
    # Records that can't be read are rows, and those around them are read.
    good = [warc.records_of(i, "u", b"abc" * 500, sha, "response", None, 9999)[0] for i in (5, 6, 7)]
    (tmp_path / "five").write_bytes(joined([good[0], b"no head at all", good[1], good[2][:300]]))
    packed = gzip.compress(joined([warc.records_of(8, "u", b"abc" * 500, sha, "response", None, 9999)[0]]))
    (tmp_path / "six.gz").write_bytes(packed + packed[: len(packed) // 2])
    got = [(r.page_id, r.problem) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()]
    assert {i: p for i, p in got if i is not None} == {1: None, 2: "missing segment", 3: "digest", 4: "total length", 5: None, 6: None, 8: None}
    assert sorted(p for i, p in got if i is None) == ["damaged archive", *["damaged record"] * 3]


@pytest.mark.parametrize("body, want", [(b"3\r\nabc\r\n0\r\n\r\n", b"abc"), (b"A;x=y\r\n0123456789\r\n2\r\n\r\n\r\n0\r\nT: 1\r\n\r\n", b"0123456789\r\n"), (b"0\r\n\r\n", b"")])
def test_chunks(body, want):
    assert warc.dechunked(body) == want
    assert warc.dechunked(warc.chunked(want, 4)) == want
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_records_parse():
    assert list(warc.parse_records(b"")) == []
    assert list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")) == [({}, b"", "damaged record")]
    folded = b"WARC/1.1\r\nWARC-Type: info\r\n and more\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert list(warc.parse_records(folded)) == [({"warc-type": "info and more", "content-length": "2"}, b"ab", None)]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "secret_scans", "best_fit_packing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs_, kept = start, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = written(stage(spark, docs_, SF), "stage")
        assert docs_.columns == start.columns
        kept.append({r.doc_id: r.text for r in docs_.collect()})
    source = {r.doc_id: r.text for r in start.collect()}
    assert kept[0] == {i: t for i, t in source.items() if any(c.isalpha() for c in t)}
    assert set(kept[1]) <= set(kept[0]) and len(kept[1]) > 0.7 * len(kept[0])
    roots, _ = plain_components(list(kept[1].items()), 85)
    assert set(kept[2]) == set(roots.values()) and set(kept[3]) == set(kept[2])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept[3])
    check_packing(rows, kept[3], plain)


def test_stages_on_odd_rows(spark):
    table = docs(spark, [(i, t, None, "s") for i, t in ODD], extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
        out.count()
        assert stage(spark, docs(spark, []), SF).count() == 0
    twice = corpus_pipeline.drop_near_duplicates(spark, table, SF)
    assert sorted(str(r.doc_id) for r in twice.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, 9, 10, None]))


def test_near_duplicate_stage_on_repeated_ids(spark):
    """A row goes only if another of its text's group stays, whatever else its id carries."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, one + " more"), (3, two), (3, three), (4, " "), (4, None), (5, three), (None, one), (None, "no other has this text at all"), (None, "no other has this text at all")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), SF).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted([(1, one), (1, two), (3, three), (4, " "), (4, ""), (None, "no other has this text at all")], key=str)


@pytest.mark.parametrize("label", [None, 0, 1])
def test_junk_stage_without_both_classes(spark, tmp_path, label):
    spark.createDataFrame([(i, label, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = docs(spark, [(i, f"some words of text {i}") for i in range(8)])
    assert corpus_pipeline.drop_junk(spark, rows, f"file://{tmp_path}").count() == 8
