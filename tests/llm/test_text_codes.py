"""BPE, packing, fingerprints and secrets against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import bpe, fingerprints, packing, queries, secrets

from .helpers import ODD, docs

SF = "/root/testdata/sf0.001"
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain_bpe():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(bpe.tokenizer_json(bpe.read_ranks(RANKS)))


@pytest.fixture(scope="module")
def plain_words():
    return Tokenizer.from_file(WORDS)


def test_pattern_is_the_vocabularys():
    assert bpe.PATTERN == P.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85 　'stlvm.,-12٣aZé中ß́\U0001f600"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_equals_the_rank_library(text):
    model = bpe.coder(bpe.tokenizer_json(bpe.read_ranks(RANKS))) if not hasattr(test_bpe_equals_the_rank_library, "c") else test_bpe_equals_the_rank_library.c
    test_bpe_equals_the_rank_library.c = model
    plain = getattr(test_bpe_equals_the_rank_library, "p", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    test_bpe_equals_the_rank_library.p = plain
    ids = np.frombuffer(model.encode([text])[0], "<u4")
    assert ids.tolist() == plain.encode_ordinary(text)
    assert model.decode(ids) == text.encode()


def test_bpe_offsets_split_characters(coder):
    text = "a😀 中é"
    ids = np.frombuffer(coder.encode([text])[0], "<u4")
    at = coder.offsets(ids)
    data = coder.decode(ids)
    assert data == text.encode() and at[-1] == len(data)
    for i, start in enumerate(bpe.character_offsets(data, at[:-1])):
        assert len(data[: at[i]].decode("utf-8", "ignore")) == start


def test_bpe_query_on_odd_rows(spark, plain_bpe):
    got = bpe.encoded(docs(spark, ODD, extra=True), RANKS, with_offsets=True).collect()
    want = sorted((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                  for i, t in ODD for ids in [plain_bpe.encode_ordinary(t or "")])
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want
    back = bpe.decoded(bpe.encoded(docs(spark, ODD), RANKS), RANKS).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in ODD)
    assert bpe.encoded(docs(spark, []), RANKS).count() == 0


def test_bpe_query_on_a_table(spark, plain_bpe):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_byte_bpe(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = plain_bpe.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85 'stlvm.,-12٣aZéΣß́İ\U0001f600"), st.characters(codec="utf-8")), max_size=60))
def test_words_equal_the_whole_text(text):
    coder = packing.words(WORDS)
    assert coder.by_word
    plain = Tokenizer.from_file(WORDS) if not hasattr(test_words_equal_the_whole_text, "p") else test_words_equal_the_whole_text.p
    test_words_equal_the_whole_text.p = plain
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, plain, capacity=2048):
    pieces, by_sequence = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cells in by_sequence.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            cut = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(cut), zlib.crc32(cut.tobytes()))
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_a_table(spark, plain_words):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    n, tokens = check_packing(rows, texts, plain_words)
    assert n <= 1.02 * tokens / 2048 + 2


def test_open_bins_are_bounded(spark):
    """In the query's own run all bins are open at times, the fullest closes, and that costs little space."""
    rows = queries.op3_best_fit_packing(spark, "/root/testdata/sf0.1").select("sequence_id", "length", "closed").collect()
    assert max(r.closed for r in rows) > 100
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY


def test_pieces_of_one_id_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 50)
    rows = packing.packed(spark.createDataFrame([(None if i % 2 else 7, 0, 0, 100 + i % 9, 1) for i in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long")).collect()
    by_task = {}
    for r in rows:
        by_task[r.sequence_id >> 40] = by_task.get(r.sequence_id >> 40, 0) + 1
    assert len(rows) == 200 and len(by_task) == 4 and max(by_task.values()) <= 60


def test_known_chunks_are_bounded():
    from vellum.llm.common import Known

    known = Known(most_bytes=10_000, most_chars=8)
    for i in range(1000):
        known.learn({f"c{i}": b"1234", "a long chunk that never comes back": b"12"})
    assert 20 < len(known) < 60 and all(len(c) <= 8 for c in known)


def test_packing_odd_rows(spark, plain_words):
    texts = {i: t for i, t in ODD if i != 4}
    rows = packing.pack_documents(docs(spark, ODD, extra=True), WORDS).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2
    check_packing([r for r in rows], texts, plain_words)
    assert packing.pack_documents(docs(spark, []), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_open_bins_are_best_fit(lengths, most):
    bins, plain, made = packing.OpenBins(20, most), [], 0
    for x in lengths:
        number, offset = bins.put(x)
        fits = [b for b in plain if b[1] >= x]
        if fits:
            best = min(b[1] for b in fits)
            assert offset == 20 - best
            own = next(b for b in plain if b[0] == number)
            assert own[1] == best
            plain.remove(own)
        else:
            assert (number, offset) == (made, 0)
            best, made = 20, made + 1
        if best > x:
            if len(plain) == most:
                least = min(b[1] for b in plain)
                plain.remove([b for b in plain if b[1] == least][-1])
            plain.append((number, best - x))


def plain_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_signatures(texts):
    """The least of each permutation over the hashes of a text's shingles, one number at a time."""
    from vellum.llm.common import shingle_hashes

    factors, offsets = (x.tolist() for x in fingerprints._multipliers(96))
    out = []
    for text in texts:
        members = shingle_hashes(text).tolist()
        assert len(members) == len(plain_shingles(text))
        out.append([min(((a * m + b) % (1 << 64)) >> 32 for m in members) if members else 0xFFFFFFFF for a, b in zip(factors, offsets)])
    return np.array(out)


def test_next_of_hot_ids(spark):
    """Ids that many rows share, null among them, are dealt to several buckets, and every row still has its next."""
    rows = [(None if i % 3 else i % 2, f"text {i} " * 3) for i in range(300)]
    table = docs(spark, rows)
    assert table.sparkSession is spark
    sizes = [r["count"] for r in fingerprints.with_next(table).where("NOT last").groupBy("bucket").count().collect()]
    got = fingerprints.compare_with_edits(table).collect()
    assert len(got) == 300 and len(sizes) >= 3 and max(sizes) < 200
    # Each text's first half is followed by the beginning of another's: the edits are those of one cycle over all rows.
    halves = {hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest(): (a, b) for _, a in rows for _, b in rows}
    follows = dict(halves[r.edited_sha256] for r in got)
    assert len(follows) == 300 == len(set(follows.values()))


def test_fingerprints(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op8_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, r in enumerate(rows):
        g, after = got[r.doc_id], rows[(i + 1) % len(rows)].text
        changed = fingerprints.edited(r.text, after)
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = plain_signatures([r.text, changed, after])
        assert g.fingerprint == fingerprints.fingerprint_text(a) and g.edited_fingerprint == fingerprints.fingerprint_text(b)
        x, y, z = (plain_shingles(t) for t in (r.text, changed, after))
        for near, bands, index, other, others in ((g.near_edited, g.bands_edited, g.jaccard_edited, b, y), (g.near_next, g.bands_next, g.jaccard_next, c, z)):
            assert near == np.mean([p & 0xFFFF == q & 0xFFFF for p, q in zip(a.tolist(), other.tolist())])
            assert bands == (sum(a[k : k + 4].tolist() == other[k : k + 4].tolist() for k in range(0, 96, 4)) if x and others else 0)
            assert index == (len(x & others) / len(x | others) if bands else None)
        assert by_text.setdefault(r.text, g.fingerprint) == g.fingerprint
    long = [g for g in got.values() if g.n_chars > 400]
    assert np.mean([g.near_edited for g in long]) > 0.2 > 0.05 > np.median([g.near_next for g in long])


def test_fingerprint_estimates_jaccard():
    one = [f"w{i}" for i in range(400)]
    other = one[:320] + [f"v{i}" for i in range(80)]
    from vellum.llm.common import shingle_hashes

    a, b = (set(shingle_hashes(" ".join(x)).tolist()) for x in (one, other))
    assert len(a) == 396
    s, t = fingerprints.signatures_of([" ".join(one), " ".join(other)], 512)
    assert abs(fingerprints.likeness(s, t) - len(a & b) / len(a | b)) < 0.08


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.compare_with_edits(docs(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    order = sorted(((-1 if i is None else i, t or "") for i, t in ODD))
    want = sorted(hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert fingerprints.compare_with_edits(docs(spark, [])).count() == 0
    assert fingerprints.compare_with_edits(docs(spark, [(1, "a b c")])).first().near_next == 1.0
    assert fingerprints.fingerprints(docs(spark, ODD)).count() == len(ODD)


def plain_base(text):
    """The contract's wording, straight."""
    found = []
    for m in re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A).finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "API_KEY", "apikey", "secret", " ", "  ", ":", "=", '"', "'", "abcdef0123456789", "AKIA", "ABCD1234EFGH", "x", "token", "ſecret", "é", "\n", "12345"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert [x[:3] for x in secrets.base_spans(text)] == plain_base(text)


def test_secret_scan(spark):
    live, shared, copied = "Zq8Rt2Lw9Xc4Vb7Nm1Kp", "Ab3De5Gh7Jk9Mn1Pq3St", "Qw3Er5Ty7Ui9Op1As3Df"
    rows = [(1, f"see bearer {live} and again {live}", "en", "a"), (2, f"bearer {shared}", "en", "a"), (3, f"bearer {shared}", "en", "b"), (3, f"bearer {shared}", "en", "b"),
            (4, 'é password = "hunter22" AKIA' + "A1" * 9 + " " + "0a" * 13, "en", "c"), (5, None), (6, ""), (7, "plain words"), *((20 + i, f"id {copied}", "en", "d") for i in range(4)), (30, "long " + "Ab1" * 70, "en", "e")]
    got = sorted(tuple(r) for r in secrets.secret_scan(docs(spark, rows, extra=True)).collect())
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1][5] == f"bearer:4:{11 + 20},random:42:62" and by[1][6] == 2
    assert by[2][5] == by[3][5] == "" and by[2][7] == 1
    assert by[4][1:4] == (1, 1, 1) and by[4][5].startswith("assign:2:22,access:") and ",hex:" in by[4][5]
    assert by[5][1:] == by[6][1:] == by[7][1:]
    assert all(by[20 + i][5] == "" and by[20 + i][7] == 1 for i in range(4))  # one owner, but four places
    assert by[30][5] == ""  # few bits: three letters over and over
    assert secrets.secret_scan(docs(spark, [(1, "x " + live * 9, "en", "a")])).first().spans == f"random:2:{2 + 20 * 9}"
    clean = {r.doc_id: r for r in secrets.redacted(docs(spark, rows)).collect()}
    assert clean[1].text == "see [secret] and again [secret]" and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == f"bearer {shared}" and "hunter" not in clean[4].text and clean[5].text is None
    assert secrets.secret_scan(docs(spark, [])).count() == 0 == secrets.redacted(docs(spark, [])).count()
    assert secrets.secret_scan(docs(spark, ODD, extra=True)).count() == len(ODD) == secrets.redacted(docs(spark, ODD)).count()


def plain_weak(text, base):
    """The weak kinds as the README words them, each match held against all earlier spans."""
    run = "[A-Za-z0-9+/_-]"
    found = []
    for kind, matches in (
        ("bearer", [(m.start(), m.end(), m[1]) for m in re.finditer(r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)", text)]),
        ("urlauth", [(m.start(1), m.end(), m[2]) for m in re.finditer(r"(?<![a-z0-9+])[0-9+]*([a-z][a-z0-9+]+://[^\s/:@]+:([^\s/:@]{4,})@)", text)]),
        ("random", [(m.start(), m.end(), m[1]) for m in re.finditer(rf"(?<!{run})({run}{{20,}}={{0,2}})", text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]),
    ):
        for s, e, v in matches:
            counts = [v.count(c) / len(v) for c in set(v)]
            if -sum(p * np.log2(p) for p in counts) >= 3 and not any(x < e and s < y for x, _, y in [*base, *found]):
                found.append((s, secrets.KINDS.index(kind), e))
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Bearer ", "bearer  ", "https://", "bob:", "hunter2XyZ@", "Zq8Rt2Lw9Xc4Vb7Nm1Kp", "Ab3De5Gh7Jk9Mn1Pq3St", "token=", "AKIA", "=", "==", " ", "\n", "é", "word", "0a1b2c3d4e5f60718293a4b5"]), max_size=12))
def test_weak_spans(parts):
    text = "".join(parts)
    base = secrets.base_spans(text)
    assert sorted(x[:3] for x in secrets.weak_spans(text, base)) == sorted(plain_weak(text, [x[:3] for x in base]))


def test_spans_take_time_in_proportion():
    import time

    random = np.random.default_rng(1)
    tokens = ["".join(random.choice(list("abcdefghijkABCDEFGHIJK0123456789"), 24)) for _ in range(2000)]
    text = " ".join(tokens * 20)
    began = time.process_time()
    found = secrets.weak_spans(text, secrets.base_spans(text))
    assert len(text) >= 1_000_000 - 1 and len(found) > 39_000 and time.process_time() - began < 6  # about one second here


def test_ownership(spark):
    """Distinct owners and repositories of every value, against a plain count."""
    random = np.random.default_rng(2)
    values = [f"Zq8Rt2Lw9Xc4Vb7Nm{i}Kp" for i in range(10, 16)]
    rows = [(int(random.integers(40)), " ".join(random.choice(values, 2)), "en", f"s{random.integers(3)}") for _ in range(120)]
    got = secrets.ownership(secrets.candidates(docs(spark, rows)).where("found IS NOT NULL"))
    want = {hashlib.blake2b(v.encode(), digest_size=16).digest(): (len({i for i, t, _, _ in rows if v in t}), len({s for _, t, _, s in rows if v in t}), sum(t.count(v) for _, t, _, _ in rows)) for v in values}
    assert {bytes(r.value): (r.repos, r.owners, r.uses) for r in got.collect()} == want


def test_secret_query(spark):
    folder = "/root/testdata/sf0.01"  # the least table with secrets
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op6_secret_scans(spark, folder).collect()
    assert len(got) == len(texts) and any(r.spans for r in got)
    for r in got:
        base = plain_base(texts[r.doc_id])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
