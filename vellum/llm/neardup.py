"""Near-duplicate documents: signatures, bands, exact Jaccard on full shingle sets, components.

``minhash_near_dedup`` signs with a circulant MinHash: one permutation scatters the shingle hashes over
the 2**32 ring, a second one, shifted circularly by one more step for each coordinate, ranks them.

Texts with equal shingle sets form a class with a number of its own; from there on only classes
are handled, so thousands of copies cost one row. Within a band's bucket every class
is paired with two centres (the least number and a pseudo-random one), and the pairs are verified on full sets.
Where that leaves a bucket of three or more in several components, all pairs of members from different
components are compared by signature in blocks of bounded size and the likely ones verified there, so
the components are those of all candidate pairs although dense buckets never emit their pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_docs, map_columns, marked, shingle_hashes, skew_join, slices, written
from .components import components

WORDS, BANDS, ROWS = 5, 24, 5
SIGNATURE = BANDS * ROWS
LINK_NUMERATOR, LINK_DENOMINATOR = 85, 100
BLOCK = 256


def _permute(x: np.ndarray, odd1: int, odd2: int, offset: int) -> np.ndarray:
    """A bijection of the 2**32 ring, in place."""
    x += np.uint32(offset)
    x *= np.uint32(odd1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(odd2)
    x ^= x >> np.uint32(13)
    return x


def circulant_signatures(sets: list[np.ndarray], size: int = SIGNATURE) -> np.ndarray:
    """uint32[len(sets), size]: coordinate k is the least rank, under the second permutation shifted by k,
    of the places that the first permutation gives the set's members. All ones for an empty set."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    for first, last in batches_of_docs(sets):
        rows = np.array([i for i in range(first, last) if len(sets[i])], np.int64)
        if not len(rows):
            continue
        folded = np.concatenate([sets[i] for i in rows])
        place = _permute((folded ^ (folded >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in rows])[:-1]))
        rank = np.empty_like(place)
        for k in range(size):
            np.add(place, np.uint32(k), out=rank)
            _permute(rank, 0x9E3779B1, 0x7FEB352D, 0x165667B1)
            out[rows, k] = np.minimum.reduceat(rank, starts)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64[n, bands]: a hash of each band's coordinates and its number."""
    out = np.empty((len(signatures), bands), np.int64)
    for i, row in enumerate(np.ascontiguousarray(signatures[:, : bands * rows])):
        for j in range(bands):
            out[i, j] = int.from_bytes(hashlib.blake2b(row[j * rows : (j + 1) * rows].tobytes(), digest_size=8, salt=j.to_bytes(2, "little")).digest(), "little", signed=True)
    return out


def signed(docs: DataFrame, sign=circulant_signatures, bands: int = BANDS, rows: int = ROWS, width: int = WORDS) -> DataFrame:
    """(doc_id, place, n_shingles, set_key, bands, sketch) of each row; the last three are null for an empty set.

    ``place`` is a hash of the text, by which a later scan finds it again.
    """

    def run(parts):
        for part in parts:
            for some in slices(part):
                sets = [shingle_hashes(t, width) if t else np.empty(0, np.uint64) for t in some["text"]]
                signatures = sign(sets, bands * rows)
                keys = band_keys(signatures, bands, rows).tolist()
                yield {
                    "doc_id": some["doc_id"], "place": some["place"], "n_shingles": [len(s) for s in sets],
                    "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "bands": [k if len(s) else None for k, s in zip(keys, sets)],
                    "sketch": [(s & np.uint32(255)).astype(np.uint8).tobytes() if len(x) else None for s, x in zip(signatures, sets)],
                }

    fields = {"doc_id": pa.int64(), "place": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "bands": pa.list_(pa.int64()), "sketch": pa.binary()}
    return map_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("place")), run, fields)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, members) with the shingle hashes of every class in ``wanted`` (cid, set_key, place).

    The documents are scanned once more and only sets leave the scan, those of the wanted places and of a few that the
    bitmap lets pass; no text shuffles.
    """

    def sets(parts):
        for part in parts:
            for some in slices(part):
                raw = [shingle_hashes(t, width).tobytes() for t in some["text"]]
                yield {"set_key": [hashlib.blake2b(x, digest_size=16).digest() for x in raw], "members": raw}

    hit = marked(docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("place")), wanted.select("place"), "place").where("_maybe").select("text")
    found = map_columns(hit, sets, {"set_key": pa.binary(), "members": pa.binary()})
    return found.groupBy("set_key").agg(F.first("members").alias("members")).join(wanted.select("cid", "set_key").hint("merge"), "set_key").select("cid", "members")


def _alike(a: np.ndarray, b: np.ndarray, numerator: int, denominator: int) -> bool:
    """Whether denominator * |intersection| >= numerator * |union| for two sorted arrays of distinct values."""
    if not len(a) or not len(b) or denominator * min(len(a), len(b)) < numerator * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return denominator * shared >= numerator * (len(both) - shared)


def _verified(pairs: DataFrame, members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes whose full shingle sets are alike enough."""

    def alike(parts):
        for part in parts:
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), numerator, denominator) for x, y in zip(part["x"], part["y"])]
            yield part.loc[keep, ["a", "b"]]

    one = skew_join(pairs, members.select(F.col("cid").alias("a"), F.col("members").alias("x")), ["a"])
    two = skew_join(one, members.select(F.col("cid").alias("b"), F.col("members").alias("y")), ["b"])
    return two.select("a", "b", "x", "y").mapInPandas(alike, "a long, b long")


def _crossing(pdf: pd.DataFrame, least: float):
    """For each member of block i in turn, the places of those of block j in another component whose sketches agree with it
    in a share of ``least``, and whose pair no lower band's task takes."""
    sketch, bands = np.stack([np.frombuffer(s, np.uint8) for s in pdf["sketch"]]), np.stack(pdf["bands"].to_list())
    cid, block = pdf["cid"].to_numpy(), pdf["block"].to_numpy()
    band = int(np.flatnonzero(bands[0] == pdf["bucket"].iloc[0])[0])
    left, right = pdf["i"].iloc[0], pdf["j"].iloc[0]
    rows, columns = np.flatnonzero(block == left), np.flatnonzero(block == right)
    across, enough = sketch[columns], least * sketch.shape[1]

    def near(r, root):
        agree = (across == sketch[r]).sum(axis=1) >= enough
        found = columns[agree & (root[columns] != root[r]) & ((cid[columns] > cid[r]) if left == right else True)]
        return found[~(bands[found, :band] == bands[r, :band]).any(axis=1)] if len(found) else found

    return rows, near


def _likely_members(least: float):
    """The members of one block pair of a bucket that have a likely partner in another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, hit = pdf["root"].to_numpy(), np.zeros(len(pdf), bool)
        rows, near = _crossing(pdf, least)
        for r in rows:
            found = near(r, root)
            hit[found] = True
            hit[r] |= len(found) > 0
        return pdf.loc[hit, ["bucket", "i", "j", "block", "cid", "root", "bands", "sketch"]]

    return run


def _cross_links(least: float, numerator: int, denominator: int):
    """A forest of the links between members of one block pair of a bucket that lie in different components.

    Pairs whose sketches agree are verified on full sets, unless a link found here has joined their components, or
    they share a bucket of a lower band, whose task takes them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, cid, root, found = [np.frombuffer(m, np.uint64) for m in pdf["members"]], pdf["cid"].to_numpy(), pdf["root"].to_numpy().copy(), []
        rows, near = _crossing(pdf, least)
        for r in rows:
            for c in near(r, root):
                if root[c] != root[r] and _alike(sets[r], sets[c], numerator, denominator):
                    found.append((cid[r], cid[c]))
                    root[root == root[c]] = root[r]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def linked_rows(docs: DataFrame, sign=circulant_signatures, bands: int = BANDS, rows: int = ROWS, width: int = WORDS,
                numerator: int = LINK_NUMERATOR, denominator: int = LINK_DENOMINATOR, by_id: bool = True) -> DataFrame:
    """(doc_id, place, n_shingles, set_key, cid, least) for each row of ``docs`` (doc_id, text).

    ``cid`` names the component, null for a text without a shingle of an id that has no other; ``least`` is the
    least doc_id in it, null where none is known. Without ``by_id`` rows that share an id aren't linked for that.
    See ``link_components``.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows_of = written(signed(docs, sign, bands, rows, width), "signed")
    grouped = rows_of.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("place").alias("place"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = classes.select("cid", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("least"), F.min_by("cid", F.xxhash64("cid", "bucket")).alias("any")).where("n > 1")
    shared = written(skew_join(members, buckets, ["bucket"]).select("bucket", "n", "cid", "least", "any"), "shared")
    stars = shared.select("cid", F.explode(F.array("least", "any")).alias("centre")).where("cid <> centre")
    tested = written(stars.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct(), "pairs")
    candidates = tested.select(F.col("a").alias("cid")).union(tested.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.select("cid", "set_key", "place").join(candidates, "cid", "left_semi")
    members = written(shingle_sets(docs, wanted, width), "members")
    # Texts that share an id are one document.
    repeated = False
    if by_id:
        several = rows_of.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("set_key").alias("sets")).where("n > 1").select("doc_id", "sets")
        several = written(several, "several")
        repeated = bool(several.take(1))
    links = _verified(tested, members, numerator, denominator)
    if repeated:
        own = rows_of.join(several.where("sets > 1"), "doc_id").join(classes.select("set_key", "cid"), "set_key").select("doc_id", "cid").distinct()
        first = own.groupBy("doc_id").agg(F.min("cid").alias("first"))
        links = links.union(own.join(first, "doc_id").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")))
    roots = written(components(links), "roots")

    # Buckets of three or more that still hold several components: the pairs that no star tested. Sketches go to
    # the blocks first, whole sets only of the members that have a likely partner there.
    wide = shared.where("n > 2").select("bucket", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    torn = wide.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    rest = skew_join(wide, torn, ["bucket"])
    rest = rest.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rest = rest.join(classes.select("cid", "sketch", "bands"), "cid").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "cid", "root", "sketch", "bands")
    threshold = numerator / denominator
    least = threshold - 5 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    schema = "bucket long, i int, j int, block int, cid long, root long, bands array<bigint>, sketch binary"
    # These tasks compute much on few bytes, so their number is stated and nothing puts them together.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    likely = rest.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(_likely_members(least), schema)
    crossing = likely.join(members, "cid").repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(_cross_links(least, numerator, denominator), "a long, b long")
    crossing = written(crossing.distinct(), "crossing")  # few rows of many tasks, in few files
    final = written(components(crossing.union(roots)), "roots") if crossing.take(1) else roots

    named = classes.select("set_key", "cid", "rep").join(final.withColumnRenamed("node", "cid"), "cid", "left").select("set_key", "rep", F.coalesce("root", "cid").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = written(skew_join(named, lowest, ["root"]).select("set_key", "root", "least"), "named")
    out = skew_join(rows_of.select("doc_id", "place", "n_shingles", "set_key"), named, ["set_key"], "left")
    if repeated:  # a text without a shingle belongs to its id's component
        with_words = rows_of.join(several, "doc_id").where("set_key IS NOT NULL").select("doc_id", "set_key").join(named, "set_key")
        by_id = with_words.groupBy("doc_id").agg(F.first("root").alias("own_root"), F.first("least").alias("own_least"))
        out = out.join(by_id, "doc_id", "left").withColumn("root", F.coalesce("root", "own_root")).withColumn("least", F.coalesce("least", "own_least"))
    return out.select("doc_id", "place", "n_shingles", "set_key", F.col("root").alias("cid"), "least")


def link_components(docs: DataFrame, sign=circulant_signatures, bands: int = BANDS, rows: int = ROWS, width: int = WORDS,
                    numerator: int = LINK_NUMERATOR, denominator: int = LINK_DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; more columns are ignored).

    Rows are linked if the Jaccard index of their sets of ``width``-word shingles is at least
    numerator / denominator; component_id is the least doc_id reachable. Null, empty and blank texts have
    no shingle and stand alone. Rows that repeat a doc_id are one document, linked by each of its texts. A null
    doc_id never names a component: such a row gets the least non-null id of its component, or null, and
    isn't kept. An empty table gives an empty result. A link can be lost in two ways: at the threshold a pair shares no
    band with a chance of under 1e-6 at the default parameters, and a pair that no star tested is passed over where its
    sketches agree five standard deviations less than expected, a chance of under 1e-6 too.
    """
    out = linked_rows(docs, sign, bands, rows, width, numerator, denominator)
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """``link_components`` by circulant MinHash with the production parameters."""
    return link_components(docs)
