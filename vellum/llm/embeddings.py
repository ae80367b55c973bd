"""Embedding near-duplicates by sorted projection passes.

Each pass gives every vector a code of concatenated random hashes (the sides of random hyperplanes), orders the
vectors by it and compares each with the next few. What is ordered are codes with a 64-bit sketch, not vectors: only
those with a neighbour in the window whose bits are near enough for the threshold are ordered once more with
their vectors and verified. The verified pairs of all passes are united into components; later passes
leave out pairs that earlier ones have joined.

Where more vectors than a window share the first bits of a code, a window doesn't see the whole run: such runs
are compared whole in blocks, between components that the windows left apart. So a link can only be lost if its ends
share those bits in no pass, whatever lies around them. Those first bits grow with the table, so that runs of
evenly spread vectors fit a window, and the passes grow with them, so that the chance of a loss stays. Links are then
counted within each component in blocks, since a dense group has more links than bounded windows see.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, skew_join, written
from .components import components

BITS, WINDOW, THRESHOLD = 56, 48, 0.95
#: The first bits of a code that make a run, at least; the chance to lose a link at the threshold; passes of the first round.
PREFIX, LOSS, FIRST_PASSES = 12, 4e-4, 4
#: Blocks of a run or component have a sixteenth of its vectors, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 64, 4096
RANGE_ROWS = 4096
_SLICE = 4096
_ROW = {"head": pa.int64(), "code": pa.int64(), "cid": pa.int64()}


def plan(vectors: int, window: int = WINDOW, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(first bits, passes) for a table: 12 and 24 up to some 200,000 vectors, 25 and 109 at a billion.

    A pair at the threshold shares one bit with a chance q and the first k bits of a pass with q ** k; there are as many
    passes as it takes to miss it in all of them with a chance of at most LOSS.
    """
    bits = min(BITS, max(PREFIX, math.ceil(math.log2(max(1, vectors / window)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(LOSS) / math.log1p(-same))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that huge and tiny components neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _stack(column, kind: str) -> np.ndarray:
    return _unit(np.stack([np.frombuffer(v, kind) for v in column]).astype(np.float64))


def _planes(number: int, dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng([20240117, number, dims]).standard_normal((dims, bits))


def _signs(unit: np.ndarray, number: int, bits: int) -> np.ndarray:
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[::-1]
    return (((unit @ _planes(number, unit.shape[1], bits)) > 0) @ weights).astype(np.int64)


def _coded(classes: DataFrame, kind: str, passes: range, carried: dict[str, pa.DataType], sketched: bool = False) -> DataFrame:
    """(head, code[, sketch]) of each class (cid, raw) in each pass, and its columns ``carried``; head holds dimensions and pass."""
    width = np.dtype(kind).itemsize

    def run(parts):
        for part in parts:
            sizes = np.array([len(r) // width for r in part["raw"]])
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    unit = _stack([part["raw"][i] for i in some], kind)
                    own = {c: [part[c][i] for i in some] * len(passes) for c in carried}
                    out = {"head": np.repeat([int(dims) << 16 | p for p in passes], len(some)), "code": np.concatenate([_signs(unit, p, BITS) for p in passes])}
                    if sketched:
                        out["sketch"] = np.tile(_signs(unit, 1 << 20, 64), len(passes))
                    yield out | own

    return map_columns(classes.select("raw", *[c for c in carried if c != "raw"]), run, {"head": pa.int64(), "code": pa.int64()} | ({"sketch": pa.int64()} if sketched else {}) | carried)


def _forest(a, b) -> dict[str, list[int]]:
    """Links (a, b) that join what the given ones join, one for each node but the roots."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    return {"a": [x for x, _ in pairs], "b": [r for _, r in pairs]}


def _pairs(columns: dict, window: int, first: int, near) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows at most ``window`` apart that are ``near``, the later one at ``first`` or beyond."""
    n, found = len(columns["head"]), [(np.empty(0, np.int64),) * 2]
    for step in range(1, min(window, n - 1) + 1):
        i = np.arange(max(0, first - step), n - step)
        i = i[columns["head"][i] == columns["head"][i + step]]
        i = i[near(columns, i, i + step)]
        found.append((i, i + step))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _windowed(rows: DataFrame, fields: dict, window: int, ranges: int, prepare, near, emit, out: dict, label: str) -> DataFrame:
    """``emit`` of the pairs of rows that are ``near`` within ``window`` places in the order of (head, code, cid).

    The order is cut into ranges; each hands its first and last rows on, and those on either side of a border are compared
    afterwards, so that a window reaches across.
    """
    names, results = list(fields), {f"o_{c}": t for c, t in out.items()}  # names of rows and of results may be the same
    every = {"side": pa.int32(), "pid": pa.int32(), "place": pa.int32()} | fields | results

    def run(parts):
        from pyspark import TaskContext

        pid, before = TaskContext.get().partitionId(), None

        def border(columns, side):
            n = len(columns["head"])
            return {c: [None] * n for c in results} | columns | {"side": [side] * n, "pid": [pid] * n, "place": list(range(n))}

        for part in parts:
            for at in range(0, len(part["head"]), _SLICE):
                here = {c: np.array(part[c][at : at + _SLICE], object if t == pa.binary() else np.int64) for c, t in fields.items()}
                if before is None:
                    yield border({c: v[:window] for c, v in here.items()}, 1)
                seen = 0 if before is None else len(before["head"])
                here = here if before is None else {c: np.concatenate([before[c], here[c]]) for c in names}
                got = emit(here, *_pairs(prepare(here), window, seen, near))
                n = len(next(iter(got.values())))
                yield {c: [None] * n for c in every} | {f"o_{c}": v for c, v in got.items()} | {"side": [0] * n}
                before = {c: here[c][-window:] for c in names}
        if before is not None:
            yield border(before, 2)

    ordered = rows.repartitionByRange(ranges, "head", "code", "cid").sortWithinPartitions("head", "code", "cid")
    table = written(map_columns(ordered.select(*names), run, every), label)

    edges = table.where("side > 0")
    pids = edges.select("pid").distinct()
    following = pids.select("pid", F.lag("pid").over(Window.orderBy("pid")).alias("previous"))
    tails = edges.where("side = 2").withColumn("border", F.col("pid"))
    heads = edges.where("side = 1").join(F.broadcast(following), "pid").withColumn("border", F.col("previous")).where("border IS NOT NULL").select(*tails.columns)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "place"], ascending=[False, True])
        columns = {c: pdf[c].to_numpy(object if t == pa.binary() else np.int64) for c, t in fields.items()}
        return pd.DataFrame(emit(columns, *_pairs(prepare(columns), window, int((pdf["side"] == 2).sum()), near)), columns=list(out), dtype="int64")

    schema = ", ".join(f"{c} long" for c in out)
    crossing = tails.unionByName(heads).groupBy("border").applyInPandas(across, schema)
    return table.where("side = 0").select(*[F.col(f"o_{c}").alias(c) for c in out]).unionByName(crossing)


def _pass_links(classes: DataFrame, kind: str, passes: range, window: int, threshold: float, ranges) -> DataFrame:
    """A forest of the links (a, b) that the windows of ``passes`` see between vectors of different roots; classes: (cid, raw, root)."""
    bits = BITS + 64
    odds = math.acos(threshold) / math.pi
    most = bits * odds + 6 * math.sqrt(bits * odds * (1 - odds))  # a link differs in more bits with a chance under 1e-8

    def alike(c, i, j):
        differ = np.bitwise_count((c["code"][i] ^ c["code"][j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((c["sketch"][i] ^ c["sketch"][j]).view(np.uint64))
        return (differ <= most) & (c["root"][i] != c["root"][j])

    def flagged(c, i, j):
        at = np.unique(np.concatenate([i, j]))
        return {k: c[k][at] for k in _ROW}

    fields = _ROW | {"sketch": pa.int64(), "root": pa.int64()}
    slim = _coded(classes, kind, passes, {"cid": pa.int64(), "root": pa.int64()}, sketched=True)
    likely = written(_windowed(slim, fields, window, ranges(len(passes)), lambda c: c, alike, flagged, _ROW, "ordered").distinct(), "likely")

    def linked(c, i, j):
        return np.einsum("ij,ij->i", c["unit"][i], c["unit"][j]) >= threshold if len(i) else np.zeros(0, bool)

    def prepared(c):
        # Vectors of other dimensions lie under other heads; each head's rows are compared among themselves.
        width = max((len(r) for r in c["raw"]), default=0) // np.dtype(kind).itemsize
        unit = np.zeros((len(c["raw"]), width))
        for size in {len(r) for r in c["raw"]}:
            rows = [k for k, r in enumerate(c["raw"]) if len(r) == size]
            unit[rows, : size // np.dtype(kind).itemsize] = _stack([c["raw"][k] for k in rows], kind)
        return c | {"unit": unit}

    def joined(c, i, j):
        return _forest(c["cid"][i].tolist(), c["cid"][j].tolist())

    full = likely.join(classes.select("cid", "raw"), "cid")
    n = max(1, min(ranges(len(passes)), likely.count() // RANGE_ROWS))
    return _windowed(full, _ROW | {"raw": pa.binary()}, window, n, prepared, linked, joined, {"a": pa.int64(), "b": pa.int64()}, "windows").distinct()


def _in_blocks(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (with n, the size of their group) dealt to pairs of blocks (i, j) of their group; ``block`` is their own."""
    size = F.greatest(F.lit(least), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("n") / 16)))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / size).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))


def _each_pair(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` of the rows of each pair of blocks (i, j) of each group, the pairs of a group dealt to the tasks in turn."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.xxhash64(*keys) + F.col("i").cast("long") * F.col("blocks") + F.col("j"), F.lit(n)).cast("int")

    def walk(parts):
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            group = (part[[*keys, "i", "j"]] != part[[*keys, "i", "j"]].shift()).any(axis=1).cumsum()
            last = part.index[group == group.iloc[-1]][0] if len(part) else 0
            for _, own in part.iloc[:last].groupby(group.iloc[:last]):
                yield run(own)
            held = part.iloc[last:]
        if held is not None and len(held):
            yield run(held)

    return rows.withColumn("_task", task).repartitionById(n, "_task").sortWithinPartitions(*keys, "i", "j").mapInPandas(walk, schema)


def _run_links(threshold: float, kind: str):
    """A forest of the links between the components that meet in one pair of blocks of a run."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, root, block = _stack(pdf["raw"], kind), pdf["root"].to_numpy(), pdf["block"].to_numpy()
        rows, columns = np.flatnonzero(block == pdf["i"].iloc[0]), np.flatnonzero(block == pdf["j"].iloc[0])
        found = [np.empty((0, 2), np.int64)]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            x, y = np.nonzero((unit[some] @ unit[columns].T >= threshold) & (root[some][:, None] != root[columns]))
            found.append(np.unique(np.sort(np.stack([root[some][x], root[columns][y]], axis=1), axis=1), axis=0))
        found = np.concatenate(found)
        return pd.DataFrame(_forest(found[:, 0].tolist(), found[:, 1].tolist()), dtype="int64")

    return run


def _block_links(threshold: float, kind: str):
    """Links of the vectors of one pair of blocks of a component, copies counted by their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, copies, block = _stack(pdf["raw"], kind), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(pdf), np.int64)
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            near = unit[some] @ unit[columns].T >= threshold
            if i == j:
                near[np.arange(len(some)), at + np.arange(len(some))] = False  # itself
            links[some] += near @ copies[columns]
            if i != j:
                links[columns] += copies[some] @ near
        return pd.DataFrame({"cid": pdf["cid"], "links": links})

    return run


def _keyed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, key, raw) of each row and the number format of raw; key and raw are null for a vector that links with nothing."""
    single = "float" in vectors.schema[vector_col].dataType.simpleString()
    kind = "<f4" if single else "<f8"

    def run(parts):
        for part in parts:
            raw = []
            for v in part["v"]:
                v = None if v is None or not len(v) or None in v else np.array(v, np.float64) + 0.0  # one zero
                good = v is not None and np.isfinite(v).all() and v.any()
                raw.append(v.astype(kind).tobytes() if good else None)
            yield {"vec_id": part["vec_id"], "key": [r and hashlib.blake2b(r, digest_size=16).digest() for r in raw], "raw": raw}

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    return map_columns(rows, run, {"vec_id": pa.int64(), "key": pa.binary(), "raw": pa.binary()}), kind


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; other columns are ignored.

    Vectors of equal length are linked if their cosine, in double precision, is at least ``threshold``. Null or empty
    vectors, those of zeros and those with a null or non-finite component link with nothing. Equal vectors are
    handled as one and counted as links of each other. n_links counts all links inside the component, not only
    those that a window saw. Rows that repeat an id count as vectors of their own in one component; a null id never
    names a component: such a row gets the least other id of its component, or null, and isn't kept. An
    empty table gives an empty result. A link at the threshold is lost with a chance of at most LOSS (``plan``).
    """
    keyed, kind = _keyed(vectors, id_col, vector_col)
    grouped = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n, shuffle = classes.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, passes = plan(n, window, threshold)
    ranges = lambda number: max(1, min(shuffle, number * n // RANGE_ROWS))

    # Rows that share an id are of one component.
    slim = written(keyed.select("vec_id", "key"), "keys")
    several = slim.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.count("*").alias("n"), F.count_distinct("key").alias("kinds")).where("n > 1").select("vec_id", "kinds")
    several = written(several, "several")
    repeated = bool(several.take(1))
    links = vectors.sparkSession.createDataFrame([], "a long, b long")
    if repeated:
        own = slim.join(several.where("kinds > 1"), "vec_id").join(classes.select("key", "cid"), "key").select("vec_id", "cid").distinct()
        links = own.join(own.groupBy("vec_id").agg(F.min("cid").alias("first")), "vec_id").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))

    rooted = classes.select("cid", "raw", F.col("cid").alias("root"))
    for some in (range(FIRST_PASSES), range(FIRST_PASSES, passes)):
        links = written(links.unionByName(_pass_links(rooted, kind, some, window, threshold, ranges)), "links")
        roots = written(components(links), "roots")
        rooted = classes.select("cid", "raw").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    # Runs of one prefix beyond a window that still hold several components.
    prefix = F.shiftrightunsigned("code", BITS - bits).alias("prefix")
    runs = _coded(rooted, kind, range(passes), {"root": pa.int64()}).groupBy("head", prefix).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    torn = written(runs.where((F.col("n") > window + 1) & (F.col("lo") != F.col("hi"))).select("head", "prefix", "n"), "runs")
    if torn.take(1):
        rest = _coded(rooted, kind, range(passes), {"cid": pa.int64(), "root": pa.int64()}).select("head", prefix, "cid", "root").join(torn, ["head", "prefix"]).join(classes.select("cid", "raw"), "cid")
        crossing = _each_pair(_in_blocks(rest, 4 * LEAST_BLOCK), ["head", "prefix"], _run_links(threshold, kind), "a long, b long")
        roots = written(components(links.unionByName(crossing)), "roots")

    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    member = skew_join(roots, sizes, ["root"]).withColumnRenamed("node", "cid").join(classes.select("cid", "copies", "raw"), "cid")
    # A component may hold vectors of several lengths where an id repeats; those of one length are compared.
    member = _in_blocks(member.withColumn("dims", F.octet_length("raw")), LEAST_BLOCK)
    counted = _each_pair(member, ["root", "dims"], _block_links(threshold, kind), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))

    named = classes.select("key", "cid", "rep", "copies").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = skew_join(named.join(counted, "cid", "left"), lowest, ["root"])
    named = written(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least"), "named")
    out = skew_join(slim, named, ["key"], "left")
    if repeated:
        by_id = slim.join(several, "vec_id").where("key IS NOT NULL").select("vec_id", "key").join(named.select("key", "least"), "key").groupBy("vec_id").agg(F.min("least").alias("own_least"))
        out = out.join(by_id, "vec_id", "left").withColumn("least", F.coalesce("least", "own_least"))
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
