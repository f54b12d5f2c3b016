"""Near copies by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.scratch import Scratch

SUBKEYS = 18  # of each of the two collections: 18 * 18 tables from 36 sub-keys
HASHES = 4  # minhashes in a sub-key, so 8 in a table key
FEW = 64  # members up to which a group is compared directly, and rows of a rare shingle
BLOCK = 1 << 16  # shingles hashed at a time
BROADCAST_IDS = 2_000_000  # candidates whose ids are broadcast to pick their texts, 16 bytes each

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are what white space separates after lower-casing A-Z; the set of a
    text holds its distinct ``width``-word shingles, as 64-bit hashes, and a
    shorter text is one shingle. Texts are linked if the intersection is at
    least ``percent`` of the union, decided on the full sets.

    *Tables.* Two collections of SUBKEYS sub-keys with HASHES minhashes each
    are computed per distinct set. Every pair of a sub-key of the first and one
    of the second is the key of one table. At the limit of 0.8 a pair shares no
    table with a probability of 1.5 in 10,000, and less above it.

    *Candidates.* Only sub-keys seen twice are paired. The member of a bucket
    with the most shared sub-keys leads it and is compared with the others.
    Groups are what the leaders hold together. Members that the links found so
    far do not tie to the largest part of their group ("strays") are then
    compared with the rest of it. In a group of more than FEW that goes by an
    exact bound: with S the shingles that more than FEW members hold, two
    members share at most ``min(|x & S|, |y & S|)`` shingles and those rarer
    ones which an index finds. No pair that shares a table is lost, and no
    group is expanded into all of its pairs.

    Null, empty and blank texts have no shingles and link with nothing. Rows
    with equal ids are one document. Rows without an id take no part in links
    to others and are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    signed = scratch.table(
        source.mapInArrow(
            lambda batches: _sign(batches, width),
            "id long, n long, h1 long, h2 long, sub array<long>",
        ),
        "signatures",
    )
    classes = scratch.table(
        signed.filter("n > 0 and id is not null")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sub").alias("sub")),
        "classes",
    )
    stars = _stars(scratch, classes)
    ids = stars.select("id").unionByName(stars.select(F.col("lead").alias("id"))).distinct()
    ids = scratch.table(ids, "candidates")
    few = ids.count() <= BROADCAST_IDS
    sets = scratch.table(
        source.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(
            lambda batches: _sets(batches, width), "id long, n long, shingles binary"
        ),
        "sets",
    )
    compared = scratch.table(
        _compare(stars.withColumnRenamed("lead", "a").withColumnRenamed("id", "b"), sets, percent),
        "compared",
    )
    links = compared.filter("linked").select("a", "b")
    late = _stray_pairs(scratch, stars, links, sets, percent)
    if late is not None:
        again = scratch.table(_compare(late, sets, percent), "compared-strays")
        links = links.unionByName(again.filter("linked").select("a", "b"))
    roots = scratch.table(components(scratch, links), "roots")
    of_class = scratch.table(
        classes.select("h1", "h2", F.col("id").alias("node"))
        .join(roots, "node", "left")
        .select("h1", "h2", F.coalesce("root", "node").alias("root")),
        "class-roots",
    )
    found = signed.select("id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    out = found.select("id", "n", root.alias("root"))
    # An id that stands on rows of several classes belongs to the smallest root.
    many = signed.filter("id is not null").groupBy("id").count().filter("count > 1")
    if not many.isEmpty():
        least = scratch.table(
            out.join(many.select("id"), "id", "left_semi")
            .groupBy("id")
            .agg(F.min("root").alias("least")),
            "repeated-ids",
        )
        out = out.join(least, "id", "left").withColumn("root", F.coalesce("least", "root"))
    return scratch.finish(
        out.select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.col("root").alias("component_id"),
            (F.col("id").isNull() | (F.col("id") == F.col("root"))).alias("kept"),
        )
    )


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    code = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    if len(code) < width:
        whole = np.frombuffer(code.tobytes(), np.uint8).tobytes()
        return np.array([xxhash.xxh3_64_intdigest(whole, seed=len(code))], dtype=np.uint64)
    n = len(code) - width + 1
    mixed = code[:n].copy()
    for j in range(1, width):
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(31)
        mixed += code[j : j + n]
    mixed *= _FOLD
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    size = 2 * SUBKEYS * HASHES
    factors = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, size, dtype=np.uint64)


def subkeys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 2 * SUBKEYS sub-keys for every non-empty set."""
    factors, shifts = _functions()
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), 2 * SUBKEYS), np.uint64)
    work = np.empty_like(flat)
    for k in range(len(factors)):
        np.multiply(flat, factors[k], out=work)
        work += shifts[k]
        column = out[:, k // HASHES]
        column *= _FOLD
        column ^= column >> np.uint64(32)
        column += np.minimum.reduceat(work, starts)
    # The number of the sub-key goes in last, so that equal minhashes of two do not meet.
    out += np.arange(1, 2 * SUBKEYS + 1, dtype=np.uint64) * _MIX
    out *= _FOLD
    return out ^ (out >> np.uint64(31))


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text")
        n, h1, h2 = [], [], []
        rows: list[np.ndarray | None] = []
        pending: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pending:
                rows.extend(subkeys(pending))
                pending.clear()
                held = 0

        for text in texts:
            found = shingle_hashes(text.as_py(), width)
            digest = xxhash.xxh3_128_digest(found.tobytes())
            n.append(len(found))
            h1.append(int.from_bytes(digest[:8], "little", signed=True))
            h2.append(int.from_bytes(digest[8:], "little", signed=True))
            if len(found):
                pending.append(found)
                held += len(found)
                if held >= BLOCK:
                    flush()
        flush()
        filled = np.array(n) > 0
        lengths = np.where(filled, 2 * SUBKEYS, 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
        sub = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), sub],
            ["id", "n", "h1", "h2", "sub"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_hashes(t.as_py(), width) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([f.tobytes() for f in found], pa.binary()),
            ],
            ["id", "n", "shingles"],
        )


def _stars(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """``lead, id``: every member of a table's bucket with the bucket's leader, once."""
    single = classes.select("id", F.posexplode("sub").alias("at", "key"))
    seen = scratch.table(
        single.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-subkeys"
    )
    first = F.col("at") < SUBKEYS
    halves = (
        single.join(seen, "key")
        .groupBy("id")
        .agg(
            F.sum("c").alias("weight"),
            F.collect_list(F.when(first, F.col("key"))).alias("left"),
            F.collect_list(F.when(~first, F.col("key"))).alias("right"),
        )
    )
    tables = (
        halves.select("id", "weight", F.explode("left").alias("l"), "right")
        .select("id", "weight", "l", F.explode("right").alias("r"))
        .select("id", "weight", F.xxhash64("l", "r").alias("key"))
    )
    tables = scratch.table(tables, "tables")
    lead = scratch.table(
        tables.groupBy("key")
        .agg(
            F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"),
            F.count(F.lit(1)).alias("c"),
        )
        .filter("c > 1")
        .select("key", (-F.col("top.minus")).alias("lead")),
        "leaders",
    )
    pairs = tables.select("key", "id").join(lead, "key").filter("id <> lead")
    return scratch.table(pairs.select("lead", "id").distinct(), "stars")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` with the sizes of both sets, and whether they are linked."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                both = int(np.count_nonzero(p[np.minimum(at, len(p) - 1)] == q))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            kept = [batch.column(c) for c in ("a", "b", "na", "nb")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(linked, pa.bool_())], ["a", "b", "na", "nb", "linked"]
            )

    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(
        check, "a long, b long, na long, nb long, linked boolean"
    )


def _stray_pairs(
    scratch: Scratch, stars: DataFrame, links: DataFrame, sets: DataFrame, percent: int
) -> DataFrame | None:
    """Pairs of a stray with another member of its group that may still be linked.

    A group is a component of the stars, so texts that share a table are in one
    group. Its members fall into the parts that the links found so far make;
    strays are those outside the largest part.
    """
    group = components(scratch, stars, "lead", "id").withColumnRenamed("root", "g")
    part = components(scratch, links)
    members = scratch.table(
        group.join(part, "node", "left")
        .join(sets.select(F.col("id").alias("node"), "n"), "node")
        .select("g", F.col("node").alias("id"), "n", F.coalesce("root", "node").alias("part")),
        "grouped",
    )
    parts = members.groupBy("g", "part").agg(F.count(F.lit(1)).alias("held"))
    groups = scratch.table(
        parts.groupBy("g")
        .agg(F.max(F.struct("held", "part")).alias("top"), F.sum("held").alias("size"))
        .filter("size > top.held")
        .select("g", F.col("top.part").alias("main"), "size"),
        "groups-with-strays",
    )
    if groups.isEmpty():
        return None
    stray = (F.col("part") != F.col("main")).alias("stray")
    members = scratch.table(
        members.join(groups, "g").select("g", "id", "n", "part", "size", stray), "members"
    )
    x = members.filter("stray").select(
        "g", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px"), "size"
    )
    y = members.select(
        "g", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("part").alias("py"),
        F.col("stray").alias("sy"),
    )
    fits = (F.col("px") != F.col("py")) & (~F.col("sy") | (F.col("x") < F.col("y"))) & (
        100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    )
    pairs = x.filter(F.col("size") <= FEW).drop("size").join(y, "g").filter(fits).select("x", "y")
    large = members.filter(F.col("size") > FEW)
    if not large.isEmpty():
        pairs = pairs.unionByName(_bounded_pairs(scratch, large, sets, percent))
    low, high = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    return scratch.table(pairs.select(low, high).distinct(), "stray-pairs")


def _bounded_pairs(
    scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Pairs ``x, y`` of large groups whose sets can be alike enough, x a stray.

    Alike means ``(100 + p) * |x & y| >= p * (|x| + |y|)`` for p percent.
    """
    ratio = (100 + percent) / percent

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.int64)
                take = pa.array(np.zeros(len(flat), np.int64))
                one = batch.slice(i, 1)
                kept = [one.column(c).take(take) for c in ("g", "id", "stray")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(flat)], ["g", "id", "stray", "s"])

    rows = members.select("g", "id", "stray").join(sets.select("id", "shingles"), "id")
    rows = scratch.table(
        rows.select("g", "id", "stray", "shingles").mapInArrow(
            listed, "g long, id long, stray boolean, s long"
        ),
        "member-shingles",
    )
    held = scratch.table(
        rows.groupBy("g", "s")
        .agg(F.count(F.lit(1)).alias("f"), F.max("stray").alias("any"))
        .filter("f > 1"),
        "held-shingles",
    )
    common = rows.join(held.filter(F.col("f") > FEW).select("g", "s"), ["g", "s"])
    counted = common.groupBy("g", "id").agg(F.count(F.lit(1)).alias("c"))
    known = scratch.table(
        members.select("g", "id", "n", "part", "stray")
        .join(counted, ["g", "id"], "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .withColumn("room", ratio * F.col("c") - F.col("n")),
        "bounds",
    )
    x = known.filter("stray").select(
        "g", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"),
        F.col("room").alias("rx"), F.col("part").alias("px"),
    )
    y = known.select(
        "g", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"),
        F.col("room").alias("ry"), F.col("part").alias("py"),
    )
    apart = F.col("px") != F.col("py")
    # (1) By their common shingles alone: |y| <= room(x) and |x| <= room(y), met by length.
    bin_of = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))
    least = F.lit(percent / 100) * F.col("nx")
    reach = x.filter(F.col("rx") >= least).withColumn(
        "bin", F.explode(F.sequence(bin_of(least) - 1, bin_of(F.col("rx")) + 1))
    )
    binned = y.withColumn("bin", bin_of(F.col("ny")))
    best = binned.groupBy("g", "bin").agg(F.min("ny").alias("shortest"), F.max("ry").alias("widest"))
    reach = reach.join(best, ["g", "bin"]).filter("shortest <= rx and widest >= nx")
    fits = (F.col("ny") <= F.col("rx")) & (F.col("nx") <= F.col("ry")) & apart
    by_length = reach.join(binned, ["g", "bin"]).filter(fits).select("x", "y")
    # (2) With rarer shingles in common, ``need`` at least: then any ``has - need + 1`` of the
    # stray's own hold one that is shared, and its rarest are the cheapest to look up.
    rare = held.filter((F.col("f") <= FEW) & F.col("any")).select("g", "s", "f")
    mine = rows.filter("stray").join(rare, ["g", "s"]).withColumnRenamed("id", "x")
    has = mine.groupBy("g", "x").agg(F.count(F.lit(1)).alias("has"))
    shortest = known.groupBy("g").agg(F.min("n").alias("least_n"))
    other = F.greatest(F.col("least_n").cast("double"), least)
    need = F.greatest(F.lit(1), F.ceil((F.col("nx") + other) / ratio - F.col("cx") - 1e-6))
    probing = scratch.table(
        has.join(x, ["g", "x"])
        .join(shortest, "g")
        .withColumn("probes", F.col("has") - need + 1)
        .filter("probes > 0"),
        "probing",
    )
    nth = F.row_number().over(Window.partitionBy("g", "x").orderBy("f", "s"))
    probes = mine.join(probing.select("g", "x", "probes"), ["g", "x"]).withColumn("nth", nth)
    probes = probes.filter("nth <= probes").select("g", "s", "x")
    holders = rows.join(rare.select("g", "s"), ["g", "s"]).select("g", "s", F.col("id").alias("y"))
    met = probes.join(holders, ["g", "s"]).filter("x <> y")
    shared = met.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("e"))
    most = F.least("cx", "cy") + F.col("e") + F.col("has") - F.col("probes")
    bound = ratio * most >= F.col("nx") + F.col("ny") - 1e-6
    by_rare = shared.join(probing, ["g", "x"]).join(y, ["g", "y"]).filter(bound & apart)
    return by_length.unionByName(by_rare.select("x", "y"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    same: tuple[str, ...] = (), **options,
) -> DataFrame:
    """One row of every group of near copies, that of the smallest id; see ``near_duplicates``.

    Of rows with equal ids, and equal columns ``same`` where given, the one with
    the smallest hash of its text stays. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.filter(F.col("kept") & F.col(id_col).isNotNull()).select(id_col)
    repeated = not kept.groupBy(id_col).count().filter("count > 1").isEmpty()
    rows = docs.join(kept.distinct() if repeated else kept, id_col, "left_semi")
    if repeated:
        order = Window.partitionBy(id_col, *same).orderBy(F.xxhash64(F.col(text_col)))
        rows = rows.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1")
    rows = rows.select(*docs.columns)
    return rows.unionByName(docs.filter(F.col(id_col).isNull()))
