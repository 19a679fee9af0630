"""Near-duplicate documents: b-bit MinHash signatures joined by multi-index Hamming search.

1. A document's set is its distinct 5-word shingles. Documents with equal sets
   collapse into one node, so exact copies never meet in a pair.
2. Each node gets SLOTS minhashes cut to 16 bits. The signature is split into
   CHUNKS chunks of WIDTH slots. By the pigeonhole principle two signatures
   that differ in at most RADIUS = CHUNKS * (ERRORS + 1) - 1 slots agree in
   some chunk but for ERRORS slots; the allowed errors are enumerated by
   leaving out each slot of a chunk in turn. Every such pair meets in a bucket.
3. Buckets of up to SMALL nodes give all their pairs. A larger bucket is
   resolved exactly without its pairs, see ``_resolve_large``.
4. Pairs whose signatures differ in more than FAR slots go (a link at
   similarity 0.75 does so with a chance of 4e-6); the others are confirmed on
   the full sets: 100 * intersection >= 75 * union.
5. Connected components of the links.

Signatures, buckets, links and components stay distributed. At similarity 0.75
a pair misses every bucket with a chance of 2e-5, less above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .components import connected_components
from .shared import Workspace

SLOTS, CHUNKS, WIDTH, ERRORS = 32, 8, 4, 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
FAR = 20
SMALL = 64
OUTSIDE = 1024
RARE = 4
MAP_BITS = 2048
ROWS_A_TASK = 20_000
HUBS = 2
BLOCK = 1024
SLICE = 65_536

_RNG = np.random.default_rng(75)
_MUL = _RNG.integers(1, 2**63, size=SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL2 = _RNG.integers(1, 2**63, size=SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SLOTS minhashes of 16 bits for each nonempty set."""
    out = np.empty((len(sets), SLOTS), dtype=np.uint16)
    if not sets:
        return out
    values = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    for k in range(SLOTS):
        x = values * _MUL[k]
        x ^= x >> np.uint64(32)
        x *= _MUL2[k]
        out[:, k] = (textvec.mix(np.minimum.reduceat(x, begin)) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket keys of each signature: every chunk with each slot left out in turn."""
    keys = []
    for c in range(CHUNKS):
        for left_out in range(WIDTH):
            key = np.full(len(sig), c * WIDTH + left_out + 1, dtype=np.uint64)
            for s in range(WIDTH):
                if s != left_out:
                    key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * WIDTH + s].astype(np.uint64))
            keys.append(key.view(np.int64))
    return np.stack(keys, axis=1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            sets = textvec.shingle_sets(part.column(1))
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([textvec.digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "name", "sig"],
            )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SLOTS)
            keys = chunk_keys(sig)
            rows = np.repeat(np.arange(len(batch)), keys.shape[1])
            chunk = np.tile(np.repeat(np.arange(CHUNKS, dtype=np.int32), WIDTH), len(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel(), pa.int64()), batch.column(0).take(pa.array(rows)), pa.array(chunk)],
                names=["key", "name", "chunk"],
            )


def _second_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, size, shared, key, chunk, sig) to one row for each cell of the entry's bucket that the signature lies in."""
    kept = list(combinations(range(WIDTH), WIDTH - RADIUS // (CHUNKS - 1)))
    for batch in batches:
        if len(batch):
            sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint16).reshape(-1, SLOTS)
            key, chunk = batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy()
            for c in range(CHUNKS):
                rows = np.flatnonzero(chunk != c)
                for number, slots in enumerate(kept):
                    cell = textvec.mix(key[rows] + np.uint64(c * len(kept) + number + 1))
                    for s in slots:
                        cell = textvec.mix(cell * np.uint64(0x9E3779B97F4A7C15) + sig[rows, c * WIDTH + s].astype(np.uint64))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(at) for k in range(3)), pa.array(cell.view(np.int64)), batch.column(4).take(at)],
                        names=["name", "size", "shared", "key", "chunk"],
                    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose signatures differ in more than FAR slots."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, SLOTS) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a != b).sum(axis=1) <= FAR))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, text_a, text_b) that are links; equal b next to each other are read once."""
    for batch in batches:
        for part in textvec.slices(batch, "text_a"):
            names = part.column(1).to_pylist()
            turns = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            right = textvec.shingle_sets(part.column(3).take(pa.array(turns, pa.int64())))
            found, turn = [], -1
            for k, left in enumerate(textvec.shingle_sets(part.column(2))):
                turn += turn + 1 < len(turns) and turns[turn + 1] == k
                both = len(np.intersect1d(left, right[turn], assume_unique=True))
                found.append(100 * both >= 75 * (len(left) + len(right[turn]) - both))
            yield part.select([0, 1]).filter(pa.array(found, pa.bool_()))


def _shingle_lists(parts: int):
    """(node, text) to (part, shingles, nodes): a text's shingles with their node, dealt by hash over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textvec.slices(batch, "text"):
                sets = textvec.shingle_sets(piece.column(1))
                flat = np.concatenate(sets)
                node = np.repeat(piece.column(0).to_numpy(), [len(s) for s in sets])
                of = (flat % np.uint64(parts)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                flat, node, of = flat[order], node[order], of[order]
                at = np.flatnonzero(np.diff(of, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of[at]),
                        pa.array([x.tobytes() for x in np.split(flat, at[1:])], pa.binary()),
                        pa.array([x.tobytes() for x in np.split(node, at[1:])], pa.binary()),
                    ],
                    names=["part", "shingles", "nodes"],
                )

    return run


def _rare_shingles(part: pa.Table) -> pa.Table:
    """Of one part: (node, null, how many of its shingles at most RARE nodes have) and (node, node, 0) for owners of such a shingle."""
    flat = np.frombuffer(b"".join(part.column("shingles").to_pylist()), np.uint64)
    node = np.frombuffer(b"".join(part.column("nodes").to_pylist()), np.int64)
    order = np.lexsort((node, flat))
    flat, node = flat[order], node[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(begin, len(flat)))
    few = count <= RARE
    owner, times = np.unique(node[np.repeat(few, count)], return_counts=True)
    x, y = [owner], [np.zeros(0, np.int64)]
    for n in range(2, RARE + 1):
        group = node[begin[count == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i + 1, n):
                x.append(group[:, i])
                y.append(group[:, j])
    couples = np.unique(np.stack([np.concatenate(x[1:]), np.concatenate(y[1:])], axis=1), axis=0) if len(x) > 1 else np.zeros((0, 2), np.int64)
    return pa.table(
        {
            "x": pa.array(np.concatenate([owner, couples[:, 0]])),
            "y": pa.array(np.concatenate([owner, couples[:, 1]]), mask=np.arange(len(owner) + len(couples)) < len(owner)),
            "n": pa.array(np.concatenate([times, np.zeros(len(couples), np.int64)])),
        }
    )


def _bit_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            maps = []
            for s in textvec.shingle_sets(part.column(1)):
                bits = np.zeros(MAP_BITS, dtype=np.uint8)
                bits[s >> np.uint64(64 - MAP_BITS.bit_length() + 1)] = 1
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(maps, pa.binary())], names=["name", "bits"])


def _may_link(part: pa.Table) -> pa.Table:
    """(a, b): the hubs of one cell with its nodes of other components that the exact bounds and the bit maps leave open.

    Two sets have at most as many elements in common as places that both maps
    have set, and the lesser number of elements that share a place with others.
    """
    part = part.combine_chunks()
    hub = part.column("hub").to_numpy(zero_copy_only=False)
    size, shared = part.column("size").to_numpy(), part.column("shared").to_numpy()
    of = np.unique(np.array(part.column("part").to_pylist(), dtype=object), return_inverse=True)[1]
    bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(len(part), -1)
    hidden = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    left, right = np.flatnonzero(hub), np.flatnonzero(~hub)
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, SLICE // max(1, len(right)))
    for at in range(0, len(left), step):
        h = left[at : at + step]
        able = (of[h][:, None] != of[right]) & (7 * np.minimum(shared[h][:, None], shared[right]) >= 3 * (size[h][:, None] + size[right]))
        i, j = np.nonzero(able)
        i, j = h[i], right[j]
        most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[i], hidden[j])
        may = 7 * most >= 3 * (size[i] + size[j])
        x.append(i[may])
        y.append(j[may])
    name = part.column("name")
    return pa.table({"a": name.take(pa.array(np.concatenate(y))), "b": name.take(pa.array(np.concatenate(x)))})


class _Run:
    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.space = Workspace(docs.sparkSession, "neardup")

    def confirm(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links on their full sets."""
        left = texts.select(F.col("name").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("name").alias("b"), F.col("text").alias("text_b"))
        return (
            pairs.join(left, "a")
            .join(right, "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(_confirm, "a binary, b binary")
        )

    def texts(self, nodes: DataFrame, names: DataFrame) -> DataFrame:
        """One whole text for each of some nodes, from the document that owns it."""
        wanted = nodes.join(names, "name", "left_semi").select("name", "owner.doc_id", "owner.text_hash")
        found = (
            self.docs.withColumn("text_hash", F.xxhash64("text"))
            .join(wanted, ["doc_id", "text_hash"])
            .select("name", "text")
            .dropDuplicates(["name"])
        )
        return self.space.keep(found, "texts")


def _pairs_near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    one = nodes.select(F.col("name").alias("a"), F.col("sig").alias("sig_a"))
    two = nodes.select(F.col("name").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a binary, b binary")


def _resolve_large(run: _Run, entries: DataFrame, nodes: DataFrame, texts: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    """Links within buckets of more than SMALL nodes, without their pairs.

    A shingle that at most RARE nodes of large buckets have gives its few pairs
    of owners, which are compared. Any other pair can only be a link if
    7 * min(shared) >= 3 * (sum of sizes), where ``shared`` counts a node's
    shingles that more than RARE nodes have; so 4 * shared >= 3 * size for each.
    These bounds are exact; they leave out documents that only have a passage
    in common. The rest works by components: in each round up to HUBS nodes of
    a bucket, those that share most first, are compared with all its nodes of
    other components and then done with. A bucket is closed when one component
    holds all its nodes but OUTSIDE at most (SMALL in the first round), whose
    pairs with the others, as far as the bounds and bit maps allow a link, are
    then compared. A pair becomes one row, however many buckets its nodes share.
    So links to a text in the middle of a group cost a row for each member, and
    no pair that could join two components stays uncompared. Buckets that are
    still open after two rounds are dealt to finer ones, see ``_cells``. The
    fourth round is the last: what a finer bucket has left open is compared
    within its bucket of the second round, all nodes outside the largest
    component being hubs. The number of rounds does not grow with a bucket.
    """
    space = run.space
    own = entries.groupBy("name").agg(F.collect_list(F.struct("key", "chunk")).alias("entries"))
    inside = space.keep(
        own.join(nodes.select("name", "size"), "name").coalesce(tasks).withColumn("node", F.xxhash64("name")), "inside"
    )
    maps = texts.join(inside.select("name"), "name", "left_semi").mapInArrow(_bit_maps, "name binary, bits binary")
    maps = space.keep(maps.join(inside.select("name", "size"), "name").coalesce(tasks), "bit-maps")
    spread = space.keep(
        texts.join(inside.select("name", "node"), "name")
        .select("node", "text")
        .mapInArrow(_shingle_lists(4 * tasks), "part long, shingles binary, nodes binary")
        .groupBy("part")
        .applyInArrow(_rare_shingles, "x long, y long, n long"),
        "rare-shingles",
    )
    rare = spread.where("y is null").groupBy(F.col("x").alias("node")).agg(F.sum("n").alias("rare"))
    open_ = space.keep(
        inside.join(rare, "node", "left")
        .withColumn("shared", F.col("size") - F.coalesce(F.col("rare"), F.lit(0)))
        .where("4 * shared >= 3 * size")
        .select("name", "size", "shared", F.explode("entries").alias("entry"))
        .select("name", "size", "shared", "entry.key", "entry.chunk"),
        "open",
    )
    couples = spread.where("y is not null").select("x", "y").distinct()
    name_of = inside.select(F.col("node"), F.col("name"), F.col("size"))
    couples = (
        couples.join(name_of.toDF("x", "a", "size_a"), "x")
        .join(name_of.toDF("y", "b", "size_b"), "y")
        .where("a != b and 4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b)")
        .select("a", "b")
    )
    couples = space.keep(_pairs_near(couples, nodes), "couples")
    links = space.keep(links.unionByName(run.confirm(couples, texts)).distinct(), "links")
    whole = None
    for limit in (SMALL, OUTSIDE, OUTSIDE, None):
        if limit is None:
            open_ = space.keep(whole.join(open_.select("name").distinct(), "name", "left_semi").select(whole.columns), "open")
        labels = connected_components(links, space)
        state = open_.join(labels, open_["name"] == labels["node"], "left").select(
            *open_.columns, F.coalesce("component", "name").alias("part")
        )
        per_part = state.groupBy("key", "part").agg(F.count("*").alias("n"))
        main = per_part.groupBy("key").agg(
            F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("all_n")
        )
        state = space.keep(state.join(main.where("main_n < all_n"), "key").coalesce(tasks), "state")
        few = F.lit(True) if limit is None else F.col("all_n") - F.col("main_n") <= limit
        outside = state.where("part != main")
        best = _top(outside.where(~few))
        hubs = space.keep(outside.where(few).select(best.columns).unionByName(best).coalesce(tasks), "hubs")
        pairs = space.keep(_hub_pairs(state, hubs, maps).distinct().coalesce(4 * tasks), "hub-pairs")
        links = space.keep(links.unionByName(run.confirm(pairs, texts)).distinct().coalesce(tasks), "links")
        rest = state.where(~few).select(open_.columns).join(hubs.select("key", "name"), ["key", "name"], "left_anti")
        if limit == OUTSIDE and whole is None:
            whole = space.keep(rest.coalesce(tasks), "open")
            rest = _cells(whole, nodes)
        open_ = space.keep(rest.coalesce(tasks), "open")
        space.drop(state, pairs, hubs)
        if open_.isEmpty():
            break
    return links


def _top(outside: DataFrame) -> DataFrame:
    """Up to HUBS nodes of each bucket, the one that shares most among them."""
    order = F.struct("shared", "name", "size", "part")
    salted = outside.groupBy("key", F.pmod(F.xxhash64("name"), F.lit(HUBS)).alias("salt")).agg(F.max(order).alias("top"))
    return salted.select("key", "top.name", "top.size", "top.shared", "top.part")


def _hub_pairs(state: DataFrame, hubs: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b): each node with each hub of its buckets that is of another component and that the exact bounds leave open.

    A bucket's hubs and its nodes are dealt to blocks of about BLOCK each, and
    every cell of a block of either is compared by itself in one array
    operation, so no task gets a whole bucket and only what the bounds leave
    open becomes a row.
    """
    parts = lambda df, n: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    dealt = parts(hubs, "blocks").join(parts(state, "salts"), "key")
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(df: DataFrame, hub: bool) -> DataFrame:
        rows = df.select("key", "name", "size", "shared", "part").join(maps.select("name", "bits"), "name").join(dealt, "key")
        rows = rows.withColumn("block", own("blocks") if hub else each("blocks")).withColumn("salt", each("salts") if hub else own("salts"))
        return rows.select(F.xxhash64("key", "block", "salt").alias("cell"), "name", "size", "shared", "part", "bits", F.lit(hub).alias("hub"))

    return side(state, False).unionByName(side(hubs, True)).groupBy("cell").applyInArrow(_may_link, "a binary, b binary")


def _cells(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries of large buckets dealt to finer ones, by a second chunk.

    Signatures that agree in a chunk but for ERRORS slots and differ in RADIUS
    at most have RADIUS // (CHUNKS - 1) errors at most in some other chunk; all
    ways to leave out that many of its slots give the cells. A pair that no
    cell brings together lies beyond the radius.
    """
    return (
        open_.join(nodes.select("name", "sig"), "name")
        .select("name", "size", "shared", "key", "chunk", "sig")
        .mapInArrow(_second_chunks, "name binary, size long, shared long, key long, chunk int")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    component_id is the smallest id reachable over links (similarity of the
    5-word shingle sets of 0.75 or more), itself included; kept marks the row
    that stays of each component. A null, empty or blank text has no shingles,
    is linked with nothing and kept. Rows that repeat an id are one document. A
    row with a null id keeps a null component_id and is kept. An empty table
    gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = _Run(docs)
    space = run.space
    sketch = space.keep(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
            _sketch, f"doc_id {kind}, text_hash long, n_shingles long, name binary, sig binary"
        ),
        "sketch",
    )
    named = sketch.where("name is not null and doc_id is not null")
    nodes = space.keep(
        named.groupBy("name").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("owner"),
            F.min("sig").alias("sig"),
            F.min("n_shingles").alias("size"),
        ),
        "nodes",
    )
    entries = space.keep(nodes.select("name", "sig").mapInArrow(_keyed, "key long, name binary, chunk int"), "keys")
    counts = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = space.keep(entries.join(counts, "key"), "met")
    space.drop(entries)
    small = met.where(F.col("n") <= SMALL)
    pairs = (
        small.select("key", F.col("name").alias("a"))
        .join(small.select("key", F.col("name").alias("b")), "key")
        .where("a < b")
        .select("a", "b")
        .distinct()
    )
    pairs = space.keep(_pairs_near(pairs, nodes), "pairs")
    large = met.where(F.col("n") > SMALL).select("key", "name", "chunk")
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))
    texts = run.texts(nodes, ends.unionByName(large.select("name")).distinct())
    links = space.keep(run.confirm(pairs, texts), "links")
    n_large = large.count()
    if n_large:
        links = _resolve_large(run, large, nodes, texts, links, 2 + n_large // ROWS_A_TASK)
    labels = connected_components(links, space)
    label_of = nodes.join(labels, nodes["name"] == labels["node"], "left").select(
        "name", F.col("owner.doc_id").alias("owner"), F.coalesce("component", "name").alias("part")
    )
    least = label_of.groupBy("part").agg(F.min("owner").alias("least"))
    label_of = space.keep(label_of.join(least, "part").select("name", "least"), "components")
    return (
        sketch.join(label_of, "name", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
        .select(
            "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
        )
    )
