"""SimHash near-duplicates with pivot distance tables.

Fingerprints. The words of a text (A-Z lower-cased) give shingles of `shingle` words, repeats included; each is hashed by
XXH64 (seed 42) and a fingerprint bit is 1 if it is set in over half of the hashes. Wider fingerprints take further
64-bit words from the same hashes, mixed.

Links. Equal fingerprints are one class at once. Distinct fingerprints meet by keys, masked parts of the fingerprint:
for `distance` bits out of 64, split into blocks, so many whole blocks must agree that any linked pair shares a key (an
exact scheme); wide fingerprints take random parts (a pair is missed with the small probability stated at
`near_duplicates`, the same at every number of documents). Pairs that share a key are compared by a pivot table: the Hamming distances of each fingerprint to
`PIVOTS` reference fingerprints are computed once, pairs whose coordinates differ by more than `distance` anywhere are
discarded (triangle inequality), survivors are verified. Each bucket emits a star per local class, at most one row per
member, so groups of copies never become pairs; long buckets are linked through member references; the stars are joined to components by repeated contraction.
Near-duplicates take these links as candidates only: an edge counts once the two texts' shingle sets have been compared.

Skew. Buckets over `most` members are split into chunks and each pair of chunks is a task of its own; nothing is capped.

Defined cases. Null text has no words: fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is the shingle. Repeated rows get a row each. A null doc_id is never the smallest. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .graph import attach, components

SEED, PIVOTS = 42, 16
#: Members of a bucket that one task compares with each other.
MOST = 2048


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle in order, repeats included; none if there are no words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4, width: int = 1) -> bytes:
    """`width` big-endian 64-bit words."""
    return folded(shingles(text, shingle), width)


def folded(hashes: np.ndarray, width: int) -> bytes:
    if not len(hashes):
        return bytes(8 * width)
    out = b""
    for k in range(width):
        h = hashes if not k else mixed(hashes, k)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * bits > len(h)).tobytes()
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit value of each hash (splitmix64's finaliser on a shifted input)."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1) -> DataFrame:
    """doc_id, fp BINARY, node LONG (the fingerprint itself if 64 bits wide, else its hash)."""
    import pyarrow as pa

    rows = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp binary")
    return out.withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long") if width == 1 else F.xxhash64("fp"))


def block_masks(distance: int, n: int) -> list[bytes]:
    """Masks of 64-bit fingerprints such that any pair within `distance` agrees on one: the bits are split into
    `distance + c` blocks, of which c must agree; c grows with n so that random buckets stay short."""
    for keep in range(1, 5):
        blocks = distance + keep
        if keep * 64 // blocks >= np.log2(max(n, 2)) or keep == 4:
            break
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    sets = [range(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [_mask(itertools.chain(*chosen), 64) for chosen in itertools.combinations(sets, keep)]


def random_masks(width: int, bits: int, number: int) -> list[bytes]:
    rng = np.random.default_rng(SEED)
    return [_mask(rng.choice(64 * width, bits, replace=False), 64 * width) for _ in range(number)]


def _mask(chosen, bits: int) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[[int(x) for x in chosen]] = 1
    return np.packbits(flags).tobytes()


def _keyed(unique: DataFrame, masks: list[bytes], width: int) -> DataFrame:
    """node, fp, key: one row per mask; the key is a hash of the mask's number and the masked fingerprint."""
    import pyarrow as pa

    m = np.frombuffer(b"".join(masks), dtype=np.uint64).reshape(len(masks), width)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, width)
            key = np.zeros((len(x), len(m)), np.uint64) + np.arange(1, len(m) + 1, dtype=np.uint64)
            for k in range(width):
                key = mixed(key ^ (x[:, None, k] & m[None, :, k]), k + 1)
            at = np.repeat(np.arange(len(x)), len(m))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), b.column("node").take(pa.array(at)), b.column("fp").take(pa.array(at))], ["key", "node", "fp"]
            )

    return unique.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def crowd(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all rows of `x` within `distance`, for long buckets. Members serve as reference fingerprints
    in turn: each takes the free rows near it as its cluster and is linked to every row near it. Then only rows of two
    clusters that are still apart, both with more than their reference, can hold unseen links; these are compared if
    the references are within three distances. A tight group of m copies so costs m comparisons per reference."""
    owner, refs, left, right, rows = np.full(len(x), -1), [], [], [], []
    for p in range(len(x)):
        if owner[p] < 0:
            d = hamming(x, x[p])
            near = np.flatnonzero(d <= distance)
            left.append(np.full(len(near), p))
            right.append(near)
            owner[near[owner[near] < 0]] = len(refs)
            refs.append(p)
            rows.append(d)
    a, b = np.concatenate(left), np.concatenate(right)
    label = stars(len(x), a, b)
    size = np.bincount(owner, minlength=len(refs))
    many = np.flatnonzero(size > 1)
    at = np.array(refs)[many]
    for k, c in enumerate(many):
        close = hamming(x[at[k + 1 :]], x[refs[c]]) <= 3 * distance
        for e in many[k + 1 :][close & (label[at[k + 1 :]] != label[refs[c]])]:
            if label[refs[c]] == label[refs[e]]:
                continue
            u, v = np.flatnonzero(owner == c), np.flatnonzero(owner == e)
            for lo in range(0, len(u), 256):
                i, j = np.nonzero(hamming(x[u[lo : lo + 256], None], x[None, v]) <= distance)
                if len(i):
                    a, b = np.append(a, u[lo + i[0]]), np.append(b, v[j[0]])
                    low, high = sorted((label[refs[c]], label[refs[e]]))
                    label[label == high] = low
                    break
    return a, b


#: Buckets from this length on are linked through reference members.
LONG = 128


def compare(key: np.ndarray, x: np.ndarray, distance: int, pivots: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal, adjacent keys that connect all those within `distance`: pivot filter, then
    verification; long buckets by `crowd`."""
    dist = np.bitwise_count(x[:, None, :] ^ pivots[None]).sum(axis=2, dtype=np.int16)  # the distance table
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in np.flatnonzero(size >= long):
        a, b = crowd(x[edge[k] : edge[k + 1]], distance)
        left.append(a + edge[k])
        right.append(b + edge[k])
    idx, d = np.flatnonzero(np.repeat(size < long, size)), 0
    while True:
        d += 1
        idx = idx[idx + d < len(x)]
        idx = idx[key[idx] == key[idx + d]]
        if not len(idx):
            break
        near = idx
        for p in range(0, len(pivots), 4):
            near = near[(np.abs(dist[near, p : p + 4] - dist[near + d, p : p + 4]) <= distance).all(axis=1)]
        near = near[hamming(x[near], x[near + d]) <= distance]
        left.append(near)
        right.append(near + d)
    return np.concatenate(left), np.concatenate(right)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(unique: DataFrame, masks: list[bytes], distance: int, width: int, most: int = MOST) -> DataFrame:
    """Edges (u, v) between nodes, enough to connect all pairs within `distance` that share a key."""
    import pyarrow as pa

    keyed = _keyed(unique, masks, width)
    big = keyed.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    j = keyed.join(big, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    j = j.withColumn("own", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(0).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    j = j.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "fp")
    rng = np.random.default_rng(SEED + 1)
    pivots = rng.integers(0, 1 << 64, (PIVOTS, width), dtype=np.uint64)

    def run(batches):
        keys, nodes, fps = np.empty(0, np.int64), np.empty(0, np.int64), b""

        def flush(n):
            x = np.frombuffer(fps[: n * 8 * width], dtype=np.uint64).reshape(-1, width)
            a, b = compare(keys[:n], x, distance, pivots)
            use, inv = np.unique(np.concatenate([nodes[a], nodes[b]]), return_inverse=True)
            root = stars(len(use), inv[: len(a)], inv[len(a) :])
            far = root != np.arange(len(use))
            return pa.RecordBatch.from_arrays([pa.array(use[far]), pa.array(use[root[far]])], ["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            fps += b"".join(batch.column("fp").to_pylist())
            n = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if n >= 1 << 15:
                yield flush(n)
                keys, nodes, fps = keys[n:], nodes[n:], fps[n * 8 * width :]
        if len(keys):
            yield flush(len(keys))

    return j.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def classes(fps: DataFrame, masks: list[bytes], distance: int, width: int) -> DataFrame:
    """fps (doc_id, fp, node) to doc_id, fp, component_id: the smallest doc_id of the component."""
    unique = materialise(fps.groupBy("node", "fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(unique, masks, distance, width))
    named = unique.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    found = materialise(attach(named.withColumnRenamed("n", "copies"), "root", least).select("node", "component_id", F.col("copies").alias("n")))
    return attach(fps, "node", found).select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """64-bit fingerprints linked at `distance` bits or fewer, exactly: doc_id, fp, component_id."""
    fps = materialise(fingerprints(docs, shingle))
    n = fps.select("node").distinct().count()
    return classes(fps, block_masks(distance, n), distance, 1)


def recall(p: float, bits: int, distance: int, part: int, keys: int) -> float:
    """Share of pairs whose fingerprints of `bits` bits differ in each with probability `p` that share one of `keys`
    random parts of `part` bits and differ in `distance` bits or fewer."""
    found = 0.0
    for d in range(distance + 1):
        miss = (1 - math.comb(bits - d, part) / math.comb(bits, part)) ** keys
        found += math.comb(bits, d) * p**d * (1 - p) ** (bits - d) * (1 - miss)
    return found


#: Near-duplicates: share of the pairs just at the similarity that must be found, and log2 of a random bucket's length.
RECALL, FILL = 0.97, 6


def near_plan(n: int, similarity: float = 0.8, width: int = 4) -> tuple[int, int, int]:
    """Distance, bits of a part and number of parts for `n` fingerprints. Parts grow with log2(n) so that random buckets
    hold about 2^FILL members at every n, and as many are taken as `RECALL` at `similarity` needs."""
    p, bits = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 64 * width
    distance = int(bits * p + 3 * (bits * p * (1 - p)) ** 0.5)
    part, keys = max(8, int(np.log2(max(n, 2))) - FILL), 1
    while recall(p, bits, distance, part, keys) < RECALL:
        keys += 1
    return distance, part, keys


#: Members and bytes of text of a unit, the part of a group whose sets one task holds.
UNIT, UNIT_BYTES = 512, 1 << 24


def set_fingerprints(rows: DataFrame, shingle: int, width: int) -> DataFrame:
    """row, doc_id, text_key, fp (each shingle once), node LONG: rows with the same set of shingles share a node."""
    import pyarrow as pa
    import xxhash

    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("text_key"), "text")
    kept = ["row", "doc_id", "text_key"]

    def run(batches):
        for b in batches:
            found = [np.unique(shingles(t, shingle)) for t in b.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
            fps = pa.array([folded(h, width) for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), fps, pa.array(node)], [*kept, "fp", "node"])

    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp binary, node long")


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def checked(edges: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The `edges` (u, v) whose texts' sets of shingles overlap by `similarity` or more."""
    import pyarrow as pa

    both = edges.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def run(batches):
        last, held = None, set()  # a centre's rows come one after another
        for b in batches:
            keep = []
            for v, tu, tv in zip(*(b.column(c).to_pylist() for c in ("v", "tu", "tv")), strict=True):
                if v != last:
                    last, held = v, set(shingles(tv, shingle).tolist())
                keep.append(jaccard(set(shingles(tu, shingle).tolist()), held) >= similarity)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def united(near: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root, label: the smallest node that `edges` connect each node of `near` (node, root) to."""
    found = components(edges).withColumnRenamed("root", "label")
    return near.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def across(open_: DataFrame, distance: int, width: int, shingle: int, similarity: float, unit: int = UNIT) -> DataFrame:
    """Edges (u, v) that connect, within each root, all labels some pair of which lies within `distance` and overlaps by
    `similarity`. `open_` has node, root, label, fp, text. Labels of many members are cut into units of their own, the
    others of a root share units; each two units of a root but those of one label meet in a task."""
    import pyarrow as pa

    size = open_.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    parts = lambda n, b: F.greatest(F.ceil(n / unit), F.ceil(F.coalesce(b, F.lit(0)) / UNIT_BYTES), F.lit(1)).cast("int")
    size = size.withColumn("parts", parts(F.col("n"), F.col("b")))
    size = size.withColumn("whole", F.when(F.col("parts") > 1, F.col("label")))  # labels with units of their own
    owners = size.groupBy("root", "whole").agg(F.when(F.col("whole").isNull(), parts(F.sum("n"), F.sum("b"))).otherwise(F.max("parts")).alias("units"))
    size, owners = materialise(size.select("root", "label", "whole")), materialise(owners)
    units = owners.select("root", "whole", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("k")).withColumn("unit", F.xxhash64(F.coalesce("whole", F.lit(0)), F.col("whole").isNull(), "k"))
    a, b = (units.select("root", F.col("unit").alias(f"{x}u"), F.col("whole").alias(f"{x}w")) for x in "ab")
    meets = a.join(b, "root").where((F.col("au") <= F.col("bu")) & ~F.coalesce(F.col("aw") == F.col("bw"), F.lit(False)))
    meets = meets.withColumn("key", F.xxhash64("root", "au", "bu"))
    sides = meets.select("root", F.col("au").alias("unit"), "key", (F.col("au") != F.col("bu")).alias("two"))
    sides = sides.unionByName(meets.where("au <> bu").select("root", F.col("bu").alias("unit"), "key", F.lit(True).alias("two")))
    members = open_.join(size, ["root", "label"]).join(owners.select("root", F.col("whole").alias("w"), "units"), "root").where(F.col("whole").eqNullSafe(F.col("w")))
    members = members.withColumn("unit", F.xxhash64(F.coalesce("whole", F.lit(0)), F.col("whole").isNull(), F.pmod(F.xxhash64("node"), F.col("units")).cast("int")))
    j = members.join(sides, ["root", "unit"]).select("key", "unit", "two", "node", "label", "fp", "text")

    def group(rows):
        if len(rows) < 2:
            return
        x = np.frombuffer(b"".join(r["fp"] for r in rows), np.uint64).reshape(-1, width)
        side = np.array([r["unit"] for r in rows])
        names, label = np.unique(np.array([r["label"] for r in rows]), return_inverse=True)
        sets: dict[int, set] = {}
        parent = list(range(len(names)))

        def find(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        def of(k):
            if k not in sets:
                sets[k] = set(shingles(rows[k]["text"], shingle).tolist())
            return sets[k]

        pairs = []
        for k in range(len(rows) - 1):
            d = hamming(x[k + 1 :], x[k])
            near = np.flatnonzero((d <= distance) & (label[k + 1 :] != label[k]) & ((side[k + 1 :] != side[k]) | (not rows[k]["two"])))
            pairs.append(np.stack([d[near], np.full(len(near), k), near + k + 1], axis=1))
        pairs = np.concatenate(pairs)
        for _, k, m in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():  # the nearest first: they save the others
            r, q = find(label[k]), find(label[m])
            if r != q and jaccard(of(k), of(m)) >= similarity:
                parent[max(r, q)] = min(r, q)
                yield rows[k]["node"], rows[m]["node"]

    def run(batches):
        key, rows = None, []

        def flush():
            found = list(group(rows))
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for r in b.to_pylist():
                if r["key"] != key:
                    yield flush()
                    key, rows = r["key"], []
                rows.append(r)
        yield flush()

    return j.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_classes(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """rows (row long, unique and fixed; doc_id; text) to row, doc_id, text_key, fp, root: rows connected by pairs whose sets of
    `shingle`-word shingles overlap by `similarity` (Jaccard) or more share a root.

    At Jaccard J two bits differ with probability acos(2J / (1 + J)) / pi; pairs are candidates up to the mean plus three
    standard deviations at `similarity`. A pair at `similarity` is a candidate with probability `RECALL` whatever the
    number of documents, a closer one more often (`near_plan`). SimHash only groups the candidates: each member's star
    edge is checked on the texts, then, in groups that these do not connect, all candidates across what is still apart.
    """
    fps = materialise(set_fingerprints(rows, shingle, width))
    unique = materialise(fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min("row").alias("row")))
    distance, part, keys = near_plan(unique.count(), similarity, width)
    star = materialise(links(unique, random_masks(width, part, keys), distance, width).distinct())
    near = materialise(components(star))
    texts = materialise(near.join(unique, "node").join(rows.select("row", "text"), "row").select("node", "root", "fp", "text"))
    edges = materialise(checked(star.groupBy("u").agg(F.min("v").alias("v")), texts, shingle, similarity))
    named = materialise(united(near, edges))
    apart = named.groupBy("root").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("root")
    rest = across(texts.join(named.select("node", "label"), "node").join(apart, "root", "left_semi"), distance, width, shingle, similarity)
    roots = components(edges.unionByName(rest))
    return fps.join(roots, "node", "left").select("row", "doc_id", "text_key", "fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among the documents that `near_classes` connects."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = materialise(near_classes(rows, shingle, similarity, width))
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every document's fingerprint and component."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
