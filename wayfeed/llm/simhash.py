"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by BK-trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, components, local_roots, map_text, mixed, n_shuffle, stored

BLOCKS = ((0, 16), (16, 16), (32, 16), (48, 16))


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in more than half of the hashes of all word shingles, repeats included."""
    import xxhash

    digest, tokens = xxhash.xxh64_intdigest, text.lower().split()
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[words - 1 :].tolist() if len(tokens) >= words else [len(joined)]
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.dtype(">u8"), n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every whole text; A-Z are lower-cased, NULL is empty."""

    def step(rows, data, offsets):
        raw = data.tobytes()
        bits = [fingerprint(raw[a:b], words, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.array(bits, np.uint64).view(np.int64))], ["doc_id", "bits"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", "text"), step, f"doc_id {kind}, bits long")


class Tree:
    """BK-tree over integers: a child hangs under its parent by their Hamming distance."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int, radius: int) -> list[int]:
        """Add a node; the nodes within the radius that its way down passes."""
        near, at, k = [], 0, len(self.nodes)
        self.nodes.append(x)
        self.children.append({})
        while k:
            d = (x ^ self.nodes[at]).bit_count()
            if d <= radius:
                near.append(at)
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = k
                break
            at = below
        return near

    def within(self, x: int, radius: int) -> list[int]:
        """All nodes within the radius, following only edges whose distance is within the radius of x's own."""
        near, stack = [], [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = (x ^ self.nodes[at]).bit_count()
            if d <= radius:
                near.append(at)
            stack.extend(k for edge, k in self.children[at].items() if d - radius <= edge <= d + radius)
        return near


def group_links(values: list[int], radius: int) -> np.ndarray:
    """Root index of each value: values within the radius, directly or over others of the list, share one.

    Building the tree already links most of a dense group.  Any link still missing has an end outside the largest set,
    so only the values outside it search the tree.
    """
    tree, left, right = Tree(), [], []
    for k, x in enumerate(values):
        for at in tree.add(x, radius):
            left.append(k)
            right.append(at)
    root = local_roots(len(values), np.array(left, np.int64), np.array(right, np.int64))
    sizes = np.bincount(root, minlength=len(values))
    for k in np.flatnonzero(root != sizes.argmax()).tolist():
        for at in tree.within(values[k], radius):
            left.append(k)
            right.append(at)
    return local_roots(len(values), np.array(left, np.int64), np.array(right, np.int64))


def keyed(prints: DataFrame, radius: int, level: int) -> DataFrame:
    """Rows (bits, key) for each way to choose which block of bits, level by level, two linked values share.

    64 bits fall into radius + 1 blocks, and values within the radius agree in one of them whole; of the bits left the
    same holds again.  Each level takes one block more and so makes groups smaller by 2**(bits in the block).
    """

    def deeper(ranges, left):
        """All chains of blocks: ``ranges`` are the bit positions left."""
        if not left:
            return [()]
        size, chains = len(ranges), []
        for b in range(radius + 1):
            block = ranges[size * b // (radius + 1) : size * (b + 1) // (radius + 1)]
            rest = [x for x in ranges if x not in block]
            chains += [(block, *chain) for chain in deeper(rest, left - 1)]
        return chains

    ways = []
    for way, chain in enumerate(deeper(list(range(64)), level)):
        mask = sum(1 << x for block in chain for x in block)
        mask -= (1 << 64) if mask >> 63 else 0
        ways.append(F.struct(F.lit(way).alias("way"), F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("shared")))
    return prints.select("bits", F.explode(F.array(*ways)).alias("key"))


def near_links(prints: DataFrame, radius: int = 3, level: int = 2, most: int = 4096, last_level: int = 4) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``bits`` that connect all those within the radius, directly or over others.

    Shard trees: each group of fingerprints that agree in chosen blocks of bits is one BK-tree, built where the group
    lies.  Groups above ``most`` values are split by one block more, up to ``last_level``.  Each group gives one link
    for a value at most, never all its pairs.
    """
    spark = prints.sparkSession
    rows = keyed(prints, radius, level).select("bits", "key.way", "key.shared")
    sizes = rows.groupBy("way", "shared").agg(F.count("*").alias("n")).filter("n > 1")
    if level < last_level:
        large = sizes.filter(F.col("n") > most).select("way", "shared")
        rows = rows.join(sizes.filter(F.col("n") <= most).select("way", "shared"), ["way", "shared"], "left_semi")
    else:
        rows = rows.join(sizes.select("way", "shared"), ["way", "shared"], "left_semi")

    def run(batches):
        held_key, held = None, []

        def links():
            if len(held) < 2:
                return None
            root = group_links(held, radius)
            v = np.array(held, np.uint64).view(np.int64)
            k = np.flatnonzero(root != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(v[k]), pa.array(v[root[k]])], ["a", "b"]) if len(k) else None

        for batch in batches:
            for way, shared, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (way, shared) != held_key:
                    if out := links():
                        yield out
                    held_key, held = (way, shared), []
                held.append(bits % (1 << 64))
        if out := links():
            yield out

    dealt = rows.select("way", "shared", "bits").repartition(n_shuffle(spark), "way", "shared").sortWithinPartitions("way", "shared", "bits")
    found = dealt.mapInArrow(run, "a long, b long")
    if level < last_level and large.limit(1).count():
        inside = keyed(prints, radius, level).select("bits", "key.way", "key.shared").join(large, ["way", "shared"], "left_semi")
        found = found.union(near_links(inside.select("bits").distinct(), radius, level + 1, most, last_level))
    return found


def simhash_groups(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, bits, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every row.

    Equal fingerprints are one value throughout; texts without a word have fingerprint zero and link like any other.
    Rows with a NULL id have NULL as component unless a row with an id is in it.
    """
    held = stored(fingerprints(docs, words, seed), "simhash")
    values = held.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    groups = components(near_links(values.select("bits"), radius), "simhash-links")
    placed = values.join(groups.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    named = placed.join(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "component")
    named = named.select("bits", "component_id")
    return held.join(named, "bits").select("doc_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by five-word similarity

PRINT_VIEWS, KEY_VIEWS, N_KEYS, KEY_BITS = 8, 11, 32, 22  # 512 bits to compare; 704 bits make 32 keys
SHORT = 80  # up to so many shingles the smallest hashes of a text find its copies; majority bits of few hashes say little


def shingle_hashes(hashed: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the distinct shingles of hashed words; of the whole sequence when it is shorter."""
    n = max(1, len(hashed) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(hashed))):
        h = h * MULTIPLIER + hashed[k : k + n]
    return np.unique(mixed(h))


def wide_bits(h: np.ndarray, views: int) -> np.ndarray:
    """64 * views bits: each is set if it is set in more than half of the hashes, mixed anew for each view."""
    salts = mixed(np.arange(1, views + 1, dtype=np.uint64) * MULTIPLIER)
    ones = np.zeros(64 * views, np.int64)
    for k in range(0, len(h), 255):  # so many that a byte can count them
        block = mixed(h[k : k + 255, None] ^ salts[None, :])
        ones += np.unpackbits(block.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(h)


def wide_print(text: bytes, words: int = 5) -> tuple[bytes, np.ndarray]:
    """The 512-bit fingerprint of the distinct word shingles, and 32 keys made of the bits of word pairs.

    Word pairs change less than longer shingles when words are edited, so near copies agree in a key more often, while
    texts that share only their common words do not.
    """
    hashed = hashed_words(text)
    return print_and_keys(hashed, shingle_hashes(hashed, words))


def hashed_words(text: bytes) -> np.ndarray:
    import xxhash

    tokens = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def print_and_keys(hashed: np.ndarray, shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
    if not len(hashed):
        return bytes(8 * PRINT_VIEWS), np.zeros(N_KEYS, np.int32)
    keys = wide_bits(shingle_hashes(hashed, 2), KEY_VIEWS).reshape(N_KEYS, KEY_BITS)
    return np.packbits(wide_bits(shingles, PRINT_VIEWS)).tobytes(), keys @ (1 << np.arange(KEY_BITS, dtype=np.int32))


def prefix_size(n: int, similarity: float) -> int:
    """Of two sets of that Jaccard similarity, one of n members, so many smallest members of each share one at least."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def text_shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; one hash, zero, for a text without a word."""
    return shingle_hashes(hashed_words(text), words)


def wide_prints(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """For every row doc_id, h (hash of the text), node (hash of the shingle set), size (of the set), print (64 bytes),
    keys (32 ints), prefix (the smallest shingle hashes of a short text, else none); NULL is empty."""

    def step(rows, data, offsets):
        import xxhash

        raw = data.tobytes()
        hashed = [hashed_words(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        sets = [shingle_hashes(x, words) for x in hashed]
        made = [print_and_keys(x, y) for x, y in zip(hashed, sets)]
        keys = pa.array(np.concatenate([k for _, k in made]).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * N_KEYS), keys)
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        prefixes = [x[: prefix_size(len(x), similarity)].view(np.int64).tolist() if len(x) <= SHORT else [] for x in sets]
        columns = [rows.column(0), rows.column(2), pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([p for p, _ in made], pa.binary()), lists, pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "node", "size", "print", "keys", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return map_text(source, step, f"doc_id {kind}, h long, node long, size long, print binary, keys array<int>, prefix array<long>")


def wide_radius(similarity: float, margin: float = 1.0) -> int:
    """Bits of the fingerprint in which sets of that Jaccard similarity differ, and ``margin`` standard errors more."""
    bits, p = 64 * PRINT_VIEWS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + margin * math.sqrt(bits * p * (1 - p)))


def wide_links(values: DataFrame, radius: int, most: int = 4096, rounds: int = 3) -> DataFrame:
    """Links (a, b) of ids that connect all values (id, print, keys) within the radius that agree in a key.

    Each group of values that agree in a key is one BK-tree, built where the group lies; it gives one link for a value
    at most.  A group above ``most`` values first links values to a few of its own (``to_centres``) in ``rounds``
    rounds; what is not close to one is cut into parts of about ``most``, and each two parts are one tree, so any two
    of its values meet and no task holds more than two parts.  Values further apart than the radius, up to 1.5 times,
    may then link too: the components are those of all near pairs or larger ones, to be held against the sets.
    """
    spark = values.sparkSession

    def run(batches):
        held_group, ids, held = None, [], []

        def links():
            if len(held) < 2:
                return None
            root, v = group_links(held, radius), np.array(ids, np.int64)
            k = np.flatnonzero(root != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(v[k]), pa.array(v[root[k]])], ["a", "b"]) if len(k) else None

        for batch in batches:
            dealt_to = batch.column(0).to_numpy()
            paired = np.ones(len(dealt_to) + 1, bool)  # the groups of the first and last row may go on in other batches
            paired[1:-1] = dealt_to[1:] == dealt_to[:-1]
            batch = batch.take(pa.array(np.flatnonzero(paired[1:] | paired[:-1])))
            for group, one, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if group != held_group:
                    if out := links():
                        yield out
                    held_group, ids, held = group, [], []
                ids.append(one)
                held.append(int.from_bytes(bits, "big"))
        if out := links():
            yield out

    def trees(rows):
        return rows.repartition(n_shuffle(spark), "group").sortWithinPartitions("group", "id").mapInArrow(run, "a long, b long")

    dealt = values.select("id", "print", F.posexplode("keys").alias("way", "key")).select(F.xxhash64("way", "key").alias("group"), "id", "print")
    # Only the few large groups are looked up; a value alone in its group takes the same shuffle and is passed over.
    large = stored(dealt.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > most), "simhash-groups")
    if large.limit(1).count():
        hot, found = dealt.join(large.select("group"), "group", "left_semi"), None
        for k in range(rounds):
            placed = stored(to_centres(hot, radius, k), "simhash-centres")
            links = placed.select(F.col("id").alias("a"), F.explode("centres").alias("b")).filter("a <> b")
            found = links if found is None else found.union(links)
            hot = placed.filter("print is not null").select("group", "id", "print")
            sizes = stored(hot.groupBy("group").agg(F.count("*").alias("n")), "simhash-groups")
            if not sizes.filter(F.col("n") > most).limit(1).count():
                break
        rows = dealt.join(large.select("group"), "group", "left_anti").union(tiles(hot, sizes, most))
        return trees(rows).union(found)
    return trees(dealt)


def to_centres(rows: DataFrame, radius: int, turn: int, n: int = 8) -> DataFrame:
    """Rows (group, id, print, centres): ids of up to ``n`` values of the group, one for each set of linked centres.

    Within half the radius of a centre (``tight``) a value needs no other link, and its print is NULL: whatever is
    within the radius of it is within radius + tight of that centre, and so links to the centre itself.
    """
    tight = radius // 2
    drawn = rows.groupBy("group", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(n)).alias("salt"))
    drawn = drawn.agg(F.min(F.struct(F.xxhash64("id", F.lit(turn + 1000)).alias("at"), "id", "print")).alias("c"))
    drawn = drawn.groupBy("group").agg(F.collect_list(F.struct("c.id", "c.print")).alias("drawn"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, ids, prints, drawn = batch.columns
            own = np.frombuffer(b"".join(prints.to_pylist()), np.uint64).reshape(-1, PRINT_VIEWS)
            centres, tight_to = [None] * len(own), np.zeros(len(own), bool)
            _, first, which = np.unique(groups.to_numpy(), return_index=True, return_inverse=True)
            order = np.argsort(which, kind="stable")
            for at, rows in zip(first.tolist(), np.split(order, np.cumsum(np.bincount(which))[:-1])):
                held = sorted((c["id"], c["print"]) for c in drawn[at].as_py())
                c = np.frombuffer(b"".join(x for _, x in held), np.uint64).reshape(-1, PRINT_VIEWS)
                apart = lambda x, c=c: np.bitwise_count(x[:, None] ^ c[None]).sum(axis=2, dtype=np.int64)
                root = local_roots(len(c), *np.nonzero(apart(c) <= radius + tight))
                far = apart(own[rows])
                tight_to[rows] = far.min(axis=1) <= tight
                for k, near in zip(rows.tolist(), far <= radius + tight):
                    centres[k] = [held[j][0] for j in np.unique(root[near]).tolist()]
            left = pa.array([None if t else p for t, p in zip(tight_to.tolist(), prints.to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([groups, ids, left, pa.array(centres, pa.list_(pa.int64()))], ["group", "id", "print", "centres"])

    return rows.join(drawn, "group").select("group", "id", "print", "drawn").mapInArrow(run, "group long, id long, print binary, centres array<long>")


def tiles(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Rows (group, id, print) of groups of n rows dealt so that any two of a group meet in one of about 2 * most."""
    parts = F.ceil(F.col("n") / most).cast("int")
    rows = rows.join(sizes.withColumn("parts", parts).select("group", "parts"), "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))).otherwise(F.array(F.lit(0)))
    rows = rows.select("group", "id", "print", "part", F.explode(other).alias("other"))
    return rows.select(F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")).alias("group"), "id", "print")


def like(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two arrays of distinct members have that Jaccard similarity at least."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def true_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the links (a, b) whose sets (node, members) have that Jaccard similarity."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            keep = [like(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"of_{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def set_links(nodes: list[int], parts: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between nodes of different parts whose sets have that similarity; each node has one to a part at most."""
    n = np.array([len(x) for x in sets], np.int64)
    _, part = np.unique(np.array(parts, np.int64), return_inverse=True)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(member, kind="stable")
    owner, first = np.repeat(np.arange(len(n)), n)[order], np.concatenate([[0], np.cumsum(np.bincount(member))])
    ends, links = np.cumsum(n), []
    for k in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
        own = member[ends[k] - n[k] : ends[k]]
        many = first[own + 1] - first[own]
        place = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(owner[place], minlength=len(n))
        fit = np.flatnonzero((both >= similarity * (n + n[k] - both) - 1e-9) & (part != part[k]))
        links += [(nodes[k], nodes[fit[j]]) for j in np.unique(part[fit], return_index=True)[1].tolist()]
    return links


def open_links(sets: DataFrame, parts: DataFrame, similarity: float, budget: int = 1_000_000) -> DataFrame:
    """Links (a, b) of that similarity that connect the parts of each component; sets has node, component, members, size.

    ``parts`` (node, component) are what true links connect already.  Each set outside the largest part of its component
    meets every other set of the component in a group of about two times ``budget`` members; sets of one part need not.
    """
    spark = sets.sparkSession
    named = sets.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = stored(named, "simhash-parts")
    weights = named.groupBy("component", "part").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    whole = weights.groupBy("component").agg(F.count("*").alias("many"), F.max(F.struct("n", "part", "weight")).alias("main"), F.sum("weight").alias("weight"))
    cut = lambda w: F.greatest(F.ceil(w / budget), F.lit(1)).cast("int")
    whole = whole.filter("many > 1").select("component", F.col("main.part").alias("main"), cut(F.col("main.weight")).alias("n_main"), cut(F.col("weight") - F.col("main.weight")).alias("n_rest"))
    rows = named.join(whole, "component").withColumn("is_main", F.col("part") == F.col("main"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    rest, main = F.sequence(F.lit(0), F.col("n_rest") - 1), F.sequence(F.lit(0), F.col("n_main") - 1)
    met_by_main = F.transform(rest, lambda j: F.struct(j.alias("lo"), (F.col("n_rest") + F.col("at")).alias("hi")))
    met_by_rest = F.concat(
        F.transform(main, lambda j: F.struct(F.col("at").alias("lo"), (F.col("n_rest") + j).alias("hi"))),
        F.transform(F.filter(rest, lambda j: j != F.col("at")), lambda j: F.struct(F.least(F.col("at"), j).alias("lo"), F.greatest(F.col("at"), j).alias("hi"))),
    )
    rows = rows.select("node", "part", "members", "component", F.explode(F.when(F.col("is_main"), met_by_main).otherwise(met_by_rest)).alias("t"))
    rows = rows.select(F.xxhash64("component", "t.lo", "t.hi").alias("tile"), "node", "part", "members")

    def run(batches):
        tile, nodes, own, held = None, [], [], []

        def links():
            found = set_links(nodes, own, held, similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for t, node, part, members in zip(*(c.to_pylist() for c in batch.columns)):
                if t != tile:
                    yield links()
                    tile, nodes, own, held = t, [], [], []
                nodes.append(node)
                own.append(part)
                held.append(np.frombuffer(members, np.uint64))
        yield links()

    return rows.repartition(n_shuffle(spark), "tile").sortWithinPartitions("tile", "node").mapInArrow(run, "a long, b long")


def near_rows(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, h (xxhash64 of the text), component (a number for each group of near copies) of every row with an id.

    Candidates are texts whose 512-bit fingerprints differ as those of texts of that Jaccard similarity do, three
    standard errors allowed, and that agree in one of 32 keys; short texts are candidates if they share one of their
    smallest shingle hashes, which no two texts of that similarity miss.  Only pairs whose sets of shingles have the
    similarity link: first the candidates, then all sets of a component of candidates that are not connected by that.
    """
    held = stored(wide_prints(docs.filter("doc_id is not null"), words, similarity), "simhash-wide")
    values = held.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.min("size").alias("size"), F.min("print").alias("print"), F.min("keys").alias("keys"), F.min("prefix").alias("prefix"))
    values = stored(values, "simhash-values")
    short = values.select("node", F.explode("prefix").alias("member"))
    lowest = short.groupBy("member").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    pairs = wide_links(values.select(F.col("node").alias("id"), "print", "keys"), wide_radius(similarity, 3.0)).union(short.join(lowest, "member").select(F.col("node").alias("a"), "b"))
    pairs = stored(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    rough = stored(components(pairs, "simhash-rough"), "simhash-components")

    def step(rows, data, offsets):
        raw = data.tobytes()
        made = [text_shingles(raw[a:b], words).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), pa.array(made, pa.binary())], ["node", "component", "size", "members"])

    want = rough.join(values.select("node", "row.doc_id", "row.h", "size"), "node")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(want, ["doc_id", "h"]).select("node", "component", "text", "size")
    sets = map_text(texts, step, "node long, component long, size long, members binary")
    sets = stored(sets.dropDuplicates(["node"]), "simhash-sets")
    links = stored(true_links(pairs, sets, similarity), "simhash-true")
    links = links.union(open_links(sets, components(links, "simhash-parts"), similarity))
    named = values.join(components(links, "simhash-near"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return held.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", "component")


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over links) of every id: near copies by shingles of words.

    See ``near_rows``.  Texts without a word are copies of each other.  Rows with the same id are one document; rows
    with a NULL id are left out.
    """
    rows = near_rows(docs, similarity, words)
    named = rows.join(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
    return named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
