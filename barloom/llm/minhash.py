"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1.  One pass over the texts gives every document its set's size, a digest of its
    words and the band keys of a SuperMinHash signature.
2.  Documents with equal words form a class; only classes go on, so copies cost
    nothing more.
3.  In every bucket of a band each class is paired with the smallest and the
    largest class (two aggregates; never all pairs of a bucket).  Pairs are
    verified as stars: the text of a hub is sent once for every STAR members.
    Links are grouped by union-find.
4.  Buckets whose classes then lie in different groups are searched in full.
    Such a bucket is cut into blocks of bounded size, and blocks of one and the
    same group are not compared.  A task gets two blocks, counts all
    intersections as products of incidence matrices, and gives out a forest of
    the links it finds: fewer links than classes, whatever the number of pairs.

Hashes only deal documents out.  Whatever is linked is compared by its words:
numbers of words and shingles are made from the bytes of the texts at hand.
Classes are named by a digest of 128 bits (BLAKE2).

With 32 bands of 4 rows a pair with similarity 0.8 shares no bucket with a
probability below 5e-8.  Step 4 compares classes that share a bucket but no
group, and there is no way around it: a family of texts just below the
threshold costs its square in comparisons (though not in rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, GOLDEN, NON_BLANK, Spans, digest_of, flat, gram_hashes, gram_starts, grams_of, mix, pieces
from .shared import discard, keep

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Members of a star that are verified in one place, about.
STAR = 1024
#: Size of a block: bytes of text, and how many of them a class counts at least.
BLOCK, LEAST = 1 << 20, 2048
#: Keys with more than one row in HOT are hot; there are fewer than HOT of them.
HOT = 2000
PIECE = 1 << 20


def shingles(column: pa.Array, size: int) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of every shingle its first word, its number of words and its text.

    A text with fewer words than size is one shingle; one without words has none.
    """
    data, offsets = flat(column)
    words = Spans(FOLD[data], offsets, NON_BLANK)
    starts = gram_starts(words.bounds, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    starts = np.concatenate((starts, words.bounds[short]))
    sizes = np.concatenate((np.full(len(starts) - len(short), size), words.counts[short]))
    return words, starts, sizes, words.doc[starts] if len(starts) else starts


def distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of n texts end to end, and offsets."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.searchsorted(doc[fresh], np.arange(n + 1))


def hashed_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, the same everywhere, and offsets."""
    words, starts, sizes, doc = shingles(column, size)
    hashes = words.hashes()
    out = np.zeros(len(starts), dtype=np.uint64)
    for n in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == n)
        out[some] = gram_hashes(hashes, n)[starts[some]]
    return distinct(doc, out, len(column))


def exact_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's distinct shingles, equal exactly if the words are, and offsets; they hold among these texts only."""
    words, starts, sizes, doc = shingles(column, size)
    return distinct(doc, grams_of(words.exact()[0], starts, sizes), len(column))


def similar(column: pa.Array, a: np.ndarray, b: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Whether the sets of texts a[i] and b[i] are similar enough, by their words."""
    number, bounds = exact_sets(column, size)
    n = np.diff(bounds)
    width = int(number.max(initial=0)) + 1
    have = np.append(np.repeat(np.arange(len(n)), n) * width + number, -1)
    many = n[b]
    at = np.arange(int(many.sum())) + np.repeat(bounds[b] - (np.cumsum(many) - many), many)
    key = np.repeat(a * width, many) + number[at]
    found = have[np.searchsorted(have[:-1], key)] == key
    both = np.bincount(np.repeat(np.arange(len(a)), many), found, len(a))
    return (both > 0) & (100 * both >= percent * (n[a] + n[b] - both))


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row per set; rank in the high and fraction in the low 32 bits.

    Every element deals the ranks 0, 1, 2... to slots by a permutation of its
    own, made one swap a step.  All elements take step j together; a set all of
    whose slots are filled has only smaller values than step j + 1 can give, so
    it stops there.
    """
    sets = len(bounds) - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * slots, full, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    h, dealt = elements, None
    for j in range(slots):
        if not len(h):
            break
        x = mix(h + np.uint64((j + 1) * int(GOLDEN) % (1 << 64)))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if dealt is None:
            slot = k
        else:
            row = np.arange(len(h))
            slot = dealt[row, k].astype(np.int64)
            dealt[row, k] = dealt[:, j]
        np.minimum.at(out, owner * slots + slot, (x >> np.uint64(32)) | np.uint64(j << 32))
        open_sets = (out.reshape(sets, slots) == full).any(axis=1)
        left = open_sets[owner]
        if dealt is None:
            h, owner, k = h[left], owner[left], k[left]
            dealt = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(h), 1))
            dealt[np.arange(len(h)), k] = 0
        elif not left.all():
            h, owner, dealt = h[left], owner[left], dealt[left]
    return out.reshape(sets, slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    mixed = mix(signatures).reshape(len(signatures), BANDS, ROWS)
    total = np.zeros((len(signatures), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        total = mix(total * GOLDEN + mixed[:, :, r])
    return mix(total + np.arange(BANDS, dtype=np.uint64) * GOLDEN)


def key_array(signatures: np.ndarray) -> pa.Array:
    keys = band_keys(signatures).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Set size, text size, digest of the words, and band keys of each row."""
    for batch in pieces(batches, "text", PIECE):
        column = batch.column("text")
        elements, bounds = hashed_sets(column, size)
        n = np.diff(exact_sets(column, size)[1])
        digests = np.frombuffer(b"".join(digest_of(b" ".join((t or b"").lower().split())) for t in column.cast(pa.binary()).to_pylist()), dtype=np.int64).reshape(-1, 2)
        bytes_of = np.diff(flat(column)[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(bytes_of.astype(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), key_array(superminhash(elements, bounds))],
            ["doc_id", "n_shingles", "bytes", "k1", "k2", "keys"],
        )


def _star(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between hubs and members, of rows (hub, salt, other, text) sorted by the first three; a hub's own row has no other."""
    held = None
    for piece in pieces(batches, "text", PIECE):
        rows = piece if held is None else pa.concat_batches([held, piece])
        hub, salt, other = (np.array(rows.column(c).fill_null(0)) for c in ("hub", "salt", "other"))
        own = np.array(rows.column("other").is_null())
        group = np.cumsum(np.concatenate(([0], (hub[1:] != hub[:-1]) | (salt[1:] != salt[:-1]))))
        hubs, members = np.flatnonzero(own), np.flatnonzero(~own)
        low, high = (np.searchsorted(group[hubs], group[members], side=x) for x in ("left", "right"))
        many = high - low
        a = hubs[np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)]
        b = np.repeat(members, many)
        good = similar(rows.column("text"), a, b, size, percent)
        x, y = hub[a[good]], other[b[good]]
        yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})
        held = rows.take(pa.array(hubs[group[hubs] == group[-1]]))


def stars(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (hub, other, n: rows of the bucket) those whose texts' sets are similar enough, as (a, b)."""
    dealt = pairs.select("hub", F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / F.lit(STAR))).cast("int").alias("salt"), "other")
    members = dealt.join(texts, dealt["other"] == texts["doc_id"]).select("hub", "salt", "other", "text")
    hubs = dealt.select("hub", "salt").distinct().join(texts, F.col("hub") == texts["doc_id"]).select("hub", "salt", F.lit(None).cast("long").alias("other"), "text")
    rows = hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("other").asc_nulls_first())
    return rows.mapInArrow(lambda batches: _star(batches, size, percent), "a long, b long")


def intersections(number: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many numbers the sets left[i] and right[j] share, as products of incidence matrices."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    _, code, count = np.unique(number, return_inverse=True, return_counts=True)
    # only what two sets hold can be shared
    column = np.full(len(count), -1, dtype=np.int64)
    column[count > 1] = np.arange(int((count > 1).sum()))
    col = column[code]
    doc, col = doc[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int((count > 1).sum()), columns):
        a, b = np.searchsorted(col, (at, at + columns))
        x = np.zeros((len(n), columns), dtype=np.float32)
        x[doc[a:b], col[a:b] - at] = 1
        out += x[left] @ x[right].T
    return out


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join the same groups as the links (a, b), one fewer than the nodes of each group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    links = [(r, x) for x in list(parent) if (r := root(x)) != x]
    return [r for r, _ in links], [x for _, x in links]


def _across(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links across groups, of rows (key, low, high, side, node, part, text) sorted by bucket and two blocks; all sides are 0 in a block by itself."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        node, part, side = (np.array(rows.column(c)) for c in ("node", "part", "side"))
        number, bounds = exact_sets(rows.column("text").combine_chunks(), size)
        n = np.diff(bounds)
        alone = not side.any()
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        both = intersections(number, bounds, left, right)
        good = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (part[left][:, None] != part[right][None, :])
        i, j = np.nonzero(np.triu(good, 1) if alone else good)
        a, b = forest_of(node[left[i]], node[right[j]])
        return pa.RecordBatch.from_pydict({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    held, now = [], None
    for batch in batches:
        names = np.stack([np.array(batch.column(c)) for c in ("key", "low", "high")], axis=1)
        edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and names[a].tolist() != now:
                yield links(pa.Table.from_batches(held))
                held = []
            now = names[a].tolist()
            held.append(batch.slice(a, b - a))
    if held:
        yield links(pa.Table.from_batches(held))


def across(placed: DataFrame, texts: DataFrame, total: int, size: int, percent: int) -> DataFrame:
    """Links between classes of different groups that share a bucket; placed has (key, node, part, weight), total rows at most."""
    parts = placed.groupBy("key", "part").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    blocks = F.ceil(F.col("weight") / F.lit(BLOCK)).cast("int")
    # group 0 has the parts that fill no block of their own; each of the others has one part
    layout = parts.groupBy("key").agg(
        F.count("*").alias("parts"),
        F.sum("n").alias("n"),
        F.ceil(F.coalesce(F.sum(F.when(blocks <= 1, F.col("weight"))), F.lit(0)) / F.lit(BLOCK)).cast("int").alias("small"),
        F.collect_list(F.when(blocks > 1, F.struct("part", blocks.alias("blocks")))).alias("large"),
    )
    # a block is named by its group, and its number there in the low 32 bits
    counts = F.concat(F.array("small"), F.col("large.blocks"))
    listed = F.flatten(F.transform(counts, lambda n, g: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(g.cast("long"), 32) + i)).otherwise(F.array().cast("array<bigint>"))))
    layout = keep(layout.where("parts > 1").select("key", "n", "small", "large", listed.alias("all")), "layout")
    group = F.array_position(F.col("large.part"), F.col("part"))
    dealt = join_by_size(placed, layout, ["key"], total).withColumn("group", group)
    count = F.when(F.col("group") == 0, F.col("small")).otherwise(F.element_at("large.blocks", F.greatest(F.col("group").cast("int"), F.lit(1))))
    own = F.shiftleft("group", 32) + F.pmod(F.xxhash64("node"), count)
    others = F.filter("all", lambda x: (F.shiftright(x, 32) != F.col("group")) | (F.col("group") == 0))
    dealt = dealt.select("key", "node", "part", own.alias("own"), F.explode(others).alias("other"))
    task = ["key", "low", "high"]
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "part")
    rows = dealt.join(texts, dealt["node"] == texts["doc_id"]).select(*task, "side", "node", "part", "text").repartition(*task).sortWithinPartitions(*task)
    found = keep(rows.mapInArrow(lambda batches: _across(batches, size, percent), "a long, b long").distinct(), "across")
    discard(layout)
    return found


def join_by_size(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with per_key, which has one row for each key, with the number of its rows in n; total is that of all rows.

    A key of more than total / HOT rows is hot.  There are fewer than HOT hot
    keys, so they are broadcast and their rows stay where they are; all others
    are shuffled by key.  rows and per_key are read twice.
    """
    most = total / HOT
    hot = per_key.where(F.col("n") > most)
    cold = per_key.where(F.col("n") <= most)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task: one link from each node to the smallest of its group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def links() -> pa.RecordBatch:
        out = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in out], type=pa.int64()), "v": pa.array([r for _, r in out], type=pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:  # a task's memory stays bounded; later rounds join the parts
            yield links()
    yield links()


def components(links: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its group, and the smallest.

    Links are first contracted by union-find within tasks, then by alternating
    large-star and small-star rounds until nothing changes.  Every round is
    written to the shared folder, and the one before deleted.
    """
    edges = keep(links.mapInArrow(_forest, "u long, v long").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link of `large` goes from a node down to a smaller one
        down = large.where(F.col("u") != F.col("v"))
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, keep(small.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return edges
        state = tuple(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of shingles of `shingle` words (A-Z lower-cased).  component_id is the
    smallest id that is reachable over links, and kept says that it is the
    row's own.  Texts without words, and null texts, are linked with nothing.
    Rows that share an id count as one document in their links.  Rows with a
    null id are linked with nothing, have no component and are kept.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = keep(texts.mapInArrow(lambda batches: _sketch(batches, shingle), "doc_id long, n_shingles long, bytes long, k1 long, k2 long, keys array<long>"), "sketches")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["k1", "k2"]
    first = F.min(F.struct("doc_id", "bytes", "keys"))
    classes = keep(named.groupBy(*key).agg(first.alias("first"), F.count("*").alias("n")).select(*key, "n", F.col("first.doc_id").alias("node"), F.col("first.bytes").alias("bytes"), "first.keys"), "classes")

    # stars within buckets
    buckets = classes.select(F.explode("keys").alias("key"), "node", F.greatest("bytes", F.lit(LEAST)).alias("weight"))
    ends = keep(buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where(F.col("low") < F.col("high")), "ends")
    total = classes.count()
    shared = keep(join_by_size(buckets, ends, ["key"], total * BANDS), "buckets")
    members = shared.select(F.col("node").alias("doc_id")).distinct()
    near_texts = keep(texts.where(F.col("text").isNotNull()).join(members, "doc_id").dropDuplicates(["doc_id", "text"]), "texts")
    pairs = shared.select(F.col("low").alias("hub"), F.col("node").alias("other"), "n").union(shared.where(F.col("node") > F.col("low")).select(F.col("high").alias("hub"), F.col("node").alias("other"), "n"))
    pairs = pairs.where(F.col("hub") != F.col("other")).groupBy("hub", "other").agg(F.max("n").alias("n"))
    links = keep(stars(pairs, near_texts, shingle, percent), "verified")
    groups = components(links)

    # buckets across groups
    grouped = groups.select(F.col("u").alias("node"), "v")
    parts = keep(shared.select("key", "node", "weight").join(grouped, "node", "left").select("key", "node", F.coalesce("v", "node").alias("part"), "weight"), "parts")
    mixed = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where(F.col("low") < F.col("high")).select("key", "n")
    placed = keep(join_by_size(parts, mixed, ["key"], total * BANDS).drop("n"), "mixed")
    more = across(placed, near_texts, total * BANDS, shingle, percent)
    final = groups if more.isEmpty() else components(groups.toDF("a", "b").union(more))
    labelled = classes.select(*key, "n", "node").join(final.withColumnRenamed("u", "node"), "node", "left").select(*key, "n", F.coalesce("v", "node").alias("component_id"))
    labelled = keep(labelled, "labelled")
    for table in (ends, shared, near_texts, links, parts, placed, more, classes):
        discard(table)

    found = join_by_size(named.select("doc_id", "n_shingles", *key), labelled, key, rows.count())
    found = found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0))
    return found.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
