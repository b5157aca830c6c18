"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

Documents become sets of word shingles. Equal sets form a class, of which one member goes on. Each element of a set
ranks the slots of the signature by its own random permutation and puts rank + fraction into them; a slot keeps
the least value. As ranks only grow, filling stops as soon as every slot has a value from an earlier rank. Bands of
the signature are buckets. Members of a bucket first meet its leader, links are confirmed on the full sets, and linked
members become one component, so a bucket of thousands of copies costs one comparison each. Only where a bucket
still holds members of different components, they meet each other: in buckets of at most SMALL members as pairs of different
components; in larger ones those outside the main component meet all others in blocks, which hold a bounded number of
rows and elements a side and emit at most one link for each two components that they join. Both ways find the same
components, and no link that shares a bucket is lost.

The chance that a pair of similarity s shares no bucket is (1 - s^rows)^bands, 5e-8 at 0.8 with the defaults.

Defined results: words are separated by U+0020 and U+0009 to U+000D, A-Z lower-cased; fewer words than the width
form one shingle; a text without words has the empty set, is linked with nothing and keeps its own id; rows with a
null id keep a null component and are linked with nothing; rows that repeat an id share its component, with one text or
several; a very long text is one set like any other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, give_back, join_groups, map_batches, maybe_filter, mix64, select_maybe, stored, windows, without, word_hashes

BANDS, ROWS = 32, 4
#: Elements whose permutations are held at a time; members of a small bucket.
CHUNK, SMALL = 40_000, 16
#: Elements of the sets that a task holds at a time.
SETS = 500_000
#: A side of a block of comparisons holds about so many members, and so many elements or one larger set.
BLOCK, BLOCK_ELEMENTS = 100, 400_000


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """Signatures of n_sets sets, given as distinct 64-bit elements and the set of each."""
    sig = np.full(n_sets * slots, np.inf)
    ranks = None
    for j in range(slots):
        draw = mix64(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = j + (draw >> np.uint64(12)).astype(np.float64) * 2.0**-52
        pick = j + (mix64(draw) % np.uint64(slots - j)).astype(np.int64)
        if ranks is None:
            slot = pick
        else:  # the next step of each element's own shuffle
            rows = np.arange(len(elements))
            slot = ranks[rows, pick].astype(np.int64)
            ranks[rows, pick] = ranks[:, j]
        np.minimum.at(sig, owner * slots + slot, value)
        # Later ranks give larger values, so a full signature is final.
        open_ = np.isinf(sig.reshape(n_sets, slots)).any(1)[owner]
        if not open_.any():
            break
        if ranks is None:
            ranks = np.tile(np.arange(slots, dtype=np.int16), (int(open_.sum()), 1))
            first, rows = pick[open_], np.arange(int(open_.sum()))
            ranks[rows, first] = 0
        else:
            ranks = ranks[open_]
        elements, owner = elements[open_], owner[open_]
    return sig.reshape(n_sets, slots)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(windows(word_hashes(text, lower=True), width))


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) ^ bits[:, :, k])
    return acc.view(np.int64)


def described(docs: DataFrame, width: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), lo and hi (a 128-bit hash of the set), bands."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, at = batch.column(1), 0
        while at < len(texts):
            begin, sets, total = at, [], 0
            while at < len(texts) and (total < CHUNK or at == begin):
                sets.append(shingle_set(texts[at].as_py(), width))
                total += len(sets[-1])
                at += 1
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if total else np.zeros(0, np.uint64)
            full = np.flatnonzero(sizes)
            owner = np.repeat(np.arange(len(full)), sizes[full])
            lo, hi = (np.array([int(mix64(s ^ np.uint64(c)).sum()) for s in sets], np.uint64).view(np.int64) for c in (0, 0x5851F42D4C957F2D))
            made = _bands(super_minhash(flat, owner, len(full), bands * rows), bands, rows) if total else np.zeros((0, bands), np.int64)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, at - begin), pa.array(sizes.astype(np.int64)), pa.array(lo), pa.array(hi), pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()))],
                ["id", "n", "lo", "hi", "bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, f"id {kind}, n long, lo long, hi long, bands array<long>")


def _sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, at = batch.column(1), 0
        while at < len(texts):
            begin, sets, total = at, [], 0
            while at < len(texts) and (total < SETS or at == begin):
                sets.append(shingle_set(texts[at].as_py(), width))
                total += len(sets[-1])
                at += 1
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            elements = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), elements], ["id", "elements"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, f"id {kind}, elements array<long>")


class _Roots:
    """Union-find; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def of(self, x):  # noqa: ANN001, ANN201
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a, b) -> bool:  # noqa: ANN001
        """Whether a and b were apart."""
        a, b = self.of(a), self.of(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _contracted(edges: DataFrame) -> DataFrame:
    """Union-find over the edges of each partition: at most one edge from each node, to its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, kind = _Roots(), None
        for batch in batches:
            kind = batch.schema.field("u").type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                roots.join(a, b)
        if kind is not None:
            joined = [(x, r) for x in list(roots.parent) if (r := roots.of(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in joined], kind) for i in (0, 1)], ["u", "v"])
        del roots
        give_back()

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for the nodes of the edges u, v."""
    star = stored(_contracted(edges.where("u <> v").select("u", "v")).distinct(), "near-forest")
    before = None
    while True:
        sign = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = sign
        # Large stars, then small stars. A hub may have any number of neighbours, so its rows aren't gathered by key.
        both = star.union(star.select("v", "u"))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k"), "near-low")
        large = join_groups(both, low, ["u"], "k", prune=False).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "near-large-stars")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "near-low")
        small = join_groups(large, low, ["u"], "k", prune=False).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "near-stars")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all x with all y, by a product of incidence matrices."""
    if len(x) * len(y) <= 16:
        return np.array([[len(np.intersect1d(p, q, assume_unique=True)) for q in y] for p in x])
    every = np.concatenate([*x, *y])
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    ends = np.cumsum([len(s) for s in (*x, *y)])
    rows = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    rows, at = rows[shared[at]], column[at[shared[at]]]
    out = np.zeros((len(x), len(y)), np.int64)
    width = int(shared.sum())
    for begin in range(0, width, 4096):  # a slice of the elements at a time
        part = (at >= begin) & (at < begin + 4096)
        m = np.zeros((len(ends), min(4096, width - begin)), np.float32)
        m[rows[part], at[part] - begin] = 1
        out += np.rint(m[: len(x)] @ m[len(x) :].T).astype(np.int64)
    return out


def _block_links(percent: int):  # noqa: ANN202
    """Links between different components in each block, rows of one side (x) against those of the other: as many as join
    what all links of the block join."""

    def run(table: pa.Table) -> pa.Table:
        blocks: dict = {}
        for r in zip(*(table[c].to_pylist() for c in ("block", "is_x", "rep", "component")), range(len(table)), strict=True):
            blocks.setdefault(r[0], ([], []))[0 if r[1] else 1].append(r[2:])
        sets = table["elements"].combine_chunks()
        flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        u, v = [], []
        for x, y in blocks.values():
            if x and y:
                take = lambda side: [flat[ends[i] : ends[i + 1]] for _, _, i in side]
                a, b = take(x), take(y)
                met = _overlaps(a, b)
                sizes = np.add.outer([len(s) for s in a], [len(s) for s in b])
                root = _Roots()
                for i, j in zip(*np.nonzero(met * 100 >= (sizes - met) * percent), strict=True):
                    if root.join(x[i][1], y[j][1]):
                        u.append(max(x[i][0], y[j][0]))
                        v.append(min(x[i][0], y[j][0]))
        kind = table.schema.field("rep").type
        return pa.table({"u": pa.array(u, kind), "v": pa.array(v, kind)})

    return run


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    light = stored(described(docs, width, bands, rows, id_col, text_col), "near-light")
    known = light.where("id IS NOT NULL AND n > 0")
    classes = stored(known.groupBy("n", "lo", "hi").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "near-classes")
    firsts = known.join(classes.select("rep", F.col("n").alias("cn"), F.col("lo").alias("cl"), F.col("hi").alias("ch")), (F.col("id") == F.col("rep")) & (F.col("n") == F.col("cn")) & (F.col("lo") == F.col("cl")) & (F.col("hi") == F.col("ch")))
    spread = stored(firsts.dropDuplicates(["rep", "n", "lo", "hi"]).select("rep", "n", F.explode("bands").alias("bucket")), "near-spread")
    shared = stored(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-shared")
    members = stored(join_groups(spread, shared, ["bucket"], "size").select("bucket", "rep", "n", "size"), "near-members")
    # A bucket's leader is the member that shares the largest buckets: in a group of copies, the least edited one.
    ids = stored(members.groupBy("rep").agg(F.sum("size").alias("weight"), F.min("n").alias("rep_n")), "near-ids")
    heads = members.join(ids, "rep").groupBy("bucket").agg(F.max(F.struct("weight", "rep", "n")).alias("l"), F.count("*").alias("k"))
    heads = stored(heads.select("bucket", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n"), "k"), "near-heads")
    # The bitmap spares reading and shuffling the texts of documents that share no bucket; the join decides.
    some = select_maybe(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), maybe_filter(ids, F.col("rep")), F.col("_id"))
    sets = _sets(some, width, "_id", "_text").join(ids, F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id", "elements"])
    sets = stored(sets, "near-sets")
    fits = lambda a, b: (a * 100 >= b * percent) & (b * 100 >= a * percent)  # noqa: E731  else the sizes rule a link out

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs a, b. The set of a travels with the pair, that of b doesn't: a should be in few pairs. A b that is
        in many is dealt to several tasks, with its set, so that none holds over one in HEAVY of the pairs."""
        pairs = stored(pairs.where("a <> b").select("a", "b").distinct(), "near-pairs")
        total = max(1, pairs.count())
        parts = F.ceil(F.col("k") * HEAVY / total).cast("int").alias("parts")
        hubs = F.broadcast(pairs.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") * HEAVY > total).select("b", parts))  # at most HEAVY rows
        left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
        right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")).join(hubs, "b", "left")
        right = right.select("b", "eb", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        dealt = pairs.join(hubs, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
        both = dealt.join(left, "a").join(right, ["b", "part"])
        met = F.size(F.array_intersect("ea", "eb"))
        return both.where(met * 100 >= (F.size("ea") + F.size("eb") - met) * percent).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    star = join_groups(members, heads, ["bucket"], "k").where("rep <> leader").select("bucket", "rep", "n", "leader", "leader_n", "size")
    star = stored(star, "near-star")
    edges = stored(linked(star.where(fits(F.col("n"), F.col("leader_n"))).select(F.col("rep").alias("a"), F.col("leader").alias("b"))), "near-edges")
    found = components(edges)
    # What is left: buckets whose members are in different components.
    state = members.join(found, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", "size", F.coalesce("component", "rep").alias("component"))
    state = stored(state, "near-state")
    mixed = state.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"))
    mixed = stored(mixed.where("lo <> hi").select("bucket", "k"), "near-mixed")
    open_ = stored(join_groups(state, mixed, ["bucket"], "k").drop("k"), "near-open")
    # Small buckets: pairs across components, at most SMALL a member.
    few = open_.where(F.col("size") <= SMALL)
    other = few.select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = few.join(other, "bucket").where((F.col("rep") < F.col("b")) & (F.col("component") != F.col("cb")) & fits(F.col("n"), F.col("nb")))
    fresh = linked(pairs.select(F.col("rep").alias("a"), "b"))
    # Large ones: clusters of buckets that share members. All outside the cluster's main component (x) meet all members
    # (y), in blocks.
    many = open_.where(F.col("size") > SMALL)
    clusters = components(stored(star.join(mixed, "bucket", "left_semi").where(F.col("size") > SMALL).select(F.greatest("rep", "leader").alias("u"), F.least("rep", "leader").alias("v")).distinct(), "near-large"))
    # components() doesn't list the smallest member of a cluster: that is the cluster itself.
    clusters = clusters.select("node", F.col("component").alias("cluster"))
    placed = many.select("rep", "n", "component").distinct().join(clusters, F.col("rep") == F.col("node"), "left")
    placed = placed.select("rep", "n", F.coalesce("cluster", "rep").alias("cluster"), "component")
    placed = stored(placed, "near-placed")
    parts = placed.groupBy("cluster", "component").agg(F.count("*").alias("k"), F.sum("n").alias("e"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("k", "component", "e")).alias("m"), F.sum("k").alias("n_y"), F.sum("e").alias("e_y"))
    main = main.select("cluster", F.col("m.component").alias("main"), "n_y", "e_y", (F.col("n_y") - F.col("m.k")).alias("n_x"), (F.col("e_y") - F.col("m.e")).alias("e_x")).where("n_x > 0")
    split = lambda n, e: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(e) / BLOCK_ELEMENTS)).cast("int")
    sided = join_groups(placed, stored(main, "near-main"), ["cluster"], "n_y").withColumns({"kx": split("n_x", "e_x"), "ky": split("n_y", "e_y")})
    h = F.xxhash64("rep")
    as_y = sided.withColumns({"j": F.pmod(h, F.col("ky")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("kx") - 1)), "is_x": F.lit(False)})
    as_x = sided.where("component <> main").withColumns({"i": F.pmod(h, F.col("kx")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("ky") - 1)), "is_x": F.lit(True)})
    blocks = as_y.unionByName(as_x).select(F.xxhash64("cluster", "i", "j").alias("block"), "is_x", "rep", "component")
    blocks = blocks.join(sets.withColumnRenamed("id", "rep"), "rep")
    kind = docs.schema[id_col].dataType.simpleString()
    later = stored(fresh.unionByName(blocks.groupBy("block").applyInArrow(_block_links(percent), f"u {kind}, v {kind}")), "near-later")
    if later.limit(1).count():
        # Only components are joined now, not documents.
        named = state.select("rep", "component").distinct()
        lifted = later.join(named.withColumnsRenamed({"rep": "u", "component": "cu"}), "u").join(named.withColumnsRenamed({"rep": "v", "component": "cv"}), "v")
        lifted = components(stored(lifted.select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct(), "near-lifted")).withColumnsRenamed({"node": "low", "component": "top"})
        nodes = found.union(lifted.select("low", "low")).distinct()
        found = nodes.join(lifted, nodes["component"] == F.col("low"), "left").select("node", F.coalesce("top", "component").alias("component"))
    names = stored(classes.join(found, F.col("rep") == F.col("node"), "left").select("n", "lo", "hi", "rows", F.coalesce("component", "rep").alias("component_id")), "near-names")
    final = join_groups(known.select("id", "n", "lo", "hi"), names, ["n", "lo", "hi"], "rows").select("id", "n", "component_id")
    alone = light.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    if known.groupBy("id").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a <> b").limit(1).count():  # one id, several texts: one node
        same = final.groupBy("id").agg(F.min("component_id").alias("m"))
        links = final.join(same, "id").select(F.col("component_id").alias("u"), F.col("m").alias("v")).union(final.select(F.col("id").alias("u"), F.col("component_id").alias("v")))
        final = final.join(components(links), F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    return final.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, with all its columns."""
    gone = stored(near_copies(docs, width, percent, id_col=id_col, text_col=text_col).where(~F.col("kept")).select(id_col).distinct(), "near-gone")
    return without(docs, gone, id_col, lambda df: df.join(gone.withColumnRenamed(id_col, "__pw_gone"), df[id_col] == F.col("__pw_gone"), "left_anti"))
