"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct word n-grams. All sets are put in one
global order, rare n-grams first, by a frequency sketch of fixed size. Two sets
that reach the similarity must share an n-gram among the first few of that
order (their prefixes), so candidates meet on prefix n-grams only. Sets are
compared as sequences in a trie: sequences with a common beginning share one
path and its partial overlap, and a subtree is left as soon as the overlap so
far plus the shorter of what remains cannot reach the required overlap.

Groups of many near copies are not expanded into pairs. Equal sets are folded
first. Then each prefix n-gram's members are compared with one leader, and
only members that the leaders left in different components are compared with
each other. A pair that is never compared is already connected, so components
are exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.kernels import lean
from corpuslab.llm import scratch
from corpuslab.llm.components import components
from corpuslab.llm.windows import texts

SKETCH, CHUNK_BITS = 20, 14
BLOCK = 256
#: Sketch blocks that one task adds up.
FAN_IN = 64
BATCH = 150_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RANK = K.U64(64 - 6)


def sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct n-gram hashes of rows i..j, row r from first[r] to first[r+1]."""
    w = K.Words(data, offsets, i, j)
    words = w.hashes(LOWER[w.bytes])
    at = np.flatnonzero(K.inside(w.first, k, len(words))) if len(words) >= k else np.zeros(0, np.int64)
    row, h = w.row[at], K.gram_hashes(words, k)[at] if len(at) else np.zeros(0, K.U64)
    for r in np.flatnonzero((w.counts > 0) & (w.counts < k)):
        part = words[w.first[r] : w.first[r + 1]]
        row, h = np.append(row, r), np.append(h, K.gram_hashes(part, len(part)) ^ K.U64(len(part)))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (np.diff(row) != 0) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(j - i + 1))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set."""
    total = np.zeros(len(h) + 1, K.U64)
    np.cumsum(K.mix64(h ^ K.U64(0x5851F42D4C957F2D)), out=total[1:])
    return K.mix64((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(K.U64)).view(np.int64)


def ranked(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """n-grams in the global order: log2 of the sketched frequency, then the hash."""
    seen = sketch[(h >> K.U64(64 - SKETCH)).astype(np.int64)]
    return (np.log2(seen + 1.0).astype(K.U64) << RANK) | (h >> K.U64(6))


def profile(order: np.ndarray) -> bytes:
    """Parities of a set's n-grams by class, at least as many classes (a power of two, 512 at least) as n-grams.

    Two sets differ in at least as many n-grams as their parities differ in.
    """
    bits = max(512, 1 << max(0, len(order) - 1).bit_length())
    odd = np.bincount((order & K.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(marks: list[bytes], words: int) -> np.ndarray:
    """Parities over 64 * words classes; halves fold onto each other."""
    m = np.frombuffer(b"".join(marks), np.uint64).reshape(len(marks), -1)
    while m.shape[1] > words:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def differing(p: list[bytes], q: list[bytes]) -> np.ndarray:
    """For each pair of profiles, n-grams in which the sets differ at least."""
    out = np.zeros(len(p), np.int64)
    a, b = np.array([len(x) for x in p]) // 8, np.array([len(x) for x in q]) // 8
    for x, y in {(int(x), int(y)) for x, y in zip(a, b, strict=True)}:
        every = np.flatnonzero((a == x) & (b == y))
        w = min(x, y)
        for at in np.split(every, range(1 << 14, len(every), 1 << 14)):
            out[at] = np.bitwise_count(_fold([p[i] for i in at], w) ^ _fold([q[i] for i in at], w)).sum(axis=1, dtype=np.int64)
    return out


class Threshold:
    """Jaccard of at least num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1


def _scan(k: int):
    """Rows (doc, n, sid) of documents and (task as doc, chunk, counts) of the task's sketch."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch = np.zeros(1 << SKETCH, np.int64)
        for frame in frames:
            docs = frame.column(0).to_numpy(zero_copy_only=False)
            data, offsets = K.text_buffers(frame.column(1))
            for i, j in K.chunks(offsets):
                h, first = sets(data, offsets, i, j, k)
                sketch += np.bincount((h >> K.U64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
                m = j - i
                cols = [pa.array(docs[i:j].astype(np.int64)), pa.array(np.diff(first)), pa.array(set_ids(h, first)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
        size = 1 << CHUNK_BITS
        for c in range(len(sketch) // size) if sketch.any() else ():
            yield pa.RecordBatch.from_pylist([{"doc": TaskContext.get().partitionId(), "chunk": c, "counts": sketch[c * size : (c + 1) * size].astype("<u4").tobytes()}], schema=schema)

    return run


def _add_chunks(frame: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, "<u4").astype(np.int64) for b in frame.column("counts").to_pylist())
    first = {c: frame.column(c).slice(0, 1) for c in ("chunk", "part")}
    return pa.table({**first, "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())})


def added_up(blocks: DataFrame, tasks: int) -> DataFrame:
    """Counts (chunk, part, counts) of ``tasks`` map tasks as one row a chunk; no group holds more than ``FAN_IN`` blocks."""
    while True:
        tasks = -(-tasks // FAN_IN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        blocks = blocks.groupBy("chunk", "part").applyInArrow(_add_chunks, "chunk int, part long, counts binary")
        if tasks <= 1:
            return blocks


def _prefixes(k: int, limit: Threshold, sketch):
    """Rows (g, sid) for each prefix n-gram and one (sid, size, profile) a set; equal sets of a task once."""
    schema = pa.schema([("g", pa.int64()), ("sid", pa.int64()), ("size", pa.int64()), ("profile", pa.binary())])

    def batch(g, sid, size, marks) -> pa.RecordBatch:
        n = len(sid)
        columns = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip((g, sid, size, marks), schema.types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for frame in frames:
            data, offsets = K.text_buffers(frame.column(1))
            for i, j in K.chunks(offsets):
                h, first = sets(data, offsets, i, j, k)
                sid = set_ids(h, first)
                order = ranked(h, sketch.value)
                grams, owners, marks = [], [], []
                for r in np.flatnonzero(np.diff(first)):
                    if int(sid[r]) not in seen:
                        seen.add(int(sid[r]))
                        own = order[first[r] : first[r + 1]]
                        p = limit.prefix(len(own))
                        grams.append(np.partition(own, p - 1)[:p] if p < len(own) else own)
                        owners.append(np.full(p, sid[r]))
                        marks.append((int(sid[r]), len(own), profile(own)))
                if grams:
                    yield batch(np.concatenate(grams).view(np.int64), np.concatenate(owners), None, None)
                    yield batch(None, *zip(*marks, strict=True))

    return run


#: Bytes of sets that a batch of sequences holds, beyond one set.
SET_BYTES = 8 << 20


def _sequences(k: int, sketch):
    """Rows (doc, text, asked) -> (group, salt, lead, sid, order): the ordered set for each group that asks for it.

    A leader is asked for by each of its salts, so batches are cut by bytes
    between the rows of one document too.
    """
    schema = pa.schema([("group", pa.int64()), ("salt", pa.int32()), ("lead", pa.bool_()), ("sid", pa.int64()), ("set", pa.binary())])

    def cut(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            asked = frame.column(2)
            data, offsets = K.text_buffers(frame.column(1))
            for i, j in K.chunks(offsets):
                h, first = sets(data, offsets, i, j, k)
                sid = set_ids(h, first)
                order = ranked(h, sketch.value)
                rows: list[tuple] = []
                size = 0
                for r in range(j - i):
                    raw = np.sort(order[first[r] : first[r + 1]]).astype(">u8").tobytes()
                    for x in asked[i + r].as_py():
                        if x["sid"] == sid[r]:
                            rows.append((x["group"], x["salt"], x["lead"], int(sid[r]), raw))
                            size += len(raw)
                            if size >= SET_BYTES or len(rows) >= 2000:
                                yield cut(rows)
                                rows, size = [], 0
                if rows:
                    yield cut(rows)

    return run


def trie_links(lead: np.ndarray, others: list[bytes], limit: Threshold) -> list[int]:
    """Which of the ordered sets (big-endian bytes) reach the threshold with ``lead``.

    Sets in lexicographic order are a trie read depth first: what a set shares
    with the one before it is their common path. ``over[d]`` is the overlap of
    the first d n-grams of the current path with ``lead``; a walk that stopped
    at depth d has ``over`` up to d only. Where neither what is left of ``lead``
    nor the remaining lengths let any set below a node reach the threshold, the
    whole subtree is left out.
    """
    found: list[int] = []
    over, path, n = np.zeros(1, np.int64), np.zeros(0, K.U64), len(lead)
    order = sorted(range(len(others)), key=others.__getitem__)
    sizes = np.array([len(others[k]) // 8 for k in order], np.int64)
    k = 0
    while k < len(order):
        raw = others[order[k]]
        y = np.frombuffer(raw, ">u8").astype(K.U64)
        need = limit.overlap(n, len(y))
        m = min(len(path), len(y))
        differ = np.flatnonzero(path[:m] != y[:m])
        depth = min(int(differ[0]) if len(differ) else m, len(over) - 1)
        over, path, dead = over[: depth + 1], y, False
        while True:
            left = n - (int(np.searchsorted(lead, y[depth - 1], side="right")) if depth else 0)
            if over[depth] + min(left, len(y) - depth) < need:
                dead = True
                break
            if depth == len(y):
                break
            part = y[depth : depth + 64]
            place = np.searchsorted(lead, part)
            hit = (place < n) & (lead[np.minimum(place, n - 1)] == part)
            over = np.concatenate([over, over[depth] + np.cumsum(hit)])
            depth += len(part)
        if not dead and over[depth] >= need:
            found.append(order[k])
        k += 1
        if dead:
            # All sets below this node: what lead has left cannot lift even the shortest of them.
            end = bisect_right(order, raw[: 8 * depth] + b"\xff" * 9, lo=k, key=others.__getitem__)
            if end > k and over[depth] + left < limit.overlap(n, int(sizes[k:end].min())):
                k = end
    return found


def _verify(limit: Threshold):
    """Rows (group, salt, lead, sid, set), sorted, lead first -> (u, v) that link."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead, held = None, None, []

        def flush() -> pa.RecordBatch:
            got = trie_links(np.frombuffer(lead, ">u8").astype(K.U64), [s for _, s in held], limit) if lead is not None else []
            return pa.RecordBatch.from_arrays([pa.array([held[x][0] for x in got], pa.int64()), pa.array([now[0]] * len(got), pa.int64())], schema=schema)

        for frame in frames:
            for group, salt, is_lead, sid, raw in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if (group, salt) != now:
                    if held:
                        yield flush()
                    now, lead, held = (group, salt), None, []
                if is_lead:
                    lead = raw
                else:
                    held.append((sid, raw))
        if held:
            yield flush()

    return run


def _cross(limit: Threshold):
    """Rows (g, lo, hi, block, sid, comp, size, profile), sorted -> likely pairs (u, v) of different components.

    Whole groups are handled many at a time; a pair that meets on several
    n-grams of a batch is looked at once.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pairs(table: pa.Table) -> pa.RecordBatch:
        g, lo, hi, block, sid, comp, size = (table.column(c).to_numpy() for c in range(7))
        n = len(g)
        head = np.ones(n, dtype=bool)
        head[1:] = (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        first = np.flatnonzero(head)
        end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        names, at, own = np.unique(sid, return_index=True, return_inverse=True)
        found, i, step = [np.zeros(0, np.int64)], np.arange(n), 0
        while len(i):
            step += 1
            i = i[i + step < end[i]]
            j = i + step
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (comp[i] != comp[j]) & (sid[i] != sid[j]) & (limit.den * small >= limit.num * large) & ((lo[i] == hi[i]) | (block[i] != block[j]))
            a, b = own[i[ok]], own[j[ok]]
            found.append(np.unique(np.maximum(a, b) * len(names) + np.minimum(a, b)))
        codes = np.unique(np.concatenate(found))
        u, v = codes // max(1, len(names)), codes % max(1, len(names))
        marks = table.column(7).take(pa.array(at)).to_pylist()
        a, b = size[at][u], size[at][v]
        most = (a + b - differing([marks[k] for k in u], [marks[k] for k in v])) // 2
        keep = most >= limit.overlap(a, b)
        return pa.RecordBatch.from_arrays([pa.array(names[u[keep]]), pa.array(names[v[keep]])], schema=schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += frame.num_rows
            if rows >= BATCH:
                table = pa.Table.from_batches(held).combine_chunks()
                key = [table.column(c).to_numpy() for c in range(3)]
                last = np.flatnonzero(~np.logical_and.reduce([k == k[-1] for k in key]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield pairs(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return run


class Join:
    """One join over (doc, text) rows; ``groups`` gives doc, n_shingles, component."""

    def __init__(self, rows: DataFrame, k: int, limit: Threshold):
        self.spark, self.rows, self.k, self.limit = rows.sparkSession, rows, k, limit
        scratch.small_batches(self.spark)
        found = scratch.stage(rows.mapInArrow(lean(_scan(k)), "doc long, n long, sid long, chunk int, counts binary"), "ngram-scan")
        self.docs = found.where("chunk is null").select("doc", "n", "sid")
        blocks = found.where("chunk is not null").select("chunk", F.col("doc").alias("part"), "counts")
        tasks = blocks.agg(F.max("part").alias("last")).first()["last"]
        sums = added_up(blocks, (tasks or 0) + 1)
        # 2**20 counts whatever the corpus: 4 MB to the driver and to each executor.
        table = np.zeros(1 << SKETCH, np.uint32)
        for row in sums.collect():
            table[row.chunk << CHUNK_BITS : (row.chunk + 1) << CHUNK_BITS] = np.frombuffer(row.counts, "<u4")
        self.sketch = self.spark.sparkContext.broadcast(table)
        # Of equal sets, the least document stands for all.
        self.reps = scratch.stage(self.docs.where("n > 0").groupBy("sid").agg(F.min("doc").alias("rep"), F.first("n").alias("size")), "sets")

    def prefixes(self) -> tuple[DataFrame, DataFrame]:
        """(g, sid, lead) and (sid, size, profile).

        Of the sets that share a prefix n-gram, the one with the largest share
        of shared n-grams in its prefix leads: where many edited copies of one
        text meet, that is the text itself.
        """
        found = scratch.stage(self.rows.mapInArrow(lean(_prefixes(self.k, self.limit, self.sketch)), "g long, sid long, size long, profile binary"), "prefixes")
        profiles = found.where("g is null").groupBy("sid").agg(F.first("size").alias("size"), F.first("profile").alias("profile"))
        profiles = scratch.stage(profiles, "profiles")
        every = found.where("g is not null").select("g", "sid")
        shared = every.groupBy("g").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("g")
        live = scratch.stage(every.join(shared, "g").distinct(), "shared-prefixes")
        scratch.release(self.spark)
        whole = F.col("size") - F.ceil(self.limit.num * F.col("size") / self.limit.den) + 1
        score = live.groupBy("sid").agg(F.count("*").alias("c")).join(profiles.select("sid", "size"), "sid")
        score = score.select("sid", F.floor(1000 * F.col("c") / whole).alias("score"))
        lead = live.join(score, "sid").groupBy("g").agg(F.max(F.struct("score", "sid")).alias("m")).select("g", F.col("m.sid").alias("lead"))
        return scratch.stage(live.join(lead, "g"), "led-prefixes"), profiles

    def likely(self, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
        """Pairs (u, v) whose profiles leave the threshold within reach."""
        limit = self.limit

        @F.arrow_udf("boolean")
        def reach(a: pa.Array, b: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
            a, b = a.to_numpy(), b.to_numpy()
            return pa.array((a + b - differing(p.to_pylist(), q.to_pylist())) // 2 >= limit.overlap(a, b))

        of = lambda c: profiles.select(F.col("sid").alias(c), F.col("size").alias(f"{c}_n"), F.col("profile").alias(f"{c}_p"))
        near = pairs.join(of("u"), "u").join(of("v"), "v")
        shorter, longer = F.least("u_n", "v_n"), F.greatest("u_n", "v_n")
        near = near.where(limit.den * shorter >= limit.num * longer)
        return scratch.stage(near.where(reach("u_n", "v_n", "u_p", "v_p")).select("u", "v"), "candidates")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that link: v leads, its partners are dealt over groups of bounded size."""
        crowd = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
        crowd = scratch.stage(crowd, "crowds")
        seats = pairs.join(crowd, "v").select(F.col("u").alias("sid"), F.col("v").alias("group"), F.pmod(F.xxhash64("u"), F.col("salts").cast("long")).cast("int").alias("salt"), F.lit(False).alias("lead"))
        leads = crowd.select(F.col("v").alias("sid"), F.col("v").alias("group"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("lead"))
        asked = seats.unionByName(leads).join(self.reps.select("sid", "rep"), "sid")
        asked = asked.groupBy(F.col("rep").alias("doc")).agg(F.collect_list(F.struct("group", "salt", "lead", "sid")).alias("asked"))
        some = self.rows.join(asked, "doc").select("doc", "text", "asked")
        seqs = some.mapInArrow(lean(_sequences(self.k, self.sketch)), "group long, salt int, lead boolean, sid long, set binary")
        seqs = seqs.repartition(scratch.parts(self.spark), "group", "salt").sortWithinPartitions("group", "salt", F.desc("lead"))
        out = scratch.stage(seqs.mapInArrow(lean(_verify(self.limit)), "u long, v long").distinct(), "links")
        scratch.release(self.spark)
        return out

    def crossing(self, shared: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
        """Likely pairs on one prefix n-gram whose components still differ."""
        rows = shared.select("g", "sid").join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        rows = scratch.stage(rows, "labelled")
        open_ = rows.groupBy("g").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c")).where("a <> b")
        open_ = scratch.stage(open_.select("g", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "open-grams")
        seats = rows.join(open_, "g").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks").cast("long")).cast("int"))
        seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(profiles, "sid")
        seats = seats.select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid", "comp", "size", "profile")
        seats = seats.repartition(scratch.parts(self.spark), "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
        return scratch.stage(seats.mapInArrow(lean(_cross(self.limit)), "u long, v long").distinct(), "crossing")

    def groups(self) -> DataFrame:
        shared, profiles = self.prefixes()
        stars = shared.where("sid <> lead").select(F.col("sid").alias("u"), F.col("lead").alias("v")).distinct()
        tried = self.likely(stars, profiles)
        linked = self.links(tried)
        labels = scratch.stage(components(linked).select(F.col("node").alias("sid"), F.col("component").alias("comp")), "labels")
        done = tried.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        rest = self.crossing(shared, labels, profiles).join(done, ["u", "v"], "left_anti")
        linked = linked.unionByName(self.links(scratch.stage(rest, "rest")))
        name = self.reps.select("sid", "rep")
        edges = linked.join(name.withColumnsRenamed({"sid": "u", "rep": "a"}), "u").join(name.withColumnsRenamed({"sid": "v", "rep": "b"}), "v")
        group = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        named = self.reps.join(group, self.reps["rep"] == group["node"], "left").select("sid", F.coalesce("component", "rep").alias("component"))
        out = self.docs.join(named, "sid", "left")
        return out.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def similarity_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, at_least: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row a document: id, ``n_shingles``, ``component_id``.

    Texts are lower-cased (A-Z) and cut into words; a set holds the distinct
    ``k``-word shingles, or the whole sequence if it is shorter. Two documents
    link when their sets' Jaccard similarity is at least ``at_least`` (a
    fraction in whole numbers). The component is the smallest id reachable by
    links. A null, empty or blank text has an empty set and links with
    nothing. Rows with a null id link with nothing (0 shingles, null
    component). Rows that repeat an id each keep their own text's result.
    Extra columns are not read; an empty table gives an empty table. Sets are
    told apart by 64-bit hashes.
    """
    rows = texts(docs, id_col, text_col)
    out = Join(rows, k, Threshold(*at_least)).groups()
    out = out.select(F.col("doc").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    lost = docs.where(F.col(id_col).isNull())
    return out.unionByName(lost.select(F.lit(None).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
