"""N-gram Jaccard join by universe partition, pigeonhole and one-deletion neighbourhoods; exact.

Documents are sets of word shingles; two link when 100 |A n B| >= 80 |A u B|. Sizes fall into
bands whose ends differ by 1 / 0.8, so linked sets lie in one band or two neighbouring ones. For
each band b the hash universe is cut into m(b) segments; a set is indexed in the space of its own
band and of the one below, by one signature a segment: a hash of the subset that falls there.

If two sets differ in at most H elements, few segments can differ, and each set allocates its
signatures by cost: segments of two or more elements come first, as small ones are shared by
chance. If it has no more than H of those, it adds the one-deletion neighbourhoods of its larger
segments, each of which needs two differences to escape; if twice those and the rest are still no
more than H, it adds its one-element segments and at last its empty ones. A pair without any match would
differ more than H at each stage, so both sets of such a pair reach the next one: no link is lost.

Signatures are exchanged as packed sorted hashes, a range of hashes a part. Sets that share one
form groups; equal groups are kept once. A first round pairs every member with the group's least;
the next rounds pair, inside each group, members whose components still differ, as least spanning
forests over the pairs that were not refused yet, until no group has such a pair. Members of a
large group are dealt in blocks, and every two blocks meet in a task of their own. So every pair of
a group is verified or made needless by a path of links, and links come before pairs that fail.
Before texts meet, pairs must pass an exact bound: a sketch has a bit a cell, set where the cell
holds an odd number of elements; each differing element turns one bit, so sketches of linked sets
differ in no more than H bits. Cells are a power of two, so a finer sketch folds into a coarser.
What passes is verified exactly on the texts. Links give components by alternating star steps.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of
fewer words than a shingle are one shingle of all their words; rows that share an id are nodes
of one id (any of their texts links it), and each gets a row with its own n_shingles; rows with a
null id link with nothing and have a null component_id. Further input columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, lower_words, mix, pack, pack_sorted, parts_for, rows_of, settled, shingles, slices, spare, text_blocks, unpack, unpack_sorted

PERCENT, WORDS, BLOCK_CHARS, SMALL = 80, 5, 4 << 20, 8
#: Bytes of text that one part of the exchange serves.
PART_BYTES = 12 << 20
#: Parts that a task takes one after the other, and groups that it remembers to emit them once.
TASK_PARTS, KNOWN_GROUPS = 4, 1 << 18
#: Cells of a sketch an element, at least: fine enough that two differing elements seldom meet in one.
CELLS = 2
#: Ids that a broadcast may hold; more of them meet their texts in a shuffle.
SENT_IDS = 1_000_000
#: Open pairs a member of a group that are verified at once; groups with more go by forests.
DENSE = 2
#: Members of a group that one task holds, about half at most; larger groups are dealt in blocks, two of which meet in each task.
TASK_MEMBERS = 4096
#: Words of sketches that are compared at once.
BLOCK_WORDS = 1 << 20


def bands(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Band numbers of set sizes: band b holds sizes from edge(b) up to edge(b + 1)."""
    return np.searchsorted(_edges(percent), n, side="right") - 1


def _edges(percent: int, cache: dict = {}) -> np.ndarray:  # noqa: B006  computed once a process
    if percent not in cache:
        e = [1]
        while e[-1] < 1 << 40:
            # the largest set that links with one of size s has floor(100 s / percent) elements
            e.append(max(e[-1] + 1, e[-1] * 100 // percent))
        cache[percent] = np.array(e, np.int64)
    return cache[percent]


def segments(band: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many segments a band's space has: about three elements each."""
    return np.maximum(2, -(-_edges(percent)[band + 1] // 3))


def most_apart(n: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (n + other) * (100 - percent) // (100 + percent)


class Sets:
    """Shingle sets of a block's documents, end to end, sorted within each."""

    def __init__(self, texts: list, hashes: WordHash, words: int) -> None:
        found = [np.unique(shingles(hashes.of(lower_words(t)), words)) for t in texts]
        self.size = np.array([len(h) for h in found], np.int64)
        self.h = np.concatenate([*found, np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(found)), self.size)

    def space(self, band: np.ndarray, percent: int):
        """Segments of each set in the spaces of the given bands: (set, segment, first element, count), and each element's segment."""
        m = segments(np.maximum(band, 0), percent)
        seg = ((self.h >> np.uint64(32)) * m[self.doc].astype(np.uint64)) >> np.uint64(32)
        seg = seg.astype(np.int64)
        new = np.flatnonzero(np.append(True, (np.diff(seg) != 0) | (np.diff(self.doc) != 0))) if len(seg) else np.empty(0, np.int64)
        return m, self.doc[new], seg[new], new, np.diff(np.append(new, len(seg))), seg


def signatures(sets: Sets, lower: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place of the set) for every allocated segment, in the space of each set's own band or the one below."""
    n = sets.size
    band = bands(np.maximum(n, 1), percent) - int(lower)
    used = (n > 0) & (band >= 0)
    if lower:  # sets that no smaller-band set can link with
        used &= n * percent <= (_edges(percent)[np.maximum(band, 0) + 1] - 1) * 100
    m, doc, seg, first, count, own = sets.space(band, percent)
    # the largest difference to any partner in this space: from below at most its band's end, from above at most n / 0.8
    top = _edges(percent)[np.maximum(band, 0) + 1] - 1
    far = most_apart(n, np.minimum(n, top) if lower else n * 100 // percent, percent)
    salt = mix(np.maximum(band, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(17))
    place = mix(salt[doc] + seg.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    value = mix(sets.h)
    whole = np.add.reduceat(value, first) if len(first) else np.empty(0, np.uint64)
    keep = used[doc]
    solid = keep & (count >= 2)
    out = [(mix(whole[solid] ^ place[solid]), doc[solid])]
    two = np.bincount(doc[solid], minlength=len(n))
    three = np.bincount(doc[keep & (count >= 3)], minlength=len(n))
    one = np.bincount(doc[keep & (count >= 1)], minlength=len(n))
    short = used & (two <= far)
    if short.any():
        tag = np.uint64(0xA5A5A5A5A5A5A5A5)
        s = short[doc] & solid
        out.append((mix(whole[s] ^ place[s] ^ tag), doc[s]))
        of = np.repeat(np.arange(len(first)), count)
        e = (short[doc] & (count >= 3))[of]
        out.append((mix((whole[of] - value)[e] ^ place[of][e] ^ tag), sets.doc[e]))
        shorter = short & (two + three <= far)
        s = shorter[doc] & (count == 1)
        out.append((mix(whole[s] ^ place[s]), doc[s]))
        for d in np.flatnonzero(shorter & (one <= far)):
            empty = np.setdiff1d(np.arange(m[d]), seg[doc == d]).astype(np.uint64)
            out.append((mix(mix(salt[d] + empty * np.uint64(0xD6E8FEB86659FD93))), np.full(len(empty), d)))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def sketches(sets: Sets) -> list[bytes]:
    """Each set's parities of elements by cell, as bits of 64-bit words, the lowest first."""
    out = []
    start = np.cumsum(sets.size) - sets.size
    for a, n in zip(start, sets.size, strict=True):
        cells = max(64, 1 << int(CELLS * n - 1).bit_length())
        odd = np.bincount((sets.h[a : a + n] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the finer one folded: no more than their sets differ in elements."""
    bits = 8 * min(len(x), len(y))
    both = []
    for sketch in (x, y):
        v, n = int.from_bytes(sketch, "little"), 8 * len(sketch)
        while n > bits:
            n //= 2
            v = (v >> n) ^ (v & ((1 << n) - 1))
        both.append(v)
    return (both[0] ^ both[1]).bit_count()


def may(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether sets of these sizes and sketches may link."""
    return min(n, m) * 100 >= max(n, m) * percent and apart(x, y) <= (n + m) * (100 - percent) // (100 + percent)


def prepared(docs: DataFrame, parts: int, words: int, percent: int, chars: int) -> DataFrame:
    """Two kinds of rows from one pass over (id, t), texts hashed once.

    With a part: the signatures of a block in one range of hashes (keys), whose they are (at, ids); a block's
    exact copies stand behind the least id. Without: (id, n, mark, sketch) of every row, that is set size, a 128-bit
    digest of the set, and its sketch.
    """

    def run(batches):
        hashes = WordHash()
        for n, rows in enumerate(text_blocks(batches, chars)):
            owner: dict[str, int | None] = {}
            for k, t in rows:
                had = owner.setdefault(t or "", k)
                if k is not None and (had is None or k < had):
                    owner[t or ""] = k
            texts = sorted((t for t, k in owner.items() if k is not None), key=owner.get)
            ids = np.array([owner[t] for t in texts], np.int64)
            texts += [t for t, k in owner.items() if k is None]
            sets = Sets(texts, hashes, words)
            marks = [xxhash.xxh3_128_digest(x.tobytes()) for x in np.split(sets.h, np.cumsum(sets.size)[:-1])]
            place = dict(zip(texts, zip(sets.size.tolist(), marks, sketches(sets), strict=True), strict=True))
            size, mark, sketch = zip(*(place[t or ""] for _, t in rows), strict=True)
            yield batch(len(rows), id=[k for k, _ in rows], n=size, mark=mark, sketch=sketch)
            both = [signatures(sets, lower, percent) for lower in (False, True)]
            keys, at = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
            keys, at = keys[at < len(ids)], at[at < len(ids)]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order].astype(np.uint32)
            for p, i, j in slices(keys, parts):
                if i < j:
                    use, who = np.unique(at[i:j], return_inverse=True)
                    who = who.astype(np.uint16 if len(use) < 1 << 16 else np.uint32)
                    yield batch(1, part=[p], keys=[pack_sorted(keys[i:j])], at=[pack(who)], ids=[pack_sorted(ids[use].view(np.uint64))])
            del rows, texts, owner, sets, place, both, keys, at
        spare(hashes)

    kinds = {"part": pa.int32(), "keys": pa.binary(), "at": pa.binary(), "ids": pa.binary(), "id": pa.int64(), "n": pa.int64(), "mark": pa.binary(), "sketch": pa.binary()}

    def batch(rows: int, **have) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(have[c], t) if c in have else pa.nulls(rows, t) for c, t in kinds.items()], names=list(kinds))

    return docs.mapInArrow(run, "part int, keys binary, at binary, ids binary, id long, n long, mark binary, sketch binary")


def groups(indexed: DataFrame, parts: int) -> DataFrame:
    """(mark, members): ids that share a signature, in order; equal groups once.

    A task takes neighbouring parts one after the other, so that it holds one part's signatures at a time, and
    emits a group once for all of them; what several tasks made is made equal by its digest.
    """
    tasks = -(-parts // TASK_PARTS)

    def shared(blocks: list[tuple]) -> list[np.ndarray]:
        """The groups of one part's blocks (keys, at, ids)."""
        keys = np.concatenate([unpack_sorted(k) for k, _, _ in blocks])
        ids = np.concatenate([unpack_sorted(i).view(np.int64)[unpack(a)] for _, a, i in blocks])
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(start, len(keys)))
        many = np.repeat(count > 1, count)
        ids, key = ids[many], np.repeat(np.arange(len(start)), count)[many]
        order = np.lexsort((ids, key))
        ids, key = ids[order], key[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.empty(0, bool)
        ids, key = ids[fresh], key[fresh]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(ids) else np.empty(0, np.int64)
        return [g for g in np.split(ids, start[1:]) if len(g) > 1]

    def meet(batches):
        known: set[bytes] = set()

        def fresh(blocks: list[tuple]):
            made = {}
            for g in shared(blocks):
                if (mark := xxhash.xxh3_128_digest(g.tobytes())) not in known:
                    made.setdefault(mark, g)
                    if len(made) + len(known) > KNOWN_GROUPS:
                        known.clear()
            known.update(made)
            ends = np.cumsum([0, *map(len, made.values())]).tolist()
            ids = np.concatenate([*made.values(), np.empty(0, np.int64)])
            marks, step = list(made), 1 << 14
            for i in range(0, len(marks), step):
                j = min(i + step, len(marks))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends[i : j + 1]) - ends[i], pa.int32()), pa.array(ids[ends[i] : ends[j]]))
                yield pa.RecordBatch.from_arrays([pa.array(marks[i:j], pa.binary()), lists], names=["mark", "members"])

        of, blocks = None, []
        for part, *block in rows_of(batches, "part", "keys", "at", "ids"):
            if part != of and blocks:
                yield from fresh(blocks)
                blocks = []
                spare()
            of = part
            blocks.append(block)
        if blocks:
            yield from fresh(blocks)
        spare(known)

    dealt = indexed.repartitionById(tasks, F.floor(F.col("part") * tasks / parts).cast("int")).sortWithinPartitions("part")
    made = dealt.mapInArrow(meet, "mark binary, members array<long>")
    return made.groupBy("mark").agg(F.first("members").alias("members"))


def may_link(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), as representatives of their copies, whose profiles pass the exact bound."""
    p = profiles.select("id", F.struct("rep", "n", "sketch").alias("p"))
    both = pairs.join(p.withColumnsRenamed({"id": "a", "p": "pa"}), "a").join(p.withColumnsRenamed({"id": "b", "p": "pb"}), "b")
    both = both.filter("pa.rep <> pb.rep").filter(F.least("pa.n", "pb.n") * 100 >= F.greatest("pa.n", "pb.n") * percent)

    def run(batches):
        for t in batches:
            n, x, m, y = (t.column(c).to_pylist() for c in ("n", "x", "m", "y"))
            yield t.select(["a", "b"]).filter(pa.array([may(*r, percent) for r in zip(n, x, m, y, strict=True)], pa.bool_()))

    return both.select(F.col("pa.rep").alias("a"), F.col("pb.rep").alias("b"), F.col("pa.n").alias("n"), F.col("pa.sketch").alias("x"), F.col("pb.n").alias("m"), F.col("pb.sketch").alias("y")).mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their texts (id, t)."""
    ids = settled(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if ids.count() <= SENT_IDS:  # only texts that are asked for are exchanged
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    side = pairs.select(F.col("a").alias("id"), "a", "b").union(pairs.select(F.col("b"), "a", "b"))
    found = side.join(texts, "id").select("a", "b", (F.col("id") == F.col("a")).alias("left"), "t")
    both = found.filter("left").select("a", "b", F.col("t").alias("ta")).join(found.filter("not left").select("a", "b", F.col("t").alias("tb")), ["a", "b"])

    def run(batches):
        hashes = WordHash()
        last: tuple[str, np.ndarray] = ("", np.empty(0, np.uint64))

        def of(t: str) -> np.ndarray:
            return np.unique(shingles(hashes.of(lower_words(t)), words))

        for t in batches:
            keep = []
            for x, y in zip(t.column("ta").to_pylist(), t.column("tb").to_pylist(), strict=True):
                if last[0] != x:
                    last = (x, of(x))
                a, b = last[1], of(y)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(len(a) > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        spare(hashes)

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id that each linked id reaches; alternating large-star and small-star steps until nothing changes."""
    edges = settled(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = settled(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = new.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        old = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        edges = new
        if same == old:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


class Group:
    """A group's members (n, rep, root, sketch, no) with their sketches by width, folded once too."""

    def __init__(self, rows: list[dict], percent: int) -> None:
        self.rep, self.root, self.n = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "root", "n"))
        self.refused = [set(r["no"] or ()) for r in rows]
        self.place = {int(x): i for i, x in enumerate(self.rep)}
        self.percent = percent
        width = np.array([len(r["sketch"]) // 8 for r in rows])
        self.at = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        self.row = np.empty(len(rows), np.int64)
        self.width, self.bits, self.folded = width, {}, {}
        for w, x in self.at.items():
            self.row[x] = np.arange(len(x))
            self.bits[w] = np.frombuffer(b"".join(rows[i]["sketch"] for i in x), "<u8").reshape(len(x), w)
            self.folded[w] = self.bits[w][:, : w // 2] ^ self.bits[w][:, w // 2 :] if w > 1 else None

    def distances(self, u: int):
        """(members, differing bits) of each width that a set linked with u can have."""
        w, i = int(self.width[u]), self.row[u]
        for other in (w // 2, w, 2 * w):
            if other in self.at:
                mine = (self.folded if other < w else self.bits)[w][i]
                table = (self.folded if other > w else self.bits)[other]
                yield self.at[other], np.bitwise_count(table ^ mine).sum(1, dtype=np.int64)

    def refuse(self, pairs: list[tuple[int, int]]) -> None:
        for x, y in pairs:
            self.refused[self.place[x]].add(y)
            self.refused[self.place[y]].add(x)

    def sparse(self) -> list[tuple[int, int]] | None:
        """All open pairs, if they are no more than DENSE a member; else None."""
        out, left = [], DENSE * len(self.n)
        for w, x in self.at.items():
            step = max(1, BLOCK_WORDS // (w * max(len(self.at.get(v, ())) for v in (w, 2 * w))))
            for other in (w, 2 * w):
                if other not in self.at:
                    continue
                y, table = self.at[other], (self.bits if other == w else self.folded)[other]
                for a in range(0, len(x), step):
                    u = x[a : a + step, None]
                    fits = np.minimum(self.n[u], self.n[y]) * 100 >= np.maximum(self.n[u], self.n[y]) * self.percent
                    fits &= self.root[u] != self.root[y]
                    if other == w:
                        fits &= u < y
                    i, j = np.nonzero(fits)
                    for c in range(0, len(i), max(1, BLOCK_WORDS // w)):
                        k, m = i[c : c + max(1, BLOCK_WORDS // w)], j[c : c + max(1, BLOCK_WORDS // w)]
                        d = np.bitwise_count(self.bits[w][a + k] ^ table[m]).sum(1, dtype=np.int64)
                        near = d <= most_apart(self.n[x[a + k]], self.n[y[m]], self.percent)
                        for p, q in zip(x[a + k[near]].tolist(), y[m[near]].tolist(), strict=True):
                            r, t = int(self.rep[p]), int(self.rep[q])
                            if t not in self.refused[p]:
                                out.append((min(r, t), max(r, t)))
                        if len(out) > left:
                            return None
        return out

    def forest(self) -> list[tuple[int, int]]:
        """A least spanning forest: edges between members of different roots that pass the bound and weren't refused.

        Distances are the bound's; members of one root are joined already. At most one edge a member.
        """
        rep, n, far = self.rep, self.n, np.iinfo(np.int64).max
        best, source, out = np.full(len(n), far), np.full(len(n), -1), []
        free = np.ones(len(n), bool)
        u = 0
        while True:
            free[u] = False
            for x, d in self.distances(u):
                d[(d > most_apart(n[u], n[x], self.percent)) | (np.minimum(n[u], n[x]) * 100 < np.maximum(n[u], n[x]) * self.percent)] = far
                if self.refused[u]:
                    d[np.isin(rep[x], list(self.refused[u]))] = far
                better = d < best[x]
                best[x[better]], source[x[better]] = d[better], u
            best[self.root == self.root[u]] = -1
            left = np.flatnonzero(free)
            if not len(left):
                return out
            v = left[np.argmin(best[left])]
            if 0 <= best[v] < far:
                pair = int(rep[v]), int(rep[source[v]])
                out.append((min(pair), max(pair)))
            u = v


def small_group(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """All open pairs of a small group."""
    out = []
    for i, x in enumerate(rows):
        for y in rows[:i]:
            a, b = min(x["rep"], y["rep"]), max(x["rep"], y["rep"])
            if x["root"] != y["root"] and y["rep"] not in (x["no"] or ()) and may(x["n"], x["sketch"], y["n"], y["sketch"], percent):
                out.append((a, b))
    return out


def open_pairs(members: DataFrame, profiles: DataFrame, roots: DataFrame, refused: DataFrame, percent: int, forests: int = 1, most: int = TASK_MEMBERS) -> DataFrame:
    """(mark, a, b): the next pairs to verify, for each group of members(mark, rep) that has several roots.

    All open pairs of a group that has few, else forests without a common edge, as many as asked for; of a group
    that is dealt in blocks, those of every two blocks.
    """
    each = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = each.groupBy("mark").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c"))
    split = split.filter("r0 <> r1").select("mark", F.when(F.col("c") <= most, 1).otherwise(F.ceil(F.col("c") * 2 / most)).cast("int").alias("k"))
    block, other = F.pmod(F.xxhash64("rep"), F.col("k")), F.sequence(F.lit(0), F.col("k") - 1)
    meets = F.transform(F.filter(other, lambda x: x != block), lambda x: F.least(x, block) * F.col("k") + F.greatest(x, block))
    dealt = each.join(split, "mark").withColumn("cell", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(meets)))
    no = refused.union(refused.select("b", "a")).groupBy(F.col("a").alias("rep")).agg(F.collect_set("b").alias("no"))
    row = F.struct("n", "rep", "root", "sketch", "no")
    packed = dealt.join(profiles, "rep").join(no, "rep", "left").groupBy("mark", "cell").agg(F.collect_list(row).alias("rows"))

    def run(batches):
        for batch in batches:
            out, marks = [], []
            for mark, group in zip(*batch.columns, strict=True):  # one group's rows as objects at a time
                mark, rows = mark.as_py(), group.as_py()
                rows.sort(key=lambda r: (r["n"], r["rep"]))
                sizes = [r["n"] for r in rows]
                if not any(x * 100 >= y * percent for x, y in zip(sizes, sizes[1:], strict=False)):
                    continue
                if len(rows) <= SMALL:
                    made = small_group(rows, percent)
                else:
                    group = Group(rows, percent)
                    if (made := group.sparse()) is None:
                        made = []
                        for _ in range(forests):
                            made += (more := group.forest())
                            group.refuse(more)
                out += made
                marks += [mark] * len(made)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["mark", "a", "b"])
        spare()

    return packed.select("mark", "rows").mapInArrow(run, "mark binary, a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, chars: int = BLOCK_CHARS, most: int = TASK_MEMBERS) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    parts = parts_for(rows, "t", each=PART_BYTES)
    made = settled(prepared(rows, parts, words, percent, chars))
    profiles = made.filter("part is null").select("id", "n", "mark", "sketch")
    # copies of one set stand behind the least of their ids
    copies = profiles.filter("id is not null and n > 0").groupBy("mark").agg(F.min("id").alias("rep"))
    known = settled(profiles.select("id", "n", "mark").join(copies, "mark", "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")))
    usable = known.filter("id is not null and n > 0").select("id", "rep")
    one = settled(profiles.filter("id is not null and n > 0").join(copies, "mark").filter("id = rep").select("rep", "n", "sketch").distinct())
    grouped = settled(groups(made.filter("part is not null").select("part", "keys", "at", "ids"), parts))
    star = grouped.select(F.element_at("members", 1).alias("a"), F.explode(F.slice("members", 2, 1 << 30)).alias("b")).distinct()
    texts = rows.filter("id is not null")
    first = settled(may_link(star, usable.join(one, "rep"), percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    many = usable.distinct().groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1").select("id", "a")
    same = usable.join(many, "id").filter("a <> rep").select("a", F.col("rep").alias("b"))
    links = settled(verify(first, texts, words, percent).union(same))
    roots = components(links)
    # members of groups of three or more, as representatives of their copies; a pair's one link was tried above
    members = grouped.filter(F.size("members") > 2).select("mark", F.explode("members").alias("id")).join(usable, "id")
    members = settled(members.select("mark", "rep").distinct())
    refused = first.join(links, ["a", "b"], "left_anti")
    forests = 4
    while not (found := settled(open_pairs(members, one, roots, refused, percent, forests, most))).isEmpty():
        rest = found.select("a", "b").distinct()
        more = settled(verify(rest, texts, words, percent))
        if not more.isEmpty():
            roots = components(more.union(roots.select("root", "id")))
        refused = settled(refused.union(rest.join(more, ["a", "b"], "left_anti")))
        # a group without an open pair never has one again: roots only join and refusals only grow
        members = settled(members.join(found.select("mark").distinct(), "mark"))
        forests *= 4
    out = known.select("id", "n", F.coalesce("rep", "id").alias("rep"))
    return out.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))
