"""N-gram Jaccard join in the metric space of shingle sets, exact at a threshold.

Documents are sets of word shingles; those that are equal as sets are one point. Jaccard
distance is a metric, and points link at a distance of at most e = 1 - threshold.

1. Which pivots are near. Unrelated texts are all at distance one from each other, so pivots
   drawn at random tell nearly all points nothing: every triangle window holds everything.
   Pivots therefore come out of the data. All shingles are dealt into m slices; in each slice
   the points that have an equal part there share a cell, and the cell's least point is its
   centre. Linked points differ in at most k shingles, where k follows from e and the size;
   with m = k + 1 + r slices they share more than r cells. So each point may leave out its r
   smallest parts, as long as it leaves out all of a size or none: parts of one or two
   shingles say little, and most are left out. Sizes are cut into classes that link with the
   next class only; m goes by class. Centres are the first pivots, and a point belongs to the
   region of each centre that it shares a cell with, so two linked points have a region in
   common. No distance to any other pivot is worth computing.
   Sketches go first: counts of a set's hashes by range bound what two sets have in common, and
   points that can't link with a member of a region leave it. What stays moves to each point's
   largest region only, then to those whose points are neither joined nor were compared.
2. Windows. In a region all distances to its centre are computed. Points within e of it link
   and are settled: what links join to the centre needs no further links among itself. The
   others are open. An open point is compared with those members only whose distance to the
   pivot is within e of its own: the triangle inequality lets no link leave that window.
3. Recursion. Where open points and members are many, PIVOTS open points far apart become
   pivots, the other open points fall into the Voronoi cell of the nearest, and each cell
   takes the members in the windows of its open points along: boundary documents are
   replicated, while a point is open in one cell only. Cells are regions in turn. Where that
   doesn't halve the pairs left, windows don't prune, and the open points are compared with
   the members that are left, each in its window.
4. Regions of at most REGION_SHINGLES shingles are solved by one task; in larger ones the same
   rounds run over the cluster, members in chunks, pivots dealt to them.

Everything is exact: a window only skips pairs that can't link or are joined by other links.
Stars around centres stand for cells and groups of copies, never all their pairs.

A-Z are lower-cased, words are what stands between ASCII white space. A text of fewer words
than a shingle, but not none, is one shingle as a whole; a text without words, or null, is
empty, links with nothing and is a component of its own. Repeated rows are equal points; null
ids link like others but never name a component unless no member has an id. Other columns
stay behind. Shingles are told apart by 52-bit hashes within a pair of documents, points by
64 bits, equal sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import M1, M2, OWNER_BITS, _batches, answer, block_words, finish, mix, pack_ints, pack_sorted, places, ranges_of, rolling, send, unpack_ints, unpack_sorted, write_coded
from ._scratch import RANGE_BYTES, discard, exchange_ranges, input_bytes, materialise, release, table, width
from .components import components

SHINGLE = 4
PERCENT = 85
SPARE = 0.4  # r, as a share of k + 1
STAR_KEYS = 1 << 18
LEAF = 64
PIVOTS = 16
REGION_SHINGLES = 3_000_000
PIVOTS_AT_ONCE = 512
CHUNK_SHINGLES = 50_000
SHRINK = 0.5  # a round that leaves a larger share of pairs is the last
WIDE = 8  # chunks that are measured as one where it was
SLACK = 1e-12
SKETCHED = 512  # members up to which a region's sketches are all compared
KEEP = np.uint64(64 - OWNER_BITS)
LOW = np.uint64((1 << 64 - OWNER_BITS) - 1)
EDGE = T.StructType().add("a", T.LongType()).add("b", T.LongType())


def shingle_sets(vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, each text's sorted; their number for each text)."""
    words = vocabulary[codes]
    owner, place = places(sizes)
    full = np.flatnonzero(place + n <= sizes[owner]) if len(words) else np.zeros(0, np.int64)
    parts, owners = [mix(rolling(words, n)[full]) if len(full) else np.zeros(0, np.uint64)], [owner[full]]
    begins = np.cumsum(sizes) - sizes
    for length in range(1, n):
        short = np.flatnonzero(sizes == length)
        value = np.zeros(len(short), dtype=np.uint64)
        for j in range(length):
            value = value * np.uint64(0x9E3779B97F4A7C15) + words[begins[short] + j]
        parts.append(mix(value ^ np.uint64(length)))
        owners.append(short)
    # One sort: the text's number above what is left of the hash.
    keys = np.sort(np.concatenate(parts) & LOW | np.concatenate(owners).astype(np.uint64) << KEEP)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    edge = np.searchsorted(keys, np.arange(len(sizes), dtype=np.uint64) << KEEP)
    return keys & LOW, np.diff(np.append(edge, len(keys)))


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys for each set; those of an empty one are equal everywhere."""
    edge = np.concatenate(([0], np.cumsum(sizes)))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64))) for x in (hashes + np.uint64(1), hashes ^ M1)]
    one, two = (x[edge[1:]] - x[edge[:-1]] for x in sums)
    return mix(one), mix(two + np.uint64(7))


class Classes:
    """Classes of set sizes: a set links with sets of its class, the one below and the one above."""

    def __init__(self, percent: int, largest: int) -> None:
        self.first, self.slices, self.spare, low = [], [], [], 1
        while low <= largest or len(self.first) < 2:
            high = 100 * low // percent
            differ = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
            self.first.append(low)
            self.spare.append(max(2, int(SPARE * (differ + 1))))
            self.slices.append(differ + 1 + self.spare[-1] if differ else 0)  # sets that differ in nothing are equal
            low = high + 1
        self.first, self.slices, self.spare = np.array(self.first), np.array(self.slices), np.array(self.spare)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, side="right") - 1


def cells(hashes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, number of the set) for each cell of each set that isn't empty."""
    out, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    classes = Classes(percent, int(sizes.max(initial=1)))
    own = classes.of(np.maximum(sizes, 1))
    value = mix(hashes ^ M2)
    for below in (0, 1):
        level = own - below
        slices = np.where((level >= 0) & (sizes > 0), classes.slices[np.maximum(level, 0)], 0)
        begins = np.cumsum(slices) - slices
        each = np.repeat(slices, sizes)
        dealt = mix(hashes + np.repeat(np.maximum(level, 0).astype(np.uint64) * M2, sizes)) >> np.uint64(32)
        # Multiplied and shifted, a hash falls into a slice without a division.
        key = np.repeat(begins, sizes) + (dealt * each.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        used = each > 0
        key, values = (key, value) if used.all() else (key[used], value[used])
        total = np.zeros(int(slices.sum()), dtype=np.uint64)
        np.add.at(total, key, values)
        filled = np.bincount(key, minlength=len(total))
        of = np.repeat(np.arange(len(sizes)), slices)
        # Parts of up to ``least`` shingles are left out: the most for which there are no more than spare ones.
        spare, least = classes.spare[np.maximum(level, 0)], np.full(len(sizes), -1)
        for size in range(6):
            few = np.bincount(of[filled <= size], minlength=len(sizes))
            least = np.where((few <= spare) & (least == size - 1), size, least)
        sent = filled > least[of]
        number = np.arange(len(total)) - begins[of]
        name = mix(total + mix(number.astype(np.uint64) * M1 + level[of].astype(np.uint64)))
        out.append(name[sent])
        owners.append(of[sent])
    return np.concatenate(out), np.concatenate(owners)


def _points(row: dict, n: int) -> Iterator[tuple]:
    hashes, sizes = shingle_sets(*block_words(row), n)
    one, two = set_keys(hashes, sizes)
    yield from zip([row["block"]] * len(sizes), range(len(sizes)), row["ids"], sizes.tolist(), one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True)


def _ask(row: dict, n: int, percent: int, parts: int) -> Iterator[tuple]:
    """Cells and their points, packed for each range of cells."""
    hashes, sizes = shingle_sets(*block_words(row), n)
    one, _ = set_keys(hashes, sizes)
    _, first = np.unique(one, return_index=True)
    chosen = np.zeros(len(sizes), dtype=bool)
    chosen[first] = True
    names, owner = cells(hashes[np.repeat(chosen, sizes)], sizes * chosen, percent)
    order = np.argsort(names)
    names, point = names[order], one[owner[order]]
    at = ranges_of(names, parts)
    for part in np.flatnonzero(np.diff(at)).tolist():
        own = slice(at[part], at[part + 1])
        payload = pack_sorted(names[own])
        yield part, row["block"], len(payload).to_bytes(8, "little") + payload + point[own].tobytes()


def _stars(part: int, rows: list[dict]) -> Iterator[tuple]:
    """(centre, other point) for each cell with several points; some STAR_KEYS of the cells' points at a time."""
    names, points = [], []
    while rows:
        payload = rows.pop()["payload"]
        size = int.from_bytes(payload[:8], "little")
        names.append(unpack_sorted(payload[8 : 8 + size]))
        points.append(np.frombuffer(payload, dtype=np.int64, offset=8 + size))
    low, high = min(int(n[0]) for n in names), max(int(n[-1]) for n in names)
    slices = 1 + sum(map(len, names)) // STAR_KEYS
    edges = np.array([low + (high - low) * i // slices for i in range(slices)], dtype=np.uint64)
    at = [np.append(np.searchsorted(n, edges), len(n)) for n in names]
    for i in range(slices):
        name = np.concatenate([n[e[i] : e[i + 1]] for n, e in zip(names, at, strict=True)])
        point = np.concatenate([p[e[i] : e[i + 1]] for p, e in zip(points, at, strict=True)])
        yield from map(tuple, _stars_of(name, point).tolist())


def _stars_of(name: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Distinct rows (least point of a cell, other point of it)."""
    order = np.argsort(name)
    name, point = name[order], point[order]
    first = np.ones(len(name), dtype=bool)
    first[1:] = name[1:] != name[:-1]
    least = np.minimum.reduceat(point, np.flatnonzero(first))[np.cumsum(first) - 1] if len(name) else point
    differ = least != point
    stars = np.stack((least[differ], point[differ]), axis=1)
    stars = stars[np.lexsort((stars[:, 1], stars[:, 0]))]
    new = np.ones(len(stars), dtype=bool)
    new[1:] = (stars[1:] != stars[:-1]).any(axis=1)
    return stars[new]


def _wanted(block: dict, rows: list[dict], n: int) -> Iterator[tuple]:
    if rows:
        hashes, sizes = shingle_sets(*block_words(block), n)
        begins = np.cumsum(sizes) - sizes
        for r in rows:
            i = r["position"]
            yield r["region"], r["point"], r["shingles"], r["n"], pack_sorted(hashes[begins[i] : begins[i] + sizes[i]])


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


class Roots:
    """Union and find."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, i: int) -> int:
        root = self.root
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        self.root[b] = a
        return a != b


class Region:
    """The members of a region in memory: finds links that join all that its links join."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.edge = percent, 1 - percent / 100 + SLACK
        self.sizes = np.array([len(s) for s in sets])
        values, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        shared = count[number] > 1
        self.values, self.shingle = len(values), number[shared]
        self.at = np.searchsorted(owner[shared], np.arange(len(sets) + 1))
        self.roots, self.links = Roots(), []

    def distances(self, members: np.ndarray, to: int) -> np.ndarray:
        """Distances of members to a point; those that link with it are joined."""
        mark = np.zeros(self.values, dtype=bool)
        mark[self.shingle[self.at[to] : self.at[to + 1]]] = True
        size = self.at[members + 1] - self.at[members]
        edge = np.concatenate(([0], np.cumsum(size)))
        taken = np.arange(edge[-1]) + np.repeat(self.at[members] - edge[:-1], size)
        total = np.concatenate(([0], np.cumsum(mark[self.shingle[taken]])))
        common = total[edge[1:]] - total[edge[:-1]]
        a, b = self.sizes[members], self.sizes[to]
        for i in members[linked(common, a, b, self.percent)].tolist():
            if self.roots.join(i, to):
                self.links.append((to, i))
        return 1 - common / (a + b - common)

    def _open(self, points: np.ndarray, anchor: int) -> np.ndarray:
        settled = self.roots.find(anchor)
        return points[[self.roots.find(i) != settled for i in points.tolist()]]

    def solve(self, centre: int) -> list[tuple[int, int]]:
        """Links (a, b), at most one less than there are members.

        What is joined to the centre is settled, so of two points that end up apart one at
        least is open throughout, and meets the other where the windows let it.
        """
        members = np.arange(len(self.sizes))
        distance = self.distances(members, centre)
        work = [(members, distance, self._open(members, centre))]
        while work:
            members, distance, open_ = work.pop()
            if len(open_) * len(members) > LEAF * LEAF and len(open_) > 2 * PIVOTS:
                pivots, table_, near = [], [], None
                for _ in range(PIVOTS):  # the next pivot is the open point farthest from all before it
                    pivot = int(open_[0 if near is None else near[np.searchsorted(members, open_)].argmax()])
                    pivots.append(pivot)
                    table_.append(self.distances(members, pivot))
                    near = table_[-1] if near is None else np.minimum(near, table_[-1])
                rest = self._open(open_[~np.isin(open_, pivots)], centre)
                grid = np.stack(table_)
                nearest = grid[:, np.searchsorted(members, rest)].argmin(axis=0) if len(rest) else np.zeros(0, np.int64)
                parts = []
                for cell in np.unique(nearest).tolist():
                    own, to = rest[nearest == cell], grid[cell]
                    at = to[np.searchsorted(members, own)]
                    inside = (to >= at.min() - self.edge) & (to <= at.max() + self.edge)
                    parts.append((members[inside], to[inside], own))
                if sum(len(m) * len(o) for m, _, o in parts) <= SHRINK * len(open_) * len(members):
                    work += parts
                    continue
                open_ = rest
            own = distance[np.searchsorted(members, open_)]
            for i, d in zip(open_.tolist(), own.tolist(), strict=True):
                self.distances(members[np.abs(distance - d) <= self.edge], i)
        return self.links


def _solve_regions(group: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    regions: dict[int, list[tuple]] = {}
    for row in zip(*(group.column(n).to_pylist() for n in ("region", "point", "data")), strict=True):
        regions.setdefault(row[0], []).append(row)
    for region, rows in regions.items():
        points = [point for _, point, _ in rows]
        links = Region([unpack_sorted(data) for _, _, data in rows], percent).solve(points.index(region) if region in points else 0)
        for a, b in links:
            yield points[a], points[b]


DISTANCES = T.StructType().add("region", T.LongType()).add("point", T.LongType()).add("nearest", T.LongType()).add("buckets", T.ArrayType(T.LongType())).add("distances", T.ArrayType(T.DoubleType())).add("links", T.ArrayType(T.LongType()))


def _distances(members: pa.Table, pivots: pa.Table, percent: int, links_only: bool) -> Iterator[tuple]:
    """Rows of DISTANCES: nearest pivot, distances to all pivots and links found.

    With ``links_only``, links alone, and of them no more than join what all would join.
    """
    rows, centres = members.to_pylist(), sorted(pivots.to_pylist(), key=lambda r: r["bucket"])
    sets, buckets = [unpack_sorted(r["data"]) for r in [*rows, *centres]], [r["bucket"] for r in centres]
    region, own, roots = Region(sets, percent), np.arange(len(rows)), Roots()
    grid = np.stack([region.distances(own, len(rows) + j) for j in range(len(centres))], axis=1)
    hit = grid <= region.edge
    for i, row in enumerate(rows):
        links = [centres[j]["point"] for j in np.flatnonzero(hit[i])]
        if not links_only:
            yield row["region"], row["point"], buckets[int(grid[i].argmin())], buckets, grid[i].tolist(), links
        elif joins := [point for point in links if roots.join(row["point"], point)]:
            yield row["region"], row["point"], None, [], [], joins


def _measure(rows, members: pa.Table, pivots: pa.Table) -> pa.Table:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(DISTANCES)
    found = rows(members, pivots) if members.num_rows and pivots.num_rows else iter(())
    return pa.Table.from_batches(list(_batches(found, arrow)), schema=arrow)


def _join_large(members: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) that join the points of large regions.

    members: region (its centre), point, shingles of the region, n of the point, data. The sets
    move once a round, to the chunk where they are measured; all else is numbers.
    """
    spark, edge = members.sparkSession, 1 - percent / 100 + SLACK
    links = spark.createDataFrame([], EDGE)
    data = materialise(members.groupBy("point").agg(F.first("data").alias("data")), "large-sets", size)
    # What this round measures: the points with their chunks.
    places = materialise(salted(members.select("region", F.col("region").alias("origin"), "point", "n", "shingles", F.lit(True).alias("open"))), "places")
    before = None
    while True:
        opened = materialise(places.groupBy("region").agg(F.count_if("open").alias("n"), F.count(F.lit(1)).cast("double").alias("members")), "opened")
        most, pairs = opened.agg(F.max("n"), F.sum(F.col("n") * F.col("members"))).first()
        last = most <= PIVOTS_AT_ONCE or (before is not None and pairs > SHRINK * before)
        before = pairs
        # All open points, or the least of each bucket of them; combined before the shuffle.
        bucket = F.col("point") if last else F.pmod(F.xxhash64("point", F.lit(2)), F.lit(PIVOTS))
        chosen = places.filter("open").groupBy("region", bucket.alias("bucket")).agg(F.min("point").alias("point"), F.max("salts").alias("salts"))
        pivots = materialise(chosen, "pivots")
        sets = materialise(data.join(pivots, "point").select("region", "bucket", "point", "salts", "data"), "pivot-sets", size)
        early = most > PIVOTS_AT_ONCE if last else False
        wide = WIDE if early else 1
        dealt = sets.select("region", "bucket", "point", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("salts") - 1) / wide))).alias("salt"))
        chunks = places.select("region", "point", F.floor(F.col("salt") / wide).alias("salt")).join(data, "point")
        keys = ["region", "salt"]
        if early:  # each chunk meets each block of pivots
            blocks = opened.filter(F.col("n") > PIVOTS_AT_ONCE).select("region", F.ceil(F.col("n") / PIVOTS_AT_ONCE).alias("blocks"))
            count = F.coalesce("blocks", F.lit(1).cast("long"))
            dealt = dealt.join(blocks, "region", "left").withColumn("block", F.pmod(F.xxhash64("bucket", F.lit(3)), count))
            chunks = chunks.join(blocks, "region", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
            keys.append("block")
        dealt, chunks = dealt.select(*keys, "bucket", "point", "data"), chunks.select(*keys, "point", "data")
        rows = partial(_distances, percent=percent, links_only=last)
        measured = materialise(chunks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(partial(_measure, rows), DISTANCES), "distances", size)
        found = measured.select(F.explode("links").alias("a"), F.col("point").alias("b")).filter("a <> b")
        links = materialise(links.unionByName(found), "links")
        if last:
            return links
        # What isn't joined to the centre of its first region, and was no pivot, stays open.
        roots = components(links)
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        state = measured.select("region", "point", "nearest", F.explode(F.arrays_zip("buckets", "distances")).alias("z")).select("region", "point", "nearest", "z.buckets", "z.distances")
        known = places.select("region", "origin", "point", "n", F.col("open").alias("was_open"))
        known = known.join(of("point"), "point", "left").join(of("origin"), "origin", "left")
        known = known.join(pivots.select("region", "point", F.lit(True).alias("pivot")), ["region", "point"], "left")
        apart = F.coalesce("point_root", "point") != F.coalesce("origin_root", "origin")
        known = materialise(known.select("region", "origin", "point", "n", (F.col("was_open") & apart & F.col("pivot").isNull()).alias("stays")), "known")
        state = state.join(known, ["region", "point"]).withColumn("open", F.col("stays") & (F.col("nearest") == F.col("buckets"))).drop("stays", "nearest")
        state = materialise(state, "state", size)
        window = materialise(state.filter("open").groupBy("region", "buckets").agg(F.min("distances").alias("low"), F.max("distances").alias("high")), "windows")
        inside = state.join(window, ["region", "buckets"]).filter((F.col("distances") >= F.col("low") - edge) & (F.col("distances") <= F.col("high") + edge))
        next_ = materialise(inside.select(F.xxhash64("region", "buckets").alias("region"), "origin", "point", "n", "open"), "regions", size)
        discard(measured, state, window, sets, pivots)
        if next_.isEmpty():
            return links
        sized = materialise(next_.groupBy("region").agg(F.sum("n").alias("shingles")), "region-sizes")
        places = materialise(salted(next_.join(sized, "region")), "places", size)


def salted(points: DataFrame) -> DataFrame:
    """Deals each region's points over ``salts`` chunks of about CHUNK_SHINGLES."""
    salts = F.ceil(F.col("shingles") / CHUNK_SHINGLES)
    return points.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("point", F.lit(1)), salts))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of at most as many equal ranges, a power of two."""
    bits = max(len(hashes), 1).bit_length() - 1
    return np.bincount((hashes >> np.uint64(64 - OWNER_BITS - bits)).astype(np.int64), minlength=1 << bits)


def near(sketches: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may link with another: two sets have no more in common than their ranges' lesser counts."""
    ranges = min(map(len, sketches))
    counts = np.stack([x.reshape(ranges, -1).sum(axis=1) for x in sketches]).astype(np.int32)
    found = np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes) - 1):
        common = np.minimum(counts[i + 1 :], counts[i]).sum(axis=1)
        hit = linked(common, sizes[i + 1 :], sizes[i], percent)
        found[i + 1 :] |= hit
        found[i] |= hit.any()
    return found


def _sketches(block: dict, rows: list[dict], n: int) -> Iterator[tuple]:
    if rows:
        hashes, sizes = shingle_sets(*block_words(block), n)
        begins, made = np.cumsum(sizes) - sizes, {}
        for r in rows:
            i = r["position"]
            if i not in made:
                made[i] = pack_ints(sketch(hashes[begins[i] : begins[i] + sizes[i]]))
            yield r["region"], r["point"], int(sizes[i]), made[i]


def _near_members(group: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    regions: dict[int, list[tuple]] = {}
    for row in zip(*(group.column(n).to_pylist() for n in ("region", "point", "n", "data")), strict=True):
        regions.setdefault(row[0], []).append(row)
    for region, rows in regions.items():
        kept = near([unpack_ints(data) for _, _, _, data in rows], np.array([n for _, _, n, _ in rows]), percent)
        for i in np.flatnonzero(kept).tolist():
            yield region, rows[i][1]


def _near(blocks: DataFrame, placed: DataFrame, *, shingle: int, percent: int, size: int) -> DataFrame:
    """The rows of placed without points that can't link with any member of the region.

    Sketches take a byte for some shingles, sets some bytes for each. Regions of over SKETCHED
    members stay whole.
    """
    members = placed.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    counted = materialise(placed.join(members, "region"), "placed-counted", size)
    few = counted.filter(F.col("members") <= SKETCHED)
    row = T.StructType().add("region", T.LongType()).add("point", T.LongType()).add("n", T.LongType()).add("data", T.BinaryType())
    made = finish(blocks, few.select("at.block", "at.position", "point", "region"), row, lambda block, rows: _sketches(block, rows, shingle))
    pair = T.StructType().add("region", T.LongType()).add("point", T.LongType())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        yield from _batches(_near_members(pa.Table.from_batches(list(batches)), percent), to_arrow_schema(pair))

    buckets = max(16, -(-(few.agg(F.sum("n")).first()[0] or 0) // RANGE_BYTES))
    kept = materialise(made.groupBy(F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket")).applyInArrow(compare, pair), "near", size)
    columns = placed.columns
    return few.join(kept, ["region", "point"]).select(columns).unionByName(counted.filter(F.col("members") > SKETCHED).select(columns))


def _links(blocks: DataFrame, placed: DataFrame, *, shingle: int, percent: int, most: int, size: int) -> DataFrame:
    """Links (a, b) that join all that links within a region join; placed: region, point, at, n of the point."""
    spark = placed.sparkSession
    sized = placed.groupBy("region").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    wanted = placed.join(sized, "region").select("at.block", "at.position", "point", "region", "n", "shingles")
    set_row = T.StructType().add("region", T.LongType()).add("point", T.LongType()).add("shingles", T.LongType()).add("n", T.LongType()).add("data", T.BinaryType())
    members = materialise(finish(blocks, wanted, set_row, lambda block, rows: _wanted(block, rows, shingle)), "members", size)
    in_task, total = F.col("shingles") <= most, members.agg(F.sum(F.when(F.col("shingles") <= most, F.col("n"))), F.max("shingles")).first()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        yield from _batches(_solve_regions(pa.Table.from_batches(list(batches)), percent), to_arrow_schema(EDGE))

    buckets = max(16, -(-8 * (total[0] or 0) // RANGE_BYTES))
    small = members.filter(in_task).select("region", "point", "data", F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket"))
    links = materialise(small.groupBy("bucket").applyInArrow(solve, EDGE), "links", size)
    if total[1] is not None and total[1] > most:
        links = links.unionByName(_join_large(members.filter(~in_task), percent, size))
    discard(members)
    return links


def _undecided(placed: DataFrame, first: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """The rows of placed whose region has points that are neither joined nor were compared.

    Points that share their first region were compared there, and what links join needs no more
    of them. Where a region's points differ in both, two of them do.
    """
    roots = components(links).withColumnRenamed("node", "point")
    known = materialise(first.join(roots, "point", "left").select("point", "first", F.coalesce("root", "point").alias("root")), "known-points", size)
    ends = placed.join(known, "point").groupBy("region").agg(*[f(c).alias(f"{n}_{c}") for c in ("first", "root") for n, f in (("low", F.min), ("high", F.max))])
    return placed.join(ends.filter("low_first < high_first AND low_root < high_root").select("region"), "region")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, region_shingles: int | None = None) -> DataFrame:
    """id, n_shingles and component_id (the least id that links reach) for each document."""
    spark, size = docs.sparkSession, input_bytes(docs)
    parts, tasks, most = exchange_ranges(size), width(docs.sparkSession, size), REGION_SHINGLES if region_shingles is None else region_shingles
    blocks = write_coded(docs, id_col, text_col, "jaccard-words")
    id_type = blocks.schema["ids"].dataType.elementType
    point_row = T.StructType().add("block", T.LongType()).add("position", T.IntegerType()).add("id", id_type).add("n_shingles", T.LongType()).add("point", T.LongType()).add("check", T.LongType())
    points = materialise(send(blocks, lambda row: _points(row, shingle), point_row), "points", size)
    classes = points.filter("n_shingles > 0").groupBy("point", "check").agg(F.min("id").alias("least"), F.min(F.struct("block", "position")).alias("at"), F.max("n_shingles").alias("n"))
    classes = materialise(classes, "classes", size)
    stars = materialise(answer(send(blocks, lambda row: _ask(row, shingle, percent, parts)), EDGE, _stars).distinct(), "stars", size)

    centres = stars.select(F.col("a").alias("region"), F.col("a").alias("point")).distinct()
    placed = stars.select(F.col("a").alias("region"), F.col("b").alias("point")).unionByName(centres).join(classes.select("point", "at", "n"), "point")
    placed = materialise(placed, "placed", size)
    candidates = placed
    placed = materialise(_near(blocks, candidates, shingle=shingle, percent=percent, size=size), "placed-near", size)
    solve = partial(_links, blocks, shingle=shingle, percent=percent, most=most, size=size)
    # Each point in its largest region, which joins most of what links; then the regions that this leaves open.
    members = placed.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    first = placed.join(members, "region").groupBy("point").agg(F.max(F.struct("members", "region"))["region"].alias("first"))
    first = materialise(first, "first-regions", size)
    links = solve(materialise(placed.join(first, "point").filter("region = first").drop("first"), "placed-once", size))
    rest = materialise(_undecided(placed, first, links, size), "placed-again", size)
    links = links.unionByName(solve(rest))
    roots = components(links)
    discard(blocks, stars, candidates, placed, first, rest)
    joined = classes.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    joined = materialise(joined.select("point", "check", "root", "least"), "class-roots", size)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(joined.join(least, "root").select("point", "check", "component_id"), "class-components", size)
    found = points.filter("n_shingles > 0").join(named, ["point", "check"]).select(F.col("id").alias(id_col), "n_shingles", "component_id")
    return found.unionByName(points.filter("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"))).coalesce(tasks)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id names their component, with the columns of docs.

    Those that go are fewer than those that stay, so they are what docs is joined with.
    """
    found = join(docs, id_col=id_col, text_col=text_col, **options)
    stays = F.max(F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = found.groupBy(F.col(id_col).alias("__gs_id")).agg(stays.alias("__gs_stays")).filter(~F.col("__gs_stays")).select("__gs_id")
    gone = materialise(gone, "gone", input_bytes(docs))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gs_id")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document with its component."""
    return join(table(spark, sf_dir, "documents"))
