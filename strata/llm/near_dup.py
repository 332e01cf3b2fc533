"""MinHash near-dedup (5): an inverted join over the coordinates of the signatures.

1. A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets form a class; one
   member stands for it in all that follows, so copies never meet in pairs.
2. A class is posted under each of its `COORDINATES` (coordinate, value) pairs. Similar sets agree in at least `matches`
   coordinates (the bound is set so that a pair at the threshold misses it with probability below 1e-7). Postings that stand
   alone are skipped, and so are classes with fewer than `matches` postings left: they have no partner.
3. Prefix: two sets that agree in m coordinates share a posting among the rarest s - m + 1 of either's s
   postings, whatever the order as long as it is the same. Only those form lists; the hot ones come last in the order.
4. In a list, members are compared with a leader, chosen anew per list and round by a hash (a member with a few of the
   leaders of its lists); a pair's collisions are counted on
   the signatures, and those with `matches` or more put both into one cluster. Pairs of a list that still lie in different
   clusters after the rounds are compared as well, so every link lies inside a cluster.
5. The pairs with their leaders are confirmed on the full sets, which gives the components so far: in a group of near copies most
   members are near some leader. What is left of a cluster is compared with all of the cluster, in blocks of bounded size: a task
   takes two blocks, counts the common hashes of all their pairs by a product of incidence matrices, and gives only the links that
   join components. No pair that is compared becomes a row.

So a group costs pairs in proportion to its members, and block work for those that no leader caught.

Defined results: no word (or a null text) gives an empty set, linked with nothing; fewer words than a shingle count
as one shingle; rows that repeat an id or a text are documents of their own; a null id is larger than any id. Documents
are found again by file and place in the stored table (checked by the fingerprint of the set); a frame that is none is stored
first. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import counted, cut, fresh, numbered, stored, text_batches
from strata.llm.components import components

COORDINATES = 64
SHINGLE = 5
PERCENT = 80
LEADER_ROUNDS = 2
#: Leaders that a member is compared with in a round, of those of its lists.
LEADERS = 8
#: Hashes, and sets, that a block of sets has on average at most.
BLOCK_HASHES = 100_000
BLOCK_SETS = 1000
#: Members that a block of a list has on average at most, and cells of a comparison that a task holds at once.
LIST_BLOCK = 1000
_CELLS = 1 << 18
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEYS = np.random.default_rng(20240501).integers(0, 2**64, (2, COORDINATES), np.uint64) | np.array([[0], [1]], np.uint64)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = 1e-7) -> int:
    """The largest number of matches that a pair of similarity `percent` misses with probability below `miss`."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(k, 1)
    return coordinates


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased."""
    words = _WORDS.findall(text.encode().lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    s = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(31))) * _STEP + h[i : i + len(s)]
    s = (s ^ (s >> np.uint64(32))) * _STEP
    return np.unique(s ^ (s >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = ((hashes[at : at + 2048, None] ^ _KEYS[0]) * _KEYS[1]) >> np.uint64(32)
        np.minimum(low, mixed.min(axis=0), out=low)
    return low.astype(np.uint32)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text_batches(docs.sparkSession)
    row = fresh(docs, "__row")
    return numbered(docs, row).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(row).alias("row"))


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, row, n (set size), fp (fingerprint of the set) and sig of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "row", "n", "fp", "sig"],
            )

    return _numbered(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, row bigint, n bigint, fp binary, sig binary")


def postings(classes: DataFrame) -> DataFrame:
    """token, node, n: a token is the coordinate in the high half and its value in the low half."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [pa.array((values + high).ravel()), *(pa.array(np.repeat(batch.column(i).to_numpy(), COORDINATES)) for i in (0, 1))],
                ["token", "node", "n"],
            )

    return classes.select("node", "n", "sig").mapInArrow(work, "token bigint, node bigint, n bigint")


def prefix_lists(classes: DataFrame, matches: int) -> DataFrame:
    """The lists (token, node, n) in which every pair with `matches` collisions meets at least once."""
    posted = postings(classes)
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("found")).where("found > 1")
    kept = cut(posted.join(shared, "token"), "postings")
    enough = kept.groupBy("node").agg(F.count(F.lit(1)).alias("left")).where(F.col("left") >= matches)
    by_node = Window.partitionBy("node").orderBy("found", "token")
    prefix = kept.join(enough, "node").withColumn("place", F.row_number().over(by_node)).where(F.col("place") <= F.col("left") - matches + 1)
    prefix = cut(prefix.select("token", "node", "n"), "prefixes")
    meets = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("token")
    return cut(prefix.join(meets, "token"), "lists")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def colliding(pairs: DataFrame, members: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least `matches` coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    left = members.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = members.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 |A and B| >= percent |A or B|."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a bigint, b bigint")


def full_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node and hashes of the classes in `members`, read again from the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            if [xxhash.xxh3_128_digest(s) for s in sets] != batch.column(2).to_pylist():
                raise ValueError("the rows of the input changed their places between two scans")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    wanted = members.select("node", "fp")
    rows = _numbered(docs, id_col, text_col).withColumnRenamed("row", "node").join(wanted, "node")
    return rows.select("node", "text", "fp").mapInArrow(work, "node bigint, hashes binary")


def list_hits(lists: DataFrame, members: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a list's members (token, node, n, comp) in different clusters whose signatures agree in `matches` coordinates.

    The cluster with most members of a list is settled in itself there; every other member is compared with all of the list. Both sides
    are cut into blocks of about `LIST_BLOCK` members; a task compares two blocks and gives only the hits.
    """
    sizes = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("found"))
    blocks = sizes.groupBy("token").agg(F.max_by("comp", F.struct("found", "comp")).alias("main"), F.sum("found").alias("all"), F.max("found").alias("most")).select(
        "token", "main", F.ceil((F.col("all") - F.col("most")) / LIST_BLOCK).cast("int").alias("lines"), F.ceil(F.col("all") / LIST_BLOCK).cast("int").alias("columns")
    )
    dealt = lists.join(blocks.where("lines > 0"), "token").join(members.select("node", "sig"), "node")
    spot = F.xxhash64("node", "token")
    line, column = F.pmod(spot, F.col("lines")).cast("int"), F.pmod(spot, F.col("columns")).cast("int")
    every = {n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("lines", "columns")}
    left = dealt.where("comp <> main").select("token", line.alias("i"), every["columns"].alias("j"), F.lit(0).alias("side"), "node", "n", "comp", "sig")
    right = dealt.select("token", every["lines"].alias("i"), column.alias("j"), F.lit(1).alias("side"), "node", "n", "comp", "sig")
    key = ["token", "i", "j"]
    ordered = left.unionByName(right).repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, "side")

    def compare(table: pa.Table) -> list[np.ndarray]:
        """Hits of the rows of one pair of blocks."""
        side, node, n, comp = (table.column(c).to_numpy() for c in ("side", "node", "n", "comp"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        step = max(1, _CELLS // max(1, len(right)))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            small, large = np.minimum(n[some, None], n[right]), np.maximum(n[some, None], n[right])
            x, y = np.nonzero((comp[some, None] != comp[right]) & (100 * small >= percent * large))
            x, y = some[x], right[y]
            for lo in range(0, len(x), _CELLS // 8):
                a, b = x[lo : lo + _CELLS // 8], y[lo : lo + _CELLS // 8]
                hit = (sig[a] == sig[b]).sum(axis=1) >= matches
                out.append(np.stack([np.minimum(node[a], node[b])[hit], np.maximum(node[a], node[b])[hit]]))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(table: pa.Table, all_of_it: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """Hits of the groups that are whole, and the rows of the last group where it may go on."""
            keys = [table.column(k).to_numpy() for k in key]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            edges = [*np.flatnonzero(new).tolist(), *([table.num_rows] if all_of_it else [])]
            out = [h for a, b in zip(edges, edges[1:], strict=False) if b - a > 1 for h in compare(table.slice(a, b - a))]
            both = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"]), table.slice(edges[-1])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                hits, rest = found(table if rest is None else pa.concat_tables([rest, table]).combine_chunks(), False)
                yield hits
        if rest is not None:
            yield found(rest, True)[0]

    return ordered.mapInArrow(work, "a bigint, b bigint").distinct()


def clusters_of(lists: DataFrame, members: DataFrame, matches: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Collisions found with leaders, and node, comp of the clusters that hold every pair of a list with enough collisions."""
    hits, clusters, tested = None, None, None
    for step in range(LEADER_ROUNDS + 1):
        placed = lists.withColumn("comp", F.col("node")) if clusters is None else lists.join(clusters, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        placed, open_rows = counted(placed.join(mixed, "token"), "mixed")
        if not open_rows:
            break
        if step < LEADER_ROUNDS:
            rank = F.xxhash64("token", "node", F.lit(step))
            leader = placed.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "comp")).alias("first"))
            other = leader.select("token", F.col("first.node").alias("node2"), F.col("first.n").alias("n2"), F.col("first.comp").alias("comp2"))
            met = placed.join(other, "token").where("comp <> comp2").select("node", "n", "node2", "n2").distinct()
            # A few leaders per member and round; what they miss is left to the comparisons that follow, which leave out nothing.
            chosen = Window.partitionBy("node").orderBy(F.xxhash64("node", "node2"), "node2")
            met = met.withColumn("place", F.row_number().over(chosen)).where(F.col("place") <= LEADERS)
        else:
            new, collisions = counted(list_hits(placed, members, matches, percent), "collisions")
            if collisions:
                hits = new if hits is None else hits.unionByName(new)
                clusters = components(hits)
            break
        pairs = met.where(_sizes_fit(F.col("n"), F.col("n2"), percent)).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new, collisions = counted(colliding(pairs, members, matches), "collisions")
        if collisions:
            hits = new if hits is None else hits.unionByName(new)
            clusters = components(hits)
    return hits, clusters


def _common(a: list[bytes], b: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of each set of `a` with each of `b`, in strips of lines: the first line and its strip.

    A strip has `_CELLS` cells at most, and an incidence matrix at most eight times as many.
    """
    flat = [np.frombuffer(s, np.uint64) for s in (*a, *b)]
    owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    values, at = np.unique(np.concatenate(flat), return_inverse=True)
    left = owner < len(a)
    both = (np.bincount(at[left], minlength=len(values)) > 0) & (np.bincount(at[~left], minlength=len(values)) > 0)
    column = np.cumsum(both) - 1
    kept = both[at]
    owner, at = owner[kept], column[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    wide = max(1, 8 * _CELLS // max(1, len(b)))
    step = max(1, _CELLS // max(1, len(b)))
    for first in range(0, len(a), step):
        lines = min(step, len(a) - first)
        out = np.zeros((lines, len(b)), np.float32)
        for lo in range(0, int(both.sum()), wide):
            here = slice(*np.searchsorted(at, [lo, lo + wide]))
            who, spot = owner[here], at[here] - lo
            mine, theirs = (who >= first) & (who < first + lines), who >= len(a)
            if mine.any():
                x, y = np.zeros((lines, wide), np.float32), np.zeros((len(b), wide), np.float32)
                x[who[mine] - first, spot[mine]] = 1
                y[who[theirs] - len(a), spot[theirs]] = 1
                out += x @ y.T
        yield first, out.astype(np.int32)


def block_links(clusters: DataFrame, comps: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within each cluster.

    The largest component of a cluster is taken as settled in itself; every other member is compared with all of the cluster.
    """
    named = clusters.select("node", F.col("comp").alias("cluster"))
    roots = named.select(F.col("cluster").alias("node"), "cluster").distinct()
    rows = named.unionByName(roots).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(members.select("node", "n"), "node")
    rows = cut(rows, "clusters")
    sizes = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("found"), F.sum("n").alias("hashes"))
    largest = sizes.groupBy("cluster").agg(
        F.max_by("comp", F.struct("found", "comp")).alias("main"), F.sum("hashes").alias("hashes"), F.count(F.lit(1)).alias("parts"),
        F.sum("found").alias("sets"), (F.sum("found") - F.max_by("found", F.struct("found", "comp"))).alias("other_sets"),
        (F.sum("hashes") - F.max_by("hashes", F.struct("found", "comp"))).alias("others"),
    ).where("parts > 1")
    blocks = largest.select(
        "cluster", "main",
        F.ceil(F.greatest(F.col("hashes") / BLOCK_HASHES, F.col("sets") / BLOCK_SETS)).cast("int").alias("columns"),
        F.ceil(F.greatest(F.col("others") / BLOCK_HASHES, F.col("other_sets") / BLOCK_SETS)).cast("int").alias("lines"),
    )
    dealt = rows.join(blocks, "cluster").join(sets, "node")
    spot = F.xxhash64("node")
    line, column = F.pmod(spot, F.col("lines")).cast("int"), F.pmod(spot, F.col("columns")).cast("int")
    every = [F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1]) for n in ("lines", "columns")]
    left = dealt.where("comp <> main").select("cluster", "node", "comp", "hashes", line.alias("line"), every[1])
    # Aliases tell the two sides of the same table apart.
    right = dealt.select(*[F.col(c).alias(c) for c in ("cluster", "node", "comp", "hashes")], every[0], column.alias("column"))
    key = ["cluster", "line", "column"]

    def work(lines: pa.Table, columns: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if lines.num_rows and columns.num_rows:
            x, y = (t.column("hashes").to_pylist() for t in (lines, columns))
            n, m = (np.array([len(s) // 8 for s in side], np.int64) for side in (x, y))
            own, other = (t.column("comp").to_numpy() for t in (lines, columns))
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            nodes, others = (t.column("node").to_numpy() for t in (lines, columns))
            for first, common in _common(x, y):
                part = slice(first, first + len(common))
                # 100 * common >= percent * (n + m - common)
                linked = (100 + percent) * common >= percent * (n[part, None] + m)
                for i, j in np.argwhere(linked & (own[part, None] != other)):
                    p, q = root(int(own[first + i])), root(int(other[j]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((int(nodes[first + i]), int(others[j])))
        a, b = [min(f) for f in found], [max(f) for f in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, "a bigint, b bigint")


def link_classes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """node, comp of the classes that are linked with another one (but the first of each component)."""
    matches = least_matches(percent)
    lists = prefix_lists(classes, matches)
    members = cut(classes.join(lists.select("node").distinct(), "node", "left_semi"), "members")
    hits, clusters = clusters_of(lists, members, matches, percent)
    if hits is None:
        return classes.select("node", F.col("node").alias("comp")).limit(0)
    met = members.join(hits.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    sets = cut(full_sets(docs, met, id_col, text_col, shingle), "sets")
    edges = cut(confirmed(hits, sets, percent), "links")
    rest = cut(block_links(clusters, components(edges), members, sets, percent), "links")
    return components(edges.unionByName(rest))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id (smallest id of its component) and first (one row of each component)."""
    docs = stored(docs)
    sketched = cut(sketch(docs, id_col, text_col, shingle), "sketches")
    classes = cut(
        sketched.where("n > 0").groupBy("fp").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    links = link_classes(docs, classes, id_col, text_col, shingle, percent)
    named = classes.select("fp", "node").join(links, "node", "left").select("fp", F.coalesce("comp", "node").alias("comp"))
    rows = sketched.select("doc_id", "row", "n", "fp").join(named, "fp", "left")
    rows = cut(rows.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("row")).alias("comp")), "documents")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = rows.groupBy("comp").agg(F.min(best).alias("best"))
    return rows.join(stays, "comp").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("first")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each component and all its columns."""
    docs = stored(docs)
    row = fresh(docs, "__row")
    stays = near_components(docs, id_col, text_col, shingle, percent).where("first").select(F.col("row").alias(row))
    return numbered(docs, row).join(stays, row, "left_semi").drop(row)
