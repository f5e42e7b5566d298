"""Exact self-join of documents by the Jaccard similarity of their word shingles.

The work goes in three parts, none of which lists the pairs of a group.

1. *Rare shingles.* Documents with equal sets are one class. Each class sends
   its shingles of the lowest ``REGION`` of the hash range to buckets. A
   shingle held by up to ``RARE`` classes gives pairs; others are *common*.
   A pair is verified if what it shares here and what it may share beyond can
   reach the similarity. In the order "uncommon low shingles by hash, then all
   others", two similar sets share a shingle of their prefixes, so a class
   whose prefix consists of uncommon low shingles finds all its partners here.
2. *Token groups.* The other classes are held apart. Those with an equal minimum
   hash are verified against hubs, the sets that hold most of what the others
   hold; the components of all links so far are groups of similar documents, and
   no pair within one is looked at again. Among them shingles are counted by groups;
   rarest first, prefixes are posted by shingle. A posting list is cut into
   groups of documents alike in size, each with the union of its members'
   token bits, and a document opens only the groups whose union can hold enough
   of its tokens. What the members' own bits then still allow is verified.
3. *Components* of the groups and the links between them.

Every verification intersects the whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import attach_groups, discard, in_buckets, materialize, partitions, small_batches
from lakeloom.llm.components import components
from lakeloom.llm.shingles import mix, text_shingles

#: The share of the hash range whose shingles are posted in part 1; a prefix needs a quarter of a set.
REGION = 0.34
#: Classes that may hold a shingle of part 1 before it counts as common.
RARE = 16
#: Minimum hashes by which classes meet hubs, hubs of a cell, tokens of a cell, and rounds in which hubs of a cell cut into several meet.
MINIMA, HUBS, HUB_TOKENS, HUB_ROUNDS = 4, 64, 1_000_000, 3
#: Bits of a document's token row, and documents of a token group.
BITS, GROUP = 4096, 64
#: Documents that are compared with a token group at once.
QUERIES = 256
#: Documents in a block of a posting list; longer lists are compared block by block, within reach of their sizes, in different tasks.
LIST_BLOCK = 2048
#: Shingles that a task gathers before it sends them.
FLUSH = 1_500_000

_LOW = np.uint64(int(REGION * 2**64))
_NOBODY = np.int64(-(2**63))



def _sketch(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0) and of posted shingles by bucket (kind 1)."""
    schema = pa.schema(
        [("kind", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("k", pa.int64()), ("low", pa.int64()), ("minima", pa.list_(pa.int64()))]
        + [("bucket", pa.int32()), ("tokens", pa.binary()), ("keys", pa.binary())]
    )
    salts = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    docs: list[tuple] = []
    posted: dict[int, np.ndarray] = {}
    gathered = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal gathered
        keys = np.repeat(np.array(list(posted), np.int64), [len(v) for v in posted.values()])
        tokens = np.concatenate([*posted.values(), np.zeros(0, np.uint64)])
        posted.clear()
        order = np.argsort(tokens, kind="stable")
        tokens, keys = tokens[order], keys[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
        held = np.diff(np.append(first, len(tokens)))
        common = np.repeat(held > RARE, held)
        lost = dict(zip(*(x.tolist() for x in np.unique(keys[common], return_counts=True))))
        rows = [(0, doc, row, n, digest, k, low - lost.get(k, 0), minima) for doc, row, n, digest, k, low, minima in docs]
        columns = list(zip(*rows)) if rows else [[]] * 8
        for at in range(0, len(rows), 2000):
            part = [c[at : at + 2000] for c in columns]
            empty = [pa.nulls(len(part[0]), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(part, schema)), *empty], schema=schema)
        # of a common shingle, only that it is one
        keep = ~common
        keep[first] = True
        keys[common] = _NOBODY
        keys, tokens = keys[keep], tokens[keep]
        del common, keep, first, held
        where = (tokens % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        where, tokens, keys = where[order], tokens[order], keys[order]
        del order
        cuts = np.searchsorted(where, np.arange(buckets + 1))
        for b in range(buckets):
            x, y = cuts[b], cuts[b + 1]
            if y > x:
                row = [[1], *[[None]] * 7, [b], [tokens[x:y].tobytes()], [keys[x:y].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)
        docs.clear()
        gathered = 0

    for batch in batches:
        with np.errstate(over="ignore"):
            sets = text_shingles(batch.column(2), size)
            for doc, row, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets):
                if not len(s):
                    docs.append((doc, row, 0, None, None, 0, None))
                    continue
                digest = hashlib.md5(s.tobytes(), usedforsecurity=False).digest()
                k = int.from_bytes(digest[:8], "little", signed=True)
                low = s[: np.searchsorted(s, _LOW)].copy()  # a view would hold the whole set
                minima = [int(v) for v in mix(s[None, :] ^ salts[:, None]).min(axis=1).view(np.int64)]
                docs.append((doc, row, len(s), digest, k, len(low), minima))
                if k not in posted:
                    posted[k] = low
                    gathered += len(low)
            if gathered > FLUSH:
                yield from flush()
    if docs:
        yield from flush()


SKETCH = "kind int, doc long, row long, n long, digest binary, k long, low long, minima array<long>, bucket int, tokens binary, keys binary"


def _posted_pairs(table: pa.Table, buckets: int) -> pa.Table:
    """Pairs of classes that share an uncommon shingle, and how many common ones each class has, packed by destination."""
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])])
    tokens, keys = tokens[fresh], keys[fresh]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    held = np.diff(np.append(first, len(tokens)))
    common = (held > RARE) | (keys[first] == _NOBODY)
    pairs = []
    for n in range(2, RARE + 1):
        at = first[(held == n) & ~common]
        if len(at):
            rows = keys[at[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            pairs.append(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], 1))
    pairs, shared = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0, return_counts=True)
    pairs = np.column_stack([pairs, shared])
    busy = keys[np.repeat(common, held)]
    busy, counts = np.unique(busy[busy != _NOBODY], return_counts=True)
    out = []
    for kind, rows in ((0, pairs), (1, np.stack([busy, counts.astype(np.int64)], 1))):
        to = (rows[:, 0].astype(np.uint64) % np.uint64(buckets)).astype(int)
        order = np.argsort(to, kind="stable")
        rows, cuts = rows[order], np.searchsorted(to[order], np.arange(buckets + 1))
        out += [(b, kind, rows[cuts[b] : cuts[b + 1]].tobytes()) for b in range(buckets) if cuts[b + 1] > cuts[b]]
    columns = list(zip(*out)) if out else [[]] * 3
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["dest", "kind", "rows"])


def _gathered(table: pa.Table) -> pa.Table:
    """Pairs (a, b, shared shingles) and classes (a, null, common shingles) of one destination, summed over the buckets."""
    parts: dict[int, list[np.ndarray]] = {0: [np.zeros((0, 3), np.int64)], 1: [np.zeros((0, 2), np.int64)]}
    for kind, rows in zip(table.column("kind").to_pylist(), table.column("rows").to_pylist()):
        parts[kind].append(np.frombuffer(rows, np.int64).reshape(-1, 3 - kind))
    sums = []
    for rows in (np.concatenate(p) for p in parts.values()):
        keys, where = np.unique(rows[:, :-1], axis=0, return_inverse=True)
        sums.append((keys, np.bincount(where.ravel(), rows[:, -1], len(keys)).astype(np.int64)))
    (pairs, shared), (busy, common) = sums
    a = pa.array(np.concatenate([pairs[:, 0], busy[:, 0]]))
    b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(busy), pa.int64())])
    return pa.table([a, b, pa.array(np.concatenate([shared, common]))], names=["a", "b", "n"])


def _token_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = text_shingles(batch.column(1), size)
        bits = []
        for s in sets:
            row = np.zeros(BITS // 64, np.uint64)
            place = mix(s) % np.uint64(BITS)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(int), np.uint64(1) << (place & np.uint64(63)))
            bits.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["rep", "tokens", "bits"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, tokens_a, tokens_b), the pairs whose sets are similar."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        good = []
        xs, ys = left.values.to_numpy(zero_copy_only=False), right.values.to_numpy(zero_copy_only=False)
        xo, yo = left.offsets.to_numpy(), right.offsets.to_numpy()
        for i in range(batch.num_rows):
            x, y = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            good.append(100 * common >= percent * (len(x) + len(y) - common))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _hub_links(table: pa.Table, percent: int) -> pa.Table:
    """Links of the cells in one bucket to hubs, verified on whole sets; one for each row at most, and those between hubs' groups.

    The next hub is the row without a link whose tokens most rows of the cell
    hold. Pairs that this leaves out are left to the token groups.
    """
    cell, rep = table.column("cell").to_numpy(), table.column("rep").to_numpy()
    order = np.lexsort((rep, cell))
    table, cell, rep = table.take(pa.array(order)), cell[order], rep[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    hubs, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
        if end - start < 2:
            continue
        sets = [x.values.to_numpy() for x in table.column("tokens").slice(start, end - start)]
        n = np.array([len(x) for x in sets])
        at = np.concatenate([[0], np.cumsum(n)])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        central = np.add.reduceat(np.bincount(place)[place], at[:-1]) / n
        hub_of = np.full(len(n), -1)
        tried = 0
        for hub in np.argsort(-central, kind="stable").tolist():
            if hub_of[hub] >= 0:
                continue
            if tried == HUBS:
                break
            tried += 1
            held = np.zeros(len(values), np.int64)
            held[place[at[hub] : at[hub + 1]]] = 1
            overlap = np.add.reduceat(held[place], at[:-1])
            linked = 100 * overlap >= percent * (n + n[hub] - overlap)
            linked[hub] = False
            fresh, known = np.flatnonzero(linked & (hub_of < 0)), np.flatnonzero(linked & (hub_of >= 0))
            known = known[np.unique(hub_of[known], return_index=True)[1]]
            hub_of[fresh] = hub
            if len(fresh) or len(known):
                hub_of[hub] = hub
            both = np.concatenate([fresh, known]) + start
            hubs.append(np.full(len(both), rep[start + hub]))
            others.append(rep[both])
    hubs, others = np.concatenate(hubs), np.concatenate(others)
    return pa.table([pa.array(hubs), pa.array(others)], names=["a", "b"])


def _open_groups(table: pa.Table, percent: int) -> pa.Table:
    """Token-group matrices of the posting lists (or blocks of two) in one bucket: pairs that may be similar."""
    cell = table.column("cell").to_numpy()
    order = np.lexsort((table.column("m").to_numpy(), table.column("n").to_numpy(), cell))
    cell = cell[order]
    rep, own, n, side = (table.column(c).to_numpy()[order] for c in ("rep", "own", "n", "side"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
    filled = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    pairs = [np.zeros((0, 2), np.int64)]
    total = 100 + percent

    def enough(overlap, x, y):
        return total * overlap >= percent * (x + y)

    for start, end in zip(starts, np.append(starts[1:], len(cell))):
        for g in range(start, end, GROUP):
            stop = min(g + GROUP, end)
            union = np.bitwise_or.reduce(bits[g:stop], axis=0)
            queries = np.arange(start, stop)  # later ones meet this group from their own
            missing = np.concatenate([np.bitwise_count(bits[at : min(at + QUERIES, stop)] & ~union).sum(axis=1).astype(np.int64) for at in range(start, stop, QUERIES)])
            queries = queries[enough(n[queries] - missing, n[queries], n[g])]
            if not len(queries):
                continue
            for at in range(0, len(queries), QUERIES):
                some = queries[at : at + QUERIES]
                q, d = np.repeat(some, stop - g), np.tile(np.arange(g, stop), len(some))
                fit = (q < d) & (own[q] != own[d]) & ((side[q] != side[d]) | (side[q] == 2))
                q, d = q[fit], d[fit]
                if not len(q):
                    continue
                both = np.bitwise_count(bits[q] & bits[d]).sum(axis=1)
                most = np.minimum(n[q] - filled[q] + both, n[d] - filled[d] + both)
                fit = enough(most, n[q], n[d])
                pairs.append(np.stack([np.minimum(rep[q[fit]], rep[d[fit]]), np.maximum(rep[q[fit]], rep[d[fit]])], 1))
    found = np.unique(np.concatenate(pairs), axis=0)
    return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verify pairs of representatives against their whole sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(lambda it: _verify(it, percent), "a long, b long")


def _linked_to_hubs(held: DataFrame, sets: DataFrame, percent: int, buckets: int) -> list[DataFrame]:
    """Tables of links between classes with an equal minimum hash and hubs among them.

    The rows of one minimum hash are a cell. A cell of many tokens is cut into
    several, and hubs that found a link in a part meet those of the other parts.
    """
    rows = held.select("rep", "n", F.posexplode("minima").alias("j", "m"))
    out = []
    for _ in range(HUB_ROUNDS):
        cells = rows.groupBy("j", "m").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.sum("n") / HUB_TOKENS).alias("parts")).filter("c > 1").drop("c")
        placed = rows.join(cells, ["j", "m"]).withColumn("cell", F.xxhash64("j", "m", F.pmod(F.xxhash64("rep"), "parts")))
        placed = materialize(placed.select("rep", "n", "j", "m", "cell", "parts"), "hub-cells")
        entries = placed.select("rep", "cell").join(sets.select("rep", "tokens"), "rep").withColumn("bucket", F.pmod("cell", F.lit(buckets)))
        out.append(materialize(in_buckets(entries, buckets).applyInArrow(lambda t: _hub_links(t, percent), "a long, b long"), "links-hubs"))
        cut = placed.filter("parts > 1")
        if cut.isEmpty():
            break
        rows = cut.select("rep", "n", "j", "m").join(out[-1].select(F.col("a").alias("rep")).distinct(), "rep", "left_semi")
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Link documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent``/100 or more.

    Returns one row per row: id, ``n_shingles``, ``component_id`` (the smallest
    id reachable by links, its own included). Words are runs of anything but
    ASCII white space, A-Z lower-cased; a text of fewer words is one shingle.
    Null and empty texts have no shingle, link with nothing, and are their own
    component. Each row is linked by its own text, whether its id is repeated
    or null; a component of null ids only has a null one. An empty table gives
    an empty result; columns that are not named are not read. ``percent`` must
    be above 66, so that a prefix fits into the posted share of the hash range.
    """
    if not 100 * (1 - REGION) < percent <= 100:
        raise ValueError(f"percent must be above {100 * (1 - REGION):g} and at most 100")
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row's own key: repeated rows share it, a null id has one too
    texts = texts.select("doc", F.xxhash64("doc", "text").alias("row"), "text")
    sketch = materialize(texts.mapInArrow(lambda it: _sketch(it, size, buckets), SKETCH), "shingle-sketch")
    rows = sketch.filter("kind = 0").select("doc", "n", "digest")
    classes = materialize(
        sketch.filter("kind = 0 and n > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc").alias("first_doc"), F.first("n").alias("n"), F.first("k").alias("k"), F.min("low").alias("low"), F.first("minima").alias("minima"), F.count(F.lit(1)).alias("copies")),
        "shingle-classes",
    )

    # 1. rare shingles
    posted = in_buckets(sketch.filter("kind = 1"), buckets).applyInArrow(lambda t: _posted_pairs(t, buckets), "dest int, kind int, rows binary")
    found = materialize(in_buckets(posted, buckets, "dest").applyInArrow(_gathered, "a long, b long, n long"), "shingle-pairs")
    rows = materialize(rows, "shingle-rows")
    discard(sketch)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    common = found.filter("b is null").select(F.col("a").alias("k"), F.col("n").alias("n_common"))
    # rest: shingles that part 1 cannot see, that is all but the uncommon low ones
    known = classes.join(common, "k", "left").withColumn("rest", F.col("n") - F.col("low") + F.coalesce("n_common", F.lit(0))).select("k", "rep", "n", "rest", "minima")
    known = materialize(known, "shingle-rests")
    ends = [known.select(F.col("k").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("rest").alias(f"rest_{x}")) for x in "ab"]
    pairs = found.filter("b is not null").withColumnRenamed("n", "shared").join(ends[0], "a").join(ends[1], "b")
    overlap = F.col("shared") + F.least("rest_a", "rest_b")
    pairs = pairs.filter(overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    pairs = materialize(pairs, "candidate-pairs")
    held = materialize(known.filter(F.col("n") - F.col("rest") < prefix).select("rep", "n", "minima"), "held-apart")

    # 2. token groups
    need = held.select("rep").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = texts.select("row", "text").join(need.hint("merge"), texts.row == need.rep, "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    sets = materialize(wanted.mapInArrow(lambda it: _token_sets(it, size), "rep long, tokens array<long>, bits binary"), "token-sets")
    links = materialize(_similar(pairs, sets, percent), "links-rare")
    for hub_links in _linked_to_hubs(held, sets, percent, buckets):
        links = links.unionByName(hub_links)
    owners = components(links).select(F.col("node").alias("rep"), F.col("root").alias("owner"))
    members = materialize(
        held.join(sets, "rep").join(owners, "rep", "left").select("rep", "n", F.element_at("minima", 1).alias("m"), F.coalesce("owner", "rep").alias("own"), "tokens", "bits"), "group-members"
    )
    tokens = members.select("rep", "n", "own", F.explode("tokens").alias("token"))
    df = materialize(tokens.select("token", "own").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "group-frequencies")
    rarest = Window.partitionBy("rep").orderBy("df", "token")
    posts = tokens.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", F.row_number().over(rarest)).filter((F.col("at") <= prefix) & (F.col("df") > 1)).select("token", "rep", "n")
    posts = materialize(posts, "posts")
    # similar sets are of one size class or of neighbouring ones, so the blocks of a long list only meet those
    level = F.floor(F.log("n") / F.lit(1.001 * math.log(100 / min(percent, 99)))).cast("int")
    levels = posts.withColumn("level", level).groupBy("token", "level").agg(F.count(F.lit(1)).alias("c"))
    lists = levels.groupBy("token").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("level", F.ceil(F.col("c") / LIST_BLOCK).cast("int")))).alias("blocks"))
    lists = materialize(lists.filter("c > 1"), "posting-lists")
    listed = posts.join(lists, "token").withColumn("level", F.when(F.col("c") > LIST_BLOCK, level).otherwise(0))
    listed = listed.withColumn("blocks", F.when(F.col("c") > LIST_BLOCK, F.col("blocks")).otherwise(F.create_map(F.lit(0), F.lit(1))))

    def blocks_of(n):
        return F.transform(F.sequence(F.lit(1), F.coalesce(F.try_element_at("blocks", n), F.lit(0))), lambda i: F.struct(n.alias("level"), i.alias("i")))

    near = F.filter(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1), lambda n: F.try_element_at("blocks", n).isNotNull())
    mine = F.struct("level", (F.pmod(F.xxhash64("rep"), F.try_element_at("blocks", F.col("level"))) + 1).cast("int").alias("i"))
    cells = (
        listed.withColumn("me", mine)
        .withColumn("other", F.explode(F.flatten(F.transform(near, blocks_of))))
        .withColumn("cell", F.xxhash64("token", F.least("me", "other"), F.greatest("me", "other")))
        .withColumn("side", F.when(F.col("me") == F.col("other"), 2).when(F.col("me") < F.col("other"), 0).otherwise(1))
        .select("rep", "cell", "side")
    )
    entries = cells.join(members.select("rep", "n", "m", "own", "bits"), "rep").withColumn("bucket", F.pmod("cell", F.lit(buckets)))
    opened = in_buckets(entries, buckets).applyInArrow(lambda t: _open_groups(t, percent), "a long, b long").distinct()
    group_links = _similar(materialize(opened, "opened-pairs"), sets, percent)

    # 3. components
    edges = group_links.unionByName(owners.select(F.col("owner").alias("a"), F.col("rep").alias("b")))
    roots = components(edges)
    rooted = materialize(classes.join(roots, classes.rep == roots.node, "left").select("digest", "copies", "first_doc", F.coalesce("root", "rep").alias("root")), "class-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    groups = materialize(attach_groups(rooted, materialize(smallest, "components"), "root", "classes").select("digest", "copies", "component_id"), "class-components")
    linked = attach_groups(rows.filter("n > 0"), groups, "digest", "copies").select("doc", "n", "component_id")
    alone = rows.filter("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.unionByName(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
