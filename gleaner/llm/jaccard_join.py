"""N-gram Jaccard join with token-combination prefixes.

Sets are the distinct five-word shingles of a text. Two texts link when 100 * intersection >= 80 * union;
the result names each text's connected component.

1. One pass makes a set signature per row; rows with equal sets collapse to one node. A node carries the smallest doc_id of its
   rows, and the set's own hash where several sets have that doc_id.
2. The frequency class of every shingle is counted over the corpus (``exchange``). A shingle of one
   document can't match anything, so it only uses up the mismatches that a link allows; a document with
   more such shingles than that is settled at once.
3. The rest is indexed by prefixes in the order (frequency class, hash). Rare shingles are keys by
   themselves. Frequent ones are dealt into token classes by hash and give keys of two tokens of one class:
   a class with n prefix tokens then stands n - 1 mismatches, and the prefix is extended until all classes
   together stand more mismatches than a link allows. Size bands (ratio 1 / 0.8) are part of every key.
4. Candidates are verified on the whole sets. A key's documents are first compared with its most central
   one only; that is enough where they all join its component. Where they don't, what they have beside
   that one is indexed in turn, and only pairs whose overlaps with it leave a link possible are
   verified, so no link that joins components is lost and a large group is not paired in full.

Defined results: null or empty texts have an empty set and stand alone; a null doc_id links with nothing
and has no component; repeated rows are equal sets. Different texts under one doc_id are different
documents: each is a row of the result with the component of its own text. ``one_of_each_group`` keeps all columns, whatever
their names, and of a group one row; rows without words or without a doc_id are in no group and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import exchange, kernel
from gleaner.operators.neardup import connected_components
from gleaner.session import cut_lineage

SHINGLE = 5
PERCENT = 80
BITS = 48
# log2 of the document count from which a shingle is frequent.
FREQUENT = 5
SINGLE_BELOW = 16
LIGHT = "doc_id bigint, n bigint, sig_a bigint, sig_b bigint"
ALIVE = "node bigint, n int, dead int, tokens binary, classes binary"
# Marks, in place of a hash range, of what a chunk is told about its rows: copies of another row's set, and sets whose node
# is their own hash.
LEFT_OUT, BY_HASH = -1, -2
PAIR = np.dtype([("doc_id", "<i8"), ("sig", "<i8")])
KEYS = "key bigint, doc bigint, dead int, n int"


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as at (text -> range) and sorted hashes."""
    words = kernel.find_words(texts, fold=True)
    hashes = words.hashes()
    value, begin = kernel.window_hashes(hashes, words.at, SHINGLE)
    owner = words.owner()[begin]
    counts = words.counts
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        whole = np.zeros(len(short), np.uint64)
        for j in range(n):
            whole = whole * np.uint64(kernel.BASE) + hashes[words.at[short] + j]
        value, owner = np.concatenate([value, kernel.mix(whole ^ np.uint64(n))]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return np.searchsorted(owner, np.arange(len(counts) + 1)), value


def _sums(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                at, value = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(_sums(value, at)),
                     pa.array(_sums(kernel.mix(value ^ np.uint64(kernel.BASE)), at))], ["doc_id", "n", "sig_a", "sig_b"],
                )

    return docs.mapInArrow(sign, LIGHT)


def _classes(values: np.ndarray, chunks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of at least two documents, tagged with log2 of that count."""
    if not len(values):
        return np.zeros(0, bool), np.zeros(0, np.uint8)
    group = exchange.first_of_value(values)
    total = np.bincount(group, counts)[group]
    return total >= 2, np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), 255).astype(np.uint8)


def allowed(n: int) -> int:
    """The smallest number of mismatches that rules a link out, for a set of n."""
    return n - (PERCENT * n + 99) // 100 + 1


def _told(seen: pa.Table, mark: int) -> np.ndarray:
    """The (doc_id, signature) pairs that a chunk got under ``mark``."""
    own = seen.filter(pa.array(np.array(seen.column("bucket").to_pylist(), np.int64) == mark))
    return np.frombuffer(b"".join(x.as_py() for x in own.column("blob")), PAIR)


def _pairs(ids: np.ndarray, sig: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), PAIR)
    out["doc_id"], out["sig"] = ids, sig
    return out


def _alive_sets(docs: DataFrame, sets: DataFrame, ranges: exchange.Ranges) -> DataFrame:
    """Sets that can still link, without shingles of one document, one row per node.

    ``sets`` has (doc_id, sig_a, mark) for rows to leave out and for rows whose node is their hash.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text", 8 << 20):
                part = batch.slice(a, b - a)
                at, value = shingle_sets(part.column("text"))
                chunk = np.repeat(ranges.chunk_of(part.column("doc_id")), np.diff(at))
                yield exchange.fragment_batch(list(exchange.fragments(chunk, value >> np.uint64(64 - BITS), ranges.buckets, BITS)))

    def blob(rows: pa.Table) -> pa.Table:
        mark, pairs = rows.column("mark").to_numpy(), _pairs(rows.column("doc_id").to_numpy(), rows.column("sig_a").to_numpy())
        chunk = rows.column("chunk")[0].as_py()
        return pa.Table.from_batches([exchange.fragment_batch([(int(m), chunk, pairs[mark == m].tobytes()) for m in np.unique(mark)])])

    def settle(rows: pa.Table, seen: pa.Table) -> pa.Table:
        left_out, by_hash = _told(seen, LEFT_OUT), _told(seen, BY_HASH)
        values, tags = exchange.decode_all(seen.filter(pa.array(np.array(seen.column("bucket").to_pylist(), np.int64) >= 0)))
        ids = rows.column("doc_id").to_numpy()
        _, of_id, rows_of_id = np.unique(ids, return_inverse=True, return_counts=True)
        # a doc_id with one row is told by itself, without its set
        keep = ~np.isin(ids, left_out["doc_id"]) | (rows_of_id[of_id] > 1)
        rows, ids = rows.filter(pa.array(keep)), ids[keep]
        out: dict[str, list] = {k: [] for k in ("node", "n", "dead", "tokens", "classes")}
        settled = set()
        for a, b in kernel.blocks(rows, "text"):
            at, value = shingle_sets(rows.column("text").slice(a, b - a))
            there, place = exchange.find(values, value >> np.uint64(64 - BITS))
            n = np.diff(at)
            sig = _sums(value, at)
            pair = _pairs(ids[a:b], sig)
            node = np.where(np.isin(pair, by_hash), sig, ids[a:b])
            alive = np.diff(np.concatenate([[0], np.cumsum(there)])[at])
            for d in np.flatnonzero((n > 0) & (n - alive < n - (PERCENT * n + 99) // 100 + 1) & ~np.isin(pair, left_out)):
                if int(node[d]) in settled:
                    continue
                settled.add(int(node[d]))
                own = slice(at[d], at[d + 1])
                out["node"].append(int(node[d]))
                out["n"].append(int(n[d]))
                out["dead"].append(int(n[d] - alive[d]))
                out["tokens"].append(value[own][there[own]].tobytes())
                out["classes"].append(tags[place[own][there[own]]].tobytes())
        return pa.Table.from_pydict(out, schema=pa.schema([
            ("node", pa.int64()), ("n", pa.int32()), ("dead", pa.int32()), ("tokens", pa.binary()), ("classes", pa.binary())]))

    chunk = ranges.chunk(F.col("doc_id"))
    replies = exchange.answers(docs.mapInArrow(send, exchange.FRAGMENT), _classes).unionByName(
        sets.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(blob, exchange.FRAGMENT)
    )
    return docs.withColumn("chunk", chunk).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(settle, ALIVE)


def band_starts(top: int) -> np.ndarray:
    """Smallest set size of each band; sizes that can link are in the same or in the next band."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * 100 // PERCENT + 1)
    return np.array(out)


def prefix_keys(tokens: np.ndarray, classes: np.ndarray, n: int, dead: int) -> np.ndarray:
    """Keys of one set. Two sets that link share a key."""
    starts = band_starts(2 * n)
    own = int(np.searchsorted(starts, n, "right")) - 1
    order = np.lexsort((tokens, classes))
    tokens, common = tokens[order], classes[order] >= FREQUENT
    need = allowed(n) - dead
    out = []
    for band in (own, own + 1):
        salt = np.uint64((band + 1) * kernel.BASE & kernel.MASK)
        least = int(starts[band])
        rare = tokens if least < SINGLE_BELOW else tokens[~common]
        out.append(kernel.mix(rare[:need] ^ salt))
        if len(rare) < need:
            often = tokens[common]
            kind = (often % np.uint64(least // 4)).astype(np.int64)
            by_kind = np.argsort(kind, kind="stable")
            head = np.ones(len(often), bool)
            head[1:] = kind[by_kind][1:] != kind[by_kind][:-1]
            first = np.zeros(len(often), bool)
            first[by_kind[head]] = True
            stop = int(np.searchsorted(np.cumsum(~first), need - len(rare))) + 1
            by_kind = by_kind[by_kind < stop]
            token, kind = often[by_kind], kind[by_kind]
            gap = 1
            while gap < len(token) and len(same := np.flatnonzero(kind[gap:] == kind[:-gap])):
                out.append(kernel.mix(token[same] * np.uint64(kernel.BASE) + token[same + gap] + salt))
                gap += 1
    return np.concatenate(out)


def _index(alive: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dead = batch.column("n").to_numpy(), batch.column("dead").to_numpy()
            found = [
                prefix_keys(np.frombuffer(t.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint8), int(n[i]), int(dead[i]))
                for i, (t, c) in enumerate(zip(batch.column("tokens"), batch.column("classes")))
            ]
            size = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)),
                pa.array(np.repeat(batch.column("node").to_numpy(), size)),
                pa.array(np.repeat((dead * 1000 // np.maximum(n, 1)).astype(np.int32), size)),
                pa.array(np.repeat(n, size)),
            ], ["key", "doc", "dead", "n"])

    return alive.mapInArrow(keys, KEYS)


def _overlap(part: pa.RecordBatch) -> list[tuple[int, int, np.ndarray]]:
    """Per pair: the intersection's size, how many tokens dst has beside src's, and those of them to index.

    Whoever links with dst beyond src's tokens has at least ceil(0.8 n) - hit of the others, so a
    prefix of them, in the order (class, hash), is enough.
    """
    out = []
    for x, y, k, n in zip(part.column("t_src"), part.column("t_dst"), part.column("k_dst"), part.column("n_dst").to_pylist()):
        own = np.frombuffer(y.as_buffer(), np.uint64)
        there, _ = exchange.find(np.frombuffer(x.as_buffer(), np.uint64), own)
        hit, others = int(there.sum()), own[~there]
        order = np.lexsort((others, np.frombuffer(k.as_buffer(), np.uint8)[~there]))
        least = max(1, (PERCENT * n + 99) // 100 - hit)
        out.append((hit, len(others), others[order][: max(0, len(others) - least + 1)]))
    return out


MEASURED = "src bigint, dst bigint, n_src int, n_dst int, hit int, beside int, others array<bigint>"


def _measured(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """Pairs (src, dst) with their overlap."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = _overlap(part)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ("src", "dst", "n_src", "n_dst")], pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.int32()), pa.array([f[2].view(np.int64) for f in found], pa.list_(pa.int64())),
                ], ["src", "dst", "n_src", "n_dst", "hit", "beside", "others"])

    src = alive.select(F.col("node").alias("src"), F.col("n").alias("n_src"), F.col("tokens").alias("t_src"))
    dst = alive.select(F.col("node").alias("dst"), F.col("n").alias("n_dst"), F.col("tokens").alias("t_dst"), F.col("classes").alias("k_dst"))
    return pairs.join(dst, "dst").join(src, "src").mapInArrow(measure, MEASURED)


LINKED = f"hit * {100 + PERCENT} >= (n_src + n_dst) * {PERCENT}"


def _verified(pairs: DataFrame, alive: DataFrame) -> DataFrame:
    """Of pairs (src, dst), those that link."""
    return _measured(pairs, alive).where(LINKED).select("src", "dst")


def _near_size(a: str, b: str):
    small, large = F.least(a, b), F.greatest(a, b)
    return small * 100 >= large * PERCENT


def _in_components(rows: DataFrame, doc: str, groups: DataFrame) -> DataFrame:
    named = groups.select(F.col("id").alias(doc), F.col("component").alias("_c"))
    return rows.join(named, doc, "left").withColumn("component", F.coalesce("_c", doc)).drop("_c")


def _several(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key still holds several components."""
    open_ = rows.groupBy(*key).agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select(*key)
    return rows.join(open_, key)


def links(alive: DataFrame) -> DataFrame:
    """Enough links (src, dst) between different sets to join every component.

    Every key's documents are measured against its most central one, the head. A link between two documents of
    one head either uses a token that the head has not, and then they meet under such a token, or
    all its tokens are the head's, and then both must have enough of those for their sizes.
    """
    index = _index(alive)
    heads = index.groupBy("key").agg(F.min(F.struct("dead", "n", "doc"))["doc"].alias("src"), F.count("*").alias("docs")).where("docs > 1")
    stars = index.join(heads.select("key", "src"), "key").where("doc <> src").select("src", F.col("doc").alias("dst")).distinct()
    measured = cut_lineage(_measured(stars, alive))
    found = measured.where(LINKED).select("src", "dst")
    rows = measured.select("src", F.col("dst").alias("doc"), F.col("n_dst").alias("n"), "hit", "beside", "others", F.expr(LINKED).alias("linked"))
    own = measured.select("src", F.col("src").alias("doc"), F.col("n_src").alias("n"), F.col("n_src").alias("hit"), F.lit(0).alias("beside"),
                          F.array().cast("array<bigint>").alias("others"), F.lit(True).alias("linked")).distinct()
    left = cut_lineage(_several(_in_components(rows.unionByName(own), "doc", connected_components(found)), ["src"]))
    if left.isEmpty():
        return found
    by_token = left.select("src", F.explode("others").alias("token"), "doc", "n", "hit", "beside", "component")
    token_heads = by_token.groupBy("src", "token").agg(F.min(F.struct(-F.col("hit"), "doc"))["doc"].alias("head"), F.count("*").alias("docs")).where("docs > 1")
    second = by_token.join(token_heads, ["src", "token"]).where("doc <> head").select(F.col("head").alias("src"), F.col("doc").alias("dst")).distinct()
    found = cut_lineage(found.unionByName(_verified(second, alive)))
    groups = cut_lineage(connected_components(found))
    still = cut_lineage(_several(_in_components(by_token.drop("component"), "doc", groups), ["src", "token"]))
    sides = [still.select("src", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "hit", "beside", "component")]) for s in "ab"]
    most = F.least("hit_a", "hit_b") + F.least("beside_a", "beside_b")
    third = (
        sides[0].join(sides[1], ["src", "token"]).where("doc_a < doc_b AND component_a <> component_b")
        .where(most * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
        .select(F.col("doc_a").alias("src"), F.col("doc_b").alias("dst")).distinct()
    )
    now = cut_lineage(_several(_in_components(left.drop("component", "others"), "doc", groups), ["src"]))
    # sizes of partners for which the tokens shared with the head can be enough
    lowest = now.groupBy("src").agg(F.min("n").alias("n_min"))
    top = F.floor(F.col("hit") * (100 + PERCENT) / PERCENT) - F.col("n")
    bottom = F.greatest(F.ceil(F.col("n") * PERCENT / 100), "n_min")
    lone = now.where("NOT linked").join(lowest, "src").where(bottom <= top).select(
        "src", F.col("doc").alias("dst"), F.col("n").alias("n_dst"), F.col("component").alias("other"), F.explode(F.sequence(bottom, top)).alias("n")
    )
    fourth = (
        lone.join(now.withColumn("n", F.col("n").cast("bigint")), ["src", "n"]).where("component <> other AND doc <> dst")
        .where(F.col("hit") * (100 + PERCENT) >= (F.col("n") + F.col("n_dst")) * PERCENT)
        .select(F.least("doc", "dst").alias("src"), F.greatest("doc", "dst").alias("dst")).distinct()
    )
    return found.unionByName(_verified(third.unionByName(fourth).distinct(), alive))


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sig_a, node, component, component_id) of every row.

    ``node`` names the row's set, ``component`` the linked sets and ``component_id`` is their smallest doc_id. A row
    without words or without a doc_id has nulls there.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    light = cut_lineage(_signatures(docs))
    in_sets = F.expr("n > 0 AND doc_id IS NOT NULL")
    signature = ["n", "sig_a", "sig_b"]
    sets = light.where(in_sets).groupBy(*signature).agg(F.min("doc_id").alias("rep"))
    # Several sets have one smallest doc_id only where a doc_id is repeated.
    shared = sets.groupBy("rep").agg(F.min("sig_a").alias("first"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    by_hash = F.coalesce(F.col("sig_a") != F.col("first"), F.lit(False))
    named = sets.join(shared, "rep", "left").select(*signature, "rep", F.when(by_hash, F.col("sig_a")).otherwise(F.col("rep")).alias("node"))
    member = cut_lineage(light.where(in_sets).join(named, signature).select("doc_id", "n", "sig_a", "rep", "node"))
    mark = F.when(F.col("doc_id") != F.col("rep"), LEFT_OUT).when(F.col("node") != F.col("rep"), BY_HASH)
    told = member.select("doc_id", "sig_a", mark.alias("mark")).where("mark IS NOT NULL")
    full = docs.where("doc_id IS NOT NULL")
    alive = cut_lineage(_alive_sets(full, told, exchange.Ranges(full, bytes_per_value=3.5, value_bytes=6)))
    groups = cut_lineage(connected_components(cut_lineage(links(alive))).withColumnRenamed("id", "node"))
    nodes = member.where("doc_id = rep").select("node", "rep").distinct().join(groups, "node")
    least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = groups.join(least, "component")
    return member.join(linked, "node", "left").select(
        "doc_id", "n", "sig_a", "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id")
    ).unionByName(light.where(~F.coalesce(in_sets, F.lit(False))).select("doc_id", "n", "sig_a"), allowMissingColumns=True)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest doc_id reachable."""
    return _components(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs that are in no group, and of each group the row with the smallest doc_id.

    Where that doc_id has several sets in the group, its least signature stays, and of its equal rows one.
    """
    found = cut_lineage(_components(docs).where("doc_id IS NOT NULL").select("doc_id", "sig_a", "component", "component_id"))
    doc_id = docs["doc_id"].cast("bigint")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    out = found.where("doc_id <> component_id").select("doc_id").unionByName(repeated).distinct().withColumnRenamed("doc_id", "_out")
    single = docs.join(out, doc_id == out["_out"], "left_anti")
    # Rows of a repeated doc_id are told apart by their sets.
    stays = (
        found.where("doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "sig_a")).alias("s"))
        .select(F.col("s.doc_id").alias("_id"), F.col("s.sig_a").alias("_sig"))
    )
    again = docs.join(repeated, doc_id == repeated["doc_id"], "left_semi")

    @F.arrow_udf("struct<n: bigint, sig: bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        parts = [shingle_sets(texts.slice(a, b - a)) for a, b in kernel.blocks(pa.table({"text": texts}), "text")]
        n = [np.diff(at) for at, _ in parts]
        sig = [_sums(value, at) for at, value in parts]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([*n, []]).astype(np.int64)), pa.array(np.concatenate([*sig, np.zeros(0, np.int64)]))], ["n", "sig"])

    row = again.select(F.struct("*").alias("_row"))
    signed = row.select("_row", F.col("_row.doc_id").cast("bigint").alias("_id"), sign(F.col("_row.text").cast("string")).alias("_set"))
    empty = signed.where("_set.n = 0").select("_row.*")
    one = (
        signed.where("_set.n > 0").select("_row", "_id", F.col("_set.sig").alias("_sig")).join(stays, ["_id", "_sig"])
        .groupBy("_id", "_sig").agg(F.min_by("_row", "_row.text").alias("_row")).select("_row.*")
    )
    return single.unionByName(empty).unionByName(one)
