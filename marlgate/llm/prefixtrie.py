"""The trie of conversations: which begin with the same turns, and what is saved if shared turns are kept once.

A node is a distinct sequence of turns.  It is named by its depth and two 64-bit values, each the exclusive or of hashes of
(place, digest of the turn) over its turns, which are running values along a conversation: no conversation has to be in one task.
Texts are read once, for their digests and lengths; only those are shuffled.

Preorder intervals: distinct conversations are ranked in lexicographic order of the nodes that they pass.  A node belongs to the
first conversation through it, so nodes in order of (rank, depth) are the trie in preorder, and the nodes below it end where those
of the last conversation through it end.  With running sums of leaves and savings in that order, what holds for a subtree is the
difference of two of them: at its end, and before its top.

What conversations are compared by has entries only where a path branches: a conversation of n turns that many others share needs
no more entries than others leave it.  As each of k branchings needs another conversation as deep, k is below the root of twice
the number of turns.

Edge cases: rows without conv_id are left out.  Turns of one number stand in order of the digest of role and text; repeated rows
are as many turns.  A conversation without turns of its own after the rebuilding ends at the root.  An empty table has no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgate.llm.prefixsums import running
from marlgate.llm.scratch import cut
from marlgate.shipping import map_in_arrow

KEY = ["depth", "h1", "h2"]
#: Conversations of a hundred take the first turns of the first of them, as many as a checksum modulo 6 says.
SHARING, HEADS = 100, 6
#: Ids that are joined into one piece of text before it is hashed.
PIECE = 10_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and n_chars of each turn, in order of turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", told.alias("digest"), F.length(text).cast("bigint").alias("n_chars"))
    return running(turns, ["conv_id"], ["turn", "digest"], {"place": ("sum", F.lit(1).cast("bigint"))}, "turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, n_chars) of rebuilt conversations, and (conv_id, length), those without turns included.

    Each conversation starts with the first h turns of the first of its hundred, and goes on with its own after its first h.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % SHARING
    convs = lengths.select("conv_id", "n", first.alias("_first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("_h"))
    of_first = lengths.where(F.col("conv_id") == first).select(F.col("conv_id").alias("_first"), F.col("n").alias("_have"))
    convs = convs.join(of_first, "_first", "left").withColumn("_taken", F.least("_h", F.coalesce("_have", F.lit(0))))
    convs = convs.withColumn("length", F.col("_taken") + F.greatest(F.lit(0), F.col("n") - F.col("_h")))
    convs = cut(convs.select("conv_id", "_first", "_h", "_taken", "length"), "lengths")
    rest = turns.join(convs, "conv_id").where("place > _h").select("conv_id", (F.col("place") - F.col("_h") + F.col("_taken")).alias("depth"), "digest", "n_chars")
    heads = turns.where((F.col("place") < HEADS) & (F.col("conv_id") == first)).withColumnRenamed("conv_id", "_first")
    begun = convs.where("_taken > 0").join(heads, "_first").where("place <= _h").select("conv_id", F.col("place").alias("depth"), "digest", "n_chars")
    return rest.unionByName(begun), convs.select("conv_id", "length")


def paths_of(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, h1, h2 (the node), p1, p2 (its parent) and n_chars of each turn of each conversation."""
    t1, t2 = F.xxhash64("digest", "depth"), F.xxhash64(F.lit("second"), "digest", "depth")
    named = sequences.select("conv_id", "depth", "n_chars", t1.alias("_t1"), t2.alias("_t2"))
    run = running(named, ["conv_id"], ["depth"], {"h1": ("xor", F.col("_t1")), "h2": ("xor", F.col("_t2"))}, "terms")
    parent = {f"p{k}": F.col(f"h{k}").bitwiseXOR(F.col(f"_t{k}")) for k in (1, 2)}
    return cut(run.withColumns(parent).select("conv_id", *KEY, "p1", "p2", "n_chars"), "paths")


def nodes_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: depth, h1, h2, p1, p2, conv_id (the least through it), n_convs, n_children and n_chars."""
    found = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_chars").alias("n_chars"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("n_chars"))
    every = cut(found.unionByName(root), "bare_nodes")
    children = every.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    return cut(every.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")


def ends_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id and the node where each conversation ends."""
    last = paths.join(lengths.withColumnsRenamed({"conv_id": "_c", "length": "_l"}), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_l"))).select("conv_id", *KEY)
    zero = F.lit(0).cast("bigint")
    return last.unionByName(lengths.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2")))


def ranked(paths: DataFrame, ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id (one for each distinct conversation) and rank, from 1, in lexicographic order of nodes."""
    alone = cut(ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("depth").alias("length")), "distinct")
    forks = nodes.where("n_children > 1").select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    steps = paths.join(alone, "conv_id", "left_semi").join(forks, ["depth", "p1", "p2"], "left_semi")
    keys = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("key"))
    none = F.array().cast("array<struct<depth:bigint,h1:bigint,h2:bigint>>")
    keyed = alone.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", none))
    return running(keyed, [], ["key", "length"], {"rank": ("sum", F.lit(1).cast("bigint"))}, "keys").select("conv_id", "rank")


def intervals(paths: DataFrame, nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """``nodes`` with place and end (the preorder interval of its subtree, from 1), n_leaves and saved_tokens."""
    through = paths.join(ranks, "conv_id").groupBy(*KEY).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    zero = F.lit(0).cast("bigint")
    top = ranks.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first is not null").select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "first", "last")
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("n_chars")
    joined = nodes.join(through.unionByName(top), KEY).withColumns({"_leaf": leaf, "_saved": saved})
    sums = {"place": ("sum", F.lit(1).cast("bigint")), "_leaves": ("sum", F.col("_leaf")), "_savings": ("sum", F.col("_saved"))}
    run = cut(running(joined, [], ["first", "depth"], sums, "preorder"), "places")
    upto = run.groupBy(F.col("first").alias("last")).agg(F.max("place").alias("end"), F.max("_leaves").alias("_all_leaves"), F.max("_savings").alias("_all_savings"))
    out = run.join(upto, "last")
    below = {"n_leaves": F.col("_all_leaves") - F.col("_leaves") + F.col("_leaf"), "saved_tokens": F.col("_all_savings") - F.col("_savings") + F.col("_saved")}
    return out.withColumns(below).select(*nodes.columns, "place", "end", *below)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, h1, h2 and the SHA-256 of the ascending ids that end there, joined by commas.

    Ids are joined into pieces over ranges of (node, id), so a node where many end is spread over tasks.  A digest is one chain: its
    pieces go through one task in order, a piece at a time.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, rows = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("least", pa.int64()), ("piece", pa.string())]))

        def close() -> None:
            if ids:
                rows.append(dict(zip(KEY, node, strict=True)) | {"least": ids[0], "piece": ",".join(map(str, ids))})

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node or len(ids) >= PIECE:
                    close()
                    node, ids = key, []
                ids.append(conv)
            if len(rows) >= 1000:
                yield made()
                rows = []
        close()
        if rows:
            yield made()

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, chain, rows = None, None, []
        schema = pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    chain.update(b"," + piece.encode())
                    continue
                if node is not None:
                    rows.append(dict(zip(KEY, node, strict=True)) | {"ends_sha256": chain.hexdigest()})
                node, chain = key, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(KEY, node, strict=True)) | {"ends_sha256": chain.hexdigest()}], schema)

    kinds = "depth bigint, h1 bigint, h2 bigint"
    dealt = ends.select(*KEY, "conv_id").repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = map_in_arrow(dealt, pieces, f"{kinds}, least bigint, piece string").repartition(parts, *KEY).sortWithinPartitions(*KEY, "least")
    return map_in_arrow(joined, chains, f"{kinds}, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: place and end in preorder, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256."""
    turns = cut(turns_of(conversations), "places_of_turns")
    sequences, lengths = rebuilt(turns)
    paths = paths_of(sequences)
    nodes = nodes_of(paths, lengths)
    ends = cut(ends_of(paths, lengths), "ends")
    found = intervals(paths, nodes, cut(ranked(paths, ends, nodes), "ranks"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = found.join(parents, ["depth", "p1", "p2"], "left").join(end_digests(ends), KEY, "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    names = ["place", "end", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*names, F.coalesce("ends_sha256", empty).alias("ends_sha256"))
