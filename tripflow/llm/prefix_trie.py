"""The prefix trie of conversations by blocks of turns.

A turn is known by the digest of its role and text. Each conversation is cut into blocks of four turns, and conversations are grouped
by successive block digests first: a group is a block below the same earlier blocks. Where one block only follows, all of its
turns have the same members, and its nodes are read off it. Turn boundaries are refined only where sibling blocks
diverge, once per different block and not per conversation.

What stands before a block is the exclusive-or of its predecessors' digests hashed with their place: running values that are taken
within ranges of a conversation and carried over the ranges, so that a conversation of any length is spread over tasks.
Nodes are known by 128 bits of hashes.

Sums over subtrees need no walk: each node belongs to its smallest member, and what a member owns lies on its own path from some depth on.
So a subtree's sum is that of its members' totals less what its owner owns above it, and a subtree's leaves are those of its members that
are the smallest of a leaf. Groups of equal conversations are added up before they are shuffled.

Null role and text count as empty. Turns are ordered by number, null first, and turns of equal number by their digest; those of 1,024
consecutive numbers of a conversation are ordered in one task. Rows without conversation are of none and are left out. Repeated rows are turns of their own. Without
conversations there is no node. Other columns are left alone, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import Tables, sized

BLOCK, RANGE, PIECE = 4, 1024, 4096  # turns of a block, places of a range, conversation ids of a piece
NODE = ["depth", "a", "b"]


def before(rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], values: Mapping[str, Column], xor: bool = False) -> DataFrame:
    """rows with the fold of each value over the key's earlier rows. bucket rises with the order: ranges are folded apart and carried on."""
    fold, join = (F.bit_xor, lambda x, y: x.bitwiseXOR(y)) if xor else (F.sum, lambda x, y: x + y)
    rows = rows.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(*[fold(v).alias(f"_{n}") for n, v in values.items()])
    carried = totals.select(*keys, "_bucket", *[F.coalesce(fold(f"_{n}").over(ranges), F.lit(0)).alias(f"_{n}") for n in values])
    own = rows.withColumns({n: F.coalesce(fold(v).over(inside), F.lit(0)) for n, v in values.items()})
    return own.join(carried, [*keys, "_bucket"]).withColumns({n: join(F.col(n), F.col(f"_{n}")) for n in values}).drop("_bucket", *[f"_{n}" for n in values])


def numbered(conversations: DataFrame, tables: Tables, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), digest and words of every turn."""
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    bucket = F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(2**62)))
    return before(tables.save(rows), ["conv"], bucket, [F.asc_nulls_first("turn"), "digest"], {"pos": F.lit(1).cast("long")}).drop("turn")


def grafted(turns: DataFrame, tables: Tables, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of the one that heads their group of ``every`` numbers.

    Conversation c takes the first h turns of c - c % every, h the CRC-32 of c modulo ``most``, and then its own after its first h.
    Returns turns (conv, pos, digest, words, n) and all conversations (conv, n), n turns each.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = lengths.select(F.col("conv").alias("base"), F.col("own").alias("given"))
    c = F.col("conv")
    convs = lengths.withColumns({"base": c - c % every, "h": F.crc32(c.cast("string").cast("binary")) % most}).join(heads, "base", "left")
    convs = convs.withColumn("given", F.least("h", F.coalesce("given", F.lit(0))))
    convs = tables.save(convs.withColumn("n", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    kept = turns.join(convs.drop("base", "own"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "words", "n")
    first = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv", "base")
    lent = first.join(convs.select("conv", "base", "h", "n"), "base").where("pos < h").select("conv", "pos", "digest", "words", "n")
    return kept.unionByName(lent), convs.select("conv", "n")


def _pair(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def _node(j: Column) -> tuple[Column, Column]:
    """Hashes of the node at a block's j-th turn; j = 0 is the node before the block, and j = BLOCK that before the next one."""
    text = F.md5(F.concat_ws("", F.slice("t.digest", F.lit(1), j)).cast("binary"))
    inner, whole = _pair(F.col("a"), F.col("b"), j, text), _pair(text, F.col("k"))
    return tuple(F.when(j == 0, F.col(p)).when(j == BLOCK, F.col(p).bitwiseXOR(w)).otherwise(i) for p, i, w in zip("ab", inner, whole, strict=True))


def _by_node(groups: DataFrame, forks: DataFrame, sums: Sequence[Column]) -> DataFrame:
    """Values of block groups (k, a, b, t, ...) by node: read off blocks without siblings, added up by turn where siblings diverge."""
    names = [c for c in groups.columns if c not in ("k", "a", "b", "t")]

    def nodes(j: Column) -> Column:
        (a, b), (up_a, up_b) = _node(j), _node(j - 1)
        return F.struct((F.col("k") * BLOCK + j).alias("depth"), a.alias("a"), b.alias("b"), up_a.alias("up_a"), up_b.alias("up_b"), F.element_at("t.words", j).alias("words"))

    marked = groups.join(sized(forks.withColumn("fork", F.lit(True)), 1_000_000), ["k", "a", "b"], "left")
    each = marked.select("fork", *names, F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), nodes)).alias("node")).select("fork", "node.*", *names)
    keys = [*NODE, "up_a", "up_b", "words"]
    return each.where("fork IS NULL").select(*keys, *names).unionByName(each.where("fork").groupBy(*keys).agg(*sums))


def trie(turns: DataFrame, convs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends. turns: (conv, pos, digest, words, n); convs: (conv, n) of all conversations, turnless ones too.

    Nodes: depth, a, b (the node's hashes), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: depth, a, b of the node where each conv ends.
    """
    blocks = turns.groupBy("conv", "n", F.floor(F.col("pos") / BLOCK).alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("t"))
    whole = _pair(F.md5(F.concat_ws("", "t.digest").cast("binary")), F.col("k"))
    blocks = tables.save(before(blocks, ["conv"], F.floor(F.col("k") / RANGE), ["k"], dict(zip("ab", whole, strict=True)), xor=True))
    groups = tables.save(blocks.groupBy("k", "a", "b", "t").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")))
    forks = tables.save(groups.groupBy("k", "a", "b").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"), zero.alias("words"), "n_convs", "conv_id")
    found = _by_node(groups, forks, [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")])
    gain = (F.col("n_convs") - 1) * F.col("words")
    nodes = tables.save(before(found.unionByName(root).withColumn("gain", gain), ["conv_id"], F.floor(F.col("depth") / RANGE), ["depth"], {"above": F.col("gain")}))

    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = tables.save(nodes.join(up, NODE, "left").fillna(0, ["n_children"]))
    shares = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("gain").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    summed = blocks.join(shares, "conv", "left").groupBy("k", "a", "b", "t").agg(F.coalesce(F.sum("total"), zero).alias("total"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"))
    below = _by_node(summed, forks, [F.sum("total").alias("total"), F.sum("n_leaves").alias("n_leaves")]).select(*NODE, "total", "n_leaves")
    top = nodes.agg(F.sum("gain").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves")).select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "total", "n_leaves")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below.unionByName(top), NODE).join(parents, ["depth", "up_a", "up_b"], "left")
    out = out.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("above")).alias("saved_tokens"))

    last = blocks.where(F.col("k") * BLOCK + F.size("t") == F.col("n")).withColumns(dict(zip(("end_a", "end_b"), _node(F.size("t")), strict=True)))
    ends = last.select("conv", F.col("n").alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"))
    return out, ends.unionByName(convs.where("n = 0").select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b")))


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and the SHA-256 of each node's conversation ids, ascending and joined by commas.

    Ids are joined in pieces of at most PIECE numbers; only the hash itself goes over a node's pieces one after the other, in a stream.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == now:
                    state.update(b",")
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(text.encode())
            yield rows(done)
        if now:
            yield rows([(*now, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends_sha256"])

    piece = F.floor(F.col("conv") / PIECE).alias("piece")
    pieces = ends.groupBy(*NODE, piece).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return dealt.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")
