"""Prefix trie of conversations: count-min screening of prefix digests, then exact
grouping of those prefixes alone that several conversations may share.

A prefix's digest is the exclusive or of its turns' digests, each mixed with its place,
so it can be worked out in blocks of any conversation.  A count-min sketch counts every
digest.  It never counts too few: where it says one, the prefix and all that follows it
belong to one conversation, whose nodes are written where the row stands.  Only prefixes
that it takes for shared are shuffled by digest and grouped.

Sums over subtrees need no walk of the trie: each node belongs to its smallest member,
each conversation's own nodes are one stretch of its path, and a subtree's sum is the
sum of its members' stretches less what lies above the node in its owner's stretch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stage, table

#: Conversations are rebuilt in families of this many ids, with up to 8 turns of the first.
FAMILY, HEAD = 5, 8
#: Rows of the sketch; cells of a row: four for each prefix, as a power of two within these.
ROWS, LEAST_BITS, MOST_BITS = 3, 12, 24
#: Cells of a piece in which tasks hand over their part of the sketch (as a power of two).
PIECE_BITS = 14
#: Nodes of one owner that are summed together.
BLOCK = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
KEY = ["d", "d1", "d2"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _hex60(text: Column, first: int) -> Column:
    return F.conv(F.substr(text, F.lit(first), F.lit(15)), 16, 10).cast("long")


def _mixed(j: Column) -> tuple[Column, Column]:
    """The two halves of a turn's digest at place ``j``."""
    return F.xxhash64(j.cast("long"), "a", "b"), F.xxhash64("b", "a", j.cast("long"), F.lit(7))


def _taken(c: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return (F.crc32(c.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def _ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in one order over all (c, a, b, bytes, part, place) and, for each part of
    that order and conversation, (c, part, first, before, total, parts): its first place
    in the part, its turns in parts before, all its turns, and in how many parts it is."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("m"), F.octet_length(text).cast("long").alias("bytes"))
    rows = stage(rows.select("c", "turn", _hex60(F.col("m"), 1).alias("a"), _hex60(F.col("m"), 16).alias("b"), "bytes", F.monotonically_increasing_id().alias("tie")), "trie-turns")
    order = ["c", F.col("turn").asc_nulls_first(), "a", "b", "tie"]  # rows alike in all may stand in any order
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "a", "b", "bytes", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    turns = stage(ranged, "trie-ordered")
    spans = turns.groupBy("c", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("c")  # a row for each part of the order that holds it
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return turns, stage(spans.select("c", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"), F.count("*").over(whole).alias("parts")), "trie-spans")


def _prefixes(turns: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation but the empty ones, (c, d, d1, d2, t1,
    t2, bytes, length): depth, digest, its last turn's digest and bytes, and the length
    of the conversation; and the conversations (c, length)."""
    place = F.col("place") - F.col("first") + F.col("before")
    opening = spans.where((F.col("c") % FAMILY == 0) & (F.col("before") < HEAD)).select("c", "part", "first", "before")
    heads = turns.where(F.col("c") % FAMILY == 0).join(opening, ["c", "part"]).withColumn("j", place).where(F.col("j") < HEAD)
    t1, t2 = _mixed(F.col("j"))
    so_far = Window.partitionBy("c").orderBy("j")  # eight rows at most
    heads = heads.withColumns({"t1": t1, "t2": t2}).withColumns({"d1": F.bit_xor("t1").over(so_far), "d2": F.bit_xor("t2").over(so_far)})
    fields = ["d", "d1", "d2", "t1", "t2", "bytes"]
    heads = heads.withColumn("d", F.col("j") + 1).groupBy("c").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("head"))
    convs = spans.groupBy("c").agg(F.first("total").alias("total")).withColumns({"h": _taken(F.col("c")), "base": F.col("c") - F.col("c") % FAMILY})
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = convs.join(heads.withColumnRenamed("c", "base"), "base", "left").withColumn("head", head)
    convs = stage(convs.select("c", "h", "head", (F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).cast("long").alias("length")), "trie-conversations")
    state = F.try_element_at("head", F.lit(-1))
    starts = convs.select("c", "h", F.size("head").alias("got"), F.coalesce(state["d1"], F.lit(0)).cast("long").alias("s1"), F.coalesce(state["d2"], F.lit(0)).cast("long").alias("s2"), "length")
    spans = spans.join(starts, "c")

    def own(spans: DataFrame) -> DataFrame:
        rows = turns.join(spans, ["c", "part"]).withColumn("j", place - F.col("h") + F.col("got")).where(place >= F.col("h"))
        t1, t2 = _mixed(F.col("j"))
        return rows.withColumns({"t1": t1, "t2": t2, "d": F.col("j") + 1})

    # What the parts before add to a conversation that goes over parts: such pairs are fewer than parts.
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own(spans.where("parts > 1")).groupBy("c", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    carried = stage(carried.select("c", "part", F.bit_xor("x1").over(earlier).alias("x1"), F.bit_xor("x2").over(earlier).alias("x2")), "trie-carried")
    so_far = Window.partitionBy("c", "part").orderBy("place")
    rows = own(spans).withColumns({"d1": F.bit_xor("t1").over(so_far), "d2": F.bit_xor("t2").over(so_far)}).join(F.broadcast(carried), ["c", "part"], "left")
    whole = lambda k: F.col(f"d{k}").bitwiseXOR(F.col(f"s{k}")).bitwiseXOR(F.coalesce(f"x{k}", F.lit(0)).cast("long"))
    rows = rows.withColumns({"d1": whole(1), "d2": whole(2)}).select("c", *fields, "length")
    shared = convs.select("c", "length", F.explode("head").alias("x")).select("c", "x.*", "length")
    return stage(rows.unionByName(shared), "trie-prefixes"), convs.select("c", "length")


def _cells(d1: np.ndarray, d2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    mask = np.uint64((1 << bits) - 1)
    x, y = d1.view(np.uint64), d2.view(np.uint64)
    return [((z & mask) + np.uint64(row << bits)).astype(np.int64) for row, z in enumerate((x, x >> np.uint64(32), y))]


def shared_cells(prefixes: DataFrame, bits: int) -> bytes:
    """Cells of the sketch that count two or more, as bits.  Counts stop at two, since
    only one is asked for.  Tasks count apart; their pieces are added up by piece."""
    piece = 1 << PIECE_BITS
    size = -(-(ROWS << bits) // piece) * piece

    def count(batches):
        counts = np.zeros(size, np.uint8)
        for b in batches:
            for cells in _cells(b.column(0).to_numpy(), b.column(1).to_numpy(), bits):
                seen, n = np.unique(cells, return_counts=True)
                counts[seen] = np.minimum(counts[seen] + np.minimum(n, 2), 2)
        for k in np.flatnonzero(counts.reshape(-1, piece).any(1)).tolist():
            part = counts[k * piece : (k + 1) * piece]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(part > 0).tobytes()], pa.binary()), pa.array([np.packbits(part > 1).tobytes()], pa.binary())], names=["k", "one", "two"])

    def add(batches):
        key, one, two = None, None, None
        for b in batches:
            for k, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                if k == key:
                    one, two = one | x, two | y | (one & x)
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([two.tobytes()], pa.binary())], names=["k", "two"])
                key, one, two = k, x, y
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([two.tobytes()], pa.binary())], names=["k", "two"])

    pieces = prefixes.select("d1", "d2").mapInArrow(count, "k int, one binary, two binary")
    added = pieces.repartition("k").sortWithinPartitions("k").mapInArrow(add, "k int, two binary")
    out = bytearray(size >> 3)
    for row in added.toLocalIterator():  # 6 MB in all at MOST_BITS
        out[row["k"] * piece >> 3 : (row["k"] + 1) * piece >> 3] = row["two"]
    return bytes(out)


def _screened(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` with the parent's digest and a kind: 2 if the sketch proves that the
    parent is one conversation's, 1 if the prefix itself, 0 if it may be shared."""
    bits = min(max(prefixes.count() * 4, 1).bit_length(), MOST_BITS)
    bits = max(bits, LEAST_BITS)
    held = prefixes.sparkSession.sparkContext.broadcast(shared_cells(prefixes, bits))

    def screen(batches):
        shared = np.frombuffer(held.value, np.uint8)
        for b in batches:
            d, d1, d2, p1, p2 = (b.column(i).to_numpy() for i in (1, 2, 3, 4, 5))
            several = lambda x, y: np.logical_and.reduce([(shared[c >> 3] >> (7 - (c & 7))) & 1 == 1 for c in _cells(x, y, bits)])
            kind = np.where((d > 1) & ~several(p1, p2), 2, np.where(several(d1, d2), 0, 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind)], names=[*b.schema.names, "kind"])

    p1, p2 = (F.col(f"d{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2))
    rows = prefixes.select("c", F.col("d").cast("long").alias("d"), "d1", "d2", p1, p2, "bytes", "length")
    return stage(rows.mapInArrow(screen, "c long, d long, d1 long, d2 long, p1 long, p2 long, bytes long, length long, kind int"), "trie-screened")


def _digests(ends: DataFrame) -> DataFrame:
    """``ends(d, d1, d2, c)`` -> the key and the SHA-256 of its ids, ascending and joined
    by commas.  Ids are joined to pieces where ranges of them stand; a key's pieces then
    stream through one hash, in bounded memory."""
    names = [*KEY, "c", "ids"]

    def join(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d, d1, d2, c = (b.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero((d[1:] != d[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
            first = np.concatenate(([0], cut))
            text = [",".join(map(str, part.tolist())) for part in np.split(c, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (d, d1, d2, c)] + [pa.array(text)], names=names)

    def digest(batches):
        key, state = None, None
        for b in batches:
            out = []
            for d, d1, d2, _, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (d, d1, d2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, d1, d2), hashlib.sha256(ids.encode())
            yield _rows(out)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [pa.array([x[3] for x in out], pa.string())], names=[*KEY, "sha"])

    pieces = ends.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(join, "d long, d1 long, d2 long, c long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(digest, "d long, d1 long, d2 long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> a row for each node of the trie of
    rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first); those of one turn by a digest of role and
    text, so repeated rows are turns each.  Null roles and texts are empty; texts of any
    length are digested whole.  Rows without a conv_id belong to no conversation and are
    left out.  An empty table gives no node, not even the root.  Extra columns are
    ignored.  Turns are told apart by 120 bits of MD5, prefixes by 128 bits.  A conversation of any
    length is cut into parts.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    prefixes, convs = _prefixes(*_ordered_turns(conversations))
    rows = _screened(prefixes)
    known = convs.agg(F.min("c").alias("first"), F.count("*").alias("n")).first()
    ended = F.col("d") == F.col("length")
    own_id = F.sha2(F.col("c").cast("string").cast("binary"), 256)
    # Proven to be one conversation's, parent and all: written where they stand.
    tails = rows.where("kind = 2").select("c", "d", F.col("c"), F.lit(1), (~ended).cast("long"), F.lit(1), F.lit(0), F.when(ended, own_id).otherwise(NO_IDS)).toDF(*_names())
    single, several = rows.where("kind = 1"), rows.where("kind = 0")
    groups = stage(several.groupBy(*KEY).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count("*").alias("n"), F.min("c").alias("owner"), F.max("bytes").alias("bytes")), "trie-groups")
    up = [(F.col("d") - 1).alias("d"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    children = stage(groups.select(*up).unionAll(single.select(*up)).groupBy(*KEY).agg(F.count("*").alias("n_children")), "trie-children")
    nodes = stage(groups.join(children, KEY, "left").na.fill(0, ["n_children"]).withColumn("saved", (F.col("n") - 1) * F.col("bytes")), "trie-nodes")
    # An owner's nodes are one stretch: what lies above each of them, block by block.
    block = F.floor(F.col("d") / BLOCK)
    blocks = nodes.groupBy("owner", block.alias("block")).agg(F.sum("saved").alias("saved"))
    earlier = Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("owner", "block", F.sum("saved").over(earlier).alias("carried")).where("carried is not null")
    above = F.sum("saved").over(Window.partitionBy("owner", "block").orderBy("d")) - F.col("saved")
    placed = nodes.withColumn("block", block).withColumn("above", above).join(carried, ["owner", "block"], "left").withColumn("above", F.col("above") + F.coalesce("carried", F.lit(0)))
    # What each conversation brings to all nodes above its own, and whether it ends in a leaf of its own.
    brings = nodes.groupBy(F.col("owner").alias("c")).agg(F.sum("saved").alias("saved"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    brings = brings.unionByName(rows.where(ended & (F.col("kind") > 0)).select("c", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf")))
    brings = stage(brings.groupBy("c").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")), "trie-brings")
    sums = several.select(*KEY, "c").join(brings, "c").groupBy(*KEY).agg(F.sum("saved").alias("all"), F.sum("leaf").alias("leaves"))
    root_key = [F.lit(0).cast("long").alias(k) for k in KEY]
    ends = _digests(several.where(ended).select(*KEY, "c").unionAll(convs.where("length = 0").select(*root_key, "c")))
    ends = stage(ends, "trie-ends")
    inner = placed.join(sums, KEY, "left").join(ends, KEY, "left").select(
        "d", "p1", "p2", F.col("owner").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("all", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("sha", F.lit(NO_IDS)).alias("ends_sha256"))
    edge = single.select("d", "p1", "p2", F.col("c").alias("conv_id"), F.lit(1).alias("n_convs"), (~ended).cast("long").alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.when(ended, own_id).otherwise(NO_IDS).alias("ends_sha256"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent"))
    # A parent that isn't among the shared ones was proven to be this conversation's own.
    parent = F.when(F.col("d") == 1, F.lit(known["first"])).otherwise(F.coalesce("parent", "conv_id")).cast("long")
    upper = inner.unionByName(edge).join(parents, ["d", "p1", "p2"], "left").select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    total = brings.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.greatest(F.coalesce(F.sum("leaf"), F.lit(0)), F.lit(1)).alias("n_leaves"))
    top = children.where("d = 0").agg(F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"))
    none = ends.where("d = 0").agg(F.coalesce(F.max("sha"), F.lit(NO_IDS)).alias("ends_sha256"))
    root = total.crossJoin(top).crossJoin(none).where(F.lit(known["n"]) > 0).select(  # one row each
        F.lit(known["first"]).cast("long").alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(known["n"]).alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = tails.unionByName(upper).unionByName(root)
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in NODE.split(", "))])


def _names() -> list[str]:
    return [f.split()[0] for f in NODE.split(", ")]


def op12_prefix_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a text of digits, written out: its bytes and their bits, one after another.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""

OP12_SQL = f"""
with turns as (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as t
    from conversations where conv_id is not null group by conv_id),
sized as (select *, ({_CRC}) % 9 as h from turns),
rebuilt as (select c.conv_id, coalesce(b.t[1:c.h], []) || coalesce(c.t[c.h + 1:], []) as t from sized c left join turns b on b.conv_id = c.conv_id - c.conv_id % 5),
paths as (select conv_id, d, t[1:d] as p, len(t) as length, t from rebuilt, unnest(range(0, len(t) + 1)) as x(d)),
nodes as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(if(d = 0, 0, strlen(p[-1].text))) as bytes,
    coalesce(string_agg(case when length = d then cast(conv_id as varchar) end, ',' order by conv_id), '') as ends, max(length) = d as childless from paths group by p, d),
above as (select p[1:a] as p, n_convs, bytes, childless from nodes, unnest(range(0, d + 1)) as x(a)),
sums as (select p, count_if(childless) as n_leaves, sum((n_convs - 1) * bytes) as saved from above group by p),
kids as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, s.n_leaves, s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s using (p) left join kids k using (p) left join nodes u on n.d > 0 and u.p = n.p[1:n.d - 1] and u.d = n.d - 1
"""
