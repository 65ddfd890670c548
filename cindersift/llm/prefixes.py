"""The trie of conversation prefixes: which conversations begin alike, and what storing each shared turn once would save.

Turns are ordered by range over (conversation, turn), so one conversation may span tasks: a numpy scan numbers a task's
turns, and the few conversations that go on in a later task are moved up by what came before. Every prefix has a
polynomial rolling fingerprint, the running sum of ``hash(turn i) * B^i`` modulo two primes, scanned within blocks of BLOCK
turns and carried over from block to block. Prefixes of one depth and fingerprint are candidates for one node. Each is then
verified turn by turn: a member's last turn and its parent must be those of the representative (the smallest member); by
induction over the depth all earlier turns are. Members that differ are split off with all their longer prefixes, and what
was split is verified again, so results are exact whatever the fingerprints do.

Counts of subtrees roll up by pointer doubling, in as many rounds as the depth of the deepest shared node has bits; nodes with
one member need no rounds, as their subtree is that conversation's own rest.

A digest over the ids of a node must read them in order; so ids are sorted by range and joined to texts of CHUNK of them, and
one task reads these texts of a node, a stream of few rows.

Defined results: turns go by turn number, null first, ties by role and text; null roles and texts are empty; rows of a null
conversation id are left out; repeated rows are turns of their own; ids below 0 use the remainder with their own sign; a
conversation rebuilt without turns is a member of the root only; an empty table has no nodes. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.llm.hashing import mixed, returning
from cindersift.storage import dropped, written

#: Turns of a conversation that one scan adds up; ids that one text of a digest's input holds.
BLOCK, CHUNK = 4096, 65536
U = np.uint64
PRIMES, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_103_515_245, 747_796_405)
WORD = r"[^\x20\x09-\x0D]+"
#: Every FAMILY-th conversation lends its first turns to those after it.
FAMILY = 20


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a new run of equal values; the first always does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _longs(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``local``: the place of a turn, from 1, among its conversation's turns of this task."""
    last, n = None, 0
    for b in batches:
        if b.num_rows:
            (conv,) = _longs(b, "conv_id")
            new = _starts(conv)
            at = np.arange(len(conv))
            first = np.maximum.accumulate(np.where(new, at, 0))
            local = at - first + 1 + np.where((first == 0) & (conv == last), n, 0)
            last, n = conv[-1], int(local[-1])
            yield b.append_column("local", pa.array(local, pa.int64()))


def placed(turns: DataFrame, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, role, text, words, h): turns with their place in their conversation, from 1; and a hash of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "role", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.xxhash64("role", "text").alias("h"), F.spark_partition_id().alias("task"))
    rows = written(rows.mapInArrow(_numbered, "conv_id long, role string, text string, words long, h long, task int, local long"), "turns")
    counts = rows.groupBy("conv_id", "task").agg(F.max("local").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A task goes on with one conversation at most, its first; so there are fewer of these rows than tasks.
    moved = counts.withColumn("before", before).where("before > 0").select("conv_id", "task", "before")
    out = rows.join(F.broadcast(moved), ["conv_id", "task"], "left")
    return out.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "text", "words", "h")


def rebuilt(turns: DataFrame, **cols: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, role, text, words, h, total) of the rebuilt conversations, and all of these (conv_id, total).

    A conversation takes the first ``crc32(id) % 4`` turns of its family's first one, and keeps its own after as many.
    """
    turns = placed(turns, **cols)
    sizes = written(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "sizes")
    lent, family = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, F.col("conv_id") - F.col("conv_id") % FAMILY
    firsts = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.col("own").alias("there"))
    convs = sizes.withColumn("lent", lent).withColumn("family", family).join(firsts, "family", "left")
    got = F.least("lent", F.coalesce("there", F.lit(0)))
    convs = written(convs.select("conv_id", "family", "lent", got.alias("got"), (got + F.greatest(F.col("own") - F.col("lent"), F.lit(0))).alias("total")), "conversations")
    own = turns.join(convs.select("conv_id", "lent", "got", "total"), "conv_id").where("pos > lent")
    own = own.select("conv_id", (F.col("got") + F.col("pos") - F.col("lent")).alias("depth"), "role", "text", "words", "h", "total")
    heads = turns.where((F.col("pos") <= 3) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    heads = heads.join(convs.select("conv_id", "family", "got", "total"), "family").where("pos <= got")
    heads = heads.select("conv_id", F.col("pos").alias("depth"), "role", "text", "words", "h", "total")
    return own.unionByName(heads), convs.select("conv_id", "total")


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.empty(BLOCK, U)
    x = 1
    for i in range(BLOCK):
        out[i] = x
        x = x * base % prime
    return out


@returning
def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, block, depth): adds the running sums f1, f2 within the block, and x1, x2 that the row added."""
    powers = [_powers(b, p) for b, p in zip(BASES, PRIMES)]
    last, held = None, [U(0), U(0)]
    for b in batches:
        if not b.num_rows:
            continue
        conv, block, depth, h = _longs(b, "conv_id", "block", "depth", "h")
        new = _starts(conv, block)
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        goes_on = (first == 0) & ((conv[0], block[0]) == last)
        for i, (base, prime) in enumerate(zip(BASES, PRIMES)):
            x = mixed(h.view(U) + U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U(prime)
            x = x * powers[i][(depth - 1) % BLOCK] % U(prime)
            blocks, back = np.unique(block, return_inverse=True)
            x = x * np.array([pow(base, int(k) * BLOCK, prime) for k in blocks], U)[back] % U(prime)
            total = np.cumsum(x, dtype=U)
            f = (total - (total - x)[first] + np.where(goes_on, held[i], U(0))) % U(prime)
            held[i] = f[-1]
            b = b.append_column(f"f{i + 1}", pa.array(f.astype(np.int64))).append_column(f"x{i + 1}", pa.array(x.astype(np.int64)))
        last = (conv[-1], block[-1])
        yield b


_TURN = "conv_id long, depth long, role string, text string, words long, total long"


def fingerprinted(turns: DataFrame, *, mask: int = -1) -> DataFrame:
    """Turns with ``f``, the fingerprint of the prefix that ends there, and ``prev``, that of the prefix before."""
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).select("conv_id", "depth", "role", "text", "words", "total", "block", "h")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    rows = written(rows.mapInArrow(_scanned, f"{_TURN}, block long, h long, f1 long, x1 long, f2 long, x2 long"), "scanned")
    sums = rows.where(F.col("total") > BLOCK).groupBy("conv_id", "block").agg(F.sum("x1").alias("y1"), F.sum("x2").alias("y2"))
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A sum of residues of 2^31 stays a long up to 2^32 turns of one conversation.
    sums = sums.select("conv_id", "block", *(F.coalesce(F.sum(f"y{i}").over(w), F.lit(0)).alias(f"c{i}") for i in (1, 2))).where("block > 0")
    later = rows.where("block > 0").join(sums, ["conv_id", "block"])
    rows = rows.where("block = 0").withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")}).unionByName(later)

    def whole(*less: Column) -> Column:
        a, b = (F.pmod(F.col(f"f{i}") + F.col(f"c{i}") - less[i - 1], F.lit(PRIMES[i - 1])) for i in (1, 2))
        return (a * (1 << 31) + b).bitwiseAND(mask)

    none = F.when(F.col("depth") == 1, F.lit(0).cast("long"))
    return rows.select("conv_id", "depth", "role", "text", "words", "total", whole(F.lit(0), F.lit(0)).alias("f"), none.otherwise(whole(F.col("x1"), F.col("x2"))).alias("prev"))


def _split_key(upto: Column) -> Column:
    """A conversation's splits down to a depth, in order."""
    return F.array_join(F.transform(F.filter("splits", lambda x: x["depth"] <= upto), lambda x: F.concat_ws(".", x["depth"], x["round"])), ";")


def verified(turns: DataFrame, *, split_rounds: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their node's key (depth, f, s), and the nodes (depth, f, s, conv_id, n, words, prev): exact, ``s`` tells collisions apart."""
    splits: DataFrame | None = None
    for round_ in range(1, 1 << 20):
        if splits is None:
            rows = turns.withColumns({"s": F.lit(""), "s_prev": F.lit("")})
        else:
            per = splits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "round"))).alias("splits"))
            rows = turns.join(per, "conv_id", "left").withColumn("splits", F.coalesce("splits", F.array().cast("array<struct<depth:long,round:int>>")))
            rows = rows.withColumn("s", _split_key(F.col("depth"))).withColumn("s_prev", _split_key(F.col("depth") - 1)).drop("splits")
        nodes = rows.groupBy("depth", "f", "s").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.max("words").alias("words"), F.min("prev").alias("prev"))
        nodes = written(nodes, "nodes")
        several = nodes.where("n > 1").select("f", "s", "depth", F.col("first").alias("conv_id"))
        stands = rows.join(several, ["conv_id", "depth", "f", "s"]).select("depth", "f", "s", F.col("conv_id").alias("first"), *(F.col(c).alias(f"its_{c}") for c in ("role", "text", "prev", "s_prev")))
        met = rows.join(written(stands, "representatives"), ["depth", "f", "s"]).where("conv_id <> first")
        other = met.where(~((F.col("role") == F.col("its_role")) & (F.col("text") == F.col("its_text")) & (F.col("prev") == F.col("its_prev")) & (F.col("s_prev") == F.col("its_s_prev"))))
        other = written(other.select("conv_id", "depth", F.lit(round_).alias("round")), "collisions")
        if other.isEmpty():
            return rows, nodes
        if split_rounds is not None:
            split_rounds.append(round_)
        splits = other if splits is None else splits.unionByName(other)
    raise RuntimeError("collisions are left")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (depth, f, s, conv_id) to texts of at most CHUNK ids joined by commas, with their first id."""
    key, ids, out = None, [], []

    def told() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "f", "s", "first", "ids"), r)) for r in rows], schema=_CHUNKS)

    for b in batches:
        for *k, conv in zip(*(c.to_pylist() for c in b.columns)):
            if k != key or len(ids) >= CHUNK:
                told()
                key = k
            ids.append(conv)
        if len(out) > 4096:
            yield batch()
    told()
    yield batch()


_CHUNKS = pa.schema([("depth", pa.int64()), ("f", pa.int64()), ("s", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("depth", pa.int64()), ("f", pa.int64()), ("s", pa.string()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (depth, f, s, first) to one digest for each key."""
    key, sha, out = None, None, []
    for b in batches:
        for *k, _, ids in zip(*(c.to_pylist() for c in b.columns)):
            if k != key:
                out += [(*key, sha.hexdigest())] if key else []
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r)) for r in out], schema=_DIGESTS)
            out = []
    out += [(*key, sha.hexdigest())] if key else []
    yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r)) for r in out], schema=_DIGESTS)


def ends(rows: DataFrame) -> DataFrame:
    """(depth, f, s, ends_sha256) of rows (depth, f, s, conv_id): digest of a key's ids, ascending, joined by commas."""
    keys = ["depth", "f", "s"]
    ids = rows.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    chunks = ids.mapInArrow(_chunks, "depth long, f long, s string, first long, ids string")
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "depth long, f long, s string, ends_sha256 string")


def rolled_up(shared: DataFrame) -> DataFrame:
    """(depth, conv_id, leaves, saved) summed over subtrees, of rows (depth, conv_id, parent_conv_id, leaves, saved).

    After round k a node holds the sums of what is less than 2^k below it and knows its ancestor 2^k above.
    """
    now = written(shared.withColumnRenamed("parent_conv_id", "up"), "rollup")
    deepest, step = now.agg(F.max("depth")).first()[0] or 0, 1
    while step < deepest:
        below = now.where(F.col("depth") > step).select((F.col("depth") - step).alias("depth"), F.col("up").alias("conv_id"), F.col("leaves").alias("l"), F.col("saved").alias("v"))
        below = below.groupBy("depth", "conv_id").agg(F.sum("l").alias("l"), F.sum("v").alias("v"))
        higher = now.where(F.col("depth") > step).select((F.col("depth") + step).alias("depth"), F.col("conv_id").alias("up"), F.col("up").alias("higher"))
        sums = now.join(below, ["depth", "conv_id"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("v", F.lit(0))}).drop("l", "v")
        deep = sums.where(F.col("depth") > 2 * step).join(higher, ["depth", "up"]).drop("up").withColumnRenamed("higher", "up")
        out = sums.where(F.col("depth") <= 2 * step).withColumn("up", F.lit(None).cast("long")).unionByName(deep)
        out = written(out, "rollup")
        dropped(now)
        now, step = out, 2 * step
    return now.drop("up")


def trie(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mask: int = -1, split_rounds: list | None = None) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``mask`` keeps some bits of the fingerprints only (for tests of collisions); ``split_rounds`` gets the rounds that split.
    """
    turns, convs = rebuilt(turns, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    rows, nodes = verified(fingerprinted(turns, mask=mask), split_rounds=split_rounds)
    nodes = nodes.withColumnRenamed("first", "conv_id")
    own = F.filter(F.split("s", ";"), lambda x: F.substring_index(x, ".", 1) != F.col("depth").cast("string"))
    child = nodes.where("depth > 1").withColumn("s_prev", F.array_join(own, ";")).withColumn("above", F.col("depth") - 1)
    parent = nodes.select(F.col("depth").alias("above"), F.col("f").alias("prev"), F.col("s").alias("s_prev"), F.col("conv_id").alias("parent_conv_id"))
    smallest, all_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    firsts = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    columns = ["depth", "conv_id", "parent_conv_id", "n", "words", "f", "s"]
    linked = written(child.join(parent, ["above", "prev", "s_prev"]).select(*columns).unionByName(firsts.select(*columns)), "linked")
    kids = linked.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum((F.col("n") == 1).cast("long")).alias("alone"))
    linked = written(linked.join(kids, ["depth", "conv_id"], "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "alone": F.coalesce("alone", F.lit(0))}), "linked")
    shared = linked.where("n > 1")
    sums = rolled_up(shared.select("depth", "conv_id", "parent_conv_id", (F.col("alone") + (F.col("kids") == 0).cast("long")).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")))
    alone = linked.where("n = 1").withColumns({"leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")})
    whole = written(shared.join(sums, ["depth", "conv_id"]).unionByName(alone), "whole")
    over = whole.where("depth = 1").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = over.where(F.lit(all_convs > 0)).select(F.lit(0).cast("long").alias("depth"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_convs).cast("long").alias("n"), "kids", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.lit(0).cast("long").alias("f"), F.lit("").alias("s"))
    turnless = convs.where("total = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), F.lit("").alias("s"), "conv_id")
    ended = ends(rows.where("depth = total").select("depth", "f", "s", "conv_id").unionByName(turnless))
    out = whole.drop("alone", "words").unionByName(root).join(ended, ["depth", "f", "s"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
