"""Prefix trie of conversations by burst containers.

Equal conversations are one sequence of turn ids with a count. All sequences begin in one container
under the root; a container with more suffixes than ``LIMIT`` bursts: its head grows into the trie node
where its suffixes part, and each suffix moves to the container under that node that its next turn id
names. What remains is dealt to shards by head, sorted and swept: a walk over sorted suffixes makes the
nodes below a head, and the heads get their sums from the containers under them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Suffixes that a container holds at most.
LIMIT = 256
#: Conversations whose ids lie in one range of so many are written down together before the digest of those that end at a node.
RUN = 1 << 14
#: Hex digits of a turn id (half a SHA-256 digest of role and text).
WIDE = 32
#: Oversized containers up to this number are sent to every task; more are joined by a shuffle.
SENT = 10_000
_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = tuple(c.split(" ")[0] for c in _NODE.split(", "))


def conversations(turns: DataFrame, shared_of: int = 0) -> DataFrame:
    """A row for each conversation: ``conv_id``, ``seq`` (turn ids joined), ``words`` (words of each turn).

    Turns stand by ascending ``turn``, null first, ties by role, then by id. A null role or text is empty;
    rows that repeat are turns of their own; rows without ``conv_id`` belong to no conversation and are
    left out. With ``shared_of`` (20, say) conversation c begins with the first h turns of conversation
    c - c % 20 (h: crc32 of c's decimal digits, mod 4) in place of its own first h. One conversation's turn
    ids (not texts) are one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, WIDE)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), turn_id.alias("id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    base = F.col("conv_id") - F.col("conv_id") % F.lit(shared_of or 1)
    own = turns.where(F.col("conv_id").isNotNull()).select(base.alias("base"), "conv_id", turn.alias("t")).repartition("base")
    own = own.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    if shared_of:
        own = own.selectExpr("*", "max(if(conv_id = base, slice(own, 1, 3), null)) over (partition by base) as first", "cast(crc32(cast(cast(conv_id as string) as binary)) % 4 as int) as h")
        own = own.selectExpr("conv_id", "concat(coalesce(slice(first, 1, h), slice(own, 1, 0)), slice(own, h + 1, greatest(size(own), 1))) as own")
    return own.selectExpr("conv_id", "array_join(own.id, '') as seq", "own.words as words")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a sequence, in ascending order of ids, become one row; the digest takes them in one by one."""
    held: list | None = None

    def closed() -> pa.RecordBatch:
        seq, words, n, least, digest = held
        return pa.RecordBatch.from_pydict({"seq": pa.array([seq]), "words": pa.array([words], pa.list_(pa.int32())), "n": pa.array([n], pa.int64()), "least": pa.array([least], pa.int64()), "ends": pa.array([digest.hexdigest()])})

    for batch in batches:
        ready = []
        for seq, words, n, least, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0] == seq:
                held[2] += n
                held[3] = min(held[3], least)
                held[4].update(b"," + ids.encode())
            else:
                if held is not None:
                    ready.append(closed())
                held = [seq, words, n, least, hashlib.sha256(ids.encode())]
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
    if held is not None:
        yield closed()


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences: ``seq``, ``words``, ``n`` conversations, the ``least`` of them, and ``ends``, the digest of all their ids.

    Ids of a range are gathered first (at most ``RUN``), so a sequence of very many conversations is a row for each range.
    """
    runs = convs.groupBy("seq", F.floor(F.col("conv_id") / RUN).alias("run")).agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    sorted_ = runs.repartition("seq").sortWithinPartitions("seq", "run").select("seq", "words", "n", "least", "ids")
    return sorted_.mapInArrow(_ends, "seq string, words array<int>, n long, least long, ends string")


def _shared_ids(a: str, b: str) -> Column:
    """How many ids the sequences ``a`` and ``b`` begin with in common."""
    both = f"cast(least(length({a}), length({b})) div {WIDE} as int)"
    # A place beyond both is taken as a difference, so there is always one.
    same = f"i < {both} and substring({a}, i * {WIDE} + 1, {WIDE}) = substring({b}, i * {WIDE} + 1, {WIDE})"
    return F.expr(f"cast(array_position(transform(sequence(0, {both}), i -> {same}), false) - 1 as int)")


def _burst(seqs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Suffixes in their last containers, the heads that burst, and the sequences that end at such a head.

    Each round splits every oversized container at the node where its suffixes part, so it ends when
    none has more than ``limit`` distinct suffixes.
    """
    active = seqs.selectExpr("*", "0 as depth", "array(named_struct('conv', 0L, 'depth', 0)) as heads", "cast(null as long) as above").withColumn("heads", F.slice("heads", 1, 0))
    active, settled, heads, ended = checkpointed(active), [], [], []
    while True:
        prefix = F.expr(f"substring(seq, 1, {WIDE} * depth)")
        large = active.groupBy(prefix.alias("prefix")).agg(
            F.count(F.lit(1)).alias("held"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min("seq").alias("low"), F.max("seq").alias("high"),
            F.min_by("words", "seq").alias("words"), F.min("depth").alias("depth"), F.first("heads").alias("heads"), F.first("above").alias("above"),
        ).where(F.col("held") > limit)
        large = checkpointed(large.withColumn("parts_at", _shared_ids("low", "high")).selectExpr("prefix", "n", "least", "slice(words, 1, parts_at) as words", "depth", "heads", "above", "parts_at"))
        n_large = large.count()
        if not n_large:
            return reduce(DataFrame.unionByName, [*settled, active]), *(reduce(DataFrame.unionByName, x) if x else None for x in (heads, ended))
        heads.append(large.drop("prefix"))
        here = large.selectExpr("prefix as _prefix", "least as _least", "depth as _depth", "parts_at as _parts_at")
        moved = checkpointed(active.join(F.broadcast(here) if n_large <= SENT else here, prefix == F.col("_prefix"), "left"))
        kept = active.columns
        settled.append(moved.where("_prefix is null").select(*kept))
        at_node = F.expr(f"length(seq) = {WIDE} * _parts_at")
        ended.append(moved.where(F.col("_prefix").isNotNull() & at_node).selectExpr("_least as conv", "_depth as depth", "ends"))
        onward = moved.where(F.col("_prefix").isNotNull() & ~at_node)
        active = onward.withColumns({"depth": F.expr("_parts_at + 1"), "heads": F.expr("array_append(heads, named_struct('conv', _least, 'depth', _depth))"), "above": F.col("_least")}).select(*kept)


def _nodes_of_container(rows: list[tuple], top: int, above: int | None) -> Iterator[tuple]:
    """Nodes from depth ``top`` on, of suffixes (sequence, words, n, least, ends) in sorted order; the top node first."""
    depth, n, least, children, leaves, saved, word, ends, parent = range(9)
    nodes: list[list] = []
    path: list[int] = []  # places of the open nodes, from the top

    def close() -> None:
        node = nodes[path.pop()]
        node[leaves] = node[leaves] or 1
        node[saved] += (node[n] - 1) * node[word]
        if path:
            up = nodes[path[-1]]
            up[n] += node[n]
            up[least] = min(up[least], node[least])
            up[leaves] += node[leaves]
            up[saved] += node[saved]
            up[children] += 1

    last = None
    for seq, words, count, smallest, digest in rows:
        size = len(seq) // WIDE
        shared = top - 1 if last is None else top
        if last is not None:
            most = min(size, len(last) // WIDE)
            while shared < most and seq[shared * WIDE : (shared + 1) * WIDE] == last[shared * WIDE : (shared + 1) * WIDE]:
                shared += 1
            while len(path) > shared - top + 1:
                close()
        for d in range(shared + 1, size + 1):
            nodes.append([d, 0, smallest, 0, 0, 0, words[d - 1] if d else 0, _NOTHING, path[-1] if path else None])
            path.append(len(nodes) - 1)
        node = nodes[path[-1]]
        node[n] += count
        node[least] = min(node[least], smallest)
        node[ends] = digest
        last = seq
    while path:
        close()
    for x in nodes:
        yield x[least], x[depth], above if x[parent] is None else nodes[x[parent]][least], x[n], x[children], x[leaves], x[saved], x[ends]


_NODE_TYPES = [pa.int64()] * 7 + [pa.string()]


def _batch(rows: list[tuple], extra: dict | None = None) -> pa.RecordBatch:
    columns = {c: pa.array(v, t) for c, v, t in zip(NODE_COLUMNS, zip(*rows, strict=True), _NODE_TYPES, strict=True)}
    return pa.RecordBatch.from_pydict(columns | (extra or {}))


_HEADS = pa.list_(pa.struct([("conv", pa.int64()), ("depth", pa.int32())]))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each container; the top node of a container carries the heads above it."""

    def suffixes() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    rows, tops = [], []
    for (depth, _), held in groupby(suffixes(), key=lambda r: (r[5], r[0][: WIDE * r[5]])):
        held = list(held)
        found = list(_nodes_of_container([r[:5] for r in held], depth, held[0][7]))
        rows += found
        tops += [held[0][6], *[None] * (len(found) - 1)]
        while len(rows) >= 10_000:
            yield _batch(rows[:10_000], {"heads": pa.array(tops[:10_000], _HEADS)})
            rows, tops = rows[10_000:], tops[10_000:]
    if rows:
        yield _batch(rows, {"heads": pa.array(tops, _HEADS)})


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a burst head: from where its container began to where its suffixes part."""
    for batch in batches:
        for n, least, words, depth, above, parts_at, children, leaves, saved, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            for d in range(parts_at, depth - 1, -1):
                saved += (n - 1) * (words[d - 1] if d else 0)
                last = d == parts_at
                rows.append((least, d, above if d == depth else least, n, children if last else 1, leaves, saved, (ends or _NOTHING) if last else _NOTHING))
            for at in range(0, len(rows), 10_000):
                yield _batch(rows[at : at + 10_000])


def trie_nodes(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node of the trie of ``convs`` (``conv_id``, ``seq``, ``words``; as ``conversations`` gives them).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's; null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, (n_convs - 1)
    times the words of a node's last turn) and ``ends_sha256`` (of the ids of those that end here, ascending, joined
    by commas). A conversation without turns is a member of the root. No conversations: no rows. ``limit`` decides
    how work is dealt, never results.
    """
    suffixes, heads, ended = _burst(sequences(convs), limit)
    shards = suffixes.withColumn("_head", F.expr(f"xxhash64(substring(seq, 1, {WIDE} * depth))")).repartition("_head").sortWithinPartitions("seq")
    swept = shards.select("seq", "words", "n", "least", "ends", "depth", "heads", "above").mapInArrow(_swept, f"{_NODE}, heads array<struct<conv: long, depth: int>>")
    if heads is None:
        return swept.select(*NODE_COLUMNS)
    swept = checkpointed(swept)
    # What lies under each head: containers give leaves and savings to all heads above, heads their own savings; each is a child of the last one.
    along = F.aggregate(F.slice("words", F.greatest("depth", F.lit(1)), F.greatest(F.expr("parts_at - greatest(depth, 1) + 1"), F.lit(0))), F.lit(0).cast("long"), lambda s, w: s + w)
    given = swept.where("heads is not null").selectExpr("heads", "n_leaves as leaves", "saved_tokens as saved")
    given = given.unionByName(heads.select("heads", F.lit(0).cast("long").alias("leaves"), ((F.col("n") - 1) * along).alias("saved")))
    shares = given.selectExpr("posexplode(heads) as (at, head)", "leaves", "saved", "size(heads) as under").selectExpr("head.conv as conv", "head.depth as depth", "leaves", "saved", "if(at = under - 1, 1L, 0L) as child", "cast(null as string) as ends")
    shares = shares.unionByName(ended.selectExpr("conv", "depth", "0L as leaves", "0L as saved", "0L as child", "ends"))
    sums = shares.groupBy(F.col("conv").alias("least"), "depth").agg(F.sum("child").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    chains = heads.join(sums, ["least", "depth"]).select("n", "least", "words", "depth", "above", "parts_at", "children", "leaves", "saved", "ends").mapInArrow(_chains, _NODE)
    return swept.select(*NODE_COLUMNS).unionByName(chains)
