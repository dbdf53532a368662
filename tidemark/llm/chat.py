"""Chat formatting into prefix trees of tokens: shared turns are emitted once, with positions, loss marks and attention intervals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.byte_bpe import kept_tables, read_ranks
from tidemark.llm.common import PARTS, cut, with_total

#: The template of a turn: OPEN role SEP text CLOSE. A backslash before a control string, or before a backslash, takes its meaning.
OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
NO_STEM = 0

Encode = Callable[[list[str]], list[np.ndarray]]


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What a turn is emitted as: its head, its escaped text, its end."""
    return f"{OPEN}{escape(role, ROLE_CONTROL)}{SEP}", escape(text), CLOSE


def format_turn(role: str, text: str) -> str:
    return "".join(turn_parts(role, text))


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation was made of.

    A colon within a role has an odd number of backslashes before it, and one of a text's own `</turn>` stands right after a backslash, so
    never after the space of CLOSE; both are found by searching on, without memory for the text.
    """
    out, at = [], 0
    while at < len(formatted):
        sep = formatted.find(SEP, at)
        while sep > 0 and (sep - len(formatted[at:sep].rstrip("\\")) - at) % 2:
            sep = formatted.find(SEP, sep + 1)
        end = formatted.find(CLOSE, sep + len(SEP))
        if not formatted.startswith(OPEN, at) or sep < 0 or end < 0:
            raise ValueError("not a formatted conversation")
        out.append((unescape(formatted[at + len(OPEN) : sep]), unescape(formatted[sep + len(SEP) : end])))
        at = end + len(CLOSE)
    return out


def pack_tree(conversations: list[list[tuple[str, str]]], encode: Encode, position: int = 0) -> tuple[np.ndarray, list[dict], list[int]]:
    """(token ids, nodes, last node of each conversation) of the prefix tree of some conversations.

    A node is one turn after one path of turns. Nodes are emitted once, depth first; their intervals count tokens. A node's
    positions go on from its parent's, a first turn's from `position`, and it attends to the intervals of its
    ancestors and its own; loss marks the text of assistant turns. A conversation without turns of its own has node -1.
    """
    root: dict = {"next": {}, "id": -1}
    ends = []
    for turns in conversations:
        node = root
        for turn in turns:
            node = node["next"].setdefault(turn, {"next": {}})
        ends.append(node)
    order: list[tuple] = []
    stack = [(turn, child, root) for turn, child in reversed(root["next"].items())]
    while stack:
        turn, node, parent = stack.pop()
        node["id"] = len(order)
        order.append((turn, node, parent))
        stack += [(t, child, node) for t, child in reversed(node["next"].items())]
    parts = [p for turn, _, _ in order for p in turn_parts(*turn)]
    ids = encode(parts) if parts else []
    nodes: list[dict] = []
    at = 0
    for k, ((role, _), _, parent) in enumerate(order):
        head, text, close = (len(x) for x in ids[3 * k : 3 * k + 3])
        before = nodes[parent["id"]] if parent["id"] >= 0 else None
        start = before["position"] + before["end"] - before["begin"] if before else position
        attends, end = [*before["attends"]] if before else [], at + head + text + close
        if attends and attends[-1][1] == at:  # the parent was emitted just before: one interval
            attends[-1] = [attends[-1][0], end]
        else:
            attends.append([at, end])
        loss = [at + head, at + head + text] if role == "assistant" else None
        nodes.append({"parent": parent["id"], "begin": at, "end": end, "position": start, "loss": loss, "attends": attends})
        at = end
    return np.concatenate(ids) if len(ids) else np.zeros(0, np.int32), nodes, [n["id"] for n in ends]


INTERVALS = "array<array<int>>"
NODE = f"struct<parent: int, begin: int, end: int, position: int, loss: array<int>, attends: {INTERVALS}>"
PACKS = f"pack bigint, stem bigint, depth int, ids array<int>, positions array<int>, nodes array<{NODE}>, conversations array<struct<conv_id: KIND, node: int>>"
_NODE = pa.struct([("parent", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("loss", pa.list_(pa.int32())), ("attends", pa.list_(pa.list_(pa.int32())))])


def _pack(pack: int, stem: int, depth: int, tree: tuple, members: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    ids, nodes, _ = tree
    positions = np.concatenate([np.arange(n["end"] - n["begin"], dtype=np.int32) + n["position"] for n in nodes]) if nodes else ids
    columns = [
        pa.array([pack], pa.int64()), pa.array([stem], pa.int64()), pa.array([depth], pa.int32()), pa.array([ids], pa.list_(pa.int32())),
        pa.array([positions], pa.list_(pa.int32())), pa.array([nodes], pa.list_(_NODE)), pa.array([members], pa.list_(pa.struct([("conv_id", kind), ("node", pa.int32())]))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["pack", "stem", "depth", "ids", "positions", "nodes", "conversations"])


def format_conversations(turns: DataFrame, pack_size: int = 64, id_col: str = "conv_id", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Packs of conversations: token ids, a position id for each, nodes, and the last node of each conversation.

    Conversations with one first turn go to one pack, for their tree to share it. A first turn with more than pack_size conversations
    becomes a stem: a pack of that turn and all further turns that these conversations share, emitted once, which the packs of its conversations refer to; these are parted
    by their next turns, and so on, as long as a branch is larger than a pack. Rounds grow with branchings, not with turns. Conversations that end where a stem does are packed by a hash and have
    no tokens of their own. The branches of a stem share packs of about pack_size conversations, whose positions go on from the stem's. So every
    turn after one path of turns is emitted once, and no task holds a hot tree. Only hashes of paths are counted for
    this; the turns move once more, to their pack. Tokens are those of the byte-level BPE; heads, texts and ends of turns are encoded apart.

    Defined results: rows of a conversation are in order of turn, ties by role, then text; null turns come first; null roles and texts are
    empty; rows that repeat are turns like others. A row with a null id is a conversation by itself. An empty table gives no packs. Other columns aren't read.
    """
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(path))
    one = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(id_col).alias("conv_id"), lone.alias("lone"), one.alias("one"))
    whole = rows.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("one")).alias("turns")).drop("lone")
    step = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    paths = F.aggregate(step, F.array(F.lit(NO_STEM).cast("bigint")), lambda acc, h: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), h))))
    whole = cut(whole.withColumns({"row": F.monotonically_increasing_id(), "paths": paths}))
    kind, id_kind = whole.schema["conv_id"].dataType.simpleString(), to_arrow_type(whole.schema["conv_id"].dataType)

    # one round a branching: `row`, its path, the stem that it has so far, how many of its turns that covers, and the position that it ends at, for rows that are not placed yet
    open_ = whole.select("row", "paths", F.element_at("paths", 1).alias("stem"), F.lit(0).alias("depth"), F.lit(0).alias("upto"))
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    placed, stems, level = None, None, 0
    while True:
        level += 1
        branch = F.coalesce(F.get("paths", F.col("depth") + 1), F.xxhash64(F.lit("end"), "stem", "row"))
        counted = with_total(open_.withColumn("branch", branch), "stem", "row", F.count(F.lit(1)), F.sum, "siblings")
        counted = cut(with_total(counted, "branch", "row", F.count(F.lit(1)), F.sum, "n"))
        bins = F.ceil(F.col("siblings") / pack_size)
        small = counted.filter(F.col("n") <= pack_size).select("row", "stem", "depth", "upto", F.xxhash64(F.lit("pack"), "stem", F.pmod(F.xxhash64(F.lit(1), "branch"), bins)).alias("pack"))
        placed = small if placed is None else placed.unionByName(small)
        large = counted.filter(F.col("n") > pack_size).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
        heads = cut(large.groupBy("branch").agg(F.min(F.struct("row", "stem", "depth", "upto", "paths")).alias("head")).select("branch", "head.*"))
        if heads.isEmpty():
            break
        # a path's entries stand for all turns up to them, so as many turns are shared as entries are equal
        met = large.join(heads.select("branch", F.col("paths").alias("own"), every), ["branch", "part"])
        same = F.size(F.filter(F.zip_with("paths", "own", lambda x, y: x == y), lambda x: x)) - 1
        reach = met.groupBy("branch").agg(F.min(same).alias("reach"))
        run = F.expr("slice(turns, depth + 1, reach - depth)").alias("turns")
        found = heads.drop("paths").join(reach, "branch").join(whole.select("row", "turns"), "row").select("branch", "stem", "upto", "reach", run)

        def stem_packs(batches: Iterable[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            _, encode = kept_tables(path, pattern, shared.value)
            for batch in batches:
                for pack, stem, upto, _, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield _pack(pack, stem, level, pack_tree([[(t["role"], t["text"]) for t in turns]], encode, upto), [], id_kind)

        found = cut(found)
        new = cut(found.mapInArrow(stem_packs, PACKS.replace("KIND", kind)))
        stems = new if stems is None else stems.unionByName(new)
        ends = new.select(F.col("pack").alias("branch"), (F.get("nodes", F.lit(0))["position"] + F.size("ids")).alias("end"))
        ends = ends.join(found.select("branch", "reach"), "branch").select("branch", "end", "reach", every)
        further = large.select("row", "paths", "branch", "part").join(ends, ["branch", "part"])
        open_ = further.select("row", "paths", F.col("branch").alias("stem"), F.col("reach").alias("depth"), F.col("end").alias("upto"))

    def build(table: pa.Table) -> pa.Table:
        _, encode = kept_tables(path, pattern, shared.value)
        pack, stem, depth, upto = (table.column(c)[0].as_py() for c in ("pack", "stem", "depth", "upto"))
        own = [[(t["role"], t["text"]) for t in turns] for turns in table.column("turns").to_pylist()]
        order = sorted(range(len(own)), key=own.__getitem__)
        tree = pack_tree([own[k] for k in order], encode, upto)
        ids = table.column("conv_id")
        members = [{"conv_id": ids[k].as_py(), "node": n} for k, n in zip(order, tree[2], strict=True)]
        return pa.Table.from_batches([_pack(pack, stem, depth, tree, members, id_kind)])

    rest = F.expr("slice(turns, depth + 1, greatest(size(turns) - depth, 0))")
    dealt = whole.select("row", "conv_id", "turns").join(placed, "row").select("pack", "stem", "depth", "upto", "conv_id", rest.alias("turns"))
    packs = dealt.groupBy("pack").applyInArrow(build, PACKS.replace("KIND", kind))
    return packs if stems is None else packs.unionByName(stems)


def read_conversations(packs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """conv_id, turns array of (role, text), loss_text, formatted_chars, read back from packs: tokens decoded, by intervals and loss marks alone.

    Stems are put together once, level by level; then packs meet the whole stem that they refer to, by stem and a part of it.
    """
    shared = packs.sparkSession.sparkContext.broadcast(read_ranks(path))
    packs = cut(packs)
    single = packs.filter(F.size("conversations") == 0)
    deepest = single.agg(F.max("depth")).first()[0] or 0
    whole, level = None, None
    for depth in range(1, deepest + 1):
        own = single.filter(F.col("depth") == depth).select(F.col("pack").alias("at"), "stem", "ids", "nodes")
        marked = F.expr("transform(filter(nodes, n -> n.loss IS NOT NULL), n -> slice(ids, n.loss[0] + 1, n.loss[1] - n.loss[0]))")
        level = own.select("at", "stem", "ids", marked.alias("marked")) if depth == 1 else (
            own.join(level.select(F.col("at").alias("stem"), F.col("ids").alias("ids0"), F.col("marked").alias("marked0")), "stem")
            .select("at", "stem", F.concat("ids0", "ids").alias("ids"), F.concat("marked0", marked).alias("marked"))
        )
        level = cut(level)
        whole = level if whole is None else whole.unionByName(level)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = kept_tables(path, pattern, shared.value)
        text = lambda ids: vocabulary.decode(np.asarray(ids, np.int32)).decode()
        for batch in batches:
            for k in range(batch.num_rows):
                tokens, nodes, members = batch.column(0)[k].values.to_numpy(), batch.column(1)[k].as_py(), batch.column(2)[k]
                stem = text(batch.column(3)[k].as_py() or [])
                stem_loss = [text(x) for x in batch.column(4)[k].as_py() or []]
                ids, turns, loss, chars = members.values.field("conv_id"), [], [], []
                for member in members.as_py():
                    up = member["node"]
                    formatted = stem + text(np.concatenate([tokens[a:b] for a, b in nodes[up]["attends"]]) if up >= 0 else [])
                    marked = []
                    while up >= 0:
                        if nodes[up]["loss"]:
                            marked.append(text(tokens[slice(*nodes[up]["loss"])]))
                        up = nodes[up]["parent"]
                    turns.append([{"role": r, "text": t} for r, t in parse_turns(formatted)])
                    loss.append("".join(map(unescape, [*stem_loss, *reversed(marked)])))
                    chars.append(len(formatted))
                kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "turns", "loss_text", "formatted_chars"])

    kind = packs.schema["conversations"].dataType.elementType["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars bigint"
    filled = packs.filter(F.size("conversations") > 0).select("pack", "stem", "ids", "nodes", "conversations")
    if whole is None:
        met = filled.withColumns({"stem_ids": F.lit(None).cast("array<int>"), "stem_marked": F.lit(None).cast("array<array<int>>")})
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        copies = whole.select(F.col("at").alias("stem"), F.col("ids").alias("stem_ids"), F.col("marked").alias("stem_marked"), parts.alias("part"))
        met = filled.withColumn("part", F.pmod(F.xxhash64("pack"), F.lit(PARTS)).cast("int")).join(copies, ["stem", "part"], "left")
    return met.select("ids", "nodes", "conversations", "stem_ids", "stem_marked").mapInArrow(read, schema)
