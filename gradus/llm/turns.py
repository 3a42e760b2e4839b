"""Cheapest repair of conversations, by a shortest path whose cost vectors are kept only at checkpoints.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant. Walking through
a conversation's rows, what has been given out so far is one of four states, and an edit leads from one to another.
The least cost from each state to the end, computed from the last row backward, tells which edits are tight.

The vectors of all rows are never held. Within a piece of rows they are kept at about the square root of its rows and
computed again, stretch by stretch, on the walk forward. Conversations are pieces themselves: rows are dealt by order
into pieces of at most the square root of all rows (a thousand at least). A piece becomes a 4 x 4 matrix of least
costs; a conversation's matrices, backward, give the vectors at its checkpoints, the pieces' ends; each piece then
says where every state it is entered in leads; and the walk through each piece emits its edits. So one conversation
that holds most rows is repaired by many tasks. Only the text of the result is put in order per conversation, as a
stream of which a task holds a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import inf, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, map_rows, named, written

#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Nothing yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state a new turn of the only fitting role leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: Rows of a piece, at least.
PIECE = 1024
#: Costs beyond the last row: a conversation ends empty or after an assistant.
END = (0, 2 * INSERT, INSERT, 0)
ENDING = ("", "II", "I", "")

#: A row's code: its role's initial (s, u, a, another) and its fault (none, truncated, duplicate, blank), one letter.
INITIALS = "sua"
FAULTS = ("", "truncated", "duplicate", "blank")
LETTERS = "abcdefghijklmnop"


def _kept(state: int, initial: int) -> int | None:
    """The state after a turn with this initial is kept, if it may be."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


@lru_cache(maxsize=1 << 16)
def layer(after: tuple, code: str) -> tuple[tuple, int, tuple]:
    """One row backward: the costs before it (less their least), that least, and for each state before it the
    ASCII-least tight edits up to and with this row and the state they lead to.

    ``after`` are the costs behind the row, less their least; so there are few different vectors, and results are
    kept."""
    initial, fault = LETTERS.index(code) % 4, LETTERS.index(code) // 4
    extra = LEFT_TRUNCATED if fault == 1 else 0
    steps: list[list[tuple[str, float, int]]] = []
    for state in range(4):
        own = [("D", DELETE + after[state], state)]
        if fault < 2:
            to = _kept(state, initial)
            if to is not None:
                own.append(("K", extra + after[to], to))
            own.append(("R", REROLE + extra + after[NEXT[state]], NEXT[state]))
        steps.append(own)
    cost = [min(c for _, c, _ in own) for own in steps]
    for _ in range(2):  # an insertion may follow another
        cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in range(4)]
    moves = []
    for state in range(4):
        edits, at = "", state
        while cost[state] < inf:
            tight = sorted([(e, to) for e, c, to in steps[at] if c == cost[at]] + ([("I", NEXT[at])] if cost[at] == INSERT + cost[NEXT[at]] else []))
            edit, at = tight[0]
            edits += edit
            if edit != "I":
                break
        moves.append((edits, at))
    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(moves)


def costs(codes: str, after: tuple) -> tuple:
    """Least costs, from each state, of the rows and what follows them."""
    least = min(after)
    vector, total = tuple(c - least for c in after), least
    for code in reversed(codes):
        vector, least, _ = layer(vector, code)
        total += least
    return tuple(total + c for c in vector)


def stretches(codes: str, after: tuple) -> Iterator[list[tuple]]:
    """The moves of every row in order, a stretch at a time: vectors are kept at the stretches' ends, and those
    between are computed again when the walk comes to them."""
    step = max(1, isqrt(len(codes)))
    least = min(after)
    vector = tuple(c - least for c in after)
    ends = [(len(codes), vector)]
    for at in range(len(codes) - 1, -1, -1):
        vector = layer(vector, codes[at])[0]
        if at % step == 0:
            ends.append((at, vector))
    ends.reverse()
    for (low, _), (high, vector) in zip(ends, ends[1:]):
        moves = []
        for code in reversed(codes[low:high]):
            vector, _, own = layer(vector, code)
            moves.append(own)
        yield moves[::-1]


def walk(codes: str, after: tuple, state: int) -> tuple[str, int]:
    """The edits of a piece entered in ``state``, and the state it is left in."""
    parts = []
    for moves in stretches(codes, after):
        for own in moves:
            edits, state = own[state]
            parts.append(edits)
    return "".join(parts), state


def leads(codes: str, after: tuple) -> list[int]:
    """The state a piece is left in, for each it may be entered in."""
    states = list(range(4))
    for moves in stretches(codes, after):
        for own in moves:
            states = [own[s][1] for s in states]
    return states


def matrix(codes: str) -> list[float]:
    """Least costs from each state (rows) to each (columns)."""
    columns = [costs(codes, tuple(0 if s == end else inf for s in range(4))) for end in range(4)]
    return [float(columns[end][s]) for s in range(4) for end in range(4)]


def checkpoints(matrices: list[list[float]]) -> list[tuple]:
    """Costs behind each piece of a conversation, and before the first."""
    vectors = [tuple(float(c) for c in END)]
    for m in reversed(matrices):
        vectors.append(tuple(min(m[4 * s + e] + vectors[-1][e] for e in range(4)) for s in range(4)))
    return vectors[::-1]


def repaired(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation, in one piece."""
    edits, state = walk(codes, END, START)
    return int(costs(codes, END)[START]), edits + ENDING[state]


def illegal_neighbours(codes: str) -> int:
    pairs = zip(codes, codes[1:])
    return sum((LETTERS.index(a) % 4, LETTERS.index(b) % 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in pairs)


def conversation_key(conv_id: str) -> Column:
    """A text that tells conversations apart, those without id being one."""
    return F.when(named(conv_id).isNull(), "").otherwise(F.concat(F.lit("="), named(conv_id).cast("string")))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with known damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties
    its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's. Nulls in key, role and text become
    one space; other columns are left out."""
    plain = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    rows = rows.select(named(conv_id).alias("conv_id"), named(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"), F.concat_ws(":", plain(conv_id), plain(turn)).alias("name"))
    rows = rows.withColumn("kind", F.crc32(F.col("name").cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's key and the text's hash. Their order: turn (nulls first), role, hash; rows that
    agree in all three are copies."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(conversation_key("conv_id").alias("k"), "turn", whole("role").alias("role"), whole("text").alias("text")).withColumn("hash", F.xxhash64("text"))


def _coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, id, code) of all rows, and the rows without texts; ids ascend in the rows' order, whichever conversation
    holds most of them."""
    visible = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    slim = _keyed(rows).select(
        "k", "turn", "role", "hash",
        F.array_position(F.array(*[F.lit(i) for i in INITIALS]), F.substring("role", 1, 1)).alias("initial"),
        F.when(visible == "", "blank").when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
    )
    # The last key parts copies of one row, which are alike; partition and row number then order all rows.
    slim = slim.withColumn("one", F.monotonically_increasing_id())
    order = ["k", "turn", "role", "hash", "one"]
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("one").withColumn("id", F.monotonically_increasing_id())
    slim = written(slim, "turns")
    repeated = slim.groupBy("k", "role", "hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = slim.join(repeated, ["k", "role", "hash"], "left")
    fault = F.when(F.col("fault") == "blank", 3).when(F.col("id") > F.col("first"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    initial = F.when(F.col("initial") == 0, 3).otherwise(F.col("initial") - 1)
    return both.select("k", "id", F.substring(F.lit(LETTERS), (initial + 4 * fault + 1).cast("int"), F.lit(1)).alias("code")), slim


def _pieces(coded: DataFrame, size: int) -> DataFrame:
    """(k, piece, codes): at most ``size`` rows each, in order."""
    within = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    piece = F.shiftright("id", 33) * F.lit(1 << 33) + F.floor(within / size)
    held = F.array_sort(F.collect_list(F.struct("id", "code")))
    return coded.groupBy("k", piece.alias("piece")).agg(F.array_join(F.transform(held, lambda x: x["code"]), "").alias("codes"))


def audits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k, blank, duplicate, truncated, illegal, cost, audit, gaps) of every conversation that has rows (conv_id, turn,
    role, text); see ``repair``."""
    coded, slim = _coded(rows)
    size = max(piece, isqrt(slim.count()))

    def first(codes):
        held = codes.to_pylist()
        by = [[sum(c.count(x) for x in LETTERS[4 * f : 4 * f + 4]) for c in held] for f in (3, 2, 1)]
        return [matrix(c) for c in held], *by, [illegal_neighbours(c) for c in held], [c[0] for c in held], [c[-1] for c in held]

    out = "matrix array<double>, blank long, duplicate long, truncated long, illegal long, head string, tail string"
    pieces = written(map_columns(_pieces(coded, size), ["k", "piece", "codes"], ["codes"], out, first), "turn-pieces")
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct("piece", *c))).alias("held")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    chains = pieces.groupBy("k").agg(ordered("matrix", "head", "tail"), *sums)

    def backward(chains):
        after, cost, between = [], [], []
        for held in chains.to_pylist():
            vectors = checkpoints([h["matrix"] for h in held])
            cost.append(int(vectors[0][START]))
            between.append(sum(illegal_neighbours(a["tail"] + b["head"]) for a, b in zip(held, held[1:])))
            after.append([{"piece": h["piece"], "after": list(v)} for h, v in zip(held, vectors[1:])])
        return after, cost, between

    kept = ["k", "blank", "duplicate", "truncated", "illegal"]
    chains = written(map_columns(chains, kept, ["held"], "behind array<struct<piece:long,after:array<double>>>, cost long, between long", backward), "turn-chains")
    behind = chains.select("k", F.explode("behind").alias("b")).select("k", "b.*")

    def leading(codes, after):
        return ([leads(c, tuple(a)) for c, a in zip(codes.to_pylist(), after.to_pylist())],)

    marked = pieces.select("k", "piece", "codes").join(behind, ["k", "piece"])
    marked = written(map_columns(marked, ["k", "piece", "codes", "after"], ["codes", "after"], "leads array<int>", leading), "turn-leads")

    def forward(chains):
        entered, ending = [], []
        for held in chains.to_pylist():
            state, own = START, []
            for h in held:
                own.append({"piece": h["piece"], "state": state})
                state = h["leads"][state]
            entered.append(own)
            ending.append(ENDING[state])
        return entered, ending

    states = map_columns(marked.groupBy("k").agg(ordered("leads")), ["k"], ["held"], "entered array<struct<piece:long,state:int>>, ending string", forward)
    states = written(states, "turn-states")
    entered = states.select("k", F.explode("entered").alias("e")).select("k", "e.*")

    def edits(codes, after, state):
        return ([walk(c, tuple(a), s)[0] for c, a, s in zip(codes.to_pylist(), after.to_pylist(), state.to_pylist())],)

    walked = map_columns(marked.join(entered, ["k", "piece"]), ["k", "piece"], ["codes", "after", "state"], "edits string", edits)
    walked = walked.groupBy("k").agg(F.array_join(F.transform(ordered("edits"), lambda x: x["edits"]), "").alias("edits"))
    exact = lambda c: c.cast("decimal(20,0)")
    span = exact(F.max("turn").cast("long")) - exact(F.min("turn").cast("long")) + 1 - exact(F.count_distinct("turn"))
    gaps = slim.groupBy("k").agg(F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"))
    done = chains.join(walked, "k").join(states.select("k", "ending"), "k").join(gaps, "k")
    return done.select("k", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", F.concat("edits", "ending").alias("audit"))


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(k, place, role, text) of the repaired conversations. Each lies in one partition, in order: a stream of its rows
    behind its audit, of which a task holds one batch and the audit."""
    texts = _keyed(rows).select("k", F.lit(1).alias("kind"), "turn", "role", "hash", "text")
    first = audited.select("k", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("hash"), F.col("audit").alias("text"))
    stream = texts.unionByName(first).repartition("k").sortWithinPartitions("k", "kind", "turn", "role", "hash")
    given = ("", "system", "user", "assistant")

    def work(batches: Iterator[list]) -> Iterator[dict]:
        audit, at, state, place, held = "", 0, START, 0, None
        out: dict[str, list] = {}

        def give(role: str, text: str) -> None:
            nonlocal place
            for name, value in zip(("k", "place", "role", "text"), (held, place, role, text)):
                out[name].append(value)
            place += 1

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = NEXT[state], at + 1
                give(given[state], "")

        for k, kind, role, text in batches:
            out = {"k": [], "place": [], "role": [], "text": []}
            for own, what, who, said in zip(k.to_pylist(), kind.to_pylist(), role.to_pylist(), text.to_pylist()):
                if what == 0:
                    audit, at, state, place, held = said, 0, START, 0, own
                    inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _kept(state, INITIALS.find(who[:1]))
                    give(who, said)
                elif edit == "R":
                    state = NEXT[state]
                    give(given[state], said)
                inserted()
            yield out

    return map_rows(stream, ["k", "kind", "role", "text"], "k string, place long, role string, text string", work)


def digests(turns: DataFrame) -> DataFrame:
    """(k, repaired_sha256): a checksum over ``role:text`` of each conversation's turns, newlines between. The turns
    come as ``repaired_turns`` leaves them: a conversation in one partition, in order."""
    import hashlib

    def work(batches: Iterator[list]) -> Iterator[dict]:
        held, sum_ = None, None
        for k, role, text in batches:
            done: dict[str, list] = {"k": [], "repaired_sha256": []}
            for own, who, said in zip(k.to_pylist(), role.to_pylist(), text.to_pylist()):
                if sum_ is not None and own == held:
                    sum_.update(b"\n")
                else:
                    if sum_ is not None:
                        done["k"].append(held)
                        done["repaired_sha256"].append(sum_.hexdigest())
                    held, sum_ = own, hashlib.sha256()
                sum_.update(f"{who}:{said}".encode())
            yield done
        if sum_ is not None:
            yield {"k": [held], "repaired_sha256": [sum_.hexdigest()]}

    return map_rows(turns, ["k", "role", "text"], "k string, repaired_sha256 string", work)


def repair(rows: DataFrame, conversations: DataFrame | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """A report per conversation and its repaired turns (k, place, role, text).

    ``rows`` has conv_id, turn, role and text; others are ignored. ``conversations`` may name (conv_id) those to
    report on, with or without rows. Null roles and texts are one space; null turns come first; rows of one turn
    follow by role and hash of the text, copies being neighbours; rows without conv_id are one conversation. A role
    whose initial is not s, u or a, or that is empty, cannot be kept. Faults of a row, the first of which counts:
    blank, a role and text that the conversation had before, no sentence end. ``gaps`` is null where turns span more
    than a 64-bit integer. A conversation without rows has zeros, an empty audit and the hash of the empty text.
    """
    names = rows if conversations is None else conversations
    audited = written(audits(rows, piece), "turn-audits")
    turns = repaired_turns(rows, audited)
    sums = digests(turns)
    every = names.select(conversation_key("conv_id").alias("k"), "conv_id").groupBy("k").agg(F.first("conv_id").alias("conv_id"))
    zero = lambda c: F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c)
    report = every.join(audited, "k", "left").join(sums, "k", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
    return report, turns
