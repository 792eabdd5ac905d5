"""Conversation structure repair by a dynamic programme over retained turns.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. Turns are kept,
given the role of a user or an assistant, or deleted; empty turns are inserted. The programme
chooses which turns stay and under which initial. What lies between two retained turns
is deleted, priced by the difference of prefix deletion sums, so each last initial needs only one running
minimum (cost less the deletion sum before it); the pair of initials tells which turns
have to be inserted. Costs tie by the audit, the string of edits; deletions come before insertions
between two retained turns, as that is the lesser string.

Rows are dealt out by ranges of (conversation, turn), so a conversation may lie in several
partitions, and is cut into pieces of at most ``PIECE`` different turns. A piece is a matrix: the cheapest
edits for each initial before it and after it. A conversation that lies inside one piece, away from
the ends of its partition, is finished in that task; the pieces of the others are chained by their matrices, without their
texts, and then edited each on its own. Only the turns' digests decide what is a
duplicate, so a text is shuffled twice (grouped, ordered) and repeated turns are counts.

Defined cases: null roles and texts are one space; a null turn comes first; turns that tie
follow role and digest of role and text; a null conversation is a conversation; a
conversation without turns costs nothing and has an empty audit. An empty table gives no
rows; columns of other names are not read. A conversation's audit is one string, so it has to fit a row;
its texts do not have to.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draper.llm.common import Scratch, settings

PIECE = 1024
PIECE_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
#: States: nothing retained yet, or the last retained initial.
START, S, U, A = range(4)
#: Turns to insert before retaining an initial in a state; absent pairs can't be joined.
GAP = {(START, S): 0, (START, U): 0, (S, U): 0, (A, U): 0, (U, U): 1, (U, A): 0, (START, A): 1, (S, A): 1, (A, A): 1}
#: Turns to insert at the end of a conversation.
ENDS = {START: 0, S: 2, U: 1, A: 0}


class Cheapest:
    """Cheapest edits of a piece from one state: for each last state (cost less deletions, edits, turns that the edits cover)."""

    def __init__(self, state: int):
        self.best: dict[int, tuple[int, str, int]] = {state: (0, "", 0)}

    def retain(self, at: int, initial: str, truncated: bool) -> None:
        """The turn ``at`` (turns before it) may stay; without this call it is deleted."""
        found = {}
        for to, own in ((S, "s"), (U, "u"), (A, "a")):
            if to == S and initial != "s":
                continue
            step, price = ("K", KEEP) if initial == own else ("R", REROLE)
            ways = [
                (cost + DELETE * at + INSERT * GAP[r, to] + price + TRUNCATED * truncated, edits + "D" * (at - upto) + "I" * GAP[r, to] + step)
                for r, (cost, edits, upto) in self.best.items() if (r, to) in GAP
            ]
            if ways:
                found[to] = min(ways)
        for to, (cost, edits) in found.items():
            before = self.best.get(to)
            if before is None or (cost - DELETE * (at + 1), edits) < (before[0], before[1] + "D" * (at + 1 - before[2])):
                self.best[to] = (cost - DELETE * (at + 1), edits, at + 1)

    def after(self, turns: int) -> dict[int, tuple[int, str]]:
        return {r: (cost + DELETE * turns, edits + "D" * (turns - upto)) for r, (cost, edits, upto) in self.best.items()}


class Piece:
    """Neighbouring turns of one conversation: their faults, their edges and their matrix."""

    def __init__(self, conv, seq: int, begins: bool):
        self.conv, self.seq, self.begins, self.turns, self.bytes, self.rows = conv, seq, begins, 0, 0, 0
        self.kept: list[tuple[int, str, str]] = []  # place, role, text of turns that may stay
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns; the order makes them the first and the last known
        self.ways = {state: Cheapest(state) for state in ((START,) if begins else (START, S, U, A))}

    def other_states(self) -> None:
        """A first piece that may continue an earlier one needs every state; its turns run again."""
        self.ways |= {state: Cheapest(state) for state in (S, U, A)}
        for at, role, text in self.kept:
            for state in (S, U, A):
                self.ways[state].retain(at, role[:1], _truncated(text))

    def add(self, turn, role: str, n: int, blank: bool, text: str | None) -> None:
        """n equal turns; ``text`` is given if the first of them is the first of its conversation."""
        if not n:
            return
        self.rows += 1
        initial = role[:1]
        self.counts["illegal"] += (self.last is not None and self.last + initial not in LEGAL) + (n - 1) * (initial * 2 not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.counts["distinct"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank:
            self.counts["blank"] += n
        elif text is None:
            self.counts["duplicate"] += n
        else:
            cut = _truncated(text)
            self.counts["truncated"] += cut
            self.counts["duplicate"] += n - 1
            for way in self.ways.values():
                way.retain(self.turns, initial, cut)
            self.kept.append((self.turns, role, text))
            self.bytes += len(text)
        self.turns += n

    def full(self) -> bool:
        return self.rows >= PIECE or self.bytes >= PIECE_BYTES


def _truncated(text: str) -> bool:
    return text.rstrip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")


def edited(state: int, edits: str, kept: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """(role, text) of the turns that the edits leave or insert; ``state`` is the one before them."""
    texts = {at: (role, text) for at, role, text in kept}
    out, at = [], 0
    for e in edits:
        if e in "IR":
            role, state = ("assistant", A) if state == U else ("user", U)
            out.append((role, texts[at][1] if e == "R" else ""))
        elif e == "K":
            out.append(texts[at])
            state = {"s": S, "u": U, "a": A}[texts[at][0][:1]]
        at += e != "I"
    return out


COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal", "distinct"]
PIECES = (
    "conv_id long, pid int, seq int, open boolean, cost long, edits string, repaired array<struct<role string, text string>>,"
    + "".join(f" {c} long," for c in COUNTS)
    + " first string, last string, low long, high long, ways array<struct<before int, after int, cost long, edits string>>,"
    " kept array<struct<at long, role string, text string>>"
)
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
ARROW = pa.schema([
    ("conv_id", pa.int64()), ("pid", pa.int32()), ("seq", pa.int32()), ("open", pa.bool_()), ("cost", pa.int64()), ("edits", pa.string()), ("repaired", TURNS),
    *((c, pa.int64()) for c in COUNTS), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
    ("ways", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))),
    ("kept", pa.list_(pa.struct([("at", pa.int64()), ("role", pa.string()), ("text", pa.string())]))),
])


def _row(piece: Piece, pid: int, alone: bool) -> dict:
    out = {"conv_id": piece.conv, "pid": pid, "seq": piece.seq, "open": not alone, "turns": piece.turns, **piece.counts}
    out |= {"first": piece.first, "last": piece.last, "low": piece.low, "high": piece.high}
    if alone:
        cost, edits = min((cost + INSERT * ENDS[r], e + "I" * ENDS[r]) for r, (cost, e) in piece.ways[START].after(piece.turns).items())
        repaired = edited(START, edits, piece.kept)
        return out | {"cost": cost, "edits": edits, "repaired": [{"role": r, "text": t} for r, t in repaired], "ways": None, "kept": None}
    ways = [{"before": b, "after": a, "cost": c, "edits": e} for b, way in piece.ways.items() for a, (c, e) in way.after(piece.turns).items()]
    return out | {"cost": None, "edits": None, "repaired": None, "ways": ways, "kept": [dict(zip(("at", "role", "text"), k)) for k in piece.kept]}


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _pieces(batches):
    """Rows ordered by conversation, turn, role, digest (text before count) -> pieces, those of whole conversations finished."""
    pid = piece = text_of = None
    out, size = [], 0

    def close(piece: Piece, edge: bool) -> dict:
        alone = piece.begins and not edge
        if not alone and len(piece.ways) == 1:
            piece.other_states()
        return _row(piece, pid, alone)

    first = True
    for conv, turn, role, digest, text, n, blank, pid in _rows(batches):
        if piece is None or conv != piece.conv:
            if piece is not None:
                out.append(close(piece, first))
                first = False
            piece, text_of = Piece(conv, 0 if piece is None else piece.seq + 1, True), None
        elif piece.full():
            # more turns of this conversation come, so this piece is not alone
            out.append(close(piece, True))
            piece = Piece(conv, piece.seq + 1, False)
        if n is None:
            text_of = (turn, digest, text)
            continue
        held = text_of[2] if text_of is not None and text_of[:2] == (turn, digest) else None
        text_of = None
        piece.add(turn, role, n, blank, held)
        size += len(held or "") + 200
        if len(out) >= 256 or size > PIECE_BYTES:
            yield pa.RecordBatch.from_pylist(out, ARROW)
            out, size = [], 0
    if piece is not None:
        out.append(close(piece, True))
        yield pa.RecordBatch.from_pylist(out, ARROW)


class _Way:
    """A chain of edits, one piece each; chains that share a beginning share its nodes."""

    __slots__ = ("cost", "before", "state", "edits", "key")

    def __init__(self, cost, before, state, edits, key):
        self.cost, self.before, self.state, self.edits, self.key = cost, before, state, edits, key


def _less(a: _Way, b: _Way) -> bool:
    """Compares two chains of as many pieces by cost, then by edits, back to where they part."""
    if a.cost != b.cost:
        return a.cost < b.cost
    mine, other, result = a, b, False
    while mine is not other:
        if mine.edits != other.edits:
            result = mine.edits < other.edits
        mine, other = mine.before, other.before
    return result


def _chained(batches):
    """Matrices of pieces ordered by conversation and place -> (pid, seq, state before, edits, cost) of each piece; costs stand in the last."""
    names = ["pid", "seq", "state", "edits", "cost"]
    best: dict[int, _Way] = {}
    conv, begun = None, False

    def chosen():
        end = None
        for r, way in best.items():
            last = _Way(way.cost + INSERT * ENDS[r], way.before, way.state, way.edits + "I" * ENDS[r], way.key)
            end = last if end is None or _less(last, end) else end
        total, chain = end.cost, []
        while end is not None and end.key is not None:
            chain.append((*end.key, end.state, end.edits, total if not chain else 0))
            end = end.before
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chain), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names)

    for c, pid, seq, ways in _rows(batches):
        if not begun or c != conv:
            if begun:
                yield chosen()
            conv, begun, best = c, True, {START: _Way(0, None, START, "", None)}
        step: dict[int, _Way] = {}
        for w in ways:
            if w["before"] in best:
                old = best[w["before"]]
                new = _Way(old.cost + w["cost"], old, w["before"], w["edits"], (pid, seq))
                if w["after"] not in step or _less(new, step[w["after"]]):
                    step[w["after"]] = new
        best = step
    if begun:
        yield chosen()


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None,
) -> DataFrame:
    """Pieces (conv_id, pid, seq, open, edits, cost, counts, edges, repaired turns), in order of pid and seq inside a conversation.

    ``copies_col`` says how often a row stands (0: only its conversation is known). ``cost`` adds up over pieces.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "conversation-repair")
    n = F.lit(1).cast("long") if copies_col is None else F.col(copies_col).cast("long")
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"),
        F.unhex(F.sha2(F.concat(F.sha2(role.cast("binary"), 256), text).cast("binary"), 256)).alias("digest"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
    )
    with settings(spark):
        counted = rows.groupBy("conv_id", "turn", "role", "digest", "blank").agg(F.sum("n").alias("n")).withColumn("text", F.lit(None).cast("string"))
        # structs order null turns first, as the ranges do
        firsts = rows.where("n > 0 and not blank").groupBy("conv_id", "digest").agg(
            F.min(F.struct("turn")).alias("least"), F.first("role").alias("role"), F.first("text").alias("text")
        ).select("conv_id", F.col("least.turn").alias("turn"), "role", "digest", F.lit(False).alias("blank"), F.lit(None).cast("long").alias("n"), "text")
        keys = ["conv_id", "turn", "role", "digest"]
        dealt = counted.unionByName(firsts).repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("n").asc_nulls_first())
        ordered = dealt.select(*keys, "text", "n", "blank", F.spark_partition_id().alias("pid"))
        pieces = scratch.table(ordered.mapInArrow(_pieces, PIECES), "pieces")
        many = pieces.where("open")
        chains = many.select("conv_id", "pid", "seq", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq")
        chains = scratch.table(chains.mapInArrow(_chained, "pid int, seq int, state int, edits string, cost long"), "chains")
        joined = many.drop("edits", "cost", "repaired", "ways").join(chains, ["pid", "seq"])
        others = [c for c in joined.columns if c not in ("state", "edits", "kept")]

        def edit(batches):
            shape = pa.schema([*(ARROW.field(c) for c in others), ARROW.field("edits"), ARROW.field("repaired")])
            for b in batches:
                out = []
                for r in b.to_pylist():
                    left = edited(r["state"], r["edits"], [(k["at"], k["role"], k["text"]) for k in r["kept"]])
                    out.append(r | {"repaired": [{"role": role, "text": text} for role, text in left]})
                yield pa.RecordBatch.from_pylist(out, shape)

        made = joined.select(*others, "state", "edits", "kept").mapInArrow(edit, pieces.select(*others, "edits", "repaired").schema)
        done = pieces.where("not open").drop("ways", "kept").unionByName(made)
        out = scratch.table(done, "repaired")
        scratch.drop("pieces")
        scratch.drop("chains")
    return out


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(repaired: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit and the digest of its repaired turns.

    A digest of several pieces needs their texts in order: they pass one task piece by piece, which keeps the digest's state alone.
    """
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0).cast("long"))
    alone = repaired.where("not open").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"),
        F.sha2(said.cast("binary"), 256).alias("repaired_sha256"),
    )
    columns = ["conv_id", "pid", "seq", "blank", "duplicate", "truncated", "illegal", "cost", "edits", "distinct", "first", "last", "low", "high"]
    parts = repaired.where("open").select(*columns, (F.size("repaired") > 0).alias("any"), said.alias("said"))
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq")

    def fold(batches):
        total, audit, digest, any_before, last = None, [], None, False, None
        types = [pa.int64()] * 7 + [pa.string()] * 2

        def done():
            low, high = total["low"], total["high"]
            gaps = 0 if low is None else high - low + 1 - total["distinct"]
            row = [total["conv_id"], gaps, *(total[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(audit), digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in REPORT.split(", ")])

        for b in batches:
            for r in b.to_pylist():
                if total is None or r["conv_id"] != total["conv_id"]:
                    if total is not None:
                        yield done()
                    total = {"conv_id": r["conv_id"], "low": None, "high": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "distinct"), 0)
                    audit, digest, any_before, last = [], hashlib.sha256(), False, None
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "distinct"):
                    total[c] += r[c]
                total["illegal"] += last is not None and r["first"] is not None and last + r["first"] not in LEGAL
                last = r["last"] if r["last"] is not None else last
                if r["low"] is not None:
                    total["distinct"] -= r["low"] == total["high"]
                    total["low"], total["high"] = r["low"] if total["low"] is None else total["low"], r["high"]
                audit.append(r["edits"])
                digest.update((b"\n" if any_before and r["any"] else b"") + r["said"].encode())
                any_before |= r["any"]
        if total is not None:
            yield done()

    return alone.unionByName(ordered.mapInArrow(fold, REPORT))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (copies; 0: dropped) after the damage that a row's id and turn choose."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("n"),
    )


def op11_conversation_repair(spark, sf_dir):
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return reports(repair_conversations(rows, copies_col="n"))


def _sql() -> str:
    """A four-state automaton, a row at a time; a state is its cost (12 digits) with its audit behind it, so that least() is the choice."""

    def add(x: str, cost: str, edits: str) -> str:
        return f"(lpad((left({x}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({x}, 13) || {edits})"

    gone = {x: add(f"d.{x}", "3", "'D'") for x in "esua"}
    to_u, to_a = "CASE f.ini WHEN 'u' THEN 'K' ELSE 'R' END", "CASE f.ini WHEN 'a' THEN 'K' ELSE 'R' END"
    cost_u, cost_a = "CASE f.ini WHEN 'u' THEN 0 ELSE 2 END + f.cut", "CASE f.ini WHEN 'a' THEN 0 ELSE 2 END + f.cut"
    u = ", ".join([*(add(f"d.{x}", cost_u, to_u) for x in "esa"), add("d.u", f"{cost_u} + 2", f"'I' || {to_u}")])
    a = ", ".join([*(add(f"d.{x}", f"{cost_a} + 2", f"'I' || {to_a}") for x in "esa"), add("d.u", cost_a, to_a)])
    table = []
    for k in range(16):
        c = k
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    byte = "xor(c, b)"
    for _ in range(2):  # two rounds of four bits
        byte = f"xor({byte} >> 4, ({table}::UBIGINT[])[({byte} & 15)::INT + 1])"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: {byte}), 4294967295::UBIGINT) % 20 AS code FROM raw),
hurt AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE code WHEN 3 THEN 2 ELSE 1 END) WHERE code <> 0),
named_turns AS (SELECT *, sha256(sha256(role) || text) AS digest, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM hurt),
placed AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before
  FROM named_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, nth)),
f AS MATERIALIZED (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN '' ELSE 'truncated' END AS fault,
  (NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z'))::BIGINT AS cut FROM placed),
d AS (SELECT conv_id, 0::BIGINT AS i, '000000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM raw)
  UNION ALL SELECT d.conv_id, f.i, {gone["e"]},
  CASE WHEN f.fault IN ('blank', 'duplicate') OR f.ini <> 's' THEN {gone["s"]} ELSE least({gone["s"]}, {add("d.e", "f.cut", "'K'")}) END,
  CASE WHEN f.fault IN ('blank', 'duplicate') THEN {gone["u"]} ELSE least({gone["u"]}, {u}) END,
  CASE WHEN f.fault IN ('blank', 'duplicate') THEN {gone["a"]} ELSE least({gone["a"]}, {a}) END
  FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = d.i + 1),
best AS (SELECT conv_id, least(e, a, {add("u", "2", "'I'")}, {add("s", "4", "'II'")}) AS x FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM d) WHERE back = 1),
steps AS (SELECT conv_id, unnest(string_split(substr(x, 13), '')) AS step, unnest(range(1, len(x) - 11)) AS p FROM best WHERE len(x) > 12),
used AS (SELECT *, sum((step <> 'I')::BIGINT) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM steps),
left_over AS (SELECT used.*, f.role, f.text, f.ini, row_number() OVER (PARTITION BY used.conv_id ORDER BY p) - 1 AS q
  FROM used LEFT JOIN f ON used.conv_id IS NOT DISTINCT FROM f.conv_id AND used.i = f.i AND step <> 'I' WHERE step <> 'D'),
named AS (SELECT *, max((q = 0 AND step = 'K' AND ini = 's')::BIGINT) OVER (PARTITION BY conv_id) AS system FROM left_over),
said AS (SELECT conv_id, string_agg(CASE WHEN step = 'K' THEN role WHEN (q - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said
  FROM named GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, left(x, 12)::BIGINT AS cost, substr(x, 13) AS audit,
  sha256(coalesce(s.said, '')) AS repaired_sha256
FROM best b LEFT JOIN counted c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON b.conv_id IS NOT DISTINCT FROM s.conv_id
"""


SQL = _sql()
