"""Conversation structure repair: dynamic programming over a trie of role and fault signatures.

What a conversation's repair costs depends on its signature alone: for each turn whether its role begins with s, u, a or
anything else, and whether it is cut short or has to go. Turns are dealt by ranges of (conversation, turn), so that a
conversation of any length lies in many tasks; each task cuts a conversation's run of turns into segments of ``SEGMENT``
and spells each segment's signature. The distinct signatures, sorted, are a prefix trie in order: one pass keeps the layers of
the path it stands on, computes a layer once for all signatures that share the prefix, and emits at a signature's end
the cheapest edits from each state of the grammar ``(s?(ua)+)?`` to each other one. A conversation's segments are
composed in order, its edits are applied to its turns in one ordered pass, and the digest is taken as they go by.

Ties: of equally cheap edits the least in ASCII stands. Two edits of the same turns to the same state and at the same cost
are never each other's prefixes, as every insertion costs; so the least of the prefixes stays the least.

Defined cases: a null role, text, turn or conversation is one space where it is spelled, and null turns come first; an empty
role has no initial and can't be kept; empty and white texts are blank; very long texts are read whole; turns of one
number are ordered by role, then by the text's MD5; repeated rows are duplicates of each other; rows without a conversation are one
conversation, whose ``conv_id`` is null; an empty table gives an empty result; further columns are ignored. The digest of one conversation is one task's work,
in memory that its edits bound, not its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, release, shuffle_partitions, small_batches

#: Turns whose layers are computed in one go; longer conversations are composed of such segments.
SEGMENT = 256
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: The grammar's states: nothing yet, after the system's turn, after the user's, after the assistant's; and the states that may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The role that an edit puts in each state.
PUTS = ("user", "user", "assistant", "user")
#: Turns as letters: s, u, a, o (any other role), upper case if cut short, and x for a turn that has to go.
GONE = "x"

Layer = dict[int, tuple[int, str]]


def inserted(layer: Layer) -> Layer:
    """A layer with every turn that may be inserted after it; three in a row reach nothing new."""
    best = dict(layer)
    for _ in range(2):
        for state, (cost, edits) in list(best.items()):
            to, entry = STEPS[state][PUTS[state][0]], (cost + COST[INSERT], edits + INSERT)
            if to not in best or entry < best[to]:
                best[to] = entry
    return best


def following(layer: Layer, turn: str) -> Layer:
    """The layer after one more turn."""
    best: Layer = {}

    def offer(state: int, cost: int, edits: str) -> None:
        if state not in best or (cost, edits) < best[state]:
            best[state] = (cost, edits)

    cut = turn.isupper()
    for state, (cost, edits) in layer.items():
        offer(state, cost + COST[DELETE], edits + DELETE)
        if turn != GONE:
            if (to := STEPS[state].get(turn.lower())) is not None:
                offer(to, cost + COST[KEEP] + cut, edits + KEEP)
            offer(STEPS[state][PUTS[state][0]], cost + COST[REROLE] + cut, edits + REROLE)
    return inserted(best)


def solved(signatures: Iterator[str]) -> Iterator[tuple[str, list[tuple[int, int, int, str]]]]:
    """Sorted signatures, each with its (state before, state after, cost, edits). The first letter says where a signature may begin: ^ at a conversation's start, + anywhere."""
    path: list[list[Layer]] = []
    before = ""
    for signature in signatures:
        shared = 0
        while shared < min(len(signature), len(before)) and signature[shared] == before[shared]:
            shared += 1
        del path[shared:]
        for i in range(shared, len(signature)):
            if i:
                path.append([following(layer, signature[i]) for layer in path[-1]])
            else:
                path.append([inserted({state: (0, "")}) for state in (range(1) if signature[0] == "^" else range(len(STEPS)))])
        before = signature
        yield signature, [(start, state, cost, edits) for start, layer in enumerate(path[-1]) for state, (cost, edits) in sorted(layer.items())]


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: (conv, turn, role, text) after it, a repeated row twice."""
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    spelled = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    kind = F.crc32(spelled.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).drop("__copy")


def turns(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, letter, blank, early) of each row; ``early``: an earlier turn has the same role and text. Copies within one turn are told when they lie next to each other."""
    seen = rows.select("conv", F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.md5("text").alias("digest"), (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    place = F.struct("numbered", "turn")
    again = seen.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select(F.col("conv").alias("r_conv"), F.col("role").alias("r_role"), F.col("digest").alias("r_digest"), "first")
    joined = seen.join(again, seen["conv"].eqNullSafe(again["r_conv"]) & (seen["role"] == again["r_role"]) & (seen["digest"] == again["r_digest"]), "left")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    return joined.select("conv", "numbered", "turn", "role", "digest", F.when(F.col("cut"), F.upper(letter)).otherwise(letter).alias("letter"), "blank", F.coalesce(F.col("first") < place, F.lit(False)).alias("early"))


ORDER = ("conv", "numbered", "turn", "role", "digest")
PIECES = "part int, seg int, signature string, first_initial string, last_initial string, first_turn long, last_turn long, distinct_turns long, blank long, duplicate long, truncated long, illegal long"
LEGAL = ("su", "ua", "au")


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Runs of a conversation's turns in order, cut into segments: (conv, part, seg, signature without its first letter, and what the report counts)."""
    kind = dict(rows.dtypes)["conv"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    names = ["conv", *(x.split()[0] for x in PIECES.split(", ")[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, began = None, 0, False
        before: tuple | None = None  # the row before, in the same conversation
        letters: list[str] = []
        made = [0] * 5  # distinct turns, blank, duplicate, truncated, illegal
        ends: list = [None] * 4  # first and last initial, first and last turn

        def segment() -> tuple:
            return (conv, number, "".join(letters), *ends, *made)

        for batch in batches:
            out = []
            for c, numbered, turn, role, digest, letter, blank, early in zip(*(batch.column(x).to_pylist() for x in (*ORDER, "letter", "blank", "early")), strict=True):
                if letters and (not began or c != conv or len(letters) >= most):
                    out.append(segment())
                    number, letters, made, ends = number + 1, [], [0] * 5, [None] * 4
                if not began or c != conv:
                    conv, number, before, began = c, 0, None, True
                initial, at = role[:1], turn if numbered else None
                copied = early or (before is not None and before == (numbered, turn, role, digest))
                gone = blank or copied
                if letters:
                    made[4] += ends[1] + initial not in LEGAL
                else:
                    ends[0] = initial
                if at is not None:
                    made[0] += ends[3] != at
                    ends[2], ends[3] = at if ends[2] is None else ends[2], at
                ends[1] = initial
                made[1] += blank
                made[2] += not blank and copied
                made[3] += not gone and letter.isupper()
                letters.append(GONE if gone else letter)
                before = (numbered, turn, role, digest)
            if out:
                yield made_batch(out, batch.schema.field("conv").type)
            type_ = batch.schema.field("conv").type
        if letters:
            yield made_batch([segment()], type_)

    def made_batch(out: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        types = (type_, pa.int32(), *[pa.string()] * 3, *[pa.int64()] * 7)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = dealt.mapInArrow(run, f"conv {kind}, {PIECES.split(', ', 1)[1]}")
    return found.withColumn("part", F.spark_partition_id())


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, moves) of the distinct ones, from one ordered pass over the trie of each range of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

        def each() -> Iterator[str]:
            for batch in batches:
                yield from batch.column("signature").to_pylist()

        some: list[tuple] = []
        for signature, moves in solved(each()):
            some.append((signature, [dict(zip(("before", "after", "cost", "edits"), m, strict=True)) for m in moves]))
            if len(some) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some]), pa.array([x[1] for x in some], type_)], ["signature", "moves"])
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some]), pa.array([x[1] for x in some], type_)], ["signature", "moves"])

    dealt = signatures.distinct().repartitionByRange(shuffle_partitions(signatures.sparkSession), "signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(run, "signature string, moves array<struct<before:int,after:int,cost:long,edits:string>>")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def composed(pieces: DataFrame) -> DataFrame:
    """One row per conversation from its segments in order: the report's counts, the cost and the edits."""
    kind = dict(pieces.dtypes)["conv"]
    names = ["conv", *(x.split()[0] for x in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, began = None, False
        layer: Layer = {}
        sums, last, low, high, tail = [0] * 5, None, None, None, None

        def row() -> tuple:
            cost, edits = min(layer[s] for s in ENDS if s in layer)
            return (conv, high - low + 1 - sums[0] if low is not None else 0, *sums[1:], cost, edits)

        def batch_of(out: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
            types = (type_, *[pa.int64()] * 6, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            out = []
            columns = ("conv", "moves", "first_initial", "last_initial", "first_turn", "last_turn", "distinct_turns", "blank", "duplicate", "truncated", "illegal")
            for c, moves, head, end, first_turn, last_turn, *counts in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
                if not began or c != conv:
                    if began:
                        out.append(row())
                    conv, began, layer = c, True, {0: (0, "")}
                    sums, last, low, high, tail = [0] * 5, None, None, None, None
                sums = [a + b for a, b in zip(sums, counts, strict=True)]
                if tail is not None:
                    sums[4] += tail + head not in LEGAL
                tail = end
                if first_turn is not None:
                    sums[0] -= last == first_turn  # one turn in two segments
                    low, high, last = first_turn if low is None else low, last_turn, last_turn
                now: Layer = {}
                for m in moves:
                    if m["before"] in layer:
                        cost, edits = layer[m["before"]]
                        entry = (cost + m["cost"], edits + m["edits"])
                        if m["after"] not in now or entry < now[m["after"]]:
                            now[m["after"]] = entry
                layer = now
            if out:
                yield batch_of(out, batch.schema.field("conv").type)
            type_ = batch.schema.field("conv").type
        if began:
            yield batch_of([row()], type_)

    dealt = pieces.repartition(shuffle_partitions(pieces.sparkSession), "conv").sortWithinPartitions("conv", "part", "seg")
    return dealt.mapInArrow(run, f"conv {kind}, {REPORT}")


def edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, role, text) of the repaired turns' digests: one row per conversation with ``sha256`` of its lines role:text."""
    kind = dict(rows.dtypes)["conv"]
    edits = found.select(F.col("conv").alias("e_conv"), "audit")
    own = rows.select("conv", F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.md5("text").alias("digest"), "text")
    dealt = own.repartition(shuffle_partitions(rows.sparkSession), "conv")
    ordered = dealt.join(edits, dealt["conv"].eqNullSafe(edits["e_conv"])).sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, began, audit, at, state, sha, lines = None, False, "", 0, 0, None, 0

        def line(role: str, text: str) -> None:
            nonlocal lines, state
            sha.update((("\n" if lines else "") + role + ":" + text).encode())
            lines, state = lines + 1, STEPS[state][role[0]]

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == INSERT:
                line(PUTS[state], "")
                at += 1

        for batch in batches:
            out = []
            for c, role, text, wanted in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text", "audit")), strict=True):
                if not began or c != conv:
                    if began:
                        insertions()
                        out.append((conv, sha.hexdigest()))
                    conv, began, audit, at, state, sha, lines = c, True, wanted, 0, 0, hashlib.sha256(), 0
                insertions()
                edit, at = audit[at], at + 1
                if edit != DELETE:
                    line(role if edit == KEEP else PUTS[state], text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("conv").type), pa.array([x[1] for x in out])], ["conv", "sha256"])
            type_ = batch.schema.field("conv").type
        if began:
            insertions()
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([sha.hexdigest()])], ["conv", "sha256"])

    return ordered.mapInArrow(run, f"conv {kind}, sha256 string")


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """For rows (conv, turn, role, text): a report per conversation (see ``REPORT``), and the digests (conv, sha256) of what the edits leave."""
    small_batches(rows.sparkSession)
    cut = materialize(segments(turns(rows), segment), "segments")
    heads = cut.groupBy("conv").agg(F.min("part").alias("h_part")).withColumnRenamed("conv", "h_conv")
    starts = cut.join(heads, cut["conv"].eqNullSafe(heads["h_conv"])).select(*cut.columns, ((F.col("part") == F.col("h_part")) & (F.col("seg") == 0)).alias("start"))
    spelled = starts.withColumn("signature", F.concat(F.when(F.col("start"), F.lit("^")).otherwise(F.lit("+")), F.col("signature"))).drop("start")
    spelled = materialize(spelled, "signatures")
    found = composed(spelled.join(answers(spelled.select("signature")), "signature"))
    found = materialize(found, "repairs")
    release(cut, spelled)
    return found, edited(rows, found)


def report(conversations: DataFrame) -> DataFrame:
    """op11's rows."""
    rows = damaged(conversations)
    found, digests = repair(rows)
    every = conversations.select("conv_id").distinct()
    digests = digests.withColumnRenamed("conv", "d_conv")
    joined = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").join(digests, every["conv_id"].eqNullSafe(digests["d_conv"]), "left")
    counts = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11 over the whole of ``conversations``."""
    return report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spelled FROM conversations),
hashed AS (SELECT kinds.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(spelled, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[((xor(c, b) & 255) + 1)::INT])), 4294967295) % 20 AS k FROM kinds, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) AS copies(c) WHERE k <> 0 AND (c = 0 OR k = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM numbered),
placed AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM faults),
report AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM placed GROUP BY 1),
ins(q, r, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
step(q, initial, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (SELECT q, q AS r, 'D' AS e, 3 AS cost, initial FROM (SELECT unnest([0, 1, 2, 3]) AS q), (VALUES ('')) AS v(initial) UNION ALL SELECT q, r, 'K', 0, initial FROM step UNION ALL SELECT q, r, 'R', 2, '' FROM step WHERE initial <> 's'),
layers AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'edits': ''}} AS best FROM report
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT l.conv_id, l.i + 1 AS i, e.r AS q, {{'cost': l.best.cost + ins.cost + e.cost + CASE WHEN e.e <> 'D' AND p.fault = 't' THEN 1 ELSE 0 END, 'edits': l.best.edits || ins.edits || e.e}} AS best
    FROM layers l JOIN placed p ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = l.i + 1 JOIN ins ON ins.q = l.q JOIN edits e ON e.q = ins.r AND (e.initial = '' OR e.initial = p.initial) AND (e.e = 'D' OR p.fault NOT IN ('b', 'd'))
  ) GROUP BY 1, 2, 3
),
answer AS (SELECT l.conv_id, min({{'cost': l.best.cost + ins.cost, 'edits': l.best.edits || ins.edits}}) AS best FROM layers l JOIN report r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.n JOIN ins ON ins.q = l.q WHERE ins.r IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, j, substr(best.edits, j::INT, 1) AS e FROM answer, LATERAL (SELECT unnest(range(1, length(best.edits) + 1)) AS j)),
paired AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT a.conv_id, a.j, a.e, a.place, CASE WHEN a.e = 'K' THEN p.role END AS role, CASE WHEN a.e = 'I' THEN '' ELSE p.text END AS text, max(CASE WHEN a.e = 'K' AND a.place = 1 AND p.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS led
  FROM paired a LEFT JOIN placed p ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND a.e <> 'I' AND p.i = a.i WHERE a.e <> 'D'),
spelled AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (place + led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS sha FROM kept GROUP BY 1)
SELECT e.conv_id, coalesce(r.gaps, 0)::BIGINT AS gaps, coalesce(r.blank, 0)::BIGINT AS blank, coalesce(r.duplicate, 0)::BIGINT AS duplicate, coalesce(r.truncated, 0)::BIGINT AS truncated, coalesce(r.illegal, 0)::BIGINT AS illegal,
  coalesce(a.best.cost, 0)::BIGINT AS cost, coalesce(a.best.edits, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN report r ON e.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN answer a ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN spelled s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""
