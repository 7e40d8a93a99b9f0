"""Conversation structure repair: the cheapest edits that make a conversation alternate, solved once for each signature.

A row's class is one character: s, u, a or o (any other role), in upper case if its text is truncated, x if it has to go
(blank, or a duplicate of an earlier row). A conversation's classes, in order, are its signature, in pieces of at most
PIECE_ROWS rows, so that no conversation has to fit into one row or task. Each distinct signature is solved once, by
memoised recursion, for every state that it may be entered and left in; the pieces' costs are then chained, and
the chosen scripts are joined back and replayed on the rows.

Only narrow rows (keys, hashes, classes) are ordered and grouped; whole texts pass one shuffle to meet their edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_schema, cut, released, small

#: Rows of a signature, as a power of two.
PIECE_BITS = 8
PIECE_ROWS = 1 << PIECE_BITS
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system's message, after a user's, after an assistant's; and where a role leads from them.
START, SYSTEM, USER, ASSISTANT = range(4)
_LEADS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Rows to insert at the end of a conversation that is left in a state.
_TAILS = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
_KEPT_SOLUTIONS = 1 << 13
_PUNCTUATION = ".!?"


def _role(state: int) -> str:
    """The one of user and assistant that may follow."""
    return "a" if state == USER else "u"


def audit_of(script: str) -> str:
    """A script's edits: inserted rows are u and a in it, reroled ones U and A."""
    return script.translate({ord("u"): "I", ord("a"): "I", ord("U"): "R", ord("A"): "R", ord(","): None})


@lru_cache(_KEPT_SOLUTIONS)
def solve(signature: str, state: int) -> tuple[tuple[int, int, str], ...]:
    """(state it is left in, cost, script) for each way out of a signature entered in a state, the cheapest and of those the one of the least audit.

    Rows are only inserted right before one that stays: before a deleted one they cost the same, and their audit is
    greater. So no script ends in an inserted row, and of two that are left in different states none begins with the other.
    Three rows in a row are never inserted: two lead back to the same state, or to the one after an assistant.
    """
    if not signature:
        return ((state, 0, ""),)
    best: dict[int, tuple[int, str, str]] = {}

    def way(cost: int, token: str, after: int) -> None:
        for left, more, script in solve(signature[1:], after):
            whole = f"{token},{script}" if script else token
            found = (cost + more, audit_of(whole), whole)
            best[left] = min(best.get(left, found), found)

    way(DELETE, "D", state)
    kind = signature[0]
    if kind != "x":
        price = TRUNCATED if kind.isupper() else 0
        inserted, at = "", state
        for _ in range(3):
            if kind.lower() in _LEADS[at]:
                way(price + INSERT * len(inserted), f"{inserted}K", _LEADS[at][kind.lower()])
            way(price + REROLE + INSERT * len(inserted), f"{inserted}{_role(at).upper()}", _LEADS[at][_role(at)])
            inserted, at = inserted + _role(at), _LEADS[at][_role(at)]
    return tuple((left, cost, script) for left, (cost, _, script) in sorted(best.items()))


def chain(pieces: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], str]:
    """The cost of a conversation, the way (4 * entered + left) through each piece, and the rows to insert at the end.

    A piece has 16 costs (-1: no such way) and the ranks of their audits among those entered alike.
    """
    to_go = [{state: INSERT * len(tail) for state, tail in _TAILS.items()}]
    for costs, _ in reversed(pieces):
        ahead = to_go[-1]
        to_go.append({a: min((costs[4 * a + b] + ahead[b] for b in range(4) if costs[4 * a + b] >= 0 and b in ahead), default=1 << 60) for a in range(4)})
    to_go.reverse()
    at, ways = START, []
    for k, (costs, ranks) in enumerate(pieces):
        fit = [b for b in range(4) if costs[4 * at + b] >= 0 and costs[4 * at + b] + to_go[k + 1][b] == to_go[k][at]]
        left = min(fit, key=lambda b: ranks[4 * at + b])
        ways.append(4 * at + left)
        at = left
    return to_go[0][START], ways, _TAILS[at]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that crc32 of conv_id:turn decides; nulls count as one space."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, _PUNCTUATION, "")).otherwise(text).alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _features(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, same (hash of conversation, role and text), rid (and of the turn), kind (class, before duplicates are known; x: blank)."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    t = t.withColumn("same", F.unhex(F.sha2(F.concat(part(F.col("conv_id").cast("string")), part(F.col("role")), F.sha2("text", 256)), 256)))
    t = t.withColumn("rid", F.unhex(F.sha2(F.concat(F.hex("same"), part(F.col("turn").cast("string"))), 256)))
    ended = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return t.withColumn("kind", F.when(ended == "", F.lit("x")).when(ended.isin(*_PUNCTUATION), kind).otherwise(F.upper(kind)))


def _ordered(t: DataFrame) -> DataFrame:
    """conv_id, turn, initial, rid, same, kind, copies, at: one narrow row for rows that are alike in all, numbered in order over all of the table."""
    rows = t.groupBy("conv_id", "turn", "role", "rid", "same", "kind").agg(F.count("*").alias("copies"))
    rows = rows.select("conv_id", "turn", F.left("role", F.lit(32)).alias("role"), F.left("role", F.lit(1)).alias("initial"), "rid", "same", "kind", "copies")
    key = ["conv_id", "turn", "role", "rid"]
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("role").withColumn("at", F.monotonically_increasing_id()))
    again, _ = small(cut(rows.where("kind <> 'x'").groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("same_"), "first")))
    rows = rows.join(again, F.col("same") == F.col("same_"), "left").drop("same_")
    later = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return rows.select("conv_id", "turn", "initial", "rid", "copies", "at", (F.col("kind") == "x").alias("is_blank"), later.alias("is_again"), F.when(later, F.lit("x")).otherwise(F.col("kind")).alias("kind"))


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def _pieces(rows: DataFrame) -> DataFrame:
    """One row per piece of a conversation: conv_id, piece, signature, rids, copies, first, last (initials), illegal (pairs within)."""
    found = rows.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "initial", "rid", "copies"))).alias("r"))
    n = F.size("r")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k < n, ~_legal(F.element_at("r", k)["initial"], F.element_at("r", F.least(k + 1, n))["initial"])).otherwise(F.lit(False))), lambda wrong: wrong)
    copies = F.transform("r", lambda x: x["copies"])
    return found.select(
        "conv_id", "piece", F.array_join(F.transform("r", lambda x: x["kind"]), "").alias("signature"), F.transform("r", lambda x: x["rid"]).alias("rids"), copies.alias("copies"),
        F.element_at("r", 1)["initial"].alias("first"), F.element_at("r", -1)["initial"].alias("last"), (F.size(pairs) + F.aggregate(copies, F.lit(0).cast("long"), lambda s, c: s + c - 1)).alias("illegal"),
    )


def solutions(signatures: DataFrame) -> DataFrame:
    """signature, costs, ranks, scripts (arrays of 16) for each row: what solve() finds, by 4 * entered + left."""
    schema = "signature string, costs array<int>, ranks array<int>, scripts array<string>"
    kinds = arrow_schema(schema)

    def one(signature: str) -> dict:
        costs, ranks, scripts = [-1] * 16, [0] * 16, [None] * 16
        for entered in range(4):
            ways = solve(signature, entered)
            for rank, (left, cost, script) in enumerate(sorted(ways, key=lambda w: audit_of(w[2]))):
                costs[4 * entered + left], ranks[4 * entered + left], scripts[4 * entered + left] = cost, rank, script
        return {"signature": signature, "costs": costs, "ranks": ranks, "scripts": scripts}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                yield pa.RecordBatch.from_pylist([one(s) for s in texts[at : at + 64]], schema=kinds)

    return signatures.select("signature").mapInArrow(lambda batches: released(run(batches)), schema)


def _chained(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, way, tail (rows to insert after it), cost (of the conversation, at its last piece; else 0), crossing (illegal pairs between it and the next).

    The pieces of a conversation come in order; a task holds two short lists for each piece of one conversation at a time.
    """
    rows = pieces.select("conv_id", "piece", "costs", "ranks", "first", "last")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, piece long, way int, tail string, cost long, crossing long"
    kinds = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for conv, group in groupby(flat, key=lambda r: r[0]):
            group = list(group)
            cost, ways, tail = chain([(r[2], r[3]) for r in group])
            for k, (r, way) in enumerate(zip(group, ways)):
                last = k == len(group) - 1
                crossing = 0 if last else int(r[5] + group[k + 1][4] not in ("su", "ua", "au"))
                out.append((conv, r[1], way, tail if last else "", cost if last else 0, crossing))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*out))], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*out))], schema=kinds)

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


@dataclass(frozen=True)
class Repaired:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation.
    conversations: DataFrame
    #: conv_id, piece, place, sub (its order), role, text: one row per message.
    messages: DataFrame


def repair(turns: DataFrame) -> Repaired:
    """The conversations of turns (conv_id, turn, role, text) repaired.

    Rows are taken by turn (nulls first), those of one turn by role and then by a hash of the text. A null role or text
    is one space, null conv_ids are one conversation. Of a row's faults the first counts: blank, duplicate (role and text came earlier;
    rows alike in all are one and its copies), truncated (the last character that is no white space isn't one of
    .!?). Edits: keep (K), rerole to user or assistant (R), delete (D; blank and duplicate rows must be), insert an empty
    user's or assistant's row (I); the initials of the roles become (s?(ua)+)?. Of edits that cost the same, those with
    the least audit are taken. An empty table gives none. Other columns are ignored, whatever their names.
    """
    t = _features(turns)
    rows = cut(_ordered(t))
    pieces = cut(_pieces(rows))
    solved, _ = small(cut(solutions(pieces.select("signature").distinct())))
    pieces = pieces.join(solved, "signature")
    ways = _chained(pieces)
    here = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("conv_id", "piece")]
    chosen = pieces.alias("p").join(ways.alias("w"), here[0] & here[1]).select("p.conv_id", "p.piece", "rids", "copies", "illegal", F.split(F.element_at("scripts", F.col("way") + 1), ",").alias("tokens"), "tail", "cost", "crossing")
    chosen = cut(chosen)

    edits = lambda token, copies: F.concat(F.translate(token, "uaUA", "IIRR"), F.repeat(F.lit("D"), (copies - 1).cast("int")))
    piece_audit = F.concat(F.array_join(F.zip_with("tokens", "copies", edits), ""), F.translate("tail", "ua", "II"))
    audits = chosen.select("conv_id", "piece", piece_audit.alias("audit"), (F.col("cost") + DELETE * F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c - 1)).alias("cost"), (F.col("illegal") + F.col("crossing")).alias("illegal"))
    audits = audits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_sort(F.collect_list(F.struct("piece", "audit"))).alias("a"))
    audits = audits.select("conv_id", "cost", "illegal", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    kept = ~F.col("is_blank") & ~F.col("is_again")
    counts = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("is_blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("is_blank"), 0).when(F.col("is_again"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.count_if(kept & (F.col("kind") == F.upper("kind"))).alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
    )
    whole = counts.alias("c").join(audits.alias("a"), F.col("c.conv_id").eqNullSafe(F.col("a.conv_id"))).select("c.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    role_of = lambda c: F.when(F.lower(c) == "u", F.lit("user")).otherwise(F.lit("assistant"))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    todo = chosen.select("conv_id", "piece", F.posexplode(F.arrays_zip("rids", "tokens")).alias("place", "x")).select("conv_id", "piece", "place", F.col("x.rids").alias("rid"), F.col("x.tokens").alias("token")).where("token <> 'D'")
    texts = t.groupBy("rid").agg(F.first(F.struct("role", "text")).alias("t"))
    found = todo.join(texts, "rid")
    own = F.right("token", F.lit(1))
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    inserted = lambda c: F.transform(letters(c), lambda x: message(role_of(x), F.lit("")))
    said = F.concat(inserted(F.left("token", F.length("token") - 1)), F.array(message(F.when(own == "K", F.col("t.role")).otherwise(role_of(own)), F.col("t.text"))))
    messages = found.select("conv_id", "piece", "place", F.posexplode(said).alias("sub", "m"))
    ends = chosen.where("tail <> ''").select("conv_id", "piece", F.lit(PIECE_ROWS).alias("place"), F.posexplode(inserted(F.col("tail"))).alias("sub", "m"))
    return Repaired(whole, messages.unionByName(ends).select("conv_id", "piece", "place", "sub", "m.role", "m.text"))


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the messages as role:text lines. A hash needs them in order, so a conversation streams through one task, never held."""
    rows = messages.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place", "sub").select("conv_id", "role", "text")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string"
    kinds = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        flat = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for conv, group in groupby(flat, key=lambda r: r[0]):
            h = None
            for _, role, text in group:
                if h is None:
                    h = hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            out.append((conv, h.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*out))], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*out))], schema=kinds)

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Every conversation of turns, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without rows after damage has zeros, an empty audit and the hash of the empty text. See damage() and repair().
    """
    found = repair(damage(turns))
    tables = [turns.select("conv_id").distinct(), found.conversations, digests(found.messages)]

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("conv_id", "conv_id_")
        return a.join(b, F.col("conv_id").eqNullSafe(F.col("conv_id_")), "left").drop("conv_id_")

    out = reduce(beside, tables)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same by a table of states, row after row; the tables' turns have no ties.
SQL = r"""
WITH RECURSIVE
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS bytes FROM conversations),
kinds AS (SELECT * EXCLUDE (bytes), xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
                 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM raw),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                  right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM after),
r AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
             CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
leads (state, initial, next) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
gaps (state, inserted, next) AS (VALUES ('', '', ''), ('', 'u', 'u'), ('', 'ua', 'a'), ('s', '', 's'), ('s', 'u', 'u'), ('s', 'ua', 'a'), ('u', '', 'u'), ('u', 'a', 'a'), ('a', '', 'a'), ('a', 'u', 'u')),
best AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '' AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''} AS b FROM r
    UNION ALL
    SELECT conv_id, k, state, min(b) FROM (
        SELECT t.conv_id, r.k, coalesce(l.next, g.next) AS state,
               {'cost': t.b.cost + 5 * length(g.inserted) + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END,
                'audit': t.b.audit || repeat('I', length(g.inserted)) || edit,
                'said': t.b.said || replace(replace(g.inserted, 'u', chr(10) || 'user:'), 'a', chr(10) || 'assistant:') || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || CASE l.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END} AS b
        FROM best t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.k = t.k + 1 JOIN gaps g ON g.state = t.state
        JOIN (VALUES ('D'), ('K'), ('R')) e (edit) ON edit = 'D' OR fault NOT IN ('blank', 'duplicate')
        LEFT JOIN leads l ON l.state = g.next AND ((edit = 'K' AND l.initial = r.initial) OR (edit = 'R' AND l.initial IN ('u', 'a')))
        WHERE edit = 'D' OR l.next IS NOT NULL) GROUP BY conv_id, k, state),
ended AS (SELECT t.conv_id, min({'cost': t.b.cost + 5 * length(g.inserted), 'audit': t.b.audit || repeat('I', length(g.inserted)),
                                 'said': t.b.said || replace(replace(g.inserted, 'u', chr(10) || 'user:'), 'a', chr(10) || 'assistant:')}) AS b
          FROM best t JOIN gaps g ON g.state = t.state AND g.next IN ('', 'a') JOIN (SELECT conv_id, max(k) AS n FROM r GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND t.k = m.n GROUP BY t.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                  count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.b.cost, 0) AS BIGINT) AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(e.b.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""
