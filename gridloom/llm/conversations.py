"""Conversation repair: the cheapest edits that make a conversation alternate, found by a search from both ends.

A conversation's rows are a lattice of (rows passed, last role put out); keep, rerole, delete and insert are its
edges. Two heaps go over it, from the start forwards and from the accepted ends backwards; when their least costs
together exceed the cheapest path found, every path of that cost has crossed from one side's nodes to the other's,
and the least of the concatenated audits is picked.

Each row is sent to its conversation's task twice in one shuffle: without its text, which sorts first and is enough
to find the edits, and with it, to write the repaired text. So texts pass through one by one; a task remembers a
few bytes a row and its 128-bit digest, no more than a constant times the audit that it returns. A conversation's
rows meet in one task, since its digest is of all its text in order; they are a sorted stream, not a group in memory.

Repaired roles have the initials ``(s?(ua)+)?``. Keeping a row costs 0, giving it the role user or assistant 3,
deleting it 4, inserting an empty row 3; a truncated row that stays costs 3 more; blank rows and repeats must go.
An audit is the edits' initials in order; of the cheapest the ASCII-least.

Defined results: a null role or text is one space, a null turn comes first and counts for no gap, null ids are one
conversation; rows of one turn come in the order of the input; a role that is an empty text has no initial and can
stay anywhere; repeated rows are repeats within their conversation; a conversation whose rows are all dropped has
zeros, an empty audit and no text; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .resample import CRC_SQL, crc32_sql

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States by the last role put out: none, system, user, assistant. A row's initial leads from one to the next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted or reroled row leads to.
MADE = (USER, USER, ASSISTANT, USER)
SPACE = " \t\n\x0b\x0c\r"
#: Conversations of up to so many rows are solved once for all with the same roles and faults.
SHORT = 32
FINE, GONE, CUT = range(3)


@lru_cache(4096)
def edges(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits that pass a row: (letter, state after, cost)."""
    out = []
    for state in range(4):
        found = [("D", state, DELETE)]
        if fault != GONE:
            more = TRUNCATED * (fault == CUT)
            kept = NEXT.get((initial, state)) if initial else state
            if kept is not None:
                found.append(("K", kept, KEEP + more))
            found.append(("R", MADE[state], REROLE + more))
        out.append(tuple(found))
    return tuple(out)


@lru_cache(4096)
def edges_back(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """The same by the state after: (letter, state before, cost)."""
    return tuple(tuple((letter, s, cost) for s in range(4) for letter, t, cost in edges(initial, fault)[s] if t == state) for state in range(4))


class _Side:
    """Costs and links of one direction. A node is 4 * rows passed + state."""

    def __init__(self, starts: list[int], sign: int):
        self.cost = dict.fromkeys(starts, 0)
        self.link: dict[int, tuple[int, str]] = {}
        self.done: set[int] = set()
        self.sign = sign
        self.heap = [(0, sign * x) for x in sorted(starts, key=lambda x: sign * x)]

    def top(self) -> float:
        """The least cost that is still open. Of equal costs the node nearest to the start comes first: edges of cost 0 lead on from it."""
        while self.heap and self.sign * self.heap[0][1] in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> int:
        node = self.sign * heappop(self.heap)[1]
        self.done.add(node)
        return node

    def put(self, node: int, cost: int, link: tuple[int, str], better) -> None:
        old = self.cost.get(node)
        if old is None or cost < old:
            self.cost[node], self.link[node] = cost, link
            heappush(self.heap, (cost, self.sign * node))
        elif cost == old and node not in self.done and node in self.link and better(link, self.link[node]):
            self.link[node] = link


def solve(rows: Sequence[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the best repair of rows given as (role initial, fault).

    Two audits of one cost that lead to one node pass the same rows, so neither begins the other: the first letter
    in which they differ decides, and a letter leads from a node to one other.
    """
    n = len(rows)
    ahead, back = _Side([START], 1), _Side([4 * n + START, 4 * n + ASSISTANT], -1)

    def forward(node: int):
        i, state = divmod(node, 4)
        yield "I", 4 * i + MADE[state], INSERT
        if i < n:
            for letter, t, cost in edges(*rows[i])[state]:
                yield letter, 4 * i + 4 + t, cost

    def backward(node: int):
        i, state = divmod(node, 4)
        for s in range(4):
            if MADE[s] == state:
                yield "I", 4 * i + s, INSERT
        if i:
            for letter, s, cost in edges_back(*rows[i - 1])[state]:
                yield letter, 4 * i - 4 + s, cost

    def parting(x: int, y: int) -> tuple[str, str]:
        """The letters after the last node that the forward paths to x and y share; none where that is x or y itself."""
        of_x = of_y = ""
        while x != y:
            if (ahead.cost[x], x) > (ahead.cost[y], y):
                x, of_x = ahead.link[x]
            else:
                y, of_y = ahead.link[y]
        return of_x, of_y

    def before(one: tuple[int, str], other: tuple[int, str]) -> bool:
        a, b = parting(one[0], other[0])
        return (a or one[1]) < (b or other[1])

    best = float("inf")
    while not back.top() or ahead.top() + back.top() <= best:  # the ends themselves are settled in any case
        if ahead.top() <= back.top():
            node = ahead.settle()
            at = ahead.cost[node]
            if node in back.cost:
                best = min(best, at + back.cost[node])
            for letter, to, cost in forward(node):
                ahead.put(to, at + cost, (node, letter), before)
                if to in back.cost:
                    best = min(best, at + cost + back.cost[to])
        else:
            node = back.settle()
            at = back.cost[node]
            if node in ahead.cost:
                best = min(best, at + ahead.cost[node])
            for letter, to, cost in backward(node):
                back.put(to, at + cost, (node, letter), lambda one, other: one[1] < other[1])
                if to in ahead.cost:
                    best = min(best, at + cost + ahead.cost[to])

    def crossings():
        """(node that the forward side has settled, next letter, node after) of all cheapest paths where they cross; no letter where the node is settled by both."""
        for node in ahead.done:
            if node in back.done:
                if ahead.cost[node] + back.cost[node] == best:
                    yield node, "", node
            else:
                for letter, to, cost in forward(node):
                    if to in back.done and ahead.cost[node] + cost + back.cost[to] == best:
                        yield node, letter, to

    chosen = None
    for crossing in crossings():
        if chosen is None:
            chosen = crossing
            continue
        a, b = parting(crossing[0], chosen[0])
        a, b = (x or c[1] or back.link.get(c[2], (0, ""))[1] for x, c in ((a, crossing), (b, chosen)))
        if a < b or a == b and ahead.cost[crossing[0]] + 1e-9 * crossing[0] < ahead.cost[chosen[0]] + 1e-9 * chosen[0]:
            chosen = crossing  # on one path the earlier crossing: what follows it is the least of all
    node, letter, to = chosen
    audit = [letter]
    while node in ahead.link:
        node, letter = ahead.link[node]
        audit.append(letter)
    audit.reverse()
    while to in back.link:
        to, letter = back.link[to]
        audit.append(letter)
    return int(best), "".join(audit)


_short = lru_cache(1 << 16)(solve)


class _Conversation:
    """What a task knows of the conversation that its stream is at."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows: list[tuple[str, int]] = []
        self.seen: set[bytes] = set()
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit = None
        self.at = self.state = self.out = 0
        self.sha = hashlib.sha256()

    def note(self, turn, initial: str, fault: int, digest: bytes) -> None:
        """Take a row without its text."""
        if turn is not None and turn != self.turn:
            self.turn, self.high, self.turns = turn, turn, self.turns + 1
            self.low = turn if self.low is None else self.low
        if self.rows:
            self.illegal += self.rows[-1][0] + initial not in ("su", "ua", "au")
        again = digest in self.seen
        self.seen.add(digest)
        if fault == GONE:
            self.blank += 1
        elif again:
            self.duplicate, fault = self.duplicate + 1, GONE
        elif fault == CUT:
            self.truncated += 1
        self.rows.append((initial, fault))

    def plan(self) -> None:
        if self.audit is None:
            self.seen = set()
            self.cost, self.audit = _short(tuple(self.rows)) if len(self.rows) <= SHORT else solve(self.rows)

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        """Inserted rows up to the next row's edit."""
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = MADE[self.state], self.at + 1
            yield self.line(ROLE[self.state], "", "I")

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Repaired rows (role, text, edit) up to this row."""
        self.plan()
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self.state = MADE[self.state]
            yield self.line(ROLE[self.state], text, edit)
        elif edit == "K":
            self.state = NEXT[role[:1], self.state] if role else self.state
            yield self.line(role, text, edit)

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.plan()
        yield from self.inserts()

    def line(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.sha.update(("\n" * (self.out > 0) + f"{role}:{text}").encode())
        self.out += 1
        return role, text, edit

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, position long, turn long, role string, text string, edit string"


def _streams(rows: DataFrame, present: Column) -> DataFrame:
    """Each row without and with its text, in the order that repairs() needs, a conversation in one partition."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", GONE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    none = F.lit(None)
    light = F.struct(F.lit(0).alias("kind"), F.substring(role, 1, 1).alias("role"), none.cast("string").alias("text"), fault.alias("fault"), digest.alias("digest"))
    full = F.struct(F.lit(1).alias("kind"), role.alias("role"), text.alias("text"), none.cast("int").alias("fault"), none.cast("binary").alias("digest"))
    named = F.struct(F.lit(-1).alias("kind"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("int").alias("fault"), none.cast("binary").alias("digest"))
    numbered = rows.select("conv_id", "turn", "role", "text", present.alias("_present")).withColumn("_at", F.monotonically_increasing_id())
    both = numbered.select("conv_id", "turn", "_at", F.explode(F.when(F.col("_present"), F.array(light, full)).otherwise(F.array(named))).alias("x")).select("conv_id", "turn", "_at", "x.*")
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "_at")


def _repair(rows: DataFrame, present: Column, turns: bool) -> DataFrame:
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [x.split()[0] for x in (_TURNS if turns else _SUMMARY).split(", ")]
        types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in (_TURNS if turns else _SUMMARY).split(", ")]
        size = 0

        def full() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def put(talk: _Conversation, lines, turn) -> int:
            length = 0
            for role, text, edit in lines:
                if turns:
                    out.append((talk.conv_id, talk.out - 1, None if edit == "I" else turn, role, text, edit))
                    length += len(text)
            return length

        def close(talk: _Conversation) -> int:
            length = put(talk, talk.end(), None)
            if not turns:
                out.append((talk.conv_id, talk.gaps(), talk.blank, talk.duplicate, talk.truncated, talk.illegal, talk.cost, talk.audit, talk.sha.hexdigest()))
                length += len(talk.audit)
            return length

        talk = None
        for batch in batches:
            for conv_id, turn, _, kind, role, text, fault, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if talk is None or conv_id != talk.conv_id:
                    if talk is not None:
                        size += close(talk)
                    talk = _Conversation(conv_id)
                if kind == 0:
                    talk.note(turn, role, fault, digest)
                elif kind == 1:
                    size += put(talk, talk.take(role, text), turn)
                if len(out) >= 4096 or size > 1 << 22:
                    yield full()
                    out, size = [], 0
        if talk is not None:
            close(talk)
        yield full()

    return _streams(rows, present).mapInArrow(run, _TURNS if turns else _SUMMARY)


def repairs(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text): its faults, the repair's cost and audit, and a digest of the repaired text.

    Where ``present`` is false, a row only names its conversation.
    """
    return _repair(rows, F.lit(True) if present is None else present, False)


def repaired_turns(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, position, turn, role, text, edit), turn null for inserted rows."""
    return _repair(rows, F.lit(True) if present is None else present, True)


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn, with ``present`` false for dropped ones."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(filled[0], F.lit(":"), filled[1])) % 20
    role, text = F.when(kind == 4, "user").otherwise(filled[2]), F.when(kind == 1, "").when(kind == 2, F.translate(filled[3], ".!?", "")).otherwise(filled[3])
    copies = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired digest of every conversation after the damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repairs(damage(rows), F.col("present"))


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
ORACLE = rf"""
WITH RECURSIVE {CRC_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY)} % 20 AS d FROM conversations, crc),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
   unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS r, row_number() OVER o AS n, lag(left(role, 1)) OVER o || left(role, 1) AS pair,
   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
   FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy)),
-- states: 0 nothing put out yet, 1 after system, 2 after user, 3 after assistant
ins(s, m, c0, a0, t0) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
   (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
   (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
kept(m, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)),
e AS (SELECT f.conv_id, f.n, m, t, e, c + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 3 ELSE 0 END AS c, line FROM (
   SELECT conv_id, n, i AS m, i AS t, 'D' AS e, 4 AS c, '' AS line FROM f CROSS JOIN range(4) q(i)
   UNION ALL SELECT conv_id, n, m, t, 'K', 0, chr(10) || role || ':' || text FROM f JOIN kept USING (r) WHERE fault NOT IN ('blank', 'duplicate')
   UNION ALL SELECT conv_id, n, i, CASE WHEN i = 2 THEN 3 ELSE 2 END, 'R', 3, chr(10) || CASE WHEN i = 2 THEN 'assistant:' ELSE 'user:' END || text
      FROM f CROSS JOIN range(4) q(i) WHERE fault NOT IN ('blank', 'duplicate')) z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.n = z.n),
p AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS c, '' AS a, '' AS t FROM f
   UNION ALL SELECT conv_id, n, s, c, a, t FROM (
      SELECT p.conv_id, e.n, e.t AS s, p.c + c0 + e.c AS c, p.a || a0 || e.e AS a, p.t || t0 || e.line AS t,
         row_number() OVER (PARTITION BY p.conv_id, e.t ORDER BY p.c + c0 + e.c, p.a || a0 || e.e) AS rk
      FROM p JOIN ins ON ins.s = p.s JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1 AND e.m = ins.m) z WHERE rk = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last FROM f GROUP BY conv_id),
b AS (SELECT p.conv_id, p.c + c0 AS cost, p.a || a0 AS audit, substr(p.t || t0, 2) AS repaired, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.c + c0, p.a || a0) AS rk
   FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND p.n = g.last JOIN ins ON ins.s = p.s WHERE ins.m IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
   coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.rk = 1
"""
