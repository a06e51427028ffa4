"""Repair the order of roles in conversations with the cheapest edits.

Every row of a conversation is one symbol, made of its role and its fault, and a conversation the string
of them, its signature. All signatures are read from their ends into one automaton in which equal endings
are one node. A node holds, for every state of the grammar, what the cheapest repair of the rest costs and the
first of its edits, so all conversations with that ending share it. As every edit leads from a state to one
other, of two cheapest repairs the lesser first letter decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.llm.common import settle, through_arrow

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40  # no repair
SEEN = r"[^\x20\x09-\x0D]"

# What is known of a conversation, besides its id.
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults, by the remainder of crc32(``conv_id:turn``) by 20; nulls become one space.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes it the user's.
    """
    what = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _turns(conversations).filter(what != 0).select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("_copy")).drop("_copy")


def _same() -> Column:
    """A key of role and text, which also puts rows of one turn and role in order."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


def signatures(turns: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, signature, counts) of every conversation of ``turns`` or ``known``.

    A symbol is ``d`` for blank or duplicate rows, else the initial of the role (``o`` for all but
    s, u and a), a capital if the row is truncated. A conversation's rows go through one task in order, but
    without their texts; what is held of them is one letter each.
    """
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    rows = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", _same().alias("same"),
                        F.when(~F.col("text").rlike(SEEN), "blank").when(~last.isin(*".!?"), "truncated")
                        .otherwise("").alias("fault"))
    # Owners are written before they are joined: so a hot conversation is split in that join.
    first = settle(rows.groupBy("conv_id", "same").agg(F.min(F.struct("turn")).alias("first")), "first")
    mine = rows.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id"))
                                & (F.col("r.same") == F.col("f.same")))
    again = ~F.col("first.turn").eqNullSafe(F.col("r.turn"))
    rows = mine.select("r.conv_id", F.lit(1).alias("kind"), F.col("r.turn").cast("long").alias("turn"), "role",
                       "r.same", "initial", "fault", again.alias("again"))
    heads = known.select("conv_id").distinct().select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("same"), F.lit("").alias("initial"), F.lit("").alias("fault"), F.lit(False).alias("again"))
    dealt = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "same")
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ("conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal")

    def signed(batches):
        own: _Counts | None = None
        for batch in batches:
            out = {n: [] for n in names}
            columns = [batch.column(n).to_pylist() for n in (
                "conv_id", "kind", "turn", "same", "initial", "fault", "again")]
            for conv, is_row, *row in zip(*columns, strict=True):
                if own is None or own.conv != conv:
                    if own is not None:
                        own.into(out)
                    own = _Counts(conv)
                if is_row:
                    own.add(*row)
            yield out
        if own is not None:
            own.into(out := {n: [] for n in names})
            yield out
    return settle(through_arrow(dealt, signed, f"conv_id {kind}, signature string, {COUNTS}"), "signatures")


class _Counts:
    """One conversation as its rows come by in order."""

    def __init__(self, conv):
        self.conv, self.symbols = conv, bytearray()
        self.low = self.high = self.turn = self.same = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, same, initial, fault, again) -> None:
        if turn is not None and (self.low is None or turn != self.high):
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        again = again or (self.same == same and self.turn == turn)
        self.turn, self.same, self.initial = turn, same, initial
        symbol = initial if initial and initial in "sua" else "o"
        if fault == "blank":
            self.blank += 1
            symbol = "d"
        elif again:
            self.duplicate += 1
            symbol = "d"
        elif fault:
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols += symbol.encode()

    def into(self, out: dict[str, list]) -> None:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        for name, value in (("conv_id", self.conv), ("signature", self.symbols.decode()), ("gaps", gaps),
                            ("blank", self.blank), ("duplicate", self.duplicate),
                            ("truncated", self.truncated), ("illegal", self.illegal)):
            out[name].append(value)


Node = tuple[tuple[int, ...], str, tuple[int, ...]]  # per state: cost of the rest, its first edit, state after it


def _with_inserts(cost: list[int], edit: list[str], after: list[int]) -> Node:
    for _ in range(2):  # a second insert at one place may follow a first
        for state in (ASSISTANT, USER, SYSTEM, START):
            to = USER if state != USER else ASSISTANT
            if (cost[to] + INSERT, "I") < (cost[state], edit[state]):
                cost[state], edit[state], after[state] = cost[to] + INSERT, "I", to
    return tuple(cost), "".join(edit), tuple(after)


END: Node = _with_inserts([0, FAR, FAR, 0], ["-"] * 4, [START, SYSTEM, USER, ASSISTANT])


def before(symbol: str, costs: tuple[int, ...]) -> Node:
    """The node of an ending with one more row before it, from what that ending costs."""
    if symbol == "d":
        return _with_inserts([c + DELETE for c in costs], ["D"] * 4, list(range(4)))
    extra = TRUNCATED if symbol.isupper() else 0
    cost, edit, after = [], [], []
    for state in range(4):
        ways = [(costs[state] + DELETE, "D", state)]
        to = NEXT[state].get(symbol.lower())
        if to is not None:
            ways.append((costs[to] + extra, "K", to))
        to = USER if state != USER else ASSISTANT
        ways.append((costs[to] + extra + REROLE, "R", to))
        best = min(ways)
        cost.append(best[0])
        edit.append(best[1])
        after.append(best[2])
    return _with_inserts(cost, edit, after)


class Endings:
    """The automaton, for signatures that come in the order of their reversed strings.

    In that order all strings with an ending follow each other, so the nodes of the ending before are kept
    and no others. Endings of which the costs differ by a constant have one set of edits, found once.
    """

    def __init__(self):
        self.symbols, self.path = "", [(0, END)]
        self.shapes: dict[tuple[str, tuple[int, ...]], tuple[int, Node]] = {}
        self.nodes = 1

    def to(self, reversed_signature: str) -> None:
        shared = 0
        for x, y in zip(self.symbols, reversed_signature, strict=False):
            if x != y:
                break
            shared += 1
        del self.path[shared + 1:]
        for symbol in reversed_signature[shared:]:
            base, node = self.path[-1]
            shape = (symbol, node[0])
            if shape not in self.shapes:
                costs, edits, after = before(*shape)
                least = min(costs)
                self.shapes[shape] = least, (tuple(c - least for c in costs), edits, after)
            least, node = self.shapes[shape]
            self.path.append((base + least, node))
            self.nodes += 1
        self.symbols = reversed_signature

    def best(self) -> tuple[int, str]:
        """Cost and edits of the whole signature."""
        base, node = self.path[-1]
        cost, state, audit = base + node[0][START], START, bytearray()
        for _, (_, edits, after) in reversed(self.path):
            while edits[state] == "I":
                audit += b"I"
                state = after[state]
            audit += edits[state].encode()
            state = after[state]
        return cost, audit[:-1].decode()


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature.

    Signatures are dealt out by ranges of their endings; a task holds the nodes of one signature.
    """
    of = F.reverse("signature")
    each = settle(signed.groupBy("signature").agg(F.lit(1).alias("_")).drop("_"), "endings")
    dealt = each.repartitionByRange(of).sortWithinPartitions(of)

    def solved(batches):
        endings = Endings()
        for batch in batches:
            out = {"signature": batch.column("signature").to_pylist(), "cost": [], "audit": []}
            for signature in out["signature"]:
                endings.to(signature[::-1])
                cost, audit = endings.best()
                out["cost"].append(cost)
                out["audit"].append(audit)
            yield out
    return settle(through_arrow(dealt, solved, "signature string, cost long, audit string"), "audits")


class Mender:
    """Goes through a conversation's rows with its audit and gives the rows of the repaired one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _step(self, initial: str) -> None:
        self.state = NEXT[self.state][initial]

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            yield self._as_needed("I", "")
            self.at += 1

    def _as_needed(self, edit: str, text: str) -> tuple[str, str, str]:
        initial = "a" if self.state == USER else "u"
        self._step(initial)
        return edit, NAMES[initial], text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What a row becomes, with the inserted ones before it: (edit, role, text)."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._step(role[0])
            yield edit, role, text
        elif edit == "R":
            yield self._as_needed(edit, text)


def _ordered(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """A conversation's head with its audit, then its rows in order."""
    kept = [c for c in heads.columns if c != "signature"]
    nothing = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in kept if c != "conv_id"]
    rows = turns.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role",
                        _same().alias("same"), *nothing, "text")
    tops = heads.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                        F.lit("").alias("role"), F.lit("").alias("same"), *kept[1:], F.lit("").alias("text"))
    return tops.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "same")


def _heads(turns: DataFrame, known: DataFrame) -> DataFrame:
    signed = signatures(turns, known)
    return settle(signed.join(audits(signed), "signature").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "heads")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text.

    Rules as for ``repairs``. A conversation that is left without rows has none here.
    """
    turns = _turns(conversations)
    dealt = _ordered(turns, _heads(turns, conversations))
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ("conv_id", "place", "edit", "role", "text")

    def mended(batches):
        conv, mender, place = None, None, 0
        for batch in batches:
            out = {n: [] for n in names}

            def put(rows):
                nonlocal place
                for row in rows:
                    for n, v in zip(names, (conv, place, *row), strict=True):
                        out[n].append(v)
                    place += 1
            for i, is_row in enumerate(batch.column("kind").to_pylist()):
                if not is_row:
                    if mender is not None:
                        put(mender.inserts())
                    conv, place = batch.column("conv_id")[i].as_py(), 0
                    mender = Mender(batch.column("audit")[i].as_py())
                else:
                    put(mender.row(batch.column("role")[i].as_py(), batch.column("text")[i].as_py()))
            yield out
        if mender is not None:
            out = {n: [] for n in names}
            put(mender.inserts())
            yield out
    return through_arrow(dealt, mended, f"conv_id {kind}, place long, edit string, role string, text string")


def repairs(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row per conversation: faults, cost and edits of its cheapest repair, and the hash of the result.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. ``known``
    may name further conversations, which have no rows. Null roles and texts are one space. Rows go by turn,
    nulls first, then by role and by the hash of role and text; of equal rows all but one are duplicates. Rows
    without conv_id are one conversation. An empty table gives no rows. A conversation's texts pass through
    one task, as the hash of them all must, but one after the other; of its other columns one letter per row
    is held. Other columns are not looked at.
    """
    turns = _turns(turns)
    dealt = _ordered(turns, _heads(turns, turns if known is None else known))
    kind = turns.schema["conv_id"].dataType.simpleString()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def hashed(batches):
        head, mender, digest, first = None, None, None, True

        def put(rows):
            nonlocal first
            for _, role, text in rows:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False

        def done(out):
            put(mender.inserts())
            for n in head:
                out[n].append(head[n])
            out["repaired_sha256"].append(digest.hexdigest())
        for batch in batches:
            out = {n: [] for n in ("conv_id", *numbers, "repaired_sha256")}
            for i, is_row in enumerate(batch.column("kind").to_pylist()):
                if not is_row:
                    if mender is not None:
                        done(out)
                    head = {n: batch.column(n)[i].as_py() for n in ("conv_id", *numbers)}
                    mender, digest, first = Mender(head["audit"]), hashlib.sha256(), True
                else:
                    put(mender.row(batch.column("role")[i].as_py(), batch.column("text")[i].as_py()))
            yield out
        if mender is not None:
            done(out := {n: [] for n in ("conv_id", *numbers, "repaired_sha256")})
            yield out
    return through_arrow(dealt, hashed, f"conv_id {kind}, {COUNTS}, cost long, audit string, repaired_sha256 string")


def _sql() -> str:
    """The same in DuckDB's SQL: whole strings of edits are compared, of each row by itself."""
    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def way(cost: str, edit: str, rest: str) -> str:
        return f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a}}"

    def with_inserts(names: list[str]) -> list[str]:
        out = []
        for state in range(4):
            to = USER if state != USER else ASSISTANT
            then = USER if to != USER else ASSISTANT
            out.append(least(names[state], way(str(INSERT), "I", names[to]), way(str(2 * INSERT), "II", names[then])))
        return out

    steps = []
    for state in range(4):
        to = USER if state != USER else ASSISTANT
        extra = f"(CASE WHEN upper(symbol) = symbol THEN {TRUNCATED} ELSE 0 END)"
        keep = " ".join(f"WHEN '{s}' THEN {way(extra, 'K', f's{t}')}" for s, t in NEXT[state].items())
        drop = way(str(DELETE), "D", f"s{state}")
        steps.append(f"CASE WHEN symbol = 'd' THEN {drop} ELSE " + least(
            drop, f"CASE lower(symbol) {keep} ELSE {drop} END", way(f"{extra} + {REROLE}", "R", f"s{to}")) + " END")
    ends = [f"{{'c': {0 if state in (START, ASSISTANT) else FAR}, 'a': ''}}" for state in range(4)]
    states = ", ".join(f"s{i}" for i in range(4))
    return f"""
WITH RECURSIVE polynomial AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
told AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
drawn AS (
    SELECT told.*, xor(list_reduce(list_prepend(4294967295, list_transform(
               range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what
    FROM told, polynomial),
damaged AS (
    SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
           CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM drawn WHERE what <> 0),
keyed AS (
    SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS same FROM damaged),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, same) AS place,
           substr(role, 1, 1) AS initial,
           right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS last
    FROM keyed),
faulty AS (
    SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate'
                   WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS plain,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, same ORDER BY place) > 1 AS again FROM placed)),
seen AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
           string_agg(CASE fault WHEN '' THEN plain WHEN 'truncated' THEN upper(plain) ELSE 'd' END, ''
                      ORDER BY place) AS signature
    FROM faulty GROUP BY conv_id),
steps AS (
    SELECT signature, length(signature) AS n, {', '.join(f"{x} AS s{i}" for i, x in enumerate(
        with_inserts(ends)))}
    FROM (SELECT DISTINCT signature FROM seen)
    UNION ALL
    SELECT signature, n, {', '.join(f"{x} AS s{i}" for i, x in enumerate(with_inserts([f"b{i}" for i in range(4)])))}
    FROM (SELECT signature, n - 1 AS n, {', '.join(f"{x} AS b{i}" for i, x in enumerate(steps))}
          FROM (SELECT *, substr(signature, n, 1) AS symbol FROM steps WHERE n > 0))),
solved AS (
    SELECT signature, s0.c AS cost, s0.a AS audit FROM steps WHERE n = 0),
edits AS (
    SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS i
    FROM seen JOIN solved USING (signature) WHERE audit <> ''),
taken AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER so_far AS place, count(*) FILTER (edit <> 'D') OVER so_far AS output
    FROM edits WINDOW so_far AS (PARTITION BY conv_id ORDER BY i)),
filled AS (
    SELECT t.conv_id, i, edit, output, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
           max((edit = 'K' AND output = 1 AND initial = 's')::INT) OVER (PARTITION BY t.conv_id) AS led
    FROM taken t JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM t.conv_id
        AND f.place = greatest(t.place, 1) WHERE edit <> 'D'),
mended AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (output - led) % 2 = 1 THEN 'user'
                                    ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole
    FROM filled GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN (seen JOIN solved USING (signature)) s ON s.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM k.conv_id
"""


SQL = _sql()
