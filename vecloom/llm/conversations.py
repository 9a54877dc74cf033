"""Repair of conversations: the cheapest edits that give every one a legal structure.

Rows are dealt by conversation and each task streams its rows twice, sorted within the
partition, carrying a few numbers from one Arrow batch to the next:

* from the last row to the first, the costs of the four states of the role pattern;
  each row leaves with one byte, the best edit for every state;
* from the first row to the last, the walk along these edits.

Between the two Spark's sort turns the order around and spills what does not fit, rows
and their bytes alike, so a conversation of any length takes constant memory in Python.
One shuffle serves all steps.

Nulls: a null role or text is one space, a null turn comes first and counts for no gap,
rows of a null conversation form one conversation. Rows of one turn go by role, then
text; equal rows are interchangeable. Empty and white texts are blank. An empty table
gives an empty result. Columns not named are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.registry import query
from vecloom.plans.catalog import table

# Faults in the order in which the first counts, and costs of edits.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
# Fixed value: the edits by their initials, in ASCII order.
EDITS = "DIKR"
# Adjacent role initials that are legal.
LEGAL = ("su", "ua", "au")
# States of (s?(ua)+)?: nothing yet, after s, after u, after a. What a user's or
# assistant's row leads to from each, and the role it must have.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
# Cost of ending in a state: a lone s lacks two rows, a u one.
ENDING = (0, 2 * INSERT, INSERT, 0)

NOT_WHITE = r"[^\x20\x09-\x0D]"


def kept_state(state: int, initial: str) -> int | None:
    """Where a kept row leads, None if its role does not fit."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial and initial == ROLE[state][0]:
        return NEXT[state]
    return None


@lru_cache(maxsize=None)
def step(initial: str, fault: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Least costs before a row from those after it, and the best edit of each state.

    Only costs less their minimum are asked for, so there are few cases, and each is
    computed once. Of edits that cost the same the first by initial is best; two bits
    a state name it.
    """
    must_go = fault in (BLANK, DUPLICATE)
    extra = CUT_SHORT if fault == TRUNCATED else 0
    own: list[dict[str, int]] = []
    for state in range(4):
        costs = {"D": DELETE + after[state]}
        if not must_go:
            costs["R"] = REROLE + extra + after[NEXT[state]]
            kept = kept_state(state, initial)
            if kept is not None:
                costs["K"] = extra + after[kept]
        own.append(costs)
    least = [min(c.values()) for c in own]
    # Rows may be put in before this one; twice round the states finds every use.
    for _ in range(2):
        least = [min(v, INSERT + least[NEXT[s]]) for s, v in enumerate(least)]
    back = 0
    for state, costs in enumerate(own):
        costs["I"] = INSERT + least[NEXT[state]]
        best = min(e for e, cost in costs.items() if cost == least[state])
        back |= EDITS.index(best) << 2 * state
    return tuple(least), back


def faults(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Columns key, turn, role, text and ``fault``, dealt by conversation.

    The key is never null. The first of equal rows of a conversation is the one of the least turn.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).repartition("key")
    earlier = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = (
        F.when(~F.col("text").rlike(NOT_WHITE), BLANK)
        .when(earlier > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise("")
    )
    return rows.withColumn("fault", fault)


def _conversation(key: str) -> Column:
    """The conversation that a key stands for."""
    return F.when(F.col(key) != "", F.substring(key, 2, 1 << 30))


def _sorted(rows: DataFrame, down: bool) -> DataFrame:
    names = ("turn", "role", "text", "fault")
    # Equal rows differ in their fault only: the first is not the duplicate.
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c in names[:3]]
    late = F.col("fault") == DUPLICATE
    return rows.sortWithinPartitions("key", *order, late.desc() if down else late.asc())


def _with_edits(rows: DataFrame) -> DataFrame:
    """Rows with ``back``, the best edit for each state, from the last row of a conversation to its first."""

    def backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, costs = object(), ENDING
        for frame in frames:
            backs = []
            for key, role, fault in zip(frame["key"], frame["role"], frame["fault"]):
                if key != current:
                    current, costs = key, ENDING
                low = min(costs)
                costs, back = step(role[:1], fault, tuple(c - low for c in costs))
                backs.append(back)
            yield frame.assign(back=backs)

    schema = "key string, turn bigint, numbered boolean, role string, text string, fault string, back int"
    plain = rows.select(
        "key", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("numbered"), "role", "text", "fault"
    )
    out = plain.mapInPandas(backwards, schema)
    return out.withColumn("turn", F.when(F.col("numbered"), F.col("turn"))).drop("numbered")


class Walk:
    """Follows the edits of one conversation from its first row."""

    def __init__(self) -> None:
        self.state = 0

    def row(self, role: str, fault: str, back: int) -> Iterator[tuple[str, str | None, int]]:
        """Edit, role it leaves (None: no row) and cost, the row's own edit last."""
        while (edit := EDITS[back >> 2 * self.state & 3]) == "I":
            yield self._insert()
        extra = CUT_SHORT if fault == TRUNCATED else 0
        if edit == "D":
            yield edit, None, DELETE
        elif edit == "K":
            self.state = kept_state(self.state, role[:1])
            yield edit, role, extra
        else:
            role, self.state = ROLE[self.state], NEXT[self.state]
            yield edit, role, REROLE + extra

    def _insert(self) -> tuple[str, str, int]:
        role, self.state = ROLE[self.state], NEXT[self.state]
        return "I", role, INSERT

    def end(self) -> Iterator[tuple[str, str, int]]:
        while ENDING[self.state]:
            yield self._insert()


def _planned(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    back = _with_edits(_sorted(faults(df, conv, turn, role, text), down=True))
    rows = _sorted(back, down=False)
    return rows.select("key", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("numbered"), "role", "text", "fault", "back")


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of the repaired conversations: conversation (as text), ``place`` from 0, edit, role, text.

    An inserted row has an empty text; deleted ones are left out.
    """

    def forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, walk, place, out = object(), None, 0, []

        def put(edit: str, kept: str | None, text: str) -> None:
            nonlocal place
            if kept is not None:
                out.append((current, place, edit, kept, text))
                place += 1

        names = ["conversation", "place", "edit", "role", "text"]
        for frame in frames:
            for key, role, text, fault, back in zip(*(frame[c] for c in ("key", "role", "text", "fault", "back"))):
                if walk is None or key != current:
                    for edit, kept, _ in walk.end() if walk else ():
                        put(edit, kept, "")
                    current, walk, place = key, Walk(), 0
                for edit, kept, _ in walk.row(role, fault, back):
                    put(edit, kept, "" if edit == "I" else text)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        for edit, kept, _ in walk.end() if walk else ():
            put(edit, kept, "")
        yield pd.DataFrame(out, columns=names)

    schema = "conversation string, place bigint, edit string, role string, text string"
    out = _planned(df, conv, turn, role, text).mapInPandas(forwards, schema)
    return out.withColumn("conversation", _conversation("conversation"))


class Report:
    """Counts of one conversation, its edits and the digest of its repaired lines."""

    def __init__(self, key: str) -> None:
        self.key, self.walk = key, Walk()
        self.found = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "": 0}
        self.illegal = self.cost = self.distinct = 0
        self.first = self.last = None
        self.before: str | None = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def _edit(self, edit: str, role: str | None, cost: int, text: str) -> None:
        self.audit.append(edit)
        self.cost += cost
        if role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self, turn: int | None, role: str, text: str, fault: str, back: int) -> None:
        self.found[fault] += 1
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        for edit, kept, cost in self.walk.row(role, fault, back):
            self._edit(edit, kept, cost, "" if edit == "I" else text)

    def end(self) -> tuple:
        for edit, kept, cost in self.walk.end():
            self._edit(edit, kept, cost, "")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        counts = (self.found[f] for f in (BLANK, DUPLICATE, TRUNCATED))
        return self.key, gaps, *counts, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def reports(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id as text in ``conversation``, faults, cost, ``audit`` and ``repaired_sha256``."""
    names = ["conversation", *COUNTS, "audit", "repaired_sha256"]

    def forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        report: Report | None = None
        columns = ("key", "turn", "numbered", "role", "text", "fault", "back")
        for frame in frames:
            out = []
            for key, turn, numbered, role, text, fault, back in zip(*(frame[c].tolist() for c in columns)):
                if report is None or key != report.key:
                    if report is not None:
                        out.append(report.end())
                    report = Report(key)
                report.row(turn if numbered else None, role, text, fault, back)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([report.end()] if report else [], columns=names)

    schema = f"conversation string, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    out = _planned(df, conv, turn, role, text).mapInPandas(forwards, schema)
    return out.withColumn("conversation", _conversation("conversation"))


def key_text(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults put in, by a hash of conversation and turn."""
    kind = F.crc32(key_text(F.col("conv_id"), F.col("turn"))) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).filter("kind <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def audited(original: DataFrame, rows: DataFrame) -> DataFrame:
    """The reports on ``rows`` for every conversation of ``original``, also those without a row left."""
    ids = original.select("conv_id").distinct()
    found = reports(rows)
    joined = ids.join(found, ids["conv_id"].cast("string").eqNullSafe(found["conversation"]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


# CRC-32 over the bytes of a key, by the table of its polynomial.
CRC_SQL = """crcs as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t)"""

_LINE = "case when {rest} = '' then {line} else {line}||chr(10)||{rest} end"


def _state_sql(state: int) -> str:
    """Least (cost, audit, lines) before a row in a state, without rows put in before it."""

    def after(s: int, edit: str, cost: str, line: str | None) -> str:
        rest = f"r.s{s}.lines"
        lines = rest if line is None else _LINE.format(rest=rest, line=line)
        return f"{{'cost': r.s{s}.cost+{cost}, 'audit': '{edit}'||r.s{s}.audit, 'lines': {lines}}}"

    extra = f"(case when fault = '{TRUNCATED}' then {CUT_SHORT} else 0 end)"
    options = [after(state, "D", str(DELETE), None)]
    live = f"fault not in ('{BLANK}', '{DUPLICATE}')"
    options.append(f"case when {live} then {after(NEXT[state], 'R', f'{REROLE}+{extra}', chr(39) + ROLE[state] + ':' + chr(39) + '||x.text')} end")
    for initial in ("s", "u", "a"):
        kept = kept_state(state, initial)
        if kept is not None:
            line = "x.role||':'||x.text"
            options.append(f"case when {live} and left(x.role, 1) = '{initial}' then {after(kept, 'K', extra, line)} end")
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o is not null))"


def _insert_sql(own: str, state: int) -> str:
    """The better of a state's own edits and a row put in before them."""
    target = f"n{NEXT[state]}"
    line = _LINE.format(rest=f"{target}.lines", line=f"'{ROLE[state]}:'")
    return f"least({own}, {{'cost': {target}.cost+{INSERT}, 'audit': 'I'||{target}.audit, 'lines': {line}}})"


# The definition, read plainly: a recursion over the rows of each conversation, from the
# last, that holds the least (cost, audit) of every state with the repaired lines. Lines
# are told from none by never being empty.
SQL = f"""
with recursive {CRC_SQL},
o as (select conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ')||':'||coalesce(turn::VARCHAR, ' ') AS k from conversations),
h as (select o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)+1])), 4294967295) % 20 AS kind from o, crcs),
d as (select conv_id, turn, case kind when 4 then 'user' else role end AS role,
  case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end AS text
  from h, range(2) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
s as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) seen from d),
e as (select *, row_number() over w i, lag(left(role, 1)) over w pre from s
  window w as (partition by conv_id order by turn nulls first, role, text, seen)),
x as materialized (select *, count(*) over (partition by conv_id) size, case when not regexp_matches(text, '{NOT_WHITE}') then '{BLANK}'
  when seen > 1 then '{DUPLICATE}'
  when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then '{TRUNCATED}' else '' end fault,
  (i > 1 and pre||left(role, 1) not in {LEGAL})::BIGINT bad from e),
r as (select conv_id, max(i)+1 i, {', '.join(f"{{'cost': {ENDING[s]}, 'audit': '{'I' * (ENDING[s] // INSERT)}', 'lines': '{chr(10).join(['user:', 'assistant:'][2 - ENDING[s] // INSERT:])}'}} s{s}" for s in range(4))}
    from x group by conv_id
  union all select conv_id, i, {_insert_sql('n0', 0)}, {_insert_sql('n1', 1)}, n2, n3 from (
    select conv_id, i, n0, n1, {_insert_sql('n2', 2)} n2, {_insert_sql('n3', 3)} n3 from (
    select x.conv_id, x.i, {', '.join(f'{_state_sql(s)} n{s}' for s in range(4))}
    from r join x on r.conv_id is not distinct from x.conv_id and x.i = r.i-1))),
f as (select conv_id, coalesce(max(turn)-min(turn)+1-count(distinct turn), 0) gaps,
  count(*) filter (fault = '{BLANK}') blank, count(*) filter (fault = '{DUPLICATE}') duplicate,
  count(*) filter (fault = '{TRUNCATED}') truncated, sum(bad) illegal from x group by conv_id)
select c.conv_id, {', '.join(f'coalesce({n}, 0)::BIGINT {n}' for n in COUNTS[:5])}, coalesce(r.s0.cost, 0)::BIGINT AS cost,
  coalesce(r.s0.audit, '') AS audit, sha256(coalesce(r.s0.lines, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join f on c.conv_id is not distinct from f.conv_id
left join r on c.conv_id is not distinct from r.conv_id and r.i = 1"""


@query("op13_conversations", SQL)
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return audited(original, damaged(original))
