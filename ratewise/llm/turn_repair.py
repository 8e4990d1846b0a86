"""Conversation structure repair by Hirschberg's divide-and-conquer.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Four
states know how far such a text has come: nothing yet, after s, after u, after a.
Every row is kept, given another role or deleted, and turns without text may be
inserted before it, each at a cost. From a given state an edit leads to one
state, so the edits' initials (the audit) tell a repair completely.

Costs from the start forwards and from the end backwards, one for each state,
meet in the middle of a conversation. Of the states with the least sum the one
whose first half has the least audit is crossed: the forward pass carries, with
each state's cost, the rank of its least audit among the four, which is all that
comparing audits needs, as the audits of equally many rows are never prefixes of
each other. Both halves are then solved alike, in linear space.

Long conversations are split the same way over the cluster. Rows are numbered in
one range sort, and cut into blocks; a block's costs and ranks between all pairs of
states are its summary, neighbouring summaries merge level by level, and going
down again each pair crosses at its least state, until every block knows the
states at its ends and repairs its rows by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, number_sorted

#: Rows of a block: what one task repairs at once.
BLOCK_ROWS = 4096

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, S, U, A = range(4)
#: state -> {initial: next state}
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: How many turns to insert after the last row.
TRAIL = {START: 0, S: 2, U: 1, A: 0}
FAR = 1 << 60


def _insert(state: int) -> int:
    return A if state == U else U


def _row_edits(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, letters) of the best edits of one row, inserted turns before it included.

    ``code`` is the initial of the role (x: any other), in upper case if the row is
    truncated, or ``d`` if it must go. Two insertions lead back to where they began, so more never pay.
    """
    best = {}
    initial, cut = code.lower(), code.isupper()
    for start in range(4):
        state, letters = start, ""
        for n in range(3):
            ways = [(state, DELETE, "D")]
            if code != "d":
                extra = TRUNCATED if cut else 0
                if initial in NEXT[state]:
                    ways.append((NEXT[state][initial], KEEP + extra, "K"))
                ways.append((_insert(state), REROLE + extra, "R"))
            for to, cost, letter in ways:
                now = (cost + n * INSERT, letters + letter)
                best[start, to] = min(best.get((start, to), (FAR, "")), now)
            state, letters = _insert(state), letters + "I"
    return tuple((a, b, *cost) for (a, b), cost in sorted(best.items()))


ROW_EDITS = {code: _row_edits(code) for code in "suaxSUAXd"}


def forward(codes: str, start: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(cost, rank of the least audit) of each state after the rows, from those before them."""
    now = start
    for code in codes:
        best: list = [None] * 4
        for a, b, cost, letters in ROW_EDITS[code]:
            if now[a][0] < FAR:
                key = (now[a][0] + cost, now[a][1], letters)
                if best[b] is None or key < best[b]:
                    best[b] = key
        order = sorted(x[1:] for x in best if x)
        now = [(x[0], order.index(x[1:])) if x else (FAR, 9) for x in best]
    return now


def backward(codes: str, end: list[int]) -> list[int]:
    """The cost of each state before the rows, from those after them."""
    now = end
    for code in reversed(codes):
        best = [FAR] * 4
        for a, b, cost, _ in ROW_EDITS[code]:
            if now[b] + cost < best[a]:
                best[a] = now[b] + cost
        now = best
    return now


def only(state: int) -> list[tuple[int, int]]:
    return [(0, 0) if s == state else (FAR, 9) for s in range(4)]


def audits(codes: str, start: int, end: int) -> list[str]:
    """The edits of each row of the least audit among the cheapest from ``start`` to ``end``."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)]
    while todo:
        low, high, a, b = todo.pop()
        if high == low:
            continue
        if high == low + 1:
            out.append(next(letters for x, y, _, letters in ROW_EDITS[codes[low]] if (x, y) == (a, b)))
            continue
        middle = (low + high) // 2
        crossing = cross(forward(codes[low:middle], only(a)), backward(codes[middle:high], [0 if s == b else FAR for s in range(4)]))
        todo += [(middle, high, crossing, b), (low, middle, a, crossing)]
    return out


def cross(before: list[tuple[int, int]], after: list[int]) -> int:
    """The state of the least cost in all, of equal ones that with the least audit so far."""
    return min(range(4), key=lambda s: (before[s][0] + after[s], before[s][1]))


# ------------------------------------------------- summaries of blocks ---

def summary(codes: str) -> list[int]:
    """Costs and ranks from each state to each: 16 costs, then 16 ranks."""
    rows = [forward(codes, only(a)) for a in range(4)]
    return [c for r in rows for c, _ in r] + [k for r in rows for _, k in r]


def joined(left: list[int], right: list[int]) -> list[int]:
    """The summary of two neighbours."""
    cost, rank = [], []
    for a in range(4):
        best: list = [None] * 4
        for m in range(4):
            if left[4 * a + m] < FAR:
                for b in range(4):
                    if right[4 * m + b] < FAR:
                        key = (left[4 * a + m] + right[4 * m + b], left[16 + 4 * a + m], right[16 + 4 * m + b])
                        if best[b] is None or key < best[b]:
                            best[b] = key
        order = sorted(x[1:] for x in best if x)
        cost += [x[0] if x else FAR for x in best]
        rank += [order.index(x[1:]) if x else 9 for x in best]
    return cost + rank


def last_state(before: list[tuple[int, int]]) -> int:
    """Where a whole conversation ends, turns inserted after its last row counted."""
    return cross(before, [INSERT * TRAIL[s] for s in range(4)])


# ---------------------------------------------------------------- Spark ---

def placed_rows(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``, their place by conversation, turn (nulls first), role and text."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return number_sorted(rows.repartitionByRange(*order).sortWithinPartitions(*order), "pos", "turns")


def faults(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, initial, fault, code): the first fault of each row (blank, duplicate, truncated or null).

    A row is a duplicate if an earlier one of its conversation has its role and text. The
    code is the initial of the role (x: any other), upper case if truncated, d if the row must go.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = materialize(placed.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), end.alias("_end"), said.alias("_said")), "said")
    first = rows.groupBy("conv_id", "_said").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = materialize(first.select(F.col("conv_id").alias("_c"), F.col("_said").alias("_s"), "_first"), "first-said")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_said") == F.col("_s")), "left")
    fault = F.when(F.col("_end") == "", "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(~F.col("_end").isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    return materialize(rows.select("conv_id", "turn", "pos", "initial", "fault", code.alias("code")), "faults")


def _blocks(marked: DataFrame, block_rows: int) -> DataFrame:
    """(conv, idx, codes, first): the codes of each block of a conversation and the place of its first row.

    ``conv`` is the place of the conversation's first row, ``idx`` numbers its blocks from 0.
    """
    block = F.floor(F.col("pos") / block_rows)
    cut = marked.groupBy("conv_id", block.alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_rows"))  # at most block_rows
    cut = materialize(cut.select("conv_id", "_b", F.col("_rows")[0]["pos"].alias("first"), F.array_join(F.col("_rows.code"), "").alias("codes")), "blocks")
    heads = cut.groupBy("conv_id").agg(F.min("first").alias("conv"), F.min("_b").alias("_b0"))
    heads = heads.select(F.col("conv_id").alias("_c"), "conv", "_b0")
    named = cut.join(heads, F.col("conv_id").eqNullSafe(F.col("_c")))
    return materialize(named.select("conv_id", "conv", (F.col("_b") - F.col("_b0")).alias("idx"), "codes", "first"), "named-blocks")


def _ends(blocks: DataFrame) -> DataFrame:
    """(conv, idx, start, end): the states at both ends of each block of conversations that have several."""
    costs = "array<bigint>"
    told = F.udf(summary, costs)
    join2 = F.udf(lambda l, r: joined(l, r) if r is not None else l, costs)
    last = F.udf(lambda s: last_state([(s[k], s[16 + k]) for k in range(4)]), "int")
    meet = F.udf(lambda l, r, a, b: b if r is None else cross([(l[4 * a + s], l[16 + 4 * a + s]) for s in range(4)], [r[4 * s + b] for s in range(4)]), "int")

    long = blocks.where("idx > 0").select("conv").distinct()
    nodes = materialize(blocks.join(long, "conv", "left_semi").select("conv", "idx", told("codes").alias("s")), "summaries")
    levels = [nodes]
    while not nodes.where("idx > 0").isEmpty():
        half = F.floor(F.col("idx") / 2)
        left = F.max(F.when(F.col("idx") % 2 == 0, F.struct("s")))["s"]
        right = F.max(F.when(F.col("idx") % 2 == 1, F.struct("s")))["s"]
        pairs = materialize(nodes.groupBy("conv", half.alias("idx")).agg(left.alias("l"), right.alias("r")), "pairs")
        nodes = materialize(pairs.select("conv", "idx", "l", "r", join2("l", "r").alias("s")), "summaries")
        levels.append(nodes)
    ends = nodes.select("conv", "idx", F.lit(START).alias("start"), last("s").alias("end"))
    for level in reversed(levels[1:]):
        both = level.join(ends, ["conv", "idx"])
        both = materialize(both.select("conv", "idx", "start", "end", F.col("r").isNotNull().alias("two"), meet("l", "r", "start", "end").alias("mid")), "crossings")
        ends = both.select("conv", (F.col("idx") * 2).alias("idx"), "start", F.col("mid").alias("end")).unionByName(
            both.where("two").select("conv", (F.col("idx") * 2 + 1).alias("idx"), F.col("mid").alias("start"), "end"))
    return materialize(ends, "ends")


def edits(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(pos, edit, trail): the edit of each row (I for each turn inserted before it, then K, R or D), and the
    number of turns inserted after a conversation's last row (0 elsewhere)."""
    blocks = _blocks(marked, block_rows)
    ends = _ends(blocks)
    placed = blocks.join(ends, ["conv", "idx"], "left")
    final = blocks.groupBy("conv").agg(F.max("idx").alias("_last"))
    placed = placed.join(final, "conv").withColumn("tail", F.col("idx") == F.col("_last"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for first, codes, start, end, tail in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if start is None:  # a conversation of one block
                    start, end = START, last_state(forward(codes, only(START)))
                steps = audits(codes, start, end)
                out += [(first + k, step, 0) for k, step in enumerate(steps[:-1])]
                out.append((first + len(steps) - 1, steps[-1], TRAIL[end] if tail else 0))
            pos, edit, trail = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(edit, pa.string()), pa.array(trail, pa.int32())], ["pos", "edit", "trail"])

    return placed.select("first", "codes", "start", "end", "tail").mapInArrow(run, "pos bigint, edit string, trail int")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The faults and edits of conversations, and their repaired turns.

    ``rows`` has conv_id, turn, role and text; other columns are ignored. Null roles and
    texts count as one space; null turns come first, null conversations are one. Rows of
    equal turn are ordered by role and text. Returns

    - marked: conv_id, turn, pos (order over all rows), initial, fault, edit, trail;
    - turns: conv_id, pos, nth, role, text of the repaired conversations, in the order of (pos, nth).

    A conversation all of whose rows go has no turns. Empty tables give empty results. No
    task holds more than a block of a conversation's rows, whatever its length.
    """
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = placed_rows(given)
    marked = faults(placed)
    marked = materialize(marked.join(edits(marked.select("conv_id", "pos", "code"), block_rows), "pos"), "edited")
    return marked, repaired(placed, marked, block_rows)


def repaired(placed: DataFrame, marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The turns that the edits leave, inserted ones without text.

    Which role a turn without a kept one takes follows from how many turns of its conversation
    come before it, and from whether a system turn leads; both are running sums over blocks of rows.
    """
    letters = F.filter(F.split(F.concat("edit", F.repeat(F.lit("I"), F.col("trail"))), ""), lambda x: x.isin("I", "K", "R"))
    made = marked.select("conv_id", "pos", letters.alias("_letters"), F.floor(F.col("pos") / block_rows).alias("_b"),
                         (F.col("edit").endswith("K") & (F.col("initial") == "s")).cast("int").alias("_s"))
    n = F.size("_letters").cast("long")
    sums = made.groupBy("conv_id", "_b").agg(F.sum(n).alias("_sum"), F.max("_s").alias("_led"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
                       F.max("_led").over(whole).alias("_led"))
    inside = Window.partitionBy("conv_id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = made.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    counted = counted.join(materialize(sums, "block-sums"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_bb")))
    at = F.col("_before") + F.col("_in") - F.col("_led")  # turns before, the system one not counted
    script = materialize(counted.where(F.size("_letters") > 0).select("pos", "_letters", at.alias("_at")), "script")
    each = placed.join(script, "pos").select("conv_id", "pos", "role", "text", "_at", F.posexplode("_letters").alias("nth", "_letter"))
    due = F.when((F.col("_at") + F.col("nth")) % 2 == 0, "user").otherwise("assistant")
    return each.select(
        "conv_id", "pos", "nth", F.when(F.col("_letter") == "K", F.col("role")).otherwise(due).alias("role"),
        F.when(F.col("_letter") == "I", "").otherwise(F.col("text")).alias("text"))


def _initials(marked: DataFrame) -> DataFrame:
    """(conv_id, illegal): adjacent role initials that are none of su, ua, au. Blocks overlap by a row."""
    b = F.floor(F.col("pos") / BLOCK_ROWS)
    here = marked.select("conv_id", "pos", "initial", b.alias("_b"))
    over = marked.select("conv_id", "pos", "initial", (F.floor((F.col("pos") + 1) / BLOCK_ROWS)).alias("_b")).where(
        (F.col("pos") + 1) % BLOCK_ROWS == 0).withColumn("_copy", F.lit(True))
    order = Window.partitionBy("conv_id", "_b").orderBy("pos")
    pairs = here.withColumn("_copy", F.lit(False)).unionByName(over).withColumn("_prev", F.lag("initial").over(order))
    bad = F.col("_prev").isNotNull() & ~F.concat("_prev", "initial").isin("su", "ua", "au")
    return pairs.where("not _copy").groupBy("conv_id").agg(F.sum(bad.cast("long")).alias("illegal"))


def reports(marked: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost."""
    said = lambda name: F.sum((F.coalesce("fault", F.lit("")) == name).cast("long")).alias(name)
    stays = ~F.col("edit").endswith("D")
    cost = (F.lit(INSERT) * (F.length("edit") - 1 + F.col("trail")) + F.when(~stays, DELETE).when(F.col("edit").endswith("R"), REROLE).otherwise(KEEP)
            + F.when(stays & (F.col("fault") == "truncated"), TRUNCATED).otherwise(0))
    turns = marked.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.sum("one")).alias("gaps"))
    counts = marked.groupBy("conv_id").agg(said("blank"), said("duplicate"), said("truncated"), F.sum(cost.cast("long")).alias("cost"))

    def add(left, right):
        right = right.withColumnRenamed("conv_id", "_c")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")

    out = add(add(counts, gaps), _initials(marked))
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")


def digests(marked: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the edits' initials, and the digest of the repaired ``role:text`` lines.

    A digest reads its text from front to back, so a conversation's turns pass one
    task in order, sorted with spilling and read as a stream: only the running digest and the audit are held.
    """
    steps = marked.select("conv_id", "pos", F.lit(-1).alias("nth"), F.concat("edit", F.repeat(F.lit("I"), F.col("trail"))).alias("step"), F.lit(None).cast("string").alias("line"))
    lines = turns.select("conv_id", "pos", "nth", F.lit("").alias("step"), F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = steps.unionByName(lines).withColumn("_k", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    ordered = ordered.withColumn("_null", F.col("conv_id").isNull()).repartition("_null", "_k").sortWithinPartitions("_null", "_k", "pos", "nth")

    def run(batches):
        import hashlib
        import pyarrow as pa

        kind = None
        now, audit, sha, any_line = None, [], None, False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            names = ["conv_id", "_null", "step", "line"]
            for conv, null, step, line in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]):
                if now != (conv, null):
                    if now is not None:
                        done.append((now[0], "".join(audit), sha.hexdigest()))
                    now, audit, sha, any_line = (conv, null), [], hashlib.sha256(), False
                audit.append(step)
                if line is not None:
                    sha.update((b"\n" if any_line else b"") + line.encode())
                    any_line = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())], ["conv_id", "audit", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array(["".join(audit)], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "audit", "repaired_sha256"])

    kind = marked.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")

