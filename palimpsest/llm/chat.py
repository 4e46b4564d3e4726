"""Chat formatting: a hidden Markov model reads transcript lines and recovers roles, then turns are rendered.

A transcript is a sequence of lines. A line shows a speaker marker (one of a few known spellings such as "User:", "A:" or
"### Assistant", an unknown name with a colon, or none) and some features (blank, question, length, opening in lower
case). States are (role, first line of a turn) and (role, later line). Transition and emission weights are counted from a
bounded sample of conversations whose roles are known, part of their markers left out so that unmarked lines are learned
too; counts start from a prior, so the model also works untrained. Viterbi finds the best states; each maximal stretch of
a turn is rendered canonically as `<|im_start|>role`, the text without its marker, `<|im_end|>`. Control marks that stand
in a text are escaped (`escape`, undone by `unescape`), so a text can't open or close a turn.

A row whose role is known is evidence: its first line is that role's first line and the others are its later ones, so it
comes out as it went in, whatever its text looks like, and it is a whole turn: no line that follows it continues it (for
that, each state has a closed twin, which the last line of such a row takes). Rows without a role are read line by line.

A conversation may hold a third of all lines, so it isn't gathered. Rows are ranged by (conversation, turn) and sorted;
each partition holds pieces of conversations. A piece that lies whole in its partition is decoded there. For a
conversation that crosses partitions (at most two pieces a partition) each piece yields its best scores from every state
to every state; joined in order, these fix the states at the borders, and each piece is decoded between its borders.
This gives the same path as one pass over the whole conversation.

Result, one row per recovered turn: conv_id, turn (from 0), role, text, rendered, first_turn (the input's turn number
where it starts).

Defined cases: a null conv_id is a conversation of its own; null turns come first; equal turns are ordered by role, then
text, and repeated rows are turns of their own; a null text is an empty line: an empty turn where the role is known, else a
line of whose turn it is the model decides. Roles other than system, user and assistant are written as an unknown name
before the text; the model decides whose turn it is. Very long texts are read whole. Empty tables: no rows. Other columns
aren't read, whatever their names.

The query withholds roles: by crc32 of `conv_id:turn`, a quarter of the rows lose role and marker, a quarter keep a marker
in the text in one of the known spellings, and half keep their role. Its result says which (evidence) and gives the role
that the row truly has (held_role).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import save, ship

ROLES = ("system", "user", "assistant")
#: States: 2 * role for a turn's first line, 2 * role + 1 for its later lines.
STATES = 2 * len(ROLES)
#: States and their closed twins.
WIDE = 2 * STATES
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model", "agent"),
}
_BY_NAME = {name: role for role, names in MARKERS.items() for name in names}
_MARKER = re.compile(r"^\s*(?:<\|im_start\|>|#{1,4}\s*|\*{1,2}|\[)?([A-Za-z][A-Za-z0-9 _-]{0,23}?)(?:\*{0,2}\s*[:>\]]\*{0,2}|\s*\|>)\s*")
#: Marker observed: one of ROLES, another name, or none. Then blank, question, three lengths, opening in lower case.
KINDS, LENGTHS = len(ROLES) + 2, 3
OTHER, NONE = len(ROLES), len(ROLES) + 1
SAMPLE_CONVERSATIONS, DROP_MARKERS = 5000, 8
#: Far below any sum of logarithms of a path that is possible.
NEVER = -1e12


def marker(line: str) -> tuple[int, int]:
    """(kind, where the text begins)."""
    m = _MARKER.match(line)
    if not m:
        return NONE, 0
    role = _BY_NAME.get(m[1].strip().lower())
    if role is None:
        # A name is short and capitalised; a clause that ends in a colon isn't one.
        return (OTHER, 0) if m[1][0].isupper() and len(m[1].split()) <= 2 else (NONE, 0)
    return ROLES.index(role), m.end()


def observe(line: str) -> tuple[int, int, int, int, int, int]:
    """(marker kind, blank, question, length class, lower-case opening, where the text begins)."""
    kind, at = marker(line)
    rest = line[at:].strip()
    n = len(rest)
    return kind, int(not rest), int(rest.endswith("?")), 0 if n < 60 else 1 if n < 240 else 2, int(rest[:1].islower()), at


class Model:
    """Logarithms of start [state], step [from, to] and emission tables [state, value] by feature."""

    WIDTHS = (KINDS, 2, 2, LENGTHS, 2)

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit
        # A twin behaves as its state does, but no later line of a turn follows it.
        self.wide_start, self.wide_step = np.tile(start, 2), np.tile(step, (2, 2))
        self.wide_step[STATES:, 1::2] = NEVER

    @staticmethod
    def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Pseudo-counts: what a transcript looks like before any is seen."""
        start, step = np.full(STATES, 0.01), np.full((STATES, STATES), 0.01)
        start[[0, 2, 4]] = 2.0, 5.0, 0.5
        for r in range(len(ROLES)):
            for s in (2 * r, 2 * r + 1):
                step[s, 2 * r + 1] = 6.0
                for other in range(len(ROLES)):
                    if other != r:
                        step[s, 2 * other] = {(0, 1): 5.0, (1, 2): 5.0, (2, 1): 5.0}.get((r, other), 0.05)
        emit = [np.full((STATES, w), 0.5) for w in Model.WIDTHS]
        for r in range(len(ROLES)):
            emit[0][2 * r] = 0.05
            emit[0][2 * r, r] = 20.0
            emit[0][2 * r, OTHER] = 0.5
            emit[0][2 * r, NONE] = 2.0
            emit[0][2 * r + 1] = 0.02
            emit[0][2 * r + 1, NONE] = 30.0
        return start, step, emit

    @staticmethod
    def of_counts(start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]) -> Model:
        p = Model.prior()
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
        return Model(norm(start + p[0]), norm(step + p[1]), [norm(a + b) for a, b in zip(emit, p[2], strict=True)])

    def emissions(self, lines: list[str], known: list[int] | None = None) -> np.ndarray:
        """[line, state]. known: by line the state that it surely has, or -1; with it, closed twins are states too."""
        obs = np.array([observe(x)[:5] for x in lines], np.int64).reshape(-1, 5)
        e = sum(table[:, obs[:, j]].T for j, table in enumerate(self.emit))
        if known is not None:
            sure, at = np.array(known, np.int64)[:, None], np.arange(WIDE)
            e = np.where(np.where(sure >= 0, at == sure, at < STATES), np.tile(e, 2), NEVER)
        return e

    def path(self, e: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """The best states of lines with emissions e. before: the state of the line ahead of them; last: the state that
        the final line must have."""
        start, step = (self.wide_start, self.wide_step) if e.shape[1] == WIDE else (self.start, self.step)
        score = (start if before is None else step[before]) + e[0]
        back = np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            both = score[:, None] + step
            back[t] = both.argmax(0)
            score = both.max(0) + e[t]
        out = np.zeros(len(e), np.int64)
        out[-1] = score.argmax() if last is None else last
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def transfer(self, e: np.ndarray, first: bool) -> np.ndarray:
        """[state before, state at the end]: the best score of these lines. first: no line stands before (one row)."""
        start, step = (self.wide_start, self.wide_step) if e.shape[1] == WIDE else (self.start, self.step)
        m = (start[None, :] if first else step) + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + step[None, :, :]).max(1) + row
        return m


def lines_of(role: str | None, text: str | None, mark: bool = True) -> list[str]:
    """A turn as transcript lines: its role as a marker ahead of the first."""
    lines = (text or "").split("\n")
    if mark and role:
        lines[0] = f"{role[:1].upper()}{role[1:]}: {lines[0]}"
    return lines


def fit(conversations: DataFrame, sample: int = SAMPLE_CONVERSATIONS) -> Model:
    """Counts from whole conversations with known roles: those whose hashed id is smallest, about `sample` of them, and
    of each the turns that share a partition. Counted map-side; what comes back is the size of the model."""
    spark = conversations.sparkSession
    ship(spark)
    ids = conversations.agg(F.approx_count_distinct("conv_id").alias("n")).first()["n"]
    scale = 1 << 30
    rows = conversations.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    rows = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(scale)) < min(scale, scale * sample // max(1, ids)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, w)) for w in Model.WIDTHS]
        conv, prev = None, -1
        for b in batches:
            for c, turn, role, text in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                if c != conv:
                    conv, prev = c, -1
                r = ROLES.index(role)
                for i, line in enumerate(lines_of(role, text, mark=(c + (turn or 0)) % DROP_MARKERS != 0)):
                    s = 2 * r + (i > 0)
                    if prev < 0:
                        start[s] += 1
                    else:
                        step[prev, s] += 1
                    prev = s
                    for j, v in enumerate(observe(line)[:5]):
                        emit[j][s, v] += 1
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([start, step.ravel(), *[x.ravel() for x in emit]])], pa.list_(pa.float64()))], names=["x"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    # One short vector a task, summed by position.
    parts = dealt.mapInArrow(count, "x array<double>").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    x = parts["v"].to_numpy() if len(parts) else np.zeros(STATES + STATES**2 + STATES * sum(Model.WIDTHS))
    start, x = x[:STATES], x[STATES:]
    step, x = x[: STATES**2].reshape(STATES, STATES), x[STATES**2 :]
    emit = []
    for w in Model.WIDTHS:
        emit.append(x[: STATES * w].reshape(STATES, w))
        x = x[STATES * w :]
    return Model.of_counts(start, step, emit)


_MARK, _ESCAPED = re.compile(r"<(\\*)\|(?=im_(?:start|end)\|>)"), re.compile(r"<\\(\\*)\|(?=im_(?:start|end)\|>)")


def escape(text: str) -> str:
    """Control marks in a text get a backslash; marks that have some get one more."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{escape(text)}<|im_end|>\n"


def rendered(role, text):
    """render() as a column."""
    safe = F.regexp_replace(text, r"<(\\*)\|(?=im_(?:start|end)\|>)", r"<\\$1|")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


_TURNS = "part int, conv_id long, piece_turn int, opens boolean, role string, text string, first_turn long"


def recover(transcripts: DataFrame, model: Model, marks: bool = True) -> DataFrame:
    """transcripts: conv_id, turn, role, text. marks: roles are evidence (False: they aren't read, texts hold markers)."""
    spark = transcripts.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    src = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ranged = save(src.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "chat-ranged")
    dealt = ranged.repartitionByRange(n, "part").sortWithinPartitions("part", *order)
    cols = ["part", *order]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, int, list[tuple[str, int, int]]]]:
        """(part, conv_id, place in the part, lines with their row's turn and the state that is known, or -1)."""
        at, place, held = None, 0, []
        for b in batches:
            for part, c, turn, role, text in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if (part, c) != at:
                    if at is not None:
                        yield at[0], at[1], place, held
                    place = place + 1 if at is not None and at[0] == part else 0
                    at, held = (part, c), []
                known = 2 * ROLES.index(role) if marks and role in ROLES else -1
                lines = lines_of(role, text, marks and known < 0)
                held += [(line, turn, known + (i > 0) + STATES * (i == len(lines) - 1) if known >= 0 else -1) for i, line in enumerate(lines)]
        if at is not None:
            yield at[0], at[1], place, held

    # Conversations that cross partitions: at most two pieces of a partition (its first and its last) belong to such.
    whose = ranged.groupBy("conv_id", "part").agg(F.lit(1).alias("x")).drop("x")
    edges = whose.groupBy("part").agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("a"), F.max(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("b"))
    ends = edges.select("part", F.explode(F.array("a.conv_id", "b.conv_id")).alias("conv_id")).distinct()
    crossing = ends.groupBy("conv_id").agg(F.sort_array(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)
    # One row per partition border at most: collected, with the number of partitions as its bound.
    spans = {r["conv_id"]: r["parts"] for r in crossing.collect()}
    wide = {(c, p) for c, ps in spans.items() for p in ps}
    first_parts = {c: ps[0] for c, ps in spans.items()}

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c, _, held in pieces(batches):
            if (c, part) in wide:
                m = model.transfer(model.emissions([x[0] for x in held], [x[2] for x in held]), first_parts[c] == part)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([c], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "conv_id", "m"])

    borders: dict[tuple[int | None, int], tuple[int | None, int]] = {}
    if spans:
        got = {(r["conv_id"], r["part"]): np.array(r["m"]).reshape(-1, WIDE) for r in dealt.select(*cols).mapInArrow(transfer, "part int, conv_id long, m array<double>").collect()}
        for c, ps in spans.items():
            score, back = got[(c, ps[0])][0], []
            for p in ps[1:]:
                both = score[:, None] + got[(c, p)]
                back.append(both.argmax(0))
                score = both.max(0)
            states = [int(score.argmax())]
            for bk in reversed(back):
                states.append(int(bk[states[-1]]))
            states.reverse()
            for i, p in enumerate(ps):
                borders[(c, p)] = (None if i == 0 else states[i - 1], states[i])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part, c, _, held in pieces(batches):
            before, last = borders.get((c, part), (None, None))
            states = model.path(model.emissions([x[0] for x in held], [x[2] for x in held]), before, last)
            turn, number = [], -1
            for i, ((line, t, sure), s) in enumerate(zip(held, states.tolist(), strict=True)):
                ahead = before if i == 0 else states[i - 1]
                opens = s % 2 == 0 or ahead is None or s % STATES // 2 != ahead % STATES // 2
                if opens or i == 0:
                    number += 1
                    turn.append([part, c, number, opens, ROLES[s % STATES // 2], [], t])
                turn[-1][5].append(line[marker(line)[1] :] if s % 2 == 0 and sure < 0 else line)
            out += [(*x[:5], "\n".join(x[5]), x[6]) for x in turn]
            if len(out) >= 500:
                yield _turns(out)
                out = []
        if out:
            yield _turns(out)

    turns = dealt.select(*cols).mapInArrow(decode, _TURNS)
    if spans:
        turns = _join_borders(save(turns, "chat-turns"), wide)
    return turns


def _turns(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _TURNS.split(", ")])


def _join_borders(turns: DataFrame, wide: set) -> DataFrame:
    """Turns cut by a partition border become one. Only rows at borders are joined: those that don't open a turn (the
    first of a piece, at most one a partition) and the turns that they continue."""
    # Such a continuation belongs to the last opened turn before it; a turn may run over several partitions.
    tails = turns.where("NOT opens").select("part", "conv_id", "text")
    if not tails.limit(1).count():
        return turns
    heads = turns.where("opens").groupBy("conv_id", "part").agg(F.max("piece_turn").alias("piece_turn"))
    h = heads.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("piece_turn").alias("_n"))
    pairs = tails.join(h, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_p") < F.col("part")))
    owner = pairs.groupBy("conv_id", "part", "text").agg(F.max(F.struct("_p", "_n")).alias("o"))
    more = owner.groupBy("conv_id", F.col("o._p").alias("part"), F.col("o._n").alias("piece_turn")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("more"))
    m = more.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("piece_turn").alias("_n"), "more")
    both = turns.where("opens").join(m, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("piece_turn") == F.col("_n")), "left")
    return both.withColumn("text", F.when(F.col("more").isNotNull(), F.concat("text", F.lit("\n"), "more")).otherwise(F.col("text"))).drop("_c", "_p", "_n", "more")


def format_chats(transcripts: DataFrame, model: Model | None = None, marks: bool = True) -> DataFrame:
    """conv_id, turn, role, text, rendered, first_turn: the recovered turns, rendered."""
    turns = save(recover(transcripts, model or fit(transcripts), marks), "chat-decoded")
    # Numbers by conversation: turns of the pieces before, plus the place in the piece. Pieces are few rows each.
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n"))
    # Where a piece's first row only continued a turn, its numbers begin at 1.
    low = turns.groupBy("conv_id", "part").agg(F.min("piece_turn").alias("low"))
    base = save(before.join(low.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "low"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).select("_c", "_p", (F.col("before") - F.col("low")).alias("base")), "chat-base")
    both = turns.join(base, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    return both.select("conv_id", (F.col("piece_turn") + F.col("base")).cast("int").alias("turn"), "role", "text", rendered(F.col("role"), F.col("text")).alias("rendered"), "first_turn")


#: Spellings of a speaker in transcripts, by role.
SPELLINGS = {"system": ("System: ", "### System: ", "[Instructions] "), "user": ("Human: ", "Q: ", "**User:** "), "assistant": ("AI: ", "A: ", "### Assistant: ")}


def withheld(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, evidence (none, marker, known) and held_role: part of the roles gone, part written into
    the text."""
    pick = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    known = F.col("role").isin(*ROLES)
    evidence = F.when(~F.coalesce(known, F.lit(False)) | (pick % 4 == 0), "none").when(pick % 4 == 1, "marker").otherwise("known")
    said = F.element_at(F.create_map(*[x for r, ws in SPELLINGS.items() for x in (F.lit(r), F.array(*map(F.lit, ws)))]), F.when(known, F.col("role")))
    marked = F.concat(F.element_at(said, (F.floor(pick / 4) % 3 + 1).cast("int")), F.coalesce("text", F.lit("")))
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("held_role"), evidence.alias("evidence"), marked.alias("marked"), "text")
    return t.select("conv_id", "turn", F.when(F.col("evidence") == "known", F.col("held_role")).alias("role"), F.when(F.col("evidence") == "marker", F.col("marked")).otherwise(F.col("text")).alias("text"), "evidence", "held_role")


def query(spark, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    given = withheld(talks)
    turns = format_chats(given, fit(talks))
    truth = given.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.min("evidence").alias("evidence"), F.min("held_role").alias("held_role"))
    both = turns.join(truth, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("first_turn").eqNullSafe(F.col("_t")), "left")
    return both.select("conv_id", "turn", "role", "text", "rendered", "first_turn", "evidence", "held_role")
