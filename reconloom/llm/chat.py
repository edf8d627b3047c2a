"""Chat formatting: transcripts parsed by a hidden Markov model, then turns rendered in one canonical form.

The lines of a transcript are the observations: the speaker marker in front of a line, if there is one, and
features of the line. The hidden states are the speaker of the line and whether it opens a turn. Viterbi's
best path gives each line its speaker, also where markers are missing; lines of a turn are joined.

Where the turns of a conversation are rows, a row's lines have one speaker, so a turn comes down to a score for each role
and Viterbi runs over turns. Only these scores are sorted by conversation, by ranges of (conversation, turn, ...), so a conversation of
any length is spread over tasks: a part of it is summed up by the best path between any two roles at its
ends (3 x 3 numbers), the parts are chained, and each is then decoded between the roles found for its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import groups, held_out, slices, small, small_batches, table

ROLES = ("system", "user", "assistant")
R = len(ROLES)
#: States: role r opens a turn (2 r) or goes on with it (2 r + 1).
STATES = 2 * R
#: Turns at most in one text of `transcripts`.
STRETCH = 1024

_NAMES = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "prompt", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a", "gpt", "response"),
}
_ROLE_OF = {name: i for i, r in enumerate(ROLES) for name in _NAMES[r]}
_MARKER = re.compile(r"^[ \t]*(?:#{1,4}[ \t]*|\*\*|<\|?(?:im_start\|>)?|\[)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\|?>|\])?(?:\*\*)?(?:[ \t]*:(?:\*\*)?[ \t]*|[ \t]*$)", re.IGNORECASE)
_LIST = re.compile(r"^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]")


def marker(line: str) -> tuple[int | None, str]:
    """(role by a marker in front, or None; the line without it)."""
    m = _MARKER.match(line)
    return (_ROLE_OF[m[1].lower()], line[m.end() :]) if m else (None, line)


def line_features(line: str, opens: bool) -> tuple[int, ...]:
    """Categories of a line without its marker: length, question, list, blank before."""
    n = len(line)
    return (min(5, n.bit_length() // 2), int(line.rstrip().endswith("?")), int(bool(_LIST.match(line))), int(opens))


#: Number of categories of each feature of a line, and of a turn: length, lines.
SIZES, SHAPES = (6, 2, 2, 2), (24, 8)


def observe(text: str | None) -> tuple[int, list[int]]:
    """Of a turn's text: role by marker (or R), and its lines in figures.

    The features of the first line; how many of the other lines have each category of each feature; length and lines of the
    turn as categories; number of lines.
    """
    text = text or ""
    lines = text.split("\n")
    role, rest = marker(lines[0])
    rest_of = [0] * sum(SIZES)
    for line in lines[1:]:
        at = 0
        for f, n in zip(line_features(line, False), SIZES, strict=True):
            rest_of[at + f] += 1
            at += n
    shape = [min(SHAPES[0] - 1, len(text).bit_length()), min(SHAPES[1] - 1, len(lines).bit_length())]
    return (R if role is None else role), [*line_features(rest, True), *rest_of, *shape, len(lines)]


_FIGURES = len(SIZES) + sum(SIZES) + len(SHAPES) + 1


class Counts:
    """What the model is fitted on: counts over turns of known roles, which add up over any split of the turns."""

    _PARTS = {"start": (R,), "turn": (2, R, R), "more": (R,), "longer": (R,), "first": (R, sum(SIZES)), "rest": (R, sum(SIZES)), "shape": (R, sum(SHAPES))}
    LENGTH = sum(int(np.prod(x)) for x in _PARTS.values())

    def __init__(self, flat: np.ndarray | None = None):
        self.flat = np.zeros(self.LENGTH, np.int64) if flat is None else flat
        at = 0
        for name, dims in self._PARTS.items():
            n = int(np.prod(dims))
            setattr(self, name, self.flat[at : at + n].reshape(dims))
            at += n

    def add_turns(self, known: np.ndarray, figures: np.ndarray) -> None:
        """Features of turns (any order) with roles `known`, none negative."""
        n = figures[:, -1]
        np.add.at(self.more, known, n > 1)
        np.add.at(self.longer, known, np.maximum(n - 2, 0))
        for f, off in enumerate(np.cumsum((0, *SIZES))[:-1]):
            np.add.at(self.first, (known, off + figures[:, f]), 1)
        np.add.at(self.rest, known, figures[:, len(SIZES) : len(SIZES) + sum(SIZES)])
        for f, off in enumerate(np.cumsum((0, *SHAPES))[:-1]):
            np.add.at(self.shape, (known, off + figures[:, len(SIZES) + sum(SIZES) + f]), 1)

    def add_order(self, before: tuple[int, bool] | None, known: int) -> None:
        """A turn of role `known` after one of (role, whether it has several lines), or at the start; unknown roles (-1) count nothing."""
        if known >= 0:
            if before is None:
                self.start[known] += 1
            elif before[0] >= 0:
                self.turn[int(before[1]), before[0], known] += 1


@dataclass
class Model:
    """Log probabilities: first state, next state, marker (each role, or none) by state, features by state, shapes of turns by role."""

    start: np.ndarray
    move: np.ndarray
    mark: np.ndarray
    feats: list[np.ndarray]
    shapes: list[np.ndarray]

    def emission(self, marked: int | None, feats: tuple[int, ...]) -> np.ndarray:
        out = self.mark[:, R if marked is None else marked].copy()
        for table_, f in zip(self.feats, feats, strict=True):
            out += table_[:, f]
        return out

    def viterbi(self, emissions: list[np.ndarray]) -> list[int]:
        """The best path of states."""
        if not emissions:
            return []
        best, back = self.start + emissions[0], []
        for e in emissions[1:]:
            into = best[:, None] + self.move
            back.append(into.argmax(0))
            best = into.max(0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


    def scores(self, mark: np.ndarray, figures: np.ndarray) -> np.ndarray:
        """A row a turn: for each role the log probability of the turn's lines if it speaks them all."""
        opens, on = np.arange(0, STATES, 2), np.arange(1, STATES, 2)
        n = figures[:, -1:]
        out = self.mark[opens][:, mark].T + np.where(n > 1, self.move[opens, on], 0) + np.maximum(n - 2, 0) * self.move[on, on] + (n - 1) * self.mark[on, -1]
        for f, t in enumerate(self.feats):
            out = out + t[opens][:, figures[:, f]].T
        at = len(SIZES)
        out = out + figures[:, at : at + sum(SIZES)] @ np.concatenate([t[on] for t in self.feats], 1).T
        for f, t in enumerate(self.shapes):
            out = out + t[:, figures[:, at + sum(SIZES) + f]].T
        return out

    def next_turn(self) -> list:
        """[whether the turn before has several lines][its role][role]: log probability that a turn follows."""
        opens = np.arange(0, STATES, 2)
        return [self.move[np.ix_(opens + many, opens)].tolist() for many in (0, 1)]

    def best_roles(self, scores: np.ndarray, many: np.ndarray, before: tuple[int, bool] | None = None, last: int | None = None) -> list[int]:
        """The best roles of turns in order, after the turn `before` (role, several lines) or at the start, ending with role `last` if given."""
        follow = self.next_turn()
        first = follow[int(before[1])][before[0]] if before else self.start[0::2].tolist()
        best, back = None, []
        for s, m in zip(scores.tolist(), [False, *many[:-1].tolist()], strict=True):
            if best is None:
                best = [x + y for x, y in zip(first, s, strict=True)]
                continue
            best, came = _step(best, follow[m], s)
            back.append(came)
        role = max(range(R), key=lambda r: best[r]) if last is None else last
        out = [role]
        for came in reversed(back):
            role = came[role]
            out.append(role)
        return out[::-1]

    def summary(self, scores: np.ndarray, many: np.ndarray) -> np.ndarray:
        """R x R: the best score of the turns from each role of the first to each role of the last."""
        follow, out = self.next_turn(), []
        for r in range(R):
            best = [scores[0, k] if k == r else -np.inf for k in range(R)]
            for s, m in zip(scores[1:].tolist(), many[:-1].tolist(), strict=True):
                best, _ = _step(best, follow[m], s)
            out.append(best)
        return np.array(out)


def _step(best: list[float], follow: list[list[float]], scores: list[float]) -> tuple[list[float], tuple[int, ...]]:
    new, came = [], []
    for r in range(R):
        top, k = max((best[b] + follow[b][r], -b) for b in range(R))
        new.append(top + scores[r])
        came.append(-k)
    return new, tuple(came)


def fit(counts: Counts, drop: float = 0.3) -> Model:
    """From counts, smoothed. Markers are taken to be missing at the rate `drop`."""
    start, move = np.full(STATES, 1e-9), np.full((STATES, STATES), 0.01)
    start[0::2] = 0.51 + counts.start  # a transcript begins with a turn
    mark = np.full((STATES, R + 1), 1e-9)  # a marker is all but certain
    feats, shapes = [np.ones((STATES, n)) for n in SIZES], [np.ones((R, n)) for n in SHAPES]
    turn_to = 0.01 + counts.turn.sum(0)
    turn_to = turn_to / turn_to.sum(1, keepdims=True)
    for r in range(R):
        mark[2 * r, r], mark[2 * r, -1] = 1 - drop, drop
        mark[2 * r + 1, -1] = 1
        for many in (0, 1):  # who speaks next depends on who spoke, also where lines like these were rare
            move[2 * r + many, 0::2] += counts.turn[many, r] + turn_to[r]
        move[2 * r, 2 * r + 1] += counts.more[r] + 1
        move[2 * r + 1, 2 * r + 1] += counts.longer[r] + 1
        move[np.arange(STATES) // 2 != r, 2 * r + 1] = 1e-12  # a turn only goes on with its own speaker
        for f, off in enumerate(np.cumsum((0, *SIZES))[:-1]):
            feats[f][2 * r] += counts.first[r, off : off + SIZES[f]]
            feats[f][2 * r + 1] += counts.rest[r, off : off + SIZES[f]]
        for f, off in enumerate(np.cumsum((0, *SHAPES))[:-1]):
            shapes[f][r] += counts.shape[r, off : off + SHAPES[f]]
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(norm(start), norm(move), norm(mark), [norm(t) for t in feats], [norm(t) for t in shapes])


def count(turns: Iterable[tuple[int, int, str]]) -> Counts:
    """Counts of (conversation, role, text), in order."""
    out, last = Counts(), None
    for conv, role, text in turns:
        _, figures = observe(text)
        out.add_turns(np.array([role]), np.array([figures]))
        out.add_order(last[1] if last and last[0] == conv else None, role)
        last = (conv, (role, figures[-1] > 1))
    return out


def parse(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(role, text) of the turns of a raw transcript. Blank lines between turns go; an empty transcript has none."""
    obs, blank = [], True
    for line in (text or "").split("\n"):
        role, rest = marker(line)
        obs.append((role, rest, line_features(rest, blank or role is not None)))
        blank = not line.strip()
    if not (text or "").strip():
        return []
    path = model.viterbi([model.emission(role, f) for role, _, f in obs])
    turns: list[tuple[str, list[str]]] = []
    for s, (role, rest, _) in zip(path, obs, strict=True):
        if s % 2 == 0 or not turns:
            turns.append((ROLES[s // 2], [rest]))
        else:
            turns[-1][1].append(rest)
    return [(r, t) for r, ls in turns if (t := "\n".join(ls).strip("\n"))]


def render(role: str, text: str) -> str:
    """A turn in canonical form. Control marks in the text are broken up, so that no text can end its turn."""
    safe = text.replace("<|", "< |")
    return f"<|im_start|>{role}\n{safe.strip()}<|im_end|>\n"


_ORDER = ("c", "none", "turn", "tie", "row")


class Observed:
    """The turns of a table: `base` has their texts by row number, `turns` their figures, sorted and cut into parts, `edges` both ends of each part.

    Turns are ordered by turn, nulls last; of equal turn numbers by hash of the text, then as the table has them. Roles play no part in the
    order, as their place would tell what is to be recovered. Rows repeated whole are turns of their own.
    """

    def __init__(self, df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str):
        small_batches(df.sparkSession)
        self.types = tuple(df.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
        role = F.lower(F.trim(F.col(role_col).cast("string")))
        src = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(role.isin(*ROLES), role).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.base = table(src.withColumn("row", F.monotonically_increasing_id()), "chat-base")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                seen = [observe(t) for t in b.column("text").to_pylist()]
                figures = np.array([f for _, f in seen], np.int32).reshape(-1, _FIGURES)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([m for m, _ in seen], pa.int32()), pa.array([f.tobytes() for f in figures], pa.binary())], names=[*b.schema.names[:-1], "mark", "figures"])

        known = F.coalesce(*[F.when(F.col("role") == r, F.lit(k)) for k, r in enumerate(ROLES)], F.lit(-1)).alias("known")
        key = F.coalesce(F.concat(F.lit("v"), F.col("conv").cast("string")), F.lit("n")).alias("c")
        narrow = self.base.select("row", key, F.col("turn").isNull().cast("int").alias("none"), "turn", F.xxhash64("text").alias("tie"), known, held_out("conv").alias("held"), "text")
        narrow = narrow.mapInArrow(run, f"row long, c string, none int, turn {self.types[1]}, tie long, known int, held boolean, mark int, figures binary")
        dealt = narrow.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        self.turns = table(dealt.withColumn("part", F.spark_partition_id()), "chat-turns")
        ends = (F.min(F.struct(*_ORDER, "known", "held")).alias("a"), F.max(F.struct(*_ORDER, "known", "held", "figures")).alias("b"))
        rows = self.turns.groupBy("part").agg(*ends).orderBy("part").collect()  # a row for each part
        # (part, first conversation, its known role; last conversation, its known role, whether of several lines); held-out roles are unknown
        self.edges = [(r["part"], r["a"]["c"], -1 if r["a"]["held"] else r["a"]["known"], r["b"]["c"], -1 if r["b"]["held"] else r["b"]["known"], np.frombuffer(r["b"]["figures"], np.int32)[-1] > 1) for r in rows]

    def by_part(self, run, schema: str, keep: set | None = None) -> DataFrame:
        """`run` over the turns of each part, in order; of all conversations or those of the (part, c) in keep."""
        t = self.turns
        if keep is not None:
            t = t.join(F.broadcast(t.sparkSession.createDataFrame(sorted(keep), "part int, c string")), ["part", "c"], "left_semi")
        return t.repartition("part").sortWithinPartitions("part", *_ORDER).select("part", "c", "row", "known", "held", "mark", "figures").mapInArrow(run, schema)

    def count(self) -> Counts:
        """Counts over all turns of known roles outside held-out conversations (crc32 of the id as text, mod 4, is 2)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, last, part = Counts(), None, None
            for b in batches:
                if not b.num_rows:
                    continue
                figures = np.frombuffer(b"".join(b.column("figures").to_pylist()), np.int32).reshape(-1, _FIGURES)
                known = np.where(b.column("held").to_numpy(zero_copy_only=False), -1, b.column("known").to_numpy())
                out.add_turns(known[known >= 0], figures[known >= 0])
                for p, c, k, n in zip(b.column("part").to_pylist(), b.column("c").to_pylist(), known.tolist(), figures[:, -1].tolist(), strict=True):
                    if p == part:  # the first turn of a part is counted with the edges
                        out.add_order(last[1] if last[0] == c else None, k)
                    part, last = p, (c, (k, n > 1))
            at = np.flatnonzero(out.flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.flat[at])], names=["at", "n"])

        out = Counts()
        for r in self.by_part(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most Counts.LENGTH rows
            out.flat[r["at"]] = r["n"]
        before = (None, None)
        for _, c, known, last_c, last_known, many in self.edges:
            out.add_order(before[1] if before[0] == c else None, known)
            before = (last_c, (last_known, many))
        return out

    def decode(self, model: Model, trust: bool) -> DataFrame:
        """(row, position, found): the place of each turn in its conversation and its role by Viterbi. Roles that rows name are markers if trusted."""

        def read(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            figures = np.frombuffer(b"".join(g.column("figures").to_pylist()), np.int32).reshape(-1, _FIGURES)
            mark, known = g.column("mark").to_numpy(), g.column("known").to_numpy()
            return model.scores(np.where(known >= 0, known, mark) if trust else mark, figures), figures[:, -1] > 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, ["part", "c"]):
                scores, many = read(g)
                yield pa.RecordBatch.from_pylist([{"part": g.column("part")[0].as_py(), "c": g.column("c")[0].as_py(), "n": g.num_rows, "best": model.summary(scores, many).ravel().tolist(), "many": bool(many[-1])}])

        # Conversations that go on from one part to the next: two at most for each part.
        cut = {(p, c) for x, y in zip(self.edges, self.edges[1:], strict=False) if x[3] == y[1] for p, c in ((x[0], x[3]), (y[0], y[1]))}
        ends = {}
        if cut:
            found = {(r["part"], r["c"]): r for r in self.by_part(sums, "part long, c string, n long, best array<double>, many boolean", cut).collect()}
            ends = _chain(model, found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, ["part", "c"]):
                offset, before, last = ends.get((g.column("part")[0].as_py(), g.column("c")[0].as_py()), (0, None, None))
                roles = model.best_roles(*read(g), before, last)
                yield pa.RecordBatch.from_arrays([g.column("row").combine_chunks(), pa.array(np.arange(offset, offset + g.num_rows)), pa.array([ROLES[r] for r in roles])], names=["row", "position", "found"])

        return self.by_part(run, "row long, position long, found string")


def _chain(model: Model, parts: dict) -> dict:
    """For each (part, c): turns before it, (role, several lines) of the turn before or None, role of its last turn; by Viterbi over the parts of each conversation."""
    follow, out = model.next_turn(), {}
    by_conv: dict[str, list] = {}
    for (p, c), r in sorted(parts.items()):
        by_conv.setdefault(c, []).append((p, r["n"], np.array(r["best"]).reshape(R, R), r["many"]))
    for c, chain in by_conv.items():
        best, back, many = None, [], False
        for _, _, inner, more in chain:
            enter = model.start[0::2][None, :] if best is None else best[:, None] + np.array(follow[int(many)])
            came = enter.argmax(0)
            through = enter.max(0)[:, None] + inner
            best, many = through.max(0), more
            back.append((came, through.argmax(0)))
        last, ends = int(best.argmax()), []
        for came, first in reversed(back):
            ends.append((last, int(came[first[last]])))
            last = ends[-1][1]
        ends.reverse()
        offset = 0
        for k, (p, n, _, _) in enumerate(chain):
            out[p, c] = (offset, None if k == 0 else (ends[k][1], bool(chain[k - 1][3])), ends[k][0])
            offset += n
    return out


def train(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Fit on all turns with known roles whose conversation isn't held out (crc32 of conv_id as text, mod 4, is 2)."""
    return fit(Observed(conversations, conv_col, turn_col, role_col, text_col).count())


def format_conversations(df: DataFrame, model: Model | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trust: bool = True) -> DataFrame:
    """One row for each row of df: conv_id, turn, position, role (recovered), given (the role that df names, or null), chat (the canonical turn).

    A role that df names (any case) is the turn's marker if trusted; others, and all if not, are recovered by Viterbi from
    a marker in the text, the lines and the turns around. Without a model one is fitted on df as `train` does. Turns
    are ordered by turn, nulls last, then by hash of the text, then as the table has them; position is the place in the conversation, from 0. Repeated
    rows are turns of their own; a null conv_id is a conversation; a null text is empty. An empty table gives no rows.
    """
    seen = Observed(df, conv_col, turn_col, role_col, text_col)
    model = model or fit(seen.count())
    found = table(seen.decode(model, trust), "chat-roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            roles, given, texts = (b.column(c).to_pylist() for c in ("found", "role", "text"))
            chats = [render(r, t if trust and g is not None else _unmarked(t)) for r, g, t in zip(roles, given, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "turn", "position", "found", "role")), pa.array(chats, pa.string())], names=["conv", "turn", "position", "role", "given", "chat"])

    joined = seen.base.join(small(found), "row").select("conv", "turn", "position", "found", "role", "text")  # texts move only if rows are too many to broadcast
    out = joined.mapInArrow(run, f"conv {seen.types[0]}, turn {seen.types[1]}, position long, role string, given string, chat string")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def _unmarked(text: str) -> str:
    first, *rest = text.split("\n", 1)
    return "\n".join([marker(first)[1], *rest])


def parse_transcripts(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, position, role, text, chat): the turns of raw transcripts, one a row of df. Empty or null transcripts have none."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, out = b.column(0).to_pylist(), []
            for i, text in zip(ids, b.column(1).to_pylist(), strict=True):
                out += [(i, k, r, t, render(r, t)) for k, (r, t) in enumerate(parse(text, model))]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["id", "position", "role", "text", "chat"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, position long, role string, text string, chat string")
    return out.withColumnRenamed("id", id_col)


def transcripts(conversations: DataFrame) -> DataFrame:
    """A table of formatted turns as canonical texts of STRETCH turns each at most: (conv_id, stretch, chat)."""
    rows = conversations.select("conv_id", F.floor(F.col("position") / STRETCH).alias("stretch"), "position", "chat")
    return table(rows.groupBy("conv_id", "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "chat"))), lambda t: t["chat"]), "").alias("chat")), "chat-texts")
