"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is text whose lines belong to turns of speakers. A line may begin
with a speaker marker (``User:``, ``### Assistant``, ``[system]``, ``<|user|>``,
``**Bot**:``, ``Q:`` ...) or have none. The hidden states are the roles, each
with a state for a turn's first line and one for its further lines. A line is
observed as four features that are independent given the state: the kind of its
marker (none, one of the roles' own, unknown), and its form: length class, a
blank line before it, and whether it ends as a question. Viterbi's algorithm
finds the likeliest states; the turns are then rendered canonically, with the
markers taken off. A marker takes one space after it along; all else, indentation
and blank lines within a turn included, stays as it was, but for blank lines at a
turn's beginning and end:

    <|role|>
    text of the turn
    <|end|>

Training counts transitions and forms over all labelled conversations given to
it (add-one smoothed); the counts have a fixed number of cells however large
the corpus. How often a line has its speaker's own marker is a parameter
(``MARKED``), as labelled turns come without markers.

Conversations are rows ``(conv_id, turn, role, text)``: ``transcripts`` writes
each, in the order of turn, role and text, as a transcript. A row with a known
role has its marker; with a null or unknown role it has none, and the role is
recovered. Turns are separated by a blank line. Null text counts as empty, and
without a marker leaves no line; very long texts are read whole; rows with a
null conv_id are left out; a null turn comes first; repeated rows are kept as
turns. Of equally likely states the lowest counts. Turns of one role that follow
each other without markers are one turn if the model takes them so. A
conversation without any line renders as the empty text with 0 turns. An empty
table gives no rows. Other columns are ignored.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

ROLES = ("system", "user", "assistant")
NAMES = {"system": "system|developer|instructions?", "user": "user|human|customer|client|question|you|q", "assistant": "assistant|bot|ai|model|answer|gpt|agent|a"}
#: Chance that a turn's first line has its role's own marker, that it has none, an unknown one, and another role's.
MARKED = (0.9, 0.0899, 0.01, 0.0001)
#: The same for a further line.
INSIDE = (0.0001, 0.9899, 0.0099, 0.0001)
KINDS = len(ROLES) + 2  # a role's marker, none, unknown
LENGTHS = (1, 20, 60, 120, 250, 500, 1000)
FORMS = (len(LENGTHS) + 1) * 4
STATES = 2 * len(ROLES)

_ROLE = {n: i for i, r in enumerate(ROLES) for n in NAMES[r].replace("s?", "").split("|")} | {"instruction": 0, "instructions": 0}
_NAME = "|".join(NAMES.values())
_MARK = re.compile(
    rf"""\s*(?:
      <\|\s*(?:im_start\|>)?\s*(?P<a>\w+)(?:\s*\|>)?             # <|user|>, <|im_start|>user
    | \[\s*(?P<b>{_NAME})\s*\](?:\s*:)?                          # [user]
    | \#{{1,6}}\s*(?P<c>{_NAME})(?:\s*:)?(?=\s|$)                # ### User
    | (?P<d>\*\*|__)?\s*(?P<e>[^\W\d_]\w{{0,19}})\s*(?P<f>\*\*|__)?\s*[:>](?P<g>\*\*|__)?(?=\s|$)  # User:, **User**:, **User:**
    )[ ]?""",
    re.I | re.X,
)


def marker(line: str) -> tuple[int, str]:
    """(kind of marker, the line without a known marker)."""
    m = _MARK.match(line)
    if not m:
        return len(ROLES), line
    name = next(x for x in m.group("a", "b", "c", "e") if x is not None).lower()
    if name in _ROLE:
        return _ROLE[name], line[m.end() :]
    return len(ROLES) + 1, line


def form(line: str, blank: bool) -> int:
    n = int(np.searchsorted(LENGTHS, len(line), "right"))
    return (n * 2 + blank) * 2 + line.rstrip().endswith("?")


@dataclass
class Model:
    start: np.ndarray  # log-probabilities: of the first state, of the next, of forms and of markers
    step: np.ndarray
    form: np.ndarray
    mark: np.ndarray

    def viterbi(self, kinds: list[int], forms: list[int]) -> list[int]:
        """The likeliest states; of equal ones the lowest."""
        if not kinds:
            return []
        emit = self.mark[:, kinds] + self.form[:, forms]
        best = self.start + emit[:, 0]
        back = []
        for t in range(1, len(kinds)):
            way = best[:, None] + self.step
            back.append(way.argmax(0))
            best = way.max(0) + emit[:, t]
        s = [int(best.argmax())]
        for b in reversed(back):
            s.append(int(b[s[-1]]))
        return s[::-1]


def marks() -> np.ndarray:
    """Log-probabilities of marker kinds; state 2r is role r's first line, 2r + 1 a further one."""
    out = np.empty((STATES, KINDS))
    for r in range(len(ROLES)):
        for k, (own, none, unknown, other) in enumerate((MARKED, INSIDE)):
            row = np.full(KINDS, other)
            row[r], row[-2], row[-1] = own, none, unknown
            out[2 * r + k] = np.log(row / row.sum())
    return out


def model(first: np.ndarray, turns: np.ndarray, lines: np.ndarray, ends: np.ndarray, forms: np.ndarray) -> Model:
    """A model from counts: first roles, role after role, further lines by role, turns by role, forms by state."""
    n = len(ROLES)
    step = np.full((STATES, STATES), 1e-300)
    for r in range(n):
        more = (lines[r] + 1) / (lines[r] + ends[r] + 2)
        after = (turns[r] + 1) / (turns[r].sum() + n)
        for k in (0, 1):
            step[2 * r + k, 2 * r + 1] = more
            step[2 * r + k, 0::2] = (1 - more) * after
    start = np.full(STATES, 1e-12)
    start[0::2] = (first + 1) / (first.sum() + n)
    cells = forms.reshape(STATES, len(LENGTHS) + 1, 2, 2)
    form = np.zeros(cells.shape)
    for axis in (1, 2, 3):  # length, blank line before and question are independent, so that rare cells are not all alike
        own = cells.sum(tuple({1, 2, 3} - {axis}), keepdims=True)
        form += np.log((own + 1) / (own.sum(axis, keepdims=True) + own.shape[axis]))
    return Model(np.log(start), np.log(step), form.reshape(STATES, FORMS), marks())


def lines_of(text: str) -> list[tuple[str, bool]]:
    """The lines that aren't blank, each with whether a blank line (or nothing) is before it."""
    raw = (text or "").split("\n")
    at = [i for i, line in enumerate(raw) if line.strip()]
    return [(raw[i], k == 0 or at[k - 1] < i - 1) for k, i in enumerate(at)]


def _known(role: str = "role"):
    name = F.lower(F.trim(F.col(role).cast("string")))
    return F.when(name.isin(*ROLES), name)


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), _known().alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def train(conversations: DataFrame) -> Model:
    """Counts over all conversations; each task returns one row of counts."""
    n = len(ROLES)
    sizes = [n, n * n, n, n, STATES * FORMS]

    def run(batches):
        first, turns, lines, ends, forms = np.zeros(n), np.zeros((n, n)), np.zeros(n), np.zeros(n), np.zeros((STATES, FORMS))
        for batch in batches:
            for conv in batch.column(0):
                last = None
                for t in conv.as_py():
                    own = lines_of(t["text"])
                    if not own:
                        continue
                    r = ROLES.index(t["role"]) if t["role"] else None
                    if r is not None:
                        if last is None:
                            first[r] += 1
                        elif last >= 0:
                            turns[last, r] += 1
                        ends[r] += 1
                        lines[r] += len(own) - 1
                        for i, (line, blank) in enumerate(own):
                            forms[2 * r + (i > 0), form(line, blank or i == 0)] += 1
                    last = -1 if r is None else r
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, turns.ravel(), lines, ends, forms.ravel()])], pa.list_(pa.float64()))], ["counts"])

    rows = _sorted(conversations).select("turns").mapInArrow(run, "counts array<double>").select(F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(sum(sizes))
    for r in rows:
        flat[r["i"]] = r["c"]
    a = np.split(flat, np.cumsum(sizes)[:-1])
    return model(a[0], a[1].reshape(n, n), a[2], a[3], a[4].reshape(STATES, FORMS))


def named(conv: Column, t: Column, i: Column) -> Column:
    """The marker ``Role: `` of a turn."""
    return F.concat(F.initcap(t["role"]), F.lit(": "))


def varied(conv: Column, t: Column, i: Column) -> Column:
    """Markers of four kinds, for the first turn and for half of the others; the rest have none."""
    k = F.pmod(F.xxhash64(conv, t["turn"]), F.lit(8))
    role = F.initcap(t["role"])
    kinds = [(role, ": "), (F.lit("### "), role, "\n"), (F.lit("["), t["role"], "] "), (F.lit("**"), role, "**: ")]
    some = F.lit("")
    for n, kind in enumerate(kinds):
        some = F.when(k % 4 == n, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in kind])).otherwise(some)
    return F.when((i == 0) | (k < 4), some).otherwise("")


def transcripts(conversations: DataFrame, mark: Callable[[Column, Column, Column], Column] = named) -> DataFrame:
    """``(conv_id, transcript)``: turns in order, a blank line between them, each with the marker that ``mark`` gives for (conversation, turn, its number) where the role is known."""
    said = F.transform("turns", lambda t, i: F.concat(F.when(t["role"].isNotNull(), mark(F.col("conv_id"), t, i)).otherwise(F.lit("")), t["text"]))
    return _sorted(conversations).select("conv_id", F.array_join(said, "\n\n").alias("transcript"))


def parse(text: str, m: Model) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript."""
    raw = (text or "").split("\n")
    at = [i for i, line in enumerate(raw) if line.strip()]
    got = [marker(raw[i]) for i in at]
    states = m.viterbi([k for k, _ in got], [form(rest, k == 0 or at[k - 1] < at[k] - 1) for k, (_, rest) in enumerate(got)])
    first = [k for k, s in enumerate(states) if s % 2 == 0 or k == 0]
    turns = []
    for a, b in zip(first, [*first[1:], len(at)]):
        role = states[a] // 2
        own = raw[at[a] : at[b - 1] + 1]
        if got[a][0] == role:  # a marker of another role is part of the text, and so are all within a turn
            own[0] = got[a][1]
        while own and not own[0].strip():
            del own[0]
        turns.append((ROLES[role], "\n".join(own)))
    return turns


def render(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def format_chats(texts: DataFrame, m: Model) -> DataFrame:
    """``(conv_id, n_turns, roles, chat)`` of rows ``(conv_id, transcript)``."""
    sent = texts.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        for part in X.slices(batches, "transcript"):
            turns = [parse(t, sent.value) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in turns], pa.int32()), pa.array([",".join(r for r, _ in t) for t in turns]), pa.array([render(t) for t in turns])], ["conv_id", "n_turns", "roles", "chat"])

    return texts.select(F.col("conv_id").cast("long").alias("conv_id"), "transcript").filter(F.col("conv_id").isNotNull()).mapInArrow(run, "conv_id long, n_turns int, roles string, chat string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written with markers for the first turn and half of the others, parsed and rendered."""
    table = X.read(spark, sf_dir, "conversations")
    return format_chats(transcripts(table, varied), train(table))


def sql() -> str:
    """What the rendering must be: the turns of the table, with the roles that the model has to recover where the marker is missing."""
    return r"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^(\s*\n)+', ''), '(\n\s*)+$', '') AS text FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY turn, role, text) AS chat
FROM t GROUP BY conv_id"""
