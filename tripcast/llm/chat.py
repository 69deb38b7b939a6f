"""Chat formatting: roles of a transcript by a hidden Markov model.

A transcript is text in which turns follow each other, marked in one of many
ways or only set apart by blank lines. Its lines are the observations, a speaker
marker and a few plain features each; the hidden states say whose turn a line
belongs to and whether it opens it. Viterbi's best path gives the turns, which
are then written in one canonical form.

The model is counted from conversations whose roles are known: each task counts
its own lines, and only the sums, a few hundred numbers, reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.llm.arrow import long_rows

ROLES = ("system", "user", "assistant")
STATES = [(r, opens) for r in ROLES for opens in (True, False)]
PRIOR = 0.1          # added to every count
PART_TURNS = 64      # turns of a conversation that make one transcript

# Words that mark a speaker, and ways to write a transcript.
SPEAKERS = {
    "system": "system", "context": "system", "instructions": "system", "note": "system", "setting": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "guest": "user", "customer": "user",
    "me": "user", "prompt": "user",
    "assistant": "assistant", "ai": "assistant", "a": "assistant", "answer": "assistant", "bot": "assistant",
    "agent": "assistant", "model": "assistant", "reply": "assistant",
}
MANNERS = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### System:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "**Note:** ", "user": "**Customer:** ", "assistant": "**Agent:** "},
    {"system": "Setting> ", "user": "Guest> ", "assistant": "Bot> "},
    {"system": "Host: ", "user": "Nora: ", "assistant": "Milo: "},
    {"system": "", "user": "", "assistant": ""},
)

MARKER = re.compile(
    r"\s*(?:#+\s*|\*\*)?(?:\[(?P<square>[A-Za-z]\w{0,19})\]:?|(?P<word>[A-Za-z]\w{0,19})(?::\*\*|\*\*:|:|>))(?:\s+|$)")


def marker(line: str) -> tuple[str, int]:
    """What the line's marker says ('' for none, 'name' for an unknown speaker),
    and how many characters it takes."""
    m = MARKER.match(line)
    if not m:
        return "", 0
    return SPEAKERS.get((m["square"] or m["word"]).lower(), "name"), m.end()


def features(lines: list[str]) -> list[tuple]:
    """Observations of each line: marker, marker alone, blank, after a blank, length, question."""
    out, blank_before = [], True
    for line in lines:
        says, taken = marker(line)
        body = line.strip()
        out.append((
            ("marker", says), ("alone", bool(says) and taken >= len(line)), ("blank", not body),
            ("after", blank_before), ("length", min(len(body) // 40, 4)), ("asks", body.endswith("?"))))
        blank_before = not body
    return out


def write_transcript(turns: list[tuple[str, str]], manner: int) -> tuple[str, list[tuple[str, bool]]]:
    """A transcript in one of the manners, and the true state of each line."""
    words = MANNERS[manner]
    lines: list[str] = []
    states: list[tuple[str, bool]] = []
    for k, (role, text) in enumerate(turns):
        own = (words.get(role, words["user"]) + text).split("\n")
        if k and not words["user"]:
            lines.append("")
            states.append((turns[k - 1][0], False))
        lines += own
        states += [(role, i == 0) for i in range(len(own))]
    return "\n".join(lines), states


@dataclass(frozen=True)
class Model:
    """Logarithms of start, step and observation probabilities."""

    start: np.ndarray
    step: np.ndarray
    seen: dict[tuple, np.ndarray]
    unseen: np.ndarray

    def best_path(self, observations: list[tuple]) -> list[tuple[str, bool]]:
        """Viterbi's path; ties go to the earlier state of ``STATES``."""
        if not observations:
            return []
        score, back = None, []
        for line in observations:
            heard = sum(self.seen.get(f, self.unseen) for f in line)
            if score is None:
                score = self.start + heard
                continue
            ways = score[:, None] + self.step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + heard
        path = [int(score.argmax())]
        for choice in reversed(back):
            path.append(int(choice[path[-1]]))
        return [STATES[s] for s in reversed(path)]


def counted(lines: list[str], states: list[tuple[str, bool]]) -> Counter:
    out: Counter = Counter()
    previous = None
    for line, state in zip(features(lines), states):
        s = STATES.index(state)
        out["start" if previous is None else "step", str(-1 if previous is None else previous), s] += 1
        for name, value in line:
            out[name, str(value), s] += 1
        previous = s
    return out


def model_of(counts: dict[tuple, int]) -> Model:
    """Probabilities from counts, a tenth added to each possible case. A turn goes on
    only as the same speaker's, which the counts can't break."""
    n = len(STATES)
    start, step, lines = np.full(n, PRIOR), np.full((n, n), PRIOR), np.full(n, PRIOR)
    cases: dict[str, set] = {}
    for (name, value, s), c in counts.items():
        if name == "start":
            start[s] += c
        elif name == "step":
            step[int(value), s] += c
        else:
            cases.setdefault(name, set()).add(value)
            if name == "blank":
                lines[s] += c
    barred = np.array([[not opens and r != role for r, opens in STATES] for role, _ in STATES])
    first = np.array([not opens for _, opens in STATES])
    with np.errstate(divide="ignore"):
        log_start = np.log(np.where(first, 0, start) / start[~first].sum())
        allowed = np.where(barred, 0, step)
        log_step = np.log(allowed / allowed.sum(axis=1, keepdims=True))
    seen = {}
    for name, values in cases.items():
        for value in values:
            c = np.array([counts.get((name, value, s), 0) for s in range(n)])
            seen[name, value] = np.log((c + PRIOR) / (lines + PRIOR * len(values)))
    return Model(log_start, log_step, {(k, _typed(v)): x for (k, v), x in seen.items()}, np.log(PRIOR / (lines + 2 * PRIOR)))


def _typed(value: str):
    return {"True": True, "False": False}.get(value, int(value) if value.isdigit() else value)


def speaker(line: str) -> str:
    """The word of the line's marker, in lower case; '' for none."""
    m = MARKER.match(line)
    return (m["square"] or m["word"]).lower() if m else ""


def marks_turns(openings: list[str]) -> bool:
    """Whether a transcript marks its speakers: every turn opens with a marker, and more than
    half of the turns with the word of a known speaker or one that comes again. Otherwise a
    first word such as 'Warning:' belongs to the text."""
    words = [speaker(line) for line in openings]
    sure = sum(w in SPEAKERS or words.count(w) > 1 for w in words)
    return "" not in words and 2 * sure > len(words)


def turns_of(transcript: str, model: Model) -> list[tuple[str, str]]:
    """Roles and texts of a transcript's turns, without outer white space and, if it marks
    its speakers, without the markers."""
    if not transcript.strip():
        return []
    lines = transcript.split("\n")
    path = model.best_path(features(lines))
    marked = marks_turns([line for line, (_, opens) in zip(lines, path) if opens])
    out: list[tuple[str, list[str]]] = []
    for line, (role, opens) in zip(lines, path):
        if opens:
            out.append((role, [line[marker(line)[1]:] if marked else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(own).strip()) for role, own in out]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form. Control words in a text get a backslash, and
    backslashes before them another, so that the form can be read back."""
    return "".join(
        f"<|im_start|>{role}\n" + re.sub(r"<(\\*)\|im_(start|end)\|>", r"<\\\1|im_\2|>", text) + "<|im_end|>\n"
        for role, text in turns)


def canonical(turns: Column) -> Column:
    """``render`` of an array of turns with ``role`` and ``text``, in Spark, the texts
    without outer white space."""
    def one(turn: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(turn["text"], r"^\s+|\s+$", ""), r"<(\\*)\|im_(start|end)\|>", r"<\\$1|im_$2|>")
        return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), text, F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, one), "")


def read_back(form: str) -> list[tuple[str, str]]:
    return [
        (m[1], re.sub(r"<\\(\\*)\|im_(start|end)\|>", r"<\1|im_\2|>", m[2]))
        for m in re.finditer(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", form, re.S)]


def held_out(conv_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def conversations_as_parts(
    rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id, part, turns``: conversations in parts of 64 turn numbers, which
    bounds what one row holds. Equal rows are one turn. Turns with the same number
    are ordered by role and text; a null number counts as 0, a null text as
    empty. A row without a conversation is one of its own."""
    clean = long_rows(rows).select(
        F.col(id_column).cast("long").alias("conv_id"), F.coalesce(F.col(turn_column).cast("long"), F.lit(0)).alias("turn"),
        F.col(role_column).cast("string").alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    once = clean.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(0)
    part = F.floor(F.col("turn") / PART_TURNS)
    return once.groupBy("conv_id", part.alias("part"), alone.alias("alone")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).drop("alone")


def with_transcripts(parts: DataFrame) -> DataFrame:
    """Parts with a ``transcript``, written in a manner that hangs on the conversation,
    and ``manner``; columns of these names are replaced. Roles other than the known three
    speak as users. Null and repeated texts are as ``conversations_as_parts`` left them, a
    part without turns has an empty transcript, and an empty table gives none."""
    parts = parts.drop(*[c for c in parts.columns if c.lower() in ("manner", "transcript")])
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                write_transcript([(t["role"] if t["role"] in ROLES else "user", t["text"]) for t in turns], manner)[0]
                for turns, manner in zip(batch.column("turns").to_pylist(), batch.column("manner").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "transcript"])
    chosen = parts.withColumn("manner", F.pmod(
        F.xxhash64(F.coalesce("conv_id", F.lit(0).cast("long"))), F.lit(len(MANNERS))).cast("int"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(run, f"{kinds}, transcript string")


def fit(parts: DataFrame) -> Model:
    """Count the model from parts with ``turns`` and ``manner``. Turns whose role is
    unknown leave their part out. Without any labelled part all cases are equally likely."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for turns, manner in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = [(t["role"], t["text"]) for t in turns]
                if all(role in ROLES for role, _ in known):
                    text, states = write_transcript(known, manner)
                    total.update(counted(text.split("\n"), states))
        names, values, states = (list(c) for c in zip(*total)) if total else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(states, pa.int32()),
             pa.array(list(total.values()), pa.int64())], names=["name", "value", "state", "n"])
    counts = parts.select("turns", "manner").mapInArrow(run, "name string, value string, state int, n long")
    sums = counts.groupBy("name", "value", "state").agg(F.sum("n").alias("n")).collect()
    return model_of({(r["name"], r["value"], r["state"]): r["n"] for r in sums})


def format_transcripts(rows: DataFrame, model: Model, text_column: str = "transcript") -> DataFrame:
    """``rows`` with ``roles`` and ``formatted``: the recovered turns in canonical
    form; columns of these names are replaced. Null and blank transcripts have no turns and
    an empty form; repeated rows are formatted each, and an empty table gives none."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [turns_of(t.as_py() or "", model) for t in batch.column(text_column)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[r for r, _ in turns] for turns in found], pa.list_(pa.string())),
                 pa.array([render(turns) for turns in found], pa.string())],
                names=[*batch.schema.names, "roles", "formatted"])
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("roles", "formatted")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, roles array<string>, formatted string")
