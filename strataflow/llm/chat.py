"""Chat formatting: roles of a raw transcript by a hidden Markov model.

A transcript is lines of text.  Each line is observed as a speaker marker (its form and role, an unknown name, or none) and by its
shape (blank, question, list or code, plain); whether the line before is blank chooses the moves.  A state is a way of marking speakers
(one of the marker forms, names, or none but blank lines), which stays as it is, a role, and whether the line begins a
turn.  So a marker in another form than the transcript's own is a quotation.  All probabilities are learned from conversations whose roles are
known: counts of moves, markers and shapes over a prior.  Viterbi finds the likeliest path of the whole conversation; turns are rendered canonically.

A conversation is one chain, whatever its length: its lines and back pointers wait in a temporary file where they are many.
Null texts are empty turns; null and unknown roles are written down as the user's; each row of a null conversation is a conversation of its
own; repeated rows count once, with their number of copies; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096  # lines that are held at once
ROLES = ("system", "user", "assistant")
#: fixed values: names by which transcripts call a role
NAMES = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "me", "prompter", "client"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "gpt", "model", "agent", "response"),
}
_ROLE = {n: k for k, r in enumerate(ROLES) for n in NAMES[r]}
_FORMS = (
    re.compile(r"^\s{0,3}<\|(?:im_start\|>)?([A-Za-z]{1,14})(?:\|>)?[ \t]*"),
    re.compile(r"^\s{0,3}\[([A-Za-z]{1,14})\]:?[ \t]*"),
    re.compile(r"^\s{0,3}#{1,4}[ \t]*([A-Za-z]{1,14}):?[ \t]*$"),
    re.compile(r"^\s{0,3}\*\*([A-Za-z]{1,14}):?\*\*:?[ \t]*"),
    re.compile(r"^\s{0,3}([A-Za-z]{1,14}):[ \t]+"),
    re.compile(r"^\s{0,3}([A-Za-z]{1,14}):$"),
)
_LIST = re.compile(r"^\s*(?:[-*+] |\d+[.)] |```|    )")


def observe(line: str) -> tuple[int, int, int, int]:
    """(marker: role, 3 for another name, 4 for none; its form; shape; where the text after the marker starts)."""
    mark, form, start = 4, 0, 0
    for k, pattern in enumerate(_FORMS):
        m = pattern.match(line)
        if m:
            role = _ROLE.get(m[1].lower())
            if role is not None or k == NAMED:
                mark, form, start = (3 if role is None else role), k, m.end()
                break
    rest = line[start:].strip()
    shape = 0 if not rest else 1 if rest.endswith("?") else 2 if _LIST.match(line[start:]) else 3
    return mark, form, shape, start


NAMED = 4  # the form that any name may have
MODES = len(_FORMS) + 2  # a form of markers; names; none
# states of a mode: 0-2 the first line of a turn of a role, 3-5 later ones; symbols: a role, a name, another form's marker, none


class Chain:
    """Log probabilities: start (mode, state), moves (mode, blank before, state, state), marks (mode, state, symbol) and
    shapes (state, shape)."""

    SHAPES = ((MODES, 6), (MODES, 2, 6, 6), (MODES, 6, 6), (6, 4))

    def __init__(self, counts: list[np.ndarray] | None = None):
        start, moves, marks, shapes = (np.full(s, 0.01) for s in self.SHAPES)
        start[:, :3] += [1, 4, 0.5]
        for m in range(MODES):
            for blank in (0, 1):
                turn = (0.3, 0.05)[not blank] if m == MODES - 1 else 0.2
                for s in range(6):
                    moves[m, blank, s, :3] += 5 * turn * np.array([0.02, 0.96 if s % 3 != 1 else 0.02, 0.96 if s % 3 == 1 else 0.02])
                    moves[m, blank, s, 3 + s % 3] += 5 * (1 - turn)
            marks[m, 3:, 4:] += [0.1, 5]
            for r in range(3):
                marks[m, r, (r, 3, 5)[(m >= MODES - 2) + (m == MODES - 1)]] += 5
        own = [start, moves, marks, shapes + 1]
        if counts:
            own = [a + b for a, b in zip(own, counts, strict=True)]
        # all modes alike at the start, roles as they are met
        self.start, self.moves, self.marks, self.shapes = (np.log(x / x.sum(-1, keepdims=True)) for x in own)
        self.start += np.log(1 / MODES)

    @staticmethod
    def symbols(mark: int, form: int) -> np.ndarray:
        """What each mode sees of a line."""
        out = np.full(MODES, 5 if mark == 4 else 4)
        if mark < 3:
            out[form] = mark
        elif mark == 3:
            out[MODES - 2] = 3
        return out


_SEEN = {(mark, form): Chain.symbols(mark, form) for mark in range(5) for form in range(len(_FORMS))}
_EVERY = np.arange(MODES)


def counted(lines: Iterable[tuple[str, int, bool]], mode: int, counts: list[np.ndarray]) -> None:
    """Adds (line, role, whether it begins a turn) of a conversation to the counts of a chain."""
    start, moves, marks, shapes = counts
    last, blank = None, False
    for line, role, first in lines:
        mark, form, shape, _ = observe(line)
        state = role + 3 * (not first)
        if last is None:
            start[mode, state] += 1
        else:
            moves[mode, int(blank), last, state] += 1
        marks[mode, state, _SEEN[mark, form][mode]] += 1
        shapes[state, shape] += 1
        last, blank = state, shape == 0 and mark == 4


class _Spool:
    """Blocks of a list too long to hold, read again from either end."""

    def __init__(self) -> None:
        self.blocks: list = []
        self.file = None

    def add(self, block) -> None:
        if not self.blocks and self.file is None:
            self.blocks = [block]  # most conversations are one block
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
            first, self.blocks = self.blocks, []
            self._put(first[0])
        self._put(block)

    def _put(self, block) -> None:
        self.file.seek(0, 2)
        self.blocks.append(self.file.tell())
        pickle.dump(block, self.file)

    def read(self, back: bool = False) -> Iterator:
        for x in reversed(self.blocks) if back else self.blocks:
            if self.file is None:
                yield x
            else:
                self.file.seek(x)
                yield pickle.load(self.file)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def parse(lines: Iterable[tuple[str, int]], chain: Chain, block: int | None = None) -> Iterator[tuple[str, str, int]]:
    """(role, text, number) of each turn of a transcript; lines come with a number, a turn has that of its first line."""
    block = block or BLOCK
    spool, held = _Spool(), []
    score, blank = None, 0
    back = np.zeros((block, MODES, 6), np.int8)
    for line, number in lines:
        mark, form, shape, start = observe(line)
        own = chain.marks[_EVERY, :, _SEEN[mark, form]] + chain.shapes[:, shape]
        if score is None:
            score = chain.start + own
        else:
            step = score[:, :, None] + chain.moves[:, blank]
            back[len(held)] = step.argmax(1)
            score = step.max(1) + own
        blank = int(shape == 0 and mark == 4)
        held.append((line, number, mark, form, start))
        if len(held) == block:
            spool.add((held, back))
            held, back = [], np.zeros((block, MODES, 6), np.int8)
    if held:
        spool.add((held, back[: len(held)]))
    if score is None:
        return
    mode, state = divmod(int(score.argmax()), 6)
    paths = _Spool()
    for own, pointers in spool.read(back=True):
        path = np.empty(len(own), np.int8)
        for i in range(len(own) - 1, -1, -1):
            path[i] = state
            state = int(pointers[i, mode, state])
        paths.add(path)
    role, text, at = None, [], 0
    for (own, _), path in zip(spool.read(), paths.read(back=True), strict=True):
        for (line, number, mark, form, start), s in zip(own, path.tolist(), strict=True):
            marker = s < 3 and (form == mode if mark < 3 else mark == 3 and mode == MODES - 2)
            if s < 3 or role is None:
                if role is not None:
                    yield ROLES[role], "\n".join(text).strip("\n"), at
                role, text, at = s % 3, [], number
            text.append(line[start:] if marker else line)
    yield ROLES[role], "\n".join(text).strip("\n"), at
    spool.close()
    paths.close()


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


#: how conversations are written down as transcripts, by crc32 of their id: with markers, with names only, with blank lines only
STYLES = ("{Role}: {text}", "### {Role}\n{text}", "[{Role}] {text}", "<|im_start|>{role}\n{text}", "**{Role}:** {text}", "{Role}:\n{text}", "{name}: {text}", "\n{text}")
#: the mode of each style
STYLE_MODES = (4, 2, 1, 0, 3, 5, MODES - 2, MODES - 1)
_NAME = {"system": "Notice", "user": "Kim", "assistant": "Lee"}
_KEY = ("conv_id", "_own")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their copies, the lines a transcript has for them, and its style; dealt and sorted by conversation."""
    role = F.coalesce(F.when(F.col("role").isin(*ROLES), F.col("role")), F.lit("user"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), own.alias("_own"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one shuffle: rows of a conversation are where their copies are
    x = rows.repartition(*_KEY).groupBy(*_KEY, "turn", "role", "text").agg(F.count("*").alias("copies"))
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(len(STYLES)))
    piece = None
    for k, s in enumerate(STYLES):
        pick = F.element_at(F.create_map(*[y for r in ROLES for y in (F.lit(r), F.lit(s.removesuffix("{text}").format(Role=r.capitalize(), role=r, name=_NAME[r])))]), F.col("role"))
        piece = F.when(style == k, pick) if piece is None else piece.when(style == k, pick)
    full = x.select(*_KEY, "turn", "role", "text", "copies", style.cast("int").alias("style"), F.concat(piece, "text").alias("raw"))
    return full.sortWithinPartitions(*_KEY, "turn", "role", "text")


_COLUMNS = (*_KEY, "turn", "role", "text", "copies", "style", "raw")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of each conversation; rows must be read before the next one is asked for."""
    stream = (row for b in batches for row in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in _COLUMNS), strict=True))
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[:2]

        def rows() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                yield ahead[2:]
                ahead = next(stream, None)

        own = rows()
        yield key, own
        for _ in own:
            pass


def learn(rows: DataFrame) -> Chain:
    """The chain of transcripts whose roles are known."""
    sizes = [int(np.prod(s)) for s in Chain.SHAPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(s) for s in Chain.SHAPES]
        for _, own in _conversations(batches):
            first = next(own)
            said = lambda first=first, own=own: ((x, ROLES.index(r[1]), k == 0) for q in ((first,), own) for r in q for k, x in enumerate(r[5].split("\n")))
            counted(said(), STYLE_MODES[first[4]], counts)
        flat = np.concatenate([c.reshape(-1) for c in counts])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "c"])

    flat = np.zeros(sum(sizes))
    for r in rows.mapInArrow(run, "at long, c double").groupBy("at").agg(F.sum("c").alias("c")).collect():  # some hundred cells
        flat[r.at] = r.c
    return Chain([x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), Chain.SHAPES, strict=True)])


def format_chats(conversations: DataFrame, chain: Chain | None = None) -> DataFrame:
    """conv_id, seq, role, text, rendered of every turn found in the transcripts; turn and copies of the table's row in which
    it begins; agrees: whether that row has this role and this text."""
    rows = transcripts(conversations)
    held = conversations.sparkSession.sparkContext.broadcast(chain or learn(rows))  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, _), own in _conversations(batches):
            said: list[tuple] = []  # of each row: turn, role, copies; texts are compared as they pass
            texts = _Texts()

            def lines() -> Iterator[tuple[str, int]]:
                for turn, role, text, copies, _, raw in own:
                    said.append((turn, role, copies))
                    texts.add(text)
                    for x in raw.split("\n"):
                        yield x, len(said) - 1

            for seq, (role, text, at) in enumerate(parse(lines(), held.value)):
                turn, known, copies = said[at]
                out.append((conv, turn, seq, role, text, render(role, text), copies, known == role and texts.same(at, text)))
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return rows.mapInArrow(run, "conv_id long, turn long, seq long, role string, text string, rendered string, copies long, agrees boolean")


class _Texts:
    """Digests of a conversation's texts."""

    def __init__(self) -> None:
        self.held: list[bytes] = []

    def add(self, text: str) -> None:
        self.held.append(hashlib.sha256(text.encode()).digest())

    def same(self, i: int, text: str) -> bool:
        return self.held[i] == hashlib.sha256(text.encode()).digest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = ["conv_id", "turn", "seq", "role", "text", "rendered", "copies", "agrees"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
