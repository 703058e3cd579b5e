"""Fill-in-middle transformation over texts stored as seekable compressed frames.

A text is stored as independent zstandard frames, one after another in one
binary, with the cumulative counts of bytes, lines and code points at each
frame. Where a cut falls is read from the counts, and only the frame that holds
it is decompressed; texts and digests are streamed from the frames in order, so
a task holds one frame of a text at a time, whatever the text's length is. The
store is a table: it is written once and serves any number of seeds and rates.

Lines (a text up to and with ``\\n``, or the rest without one) are the units
that are cut between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_of

FRAME_BYTES = 1 << 18
_NEWLINE = 10
_STORE = "frames binary, at array<long>, bytes array<long>, units array<long>, chars array<long>"


@dataclass(frozen=True)
class Form:
    """Marks, percentages and seed of the transformation; a text that holds a mark stays plain."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm_rate: int = 50
    seed: int = 7


def _points(piece: bytes) -> int:
    """Code points that begin in ``piece``."""
    return int(np.count_nonzero((np.frombuffer(piece, dtype=np.uint8) & 0xC0) != 0x80))


def pack(text: bytes, frame_bytes: int = FRAME_BYTES, level: int = 3) -> tuple:
    """``(frames, at, bytes, units, chars)`` of one text: list entry k holds what lies before frame k, the last one the totals."""
    packer = zstandard.ZstdCompressor(level=level)
    frames: list[bytes] = []
    at, size, units, chars = [0], [0], [0], [0]
    for start in range(0, len(text), frame_bytes):
        piece = text[start:start + frame_bytes]
        frames.append(packer.compress(piece))
        at.append(at[-1] + len(frames[-1]))
        size.append(size[-1] + len(piece))
        units.append(units[-1] + piece.count(b"\n"))
        chars.append(chars[-1] + _points(piece))
    if text and text[-1] != _NEWLINE:
        units[-1] += 1
    return b"".join(frames), at, size, units, chars


def store_of(text: Column, frame_bytes: int = FRAME_BYTES, level: int = 3) -> Column:
    """The frames of a text column as a struct; texts pass as bytes and are not decoded."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pack(bytes(t), frame_bytes, level) for t in texts], columns=[c.split()[0] for c in _STORE.split(", ")])

    return F.pandas_udf(batch, _STORE)(text.cast("binary"))


def store_frames(docs: DataFrame, text_col: str = "text", frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """``docs`` with the text replaced by ``_store``, its frames and counts.

    A null text is stored as an empty one, without frames. Every row is stored
    by itself, so repeated rows and rows without an id stay as they are, and a
    text of any length is one row of frames. An empty table stays empty. Other
    columns pass through; one named ``_store`` is replaced.
    """
    return docs.withColumn("_store", store_of(text_of(text_col), frame_bytes, level)).drop(*({text_col} - {"_store"}))


class Frames:
    """One stored text; decompresses a frame when it is asked for, and keeps the last one."""

    def __init__(self, store: dict) -> None:
        self._data = memoryview(store["frames"])
        self._at, self._bytes, self._units, self._chars = (np.asarray(store[c], dtype=np.int64) for c in ("at", "bytes", "units", "chars"))
        self._held: tuple[int, bytes] = (-1, b"")

    @property
    def n_units(self) -> int:
        return int(self._units[-1])

    @property
    def n_bytes(self) -> int:
        return int(self._bytes[-1])

    @property
    def n_chars(self) -> int:
        return int(self._chars[-1])

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, zstandard.ZstdDecompressor().decompress(self._data[self._at[k]:self._at[k + 1]]))
        return self._held[1]

    def cut(self, k: int) -> tuple[int, int]:
        """``(bytes, code points)`` of the first ``k`` units."""
        if k == 0:
            return 0, 0
        if k == self.n_units:
            return self.n_bytes, self.n_chars
        f = int(np.searchsorted(self._units, k, side="left")) - 1
        piece = self._frame(f)
        ends = np.flatnonzero(np.frombuffer(piece, dtype=np.uint8) == _NEWLINE)
        inside = int(ends[k - int(self._units[f]) - 1]) + 1
        return int(self._bytes[f]) + inside, int(self._chars[f]) + _points(piece[:inside])

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame by frame."""
        if start >= end:
            return
        f = int(np.searchsorted(self._bytes, start, side="right")) - 1
        while start < end:
            base = int(self._bytes[f])
            piece = self._frame(f)[start - base:end - base]
            yield piece
            start += len(piece)
            f += 1


def find_marks(pieces: Iterator[bytes], marks: list[bytes]) -> list[int]:
    """Where each mark stands for the first time after the one before it, or -1, in a stream read once."""
    places, at, buf = [], 0, b""
    for piece in pieces:
        buf += piece
        while len(places) < len(marks):
            hit = buf.find(marks[len(places)])
            if hit < 0:
                break
            places.append(at + hit)
            drop = hit + len(marks[len(places) - 1])
            at, buf = at + drop, buf[drop:]
        if len(places) == len(marks):
            break
        keep = len(marks[len(places)]) - 1
        drop = max(0, len(buf) - keep)
        at, buf = at + drop, buf[drop:]
    return places + [-1] * (len(marks) - len(places))


def _between(pieces: Iterator[bytes], start: int, end: int) -> Iterator[bytes]:
    at = 0
    for piece in pieces:
        if at >= end:
            return
        if at + len(piece) > start:
            yield piece[max(0, start - at):end - at]
        at += len(piece)


def _digest(pieces: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece)
    return h.hexdigest()


class Transformed:
    """The transformation of one stored text, as a stream that can be read any number of times."""

    def __init__(self, doc_id: int | None, frames: Frames, form: Form) -> None:
        self._frames = frames
        self._marks = {"P": form.prefix.encode(), "S": form.suffix.encode(), "M": form.middle.encode()}
        drawn = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else int(doc_id)}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(drawn[k:k + 8], 16) for k in (0, 8, 16, 24))
        self.n = frames.n_units
        a, b = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        self.form = "spm" if h4 % 100 < form.spm_rate else "psm"
        if self.n == 0 or h3 % 100 >= form.rate or self._holds_mark():
            self.form = "plain"
        self.prefix_chars = self.middle_chars = None
        if self.form != "plain":
            (p, self.prefix_chars), (m, chars) = frames.cut(a), frames.cut(b)
            self.middle_chars = chars - self.prefix_chars
            self._parts = {"P": (0, p), "M": (p, m), "S": (m, frames.n_bytes)}

    def _holds_mark(self) -> bool:
        # One pass for each mark; the frame of a text that has only one is decompressed once.
        return any(find_marks(self._frames.stream(0, self._frames.n_bytes), [m])[0] >= 0 for m in self._marks.values())

    @property
    def order(self) -> str:
        return {"psm": "PSM", "spm": "SPM"}.get(self.form, "")

    def output(self) -> Iterator[bytes]:
        if self.form == "plain":
            yield from self._frames.stream(0, self._frames.n_bytes)
        for part in self.order:
            yield self._marks[part]
            yield from self._frames.stream(*self._parts[part])

    def restored(self) -> Iterator[bytes]:
        return restore(self.output, self.form, self._marks)


def restore(output: Callable[[], Iterator[bytes]], form: str, marks: dict[str, bytes]) -> Iterator[bytes]:
    """The text behind an output, read from the output and its form alone."""
    if form == "plain":
        yield from output()
        return
    order = form.upper()
    places = find_marks(output(), [marks[c] for c in order])
    starts = [p + len(marks[c]) for p, c in zip(places, order)]
    ends = [*places[1:], 1 << 62]
    spans = dict(zip(order, zip(starts, ends)))
    for part in "PMS":
        yield from _between(output(), *spans[part])


def _transform(store: DataFrame, id_col: str, form: Form, more: str, row: Callable[[Transformed], tuple]) -> DataFrame:
    """The rows of a store with the columns ``more``; other columns do not go through Python."""
    names = [c.split()[0] for c in more.split(", ")]

    def batch(ids: pd.Series, stores: pd.DataFrame) -> pd.DataFrame:
        made = [
            row(Transformed(None if i is None else int(i), Frames(dict(zip(stores.columns, s))), form))
            for i, s in zip(ids, stores.itertuples(index=False, name=None))
        ]
        new = pd.DataFrame(made, columns=names, dtype=object)
        return new.astype({c: "Int64" for c in ("n", "prefix_chars", "middle_chars")})

    kept = [store[f"`{c}`"] for c in store.columns if c not in {"_store", *names}]
    made = F.pandas_udf(batch, more)(F.col(id_col).cast("string"), F.col("_store"))
    # One array of one struct: its fields are read without running the function again for each.
    return store.select(*kept, F.inline(F.array(made)))


_FACTS = "n long, form string, prefix_chars long, middle_chars long"


def fim_texts(store: DataFrame, id_col: str = "doc_id", form: Form = Form()) -> DataFrame:
    """The rows of a store with ``n, form, prefix_chars, middle_chars`` and the transformed text in ``fim_text``.

    The draw depends on the integer id and the seed alone, so repeated rows get
    equal texts; a null id counts as an empty one. Empty texts, and texts that
    hold a mark, are plain. A very long text is put together once, in its cell.
    """
    return _transform(
        store, id_col, form, f"{_FACTS}, fim_text string",
        lambda t: (t.n, t.form, t.prefix_chars, t.middle_chars, b"".join(t.output()).decode("utf-8", "replace")),
    )


def fim_digests(store: DataFrame, id_col: str = "doc_id", form: Form = Form()) -> DataFrame:
    """As :func:`fim_texts`, with the SHA-256 of the output and of the text restored from it, both streamed from the frames."""
    return _transform(
        store, id_col, form, f"{_FACTS}, output_sha256 string, restored_sha256 string",
        lambda t: (t.n, t.form, t.prefix_chars, t.middle_chars, _digest(t.output()), _digest(t.restored())),
    )
