"""Fill-in-the-middle transformation with a byte automaton (operator 11).

A text is n units: runs of ASCII letters, and every other code point alone. Its document's id gives two cuts between units,
and a form: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` leaves the text as it is.

1. automaton() builds one table over bytes: a state is the part of a sentinel read so far, whether a run of letters is open,
   and how many UTF-8 continuation bytes are due. A transition emits marks: a code point begins, a unit begins, a sentinel ends.
2. scan() takes every byte through the table once. Texts are dealt into stretches of STRETCH bytes that go side by side, one byte
   each a step; a state depends on the last few bytes only, so a stretch begins a few bytes early and is in the right state at
   its first own byte. Marks are counted by stretch.
3. locate() is the second pass: the counts name the stretch that holds a cut, which alone is read again.

Sentinels never overlap (each begins with < and ends with >), and a text that holds one stays plain, so restored() can
rebuild the text from output and form.

Edge cases: null and empty texts are plain, with n = 0; a null doc_id is hashed as the empty string; rows that repeat, and rows of
equal doc_id, are each transformed; an empty table gives no rows. Only doc_id and text are read. A text of any length goes
through in pieces of bounded size. Bytes that are not UTF-8 count a code point at each byte that is no continuation byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many stay plain, and so many of the others are spm.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Marks of a transition.
CHAR, UNIT, SENTINEL = 1, 2, 4
#: Bytes of one stretch, and stretches that go side by side.
STRETCH, SIDE = 256, 4096

FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def automaton(sentinels: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[np.ndarray, np.ndarray, int]:
    """Next state and marks for (state, byte), flat; and how many bytes back a state can reach.

    State 0 is where a text begins; NUL bytes leave it there.
    """
    marks = [s.encode() for s in sentinels]
    names: dict[tuple[bytes, bool, int], int] = {(b"", False, 0): 0}
    to, emits, todo = [], [], [(b"", False, 0)]
    for read, open_, due in todo:  # grows while it is read
        for byte in range(256):
            seen = read + bytes([byte])
            done = any(seen.endswith(m) for m in marks)
            while not any(m.startswith(seen) and m != seen for m in marks):  # the longest end that may still become a sentinel
                seen = seen[1:]
            letter = chr(byte) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
            inner = 0x80 <= byte < 0xC0
            left = max(due - 1, 0) if inner else (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
            state = (seen, letter or (inner and open_), left)
            if state not in names:
                names[state] = len(names)
                todo.append(state)
            to.append(names[state])
            emits.append((0 if inner else CHAR) | (0 if inner or (letter and open_) else UNIT) | (SENTINEL if done else 0))
    return np.array(to, np.int32), np.array(emits, np.uint8), max(3, *[len(m) - 1 for m in marks])


_TO, _EMIT, _BACK = automaton()


def _through(data: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks of the stretches that begin at `first` within the texts begin..end: one row each, 0 beyond the text."""
    at = first[None, :] + np.arange(-_BACK, STRETCH)[:, None]
    inside = (at >= begin) & (at < end)
    bytes_ = np.where(inside, data[np.minimum(np.maximum(at, 0), len(data) - 1)], 0).astype(np.int32)
    state = np.zeros(len(first), np.int32)
    out = np.empty((STRETCH, len(first)), np.uint8)
    for j in range(-_BACK, STRETCH):
        code = (state << 8) | bytes_[j + _BACK]
        if j >= 0:
            _EMIT.take(code, out=out[j])
        state = _TO.take(code)
    out[~inside[_BACK:]] = 0
    return out.T


class Scan:
    """Counts of one pass over texts that lie in a row (bytes and n + 1 offsets)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        n = -(-np.diff(offs) // STRETCH)
        self.at = np.concatenate([[0], np.cumsum(n)])  # a text's first stretch
        self.text = np.repeat(np.arange(len(n)), n)
        self.first = offs[self.text] + STRETCH * (np.arange(len(self.text)) - self.at[self.text])
        chars, units, found = (np.zeros(len(self.text) + 1, np.int64) for _ in range(3))
        for some in self._some(np.arange(len(self.text))):
            m = self._marks(some)
            for total, bit in ((chars, CHAR), (units, UNIT), (found, SENTINEL)):
                total[some + 1] = ((m & bit) > 0).sum(axis=1)
        self.chars, self.units, self.found = (np.cumsum(x) for x in (chars, units, found))

    def _some(self, which: np.ndarray) -> Iterator[np.ndarray]:
        for a in range(0, len(which), SIDE):
            yield which[a : a + SIDE]

    def _marks(self, some: np.ndarray) -> np.ndarray:
        text = self.text[some]
        return _through(self.data, self.first[some], self.offs[text], self.offs[text + 1])

    def of_texts(self, total: np.ndarray) -> np.ndarray:
        return np.diff(total[self.at])

    def locate(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (text, unit): the byte within the text at which that unit begins, and the code points before it; unit n: its end."""
        n, chars = self.of_texts(self.units), self.of_texts(self.chars)
        place, before = np.diff(self.offs)[text], chars[text]
        inner = np.flatnonzero(unit < n[text])
        sought = self.units[self.at[text[inner]]] + unit[inner]  # of all units, so many come before
        stretch = np.searchsorted(self.units, sought, side="right") - 1
        for some in self._some(np.arange(len(inner))):
            s = stretch[some]
            m = self._marks(s)
            nth = np.cumsum((m & UNIT) > 0, axis=1)
            j = (nth > (sought[some] - self.units[s])[:, None]).argmax(axis=1)
            own = np.cumsum(m & CHAR, axis=1)[np.arange(len(s)), j] - 1  # the unit's own first code point comes after the cut
            i, t = inner[some], text[inner[some]]
            place[i] = self.first[s] + j - self.offs[t]
            before[i] = self.chars[s] - self.chars[self.at[t]] + own
        return place, before


def _draws() -> list[Column]:
    """The first four groups of 8 hex digits of sha256("1:" + doc_id), as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (null where plain) and output for each row of docs."""
    rows = common.text_only(docs).select("doc_id", "text", *_draws())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            data, offs = common.text_arrays(b.column(1))
            h1, h2, h3, h4 = (b.column(k).to_numpy() for k in range(2, 6))
            seen = Scan(data, offs)
            n = seen.of_texts(seen.units)
            plain = (n == 0) | (seen.of_texts(seen.found) > 0) | (h3 % 100 >= PLAIN_FROM)
            spm = h4 % 100 < SPM_BELOW
            cut = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            cut_texts = np.flatnonzero(~plain)
            place, chars = seen.locate(np.tile(cut_texts, 2), cut[:, cut_texts].ravel())
            (p, q), (cp, cq) = place.reshape(2, -1), chars.reshape(2, -1)
            out, form = [], []
            nth = 0
            for i, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                text = data[a:z].tobytes()
                if plain[i]:
                    out.append(text)
                    form.append("plain")
                    continue
                x, y = p[nth], q[nth]
                nth += 1
                before, after = (PREFIX.encode(), text[:x]), (SUFFIX.encode(), text[y:])
                out.append(b"".join((*after, *before) if spm[i] else (*before, *after)) + MIDDLE.encode() + text[x:y])
                form.append("spm" if spm[i] else "psm")
            prefix, middle = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            prefix[cut_texts], middle[cut_texts] = cp, cq - cp
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(form), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).view(pa.string())],
                [f.split()[0] for f in FIELDS.split(", ")],
            )

    return rows.mapInArrow(run, FIELDS)


def restored(output: Column, form: Column) -> Column:
    """The text that transform() had, from its output and form."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)  # the output begins with a mark, so the first part is empty
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def digest(docs: DataFrame) -> DataFrame:
    """transform()'s rows with SHA-256 of output and of the text rebuilt from it, in place of the output."""
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
