"""Language identification by cross-parsing entropy with suffix automata (operator 4).

For each language a suffix automaton of labelled text is built. A document is parsed from left to right into the
longest phrases that occur in a language's text; few phrases for its length mean that it looks like that language.
The phrase counts are normalised by the document's length and the size of the language's text (phrases times log of
the text's size, per character), and the language with the least wins. The score is 1 - least / second least.

The labelled text of a language is a bounded sample: the documents with the smallest hashes of doc_id, about
SAMPLE_DOCS of them, up to DOC_CHARS characters each and SAMPLE_CHARS in all. Predictions read whole texts.

Edge cases: a text that is null, empty or has no letter gets `und` and score 0; equal least counts go to the
language whose name sorts first; rows without lang are never learned from; with no labelled row at all every
document is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import common

SAMPLE_DOCS, DOC_CHARS, SAMPLE_CHARS = 300, 1500, 60_000
#: Symbols that are parsed in one go, side by side with others; changes the time and nothing else.
STRETCH = 1024
UND = "und"


def letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


class Automaton:
    """Suffix automaton of a sequence of symbols 0..width-1; next states by (state, symbol), 0 if there is none.

    The transitions (at most three a symbol of the sequence) lie in one array, each state's row laid over the gaps of
    others: the one of state x and symbol s is at base[x] + s if owner has x there.
    """

    def __init__(self, symbols: list[int], width: int):
        self.size, self.width = len(symbols), width
        table, link, length, last = [{}], [-1], [0], 0
        for s in symbols:
            here = len(table)
            table.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and s not in table[p]:
                table[p][s] = here
                p = link[p]
            if p != -1:
                q = table[p][s]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    clone = len(table)
                    table.append(dict(table[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and table[p].get(s) == q:
                        table[p][s] = clone
                        p = link[p]
                    link[q] = link[here] = clone
            last = here
        self._lay(table)

    def _lay(self, table: list[dict[int, int]]) -> None:
        """Rows with most transitions first, each at the first place where all of its own are free."""
        cells = sum(map(len, table)) + 2 * self.width
        taken = bytearray(cells)
        base, owner, to = np.zeros(len(table), np.int32), np.full(cells, -1, np.int32), np.zeros(cells, np.int32)
        # the search goes on from where the last row of as many transitions found its place
        start, wide = self.width, 0
        for x in sorted((x for x, row in enumerate(table) if row), key=lambda x: -len(table[x])):
            row = table[x]
            if len(row) != wide:
                start, wide = self.width, len(row)
            first, *rest = sorted(row)
            at = start
            while True:
                at = taken.find(0, at)
                if at < 0 or at - first + self.width > len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    owner, to = np.append(owner, np.full(more, -1, np.int32)), np.append(to, np.zeros(more, np.int32))
                    at = max(at, start)
                    continue
                if not any(taken[at - first + s] for s in rest):
                    break
                at += 1
            start = at
            base[x] = at - first
            for s, y in row.items():
                k = at - first + s
                taken[k], owner[k], to[k] = 1, x, y
        end = int(base.max()) + self.width
        self.base, self.owner, self.to = base, owner[:end].copy(), to[:end].copy()


class Parser:
    """Several automata over the same symbols in one set of arrays, so that all of them parse side by side."""

    def __init__(self, automata: list[Automaton], width: int):
        states = np.cumsum([0, *(len(a.base) for a in automata)]).astype(np.int32)
        cells = np.cumsum([0, *(len(a.owner) for a in automata)]).astype(np.int32)
        self.n, self.width, self.roots = len(automata), width, states[:-1]
        self.base = np.concatenate([a.base + c for a, c in zip(automata, cells, strict=False)])
        self.owner = np.concatenate([np.where(a.owner >= 0, a.owner + x, -1) for a, x in zip(automata, states, strict=False)])
        self.to = np.concatenate([a.to + x for a, x in zip(automata, states, strict=False)])
        k = self.base[self.roots][:, None] + np.arange(width, dtype=np.int32)
        self.first = np.where(self.owner[k] == self.roots[:, None], self.to[k], self.roots[:, None]).ravel()

    def _next(self, state: np.ndarray, s: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after symbols s, and whether a phrase starts with them."""
        k = self.base[state]
        k += s
        starts = self.owner[k] != state
        to = self.to[k]
        miss = np.flatnonzero(starts)
        to[miss] = self.first[which[miss] * np.int32(self.width) + s[miss]]
        starts |= state == self.roots[which]  # also after a symbol that never occurs, which is a phrase of its own
        return to, starts

    def phrases(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of longest-match phrases of sequences, each length[k] symbols from begin[k] on, a row for each automaton.

        Stretches of the sequences are parsed side by side, each as if a phrase started with it. Then what goes on from
        the stretch before is parsed until a phrase of it starts where one of the stretch's own does; from there on both
        are the same. A stretch in which that never happens ends in another state, and the next one is taken again.
        """
        k = -(-length // STRETCH)
        of = np.repeat(np.arange(len(length)), k)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        size = np.minimum(length[of] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        at = (begin[of] + nth * STRETCH)[order]
        which = np.tile(np.arange(self.n, dtype=np.int32), len(of))
        state, starts = self.roots[which], np.zeros((int(size.max(initial=0)), len(which)), bool)
        for j, n in enumerate(np.searchsorted(-size[order], -np.arange(len(starts)), side="left").tolist()):
            m = n * self.n
            state[:m], starts[j, :m] = self._next(state[:m], np.repeat(symbols[at[:n] + j], self.n), which[:m])
        upto = np.cumsum(starts, axis=0, dtype=np.int16)
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        column = (place[:, None] * self.n + np.arange(self.n)).ravel()  # of a stretch and automaton, by stretch
        end, size, at = state[column], np.repeat(size, self.n), np.repeat(at[place], self.n)
        total = upto[-1][column].astype(np.int64) if len(of) else np.zeros(0, np.int64)
        count, again, later = total.copy(), np.flatnonzero(np.repeat(nth > 0, self.n)), np.repeat(nth > 0, self.n)
        while len(again):
            state, own, active, moved = end[again - self.n], np.zeros(len(again), np.int64), np.arange(len(again)), []
            for j in range(STRETCH):
                over = size[again[active]] == j
                if over.any():
                    moved.append(active[over])
                    active = active[~over]
                if not len(active):
                    break
                here = again[active]
                state[active], fresh = self._next(state[active], symbols[at[here] + j], which[here])
                own[active] += fresh
                met = fresh & starts[j, column[here]]
                done = here[met]
                count[done] = own[active[met]] + total[done] - upto[j, column[done]]
                active = active[~met]
            moved.append(active)
            left = np.concatenate(moved)
            count[again[left]] = own[left]
            differs = left[end[again[left]] != state[left]]
            end[again[left]] = state[left]
            again = np.sort(again[differs]) + self.n
            again = again[again < len(later)]
            again = again[later[again]]
        return np.stack([np.bincount(of, count[j :: self.n], minlength=len(length)) for j in range(self.n)]).astype(np.int64)


class Model:
    """Automata of labelled texts by language. It is made once and sent to the tasks, a few megabytes a language."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letter = letters()
        known = sorted({c for t in samples.values() for c in np.unique(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)).tolist() if letter[c]})
        self.width = len(known) + 2
        kind = np.uint16 if self.width < 1 << 16 else np.uint32
        self.symbol = np.where(letter, len(known) + 1, 0).astype(kind)  # 0: any run of other characters; the last: letters never learned
        self.symbol[known] = np.arange(1, len(known) + 1)
        made = [Automaton(self.symbols(samples[k])[0].tolist(), self.width) for k in self.langs]
        self.bits = np.array([math.log2(max(2, a.size)) for a in made])
        self.parser = Parser(made, self.width) if made else None

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text with one separator for each run of other characters, and whether it has a letter."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s > 0
        keep[1:] |= keep[:-1]
        return s[keep], bool(s.any())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and normalised phrases (bits a letter of the best language) for each text."""
        parsed = [self.symbols(t) for t in texts]
        n = np.array([len(s) for s, _ in parsed], np.int64)
        if not self.langs or not n.sum():
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        every, begin = np.concatenate([s for s, _ in parsed]), np.cumsum(n) - n
        cost = self.parser.phrases(every, begin, n).T * self.bits / np.maximum(n, 1)[:, None]
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(texts)), best]
        rest = cost.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1)
        score = np.where(np.isfinite(second) & (second > 0), 1 - least / np.where(second > 0, second, 1), 1.0 if len(self.langs) == 1 else 0.0)
        has = np.array([h for _, h in parsed])
        return [self.langs[b] if h else UND for b, h in zip(best.tolist(), has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0), np.where(has, least, 0.0)


def held_out(n: int, r: int) -> Column:
    """Whether crc32 of doc_id as text leaves remainder r when divided by n (a null id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == r, F.lit(False))


def samples(docs: DataFrame, learn: Column, size: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text by language from the rows of docs for which learn holds; bounded by the number of languages."""
    rows = docs.filter(learn & F.col("lang").isNotNull())
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).cast("double") / (1 << 30)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * SAMPLE_DOCS / n))])
    some = rows.filter(F.col("text").isNotNull() & (place <= share[F.col("lang")]))
    first = Window.partitionBy("lang").orderBy("place", "text")
    some = some.select("lang", place.alias("place"), F.substring("text", 1, DOC_CHARS).alias("text")).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "nth").collect():  # at most SAMPLE_DOCS short rows a language
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v)[:size] for k, v in texts.items()}


def predict(docs: DataFrame, learned: dict[str, str], *keep: str) -> DataFrame:
    """doc_id, the columns named in keep, lang_pred, score and bits (per letter, of the best language) for each row."""
    rows = common.text_only(docs, *keep)
    names = ["doc_id", *keep, "lang_pred", "score", "bits"]

    m = Model(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, step=4 * common.STEP_BYTES):
            lang, score, bits = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names)

    schema = T.StructType([rows.schema[c] for c in ("doc_id", *keep)]).add("lang_pred", "string").add("score", "double").add("bits", "double")
    return rows.mapInArrow(run, schema)
