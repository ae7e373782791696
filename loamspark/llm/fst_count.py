"""Token counts by a compiled finite-state transducer.

A BPE tokenization is right if and only if every two neighbouring tokens are what the two alone, joined,
would be split into; so the last token of each prefix follows from the text's last characters and the
last tokens of the prefixes before them.  A state is the longest suffix that begins some piece, with the
last tokens of the prefixes within that suffix.  Both are bounded by the longest piece: the machine is
finite.  Each transition is annotated with the number of tokens by which the prefix's count changes.
States and transitions are compiled when first met, as most never are.

Texts are cut at fixed sizes, inside words too.  A piece's map leads from its entry states to (exit state,
count).  Maps compose by an associative rule, in pairs of pairs as in a prefix scan, so pieces are worked on
independently of each other.  The entry states for which a piece's map is made up front are those that can
be told from the text just before it; should composing ask for another, it is added then.

No vocabulary piece has a space mark after another character, nor a character outside all pieces.  Before the
first, and around the second, the machine is back in its start state, whatever came before.  From the first
such place in a piece on, its map is constant: what lies between two of them is a word with a remembered count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

MARK = "▁"
#: Words' counts, transducer states, and pairs of tokens that a Python worker holds; when full it starts anew.
WORDS, STATES, PAIRS = 1 << 20, 1 << 19, 1 << 20
#: Characters in a piece of a text, and before a piece from which its entry state is told.
PIECE, BEFORE = 1 << 12, 64


class Model:
    """Pieces and their order of merging, and the normaliser's settings, as the library gives them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.score = {p.id_to_piece(i): p.get_score(i) for i in normal}
        if any(MARK in x.lstrip(MARK) for x in self.score):
            raise ValueError("a piece goes on after a word's end; words don't begin anew at spaces")
        self.chars = {c for x in self.score for c in x}
        # Three probes tell whether texts are taken as they are, but for spaces and a first one.
        plain = [p.encode(x, out_type=str) for x in ("a", "  a ", "①")]
        if "".join(plain[0]) != MARK + "a" or "".join(plain[1]) != MARK * 3 + "a" + MARK or "<0xE2>" not in plain[2]:
            raise ValueError("only models that add one leading space, keep spaces, fall back to bytes and change nothing else are compiled")

    def split(self, symbols: list[str]) -> list[str]:
        """Merging by score, from the left among equals, until no neighbours join to a piece."""
        symbols = list(symbols)
        while True:
            best = None
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return symbols
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


class Transducer:
    """States are numbers; ``step`` has (state, character) -> (state, change of the count)."""

    def __init__(self, model: Model) -> None:
        self.model = model
        prefixes = {x[:k] for x in model.score for k in range(1, len(x) + 1)}
        self.prefixes = prefixes
        self.tokens = {x for x in model.score if len(x) == 1 or model.split(list(x)) == [x]}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.first = ("", ("",), (0,))
        self.reset()

    def reset(self) -> None:
        self.pairs.clear()
        self.state_of: dict[tuple, int] = {}
        self.key_of: list[tuple] = []
        self.step: dict[tuple[int, str], tuple[int, int]] = {}
        self.start = self.number(self.first)

    def number(self, key: tuple) -> int:
        if key not in self.state_of:
            self.state_of[key] = len(self.key_of)
            self.key_of.append(key)
        return self.state_of[key]

    def fits(self, left: str, right: str) -> bool:
        if not left:
            return True
        got = self.pairs.get((left, right))
        if got is None:
            got = self.pairs[left, right] = self.model.split([*left, *right]) == [left, right]
        return got

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """A state: suffix s; last tokens of the len(s) + 1 prefixes that end within or before it; their counts less that of the last."""
        s, last, count = self.key_of[state]
        if c not in self.model.chars:
            return self.start, len(c.encode())
        text = s + c
        lasts, counts = [*last], [*count]
        for size in range(len(text), 0, -1):
            token = text[-size:]
            if (size == 1 or token in self.tokens) and self.fits(lasts[-size], token):
                break
        else:
            raise AssertionError("no token fits")
        delta = counts[-size] + (1 if token in self.model.score else len(token.encode()))
        lasts.append(token)
        counts.append(delta)
        keep = next((k for k in range(len(text), 0, -1) if text[-k:] in self.prefixes), 0)
        if keep == 0:
            return self.start, delta
        if text[-keep:] == MARK:
            lasts[-2] = ""  # nothing joins across a word's start
        key = (text[-keep:], tuple(lasts[-keep - 1 :]), tuple(x - delta for x in counts[-keep - 1 :]))
        return self.number(key), delta

    def run(self, text: str, key: tuple) -> tuple[tuple, int]:
        """The state's key after the text, and by how much the count changes.  Keys outlive a reset."""
        if len(self.key_of) > STATES or len(self.pairs) > PAIRS:
            self.reset()
        step, total, state = self.step, 0, self.number(key)
        for c in text:
            at = step.get((state, c))
            if at is None:
                at = step[state, c] = self.compile(state, c)
            state = at[0]
            total += at[1]
        return self.key_of[state], total


class Map(dict):
    """From entry state to (exit state, count); ``f`` gives it for an entry state met for the first time."""

    def __init__(self, f) -> None:
        self.f = f

    def __missing__(self, entry: tuple) -> tuple[tuple, int]:
        self[entry] = out = self.f(entry)
        return out


def composed(first: Map, second: Map) -> Map:
    """What is known of the first, followed by the second; more when it is asked for."""

    def f(entry: tuple) -> tuple[tuple, int]:
        between, n = first[entry]
        end, m = second[between]
        return end, n + m

    out = Map(f)
    for entry in [*first]:
        out[entry]
    return out


def scanned(maps: list[Map]) -> Map:
    """All maps composed, in pairs, level by level."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else []
        maps = [composed(x, y) for x, y in zip(maps[::2], maps[1::2])] + odd
    return maps[0]


class Counter(dict):
    """From a word, with the spaces before it, to the number by which it changes the count."""

    def __init__(self, path: str, piece: int = PIECE) -> None:
        self.machine, self.piece = Transducer(Model(path)), piece
        self.find = re.compile(r" +[^ \n]*|[^ \n]+|\n+").findall
        self.anew = re.compile(r"(?<=[^ ]) |(?<=\n)")

    def run(self, text: str, key: tuple) -> tuple[tuple, int]:
        return self.machine.run(text.replace(" ", MARK), key)

    def __missing__(self, word: str) -> int:
        n = self.run(word, self.machine.first)[1]
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def map_of(self, text: str, at: int) -> tuple[Map, bool]:
        """The map of the piece that begins at ``at``, and whether it is constant."""
        part, m = text[at : at + self.piece], self.machine
        anew = self.anew.search(part)
        start = 0 if not at else anew.start() if anew else len(part)
        head, words = part[:start], self.find(part[start:])
        if not words:
            return Map(lambda entry: self.run(part, entry)), False
        # The last word may go on in the next piece.
        end, n = self.run(words.pop(), m.first)
        n += sum(map(self.__getitem__, words))
        return Map(lambda entry: (end, n + self.run(head, entry)[1])), True

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        first = self.machine.first
        if len(text) <= self.piece:
            return sum(map(self.__getitem__, self.find(text)))
        maps, entry = [], first
        for at in range(0, len(text), self.piece):
            made, constant = self.map_of(text, at)
            end, _ = made[entry]
            maps.append(made)
            if not constant:
                end, _ = self.run(text[max(0, at + self.piece - BEFORE) : at + self.piece], first)
            entry = end
        return scanned(maps)[first][1]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def fst_token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per row.  ``path``: a sentencepiece BPE model, on every executor.

    Null and empty texts have no bytes and no tokens.  Rows are counted alone: repeats and null ids
    come out as they are.  Texts of any length, words of any length count whole.  Other columns are left
    out, whatever their names.  Empty in, empty out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, 1):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = np.array([c.count(x) for x in texts], np.int64)
            size = np.array([len(x.encode()) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
