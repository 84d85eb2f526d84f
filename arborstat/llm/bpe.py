"""BPE encoding and decoding by a prefix-sharing walk over the trie of distinct words.

A byte-level BPE encoding has a useful property: the last token of every prefix of a
word is settled by the prefix alone, and dropping that token leaves the encoding of a
shorter prefix. So one state per trie node, the last token, holds the encodings of all
words below. The distinct words of a slice of documents are put in byte order, which is
the trie in depth-first order; the walk keeps the states of the current path only, and
every prefix that neighbouring words share is worked out once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from arborstat.llm.common import gives_back, in_groups, refuse_clash, schema_of, whole_text, with_columns

#: Words as the byte-level pre-tokenizer cuts them (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between two other characters always starts a word, whatever stands around it.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces, words and pairs of tokens that a task remembers between slices, at most.
KEPT_PIECES = 400_000
KEPT_WORDS = 400_000
KEPT_PAIRS = 250_000
#: Characters of the texts that are encoded together, about.
GROUP = 1_000_000
#: Longest stretch of one text, in characters, whose pieces are held at once.
STRETCH = 1_000_000
FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the rest from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def oldest(memo: dict) -> dict:
    """The quarter of a full memo that was met first: frequent words are among it."""
    return dict(islice(memo.items(), len(memo) // 4))


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes that each id of a vocabulary file stands for."""
    letters = byte_letters()
    of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
    return of | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file, with the walk that encodes words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = token_bytes(spec)
        self.rank: dict[tuple[int, int], int] = {}
        self.born, self.left, self.right = ([0] * (max(self.bytes_of) + 1) for _ in range(3))
        vocab = model["vocab"]
        for i in self.bytes_of:
            self.born[i] = -1
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = rank
            if self.born[whole] < 0:
                self.born[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        made = {i for i in vocab.values() if i in self.bytes_of and (self.born[i] >= 0 or len(self.bytes_of[i]) == 1)}
        self.id_of = {self.bytes_of[i]: i for i in made if i not in self.special.values()}
        self.step, self.token_at = {}, [None]
        for token, i in self.id_of.items():
            self._add(token, i)
        self.apart_memo: dict[int, bool] = {}
        self.word = regex.compile(WORD)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = by_id(self.bytes_of)
        self.four = [i.to_bytes(4, "little") for i in range(len(self.born))]
        self.inner: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.kept_pieces, self.kept_words = KEPT_PIECES, KEPT_WORDS

    def _add(self, token: bytes, i: int) -> None:
        """Put a token into the automaton of vocabulary prefixes; ``step[state << 8 | byte]`` is the next state."""
        state = 0
        for byte in token:
            at = state << 8 | byte
            if at not in self.step:
                self.step[at] = len(self.token_at)
                self.token_at.append(None)
            state = self.step[at]
        self.token_at[state] = i

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` can stand side by side: no merge across their border comes first.

        Goes back in time over the parts at the border. ``until``: a merge of the present
        two parts would win if its rank is below. Of equal ranks the left pair merges first.
        """
        x, y, until, born, good = a, b, FOREVER, self.born, True
        while True:
            if self.rank.get((x, y), FOREVER) < until:
                good = False
                break
            if born[x] < 0 and born[y] < 0:
                break
            if born[y] >= born[x]:
                until, y = born[y] + 1, self.left[y]
            else:
                until, x = born[x], self.right[x]
        if len(self.apart_memo) > KEPT_PAIRS:
            self.apart_memo.clear()
        self.apart_memo[a << 32 | b] = good
        return good

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each of the sorted ``words``."""
        step, token_at, known, apart, four = self.step.get, self.token_at, self.apart_memo, self.apart, self.four
        # The path's nodes, by depth: last token, where it starts, and (start, vocabulary prefix) of what may yet grow into a token.
        last, begins, growing = [0], [0], [[]]
        out, before = [], b""
        for w in words:
            shared = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :], growing[shared + 1 :]
            for end in range(shared, len(w)):
                byte, grown, token = w[end], [], None
                for start, state in growing[end]:
                    state = step(state << 8 | byte)
                    if state is not None:
                        grown.append((start, state))
                        if token is None and (t := token_at[state]) is not None:
                            if start:
                                fits = known.get(last[start] << 32 | t)
                                if not (apart(last[start], t) if fits is None else fits):
                                    continue
                            token, at = t, start
                state = step(byte)
                grown.append((end, state))
                if token is None:
                    token, at = token_at[state], end
                last.append(token)
                begins.append(at)
                growing.append(grown)
            got, n = [], len(w)
            while n:
                got.append(four[last[n]])
                n = begins[n]
            got.reverse()
            out.append(b"".join(got))
            before = w
        return out

    def stretches(self, text: str) -> Iterator[str]:
        """``text`` in stretches of about STRETCH characters, cut where a word starts for certain."""
        at = 0
        while len(text) - at > STRETCH:
            found = SAFE.search(text, at + STRETCH)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of texts without special tokens: their new distinct words in one walk."""
        if len(self.words) > self.kept_words:
            self.words = oldest(self.words)
        cut = {p: [p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else self.word.findall(p) for p in pieces}
        of = self.words
        words = sorted({w.encode(): w for ws in cut.values() for w in ws if w not in of}.items())
        of.update(zip([w for _, w in words], self.encode_words([b for b, _ in words])))
        return {p: of[ws[0]] if len(ws) == 1 else b"".join([of[w] for w in ws]) for p, ws in cut.items()}

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that are held at once, their distinct pieces between single spaces encoded once.

        A piece that has white space at an end is odd: the space before or after it does
        not start a word for certain. A text with an odd piece is cut more carefully.
        """
        if len(self.inner) > self.kept_pieces:
            self.inner = oldest(self.inner)
        inner, cut, distinct = self.inner, [t.split(" ") for t in texts], set()
        for c in cut:
            distinct.update(c[1:-1])
        new = [p for p in distinct if p not in inner]
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        ends = {c[0] for c in cut if c[0]} | {" " + c[-1] for c in cut if len(c) > 1}
        got = self.encode_pieces({*ends, *(" " + p for p in new if p not in odd)})
        inner.update((p, None if p in odd else got[" " + p]) for p in new)
        got[""] = b""
        out = []
        for t, c in zip(texts, cut):
            plain = not (self.at_special and self.at_special.search(t)) and (len(c) < 2 or c[-1] and not c[-1][0].isspace() and c[0] and not c[0][-1].isspace())
            try:
                out.append(b"".join([got[c[0]], *map(inner.__getitem__, c[1:-1]), *([got[" " + c[-1]]] if len(c) > 1 else [])]) if plain else None)
            except TypeError:
                out.append(None)
        for i, x in enumerate(out):
            if x is None:
                out[i] = self.encode_careful(texts[i])
        return out

    def encode_careful(self, text: str) -> bytes:
        """One text with special tokens or uncommon white space."""
        parts = self.at_special.split(text) if self.at_special else [text]
        cut = [(k % 2, p) for k, part in enumerate(parts) for p in ([part] if k % 2 else ((" " if j else "") + p for j, p in enumerate(SAFE.split(part)) if p or j))]
        of = self.encode_pieces({p for special, p in cut if not special})
        return b"".join([self.four[self.special[p]] if special else of[p] for special, p in cut])

    def forget(self) -> None:
        """Free what was remembered of a task's texts; workers outlive their tasks."""
        self.inner, self.words, self.apart_memo = {}, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit integers) of each text."""
        if any(len(t) > STRETCH for t in texts):
            return [b"".join([self.encode_group([s])[0] for s in self.stretches(t)]) for t in texts]
        return self.encode_group(texts)


def by_id(of: dict[int, bytes]) -> list[bytes]:
    """Bytes by id; ids without any have none, and so does the last entry, which stands for all beyond."""
    return [of.get(i, b"") for i in range(max(of) + 2)]


def decode_ids(packed: bytes, table: list[bytes]) -> str:
    ids = np.minimum(np.frombuffer(packed, "<u4"), len(table) - 1).tolist()
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(2)
def loaded_bytes(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        return by_id(token_bytes(json.load(f)))


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False, remembered: int | None = None) -> DataFrame:
    """``keep`` columns with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers) of each row's whole text.

    With ``decoded`` also a column of that name: the text that the ids stand for, as
    :func:`decode` gives it, in the same pass.

    ``remembered``: pieces, and words, whose ids a task keeps, about (KEPT_PIECES and
    KEPT_WORDS if not given); fewer take less memory and more time, the ids are the same.

    ``path`` names a tokenizer file that every executor has. Special tokens written in a
    text become their ids; none are added. A null text counts as empty (no ids), repeated
    rows are encoded alike, an empty table gives an empty one. Columns named like the
    outputs cannot be kept (ValueError). Rows stay where they are: nothing is shuffled.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    refuse_clash(keep, ["n_tokens", "ids", *["decoded"] * decoded])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        bpe.kept_pieces, bpe.kept_words = (KEPT_PIECES, KEPT_WORDS) if remembered is None else (remembered, remembered)
        for b in in_groups(batches, "__text", GROUP):
            ids = bpe.encode(b.column("__text").to_pylist())
            new = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                new["decoded"] = pa.array([decode_ids(x, bpe.table) for x in ids], pa.string())
            yield with_columns(b, keep, new)
        bpe.forget()

    given = docs.select(*keep, whole_text(text).alias("__text"))
    return given.mapInArrow(gives_back(run), schema_of(docs, keep, "n_tokens bigint, ids binary" + ", decoded string" * decoded))


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with decoded (string): the text of packed ``ids``, special tokens included; broken bytes become U+FFFD, null ids an empty text."""
    keep = [c for c in encoded.columns if c != ids] if keep is None else keep

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = loaded_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                yield with_columns(b, keep, {"decoded": pa.array([decode_ids(x or b"", of) for x in b.column("__ids").to_pylist()], pa.string())})

    given = encoded.select(*keep, F.col(ids).alias("__ids"))
    return given.mapInArrow(run, schema_of(encoded, keep, "decoded string"))
