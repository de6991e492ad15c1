"""BPE encoding and decoding by a transducer with bounded lookahead.

The merges are applied in rank order, so what a symbol far to the right can change on the left is
bounded: a merge moves the border between "same" and "different" left by the length of its left
part, and only a later merge whose right part starts with that left part can move it again. The
longest such chain over the merge list is the sufficient lookahead; tokens that end before it are
stable and are emitted, and the transducer keeps one window of constant size. A text is read in
pieces that end at white space, and ordinary words are looked up in a bounded table of words seen.

Decoding feeds token bytes to an incremental UTF-8 machine, so that a character split over tokens
comes out whole and memory stays constant.

Defined cases: a null or empty text has no tokens and decodes to the empty text; strings of the
special tokens in a text become those tokens, as in the tokenizers library; repeated rows and equal
texts give equal results; an empty table gives an empty result; further columns are ignored unless
they are named as keys.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .base import map_texts

#: Symbols emitted per window of a long word, words kept in the table, characters read at a time.
WINDOW, WORDS_KEPT, PIECE = 4096, 150_000, 1 << 16
# Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

# What a vocabulary file asks for before and after the merges, as far as it is done here (fixed values).
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}


def byte_symbols() -> dict[int, str]:
    """Each byte's printable stand-in: visible Latin-1 characters stand for themselves, the others
    follow from code point 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """Symbols to the right of a token's end that suffice to know the token is final."""
    deepest: dict[str, int] = {}
    bound = 1
    for left, right in merges:
        plain = right.removesuffix(suffix) if suffix else right
        chained = max((deepest.get(plain[:k], 0) for k in range(1, len(plain) + 1)), default=0)
        reach = len(left) + chained
        if reach > deepest.get(left, 0):
            deepest[left] = reach
        bound = max(bound, reach + len(plain))
    return bound


class Transducer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        for part, known in KNOWN.items():
            if spec.get(part) != known:
                raise ValueError(f"{path}: this transducer does not do its {part}")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.lookahead = lookahead(merges, self.suffix)
        self.symbol = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: t for t, i in (self.ids | self.special).items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word_at = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
        self.space_at = regex.compile(f"[{WHITE}]")
        self.decimal = {t: str(i) for t, i in self.ids.items()}
        self.words: dict[str, tuple[int, bytes, str]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges of one window, lowest rank first and leftmost first among equals."""
        ranks = self.ranks
        if len(symbols) < 64:
            out, none = symbols, len(ranks)
            order = [ranks.get(pair, none) for pair in zip(out, out[1:], strict=False)]
            while order and (rank := min(order)) < none:
                i = order.index(rank)
                out[i : i + 2] = [out[i] + out[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get((out[i - 1], out[i]), none)
                if i < len(order):
                    order[i] = ranks.get((out[i], out[i + 1]), none)
            return out
        part: list[str | None] = list(symbols)
        after, before = [*range(1, len(part)), -1], [-1, *range(len(part) - 1)]
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, (part[a], part[b])))
        return [p for p in part if p is not None]

    def tokens(self, word: str) -> Iterator[str]:
        """Tokens of one word as they become stable."""
        data = word.encode()
        symbol, at, end = self.symbol, 0, len(data)
        while at < end:
            stop = min(end, at + WINDOW + self.lookahead)
            window = [symbol[b] for b in data[at:stop]]
            if stop == end:
                window[-1] += self.suffix
            stable = end if stop == end else stop - self.lookahead
            for token in self.merged(window):
                width = len(token) - (len(self.suffix) if token.endswith(self.suffix) and at + len(token) > end else 0)
                if at + width > stable:
                    break
                yield token
                at += width

    def word(self, word: str) -> tuple[int, bytes, str]:
        """(number of ids, the ids in decimal, surface) of a word."""
        found = self.words.get(word)
        if found is None:
            if len(word) < 64 and word.isascii() and word.isprintable():  # such symbols stand for themselves
                symbols = list(word)
                symbols[-1] += self.suffix
                made = self.merged(symbols)
            else:
                made = list(self.tokens(word))
            found = len(made), " ".join([self.decimal[t] for t in made]).encode(), " ".join(made)
            if len(word) <= 64:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that end at white space, where no word and no composed character goes on."""
        at, end = 0, len(text)
        while at < end:
            stop = at + PIECE
            if stop < end:
                space = self.space_at.search(text, stop)
                stop = space.end() if space else end
            yield text[at:stop]
            at = stop

    def normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        # Each character is lowered on its own: sigma has no final form.
        return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def encoded(self, text: str) -> Iterator[list[tuple[int, bytes, str]]]:
        """Lists of (number of ids, decimal ids, surface), an entry for each word or special token."""
        parts = self.special_at.split(text) if self.special_at and "<|" in text else (text,)
        for part in parts:
            if part in self.special:
                yield [(1, str(self.special[part]).encode(), part)]
            else:
                for piece in self.pieces(part):
                    words, seen = self.word_at.findall(self.normal(piece)), self.words
                    yield [seen.get(w) or self.word(w) for w in words]

    def encode(self, text: str) -> list[int]:
        return [int(i) for found in self.encoded(text) for _, ids, _ in found for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's text of these ids: token surfaces, one space between two."""
        return "".join(incremental_text(self.surface_bytes(ids)))

    def surface_bytes(self, ids: Iterable[int]) -> Iterator[bytes]:
        gap = b""
        for i in ids:
            yield gap + self.surface[i].encode()
            gap = b" "

    def plain_text(self, ids: Iterable[int]) -> str:
        """The words behind the ids: bytes of the symbols, a space at a word's end."""
        byte_of = {s: b for b, s in self.symbol.items()}

        def data() -> Iterator[bytes]:
            for i in ids:
                token = self.surface[i]
                if token in self.special:
                    yield token.encode()
                    continue
                body = token.removesuffix(self.suffix) if self.suffix else token
                yield bytes(byte_of[c] for c in body) + (b" " if len(body) < len(token) else b"")

        return "".join(incremental_text(data()))


def incremental_text(chunks: Iterable[bytes]) -> Iterator[str]:
    """Text of a byte stream; incomplete characters wait for their other bytes."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield machine.decode(chunk)
    yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One per worker process and vocabulary file."""
    return Transducer(path)


def digests(machine: Transducer, text: str, ids: list[int] | None = None) -> tuple[int, str, str]:
    """(n_tokens, ids_sha256, decoded_sha256), fed as the stream goes on; the ids are added to a list
    where one is given."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    gap = ""
    for found in machine.encoded(text):
        if found:
            counts, numbers, surfaces = zip(*found, strict=True)
            n += sum(counts)
            joined = b" ".join(numbers)
            ids_hash.update(gap.encode() + joined)
            text_hash.update(decoder.decode((gap + " ".join(surfaces)).encode()).encode())
            gap = " "
            if ids is not None:
                ids.extend(map(int, joined.split()))
    text_hash.update(decoder.decode(b"", True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_texts(df: DataFrame, vocabulary: str, keys: list[str], column: str = "text") -> DataFrame:
    """Per row: keys, the ids, their count and the digests."""

    def one(text: str) -> tuple:
        ids: list[int] = []
        found = digests(transducer(vocabulary), text, ids)
        return ids, *found

    return map_texts(df, keys, column, one, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_digests(df: DataFrame, vocabulary: str, keys: list[str], column: str = "text") -> DataFrame:
    return map_texts(df, keys, column, lambda t: digests(transducer(vocabulary), t), "n_tokens long, ids_sha256 string, decoded_sha256 string")
