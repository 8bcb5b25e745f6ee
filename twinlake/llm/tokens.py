"""Exact tokenisation with tables of the words already seen.

The word-level vocabulary drops white space and never merges across it, so the ids of a text are the ids of its
white-space separated chunks, one after the other. Each Python worker keeps a bounded table chunk -> ids, kept
from task to task; only chunks that are not in it are encoded, many in one call.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

#: Entries that a worker's table holds before it starts afresh.
TABLE_LIMIT = 500_000
#: Longer chunks are encoded but not kept.
KEEP_CHARS = 64
_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: The vocabulary file's pattern for Latin text: contractions, letters, one digit, other signs.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Latin text: its lower case is the library's, and normal form C leaves it as it is.
_LATIN = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-įı-ž]*")
_END = "\x01"
#: Stands for the end of a word where any character may be in it: no UTF-8 has this byte.
_MARK = b"\xff"


def load(path: str):
    """The tokenizer in a .json file, single-threaded: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordBpe:
    """Ids of many chunks at once.

    Latin chunks are split by the file's pattern and merged by tiktoken, which ranks joined bytes: byte 1 (in no
    Latin chunk) stands for the end of a word. Both libraries merge the pair of lowest rank first, so they agree
    as long as each token's bytes merge into that token; tokens for which that fails can never arise and are
    left out of the ranks. All other chunks go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.library = load(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        ranks: dict[bytes, int] = {}
        self.marked: dict[bytes, int] = {}  # the same with byte 255 as the end of a word
        self.ends = np.zeros(len(vocab) + 2, bool)
        for token, n in vocab.items():
            if _SPECIAL.fullmatch(token) or not self._arises(token, end, rank):
                continue
            body = token.removesuffix(end)
            self.ends[n] = body != token
            raw = bytes(byte_of[c] for c in body)
            ranks[raw + _END.encode() * (body != token)] = n
            self.marked[raw + _MARK * (body != token)] = n
        if b"\x01" in ranks:  # byte 1 is in no Latin chunk; its place is taken by the end of a word
            ranks = {k: v for k, v in ranks.items() if k == b"\x01" or k.find(b"\x01", 0, -1) < 0}
        self.ranks, self.fits, self.known = ranks, {}, 0
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self._tokens_of = None

    @staticmethod
    def _arises(token: str, end: str, rank: dict) -> bool:
        """Whether the token's own bytes merge into it."""
        body = token.removesuffix(end)
        parts = [*body]
        if body != token:
            parts[-1] += end
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in rank:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return True

    def _latin(self, chunks: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
        """The Latin chunks, their ids one after the other, and where each one's ids end."""
        latin = [c for c in chunks if _LATIN.fullmatch(c) and "<|" not in c]
        if not latin:
            return [], np.zeros(0, np.uint32), []
        pieces = [[c.lower()] if c.isalpha() else _PIECES.findall(c.lower()) for c in latin]
        flat = np.array(self.encoding.encode_ordinary("".join([p + _END for x in pieces for p in x])), np.uint32)
        return latin, flat, (np.flatnonzero(self.ends[flat])[np.cumsum([*map(len, pieces)]) - 1] + 1).tolist()

    def many(self, chunks: list[str]) -> list[bytes]:
        """For each chunk its ids as little-endian unsigned 32-bit bytes."""
        latin, flat, stops = self._latin(chunks)
        raw, at, found = flat.astype("<u4").tobytes(), 0, {}
        for c, stop in zip(latin, stops):
            found[c] = raw[4 * at : 4 * stop]
            at = stop
        if len(found) < len(chunks):
            rest = [c for c in chunks if c not in found]
            found.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(rest, self.library.encode_batch(rest, add_special_tokens=False)))
        return [*map(found.__getitem__, chunks)]

    def counts(self, chunks: list[str]) -> list[int]:
        """For each chunk its number of ids."""
        latin, _, stops = self._latin(chunks)
        found = dict(zip(latin, map(int.__sub__, stops, [0, *stops])))
        if len(found) < len(chunks):
            rest = [c for c in chunks if c not in found]
            found.update(zip(rest, map(len, self.library.encode_batch(rest, add_special_tokens=False))))
        return [*map(found.__getitem__, chunks)]


    def behind(self, first: bytes) -> dict[bytes, bool]:
        """What is known of the tokens that may follow a token."""
        if self.known > 1_000_000:
            self.known = 0
            for some in self.fits.values():
                some.clear()
        return self.fits.setdefault(first, {})

    def compatible(self, first: bytes, second: bytes, behind: dict[bytes, bool]) -> bool:
        """Whether two tokens of `marked` stay side by side when their bytes are merged; kept in `behind`, that of the first."""
        if self._tokens_of is None:
            import tiktoken

            self._tokens_of = tiktoken.Encoding("prefixes", pat_str="(?s:.+)", mergeable_ranks=self.marked, special_tokens={})._core_bpe.encode_single_piece
        self.known += 1
        fit = behind[second] = self._tokens_of(first + second) == [self.marked[first], self.marked[second]]
        return fit


def blanks(text: str) -> str:
    """The text with a space for each ASCII white space; other white space stays, the library handles it."""
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text


def _batches(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


class _Table:
    """A bounded table chunk -> bytes and the texts made of its entries."""

    joint = b""

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        self.words, self.limit = WordBpe(path), limit
        self.table: dict[str, bytes] = {"": b""}

    def split(self, text: str) -> list[str]:
        return blanks(text).split(" ")

    def values(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def of(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in _batches(texts):
            split = [self.split(t) for t in some]
            missing = set().union(*split).difference(self.table)
            if len(self.table) + len(missing) > self.limit:
                self.table = {"": b""}
                missing = set().union(*split) - {""}
            new = dict(zip(missing, self.values([*missing]))) if missing else {}
            long = {c for c in new if len(c) > KEEP_CHARS}
            self.table.update(new)
            get = self.table.__getitem__
            out += [self.joint.join(map(get, s)) for s in split]
            for c in long:
                del self.table[c]
        return out


class ChunkIds(_Table):
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    _doubled = re.compile(r"[.,](?<=[^\w ].|_.)(?= |$)")  # looks behind, so that the search stops at points and commas only

    def split(self, text: str) -> list[str]:
        text = blanks(text)
        if _LATIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            if not self._doubled.search(text):  # a sign behind a word is a piece of its own
                text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def values(self, chunks: list[str]) -> list[bytes]:
        return self.words.many(chunks)


# The vocabulary file's contractions.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def joining() -> set[str]:
    """Characters that normal form C may join to or sort among the ones before them; a normal form can be taken apart in
    front of all others."""
    found = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}  # Hangul vowels and finals
    for c in map(chr, range(0x300, 0x110000)):
        if unicodedata.combining(c):
            found.add(c)
        elif made := unicodedata.decomposition(c):
            if unicodedata.combining(unicodedata.normalize("NFD", c)[0]):
                found.add(c)
            parts = made.split()
            if len(parts) == 2 and parts[0][0] != "<":
                found.add(chr(int(parts[1], 16)))
    return found


class Composer:
    """Normal form C of a text that grows by a character at a time: of its end, the last starter and the marks behind it.

    Marks are kept by combining class, in order of arrival; the starter takes up the first ones of a class, so a further
    mark of a class with a mark left over changes nothing but its own place.
    """

    def __init__(self) -> None:
        self.head, self.joined, self.marks, self.taken = "", "", {}, {}

    def add(self, c: str) -> tuple[int, str]:
        """One more character: how many characters of the form go at its end, and what comes instead."""
        gone, new = 0, ""
        for x in unicodedata.normalize("NFD", c):
            less, more = self._one(x)
            gone, new = (gone + less - len(new), more) if less > len(new) else (gone, new[: len(new) - less] + more)
        return gone, new

    def _left(self, above: int = -1) -> int:
        """How many marks of classes above that one stand behind the starter."""
        return sum(len(m) - self.taken[k] for k, m in self.marks.items() if k > above)

    def _one(self, x: str) -> tuple[int, str]:
        kind = unicodedata.combining(x)
        if kind == 0:
            both = unicodedata.normalize("NFC", self.joined + x) if self.head and not self.marks else ""
            if len(both) == 1:
                self.head = self.joined = both
                return 1, both
            self.head = self.joined = x
            self.marks, self.taken = {}, {}
            return 0, x
        before, place = (self.joined, dict(self.taken)), self._left(kind)
        size = len(self.joined) + self._left()
        self.marks.setdefault(kind, []).append(x)
        self.taken.setdefault(kind, 0)
        if self.head and self.taken[kind] == len(self.marks[kind]) - 1:  # else one of its class, left over, stands between
            self._compose()
        if (self.joined, self.taken) != (before[0], {**self.taken, **before[1]}):
            return size, self.joined + self._tail(-1)
        return place, x + self._tail(kind)

    def _compose(self) -> None:
        self.joined = self.head
        for kind in sorted(self.marks):
            self.taken[kind] = 0
            for x in self.marks[kind]:
                if len(both := unicodedata.normalize("NFC", self.joined + x)) != 1:
                    break
                self.joined, self.taken[kind] = both, self.taken[kind] + 1

    def _tail(self, above: int) -> str:
        return "".join("".join(self.marks[k][self.taken[k] :]) for k in sorted(self.marks) if k > above)


class PrefixScan:
    """Token counts of all prefixes of a text without ASCII blanks, by dynamic programming over its normalised bytes.

    A piece's plain encoding (no end of word yet) at a byte is the one at an earlier byte and one more token; the right
    token is the one compatible with the token before it, for tokens that are compatible in pairs are the encoding. A
    prefix's count takes one last token, with the end of a word. The step at a byte depends on a token's length of bytes
    before it. The state behind each normalised character is kept, so that a mark which changes the characters before it
    (normal form C) only takes those back: time is in proportion to the text, but for a run of marks in which those of a
    lower class keep following those of a higher one, all of which each of them moves.
    """

    def __init__(self, words: WordBpe):
        self.words, self.kinds, self.single, self.even, self.join = words, {}, {}, {}, None
        tails: dict[bool, set[bytes]] = {False: set(), True: set()}
        for token in words.marked:
            ended = token.endswith(_MARK) and len(token) > 1
            body = token[:-1] if ended else token
            tails[ended].update(body[k:] for k in range(len(body)))
        self.plain_tails, self.end_tails = tails[False], tails[True]
        self.whole = {c: words.counts([c])[0] for c in _CONTRACTIONS}

    def kind(self, c: str) -> str:
        """Letter, Number, Sign or White, as the vocabulary file's own splitter takes a character."""
        if c not in self.kinds:
            split = self.words.library.pre_tokenizer.pre_tokenize_str
            n = len(split(c + c))
            self.kinds[c] = "W" if n == 0 else "N" if n == 2 else "L" if len(split("a" + c)) == 1 else "S"
        return self.kinds[c]

    def normal(self, some: str) -> str:
        """A character of a normal form C as the library has it: in lower case."""
        if some not in self.even:
            self.even[some] = self.words.library.normalizer.normalize_str(some)
        return self.even[some]

    def _extend(self, start: int, tails: set[bytes], mark: bytes) -> tuple[bytes, int]:
        """The last token of the piece from `start` to the end, and how many tokens it has."""
        raw, last, ranks = self.raw, self.last, self.words.marked
        stop, found, n = len(raw), [], 1
        while stop - n >= start and (token := bytes(raw[stop - n :])) in tails:
            if token + mark in ranks:
                found.append(token + mark)
            n += 1
        for token in reversed(found):
            at = stop - len(token) + len(mark)
            if at == start:
                return token, 1
            if last[at - 1]:
                behind = self.words.behind(last[at - 1])
                if behind[token] if token in behind else self.words.compatible(last[at - 1], token, behind):
                    return token, self.count[at - 1] + 1
        return b"", 0

    def _push(self, c: str) -> None:
        """The state behind one more normalised character: tokens before its piece, where the piece starts, bytes so far,
        kind (lower case where the piece is complete), tokens in all."""
        states = self.states
        base, start, size, kind, total = states[-1]
        new = self.kind(c)
        if new == "W":
            states.append((total, size, size, "w", total))
            return
        if new == "L" and kind in "SL":
            at = states[-1] if kind == "S" else states[-2]
            word = bytes(self.raw[at[1] : size]).decode() + c if kind == "S" or (size - start == 1 and states[-2][3] == "S" and start == states[-2][2]) else ""
            if word in self.whole and at[2] - at[1] == 1:
                self._bytes(c, size)
                states.append((at[0], at[1], len(self.raw), "l", at[0] + self.whole[word]))
                return
        if new != kind or new == "N":
            base, start = total, size
        self._bytes(c, start)
        n = self._extend(start, self.end_tails, _MARK)[1]
        states.append((base, start, len(self.raw), "n" if new == "N" else new, base + n))

    def _bytes(self, c: str, start: int) -> None:
        for b in c.encode():
            self.raw.append(b)
            token, n = self._extend(start, self.plain_tails, b"")
            self.last.append(token)
            self.count.append(n)

    def _reset(self, total: int) -> None:
        self.raw, self.last, self.count = bytearray(), [], []
        self.states = [(total, 0, 0, "w", total)]

    def _cluster(self, some: str) -> Iterator[int]:
        """Counts behind each character of a stretch of its own."""
        if len(some) == 1 and (done := self.normal(some)):
            for c in done:
                self._push(c)
            yield self.states[-1][4]
            return
        form, sizes = Composer(), []
        for c in some:
            gone, new = form.add(c)
            if gone:
                del self.states[len(self.states) - sum(sizes[-gone:]) :], sizes[-gone:]
                size = self.states[-1][2]
                del self.raw[size:], self.last[size:], self.count[size:]
            for x in new:
                small = self.normal(x)
                sizes.append(len(small))
                for y in small:
                    self._push(y)
            yield self.states[-1][4]

    def _plain(self, text: str) -> Iterator[int]:
        if text.isascii():
            for c in text.lower():
                self._push(c)
                yield self.states[-1][4]
            return
        self.join = self.join or joining()
        at = 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k] not in self.join:
                yield from self._cluster(text[at:k])
                at = k

    def counts(self, text: str) -> list[int]:
        """The count of each prefix of one and more characters."""
        out, total = [], 0
        for k, part in enumerate(_SPECIAL.split(text)):
            if k % 2:  # all but its last character is text like the one before
                out += self._plain(part[:-1])
                total += 1
                out.append(total)
                self._reset(total)
            else:
                if not k:
                    self._reset(0)
                out += self._plain(part)
                total = self.states[-1][4]
        return out


class PrefixCounts(_Table):
    """Token counts of every prefix of a text, as changes from one code point to the next (int16, little-endian).

    The count at a text position is the count at the start of its chunk plus PrefixScan's for the part of the chunk
    before it, which gives all positions from left to right. Blanks add no token. A table keeps the changes of chunks.
    """

    joint = b"\0\0"

    def split(self, text: str) -> list[str]:
        text = blanks(text)
        return (text.lower() if _LATIN.fullmatch(text) and "<|" not in text else text).split(" ")

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        super().__init__(path, limit)
        self.scan, self.pieces = PrefixScan(self.words), {}
        self.plain: dict[bytes, tuple[bytes, int, int, dict]] = {}  # prefix -> last token, tokens, tokens with the end of a word, followers of the last

    def values(self, chunks: list[str]) -> list[bytes]:
        return [self._changes(c) for c in chunks]

    def _changes(self, chunk: str) -> bytes:
        if len(chunk) > KEEP_CHARS or "'" in chunk or "<|" in chunk or not _LATIN.fullmatch(chunk):
            n = self.scan.counts(chunk)
            return struct.pack(f"<{len(n)}h", *map(int.__sub__, n, [0, *n]))
        found, known = [], self.pieces
        for piece in _PIECES.findall(chunk.lower()):
            if piece not in known:
                if len(self.plain) + len(known) > 2 * self.limit:
                    known.clear()
                    self.plain.clear()
                known[piece] = self._piece(piece.encode())
            found.append(known[piece])
        return b"".join(found)

    def _piece(self, raw: bytes) -> bytes:
        """The changes within one short piece of Latin text: PrefixScan's step, with a table of the prefixes that words share."""
        plain, ranks, words = self.plain, self.words.marked, self.words
        tails, end_tails, end, n, size = self.scan.plain_tails, self.scan.end_tails, _MARK, [0], len(raw)
        for stop in range(1, size + 1):
            before = raw[:stop]
            state = plain.get(before)
            if state is None:
                last, count = (before, 1) if before in ranks else (b"", 0)
                at = 0 if count else stop - 1
                while at > 0 and (token := raw[at:stop]) in tails:
                    if token in ranks:
                        first, m, _, behind = plain[raw[:at]]
                        if m and (behind[token] if token in behind else words.compatible(first, token, behind)):
                            last, count = token, m + 1
                            break
                    at -= 1
                ended = int(before + end in ranks)
                at = 0 if ended or (stop < size and raw[stop] & 0xC0 == 0x80) else stop - 1  # not inside a character
                while at > 0 and (token := raw[at:stop]) in end_tails:
                    if (token := token + end) in ranks:
                        first, m, _, behind = plain[raw[:at]]
                        if m and (behind[token] if token in behind else words.compatible(first, token, behind)):
                            ended = m + 1
                            break
                    at -= 1
                state = plain[before] = last, count, ended, words.behind(last)
            if stop == size or raw[stop] & 0xC0 != 0x80:
                n.append(state[2])
        return struct.pack(f"<{len(n) - 1}h", *map(int.__sub__, n[1:], n))


_WORKERS: dict[tuple[str, str], object] = {}


def worker(kind: Callable, path: str):
    """One table for each worker process."""
    key = kind.__name__, path
    if key not in _WORKERS:
        _WORKERS[key] = kind(path)
    return _WORKERS[key]
